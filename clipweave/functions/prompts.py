"""What models are asked, with the placeholders each template must hold, and the answer's JSON schema."""

from __future__ import annotations

import string
from dataclasses import dataclass, fields

NEEDS = {"subtopics": {"transcript", "most"}, "classify": {"content", "topics"}, "repair_all": {"content"}, "repair_part": {"content", "transcript"}, "merge_topics": {"topics"}, "questions": {"query"}, "look": {"questions"}}


@dataclass(frozen=True)
class Prompts:
    subtopics: str = "Name at most {most} topics of this transcript, as JSON that maps \"0\", \"1\" and so on to topics.\n\n{transcript}"
    classify: str = "Which one of these topics fits the text best? Answer with JSON that maps its number to its name.\n\nTopics: {topics}\n\nText: {content}"
    repair_all: str = "Correct what the speech recognition misheard in this transcript. Change nothing else.\n\n{content}"
    repair_part: str = "Correct this part of a transcript. The whole reads: {transcript}\n\nPart: {content}"
    merge_topics: str = "Merge these topics of several videos into one list without repeats, as JSON that maps numbers to topics.\n\n{topics}"
    questions: str = "Write yes-or-no questions about an image that tell whether it fits this request, as a JSON list.\n\n{query}"
    look: str = "Answer each question about the images with true, false or null, as JSON that maps its number to the answer.\n\n{questions}"

    def __post_init__(self):
        for f in fields(self):
            missing = NEEDS[f.name] - {n for _, n, _, _ in string.Formatter().parse(getattr(self, f.name)) if n}
            if missing:
                raise ValueError(f"{f.name} lacks {', '.join(sorted(missing))}")


def _closed(**properties) -> dict:
    return {"type": "object", "properties": properties, "required": list(properties), "additionalProperties": False}


def answer_schema(kind: str, topic_ids=(), answer_ids=()) -> dict | None:
    """A strict schema of the answer's envelope; none for free text."""
    text = {"type": "string"}
    if kind == "topic":
        return _closed(id=text | {"enum": list(topic_ids)}, label=text)
    if kind == "topics":
        return _closed(topics={"type": "array", "items": _closed(id=text, label=text)})
    if kind == "string_list":
        return _closed(items={"type": "array", "items": text})
    if kind == "answers":
        return _closed(answers={"type": "array", "items": _closed(id=text | {"enum": list(answer_ids)}, answer={"type": ["boolean", "null"]})})
    return None
