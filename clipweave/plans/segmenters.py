"""From transcripts to segments with topics: by words, and by overlapping clusters of utterances.

Transcripts have video, text, words, segments and error_type, as functions.align makes
them; videos have video, path, topics (may be empty) and seconds. All calls to a language
model are rows of requests that providers.generate answers in parallel; keep writes what
it returned, so that no call is made twice, and the answers of one step are the next
one's columns. Requests a model could not answer end the run with an error that names
how many and why.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipweave.functions.prompts import Prompts
from clipweave.functions.text import sentence_end, stripped, topic_limit
from clipweave.operators import segmentation as cut
from clipweave.sources.providers import NoSpeech, ProviderError, generate

Keep = Callable[[DataFrame, str], DataFrame]
TOPICS = "map<string,string>"


def filled(template: str, **cells) -> F.Column:
    """A prompt's template with columns in its places."""
    out, rest = [], template
    while rest:
        at = min((rest.find("{" + k + "}") for k in cells if "{" + k + "}" in rest), default=-1)
        if at < 0:
            out.append(F.lit(rest))
            break
        name = next(k for k in cells if rest.startswith("{" + k + "}", at))
        out += [F.lit(rest[:at]), cells[name]]
        rest = rest[at + len(name) + 2 :]
    return F.concat(*out)


def numbered(topics: F.Column) -> F.Column:
    """A list of topics as a map from place, as text, to topic."""
    places = F.transform(F.sequence(F.lit(1), F.size(topics)), lambda i: (i - 1).cast("string"))
    return F.when(F.size(topics) > 0, F.map_from_arrays(places, topics)).otherwise(F.from_json(F.lit("{}"), TOPICS))


def require_speech(transcripts: DataFrame) -> None:
    """Before any model is asked: every transcript has speech and can be read."""
    bad = transcripts.where("error_type IS NOT NULL").groupBy("error_type").count().collect()
    if bad:
        raise NoSpeech("; ".join(f"{r['count']} transcripts: {r.error_type}" for r in sorted(bad)))


@dataclass
class Segmenter:
    """What both ways share. client makes a model's client in the task that uses it."""

    client: Callable[[], Callable[[str], str]]
    keep: Keep
    least: float = 10.0
    longest: float | None = None
    max_topics: int | None = None
    most_attempts: int = 3
    prompts: Prompts = field(default_factory=Prompts)
    runs: int = 0

    def kept(self, df: DataFrame, name: str) -> DataFrame:
        self.runs += 1
        return self.keep(df, f"{self.runs}-{name}")

    def ask(self, requests: DataFrame, kind: str, **spec) -> DataFrame:
        """requests (keys, prompt, and what generate knows) with value; each is asked once."""
        keys = [c for c in requests.columns if c not in ("prompt", "topic_ids", "answer_ids", "max_items")]
        rows = self.kept(requests.withColumn("request_id", F.monotonically_increasing_id()), "requests")
        said = self.kept(generate(rows, self.client, kind, self.most_attempts, **spec), "answers")
        failed = said.where("value IS NULL").groupBy("error_type").count().collect()
        if failed:
            raise ProviderError("; ".join(f"{r['count']} {kind} requests: {r.error_type}" for r in sorted(failed)))
        return rows.join(said, "request_id").select(*keys, "value", "attempts")

    def video_topics(self, videos: DataFrame, transcripts: DataFrame) -> DataFrame:
        """(video, topics): a video's own topics if it has any, else what the model finds, up to a number that follows its length."""
        own = F.coalesce(F.size("topics"), F.lit(0)) > 0
        given = videos.where(own).select("video", numbered(F.col("topics")).alias("topics"))
        most = F.lit(self.max_topics).cast("int") if self.max_topics else topic_limit(F.floor("seconds"), 3, 2, 0.5).cast("int")
        open_ = videos.where(~own).join(transcripts.select("video", "text"), "video").withColumn("max_items", most)
        prompt = filled(self.prompts.subtopics, most=F.col("max_items").cast("string"), transcript=F.col("text"))
        found = self.ask(open_.select("video", "max_items", prompt.alias("prompt")), "topics")
        return given.unionByName(found.select("video", F.from_json("value", TOPICS).alias("topics")))

    def classified(self, rows: DataFrame, topics: DataFrame, into: str) -> DataFrame:
        """rows (video, content, ...) with the label of one topic of their video's; the label is the map's, whatever the model wrote beside the id."""
        rows = rows.join(topics, "video")
        prompt = filled(self.prompts.classify, content=F.col("content"), topics=F.to_json("topics"))
        asked = rows.select(*rows.columns, F.map_keys("topics").alias("topic_ids"), prompt.alias("prompt"))
        said = self.ask(asked, "topic")
        return said.withColumn(into, F.element_at("topics", F.map_keys(F.from_json("value", TOPICS))[0])).drop("topics", "value", "attempts")

    def finished(self, segments: DataFrame, videos: DataFrame) -> DataFrame:
        """Orders from 0 on, and the video's path."""
        rows = segments.select("video", "order", F.col("topic").alias("video_topic"), "start", "end", "content")
        return cut.renumbered(rows, "video", "order").join(videos.select("video", F.col("path").alias("video_path")), "video")


class WordSegmenter(Segmenter):
    """Words to segments of at least so many seconds, neighbours of one topic merged."""

    def segments(self, videos: DataFrame, transcripts: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(segments, topics by video)."""
        require_speech(transcripts)
        rows = cut.word_segments(cut.flattened(transcripts, "video"), self.least)
        topics = self.kept(self.video_topics(videos, transcripts), "topics")
        labelled = self.classified(rows, topics, "topic").withColumn("pos", F.col("order").cast("long"))
        return self.kept(self.finished(cut.merge_topics(labelled, self.longest), videos), "segments"), topics

    def with_global_topics(self, videos: DataFrame, transcripts: DataFrame, topics: list[str] | dict[str, str] | None = None) -> DataFrame:
        """Segments of all videos, also classified by topics they share: given ones, or one merged list of all videos' topics."""
        rows, own = self.segments(videos, transcripts)
        spark = videos.sparkSession
        if topics:
            known = topics if isinstance(topics, dict) else {str(i): t for i, t in enumerate(topics)}
            shared = spark.createDataFrame([(known,)], f"topics {TOPICS}")
        else:
            # one request holds the topics of all videos; it is as long as their lists
            every = own.select("video", F.map_values("topics").alias("labels")).agg(F.array_sort(F.collect_list(F.struct("video", "labels"))).alias("x"))
            every = every.select(filled(self.prompts.merge_topics, topics=F.to_json(F.flatten(F.transform("x", lambda x: x["labels"])))).alias("prompt"))
            shared = self.ask(every, "string_list").select(numbered(F.from_json("value", "array<string>")).alias("topics"))
        shared = own.select("video").crossJoin(F.broadcast(shared))  # one row
        return self.kept(self.classified(rows, shared, "global_topic"), "global-segments")


class ClusterSegmenter(Segmenter):
    """Utterances, repaired by the model, in overlapping clusters; each takes the topic of the shortest cluster that holds it, and neighbours of one topic are fused."""

    def segments(self, videos: DataFrame, transcripts: DataFrame, ratio: float = 0.5, pause: float = 0.7) -> tuple[DataFrame, DataFrame]:
        """(segments, topics by video). Topics are found in the transcript as it came, clusters hold repaired text."""
        require_speech(transcripts)
        raw = cut.transcript_chunks(transcripts)
        whole = self.ask(transcripts.select("video", filled(self.prompts.repair_all, content=F.col("text")).alias("prompt")), "text")
        whole = whole.select("video", stripped(F.get_json_object(F.concat(F.lit('{"v":'), "value", F.lit("}")), "$.v")).alias("full"))
        prompt = filled(self.prompts.repair_part, transcript=F.col("full"), content=F.col("content"))
        part = self.ask(raw.join(whole, "video").select("video", "order", "start", "end", prompt.alias("prompt")), "text")
        part = part.select("video", "order", "start", "end", stripped(F.get_json_object(F.concat(F.lit('{"v":'), "value", F.lit("}")), "$.v")).alias("content"))
        part = self.kept(part.withColumn("ends", sentence_end(F.col("content"))).withColumn("pos", F.col("order")), "parts")
        topics = self.kept(self.video_topics(videos, transcripts), "topics")
        member = cut.overlapping(part, self.least, ratio, pause).join(part, ["video", "order"])
        member = member.select(F.col("video").alias("video_index"), "cluster_id", F.col("order").alias("segment_index"), "content", "start", "end")
        spans = self.kept(cut.cluster_spans(member), "clusters")
        labelled = self.classified(spans.withColumnRenamed("video_index", "video"), topics, "topic").select(F.col("video").alias("video_index"), "cluster_id", "topic")
        best = cut.shortest_cover(member, spans).join(labelled, ["video_index", "cluster_id"])
        rows = part.join(best.select(F.col("video_index").alias("video"), F.col("segment_index").alias("order"), "topic"), ["video", "order"])
        return self.kept(self.finished(cut.fuse(rows, self.longest), videos), "segments"), topics
