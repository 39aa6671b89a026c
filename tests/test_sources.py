"""Reading, writing, alignment, providers, streams."""

import itertools
import json

import pytest
from pyspark.sql import functions as F

from clipweave.functions.align import Mismatch, align, aligned, typed_words
from clipweave.functions.prompts import Prompts, answer_schema
from clipweave.sources import datasets, providers
from clipweave.streaming.sessions import sessions


def test_datasets_round_trip(spark, tmp_path):
    v = [{"name": "b", "path": "v/b.mp4", "topics": ["x"], "segments": [{"content": "hi", "start": 0.0, "end": 1.5}]}, {"name": "a", "path": "v/a.mp4", "topics": [], "segments": []}]
    (tmp_path / "in.json").write_text(json.dumps(v))
    df = datasets.read_videos(spark, str(tmp_path / "in.json"), "/data")
    row = df.where("name = 'b'").first()
    assert row.path == "/data/v/b.mp4" == row.segments[0].video_path and row.segments[0].order is None and row.segments[0].video_topic == ""
    assert [r.name for r in datasets.invalid_videos(df).collect()] == ["a"]
    assert datasets.segments(df).first().video_index == 1
    datasets.dump_videos(df, str(tmp_path / "out.json"), "/data")
    assert json.loads((tmp_path / "out.json").read_text())[1]["segments"][0]["video_path"] == "v/b.mp4"
    datasets.write_videos(df, str(tmp_path / "out"), "/data")
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_append_unseen(spark, tmp_path):
    path = str(tmp_path / "t")
    for ids in ([1, 2], [2, 3]):
        datasets.append_unseen(spark.createDataFrame([(i, "x") for i in ids], "id long, p string"), path, "id")
    assert sorted(int(r.id) for r in spark.read.option("header", True).csv(path).collect()) == [1, 2, 3]


def test_list_videos(spark, tmp_path):
    for n in ("b.mp4", "a.mp4", "c.txt"):
        (tmp_path / n).write_bytes(b"x")
    assert [r.path.rsplit("/", 1)[1] for r in datasets.list_videos(spark, str(tmp_path)).collect()] == ["a.mp4", "b.mp4"]
    assert datasets.video_file(str(tmp_path / "a.mp4"))["name"] == "a"
    with pytest.raises(ValueError):
        datasets.video_file(str(tmp_path / "c.txt"))


@pytest.mark.parametrize("gaps", list(itertools.product([" ", ", ", " (", "… «", "-", "?\" "], repeat=2)))
def test_alignment_round_trip(gaps):
    text = f"¿Um{gaps[0]}dois{gaps[1]}três!"
    got = align([("um", 0, 1), ("dois", 1, 2), ("três", 2, 3)] if False else [("Um", 0, 1), ("dois", 1, 2), ("três", 2, 3)], text)
    assert "".join(t + s for t, _, _, s in got) == text


def test_alignment_rejects_other_words(spark):
    for words in ([("a", 0, 1)], [("b", 0, 1), ("c", 1, 2)], [("a", 0, 1), ("b", 1, 2), ("c", 2, 3)]):
        with pytest.raises(Mismatch):
            align(words, "a b")
    assert [t for t, *_ in align([("你", 0, 1), ("好", 1, 2)], "你好。")] == ["你", "好。"]
    df = spark.createDataFrame([([("a", 0.0, 1.0), ("b", 0.5, 2.0)], "A? b"), ([("a", 2.0, 1.0)], "a"), (None, None)], "w array<struct<text:string,start:double,end:double>>, t string")
    assert [r.r.error for r in df.select(aligned(F.col("w"), F.col("t")).alias("r")).collect()] == ["words and transcript differ", "bad times", None]


def test_attempts_share_one_budget():
    answers = iter(["no", providers.RateLimited(), '{"items": ["x"]}'])

    def call(_):
        x = next(answers)
        if isinstance(x, Exception):
            raise x
        return x

    waits = []
    value, records = providers.attempt(call, "p", "string_list", 3, sleep=waits.append)
    assert value == ["x"] and [r["status"] for r in records] == ["failed", "failed", "completed"] and waits == [1.0, 2.0]

    def denied(_):
        raise providers.error_of(401)

    assert len(providers.attempt(denied, "p", "text", 3, sleep=waits.append)[1]) == 1


def test_generate(spark):
    df = spark.createDataFrame([(1, "a"), (2, "")], "request_id long, prompt string")
    got = {r.request_id: (r.value, r.attempts, r.error_type) for r in providers.generate(df, lambda: lambda p: p, "text", 1).collect()}
    assert got == {1: ('"a"', 1, None), 2: (None, 1, "Invalid")}


def test_configuration():
    c = providers.configured("LLM", "m", {"LLM_MODEL": " "}, {"LLM_MODEL": "env", "LLM_API_KEY": "hidden"}, {"LLM_MODEL": "file", "LLM_LANGUAGE": "auto"})
    assert c.model == "env" and c.language is None and "hidden" not in repr(c)
    for bad in ({"LLM_BASE_URL": "ftp://x"}, {"LLM_BASE_URL": "http://u:p@x"}, {"LLM_TIMEOUT": "-1"}):
        with pytest.raises(providers.Configuration):
            providers.configured("LLM", "m", bad, {}, {})


def test_sessions(spark):
    t = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:30:00"), (1, "2024-01-01 05:00:00")], "video long, ts string").select("video", F.col("ts").cast("timestamp").alias("ts"))
    assert sorted(r.n_words for r in sessions(t).collect()) == [1, 2]


def test_typed_words():
    w = lambda t, a, b: {"type": "word", "text": t, "start": a, "end": b}
    words, events = typed_words([w("¿", 0, 0), w("Qué", 0, 1), {"type": "spacing", "text": " "}, w("?", 1, 1), {"type": "audio_event", "text": "(laughs)"}, w("Sí", 1, 2)])
    assert [t for t, *_ in words] == ["¿Qué?", "Sí"] and events == [("(laughs)", 1)]
    for bad in ([w("a b", 0, 1)], [w("a", 2, 1)], [w("a", 1, 2), w("b", 1, 3)], [{"type": "spacing", "text": "x"}], [{"type": "other", "text": "x"}], [w("a", True, 2)]):
        with pytest.raises(Mismatch):
            typed_words(bad)


def test_prompts_and_schemas():
    assert "{content}" in Prompts().classify
    with pytest.raises(ValueError):
        Prompts(classify="{content}")
    assert answer_schema("topic", ["0"])["properties"]["id"]["enum"] == ["0"] and answer_schema("text") is None
