"""Cutting transcripts. Words and segments are rows of a video in order; each fold sees one video's rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from clipweave.functions.text import sentence_end


def joined(texts: list[str], separators: list[str]) -> str:
    """Words with what separates each from the next; the last one's separator is left out."""
    return "".join(t + x for t, x in zip(texts, [*separators[:-1], ""]))


def joined_words(pos: str = "pos", text: str = "text", separator: str = "separator_after") -> Column:
    """The same as an aggregate of rows."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(text).alias("t"), F.col(separator).alias("s"))))
    return F.array_join(F.transform(rows, lambda x, i: F.when(i + 1 < F.size(rows), F.concat(x["t"], x["s"])).otherwise(x["t"])), "")


def flattened(transcripts: DataFrame, *keys: str) -> DataFrame:
    """Transcripts with an array of words to a row a word: the keys, pos, text, start, end, separator_after, ends."""
    rows = transcripts.select(*keys, F.posexplode("words").alias("pos", "w"))
    return rows.select(*keys, F.col("pos").cast("long").alias("pos"), "w.text", "w.start", "w.end", "w.separator_after", sentence_end(F.col("w.text")).alias("ends"))


def _separated(words: DataFrame) -> DataFrame:
    return words if "separator_after" in words.columns else words.withColumn("separator_after", F.lit(" "))


def word_segments(words: DataFrame, least: float = 10.0) -> DataFrame:
    """Words (video, pos, text, start, end, ends and, unless it is a blank, separator_after) to segments: closed by a word that ends a sentence once least seconds are reached; the rest is one more."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        out, held, start = [], [], None

        def close(r):
            out.append((r.video, len(out), joined(*map(list, zip(*held))), start, r.end))

        for r in rows.sort_values("pos").itertuples():
            start = r.start if start is None else start
            held.append((r.text, r.separator_after))
            if r.ends and r.end - start >= least:
                close(r)
                held, start = [], None
        if held:
            close(r)
        return pd.DataFrame(out, columns=["video", "order", "content", "start", "end"])

    kind = words.schema["video"].dataType.simpleString()
    return _separated(words).groupBy("video").applyInPandas(fold, f"video {kind}, order int, content string, start double, end double")


@F.udtf(returnType="video long, order int, content string, start double, end double")
class SegmentWords:
    """word_segments as a table function: words partitioned by video, ordered by pos, and the least seconds."""

    def __init__(self):
        self.held, self.start, self.n, self.video, self.end = [], None, 0, None, None

    def row(self):
        return self.video, self.n, joined(*map(list, zip(*self.held))), self.start, self.end

    def eval(self, word: Row, least: float):
        self.video, self.end = word["video"], word["end"]
        self.start = word["start"] if self.start is None else self.start
        self.held.append((word["text"], word["separator_after"]))
        if word["ends"] and self.end - self.start >= least:
            yield self.row()
            self.held, self.start, self.n = [], None, self.n + 1

    def terminate(self):
        if self.held:
            yield self.row()


def word_segments_function(words: DataFrame, least: float = 10.0) -> DataFrame:
    """word_segments by the table function, which needs no array of a video's words."""
    rows = _separated(words).select(F.col("video").cast("long").alias("video"), "pos", "text", "start", "end", "ends", "separator_after")
    return SegmentWords(rows.asTable().partitionBy("video").orderBy("pos"), F.lit(float(least)))


def topics_in_order(rows: DataFrame) -> DataFrame:
    """(video, topics, before): every video's topics (video, pos, topic) in order, repeats kept, and how many stand before them in the list of all videos' topics. One task sees a row a video; no list holds them all."""
    own = rows.groupBy("video").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "topic"))), lambda x: x["topic"]).alias("topics"))
    upto = F.sum("n").over(W.orderBy("v").rowsBetween(W.unboundedPreceding, -1))
    places = own.select(F.col("video").alias("v"), F.size("topics").alias("n")).select("v", F.coalesce(upto, F.lit(0)).cast("long").alias("before"))
    return own.join(places, F.col("video") == F.col("v")).drop("v")


def chunks(words: DataFrame) -> DataFrame:
    """Words to chunks that end at each sentence end: video, order, content, start, end, n_words."""
    w = W.partitionBy("video").orderBy("pos")
    island = F.coalesce(F.sum(F.col("ends").cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = _separated(words).withColumn("order", island).groupBy("video", "order")
    return rows.agg(joined_words().alias("content"), F.min_by("start", "pos").alias("start"), F.max_by("end", "pos").alias("end"), F.count("*").alias("n_words"))


def transcript_chunks(transcripts: DataFrame) -> DataFrame:
    """video, order, content, start, end of transcripts (video, words, segments): the service's own segments where it gives any, else sentences."""
    own = transcripts.where(F.size("segments") > 0).select("video", F.posexplode("segments").alias("order", "s"))
    own = own.select("video", F.col("order").cast("long").alias("order"), F.col("s.text").alias("content"), "s.start", "s.end")
    rest = flattened(transcripts.where(F.coalesce(F.size("segments"), F.lit(0)) <= 0), "video")
    return own.unionByName(chunks(rest).select("video", F.col("order").cast("long").alias("order"), "content", "start", "end"))


def renumbered(segments: DataFrame, video: str, *order) -> DataFrame:
    """The segments with order from 0 on, by the columns given."""
    return segments.withColumn("order", (F.row_number().over(W.partitionBy(video).orderBy(*order)) - 1).cast("long"))


def goes_on(words: DataFrame, pause: float = 0.7) -> DataFrame:
    """With goes_on: whether the next one of the video begins less than pause seconds after the end."""
    after = F.lead("start").over(W.partitionBy("video").orderBy("pos"))
    return words.withColumn("goes_on", F.coalesce(after - F.col("end") < pause, F.lit(False)))


def cluster_spans(members: DataFrame) -> DataFrame:
    """(video_index, cluster_id, duration, content) of clusters' segments (video_index, cluster_id, segment_index, content, start, end)."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment_index", "content"))), lambda x: x["content"]), " ")
    return members.groupBy("video_index", "cluster_id").agg(F.round(F.max("end") - F.min("start"), 6).alias("duration"), text.alias("content"))


def shortest_cover(members: DataFrame, spans: DataFrame) -> DataFrame:
    """Of every segment the cluster of the least duration that has it; the first wins ties."""
    rank = F.row_number().over(W.partitionBy("video_index", "segment_index").orderBy("duration", "cluster_id"))
    rows = members.join(spans.select("video_index", "cluster_id", "duration"), ["video_index", "cluster_id"]).withColumn("r", rank)
    return rows.where("r = 1").select("video_index", "segment_index", "cluster_id")


def merge_topics(segments: DataFrame, longest: float | None = None) -> DataFrame:
    """Neighbours of one topic become one segment, if the whole is not longer than longest."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = []
        for r in rows.sort_values("pos").itertuples():
            if out and out[-1][2] == r.topic and (longest is None or r.end - out[-1][3] <= longest):
                out[-1][4], out[-1][5] = r.end, f"{out[-1][5]} {r.content}"
            else:
                out.append([r.video, len(out), r.topic, r.start, r.end, r.content])
        return pd.DataFrame(out, columns=["video", "order", "topic", "start", "end", "content"])

    return segments.groupBy("video").applyInPandas(fold, f"video {segments.schema['video'].dataType.simpleString()}, order int, topic string, start double, end double, content string")


def fuse(segments: DataFrame, longest: float | None) -> DataFrame:
    """Neighbours of one topic become one while their durations sum to less than longest; without it nothing is fused."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = []
        for r in rows.sort_values("pos").itertuples():
            if out and longest is not None and out[-1][2] == r.topic and out[-1][4] - out[-1][3] + r.end - r.start < longest:
                out[-1][4], out[-1][5] = r.end, f"{out[-1][5]} {r.content}"
            else:
                out.append([r.video, len(out), r.topic, r.start, r.end, r.content])
        return pd.DataFrame(out, columns=["video", "order", "topic", "start", "end", "content"])

    return segments.groupBy("video").applyInPandas(fold, f"video {segments.schema['video'].dataType.simpleString()}, order int, topic string, start double, end double, content string")


def overlapping(segments: DataFrame, least: float = 10.0, ratio: float = 0.5, pause: float = 0.7) -> DataFrame:
    """(video, cluster_id, order): runs of raw segments that overlap by about ratio of the least length.

    A run goes on while the pause to the next is short, and closes at a sentence end once
    it is long enough; the next begins with its last segments.
    """
    room = int(least * ratio)

    def seed(run: list) -> list:
        kept = [run[-1]]
        for r in run[-2:0:-1]:
            if abs(kept[-1].end - r.start - room) > abs(kept[-1].end - kept[0].start - room):
                break
            kept.insert(0, r)
        return kept

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        items, out, run, n = list(rows.sort_values("pos").itertuples()), [], [], 0
        for i, r in enumerate(items):
            run.append(r)
            if i == len(items) - 1:
                out += [(r.video, n, x.pos) for x in run]
            elif items[i + 1].start - r.end < pause:
                continue
            elif run[-1].end - run[0].start >= least and r.ends:
                out += [(r.video, n, x.pos) for x in run]
                n, run = n + 1, seed(run)
        return pd.DataFrame(out, columns=["video", "cluster_id", "order"])

    return segments.groupBy("video").applyInPandas(fold, f"video {segments.schema['video'].dataType.simpleString()}, cluster_id int, order long")


def until(segments: DataFrame, second: Column, slack: float = 1) -> DataFrame:
    """Segments from the first on, up to the first whose rounded end is past second + slack; halves round to even."""
    run = W.partitionBy("video_index").orderBy("segment_index").rowsBetween(W.unboundedPreceding, W.currentRow)
    return segments.withColumn("ok", F.bool_and(F.bround("end", 0) <= second + slack).over(run)).where("ok").drop("ok")
