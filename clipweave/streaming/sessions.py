"""An extension: chunks of a stream of timed words that pauses cut, as session windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(words: DataFrame, pause: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(video, start, end, n_words) of a stream of (video, ts)."""
    w = F.session_window("ts", pause)
    return words.withWatermark("ts", late).groupBy("video", w.alias("w")).agg(F.count("*").alias("n_words")).select("video", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_words")
