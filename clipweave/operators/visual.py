"""Visual words: keyframes by mutual matches, and a vocabulary of their descriptors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mutual(a: np.ndarray, b: np.ndarray, threshold: float = 0.95) -> int:
    """How many descriptors are each other's nearest by dot product, both at least the threshold."""
    if not len(a) or not len(b):
        return 0
    s = a @ b.T
    there, back = s.argmax(axis=1), s.argmax(axis=0)
    own = np.arange(len(a))
    return int(((back[there] == own) & (s[own, there] >= threshold)).sum())


def keyframes(descriptors: DataFrame, ratio: float = 0.1) -> DataFrame:
    """(segment, frame, size): frames, first and last apart, that match every frame kept before in fewer than ratio of that one's descriptors. descriptors: segment, frame, kp, vec."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        frames = [(f, np.stack(g.sort_values("kp")["vec"].to_list())) for f, g in rows.groupby("frame")][1:-1]
        kept: list = []
        for f, d in frames:
            if all(mutual(d, e) < ratio * len(e) for _, e in kept):
                kept.append((f, d))
        return pd.DataFrame([(rows["segment"].iloc[0], f, len(d)) for f, d in kept], columns=["segment", "frame", "size"])

    return descriptors.groupBy("segment").applyInPandas(fold, "segment long, frame long, size int")


def visual_vocabulary(descriptors: DataFrame, size: int = 300, seed: int = 1) -> DataFrame:
    """The descriptors with word, their cluster; seeded, so reruns agree."""
    rows = descriptors.withColumn("features", array_to_vector(F.transform("vec", lambda x: x.cast("double"))))
    model = KMeans(k=size, seed=seed, maxIter=10).fit(rows)
    return model.transform(rows).drop("features").withColumnRenamed("prediction", "word")
