"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

A document's position is a hash; a block is a range of positions in one source, so
blocks are random, disjoint subsets of about BLOCK_DOCS documents, and a source's
blocks in order of position are in random order. A source's target buys whole passes
over its blocks, then the first blocks of a further pass, then documents of the one
block where the target ends, largest first while they fit. Each pass of a block is a
draw; sums per block, superblock and source (never per document) place the targets.

A tree over the output shards splits the sources' draws: at a node the draws that go
left are multivariate-hypergeometric, with a generator seeded by the node. A leaf
thus owns an interval of every source's draws; each shard's task walks from the root
on its own, so nothing grows on the driver but one row a source. From the intervals
comes a row for each block with the shards of its passes. Documents look up their block
there, by one join that Spark broadcasts while the table of blocks is small; the mix
itself is dealt to shards in one more shuffle.

The generator of the tree takes up to 10^9 draws in all, so blocks hold BLOCK_DOCS
documents or, beyond 2^28 blocks, as many more as keep it at that. Words of a text are
counted in one row.

Nulls: a null text has size 0; documents of a null source form the last source; null
ids are kept. Documents of size 0 may be drawn, and weigh nothing. Repeated rows are
drawn alike where a target ends. An empty table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import TOKEN, Scratch

WEIGHTS, SHARE, MOST_COPIES = (3, 1, 2), 1.5, 2
BLOCK_DOCS, SUPER, SHARD_WORDS, MOST_BLOCKS = 256, 10, 2_000_000, 1 << 28
OWN = ("size", "source_size", "target", "shards")


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> list[float]:
    """Each source's words: the whole by weight, none above most times its size, excess shared anew by weight."""
    w = [float(weights[i % len(weights)]) for i in range(len(sizes))]
    out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = share * sum(sizes)
    while open_:
        total = sum(w[i] for i in open_)
        full = {i for i in open_ if left * w[i] / total > most * sizes[i]}
        if not full:
            for i in open_:
                out[i] = left * w[i] / total
            break
        for i in full:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in full)
        open_ -= full
    return out


def _walk(draws: np.ndarray, shards: int, seed: int, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """A leaf's first draw and number of draws, by source."""
    n, first, total = draws.copy(), np.zeros_like(draws), int(draws.sum())
    lo, hi = 0, shards
    while hi - lo > 1:
        mid = (lo + hi) // 2
        room = total * mid // shards - total * lo // shards
        rng = np.random.Generator(np.random.Philox(key=[seed, lo * shards + hi]))
        left = rng.multivariate_hypergeometric(n, room, method="marginals")
        if leaf < mid:
            n, hi = left, mid
        else:
            n, first, lo = n - left, first + left, mid
    return first, n


def _greedy(units: pd.DataFrame) -> pd.DataFrame:
    """Of one source's last block: largest first, what still fits."""
    units = units.sort_values(["words", "u"], ascending=[False, True])
    left, kept = float(units["rest"].iloc[0]), []
    for w in units["words"]:
        kept.append(w <= left)
        left -= w * kept[-1]
    if not any(kept):  # a source of few documents: the smallest, if that comes nearer
        kept[-1] = bool(units["words"].iloc[-1] < 2 * left)
    return units.loc[kept, ["s", "u"]]


def draw(docs: DataFrame, scratch: Scratch, text: str = "text", source: str = "source", doc_id: str = "doc_id", seed: int = 7, block_docs: int = BLOCK_DOCS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The documents with size, source_size, target and shards, the output shards that get a copy each (columns of these names are replaced)."""
    spark = docs.sparkSession
    base = docs.drop(*OWN)
    base = base.select(F.struct(*[base[c] for c in base.columns]).alias("row"), base[source].alias("source"), F.coalesce(F.regexp_count(base[text], F.lit(TOKEN)), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.lit(seed), base[doc_id], base[text]).alias("u"))
    narrow = scratch.save(base.select("source", "size", "u"), "narrow")
    per = sorted(((r.source, r.n, r.words) for r in narrow.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("words")).collect()), key=lambda r: (r[0] is None, (r[0] or "").encode()))
    goal = targets([w for *_, w in per])
    block_docs = max(block_docs, -(-sum(n for _, n, _ in per) // MOST_BLOCKS))
    bits = [min(40, max(0, int(np.ceil(np.log2(max(n / block_docs, 1)))))) for _, n, _ in per]
    full = [min(MOST_COPIES, int(t // w)) if w else 0 for (*_, w), t in zip(per, goal)]
    rows = [(k, s, w, t, b, f, t - f * w) for k, ((s, _, w), t, b, f) in enumerate(zip(per, goal, bits, full))]
    sources = spark.createDataFrame(rows, "s int, source string, source_size long, target double, bits int, full int, rest double")

    def placed(df: DataFrame) -> DataFrame:
        """With s and block: the leading bits of the position. There is one row a source, so this side may be broadcast."""
        df = df.join(F.broadcast(sources), df["source"].eqNullSafe(sources["source"])).drop(sources["source"])
        return df.withColumn("block", F.when(F.col("bits") > 0, F.expr("shiftrightunsigned(u, 64 - bits)")).otherwise(F.lit(0).cast("long")))

    block = placed(narrow).groupBy("s", "block").agg(F.sum("size").alias("words"), F.first("rest").alias("rest")).withColumn("super", F.shiftright("block", SUPER))
    block = scratch.save(block, "blocks")
    upper = block.groupBy("s", "super").agg(F.sum("words").alias("w"))
    upto = W.partitionBy("s").orderBy("super").rowsBetween(W.unboundedPreceding, -1)
    upper = upper.select("s", "super", F.coalesce(F.sum("w").over(upto), F.lit(0)).alias("base"))
    within = W.partitionBy("s", "super").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    block = block.join(upper, ["s", "super"]).withColumn("before", F.col("base") + F.coalesce(F.sum("words").over(within), F.lit(0)))
    last = block.where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest")) & (F.col("rest") > 0))
    last = scratch.save(last.select("s", "block", (F.col("rest") - F.col("before")).alias("rest")), "last")
    ends = {r.s: r.block for r in last.collect()}  # one a source at most
    whole = [ends.get(k, 0) for k in range(len(per))]  # blocks that the last pass takes whole
    units = placed(narrow).drop("rest").join(F.broadcast(last), ["s", "block"]).groupBy("s", "u", "rest").agg(F.sum("size").alias("words"))
    taken = scratch.save(units.groupBy("s").applyInPandas(_greedy, "s int, u long"), "taken")

    draws = np.array([f * 2**b + e + (k in ends) for k, (f, b, e) in enumerate(zip(full, bits, whole))], np.int64)
    shards = max(1, int(np.ceil(sum(goal) / shard_words)))

    def leaves(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for leaf in frame["id"]:
                first, n = _walk(draws, shards, seed, int(leaf))
                yield pd.DataFrame({"s": np.arange(len(n), dtype=np.int32), "first": first, "n": n, "shard": np.int64(leaf)})[n > 0]

    share = spark.range(shards).mapInPandas(leaves, "s int, first long, n long, shard long")
    # A row a draw, narrow, and from these a row a block; draws count up through a source's passes.
    share = share.select("s", "shard", F.explode(F.expr("sequence(first, first + n - 1)")).alias("j")).join(F.broadcast(sources.select("s", "bits")), "s")
    share = share.select("s", F.expr("j & ((1L << bits) - 1)").alias("block"), F.struct(F.expr("shiftright(j, bits)").alias("pass"), "shard").alias("p"))
    place = share.groupBy("s", "block").agg(F.array_sort(F.collect_list("p")).alias("p")).select("s", "block", F.transform("p", lambda x: x["shard"]).alias("places"))
    place = scratch.save(place, "places")  # MOST_COPIES shards a block; Spark knows its size and chooses the join

    extra = spark.createDataFrame([(k, e) for k, e in enumerate(whole)], "s int, whole long")
    out = placed(base).join(F.broadcast(extra), "s").join(taken.withColumn("fits", F.lit(True)), ["s", "u"], "left")
    more = (F.col("block") < F.col("whole")) | F.coalesce("fits", F.lit(False))
    copies = F.least(F.col("full") + more.cast("int"), F.lit(MOST_COPIES))
    out = out.withColumn("copies", copies).join(place, ["s", "block"], "left")
    shards_ = F.slice(F.coalesce("places", F.array().cast("array<long>")), F.lit(1), F.col("copies"))
    return out.select("row.*", "size", "source_size", "target", shards_.alias("shards"))


def mix(docs: DataFrame, scratch: Scratch, seed: int = 7, **options) -> DataFrame:
    """The mix itself: a row for every copy, with copy (from 0) and shard, each shard in one task and shuffled there."""
    drawn = draw(docs, scratch, seed=seed, **options)
    kept = [c for c in docs.columns if c not in ("copy", "shard")]
    rows = drawn.select(*kept, F.posexplode("shards").alias("copy", "shard"))
    return rows.repartition("shard").sortWithinPartitions("shard", F.xxhash64(F.lit(seed + 1), "shard", "copy", "doc_id"), "doc_id", "copy")
