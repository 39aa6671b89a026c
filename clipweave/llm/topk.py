"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code has a bit for each component, 1 where it is positive. Codes are cut into
segments, each of about as many bits as the number of codes has, and the index is a
table of (segment, value, code). Search radii of the segments grow one by one: round s
looks up, for every query that is still open, the values at distance s of each segment
of its own code, by a join on (segment, value), and verifies the codes found by their
Hamming distance. A code at distance d differs by at most d div m bits in some one of
its m segments, so after round s every code at distance up to m * s + m - 1 has been
seen. A query is done once that covers its k-th verified distance, and leaves. Where a
segment has more values at the next radius than the index has codes, the few queries
still open, far from everything, are verified against all codes in blocks of BLOCK. Of each
query the k + 1 best codes are kept between rounds, which prunes what later rounds find.

Of one code the k + 1 rows with the least ids are indexed, since no more can be among
the k nearest: copies cost nothing, and the result is whole. No row goes to all tasks;
a value that many codes share is a join's skewed key, which Spark splits.

Ties in distance go to the smaller id; a query is not its own neighbour. Nulls: rows
with a null id, a null vector or one of another length than bits have no code and take
no part; a component that is null or no number counts as not positive. Repeated rows
count once; of an id with several vectors the one with the least code counts. An empty
table gives an empty result. Columns besides id and vector are not read.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations, count
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch

BITS, BLOCK = 64, 4096


def code(vector: Column, bits: int = BITS) -> Column:
    """The signs as a long, component 0 in the lowest bit."""
    one = F.transform(vector, lambda x, i: F.when((x > 0) & ~F.isnan(x), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(vector) == bits, F.aggregate(one, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)))


def width(codes: int) -> int:
    """Bits of a segment: 8, 16 or 32, whichever has the number of codes nearest."""
    return 8 if codes < 1 << 12 else 16 if codes < 1 << 24 else 32


def _segments(c: Column, w: int) -> Column:
    """An array of the values of a code's segments."""
    return F.array(*[F.shiftrightunsigned(c, j * w).bitwiseAND(F.lit((1 << w) - 1)) for j in range(BITS // w)])


def _masks(df: DataFrame, w: int, s: int) -> DataFrame:
    """A row for every way to flip s of w bits, in column mask; with s = 1 also for none."""
    if comb(w, s) <= 5000:
        ways = [c for t in ({0, 1} if s == 1 else {s}) for c in combinations(range(w), t)]
        return df.withColumn("mask", F.explode(F.expr("array(" + ",".join(f"{sum(1 << i for i in c)}L" for c in ways) + ")")))
    df = df.withColumn("mask", F.lit(0).cast("long")).withColumn("top", F.lit(-1))  # bit after bit, each above the last
    for left in range(s, 0, -1):
        df = df.withColumn("top", F.explode(F.expr(f"sequence(top + 1, {w - left})"))).withColumn("mask", F.expr("mask | shiftleft(1L, top)"))
    return df.drop("top")


def search(index: DataFrame, queries: DataFrame, k: int = 10, segment: int | None = None) -> DataFrame:
    """(query_id, neighbour_id, distance, rank). Both inputs: id, vector; their vectors have BITS components. segment: bits of a segment."""
    spark = index.sparkSession
    scratch = Scratch(spark, "topk")
    coded = lambda df: df.select("id", code(F.col("vector")).alias("code")).where("id IS NOT NULL AND code IS NOT NULL").groupBy("id").agg(F.min("code").alias("code"))
    rank = F.row_number().over(W.partitionBy("code").orderBy("id"))
    own = coded(index).withColumn("r", rank).where(F.col("r") <= k + 1).groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    own = scratch.save(own, "codes")
    size = own.count()
    w = segment or width(size)
    m = BITS // w
    keyed = own.select("code", F.size("ids").alias("n"), F.col("ids")[0].alias("least"), F.posexplode(_segments(F.col("code"), w)).alias("j", "value"))
    keyed = scratch.save(keyed, "index")
    asked = scratch.save(coded(queries), "queries")
    if not size:
        return asked.select(F.col("id").alias("query_id"), F.col("id").alias("neighbour_id"), F.lit(0).alias("distance"), F.lit(0).alias("rank")).limit(0)
    open_ = scratch.save(asked.select(F.col("code").alias("q")).distinct().withColumn("worst", F.lit(BITS)), "open-0")
    best, state = None, []
    order = W.partitionBy("q").orderBy("d", "least")
    for s in count(1):
        covered = m * s + m - 1
        if comb(w, s) > size:
            covered, blocks = BITS, -(-open_.count() // BLOCK)
            block = F.pmod(F.xxhash64("q"), F.lit(blocks))
            met = [keyed.where("j = 0").crossJoin(F.broadcast(open_.where(block == i))) for i in range(blocks)]
            found = reduce(DataFrame.unionByName, met)
        else:
            probe = _masks(open_.select("q", "worst", F.posexplode(_segments(F.col("q"), w)).alias("j", "own")), w, s)
            found = probe.select("q", "worst", "j", F.col("own").bitwiseXOR(F.col("mask")).alias("value")).join(keyed.hint("merge"), ["j", "value"])  # Spark takes the exploded side for small and would broadcast it
        found = found.withColumn("d", F.bit_count(F.col("q").bitwiseXOR(F.col("code")))).where("d <= worst")
        found = found.select("q", "code", "n", "least", "d")
        if best is not None:
            found = found.unionByName(best.join(open_.select("q"), "q", "left_semi"))
        found = found.withColumn("r", F.dense_rank().over(order)).where(F.col("r") <= k + 1).drop("r").distinct()  # a code found in several segments has one rank
        best = scratch.save(found, f"best-{s}")
        sums = best.groupBy("q").agg(F.sum(F.when(F.col("d") <= covered, F.col("n"))).alias("sure"), F.count("*").alias("codes"), F.max("d").alias("far"))
        sums = open_.select("q").join(sums, "q", "left").withColumn("done", (F.coalesce("sure", F.lit(0)) > k) | F.lit(covered >= BITS))
        sums = scratch.save(sums.select("q", "done", F.when(F.col("codes") > k, F.col("far")).otherwise(BITS).alias("worst")), f"sums-{s}")
        state.append(best.join(sums.where("done"), "q", "left_semi"))
        if sums.where("NOT done").isEmpty():
            break
        open_ = sums.where("NOT done").select("q", "worst")
    done = reduce(DataFrame.unionByName, state)
    pairs = done.join(own, "code").select("q", "d", F.explode("ids").alias("neighbour_id"))
    nearest = W.partitionBy("q").orderBy("d", "neighbour_id")
    pairs = pairs.withColumn("r", F.row_number().over(nearest)).where(F.col("r") <= k + 1).drop("r")
    out = asked.select(F.col("id").alias("query_id"), F.col("code").alias("q")).join(pairs, "q").where("query_id <> neighbour_id")
    final = F.row_number().over(W.partitionBy("query_id").orderBy("d", "neighbour_id"))
    return out.withColumn("rank", final).where(F.col("rank") <= k).select("query_id", "neighbour_id", F.col("d").alias("distance"), "rank")
