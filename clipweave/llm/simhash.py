"""SimHash near-duplicates through tables of distances to reference fingerprints.

The reference fingerprints (pivots) are zero and 32 masks of two neighbouring bits. A
fingerprint's Hamming distances to them are its coordinates; those of two fingerprints
differ by at most their distance. The half difference of a mask's coordinate and
zero's counts the ones under the mask; the masks are disjoint, so the counts of two
fingerprints differ by at most their distance in sum. Cut into five groups of masks,
at most two groups differ between fingerprints at distance 2: some three of the five
agree. Each of the ten ways to choose three is a key, made of pivot distances only.

Fingerprints that share a key are candidates; pairs whose largest coordinate
difference exceeds the limit go, survivors are verified. Distinct fingerprints are
compared, whatever their number of copies.

A key that more than BLOCK[0] fingerprints share is divided by a second pivot table: its
pivots are masks that pair the bits otherwise, with keys made in the same way, and pairs
within the limit agree on one of those too. A key that more than BLOCK[1] still share
fixes most counts of both, and its fingerprints crowd around each other. Pivots are then taken around the data: every fingerprint at distance 0 or 1 from
one of them is a pivot, and two of them are within 2 if and only if both are within 1
of the same pivot: 65 rows each, linked through a minimum. So no step emits the pairs of
a large group, whatever its size, and none drops any.

Nulls: a null or wordless text has fingerprint zero and links like any other. A null
id takes part; it is never a component's id unless the component has no other.
Repeated rows each get a row. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch
from .components import components

SHINGLE, SEED, LIMIT, BLOCK = 3, 42, 2, (64, 16)
MASKS = [3 << 2 * j for j in range(32)]
#: Pairings of the bits, one a table.
TABLES = [MASKS, [(1 | 1 << 32) << j for j in range(32)]]
GROUPS = [range(0, 7), range(7, 14), range(14, 20), range(20, 26), range(26, 32)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """Majority bits of the XXH64 of all shingles, as an unsigned integer."""
    ws = text.lower().split()  # of bytes: A-Z, and the six ASCII blanks
    if not ws:
        return 0
    shingles = map(b" ".join, zip(*[ws[i:] for i in range(size)])) if len(ws) > size else [b" ".join(ws)]
    n = max(len(ws) - size + 1, 1)
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for a in range(0, n, 65536):  # bounds what long texts unpack
        ones += np.unpackbits(h[a : a + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp), fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [signed(fingerprint(t or b"")) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def _coordinates(fp: Column, masks: list[int] = MASKS) -> Column:
    return F.array(F.bit_count(fp), *[F.bit_count(fp.bitwiseXOR(F.lit(signed(m)))) for m in masks])


def _keyed(rows: DataFrame, masks: list[int]) -> DataFrame:
    """(fp, key), ten rows for one of (fp, key): the key goes on with a choice of three groups and their counts under the masks. Keys are hashes; a clash only adds candidates."""
    pivots = _coordinates(F.col("fp"), masks)
    rows = rows.select("fp", "key", pivots.alias("p")).select("fp", "key", F.expr("transform(slice(p, 2, 32), x -> (p[0] + 2 - x) div 2)").alias("ones"))
    ways = [F.xxhash64("key", F.lit(way), F.concat(*[F.slice("ones", g[0] + 1, len(g)) for g in chosen])) for way, chosen in enumerate(combinations(GROUPS, len(GROUPS) - LIMIT))]
    return rows.select("fp", F.explode(F.array(*ways)).alias("key"))


def _verified(member: DataFrame) -> DataFrame:
    """(a, b): the pairs within the limit among fingerprints that share a key."""
    lists = member.groupBy("key").agg(F.array_sort(F.collect_list("fp")).alias("fps"))
    lists = lists.withColumn("items", F.transform("fps", lambda x: F.struct(x.alias("fp"), _coordinates(x).alias("pivots"))))
    pairs = F.expr(f"""
        flatten(transform(items, (x, i) -> transform(
            filter(slice(items, i + 2, size(items)), y ->
                abs(x.pivots[0] - y.pivots[0]) <= {LIMIT}
                AND NOT exists(zip_with(x.pivots, y.pivots, (p, q) -> abs(p - q)), d -> d > {LIMIT})
                AND bit_count(x.fp ^ y.fp) <= {LIMIT}),
            y -> struct(x.fp AS a, y.fp AS b))))""")
    return lists.select(F.explode(pairs).alias("p")).select("p.a", "p.b").distinct()


def links(spark: SparkSession, fps: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): edges that connect just what the pairs at distance up to LIMIT connect. fps: distinct, column fp. b may be a neighbour, no fingerprint itself."""
    rows, out = fps.select("fp", F.lit(0).cast("long").alias("key")), []
    for level, masks in enumerate(TABLES):
        keyed = scratch.save(_keyed(rows, masks), f"keyed-{level}")
        shared = scratch.save(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), f"shared-{level}")
        out.append(_verified(keyed.join(shared.where(F.col("n") <= BLOCK[level]), "key")))
        rows = keyed.join(shared.where(F.col("n") > BLOCK[level]), "key", "left_semi")
        if shared.where(F.col("n") > BLOCK[level]).isEmpty():
            break
    else:
        crowd = rows.select("fp").distinct()
        near = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(signed(1 << i))) for i in range(64)])
        around = scratch.save(crowd.select("fp", F.explode(near).alias("near")), "around")
        first = scratch.save(around.groupBy("near").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1"), "pivots")
        out.append(around.join(first, "near").where(F.col("fp") != F.col("b")).select(F.col("fp").alias("a"), "b").distinct())
    found = scratch.save(reduce(DataFrame.unionByName, out), "links")
    for name in ("around", "pivots", *[f"{kind}-{k}" for kind in ("keyed", "shared") for k in range(len(TABLES))]):
        scratch.drop(name)
    return found


def classes(docs: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs; component_id is the least id reachable."""
    spark = docs.sparkSession
    rows = scratch.save(fingerprints(docs, doc_id, text), "fingerprints")
    distinct = scratch.save(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = components(spark, links(spark, distinct.select("fp"), scratch), scratch)
    member = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    member = scratch.save(member, "members")
    ids = member.groupBy("root").agg(F.min("least").alias("component_id"))
    named = scratch.save(member.join(ids, "root").select("fp", "component_id"), "named")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
