"""Connected components by alternating large-star and small-star rounds, until only stars are left.

Edges point from the larger node to the smaller. A round takes each node's least smaller
neighbour (combined before the shuffle), writes that table of a row a node, and joins
it: once by the smaller end (large star), once by the larger (small star). The least
node of a star has no smaller neighbour and thus no row to join. As both sides of a join
are read from storage, Spark splits the edges of a hub over tasks where they are many
(its handling of skewed joins), and broadcasts the other side only where that is small.
No list of neighbours is ever gathered. Rounds are written to shared storage, and the
tables of the round before are dropped.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of an edge; root is the least node reachable.

    edges has columns a and b of one orderable type, in any direction, repeats
    and loops allowed. Nodes without an edge are absent from the result.
    """
    a, b = F.col("a"), F.col("b")

    def least(of: DataFrame, name: str) -> DataFrame:
        return scratch.save(of.groupBy(a.alias("node")).agg(F.min("b").alias("m")), name)

    now = edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    now = scratch.save(now, "edges-0")
    for k in count(1):
        m = least(now, f"least-{k}a")
        # Stars: every node has one smaller neighbour, and that one has none. A round lowers some neighbour of what is no star, so there is a last one.
        if m.count() == now.count() and now.join(m, b == F.col("node"), "left_semi").isEmpty():
            scratch.drop(f"least-{k}a")
            break
        large = now.join(m, b == F.col("node"), "left").select("a", F.coalesce("m", "b").alias("b")).distinct()
        large = scratch.save(large, f"large-{k}")
        m = least(large, f"least-{k}b")
        small = large.join(m, a == F.col("node")).select(b.alias("a"), F.col("m").alias("b")).where(a != b)
        small = small.unionByName(m.select(F.col("node").alias("a"), F.col("m").alias("b"))).distinct()
        now = scratch.save(small, f"edges-{k}")
        for old in (f"edges-{k - 1}", f"least-{k}a", f"least-{k}b", f"large-{k}"):
            scratch.drop(old)
    roots = now.select(b.alias("node")).distinct()
    return now.select(a.alias("node"), b.alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
