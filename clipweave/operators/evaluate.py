"""Reports on predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def classification_report(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(name, precision, recall, f1, support): a row a class, accuracy, macro and weighted averages; division by zero gives 0."""
    cells = rows.groupBy(F.col(actual).cast("string").alias("a"), F.col(predicted).cast("string").alias("p")).agg(F.count("*").alias("n"))
    sides = cells.select(F.explode(F.array(F.struct(F.col("a").alias("c"), F.col("n").alias("s"), F.lit(0).cast("long").alias("g"), F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0).alias("h")), F.struct(F.col("p").alias("c"), F.lit(0).cast("long").alias("s"), F.col("n").alias("g"), F.lit(0).cast("long").alias("h")))).alias("x")).select("x.*")
    per = sides.groupBy("c").agg(F.sum("s").alias("support"), F.sum("g").alias("given"), F.sum("h").alias("hit"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    per = per.withColumn("precision", ratio(F.col("hit"), F.col("given"))).withColumn("recall", ratio(F.col("hit"), F.col("support")))
    per = per.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    cols = ("precision", "recall", "f1")
    total = F.sum("support")
    classes = per.select(F.col("c").alias("name"), *cols, "support")
    accuracy = F.sum("hit") / F.nullif(total, F.lit(0))
    summary = per.agg(
        F.struct(F.lit("accuracy").alias("name"), *[accuracy.alias(c) for c in cols], total.alias("support")).alias("x"),
        F.struct(F.lit("macro avg").alias("name"), *[F.avg(c).alias(c) for c in cols], total.alias("support")).alias("y"),
        F.struct(F.lit("weighted avg").alias("name"), *[(F.sum(F.col(c) * F.col("support")) / F.nullif(total, F.lit(0))).alias(c) for c in cols], total.alias("support")).alias("z"),
    ).select(F.explode(F.array("x", "y", "z")).alias("r")).select("r.*")
    return classes.unionByName(summary)


def duplicate_ids(rows: DataFrame, group: str, ident: str) -> DataFrame:
    """The groups in which an id stands twice."""
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.count_distinct(ident).alias("k")).where("n <> k").select(group)
