"""A training-data pipeline over documents: five stages, each written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipweave.llm import decontaminate, mixing, quality, secrets, simhash
from clipweave.llm.common import Scratch, remainder_is, table, unused

NARROW = 500_000


def _counted(new: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, n_chars as long as the text is now."""
    return new.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranking rejects are gone."""
    held = remainder_is(F.col("doc_id"), 4, 2)
    model = quality.fit(docs.where(~held), table(spark, sf_dir, "labels").where(~held))
    return quality.score(docs, model).where("predicted = 1").select(*docs.columns)


def one_of_a_kind(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays: of those with the least id, or without ids, one of the least digest of its text."""
    # tells texts apart where ids repeat or are null; rows with equal keys are copies of one text
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.unhex(F.sha2("text", 256)).alias("digest"))
    name, mark = unused(docs, "key"), unused(docs, "gone")
    rows, scratch = docs.withColumn(name, key), Scratch(spark, "near")
    found = simhash.classes(rows, scratch, doc_id=name).groupBy("doc_id", "component_id").agg(F.count("*").alias("n"))
    found = scratch.save(found.select(F.col("doc_id").alias(name), (F.col("doc_id") != F.col("component_id")).alias(mark), "n"), "keys")
    # Rows that go, and keys that repeat: up to NARROW of them are broadcast, so that the other texts need not move.
    odd = found.where(F.col(mark) | (F.col("n") > 1)).select(name, mark)
    if odd.count() <= NARROW:
        odd = F.broadcast(odd)
    rows = rows.join(odd, name, "left")
    return rows.where(F.col(mark).isNull()).unionByName(rows.where(~F.col(mark)).dropDuplicates([name])).select(*docs.columns)


def no_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents are gone; lesser hits are cut out."""
    return _counted(decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), Scratch(spark, "clean")), docs)


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    return _counted(secrets.redacted(docs, secrets.Ledger(spark, Scratch(spark, "secrets").path)), docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for every copy of a document that the mix takes, with its shard."""
    return mixing.mix(docs, Scratch(spark, "mix"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("near_copies", one_of_a_kind),
    ("decontamination", no_benchmarks),
    ("secrets", no_secrets),
    ("mixing", mixed),
]
#: The first stage is a trained model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"{k}-{name}")
    return docs
