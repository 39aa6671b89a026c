"""Rows that once were lost."""

from pyspark.sql import functions as F

import corpus_pipeline
from clipweave.llm import langid

DATA = "/root/testdata/sf0.001"


def test_one_row_of_each_group_of_near_copies(spark):
    base = "one two three four five six seven eight nine ten"
    other, third = "a lonely text that is like no other text here at all", "yet another text which nothing else resembles in any way"
    rows = [(1, base), (1, other), (2, base), (None, base), (None, third), (None, third), (5, ""), (None, None), (None, " \n"), (4, "x y z"), (4, "x y z")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.one_of_a_kind(spark, docs, DATA)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(1, base), (1, other), (None, third), (5, ""), (4, "x y z")], key=str)
    nameless = docs.where("doc_id IS NULL")  # ids all null: differing texts without words are one group
    assert sorted(r.text or "" for r in corpus_pipeline.one_of_a_kind(spark, nameless, DATA).collect())[1:] == sorted([base, third])


def test_no_language_is_lost_however_many_rows_it_has(spark):
    many = spark.range(1_200_000).select(F.col("id").alias("doc_id"), F.lit("der hund und die katze").alias("text"), F.lit("de").alias("lang"))
    few = spark.createDataFrame([(7, "the cat and the dog", "en")], many.schema)
    assert langid.fit(many.unionByName(few), max_rows=1).langs == ["de", "en"]


def test_a_language_of_one_row_is_counted_whatever_its_hash(spark):
    many = [(k, f"the cat and the dog {k}", "en") for k in range(40)]
    for k in range(100, 120):
        docs = spark.createDataFrame([*many, (k, "der hund und die katze", "de")], "doc_id long, text string, lang string")
        assert langid.fit(docs).langs == ["de", "en"]


def test_repeated_ids_crowd_no_language_out(spark):
    rows = [(1, "der hund und die katze", "de")] * 3000 + [(k, f"the cat and the dog {k}", "en") for k in range(2, 6)]
    assert langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_rows=5).langs == ["de", "en"]
