"""Benchmark decontamination, with DataFrame functions only.

A word is a run of digits, letters a-z (after lower-casing A-Z) and characters
from U+0080 on. A window is 13 consecutive words of an item; an item of fewer
words, but not none, is one window.

1. Every occurrence of a window of n words holds a seed of k = min(n, 5) words
   that starts at a multiple of n - k + 1. So only those positions of a text are
   hashed, for the lengths n that the benchmark has, and looked up in the hash set
   of all seeds: a join on the hash, for a benchmark of any size. The set is
   broadcast up to BROADCAST entries, and dealt out by hash beyond.
2. Where a seed is hit, and there only, the windows around it are compared with
   the benchmark's, word for word. Texts that are equal (by SHA-256) are compared
   once. Which items have a window is joined to the windows that were found.

A text of any length is one row with 8 bytes for each position that is hashed; the
windows and hit positions of a text take about 100 bytes for each of its hit words.

Nulls: a null text has no words; an item with a null id marks words as hit but
is neither counted nor listed. Repeated rows each get a row. Empty benchmark:
nothing is hit. Columns of the documents other than the two named are carried
along unchanged, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower

#: Runs of what is no word, after lower-casing.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before lower-casing: a separator run, then a word.
PIECE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TAIL = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*$"
WINDOW, SEED, BROADCAST = 13, 5, 2_000_000


def words(lowered: Column) -> Column:
    """Splitting at the gaps is several times as fast as extracting words; a gap at an end leaves an empty string there."""
    parts = F.split(F.coalesce(lowered, F.lit("")), GAP)
    lead = (F.get(parts, F.lit(0)) == "").cast("int")
    trail = ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")
    return F.slice(parts, lead + 1, F.size(parts) - lead - trail)


def _folded(text: Column) -> Column:
    """Lower case of all letters. Lower-casing a final sigma depends on what follows the word, so both forms are made one."""
    return F.replace(F.lower(text), F.lit("ς"), F.lit("σ"))


def _items(benchmark: DataFrame, item: str, text: str, folded: bool = False) -> DataFrame:
    """(item, ws, n): the words of items that have any, and the length of their windows."""
    lowered = _folded(F.col(text)) if folded else ascii_lower(F.col(text))
    ws = benchmark.select(F.col(item).cast("string").alias("item"), words(lowered).alias("ws")).where(F.size("ws") > 0)
    return ws.withColumn("n", F.least(F.size("ws"), F.lit(WINDOW)))


def _windows(items: DataFrame) -> DataFrame:
    """(w, n, item): each window's words with blanks between, its length, its item; repeats are possible."""
    starts = F.sequence(F.lit(1), F.size("ws") - F.col("n") + 1)
    return items.select("item", "n", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("ws", i, F.col("n")), " "))).alias("w"))


def _seed(ws: Column, at: Column, n: Column | int, k: Column | int) -> Column:
    """The hash of the k words from at (from 0), for windows of n words."""
    return F.xxhash64(n if isinstance(n, Column) else F.lit(n), F.slice(ws, at + 1, k))


def _seeds(items: DataFrame) -> DataFrame:
    """(h): the hash set, of all runs of min(n, SEED) words of the items, whose words are folded."""
    ws = items.withColumn("k", F.least("n", F.lit(SEED)))
    runs = F.transform(F.sequence(F.lit(0), F.size("ws") - F.col("k")), lambda i: _seed(F.col("ws"), i, F.col("n"), F.col("k")))
    return ws.select(F.explode(runs).alias("h")).distinct()


def _step(n: int) -> int:
    return n - min(n, SEED) + 1


def _tested(ws: Column, n: int) -> Column:
    """The hashes of the positions that are looked up for windows of n words."""
    at = F.expr(f"CASE WHEN size(ws) >= {n} THEN sequence(0, size(ws) - {min(n, SEED)}, {_step(n)}) ELSE cast(array() AS array<int>) END")
    return F.transform(at, lambda i: _seed(ws, i, n, min(n, SEED)))


def _around(n: int) -> Column:
    """Of column ws, the windows of n words that hold a seed of column spots: place, length, words."""
    own = F.filter("spots", lambda s: s["n"] == n)
    starts = F.transform(own, lambda s: F.sequence(F.greatest(s["at"] - (_step(n) - 1), F.lit(0)), F.least(s["at"], F.size("ws") - n)))
    return F.transform(F.array_distinct(F.flatten(starts)), lambda i: F.struct(i.alias("at"), F.lit(n).alias("n"), F.array_join(F.slice("ws", i + 1, n), " ").alias("w")))


def _small(df: DataFrame, rows: int) -> DataFrame:
    """To be broadcast if there are at most so many rows; else Spark decides by the table's size."""
    return F.broadcast(df) if df.count() <= rows else df


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def find(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, text: str = "text", item: str = "item_id", item_text: str = "text", keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(tested, found). tested: row (a struct of the columns in keep), digest and n_words of every document. found: digest, total (its words), hits, items of every different text with a hit."""
    spark = docs.sparkSession
    items = _items(benchmark, item, item_text)
    lengths = sorted(r.n for r in items.select("n").distinct().collect())  # WINDOW at most
    # Lower-casing of all letters only joins words that A-Z lower-casing keeps apart, and is faster.
    row = F.struct(*[docs[c] for c in keep]) if keep else F.struct(F.lit(0).alias("none"))
    base = docs.select(row.alias("row"), docs[text].alias("text")).withColumn("ws", words(_folded(F.col("text"))))
    base = base.select("row", _digest(F.col("text")).alias("digest"), F.size("ws").cast("long").alias("n_words"), *[_tested(F.col("ws"), n).alias(f"h{n}") for n in lengths])
    base = scratch.save(base, "tested")  # so that texts are split once
    tested = base.select("row", "digest", "n_words")
    if not lengths:
        return tested, spark.createDataFrame([], "digest binary, total long, hits array<int>, items array<string>")

    seeds = scratch.save(_seeds(_items(benchmark, item, item_text, folded=True)), "seeds")
    spots = reduce(DataFrame.unionByName, [base.select("digest", F.lit(n).alias("n"), F.posexplode(f"h{n}").alias("j", "h")).withColumn("at", F.col("j") * _step(n)) for n in lengths])
    spots = spots.join(_small(seeds, BROADCAST), "h", "left_semi").groupBy("digest").agg(F.collect_set(F.struct("n", "at")).alias("spots"))
    spots = scratch.save(spots, "spots")
    # Copies of a text meet before it is dealt out.
    texts = docs.select(_digest(docs[text]).alias("digest"), docs[text].alias("text")).join(_small(spots.select("digest"), BROADCAST // 4), "digest", "left_semi").groupBy("digest").agg(F.first("text").alias("text"))
    each = texts.join(spots, "digest").select("digest", "spots", words(ascii_lower(F.col("text"))).alias("ws"))
    each = each.select("digest", F.size("ws").cast("long").alias("total"), F.explode(F.flatten(F.array(*[_around(n) for n in lengths]))).alias("s")).select("digest", "total", "s.*")
    each = scratch.save(each, "each")  # few; Spark knows the size, so the benchmark's windows need not move
    windows = scratch.save(_windows(items).join(each.select("w", "n").distinct(), ["w", "n"]).distinct(), "windows")
    met = each.join(windows.select("w", "n").distinct(), ["w", "n"], "left_semi")
    hits = met.groupBy("digest", "total").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.sequence("at", F.col("at") + F.col("n") - 1))))).alias("hits"))
    named = met.select("digest", "w", "n").distinct().join(windows.where("item IS NOT NULL"), ["w", "n"]).groupBy("digest").agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = hits.join(named, "digest", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return tested, scratch.save(found, "found")


def scan(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, text: str = "text", item: str = "item_id", item_text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The documents (their columns in keep, or all) with n_words, hits (positions of hit words, from 0, ascending) and items (sorted ids as strings).

    Columns of docs with these three names are replaced.
    """
    base = docs.drop("n_words", "hits", "items")
    tested, found = find(base, benchmark, scratch, text, item, item_text, base.columns if keep is None else keep)
    out = tested.join(found.drop("total"), "digest", "left")
    none = F.array().cast("array<int>"), F.array().cast("array<string>")
    return out.select("row.*", "n_words", F.coalesce("hits", none[0]).alias("hits"), F.coalesce("items", none[1]).alias("items"))


def contaminated() -> Column:
    """Whether at least a twentieth of the words are hit."""
    n = F.size("hits")
    return (n > 0) & (20 * n >= F.col("n_words"))


def without_hits(text: Column) -> Column:
    """The text without its hit words and the separators before them."""
    pieces = F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))
    kept = F.filter(pieces, lambda _, i: ~F.array_contains("hits", i))
    return F.concat(F.array_join(kept, ""), F.regexp_extract(text, TAIL, 0))


def clean(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, text: str = "text") -> DataFrame:
    """The documents' own columns: contaminated ones are gone, lesser hits are cut out of their texts."""
    found = find(docs, benchmark, scratch, text)[1].select("digest", F.col("total").alias("n_words"), "hits")
    own, digest = F.struct(*[docs[c] for c in docs.columns]).alias("row"), _digest(docs[text]).alias("digest")
    base = docs.select(own, digest)
    if found.count() <= BROADCAST // 4:  # then texts without a hit need not move
        keys = F.broadcast(found.select("digest"))
        dirty = base.join(keys, "digest", "left_semi").join(found, "digest")
        out = base.join(keys, "digest", "left_anti").select("row", F.lit(None).cast("long").alias("n_words"), F.lit(None).cast("array<int>").alias("hits")).unionByName(dirty.select("row", "n_words", "hits"))
    else:
        out = base.join(found, "digest", "left")
    new = F.when(F.size("hits") > 0, without_hits(F.col(f"row.`{text}`"))).otherwise(F.col(f"row.`{text}`"))
    out = out.where(F.col("hits").isNull() | ~contaminated())
    return out.select(*[new.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
