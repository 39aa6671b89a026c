"""Passages that repeat across documents, by MinHash banding of paragraphs.

Paragraphs are of two kinds, both of MIN_WORDS words or more: whole lines, and, as
passages are also set into longer lines, windows. These start at a sentence and end with
the first sentence that makes them long enough; others, of MIN_WORDS words each, are
chosen by winnowing, so that any RUN words that two documents share hold one, wherever
their sentences end. Windows are compared for equality. Lines get a MinHash signature over their 5-word shingles, in BANDS bands of ROWS values,
which finds a pair of Jaccard similarity 0.8 with probability 0.997; lines that share a
band are candidates, and the Jaccard similarity of their shingle sets decides.

Equal paragraphs count once in all comparisons. The different lines of a band's bucket
are compared inside its row if there are up to BUCKET; larger buckets are cut into
chunks of about CHUNK lines, and a task compares two chunks in one matrix product and
returns no pairs but a forest that connects what they connect. All pairs of a bucket
are compared, and none is written out.

Similar lines form components. A paragraph belongs to the document with the least id
that has it or a line of its component; the other documents' copies are marked for
removal. Components of documents follow from shared paragraphs.

Paragraphs are equal if two independent hashes of their words are, of 64 and of 32 bits:
the first deals them out, the second is compared where it says equal. Shingles are
compared by 32 bits of their hashes.

Nulls: a null text has no paragraphs; rows with a null id are returned but not
compared. Ids may be of any type that has an order. Repeated rows each get a row; a
passage that only repeats inside one id is no repeat; of equal ids none is first. An
empty table gives an empty result. Only the two named columns are read. Texts are read
whole, in blocks of about BLOCK words or one text; a text takes about 100 bytes a word.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .components import components

MIN_WORDS, RUN, SHINGLE, SIMILAR, BANDS, ROWS, BUCKET, CHUNK, BLOCK, BROADCAST, COLUMNS = 25, 50, 5, (4, 5), 8, 3, 8, 512, 1_000_000, 500_000, 8192
SENTENCE = re.compile(r"((?<=[.!?])\s+|\n)")
U = np.uint64
_B = U(0x9E3779B97F4A7C15)
_C = U(0xD6E8FEB86659FD93)
_A = np.random.default_rng(11).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * U(2) + U(1)
PARAGRAPHS = "at int, n int, content long, proof int, bands array<long>, shingles array<int>"


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(31))
    h = h * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(29))


class Tokens:
    """The words of several texts, their sentences and lines, and hashes of any run of words."""

    def __init__(self, texts: list[str]):
        known: dict[str, int] = defaultdict()
        known.default_factory = known.__len__
        words, sentences, lines, self.docs = [], [0], [0], [0]
        at = 0
        for t in texts:
            parts = SENTENCE.split(t.lower())
            for k in range(0, len(parts), 2):
                ws = parts[k].split()
                words += map(known.__getitem__, ws)
                at += len(ws)
                if ws:
                    sentences.append(at)
                if k + 1 < len(parts) and "\n" in parts[k + 1] and at > lines[-1]:
                    lines.append(at)
            if at > lines[-1]:
                lines.append(at)
            self.docs.append(at)
        self.sentences, self.lines, self.docs = np.array(sentences), np.array(lines), np.array(self.docs)
        words = np.array(words, np.int64)
        self.first, self.second = self._sums(words, known, 0, _B), self._sums(words, known, 1, _C)
        self.sums = self.first[0]

    @staticmethod
    def _sums(words: np.ndarray, known: dict[str, int], seed: int, base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        """Running sums of the words' hashes times powers of the base, and the inverse powers."""
        w = np.fromiter((xxhash.xxh64_intdigest(x, seed) for x in known), U, len(known))[words] if len(words) else np.zeros(0, U)
        power = np.cumprod(np.concatenate([[U(1)], np.full(len(w), base)]), dtype=U)
        undo = np.cumprod(np.concatenate([[U(1)], np.full(len(w), U(pow(int(base), -1, 1 << 64)))]), dtype=U)
        return np.concatenate([[U(0)], np.cumsum(w * power[:-1], dtype=U)]), undo

    def hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        sums, undo = self.first
        return _mix((sums[b] - sums[a]) * undo[a] + (b - a).astype(U))

    def proof(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """32 bits of another hash."""
        sums, undo = self.second
        return (_mix((sums[b] - sums[a]) * undo[a] + (b - a).astype(U)) >> U(32)).astype(np.uint32).view(np.int32)


def _winnowed(t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Windows (from, to): of any RUN - MIN_WORDS + 1 starts in a row, the one with the least hash. One word repeated makes one window, of RUN words."""
    n = len(t.sums) - MIN_WORDS
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a = np.arange(n)
    h = t.hash(a, a + MIN_WORDS)
    within = np.ones(n, bool)
    for end in t.docs[1:-1]:
        within[max(end - MIN_WORDS + 1, 0) : end] = False  # these reach into the next text
    again = np.concatenate([[False], h[1:] == h[:-1]])
    alike = np.concatenate([[0], np.cumsum(again & within)])
    first = np.nonzero(~again & within)[0]
    first = first[alike[np.minimum(first + RUN - MIN_WORDS + 1, n)] - alike[first] == RUN - MIN_WORDS]
    none, low = U(np.iinfo(U).max), U((1 << n.bit_length()) - 1)
    single = ~again & ~np.append(again[1:], False)
    key = np.where(within & single, (h & ~low) | a.astype(U), none)  # the place breaks ties
    width = RUN - MIN_WORDS + 1
    least, size = np.append(key, np.full(width - 1, none)), 1
    while 2 * size <= width:
        least, size = np.minimum(least[:-size], least[size:]), 2 * size
    if size < width:
        least = np.minimum(least[: size - width], least[width - size :])
    a = np.unique(least[least != none] & low).astype(np.int64)
    return np.concatenate([a, first]), np.concatenate([a + MIN_WORDS, first + RUN])


def _paragraphs(ids: pa.Array, texts: list[str]) -> Iterator[pa.RecordBatch]:
    t = Tokens(texts)
    kinds = [ids.type, pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32())]
    names = ["doc_id", *(x.split()[0] for x in PARAGRAPHS.split(", "))]

    def batch(a, b, content, bands, shingles):
        doc = np.searchsorted(t.docs, a, side="right") - 1
        return pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), pa.array((a - t.docs[doc]).astype(np.int32)), pa.array((b - a).astype(np.int32)), pa.array(content.view(np.int64)), pa.array(t.proof(a, b)), bands, shingles], schema=pa.schema(list(zip(names, kinds))))

    a = t.sentences[:-1]
    to = np.searchsorted(t.sentences, a + MIN_WORDS)
    own = np.searchsorted(t.docs, a, side="right")
    ok = to < len(t.sentences)
    a, b, own = a[ok], t.sentences[to[ok]], own[ok]
    ok = b <= t.docs[own]
    a, b = a[ok], b[ok]
    more = _winnowed(t)
    a, b = np.concatenate([a, more[0]]), np.concatenate([b, more[1]])
    if len(a):
        yield batch(a, b, t.hash(a, b), pa.nulls(len(a), kinds[5]), pa.nulls(len(a), kinds[6]))
    a, b = t.lines[:-1], t.lines[1:]
    ok = b - a >= MIN_WORDS
    a, b = a[ok], b[ok]
    if len(a):
        size = b - a - SHINGLE + 1
        start = np.cumsum(size) - size
        first = np.repeat(a - start, size) + np.arange(size.sum())
        s = t.hash(first, first + SHINGLE)
        bands = []
        for k in range(BANDS):
            h = np.zeros(len(a), U)
            for r in range(ROWS):
                h = _mix(h + np.minimum.reduceat(_mix(s * _A[k * ROWS + r]), start))
            bands.append(h)
        bands = np.stack(bands, axis=1).ravel()
        line = np.repeat(np.arange(len(a)), size).astype(U)
        sets = np.sort(line << U(32) | (s >> U(32)))
        sets = sets[np.append(True, sets[1:] != sets[:-1])]
        ends = np.searchsorted(sets >> U(32), np.arange(len(a) + 1, dtype=U))
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array((sets & U(0xFFFFFFFF)).astype(np.uint32).view(np.int32)))
        yield batch(a, b, t.hash(a, b), pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * BANDS), pa.array(bands.view(np.int64))), lists)


def paragraphs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All paragraphs: at and n in words of the text; windows have no bands and shingles. Shingles are kept as 32 bits of their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            begin = size = 0
            for i, t in enumerate(texts):
                size += len(t) // 6
                if size >= BLOCK or i == len(texts) - 1:
                    yield from _paragraphs(ids.slice(begin, i + 1 - begin), texts[begin : i + 1])
                    begin, size = i + 1, 0

    rows = docs.where(docs[doc_id].isNotNull() & docs[text].isNotNull())
    return rows.select(rows[doc_id].alias("doc_id"), rows[text].alias("text")).mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, {PARAGRAPHS}")


def _similar(a: str, b: str) -> str:
    """SQL: Jaccard similarity of at least 4 / 5; sizes alone decide most."""
    p, q = SIMILAR
    return f"({q} * least(size({a}), size({b})) >= {p} * greatest(size({a}), size({b})) AND {q} * size(array_intersect({a}, {b})) >= {p} * size(array_union({a}, {b})))"


def _forest(rows: pd.DataFrame) -> pd.DataFrame:
    """Of lines that share a bucket: each with the first that it is connected to."""
    content, sets = rows["content"].to_numpy(), rows["shingles"].tolist()
    size = np.array([len(x) for x in sets])
    words, word = np.unique(np.concatenate(sets), return_inverse=True)
    line = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(word, kind="stable")
    word, line = word[order], line[order]
    both = np.zeros((len(sets), len(sets)), np.float32)  # exact: counts are below 2^24
    for k in range(0, len(words), COLUMNS):  # so many shingles at once bound the matrix
        a, b = np.searchsorted(word, [k, k + COLUMNS])
        x = np.zeros((len(sets), min(COLUMNS, len(words) - k)), np.float32)
        x[line[a:b], word[a:b] - k] = 1
        both += x @ x.T
    linked = SIMILAR[1] * both >= SIMILAR[0] * (size[:, None] + size[None] - both)
    label, before = np.arange(len(sets)), None
    while before is None or (label != before).any():
        before = label
        label = np.where(linked, label[None], len(sets)).min(axis=1)
        label = label[label]
    on = label != np.arange(len(sets))
    return pd.DataFrame({"a": content[on], "b": content[label[on]]})


def similar_lines(lines: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): edges that connect just what the verified pairs connect. lines: distinct content, with bands; sets: content and shingles, repeats allowed."""
    keys = lines.select("content", F.posexplode("bands").alias("band", "key"))
    shared = keys.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    member = scratch.save(keys.join(shared, ["band", "key"]), "members")
    asked = scratch.save(member.select("content").distinct(), "asked")  # shingle sets are large: only these move
    near = F.broadcast(asked) if asked.count() <= BROADCAST else asked
    sets = sets.join(near, "content", "left_semi").groupBy("content").agg(F.first("shingles").alias("shingles"))
    member = member.join(sets, "content")
    few = member.where(F.col("n") <= BUCKET).groupBy("band", "key").agg(F.collect_list(F.struct("content", "shingles")).alias("c"))
    pairs = F.expr(f"""flatten(transform(c, (x, i) -> transform(
        filter(slice(c, i + 2, size(c)), y -> {_similar("x.shingles", "y.shingles")}),
        y -> struct(x.content AS a, y.content AS b))))""")
    few = few.select(F.explode(pairs).alias("p")).select("p.a", "p.b")
    many = member.where(F.col("n") > BUCKET).withColumn("chunks", F.expr(f"(n + {CHUNK - 1}) div {CHUNK}"))
    many = many.withColumn("own", F.pmod(F.xxhash64("content", "band"), F.col("chunks"))).withColumn("other", F.explode(F.expr("sequence(0L, chunks - 1)")))
    many = many.select("band", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "content", "shingles")
    many = many.groupBy("band", "key", "i", "j").applyInPandas(_forest, "a long, b long")
    out = scratch.save(few.unionByName(many).distinct(), "similar")
    scratch.drop("members")
    scratch.drop("asked")
    return out


def per_schema(docs: DataFrame, doc_id: str) -> str:
    kind = docs.schema[doc_id].dataType.simpleString()
    return f"doc_id {kind}, root {kind}, n_links long, remove array<struct<at:int,to:int>>"


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans that overlap or touch become one; they are sorted by at."""
    for b in batches:
        spans = b.column("spans")
        size = np.asarray(spans.value_lengths().fill_null(0))
        flat = spans.flatten()
        at, to = np.asarray(flat.field("at")), np.asarray(flat.field("to")).astype(np.int64)
        row = np.repeat(np.arange(len(size)), size)
        far = np.int64(1) << 32  # sets the rows apart
        reach = np.maximum.accumulate(to + row * far) if len(to) else to
        new = np.append(True, at[1:] + row[1:] * far > reach[:-1]) if len(to) else np.zeros(0, bool)
        first = np.nonzero(new)[0]
        ends = reach[np.append(first[1:], len(to)) - 1] - row[first] * far if len(to) else to
        kept = np.concatenate([[0], np.cumsum(np.bincount(row[first], minlength=len(size)))])
        cells = pa.StructArray.from_arrays([pa.array(at[first].astype(np.int32)), pa.array(ends.astype(np.int32))], ["at", "to"])
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("root"), b.column("n_links"), pa.ListArray.from_arrays(pa.array(kept.astype(np.int32)), cells)], ["doc_id", "root", "n_links", "remove"])


def repeats(docs: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: doc_id, component_id (the least id linked to it, itself included), n_links (paragraphs it shares), n_remove and remove (word spans that another document keeps)."""
    spark = docs.sparkSession
    all_ = scratch.save(paragraphs(docs, doc_id, text), "paragraphs")
    span = F.min("doc_id").alias("first"), F.max("doc_id").alias("last")
    twice = scratch.save(all_.groupBy("content").agg(*span).where("first < last"), "twice")
    lines = scratch.save(all_.where("bands IS NOT NULL").groupBy("content").agg(*span, F.first("bands").alias("bands")), "lines")
    alike = components(spark, similar_lines(lines, all_.where("bands IS NOT NULL").select("content", "shingles"), scratch), Scratch(spark, "op10-lines")).withColumnRenamed("node", "content")
    # A line's owners; a window of another document may equal the line.
    of = alike.join(lines.select("content", F.col("first").alias("f"), F.col("last").alias("l")), "content").join(twice, "content", "left")
    of = scratch.save(of.select("content", "root", F.coalesce("first", "f").alias("first"), F.coalesce("last", "l").alias("last")), "alike")
    clusters = of.groupBy("root").agg(F.min("first").alias("keeper"), F.max("last").alias("final"))
    of = scratch.save(of.join(clusters, "root").where("keeper < final").select("content", "keeper"), "clusters")
    # A content is shared if equal or similar ones are in another document.
    alone = twice.select("content", "first").join(of, "content", "left_anti").withColumnRenamed("first", "keeper")
    owner = scratch.save(of.unionByName(alone), "owners")
    mine = scratch.save(all_.select("doc_id", "at", "n", "content", "proof").join(owner, "content"), "shared")
    scratch.drop("paragraphs")
    # Contents whose hash two different paragraphs have are taken apart by the other hash.
    torn = mine.groupBy("content").agg(F.min("proof").alias("p"), F.max("proof").alias("q")).where("p < q").select("content")
    torn = scratch.save(torn, "torn")
    if not torn.isEmpty():
        of = mine.join(torn, "content", "left_semi").groupBy("content", "proof").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last")).where("keeper < last")
        apart = mine.drop("keeper").join(of.drop("last"), ["content", "proof"])
        mine = scratch.save(mine.join(torn, "content", "left_anti").unionByName(apart), "shared-apart")
    mine = mine.select("doc_id", "at", "n", "keeper")
    edges = mine.where("doc_id <> keeper").select(F.col("doc_id").alias("a"), F.col("keeper").alias("b")).distinct()
    found = components(spark, edges, scratch)
    per = mine.groupBy("doc_id").agg(
        F.count("*").alias("n_links"),
        F.array_sort(F.collect_set(F.when(F.col("doc_id") > F.col("keeper"), F.struct("at", (F.col("at") + F.col("n")).alias("to"))))).alias("spans"),
    )
    per = per.join(found.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left").mapInArrow(_merged, per_schema(docs, doc_id))
    per = scratch.save(per, "per-document")
    for name in ("twice", "lines", "similar", "alike", "clusters", "owners", "shared", "torn", "shared-apart"):
        scratch.drop(name)
    ids = docs.select(docs[doc_id].alias("doc_id")).join(per, "doc_id", "left")
    remove = F.coalesce("remove", F.array().cast("array<struct<at:int,to:int>>"))
    return ids.select("doc_id", F.least("doc_id", F.coalesce("root", "doc_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.size(remove).cast("long").alias("n_remove"), remove.alias("remove"))
