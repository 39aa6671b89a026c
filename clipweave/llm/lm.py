"""Scoring with an Elias-Fano n-gram trie of words, pairs and, at order 3, triples of words.

Level 1, in shards by leading bits of the word's XXH64: the sorted hashes as an
Elias-Fano sequence (a word's id is its place among all), the running sums of counts as
another, and how many different words follow each. Level 2, in shards of about equal
numbers of tokens, cut by (context, word): the contexts' ids and the monotone pointers to
their successors as Elias-Fano sequences, the successors as a third (a successor counts
from its context's place times the number of words on, so that all of a shard's are one
rising sequence), and the discounted probability of each quantised to 16 bits. A word
after a context is searched among that context's successors only. Frequent contexts are
spread over shards by the word.

Level 3 is built like level 2, from the pairs on: a triple lies in the shard of its first
two words, its context is the place of that pair in the shard, so that pointers need no
search, and beside each context stands, quantised, the weight it leaves to the shorter one. So a text is scored by
descending: the word's id, the pair among the successors of its first word, the triple
among the successors of the pair.

The model interpolates: p(w|v) = max(c(v,w) - D, 0) / c(v) + D s(v) / c(v) p(w), with
s(v) the number of v's distinct successors and p(w) = (c(w) + 1) / (N + V + 1), and
p(w|u,v) likewise from c(u,v,w), c(u,v), s(u,v) and p(w|v). The end token closes a text
and is the first word's only context. The trie holds every pair and triple of words of
the training texts and grows with them.

Tasks count inside blocks of about BLOCK tokens and hand over a sorted array for each
shard, as compressed differences; a shard's task merges those and writes its arrays to shared storage. Scoring
tasks map the arrays into memory and touch the pages they need; of a block's words and
pairs each is looked up once, shard after shard, and up to OPEN shards stay mapped.

Limits: ids have 32 bits, so fit raises beyond 2^32 different words; a count of a block
has 32 bits. A text is one row, its tokens are held in memory, about 50 bytes each.

Nulls: a null text is empty and has one token, the end; a null id is in training.
Repeated rows count and are scored each. With no training text N and V are 0 and every
token has probability 1.
"""

from __future__ import annotations

import itertools
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import xxhash
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from clipweave.sources.shared import get, local_path, put

from .common import Scratch, unused, widened
from .eliasfano import EliasFano, U

BLOCK, DISCOUNT, STEP, OPEN, ORDER = 1_200_000, 0.75, 1024, 256, 3
CODEC, SHARD, MERGE = "zstd", 4_000_000, 1 << 17  # tokens of a shard of levels 2 and 3; entries handled at once
END = b"\n"  # no word holds it
WEIGHTS = 10.0 ** (-np.arange(1 << 16) / STEP)  # by code


def _named(prefix: str, arrays: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {f"{prefix}-{k}": v for k, v in arrays.items()}


@lru_cache(maxsize=4 * OPEN)
def _sequence(path: str, prefix: str) -> EliasFano:
    names = [f"{prefix}-{k}" for k in ("meta", "low", "high", "ones", "zeros")]
    return EliasFano({k.partition("-")[2]: v for k, v in get(path, *names).items()})


@lru_cache(maxsize=OPEN)
def _array(path: str, name: str) -> np.ndarray:
    return get(path, name)[name]


class Block:
    """Texts of some rows: sizes, and tokens as numbers of the block's own vocabulary (0 is the end), of which hashes are kept."""

    def __init__(self, texts: pa.Array):
        parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))  # the blanks are space and 9 to 13
        sizes = np.asarray(parts.value_lengths()).astype(np.int64)
        words, row = parts.flatten(), np.repeat(np.arange(len(sizes)), sizes)
        del parts
        said = np.asarray(pc.binary_length(words)) > 0  # blanks at an end leave an empty word
        if not said.all():
            words, row = words.filter(pa.array(said)), row[said]
        coded = words.dictionary_encode()
        self.sizes = np.bincount(row, minlength=len(sizes)) + 1
        self.tokens = np.zeros(len(row) + len(sizes), np.int32)
        row += np.arange(len(row))
        self.tokens[row] = np.asarray(coded.indices) + 1  # an end stands after each text
        known = coded.dictionary.cast(pa.binary()).to_pylist()
        self.hashes = np.fromiter(map(xxhash.xxh64_intdigest, itertools.chain([END], known)), U, len(known) + 1)


def _blocks(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.Table, Block]]:
    """Rows in groups of about BLOCK tokens."""
    held, size = [], 0

    def made() -> tuple[pa.Table, Block]:
        rows = pa.Table.from_batches(held)
        held.clear()
        return rows, Block(rows.column(text).combine_chunks().fill_null(""))

    for b in batches:
        upto = size + np.cumsum(np.asarray(pc.binary_length(b.column(text)).fill_null(0)).astype(np.int64) // 6 + 1)
        at = 0
        while at < len(b):
            end = min(len(b), int(np.searchsorted(upto, BLOCK)) + 1)
            held.append(b.slice(at, end - at))
            size, at = int(upto[end - 1]), end
            if size >= BLOCK:
                yield made()
                upto, size = upto - size, 0
    if held:
        yield made()


def _planes(values: np.ndarray) -> bytes:
    """The first bytes of all values, then their second bytes, and so on, compressed: so they take little room in the JVM, too."""
    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T), codec=CODEC, asbytes=True)


def _whole(raw: pa.Buffer, kind: type, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(pa.decompress(raw, n * size, codec=CODEC), np.uint8).reshape(size, -1).T).view(kind).ravel()


def _rows(shard: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row for each shard of keys sorted by shard and key: the keys' differences and their counts as bytes."""
    first, _ = _runs(shard)
    for a, b in zip(first, np.append(first[1:], len(keys))):
        yield _row(int(shard[a]), keys[a:b], counts[a:b])


def _row(shard: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "n": pa.array([len(keys)], pa.int64()), "keys": pa.array([_planes(np.diff(keys.astype(U), prepend=U(0)))], pa.binary()), "counts": pa.array([_planes(counts.astype(np.uint32))], pa.binary())})


def _sized(shard: int, counts: np.ndarray) -> pa.Table:
    return pa.table({"shard": pa.array([shard], pa.int64()), "n": pa.array([len(counts)], pa.int64()), "total": pa.array([int(counts.sum())], pa.int64())})


def _shard_of(rows: pa.Table) -> int:
    return rows.column("shard")[0].as_py()


def _merge(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all rows in order, each once, and the sums of their counts. Rows are sorted, so ranges of keys are merged one after the other."""
    raw = [[x.as_buffer() for x in rows.column(c)] for c in ("keys", "counts")]
    ends = np.cumsum([0, *rows.column("n").to_pylist()])
    keys, counts = np.empty(ends[-1], U), np.empty(ends[-1], np.uint32)
    for a, b, k, c in zip(ends, ends[1:], *raw):
        np.cumsum(_whole(k, U, b - a), out=keys[a:b])
        counts[a:b] = _whole(c, np.uint32, b - a)
    cuts = np.unique(np.sort(keys[:: MERGE // 64])[64::64])  # ranges of about so many, but for a key that many rows have
    spans = np.stack([np.concatenate([[a], a + np.searchsorted(keys[a:b], cuts), [b]]) for a, b in zip(ends, ends[1:])], axis=1).tolist()
    out = []
    for at, to in zip(spans, spans[1:]):
        part = np.concatenate([keys[a:b] for a, b in zip(at, to)])
        order = np.argsort(part, kind="stable")
        part = part[order]
        first, _ = _runs(part)
        if len(first):
            out.append((part[first], np.add.reduceat(np.concatenate([counts[a:b] for a, b in zip(at, to)])[order], first, dtype=np.int64)))
    del keys, counts
    return np.concatenate([k for k, _ in out]), np.concatenate([c for _, c in out])


def _parts(n: int) -> Iterator[slice]:
    return (slice(a, min(n, a + MERGE)) for a in range(0, n, MERGE))


def _codes(p: np.ndarray) -> np.ndarray:
    return np.round(-np.log10(p) * STEP).astype(np.uint16)


class Model:
    """Where the levels are, and their sizes; small, so it travels with the tasks."""

    def __init__(self, path: str, bits: int, level1: list[Row], shards: int, order: int = ORDER):
        self.path, self.bits, self.shards, self.order = path, bits, shards, order
        self.followed = False  # whether level 2 is written
        self.words, self.tokens = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        for r in level1:
            self.words[r.shard], self.tokens[r.shard] = r.n, r.total
        self.base = np.concatenate([[0], np.cumsum(self.words)])
        self.start = np.concatenate([[0], np.cumsum(self.tokens)])
        self.v, self.n = int(self.base[-1]), int(self.start[-1])
        if self.v >= 1 << 32:
            raise ValueError("ids of words have 32 bits")

    def lookup(self, hashes: np.ndarray, followed: bool = False) -> tuple[np.ndarray, ...]:
        """(id or -1, count, tokens of all words before it) for each hash; followed: also how many different words come after it."""
        order = np.argsort(hashes)
        h = hashes[order]
        shard = (h >> U(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(h), np.int64)
        ids, counts, sums, after = np.full(len(h), -1), *(np.zeros(len(h), np.int64) for _ in range(3))
        for s in np.unique(shard):
            if not self.words[s]:
                continue
            a, b = np.searchsorted(shard, [s, s + 1])
            at = _sequence(f"{self.path}/1-{s}", "hash").find(h[a:b])
            ok = np.nonzero(at >= 0)[0]
            sums_of = _sequence(f"{self.path}/1-{s}", "sum")
            low, high = sums_of.get(at[ok]).astype(np.int64), sums_of.get(at[ok] + 1).astype(np.int64)
            ids[a + ok], counts[a + ok], sums[a + ok] = at[ok] + self.base[s], high - low, low + self.start[s]
            if followed:
                after[a + ok] = _array(f"{self.path}/1-{s}", "after")[at[ok]]
        out = np.empty_like(order)
        out[order] = np.arange(len(order))
        return ids[out], counts[out], sums[out], after[out]

    def shard(self, sums: np.ndarray, counts: np.ndarray, word: np.ndarray | int) -> np.ndarray:
        """Of a pair: by the context's place among all tokens, and in it by the word."""
        return ((sums + counts * (word / max(self.v, 1))) * (self.shards / max(self.n, 1))).astype(np.int64)


def _count_words(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block in _blocks(batches, 0):
            counts = np.bincount(block.tokens, minlength=len(block.hashes))
            order = np.argsort(block.hashes)
            h = block.hashes[order]
            yield from _rows((h >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64), h, counts[order])
            del block

    return run


def _write_words(path: str, bits: int):
    def run(rows: pa.Table) -> pa.Table:
        keys, counts = _merge(rows)
        s = _shard_of(rows)
        sums = np.concatenate([[0], np.cumsum(counts)])
        put(f"{path}/1-{s}", _named("hash", EliasFano.build(keys, 1 << 64)) if not bits else _named("hash", EliasFano.build(keys, (s + 1) << (64 - bits))))
        put(f"{path}/1-{s}", _named("sum", EliasFano.build(sums, int(sums[-1]) + 1)))
        return _sized(s, counts)

    return run


def _count_pairs(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block in _blocks(batches, 0):
            pairs = Pairs(model, block)
            yield from _rows(pairs.shard, _keys(pairs.ids[pairs.v], pairs.ids[pairs.w]), pairs.n)
            del pairs, block  # before the next are made

    return run


def _keys(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    keys = high.astype(U)
    keys <<= U(32)
    keys |= low.astype(U)
    return keys


def _write_pairs(model: Model):
    def run(rows: pa.Table) -> pa.Table:
        keys, counts = _merge(rows)
        s = _shard_of(rows)
        new = np.ones(len(keys), bool)
        for i in _parts(len(keys) - 1):
            new[1:][i] = keys[1:][i] >> U(32) != keys[:-1][i] >> U(32)
        first = np.nonzero(new)[0]
        context = np.cumsum(new, dtype=np.int32) - np.int32(1)
        v = keys[first] >> U(32)
        totals = np.zeros(len(v), np.int64)
        for u in np.unique(at := np.searchsorted(model.base, v.astype(np.int64), side="right") - 1):
            mine = np.nonzero(at == u)[0]
            sums = _sequence(f"{model.path}/1-{u}", "sum")
            local = v[mine].astype(np.int64) - model.base[u]
            totals[mine] = sums.get(local + 1).astype(np.int64) - sums.get(local).astype(np.int64)
        many = np.diff(np.append(first, len(keys)))
        code = np.empty(len(keys), np.uint16)
        for i in _parts(len(keys)):
            code[i] = _codes((counts[i] - DISCOUNT) / totals[context[i]])
            _place(keys[i], context[i], model)
        put(f"{model.path}/2-{s}", _named("context", EliasFano.build(v, 1 << 32)))
        put(f"{model.path}/2-{s}", _named("pointer", EliasFano.build(np.append(first, len(keys)), len(keys) + 1)))
        put(f"{model.path}/2-{s}", _named("next", EliasFano.build(keys, len(v) * model.v)))
        put(f"{model.path}/2-{s}", {"code": code})
        cuts = np.searchsorted(v.astype(np.int64), model.base)
        return pa.Table.from_batches([_row(u, v[a:b] - U(model.base[u]), many[a:b]) for u, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b])

    return run


def _place(keys: np.ndarray, context: np.ndarray, model: Model) -> None:
    """Turn keys into successors (their low halves) counted on from their context's place."""
    keys &= U(0xFFFFFFFF)
    keys += context.astype(U) * U(model.v)


def _write_after(model: Model):
    """Of a shard of level 1, the numbers of different words after each word; a frequent context's parts are added up."""

    def run(rows: pa.Table) -> pa.Table:
        keys, counts = _merge(rows)
        s = _shard_of(rows)
        after = np.zeros(int(model.words[s]), np.uint32)
        after[keys.astype(np.int64)] = counts
        put(f"{model.path}/1-{s}", {"after": after})
        return _sized(s, counts)

    return run


def _count_triples(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block in _blocks(batches, 0):
            pairs = Pairs(model, block)
            context, word, _, n = pairs.triples()
            yield from _rows(pairs.shard[context], _keys(pairs.rank[context], pairs.ids[word]), n)
            del pairs, block, context, word, n

    return run


def _write_triples(model: Model):
    def run(rows: pa.Table) -> pa.Table:
        keys, counts = _merge(rows)
        s = _shard_of(rows)
        size = len(_array(f"{model.path}/2-{s}", "code"))
        many, totals = np.zeros(size, np.int64), np.zeros(size)
        for i in _parts(len(keys)):
            pair = (keys[i] >> U(32)).astype(np.int64)
            low, high = pair[0], pair[-1] + 1
            many[low:high] += np.bincount(pair - low)
            totals[low:high] += np.bincount(pair - low, weights=counts[i])
        code = np.empty(len(keys), np.uint16)
        for i in _parts(len(keys)):
            pair = (keys[i] >> U(32)).astype(np.int64)
            code[i] = _codes((counts[i] - DISCOUNT) / totals[pair])
            _place(keys[i], pair, model)
        back = np.empty(size, np.uint16)
        for i in _parts(size):  # a pair that ends a text leaves all
            back[i] = _codes(np.where(many[i] > 0, DISCOUNT * many[i] / np.maximum(totals[i], 1), 1))
        done = _sized(s, counts)
        del counts, totals
        put(f"{model.path}/3-{s}", _named("next", EliasFano.build(keys, size * model.v)))
        put(f"{model.path}/3-{s}", _named("pointer", EliasFano.build(np.append(0, np.cumsum(many)), len(keys) + 1)))
        put(f"{model.path}/3-{s}", {"back": back, "code": code})
        return done

    return run


ROWS, SIZES = "shard long, n long, keys binary, counts binary", "shard long, n long, total long"


def fit(docs: DataFrame, scratch: Scratch, text: str = "text", parts: int | None = None, order: int = ORDER) -> Model:
    """Count and write the trie of these texts, of pairs (order 2) or triples (order 3) of words."""
    if order not in (2, 3):
        raise ValueError("the order is 2 or 3")
    texts = docs.select(docs[text].cast("string").alias("text"))
    parts = parts or max(1, texts.rdd.getNumPartitions())
    bits = (parts - 1).bit_length()
    path = f"{scratch.path}/trie"
    words = texts.mapInArrow(_count_words(bits), ROWS).groupBy("shard").applyInArrow(_write_words(path, bits), SIZES)
    level1 = words.collect()  # a row for each shard
    shards = max(parts, -(-sum(r.total for r in level1) // SHARD))  # large partitions are no large shards
    model = Model(path, bits, level1, shards, order)
    pairs = texts.mapInArrow(_count_pairs(model), ROWS).groupBy("shard").applyInArrow(_write_pairs(model), ROWS)
    pairs.groupBy("shard").applyInArrow(_write_after(model), SIZES).agg(F.sum("n")).collect()
    model.followed = True
    if order == 3:
        texts.mapInArrow(_count_triples(model), ROWS).groupBy("shard").applyInArrow(_write_triples(model), SIZES).agg(F.sum("n")).collect()
    return model


@lru_cache(maxsize=1 << 16)
def _exists_at(path: str) -> bool:
    if local := local_path(f"{path}.code.npy"):
        return os.path.exists(local)
    fs, key = pyarrow.fs.FileSystem.from_uri(f"{path}.code.npy")
    return fs.get_file_info(key).type != pyarrow.fs.FileType.NotFound


def _runs(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal values begins, and the run of every place."""
    new = np.append(True, sorted_[1:] != sorted_[:-1]) if len(sorted_) else np.zeros(0, bool)
    run = np.cumsum(new, dtype=np.int32)
    run -= 1
    return np.nonzero(new)[0], run


def _distinct(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(high, low, number of every row's pair, counts): the different pairs in order, all of 32 bits. Where bits allow, each row's place is sorted along in one integer, which is several times as fast."""
    n = len(high)
    if not n:
        return high, low, np.zeros(0, np.int32), np.zeros(0, np.int32)
    place, right = n.bit_length(), int(low.max()).bit_length()
    key = high.astype(np.int64)
    if int(high.max()).bit_length() + right + place <= 63:
        key <<= right
        key |= low
        key <<= place
        key |= np.arange(n, dtype=np.int32)
        key.sort()
        order = (key & ((1 << place) - 1)).astype(np.int32)
        key >>= place
    else:
        right = 32
        key <<= right
        key |= low
        order = np.argsort(key, kind="stable")
        key = key[order]
    first, run = _runs(key)
    of = np.empty(n, np.int32)
    of[order] = run
    del order, run
    key = key[first]
    return (key >> right).astype(np.int32), (key & ((1 << right) - 1)).astype(np.int32), of, np.diff(np.append(first, n)).astype(np.int32)


def _found(model: Model, level: int, shard: np.ndarray, ngrams: Callable[[slice], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in the shard or -1, stored probability or 0, weight left to the shorter context or 1) of n-grams of a level, sorted by shard and context. ngrams: the contexts and words of some of them."""
    place, p, back = np.full(len(shard), -1, np.int32), np.zeros(len(shard)), np.ones(len(shard) if level > 2 else 0)
    first, _ = _runs(shard)
    for a, b in zip(first, np.append(first[1:], len(shard))):
        path = f"{model.path}/{level}-{int(shard[a])}"
        if not _exists_at(path):
            continue
        context, word = ngrams(slice(a, b))
        if level > 2:
            own = context
            back[a:b] = WEIGHTS[_array(path, "back")[own]]
        else:
            start, of = _runs(context)
            own = _sequence(path, "context").find(context[start])[of]
        ok = np.nonzero(own >= 0)[0]
        got = _sequence(path, "next").find(own[ok].astype(U) * U(model.v) + word[ok].astype(U))
        hit = ok[got >= 0] + a
        place[hit] = got[got >= 0]
        p[hit] = WEIGHTS[_array(path, "code")[got[got >= 0]]]
    return place, p, back


class Pairs:
    """A block's words, numbered anew in the order of their ids, and its different pairs of them, so numbered that shards and places in shards rise with them: shard, place (rank; -1 for unseen ones) and stored probability."""

    def __init__(self, model: Model, block: Block):
        ids, counts, sums, after = model.lookup(block.hashes, followed=model.followed)
        order = np.argsort(ids, kind="stable")
        number = np.empty(len(order), np.int32)
        number[order] = np.arange(len(order))
        self.ids, self.counts, self.sums, self.after = ids[order], counts[order], sums[order], after[order]
        self.sizes, self.tokens = block.sizes, number[block.tokens]
        before = np.concatenate([number[:1], self.tokens[:-1]]) if len(self.tokens) else self.tokens
        self.v, self.w, self.of, self.n = _distinct(before, self.tokens)
        del before
        known = np.nonzero((self.ids[self.v] >= 0) & (self.ids[self.w] >= 0))[0].astype(np.int32)
        self.shard, self.rank, self.p = np.zeros(len(self.v), np.int32), np.full(len(self.v), -1, np.int32), np.zeros(len(self.v))
        for i in _parts(len(known)):
            v, w = self.v[known[i]], self.w[known[i]]
            self.shard[known[i]] = model.shard(self.sums[v], self.counts[v], self.ids[w])
        if model.followed:
            self.rank[known], self.p[known], _ = _found(model, 2, self.shard[known], lambda i: (self.ids[self.v[known[i]]], self.ids[self.w[known[i]]]))

    def triples(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(pair, word, triple of each token but the first of each text, counts): the different triples as numbers of a pair and a word."""
        later = self.later()
        return _distinct(self.of[:-1][later[1:]], self.tokens[later])

    def later(self) -> np.ndarray:
        """Of each token, whether it is not the first of its text."""
        later = np.ones(len(self.tokens), bool)
        later[np.cumsum(self.sizes) - self.sizes] = False
        return later


def score_block(model: Model, block: Block) -> dict[str, np.ndarray]:
    pairs = Pairs(model, block)
    counts = pairs.counts
    single = (counts + 1) / (model.n + model.v + 1)
    back = np.ones(len(counts))
    seen = np.nonzero(pairs.ids >= 0)[0]
    back[seen] = DISCOUNT * pairs.after[seen] / counts[seen]
    for i in _parts(len(pairs.p)):
        pairs.p[i] += back[pairs.v[i]] * single[pairs.w[i]]
    p = pairs.p[pairs.of]
    pairs.p = pairs.v = pairs.w = None
    if model.order > 2 and len(p):
        context, word, of, _ = pairs.triples()
        pairs.of = None
        seen = pairs.rank[context] >= 0
        # a triple whose last word is new has no place, but its context still leaves its weight
        new = np.nonzero(seen & (pairs.ids[word] < 0))[0]
        known = np.nonzero(seen & (pairs.ids[word] >= 0))[0].astype(np.int32)
        own, left = np.zeros(len(context)), np.ones(len(context))
        _, own[known], left[known] = _found(model, 3, pairs.shard[context[known]], lambda i: (pairs.rank[context[known[i]]], pairs.ids[word[known[i]]]))
        left[new] = _left(model, pairs.shard[context[new]], pairs.rank[context[new]])
        del context, word, seen, new, known
        at = np.nonzero(pairs.later())[0]
        for i in _parts(len(at)):
            p[at[i]] = own[of[i]] + left[of[i]] * p[at[i]]
        del own, left, of, at
    rows = len(block.sizes)
    row = np.repeat(np.arange(rows), block.sizes)
    add = lambda x: np.bincount(row, weights=x, minlength=rows)
    return {"n_tokens": block.sizes, "n_known": add((counts > 0)[pairs.tokens]).astype(np.int64), "base_score": add(np.log10(single)[pairs.tokens]), "score": add(np.log10(p, out=p))}


def _left(model: Model, shard: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The weight that contexts of level 3, sorted, leave to the shorter one."""
    return _found(model, 3, shard, lambda i: (rank[i], np.zeros(len(rank[i]), np.int64)))[2]


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents with n_tokens, n_known, train_tokens, base_score and score (columns of these names are replaced)."""
    new = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    base = docs.drop(*new)
    kind = dict(base.dtypes).get(text)
    names, own = base.columns, unused(base, "text_")
    texts, at = ([], base.columns.index(text)) if kind == "string" else ([base[text].cast("string").alias(own)], len(names))  # large texts go to the workers once
    schema = widened(base, **{c: "double" if c.endswith("score") else "long" for c in new})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, block in _blocks(batches, at):
            out = score_block(model, block)
            out["train_tokens"] = np.full(len(block.sizes), model.n)
            del block  # before the next is made
            rows = rows.select(names)
            for c in new:
                rows = rows.append_column(c, pa.array(out[c]))
            yield from rows.combine_chunks().to_batches()
            del rows, out

    return base.select(*[base[c] for c in names], *texts).mapInArrow(run, schema)
