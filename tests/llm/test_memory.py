"""Memory of the language model's steps, in traced bytes an entry, beside their results."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from clipweave.llm import eliasfano, lm
from clipweave.llm.common import Scratch


@pytest.mark.parametrize("bits", [1, 7, 31, 33, 56])
def test_packed_integers_in_pieces(bits, monkeypatch):
    monkeypatch.setattr(eliasfano, "CHUNK", 64)
    v = np.random.default_rng(bits).integers(0, 1 << bits, 1000, dtype=np.uint64)
    for n in (0, 1, 63, 64, 65, 1000):
        assert (eliasfano.unpack(eliasfano.pack(v[:n], bits), bits, np.arange(n)) == v[:n]).all()


def test_building_a_sequence_takes_little_memory():
    v = np.sort(np.random.default_rng(1).integers(0, 1 << 44, 1 << 20, dtype=np.uint64))
    tracemalloc.start()
    made = eliasfano.EliasFano.build(v, 1 << 44)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 * len(v)  # the result takes about 4 bytes each
    e = eliasfano.EliasFano(made)
    assert (e.get(np.arange(len(v))) == v).all()


def test_merge_of_counts_takes_little_memory():
    g = np.random.default_rng(2)
    rows = [np.unique(g.integers(0, 1 << 20, 50_000, dtype=np.uint64)) * np.uint64(1 << 30) for _ in range(40)]
    counts = [g.integers(1, 9, len(r)) for r in rows]
    table = pa.Table.from_batches([lm._row(3, r, c) for r, c in zip(rows, counts)])
    tracemalloc.start()
    keys, sums = lm._merge(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want, at = np.unique(np.concatenate(rows), return_inverse=True)
    assert (keys == want).all() and (sums == np.bincount(at, weights=np.concatenate(counts))).all()
    assert peak < 36 * sum(map(len, rows))


def test_large_partitions_make_no_large_shards(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 97}" for k in range(50))) for i in range(200)], "doc_id long, text string").coalesce(1)
    one = lm.fit(docs, Scratch(spark, "t"))
    monkeypatch.setattr(lm, "SHARD", 2000)
    many = lm.fit(docs, Scratch(spark, "t"))
    assert (one.shards, many.shards) == (1, 6)  # 10,200 tokens
    of = lambda m: {r.doc_id: (r.n_known, r.base_score, r.score) for r in lm.score(docs, m).collect()}
    assert of(one) == of(many)


def test_scoring_a_block_takes_little_memory(spark):
    g = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in g.integers(0, 20_000, 2000)) for _ in range(100)]
    model = lm.fit(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1), Scratch(spark, "t"), parts=16)
    block = lm.Block(pa.array(texts))
    tracemalloc.start()
    lm.score_block(model, block)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 * len(block.tokens)
