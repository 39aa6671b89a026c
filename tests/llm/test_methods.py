"""The methods at their bounds: crowded keys, large benchmarks, hubs, ledgers opened again, odd ids and names."""

import math
import os
import re
import subprocess
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from clipweave.llm import common, decontaminate, langid, lm, mixing, passages, quality, queries, secrets, simhash, topk, warc
from clipweave.llm.common import Scratch, table
from clipweave.llm.components import components

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def linked(values, near):
    """The least index reachable, for every index."""
    label = list(range(len(values)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(values):
            for j, b in enumerate(values):
                if near(a, b) and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


@pytest.mark.parametrize("block", [(1, 1), (3, 2), (3, 64), (64, 16)])
def test_crowded_fingerprints_link_like_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(4)
    fps = set()
    for centre in rng.integers(0, 1 << 63, 4).tolist():
        for _ in range(25):
            x = centre
            for b in rng.integers(0, 64, rng.integers(0, 5)).tolist():
                x ^= 1 << b
            fps.add(x)
    fps = sorted(simhash.signed(x) for x in fps)
    edges = simhash.links(spark, spark.createDataFrame([(x,) for x in fps], "fp long"), Scratch(spark, "t"))
    got = {r.node: r.root for r in components(spark, edges, Scratch(spark, "t")).collect()}
    label = linked(fps, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2)
    roots = defaultdict(set)
    for x, k in zip(fps, label):
        roots[got.get(x, x)].add(k)
    assert all(len(v) == 1 for v in roots.values()) and len(roots) == len(set(label))


@pytest.mark.parametrize("kind", ["path", "star", "random", "tree"])
def test_components_of_any_shape(spark, kind):
    rng = np.random.default_rng(1)
    n = 300
    edges = {"path": [(i, i + 1) for i in range(n)], "star": [(n, i) for i in range(n)], "random": rng.integers(0, n, (n // 2, 2)).tolist(), "tree": [(i, (i - 1) // 2) for i in range(1, n)]}[kind]
    names = rng.permutation(n + 1).tolist()
    edges = [(names[a], names[b]) for a, b in edges]
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(n):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = components(spark, spark.createDataFrame([tuple(map(str, e)) for e in edges], "a string, b string").select(F.lpad("a", 4, "0").alias("a"), F.lpad("b", 4, "0").alias("b")), Scratch(spark, "t")).collect()
    assert len(got) == len(root) and {int(r.node): int(r.root) for r in got} == root


@pytest.mark.parametrize("edges, rounds", [([], 0), ([(1, 1)], 0), ([(1, 2), (3, 1), (3, 1), (5, 4)], 0), ([(1, 2), (2, 3)], 1)])
def test_components_write_no_round_for_stars(spark, edges, rounds):
    class Counting(Scratch):
        names = []

        def save(self, df, name):
            self.names.append(name)
            return super().save(df, name)

    scratch = Counting(spark, "t")
    scratch.names.clear()
    got = {r.node: r.root for r in components(spark, spark.createDataFrame(edges, "a long, b long"), scratch).collect()}
    assert sum(n.startswith("edges-") for n in scratch.names) == 1 + rounds
    assert got == {x: 4 if x > 3 else 1 for e in edges for x in e if e[0] != e[1]}


@pytest.mark.parametrize("most", [0, 2_000_000])
def test_decontamination_with_a_benchmark_of_any_size(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "BROADCAST", most)
    got = queries.op1_decontamination(spark, DATA).collect()
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    fold = lambda t: pattern.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    wins = defaultdict(set)
    for r in table(spark, DATA, "benchmark").collect():
        w = fold(r.text)
        n = min(len(w), 13)
        for i in range(len(w) - n + 1 if n else 0):
            wins[tuple(w[i : i + n])].add(str(r.item_id))
    want = []
    for r in table(spark, DATA, "documents").collect():
        w, hit, items = fold(r.text), set(), set()
        for n in {len(k) for k in wins}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in wins:
                    hit |= set(range(i, i + n))
                    items |= wins[tuple(w[i : i + n])]
        want.append((r.doc_id, len(w), len(hit), len(items)))
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in got) == sorted(want)


def test_decontamination_of_a_long_text_and_short_items(spark):
    text = "a " * 200_000 + "needle in hay " + "b " * 200_000
    items = spark.createDataFrame([(1, "Needle in hay"), (2, "hay"), (None, "b b b b b b b b b b b b b b")], "item_id long, text string")
    docs = spark.createDataFrame([(1, text), (1, text), (2, "nothing")], "doc_id long, text string").withColumn("n_words", F.lit("x")).withColumn("digest", F.lit("y")).withColumn("row", F.lit(1))
    got = decontaminate.scan(docs, items, Scratch(spark, "t")).orderBy("doc_id").collect()
    assert [(r.n_words, len(r.hits), r["items"], r.digest, r.row) for r in got] == [(400_003, 200_003, ["1", "2"], "y", 1)] * 2 + [(1, 0, [], "y", 1)]


SESSION = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from clipweave.llm import secrets
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {shared!r}).getOrCreate()
docs = spark.createDataFrame([("a", "2", "token=abcdefgh"), ("b", "1", "new AKIA" + "B" * 16), ("c", "1", None)], "path string, version string, text string")
ledger = secrets.Ledger(spark, {ledger!r})
before = ledger.blobs().count()
rows = secrets.scan(docs, ledger, path="path", version="version").orderBy("path").collect()
print("SAYS", before, ledger.blobs().count(), [len(r.findings) for r in rows], sorted((r.path, r.version) for r in ledger.history().collect()))
"""


def test_a_ledger_is_opened_again_by_another_process(spark, tmp_path, monkeypatch):
    scanned = []
    ledger = secrets.Ledger(spark, str(tmp_path / "ledger"))
    docs = spark.createDataFrame([("a", "1", "token=abcdefgh"), ("x", "1", "plain"), ("c", "0", None)], "path string, version string, text string")
    for _ in range(2):
        secrets.scan(docs, ledger, path="path", version="version").collect()
        scanned.append((ledger.blobs().count(), ledger.versions().count()))
    assert scanned == [(3, 3), (3, 3)]
    code = SESSION.format(root=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), shared=str(tmp_path), ledger=str(tmp_path / "ledger"))
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120).stdout
    # 3 known blobs, one new; a's second version has the known text; history names every version with findings
    assert out.split("SAYS ")[1].strip() == "3 4 [1, 1, 0] [('a', '1'), ('a', '2'), ('b', '1')]"


def test_redaction_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "my token=abcdefgh! and AKIA" + "Z" * 16, "b"), (2, None, "c"), (3, "clean", "d"), (3, "clean", "d")], "doc_id long, text string, findings string").withColumn("row", F.col("doc_id")).withColumn("blob", F.lit(0))
    got = secrets.redacted(docs, secrets.Ledger(spark, Scratch(spark, "t").path))
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.text or "", r.findings, r.row) for r in got.collect()) == [(1, "my [secret]! and [secret]", "b", 1), (2, "", "c", 2), (3, "clean", "d", 3), (3, "clean", "d", 3)]


def test_topk_of_repeated_ids_and_other_columns(spark):
    v = lambda x: [1.0 if (x >> b) & 1 else -1.0 for b in range(64)]
    rows = [(1, v(3)), (1, v(1)), (2, v(1)), (3, v(1)), (3, v(1)), (4, [float("nan")] * 64), (5, [None] * 64)]
    df = spark.createDataFrame(rows, "id long, vector array<double>").withColumn("code", F.lit("x")).withColumn("rank", F.lit(0))
    got = topk.search(df, df.where("id = 1"), 3).orderBy("rank").collect()
    assert [(r.neighbour_id, r.distance) for r in got] == [(2, 0), (3, 0), (4, 1)]
    assert topk.search(df.limit(0), df, 3).count() == 0


def test_mixing_sizes_and_targets_by_sql(spark):
    import duckdb

    got = queries.op6_mixing(spark, DATA).collect()
    rows = duckdb.sql(f"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM read_parquet('{DATA}/documents.parquet'))
        SELECT doc_id, source, size, sum(size) OVER (PARTITION BY source) FROM d""").fetchall()
    total = {s: w for _, s, _, w in rows}
    goal = dict(zip(sorted(total), mixing.targets([int(total[s]) for s in sorted(total)])))
    assert sorted((r.doc_id, r["size"], r.source_size, round(r.target, 6)) for r in got) == sorted((i, n, int(w), round(goal[s], 6)) for i, s, n, w in rows)
    source, most, taken = {i: s for i, s, *_ in rows}, defaultdict(int), Counter()
    for r in got:
        assert r.taken in (0, r["size"], 2 * r["size"])
        taken[source[r.doc_id]] += r.taken
        most[source[r.doc_id]] = max(most[source[r.doc_id]], r["size"])
    assert all(abs(taken[s] - goal[s]) <= most[s] for s in goal)


def test_mixing_ties_and_one_hot_source(spark):
    rows = [(k, "w " * 5, "en", "hot" if k % 3 else f"s{k % 5}", 10) for k in range(2000)]
    docs = spark.createDataFrame(rows, DOCS)
    first = {r.doc_id: tuple(r.shards) for r in mixing.draw(docs, Scratch(spark, "t"), block_docs=32, shard_words=900).collect()}
    again = {r.doc_id: tuple(r.shards) for r in mixing.draw(docs.repartition(5), Scratch(spark, "t"), block_docs=32, shard_words=900).collect()}
    assert first == again and len(first) == 2000
    sizes = Counter(s for v in first.values() for s in v)
    assert max(sizes.values()) < 3 * 900 / 5


def brute_kneser_ney(texts, order):
    """log p(c | the order - 1 characters before), by dictionaries."""
    pad = lambda t: " " * (order - 1) + t + " "
    grams = {k: Counter() for k in range(1, order + 1)}
    for t in texts:
        for k in range(1, order + 1):
            grams[k].update(pad(t)[i : i + k] for i in range(len(pad(t)) - k + 1))
    alphabet = len({c for t in texts for c in pad(t)}) + 1
    counts = {order: dict(grams[order])}
    for k in range(1, order):
        before = Counter(g[1:] for g in grams[k + 1])
        counts[k] = {g: before.get(g, 1) for g in grams[k]}
    discount, total, kinds = {}, defaultdict(float), defaultdict(int)
    for k, c in counts.items():
        n1, n2 = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        discount[k] = n1 / (n1 + 2 * n2) if n1 else 0.5
        for g, v in c.items():
            total[g[:-1]] += v
            kinds[g[:-1]] += 1

    def p(g):
        if not g:
            return 1 / alphabet
        k = len(g)
        if g[:-1] not in total:
            return p(g[1:])
        return max(counts[k].get(g, 0) - discount[k], 0) / total[g[:-1]] + discount[k] * kinds[g[:-1]] / total[g[:-1]] * p(g[1:])

    def entropy(t):
        t = pad(t)
        return -sum(math.log(p(t[i - order + 1 : i + 1])) for i in range(order - 1, len(t))) / (len(t) - order + 1)

    return entropy


def test_language_models_equal_brute_force():
    texts = {"a": ["the cat sat", "a cat", "that hat that"], "b": ["der hut", "das tut gut", "der hund"]}
    model = langid.train(texts)
    asked = ["the hut", "cat", "das xyz", "hat", "q"]
    h, _ = model.entropies(asked)
    for j, name in enumerate(model.langs):
        entropy = brute_kneser_ney(texts[name], langid.ORDER)
        # floors differ: the models share one alphabet
        shared = len({c for ts in texts.values() for t in ts for c in t + " "}) + 1
        own = len({c for t in texts[name] for c in t + " "}) + 1
        if shared == own:
            assert np.allclose(h[:, j], [entropy(t) for t in asked], atol=1e-4)
    one = langid.train({"a": texts["a"]})
    entropy = brute_kneser_ney(texts["a"], langid.ORDER)
    assert np.allclose(one.entropies(asked)[0][:, 0], [entropy(t) for t in asked], atol=1e-4)


def test_quality_weights_are_those_of_the_pairwise_loss():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, quality.FEATURES))
    y = (x[:, 0] + 0.5 * rng.normal(size=60) > 0).astype(float)
    model = quality.train(x, y)
    z = np.clip((x - model.mean) / model.scale, -6, 6)
    rng = np.random.default_rng(3)
    good, bad = np.nonzero(y == 1)[0], np.nonzero(y == 0)[0]
    n = min(quality.PAIRS, len(good) * len(bad))
    d = z[rng.choice(good, n)] - z[rng.choice(bad, n)]
    loss = lambda w: np.log1p(np.exp(-d @ w)).mean() + 5e-4 * w @ w
    best = loss(model.weights)
    for k in range(quality.FEATURES):
        for step in (-0.05, 0.05):
            assert loss(model.weights + step * np.eye(quality.FEATURES)[k]) > best
    every = model.raw(x)
    assert np.mean([every[g] > every[b] for g in good for b in bad]) > 0.9


def test_quality_and_language_on_held_out_rows(spark):
    labels = {r.doc_id: r.quality for r in table(spark, DATA, "labels").collect()}
    got = [(r.score, labels[r.doc_id]) for r in queries.op9_quality(spark, DATA).collect() if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y in got if y == 1], [s for s, y in got if y == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.9
    langs = {r.doc_id: r.lang for r in table(spark, DATA, "documents").collect()}
    got = [(r.lang_pred, langs[r.doc_id]) for r in queries.op7_language(spark, DATA).collect() if r.held_out]
    assert np.mean([a == b for a, b in got]) > 0.9


def test_columns_of_clashing_names(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der hund", "de")], "doc_id long, text string, lang string")
    odd = docs.withColumn("text_", F.lit("mine")).withColumn("TEXT__", F.lit(7)).withColumn("__text", F.lit(1))
    model = lm.fit(docs, Scratch(spark, "t"))
    for got in (lm.score(odd, model), langid.predict(odd, langid.fit(docs)), quality.score(odd, quality.fit(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")))):
        assert [(r.text_, r["TEXT__"], r["__text"]) for r in got.collect()] == [("mine", 7, 1)] * 2
    pages = spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("bytes", F.lit("z"))
    scratch = Scratch(spark, "t")
    assert warc.read(spark, warc.write(pages, scratch), scratch).count() == 1
    got = passages.repeats(odd.withColumn("content", F.lit(1)), Scratch(spark, "t"))
    assert got.count() == 2


def test_paragraphs_of_string_ids_ties_and_equal_hashes(spark, monkeypatch):
    words = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    shared = words(0, 60)
    rows = [("b", f"{words(1, 40)}\n{shared}"), ("a", f"{shared}\n{words(2, 30)}"), ("c", words(3, 80)), ("c", words(3, 80)), (None, shared), ("d", None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    find = lambda: sorted((str(r.doc_id), str(r.component_id), r.n_links > 0, r.n_remove) for r in passages.repeats(docs, Scratch(spark, "t")).collect())
    want = [("None", "None", False, 0), ("a", "a", True, 0), ("b", "a", True, 1), ("c", "c", False, 0), ("c", "c", False, 0), ("d", "d", False, 0)]
    assert find() == want
    monkeypatch.setattr(passages.Tokens, "hash", lambda t, a, b: np.minimum((t.first[0][b] - t.first[0][a]) * t.first[1][a], 1).astype(np.uint64) + (np.arange(len(a)) % 2).astype(np.uint64))
    t = passages.Tokens([words(5, 60), words(6, 60)])
    assert len(set(t.proof(np.array([0, 60]), np.array([50, 110])).tolist())) == 2


def test_contents_with_one_hash_are_taken_apart(spark, monkeypatch):
    texts = [" ".join(f"w{k}x{i}" for i in range(30)) for k in (0, 1, 0, 1, 2)]
    rows = [(i, t) for i, t in enumerate(texts)]
    real = passages.paragraphs
    fake = lambda docs, *a: real(docs, *a).where("bands IS NULL").withColumn("content", F.lit(5).cast("long"))
    monkeypatch.setattr(passages, "paragraphs", fake)
    got = passages.repeats(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t")).collect()
    assert {r.doc_id: r.component_id for r in got} == {0: 0, 1: 1, 2: 0, 3: 1, 4: 4}


def test_recall_of_banding(spark):
    rng = np.random.default_rng(6)
    found = total = 0
    texts, pairs = [], []
    for k in range(400):
        a = [f"w{x}" for x in rng.integers(0, 100_000, 120)]
        b = list(a)
        for at in rng.integers(0, 120, 2):
            b[at] = "new"
        sets = [{tuple(x[i : i + 5]) for i in range(116)} for x in (a, b)]
        if len(sets[0] & sets[1]) / len(sets[0] | sets[1]) >= 0.8:
            pairs.append((len(texts), len(texts) + 1))
            texts += [" ".join(a), " ".join(b)]
    rows = passages.paragraphs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).where("bands IS NOT NULL").select("doc_id", "bands").collect()
    bands = {r.doc_id: r.bands for r in rows}
    found = sum(any(x == y for x, y in zip(bands[a], bands[b])) for a, b in pairs)
    assert len(pairs) > 200 and found / len(pairs) >= 0.99


def test_merged_spans_of_long_lists():
    import pyarrow as pa

    spans = [[(0, 5), (3, 9), (9, 12), (20, 30)], [], None, [(k, k + 2) for k in range(0, 100_000, 3)], [(1, 50), (2, 3), (60, 61)]]
    kind = pa.list_(pa.struct([("at", pa.int32()), ("to", pa.int32())]))
    rows = [None if s is None else [{"at": a, "to": b} for a, b in s] for s in spans]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(range(5)), pa.array([1] * 5, pa.int64()), pa.array(rows, kind)], ["doc_id", "root", "n_links", "spans"])
    got = [[(x["at"], x["to"]) for x in r] for r in next(passages._merged(iter([batch]))).column("remove").to_pylist()]
    assert got == [[(0, 12), (20, 30)], [], [], spans[3], [(1, 50), (60, 61)]]


def test_very_long_texts(spark):
    text = " ".join(f"w{i % 977}" for i in range(200_000)) + " token=abcdefgh"
    docs = spark.createDataFrame([(1, text, "en", "a", len(text)), (2, text, "en", "a", len(text)), (3, "short", "de", "b", 5)], DOCS)
    found = {r.doc_id: r for r in passages.repeats(docs, Scratch(spark, "t")).collect()}
    assert found[2].component_id == 1 and found[3].n_links == 0
    assert {r.component_id for r in simhash.classes(docs, Scratch(spark, "t")).collect()} == {1, 3}
    assert mixing.mix(docs, Scratch(spark, "t")).count() > 0
    assert {r.lang_pred for r in langid.predict(docs, langid.fit(docs)).collect()} == {"en", "de"}
    assert quality.score(docs, quality.fit(docs, spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int"))).count() == 3
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
    scratch = Scratch(spark, "t")
    assert {r.payload_bytes for r in warc.read(spark, warc.write(pages, scratch), scratch).collect()} == {len(text), 5}


def test_pipeline_keeps_clean_rows_whatever_their_ids(spark):
    long = " ".join(f"word{i}" for i in range(40))
    rows = [(7, f"one {long}", "en", "s", 1), (7, f"two other {long[::-1]}", "en", "s", 1), (None, "three " + " ".join(f"else{i}" for i in range(50)), "en", "s", 1), (None, None, "en", "s", 1), (9, f"one {long}", "en", None, 1)]
    docs = spark.createDataFrame(rows, DOCS)
    kept = corpus_pipeline.one_of_a_kind(spark, docs, DATA)
    assert sorted((str(r.doc_id), (r.text or "")[:5]) for r in kept.collect()) == [("7", "one w"), ("7", "two o"), ("None", ""), ("None", "three")]
    for stage in (corpus_pipeline.no_benchmarks, corpus_pipeline.no_secrets):
        out = stage(spark, kept, DATA)
        assert out.columns == docs.columns and sorted(str(r.text) for r in out.collect()) == sorted(str(r.text) for r in kept.collect())


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def __init__(self, master):
            self.master = master

        def get(self, key, default=None):
            return self.master if key == "spark.master" else default

        def set(self, key, value):
            self.made = value

    class Session:
        def __init__(self, master):
            self.conf = Conf(master)

    for master in ("spark://x:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            common.Scratch(Session(master), "t")
    assert common.Scratch(Session("local[4]"), "t").path
