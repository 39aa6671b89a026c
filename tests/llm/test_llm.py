"""The operators against brute force, and on nulls, empty and repeated rows, empty tables, clashing names."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clipweave.llm import decontaminate, eliasfano, langid, lm, mixing, passages, quality, queries, secrets, simhash, topk, warc
from clipweave.llm.common import Scratch, table
from clipweave.llm.components import components

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


ODD = [(1, None, "b"), (2, "", None), (3, "one", "b"), (3, "one", "b"), (None, "Two words", "é"), (5, "x " * 3000, "b"), (6, "\n\t ", "a")]


def pandas(spark, name):
    return table(spark, DATA, name).toPandas()


def brute_hits(text, items):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    ws = pattern.findall(lower(text or ""))
    hit, found = set(), set()
    for item, t in items:
        v = pattern.findall(lower(t or ""))
        n = min(len(v), 13)
        wins = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else set()
        for i in range(len(ws) - n + 1 if n else 0):
            if tuple(ws[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(ws), hit, sorted(found)


def test_decontamination(spark):
    item = " ".join(f"w{i}" for i in range(20))
    items = [(1, item), (2, "Short Item"), (3, ""), (4, None), (10, " ".join(item.split()[:13]))]
    rows = [*ODD, (7, f"a b {item.upper()}! c", "a"), (8, "x short, item y", "a"), (9, " ".join(item.split()[:12]), "a")]
    docs = documents(spark, rows).withColumn("hits", F.lit("mine"))
    got = decontaminate.scan(docs, spark.createDataFrame(items, "item_id long, text string"), Scratch(spark, "t"))
    want = sorted((str(i), n, sorted(h), f) for i, (n, h, f) in ((i, brute_hits(t, items)) for i, t, _ in rows))
    assert sorted((str(r.doc_id), r.n_words, r.hits, r["items"]) for r in got.collect()) == want
    clean = {r.doc_id: r.text for r in decontaminate.clean(documents(spark, [*rows, (11, "z " * 100 + item + " end.", "a")]), spark.createDataFrame(items, "item_id long, text string"), Scratch(spark, "t")).collect()}
    assert 7 not in clean and clean[6] == "\n\t " and 11 not in clean
    assert decontaminate.scan(docs.limit(0), spark.createDataFrame(items, "item_id long, text string"), Scratch(spark, "t")).count() == 0
    assert decontaminate.scan(docs, spark.createDataFrame([], "item_id long, text string"), Scratch(spark, "t")).where(F.size("hits") > 0).count() == 0


def test_decontamination_of_letters_beyond_ascii(spark):
    items = [(1, "ΟΔΟΣ"), (2, "straße İST \u212Aelvin"), (3, "Éa éb")]
    rows = [(k, t, "a") for k, t in enumerate(["ΟΔΟΣ'Α x", "ΟΔΟΣ", "οδος", "STRAßE İst \u212AELVIN", "straße ist kelvin", "éa éb, ÉA éb", "Éa;éb"])]
    got = decontaminate.scan(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string"), Scratch(spark, "t")).collect()
    assert {r.doc_id: (r.n_words, set(r.hits), r["items"]) for r in got} == {i: brute_hits(t, items) for i, t, _ in rows}


def test_lesser_hits_are_cut_out(spark):
    item = " ".join(f"w{i}" for i in range(13))
    docs = documents(spark, [(1, "z, " * 400 + item + "; end.", "a")])
    got = decontaminate.clean(docs, spark.createDataFrame([(1, item)], "item_id long, text string"), Scratch(spark, "t")).first()
    assert got.text == ("z, " * 400).rstrip(", ") + "; end."


@pytest.mark.parametrize(("text", "want"), [("token=abc", []), ("Password: 'abcdefgh1'", [("assign", 0, 20)]), ("token=token:longvalue123", []), ("é AKIA" + "A" * 12, [("access", 2, 18)]), ("AKIAAKIA", []), ("0" * 31, []), ("x" + "a1" * 16 + "g", [("hex", 1, 33)]), ("ſecret=abcdefgh1", []), ("secret=" + "a" * 32, [("assign", 0, 39), ("hex", 7, 39)])])
def test_secret_rules(text, want):
    assert secrets.find(text) == want


def test_secret_ledger_scans_each_blob_once(spark):
    rows = [*ODD, (7, "token=abcdefgh", "a"), (8, "token=abcdefgh", "a")]
    ledger = secrets.Ledger(spark, Scratch(spark, "t").path)
    got = {str(r.doc_id): [tuple(f) for f in r.findings] for r in secrets.scan(documents(spark, rows).withColumn("blob", F.lit(1)), ledger).collect()}
    assert got["7"] == got["8"] == [("assign", 0, 14)] and got["1"] == []
    first = ledger.blobs().count()
    assert first == len({t or "" for _, t, _ in rows})
    again = secrets.scan(documents(spark, [*rows, (9, "new AKIA" + "B" * 16, "a")]), ledger)
    assert again.count() == len(rows) + 1 and ledger.blobs().count() == first + 1
    secrets.scan(documents(spark, rows), ledger, rules="2")
    assert ledger.blobs().count() == 2 * first + 1
    assert [r.text for r in secrets.redacted(documents(spark, rows[-1:]), secrets.Ledger(spark, Scratch(spark, "t").path)).collect()] == ["[secret]"]


def test_secret_filter_keeps_all_that_match(spark):
    texts = pandas(spark, "documents").text.tolist()
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", secrets.suspicious(F.col("t")).alias("s")).collect():
        assert r.s or not secrets.find(r.t)


def test_warc_round_trip_with_magic_inside(spark):
    forged = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    pages = [(1, "u", "<p>é</p>"), (2, "u", None), (3, "u", "x" + forged + "y"), (4, "u", "x" + forged + "y"), (5, None, "WARC/1.1\r\n"), (6, "a\r\nb", forged), (7, "u", forged + forged), (None, "u", "<p>é</p>"), (8, "u", ""), (8, "u", "")]
    scratch = Scratch(spark, "t")
    got = warc.read(spark, warc.write(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), scratch), scratch).collect()
    most = {}
    for i, _, h in pages:
        most[h or ""] = max(most.get(h or "", 0), i or 0)
    want = []
    for i, _, h in pages:
        raw = (h or "").encode()
        first = i == most[h or ""]
        want.append((str(i), len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if first else "revisit", None if first else most[h or ""]))
    assert sorted(map(repr, want)) == sorted(repr((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got)
    scratch = Scratch(spark, "t")
    assert warc.read(spark, warc.write(spark.createDataFrame([], "page_id long, url string, html string"), scratch), scratch).count() == 0


def test_warc_small_payloads_are_all_responses(spark):
    scratch = Scratch(spark, "t")
    path = warc.write(spark.createDataFrame([(1, "u", "abc"), (2, "u", "abc")], "page_id long, url string, html string"), scratch, min_bytes=10)
    assert [r.record_type for r in warc.read(spark, path, scratch).collect()] == ["response"] * 2


@pytest.mark.parametrize(("n", "segment"), [(3, 8), (300, 8), (300, 16), (40, 32)])
def test_topk_is_exact(spark, n, segment):
    rng = np.random.default_rng(n + segment)
    signs = rng.integers(0, 2, (n, 64)) * rng.integers(0, 2, (n, 64))
    signs[n // 2 :] = signs[0] ^ (rng.random((n - n // 2, 64)) < 0.05)  # many near each other, and equal ones
    rows = [(int(i), [float(2 * x - 1) for x in v]) for i, v in enumerate(signs)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    got = {}
    for r in topk.search(df, df.where("id % 7 = 0"), 5, segment=segment).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.distance, r.neighbour_id))
    d = (signs[:, None] != signs[None]).sum(axis=2)
    for q in range(0, n, 7):
        want = sorted((int(d[q, i]), i) for i in range(n) if i != q)[:5]
        assert [x[1:] for x in sorted(got.get(q, []))] == want


def test_topk_on_odd_rows(spark):
    rows = [(i, [1.0 if (i >> b) & 1 else -1.0 for b in range(64)]) for i in range(100)] + [(200, [1.0]), (201, None), (None, [1.0] * 64), (5, [1.0 if (5 >> b) & 1 else -1.0 for b in range(64)])]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    got = topk.search(df, df.where("id % 50 = 0"), 10).collect()
    for q in (0, 50):
        want = sorted(((i ^ q).bit_count(), i) for i in range(100) if i != q)[:10]
        assert [(r.distance, r.neighbour_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == want
    assert topk.search(df.limit(0), df.limit(0), 10).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, (1 << 64) - 1), max_size=200), st.lists(st.integers(0, (1 << 64) - 1), max_size=20))
def test_elias_fano(values, asked):
    v = np.array(sorted(set(values)), np.uint64)
    e = eliasfano.EliasFano(eliasfano.EliasFano.build(v, 1 << 64))
    assert (e.get(np.arange(len(v))) == v).all()
    want = [int(np.searchsorted(v, np.uint64(x))) if x in set(values) else -1 for x in [*asked, *values]]
    assert e.find(np.array([*asked, *values], np.uint64)).tolist() == want


@pytest.mark.parametrize("order", [2, 3])
def test_language_model(spark, order):
    rows = [(k, f"the cat {k % 5} sat\non THE mat {k % 3}", "a") for k in range(40)] + ODD
    docs = documents(spark, rows).select("doc_id", "text").withColumn("score", F.lit("mine"))
    train = docs.where("doc_id IS NULL OR doc_id % 4 <> 1")
    got = lm.score(docs, lm.fit(train, Scratch(spark, "t"), parts=3, order=order)).collect()
    tok = lambda t: (t or "").encode().lower().split() + [b"\n"]
    one, two, three = Counter(), Counter(), Counter()
    for i, t, _ in rows:
        if i is None or i % 4 != 1:
            x = tok(t)
            one.update(x)
            two.update(zip([b"\n", *x], x))
            three.update(zip([b"\n", *x], x, x[1:]))
    n, v = sum(one.values()), len(one)
    after, later = Counter(a for a, _ in two), Counter((u, a) for u, a, _ in three)
    p1 = lambda w: (one[w] + 1) / (n + v + 1)
    assert len(got) == len(rows)
    for r in got:
        x = tok(r.text)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(x), sum(one[w] > 0 for w in x), n)
        assert math.isclose(r.base_score, sum(math.log10(p1(w)) for w in x), abs_tol=1e-9)
        p2 = lambda a, w: max(two[a, w] - 0.75, 0) / one[a] + 0.75 * after[a] / one[a] * p1(w) if one[a] else p1(w)
        p3 = lambda u, a, w: max(three[u, a, w] - 0.75, 0) / two[u, a] + 0.75 * later[u, a] / two[u, a] * p2(a, w) if two[u, a] else p2(a, w)
        want = sum(math.log10(p2(a, w)) for a, w in zip([b"\n", *x], x))
        if order == 3:
            want = math.log10(p2(b"\n", x[0])) + sum(math.log10(p3(*t)) for t in zip([b"\n", *x], x, x[1:]))
        assert abs(r.score - want) < 1e-3 * len(x)
    empty = lm.fit(docs.limit(0), Scratch(spark, "t"))
    assert {r.n_known for r in lm.score(docs, empty).collect()} == {0}
    assert lm.score(docs.limit(0), empty).count() == 0


def test_mixing_targets():
    assert mixing.targets([100, 10, 100]) == [145.0, 20.0, 150.0] or sum(mixing.targets([100, 10, 100])) == pytest.approx(315)
    t = mixing.targets([1000, 10, 10])
    assert t[1] == 20 and t[2] == 20 and sum(t) == pytest.approx(1530)
    assert mixing.targets([]) == []


def test_mixing(spark):
    rng = np.random.default_rng(1)
    rows = [(k, " ".join(["w"] * int(rng.integers(1, 60))), f"s{k % 7}" if k % 3 else "s0") for k in range(3000)] + ODD
    docs = documents(spark, rows).withColumn("target", F.lit("mine"))
    draws = [{(r.doc_id, r.text): (r["size"], r.target, tuple(r.shards), r.source) for r in mixing.draw(d, Scratch(spark, "t"), block_docs=16, shard_words=5000).collect()} for d in (docs, docs.repartition(7))]
    assert draws[0] == draws[1]
    taken, goal = Counter(), {}
    for (_, t), (size, target, shards, source) in draws[0].items():
        assert size == len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) and len(shards) <= 2
        taken[source] += size * len(shards)
        goal[source] = target
    for s in (f"s{k}" for k in range(7)):
        assert abs(taken[s] - goal[s]) <= 60
    assert max(x for v in draws[0].values() for x in v[2]) > 0
    mix = mixing.mix(documents(spark, rows), Scratch(spark, "t"), block_docs=16, shard_words=5000)
    assert mix.count() == sum(r["n"] for r in mixing.draw(documents(spark, rows), Scratch(spark, "t"), block_docs=16, shard_words=5000).select(F.size("shards").alias("n")).collect())
    assert mixing.draw(docs.limit(0), Scratch(spark, "t")).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(spark, edges, Scratch(spark, "t")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def brute_fingerprint(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    sh = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] if len(ws) >= 3 else [" ".join(ws)] if ws else []
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


@pytest.mark.parametrize("block", [(2, 2), (64, 16)])
def test_simhash(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    base = "one two three four five six seven eight nine ten"
    rows = [(10 + k, f"{base} {k % 3}" + " tail" * (k % 4), "a") for k in range(12)] + ODD + [(None, "", "a")]
    got = simhash.classes(documents(spark, rows).withColumn("fp", F.lit(0)), Scratch(spark, "t")).collect()
    fps = {t: brute_fingerprint(t) for _, t, _ in rows}
    group = list(range(len(rows)))
    for _ in rows:
        for i, (_, a, _) in enumerate(rows):
            for j, (_, b, _) in enumerate(rows):
                if (fps[a] ^ fps[b]).bit_count() <= 2:
                    group[i] = group[j] = min(group[i], group[j])
    least = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            least[group[k]] = min(least.get(group[k], i), i)
    want = sorted((str(i), simhash.signed(fps[t]), least.get(group[k])) for k, (i, t, _) in enumerate(rows))
    assert sorted((str(r.doc_id), r.fp, r.component_id) for r in got) == want
    assert simhash.classes(documents(spark, []), Scratch(spark, "t")).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.text(max_size=80))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode("utf-8", "replace")) == brute_fingerprint(text.encode("utf-8", "replace").decode())


def test_language_identification(spark):
    rows = [(k, {"en": "the cat and the dog were there with him", "de": "der hund und die katze waren nicht bei ihm"}[g] + f" {k}", g) for k in range(60) for g in ("en", "de")]
    docs = spark.createDataFrame(rows + [(900, None, "en"), (901, "123 !!", None), (902, "", "de"), (903, "der hund", None)], "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    got = langid.predict(docs, langid.fit(docs)).collect()
    for r in got:
        if r.text and re.search("[a-z]", r.text):
            assert r.lang_pred == ("de" if "hund" in r.text else "en") and 0.5 < r.score <= 1
        else:
            assert r.lang_pred == "und" and r.score == 0 and r.rejected
    assert {r.lang_pred for r in langid.predict(docs, langid.fit(docs.limit(0))).collect()} == {"und"}


def test_language_models_are_distributions():
    model = langid.train({"a": ["abab abba"] * 3, "b": ["baba cab"] * 3})
    c, _ = langid.characters(["abc"])
    for last in ([97, 98], [99, 32]):
        total = np.zeros(2)
        for x in (32, 97, 98, 99):
            seq = np.array([32, *last, x], np.uint32)
            by = {k: langid.hashes(seq, k) for k in range(1, langid.ORDER + 1)}
            total += np.exp(model.log_prob(seq, np.array([3]), langid.ORDER, by)[0])
        assert (total <= 1.001).all() and (total > 0.7).all()  # the rest is left to unseen characters


def test_quality(spark):
    rng = np.random.default_rng(0)
    words = ["alpha", "beta", "gamma", "delta", "of", "the"]
    good = [(k, " ".join(rng.choice(words, 50)) + ".", 1) for k in range(80)]
    bad = [(100 + k, "BUY!! " * 30, 0) for k in range(40)]
    docs = spark.createDataFrame([(i, t, "mine") for i, t, _ in good + bad] + [(900, None, ""), (901, "", ""), (901, "", "")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in good + bad] + [(900, None), (None, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    assert np.mean([got[i].predicted == y for i, _, y in good + bad]) > 0.95
    assert got[900].score == got[901].score and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert {r.score for r in quality.score(docs, quality.fit(docs, labels.limit(0))).collect()} == {0.5}


def test_passages(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    sentence = lambda: " ".join(word() for _ in range(9)).capitalize() + "."
    text = lambda n: " ".join(sentence() for _ in range(n))
    shared, near = text(7), text(8)
    changed = near.split()
    changed[36] = "other"
    docs = documents(spark, [(1, f"{text(5)}\n{text(3)} {shared} {text(2)}", "a"), (2, f"{text(4)} {shared}", "a"), (3, f"{text(9)}\n{near}\n{text(2)}", "a"), (4, f"{' '.join(changed)}\n{text(6)}", "a"), (7, text(20), "a"), (8, f"{text(3)} short line here.\nshort line here.", "a"), *ODD])
    got = {r.doc_id: r for r in passages.repeats(docs, Scratch(spark, "t")).collect() if r.doc_id is not None}
    assert (got[1].component_id, got[2].component_id, got[3].component_id, got[4].component_id) == (1, 1, 3, 3)
    assert got[7].n_links == got[8].n_links == 0 and got[1].n_remove == 0
    cut = [w for s in got[2].remove for w in lower(docs.where("doc_id = 2").first().text).split()[s["at"] : s["to"]]]
    assert " ".join(cut) == shared.lower()
    assert got[3].n_remove == 0 and got[4].n_remove == 1
    assert passages.repeats(docs, Scratch(spark, "t")).count() == 13
    assert passages.repeats(docs.limit(0), Scratch(spark, "t")).count() == 0


@pytest.mark.parametrize("run", ["many", "ab", "a"])
def test_any_run_of_fifty_words_holds_a_window(run):
    rng = np.random.default_rng(8)
    words = lambda n: [f"w{i}" for i in rng.integers(0, 500, n)]
    for _ in range(60):
        inner = words(passages.RUN) if run == "many" else (list(run) * passages.RUN)[: passages.RUN]
        texts = [" ".join(words(int(rng.integers(0, 60))) + inner + words(int(rng.integers(0, 60)))) for _ in range(3)]
        t = passages.Tokens(texts)
        a, b = passages._winnowed(t)
        own = np.searchsorted(t.docs, a, side="right") - 1
        assert (b <= t.docs[own + 1]).all()
        found = [set(t.hash(a, b)[own == k]) for k in range(3)]
        assert found[0] & found[1] and found[1] & found[2] and found[0] & found[2]
    for texts in ([""], ["a b"], ["", " ".join(["a"] * 49), ""]):
        assert not len(passages._winnowed(passages.Tokens(texts))[0])


def test_large_buckets_connect_like_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(passages, "CHUNK", 8)
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 30, 40).tolist()
    sets = []
    for k in range(60):
        s = set(base)
        for _ in range(int(rng.integers(0, 5))):
            s.discard(base[int(rng.integers(0, 40))])
            s.add(int(rng.integers(0, 1 << 30)))
        sets.append(sorted(s))
    lines = spark.createDataFrame([(k, [1], s) for k, s in enumerate(sets)], "content long, bands array<long>, shingles array<int>")
    edges = passages.similar_lines(lines.select("content", "bands"), lines.select("content", "shingles"), Scratch(spark, "t"))
    got = {r.node: r.root for r in components(spark, edges, Scratch(spark, "t")).collect()}
    label = list(range(60))
    for _ in range(60):
        for i in range(60):
            for j in range(60):
                a, b = set(sets[i]), set(sets[j])
                if 5 * len(a & b) >= 4 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    assert {k: label[k] for k in range(60) if label.count(label[k]) > 1} == got


def test_held_out_rule(spark):
    for r in queries.op5_lm(spark, DATA).select("doc_id", "held_out").collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equal_to_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    got = queries.QUERIES[name](spark, DATA)
    want = c.execute(queries.SQL[name])
    at = [[x[0] for x in want.description].index(k) for k in got.columns]
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(repr(tuple(r[k] for k in at)) for r in want.fetchall())


def test_pipeline_stages(spark):
    import corpus_pipeline

    scratch, docs = Scratch(spark, "t"), table(spark, DATA, "documents")
    before = {r.doc_id: r.text for r in docs.collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        new = scratch.save(stage(spark, docs, DATA), str(k))
        assert set(docs.columns) <= set(new.columns)
        assert {r.doc_id for r in new.select("doc_id").collect()} <= set(before)
        docs = new
    items = [(r.item_id, r.text) for r in table(spark, DATA, "benchmark").collect()]
    for r in docs.collect():
        assert not brute_hits(r.text, items)[1] and not secrets.find(r.text)


def test_pipeline_equals_brute_force(spark):
    import corpus_pipeline

    docs = pandas(spark, "documents")
    held = [zlib.crc32(str(i).encode()) % 4 == 2 for i in docs.doc_id]
    learned = table(spark, DATA, "documents").where(F.col("doc_id").isin(docs.doc_id[~np.array(held)].tolist()))
    model = quality.fit(learned, table(spark, DATA, "labels"))
    kept = {i: t for i, t in zip(docs.doc_id.tolist(), docs.text) if model.score(quality.features(t)[None])[0] >= quality.CUT}
    ids, fps = sorted(kept), {i: brute_fingerprint(t) for i, t in kept.items()}
    least = {i: i for i in ids}
    changed = True
    while changed:
        new = {i: min(least[j] for j in ids if (fps[i] ^ fps[j]).bit_count() <= 2) for i in ids}
        changed, least = new != least, new
    items = [(r.item_id, r.text) for r in table(spark, DATA, "benchmark").collect()]
    want = {}
    for i in ids:
        if least[i] == i:
            n, hit, _ = brute_hits(kept[i], items)
            if not hit or 20 * len(hit) < n:
                pieces = re.findall(f"{decontaminate.PIECE}|{decontaminate.TAIL}", kept[i])
                text = "".join(p for k, p in enumerate(pieces) if k not in hit) if hit else kept[i]
                want[i] = secrets.redact(text, [{"start": a, "end": b} for _, a, b in secrets.find(text)])
    source = dict(zip(docs.doc_id.tolist(), docs.source))
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in want.items()}
    total = Counter()
    for i in want:
        total[source[i]] += sizes[i]
    goal = dict(zip(sorted(total), mixing.targets([total[s] for s in sorted(total)])))
    got = corpus_pipeline.run(spark, DATA).collect()
    assert len({(r.doc_id, r.copy) for r in got}) == len(got) and max(r.copy for r in got) < 2
    assert all(r.text == want[r.doc_id] and r.n_chars == len(r.text) for r in got)
    taken = Counter()
    for r in got:
        taken[r.source] += sizes[r.doc_id]
    smallest = {s: min((sizes[i] for i in want if source[i] == s and sizes[i]), default=0) for s in goal}
    largest = {s: max((sizes[i] for i in want if source[i] == s), default=0) for s in goal}
    for s, g in goal.items():
        assert smallest[s] - largest[s] <= taken[s] - g <= smallest[s]


def test_pipeline_on_odd_rows(spark):
    import corpus_pipeline

    docs = documents(spark, ODD)
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs, DATA).count() <= 2 * len(ODD)
        assert stage(spark, docs.limit(0), DATA).count() == 0
