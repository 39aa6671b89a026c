"""Language identification with interpolated Kneser-Ney character models.

Texts are lower-cased, runs of anything but letters become one blank. For every order
up to ORDER and every language, counts (continuation counts below the highest order)
are discounted and interpolated down to a uniform distribution. What is kept is, by
order, one sorted array of n-gram hashes with a directory of their leading bits, and a
row of log probabilities, one a language, beside each; likewise weights of contexts for
n-grams that no language has. The language with the lowest cross-entropy per character
is chosen. A softmax over the cross-entropies, its slope chosen on documents kept from
the counts, gives the score; texts whose best cross-entropy is above a high quantile
of those documents' are marked as rejected.

The models are fitted on a bounded sample, about max_rows rows a language (a documented
parameter), so they have a bounded size and are broadcast. Every text is scored whole,
in pieces.

Nulls: a null text, or one without a letter, is `und` with score 0. Rows with a null
language are never learned from. Without any labelled row all predictions are `und`.
Repeated rows each get a row. An empty table gives an empty result. Columns of any name
are carried along; lang_pred, score and rejected are replaced. Of languages that tie the
first by name is chosen. A very long text is scored in pieces of PIECE characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import unused, widened

ORDER, MAX_ROWS, PIECE, REJECT = 4, 400, 1 << 20, 0.995
TOP = (1 << 63) - 1  # the largest hash that a draw compares
U = np.uint64
_P, _Q = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9)  # odd multipliers of a well-known mixer


def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


_TABLE: list[np.ndarray] = []


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' characters one after the other, each text led by ORDER - 1 blanks and ended by one, and the text of each character."""
    if not _TABLE:
        _TABLE.append(_letters())
    parts = [np.frombuffer(f"{' ' * ORDER}{t.lower()} ".encode("utf-32-le", "replace"), np.uint32) for t in texts]
    sizes = np.array([len(p) for p in parts])
    c = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    of = np.repeat(np.arange(len(parts)), sizes)
    letter = _TABLE[0][c]
    first = np.zeros(len(c), bool)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(int) if len(parts) else np.zeros(0, int)
    for k in range(ORDER - 1):
        first[starts + k] = True
    keep = letter | first
    keep[1:] |= letter[:-1]  # the first of a run of others stands for it
    c = np.where(letter, c, np.uint32(32))
    return c[keep], of[keep]


def hashes(c: np.ndarray, order: int) -> np.ndarray:
    """Of the n-gram that ends at each character from the order-th on."""
    h = np.full(max(len(c) - order + 1, 0), U(order))
    for j in range(order):
        h = h * _P + c[j : len(c) - order + 1 + j].astype(U) + U(1)
    h ^= h >> U(29)
    h *= _Q
    return h ^ (h >> U(32))


class Index:
    """A sorted hash array, found by the leading bits of the hash."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(1, int(len(keys)).bit_length())
        edges = np.searchsorted(keys >> U(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=U))
        self.edges = edges.astype(np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        top = (h >> U(64 - self.bits)).astype(np.int64)
        at, end = self.edges[top], self.edges[top + 1]
        out = np.full(len(h), -1, np.int32)
        on = np.nonzero(at < end)[0]
        at = at[on]
        while len(on):
            hit = self.keys[at] == h[on]
            out[on[hit]] = at[hit]
            at = at + 1
            more = ~hit & (at < end[on])
            on, at = on[more], at[more]
        return out


class Model:
    def __init__(self, langs: list[str], slope: float = 1.0, limit: float = np.inf):
        self.langs, self.slope, self.limit = langs, slope, limit
        self.grams: dict[int, tuple[Index, np.ndarray]] = {}  # order: log probabilities
        self.backs: dict[int, tuple[Index, np.ndarray]] = {}  # order: log weights of contexts one shorter
        self.floor = 0.0

    def log_prob(self, c: np.ndarray, at: np.ndarray, order: int, by: dict[int, np.ndarray]) -> np.ndarray:
        """Rows of log probabilities of the characters at these places, after up to order - 1 before. by: hashes by order."""
        if not order:
            return np.full((len(at), len(self.langs)), self.floor, np.float32)
        index, rows = self.grams[order]
        got = index.find(by[order][at - order + 1])
        out = rows[got]
        miss = np.nonzero(got < 0)[0]
        if len(miss):
            out[miss] = self.log_prob(c, at[miss], order - 1, by) + self.back(at[miss], order, by)
        return out

    def back(self, at: np.ndarray, order: int, by: dict[int, np.ndarray]) -> np.ndarray:
        index, rows = self.backs[order]
        got = index.find(by[order - 1][at - order + 1]) if order > 1 else np.zeros(len(at), np.int32)
        return np.where(got[:, None] >= 0, rows[got], np.float32(0))

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character, texts by languages, and the number of characters scored."""
        total, n = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        group: list[int] = []
        size = 0
        for i, t in enumerate(texts):
            group.append(i)
            size += len(t)
            if size >= PIECE or i == len(texts) - 1:
                c, of = characters([texts[j] for j in group])
                for a in range(0, len(c), PIECE):
                    lead = min(a, ORDER - 1)
                    part, own = c[a - lead : a + PIECE], of[a - lead : a + PIECE]
                    by = {k: hashes(part, k) for k in range(1, ORDER + 1)}
                    at = np.arange(ORDER - 1, len(part))
                    at = at[own[at] == own[at - ORDER + 1]]
                    p = self.log_prob(part, at, ORDER, by)
                    for k in range(len(self.langs)):
                        total[group, k] -= np.bincount(own[at], weights=p[:, k], minlength=len(group))
                    n[group] += np.bincount(own[at], minlength=len(group))
                group, size = [], 0
        return total / np.maximum(n, 1)[:, None], n

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether it is rejected."""
        has = np.array([t is not None and any(map(str.isalpha, t)) for t in texts], bool)
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), ~has
        h, _ = self.entropies([t if ok else "" for t, ok in zip(texts, has)])
        best = h.argmin(axis=1)
        z = np.exp(-self.slope * (h - h.min(axis=1, keepdims=True)))
        score = np.where(has, 1 / z.sum(axis=1), 0.0)
        return [self.langs[b] if ok else "und" for b, ok in zip(best, has)], score, ~has | (h.min(axis=1) > self.limit)


def _order(seqs: list[tuple[np.ndarray, np.ndarray]], order: int) -> list[dict[str, np.ndarray]]:
    """By language: the distinct n-grams' hashes, counts, and hashes of their contexts and endings. None reaches from one text into the next."""
    out = []
    for c, of in seqs:
        h = hashes(c, order)
        inside = np.nonzero(of[order - 1 :] == of[: len(h)])[0]
        keys, first, n = np.unique(h[inside], return_index=True, return_counts=True)
        first = inside[first]
        short = hashes(c, order - 1) if order > 1 else np.zeros(len(c) + 1, U)
        out.append({"keys": keys, "n": n, "context": short[first], "ending": short[first + 1]})
    return out


def train(texts: dict[str, list[str]]) -> Model:
    langs = sorted(texts)
    model = Model(langs)
    if not langs:
        return model
    seqs = [characters(texts[name]) for name in langs]
    model.floor = float(-np.log(len(np.unique(np.concatenate([c for c, _ in seqs]))) + 1))
    orders = {k: _order(seqs, k) for k in range(1, ORDER + 1)}
    for k in range(1, ORDER + 1):
        stats = []
        for j in range(len(langs)):
            g = orders[k][j]
            if k < ORDER:  # continuation counts: how many characters come before
                ends, n = np.unique(orders[k + 1][j]["ending"], return_counts=True)
                at = np.minimum(np.searchsorted(ends, g["keys"]), len(ends) - 1)
                a = np.where(ends[at] == g["keys"], n[at], 1).astype(float) if len(ends) else np.ones(len(g["keys"]))
            else:
                a = g["n"].astype(float)
            n1, n2 = (a == 1).sum(), (a == 2).sum()
            d = n1 / (n1 + 2 * n2) if n1 else 0.5
            contexts, of = np.unique(g["context"], return_inverse=True)
            total = np.bincount(of, weights=a)
            stats.append((g, np.maximum(a - d, 0) / total[of], contexts, d * np.bincount(of) / total))
        contexts = np.unique(np.concatenate([s[2] for s in stats]))
        back = np.zeros((len(contexts), len(langs)), np.float32)
        for j, (*_, own, weight) in enumerate(stats):
            back[np.searchsorted(contexts, own), j] = np.log(weight)
        model.backs[k] = (Index(contexts), back)
        keys, first = np.unique(np.concatenate([s[0]["keys"] for s in stats]), return_index=True)
        context = np.concatenate([s[0]["context"] for s in stats])[first]
        ending = np.concatenate([s[0]["ending"] for s in stats])[first]
        weights = back[np.searchsorted(contexts, context)]
        lower = np.full((len(keys), len(langs)), model.floor, np.float32) if k == 1 else _lower(model, k - 1, ending)
        p = np.exp(lower.astype(float) + weights)
        for j, s in enumerate(stats):
            p[np.searchsorted(keys, s[0]["keys"]), j] += s[1]
        model.grams[k] = (Index(keys), np.log(p).astype(np.float32))
    return model


def _lower(model: Model, order: int, ending: np.ndarray) -> np.ndarray:
    index, rows = model.grams[order]
    got = index.find(ending)
    return np.where(got[:, None] >= 0, rows[got], np.float32(model.floor))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", max_rows: int = MAX_ROWS) -> Model:
    """From about max_rows rows a language, drawn by a hash, one at least; a fifth of them calibrate, unless a language has no others."""
    rows = docs.where(docs[lang].isNotNull() & docs[text].isNotNull())
    rows = rows.select(rows[lang].alias("lang"), rows[text].alias("text"), F.xxhash64(F.lit(1), rows[doc_id]).bitwiseAND(F.lit(TOP)).alias("draw"), (F.pmod(F.xxhash64(F.lit(2), rows[doc_id]), F.lit(5)) == 0).alias("held"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("draw").alias("least")).collect()
    if not counts:
        return Model([])
    share = F.create_map(*[F.lit(x) for r in counts for x in (r.lang, max(min(max_rows * (TOP + 1) // r.n, TOP), r.least))])
    rank = F.row_number().over(W.partitionBy("lang").orderBy("draw"))  # bounds what repeated ids draw at once
    picked = rows.where(F.col("draw") <= share[F.col("lang")]).withColumn("rank", rank).where(F.col("rank") <= 4 * max_rows).toPandas()
    picked["held"] &= picked["lang"].isin(picked.loc[~picked["held"], "lang"])
    model = train({k: g["text"].tolist() for k, g in picked[~picked["held"]].groupby("lang")})
    test = picked[picked["held"]] if picked["held"].any() else picked
    h, n = model.entropies(test["text"].tolist())
    want = np.array([model.langs.index(x) for x in test["lang"]])
    losses = {}
    for slope in 2.0 ** np.arange(0, 9):
        z = -slope * (h - h.min(axis=1, keepdims=True))
        losses[slope] = float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(want)), want]).mean())
    model.slope = min(losses, key=losses.get)
    model.limit = float(np.quantile(h[n > 0].min(axis=1), REJECT)) if (n > 0).any() else np.inf
    return model


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents with lang_pred, score and rejected (columns of these names are replaced)."""
    base = docs.drop("lang_pred", "score", "rejected")
    names = base.columns
    shared = base.sparkSession.sparkContext.broadcast(model)  # bounded by the sample's size
    schema = widened(base, lang_pred="string", score="double", rejected="boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score, rejected = shared.value.predict(b.column(len(names)).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], schema=pa.schema([*list(b.schema)[:-1], ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())]))

    return base.select(*[base[c] for c in names], base[text].alias(unused(base, "text_"))).mapInArrow(run, schema)
