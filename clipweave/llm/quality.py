"""A quality classifier by Bradley-Terry ranking.

Documents are described by numbers of their whole texts (repetition, symbols, letter
case, lengths). Weights are learned from preference pairs, a document labelled 1 before
one labelled 0, by logistic loss on the difference of their features. The threshold is
the quantile of the training documents' scores that leaves as many below as are
labelled 0. A logistic curve through it gives scores from 0 to 1, the threshold at 0.7.

Labels are learned from a sample of about max_rows rows (a documented parameter); pairs
are drawn from it. All texts are scored.

Nulls: a null text is scored like an empty one. Rows with a null label are not learned
from. Without labels of both kinds every score is the share of label 1, or 0.5.
Repeated rows each get a row. An empty table gives an empty result. Columns of any name
are carried along; score and predicted are replaced. Equal texts have equal scores; a
label that repeats an id counts as often as it stands. A text is one row's work, and
its words are held in memory, about 150 bytes each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import unused, widened

MAX_ROWS, PAIRS, CUT = 20_000, 200_000, 0.7
FEATURES = 22


def features(text: str | None) -> np.ndarray:
    text = text or ""
    ws = text.split()
    n = len(ws)
    if not n:
        return np.zeros(FEATURES)
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    size = len(raw)
    c = np.bincount(raw, minlength=256)
    upper, lower, digit = c[65:91].sum(), c[97:123].sum(), c[48:58].sum()
    marks = c[33] + c[63]  # ! and ?
    symbols = c[35] + c[36] + c[37] + c[38] + c[42] + c[64] + c[94] + c[95] + c[126]
    bars = c[124] + c[60] + c[62] + c[91] + c[93] + c[123] + c[125]
    stops, commas = c[46], c[44]
    counts = Counter(ws)
    lens = np.fromiter(map(len, ws), np.int64, n)
    lines = [x for x in text.split("\n") if x.strip()]
    adjacent = sum(map(str.__eq__, ws, ws[1:]))
    triples = Counter(zip(ws, ws[1:], ws[2:]))
    caps = sum(w[0].isupper() for w in ws)
    whole = sum(map(str.isupper, ws))
    return np.array([
        np.log1p(n), np.log1p(len(lines)), lens.mean(), lens.std(), (lens <= 3).mean(), (lens >= 12).mean(),
        upper / max(upper + lower, 1), whole / n, caps / n, digit / size, marks / n, symbols / n, bars / n, stops / n, commas / n,
        len(counts) / n, max(counts.values()) / n, adjacent / n,
        1 - len(triples) / max(n - 2, 1) if n > 2 else 0.0,
        1 - len(set(lines)) / max(len(lines), 1), c[128:].sum() / size, float(n < 5),
    ])


class Model:
    def __init__(self, prior: float = 0.5):
        self.mean, self.scale, self.weights = np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES)
        self.slope, self.cut, self.prior = 0.0, 0.0, prior

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.slope:
            return np.full(len(x), self.prior)
        z = np.clip(self.slope * (self.raw(x) - self.cut), -30, 30)
        return 1 / (1 + np.exp(-z) * (1 - CUT) / CUT)


def train(x: np.ndarray, y: np.ndarray, seed: int = 3) -> Model:
    model = Model(float(y.mean()) if len(y) else 0.5)
    good, bad = np.nonzero(y == 1)[0], np.nonzero(y == 0)[0]
    if not len(good) or not len(bad):
        return model
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.clip((x - model.mean) / model.scale, -6, 6)
    rng = np.random.default_rng(seed)
    n = min(PAIRS, len(good) * len(bad))
    d = z[rng.choice(good, n)] - z[rng.choice(bad, n)]
    w = np.zeros(FEATURES)
    for _ in range(30):  # Newton steps of the pairwise logistic loss
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        grad = d.T @ (1 - p) / n - 1e-3 * w
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / n + 1e-3 * np.eye(FEATURES), grad)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    model.weights = w
    s = model.raw(x)
    model.cut = float(np.quantile(s, (y == 0).mean()))
    near = 1.0
    for _ in range(50):  # the slope that fits the labels best, the curve held at the threshold
        p = 1 / (1 + np.exp(-np.clip(near * (s - model.cut), -30, 30)) * (1 - CUT) / CUT)
        g, h = ((y - p) * (s - model.cut)).mean(), (p * (1 - p) * (s - model.cut) ** 2).mean() + 1e-9
        near = float(np.clip(near + np.clip(g / h, -0.5, 0.5), 0.05, 20))
    model.slope = near
    return model


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", max_rows: int = MAX_ROWS) -> Model:
    """From about max_rows labelled rows, drawn by a hash of the id."""
    known = labels.where(labels[label].isin(0, 1) & labels["doc_id"].isNotNull()).select(labels["doc_id"].alias("id"), labels[label].alias("y"))
    share = int(min(1.0, max_rows / max(known.count(), 1)) * (1 << 20))
    drawn = known.where(F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(1 << 20)) < share).limit(2 * max_rows)
    rows = docs.select(docs[doc_id].alias("id"), docs[text].alias("text")).join(F.broadcast(drawn), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t).tolist() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(x, pa.list_(pa.float64())), b.column("y").cast(pa.int32())], ["id", "x", "y"])

    kind = docs.schema[doc_id].dataType.simpleString()
    got = rows.mapInArrow(run, f"id {kind}, x array<double>, y int").limit(4 * max_rows).toPandas().sort_values("id", kind="stable")
    return train(np.array(got["x"].tolist()).reshape(-1, FEATURES), got["y"].to_numpy(float))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents with score and predicted (columns of these names are replaced)."""
    base = docs.drop("score", "predicted")
    names = base.columns
    schema = widened(base, score="double", predicted="int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t) for t in b.column(len(names)).to_pylist()]).reshape(-1, FEATURES)
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s), pa.array((s >= CUT).astype(np.int32))], schema=pa.schema([*list(b.schema)[:-1], ("score", pa.float64()), ("predicted", pa.int32())]))

    return base.select(*[base[c] for c in names], base[text].alias(unused(base, "text_"))).mapInArrow(run, schema)
