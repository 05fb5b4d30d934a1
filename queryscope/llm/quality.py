"""Quality classifier by Bradley-Terry pairwise ranking.

Every text has a vector of surface features: shares of letters, capitals, digits and symbols, word and line statistics,
repetition. A document's strength is linear in them; the chance that one document is preferred to another is the
logistic function of the difference of their strengths. Preference pairs (label 1 over label 0) train the weights by
logistic loss on feature differences, with Newton steps. The cut is a quantile of the training strengths: the share of
label 0. The score is a logistic curve through ``THRESHOLD`` at the cut, so ``score >= THRESHOLD`` is the same as being
above the quantile; its slope is the one that fits the labels best.

The model is fitted on a bounded sample: about ``SAMPLE_ROWS`` labelled rows, picked by a hash of the id, and
``PAIRS_PER_DOC`` partners per document. Features of whole texts are computed on Spark; only the sample's vectors reach the
driver.

Defined cases: null counts as the empty text, which has a score like any other; without labels of both kinds the
strength is 0 and the score is the share of label 1 (0.5 without labels); rows without label teach nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from queryscope.llm.common import bounded_sample, lean, replace_columns, texts_of, type_of
from queryscope.session import cut

#: labelled rows that the model is fitted on, at most about
SAMPLE_ROWS = 20_000
PAIRS_PER_DOC = 12
#: pairs whose differences are held at once while the model is fitted
BLOCK = 4096
THRESHOLD = 0.3

_SYMBOLS = [b for b in range(0x21, 0x7F) if not chr(b).isalnum()]


def features(text: str) -> np.ndarray:
    """Feature vector of a whole text."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    counts = np.bincount(raw, minlength=256).astype(float)
    words = text.split()
    lines = text.split("\n")
    n, m = max(1, len(raw)), max(1, len(words))
    distinct = len(set(words))
    again = sum(map(str.__eq__, words, words[1:]))
    symbols = counts[_SYMBOLS]
    upper, lower = counts[0x41:0x5B].sum(), counts[0x61:0x7B].sum()
    joined = len(text) - text.count(" ")
    head = [
        1.0 if words else 0.0,
        np.log1p(len(words)),
        upper / n,
        upper / max(1.0, upper + lower),
        counts[0x30:0x3A].sum() / n,
        counts[0x80:].sum() / n,
        symbols.sum() / n,
        symbols.sum() / m,
        joined / m / 10,
        distinct / m,
        distinct / np.sqrt(m) / 10,
        again / m,
        np.sqrt(again / m),
        len(set(lines)) / len(lines),
        np.log1p(len(text) / len(lines)),
        np.log1p(len(lines)),
        float(text.isupper()),
    ]
    return np.concatenate([head, np.sqrt(symbols / m)])


def feature_rows(rows: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    """``keep`` columns and the feature vector."""
    own = rows.select(*dict.fromkeys([*keep, text_col]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield replace_columns(b, keep, f=pa.array([features(t) for t in texts_of(b, text_col)], pa.list_(pa.float64())))

    schema = ", ".join(f"`{c}` {type_of(own, c)}" for c in keep)
    return own.mapInArrow(lean(run), f"{schema}, f array<double>")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float
    base: float  # score at the cut

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.strength(x) - self.cut) + np.log(self.base / (1 - self.base))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _newton(z: np.ndarray, up: np.ndarray, down: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Weights that minimise mean log(1 + exp(-(z[up] - z[down]) @ w)) + ridge / 2 * |w|^2; pairs are built in blocks, never all at once."""
    size, n = z.shape[1], len(up)
    w = np.zeros(size)
    for _ in range(steps):
        grad, h = np.zeros(size), np.zeros((size, size))
        for k in range(0, n, BLOCK):
            diff = z[up[k : k + BLOCK]] - z[down[k : k + BLOCK]]
            p = 1 / (1 + np.exp(np.clip(diff @ w, -500, 500)))
            grad += diff.T @ p
            h += (diff * (p * (1 - p))[:, None]).T @ diff
        grad = ridge * w - grad / n
        step = np.linalg.solve(h / n + ridge * np.eye(size), grad)
        step *= min(1.0, 5 / max(1e-12, np.abs(step).max()))
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_arrays(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS_PER_DOC, threshold: float = THRESHOLD) -> Model:
    """Model from feature rows and labels 0 and 1; the order of the rows must be fixed."""
    size = x.shape[1] if len(x) else len(features(""))
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        return Model(np.zeros(size), np.ones(size), np.zeros(size), 0.0, 1.0, share)
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.clip((x - mean) / scale, -6, 6)
    rng = np.random.default_rng(11)
    up = np.concatenate([np.repeat(good, pairs), rng.choice(good, len(bad) * pairs)])
    down = np.concatenate([rng.choice(bad, len(good) * pairs), np.repeat(bad, pairs)])
    w = _newton(z, up, down)
    s = z @ w
    cut = float(np.quantile(s, len(bad) / len(y)))
    odds = np.log(threshold / (1 - threshold))

    def loss(k: float) -> float:
        t = k * (s - cut) + odds
        return float(np.logaddexp(0, np.where(y == 1, -t, t)).mean())

    slope = min(np.geomspace(0.05, 20, 60), key=loss)
    return Model(mean, scale, w, cut, float(slope), threshold)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = SAMPLE_ROWS) -> Model:
    """Model from ``docs`` that have a label of 0 or 1; reads a bounded sample of labels (module docstring).

    The sampled labels are few enough to be sent to every task, so no text is shuffled.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_y")).where(F.col("_y").isin(0, 1)).distinct()
    few = F.broadcast(bounded_sample(known, "_id", rows))
    pairs = docs.select(F.col(id_col).alias("_d"), F.col(text_col).alias("_t")).join(few, F.col("_d") == F.col("_id"))
    # a repeated id may bring any number of rows: copies collapse, and a second hash bounds its different texts
    pairs = cut(pairs.groupBy("_id", "_y", F.xxhash64("_t").alias("_h")).agg(F.first("_t").alias("_t")))
    pairs = bounded_sample(pairs, "_h", 2 * rows).select("_id", "_y", "_t")
    table = feature_rows(pairs, ["_id", "_y"], "_t").toArrow().sort_by([("_id", "ascending"), ("_y", "ascending")])
    y = table.column("_y").to_numpy().astype(float)
    if not len(y):
        return fit_arrays(np.zeros((0, 0)), y)
    x = table.column("f").combine_chunks().flatten().to_numpy().reshape(len(y), -1)
    order = np.lexsort((*x.T[::-1], y, table.column("_id").to_numpy()))  # repeated ids in a fixed order too
    return fit_arrays(x[order], y[order])


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns, score (0 to 1) and predicted (1 if score >= THRESHOLD) per row."""
    rows = docs.select(*dict.fromkeys([*keep, text_col]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t) for t in texts_of(b, text_col)]).reshape(b.num_rows, len(model.mean))
            s = model.score(x)
            yield replace_columns(b, keep, score=pa.array(s), predicted=pa.array((s >= THRESHOLD).astype(np.int32)))

    schema = ", ".join(f"`{c}` {type_of(rows, c)}" for c in keep)
    return rows.mapInArrow(lean(run), f"{schema}, score double, predicted int")
