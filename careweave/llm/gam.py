"""Quality classifier: a generalised additive model with pairwise interactions.

Shape features of a text are put into quantile bins. Cyclic boosting goes round the
features many times and adds a small tree over the bins of one feature at a time, so
what is learned is one lookup table for each feature. Then the pairs of features whose
joint bins explain most of what is left get two-dimensional tables the same way. A
score is the logistic of the intercept and one entry of each table.

The model is fitted on the driver on a bounded sample of labelled rows (``max_rows``, by
smallest hash of the identifier); every text is read whole and scored on the executors.

Defined cases: a null text is an empty text, which is scored too; rows without a label,
or with a null one, don't train; conflicting labels all count, rows of equal
identifier once for each label; with no
label at all every score is 0.5; an empty table gives an empty table; other columns
are not looked at. A very long text is one row of features, read whole. Ties: rows of equal
hash are ordered by identifier and label, equal gains of a split or pair take the first.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careweave.llm import common

FEATURES = ("log_words", "word_length", "upper", "digits", "symbols", "exclamations", "blanks", "distinct_words", "repeated_lines", "top_word", "stops", "one_letter", "non_ascii", "line_length", "repeated_pairs")
_CLASS = np.zeros(256, np.int64)
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("a") : ord("z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[list(b"#*$%&|<>{}[]\\^~=@_`/+")] = 4
_CLASS[ord("!")] = 5
_CLASS[list(b" \t\n\x0b\x0c\r")] = 6
_CLASS[list(b".?")] = 7
_CLASS[128:] = 8


def features(data: bytes) -> list[float]:
    """Shape of a text, in the order of FEATURES."""
    kind = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=9) if data else np.zeros(9)
    n = max(1, len(data))
    words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
    w = max(1, len(words))
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        math.log1p(len(words)), (n - kind[6]) / w, kind[1] / max(1, kind[1] + kind[2]), kind[3] / n, kind[4] / n, kind[5] / n, kind[6] / n,
        len(counts) / math.sqrt(w), 1 - len(set(lines)) / len(lines) if lines else 0.0, max(counts.values(), default=0) / w, kind[7] / w,
        sum(v for k, v in counts.items() if len(k) == 1) / w, kind[8] / n, math.log1p(n / max(1, len(lines))), 1 - pairs / max(1, len(words) - 1),
    ]


class Gam:
    """Lookup tables over binned features and over pairs of them."""

    def __init__(self, edges: list[np.ndarray], base: float) -> None:
        self.edges, self.base = edges, base
        self.tables = [np.zeros(len(e) + 1) for e in edges]
        self.pairs: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], 1) if len(x) else np.zeros((0, len(self.edges)), np.int64)

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = self.binned(x)
        total = np.full(len(x), self.base)
        for k, table in enumerate(self.tables):
            total += table[bins[:, k]]
        for (i, j), (gi, gj, table) in self.pairs.items():
            total += table[gi[bins[:, i]], gj[bins[:, j]]]
        return 1 / (1 + np.exp(-total))


def _tree(grad: np.ndarray, hess: np.ndarray, leaves: int, smooth: float) -> np.ndarray:
    """Newton steps of a tree of up to ``leaves`` leaves over ordered bins."""
    g, h = np.concatenate([[0], np.cumsum(grad)]), np.concatenate([[0], np.cumsum(hess)])
    worth = lambda a, b: np.square(g[b] - g[a]) / (h[b] - h[a] + smooth)
    cuts = [0, len(grad)]
    while len(cuts) <= leaves:
        best = (1e-9, 0)
        for a, b in itertools.pairwise(cuts):
            m = np.arange(a + 1, b)
            if len(m):
                gain = worth(a, m) + worth(m, b) - worth(a, b)
                best = max(best, (float(gain.max()), int(m[gain.argmax()])))
        if not best[1]:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(grad))
    for a, b in itertools.pairwise(cuts):
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + smooth)
    return out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 48, rounds: int = 120, rate: float = 0.12, leaves: int = 3, pairs: int = 6, pair_bins: int = 8, pair_rounds: int = 40, smooth: float = 2.0) -> Gam:
    """Cyclic boosting of single tables, then of the strongest pairs."""
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])] if len(x) else [np.zeros(0)] * len(FEATURES)
    rate_1 = (y.sum() + 1) / (len(y) + 2)
    model = Gam(edges, math.log(rate_1 / (1 - rate_1)))
    if len(set(y.tolist())) < 2:
        return model
    at = model.binned(x)
    total = np.full(len(x), model.base)

    def residual() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for k, table in enumerate(model.tables):
            r, h = residual()
            step = rate * _tree(np.bincount(at[:, k], r, len(table)), np.bincount(at[:, k], h, len(table)), leaves, smooth)
            table += step
            total += step[at[:, k]]
    # pairs: coarse bins, ranked by what independent cells would still explain
    coarse = [np.minimum(np.arange(len(t)) * pair_bins // len(t), pair_bins - 1) for t in model.tables]
    r, h = residual()
    gains = {}
    for i, j in itertools.combinations(range(x.shape[1]), 2):
        cell = coarse[i][at[:, i]] * pair_bins + coarse[j][at[:, j]]
        g, w = np.bincount(cell, r, pair_bins**2), np.bincount(cell, h, pair_bins**2)
        gains[i, j] = float((g * g / (w + smooth)).sum())
    strongest = sorted(gains, key=gains.get, reverse=True)[:pairs]
    for pair in strongest:
        model.pairs[pair] = (coarse[pair[0]], coarse[pair[1]], np.zeros((pair_bins, pair_bins)))
    for _ in range(pair_rounds):
        for (i, j), (gi, gj, table) in model.pairs.items():
            r, h = residual()
            cell = gi[at[:, i]] * pair_bins + gj[at[:, j]]
            g, w = (np.bincount(cell, v, pair_bins**2).reshape(pair_bins, pair_bins) for v in (r, h))
            rows = _tree(g.sum(1), w.sum(1), 2, smooth)  # first split one way, then each part the other
            step = np.zeros_like(table)
            for value in np.unique(rows):
                part = rows == value
                step[part] = _tree(g[part].sum(0), w[part].sum(0), 2, smooth)
            table += rate * step
            total += rate * step[gi[at[:, i]], gj[at[:, j]]]
    return model


def _featured(rows: DataFrame) -> DataFrame:
    """(id, x) for rows (id, text, ...)."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64())), b.column(2)], names=["id", "x", "label"])

    return rows.mapInArrow(compute, f"id {dict(rows.dtypes)['id']}, x array<double>, label int")


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Gam:
    """Fit on at most ``max_rows`` labelled documents. ``labels``: (id, 0 or 1)."""
    usable = labels.where(f"{id_col} IS NOT NULL AND {label_col} IS NOT NULL")
    chosen = usable.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).orderBy(F.xxhash64("id"), "id", "label").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    # at most max_rows pairs of numbers are sent to the executors
    got = _featured(texts.join(F.broadcast(chosen), "id").select("id", "text", "label")).groupBy("id", "label").agg(F.min("x").alias("x")).toPandas().sort_values(["id", "label"])
    x = np.array(got["x"].tolist(), float).reshape(len(got), len(FEATURES))
    return fit(x, got["label"].to_numpy(float)) if len(got) else fit(np.zeros((0, len(FEATURES))), np.zeros(0))


def predict(docs: DataFrame, model: Gam, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """(id, score, predicted) of every row."""
    common.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in b.column(1)], float).reshape(b.num_rows, len(FEATURES))
            score = shared.value.score(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["id", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(answer, f"id {dict(rows.dtypes)['id']}, score double, predicted int").withColumnRenamed("id", id_col)
