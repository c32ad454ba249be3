"""Document quality by a regularised quadratic discriminant over transformed document statistics.

Each class has a mean and a shrinkage covariance; a score is the logistic of the difference of the two
Gaussian log-densities, each a Mahalanobis distance through a Cholesky factor that is computed once,
and of the log prior odds.  Sums and products that the model needs are aggregated over all labelled rows.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.llm.common import checkpoint, held_out, text_pass

#: Weight of the pooled covariance in each class's, and of its diagonal in both.
POOLED, DIAGONAL = 0.6, 0.1
#: Added to every variance, in transformed units.
RIDGE = 0.02
#: Log-density differences are damped by this before the logistic.
DAMP = 0.5
LEVEL = 0.7

# byte classes: lower, upper, digit, space, line end, sentence marks, other marks, symbols, beyond ASCII
_CLASS = np.full(256, 7, np.uint8)
for _chars, _k in ((b"abcdefghijklmnopqrstuvwxyz", 0), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"0123456789", 2), (b" \t", 3), (b"\n\r\x0b\x0c", 4), (b".,;:?", 5), (b"'\"-()/", 6)):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 8

STATISTICS = ["chars", "words", "upper", "digits", "marks", "others", "symbols", "beyond", "length", "distinct", "repeated", "ends", "lines"]


def _share(part: float, whole: float, prior: float = 1.0) -> float:
    """The log odds of part in whole, with `prior` pseudo-counts on either side."""
    return float(np.log((part + prior) / (max(whole - part, 0) + prior)))


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a whole text; null counts as empty."""
    raw = (text or "").encode()
    low, up, digit, space, line, mark, other, symbol, beyond = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=9).tolist()
    ws = raw.split()
    n = len(ws)
    lines = [x for x in raw.split(b"\n") if x]
    alpha = low + up + beyond
    return [
        float(np.log1p(len(raw))),
        float(np.log1p(n)),
        _share(up, low + up),
        _share(digit, len(raw)),
        _share(mark, len(raw)),
        _share(other, len(raw)),
        _share(symbol, len(raw)),
        _share(beyond, alpha),
        float(np.log((alpha + 5) / (n + 1))),
        _share(len(set(ws)), n),
        _share(sum(map(eq, ws, ws[1:])), n),
        _share(sum(not w[-1:].isalnum() and w[-1] < 128 for w in ws), n),
        _share(len(lines) - len(set(lines)), len(lines)),
    ]


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep and x, the array of statistics, of every row."""
    return text_pass(docs, keep, "text", [("x", "array<double>")], lambda: lambda texts: [[statistics(t) for t in texts]])


class Discriminant:
    """Two Gaussian classes with cached Cholesky factors."""

    def __init__(self, n: np.ndarray, sums: np.ndarray, products: np.ndarray):
        """Counts (2), sums (2, d) and sums of products (2, d, d) of classes 0 and 1."""
        self.n = n
        if (n < 2).any():
            return
        mean = sums / n[:, None]
        own = products / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
        pooled = (own * n[:, None, None]).sum(axis=0) / n.sum()
        self.mean, self.factor, self.logdet = mean, [], []
        for k in (0, 1):
            mixed = (1 - POOLED) * own[k] + POOLED * pooled
            mixed = (1 - DIAGONAL) * mixed + DIAGONAL * np.diag(np.diag(mixed)) + RIDGE * np.eye(len(mixed))
            chol = np.linalg.cholesky(mixed)
            self.factor.append(np.linalg.inv(chol))
            self.logdet.append(2 * np.log(np.diag(chol)).sum())
        self.odds = float(np.log(n[1] / n[0]))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The chance of class 1 for rows of x; with fewer than two rows in a class the smoothed share of class 1."""
        if (self.n < 2).any():
            return np.full(len(x), (self.n[1] + 1) / (self.n.sum() + 2))
        density = [-0.5 * (((x - self.mean[k]) @ self.factor[k].T) ** 2).sum(axis=1) - 0.5 * self.logdet[k] for k in (0, 1)]
        z = np.clip(DAMP * (density[1] - density[0]) + self.odds, -500, 500)
        return 1 / (1 + np.exp(-z))


def fit(rows: DataFrame) -> Discriminant:
    """From all rows with x and label (0 or 1): one aggregate of counts, sums and products."""
    d = len(STATISTICS)
    pairs = [(i, k) for i in range(d) for k in range(i, d)]

    def moments(batches):
        n, s, p = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            for k in (0, 1):
                own = x[y == k]
                n[k] += len(own)
                s[k] += own.sum(axis=0)
                p[k] += own.T @ own
        for k in (0, 1):
            full = np.concatenate(([n[k]], s[k], [p[k][a, b] for a, b in pairs]))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(full), k, np.int32)), pa.array(np.arange(len(full), dtype=np.int32)), pa.array(full)], ["k", "at", "v"])

    table = rows.select("x", "label").mapInArrow(moments, "k int, at int, v double").groupBy("k", "at").agg(F.sum("v").alias("v")).toPandas()
    full = np.zeros((2, 1 + d + len(pairs)))
    full[table.k.to_numpy(int), table["at"].to_numpy(int)] = table.v.to_numpy(float)
    products = np.zeros((2, d, d))
    for i, (a, b) in enumerate(pairs):
        products[:, a, b] = products[:, b, a] = full[:, 1 + d + i]
    return Discriminant(full[:, 0], full[:, 1 : 1 + d], products)


def classify(docs: DataFrame, labels: DataFrame, level: float = LEVEL) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Learns from labels (doc_id, quality 0 or 1) of documents that are not held out; null or other
    labels teach nothing, repeated ones each count.  Null and empty texts are scored by their statistics.  Repeated documents
    each get a row, an empty table stays empty, a text of any length counts as a whole, and no other column plays a part.
    """
    rows = checkpoint(measured(docs, ["doc_id"]).withColumn("held_out", held_out()))
    taught = rows.where("not held_out").join(labels.where("quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("label")), "doc_id")
    model = docs.sparkSession.sparkContext.broadcast(fit(taught))
    d = len(STATISTICS)

    def score(batches):
        for batch in batches:
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            s = model.value.scores(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= level).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = dict(rows.dtypes)["doc_id"]
    return rows.select("doc_id", "held_out", "x").mapInArrow(score, f"doc_id {kind}, held_out boolean, score double, predicted int")
