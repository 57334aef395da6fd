"""Operator 9: quality classifier, a regularised quadratic discriminant over document statistics.

Each class has a mean and a covariance shrunk towards its diagonal and towards the pooled one. The
score is the logistic of the difference of the classes' log densities and log priors; a log density
is a Mahalanobis distance by the class's Cholesky factor, computed once when the model is fitted.

The fit uses a bounded, uniform sample of the labelled rows (``FIT_ROWS`` of the training fold, the
least hashes of doc_id), so its cost doesn't grow with the corpus. How far the covariances are shrunk
is chosen among SHRINKS and TO_POOLED by the log loss over inner folds of these rows, so no held-out
row has a part in it. Scoring is one pass over whole texts without a shuffle.

Nulls and corners: null or empty text has statistics of zero and a score like any other text; a
doc_id with differing labels is not learned from, nor is a null label or doc_id; a label without a
document is ignored; with no usable row of one class every score is the share of label 1 (0.5 if
there is none at all); repeated rows are scored each; among equal losses the first shrinkage listed
is taken; a very long text is counted whole, its words held in memory once; an empty table gives no
row; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.sources.shared import settle

from . import _worker

FIT_ROWS, THRESHOLD = 20_000, 0.3
#: Shares of the diagonal and of the pooled covariance that are tried (all of it would be linear), and the inner folds that choose.
SHRINKS, TO_POOLED, FOLDS = (0.02, 0.1, 0.3), (0.0, 0.25, 0.5, 0.75), 5
#: Bytes of the classes that are counted: letters, capitals, digits, marks of prose, other marks.
_CLASSES = np.zeros((256, 6), np.float64)
for _b in range(256):
    _c = chr(_b)
    _CLASSES[_b] = [
        _c.isascii() and _c.isalpha() or _b >= 0xC0, _c.isascii() and _c.isupper(), _c.isascii() and _c.isdigit(),
        _c in ".,;:'\"?-()", _c in "#*$%&|<>!@^_=+~/\\[]{}`", _c in " \t\n\r\x0b\x0c",
    ]
N_FEATURES = 12


def _logit(share: float, n: float) -> float:
    """The log odds of a share of n, smoothed by half a count on each side."""
    k = share * n
    return math.log((k + 0.5) / (n - k + 0.5))


def statistics(text: str | None) -> list[float]:
    """A document's transformed statistics."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(np.float64)
    letters, capitals, digits, prose, marks, spaces = (counts @ _CLASSES).tolist()
    words = raw.split()
    n = len(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    solid = max(1.0, len(raw) - spaces)
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        math.log1p(n),
        math.log1p((len(raw) - spaces) / max(1, n)),
        _logit(len(set(words)) / max(1, n), n),
        _logit(pairs / max(1, n - 1), max(0, n - 1)),
        math.log1p(100 * marks / solid),
        math.log1p(100 * prose / solid),
        math.log1p(100 * digits / solid),
        math.log1p(100 * capitals / max(1.0, letters)),
        math.log1p(100 * (1 - min(1.0, letters / solid))),
        math.log1p(len(lines)),
        math.log1p(100 * (1 - len(set(lines)) / max(1, len(lines)))),
        math.log1p(100 * (len(raw) - float(counts[:128].sum())) / solid),
    ]


def _statistics(texts) -> np.ndarray:
    return np.array([statistics(x.as_py()) for x in texts], dtype=np.float64).reshape(-1, N_FEATURES)


class Discriminant:
    """The fitted model; ``score`` is the probability of label 1."""

    def __init__(self, x: np.ndarray, y: np.ndarray, shrink: float = SHRINKS[0], to_pooled: float = TO_POOLED[0]):
        self.share = float(y.mean()) if len(y) else 0.5
        self.classes = []
        if len(set(y.tolist())) < 2:
            return
        self.mean = x.mean(axis=0)
        spread = x.std(axis=0)
        self.scale = np.where(spread > 1e-9, spread, np.inf)  # a statistic that doesn't vary tells nothing
        z = (x - self.mean) / self.scale
        parts = [z[y == c] for c in (0, 1)]
        own = [(p - p.mean(axis=0)).T @ (p - p.mean(axis=0)) / len(p) for p in parts]
        pooled = sum(len(p) * c for p, c in zip(parts, own, strict=True)) / len(z)
        for p, c in zip(parts, own, strict=True):
            c = (1 - to_pooled) * c + to_pooled * pooled
            c = (1 - shrink) * c + shrink * np.diag(np.diag(c)) + 1e-3 * np.eye(len(c))
            factor = np.linalg.cholesky(c)
            constant = math.log(len(p) / len(z)) - float(np.log(np.diag(factor)).sum())
            self.classes.append((p.mean(axis=0), np.linalg.inv(factor), constant))

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.classes:
            return np.full(len(x), self.share)
        z = (x - self.mean) / self.scale
        logs = [c - 0.5 * (((z - m) @ inverse.T) ** 2).sum(axis=1) for m, inverse, c in self.classes]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def shrinkage(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The pair of ``shrink`` and ``to_pooled`` with the least log loss over inner folds, every FOLDS-th row one."""
    inner, losses = np.arange(len(y)) % FOLDS, {}
    for pair in product(SHRINKS, TO_POOLED):
        losses[pair] = 0.0
        for k in range(FOLDS):
            if len(y[inner == k]):
                p = np.clip(Discriminant(x[inner != k], y[inner != k], *pair).score(x[inner == k]), 1e-6, 1 - 1e-6)
                losses[pair] -= float(np.log(np.where(y[inner == k] == 1, p, 1 - p)).sum())
    return min(losses, key=lambda pair: round(losses[pair], 6))


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Discriminant:
    """The model of ``docs`` (doc_id, text) and ``labels`` (doc_id, quality) outside fold 0 of 5."""
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    labels = labels.filter("doc_id is not null and quality in (0, 1)").filter(fold(F.col("doc_id"), 5) != 0)
    agreed = labels.groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("top")).filter("y = top")
    agreed = settle(agreed.select("doc_id", "y", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("draw")), "labels")
    # twice as many as wanted, by hash, where the rows lie: so few are put in order, however many there are
    few = agreed.filter(F.col("draw") < F.lit(2.0 * fit_rows * (1 << 30) / max(1, agreed.count())))
    # at most ``fit_rows`` rows of 12 bytes
    chosen = F.broadcast(few.orderBy("draw", "doc_id").limit(fit_rows).select("doc_id", "y"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _worker.release()
        for b in batches:
            x = _statistics(b["text"])
            columns = [b["doc_id"], b["y"], pa.array(x.tolist(), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "y", "x"])

    rows = docs.join(chosen, "doc_id").select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, x array<double>")
    # a repeated document counts once, so the driver gets ``fit_rows`` rows at most
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("x", "y")).alias("r")).select("doc_id", "r.x", "r.y").toPandas()
    rows = rows.sort_values("doc_id")
    x = np.array(rows["x"].tolist(), dtype=np.float64).reshape(-1, N_FEATURES)
    y = rows["y"].to_numpy(dtype=np.int64)
    return Discriminant(x, y, *shrinkage(x, y))


def score(docs: DataFrame, model: Discriminant, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` (doc_id, text) to (doc_id, score, predicted), one row per row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _worker.release()
        for b in batches:
            found = sent.value.score(_statistics(b["text"]))
            columns = [b["doc_id"], pa.array(found), pa.array((found >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "score", "predicted"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, score double, predicted int")


def keep(docs: DataFrame, model: Discriminant, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is at least ``threshold``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _worker.release()
        for b in batches:
            yield b.filter(pa.array(sent.value.score(_statistics(b.column(text))) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every row of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out")
    return score(docs, model).select("doc_id", held_out, "score", "predicted")
