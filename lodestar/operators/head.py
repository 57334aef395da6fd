"""The projection head: forward pass, gradient, AdamW, weights as a table.

The backbone is frozen, so the head's few weights are all that is trained. They live on the driver;
items stay on the executors, and a forward pass sends the weights to them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.vector import NORM_FLOOR, doubles, l2_normalize
from lodestar.schema import HEAD_WEIGHTS


@dataclass
class Head:
    """Linear, ReLU, dropout, linear; or linear and dropout where ``hidden`` is 0. layers: (weights, bias) each."""

    layers: list[tuple[np.ndarray, np.ndarray]]
    normalize: bool = True
    dropout: float = 0.0
    state: dict = field(default_factory=dict)

    @classmethod
    def random(cls, dim: int, hidden: int, out: int, normalize: bool = True, dropout: float = 0.0, seed: int = 42) -> Head:
        rng = np.random.default_rng(seed)
        sizes = [(hidden, dim), (out, hidden)] if hidden else [(out, dim)]
        bound = lambda n: 1 / np.sqrt(n)
        layers = [(rng.uniform(-bound(n), bound(n), (m, n)), rng.uniform(-bound(n), bound(n), m)) for m, n in sizes]
        return cls(layers, normalize, dropout)

    def forward(self, x: np.ndarray, rng: np.random.Generator | None = None) -> tuple[np.ndarray, list]:
        """Outputs and what ``backward`` needs. Dropout only with ``rng``, as when training."""
        tape, last = [], len(self.layers) - 1
        for k, (w, b) in enumerate(self.layers):
            before, x = x, x @ w.T + b
            gate = np.ones_like(x)
            if k < last:
                gate = (x > 0).astype(float)
            if rng is not None and self.dropout and (k < last or last == 0):
                gate *= (rng.random(x.shape) >= self.dropout) / (1 - self.dropout)
            x = x * gate
            tape.append((before, gate))
        if self.normalize:
            size = np.maximum(np.linalg.norm(x, axis=1, keepdims=True), NORM_FLOOR)
            x = x / size
            tape.append((x, size))
        return x, tape

    def backward(self, grad: np.ndarray, tape: list) -> list[tuple[np.ndarray, np.ndarray]]:
        tape = list(tape)
        if self.normalize:
            y, size = tape.pop()
            grad = (grad - y * (y * grad).sum(axis=1, keepdims=True)) / size
        out = []
        for (w, _), (before, gate) in zip(reversed(self.layers), reversed(tape), strict=True):
            grad = grad * gate
            out.append((grad.T @ before, grad.sum(axis=0)))
            grad = grad @ w
        return out[::-1]

    def step(self, grads: list, lr: float, weight_decay: float = 0.0, betas: tuple = (0.9, 0.999), eps: float = 1e-8) -> None:
        """One step of AdamW; Adam where the decay is 0."""
        t = self.state["t"] = self.state.get("t", 0) + 1
        for k, (params, g) in enumerate(zip(self.layers, grads, strict=True)):
            for j, (p, d) in enumerate(zip(params, g, strict=True)):
                m, v = self.state.get((k, j), (0.0, 0.0))
                m, v = betas[0] * m + (1 - betas[0]) * d, betas[1] * v + (1 - betas[1]) * d * d
                self.state[k, j] = m, v
                p *= 1 - lr * weight_decay
                p -= lr * (m / (1 - betas[0] ** t)) / (np.sqrt(v / (1 - betas[1] ** t)) + eps)

    def embed(self, items: DataFrame, column: str = "embedding") -> DataFrame:
        """``items`` with ``column`` replaced by the head's output, by matrix products in Arrow batches."""
        plain = Head([(w.copy(), b.copy()) for w, b in self.layers], self.normalize)
        sent = items.sparkSession.sparkContext.broadcast(plain)
        rest = [c for c in items.columns if c != column]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = b["_v"].flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                    y = sent.value.forward(x)[0]
                    out = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1]), pa.array(y.ravel()))
                    yield pa.RecordBatch.from_arrays([*(b[c] for c in rest), out], names=[*rest, column])

        kinds = dict(items.dtypes)
        schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), f"`{column}` array<double>"])
        return items.select(*rest, doubles(F.col(column)).alias("_v")).mapInArrow(run, schema)

    def column(self, v: Column) -> Column:
        """The forward pass as a column expression, for small heads: no Python."""
        last = len(self.layers) - 1
        for k, (w, b) in enumerate(self.layers):
            rows = F.lit([[float(x) for x in r] for r in w])
            biased = F.zip_with(rows, F.lit([float(x) for x in b]), _linear(v))
            v = F.transform(biased, lambda x: F.greatest(x, F.lit(0.0))) if k < last else biased
        return l2_normalize(v) if self.normalize else v

    def save(self, spark: SparkSession, path: str, run: str, tag: str) -> None:
        """Replace the weights ``tag`` (best, best_loss, last) of ``run``."""
        rows = [(run, tag, f"{k}.{kind}", r, [float(x) for x in np.atleast_1d(row)]) for k, layer in enumerate(self.layers) for kind, m in zip("wb", layer, strict=True) for r, row in enumerate(m)]
        frame = spark.createDataFrame(rows, HEAD_WEIGHTS)
        frame.write.mode("overwrite").parquet(f"{path.rstrip('/')}/run={run}/tag={tag}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, run: str, tag: str, normalize: bool = True) -> Head:
        rows = spark.read.schema("layer string, row int, values array<double>").parquet(f"{path.rstrip('/')}/run={run}/tag={tag}").collect()
        found: dict[str, dict[int, list]] = {}
        for r in rows:
            found.setdefault(r["layer"], {})[r["row"]] = r["values"]
        matrix = lambda name: np.array([found[name][k] for k in sorted(found[name])])
        n = len({name.split(".")[0] for name in found})
        return cls([(matrix(f"{k}.w"), matrix(f"{k}.b").ravel()) for k in range(n)], normalize)


def _linear(v: Column):
    """From a row of weights and its bias to the row's output on ``v``."""
    return lambda row, bias: F.aggregate(F.zip_with(row, v, lambda x, y: x * y), bias, lambda s, x: s + x)


def embed(items: DataFrame, head: Head | None) -> DataFrame:
    """Items embedded by the head; without one, their vectors normalised."""
    return head.embed(items) if head else items.withColumn("embedding", l2_normalize(doubles(F.col("embedding"))))


def centroids(items: DataFrame, label: str = "label") -> DataFrame:
    """The mean vector of each class, as rows (label, pos, value)."""
    rows = items.select(label, F.posexplode(doubles(F.col("embedding"))).alias("pos", "x"))
    return rows.groupBy(label, "pos").agg(F.avg("x").alias("value"))
