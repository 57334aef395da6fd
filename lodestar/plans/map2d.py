"""Two-dimensional maps of items: by principal components, and by a layout of the neighbour graph.

``map_2d`` is linear, and a labelled substitute where only an overview is wanted. ``neighbour_map``
is a manifold projection by the published method of uniform manifold approximation: the exact graph
of nearest neighbours, its edges as fuzzy memberships, and a layout that pulls neighbours together
and pushes drawn others apart. It takes whole epochs of gradients, not one edge after the other, so
an epoch is a few joins on the executors and its result doesn't depend on the order of edges; points
therefore differ from those of a sequential implementation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.hashing import draw
from lodestar.functions.vector import doubles, width
from lodestar.operators.ranking import place
from lodestar.operators.search import knn
from lodestar.sources.shared import settle


def map_2d(items: DataFrame, key: str = "vec_id") -> DataFrame:
    """(key, x, y): centred vectors on the two leading components; signs follow the largest loading.

    Each task adds up its own moments, so what reaches the driver is one matrix for a task.
    """
    dim = width(items, "embedding")
    rows = items.select(key, doubles(F.col("embedding")).alias("v"))

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + dim + dim * dim)
        for b in batches:
            x = b["v"].flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            total += np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["k", "t"])

    sums = rows.mapInArrow(moments, "k int, t double").groupBy("k").agg(F.sum("t").alias("t")).toPandas()
    total = sums.sort_values("k")["t"].to_numpy()
    n, mean = max(1.0, total[0]), total[1 : 1 + dim] / max(1.0, total[0])
    cov = total[1 + dim :].reshape(dim, dim) / n - np.outer(mean, mean)
    axes = np.linalg.eigh(cov)[1][:, ::-1][:, :2]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), range(axes.shape[1])])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b["v"].flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                y = (x - mean) @ axes
                yield pa.RecordBatch.from_arrays([b[key], pa.array(y[:, 0]), pa.array(y[:, 1])], names=[key, "x", "y"])

    return rows.mapInArrow(project, f"{key} {dict(items.dtypes)[key]}, x double, y double")


def fuzzy_graph(neighbours: DataFrame, k: int) -> DataFrame:
    """``neighbours`` (q, g, d), ``k`` for each q, to undirected edges as rows (a, b, weight) in both directions.

    A query's nearest neighbour has membership 1 and the others less by distance, at a rate that makes
    them add up to log2(k); two directions join as probabilities: u + v - uv.
    """
    rows = neighbours.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("d", "g"))).alias("near"))  # k each
    rows = rows.select("q", F.transform("near", lambda x: x["g"]).alias("g"), F.transform("near", lambda x: x["d"]).alias("d"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                n = np.array(pa.compute.list_value_length(b["d"]))
                d = np.full((len(n), n.max()), np.inf)
                d[np.arange(d.shape[1]) < n[:, None]] = b["d"].flatten().to_numpy()
                w = memberships(d, k)[np.arange(d.shape[1]) < n[:, None]]
                columns = [pa.array(np.repeat(b["q"].to_numpy(), n)), b["g"].flatten(), pa.array(w)]
                yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "weight"])

    one = rows.mapInArrow(run, "a long, b long, weight double")
    both = one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    joined = F.sum("weight") - F.when(F.count("weight") > 1, F.max("weight") * F.min("weight")).otherwise(0.0)
    return both.groupBy("a", "b").agg(joined.alias("weight"))


def memberships(d: np.ndarray, k: int) -> np.ndarray:
    """Of rows of ascending distances (inf for none): exp(-(d - least positive) / rate), rates by bisection."""
    least = np.where(d > 0, d, np.inf).min(axis=1, keepdims=True)
    beyond = np.maximum(0, d - np.where(np.isfinite(least), least, 0))
    low, high, rate = np.zeros(len(d)), np.full(len(d), np.inf), np.ones(len(d))
    for _ in range(64):
        more = np.exp(-beyond / np.maximum(rate, 1e-300)[:, None]).sum(axis=1) > np.log2(k)
        low, high = np.where(more, low, rate), np.where(more, rate, high)
        rate = np.where(np.isfinite(high), (low + high) / 2, 2 * rate)
    finite = np.where(np.isfinite(d), d, 0)
    floor = 1e-3 * finite.sum(axis=1) / np.maximum(1, np.isfinite(d).sum(axis=1))
    return np.exp(-beyond / np.maximum(np.maximum(rate, floor), 1e-300)[:, None])


def curve(min_dist: float, spread: float = 1.0) -> tuple[float, float]:
    """(a, b) with which 1 / (1 + a x^2b) is nearest to 1 up to ``min_dist`` and an exponential beyond it."""
    x = np.linspace(0, 3 * spread, 300)[1:]
    want = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread))
    a, b, damp = 1.0, 1.0, 1e-2
    error = lambda a, b: 1 / (1 + a * x ** (2 * b)) - want
    for _ in range(200):
        f = 1 / (1 + a * x ** (2 * b))
        slope = np.stack([-(f**2) * x ** (2 * b), -(f**2) * a * x ** (2 * b) * 2 * np.log(x)], axis=1)
        step = np.linalg.solve(slope.T @ slope + damp * np.eye(2), -slope.T @ error(a, b))
        if a + step[0] > 0 and b + step[1] > 0 and (error(a + step[0], b + step[1]) ** 2).sum() < (error(a, b) ** 2).sum():
            a, b, damp = a + step[0], b + step[1], damp / 3
        else:
            damp *= 4
    return float(a), float(b)


def neighbour_map(items: DataFrame, k: int = 15, min_dist: float = 0.1, epochs: int = 40, metric: str = "cosine", seed: int = 42, others: int = 5, key: str = "vec_id") -> DataFrame:
    """(key, x, y): a layout of the graph of ``k`` neighbours, each epoch settled in the shared folder.

    A point moves by the mean of its edges' pulls, weighted by membership, and of the pushes of
    ``others`` points that each edge's end draws anew in every epoch; steps shrink to nothing.
    """
    rows = settle(place(items.select(key, "embedding", *([] if key == "vec_id" else [F.col(key).alias("vec_id")])), [], key), "numbered-items")
    n = rows.count()
    if n < 3:
        return rows.select(key, F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    nodes = rows.select(F.col("_place").alias("vec_id"), "embedding", F.lit(0).alias("label"))
    k = min(k, n - 1)
    edges = settle(fuzzy_graph(knn(nodes, nodes, k, metric, same=True).select("q", "g", "d"), k), "fuzzy-graph")
    start = map_2d(nodes)
    size = start.agg(F.greatest(F.max(F.abs("x")), F.max(F.abs("y")), F.lit(1e-12)).alias("m")).first()["m"]
    at = settle(start.select(F.col("vec_id").alias("id"), (F.col("x") * 10 / size).alias("x"), (F.col("y") * 10 / size).alias("y")), "layout")
    a, b = curve(min_dist)
    for epoch in range(epochs):
        at = settle(_moved(at, edges, n, a, b, 1 - epoch / epochs, f"map:{seed}:{epoch}", others), "layout")
    named = rows.select(F.col("_place").alias("id"), key)
    return named.join(at, "id").select(key, "x", "y")


def _moved(at: DataFrame, edges: DataFrame, n: int, a: float, b: float, step: float, seed: str, others: int) -> DataFrame:
    """Every point after one epoch."""
    end = at.select(F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    pairs = edges.join(at.withColumnRenamed("id", "a"), "a")
    dx, dy = F.col("x") - F.col("bx"), F.col("y") - F.col("by")
    apart = dx * dx + dy * dy
    powered = F.lit(a) * F.pow(apart, F.lit(b))
    pull = F.when(apart > 0, -2 * b * powered / apart / (1 + powered)).otherwise(0.0)
    pulled = pairs.join(end, "b").select("a", "weight", pull.alias("f"), dx.alias("dx"), dy.alias("dy"))
    drawn = pairs.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
    drawn = drawn.withColumn("b", draw(seed, F.col("a"), F.col("b"), F.col("j")) % n).filter("a != b")
    push = F.lit(2 * b) / ((0.001 + apart) * (1 + powered))
    pushed = drawn.join(end, "b").select("a", "weight", push.alias("f"), dx.alias("dx"), dy.alias("dy"))
    limited = lambda c: F.col("weight") * F.greatest(F.lit(-4.0), F.least(F.lit(4.0), F.col("f") * F.col(c)))
    moves = pulled.unionByName(pushed).groupBy("a").agg(
        (F.sum(limited("dx")) / F.sum("weight") * (1 + others)).alias("mx"), (F.sum(limited("dy")) / F.sum("weight") * (1 + others)).alias("my")
    )
    moved = at.join(moves.withColumnRenamed("a", "id"), "id", "left")
    return moved.select("id", *((F.col(c) + step * F.coalesce(f"m{c}", F.lit(0.0))).alias(c) for c in ("x", "y")))
