"""Exact nearest neighbours and Recall@k.

A zero vector has no direction: its cosine distance to any vector is 1, in every form of the search.
Distances that are NaN are the farthest, as Spark orders them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.functions.vector import BUILT_IN, METRICS, TERMS, doubles, width
from lodestar.sources.shared import settle

#: Bytes of query vectors that are broadcast; of a block of vectors beyond that; of distances, or of vectors side by side, that a task holds.
QUERY_BYTES, BLOCK_BYTES, TILE_BYTES = 64 << 20, 64 << 20, 64 << 20
#: Rows of the gallery, in units of k, that give the first bound of ``knn_pairs``, and how many times as many give the next.
GROWTH = 16
#: Pairs that a task of ``knn_pairs`` is meant to compute, and the most tasks that the gallery is dealt to for that.
TASK_PAIRS, MOST_TASKS = 4 << 20, 2000
#: Queries and rows whose sums of terms are made at a time.
SQUARE = 32, 512
#: Norms within which a matrix product's error is bounded by ``_slack``; others are compared term by term.
SAFE_NORM = 1e-140, 1e140

FOUND = "q long, g long, ql int, gl int, d double"


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query, ties by gallery id. Spark limits each task's rows before the shuffle."""
    by = W.partitionBy("q").orderBy("d", "g")
    return pairs.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def _blocks(n: int, dim: int, most: int) -> int:
    return max(1, -(-n * max(1, dim) * 8 // most))


def _dealt(rows: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
    """Each row in its block ``own``, once for every block ``other`` of the other side."""
    rows = rows.withColumn(own, F.pmod(F.xxhash64("vec_id"), F.lit(n_own)).cast("int"))
    return rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))) if n_other > 1 else F.lit(0))


def _pairs(asked: DataFrame, rows: DataFrame, n: int, m: int, dim: int, kernel: Callable, same: bool) -> DataFrame:
    """All pairs of ``n`` queries and ``m`` rows that their query's bound doesn't rule out: q, g, ql, gl, d."""
    few = n * dim * 8 <= QUERY_BYTES
    nq, ng = (1, 1) if few else (_blocks(n, dim, BLOCK_BYTES), _blocks(m, dim, BLOCK_BYTES))
    tasks = min(MOST_TASKS, -(-n * m // TASK_PAIRS)) if few else 1
    left = _dealt(rows.repartition(tasks) if tasks > 1 else rows, "gb", ng, "qb", nq).withColumnsRenamed({"vec_id": "g", "label": "gl", "v": "gv"})
    right = _dealt(asked, "qb", nq, "gb", ng).withColumnsRenamed({"vec_id": "q", "label": "ql", "v": "qv"})
    pairs = left.join(F.broadcast(right) if few else right, ["qb", "gb"])
    if same:
        pairs = pairs.filter("q != g")
    found = ["q", "g", "ql", "gl", kernel(F.col("qv"), F.col("gv"), dim).alias("d")]
    if "most" not in asked.columns:
        return pairs.select(*found)
    # A task's number keeps Spark from moving the filter into the join, whose code would be one method, too long to be compiled.
    pairs = pairs.select(*found, "most", "last", F.spark_partition_id().alias("task"))
    beyond = (F.col("d") > F.col("most")) | ((F.col("d") == F.col("most")) & (F.col("g") > F.col("last")))
    return pairs.filter(~F.coalesce(beyond, F.lit(False)) & (F.col("task") >= 0)).select("q", "g", "ql", "gl", "d")


def knn_pairs(queries: DataFrame, gallery: DataFrame, k: int, metric: str = "l2", same: bool = False) -> DataFrame:
    """All pairs by a registered kernel inside generated code: q, g, ql, gl, d, rank.

    Queries of up to QUERY_BYTES are broadcast. More of them, and the gallery, are dealt to blocks of
    BLOCK_BYTES, and each block of one side meets each block of the other in a task of its own.
    The distance of every pair is computed, but few pairs are put in order: the k-th nearest of a
    query among some rows of the gallery (taken by hash, GROWTH * k of them, then GROWTH times as many
    under the bound of those) is a bound that none of its k nearest in the whole gallery exceeds.
    Ties are bounded by gallery id, too, so copies don't come through; about GROWTH * k pairs a query do.
    ``same``: both sides are one set, and a vector is no neighbour of itself.
    """
    kernel, dim, n, m = METRICS[metric], width(gallery, "embedding"), queries.count(), gallery.count()
    plain = lambda df: df.select("vec_id", "label", doubles(F.col("embedding")).alias("v"))
    asked, rows, some = plain(queries), plain(gallery), GROWTH * k
    while n and some < m:
        part = rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(m)) < some)
        bound = _ranked(_pairs(asked, part, n, some, dim, kernel, same), k).filter(F.col("rank") == k)
        bound = settle(bound.select(F.col("q").alias("vec_id"), F.col("d").alias("most"), F.col("g").alias("last")), "bound")
        asked, some = plain(queries).join(bound, "vec_id", "left"), some * GROWTH
    return _ranked(_pairs(asked, rows, n, m, dim, kernel, same), k)


def _total(x: np.ndarray) -> np.ndarray:
    """Sums of rows, from left to right."""
    out = np.zeros(len(x))
    for k in range(x.shape[1]):
        out = out + x[:, k]
    return out


def _exact(metric: str | Callable, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, summed from left to right: to the bit what the column kernels give."""
    with np.errstate(all="ignore"):
        if callable(metric):
            return _total(metric(a, b))
        if metric == "l2":
            return np.sqrt(_total((a - b) * (a - b)))
        inner = _total(a * b)
        if metric == "ip":
            return -inner
        sizes = np.sqrt(_total(a * a)) * np.sqrt(_total(b * b))
        return 1.0 - np.where(sizes == 0, 0.0, inner / np.where(sizes == 0, 1.0, sizes))


def _summed(term: Callable, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All sums of terms, from left to right, by squares that stay in a processor's cache."""
    out, turned = np.zeros((len(a), len(b))), np.ascontiguousarray(b.T)
    for i in range(0, len(a), SQUARE[0]):
        for j in range(0, len(b), SQUARE[1]):
            part, x, y = np.zeros(out[i : i + SQUARE[0], j : j + SQUARE[1]].shape), a[i : i + SQUARE[0]], turned[:, j : j + SQUARE[1]]
            for k in range(a.shape[1]):
                part += term(x[:, k, None], y[k])
            out[i : i + SQUARE[0], j : j + SQUARE[1]] = part
    return out


def _rough(metric: str | Callable, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All distances (squared, for l2) by one matrix product, and how far each row's may be off, twice over.

    The vectors are moved so that the first of ``b`` is the origin where only differences count, so the
    bound follows from the spread of the vectors, not from where they lie. What the bound doesn't
    cover, by norms too small or too large, is NaN.
    """
    with np.errstate(all="ignore"):
        if callable(metric):
            return _summed(metric, a, b), np.zeros(len(a))
        if metric == "l2":
            a, b = a - b[0], b - b[0]
        na, nb = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
        inner, top = a @ b.T, nb.max()
        error = 16 * (a.shape[1] + 16) * np.finfo(np.float64).eps
        if metric == "l2":
            rough, slack = (na * na)[:, None] + nb * nb - 2 * inner, error * (na * na + top * top)
        elif metric == "ip":
            rough, slack = -inner, error * na * top
        else:
            sizes = na[:, None] * nb
            rough, slack = 1.0 - np.where(sizes == 0, 0.0, inner / np.where(sizes == 0, 1.0, sizes)), np.full(len(a), error)
        odd = lambda n: (n != 0) & ~((n > SAFE_NORM[0]) & (n < SAFE_NORM[1]))
        rough[odd(na)] = np.nan
        rough[:, odd(nb)] = np.nan
        return rough, np.where(np.isfinite(slack), slack, np.inf)


class Nearest:
    """The k nearest of each of a block of queries among the portions of a gallery seen so far."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, k: int, metric: str | Callable, same: bool):
        self.ids, self.labels, self.v, self.k, self.metric, self.same = ids, labels, vectors, k, metric, same
        self.n = np.zeros(len(ids), np.int64)
        self.d, self.g, self.gl = np.full((len(ids), k), np.nan), np.zeros((len(ids), k), np.int64), np.zeros((len(ids), k))

    def add(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        rows = max(1, TILE_BYTES // (8 * max(1, vectors.shape[1]) * 4))
        for j in range(0, len(ids), rows):
            g = slice(j, j + rows)
            step = max(1, TILE_BYTES // (8 * len(ids[g])))
            for i in range(0, len(self.ids), step):
                self._tile(slice(i, i + step), ids[g], labels[g], vectors[g])

    def _tile(self, q: slice, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        rough, slack = _rough(self.metric, self.v[q], vectors)
        own = self.ids[q][:, None] == ids if self.same else np.zeros((1, 1), bool)
        ranked = np.where(own | np.isnan(rough), np.inf, rough)
        at = min(self.k, rough.shape[1]) - 1
        bound = np.partition(ranked, at, axis=1)[:, at] if self.k <= rough.shape[1] else np.full(len(rough), np.inf)
        with np.errstate(all="ignore"):
            kept = np.where(self.n[q] == self.k, self.d[q, -1], np.inf)
            kept = np.where(np.isnan(kept), np.inf, kept * kept if self.metric == "l2" else kept)
            bound = np.minimum(bound, kept) + slack
        row, col = np.nonzero(~(rough > bound[:, None]) & ~own)  # NaN stays
        if not len(row):
            return
        size = max(1, TILE_BYTES // (8 * 4 * max(1, vectors.shape[1])))
        d = np.concatenate([_exact(self.metric, self.v[q][row[x : x + size]], vectors[col[x : x + size]]) for x in range(0, len(row), size)])
        old_row, old_col = np.nonzero(np.arange(self.k) < self.n[q][:, None])
        row = np.concatenate([row, old_row])
        d = np.concatenate([d, self.d[q][old_row, old_col]])
        g = np.concatenate([ids[col], self.g[q][old_row, old_col]])
        gl = np.concatenate([labels[col], self.gl[q][old_row, old_col]])
        order = np.lexsort((g, d, row))  # NaN comes last
        row, d, g, gl = row[order], d[order], g[order], gl[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank < self.k
        row, rank = row[keep], rank[keep]
        self.d[q][row, rank], self.g[q][row, rank], self.gl[q][row, rank] = d[keep], g[keep], gl[keep]
        self.n[q] = np.maximum(self.n[q], np.bincount(row, minlength=len(self.n[q])))

    def rows(self) -> pa.RecordBatch:
        row, rank = np.nonzero(np.arange(self.k) < self.n[:, None])
        label = lambda x: pa.array(x, pa.float64(), from_pandas=True).cast(pa.int32())
        columns = [pa.array(self.ids[row]), pa.array(self.g[row, rank]), label(self.labels[row]), label(self.gl[row, rank]), pa.array(self.d[row, rank])]
        return pa.RecordBatch.from_arrays(columns, names=["q", "g", "ql", "gl", "d"])


def _arrays(rows: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels (NaN for none) and vectors."""
    flat = rows["v"].combine_chunks() if isinstance(rows["v"], pa.ChunkedArray) else rows["v"]
    vectors = np.array(flat.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(rows.num_rows, -1)
    return rows["vec_id"].to_numpy(), np.asarray(rows["label"].to_pandas(), dtype=np.float64), vectors


def knn(queries: DataFrame, gallery: DataFrame, k: int, metric: str = "l2", same: bool = False) -> DataFrame:
    """Exact k nearest of each query by matrix products: q, g, ql, gl, d, rank.

    Queries of up to QUERY_BYTES are broadcast and the gallery stays where it is: a task gives its k
    nearest for each query, so what is shuffled is k rows a query and task. More of them, and the
    gallery, are dealt to blocks of BLOCK_BYTES that meet two by two on the executors, so nothing of
    either passes through the driver. A matrix product only rules out pairs that its rounding cannot
    bring among the k nearest; the others' distances are computed term by term, so they and their
    order equal those of ``knn_pairs`` to the bit. Registered metrics have no matrix product: those
    with a term are summed for all pairs, block by block, the others go by ``knn_pairs``.
    """
    form = metric if metric in BUILT_IN else TERMS.get(metric) if metric in METRICS else None
    if form is None:
        return knn_pairs(queries, gallery, k, metric, same)
    dim = width(gallery, "embedding")
    plain = lambda df: df.select(F.col("vec_id").cast("long"), F.col("label").cast("int"), doubles(F.col("embedding")).alias("v"))
    asked, gallery, n = plain(queries), plain(gallery), queries.count()
    if n * dim * 8 <= QUERY_BYTES:
        sent = gallery.sparkSession.sparkContext.broadcast(_arrays(asked.toArrow()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Nearest(*sent.value, k, form, same)
            for b in batches:
                if b.num_rows and len(best.ids):
                    best.add(*_arrays(b))
            yield best.rows()

        return _ranked(gallery.mapInArrow(run, FOUND), k)

    def meet(asked: pa.Table, rows: pa.Table) -> pa.Table:
        best = Nearest(*_arrays(asked), k, form, same)
        if rows.num_rows and len(best.ids):
            best.add(*_arrays(rows))
        return pa.Table.from_batches([best.rows()])

    nq, ng = _blocks(n, dim, BLOCK_BYTES), _blocks(gallery.count(), dim, BLOCK_BYTES)
    left, right = _dealt(asked, "qb", nq, "gb", ng), _dealt(gallery, "gb", ng, "qb", nq)
    return _ranked(left.groupBy("qb", "gb").cogroup(right.groupBy("qb", "gb")).applyInArrow(meet, FOUND), k)


def first_hits(queries: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Each query with the least rank of a neighbour of its class, null if there is none."""
    hits = neighbours.filter("ql = gl").groupBy("q").agg(F.min("rank").alias("first_hit"))
    return queries.select(F.col("vec_id").alias("q"), "label").join(hits, "q", "left")


def recall(queries: DataFrame, neighbours: DataFrame, ks: Sequence[int]) -> DataFrame:
    """One row: ``recall_k`` for each k, the share of queries with a neighbour of their class among the first k.

    All k share one ranking to the largest k. A query whose class the gallery lacks is a miss.
    """
    hits = first_hits(queries, neighbours)
    return hits.agg(*(F.avg((F.coalesce(F.col("first_hit"), F.lit(1 << 30)) <= k).cast("double")).alias(f"recall_{k}") for k in ks))


def recall_long(queries: DataFrame, neighbours: DataFrame, ks: Sequence[int]) -> DataFrame:
    """The same as rows (k, recall)."""
    wide = recall(queries, neighbours, ks)
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"recall_{k}").alias("recall")) for k in ks)))
    return wide.select(pairs.alias("r")).select("r.k", "r.recall")


def recall_per_class(queries: DataFrame, neighbours: DataFrame, ks: Sequence[int]) -> DataFrame:
    hits = first_hits(queries, neighbours)
    return hits.groupBy("label").agg(
        F.count(F.lit(1)).alias("n_queries"),
        *(F.avg((F.coalesce(F.col("first_hit"), F.lit(1 << 30)) <= k).cast("double")).alias(f"recall_{k}") for k in ks),
    )
