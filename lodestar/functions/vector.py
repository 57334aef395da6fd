"""Distances, normalisation and pooling over ``array<double>`` columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Below this, a norm counts as this in ``l2_normalize``; the shift of differences in a triplet's distances.
NORM_FLOOR, TRIPLET_SHIFT = 1e-12, 1e-6
#: Widest vector whose distance is written out term by term, inside whole-stage code.
UNROLL = 256


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def width(df: DataFrame, column: str) -> int:
    """The one length of all vectors; raises if lengths differ or a vector is missing."""
    row = df.agg(F.min(F.size(column)).alias("a"), F.max(F.size(column)).alias("z"), F.count_if(F.col(column).isNull()).alias("none")).first()
    if row["none"] or row["a"] != row["z"]:
        raise ValueError(f"vectors of {column} must all be of one length: {row['a']} to {row['z']}, {row['none']} missing")
    return row["a"] or 0


def _sum(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms, F.lit(0.0))


def l2(a: Column, b: Column, dim: int | None = None, shift: float = 0.0) -> Column:
    """Euclidean distance, summed from left to right; ``shift`` is added to each difference."""
    if dim and dim <= UNROLL:
        steps = [F.get(a, F.lit(k)) - F.get(b, F.lit(k)) + (F.lit(shift) if shift else F.lit(0.0)) for k in range(dim)]
        return F.sqrt(_sum([s * s for s in steps]))
    squares = F.zip_with(a, b, lambda x, y: (x - y + F.lit(shift)) * (x - y + F.lit(shift)))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def dot(a: Column, b: Column, dim: int | None = None) -> Column:
    if dim and dim <= UNROLL:
        return _sum([F.get(a, F.lit(k)) * F.get(b, F.lit(k)) for k in range(dim)])
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column, dim: int | None = None) -> Column:
    return F.sqrt(dot(v, v, dim))


def cosine_distance(a: Column, b: Column, dim: int | None = None) -> Column:
    """1 - cosine; 1 where a vector is zero."""
    return F.lit(1.0) - F.coalesce(F.try_divide(dot(a, b, dim), norm(a, dim) * norm(b, dim)), F.lit(0.0))


def negative_dot(a: Column, b: Column, dim: int | None = None) -> Column:
    return -dot(a, b, dim)


#: Kernels that rank neighbours, smaller is nearer. New ones can be registered.
BUILT_IN = {"l2": l2, "cosine": cosine_distance, "ip": negative_dot}
METRICS = dict(BUILT_IN)
#: Of registered metrics that are sums over components: a component's term on arrays.
TERMS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {}


def register_metric(name: str, kernel, term: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> None:
    """``kernel(a, b, dim)``: a Column to rank by; usable by name in the exact search.

    ``term(x, y)``: where the metric is the sum of a term of each component, that term on NumPy arrays,
    element by element; the search by blocks then takes it in place of the kernel, many pairs at a time.
    """
    if name in BUILT_IN:
        raise ValueError(f"{name} is built in")
    METRICS[name] = kernel
    TERMS.pop(name, None)
    if term:
        TERMS[name] = term


def l2_normalize(v: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    return F.transform(F.array(F.greatest(norm(v), F.lit(NORM_FLOOR))), lambda n: F.transform(v, lambda x: x / n))[0]


def l2_normalize_raw(v: Column) -> Column:
    """Unit length without a floor; a zero vector becomes NaN."""
    nan = F.lit(float("nan"))
    return F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: F.coalesce(F.try_divide(x, n), nan)))[0]


def conditional_normalize(v: Column, is_unit: Column) -> Column:
    """Normalised unless the model did so already."""
    return F.when(is_unit, v).otherwise(l2_normalize(v))


def tokens(v: Column, n: int, dim: int) -> Column:
    """A flat vector cut into ``n`` tokens of ``dim``."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.slice(v, k * dim + 1, dim))


def mean_pool(parts: Column, dim: int) -> Column:
    """Element-wise mean of an array of vectors."""
    zero = F.array_repeat(F.lit(0.0), dim)
    total = F.aggregate(parts, zero, lambda s, x: F.zip_with(s, x, lambda p, q: p + q))
    return F.transform(total, lambda x: x / F.size(parts))


def pooled(pooler: Column, parts: Column, dim: int) -> Column:
    """The pooler's output if there is one, else the mean over tokens."""
    return F.coalesce(pooler, mean_pool(parts, dim))


def register_sql(spark: SparkSession) -> None:
    """``l2_distance``, ``cosine_distance``, ``inner_product`` and ``l2_normalize`` as SQL functions without Python."""
    add = "aggregate(zip_with(a, b, (x, y) -> {}), 0.0D, (s, x) -> s + x)"
    inner = add.format("x * y")
    own = "sqrt(aggregate({0}, 0.0D, (s, x) -> s + x * x))"
    bodies = {
        "l2_distance": f"sqrt({add.format('(x - y) * (x - y)')})",
        "inner_product": inner,
        "cosine_distance": f"1.0D - coalesce(try_divide({inner}, {own.format('a')} * {own.format('b')}), 0.0D)",
    }
    for name, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN {body}")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION l2_normalize(a ARRAY<DOUBLE>) RETURNS ARRAY<DOUBLE> "
        f"RETURN transform(a, x -> x / greatest({own.format('a')}, {NORM_FLOOR!r}D))"
    )
