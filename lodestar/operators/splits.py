"""Seeded stratified splits into queries and gallery (test and train), class indexes, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.functions.hashing import draw
from lodestar.operators.ranking import place


def _off(pos: Column, start: Column, n: Column) -> Column:
    """How far ``pos`` lies beyond ``start`` on a circle of ``n``."""
    return (pos - start + n) % n


def per_class(items: DataFrame, ratio: float, seed: int = 42, label: str = "label", key: str = "vec_id", group: str | None = None) -> DataFrame:
    """Adds ``is_query``: in each class a circular run of ``floor(n * ratio)`` items from a seeded start.

    With ``group``, rows that share a group (copies of one source) fall on the same side: groups take
    the place of items. Only labels and keys are put in order; the items meet their side in one join.
    """
    unit = group or key
    rows = place(items.select(label, unit).distinct(), [label], unit)
    start = draw(f"split:{seed}", F.col(label)) % F.col("_size")
    size = F.floor(F.col("_size") * F.lit(float(ratio)))
    sides = rows.select(F.col(label).alias("_label"), F.col(unit).alias("_unit"), (_off(F.col("_place"), start, F.col("_size")) < size).alias("is_query"))
    return items.join(sides, F.col(label).eqNullSafe(F.col("_label")) & F.col(unit).eqNullSafe(F.col("_unit"))).select(items["*"], "is_query")


def positional(items: DataFrame, ratio: float, seed: int = 42, label: str = "label", key: str = "vec_id") -> DataFrame:
    """Adds ``block`` and ``side`` (test, train, dropped) as of the rows' order by label and key.

    There are as many equal blocks as classes; each block's test rows are a circular run; rows beyond
    the last whole block belong to neither side. A row's global number is its place in its class and
    the sizes of the classes before.
    """
    rows = place(items, [label], key)
    classes = rows.groupBy(label).agg(F.first("_size").alias("c"))
    shape = classes.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("classes")).first()
    n_classes = max(1, shape["classes"])
    block_rows = shape["rows"] // n_classes
    test = int(block_rows * ratio)
    before = W.orderBy(label).rowsBetween(W.unboundedPreceding, -1)  # one row for each class
    classes = classes.select(F.col(label).alias("_l"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("_before"))
    rows = rows.join(classes, F.col(label).eqNullSafe(F.col("_l")))
    rows = rows.withColumn("_rn", F.col("_before") + F.col("_place"))
    rows = rows.withColumn("block", F.floor(F.try_divide(F.col("_rn"), F.lit(block_rows))).cast("long"))
    n = F.lit(max(1, block_rows)).cast("long")
    offset = _off(F.col("_rn") % n, draw(f"pos:{seed}", F.col("block")) % n, n)
    side = F.when((F.col("block") >= n_classes) | F.col("block").isNull(), "dropped").when(offset < test, "test").otherwise("train")
    return rows.withColumn("side", side).drop("_l", "_before", "_rn", "_place", "_size")


def class_counts(items: DataFrame, label: str = "label") -> DataFrame:
    return items.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def class_index(items: DataFrame, label: str = "label", key: str = "vec_id") -> DataFrame:
    """The inverted index as rows: each item's place ``pos`` among its class's ``n`` items."""
    return place(items, [label], key).withColumnsRenamed({"_place": "pos", "_size": "n"})


def subset_index(items: DataFrame, subset: DataFrame, label: str = "label", key: str = "vec_id") -> DataFrame:
    """``class_index`` of the items whose key is in ``subset``; classes without one vanish."""
    return class_index(items.join(subset.select(key), key, "left_semi"), label, key)


def batch_scan(items: DataFrame, size: int, key: str = "vec_id") -> DataFrame:
    """Consecutive batches by key, the last one short: ``batch`` and ``slot``."""
    rows = place(items, [], key)
    rows = rows.withColumn("batch", F.floor(F.col("_place") / size).cast("long"))
    return rows.withColumn("slot", (F.col("_place") % size).cast("int")).drop("_place", "_size")
