"""Places of rows in an order, without a window that holds a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.sources.shared import settle


def place(rows: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    """Adds ``_place`` (from 0, by ``key`` within the group ``by``) and ``_size`` (of the group).

    One shuffle by range of group and key, so a group with a third of all rows is spread over a third
    of the tasks. A task numbers its own rows; what it adds to them comes from a table of one row for
    each task and group. The numbered rows are settled, since both sides must see the same ranges.
    """
    names = [f"`{c}`" for c in rows.columns]
    ordered = rows.repartitionByRange(*(F.col(c) for c in (*by, key))).sortWithinPartitions(*by, key)
    numbered = settle(ordered.withColumn("_id", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_id", 33)  # the task's number; the low bits count its rows
    spans = numbered.groupBy(part.alias("_part"), *by).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    group = W.partitionBy(*by)
    before = F.sum("_n").over(group.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    spans = spans.select("_part", "_first", *(F.col(c).alias(f"_by_{c}") for c in by), F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(group).alias("_size"))
    same = F.col("_own") == F.col("_part")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    joined = numbered.withColumn("_own", part).join(spans, same)
    return joined.select(*names, (F.col("_id") - F.col("_first") + F.col("_before")).alias("_place"), "_size")
