"""Triplet mining inside batches, triplet loss, and the best of a run.

A batch has a bounded number of rows (classes times items), so an anchor's partners fit in an array;
the number of batches is what grows. A batch's pairs are made in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.functions.hashing import draw
from lodestar.functions.vector import TRIPLET_SHIFT, doubles, width


def batch_pairs(batches: DataFrame, items: DataFrame, key: str = "vec_id") -> DataFrame:
    """Ordered pairs of different slots of a batch: batch, a, b, same, d, d_shifted.

    d: the distance that mining compares; d_shifted: that of the loss, which shifts each difference.
    Both are summed from left to right over a batch's pairs at once, in one call a batch.
    """
    width(items, "embedding")  # all of one length
    rows = batches.join(items.select(key, doubles(F.col("embedding")).alias("v")), key).select("batch", "slot", "label", "v")
    return rows.groupBy("batch").applyInArrow(_pairs, "batch long, a int, b int, same boolean, d double, d_shifted double")


def _pairs(rows: pa.Table) -> pa.Table:
    n, slot = rows.num_rows, rows["slot"].to_numpy()
    x = rows["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    d, shifted = np.zeros((n, n)), np.zeros((n, n))
    for column in x.T:
        gap = column[:, None] - column
        d += gap * gap
        shifted += (gap + TRIPLET_SHIFT) * (gap + TRIPLET_SHIFT)
    label = rows["label"].to_pandas()
    a, b = np.nonzero(slot[:, None] != slot)
    same = pa.array((label.to_numpy()[:, None] == label.to_numpy())[a, b], mask=(label.isna().to_numpy()[a] | label.isna().to_numpy()[b]))
    columns = [
        pa.array(np.full(len(a), rows["batch"][0].as_py(), np.int64)), pa.array(slot[a], pa.int32()), pa.array(slot[b], pa.int32()), same,
        pa.array(np.sqrt(d[a, b])), pa.array(np.sqrt(shifted[a, b])),
    ]
    return pa.Table.from_arrays(columns, names=["batch", "a", "b", "same", "d", "d_shifted"])


def positives(pairs: DataFrame) -> DataFrame:
    return pairs.filter("same").select("batch", "a", F.col("b").alias("p"), F.col("d").alias("d_ap"))


def negatives(pairs: DataFrame) -> DataFrame:
    return pairs.filter("not same").select("batch", "a", F.col("b").alias("n"), F.col("d").alias("d_an"))


def _anchors(pairs: DataFrame) -> DataFrame:
    """Each anchor with the arrays of its positives and negatives, both bounded by the batch."""
    p = F.when(F.col("same"), F.struct(F.col("b").alias("p"), F.col("d").alias("d_ap"), F.col("d_shifted").alias("s_ap")))
    n = F.when(~F.col("same"), F.struct(F.col("b").alias("n"), F.col("d").alias("d_an"), F.col("d_shifted").alias("s_an")))
    return pairs.groupBy("batch", "a").agg(F.collect_list(p).alias("ps"), F.collect_list(n).alias("ns"))


def _triplets(chosen: DataFrame, band) -> DataFrame:
    """Rows (batch, a, p, n, ...) of anchors' one positive ``pos`` with the negatives that ``band`` allows."""
    near = chosen.withColumn("neg", F.explode(F.filter("ns", band)))
    return near.select("batch", "a", "pos.p", "neg.n", "pos.d_ap", "neg.d_an", "pos.s_ap", "neg.s_an")


def semi_hard(pairs: DataFrame, margin: float) -> DataFrame:
    """Every positive with every negative that is further away, but by less than the margin (both strict)."""
    each = _anchors(pairs).select("batch", "a", "ns", F.explode("ps").alias("pos"))
    return _triplets(each, lambda x: (x["d_an"] > F.col("pos.d_ap")) & (x["d_an"] < F.col("pos.d_ap") + F.lit(float(margin))))


def hard(pairs: DataFrame, seed: int = 42, closest_only: bool = False) -> DataFrame:
    """One drawn positive for each anchor, with all negatives nearer than it (strict), or with the nearest one."""
    order = F.transform("ps", lambda x: F.struct(draw(f"p:{seed}", F.col("batch"), F.col("a"), x["p"]).alias("h"), x["p"].alias("i"), x.alias("x")))
    one = _anchors(pairs).select("batch", "a", "ns", F.array_min(order)["x"].alias("pos")).filter("pos is not null")
    if closest_only:
        first = F.array_min(F.transform("ns", lambda x: F.struct(x["d_an"].alias("d"), x["n"].alias("i"), x.alias("x"))))["x"]
        one = one.withColumn("ns", F.array(first))
    return _triplets(one, lambda x: x["d_an"] < F.col("pos.d_ap"))


def _loss(margin: float) -> Column:
    return F.greatest(F.col("s_ap") - F.col("s_an") + F.lit(float(margin)), F.lit(0.0))


def batch_stats(triplets: DataFrame, margin: float) -> DataFrame:
    """For each batch with triplets: their number, mean loss and mean shifted distances, multiplicity kept."""
    return triplets.groupBy("batch").agg(
        F.count(F.lit(1)).alias("triplets"), F.avg(_loss(margin)).alias("loss"),
        F.avg("s_ap").alias("mean_pos_dist"), F.avg("s_an").alias("mean_neg_dist"),
    )


def epoch_rollup(batches: DataFrame, stats: DataFrame) -> DataFrame:
    """Means of the batches' means over all batches, those without triplets counting as zero; and the sum of triplets."""
    all_batches = batches.select("batch").distinct()
    rows = all_batches.join(stats, "batch", "left").fillna(0)
    mean = lambda c: F.try_divide(F.sum(c), F.count(F.lit(1)))
    return rows.agg(
        mean("loss").alias("loss"), mean("mean_pos_dist").alias("mean_pos_dist"), mean("mean_neg_dist").alias("mean_neg_dist"),
        F.coalesce(F.sum("triplets"), F.lit(0)).alias("triplets_mined"), F.count(F.lit(1)).alias("batches"),
    )


def best_flags(log: DataFrame, run: str, epoch: str, metric: str, loss: str) -> DataFrame:
    """Adds is_best_metric, is_best_loss and is_last: whether an epoch beats all before it, strictly.

    Before the first epoch the best metric is 0 and the best loss is infinite.
    """
    before = W.partitionBy(run).orderBy(epoch).rowsBetween(W.unboundedPreceding, -1)
    top = F.greatest(F.coalesce(F.max(metric).over(before), F.lit(0.0)), F.lit(0.0))
    low = F.coalesce(F.min(loss).over(before), F.lit(float("inf")))
    last = F.max(epoch).over(W.partitionBy(run))
    return log.select(
        "*", (F.col(metric) > top).alias("is_best_metric"), (F.col(loss) < low).alias("is_best_loss"), (F.col(epoch) == last).alias("is_last")
    )


def best_final(flags: DataFrame, run: str, epoch: str) -> DataFrame:
    """For each run the epochs whose weights the three checkpoints hold in the end; null if none qualified."""
    pick = lambda c: F.max(F.when(F.col(c), F.col(epoch)))
    return flags.groupBy(run).agg(
        pick("is_best_metric").alias("best_metric_epoch"), pick("is_best_loss").alias("best_loss_epoch"), pick("is_last").alias("last_epoch")
    )
