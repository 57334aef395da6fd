"""Class-balanced batches and other seeded draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.hashing import draw
from lodestar.operators.ranking import place
from lodestar.operators.splits import class_index
from lodestar.sources.shared import settle


class TooFewClasses(ValueError):
    """No batch can be made."""


def _distinct_draws(n: Column, k: int, seed: str, batch: Column) -> Column:
    """``k`` different numbers below ``n``, by Floyd's algorithm: no row for each candidate."""

    def step(drawn: Column, i: Column) -> Column:
        top = n - k + i
        t = draw(seed, batch, i) % (top + 1)
        return F.array_append(drawn, F.when(F.array_contains(drawn, t), top).otherwise(t))

    return F.aggregate(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")), F.array().cast("array<long>"), step)


def pk_index(items: DataFrame, label: str = "label", key: str = "vec_id") -> DataFrame:
    """What ``pk_batches`` draws from: each item's place ``pos`` among its class's ``n``, and its class's ``rank``. Settled, for many epochs."""
    index = class_index(items.select(label, key), label, key)
    classes = place(index.select(label).distinct(), [], label).select(label, F.col("_place").alias("rank"))
    return settle(index.join(classes, index[label].eqNullSafe(classes[label])).select(index[label], key, "pos", "n", "rank"), "class-index")


def pk_batches(
    items: DataFrame | None, n_classes: int, n_items: int, seed: int = 42, label: str = "label", key: str = "vec_id", index: DataFrame | None = None
) -> DataFrame:
    """Batches of ``n_classes`` classes times ``n_items`` items: batch, slot, key, label.

    There are (classes // n_classes) batches, each with its own draw of different classes, and from
    each class a circular run of items from a seeded start, so a small class repeats its items; rows
    are told apart by ``slot``. Too few classes for one batch is an error. ``index``: of ``pk_index``,
    where several epochs draw from the same items.
    """
    index = pk_index(items, label, key) if index is None else index
    classes = index.filter("pos = 0").select(label, "rank", "n")
    total = classes.count()
    if total < n_classes:
        raise TooFewClasses(f"{total} classes are too few for batches of {n_classes}")
    batches = index.sparkSession.range(total // n_classes).withColumnRenamed("id", "batch")
    drawn = batches.select("batch", F.posexplode(_distinct_draws(F.lit(total).cast("long"), n_classes, f"c:{seed}", F.col("batch"))).alias("c", "rank"))
    chosen = drawn.join(classes, "rank").withColumn("start", draw(f"s:{seed}", F.col("batch"), F.col(label)) % F.col("n"))
    slots = chosen.select(
        "batch", "c", "rank", "n", "start", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_items - 1).cast("long"))).alias("k")
    ).withColumn("pos", (F.col("start") + F.col("k")) % F.col("n"))
    found = slots.join(index.select("rank", label, key, "pos"), ["rank", "pos"])
    return found.select("batch", (F.col("c") * n_items + F.col("k")).cast("int").alias("slot"), key, label)


def pick(rows: DataFrame, pool: DataFrame, rank: str, *parts: Column | str | int) -> DataFrame:
    """Each row joined to a uniformly drawn row of ``pool``, whose ``rank`` runs from 0 without gaps."""
    n = pool.count()
    if not n:
        raise ValueError("the pool is empty")
    return rows.withColumn(rank, draw(*parts) % n).join(pool, rank)


def augment_plan(images: DataFrame, backgrounds: DataFrame, copies: int = 4, seed: int = 42) -> DataFrame:
    """``copies`` outputs of each image (path, class_name), each with a drawn background and its file name."""
    fan = images.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    ranked = place(backgrounds.select("photo_image_url"), [], "photo_image_url").withColumnRenamed("_place", "bg")
    plan = pick(fan, ranked.select("bg", "photo_image_url"), "bg", f"bg:{seed}", F.col("path"), F.col("n"))
    name = F.concat_ws("-", F.col("n").cast("string"), F.element_at(F.split("path", "/"), -1))
    return plan.select("path", "class_name", "n", name.alias("out_name"), "bg", "photo_image_url")


def unfinished(plan: DataFrame, outputs: DataFrame, enough: int = 16) -> DataFrame:
    """The plan without classes that already have ``enough`` files in ``outputs`` (class_name)."""
    done = outputs.groupBy("class_name").agg(F.count(F.lit(1)).alias("files")).filter(F.col("files") >= enough)
    return plan.join(done, "class_name", "left_anti")
