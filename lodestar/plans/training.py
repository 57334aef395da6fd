"""Training of the projection head, and the search for its parameters."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace as dc_replace
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.hashing import uniform
from lodestar.functions.vector import TRIPLET_SHIFT, doubles, width
from lodestar.operators.head import Head
from lodestar.operators.sampling import TooFewClasses, pk_batches, pk_index
from lodestar.operators.search import knn, recall
from lodestar.schema import EPOCH_LOG, EngineConfig
from lodestar.sources.shared import settle

#: Bytes of the vectors of batches that reach the driver at a time.
BATCH_BYTES = 32 << 20


def semi_hard(y: np.ndarray, labels: np.ndarray, margin: float) -> np.ndarray:
    """Rows (anchor, positive, negative) of one batch."""
    gaps = y[:, None, :] - y[None, :, :]
    d = np.sqrt((gaps * gaps).sum(axis=2))
    same = labels[:, None] == labels
    a, p = np.nonzero(same & ~np.eye(len(y), dtype=bool))
    near = ~same[a] & (d[a] > d[a, p][:, None]) & (d[a] < d[a, p][:, None] + margin)
    k, n = np.nonzero(near)
    return np.stack([a[k], p[k], n], axis=1)


def triplet_loss(y: np.ndarray, triplets: np.ndarray, margin: float) -> tuple[float, np.ndarray, float, float]:
    """Mean loss, its gradient by ``y``, and the mean distances to positives and to negatives."""
    a, p, n = triplets.T
    up, un = y[a] - y[p] + TRIPLET_SHIFT, y[a] - y[n] + TRIPLET_SHIFT
    dp, dn = np.linalg.norm(up, axis=1), np.linalg.norm(un, axis=1)
    loss = np.maximum(dp - dn + margin, 0)
    on = (loss > 0)[:, None] / len(triplets)
    up, un = on * up / np.maximum(dp, 1e-300)[:, None], on * un / np.maximum(dn, 1e-300)[:, None]
    grad = np.zeros_like(y)
    np.add.at(grad, a, up - un)
    np.add.at(grad, p, -up)
    np.add.at(grad, n, un)
    return float(loss.mean()), grad, float(dp.mean()), float(dn.mean())


def _batches(items: DataFrame, batches: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Batch by batch, about BATCH_BYTES of them at a time."""
    rows = batches.join(items.select("vec_id", doubles(F.col("embedding")).alias("v")), "vec_id")
    parts = 1 + batches.count() * width(items, "embedding") * 8 // BATCH_BYTES
    rows = rows.repartitionByRange(parts, "batch").sortWithinPartitions("batch", "slot").select("batch", "label", "v")
    for _, own in groupby(rows.toLocalIterator(), key=lambda r: r["batch"]):
        own = list(own)
        yield np.array([r["v"] for r in own]), np.array([r["label"] for r in own])


def train_epoch(head: Head, items: DataFrame, batches: DataFrame, config: EngineConfig, epoch: int) -> dict:
    """One pass over the batches in order; means over all of them, those without triplets counted as zero.

    ``losses``: of each batch that has triplets; the others take no step.
    """
    rng = np.random.default_rng([config.seed, epoch])
    total, n, mined, losses = np.zeros(3), 0, 0, []
    for x, labels in _batches(items, batches):
        n += 1
        y, tape = head.forward(x, rng)
        triplets = semi_hard(y, labels, config.margin)
        if not len(triplets):
            continue
        loss, grad, dp, dn = triplet_loss(y, triplets, config.margin)
        head.step(head.backward(grad, tape), config.lr, config.weight_decay)
        total += loss, dp, dn
        mined += len(triplets)
        losses.append(loss)
    loss, dp, dn = (total / max(1, n)).tolist()
    return {"loss": loss, "mean_pos_dist": dp, "mean_neg_dist": dn, "triplets_mined": mined, "losses": losses}


def evaluate(head: Head, gallery: DataFrame, queries: DataFrame, ks: tuple[int, ...]) -> dict[int, float]:
    """Recall@k of embedded queries; both sides are embedded once."""
    queries, gallery = settle(head.embed(queries), "embedded"), settle(head.embed(gallery), "embedded")
    row = recall(queries, knn(queries, gallery, max(ks)), ks).first()
    return {k: row[f"recall_{k}"] for k in ks}


def train(items: DataFrame, config: EngineConfig, head: Head | None = None) -> tuple[Head, list[float]]:
    """The simple trainer: Adam without decay; the head and the loss of each batch that has triplets, in order."""
    head = head or _head(items, config)
    plain, index, losses = dc_replace(config, weight_decay=0.0), pk_index(items), []
    for epoch in range(config.epochs):
        batches = settle(pk_batches(None, config.classes_per_batch, config.items_per_class, config.seed + epoch, index=index), "batches")
        losses += train_epoch(head, items, batches, plain, epoch)["losses"]
    return head, losses


def _head(items: DataFrame, config: EngineConfig) -> Head:
    return Head.random(width(items, "embedding"), config.hidden_dim, config.output_dim, config.normalize, config.dropout, config.seed)


def train_and_evaluate(train_items: DataFrame, val_items: DataFrame, config: EngineConfig, run: str = "run", save_to: str | None = None, full_gallery: bool = False, report: Callable[[str], None] | None = None) -> tuple[Head, list[dict]]:
    """Head and epoch log: each epoch's losses and Recall@k of ``val_items``.

    The gallery is the epoch's sampled batches, not all training rows, unless ``full_gallery``.
    ``save_to``: where the best-by-recall, best-by-loss and last weights go; ``report`` (``print``,
    say) gets a line for each new best recall.
    """
    spark, head, log, index = train_items.sparkSession, _head(train_items, config), [], pk_index(train_items)
    best_recall, best_loss = 0.0, float("inf")
    for epoch in range(config.epochs):
        batches = settle(pk_batches(None, config.classes_per_batch, config.items_per_class, config.seed + epoch, index=index), "batches")
        row = {"run": run, "epoch": epoch} | train_epoch(head, train_items, batches, config, epoch)
        gallery = train_items if full_gallery else batches.select("vec_id", "batch", "slot").join(train_items, "vec_id")
        # a sampled item may occur in several slots; each is a row of the gallery
        row["recall"] = evaluate(head, gallery.select("vec_id", "label", "embedding"), val_items, config.recall_k)
        log.append(row)
        mean = sum(row["recall"].values()) / len(row["recall"])
        if report and mean > best_recall:
            report(f"epoch {epoch}: new best mean recall {mean:.4f}")
        if save_to:
            for tag, better in (("best", mean > best_recall), ("best_loss", row["loss"] < best_loss), ("last", True)):
                if better:
                    head.save(spark, save_to, run, tag)
        best_recall, best_loss = max(best_recall, mean), min(best_loss, row["loss"])
    return head, log


def log_frame(spark: SparkSession, log: list[dict]) -> DataFrame:
    names = [x.split()[0] for x in EPOCH_LOG.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in log], EPOCH_LOG)


#: The default space of a search, bounds of draws and choices: fixed values.
SPACE = {
    "epochs": ("int", 1, 50),
    "lr": ("log", 1e-6, 1e-4),
    "weight_decay": ("log", 1e-7, 1e-4),
    "margin": ("float", 0.5, 2.0),
    "dropout": ("float", 0.0, 0.5),
    "output_dim": ("choice", 32, 64, 128, 256),
    "hidden_dim": ("choice", 256, 512),
    "P": ("choice", 4, 8, 16, 32),
    "K": ("choice", 4, 8, 16),
}


def space_of(tree: dict) -> dict:
    """The space with the lists of a nested mapping, as a YAML file of a search has them."""
    found = dict(SPACE)
    for key, value in tree.items():
        if isinstance(value, dict):
            found |= {k: v for k, v in space_of(value).items() if v != SPACE[k]}
        elif key in SPACE and isinstance(value, (list, tuple)):
            found[key] = (SPACE[key][0], *value)
    return found


def trials(spark: SparkSession, n: int, space: dict = SPACE, seed: int = 42) -> DataFrame:
    """``n`` random trials as a table: trial_id and a column for each parameter."""
    out = spark.range(n).withColumnRenamed("id", "trial_id")
    for name, (kind, *bounds) in space.items():
        u = uniform(f"t:{seed}", F.col("trial_id"), name)
        low, high = (F.lit(float(x)) for x in (bounds[0], bounds[-1]))
        if kind == "int":
            c = (F.lit(bounds[0]) + F.floor(u * (bounds[1] - bounds[0] + 1))).cast("int")
        elif kind == "log":
            c = F.exp(F.log(low) + u * (F.log(high) - F.log(low)))
        elif kind == "float":
            c = low + u * (high - low)
        else:
            c = F.get(F.array(*map(F.lit, bounds)), F.floor(u * len(bounds)).cast("int"))
        out = out.withColumn(name, c)
    return out


def best(rows: DataFrame, objective: str = "objective", key: str = "trial_id") -> DataFrame:
    """The one row with the highest objective, the least key among equals; rows without one come last."""
    return rows.orderBy(F.desc_nulls_last(objective), key).limit(1)


def search(spark: SparkSession, objective: Callable[[dict], float | None], n: int, space: dict = SPACE, seed: int = 42) -> DataFrame:
    """Random search: each trial's parameters with its objective, one trial after the other."""
    table = trials(spark, n, space, seed)
    rows = [(*r, objective(r.asDict())) for r in table.orderBy("trial_id").collect()]  # n rows, a parameter
    return spark.createDataFrame(rows, table.schema.simpleString()[7:-1].replace(":", " ") + ", objective double")


def tune(
    train_items: DataFrame, val_items: DataFrame, gallery: DataFrame, test_items: DataFrame, n: int, config: EngineConfig | None = None,
    space: dict = SPACE, seed: int = 42, full_gallery: bool = False, report: Callable[[str], None] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Random search for the head's parameters: the trials, and every epoch's log.

    A trial trains a fresh head. Its objective, to be the highest (``best``), is the mean validation
    recall of its last epoch; ``test_recall`` is that of ``test_items`` in ``gallery``, logged and not
    searched for. A trial whose batches need more classes than there are has neither.
    """
    spark, config, logs, test = train_items.sparkSession, config or EngineConfig(), [], {}
    sides = [settle(side.select("vec_id", "label", "embedding"), "tuned") for side in (train_items, val_items, gallery, test_items)]

    def objective(trial: dict) -> float | None:
        names = {"P": "classes_per_batch", "K": "items_per_class"}
        own = dc_replace(config, **{names.get(k, k): v for k, v in trial.items() if k != "trial_id"})
        try:
            head, log = train_and_evaluate(sides[0], sides[1], own, f"trial-{trial['trial_id']}", full_gallery=full_gallery)
        except TooFewClasses:
            return None
        logs.extend(log)
        test[trial["trial_id"]] = evaluate(head, sides[2], sides[3], own.recall_k)
        if report:
            report(f"trial {trial['trial_id']}: test recall {test[trial['trial_id']]}")
        return sum(log[-1]["recall"].values()) / len(log[-1]["recall"])

    found = search(spark, objective, n, space, seed)
    tested = spark.createDataFrame(list(test.items()), "trial_id long, test_recall map<int,double>")
    return found.join(tested, "trial_id", "left"), log_frame(spark, logs)
