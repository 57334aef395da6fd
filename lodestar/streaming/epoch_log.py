"""The epoch log as a stream: metrics of runs as they arrive, and each run's best so far.

Batch queries over a finished log are in ``lodestar.operators.mining``; these keep a live one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of parquet files as they appear in ``path``."""
    return spark.readStream.schema(schema).parquet(path)


def windowed_metrics(log: DataFrame, time: str = "ts", run: str = "run", metric: str = "metric", late: str = "10 minutes", every: str = "1 hour") -> DataFrame:
    """Count, mean and best metric of each run and window; rows later than ``late`` are dropped with their window's state."""
    return (
        log.withWatermark(time, late)
        .groupBy(F.window(time, every), F.col(run))
        .agg(F.count(F.lit(1)).alias("epochs"), F.avg(metric).alias("mean_metric"), F.max(metric).alias("best_metric"))
        .select(F.col("window.start").alias("since"), F.col(run).alias("run"), "epochs", "mean_metric", "best_metric")
    )


def running_best(log: DataFrame, run: str = "run", epoch: str = "epoch", metric: str = "metric", loss: str = "loss") -> DataFrame:
    """Each new epoch with whether it beats its run's best so far; state: two numbers for each run."""

    def judge(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        top, low = state.get if state.exists else (0.0, float("inf"))
        rows = pd.concat(list(frames)).sort_values("epoch")
        out = []
        for e, m, x in zip(rows["epoch"], rows["metric"], rows["loss"], strict=True):
            out.append((key[0], int(e), bool(m > top), bool(x < low)))
            top, low = max(top, float(m)), min(low, float(x))
        state.update((top, low))
        yield pd.DataFrame(out, columns=["run", "epoch", "is_best_metric", "is_best_loss"])

    named = log.select(F.col(run).cast("string").alias("run"), F.col(epoch).cast("long").alias("epoch"), F.col(metric).alias("metric"), F.col(loss).alias("loss"))
    return named.groupBy("run").applyInPandasWithState(
        judge, "run string, epoch long, is_best_metric boolean, is_best_loss boolean", "top double, low double", "append", GroupStateTimeout.NoTimeout
    )
