from __future__ import annotations

from lodestar.streaming import epoch_log

SCHEMA = "ts timestamp, run string, epoch long, metric double, loss double"


def finished(query):
    query.processAllAvailable()
    query.stop()


def test_stream(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "r", 0, 0.5, 0.9), ("2024-01-01 00:10:00", "r", 1, 0.5, 0.8), ("2024-01-01 02:00:00", "r", 2, 0.7, 0.85), ("2024-01-01 05:00:00", "r", 3, 0.6, 0.7)]
    for k in (0, 2):
        part = spark.createDataFrame([tuple(r) for r in rows[k : k + 2]], "ts string, run string, epoch long, metric double, loss double")
        part.selectExpr("cast(ts as timestamp) ts", "run", "epoch", "metric", "loss").coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    log = epoch_log.read_log(spark, f"{tmp_path}/log", SCHEMA)
    start = lambda df, name: df.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").start()
    finished(start(epoch_log.running_best(log), "best"))
    got = {r["epoch"]: (r["is_best_metric"], r["is_best_loss"]) for r in spark.table("best").collect()}
    assert got == {0: (True, True), 1: (False, True), 2: (True, False), 3: (False, True)}
    finished(start(epoch_log.windowed_metrics(log), "windows"))
    first = spark.table("windows").orderBy("since").first()  # the last windows are still open
    assert (first["epochs"], first["mean_metric"], first["best_metric"]) == (2, 0.5, 0.5)
