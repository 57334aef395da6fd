"""Labelled image folders, tables and parameters in; checkpoints, metrics, images and data sets out."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.image import png, resized
from lodestar.operators.ranking import place
from lodestar.schema import EngineConfig
from lodestar.sources.shared import settle


def class_of(path: Column) -> Column:
    """The name of the folder that a file lies in."""
    return F.try_element_at(F.split(path, "/"), F.lit(-2))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _classes(files: DataFrame) -> DataFrame:
    """(class_name, label) of ``files`` (path): classes numbered by name."""
    names = files.select(class_of(F.col("path")).alias("class_name")).distinct()
    return place(names, [], "class_name").select("class_name", F.col("_place").cast("int").alias("label"))


def with_labels(files: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """``files`` (path, more) with item_id (a hash: the path is the key), class_name and label."""
    rows = files.withColumns({"class_name": class_of(F.col("path")), "item_id": F.xxhash64("path")})
    return rows.join(_classes(files) if classes is None else classes, "class_name")


def _listed(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").load(f"{root.rstrip('/')}/*/*").select("path")


def labelled_files(spark: SparkSession, root: str) -> DataFrame:
    """Every file in the folders of ``root``, one folder a class: item_id, path, class_name, label.

    Files directly in ``root`` have no class and are left out. Contents are not read.
    """
    return with_labels(_listed(spark, root)).select("item_id", "path", "class_name", "label")


def labelled_images(spark: SparkSession, root: str, cache: bool = False, size: int = 224) -> DataFrame:
    """The same with the decoded ``image``, decoded when read; if ``cache``, resized to a square of ``size`` and kept on the executors.

    Classes come from the listing, so no image is decoded for them.
    """
    images = spark.read.format("image").option("dropInvalid", True).load(f"{root.rstrip('/')}/*/*")
    rows = with_labels(images.withColumn("path", F.col("image.origin")), _classes(_listed(spark, root)))
    rows = rows.select("item_id", "path", "class_name", "label", "image")
    return resized(rows, size).persist() if cache else rows


def images_at(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.format("image").load(list(paths))


def tab_separated(spark: SparkSession, path: str) -> DataFrame:
    """A table with a header, all columns strings."""
    return spark.read.csv(path, sep="\t", header=True)


def parameters(spark: SparkSession, path: str) -> EngineConfig:
    """Parameters from a YAML file in any store that Spark reads."""
    import yaml

    text = spark.read.text(path, wholetext=True).first()
    return EngineConfig.from_mapping(yaml.safe_load(text["value"]) or {} if text else {})


def append_metrics(rows: DataFrame, path: str) -> None:
    """The epoch log: one folder for each run."""
    rows.write.mode("append").partitionBy("run").parquet(path)


def print_metrics(rows: DataFrame, n: int = 20) -> None:
    """The last ``n`` rows of an epoch log to the standard output."""
    rows.orderBy(F.desc("epoch")).limit(n).orderBy("epoch").show(n, truncate=False)


def save_dataset(rows: DataFrame, table: str, points: DataFrame | None = None, key: str = "vec_id") -> None:
    """Replace a table of items with labels and vectors; ``points`` (key, x, y) of a map are attached by key."""
    rows = rows if points is None else rows.join(points, key, "left")
    rows.write.mode("overwrite").saveAsTable(table)


def save_images(images: DataFrame, root: str) -> DataFrame:
    """``images`` (class_name, out_name, content) as files ``root``/class_name/out_name; (path, bytes) of each.

    ``root``: a URI of a store that pyarrow reaches from every executor. A file is written beside its
    place and then moved there, so a task that runs twice leaves whole files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(root.rstrip("/"))
        for b in batches:
            paths, sizes = [], []
            for folder, name, content in zip(*(b[c].to_pylist() for c in ("class_name", "out_name", "content")), strict=True):
                store.create_dir(f"{top}/{folder}", recursive=True)
                beside = f"{top}/{folder}/.{name}-{uuid.uuid4().hex}"
                with store.open_output_stream(beside) as out:
                    out.write(content)
                store.move(beside, f"{top}/{folder}/{name}")
                paths.append(f"{root.rstrip('/')}/{folder}/{name}")
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["path", "bytes"])

    return settle(images.select("class_name", "out_name", "content").mapInArrow(run, "path string, bytes long"), "saved-images")


def encode_png(tensors: DataFrame) -> DataFrame:
    """``tensors`` (class_name, out_name, height, width, rgb array<float>) with ``content``, a PNG."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [png(np.array(rgb.as_py()).reshape(h, w, 3)) for h, w, rgb in zip(b["height"].to_pylist(), b["width"].to_pylist(), b["rgb"], strict=True)]
            yield pa.RecordBatch.from_arrays([b["class_name"], b["out_name"], pa.array(out, pa.binary())], names=["class_name", "out_name", "content"])

    return tensors.select("class_name", "out_name", "height", "width", "rgb").mapInArrow(run, "class_name string, out_name string, content binary")
