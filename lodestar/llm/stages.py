"""The operators as steps of a pipeline: documents in, documents out.

Nulls and corners, for every stage: a null text counts as an empty one, so the rules reject it (no
words) and, had it got that far, it would be a near-duplicate of other wordless texts, never
contaminated, and packed as one end id. Rows without or with the same doc_id are rows of their own:
no stage joins by doc_id but the classifier's fit, which reads labels. Repeated rows are copies of
each other, of which one stays; ties between copies go to the first row in the table. Very long
texts are worked on whole. An empty table, or empty labels or benchmark, gives no row, or rejects
none. Stages but the last keep all columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontaminate, host_rules, packing, quality, simhash
from lodestar.sources.shared import settle


def _fresh(docs: DataFrame, name: str) -> str:
    """``name``, longer as long as a column of ``docs`` begins with it."""
    while any(c.lower().startswith(name) for c in docs.columns):
        name += "_"
    return name


def _own(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier accepts, learned from the labels of these documents."""
    return quality.keep(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep, their hosts' verdicts included."""
    name = _fresh(docs, "rules")
    return host_rules.verdicts(docs, name).filter(F.col(name)["kept"]).select(*_own(docs))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates.

    Rows get numbers of their own, written once with the rows and their fingerprints, so repeated or
    missing ids don't matter. The numbers of the rows that go are written before the rows meet them:
    texts are shuffled by number only where those are too many for Spark to broadcast.
    """
    row = _fresh(docs, "row")
    fp = f"{row}_fp"
    rows = settle(simhash.with_fingerprints(docs.withColumn(row, F.monotonically_increasing_id()), fp), "numbered")
    prints = rows.select(F.col(row).alias("doc_id"), F.col(fp).alias("fp"))
    gone = prints.join(simhash.groups(prints), "fp").filter("doc_id != component_id").select(F.col("doc_id").alias(row))
    return rows.join(settle(gone, "copies"), row, "left_anti").select(*_own(docs))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the benchmark doesn't contaminate.

    Contamination depends on the text alone, so the index names a text by its md5. The names of
    contaminated texts are written before the rows meet them: texts are shuffled only where those
    are too many for Spark to broadcast.
    """
    name = _fresh(docs, "name")
    index = settle(decontaminate.build_index(docs.select(F.md5("text").alias("doc_id"), "text")), "positional-index")
    found = decontaminate.contamination(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    dirty = settle(found.filter("contaminated").select(F.col("doc_id").alias(name)).distinct(), "contaminated")
    return docs.join(dirty, F.md5("text") == F.col(name), "left_anti").select(*_own(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 ids."""
    return packing.pack(docs, byte_bpe.default_path(), keep_ids=False).drop("ids")
