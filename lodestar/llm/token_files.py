"""Operator 5: token-id files with Elias-Fano document boundaries.

A data set is a folder of segment files. Documents stand in ascending ``doc_id`` order (null ids
first; rows that share an id by the hash of their text), each followed by the end id. A segment:

    magic ``LODEFSG2`` | segment number u64 | documents u64 | of them without doc_id u64 | least doc_id
    i64 | ids u64 | bytes of an id u8, 7 x 0 | Elias-Fano doc_ids less the least | Elias-Fano ends | ids

So neither the doc_ids nor the boundaries are a table of 64-bit numbers: both ascend, and select
structures give the i-th of them. Numbers are little-endian. Segment numbers ascend in document order. Spark's text writer makes the
files, one record each, so one line feed follows; a reader stops before it. Hence the folder can lie
in any store that Spark writes, and ``binaryFile`` reads it back.

Nulls and corners: null or empty text is one end id; an empty table makes no segment; repeated rows
are documents of their own, dealt over as many ranges as they need; a very long text lies whole in
one segment, which may then hold more than SEGMENT_IDS; columns other than ``doc_id`` and ``text``
are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import byte_bpe, elias_fano
from lodestar.sources.shared import new_path, settle

MAGIC = b"LODEFSG2"
_HEAD = struct.Struct("<8sQQQqQB7x")
#: Ids that a segment holds before the next begins; bytes of text that a range of documents holds, and the
#: most ranges (beyond them, ranges grow; a task still holds one segment).
SEGMENT_IDS, RANGE_BYTES, MOST_RANGES = 4_000_000, 12_000_000, 20_000
#: A segment's number is its range's, and its own in the range in these low bits.
RANGE_BITS = 24


def segment_bytes(number: int, doc_ids: list[int | None], ids: list[bytes], width: int) -> bytes:
    """One segment of documents in ascending order of doc_id, nulls first. ids: of each, as little-endian
    unsigned 32-bit, the end id included.
    """
    ends = np.cumsum([len(x) // 4 for x in ids]) if ids else np.zeros(0, np.int64)
    total = int(ends[-1]) if ids else 0
    flat = np.frombuffer(b"".join(ids), "<u4").astype(f"<u{width}").tobytes()
    known = [x for x in doc_ids if x is not None]
    least, most = (known[0], known[-1]) if known else (0, 0)
    head = _HEAD.pack(MAGIC, number, len(ids), len(ids) - len(known), least, total, width)
    keys = elias_fano.dump(np.array([x - least for x in known], dtype=np.uint64), most - least)
    return head + keys + elias_fano.dump(ends, total) + flat


class Segment:
    """A segment's documents, by position."""

    def __init__(self, data: bytes):
        magic, self.number, self.n_docs, self.n_null, self.least, self.n_ids, width = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a segment")
        self.keys = elias_fano.EliasFano(data, _HEAD.size)
        self.ends = elias_fano.EliasFano(data, self.keys.end)
        self.ids = np.frombuffer(data, f"<u{width}", self.n_ids, self.ends.end)

    def doc_ids(self) -> list[int | None]:
        found = self.keys.select(np.arange(self.n_docs - self.n_null)).astype(np.uint64).tolist()
        return [None] * self.n_null + [k + self.least for k in found]

    def bounds(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def document(self, i: int) -> np.ndarray:
        start, end = self.bounds(i)
        return self.ids[start:end]


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = byte_bpe.END_ID) -> None:
    """Encode ``docs`` (doc_id, text) and write the segments to ``path``.

    One shuffle of the texts by range of ``doc_id``; a task holds one segment's ids at a time.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # rows that share id and text differ by ``row`` alone, so no key holds more than a row
    docs = docs.withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    keys = ["doc_id", "tie", "row"]
    ranged = docs.repartitionByRange(min(MOST_RANGES, 1 + size // RANGE_BYTES), *keys).sortWithinPartitions(*keys)
    end = np.array([end_id], dtype="<u4").tobytes()

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_bpe.encoder(vocabulary)
        width = 2 if len(coder.n_bytes) <= 1 << 16 else 4
        part, k, doc_ids, ids, held = TaskContext.get().partitionId(), 0, [], [], 0
        rows = ((key.as_py(), text.as_py()) for b in batches for key, text in zip(b["doc_id"], b["text"], strict=True))
        for doc_id, got in coder.encode_stream(rows):
            doc_ids.append(doc_id)
            ids.append(got + end)
            held += len(ids[-1]) // 4
            if held >= SEGMENT_IDS:
                yield pa.RecordBatch.from_pydict({"value": [segment_bytes((part << RANGE_BITS) + k, doc_ids, ids, width)]})
                k, doc_ids, ids, held = k + 1, [], [], 0
        if ids:
            yield pa.RecordBatch.from_pydict({"value": [segment_bytes((part << RANGE_BITS) + k, doc_ids, ids, width)]})

    made = ranged.select("doc_id", "text").mapInArrow(segments, "value binary")
    made.select(F.col("value").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every document of the folder: doc_id, segment, local_start, n_tokens, ids_crc32."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b["content"]:
                s = Segment(content.as_py())
                ends = s.ends.select(np.arange(s.n_docs))
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if s.n_docs else ends
                flat = s.ids.astype("<u4").tobytes()
                bounds = list(zip((4 * starts).tolist(), (4 * ends).tolist(), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(s.doc_ids(), pa.int64()),
                        pa.array([s.number] * s.n_docs, pa.int64()),
                        pa.array(starts, pa.int64()),
                        pa.array(ends - starts, pa.int64()),
                        pa.array([zlib.crc32(memoryview(flat)[a:z]) for a, z in bounds], pa.int64()),
                    ],
                    names=["doc_id", "segment", "local_start", "n_tokens", "ids_crc32"],
                )

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(
        documents, "doc_id long, segment long, local_start long, n_tokens long, ids_crc32 long"
    )


def with_starts(documents: DataFrame) -> DataFrame:
    """Adds ``start``, the ids of all documents before: running totals over segments, not documents.

    Segments are added up range by range; only the ranges, MOST_RANGES at most, meet in one task.
    """
    documents = settle(documents, "token-file-documents")
    totals = documents.groupBy("segment").agg(F.sum("n_tokens").alias("total")).withColumn("range", F.shiftright("segment", RANGE_BITS))
    ranges = totals.groupBy("range").agg(F.sum("total").alias("of_range"))
    ranges = ranges.select("range", F.coalesce(F.sum("of_range").over(_before(W.orderBy("range"))), F.lit(0)).alias("before_range"))
    inside = F.coalesce(F.sum("total").over(_before(W.partitionBy("range").orderBy("segment"))), F.lit(0))
    bases = totals.withColumn("inside", inside).join(F.broadcast(ranges), "range").select("segment", (F.col("inside") + F.col("before_range")).alias("base"))
    return documents.join(bases, "segment").withColumn("start", F.col("base") + F.col("local_start"))


def _before(window):
    return window.rowsBetween(W.unboundedPreceding, -1)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` written as token files and read back."""
    path = new_path(spark, "token-files")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, byte_bpe.default_path())
    return with_starts(read(spark, path)).select("doc_id", "start", "n_tokens", "ids_crc32")
