"""Operator 10: bounded-space online packing of documents into sequences.

Each partition keeps at most ``OPEN`` open windows. What a document has beyond whole windows is put
into the open window that it fits best. When none fits, the fullest window is emitted: it is topped
up with the document's first ids if its gap is worth a cut, and the rest goes on. Windows still open
when a partition ends are the leftovers; those of ``GROUP`` neighbouring partitions are merged, cut
to fill, so that a group has one short sequence at most.

Nulls and corners: null or empty text is the end id alone; an empty table gives no row; repeated rows
are documents of their own and so are rows without a doc_id; a very long text is cut into whole
windows as it comes, its ids held once; of windows that fit equally well the oldest is taken; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe
from lodestar.sources.shared import settle

LENGTH = 1024
#: Open windows of a partition; partitions whose leftovers are merged; the smallest gap worth a cut.
OPEN, GROUP, MIN_CUT = 16, 16, 8

_PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length", "ids"]
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
    "offset long, sequence_length long, ids binary"
)


class Packer:
    """Bounded-space best-fit. A piece: (doc_id, start, ids as bytes of 4 each, doc_tokens)."""

    def __init__(self, length: int, n_open: int, min_cut: int):
        self.length, self.n_open, self.min_cut = length, n_open, min_cut
        self.windows: list[tuple[int, list]] = []  # fill, pieces

    def add(self, piece: tuple) -> Iterator[list]:
        """Place a piece; yields the windows that this closes."""
        doc_id, start, ids, total = piece
        ids = memoryview(ids)  # cuts copy nothing
        while len(ids) >= 4 * self.length:
            yield [(doc_id, start, ids[: 4 * self.length], total)]
            start, ids = start + self.length, ids[4 * self.length :]
        while n := len(ids) // 4:
            fits = [k for k, (fill, _) in enumerate(self.windows) if fill + n <= self.length]
            if fits:
                best = max(fits, key=lambda k: self.windows[k][0])
                fill, pieces = self.windows[best]
                pieces.append((doc_id, start, ids, total))
                self.windows[best] = (fill + n, pieces)
                if fill + n == self.length:
                    yield self.windows.pop(best)[1]
                return
            if len(self.windows) < self.n_open:
                self.windows.append((n, [(doc_id, start, ids, total)]))
                return
            fill, pieces = self.windows.pop(max(range(len(self.windows)), key=lambda k: self.windows[k][0]))
            if (gap := self.length - fill) >= self.min_cut:
                pieces.append((doc_id, start, ids[: 4 * gap], total))
                start, ids = start + gap, ids[4 * gap :]
            yield pieces

    def rest(self) -> list[list]:
        found, self.windows = [pieces for _, pieces in self.windows], []
        return found


def _rows(windows: list[tuple[int, list]], keep_ids: bool) -> pa.RecordBatch:
    """Rows of (sequence_id, pieces)."""
    cols: dict[str, list] = {k: [] for k in _PIECE}
    for sequence, pieces in windows:
        offset, size = 0, sum(len(x[2]) for x in pieces) // 4
        for doc_id, start, ids, total in pieces:
            n = len(ids) // 4
            row = (doc_id, start, n, zlib.crc32(ids), total, sequence, offset, size, bytes(ids) if keep_ids else None)
            for k, v in zip(_PIECE, row, strict=True):
                cols[k].append(v)
            offset += n
    kinds = {"ids": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(cols[k], kinds.get(k, pa.int64())) for k in _PIECE], names=_PIECE)


def pack(
    docs: DataFrame, vocabulary: str, length: int = LENGTH, n_open: int = OPEN, group: int = GROUP,
    min_cut: int = MIN_CUT, end_id: int = byte_bpe.END_ID, keep_ids: bool = True,
) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text), their ids too if ``keep_ids``.

    No shuffle of texts or of whole documents' ids: only leftovers, ``n_open`` windows a partition,
    move. The first pass is written once, so that its closed and open windows agree.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, packer, part = byte_bpe.encoder(vocabulary), Packer(length, n_open, min_cut), TaskContext.get().partitionId()
        rows = ((key.as_py(), text.as_py()) for b in batches for key, text in zip(b["doc_id"], b["text"], strict=True))
        n, closed = part << 32, []
        for doc_id, ids in coder.encode_stream(rows):
            ids += end
            for pieces in packer.add((doc_id, 0, ids, len(ids) // 4)):
                closed.append((n, pieces))
                n += 1
            if len(closed) >= 1000:
                yield with_group(_rows(closed, keep_ids), None)
                closed = []
        yield with_group(_rows(closed, keep_ids), None)
        left = [(n + k, pieces) for k, pieces in enumerate(packer.rest())]
        yield with_group(_rows(left, True), part // group)

    def with_group(rows: pa.RecordBatch, g: int | None) -> pa.RecordBatch:
        column = pa.array([g] * rows.num_rows, pa.int64())
        return pa.RecordBatch.from_arrays([*rows.columns, column], names=[*_PIECE, "group"])

    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("sequence_id", "ascending"), ("offset", "ascending")]).to_pylist()
        packer, n, closed = Packer(length, n_open, 1), (1 << 62) + (key[0].as_py() << 32), []
        for r in rows:
            for pieces in packer.add((r["doc_id"], r["start"], r["ids"], r["doc_tokens"])):
                closed.append((n + len(closed), pieces))
        tail = Packer(length, 1, 1)  # one window, always cut to fill
        for piece in (x for pieces in packer.rest() for x in pieces):
            for pieces in tail.add(piece):
                closed.append((n + len(closed), pieces))
        closed += [(n + len(closed) + k, pieces) for k, pieces in enumerate(tail.rest())]
        return pa.Table.from_batches([_rows(closed, keep_ids)])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = settle(docs.mapInArrow(first, SCHEMA + ", group long"), "packed")
    closed = made.filter(F.col("group").isNull()).select(*_PIECE)
    merged = made.filter(F.col("group").isNotNull()).groupBy("group").applyInArrow(merge, SCHEMA)
    return closed.unionByName(merged)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` packed into sequences of 1024 ids."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, byte_bpe.default_path(), keep_ids=False).drop("ids", "sequence_length")
