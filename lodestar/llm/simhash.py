"""Operator 7: SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within ``2 r`` bits have a value within ``r`` bits of both. So every fingerprint
emits all values within r bits of itself (2081 for r = 2), and fingerprints that meet in a value are
within 2 r bits of each other: a meeting needs no further check and no link is missed.

A ball's values share few prefixes, so the shuffle moves a fingerprint once for each of the prefixes
(``buckets``: 56 of 10 bits) instead of 2081 rows. The task that has a prefix makes the values under
it, sorts them, and links the fingerprints that meet. A prefix with very many fingerprints is dealt
again by more bits, so near copies of one text do not end in one task, and values are made in
portions of ``PORTION`` at most. Linked fingerprints go out once per task with their least one, so
no pairs within a group are listed.

Nulls and corners: null, empty and blank texts have no words and fingerprint 0, which links like any
other. Fewer than four words make one shingle. Rows with the same fingerprint link at distance 0,
repeated rows included; a row without doc_id gets a component too, whose id is the least doc_id
that is not null (null if there is none). A very long text is hashed in portions of 65,536 shingles.
An empty table gives no row. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import _worker
from lodestar.sources.shared import settle
from .components import components

SHINGLE, SEED, RADIUS = 4, 42, 2
#: Values made at a time; rows under one prefix, and times the mean, beyond which it is dealt again; bits for that.
PORTION, HOT, HOT_TIMES, HOT_BITS = 1_000_000, 20_000, 8, 8
#: Rows expected under one prefix, which sets the prefix's bits between the two bounds.
PER_PREFIX, LEAST_BITS, MOST_BITS = 16_000, 10, 24
#: Components, of 16 bytes each, that are broadcast: those with more than this share of all linked fingerprints.
BIG_ROOTS = 100_000


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit fingerprint, unsigned."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(g, seed) for g in grams), dtype="<u8")
    bits = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65536):
        part = hashes[k : k + 65536]
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    set_bits = np.packbits(2 * bits > len(hashes), bitorder="little")
    return int(set_bits.view("<u8")[0])


def with_fingerprints(docs: DataFrame, name: str, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``docs`` (text, more) with all its columns and ``name``: the text's fingerprint as a signed long."""
    at = docs.columns.index("text")
    schema = StructType([*docs.schema.fields, StructField(name, LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _worker.release()
        for b in batches:
            fp = np.array([fingerprint(x.as_py(), shingle, seed) for x in b.column(at)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fp.view(np.int64))], names=schema.names)
        _worker.release()

    return docs.mapInArrow(run, schema)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``docs`` (doc_id, text) to (doc_id, fp)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_fingerprints(docs, "fp", shingle, seed).drop("text")


@cache
def _masks(bits: int, radius: int) -> np.ndarray:
    """All masks of at most ``radius`` of ``bits`` bits."""
    found = [sum(1 << k for k in c) for r in range(radius + 1) for c in combinations(range(bits), r)]
    return np.array(found, dtype=np.uint64)


def _meetings(fps: np.ndarray, left: np.ndarray, bits: int, radius: int) -> Iterator[np.ndarray]:
    """Pairs of positions that link all fingerprints meeting under one prefix.

    fps: unsigned; left: how many bits of the ``bits`` low ones each may still change.
    """
    sizes = {r: len(_masks(bits, r)) for r in range(radius + 1)}
    if bits > 8 and sum(sizes[r] * int((left == r).sum()) for r in sizes) > PORTION and len(fps) > 1:
        cut, keys, rows, lefts = min(6, bits - 8), [], [], []
        for r in range(radius + 1):
            at = np.flatnonzero(left == r)
            for mask in _masks(cut, r).tolist():
                keys.append(((fps[at] >> np.uint64(bits - cut)) & np.uint64((1 << cut) - 1)) ^ np.uint64(mask))
                rows.append(at)
                lefts.append(np.full(len(at), r - mask.bit_count()))
        keys, rows, lefts = map(np.concatenate, (keys, rows, lefts))
        for key in range(1 << cut):
            own = np.flatnonzero(keys == key)
            if len(own) > 1:
                for pairs in _meetings(fps[rows[own]], lefts[own], bits - cut, radius):
                    yield rows[own][pairs]
        return
    values, rows, low = [], [], fps & np.uint64((1 << bits) - 1)
    for r in range(radius + 1):
        at = np.flatnonzero(left == r)
        masks = _masks(bits, r)
        values.append((low[at][:, None] ^ masks).ravel())
        rows.append(np.repeat(at, len(masks)))
    values, rows = np.concatenate(values), np.concatenate(rows)
    order = np.argsort(values)
    values, rows = values[order], rows[order]
    same = np.flatnonzero(values[1:] == values[:-1])
    if len(same):
        pairs = np.stack([rows[same], rows[same + 1]], axis=1)
        yield np.unique(pairs.min(axis=1) * len(fps) + pairs.max(axis=1))[:, None] // [len(fps), 1] % [len(fps) + 1, len(fps)]


def _roots(n: int, pairs: np.ndarray) -> np.ndarray:
    """The least position that each of n positions is connected to."""
    root = np.arange(n)
    while True:
        a, b = root[pairs[:, 0]], root[pairs[:, 1]]
        if (a == b).all():
            return root
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def _reach(bits: int, radius: int) -> int:
    """Prefixes of so many bits that a ball touches."""
    return sum(comb(bits, r) for r in range(radius + 1))


def _prefix_bits(n: int, radius: int) -> int:
    """The fewest bits with which ``n`` fingerprints make at most ``PER_PREFIX`` rows a prefix."""
    return next((b for b in range(LEAST_BITS, MOST_BITS) if n * _reach(b, radius) <= PER_PREFIX << b), MOST_BITS)


def _links(distinct: DataFrame, n: int, bits: int, radius: int) -> DataFrame:
    """Edges (a, b) that connect all ``n`` fingerprints of ``distinct`` (fp) within 2 * radius bits."""

    def dealt(rows: DataFrame, width: int, shift: int) -> DataFrame:
        """Each row once for every value of its next ``width`` bits that it may still reach."""
        masks = F.array([F.lit(x).cast("long") for x in _masks(width, radius).tolist()])
        out = rows.withColumn("mask", F.explode(masks)).withColumn("left", F.col("left") - F.bit_count("mask").cast("int"))
        key = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1)).bitwiseXOR(F.col("mask"))
        key = F.shiftleft("key", width).bitwiseOR(key)
        return out.filter("left >= 0").select("fp", "left", key.alias("key"), F.lit(shift).alias("bits"))

    start = distinct.select("fp", F.lit(radius).alias("left"), F.lit(0).cast("long").alias("key"))
    rows = dealt(start, bits, 64 - bits)
    many = max(HOT, HOT_TIMES * n * _reach(bits, radius) >> bits)
    hot = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > many).select("key")
    # keys with HOT_TIMES the mean are at most 2 ** MOST_BITS / HOT_TIMES, of eight bytes each: 16 MB
    rows = rows.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "key", "left")
    again = dealt(rows.filter("hot").select("fp", "left", "key"), HOT_BITS, 64 - bits - HOT_BITS)
    rows = rows.filter("hot is null").select("fp", "left", "key", "bits").unionByName(again)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _worker.release()
        for fps, left, low_bits in _runs(batches):
            pairs = list(_meetings(fps, left, low_bits, radius))
            if pairs:
                order = np.argsort(fps.view(np.int64), kind="stable")  # the least one is least as a signed long
                place = np.empty_like(order)
                place[order] = np.arange(len(order))
                root = _roots(len(fps), place[np.concatenate(pairs)])
                fp = fps.view(np.int64)[order]
                at = np.flatnonzero(root != np.arange(len(root)))
                yield pa.RecordBatch.from_pydict({"a": fp[at], "b": fp[root[at]]})
        _worker.release()

    keyed = rows.repartition("key", "bits").sortWithinPartitions("key", "bits")
    return keyed.select("key", "bits", "fp", "left").mapInArrow(meet, "a long, b long")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """The fingerprints of each run of equal key and bits, of two or more."""
    held: list[np.ndarray] = []
    last = None

    def done():
        if held and sum(x.shape[1] for x in held) > 1:
            both = np.concatenate(held, axis=1)
            yield both[0].view(np.uint64), both[1], last[1]

    for b in batches:
        if not b.num_rows:
            continue
        key, bits = (b[k].to_numpy(zero_copy_only=False).astype(np.int64) for k in ("key", "bits"))
        both = np.stack([b[k].to_numpy(zero_copy_only=False).astype(np.int64) for k in ("fp", "left")])
        cuts = np.flatnonzero((key[1:] != key[:-1]) | (bits[1:] != bits[:-1])) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
            if (now := (int(key[i]), int(bits[i]))) != last:
                yield from done()
                held, last = [], now
            held.append(both[:, i:j])
    yield from done()


def groups(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``prints`` (doc_id, fp), a settled table, to (fp, component_id), one row a fingerprint."""
    distinct = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    n = distinct.count()
    nodes = components(_links(distinct.select("fp"), n, _prefix_bits(n, radius), radius))
    nodes = nodes.withColumnRenamed("node", "fp")
    # only fingerprints with links need a join; the others are their own component
    linked = settle(distinct.join(nodes, "fp", "left"), "linked-fingerprints")
    alone = linked.filter("root is null").select("fp", F.col("least").alias("component_id"))
    return alone.unionByName(_least_of(linked.filter("root is not null")))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` (doc_id, text) to (doc_id, fp, component_id), one row per row."""
    prints = settle(fingerprints(docs), "fingerprints")
    return prints.join(groups(prints, radius), "fp", "left").select("doc_id", "fp", "component_id")


def _least_of(linked: DataFrame) -> DataFrame:
    """(fp, root, least) to (fp, component_id): the least of ``least`` over a root's rows.

    A root with more than a BIG_ROOTS-th of the rows is one of at most BIG_ROOTS, so those are
    broadcast, and their rows stay where they are; only the rows of small roots meet by root.
    """
    ids = settle(linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")), "components")
    many = (ids.agg(F.sum("n").alias("n")).first()["n"] or 0) // BIG_ROOTS
    big = ids.filter(F.col("n") > many).select("root", F.col("component_id").alias("of_big"), F.lit(True).alias("big"))
    rows = linked.select("fp", "root").join(F.broadcast(big), "root", "left")
    small = rows.filter("big is null").select("fp", "root").join(ids.filter(F.col("n") <= many), "root")
    return rows.filter("big").select("fp", F.col("of_big").alias("component_id")).unionByName(small.select("fp", "component_id"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every row of ``documents``."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
