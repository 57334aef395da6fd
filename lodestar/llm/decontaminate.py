"""Operator 4: benchmark decontamination over a distributed positional inverted index.

``build_index`` turns documents into segments, one row each: the segment's terms, and for each term
the ascending places of its occurrences among the segment's words. A gap stands between documents,
so no phrase runs across. The index is stored once in the shared folder, and read once by a search,
whatever the benchmark's size.

Phrases of up to BLOCK_CHARS characters of items are broadcast, and every segment fetches the lists
of their terms. More phrases are routed: ``directory`` lists in which segments a term stands and how
often, each phrase takes its rarest term of all, phrases with a term that stands nowhere fall away,
and a phrase goes to the segments of its rarest term only. Segments meet their phrases in one
shuffle of the index. A segment that would get more than TASK_PHRASES is dealt to several tasks.

In a segment, a phrase's terms are ordered from the rarest by the lengths of their lists; the rarest
list, moved by its term's offset, gives the candidate places, and each further list drops those that
it doesn't hold. With ``slop`` above 0, a phrase stands at a place of a document if each of its terms
stands in the same document at most that many words off its place: proximity matches.

Nulls and corners: null or empty text has no words; an item without words has no window; a null
item_id hits words but has no id to list; rows that repeat an item_id count once; repeated documents
are rows of their own; a very long text makes a segment of its own; terms of equal frequency go by
their order; an empty benchmark contaminates nothing; an empty table gives no row; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lodestar.sources.shared import settle

from . import _worker
from .words import alnum_words

WINDOW = 13
#: Words of a segment, and characters of items whose phrases are broadcast.
SEGMENT_WORDS, BLOCK_CHARS = 500_000, 2_000_000
#: Candidates that are looked at together in a segment, and phrases that a task looks for in one.
CANDIDATES, TASK_PHRASES = 500_000, 500_000

INDEX_SCHEMA = "segment long, doc_ids array<string>, starts binary, n_words binary, terms binary, counts binary, places binary"
_INDEX = pa.schema([("segment", pa.int64()), ("doc_ids", pa.list_(pa.string()))] + [(x.split()[0], pa.binary()) for x in INDEX_SCHEMA.split(", ")[2:]])


def _segment(number: int, doc_ids: list, docs: list[list[bytes]]) -> dict:
    """One row of the index. Places of a term are kept as differences from one to the next."""
    n_words = np.array([len(x) for x in docs], dtype=np.int64)
    starts = np.cumsum(n_words + 1) - n_words - 1 if len(docs) else n_words  # a gap of one before the next document
    terms: dict[bytes, int] = {}
    ids = np.array([terms.setdefault(w, len(terms)) for x in docs for w in x], dtype=np.int32)
    place = np.arange(len(ids)) + np.repeat(np.arange(len(docs)), n_words)
    order = np.argsort(ids, kind="stable")
    counts = np.bincount(ids, minlength=len(terms))
    places = place[order]
    steps = np.diff(places, prepend=0)
    first = (np.cumsum(counts) - counts)[counts > 0]
    steps[first] = places[first]
    return {
        "segment": number,
        "doc_ids": doc_ids,
        "starts": starts.astype("<i4").tobytes(),
        "n_words": n_words.astype("<i4").tobytes(),
        "terms": b"\n".join(terms),  # words hold no line feed
        "counts": counts.astype("<i4").tobytes(),
        "places": steps.astype("<i4").tobytes(),
    }


def build_index(docs: DataFrame, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """``docs`` (doc_id, text) to index segments. No shuffle: a segment covers neighbouring rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _worker.release()
        number, doc_ids, held, n = TaskContext.get().partitionId() << 32, [], [], 0
        for b in batches:
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                doc_ids.append(doc_id.as_py())
                held.append(alnum_words(text.as_py()))
                n += len(held[-1]) + 1
                if n >= segment_words:
                    yield pa.RecordBatch.from_pylist([_segment(number, doc_ids, held)], _INDEX)
                    number, doc_ids, held, n = number + 1, [], [], 0
        if held:
            yield pa.RecordBatch.from_pylist([_segment(number, doc_ids, held)], _INDEX)
        del held
        _worker.release()

    docs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, INDEX_SCHEMA)


def directory(index: DataFrame) -> DataFrame:
    """(term, segment, n): in which segments a term stands, and how often there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for segment, terms, counts in zip(b["segment"], b["terms"], b["counts"], strict=True):
                n = np.frombuffer(counts.as_py(), "<i4").astype(np.int64)
                if len(n):
                    columns = [pa.array(terms.as_py().decode().split("\n")), pa.array([segment.as_py()] * len(n), pa.int64()), pa.array(n)]
                    yield pa.RecordBatch.from_arrays(columns, names=["term", "segment", "n"])

    return index.select("segment", "terms", "counts").mapInArrow(run, "term string, segment long, n long")


class Segment:
    """The lists of one row of the index that the terms of ``vocabulary`` have."""

    #: Term and place in one number, ascending: a list is a stretch of it.
    span = 1 << 32

    def __init__(self, row: dict, vocabulary: list[bytes]):
        self.doc_ids = row["doc_ids"]
        self.starts = np.frombuffer(row["starts"], "<i4").astype(np.int64)
        self.n_words = np.frombuffer(row["n_words"], "<i4").astype(np.int64)
        number = {w: k for k, w in enumerate(row["terms"].split(b"\n"))} if row["counts"] else {}
        of = np.array([number.get(w, -1) for w in vocabulary], dtype=np.int64)
        #: The list of each term of the vocabulary, -2 where there is none.
        self.list_of = np.where(of >= 0, np.cumsum(of >= 0) - 1, -2)
        of = of[of >= 0]
        counts, steps = (np.frombuffer(row[k], "<i4").astype(np.int64) for k in ("counts", "places"))
        begin = (np.cumsum(counts) - counts)[of]
        self.counts = counts[of]
        self.first = np.cumsum(self.counts) - self.counts
        total = np.cumsum(steps[np.repeat(begin - self.first, self.counts) + np.arange(self.counts.sum())])
        before = np.concatenate([[0], total])[self.first]
        self.places = total - np.repeat(before, self.counts)
        self.keys = np.repeat(np.arange(len(of)), self.counts) * self.span + self.places

    def doc_of(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, place, side="right") - 1


def _find(s: Segment, phrases: np.ndarray, sizes: np.ndarray, slop: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Portions of (phrase, place) at which phrases stand. phrases: lists of terms, -1 beyond the end, -2 unknown."""
    width = phrases.shape[1]
    inside = np.arange(width) < sizes[:, None]
    alive = np.flatnonzero(~(inside & (phrases == -2)).any(axis=1) & (sizes > 0))
    if not len(alive) or not len(s.keys):
        return
    phrases, sizes = phrases[alive].astype(np.int64), sizes[alive]  # few are left: a segment lacks most phrases' terms
    lengths = np.where(inside[alive], s.counts[np.maximum(phrases, 0)], np.iinfo(np.int64).max)
    order = np.argsort(lengths, axis=1, kind="stable")  # a phrase's terms from the rarest
    n = lengths[np.arange(len(alive)), order[:, 0]]
    groups = np.cumsum(n * (2 * slop + 1)) // CANDIDATES
    for g in np.unique(groups):
        at = np.flatnonzero(groups == g)
        of = np.repeat(at, n[at])
        anchor = order[of, 0]
        k = np.arange(len(of)) - np.repeat(np.cumsum(n[at]) - n[at], n[at])
        stands = s.places[s.first[phrases[of, anchor]] + k]
        doc = s.doc_of(stands)
        low, high = s.starts[doc], s.starts[doc] + s.n_words[doc] - 1  # the document's first and last place
        if slop:
            place = (stands - anchor)[:, None] + np.arange(-slop, slop + 1)
            rows, shift = np.nonzero((place >= low[:, None]) & (place <= high[:, None]))
            _, one = np.unique(of[rows] * s.span + place[rows, shift], return_index=True)  # the phrase's other occurrences may give it too
            of, place, low, high = of[rows[one]], place[rows[one], shift[one]], low[rows[one]], high[rows[one]]
        else:
            place = stands - anchor
            keep = place >= low
            of, place, low, high = of[keep], place[keep], low[keep], high[keep]
        for step in range(1, width):
            if not len(of):
                break
            off = order[of, step]
            more, term = off < sizes[of], phrases[of, off] * s.span
            least = np.maximum(place + off - slop, low)
            found = np.searchsorted(s.keys, term + least)
            hit = s.keys[np.minimum(found, len(s.keys) - 1)]
            ok = ~more | ((found < len(s.keys)) & (hit >= term + least) & (hit <= term + np.minimum(place + off + slop, high)))
            of, place, low, high = of[ok], place[ok], low[ok], high[ok]
        if len(of):
            yield alive[of], place


class Phrases:
    """Different phrases, each with the names of its owners."""

    def __init__(self, owners: dict[tuple[bytes, ...], list], window: int):
        number: dict[bytes, int] = {}
        rows = [[number.setdefault(w, len(number)) for w in p] + [-1] * (window - len(p)) for p in owners]
        self.owners, self.vocabulary = list(owners.values()), list(number)
        self.rows = np.array(rows, dtype=np.int32).reshape(-1, window)
        self.sizes = (self.rows >= 0).sum(axis=1)

    @classmethod
    def of_items(cls, items: list[tuple[str | None, str | None]], window: int = WINDOW) -> Phrases:
        owners: dict[tuple[bytes, ...], list] = {}
        for item, text in items:
            for cut in dict.fromkeys(_cuts(alnum_words(text), window)):
                owners.setdefault(cut, []).append(item)
        return cls(owners, window)

    @classmethod
    def of_texts(cls, texts: list[str], window: int = WINDOW) -> Phrases:
        """Each phrase is named by its words."""
        return cls({tuple(x.encode().split(b" ")): [x] for x in texts}, window)

    def segment(self, row: dict) -> Segment:
        return Segment(row, self.vocabulary)

    def find(self, s: Segment, slop: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Portions of (document, phrase, place in the segment, words)."""
        if not len(self.rows):
            return
        local = np.append(s.list_of, -1)
        for phrase, place in _find(s, local[self.rows], self.sizes, slop):
            yield s.doc_of(place), phrase, place, self.sizes[phrase]


def _cuts(words: list[bytes], window: int) -> list[tuple[bytes, ...]]:
    return [tuple(words[i : i + window]) for i in range(max(1, len(words) - window + 1) if words else 0)]


def _items(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """Items that have a word, repeats dropped, and their characters."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.filter(F.col("text").rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")).distinct()
    return items, items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0


def _windows(items: DataFrame, window: int) -> DataFrame:
    """(phrase, item): the items' windows, words joined by spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, text in zip(b["item_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                cuts = [b" ".join(x).decode() for x in dict.fromkeys(_cuts(alnum_words(text), window))]
                yield pa.RecordBatch.from_arrays([pa.array(cuts, pa.string()), pa.array([item] * len(cuts), pa.string())], names=["phrase", "item"])

    return items.mapInArrow(run, "phrase string, item string")


def _routes(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """(segment, phrase): where each of ``phrases`` (phrase) can stand, by its rarest term of all."""
    terms = settle(directory(index), "term-directory")
    each = phrases.select("phrase", F.explode(F.array_distinct(F.split("phrase", " "))).alias("term"))
    totals = terms.join(each.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("total"))
    known = each.join(totals, "term", "left").groupBy("phrase").agg(
        F.min_by("term", F.struct("total", "term")).alias("term"), F.count_if(F.col("total").isNull()).alias("lacking")
    )
    return known.filter("lacking = 0").join(terms, "term").select("segment", "phrase")


def _met(index: DataFrame, items: DataFrame, chars: int, window: int, block_chars: int, work: Callable, schema: str) -> tuple[DataFrame, DataFrame | None]:
    """``work(row of the index, Phrases)`` for every segment, and (phrase, item) if phrases are named by their words."""
    context = index.sparkSession.sparkContext
    if chars <= block_chars:
        sent = context.broadcast(Phrases.of_items([tuple(r) for r in items.collect()], window))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            _worker.release()
            for b in batches:
                for row in b.to_pylist():
                    yield from work(row, sent.value)
            _worker.release()

        return index.mapInArrow(run, schema), None
    windows = settle(_windows(items, window), "windows")
    routes = settle(_routes(index, windows.select("phrase").distinct()), "routes")
    most = routes.groupBy("segment").count().agg(F.max("count").alias("n")).first()["n"] or 0
    parts = 1 + most // TASK_PHRASES
    index = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))) if parts > 1 else F.lit(0))
    routes = routes.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)).cast("int"))

    def meet(segments: pa.Table, routed: pa.Table) -> pa.Table:
        phrases = Phrases.of_texts(routed["phrase"].to_pylist(), window)
        found = [b for row in segments.to_pylist() for b in work(row, phrases)]
        return pa.Table.from_batches(found) if found else pa.Table.from_batches([], empty)

    empty = to_arrow_schema(StructType.fromDDL(schema))
    return index.groupBy("segment", "part").cogroup(routes.groupBy("segment", "part")).applyInArrow(meet, schema), windows


def matches(index: DataFrame, benchmark: DataFrame, slop: int = 0, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, first_word, n_words) of every place where a window of an item stands."""

    def places(row: dict, phrases: Phrases) -> Iterator[pa.RecordBatch]:
        s = phrases.segment(row)
        for doc, phrase, place, n in phrases.find(s, slop):
            times = [len(phrases.owners[k]) for k in phrase.tolist()]
            columns = [
                pa.array([s.doc_ids[d] for d in np.repeat(doc, times).tolist()], pa.string()),
                pa.array([x for k in phrase.tolist() for x in phrases.owners[k]], pa.string()),
                pa.array(np.repeat(place - s.starts[doc], times), pa.int64()),
                pa.array(np.repeat(n, times), pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "first_word", "n_words"])

    items, chars = _items(benchmark)
    found, windows = _met(index, items, chars, window, block_chars, places, "doc_id string, item_id string, first_word long, n_words long")
    if windows is not None:
        found = found.withColumnRenamed("item_id", "phrase").join(windows, "phrase")
        found = found.select("doc_id", F.col("item").alias("item_id"), "first_word", "n_words")
    return found


def _mark(s: Segment, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """A number for each place of the segment, not 0 where it is hit; different pairs (document, phrase)."""
    size = int(s.starts[-1] + s.n_words[-1] + 1) if len(s.starts) else 0
    change, pairs = np.zeros(size + 1, np.int64), [np.zeros(0, np.int64)]
    for doc, phrase, place, n in phrases.find(s):
        change += np.bincount(place, minlength=size + 1)
        change -= np.bincount(place + n, minlength=size + 1)
        pairs.append(np.unique(doc * len(phrases.owners) + phrase))
    codes = np.unique(np.concatenate(pairs))
    return np.cumsum(change[:-1]), np.stack(np.divmod(codes, max(1, len(phrases.owners))), axis=1)


def _hits(hit: np.ndarray, starts: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """Hit words of each document."""
    total = np.concatenate([[0], np.cumsum(hit > 0, dtype=np.int64)])
    return total[starts + n_words] - total[starts]


DOCUMENTS = "doc_id string, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def contamination(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Every document of ``index``, a settled table: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    items, chars = _items(benchmark)
    if chars <= block_chars:
        return _met(index, items, chars, window, block_chars, _documents, DOCUMENTS)[0]
    marked, windows = _met(index, items, chars, window, block_chars, _marks, MARKS)
    marked = settle(marked, "marked-segments")
    docs = marked.drop("found").groupBy("segment").applyInArrow(_merged, "segment long, doc int, doc_id string, n_words long, n_hit long")
    pairs = marked.select("segment", F.explode("found").alias("x")).select("segment", "x.doc", "x.phrase")
    listed = pairs.join(windows.filter("item is not null"), "phrase").groupBy("segment", "doc").agg(F.sort_array(F.collect_set("item")).alias("items"))
    found = F.coalesce("items", F.array().cast("array<string>"))
    return docs.join(listed, ["segment", "doc"], "left").select(
        "doc_id", "n_words", "n_hit", F.size(found).cast("long").alias("n_items"), F.sha2(F.array_join(found, ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def _documents(row: dict, phrases: Phrases) -> Iterator[pa.RecordBatch]:
    """Every document of a segment, judged by all phrases."""
    s = phrases.segment(row)
    hit, pairs = _mark(s, phrases)
    n_hit = _hits(hit, s.starts, s.n_words)
    cuts = np.searchsorted(pairs[:, 0], np.arange(len(s.starts) + 1))
    n_items, digests = [], []
    for a, z in zip(cuts.tolist(), cuts.tolist()[1:], strict=False):
        own = sorted({x for k in pairs[a:z, 1].tolist() for x in phrases.owners[k] if x is not None})
        n_items.append(len(own))
        digests.append(hashlib.sha256(",".join(own).encode()).hexdigest())
    columns = [
        pa.array(s.doc_ids, pa.string()), pa.array(s.n_words), pa.array(n_hit), pa.array(n_items, pa.int64()),
        pa.array(digests, pa.string()), pa.array((n_hit > 0) & (20 * n_hit >= s.n_words), pa.bool_()),
    ]
    yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in DOCUMENTS.split(", ")])


MARKS = "segment long, doc_ids array<string>, starts binary, n_words binary, hit binary, found array<struct<doc: int, phrase: string>>"
_MARKS = pa.schema([*(_INDEX.field(x) for x in ("segment", "doc_ids", "starts", "n_words")), pa.field("hit", pa.binary()), pa.field("found", pa.list_(pa.struct([("doc", pa.int32()), ("phrase", pa.string())])))])


def _marks(row: dict, phrases: Phrases) -> Iterator[pa.RecordBatch]:
    """A segment's documents and what some phrases hit: places, a bit each, and pairs (document, phrase)."""
    hit, pairs = _mark(phrases.segment(row), phrases)
    found = [{"doc": d, "phrase": phrases.owners[k][0]} for d, k in pairs.tolist()]
    own = {k: row[k] for k in ("segment", "doc_ids", "starts", "n_words")}
    yield pa.RecordBatch.from_pylist([own | {"hit": np.packbits(hit > 0).tobytes(), "found": found}], _MARKS)


def _merged(parts: pa.Table) -> pa.Table:
    """The documents of one segment, with the words that any part hits."""
    rows = parts.to_pylist()
    starts, n_words = (np.frombuffer(rows[0][k], "<i4").astype(np.int64) for k in ("starts", "n_words"))
    hit = np.unpackbits(np.bitwise_or.reduce([np.frombuffer(r["hit"], np.uint8) for r in rows]))
    n = len(starts)
    columns = [
        pa.array([rows[0]["segment"]] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(rows[0]["doc_ids"], pa.string()),
        pa.array(n_words), pa.array(_hits(hit, starts, n_words)),
    ]
    return pa.Table.from_arrays(columns, names=["segment", "doc", "doc_id", "n_words", "n_hit"])


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contamination of every row of ``documents`` by ``benchmark``."""
    index = settle(build_index(spark.read.parquet(f"{sf_dir}/documents.parquet")), "positional-index")
    found = contamination(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


#: The same rows in SQL: each document's windows of every length that an item's windows have.
ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), p AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, list_slice(w, k, k + least(len(w), 13) - 1) AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k FROM i WHERE len(w) > 0)
), c AS (
  SELECT row, k, n, list_slice(w, k, k + n - 1) AS phrase
  FROM (SELECT row, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)
), m AS (
  SELECT c.row, c.k, c.n, p.item_id FROM c JOIN p USING (phrase)
), h AS (
  SELECT row, count(DISTINCT place) AS n_hit FROM (SELECT row, unnest(range(k, k + n)) AS place FROM m) GROUP BY row
), s AS (
  SELECT row, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT row, item_id FROM m WHERE item_id IS NOT NULL) GROUP BY row
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (row) LEFT JOIN s USING (row)
"""
