"""Operator 6: language identification by unigram pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. A word's likelihood
is the sum over all ways to cut it into pieces of the product of their probabilities, which a
forward pass gives; a text's is the product over its words. The probabilities come from a bounded
sample of labelled rows by expectation-maximisation over the same segmentations.

Words are letters with the marks that belong to them, composed (NFC) and lower-cased, with the
vocabulary's word mark in front. A character that no piece covers counts as a piece of a small fixed
probability, the same in all languages. Words are scored once for each worker and kept in a bounded
cache; a batch of new words of equal length goes through the forward pass together, and a word
beyond SHORT letters on its own, in logarithms, with only as many values as the longest piece needs.

The sample's words stay on the executors: in each round they add up expected counts, and the driver
gets a number a piece and language for each part of a language's words.

Nulls and corners: null text, or text without a letter, is ``und`` with score 0; rows without lang
or doc_id are predicted but not learned from; with no labelled row at all every text is ``und``;
equal likelihoods go to the first language by name; rows that repeat a doc_id and lang are learned
from once, by the least of their texts, and predicted each; very long texts and words are summed up
whole, in time and memory that grow with their length; an empty table gives no row; other columns
are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import _worker
from lodestar.sources.shared import settle
from .quality import fold

#: Labelled documents of each language that are learned from, rounds, and the smoothing counts.
FIT_DOCS, ROUNDS, SMOOTH = 400, 2, 0.1
#: Languages that are learned, and that go through the forward pass, at a time.
BLOCK = 50
#: Log probability of a character that no piece covers.
UNKNOWN = -16.0
#: Log factor of a character in the forward pass, and slots of a hash table of pieces.
LIFT, _SLOTS = 8.0, 1 << 18
#: Words in a worker's cache, if they have no more values than CACHE_VALUES, one a language.
CACHE_WORDS, CACHE_VALUES = 500_000, 4_000_000
#: Letters of a word that goes through the forward pass with others; places of a longer one looked up at a time.
SHORT, STRETCH = 64, 1 << 16
#: Different words of a language that a task learns from.
TASK_WORDS = 50_000
MARK = "▁"
_ASCII, _LETTERS, _PIECE = re.compile("[a-z]+"), regex.compile(r"\p{L}[\p{L}\p{M}]*"), regex.compile(r"[\p{L}\p{M}]*")
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(path: str) -> list[str]:
    """The pieces of a sentencepiece model that this module's words can hold."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(k) for k in range(model.get_piece_size()))
    body = (p for p in pieces if _PIECE.fullmatch(p.removeprefix(MARK)))
    return sorted({p for p in body if p == p.lower()})


def words_of(text: str | None) -> list[str]:
    text = (text or "").lower()
    return _ASCII.findall(text) if text.isascii() else _LETTERS.findall(unicodedata.normalize("NFC", text))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)


class Matcher:
    """Finds the pieces that stand at given places of many words at once, by polynomial hashes."""

    def __init__(self, pieces: list[str]):
        self.none = len(pieces)
        self.sizes = sorted({len(p) for p in pieces})
        self.longest = max(self.sizes, default=1)
        old = np.seterr(over="ignore")
        self.powers = np.array([pow(int(_BASE), k, 1 << 64) for k in range(self.longest + 1)], dtype=np.uint64)
        hashes = np.zeros(len(pieces), dtype=np.uint64)
        for size in self.sizes:
            at = [k for k, p in enumerate(pieces) if len(p) == size]
            hashes[at] = self._prefixes([pieces[k] for k in at])[:, -1]
        #: Hash tables one after the other: what finds its slot taken goes to the next, by other bits.
        self.levels, left = [], np.arange(len(pieces))
        while len(left):
            shift = np.uint64(46 - 9 * len(self.levels))
            slots = (hashes[left] * _MIX >> shift) & np.uint64(_SLOTS - 1)
            _, first = np.unique(slots, return_index=True)
            piece = np.full(_SLOTS, self.none)
            key = np.zeros(_SLOTS, np.uint64)
            piece[slots[first]], key[slots[first]] = left[first], hashes[left[first]]
            self.levels.append((shift, key, piece))
            left = np.delete(left, first)
        np.seterr(**old)

    def _prefixes(self, words: list[str]) -> np.ndarray:
        codes = _codes("".join(words)).reshape(len(words), -1)
        out = np.zeros((len(words), codes.shape[1] + 1), dtype=np.uint64)
        for k in range(codes.shape[1]):
            out[:, k + 1] = out[:, k] * _BASE + codes[:, k]
        return out

    def _pieces(self, want: np.ndarray) -> np.ndarray:
        """The piece of each hash, or ``none``."""
        found, mixed = self.none, want * _MIX
        for shift, key, piece in reversed(self.levels):
            slot = (mixed >> shift) & np.uint64(_SLOTS - 1)
            found = np.where(key[slot] == want, piece[slot], found)
        return found

    def spans(self, words: list[str]) -> Iterator[tuple[int, int, np.ndarray]]:
        """Words of equal length: (start, end, the piece of each word there or ``none``), by ascending end."""
        sizes = set(self.sizes)
        with np.errstate(over="ignore"):
            prefix = self._prefixes(words)
            for end in range(1, prefix.shape[1]):
                for start in range(max(0, end - self.longest), end):
                    if end - start in sizes:
                        yield start, end, self._pieces(prefix[:, end] - prefix[:, start] * self.powers[end - start])

    def stretch(self, word: str, begin: int, end: int) -> np.ndarray:
        """Pieces (place, size) that end after each of the places from ``begin`` to ``end`` of one word."""
        first = max(0, begin - self.longest + 1)
        codes = _codes(word[first:end])
        out = np.full((end - begin, len(self.sizes)), self.none, dtype=np.int64)
        hashes = np.zeros(len(codes) + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for size in range(1, self.longest + 1):
                hashes = hashes[:-1] * _BASE + codes[size - 1 :]  # of the ``size`` characters from each place
                if not len(hashes):
                    break
                if size in self.sizes:
                    skip = max(0, begin - first - size + 1)  # these end before ``begin``
                    own = self._pieces(hashes[skip:])
                    out[len(out) - len(own) :, self.sizes.index(size)] = own
        return out


def _by_length(words: list[str], size: int = 20_000) -> Iterator[list[str]]:
    lengths: dict[int, list[str]] = {}
    for w in words:
        lengths.setdefault(len(w), []).append(w)
    for same in lengths.values():
        for k in range(0, len(same), size):
            yield same[k : k + size]


def _lifted(table: np.ndarray, pieces: list[str]) -> np.ndarray:
    """Probabilities times exp(LIFT) for each character, so that long words stay within a double; 0 for no piece."""
    sizes = np.array([len(p) for p in pieces], dtype=np.float64)
    return np.concatenate([np.exp(table + LIFT * sizes[:, None]), np.zeros((1, table.shape[1]))])


def _portions(found: list[list[str]], most: int) -> Iterator[list[tuple[int, list[str]]]]:
    """(text, words of it) in lists that hold at most ``most`` words; a longer text's words come in several."""
    part, held = [], 0
    for k, words in enumerate(found):
        for i in range(0, len(words), most):
            cut = words[i : i + most]
            if part and held + len(cut) > most:
                yield part
                part, held = [], 0
            part.append((k, cut))
            held += len(cut)
    if part:
        yield part


def _forward(matcher: Matcher, words: list[str], lifted: np.ndarray, spans: list | None = None) -> tuple[np.ndarray, list]:
    """Forward values (place, word, language), times exp(LIFT * place), and the spans they were made from."""
    n = len(words[0])
    alpha = np.zeros((n + 1, len(words), lifted.shape[1]))
    alpha[0] = 1
    spans = list(matcher.spans(words)) if spans is None else spans
    for start, end, piece in spans:
        alpha[end] += alpha[start] * lifted[piece]
        if start == end - 1:  # the last span of an end: a character alone, where nothing else led there
            none = alpha[end, :, 0] == 0
            alpha[end, none] = alpha[start, none] * np.exp(UNKNOWN + LIFT)
    return alpha, spans


def _stretches(word: str) -> list[tuple[int, int]]:
    return [(k, min(len(word), k + STRETCH)) for k in range(0, len(word), STRETCH)]


def _long_forward(matcher: Matcher, word: str, logs: np.ndarray, kept: np.ndarray | None = None) -> np.ndarray:
    """Log likelihood of one word in each language. logs: (piece, language), with a last row for no piece.

    Only the last ``longest`` values are held; ``kept``, if given, gets all of them.
    """
    sizes, ring = np.array(matcher.sizes), matcher.longest + 1
    last = np.full((ring, logs.shape[1]), -np.inf)
    last[0] = 0
    for begin, end in _stretches(word):
        for k, pieces in enumerate(matcher.stretch(word, begin, end), begin + 1):
            value = np.logaddexp.reduce(last[(k - sizes) % ring] + logs[pieces], axis=0)
            if value[0] == -np.inf:  # no piece leads here, in any language
                value = last[(k - 1) % ring] + UNKNOWN
            last[k % ring] = value
            if kept is not None:
                kept[k] = value
    return last[len(word) % ring]


def _long_expected(matcher: Matcher, word: str, logs: np.ndarray, expected: np.ndarray) -> None:
    """Adds the expected number of each piece in one word, in the one language of ``logs``."""
    sizes = np.array(matcher.sizes)
    forward = np.zeros((len(word) + 1, 1))
    total = _long_forward(matcher, word, logs, forward)[0]
    forward, one = forward[:, 0], logs[:, 0]
    backward = np.full(len(word) + 1, -np.inf)
    backward[-1] = 0
    for begin, end in reversed(_stretches(word)):
        pieces = matcher.stretch(word, begin, end)
        for k in range(end, begin, -1):
            at = pieces[k - 1 - begin]
            at, starts = at[at != matcher.none], k - sizes[at != matcher.none]
            at, starts = at[forward[starts] > -np.inf], starts[forward[starts] > -np.inf]
            if not len(at):
                at_unknown = backward[k] + UNKNOWN
                backward[k - 1] = np.logaddexp(backward[k - 1], at_unknown)
                continue
            step = one[at] + backward[k]
            backward[starts] = np.logaddexp(backward[starts], step)
            expected[at] += np.exp(forward[starts] + step - total)


class LanguageModel:
    """``log_likelihoods(words)``: of each word in each language."""

    def __init__(self, pieces: list[str], languages: list[str], table: np.ndarray):
        self.pieces, self.languages, self.table = pieces, languages, table
        self._matcher = None
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.rows = np.zeros((0, len(self.languages)))

    def __getstate__(self) -> tuple:
        return self.pieces, self.languages, self.table

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def log_likelihoods(self, words: list[str]) -> np.ndarray:
        if self._matcher is None:
            self._matcher, self._lifted = Matcher(self.pieces), _lifted(self.table, self.pieces)
            self._logs = np.concatenate([self.table, np.full((1, self.table.shape[1]), -np.inf)])
        n = len(self.languages)
        out = np.empty((len(words), n))
        place = {w: k for k, w in enumerate(words)}
        for same in _by_length([w for w in words if len(w) <= SHORT], min(20_000, 80_000 // min(n, BLOCK))):
            at, marked = [place[w] for w in same], [MARK + w for w in same]
            spans = list(self._matcher.spans(marked))
            for k in range(0, n, BLOCK):
                alpha, _ = _forward(self._matcher, marked, self._lifted[:, k : k + BLOCK], spans)
                out[at, k : k + BLOCK] = np.log(alpha[-1]) - LIFT * (len(same[0]) + 1)
        for w in words:
            if len(w) > SHORT:
                out[place[w]] = _long_forward(self._matcher, MARK + w, self._logs)
        return out

    def _places(self, words: list[str], cache_words: int) -> None:
        """Score those of the words that the cache lacks."""
        new = [w for w in set(words) if w not in self.number]
        if len(self.number) + len(new) > cache_words and self.number:
            self._forget()
            new = list(set(words))
        if new:
            n = len(self.number)
            self.number.update((w, n + k) for k, w in enumerate(new))
            if n + len(new) > len(self.rows):  # twice as many places, so values are moved seldom
                self.rows = np.concatenate([self.rows[:n], np.empty((n + 2 * len(new), self.rows.shape[1]))])
            self.rows[n : n + len(new)] = self.log_likelihoods(new)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and posterior probability of each text, all languages equal beforehand."""
        found = [words_of(x) for x in texts]
        if not self.languages:
            return [("und", 0.0)] * len(texts)
        most = max(1, CACHE_VALUES // len(self.languages))
        totals = np.zeros((len(texts), len(self.languages)))
        for part in _portions(found, most):
            self._places([w for _, words in part for w in words], min(CACHE_WORDS, most))
            for k, words in part:
                at = np.fromiter(map(self.number.__getitem__, words), dtype=np.int64, count=len(words))
                totals[k] += self.rows[at].sum(axis=0)
        out = []
        for words, total in zip(found, totals, strict=True):
            if not words:
                out.append(("und", 0.0))
                continue
            best = int(np.argmax(total))
            out.append((self.languages[best], float(1 / np.exp(np.minimum(total - total[best], 0)).sum())))
        return out


def expectation(words: list[str], counts: np.ndarray, column: np.ndarray, matcher: Matcher, pieces: list[str]) -> np.ndarray:
    """Expected number of each piece in the words of one language. column: the pieces' log probabilities."""
    expected = np.zeros(len(pieces) + 1)
    lifted = _lifted(column[:, None], pieces)
    one, logs = lifted[:, 0], np.append(column, -np.inf)[:, None]
    weight_of = dict(zip(words, counts.tolist(), strict=True))
    for same in _by_length([w for w in words if len(w) <= SHORT]):
        weight = np.array([weight_of[w] for w in same], dtype=np.float64)
        alpha, spans = _forward(matcher, [MARK + w for w in same], lifted)
        alpha = alpha[:, :, 0]
        beta = np.zeros_like(alpha)
        beta[-1] = 1
        lone = {end: np.ones(len(same), bool) for end in range(len(alpha))}
        for start, end, piece in spans:
            lone[end] &= (piece == matcher.none) | (alpha[start] == 0)
        for start, end, piece in reversed(spans):
            if start == end - 1:
                beta[start] += lone[end] * np.exp(UNKNOWN + LIFT) * beta[end]
            step = one[piece] * beta[end]
            beta[start] += step
            expected += np.bincount(piece, alpha[start] * step / alpha[-1] * weight, len(pieces) + 1)
    for w in words:
        if len(w) > SHORT:
            own = np.zeros(len(pieces) + 1)
            _long_expected(matcher, MARK + w, logs, own)
            expected += weight_of[w] * own
    return expected[:-1]


def _uniform(pieces: list[str]) -> np.ndarray:
    return np.full(len(pieces), -np.log(len(pieces)))


def _maximised(expected: np.ndarray) -> np.ndarray:
    return np.log((expected + SMOOTH) / (expected + SMOOTH).sum())


def learn(counts: dict[str, dict[str, int]], pieces: list[str], rounds: int = ROUNDS) -> LanguageModel:
    """From each language's word counts, by expectation-maximisation over all segmentations, on this machine."""
    languages, matcher, columns = sorted(counts), Matcher(pieces), []
    for lang in languages:
        column, words = _uniform(pieces), sorted(counts[lang])
        for _ in range(rounds + 1):
            n = np.array([counts[lang][w] for w in words], dtype=np.float64)
            column = _maximised(expectation(words, n, column, matcher, pieces))
        columns.append(column)
    return LanguageModel(pieces, languages, np.array(columns).reshape(len(languages), len(pieces)).T)


def sample(docs: DataFrame, fit_docs: int = FIT_DOCS) -> DataFrame:
    """(lang, word, n) of ``fit_docs`` documents of each language outside fold 2 of 4, taken by hash."""
    known = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
    ).filter("doc_id is not null and lang is not null").filter(fold(F.col("doc_id"), 4) != 2)
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    first = F.min(F.struct(draw.alias("draw"), "doc_id")).getField("doc_id").alias("first")
    # a row a language; documents are counted roughly, but repeats of one doc_id as one
    sizes = settle(known.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n"), first), "language-sizes")
    # twice as many as wanted, by hash, where the rows lie: so few reach the ranking, however frequent the language
    known = known.join(sizes, "lang")
    kept = (draw < F.lit(2.0 * fit_docs * (1 << 30)) / F.col("n")) | (F.col("doc_id") == F.col("first"))  # one at least
    known = known.filter(kept).select("doc_id", "lang").distinct()
    order = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = known.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= fit_docs).drop("rank")
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.col("lang").cast("string").alias("lang"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = Counter((lang.as_py(), w) for lang, x in zip(b["lang"], b["text"], strict=True) for w in words_of(x.as_py()))
            yield pa.RecordBatch.from_pydict(
                {"lang": [k[0] for k in counts], "word": [k[1] for k in counts], "n": list(counts.values())},
                pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())]),
            )

    # at most fit_docs rows a language on the right; a repeated document's texts meet in a combining aggregate
    rows = texts.join(settle(chosen, "language-sample"), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    return rows.select("lang", "text").mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, path: str, fit_docs: int = FIT_DOCS) -> LanguageModel:
    """From ``docs`` (doc_id, text, lang) outside fold 2 of 4: ``fit_docs`` documents of each language.

    Every language is learned, BLOCK of them at a time, a task for each TASK_WORDS different words of
    one; the driver and a worker hold a number a piece for each, a worker twice.
    """
    context, pieces, models = docs.sparkSession.sparkContext, vocabulary(path), []
    rows = settle(sample(docs, fit_docs), "language-words")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # a row a language
    names, parts = sorted(r["lang"] for r in sizes), 1 + max((r["n"] for r in sizes), default=0) // TASK_WORDS
    rows = rows.withColumn("part", F.pmod(F.xxhash64("word"), F.lit(parts)).cast("int"))
    for k in range(0, len(names), BLOCK):
        block = names[k : k + BLOCK]
        own = rows.filter(F.col("lang").isin(block)) if len(names) > BLOCK else rows
        table = np.tile(_uniform(pieces)[:, None], len(block))
        for _ in range(ROUNDS + 1):
            expected = np.zeros_like(table)
            sent = context.broadcast((pieces, block, table))
            for r in sorted(own.groupBy("lang", "part").applyInArrow(_expect(sent), "lang string, part int, expected binary").collect()):
                expected[:, block.index(r["lang"])] += np.frombuffer(r["expected"])
            table = _maximised_all(expected)
            sent.destroy()
        models.append(table)
    # a language of the sample whose texts have no letter has no words: unlike the others, it is never predicted
    return LanguageModel(pieces, names, np.concatenate(models, axis=1) if models else np.zeros((len(pieces), 0)))


def _maximised_all(expected: np.ndarray) -> np.ndarray:
    return np.stack([_maximised(x) for x in expected.T], axis=1)


def _expect(sent):
    """A step for the words of one part of a language."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        pieces, block, table = sent.value
        matcher = _worker.keep(("language-pieces", len(pieces), hash(tuple(pieces))), lambda: Matcher(pieces))
        rows = rows.sort_by("word")
        column = table[:, block.index(key[0].as_py())]
        found = expectation(rows["word"].to_pylist(), rows["n"].to_numpy().astype(np.float64), column, matcher, pieces)
        return pa.table({"lang": [key[0].as_py()], "part": pa.array([key[1].as_py()], pa.int32()), "expected": [found.tobytes()]})

    return run


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` (doc_id, text) to (doc_id, lang_pred, score), one row per row, without a shuffle."""
    sent, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _worker.keep(("language", name), lambda: LanguageModel(*sent.value.__getstate__()))
        for b in batches:
            found = []
            for k in range(0, b.num_rows, 500):
                found += own.predict(b["text"][k : k + 500].to_pylist())
            columns = [b["doc_id"], pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, lang_pred string, score double")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every row of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out")
    return predict(docs, fit(docs, default_path())).select("doc_id", held_out, "lang_pred", "score")
