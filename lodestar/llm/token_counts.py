"""Operator 1: token counts by a count-only Viterbi.

The tokenizer is a unigram model over a fixed public vocabulary: the pieces of a sentencepiece file
with log probabilities by Zipf's law over their ranks (``zipf``). White space is cut as the library's
Metaspace pre-tokenizer cuts it: a mark stands for a space, one is put in front of the text, and
pieces never cross into the next word. So a text's count is the sum of its words' counts, and each
word is counted once for each worker and kept in a bounded cache.

An Aho-Corasick automaton lists the vocabulary's matches in a word by their ends, longest first.
Each end keeps the best score and its number of tokens, no back pointers. The tie rule is the
library's: the first path found wins, and starts come from left to right, so only a higher score
replaces one. A character that no piece of length one matches may be an unknown token, scored 10
below the least piece; neighbouring unknown tokens count as one.

Nulls and corners: null or empty text has no tokens; repeated rows are counted each; an empty table
gives no row; other columns are ignored; very long words take time in proportion to their length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _worker

MARK, UNKNOWN, PENALTY = "▁", "<unk>", 10.0
#: Words, and characters of words, that a worker's cache may hold.
CACHE_WORDS, CACHE_CHARS = 700_000, 16_000_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def zipf(path: str) -> list[tuple[str, float]]:
    """The vocabulary: the unknown token, then the file's ordinary pieces, each with a log probability."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    odd = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
    pieces = [model.id_to_piece(k) for k in ids if not any(f(k) for f in odd)]
    total = math.log(sum(1 / k for k in range(1, len(pieces) + 1)))
    return [(UNKNOWN, 0.0)] + [(p, -math.log(k) - total) for k, p in enumerate(pieces, 1)]


class Counter(dict):
    """Word to its number of tokens, counted when first asked for."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score, piece == UNKNOWN))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in vocabulary) - PENALTY
        self.chars = 0

    def __missing__(self, word: str) -> int:
        self[word] = n = self.count(MARK + word)
        self.chars += len(word)
        return n

    def count(self, word: str) -> int:
        """Tokens of a word with its mark."""
        ends: list[list] = [[] for _ in range(len(word) + 1)]
        for last, match in self.automaton.iter(word):
            ends[last + 1].append(match)
        best, tokens, in_unknown = [0.0], [0], [False]
        for end in range(1, len(word) + 1):
            top, n, unknown, alone = None, 0, False, False
            for size, score, is_unknown in ends[end]:
                alone = alone or size == 1
                start = end - size
                found = score + best[start]
                if top is None or found > top:
                    top, unknown = found, is_unknown
                    n = tokens[start] + (not (is_unknown and in_unknown[start]))
            if not alone:
                found = self.unknown + best[end - 1]
                if top is None or found > top:
                    top, unknown = found, True
                    n = tokens[end - 1] + (not in_unknown[end - 1])
            best.append(top)
            tokens.append(n)
            in_unknown.append(unknown)
        return tokens[-1]

    def of_text(self, text: str | None) -> int:
        """Tokens of a whole text."""
        if not text:
            return 0
        if len(self) > CACHE_WORDS or self.chars > CACHE_CHARS:
            self.clear()
            self.chars = 0
        text = text.replace(MARK, " ")
        words = text[1:].split(" ") if text[0] == " " else text.split(" ")
        return sum(map(self.__getitem__, words))


def counter(path: str) -> Counter:
    """This worker's counter."""
    return _worker.keep(("token_counts", path), lambda: Counter(zipf(path)))


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` (doc_id, text) to (doc_id, n_chars, n_tokens), one row per row, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).of_text
        for b in batches:
            n = [count(x.as_py()) for x in b["text"]]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["n_chars"], pa.array(n, pa.int64())], names=["doc_id", "n_chars", "n_tokens"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(text).cast("long").alias("n_chars"), text.alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_chars long, n_tokens long")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every row of ``documents``."""
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_path())
