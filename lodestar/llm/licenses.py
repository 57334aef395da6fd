r"""Operator 2: license scans by a positional rare-token index, in DataFrame functions only.

Templates are license texts (``license_texts``), cut into passages, and the names of licenses. Every
template has a key phrase that must be there, in its key passage. The index has, for the rarest word
of each passage (the highest IDF among templates; of a key passage, the rarest of its key phrase), the
passages and positions where it is that word. It is a hash table in one row that is broadcast; only
texts that hold all words of some key phrase, by a plain search of substrings, meet it.

A text's words that the index has give, with the position there, the places where a passage could
begin. Words of the passage at the same relative positions add up their IDF weights; the key phrase
is verified word by word first. A passage stands where LEAST of its weight does, and a template at
each place of its key passage, if that and the best of its other passages reach LEAST of the
template's weight. Every place of a key phrase holds its rarest word, so none is missed or capped.

All of it happens within a row: no shuffle, whatever the skew, and time in proportion to a text's
length, very long ones included.

Nulls and corners: null text is empty; a text without a license has empty labels, null places and
score 0; a label found many times is listed once; words of equal IDF go by their place in the
passage; repeated rows are scanned each; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import NAMES, TEXTS

NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LEAST = 0.6
#: Slots of the index's hash table, and words of templates that may be broadcast.
SLOTS, MOST_WORDS = 256, 200_000
#: Phrases of the base, each a template and key phrase of its own: fixed values.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}


@dataclass
class Passage:
    """Words with their IDF weights; key: words that must stand at ``key_at``, the anchor among them."""

    template: int
    words: list[str]
    weights: list[float]
    key: list[str]
    key_at: int
    anchor_at: int
    is_key: bool

    @property
    def total(self) -> float:
        return sum(self.weights)


@dataclass
class Template:
    label: str
    base: bool
    key: list[str]
    passages: list[Passage]

    @property
    def total(self) -> float:
        return sum(p.total for p in self.passages)


def _words(text: str) -> list[str]:
    return re.sub(r"[^0-9a-z]+", " ", text.lower()).split()


def templates(texts: list[tuple[str, str, str]] | None = None) -> list[Template]:
    """From (label, key phrase, text): passages are the lines of a text. The base and the names come with them."""
    named = [(label, name, name, True) for name, label in BASE.items()] + [(label, name, name, False) for label, name in NAMES]
    every = named + [(*x, False) for x in (TEXTS if texts is None else texts)]
    bodies = [[_words(line) for line in text.split("\n") if _words(line)] for _, _, text, _ in every]
    seen = Counter(w for lines in bodies for w in {w for line in lines for w in line})
    idf = {w: math.log(1 + len(every) / n) for w, n in seen.items()}
    out = []
    for t, ((label, key, _, base), lines) in enumerate(zip(every, bodies, strict=True)):
        key, passages = _words(key), []
        for words in lines:
            at = next((k for k in range(len(words)) if words[k : k + len(key)] == key), None)
            own = range(len(words)) if at is None or any(p.is_key for p in passages) else range(at, at + len(key))
            anchor = max(own, key=lambda k: (idf[words[k]], -k))
            is_key = len(own) == len(key) and at is not None and own[0] == at and not any(p.is_key for p in passages)
            held = (key, at) if is_key else ([words[anchor]], anchor)
            passages.append(Passage(t, words, [idf[w] for w in words], *held, anchor, is_key))
        if sum(p.is_key for p in passages) != 1:
            raise ValueError(f"the key phrase of {label} must stand in one line of its text")
        out.append(Template(label, base, key, passages))
    return out


INDEX = (
    "slots array<array<struct<word: string, postings: array<struct<p: int, at: int>>>>>,"
    " passages array<struct<t: int, words: array<string>, weights: array<double>, total: double, key: array<string>, key_at: int, is_key: boolean>>,"
    " templates array<struct<label: string, base: boolean, total: double, others: array<int>>>"
)


def _slot(word: str) -> int:
    return zlib.crc32(word.encode()) % SLOTS


def index(spark: SparkSession, found: list[Template]) -> DataFrame:
    """One row: the hash table of anchors, passages by number, templates by number."""
    passages = [p for t in found for p in t.passages]
    if sum(len(p.words) for p in passages) > MOST_WORDS:
        raise ValueError(f"templates of more than {MOST_WORDS} words are too many to broadcast")
    postings: dict[str, list[dict]] = {}
    for k, p in enumerate(passages):
        postings.setdefault(p.words[p.anchor_at], []).append({"p": k, "at": p.anchor_at})
    slots: list[list] = [[] for _ in range(SLOTS)]
    for word, own in postings.items():
        slots[_slot(word)].append({"word": word, "postings": own})
    row = {
        "slots": slots,
        "passages": [{"t": p.template, "words": p.words, "weights": p.weights, "total": p.total, "key": p.key, "key_at": p.key_at, "is_key": p.is_key} for p in passages],
        "templates": [
            {"label": t.label, "base": t.base, "total": t.total, "others": [k for k, p in enumerate(passages) if p.template == n and not p.is_key]}
            for n, t in enumerate(found)
        ],
    }
    return spark.range(1).select(F.col("id").alias("one"), F.from_json(F.lit(json.dumps(row)), INDEX).alias("ix"))


def scan(docs: DataFrame, found: list[Template] | None = None, least: float = LEAST) -> DataFrame:
    """``docs`` (doc_id, text) to doc_id, n_words, matches, one row per row.

    matches: an array of (label, base, place, score), one for each place of a template; place: the
    first word of its key passage in the text, from 0 (below 0 if the text begins within the passage).
    """
    found = templates() if found is None else found
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("low", F.lower("text"))  # finds at least what lower-casing A-Z alone finds
    keys = {tuple(sorted(set(t.key))) for t in found}
    minimal = sorted(k for k in keys if not any(set(o) < set(k) for o in keys))
    likely = F.lit(False)
    for k in minimal:
        likely = likely | _all(F.contains("low", F.lit(w)) for w in sorted(k, key=lambda w: (-len(w), w)))
    upper, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    rows = rows.select("doc_id", F.array_remove(F.split("text", NOT_WORD), "").alias("cased"), F.when(likely, F.lit(0).cast("long")).alias("likely"))
    rows = rows.join(F.broadcast(index(docs.sparkSession, found)), F.col("likely") == F.col("one"), "left")
    rows = rows.withColumn(
        "words", F.expr(f"if(likely is null, cast(array() as array<string>), transform(cased, w -> translate(w, '{upper}', '{small}')))")
    )
    slot = f"get(ix.slots, cast(crc32(cast(x.w as binary)) % {SLOTS} as int))"
    rows = rows.withColumn(
        "starts",
        F.expr(f"flatten(flatten(transform(filter(transform(words, (w, i) -> struct(w, i)), x -> exists({slot}, e -> e.word = x.w)),"
               f" x -> transform(filter({slot}, e -> e.word = x.w), e -> transform(e.postings, p -> struct(p.p, x.i - p.at as at))))))"),
    )
    weight = "aggregate(transform(s.words, (w, k) -> if(get(words, x.at + k) <=> w, get(s.weights, k), 0.0D)), 0.0D, (a, y) -> a + y)"
    key = "x.at + s.key_at >= 0 and slice(words, x.at + s.key_at + 1, size(s.key)) = s.key"
    # a passage bound to s by an array of one
    one = f"get(transform(array(get(ix.passages, x.p)), s -> struct(x.p, s.t, s.is_key, x.at, s.total, if({key}, {weight}, 0.0D) as got)), 0)"
    rows = rows.withColumn("stands", F.expr(f"filter(transform(starts, x -> {one}), y -> y.got / y.total >= {least}D)"))
    # of a template, what the best of each of its other passages adds
    best = "aggregate(rest, 0.0D, (a, y) -> if(y.p = q, greatest(a, y.got), a))"
    added = f"transform(ix.templates, t -> aggregate(t.others, 0.0D, (b, q) -> b + {best}))"
    match = (
        "get(transform(array(get(ix.templates, y.t)), t -> struct(t.label, t.base, cast(y.at as bigint) as place,"
        " (y.got + get(added, y.t)) / t.total as score)), 0)"
    )
    matches = f"filter(transform(filter(stands, y -> y.is_key), y -> {match}), m -> m.score >= {least}D)"
    bound = f"get(transform(array(filter(stands, y -> not y.is_key)), rest -> get(transform(array({added}), added -> {matches}), 0)), 0)"
    none = "cast(array() as array<struct<label: string, base: boolean, place: bigint, score: double>>)"
    return rows.select("doc_id", F.size("cased").cast("long").alias("n_words"), F.expr(f"if(size(stands) > 0, {bound}, {none})").alias("matches"))


def _all(conditions) -> Column:
    out = None
    for c in conditions:
        out = c if out is None else out & c
    return out


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses named in every row of ``documents``."""
    rows = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = "filter(matches, m -> m.base)"
    labels = "array_join(sort_array(array_distinct(transform({}, m -> m.label))), ',')"
    return rows.select(
        "doc_id",
        "n_words",
        F.expr(f"cast(size({base}) as bigint)").alias("n_base"),
        F.expr(f"array_min(transform({base}, m -> m.place))").alias("first_word"),
        F.expr(f"array_max(transform({base}, m -> m.place))").alias("last_word"),
        F.expr(labels.format(base)).alias("base_labels"),
        F.expr(labels.format("matches")).alias("labels"),
        F.expr("round(coalesce(array_max(transform(matches, m -> m.score)), 0.0D), 9)").alias("score"),
    )


def oracle() -> str:
    """The same rows in SQL, from the same templates."""
    found = templates()
    passages = [p for t in found for p in t.passages]
    words = ", ".join(
        f"({k}, {i}, '{w}', {p.weights[i]!r}::DOUBLE, {p.key_at <= i < p.key_at + len(p.key)})" for k, p in enumerate(passages) for i, w in enumerate(p.words)
    )
    of = ", ".join(f"({k}, {p.template}, {p.is_key}, {p.total!r}::DOUBLE, {len(p.key)})" for k, p in enumerate(passages))
    names = ", ".join(f"({k}, '{t.label}', {t.base}, {t.total!r}::DOUBLE)" for k, t in enumerate(found))
    return rf"""
WITH w(p, i, word, weight, in_key) AS (VALUES {words}),
s(p, t, is_key, total, keys) AS (VALUES {of}),
t(t, label, base, total) AS (VALUES {names}),
d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), l AS (
  SELECT row, unnest(w) AS word, unnest(range(len(w))) AS place FROM d
), a AS (
  SELECT row, p, place - i AS place, sum(weight ORDER BY i) AS got, count(*) FILTER (in_key) AS keys
  FROM l JOIN w USING (word) GROUP BY row, p, place - i
), f AS (
  SELECT row, a.p, s.t, is_key, place, got FROM a JOIN s ON a.p = s.p AND a.keys = s.keys WHERE got / total >= {LEAST}::DOUBLE
), o AS (
  SELECT row, t, sum(got ORDER BY p) AS got FROM (SELECT row, t, p, max(got) AS got FROM f WHERE NOT is_key GROUP BY row, t, p) GROUP BY row, t
), m AS (
  SELECT f.row, place, label, base, (f.got + coalesce(o.got, 0)) / total AS score
  FROM f JOIN t USING (t) LEFT JOIN o ON f.row = o.row AND f.t = o.t WHERE is_key AND (f.got + coalesce(o.got, 0)) / total >= {LEAST}::DOUBLE
), r AS (
  SELECT row, count(*) FILTER (base) AS n_base, min(place) FILTER (base) AS first_word, max(place) FILTER (base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
    max(score) AS score
  FROM m GROUP BY row
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(score, 0), 9) AS score
FROM d LEFT JOIN r USING (row)
"""


ORACLE = oracle()
