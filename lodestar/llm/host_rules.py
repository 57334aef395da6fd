r"""Operator 8: quality rules with host-level verdicts, in DataFrame functions only.

Counts come from whole texts, row by row, without a shuffle: words ``[^\x20\x09-\x0D]+``, symbols,
lines equal to an earlier one, and words in three-word windows that stand in the text twice or more.
A document collects points: one for a rule it fails, two for one that it fails badly. Failures are
added up by host; a beta prior, fitted to the hosts' rates by moments, shrinks each host's rate, so
a host of few documents is judged mostly like the others. The shrunk rate joins back to the
documents as the odds that one of this host is bad, and each point multiplies the odds by ``POINT``.
A document without points is never rejected by its host.

A host's rows are counted by a combining aggregate, and the join back is one row to each document,
broadcast by Spark where the hosts are few and split where one host has very many documents.

Nulls and corners: null text has no words and so fails; rows without a source are a host of their
own; a rate whose odds are just 1 keeps the document; an empty table gives no row; repeated rows are
judged each; a very long text is counted whole, in time in proportion to its words (times the
logarithm of their number where windows repeat); other columns are kept or ignored, whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.sources.shared import settle

SPACE = r"[\x20\x09-\x0D]+"
MIN_WORDS, MAX_REPEATED, MANY_LINES = 50, 50, 3
#: What a point multiplies the odds by, and the weight of the prior where hosts' rates don't differ.
POINT, PRIOR_DOCS = 20.0, 20.0
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def counts(docs: DataFrame, text: str, name: str) -> DataFrame:
    """``docs`` and a struct column ``name`` of the counts; ``name`` and ``name_*`` are no columns of docs."""
    c = {k: f"{name}_{k}" for k in ("text", "words", "lines", "hashes", "sorted", "places")}
    keep = docs.columns
    rows = docs.withColumn(c["text"], F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    rows = rows.withColumn(c["words"], F.array_remove(F.split(c["text"], SPACE), ""))
    rows = rows.withColumn(c["lines"], F.expr(rf"filter(split({c['text']}, '\\n'), x -> rlike(x, '[^\\x20\\x09-\\x0D]'))"))
    # a window of three words by a 64-bit hash; windows of one text number a few thousand
    rows = rows.withColumn(
        c["hashes"],
        F.expr(f"slice(transform({c['words']}, (w, i) -> xxhash64(w, get({c['words']}, i + 1), get({c['words']}, i + 2))),"
               f" 1, greatest(size({c['words']}) - 2, 0))"),
    )
    # only where a window repeats: windows by hash, those next to an equal one, their places in order
    rows = rows.withColumn(
        c["sorted"],
        F.expr(f"if(size(array_distinct({c['hashes']})) < size({c['hashes']}),"
               f" sort_array(transform({c['hashes']}, (h, i) -> struct(h, i))), array())"),
    )
    rows = rows.withColumn(
        c["places"],
        F.expr(f"sort_array(transform(filter({c['sorted']}, (x, j) -> x.h = get({c['sorted']}, j - 1).h"
               f" or x.h = get({c['sorted']}, j + 1).h), x -> x.i))"),
    )
    # a window covers three words, or up to the next one's first
    covered = F.expr(f"aggregate(transform({c['places']}, (p, j) -> least(3, coalesce(get({c['places']}, j + 1) - p, 3))),"
                     " 0L, (a, x) -> a + x)")  # fmt: skip
    found = {
        "n_words": F.size(c["words"]),
        "word_chars": F.length(F.array_join(c["words"], "")),
        "n_symbols": F.length(c["text"]) - F.length(F.regexp_replace(c["text"], "[#*$%&|<>]+", "")),
        "n_dup_lines": F.size(c["lines"]) - F.size(F.array_distinct(c["lines"])),
        "n_repeat_words": covered,
        "n_lines": F.size(c["lines"]),
    }
    return rows.select(*(f"`{k}`" for k in keep), F.struct(*(found[k].cast("long").alias(k) for k in _COUNTS)).alias(name))


def base_failed(c: Column) -> Column:
    return (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEATED * c["n_words"])


def points(c: Column) -> Column:
    """0 for a document that fails no rule."""

    def rule(fails: Column, badly: Column) -> Column:
        return F.when(badly, 2).when(fails, 1).otherwise(0)

    n, many = c["n_words"], c["n_dup_lines"] >= MANY_LINES  # one line twice says nothing of three lines
    return (
        rule(10 * c["n_symbols"] > n, 2 * c["n_symbols"] > n)
        + rule(many & (10 * c["n_dup_lines"] > 3 * c["n_lines"]), many & (10 * c["n_dup_lines"] > 6 * c["n_lines"]))
        + rule(100 * c["n_repeat_words"] > 30 * n, F.lit(False))
        + rule((10 * c["word_chars"] < 25 * n) | (c["word_chars"] > 12 * n), (c["word_chars"] < 2 * n) | (c["word_chars"] > 20 * n))
    )


def host_rates(rows: DataFrame, host: Column, failed: Column) -> DataFrame:
    """(host, rate): each host's share of failed rows, shrunk by a beta prior fitted to all hosts."""
    hosts = rows.groupBy(host.alias("host")).agg(F.count(F.lit(1)).alias("n"), F.sum(failed.cast("long")).alias("k"))
    hosts = settle(hosts, "hosts")
    share = F.col("k") / F.col("n")
    prior = hosts.agg(
        F.count(F.lit(1)).alias("hosts"), F.sum("n").alias("docs"), F.sum("k").alias("failed"),
        F.avg(share).alias("mean"), F.coalesce(F.var_samp(share), F.lit(0.0)).alias("var"),
        F.avg(1 / F.col("n")).alias("inverse"),
    )
    # moments of the beta: the variance of rates beyond what their sampling explains
    center = (F.col("failed") + 1) / (F.col("docs") + 2)
    between = F.col("var") - center * (1 - center) * F.col("inverse")
    weight = F.when(between > 0, center * (1 - center) / between - 1).otherwise(F.lit(PRIOR_DOCS))
    weight = F.least(F.greatest(weight, F.lit(2.0)), F.lit(1000.0))
    center, weight = prior.select(F.coalesce(center, F.lit(0.5)), weight).first()  # two numbers
    rate = (F.col("k") + F.lit(center * weight)) / (F.col("n") + F.lit(weight))
    return hosts.select("host", rate.alias("rate"))


def verdicts(docs: DataFrame, name: str = "rules", with_text: bool = True) -> DataFrame:
    """``docs`` (text, source, more) and the struct ``name``: the counts, base_failed, kept, host_rate.

    The counted rows are written once, so hosts and verdicts come from one reading of the texts.
    """
    rows = counts(docs, "text", name)
    rows = rows if with_text else rows.drop("text")
    columns, c = rows.columns[:-1], F.col(name)
    rows = rows.withColumn(name, F.struct(f"{name}.*", base_failed(c).alias("base_failed"), points(c).alias("points")))
    rows = settle(rows, "ruled")
    rates = host_rates(rows, F.col("source"), c["base_failed"] | (c["points"] > 0))
    rates = rates.withColumnsRenamed({"host": f"{name}_host", "rate": f"{name}_rate"})
    rows = rows.join(rates, F.col("source").eqNullSafe(F.col(f"{name}_host")), "left")
    rate = F.col(f"{name}_rate")
    odds = rate / (1 - rate) * F.pow(F.lit(POINT), c["points"])
    kept = ~c["base_failed"] & ((c["points"] == 0) | (odds <= 1))
    judged = F.struct(f"{name}.*", kept.alias("kept"), rate.alias("host_rate"))
    return rows.select(*(f"`{k}`" for k in columns), judged.alias(name))


def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict for every row of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    found = verdicts(docs, with_text=False)
    return found.select("doc_id", *(f"rules.{k}" for k in _COUNTS[:-1]), "rules.base_failed", "rules.kept")


#: The same rows in SQL.
ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents
), windows AS (
  SELECT row, k, w[k] AS a, w[k + 1] AS b, w[k + 2] AS c
  FROM (SELECT row, w, unnest(range(1, greatest(len(w) - 1, 1))) AS k FROM d)
), repeated AS (
  SELECT row, count(DISTINCT place) AS n FROM (
    SELECT row, unnest(range(k, k + 3)) AS place
    FROM (SELECT row, k, count(*) OVER (PARTITION BY row, a, b, c) AS times FROM windows) WHERE times > 1)
  GROUP BY row
), c AS (
  SELECT d.row, doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
    CAST(len(lines) AS BIGINT) AS n_lines
  FROM d LEFT JOIN repeated USING (row)
), p AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    CASE WHEN 2 * n_symbols > n_words THEN 2 WHEN 10 * n_symbols > n_words THEN 1 ELSE 0 END
    + CASE WHEN n_dup_lines < 3 THEN 0 WHEN 10 * n_dup_lines > 6 * n_lines THEN 2 WHEN 10 * n_dup_lines > 3 * n_lines THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 1 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 2
        WHEN 10 * word_chars < 25 * n_words OR word_chars > 12 * n_words THEN 1 ELSE 0 END AS points
  FROM c
), h AS (
  SELECT source, count(*) AS n, CAST(sum(CASE WHEN base_failed OR points > 0 THEN 1 ELSE 0 END) AS BIGINT) AS k FROM p GROUP BY source
), m AS (
  SELECT (sum(k) + 1)::DOUBLE / (sum(n) + 2)::DOUBLE AS center, coalesce(var_samp(k / n), 0) AS var, avg(1 / n) AS inverse FROM h
), b AS (
  SELECT center, least(greatest(CASE WHEN var - center * (1 - center) * inverse > 0
    THEN center * (1 - center) / (var - center * (1 - center) * inverse) - 1 ELSE 20.0::DOUBLE END, 2.0::DOUBLE), 1000.0::DOUBLE) AS weight FROM m
), r AS (
  SELECT source, (k + center * weight) / (n + weight) AS rate FROM h, b
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (points = 0 OR rate / (1 - rate) * pow(20.0::DOUBLE, points) <= 1) AS kept
FROM p JOIN r ON p.source IS NOT DISTINCT FROM r.source
"""
