"""Operator 3: URL filters by a temporal list join.

A list's entries are dated: from its date on, an ``add`` puts a host (and all hosts under it) on the
list and a ``remove`` takes it off. Entries of one list and host become validity intervals, from an
add to the next remove. A capture is judged by what was valid on the day it was fetched, for its
host and the domains above it.

Captures are first reduced to their distinct (host, day) pairs by a combining aggregate, so a host
with a third of all captures costs its days, not its captures. Pairs meet the intervals as of their
day: up to BROADCAST_ROWS intervals are broadcast, and only pairs that some list names move. Beyond
them, pairs and intervals meet by key and salt, so a domain above most hosts (``com``) is spread
over SALTS tasks. The verdicts join back by host and day, where no key is hotter than one day of one
host; captures that have no host or day meet nothing and stay spread as they are.

Nulls and corners: a URL without a host, or a null URL or day, is on no list; entries without list,
host, date or a known action are ignored; on one day the last action by name (``remove``) holds and
repeated entries count once; an add while on the list, or a remove while off it, changes nothing;
an empty list blocks nothing; repeated captures are judged each; an empty table gives no row; a very
long URL is read whole. Captures keep all their columns; a verdict's column whose name one of them
has, in any case, gets ``_`` behind it until it is free.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestar.sources.shared import settle

#: Intervals, of under 100 bytes each, that are broadcast; parts that a key is dealt to beyond them.
BROADCAST_ROWS, SALTS = 100_000, 64


def host_of(url: Column) -> Column:
    """The lower-case host of an absolute URL; null if there is none."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.when(found != "", F.lower(found))


def intervals(entries: DataFrame) -> DataFrame:
    """``entries`` (list, host, action, day) to (list, host, since, until); until: exclusive, null if open."""
    known = entries.select(
        F.col("list").cast("string").alias("list"), F.lower(F.col("host").cast("string")).alias("host"),
        F.col("day").cast("date").alias("day"), F.col("action").cast("string").alias("action"),
    ).filter("list is not null and host is not null and day is not null and action in ('add', 'remove')")
    known = known.groupBy("list", "host", "day").agg(F.max("action").alias("action"))
    order = W.partitionBy("list", "host").orderBy("day")
    changes = known.withColumn("before", F.lag("action", 1, "remove").over(order)).filter("action != before")
    ended = changes.withColumn("until", F.lead("day").over(order)).filter("action = 'add'")
    return ended.select("list", "host", F.col("day").alias("since"), "until")


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", day: str = "fetch_day") -> DataFrame:
    """``captures`` with host, n_lists, lists (sorted, comma-joined) and blocked: the state of the lists on their day."""
    rows = captures.select(
        F.struct(*(F.col(f"`{c}`") for c in captures.columns)).alias("capture"), host_of(F.col(f"`{url}`")).alias("host"),
        F.col(f"`{day}`").cast("date").alias("day"), F.concat(F.lit("?"), F.spark_partition_id().cast("string")).alias("nobody"),
    )
    pairs = rows.select("host", "day").filter("host is not null and day is not null").distinct()
    parts = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    keyed = pairs.select("host", "day", F.explode(above).alias("key"))
    valid = settle(intervals(entries).withColumnRenamed("host", "key"), "list-intervals")
    if valid.count() <= BROADCAST_ROWS:
        met = keyed.join(F.broadcast(valid), "key")
    else:
        keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("host", "day"), F.lit(SALTS)).cast("int"))
        met = keyed.join(valid.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["key", "salt"])
    met = met.filter("since <= day and (until is null or day < until)")
    found = met.groupBy("host", "day").agg(F.array_sort(F.collect_set("list")).alias("found"))  # lists, not rows: few
    found = found.select(F.col("host").alias("at"), F.col("day").alias("on"), "found")
    known = F.when(F.col("host").isNotNull() & F.col("day").isNotNull(), F.col("host")).otherwise(F.col("nobody"))  # no host begins with ?
    lists = F.coalesce(F.col("found"), F.array().cast("array<string>"))
    verdict = {"host": F.col("host"), "n_lists": F.size(lists).cast("long"), "lists": F.array_join(lists, ","), "blocked": F.size(lists) > 0}
    taken = {c.lower() for c in captures.columns}
    joined = rows.join(found, (known == F.col("at")) & (F.col("day") == F.col("on")), "left")
    return joined.select("capture.*", *(c.alias(_free(name, taken)) for name, c in verdict.items()))


def _free(name: str, taken: set[str]) -> str:
    while name in taken:
        name += "_"
    return name


#: The query's stand-ins for a crawl's dates and for published lists: rules over the pages' own URLs.
LISTS = ["adult", "malware", "spam"]
FIRST_DAY, DAYS = "2023-01-01", 730


def _digits(text: Column) -> Column:
    """28 bits of an md5, the same in any engine."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 7), 16, 10).cast("long")


def sample_entries(pages: DataFrame) -> DataFrame:
    """For each list and each host and domain above: up to three dated actions, by hashes."""
    hosts = pages.select(host_of(F.col("url")).alias("host")).filter("host is not null").distinct()
    keys = hosts.unionByName(hosts.select(F.regexp_replace("host", r"^[^.]*\.", "").alias("host"))).distinct()
    keys = keys.withColumn("list", F.explode(F.array(*map(F.lit, LISTS))))
    keys = keys.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    h = _digits(F.concat_ws(":", "list", "host", F.col("k").cast("string")))
    action = F.when(F.col("k") == 1, "remove").otherwise("add")
    keys = keys.withColumn("h", h).filter("h % 5 = 0")
    return keys.select("list", "host", action.alias("action"), F.date_add(F.lit(FIRST_DAY).cast("date"), (F.floor(F.col("h") / 5) % DAYS).cast("int")).alias("day"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by the lists as they were on its day."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), (_digits(F.coalesce("url", F.lit(""))) % DAYS).cast("int"))
    found = judge(pages.withColumn("fetch_day", day), sample_entries(pages)).drop("url")
    return found.withColumn("fetch_day", F.col("fetch_day").cast("string"))


#: The same rows in SQL.
ORACLE = rf"""
WITH p AS (
  SELECT page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '') AS host,
    DATE '{FIRST_DAY}' + CAST(('0x' || substr(md5(coalesce(url, '')), 1, 7))::BIGINT % {DAYS} AS INTEGER) AS fetch_day FROM pages
), k AS (
  SELECT host FROM p WHERE host IS NOT NULL UNION SELECT regexp_replace(host, '^[^.]*\.', '') FROM p WHERE host IS NOT NULL
), e AS (
  SELECT list, host, k, ('0x' || substr(md5(list || ':' || host || ':' || k), 1, 7))::BIGINT AS h
  FROM k, (SELECT unnest(['adult', 'malware', 'spam']) AS list), (SELECT unnest([0, 1, 2]) AS k)
), a AS (
  SELECT list, host, DATE '{FIRST_DAY}' + CAST(h // 5 % {DAYS} AS INTEGER) AS day, max(CASE WHEN k = 1 THEN 'remove' ELSE 'add' END) AS action
  FROM e WHERE h % 5 = 0 GROUP BY ALL
), s AS (
  SELECT DISTINCT p.host, p.fetch_day, a.list, arg_max(a.action, a.day) AS action
  FROM (SELECT DISTINCT host, fetch_day FROM p) p JOIN a ON (p.host = a.host OR ends_with(p.host, '.' || a.host)) AND a.day <= p.fetch_day
  GROUP BY p.host, p.fetch_day, a.list, a.host
), f AS (
  SELECT host, fetch_day, count(DISTINCT list) AS n, string_agg(DISTINCT list, ',' ORDER BY list) AS lists FROM s WHERE action = 'add' GROUP BY ALL
)
SELECT page_id, CAST(p.fetch_day AS VARCHAR) AS fetch_day, p.host, coalesce(n, 0) AS n_lists, coalesce(lists, '') AS lists, coalesce(n, 0) > 0 AS blocked
FROM p LEFT JOIN f ON p.host = f.host AND p.fetch_day = f.fetch_day
"""
