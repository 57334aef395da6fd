from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lodestar.llm import url_filter


def test_hosts(spark):
    cases = {
        "http://A.Example.com/x": "a.example.com", "https://u:p@h.org:8080/?q#f": "h.org", "ftp://x.y": "x.y", "//no.scheme/x": None,
        "": None, None: None, "mailto:a@b": None, "http://": None,
    }
    rows = spark.createDataFrame([(u,) for u in cases], "url string").select("url", url_filter.host_of(F.col("url")).alias("h")).collect()
    assert {r["url"]: r["h"] for r in rows} == cases


def brute(captures, entries):
    out = []
    for key, url, day in captures:
        host = url.split("/")[2].lower() if url and "//" in url else None
        state = {}
        known = {(a, b.lower(), d, c) for a, b, c, d in entries if None not in (a, b, c, d) and c in ("add", "remove")}
        for name, on, at, action in sorted(known):
            if day is not None and host and (host == on or host.endswith("." + on)) and at <= day:
                old = state.get((name, on), (at, action))
                state[name, on] = max(old, (at, action))
        lists = sorted({name for (name, _), (_, action) in state.items() if action == "add"})
        out.append((key, host, len(lists), ",".join(lists), bool(lists)))
    return sorted(out)


@pytest.mark.parametrize("most", [100_000, 0])
def test_as_of(spark, monkeypatch, most):
    """Intervals broadcast, and met by salted keys."""
    monkeypatch.setattr(url_filter, "BROADCAST_ROWS", most)
    rng = random.Random(1)
    day = lambda: dt.date(2024, 1, 1) + dt.timedelta(rng.randrange(20))
    hosts = ["a.com", "b.a.com", "c.b.a.com", "d.org", "hot.net"]
    entries = [(rng.choice("xyz"), rng.choice(hosts).upper(), rng.choice(["add", "remove", "add", "drop"]), day()) for _ in range(60)]
    entries += [(None, "a.com", "add", day()), ("x", None, "add", day()), ("x", "a.com", "add", None), entries[0], entries[0]]
    captures = [(k, f"https://{rng.choice(hosts + ['hot.net'] * 5)}/p{k}", day()) for k in range(300)]
    captures += [(900, None, day()), (901, "nonsense", day()), (902, "https://a.com/", None), (903, "https://a.com/", dt.date(1999, 1, 1))]
    rows = spark.createDataFrame([(*c, "k", 1, "f") for c in captures], "page_id long, url string, fetch_day date, key string, day int, found string")
    table = spark.createDataFrame(entries, "list string, host string, action string, day date")
    got = url_filter.judge(rows, table)
    assert set(rows.columns) < set(got.columns)
    want = [(k, h if u and "//" in u else None, n, names, b) for (k, h, n, names, b), (_, u, _) in zip(brute(captures, entries), sorted(captures, key=lambda c: c[0]), strict=True)]
    assert sorted(tuple(r) for r in got.select("page_id", "host", "n_lists", "lists", "blocked").collect()) == want
    assert not url_filter.judge(rows, table.limit(0)).filter("blocked").count()
    assert url_filter.judge(rows.limit(0), table).count() == 0


def test_captures_keep_columns_of_clashing_names(spark):
    rows = spark.createDataFrame(
        [(1, "https://bad.com/", "own host", 7, True, "l", "c", "k", 5, 6, "?0"), (2, None, "h", 8, False, "m", "d", "k", 5, 6, "x")],
        "page_id long, url string, Host string, n_lists int, blocked boolean, lists string, capture string, key string, salt int, at int, nobody string",
    ).withColumns({"fetch_day": F.lit("2024-01-05").cast("date"), "on": F.lit(1), "found": F.lit(2), "host_": F.lit(3)})
    entries = spark.createDataFrame([("spam", "bad.com", "add", dt.date(2024, 1, 2))], "list string, host string, action string, day date")
    got = url_filter.judge(rows, entries)
    assert got.columns == [*rows.columns, "host__", "n_lists_", "lists_", "blocked_"]
    found = {r["page_id"]: r for r in got.collect()}
    assert [tuple(found[k])[: len(rows.columns)] for k in (1, 2)] == [tuple(r) for r in sorted(rows.collect())]
    assert [(found[k]["host__"], found[k]["n_lists_"], found[k]["blocked_"]) for k in (1, 2)] == [("bad.com", 1, True), (None, 0, False)]
