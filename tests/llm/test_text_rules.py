"""Operators 2, 4 and 8 against plain Python."""

from __future__ import annotations

import hashlib
import random
import time

import numpy as np
import pytest

from lodestar.llm import decontaminate, host_rules, license_texts, licenses

from .corpus import alnum, awkward_texts, by_row, documents, empty, prose, spaced

LICENSED = [
    "This is under the GNU General Public License, version 3.", "gnu general public license GNU-General.Public/License", "Apache License", "apache  license version 2.0 and MIT license",
    "Licensed under CC BY-NC 4.0", "cc by cc by", "gnu general public", "mit licenses", "xgnu general public license", "GNU general public license version 2 or MIT License\nCC BY 4.0",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "permission granted free of charge to any person", "Kit mit license mit license",
]


def brute_license(text):
    words, base, found, limits = alnum(text), [], [], []

    def places(p):
        for start in range(-len(p.words), len(words)):
            if start + p.key_at >= 0 and words[start + p.key_at : start + p.key_at + len(p.key)] == p.key:
                got = sum(x for k, (w, x) in enumerate(zip(p.words, p.weights, strict=True)) if 0 <= start + k < len(words) and words[start + k] == w)
                if got / p.total >= licenses.LEAST:
                    yield start, got

    for t in licenses.templates():
        keys = [x for p in t.passages if p.is_key for x in places(p)]
        rest = sum(max((got for _, got in places(p)), default=0) for p in t.passages if not p.is_key) if keys else 0
        for start, got in keys:
            limits.append((got + rest) / t.total)
            if limits[-1] >= licenses.LEAST:
                found.append((t.label, limits[-1]))
                if t.base:
                    base.append((start, t.label))
    join = lambda xs: ",".join(sorted(set(xs)))
    at = [p for p, _ in base]
    return (len(words), len(at), min(at, default=None), max(at, default=None), join(x for _, x in base), join(x for x, _ in found), round(max((s for _, s in found), default=0.0), 9))


def whole_texts():
    rng = random.Random(9)
    for label, _, text in license_texts.TEXTS:
        lines = text.strip().split("\n")
        yield label, "Copyright 2020\n" + text
        yield label, "\n".join(x for line in lines for x in (line, prose(rng, 7)))  # prose between the passages
        yield label, lines[0]
        yield label, " ".join(w for w in text.split() if rng.random() < 0.9)


def test_licenses(spark, tmp_path):
    texts = awkward_texts() + LICENSED + [x for _, x in whole_texts()] + [prose(random.Random(1), 300) + " " + x + " " + prose(random.Random(2), 50) for x in LICENSED]
    docs = documents(spark, texts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = licenses.op2_licenses(spark, str(tmp_path)).collect()
    assert by_row(got) == by_row((r["doc_id"], *brute_license(r["text"])) for r in docs.select("doc_id", "text").collect())
    assert licenses.scan(empty(spark)).count() == 0


def test_whole_texts_are_found(spark):
    texts = [x for k, x in enumerate(whole_texts()) if k % 4 < 2]
    rows = licenses.scan(spark.createDataFrame([(k, x) for k, (_, x) in enumerate(texts)], "doc_id long, text string")).collect()
    for r in rows:
        best = [m["score"] for m in r["matches"] if m["label"] == texts[r["doc_id"]][0]]
        assert max(best) > 0.99 and not any(m["base"] for m in r["matches"] if m["label"] in ("isc", "zlib"))


def test_long_repeated_phrases_take_time_in_proportion(spark):
    """240 KB of one phrase after another, of names and of a whole text."""
    for phrase in ("cc by ", "GNU General Public License version 2 ", license_texts.TEXTS[0][2]):
        took = []
        for n in (60_000, 240_000):
            docs = spark.createDataFrame([(1, phrase * (n // len(phrase)))], "doc_id long, text string")
            licenses.scan(docs).collect()
            began = time.perf_counter()
            found = licenses.scan(docs).first()["matches"]
            took.append(time.perf_counter() - began)
            assert len(found) >= n // len(phrase)
        assert took[1] < 8 * took[0] + 2, took


def brute_contamination(text, items, window=13):
    words = alnum(text)
    hit, found = set(), set()
    for item, body in items:
        body = alnum(body)
        for i in range(max(1, len(body) - window + 1) if body else 0):
            cut = body[i : i + window]
            for k in range(len(words) - len(cut) + 1):
                if words[k : k + len(cut)] == cut:
                    hit.update(range(k, k + len(cut)))
                    found.add(item)
    found = sorted(str(x) for x in found if x is not None)
    digest = hashlib.sha256(",".join(found).encode()).hexdigest()
    return len(words), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(words)


def contamination_case():
    rng = random.Random(3)
    bodies = [prose(rng, n, 40) for n in (30, 14, 13, 12, 3, 1, 50)]
    items = [(k, b) for k, b in enumerate(bodies)] + [(11, None), (12, ""), (13, "... !"), (None, bodies[0]), (2, bodies[4]), (20, "the the the")]
    small = [t for t in awkward_texts() if len(t or "") < 20_000]
    texts = small + [prose(rng, 30, 40) + " " + b.upper() + " " + prose(rng, 400, 40) for b in bodies] + bodies + [bodies[0][: len(bodies[0]) // 2], "the " * 40]
    return items, texts


@pytest.mark.parametrize("segment,block,phrases", [(1_000_000, 16_000_000, 1000), (200, 150, 1000), (1000, 0, 3), (1_000_000, 0, 20)])
def test_contamination(spark, monkeypatch, segment, block, phrases):
    """Broadcast phrases, and phrases routed by their rarest terms, to one task a segment and to several."""
    monkeypatch.setattr(decontaminate, "TASK_PHRASES", phrases)
    items, texts = contamination_case()
    docs = documents(spark, texts)
    benchmark = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, hit int")
    index = decontaminate.settle(decontaminate.build_index(docs, segment))
    got = decontaminate.contamination(index, benchmark, block_chars=block).collect()
    want = [(None if r["doc_id"] is None else str(r["doc_id"]), *brute_contamination(r["text"], items)) for r in docs.select("doc_id", "text").collect()]
    assert by_row(got) == by_row(want)


@pytest.mark.parametrize("block", [1000, 0])
def test_contamination_of_nothing(spark, block):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = documents(spark)
    for items in (none, spark.createDataFrame([(k, x) for k in range(500) for x in (None, "", "... !")], "item_id long, text string")):
        rows = decontaminate.contamination(decontaminate.build_index(docs), items, block_chars=block).collect()
        assert len(rows) == docs.count() and not any(r["contaminated"] or r["n_hit"] for r in rows)
    items = spark.createDataFrame([(1, "one two"), (1, "one two")], "item_id long, text string")
    assert decontaminate.contamination(decontaminate.build_index(empty(spark)), items, block_chars=block).count() == 0


def test_matches_and_proximity(spark):
    docs = spark.createDataFrame([(1, "zero one two three four two three"), (2, "one x two three"), (3, "three two one")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "one two three"), (8, "two three"), (8, "two three"), (9, "Two, three!")], "item_id long, text string")
    index = decontaminate.build_index(docs)
    exact = {("1", "7", 1, 3), ("1", "8", 2, 2), ("1", "8", 5, 2), ("2", "8", 2, 2)}
    exact |= {(d, "9", *x) for d, i, *x in exact if i == "8"}
    for block in (1000, 0):
        assert sorted(map(tuple, decontaminate.matches(index, items, block_chars=block).collect())) == sorted(exact)


def brute_near(words, phrase, slop):
    return [p for p in range(len(words)) if all(any(words[j] == w for j in range(max(0, p + k - slop), min(len(words), p + k + slop + 1))) for k, w in enumerate(phrase))]


def test_proximity_is_exact(spark):
    """Whatever term is the rarest, at a segment's start, and never across documents."""
    rng = random.Random(8)
    texts = ["rare com com com", "b a c d", "end one", "two start", "x b x", "a", "", None, "com rare"] + [" ".join(rng.choices("abcd", k=rng.randint(1, 9))) for _ in range(40)]
    items = ["com rare", "a b c d", "one two", "a b", "c a a d", "b", "d c b a", "zz a"]
    index = decontaminate.build_index(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2))
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for slop in (0, 1, 2):
        want = sorted((str(d), str(i), p, len(alnum(x))) for d, t in enumerate(texts) for i, x in enumerate(items) for p in brute_near(alnum(t), alnum(x), slop))
        for block in (1000, 0):
            assert sorted(map(tuple, decontaminate.matches(index, benchmark, slop, block_chars=block).collect())) == want
        assert slop == 0 or ("0", "0", 0, 2) in want and ("1", "1", 0, 4) in want
    assert not any(i == "2" for _, i, *_ in want)


def brute_counts(text):
    text = text or ""
    words = spaced(text)
    lines = [x for x in text.split("\n") if spaced(x)]
    places = {}
    for k in range(len(words) - 2):
        places.setdefault(tuple(words[k : k + 3]), []).append(k)
    covered = {j for p in places.values() if len(p) > 1 for k in p for j in range(k, k + 3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def plain_verdicts(rows):
    """Whether each of (text, source) is kept, host by host."""
    judged = []
    for text, host in rows:
        n, chars, symbols, dup, repeated = brute_counts(text)
        lines = sum(bool(spaced(x)) for x in (text or "").split("\n"))
        points = (symbols > n / 10) + (symbols > n / 2) + (dup >= 3) * ((dup > 0.3 * lines) + (dup > 0.6 * lines)) + (repeated > 0.3 * n)
        points += (chars < 2.5 * n or chars > 12 * n) + (chars < 2 * n or chars > 20 * n)
        judged.append((host, n < 50 or repeated > 0.5 * n, points))
    hosts = {}
    for host, failed, points in judged:
        n, k = hosts.get(host, (0, 0))
        hosts[host] = n + 1, k + (failed or points > 0)
    mean = (sum(k for _, k in hosts.values()) + 1) / (len(rows) + 2)
    between = (np.var([k / n for n, k in hosts.values()], ddof=1) if len(hosts) > 1 else 0) - mean * (1 - mean) * np.mean([1 / n for n, _ in hosts.values()])
    weight = min(1000, max(2, mean * (1 - mean) / between - 1 if between > 0 else host_rules.PRIOR_DOCS))
    rate = {host: (k + mean * weight) / (n + weight) for host, (n, k) in hosts.items()}
    return [not failed and (points == 0 or rate[h] / (1 - rate[h]) * host_rules.POINT**points <= 1) for h, failed, points in judged]


def test_verdicts_equal_a_plain_version(spark):
    rng = random.Random(13)
    texts = awkward_texts()
    for k in range(200):
        text = prose(rng, rng.randint(40, 120))
        text = text.replace(" ", rng.choice([" ", " ", " ", " # ", " a ", "_"])) if k % 3 == 0 else text
        texts.append("\n".join([text] * rng.choice([1, 1, 2])) if k % 5 else text + "\nmore of it" * rng.randint(0, 9))
    rows = [(k, x, rng.choice(["a", "b", "c", None, f"h{k % 20}"])) for k, x in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["v"]["kept"] for r in host_rules.verdicts(docs, "v").collect()}
    want = plain_verdicts([(x, h) for _, x, h in rows])
    assert [got[k] for k in range(len(rows))] == want and 0 < sum(want) < len(want)


def test_rules(spark):
    docs = documents(spark)
    rows = host_rules.verdicts(docs, "verdict").collect()
    assert set(docs.columns) < set(rows[0].asDict())
    for r in rows:
        want = brute_counts(r["text"])
        assert tuple(r["verdict"][k] for k in host_rules._COUNTS[:-1]) == want
        assert r["verdict"]["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["verdict"]["kept"] and r["verdict"]["base_failed"])
        if not r["verdict"]["base_failed"] and r["verdict"]["points"] == 0:
            assert r["verdict"]["kept"]
    assert host_rules.verdicts(empty(spark), "verdict").count() == 0


def test_hosts_shrink(spark):
    """One failure of one document says less of a host than forty of forty."""
    rng = random.Random(4)
    good, symbols = (lambda: prose(rng, 80)), (lambda: " ".join(w + "#" * (k % 4 == 0) for k, w in enumerate(prose(rng, 80).split())))
    rows = [(k, good(), f"fine{k % 5}") for k in range(200)] + [(200 + k, symbols(), "bad") for k in range(40)] + [(300, symbols(), "fine0"), (301, symbols(), "new"), (302, good(), "bad")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["v"]["kept"], r["v"]["host_rate"]) for r in host_rules.verdicts(docs, "v").collect()}
    assert all(got[k][0] for k in range(200)) and got[302][0]
    assert not any(got[k][0] for k in range(200, 240))
    assert got[300][0]
    assert got[300][1] < got[301][1] < got[200][1]
