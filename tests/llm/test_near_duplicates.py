"""Operator 7 against all pairs, and the components it rests on."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from lodestar.llm import simhash
from lodestar.llm.components import components

from .corpus import UPPER, awkward_texts, documents, empty, spaced


def brute_print(text) -> int:
    words = spaced((text or "").translate(UPPER))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=4) -> list[int]:
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    return [find(k) for k in range(len(prints))]


def test_fingerprints():
    texts = [t for t in awkward_texts() if len(t or "") < 20_000]
    assert [simhash.fingerprint(t) for t in texts] == [brute_print(t) for t in texts]


def test_rows(spark):
    docs = documents(spark)
    rows = docs.select("doc_id", "text").collect()
    prints = [brute_print(r["text"]) for r in rows]
    roots = brute_components(prints)
    least = {}
    for r, root in zip(rows, roots, strict=True):
        if r["doc_id"] is not None:
            least[root] = min(least.get(root, r["doc_id"]), r["doc_id"])
    want = sorted(((r["doc_id"], f, least.get(c)) for r, f, c in zip(rows, prints, roots, strict=True)), key=repr)
    got = simhash.near_duplicates(docs).collect()
    assert sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got), key=repr) == want
    assert simhash.near_duplicates(empty(spark)).count() == 0


def clouds(n, size, seed):
    """Fingerprints in clouds of few changed bits around random centres, some chained."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, size)):
            for _ in range(rng.randint(0, 6)):
                x ^= 1 << rng.randrange(64)
            out.append(x)
    return out


def linked(spark, prints, bits):
    rows = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in set(prints)], "fp long")
    found = {r["node"]: r["root"] for r in components(simhash._links(rows, rows.count(), bits, 2)).collect()}
    groups = {}
    for x in set(prints):
        x = x - (1 << 64) if x >> 63 else x
        groups.setdefault(found.get(x, x), set()).add(x % (1 << 64))
    return sorted(map(sorted, groups.values()))


def brute_groups(prints):
    distinct = sorted(set(prints))
    groups = {}
    for x, r in zip(distinct, brute_components(distinct), strict=True):
        groups.setdefault(r, []).append(x)
    return sorted(map(sorted, groups.values()))


@pytest.mark.parametrize("bits", [10, 13])
def test_no_link_is_missed(spark, bits):
    prints = clouds(60, 8, bits)
    assert linked(spark, prints, bits) == brute_groups(prints)


def test_hot_prefixes_and_portions(spark, monkeypatch):
    """Nearly all fingerprints under one prefix, dealt again and cut into small portions, give the same."""
    monkeypatch.setattr(simhash, "HOT", 30)
    rng = random.Random(5)
    prints = [x >> 20 for x in clouds(40, 10, 6)] + [rng.getrandbits(44) for _ in range(100)]
    want = brute_groups(prints)
    assert linked(spark, prints, 10) == want
    fps = np.array(sorted(set(prints)), dtype=np.uint64)
    whole = simhash._roots(len(fps), np.concatenate([*simhash._meetings(fps, np.full(len(fps), 2), 64, 2), np.zeros((0, 2), int)]))
    monkeypatch.setattr(simhash, "PORTION", 3000)
    cut = simhash._roots(len(fps), np.concatenate([*simhash._meetings(fps, np.full(len(fps), 2), 64, 2), np.zeros((0, 2), int)]))
    assert (whole == cut).all()
    assert len(set(whole.tolist())) == len(want)


def test_prefixes_grow_with_the_table():
    assert [simhash._prefix_bits(n, 2) for n in (0, 1000, 250_000, 15_000_000, 10**12)] == [10, 10, 10, 18, 24]


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 100 + k) for k in range(50)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(-5, 7), (7, -5)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    assert got == {x: find(x) for x in list(root) if x in got} and {a for e in edges if e[0] != e[1] for a in e} == set(got)


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0
