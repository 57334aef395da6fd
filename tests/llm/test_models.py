"""Operators 6 and 9: held-out accuracy, and corners."""

from __future__ import annotations

import math
import random
import string
import zlib
from itertools import product

import numpy as np
import pytest

from conftest import DATA
from lodestar.llm import language, quality
from lodestar.llm.queries import QUERIES

from .corpus import awkward_texts, documents, empty, prose


def test_forward_sums_all_segmentations():
    pieces = sorted({"▁", "a", "b", "ab", "ba", "▁a", "aba"})
    rng = np.random.default_rng(1)
    table = np.log(rng.dirichlet(np.ones(len(pieces)), 2).T)
    model = language.LanguageModel(pieces, ["x", "y"], table)

    def brute(word):
        total = np.zeros(2)
        for cuts in product([0, 1], repeat=len(word) - 1):
            parts, last = [], 0
            for k, c in enumerate(cuts, 1):
                if c:
                    parts.append(word[last:k])
                    last = k
            parts.append(word[last:])
            if all(p in pieces for p in parts):
                total += np.exp(sum(table[pieces.index(p)] for p in parts))
        return np.log(total)

    words = ["a", "ab", "ba", "aba", "abab", "babab"]
    assert np.allclose(model.log_likelihoods(words), [brute("▁" + w) for w in words])
    unknown = model.log_likelihoods(["z"])
    assert np.allclose(unknown, table[pieces.index("▁")] + language.UNKNOWN)


def test_learning_raises_the_likelihood():
    rng = random.Random(2)
    counts = {k: {"".join(rng.choice(letters) for _ in range(rng.randint(2, 9))): rng.randint(1, 9) for _ in range(200)} for k, letters in (("p", "thenri"), ("q", "laosuej"))}
    pieces = language.vocabulary(language.default_path())

    def total(rounds):
        model = language.learn(counts, pieces, rounds)
        return sum(float((model.log_likelihoods(list(c))[:, k] * np.array(list(c.values()))).sum()) for k, c in enumerate(counts.values()))

    values = [total(k) for k in range(3)]
    assert values == sorted(values)


def test_language_corners(spark):
    docs = documents(spark)
    model = language.fit(docs, language.default_path())
    rows = language.predict(docs, model).collect()
    assert len(rows) == docs.count()
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect() if r["doc_id"] not in (None, 3)}
    for r in rows:
        assert 0 <= r["score"] <= 1
        if r["doc_id"] in texts:
            assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in texts[r["doc_id"]] or ""))
    assert language.predict(empty(spark), model).count() == 0
    blank = language.predict(docs, language.fit(empty(spark), language.default_path())).collect()
    assert {r["lang_pred"] for r in blank} == {"und"}


def test_long_words_and_a_small_cache(monkeypatch):
    monkeypatch.setattr(language, "CACHE_WORDS", 3)
    assert language.words_of("½ ² a² ４ Ab") == ["a", "ab"]
    counts = {"p": {"then": 5, "there": 3}, "q": {"las": 4, "casa": 2}}
    model = language.learn(counts, language.vocabulary(language.default_path()))
    got = model.predict(["then there", "x" * 3000, "日本語 casa las", None, "12 34"])
    assert got[0][0] == "p" and got[2][0] == "q" and got[3] == got[4] == ("und", 0.0)
    assert np.isfinite(model.log_likelihoods(["z" * 64, "日" * 64, "日" * 300])).all()


def test_language_held_out(spark):
    want = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang").collect()}
    rows = QUERIES["op6_language"](spark, DATA).collect()
    assert {r["doc_id"] for r in rows} == set(want)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == want[r["doc_id"]] for r in held]) > 0.99


def test_quality_held_out(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    rows = QUERIES["op9_quality"](spark, DATA).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_quality_learns_from_the_least_hashes(spark):
    """The sample is the same whether or not rows are thinned before they are put in order."""
    rng = random.Random(14)
    rows = [(k, prose(rng, 60) if k % 3 else "### $$$ " * 9, int(k % 3 > 0)) for k in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    draws = {r[0]: r[1] for r in docs.selectExpr("doc_id", "pmod(xxhash64(doc_id), 1 << 30)").collect()}
    known = sorted((k for k, _, _ in rows if zlib.crc32(str(k).encode()) % 5), key=lambda k: (draws[k], k))
    few = sorted(known[:300])
    model = quality.fit(docs, docs, 300)
    x, y = np.array([quality.statistics(rows[k][1]) for k in few]), np.array([rows[k][2] for k in few])
    points = np.array([quality.statistics(t) for _, t, _ in rows[:50]])
    assert model.score(points) == pytest.approx(quality.Discriminant(x, y, *quality.shrinkage(x, y)).score(points))


def test_quality_corners(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 0), (None, 1, 0), (3, None, 0), (999, 1, 0), (919, 1, 0), (919, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    assert len({r["score"] for r in quality.score(docs, model).collect()}) == 1  # one class only
    assert quality.score(docs, quality.fit(docs, labels.limit(0))).first()["score"] == 0.5
    kept = quality.keep(docs, model)
    assert kept.columns == docs.columns
    assert quality.score(empty(spark), model).count() == 0


def plain_statistics(text):
    """Character by character and word by word."""
    raw = (text or "").encode()
    words, word = [], []
    for b in [*raw, 32]:
        if chr(b) not in " \t\n\r\x0b\x0c":
            word.append(b)
        elif word:
            words.append(bytes(word))
            word = []
    blank = sum(chr(b) in " \t\n\r\x0b\x0c" for b in raw)
    solid, n = max(1, len(raw) - blank), len(words)
    letters = sum(chr(b) in string.ascii_letters or b >= 0xC0 for b in raw)
    of = lambda chars: math.log(1 + 100 * sum(chr(b) in chars for b in raw) / solid)
    odds = lambda share, n: math.log(share * n + 0.5) - math.log(n - share * n + 0.5)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    pairs = {(a, b) for a, b in zip(words, words[1:], strict=False)}
    return [
        math.log(1 + n), math.log(1 + (len(raw) - blank) / max(1, n)), odds(len({*words}) / max(1, n), n), odds(len(pairs) / max(1, n - 1), max(0, n - 1)),
        of("#*$%&|<>!@^_=+~/\\[]{}`"), of(".,;:'\"?-()"), of(string.digits),
        math.log(1 + 100 * sum(chr(b) in string.ascii_uppercase for b in raw) / max(1, letters)), math.log(1 + 100 * (1 - min(1, letters / solid))),
        math.log(1 + len(lines)), math.log(1 + 100 * (1 - len({*lines}) / max(1, len(lines)))), math.log(1 + 100 * sum(b >= 128 for b in raw) / solid),
    ]


def plain_scores(train, y, points, shrink, pooled):
    """Log densities by determinants and inverses, nothing cached."""
    varies = train.std(axis=0) > 1e-9
    train, points = train[:, varies], points[:, varies]
    mean, scale = train.mean(axis=0), train.std(axis=0)
    train, points = (train - mean) / scale, (points - mean) / scale
    covs = [np.cov(train[y == c].T, bias=True) for c in (0, 1)]
    both = sum((y == c).mean() * covs[c] for c in (0, 1))
    logs = []
    for c in (0, 1):
        cov = (1 - pooled) * covs[c] + pooled * both
        cov = (1 - shrink) * cov + shrink * np.diag(np.diag(cov)) + 1e-3 * np.eye(len(cov))
        d = points - train[y == c].mean(axis=0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1] + math.log((y == c).mean()))
    return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def plain_quality(texts, labels, points):
    """Scores of ``points`` as learned from ``texts`` (id to text) and ``labels`` (id, quality)."""
    known = {k: q for k, q in labels if q is not None and k in texts and not zlib.crc32(str(k).encode()) % 5 == 0}
    ids = sorted(known)
    x, y = np.array([plain_statistics(texts[k]) for k in ids]), np.array([known[k] for k in ids])
    losses = {}
    for pair in product(quality.SHRINKS, quality.TO_POOLED):
        total = 0
        for k in range(quality.FOLDS):
            own = np.arange(len(ids)) % quality.FOLDS == k
            p = np.clip(plain_scores(x[~own], y[~own], x[own], *pair), 1e-6, 1 - 1e-6)
            total -= np.log(np.where(y[own] == 1, p, 1 - p)).sum()
        losses[pair] = round(total, 6)
    return plain_scores(x, y, np.array([plain_statistics(t) for t in points]), *min(losses, key=losses.get))


def test_quality_query_equals_a_plain_version(spark, tmp_path):
    rng = random.Random(11)
    good = lambda: prose(rng, rng.randint(40, 200))
    bad = lambda: " ".join(rng.choice(["click", "###", "$$$", "BUY", "now"]) for _ in range(rng.randint(5, 90))) + "\n" * rng.randint(0, 3)
    quality_of = {k: rng.randint(0, 1) for k in range(150)}
    rows = [(k, good() if (q if rng.random() < 0.9 else 1 - q) else bad()) for k, q in quality_of.items()]
    rows += [(200 + k, x) for k, x in enumerate(awkward_texts()[:-1])] + [rows[3], (None, good())]
    labels = [(k, q) for k, q in quality_of.items()] + [(5, quality_of[5]), (200, 0), (999, 1), (201, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 5 == 0
    want = plain_quality(dict(rows), labels, [t for _, t in rows])
    got = sorted((r["doc_id"] is not None, r["doc_id"], r["score"], r["held_out"]) for r in QUERIES["op9_quality"](spark, str(tmp_path)).collect())
    want = sorted((k is not None, k, s, held(k)) for (k, _), s in zip(rows, want.tolist(), strict=True))
    assert [(a[1], a[3]) for a in got] == [(b[1], b[3]) for b in want]
    assert [a[2] for a in got] == pytest.approx([b[2] for b in want], abs=1e-6)


def test_discriminant_is_the_log_density_difference():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, (400, 3)), rng.normal(1, 2, (600, 3))])
    y = np.repeat([0, 1], [400, 600])
    model = quality.Discriminant(x, y, shrink=0.0, to_pooled=0.0)

    def log_density(part, points):
        mean, cov = part.mean(axis=0), np.cov(part.T, bias=True)
        d = points - mean
        return -0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1] + np.log(len(part) / len(x))

    want = 1 / (1 + np.exp(log_density(x[y == 0], x) - log_density(x[y == 1], x)))
    assert model.score(x) == pytest.approx(want, abs=0.02)  # the fit adds a small ridge
