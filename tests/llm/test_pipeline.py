"""The registered queries against their SQL, and the pipeline against plain versions of its stages."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

import corpus_pipeline
from conftest import DATA, assert_same
from lodestar.llm import stages
from lodestar.llm.queries import ORACLE_SQL, QUERIES

from .corpus import alnum, documents, empty
from .test_models import plain_quality
from .test_near_duplicates import brute_components, brute_print
from .test_text_rules import plain_verdicts
from .test_tokens import ids_of


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    assert_same(QUERIES[name](spark, DATA), ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_has_its_rows(spark, name):
    rows = QUERIES[name](spark, DATA)
    assert rows.select("doc_id").distinct().count() == spark.read.parquet(f"{DATA}/documents.parquet").count()


def test_stages(spark):
    """Each stage's decisions on its own input, on the small tables."""
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, sources = docs.columns, {r["doc_id"]: r["source"] for r in docs.collect()}
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stages.settle(stage(spark, docs, DATA), name)
        assert docs.columns == columns
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        gone = set(before) - set(after)
        assert gone and set(after.items()) <= set(before.items())
        if name == "quality_classifier":
            ids = sorted(before)
            scores = plain_quality(before, labels.items(), [before[k] for k in ids])
            assert {k for k, s in zip(ids, scores, strict=True) if s < 0.3} == gone
            assert np.mean([labels[k] == 0 for k in gone if k in labels]) > 0.5
        elif name == "quality_rules":
            ids = sorted(before)
            assert {k for k, kept in zip(ids, plain_verdicts([(before[k], sources[k]) for k in ids]), strict=True) if kept} == set(after)
        elif name == "simhash_near_dedup":
            ids = sorted(before)
            roots = brute_components([brute_print(before[k]) for k in ids])
            groups = {}
            for k, r in zip(ids, roots, strict=True):
                groups.setdefault(r, []).append(k)
            assert all(len(set(g) & set(after)) == 1 for g in groups.values())
        else:
            bodies = [alnum(text) for _, text in items]
            windows = {tuple(b[k : k + 13]) for b in bodies for k in range(max(1, len(b) - 12) if b else 0)}
            dirty = {k for k in before if contaminated(before[k], windows)}
            assert dirty == gone
        before = after
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    whole, sequences, at = {k: ids_of(t) for k, t in before.items()}, {}, {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        assert r["start"] == at.get(r["doc_id"], 0) and r["doc_tokens"] == len(whole[r["doc_id"]])
        at[r["doc_id"]] = r["start"] + r["length"]
        assert r["ids_crc32"] == zlib.crc32(whole[r["doc_id"]][r["start"] : at[r["doc_id"]]].tobytes())
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert at == {k: len(x) for k, x in whole.items()}
    for pieces in sequences.values():
        pieces.sort()
        assert [a for a, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))] and sum(n for _, n in pieces) <= 1024
    assert sum(at.values()) > 0.98 * 1024 * len(sequences)


def contaminated(text, windows):
    """``windows``: of all items, as tuples of words."""
    words, hit = alnum(text), set()
    for n in {len(w) for w in windows}:
        for k in range(len(words) - n + 1):
            if tuple(words[k : k + n]) in windows:
                hit.update(range(k, k + n))
    return len(hit) > 0 and 20 * len(hit) >= len(words)


def test_run(spark):
    rows = corpus_pipeline.run(spark, DATA)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(rows.columns)
    assert rows.count() > 100


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_awkward_tables(spark, name, tmp_path):
    stage = dict(corpus_pipeline.STAGES)[name]
    spark.createDataFrame([(0, 1, 0), (919, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "one two three")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = documents(spark)
    got = stage(spark, docs, str(tmp_path))
    if name == "packing":
        assert got.count() > 0
    else:
        assert got.columns == docs.columns and got.count() <= docs.count()
    assert stage(spark, empty(spark), str(tmp_path)).count() == 0


def test_one_of_repeated_rows_stays(spark):
    text = "one copy of this stays " * 12
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (2, None), (3, "")], "doc_id long, text string")
    assert stages.without_copies(spark, docs, "").count() == 2
