"""Operators 1, 5 and 10: counts, files and packing against the tokenizers library."""

from __future__ import annotations

import random
import zlib
from functools import cache

import numpy as np
import pytest

from lodestar.llm import byte_bpe, elias_fano, packing, token_counts, token_files

from .corpus import awkward_texts, by_row, documents, empty


@cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(byte_bpe.default_path())


def reference(texts):
    return [np.array(x.ids, dtype="<u4").tobytes() for x in library().encode_batch([x or "" for x in texts], add_special_tokens=False)]


def ids_of(text):
    return np.frombuffer(reference([text])[0] + np.zeros(1, "<u4").tobytes(), "<u4")


def random_texts(n, seed, parts):
    rng = random.Random(seed)
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 10))) for _ in range(n)]


PARTS = ["<|endoftext|>", " ", " ", "\n", "a", "b", "th", "é", " ", "\t", "!", "1", "'s", "\x1c", "​", "日", "  ", "<unk>", "▁"]


def test_encoder_is_exact(monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE_CHUNKS", 500)  # forgets now and then
    texts = random_texts(8000, 1, PARTS) + [x or "" for x in awkward_texts()]
    coder = byte_bpe.Encoder(byte_bpe.default_path())
    got = [x for k in range(0, len(texts), 40) for x in coder.encode_many(texts[k : k + 40])]
    assert got == reference(texts)


@pytest.mark.parametrize("values", [[], [0], [0, 0, 0], [5, 5, 9], list(range(0, 9000, 7)), list(range(100)) * 1 + [900] * 2000 + [50_000], [1 << 33], [0, 3, 3, 1 << 40]])
def test_elias_fano(values):
    data = b"xyz" + elias_fano.dump(np.array(values, dtype=np.uint64), max(values, default=0)) + b"tail"
    found = elias_fano.EliasFano(data, 3)
    assert data[found.end :] == b"tail"
    assert found.select(np.arange(len(values))).tolist() == values
    some = np.arange(len(values))[::-3]
    assert found.select(some).tolist() == [values[k] for k in some]
    assert [found.select(k) for k in range(len(values))] == values
    with pytest.raises(IndexError):
        found.select(len(values))


def test_elias_fano_is_near_minimal():
    rng = np.random.default_rng(1)
    ends = np.cumsum(rng.integers(1, 2000, 20_000))
    size = len(elias_fano.dump(ends, int(ends[-1]))) * 8 / len(ends)
    assert size < 2 + np.log2(ends[-1] / len(ends)) + 0.6


def test_segment_round_trip():
    ids = [np.array(x, dtype="<u4").tobytes() for x in ([5, 0], [0], [7, 50256, 0])]
    for width in (2, 4):
        s = token_files.Segment(token_files.segment_bytes(9, [None, -4, 6], ids, width) + b"\n")
        assert (s.number, s.doc_ids()) == (9, [None, -4, 6])
        assert [s.document(k).tolist() for k in range(3)] == [[5, 0], [0], [7, 50256, 0]]
        assert [s.bounds(k) for k in range(3)] == [(0, 2), (2, 3), (3, 6)]


def test_segments_keep_any_doc_id():
    end = np.zeros(1, "<u4").tobytes()
    for keys in ([], [None], [-(1 << 63), -5, -5, 0, (1 << 63) - 1], [None, None, 1 << 62], list(range(7, 70_000, 3))):
        data = token_files.segment_bytes(0, keys, [end] * len(keys), 2)
        assert token_files.Segment(data).doc_ids() == keys
    assert len(data) < len(keys) * (2 + 8 / 8) + 300  # two bytes of id, and under a byte for doc_id and end


def test_files_of_one_repeated_row(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "RANGE_BYTES", 2_000)
    docs = spark.createDataFrame([(5, "all the same words")] * 900 + [(4, "other")], "doc_id long, text string")
    path = f"{tmp_path.as_uri()}/r"
    token_files.write(docs, path, byte_bpe.default_path())
    rows = token_files.with_starts(token_files.read(spark, path)).collect()
    assert len(rows) == 901 and len({r["segment"] for r in rows}) > 4
    at = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]


def test_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT_IDS", 300)
    monkeypatch.setattr(token_files, "RANGE_BYTES", 20_000)
    docs = documents(spark)
    token_files.write(docs, f"{tmp_path.as_uri()}/f", byte_bpe.default_path())
    assert len(list((tmp_path / "f").glob("part-*"))) > 3
    got = token_files.with_starts(token_files.read(spark, f"{tmp_path.as_uri()}/f")).collect()
    want = [(r["doc_id"], ids_of(r["text"])) for r in docs.select("doc_id", "text").collect()]
    assert by_row((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == by_row((k, len(x), zlib.crc32(x.tobytes())) for k, x in want)
    at = 0
    order = sorted(got, key=lambda r: r["start"])
    for r in order:
        assert r["start"] == at
        at += r["n_tokens"]
    assert [r["doc_id"] for r in order] == sorted((r["doc_id"] for r in got), key=lambda k: (k is not None, k))


def test_files_of_nothing(spark, tmp_path):
    token_files.write(empty(spark), f"{tmp_path.as_uri()}/e", byte_bpe.default_path())
    assert token_files.with_starts(token_files.read(spark, f"{tmp_path.as_uri()}/e")).count() == 0


def check_packing(rows, texts, length):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r)
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= length and all(r["sequence_length"] == at for r in own)
    pieces = {}
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] > 0 and zlib.crc32(r["ids"]) == r["ids_crc32"]
        pieces.setdefault(r["doc_id"], []).append((r["start"], ids, r["doc_tokens"]))
    for k, text in enumerate(texts):
        whole, at = ids_of(text), 0
        for start, ids, total in sorted(pieces[k], key=lambda x: x[0]):
            assert start == at and total == len(whole) and (whole[start : start + len(ids)] == ids).all()
            at += len(ids)
        assert at == len(whole)
    return len(by)


def test_packing(spark):
    texts = awkward_texts() * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    rows = packing.pack(docs, byte_bpe.default_path(), length=64, n_open=4, group=2, min_cut=4).collect()
    n = check_packing(rows, texts, 64)
    total = sum(r["length"] for r in rows)
    assert total / (64 * n) > 0.97
    assert packing.pack(docs, byte_bpe.default_path(), keep_ids=False).filter("ids is not null").count() == 0


def test_packing_awkward(spark):
    docs = documents(spark)
    rows = packing.pack(docs, byte_bpe.default_path()).collect()
    want = sum(len(ids_of(r["text"])) for r in docs.select("text").collect())
    assert sum(r["length"] for r in rows) == want
    assert packing.pack(empty(spark), byte_bpe.default_path()).count() == 0


def test_packer_prefers_the_best_fit():
    p = packing.Packer(10, 2, 3)
    piece = lambda n: (n, 0, bytes(4 * n), n)
    assert [*p.add(piece(6)), *p.add(piece(8))] == []
    assert list(p.add(piece(2)))[0][-1][0] == 2  # fills the window of 8
    assert list(p.add(piece(7))) == []
    closed = list(p.add(piece(5)))  # fits neither 6 nor 7: the fuller one is topped up with 3
    assert [len(x[2]) // 4 for x in closed[0]] == [7, 3]
    assert sorted(sum(len(x[2]) // 4 for x in w) for w in p.rest()) == [8]


def unigram():
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.Unigram(token_counts.zipf(token_counts.default_path()), unk_id=0, byte_fallback=False))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return t


def test_counts_equal_the_library():
    texts = random_texts(4000, 2, PARTS + ["er", "\x01", "\x02"]) + [x or "" for x in awkward_texts()]
    count = token_counts.counter(token_counts.default_path())
    want = [len(x.ids) for x in unigram().encode_batch(texts, add_special_tokens=False)]
    assert [count.of_text(x) for x in texts] == want


def test_counts_on_ties():
    vocabulary = [("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("aa", -2.0), ("▁a", -2.0), ("aaa", -3.0), ("b", -5.0), ("ab", -6.0)]
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=False))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    count = token_counts.Counter(vocabulary)
    texts = ["a", "aa", "aaa", "aaaa", "aaaaa", "ab", "aab", "aaab", "abab", "xyab", "axya", "xx a yy", "b" * 9, "ba" * 7]
    assert [count.of_text(x) for x in texts] == [len(t.encode(x).ids) for x in texts]


def test_count_query(spark):
    docs = documents(spark)
    rows = token_counts.count_tokens(docs, token_counts.default_path()).collect()
    t = unigram()
    want = [(r["doc_id"], len(r["text"] or ""), len(t.encode(r["text"] or "").ids)) for r in docs.select("doc_id", "text").collect()]
    assert by_row(rows) == by_row(want)
    assert token_counts.count_tokens(empty(spark), token_counts.default_path()).count() == 0


def test_stream_keeps_order():
    coder = byte_bpe.encoder(byte_bpe.default_path())
    rows = [((k,), x) for k, x in enumerate(awkward_texts())]
    assert [k for k, _ in coder.encode_stream(rows)] == [k for k, _ in rows]
