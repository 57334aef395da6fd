"""Operators 5 and 10: added tokens of the vocabulary get their own ids, as by the library's default."""

from __future__ import annotations

import zlib

import numpy as np

from lodestar.llm import byte_bpe, stages
from lodestar.llm.queries import QUERIES

from .corpus import awkward_texts, by_row
from .test_tokens import PARTS, random_texts, reference

END = "<|endoftext|>"
TEXTS = [
    f"end of one sample.{END}start of the next", END, END * 3, f"a {END} b", f"a  {END}  b", f"x{END}", f"{END} y", f" {END}\n{END} ",
    f"  {END}a", f"a \n {END}\t b", "<|endoftext|", "< |endoftext|>", "plain words", None,
]


def test_encoder_with_added_tokens(monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE_CHUNKS", 500)
    texts = random_texts(4000, 5, PARTS) + [x or "" for x in [*awkward_texts(), *TEXTS]]
    coder = byte_bpe.Encoder(byte_bpe.default_path())
    got = [x for k in range(0, len(texts), 40) for x in coder.encode_many(texts[k : k + 40])]
    assert got == reference(texts)


def test_queries_and_the_last_stage(spark, tmp_path):
    texts = [*TEXTS, *awkward_texts()]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = [x + np.zeros(1, "<u4").tobytes() for x in reference(texts)]
    starts = np.cumsum([0, *(len(x) // 4 for x in want)]).tolist()
    rows = QUERIES["op5_token_files"](spark, str(tmp_path)).collect()
    assert by_row(rows) == by_row((k, starts[k], len(x) // 4, zlib.crc32(x)) for k, x in enumerate(want))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for rows in (QUERIES["op10_packing"](spark, str(tmp_path)).collect(), stages.packed(spark, docs, str(tmp_path)).collect()):
        for r in rows:
            piece = want[r["doc_id"]][4 * r["start"] : 4 * (r["start"] + r["length"])]
            assert (r["doc_tokens"], r["ids_crc32"]) == (len(want[r["doc_id"]]) // 4, zlib.crc32(piece))
        assert sum(r["length"] for r in rows) == starts[-1]
