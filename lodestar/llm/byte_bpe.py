"""Ids of the byte-level BPE vocabulary, by the tokenizers library, at cache speed.

The vocabulary's pre-tokenizer never joins characters across a space that follows or precedes a
non-space, so a text falls apart at such spaces into chunks whose ids do not depend on each other.
Chunks that are new to a worker are encoded by the library, many in one call; repeated ones come
from a bounded cache. Texts with a space inside a run of white space are encoded whole.

The vocabulary's added tokens (``<|endoftext|>``) get their own ids where a text holds them, as the
library does by default; such texts are encoded whole too.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np

from . import _worker

#: A space that both follows and precedes white space (or an end): no place to cut at.
_INSIDE_RUN = re.compile(r"(?:^|\s) (?=\s|$)")
#: Chunks and bytes of chunks that the cache may hold; characters encoded at a time.
CACHE_CHUNKS, CACHE_CHARS, GROUP_CHARS = 600_000, 16_000_000, 3_000_000
END_ID = 0


def default_path() -> str:
    """Where the public vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Numbers(dict):
    """Numbers new keys from 0 up and lists them."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, key: bytes) -> int:
        self.new.append(key)
        self[key] = n = len(self)
        return n


class Encoder:
    """``encode_many(texts)`` gives the ids of whole texts as bytes, little-endian unsigned 32-bit."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        # every character of a byte-level token stands for one byte
        self.n_bytes = np.zeros(self.tokenizer.get_vocab_size(), dtype=np.int64)
        for token, k in self.tokenizer.get_vocab().items():
            self.n_bytes[k] = len(token)
        self._forget()

    def _forget(self) -> None:
        #: A chunk's number: of one that a space precedes by the chunk, of a text's first by a space and the chunk.
        self.numbers, self.chars = _Numbers(), 0
        #: By number: where the chunk's ids begin in ``flat``, how many, and whether the chunk ends with white space.
        self.begin, self.size, self.loose = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.flat = np.zeros(0, "<u4")

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _together(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks that a space precedes, one after the other, and how many each has."""
        if not chunks:
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        lines = [(b" " + b" ".join(chunks[k : k + 100])).decode() for k in range(0, len(chunks), 100)]
        found = self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)
        ids = np.concatenate([np.array(x.ids, dtype="<u4") for x in found])
        ends = np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks)) + 1)
        return ids, np.diff(np.searchsorted(np.cumsum(self.n_bytes[ids]), ends) + 1, prepend=0)

    def _learn(self, chunks: list[bytes]) -> None:
        """Append the ids of new chunks. Those without white space at their ends are encoded together."""
        plain, odd, loose = [], [], np.zeros(len(chunks), bool)
        for k, x in enumerate(chunks):
            if x and 0x20 < x[0] < 0x80 and 0x20 < x[-1] < 0x80:  # most
                plain.append(k)
                continue
            y = x.decode()
            if y and y.strip() == y:
                plain.append(k)
            else:
                odd.append(k)
                loose[k] = not y.strip() or y[-1:].isspace()
        flat, counts = self._together([chunks[k] for k in plain])
        size, begin = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        size[plain], begin[plain] = counts, np.cumsum(counts) - counts
        # the others mostly are texts' first chunks, which no space precedes
        texts = [x[1:] if x[:1] == " " else " " + x for x in (chunks[k].decode() for k in odd)]
        ids = [np.array(x.ids, dtype="<u4") for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        size[odd] = [len(x) for x in ids]
        begin[odd] = len(flat) + np.cumsum(size[odd]) - size[odd]
        self.begin = np.concatenate([self.begin, begin + len(self.flat)])
        self.size = np.concatenate([self.size, size])
        self.loose = np.concatenate([self.loose, loose])
        self.flat = np.concatenate([self.flat, flat, *ids])

    def encode_many(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        if len(self.numbers) > CACHE_CHUNKS or self.chars > CACHE_CHARS:
            self._forget()
        numbers, counts, found = self.numbers, [], []
        whole = {k for k, text in enumerate(texts) if any(x in text for x in self.added)}
        for k, text in enumerate(texts):
            parts = (b"" if k in whole else text.encode()).split(b" ")
            parts[0] = b" " + parts[0]
            counts.append(len(parts))
            found.append(np.fromiter(map(numbers.__getitem__, parts), np.int64, len(parts)))
        if numbers.new:
            self._learn(numbers.new)
            self.chars += sum(map(len, numbers.new))
            numbers.new = []
        found = np.concatenate(found)
        size = self.size[found]
        ends = np.cumsum(size)
        flat = self.flat[np.repeat(self.begin[found] - ends + size, size) + np.arange(ends[-1])].tobytes()
        last = np.cumsum(counts)
        cuts = [0, *(4 * ends[last - 1]).tolist()]
        out = [flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        for k in whole.union(np.flatnonzero(np.add.reduceat(self.loose[found], last - counts)).tolist()):
            if k in whole or _INSIDE_RUN.search(texts[k]):
                out[k] = self._ids(texts[k]).tobytes()
        return out

    def encode_stream(self, rows: Iterable[tuple[tuple, str | None]]) -> Iterator[tuple[tuple, bytes]]:
        """(key, text) to (key, ids), in order, in groups of about GROUP_CHARS characters."""
        group, chars = [], 0
        for key, text in rows:
            group.append((key, text or ""))
            chars += len(group[-1][1])
            if chars >= GROUP_CHARS:
                yield from zip((k for k, _ in group), self.encode_many([x for _, x in group]), strict=True)
                group, chars = [], 0
        yield from zip((k for k, _ in group), self.encode_many([x for _, x in group]), strict=True)


def encoder(path: str) -> Encoder:
    """This worker's encoder."""
    return _worker.keep(("byte_bpe", path), lambda: Encoder(path))
