"""Small tables with every awkward case, and plain-Python versions of the operators."""

from __future__ import annotations

import random
import re

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Columns whose names the operators might use themselves.
CLASHES = "words string, tie string, fp long, row long, rules string, score double, host string, key string, group long, low string, name string"


def prose(rng: random.Random, n: int, vocabulary: int = 300) -> str:
    words = [f"{rng.choice('bcdfgl')}{rng.choice('aeiou')}{rng.choice('nrst')}{rng.randrange(vocabulary)}" for _ in range(n)]
    return " ".join(w.capitalize() if rng.random() < 0.1 else w + rng.choice(["", "", ".", ",\n"]) for w in words)


def awkward_texts(seed: int = 1) -> list:
    """Null, empty, blank, tiny, odd white space, beyond ASCII, repeated, near copies, junk, very long."""
    rng = random.Random(seed)
    base = [prose(rng, n) for n in (5, 12, 13, 14, 60, 120, 300, 700)]
    near = [base[6].replace("a", "e", 1), base[6] + " more", base[7] + "\nthe end"]
    odd = [
        None, "", " ", "\n\t ", "a", "One two three", "one TWO  three four　five", "  lead and trail  ", "x" * 5000,
        "Éléphant naïve 日本語 Kelvin İstanbul", "<|endoftext|> <unk> ▁mark", "a \n b\r\n\tc  \n  d", "\x00nul\x7f del",
        "### $$$ %%% " * 40, "\n".join(["same line here again"] * 30), "the the the the the the",
    ]
    return base + near + odd + [base[4]] * 3 + [None] + [prose(rng, 20_000)]


def documents(spark, texts=None, clashes=True):
    """Ids in no order, one repeated, one null; sources with a hot one and a null one."""
    texts = awkward_texts() if texts is None else texts
    rows = []
    for k, text in enumerate(texts):
        doc_id = None if k == 7 else 3 if k == 9 else (k * 7919) % 1000
        rows.append((doc_id, text, ["en", "de", None][k % 3], None if k % 11 == 0 else f"src{k % 4 * (k % 2)}", len(text or "")))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    if not clashes:
        return spark.createDataFrame(rows, schema)
    extra = ("w", "t", 1, 2, "r", 0.5, "h", "k", 3, "l", "n")
    return spark.createDataFrame([(*r, *extra) for r in rows], f"{schema}, {CLASHES}").repartition(3)


def empty(spark):
    return documents(spark).limit(0)


def alnum(text) -> list[str]:
    return ALNUM.findall((text or "").translate(UPPER))


def spaced(text) -> list[str]:
    return SPACED.findall(text or "")


def by_row(rows) -> list:
    return sorted(map(tuple, rows), key=repr)
