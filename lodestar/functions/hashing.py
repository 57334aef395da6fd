"""Seeded draws from md5, the same in any SQL engine: 28 bits from the first seven hex digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RANGE = 1 << 28


def draw(*parts: Column | str | int) -> Column:
    """A whole number from 0 below 2**28 from the parts' text, joined by colons; strings are literals."""
    columns = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *columns).cast("binary")), 1, 7), 16, 10).cast("bigint")


def uniform(*parts: Column | str | int) -> Column:
    """A double from 0 below 1."""
    return draw(*parts) / F.lit(float(RANGE))


def draw_sql(text: str) -> str:
    """The DuckDB counterpart of ``draw`` for a SQL expression of the joined text."""
    return f"('0x' || substr(md5({text}), 1, 7))::BIGINT"
