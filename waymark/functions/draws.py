"""Seeded draws that any SQL engine with md5 repeats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(seed: int | str, key: Column) -> Column:
    """A uniform number in [0, 1): the first 32 bits of md5(seed|key)."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string"))), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def fine_draw(seed: int | str, key: Column) -> Column:
    """The same by the first 52 bits, for drawing one of more things than 32 bits tell apart."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string"))), 1, 13), 16, 10).cast("bigint") / F.lit(4503599627370496.0)
