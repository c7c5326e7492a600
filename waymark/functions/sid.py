"""Semantic-ID strings: tokens such as <a_3><b_17><c_40> with an optional <d_n>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The forms of complete semantic IDs, place IDs and segments.
SID = r"<a_\d+><b_\d+><c_\d+>(?:<d_\d+>)?"
PLACE = r"<\d+>"
SEGMENT = r"<[a-zA-Z]_\d+>"
LEVELS = {"a": 1, "ab": 2, "abc": 3}


def token(indices: Column) -> Column:
    """[3, 17, 40] to <a_3><b_17><c_40>."""
    return F.array_join(F.transform(indices, lambda x, i: F.concat(F.lit("<"), F.char(i + 97), F.lit("_"), x.cast("string"), F.lit(">"))), "")


def place_token(pid: Column) -> Column:
    return F.concat(F.lit("<"), pid.cast("string"), F.lit(">"))


def segments(sid: Column, strict: bool = False) -> Column:
    """The segments; a SID has 3 or 4, others are null, or an error in strict mode."""
    parts = F.regexp_extract_all(sid, F.lit(f"({SEGMENT})"), F.lit(1))
    bad = F.raise_error(F.concat(F.lit("not a semantic ID: "), sid)) if strict else F.lit(None)
    return F.when(F.size(parts).isin(3, 4), parts).otherwise(bad)


def prefix(sid: Column, level: str) -> Column:
    """The first segments, as many as the level has; `full_sid` is all of them."""
    return F.array_join(segments(sid) if level == "full_sid" else F.slice(segments(sid), 1, LEVELS[level]), "")


def level_name(sid: Column) -> Column:
    n = F.size(segments(sid))
    return F.when(n == 4, "full_sid").when(n == 3, "abc")


def first_prefix(text: Column, level: str) -> Column:
    """The first run of as many segments as the level has, or null."""
    return F.nullif(F.regexp_extract(text, f"((?:{SEGMENT}){{{LEVELS[level]}}})", 1), F.lit(""))


def predictions(text: Column, kind: str) -> Column:
    """All distinct IDs of a text in order of first appearance; kind: id or sid."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"({PLACE if kind == 'id' else SID})"), F.lit(1)))


def shared_depth(one: Column, other: Column) -> Column:
    """How many of the first three segments agree from the front."""
    a, b = segments(one), segments(other)
    same = [F.coalesce(F.get(a, F.lit(i)) == F.get(b, F.lit(i)), F.lit(False)) for i in range(3)]
    return F.when(same[0] & same[1] & same[2], 3).when(same[0] & same[1], 2).when(same[0], 1).otherwise(0)
