"""Profiles of prefixes: category, region and geo bucket as far as the level goes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The keys of each level, in the order they are written.
FIELDS = {"a": ("category",), "ab": ("category", "region"), "abc": ("category", "region", "geo_bucket")}


def to_json(level: str, category: Column, region: Column | None = None, geo: Column | None = None) -> Column:
    """Compact JSON in fixed key order; regions that are whole numbers are written as numbers."""
    quoted = lambda c: F.right(o := F.to_json(F.struct(c.alias("x"))), F.length(o) - 5)  # noqa: E731  '"text"}' of {"x":"text"}
    body = F.concat(F.lit('{"category":'), quoted(category))
    if level == "a":
        return body
    body = F.expr("null").cast("string") if region is None else F.concat(F.regexp_replace(body, r"\}$", ""), F.lit(',"region":'), F.when(region.rlike(r"^-?\d+$"), F.concat(region, F.lit("}"))).otherwise(quoted(region)))
    return body if level == "ab" else F.concat(F.regexp_replace(body, r"\}$", ""), F.lit(',"geo_bucket":'), quoted(geo))


def parsed(text: Column) -> Column:
    """The JSON object of a text as a variant, with whatever keys it has; null where the text, trimmed, is no JSON or no object."""
    v = F.try_parse_json(F.trim(text, F.lit(" \t\n\r\f\x0b")))
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), v)


def valid(text: Column, level: str) -> Column:
    """Exactly the level's keys in order, non-empty category and region, a geo bucket of the right form."""
    keys = F.json_object_keys(text)
    get = lambda k: F.get_json_object(text, f"$.{k}")
    ok = keys == F.array(*[F.lit(k) for k in FIELDS[level]])
    for k in FIELDS[level]:
        ok = ok & (get(k).rlike(r"^G\d+_\d+$") if k == "geo_bucket" else F.length(F.trim(get(k))) > 0)
    return F.coalesce(ok, F.lit(False))
