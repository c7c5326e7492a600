"""Text scalars: cleaning, literals, trajectory sentences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def category(c: Column) -> Column:
    """White space of any script collapsed; empty is null."""
    return F.nullif(F.trim(F.regexp_replace(c.cast("string"), r"(?U)\s+", " ")), F.lit(""))


def region(c: Column) -> Column:
    """Numbers that are whole as whole-number text, all else trimmed; empty is null."""
    t = F.nullif(F.trim(c.cast("string")), F.lit(""))
    d = t.try_cast("double")
    whole = d.isNotNull() & (F.abs(d) < 9e15) & (d == F.floor(d))
    return F.when(whole, d.cast("decimal(20,0)").cast("string")).otherwise(t)


def region_is_int(c: Column) -> Column:
    return F.coalesce(region(c).rlike(r"^-?\d+$"), F.lit(False))


def clean_literal(c: Column) -> Column:
    """np.int64(5) and numpy.int64(5) to 5."""
    return F.regexp_replace(c, r"\b(?:np|numpy)\.int64\((-?\d+)\)", "$1")


# Strings of a list literal, in single or double quotes with escapes, or anything up to the next comma or end.
_SINGLE, _DOUBLE, _BARE = r"'(?:[^'\\]|\\.)*'", r'"(?:[^"\\]|\\.)*"', r"[^\s,'\"\[\]()]+"
_ITEM = f"{_SINGLE}|{_DOUBLE}|{_BARE}"
_LIST = rf"(?s)^\s*[\[(]\s*(?:(?:{_ITEM})\s*(?:,\s*(?:{_ITEM})\s*)*,?\s*)?[\])]\s*$"


def literal_list(c: Column, kind: str = "string") -> Column:
    """A list literal to an array: quotes are read by state, so an apostrophe in double quotes stays; null gives an empty array.

    Junk, and items that are no `kind`, are errors, as rows would be lost silently.
    """
    t = clean_literal(c)
    items = F.regexp_extract_all(t, F.lit(f"({_ITEM})"), F.lit(1))
    quoted = lambda x: x.rlike("^['\"]")
    inner = lambda x: F.regexp_replace(F.substring(x, F.lit(2), F.length(x) - 2), r"(?s)\\(['\"\\])", "$1")
    plain = F.transform(items, lambda x: F.when(quoted(x), inner(x)).when(x == "None", F.lit(None).cast("string")).otherwise(x))
    bad = F.raise_error(F.concat(F.lit("not a list literal: "), t))
    return F.when(c.isNull(), F.array().cast(f"array<{kind}>")).when(t.rlike(_LIST), plain.cast(f"array<{kind}>")).otherwise(bad)


def time_literal(c: Column) -> Column:
    """Hours and their weights of a literal, to map<int,double>: a mapping {8: 2} as it is, a list of hours [8, 9, 8] with a weight of one
    for each time it comes, pairs [(8, 2)] as a mapping; junk and null give an empty one. Weights may be decimal; of a key that comes
    twice in a mapping the last weight stays."""
    t = clean_literal(c)
    hour = r"['\"]?(-?\d+)['\"]?"
    weight = r"(-?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
    pair = rf"(?:{hour}\s*:\s*{weight}|[\[(]\s*{hour}\s*,\s*{weight}\s*[\])])"
    weighed = rf"(?s)^\s*(?:\{{\s*(?:{hour}\s*:\s*{weight}\s*(?:,\s*{hour}\s*:\s*{weight}\s*)*,?\s*)?\}}|\[\s*(?:{pair}\s*,?\s*)*\])\s*$"
    listed = rf"(?s)^\s*\[\s*{hour}\s*(?:,\s*{hour}\s*)*,?\s*\]\s*$"
    each = F.regexp_extract_all(t, F.lit(rf"({hour}\s*[:,]\s*{weight})"), F.lit(1))
    key = lambda x: F.regexp_extract(x, hour, 1).cast("int")
    value = lambda x: F.regexp_extract(x, rf"[:,]\s*{weight}$", 1).cast("double")
    entries = F.transform(each, lambda x: F.struct(key(x).alias("k"), value(x).alias("v")))
    lasting = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries) - i - 1, F.lit(0))), lambda o: o["k"] == e["k"]))
    hours = F.transform(F.regexp_extract_all(t, F.lit(hour), F.lit(1)), lambda x: x.cast("int"))
    counted = F.transform(F.array_distinct(hours), lambda h: F.struct(h.alias("k"), F.size(F.filter(hours, lambda x: x == h)).cast("double").alias("v")))
    empty = F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<double>"))
    return F.coalesce(F.when(t.rlike(listed), F.map_from_entries(counted)).when(t.rlike(weighed), F.map_from_entries(lasting)), empty)


def completion(instruction: Column, body: Column, output: Column, end: str = "<|eot_id|>") -> Column:
    """The training text of a supervised row, each part trimmed, with the end mark."""
    part = lambda c: F.trim(F.coalesce(c.cast("string"), F.lit("")), F.lit(" \t\n\r\f\x0b"))
    return F.concat(F.lit("### Instruction:\n"), part(instruction), F.lit("\n\n### Input:\n"), part(body), F.lit("\n\n### Response:\n"), part(output), F.lit(end))


def sequence(uid: Column, tokens: Column, times: Column) -> Column:
    """User_7 visited: <1> at 2024-01-01 08:00, ..."""
    each = F.zip_with(tokens, times, lambda p, t: F.concat(p, F.lit(" at "), t))
    return F.concat(F.lit("User_"), uid.cast("string"), F.lit(" visited: "), F.array_join(each, ", "))


def prediction_input(uid: Column, tokens: Column, times: Column, target_time: Column) -> Column:
    return F.concat(sequence(uid, tokens, times), F.lit(". When "), target_time, F.lit(" user_"), uid.cast("string"), F.lit(" is likely to visit:"))


def without_think(c: Column) -> Column:
    """Leading think blocks go, as often as they follow each other."""
    return F.regexp_replace(c, r"^(?s:\s*<think>.*?</think>\s*)+", "")


def preview(c: Column, limit: int = 240) -> Column:
    """One line, with ... where it was cut."""
    t = F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit - 3), F.lit("..."))).otherwise(t)


def chat(messages: Column) -> Column:
    """[ROLE] and content of each message, blank lines between."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("["), F.upper(m["role"]), F.lit("]\n"), m["content"])), "\n\n")
