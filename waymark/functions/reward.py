"""The reward of a ranked answer, as one expression."""

from __future__ import annotations

import functools
import os

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sid, text

# The weights of the parts, and of the format part's own parts.
FORMAT, RECIPROCAL, HIT, PREFIX, DIVERSITY = 0.5, 1.0, 1.0, 0.2, 0.1
SINGLE_LINE, VALID_COUNT, EXACT_TEN = 0.2, 0.5, 0.3
TOP = 10


def parts(answer: Column, truth: Column) -> Column:
    """A struct of all components; total_reward is their sum."""
    scored = text.without_think(answer)
    found = F.slice(sid.predictions(scored, "sid"), 1, TOP)
    n = F.size(found).cast("double")
    one_line = F.when(F.trim(scored, F.lit(" \t\n\r\f\x0b")).rlike("[\n\r]"), 0.0).otherwise(1.0)
    exact = F.when(n == TOP, 1.0).otherwise(0.0)
    rank = F.coalesce(F.array_position(found, truth), F.lit(0)).cast("int")
    hit = F.when(rank > 0, 1.0).otherwise(0.0)
    boost = F.when(rank > 0, 1 + (TOP - F.least(F.greatest(rank, F.lit(1)), F.lit(TOP))) / 10.0).otherwise(0.0)
    depth = F.aggregate(F.transform(found, lambda p: sid.shared_depth(p, truth).cast("double")), F.lit(0.0), lambda s, d: s + d) / (3.0 * TOP)
    single, valid, ten = FORMAT * SINGLE_LINE * one_line, FORMAT * VALID_COUNT * n / TOP, FORMAT * EXACT_TEN * exact
    reciprocal = F.when(rank > 0, RECIPROCAL / rank * boost).otherwise(0.0)
    total = single + valid + ten + reciprocal + HIT * hit + PREFIX * depth + DIVERSITY * n / TOP
    return F.struct(
        text.preview(answer).alias("solution_preview"), found.alias("parsed_predictions"), F.size(found).alias("parsed_prediction_count"), one_line.alias("single_line_score"),
        (n / TOP).alias("valid_count_score"), exact.alias("exact_ten_score"), single.alias("single_line_reward"), valid.alias("valid_count_reward"), ten.alias("exact_ten_reward"),
        hit.alias("hit"), F.nullif(rank, F.lit(0)).alias("rank"), boost.alias("reciprocal_rank_boost"), (single + valid + ten).alias("format_reward"), reciprocal.alias("reciprocal_rank_reward"),
        (HIT * hit).alias("soft_hit_reward"), (PREFIX * depth).alias("prefix_match_reward"), (DIVERSITY * n / TOP).alias("diversity_reward"), total.alias("total_reward"),
    )


#: Rewards by name: functions of (answer, truth) columns to a struct with total_reward.
REGISTRY = {"top10": parts}
#: Columns that a reward of a user's own gets beside the answer and the truth, where the rows have them.
EXTRA = ("sample_id", "uid", "repr", "history_source", "target_time", "prompt_template_version")
PATH_VARIABLE, NAME_VARIABLE = "WAYMARK_REWARD_PATH", "WAYMARK_REWARD_NAME"


def register(name: str, function) -> None:
    """Adds a reward: a function of (answer, truth) columns to a struct with total_reward."""
    REGISTRY[name] = function


def value(columns: list[str], given) -> Column:
    """A column where the name of one is given, else the same value in every row."""
    return given if isinstance(given, Column) else F.col(given) if isinstance(given, str) and given in columns else F.lit(given)


@functools.lru_cache(maxsize=8)
def loaded(path: str, name: str = "compute_score"):
    """The function of that name in a Python file; another file or name is loaded once for each process."""
    import importlib.util

    spec = importlib.util.spec_from_file_location("waymark_reward", path)
    if spec is None or spec.loader is None:
        raise ImportError(f"no reward module at {path}")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    found = getattr(module, name, None)
    if found is None:
        raise AttributeError(f"no {name} in {path}")
    return found


def own(function, columns: list[str], answer: Column, truth: Column, source="") -> Column:
    """A user's function (data source, answer, truth, extra_info) -> number as a column, in Arrow batches."""
    names = [c for c in EXTRA if c in columns]

    @F.pandas_udf("double")
    def scored(s: pd.Series, a: pd.Series, t: pd.Series, extra: pd.DataFrame) -> pd.Series:
        rows = extra.to_dict("records")
        return pd.Series([float(function(x or "", y or "", z, extra_info={**e, "target": z})) for x, y, z, e in zip(s, a, t, rows, strict=True)], dtype="float64")

    extra = F.struct(*[F.col(c) for c in names]) if names else F.struct(F.lit(None).cast("string").alias("sample_id"))
    return scored(value(columns, source).cast("string"), answer.cast("string"), truth.cast("string"), extra)


def scored(df: DataFrame, answer="prediction", truth="ground_truth", name: str = "top10", source="", out: str = "reward") -> DataFrame:
    """Adds the total reward of each row; columns or plain values for all rows may be given.

    name: a registered reward, or "environment": the function that PATH_VARIABLE and NAME_VARIABLE name, the built-in one without them.
    """
    columns = df.columns
    a, t = value(columns, answer), value(columns, truth)
    path = os.environ.get(PATH_VARIABLE) if name == "environment" else None
    if path:
        return df.withColumn(out, own(loaded(path, os.environ.get(NAME_VARIABLE, "compute_score")), columns, a, t, source))
    if name != "environment" and name not in REGISTRY:
        raise KeyError(f"no reward is registered as {name}")
    return df.withColumn(out, REGISTRY["top10" if name == "environment" else name](a, t)["total_reward"])
