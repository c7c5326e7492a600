"""Roll-ups of reward traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import positions


def zero(c: str) -> Column:
    """Missing, null and zero are all zero."""
    return F.coalesce(F.col(c), F.lit(0))


def summary(t: DataFrame) -> DataFrame:
    """Counts, means and rates of all rows; scores that the table lacks count as zero."""
    n = F.count(F.lit(1))
    t = t.withColumns({c: F.lit(0) for c in ("total_reward", "parsed_prediction_count", "single_line_score") if c not in t.columns})
    return t.agg(
        n.alias("trace_row_count"), F.avg(zero("total_reward")).alias("mean_total_reward"), F.avg(zero("parsed_prediction_count")).alias("mean_parsed_prediction_count"),
        F.avg(zero("single_line_score")).alias("single_line_rate"), F.avg((zero("parsed_prediction_count") == 0).cast("double")).alias("zero_prediction_rate"),
    )


def histogram(t: DataFrame) -> DataFrame:
    return t.groupBy(zero("parsed_prediction_count").cast("bigint").alias("parsed")).agg(F.count(F.lit(1)).alias("n")).orderBy("parsed")


def top_previews(t: DataFrame, k: int = 10, position: str = "position") -> DataFrame:
    """The k most frequent previews with their means; ties by first appearance."""
    g = t.groupBy(F.coalesce("solution_preview", F.lit("")).alias("solution_preview")).agg(F.count(F.lit(1)).alias("n"), F.avg(zero("total_reward")).alias("mean_total_reward"), F.avg(zero("parsed_prediction_count")).alias("mean_parsed"), F.avg(zero("single_line_score")).alias("single_line_rate"), F.min(position).alias("first"))
    return g.orderBy(F.col("n").desc(), "first").limit(k)


def single_line(t: DataFrame) -> DataFrame:
    """Means of single-line and of other answers side by side; no rows on a side give zeros."""
    one = zero("single_line_score") > 0.5
    mean = lambda c, test: F.coalesce(F.avg(F.when(test, zero(c))), F.lit(0.0))
    cols = [mean(c, test).alias(f"{name}_{c}") for name, test in (("single", one), ("multi", ~one)) for c in ("total_reward", "parsed_prediction_count", "hit")]
    return t.agg(F.count(F.lit(1)).alias("n"), F.avg(one.cast("double")).alias("single_line_rate"), *cols)


def group_size(t: DataFrame, explicit: int | None = None, position: str = "position") -> int:
    """The explicit size, or the most common hint that is not zero; ties by first appearance."""
    if explicit is not None:
        if explicit < 1:
            raise ValueError("a group has one row or more")
        return explicit
    top = t.where(zero("group_size_hint") > 0).groupBy("group_size_hint").agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("f")).orderBy(F.col("n").desc(), "f").limit(1).collect()
    if not top:
        raise ValueError("no group size given or hinted at")
    return int(top[0][0])


def ordered(t: DataFrame) -> DataFrame:
    """Adds position, by time, writer and the writer's own count; missing ones are zero."""
    d = t.withColumns({"_t": zero("time_ns"), "_p": zero("pid"), "_l": zero("local_record_index")})
    return positions(d, [F.col("_t"), F.col("_p"), F.col("_l")], "position").drop("_t", "_p", "_l")


def steps(t: DataFrame, g: int, columns: tuple[str, ...] = ("total_reward",)) -> DataFrame:
    """Chunks of g rows by position: sums and means, the last chunk as it is; cumulative sums, and means over rows."""
    step = (F.floor((F.col("position") - 1) / g) + 1).cast("bigint")
    by = t.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(zero(c).cast("double")).alias(f"{c}_sum") for c in columns])
    # The running sums: first over blocks of 1,024 steps, then in each block.
    block = by.withColumn("_b", F.floor(F.col("step") / 1024))
    sums = block.groupBy("_b").agg(F.sum("n").alias("_n"), *[F.sum(f"{c}_sum").alias(f"_{c}") for c in columns])
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    first = sums.select(F.col("_b").alias("_k"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0.0)).alias(f"_{c}0") for c in columns])
    run = Window.partitionBy("_b").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = block.join(first, F.col("_b") == F.col("_k"))
    out = out.withColumn("rows_so_far", F.col("_n0") + F.sum("n").over(run))
    for c in columns:
        out = out.withColumn(f"{c}_mean", F.col(f"{c}_sum") / F.col("n")).withColumn(f"{c}_cum", F.col(f"_{c}0") + F.sum(f"{c}_sum").over(run)).withColumn(f"{c}_cum_mean", F.col(f"{c}_cum") / F.col("rows_so_far"))
    return out.select("step", "n", "rows_so_far", *[f"{c}_{x}" for c in columns for x in ("sum", "mean", "cum", "cum_mean")])


# How much of the format part each score weighs.
BACKFILL = {"single_line_reward": ("single_line_score", 0.1), "valid_count_reward": ("valid_count_score", 0.25), "exact_ten_reward": ("exact_ten_score", 0.15)}


def backfilled(t: DataFrame) -> DataFrame:
    """Weighted format parts from their scores where they are missing."""
    out = t
    for part, (score, weight) in BACKFILL.items():
        have = F.col(part) if part in t.columns else F.lit(None).cast("double")
        out = out.withColumn(part, F.coalesce(have, weight * (F.coalesce(F.col(score), F.lit(0.0)) if score in t.columns else F.lit(0.0)), F.lit(0.0)))
    return out


def downsampled(series: DataFrame, most: int, index: str, x: str, ys: tuple[str, ...]) -> DataFrame:
    """At most `most` points: buckets of ceil(n / most) by 0-based index, the last x and the mean of each y."""
    n = series.agg(F.count(F.lit(1)).alias("_n"))
    d = series.crossJoin(F.broadcast(n)).withColumn("bucket", F.floor(F.col(index) / F.greatest(F.ceil(F.col("_n") / most), F.lit(1))))
    return d.groupBy("bucket").agg(F.max_by(x, index).alias(x), *[F.avg(y).alias(y) for y in ys]).drop("bucket")
