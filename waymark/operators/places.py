"""Place summaries and adjacency."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import positions


def hour_histogram(df: DataFrame, key: str, hour: str) -> DataFrame:
    """key, visit_time_and_count: counts by hour, hours as text keys in numeric order."""
    each = df.groupBy(key, hour).agg(F.count(F.lit(1)).alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct(F.col(hour).cast("int").alias("h"), "n")))
    return each.groupBy(key).agg(F.map_from_entries(F.transform(pairs, lambda x: F.struct(x["h"].cast("string"), x["n"]))).alias("visit_time_and_count"))


def summary(df: DataFrame) -> DataFrame:
    """One row a place from (uid, pid, category, category_id, region, lat, lon, time_dt, hour, seq).

    First visits are found for each place and user, and each place and hour, before anything is gathered: a place's arrays hold its
    distinct users and hours, not its visits.
    """
    when = F.struct("uid", "time_dt", "seq")
    firsts = lambda c: df.groupBy("pid", F.col(c).alias("v")).agg(F.min(when).alias("f"), F.count(F.lit(1)).alias("n"))
    in_order = lambda g, name: F.transform(F.array_sort(F.collect_list(F.struct("f", "v"))), lambda x: x["v"]).alias(name)
    users, hours = firsts("uid"), firsts("hour")
    by_user = users.groupBy("pid").agg(in_order(users, "uids"), F.count(F.lit(1)).alias("unique_user_count"), F.sum("n").alias("visit_count"))
    pairs = F.array_sort(F.collect_list(F.struct(F.col("v").cast("int").alias("h"), "n")))
    by_hour = hours.groupBy("pid").agg(in_order(hours, "hours"), F.array_sort(F.collect_list("v")).alias("visit_hours"), F.map_from_entries(F.transform(pairs, lambda x: F.struct(x["h"].cast("string"), x["n"]))).alias("visit_time_and_count"))
    out = df.groupBy("pid").agg(*[F.min_by(c, when).alias(c) for c in ("category", "category_id", "region")], F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"))
    out = out.join(by_user, "pid").join(by_hour, "pid")
    return out.select("pid", "uids", "hours", "category", "category_id", "region", "latitude", "longitude", "unique_user_count", "visit_count", "visit_hours", "visit_time_and_count")


def followed(df: DataFrame, user: str = "uid", poi: str = "pid", order: tuple[str, ...] = ("time_dt", "seq")) -> DataFrame:
    """(user, a, b) and the order's columns: each row's place and the one after it in the user's sequence, null at its end.

    Rows get their place in the order of all users, dealt by sampled ranges, and meet the row of the next place, so a user with any
    share of the rows is no task of its own.
    """
    d = positions(df.select(F.col(user).alias("_user"), F.col(poi).alias("a"), *order), [F.col("_user"), *map(F.col, order)], "_at")
    after = d.select((F.col("_at") - 1).alias("_at"), F.col("_user").alias("_next"), F.col("a").alias("b"))
    met = d.join(after, "_at", "left").withColumn("b", F.when(F.col("_user").eqNullSafe(F.col("_next")), F.col("b")))
    return met.select(F.col("_user").alias(user), "a", "b", *[c for c in order if c != user])


def neighbours(df: DataFrame, forward_only: bool, user: str = "uid", poi: str = "pid", order: tuple[str, ...] = ("time_dt", "seq")) -> DataFrame:
    """poi, neighbour, n, rank: how often each other place stood next to it in a user's sequence; ties by number."""
    pairs = followed(df, user, poi, order).select("a", "b").where("b is not null")
    both = pairs if forward_only else pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counts = both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.col("n").desc(), "b"))
    return counts.select(F.col("a").alias(poi), F.col("b").alias("neighbour"), "n", rank.alias("rank"))


def neighbour_lists(df: DataFrame, forward_only: bool, **kw) -> DataFrame:
    """pid, neighbours: every place, also those without any."""
    n = neighbours(df, forward_only, **kw).groupBy("pid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "neighbour"))), lambda x: x["neighbour"]).alias("neighbours"))
    return df.select("pid").distinct().join(n, "pid", "left").withColumn("neighbours", F.coalesce("neighbours", F.array().cast("array<bigint>")))
