"""The test tables as check-ins, vectors and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as check-ins: the user, the place props.k, and a category, coordinates and offset made from them by arithmetic.

    Some events of the last days go to the places 100 and 101, which nobody visits before.
    """
    k = F.nullif(F.regexp_extract("props", r"(\d+)", 1), F.lit("")).cast("bigint")
    k = F.when((F.col("ts").cast("timestamp_ntz") >= F.lit("2024-01-27").cast("timestamp_ntz")) & (F.col("event_id") % 20 == 0), 100 + k % 2).otherwise(k)
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("uid"), k.alias("pid"), F.col("ts").cast("timestamp_ntz").alias("utc_ts"))
    offset = (F.lit(-240) + (F.col("uid") % 3) * 60).cast("int")
    return e.select(
        "seq", "uid", "pid", F.concat(F.lit("cat"), (F.col("pid") % 7).cast("string")).alias("category"), F.concat(F.lit("c"), (F.col("pid") % 7).cast("string")).alias("category_id"),
        (F.lit(40.5) + (F.col("pid") % 10) * F.lit(0.0371)).alias("latitude"), (F.lit(-74.2) + F.floor(F.col("pid") / 10) * F.lit(0.0413)).alias("longitude"),
        offset.alias("timezone_offset"), "utc_ts", (F.col("utc_ts") + F.make_dt_interval(mins=offset)).alias("time_dt"),
    )


#: The same in SQL, as the table c; time_dt is the local time, t its minute text.
CHECKINS_SQL = r"""
c00 AS (SELECT *, regexp_extract(props, '(\d+)', 1)::BIGINT AS k FROM events),
c0 AS (SELECT event_id AS seq, user_id AS uid, CASE WHEN ts >= TIMESTAMP '2024-01-27' AND event_id % 20 = 0 THEN 100 + k % 2 ELSE k END AS pid, ts AS utc_ts FROM c00),
c AS (SELECT seq, uid, pid, 'cat' || (pid % 7)::VARCHAR AS category, 'c' || (pid % 7)::VARCHAR AS category_id, 40.5::DOUBLE + (pid % 10) * 0.0371::DOUBLE AS latitude,
    -74.2::DOUBLE + (pid // 10) * 0.0413::DOUBLE AS longitude, (-240 + (uid % 3) * 60)::INTEGER AS timezone_offset, utc_ts, utc_ts + to_minutes((-240 + (uid % 3) * 60)::INTEGER) AS time_dt,
    strftime(utc_ts + to_minutes((-240 + (uid % 3) * 60)::INTEGER), '%Y-%m-%d %H:%M') AS t FROM c0)
"""


def sids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pid, indices): a code of three levels made from each place's number; some places share one."""
    p = checkins(spark, sf_dir).select("pid").distinct()
    return p.select("pid", F.array((F.col("pid") % 4).cast("int"), (F.floor(F.col("pid") / 4) % 4).cast("int"), (F.floor(F.col("pid") / 16) % 3).cast("int")).alias("indices"))


#: (pid, base, k, n, sid_token) with the suffix for shared codes; needs the table c.
SIDS_SQL = r"""
s0 AS (SELECT DISTINCT pid FROM c),
s1 AS (SELECT pid, '<a_' || (pid % 4) || '><b_' || ((pid // 4) % 4) || '><c_' || ((pid // 16) % 3) || '>' AS base FROM s0),
s2 AS (SELECT pid, base, row_number() OVER (PARTITION BY base ORDER BY pid) - 1 AS k, count(*) OVER (PARTITION BY base) AS n FROM s1),
s AS (SELECT pid, base AS abc, base || CASE WHEN n > 1 THEN '<d_' || k || '>' ELSE '' END AS sid_token,
    regexp_extract(base, '^<a_\d+>') AS a, regexp_extract(base, '^<a_\d+><b_\d+>') AS ab FROM s2)
"""
