"""Cleaning, frequency filters, dictionary encoding, global positions and the chronological split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..session import cut

CATEGORY_ALIASES = ("category", "Category", "Catname", "catname")
REGION_ALIASES = ("region", "Region")
LAT_ALIASES = ("latitude", "Latitude", "lat", "Lat")
LON_ALIASES = ("longitude", "Longitude", "lon", "Lon")


def resolve(df: DataFrame, aliases: tuple[str, ...]) -> str:
    """The first alias that is a column, at plan time."""
    for c in aliases:
        if c in df.columns:
            return c
    raise ValueError(f"none of {aliases} in {df.columns}")


def first_present(df: DataFrame, aliases: tuple[str, ...]) -> Column:
    """The first non-null alias of each row."""
    return F.coalesce(*[F.col(c) for c in aliases if c in df.columns])


def clean(raw: DataFrame) -> DataFrame:
    """Drops rows without user, place, coordinates, offset or time; adds region, local time, its minute text and hour."""
    d = raw.dropna(subset=["original_uid", "original_pid", "latitude", "longitude", "timezone_offset", "utc_ts"])
    local = F.col("utc_ts") + F.make_dt_interval(mins=F.col("timezone_offset").cast("int"))
    d = d.withColumns({"category": F.coalesce(F.col("category"), F.lit("nan")), "time_dt": local, "region": geo.plus_code(F.col("latitude"), F.col("longitude"))})
    return d.withColumns({"Time": F.date_format("time_dt", "yyyy-MM-dd HH:mm"), "visit_hour": F.hour("time_dt")})


def frequent(df: DataFrame, poi: str, user: str, poi_min: int, user_min: int) -> DataFrame:
    """Places with poi_min rows, then users with user_min of the rows left; not iterated.

    Counts meet rows in joins, which split skewed keys and pre-aggregate; windows would gather a hot key in one task.
    """
    def kept(d: DataFrame, c: str, least: int) -> DataFrame:
        return d.join(d.groupBy(c).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select(c), c, "left_semi")

    return kept(kept(df, poi, poi_min), user, user_min)


def dictionary(df: DataFrame, column: str, mapped: str) -> DataFrame:
    """Distinct values to dense numbers from 1 in sorted order."""
    return positions(df.select(column).where(F.col(column).isNotNull()).distinct(), [F.col(column)], mapped)


def positions(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds the 1-based position in a total order, without one task for all rows or for a frequent value.

    Rows are dealt over ranges of the whole order, whose bounds Spark samples from the data, as many as there are shuffle partitions;
    each range is sorted and its rows are numbered as they are written out. Then the ranges' sizes, one row each, are summed up.
    """
    d = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id()))  # partition << 33 | place
    part, place = F.shiftrightunsigned("_row", 33), F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = d.groupBy(part.alias("_part")).agg((F.max(place) + 1).alias("_n"))
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("_part", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_first"))
    out = d.join(F.broadcast(firsts), part == F.col("_part"))  # a row a shuffle partition
    return out.withColumn(name, (F.col("_first") + place + 1).cast("bigint")).drop("_row", "_part", "_first")


def encode(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds the dense number of each column; columns: original to mapped name."""
    out = df
    for c, m in columns.items():
        out = out.join(dictionary(df, c, m), c, "left")
    return out


def split(df: DataFrame, user: str, poi: str, time: str, tie: str, ratio: float) -> DataFrame:
    """Adds train and kept: train are the first int(ratio n) rows by time; of the others those whose user and place are in train."""
    n = df.agg(F.floor(F.count(F.lit(1)) * F.lit(ratio)).alias("_cut"))
    d = positions(df, [F.col(time), F.col(tie)], "position").crossJoin(F.broadcast(n))  # one row
    d = d.withColumn("train", F.col("position") <= F.col("_cut")).drop("_cut")
    seen = lambda c: d.where("train").select(F.col(c).alias(f"_{c}")).distinct().withColumn(f"_in_{c}", F.lit(True))
    out = d.join(seen(user), F.col(user) == F.col(f"_{user}"), "left").join(seen(poi), F.col(poi) == F.col(f"_{poi}"), "left")
    test = ~F.col("train") & F.col(f"_in_{user}").isNotNull() & F.col(f"_in_{poi}").isNotNull()
    return out.withColumn("test", test).drop(f"_{user}", f"_{poi}", f"_in_{user}", f"_in_{poi}")


def eval_base(parts: DataFrame, user: str) -> DataFrame:
    """All events of the users with test rows, from either period, also those at places that training has not seen."""
    return parts.join(parts.where("test").select(user).distinct(), user, "left_semi")
