"""Vectors of places: category, position or region, and visiting hours; encoded columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, vector
from ..models import TextEncoder, encoded


def histogram_features(histogram: Column) -> Column:
    """Twelve features of a map from hour (text) to count."""
    hours = F.transform(F.map_keys(histogram), lambda h: h.cast("int"))
    return vector.time_features(hours, F.transform(F.map_values(histogram), lambda n: n.cast("double")))


def hour_list_features(hours: Column) -> Column:
    """The same of a plain list, each hour with weight one."""
    return vector.time_features(hours, F.transform(hours, lambda h: F.lit(1.0)))


def with_lookup(df: DataFrame, column: str, vectors: DataFrame, dimension: int, out: str) -> DataFrame:
    """Adds the vector of the column's value; values without one get zeros. vectors: (value, vec)."""
    v = vectors.select(F.col("value").alias("_value"), F.col("vec").alias(out))
    zeros = F.array_repeat(F.lit(0.0), dimension)
    return df.join(v, F.col(column).cast("string") == F.col("_value"), "left").drop("_value").withColumn(out, F.coalesce(out, zeros))


def place_vectors(places: DataFrame, categories: DataFrame, dimension: int, regions: DataFrame | None = None, region_dimension: int = 0) -> DataFrame:
    """(pid, vec): category vector, then the region's vector or the place on the unit sphere, then the features of its hours."""
    d = with_lookup(places, "category", categories, dimension, "_c")
    if regions is not None:
        d = with_lookup(d, "region", regions, region_dimension, "_s")
    else:
        d = d.withColumn("_s", geo.sphere(F.col("latitude"), F.col("longitude")))
    return d.select("pid", F.concat("_c", "_s", histogram_features(F.col("visit_time_and_count"))).alias("vec"))


def column_vectors(df: DataFrame, column: str, encoder: TextEncoder | None = None, components: int | None = None) -> DataFrame:
    """(value, vec) of the distinct values of a column, reduced to principal components where there are more dimensions."""
    values = df.select(F.col(column).cast("string").alias("value")).where("value is not null").distinct()
    v = encoded(values, "value", encoder)
    if components is None:
        return v
    from .quantise import pca_signed

    return pca_signed(v, "vec", components).select("value", F.col("components").alias("vec"))
