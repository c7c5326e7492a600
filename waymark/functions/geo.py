"""Cells and coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the digits of Open Location Codes.
DIGITS = "23456789CFGHJMPQRVWX"


def plus_code(lat: Column, lon: Column) -> Column:
    """The first six digits of the Open Location Code: cells of 0.05 degrees, in whole 1/8000 degrees against edge errors."""
    y = F.least(F.greatest(F.floor(lat * 8000).cast("bigint") + 720000, F.lit(0)), F.lit(1439999))
    x = F.pmod(F.floor(lon * 8000).cast("bigint") + 1440000, F.lit(2880000))
    digit = lambda v, cell: F.substring(F.lit(DIGITS), (F.floor(v / cell) % 20 + 1).cast("int"), F.lit(1))
    return F.concat(*[digit(v, cell) for cell in (160000, 8000, 400) for v in (y, x)])


def _cell(v: Column, lo: Column, hi: Column, grid: int) -> Column:
    share = (v - lo) / (hi - lo)
    return F.when(hi <= lo, 0).when(v >= hi, grid - 1).otherwise(F.least(F.greatest(F.floor(share * grid), F.lit(0)), F.lit(grid - 1))).cast("int")


def bucket(lat: Column, lon: Column, lat_min: Column, lat_max: Column, lon_min: Column, lon_max: Column, grid: int = 8) -> Column:
    """G{row}_{column} on coordinates between the bounds; a flat range is cell 0, the upper bound the last cell."""
    return F.format_string("G%d_%d", _cell(lat, lat_min, lat_max, grid), _cell(lon, lon_min, lon_max, grid))


def bucket_distance(one: Column, other: Column) -> Column:
    """Manhattan distance of two buckets, null where either has another form."""
    part = lambda c, i: F.expr("try_cast(null as int)") if c is None else F.nullif(F.regexp_extract(c, r"^G(\d+)_(\d+)$", i), F.lit("")).cast("int")
    return F.abs(part(one, 1) - part(other, 1)) + F.abs(part(one, 2) - part(other, 2))


def sphere(lat: Column, lon: Column) -> Column:
    """Latitude and longitude on the unit sphere."""
    a, b = F.radians(lat), F.radians(lon)
    return F.array(F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a))
