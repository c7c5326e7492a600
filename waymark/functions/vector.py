"""Vectors as arrays of doubles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector by its length; a zero vector is an error."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(F.raise_error(F.lit("zero vector")))


def unit_or_zero(a: Column) -> Column:
    """The vector by its length, which is taken once and not for each component; a zero vector stays."""
    return F.transform(F.array(norm(a)), lambda n: F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a))[0]


def finite(a: Column) -> Column:
    """Whether the vector has components and all are finite numbers; never null."""
    return F.coalesce((F.size(a) > 0) & F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def matrix(a: pa.Array) -> np.ndarray:
    """The vectors of an Arrow batch as rows of doubles; null ones, and vectors of different lengths, are an error."""
    lengths = pc.unique(pc.list_value_length(a)).to_pylist()
    if len(lengths) != 1 or lengths[0] is None:
        raise ValueError(f"vectors of different lengths: {', '.join(map(str, lengths[:9]))}")
    return a.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(a), lengths[0])


def time_features(hours: Column, weights: Column, harmonics: int = 6) -> Column:
    """Weighted means of sin and cos of 2 pi k hour / 24, k = 1..; nothing to weigh gives zeros."""
    total = F.aggregate(weights, F.lit(0.0), lambda s, w: s + w)
    pi2 = 2 * 3.141592653589793 / 24

    def mean(k: int, wave) -> Column:
        parts = F.zip_with(hours, weights, lambda h, w: wave(h.cast("double") * (pi2 * k)) * w)
        return F.when(total > 0, F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / total).otherwise(0.0)

    return F.array(*[mean(k, wave) for k in range(1, harmonics + 1) for wave in (F.sin, F.cos)])


def health(a: Column) -> Column:
    """Length and counts of null, NaN and infinite components."""
    n = lambda test: F.size(F.filter(a, test))
    return F.struct(F.size(a).alias("length"), n(lambda x: x.isNull()).alias("nulls"), n(F.isnan).alias("nans"), n(lambda x: F.abs(x) == float("inf")).alias("infs"))
