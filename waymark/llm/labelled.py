"""Bounded samples of labelled rows, for the two classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import draw, fold


def sample_ids(rows: DataFrame, most: int, seed: str, key: str = "doc_id") -> list[int]:
    """At most `most` distinct keys of rows, the first ones in an order by md5; null keys never.

    A threshold on the order, from the number of rows, leaves a few times `most` of them, so that not all keys are sorted or made distinct;
    where repeated keys leave fewer than `most`, the threshold is raised.
    """
    d = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), draw(seed, F.col(key)).alias("u"))
    n, share = d.count(), 0.0
    while n and share < 1:
        share = min(1.0, max(4 * share, 2.0 * (most + 100) / n))
        got = [r[0] for r in d.where(F.col("u") < int(share * 2**32)).distinct().orderBy("u", "key").limit(most).select("key").collect()]
        if len(got) == most:
            return got
    return got if n else []


def learnable(labels: DataFrame, held_out: int, key: str = "doc_id") -> DataFrame:
    """The rows whose labels may be learned from: those outside the held-out fold."""
    return labels.where((fold(key) != held_out) & F.col(key).isNotNull())


def texts_of(docs: DataFrame, ids: dict[int, list[int]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kind, text) of the documents of a bounded sample; ids: keys by kind. The sample is broadcast: its size is a parameter."""
    spark = docs.sparkSession
    rows = [(i, kind) for kind, keys in ids.items() for i in keys]
    chosen = spark.createDataFrame(rows, "_key bigint, kind int")
    narrow = docs.select(F.col(f"`{key}`").cast("bigint").alias("key"), F.col(f"`{text}`").alias("text"))
    return narrow.join(F.broadcast(chosen), F.col("key") == F.col("_key")).select("key", "kind", "text")
