"""Helpers that the operators share: reading tables, the shared folder, and splits by crc32."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_dir

#: A word of the contracts: anything but ASCII white space. ``bytes.split()`` splits at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of an Arrow batch while texts go through Python: some texts are very long, so batches stay small.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, by a path that only Spark needs to be able to open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bounds the Arrow batches of the session, so that a batch of very long texts fits a Python worker; a lower bound stays.

    Spark reads the setting when a lazy result is run, so it can't be put back before that.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= rows:
        spark.conf.set(name, str(rows))


def fresh(names: list[str], stem: str) -> str:
    """A name like the stem that none of the columns has, whatever their case."""
    there = {c.lower() for c in names}
    while stem.lower() in there:
        stem += "_"
    return stem


def packed(df: DataFrame, **inputs: Column) -> DataFrame:
    """Only the given columns, and `row` with all columns that came in, so that no column's name can clash with a step's own."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(name) for name, c in inputs.items()])


def unpacked(df: DataFrame, names: list[str], **added: Column) -> DataFrame:
    """The columns that came in, in their order, and added ones, which replace those of their names."""
    return df.select(*[F.col("row").getField(c).alias(c) for c in names if c not in added], *[c.alias(name) for name, c in added.items()])


def mapped(df: DataFrame, run: Callable, schema: T.StructType) -> DataFrame:
    """mapInArrow, which finds columns by names without quotes, also for names that need them; run takes columns by place."""
    if all(re.fullmatch(r"\w+", c) for c in df.columns):
        return df.mapInArrow(run, schema)
    plain = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema)])
    renamed = lambda batches: (b.rename_columns(plain.names) for b in run(batches))
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(renamed, plain).toDF(*schema.names)


def materialise(df: DataFrame) -> DataFrame:
    """Writes a frame to the shared folder and reads it back: it cuts the lineage and outlives any executor.

    The files go with discard(), or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/waymark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where, fs = _place(spark, path)
    fs.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._waymark_path = path
    return out


def _place(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def discard(df: DataFrame) -> None:
    """Deletes what materialise() wrote, once nothing reads it any more."""
    path = getattr(df, "_waymark_path", None)
    if path:
        where, fs = _place(df.sparkSession, path)
        fs.delete(where, True)


def fold(doc_id: str | Column = "doc_id") -> Column:
    """crc32(doc_id as text) mod 5; 0-based like the contracts; -1 where doc_id is null."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")) % 5, F.lit(-1))


def draw(seed: str, *cols: Column) -> Column:
    """A uniform number in [0, 2^32) from md5(seed|values), the same in any SQL engine with md5."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("\\N")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
