"""Importing a finished data set: known files by their old and new places, and place information enriched from raw check-ins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.places import hour_histogram

# The names that known tables have in an old tree, and their new names.
TABLES = {
    "data/train.csv": "train", "data/val.csv": "val", "data/test.csv": "test", "data/history.csv": "history", "poi_info.csv": "poi_info", "pid_mapping.csv": "pid_mapping",
    "uid_mapping.csv": "uid_mapping", "region_mapping.csv": "region_mapping", "catname_mapping.csv": "catname_mapping",
}
DOCUMENTS = {
    "data/history_id.json": "history_id", "data/history_codebook.json": "history_sid", "data/test_id.json": "test_id", "data/test_codebook.json": "test_sid",
    "data/similar_map_test_id.json": "similar_map_test_id", "data/similar_map_test_codebook.json": "similar_map_test_sid",
}
BANKS = {"data/retrieval_bank_id.jsonl": "retrieval_bank_id", "data/retrieval_bank_codebook.jsonl": "retrieval_bank_sid"}


def present(spark: SparkSession, root: str) -> dict[str, str]:
    """New name to path of the known files that a tree has; a missing root is an error. It looks through Hadoop's file systems."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(root).getFileSystem(conf)
    if not fs.exists(at(root)):
        raise FileNotFoundError(root)
    known = TABLES | DOCUMENTS | BANKS
    return {new: f"{root.rstrip('/')}/{old}" for old, new in known.items() if fs.exists(at(f"{root.rstrip('/')}/{old}"))}


def imported(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The known tables of a tree by their new names."""
    out = {}
    for new, path in present(spark, root).items():
        if path.endswith(".csv"):
            out[new] = spark.read.option("header", "true").option("inferSchema", "true").option("escape", '"').csv(path)
        else:
            out[new] = spark.read.option("multiLine", str(path.endswith(".json")).lower()).json(path)
    return out


def enriched(info: DataFrame, raw: DataFrame, mapping: DataFrame) -> DataFrame:
    """Place information with coordinates, counts and hours of raw check-ins; hours are UTC here.

    info: (Pid, Catname, Region, ...); raw: (original_uid, Original_Pid, category, category_id, latitude, longitude, utc_ts);
    mapping: (Original_Pid, Mapped_Pid). Places without check-ins keep nulls and an empty histogram, and Catname as category.
    """
    d = raw.dropna(subset=["Original_Pid", "latitude", "longitude", "utc_ts"]).join(mapping, "Original_Pid")
    d = d.withColumn("hour", F.hour("utc_ts")).withColumn("Pid", F.col("Mapped_Pid").cast("bigint"))
    first = F.struct("utc_ts", "original_uid")
    g = d.groupBy("Pid").agg(
        F.min_by("Original_Pid", first).alias("original_pid"), F.min_by("category", first).alias("category"), F.min_by("category_id", first).alias("category_id"), F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"),
        F.countDistinct("original_uid").alias("unique_user_count"), F.count(F.lit(1)).alias("visit_count"), F.array_sort(F.collect_set("hour")).alias("visit_hours"),
    )
    out = info.join(g, "Pid", "left").join(hour_histogram(d, "Pid", "hour"), "Pid", "left")
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    # Column names do not tell Pid from pid, so the key keeps the one name it has.
    return out.withColumns({"category": F.coalesce("category", F.col("Catname").cast("string")), "region": F.col("Region").cast("string"), "visit_time_and_count": F.coalesce("visit_time_and_count", empty)})
