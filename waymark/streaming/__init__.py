"""Beyond batch parity: reward traces as a stream, rolled up by event-time windows with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRACE_SCHEMA = "time_ns bigint, pid bigint, local_record_index bigint, group_size_hint bigint, total_reward double, single_line_score double, parsed_prediction_count int, hit double, solution_preview string"


def trace_stream(spark: SparkSession, path: str, schema: str = TRACE_SCHEMA, files_per_trigger: int = 64) -> DataFrame:
    """New JSON-lines files of a folder as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def rolled(traces: DataFrame, every: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Counts and mean rewards of each window; works on batches too."""
    t = traces.withColumn("at", F.timestamp_micros((F.col("time_ns") / 1000).cast("bigint")))
    t = t.withWatermark("at", late) if t.isStreaming else t
    return t.groupBy(F.window("at", every)).agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce("total_reward", F.lit(0.0))).alias("mean_total_reward"), F.avg(F.coalesce("single_line_score", F.lit(0.0))).alias("single_line_rate"))


def start(traces: DataFrame, out: str, checkpoint: str, once: bool = True):
    """Writes closed windows as Parquet; once: all there is now, then it stops."""
    w = rolled(traces).select(F.col("window.start").alias("start"), "n", "mean_total_reward", "single_line_rate").writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start(out)
