"""Reward traces as a stream of steps: chunks of a run's rows with running sums, kept as keyed state and written once a batch.

A run's rows are counted off in the order they come, in a batch by time, writer and the writer's own count; the state holds the rows
seen, the open chunk's sums and the sums of all closed ones, a few numbers a run. Every chunk that a batch touches is given out as it
then stands, so the last, open one is there too, and the newest row of a step counts. Runs are independent of each other; of one run a
task has what one batch brings, which `files_per_trigger` bounds. Where files come in the order of their rows' times, the steps are
those of the batch form over all files, however the rows are cut into files and batches, and after restarts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.traces import zero


def step_stream(traces: DataFrame, g: int, columns: tuple[str, ...] = ("total_reward",), run: str = "run") -> DataFrame:
    """(run, step, n, sums and means, running ones) of a stream of traces; g: rows of a step."""
    if g < 1:
        raise ValueError("a group has one row or more")
    each = "".join(f", {c}_sum double, {c}_mean double, {c}_cum double, {c}_cum_mean double" for c in columns)
    out = f"run string, step bigint, n bigint, rows_so_far bigint{each}"
    held = "seen bigint" + "".join(f", {c}_open double, {c}_closed double" for c in columns)
    order = ["time_ns", "pid", "local_record_index"]

    def advance(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(order, kind="stable")
        old = state.get if state.exists else (0, *[0.0] * (2 * len(columns)))
        seen, sums = int(old[0]), np.array(old[1:], dtype=np.float64).reshape(len(columns), 2)
        step = (seen + np.arange(len(rows))) // g
        first = seen // g
        touched = np.arange(first, step[-1] + 1)
        n = np.bincount(step - first, minlength=len(touched)) + np.where(touched == first, seen - first * g, 0)
        told = {"run": key[0], "step": touched + 1, "n": n, "rows_so_far": first * g + np.cumsum(n)}
        after = [seen + len(rows)]
        for c, (open_, closed) in zip(columns, sums, strict=True):
            s = np.bincount(step - first, rows[c].to_numpy(dtype=np.float64), minlength=len(touched))
            s[0] += open_
            cum = closed + np.cumsum(s)
            told |= {f"{c}_sum": s, f"{c}_mean": s / n, f"{c}_cum": cum, f"{c}_cum_mean": cum / told["rows_so_far"]}
            full = n[-1] == g
            after += [0.0 if full else float(s[-1]), float(cum[-1] if full else cum[-1] - s[-1])]
        state.update(tuple(after))
        yield pd.DataFrame(told)[["run", "step", "n", "rows_so_far", *[f"{c}_{x}" for c in columns for x in ("sum", "mean", "cum", "cum_mean")]]]

    d = traces.select(F.col(run).cast("string").alias("run"), *[zero(c).cast("bigint").alias(c) for c in order], *[zero(c).cast("double").alias(c) for c in columns])
    return d.groupBy("run").applyInPandasWithState(advance, out, held, "update", "NoTimeout")


def start(steps: DataFrame, out: str, checkpoint: str, once: bool = True):
    """Writes each batch under its number, in place of what an earlier try of it left; once: all there is now, then it stops."""
    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={number}")

    w = steps.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put)
    return (w.trigger(availableNow=True) if once else w).start()


def latest(written: DataFrame) -> DataFrame:
    """The newest row of each step of what start() has written."""
    r = F.row_number().over(Window.partitionBy("run", "step").orderBy(F.col("batch").desc()))
    return written.withColumn("_r", r).where("_r = 1").drop("_r", "batch")
