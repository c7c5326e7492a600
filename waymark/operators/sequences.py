"""Per-user sequences: train, evaluation and history windows, sample rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sid, text
from ..functions.draws import draw
from .base import positions


def gathered(df: DataFrame, user: str, poi: str, time: str, tie: str, most: int | None = None) -> DataFrame:
    """user, p and t: the places and times of each user in order; before: how many earlier events are left out.

    With `most` only a user's last so many events are gathered: each task cuts what it has of a user to them before rows are sent, so
    the longest array is as long as that. Without it a user's events are one array, as a history of all of them is one text.
    """
    d, held = df.withColumn("_u", F.col(user)), F.lit(0).cast("bigint")
    if most is not None:
        counts = d.groupBy("_u").agg(F.count(F.lit(1)).alias("_n")).withColumnRenamed("_u", "_v")
        latest = Window.partitionBy("_u").orderBy(F.col(time).desc(), F.col(tie).desc(), F.col(poi).desc())
        d = d.withColumn("_r", F.row_number().over(latest)).where(F.col("_r") <= most)
        d = d.join(counts.where(F.col("_n") > most), F.col("_u") == F.col("_v"), "left")
        held = F.coalesce(F.max("_n") - most, held)
    s = F.array_sort(F.collect_list(F.struct(F.col(time).alias("t"), F.col(tie).alias("e"), F.col(poi).alias("p"))))
    g = d.groupBy(F.col("_u").alias("uid")).agg(s.alias("s"), (F.max(held) if most is None else held).alias("before"))
    return g.select("uid", F.transform("s", lambda x: x["p"]).alias("p"), F.transform("s", lambda x: x["t"]).alias("t"), "before")


def _windowed(d: DataFrame, ends: Column, width: Column, *others: str) -> DataFrame:
    """Inputs of `width` items that end before each of `ends` (0-based places of targets)."""
    d = d.withColumn("end", F.explode(ends)).withColumn("w", width)
    cut = lambda c: F.slice(c, F.col("end") - F.col("w") + 1, F.col("w"))
    return d.select("uid", "end", cut(F.col("p")).alias("pids"), cut(F.col("t")).alias("times"), F.get("p", F.col("end")).alias("target"), F.get("t", F.col("end")).alias("target_time"), *others)


def train_windows(seqs: DataFrame, window: int = 50, step: int = 10, mask_prob: float = 0.1, most: int = 80, least: int = 10, seed: int = 42) -> DataFrame:
    """Windows over the last `most` events: under `window` events one row, if there are `least`; else one each `step` from the end.

    With probability mask_prob a full window's target becomes one of its inputs, drawn by hash, and the true last event an input.
    """
    n0 = F.size("p")
    last = lambda c: F.slice(c, F.greatest(n0 - most, F.lit(0)) + 1, F.lit(most))
    d = seqs.select("uid", last(F.col("p")).alias("p"), last(F.col("t")).alias("t")).withColumn("n", F.size("p"))
    short = F.when(F.col("n") >= least, F.array(F.col("n") - 1)).otherwise(F.array().cast("array<int>"))
    full = F.when(F.col("n") >= window, F.sequence(F.col("n") - 1, F.lit(window - 1), F.lit(-step))).otherwise(short)
    w = _windowed(d, full, F.when(F.col("n") >= window, F.lit(window - 1)).otherwise(F.col("n") - 1))
    key = F.concat_ws("|", F.col("uid").cast("string"), F.col("end").cast("string"))
    masked = (F.size("pids") == window - 1) & (draw(f"{seed}-mask", key) < mask_prob)
    at = F.floor(draw(f"{seed}-place", key) * F.size("pids")).cast("int")
    swap = lambda c, new: F.concat(F.slice(c, F.lit(1), at), F.slice(c, at + 2, F.greatest(F.size(c) - at - 1, F.lit(0))), F.array(new))
    return w.select(
        "uid", "end", masked.alias("masked"), F.when(masked, swap(F.col("pids"), F.col("target"))).otherwise(F.col("pids")).alias("pids"), F.when(masked, swap(F.col("times"), F.col("target_time"))).otherwise(F.col("times")).alias("times"),
        F.when(masked, F.get("pids", at)).otherwise(F.col("target")).alias("target"), F.when(masked, F.get("times", at)).otherwise(F.col("target_time")).alias("target_time"),
    )


def eval_windows(seqs: DataFrame, window: int = 50) -> DataFrame:
    """split, uid, ...: under `window` events (over 2) a test row on the last and a val row on the one before; else full windows.

    With exactly `window` events there is a test row only. Of a user's events the last window + 1 are enough; `end` counts all of them.
    """
    d = seqs.withColumn("n", F.size("p"))
    if "before" not in d.columns:
        d = d.withColumn("before", F.lit(0))

    def part(split: str, back: int) -> DataFrame:
        few = F.when((F.col("n") < window) & (F.col("n") > 2), F.array(F.col("n") - back)).otherwise(F.array().cast("array<int>"))
        ends = F.when(F.col("n") >= window + back - 1, F.array(F.col("n") - back)).otherwise(few)
        w = _windowed(d, ends, F.when(F.col("n") >= window, F.lit(window - 1)).otherwise(F.col("n") - back), "before")
        return w.withColumn("end", (F.col("end") + F.col("before")).cast("int")).drop("before").withColumn("split", F.lit(split))

    return part("test", 1).unionByName(part("val", 2))


def history_rows(seqs: DataFrame) -> DataFrame:
    """All but the last event to the last one, for users with more than one."""
    d = seqs.where(F.size("p") > 1).withColumn("n", F.size("p"))
    return _windowed(d, F.array(F.col("n") - 1), F.col("n") - 1)


def indexed(windows: DataFrame) -> DataFrame:
    """Adds row_index from 0: by user, a user's windows from the last one back."""
    d = positions(windows.withColumn("_back", -F.col("end")), [F.col("uid"), F.col("_back")], "row_index")
    return d.withColumn("row_index", F.col("row_index") - 1).drop("_back")


def with_tokens(windows: DataFrame, sids: DataFrame) -> DataFrame:
    """Adds tokens and goal, the semantic IDs of a window's places and of its target, by one join on the exploded places.

    windows: with row_index; sids: (pid, sid_token). A place without a semantic ID is an error.
    """
    m = sids.select(F.col("pid").alias("_pid"), "sid_token")
    lost = F.when(F.col("sid_token").isNull(), F.raise_error(F.lit("a place without a semantic ID"))).otherwise(F.col("sid_token"))
    every = windows.select("row_index", F.posexplode(F.concat("pids", F.array("target"))).alias("i", "_q"))  # the target stands last
    long = every.join(m, F.col("_q") == F.col("_pid"), "left")
    toks = long.groupBy("row_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", lost.alias("s")))), lambda x: x["s"]).alias("_all"))
    return windows.join(toks, "row_index").withColumns({"tokens": F.slice("_all", F.lit(1), F.size("_all") - 1), "goal": F.element_at("_all", -1)}).drop("_all")


def sample_rows(windows: DataFrame, split: Column, row_index: Column, kind: str, current_k: int, tokens: Column | None = None, target: Column | None = None) -> DataFrame:
    """Sample rows with their three texts; current_k > 0 keeps the last so many inputs. tokens and target: for kind sid."""
    keep = (lambda c: F.slice(c, F.greatest(F.size(c) - current_k, F.lit(0)) + 1, F.lit(current_k))) if current_k > 0 else (lambda c: c)
    toks = F.transform("pids", sid.place_token) if kind == "id" else tokens
    goal = sid.place_token(F.col("target")) if kind == "id" else target
    d = windows.withColumns({"_split": split, "_row": row_index, "_tok": toks, "_goal": goal})
    d = d.withColumns({"_tok": keep(F.col("_tok")), "_t": keep(F.col("times")), "_p": keep(F.col("pids"))})
    key = text.sequence(F.col("uid"), F.col("_tok"), F.col("_t"))
    query = text.sequence(F.col("uid"), F.concat("_tok", F.array("_goal")), F.concat("_t", F.array("target_time")))
    return d.select(
        F.format_string("%s-%05d-u%d", "_split", "_row", "uid").alias("sample_id"), F.col("_split").alias("split"), F.col("_row").alias("row_index"), "uid", F.lit(kind).alias("repr"),
        F.col("target").alias("target_pid"), F.col("_goal").alias("target"), "target_time", key.alias("key_text"), query.alias("query_text"),
        text.prediction_input(F.col("uid"), F.col("_tok"), F.col("_t"), F.col("target_time")).alias("input_text"), F.col("_p").alias("observed_pids"), F.col("_t").alias("observed_times"),
    )
