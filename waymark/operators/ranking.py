"""Ranked candidate lists, retrieval, accuracy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import profile, sid
from ..session import cut
from . import seeding

TOP = 10
SAME_ABC, SAME_AB, SAME_A = 2, 2, 2


def ranked_targets(targets: DataFrame, space: DataFrame, top: int = TOP) -> DataFrame:
    """(target, candidate, rank) from distinct targets and the SID space (sid, n: train count).

    After the target comes one more of its abc; then the best SID of each other abc: at most two of the same ab, two of the same
    a with another ab, then any. Only the best few of a tier can be taken, so a target meets the best of its ab, of its a and of
    all (top + what the nearer tiers may take from them), not the whole space.
    """
    s = space.select("sid", "n", sid.prefix(F.col("sid"), "a").alias("a"), sid.prefix(F.col("sid"), "ab").alias("ab"), sid.prefix(F.col("sid"), "abc").alias("abc"))
    by = [F.col("n").desc(), F.col("sid")]
    num = lambda d, keys, name: d.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*by)))
    best = num(s, ["abc"], "k").where("k = 1").drop("k")  # one SID of each abc
    in_ab = num(best, ["ab"], "k").where(F.col("k") <= SAME_AB + 1).drop("k")
    in_a = num(num(best, ["a", "ab"], "j").where(F.col("j") <= SAME_A), ["a"], "k")
    # In its a, a target may not take those of its own ab, which can be the best ones: keep the best of each ab.
    in_a = in_a.drop("j", "k")
    a_top = num(best, ["a"], "k").where(F.col("k") <= top + SAME_AB + SAME_A + 1).drop("k")
    all_top = a_top.orderBy(*by).limit(top + SAME_AB + SAME_A + 2)
    t = targets.select(F.col("target"), sid.prefix(F.col("target"), "a").alias("ta"), sid.prefix(F.col("target"), "ab").alias("tab"), sid.prefix(F.col("target"), "abc").alias("tabc"))
    pick = lambda d, tier: d.select("target", "tabc", "sid", "n", "abc", F.lit(tier).alias("tier"))
    own = t.select("target", F.col("target").alias("candidate"), F.lit(0).alias("tier"), F.lit(0).cast("bigint").alias("n"))
    twins = num(s, ["abc"], "k").where(F.col("k") <= SAME_ABC).drop("k")  # the target itself may be one of the best
    twin = pick(num(t.join(twins, F.col("abc") == F.col("tabc")).where("sid <> target"), ["target"], "k").where(F.col("k") <= SAME_ABC - 1), 1)
    ab = pick(num(t.join(in_ab, F.col("ab") == F.col("tab")).where("abc <> tabc"), ["target"], "k").where(F.col("k") <= SAME_AB), 2)
    a = pick(num(t.join(in_a, F.col("a") == F.col("ta")).where("ab <> tab"), ["target"], "k").where(F.col("k") <= SAME_A), 3)
    near = ab.unionByName(a).select(F.col("target").alias("_t"), F.col("abc").alias("_abc"))
    wide = t.join(F.broadcast(all_top), F.col("abc") != F.col("tabc"))  # at most top + 6 rows
    wide = wide.join(near, (F.col("target") == F.col("_t")) & (F.col("abc") == F.col("_abc")), "left_anti")
    rest = pick(wide, 4)
    every = own.unionByName(twin.unionByName(ab).unionByName(a).unionByName(rest).select("target", F.col("sid").alias("candidate"), "tier", "n"))
    r = F.row_number().over(Window.partitionBy("target").orderBy("tier", F.col("n").desc(), "candidate"))
    return every.withColumn("rank", r).where(F.col("rank") <= top).select("target", "candidate", "tier", "rank")


#: Vectors of a block of queries or of keys; a task scores a block with a block. Cells that blocks are made of, at most.
BLOCK = 4096
MOST_CELLS = 256


def _score(one: pd.DataFrame, other: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best keys of a block for each query of a block."""
    out = []
    if len(one) and len(other):
        other = other.rename(columns=lambda c: c[2:]).sort_values("id", kind="stable")
        s = (np.array(one["vec"].tolist()) @ np.array(other["vec"].tolist()).T).round(9)
        barred = (other["t"].to_numpy()[None, :] >= one["t"].to_numpy()[:, None]) | (other["id"].to_numpy()[None, :] == one["id"].to_numpy()[:, None])
        s[barred] = -np.inf
        for row, own in zip(s, one["id"], strict=True):
            best = np.argsort(-row, kind="stable")[:k]
            out += [(own, other["id"].iloc[j], float(row[j])) for j in best if row[j] > -np.inf]
    return pd.DataFrame(out, columns=["query_id", "key_id", "score"])


def _scored(q: DataFrame, t: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """(query_id, key_id, score) of the pairs of blocks: k rows a query and pair; both blocks of a pair travel to one task."""
    ids = dict(t.dtypes)["id"]
    left = q.select("qb", "id", "t", "vec").join(pairs, "qb")
    right = t.select(F.col("kb").alias("k_kb"), F.col("id").alias("k_id"), F.col("t").alias("k_t"), F.col("vec").alias("k_vec")).join(pairs.select(F.col("qb").alias("k_qb"), F.col("kb").alias("_kb")), F.col("k_kb") == F.col("_kb")).drop("_kb")
    cogrouped = left.groupBy("qb", "kb").cogroup(right.groupBy("k_qb", "k_kb"))
    return cogrouped.applyInPandas(lambda one, other: _score(one, other, k), f"query_id {ids}, key_id {ids}, score double")


def _best(part: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "key_id"))
    return part.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "key_id", "score", "rank")


def causal_topk(queries: DataFrame, keys: DataFrame, k: int, block: int = BLOCK, report: dict | None = None) -> DataFrame:
    """(query_id, key_id, score, rank): the k most similar keys before the query's time, itself excluded; vectors are unit ones.

    The search is exact and skips blocks. Blocks are made of vectors nearest to one of some drawn pivots, keys by time too, so none
    has much over `block` rows. A pair of blocks can't hold a cosine above that of the angle between their pivots less both blocks'
    widest angles. First each block of queries meets the blocks of its own pivot; then, with the least k-th score of its queries as
    threshold, only those others that may reach it. Blocks of keys that all come later are never met. A pair is one product of
    matrices in an Arrow batch. Ties, to nine digits, by key. report: gets the numbers of pairs that time allows and that were scored.
    """
    stamp = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    side = lambda d: d.select("id", stamp("time").alias("t"), F.col("vec").cast("array<double>").alias("vec")).where("t is not null")
    q, t = cut(side(queries)), cut(side(keys))
    n, m = t.count(), q.count()
    if not n or not m:
        return _best(q.join(t.select(F.col("id").alias("key_id")), F.lit(False)).select(F.col("id").alias("query_id"), "key_id", F.lit(0.0).alias("score")), k)
    cells = min(MOST_CELLS, -(-n // block))
    pivots = np.unique(np.array([r["vec"] for r in t.orderBy(F.xxhash64("id"), "id").limit(cells).select("vec").collect()]), axis=0)  # at most MOST_CELLS
    epochs = max(1, -(-n // (block * len(pivots))))
    bounds = t.agg(F.percentile_approx("t", [e / epochs for e in range(1, epochs)] or [0.5], 10_000)).first()[0] if epochs > 1 else []
    # A row an epoch: as many as blocks of one cell.
    epoch = F.size(F.filter(F.array(*[F.lit(int(x)) for x in bounds]), lambda x: x < F.col("t"))) if bounds else F.lit(0)

    def blocks(d: DataFrame, name: str, by: list[str]) -> tuple[DataFrame, DataFrame]:
        """The rows with their block, and the blocks with pivot, widest angle and span of time."""
        near = seeding.nearest(d, pivots).withColumn("angle", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - F.col("square") / 2))))
        near = cut(near.withColumn("epoch", epoch))
        sizes = near.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("n"))
        near = near.join(sizes, by).withColumn(name, F.concat_ws("-", *by, F.pmod(F.xxhash64("id"), F.col("n"))))
        return near, cut(near.groupBy(name, "code").agg(F.max("angle").alias("wide"), F.min("t").alias("first"), F.max("t").alias("last")))

    q, qb = blocks(q, "qb", ["code"])
    t, kb = blocks(t, "kb", ["code", "epoch"])
    between = np.arccos(np.clip(pivots @ pivots.T, -1, 1))
    spark = t.sparkSession
    turned = spark.createDataFrame([(i, j, float(between[i, j])) for i in range(len(pivots)) for j in range(len(pivots))], "code int, k_code int, between double")  # at most MOST_CELLS squared
    kb = kb.select("kb", F.col("code").alias("k_code"), F.col("wide").alias("k_wide"), F.col("first").alias("k_first"))
    pairs = qb.join(turned, "code").join(kb, ["k_code"]).where(F.col("k_first") < F.col("last"))
    most = F.cos(F.greatest(F.lit(0.0), F.col("between") - F.col("wide") - F.col("k_wide")))
    pairs = cut(pairs.select("qb", "kb", (F.col("code") == F.col("k_code")).alias("own"), most.alias("most")))
    first = cut(_best(_scored(q, t, pairs.where("own").select("qb", "kb"), k), k))
    kth = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth"))
    least = q.select("id", "qb").join(kth, "id", "left").groupBy("qb").agg(F.min(F.coalesce("kth", F.lit(-2.0))).alias("least"))
    open_ = cut(pairs.where("not own").join(least, "qb").where(F.col("most") >= F.col("least") - 1e-8).select("qb", "kb"))
    if report is not None:
        report |= {"pairs": pairs.count(), "scored": pairs.where("own").count() + open_.count()}
    return _best(first.drop("rank").unionByName(_scored(q, t, open_, k)), k)


def enriched(predictions: DataFrame, kind: str = "sid") -> DataFrame:
    """Each row with its parsed predictions and whether the first 1, 5 and 10 of them hold the target.

    Empty parsed lists are read from the text again, by the row's own `repr` where there is one, else by `kind`.
    """
    text = F.coalesce("prediction", F.lit(""))
    again = sid.predictions(text, kind)
    if "repr" in predictions.columns:
        again = F.when(F.coalesce("repr", F.lit(kind)) == "id", sid.predictions(text, "id")).otherwise(sid.predictions(text, "sid"))
    had = F.col("parsed_predictions") if "parsed_predictions" in predictions.columns else F.array().cast("array<string>")
    d = predictions.withColumn("parsed_predictions", F.when(F.size(had) > 0, had).otherwise(again))
    return d.withColumns({f"top{k}_correct": F.coalesce(F.array_contains(F.slice("parsed_predictions", 1, k), F.col("target")), F.lit(False)) for k in (1, 5, 10)})


def accuracy(predictions: DataFrame, kind: str = "sid") -> DataFrame:
    """One row of ranking metrics; no rows give zeros. A prompt_char_length column stands for the prompt's length."""
    d = enriched(predictions, kind)
    length = F.length("prompt") if "prompt" in d.columns else F.lit(0)
    length = F.coalesce("prompt_char_length", length, F.lit(0)) if "prompt_char_length" in d.columns else F.coalesce(length, F.lit(0))
    hit = lambda k: F.col(f"top{k}_correct").cast("int")
    n = F.count(F.lit(1))
    share = lambda c: F.coalesce(F.try_divide(F.sum(c).cast("double"), n), F.lit(0.0))
    return d.agg(
        n.alias("num_samples"), *[F.coalesce(F.sum(hit(k)), F.lit(0)).cast("bigint").alias(f"correct{k}") for k in (1, 5, 10)], *[share(hit(k)).alias(f"acc{k}") for k in (1, 5, 10)],
        share(length).alias("mean_prompt_length"), share(F.size("parsed_predictions")).alias("mean_parsed"), share((F.size("parsed_predictions") == TOP).cast("int")).alias("exact_ten_rate"),
    )


def profile_eval(d: DataFrame) -> DataFrame:
    """One row of rates from (prediction, output): valid profiles, and each field and all fields right; regions compare as text.

    dominant_category_share and dominant_region_share: the rows with the most frequent predicted value, of all rows. Profiles are
    told apart by their canonical JSON, so white space of an answer does not count.
    """
    get = lambda c, f: F.get_json_object(c, f"$.{f}")
    d = d.withColumn("_ok", profile.valid(F.col("prediction"), "abc"))
    d = d.withColumns({f"_p_{f}": F.when(F.col("_ok"), get("prediction", f)) for f in profile.FIELDS["abc"]})
    right = {f: F.coalesce(F.col(f"_p_{f}") == get("output", f), F.lit(False)).cast("double") for f in profile.FIELDS["abc"]}
    rate = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    rates = [rate(c).alias(f"{f}_rate") for f, c in right.items()]
    # The canonical form keeps the difference between a region that is a number and one that is its text.
    kind = F.regexp_extract("prediction", r'"region"\s*:\s*(")?', 1)
    whole = F.when(F.col("_ok"), F.struct("_p_category", "_p_region", "_p_geo_bucket", kind))
    one = d.agg(F.count(F.lit(1)).alias("num_samples"), rate(F.col("_ok").cast("double")).alias("valid_rate"), *rates, rate(right["category"] * right["region"] * right["geo_bucket"]).alias("joint_rate"), F.countDistinct(whole).alias("unique_profiles"))
    for f in ("category", "region"):
        most = d.where("_ok").groupBy(f"_p_{f}").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("_m"))
        one = one.crossJoin(most).withColumn(f"dominant_{f}_share", F.coalesce(F.try_divide(F.col("_m").cast("double"), F.col("num_samples")), F.lit(0.0))).drop("_m")  # one row each
    return one


def prefix_eval(d: DataFrame, level: str) -> DataFrame:
    """valid_prefix_rate: the first prefix is a candidate; exact_match_rate: it is the output."""
    p = sid.first_prefix(F.col("prediction"), level)
    rate = lambda c: F.coalesce(F.avg(F.coalesce(c, F.lit(False)).cast("double")), F.lit(0.0))
    return d.agg(F.count(F.lit(1)).alias("num_samples"), rate(F.array_contains("candidate_prefixes", p)).alias("valid_prefix_rate"), rate(p == F.col("output")).alias("exact_match_rate"))
