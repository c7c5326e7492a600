"""Whole builds: compositions of operators that return their tables by name, lazy until written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import prompts, sid, text
from ..models import Generator, TextEncoder, encoded, generated
from ..operators import base, places, ranking, sampling, semantic, sequences
from ..session import BuildConfig, cut


def trajectories(raw: DataFrame, config: BuildConfig | None = None, seq: str | None = None) -> dict[str, DataFrame]:
    """Raw check-ins to mapped events, four mappings, windows, history and place information; three steps are written out.

    seq breaks ties of time; without one, a hash of the row does.
    """
    c = config or BuildConfig()
    d = base.clean(raw)
    d = d.withColumn("seq", F.col(seq) if seq else F.xxhash64(*d.columns))
    d = cut(base.frequent(d, "original_pid", "original_uid", c.poi_min, c.user_min))
    names = {"original_uid": "uid", "original_pid": "pid", "category": "catname", "region": "region_id"}
    out = {f"{m}_mapping": base.dictionary(d, o, m) for o, m in names.items()}
    mapped = cut(base.encode(d, names))  # windows, places and counts all read it
    parts = cut(base.split(mapped, "uid", "pid", "Time", "seq", c.train_ratio))
    train = sequences.gathered(parts.where("train"), "uid", "pid", "Time", "seq")
    latest = sequences.gathered(parts.where("train"), "uid", "pid", "Time", "seq", most=c.max_user_events)
    ev = sequences.eval_windows(sequences.gathered(base.eval_base(parts, "uid"), "uid", "pid", "Time", "seq", most=c.window + 1), c.window)
    tw = sequences.train_windows(latest, c.window, c.step, c.mask_prob, c.max_user_events, c.min_sequence, c.seed)
    order = mapped.withColumn("hour", F.col("visit_hour"))
    info = places.summary(order)
    for name, forward in (("neighbors", False), ("forward_neighbors", True)):
        info = info.join(places.neighbour_lists(order, forward).withColumnRenamed("neighbours", name), "pid")
    out |= {"checkins": mapped, "train": tw, "test": ev.where("split = 'test'"), "val": ev.where("split = 'val'"), "history": sequences.history_rows(train), "poi_info": info}
    return out


def manifest(tables: dict[str, DataFrame], config: BuildConfig | None = None) -> dict:
    """Row counts and parameters of a build."""
    return {"rows": {k: d.count() for k, d in tables.items()}, "config": vars(config or BuildConfig())}


def history_texts(history: DataFrame) -> DataFrame:
    """(uid, history) from history rows, so that the section is there after a raw build too."""
    toks = F.transform("pids", sid.place_token)
    return history.select("uid", text.sequence(F.col("uid"), toks, F.col("times")).alias("history"))


def supervised(samples: DataFrame, source: str = "current", histories: DataFrame | None = None) -> DataFrame:
    """(instruction, input, output, sample_id) for supervised training."""
    now = prompts.current(F.col("input_text"), F.col("key_text"), F.col("target_time"))
    d = samples if source == "current" else samples.join(histories, "uid", "left")
    past = None if source == "current" else prompts.history(F.col("history"))
    return d.select(F.lit(prompts.INSTRUCTION).alias("instruction"), prompts.body(source, now, past).alias("input"), F.col("target").alias("output"), "sample_id")


def alignment(rows: DataFrame, ratio: float = 0.1, seed: int = 42) -> dict[str, DataFrame]:
    """Prototypes, purity, train and valid records of the three phases, and the counts of tasks; rows and records are written out.

    Training phases draw the records of full IDs and of abc prefixes by inverse frequency, the others evenly.
    """
    rows = cut(rows)
    if not rows.limit(1).count():
        raise ValueError("no place has a semantic ID")
    protos = cut(semantic.prototypes(rows))
    sides = cut(semantic.split_prefixes(rows, ratio, seed))
    out = {"prototypes": protos, "purity": semantic.purity(rows)}
    for name, flag in (("train", ~F.col("valid")), ("valid", F.col("valid"))):
        r = cut(sampling.weighted(semantic.records(rows, protos, sides.where(flag), seed), rows))
        fam = {f: r.where(F.col("task_type") == f) for f in ("full_sid_to_abc_profile", "abc_to_abc_profile", "abc_profile_to_abc")}
        fam["phase_a_replay"] = a = r.where(F.col("sid_level").isin("a", "ab"))
        out[f"{name}_phase_a"] = sampling.shuffled(a, "sample_id", seed)
        if name == "train":
            out["train_phase_b1"] = sampling.mixed({f: fam[f] for f, _ in sampling.PHASE_B1}, sampling.PHASE_B1, seed=seed, weight="weight")
            out["train_phase_b2"] = sampling.mixed(fam, sampling.PHASE_B2, seed=seed, weight="weight")
        else:
            out["valid_phase_b1"] = sampling.shuffled(fam["full_sid_to_abc_profile"].unionByName(fam["abc_to_abc_profile"]), "sample_id", seed)
            out["valid_phase_b2"] = sampling.shuffled(r, "sample_id", seed)
    out = {k: d.drop("weight", "draw", "family") for k, d in out.items()}
    counts = None
    for k, d in out.items():
        if "phase" in k:
            n = semantic.task_counts(d).select(F.lit(k).alias("table"), "task_type", "n")
            counts = n if counts is None else counts.unionByName(n)
    return out | {"task_counts": counts}


def warmup(samples: DataFrame, space: DataFrame) -> DataFrame:
    """Supervised rows whose output is a ranked list of ten; lists are made once for each distinct target."""
    r = ranking.ranked_targets(samples.select("target").distinct(), space)
    lists = r.groupBy("target").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "candidate"))), lambda x: x["candidate"]).alias("ranked_targets"))
    short = F.when(F.size("ranked_targets") < 10, F.raise_error(F.lit("fewer than ten candidates"))).otherwise(F.col("ranked_targets"))
    d = samples.join(lists.withColumn("ranked_targets", short), "target")
    body = F.concat(prompts.current(F.col("input_text"), F.col("key_text"), F.col("target_time")), F.lit("\n\n" + prompts.requirements("sid")))
    return d.select(F.lit(prompts.system("sid") + "\n\n" + prompts.INSTRUCTION).alias("instruction"), body.alias("input"), F.array_join("ranked_targets", " ").alias("output"), "sample_id", "target", "ranked_targets")


def chat(samples: DataFrame, data_source: str = "next_poi", ability: str = "next_poi_prediction") -> DataFrame:
    """RL rows with system and user messages."""
    body = prompts.current(F.col("input_text"), F.col("key_text"), F.col("target_time"))
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return samples.select(
        F.lit(data_source).alias("data_source"), F.lit(ability).alias("ability"), F.array(message("system", F.lit(prompts.system("sid"))), message("user", prompts.prompt(body, "sid"))).alias("messages"),
        F.col("target").alias("ground_truth"), "sample_id", "uid", F.lit("sid").alias("repr"), F.lit("current").alias("history_source"), "target_time", F.lit(prompts.VERSION).alias("prompt_template_version"),
    )


def bank(splits: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The union of all splits' samples, and its counts by split."""
    out = splits[0]
    for s in splits[1:]:
        out = out.unionByName(s)
    return out, out.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def similar_map(bank_rows: DataFrame, split: str, k: int = 35, encoder: TextEncoder | None = None) -> DataFrame:
    """(query_id, key_id, score, rank): train samples like each of the split's, before its time; texts are encoded once each."""
    at = F.to_timestamp("target_time", "yyyy-MM-dd HH:mm")
    q = encoded(bank_rows.where(F.col("split") == split).select(F.col("sample_id").alias("id"), at.alias("time"), "key_text"), "key_text", encoder).select("id", "time", "vec")
    t = encoded(bank_rows.where("split = 'train'").select(F.col("sample_id").alias("id"), at.alias("time"), "query_text"), "query_text", encoder).select("id", "time", "vec")
    return ranking.causal_topk(q, t, k)


def prompted(samples: DataFrame, kind: str, source: str = "current", histories: DataFrame | None = None, similar: DataFrame | None = None, keep: int | None = None, n: int = 10) -> DataFrame:
    """Samples with their prompt. similar: (query_id, key_text, target, rank) of retrieved cases, of which 3 (hybrid) or 5 are shown unless `keep` says so."""
    d = samples
    past = cases = None
    if source in ("original", "hybrid"):
        d = d.join(histories, "uid", "left")
        past = prompts.history(F.col("history"))
    if source in ("retrieval", "hybrid"):
        most = keep or (3 if source == "hybrid" else 5)
        s = similar.where(F.col("rank") <= most).select("query_id", "rank", prompts.case(F.col("rank"), F.col("key_text"), F.col("target")).alias("c"))
        s = s.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "c"))), lambda x: x["c"]).alias("_cases"))
        d = d.join(s, F.col("sample_id") == F.col("query_id"), "left")
        cases = prompts.cases(F.coalesce("_cases", F.array().cast("array<string>")))
    now = prompts.current(F.col("input_text"), F.col("key_text"), F.col("target_time"))
    return d.withColumn("prompt", prompts.prompt(prompts.body(source, now, past, cases), kind, n)).select(*samples.columns, "prompt")


def inference(samples: DataFrame, candidates: DataFrame, kind: str, source: str = "current", histories: DataFrame | None = None, similar: DataFrame | None = None, keep: int | None = None, generator: Generator | None = None, n: int = 10) -> DataFrame:
    """Prompts, answers and what is parsed from them. candidates: (sample_id, candidates) in the ranker's order."""
    d = prompted(samples, kind, source, histories, similar, keep, n).join(candidates, "sample_id", "left")
    d = d.select("sample_id", "target", "prompt", F.coalesce("candidates", F.array().cast("array<string>")).alias("candidates"))
    return generated(d, "prompt", "candidates", n, generator).withColumn("parsed_predictions", sid.predictions(F.col("prediction"), kind))


def replay(samples: DataFrame, answers: DataFrame, sample_id: str | None = None, row_index: int | None = None) -> DataFrame:
    """One RL sample with its answer and all parts of its reward; by id, or by its place in id order."""
    from ..functions import reward

    if sample_id is None:
        one = base.positions(samples, [F.col("sample_id")], "_k").where(F.col("_k") == (row_index or 0) + 1).drop("_k")
    else:
        one = samples.where(F.col("sample_id") == sample_id)
    d = one.join(answers.select("sample_id", "prediction"), "sample_id")
    return d.withColumn("reward", reward.parts(F.col("prediction"), F.col("ground_truth")))


def inspect_encoder(bank_rows: DataFrame, n: int = 2, encoder: TextEncoder | None = None) -> DataFrame:
    """Health of the vectors of the first few texts of a bank; the limit is what is asked for."""
    from ..functions import vector

    few = encoded(bank_rows.select("sample_id", "key_text").orderBy("sample_id").limit(n), "key_text", encoder)
    return few.select("sample_id", vector.health(F.col("vec")).alias("health"), vector.norm(F.col("vec")).alias("norm"))
