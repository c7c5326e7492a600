"""Runs over whole data sets: prepared samples, warm-up and chat builds, evaluations, exports; frames by name, and their sinks."""

from __future__ import annotations

import json
import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import profile, prompts, sid
from ..models import Generator, generated
from ..operators import base, decoding, places, ranking, semantic, sequences
from ..session import BuildConfig, cut
from ..sources import documents, files
from . import builders

SPLITS = ("train", "val", "test")
SOURCES = ("current", "original")
LEAST_SPACE = 10
#: Candidates that go to each task as one list; more are chosen from list by list, and then from the lists' winners.
MOST_CANDIDATES = 200_000
#: Answers of a decoder to one sample.
ANSWERS = 10
# Evaluation tasks by name, with the record's task and the level of its prefixes.
TASKS = {"sid_to_abc_profile": ("full_sid_to_abc_profile", "abc"), "abc_profile_to_a": ("category_profile_to_a", "a"), "abc_profile_to_ab": ("category_region_profile_to_ab", "ab"), "abc_profile_to_abc": ("abc_profile_to_abc", "abc")}


def prepared(windows: dict[str, DataFrame], current_k: int, sids: DataFrame | None = None, histories: dict[str, DataFrame] | None = None) -> dict[tuple[str, ...], DataFrame]:
    """Samples by (repr, split) and supervised rows by (repr, split, source); without a SID map there is no `sid`.

    windows: by split; histories: (uid, history) by repr, for the source `original`; a user without one gets the default text.
    """
    from .builders import supervised

    out: dict[tuple[str, ...], DataFrame] = {}
    for split in (s for s in SPLITS if s in windows):
        w = cut(sequences.indexed(windows[split]))
        for kind in ("id", "sid") if sids is not None else ("id",):
            d = w if kind == "id" else sequences.with_tokens(w, sids)
            rows = cut(sequences.sample_rows(d, F.lit(split), F.col("row_index"), kind, current_k, *(() if kind == "id" else (F.col("tokens"), F.col("goal")))))
            out[kind, split] = rows
            past = (histories or {}).get(kind)
            for source in SOURCES:
                own = past if past is not None else rows.select("uid", F.lit(None).cast("string").alias("history")).limit(0)
                out[kind, split, source] = supervised(rows, source, own)
    return out


def write_tables(tables: dict[str, DataFrame], base: str, config: BuildConfig | None = None, csv: bool = False) -> dict:
    """Writes each frame as Parquet under its name, CSV beside it if asked (arrays and maps as JSON), and the manifest; returns that."""
    counts = {}
    for name, d in tables.items():
        path = f"{base.rstrip('/')}/{name}"
        d.write.mode("overwrite").parquet(path)
        back = d.sparkSession.read.parquet(path)
        counts[name] = back.count()  # from the files' footers
        if csv:
            flat = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in back.dtypes]
            back.select(*flat).write.mode("overwrite").option("header", "true").option("escape", '"').csv(f"{path}_csv")
    manifest = {"rows": counts, "config": vars(config or BuildConfig())}
    line = json.dumps(manifest, ensure_ascii=False)
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{base.rstrip('/')}/manifest")
    return manifest


def sid_space(sids: DataFrame) -> DataFrame:
    """(sid): the distinct tokens; fewer than ten are an error."""
    d = sids.select(F.col("sid_token").alias("sid")).where("sid is not null").distinct()
    if d.limit(LEAST_SPACE).count() < LEAST_SPACE:
        raise ValueError(f"the candidate space has fewer than {LEAST_SPACE} semantic IDs")
    return d


def bank_rows(bank: DataFrame, split: str | None = None, kind: str | None = None) -> DataFrame:
    """The bank's rows, or samples, of a split and a representation."""
    d = bank if split is None else bank.where(F.col("split") == split)
    return d if kind is None else d.where(F.col("repr") == kind)


def bank_map(bank: DataFrame, kind: str) -> DataFrame:
    """(sample_id, row): the bank's rows of a representation by their id; of rows that share one the greatest."""
    d = bank_rows(bank, kind=kind)
    return d.groupBy("sample_id").agg(F.max(F.struct(*[F.col(f"`{c}`") for c in d.columns])).alias("row"))


def neighbour_rows(similar: DataFrame, bank: DataFrame, kind: str, k: int) -> DataFrame:
    """(query_id, rank, key_text, target) of the first k neighbours, by rank; those that the bank lacks are missing, and none takes their place."""
    rows = bank_map(bank, kind).select(F.col("sample_id").alias("key_id"), F.col("row.key_text").alias("key_text"), F.col("row.target").alias("target"))
    return similar.where(F.col("rank") <= k).join(rows, "key_id").select("query_id", "rank", "key_text", "target")


def candidate_space(bank: DataFrame, kind: str) -> DataFrame:
    """(target) in order: what the rows of a representation aim at, in all splits."""
    return bank_rows(bank, kind=kind).select("target").where("target is not null").distinct().orderBy("target")


def warmup_build(train: DataFrame, valid: DataFrame, sids: DataFrame, source: str = "current") -> tuple[dict[str, DataFrame], dict]:
    """Warm-up rows of both splits, ranked by the counts of training targets alone, and their manifest."""
    from .builders import warmup

    if source != "current":
        raise ValueError("warm-up rows know the source `current` only")
    n = train.groupBy(F.col("target").alias("_t")).agg(F.count(F.lit(1)).alias("n"))
    space = cut(sid_space(sids).join(n, F.col("sid") == F.col("_t"), "left").select("sid", F.coalesce("n", F.lit(0)).alias("n")))
    out = {"train": cut(warmup(train, space)), "valid": cut(warmup(valid, space))}
    return out, {"repr": "sid", "history_source": source, "prompt_template_version": prompts.VERSION, "num_train": out["train"].count(), "num_valid": out["valid"].count(), "sid_space_size": space.count()}


def chat_build(train: DataFrame, valid: DataFrame, data_source: str = "next_poi", ability: str = "next_poi_prediction") -> tuple[dict[str, DataFrame], dict]:
    """Chat rows of both splits and their manifest."""
    from .builders import chat

    out = {"train": cut(chat(train, data_source, ability)), "valid": cut(chat(valid, data_source, ability))}
    return out, {"repr": "sid", "history_source": "current", "data_source": data_source, "ability": ability, "prompt_template_version": prompts.VERSION, "num_train": out["train"].count(), "num_valid": out["valid"].count()}


def checked_similar_map(bank: DataFrame, split: str, kind: str, k: int = 35, encoder=None) -> DataFrame:
    """The similar map of a representation; no training rows, no rows of the split, or scores that are all zero are errors."""
    from .builders import similar_map

    own = cut(bank_rows(bank, kind=kind))
    for s in ("train", split):
        if not own.where(F.col("split") == s).limit(1).count():
            raise ValueError(f"the bank has no {s} rows of {kind}")
    out = cut(similar_map(own, split, k, encoder))
    if out.limit(1).count() and not out.where("score <> 0").limit(1).count():
        raise ValueError("all similarity scores are zero")
    return out


def popular_candidates(samples: DataFrame, train: DataFrame, n: int = 20) -> DataFrame:
    """(sample_id, candidates): what followed a sample's last place in training, then the most visited places; as place tokens.

    samples: (sample_id, observed_pids); train: (uid, pid, time_dt, seq). What a generator without a model answers from.
    """
    from pyspark.sql import Window

    near = places.neighbours(train, True).where(F.col("rank") <= n).select(F.col("pid").alias("_a"), F.col("neighbour").alias("b"), F.col("rank").alias("o"))
    popular = train.groupBy("pid").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "pid").limit(n)
    popular = popular.select(F.col("pid").alias("b"), (F.row_number().over(Window.orderBy(F.col("n").desc(), "pid")) + n).alias("o"))  # n rows
    t = samples.select("sample_id", F.try_element_at("observed_pids", F.lit(-1)).alias("_last"))
    every = t.join(near, F.col("_last") == F.col("_a")).select("sample_id", "b", "o").unionByName(t.crossJoin(F.broadcast(popular)).select("sample_id", "b", "o"))
    best = F.array_sort(F.collect_list(F.struct("o", "b")))
    return every.groupBy("sample_id", "b").agg(F.min("o").alias("o")).groupBy("sample_id").agg(F.slice(F.transform(best, lambda x: sid.place_token(x["b"])), 1, n).alias("candidates"))


METRICS = {"num_samples": "num_samples", "acc1": "acc_at_1", "acc5": "acc_at_5", "acc10": "acc_at_10", "correct1": "correct_at_1", "correct5": "correct_at_5", "correct10": "correct_at_10", "mean_prompt_length": "avg_prompt_char_length", "mean_parsed": "avg_parsed_prediction_count", "exact_ten_rate": "exact_10_prediction_rate"}


def evaluation(predictions: DataFrame, kind: str = "sid", metadata: dict | None = None) -> tuple[dict, DataFrame]:
    """({metadata, metrics}, the rows with what was parsed and which cut-offs hold the target)."""
    m = ranking.accuracy(predictions, kind).first().asDict()
    return {"metadata": metadata or {}, "metrics": {name: m[c] for c, name in METRICS.items()}}, ranking.enriched(predictions, kind)


def evaluation_path(predictions_path: str, metadata: dict) -> str:
    """Where an evaluation goes by default: in eval/ beside the folder of the predictions, named by representation and history."""
    up = os.path.dirname(os.path.dirname(predictions_path))
    return os.path.join(up, "eval", f"eval_{metadata.get('repr', 'repr')}_{metadata.get('history_source', 'history')}.json")


def run_evaluation(spark, predictions_path: str, output_path: str | None = None, kind: str = "sid") -> dict:
    """Evaluates a predictions file: the metrics become a JSON document, the rows JSON lines in a folder beside it."""
    metadata = {}
    if predictions_path.endswith(".jsonl"):
        beside = metadata_path(predictions_path)
        metadata = files.read_json(beside) if documents.exists(beside, spark) else {}
    else:
        whole = spark.read.option("multiLine", "true").json(predictions_path)
        if "metadata" in whole.columns and "samples" in whole.columns:
            metadata = whole.select("metadata").first()["metadata"].asDict(recursive=True)
    payload, rows = evaluation(files.read_predictions(spark, predictions_path), metadata.get("repr", kind), metadata)
    path = output_path or evaluation_path(predictions_path, metadata)
    files.write_json(path, payload)
    files.write_jsonl(rows, f"{path.removesuffix('.json')}_samples", "overwrite")
    return payload


def chosen(d: DataFrame, prompt: str, space: DataFrame, generator: Generator | None = None, most: int | None = None, out: str = "prediction") -> DataFrame:
    """Adds a generator's choice for each prompt from all candidates of a space (one column), in order.

    A list of `most` goes to each task once, in a broadcast variable. Of a larger space each list in turn has a winner, and the winners meet in
    a last list, in the order of the lists; a generator that picks the best it is shown picks the best of all.
    """
    most = most or MOST_CANDIDATES
    name = space.columns[0]
    placed = cut(base.positions(space.where(F.col(name).isNotNull()), [F.col(name)], "_k"))
    lists = max(1, -(-placed.count() // most))
    names, winners = list(d.columns), []
    for k in range(lists):
        part = placed.where(F.col("_k").between(k * most + 1, (k + 1) * most)).orderBy("_k").select(name)
        d = generated(d, prompt, [r[0] for r in part.collect()], 1, generator, f"_w{k}")  # at most `most`
        winners.append(f"_w{k}")
        d = cut(d) if lists > 1 else d
    if lists == 1:
        return d.withColumnRenamed("_w0", out)
    last = generated(d.withColumn("_candidates", F.array(*winners)), prompt, "_candidates", 1, generator, out)
    return last.select(*names, out)


def metadata_path(predictions_path: str) -> str:
    return f"{predictions_path.rstrip('/').removesuffix('.jsonl')}.metadata.json"


def run_inference(bank: DataFrame, kind: str, path: str, scorer, space: DataFrame, tokens: Callable[[Column], Column], context: str = "prompt", split: str = "test", source: str = "current", histories: DataFrame | None = None, similar: DataFrame | None = None, keep: int | None = None, limit: int | None = None, k: int = ANSWERS, width: int | None = None, metadata: dict | None = None) -> dict:
    """Decodes the samples of a split from all allowed answers and writes predictions (JSON lines, ending in .jsonl) with metadata beside them.

    scorer(vocabulary, tree): what scores a branch for a sample's `context` column; space: (target) of all answers; tokens: an answer's
    tokens as an array; limit: only the first so many samples, in the order of their ids. run_evaluation reads what this writes.
    """
    if not path.endswith(".jsonl"):
        raise ValueError(f"predictions are JSON lines, so their path ends in .jsonl: {path}")
    samples = bank_rows(bank, split, kind)
    samples = samples if limit is None else samples.orderBy("sample_id").limit(limit)
    allowed = space.select(F.col("target"), tokens(F.col("target")).alias("tokens"))
    vocabulary, tree = decoding.answers(allowed, "tokens")
    d = builders.prompted(samples, kind, source, histories, similar, keep, 1)
    d = decoding.decoded(d, context, vocabulary, tree, scorer(vocabulary, tree), k, width)
    rows = d.select(
        "sample_id", "uid", F.lit(split).alias("split"), F.lit(kind).alias("repr"), F.lit(source).alias("history_source"), "target", "target_time", F.lit(prompts.VERSION).alias("prompt_template_version"), F.lit(prompts.system(kind, 1)).alias("system_prompt"),
        "prompt", F.length("prompt").alias("prompt_char_length"), "prediction", sid.predictions(F.col("prediction"), kind).alias("parsed_predictions"),
    )
    files.write_jsonl(rows, path, "overwrite")
    told = {
        **(metadata or {}), "repr": kind, "history_source": source, "split": split, "prompt_template_version": prompts.VERSION, "top_k_retrieval": keep or (3 if source == "hybrid" else 5), "decoding_mode": "candidate_constrained_beam_search",
        "candidate_space_size": len(tree), "num_samples": bank.sparkSession.read.schema("sample_id string").json(path).count(),
    }
    files.write_json(metadata_path(path), told)
    return told


def alignment_evaluation(records: DataFrame, task: str, generator: Generator | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(metrics, rows): what a generator answers to the records of a task.

    Profiles are chosen from the outputs of all records of the task, prefixes from the record's own.
    """
    if task not in TASKS:
        raise ValueError(f"no such task: {task}")
    kind, level = TASKS[task]
    d = semantic.task_records(records, kind, limit).withColumn("prompt", prompts.alignment(F.col("instruction"), F.col("input")))
    if task == "sid_to_abc_profile":
        told = cut(chosen(d, "prompt", d.select(F.trim("output").alias("c")).distinct(), generator))
    else:
        told = cut(generated(d.withColumn("_candidates", F.col("candidate_prefixes")), "prompt", "_candidates", 1, generator).drop("_candidates"))
    if task != "sid_to_abc_profile":
        p = sid.first_prefix(F.col("prediction"), level)
        rows = told.withColumns({"parsed_prefix": p, "valid_prefix": F.coalesce(F.array_contains("candidate_prefixes", p), F.lit(False)), "is_exact_match": F.coalesce(p == F.trim("output"), F.lit(False))})
        return ranking.prefix_eval(told, level), rows
    ok = profile.valid(F.col("prediction"), "abc")
    get = lambda c, f: F.get_json_object(c, f"$.{f}")
    same = {f: ok & F.coalesce(get("prediction", f) == get("output", f), F.lit(False)) for f in profile.FIELDS["abc"]}
    rows = told.withColumns({"valid_profile": ok, **{f"{f}_match": c for f, c in same.items()}, "joint_profile_match": same["category"] & same["region"] & same["geo_bucket"]})
    return ranking.profile_eval(told), rows


def export_sids(codes: DataFrame, base: str | None = None) -> tuple[DataFrame, dict]:
    """((pid, sid_indices, sid_token, vector), stats) from (pid, indices, reconstruction); with a base, written as JSON lines and CSV."""
    out = cut(semantic.with_suffix(codes).select("pid", "sid_indices", "sid_token", F.col("reconstruction").alias("vector")))
    c = semantic.collision_rate(codes).first()
    stats = {"num_pois": c["rows"], "collision_rate_before_suffix": c["collision_rate"]}
    if base:
        files.write_jsonl(out, f"{base.rstrip('/')}/pid_to_sid", "overwrite")
        out.select("pid", F.to_json("sid_indices").alias("sid_indices"), "sid_token").write.mode("overwrite").option("header", "true").option("escape", '"').csv(f"{base.rstrip('/')}/pid_to_sid_csv")
    return out, stats
