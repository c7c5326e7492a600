"""Queries of retrieval, evaluation, rewards and traces."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import prompts, reward, sid, vector
from ..operators import ranking, semantic, traces
from ..session import cut, shared_dir
from ..sources import documents, files
from ..sources.adapters import CHECKINS_SQL, SIDS_SQL, checkins, sids, table
from ..streaming import steps
from . import runs

from .meaning import _ROWS, _PROTO, rows

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


_UNIT = "u AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE / n) AS vec FROM (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings))"
_TOPK = f"""{_UNIT}, qq AS (SELECT id, vec, TIMESTAMP '2024-01-01' + to_hours(((id * 37) % 400)::INTEGER) AS tm FROM u WHERE id % 100 = 0), kk AS (SELECT id, vec, TIMESTAMP '2024-01-01' + to_hours(((id * 37) % 400)::INTEGER) AS tm FROM u),
sc AS (SELECT q.id AS query_id, k.id AS key_id, round(list_dot_product(q.vec, k.vec), 9) AS score FROM qq q JOIN kk k ON k.tm < q.tm AND q.id <> k.id),
tk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key_id)::INTEGER AS rank FROM sc) WHERE rank <= 5)"""


def similar(spark, sf_dir) -> DataFrame:
    """The vectors whose number is divisible by 100 as queries against all vectors, by a made-up time."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), vector.unit(F.col("embedding").cast("array<double>")).alias("vec"))
    e = e.withColumn("time", F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=((F.col("id") * 37) % 400).cast("int")))
    return ranking.causal_topk(e.where("id % 100 = 0"), e, 5)


@query(f"WITH {_TOPK} SELECT query_id, key_id, round(score, 6) AS score, rank FROM tk")
def causal_similarity(spark, sf_dir):
    return similar(spark, sf_dir).withColumn("score", F.round("score", 6))


@query(f"WITH {_TOPK} SELECT query_id, 'Retrieved similar cases:' || chr(10) || string_agg('Case ' || rank || ':' || chr(10) || 'Trajectory: vector ' || key_id || chr(10) || 'Next POI: <' || (key_id % 100) || '>', chr(10) || chr(10) ORDER BY rank) AS block FROM tk JOIN u ON u.id = key_id WHERE rank <= 3 AND label <> 3 GROUP BY query_id")
def retrieved_cases(spark, sf_dir):
    """The first three neighbours, with their ranks; those that the bank lacks (label 3) leave gaps."""
    key = F.col("vec_id")
    bank = table(spark, sf_dir, "embeddings").where("label <> 3").select(key.alias("sample_id"), F.lit("id").alias("repr"), F.concat(F.lit("vector "), key.cast("string")).alias("key_text"), sid.place_token(key % 100).alias("target"))
    s = runs.neighbour_rows(similar(spark, sf_dir), bank, "id", 3)
    case = prompts.case(F.col("rank"), F.col("key_text"), F.col("target"))
    g = s.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", case.alias("c")))), lambda x: x["c"]).alias("cs"))
    return g.select("query_id", prompts.cases(F.col("cs")).alias("block"))


@query(f"WITH {CHECKINS_SQL}, {SIDS_SQL} SELECT DISTINCT sid_token AS target FROM c JOIN s USING (pid) WHERE uid % 3 < 2")
def candidate_space(spark, sf_dir):
    """The distinct targets of the bank's rows of one representation, whatever their split."""
    d = checkins(spark, sf_dir).join(semantic.with_suffix(sids(spark, sf_dir)).select("pid", "sid_token"), "pid")
    kind = F.when(F.col("uid") % 3 < 2, "sid").otherwise("id")
    bank = d.select(F.when(kind == "id", sid.place_token(F.col("pid"))).otherwise(F.col("sid_token")).alias("target"), kind.alias("repr"), F.when(F.col("uid") % 2 == 0, "train").otherwise("test").alias("split"))
    return runs.candidate_space(bank, "sid")


_MORE = " || ".join(f"' <a_9><b_9><c_{j}>'" + (" || CASE WHEN doc_id % 22 = 0 THEN ' ' || truth ELSE '' END" if j == 3 else "") for j in range(1, 10))
_PRED = f"""pd00 AS (SELECT doc_id, '<a_' || doc_id % 2 || '><b_' || doc_id % 3 || '><c_' || doc_id % 2 || '>' AS truth, n_chars FROM documents),
pd0 AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'no idea' ELSE CASE WHEN doc_id % 5 = 0 THEN '' ELSE '<think>x</think> ' END || '<a_' || doc_id % 4 || '><b_' || doc_id % 3 || '><c_' || doc_id % 5 || '> <a_' || doc_id % 3 || '><b_1><c_2>' || CASE WHEN doc_id % 7 = 0 THEN chr(10) ELSE ' ' END || '<a_' || doc_id % 2 || '><b_0><c_1><d_' || doc_id % 2 || '> <a_9'
    || CASE WHEN doc_id % 11 = 0 THEN {_MORE} ELSE '' END END AS answer, truth, n_chars FROM pd00)"""


def answers(spark, sf_dir) -> DataFrame:
    """Made-up answers and truths from the documents' numbers: most of three predictions, some of none, some of more than ten."""
    n = lambda k: (F.col("doc_id") % k).cast("string")
    s = F.lit
    truth = F.concat(s("<a_"), n(2), s("><b_"), n(3), s("><c_"), n(2), s(">"))
    more = F.concat(*[F.concat(s(f" <a_9><b_9><c_{j}>"), F.when((F.col("doc_id") % 22 == 0) & s(j == 3), F.concat(s(" "), truth)).otherwise(s(""))) for j in range(1, 10)])
    ans = F.concat(
        F.when(F.col("doc_id") % 5 == 0, s("")).otherwise(s("<think>x</think> ")), s("<a_"), n(4), s("><b_"), n(3), s("><c_"), n(5), s("> <a_"), n(3), s("><b_1><c_2>"),
        F.when(F.col("doc_id") % 7 == 0, s("\n")).otherwise(s(" ")), s("<a_"), n(2), s("><b_0><c_1><d_"), n(2), s("> <a_9"), F.when(F.col("doc_id") % 11 == 0, more).otherwise(s("")),
    )
    ans = F.when(F.col("doc_id") % 13 == 0, s("no idea")).otherwise(ans)
    return table(spark, sf_dir, "documents").select("doc_id", ans.alias("answer"), truth.alias("truth"), "n_chars")


_EXTRA = "list_concat(list_concat(['<a_9><b_9><c_1>', '<a_9><b_9><c_2>', '<a_9><b_9><c_3>'], CASE WHEN doc_id % 22 = 0 THEN [truth] ELSE [] END), ['<a_9><b_9><c_4>', '<a_9><b_9><c_5>', '<a_9><b_9><c_6>', '<a_9><b_9><c_7>', '<a_9><b_9><c_8>', '<a_9><b_9><c_9>'])"
_PARSE = rf"""pp AS (SELECT doc_id, answer, truth, n_chars, CASE WHEN doc_id % 7 = 0 AND doc_id % 13 <> 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS one, '<a_' || doc_id % 4 || '><b_' || doc_id % 3 || '><c_' || doc_id % 5 || '>' AS x1, '<a_' || doc_id % 3 || '><b_1><c_2>' AS x2, '<a_' || doc_id % 2 || '><b_0><c_1><d_' || doc_id % 2 || '>' AS x3 FROM pd0),
pq0 AS (SELECT *, CASE WHEN x1 = x2 THEN [x1, x3] ELSE [x1, x2, x3] END AS base, {_EXTRA} AS extra FROM pp),
pq AS (SELECT * EXCLUDE (base, extra), CASE WHEN doc_id % 13 = 0 THEN []::VARCHAR[] WHEN doc_id % 11 = 0 THEN list_slice(list_concat(base, list_filter(extra, lambda x: NOT list_contains(base, x))), 1, 10) ELSE base END AS ps FROM pq0),
dp AS (SELECT doc_id, sum(CASE WHEN p3 = truth THEN 3 WHEN p2 = t2 THEN 2 WHEN p1 = t1 THEN 1 ELSE 0 END) AS depth FROM (SELECT doc_id, truth, regexp_extract(truth, '^<a_\d+>') AS t1, regexp_extract(truth, '^<a_\d+><b_\d+>') AS t2, regexp_extract(x, '^<a_\d+>') AS p1, regexp_extract(x, '^<a_\d+><b_\d+>') AS p2, regexp_extract(x, '^<a_\d+><b_\d+><c_\d+>') AS p3 FROM (SELECT doc_id, truth, unnest(ps) AS x FROM pq)) GROUP BY doc_id),
rw AS (SELECT pq.*, coalesce(list_position(ps, truth), 0) AS rank, len(ps) AS n, coalesce(depth, 0) AS depth FROM pq LEFT JOIN dp USING (doc_id)),
rr AS (SELECT doc_id, n::INTEGER AS parsed, nullif(rank, 0)::INTEGER AS rank, one, n_chars, 0.5 * 0.2 * one + 0.5 * 0.5 * n / 10 + CASE WHEN n = 10 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN rank > 0 THEN 1.0::DOUBLE / rank * (1 + (10 - rank) / 10.0::DOUBLE) + 1.0::DOUBLE ELSE 0 END + 0.2::DOUBLE * depth / 30 + 0.1::DOUBLE * n / 10 AS total FROM rw)"""


@query(f"WITH {_PRED}, {_PARSE} SELECT doc_id, parsed, coalesce(rank, 0)::INTEGER AS rank, one AS single_line, round(total::DOUBLE, 9) AS total FROM rr")
def reward_scores(spark, sf_dir):
    d = answers(spark, sf_dir).withColumn("r", reward.parts(F.col("answer"), F.col("truth")))
    return d.select("doc_id", F.col("r.parsed_prediction_count").alias("parsed"), F.coalesce("r.rank", F.lit(0)).alias("rank"), F.col("r.single_line_score").alias("single_line"), F.round("r.total_reward", 9).alias("total"))


@query(f"WITH {_PRED}, {_PARSE} SELECT count(*)::BIGINT AS num_samples, " + ", ".join(f"round(avg(CASE WHEN rank BETWEEN 1 AND {k} THEN 1.0::DOUBLE ELSE 0 END), 9) AS acc{k}" for k in (1, 5, 10)) + ", round(avg(all_::DOUBLE), 9) AS mean_parsed, round(avg((all_ = 10)::INTEGER), 9) AS exact_ten_rate FROM rr JOIN (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 0 WHEN doc_id % 11 = 0 THEN len(base) + len(list_filter(extra, lambda x: NOT list_contains(base, x))) ELSE len(base) END AS all_ FROM pq0) USING (doc_id)")
def ranking_accuracy(spark, sf_dir):
    d = answers(spark, sf_dir).select(F.col("answer").alias("prediction"), F.array().cast("array<string>").alias("parsed_predictions"), F.col("truth").alias("target"), F.lit("p").alias("prompt"))
    m = ranking.accuracy(d)
    return m.select("num_samples", *[F.round(c, 9).alias(c) for c in ("acc1", "acc5", "acc10", "mean_parsed", "exact_ten_rate")])


@query(f"WITH {_PRED}, {_PARSE}, m AS (SELECT avg(CASE WHEN rank = 1 THEN 1.0::DOUBLE ELSE 0 END) AS a1, avg(CASE WHEN rank BETWEEN 1 AND 5 THEN 1.0::DOUBLE ELSE 0 END) AS a5, avg(CASE WHEN rank BETWEEN 1 AND 10 THEN 1.0::DOUBLE ELSE 0 END) AS a10, avg((all_ = 10)::INTEGER) AS x, count(*) AS n FROM rr JOIN (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 0 WHEN doc_id % 11 = 0 THEN len(base) + len(list_filter(extra, lambda x: NOT list_contains(base, x))) ELSE len(base) END AS all_ FROM pq0) USING (doc_id)) SELECT k, line FROM (VALUES " + ", ".join(f"({k}, '{line}')" for k, line in enumerate(files.SUMMARY_HEAD)) + ") AS h(k, line) UNION ALL SELECT 4, printf('| demo | sid | - | %d | %.4f | %.4f | %.4f | 1.0 | %.4f |', n, a1, a5, a10, x) FROM m")
def markdown_summary(spark, sf_dir):
    d = answers(spark, sf_dir).select(F.col("answer").alias("prediction"), F.array().cast("array<string>").alias("parsed_predictions"), F.col("truth").alias("target"), F.lit("p").alias("prompt"))
    return files.summary_lines(ranking.accuracy(d).withColumns({"run": F.lit("demo"), "repr": F.lit("sid")}))


@query(f"WITH {_PRED}, {_PARSE}, m AS (SELECT doc_id % 3 AS run, avg(CASE WHEN rank = 1 THEN 1.0::DOUBLE ELSE 0 END) AS a1, avg(CASE WHEN rank BETWEEN 1 AND 5 THEN 1.0::DOUBLE ELSE 0 END) AS a5, avg(CASE WHEN rank BETWEEN 1 AND 10 THEN 1.0::DOUBLE ELSE 0 END) AS a10, avg((all_ = 10)::INTEGER) AS x, count(*) AS n FROM rr JOIN (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 0 WHEN doc_id % 11 = 0 THEN len(base) + len(list_filter(extra, lambda x: NOT list_contains(base, x))) ELSE len(base) END AS all_ FROM pq0) USING (doc_id) GROUP BY 1) SELECT k::BIGINT AS k, line FROM (VALUES " + ", ".join(f"({k}, '{line}')" for k, line in enumerate(files.SUMMARY_HEAD)) + ") AS h(k, line) UNION ALL SELECT 4 + run, printf('| run%d | sid | current | %d | %.4f | %.4f | %.4f | %.1f | %.4f |', run, n, a1, a5, a10, (run + 1)::DOUBLE, x) FROM m")
def evaluation_summary(spark, sf_dir):
    """Three runs' predictions, written with their metadata, evaluated from there, and summed up from what the evaluations have written."""
    base = f"{shared_dir(spark)}/runs-{uuid.uuid4().hex}"
    d = answers(spark, sf_dir).select((F.col("doc_id") % 3).alias("run"), F.col("answer").alias("prediction"), F.array().cast("array<string>").alias("parsed_predictions"), F.col("truth").alias("target"))
    for k in range(3):
        path = f"{base}/predictions/run{k}.jsonl"
        files.write_jsonl(d.where(F.col("run") == k).drop("run").withColumn("prompt", F.lit("p" * (k + 1))), path)
        files.write_json(runs.metadata_path(path), {"repr": "sid", "history_source": "current"})
        runs.run_evaluation(spark, path, f"{base}/eval/run{k}.json")
    files.summarise(spark, f"{base}/eval", f"{base}/summary.md")
    lines = documents.read(f"{base}/summary.md", spark).rstrip("\n").split("\n")
    return spark.createDataFrame(list(enumerate(lines)), "k bigint, line string")


@query(f"WITH {_PRED}, {_PARSE} SELECT doc_id, array_to_string(CASE WHEN doc_id % 11 = 0 AND doc_id % 13 <> 0 THEN list_concat(base, list_filter(extra, lambda x: NOT list_contains(base, x))) ELSE ps END, ' ') AS parsed, rank = 1 AS top1_correct, rank BETWEEN 1 AND 5 AS top5_correct, rank BETWEEN 1 AND 10 AS top10_correct FROM rw JOIN (SELECT doc_id, base, extra FROM pq0) USING (doc_id)")
def evaluated_rows(spark, sf_dir):
    """The rows of an evaluation, with what was parsed from them."""
    d = answers(spark, sf_dir).select("doc_id", F.col("answer").alias("prediction"), F.col("truth").alias("target"), F.lit("sid").alias("repr"))
    return ranking.enriched(d).select("doc_id", F.array_join("parsed_predictions", " ").alias("parsed"), *[f"top{k}_correct" for k in (1, 5, 10)])


@query(f"WITH {_PRED}, {_PARSE} SELECT doc_id, round(total::DOUBLE, 9) AS reward FROM rr")
def reward_batch(spark, sf_dir):
    """The registered reward over a batch of answers."""
    d = reward.scored(answers(spark, sf_dir), "answer", "truth")
    return d.select("doc_id", F.round("reward", 9).alias("reward"))


_PE = f"""WITH {_ROWS}, {_PROTO}, x0 AS (SELECT full_sid, sr.pid, pr.profile_json AS output, sr.pid % 4 AS k, pr.category AS oc, pr.region AS ore, pr.geo_bucket AS og, CASE WHEN sr.pid % 4 = 2 THEN '99' ELSE pr.region END AS pre FROM sr JOIN pr ON pr.level = 'abc' AND pr.prefix = sr.abc),
x AS (SELECT *, k > 0 AS ok, k > 0 AND pre = ore AS rok, CASE WHEN k = 2 THEN true WHEN k > 0 THEN NOT regexp_full_match(pre, '-?[0-9]+') END AS quoted FROM x0)"""


@query(f"""{_PE} SELECT count(*)::BIGINT AS num_samples, avg(ok::INTEGER) AS valid_rate, avg(ok::INTEGER) AS category_rate, avg(rok::INTEGER) AS region_rate, avg(ok::INTEGER) AS geo_bucket_rate, avg(rok::INTEGER) AS joint_rate,
count(DISTINCT CASE WHEN ok THEN row(oc, pre, og, quoted) END)::BIGINT AS unique_profiles, (SELECT max(n) FROM (SELECT count(*) AS n FROM x WHERE ok GROUP BY oc))::DOUBLE / count(*) AS dominant_category_share, (SELECT max(n) FROM (SELECT count(*) AS n FROM x WHERE ok GROUP BY pre))::DOUBLE / count(*) AS dominant_region_share FROM x""")
def profile_evaluation(spark, sf_dir):
    """Answers by place number: junk, the right profile, one with another region, and the right one with blanks in its JSON."""
    d = rows(spark, sf_dir)
    p = semantic.prototypes(d).where("level = 'abc'").select(F.col("prefix").alias("_p"), F.col("category").alias("_c"), F.col("geo_bucket").alias("_g"), F.col("profile_json").alias("output"))
    wrong = F.concat(F.lit('{"category":"'), "_c", F.lit('","region":"99","geo_bucket":"'), "_g", F.lit('"}'))
    k = F.col("pid") % 4
    blanks = F.regexp_replace(F.regexp_replace("output", '":', '" : '), ',"', ' , "')
    x = d.join(p, F.col("abc") == F.col("_p")).withColumn("prediction", F.when(k == 0, "junk").when(k == 1, F.col("output")).when(k == 2, wrong).otherwise(blanks))
    return ranking.profile_eval(x)


@query(f"WITH {CHECKINS_SQL}, {SIDS_SQL} SELECT count(*)::BIGINT AS num_samples, 1.0::DOUBLE AS valid_prefix_rate, avg((pid % 2)::DOUBLE) AS exact_match_rate FROM s")
def prefix_evaluation(spark, sf_dir):
    d = semantic.with_suffix(sids(spark, sf_dir)).withColumn("abc", sid.prefix(F.col("sid_token"), "abc"))
    said = F.when(F.col("pid") % 2 == 1, F.col("abc")).otherwise(F.lit("<a_90><b_90><c_90>"))
    x = d.select(F.concat(F.lit("answer: "), said).alias("prediction"), F.col("abc").alias("output"), F.array("abc", F.lit("<a_90><b_90><c_90>")).alias("candidate_prefixes"))
    return ranking.prefix_eval(x, "abc")


_TRACE = f"{_PRED}, {_PARSE}, tr AS (SELECT doc_id, (doc_id * 7919) % 100003 AS time_ns, doc_id % 4 AS pid, parsed, one, total::DOUBLE AS total, CASE WHEN rank IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS hit, row_number() OVER (ORDER BY (doc_id * 7919) % 100003, doc_id % 4, doc_id) AS position FROM rr)"


def traced(spark, sf_dir) -> DataFrame:
    d = answers(spark, sf_dir).withColumn("r", reward.parts(F.col("answer"), F.col("truth")))
    t = d.select("doc_id", ((F.col("doc_id") * 7919) % 100003).alias("time_ns"), (F.col("doc_id") % 4).alias("pid"), F.col("doc_id").alias("local_record_index"), F.when(F.col("doc_id") % 3 > 0, 8).otherwise(0).alias("group_size_hint"), "r.*")
    return traces.ordered(t)


@query(f"WITH {_TRACE} SELECT count(*)::BIGINT AS trace_row_count, round(avg(total), 9) AS mean_total_reward, round(avg(parsed::DOUBLE), 9) AS mean_parsed_prediction_count, round(avg(one), 9) AS single_line_rate, round(avg((parsed = 0)::INTEGER), 9) AS zero_prediction_rate FROM tr")
def trace_summary(spark, sf_dir):
    s = traces.summary(traced(spark, sf_dir))
    return s.select("trace_row_count", *[F.round(c, 9).alias(c) for c in ("mean_total_reward", "mean_parsed_prediction_count", "single_line_rate", "zero_prediction_rate")])


@query(f"WITH {_TRACE} SELECT parsed::BIGINT AS parsed, count(*)::BIGINT AS n FROM tr GROUP BY 1")
def trace_histogram(spark, sf_dir):
    return traces.histogram(traced(spark, sf_dir))


@query(rf"WITH {_TRACE}, g0 AS (SELECT doc_id, trim(regexp_replace(answer, '\s+', ' ', 'g')) AS a FROM pd0), g AS (SELECT CASE WHEN length(a) > 240 THEN substr(a, 1, 237) || '...' ELSE a END AS solution_preview, tr.* FROM tr JOIN g0 USING (doc_id)) SELECT solution_preview, count(*)::BIGINT AS n, round(avg(total), 9) AS mean_total_reward FROM g GROUP BY 1 ORDER BY count(*) DESC, min(position) LIMIT 10")
def trace_previews(spark, sf_dir):
    return traces.top_previews(traced(spark, sf_dir)).select("solution_preview", "n", F.round("mean_total_reward", 9).alias("mean_total_reward"))


@query(f"WITH {_TRACE} SELECT count(*)::BIGINT AS n, round(avg((one > 0.5)::INTEGER), 9) AS single_line_rate, " + ", ".join(f"round(coalesce(avg(CASE WHEN {w} THEN {c}::DOUBLE END), 0), 9) AS {s}_{x}" for s, w in (("single", "one > 0.5"), ("multi", "one <= 0.5")) for c, x in (("total", "total_reward"), ("parsed", "parsed_prediction_count"), ("hit", "hit"))) + " FROM tr")
def single_line_split(spark, sf_dir):
    s = traces.single_line(traced(spark, sf_dir))
    return s.select("n", *[F.round(c, 9).alias(c) for c in s.columns if c != "n"])


@query(f"WITH {_TRACE}, st AS (SELECT ((position - 1) // 8 + 1)::BIGINT AS step, count(*) AS n, sum(total) AS s FROM tr GROUP BY 1) SELECT step, n::BIGINT AS n, (sum(n) OVER w)::BIGINT AS rows_so_far, round(s, 6) AS total_reward_sum, round(s / n, 6) AS total_reward_mean, round(sum(s) OVER w, 6) AS total_reward_cum, round(sum(s) OVER w / sum(n) OVER w, 6) AS total_reward_cum_mean FROM st WINDOW w AS (ORDER BY step)")
def trace_steps(spark, sf_dir):
    t = traced(spark, sf_dir)
    s = traces.steps(t, traces.group_size(t))
    return s.select("step", "n", F.col("rows_so_far").cast("bigint").alias("rows_so_far"), *[F.round(c, 6).alias(c) for c in s.columns if c.startswith("total_")])


@query(f"WITH {_TRACE}, o AS (SELECT doc_id % 3 AS run, total, row_number() OVER (PARTITION BY doc_id % 3 ORDER BY time_ns, pid, doc_id) AS place FROM tr), st AS (SELECT run, ((place - 1) // 8 + 1)::BIGINT AS step, count(*) AS n, sum(total) AS s FROM o GROUP BY 1, 2) SELECT run::VARCHAR AS run, step, n::BIGINT AS n, (sum(n) OVER w)::BIGINT AS rows_so_far, round(s, 6) AS total_reward_sum, round(s / n, 6) AS total_reward_mean, round(sum(s) OVER w, 6) AS total_reward_cum, round(sum(s) OVER w / sum(n) OVER w, 6) AS total_reward_cum_mean FROM st WINDOW w AS (PARTITION BY run ORDER BY step)")
def streamed_steps(spark, sf_dir):
    """Traces of three runs that come in four instalments, each taken up by a stream that starts again from its checkpoint."""
    t = cut(traced(spark, sf_dir).withColumn("run", (F.col("doc_id") % 3).cast("string")).select("run", "time_ns", "pid", "local_record_index", "total_reward"))
    base = f"{shared_dir(spark)}/steps-{uuid.uuid4().hex}"
    for k in range(4):
        t.where(F.floor(F.col("time_ns") / 25_001) == k).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1 << 20).parquet(f"{base}/in")
        steps.start(steps.step_stream(stream, 8), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    s = steps.latest(spark.read.parquet(f"{base}/out"))
    return s.select("run", "step", "n", "rows_so_far", *[F.round(c, 6).alias(c) for c in s.columns if c.startswith("total_")])


@query(f"WITH {_TRACE}, m AS (SELECT count(*) AS total_, greatest(ceil(count(*) / 20.0::DOUBLE), 1) AS b FROM tr) SELECT max(position)::BIGINT AS position, round(avg(total), 6) AS total_reward FROM tr, m GROUP BY floor((position - 1) / b)")
def trace_downsample(spark, sf_dir):
    t = traced(spark, sf_dir).withColumn("i", F.col("position") - 1)
    return traces.downsampled(t, 20, "i", "position", ("total_reward",)).withColumn("total_reward", F.round("total_reward", 6))


@query(f"WITH {_TRACE} SELECT doc_id, round(0.1 * one, 9)::DOUBLE AS single_line_reward, round(0.25::DOUBLE * (parsed / 10.0::DOUBLE), 9) AS valid_count_reward, CASE WHEN parsed = 10 THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END AS exact_ten_reward FROM tr")
def trace_backfill(spark, sf_dir):
    t = traced(spark, sf_dir).drop("single_line_reward", "valid_count_reward", "exact_ten_reward")
    b = traces.backfilled(t)
    return b.select("doc_id", *[F.round(c, 9).alias(c) for c in ("single_line_reward", "valid_count_reward", "exact_ten_reward")])
