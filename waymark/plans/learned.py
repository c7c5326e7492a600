"""Queries of balanced codes, codebook starts and constrained decoding."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sid, vector
from ..operators import balanced, decoding, seeding, semantic
from ..session import shared_dir
from ..sources import files
from ..sources.adapters import CHECKINS_SQL, SIDS_SQL, checkins, sids, table
from . import runs

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
EPSILON, ROUNDS, CODES = 0.1, 4, 16


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))


def _balanced_sql() -> str:
    steps = []
    for r in range(ROUNDS):
        before = f"p{r - 1}" if r else "(SELECT code, 0.0::DOUBLE AS p FROM b)"
        steps.append(
            f"q{r} AS (SELECT vec_id, e.code, l - p AS q FROM e JOIN {before} USING (code)), m{r} AS (SELECT vec_id, max(q) AS top FROM q{r} GROUP BY vec_id), "
            f"z{r} AS (SELECT vec_id, top + ln(sum(exp(q - top))) AS a FROM q{r} JOIN m{r} USING (vec_id) GROUP BY vec_id, top), "
            f"s{r} AS (SELECT code, ln(sum(exp(q - a)) + {balanced.LEAST}::DOUBLE) AS g FROM q{r} JOIN z{r} USING (vec_id) GROUP BY code), p{r} AS (SELECT code, p + g AS p FROM s{r} JOIN {before} USING (code))"
        )
    u = "list_transform(embedding, lambda x: x::DOUBLE / n)"
    norm = "(SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings)"
    return f"""WITH b AS (SELECT vec_id AS code, {u} AS v FROM {norm} WHERE vec_id < {CODES}), d AS (SELECT x.vec_id, code, -list_dot_product(list_transform(x.embedding, lambda y: y::DOUBLE / x.n), v) AS d FROM {norm} x, b),
c AS (SELECT (max(d) + min(d)) / 2 AS mid, (max(d) - min(d)) / 2 + 1e-5::DOUBLE AS half FROM d), e AS (SELECT vec_id, code, -((d - mid) / half) / ({EPSILON}::DOUBLE + {balanced.LEAST}::DOUBLE) AS l FROM d, c),
{", ".join(steps)}, w AS (SELECT vec_id, code, l - p AS q FROM e JOIN p{ROUNDS - 1} USING (code)), t AS (SELECT vec_id, max(q) AS top FROM w GROUP BY vec_id), y AS (SELECT vec_id, top, top + ln(sum(exp(q - top))) AS a FROM w JOIN t USING (vec_id) GROUP BY vec_id, top)
SELECT vec_id, code::INTEGER AS code FROM (SELECT vec_id, code, row_number() OVER (PARTITION BY vec_id ORDER BY round(q - a, 9) DESC, code) AS r FROM w JOIN y USING (vec_id)) WHERE r = 1"""


@query(_balanced_sql())
def balanced_codes(spark, sf_dir):
    """Codes of all vectors that are used alike, over a fixed codebook, after a fixed number of rounds."""
    e = _vectors(spark, sf_dir).withColumn("vec", vector.unit(F.col("vec")))
    book = np.array([r["vec"] for r in e.where(f"id < {CODES}").orderBy("id").collect()])
    return balanced.balanced(e, book, EPSILON, ROUNDS).select(F.col("id").alias("vec_id"), "code")


@query(None)
def started_codes(spark, sf_dir):
    """The k-means|| start over all vectors: how many are nearest to each first code, and how far they are."""
    e = _vectors(spark, sf_dir)
    got = seeding.nearest(e, seeding.start(e, CODES))
    return got.groupBy("code").agg(F.count(F.lit(1)).alias("vectors"), F.round(F.avg("square"), 9).alias("mean_square"))


def followed(spark, sf_dir) -> DataFrame:
    """(uid, pid, next): each check-in's place and the user's next one."""
    w = Window.partitionBy("uid").orderBy("time_dt", "seq")
    return checkins(spark, sf_dir).select("uid", "pid", "time_dt", "seq", F.lead("pid").over(w).alias("next"))


def path_counts(steps: DataFrame, tokens: DataFrame) -> dict:
    """{context: {path: n}} of (context, pid) steps, by all paths that the places' tokens begin with; a row a context and a node of the tree."""
    paths = F.transform(F.sequence(F.lit(0), F.size("tokens")), lambda n: F.slice("tokens", 1, n))
    n = steps.join(tokens, "pid").groupBy("context", "tokens").agg(F.count(F.lit(1)).alias("n")).select("context", F.explode(paths).alias("path"), "n")
    out: dict = {}
    for r in n.groupBy("context", "path").agg(F.sum("n").alias("n")).collect():
        out.setdefault(r["context"], {})[tuple(r["path"])] = r["n"]
    return out


_BEST = f"""WITH {CHECKINS_SQL}, {SIDS_SQL}, f AS (SELECT uid, pid, time_dt, seq, lead(pid) OVER (PARTITION BY uid ORDER BY time_dt, seq) AS nxt FROM c),
st AS (SELECT x.a AS context, f.nxt AS pid FROM f JOIN s x ON f.pid = x.pid WHERE f.nxt IS NOT NULL),
nodes AS (SELECT pid, sid_token, '' AS parent, a AS path FROM s UNION ALL SELECT pid, sid_token, a, ab FROM s UNION ALL SELECT pid, sid_token, ab, abc FROM s UNION ALL SELECT pid, sid_token, abc, sid_token FROM s WHERE sid_token <> abc),
kids AS (SELECT parent, count(DISTINCT path) AS k FROM nodes GROUP BY parent), own AS (SELECT context, path, count(*) AS n FROM st JOIN nodes USING (pid) GROUP BY 1, 2), top AS (SELECT context, '' AS path, count(*) AS n FROM st GROUP BY 1),
n AS (SELECT * FROM own UNION ALL SELECT * FROM top), ctx AS (SELECT DISTINCT a AS context FROM s),
sc AS (SELECT ctx.context, d.sid_token, sum(ln((coalesce(u.n, 0) + 1) / (coalesce(v.n, 0) + k))) AS score FROM ctx CROSS JOIN (SELECT DISTINCT sid_token, parent, path FROM nodes) d JOIN kids ON kids.parent = d.parent
    LEFT JOIN n u ON u.context = ctx.context AND u.path = d.path LEFT JOIN n v ON v.context = ctx.context AND v.path = d.parent GROUP BY 1, 2),
best AS (SELECT context, string_agg(sid_token, ' ' ORDER BY round(score, 9) DESC, sid_token) AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY context ORDER BY round(score, 9) DESC, sid_token) AS r FROM sc) WHERE r <= 10 GROUP BY context)"""


@query(f"{_BEST} SELECT f.uid, s.sid_token AS last, prediction FROM f JOIN s ON f.pid = s.pid JOIN best ON best.context = s.a WHERE f.nxt IS NULL")
def decoded_sids(spark, sf_dir):
    """Ten semantic IDs for what each user may visit next, by beams down the tree of all of them; counts of steps score a branch."""
    places, f, counts = _steps(spark, sf_dir)
    vocabulary, tree = decoding.answers(places, "tokens")
    asked = f.where("next is null").select("uid", F.col("sid_token").alias("last"), "context")
    got = decoding.decoded(asked, "context", vocabulary, tree, decoding.PathCounts(vocabulary, tree, counts), 10, width=256)
    return got.select("uid", "last", "prediction")


def _steps(spark, sf_dir) -> tuple[DataFrame, DataFrame, dict]:
    """(places with their tokens, check-ins with the next place and the first token as context, counts of paths by context)."""
    places = semantic.with_suffix(sids(spark, sf_dir)).select("pid", "sid_token").withColumn("tokens", sid.segments(F.col("sid_token")))
    f = followed(spark, sf_dir).join(places, "pid").withColumn("context", F.col("tokens")[0])
    counts = path_counts(f.where("next is not null").select("context", F.col("next").alias("pid")), places.select("pid", "tokens"))
    return places, f, counts


@query(f"""{_BEST} SELECT f.uid::VARCHAR AS sample_id, s.sid_token AS target, prediction, len(string_split(prediction, ' '))::INTEGER AS parsed, 'test' AS split, (SELECT count(*) FROM f WHERE nxt IS NULL)::BIGINT AS num_samples, (SELECT count(DISTINCT sid_token) FROM s)::BIGINT AS space
FROM f JOIN s ON f.pid = s.pid JOIN best ON best.context = s.a WHERE f.nxt IS NULL""")
def inference_run(spark, sf_dir):
    """A whole batch inference: prompts, decoding, predictions and metadata written out and read back."""
    places, f, counts = _steps(spark, sf_dir)
    text = F.concat(F.lit("User_"), F.col("uid").cast("string"), F.lit(" visited: "), F.col("sid_token"))
    when = F.date_format("time_dt", "yyyy-MM-dd HH:mm")
    last = f.where("next is null").select(F.col("uid").cast("string").alias("sample_id"), "uid", F.lit("sid").alias("repr"), F.lit("test").alias("split"), F.col("sid_token").alias("target"), when.alias("target_time"), text.alias("input_text"), text.alias("key_text"), "context")
    path = f"{shared_dir(spark)}/predictions-{uuid.uuid4().hex}.jsonl"
    scorer = lambda vocabulary, tree: decoding.PathCounts(vocabulary, tree, counts)
    told = runs.run_inference(last, "sid", path, scorer, places.select(F.col("sid_token").alias("target")), sid.segments, context="context", width=256)
    got = spark.read.schema("sample_id string, target string, prediction string, parsed_predictions array<string>, split string").json(path)
    return got.select("sample_id", "target", "prediction", F.size("parsed_predictions").alias("parsed"), "split", F.lit(told["num_samples"]).cast("bigint").alias("num_samples"), F.lit(told["candidate_space_size"]).cast("bigint").alias("space"))


@query(f"WITH {CHECKINS_SQL}, {SIDS_SQL}, n AS (SELECT count(*)::BIGINT AS num_pois, (count(*) - count(DISTINCT abc))::DOUBLE / greatest(count(*), 1) AS rate FROM s) SELECT form, pid, sid_token, num_pois, round(rate, 9) AS collision_rate FROM s, n, (VALUES ('json lines'), ('csv')) AS f(form)")
def exported_sids(spark, sf_dir):
    """Codes exported as JSON lines and CSV with suffixes where places share one, read back as SID maps, and the export's figures."""
    base = f"{shared_dir(spark)}/sids-{uuid.uuid4().hex}"
    codes = sids(spark, sf_dir).withColumn("reconstruction", F.array(F.col("pid").cast("double")))
    _, stats = runs.export_sids(codes, base)
    lines = files.sid_map(spark.read.json(f"{base}/pid_to_sid")).withColumn("form", F.lit("json lines"))
    commas = files.sid_map(spark.read.option("header", "true").option("escape", '"').csv(f"{base}/pid_to_sid_csv").drop("sid_token")).withColumn("form", F.lit("csv"))
    got = lines.unionByName(commas)
    return got.select("form", "pid", "sid_token", F.lit(stats["num_pois"]).cast("bigint").alias("num_pois"), F.round(F.lit(stats["collision_rate_before_suffix"]), 9).alias("collision_rate"))
