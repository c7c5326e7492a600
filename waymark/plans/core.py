"""Queries of the trajectory build: cleaning, filters, encoding, splits, windows, places, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prompts, sid
from ..operators import base, places, ranking, semantic, sequences
from ..session import cut
from ..sources.adapters import CHECKINS_SQL, SIDS_SQL, checkins, sids, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: The least frequencies of the oracle queries: high enough that the filters drop something.
POI_MIN, USER_MIN = 95, 20


def query(sql: str | None):
    """Registers a query under its function's name."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checkins(spark, sf_dir).withColumn("t", F.date_format("time_dt", "yyyy-MM-dd HH:mm"))


_DIGITS = "23456789CFGHJMPQRVWX"
_Y, _X = "(floor(latitude * 8000)::BIGINT + 720000)", "(floor(longitude * 8000)::BIGINT + 1440000)"
_CODE = " || ".join(f"substr('{_DIGITS}', (({v} // {cell}) % 20 + 1)::INTEGER, 1)" for cell in (160000, 8000, 400) for v in (_Y, _X))


@query(f"WITH {CHECKINS_SQL} SELECT seq, uid, pid, category, {_CODE} AS region, t AS \"Time\", hour(time_dt)::INTEGER AS visit_hour FROM c")
def checkins_clean(spark, sf_dir):
    raw = checkins(spark, sf_dir).select("seq", F.col("uid").alias("original_uid"), F.col("pid").alias("original_pid"), "category", "latitude", "longitude", "timezone_offset", F.col("utc_ts"))
    return base.clean(raw).select("seq", F.col("original_uid").alias("uid"), F.col("original_pid").alias("pid"), "category", "region", "Time", "visit_hour")


_FREQ = f"""f1 AS (SELECT c.* FROM c JOIN (SELECT pid FROM c GROUP BY pid HAVING count(*) >= {POI_MIN}) USING (pid)),
f AS (SELECT f1.* FROM f1 JOIN (SELECT uid FROM f1 GROUP BY uid HAVING count(*) >= {USER_MIN}) USING (uid))"""


def filtered(spark, sf_dir) -> DataFrame:
    return base.frequent(timed(spark, sf_dir), "pid", "uid", POI_MIN, USER_MIN)


@query(f"WITH {CHECKINS_SQL}, {_FREQ} SELECT seq, uid, pid FROM f")
def min_frequency(spark, sf_dir):
    return filtered(spark, sf_dir).select("seq", "uid", "pid")


@query(f"WITH {CHECKINS_SQL} SELECT seq, dense_rank() OVER (ORDER BY uid)::BIGINT AS \"Uid_\", dense_rank() OVER (ORDER BY pid)::BIGINT AS \"Pid_\", dense_rank() OVER (ORDER BY category)::BIGINT AS \"Catname\" FROM c")
def dictionary_encoding(spark, sf_dir):
    return base.encode(checkins(spark, sf_dir), {"uid": "Uid_", "pid": "Pid_", "category": "Catname"}).select("seq", "Uid_", "Pid_", "Catname")


_SPLIT = r"""p0 AS (SELECT c.*, row_number() OVER (ORDER BY t, seq) AS position, count(*) OVER () AS total FROM c),
p1 AS (SELECT *, position <= floor(total * 0.8::DOUBLE) AS train FROM p0),
p AS (SELECT *, NOT train AND uid IN (SELECT uid FROM p1 WHERE train) AND pid IN (SELECT pid FROM p1 WHERE train) AS test FROM p1),
e AS (SELECT * FROM p WHERE uid IN (SELECT uid FROM p WHERE test))"""


def parts(spark, sf_dir) -> DataFrame:
    """The split, written out: windows, semi-joins and adjacency all read it."""
    return cut(base.split(timed(spark, sf_dir), "uid", "pid", "t", "seq", 0.8))


@query(f"WITH {CHECKINS_SQL}, {_SPLIT} SELECT seq, position::BIGINT AS position, train, test FROM p")
def chronological_split(spark, sf_dir):
    return parts(spark, sf_dir).select("seq", "position", "train", "test")


@query(f"WITH {CHECKINS_SQL}, {_SPLIT} SELECT uid, count(*)::BIGINT AS n, sum(train::INTEGER)::BIGINT AS n_train FROM e GROUP BY uid")
def eval_base(spark, sf_dir):
    return base.eval_base(parts(spark, sf_dir), "uid").groupBy("uid").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("train").cast("bigint")).alias("n_train"))


_U = "(('0x' || substr(md5('{seed}|' || {key}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
_SEQ = "q AS (SELECT uid, list(pid ORDER BY t, seq) AS p, list(t ORDER BY t, seq) AS tt FROM {src} GROUP BY uid)"


def flat(w: DataFrame) -> DataFrame:
    """Arrays as text, for comparing."""
    return w.withColumn("pids", F.array_join("pids", ",")).withColumn("times", F.array_join("times", ","))


_TRAIN = f"""t0 AS (SELECT * FROM p WHERE train), {_SEQ.format(src='t0')},
q1 AS (SELECT uid, list_slice(p, greatest(len(p) - 60, 0) + 1, len(p)) AS p, list_slice(tt, greatest(len(tt) - 60, 0) + 1, len(tt)) AS tt FROM q),
w0 AS (SELECT uid, p, tt, len(p)::INTEGER AS n, unnest(CASE WHEN len(p) >= 50 THEN range(len(p) - 1, 48, -10) WHEN len(p) >= 10 THEN [len(p) - 1] ELSE [] END)::INTEGER AS "end" FROM q1),
w1 AS (SELECT uid, "end", n >= 50 AS full_, list_slice(p, CASE WHEN n >= 50 THEN "end" - 48 ELSE 1 END, "end") AS pids, list_slice(tt, CASE WHEN n >= 50 THEN "end" - 48 ELSE 1 END, "end") AS times,
    p["end" + 1] AS target, tt["end" + 1] AS target_time FROM w0),
w2 AS (SELECT *, len(pids) = 49 AND {_U.format(seed='42-mask', key="uid || '|' || \"end\"")} < 0.1::DOUBLE AS masked, floor({_U.format(seed='42-place', key="uid || '|' || \"end\"")} * len(pids))::INTEGER AS at_ FROM w1)
SELECT uid, "end", masked, array_to_string(CASE WHEN masked THEN list_concat(list_concat(list_slice(pids, 1, at_), list_slice(pids, at_ + 2, len(pids))), [target]) ELSE pids END, ',') AS pids,
    array_to_string(CASE WHEN masked THEN list_concat(list_concat(list_slice(times, 1, at_), list_slice(times, at_ + 2, len(times))), [target_time]) ELSE times END, ',') AS times,
    CASE WHEN masked THEN pids[at_ + 1] ELSE target END AS target, CASE WHEN masked THEN times[at_ + 1] ELSE target_time END AS target_time FROM w2"""


@query(f"WITH {CHECKINS_SQL}, {_SPLIT}, {_TRAIN}")
def train_windows(spark, sf_dir):
    """With a cap of 60 events, so that it fires on the test tables."""
    seqs = sequences.gathered(parts(spark, sf_dir).where("train"), "uid", "pid", "t", "seq", most=60)
    return flat(sequences.train_windows(seqs, most=60))


_EVAL = f"""{_SEQ.format(src='e')},
v0 AS (SELECT uid, p, tt, len(p)::INTEGER AS n, 'test' AS split, (len(p) - 1)::INTEGER AS "end" FROM q WHERE len(p) > 2
    UNION ALL SELECT uid, p, tt, len(p)::INTEGER, 'val', (len(p) - 2)::INTEGER FROM q WHERE len(p) > 2 AND len(p) <> 50),
v AS (SELECT split, uid, "end", list_slice(p, CASE WHEN n >= 50 THEN "end" - 48 ELSE 1 END, "end") AS pids, list_slice(tt, CASE WHEN n >= 50 THEN "end" - 48 ELSE 1 END, "end") AS times,
    p["end" + 1] AS target, tt["end" + 1] AS target_time FROM v0)"""


def evaluation(spark, sf_dir, p: DataFrame | None = None) -> DataFrame:
    return sequences.eval_windows(sequences.gathered(base.eval_base(parts(spark, sf_dir) if p is None else p, "uid"), "uid", "pid", "t", "seq", most=51))


@query(f"WITH {CHECKINS_SQL}, {_SPLIT}, {_EVAL} SELECT split, uid, \"end\", array_to_string(pids, ',') AS pids, array_to_string(times, ',') AS times, target, target_time FROM v")
def eval_windows(spark, sf_dir):
    return flat(evaluation(spark, sf_dir)).select("split", "uid", "end", "pids", "times", "target", "target_time")


@query(f"WITH {CHECKINS_SQL}, {_SPLIT}, t0 AS (SELECT * FROM p WHERE train), {_SEQ.format(src='t0')} SELECT uid, (len(p) - 1)::INTEGER AS \"end\", array_to_string(list_slice(p, 1, len(p) - 1), ',') AS pids, p[len(p)] AS target, tt[len(p)] AS target_time FROM q WHERE len(p) > 1")
def history_rows(spark, sf_dir):
    seqs = sequences.gathered(parts(spark, sf_dir).where("train"), "uid", "pid", "t", "seq")
    return flat(sequences.history_rows(seqs)).select("uid", "end", "pids", "target", "target_time")


@query(f"""WITH {CHECKINS_SQL}, g AS (SELECT pid, uid, time_dt, seq, hour(time_dt)::INTEGER AS h, category, category_id, latitude, longitude FROM c),
fu AS (SELECT pid, uid, min(row(uid, time_dt, seq)) AS f FROM g GROUP BY pid, uid), fh AS (SELECT pid, h, min(row(uid, time_dt, seq)) AS f, count(*) AS n FROM g GROUP BY pid, h),
lu AS (SELECT pid, string_agg(uid::VARCHAR, ',' ORDER BY f) AS uids FROM fu GROUP BY pid),
lh AS (SELECT pid, string_agg(h::VARCHAR, ',' ORDER BY f) AS hours, string_agg(h::VARCHAR, ',' ORDER BY h) AS visit_hours, string_agg(h || ':' || n, ',' ORDER BY h) AS histogram FROM fh GROUP BY pid),
s AS (SELECT pid, arg_min(category, row(uid, time_dt, seq)) AS category, round(avg(latitude), 9) AS latitude, round(avg(longitude), 9) AS longitude, count(DISTINCT uid)::BIGINT AS unique_user_count, count(*)::BIGINT AS visit_count FROM g GROUP BY pid)
SELECT pid, uids, hours, category, latitude, longitude, unique_user_count, visit_count, visit_hours, histogram FROM s JOIN lu USING (pid) JOIN lh USING (pid)""")
def place_summary(spark, sf_dir):
    d = checkins(spark, sf_dir).withColumn("hour", F.hour("time_dt")).withColumn("region", F.lit("r"))
    s = places.summary(d)
    hist = F.array_join(F.transform(F.map_entries("visit_time_and_count"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    join = lambda c: F.array_join(F.col(c), ",").alias(c)
    return s.select("pid", join("uids"), join("hours"), "category", F.round("latitude", 9).alias("latitude"), F.round("longitude", 9).alias("longitude"), "unique_user_count", "visit_count", join("visit_hours"), hist.alias("histogram"))


_NEXT = "nx AS (SELECT pid AS a, lead(pid) OVER (PARTITION BY uid ORDER BY time_dt, seq) AS b FROM c)"


@query(f"WITH {CHECKINS_SQL}, {_NEXT}, n2 AS (SELECT a, b FROM nx WHERE b IS NOT NULL UNION ALL SELECT b, a FROM nx WHERE b IS NOT NULL), n3 AS (SELECT a AS pid, b AS neighbour, count(*)::BIGINT AS n FROM n2 GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY pid ORDER BY n DESC, neighbour)::INTEGER AS rank FROM n3")
def neighbours(spark, sf_dir):
    return places.neighbours(checkins(spark, sf_dir), forward_only=False)


@query(f"WITH {CHECKINS_SQL}, {_NEXT}, n3 AS (SELECT a AS pid, b AS neighbour, count(*) AS n FROM nx WHERE b IS NOT NULL GROUP BY 1, 2), l AS (SELECT pid, string_agg(neighbour::VARCHAR, ',' ORDER BY n DESC, neighbour) AS neighbours FROM n3 GROUP BY pid) SELECT pid, coalesce(neighbours, '') AS neighbours FROM (SELECT DISTINCT pid FROM c) LEFT JOIN l USING (pid)")
def forward_neighbours(spark, sf_dir):
    return places.neighbour_lists(checkins(spark, sf_dir), forward_only=True).select("pid", F.array_join("neighbours", ",").alias("neighbours"))


_TEST = "tv AS (SELECT *, row_number() OVER (ORDER BY uid) - 1 AS row_index FROM v WHERE split = 'test')"
_LAST = "list_slice({0}, greatest(len({0}) - 9, 1), len({0}))"
_SEQTEXT = "'User_' || uid || ' visited: ' || (SELECT string_agg(tok || ' at ' || x.t, ', ' ORDER BY x.i) FROM (SELECT unnest({p}) AS pid, unnest({t}) AS t, generate_subscripts({p}, 1) AS i) AS x {join})"


def samples(spark, sf_dir, kind: str = "id", k: int = 10) -> DataFrame:
    """Test samples of either representation."""
    w = sequences.indexed(evaluation(spark, sf_dir).where("split = 'test'"))
    if kind == "id":
        return sequences.sample_rows(w, F.lit("test"), F.col("row_index"), "id", k)
    w = sequences.with_tokens(w, semantic.with_suffix(sids(spark, sf_dir)))
    return sequences.sample_rows(w, F.lit("test"), F.col("row_index"), "sid", k, F.col("tokens"), F.col("goal"))


_SAMPLE_ID = "printf('test-%05d-u%d', row_index, uid)"


def _sample_sql(kind: str) -> str:
    tok = "'<' || x.pid || '>'" if kind == "id" else "s.sid_token"
    join = "" if kind == "id" else "JOIN s ON s.pid = x.pid"
    text = "'User_' || uid || ' visited: ' || string_agg(tok || ' at ' || tm, ', ' ORDER BY i)"
    return f"""{_TEST}, x0 AS (SELECT row_index, uid, target, target_time, {_LAST.format('pids')} AS lp, {_LAST.format('times')} AS lt FROM tv),
x AS (SELECT row_index, uid, target, target_time, unnest(lp) AS pid, unnest(lt) AS tm, unnest(range(1, len(lp) + 1)) AS i FROM x0),
y AS (SELECT row_index, uid, x.target, target_time, tm, i, {tok} AS tok FROM x {join}),
z AS (SELECT row_index, uid, target, target_time, {text} AS key_text FROM y GROUP BY row_index, uid, target, target_time)"""


@query(f"WITH {CHECKINS_SQL}, {_SPLIT}, {_EVAL}, {_sample_sql('id')} SELECT {_SAMPLE_ID} AS sample_id, uid, '<' || target || '>' AS target, target_time, key_text, key_text || ', <' || target || '> at ' || target_time AS query_text, key_text || '. When ' || target_time || ' user_' || uid || ' is likely to visit:' AS input_text FROM z")
def samples_id(spark, sf_dir):
    return samples(spark, sf_dir).select("sample_id", "uid", "target", "target_time", "key_text", "query_text", "input_text")


@query(f"WITH {CHECKINS_SQL}, {_SPLIT}, {_EVAL}, {SIDS_SQL}, {_sample_sql('sid')} SELECT {_SAMPLE_ID} AS sample_id, uid, s.sid_token AS target, target_time, key_text, key_text || '. When ' || target_time || ' user_' || uid || ' is likely to visit:' AS input_text FROM z JOIN s ON s.pid = z.target")
def samples_sid(spark, sf_dir):
    return samples(spark, sf_dir, "sid").select("sample_id", "uid", "target", "target_time", "key_text", "input_text")


_ESC = lambda t: t.replace("'", "''")


@query(f"""WITH {CHECKINS_SQL}, {_SPLIT}, {_EVAL}, {SIDS_SQL}, {_sample_sql('sid')}
SELECT {_SAMPLE_ID} AS sample_id, '{_ESC(prompts.system('sid'))}' AS system, '### Instruction:' || chr(10) || '{_ESC(prompts.INSTRUCTION)}' || chr(10) || chr(10) || '### Input:' || chr(10) || 'Historical trajectory:' || chr(10) || '{prompts.NO_HISTORY}' || chr(10) || chr(10)
    || key_text || '. When ' || target_time || ' user_' || uid || ' is likely to visit:' || chr(10) || chr(10) || '{_ESC(prompts.requirements('sid'))}' AS prompt, s.sid_token AS ground_truth FROM z JOIN s ON s.pid = z.target""")
def chat_rows(spark, sf_dir):
    """RL rows: system and user message, with the history section of users without one."""
    d = samples(spark, sf_dir, "sid")
    body = prompts.body("original", prompts.current(F.col("input_text"), F.col("key_text"), F.col("target_time")), prompts.history(F.lit(None).cast("string")))
    d = d.withColumn("messages", F.array(F.struct(F.lit("system").alias("role"), F.lit(prompts.system("sid")).alias("content")), F.struct(F.lit("user").alias("role"), prompts.prompt(body, "sid").alias("content"))))
    return d.select("sample_id", F.col("messages")[0]["content"].alias("system"), F.col("messages")[1]["content"].alias("prompt"), F.col("target").alias("ground_truth"))


_FLAG = f"""{_SPLIT}, {_EVAL},
t0 AS (SELECT * FROM p WHERE train), nx AS (SELECT pid AS a, lead(pid) OVER (PARTITION BY uid ORDER BY t, seq) AS b FROM t0),
n3 AS (SELECT a, b, count(*) AS n FROM nx WHERE b IS NOT NULL GROUP BY 1, 2), n4 AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS r FROM n3),
pop AS (SELECT pid AS b, row_number() OVER (ORDER BY count(*) DESC, pid) AS r FROM t0 GROUP BY pid),
tv AS (SELECT uid, pids[len(pids)] AS lastp, target FROM v WHERE split = 'test'),
ca AS (SELECT uid, target, b, 0 AS tier, r FROM tv JOIN n4 ON lastp = a WHERE r <= 10 UNION ALL SELECT uid, target, b, 1, r FROM tv, pop WHERE r <= 20),
cb AS (SELECT uid, target, b, min(tier * 1000 + r) AS o FROM ca GROUP BY 1, 2, 3), cc AS (SELECT uid, target, b, row_number() OVER (PARTITION BY uid ORDER BY o) AS k FROM cb),
cd AS (SELECT uid, target, max(CASE WHEN b = target AND k <= 10 THEN k ELSE 0 END) AS hit FROM cc GROUP BY 1, 2)
SELECT count(*)::BIGINT AS num_samples, avg(CASE WHEN hit BETWEEN 1 AND 1 THEN 1.0::DOUBLE ELSE 0 END) AS acc1, avg(CASE WHEN hit BETWEEN 1 AND 5 THEN 1.0::DOUBLE ELSE 0 END) AS acc5, avg(CASE WHEN hit BETWEEN 1 AND 10 THEN 1.0::DOUBLE ELSE 0 END) AS acc10 FROM cd"""


@query(f"WITH {CHECKINS_SQL}, {_FLAG}")
def flagship(spark, sf_dir):
    """Next places predicted from what followed the last one in training, filled up by popularity; accuracy by cut-off."""
    p = parts(spark, sf_dir)
    train = p.where("train")
    near = places.neighbours(train, True, order=("t", "seq")).where("rank <= 10").select(F.col("pid").alias("a"), F.col("neighbour").alias("b"), F.col("rank").alias("o"))
    popular = train.groupBy("pid").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "pid").limit(20)
    from pyspark.sql import Window

    popular = popular.select(F.col("pid").alias("b"), (F.row_number().over(Window.orderBy(F.col("n").desc(), "pid")) + 1000).alias("o"))  # 20 rows
    t = evaluation(spark, sf_dir, p).where("split = 'test'").select("uid", "target", F.element_at("pids", -1).alias("last"))
    cand = t.join(near, F.col("last") == F.col("a")).select("uid", "target", "b", "o").unionByName(t.crossJoin(F.broadcast(popular)).select("uid", "target", "b", "o"))
    best = F.array_sort(F.collect_list(F.struct("o", "b")))
    ranked = cand.groupBy("uid", "target", "b").agg(F.min("o").alias("o")).groupBy("uid", "target").agg(F.slice(F.transform(best, lambda x: sid.place_token(x["b"])), 1, 10).alias("parsed_predictions"))
    rows = ranked.select(F.lit("").alias("prompt"), F.lit("").alias("prediction"), "parsed_predictions", sid.place_token(F.col("target")).alias("target"))
    return ranking.accuracy(rows, "id").select("num_samples", "acc1", "acc5", "acc10")


@query("WITH m AS (SELECT conv_id, string_agg('[' || upper(role) || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS chat FROM conversations WHERE role IS NOT NULL AND text IS NOT NULL GROUP BY conv_id) SELECT * FROM m")
def chat_rendering(spark, sf_dir):
    from ..functions import text

    m = table(spark, sf_dir, "conversations").where("role is not null and text is not null").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("m"))
    return m.select("conv_id", text.chat(F.col("m")).alias("chat"))
