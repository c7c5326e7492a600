"""Queries of whole builds and of file round trips: prepared rows, prompts, banks, maps, negatives, pooled vectors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prompts, text
from ..operators import base, quantise, sampling, semantic, sequences
from ..session import BuildConfig, cut, shared_dir
from ..sources import files
from ..sources.adapters import CHECKINS_SQL, SIDS_SQL, checkins, sids, table
from . import builders, core, meaning, runs
from .core import query as _query

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        _query(sql)(f)
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _folder(spark: SparkSession, suffix: str = "") -> str:
    """A new folder's name in the shared one; what is written there goes when the driver ends."""
    path = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}{suffix}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(where)
    return path


def _lit(t: str) -> str:
    """A text as an SQL literal."""
    return "'" + t.replace("'", "''") + "'"


_NL = "chr(10)"


@query(f"""WITH {CHECKINS_SQL} SELECT 'k' || seq AS category_id, uid AS original_uid, pid::VARCHAR AS original_pid, CASE WHEN seq % 11 > 0 THEN 'Café ' || category END AS category,
    CASE WHEN seq % 11 > 0 AND seq % 13 > 0 THEN round(latitude, 9) END AS latitude, CASE WHEN seq % 11 > 0 THEN timezone_offset::VARCHAR END AS timezone_offset,
    CASE WHEN seq % 11 > 0 AND seq % 7 > 0 THEN floor(epoch(utc_ts))::BIGINT::VARCHAR END AS seconds FROM c WHERE seq % 17 > 0""")
def checkin_files(spark, sf_dir):
    """Check-ins through a headerless TSV: lines with a field too many, short lines, numbers and times that are none, letters beyond ASCII."""
    c, k = checkins(spark, sf_dir), F.col("seq")
    time = F.when(k % 7 == 0, F.lit("yesterday")).otherwise(F.concat(F.date_format("utc_ts", "EEE MMM dd HH:mm:ss"), F.lit(" +0000 "), F.date_format("utc_ts", "yyyy")))
    whole = [F.concat(F.lit("Café "), "category"), F.when(k % 13 == 0, F.lit("north")).otherwise(F.col("latitude").cast("string")), "longitude", "timezone_offset", time]
    line = F.concat_ws("\t", "uid", "pid", F.concat(F.lit("k"), k.cast("string")), F.when(k % 11 > 0, F.concat_ws("\t", *whole)), F.when(k % 17 == 0, F.concat(*[F.lit("\t")] * 8)))
    path = _folder(spark)
    c.select(line.alias("value")).write.text(path)
    d = files.read_checkins(spark, path)
    return d.select("category_id", "original_uid", "original_pid", "category", F.round("latitude", 9).alias("latitude"), F.col("timezone_offset").cast("string").alias("timezone_offset"), F.unix_timestamp("utc_ts").cast("string").alias("seconds"))


@query(f"WITH {CHECKINS_SQL}, {SIDS_SQL} SELECT form, pid, CASE WHEN form = 'json' OR pid % 5 = 0 THEN sid_token ELSE abc END AS sid_token FROM s, (VALUES ('csv'), ('jsonl'), ('json')) AS f(form)")
def sid_map_files(spark, sf_dir):
    """A SID map through its three forms: an object keyed by place, JSON lines and CSV, whose rows have a token, or index lists in either column, with numpy's marks too."""
    s, k = semantic.with_suffix(sids(spark, sf_dir)), F.col("pid") % 5
    indices = F.to_json(F.slice("sid_indices", 1, 3))
    marked = F.concat(F.lit("["), F.array_join(F.transform(F.slice("sid_indices", 1, 3), lambda x: F.concat(F.lit("np.int64("), x.cast("string"), F.lit(")"))), ", "), F.lit("]"))
    s = cut(s.select("pid", "sid_token", "sid_indices"))
    d = cut(s.select("pid", F.when(k == 0, F.col("sid_token")).when(k == 1, F.lit("")).alias("sid_token"), F.when(k.isin(1, 2), indices).when(k == 4, marked).alias("sid_indices"), F.when(k == 3, indices).alias("sid")))
    lines, commas, keyed = _folder(spark, ".jsonl"), _folder(spark, ".csv"), _folder(spark, ".json")
    files.write_jsonl(d, lines)
    d.write.option("header", "true").option("escape", '"').csv(commas)
    entries = F.map_from_entries(F.collect_list(F.struct(F.col("pid").cast("string"), F.struct("sid_token", "sid_indices"))))
    s.agg(F.to_json(entries)).coalesce(1).write.text(keyed)  # the form is one document, as large as the map
    forms = {"jsonl": lines, "csv": commas, "json": keyed}
    read = [files.read_sid_map(spark, path).select(F.lit(form).alias("form"), "*") for form, path in forms.items()]
    return read[0].unionByName(read[1]).unionByName(read[2])


@query("SELECT conv_id, turn, role, CASE WHEN turn % 3 > 0 THEN text END AS text FROM conversations")
def json_lines(spark, sf_dir):
    """Rows through JSON lines with explicit nulls."""
    d = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.when(F.col("turn") % 3 > 0, F.col("text")).alias("text"))
    path = _folder(spark)
    files.write_jsonl(d, path)
    return files.read_jsonl(spark, path, d.schema)


@query("SELECT p_partkey AS id, p_type AS category, coalesce(CASE WHEN p_partkey % 3 > 0 THEN p_brand END, p_type) AS name FROM part")
def alias_columns(spark, sf_dir):
    """The first alias that is a column, and the first alias that a row has a value of."""
    d = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("Catname"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_brand")).alias("name"))
    return d.select(F.col("p_partkey").alias("id"), F.col(base.resolve(d, base.CATEGORY_ALIASES)).alias("category"), base.first_present(d, ("title", "name", "Catname")).alias("name"))


_HOUR = "(p_size % 24)"


_W = "::DECIMAL(10, 2)::VARCHAR"


@query(f"""SELECT p_partkey AS id, CASE p_partkey % 7 WHEN 0 THEN {_HOUR} || ':' || p_size{_W} || ',30:1.00' WHEN 1 THEN {_HOUR} || ':' || p_size{_W} || ',30:7.00' WHEN 2 THEN {_HOUR} || ':4.00'
    WHEN 5 THEN {_HOUR} || ':2.00,30:1.00' WHEN 6 THEN {_HOUR} || ':' || (p_size + 0.5){_W} ELSE '' END AS hours FROM part""")
def time_literals(spark, sf_dir):
    """Hours and weights out of mappings, pairs, a key that comes twice, a list of hours, decimal weights, junk and null."""
    h, n, k = (F.col("p_size") % 24).cast("string"), F.col("p_size").cast("string"), F.col("p_partkey") % 7
    form = F.when(k == 0, F.concat(F.lit("{"), h, F.lit(": np.int64("), n, F.lit("), 30: 1}"))).when(k == 1, F.concat(F.lit("[("), h, F.lit(", "), n, F.lit("), ('30', 7)]")))
    form = form.when(k == 2, F.concat(F.lit("{"), h, F.lit(": "), n, F.lit(", "), h, F.lit(": 4}"))).when(k == 3, F.concat(F.lit("about "), n))
    form = form.when(k == 5, F.concat(F.lit("["), h, F.lit(", 30, "), h, F.lit("]"))).when(k == 6, F.concat(F.lit("{"), h, F.lit(": "), n, F.lit(".5}")))
    d = table(spark, sf_dir, "part").select("p_partkey", text.time_literal(form).alias("m"))
    each = F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("decimal(10,2)").cast("string")))
    return d.select(F.col("p_partkey").alias("id"), F.array_join(each, ",").alias("hours"))


_PAST = """h0 AS (SELECT uid, list(pid ORDER BY t, seq) AS hp, list(t ORDER BY t, seq) AS ht FROM p WHERE train GROUP BY uid),
hi AS (SELECT uid, 'User_' || uid || ' visited: ' || array_to_string(list_transform(range(1, len(hp)), lambda i: '<' || hp[i] || '> at ' || ht[i]), ', ') AS history FROM h0 WHERE len(hp) > 1 AND uid % 3 > 0)"""
_INPUT = "key_text || '. When ' || target_time || ' user_' || uid || ' is likely to visit:'"


def past(spark, sf_dir) -> DataFrame:
    """(uid, history) of two users in three, found by the user that the text names, the later of two."""
    seqs = sequences.gathered(core.parts(spark, sf_dir).where("train"), "uid", "pid", "t", "seq")
    h = builders.history_texts(sequences.history_rows(seqs)).where("uid % 3 > 0")
    old = h.select(F.concat(F.regexp_extract("history", r"^User_\d+", 0), F.lit(" visited: <0> at 2000-01-01 00:00")).alias("history"), F.lit(0).alias("at"))
    return files.history_map(h.select("history", F.lit(1).alias("at")).unionByName(old), "history", "at")


@query(f"""WITH {CHECKINS_SQL}, {core._SPLIT}, {core._EVAL}, {core._sample_sql('id')}, {_PAST},
r AS (SELECT {core._SAMPLE_ID} AS sample_id, 'Historical trajectory:' || {_NL} || coalesce(history, {_lit(prompts.NO_HISTORY)}) || {_NL} || {_NL} || {_INPUT} AS input, '<' || target || '>' AS output FROM z LEFT JOIN hi USING (uid))
SELECT sample_id, input, output, '### Instruction:' || {_NL} || {_lit(prompts.INSTRUCTION)} || {_NL} || {_NL} || '### Input:' || {_NL} || input || {_NL} || {_NL} || '### Response:' || {_NL} || output || '<|eot_id|>' AS completion FROM r""")
def supervised_rows(spark, sf_dir):
    """Prepared supervised rows of the source `original`, with the default text for users without a history, and their training text."""
    windows = {"test": core.evaluation(spark, sf_dir).where("split = 'test'")}
    d = runs.prepared(windows, 10, None, {"id": past(spark, sf_dir)})["id", "test", "original"]
    return d.select("sample_id", "input", "output", text.completion(F.col("instruction"), F.col("input"), F.col("output")).alias("completion"))


_FORMS = [(kind, n, source) for kind in ("id", "sid") for n in (1, 10) for source in ("current", "original", "retrieval", "hybrid")]


def _form_sql(kind: str, n: int, source: str) -> str:
    blank = f" || {_NL} || {_NL} || "
    history = f"'Historical trajectory:' || {_NL} || coalesce(history, {_lit(prompts.NO_HISTORY)})"
    case = f"'Retrieved similar cases:' || {_NL} || CASE WHEN uid % 2 = 0 THEN {_lit(prompts.NO_CASE)} ELSE 'Case 1:' || {_NL} || 'Trajectory: ' || key_text || {_NL} || 'Next POI: <' || target || '>' END"
    sections = [x for x, there in ((history, source in ("original", "hybrid")), (case, source in ("retrieval", "hybrid"))) if there] + [_INPUT]
    whole = [f"'### Instruction:' || {_NL} || {_lit(prompts.INSTRUCTION)}", f"'### Input:' || {_NL} || " + blank.join(sections)] + ([_lit(prompts.requirements(kind, n))] if n != 1 else [])
    return f"SELECT {core._SAMPLE_ID} AS sample_id, '{kind}-{n}-{source}' AS form, {_lit(prompts.system(kind, n))} AS system, md5({blank.join(whole)}) AS prompt FROM z LEFT JOIN hi USING (uid)"


@query(f"WITH {CHECKINS_SQL}, {core._SPLIT}, {core._EVAL}, {core._sample_sql('id')}, {_PAST} " + " UNION ALL ".join(_form_sql(*f) for f in _FORMS))
def prompt_forms(spark, sf_dir):
    """The system text and the prompt's digest by representation, number of candidates and source of history."""
    d = cut(core.samples(spark, sf_dir).join(past(spark, sf_dir), "uid", "left"))
    now = prompts.current(F.col("input_text"), F.col("key_text"), F.col("target_time"))
    shown = F.when(F.col("uid") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(prompts.case(F.lit(1), F.col("key_text"), F.col("target"))))
    each = [F.struct(F.lit(f"{k}-{n}-{s}").alias("form"), F.lit(prompts.system(k, n)).alias("system"), F.md5(prompts.prompt(prompts.body(s, now, prompts.history(F.col("history")), prompts.cases(shown)), k, n)).alias("prompt")) for k, n, s in _FORMS]
    return d.select("sample_id", F.explode(F.array(*each)).alias("f")).select("sample_id", "f.*")


@query(f"WITH {meaning._ROWS}, {meaning._PROTO}, {meaning._NEG} SELECT sample_id, '### Instruction:' || {_NL} || trim(instruction) || {_NL} || {_NL} || '### Input:' || {_NL} || trim(input) || {_NL} || {_NL} || '### Response:' || {_NL} AS prompt FROM ({meaning._RECORDS})")
def alignment_prompts(spark, sf_dir):
    return meaning.alignment_records(spark, sf_dir).select("sample_id", prompts.alignment(F.col("instruction"), F.col("input")).alias("prompt"))


_HALF = "CASE WHEN row_index % 2 = 0 THEN 'train' ELSE 'valid' END"


def halves(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The samples of even places and of odd ones, as two splits."""
    d = cut(core.samples(spark, sf_dir, "sid"))
    return d.where("row_index % 2 = 0"), d.where("row_index % 2 = 1")


@query(f"""WITH {CHECKINS_SQL}, {core._SPLIT}, {core._EVAL}, {SIDS_SQL}, {core._sample_sql('sid')}, {meaning._RANK.replace('SELECT pid, count(*) AS n FROM c GROUP BY pid', 'SELECT target AS pid, count(*) AS n FROM z WHERE row_index % 2 = 0 GROUP BY 1')},
rk AS (SELECT target, candidate, row_number() OVER (PARTITION BY target ORDER BY tier, n DESC, candidate) AS rank FROM al), li AS (SELECT target AS goal, string_agg(candidate, ' ' ORDER BY rank) AS output FROM rk WHERE rank <= 10 GROUP BY target)
SELECT {_HALF} AS split, {core._SAMPLE_ID} AS sample_id, {_lit(prompts.system('sid'))} || {_NL} || {_NL} || {_lit(prompts.INSTRUCTION)} AS instruction, {_INPUT} || {_NL} || {_NL} || {_lit(prompts.requirements('sid'))} AS input, output
FROM z JOIN s ON s.pid = z.target JOIN li ON goal = s.sid_token""")
def warmup_rows(spark, sf_dir):
    """Warm-up rows of two splits, ranked by the targets of the first."""
    out, _ = runs.warmup_build(*halves(spark, sf_dir), semantic.with_suffix(sids(spark, sf_dir)))
    each = [d.select(F.lit(name).alias("split"), "sample_id", "instruction", "input", "output") for name, d in out.items()]
    return each[0].unionByName(each[1])


@query(f"""WITH {CHECKINS_SQL}, {core._SPLIT}, {core._EVAL}, {SIDS_SQL}, {core._sample_sql('sid')}
SELECT {_HALF} AS split, {core._SAMPLE_ID} AS sample_id, uid, target_time, s.sid_token AS ground_truth, 'next_poi' AS data_source, 'next_poi_prediction' AS ability, '{prompts.VERSION}' AS version, 'system: ' || {_lit(prompts.system('sid'))} || {_NL} || 'user: ' || '### Instruction:' || {_NL} || {_lit(prompts.INSTRUCTION)}
    || {_NL} || {_NL} || '### Input:' || {_NL} || {_INPUT} || {_NL} || {_NL} || {_lit(prompts.requirements('sid'))} AS messages FROM z JOIN s ON s.pid = z.target""")
def chat_build_rows(spark, sf_dir):
    """Chat rows of two splits, their messages one after the other."""
    out, _ = runs.chat_build(*halves(spark, sf_dir))
    said = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")
    each = [d.select(F.lit(name).alias("split"), "sample_id", "uid", "target_time", "ground_truth", "data_source", "ability", F.col("prompt_template_version").alias("version"), said.alias("messages")) for name, d in out.items()]
    return each[0].unionByName(each[1])


@query(f"WITH {CHECKINS_SQL}, {core._SPLIT}, {core._EVAL}, {SIDS_SQL} SELECT split, repr, count(*)::BIGINT AS n, count(DISTINCT CASE WHEN repr = 'id' THEN '<' || target || '>' ELSE sid_token END)::BIGINT AS targets FROM v JOIN s ON s.pid = v.target, (VALUES ('id'), ('sid')) AS k(repr) GROUP BY 1, 2")
def retrieval_bank(spark, sf_dir):
    """Rows and distinct targets of a bank of two splits, for each split and representation."""
    w = cut(core.evaluation(spark, sf_dir))
    made = runs.prepared({s: w.where(F.col("split") == s) for s in ("val", "test")}, 10, semantic.with_suffix(sids(spark, sf_dir)))
    whole, counts = builders.bank([d for k, d in made.items() if len(k) == 2])
    each = [runs.bank_rows(whole, s, k).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("target").alias("targets")).select(F.lit(s).alias("split"), F.lit(k).alias("repr"), "n", "targets") for s in ("val", "test") for k in ("id", "sid")]
    return each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3]).join(counts.select("split"), "split", "left_semi")


@query(f"WITH {meaning._ROWS}, {meaning._PROTO} SELECT prefix FROM pr WHERE level = 'abc' AND prefix <> '<a_0><b_0><c_0>' AND category NOT IN ('cat0', 'cat3') ORDER BY {meaning._u('42', 'prefix')}, prefix LIMIT 7")
def simple_negatives(spark, sf_dir):
    """Seven prefixes, which is what is asked for, but for the positive and for what is like it."""
    d = cut(semantic.prototypes(meaning.rows(spark, sf_dir))).where("level = 'abc'").select("prefix", F.col("category").alias("profile_json"))
    return sampling.negatives(d, "<a_0><b_0><c_0>", ["cat0", "cat3"], 7).select("prefix")


@query(f"WITH {CHECKINS_SQL}, {SIDS_SQL} SELECT pid, row_number() OVER (ORDER BY {meaning._u('7', 'pid')}, pid)::BIGINT AS place FROM s")
def shuffled_order(spark, sf_dir):
    """Places in the seeded order, numbered as they come."""
    d = cut(sampling.shuffled(sids(spark, sf_dir), "pid", 7).select("pid", F.monotonically_increasing_id().alias("at")))
    return base.positions(d, [F.col("at")], "place").select("pid", "place")


_TOKENS = "t AS (SELECT coalesce(label, -1)::BIGINT AS id, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE embedding IS NOT NULL), x AS (SELECT id, vec_id, unnest(range(0, len(v)))::INTEGER AS i, unnest(v) AS v FROM t)"


@query(f"""WITH {_TOKENS}, w AS (SELECT *, 0.1::DOUBLE * (1 + vec_id % 4) + 0.1::DOUBLE * (1 + (vec_id + 1) % 4) AS w FROM x)
SELECT 'mean' AS form, id, i, round(avg(v), 6) AS x FROM x WHERE vec_id % 3 > 0 GROUP BY id, i UNION ALL SELECT 'attention', id, i, round(sum(v * w) / 2, 6) FROM w GROUP BY id, i""")
def pooled_vectors(spark, sf_dir):
    """Vectors of a label as tokens of a text: the mean where the mask lets through, and the mean by two heads' weights."""
    d = table(spark, sf_dir, "embeddings").where("embedding is not null").select(F.coalesce("label", F.lit(-1)).cast("bigint").alias("id"), F.col("vec_id").alias("position"), F.col("embedding").cast("array<double>").alias("vec"), (F.col("vec_id") % 3 > 0).cast("int").alias("mask"))
    heads = d.select("id", "position", F.explode(F.array(F.lit(0), F.lit(1))).alias("head"), F.lit(0).alias("asker"))
    heads = heads.withColumn("weight", 0.1 * (1 + (F.col("position") + F.col("head")) % 4))
    size = d.select(F.size("vec").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    each = lambda name, v: v.select(F.lit(name).alias("form"), "id", F.posexplode("vec").alias("i", "y")).select("form", "id", "i", F.round("y", 6).alias("x"))
    return each("mean", quantise.mean_pooled(d, size)).unionByName(each("attention", quantise.attention_pooled(d, heads, size)))


_BUILT = f"""{core._FREQ}, {core._SPLIT.replace('c.*', 'f.*').replace('FROM c)', 'FROM f)')}, tn AS (SELECT uid, least(count(*), 80) AS n FROM p WHERE train GROUP BY uid), en AS (SELECT uid, count(*) AS n FROM e GROUP BY uid)"""


@query(f"""WITH {CHECKINS_SQL}, {_BUILT} SELECT 'checkins' AS name, count(*)::BIGINT AS n FROM f UNION ALL SELECT 'uid_mapping', count(DISTINCT uid)::BIGINT FROM f UNION ALL SELECT 'pid_mapping', count(DISTINCT pid)::BIGINT FROM f
UNION ALL SELECT 'catname_mapping', count(DISTINCT category)::BIGINT FROM f UNION ALL SELECT 'region_id_mapping', count(DISTINCT {core._CODE})::BIGINT FROM f UNION ALL SELECT 'poi_info', count(DISTINCT pid)::BIGINT FROM f
UNION ALL SELECT 'train', coalesce(sum(CASE WHEN n >= 50 THEN (n - 50) // 10 + 1 WHEN n >= 10 THEN 1 ELSE 0 END), 0)::BIGINT FROM tn UNION ALL SELECT 'history', count(*)::BIGINT FROM tn WHERE n > 1
UNION ALL SELECT 'test', count(*)::BIGINT FROM en WHERE n > 2 UNION ALL SELECT 'val', count(*)::BIGINT FROM en WHERE n > 2 AND n <> 50""")
def trajectory_tables(spark, sf_dir):
    """The tables of a whole raw build, written out, by the rows that their manifest counts."""
    raw = checkins(spark, sf_dir).select("seq", F.col("uid").alias("original_uid"), F.col("pid").alias("original_pid"), "category_id", "category", "latitude", "longitude", "timezone_offset", "utc_ts")
    config = BuildConfig(poi_min=core.POI_MIN, user_min=core.USER_MIN)
    counts = runs.write_tables(builders.trajectories(raw, config, "seq"), _folder(spark), config)["rows"]
    return spark.createDataFrame(sorted(counts.items()), "name string, n bigint")
