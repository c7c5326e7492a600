"""Queries of semantic IDs: strings, geography, prototypes, purity, negatives, records, sampling, ranked targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo, prompts, sid, text, vector
from ..operators import ranking, sampling, semantic
from ..session import cut
from ..sources.adapters import CHECKINS_SQL, SIDS_SQL, checkins, sids, table
from .core import query as _query

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        _query(sql)(f)
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _u(seed: str, key: str) -> str:
    return f"(('0x' || substr(md5('{seed}|' || {key}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


@query(f"WITH {CHECKINS_SQL}, {SIDS_SQL} SELECT pid, sid_token, a, ab, abc, CASE WHEN sid_token = abc THEN 'abc' ELSE 'full_sid' END AS level FROM s")
def sid_suffixes(spark, sf_dir):
    d = semantic.with_suffix(sids(spark, sf_dir))
    t = F.col("sid_token")
    return d.select("pid", "sid_token", *[sid.prefix(t, lv).alias(lv) for lv in ("a", "ab", "abc")], sid.level_name(t).alias("level"))


@query(f"WITH {CHECKINS_SQL}, {SIDS_SQL} SELECT count(*)::BIGINT AS rows, count(DISTINCT abc)::BIGINT AS codes, (count(*) - count(DISTINCT abc))::DOUBLE / greatest(count(*), 1) AS collision_rate FROM s")
def collision_rate(spark, sf_dir):
    return semantic.collision_rate(sids(spark, sf_dir))


_BOX = """g0 AS (SELECT min(latitude) AS y0, max(latitude) AS y1, min(longitude) AS x0, max(longitude) AS x1 FROM pl),
sr AS (SELECT pl.pid, sid_token AS full_sid, a, ab, abc, category, region, 'G' || (CASE WHEN y1 <= y0 THEN 0 WHEN latitude >= y1 THEN 7 ELSE least(greatest(floor((latitude - y0) / (y1 - y0) * 8)::INTEGER, 0), 7) END)
    || '_' || (CASE WHEN x1 <= x0 THEN 0 WHEN longitude >= x1 THEN 7 ELSE least(greatest(floor((longitude - x0) / (x1 - x0) * 8)::INTEGER, 0), 7) END) AS geo_bucket FROM pl JOIN s USING (pid), g0)"""
_PLACES = "pl AS (SELECT DISTINCT pid, category, CASE WHEN pid % 5 = 0 THEN 'r' || (pid % 3) ELSE (pid % 4)::VARCHAR END AS region, latitude, longitude FROM c)"
_ROWS = f"{CHECKINS_SQL}, {SIDS_SQL}, {_PLACES}, {_BOX}"


def places(spark, sf_dir) -> DataFrame:
    region = F.when(F.col("pid") % 5 == 0, F.concat(F.lit("r"), (F.col("pid") % 3).cast("string"))).otherwise((F.col("pid") % 4).cast("string"))
    return checkins(spark, sf_dir).select("pid", "category", region.alias("region"), "latitude", "longitude").distinct()


def rows(spark, sf_dir) -> DataFrame:
    return semantic.rows(places(spark, sf_dir), semantic.with_suffix(sids(spark, sf_dir)))


@query(f"WITH {_ROWS} SELECT * FROM sr")
def semantic_rows(spark, sf_dir):
    return rows(spark, sf_dir).select("pid", "full_sid", "a", "ab", "abc", "category", "region", "geo_bucket")


_LONG = """lg AS (SELECT lv AS level, CASE lv WHEN 'a' THEN a WHEN 'ab' THEN ab ELSE abc END AS prefix, f AS field, CASE f WHEN 'category' THEN category WHEN 'region' THEN region ELSE geo_bucket END AS value
    FROM sr, (VALUES ('a', 'category'), ('ab', 'category'), ('ab', 'region'), ('abc', 'category'), ('abc', 'region'), ('abc', 'geo_bucket')) AS v(lv, f)),
lc AS (SELECT level, prefix, field, value, count(*) AS n FROM lg GROUP BY 1, 2, 3, 4)"""
_JSON = """'{"category":"' || category || '"' || CASE WHEN level <> 'a' THEN ',"region":' || CASE WHEN regexp_full_match(region, '-?[0-9]+') THEN region ELSE '"' || region || '"' END ELSE '' END || CASE WHEN level = 'abc' THEN ',"geo_bucket":"' || geo_bucket || '"' ELSE '' END || '}'"""
_PROTO = f"""{_LONG}, wo AS (SELECT field, value, sum(n) AS g FROM lc WHERE level = 'abc' GROUP BY 1, 2),
bs AS (SELECT lc.*, row_number() OVER (PARTITION BY level, prefix, field ORDER BY n DESC, CASE WHEN field = 'geo_bucket' THEN 0 ELSE g END DESC, value) AS r FROM lc JOIN wo USING (field, value)),
wd AS (SELECT level, prefix, max(CASE WHEN field = 'category' THEN value END) AS category, max(CASE WHEN field = 'region' THEN value END) AS region, max(CASE WHEN field = 'geo_bucket' THEN value END) AS geo_bucket FROM bs WHERE r = 1 GROUP BY 1, 2),
pr AS (SELECT wd.*, (SELECT count(*) FROM sr WHERE CASE level WHEN 'a' THEN a WHEN 'ab' THEN ab ELSE abc END = prefix)::BIGINT AS member_count, {_JSON} AS profile_json FROM wd)"""


@query(f"WITH {_ROWS}, {_PROTO} SELECT * FROM pr")
def prefix_prototypes(spark, sf_dir):
    return semantic.prototypes(rows(spark, sf_dir)).select("level", "prefix", "category", "region", "geo_bucket", "member_count", "profile_json")


@query(f"WITH {_ROWS}, {_LONG}, sh AS (SELECT level, prefix, field, max(n) / sum(n) AS s FROM lc GROUP BY 1, 2, 3) SELECT level, field, count(*)::BIGINT AS num_groups, round(avg(s), 9) AS mean, median(s) AS median, min(s) AS min, max(s) AS max FROM sh GROUP BY 1, 2")
def purity(spark, sf_dir):
    return semantic.purity(rows(spark, sf_dir)).withColumn("mean", F.round("mean", 9))


_DIST = "(abs(regexp_extract(p.geo_bucket, 'G(\\d+)_', 1)::BIGINT - regexp_extract(q.geo_bucket, 'G(\\d+)_', 1)::BIGINT) + abs(regexp_extract(p.geo_bucket, '_(\\d+)', 1)::BIGINT - regexp_extract(q.geo_bucket, '_(\\d+)', 1)::BIGINT))"


def _negatives(level: str) -> str:
    rule = {
        "a": [("p.category <> q.category", "q.category, q.prefix")],
        "ab": [("p.category = q.category AND p.region <> q.region", "q.region, q.prefix"), ("p.category <> q.category AND p.region = q.region", "q.category, q.prefix")],
        "abc": [("p.category = q.category AND p.region <> q.region", f"{_DIST}, q.region, q.prefix"), ("p.category = q.category AND p.region = q.region AND p.geo_bucket <> q.geo_bucket", f"{_DIST}, q.prefix"), ("p.category <> q.category", f"{_DIST}, q.category, q.prefix")],
    }[level]
    x = f"x_{level}"
    picked = " UNION ALL ".join(f"SELECT positive, negative, {k} AS rule FROM (SELECT p.prefix AS positive, q.prefix AS negative, row_number() OVER (PARTITION BY p.prefix ORDER BY {o}) AS r FROM {x} p JOIN {x} q ON {w}) WHERE r = 1" for k, (w, o) in enumerate(rule))
    return f"""{x} AS (SELECT * FROM pr WHERE level = '{level}'), ri_{level} AS (SELECT prefix, row_number() OVER (ORDER BY {_u(f'42-ring-{level}', 'prefix')}, prefix) - 1 AS place, count(*) OVER () AS total FROM {x}),
fi_{level} AS (SELECT p.prefix AS positive, q.prefix AS negative, (q.place - p.place + p.total) % p.total + 100 AS rule FROM ri_{level} p JOIN ri_{level} q ON q.prefix <> p.prefix WHERE (q.place - p.place + p.total) % p.total <= {3 + len(rule)}),
ev_{level} AS (SELECT positive, negative, min(rule) AS rule FROM ({picked} UNION ALL SELECT * FROM fi_{level}) GROUP BY 1, 2),
ne_{level} AS (SELECT positive, string_agg(negative, ' ' ORDER BY negative) AS negatives FROM (SELECT *, row_number() OVER (PARTITION BY positive ORDER BY rule, negative) AS k FROM ev_{level}) WHERE k <= 3 GROUP BY 1)"""


_NEG = ", ".join(map(_negatives, semantic.LEVELS))


@query(f"WITH {_ROWS}, {_PROTO}, {_NEG} SELECT 'a' AS level, * FROM ne_a UNION ALL SELECT 'ab', * FROM ne_ab UNION ALL SELECT 'abc', * FROM ne_abc")
def hard_negatives(spark, sf_dir):
    p = cut(semantic.prototypes(rows(spark, sf_dir)))
    out = [semantic.hard_negatives(p, lv).select(F.lit(lv).alias("level"), "positive", F.array_join("negatives", " ").alias("negatives")) for lv in semantic.LEVELS]
    return out[0].unionByName(out[1]).unionByName(out[2])


def _fields(level: str) -> str:
    return f"category, {'region' if level != 'a' else 'NULL::VARCHAR'} AS region, {'geo_bucket' if level in ('abc', 'full_sid') else 'NULL::VARCHAR'} AS geo_bucket"


def _record_sql(level: str, there: str, back: str) -> str:
    j = f"(SELECT t.abc AS source_abc, t.{level} AS pre, pr.*, (SELECT string_agg(x, ' ' ORDER BY x) FROM unnest(list_append(string_split(negatives, ' '), positive)) AS u(x)) AS candidates FROM (SELECT DISTINCT a, ab, abc FROM sr) t JOIN pr ON pr.level = '{level}' AND pr.prefix = t.{level} JOIN ne_{level} ON positive = t.{level})"
    return f"""SELECT '{there}' AS task_type, source_abc || '::{level}_to_profile' AS sample_id, 'Semantic prefix (level {level}): ' || pre AS input, profile_json AS output, '{prompts.TASKS[there]}' AS instruction, {_fields(level)}, NULL::VARCHAR AS candidates FROM {j}
UNION ALL SELECT '{back}', source_abc || '::profile_to_{level}', 'Semantic profile: ' || profile_json || chr(10) || 'Candidate prefixes: ' || candidates, pre, '{prompts.TASKS[back]}', {_fields(level)}, candidates FROM {j}"""


_RECORDS = f"""{_record_sql('a', 'a_to_category_profile', 'category_profile_to_a')} UNION ALL {_record_sql('ab', 'ab_to_category_region_profile', 'category_region_profile_to_ab')}
UNION ALL {_record_sql('abc', 'abc_to_abc_profile', 'abc_profile_to_abc')}
UNION ALL SELECT 'full_sid_to_abc_profile', full_sid || '::full_to_profile', 'Semantic ID: ' || full_sid, profile_json, '{prompts.TASKS['full_sid_to_abc_profile']}', pr.category, pr.region, pr.geo_bucket, NULL FROM sr JOIN pr ON pr.level = 'abc' AND pr.prefix = sr.abc"""


@query(f"WITH {_ROWS}, {_PROTO}, {_NEG} SELECT task_type, count(*)::BIGINT AS n FROM ({_RECORDS}) GROUP BY 1")
def task_counts(spark, sf_dir):
    d = cut(rows(spark, sf_dir))
    return semantic.task_counts(semantic.records(d, cut(semantic.prototypes(d))))


@query(f"WITH {_ROWS}, {_PROTO}, {_NEG} {_RECORDS}")
def alignment_records(spark, sf_dir):
    d = cut(rows(spark, sf_dir))
    return semantic.records(d, cut(semantic.prototypes(d))).select("task_type", "sample_id", "input", "output", "instruction", "category", "region", "geo_bucket", F.array_join("candidate_prefixes", " ").alias("candidates"))


@query(f"WITH {_ROWS}, d AS (SELECT DISTINCT abc FROM sr) SELECT abc, row_number() OVER (ORDER BY {_u('42-abc', 'abc')}, abc) <= greatest(1, floor(count(*) OVER () * 0.1::DOUBLE)) AS valid FROM d")
def prefix_split(spark, sf_dir):
    return semantic.split_prefixes(rows(spark, sf_dir), 0.1)


_W = "greatest(0.1::DOUBLE, least(1.0::DOUBLE, pow(rn::DOUBLE, -0.35::DOUBLE) * pow(cn::DOUBLE, -0.15::DOUBLE) * pow(gn::DOUBLE, -0.20::DOUBLE)))"


@query(f"WITH {_ROWS}, n AS (SELECT full_sid, count(*) OVER (PARTITION BY category) AS cn, count(*) OVER (PARTITION BY region) AS rn, count(*) OVER (PARTITION BY geo_bucket) AS gn FROM sr) SELECT full_sid, round({_W}, 9) AS forward, round(1 / sqrt((cn * rn)::DOUBLE), 9) AS candidate FROM n")
def sampling_weights(spark, sf_dir):
    d = rows(spark, sf_dir)
    for c, n in (("category", "cn"), ("region", "rn"), ("geo_bucket", "gn")):
        d = d.join(d.groupBy(c).agg(F.count(F.lit(1)).alias(n)), c)
    return d.select("full_sid", F.round(sampling.forward_weight(F.col("rn"), F.col("cn"), F.col("gn")), 9).alias("forward"), F.round(sampling.candidate_weight(F.col("cn"), F.col("rn")), 9).alias("candidate"))


_FINE = "(('0x' || substr(md5('{seed}|' || {key}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


def _drawn_sql(items: str, name: str, key: str, size: str, seed: str) -> str:
    """Draws from items (key, w): a running sum of whole weights by bucket and key, and the draws' numbers in it."""
    bucket = f"floor({_FINE.format(seed=seed + '-bucket', key=key + '::VARCHAR')} * greatest(1, (count(*) OVER () + 65535) // 65536))"
    return f"""{name}_b AS (SELECT *, {bucket} AS b FROM {items}), {name}_c AS (SELECT *, sum(w) OVER (ORDER BY b, {key} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi, sum(w) OVER () AS total FROM {name}_b),
{name}_u AS (SELECT i AS draw, {_FINE.format(seed=seed + '-draw', key='i::VARCHAR')} AS u FROM (SELECT unnest(range({size})) AS i)), {name} AS (SELECT draw::BIGINT AS draw, {name}_c.* FROM {name}_u JOIN {name}_c ON floor(u * total::DOUBLE) >= hi - w AND floor(u * total::DOUBLE) < hi)"""


@query(f"WITH {CHECKINS_SQL}, {SIDS_SQL}, x AS (SELECT pid, sid_token, 1 AS w FROM s), {_drawn_sql('x', 'dr', 'pid', '50', '7')} SELECT draw, pid, sid_token FROM dr")
def sample_with_replacement(spark, sf_dir):
    d = semantic.with_suffix(sids(spark, sf_dir)).select("pid", "sid_token")
    return sampling.with_replacement(d, "pid", 50, 7)


@query(f"WITH {_ROWS}, n(family, k, r) AS (VALUES ('full_sid_to_abc_profile', 0, 0.5::DOUBLE), ('abc_to_abc_profile', 1, 0.2::DOUBLE), ('abc_profile_to_abc', 2, 0.2::DOUBLE), ('phase_a_replay', 3, 0.1::DOUBLE)), x AS (SELECT (SELECT count(*) FROM sr) + 6 * (SELECT count(DISTINCT abc) FROM sr) AS total), q AS (SELECT family, k, CASE WHEN k < 3 THEN round_even(total * r, 0)::BIGINT ELSE 0 END AS q, total FROM n, x) SELECT family, (CASE WHEN k < 3 THEN q ELSE total - (SELECT sum(q) FROM q) END)::BIGINT AS quota FROM q")
def mix_quotas(spark, sf_dir):
    d = rows(spark, sf_dir)
    abc = d.select("abc").distinct().agg(F.count(F.lit(1)).alias("n"))
    one = lambda f, k: abc.select(F.lit(f).alias("family"), (F.col("n") * k).alias("n"))
    counts = d.agg(F.count(F.lit(1)).alias("n")).select(F.lit("full_sid_to_abc_profile").alias("family"), "n").unionByName(one("abc_to_abc_profile", 1)).unionByName(one("abc_profile_to_abc", 1)).unionByName(one("phase_a_replay", 4))
    return sampling.quotas(counts, sampling.PHASE_B2)


_MIX = f"""{_ROWS}, {_PROTO}, cn AS (SELECT category, count(*) AS cn FROM sr GROUP BY 1), rn AS (SELECT region, count(*) AS rn FROM sr GROUP BY 1), gn AS (SELECT geo_bucket, count(*) AS gn FROM sr GROUP BY 1),
pw AS (SELECT pr.*, greatest(1, round({_W} * 1000000))::BIGINT AS w FROM pr JOIN cn USING (category) JOIN rn USING (region) JOIN gn USING (geo_bucket) WHERE level = 'abc'),
ta AS (SELECT DISTINCT abc FROM sr),
f0 AS (SELECT full_sid || '::full_to_profile' AS sample_id, w FROM sr JOIN pw ON pw.prefix = abc), f1 AS (SELECT abc || '::abc_to_profile' AS sample_id, w FROM ta JOIN pw ON prefix = abc), f2 AS (SELECT abc || '::profile_to_abc' AS sample_id, 1 AS w FROM ta),
f3 AS (SELECT abc || k AS sample_id, 1 AS w FROM ta, (VALUES ('::a_to_profile'), ('::profile_to_a'), ('::ab_to_profile'), ('::profile_to_ab')) AS v(k)),
al AS (SELECT (SELECT count(*) FROM f0) + (SELECT count(*) FROM f1) + (SELECT count(*) FROM f2) + (SELECT count(*) FROM f3) AS total),
qs AS (SELECT round_even(total * 0.5::DOUBLE, 0)::BIGINT AS q0, round_even(total * 0.2::DOUBLE, 0)::BIGINT AS q1, total FROM al)"""
_FAMILIES = (("full_sid_to_abc_profile", "(SELECT q0 FROM qs)"), ("abc_to_abc_profile", "(SELECT q1 FROM qs)"), ("abc_profile_to_abc", "(SELECT q1 FROM qs)"), ("phase_a_replay", "(SELECT total - q0 - 2 * q1 FROM qs)"))


@query(f"WITH {_MIX}, " + ", ".join(_drawn_sql(f"f{k}", f"m{k}", "sample_id", size, f"42-{f}") for k, (f, size) in enumerate(_FAMILIES)) + " " + " UNION ALL ".join(f"SELECT '{f}' AS family, draw, sample_id FROM m{k}" for k, (f, _) in enumerate(_FAMILIES)))
def mixed_phase(spark, sf_dir):
    """The last phase's training mix; its rows follow the quotas, two families by weight, drawn with replacement."""
    d = cut(rows(spark, sf_dir))
    r = cut(sampling.weighted(semantic.records(d, cut(semantic.prototypes(d))), d))
    fam = {f: r.where(F.col("task_type") == f) for f, _ in sampling.PHASE_B2[:3]}
    fam["phase_a_replay"] = r.where(F.col("sid_level").isin("a", "ab"))
    return sampling.mixed(fam, sampling.PHASE_B2, weight="weight").select("family", "draw", "sample_id")


_RANK = """sp AS (SELECT sid_token AS sid, a, ab, abc, coalesce(n, 0) AS n FROM s LEFT JOIN (SELECT pid, count(*) AS n FROM c GROUP BY pid) USING (pid)),
be AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY abc ORDER BY n DESC, sid) AS k FROM sp) WHERE k = 1),
pa AS (SELECT t.sid AS target, o.sid AS candidate, o.n, 1 AS tier, row_number() OVER (PARTITION BY t.sid ORDER BY o.n DESC, o.sid) AS k FROM sp t JOIN sp o ON o.abc = t.abc AND o.sid <> t.sid),
pb AS (SELECT t.sid AS target, o.sid AS candidate, o.n, o.abc, 2 AS tier, row_number() OVER (PARTITION BY t.sid ORDER BY o.n DESC, o.sid) AS k FROM sp t JOIN be o ON o.ab = t.ab AND o.abc <> t.abc),
pc AS (SELECT t.sid AS target, o.sid AS candidate, o.n, o.abc, 3 AS tier, row_number() OVER (PARTITION BY t.sid ORDER BY o.n DESC, o.sid) AS k FROM sp t JOIN be o ON o.a = t.a AND o.ab <> t.ab),
nr AS (SELECT target, abc FROM pb WHERE k <= 2 UNION ALL SELECT target, abc FROM pc WHERE k <= 2),
pd AS (SELECT t.sid AS target, o.sid AS candidate, o.n, 4 AS tier FROM sp t JOIN be o ON o.abc <> t.abc WHERE NOT EXISTS (SELECT 1 FROM nr WHERE nr.target = t.sid AND nr.abc = o.abc)),
al AS (SELECT sid AS target, sid AS candidate, 0 AS tier, 0 AS n FROM sp UNION ALL SELECT target, candidate, tier, n FROM pa WHERE k <= 1 UNION ALL SELECT target, candidate, tier, n FROM pb WHERE k <= 2
    UNION ALL SELECT target, candidate, tier, n FROM pc WHERE k <= 2 UNION ALL SELECT target, candidate, tier, n FROM pd)"""


@query(f"WITH {CHECKINS_SQL}, {SIDS_SQL}, {_RANK} SELECT * FROM (SELECT target, candidate, tier, row_number() OVER (PARTITION BY target ORDER BY tier, n DESC, candidate)::INTEGER AS rank FROM al) WHERE rank <= 10")
def ranked_targets(spark, sf_dir):
    n = checkins(spark, sf_dir).groupBy("pid").agg(F.count(F.lit(1)).alias("n"))
    space = semantic.with_suffix(sids(spark, sf_dir)).join(n, "pid", "left").select(F.col("sid_token").alias("sid"), F.coalesce("n", F.lit(0)).alias("n"))
    return ranking.ranked_targets(space.select(F.col("sid").alias("target")), space)


@query(f"WITH {CHECKINS_SQL}, pl AS (SELECT DISTINCT pid, latitude, longitude FROM c) SELECT pid, round(cos(radians(latitude)) * cos(radians(longitude)), 9) AS x, round(cos(radians(latitude)) * sin(radians(longitude)), 9) AS y, round(sin(radians(latitude)), 9) AS z FROM pl")
def unit_sphere(spark, sf_dir):
    v = geo.sphere(F.col("latitude"), F.col("longitude"))
    return places(spark, sf_dir).select("pid", *[F.round(v[i], 9).alias(c) for i, c in enumerate("xyz")])


_WAVES = ", ".join(f"round(sum({w}(h * (2 * 3.141592653589793::DOUBLE / 24 * {k})) * n) / sum(n), 8) AS {w}{k}" for k in range(1, 7) for w in ("sin", "cos"))


@query(f"WITH {CHECKINS_SQL}, h AS (SELECT pid, hour(time_dt)::DOUBLE AS h, count(*)::DOUBLE AS n FROM c GROUP BY 1, 2) SELECT pid, {_WAVES} FROM h GROUP BY pid")
def time_features(spark, sf_dir):
    h = checkins(spark, sf_dir).groupBy("pid", F.hour("time_dt").alias("h")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    g = h.groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("h", "n"))).alias("s"))
    v = vector.time_features(F.transform("s", lambda x: x["h"]), F.transform("s", lambda x: x["n"]))
    names = [f"{w}{k}" for k in range(1, 7) for w in ("sin", "cos")]
    return g.withColumn("v", v).select("pid", *[F.round(F.col("v")[i], 8).alias(c) for i, c in enumerate(names)])


@query(r"SELECT p_partkey AS id, trim(regexp_replace(p_name || '  ' || chr(9) || p_type, '\s+', ' ', 'g')) AS category, (p_size // 2)::VARCHAR AS region, true AS whole, CASE WHEN p_size % 2 = 0 THEN (p_size // 2)::VARCHAR ELSE (p_size / 2)::VARCHAR END AS region2 FROM part")
def normalised_text(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    half = F.floor(F.col("p_size") / 2)
    return p.select(F.col("p_partkey").alias("id"), text.category(F.concat("p_name", F.lit("  \t"), "p_type")).alias("category"), text.region(F.concat(F.lit(" "), half.cast("string"), F.lit(".0"))).alias("region"), text.region_is_int(F.concat(half.cast("string"), F.lit(".0"))).alias("whole"), text.region((F.col("p_size") / 2).cast("string")).alias("region2"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
w AS (SELECT vec_id, v, CASE vec_id % 5 WHEN 1 THEN list_concat(v, [NULL, NULL]) WHEN 2 THEN list_concat(v, ['nan'::DOUBLE]) WHEN 3 THEN list_concat(v, ['inf'::DOUBLE, '-inf'::DOUBLE, 1.0]) ELSE v END AS x FROM v)
SELECT vec_id, len(x)::INTEGER AS length, len(list_filter(x, lambda y: y IS NULL))::INTEGER AS nulls, len(list_filter(x, lambda y: isnan(y)))::INTEGER AS nans, len(list_filter(x, lambda y: isinf(y)))::INTEGER AS infs,
round(sqrt(list_sum(list_transform(v, lambda y: y * y))), 6) AS norm, round(v[1] / sqrt(list_sum(list_transform(v, lambda y: y * y))), 6) AS first FROM w""")
def vector_health(spark, sf_dir):
    """Health of vectors to some of which nulls, NaN and infinities are added; norm and direction of the whole ones."""
    d = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    odd = lambda *xs: F.concat("v", F.array(*[F.lit(x).cast("double") for x in xs]))
    k = F.col("vec_id") % 5
    x = F.when(k == 1, odd(None, None)).when(k == 2, odd(float("nan"))).when(k == 3, odd(float("inf"), float("-inf"), 1.0)).otherwise(F.col("v"))
    h = d.withColumn("h", vector.health(x))
    return h.select("vec_id", *[F.col(f"h.{c}").alias(c) for c in ("length", "nulls", "nans", "infs")], F.round(vector.norm(F.col("v")), 6).alias("norm"), F.round(vector.unit(F.col("v"))[0], 6).alias("first"))


_CODE = """b AS (SELECT vec_id AS code, list_transform(embedding, lambda x: x::DOUBLE) AS v, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings WHERE vec_id < 16),
k AS (SELECT code, list_transform(v, lambda x: x / n) AS v FROM b), e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS r FROM embeddings),
m1 AS (SELECT vec_id, r, code, v, list_dot_product(r, v) AS s FROM e, k), a1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 9) DESC, code) AS q FROM m1) WHERE q = 1),
e2 AS (SELECT vec_id, code AS c1, list_transform(list_zip(r, v), lambda z: z[1] - z[2] * greatest(0, s)) AS r FROM a1),
m2 AS (SELECT vec_id, c1, code, list_dot_product(r, v) AS s FROM e2, k), a2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 9) DESC, code) AS q FROM m2) WHERE q = 1)"""


@query(f"WITH {_CODE} SELECT vec_id, c1::INTEGER AS code_1, code::INTEGER AS code_2 FROM a2")
def residual_codes(spark, sf_dir):
    """Two levels of residual cosine codes over a fixed codebook, in the bulk form."""
    import numpy as np

    from ..operators import quantise

    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    book = np.array([r["vec"] for r in e.where("vec_id < 16").orderBy("vec_id").collect()])
    book /= np.linalg.norm(book, axis=1, keepdims=True)
    got = quantise.assign(e, [book, book])
    return got.select("vec_id", F.col("indices")[0].alias("code_1"), F.col("indices")[1].alias("code_2"))


def trained_codes(spark, sf_dir):
    """Codebooks of three levels trained on the vectors; the SIDs with suffixes.

    Vectors that are null or empty, hold null or non-finite components, or have another length than most (of equally many, than the
    shortest), have no SID; so have all if there are no others.
    """
    from ..operators import quantise

    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    length = e.where(vector.finite(F.col("vec"))).groupBy(F.size("vec").alias("length")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "length").first()
    sound = vector.finite(F.col("vec")) & (F.size("vec") == F.lit(length["length"] if length else 0))
    without = e.where(~sound).select(F.col("id").alias("pid"), F.lit(None).cast("string").alias("sid_token"))
    if not length:
        return without
    sound = e.where(sound)
    books = quantise.train(sound, levels=3, k=16)
    coded = semantic.with_suffix(quantise.assign(sound, books).select(F.col("id").alias("pid"), "indices")).select("pid", "sid_token")
    return coded.unionByName(without)


QUERIES["trained_codes"] = trained_codes


@query(f"WITH {CHECKINS_SQL}, h AS (SELECT pid, hour(time_dt)::DOUBLE AS h, count(*)::DOUBLE AS n FROM c GROUP BY 1, 2), f AS (SELECT pid, {_WAVES} FROM h GROUP BY pid), cv AS (SELECT 'cat' || vec_id AS value, embedding FROM embeddings WHERE vec_id < 5), pl AS (SELECT DISTINCT pid, category, latitude, longitude FROM c) SELECT pid, 79::INTEGER AS length, round(coalesce(embedding[1]::DOUBLE, 0), 6) AS c1, round(coalesce(embedding[64]::DOUBLE, 0), 6) AS c64, round(sin(radians(latitude)), 8) AS z, sin1, cos6 FROM pl JOIN f USING (pid) LEFT JOIN cv ON cv.value = category")
def place_vectors(spark, sf_dir):
    """Vectors of 64 + 3 + 12 numbers; categories 5 and 6 have no vector of their own and get zeros."""
    from ..operators import embedding
    from ..operators.places import hour_histogram

    cats = table(spark, sf_dir, "embeddings").where("vec_id < 5").select(F.concat(F.lit("cat"), F.col("vec_id").cast("string")).alias("value"), F.col("embedding").cast("array<double>").alias("vec"))
    p = places(spark, sf_dir).join(hour_histogram(checkins(spark, sf_dir).withColumn("hour", F.hour("time_dt")), "pid", "hour"), "pid")
    v = embedding.place_vectors(p, cats, 64)
    at = lambda i, n, d=6: F.round(F.col("vec")[i], d).alias(n)
    return v.select("pid", F.size("vec").alias("length"), at(0, "c1"), at(63, "c64"), at(66, "z", 8), at(67, "sin1", 8), at(78, "cos6", 8))


@query(f"WITH {CHECKINS_SQL}, m AS (SELECT DISTINCT pid, pid % 3 > 0 AS has FROM c), g AS (SELECT pid, count(DISTINCT uid)::BIGINT AS unique_user_count, count(*)::BIGINT AS visit_count, string_agg(DISTINCT hour(utc_ts)::VARCHAR, ',') AS x FROM c WHERE pid % 3 > 0 GROUP BY pid), hh AS (SELECT pid, string_agg(h || ':' || n, ',' ORDER BY h) AS histogram FROM (SELECT pid, hour(utc_ts) AS h, count(*) AS n FROM c WHERE pid % 3 > 0 GROUP BY 1, 2) GROUP BY pid) SELECT m.pid AS \"Pid\", CASE WHEN has THEN 'cat' || (m.pid % 7) ELSE 'old' || m.pid END AS category, coalesce(unique_user_count, 0)::BIGINT AS unique_user_count, coalesce(visit_count, 0)::BIGINT AS visit_count, coalesce(histogram, '') AS histogram FROM m LEFT JOIN g USING (pid) LEFT JOIN hh USING (pid)")
def import_enrichment(spark, sf_dir):
    """Place information joined with the check-ins of mapped places; the mapping leaves every third place out."""
    from ..sources.imported import enriched

    c = checkins(spark, sf_dir)
    raw = c.select(F.col("uid").alias("original_uid"), F.concat(F.lit("p"), F.col("pid").cast("string")).alias("Original_Pid"), "category", "category_id", "latitude", "longitude", "utc_ts")
    mapping = c.select("pid").distinct().where("pid % 3 > 0").select(F.concat(F.lit("p"), F.col("pid").cast("string")).alias("Original_Pid"), F.col("pid").alias("Mapped_Pid"))
    info = c.select(F.col("pid").alias("Pid")).distinct().withColumns({"Catname": F.concat(F.lit("old"), F.col("Pid").cast("string")), "Region": F.lit(7)})
    hist = F.array_join(F.transform(F.map_entries("visit_time_and_count"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    return enriched(info, raw, mapping).select("Pid", "category", F.coalesce("unique_user_count", F.lit(0)).alias("unique_user_count"), F.coalesce("visit_count", F.lit(0)).alias("visit_count"), hist.alias("histogram"))
