"""Prefix semantics: suffixes for colliding codes, rows, prototypes, purity, hard negatives, records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, profile, prompts, sid
from ..functions.draws import draw
from ..session import cut
from .base import positions

LEVELS = ("a", "ab", "abc")


def with_suffix(codes: DataFrame) -> DataFrame:
    """(pid, indices) to sid_indices and sid_token: places that share a code get 0, 1, 2, ... in pid order behind it."""
    n = F.count(F.lit(1)).over(Window.partitionBy("indices"))
    k = F.row_number().over(Window.partitionBy("indices").orderBy("pid")) - 1
    full = F.when(n > 1, F.concat("indices", F.array(k))).otherwise(F.col("indices"))
    return codes.withColumn("sid_indices", full).withColumn("sid_token", sid.token(F.col("sid_indices")))


def collision_rate(codes: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return codes.agg(n.alias("rows"), F.countDistinct("indices").alias("codes"), ((n - F.countDistinct("indices")) / F.greatest(n, F.lit(1))).alias("collision_rate"))


def rows(places: DataFrame, sids: DataFrame, grid: int = 8) -> DataFrame:
    """Places with a SID, their prefixes and geo bucket; bounds are those of matched places, one row that is broadcast."""
    d = places.join(sids.select("pid", F.col("sid_token").alias("full_sid")), "pid")
    box = d.agg(F.min("latitude").alias("y0"), F.max("latitude").alias("y1"), F.min("longitude").alias("x0"), F.max("longitude").alias("x1"))
    d = d.crossJoin(F.broadcast(box))
    cell = geo.bucket(F.col("latitude"), F.col("longitude"), F.col("y0"), F.col("y1"), F.col("x0"), F.col("x1"), grid)
    return d.withColumns({lv: sid.prefix(F.col("full_sid"), lv) for lv in LEVELS}).withColumn("geo_bucket", cell).drop("y0", "y1", "x0", "x1")


def _long(d: DataFrame) -> DataFrame:
    """(level, prefix, field, value) of the fields each level has."""
    parts = F.array(*[F.struct(F.lit(lv).alias("level"), F.col(lv).alias("prefix"), F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for lv in LEVELS for f in profile.FIELDS[lv]])
    return d.select(F.explode(parts).alias("x")).select("x.*")


def prototypes(d: DataFrame) -> DataFrame:
    """(level, prefix, category, region, geo_bucket, member_count, profile_json): the mode of each field.

    Ties: more frequent over all rows, then the smaller text; for geo buckets the smaller text at once.
    """
    local = _long(d).groupBy("level", "prefix", "field", "value").agg(F.count(F.lit(1)).alias("n"))
    world = local.where("level = 'abc'").groupBy("field", "value").agg(F.sum("n").alias("g"))
    best = local.join(world, ["field", "value"]).withColumn("g", F.when(F.col("field") == "geo_bucket", 0).otherwise(F.col("g")))
    top = F.row_number().over(Window.partitionBy("level", "prefix", "field").orderBy(F.col("n").desc(), F.col("g").desc(), "value"))
    best = best.withColumn("r", top).where("r = 1")
    wide = best.groupBy("level", "prefix").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in profile.FIELDS["abc"]])
    sizes = d.select(F.explode(F.array(*[F.struct(F.lit(lv).alias("level"), F.col(lv).alias("prefix")) for lv in LEVELS])).alias("x")).groupBy("x.level", "x.prefix").agg(F.count(F.lit(1)).alias("member_count"))
    js = F.coalesce(*[F.when(F.col("level") == lv, profile.to_json(lv, F.col("category"), F.col("region"), F.col("geo_bucket"))) for lv in LEVELS])
    return wide.join(sizes, ["level", "prefix"]).withColumn("profile_json", js)


def purity(d: DataFrame) -> DataFrame:
    """(level, field, num_groups, mean, median, min, max) of the largest value's share in each group."""
    local = _long(d).groupBy("level", "prefix", "field", "value").agg(F.count(F.lit(1)).alias("n"))
    share = local.groupBy("level", "prefix", "field").agg((F.max("n") / F.sum("n")).alias("s"))
    share = cut(share)  # it is read for each pass below
    figures = share.groupBy("level", "field").agg(F.count(F.lit(1)).alias("num_groups"), F.avg("s").alias("mean"), F.min("s").alias("min"), F.max("s").alias("max"))
    return figures.join(medians(share, ["level", "field"], "s"), ["level", "field"]).select("level", "field", "num_groups", "mean", "median", "min", "max")


def medians(d: DataFrame, by: list[str], share: str, bits: tuple[int, ...] = (16, 32)) -> DataFrame:
    """(by, median) of shares from 0 to 1, exactly, for a few groups of any size.

    Shares are counted by bins of 2^-16, then those in a middle bin by bins of 2^-32, then by value in the middle one; a pass counts
    where the rows are and sends a row a bin, so no group's shares come together. The bins asked for are two a group, in a broadcast.
    """
    v = d.select(*by, F.col(share).alias("_s")).where("_s is not null")
    n = v.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    asked = n.select(*by, F.explode(F.array(F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2))).alias("_rank"), F.lit(0).cast("double").alias("_in")).withColumn("_k", F.monotonically_increasing_id())
    below = lambda keys: Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    inside = v.withColumn("_in", F.lit(0).cast("double"))
    for width in (*[float(1 << b) for b in bits], None):
        inside = inside.withColumn("_bin", F.col("_s") if width is None else F.floor(F.col("_s") * width).cast("double"))
        counts = inside.groupBy(*by, "_in", "_bin").agg(F.count(F.lit(1)).alias("_c"))
        counts = counts.withColumn("_before", F.coalesce(F.sum("_c").over(below([*by, "_in"])), F.lit(0)))
        met = counts.join(F.broadcast(asked), [*by, "_in"]).where((F.col("_before") <= F.col("_rank")) & (F.col("_rank") < F.col("_before") + F.col("_c")))
        asked = cut(met.select(*by, (F.col("_rank") - F.col("_before")).alias("_rank"), F.col("_bin").alias("_in"), "_k"))  # two rows a group
        if width is not None:
            bins = asked.select(*by, F.col("_in").alias("_bin")).distinct()
            inside = inside.join(F.broadcast(bins), [*by, "_bin"], "left_semi").select(*by, "_s", F.col("_bin").alias("_in"))
    return asked.groupBy(*by).agg(F.avg("_in").alias("median"))


def _firsts(q: DataFrame, group: list[str], other: list[str], keep: int) -> DataFrame:
    """In each group, the least prefix of each value of `other`, for its `keep` least values: one of them is not the value one has oneself."""
    each = q.groupBy(*group, *other).agg(F.min("n_prefix").alias("n_prefix"))
    if not group:
        return each.orderBy(*other, "n_prefix").limit(keep)
    order = F.row_number().over(Window.partitionBy(*group).orderBy(*other, "n_prefix"))
    return each.withColumn("k", order).where(F.col("k") <= keep).drop("k")


def hard_negatives(protos: DataFrame, level: str, count: int = 3, seed: int = 42) -> DataFrame:
    """(positive, negatives): at most one prefix by each of the level's rules, filled up by hash to `count`, sorted.

    A rule that asks for another value can only pick the least prefix of the two least values, so a prefix never meets all of its
    category or region: at level ab two, at level abc two for each of the grid's cells, which geo buckets bound.
    """
    p = protos.where(F.col("level") == level).select("prefix", "category", "region", "geo_bucket")
    q = p.select(*[F.col(c).alias(f"n_{c}") for c in p.columns])
    differs = lambda c: F.col(c) != F.col(f"n_{c}")
    same = lambda c: F.col(c) == F.col(f"n_{c}")
    away = geo.bucket_distance(F.col("geo_bucket"), F.col("n_geo_bucket"))
    if level == "a":
        rules = [(p.join(F.broadcast(_firsts(q, [], ["n_category"], 2)), differs("category")), ["n_category", "n_prefix"])]  # two rows
    elif level == "ab":
        rules = [
            (p.join(_firsts(q, ["n_category"], ["n_region"], 2), same("category") & differs("region")), ["n_region", "n_prefix"]),
            (p.join(_firsts(q, ["n_region"], ["n_category"], 2), same("region") & differs("category")), ["n_category", "n_prefix"]),
        ]
    else:
        far = F.coalesce(away.cast("double"), F.lit(float("inf")))
        # Prefixes of one category, region and cell share their picks, so these meet and the prefixes get the result.
        kinds = p.select("category", "region", "geo_bucket").distinct()
        cells = F.broadcast(_firsts(q.where(F.col("n_geo_bucket").isNotNull()), ["n_geo_bucket"], ["n_category"], 2))  # two rows a cell of the grid
        alike = q.groupBy("n_category", "n_region", "n_geo_bucket").agg(F.min("n_prefix").alias("n_prefix"))
        rules = [
            (kinds.join(_firsts(q, ["n_category", "n_geo_bucket"], ["n_region"], 2), same("category") & differs("region")).withColumn("d", far), ["d", "n_region", "n_prefix"]),
            (kinds.join(alike, same("category") & same("region") & differs("geo_bucket")).withColumn("d", far), ["d", "n_prefix"]),
            (kinds.join(cells, differs("category")).withColumn("d", away).where("d is not null"), ["d", "n_category", "n_prefix"]),
        ]
        own = ["category", "region", "geo_bucket"]
        meets = F.col("category").eqNullSafe(F.col("_c")) & F.col("region").eqNullSafe(F.col("_r")) & F.col("geo_bucket").eqNullSafe(F.col("_g"))

        def back(d: DataFrame, order: list[str]) -> DataFrame:
            best = d.withColumn("k", F.row_number().over(Window.partitionBy(*own).orderBy(*order))).where("k = 1")
            return p.join(best.select(F.col("category").alias("_c"), F.col("region").alias("_r"), F.col("geo_bucket").alias("_g"), *order), meets)

        rules = [(back(d, order), order) for d, order in rules]
    picked = None
    for k, (d, order) in enumerate(rules):
        best = d.withColumn("k", F.row_number().over(Window.partitionBy("prefix").orderBy(*order))).where("k = 1").select(F.col("prefix").alias("positive"), F.col("n_prefix").alias("negative"), F.lit(k).alias("rule"))
        picked = best if picked is None else picked.unionByName(best)
    # The fill: `count` + 1 + rules prefixes that come first in the positive's own hash order hold enough that are not picked yet.
    # All prefixes share one hash order on a ring; each positive starts at its own place, so no positive meets all prefixes.
    ring = p.select("prefix", draw(f"{seed}-ring-{level}", F.col("prefix")).alias("u"))
    ring = positions(ring, [F.col("u"), F.col("prefix")], "place").select("prefix", (F.col("place") - 1).alias("place"))
    n = ring.count()
    span = min(count + len(rules), max(0, n - 1))
    steps = ring.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(span)))) if span else ring.withColumn("step", F.lit(0)).limit(0)
    steps = steps.withColumn("to", F.pmod(F.col("place") + F.col("step"), F.lit(max(1, n))))
    fill = steps.join(ring.select(F.col("place").alias("to"), F.col("prefix").alias("negative")), "to").select(F.col("prefix").alias("positive"), "negative", (F.col("step") + 100).alias("rule"))
    every = picked.unionByName(fill).where("positive <> negative").groupBy("positive", "negative").agg(F.min("rule").alias("rule"))
    kept = every.withColumn("k", F.row_number().over(Window.partitionBy("positive").orderBy("rule", "negative"))).where(F.col("k") <= count)
    return p.select(F.col("prefix").alias("positive")).join(kept.groupBy("positive").agg(F.array_sort(F.collect_list("negative")).alias("negatives")), "positive", "left").withColumn("negatives", F.coalesce("negatives", F.array().cast("array<string>")))


def split_prefixes(prefixes: DataFrame, ratio: float, seed: int = 42) -> DataFrame:
    """(abc, valid): max(1, int(n ratio)) prefixes are for validation, by hash order; none left for training is an error."""
    if not 0 < ratio < 1:
        raise ValueError("ratio must lie between 0 and 1")
    d = prefixes.select("abc").distinct()
    placed = positions(d.withColumn("_u", draw(f"{seed}-abc", F.col("abc"))), [F.col("_u"), F.col("abc")], "_place")
    n = placed.count()
    valid = max(1, int(n * ratio))
    if valid >= n:
        raise ValueError("the ratio leaves no prefix for training")
    return placed.select("abc", (F.col("_place") <= valid).alias("valid"))


def _record(d: DataFrame, task: str, level: str, source: Column, target: Column, text: Column, output: Column, suffix: str, key: Column, candidates: Column | None = None) -> DataFrame:
    has = profile.FIELDS[level] if level in profile.FIELDS else profile.FIELDS["abc"]
    return d.select(
        F.lit(task).alias("task_type"), F.lit(level).alias("sid_level"), source.alias("source_sid"), F.col("abc").alias("source_abc"), target.alias("target_prefix"), F.col("category").alias("category"),
        (F.col("region") if "region" in has else F.lit(None).cast("string")).alias("region"), (F.col("geo_bucket") if "geo_bucket" in has else F.lit(None).cast("string")).alias("geo_bucket"),
        F.lit(prompts.TASKS[task]).alias("instruction"), text.alias("input"), output.alias("output"), F.concat(key, F.lit(f"::{suffix}")).alias("sample_id"),
        (candidates if candidates is not None else F.lit(None).cast("array<string>")).alias("candidate_prefixes"),
    )


def records(d: DataFrame, protos: DataFrame, abc: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """All alignment records: for each abc prefix two of each level, and one of each full SID; abc restricts the prefixes."""
    tops = d.select("a", "ab", "abc").distinct()
    tops = tops if abc is None else tops.join(abc.select("abc"), "abc", "left_semi")
    names = {"a": ("a_to_category_profile", "category_profile_to_a"), "ab": ("ab_to_category_region_profile", "category_region_profile_to_ab"), "abc": ("abc_to_abc_profile", "abc_profile_to_abc")}
    out = None
    for lv in LEVELS:
        neg = hard_negatives(protos, lv, seed=seed).withColumnRenamed("positive", "_p")
        one = protos.where(F.col("level") == lv).select(F.col("prefix").alias("_x"), "category", "region", "geo_bucket", "profile_json")
        j = tops.join(one, F.col(lv) == F.col("_x")).join(neg, F.col(lv) == F.col("_p"))
        cand = F.array_sort(F.concat(F.array(F.col(lv)), "negatives"))
        there = _record(j, names[lv][0], lv, F.col(lv), F.col(lv), F.concat(F.lit(f"Semantic prefix (level {lv}): "), F.col(lv)), F.col("profile_json"), f"{lv}_to_profile", F.col("abc"))
        ask = F.concat(F.lit("Semantic profile: "), "profile_json", F.lit("\nCandidate prefixes: "), F.array_join(cand, " "))
        back = _record(j, names[lv][1], lv, F.col(lv), F.col(lv), ask, F.col(lv), f"profile_to_{lv}", F.col("abc"), cand)
        out = there.unionByName(back) if out is None else out.unionByName(there).unionByName(back)
    one = protos.where(F.col("level") == "abc").select(F.col("prefix").alias("_x"), "category", "region", "geo_bucket", "profile_json")
    full = d.select("full_sid", "abc").join(one, F.col("abc") == F.col("_x"))
    full = full if abc is None else full.join(abc.select("abc"), "abc", "left_semi")
    return out.unionByName(_record(full, "full_sid_to_abc_profile", "full_sid", F.col("full_sid"), F.col("abc"), F.concat(F.lit("Semantic ID: "), "full_sid"), F.col("profile_json"), "full_to_profile", F.col("full_sid")))


def task_counts(records: DataFrame) -> DataFrame:
    """(task_type, n) in the order of the tasks' names."""
    return records.groupBy("task_type").agg(F.count(F.lit(1)).alias("n")).orderBy("task_type")


def task_records(records: DataFrame, task_type: str, limit: int | None = None) -> DataFrame:
    """The records of one task; with a limit, which is what is asked for, the first ones by sample_id."""
    d = records.where(F.col("task_type") == task_type)
    return d if limit is None else d.orderBy("sample_id").limit(limit)
