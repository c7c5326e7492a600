"""Weights, seeded sampling with replacement, mixes of task families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import draw, fine_draw

# The task mixes of the two later phases.
PHASE_B1 = (("full_sid_to_abc_profile", 0.75), ("abc_to_abc_profile", 0.25))
PHASE_B2 = (("full_sid_to_abc_profile", 0.50), ("abc_to_abc_profile", 0.20), ("abc_profile_to_abc", 0.20), ("phase_a_replay", 0.10))


def forward_weight(region_n: Column, category_n: Column, geo_n: Column) -> Column:
    """region^-0.35 category^-0.15 geo^-0.20 within [0.1, 1]."""
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.pow(region_n.cast("double"), F.lit(-0.35)) * F.pow(category_n.cast("double"), F.lit(-0.15)) * F.pow(geo_n.cast("double"), F.lit(-0.20))))


def candidate_weight(category_n: Column, region_n: Column) -> Column:
    return 1 / F.sqrt(category_n.cast("double") * region_n.cast("double"))


#: Weights are summed in whole millionths, so that sums are the same in any order.
UNIT = 1_000_000
#: Items of a bucket whose weights one task adds up, and items and draws that a cell is meant to have.
BUCKET, CELL = 1 << 16, 64


def weighted(records: DataFrame, rows: DataFrame) -> DataFrame:
    """Adds weight: the inverse frequency of a record's category, region and cell among the semantic rows; what they lack counts as one."""
    d = records
    for c in ("category", "region", "geo_bucket"):
        n = rows.groupBy(F.col(c).alias(f"_{c}")).agg(F.count(F.lit(1)).alias(f"_n_{c}"))
        d = d.join(n, F.col(c) == F.col(f"_{c}"), "left").drop(f"_{c}")
    count = lambda c: F.coalesce(F.col(f"_n_{c}"), F.lit(1))
    return d.withColumn("weight", forward_weight(count("region"), count("category"), count("geo_bucket"))).drop(*[f"_n_{c}" for c in ("category", "region", "geo_bucket")])


def with_replacement(items: DataFrame, key: str, size: int, seed: int | str, weight: Column | None = None) -> DataFrame:
    """`size` draws from items, uniform or by weight: (draw, and the item's columns); no items give no draws.

    Each item has a stretch of the whole numbers below the sum of weights: its hash bucket's offset and the running sum in the
    bucket, of which there are as many as keep a bucket at BUCKET items. The numbers are cut into cells of about CELL items and draws,
    an item is sent to each cell that its stretch touches, and a draw meets the items of its own cell only.
    """
    w = F.greatest(F.lit(1), F.round(weight * UNIT)).cast("bigint") if weight is not None else F.lit(1).cast("bigint")
    d = items.withColumn("_w", w)
    n, total = d.agg(F.count(F.lit(1)), F.coalesce(F.sum("_w"), F.lit(0))).first()
    if not n or size <= 0:
        return d.sparkSession.range(0).select(F.col("id").alias("draw")).crossJoin(items.limit(0))
    d = d.withColumn("_b", F.floor(fine_draw(f"{seed}-bucket", F.col(key)) * -(-n // BUCKET)).cast("bigint"))
    sums = d.groupBy("_b").agg(F.sum("_w").alias("_s"))  # a row a bucket
    upto = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_b", F.coalesce(F.sum("_s").over(upto), F.lit(0)).alias("_from"))
    d = d.withColumn("_hi", F.sum("_w").over(Window.partitionBy("_b").orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow))).join(sums, "_b")
    d = d.withColumns({"_hi": F.col("_hi") + F.col("_from"), "_lo": F.col("_hi") + F.col("_from") - F.col("_w")})
    width = max(1, -(-total * CELL // (n + size)))
    cell = lambda c: F.floor(c / width).cast("bigint")
    d = d.withColumn("_cell", F.explode(F.sequence(cell(F.col("_lo")), cell(F.col("_hi") - 1))))
    at = d.sparkSession.range(size).select(F.col("id").alias("draw"), F.floor(fine_draw(f"{seed}-draw", F.col("id")) * float(total)).cast("bigint").alias("_v")).withColumn("_at", cell(F.col("_v")))
    met = d.join(at, (F.col("_cell") == F.col("_at")) & (F.col("_v") >= F.col("_lo")) & (F.col("_v") < F.col("_hi")))
    return met.select("draw", *[F.col(f"`{c}`") for c in items.columns])


def quotas(counts: DataFrame, mix: tuple[tuple[str, float], ...]) -> DataFrame:
    """(family, quota) from (family, n): round-half-even shares of the total, the last family takes what is left."""
    spark = counts.sparkSession
    total = counts.agg(F.sum("n").alias("total"))
    shares = spark.createDataFrame([(k, f, r, k == len(mix) - 1) for k, (f, r) in enumerate(mix)], "k int, family string, ratio double, last boolean").crossJoin(total)
    share = shares.withColumn("q", F.when(F.col("last"), 0).otherwise(F.bround(F.col("total") * F.col("ratio")).cast("bigint")))
    rest = F.col("total") - F.sum("q").over(Window.partitionBy())
    return share.select("family", F.when(F.col("last"), rest).otherwise(F.col("q")).cast("bigint").alias("quota"))


#: The families whose records are drawn by weight.
WEIGHTED = ("full_sid_to_abc_profile", "abc_to_abc_profile")


def mixed(families: dict[str, DataFrame], mix: tuple[tuple[str, float], ...], key: str = "sample_id", seed: int = 42, weight: str | None = None) -> DataFrame:
    """Families in their shares of all rows, sampled with replacement, in hash order; weight: the column that the WEIGHTED ones have it in."""
    counts = None
    for f, d in families.items():
        n = d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(f).alias("family"), "n")
        counts = n if counts is None else counts.unionByName(n)
    sizes = {r["family"]: r["quota"] for r in quotas(counts, mix).collect()}  # one row a family
    out = None
    for f, d in families.items():
        if sizes.get(f, 0) > 0:
            part = with_replacement(d, key, sizes[f], f"{seed}-{f}", F.col(weight) if weight and f in WEIGHTED else None).withColumn("family", F.lit(f))
            out = part if out is None else out.unionByName(part)
    if out is None:  # no family has a row
        first = next(iter(families.values()))
        out = with_replacement(first, key, 0, seed).withColumn("family", F.lit(""))
    return out.orderBy(draw(f"{seed}-order", F.concat_ws("|", "family", F.col("draw").cast("string"))))


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """A repeatable order by hash."""
    return df.orderBy(draw(seed, F.col(key)), key)


def negatives(prefixes: DataFrame, positive: str, incompatible: list[str], count: int, seed: int = 42) -> DataFrame:
    """The simple sampler: neither the positive nor a prefix with an incompatible profile; sorted."""
    left = prefixes.where((F.col("prefix") != positive) & ~F.col("profile_json").isin(incompatible or [""]))
    return left.orderBy(draw(seed, F.col("prefix")), "prefix").limit(count).orderBy("prefix")
