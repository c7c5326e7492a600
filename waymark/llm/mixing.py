"""Mixing sources to target weights by systematic sampling.

Targets: sources in code-point order (null last) weigh 1, 2, 3, repeating, and share all words; no target is above three times
its source's words, and what is over is shared again by weight. With w the weights and s the sizes the fixed point is
min(3 s, L w) with one level L, which prefix sums over the sources, ordered by 3 s / w, give without iterating.

Copies: documents stand in a fixed order, one random offset is added to the prefix sums of their expected copies, and a document is
emitted once for each whole number its interval crosses. The order: by size class (eight for each doubling), the largest first, in it
by hash bucket, in that by size. The expected copies are those of the class: of the words that the target still asks for, by the
number of copies the classes before get and their mean sizes, over the words that are left; at most 3. So where a few very large
documents are taken or not, the smaller ones after them make up for it. Rates and sums are whole numbers of 2^-20, so no rounding
depends on the order of work. The prefix sum is the class's, the stretch's offset in it and the place in the stretch, so a source
that holds a third of all rows, or many documents of one size, is spread over its stretches; there are as many hash buckets as keep
a stretch at STRETCH rows. Classes are at most eight for each doubling of the largest size, so a source's are one short array.

Edge cases: null and empty texts have size 0 and are drawn like others; a source of size 0 has target 0; no words at all: all
targets 0; a null source is a source of its own; rows without a doc_id are spread and ordered by their text; rows with equal doc_id
are ordered by their text too, and where that is equal as well they are copies of each other, of which any may be taken; a very long
text is one row like others; extra columns pass through whatever their names; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, draw, materialise, packed, table, unpacked

WEIGHTS = (1, 2, 3)
MOST = 3
SEED = "mix-1"
#: Rows that a hash bucket is meant to have; the stretches of all size classes in it share them.
STRETCH = 1 << 16
#: Rates and sums are whole numbers of 2^-BITS copies.
BITS = 20
UNIT = 1 << BITS


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("bigint"), F.lit(0).cast("bigint"))


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds size, the number of words; a column of this name is replaced."""
    return docs.withColumn("size", words(F.col(text)))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) to source, source_size, target. One row a source, so the windows over all rows here are small."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    kind = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    w = F.element_at(F.array(*[F.lit(x).cast("bigint") for x in weights]), (kind + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("cap", F.lit(most).cast("bigint") * F.col("source_size"))
    everything = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = everything.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    s = s.withColumn("ratio", F.col("cap").cast("double") / F.col("w"))
    s = s.withColumns({"total": F.sum("source_size").over(all_rows), "weights": F.sum("w").over(all_rows)})
    # The level if exactly the sources before this one stop at their cap; it holds from the first one that stays under it on.
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / (F.col("weights") - F.coalesce(F.sum("w").over(before), F.lit(0))))
    s = s.withColumn("held", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(all_rows)["level"])
    return s.select("source", "source_size", F.when(F.col("ratio") < F.col("held"), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("held") * F.col("w"))).alias("target"))


def rates(classes: DataFrame, goal: DataFrame, most: int = MOST, seed: str = SEED) -> DataFrame:
    """(mark, source, klass, rows, words) by class to (mark, klass, before, rate, offset, source_size, target): sums and rates in UNIT parts of a copy."""
    offset = F.shiftright(draw(seed, F.col("source")), 12)
    each = classes.groupBy("mark", "source").agg(F.sort_array(F.collect_list(F.struct("klass", "rows", "words")), asc=False).alias("classes"))  # a short array a source
    each = each.join(goal, F.col("source").eqNullSafe(F.col("_g"))).withColumn("offset", offset)
    plain = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))

    def step(state: Column, c: Column) -> Column:
        asked = F.when(state["left"] > 0, F.least(F.lit(float(most)), F.greatest(F.lit(0.0), state["wanted"] / state["left"]))).otherwise(plain)
        rate = F.floor(asked * UNIT).cast("bigint")
        after = state["sum"] + c["rows"] * rate
        got = F.shiftright(after + F.col("offset"), BITS) - F.shiftright(state["sum"] + F.col("offset"), BITS)
        one = F.struct(c["klass"].alias("klass"), state["sum"].alias("before"), rate.alias("rate"))
        return F.struct(
            (state["wanted"] - got * (c["words"] / c["rows"])).alias("wanted"), (state["left"] - c["words"]).alias("left"), after.alias("sum"), F.concat(state["out"], F.array(one)).alias("out")
        )

    empty = F.array().cast("array<struct<klass:string,before:bigint,rate:bigint>>")
    start = F.struct(F.col("target").alias("wanted"), F.col("source_size").alias("left"), F.lit(0).cast("bigint").alias("sum"), empty.alias("out"))
    each = each.withColumn("out", F.aggregate("classes", start, step, lambda s: s["out"]))
    return each.select("mark", "offset", "source_size", "target", F.inline("out"))


def drawn(d: DataFrame, stretch_rows: int = STRETCH, seed: str = SEED) -> DataFrame:
    """Adds source_size, target and copies to (key, source, size, tie) and whatever else there is; tie: a digest of the text."""
    buckets = max(1, -(-d.count() // stretch_rows))
    bits = F.bin(F.col("size") + 1)
    stretch = F.concat(F.lpad(F.length(bits).cast("string"), 2, "0"), F.rpad(F.substring(bits, 2, 3), 3, "0"), F.lit("-"), F.lpad(F.pmod(draw(seed, F.col("key"), F.col("tie")), F.lit(buckets)).cast("string"), 12, "0"))
    # A mark that is never null stands for the source, so that the window and the join below share one dealing of the rows.
    d = d.withColumns({"bucket": stretch, "mark": F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))})
    counted = materialise(d.groupBy("source", "mark", "bucket").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("words")))  # a row a stretch
    counted = counted.withColumn("klass", F.substring("bucket", 1, 5))
    goal = targets(counted.groupBy("source").agg(F.sum("words").alias("source_size"))).withColumnRenamed("source", "_g")
    classes = rates(counted.groupBy("mark", "source", "klass").agg(F.sum("rows").alias("rows"), F.sum("words").alias("words")), goal, seed=seed)
    upto = Window.partitionBy("mark", "klass").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counted.select("mark", "klass", "bucket", F.coalesce(F.sum("rows").over(upto), F.lit(0)).alias("first"))
    first = first.join(classes, ["mark", "klass"]).drop("klass")
    place = F.row_number().over(Window.partitionBy("mark", "bucket").orderBy("size", F.col("key").asc_nulls_last(), F.col("tie").asc_nulls_last()))
    d = d.withColumn("place", place).join(first, ["mark", "bucket"])
    upper = F.col("before") + F.col("offset") + (F.col("first") + F.col("place")) * F.col("rate")
    crossed = F.shiftright(upper, BITS) - F.shiftright(upper - F.col("rate"), BITS)
    return d.withColumn("copies", crossed.cast("bigint")).drop("bucket", "place", "first", "mark", "before", "rate", "offset")


def _inputs(docs: DataFrame, key: str, text: str, source: str) -> dict[str, Column]:
    return {"key": F.col(f"`{key}`"), "source": F.col(f"`{source}`"), "size": words(F.col(f"`{text}`")), "tie": F.md5(f"`{text}`")}


def copies(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", stretch_rows: int = STRETCH) -> DataFrame:
    """Adds size, source_size, target and copies; columns of these names are replaced."""
    d = drawn(packed(docs, **_inputs(docs, key, text, source)), stretch_rows)
    return unpacked(d, docs.columns, **{c: F.col(c) for c in ("size", "source_size", "target", "copies")})


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mixed documents: each row as often as it has copies, with the columns it came with."""
    d = drawn(packed(docs, **_inputs(docs, key, text, source)))
    times = d.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return unpacked(times, docs.columns)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts are read once: what the sampling needs of a document is written out."""
    docs = table(spark, sf_dir, "documents")
    c = drawn(materialise(docs.select(*[x.alias(n) for n, x in _inputs(docs, "doc_id", "text", "source").items()])))
    return c.select(F.col("key").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE = rf"""
WITH RECURSIVE d0 AS (SELECT doc_id, source, coalesce('=' || source, '') AS mark, md5(text) AS tie, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size, greatest(1, (count(*) OVER () + {STRETCH} - 1) // {STRETCH})::BIGINT AS buckets FROM documents),
d AS (SELECT *, lpad(length(bin(size + 1))::VARCHAR, 2, '0') || rpad(substr(bin(size + 1), 2, 3), 3, '0') AS klass,
    lpad((('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '\N') || '|' || coalesce(tie, '\N')), 1, 8))::BIGINT % buckets)::VARCHAR, 12, '0') AS bucket FROM d0),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT source, source_size, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::BIGINT AS w, (3 * source_size)::BIGINT AS cap FROM s0),
s2 AS (SELECT *, cap::DOUBLE / w AS ratio, sum(source_size) OVER () AS total, sum(w) OVER () AS weights FROM s1),
s3 AS (SELECT *, (total - coalesce(sum(cap) OVER p, 0))::DOUBLE / (weights - coalesce(sum(w) OVER p, 0))::DOUBLE AS level FROM s2
    WINDOW p AS (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, (SELECT level FROM s3 WHERE level <= ratio ORDER BY ratio, level LIMIT 1) AS held FROM s3),
s5 AS (SELECT coalesce('=' || source, '') AS mark, source_size, CASE WHEN ratio < held THEN cap::DOUBLE ELSE least(cap::DOUBLE, held * w) END AS target, ('0x' || substr(md5('{SEED}|' || coalesce(source, '\N')), 1, 8))::BIGINT >> 12 AS u FROM s4),
k AS (SELECT mark, klass, count(*)::BIGINT AS n, sum(size)::BIGINT AS w, row_number() OVER (PARTITION BY mark ORDER BY klass DESC) AS i FROM d GROUP BY mark, klass),
f AS (SELECT mark, 0::BIGINT AS i, NULL::VARCHAR AS klass, 0::BIGINT AS before, 0::BIGINT AS rate, target AS wanted, source_size AS remaining, 0::BIGINT AS after, source_size, target, u FROM s5
    UNION ALL SELECT mark, i, klass, before, rate, wanted - ((before + n * rate + u >> {BITS}) - (before + u >> {BITS})) * (w / n), remaining - w, before + n * rate, source_size, target, u FROM (
        SELECT f.mark, k.i, k.klass, f.after AS before, floor(CASE WHEN remaining > 0 THEN least({float(MOST)}::DOUBLE, greatest(0.0::DOUBLE, wanted / remaining)) WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END * {UNIT})::BIGINT AS rate,
            wanted, remaining, k.n, k.w, source_size, target, u FROM f JOIN k ON f.mark = k.mark AND k.i = f.i + 1)),
o AS (SELECT *, row_number() OVER (PARTITION BY mark, klass ORDER BY bucket, size, doc_id NULLS LAST, tie NULLS LAST) AS place FROM d)
SELECT doc_id, size, source_size, target, (((before + u + place * rate >> {BITS}) - (before + u + (place - 1) * rate >> {BITS})) * size)::BIGINT AS taken FROM o JOIN f ON o.mark = f.mark AND o.klass = f.klass
"""
