"""Connected components by alternating large-star and small-star, and bucket splitting for joins of likes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

#: Rows of a bucket that are compared with each other in one piece; larger buckets become pairs of such chunks.
CHUNK = 512
ROUNDS = 60


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour v of u is linked to the least of u and its neighbours. Sums meet edges in a join, which can split."""
    both = e.union(e.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, F.col("u") == F.col("_u")).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """u and its smaller neighbours are linked to the least of them; edges have a > b."""
    least = e.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("_a"), "m")
    moved = e.join(least, F.col("a") == F.col("_a")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select(F.col("_a").alias("a"), F.col("m").alias("b"))).distinct()


def connected(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(a, b) links of numbers to (node, component) for every node with a link to another; component is the least number reachable.

    Each round is written to the shared folder. It ends when a round changes no edge; then every edge leads to its component.
    """
    norm = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = materialise(norm)
    mark = lambda d: tuple(d.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first())
    seen = mark(now)
    for _ in range(rounds):
        after = materialise(_small_star(_large_star(now)))
        discard(now)
        now, before, seen = after, seen, mark(after)
        if seen == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b"), F.col("b"))).distinct()


def chunk_pairs(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(bucket, id, …) of buckets with two rows or more to (bucket, id, own, i, j, …): the chunk pairs that a row takes part in.

    A bucket's rows are dealt over ceil(rows / chunk) chunks by hash; every two rows of it meet in exactly one pair of chunks. With a
    column `settled`, rows that have it true need not meet each other: they get chunks of their own, which meet the others only.
    """
    calm = F.col("settled") if "settled" in rows.columns else F.lit(False)
    rest = [c for c in rows.columns if c not in ("bucket", "id", "settled")]
    parts = lambda c: F.ceil(F.sum(c.cast("bigint")) / chunk).cast("int")
    many = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n"), parts(~calm).alias("_open"), parts(calm).alias("_calm")).where("_n > 1 and _open > 0").withColumnRenamed("bucket", "_bucket").drop("_n")
    dealt = rows.withColumn("_settled", calm).join(many, F.col("bucket") == F.col("_bucket"))
    place = lambda n: F.pmod(F.xxhash64("bucket", "id"), F.greatest(n, F.lit(1))).cast("int")
    dealt = dealt.withColumn("own", F.when(F.col("_settled"), F.col("_open") + place(F.col("_calm"))).otherwise(place(F.col("_open"))))
    last = F.col("_open") - 1 + F.when(F.col("_settled"), 0).otherwise(F.col("_calm"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), last)))
    return dealt.select("bucket", "id", "own", F.least("own", "_other").alias("i"), F.greatest("own", "_other").alias("j"), *rest)


def each_piece(rows: DataFrame, run: Callable[[tuple[int, int, int], pa.Table], list[tuple]], schema: str) -> DataFrame:
    """run(key, rows) for each (bucket, i, j), rows sorted by id; its tuples are the result.

    Most pieces are two or three rows, for which a grouped pandas call costs far more than the work. So rows are dealt by piece,
    sorted, and read as a stream from which pieces are cut; only the piece that is being read is held.
    """
    dealt = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "id")
    keys = [rows.columns.index(c) for c in ("bucket", "i", "j")]
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"bigint": pa.int64(), "int": pa.int32()}
    types = [kinds[x.split()[1]] for x in schema.split(", ")]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key, out = None, []

        def made() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for b in batches:
            cols = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
            starts = [0, *(k for k in range(1, b.num_rows) if cols[0][k] != cols[0][k - 1] or cols[1][k] != cols[1][k - 1] or cols[2][k] != cols[2][k - 1])]
            for at, end in zip(starts, [*starts[1:], b.num_rows], strict=True):
                now = tuple(int(c[at]) for c in cols)
                if now != key and held:
                    out += run(key, pa.Table.from_batches(held))
                    held = []
                key = now
                held.append(b.slice(at, end - at))
            if len(out) > 10_000:
                yield made()
                out = []
        if held:
            out += run(key, pa.Table.from_batches(held))
        yield made()

    return dealt.mapInArrow(stream, schema)
