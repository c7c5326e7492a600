"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables, with the whole vectors deciding.

Rotations are learned by ITQ on a bounded sample: PCA, then alternating signs and Procrustes rotations, so that the bits are
balanced and lose little. Codes are cut into tables of `bits` bits; two vectors that agree in a table's bits meet in a bucket of
it. With n distinct vectors a table has about log2(n / BUCKET) bits, and there are as many tables as bring two vectors at the
threshold together with probability TARGET, by as many rotations as that takes. Bits are of vectors less their mean, between which
angles are wider, so tables are counted and then tried on pairs of the sample and pairs built at the threshold; where they would be
more than comparing all vectors with each other is worth, one table of no bits has them all. What travels to the buckets is a vector's
number and the signs of all its bits. There, all pairs not met in an earlier table whose signs differ in few enough places (at most
as many as in any tried pair, and one more) have their vectors fetched, which are compared in double precision. Equal vectors are one
representative, with its number of copies. Pairs never become rows: a bucket gives each vector's number of links and the edges of a
spanning forest; large buckets are split into pairs of chunks.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing; those of each length have
an index of their own; every row is a vector of its own: rows that repeat a vec_id and its vector are copies that link with each other,
with another vector each row has its own links, and the least vec_id reachable; null vec_id rows are linked like others, and name no
component: a component without any vec_id is null; all columns but key and vector are left out, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import draw, materialise, table
from .components import chunk_pairs, connected, each_piece
from .minhash import Forest

COSINE = 0.9
TARGET = 0.998
#: Vectors that a bucket is meant to have, and the rotations' sample.
BUCKET = 256
SAMPLE = 8192
ROUNDS = 30
#: Pairs that tables are tried on, of each kind; those of the sample are at most NEAR above the threshold.
TRIED = 2048
NEAR = 0.03
#: Signs that travel with a vector's number, at least.
SIGNS = 128
SEED = "itq-1"


def plan(n: int, cosine: float = COSINE, target: float = TARGET, bucket: int = BUCKET) -> tuple[int, int]:
    """(bits, tables) for n distinct vectors: a bit differs with probability angle / pi, so a table agrees with (1 - that)^bits."""
    bits = max(4, math.ceil(math.log2(max(1, n) / bucket)) if n > bucket else 4)
    agree = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - target) / math.log(1 - agree))


def rotation(x: np.ndarray, seed: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(mean, matrix): bits are (x - mean) @ matrix > 0. x: unit vectors of the sample."""
    d = x.shape[1]
    rng = np.random.default_rng(seed)
    r = np.linalg.qr(rng.standard_normal((d, d)))[0]
    if len(x) < 2:
        return np.zeros(d), r
    mean = x.mean(0)
    centred = x - mean
    vt = np.linalg.eigh(centred.T @ centred)[1].T[::-1]  # the principal directions, by d * d numbers whatever the sample
    v = centred @ vt.T
    for _ in range(rounds):
        b = np.where(v @ r >= 0, 1.0, -1.0)
        u, _, wt = np.linalg.svd(b.T @ v)
        r = wt.T @ u.T
    return mean, vt.T @ r


def near_pairs(x: np.ndarray, cosine: float = COSINE, most: int = TRIED) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs (u, v) by kind: built from the sample with exactly this cosine, and those of the sample at it or little above.

    A built v is as far from the sample's mean as u where that can be, and else as near to it; the rest of its way from u is along
    the difference of two vectors of the sample. u . v and both distances give the angle between u - mean and v - mean.
    """
    if len(x) < 2 or x.shape[1] < 2:
        return []
    rng = np.random.default_rng(1)
    mean, side = x.mean(0), math.sqrt(1 - cosine * cosine)
    u = x[rng.integers(0, len(x), most)]
    s = u @ mean
    away = mean - s[:, None] * u
    h = np.sqrt((away * away).sum(1))
    some = h > 1e-9
    away = np.where(some[:, None], away / np.maximum(h, 1e-9)[:, None], 0.0)
    w = x[rng.integers(0, len(x), most)] - x[rng.integers(0, len(x), most)]
    w = np.where((np.abs(w).max(1) > 1e-9)[:, None], w, rng.standard_normal(w.shape))
    for base in (u, away):
        w = w - (w * base).sum(1)[:, None] * base
    w /= np.maximum(np.sqrt((w * w).sum(1)), 1e-12)[:, None]
    up = np.where(some, np.clip((1 - cosine) * s / np.maximum(h, 1e-9), -side, side), 0.0)
    v = cosine * u + up[:, None] * away + np.sqrt(np.maximum(0, side * side - up * up))[:, None] * w
    found = [(u, v / np.sqrt((v * v).sum(1, keepdims=True)))]
    left, right = [], []
    for at in range(0, len(x), 1024):
        near = x[at : at + 1024] @ x[at:].T
        i, j = np.nonzero((near >= cosine) & (near < cosine + NEAR) & (np.arange(len(near))[:, None] < np.arange(near.shape[1])))
        few = rng.permutation(len(i))[:most]
        left.append(at + i[few])
        right.append(at + j[few])
    i, j = np.concatenate(left), np.concatenate(right)
    few = rng.permutation(len(i))[:most]
    return [*found, (x[i[few]], x[j[few]])] if len(i) else found


def fitted(pairs: list[tuple[np.ndarray, np.ndarray]], mean: np.ndarray, n: int, cosine: float, target: float) -> tuple[int, int]:
    """(bits, tables) as plan() has them, or fewer bits and more tables where the angles of the pairs less the mean ask for it.

    A vector's row in a table costs as much as BUCKET comparisons; of the numbers of bits the cheapest is taken. (0, 1): all pairs.
    """
    bits, tables = plan(n, cosine, target)
    most = limit(n)
    agree = []
    for u, v in pairs:
        a, b = u - mean, v - mean
        c = (a * b).sum(1) / np.maximum(np.sqrt((a * a).sum(1) * (b * b).sum(1)), 1e-12)
        agree.append(1 - np.arccos(np.clip(c, -1, 1)) / math.pi)
    best = None
    for k in range(4, bits + 1):
        met = [p**k for p in agree]
        enough = lambda t, met=met: all((1 - (1 - q) ** t).mean() >= target for q in met)
        low, high = 0, most
        if not enough(most):
            continue
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (low, mid) if enough(mid) else (mid, high)
        own = max(high, tables) if k == bits else high
        cost = own * (BUCKET + n / 2**k)
        if best is None or cost <= best[0]:
            best = cost, k, own
    return best[1:] if best else (0, 1)


def limit(n: int) -> int:
    """Tables beyond which comparing all pairs is no more work."""
    return max(64, n // BUCKET)


class Index:
    """Rotations and the cut into tables."""

    def __init__(self, sample: np.ndarray, dimension: int, n: int, cosine: float = COSINE, target: float = TARGET):
        self.dimension, self.cosine, self.rotations = dimension, cosine, []
        self.bits, self.tables = plan(n, cosine, target)
        pairs = near_pairs(sample, cosine) if dimension else []
        if pairs:
            self.bits, self.tables = fitted(pairs, sample.mean(0), n, cosine, target)
        self.rotate(sample)
        while self.bits and pairs and not all(self.found(u, v) >= math.floor(target * len(u)) for u, v in pairs):
            self.tables += max(1, self.tables // 8)
            if self.tables > limit(n):
                self.bits, self.tables = 0, 1
            self.rotate(sample)

        far = [int((self.signs(u) != self.signs(v)).sum(1).max()) for u, v in pairs if len(u)]
        self.radius = max(far) + 1 if far else max(1, self.dimension) * len(self.rotations)

    def rotate(self, sample: np.ndarray) -> None:
        """As many rotations as the tables take, and enough of them for the signs to tell vectors apart."""
        need = max(-(-self.bits * self.tables // self.dimension), -(-SIGNS // self.dimension)) if self.dimension else 0
        self.rotations = self.rotations[:need] + [rotation(sample, s) for s in range(len(self.rotations), need)]

    def found(self, u: np.ndarray, v: np.ndarray) -> int:
        """How many of the pairs meet in a table."""
        return int((self.keys(u) == self.keys(v)).any(1).sum())

    def signs(self, unit: np.ndarray) -> np.ndarray:
        """The bits of all rotations, a byte each."""
        width = self.dimension * len(self.rotations)
        out = np.zeros((len(unit), width), dtype=np.uint8)
        for at in range(0, len(unit) if width else 0, 256):
            out[at : at + 256] = np.concatenate([(unit[at : at + 256] - m) @ r > 0 for m, r in self.rotations], axis=1)
        return out

    def keys(self, unit: np.ndarray, signs: np.ndarray | None = None) -> np.ndarray:
        """A number for each table; the table's number is part of it."""
        out = np.tile(np.arange(self.tables, dtype=np.int64) << 40, (len(unit), 1))
        if self.bits and len(unit):
            signs = self.signs(unit) if signs is None else signs
            for at in range(0, len(unit), 256):
                cut = signs[at : at + 256, : self.bits * self.tables].reshape(-1, self.tables, self.bits)
                out[at : at + 256] += cut @ (1 << np.arange(self.bits, dtype=np.int64))
        return out


def units(vectors: list, dimension: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(whether valid, unit vectors of the valid ones), in double precision."""
    ok = np.zeros(len(vectors), dtype=bool)
    out = []
    for i, v in enumerate(vectors):
        if v is None or not len(v) or dimension is not None and len(v) != dimension:
            continue
        a = np.array([np.nan if x is None else x for x in v], dtype=np.float64)
        top = np.abs(a).max()
        if np.isfinite(a).all() and top > 0:
            a = a / top  # no overflow or underflow in the squares
            out.append(a / np.sqrt((a * a).sum()))
            ok[i] = True
    return ok, np.array(out) if out else np.zeros((0, dimension or 0))


def coded(reps: DataFrame, index: Index) -> DataFrame:
    """(id, copies, unit, keys, signs) of the valid representatives."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok, u = units(b.column(2).to_pylist(), index.dimension)
            if len(u):
                at, bits = pa.array(np.flatnonzero(ok)), index.signs(u)
                columns = [b.column(0).take(at), b.column(1).take(at), pa.array([x.tobytes() for x in u], pa.binary()), pa.array(list(index.keys(u, bits)), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([x.tobytes() for x in np.packbits(bits, axis=1)], pa.binary())], ["id", "copies", "unit", "keys", "signs"])

    return reps.select("id", "copies", "v").mapInArrow(run, "id bigint, copies bigint, unit binary, keys array<bigint>, signs binary")


class Met:
    """Which rows of a piece have to be compared: signs near, in no earlier table together, of both chunks where there are two."""

    def __init__(self, key: tuple[int, int, int], rows: pa.Table, bits: int, radius: int):
        n = rows.num_rows
        packed = np.frombuffer(b"".join(rows.column("signs").to_pylist()), dtype=np.uint8).reshape(n, -1)
        self.signs = np.unpackbits(packed, axis=1)
        self.own, self.place, self.crossed, self.bits, self.radius = rows.column("own").to_numpy(), key[0] >> 40, key[1] != key[2], bits, radius
        whole = self.signs.astype(np.float32)
        ones = whole.sum(1)
        self.near = np.triu(ones[:, None] + ones - 2 * (whole @ whole.T) <= radius, 1)

    def later(self, a: int) -> np.ndarray:
        """The later rows that row a is compared with."""
        rest = np.flatnonzero(self.near[a])
        if self.crossed:
            rest = rest[self.own[rest] != self.own[a]]
        if self.place and len(rest):
            width = self.place * self.bits
            same = (self.signs[rest, :width] == self.signs[a, :width]).reshape(len(rest), self.place, self.bits).all(2)
            rest = rest[~same.any(1)]
        return rest


def likely(pieces: DataFrame, bits: int, radius: int) -> DataFrame:
    """(bucket, id, own, i, j) of the rows that have a row to be compared with; written out."""
    def run(key: tuple[int, int, int], rows: pa.Table) -> list[tuple]:
        met, hit = Met(key, rows, bits, radius), set()
        for a in range(rows.num_rows - 1):
            rest = met.later(a).tolist()
            if rest:
                hit.add(a)
                hit.update(rest)
        ids = rows.column("id").to_pylist()
        return [(key[0], ids[k], int(met.own[k]), key[1], key[2]) for k in sorted(hit)]

    return materialise(each_piece(pieces, run, "bucket bigint, id bigint, own int, i int, j int"))


def bucket_links(met: DataFrame, cosine: float, dimension: int, bits: int, radius: int) -> DataFrame:
    """From (bucket, id, own, i, j, copies, unit, signs): (id, links, other) rows; other is an edge of the forest or null."""
    def run(key: tuple[int, int, int], rows: pa.Table) -> list[tuple]:
        n = rows.num_rows
        u = np.frombuffer(b"".join(rows.column("unit").to_pylist()), dtype=np.float64).reshape(n, dimension)
        ids, copies = (rows.column(c).to_numpy() for c in ("id", "copies"))
        near = Met(key, rows, bits, radius)
        links, forest, edges = np.zeros(n, dtype=np.int64), Forest(n), []
        for a in range(n - 1):
            rest = near.later(a)
            rest = rest[(u[rest] * u[a]).sum(1) >= cosine] if len(rest) else rest
            if len(rest):
                links[a] += copies[rest].sum()
                links[rest] += copies[a]
                edges += [(int(ids[a]), int(ids[b])) for b in rest if forest.root(a) != forest.root(int(b)) and forest.add(a, int(b))]
        some = np.flatnonzero(links)
        return [(int(ids[i]), int(links[i]), None) for i in some] + [(a, 0, b) for a, b in edges]

    return each_piece(met, run, "id bigint, links bigint, other bigint")


def link(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE, target: float = TARGET, sample: int = SAMPLE) -> DataFrame:
    """(id, n_links, component) of every row."""
    src = rows.select(F.col(f"`{key}`").cast("bigint").alias("name"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    valid = (F.coalesce(F.size("v"), F.lit(0)) > 0) & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists("v", lambda x: x != 0)
    # -0.0 and 0.0 are the same component of a vector.
    same = F.when(valid, F.md5(F.transform("v", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x)).cast("string")))
    src = src.withColumn("same", same)
    # A vector, not a vec_id, is a node; its number is made here and written out.
    groups = src.where("same is not null").groupBy("same").agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v"))
    reps = materialise(groups.withColumn("id", F.monotonically_increasing_id()))
    # An index for each length that two vectors or more have; vectors of other lengths have no cosine.
    outs = []
    for dimension, n in sorted(tuple(r) for r in reps.groupBy(F.size("v").alias("d")).count().where("count > 1").collect()):
        own = reps.where(F.size("v") == dimension)
        picked = [r[0] for r in own.orderBy(draw(SEED, F.col("same")), "same").limit(sample).select("v").collect()]
        index = Index(units(picked, dimension)[1], dimension, n, cosine, target)
        made = materialise(coded(own, index))
        pieces = chunk_pairs(made.select("id", F.explode("keys").alias("bucket"), "signs").select("bucket", "id", "signs"))
        whole = made.select(F.col("id").alias("_id"), "copies", "unit", "signs")
        met = likely(pieces, index.bits, index.radius).join(whole, F.col("id") == F.col("_id")).drop("_id")
        outs.append(materialise(bucket_links(met, cosine, dimension, index.bits, index.radius)))
    out = reduce(DataFrame.unionByName, outs) if outs else rows.sparkSession.createDataFrame([], "id bigint, links bigint, other bigint")
    counts = out.where("links > 0").groupBy("id").agg(F.sum("links").alias("links")).withColumnRenamed("id", "_c")
    found = connected(out.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    each = reps.select("same", "id", "name", "copies").join(counts, F.col("id") == F.col("_c"), "left").join(found, F.col("id") == F.col("node"), "left")
    each = materialise(each.select(F.col("same").alias("_same"), "name", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "id").alias("group")))
    least = each.groupBy("group").agg(F.min("name").alias("component")).withColumnRenamed("group", "_group")
    each = each.join(least, F.col("group") == F.col("_group")).select("_same", "links", "component")
    # Back to every row, of which the invalid ones have no representative.
    every = src.select(F.col("name").alias("id"), "same").join(each, F.col("same") == F.col("_same"), "left")
    return every.select("id", F.coalesce("links", F.lit(0)).alias("n_links"), F.when(F.col("_same").isNull(), F.col("id")).otherwise(F.col("component")).alias("component"))


def op6_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = link(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))
