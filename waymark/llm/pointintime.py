"""Point-in-time feature join: which version of a source's feature holds at the second a label asks for, by union-find painting.

A version can be used at t where its event <= t and arrival <= t < expiry, so it covers the seconds from the later of event and arrival
to before expiry. The latest event wins, then the latest arrival, then the largest id. Painting a stretch of seconds with versions in
this order, best first, each claims the seconds that are still free; a next-free pointer at each painted second skips what is taken, so a
stretch of s seconds and v versions takes O(s + v) claims, however deep versions lie on each other.

Versions are dealt by ranges of (source, chunk of CHUNK seconds, hash of the id), whose bounds Spark samples: a source that holds a third of
all rows, or a crowded chunk of it, spreads over as many tasks as its rows ask for. Each task paints the chunks it holds, which leaves
at most a run a second for each; best of several is best of all, so the runs of all tasks are painted again, in tiles of TILE seconds,
where the labels read them. Neither a source's versions nor its labels meet in one task, nothing goes to the driver or is broadcast.

Edge cases: versions with a null source, id or time, and those whose expiry is no later than event or arrival, are never usable; labels with
a null source or time get no winner; times are whole seconds and may be negative; intervals may be of any length (a version
comes once for each chunk it touches); versions equal in event, arrival and id are copies of each other, of which one with the largest
payload wins; repeated labels are answered each; extra columns of labels stay; empty tables: no labels give no rows, no versions no winners.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .fim import draws

#: Seconds of a chunk that is painted at once, and of a tile in which labels read.
CHUNK, TILE = 1024, 64
#: Times of the test tables' contract.
SPAN, LATE, LATEST, LASTS, FRESH = 50_000, -60, 600, 900, 120


def paint(starts: np.ndarray, ends: np.ndarray, seconds: int) -> np.ndarray:
    """The number of the interval that each second belongs to, -1 for none; intervals come best first, as half-open offsets."""
    owner = np.full(seconds, -1, np.int64)
    free = list(range(seconds + 1))  # free[s]: s if it is free, else a pointer towards the next free second
    left = seconds
    for k, (start, end) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        s = start
        while free[s] != s:
            free[s] = free[free[s]]  # halves the path
            s = free[s]
        while s < end:
            owner[s] = k
            free[s] = s + 1
            left -= 1
            s += 1
            while free[s] != s:
                free[s] = free[free[s]]
                s = free[s]
        if not left:
            break
    return owner


def runs(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, interval) of the stretches of one owner, in order of time, without the free ones."""
    if not len(owner):
        return owner, owner, owner
    change = np.flatnonzero(np.diff(owner)) + 1
    start, end = np.concatenate([[0], change]), np.concatenate([change, [len(owner)]])
    held = owner[start] >= 0
    return start[held], end[held], owner[start[held]]


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The stretches of rows with equal keys, of sorted batches; one that goes over a batch's end is put together."""
    held: list[pa.Table] = []
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if not t.num_rows:
            continue
        differs = np.zeros(t.num_rows - 1, bool)
        for k in keys:
            c = batch.column(k)
            differs |= np.asarray(pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)))
        bounds = [0, *(np.flatnonzero(differs) + 1).tolist(), t.num_rows]
        for a, b in zip(bounds, bounds[1:], strict=False):
            part = t.slice(a, b - a)
            if held and (a or any(held[-1].column(k)[-1] != part.column(k)[0] for k in keys)):
                yield pa.concat_tables(held)
                held = []
            held.append(part)
    if held:
        yield pa.concat_tables(held)


def _painter(tile: int, chunk: int):
    """Sorted versions of chunks to painted runs, cut at the bounds of tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, ["source", "chunk"]):
            base = g.column("chunk")[0].as_py() * chunk
            own = [np.clip(g.column(c).to_numpy() - base, 0, chunk) for c in ("start", "end")]
            start, end, who = runs(paint(*own, chunk))
            first, last = start // tile, (end - 1) // tile
            many = last - first + 1
            at = np.repeat(np.arange(len(start)), many)
            k = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many) + first[at]
            s, e = np.maximum(start[at], k * tile) + base, np.minimum(end[at], (k + 1) * tile) + base
            out = g.take(pa.array(who[at]))
            for name, values in (("start", s), ("end", e), ("chunk", s // tile)):
                out = out.set_column(out.schema.get_field_index(name), name, pa.array(values, pa.int64()))
            yield from out.combine_chunks().to_batches()

    return run


def _reader(tile: int):
    """Runs of tiles, best first, and then the tile's labels to the labels with their winners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, ["source", "chunk"]):
            asks = np.asarray(g.column("asks"))
            n = len(asks) - int(asks.sum())  # versions come first
            if n == len(asks):
                continue
            labels, base = g.slice(n), (g.column("chunk")[0].as_py() or 0) * tile
            if n:
                own = [np.clip(g.column(c).slice(0, n).to_numpy() - base, 0, tile) for c in ("start", "end")]
                owner = paint(*own, tile)[labels.column("start").to_numpy() - base]
            else:
                owner = np.full(labels.num_rows, -1)
            found = pa.array(owner, pa.int64(), mask=owner < 0)
            columns = [labels.column("label"), *[g.column(c).take(found) for c in ("event", "id", "payload")]]
            yield from pa.Table.from_arrays(columns, ["label", "event", "id", "payload"]).combine_chunks().to_batches()

    return run


def join(labels: DataFrame, versions: DataFrame, t: str = "t", payload: tuple[str, ...] = (), chunk: int = CHUNK, tile: int = TILE) -> DataFrame:
    """Labels (source, t and others) with version_id and event of the winner among versions (source, version_id, event, arrival, expiry), and its payload columns.

    Columns of labels named like an added one are replaced.
    """
    if chunk % tile:
        raise ValueError("a chunk has to be a whole number of tiles")
    parts = max(int(labels.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    v = versions.select(
        F.col("source"), F.greatest("event", "arrival").cast("bigint").alias("start"), F.col("expiry").cast("bigint").alias("end"), F.col("event").cast("bigint").alias("event"),
        F.col("arrival").cast("bigint").alias("arrival"), F.col("version_id").cast("bigint").alias("id"), F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in payload]).alias("payload"),
    )
    v = v.where("source is not null and id is not null and event is not null and arrival is not null and start < end")
    v = v.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("start") / chunk), F.floor((F.col("end") - 1) / chunk))))
    best = [F.col(c).desc() for c in ("event", "arrival", "id", "payload")]
    v = v.repartitionByRange(parts, "source", "chunk", F.xxhash64("id", "event", "arrival")).sortWithinPartitions("source", "chunk", *best)
    painted = v.mapInArrow(_painter(tile, chunk), v.schema)
    added = ("version_id", "event", *payload)
    names = [c for c in labels.columns if c not in added]
    asks = labels.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("label"), F.col("source"), F.col(f"`{t}`").cast("bigint").alias("start"))
    nothing = {c: F.lit(None).cast(painted.schema[c].dataType) for c in ("end", "event", "arrival", "id", "payload")}
    asks = asks.select("*", F.lit(1).alias("asks"), F.floor(F.col("start") / tile).alias("chunk"), *[c.alias(k) for k, c in nothing.items()])
    answered = asks.where("source is not null and start is not null")
    both = answered.unionByName(painted.select("*", F.lit(0).alias("asks"), F.lit(None).cast(asks.schema["label"].dataType).alias("label")))
    both = both.repartition(parts, "source", "chunk").sortWithinPartitions("source", "chunk", "asks", *best)
    out = F.col("label"), F.col("event"), F.col("id"), F.col("payload")
    read = both.mapInArrow(_reader(tile), both.select(*out).schema)
    read = read.unionByName(asks.where("source is null or start is null").select(*out))
    return read.select(*[F.col("label").getField(c).alias(c) for c in names], F.col("id").alias("version_id"), "event", *[F.col("payload").getField(c).alias(c) for c in payload])


def op13_point_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions are the documents, labels ask about their document's source; of documents that share a doc_id the source is the least non-null one."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    a, b, c, d = draws(F.col("doc_id"), "")
    known = F.col("doc_id").isNotNull()
    timed: dict[str, Column] = {"event": F.when(known, a % SPAN), "arrival": F.when(known, a % SPAN + LATE + b % LATEST), "expiry": F.when(known, a % SPAN + c % LASTS)}
    versions = docs.select(F.col("doc_id").alias("version_id"), "source", "n_chars", "lang", *[v.alias(k) for k, v in timed.items()])
    sources = docs.where(known).groupBy(F.col("doc_id").alias("_id")).agg(F.min("source").alias("source"))
    asks = labels.select("doc_id", F.when(known, d % SPAN).alias("t")).join(sources, F.col("doc_id") == F.col("_id"), "left").drop("_id")
    j = join(asks, versions, payload=("n_chars", "lang"))
    age = F.col("t") - F.col("event")
    fresh_ = age <= FRESH
    status = F.when(F.col("version_id").isNull(), "none").when(fresh_, "fresh").otherwise("stale")
    return j.select("doc_id", "t", "version_id", age.alias("age"), status.alias("status"), F.when(fresh_, F.col("n_chars")).alias("n_chars"), F.when(fresh_, F.col("lang")).alias("lang"))


ORACLE = f"""
WITH x AS (SELECT *, sha256(doc_id::VARCHAR) AS h FROM documents),
v AS (SELECT doc_id, source, n_chars, lang, ('0x' || h[1:8])::BIGINT % {SPAN} AS event, ('0x' || h[9:16])::BIGINT % {LATEST} AS b, ('0x' || h[17:24])::BIGINT % {LASTS} AS c FROM x),
s AS (SELECT doc_id, min(source) AS source FROM documents GROUP BY doc_id),
l AS (SELECT row_number() OVER () AS r, l.doc_id, ('0x' || sha256(l.doc_id::VARCHAR)[25:32])::BIGINT % {SPAN} AS t, s.source FROM labels l LEFT JOIN s ON l.doc_id = s.doc_id),
w AS (SELECT l.r, l.doc_id, l.t, v.doc_id AS version_id, v.event, v.n_chars, v.lang, row_number() OVER (PARTITION BY l.r ORDER BY v.event DESC NULLS LAST, v.b DESC, v.doc_id DESC) AS k
    FROM l LEFT JOIN v ON v.source = l.source AND v.event <= l.t AND v.event {LATE:+d} + v.b <= l.t AND l.t < v.event + v.c)
SELECT doc_id, t, version_id, t - event AS age, CASE WHEN version_id IS NULL THEN 'none' WHEN t - event > {FRESH} THEN 'stale' ELSE 'fresh' END AS status,
    CASE WHEN t - event <= {FRESH} THEN n_chars END AS n_chars, CASE WHEN t - event <= {FRESH} THEN lang END AS lang FROM w WHERE k = 1
"""
