"""MinHash near-duplicates: many universal hash minima, banding, signature verification, exact confirmation, components.

A document is its set of distinct shingles of `words` words (64-bit hashes). Equal sets are one representative from the start. A signature
has K minima of (a x + b) mod 2^64 >> 32; bands of R minima make the buckets. At similarity 0.8 a pair shares no band with
probability (1 - 0.8^5)^30 = 7e-6. In a bucket, two documents are compared only in the first band they share; the signatures'
agreement must be FLOOR or more (4.5 standard deviations below 0.8), and then the whole sets decide. Pairs never become rows:
a bucket gives the edges of a spanning forest of its confirmed links. In a bucket beyond CHUNK rows each set is first held against that
of the bucket's least document; those that are linked with it need not meet each other any more, so a large group of near copies is a
pass over it, and only the others meet all, in pairs of chunks.

Sets are built again only for documents with a likely partner; a bitmap picks them in the scan, of 16 bits or more for each of them
up to MOST_BITS in all, where a few others are built in vain.

Edge cases: null, empty and blank texts have n_shingles 0 and are linked with nothing; fewer words than a shingle's are one shingle;
null doc_id: the row's component is that of its equal texts, or null; repeated rows share a component; a very long text is one set of
all its shingles; all columns but key and text are left out, whatever their names; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, small_batches, table
from .components import CHUNK, chunk_pairs, connected, each_piece

#: Words of a shingle; the query op8 has its own by contract.
WORDS = 5
QUERY_WORDS = 4
BANDS, R = 30, 5
K = BANDS * R
NUMERATOR, DENOMINATOR = 80, 100
FLOOR = 0.8 - 4.5 * (0.8 * 0.2 / K) ** 0.5
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28
SEED = 20
#: Word types that a task keeps the hashes of; then the table begins anew.
KEPT_WORDS = 400_000

_rng = np.random.default_rng(SEED)
_A = _rng.integers(1, 2**63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, K, dtype=np.uint64)
_M = np.uint64(0xBF58476D1CE4E5B9)


class Shingler:
    """Shingle sets of texts; words are hashed once while they are kept."""

    def __init__(self, words: int = WORDS):
        self.words, self.kept = words, {}

    def shingles(self, text: str | None) -> np.ndarray:
        """The sorted distinct 64-bit hashes of the shingles of the whole text."""
        w = (text or "").encode("utf-8", "surrogatepass").lower().split()
        kept = self.kept
        if len(kept) > KEPT_WORDS:
            kept.clear()
        ids = np.empty(len(w), dtype=np.uint64)
        for i, x in enumerate(w):
            h = kept.get(x)
            if h is None:
                h = kept[x] = xxhash.xxh3_64_intdigest(x)
            ids[i] = h
        n = self.words
        if not len(w):
            return ids
        if len(w) < n:  # the whole sequence is one shingle, of its own kind
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(w), seed=1)], dtype=np.uint64)
        with np.errstate(over="ignore"):
            s = ids[: len(ids) - n + 1].copy()
            for j in range(1, n):
                s = ((s ^ (s >> np.uint64(29))) * _M) + ids[j : len(ids) - n + 1 + j]
            s = (s ^ (s >> np.uint64(32))) * _M
        return np.unique(s ^ (s >> np.uint64(31)))


def minima(s: np.ndarray) -> np.ndarray:
    """K minima of a set that is not empty."""
    out = None
    with np.errstate(over="ignore"):
        for at in range(0, len(s), 2048):
            x = ((s[at : at + 2048, None] * _A + _B) >> np.uint64(32)).min(0)
            out = x if out is None else np.minimum(out, x)
    return out


def bands(m: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band; the band's number is part of it."""
    with np.errstate(over="ignore"):
        k = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for r in range(R):
            k = (k ^ (k >> np.uint64(30))) * _M + m.reshape(BANDS, R)[:, r]
        k = (k ^ (k >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return k ^ (k >> np.uint64(31))


def signatures(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(id, n, same, bands, low): size of the set, a 128-bit name of it, band keys, and the low byte of each minimum."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sh = Shingler(words)
        for b in batches:
            n, same, keys, low = [], [], [], []
            for t in b.column(1).to_pylist():
                s = sh.shingles(t)
                n.append(len(s))
                if len(s):
                    m = minima(s)
                    same.append(xxhash.xxh3_128_digest(s.tobytes()))
                    keys.append(bands(m).astype(np.int64))
                    low.append((m & np.uint64(255)).astype(np.uint8).tobytes())
                else:
                    same.append(None)
                    keys.append(None)
                    low.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(same, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(low, pa.binary())], ["id", "n", "same", "bands", "low"])

    return docs.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("t")).mapInArrow(run, "id bigint, n bigint, same binary, bands array<bigint>, low binary")


class Forest:
    """Union-find over the rows of one piece; add() tells whether two were apart."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def add(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def likely(band: np.ndarray, low: np.ndarray, own: np.ndarray, bucket: int, crossed: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each row, the later rows it has to be compared with here, and their agreement."""
    place = np.flatnonzero(band[0] == bucket)
    first = int(place[0]) if len(place) else 0
    for a in range(len(band) - 1):
        ok = (low[a + 1 :] == low[a]).mean(1) >= FLOOR
        if crossed:
            ok &= own[a + 1 :] != own[a]
        if first and ok.any():
            ok &= ~(band[a + 1 :, :first] == band[a, :first]).any(1)
        rest = np.flatnonzero(ok) + a + 1
        if len(rest):
            yield a, rest, (low[rest] == low[a]).mean(1)


def _arrays(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = rows.num_rows
    band = np.concatenate([c.flatten().to_numpy() for c in rows.column("bands").chunks]).reshape(n, -1)
    low = np.frombuffer(b"".join(rows.column("low").to_pylist()), dtype=np.uint8).reshape(n, -1)
    return band, low, rows.column("own").to_numpy()


def sets_of(ids: DataFrame, reps: DataFrame, docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(id, set, bands, low) of the representatives in ids (id), by one scan of the texts; written out."""
    ids = materialise(ids.distinct())
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * ids.count()).bit_length()))
    slot = F.pmod(F.xxhash64(F.col("id")), F.lit(size))
    parts = ids.groupBy(F.shiftright(slot, 15).cast("int").alias("part")).agg(F.bitmap_construct_agg(slot.bitwiseAND(32767)).alias("bits")).collect()
    bitmap = np.zeros(size // 8, dtype=np.uint8)
    for r in parts:  # at most MOST_BITS / 32768 rows of 4 KB
        bitmap[r["part"] * 4096 : (r["part"] + 1) * 4096] = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sh, bits = Shingler(words), shared.value
        for b in batches:
            at = b.column(2).to_numpy(zero_copy_only=False)
            chosen = np.flatnonzero((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
            part = b.take(pa.array(chosen))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([sh.shingles(t).tobytes() for t in part.column(1).to_pylist()], pa.binary())], ["id", "set"])

    source = docs.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("t")).where("id is not null").withColumn("slot", slot)
    built = source.mapInArrow(sets, "id bigint, set binary")
    # Of rows with one id but several texts, the one whose set was signed.
    named = built.join(ids.withColumnRenamed("id", "_n"), F.col("id") == F.col("_n")).drop("_n").withColumn("_name", F.md5("set"))
    named = named.groupBy("id", "_name").agg(F.first("set").alias("set")).drop("_name")
    return materialise(named.join(reps.withColumnRenamed("id", "_r"), F.col("id") == F.col("_r")).select("id", "set", "bands", "low"))


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets are linked."""
    if DENOMINATOR * min(len(x), len(y)) < NUMERATOR * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return DENOMINATOR * both >= NUMERATOR * (len(x) + len(y) - both)


def led(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (id, lead) that are linked; written out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = FLOOR * K
        for b in batches:
            one, other, low, top = (b.column(k).to_pylist() for k in (2, 3, 4, 5))
            as_set, as_low = (lambda x: np.frombuffer(x, dtype=np.uint64)), (lambda x: np.frombuffer(x, dtype=np.uint8))
            ok = [(as_low(p) == as_low(q)).sum() >= floor and similar(as_set(x), as_set(y)) for x, y, p, q in zip(one, other, low, top, strict=True)]
            at = pa.array(np.flatnonzero(ok))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at)], ["id", "lead"])

    of = lambda c: sets.select(F.col("id").alias(f"_{c}"), F.col("set").alias(f"{c}_set"), F.col("low").alias(f"{c}_low"))
    met = pairs.join(of("id"), F.col("id") == F.col("_id")).join(of("lead"), F.col("lead") == F.col("_lead"))
    return materialise(met.select("id", "lead", "id_set", "lead_set", "id_low", "lead_low").mapInArrow(run, "id bigint, lead bigint"))


def links(reps: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, chunk: int = CHUNK) -> DataFrame:
    """Edges (a, b) between representatives that connect what confirmed links connect. reps: (id, bands, low), ids distinct."""
    rows = reps.select("id", F.explode("bands").alias("bucket"))
    many = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("lead")).where("n > 1").withColumnRenamed("bucket", "_bucket")
    met = materialise(rows.join(many, F.col("bucket") == F.col("_bucket")).select("bucket", "id", "n", "lead"))
    large = met.where(F.col("n") > chunk)
    light = reps.select(F.col("id").alias("_id"), "bands", "low")

    def pick(key: tuple[int, int, int], rows: pa.Table) -> list[tuple]:
        """The rows with a likely partner here; those alone bring their sets to the next step."""
        hit: set[int] = set()
        for a, rest, _ in likely(*_arrays(rows), key[0], key[1] != key[2]):
            hit.add(a)
            hit.update(rest.tolist())
        ids, own = rows.column("id").to_pylist(), rows.column("own").to_pylist()
        return [(key[0], ids[k], own[k], key[1], key[2]) for k in sorted(hit)]

    def confirm(key: tuple[int, int, int], rows: pa.Table) -> list[tuple]:
        s = [np.frombuffer(x, dtype=np.uint64) for x in rows.column("set").to_pylist()]
        pairs = [(float(g), a, int(b)) for a, rest, agree in likely(*_arrays(rows), key[0], key[1] != key[2]) for b, g in zip(rest, agree, strict=True)]
        forest, ids, out = Forest(len(s)), rows.column("id").to_pylist(), []
        for _, a, b in sorted(pairs, reverse=True):  # the likeliest first, so that most of the others are connected already
            if forest.root(a) != forest.root(b) and ids[a] != ids[b] and similar(s[a], s[b]) and forest.add(a, b):
                out.append((ids[a], ids[b]))
        return out

    def picked(pieces: DataFrame) -> DataFrame:
        return materialise(each_piece(pieces.join(light, F.col("id") == F.col("_id")).drop("_id"), pick, "bucket bigint, id bigint, own int, i int, j int"))

    def confirmed(need: DataFrame, sets: DataFrame) -> DataFrame:
        return each_piece(need.join(sets.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id")).drop("_id"), confirm, "a bigint, b bigint")

    small = met.where(F.col("n") <= chunk).select("bucket", "id", *[F.lit(0).alias(c) for c in ("own", "i", "j")])
    need = picked(small)
    sets = sets_of(need.select("id").union(large.select("id")), reps, docs, key, text, words)
    edges = confirmed(need, sets)
    if not large.limit(1).count():
        return edges
    found = led(large.where("id <> lead").select("id", "lead").distinct(), sets)
    known = found.select(F.col("id").alias("_i"), F.col("lead").alias("_l"))
    calm = (F.col("id") == F.col("lead")) | F.col("_i").isNotNull()
    rest = large.join(known, (F.col("id") == F.col("_i")) & (F.col("lead") == F.col("_l")), "left").select("bucket", "id", calm.alias("settled"))
    more = confirmed(picked(chunk_pairs(rest, chunk)), sets)
    return edges.unionByName(found.select(F.col("id").alias("a"), F.col("lead").alias("b"))).unionByName(more)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, chunk: int = CHUNK) -> DataFrame:
    """(id, n, component) of every row of docs; component is the least id reachable, the row's own without a link."""
    signed = materialise(signatures(docs, key, text, words))
    # Written out, so that the joins below deal both sides anew and a group of a third of all rows can be split.
    same = materialise(signed.where("same is not null").groupBy("same").agg(F.min("id").alias("rep")).withColumnRenamed("same", "_same"))
    member = materialise(signed.select("id", "n", "same").join(same, F.col("same") == F.col("_same"), "left").select("id", "n", F.coalesce("rep", "id").alias("rep")))
    # One signature for each representative: that of the set it stands for. An id with several sets stands for each of them.
    reps = signed.where("same is not null and id is not null").join(same, (F.col("same") == F.col("_same")) & (F.col("id") == F.col("rep"))).select("id", "bands", "low").distinct()
    edges = links(materialise(reps), docs, key, text, words, chunk)
    # Rows that share an id are one node, so an id with several sets also links their representatives.
    edges = edges.unionByName(member.where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b")).join(signed.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select(F.col("id").alias("_i")), F.col("a") == F.col("_i")).drop("_i"))
    found = connected(edges)
    return member.join(found, F.col("rep") == F.col("node"), "left").select("id", "n", F.coalesce("component", "rep").alias("component"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), words=QUERY_WORDS)
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))
