"""Language-model scoring with a weighted backoff automaton.

The model: n-grams of words with Dirichlet smoothing, order by order. With h a history and h' the history without its oldest word,

    P(w | h) = (c(h w) + K P(w | h')) / (c(h) + K),     P(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)),

so seen n-grams are arcs, a history is a state, and the failure arc of h leads to h' with weight K / (c(h) + K). A text is read
left to right once: at a word without an arc the failure weight is added and the shorter history tried; the logs add up.
Each history's probabilities sum to 1 over the V training words and the one class of unknown ones. A text starts in the state of
the start mark and ends with one end token.

No part of the model has to fit one machine. Texts are cut into blocks, each with its own word list. A block sends the keys
(64-bit hashes) of its words and n-grams with its training counts; the counts of a key are summed over blocks, and go back only
to the blocks where the sum differs from what the block itself counted. So a block holds exactly the part of the automaton its own
texts can reach. Counts of a key travel packed, sorted, by key range; a very common key costs an entry a block, not one a row. Sums
go up a tree: a task adds a range's counts of at most FAN blocks, then of at most FAN such sums, and so on, and down the same way.

Edge cases: null and empty texts are the end token alone; null doc_id counts as training text; repeated rows count each; a very
long text is a block of its own; all columns but key and text are left out, whatever their names; an empty table gives no rows;
without training texts N and V are 0, every word is unknown and P(w) is 1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, materialise, small_batches, table

ORDER = 2
#: Weight of the shorter history, in observations.
MASS = 128.0
HELD_OUT = 1
#: Bytes of text of a block, and n-gram keys that a key range is meant to have.
BLOCK_BYTES = 3 << 20
RANGE_KEYS = 1 << 19
#: Blocks, or sums of blocks, whose counts of a key range one task adds.
FAN = 4096

END, START = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_PACK = {"uint64": np.uint64, "uint32": np.uint32, "float64": np.float64}


def tokens(text: str | None) -> list[bytes]:
    """The words with A-Z in lower case; bytes.split() parts at the same six white-space bytes as the contract."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def pack(a: np.ndarray, ascending: bool = False) -> bytes:
    """Compressed numbers, by byte planes: all lowest bytes first, and so on; ascending ones as differences."""
    a = np.diff(a, prepend=a.dtype.type(0)) if ascending else np.ascontiguousarray(a)
    return zstandard.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes(), 3)


def unpack(b: bytes, kind: str, ascending: bool = False) -> np.ndarray:
    size = np.dtype(_PACK[kind]).itemsize
    planes = np.frombuffer(zstandard.decompress(b), dtype=np.uint8).reshape(size, -1)
    a = np.ascontiguousarray(planes.T).view(_PACK[kind]).ravel()
    with np.errstate(over="ignore"):
        return np.cumsum(a, dtype=a.dtype) if ascending else a


def extend(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The key of a history with one more word: an odd multiplier and shifts mix all bits."""
    with np.errstate(over="ignore"):
        x = (history ^ (history >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + word
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(30))


class Block:
    """Texts as places in a word list. ids has each text's words and then its end (place 0)."""

    def __init__(self, ids: np.ndarray, ends: np.ndarray, train: np.ndarray, hashes: np.ndarray):
        self.ids, self.ends, self.train, self.hashes = ids, ends, train, hashes  # ends: where each text ends in ids

    @classmethod
    def of(cls, texts: list[str | None], train: list[bool]) -> Block:
        places: dict[bytes, int] = {}
        parts, ends, n = [], [], 0
        for t in texts:
            w = tokens(t)
            parts.append(np.fromiter((places.setdefault(x, len(places) + 1) for x in w), dtype=np.uint32, count=len(w)))
            parts.append(np.zeros(1, dtype=np.uint32))
            n += len(w) + 1
            ends.append(n)
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in places), dtype=np.uint64, count=len(places))
        return cls(np.concatenate(parts) if parts else np.zeros(0, np.uint32), np.array(ends, dtype=np.uint32), np.array(train, dtype=np.uint32), np.append(END, hashes))

    def in_training(self) -> np.ndarray:
        """For each token, whether its text is a training text."""
        return np.repeat(self.train.astype(bool), np.diff(self.ends.astype(np.int64), prepend=0))

    def keys(self, order: int) -> list[np.ndarray]:
        """keys[k - 1]: the key of the k words that end at each token; words before the text's start are start marks."""
        word = self.hashes[self.ids]
        firsts = np.append(0, self.ends[:-1].astype(np.int64)) if len(self.ends) else np.zeros(0, np.int64)
        out, shifted = [word], word
        columns = [word]
        for _ in range(order - 1):
            shifted = np.append(START, shifted[:-1]) if len(shifted) else shifted
            shifted = shifted.copy()
            shifted[firsts] = START
            columns.append(shifted)
        for k in range(2, order + 1):
            key = columns[k - 1]
            for j in range(k - 2, -1, -1):
                key = extend(key, columns[j])
            out.append(extend(key, np.full_like(key, np.uint64(k))))
        return out


def counted(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, sorted, how often each is in training text (0 where only elsewhere), and each token's place in them."""
    distinct, inverse = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(inverse[train], minlength=len(distinct)).astype(np.uint32), inverse


def cut(distinct: np.ndarray, ranges: int) -> np.ndarray:
    """Where each key range begins in sorted keys; one entry more for the end."""
    which = ((distinct >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    return np.searchsorted(which, np.arange(ranges + 1).astype(np.uint64))


_BLOCK = "block bigint, tokens bigint, train_tokens bigint, starts bigint, ids binary, ends binary, train binary, hashes binary, keys binary, nulls binary"


def blocks(docs: DataFrame, key: str = "doc_id", text: str = "text", held_out: int = HELD_OUT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows (block, ids, ends, train, hashes, keys, nulls) of whole texts; keys are the doc_ids, nulls those without. Written out, as two steps read it."""
    src = docs.select(F.col(key).cast("bigint").alias("k"), (fold(key) != held_out).alias("t"), F.col(text).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        names, train, texts, size = [], [], [], 0

        def made() -> pa.RecordBatch:
            b = Block.of(texts, train)
            own = b.in_training()
            row = {"block": (part << 32) + number, "tokens": len(own), "train_tokens": int(own.sum()), "starts": sum(train), "ids": pack(b.ids), "ends": pack(b.ends), "train": pack(b.train), "hashes": pack(b.hashes)}
            row |= {"keys": pack(np.array([k or 0 for k in names], dtype=np.int64).view(np.uint64)), "nulls": pack(np.array([k is None for k in names], dtype=np.uint32))}
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([(c, pa.binary() if isinstance(v, bytes) else pa.int64()) for c, v in row.items()]))

        for batch in batches:
            for k, t, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                names.append(k)
                train.append(bool(t))
                texts.append(x)
                size += len(x or "") + 16
                if size >= block_bytes:
                    yield made()
                    names, train, texts, size, number = [], [], [], 0, number + 1
        if names:
            yield made()

    return materialise(src.mapInArrow(run, _BLOCK))


def restored(row: dict) -> Block:
    return Block(unpack(row["ids"], "uint32"), unpack(row["ends"], "uint32"), unpack(row["train"], "uint32"), unpack(row["hashes"], "uint64"))


def sent(block_rows: DataFrame, levels: list[int], ranges: int) -> DataFrame:
    """(range, level, block, k, c): each block's distinct keys and counts of these levels, cut into key ranges."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                block = restored(row)
                train, keys = block.in_training(), block.keys(max(levels))
                for level in levels:
                    k, c, _ = counted(keys[level - 1], train)
                    cuts = cut(k, ranges)
                    full = np.flatnonzero(np.diff(cuts))
                    columns = [pa.array(full, pa.int64()), pa.array(np.full(len(full), level), pa.int32()), pa.array(np.full(len(full), row["block"]), pa.int64())]
                    columns += [pa.array([pack(x[cuts[i] : cuts[i + 1]], x is k) for i in full], pa.binary()) for x in (k, c)]
                    yield pa.RecordBatch.from_arrays(columns, ["range", "level", "block", "k", "c"])

    return block_rows.select("block", "ids", "ends", "train", "hashes").mapInArrow(run, "range bigint, level int, block bigint, k binary, c binary")


_SUMS = "range bigint, level int, block bigint, distinct bigint, p binary, s binary"


def _merged(pdf: pd.DataFrame, kind: str) -> tuple[pd.DataFrame, list, list, np.ndarray, np.ndarray, np.ndarray]:
    """The rows by block, their keys and counts, all distinct keys, where each row's keys stand in them, and the sums."""
    pdf = pdf.sort_values("block")
    ks, cs = [unpack(b, "uint64", True) for b in pdf["k"]], [unpack(b, kind) for b in pdf["c"]]
    all_k, inverse = np.unique(np.concatenate(ks), return_inverse=True)
    total = np.bincount(inverse, weights=np.concatenate(cs), minlength=len(all_k)).astype(np.uint64)  # exact below 2^53
    return pdf, ks, cs, all_k, inverse, total


def _differences(key: tuple, merged: tuple, total: np.ndarray) -> list[tuple]:
    pdf, ks, cs, _, inverse, _ = merged
    out, at = [], 0
    for block, k, c in zip(pdf["block"], ks, cs, strict=True):
        mine = total[inverse[at : at + len(k)]]
        at += len(k)
        differ = np.flatnonzero(mine != c)
        if len(differ):
            out.append((key[0], key[1], block, 0, pack(differ.astype(np.uint32), True), pack(mine[differ])))
    return out


def summed(rows: DataFrame, blocks: int, fan: int = FAN, kind: str = "uint32") -> DataFrame:
    """(range, level, block, distinct, p, s): the sums over all blocks, for the keys where they differ from the block's own count.

    p are places in the block's sorted keys of that range, s their sums; block -1 has how many keys of the range are in training.
    kind: the numbers' type in column c. blocks: how many there are; beyond `fan` of them, groups of blocks are summed first, then the groups' sums in the same way.
    """
    names = ["range", "level", "block", "distinct", "p", "s"]
    if blocks <= fan:
        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            m = _merged(pdf, kind)
            out = _differences(key, m, m[5])
            return pd.DataFrame([*out, (key[0], key[1], -1, int((m[5] > 0).sum()), b"", b"")], columns=names)

        return rows.groupBy("range", "level").applyInPandas(run, _SUMS)
    groups = -(-blocks // max(2, fan))

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, _, _, all_k, _, total = _merged(pdf, kind)
        return pd.DataFrame([(key[0], key[1], key[2], pack(all_k, True), pack(total))], columns=["range", "level", "block", "k", "c"])

    def down(key: tuple, own: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame({c: [] for c in names})
        m = _merged(own, kind)
        total = m[5].copy()
        for p, s in zip(above["p"], above["s"], strict=True):  # one row at most
            total[unpack(p, "uint32", True).astype(np.int64)] = unpack(s, "uint64")
        return pd.DataFrame(_differences(key, m, total), columns=names)

    dealt = rows.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)))
    sums = materialise(dealt.groupBy("range", "level", "group").applyInPandas(add, "range bigint, level int, block bigint, k binary, c binary"))
    above = materialise(summed(sums, groups, fan, "uint64"))
    by = ["range", "level", "group"]
    each = dealt.groupBy(*by).cogroup(above.where("block >= 0").withColumnRenamed("block", "group").groupBy(*by)).applyInPandas(down, _SUMS)
    return each.unionByName(above.where("block = -1"))


class Automaton:
    """The part of the model that a block's texts reach: states are histories in training text, with arcs and a failure arc each."""

    def __init__(self, block: Block, counts: list[np.ndarray], starts: int, n: int, v: int, mass: float = MASS):
        """counts[k - 1]: the training count of the k words that end at each token; starts, n, v: training texts, tokens, words."""
        order, ids = len(counts), block.ids.astype(np.int64)
        first = np.zeros(len(ids), bool)
        first[np.append(0, block.ends[:-1].astype(np.int64)) if len(block.ends) else []] = True
        keys = block.keys(order)
        self.width = len(block.hashes)
        # State 0 is the root, 1 .. order - 1 the histories of start marks alone; then the histories of each length.
        self.fail_weight, self.fail = [0.0], [0]
        for k in range(1, order):
            self.fail_weight.append(math.log10(mass / (starts + mass)))
            self.fail.append(k - 1)
        self.start = order - 1 if starts else 0
        state = [np.zeros(len(ids), dtype=np.int64)]  # state[k]: of the k words that end at each token, 0 if not in training
        for k in range(1, order):
            kept = np.flatnonzero(counts[k - 1] > 0)
            _, where, inverse = np.unique(keys[k - 1][kept], return_index=True, return_inverse=True)
            now = np.zeros(len(ids), dtype=np.int64)
            now[kept] = inverse + len(self.fail)
            self.fail_weight += np.log10(mass / (counts[k - 1][kept[where]] + mass)).tolist()
            self.fail += state[k - 1][kept[where]].tolist()
            state.append(now)
        unit = (n + 0.5 * (v + 1)) or 1.0
        word, after = np.full(self.width, 1.0), np.zeros(self.width, dtype=np.int64)
        word[ids] = (counts[0] + 0.5) / unit if n else 1.0
        if order > 1:
            after[ids] = state[1]
        self.root, self.after = np.log10(word).tolist(), after.tolist()
        self.arcs: dict[int, float] = {}
        self.to: dict[int, int] = {}  # where an arc leads, if not to the state of its word alone
        p = word[ids]
        for k in range(2, order + 1):
            history, size = np.append(0, state[k - 1][:-1]), np.append(0, counts[k - 2][:-1]).astype(np.float64)
            history[first], size[first] = (k - 1) if starts else 0, starts
            both = counts[k - 1].astype(np.float64)
            p = np.where(history > 0, (both + mass * p) / (size + mass), p)
            seen = np.flatnonzero((both > 0) & (history > 0))
            arc, place = np.unique(history[seen] * self.width + ids[seen], return_index=True)
            self.arcs.update(zip(arc.tolist(), np.log10(p[seen][place]).tolist(), strict=True))
            if order > 2:
                goal = state[min(k, order - 1)][seen][place]
                self.to.update(zip(arc.tolist(), goal.tolist(), strict=True))

    def traverse(self, block: Block) -> list[float]:
        """The log10 probability of each text, by one pass from left to right that carries the state."""
        get, fail, weight, root, after, width, to = self.arcs.get, self.fail, self.fail_weight, self.root, self.after, self.width, self.to
        ids, out, at = block.ids.tolist(), [], 0
        for end in block.ends.tolist():
            total, s = 0.0, self.start
            for w in ids[at:end]:
                while s:
                    arc = s * width + w
                    got = get(arc)
                    if got is not None:
                        total += got
                        s = to[arc] if to else after[w]
                        break
                    total += weight[s]
                    s = fail[s]
                else:
                    total += root[w]
                    s = after[w]
            out.append(total)
            at = end
        return out


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER, mass: float = MASS, held_out: int = HELD_OUT, block_bytes: int = BLOCK_BYTES, range_keys: int = RANGE_KEYS, fan: int = FAN) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; other columns are left out."""
    rows = blocks(docs, key, text, held_out, block_bytes)
    size = rows.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("train_tokens"), F.lit(0)), F.coalesce(F.sum("starts"), F.lit(0)), F.count(F.lit(1))).first()
    ranges, n, starts, many = max(1, -(-size[0] // range_keys)), size[1], size[2], size[3]
    words = materialise(summed(sent(rows, [1], ranges), many, fan))
    both = F.coalesce(F.sum("distinct"), F.lit(0))
    v = words.where("block = -1").agg(both).first()[0]
    back = words.where("block >= 0")
    if order > 1:
        back = back.unionByName(summed(sent(rows, list(range(2, order + 1)), ranges), many, fan).where("block >= 0"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        if not len(left):
            return pd.DataFrame({c: [] for c in names})
        row = left.iloc[0]
        block, counts = restored(row), []
        train = block.in_training()
        for level, keys in enumerate(block.keys(order), 1):
            k, c, inverse = counted(keys, train)
            cuts, c = cut(k, ranges), c.astype(np.int64)
            mine = right[right["level"] == level]
            for r, p, s in zip(mine["range"], mine["p"], mine["s"], strict=True):
                c[cuts[r] + unpack(p, "uint32", True).astype(np.int64)] = unpack(s, "uint64")
            counts.append(c[inverse])
        firsts = np.append(0, block.ends[:-1].astype(np.int64)).astype(np.int64)
        per = lambda x: np.add.reduceat(x, firsts)
        unit = (n + 0.5 * (v + 1)) or 1.0
        base = np.log10((counts[0] + 0.5) / unit) if n else np.zeros(len(counts[0]))
        got = Automaton(block, counts, starts, n, v, mass).traverse(block)
        keys = pd.arrays.IntegerArray(unpack(row["keys"], "uint64").view(np.int64).copy(), unpack(row["nulls"], "uint32") > 0)
        out = [keys, block.train == 0, np.diff(block.ends.astype(np.int64), prepend=0), per((counts[0] > 0).astype(np.int64)), np.full(len(got), n), per(base), got]
        return pd.DataFrame(dict(zip(names, out, strict=True)))

    schema = "key bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    need = rows.select("block", "ids", "ends", "train", "hashes", "keys", "nulls")
    return need.groupBy("block").cogroup(back.groupBy("block")).applyInPandas(run, schema).withColumnRenamed("key", key)


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"))
