"""Quality classifier by Bradley-Terry pairwise ranking.

A document's strength is linear in figures of its text. All labelled documents outside the held-out fold are learned from: they
are dealt to blocks, a preference pair is a good document over a bad one of its block, and the weights minimise the logistic loss
on the differences of figures of all pairs. The cut is the exact quantile of all their strengths at the share of bad ones. Scores
are logistic in the strength, and 0.3 stands at the cut. Sums are of decimals and whole numbers, so no order of tasks changes them.

Edge cases: a null text counts as an empty one, which has a score like any other; with no labels, or labels of one kind only,
every score is 0.5 (predicted 1); labels that are null are not used; repeated rows and ties get equal scores; a very long text is
read whole; an empty table gives none; extra columns stay whatever their names, but one named like the score is replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, draw, fold, mapped, materialise, small_batches, table
from .labelled import learnable

#: Labelled documents of a block in the mean, and of each kind in it, for which a rarer kind goes to several blocks.
BLOCK, LEAST = 256, 32
#: Passes over all pairs at most, and the gain at which they end.
PASSES, GAIN = 40, 1e-7
#: Bins of a pass that looks for a quantile, and how many values end it.
BINS, FEW = 4096, 4096
#: Sums of a block are rounded to whole numbers of this part.
PART = 2.0**20
CUT = 0.3
HELD_OUT = 0
SEED = "quality-1"

_CLASS = np.zeros(256, dtype=np.uint8)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".", b",", b"!?", b"|", b"\"'-:;()", b"\n", b" \t\r\x0b\x0c"), 1):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 11  # what is left, 0, is the other ASCII symbols


def figures(text: str | None) -> list[float]:
    """What a document is judged by; the order is fixed."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    c = np.bincount(_CLASS[np.frombuffer(raw, dtype=np.uint8)], minlength=12)
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    m, k = max(1, len(words)), max(1, len(lines))
    counts = Counter(words)
    letters = max(1, int(c[1] + c[2]))
    repeated = sum(v for v in Counter(lines).values() if v > 1)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    marked = sum(w[-1] not in b".,;:!?)\"'" and not (w[-1:].isalnum() or w[-1] >= 128) for w in words)
    shares = [float(c[i]) / n for i in (0, 2, 3, 4, 5, 6, 7, 8, 9, 11)]
    return [
        float(np.log1p(len(raw))), float(np.log1p(len(words))), float(np.log1p(len(lines))), *shares, float(c[2]) / letters,
        len(counts) / m, max(counts.values(), default=0) / m, len(set(lines)) / k, repeated / k, float(np.log1p(len(raw) / k)),
        float(lengths.mean()) if m > 1 else 0.0, float(lengths.std()) if m > 1 else 0.0, float((lengths <= 3).sum()) / m, marked / m,
        float(np.sqrt(c[0] / n)), float(np.sqrt(c[7] / n)), float(np.sqrt(c[6] / n)), float(np.sqrt(repeated / k)),
    ]


def pair_loss(diff: np.ndarray, w: np.ndarray, decay: float = 0.0) -> tuple[float, np.ndarray]:
    """Mean of -log sigmoid(w . difference) plus decay / 2 w . w, and its gradient."""
    z = diff @ w
    return float(np.logaddexp(0, -z).mean() + decay / 2 * w @ w), -(diff / (1 + np.exp(np.clip(z, -30, 30)))[:, None]).mean(0) + decay * w


class Ranker:
    """Bradley-Terry weights over standardised figures."""

    def __init__(self) -> None:
        self.mean = self.scale = self.weights = None
        self.cut, self.spread = 0.0, 1.0

    def fit(self, blocks: DataFrame, decay: float = 1e-4) -> Ranker:
        """Newton steps on the loss of all pairs, halved where they don't lower it; blocks: (good, bad), figures one after another."""
        at = w = np.zeros(len(self.mean))
        best, step = np.inf, None
        for _ in range(PASSES):
            loss, gradient, curve = pair_sums(blocks, self, w, decay)
            if loss > best:  # too far
                step = step / 2
            else:
                gained, at, best = best - loss, w, loss
                step = -np.linalg.solve(curve, gradient)
                if gained < GAIN:
                    break
            if np.abs(step).max() < GAIN:
                break
            w = at + step
        self.weights = at
        return self

    def _norm(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def strength(self, x: np.ndarray) -> np.ndarray:
        return (self._norm(x) * self.weights).sum(1)  # by rows, so that a row's place in a batch doesn't matter

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; CUT exactly at the quantile."""
        if self.weights is None:
            return np.full(len(x), 0.5)
        z = np.clip((self.strength(x) - self.cut) / self.spread, -30, 30) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-z))


def block_sums(good: np.ndarray, bad: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Pairs, loss, gradient and curvature (row by row), summed over each good document with each bad one."""
    z = (good @ w)[:, None] - (bad @ w)[None, :]
    p = 1 / (1 + np.exp(np.clip(z, -30, 30)))
    q = p * (1 - p)
    cross = good.T @ q @ bad
    curve = (good.T * q.sum(1)) @ good + (bad.T * q.sum(0)) @ bad - cross - cross.T
    return np.concatenate([[z.size, np.logaddexp(0, -z).sum()], p.sum(0) @ bad - p.sum(1) @ good, curve.ravel()])


def pair_sums(blocks: DataFrame, model: Ranker, w: np.ndarray, decay: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean loss of all pairs with its decay, its gradient and its curvature at w; a task adds up its own blocks."""
    d = len(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 + d + d * d, dtype=np.int64)
        for b in batches:
            for pair in zip(b.column(0), b.column(1), strict=True):
                good, bad = (model._norm(np.asarray(x.values).reshape(-1, d)) for x in pair)
                total += np.rint(block_sums(good, bad, w) * PART).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.int64()))], ["s"])

    part = blocks.select("good", "bad").mapInArrow(run, "s array<bigint>").select(F.posexplode("s").alias("i", "v"))
    sums = np.array([float(r[1]) for r in part.groupBy("i").agg(F.sum("v")).orderBy("i").collect()]) / PART
    mean = sums[1:] / sums[0]
    return mean[0] + decay / 2 * w @ w, mean[1 : 1 + d] + decay * w, mean[1 + d :].reshape(d, d) + decay * np.eye(d)


def figure_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, x): the figures of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([figures(t) for t in b.column(1).to_pylist()], pa.list_(pa.float64()))], ["key", "x"])

    return docs.select(F.col(f"`{key}`").cast("bigint").alias("key"), F.col(f"`{text}`").alias("text")).mapInArrow(run, "key bigint, x array<double>")


def dealt(rows: DataFrame, n_rows: int, keys: dict[int, int]) -> DataFrame:
    """(block, good, bad): all rows (key, kind, x) by hashes of their keys; a kind with too few keys goes to as many blocks as needed."""
    n = max(1, round(n_rows / BLOCK))
    copies = {k: min(n, -(-n * LEAST // c)) for k, c in keys.items()}
    several = F.when(F.col("kind") == 1, F.lit(copies[1])).otherwise(F.lit(copies[0]))
    first = draw(SEED, F.col("key")) % n
    d = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), several - 1)))
    d = d.select("kind", "x", ((first + F.floor(F.col("copy") * F.lit(n) / several)) % n).alias("block"))  # copies lie evenly, each in another block
    lists = [F.flatten(F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.col("x"))))).alias(name) for k, name in ((1, "good"), (0, "bad"))]
    return d.groupBy("block").agg(*lists).where("size(good) > 0 and size(bad) > 0")


def quantile(values: DataFrame, share: float, name: str = "s") -> float:
    """The exact quantile of all values, between two as numpy has it: bins are counted and cut up until few values are left."""
    s = F.col(name)
    n, low, high = values.agg(F.count(s), F.min(s), F.max(s)).first()
    place = (n - 1) * share
    return (1 - place % 1) * _ranked(values, s, int(place), low, high) + place % 1 * _ranked(values, s, min(n - 1, int(place) + 1), low, high)


def _ranked(values: DataFrame, s, rank: int, low: float, high: float) -> float:
    """The value of a rank, from 0, of values from low to high."""
    while low < high:
        inside = values.where((s >= low) & (s <= high))
        width = (high - low) / BINS
        bin_ = F.least(F.floor((s - F.lit(low)) / F.lit(width)), F.lit(BINS - 1)) if width > 0 else F.when(s > low, 1).otherwise(0)
        for r in inside.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(s).alias("low"), F.max(s).alias("high")).orderBy("bin").collect():
            if rank < r["n"]:
                break
            rank -= r["n"]
        low, high = r["low"], r["high"]
        if r["n"] <= FEW:
            return values.where((s >= low) & (s <= high)).select(s).orderBy(s).collect()[rank][0]
    return low


def learn(docs: DataFrame, labels: DataFrame, held_out: int = HELD_OUT) -> Ranker:
    """A ranker from all labelled documents outside the held-out fold; a document labelled as both counts as both."""
    known = learnable(labels, held_out).where(F.col("quality").isin(0, 1))
    known = known.select(F.col("doc_id").cast("bigint").alias("key"), F.col("quality").cast("int").alias("kind")).distinct()
    rows = materialise(figure_rows(docs.where(fold(F.col("`doc_id`")) != held_out)).join(known, "key").select("key", "kind", "x"))
    size = len(figures(""))
    number = lambda x: x.cast("decimal(28,9)")
    x = [F.get("x", F.lit(i)) for i in range(size)]
    sums = rows.agg(F.sum(1 - F.col("kind")), F.sum("kind"), *[F.sum(number(c)) for c in x], *[F.sum(number(c * c)) for c in x]).first()
    model, counts = Ranker(), {k: sums[k] or 0 for k in (0, 1)}
    if counts[0] and counts[1]:
        n = counts[0] + counts[1]
        model.mean = np.array([float(v) for v in sums[2 : 2 + size]]) / n
        model.scale = np.sqrt(np.maximum(np.array([float(v) for v in sums[2 + size :]]) / n - model.mean**2, 0)) + 1e-9
        keys = {r["kind"]: r["n"] for r in rows.groupBy("kind").agg(F.countDistinct("key").alias("n")).collect()}
        blocks = materialise(dealt(rows, n, keys))
        model.fit(blocks)
        strengths = materialise(strength_rows(rows, model))
        model.cut = quantile(strengths, counts[0] / n)
        s = F.col("s")
        mean, square = (float(v) / n for v in strengths.agg(F.sum(number(s)), F.sum(number(s * s))).first())
        model.spread = float(np.sqrt(max(square - mean**2, 0))) / 4 + 1e-9
        discard(blocks)
        discard(strengths)
    discard(rows)
    return model


def strength_rows(rows: DataFrame, model: Ranker) -> DataFrame:
    """(s): the strengths of (x)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(model.strength(x) if len(x) else np.zeros(0), pa.float64())], ["s"])

    return rows.select("x").mapInArrow(run, "s double")


def score(docs: DataFrame, model: Ranker, text: str = "text", out: str = "score") -> DataFrame:
    """Adds the score and keeps every other column; a column of its name is replaced."""
    narrow = docs.drop(out)
    at, names = narrow.columns.index(text), narrow.columns
    schema = narrow.withColumn(out, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([figures(t) for t in b.column(at).to_pylist()])
            s = model.score(x) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], [*names, out])

    return mapped(narrow, run, schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", (fold() == HELD_OUT).alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))
