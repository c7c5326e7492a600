"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives, all training-side documents, whatever their labels, are unlabelled, and the share of
toxic ones among labelled rows is the class prior. A document is the character 5- and 6-grams, beginnings and wholes of its distinct
lower-case words. The GRAMS grams that set the positives apart most, by totals over all unlabelled documents, are the inputs of a
logistic model, which numpy trains on the risk  p E+[l(g)] + max(0, Eu[l(-g)] - p E+[l(-g)]);  where the second part falls below
zero, a step climbs it back instead. Its steps draw from bounded samples of the positives and of the unlabelled documents.

Edge cases: a null text counts as an empty one and has the score of a document without any gram; with no confirmed positives
every score is the prior of 0; null labels are not used; repeated rows and equal texts get equal scores; a very long text is read
whole; an empty table gives none; extra columns stay whatever their names, but one named like the score is replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, mapped, materialise, small_batches, table
from .labelled import learnable, sample_ids, texts_of

#: Confirmed positives and unlabelled rows that the steps draw from, at most.
POSITIVES, UNLABELLED = 2500, 5000
GRAMS = 2048
HELD_OUT = 0
SEED = "toxicity-1"
#: Word types whose grams a task keeps; then the table begins anew.
KEPT_WORDS = 300_000
#: Grams whose sums a task keeps; then it sends them.
KEPT_GRAMS = 1_000_000

#: Distinct words of a document that count for a gram, at most.
MOST_WORDS = 3

_WORD = re.compile(r"[^\W\d_]+")


def grams(word: str) -> set[str]:
    """Each 5- and 6-gram of <word>, its beginnings of 4 to 9 characters and the whole."""
    w = f"<{word}>"
    n = len(w)
    found = {w[i : i + 5] for i in range(n - 4)}
    found.update([w[i : i + 6] for i in range(n - 5)])
    found.update((w[:5], w[:6], w[:7], w[:8], w[:9], w))
    return found


def words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


class Model:
    """Weights of chosen grams; scoring looks up each distinct word once."""

    def __init__(self, chosen: list[str], weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias
        self.place = {g: i for i, g in enumerate(chosen)}
        self.kept: dict[str, tuple[int, ...]] = {}

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "place": self.place, "kept": {}}

    def counts(self, text: str | None) -> dict[int, int]:
        """How many distinct words of the text have each chosen gram."""
        kept, place, hit = self.kept, self.place, {}
        chosen = place.keys()
        for w in words(text):
            got = kept.get(w)
            if got is None:
                got = tuple([place[g] for g in chosen & grams(w)])
                if len(kept) >= KEPT_WORDS:
                    kept.clear()
                kept[w] = got
            for i in got:
                hit[i] = hit.get(i, 0) + 1
        return hit

    def score(self, text: str | None) -> float:
        hit, g = self.counts(text), self.bias
        if hit:
            at = sorted(hit)
            g += float(self.weights[at] @ np.array([min(hit[i], MOST_WORDS) for i in at], dtype=np.float64))
        return float(1 / (1 + np.exp(-np.clip(g, -30, 30))))


def word_counts(texts: DataFrame, kind: int, text: str = "text") -> DataFrame:
    """(kind, word, n): in how many documents each word is; a task sums first, and sends what it has when its table is full."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                held.update(words(t))
            if len(held) > KEPT_WORDS:
                yield made()
                held.clear()
        yield made()

    each = texts.select(F.col(text)).mapInArrow(run, "word string, n bigint")
    return each.groupBy("word").agg(F.sum("n").alias("n")).select(F.lit(kind).alias("kind"), "word", "n")


def gram_sums(counts: DataFrame) -> DataFrame:
    """(kind, gram, total): in how many distinct words of documents each gram is, from (kind, word, n)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Counter] = {}

        def made() -> Iterator[pa.RecordBatch]:
            for kind, own in held.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), kind), pa.int32()), pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())], ["kind", "gram", "n"])

        for b in batches:
            for kind, w, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = held.setdefault(kind, Counter())
                for g in grams(w):
                    own[g] += n
            if sum(map(len, held.values())) > KEPT_GRAMS:
                yield from made()
                held.clear()
        yield from made()

    return counts.mapInArrow(run, "kind int, gram string, n bigint").groupBy("kind", "gram").agg(F.sum("n").alias("total"))


def choose(sums: DataFrame, n_pos: int, n_unl: int, most: int = GRAMS) -> list[str]:
    """The grams with the largest difference of mean counts, in standard errors of counts; ties by text."""
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("total")).otherwise(0))
    by = sums.groupBy("gram").agg((of(1) / max(1, n_pos)).alias("p"), (of(0) / max(1, n_unl)).alias("u"))
    z = (F.col("p") - F.col("u")) / F.sqrt((F.col("p") + 1 / max(1, n_pos)) / max(1, n_pos) + (F.col("u") + 1 / max(1, n_unl)) / max(1, n_unl))
    return sorted(r[0] for r in by.orderBy(z.desc(), "gram").limit(most).select("gram").collect())


def dense_rows(texts: DataFrame, chosen: list[str], text: str = "text") -> DataFrame:
    """(kind, key, x): a byte for each chosen gram."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(chosen, np.zeros(len(chosen)), 0.0)
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                x = np.zeros(len(chosen), dtype=np.uint8)
                for i, n in model.counts(t).items():
                    x[i] = min(n, MOST_WORDS)
                out.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out, pa.binary())], ["kind", "key", "x"])

    return texts.select("kind", text, "key").mapInArrow(run, "kind int, key bigint, x binary")


def risk(p: np.ndarray, u: np.ndarray, w: np.ndarray, prior: float, beta: float = 0.0) -> tuple[float, float, np.ndarray]:
    """(positive part, negative part, gradient of the step): of the risk, or of minus its negative part where that is below -beta.

    The last weight is the bias. The loss is l(z) = log(1 + exp(-z)): l'(g) = -sig(-g) for a positive, sig(g) for a negative.
    """
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    gp, gu = p @ w[:-1] + w[-1], u @ w[:-1] + w[-1]
    positive = prior * np.logaddexp(0, -gp).mean()
    negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
    d_neg_u, d_neg_p = sig(gu) / len(gu), -prior * sig(gp) / len(gp)
    if negative >= -beta:
        dp, du = -prior * sig(-gp) / len(gp) + d_neg_p, d_neg_u
    else:
        dp, du = -d_neg_p, -d_neg_u
    dp, du = dp.astype(p.dtype), du.astype(u.dtype)
    return float(positive), float(negative), np.append(dp @ p + du @ u, dp.sum() + du.sum())


def nnpu(pos: np.ndarray, unl: np.ndarray, prior: float, steps: int = 1500, rate: float = 0.01, decay: float = 3e-3, beta: float = 0.0, seed: int = 11) -> tuple[np.ndarray, float]:
    """Weights and bias of the logistic model, by Adam on mini-batches of the corrected risk; the mean over the later half of the steps.

    The climbs make single steps swing about the corrected risk's edge, so the last one depends on the draw; their mean hardly does.
    """
    rng = np.random.default_rng(seed)
    pos, unl = pos.astype(np.float32), unl.astype(np.float32)
    w = np.zeros(pos.shape[1] + 1, dtype=np.float32)
    w[-1] = -1.0
    m, v, late = np.zeros_like(w), np.zeros_like(w), np.zeros(len(w))
    for t in range(1, steps + 1):
        p = pos[rng.integers(0, len(pos), min(256, len(pos)))]
        u = unl[rng.integers(0, len(unl), min(512, len(unl)))]
        grad = risk(p, u, w, prior, beta)[2]
        grad[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        if 2 * t > steps:
            late += w
    late /= max(1, steps - steps // 2)
    return late[:-1], float(late[-1])


def learn(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, held_out: int = HELD_OUT) -> Model:
    """A model from bounded samples of the rows outside the held-out fold."""
    known = learnable(labels, held_out).where(F.col("toxic").isin(0, 1))
    counts = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    none = Model([], np.zeros(0), -30.0)
    if not counts.get(1):
        return none
    prior = counts[1] / sum(counts.values())
    pos = sample_ids(known.where("toxic = 1"), positives, SEED)
    there = docs.where(fold() != held_out)
    unl = sample_ids(there, unlabelled, SEED)
    # The sample is bounded; written out and dealt evenly, the documents are scanned once for both passes over it.
    texts = materialise(texts_of(docs, {1: pos, 0: unl}).repartition(docs.sparkSession.sparkContext.defaultParallelism, "key"))
    counts = word_counts(there, 0).unionByName(word_counts(texts.where("kind = 1"), 1))
    chosen = choose(gram_sums(counts), len(pos), there.count())
    rows = sorted(dense_rows(texts, chosen).collect(), key=lambda r: (r["key"], bytes(r["x"])))
    x = [np.frombuffer(b"".join(r["x"] for r in rows if r["kind"] == k), dtype=np.uint8).reshape(-1, max(1, len(chosen))) for k in (0, 1)]
    if not len(x[0]) or not len(x[1]):
        return none
    return Model(chosen, *nnpu(x[1], x[0], min(prior, 0.9)))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Puts the score in the text's place; other columns stay, a column of its name is replaced."""
    narrow = docs.drop(out)
    at, names = narrow.columns.index(text), narrow.columns
    schema = narrow.drop(text).withColumn(out, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [model.score(t) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(names)) if i != at] + [pa.array(s, pa.float64())], schema.names)

    return mapped(narrow, run, schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", (fold() == HELD_OUT).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
