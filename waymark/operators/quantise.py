"""Residual cosine quantisation: assignment, codebook training by k-means rounds, balanced assignment, pooling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vector
from ..functions.draws import draw
from ..session import cut, discard
from . import seeding

#: Components of a vector that one row of sums holds, so that the plan is the same for any length.
WIDTH = 16


def assign_level(df: DataFrame, codebook: DataFrame, level: int) -> DataFrame:
    """Adds code_{level} and takes the projection off the residual: the largest cosine, ties to the lower code.

    codebook: (code, direction) of unit vectors, at most a few thousand rows; it is checked and then broadcast.
    """
    book = [(r["code"], r["direction"]) for r in codebook.orderBy("code").limit(4097).collect()]
    if len(book) > 4096:
        raise ValueError("a codebook has at most 4096 codes")
    scores = F.array(*[F.struct(F.round(vector.dot(F.col("residual"), F.array(*[F.lit(float(x)) for x in v])), 9).alias("s"), F.lit(-c).alias("k"), F.array(*[F.lit(float(x)) for x in v]).alias("v")) for c, v in book])
    d = df.withColumn("_best", F.array_max(scores))
    scalar = F.greatest(F.lit(0.0), F.col("_best")["s"])
    d = d.withColumn(f"code_{level}", (-F.col("_best")["k"]).cast("int")).withColumn("_p", F.transform(F.col("_best")["v"], lambda x: x * scalar))
    return d.withColumn("residual", F.zip_with("residual", "_p", lambda a, b: a - b)).withColumn("reconstruction", F.zip_with("reconstruction", "_p", lambda a, b: a + b)).drop("_best", "_p")


def assign(df: DataFrame, books: list[np.ndarray], vec: str = "vec") -> DataFrame:
    """(…, indices, reconstruction) by all levels at once, in Arrow batches: codebooks of k x d numbers go to each task."""
    schema = df.withColumn("indices", F.array().cast("array<int>")).withColumn("reconstruction", F.array().cast("array<double>")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.array(b[vec].tolist(), dtype=np.float64) if len(b) else np.zeros((0, books[0].shape[1]))
            r, codes = x.copy(), []
            for book in books:
                s = r @ book.T
                c = s.round(9).argmax(1)  # what is nearly equal, such as a residual of nothing, goes to the lower code
                r -= np.maximum(0, s[np.arange(len(c)), c])[:, None] * book[c]
                codes.append(c)
            yield b.assign(indices=list(np.stack(codes, 1).astype(np.int32)) if len(b) else [], reconstruction=list(x - r) if len(b) else [])

    return df.mapInPandas(run, schema)


def code_sums(df: DataFrame, book: np.ndarray, vec: str = "vec", unit: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(sums of the vectors by their code, how many): a task adds up its own vectors, the driver gets a few rows a code, of WIDTH components each."""
    (k, d), names = book.shape, [f"s{i}" for i in range(WIDTH)]
    wide = -(-d // WIDTH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, used = np.zeros((k, wide * WIDTH)), np.zeros(k, dtype=np.int64)
        for b in batches:
            if b.num_rows:
                x = vector.matrix(b.column(0))
                c = (x @ book.T).round(9).argmax(1)
                np.add.at(total[:, :d], c, x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12) if unit else x)
                used += np.bincount(c, minlength=k)
        code, part = np.repeat(np.flatnonzero(used), wide), np.tile(np.arange(wide), np.count_nonzero(used))
        sums = total.reshape(k, wide, WIDTH)[code, part]
        yield pa.RecordBatch.from_pydict({"code": code.astype(np.int32), "part": part.astype(np.int32), "n": used[code]} | {s: sums[:, i] for i, s in enumerate(names)})

    each = df.select(vec).mapInArrow(run, f"code int, part int, n bigint, {', '.join(f'{s} double' for s in names)}")
    rows = each.groupBy("code", "part").agg(*[F.sum(c).alias(c) for c in ("n", *names)]).collect()  # k times a vector
    total, used = np.zeros((k, wide, WIDTH)), np.zeros(k)
    for r in rows:
        total[r["code"], r["part"]], used[r["code"]] = [r[s] for s in names], r["n"]
    return total.reshape(k, wide * WIDTH)[:, :d], used


def _unit(x: np.ndarray) -> np.ndarray:
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)


def train(df: DataFrame, levels: int, k: int, rounds: int = 10, vec: str = "vec", key: str = "id", decay: float = 0.95, seed: int = 42, first_rounds: int = 10) -> list[np.ndarray]:
    """Codebooks by level: k-means rounds on the residuals, then moving averages; codes used less than a fifth of the mean are drawn anew.

    Vectors that are null or empty, or hold null or non-finite components, teach nothing. Residuals are written out for each level,
    so a round reads them and not all levels before, and deleted once those of the next level are there. A level's first codes come from
    k-means|| over its unit vectors, moved by `first_rounds` of k-means; then each of `rounds` moves sums of unit vectors and counts
    by `decay`: one move a pass over all vectors, where a trainer by batches makes one a batch.
    """
    books: list[np.ndarray] = []
    res = cut(df.select(F.col(key).alias("id"), F.col(vec).cast("array<double>").alias("vec")).where(vector.finite(F.col("vec"))))

    def some(name: str, n: int) -> np.ndarray:
        return np.array([r[0] for r in res.orderBy(draw(name, F.col("id")), "id").limit(n).select("vec").collect()], dtype=np.float64)

    for level in range(levels):
        book = _unit(seeding.start(res.select("id", vector.unit_or_zero(F.col("vec")).alias("vec")), k, seed=seed + level))
        for _ in range(first_rounds):
            total, used = code_sums(res, book)
            book = np.where(used[:, None] > 0, _unit(total), book)
        size, mass = np.ones(len(book)), book.copy()
        for round_ in range(rounds):
            total, used = code_sums(res, book, unit=True)
            share = len(book) / max(1.0, used.sum())  # a round sees all vectors, so its sums are brought to one a code
            size, mass = decay * size + (1 - decay) * used * share, decay * mass + (1 - decay) * total * share
            dead = np.flatnonzero(size < 0.2 * size.mean())
            if len(dead) and round_ < rounds - 1:
                new = _unit(some(f"{seed}-{level}-{round_}", len(dead)))
                size[dead[: len(new)]], mass[dead[: len(new)]] = 1.0, new
            book = np.where((size > 1e-9)[:, None], _unit(mass), book)
        books.append(book)
        if level < levels - 1:
            left = cut(assign(res, [book]).select("id", F.zip_with("vec", "reconstruction", lambda a, b: a - b).alias("vec")))
            discard(res)
            res = left
    discard(res)
    return books


def quantisation_loss(df: DataFrame, books: list[np.ndarray], vec: str = "vec", beta: float = 0.25, moving: bool = True) -> DataFrame:
    """(rows, loss): the mean over the levels of the mean squares that a level's projection leaves; with books that are learned by
    gradients instead of moving averages the codebook's part comes on top of beta times it."""
    weight = beta if moving else 1 + beta
    done, out = df.select(F.col(vec).cast("array<double>").alias("vec")), []
    schema = "loss array<double>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                r, left = np.array(b["vec"].tolist(), dtype=np.float64), []
                for book in books:
                    s = r @ book.T
                    c = s.round(9).argmax(1)
                    r = r - np.maximum(0, s[np.arange(len(c)), c])[:, None] * book[c]
                    left.append((r * r).mean(1))
                yield pd.DataFrame({"loss": list(np.stack(left, 1))})

    each = done.mapInPandas(run, schema)
    out = [F.avg(F.get("loss", F.lit(i))) for i in range(len(books))]
    return each.agg(F.count(F.lit(1)).alias("rows"), (F.lit(weight) * sum(out[1:], out[0]) / len(books)).alias("loss"))


def attention_pooled(tokens: DataFrame, attention: DataFrame, dimension: int) -> DataFrame:
    """(id, vec): the mean over the asking tokens of what each attends to, heads averaged.

    tokens: (id, position, vec); attention: (id, head, asker, position, weight). Values that are not finite, and zero vectors, are errors.
    """
    heads = attention.groupBy("id").agg((F.countDistinct("head") * F.countDistinct("asker")).alias("_m"))
    w = attention.groupBy("id", "position").agg(F.sum("weight").alias("_w")).join(heads, "id").withColumn("_w", F.col("_w") / F.col("_m"))
    sums = [F.sum(F.get("vec", F.lit(i)) * F.col("_w")) for i in range(dimension)]
    d = tokens.join(w, ["id", "position"]).groupBy("id").agg(F.array(*sums).alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    bad = F.raise_error(F.lit("a pooled vector is not finite or zero"))
    return d.select("id", F.when(finite & F.exists("vec", lambda x: x != 0), F.col("vec")).otherwise(bad).alias("vec"))


def sinkhorn(distances: np.ndarray, epsilon: float, rounds: int) -> np.ndarray:
    """Balanced assignment of one batch: centred distances to a transport plan by alternating normalisation; NaN gives the plain one."""
    mid, half = (distances.max() + distances.min()) / 2, (distances.max() - distances.min()) / 2 + 1e-5
    q = np.exp(-((distances - mid) / half) / epsilon)
    q /= q.sum()
    n, k = q.shape
    for _ in range(rounds):
        q /= q.sum(0, keepdims=True) * k
        q /= q.sum(1, keepdims=True) * n
    return distances.argmin(1) if not np.isfinite(q).all() else q.argmax(1)


def mean_pooled(tokens: DataFrame, dimension: int) -> DataFrame:
    """(id, vec): means of the token vectors that the mask lets through; texts without any are an error."""
    kept = F.sum(F.col("mask"))
    means = [F.try_divide(F.sum(F.get("vec", F.lit(i)) * F.col("mask")), kept) for i in range(dimension)]
    return tokens.groupBy("id").agg(F.when(kept > 0, F.array(*means)).otherwise(F.raise_error(F.lit("no token to pool"))).alias("vec"))


def pca_signed(df: DataFrame, vec: str, n: int) -> DataFrame:
    """Principal components of ml.feature with each component's largest loading positive, so that signs repeat."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    m = PCA(k=n, inputCol="_v", outputCol="_o").fit(df.select(array_to_vector(vec).alias("_v")))
    pc = m.pc.toArray()
    sign = [1.0 if pc[np.abs(pc[:, j]).argmax(), j] > 0 else -1.0 for j in range(n)]
    d = m.transform(df.withColumn("_v", array_to_vector(vec)))
    return d.withColumn("components", F.zip_with(vector_to_array("_o"), F.array(*[F.lit(s) for s in sign]), lambda a, b: a * b)).drop("_v", "_o")


