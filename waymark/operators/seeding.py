"""First codes by k-means||: a few oversampled rounds over all vectors, then the drawn ones, weighed by whom they are nearest to, become k."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vector
from ..functions.draws import draw
from ..session import cut, discard

#: Rounds, and how many vectors a round draws in the mean, as a multiple of k.
ROUNDS, OVERSAMPLE = 5, 2.0


def squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None, :], 0)


def _matrix(b: pd.DataFrame, vec: str) -> np.ndarray:
    return np.array(b[vec].tolist(), dtype=np.float64)


def nearest(df: DataFrame, centres: np.ndarray, vec: str = "vec") -> DataFrame:
    """Adds code and square: the nearest centre, the first of equal ones, and its squared distance; the centres go to each task."""
    schema = df.withColumns({"code": F.lit(0), "square": F.lit(0.0)}).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            c, square = _near(_matrix(b, vec), centres) if len(b) else (np.zeros(0), np.zeros(0))
            yield b.assign(code=c.astype(np.int32), square=square)

    return df.mapInPandas(run, schema)


def _near(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = squares(x, centres)
    c = d.round(9).argmin(1)
    return c, d[np.arange(len(c)), c]


def _all_squares(df: DataFrame, centres: np.ndarray) -> float:
    """The sum of all vectors' squared distances to their nearest centres."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"square": [float(sum(_near(vector.matrix(b.column(0)), centres)[1].sum() for b in batches if b.num_rows))]})

    return math.fsum(r[0] for r in df.select("vec").mapInArrow(run, "square double").collect())  # a number a task


def _far(df: DataFrame, centres: np.ndarray, rate: float, seed: str) -> DataFrame:
    """(id, vec) of the vectors that a round draws: the chance is their squared distance times rate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                square = _near(vector.matrix(b.column(1)), centres)[1]
                yield b.filter(pa.array((b.column(2).to_numpy(zero_copy_only=False) < square * rate) & (square > 0))).select([0, 1])

    return df.select("id", "vec", draw(seed, F.col("id")).alias("u")).mapInArrow(run, df.select("id", "vec").schema)


def _counts(df: DataFrame, centres: np.ndarray) -> np.ndarray:
    """How many vectors each centre is the nearest to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = sum((np.bincount(_near(vector.matrix(b.column(0)), centres)[0], minlength=len(centres)) for b in batches if b.num_rows), np.zeros(len(centres), dtype=np.int64))
        yield pa.RecordBatch.from_pydict({"code": np.flatnonzero(n).astype(np.int32), "n": n[n > 0]})

    counts = {r["code"]: r["n"] for r in df.select("vec").mapInArrow(run, "code int, n bigint").groupBy("code").agg(F.sum("n").alias("n")).collect()}  # a row a centre
    return np.array([counts.get(i, 0) for i in range(len(centres))], float)


def weighted_start(points: np.ndarray, weights: np.ndarray, k: int, seed: int, moves: int = 20, tries: int = 10) -> np.ndarray:
    """k centres of weighted points: the best of some k-means++ draws with Lloyd moves; the points are the bounded sample of start()."""
    rng = np.random.default_rng(seed)
    return min((_one_start(points, weights, k, rng, moves) for _ in range(tries)), key=lambda c: float((weights * squares(points, c).min(1)).sum()))


def _one_start(points: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator, moves: int) -> np.ndarray:
    at = [int(rng.choice(len(points), p=weights / weights.sum()))]
    far = squares(points, points[at]).min(1)
    while len(at) < min(k, len(points)):
        p = weights * far
        i = int(rng.choice(len(points), p=p / p.sum())) if p.sum() > 0 else next(j for j in range(len(points)) if j not in at)
        at.append(i)
        far = np.minimum(far, squares(points, points[[i]])[:, 0])
    centres = points[at].copy()
    for _ in range(moves):
        c = squares(points, centres).argmin(1)
        mass = np.bincount(c, weights, len(centres))
        moved = np.stack([np.bincount(c, weights * points[:, j], len(centres)) for j in range(points.shape[1])], 1)
        centres = np.where(mass[:, None] > 0, moved / np.maximum(mass, 1e-300)[:, None], centres)
    return centres


def start(df: DataFrame, k: int, vec: str = "vec", key: str = "id", seed: int = 42, rounds: int = ROUNDS, oversample: float = OVERSAMPLE) -> np.ndarray:
    """k centres, or as many as there are distinct vectors if those are fewer.

    Each round draws a vector with the chance oversample * k * square / all squares, by a hash of its key, so that reruns agree. What
    the driver holds is the drawn vectors, some rounds * oversample * k of them; every pass reads all vectors. They are written once
    and deleted at the end; squares are computed again where they are read again.
    """
    d = cut(df.select(F.col(key).alias("id"), F.col(vec).cast("array<double>").alias("vec")).where(F.col(vec).isNotNull()))
    first = d.orderBy(draw(f"{seed}-first", F.col("id")), "id").limit(1).collect()
    if not first:
        raise ValueError("no vectors to start from")
    drawn = [np.array(first[0]["vec"])]
    for r in range(rounds):
        total = _all_squares(d, np.array(drawn))
        if not total:
            break
        more = _far(d, np.array(drawn), oversample * k / total, f"{seed}-{r}").orderBy("id").select("vec").collect()  # oversample * k in the mean
        drawn += [np.array(x["vec"]) for x in more]
    points = np.unique(np.array(drawn), axis=0)
    if len(points) < k:  # few or heavy copies: fill up with distinct vectors, farthest first
        for _ in range(k - len(points)):
            x = nearest(d, points).orderBy(F.col("square").desc(), "id").limit(1).first()
            if x["square"] <= 1e-12:
                break
            points = np.vstack([points, x["vec"]])
    counts = _counts(d, points)
    discard(d)
    return weighted_start(points, counts + 1e-9, k, seed)
