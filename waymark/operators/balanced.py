"""Balanced assignment of all rows to codes: entropic transport by alternating normalisation, with no matrix of rows by codes.

In logarithms the plan is -distance / epsilon less a potential of the row and one of the code. Only the codes' potentials are kept
between rounds: a batch works out its rows' potentials from them, adds up what each code gets, and Spark adds up the batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cosine distances lie within it; what a caller's distances may reach at most. Keeps a division by nothing from counting.
BOUND, LEAST = 1e3, 1e-8


def _distances(b: pd.DataFrame, vec: str, book: np.ndarray) -> np.ndarray:
    return -(np.array(b[vec].tolist(), dtype=np.float64).reshape(len(b), book.shape[1]) @ book.T)


def _plan(d: np.ndarray, centre: tuple[float, float], epsilon: float, potential: np.ndarray) -> np.ndarray:
    """Logarithms of the plan's rows, each of which adds up to one."""
    q = -np.clip((d - centre[0]) / centre[1], -BOUND, BOUND) / (epsilon + LEAST) - potential
    top = q.max(1, keepdims=True)
    return q - top - np.log(np.exp(q - top).sum(1, keepdims=True))


def potentials(df: DataFrame, book: np.ndarray, epsilon: float, rounds: int, vec: str = "vec") -> tuple[tuple[float, float], np.ndarray]:
    """((middle, half width) of all distances, the codes' potentials after so many rounds): a round is a pass that brings the driver a row a code."""
    k = len(book)

    def span(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                d = _distances(b, vec, book)
                yield pd.DataFrame({"low": [d.min()], "high": [d.max()], "odd": [not np.isfinite(d).all()]})

    s = df.select(vec).mapInPandas(span, "low double, high double, odd boolean").agg(F.min("low"), F.max("high"), F.max("odd")).first()
    if s[0] is None or s[2]:
        return (0.0, 1.0), np.full(k, np.nan if s[2] else 0.0)
    centre = ((s[1] + s[0]) / 2, (s[1] - s[0]) / 2 + 1e-5)
    potential = np.zeros(k)
    for _ in range(rounds):

        def got(batches: Iterator[pd.DataFrame], at: np.ndarray = potential) -> Iterator[pd.DataFrame]:
            total = np.zeros(k)
            for b in batches:
                if len(b):
                    total += np.exp(_plan(_distances(b, vec, book), centre, epsilon, at)).sum(0)
            yield pd.DataFrame({"code": np.arange(k, dtype=np.int32), "s": total})

        sums = np.zeros(k)
        for r in df.select(vec).mapInPandas(got, "code int, s double").groupBy("code").agg(F.sum("s").alias("s")).collect():  # k rows
            sums[r["code"]] = r["s"]
        potential = potential + np.log(sums + LEAST)
    return centre, potential


def balanced(df: DataFrame, book: np.ndarray, epsilon: float = 0.05, rounds: int = 50, vec: str = "vec", out: str = "code") -> DataFrame:
    """Adds the code that each row gets most of in a plan where all codes get alike; the book's rows are unit vectors, distances cosines.

    Where any distance is no finite number every row gets its nearest code; nearly equal ones go to the lower code; no rounds: the nearest.
    """
    centre, potential = potentials(df, book, epsilon, rounds, vec)
    schema = df.withColumn(out, F.lit(0)).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                code = np.zeros(0, dtype=np.int32)
            elif np.isfinite(potential).all():
                code = _plan(_distances(b, vec, book), centre, epsilon, potential).round(9).argmax(1)
            else:
                d = _distances(b, vec, book)
                code = np.where(np.isnan(d), np.inf, d).round(9).argmin(1)
            yield b.assign(**{out: code.astype(np.int32)})

    return df.mapInPandas(run, schema)
