"""Candidate-constrained decoding: a flat prefix tree of all allowed answers and beams of a whole batch that go down it together."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Nodes of a tree that goes to every worker, of some 30 bytes; with more, score the candidates as rows (``models.constrained``).
MOST_NODES = 20_000_000


class Tree:
    """Answers as sequences of token numbers, in sorted order; children of a node lie side by side, nodes of a depth in the answers' order.

    token: of each node; first, last: the range of its children; answer: the number of the answer that ends there, or -1.
    """

    def __init__(self, sequences: list[list[int]]):
        rows = sorted({tuple(s) for s in sequences if len(s)})
        if not rows:
            raise ValueError("no answer has a token")
        if sum(map(len, rows)) > MOST_NODES:
            raise ValueError(f"the answers have more than {MOST_NODES} tokens; score them as rows instead")
        self.rows, deep = rows, max(map(len, rows))
        grid = np.full((len(rows), deep), -1, np.int64)
        for i, r in enumerate(rows):
            grid[i, : len(r)] = r
        token, parent, answer = [np.array([-1])], [np.array([-1])], [np.array([-1])]
        at, before, total = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), 1
        for depth in range(deep):
            there = np.flatnonzero(grid[:, depth] >= 0)
            new = np.ones(len(there), bool)
            new[1:] = (grid[there[1:], depth] != grid[there[:-1], depth]) | (before[there[1:]] != before[there[:-1]])
            number = total + np.cumsum(new) - 1
            at[there] = number
            token.append(grid[there[new], depth])
            parent.append(before[there[new]])
            ends = np.full(int(new.sum()), -1, np.int64)
            done = np.array([len(rows[i]) == depth + 1 for i in there])
            ends[number[done] - total] = there[done]
            answer.append(ends)
            before, total = at.copy(), total + int(new.sum())
        self.token, self.parent, self.answer = map(np.concatenate, (token, parent, answer))
        kids = np.bincount(self.parent[1:], minlength=total)
        self.first = np.concatenate([[1], 1 + np.cumsum(kids)[:-1]])
        self.last = self.first + kids

    def __len__(self) -> int:
        return len(self.rows)


class Scorer(Protocol):
    """What a model says of next tokens: for each asked pair the log-probability of going from a node to a child, for its context."""

    def __call__(self, contexts: list, tree: Tree, context: np.ndarray, node: np.ndarray, child: np.ndarray) -> np.ndarray: ...


def beams(contexts: list, tree: Tree, scorer: Scorer, k: int, width: int | None = None, end: Scorer | None = None) -> list[list[int]]:
    """The numbers of the k best answers for each context; all contexts take a step at a time, and a step asks the scorer once.

    The width is five times k, at least 50, at most the number of answers; nearly equal sums go to the smaller sequence. An answer that
    others go on from may end where it is, at what `end` says of it, if that is given.
    """
    k = min(k, len(tree))
    width = min(len(tree), width or max(5 * k, 50))
    context, node, total = np.arange(len(contexts)), np.zeros(len(contexts), np.int64), np.zeros(len(contexts))
    ended: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(node):
        many = tree.last[node] - tree.first[node]
        beam = np.repeat(np.arange(len(node)), many)
        child = np.arange(len(beam)) - np.repeat(np.cumsum(many) - many, many) + tree.first[node][beam]
        if not len(child):
            break
        sums = total[beam] + scorer(contexts, tree, context[beam], node[beam], child)
        c = context[beam]
        order = np.lexsort((child, -sums.round(9), c))
        c, child, sums = c[order], child[order], sums[order]
        place = np.arange(len(c)) - np.searchsorted(c, c)
        kept = (place < width) & (sums > -np.inf)
        context, node, total = c[kept], child[kept], sums[kept]
        over = tree.answer[node] >= 0
        cost = np.zeros(int(over.sum()))
        more = (tree.last[node] > tree.first[node])[over]
        if end is not None and more.any():
            cost[more] = end(contexts, tree, context[over][more], node[over][more], node[over][more])
        ended.append((context[over], tree.answer[node[over]], total[over] + cost))
    out: list[list[int]] = [[] for _ in contexts]
    if ended:
        c, answer, sums = map(np.concatenate, zip(*ended, strict=True))
        for i in np.lexsort((answer, -sums.round(9), c)):
            if len(out[c[i]]) < k:
                out[c[i]].append(int(answer[i]))
    return out


class Vocabulary:
    """Tokens of answers by number, in the order of their texts."""

    def __init__(self, tokens: list[str]):
        self.tokens = sorted(set(tokens))
        self.number = {t: i for i, t in enumerate(self.tokens)}


def answers(space: DataFrame, tokens: str) -> tuple[Vocabulary, Tree]:
    """The tree of a candidate space, a row an answer with an array of its tokens; its size is checked before it comes to the driver."""
    held = space.select(tokens).where(F.size(tokens) > 0).distinct()
    n = held.agg(F.sum(F.size(tokens))).first()[0] or 0
    if n > MOST_NODES:
        raise ValueError(f"the answers have {n} tokens, more than {MOST_NODES}; score them as rows instead")
    rows = [list(r[0]) for r in held.collect()]
    vocabulary = Vocabulary([t for r in rows for t in r])
    return vocabulary, Tree([[vocabulary.number[t] for t in r] for r in rows])


def decoded(df: DataFrame, context: str, vocabulary: Vocabulary, tree: Tree, scorer: Scorer, k: int = 10, width: int | None = None, out: str = "prediction", end: Scorer | None = None) -> DataFrame:
    """Adds the k best answers to each row's context, joined by spaces; tree and scorer go to each worker once."""
    schema = T.StructType([*[f for f in df.schema.fields if f.name != out], T.StructField(out, T.StringType())])
    held = df.sparkSession.sparkContext.broadcast((vocabulary.tokens, tree, scorer, end))  # size checked in Tree

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, t, s, e = held.value
        texts: dict[int, str] = {}
        for b in batches:
            told = []
            for start in range(0, len(b), 256):  # contexts that go down together
                for best in beams(list(b[context].iloc[start : start + 256]), t, s, k, width, e):
                    told.append(" ".join(texts.setdefault(i, "".join(tokens[x] for x in t.rows[i])) for i in best))
            yield b.drop(columns=[out], errors="ignore").assign(**{out: told})

    return df.mapInPandas(run, schema)


class PathCounts:
    """STAND-IN for a model: log((n of the child + 1) / (n of the node + its children)) by how often a context took each path.

    counts: {context: {path: n}}, a path being the texts of the tokens on the way; () has the context's total.
    """

    def __init__(self, vocabulary: Vocabulary, tree: Tree, counts: dict):
        paths: list[tuple] = [()]
        for i in range(1, len(tree.token)):
            paths.append((*paths[tree.parent[i]], vocabulary.tokens[tree.token[i]]))
        number = {p: i for i, p in enumerate(paths)}
        self.n = {c: {number[p]: n for p, n in by.items() if p in number} for c, by in counts.items()}

    def __call__(self, contexts: list, tree: Tree, context: np.ndarray, node: np.ndarray, child: np.ndarray) -> np.ndarray:
        up, down = np.zeros(len(node)), np.zeros(len(node))
        for c in np.unique(context):
            by, at = self.n.get(contexts[c], {}), context == c
            up[at], down[at] = [by.get(i, 0) for i in child[at].tolist()], [by.get(i, 0) for i in node[at].tolist()]
        return np.log((up + 1) / (down + (tree.last[node] - tree.first[node])))
