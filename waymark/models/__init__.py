"""Pluggable encoders and generators, with deterministic stand-ins that are no language models.

A real model implements ``TextEncoder.encode`` or ``Generator.generate`` over batches; it is loaded once for each Python worker.
Training is out of scope: external programs do it, and nothing here stands in for them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class TextEncoder(Protocol):
    """Texts to vectors of one length."""

    dimension: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashedGrams:
    """STAND-IN: counts of hashed character 3-grams with hashed signs, as unit vectors."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension))
        for row, t in zip(out, texts, strict=True):
            t = f"  {t} "
            for i in range(len(t) - 2):
                h = int.from_bytes(hashlib.blake2b(t[i : i + 3].encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
                row[h % self.dimension] += 1 if h >> 63 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        out[n[:, 0] == 0, 0] = 1.0
        return out / np.where(n > 0, n, 1.0)


def encoded(df: DataFrame, text: str, encoder: TextEncoder | None = None, out: str = "vec") -> DataFrame:
    """Adds the vector of each text; vectors that are not finite are an error."""
    model = encoder or HashedGrams()
    schema = df.withColumn(out, F.array().cast("array<double>")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            v = model.encode([t or "" for t in b[text]]) if len(b) else np.zeros((0, model.dimension))
            if not np.isfinite(v).all():
                raise ValueError("a vector is not finite")
            yield b.assign(**{out: list(v)})

    return df.mapInPandas(run, schema)


class Generator(Protocol):
    """Prompts, and for each the candidates with their scores, to answers."""

    def generate(self, prompts: list[str], candidates: list[list[str]], k: int) -> list[str]: ...


class FirstCandidates:
    """STAND-IN: the candidates in the order they came, which is that of the ranker before."""

    def generate(self, prompts: list[str], candidates: list[list[str]], k: int) -> list[str]:
        return [" ".join(list(dict.fromkeys(c))[:k]) for c in candidates]


def generated(df: DataFrame, prompt: str, candidates: str | list[str], k: int = 10, generator: Generator | None = None, out: str = "prediction") -> DataFrame:
    """Adds the answer to each prompt, made of candidates only: those of a column, or one list for all, which goes to each worker once."""
    model = generator or FirstCandidates()
    schema = df.withColumn(out, F.lit("")).schema
    shared = df.sparkSession.sparkContext.broadcast(candidates) if isinstance(candidates, list) else None  # callers bound it

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lists = [shared.value] * len(b) if shared is not None else [list(c) for c in b[candidates]]
            yield b.assign(**{out: model.generate(list(b[prompt]), lists, k) if len(b) else []})

    return df.mapInPandas(run, schema)


class ChatTemplate(Protocol):
    """A tokenizer's own way of writing a conversation down, up to where the answer begins; it may take arguments of its own."""

    def apply_chat_template(self, messages: list[dict], **arguments) -> str: ...


def template_arguments(model: dict) -> dict:
    """The template's arguments of a model's configuration; `enable_thinking` may stand beside them."""
    told = dict(model.get("chat_template_kwargs") or {})
    if "enable_thinking" in model:
        told.setdefault("enable_thinking", bool(model["enable_thinking"]))
    return told


def conversation(messages: list[dict], template: ChatTemplate | None = None, arguments: dict | None = None) -> str:
    """A conversation by its template. Arguments that it doesn't know are left out; a template that fails otherwise, or none, gives the plain form."""
    if template is not None:
        for told in (arguments or {}, {}):
            try:
                return template.apply_chat_template(messages, **told)
            except TypeError as e:
                if not told or "unexpected keyword argument" not in str(e):
                    raise
            except Exception:
                break
    return "\n\n".join([*(f"[{m['role'].upper()}]\n{m['content']}" for m in messages), "[ASSISTANT]\n"])


def rendered(df: DataFrame, messages: str, template: ChatTemplate | None = None, arguments: dict | None = None, out: str = "prompt") -> DataFrame:
    """Adds the written conversation of an array of (role, content), in Arrow batches; without a template it is a column expression."""
    if template is None:
        return df.withColumn(out, F.concat(F.array_join(F.transform(messages, lambda m: F.concat(F.lit("["), F.upper(m["role"]), F.lit("]\n"), m["content"])), "\n\n"), F.when(F.size(messages) > 0, "\n\n").otherwise(""), F.lit("[ASSISTANT]\n")))
    schema = df.withColumn(out, F.lit("")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            plain = [[m if isinstance(m, dict) else m.asDict() for m in one] for one in b[messages]]
            yield b.assign(**{out: [conversation(m, template, arguments) for m in plain]})

    return df.mapInPandas(run, schema)


def constrained(scores: DataFrame, k: int) -> DataFrame:
    """Candidate-constrained decoding for models that score: the k best candidates of each sample, ties by candidate."""
    r = F.row_number().over(Window.partitionBy("sample_id").orderBy(F.col("score").desc(), "candidate"))
    best = scores.withColumn("rank", r).where(F.col("rank") <= k)
    return best.groupBy("sample_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "candidate"))), lambda x: x["candidate"]), " ").alias("prediction"))


#: Stands in the tree where a sequence ends.
ENDED = "end"


class Trie:
    """Token sequences of the allowed answers, for models that decode token by token."""

    def __init__(self, sequences: list[list[int]]):
        self.root: dict = {}
        self.size = len({tuple(s) for s in sequences if s})
        for s in filter(None, sequences):
            node = self.root
            for t in s:
                node = node.setdefault(t, {})
            node[ENDED] = {}

    def allowed(self, prefix: list[int]) -> list[int]:
        """The tokens that may follow; none at an end or off the tree."""
        node = self.root
        for t in prefix:
            if t not in node:
                return []
            node = node[t]
        return sorted(t for t in node if t != ENDED)


    def beams(self, scores, k: int, end: int | None = None) -> list[list[int]]:
        """The k best sequences of the tree by beam search; scores(prefix) gives the log-probabilities of next tokens.

        The width is five times k, at least 50, at most the number of sequences; equal sums go to the smaller sequence. A sequence
        that others go on from may end where it is, at the cost of the end token, if there is one.
        """
        width = min(self.size, max(5 * k, 50))
        live, done = [(0.0, [], self.root)], []
        while live:
            grown = []
            for total, prefix, node in live:
                s = scores(prefix)
                if ENDED in node:
                    done.append((total + (s.get(end, float("-inf")) if end is not None and len(node) > 1 else 0.0), prefix))
                grown += [(total + s.get(t, float("-inf")), [*prefix, t], n) for t, n in node.items() if t != ENDED]
            live = sorted(grown, key=lambda x: (-x[0], x[1]))[:width]
        return [p for _, p in sorted(done, key=lambda x: (-x[0], x[1]))[:k]]


class Layers:
    """A multilayer perceptron with given weights: linear, then between layers normalisation by given statistics, and an activation.

    Training is another program's; at inference dropout is nothing. layers: (weight of out x in, bias); norms: (scale, shift, mean,
    variance) after every layer but the last, or None.
    """

    ACTIVATIONS = {"none": lambda x: x, "relu": lambda x: np.maximum(x, 0), "sigmoid": lambda x: 1 / (1 + np.exp(-x)), "tanh": np.tanh, "leakyrelu": lambda x: np.where(x > 0, x, 0.01 * x)}

    def __init__(self, layers: list[tuple[np.ndarray, np.ndarray]], norms: list[tuple] | None = None, activation: str = "relu"):
        if activation.lower() not in self.ACTIVATIONS:
            raise ValueError(f"no activation {activation}")
        self.layers, self.norms, self.activation = layers, norms, activation.lower()

    def __call__(self, x: np.ndarray) -> np.ndarray:
        for i, (w, b) in enumerate(self.layers):
            x = x @ w.T + b
            if i < len(self.layers) - 1:
                if self.norms:
                    scale, shift, mean, variance = self.norms[i]
                    x = (x - mean) / np.sqrt(variance + 1e-5) * scale + shift
                x = self.ACTIVATIONS[self.activation](x)
        return x


def passed(df: DataFrame, layers: Layers, vec: str = "vec", out: str = "vec") -> DataFrame:
    """Vectors through the layers, in Arrow batches; the weights go to each task."""
    schema = df.withColumn(out, F.array().cast("array<double>")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{out: list(layers(np.array(b[vec].tolist(), dtype=np.float64))) if len(b) else []})

    return df.mapInPandas(run, schema)


def autoencoded(df: DataFrame, encoder: Layers, books: list[np.ndarray], decoder: Layers, vec: str = "vec") -> DataFrame:
    """Adds indices and decoded: the codes of the encoded vectors, and what the decoder makes of their reconstruction."""
    from ..operators.quantise import assign

    coded = assign(passed(df, encoder, vec, "_encoded"), books, "_encoded")
    return passed(coded, decoder, "reconstruction", "decoded").drop("_encoded", "reconstruction")


def autoencoder_loss(df: DataFrame, encoder: Layers, books: list[np.ndarray], decoder: Layers, vec: str = "vec", kind: str = "mse", weight: float = 0.25, beta: float = 0.25) -> DataFrame:
    """(loss, reconstruction_loss, quantisation_loss): squared or absolute errors of the decoded vectors, and the codes' own by weight."""
    from ..operators.quantise import quantisation_loss

    if kind not in ("mse", "l1"):
        raise ValueError(f"no loss {kind}")
    d = autoencoded(df, encoder, books, decoder, vec)
    off = F.zip_with(vec, "decoded", (lambda a, b: (a - b) * (a - b)) if kind == "mse" else (lambda a, b: F.abs(a - b)))
    own = d.agg((F.sum(F.aggregate(off, F.lit(0.0), lambda s, x: s + x)) / F.sum(F.size(vec))).alias("reconstruction_loss"))
    q = quantisation_loss(passed(df, encoder, vec, "_encoded"), books, "_encoded", beta).select(F.col("loss").alias("quantisation_loss"))
    return own.crossJoin(q).select((F.col("reconstruction_loss") + weight * F.col("quantisation_loss")).alias("loss"), "reconstruction_loss", "quantisation_loss")  # one row each
