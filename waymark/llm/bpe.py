"""Byte-level BPE encoding and decoding by the tokenizers library, over Arrow batches.

A rank file becomes a tokenizers model: every split of a token into two tokens is a merge, in the order of the token's rank, and
a piece that is a token itself is taken whole. Bytes stand as characters by the usual byte table. Texts are split by the public
pattern; each distinct piece of a task goes through the library once and is kept in a bounded table, as most pieces come again.

Edge cases: null and empty texts have no tokens; a very long text is one list of ids; repeated rows get equal ids; an empty table
gives none; extra columns stay, but those named like an added one are replaced; lone surrogates can't occur in Arrow strings; a character whose bytes fall in
several tokens has the same offsets in each of them, and decoding only part of them gives U+FFFD in text, the bytes in bytes.
Ids without a token, null ids and null lists decode to nothing.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, small_batches, table

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Distinct pieces that a task keeps; beyond it the table begins anew, with equal results.
KEPT_PIECES = 400_000
#: Longer pieces are not kept: they seldom come again and would fill the table.
KEPT_LENGTH = 64


def byte_table() -> dict[int, str]:
    """The character that stands for each byte: printable Latin-1 ones for themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer, models

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        chars = byte_table()
        self.latin = str.maketrans({chr(b): c for b, c in chars.items()})
        name = lambda raw: raw.decode("latin-1").translate(self.latin)
        merges = []
        for token, _ in sorted(ranks.items(), key=lambda x: x[1]):
            splits = [(token[:i], token[i:]) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
            merges += [(name(a), name(b)) for a, b in sorted(splits, key=lambda s: (ranks[s[0]], ranks[s[1]]))]
        self.model = Tokenizer(models.BPE(vocab={name(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
        self.tokens = [b""] * (max(ranks.values()) + 1)
        back = {c: b for b, c in chars.items()}
        for t, r in self.model.get_vocab().items():
            self.tokens[r] = bytes(back[c] for c in t)
        self.split = regex.compile(pattern).findall
        self.kept: dict[str, bytes] = {}

    def pieces(self, pieces: set[str]) -> None:
        """Puts the ids of pieces, as little-endian 32-bit numbers, into the table."""
        new = [p for p in pieces if p not in self.kept]
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            coded = self.model.encode_batch_fast([p.encode().decode("latin-1").translate(self.latin) for p in part], add_special_tokens=False)
            for p, e in zip(part, coded, strict=True):
                self.kept[p] = np.array(e.ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers."""
        split = [self.split(t or "") for t in texts]
        need = set().union(*split) if split else set()
        if len(self.kept) > KEPT_PIECES:
            self.kept = {}
        self.pieces(need)
        out = [b"".join(map(self.kept.__getitem__, p)) for p in split]
        for p in need:
            if len(p) > KEPT_LENGTH:
                del self.kept[p]
        return out

    def decode(self, ids: bytes) -> bytes:
        tokens, n = self.tokens, len(self.tokens)
        return b"".join([tokens[i] for i in np.frombuffer(ids, dtype="<u4").tolist() if i < n])

    def offsets(self, text: str, ids: bytes) -> list[tuple[int, int]]:
        """(first, end) of the characters that each token has a byte of, in code points."""
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        at = np.cumsum((raw & 0xC0) != 0x80) - 1  # the character that each byte is part of
        out, pos = [], 0
        for i in np.frombuffer(ids, dtype="<u4").tolist():
            end = pos + len(self.tokens[i])
            out.append((int(at[pos]), int(at[end - 1]) + 1))
            pos = end
        return out


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def public_vocabulary() -> tuple[str, str]:
    """The path of the rank file and the pattern of the public vocabularies on this box."""
    import public_tokenizers

    return public_tokenizers.path(RANKS), public_tokenizers.PATTERN


def found(vocabulary: tuple[str, str] | None) -> Codec:
    """The codec of a vocabulary; the public one's path is looked up where the codec is used, in the task."""
    return codec(*(vocabulary or public_vocabulary()))


def _mapped(df: DataFrame, column: str, added: dict[str, str], run, drop: bool) -> DataFrame:
    """Adds columns that run(values) makes a batch of; `added`: their names and SQL types. Columns of these names are replaced."""
    keep = [c for c in df.columns if c not in added or c == column]
    narrow = df.select(*[F.col(f"`{c}`") for c in keep])
    rest = [c for c in keep if c not in added and not (drop and c == column)]
    schema = narrow.select(*[F.col(f"`{c}`") for c in rest], *[F.lit(None).cast(t).alias(c) for c, t in added.items()]).schema
    at, places = keep.index(column), [keep.index(c) for c in rest]

    def replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in places], *run(b.column(at))], [*rest, *added])

    return mapped(narrow, replaced, schema)


def encode(df: DataFrame, text: str = "text", ids: str = "ids", offsets: str = "offsets", vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """Adds the ids of each text, and for each id the first and end character it has bytes of."""
    def run(values: pa.Array) -> list[pa.Array]:
        c, texts = found(vocabulary), values.to_pylist()
        coded = c.encode(texts)
        where = [[{"first": a, "end": b} for a, b in c.offsets(t or "", i)] for t, i in zip(texts, coded, strict=True)]
        return [pa.array([np.frombuffer(i, "<u4").astype(np.int32) for i in coded], pa.list_(pa.int32())), pa.array(where, pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())])))]

    return _mapped(df, text, {ids: "array<int>", offsets: "array<struct<first:int,end:int>>"}, run, drop=False)


def decode(df: DataFrame, ids: str = "ids", raw: str = "decoded", text: str = "decoded_text", vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """Adds the bytes of each list of ids, and their text with U+FFFD where a character's bytes are not whole."""
    def run(values: pa.Array) -> list[pa.Array]:
        c = found(vocabulary)
        out = [c.decode(np.array([i for i in v or [] if i is not None and i >= 0], "<u4").tobytes()) for v in values.to_pylist()]
        return [pa.array(out, pa.binary()), pa.array([o.decode("utf-8", "replace") for o in out], pa.string())]

    return _mapped(df, ids, {raw: "binary", text: "string"}, run, drop=False)


def digests(df: DataFrame, text: str = "text", vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """Encodes and decodes each text and puts n_tokens, ids_sha256 and decoded_sha256 in its place, so no ids leave the task."""
    def run(values: pa.Array) -> list[pa.Array]:
        c = found(vocabulary)
        coded = c.encode(values.to_pylist())
        return [pa.array([len(i) // 4 for i in coded], pa.int64()), pa.array([hashlib.sha256(i).hexdigest() for i in coded], pa.string()), pa.array([hashlib.sha256(c.decode(i)).hexdigest() for i in coded], pa.string())]

    return _mapped(df, text, {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}, run, drop=True)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"))
