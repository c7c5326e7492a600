"""Fill-in-middle: texts are cut in three at token bounds and put together again with marks, so that models learn to fill gaps.

Tokens are the isolated matches of a pattern, found by the tokenizers library's Split pre-tokenizer, which needs no training and gives
code-point offsets. The length of the offset array is n; two cuts between 0 and n are ranked, and the offsets at them slice the text. The
draws come from a digest of the document's id, so that reruns, other partitionings and lost executors give the same forms.

Forms: plain, the text; psm, `<P>`prefix`<S>`suffix`<M>`middle; spm, `<S>`suffix`<P>`prefix`<M>`middle. As a text that holds a mark stays
plain, and no mark can begin inside another or across a cut, the first mark of each kind is the one put in; so the text can be rebuilt.

Edge cases: null and empty texts are plain, with n 0; a very long text is one row, cut like others; rows without a doc_id draw
from the empty text, rows with equal ones draw alike; repeated rows stay; extra columns stay, but those named like an added one are
replaced; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import packed, small_batches, table, unpacked

PATTERN = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
SEED = "42:"
#: Of a hundred texts so many are cut, and of a hundred cut ones so many have the suffix first.
CUT, SUFFIX_FIRST = 50, 80
OUT = {"n": "bigint", "form": "string", "prefix_chars": "bigint", "middle_chars": "bigint", "output": "string"}


def draws(key: Column, seed: str = SEED, many: int = 4) -> list[Column]:
    """The first eight-digit groups of sha256(seed, key) as unsigned numbers."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(many)]


def splitter(pattern: str = PATTERN):
    """Text to the bounds of its tokens: 0, then the end of each."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    split = Split(Regex(pattern), behavior="isolated")
    return lambda text: [0, *(end for _, (_, end) in split.pre_tokenize_str(text))] if text else [0]


def arranged(text: str, bounds: list[int], h: tuple[int, int, int, int], cut: int = CUT, suffix_first: int = SUFFIX_FIRST) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of a text."""
    n = len(bounds) - 1
    if not text or h[2] % 100 >= cut or any(m in text for m in MARKS):
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m = bounds[a], bounds[b]
    prefix, middle, suffix = text[:p], text[p:m], text[m:]
    if h[3] % 100 < suffix_first:
        return n, "spm", p, m - p, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", p, m - p, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restored(output: str, form: str) -> str:
    """The text that a form was made of, from the output alone."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    if not output.startswith(first):
        raise ValueError(f"{form} output without {first}")
    one, rest = output[len(first) :].split(second, 1)
    two, middle = rest.split(MIDDLE, 1)
    prefix, suffix = (two, one) if form == "spm" else (one, two)
    return prefix + middle + suffix


def _rows(batch: pa.RecordBatch, bounds, cut: int, suffix_first: int) -> Iterator[tuple]:
    columns = [batch.column(c).to_pylist() for c in ("text", "h1", "h2", "h3", "h4")]
    for text, *h in zip(*columns, strict=True):
        yield arranged(text or "", bounds(text or ""), tuple(h), cut, suffix_first)


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: str = SEED, cut: int = CUT, suffix_first: int = SUFFIX_FIRST, pattern: str = PATTERN) -> DataFrame:
    """Adds n, form, prefix_chars, middle_chars and output; columns of these names are replaced."""
    small_batches(docs.sparkSession)
    kinds = {"n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.large_string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = splitter(pattern)
        for batch in batches:
            made = list(zip(*_rows(batch, bounds, cut, suffix_first), strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column("row"), *[pa.array(c, t) for c, t in zip(made, kinds.values(), strict=True)]], ["row", *kinds])

    h = dict(zip(("h1", "h2", "h3", "h4"), draws(F.col(f"`{doc_id}`"), seed), strict=True))
    names = [c for c in docs.columns if c not in OUT]
    d = packed(docs.select(*[F.col(f"`{c}`") for c in names]), text=F.col(f"`{text}`"), **h) if text in names else packed(docs, text=F.col(f"`{text}`"), **h)
    out = d.mapInArrow(run, d.select("row", *[F.lit(None).cast(t).alias(c) for c, t in OUT.items()]).schema)
    return unpacked(out, names, **{c: F.col(c) for c in OUT})


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the figures of its form, and digests of the output and of the text rebuilt from it; texts stay in the task."""
    small_batches(docs.sparkSession)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    kinds = {"n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output_sha256": pa.string(), "restored_sha256": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = splitter()
        for batch in batches:
            rows = [(*r[:4], sha(r[4]), sha(restored(r[4], r[1]))) for r in _rows(batch, bounds, CUT, SUFFIX_FIRST)]
            made = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(made, kinds.values(), strict=True)]], ["doc_id", *kinds])

    h = dict(zip(("h1", "h2", "h3", "h4"), draws(F.col(f"`{doc_id}`")), strict=True))
    d = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), *[c.alias(k) for k, c in h.items()])
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(run, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string")


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (SELECT doc_id, text, regexp_extract_all(text, '{PATTERN}') AS tokens, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT doc_id, text, tokens, len(tokens)::BIGINT AS n, least(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS a, greatest(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= {CUT} THEN 'plain' WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT doc_id, text, n, form, array_to_string(tokens[1:a], '') AS prefix, array_to_string(tokens[a+1:b], '') AS middle, array_to_string(tokens[b+1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle ELSE '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle END) AS output_sha256,
    sha256(text) AS restored_sha256 FROM p
"""
