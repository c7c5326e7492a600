"""The corpus pipeline: quality classifier, near-duplicates, private data, mixing, token ids; each stage over all the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import bpe, minhash, mixing, pii, quality
from waymark.llm.common import discard, fresh, materialise, packed, small_batches, table, unpacked


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the cut go.

    Null and empty texts are judged like others, by figures of nothing; repeated rows go or stay together; very long texts are read
    whole; an empty table stays one; extra columns stay, whatever their names. Without labels of both kinds every document stays.
    """
    small_batches(spark)
    score = fresh(docs.columns, "score")
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, out=score).where(F.col(score) >= quality.CUT).select(*[F.col(f"`{c}`") for c in docs.columns])


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five words, 0.8) stays, that of the least doc_id; repeats of a doc_id with its text go too.

    Rows that share a doc_id but have different texts are different documents, in the order of their texts' digests; rows without a
    doc_id come after all others. Of rows equal in doc_id and text the one with the least digest of all its columns stays. Null, empty
    and blank texts are linked with nothing; an empty table stays one; extra columns stay, whatever their names.
    """
    small_batches(spark)
    names = docs.columns
    d = packed(docs, key=F.col("`doc_id`").cast("bigint"), text=F.col("`text`"))
    repeated = d.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    nameless = d.where("key is null").limit(1).count()
    if repeated or nameless:  # doc_ids don't name documents, so numbers in the order of (doc_id, text) do; else this carries no texts
        one = d.groupBy("key", F.md5("text").alias("digest")).agg(F.min_by("row", F.md5(F.to_json("row"))).alias("row"), F.first("text").alias("text"))
        ordered = one.orderBy(F.col("key").asc_nulls_last(), F.col("digest").asc_nulls_first())
        d = materialise(ordered.select("row", "text", F.monotonically_increasing_id().alias("key")))
    found = minhash.near_duplicates(d, "key")
    gone = found.where("id <> component").select(F.col("id").alias("gone")).distinct()
    return unpacked(d.join(gone, F.col("key") == F.col("gone"), "left_anti"), names)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Private data is replaced by surrogates; n_chars follows the text.

    Null and empty texts stay as they are; equal texts become equal; repeated rows, very long texts and extra columns of any name stay.
    """
    small_batches(spark)
    out = pii.surrogates(docs, report=False)
    chars = F.when(F.col("`text`").isNotNull(), F.length("`text`").cast("bigint")).otherwise(F.col("`n_chars`")).alias("n_chars") if "n_chars" in docs.columns else None
    return out.select(*[chars if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the target weights of its source ask.

    A null source is one of its own; null and empty texts weigh nothing and are drawn like others; rows without a doc_id or with a
    repeated one are drawn in the order of their texts; an empty table stays one; extra columns stay, whatever their names.
    """
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the token ids' count and digests, a row for each copy; null and empty texts have no tokens; other columns are left out."""
    small_batches(spark)
    return bpe.digests(docs.select("doc_id", "text"))


STAGES = [("quality", classify), ("near_duplicates", deduplicate), ("private_data", private), ("mixing", mix), ("token_ids", encode)]

#: The classifier, the surrogates and the token ids can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            out = materialise(out)
            discard(docs)  # nothing reads a stage's rows once those of the next are written
        docs = out
    return docs
