"""From raw documents to token ids: rules, near copies, secrets, mixture, encoding.

Each stage is one operator of evenkeel.llm over all that its predecessor kept; its result is
written to the shared folder as Parquet and read again by the next one, so a lost executor costs
at most a part of one stage. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from evenkeel.llm import bpe, mixing, quality_rules, secrets, simhash
from evenkeel.session import stored


def drop_outliers(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest id."""
    return simhash.one_of_each(docs, written=True)  # every stage reads what was written


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by its kind; n_chars follows the text."""
    out = secrets.redact_secrets(docs)
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.coalesce(length, "n_chars"))
    return out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of sources in a shuffled order; a document is in it once per copy."""
    return mixing.mixed(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers), n_tokens, and the digests of the ids
    and of the text that they decode to."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.encode(docs, path, decoded=True).select(
        "doc_id",
        "ids",
        F.floor(F.length("ids") / 4).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality rules", drop_outliers),
    ("SimHash near-dedup", drop_near_copies),
    ("secret scans", redact),
    ("mixing sources to target weights", mix),
    ("BPE encoding and decoding", encode),
]

# Fingerprints, redaction and token ids are beyond SQL; tests/llm/test_pipeline.py has the
# brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stored(spark, stage(spark, docs, sf_dir), f"stage{number}")
    return docs
