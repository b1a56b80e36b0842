"""Corpus preparation over `documents`: each stage works on what the one before it kept.

A stage takes (spark, docs, sf_dir); its result is written as Parquet and read
again as the next one's docs. All but the last return the columns of `docs`.

Columns other than doc_id and text are passed on, whatever their names; n_chars is kept
right where it is there, lang and source are in the result where they are. Null and empty texts
have no words: the classifier judges them by its prior, they are near-duplicates of
nothing, hold no window and no secret, and have no tokens. Rows that are repeated as a whole
are near-duplicates of each other: one stays; so does one of several rows of one text without an id. Texts of any length are
read whole. A table without rows gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugeworks.llm import bpe, decontaminate, neardup, quality, secrets
from gaugeworks.llm.common import materialize, table


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the whole row as one column: no name in it can clash with what an operator adds."""
    return docs.select("doc_id", "text", F.struct(*docs.columns).alias("__doc"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line CRF calls bad rather than good go; the threshold is even, so that clean documents stay."""
    scored = quality.quality(packed(docs), table(spark, sf_dir, "labels"), keep=["__doc"], threshold=0.5)
    return scored.where("predicted = 1").select("__doc.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id."""
    return neardup.without_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    judged = decontaminate.contamination(packed(docs), table(spark, sf_dir, "benchmark"), keep=["__doc"])
    return judged.where("NOT contaminated").select("__doc.*")


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts give way to a marker; n_chars follows."""
    out = secrets.redacted(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of the decoded bytes."""
    return bpe.encode_documents(docs, keep=[c for c in ("lang", "source") if c in docs.columns])


STAGES = [
    ("quality classifier", quality_stage),
    ("minhash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scan", secret_stage),
    ("byte-level bpe", token_stage),
]
#: The classifier, the randomness tests and BPE have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
