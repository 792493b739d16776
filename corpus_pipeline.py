"""The corpus pipeline: stages that clean a table of documents and pack what is left.

Every stage works on all that the one before it kept.  The first four return the columns of the
documents; the last one returns the packed pieces.

Edge cases, by stage: null, empty and letterless texts go with language ID, as texts that no language
explains; of rows that share or nearly share a fingerprint (copies, repeated rows, texts too short to
differ) the smallest id stays in near-dedup, null ids last; texts of fewer than five words hold no
benchmark item; secrets of a text are masked in place; a text longer than the largest sequence is
packed in pieces. Texts are whole throughout. Other columns are handed on as they are, whatever their
names. An empty table leaves every stage empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalmill.llm import decontam, langid, packing, secrets, simhash
from evalmill.llm.common import documents, stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, or unlike every learned language, go; the others get their language."""
    model = langid.train(docs.select("doc_id", "text", "lang"))
    known = langid.identify(docs, model).where(~F.col("rejected"))
    return known.select(*[F.col("lang_pred").alias(c) if c == "lang" else F.col(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near-duplicates stays: fingerprints of three-word
    shingles that differ in two bits at most are linked, by the SimHash operator."""
    return simhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked and the length follows; every document stays."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in bins of the permitted lengths."""
    return packing.op5_best_fit_packing(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: No SQL: languages are learned and bins are packed; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage keeps is written and read again by the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
