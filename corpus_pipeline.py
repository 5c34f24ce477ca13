"""From raw documents to a training mix: language ID, near-duplicates, decontamination, secrets, mixing.

Each stage takes what the one before kept; all but the last return the columns of ``documents``, extra ones included and
whatever their names; the last adds its own and renames those that clash. A rerun over the same tables gives the same
rows. Null columns, empty texts, repeated rows and empty tables pass through every stage; see the operators for what each
makes of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import materialize
from tidewell.llm.decontaminate import decontaminate
from tidewell.llm.language import UNKNOWN, identify, train_on
from tidewell.llm.mixing import curriculum_mix, training_order
from tidewell.llm.secrets import redact_documents
from tidewell.llm.simhash import keep_one_of_each


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts in no language (null, or without a letter); documents that lack a language get the predicted one."""
    labelled = identify(docs, train_on(docs), keep_all=True).where(F.col("lang_pred") != UNKNOWN)
    lang = F.coalesce("document.lang", "lang_pred").alias("lang")
    return labelled.select(*[lang if c == "lang" else F.col(f"document.`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity of at least 0.8."""
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep_all=True)
    return found.where("not contaminated").select("document.*")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; reported spans are replaced in the text, and n_chars follows."""
    return redact_documents(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training sequence: a row for each time that the mix takes a document, sorted by training position."""
    return training_order(curriculum_mix(docs))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("mixing", mixing),
]
#: Language models and fingerprints have no SQL form: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
