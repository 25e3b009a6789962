"""The corpus pipeline: five stages over documents, each calling one training-data operator.

Every stage but the last returns the columns of documents and takes all that its predecessor kept. Repeated rows and
null ids pass through as rows of their own; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiquarry.llm import langid, mixing, packing, pii, simhash
from lexiquarry.llm.common import materialise, table

#: Documents whose language is less sure than this are rejected, as are those without a letter.
LEAST_SCORE = 0.5
COLUMNS = ("lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of no language or of an unsure one; fills in languages that are missing."""
    found = langid.predict(docs, langid.train(docs), keep=("text", *COLUMNS))
    kept = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.select("doc_id", "text", F.coalesce("lang", "lang_pred").alias("lang"), "source", "n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: five-word shingles, a similarity of about 0.8 or more."""
    return simhash.representatives(docs, keep=COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and the terms that give it away by their kinds."""
    found = pii.find(docs, keep=COLUMNS).withColumn("text", pii.redacted())
    return found.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source's words to its target: a row for each copy of a document, and one for drawn blocks of it."""
    found = mixing.mix(docs, keep=("text", "lang")).withColumn("text", F.explode(mixing.taken_text()))
    return found.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences."""
    return packing.pack(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mix", mix), ("pack", pack)]
#: Classifiers, XXH64 and tokenizers are beyond SQL: tests/llm holds the stages against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
