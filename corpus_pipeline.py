"""The corpus pipeline: quality rules, near-duplicates, decontamination, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoloom.llm import decontaminate, pii, quality_rules, sentencepiece_codec, simhash
from cytoloom.llm.common import new_path, remove, table
from cytoloom.llm.entry import public_model

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.judge(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays: near by fingerprint, or with a
    similarity of 0.8 or more over 5-word shingles."""
    return simhash.one_of_each(docs.select(*COLUMNS), similar=True)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms; n_chars counts the new text."""
    changed = pii.pseudonymise(docs.select(*COLUMNS), pii.session_key(spark)).withColumn("n_chars", F.char_length("text").cast("long"))
    return changed.select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document, and whether decoding them gives the text."""
    coded = sentencepiece_codec.encode(docs.select(*COLUMNS), public_model())
    return coded.select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids", F.coalesce(F.col("decoded") == F.coalesce("text", F.lit("")), F.lit(False)).alias("round_trip"))


STAGES = [("quality rules", quality), ("SimHash near-dedup", near_dedup), ("benchmark decontamination", decontamination), ("PII", personal_data), ("SentencePiece", tokens)]

#: SQL can express neither the fingerprints nor the pseudonyms nor the ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each stored in the shared folder before the next. A stage's input goes when its
    output is whole; ``common.clear`` deletes what is left when the result has been written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = new_path(spark, f"stage-{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                remove(spark, before)
            before = path
    return docs
