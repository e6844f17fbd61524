"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, html_extract, pii, quality_classifier, quality_rules, secrets, sentencepiece_codec, simhash, url_filter, warc
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def public_model() -> bytes:
    """The model that the query's contract names; operators take any model's bytes."""
    import public_tokenizers

    return sentencepiece_codec.model_bytes(public_tokenizers.path("piece_bpe_32k.model"))


def queries() -> dict[str, Query]:
    return {
        "op1_simhash": lambda spark, d: simhash.op1_simhash(table(spark, d, "documents")),
        "op2_quality_classifier": lambda spark, d: quality_classifier.op2_quality_classifier(table(spark, d, "documents"), table(spark, d, "labels")),
        "op3_secret_scan": lambda spark, d: secrets.op3_secret_scan(table(spark, d, "documents")),
        "op4_url_filter": lambda spark, d: url_filter.op4_url_filter(table(spark, d, "pages")),
        "op5_warc": lambda spark, d: warc.op5_warc(table(spark, d, "pages")),
        "op6_decontamination": lambda spark, d: decontaminate.op6_decontamination(table(spark, d, "documents"), table(spark, d, "benchmark")),
        "op7_sentencepiece": lambda spark, d: sentencepiece_codec.op7_sentencepiece(table(spark, d, "documents"), public_model()),
        "op8_pii": lambda spark, d: pii.op8_pii(table(spark, d, "documents")),
        "op9_html_extraction": lambda spark, d: html_extract.op9_html_extraction(table(spark, d, "pages")),
        "op10_quality_rules": lambda spark, d: quality_rules.op10_quality_rules(table(spark, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    from . import oracles

    return {k: v for k, v in oracles.SQL.items() if k in queries()}
