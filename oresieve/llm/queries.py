"""Queries p1_ to p9_ over the test tables, with production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oresieve.llm import docpairs, handwritten, mixing, pairs, secrets, spam, tokenizing, truncation, unparsable
from oresieve.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return unparsable.unparsable(unparsable.parse_files(table(spark, sf, "source_files")))


def p1_rates(spark: SparkSession, sf: str) -> DataFrame:
    return unparsable.rates(unparsable.parse_files(table(spark, sf, "source_files")))


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokenizing.encoded(table(spark, sf, "documents"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.found_secrets(table(spark, sf, "components"))


def p4_redacted(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.redacted(table(spark, sf, "components"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    found = docpairs.paired(table(spark, sf, "components"), table(spark, sf, "doc_compare"), with_code=False)
    return found.select("id", "func_name").distinct()


def p6_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return docpairs.pairs(table(spark, sf, "components"), table(spark, sf, "doc_compare"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return spam.stuffed(table(spark, sf, "documents"))


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    return spam.stuffed_share(table(spark, sf, "documents"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return handwritten.not_handwritten(table(spark, sf, "source_files"))


def p2_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return handwritten.classified(table(spark, sf, "source_files"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.truncated(table(spark, sf, "doc_compare"))


def p3_rates(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.rates(table(spark, sf, "doc_compare"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.defective(table(spark, sf, "doc_compare"))


def p5_counts(spark: SparkSession, sf: str) -> DataFrame:
    found = pairs.judged(table(spark, sf, "doc_compare"))
    return found.groupBy(F.coalesce("defect_type", F.lit("none")).alias("defect_type")).agg(F.count("*").alias("pairs"))


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mixed(table(spark, sf, "documents"), table(spark, sf, "source_targets"))


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    targets = table(spark, sf, "source_targets")
    return mixing.shares(mixing.mixed(table(spark, sf, "documents"), targets), targets)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_rates, p2_found, p2_reasons, p3_found, p3_rates, p4_found, p4_redacted, p5_found, p5_counts, p6_found, p6_pairs, p7_ids, p8_mix, p8_shares, p9_found, p9_shares)}


def oracle_sql() -> dict[str, str]:
    return {}
