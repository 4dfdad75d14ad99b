"""Test tables as the operators expect them: rows delivered again count once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def components(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "components").dropDuplicates(["id"])


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "dag_nodes").dropDuplicates(["id"])


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """(src, dst) of the dependency graph."""
    return nodes(spark, sf).select(F.col("id").alias("src"), F.explode("depends_on").alias("dst"))


def files(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "source_files").dropDuplicates(["file_id"])


def validation(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "validation").dropDuplicates(["validation_id"])


def replies(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "doc_compare").dropDuplicates(["record_id"])


def log_lines(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, line_no, value) of the documents that hold logs."""
    docs = table(spark, sf, "documents").filter("source = 'logs' AND text IS NOT NULL")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "value"))


# The same in SQL.
COMPONENTS = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id) AS rn FROM components) WHERE rn = 1)"
NODES = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id) AS rn FROM dag_nodes) WHERE rn = 1)"
EDGES = f"(SELECT id AS src, unnest(depends_on) AS dst FROM {NODES})"
FILES = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id) AS rn FROM source_files) WHERE rn = 1)"
VALIDATION = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY validation_id) AS rn FROM validation) WHERE rn = 1)"
REPLIES = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY record_id) AS rn FROM doc_compare) WHERE rn = 1)"
LOGS = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS value FROM documents WHERE source = 'logs' AND text IS NOT NULL)"
