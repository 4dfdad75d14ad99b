"""Comparison of an extractor with a reference: precision, recall, F1, accuracy and coverage of fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oresieve.functions.code import populated
from oresieve.operators.joins import band_pairs


def ratios(matched, found, wanted) -> dict:
    """precision, recall and F1 with 0 where there is nothing to divide by."""
    p = F.when(found == 0, 0.0).otherwise(matched / found)
    r = F.when(wanted == 0, 0.0).otherwise(matched / wanted)
    return {"precision": p, "recall": r, "f1": F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))}


def file_metrics(gold: DataFrame, found: DataFrame, file: str = "file_path", name: str = "name", line: str = "line", band: int = 1) -> DataFrame:
    """Per file: counts, precision, recall, F1, and the names missing and extra; pairs are of one name and within the band of lines."""
    pairs = band_pairs(gold.filter(F.col(name).isNotNull()), found.filter(F.col(name).isNotNull()), [file, name], line, band)
    m = pairs.groupBy(file).agg(F.count("*").alias("matched"))
    g, f = gold.groupBy(file).agg(F.count("*").alias("gold")), found.groupBy(file).agg(F.count("*").alias("found"))
    hit_g, hit_f = pairs.select(file, name, F.col("gold_line").alias(line)), pairs.select(file, name, F.col("found_line").alias(line))
    missing = gold.select(file, name, F.col(line).cast("long").alias(line)).join(hit_g, [file, name, line], "left_anti").groupBy(file).agg(F.array_sort(F.collect_list(name)).alias("missing"))
    extra = found.select(file, name, F.col(line).cast("long").alias(line)).join(hit_f, [file, name, line], "left_anti").groupBy(file).agg(F.array_sort(F.collect_list(name)).alias("extra"))
    joined = g.join(f, file, "full_outer").join(m, file, "left").join(missing, file, "left").join(extra, file, "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gold", "found", "matched")]
    rows = joined.select(file, *counts, F.coalesce("missing", F.array().cast("array<string>")).alias("missing"), F.coalesce("extra", F.array().cast("array<string>")).alias("extra"))
    return rows.withColumns({k: F.round(v, 4) for k, v in ratios(F.col("matched"), F.col("found"), F.col("gold")).items()})


def by_language(files: DataFrame, key: str = "language") -> DataFrame:
    """Macro averages and the number of files of each language."""
    return files.groupBy(key).agg(F.count("*").alias("files"), *[F.round(F.avg(c), 4).alias(c) for c in ("precision", "recall", "f1")])


def overall_f1(per_language: DataFrame) -> DataFrame:
    return per_language.agg(F.round(F.sum(F.col("f1") * F.col("files")) / F.sum("files"), 4).alias("overall_f1"))


def field_accuracy(matched: DataFrame, fields: list[str]) -> DataFrame:
    """(field, accuracy) in per cent over pairs that hold gold_<field> and found_<field>."""
    cols = [F.avg(F.col(f"gold_{f}").eqNullSafe(F.col(f"found_{f}")).cast("int")).alias(f) for f in fields]
    one = matched.agg(*cols)
    return one.unpivot([], fields, "field", "accuracy").withColumn("accuracy", F.round(F.col("accuracy") * 100, 1))


def field_coverage(rows: DataFrame, kind: str, fields: list[str]) -> DataFrame:
    """(kind, field, n, populated, percent) of every field in every kind of row."""
    types = dict(rows.dtypes)
    sums = [F.sum(populated(f, types[f]).cast("long")).alias(f) for f in fields]
    by = rows.groupBy(kind).agg(F.count("*").alias("n"), *sums)
    return by.unpivot([kind, "n"], fields, "field", "populated").withColumn("percent", F.round(F.col("populated") / F.col("n") * 100, 1))


def name_overlap(gold: DataFrame, found: DataFrame, key: str, name: str = "name") -> DataFrame:
    """Precision, recall and F1 of name sets by key."""
    a = gold.select(key, name).distinct().withColumn("g", F.lit(1))
    b = found.select(key, name).distinct().withColumn("f", F.lit(1))
    by = a.join(b, [key, name], "full_outer").groupBy(key).agg(F.count("g").alias("gold"), F.count("f").alias("found"), F.count_if(F.col("g").isNotNull() & F.col("f").isNotNull()).alias("matched"))
    return by.withColumns({k: F.round(v, 4) for k, v in ratios(F.col("matched"), F.col("found"), F.col("gold")).items()})
