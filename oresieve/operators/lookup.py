"""Views, lookups and dependency resolution over component tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oresieve.functions.text import bound

# Kinds that a listing merges or leaves out.
LISTED_AS = {"arrow_function": "function", "constructor": "method"}
UNLISTED = ("field", "static_field", "global_variable", "variable", "api_endpoint", "import")
#: Terms of the score of an agent system: weights sum to 1.
AGENT_WEIGHTS = {"learning": 0.10, "errors": 0.15, "hallucination": 0.15, "misalignment": 0.10, "collaboration": 0.15, "latency": 0.05, "instruction": 0.15, "explainability": 0.10, "transparency": 0.05}


def listed(components: DataFrame, kind: str | None = None, file_path: str | None = None) -> DataFrame:
    """Components of a listing with merged kinds, and for methods the class that the id names."""
    merged = F.col("type")
    for a, b in LISTED_AS.items():
        merged = F.when(F.col("type") == a, b).otherwise(merged)
    rows = components.filter(~F.col("type").isin(*UNLISTED)).withColumn("type", merged)
    rows = rows if kind is None else rows.filter(F.col("type") == kind)
    rows = rows if file_path is None else rows.filter(F.col("file_path") == file_path)
    return rows.withColumn("parent_class", F.when(F.col("type") == "method", F.try_element_at(F.split("id", r"\."), F.lit(-2))))


def found_by_name(components: DataFrame, name: str, file_path: str | None = None) -> DataFrame:
    """The first function of a name, else the first class."""
    rows = components.filter((F.col("name") == name) & F.col("type").isin("function", "method", "class"))
    rows = rows if file_path is None else rows.filter(F.col("file_path") == file_path)
    return rows.orderBy(F.when(F.col("type") == "class", 1).otherwise(0), "id").limit(1)


def found_by_key(components: DataFrame, key: str) -> DataFrame:
    """The component of an id, else of a qualified name ending so."""
    return components.filter((F.col("id") == key) | F.endswith("id", F.lit("." + key))).orderBy(F.when(F.col("id") == key, 0).otherwise(1), "id").limit(1)


def searched(rows: DataFrame, column: str, query: str) -> DataFrame:
    return rows.filter(F.contains(F.lower(column), F.lit(query.lower())))


def aliases(components: DataFrame) -> DataFrame:
    """(low, kind, id): every lower-case name by which a component may be called: plain, Class.method, and dotted suffixes of modules."""
    parts = F.split("id", r"\.")
    suffixes = bound(parts, lambda p: F.transform(F.sequence(F.lit(1), F.size(p)), lambda k: F.array_join(F.slice(p, k, F.size(p)), ".")))
    names = F.when(F.col("type") == "module", suffixes).when(F.col("type").isin("method", "constructor"), F.array(F.col("name"), F.concat_ws(".", F.try_element_at(parts, F.lit(-2)), "name"))).otherwise(F.array("name", "id"))
    return components.select(F.explode(F.array_distinct(names)).alias("low"), F.col("type").alias("kind"), "id").withColumn("low", F.lower("low"))


def resolved_dependencies(components: DataFrame) -> DataFrame:
    """(src, dst, via): calls and parents of each component, resolved in its own file, else in the files it imports, else anywhere.

    In each tier the least id wins; Java resolves to classes only; self and own class are dropped. Every tier is an equality join.
    """
    base = components.filter("id IS NOT NULL").select("id", "name", "type", "language", "file_path", "calls", "parent_classes", "imports")
    said = base.select(F.col("id").alias("src"), "language", "file_path", F.explode(F.array_distinct(F.concat(F.coalesce("calls", F.array()), F.coalesce("parent_classes", F.array())))).alias("n"), "imports").withColumn("n", F.element_at(F.split("n", r"\."), -1))
    target = base.filter(F.col("type").isin("class", "function", "method", "constructor")).select(F.col("id").alias("dst"), F.col("name").alias("n"), F.col("file_path").alias("f"), F.col("language").alias("l"), F.col("type").alias("kind"))
    target = target.filter((F.col("l") != "java") | (F.col("kind") == "class"))
    own = said.join(target.groupBy(F.col("f").alias("file_path"), "n").agg(F.min("dst").alias("dst")), ["file_path", "n"]).select("src", "n", "dst", F.lit(0).alias("tier"))
    stem = F.regexp_replace(F.element_at(F.split("f", "/"), -1), r"\.\w+$", "")
    by_stem = target.groupBy(stem.alias("m"), "n").agg(F.min("dst").alias("dst"))
    imported = said.select("src", "n", F.explode("imports").alias("m")).withColumn("m", F.element_at(F.split("m", r"[./]"), -1)).join(by_stem, ["m", "n"]).groupBy("src", "n").agg(F.min("dst").alias("dst")).select("src", "n", "dst", F.lit(1).alias("tier"))
    any_ = said.join(target.groupBy(F.col("l").alias("language"), "n").agg(F.min("dst").alias("dst")), ["language", "n"]).select("src", "n", "dst", F.lit(2).alias("tier"))
    best = own.unionByName(imported).unionByName(any_).groupBy("src", "n").agg(F.min(F.struct("tier", "dst")).alias("b"))
    via = F.when(F.col("b.tier") == 0, "file").when(F.col("b.tier") == 1, "import").otherwise("name")
    edges = best.select("src", F.col("b.dst").alias("dst"), via.alias("via"))
    return edges.filter((F.col("src") != F.col("dst")) & ~F.startswith("src", F.concat("dst", F.lit("."))))


def statement_at(calls: DataFrame, statements: DataFrame) -> DataFrame:
    """calls (func_id, line) with the first statement of that line."""
    first = statements.groupBy("func_id", "line").agg(F.min("ord").alias("ord"))
    return calls.join(first, ["func_id", "line"], "left")


def sample_components(samples: DataFrame) -> DataFrame:
    """Component rows of code samples (repo, func_name, code): id from name and digest, parameters and signature by pattern."""
    code = F.col("code")
    head = F.regexp_extract(code, r"\(([^)]*)\)", 1)
    return samples.select(
        F.concat("func_name", F.lit("_"), F.substring(F.md5(code), 1, 8)).alias("id"), F.col("func_name").alias("name"),
        F.when(F.col("func_name") == "constructor", "constructor").when(code.rlike(r"\bclass\s"), "class").when(code.rlike(r"^\s*(?:async\s+)?function\b|=>"), "function").otherwise("method").alias("type"),
        F.filter(F.transform(F.split(head, ","), lambda p: F.trim(F.regexp_replace(p, r"[=:].*$", ""))), lambda p: p != "").alias("parameters"),
        F.trim(F.regexp_extract(code, r"^([^{]*?)\s*\{", 1)).alias("signature"), code.rlike(r"\basync\b").alias("is_async"), F.size(F.split(code, "\n")).alias("lines_of_code"), F.concat("repo", F.lit("/"), "func_name", F.lit(".js")).alias("file_path"),
    )


def agent_score(terms: dict[str, Column]) -> Column:
    """The weighted sum of the nine terms, each between 0 and 1."""
    return F.round(sum((F.coalesce(terms[k], F.lit(0.5)) * w for k, w in AGENT_WEIGHTS.items()), F.lit(0.0)), 3)


def ordered_nodes(nodes: DataFrame, how: str, seed: int = 0) -> DataFrame:
    """nodes with a place in a random order of nodes, or of files with their nodes in order, the same for one seed."""
    key = F.xxhash64(F.lit(seed), "id") if how == "node" else F.xxhash64(F.lit(seed), "file_path")
    return nodes.withColumn("place", key).orderBy("place", "id")


def tree_order(paths: DataFrame, path: str = "path") -> DataFrame:
    """(path, parent, name, is_file): every folder and file of a tree, folders before files in each parent, then by name."""
    parts = F.split(F.col(path), "/")
    each = bound(parts, lambda p: F.transform(F.sequence(F.lit(1), F.size(p)), lambda k: F.struct(F.array_join(F.slice(p, 1, k), "/").alias("path"), (k == F.size(p)).alias("is_file"))))
    rows = paths.select(F.explode(each).alias("e")).select("e.path", "e.is_file").distinct()
    named = rows.select("path", F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("parent"), F.element_at(F.split("path", "/"), -1).alias("name"), "is_file")
    return named.orderBy("parent", "is_file", F.lower("name"))


def severity_histogram(findings: DataFrame, severity: str, group: str) -> DataFrame:
    """(severity, group, n), the gravest first."""
    rank = F.when(F.col(severity) == "critical", 0).when(F.col(severity) == "high", 1).when(F.col(severity) == "medium", 2).when(F.col(severity) == "low", 3).otherwise(4)
    return findings.groupBy(severity, group).agg(F.count("*").alias("n")).orderBy(rank, F.desc("n"), group)


def newest(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter("__n = 1").drop("__n")
