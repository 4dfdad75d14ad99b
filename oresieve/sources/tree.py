"""Sources and sinks: source trees, component and graph exports, documentation of writers and systems, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oresieve.functions.code import suffix_language
from oresieve.schema import COMPONENTS

# Parts of paths that a scan leaves out.
EXCLUDED = ("__pycache__", ".git", "node_modules", "venv", ".venv", "env", "build", "dist", ".egg-info", ".tox")


def source_tree(spark: SparkSession, path: str, excluded: tuple[str, ...] = EXCLUDED, glob: str | None = None) -> DataFrame:
    """(path, value, scan_ord) of the files below a folder; invalid bytes become replacement characters.

    A path that holds one of the excluded parts below the folder is left out.
    """
    reader = spark.read.option("recursiveFileLookup", True).option("wholetext", True)
    rows = (reader.option("pathGlobFilter", glob) if glob else reader).text(path)
    root = "file:" + path.rstrip("/") if path.startswith("/") else path.rstrip("/")
    full = F.col("_metadata.file_path")
    inner = F.regexp_replace(F.regexp_replace(full, "^file:/+", "file:/"), "^" + root.replace(".", r"\."), "")
    files = rows.select(F.regexp_replace(inner, "^/", "").alias("path"), "value")
    for part in excluded:
        files = files.filter(~F.contains(F.concat(F.lit("/"), F.col("path")), F.lit("/" + part + "/" if not part.startswith(".egg") else part)))
    return files.withColumn("scan_ord", F.xxhash64("path"))


def by_language(files: DataFrame) -> DataFrame:
    """Files of the languages that an extractor knows, with their language; blank ones are left out."""
    return files.withColumn("language", suffix_language("path")).filter("language IS NOT NULL AND trim(value) <> ''")


def files_and_lines(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("files"), F.sum(F.size(F.split("value", "\n"))).alias("lines"))


def last_of_each(rows: DataFrame, key: str = "id", order: str = "scan_ord") -> DataFrame:
    """The last row of each key in scan order."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter("__r = 1").drop("__r")


def export_components(components: DataFrame, path: str) -> None:
    components.write.mode("overwrite").partitionBy("repo").json(path) if "repo" in components.columns else components.write.mode("overwrite").json(path)


def export_adjacency(edges: DataFrame, path: str) -> None:
    edges.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("dst")).write.mode("overwrite").json(path)


def read_components(spark: SparkSession, path: str) -> DataFrame:
    """Exported components, one JSON object a line, by the component schema."""
    return spark.read.schema(COMPONENTS).json(path)


def read_component_shapes(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, type, file_path) from documents of any accepted shape: {"nodes": []}, {"components": []}, a list, or a map from id to row."""
    text = spark.read.option("wholetext", True).text(path).select("value")
    row = "struct<id:string,name:string,type:string,file_path:string,location:struct<file_path:string>>"
    nodes = F.from_json("value", f"struct<nodes:array<{row}>>")["nodes"]
    parts = F.from_json("value", f"struct<components:array<{row}>>")["components"]
    plain = F.from_json("value", f"array<{row}>")
    entries = F.transform(F.map_entries(F.from_json("value", f"map<string,{row}>")), lambda e: e["value"].withField("id", F.coalesce(e["value"]["id"], e["key"])))
    entries = F.filter(entries, lambda e: e["name"].isNotNull())
    chosen = F.when(nodes.isNotNull(), nodes).when(parts.isNotNull(), parts).when(F.trim("value").startswith("["), plain).otherwise(entries)
    return text.select(F.explode(chosen).alias("c")).select("c.id", "c.name", "c.type", F.coalesce("c.file_path", "c.location.file_path").alias("file_path"))


def read_systems(spark: SparkSession, path: str) -> DataFrame:
    """(system, component_id, docstring) from JSON lines whose fields go by alternative names."""
    schema = "system string, system_name string, component_id string, id string, docstring string, documentation string, generated_docstring string"
    rows = spark.read.schema(schema).json(path)
    return rows.select(
        F.coalesce("system", "system_name", F.lit("default_system")).alias("system"), F.coalesce("component_id", "id").alias("component_id"), F.coalesce("docstring", "documentation", "generated_docstring").alias("docstring")
    ).filter("trim(docstring) <> ''")


def combined_systems(systems: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in systems.items():
        part = df.withColumn("system", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def with_writer_output(components: DataFrame, written: DataFrame) -> DataFrame:
    """components with existing_docstring replaced where a writer gave one, an empty one included."""
    w = written.select(F.col("component_id").alias("id"), F.col("docstring").alias("__d"), F.lit(True).alias("__w"))
    return components.join(w, "id", "left").withColumn("existing_docstring", F.when(F.col("__w"), F.col("__d")).otherwise(F.col("existing_docstring"))).drop("__d", "__w")


def log_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file_ord, line_no, value) of log files in a fixed order; line numbers rise inside a file."""
    out = None
    for i, p in enumerate(paths):
        part = spark.read.text(p).select(F.lit(i).alias("file_ord"), F.monotonically_increasing_id().alias("line_no"), "value")
        out = part if out is None else out.unionByName(part)
    return out


def samples_to_script(samples: DataFrame, path: str) -> None:
    """Code samples (code, comment) as annotated script text."""
    body = F.concat(F.lit("/**\n"), F.array_join(F.transform(F.split("comment", "\n"), lambda x: F.concat(F.lit(" * "), x)), "\n"), F.lit("\n */\n"), F.col("code"), F.lit("\n"))
    samples.select(body.alias("value")).write.mode("overwrite").text(path)


def load_samples(spark: SparkSession, path: str) -> DataFrame:
    """Code samples from JSON lines of either spelling of their fields."""
    schema = "repo string, path string, func_name string, function_name string, name string, language string, code string, original_string string, comment string, docstring string"
    rows = spark.read.schema(schema).json(path)
    return rows.select("repo", "path", F.coalesce("function_name", "func_name", "name").alias("func_name"), "language", F.coalesce("code", "original_string").alias("code"), F.coalesce("comment", "docstring").alias("comment"))


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def report(rows: DataFrame, path: str, title: str) -> None:
    """A result as JSON lines and as lines of Markdown."""
    rows.write.mode("overwrite").json(f"{path}/json")
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]), F.lit(" |"))
    head = rows.sparkSession.createDataFrame([(f"# {title}\n\n| " + " | ".join(rows.columns) + " |\n|" + "-|" * len(rows.columns),)], "value string")
    head.unionByName(rows.select(cells.alias("value"))).write.mode("overwrite").text(f"{path}/markdown")
