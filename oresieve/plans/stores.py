"""Documents that are written and read again, updates, data flow of globals, streams and state, as tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from oresieve.functions import code, docs
from oresieve.operators import joins
from oresieve.operators.lineage import fresh_folder
from oresieve.plans.tables import COMPONENTS, EDGES, FILES, NODES, REPLIES, VALIDATION, components, edges, files, nodes, replies, table, validation
from oresieve.sources import tree
from oresieve.streaming import progress


def stored_components(spark, sf):
    path = fresh_folder(spark, "components")
    tree.export_components(components(spark, sf).drop("repo"), path)
    return tree.read_components(spark, path).select("id", "name", "type", F.col("location.file_path").alias("file_path"), F.size("parameters").alias("parameters"))


SQL_STORED = f"SELECT id, name, type, location.file_path AS file_path, CAST(len(parameters) AS INT) AS parameters FROM {COMPONENTS}"


def stored_adjacency(spark, sf):
    path = fresh_folder(spark, "edges")
    tree.export_adjacency(edges(spark, sf), path)
    return spark.read.schema("src string, dst array<string>").json(path).select("src", F.explode("dst").alias("dst"))


SQL_ADJACENCY = f"SELECT DISTINCT src, dst FROM {EDGES} WHERE dst IS NOT NULL"


def stored_graph(spark, sf):
    path = fresh_folder(spark, "graph")
    tree.save_graph(nodes(spark, sf).select("id", "node_type"), edges(spark, sf), path)
    n, e = tree.load_graph(spark, path)
    return n.join(e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out")), "id", "left").groupBy("node_type").agg(F.count("*").alias("nodes"), F.coalesce(F.sum("out"), F.lit(0)).alias("edges"))


SQL_GRAPH = f"SELECT node_type, count(*) AS nodes, CAST(coalesce(sum(len(depends_on)), 0) AS BIGINT) AS edges FROM {NODES} GROUP BY 1"


def component_shapes(spark, sf):
    path = fresh_folder(spark, "shapes")
    row = F.struct("id", "name", "type", F.col("location.file_path").alias("file_path"))
    c = components(spark, sf).filter("type = 'class'").groupBy("repo").agg(F.collect_list(row).alias("c"))
    kind = F.pmod(F.length("repo"), F.lit(3))
    shape = F.when(kind == 0, F.to_json(F.struct(F.col("c").alias("nodes")))).when(kind == 1, F.to_json(F.struct(F.col("c").alias("components")))).otherwise(F.to_json("c"))
    # one document a file: as many files as repositories
    c.select("repo", shape.alias("value")).repartition("repo").write.partitionBy("repo").text(path)
    return tree.read_component_shapes(spark, f"{path}/repo=*").select("id", "name", "type", "file_path")


SQL_SHAPES = f"SELECT id, name, type, location.file_path AS file_path FROM {COMPONENTS} WHERE type = 'class'"


def writer_systems(spark, sf):
    path = fresh_folder(spark, "systems")
    r = replies(spark, sf)
    half = {w: r.filter(f"writer = '{w}'").select(F.col("component_id").alias("id"), F.col("generated_docstring").alias(name)) for w, name in (("writer_base", "docstring"), ("baseline_a", "documentation"))}
    tree.combined_systems(half).write.json(path)
    return tree.read_systems(spark, path).groupBy("system", "component_id").agg(F.count("*").alias("texts"))


SQL_SYSTEMS = f"SELECT writer AS system, component_id, count(*) AS texts FROM {REPLIES} WHERE writer IN ('writer_base', 'baseline_a') AND trim(generated_docstring, ' ') <> '' GROUP BY 1, 2"


def writer_output(spark, sf):
    written = replies(spark, sf).filter("component_id IS NOT NULL").groupBy("component_id").agg(F.max_by("generated_docstring", F.col("record_id")).alias("docstring"))
    return tree.with_writer_output(components(spark, sf), written).select("id", "existing_docstring")


SQL_WRITTEN = f"""WITH w AS (SELECT component_id, generated_docstring AS d FROM (SELECT *, row_number() OVER (PARTITION BY component_id ORDER BY record_id DESC) AS r FROM {REPLIES} WHERE component_id IS NOT NULL) WHERE r = 1)
SELECT c.id, CASE WHEN w.component_id IS NOT NULL THEN d ELSE existing_docstring END AS existing_docstring FROM {COMPONENTS} c LEFT JOIN w ON c.id = w.component_id"""


def stored_samples(spark, sf):
    path = fresh_folder(spark, "samples")
    c = components(spark, sf).filter("type = 'function' AND language = 'javascript'")
    c.select("repo", F.col("name").alias("func_name"), "language", F.col("source_code").alias("original_string"), F.coalesce("existing_docstring", F.lit("")).alias("docstring")).write.json(path)
    samples = tree.load_samples(spark, path)
    tree.samples_to_script(samples, f"{path}-script")
    lines = spark.read.text(f"{path}-script").agg(F.count("*").alias("lines"), F.count_if(F.trim("value") == "/**").alias("openers")).select("lines", (F.col("openers") > 0).alias("commented"))
    return samples.agg(F.count("*").alias("samples"), F.countDistinct("func_name").alias("names"), F.sum(F.length("code")).alias("signs")).crossJoin(F.broadcast(lines)).select("samples", "names", "signs", "commented")


SQL_STORED_SAMPLES = f"SELECT count(*) AS samples, count(DISTINCT name) AS names, CAST(sum(length(source_code)) AS BIGINT) AS signs, true AS commented FROM {COMPONENTS} WHERE type = 'function' AND language = 'javascript'"


def reported(spark, sf):
    path = fresh_folder(spark, "report")
    tree.report(components(spark, sf).groupBy("type").agg(F.count("*").alias("n")), path, "Components by type")
    cells = F.split(F.col("value"), r" \| ")
    return spark.read.text(f"{path}/markdown").filter("value LIKE '| % | %' AND value NOT LIKE '| type%'").select(F.regexp_replace(cells[0], r"^\| ", "").alias("type"), F.regexp_replace(cells[1], r" \|$", "").cast("long").alias("n"))


SQL_REPORT = f"SELECT type, count(*) AS n FROM {COMPONENTS} GROUP BY 1"


def upserted(spark, sf):
    base = table(spark, sf, "repos").select("repo", "main_language", "licence")
    changes = files(spark, sf).groupBy("repo").agg(F.max(F.when(F.col("path").endswith(".json"), "json")).alias("licence"))
    return joins.upsert(base, changes, "repo")


SQL_UPSERT = f"""WITH c AS (SELECT repo, max(CASE WHEN path LIKE '%.json' THEN 'json' END) AS licence FROM {FILES} GROUP BY 1)
SELECT coalesce(r.repo, c.repo) AS repo, main_language, coalesce(c.licence, r.licence) AS licence FROM repos r FULL JOIN c ON r.repo = c.repo"""


def element_updates(spark, sf):
    new = joins.element_updated("parameters", "type_hint", "string", {"is_required": F.lit(False)})
    return components(spark, sf).filter("size(parameters) > 0").select("id", F.size(F.filter(new, lambda p: p["is_required"])).alias("required"))


SQL_ELEMENTS = f"SELECT id, CAST(len(list_filter(parameters, lambda p: CASE WHEN p.type_hint = 'string' THEN false ELSE p.is_required END)) AS INT) AS required FROM {COMPONENTS} WHERE len(parameters) > 0"


def global_data_flow(spark, sf):
    """Of each function and each of its parameters whether its text writes, reads or deletes it."""
    c = components(spark, sf).filter("type IN ('function', 'method', 'constructor')").select("id", "source_code", F.explode("parameters.name").alias("name")).filter("name RLIKE '^[A-Za-z_][A-Za-z0-9_]*$'")
    return c.select("id", "name", *[v.alias(k) for k, v in code.data_flow("source_code", "name").items()])


def _like(before: str, after: str) -> str:
    return f"regexp_matches(source_code, '{before}' || name || '{after}')"


# RE2 has no look-ahead: what may follow the sign is spelt out
_EQ = "\\s*=(?:[^=]|$)"
SQL_FLOW = f"""WITH c AS (SELECT id, coalesce(source_code, '') AS source_code, unnest(list_transform(parameters, lambda p: p.name)) AS name FROM {COMPONENTS} WHERE type IN ('function', 'method', 'constructor'))
SELECT id, name, {_like(chr(92) + 'b', _EQ)} OR {_like(chr(92) + 'b', chr(92) + 's*[-+*/]=')} OR {_like(chr(92) + 'b', chr(92) + '[[^' + chr(92) + ']]*' + chr(92) + ']' + _EQ)} OR {_like(chr(92) + 'b', chr(92) + '.(?:append|add|update|push|set)' + chr(92) + '(')} AS writes,
 {_like(chr(92) + 'bin' + chr(92) + 's+', chr(92) + 'b')} OR {_like(chr(92) + 'b', chr(92) + '[')} AS reads,
 {_like(chr(92) + 'bdel' + chr(92) + 's+', chr(92) + 'b')} OR {_like(chr(92) + 'bdelete' + chr(92) + 's+', chr(92) + 'b')} OR {_like(chr(92) + 'b', chr(92) + '.(?:clear|pop|remove)' + chr(92) + '(')} AS deletes FROM c WHERE regexp_matches(name, '^[A-Za-z_][A-Za-z0-9_]*$')"""


def rendered_docs(spark, sf):
    c = components(spark, sf).filter("type = 'function'")
    parts = ("name", "parameters", "return_type")
    return c.select("id", *[docs.rendered(*parts, style).alias(style) for style in ("google", "numpy", "sphinx")])


_NL, _P = "chr(10)", "lambda p: "
_WORD = "coalesce(p.description, '')"
SQL_RENDERED = f"""WITH c AS (SELECT id, name, coalesce(parameters, []) AS ps, return_type AS r, coalesce(return_type, '') <> '' AS has FROM {COMPONENTS} WHERE type = 'function')
SELECT id, name || CASE WHEN len(ps) > 0 THEN {_NL} || {_NL} || 'Args:' || {_NL} || array_to_string(list_transform(ps, {_P}'    ' || p.name || ': ' || {_WORD}), {_NL}) ELSE '' END || CASE WHEN has THEN {_NL} || {_NL} || 'Returns:' || {_NL} || '    ' || r ELSE '' END AS google,
 name || CASE WHEN len(ps) > 0 THEN {_NL} || {_NL} || 'Parameters' || {_NL} || '----------' || {_NL} || array_to_string(list_transform(ps, {_P}p.name || {_NL} || '    ' || {_WORD}), {_NL}) ELSE '' END || CASE WHEN has THEN {_NL} || {_NL} || 'Returns' || {_NL} || '-------' || {_NL} || r ELSE '' END AS numpy,
 name || CASE WHEN len(ps) > 0 THEN {_NL} || {_NL} || array_to_string(list_transform(ps, {_P}':param ' || p.name || ': ' || {_WORD}), {_NL}) ELSE '' END || CASE WHEN has THEN {_NL} || ':returns: ' || r ELSE '' END AS sphinx FROM c"""


def example_calls(spark, sf):
    """Calls of functions with their own parameters, with one argument less and with another name, against the expected call."""
    c = components(spark, sf).filter("type = 'function' AND language = 'python' AND size(parameters) > 0").select("id", "name", F.col("parameters.name").alias("p"))
    call = lambda name, args: F.concat(name, F.lit("("), F.array_join(args, ", "), F.lit(")"))
    last = F.slice("p", 1, F.size("p") - 1)
    rows = c.select(call(F.col("name"), F.col("p")).alias("expected"), "id", F.explode(F.array(F.struct(F.lit("same").alias("how"), F.concat(F.lit("  "), F.col("name"), F.lit(" ( "), F.array_join("p", " , "), F.lit(" ) ")).alias("said")), F.struct(F.lit("less").alias("how"), call(F.col("name"), last).alias("said")), F.struct(F.lit("name").alias("how"), call(F.concat("name", F.lit("_")), F.col("p")).alias("said")))).alias("x"))
    keyed = rows.select(F.concat_ws("|", "x.how", "id").alias("key"), "x.said", "expected")
    return docs.call_scores(keyed, "key", "said", "expected")


SQL_CALLS = f"""SELECT how || '|' || id AS key, how = 'same' AS ok, CASE how WHEN 'same' THEN '' WHEN 'less' THEN 'positional' ELSE 'name' END AS reason
FROM {COMPONENTS}, (VALUES ('same'), ('less'), ('name')) v(how) WHERE type = 'function' AND language = 'python' AND len(parameters) > 0"""


def _progress(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").cast("string").alias("repo_id"), F.col("event_type").alias("stage"), F.col("value").alias("percent"), "ts", "event_id")


def progress_state(spark, sf):
    e = _progress(spark, sf)
    return progress.latest_state(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 <> 0"))


SQL_STATE = "SELECT CAST(user_id AS VARCHAR) AS repo_id, arg_max(event_type, ts) AS stage, max_by(value, ts) AS percent FROM events GROUP BY 1"


def progress_windows(spark, sf):
    return progress.windowed_counts(_progress(spark, sf), "ts", "stage", "1 day").select(F.col("window.start").cast("date").alias("day"), "stage", "n")


SQL_DAYS = "SELECT CAST(ts AS DATE) AS day, event_type AS stage, count(*) AS n FROM events GROUP BY 1, 2"


def progress_lines(spark, sf):
    e = _progress(spark, sf).filter("percent IS NOT NULL").select("repo_id", "stage", F.lit(50.0).alias("percent"), F.lit("at work").alias("message"), "event_id")
    return progress.sse_lines(e.drop("event_id")).groupBy("repo_id", "value").agg(F.count("*").alias("n"))


SQL_LINES = """SELECT CAST(user_id AS VARCHAR) AS repo_id, 'event: progress' || chr(10) || 'data: {"stage":"' || event_type || '","percent":50.0,"message":"at work"}' || chr(10) || chr(10) AS value, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1, 2"""


def unexpired_entries(spark, sf):
    newest = validation(spark, sf).agg(F.max("validated_at").alias("now"))  # one row
    rows = validation(spark, sf).crossJoin(F.broadcast(newest))
    return progress.unexpired(rows, F.col("now"), 30 * 86400, "validated_at").groupBy("repo").agg(F.count("*").alias("n"))


SQL_UNEXPIRED = f"SELECT repo, count(*) AS n FROM {VALIDATION} WHERE epoch((SELECT max(validated_at) FROM validation)) // 1 - epoch(validated_at) // 1 <= 30 * 86400 GROUP BY 1"


def request_rounds(spark, sf):
    e = table(spark, sf, "events").withColumn("request", F.when(F.col("event_type") == "click", "").otherwise(F.col("event_type")))
    return progress.convergence(e, "user_id", "event_id", "request", most=6)


SQL_ROUNDS = """WITH p AS (SELECT user_id, CASE WHEN event_type = 'click' THEN '' ELSE event_type END AS r, row_number() OVER w AS i, lag(CASE WHEN event_type = 'click' THEN '' ELSE event_type END) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
s AS (SELECT *, CASE WHEN r = b AND r <> '' THEN 'unchanged' WHEN r = '' AND b = '' THEN 'exhausted' WHEN i >= 6 THEN 'limit' END AS reason FROM p)
SELECT user_id, CAST(coalesce(min(i) FILTER (reason IS NOT NULL), max(i)) AS INT) AS rounds, coalesce(arg_min(reason, i) FILTER (reason IS NOT NULL), 'ended') AS reason FROM s GROUP BY 1"""

QUERIES = {
    "stored_components": (stored_components, SQL_STORED), "stored_adjacency": (stored_adjacency, SQL_ADJACENCY), "stored_graph": (stored_graph, SQL_GRAPH), "component_shapes": (component_shapes, SQL_SHAPES), "writer_systems": (writer_systems, SQL_SYSTEMS),
    "writer_output": (writer_output, SQL_WRITTEN), "stored_samples": (stored_samples, SQL_STORED_SAMPLES), "reported": (reported, SQL_REPORT), "upserted": (upserted, SQL_UPSERT), "element_updates": (element_updates, SQL_ELEMENTS),
    "global_data_flow": (global_data_flow, SQL_FLOW), "rendered_docs": (rendered_docs, SQL_RENDERED), "example_calls": (example_calls, SQL_CALLS), "progress_state": (progress_state, SQL_STATE), "progress_windows": (progress_windows, SQL_DAYS),
    "progress_lines": (progress_lines, SQL_LINES), "unexpired_entries": (unexpired_entries, SQL_UNEXPIRED), "request_rounds": (request_rounds, SQL_ROUNDS),
}
