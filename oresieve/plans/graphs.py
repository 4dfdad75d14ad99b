"""Name resolution, dependency graphs, extraction and flow graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from oresieve.functions import docs
from oresieve.operators import extract, flow, graph, joins, lookup, validation
from oresieve.plans.tables import COMPONENTS, EDGES, FILES, NODES, components, edges, files, nodes, replies, table


def _modules(spark, sf):
    return nodes(spark, sf).filter("node_type = 'module'").select("id")


def call_edges(spark, sf):
    # the scan left calls empty: the last part of each dependency is the name that was called
    c = components(spark, sf).withColumn("calls", F.transform("depends_on", lambda x: F.element_at(F.split(x, r"\."), -1)))
    return joins.call_edges(c)


SQL_CALLS = f"""WITH i AS (SELECT lower(name) AS low, min(id) AS dst FROM {COMPONENTS} GROUP BY 1), c AS (SELECT DISTINCT id AS src, split_part(unnest(depends_on), '.', -1) AS name FROM {COMPONENTS})
SELECT src, name, dst FROM c JOIN i ON lower(c.name) = i.low"""


def priority_resolution(spark, sf):
    n = nodes(spark, sf).select("id", "repo", "file_path")
    f = files(spark, sf).select("repo", "path", "file_id")
    clean = F.regexp_replace(F.regexp_replace("file_path", r"\\", "/"), r"^(\./|/work/[^/]+/[^/]+/|/)", "")
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    key = lambda c: F.concat_ws("|", "repo", c)
    tiers = [(key(F.col("file_path")), key(F.col("path"))), (key(clean), key(F.col("path"))), (key(base(clean)), key(base(F.col("path"))))]
    return joins.priority_join(n, f, tiers, "id", "file_id").select("id", F.col("tier").cast("int").alias("tier"), "file_id")


_CLEAN = "regexp_replace(replace(file_path, '\\', '/'), '^(\\./|/work/[^/]+/[^/]+/|/)', '')"
SQL_PRIORITY = f"""WITH n AS (SELECT id, repo, file_path, {_CLEAN} AS c FROM {NODES}), f AS (SELECT repo, path, file_id, split_part(path, '/', -1) AS b FROM {FILES}), m AS (
 SELECT id, 0 AS tier, min(file_id) AS file_id FROM n JOIN f ON n.repo = f.repo AND n.file_path = f.path GROUP BY 1 UNION ALL SELECT id, 1, min(file_id) FROM n JOIN f ON n.repo = f.repo AND n.c = f.path GROUP BY 1
 UNION ALL SELECT id, 2, min(file_id) FROM n JOIN f ON n.repo = f.repo AND split_part(n.c, '/', -1) = f.b GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tier) AS k FROM m)
SELECT n.id, CAST(tier AS INT) AS tier, file_id FROM n LEFT JOIN (SELECT * FROM r WHERE k = 1) r ON n.id = r.id"""


def suffix_imports(spark, sf):
    names = components(spark, sf).select(F.explode("imports").alias("name")).unionByName(components(spark, sf).select(F.regexp_replace("name", "#.*", "").alias("name")))
    modules = nodes(spark, sf).filter("node_type = 'module'").select(F.col("qualified_name").alias("module"))
    return joins.suffix_join(names, modules)


SQL_SUFFIX = f"""WITH a AS (SELECT DISTINCT name FROM (SELECT unnest(imports) AS name FROM {COMPONENTS} UNION ALL SELECT regexp_replace(name, '#.*', '') FROM {COMPONENTS}) WHERE name <> ''), b AS (SELECT DISTINCT qualified_name AS module FROM {NODES} WHERE node_type = 'module' AND qualified_name <> '')
SELECT name, min(module) AS module FROM a JOIN b ON a.name = b.module OR ends_with(a.name, '.' || b.module) OR ends_with(b.module, '.' || a.name) GROUP BY name"""


def existence_counts(spark, sf):
    return joins.containment_counts(table(spark, sf, "documents"), table(spark, sf, "third_party_libs"), "doc_id", "text", "lib_name")


SQL_EXISTENCE = """WITH t AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '([a-z_]\\w*)', 1))) AS w FROM documents), l AS (SELECT DISTINCT lower(lib_name) AS w FROM third_party_libs)
SELECT d.doc_id, count(l.w) AS found FROM documents d LEFT JOIN t ON d.doc_id = t.doc_id LEFT JOIN l ON t.w = l.w GROUP BY d.doc_id"""


def restricted_edges(spark, sf):
    return joins.restricted_edges(components(spark, sf))


SQL_RESTRICTED = f"SELECT DISTINCT src, dst FROM (SELECT id AS src, unnest(depends_on) AS dst FROM {COMPONENTS}) WHERE dst IN (SELECT id FROM components)"


def placeholder_nodes(spark, sf):
    c = components(spark, sf)
    said = c.select(F.col("id").alias("src"), F.explode("methods").alias("dst"))
    return joins.placeholders(said, c)


SQL_PLACEHOLDERS = f"SELECT DISTINCT m AS id FROM (SELECT unnest(methods) AS m FROM {COMPONENTS}) WHERE m NOT IN (SELECT id FROM components)"


def gathered_context(spark, sf):
    out = joins.gathered_context(nodes(spark, sf), edges(spark, sf))
    return out.select("id", F.coalesce(F.array_join("dependencies", ","), F.lit("")).alias("dependencies"), F.coalesce(F.array_join("callers", ","), F.lit("")).alias("callers"))


SQL_CONTEXT = f"""WITH e AS (SELECT DISTINCT * FROM {EDGES}), a AS (SELECT src, string_agg(dst, ',' ORDER BY dst) AS d FROM e GROUP BY 1), b AS (SELECT dst, string_agg(src, ',' ORDER BY src) AS c FROM e GROUP BY 1)
SELECT id, coalesce(d, '') AS dependencies, coalesce(c, '') AS callers FROM {NODES} n LEFT JOIN a ON n.id = a.src LEFT JOIN b ON n.id = b.dst"""


def call_buckets(spark, sf):
    out = joins.call_buckets(nodes(spark, sf).withColumnRenamed("node_type", "type"))
    return out.select("id", *[F.size(c).cast("long").alias(c) for c in ("classes", "functions", "methods")])


def owner_rollup(spark, sf):
    n = nodes(spark, sf)
    owners = edges(spark, sf).join(n.filter("node_type = 'class'").select(F.col("id").alias("src")), "src").join(n.filter("node_type = 'method'").select(F.col("id").alias("dst")), "dst")
    owned = n.select("id").join(owners.groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("owner")), "id", "left")
    return joins.roll_up_to_owner(edges(spark, sf).distinct(), owned)


SQL_ROLLUP = f"""WITH n AS {NODES}, e AS (SELECT DISTINCT * FROM {EDGES}), o AS (SELECT e.dst AS id, min(e.src) AS owner FROM e JOIN n a ON e.src = a.id AND a.node_type = 'class' JOIN n b ON e.dst = b.id AND b.node_type = 'method' GROUP BY 1),
j AS (SELECT e.src, e.dst, s.owner AS so, d.owner AS dow FROM e LEFT JOIN o s ON e.src = s.id LEFT JOIN o d ON e.dst = d.id)
SELECT DISTINCT src, dst FROM (SELECT src, CASE WHEN dow IS NOT NULL AND dow IS DISTINCT FROM so THEN dow ELSE dst END AS dst FROM j WHERE NOT (dow IS NOT NULL AND dow IS NOT DISTINCT FROM so)) WHERE src <> dst AND dst <> ''"""


def bfs_depth(spark, sf):
    return graph.bfs(edges(spark, sf), _modules(spark, sf), 3)


SQL_BFS = f"""WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT * FROM {EDGES}), r(id, depth) AS (SELECT id, 0 FROM {NODES} WHERE node_type = 'module' UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.id WHERE r.depth < 3)
SELECT id, CAST(min(depth) AS INT) AS depth FROM r GROUP BY id"""


def khop_subgraph(spark, sf):
    return graph.khop(edges(spark, sf), _modules(spark, sf), 1).distinct()


SQL_KHOP = f"""WITH e AS (SELECT DISTINCT * FROM {EDGES}), m AS (SELECT id FROM {NODES} WHERE node_type = 'module'), k AS (SELECT id FROM m UNION SELECT dst FROM e WHERE src IN (SELECT id FROM m))
SELECT src, dst FROM e WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)"""


def simple_paths(spark, sf):
    first = nodes(spark, sf).filter("node_type = 'module' AND size(depends_on) > 0").agg(F.min("id").alias("id")).first()
    e = edges(spark, sf)
    return graph.simple_paths(e, first["id"] if first else "", None, 4).select(F.array_join("path", ">").alias("path"))


SQL_PATHS = f"""WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM {EDGES}), s AS (SELECT min(id) AS id FROM {NODES} WHERE node_type = 'module' AND len(depends_on) > 0), r(n, p) AS (SELECT id, [id] FROM s UNION ALL SELECT e.dst, list_append(r.p, e.dst) FROM r JOIN e ON e.src = r.n WHERE NOT list_contains(r.p, e.dst) AND len(r.p) <= 4)
SELECT array_to_string(p, '>') AS path FROM r WHERE len(p) > 1"""


def dependents_closure(spark, sf):
    start = nodes(spark, sf).filter("node_type = 'method'").agg(F.min("id").alias("id"))
    return graph.dependents_closure(edges(spark, sf), start)


SQL_DEPENDENTS = f"""WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT * FROM {EDGES}), s AS (SELECT min(id) AS id FROM {NODES} WHERE node_type = 'method'), r(id, depth) AS (SELECT id, 0 FROM s UNION SELECT e.src, r.depth + 1 FROM r JOIN e ON e.dst = r.id WHERE r.depth < 40)
SELECT id, CAST(min(depth) AS INT) AS depth FROM r GROUP BY id HAVING min(depth) > 0"""


def _geo(spark, sf):
    n, r, c = table(spark, sf, "nation"), table(spark, sf, "region"), table(spark, sf, "customer")
    rid = F.concat(F.lit("r"), F.col("r_regionkey").cast("string"))
    nid, cid = F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    e = n.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("src"), nid.alias("dst")).unionByName(c.select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("src"), cid.alias("dst")))
    v = r.select(rid.alias("id")).union(n.select(nid)).union(c.select(cid))
    return e, v


_GEO_E = "(SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer)"
_GEO_V = "(SELECT 'r' || r_regionkey AS id FROM region UNION ALL SELECT 'n' || n_nationkey FROM nation UNION ALL SELECT 'c' || c_custkey FROM customer)"


def topo_levels(spark, sf):
    e, v = _geo(spark, sf)
    return graph.levels(e, v)


SQL_LEVELS = f"""WITH RECURSIVE e AS {_GEO_E}, v AS {_GEO_V}, r(id, l) AS (SELECT id, 0 FROM v WHERE id NOT IN (SELECT dst FROM e) UNION ALL SELECT e.dst, r.l + 1 FROM r JOIN e ON e.src = r.id) SELECT id, CAST(max(l) AS INT) AS level FROM r GROUP BY id"""


def _rings(spark, sf):
    p = table(spark, sf, "part").select("p_partkey")
    k, block = F.col("p_partkey"), F.floor((F.col("p_partkey") - 1) / 5)
    next_ = F.when((k - 1) % 5 < 4, k + 1).when(block % 2 == 0, k - 4)
    return p.select(k.cast("string").alias("src"), next_.cast("string").alias("dst")).filter("dst IS NOT NULL")


_RINGS = "(SELECT CAST(p_partkey AS VARCHAR) AS src, CAST(CASE WHEN (p_partkey - 1) % 5 < 4 THEN p_partkey + 1 WHEN ((p_partkey - 1) // 5) % 2 = 0 THEN p_partkey - 4 END AS VARCHAR) AS dst FROM part WHERE (p_partkey - 1) % 5 < 4 OR ((p_partkey - 1) // 5) % 2 = 0)"


def strong_components(spark, sf):
    return graph.strong_components(_rings(spark, sf))


SQL_SCC = f"""WITH RECURSIVE e AS MATERIALIZED {_RINGS}, c(a, b) AS (SELECT src, dst FROM e UNION SELECT c.a, e.dst FROM c JOIN e ON c.b = e.src) SELECT x.a AS id, min(x.b) AS label FROM c x JOIN c y ON x.a = y.b AND x.b = y.a GROUP BY x.a HAVING count(DISTINCT x.b) > 1"""


def without_cycles(spark, sf):
    e = _rings(spark, sf)
    return graph.without_cycles(e, graph.strong_components(e))


SQL_BREAK = f"WITH s AS ({SQL_SCC}), e AS {_RINGS} SELECT src, dst FROM e LEFT JOIN s a ON e.src = a.id LEFT JOIN s b ON e.dst = b.id WHERE a.label IS NULL OR b.label IS NULL OR a.label <> b.label"


def weak_components(spark, sf):
    return graph.weak_components(edges(spark, sf), nodes(spark, sf).select("id"))


SQL_WCC = f"""WITH RECURSIVE e AS MATERIALIZED (SELECT src, dst FROM {EDGES} UNION SELECT dst, src FROM {EDGES}), r(id, label) AS (SELECT id, id FROM {NODES} UNION SELECT e.dst, r.label FROM r JOIN e ON e.src = r.id WHERE r.label < e.dst) SELECT id, min(label) AS label FROM r GROUP BY id"""


def graph_statistics(spark, sf):
    return graph.statistics(edges(spark, sf), nodes(spark, sf))


SQL_GSTATS = f"""WITH i AS (SELECT dst AS id, count(*) AS n FROM {EDGES} GROUP BY 1), o AS (SELECT src AS id, count(*) AS n FROM {EDGES} GROUP BY 1), d AS (SELECT v.id, coalesce(i.n, 0) AS a, coalesce(o.n, 0) AS b FROM {NODES} v LEFT JOIN i ON v.id = i.id LEFT JOIN o ON v.id = o.id)
SELECT count(*) AS nodes, CAST(sum(b) AS BIGINT) AS edges, round(avg(a), 4) AS avg_in, round(avg(b), 4) AS avg_out, max(a) AS max_in, max(b) AS max_out FROM d"""


def reverse_adjacency(spark, sf):
    return graph.adjacency(edges(spark, sf), reverse=True).select("id", F.array_join("others", ",").alias("others"))


SQL_REVERSE = f"SELECT dst AS id, string_agg(src, ',' ORDER BY src) AS others FROM (SELECT DISTINCT * FROM {EDGES}) GROUP BY dst"


def edge_types(spark, sf):
    n = nodes(spark, sf)
    e = edges(spark, sf).join(n.select(F.col("id").alias("src"), F.col("node_type").alias("a")), "src").join(n.select(F.col("id").alias("dst"), F.col("node_type").alias("b")), "dst")
    typed = e.select(F.concat_ws("-", "a", "b").alias("type"))
    return graph.type_counts(n.select(F.col("node_type").alias("type")), typed)


SQL_TYPES = f"WITH n AS {NODES}, e AS (SELECT concat_ws('-', a.node_type, b.node_type) AS type FROM {EDGES} e JOIN n a ON e.src = a.id JOIN n b ON e.dst = b.id) SELECT 'node' AS what, node_type AS type, count(*) AS n FROM n GROUP BY 2 UNION ALL SELECT 'edge', type, count(*) FROM e GROUP BY 2"


def dependency_order(spark, sf):
    n = nodes(spark, sf)
    e = edges(spark, sf).join(n.select(F.col("id").alias("src"), "repo"), "src")
    return graph.dependency_first(e, n, "repo")


def neighbours(spark, sf):
    top = graph.degrees(edges(spark, sf), nodes(spark, sf)).orderBy(F.desc("in_degree"), "id").first()
    return joins.neighbours(edges(spark, sf), top["id"] if top else "", reverse=True)


SQL_NEIGHBOURS = f"WITH t AS (SELECT dst FROM {EDGES} GROUP BY 1 ORDER BY count(*) DESC, dst LIMIT 1) SELECT DISTINCT src AS id FROM {EDGES} WHERE dst = (SELECT dst FROM t)"


def _parsed(spark, sf):
    f = files(spark, sf)
    return f.select(F.concat_ws("/", "repo", "path").alias("path"), "value")


def extracted_components(spark, sf):
    return extract.components(_parsed(spark, sf)).select("id", "name", "type", "language", "file_path", "start_line", "end_line", "signature", "complexity", "visibility")


def extracted_statements(spark, sf):
    return extract.function_statements(_parsed(spark, sf)).select("func_id", "ord", "type", "line", "end_line", "depth", "code")


def _statements(spark, sf):
    return extract.function_statements(_parsed(spark, sf)).dropDuplicates(["func_id", "ord"]).persist()


def control_flow_graph(spark, sf):
    return flow.cfg_edges(_statements(spark, sf))


def dependence_graph(spark, sf):
    return flow.pdg_edges(_statements(spark, sf))


def hybrid_graph(spark, sf):
    s = _statements(spark, sf)
    return flow.hpg_edges(flow.cfg_edges(s), flow.pdg_edges(s))


def knowledge_graph(spark, sf):
    c, s = extract.graph_parts(_parsed(spark, sf))
    v, e = flow.ckg(c, s, flow.cfg_edges(s), flow.data_dependence(s))
    return graph.type_counts(v, e)


def api_endpoints(spark, sf):
    return extract.api_endpoints(_parsed(spark, sf)).withColumn("path_parameters", F.array_join("path_parameters", ","))


def extraction_quality(spark, sf):
    f = _parsed(spark, sf)
    found = extract.components(f).filter("type IN ('function', 'method', 'constructor', 'class')").select("file_path", "name", F.col("start_line").alias("line"))
    return validation.file_metrics(extract.gold_components(f), found).select("file_path", "gold", "found", "matched", "precision", "recall", "f1")


def band_alignment(spark, sf):
    n = nodes(spark, sf).filter("line IS NOT NULL AND node_type <> 'module'").select(F.regexp_replace("qualified_name", r"\.[^.]+$", "").alias("file"), "name", "line")
    c = components(spark, sf).filter(F.col("type") != "module").select(F.regexp_replace("id", r"\.[^.]+$", "").alias("file"), "name", F.col("location.start_line").alias("line"))
    return joins.band_pairs(n, c, ["file", "name"], "line", 1)


def listed_components(spark, sf):
    c = components(spark, sf).withColumn("file_path", F.col("location.file_path"))
    return lookup.listed(c).select("id", "type", "parent_class")


SQL_LISTED = f"""SELECT id, CASE type WHEN 'constructor' THEN 'method' WHEN 'arrow_function' THEN 'function' ELSE type END AS type, CASE WHEN type IN ('constructor', 'method') THEN nullif(split_part(id, '.', -2), '') END AS parent_class
FROM {COMPONENTS} WHERE type NOT IN ('field', 'static_field', 'global_variable', 'variable', 'api_endpoint', 'import')"""


def file_tree(spark, sf):
    f = files(spark, sf).select(F.concat_ws("/", "repo", "path").alias("path"))
    return lookup.tree_order(f).select("path", "parent", "name", "is_file")


SQL_TREE = f"""WITH f AS (SELECT DISTINCT string_split(concat_ws('/', repo, path), '/') AS p FROM {FILES}), e AS (SELECT DISTINCT array_to_string(p[1:k], '/') AS path, k = len(p) AS is_file FROM (SELECT p, unnest(range(1, len(p) + 1)) AS k FROM f))
SELECT path, regexp_extract(path, '^(.*)/[^/]+$', 1) AS parent, split_part(path, '/', -1) AS name, is_file FROM e"""


def searched_files(spark, sf):
    return lookup.searched(files(spark, sf), "path", "GateWay").groupBy("repo").agg(F.count("*").alias("n"))


SQL_SEARCH = f"SELECT repo, count(*) AS n FROM {FILES} WHERE contains(lower(path), 'gateway') GROUP BY repo"


def name_aliases(spark, sf):
    return lookup.aliases(components(spark, sf).filter("type <> 'module'")).groupBy("kind").agg(F.count("*").alias("aliases"), F.count_distinct("low").alias("names"))


SQL_ALIASES = f"""WITH a AS (SELECT DISTINCT id, type AS kind, lower(unnest(CASE WHEN type IN ('method', 'constructor') THEN [name, concat_ws('.', nullif(split_part(id, '.', -2), ''), name)] ELSE [name, id] END)) AS low FROM {COMPONENTS} WHERE type <> 'module')
SELECT kind, count(*) AS aliases, count(DISTINCT low) AS names FROM a GROUP BY kind"""


def severities(spark, sf):
    l = table(spark, sf, "lineitem").select(F.when(F.col("l_discount") >= 0.08, "critical").when(F.col("l_discount") >= 0.05, "high").when(F.col("l_discount") >= 0.02, "medium").otherwise("low").alias("severity"), F.col("l_returnflag").alias("cwe"))  # noqa: E741
    return lookup.severity_histogram(l, "severity", "cwe")


SQL_SEVERITIES = "SELECT CASE WHEN l_discount >= 0.08 THEN 'critical' WHEN l_discount >= 0.05 THEN 'high' WHEN l_discount >= 0.02 THEN 'medium' ELSE 'low' END AS severity, l_returnflag AS cwe, count(*) AS n FROM lineitem GROUP BY 1, 2"


def resolved_dependencies(spark, sf):
    return lookup.resolved_dependencies(extract.components(_parsed(spark, sf)))


def documentation_similarity(spark, sf):
    return docs.similarity(replies(spark, sf), "record_id", "original_comment", "generated_docstring").select("record_id", F.round("bleu4", 6).alias("bleu4"), F.round("rouge_l", 6).alias("rouge_l"))


def tree_completeness(spark, sf):
    c = components(spark, sf).filter("language = 'python' AND type IN ('function', 'class')")
    return docs.tree_scores(c).select("id", F.round("score", 6).alias("score"))


def script_facts(spark, sf):
    facts = docs.script_facts("source_code")
    c = components(spark, sf).filter("language IN ('javascript', 'typescript')")
    return c.groupBy("language", "type").agg(F.sum(F.size(facts["promise_handlers"])).alias("handlers"), F.sum(F.size(facts["middleware"])).alias("middleware"), F.count_if(facts["iife"]).alias("iife"), F.sum(facts["inline_functions"]).alias("inline"))


SQL_FACTS = rf"""SELECT language, type, CAST(sum(len(regexp_extract_all(coalesce(source_code, ''), '\.(then|catch|finally)\s*\(', 1))) AS BIGINT) AS handlers,
 CAST(sum(len(list_distinct(regexp_extract_all(coalesce(source_code, ''), '\b((?:app|router|express)\.[A-Za-z0-9_]+)\s*\(', 1)))) AS BIGINT) AS middleware,
 count(*) FILTER (regexp_matches(coalesce(source_code, ''), '(?s)\(\s*(?:async\s+)?function\b.*\}}\s*\)?\s*\(|\(\s*(?:async\s*)?\([^)]*\)\s*=>.*\)\s*\(')) AS iife,
 CAST(sum(len(regexp_extract_all(coalesce(source_code, ''), '[(,]\s*(?:async\s+)?(function\b|\(?[A-Za-z0-9_$, ]*\)?\s*=>)', 1))) AS BIGINT) AS inline
FROM {COMPONENTS} WHERE language IN ('javascript', 'typescript') GROUP BY 1, 2"""


def reaching_definitions(spark, sf):
    s = _statements(spark, sf)
    return flow.reaching_definitions(s, flow.cfg_edges(s))


QUERIES = {
    "call_edges": (call_edges, SQL_CALLS), "priority_resolution": (priority_resolution, SQL_PRIORITY), "suffix_imports": (suffix_imports, SQL_SUFFIX), "existence_counts": (existence_counts, SQL_EXISTENCE), "restricted_edges": (restricted_edges, SQL_RESTRICTED),
    "placeholder_nodes": (placeholder_nodes, SQL_PLACEHOLDERS), "gathered_context": (gathered_context, SQL_CONTEXT), "call_buckets": (call_buckets, None), "owner_rollup": (owner_rollup, SQL_ROLLUP), "bfs_depth": (bfs_depth, SQL_BFS), "khop_subgraph": (khop_subgraph, SQL_KHOP),
    "simple_paths": (simple_paths, SQL_PATHS), "dependents_closure": (dependents_closure, SQL_DEPENDENTS), "topo_levels": (topo_levels, SQL_LEVELS), "strong_components": (strong_components, SQL_SCC), "without_cycles": (without_cycles, SQL_BREAK), "weak_components": (weak_components, SQL_WCC),
    "graph_statistics": (graph_statistics, SQL_GSTATS), "reverse_adjacency": (reverse_adjacency, SQL_REVERSE), "edge_types": (edge_types, SQL_TYPES), "neighbours": (neighbours, SQL_NEIGHBOURS), "dependency_order": (dependency_order, None),
    "extracted_components": (extracted_components, None), "extracted_statements": (extracted_statements, None), "control_flow_graph": (control_flow_graph, None), "dependence_graph": (dependence_graph, None), "hybrid_graph": (hybrid_graph, None), "knowledge_graph": (knowledge_graph, None),
    "api_endpoints": (api_endpoints, None), "extraction_quality": (extraction_quality, None), "band_alignment": (band_alignment, None),
    "listed_components": (listed_components, SQL_LISTED), "file_tree": (file_tree, SQL_TREE), "searched_files": (searched_files, SQL_SEARCH), "name_aliases": (name_aliases, SQL_ALIASES), "severities": (severities, SQL_SEVERITIES),
    "resolved_dependencies": (resolved_dependencies, None), "documentation_similarity": (documentation_similarity, None), "tree_completeness": (tree_completeness, None), "script_facts": (script_facts, SQL_FACTS), "reaching_definitions": (reaching_definitions, None),
}
