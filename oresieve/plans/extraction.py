"""What components say of themselves, read out of their own texts and held against the columns that the scan gave."""

from __future__ import annotations

from pyspark.sql import functions as F

from oresieve.functions import docs
from oresieve.operators import extract, flow, lookup
from oresieve.plans.tables import COMPONENTS, components

_CODE = "type IN ('function', 'method', 'constructor', 'class') AND language IN ('python', 'javascript', 'typescript', 'java')"
_CALLABLE = "type IN ('function', 'method', 'constructor') AND language IN ('python', 'javascript', 'typescript', 'java')"


def _own(spark, sf):
    return extract.own_components(components(spark, sf))


def own_names(spark, sf):
    return _own(spark, sf).select("id", "name", (F.col("type") == "class").alias("is_class"))


SQL_NAMES = f"SELECT id, name, type = 'class' AS is_class FROM {COMPONENTS} WHERE {_CODE}"


def own_parameters(spark, sf):
    return _own(spark, sf).select("id", F.posexplode("parameters").alias("place", "p")).select("id", "place", "p.name", "p.type_hint")


SQL_PARAMETERS = f"""SELECT id, CAST(i - 1 AS INT) AS place, parameters[i].name AS name, parameters[i].type_hint AS type_hint
FROM (SELECT id, parameters, unnest(range(1, len(parameters) + 1)) AS i FROM {COMPONENTS} WHERE {_CALLABLE})"""


def own_modifiers(spark, sf):
    return _own(spark, sf).filter("type <> 'class'").select("id", "is_async", "is_static")


SQL_MODIFIERS = f"SELECT id, coalesce(is_async, false) AS is_async, coalesce(is_static, false) AS is_static FROM {COMPONENTS} WHERE {_CALLABLE}"


def own_results(spark, sf):
    # scripts name no type, constructors have none, and a promise stands for what it gives
    typed = components(spark, sf).filter("language = 'python' OR (language IN ('typescript', 'java') AND type <> 'constructor')")
    return extract.own_components(typed).filter("type <> 'class'").select("id", F.regexp_replace("return_type", r"^Promise<(.*)>$", "$1").alias("return_type"))


SQL_RESULTS = f"SELECT id, return_type FROM {COMPONENTS} WHERE {_CALLABLE} AND (language = 'python' OR (language IN ('typescript', 'java') AND type <> 'constructor'))"


def own_decorators(spark, sf):
    return _own(spark, sf).filter("type <> 'class' AND size(decorators) > 0").select("id", F.array_join(F.array_sort("decorators"), ",").alias("decorators"))


SQL_DECORATORS = f"SELECT id, array_to_string(list_sort(list_transform(decorators, lambda d: regexp_extract(d, '@?([A-Za-z_0-9.]+)', 1))), ',') AS decorators FROM {COMPONENTS} WHERE {_CALLABLE} AND len(decorators) > 0"


def own_methods(spark, sf):
    listed = components(spark, sf).filter("type = 'class' AND size(methods) > 0")
    return extract.own_components(listed).select("id", F.array_join(F.array_sort("methods"), ",").alias("methods"))


SQL_METHODS = f"SELECT id, array_to_string(list_sort(list_transform(methods, lambda m: replace(split_part(m, '.', -1), '#ctor', ''))), ',') AS methods FROM {COMPONENTS} WHERE type = 'class' AND len(methods) > 0 AND {_CODE}"


def own_parents(spark, sf):
    return _own(spark, sf).filter("type = 'class'").select("id", F.array_join("parents", ",").alias("parents"))


_BASE = "regexp_extract(source_code, '(?m)^(?:export |public |abstract )*class [A-Za-z_0-9$]+(?:<[^>]*>)?(?:\\(([A-Za-z_0-9., ]*)\\)| extends ([A-Za-z_0-9.]+))?', "
SQL_PARENTS = f"SELECT id, concat({_BASE}1), {_BASE}2)) AS parents FROM {COMPONENTS} WHERE type = 'class' AND {_CODE}"


def second_reader(spark, sf):
    """Both readers of heads on the same classes: names that one of them misses."""
    whole = components(spark, sf).filter("type = 'class' AND language <> 'python'").select(F.concat("id", F.when(F.col("language") == "java", ".java").when(F.col("language") == "javascript", ".js").otherwise(".ts")).alias("path"), F.col("source_code").alias("value"), "id", "methods")
    gold = extract.gold_components(whole).filter("type IN ('method', 'constructor')").groupBy(F.col("file_path").alias("path")).agg(F.array_sort(F.collect_list("name")).alias("names"))
    return whole.filter("size(methods) > 0").join(gold, "path", "left").select("id", F.array_join("names", ",").alias("methods"))


SQL_SECOND = SQL_METHODS + " AND language <> 'python'"

_STATEMENTS = {"IF": r"^(?:\}\s*)?(?:else\s+)?if\s*\(", "FOR": r"^for\s*\(", "WHILE": r"^while\s*\(", "TRY": r"^try\b", "EXCEPT": r"^(?:\}\s*)?catch\b", "SWITCH": r"^switch\s*\(", "RETURN": r"^return\b", "RAISE": r"^throw\b", "BREAK": r"^break\b", "CONTINUE": r"^continue\b"}
_BRACKETS = "language IN ('javascript', 'typescript', 'java') AND type IN ('function', 'method', 'constructor')"


def snippet_kinds(spark, sf):
    found = extract.component_statements(components(spark, sf).filter(_BRACKETS)).filter(F.col("type").isin(*_STATEMENTS))
    return found.groupBy(F.col("func_id").alias("id"), "type").agg(F.count("*").alias("n"))


_LINE = "trim(line, ' ' || chr(9) || chr(13))"
SQL_SNIPPETS = f"""WITH l AS (SELECT id, unnest(string_split(source_code, chr(10))) AS line FROM {COMPONENTS} WHERE {_BRACKETS}), k AS (SELECT id, CASE {' '.join(f"WHEN regexp_matches({_LINE}, '{p}') THEN '{k}'" for k, p in _STATEMENTS.items())} END AS type FROM l)
SELECT id, type, count(*) AS n FROM k WHERE type IS NOT NULL GROUP BY 1, 2"""


def sample_rows(spark, sf):
    c = components(spark, sf).filter("language = 'javascript' AND type IN ('function', 'method', 'constructor')")
    return lookup.sample_components(c.select("repo", F.col("name").alias("func_name"), F.col("source_code").alias("code"))).select("id", "name", "type", "is_async", "lines_of_code", "file_path")


SQL_SAMPLES = rf"""SELECT name || '_' || substr(md5(source_code), 1, 8) AS id, name, CASE WHEN name = 'constructor' THEN 'constructor' WHEN regexp_matches(source_code, '\bclass\s') THEN 'class' WHEN regexp_matches(source_code, '^\s*(?:async\s+)?function\b|=>') THEN 'function' ELSE 'method' END AS type,
 regexp_matches(source_code, '\basync\b') AS is_async, CAST(len(string_split(source_code, chr(10))) AS INT) AS lines_of_code, repo || '/' || name || '.js' AS file_path FROM {COMPONENTS} WHERE language = 'javascript' AND type IN ('function', 'method', 'constructor')"""


def first_calls(spark, sf):
    call = docs.first_call("signature")
    return components(spark, sf).filter("signature IS NOT NULL").select("id", call["receiver"].alias("receiver"), call["name"].alias("called"))


_P = r"'(?:([A-Za-z0-9_$]+(?:[.][A-Za-z0-9_$]+)*)[.])?([A-Za-z_$][A-Za-z0-9_$]*)\s*[(]'"
SQL_FIRST = f"SELECT id, nullif(regexp_extract(signature, {_P}, 1), '') AS receiver, nullif(regexp_extract(signature, {_P}, 2), '') AS called FROM {COMPONENTS} WHERE signature IS NOT NULL"

_PYTHON = "language = 'python' AND type IN ('function', 'method', 'constructor')"
_KINDS = {"FOR": r"^(?:async )?for\b", "WHILE": r"^while\b", "TRY": r"^try:", "RETURN": r"^return\b", "RAISE": r"^raise\b", "BREAK": r"^break$", "CONTINUE": r"^continue$", "IF": r"^(?:el)?if\b", "WITH": r"^(?:async )?with\b"}


def _python(spark, sf):
    return extract.python_statements(components(spark, sf).filter(_PYTHON))


def _whole(rows):
    return rows.withColumn("id", F.regexp_replace("func_id", r"\|.*$", ""))


def python_kinds(spark, sf):
    return _whole(_python(spark, sf)).filter(F.col("type").isin(*_KINDS)).groupBy("id", "type").agg(F.count("*").alias("n"))


# lines of code: those of documentation strings are blanked first
_LINES = f"""(SELECT id, trim(unnest(string_split(regexp_replace(source_code, '(?s)\"\"\".*?\"\"\"', '', 'g'), chr(10))), ' ' || chr(9) || chr(13)) AS line FROM {COMPONENTS} WHERE {_PYTHON})"""
SQL_KINDS = f"SELECT id, type, count(*) AS n FROM (SELECT id, CASE {' '.join(f"WHEN regexp_matches(line, '{p}') THEN '{k}'" for k, p in _KINDS.items())} END AS type FROM {_LINES}) WHERE type IS NOT NULL GROUP BY 1, 2"


def flow_counts(spark, sf):
    """Edges of the control flow of each function: branches taken and not taken, handlers, and ways to the exit by return and raise."""
    s = _python(spark, sf).persist()
    ends = s.filter("type IN ('RETURN', 'RAISE')").select("func_id", F.col("ord").alias("source"), F.lit(True).alias("ends"))
    e = _whole(flow.cfg_edges(s).join(ends, ["func_id", "source"], "left"))
    kind = lambda k: F.count_if(F.col("type") == k)
    counts = e.groupBy("id").agg(kind("true").alias("taken"), kind("exception").alias("handlers"), F.count_if(F.col("ends") & (F.col("target") == flow.EXIT)).alias("leaving"))
    return counts.filter("taken + handlers + leaving > 0")


SQL_COUNTS = f"""SELECT id, count(*) FILTER (regexp_matches(line, '^(?:(?:el)?if|for|while|async for)\\b')) AS taken, count(*) FILTER (regexp_matches(line, '^except\\b')) AS handlers, count(*) FILTER (regexp_matches(line, '^(?:return|raise)\\b')) AS leaving
FROM {_LINES} GROUP BY 1 HAVING taken + handlers + leaving > 0"""


def guard_counts(spark, sf):
    """Statements that depend on a block of their function, by the kind of the block."""
    s = _python(spark, sf).persist()
    blocks = s.select("func_id", F.col("ord").alias("source"), F.col("type").alias("block"))
    return flow.control_dependence(s).join(blocks, ["func_id", "source"]).groupBy("block", "type").agg(F.count("*").alias("n"))


QUERIES = {
    "python_kinds": (python_kinds, SQL_KINDS), "flow_counts": (flow_counts, SQL_COUNTS), "guard_counts": (guard_counts, None),
    "own_names": (own_names, SQL_NAMES), "own_parameters": (own_parameters, SQL_PARAMETERS), "own_modifiers": (own_modifiers, SQL_MODIFIERS), "own_results": (own_results, SQL_RESULTS), "own_decorators": (own_decorators, SQL_DECORATORS),
    "own_methods": (own_methods, SQL_METHODS), "own_parents": (own_parents, SQL_PARENTS), "second_reader": (second_reader, SQL_SECOND), "snippet_kinds": (snippet_kinds, SQL_SNIPPETS), "sample_rows": (sample_rows, SQL_SAMPLES), "first_calls": (first_calls, SQL_FIRST),
}
