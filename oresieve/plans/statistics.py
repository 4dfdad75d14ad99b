"""Counts, rollups, coverage and scores over the component tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from oresieve.functions import code
from oresieve.operators import quality, validation
from oresieve.plans.tables import COMPONENTS, FILES, NODES, REPLIES, VALIDATION, components, files, nodes, replies
from oresieve.plans.tables import validation as runs

FIELDS = ["signature", "return_type", "existing_docstring", "decorators", "calls", "parameters", "complexity", "is_async", "source_code", "depends_on"]


def component_stats(spark, sf):
    c = components(spark, sf)
    deps = code.n("depends_on")
    kinds = {"functions": "function", "methods": "method", "classes": "class", "constructors": "constructor", "modules": "module"}
    return c.groupBy("language").agg(
        F.count("*").alias("total"), *[F.count_if(F.col("type") == v).alias(k) for k, v in kinds.items()], F.sum(deps).cast("long").alias("deps"), F.max(deps).cast("long").alias("max_deps"), F.round(F.avg(deps), 2).alias("avg_deps"), F.count_if(deps == 0).alias("without_deps")
    )


_D = "coalesce(len(depends_on), 0)"
SQL_STATS = f"""SELECT language, count(*) AS total, count(*) FILTER (type = 'function') AS functions, count(*) FILTER (type = 'method') AS methods, count(*) FILTER (type = 'class') AS classes,
 count(*) FILTER (type = 'constructor') AS constructors, count(*) FILTER (type = 'module') AS modules, CAST(sum({_D}) AS BIGINT) AS deps, CAST(max({_D}) AS BIGINT) AS max_deps, round(avg({_D}), 2) AS avg_deps,
 count(*) FILTER ({_D} = 0) AS without_deps FROM {COMPONENTS} GROUP BY language"""


def parse_status(spark, sf):
    c = components(spark, sf)
    return c.groupBy("repo").agg(F.count_if(F.col("type") == "class").alias("classes"), F.count_if(F.col("type").isin("function", "method", "constructor")).alias("functions"), F.count_distinct("file_id").alias("files"))


SQL_PARSE = f"""SELECT repo, count(*) FILTER (type = 'class') AS classes, count(*) FILTER (type IN ('function', 'method', 'constructor')) AS functions, count(DISTINCT file_id) AS files FROM {COMPONENTS} GROUP BY repo"""


def kind_histogram(spark, sf):
    by = nodes(spark, sf).groupBy("node_type").agg(F.count("*").alias("n"))
    total = by.agg(F.sum("n").alias("total"))  # one row
    return by.crossJoin(F.broadcast(total)).select("node_type", "n", F.round(F.col("n") / F.col("total") * 100, 2).alias("percent"))


SQL_KINDS = f"SELECT node_type, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM {NODES}), 2) AS percent FROM {NODES} GROUP BY node_type"


def coverage_rollup(spark, sf):
    documented = (F.trim(F.coalesce("existing_docstring", F.lit(""))) != "").cast("double").alias("score")
    scores = components(spark, sf).select("language", "type", documented)
    return quality.score_rollup(scores, "language", "type")


SQL_COVERAGE = f"""WITH s AS (SELECT language, type, CASE WHEN trim(coalesce(existing_docstring, ''), ' ') <> '' THEN 1.0 ELSE 0.0 END AS score FROM {COMPONENTS})
SELECT language, type, count(*) AS components, round(avg(score), 3) AS average, count(*) FILTER (score > 0) AS documented, count(*) FILTER (score = 0) AS undocumented FROM s GROUP BY GROUPING SETS ((language), (type), ())"""


def completeness_scores(spark, sf):
    return quality.completeness(components(spark, sf)).select("id", F.array_join("required", ",").alias("required"), "score")


def completeness_rollup(spark, sf):
    return quality.score_rollup(quality.completeness(components(spark, sf)), "language", "type")


def completeness_criteria(spark, sf):
    return quality.criteria_shares(quality.completeness(components(spark, sf)))


def section_labels(spark, sf):
    c = components(spark, sf).filter(F.col("language").isin("python", "java", "javascript", "typescript"))
    parts = ("args", "returns", "raises")
    return c.select("language", *[quality.has_section(s, "existing_docstring", "language").alias(s) for s in parts]).groupBy("language").agg(*[F.count_if(s).alias(s) for s in parts])


def _labels(section: str) -> str:
    whens = []
    for lang, labels in quality.LABELS.items():
        tests = " OR ".join(f"contains(lower(existing_docstring), '{x}')" for x in labels[section])
        whens.append(f"WHEN language = '{lang}' THEN ({tests})")
    return f"count(*) FILTER (coalesce(CASE {' '.join(whens)} END, false)) AS {section}"


SQL_SECTIONS = f"SELECT language, {_labels('args')}, {_labels('returns')}, {_labels('raises')} FROM {COMPONENTS} WHERE language IN ('python', 'java', 'javascript', 'typescript') GROUP BY language"


def primary_language(spark, sf):
    by = files(spark, sf).withColumn("language", code.suffix_language("path")).filter("language IS NOT NULL").groupBy("repo", "language").agg(F.count("*").alias("n"))
    return quality.first_by(by, ["repo"], [F.desc("n"), F.asc("language")])


_LANG = "CASE WHEN path LIKE '%.py' THEN 'python' WHEN regexp_matches(path, '\\.jsx?$') THEN 'javascript' WHEN regexp_matches(path, '\\.tsx?$') THEN 'typescript' WHEN path LIKE '%.java' THEN 'java' END"
SQL_PRIMARY = f"""WITH b AS (SELECT repo, {_LANG} AS language, count(*) AS n FROM {FILES} WHERE {_LANG} IS NOT NULL GROUP BY 1, 2)
SELECT repo, language, n FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY n DESC, language) AS r FROM b) WHERE r = 1"""


def file_coverage(spark, sf):
    has = F.count_if(F.trim(F.coalesce("existing_docstring", F.lit(""))) != "")
    by = components(spark, sf).groupBy("repo", F.col("location.file_path").alias("file_path")).agg(F.count("*").alias("total"), has.alias("documented"))
    share = F.round(F.col("documented") / F.col("total") * 100, 1)
    return by.select("repo", "file_path", "total", "documented", share.alias("percent"), F.when(share >= 80, "good").when(share >= 40, "partial").otherwise("poor").alias("status"))


SQL_FILES = f"""WITH b AS (SELECT repo, location.file_path AS file_path, count(*) AS total, count(*) FILTER (trim(coalesce(existing_docstring, ''), ' ') <> '') AS documented FROM {COMPONENTS} GROUP BY 1, 2),
s AS (SELECT *, round(documented / total * 100, 1) AS percent FROM b)
SELECT repo, file_path, total, documented, percent, CASE WHEN percent >= 80 THEN 'good' WHEN percent >= 40 THEN 'partial' ELSE 'poor' END AS status FROM s"""


def top_missing(spark, sf):
    names = runs(spark, sf).select(F.explode("missing").alias("name"))
    return names.groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(10)


SQL_MISSING = f"SELECT name, count(*) AS n FROM (SELECT unnest(missing) AS name FROM {VALIDATION}) GROUP BY name ORDER BY n DESC, name LIMIT 10"


def field_coverage(spark, sf):
    return validation.field_coverage(components(spark, sf), "type", FIELDS)


def _populated(f: str) -> str:
    if f in ("decorators", "calls", "parameters", "depends_on"):
        return f"coalesce(len({f}), 0) > 0"
    return f"{f} IS NOT NULL" if f in ("complexity", "is_async") else f"coalesce({f}, '') <> ''"


SQL_FIELDS = " UNION ALL ".join(
    f"SELECT type, count(*) AS n, '{f}' AS field, count(*) FILTER ({_populated(f)}) AS populated, round(count(*) FILTER ({_populated(f)}) / count(*) * 100, 1) AS percent FROM {COMPONENTS} GROUP BY type" for f in FIELDS
)


def best_run(spark, sf):
    v = runs(spark, sf).filter("f1 IS NOT NULL")
    return quality.first_by(v, ["repo"], [F.desc("f1"), F.asc("validation_id")]).select("repo", "validation_id", "f1")


SQL_BEST = f"SELECT repo, validation_id, f1 FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY f1 DESC, validation_id) AS r FROM {VALIDATION} WHERE f1 IS NOT NULL) WHERE r = 1"


def overall_quality(spark, sf):
    a = components(spark, sf).agg(F.avg((F.trim(F.coalesce("existing_docstring", F.lit(""))) != "").cast("int")).alias("completeness"))
    b = replies(spark, sf).agg((F.avg("metrics.word_overlap") * 5).alias("helpfulness"))
    c = runs(spark, sf).agg(F.avg("precision").alias("truthfulness"))
    one = a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(c))  # one row each
    total = quality.overall_quality(F.col("completeness"), F.col("helpfulness"), F.col("truthfulness"))
    return one.select(*[F.round(x, 4).alias(x) for x in ("completeness", "helpfulness", "truthfulness")], total.alias("overall"))


SQL_OVERALL = f"""WITH t AS (SELECT (SELECT avg(CASE WHEN trim(coalesce(existing_docstring, ''), ' ') <> '' THEN 1.0 ELSE 0.0 END) FROM {COMPONENTS}) AS a, (SELECT avg(metrics.word_overlap) * 5 FROM {REPLIES}) AS b, (SELECT avg(precision) FROM {VALIDATION}) AS c)
SELECT round(a, 4) AS completeness, round(b, 4) AS helpfulness, round(c, 4) AS truthfulness, round(0.35 * a + 0.35 * b / 5 + 0.30 * c, 3) AS overall FROM t"""


def grade_histogram(spark, sf):
    v = runs(spark, sf).filter("f1 IS NOT NULL")
    return v.groupBy(code.letter_grade("f1").alias("grade"), code.evaluation_grade(F.col("f1") * 100).alias("mark")).agg(F.count("*").alias("n"))


SQL_GRADES = f"""SELECT CASE WHEN f1 >= .9 THEN 'A+' WHEN f1 >= .85 THEN 'A' WHEN f1 >= .8 THEN 'A-' WHEN f1 >= .75 THEN 'B+' WHEN f1 >= .7 THEN 'B' WHEN f1 >= .65 THEN 'B-' WHEN f1 >= .6 THEN 'C+' WHEN f1 >= .55 THEN 'C' WHEN f1 >= .5 THEN 'C-' WHEN f1 >= .4 THEN 'D' ELSE 'F' END AS grade,
CASE WHEN f1 * 100 >= 90 THEN 'A' WHEN f1 * 100 >= 80 THEN 'B' WHEN f1 * 100 >= 70 THEN 'C' WHEN f1 * 100 >= 60 THEN 'D' ELSE 'F' END AS mark, count(*) AS n FROM {VALIDATION} WHERE f1 IS NOT NULL GROUP BY 1, 2"""


def component_count_histogram(spark, sf):
    by = components(spark, sf).groupBy("file_id").agg(F.count("*").alias("k"))
    whole = files(spark, sf).select("file_id").join(by, "file_id", "left").select(F.coalesce("k", F.lit(0)).alias("k"))
    bucket = F.when(F.col("k") == 0, "0").when(F.col("k") == 1, "1").when(F.col("k") <= 3, "2-3").when(F.col("k") <= 5, "4-5").otherwise("6+")
    return whole.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("files"))


SQL_BUCKETS = f"""WITH k AS (SELECT f.file_id, count(c.id) AS k FROM {FILES} f LEFT JOIN {COMPONENTS} c ON f.file_id = c.file_id GROUP BY 1)
SELECT CASE WHEN k = 0 THEN '0' WHEN k = 1 THEN '1' WHEN k <= 3 THEN '2-3' WHEN k <= 5 THEN '4-5' ELSE '6+' END AS bucket, count(*) AS files FROM k GROUP BY 1"""


def writer_scores(spark, sf):
    r = replies(spark, sf).filter("metrics.word_overlap IS NOT NULL AND metrics.bleu1 IS NOT NULL")
    return r.groupBy("writer").agg(F.count("*").alias("n"), F.round(F.avg("metrics.word_overlap"), 9).alias("overlap"), F.round(F.avg("metrics.bleu1"), 9).alias("bleu1"), F.round(F.avg("elapsed_sec"), 9).alias("elapsed"), F.round(F.avg(F.col("success").cast("int")), 9).alias("success_rate"))


SQL_WRITERS = f"""SELECT writer, count(*) AS n, round(avg(metrics.word_overlap), 9) AS overlap, round(avg(metrics.bleu1), 9) AS bleu1, round(avg(elapsed_sec), 9) AS elapsed, round(avg(CAST(success AS INT)), 9) AS success_rate
FROM {REPLIES} WHERE metrics.word_overlap IS NOT NULL AND metrics.bleu1 IS NOT NULL GROUP BY writer"""


def reply_cost(spark, sf):
    from oresieve.operators.models import call_cost

    r = replies(spark, sf).select("writer", (F.length(F.coalesce("prompt", F.lit(""))) / 4).alias("p"), (F.length(F.coalesce("raw_llm_response", F.lit(""))) / 4).alias("c"))
    cost = call_cost("writer", "p", "c", {"writer_base": (0.0005, 0.0015), "writer_refined": (0.003, 0.006)})
    return r.groupBy("writer").agg(F.count("*").alias("calls"), F.round(F.sum(F.col("p") + F.col("c")), 2).alias("tokens"), F.round(F.sum(cost), 4).alias("cost"))


SQL_COST = f"""WITH r AS (SELECT writer, length(coalesce(prompt, '')) / 4 AS p, length(coalesce(raw_llm_response, '')) / 4 AS c FROM {REPLIES})
SELECT writer, count(*) AS calls, round(sum(p + c), 2) AS tokens, round(sum(p / 1000 * CASE writer WHEN 'writer_base' THEN 0.0005 WHEN 'writer_refined' THEN 0.003 ELSE 0.001 END + c / 1000 * CASE writer WHEN 'writer_base' THEN 0.0015 WHEN 'writer_refined' THEN 0.006 ELSE 0.002 END), 4) AS cost FROM r GROUP BY writer"""


def precision_recall(spark, sf):
    low = F.lower(F.trim("language"))
    lang = F.when(low.isin("py", "python"), "python").when(low.isin("js", "javascript"), "javascript").otherwise(low)
    v = runs(spark, sf).withColumn("language", lang).filter("language IS NOT NULL")
    ratio = validation.ratios(F.col("matched_components"), F.col("total_ir_components"), F.col("total_gold_components"))
    return validation.by_language(v.select("language", *[x.alias(k) for k, x in ratio.items()]))


SQL_PRF = f"""WITH v AS (SELECT CASE WHEN lower(trim(language)) IN ('py', 'python') THEN 'python' WHEN lower(trim(language)) IN ('js', 'javascript') THEN 'javascript' ELSE lower(trim(language)) END AS language, matched_components AS m, total_ir_components AS f, total_gold_components AS g FROM {VALIDATION} WHERE language IS NOT NULL),
r AS (SELECT language, CASE WHEN f = 0 THEN 0.0 ELSE m / f END AS p, CASE WHEN g = 0 THEN 0.0 ELSE m / g END AS r FROM v)
SELECT language, count(*) AS files, round(avg(p), 4) AS precision, round(avg(r), 4) AS recall, round(avg(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END), 4) AS f1 FROM r GROUP BY language"""


def overall_f1(spark, sf):
    return validation.overall_f1(precision_recall(spark, sf))


SQL_F1 = f"SELECT round(sum(f1 * files) / sum(files), 4) AS overall_f1 FROM ({SQL_PRF})"


def field_accuracy_means(spark, sf):
    return runs(spark, sf).select(F.explode("field_accuracy").alias("field", "accuracy")).groupBy("field").agg(F.count("*").alias("runs"), F.round(F.avg("accuracy"), 3).alias("accuracy"))


SQL_ACCURACY = f"SELECT field, count(*) AS runs, round(avg(accuracy), 3) AS accuracy FROM (SELECT unnest(map_entries(field_accuracy)).key AS field, unnest(map_entries(field_accuracy)).value AS accuracy FROM {VALIDATION}) GROUP BY field"


def files_and_lines(spark, sf):
    f = files(spark, sf).withColumn("language", F.coalesce(code.suffix_language("path"), F.lit("other")))
    return f.groupBy("language").agg(F.count("*").alias("files"), F.sum(F.size(F.split(F.coalesce("value", F.lit("")), "\n"))).alias("lines"))


SQL_LINES = f"SELECT coalesce({_LANG}, 'other') AS language, count(*) AS files, CAST(sum(len(string_split(coalesce(value, ''), chr(10)))) AS BIGINT) AS lines FROM {FILES} GROUP BY 1"


def latest_records(spark, sf):
    r = replies(spark, sf).filter("component_id IS NOT NULL")
    return quality.first_by(r, ["component_id"], [F.desc("created_at"), F.desc("record_id")]).select("component_id", "record_id", "writer")


SQL_LATEST = f"SELECT component_id, record_id, writer FROM (SELECT *, row_number() OVER (PARTITION BY component_id ORDER BY created_at DESC, record_id DESC) AS r FROM {REPLIES} WHERE component_id IS NOT NULL) WHERE r = 1"


def helpfulness_rollup(spark, sf):
    r = replies(spark, sf).filter("metrics.word_overlap IS NOT NULL").select("writer", "component_type", (1 + F.floor(F.col("metrics.word_overlap") * 4.999)).alias("score"))
    scores = r.select(F.col("writer").alias("language"), F.lit("summary").alias("aspect"), F.col("component_type").alias("type"), "score")
    return quality.helpfulness_rollup(scores)


SQL_HELP = f"""WITH s AS (SELECT writer AS language, 'summary' AS aspect, component_type AS type, CAST(1 + floor(metrics.word_overlap * 4.999) AS BIGINT) AS score FROM {REPLIES} WHERE metrics.word_overlap IS NOT NULL)
SELECT language, aspect, type, count(*) AS scores, round(avg(score), 6) AS average, min(score) AS least, max(score) AS greatest FROM s GROUP BY GROUPING SETS ((language), (aspect), (type), ())"""


def helpfulness_candidates(spark, sf):
    c = components(spark, sf)
    return quality.helpfulness_candidates(c, None).groupBy("language").agg(F.count("*").alias("candidates"))


SQL_CANDIDATES = f"SELECT language, count(*) AS candidates FROM {COMPONENTS} WHERE trim(coalesce(existing_docstring, ''), ' ') <> '' AND coalesce(is_public, NOT (starts_with(name, '_') OR starts_with(name, '#'))) GROUP BY language"

QUERIES = {
    "component_stats": (component_stats, SQL_STATS), "parse_status": (parse_status, SQL_PARSE), "kind_histogram": (kind_histogram, SQL_KINDS), "coverage_rollup": (coverage_rollup, SQL_COVERAGE),
    "completeness_scores": (completeness_scores, None), "completeness_rollup": (completeness_rollup, None), "completeness_criteria": (completeness_criteria, None), "section_labels": (section_labels, SQL_SECTIONS),
    "primary_language": (primary_language, SQL_PRIMARY), "file_coverage": (file_coverage, SQL_FILES), "top_missing": (top_missing, SQL_MISSING), "field_coverage": (field_coverage, SQL_FIELDS), "best_run": (best_run, SQL_BEST),
    "overall_quality": (overall_quality, SQL_OVERALL), "grade_histogram": (grade_histogram, SQL_GRADES), "component_count_histogram": (component_count_histogram, SQL_BUCKETS), "writer_scores": (writer_scores, SQL_WRITERS),
    "reply_cost": (reply_cost, SQL_COST), "precision_recall": (precision_recall, SQL_PRF), "overall_f1": (overall_f1, SQL_F1), "field_accuracy_means": (field_accuracy_means, SQL_ACCURACY), "files_and_lines": (files_and_lines, SQL_LINES),
    "latest_records": (latest_records, SQL_LATEST), "helpfulness_rollup": (helpfulness_rollup, SQL_HELP), "helpfulness_candidates": (helpfulness_candidates, SQL_CANDIDATES),
}
