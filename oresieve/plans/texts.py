"""Text measures, parsers of replies and facts about sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from oresieve.functions import code, text
from oresieve.operators import quality
from oresieve.plans.tables import COMPONENTS, REPLIES, components, replies, table

_TOK = "list_filter(string_split_regex(lower(coalesce({0}, '')), '\\s+'), lambda t: t <> '')"
_WORD = "list_transform(regexp_extract_all(coalesce({0}, ''), '([A-Za-z_]\\w*)', 1), lambda t: lower(t))"
_A, _B = _TOK.format("original_comment"), _TOK.format("generated_docstring")
_C, _D = _WORD.format("original_comment"), _WORD.format("generated_docstring")
_JACCARD = "CASE WHEN len(list_distinct({0})) = 0 AND len(list_distinct({1})) = 0 THEN 1.0 WHEN len(list_distinct({0})) = 0 OR len(list_distinct({1})) = 0 THEN 0.0 ELSE len(list_intersect(list_distinct({0}), list_distinct({1}))) / len(list_distinct(list_concat({0}, {1}))) END"


def jaccard(spark, sf):
    r = replies(spark, sf)
    return r.select("record_id", F.round(text.jaccard(text.blank_tokens("original_comment"), text.blank_tokens("generated_docstring")), 6).alias("plain"), F.round(text.jaccard(text.word_tokens("original_comment"), text.word_tokens("generated_docstring")), 6).alias("words"))


SQL_JACCARD = f"WITH t AS (SELECT record_id, {_A} AS a, {_B} AS b, {_C} AS c, {_D} AS d FROM {REPLIES}) SELECT record_id, round({_JACCARD.format('a', 'b')}, 6) AS plain, round({_JACCARD.format('c', 'd')}, 6) AS words FROM t"


def bleu1(spark, sf):
    r = replies(spark, sf)
    a, b = text.blank_tokens("original_comment"), text.blank_tokens("generated_docstring")
    c, d = text.word_tokens("original_comment"), text.word_tokens("generated_docstring")
    return r.select("record_id", F.round(text.unigram_precision(a, b), 6).alias("plain"), F.round(text.clipped_bleu1(c, d), 6).alias("clipped"))


SQL_BLEU = f"""WITH t AS (SELECT record_id, {_A} AS a, {_B} AS b, {_C} AS c, {_D} AS d FROM {REPLIES})
SELECT record_id, round(CASE WHEN len(b) = 0 THEN 0.0 ELSE len(list_filter(b, lambda x: list_contains(a, x))) / len(b) END, 6) AS plain,
 round(CASE WHEN len(c) = 0 OR len(d) = 0 THEN 0.0 ELSE list_sum(list_transform(list_distinct(d), lambda x: least(len(list_filter(c, lambda y: y = x)), len(list_filter(d, lambda y: y = x))))) / len(d) * least(1.0, exp(1 - len(c) / len(d))) END, 6) AS clipped FROM t"""


def tag_counts(spark, sf):
    return replies(spark, sf).select("writer", F.explode(text.tags("generated_docstring")).alias("tag")).groupBy("writer", "tag").agg(F.count("*").alias("n"))


SQL_TAGS = f"SELECT writer, tag, count(*) AS n FROM (SELECT writer, unnest(list_distinct(regexp_extract_all(coalesce(generated_docstring, ''), '@(\\w+)', 1))) AS tag FROM {REPLIES}) GROUP BY 1, 2"


def low_value_summaries(spark, sf):
    r = replies(spark, sf).select("writer", text.low_value_summary(text.summary_line("generated_docstring")).alias("low"))
    return r.groupBy("writer").agg(F.count("*").alias("n"), F.count_if("low").alias("low"))


def mentions(spark, sf):
    said = replies(spark, sf).select("record_id", F.explode(text.backtick_mentions("prompt")).alias("mention"))
    return said.distinct()


_STOP = ", ".join(f"'{w}'" for w in text.COMMON_WORDS)
SQL_MENTIONS = f"""SELECT DISTINCT record_id, mention FROM (SELECT record_id, unnest(regexp_extract_all(coalesce(prompt, ''), '`([a-zA-Z_][a-zA-Z0-9_]*)`', 1)) AS mention FROM {REPLIES})
WHERE lower(mention) NOT IN ({_STOP}) AND length(mention) > 2"""


def truthfulness(spark, sf):
    r = replies(spark, sf).select(F.col("record_id").alias("id"), F.lit("").alias("file_path"), text.backtick_mentions("prompt").alias("mentions"))
    names = components(spark, sf).select("name", F.col("location.file_path").alias("file_path"))
    return quality.truthfulness(r, names).select("id", "mentioned", "existing", "existence_ratio", "hallucination_rate")


SQL_TRUTH = f"""WITH m AS ({SQL_MENTIONS}), k AS (SELECT DISTINCT lower(name) AS low FROM {COMPONENTS}),
b AS (SELECT record_id, count(*) AS mentioned, count(low) AS existing FROM m LEFT JOIN k ON lower(mention) = low GROUP BY 1)
SELECT r.record_id AS id, coalesce(mentioned, 0) AS mentioned, coalesce(existing, 0) AS existing, coalesce(round(existing / mentioned, 4), 1.0) AS existence_ratio, round(1 - coalesce(round(existing / mentioned, 4), 1.0), 4) AS hallucination_rate
FROM (SELECT DISTINCT record_id FROM {REPLIES}) r LEFT JOIN b ON r.record_id = b.record_id"""


def hallucinated_names(spark, sf):
    r = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), text.backtick_mentions("text").alias("mentions"))
    return quality.hallucinated(r, components(spark, sf)).groupBy("mention").agg(F.count("*").alias("n"))


SQL_HALL = f"""WITH m AS (SELECT DISTINCT doc_id, mention FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '`([a-zA-Z_][a-zA-Z0-9_]*)`', 1)) AS mention FROM documents) WHERE lower(mention) NOT IN ({_STOP}) AND length(mention) > 2)
SELECT mention, count(*) AS n FROM m WHERE lower(mention) NOT IN (SELECT lower(name) FROM {COMPONENTS}) GROUP BY mention"""


def docs_scorecard(spark, sf):
    return quality.documentation_scorecard(replies(spark, sf), "original_comment", "generated_docstring")


def visibility(spark, sf):
    return components(spark, sf).groupBy(code.visibility("name").alias("visibility")).agg(F.count("*").alias("n"))


SQL_VISIBILITY = f"SELECT CASE WHEN regexp_matches(name, '^__.*__$') THEN 'public' WHEN starts_with(name, '__') THEN 'private' WHEN starts_with(name, '_') THEN 'protected' ELSE 'public' END AS visibility, count(*) AS n FROM {COMPONENTS} GROUP BY 1"


def complexity_tiers(spark, sf):
    tier = code.complexity_tier("lines_of_code", "complexity", "parameters", "depends_on", "is_async", "is_generator", "is_abstract")
    c = components(spark, sf).select("type", tier.alias("tier"))
    return c.groupBy("type", "tier", code.documentation_category("type", F.col("tier")).alias("category")).agg(F.count("*").alias("n"))


def _pts(e: str, *bounds: int) -> str:
    return "CASE " + " ".join(f"WHEN {e} <= {b} THEN {i}" for i, b in enumerate(bounds)) + f" ELSE {len(bounds)} END"


SQL_TIERS = f"""WITH p AS (SELECT type, {_pts('coalesce(lines_of_code, 0)', 5, 15, 40)} + {_pts('coalesce(complexity, 0)', 2, 5, 10)} + {_pts('coalesce(len(parameters), 0)', 1, 3)} + {_pts('coalesce(len(depends_on), 0)', 0, 3)}
 + coalesce(CAST(is_async AS INT), 0) + coalesce(CAST(is_generator AS INT), 0) + coalesce(CAST(is_abstract AS INT), 0) AS pts FROM {COMPONENTS}),
t AS (SELECT type, CASE WHEN pts <= 2 THEN 'trivial' WHEN pts <= 5 THEN 'simple' WHEN pts <= 8 THEN 'moderate' ELSE 'complex' END AS tier FROM p)
SELECT type, tier, CASE WHEN type IN ('variable', 'global_variable', 'static_field', 'field', 'import') THEN 'minimal' WHEN type = 'module' THEN 'detailed' WHEN type = 'api_endpoint' THEN 'comprehensive'
 WHEN type = 'class' THEN CASE WHEN tier IN ('moderate', 'complex') THEN 'comprehensive' ELSE 'detailed' END WHEN type = 'constructor' THEN CASE WHEN tier = 'complex' THEN 'comprehensive' ELSE 'detailed' END
 ELSE CASE tier WHEN 'trivial' THEN 'minimal' WHEN 'simple' THEN 'standard' WHEN 'moderate' THEN 'detailed' ELSE 'comprehensive' END END AS category, count(*) AS n FROM t GROUP BY 1, 2, 3"""


def reader_levels(spark, sf):
    c = components(spark, sf).select("language", code.cognitive("complexity").alias("cog"), code.nesting_depth("source_code").alias("nest"), code.coupling("depends_on", "parameters").alias("coup"))
    return c.groupBy("language", code.complexity_level(F.col("cog"), F.col("nest"), F.col("coup")).alias("level")).agg(F.count("*").alias("n"), F.round(F.avg("coup"), 3).alias("coupling"), F.max("nest").alias("deepest"))


_DEPTH = "list_max(list_transform(list_filter(string_split(coalesce(source_code, ''), chr(10)), lambda x: trim(x, ' ') <> ''), lambda x: CASE WHEN contains(regexp_extract(x, '^(\\s*)', 1), chr(9)) THEN length(regexp_extract(x, '^(\\s*)', 1)) - length(replace(regexp_extract(x, '^(\\s*)', 1), chr(9), '')) ELSE length(regexp_extract(x, '^(\\s*)', 1)) // 4 END))"
SQL_LEVELS = f"""WITH r AS (SELECT language, least(greatest(coalesce(complexity, 1), 1) * 1.5, 100.0) AS cog, coalesce({_DEPTH}, 0) AS raw, least(least(coalesce(len(depends_on), 0), 10) * 1.2 + least(coalesce(len(parameters), 0), 8) * 0.8, 20.0) AS coup FROM {COMPONENTS}),
d AS (SELECT language, cog, coup, CAST(CASE WHEN raw > 6 THEN floor(pow(raw, 0.7) * 2) ELSE raw END AS INT) AS nest FROM r)
SELECT language, CASE WHEN cog * 0.5 + nest * 2.0 + coup * 0.3 <= 5 THEN 'simple' WHEN cog * 0.5 + nest * 2.0 + coup * 0.3 <= 15 THEN 'moderate' ELSE 'complex' END AS level, count(*) AS n, round(avg(coup), 3) AS coupling, max(nest) AS deepest FROM d GROUP BY 1, 2"""


def static_hints(spark, sf):
    hints = code.static_hints("source_code", "language")
    return components(spark, sf).groupBy("language").agg(*[F.count_if(v).alias(k) for k, v in hints.items()])


_S = "coalesce(source_code, '')"
_JS = "language IN ('javascript', 'typescript')"
_H = {
    "detects_throw": f"CASE WHEN language = 'python' THEN regexp_matches({_S}, '(^|[^.\\w])raise\\s+') WHEN {_JS} OR language = 'java' THEN regexp_matches({_S}, '(^|[^.\\w])throw\\s+') ELSE regexp_matches({_S}, '(^|[^.\\w])(throw|raise)\\s+') END",
    "uses_instanceof": f"regexp_matches({_S}, '\\binstanceof\\b')", "modifies_prototype": f"regexp_matches({_S}, '\\.prototype\\b|\\bObject\\.create\\s*\\(')",
    "is_exported": f"{_JS} AND regexp_matches({_S}, '\\bmodule\\.exports\\b|\\bexports\\.|\\bexport\\s+')", "uses_await": f"regexp_matches({_S}, '\\bawait\\s+')",
    "accepts_callback": f"{_JS} AND regexp_matches({_S}, '\\bcallback\\b|\\bcb\\b|\\bfn\\b')", "detects_switch_dispatch": f"{_JS} AND regexp_matches({_S}, '\\bswitch\\s*\\(')",
    "detects_validation": f"regexp_matches({_S}, '\\bvalidate\\w*\\s*\\(')", "detects_logging": f"regexp_matches({_S}, '\\blog\\w*\\s*\\(')",
}
SQL_HINTS = f"SELECT language, {', '.join(f'count(*) FILTER ({v}) AS {k}' for k, v in _H.items())} FROM {COMPONENTS} GROUP BY language"


def trivial_rows(spark, sf):
    c = components(spark, sf).filter(F.col("type").isin("function", "method", "constructor"))
    return c.groupBy("language").agg(F.count("*").alias("n"), F.count_if(code.trivial_function("source_code")).alias("trivial"), F.count_if(code.trivial_component("source_code", "language")).alias("trivial_component"))


def stable_ids(spark, sf):
    return components(spark, sf).select("id", text.stable_id("func", "repo", "name", "type").alias("stable_id"))


SQL_IDS = f"SELECT id, concat('func_', substr(md5(concat_ws(':', repo, name, type)), 1, 8)) AS stable_id FROM {COMPONENTS}"


def repo_names(spark, sf):
    libs = table(spark, sf, "third_party_libs")
    return libs.select("lib_name", text.repo_name(F.concat(F.coalesce("homepage", F.lit("")), F.lit("x y.git/"))).alias("name"))


SQL_REPO = "SELECT lib_name, regexp_replace(regexp_extract(regexp_replace(regexp_replace(concat(coalesce(homepage, ''), 'x y.git/'), '/+$', ''), '\\.git$', ''), '([^/:]+)$', 1), '[^\\w-]', '_', 'g') AS name FROM third_party_libs"


def shortened_sources(spark, sf):
    return components(spark, sf).select("id", code.shortened("source_code", 200).alias("source"), (F.trim(F.coalesce("existing_docstring", F.lit(""))) != "").alias("has_docstring"))


SQL_SHORT = f"SELECT id, CASE WHEN length({_S}) > 200 THEN concat(substr({_S}, 1, 200), '...') ELSE {_S} END AS source, trim(coalesce(existing_docstring, ''), ' ') <> '' AS has_docstring FROM {COMPONENTS}"


def reply_scores(spark, sf):
    r = replies(spark, sf).select(F.concat(F.lit("Score: "), F.pmod(F.col("record_id"), F.lit(7)).cast("string"), F.lit(" of five, level 2")).alias("reply"))
    return r.groupBy(text.reply_score("reply").alias("score")).agg(F.count("*").alias("n"))


SQL_SCORES = f"SELECT CAST(CASE WHEN record_id % 7 BETWEEN 1 AND 5 THEN record_id % 7 ELSE 2 END AS INT) AS score, count(*) AS n FROM {REPLIES} GROUP BY 1"


def extracted_docstrings(spark, sf):
    return replies(spark, sf).select("record_id", F.length(F.coalesce(text.tag_text("raw_llm_response", "DOCSTRING"), F.lit(""))).alias("length"))


SQL_DOCSTRINGS = f"SELECT record_id, CAST(length(trim(regexp_extract(coalesce(raw_llm_response, ''), '(?is)<DOCSTRING>(.*?)</DOCSTRING>', 1), ' ')) AS INT) AS length FROM {REPLIES}"


def signatures(spark, sf):
    c = components(spark, sf).filter("language = 'python' AND type IN ('function', 'method')")
    return c.select("id", code.built_signature("name", "parameters", "return_type", "is_async").alias("signature"))


def thresholds(spark, sf):
    # comparisons of a parameter's field stand for those of an own attribute, which the table lacks
    own = F.regexp_replace("source_code", r"\b[a-z]+\.(\w+) > (\d)", "self.$1 > $2")
    found = components(spark, sf).select("id", code.threshold(own).alias("t")).filter("t IS NOT NULL")
    return found.select("id", code.threshold_summary(F.col("t")).alias("summary"))


_OWN = f"regexp_replace({_S}, '\\b[a-z]+\\.(\\w+) > (\\d)', 'self.\\1 > \\2', 'g')"
_CMP = "'\\bself\\.(\\w+)\\s*(>=|<=|==|!=|>|<)\\s*(\\d+)\\b'"
SQL_THRESHOLD = f"""WITH t AS (SELECT id, regexp_extract({_OWN}, {_CMP}, 1) AS a, regexp_extract({_OWN}, {_CMP}, 2) AS o, regexp_extract({_OWN}, {_CMP}, 3) AS v FROM {COMPONENTS})
SELECT id, concat('Reports whether the stored ', a, ' is ', CASE o WHEN '>=' THEN 'at least' WHEN '>' THEN 'greater than' WHEN '<=' THEN 'at most' WHEN '<' THEN 'less than' WHEN '==' THEN 'equal to' ELSE 'different from' END, ' ', v, '.') AS summary FROM t WHERE o <> ''"""

QUERIES = {
    "jaccard": (jaccard, SQL_JACCARD), "bleu1": (bleu1, SQL_BLEU), "tag_counts": (tag_counts, SQL_TAGS), "low_value_summaries": (low_value_summaries, None), "mention_extract": (mentions, SQL_MENTIONS), "truthfulness_ratio": (truthfulness, SQL_TRUTH),
    "hallucinated_names": (hallucinated_names, SQL_HALL), "docs_scorecard": (docs_scorecard, None), "visibility": (visibility, SQL_VISIBILITY), "complexity_tiers": (complexity_tiers, SQL_TIERS), "reader_levels": (reader_levels, SQL_LEVELS),
    "static_hints": (static_hints, SQL_HINTS), "trivial_rows": (trivial_rows, None), "stable_ids": (stable_ids, SQL_IDS), "repo_names": (repo_names, SQL_REPO), "shortened_sources": (shortened_sources, SQL_SHORT), "reply_scores": (reply_scores, SQL_SCORES),
    "extracted_docstrings": (extracted_docstrings, SQL_DOCSTRINGS), "built_signatures": (signatures, None), "threshold_summaries": (thresholds, SQL_THRESHOLD),
}
