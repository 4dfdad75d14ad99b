"""Quality of documentation: completeness by required sections, truthfulness of mentioned names, aggregates of scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oresieve.functions import code, text
from oresieve.functions.text import bound, col

# The labels by which a docstring shows a section, types that return nothing, and the words that return and raise.
LABELS = {
    "python": {
        "args": ["args:", "arguments:", "parameters:", "params:"],
        "returns": ["returns:", "return:", "yields:", "yield:"],
        "raises": ["raises:", "exceptions:", "throws:"],
        "examples": ["example:", "examples:", "usage:", "usage example:", "usage examples:"],
        "attributes": ["attributes:", "members:", "member variables:", "instance variables:", "properties:"],
    },
    "java": {"args": ["@param"], "returns": ["@return"], "raises": ["@throws", "@exception"], "examples": ["example:", "examples:", "usage:", "@example"], "attributes": []},
    "javascript": {
        "args": ["@param"],
        "returns": ["@returns", "@return"],
        "raises": ["@throws"],
        "examples": ["@example", "example:", "examples:", "usage:"],
        "attributes": ["@property", "@prop", "properties:", "property:", "attributes:", "members:"],
    },
    "typescript": {
        "args": ["@param"],
        "returns": ["@returns", "@return"],
        "raises": ["@throws"],
        "examples": ["@example", "example:", "examples:"],
        "attributes": ["@property", "@prop", "properties:", "property:", "attributes:", "members:"],
    },
}
NOTHING = {"python": ["None", ""], "java": ["void"], "javascript": ["void", "undefined"], "typescript": ["void", "undefined", "never"]}
RAISES = {"python": r"\braise\b", "java": r"\bthrow\b", "javascript": r"\bthrow\b", "typescript": r"\bthrow\b"}
SECTIONS = ("summary", "description", "args", "returns", "raises", "examples", "attributes")
SKIPPED = ("global_variable", "variable", "constant")


def _by_language(language: Column, choose) -> Column:
    out = None
    for name in LABELS:
        out = F.when(language == name, choose(name)) if out is None else out.when(language == name, choose(name))
    return out


def has_summary(doc) -> Column:
    """Any line that holds more than comment marks."""
    return F.exists(F.split(F.coalesce(col(doc), F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"[*\s]", "")) != "")


def has_description(doc, language) -> Column:
    """For Python a second paragraph that is no section, else a second line that is no tag."""
    raw = F.coalesce(col(doc), F.lit(""))
    chunks = F.transform(F.split(F.trim(raw), r"\n\s*\n"), lambda x: F.trim(x))
    second = F.lower(F.coalesce(F.try_element_at(F.filter(chunks, lambda x: x != ""), F.lit(2)), F.lit("")))
    headings = [label for labels in LABELS["python"].values() for label in labels]
    python = bound(second, lambda x: (x != "") & ~F.exists(F.array(*[F.lit(h) for h in headings]), lambda h: F.startswith(x, h)))
    lines = F.filter(F.transform(F.split(raw, "\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^[/*]+|\*/$", ""))), lambda x: x != "")
    line = F.coalesce(F.try_element_at(lines, F.lit(2)), F.lit(""))
    return F.when(col(language) == "python", python).otherwise((line != "") & ~line.startswith("@"))


def has_section(section: str, doc, language) -> Column:
    if section == "summary":
        return has_summary(doc)
    if section == "description":
        return has_description(doc, language)
    low = F.lower(F.coalesce(col(doc), F.lit("")))

    def some(name):
        labels = LABELS[name][section]
        out = F.lit(False)
        for label in labels:
            out = out | F.contains(low, F.lit(label))
        return out

    return F.coalesce(_by_language(col(language), some), F.lit(False))


def required_sections() -> Column:
    """The sections that a component must have, by kind, parameters, result, exceptions, attributes, visibility and triviality.

    A null result type counts as returning nothing.
    """
    kind, lang = F.col("type"), F.col("language")
    func, klass, init = kind.isin("function", "method"), kind == "class", kind == "constructor"
    public = code.is_public("is_public", "name")
    small = code.trivial_component("source_code", "language")
    nothing = F.col("return_type").isNull() | F.coalesce(_by_language(lang, lambda x: F.col("return_type").isin(*NOTHING[x])), F.lit(False))
    raises = F.coalesce(_by_language(lang, lambda x: F.coalesce(F.col("source_code"), F.lit("")).rlike(RAISES[x])), F.lit(False)) | ((lang == "java") & (F.coalesce(F.col("metadata")["throws"], F.lit("")) != ""))
    need = {
        "summary": F.lit(True),
        "description": (func | klass) & public & ~small & ((F.coalesce(F.col("lines_of_code"), F.lit(0)) > 10) | klass),
        "args": (func | init) & (code.n("parameters") > 0),
        "returns": func & ~nothing,
        "raises": (func | init) & raises,
        "examples": (klass & public & ~small) & (code.n("methods") > 3),
        "attributes": klass & (code.n("attributes") > 0),
    }
    return F.array_compact(F.array(*[F.when(F.coalesce(v, F.lit(False)), F.lit(k)) for k, v in need.items()]))


def completeness(components: DataFrame, doc: str = "existing_docstring") -> DataFrame:
    """(id, language, type, required, present, score): score is the share of required sections, 0 without docstring or for other languages.

    Variables and constants are left out.
    """
    some = components.filter(~F.col("type").isin(*SKIPPED))
    flags = F.create_map(*[x for s in SECTIONS for x in (F.lit(s), has_section(s, doc, "language"))])
    none = (F.trim(F.coalesce(F.col(doc), F.lit(""))) == "") | ~F.col("language").isin(*LABELS)
    rows = some.select("id", "language", "type", required_sections().alias("required"), flags.alias("present"), none.alias("none"))
    hits = F.size(F.filter("required", lambda s: F.col("present")[s]))
    return rows.select("id", "language", "type", "required", "present", F.when(F.col("none"), 0.0).otherwise(F.round(hits / F.size("required"), 3)).alias("score"))


def score_rollup(scores: DataFrame, *keys: str, score: str = "score") -> DataFrame:
    """Count, mean, share documented over all rows and by each key on its own (grouping sets)."""
    sets = [[F.col(k)] for k in keys] + [[]]
    grouped = scores.groupingSets(sets, *[F.col(k) for k in keys])
    return grouped.agg(F.count("*").alias("components"), F.round(F.avg(score), 3).alias("average"), F.count_if(F.col(score) > 0).alias("documented"), F.count_if(F.col(score) == 0).alias("undocumented"))


def criteria_shares(scores: DataFrame) -> DataFrame:
    """Share of components that have each section."""
    return scores.agg(*[F.round(F.avg(F.col("present")[s].cast("int")), 4).alias(s) for s in SECTIONS])


def truthfulness(docs: DataFrame, names: DataFrame, key: str = "id", mentions: str = "mentions") -> DataFrame:
    """(key, mentioned, existing, cross_file, existence_ratio, hallucination_rate) of each document.

    docs: key, file_path, mentions. names: (name, file_path) of known components. A mention exists if a name equals it but for case.
    Without mentions the ratio is 1. Names are joined by equality on what occurs in mentions, so nothing is compared pairwise.
    """
    said = docs.select(F.col(key), "file_path", F.explode(mentions).alias("mention")).distinct()
    # one row a name: its first file, and whether it has several
    known = names.groupBy(F.lower("name").alias("low")).agg(F.min("file_path").alias("first_file"), F.max("file_path").alias("last_file"))
    hit = said.join(known, F.lower("mention") == F.col("low"), "left")
    cross = F.col("low").isNotNull() & (F.col("first_file") == F.col("last_file")) & (F.col("first_file") != F.col("file_path"))
    by = hit.groupBy(key).agg(F.count("*").alias("mentioned"), F.count("low").alias("existing"), F.count_if(cross).alias("cross_file"))
    all_docs = docs.select(key).distinct().join(by, key, "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("mentioned", "existing", "cross_file")]
    ratio = F.coalesce(F.round(F.col("existing") / F.col("mentioned"), 4), F.lit(1.0))
    return all_docs.select(key, *counts, ratio.alias("existence_ratio"), F.round(1 - ratio, 4).alias("hallucination_rate"))


def hallucinated(docs: DataFrame, names: DataFrame, key: str = "id", mentions: str = "mentions") -> DataFrame:
    """(key, mention) of each mention that no component has as its name."""
    said = docs.select(F.col(key), F.explode(mentions).alias("mention")).distinct()
    known = names.select(F.lower("name").alias("low")).distinct()
    return said.join(known, F.lower("mention") == F.col("low"), "left_anti")


def overall_quality(completeness_score: Column, helpfulness: Column, truth: Column) -> Column:
    """0.35, 0.35 (of five) and 0.30 of the three scores."""
    return F.round(0.35 * completeness_score + 0.35 * helpfulness / 5 + 0.30 * truth, 3)


def helpfulness_rollup(scores: DataFrame) -> DataFrame:
    """Mean, least and greatest score overall, by language, by aspect and by type; scores: (language, aspect, type, score)."""
    keys = ["language", "aspect", "type"]
    return scores.groupingSets([[F.col(k)] for k in keys] + [[]], *[F.col(k) for k in keys]).agg(
        F.count("*").alias("scores"), F.round(F.avg("score"), 6).alias("average"), F.min("score").alias("least"), F.max("score").alias("greatest")
    )


def helpfulness_candidates(components: DataFrame, most: int | None, doc: str = "existing_docstring") -> DataFrame:
    """Public components with documentation, the first in scan order if a number is given."""
    some = components.filter((F.trim(F.coalesce(F.col(doc), F.lit(""))) != "") & code.is_public("is_public", "name"))
    return some if most is None else some.orderBy("scan_ord", "id").limit(most)


def documentation_scorecard(docs: DataFrame, reference: str, generated: str) -> DataFrame:
    """One row of coverage, mean overlap, mean clipped precision, tag share and throws precision of generated documentation."""
    a, b = text.word_tokens(text.clean_comment(reference)), text.word_tokens(text.clean_comment(generated))
    rows = docs.select(
        (F.trim(F.coalesce(F.col(generated), F.lit(""))) != "").alias("has"),
        text.jaccard(a, b).alias("overlap"),
        text.clipped_bleu1(a, b).alias("bleu1"),
        (F.size(text.tags(generated)) > 0).alias("tagged"),
        F.contains(F.coalesce(F.col(generated), F.lit("")), F.lit("@throws")).alias("throws"),
        F.coalesce(F.col("metrics.throws_in_code"), F.lit(False)).alias("throws_in_code"),
    )
    return rows.agg(
        F.count("*").alias("samples"),
        F.round(F.avg(F.col("has").cast("int")), 4).alias("coverage"),
        F.round(F.avg("overlap"), 4).alias("mean_overlap"),
        F.round(F.avg("bleu1"), 4).alias("mean_bleu1"),
        F.round(F.avg(F.col("tagged").cast("int")), 4).alias("tag_coverage"),
        F.round(code.guarded(F.count_if(F.col("throws") & F.col("throws_in_code")), F.count_if(F.col("throws"))), 4).alias("throws_precision"),
    )


def recommendations(metrics: DataFrame, rules: list[tuple[str, str, float, str]]) -> DataFrame:
    """metrics with an array of messages: rules are (column, '>' or '<', bound, message)."""
    said = [F.when((F.col(c) > b) if op == ">" else (F.col(c) < b), F.lit(m)) for c, op, b, m in rules]
    return metrics.withColumn("recommendations", F.array_compact(F.array(*said)))


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group by a total order."""
    return df.withColumn("__at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__at = 1").drop("__at")
