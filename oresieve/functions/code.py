"""Scores and classes of code components as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from oresieve.functions.text import col


def n(array) -> Column:
    """Size of an array, 0 for null."""
    return F.when(col(array).isNull(), 0).otherwise(F.size(col(array)))


def source_lines(source) -> Column:
    return F.split(F.coalesce(col(source), F.lit("")), "\n")


def visibility(name) -> Column:
    """public for dunder and plain names, private for two leading underscores, protected for one."""
    x = col(name)
    return F.when(x.rlike("^__.*__$"), "public").when(x.startswith("__"), "private").when(x.startswith("_"), "protected").otherwise("public")


def is_public(flag, name) -> Column:
    x = col(name)
    return F.coalesce(col(flag), ~(x.startswith("_") | x.startswith("#")))


def nesting_depth(source) -> Column:
    """The deepest indentation in tabs, or in fours of blanks; beyond six as floor(2 depth^0.7)."""
    def depth(line):
        lead = F.regexp_extract(line, r"^(\s*)", 1)
        tabs = F.length(lead) - F.length(F.replace(lead, F.lit("\t"), F.lit("")))
        return F.when(tabs > 0, tabs).otherwise(F.floor(F.length(lead) / 4).cast("int"))

    deepest = F.coalesce(F.array_max(F.transform(F.filter(source_lines(source), lambda x: F.trim(x) != ""), depth)), F.lit(0))
    return F.when(deepest > 6, F.floor(F.pow(deepest, F.lit(0.7)) * 2)).otherwise(deepest).cast("int")


def coupling(depends_on, parameters) -> Column:
    return F.least(F.least(n(depends_on), F.lit(10)) * 1.2 + F.least(n(parameters), F.lit(8)) * 0.8, F.lit(20.0))


def cognitive(complexity, branches=None, loops=None, tries=None, is_async=None, endless=None) -> Column:
    """1.5 x cyclomatic complexity and points for branches, loops, handlers, asynchrony and endless loops; 100 at most."""
    zero = F.lit(0)
    branch = F.coalesce(branches, zero) if branches is not None else zero
    loop = F.coalesce(loops, zero) if loops is not None else zero
    score = F.greatest(F.coalesce(col(complexity), F.lit(1)), F.lit(1)) * 1.5 + 2 * branch + F.when((loop > 0) & (branch > 0), 5).when(loop > 0, 2).otherwise(0)
    for flag, points in ((tries, 3), (is_async, 4), (endless, 8)):
        if flag is not None:
            score = score + F.when(F.coalesce(flag.cast("int"), zero) > 0, points).otherwise(0)
    return F.least(score, F.lit(100.0))


def complexity_level(cognitive_score: Column, depth: Column, coupling_score: Column) -> Column:
    total = cognitive_score * 0.5 + depth * 2.0 + coupling_score * 0.3
    return F.when(total <= 5, "simple").when(total <= 15, "moderate").otherwise("complex")


def _points(value: Column, *bounds: int) -> Column:
    out = F.lit(len(bounds))
    for i, bound in reversed(list(enumerate(bounds))):
        out = F.when(value <= bound, i).otherwise(out)
    return out


def complexity_tier(lines, complexity, parameters, depends_on, *traits) -> Column:
    """trivial, simple, moderate or complex by points for size, branches, parameters, dependencies and traits."""
    points = _points(F.coalesce(col(lines), F.lit(0)), 5, 15, 40) + _points(F.coalesce(col(complexity), F.lit(0)), 2, 5, 10) + _points(n(parameters), 1, 3) + _points(n(depends_on), 0, 3)
    for trait in traits:
        points = points + F.coalesce(col(trait).cast("int"), F.lit(0))
    return F.when(points <= 2, "trivial").when(points <= 5, "simple").when(points <= 8, "moderate").otherwise("complex")


def documentation_category(kind, tier: Column) -> Column:
    k = col(kind)
    return (
        F.when(k.isin("variable", "global_variable", "static_field", "field", "import"), "minimal")
        .when(k == "module", "detailed")
        .when(k == "api_endpoint", "comprehensive")
        .when(k == "class", F.when(tier.isin("moderate", "complex"), "comprehensive").otherwise("detailed"))
        .when(k == "constructor", F.when(tier == "complex", "comprehensive").otherwise("detailed"))
        .otherwise(F.when(tier == "trivial", "minimal").when(tier == "simple", "standard").when(tier == "moderate", "detailed").otherwise("comprehensive"))
    )


def context_exhausted(empties: Column, calls: Column, found: Column) -> Column:
    return (empties >= 2) | ((calls >= 3) & (found == 0))


def static_hints(source, language) -> dict[str, Column]:
    """Nine yes or no facts about a source that a writer may rely on."""
    code, lang = F.coalesce(col(source), F.lit("")), F.lower(F.coalesce(col(language), F.lit("")))
    script = lang.isin("javascript", "typescript")
    raises = F.when(lang == "python", code.rlike(r"(?<![.\w])raise\s+")).when(script | (lang == "java"), code.rlike(r"(?<![.\w])throw\s+")).otherwise(code.rlike(r"(?<![.\w])(throw|raise)\s+"))
    return {
        "detects_throw": raises,
        "uses_instanceof": code.rlike(r"\binstanceof\b"),
        "modifies_prototype": code.rlike(r"\.prototype\b|\bObject\.create\s*\("),
        "is_exported": script & code.rlike(r"\bmodule\.exports\b|\bexports\.|\bexport\s+"),
        "uses_await": code.rlike(r"\bawait\s+"),
        "accepts_callback": script & code.rlike(r"\bcallback\b|\bcb\b|\bfn\b"),
        "detects_switch_dispatch": script & code.rlike(r"\bswitch\s*\("),
        "detects_validation": code.rlike(r"\bvalidate\w*\s*\("),
        "detects_logging": code.rlike(r"\blog\w*\s*\("),
    }


def trivial_function(source) -> Column:
    """At most three body lines, all of them a return or an assignment."""
    lines = F.filter(F.transform(source_lines(source), lambda x: F.trim(x)), lambda x: x != "")
    body = F.filter(lines, lambda x: ~x.rlike(r"^(?:def |function |async |export |public |private |protected |static |@|//|#|/\*|\*|\})") & ~x.isin("{", "}", ")", ");"))
    fine = F.forall(body, lambda x: x.rlike(r"^(?:return\s+|this\.\w+\s*=|self\.\w+\s*=|\w+\s*=\s*)"))
    return F.when(F.coalesce(col(source), F.lit("")) == "", F.lit(False)).otherwise((F.size(body) <= 3) & fine)


def trivial_component(source, language) -> Column:
    """A small body of returns, delegations and plain assignments, signature lines aside by language."""
    lang = col(language)
    lines = F.filter(F.transform(source_lines(source), lambda x: F.trim(x)), lambda x: x != "")
    code = F.filter(lines, lambda x: ~x.rlike(r"^(?:#|//|/\*|\*)"))

    def head(x):
        script = lang.isin("javascript", "typescript") & x.rlike(r"^(?:export |function |async function|const |let |var )") & x.rlike(r"\{|=>")
        python = (lang == "python") & x.rlike(r"^(?:def |async def |class )")
        java = (lang == "java") & x.rlike(r"^(?:public |private |protected |static )") & x.rlike(r"\(") & x.rlike(r"\{")
        return x.isin("{", "}", ")", ");") | script | python | java

    body = F.filter(code, lambda x: ~head(x))
    fine = F.forall(body, lambda x: x.rlike(r"^(?:return\b|\w+\s*=\s*\w+\s*[+\-*/]|(?:self|this)\.\w+\s*=\s*\w+\b)"))
    return F.when(F.size(code) == 0, F.lit(False)).otherwise((F.size(body) <= 3) & fine)


def shortened(source, most: int = 500) -> Column:
    text = F.coalesce(col(source), F.lit(""))
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def built_signature(name, parameters, return_type, is_async) -> Column:
    """The signature line of a Python definition."""
    def one(p):
        hint = F.when(p["type_hint"].isNotNull() & (p["type_hint"] != ""), F.concat(F.lit(": "), p["type_hint"])).otherwise(F.lit(""))
        value = F.when(p["default_value"].isNotNull(), F.concat(F.lit(" = "), p["default_value"])).otherwise(F.lit(""))
        return F.concat(F.coalesce(p["name"], F.lit("")), hint, value)

    result = F.when(F.coalesce(col(return_type), F.lit("")) != "", F.concat(F.lit(" -> "), col(return_type))).otherwise(F.lit(""))
    return F.concat(F.when(F.coalesce(col(is_async), F.lit(False)), "async def ").otherwise("def "), col(name), F.lit("("), F.array_join(F.transform(F.coalesce(col(parameters), F.array()), one), ", "), F.lit(")"), result)


def novel_concepts(source) -> Column:
    """The first three comments of 11 to 99 characters that speak of a method, and names of own losses and metrics."""
    comments = F.transform(F.filter(source_lines(source), lambda x: F.trim(x).rlike(r"^(?:#|//)")), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^(?:#+|//+)", "")))
    told = F.filter(comments, lambda x: (F.length(x) > 10) & (F.length(x) < 100) & F.lower(x).rlike(r"\b(?:novel|custom|algorithm|approach|technique|paper|based on|inspired|optimi[sz])"))
    named = F.regexp_extract_all(F.coalesce(col(source), F.lit("")), F.lit(r"\b(?:def|class)\s+(\w*(?:[Ll]oss|[Mm]etric)\w*)"), F.lit(1))
    return F.slice(F.array_distinct(F.concat(told, named)), 1, 3)


def threshold(source) -> Column:
    """struct(attr, op, value) of the first comparison of an own attribute with a number."""
    text, p = F.coalesce(col(source), F.lit("")), r"\bself\.(\w+)\s*(>=|<=|==|!=|>|<)\s*(\d+)\b"
    return F.when(text.rlike(p), F.struct(F.regexp_extract(text, p, 1).alias("attr"), F.regexp_extract(text, p, 2).alias("op"), F.regexp_extract(text, p, 3).alias("value")))


# How a comparison is said.
PHRASES = {">=": "at least", ">": "greater than", "<=": "at most", "<": "less than", "==": "equal to", "!=": "different from"}


def threshold_summary(found: Column) -> Column:
    said = F.create_map(*[x for k, v in PHRASES.items() for x in (F.lit(k), F.lit(v))])[found["op"]]
    return F.concat(F.lit("Reports whether the stored "), found["attr"], F.lit(" is "), said, F.lit(" "), found["value"], F.lit("."))


def without_strings(line) -> Column:
    """A line without comments, its string bodies blanked."""
    x = F.regexp_replace(F.coalesce(col(line), F.lit("")), r"/\*.*?\*/", "")
    x = F.regexp_replace(x, r"\"(?:[^\"\\]|\\.)*\"", "\"\"")
    x = F.regexp_replace(x, r"'(?:[^'\\]|\\.)*'", "''")
    return F.regexp_replace(x, r"//.*$", "")


def likely_variable(text) -> Column:
    return F.coalesce(col(text).rlike(r"^[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*$"), F.lit(False))


def data_flow(source, variable) -> dict[str, Column]:
    """Whether a source writes, reads or deletes a variable; names are escaped."""
    code, var = F.coalesce(col(source), F.lit("")), F.regexp_replace(col(variable), r"([\W])", r"\\$1")
    like = lambda before, after: F.regexp_like(code, F.concat(F.lit(before), var, F.lit(after)))
    return {
        "writes": like(r"\b", r"\s*=(?!=)") | like(r"\b", r"\s*[-+*/]=") | like(r"\b", r"\[[^\]]*\]\s*=(?!=)") | like(r"\b", r"\.(?:append|add|update|push|set)\("),
        "reads": like(r"\bin\s+", r"\b") | like(r"\b", r"\["),
        "deletes": like(r"\bdel\s+", r"\b") | like(r"\bdelete\s+", r"\b") | like(r"\b", r"\.(?:clear|pop|remove)\("),
    }


def letter_grade(score) -> Column:
    """Eleven grades of a score from 0 to 1."""
    s = col(score)
    out = F.when(s >= 0.9, "A+")
    for bound, grade in ((0.85, "A"), (0.8, "A-"), (0.75, "B+"), (0.7, "B"), (0.65, "B-"), (0.6, "C+"), (0.55, "C"), (0.5, "C-"), (0.4, "D")):
        out = out.when(s >= bound, grade)
    return out.otherwise("F")


def evaluation_grade(score) -> Column:
    s = col(score)
    return F.when(s >= 90, "A").when(s >= 80, "B").when(s >= 70, "C").when(s >= 60, "D").otherwise("F")


def populated(name: str, kind: str) -> Column:
    """Whether a field says something: flags and numbers unless null, lists unless empty, texts unless empty."""
    c = F.col(name)
    if kind.startswith(("array", "map")):
        return F.coalesce(F.size(c), F.lit(0)) > 0
    if kind == "string":
        return F.coalesce(c, F.lit("")) != ""
    return c.isNotNull()


def suffix_language(path) -> Column:
    suffix = F.lower(F.regexp_extract(col(path), r"\.(\w+)$", 1))
    return F.when(suffix == "py", "python").when(suffix.isin("js", "jsx"), "javascript").when(suffix.isin("ts", "tsx"), "typescript").when(suffix == "java", "java")


def guarded(part: Column, whole: Column) -> Column:
    """part over whole, whole taken as 1 where it is 0."""
    return part / F.greatest(whole, F.lit(1))
