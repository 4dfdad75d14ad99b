"""Rendering, repair and scoring of documentation texts."""

from __future__ import annotations

import ast
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oresieve.functions.text import col

# Names of languages and the style of their documentation.
STYLES = {"python": "google", "py": "google", "javascript": "jsdoc", "js": "jsdoc", "typescript": "tsdoc", "ts": "tsdoc", "java": "javadoc"}


def style_of(language) -> Column:
    """The documentation style of a language or its alias; Python's for unknown ones."""
    low = F.lower(F.trim(F.coalesce(col(language), F.lit(""))))
    out = F.lit("google")
    for name, style in STYLES.items():
        out = F.when(low == name, style).otherwise(out)
    return out


def without_blocks(doc) -> Column:
    """A comment without its @summary and @description blocks, which end at the next tag; a fold over the lines."""
    lines = F.split(F.coalesce(col(doc), F.lit("")), "\n")
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("inside"))

    def step(acc, line):
        bare = F.regexp_replace(F.trim(line), r"^\*\s*", "")
        opens = bare.rlike(r"^@(?:summary|description)\b")
        inside = F.when(opens, True).when(bare.startswith("@") | (F.trim(line) == "*/"), False).otherwise(acc["inside"])
        return F.struct(F.when(inside, acc["kept"]).otherwise(F.array_append(acc["kept"], line)).alias("kept"), inside.alias("inside"))

    return F.array_join(F.aggregate(lines, start, step, lambda acc: acc["kept"]), "\n")


def missing_params(doc, parameters) -> Column:
    """Names of parameters that no @param line mentions."""
    said = F.regexp_extract_all(F.coalesce(col(doc), F.lit("")), F.lit(r"@param\s+(?:\{[^}]*\}\s*)?\[?([\w$]+)"), F.lit(1))
    return F.array_except(F.transform(F.coalesce(col(parameters), F.array()), lambda p: p["name"]), said)


def with_params(doc, parameters) -> Column:
    """A JSDoc text with a line for each parameter that lacks one, before its end."""
    lines = F.array_join(F.transform(missing_params(doc, parameters), lambda n: F.concat(F.lit("@param "), n)), "\n")
    return F.when(lines == "", col(doc)).otherwise(F.concat(F.regexp_replace(F.coalesce(col(doc), F.lit("")), r"\s+$", ""), F.lit("\n"), lines))


def rendered(summary, parameters, result, style: str) -> Column:
    """A docstring of google, numpy or sphinx style from its parts."""
    params = F.coalesce(col(parameters), F.array())
    word = lambda p: F.coalesce(p["description"], F.lit(""))
    if style == "google":
        body = F.concat(F.lit("\n\nArgs:\n"), F.array_join(F.transform(params, lambda p: F.concat(F.lit("    "), p["name"], F.lit(": "), word(p))), "\n"))
        end = F.concat(F.lit("\n\nReturns:\n    "), col(result))
    elif style == "numpy":
        body = F.concat(F.lit("\n\nParameters\n----------\n"), F.array_join(F.transform(params, lambda p: F.concat(p["name"], F.lit("\n    "), word(p))), "\n"))
        end = F.concat(F.lit("\n\nReturns\n-------\n"), col(result))
    else:
        body = F.concat(F.lit("\n\n"), F.array_join(F.transform(params, lambda p: F.concat(F.lit(":param "), p["name"], F.lit(": "), word(p))), "\n"))
        end = F.concat(F.lit("\n:returns: "), col(result))
    return F.concat(col(summary), F.when(F.size(params) > 0, body).otherwise(F.lit("")), F.when(F.coalesce(col(result), F.lit("")) != "", end).otherwise(F.lit("")))


def script_facts(source) -> dict[str, Column]:
    """Promise handlers, middleware calls, immediate calls and inline callbacks of a script, as arrays and a flag."""
    code = F.coalesce(col(source), F.lit(""))
    return {
        "promise_handlers": F.regexp_extract_all(code, F.lit(r"\.(then|catch|finally)\s*\("), F.lit(1)),
        "middleware": F.array_distinct(F.regexp_extract_all(code, F.lit(r"\b((?:app|router|express)\.\w+)\s*\("), F.lit(1))),
        "iife": code.rlike(r"\(\s*(?:async\s+)?function\b[\s\S]*\}\s*\)?\s*\(|\(\s*(?:async\s*)?\([^)]*\)\s*=>[\s\S]*\)\s*\("),
        "inline_functions": F.size(F.regexp_extract_all(code, F.lit(r"[(,]\s*(?:async\s+)?(function\b|\(?[\w$, ]*\)?\s*=>)"), F.lit(1))),
    }


def first_call(line) -> Column:
    """struct(receiver, name) of the first call in a line; null without one."""
    text, p = F.coalesce(col(line), F.lit("")), r"(?:([\w$]+(?:\.[\w$]+)*)\.)?([A-Za-z_$][\w$]*)\s*\("
    return F.when(text.rlike(p), F.struct(F.nullif(F.regexp_extract(text, p, 1), F.lit("")).alias("receiver"), F.regexp_extract(text, p, 2).alias("name")))


# -- scores that need a syntax tree or an alignment
SECTIONS = {
    "args": re.compile(r"^\s*(?:Args|Arguments|Parameters|Params)\s*:|:param\b|@param\b", re.M | re.I), "returns": re.compile(r"^\s*(?:Returns?|Yields?)\s*:|:returns?:|@returns?\b", re.M | re.I),
    "raises": re.compile(r"^\s*(?:Raises|Exceptions|Throws)\s*:|:raises\b|@throws\b", re.M | re.I), "examples": re.compile(r"^\s*(?:Examples?|Usage)\s*:|>>>|@example\b", re.M | re.I),
    "attributes": re.compile(r"^\s*(?:Attributes|Members|Properties)\s*:|:ivar\b", re.M | re.I),
}


def tree_completeness(source: str | None) -> float | None:
    """Share of the parts that a Python function or class documents of those it needs, by its syntax tree; null if it does not parse.

    Summary and description are always needed, examples by public names; a raise counts, and so does a call outside handlers.
    Constructors are complete.
    """
    try:
        node = ast.parse(re.sub(r"^[ \t]+", "", source or "", count=1) if (source or "").startswith((" ", "\t")) else source or "").body[0]
    except (SyntaxError, ValueError, IndexError, RecursionError):
        return None
    doc = ast.get_docstring(node) if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) else None
    if not isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
        return None
    public = not node.name.startswith("_")
    need = ["summary", "description"]
    if isinstance(node, ast.ClassDef):
        init = next((x for x in node.body if isinstance(x, ast.FunctionDef) and x.name == "__init__"), None)
        need += ["attributes"] * any(isinstance(x, ast.Attribute) and isinstance(x.ctx, ast.Store) for x in ast.walk(node)) + ["args"] * bool(init and len(init.args.args) > 1)
    else:
        if node.name == "__init__":
            return 1.0
        own = [a for a in node.args.args if a.arg not in ("self", "cls")]
        caught = {id(y) for x in ast.walk(node) if isinstance(x, ast.Try) for h in x.handlers for y in ast.walk(h)}
        raises = any(isinstance(x, (ast.Raise, ast.Call)) and id(x) not in caught for b in node.body for x in ast.walk(b))
        returns = any(isinstance(x, (ast.Return, ast.Yield)) and x.value is not None for x in ast.walk(node))
        need += ["args"] * bool(own) + ["returns"] * returns + ["raises"] * raises
    need += ["examples"] * public
    if not doc:
        return 0.0
    chunks = [c for c in re.split(r"\n\s*\n", doc.strip()) if c.strip()]
    has = {"summary": bool(chunks), "description": len(chunks) > 1 and not any(p.match(chunks[1]) for p in SECTIONS.values()), **{k: bool(p.search(doc)) for k, p in SECTIONS.items()}}
    return sum(has[k] for k in need) / len(need)


def same_call(predicted: str | None, expected: str | None) -> tuple[bool, str]:
    """Whether two Python calls agree in name, positional and keyword arguments, and where they first differ."""
    try:
        a, b = (ast.parse((x or "").strip(), mode="eval").body for x in (predicted, expected))
    except (SyntaxError, ValueError, RecursionError):
        return False, "unparsable"
    if not (isinstance(a, ast.Call) and isinstance(b, ast.Call)):
        return False, "no call"
    if ast.dump(a.func) != ast.dump(b.func):
        return False, "name"
    if [ast.dump(x) for x in a.args] != [ast.dump(x) for x in b.args]:
        return False, "positional"
    if sorted((k.arg or "**", ast.dump(k.value)) for k in a.keywords) != sorted((k.arg or "**", ast.dump(k.value)) for k in b.keywords):
        return False, "keywords"
    return True, ""


def bleu4(reference: list[str], hypothesis: list[str]) -> float:
    """Geometric mean of clipped precisions up to four words, one added to counts beyond the first, with the brevity penalty."""
    import math

    if not reference or not hypothesis:
        return 0.0
    logs = 0.0
    for n in range(1, 5):
        a, b = (Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)) for x in (reference, hypothesis))
        hits, total, plus = sum((a & b).values()), sum(b.values()), int(n > 1)
        if hits + plus == 0:
            return 0.0
        logs += math.log((hits + plus) / max(1, total + plus)) / 4
    return math.exp(logs) * min(1.0, math.exp(1 - len(reference) / len(hypothesis)))


def rouge_l(reference: list[str], hypothesis: list[str]) -> float:
    """F measure of the longest common subsequence."""
    if not reference or not hypothesis:
        return 0.0
    row = [0] * (len(hypothesis) + 1)
    for x in reference:
        before = 0
        for j, y in enumerate(hypothesis, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    p, r = row[-1] / len(hypothesis), row[-1] / len(reference)
    return 0.0 if p + r == 0 else 2 * p * r / (p + r)


def similarity(docs: DataFrame, key: str, reference: str, hypothesis: str) -> DataFrame:
    """(key, bleu4, rouge_l) over lower-case words."""

    def run(batches):
        for batch in batches:
            words = [[re.findall(r"\w+", (x or "").lower()) for x in batch.column(i).to_pylist()] for i in (1, 2)]
            scores = [[f(a, b) for a, b in zip(*words)] for f in (bleu4, rouge_l)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(s, pa.float64()) for s in scores)], names=[key, "bleu4", "rouge_l"])

    return docs.select(key, reference, hypothesis).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, bleu4 double, rouge_l double")


def tree_scores(components: DataFrame, key: str = "id", source: str = "source_code") -> DataFrame:
    """(key, score) of Python functions and classes by their syntax trees."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([tree_completeness(x) for x in batch.column(1).to_pylist()], pa.float64())], names=[key, "score"])

    return components.select(key, source).mapInArrow(run, f"{key} {components.schema[key].dataType.simpleString()}, score double")


def call_scores(predictions: DataFrame, key: str, predicted: str, expected: str) -> DataFrame:
    """(key, ok, reason) of predicted example calls."""

    def run(batches):
        for batch in batches:
            found = [same_call(a, b) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found]), pa.array([f[1] for f in found], pa.string())], names=[key, "ok", "reason"])

    return predictions.select(key, predicted, expected).mapInArrow(run, f"{key} {predictions.schema[key].dataType.simpleString()}, ok boolean, reason string")
