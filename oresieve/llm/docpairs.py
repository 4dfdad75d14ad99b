"""Problem 6: functions paired with their documentation.

Recursive patterns of the regex library take a definition in one match: the comments, annotations and directives above it, its
signature with balanced parentheses, and its balanced body, in which strings, comments and regular expressions are protected. What a
body holds is consumed with it, so nested functions never match. Captures without documentation, or with a trivial one, are dropped.

A documentation is trivial with fewer than four words besides the function's name (whole or in its parts), its parameters, tags and
types; directives, separators and commented-out code hold no words.

Defined results: null and empty source gives nothing from source_code, but a function row may still be documented in the other two
places; its name is then the component's. Rows delivered again give one pair. Text whose brackets do not balance is taken to its end.
"""

from __future__ import annotations

from collections.abc import Iterator

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oresieve.llm.common import map_columns, spread

LEAST_WORDS = 4

_PARTS = r"""
(?(DEFINE)
 (?<str>"(?:[^"\\\n]++|\\.)*+"|'(?:[^'\\\n]++|\\.)*+'|`(?:[^`\\]++|\\.)*+`)
 (?<com>//[^\n]*+|/\*(?:[^*]++|\*(?!/))*+\*/)
 (?<rex>(?<=[=(,:;!&|?{}\[\n]\ ?|return\ )/(?![*/])(?:[^/\\\[\n]++|\\.|\[(?:[^\]\\\n]++|\\.)*+\])++/)
 (?<paren>\((?:[^()"'`/]++|(?&str)|(?&com)|(?&rex)|["'`/]|(?&paren))*+\))
 (?<block>\{(?:[^{}"'`/]++|(?&str)|(?&com)|(?&rex)|["'`/]|(?&block))*+\})
 (?<angle><(?:[^<>(){};]++|(?&angle))*+>)
)
"""
_LEAD = r"(?<lead>(?:\s++|(?&com)|@(?!interface\b)[\w.]++(?:\s*+(?&paren))?+)*+)"
_TAIL = r"(?<tail>\s*+(?::\s*+(?:[^{};=(]++|(?&paren)|\{[^{}]*+\}(?=\s*+[{|&\[]))++|throws\s[^{;]++|=>|[ \t]++)*+\s*+)(?<body>(?&block)|;|\{[\s\S]*+\Z)"
#: A member of a class body: a method with what stands above it, or any other member.
_MEMBER = regex.compile(
    _PARTS + _LEAD + r"(?:(?<head>(?:[^(){};=\"'`/@<]++|(?&angle))*+)(?<params>(?&paren))" + _TAIL
    + r"|(?<other>(?:[^;{}\"'`/]++|(?&str)|(?&com)|(?&rex)|[\"'`/]|(?&block))*?(?:;[ \t]*+(?://[^\n]*+)?|(?<=\})|\Z)))",
    regex.X | regex.V1,
)
#: A function that starts a text.
_FUNCTION = regex.compile(
    _PARTS + _LEAD
    + r"(?<head>(?:export\s++|default\s++|declare\s++)*+(?:async\s++)?+(?:function\b\s*+\*?+\s*+(?<name>[\w$]++)(?&angle)?+"
    + r"|(?:const|let|var)\s++(?<name>[\w$]++)\s*+(?::[^=]++)?+=\s*+(?:async\s++)?+(?:function\b\s*+\*?+\s*+[\w$]*+)?+(?&angle)?+"
    + r"|(?:[^(){};=\"'`/@<]++|(?&angle))*+))\s*+(?<params>(?&paren)|[\w$]++(?=\s*+=>))(?:" + _TAIL + r"|\s*+(?::[^=]++)?=>[\s\S]*+)?+",
    regex.X | regex.V1,
)
_CLASS = regex.compile(r"\b(?:class|interface|enum|record)\b[^{;]*+\{")
_ABOVE = regex.compile(_PARTS + _LEAD, regex.X | regex.V1)
_NEXT = regex.compile(r"[^\n;}]*+(?:[\n;}]|\Z)", regex.V1)
_COMMENT = regex.compile(r"//[^\n]*+|/\*(?:[^*]++|\*(?!/))*+\*/|\n[ \t]*+(?=\n)|@[\w.]++")

_PYTHON = regex.compile(
    r"""
(?(DEFINE)
 (?<pystr>"{3}(?:[^"\\]++|\\.|"(?!""))*+"{3}|'{3}(?:[^'\\]++|\\.|'(?!''))*+'{3}|"(?:[^"\\\n]++|\\.)*+"|'(?:[^'\\\n]++|\\.)*+')
 (?<paren>[(\[{](?:[^()\[\]{}"'\#]++|(?&pystr)|\#[^\n]*+|["']|(?&paren))*+[)\]}])
)
^(?<ind>[ \t]*+)
(?<lead>(?:\#[^\n]*+\r?\n(?P=ind)|@[\w.]++[ \t]*+(?&paren)?+[^\n]*+\r?\n(?P=ind))*+)
(?:async\s++)?+def\s++(?<name>\w++)\s*+(?<params>(?&paren))(?:[^:\n"']++|(?&pystr))*+:
(?<body>(?:(?&pystr)|\#[^\n]*+|["']|[^"'\#\n]++|\n(?=[ \t]*+(?:\r?\n|\Z))|\n(?=(?P=ind)[ \t]))*+)
""",
    regex.X | regex.V1 | regex.M,
)
_PYCLASS = regex.compile(r"^([ \t]*+)class\s[^:]*?(?:\([^()]*+\)\s*+)?:[^\S\n]*+(?:\#[^\n]*+)?\n(?:[ \t]*+(?:\#[^\n]*+)?\n)*+([ \t]++)", regex.M | regex.V1)
_DOCSTRING = regex.compile(r"\s*+(?:\#[^\n]*+\s*+)*+[rRuU]?+(\"{3}((?:[^\"\\]++|\\[\s\S]|\"(?!\"\"))*+)\"{3}|'{3}((?:[^'\\]++|\\[\s\S]|'(?!''))*+)'{3}|\"((?:[^\"\\\n]++|\\[\s\S])*+)\"|'((?:[^'\\\n]++|\\[\s\S])*+)')")

# Words that start a directive to a tool.
DIRECTIVE = regex.compile(
    r"^\W*(?:eslint|tslint|jshint|jscs|prettier|istanbul|c8|webpack|noinspection|nosonar|nosec|noqa|pylint|flake8|mypy|ruff|isort|fmt|yapf|pragma|"
    r"type:\s*ignore|pyright|ts-(?:ignore|expect-error|nocheck|check)|@ts-(?:ignore|expect-error|nocheck)|@formatter|checkstyle|spotbugs|suppress|language=|"
    r"region\b|endregion\b|#(?:end)?region|global\b|globals\b|@flow|coverage:|cspell|biome|deno-|v8 ignore|-\*-|vim:)",
    regex.I,
)
CODE = regex.compile(
    r"^(?:(?:return|throw|raise|yield|await|del|break|continue|pass|import|from|const|let|var|print|console\.\w+|if|elif|else|for|while|try|def|function|class|public|private|protected|static|final|new|this\.|self\.|@)\b?.*[;{}()\]:=]\s*|return(?:\s+[\w.$]+)?;?|[\w.$\[\]'\"]+\s*[-+*/%|&^]?=(?!=)\s*\S.*|[\w.$]+\([^)]*\)\s*[;{]?|.*[;{}])$"
)
_MARKS = regex.compile(r"^\s*(?:/\*+!?|\*/|\*(?!/)|//+!?|\#+!?|<!--|-->|\"{3}|'{3})+|(?:\*+/|\"{3}|'{3}|-->)\s*$")
_TAGS = regex.compile(
    r"\{[^{}\n]*\}|</?[A-Za-z][^<>\n]*>|@\w+|:(?:param|type|arg|raises?|returns?|rtype|keyword|var|ivar)\b[^:\n]*:|^\s*(?:Args|Arguments|Parameters|Returns?|Raises|Yields|Throws|Params|Note|Example|Examples)\s*:", regex.M | regex.I
)
_PARAM_NAMES = regex.compile(r"(?:@(?:param|arg|argument|property|prop)\s+(?:\{[^{}\n]*\}\s*)?\[?([\w$.]+)|:(?:param|type|arg|keyword)\s+(?:[\w.\[\], ]+\s+)?([\w$]+)\s*:|^\s{2,}\*{0,2}(\w+)\s*(?:\([^)\n]*\))?\s*:)", regex.M)
_WORD = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]|[^\W\d_\p{Han}\p{Hiragana}\p{Katakana}]+(?:['’][^\W\d_]+)?")
_NAME_PARTS = regex.compile(r"[A-Z]+(?![a-z])|[A-Z]?[^\W\dA-Z_]+|\d+")
_ID = regex.compile(r"[A-Za-z_$][\w$]*")
# What may stand where a name is expected but begins a statement.
NO_NAMES = frozenset("if for while switch catch return function new throw else do try synchronized super this typeof await".split())


def words(doc: str | None, name: str = "", params: str = "") -> list[str]:
    """The words of a documentation that say something."""
    if not doc:
        return []
    lines = []
    for line in doc.replace("\r", "").split("\n"):
        before = None
        while before != line:
            before, line = line, _MARKS.sub("", line)
        bare = line.strip()
        if not bare or DIRECTIVE.match(bare) or CODE.match(bare) and not bare.startswith(("@", ":")):
            continue
        lines.append(line)
    text = "\n".join(lines)
    own = {name.lower(), *(p.lower() for p in _NAME_PARTS.findall(name))}
    own.update(p.lower() for p in _ID.findall(regex.sub(r"[:=][^,()]*", "", params)))
    for found in _PARAM_NAMES.findall(text):
        own.update(p.lower() for p in found if p)
    text = regex.sub(r"`?" + regex.escape(name) + r"`?(?:\(\))?", " ", text) if name else text
    text = _TAGS.sub(" ", _PARAM_NAMES.sub(lambda m: "\n", text))
    return [w for w in _WORD.findall(text) if w.lower() not in own and w.lower() not in ("none", "null", "todo", "fixme", "tbd")]


def trivial(doc: str | None, name: str = "", params: str = "") -> bool:
    return len(words(doc, name, params)) < LEAST_WORDS


def _above(lead: str) -> str:
    """The comments right above a definition: those after the last blank line."""
    parts: list[str] = []
    for m in _COMMENT.finditer(lead):
        text = m.group(0)
        if text.startswith("\n"):
            parts.clear()
        elif not text.startswith("@"):
            parts.append(text)
    return "\n".join(parts)


def _docstring(body: str) -> str:
    m = _DOCSTRING.match(body)
    if not m:
        return ""
    return next((g for g in m.groups()[1:] if g is not None), "")


def python_functions(text: str, inside_class: bool) -> Iterator[tuple[str, str, str, str]]:
    """(name, parameters, documentation, code)."""
    wanted = None
    if inside_class:
        head = _PYCLASS.search(text)
        if head is None:
            return
        wanted = head.group(2)
    for m in _PYTHON.finditer(text):
        if inside_class and m.group("ind") != wanted:
            continue
        doc = "\n".join(x for x in m.group("lead").split("\n") if x.strip().startswith("#"))
        yield m.group("name"), m.group("params"), doc + "\n" + _docstring(m.group("body")), m.group(0)
        if not inside_class:
            return


def brace_functions(text: str, inside_class: bool) -> Iterator[tuple[str, str, str, str]]:
    """(name, parameters, documentation, code) of JavaScript, TypeScript and Java."""
    if not inside_class:
        m = _FUNCTION.match(text)
        if m:
            name = m.group("name") or next(reversed(_ID.findall(regex.sub(r"<[^<>]*>", "", m.group("head")))), None)
            if name and name not in NO_NAMES:
                yield name, m.group("params"), _above(m.group("lead")), m.group(0)
        return
    start = _CLASS.search(text)
    if start is None:
        return
    at = start.end()
    while at < len(text):
        m = _MEMBER.match(text, at)
        if m is None or m.end() == at:
            # nothing to read here: past what stands above, the class ends or the next line begins
            at = _ABOVE.match(text, at).end()
            if text.startswith("}", at):
                return
            at = _NEXT.match(text, at).end()
            continue
        at = m.end()
        if m.group("params") is not None:
            name = next(reversed(_ID.findall(regex.sub(r"<[^<>]*>", "", m.group("head")))), None)
            if name and name not in NO_NAMES:
                yield name, m.group("params"), _above(m.group("lead")), m.group(0)[len(m.group("lead")) - len(m.group("lead").lstrip()) :]
        elif text.startswith("}", at):
            return


def functions(text: str | None, language: str | None, kind: str) -> list[tuple[str, str, str, str]]:
    """(name, parameters, documentation, code) of a component's own function, or of a class's direct methods."""
    if not text:
        return []
    find = python_functions if (language or "").lower().startswith("py") else brace_functions
    return list(find(text.replace("\r\n", "\n").replace("\r", "\n"), kind == "class"))


def extracted(components: DataFrame) -> DataFrame:
    """(id, kind, func_name, params, doc, code) of every function that the sources hold, doc null where none or trivial."""

    def rule(key, kind, language, name, source, docstring) -> Iterator[tuple]:
        found = functions(source, language, kind)
        if kind != "class" and not found:
            found = [(name or "", "", "", source or "")]
        for func, params, doc, code in found:
            best = doc if not trivial(doc, func, params) else None
            if best is None and kind != "class" and not trivial(docstring, func, params):
                best = docstring
            yield key, kind, func, params, best, code

    rows = components.filter(F.col("type").isin("function", "method", "constructor", "class"))
    return map_columns(spread(rows), ["id", "type", "language", "name", "source_code", "existing_docstring"], rule, "id string, kind string, func_name string, params string, doc string, code string")


def paired(components: DataFrame, comments: DataFrame, with_code: bool = True) -> DataFrame:
    """(id, func_name, doc, code) of each function that is documented in its source, in existing_docstring or in a comment recorded elsewhere.

    comments: (component_id, original_comment). They meet only the functions without other documentation, by their id.
    """
    found = extracted(components)
    if not with_code:
        found = found.drop("code").withColumn("code", F.lit(None).cast("string"))
    found = found.persist()
    rest = found.filter("doc IS NULL AND kind <> 'class'").select("id", "func_name", "params", "code")
    texts = comments.filter("length(trim(original_comment)) > 3").select(F.col("component_id").alias("id"), "original_comment").distinct()

    def rule(key, func, params, code, comment) -> Iterator[tuple]:
        if not trivial(comment, func, params):
            yield key, func, comment, code

    schema = "id string, func_name string, doc string, code string"
    elsewhere = map_columns(rest.join(texts, "id"), ["id", "func_name", "params", "code", "original_comment"], rule, schema)
    return found.filter("doc IS NOT NULL").select("id", "func_name", "doc", "code").unionByName(elsewhere)


def pairs(components: DataFrame, comments: DataFrame) -> DataFrame:
    """One row (id, func_name, doc, code) a function; of several documentations the longest, then the first in order."""
    best = F.max(F.struct(F.length("doc").alias("n"), F.col("doc"), F.col("code"))).alias("best")
    return paired(components, comments).groupBy("id", "func_name").agg(best).select("id", "func_name", "best.doc", "best.code")
