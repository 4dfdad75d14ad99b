"""Problem 1: source files that do not parse.

Every code file is parsed by the grammar of its extension. A file that this grammar refuses is tried against all others, in the
order of a token-based ranking of languages: one that accepts it names the language the file really has (a wrong extension), none
means a corrupt file (cut off, merge conflict, damaged). A file that its own grammar accepts is valid whatever others say, so the
foreign parsers are not asked.

Nesting is no fault: chains of branches are loops in the recognisers, and their frames lie on the heap, up to FRAMES of them. A file
that a parser gives up for its depth (CPython's own parser does so from 200 brackets or some thousand operands on) is corrupt if its
brackets do not match, and otherwise undecided: it is counted apart and never reported as unparsable.

Defined results: null and empty text is valid; files of other extensions are left out; a file delivered several times counts once.
"""

from __future__ import annotations

import ast
import re
import sys
import warnings
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oresieve.llm.common import LANGUAGES, map_columns, spread
from oresieve.llm.grammar.java import parse_java
from oresieve.llm.grammar.scan import Bad
from oresieve.llm.grammar.script import parse_script


#: Frames of a recogniser; a level of nesting takes about fifteen of some hundred bytes.
FRAMES = 1_000_000
#: What CPython says where its parser, and not the grammar, ends.
_LIMITS = re.compile(r"too many nested parentheses|too many levels of indentation")
_PYTHON = re.compile(r"\"{3}(?:[^\\]|\\.)*?\"{3}|'{3}(?:[^\\]|\\.)*?'{3}|\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'|#[^\n]*|([(\[{])|([)\]}])", re.S)


class TooDeep(Exception):
    """The text is nested deeper than a parser follows."""


def _matched(text: str) -> bool:
    """Whether the brackets of a Python text match."""
    opened = []
    for m in _PYTHON.finditer(text):
        if m.group(1):
            opened.append(m.group(1))
        elif m.group(2) and (not opened or opened.pop() + m.group(2) not in ("()", "[]", "{}")):
            return False
    return not opened


def _python(text: str) -> None:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            ast.parse(text)
        except (RecursionError, MemoryError, SyntaxError) as fault:
            if isinstance(fault, SyntaxError) and not _LIMITS.search(fault.msg or ""):
                raise
            if not _matched(text):
                raise Bad("brackets") from None
            raise TooDeep from None


#: Grammar → parser. JSX is a grammar of its own, as .js and .ts files must not hold it.
GRAMMARS = {
    "python": _python,
    "javascript": lambda text: parse_script(text),
    "jsx": lambda text: parse_script(text, jsx=True),
    "typescript": lambda text: parse_script(text, ts=True),
    "tsx": lambda text: parse_script(text, ts=True, jsx=True),
    "java": parse_java,
}
GRAMMAR_OF = {"py": "python", "js": "javascript", "jsx": "jsx", "ts": "typescript", "tsx": "tsx", "java": "java"}

#: Marks by which the ranking tells languages apart: (pattern of one token or short token group, language, weight).
MARKS = [
    (re.compile(r"^\s*(?:def|class)\s+\w+.*:\s*$|^\s*(?:from\s+[\w.]+\s+)?import\s+[\w.]+\s*$|\bself\b|\belif\b|^\s*#", re.M), "python", 1.0),
    (re.compile(r"\b(?:function|const|let|var|typeof|require)\b|=>|===|module\.exports"), "javascript", 1.0),
    (re.compile(r"\b(?:interface|type|enum|namespace|readonly|implements)\s+\w+|:\s*(?:string|number|boolean|any|unknown|void)\b|\bas\s+\w+"), "typescript", 1.5),
    (re.compile(r"^\s*package\s+[\w.]+;|\b(?:public|private|protected)\s+(?:static\s+|final\s+)*(?:class|void|[A-Z]\w*)\b|^\s*import\s+[\w.*]+;|@Override", re.M), "java", 2.0),
    (re.compile(r"</\w+>|/>"), "jsx", 0.5),
    (re.compile(r"</\w+>|/>"), "tsx", 0.25),
]


def ranked_grammars(text: str) -> list[str]:
    """All grammars, the likeliest first."""
    score = dict.fromkeys(GRAMMARS, 0.0)
    for pattern, language, weight in MARKS:
        score[language] += weight * len(pattern.findall(text))
    score["jsx"] += score["javascript"] * 0.9
    score["tsx"] += score["typescript"] * 0.9
    return sorted(score, key=lambda x: -score[x])


def parses(text: str, grammar: str) -> bool:
    """Whether text, without a byte order mark, is a program of the grammar; raises TooDeep where nesting leaves it open."""
    sys.setrecursionlimit(max(FRAMES, sys.getrecursionlimit()))
    try:
        GRAMMARS[grammar](text.removeprefix("\ufeff"))
        return True
    except RecursionError:
        raise TooDeep from None
    except (Bad, SyntaxError, ValueError):
        return False


def verdict(path: str | None, text: str | None) -> tuple[str, str, str | None] | None:
    """(language of the extension, valid/wrong_extension/corrupt/undecided, language found); None for files that hold no code."""
    own = GRAMMAR_OF.get((path or "").rpartition(".")[2].lower())
    if own is None:
        return None
    language = LANGUAGES[(path or "").rpartition(".")[2].lower()]
    try:
        if not text or parses(text, own):
            return language, "valid", language
    except TooDeep:
        return language, "undecided", None
    for grammar in ranked_grammars(text):
        try:
            if grammar != own and parses(text, grammar):
                return language, "wrong_extension", {"jsx": "javascript", "tsx": "typescript"}.get(grammar, grammar)
        except TooDeep:  # the text is no program of its own language, whatever it is of this one
            continue
    return language, "corrupt", None


def parse_files(files: DataFrame, file_id: str = "file_id", repo: str = "repo", path: str = "path", text: str = "value") -> DataFrame:
    """One row (file_id, repo, language, verdict, found_language) for each code file."""

    def rule(key, owner, where, value) -> Iterator[tuple]:
        found = verdict(where, value)
        if found:
            yield key, owner, *found

    code = files.filter(F.lower(F.regexp_extract(path, r"\.(\w+)$", 1)).isin(*GRAMMAR_OF))
    parsed = map_columns(spread(code), [file_id, repo, path, text], rule, "file_id long, repo string, language string, verdict string, found_language string")
    # one row a file from here on: the texts were never shuffled
    return parsed.dropDuplicates(["file_id"])


def unparsable(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("verdict").isin("wrong_extension", "corrupt")).select("file_id")


def rates(parsed: DataFrame) -> DataFrame:
    """Share of files that do not parse, by repository and language."""
    bad = F.count_if(F.col("verdict").isin("wrong_extension", "corrupt"))
    return parsed.groupBy("repo", "language").agg(
        F.count("*").alias("files"),
        bad.alias("unparsable"),
        F.count_if(F.col("verdict") == "wrong_extension").alias("wrong_extension"),
        F.count_if(F.col("verdict") == "corrupt").alias("corrupt"),
        F.count_if(F.col("verdict") == "undecided").alias("undecided"),
        F.round(bad / F.count("*"), 4).alias("rate"),
    )
