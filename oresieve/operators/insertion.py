"""Insertion of documentation into source files."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame


def rendered(doc: str, indent: str, language: str) -> list[str]:
    """The lines of a documentation comment."""
    lines = doc.strip().split("\n")
    if language == "python":
        if len(lines) == 1:
            return [f'{indent}"""{lines[0]}"""']
        return [f'{indent}"""{lines[0]}', *[(indent + x).rstrip() for x in lines[1:]], f'{indent}"""']
    return [f"{indent}/**", *[f"{indent} * {x}".rstrip() for x in lines], f"{indent} */"]


def definition_end(lines: list[str], start: int, last: str = ":") -> int:
    """The first line from start on that ends with `last` outside brackets; start if none does."""
    depth = 0
    for i in range(start, len(lines)):
        bare = re.sub(r"\"[^\"\n]*\"|'[^'\n]*'|#.*$", "", lines[i])
        depth += sum((c in "([{") - (c in ")]}") for c in bare)
        if depth <= 0 and bare.rstrip().endswith(last):
            return i
    return start


def inserted(source: str, points: list[tuple[int, str]], language: str) -> str:
    """source with documentation at 1-based definition lines, from the last to the first so that no place moves; existing docstrings are replaced."""
    lines = source.split("\n")
    for line, doc in sorted(points, key=lambda x: -x[0]):
        at = line - 1
        if not 0 <= at < len(lines):
            continue
        indent = re.match(r"\s*", lines[at]).group(0)
        if language == "python":
            end = definition_end(lines, at)
            text = "\n".join(lines[end + 1 :])
            m = re.match(r"\s*[rRuU]?(\"{3}[\s\S]*?\"{3}|'{3}[\s\S]*?'{3})[ \t]*(?:\n|\Z)", text)
            skip = m.group(0).rstrip("\n").count("\n") + 1 if m else 0
            lines[end + 1 : end + 1 + skip] = rendered(doc, indent + "    ", language)
        else:
            first = at
            while first > 0 and re.match(r"\s*@\w+", lines[first - 1]):
                first -= 1
            if first > 0 and lines[first - 1].strip().endswith("*/"):
                begin = first - 1
                while begin > 0 and "/*" not in lines[begin]:
                    begin -= 1
                lines[begin:first] = rendered(doc, indent, language)
            else:
                lines[first:first] = rendered(doc, indent, language)
    return "\n".join(lines)


def documented_files(files: DataFrame, docs: DataFrame) -> DataFrame:
    """(path, value): files (path, language, value) with docs (path, line, docstring) written in; a file is one group of its insertions."""
    rows = files.join(docs, "path")

    def run(t: pa.Table) -> pa.Table:
        points = list(zip(t["line"].to_pylist(), t["docstring"].to_pylist()))
        value = inserted(t["value"][0].as_py(), points, t["language"][0].as_py())
        return pa.table({"path": pa.array([t["path"][0].as_py()], pa.string()), "value": pa.array([value], pa.string())})

    return rows.select("path", "language", "value", "line", "docstring").groupBy("path").applyInArrow(run, "path string, value string")
