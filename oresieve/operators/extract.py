"""Extraction of components, statements, calls and endpoints from source files (path, value).

Python is read by the ast module. JavaScript, TypeScript and Java are read by brackets: comments and strings are blanked at equal length,
then definitions are found by their heads and their bodies by bracket pairs. Read are: classes, interfaces, enums and records, functions,
arrow functions bound to a name, methods, constructors, fields, imports and calls; not read are object-literal methods and inline callbacks.

A file that does not parse gives one row of type "error" and touches no other file. Null text is empty text.
"""

from __future__ import annotations

import ast
import hashlib
import re
import textwrap
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oresieve.functions.code import suffix_language

COMPONENT = pa.schema(
    [
        ("id", pa.string()), ("name", pa.string()), ("type", pa.string()), ("language", pa.string()), ("file_path", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()),
        ("signature", pa.string()),
        ("parameters", pa.list_(pa.struct([("name", pa.string()), ("type_hint", pa.string()), ("default_value", pa.string()), ("is_required", pa.bool_())]))),
        ("return_type", pa.string()), ("decorators", pa.list_(pa.string())), ("parent_classes", pa.list_(pa.string())), ("methods", pa.list_(pa.string())), ("attributes", pa.list_(pa.string())),
        ("existing_docstring", pa.string()), ("calls", pa.list_(pa.string())), ("imports", pa.list_(pa.string())), ("throws", pa.list_(pa.string())), ("complexity", pa.int32()), ("lines_of_code", pa.int32()),
        ("is_async", pa.bool_()), ("is_generator", pa.bool_()), ("is_static", pa.bool_()), ("is_class_method", pa.bool_()), ("is_abstract", pa.bool_()), ("visibility", pa.string()), ("source_code", pa.string()),
    ]
)
STATEMENT = pa.schema(
    [
        ("func_id", pa.string()), ("ord", pa.int32()), ("type", pa.string()), ("line", pa.int32()), ("end_line", pa.int32()), ("depth", pa.int32()), ("code", pa.string()),
        ("defs", pa.list_(pa.string())), ("uses", pa.list_(pa.string())), ("calls", pa.list_(pa.string())),
    ]
)
_DDL = {pa.string(): "string", pa.int32(): "int", pa.bool_(): "boolean", pa.list_(pa.string()): "array<string>"}
PARAMETERS = "array<struct<name:string,type_hint:string,default_value:string,is_required:boolean>>"


def ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_DDL.get(f.type, PARAMETERS)}" for f in schema)


def module_path(path: str) -> str:
    return re.sub(r"\.\w+$", "", path.strip("/")).replace("/", ".")


def short_digest(*parts: str) -> str:
    return hashlib.md5(":".join(parts).encode()).hexdigest()[:8]


def visibility_of(name: str) -> str:
    if name.startswith("__"):
        return "public" if name.endswith("__") else "private"
    return "protected" if name.startswith("_") else "public"


# -- Python
class _Fields(dict):
    """The fields of a type of nodes that may hold nodes, contexts and operators aside."""

    def __missing__(self, kind: type) -> tuple[str, ...]:
        self[kind] = found = () if kind is ast.Constant else tuple(f for f in kind._fields if f not in ("ctx", "op", "ops", "id", "attr"))
        return found


_FIELDS = _Fields()


def _walk(node: ast.AST) -> list[ast.AST]:
    """The nodes of ast.walk in its order, without contexts and operators, as a list that grows while it is read."""
    out = [node]
    for x in out:
        for name in _FIELDS[type(x)]:
            v = getattr(x, name, None)
            if isinstance(v, ast.AST):
                out.append(v)
            elif isinstance(v, list):
                out += [y for y in v if isinstance(y, ast.AST)]
    return out


def _tree(source: str) -> ast.Module | Exception:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return e


def _text(node) -> str | None:
    return None if node is None else ast.unparse(node)


def _parameters(a: ast.arguments, skip_self: bool) -> list[dict]:
    out = []
    plain = [*a.posonlyargs, *a.args]
    values = [None] * (len(plain) - len(a.defaults)) + list(a.defaults)
    for i, (p, v) in enumerate(zip(plain, values)):
        if not (skip_self and i == 0 and p.arg in ("self", "cls")):
            out.append({"name": p.arg, "type_hint": _text(p.annotation), "default_value": _text(v), "is_required": v is None})
    if a.vararg:
        out.append({"name": "*" + a.vararg.arg, "type_hint": _text(a.vararg.annotation), "default_value": None, "is_required": False})
    for p, v in zip(a.kwonlyargs, a.kw_defaults):
        out.append({"name": p.arg, "type_hint": _text(p.annotation), "default_value": _text(v), "is_required": v is None})
    if a.kwarg:
        out.append({"name": "**" + a.kwarg.arg, "type_hint": _text(a.kwarg.annotation), "default_value": None, "is_required": False})
    return out


def _called(node) -> list[str]:
    names = []
    for x in _walk(node):
        if isinstance(x, ast.Call):
            f = x.func
            names.append(f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else "")
    return sorted({n for n in names if n})


_BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.comprehension, ast.match_case, ast.Assert)


def _complexity(node) -> int:
    return 1 + sum(isinstance(x, _BRANCHES) for x in _walk(node)) + sum(len(x.values) - 1 for x in _walk(node) if isinstance(x, ast.BoolOp))


def imported(tree: ast.Module) -> list[str]:
    out, open_ = set(), [tree]
    for x in open_:
        if isinstance(x, ast.Import):
            out.update(n.name for n in x.names)
        elif isinstance(x, ast.ImportFrom):
            out.add("." * x.level + (x.module or ""))
        else:  # imports are statements, so only blocks can hold them
            for block in ("body", "handlers", "orelse", "finalbody", "cases"):
                if isinstance(v := getattr(x, block, None), list):
                    open_ += v
    return sorted(out)


def python_components(path: str, source: str, tree: ast.Module | Exception | None = None, brief: bool = False) -> Iterator[dict]:
    """Components of a Python file; brief: only the nodes of a graph, with what they refer to. tree: what _tree gave for the source."""
    module, lines = module_path(path), source.split("\n")
    tree = tree or _tree(source)
    if isinstance(tree, Exception):
        yield _row(id=module, name=module.rpartition(".")[2], type="error", language="python", file_path=path, existing_docstring=str(tree)[:200])
        return
    names = imported(tree)

    def code(node) -> str:
        first = min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))])
        return "\n".join(lines[first - 1 : node.end_lineno])

    def function(node, owner: str | None) -> dict:
        kind = "function" if owner is None else "constructor" if node.name == "__init__" else "method"
        if brief:
            return {"id": f"{owner or module}.{node.name}", "name": node.name, "type": kind, "file_path": path, "start_line": node.lineno, "calls": _called(node)}
        decorators = [ast.unparse(d) for d in node.decorator_list]
        params = _parameters(node.args, owner is not None)
        own = [x for b in node.body for x in _walk(b)]
        raised = sorted({ast.unparse(x.exc.func if isinstance(x.exc, ast.Call) else x.exc) for x in own if isinstance(x, ast.Raise) and x.exc is not None})
        prefix = "async def" if isinstance(node, ast.AsyncFunctionDef) else "def"
        result = _text(node.returns)
        return _row(
            id=f"{owner or module}.{node.name}", name=node.name, type=kind, language="python", file_path=path, start_line=node.lineno, end_line=node.end_lineno,
            signature=f"{prefix} {node.name}({ast.unparse(node.args)})" + (f" -> {result}" if result else ""), parameters=params, return_type=result, decorators=decorators,
            existing_docstring=ast.get_docstring(node), calls=_called(node), imports=names, throws=raised, complexity=_complexity(node), lines_of_code=node.end_lineno - node.lineno + 1,
            is_async=isinstance(node, ast.AsyncFunctionDef), is_generator=any(isinstance(x, (ast.Yield, ast.YieldFrom)) for x in own), is_static="staticmethod" in decorators,
            is_class_method="classmethod" in decorators, is_abstract=any("abstractmethod" in d for d in decorators), visibility=visibility_of(node.name), source_code=code(node),
        )

    def visit(body, owner: str | None, inside: bool, top: bool) -> Iterator[dict]:
        for node in body:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                yield function(node, owner if inside else None)
                yield from visit(node.body, owner, False, False)
            elif isinstance(node, ast.ClassDef):
                key = f"{owner or module}.{node.name}"
                if brief:
                    yield {"id": key, "name": node.name, "type": "class", "file_path": path, "start_line": node.lineno, "parent_classes": [ast.unparse(b) for b in node.bases]}
                    yield from visit(node.body, key, True, False)
                    continue
                methods = [f"{key}.{x.name}" for x in node.body if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef))]
                attributes = []
                for x in node.body:
                    if isinstance(x, ast.FunctionDef) and x.name == "__init__":
                        for a in _walk(x):
                            targets = a.targets if isinstance(a, ast.Assign) else [a.target] if isinstance(a, (ast.AnnAssign, ast.AugAssign)) else []
                            attributes += [t.attr for t in targets if isinstance(t, ast.Attribute) and isinstance(t.value, ast.Name) and t.value.id == "self"]
                yield _row(
                    id=key, name=node.name, type="class", language="python", file_path=path, start_line=node.lineno, end_line=node.end_lineno, decorators=[ast.unparse(d) for d in node.decorator_list],
                    parent_classes=[ast.unparse(b) for b in node.bases], methods=methods, attributes=attributes, existing_docstring=ast.get_docstring(node), calls=_called(node), imports=names,
                    lines_of_code=node.end_lineno - node.lineno + 1, is_abstract=any("ABC" in ast.unparse(b) for b in node.bases), visibility=visibility_of(node.name), source_code=code(node),
                )
                yield from visit(node.body, key, True, False)
            elif isinstance(node, (ast.If, ast.Try, ast.With, ast.For, ast.While)) and owner is None:
                yield from visit([x for x in ast.iter_child_nodes(node) if isinstance(x, ast.stmt)], owner, inside, top)
            elif top and not brief and isinstance(node, (ast.Assign, ast.AnnAssign)):
                for t in node.targets if isinstance(node, ast.Assign) else [node.target]:
                    if isinstance(t, ast.Name):
                        yield _row(id=f"{module}.{t.id}", name=t.id, type="global_variable", language="python", file_path=path, start_line=node.lineno, end_line=node.end_lineno, source_code=code(node), visibility=visibility_of(t.id))

    yield _row(id=module, name=module.rpartition(".")[2], type="module", language="python", file_path=path, start_line=1, end_line=len(lines), existing_docstring=ast.get_docstring(tree), imports=names, lines_of_code=len(lines))
    yield from visit(tree.body, None, False, True)


def _row(**fields) -> dict:
    return {f.name: fields.get(f.name, [] if pa.types.is_list(f.type) else None) for f in COMPONENT}


# -- statements of Python functions
_KINDS = {
    ast.Assign: "ASSIGNMENT", ast.AnnAssign: "ASSIGNMENT", ast.AugAssign: "AUG_ASSIGNMENT", ast.Return: "RETURN", ast.If: "IF", ast.For: "FOR", ast.AsyncFor: "FOR", ast.While: "WHILE", ast.Try: "TRY",
    ast.With: "WITH", ast.AsyncWith: "WITH", ast.Raise: "RAISE", ast.Break: "BREAK", ast.Continue: "CONTINUE", ast.Pass: "PASS", ast.Assert: "ASSERT", ast.Delete: "DELETE", ast.Global: "GLOBAL",
    ast.Nonlocal: "NONLOCAL", ast.Import: "IMPORT", ast.ImportFrom: "IMPORT", ast.Match: "MATCH", ast.FunctionDef: "FUNCTION_DEF", ast.AsyncFunctionDef: "FUNCTION_DEF", ast.ClassDef: "CLASS_DEF",
}
#: Methods that change their object, so a call defines it anew.
MUTATING = frozenset("append extend insert remove pop clear sort reverse update setdefault add discard".split())


def _dotted(node: ast.Attribute) -> str:
    """The text of an attribute; that of a name's attributes without unparsing."""
    parts, x = [], node
    while isinstance(x, ast.Attribute):
        parts.append(x.attr)
        x = x.value
    if isinstance(x, ast.Name):
        return ".".join([x.id, *reversed(parts)])
    return ast.unparse(node) if isinstance(x, ast.Constant) else ""  # any other has signs beside names and dots


def _names(nodes) -> tuple[list[str], list[str], list[str]]:
    """Defined, used and called names of expressions; an attribute counts as its path and as its base."""
    defs, uses, calls = [], [], []
    for root in nodes:
        if root is None:
            continue
        for x in _walk(root):
            if isinstance(x, ast.Name):
                (defs if isinstance(x.ctx, (ast.Store, ast.Del)) else uses).append(x.id)
            elif isinstance(x, ast.Attribute):
                try:
                    path = _dotted(x)
                except ValueError:
                    continue
                if re.fullmatch(r"[\w.]+", path):
                    (defs if isinstance(x.ctx, ast.Store) else uses).append(path)
            elif isinstance(x, ast.Call):
                f = x.func
                calls.append(f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else "")
                if isinstance(f, ast.Attribute) and f.attr in MUTATING and isinstance(f.value, ast.Name):
                    defs.append(f.value.id)
    called = set(calls)
    return sorted(set(defs)), sorted({u for u in uses if u not in called}), sorted(called - {""})


def statements(path: str, source: str) -> Iterator[dict]:
    """Pre-order statements of every function, with ELSE, EXCEPT and FINALLY markers; ord is the key inside a function."""
    return (dict(zip(STATEMENT.names, s)) for s in _statements(path, source, _tree(source)))


def _statements(path: str, source: str, tree: ast.Module | Exception) -> Iterator[tuple]:
    if isinstance(tree, Exception):
        return
    module, lines = module_path(path), source.split("\n")

    def flat(body, depth, out):
        for node in body:
            if depth == 0 and not out and isinstance(node, ast.Expr) and isinstance(node.value, ast.Constant) and isinstance(node.value.value, str):
                continue
            kind = _KINDS.get(type(node)) or ("CALL" if isinstance(node, ast.Expr) and isinstance(node.value, ast.Call) else "EXPRESSION")
            heads = [x for f, x in ast.iter_fields(node) if f not in ("body", "orelse", "finalbody", "handlers", "cases", "decorator_list")]
            exprs = [y for x in heads for y in (x if isinstance(x, list) else [x]) if isinstance(y, ast.AST)]
            if kind in ("FUNCTION_DEF", "CLASS_DEF"):
                defs, uses, calls = [node.name], [], []
            else:
                defs, uses, calls = _names(exprs)
                if kind == "AUG_ASSIGNMENT":
                    uses = sorted({*uses, *defs})
            out.append((kind, node.lineno, node.end_lineno, depth, lines[node.lineno - 1].strip()[:200], defs, uses, calls))
            if kind in ("FUNCTION_DEF", "CLASS_DEF"):
                continue
            flat(getattr(node, "body", []), depth + 1, out)
            for h in getattr(node, "handlers", []):
                out.append(("EXCEPT", h.lineno, h.end_lineno, depth, lines[h.lineno - 1].strip()[:200], [h.name] if h.name else [], [], []))
                flat(h.body, depth + 1, out)
            for case in getattr(node, "cases", []):
                flat(case.body, depth + 1, out)
            rest = getattr(node, "orelse", [])
            if rest:
                if not (isinstance(node, ast.If) and len(rest) == 1 and isinstance(rest[0], ast.If)):
                    out.append(("ELSE", rest[0].lineno, rest[-1].end_lineno, depth, "else", [], [], []))
                    flat(rest, depth + 1, out)
                else:
                    flat(rest, depth, out)
            if getattr(node, "finalbody", []):
                out.append(("FINALLY", node.finalbody[0].lineno, node.finalbody[-1].end_lineno, depth, "finally", [], [], []))
                flat(node.finalbody, depth + 1, out)

    def visit(body, owner):
        for node in body:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                out: list[tuple] = []
                flat(node.body, 0, out)
                for i, s in enumerate(out):
                    yield (f"{owner}.{node.name}", i, *s)
                yield from visit(node.body, owner)
            elif isinstance(node, ast.ClassDef):
                yield from visit(node.body, f"{owner}.{node.name}")

    yield from visit(tree.body, module)


# -- languages of brackets
_BLANK = re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|\"{3}[\s\S]*?\"{3}|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`|(?<=[=(,:;!&|?{}\[\n])\s*/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/")
# these begin with the first letters of their words, so that the search runs over other text at once
_TYPE_HEAD = re.compile(r"[cier](?<!\w.)((?<=c)lass|(?<=i)nterface|(?<=e)num|(?<=r)ecord)\s+([A-Za-z_$][\w$]*)\s*(?:<[^{]*?>)?\s*(?:\([^)]*\))?\s*((?:extends|implements|permits)[^{]*)?\{")
_SCRIPT_FUNCTION = re.compile(r"\b(async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)\s*(?:<[^>]*>)?\s*\(")
_ARROW = re.compile(r"[clv](?<!\w.)(?:(?<=c)onst|(?<=l)et|(?<=v)ar)\s+([A-Za-z_$][\w$]*)\s*(?::[^=]+)?=\s*(async\s*)?(?:function\s*\*?\s*[\w$]*\s*)?(?:<[^>]*>\s*)?(?:\(|[A-Za-z_$][\w$]*\s*=>)")
_OBJECT = re.compile(r"[clvm](?<!\w.)(?:(?:(?<=c)onst|(?<=l)et|(?<=v)ar)\s+([A-Za-z_$][\w$]*)\s*(?::[^=;]+)?=|(?<=m)odule\.(exports)\s*=)\s*\{")
_MEMBER = re.compile(r"(?<=[{,\n])\s*((?:async\s+|get\s+|set\s+|\*\s*)*)([A-Za-z_$][\w$]*)\s*(?::\s*(?:async\s*)?(?:function\s*\*?\s*[\w$]*\s*)?)?\(")
_CALLBACK = re.compile(r"(?<=[(,])\s*(async\s+)?(?:function\s*\*?\s*([\w$]*)\s*\(([^()]*)\)\s*\{|(?:\(([^()]*)\)|([A-Za-z_$][\w$]*))\s*=>)")
_TYPE = r"[\w$.]+(?:<[^;(){}=]*>)?(?:\[\])*"
_METHOD = re.compile(
    r"(?:(?:(?<=^)|(?<=[;{}\n]))[ \t]*)((?:@\w+(?:\([^)]*\))?\s+|(?:public|private|protected|static|final|abstract|synchronized|native|default|async|readonly|override|get|set)\s+)*)"
    rf"(?:<[^>(]*>\s*)?(?:({_TYPE})[ \t]+)?([A-Za-z_$#][\w$]*)[ \t]*\("
)
_BRACE = re.compile(r"[^;{}()=]*(?:\{[^{}]*\}\s*)?(?:=>\s*)?\{")
_STOP = re.compile(r"[^;{}]*;|[^\n]*")
_CALL = re.compile(r"([A-Za-z_$][\w$]*)\s*\(")
_NOT_NAMES = frozenset("if for while switch catch return function new throw else do try synchronized super this typeof await constructorless".split())
_JAVA_BRANCH = re.compile(r"\b(?:if|for|while|case|catch)\b|&&|\|\||\?(?![^<>]*>)")


def blanked(text: str) -> str:
    """text with comments and strings as blanks of equal length."""
    return _BLANK.sub(lambda m: " " * len(s) if "\n" not in (s := m.group(0)) else re.sub(r"[^\n]", " ", s), text)


def bracket_pairs(text: str) -> dict[int, int]:
    pairs, stack, opens = {}, [], {")": "(", "]": "[", "}": "{"}
    for m in re.finditer(r"[()\[\]{}]", text):
        c = m.group(0)
        if c in "([{":
            stack.append(m.start())
        elif stack and text[stack[-1]] == opens[c]:
            pairs[stack.pop()] = m.start()
    return pairs


def block_end(lines: list[str], start: int) -> int:
    """The 1-based line where the bracket depth returns to 0, from a 1-based start; the start itself if nothing opens."""
    depth, opened = 0, False
    for i in range(start - 1, len(lines)):
        depth += lines[i].count("{") - lines[i].count("}")
        opened |= "{" in lines[i]
        if opened and depth <= 0:
            return i + 1
    return start if not opened else len(lines)


def balanced_condition(text: str) -> str:
    """The inside of the first balanced parentheses; empty if there are none."""
    at = text.find("(")
    end = bracket_pairs(text).get(at) if at >= 0 else None
    return text[at + 1 : end].strip() if end is not None else ""


def _script_parameters(inside: str) -> list[dict]:
    out, depth, part = [], 0, ""
    for c in inside + ",":
        if c == "," and depth == 0:
            p = part.strip()
            if p:
                left, _, value = p.partition("=")
                name, _, hint = left.partition(":")
                words = re.sub(r"@\w+(?:\([^)]*\))?|\b(?:final|public|private|protected|readonly)\b", " ", name).split()
                java = len(words) > 1 and not hint
                out.append({"name": (words[-1] if words else "").rstrip("?"), "type_hint": (" ".join(words[:-1]) if java else hint.strip()) or None, "default_value": value.strip() or None, "is_required": not value.strip() and "?" not in name and "..." not in name})
            part = ""
        else:
            depth += (c in "([{<") - (c in ")]}>")
            part += c
    return out


def _comment_before(text: str, at: int) -> str | None:
    """The text of the documentation comment that ends right before a place, annotations and modifiers between aside."""
    before = text[max(0, at - 4000) : at]
    m = re.search(r"\*/\s*(?:(?:@\w+(?:\([^)]*\))?|export|default|public|private|protected|static|final|abstract|async)\s+)*$", before)
    start = before.rfind("/**", 0, m.start() + 1) if m else -1
    return re.sub(r"^\s*\*\s?", "", before[start + 3 : m.start()], flags=re.M).strip() if start >= 0 else None


def bracket_components(path: str, source: str, language: str, brief: bool = False) -> Iterator[dict]:
    """Components of a JavaScript, TypeScript or Java file; brief: only the nodes of a graph, with what they refer to."""
    module, bare = module_path(path), blanked(source)
    pairs = bracket_pairs(bare)
    line = lambda i: source.count("\n", 0, i) + 1
    imports = sorted(set(re.findall(r"^\s*import\s+(?:static\s+)?([\w.*]+)\s*;", source, re.M) if language == "java" else re.findall(r"(?:from\s+|require\(\s*|^\s*import\s+)['\"]([^'\"]+)['\"]", source, re.M)))
    classes, taken = [], []
    for m in _TYPE_HEAD.finditer(bare):
        end = pairs.get(m.end() - 1)
        if end is not None:
            parents = re.findall(r"[\w$.]+", re.sub(r"<[^>]*>|\b(?:extends|implements|permits)\b", " ", m.group(3) or ""))
            classes.append((m.start(), m.end() - 1, end, m.group(2), parents))

    def owner(at: int) -> str:
        names = [c[3] for c in classes if c[1] < at < c[2]]
        return ".".join([module, *names])

    def function(kind, name, start, open_, prefix, result, is_async):
        close = pairs.get(open_)
        if close is None:
            return None
        brace = _BRACE.match(bare, close + 1)
        first = brace.end() - 1 if brace else None
        end = pairs.get(first) if first is not None else None
        if end is None:
            end = _STOP.match(bare, close + 1).end() - 1
        body = bare[close:end]
        calls = sorted({c for c in _CALL.findall(body) if c not in _NOT_NAMES})
        if brief:
            return {"id": f"{owner(start)}.{name}", "name": name, "type": kind, "file_path": path, "start_line": line(start), "calls": calls, "source_code": source[start : end + 1]}
        found = re.match(r"\s*throws\s+([\w., ]+)", bare[close + 1 : end])
        throws = re.findall(r"[\w.]+", found.group(1)) if found else sorted(set(re.findall(r"\bthrow\s+new\s+([\w.]+)", body)))
        hint = re.match(r"\s*:\s*([^={;]+)", bare[close + 1 : first or end])
        shown = "private" if "private" in prefix or name.startswith("#") else "protected" if "protected" in prefix else "public" if "public" in prefix or language != "java" else "package"
        return _row(
            id=f"{owner(start)}.{name}", name=name, type=kind, language=language, file_path=path, start_line=line(start), end_line=line(end), signature=re.sub(r"\s+", " ", source[start : close + 1]).strip(),
            parameters=_script_parameters(source[open_ + 1 : close]), return_type=(result or "").strip() or (hint.group(1).strip() if hint else None), decorators=re.findall(r"@\w+(?:\([^)]*\))?", prefix),
            existing_docstring=_comment_before(source, start), calls=calls, imports=imports, throws=throws, complexity=1 + len(_JAVA_BRANCH.findall(body)), lines_of_code=line(end) - line(start) + 1,
            is_async=is_async, is_generator="yield" in body, is_static="static" in prefix.split(), is_abstract="abstract" in prefix.split(), visibility=shown, source_code=source[start : end + 1],
        )

    rows = []
    if language != "java":
        for m in _SCRIPT_FUNCTION.finditer(bare) if "function" in bare else ():
            r = function("function", m.group(2), m.start(), m.end() - 1, "", None, bool(m.group(1)))
            if r:
                rows.append(r)
                taken.append((m.start(), pairs.get(m.end() - 1, m.end())))
        for m in _ARROW.finditer(bare):
            if bare[m.end() - 1] == "(":
                close = pairs.get(m.end() - 1)
                if close is None or not re.match(r"[^;{}=]*(?:=>|\{)", bare[close + 1 :]) or ("=>" not in bare[close + 1 : close + 200].split("{")[0] and "function" not in m.group(0)):
                    continue
                r = function("function", m.group(1), m.start(), m.end() - 1, "", None, bool(m.group(2)))
                if r:
                    rows.append(r)
        # methods of object literals that a name holds, and functions given as arguments
        for m in _OBJECT.finditer(bare):
            end = pairs.get(m.end() - 1)
            if end is None:
                continue
            at = m.end()
            while (x := _MEMBER.search(bare, at)) is not None and x.start() < end:
                nested = next((pairs[i] for i in range(at, x.start(1)) if bare[i] in "{(" and i in pairs and pairs[i] > x.start(1)), None)
                if nested is not None:  # the match stands inside another member
                    at = nested
                    continue
                open_paren = x.end() - 1
                close = pairs.get(open_paren)
                shown = re.compile(r"\s*(?::[^={]+)?(?:=>|\{)").match(bare, close + 1) if close is not None else None
                if shown is None or x.group(2) in _NOT_NAMES:
                    at = x.end()
                    continue
                r = function("method", x.group(2), x.start(1) if x.group(1) else x.start(2), open_paren, "", None, "async" in x.group(0))
                if r:
                    r["id"] = f"{owner(m.start())}.{m.group(1) or m.group(2)}.{x.group(2)}"
                    rows.append(r)
                at = max(x.end(), x.start(2) + len(r["source_code"]) - 1) if r else x.end()
    for start, open_, end, name, parents in classes:
        inner = [c for c in classes if open_ < c[0] and c[2] < end]
        methods, fields = [], []
        at = open_
        while True:
            m = _METHOD.search(bare, at)
            if m is None or m.start() >= end:
                break
            inside = next((c for c in inner if c[1] < m.end() < c[2]), None)
            if inside:
                at = inside[2]
                continue
            kind_name, open_paren = m.group(3), m.end() - 1
            close = pairs.get(open_paren)
            if kind_name in _NOT_NAMES or close is None:
                at = m.end()
                continue
            ctor = kind_name == "constructor" if language != "java" else kind_name == name and not m.group(2)
            if language == "java" and not ctor and not m.group(2):
                at = m.end()
                continue
            begin = m.start() + len(m.group(0)) - len(m.group(0).lstrip(" \n\t\r;{}*/"))
            r = function("constructor" if ctor else "method", kind_name, begin, open_paren, source[m.start(1) : m.end(1)], m.group(2) if language == "java" else None, "async" in (m.group(1) or "").split())
            if r is None:
                at = m.end()
                continue
            methods.append(r)
            at = max(close, begin + len(r["source_code"]) - 1)
        key = owner(start) + f".{name}"
        if brief:
            yield {"id": key, "name": name, "type": "class", "file_path": path, "start_line": line(start), "parent_classes": parents}
            yield from methods
            continue
        body = bare[open_ + 1 : end]
        for f in re.finditer(rf"^[ \t]*((?:(?:public|private|protected|static|final|readonly|volatile|transient)[ \t]+)*)({_TYPE}[ \t]+)?([A-Za-z_$#][\w$]*)[ \t]*(?::[^=;\n]+)?(?:=[^;\n]*)?;", body, re.M):
            if body.count("{", 0, f.start()) == body.count("}", 0, f.start()) and f.group(3) not in _NOT_NAMES and not re.match(r"\s*(?:return|import|package|break|continue)\b", f.group(0)):
                fields.append((f.group(3), "static" in f.group(1).split(), open_ + 1 + f.start(3)))
        yield _row(
            id=key, name=name, type="class", language=language, file_path=path, start_line=line(start), end_line=line(end), parent_classes=parents, methods=[r["id"] for r in methods], attributes=[f[0] for f in fields],
            existing_docstring=_comment_before(source, start), imports=imports, lines_of_code=line(end) - line(start) + 1, source_code=source[start : end + 1],
        )
        yield from methods
        for f, static, where in fields:
            yield _row(id=f"{key}.{f}", name=f, type="static_field" if static else "field", language=language, file_path=path, start_line=line(where), end_line=line(where), is_static=static)
    yield from rows
    yield _row(id=module, name=module.rpartition(".")[2], type="module", language=language, file_path=path, start_line=1, end_line=source.count("\n") + 1, imports=imports, lines_of_code=source.count("\n") + 1)


def inline_functions(source: str) -> list[dict]:
    """(line, name, parameters, is_async) of functions that are arguments of a call."""
    bare = blanked(source)
    return [
        {"line": bare.count("\n", 0, m.start() + len(m.group(0)) - len(m.group(0).lstrip())) + 1, "name": m.group(2) or None, "parameters": [p["name"] for p in _script_parameters(m.group(3) or m.group(4) or m.group(5) or "")], "is_async": bool(m.group(1))}
        for m in _CALLBACK.finditer(bare)
    ]


# How lines of the languages of brackets are classed, in order.
LINE_KINDS = [
    ("IF", r"^(?:\}\s*)?(?:else\s+)?if\s*\("), ("ELSE", r"^(?:\}\s*)?else\b"), ("FOR", r"^for\s*\("), ("WHILE", r"^while\s*\("), ("WHILE", r"^do\b"), ("TRY", r"^try\b"), ("EXCEPT", r"^(?:\}\s*)?catch\b"),
    ("FINALLY", r"^(?:\}\s*)?finally\b"), ("SWITCH", r"^switch\s*\("), ("RETURN", r"^return\b"), ("RAISE", r"^throw\b"), ("BREAK", r"^break\b"), ("CONTINUE", r"^continue\b"),
    ("ASSIGNMENT", r"^(?:(?:const|let|var|final)\s+)?[\w$.\[\]<>, ]+?\s*(?::[^=]+)?[-+*/]?=(?!=)"), ("CALL", r"^(?:await\s+)?[\w$.]+\s*\("),
]


def snippet_statements(source: str, start_line: int = 1) -> list[dict]:
    """Statements of a JavaScript, TypeScript or Java body, a row a line that is neither empty nor only brackets."""
    bare, out = blanked(source).split("\n"), []
    true = source.split("\n")
    for i, text in enumerate(bare):
        line = text.strip()
        if not line.strip("{}();, "):
            continue
        kind = next((k for k, p in LINE_KINDS if re.match(p, line)), "EXPRESSION")
        defs = []
        if kind == "ASSIGNMENT":
            defs = re.findall(r"([A-Za-z_$][\w$.]*)\s*(?::[^=]+)?[-+*/]?=(?!=)", line)[:1]
        calls = [c for c in re.findall(r"([A-Za-z_$][\w$]*)\s*\(", line) if c not in _NOT_NAMES]
        uses = [u for u in re.findall(r"(?<![.\w$])[A-Za-z_$][\w$]*", line.partition("=")[2] if defs else line) if u not in calls and u not in _NOT_NAMES]
        end = block_end(bare, i + 1) if "{" in line and kind in ("IF", "ELSE", "FOR", "WHILE", "TRY", "EXCEPT", "FINALLY", "SWITCH") else i + 1
        out.append({"ord": len(out), "type": kind, "line": start_line + i, "end_line": start_line + end - 1, "depth": 0, "code": true[i].strip()[:200], "defs": defs, "uses": sorted(set(uses)), "calls": sorted(set(calls))})
    return out


# -- endpoints
# Verbs of frameworks' decorators and mappings.
VERBS = "get|post|put|delete|patch"
FRAMEWORKS = [
    ("fastapi", r"\bfastapi\b", r"@(?:app|router)\.(?:" + VERBS + r")"), ("flask", r"\bflask\b", r"@(?:app|blueprint|bp)\.route"), ("express", r"\bexpress\b", r"\b(?:app|router)\.(?:" + VERBS + r")\("),
    ("spring", r"springframework", r"@(?:Get|Post|Put|Delete|Patch|Request)Mapping"), ("django", r"\bdjango\b", r"@(?:csrf_exempt|require_http_methods)"),
]


def framework(source: str) -> str | None:
    for name, imports, marks in FRAMEWORKS:
        if re.search(imports, source, re.I) or re.search(marks, source):
            return name
    return None


def endpoints(path: str, source: str) -> Iterator[tuple[str, str, str, str, str, list[str], int]]:
    """(file, framework, method, path, handler, path parameters, status) of the endpoints of a file; a handler stands within nine lines."""
    kind, lines = framework(source), source.split("\n")

    def handler(i: int, pattern: str) -> str | None:
        for text in lines[i + 1 : i + 10]:
            m = re.search(pattern, text)
            if m:
                return m.group(1)
        return None

    for i, text in enumerate(lines):
        if kind == "fastapi":
            m = re.search(rf"@\w+\.({VERBS})\(\s*['\"]([^'\"]*)['\"]", text)
            name = handler(i, r"def\s+(\w+)") if m else None
            if name:
                status = re.search(r"status_code\s*=\s*(\d+)", text)
                yield path, kind, m.group(1).upper(), m.group(2), name, re.findall(r"\{(\w+)", m.group(2)), int(status.group(1)) if status else 200
        elif kind == "flask":
            m = re.search(r"@\w+\.route\(\s*['\"]([^'\"]*)['\"]", text)
            name = handler(i, r"def\s+(\w+)") if m else None
            if name:
                methods = re.search(r"methods\s*=\s*[\[(]([^\])]*)", text)
                for verb in re.findall(r"['\"](\w+)['\"]", methods.group(1)) if methods else ["GET"]:
                    yield path, kind, verb.upper(), m.group(1), name, re.findall(r"<(?:\w+:)?(\w+)>", m.group(1)), 200
        elif kind == "express":
            m = re.search(rf"\b(?:app|router)\.({VERBS})\(\s*['\"`]([^'\"`]*)['\"`]\s*,\s*(?:async\s+)?(?:function\s+)?(\w+)?", text)
            if m:
                yield path, kind, m.group(1).upper(), m.group(2), m.group(3) or "anonymous", re.findall(r":(\w+)", m.group(2)), 200
        elif kind == "spring":
            m = re.search(r"@(Get|Post|Put|Delete|Patch|Request)Mapping(?:\(\s*(?:value\s*=\s*)?['\"]([^'\"]*)['\"])?", text)
            name = handler(i, r"(?:public|private|protected)\s+[\w<>\[\], ]+\s+(\w+)\s*\(") if m else None
            if name:
                where = m.group(2) or "/"
                yield path, kind, "GET" if m.group(1) == "Request" else m.group(1).upper(), where, name, re.findall(r"\{(\w+)", where), 200


# -- operators
def _mapped(files: DataFrame, rule, schema: pa.Schema, path: str, value: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = [r for p, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in rule(p or "", v or "")]
            if rows:
                yield from pa.Table.from_pylist(rows, schema=schema).to_batches()

    return files.select(F.col(path), F.col(value)).mapInArrow(run, ddl(schema))


LANGUAGE_OF = {"py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java"}


def components(files: DataFrame, path: str = "path", value: str = "value") -> DataFrame:
    """Component rows of all files of the four languages; a dispatch by suffix stands for a registry of adapters."""
    def rule(p, v):
        language = LANGUAGE_OF.get(p.rpartition(".")[2].lower())
        if language == "python":
            return python_components(p, v)
        return bracket_components(p, v, language) if language else ()

    return _mapped(files.filter(suffix_language(path).isNotNull()), rule, COMPONENT, path, value)


def function_statements(files: DataFrame, path: str = "path", value: str = "value") -> DataFrame:
    return _mapped(files.filter(F.lower(F.col(path)).endswith(".py")), statements, STATEMENT, path, value)


def component_statements(parts: DataFrame, key: str = "id", source: str = "source_code") -> DataFrame:
    """Statements of components in languages of brackets."""
    return _mapped(parts, lambda k, v: ({"func_id": k, **s} for s in snippet_statements(v)), STATEMENT, key, source)


def python_statements(parts: DataFrame, key: str = "id", source: str = "source_code") -> DataFrame:
    """Statements of Python components by their own texts; func_id is the component's key, with what is nested in it after a bar."""

    def rule(k, v):
        for s in statements("own.py", textwrap.dedent(v)):
            yield {**s, "func_id": f"{k}|{s['func_id']}"}

    return _mapped(parts, rule, STATEMENT, key, source)


#: Rows of components (ord is null) and of statements, as far as a graph needs them.
GRAPH = pa.schema(
    [(x, pa.string()) for x in ("id", "name", "type", "file_path", "code")] + [(x, pa.int32()) for x in ("start_line", "ord", "line", "depth")]
    + [(x, pa.list_(pa.string())) for x in ("calls", "imports", "parent_classes", "defs", "uses")]
)


_BRIEF = ("id", "name", "type", "file_path", "start_line", "calls", "imports", "parent_classes")


def graph_rows(path: str, source: str) -> tuple[list[dict], list[tuple]]:
    """The nodes of a graph that a file holds and the statements of its functions as tuples of STATEMENT, by one reading."""
    language = LANGUAGE_OF.get(path.rpartition(".")[2].lower())
    if language == "python":
        tree = _tree(source)
        return list(python_components(path, source, tree, brief=True)), list(_statements(path, source, tree))
    return list(bracket_components(path, source, language, brief=True)) if language else [], []


def graph_parts(files: DataFrame, path: str = "path", value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(components, statements) for flow.ckg; every file is read once, and all rows of an id lie together.

    Of statements of one place, where a function is defined again, the first in the file stands.
    """

    def run(batches, step=256):
        for batch in batches:
            for k in range(0, batch.num_rows, step):
                parts, found = [], []
                for p, v in zip(*(batch.column(i).slice(k, step).to_pylist() for i in range(2))):
                    a, b = graph_rows(p or "", v or "")
                    parts += a
                    found += b
                said = dict(zip(("id", *STATEMENT.names[1:]), zip(*found)))
                for n, column in ((len(parts), lambda name: [r.get(name) for r in parts] if name in _BRIEF else None), (len(found), said.get)):
                    yield pa.RecordBatch.from_arrays([pa.nulls(n, f.type) if (c := column(f.name)) is None else pa.array(c, f.type) for f in GRAPH], schema=GRAPH)

    rows = files.filter(suffix_language(path).isNotNull()).select(F.col(path), F.col(value)).mapInArrow(run, ddl(GRAPH))
    w = Window.partitionBy("id", "ord").orderBy("line", "code")
    rows = rows.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id").withColumn("place", F.row_number().over(w))
    rows = rows.filter("ord IS NULL OR place = 1").drop("place").persist()
    found = rows.filter("ord IS NOT NULL").select(F.col("id").alias("func_id"), "ord", "type", "line", "depth", "code", "defs", "uses", "calls")
    return rows.filter("ord IS NULL").select(*_BRIEF), found


ENDPOINT = pa.schema([("file_path", pa.string()), ("framework", pa.string()), ("method", pa.string()), ("http_path", pa.string()), ("handler", pa.string()), ("path_parameters", pa.list_(pa.string())), ("status", pa.int32())])


def api_endpoints(files: DataFrame, path: str = "path", value: str = "value") -> DataFrame:
    return _mapped(files, lambda p, v: (dict(zip(ENDPOINT.names, e)) for e in endpoints(p, v)), ENDPOINT, path, value)


OWN = pa.schema(
    [("id", pa.string()), ("name", pa.string()), ("type", pa.string()), ("parameters", pa.list_(pa.struct([("name", pa.string()), ("type_hint", pa.string()), ("default_value", pa.string())]))), ("return_type", pa.string())]
    + [(x, pa.list_(pa.string())) for x in ("decorators", "methods", "parents")] + [("is_async", pa.bool_()), ("is_static", pa.bool_())]
)


def own_component(name: str, kind: str, language: str, source: str) -> dict | None:
    """What a component's own text says of it: the definition of its name, read out of its file.

    Methods are read inside a class of any name; names of decorators and methods are given without arguments and owners.
    """
    member = kind in ("method", "constructor")
    if language == "python":
        found = python_components("own.py", textwrap.dedent(source))
    else:
        shell = name if language == "java" and kind == "constructor" else "Owner"
        found = bracket_components("own", f"class {shell} {{\n{source}\n}}" if member else source, language)
    x = next((x for x in found if x["name"] == name and (x["type"] == "class") == (kind == "class") and x["type"] in ("function", "method", "constructor", "class")), None)
    if x is None:
        return None
    parameters = [{k: p[k] for k in ("name", "type_hint", "default_value")} for p in x["parameters"] or []]
    if member and language == "python" and parameters and parameters[0]["name"] in ("self", "cls"):
        parameters = parameters[1:]
    return {
        "name": name, "type": x["type"], "parameters": parameters, "return_type": x["return_type"], "decorators": [re.match(r"@?([\w.]+)", d).group(1) for d in x["decorators"] or []],
        "methods": [m.rpartition(".")[2] for m in x["methods"] or []], "parents": x["parent_classes"] or [], "is_async": bool(x["is_async"]), "is_static": bool(x["is_static"]),
    }


def own_components(parts: DataFrame) -> DataFrame:
    """own_component of each function, method, constructor and class row (id, name, type, language, source_code); null name where it is not found."""

    def run(batches):
        for batch in batches:
            rows = []
            for key, name, kind, language, source in zip(*(batch.column(i).to_pylist() for i in range(5))):
                rows.append({"id": key, **(own_component(name or "", kind, language, source or "") or {})})
            yield from pa.Table.from_pylist(rows, schema=OWN).to_batches()

    some = parts.filter(F.col("type").isin("function", "method", "constructor", "class") & F.col("language").isin("python", "javascript", "typescript", "java"))
    parameter = "parameters array<struct<name:string,type_hint:string,default_value:string>>"
    lists = ", ".join(f"{x} array<string>" for x in ("decorators", "methods", "parents"))
    return some.select("id", "name", "type", "language", "source_code").mapInArrow(run, f"id string, name string, type string, {parameter}, return_type string, {lists}, is_async boolean, is_static boolean")


# -- an independent reader of Python by regular expressions, to hold the first against
_GOLD = re.compile(r"^([ \t]*)(?:(class)\s+(\w+)|(?:async\s+)?(def)\s+(\w+))", re.M)


def gold_python(path: str, source: str) -> Iterator[dict]:
    """(name, type, line) of Python definitions by their heads alone, strings and comments blanked."""
    bare = re.sub(r"\"{3}[\s\S]*?\"{3}|'{3}[\s\S]*?'{3}|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|#[^\n]*", lambda m: re.sub(r"[^\n]", " ", m.group(0)), source)
    open_: list[tuple[int, str]] = []
    for m in _GOLD.finditer(bare):
        indent = len(m.group(1).expandtabs(8))
        while open_ and open_[-1][0] >= indent:
            open_.pop()
        name = m.group(3) or m.group(5)
        kind = "class" if m.group(2) else "method" if open_ and open_[-1][1] == "class" else "function"
        if kind == "method" and name == "__init__":
            kind = "constructor"
        open_.append((indent, "class" if m.group(2) else "def"))
        yield {"file_path": path, "name": name, "type": kind, "line": bare.count("\n", 0, m.start()) + 1 + m.group(0).count("\n")}


_GOLD_HEADS = [
    ("class", re.compile(r"^(\s*)(?:export\s+|default\s+|public\s+|abstract\s+|final\s+|private\s+|protected\s+|static\s+)*class\s+(\w+)")),
    ("function", re.compile(r"^(\s*)(?:export\s+|default\s+)*(?:async\s+)?function\s*\*?\s*([\w$]+)")),
    ("function", re.compile(r"^(\s*)(?:export\s+)?(?:const|let|var)\s+([\w$]+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:function\b|\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^=]+)?=>|[\w$]+\s*=>)")),
    ("method", re.compile(r"^(\s+)(?:(?:public|private|protected|static|final|abstract|async|override|synchronized)\s+)*(?:[\w$.<>\[\], ?]+\s+)?([\w$#]+)\s*\((?:[^;]*)\)\s*(?::[^{;]+)?(?:throws\s+[\w., ]+)?\{\s*$")),
]


def gold_brackets(path: str, source: str) -> Iterator[dict]:
    """(name, type, line) of JavaScript, TypeScript and Java definitions by their head lines and indents alone, strings and comments blanked."""
    open_: list[tuple[int, str, str]] = []
    for i, line in enumerate(blanked(source).split("\n"), 1):
        if not line.strip() or not line[len(line) - len(line.lstrip())].isalpha() and not line.lstrip().startswith(("_", "$", "#")):
            continue
        indent = len(line.expandtabs(4)) - len(line.expandtabs(4).lstrip())
        while open_ and open_[-1][0] >= indent:
            open_.pop()
        kind, name = next(((k, m.group(2)) for k, p in _GOLD_HEADS if (m := p.match(line))), (None, None))
        if kind is None or name in _NOT_NAMES or (kind == "method" and (not open_ or open_[-1][1] != "class")):
            continue
        if kind == "method" and name in ("constructor", open_[-1][2]):
            kind = "constructor"
        open_.append((indent, "class" if kind == "class" else "def", name))
        yield {"file_path": path, "name": name, "type": kind, "line": i}


GOLD = pa.schema([("file_path", pa.string()), ("name", pa.string()), ("type", pa.string()), ("line", pa.int32())])


def gold_components(files: DataFrame, path: str = "path", value: str = "value") -> DataFrame:
    def rule(p, v):
        return gold_python(p, v) if p.lower().endswith(".py") else gold_brackets(p, v)

    return _mapped(files.filter(suffix_language(path).isNotNull()), rule, GOLD, path, value)
