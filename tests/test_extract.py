"""Extraction and flow graphs on small sources."""

from pyspark.sql import functions as F

from oresieve.operators import extract, flow, validation
from oresieve.operators.insertion import inserted

PYTHON = '''"""Module text."""
import os

LIMIT = 3


def helper(a, b=1, *rest, key: int = 0, **more) -> int:
    """Adds."""
    total = a
    for x in rest:
        if x > 1:
            total = total + x
        elif x < 0:
            break
        else:
            continue
    return total


class Box(Base):
    """A box."""

    def __init__(self, size):
        self.size = size
        self.items = []

    @staticmethod
    async def fill(n):
        y = n
        helper(y)
        yield y
'''
SCRIPT = """import { a } from './x';
/** Sums. */
export async function sum(p, q = 2) { if (p) { return q; } return call(p); }
const twice = (n) => { return n * 2; };
class Cart extends Base {
  constructor(x) { super(x); }
  /** Total of all. */
  total(items) { return items.map((i) => i.price); }
}
"""
JAVA = """package a;
import java.util.List;
public class Shop extends Base implements Open {
    private int count = 1;
    public Shop(int n) { count = n; }
    /** Sells. */
    public static List<String> sell(String what, int n) throws IOException { if (n > 1 && what != null) { log(what); } return null; }
}
"""


def rows(path, text, language):
    found = extract.python_components(path, text) if language == "python" else extract.bracket_components(path, text, language)
    return {r["id"]: r for r in found}


def test_python_components():
    r = rows("pkg/mod.py", PYTHON, "python")
    assert {"pkg.mod", "pkg.mod.LIMIT", "pkg.mod.helper", "pkg.mod.Box", "pkg.mod.Box.__init__", "pkg.mod.Box.fill"} == set(r)
    h = r["pkg.mod.helper"]
    assert [p["name"] for p in h["parameters"]] == ["a", "b", "*rest", "key", "**more"] and h["return_type"] == "int" and h["existing_docstring"] == "Adds."
    assert r["pkg.mod.Box"]["parent_classes"] == ["Base"] and r["pkg.mod.Box"]["attributes"] == ["size", "items"]
    assert r["pkg.mod.Box.fill"]["is_static"] and r["pkg.mod.Box.fill"]["is_async"] and r["pkg.mod.Box.fill"]["is_generator"]


def test_syntax_error_is_one_row():
    r = list(extract.python_components("bad.py", "def f(:\n"))
    assert [x["type"] for x in r] == ["error"]


def test_script_and_java_components():
    r = rows("src/cart.js", SCRIPT, "javascript")
    assert r["src.cart.sum"]["is_async"] and r["src.cart.sum"]["existing_docstring"] == "Sums." and r["src.cart.twice"]["type"] == "function"
    assert r["src.cart.Cart.constructor"]["type"] == "constructor" and r["src.cart.Cart.total"]["existing_docstring"] == "Total of all."
    j = rows("a/Shop.java", JAVA, "java")
    assert j["a.Shop.Shop.sell"]["throws"] == ["IOException"] and j["a.Shop.Shop.sell"]["complexity"] == 3 and j["a.Shop.Shop.Shop"]["type"] == "constructor"
    assert j["a.Shop.Shop.count"]["type"] == "field" and j["a.Shop.Shop"]["parent_classes"] == ["Base", "Open"]


def test_control_flow_nests_loops_and_breaks():
    s = [x for x in extract.statements("m.py", PYTHON) if x["func_id"] == "m.helper"]
    kinds = [x["type"] for x in s]
    assert kinds == ["ASSIGNMENT", "FOR", "IF", "ASSIGNMENT", "IF", "BREAK", "ELSE", "CONTINUE", "RETURN"]
    edges = set(flow.control_flow([(x["ord"], x["type"], x["depth"], x["code"]) for x in s]))
    assert (1, 2, "true") in edges and (3, 1, "back") in edges and (5, 8, "flow") in edges and (7, 1, "back") in edges and (1, 8, "false") in edges and (8, flow.EXIT, "flow") in edges


def test_dependence_edges(spark):
    text = "def f():\n    x = 1\n    y = x\n    x = 2\n    z = x\n    if z:\n        w = y\n        v = w\n"
    s = extract.function_statements(spark.createDataFrame([("m.py", text)], "path string, value string")).persist()
    data = {(r.source, r.target, r.variable) for r in flow.data_dependence(s).collect()}
    assert {(0, 1, "x"), (2, 3, "x"), (3, 4, "z"), (1, 5, "y"), (5, 6, "w")} == data
    control = {(r.source, r.target, r.type) for r in flow.control_dependence(s).collect()}
    assert control == {(4, 5, "guard"), (4, 6, "guard")}
    cfg = flow.cfg_edges(s)
    reach = {(r.source, r.target, r.variable) for r in flow.reaching_definitions(s, cfg).collect()}
    assert reach == data
    hpg = flow.hpg_edges(cfg, flow.pdg_edges(s))
    assert hpg.filter("type = 'data'").count() == 5 and hpg.filter("source = target").count() == 0


def test_knowledge_graph(spark):
    files = spark.createDataFrame([("pkg/mod.py", PYTHON), ("pkg/empty.py", None), ("notes.txt", "x")], "path string, value string")
    c = extract.components(files).persist()
    s = extract.function_statements(files).persist()
    nodes, edges = flow.ckg(c, s, flow.cfg_edges(s), flow.data_dependence(s))
    counts = {r.type: r["count"] for r in edges.groupBy("type").count().collect()}
    assert counts["control_flow"] > 0 and counts["data_flow"] > 0 and counts["calls"] >= 1 and counts["contains"] > 5
    ids = {r.id for r in nodes.collect()}
    assert all(r.src in ids and r.dst in ids for r in edges.collect())


def test_knowledge_graph_plan(spark, sf):
    # the driver holds a plan for every query stage: joins must not multiply with the kinds of edges, nor files be read again for each use
    import __spark_entry__ as entry

    plan = entry.queries()["knowledge_graph"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2 and plan.count("InMemoryRelation") <= 8
    spark.catalog.clearCache()


def test_knowledge_graph_of_doubles(spark):
    """Ids that occur twice, parents that are no nodes and names that nothing has, against the definition written out."""
    row = "id string, name string, type string, file_path string, start_line int, calls array<string>, imports array<string>, parent_classes array<string>"
    c = spark.createDataFrame(
        [
            ("p.m", "m", "module", "p/m.py", 1, ["f"], ["p.n", "gone", None], None), ("p.n", "N", "module", "p/n.py", 1, None, [], []), ("p.m.f", "f", "function", "p/m.py", 9, ["F", "g", "A"], ["p.n"], []),
            ("p.m.f", "f", "function", "p/m.py", 2, ["f"], [], []), ("p.m.A", "A", "class", "p/m.ts", 4, [], [], ["x.a", "I"]), ("p.m.A", "A", "interface", "p/m.ts", 3, [], [], ["A"]),
            ("p.m.I", "I", "interface", "p/m.ts", 8, [], [], ["A"]), ("p.m.I.h", "h", "method", "p/m.ts", 8, ["m"], [], []), ("p.m.e", "e", "field", "p/m.ts", 8, [], [], []), (None, "f", "function", "q.py", 1, ["f"], [], []), ("q.F", "F", "constructor", "q.py", 1, [], [], []),
        ], row)
    s = spark.createDataFrame([("p.m.f", 0, "IF", 0, "if a:", 3, ["a"], ["b"], []), ("p.m.f", 1, "RETURN", 1, "return a", 4, [], ["a"], []), ("gone.f", 0, "PASS", 0, "pass", 1, [], None, [])], "func_id string, ord int, type string, depth int, code string, line int, defs array<string>, uses array<string>, calls array<string>")
    nodes, edges = flow.ckg(c, s, flow.cfg_edges(s), flow.data_dependence(s))
    assert sorted((r.id or "", r.type, r.line) for r in nodes.collect()) == [
        ("", "function", 1), ("gone.f:0", "statement", 1), ("p.m", "module", 1), ("p.m.A", "class", 4), ("p.m.I.h", "function", 8), ("p.m.f", "function", 2), ("p.m.f:0", "statement", 3), ("p.m.f:1", "statement", 4), ("p.n", "module", 1), ("q.F", "function", 1),
    ]
    assert sorted(map(tuple, edges.collect())) == sorted(
        [
            ("p.m", "p.m.f", "contains"), ("p.m", "p.m.A", "contains"), ("p.m", "p.n", "imports"), ("p.m.f", "p.m.f", "calls"), ("p.m.f", "p.m.f", "calls"), ("p.m.A", "p.m.A", "extends"), ("p.m.A", "p.m.A", "extends"),
            ("p.m.f", "p.m.f:0", "contains"), ("p.m.f", "p.m.f:1", "contains"), ("p.m.f:0", "p.m.f:1", "control_flow"), ("p.m.f:0", "p.m.f:1", "data_flow"),
        ]
    )


def test_graph_parts_are_those_of_the_whole_readers(spark):
    script = "import x from './pkg/mod';\nclass A extends B { m(a) { q(a); } }\nconst api = { load(id) { return m(id); } };\n"
    again = "def f():\n    a = 1.5.real\n    b = a.x.y\n\ndef f():\n    a = 2\n    b = 3\n    if a: g(b)\n"
    files = spark.createDataFrame([("pkg/mod.py", PYTHON), ("pkg/two.py", again), ("a.js", script), ("bad.py", "def ("), ("empty.ts", None), ("notes.txt", "x")], "path string, value string")
    parts, found = extract.graph_parts(files)
    kinds = ["module", "class", "function", "method", "constructor"]
    calls = F.when(F.col("type").isin(kinds[2:]), F.concat_ws(",", "calls"))
    said = lambda df: sorted(map(str, df.filter(F.col("type").isin(kinds)).select("id", "name", "type", "file_path", "start_line", calls, F.when(F.col("type") == "module", F.concat_ws(",", "imports")), F.concat_ws(",", "parent_classes")).collect()))
    assert said(parts) == said(extract.components(files)) and len(said(parts)) > 10
    whole = {}
    for r in extract.function_statements(files).orderBy("line").collect():
        whole.setdefault((r.func_id, r.ord), r)
    assert sorted((r.func_id, r.ord, r.type, r.line, r.depth, r.code, r.defs, r.uses, r.calls) for r in found.collect()) == sorted((r.func_id, r.ord, r.type, r.line, r.depth, r.code, r.defs, r.uses, r.calls) for r in whole.values())
    assert {r.line for r in found.filter("func_id = 'pkg.two.f'").collect()} == {2, 3, 8}
    spark.catalog.clearCache()


def test_gold_and_extracted_agree(spark):
    files = spark.createDataFrame([("pkg/mod.py", PYTHON)], "path string, value string")
    found = extract.components(files).filter(F.col("type").isin("function", "method", "constructor", "class")).select("file_path", "name", F.col("start_line").alias("line"))
    r = validation.file_metrics(extract.gold_components(files), found).first()
    assert (r.gold, r.found, r.matched, r.f1) == (4, 4, 4, 1.0) and r.missing == [] and r.extra == []


def test_endpoints():
    api = 'from fastapi import FastAPI\n@app.get("/items/{id}", status_code=201)\n\nasync def get_item(id): pass\n'
    assert list(extract.endpoints("a.py", api)) == [("a.py", "fastapi", "GET", "/items/{id}", "get_item", ["id"], 201)]
    flask = "from flask import Flask\n@bp.route('/u/<int:k>', methods=['GET', 'POST'])\ndef u(k): pass\n"
    assert [e[2] for e in extract.endpoints("b.py", flask)] == ["GET", "POST"]
    express = "const e = require('express');\nrouter.post('/a/:b', save)\n"
    assert list(extract.endpoints("c.js", express)) == [("c.js", "express", "POST", "/a/:b", "save", ["b"], 200)]
    spring = "import org.springframework.web;\n@GetMapping\npublic String all() { }\n"
    assert list(extract.endpoints("D.java", spring))[0][2:5] == ("GET", "/", "all")
    assert list(extract.endpoints("e.py", "import django\n")) == []


def test_snippet_statements():
    s = extract.snippet_statements("if (a > 1) {\n  b = f(a);\n}\nreturn b;", 10)
    assert [(x["type"], x["line"], x["end_line"]) for x in s] == [("IF", 10, 12), ("ASSIGNMENT", 11, 11), ("RETURN", 13, 13)]
    assert s[1]["defs"] == ["b"] and s[1]["calls"] == ["f"]
    assert extract.balanced_condition("if (a(b) && c) {") == "a(b) && c"


def test_insertion_from_below():
    out = inserted("def a():\n    '''old'''\n    return 1\n\ndef b(x,\n      y):\n    pass", [(1, "New."), (5, "Two\nlines.")], "python")
    assert out == 'def a():\n    """New."""\n    return 1\n\ndef b(x,\n      y):\n    """Two\n    lines.\n    """\n    pass'
    assert inserted("  @Override\n  public int f() {", [(2, "Doc.")], "java") == "  /**\n   * Doc.\n   */\n  @Override\n  public int f() {"


def test_object_methods_and_callbacks():
    source = """const api = {
  base: '/x',
  load(id, { deep }) {
    return items.map((x) => x.id).filter(function keep(y) { return y; });
  },
  save: async (row) => { await put(row, async z => z); },
  drop: function (id) { if (id) { go(id); } },
  nested: { inner(a) { return a; } },
};
module.exports = { run() { return api; } };
"""
    found = {r["id"]: (r["type"], [p["name"] for p in r["parameters"]], r["is_async"], r["start_line"]) for r in extract.bracket_components("src/a.js", source, "javascript") if r["type"] == "method"}
    assert found["src.a.api.save"] == ("method", ["row"], True, 6) and found["src.a.api.drop"] == ("method", ["id"], False, 7)
    assert found["src.a.api.load"][0] == "method" and found["src.a.api.load"][3] == 3 and "src.a.exports.run" in found
    assert not any(k.endswith((".if", ".map", ".filter", ".put", ".go")) for k in found)
    assert [(x["line"], x["name"], x["parameters"], x["is_async"]) for x in extract.inline_functions(source)] == [(4, None, ["x"], False), (4, "keep", ["y"], False), (6, None, ["z"], True)]


def test_second_reader_of_brackets():
    source = "class A extends B {\n  constructor(a) {\n    super(a);\n  }\n\n  one(b) {\n    if (b) {\n      return 1;\n    }\n  }\n}\n\nconst two = async (c) => {\n  return c;\n};\n\nfunction three() {\n}\n"
    assert [(g["name"], g["type"], g["line"]) for g in extract.gold_brackets("a.js", source)] == [("A", "class", 1), ("constructor", "constructor", 2), ("one", "method", 6), ("two", "function", 13), ("three", "function", 17)]
    java = "public class D<T> {\n    private int n;\n    public D(int n) {\n    }\n    protected static List<A> all(Map<A, B> m) throws E {\n        for (A a : b) {\n        }\n    }\n}\n"
    assert [(g["name"], g["type"]) for g in extract.gold_brackets("D.java", java)] == [("D", "class"), ("D", "constructor"), ("all", "method")]


def test_own_component():
    own = extract.own_component("f", "method", "java", '@Named("x")\npublic static int f(final int a, List<A> b) { return a; }')
    assert (own["decorators"], own["is_static"], [p["name"] for p in own["parameters"]], own["return_type"]) == (["Named"], True, ["a", "b"], "int")
    assert extract.own_component("f", "function", "python", "") is None and extract.own_component("f", "method", "python", "    def g(self): pass") is None
