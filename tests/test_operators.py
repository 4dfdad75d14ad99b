"""Joins, graphs, logs, quality and text on small tables with hand-made results."""

import datetime as dt

from pyspark.sql import functions as F

from oresieve.functions import code, text
from oresieve.operators import agentlog, graph, joins, models, quality, validation
from oresieve.streaming import progress


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values()) or (0,)], ", ".join(f"{k} string" for k in values) or "x int")
    return row.select(column.alias("r")).first().r


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "src string, dst string")


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def test_cycle_graph(spark):
    e, v = edges(spark, ("a", "b"), ("b", "c"), ("c", "d"), ("d", "b")), ids(spark, *"abcd")
    strong = graph.strong_components(e)
    assert {(r.id, r.label) for r in strong.collect()} == {("b", "b"), ("c", "b"), ("d", "b")}
    assert [tuple(r) for r in graph.without_cycles(e, strong).collect()] == [("a", "b")]
    assert not graph.is_dag(e, v)
    assert [r.path for r in graph.simple_paths(e, "a", "d", 5).collect()] == [["a", "b", "c", "d"]]


def test_diamond_levels_and_components(spark):
    e, v = edges(spark, ("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")), ids(spark, *"abcde")
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    assert {r.id: r.level for r in graph.levels(back, v).collect()} == {"d": 0, "b": 1, "c": 1, "a": 2, "e": 0}
    assert {r.id: r.depth for r in graph.bfs(e, ids(spark, "a")).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2}
    assert graph.weak_components(e, v).select("label").distinct().count() == 2
    assert graph.statistics(e, v).first().avg_in == 0.8
    assert {r.id for r in graph.dependents_closure(e, ids(spark, "d")).collect()} == {"a", "b", "c"}
    order = {r.id: r.position for r in graph.dependency_first(e.withColumn("g", F.lit("x")), v.withColumn("g", F.lit("x")), "g").collect()}
    assert order["d"] < order["b"] < order["a"] and order["d"] < order["c"] < order["a"]


def test_parallel_edges_and_loops(spark):
    e = edges(spark, ("a", "b"), ("a", "b"), ("c", "c"))
    assert {r.id: r.out_degree for r in graph.degrees(e, ids(spark, *"abc")).collect()} == {"a": 2, "b": 0, "c": 1}
    assert graph.bfs(e, ids(spark, "a")).count() == 2
    assert graph.strong_components(e).count() == 0 and graph.simple_paths(e, "a", "b", 3).count() == 2
    assert graph.known_edges(e, ids(spark, "a", "b")).count() == 2


def test_empty_graph(spark):
    e, v = spark.createDataFrame([], "src string, dst string"), spark.createDataFrame([], "id string")
    assert graph.levels(e, v).count() == graph.weak_components(e, v).count() == graph.strong_components(e).count() == graph.bfs(e, v).count() == 0


def test_band_alignment(spark):
    g = spark.createDataFrame([("x", "f", 10), ("x", "f", 12), ("x", "g", 20)], "file_path string, name string, line int")
    r = spark.createDataFrame([("x", "f", 11), ("x", "f", 13), ("x", "h", 1)], "file_path string, name string, line int")
    assert {(p.gold_line, p.found_line) for p in joins.band_pairs(g, r, ["file_path", "name"], "line").collect()} == {(10, 11), (12, 13)}
    m = validation.file_metrics(g, r).first()
    assert (m.matched, m.missing, m.extra) == (2, ["g"], ["h"]) and m.precision == round(2 / 3, 4)


def test_priority_and_suffix_joins(spark):
    left = spark.createDataFrame([(1, "pkg.a"), (2, "z.b"), (3, None)], "k int, n string")
    right = spark.createDataFrame([("pkg.a", "t1"), ("b", "t2"), ("b", "t0")], "n string, target string")
    tiers = [(F.col("n"), F.col("n")), (F.element_at(F.split("n", r"\."), -1), F.col("n"))]
    assert {r.k: (r.tier, r.target) for r in joins.priority_join(left, right, tiers, "k", "target").collect()} == {1: (0, "t1"), 2: (1, "t0"), 3: (None, None)}
    names, modules = spark.createDataFrame([("a.b",), ("b",), ("q",)], "name string"), spark.createDataFrame([("x.a.b",), ("b",)], "module string")
    assert {(r.name, r.module) for r in joins.suffix_join(names, modules).collect()} == {("a.b", "b"), ("b", "b")}


def test_truthfulness(spark):
    docs = spark.createDataFrame([("d1", "f", "uses `Foo` and `bar` and `of`"), ("d2", "f", "none"), ("d3", "f", None)], "id string, file_path string, text string")
    said = docs.select("id", "file_path", text.backtick_mentions("text").alias("mentions"))
    names = spark.createDataFrame([("foo", "g")], "name string, file_path string")
    r = {x.id: (x.mentioned, x.existing, x.cross_file, x.existence_ratio, x.hallucination_rate) for x in quality.truthfulness(said, names).collect()}
    assert r == {"d1": (2, 1, 1, 0.5, 0.5), "d2": (0, 0, 0, 1.0, 0.0), "d3": (0, 0, 0, 1.0, 0.0)}


def test_text_measures(spark):
    a, b = text.blank_tokens(F.lit("a b c")), text.blank_tokens(F.lit("a a b"))
    assert one(spark, text.unigram_precision(a, b)) == 1.0 and round(one(spark, text.clipped_bleu1(a, b)), 4) == round(2 / 3, 4)
    assert one(spark, text.jaccard(text.blank_tokens(F.lit("")), text.blank_tokens(F.lit(None).cast("string")))) == 1.0
    assert one(spark, text.jaccard(a, text.blank_tokens(F.lit("")))) == 0.0
    assert one(spark, text.clean_comment(F.lit("/**\n * Adds.\n * @param a x\n */"))) == "Adds. @param a x"
    assert one(spark, text.summary_line(F.lit("/**\n * @x\n * Adds.\n */"))) == "Adds."
    assert one(spark, text.repo_name(F.lit("git@host:me/my repo.git/"))) == "my_repo"
    assert one(spark, text.reply_score(F.lit("score: 9, level 2"))) == 2 and one(spark, text.reply_score(F.lit("none"))) == 3
    assert one(spark, text.extracted_docstring(F.lit("<think>x</think><summary>one two</summary>"))) == "one two"
    assert one(spark, text.attribute_descriptions(F.lit("A.\n\nAttributes:\n    x (int): first\n    y: second\n\nEnd"))) == {"x": "first", "y": "second"}
    assert one(spark, text.explicit_mentions(F.lit("Returns InMemoryCache.\nArgs:\nuse run() on a.bc_d"), F.lit("python"))) == ["InMemoryCache", "run", "bc_d"]
    assert one(spark, text.described(F.lit("One.\nTwo.\nThree.\nArgs:\n x"))) == "Two.\nThree."


def test_code_scores(spark):
    assert one(spark, code.nesting_depth(F.lit("a\n    b\n        c"))) == 2 and one(spark, code.nesting_depth(F.lit("\t" * 7 + "x"))) == int(7**0.7 * 2)
    assert one(spark, code.visibility(F.lit("__a__"))) == "public" and one(spark, code.visibility(F.lit("__a"))) == "private"
    assert one(spark, code.trivial_function(F.lit("def f():\n    return 1"))) and not one(spark, code.trivial_function(F.lit("def f():\n    for x in y:\n        pass")))
    assert one(spark, code.letter_grade(F.lit(0.5))) == "C-" and one(spark, code.evaluation_grade(F.lit(59.0))) == "F"
    assert one(spark, code.without_strings(F.lit('a = "x // y"; // z'))).strip() == 'a = "";'
    assert one(spark, code.threshold_summary(code.threshold(F.lit("return self.age >= 18")))) == "Reports whether the stored age is at least 18."
    flags = code.data_flow(F.lit("total[1] = 2; del other"), F.lit("total"))
    assert one(spark, flags["writes"]) and one(spark, flags["reads"]) and not one(spark, flags["deletes"])


def test_completeness(spark):
    from oresieve.schema import COMPONENTS

    base = {"id": "a", "name": "f", "type": "function", "language": "python", "source_code": "def f(a):\n    x = g(a)\n    y = x\n    z = y\n    w = z\n    return w", "lines_of_code": 6, "return_type": "int", "existing_docstring": "Adds.", "parameters": [("a", None, None, True, None)]}
    rows = [base, {**base, "id": "b", "existing_docstring": None}, {**base, "id": "c", "type": "global_variable"}, {**base, "id": "d", "return_type": None}]
    r = {x.id: x.score for x in quality.completeness(spark.createDataFrame(rows, COMPONENTS)).collect()}
    assert r == {"a": 0.333, "b": 0.0, "d": 0.5}


def test_logs(spark):
    lines = [
        "2025-01-01 00:00:01 - agent.reader - INFO - Processing component 1/9: load (function)", "\x1b[32m2025-01-01 00:00:02 - agent.writer - ERROR - failed to document load: x", "not a line",
        "2025-01-01 00:00:03 - agent.verifier - INFO - verification complete", None,
    ]
    rows = agentlog.parsed(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "line_no int, value string"))
    assert [(r.agent_name, r.action, r.status, r.component_name) for r in rows.orderBy("line_no").collect()] == [
        ("reader", "analyzing", "success", "load"), ("writer", "error", "failed", "load"), ("verifier", "completed", "success", None)
    ]
    flow = agentlog.component_flows(rows).first()
    assert flow.status == "failed" and flow.agents == ["reader", "writer"] and flow.executions == 2


def test_latency_and_handoffs(spark):
    t0 = dt.datetime(2025, 1, 1)
    rows = spark.createDataFrame([("g", i, t0 + dt.timedelta(milliseconds=m), a, s) for i, (m, a, s) in enumerate([(0, "reader", "ok"), (0, "reader", "ok"), (100, "searcher", "failed"), (400100, "writer", "ok"), (400300, "writer", "ok")])], "g string, i int, ts timestamp_ntz, agent_name string, status string")
    kept = agentlog.latencies(rows, ["g"], ["i"])
    assert sorted(r.delta_ms for r in kept.collect()) == [100.0, 200.0]
    s = agentlog.latency_summary(kept.withColumn("k", F.lit("x")), "k").first()
    assert (s["mean"], s.p50, s.p90, s.p99) == (150.0, 200.0, 200.0, 200.0)
    h = agentlog.handoffs(rows, ["g"], ["i"])
    assert {(r.source, r.target, r.ok) for r in h.collect()} == {("reader", "searcher", False), ("searcher", "writer", True)}
    curve = agentlog.learning_curve(spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.7), ("a", 3, 0.705)], "k string, i int, v double"), "k", ["i"], "v").first()
    assert (curve.improvement, curve.trend, curve.converged_at) == (0.41, "improving", 2)


def test_windows(spark):
    t = lambda d: dt.datetime(2025, 1, d)
    s = spark.createDataFrame([("a", t(1)), ("b", t(2)), ("a", t(3)), ("c", t(9))], "repo string, ts timestamp_ntz")
    assert {r.repo: (r.start.day, r.end and r.end.day) for r in agentlog.windows(s).collect()} == {"a": (3, 9), "b": (2, 3), "c": (9, None)}


def test_models(spark):
    rows = spark.createDataFrame([(1, "hard"), (2, "easy"), (3, None)], "id int, prompt string")
    assert {r.id: r.reply for r in models.short_circuit(rows, F.col("prompt") == "easy", "skip", "prompt", lambda x: x.upper()).collect()} == {1: "HARD", 2: "skip", 3: ""}
    assert one(spark, models.batch_decision(F.lit("COMPONENT 1: YES\nCOMPONENT 2: no"), F.lit(2), F.lit(True))) is False
    v = models.verdict(F.lit("<need_revision>TRUE</need_revision><SUGGESTION> a </SUGGESTION>"))
    assert one(spark, v["needs_revision"]) and one(spark, v["suggestion"]) == "a" and not one(spark, v["needs_context"])
    xml = models.request_xml(F.array(F.lit("a"), F.lit("b")), F.array().cast("array<string>"), F.lit(None).cast("array<string>"))
    assert one(spark, models.parsed_request(xml)["calls"]) == ["a", "b"]


def test_updates(spark):
    table = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k int, s string, n int")
    new = joins.upsert(table, spark.createDataFrame([(2, "z"), (3, "y")], "k int, s string"), "k")
    assert {tuple(r) for r in new.collect()} == {(1, "a", 5), (2, "z", 6), (3, "y", None)}
    logs = spark.sql("SELECT array(named_struct('agent', 'r', 'status', 'x'), named_struct('agent', 'w', 'status', 'x')) AS l")
    assert [x.status for x in logs.select(joins.element_updated("l", "agent", F.lit("w"), {"status": F.lit("done")}).alias("l")).first().l] == ["x", "done"]


def test_convergence_and_ttl(spark):
    rounds = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("b", 1, ""), ("b", 2, None), ("c", 1, "p"), ("c", 2, "q"), ("c", 3, "r")], "k string, i int, req string")
    assert {r.k: (r.rounds, r.reason) for r in progress.convergence(rounds, "k", "i", "req").collect()} == {"a": (2, "unchanged"), "b": (2, "exhausted"), "c": (3, "limit")}
    cache = spark.sql("SELECT 'k' AS key, timestamp'2025-01-01 00:00:00' AS created")
    assert progress.unexpired(cache, F.lit("2025-01-01 00:01:00").cast("timestamp"), 60).count() == 1 and progress.unexpired(cache, F.lit("2025-01-01 00:01:01").cast("timestamp"), 60).count() == 0


def test_streams(spark, tmp_path):
    rows = spark.sql("SELECT 'r' AS repo_id, 'scan' AS stage, 5.0D AS percent, 'm' AS message, timestamp'2025-01-01 00:00:00' AS ts")
    rows.write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = progress.published(stream, lambda df, n: seen.extend(progress.sse_lines(df).collect()), str(tmp_path / "check"))
    q.awaitTermination()
    assert len(seen) == 1 and seen[0].value.startswith("event: progress\ndata: {")
    counts = progress.windowed_counts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "ts", "repo_id")
    w = counts.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    w.awaitTermination()
    assert spark.table("counts").first().n == 1


def test_sources(spark, tmp_path):
    from oresieve.sources import tree

    (tmp_path / "src/pkg").mkdir(parents=True)
    (tmp_path / "src/node_modules").mkdir()
    (tmp_path / "src/pkg/a.py").write_text("x = 1\n")
    (tmp_path / "src/node_modules/b.js").write_text("y")
    files = tree.source_tree(spark, str(tmp_path / "src"))
    assert [r.path for r in files.collect()] == ["pkg/a.py"] and tree.by_language(files).first().language == "python"
    (tmp_path / "a.json").write_text('{"nodes": [{"id": "n", "name": "N"}]}')
    (tmp_path / "b.json").write_text('{"m.f": {"name": "f", "location": {"file_path": "p"}}}')
    (tmp_path / "c.json").write_text('[{"id": "l", "name": "L"}]')
    shapes = {r.id: r.name for x in "abc" for r in tree.read_component_shapes(spark, str(tmp_path / f"{x}.json")).collect()}
    assert shapes == {"n": "N", "m.f": "f", "l": "L"}
    (tmp_path / "s.jsonl").write_text('{"id": "1", "docstring": "d"}\n{"component_id": "2", "documentation": " "}\n')
    assert [tuple(r) for r in tree.read_systems(spark, str(tmp_path / "s.jsonl")).collect()] == [("default_system", "1", "d")]


def test_documentation_functions(spark):
    from oresieve.functions import docs

    assert one(spark, docs.style_of(F.lit(" JS "))) == "jsdoc" and one(spark, docs.style_of(F.lit(None).cast("string"))) == "google"
    assert one(spark, docs.without_blocks(F.lit("/**\n * @summary x\n * y\n * @param a\n */"))) == "/**\n * @param a\n */"
    params = F.array(F.struct(F.lit("a").alias("name"), F.lit("first").alias("description")), F.struct(F.lit("b").alias("name"), F.lit(None).cast("string").alias("description")))
    assert one(spark, docs.with_params(F.lit("Adds.\n@param a x"), params)) == "Adds.\n@param a x\n@param b"
    assert one(spark, docs.rendered(F.lit("Adds."), params, F.lit("sum"), "google")) == "Adds.\n\nArgs:\n    a: first\n    b: \n\nReturns:\n    sum"
    call = one(spark, docs.first_call(F.lit("x = a.b.run(1)")))
    assert (call.receiver, call.name) == ("a.b", "run")
    assert docs.same_call("f(1, k=2)", "f(1,k = 2)") == (True, "") and docs.same_call("f(1)", "f(2)")[1] == "positional" and docs.same_call("g()", "f()")[1] == "name" and docs.same_call("(", "f()")[1] == "unparsable"
    assert docs.rouge_l("a b c d".split(), "a c d e".split()) == 0.75 and docs.bleu4("a b c d e".split(), "a b c d e".split()) == 1.0 and docs.bleu4([], ["a"]) == 0.0
    assert docs.tree_completeness('def f(a):\n    """Adds.\n\n    More text.\n\n    Args:\n        a: x\n    """\n    return a') == 0.6
    assert docs.tree_completeness("def __init__(self): pass") == 1.0 and docs.tree_completeness("def f(: x") is None and docs.tree_completeness("def f(): pass") == 0.0


def test_lookups(spark):
    from oresieve.operators import extract, lookup

    files = spark.createDataFrame([("p/a.py", "from p.b import helper\ndef run():\n    helper()\n    local()\ndef local(): pass\n"), ("p/b.py", "def helper(): pass\n"), ("p/c.py", "def helper(): pass\n")], "path string, value string")
    c = extract.components(files)
    assert {(r.src, r.dst, r.via) for r in lookup.resolved_dependencies(c).collect()} == {("p.a.run", "p.b.helper", "import"), ("p.a.run", "p.a.local", "file")}
    assert lookup.found_by_name(c, "helper").first().id == "p.b.helper" and lookup.found_by_key(c, "a.run").first().id == "p.a.run" and lookup.listed(c, "function", "p/a.py").count() == 2
    order = [r.path for r in lookup.tree_order(spark.createDataFrame([("d/z.py",), ("d/e/f.py",), ("a.py",)], "path string")).collect()]
    assert order == ["d", "a.py", "d/e", "d/z.py", "d/e/f.py"]
    s = lookup.sample_components(spark.createDataFrame([("r", "add", "async function add(a, b = 1) {\n return a; }")], "repo string, func_name string, code string")).first()
    assert s.parameters == ["a", "b"] and s.is_async and s.type == "function" and s.signature == "async function add(a, b = 1)"
    assert round(sum(lookup.AGENT_WEIGHTS.values()), 9) == 1.0 and one(spark, lookup.agent_score({k: F.lit(1.0) for k in lookup.AGENT_WEIGHTS})) == 1.0


def test_cached_replies_by_stream(spark, tmp_path):
    rows = spark.sql("SELECT * FROM VALUES ('a', timestamp'2025-01-01 00:00:00'), ('a', timestamp'2025-01-01 00:00:01'), ('a', timestamp'2025-01-01 00:02:00'), ('b', timestamp'2025-01-01 00:00:00') AS t(key, ts)")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    found = progress.cached_replies(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), 60_000)
    found.writeStream.format("memory").queryName("replies").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert sorted(tuple(r) for r in spark.table("replies").collect()) == [("a", False, 0), ("a", False, 0), ("a", True, 1), ("b", False, 0)]


def test_edge_ids(spark):
    e = spark.createDataFrame([(f"n{i % 7}", f"m{i:03d}") for i in range(100)], "src string, dst string").repartition(5)
    found = sorted(((r.src, r.dst, int(r.edge_id[1:])) for r in graph.edge_ids(e, "src", "dst").collect()))
    assert [x[2] for x in found] == list(range(100))
    assert graph.edge_ids(e.limit(0), "src").count() == 0
