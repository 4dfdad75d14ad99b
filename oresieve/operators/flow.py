"""Control flow, dependence, hybrid and knowledge graphs over statement and component tables.

Statements are keyed by (func_id, ord). Bodies are nested, break and continue lead out of or back to their loop, and handlers hang on
their try; edges between graphs are joined by that key.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCKS = ("IF", "FOR", "WHILE", "TRY", "WITH")
_LABELS = {"RETURN": 50, "IF": 50, "FOR": 50, "WHILE": 50, "EXCEPT": 40}

CFG_EDGE = pa.schema([("func_id", pa.string()), ("source", pa.int32()), ("target", pa.int32()), ("type", pa.string())])
#: Places of entry and exit beside the statements' ord.
ENTRY, EXIT = -1, -2


class _Node:
    __slots__ = ("ord", "type", "code", "body", "parts")

    def __init__(self, ord_, type_, code):
        self.ord, self.type, self.code, self.body, self.parts = ord_, type_, code, [], []


def _tree(rows: list[tuple[int, str, int, str]]) -> list[_Node]:
    """Blocks with their bodies; ELSE, EXCEPT, FINALLY and elif hang on the block before them."""
    top: list[_Node] = []
    stack: list[tuple[int, list[_Node]]] = [(0, top)]
    for ord_, type_, depth, code in rows:
        node = _Node(ord_, type_, code)
        while len(stack) > 1 and stack[-1][0] > depth:
            stack.pop()
        siblings = stack[-1][1]
        if siblings and (type_ in ("ELSE", "EXCEPT", "FINALLY") or (type_ == "IF" and code.startswith("elif"))):
            siblings[-1].parts.append(node)
        else:
            siblings.append(node)
        stack.append((depth + 1, node.body))
    return top


def control_flow(rows: list[tuple[int, str, int, str]]) -> list[tuple[int, int, str]]:
    """(source, target, type) of one function; rows are (ord, type, depth, code) in order."""
    edges: list[tuple[int, int, str]] = []

    def join(ends, target):
        for source, kind in ends:
            edges.append((source, target, kind))

    def block(nodes, ends, loop, breaks):
        for node in nodes:
            if not ends:
                ends = []
            join(ends, node.ord)
            here = [(node.ord, "flow")]
            if node.type in ("RETURN", "RAISE"):
                edges.append((node.ord, EXIT, "flow"))
                ends = []
            elif node.type == "BREAK" and breaks is not None:
                breaks.append((node.ord, "flow"))
                ends = []
            elif node.type == "CONTINUE" and loop is not None:
                edges.append((node.ord, loop, "back"))
                ends = []
            elif node.type == "IF":
                ends, fallen, at = [], [(node.ord, "false")], node.ord
                ends += block(node.body, [(at, "true")], loop, breaks)
                for part in node.parts:
                    join(fallen, part.ord)
                    if part.type == "IF":
                        ends += block(part.body, [(part.ord, "true")], loop, breaks)
                        fallen = [(part.ord, "false")]
                    else:
                        ends += block(part.body, [(part.ord, "flow")], loop, breaks)
                        fallen = []
                ends += fallen
            elif node.type in ("FOR", "WHILE"):
                left: list[tuple[int, str]] = []
                for source, _ in block(node.body, [(node.ord, "true")], node.ord, left):
                    edges.append((source, node.ord, "back"))
                out = [(node.ord, "false")]
                for part in node.parts:
                    join(out, part.ord)
                    out = block(part.body, [(part.ord, "flow")], loop, breaks)
                ends = out + left
            elif node.type == "TRY":
                ends = block(node.body, here, loop, breaks)
                for part in node.parts:
                    if part.type == "EXCEPT":
                        edges.append((node.ord, part.ord, "exception"))
                        ends = ends + block(part.body, [(part.ord, "flow")], loop, breaks)
                    else:
                        join(ends, part.ord)
                        ends = block(part.body, [(part.ord, "flow")], loop, breaks)
            else:
                ends = block(node.body, here, loop, breaks) if node.body else here
        return ends

    join(block(_tree(rows), [(ENTRY, "flow")], None, None), EXIT)
    return list(dict.fromkeys(edges))


def cfg_edges(statements: DataFrame) -> DataFrame:
    """(func_id, source, target, type) of every function; a function is one row of an Arrow batch."""

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            rows, at, out = list(zip(*(x.to_pylist() for x in lists.flatten().flatten()))), 0, []
            for name, n in zip(batch.column(0).to_pylist(), lists.value_lengths().to_pylist()):
                out += [(name, *e) for e in control_flow(sorted(rows[at : at + n]))]
                at += n
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out) if out else [[]] * len(CFG_EDGE), CFG_EDGE)], schema=CFG_EDGE)

    # of the code the flow asks only whether it begins with elif
    one = F.struct("ord", "type", "depth", F.coalesce(F.substring("code", 1, 4), F.lit("")).alias("code"))
    functions = statements.groupBy("func_id").agg(F.collect_list(one).alias("rows"))
    return functions.mapInArrow(run, "func_id string, source int, target int, type string")


def cfg_nodes(statements: DataFrame) -> DataFrame:
    """(func_id, ord, type, label, line), entry and exit included."""
    cut = F.lit(30)
    for kind, n in _LABELS.items():
        cut = F.when(F.col("type") == kind, n).otherwise(cut)
    rows = statements.select("func_id", "ord", "type", F.expr("substring(code, 1, 50)").alias("code"), cut.alias("cut"), "line")
    own = rows.select("func_id", "ord", "type", F.substring(F.col("code"), F.lit(1), F.col("cut")).alias("label"), "line")
    ends = statements.select("func_id").distinct().select("func_id", F.explode(F.array(F.struct(F.lit(ENTRY).alias("ord"), F.lit("ENTRY").alias("type")), F.struct(F.lit(EXIT).alias("ord"), F.lit("EXIT").alias("type")))).alias("e"))
    return own.unionByName(ends.select("func_id", "e.ord", "e.type", F.lower("e.type").alias("label"), F.lit(None).cast("int").alias("line")))


def control_dependence(statements: DataFrame) -> DataFrame:
    """(func_id, source, target, type): each statement depends on the innermost block around it, which a guard edge names for loops and ifs."""
    rows = statements.filter(~F.col("type").isin("ELSE"))
    s = rows.select("func_id", F.col("ord").alias("target"), "line", "depth")
    b = rows.filter(F.col("type").isin(*BLOCKS)).select("func_id", F.col("ord").alias("b"), F.col("line").alias("from"), F.col("end_line").alias("to"), F.col("depth").alias("bd"), F.col("type").alias("bt"))
    inside = s.join(b, "func_id").filter((F.col("b") < F.col("target")) & (F.col("line") >= F.col("from")) & (F.col("line") <= F.col("to")) & (F.col("bd") < F.col("depth")))
    inner = inside.groupBy("func_id", "target").agg(F.max_by(F.struct("b", "bt"), "b").alias("x"))
    return inner.select("func_id", F.col("x.b").alias("source"), "target", F.when(F.col("x.bt").isin("IF", "WHILE", "FOR"), "guard").otherwise("control").alias("type"))


def _variables(names):
    return F.array_distinct(F.transform(names, lambda x: F.element_at(F.split(x, r"\."), 1)))


def data_dependence(statements: DataFrame) -> DataFrame:
    """(func_id, source, target, variable): from the most recent definition of each used variable; dotted names by their base."""
    marked = lambda names, is_def: F.coalesce(F.transform(names, lambda x: F.struct(x.alias("variable"), F.lit(is_def).alias("is_def"))), F.array().cast("array<struct<variable:string,is_def:int>>"))
    both = F.concat(marked(_variables(F.array_except("uses", "calls")), 0), marked(_variables("defs"), 1))
    known = statements.select("func_id", "ord", F.inline(both))
    w = Window.partitionBy("func_id", "variable").orderBy("ord", "is_def").rowsBetween(Window.unboundedPreceding, -1)
    known = known.withColumn("source", F.last(F.when(F.col("is_def") == 1, F.col("ord")), ignorenulls=True).over(w))
    return known.filter("is_def = 0 AND source IS NOT NULL").select("func_id", "source", F.col("ord").alias("target"), "variable").distinct()


def pdg_edges(statements: DataFrame) -> DataFrame:
    control = control_dependence(statements).select("func_id", "source", "target", "type", F.lit(None).cast("string").alias("variable"))
    return control.unionByName(data_dependence(statements).select("func_id", "source", "target", F.lit("data").alias("type"), "variable"))


def reaching_definitions(statements: DataFrame, cfg: DataFrame, variables: DataFrame | None = None) -> DataFrame:
    """(func_id, source, target, variable) along control flow: every definition that some path carries to a use."""
    from oresieve.operators.lineage import checkpointed

    defs = statements.select("func_id", F.col("ord").alias("source"), F.explode(_variables("defs")).alias("variable")).distinct()
    kills = defs.select("func_id", F.col("source").alias("at"), "variable", F.lit(True).alias("kill")).persist()
    steps = cfg.select("func_id", F.col("source").alias("from"), F.col("target").alias("at")).distinct().persist()
    seen = frontier = checkpointed(defs.select("func_id", "source", "variable", F.col("source").alias("from")).join(steps, ["func_id", "from"]).select("func_id", "source", "variable", "at").distinct())
    while not frontier.isEmpty():
        alive = frontier.join(kills, ["func_id", "at", "variable"], "left").filter("kill IS NULL").select("func_id", "source", "variable", F.col("at").alias("from"))
        new = alive.join(steps, ["func_id", "from"]).select("func_id", "source", "variable", "at").distinct()
        frontier = checkpointed(new.join(seen, ["func_id", "source", "variable", "at"], "left_anti"))
        seen = seen.unionByName(frontier)
    uses = statements.select("func_id", F.col("ord").alias("at"), F.explode(_variables(F.array_except("uses", "calls"))).alias("variable"))
    return seen.join(uses, ["func_id", "at", "variable"]).select("func_id", "source", F.col("at").alias("target"), "variable").distinct()


def hpg_edges(cfg: DataFrame, pdg: DataFrame) -> DataFrame:
    """Control flow and data edges over one set of statement keys, without repeats and self-loops."""
    a = cfg.select("func_id", "source", "target", "type", F.lit(None).cast("string").alias("label"))
    b = pdg.filter("type = 'data'").select("func_id", "source", "target", "type", F.col("variable").alias("label"))
    return a.unionByName(b).filter("source <> target").dropDuplicates(["func_id", "source", "target", "type", "label"])


def ckg(components: DataFrame, statements: DataFrame | None = None, flow: DataFrame | None = None, data: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the knowledge graph: containment, calls, imports, inheritance, and flow between statements if given.

    Names resolve to the component of that name with the least id, modules by the last part of an import. Parallel edges stay. Of components
    of one id the first in its file is the node. flow and data are edges of these statements, so both their ends are nodes;
    graph.known_edges drops others.

    Everything that a component refers to, its container included, finds its end in one join: a filter of the united edges by known ids would
    be planned again for every kind of edge. Components and statements that lie by id and func_id already are not moved for that.
    """
    callable_ = F.col("type").isin("method", "constructor", "function")
    is_node = callable_ | F.col("type").isin("module", "class")
    w = Window.partitionBy("id").orderBy(F.desc_nulls_last(is_node), "start_line", "type", "name", "file_path")
    part = F.split("id", r"\.")
    parent = F.array_join(F.slice(part, 1, F.greatest(F.size(part) - 1, F.lit(1))), ".")
    said = "array<struct<kind:string,key:string,label:string>>"

    def named(column, kind, label):
        return F.coalesce(F.transform(column, lambda n: F.struct(F.lit(kind).alias("kind"), F.lower(F.element_at(F.split(n, r"[./]"), -1)).alias("key"), F.lit(label).alias("label"))), F.array().cast(said))

    names = F.concat(named(F.when(callable_, F.col("calls")), "function", "calls"), named(F.when(F.col("type") == "module", F.col("imports")), "module", "imports"), named("parent_classes", "class", "extends"))
    placed = components.select("id", "name", "type", "file_path", "start_line", names.alias("names"), F.row_number().over(w).alias("place"), F.first(is_node).over(w).alias("known"))
    first = placed.filter(is_node & (F.col("place") == 1))
    nodes = first.select("id", "name", F.when(callable_, "function").otherwise(F.col("type")).alias("type"), "file_path", F.col("start_line").alias("line"))

    # a name by its kind, and an id by itself
    entry = lambda kind, key: F.struct(kind.alias("kind"), key.alias("key"))
    index = nodes.filter("id IS NOT NULL").select("id", F.inline(F.array(entry(F.lit("id"), F.col("id")), entry(F.col("type"), F.lower("name"))))).groupBy("kind", "key").agg(F.min("id").alias("end"))
    contained = F.when(is_node & (F.col("place") == 1) & (parent != F.col("id")), F.array(F.struct(F.lit("id").alias("kind"), parent.alias("key"), F.lit("contains").alias("label"))))
    refers = placed.filter("known AND id IS NOT NULL").select("id", F.inline(F.concat("names", F.coalesce(contained, F.array().cast(said))))).join(index, ["kind", "key"])
    up = F.col("label") == "contains"
    edges = refers.select(F.when(up, F.col("end")).otherwise(F.col("id")).alias("src"), F.when(up, F.col("id")).otherwise(F.col("end")).alias("dst"), F.col("label").alias("type"))
    if statements is not None:
        at = lambda c: F.concat_ws(":", "func_id", F.col(c).cast("string"))
        holders = first.select(F.col("id").alias("func_id"))
        edges = edges.unionByName(statements.select("func_id", "ord").join(holders, "func_id").select(F.col("func_id").alias("src"), at("ord").alias("dst"), F.lit("contains").alias("type")))
        nodes = nodes.unionByName(statements.select(at("ord").alias("id"), F.expr("substring(code, 1, 100)").alias("name"), F.lit("statement").alias("type"), F.lit(None).cast("string").alias("file_path"), "line"))
        for part, label in ((flow, "control_flow"), (data, "data_flow")):
            if part is not None:
                edges = edges.unionByName(part.filter("source >= 0 AND target >= 0").select(at("source").alias("src"), at("target").alias("dst"), F.lit(label).alias("type")))
    return nodes, edges
