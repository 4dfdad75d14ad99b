"""Graph queries over edge tables (src, dst, further columns): traversals, components, orders and statistics.

Parallel edges are kept in edge tables; traversals visit a node once. Loops run on frontiers joined to edges, cut by checkpoints.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oresieve.operators.lineage import checkpointed


def of_types(edges: DataFrame, types: list[str] | None, column: str = "type") -> DataFrame:
    return edges if types is None else edges.filter(F.col(column).isin(*types))


def _directed(edges: DataFrame, direction: str) -> DataFrame:
    out = edges.select("src", "dst")
    if direction == "out":
        return out
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return back if direction == "in" else out.unionByName(back)


def bfs(edges: DataFrame, starts: DataFrame, most: int | None = None, direction: str = "out") -> DataFrame:
    """(id, depth): nodes reached from starts (id) with their least depth, the starts at 0; stops where nothing new appears."""
    steps = _directed(edges, direction).distinct().persist()
    seen = checkpointed(starts.select("id").distinct().withColumn("depth", F.lit(0)))
    frontier, depth = seen, 0
    while most is None or depth < most:
        depth += 1
        reached = frontier.select(F.col("id").alias("src")).join(steps, "src").select(F.col("dst").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
        frontier = checkpointed(reached.withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def khop(edges: DataFrame, starts: DataFrame, k: int, direction: str = "out", types: list[str] | None = None) -> DataFrame:
    """Edges of the induced subgraph on the nodes within k hops, of the given types."""
    typed = of_types(edges, types)
    ids = bfs(typed, starts, k, direction).select("id")
    return typed.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").select(edges.columns)


def simple_paths(edges: DataFrame, source: str, target: str | None, most: int) -> DataFrame:
    """(path): all simple paths of up to `most` edges from source, to target if given; parallel edges give equal paths."""
    steps = edges.select("src", "dst").persist()
    spark = edges.sparkSession
    open_ = spark.createDataFrame([(source, [source])], "id string, path array<string>")
    done = None
    for _ in range(most):
        grown = open_.join(steps, open_["id"] == steps["src"]).filter(~F.array_contains("path", F.col("dst"))).select(F.col("dst").alias("id"), F.array_append("path", F.col("dst")).alias("path"))
        grown = checkpointed(grown)
        if grown.isEmpty():
            break
        hits = grown if target is None else grown.filter(F.col("id") == target)
        done = hits if done is None else done.unionByName(hits)
        open_ = grown if target is None else grown.filter(F.col("id") != target)
    return (done if done is not None else open_.limit(0)).select("path")


def dependencies_closure(edges: DataFrame, starts: DataFrame) -> DataFrame:
    return bfs(edges, starts).filter("depth > 0").select("id", "depth")


def dependents_closure(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """What points to the starts, at any distance, the farthest first in order."""
    return bfs(edges, starts, direction="in").filter("depth > 0").select("id", "depth")


def levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, level): the longest path that ends at a node, sources at 0; nodes on or behind a cycle get null.

    Kahn's peeling: each round takes the nodes whose predecessors all have a level.
    """
    left = checkpointed(edges.select("src", "dst").distinct())
    rest = checkpointed(nodes.select("id").distinct())
    out, level = None, 0
    while True:
        ready = checkpointed(rest.join(left.select(F.col("dst").alias("id")), "id", "left_anti").withColumn("level", F.lit(level)))
        if ready.isEmpty():
            break
        out = ready if out is None else out.unionByName(ready)
        rest = checkpointed(rest.join(ready, "id", "left_anti"))
        left = checkpointed(left.join(ready.select(F.col("id").alias("src")), "src", "left_anti"))
        level += 1
    stuck = rest.withColumn("level", F.lit(None).cast("int"))
    return stuck if out is None else out.unionByName(stuck)


def is_dag(edges: DataFrame, nodes: DataFrame) -> bool:
    return levels(edges, nodes).filter("level IS NULL").isEmpty()


def _spread(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels (id, label) after the least label went along the edges until nothing changed; labels are ids that reach their node.

    What reaches the label's node reaches the node, so each round also jumps to the label's own label and ways halve.
    """
    while True:
        came = edges.join(labels.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("label").alias("came"))
        near = labels.join(came, "id", "left").select("id", "label", F.least("label", "came").alias("near"))
        jump = labels.select(F.col("id").alias("near"), F.col("label").alias("far"))
        new = checkpointed(near.join(jump, "near", "left").select("id", F.least("near", "far").alias("label"), (F.least("near", "far") < F.col("label")).alias("moved")))
        labels = new.select("id", "label")
        if new.filter("moved").isEmpty():
            return labels


def weak_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, label): label is the least id of the weakly connected component; every round also jumps to the label's own label."""
    both = checkpointed(_directed(edges, "both").distinct())
    labels = checkpointed(nodes.select("id", F.col("id").alias("label")).distinct())
    while True:
        came = both.join(labels.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("label").alias("came"))
        near = labels.join(came, "id", "left").select("id", "label", F.least("label", "came").alias("near"))
        jump = labels.select(F.col("id").alias("near"), F.col("label").alias("far"))
        new = checkpointed(near.join(jump, "near", "left").select("id", F.least("near", "far").alias("new"), "label"))
        moved = new.filter("new < label")
        labels = new.select("id", F.col("new").alias("label"))
        if moved.isEmpty():
            return labels


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, label) of the nodes in strongly connected components of more than one node; label is the least id.

    Nodes without way in or out are trimmed; the least id spreads forward, and what reaches its origin inside the colour is a component.
    """
    left = checkpointed(edges.filter("src <> dst").select("src", "dst").distinct())
    out = None
    while not left.isEmpty():
        while True:  # trim
            kept = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
            kept = checkpointed(kept)
            if kept.count() == left.count():
                break
            left = kept
        if left.isEmpty():
            break
        nodes = left.select(F.col("src").alias("id")).union(left.select("dst")).distinct()
        colour = _spread(checkpointed(nodes.withColumn("label", F.col("id"))), left)
        a, b = colour.select(F.col("id").alias("src"), F.col("label").alias("ls")), colour.select(F.col("id").alias("dst"), F.col("label").alias("ld"))
        inside = checkpointed(left.join(a, "src").join(b, "dst").filter("ls = ld").select("src", "dst"))
        roots = colour.filter("id = label").select("id")
        back = bfs(inside, roots, direction="in").select("id")
        found = checkpointed(colour.join(back, "id", "left_semi"))
        many = found.groupBy("label").agg(F.count("*").alias("n")).filter("n > 1").select("label")
        part = checkpointed(found.join(many, "label", "left_semi").select("id", "label"))
        out = part if out is None else out.unionByName(part)
        left = checkpointed(left.join(found.select(F.col("id").alias("src")), "src", "left_anti").join(found.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst"))
    return out if out is not None else edges.limit(0).select(F.col("src").alias("id"), F.col("src").alias("label"))


def without_cycles(edges: DataFrame, strong: DataFrame) -> DataFrame:
    """edges without those inside a strongly connected component; self-loops stay."""
    a, b = strong.select(F.col("id").alias("src"), F.col("label").alias("__a")), strong.select(F.col("id").alias("dst"), F.col("label").alias("__b"))
    return edges.join(a, "src", "left").join(b, "dst", "left").filter(F.col("__a").isNull() | F.col("__b").isNull() | (F.col("__a") != F.col("__b")) | (F.col("src") == F.col("dst"))).select(edges.columns)


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree), isolated nodes with zeros; parallel edges count."""
    i = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("i"))
    o = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("o"))
    return nodes.select("id").distinct().join(i, "id", "left").join(o, "id", "left").select("id", F.coalesce("i", F.lit(0)).alias("in_degree"), F.coalesce("o", F.lit(0)).alias("out_degree"))


def statistics(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    d = degrees(edges, nodes)
    return d.agg(
        F.count("*").alias("nodes"), F.sum("out_degree").alias("edges"), F.round(F.avg("in_degree"), 4).alias("avg_in"), F.round(F.avg("out_degree"), 4).alias("avg_out"), F.max("in_degree").alias("max_in"), F.max("out_degree").alias("max_out")
    )


def adjacency(edges: DataFrame, reverse: bool = False) -> DataFrame:
    """(id, others): sorted distinct neighbours of each node."""
    a, b = ("dst", "src") if reverse else ("src", "dst")
    return edges.groupBy(F.col(a).alias("id")).agg(F.array_sort(F.collect_set(b)).alias("others"))


def known_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends exist, parallel ones kept."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").select(edges.columns)


def type_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, type, n) of nodes and edges."""
    return nodes.groupBy("type").agg(F.count("*").alias("n")).select(F.lit("node").alias("what"), "type", "n").unionByName(edges.groupBy("type").agg(F.count("*").alias("n")).select(F.lit("edge").alias("what"), "type", "n"))


def edge_ids(edges: DataFrame, *order: str) -> DataFrame:
    """edges numbered e0, e1, ... in an order: by ranges, whose counts (a row a partition) shift the numbers inside them."""
    at = F.monotonically_increasing_id()
    placed = checkpointed(edges.orderBy(*order).withColumn("__part", F.shiftright(at, 33)).withColumn("__n", at.bitwiseAND(F.lit((1 << 33) - 1))))
    counts = placed.groupBy("__part").agg(F.count("*").alias("n"))
    before = counts.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return placed.join(F.broadcast(before), "__part").select(*edges.columns, F.concat(F.lit("e"), F.col("__n") + F.col("__before")).alias("edge_id"))


def batches(df: DataFrame, keys: list[str], order: list[str], size: int = 5) -> DataFrame:
    """df with the number of its batch of fixed size in an order, inside each group."""
    return df.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1) / size))


def running_offset(df: DataFrame, keys: list[str], order: list[str], offset: str) -> DataFrame:
    """df with the sum of the offsets of all earlier rows of its group."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("shift", F.coalesce(F.sum(offset).over(w), F.lit(0)))


def dependency_first(edges: DataFrame, nodes: DataFrame, group: str) -> DataFrame:
    """(group, id, position): post-order depth-first, dependencies before what needs them, inside each group (such as a repository).

    The order is sequential by nature; groups are independent, and inside one a stack of iterators replaces recursion.
    """
    import pyarrow as pa

    rows = nodes.select(group, F.col("id"), F.lit(None).cast("string").alias("dst")).unionByName(edges.select(group, F.col("src").alias("id"), "dst"))

    def order(t: pa.Table) -> pa.Table:
        after: dict[str, list[str]] = {}
        for i, d in zip(t["id"].to_pylist(), t["dst"].to_pylist()):
            after.setdefault(i, [])
            if d is not None:
                after[i].append(d)
        seen, out = set(), []
        for root in sorted(after):
            if root in seen:
                continue
            seen.add(root)
            stack = [(root, iter(sorted(set(after[root]))))]
            while stack:
                node, rest = stack[-1]
                for d in rest:
                    if d in after and d not in seen:
                        seen.add(d)
                        stack.append((d, iter(sorted(set(after[d])))))
                        break
                else:
                    out.append(node)
                    stack.pop()
        name = t[group][0].as_py()
        return pa.table({group: pa.array([name] * len(out), type=pa.string()), "id": pa.array(out, type=pa.string()), "position": pa.array(range(len(out)), type=pa.int64())})

    return rows.groupBy(group).applyInArrow(order, f"{group} string, id string, position long")
