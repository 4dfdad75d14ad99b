"""Joins: names to components by priority, suffix, band and as-of, and the neighbourhoods of dependency edges."""

from __future__ import annotations



import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oresieve.functions.text import bound


def call_edges(components: DataFrame, calls: str = "calls") -> DataFrame:
    """(src, name, dst): each call joined to a component of that name but for case, the least id where several have it."""
    index = components.select(F.lower("name").alias("low"), "id").groupBy("low").agg(F.min("id").alias("dst"))
    said = components.select(F.col("id").alias("src"), F.explode(calls).alias("name")).distinct()
    return said.join(index, F.lower("name") == F.col("low")).select("src", "name", "dst")


def name_ladder(names: DataFrame, index: DataFrame, name: str = "name") -> DataFrame:
    """names with dst: the least id of the full name, else of its last dotted part; null where neither is known. index: (low, dst)."""
    one = index.select(F.col("low").alias("l1"), F.col("dst").alias("d1"))
    two = index.select(F.col("low").alias("l2"), F.col("dst").alias("d2"))
    last = F.element_at(F.split(F.lower(name), r"\."), -1)
    return names.join(one, F.lower(name) == F.col("l1"), "left").join(two, last == F.col("l2"), "left").withColumn("dst", F.coalesce("d1", "d2")).drop("l1", "d1", "l2", "d2")


def priority_join(left: DataFrame, right: DataFrame, tiers: list[tuple[Column, Column]], key: str, target: str) -> DataFrame:
    """left with the target of the first tier that matches, the least target inside a tier; null without match.

    tiers are (expression over left, expression over right) in falling priority, each an equality join.
    """
    found = None
    for rank, (a, b) in enumerate(tiers):
        side = right.select(b.alias("__k"), F.col(target)).filter("__k IS NOT NULL").groupBy("__k").agg(F.min(target).alias(target))
        part = left.select(F.col(key), a.alias("__k")).join(side, "__k").select(key, F.lit(rank).alias("tier"), target)
        found = part if found is None else found.unionByName(part)
    best = found.groupBy(key).agg(F.min(F.struct("tier", target)).alias("b")).select(key, F.col("b.tier").alias("tier"), F.col(f"b.{target}").alias(target))
    return left.join(best, key, "left")


def suffix_join(names: DataFrame, modules: DataFrame, name: str = "name", module: str = "module") -> DataFrame:
    """(name, module): the least module that equals a name, or is a dotted suffix of it, or has it as one.

    Every dotted suffix becomes a key, so the theta join is two equality joins.
    """
    def suffixes(c):
        return bound(F.split(F.col(c), r"\."), lambda parts: F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), ".")))

    left, right = names.select(name).distinct(), modules.select(module).distinct()
    a = left.select(name, F.explode(suffixes(name)).alias("__k")).join(right.select(module, F.col(module).alias("__k")), "__k")
    b = right.select(module, F.explode(suffixes(module)).alias("__k")).join(left.select(name, F.col(name).alias("__k")), "__k")
    both = a.select(name, module).unionByName(b.select(name, module)).filter((F.col(name) != "") & (F.col(module) != ""))
    return both.groupBy(name).agg(F.min(module).alias(module))


def band_pairs(gold: DataFrame, found: DataFrame, keys: list[str], line: str, band: int = 1) -> DataFrame:
    """(keys, gold_line, found_line): greedy pairs of one to one, gold in order taking the first free row within the band.

    Buckets of the keys are independent, so each is one group; inside it two pointers suffice, as a row too early for this gold row is
    too early for all later ones.
    """
    both = gold.select(*keys, F.col(line).cast("long").alias("line"), F.lit(0).alias("side")).unionByName(found.select(*keys, F.col(line).cast("long").alias("line"), F.lit(1).alias("side")))
    schema = ", ".join(f"`{k}` {gold.schema[k].dataType.simpleString()}" for k in keys) + ", gold_line long, found_line long"

    def align(batch: pa.Table) -> pa.Table:
        lines, sides = batch["line"].to_pylist(), batch["side"].to_pylist()
        g = sorted(x for x, s in zip(lines, sides) if s == 0 and x is not None)
        f = sorted(x for x, s in zip(lines, sides) if s == 1 and x is not None)
        a, b, j = [], [], 0
        for x in g:
            while j < len(f) and f[j] < x - band:
                j += 1
            if j < len(f) and f[j] <= x + band:
                a.append(x), b.append(f[j])
                j += 1
        constant = [pa.array([batch[k][0].as_py()] * len(a), type=batch[k].type) for k in keys]
        return pa.table([*constant, pa.array(a, type=pa.int64()), pa.array(b, type=pa.int64())], names=[*keys, "gold_line", "found_line"])

    return both.groupBy(*keys).applyInArrow(align, schema)


def last_before(df: DataFrame, keys: list[str], order: list[str], wanted: Column, value: str) -> DataFrame:
    """df with the value of the most recent earlier row of its keys for which wanted holds (an as-of join as a window)."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(f"last_{value}", F.last(F.when(wanted, F.col(value)), ignorenulls=True).over(w))


def restricted_edges(components: DataFrame, depends: str = "depends_on") -> DataFrame:
    """(src, dst) of dependencies whose target is a component too."""
    edges = components.select(F.col("id").alias("src"), F.explode(depends).alias("dst")).distinct()
    return edges.join(components.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")


def placeholders(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ids that edges lead to and that no node has."""
    return edges.select(F.col("dst").alias("id")).distinct().join(nodes.select("id"), "id", "left_anti")


def neighbours(edges: DataFrame, node: str, reverse: bool = False) -> DataFrame:
    a, b = ("dst", "src") if reverse else ("src", "dst")
    return edges.filter(F.col(a) == node).select(F.col(b).alias("id")).distinct()


def call_buckets(components: DataFrame) -> DataFrame:
    """(id, classes, functions, methods): each component's dependencies by kind; unknown ones by the look of their last part."""
    kinds = components.select(F.col("id").alias("dep"), F.col("type").alias("kind")).distinct()
    said = components.select("id", F.explode("depends_on").alias("dep")).distinct().join(kinds, "dep", "left")
    last = F.element_at(F.split("dep", r"\."), -1)
    kind = F.coalesce("kind", F.when(last.rlike("^[A-Z]"), "class").when(F.size(F.split("dep", r"\.")) > 2, "method").otherwise("function"))
    kind = F.when(kind == "class", "classes").when(kind.isin("method", "constructor"), "methods").otherwise("functions")
    return said.groupBy("id").agg(*[F.array_sort(F.collect_set(F.when(kind == k, F.col("dep")))).alias(k) for k in ("classes", "functions", "methods")])


def roll_up_to_owner(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """(src, dst): dependencies on a method of another class become dependencies on that class; own class and self are dropped.

    owners: (id, owner), owner null for what belongs to no class.
    """
    own = owners.select(F.col("id").alias("src"), F.col("owner").alias("src_owner"))
    far = owners.select(F.col("id").alias("dst"), F.col("owner").alias("dst_owner"))
    both = edges.join(own, "src", "left").join(far, "dst", "left")
    target = F.when(F.col("dst_owner").isNotNull() & ~F.col("dst_owner").eqNullSafe(F.col("src_owner")), F.col("dst_owner")).otherwise(F.col("dst"))
    private = F.col("dst_owner").isNotNull() & F.col("dst_owner").eqNullSafe(F.col("src_owner"))
    return both.filter(~private).select("src", target.alias("dst")).filter("src <> dst").filter(~F.col("dst").eqNullSafe(F.lit(""))).distinct()


def gathered_context(components: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, dependencies, callers): ids that a component uses and that use it, sorted."""
    a = edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("dst")).alias("dependencies"))
    b = edges.groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_set("src")).alias("callers"))
    return components.select("id").distinct().join(a, "id", "left").join(b, "id", "left")


def containment_counts(texts: DataFrame, words: DataFrame, key: str, text: str, word: str) -> DataFrame:
    """(key, found): how many distinct words stand in a text as tokens; an equality join over the text's own tokens."""
    tokens = texts.select(F.col(key), F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"([a-z_]\w*)"), F.lit(1)))).alias("__k"))
    hits = tokens.join(words.select(F.lower(word).alias("__k")).distinct(), "__k").groupBy(key).agg(F.count("*").alias("found"))
    return texts.select(key).distinct().join(hits, key, "left").select(key, F.coalesce("found", F.lit(0)).alias("found"))


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """table with the non-null fields of changes set, unknown keys added (a partial update by full outer join)."""
    extra = [c for c in changes.columns if c != key]
    renamed = changes.select(key, *[F.col(c).alias(f"__{c}") for c in extra])
    joined = table.join(renamed, key, "full_outer")
    return joined.select(key, *[F.coalesce(f"__{c}", c).alias(c) if c in extra else F.col(c) for c in table.columns if c != key])


def element_updated(array: str, field: str, value, changes: dict[str, Column]) -> Column:
    """An array of structs with fields of the elements that have field = value replaced."""
    def one(x):
        new = x
        for name, c in changes.items():
            new = new.withField(name, c)
        return F.when(x[field] == value, new).otherwise(x)

    return F.transform(F.col(array), one)


