"""Problem 8: mixing sources to target weights.

The largest total B for which no source has to repeat a document more than its cap is the least of tokens x cap / share over the
sources; each source gives share x B tokens. The copies of its documents lie one after another on a line, in the order of a hash of the
key, and the source takes the line's beginning; where on the line a copy starts comes from sums over hash ranges and sums inside them,
so no source is ever summed or sorted in one task.

The line is cut into quanta of one size, no smaller than the largest document. Pfair scheduling gives quantum j of a source with weight w
the release time floor(j / w) and the deadline ceil((j + 1) / w) in slots; among the released ones the earliest deadline runs next, so
after every slot each source is less than one quantum away from its share. Documents stay whole and follow the quantum where they start,
at most one of them beyond its end, so in tokens each source is always less than a block of two quanta away from its share. The schedule
knows counts of quanta only and has a stated length (SLOTS at most), whatever the corpus' size.

Defined results: documents of null or unlisted sources, and without tokens, stay out; a source listed more than once counts with its
first row in order; a share that is null or not positive contributes nothing, a cap that is null counts as 1; a listed source without
tokens is reported with share 0 and the others keep their proportions; an empty table gives an empty mix.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oresieve.llm.tokenizing import TOKENIZERS, VOCABULARY, encoded

#: Most slots of the schedule: the size of a quantum follows from it.
SLOTS = 8192
#: Documents of a hash range that are summed in one task, and the most ranges of all sources, whose sums are the only thing that is broadcast.
RANGE_DOCS, MOST_RANGES = 100_000, 65_536


def schedule(weights: dict[str, float], blocks: dict[str, int]) -> list[tuple[str, int, int]]:
    """(source, block, slot) by earliest deadline first among the released blocks of each source.

    weights: positive shares; they are taken as exact fractions of their sum. blocks: how many each source has.
    """
    exact = {s: Fraction(w).limit_denominator(10**9) for s, w in weights.items() if w > 0 and blocks.get(s, 0) > 0}
    total = sum(exact.values())
    if not total:
        return []
    exact = {s: w / total for s, w in exact.items()}
    ready: list[tuple[int, str, int]] = []
    waiting: list[tuple[int, int, str, int]] = []
    for s, w in exact.items():
        waiting.append((0, math.ceil(1 / w), s, 0))
    heapq.heapify(waiting)
    out, slot = [], 0
    while ready or waiting:
        while waiting and waiting[0][0] <= slot:
            _, deadline, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, s, j))
        if not ready:
            slot = waiting[0][0]
            continue
        _, s, j = heapq.heappop(ready)
        out.append((s, j, slot))
        slot += 1
        if j + 1 < blocks[s]:
            w = exact[s]
            heapq.heappush(waiting, (math.floor((j + 1) / w), math.ceil((j + 2) / w), s, j + 1))
    return out


def sized(docs: DataFrame, key: str, text: str, source: str, folder: str, vocabulary: str) -> DataFrame:
    some = docs.filter(F.col(source).isNotNull()).select(F.col(key).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text"))
    return encoded(some, "doc_id", "text", ["source"], "n_tokens", folder, vocabulary).filter("n_tokens > 0")


def _targets(targets: DataFrame) -> DataFrame:
    first = Window.partitionBy("source").orderBy("target_share", "max_repeats")
    one = targets.filter("source IS NOT NULL").withColumn("at", F.row_number().over(first)).filter("at = 1")
    return one.select("source", F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(1)).alias("max_repeats"))


def mixed(docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", slots: int = SLOTS, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, copy, n_tokens, slot, place): a row for each use of a document; slot and place give the order."""
    spark = docs.sparkSession
    tokens = sized(docs, key, text, source, folder, vocabulary).join(F.broadcast(_targets(targets)).filter("target_share > 0"), "source").persist()
    # one row a listed source: bounded by the table of targets
    totals = {r["source"]: r for r in tokens.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.first("target_share").alias("share"), F.first("max_repeats").alias("cap"), F.count("*").alias("docs"), F.max("n_tokens").alias("largest")).collect()}
    schema = "doc_id long, source string, copy int, n_tokens int, slot long, place long"
    if not totals:
        return spark.createDataFrame([], schema)
    whole = sum(r["share"] for r in totals.values())
    budget = min(r["tokens"] * r["cap"] * whole / r["share"] for r in totals.values())
    quota = {s: r["share"] / whole * budget for s, r in totals.items()}
    block = max(math.ceil(budget / slots), *[r["largest"] for r in totals.values()], 1)
    plan = schedule({s: r["share"] for s, r in totals.items()}, {s: math.ceil(quota[s] / block) for s in totals})

    ranges = min(max(1, MOST_RANGES // len(totals)), 16 + max(r["docs"] for r in totals.values()) // RANGE_DOCS)
    ordered = tokens.withColumn("h", F.xxhash64("doc_id")).withColumn("range", F.floor((F.col("h").cast("double") + 2.0**63) / 2.0**64 * ranges).cast("int"))
    sums = ordered.groupBy("source", "range").agg(F.sum("n_tokens").alias("tokens"))
    # at most MOST_RANGES rows, or one a listed source
    before = sums.withColumn("before", F.coalesce(F.sum("tokens").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("tokens")
    inside = Window.partitionBy("source", "range").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    starts = ordered.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(F.broadcast(before), ["source", "range"])
    known = spark.createDataFrame([(s, int(r["tokens"]), float(quota[s])) for s, r in totals.items()], "source string, tokens long, quota double")
    line = starts.join(F.broadcast(known), "source").withColumn("start", F.col("before") + F.col("inside"))
    rounds = F.ceil(F.col("quota") / F.col("tokens")).cast("int")
    uses = line.withColumn("copy", F.explode(F.sequence(F.lit(0), F.least(rounds, F.col("max_repeats")) - 1))).withColumn("at", F.col("copy") * F.col("tokens") + F.col("start"))
    # a use counts if most of it lies before the quota
    kept = uses.filter(F.col("at") + F.col("n_tokens") / 2 <= F.col("quota")).withColumn("block", F.floor(F.col("at") / block).cast("long"))
    slots_of = spark.createDataFrame(plan, "source string, block long, slot long")
    final = kept.join(F.broadcast(slots_of), ["source", "block"])
    return final.select("doc_id", "source", "copy", "n_tokens", "slot", (F.col("at") - F.col("block") * block).cast("long").alias("place"))


def shares(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, documents, uses, most_uses) of every listed source."""
    each = mix.groupBy("source", "doc_id").agg(F.count("*").alias("uses"), F.sum("n_tokens").alias("tokens"))
    by = each.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"), F.sum("uses").alias("uses"), F.max("uses").alias("most_uses"))
    total = by.agg(F.sum("tokens").alias("total"))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("tokens", "documents", "uses", "most_uses")]
    joined = _targets(targets).join(by, "source", "left").crossJoin(F.broadcast(total))  # total is one row
    return joined.select("source", "target_share", F.round(F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0)), 6).alias("actual_share"), *zero)
