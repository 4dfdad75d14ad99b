"""Execution logs of agents: parsing, windows of repositories, flows of components and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oresieve.functions.code import guarded
from oresieve.functions.text import col

TRACKED = ("reader", "searcher", "writer", "verifier")
_LINE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) - (\S+) - (\w+) - (.*)$"
# How messages name a component, in order.
NAMES = (
    r"(?i)component[_ ]id[:=]\s*(\S+)",
    r"(?i)processing component \d+/\d+:\s*(\S+)",
    r"(?i)reader complete:\s*(\S+)",
    r"(?i)documentation for:?\s*(\S+)",
    r"(?i)failed to document\s+(\S+?):",
)
# Words of a failed row that make it critical, or a failure of a tool; and words that give reasons.
CRITICAL, TOOLS = r"(?i)critical|fatal|crash|exception", r"(?i)tool|llm|api|timeout|connection"
REASONS = r"(?i)because|since|therefore|thus|due to|as a result|reason|determined|concluded|analysis shows|found that"


def without_ansi(text) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(col(text), F.lit("")), "\\x1b\\[[0-9;]*m", ""))


def component_name(message) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(col(message), p, 1), F.lit("")) for p in NAMES])


def parsed(lines: DataFrame, value: str = "value") -> DataFrame:
    """lines with ts, agent_name, component_name, action, status, level and message; lines of another form are dropped."""
    clean = without_ansi(value)
    part = lambda i: F.regexp_extract(clean, _LINE, i)
    logger, level, message = part(2), part(3), part(4)
    last = F.element_at(F.split(logger, r"\."), -1)
    agent = (
        F.when(F.contains(logger, F.lit("agent.")), F.element_at(F.split(logger, r"agent\."), -1))
        .when(logger.rlike("reader|searcher|writer|verifier"), last)
        .when(F.contains(logger, F.lit("orchestrator")), "orchestrator")
        .when(F.contains(logger, F.lit("pipeline")), "pipeline")
    )
    low = F.lower(message)
    bad = F.contains(low, F.lit("error")) | (level == "ERROR")
    action = F.when(bad, "error").when(F.contains(low, F.lit("complete")), "completed").when(low.rlike("component|analyzing|generating documentation|verifying documentation"), "analyzing").otherwise("executing")
    out = lines.filter(clean.rlike(_LINE)).withColumns(
        {
            "ts": F.try_to_timestamp(part(1), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz"),
            "agent_name": F.lower(agent),
            "component_name": component_name(message),
            "action": action,
            "status": F.when(bad, "failed").otherwise("success"),
            "level": level,
            "message": message,
        }
    )
    return out.filter("agent_name IS NOT NULL").drop(value)


def component_matches(reference, component) -> Column:
    a, b = F.lower(F.trim(col(reference))), F.lower(F.trim(col(component)))
    return F.coalesce((a == b) | F.endswith(a, F.concat(F.lit("."), b)), F.lit(False))


def repo_matches(requested, path) -> Column:
    """The path's last part equals, ends with or holds the requested name, case aside."""
    want, have = F.lower(F.trim(col(requested))), F.lower(col(path))
    return F.coalesce((F.element_at(F.split(F.regexp_replace(have, r"[/\\]+$", ""), r"[/\\]"), -1) == want) | F.endswith(have, want) | F.contains(have, want), F.lit(False))


def windows(starts: DataFrame, key: str = "repo") -> DataFrame:
    """(key, start, end): the last start of each key and the next later start of any key.

    starts: (key, ts). The next start is an as-of lookup over the distinct starts, split by day so that no single task sorts them all.
    """
    last = starts.groupBy(key).agg(F.max("ts").alias("start"))
    days = starts.select(F.to_date("ts").alias("day"), "ts").distinct()
    first = days.groupBy("day").agg(F.min("ts").alias("first"))
    following = first.withColumn("after", F.lead("first").over(Window.orderBy("day"))).select("day", "after")  # a row a day
    both = last.select(F.to_date("start").alias("day"), key, "start").join(days.withColumnRenamed("ts", "t"), "day", "left").filter("t > start OR t = start")
    near = both.groupBy(key, "day", "start").agg(F.min(F.when(F.col("t") > F.col("start"), F.col("t"))).alias("near"))
    return near.join(following, "day", "left").select(key, "start", F.coalesce("near", "after").alias("end"))


def inside(rows: DataFrame, window: DataFrame, key: str = "repo", ts: str = "ts") -> DataFrame:
    """rows of each key inside its half-open window."""
    return rows.join(window, key).filter((F.col(ts) >= F.col("start")) & (F.col("end").isNull() | (F.col(ts) < F.col("end")))).drop("start", "end")


def agent_statistics(rows: DataFrame) -> DataFrame:
    """(agent_name, total, completed, errors, success_rate), and a row with null agent for all."""
    failed = F.count_if(F.col("status") == "failed")
    return rows.rollup("agent_name").agg(
        F.count("*").alias("total"), F.count_if(F.col("action") == "completed").alias("completed"), failed.alias("errors"), F.round((F.count("*") - failed) / F.count("*") * 100, 2).alias("success_rate")
    )


def component_flows(rows: DataFrame) -> DataFrame:
    """(component_name, agents, executions, status) of every component that a tracked agent worked on, or that was skipped."""
    low = F.lower("message")
    inferred = F.array_compact(
        F.array(
            F.when(F.contains(low, F.lit("reader")) & ~F.contains(low, F.lit("searcher")) | F.contains(low, F.lit("reader-searcher converged")), "reader"),
            F.when(F.contains(low, F.lit("searcher")) & ~F.contains(low, F.lit("reader")) | F.contains(low, F.lit("reader-searcher converged")), "searcher"),
            F.when(F.contains(low, F.lit("writer")), "writer"),
            F.when(F.contains(low, F.lit("verifier")), "verifier"),
        )
    )
    tracked = F.col("agent_name").isin(*TRACKED)
    skipped = (F.col("agent_name") == "orchestrator") & F.contains(low, F.lit("skipping"))
    by = rows.filter("component_name IS NOT NULL").groupBy("component_name").agg(
        F.count("*").alias("executions"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(tracked, F.array_union(F.array("agent_name"), inferred)).otherwise(inferred))))).alias("agents"),
        F.count_if(tracked).alias("own"),
        F.count_if(tracked & (F.col("status") == "failed")).alias("bad"),
        F.count_if(skipped).alias("skips"),
    )
    status = F.when((F.col("own") == 0) & (F.col("skips") > 0), "skipped").when(F.col("bad") > 0, "failed").otherwise("success")
    return by.filter("own > 0 OR skips > 0").select("component_name", F.when(F.col("own") > 0, F.col("agents")).otherwise(F.array().cast("array<string>")).alias("agents"), F.when(F.col("own") > 0, F.col("executions")).otherwise(F.col("skips")).alias("executions"), status.alias("status"))


def latencies(rows: DataFrame, keys: list[str], order: list[str], ts: str = "ts", most: int = 300_000) -> DataFrame:
    """rows with the milliseconds since the row before, where they lie between 0 and `most`."""
    prior = F.lag(ts).over(Window.partitionBy(*keys).orderBy(*order))
    delta = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(prior.cast("timestamp"))) / 1000.0
    return rows.withColumn("delta_ms", delta).filter((F.col("delta_ms") > 0) & (F.col("delta_ms") < most))


def latency_summary(deltas: DataFrame, key: str, value: str = "delta_ms") -> DataFrame:
    """Mean, least, greatest and index percentiles by key: p50 at n//2, p90 at floor(0.9 n), p99 the same way only beyond 100 values.

    Ranks come from counts of equal values, so no group is gathered in one row.
    """
    counts = deltas.groupBy(key, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(key).orderBy(value)
    ranked = counts.withColumn("upto", F.sum("n").over(w)).withColumn("from", F.col("upto") - F.col("n"))
    total = counts.groupBy(key).agg(F.sum("n").alias("total"), F.round(F.sum(F.col(value) * F.col("n")) / F.sum("n"), 3).alias("mean"), F.min(value).alias("least"), F.max(value).alias("greatest"))
    both = ranked.join(total, key)
    at = lambda i: F.max(F.when((F.col("from") <= i) & (i < F.col("upto")), F.col(value)))
    half, ninety, most = F.floor(F.col("total") / 2), F.floor(F.col("total") * 0.9), F.floor(F.col("total") * 0.99)
    return both.groupBy(key, "total", "mean", "least", "greatest").agg(at(half).alias("p50"), at(ninety).alias("p90"), F.coalesce(F.when(F.first("total") > 100, at(most)), F.max("greatest")).alias("p99"))


def handoffs(rows: DataFrame, keys: list[str], order: list[str], agent: str = "agent_name") -> DataFrame:
    """(source, target, ok): changes from one agent to another inside each group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("source", F.lag(agent).over(w)).filter(F.col("source").isNotNull() & (F.col("source") != F.col(agent))).select("source", F.col(agent).alias("target"), (F.col("status") != "failed").alias("ok"))


def handoff_matrix(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("source", "target").agg(F.count("*").alias("n"), F.count_if("ok").alias("succeeded"))


def collaboration(pairs: DataFrame, rejected: Column) -> DataFrame:
    """(handoffs, success_rate, score): the score is the rate less 0.3 of the rejections, not under 0."""
    rate = guarded(F.count_if("ok"), F.count("*"))
    return pairs.agg(F.count("*").alias("handoffs"), F.round(rate, 4).alias("success_rate"), F.round(F.greatest(rate - 0.3 * rejected, F.lit(0.0)), 4).alias("score"))


def learning_curve(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """(key, first, last, improvement, trend, converged_at): relative change of a series, and the first place where it moves less than 0.01."""
    w = Window.partitionBy(key).orderBy(*order)
    placed = rows.withColumn("__i", F.row_number().over(w) - 1).withColumn("__d", F.abs(F.lead(value).over(w) - F.col(value)))
    by = placed.groupBy(key).agg(F.min_by(value, "__i").alias("first"), F.max_by(value, "__i").alias("last"), F.min(F.when(F.col("__d") < 0.01, F.col("__i") + 1)).alias("converged_at"))
    change = F.when(F.col("first") == 0, 0.0).otherwise((F.col("last") - F.col("first")) / F.col("first"))
    return by.select(key, "first", "last", F.round(change, 6).alias("improvement"), F.when(change > 0.1, "improving").when(change < -0.1, "declining").otherwise("stable").alias("trend"), "converged_at")


def error_classes(rows: DataFrame) -> DataFrame:
    """One row of rates: critical, tool and recoverable failures over all rows, and the share recovered."""
    bad = F.col("status") == "failed"
    kind = F.when(bad & F.col("message").rlike(CRITICAL), "critical").when(bad & F.col("message").rlike(TOOLS), "tool").when(bad, "recoverable")
    c = lambda k: F.count_if(kind == k)
    total = F.count("*")
    return rows.agg(
        total.alias("rows"), c("critical").alias("critical"), c("tool").alias("tool"), c("recoverable").alias("recoverable"),
        F.round(guarded(F.count_if(bad), total), 4).alias("error_rate"), F.round(guarded(c("recoverable"), F.count_if(bad)), 4).alias("recovery_rate"),
    )


def explainability(rows: DataFrame) -> DataFrame:
    return rows.agg(F.round(F.avg(F.col("message").rlike(REASONS).cast("int")), 4).alias("reasoned"))


def transparency(rows: DataFrame, key: str, agent: str, expected: list[str]) -> DataFrame:
    """(key, agents, score): 1 where all expected agents occur, 0.5 where at least two do."""
    found = rows.filter(F.col(agent).isin(*expected)).groupBy(key).agg(F.count_distinct(agent).alias("agents"))
    whole = rows.select(key).distinct().join(found, key, "left").select(key, F.coalesce("agents", F.lit(0)).alias("agents"))
    return whole.withColumn("score", F.when(F.col("agents") == len(expected), 1.0).when(F.col("agents") >= 2, 0.5).otherwise(0.0))


def misalignment(docs: DataFrame, doc: str, source: str, kind: str) -> DataFrame:
    """One row of shares: too short, leaking a model's talk, without sections where the source defines a function, any of them."""
    text = F.trim(F.coalesce(F.col(doc), F.lit("")))
    short = F.length(text) < 20
    leak = text.rlike(r"(?i)as an ai|i cannot|i'm sorry|here is the")
    bare = ~text.rlike(r"Args:|@param|:param|Returns:|@return|:returns") & (F.contains(F.coalesce(F.col(source), F.lit("")), F.lit("def ")) | F.contains(F.col(kind), F.lit("function")))
    avg = lambda c: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("int")), 4)
    return docs.agg(avg(short).alias("short"), avg(leak).alias("leaking"), avg(bare).alias("without_sections"), avg(short | leak | bare).alias("incidents"))


def instruction_following(docs: DataFrame, doc: str) -> DataFrame:
    text = F.trim(F.coalesce(F.col(doc), F.lit("")))
    params, returns = text.rlike(r"Args:|@param|:param|Parameters"), text.rlike(r"Returns:|@returns|@return|:returns")
    state = F.when((F.length(text) > 50) & params & returns, "followed").when((F.length(text) > 50) & (params | returns), "partial").otherwise("not_followed")
    return docs.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def recent(rows: DataFrame, order: list[Column], n: int = 50) -> DataFrame:
    return rows.orderBy(*order).limit(n)
