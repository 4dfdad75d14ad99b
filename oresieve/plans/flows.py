"""Logs, ordered rows and event streams read as tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from oresieve.operators import agentlog, graph, joins
from oresieve.plans.tables import COMPONENTS, FILES, LOGS, components, files, log_lines, table

_RE = "^(\\d{4}-\\d{2}-\\d{2} \\d{2}:\\d{2}:\\d{2}) - (\\S+) - (\\w+) - (.*)$"
_NAMES = "coalesce(" + ", ".join(f"nullif(regexp_extract(message, '{p}', 1), '')" for p in agentlog.NAMES) + ")"
PARSED = f"""(SELECT *, CASE WHEN bad THEN 'failed' ELSE 'success' END AS status, CASE WHEN bad THEN 'error' WHEN contains(lower(message), 'complete') THEN 'completed' WHEN regexp_matches(lower(message), 'component|analyzing|generating documentation|verifying documentation') THEN 'analyzing' ELSE 'executing' END AS action, {_NAMES} AS component_name
 FROM (SELECT doc_id, try_strptime(regexp_extract(v, '{_RE}', 1), '%Y-%m-%d %H:%M:%S') AS ts, lower(split_part(regexp_extract(v, '{_RE}', 2), 'agent.', 2)) AS agent_name, regexp_extract(v, '{_RE}', 3) AS level, regexp_extract(v, '{_RE}', 4) AS message,
 contains(lower(regexp_extract(v, '{_RE}', 4)), 'error') OR regexp_extract(v, '{_RE}', 3) = 'ERROR' AS bad FROM (SELECT doc_id, trim(value, ' ') AS v FROM {LOGS}) WHERE regexp_matches(v, '{_RE}') AND contains(regexp_extract(v, '{_RE}', 2), 'agent.')))"""


def _rows(spark, sf):
    return agentlog.parsed(log_lines(spark, sf))


def log_parse(spark, sf):
    return _rows(spark, sf).groupBy("agent_name", "action", "status", "level").agg(F.count("*").alias("n"), F.count("component_name").alias("named"), F.min("ts").alias("first"), F.max("ts").alias("last"))


SQL_PARSE = f"SELECT agent_name, action, status, level, count(*) AS n, count(component_name) AS named, min(ts) AS first, max(ts) AS last FROM {PARSED} GROUP BY 1, 2, 3, 4"


def agent_statistics(spark, sf):
    return agentlog.agent_statistics(_rows(spark, sf))


SQL_AGENTS = f"""SELECT agent_name, count(*) AS total, count(*) FILTER (action = 'completed') AS completed, count(*) FILTER (status = 'failed') AS errors, round((count(*) - count(*) FILTER (status = 'failed')) / count(*) * 100, 2) AS success_rate FROM {PARSED} GROUP BY ROLLUP (agent_name)"""


def error_taxonomy(spark, sf):
    return agentlog.error_classes(_rows(spark, sf))


_K = f"CASE WHEN bad AND regexp_matches(message, '{agentlog.CRITICAL}') THEN 'critical' WHEN bad AND regexp_matches(message, '{agentlog.TOOLS}') THEN 'tool' WHEN bad THEN 'recoverable' END"
SQL_ERRORS = f"""WITH k AS (SELECT *, {_K} AS kind FROM {PARSED}) SELECT count(*) AS rows, count(*) FILTER (kind = 'critical') AS critical, count(*) FILTER (kind = 'tool') AS tool, count(*) FILTER (kind = 'recoverable') AS recoverable,
 round(count(*) FILTER (bad) / greatest(count(*), 1), 4) AS error_rate, round(count(*) FILTER (kind = 'recoverable') / greatest(count(*) FILTER (bad), 1), 4) AS recovery_rate FROM k"""


def component_flow(spark, sf):
    return agentlog.component_flows(_rows(spark, sf)).select("component_name", F.array_join("agents", ",").alias("agents"), "executions", "status")


_L = "lower(message)"
SQL_FLOW = f"""WITH r AS (SELECT * FROM {PARSED} WHERE component_name IS NOT NULL), a AS (
 SELECT component_name, agent_name AS agent FROM r WHERE agent_name IN ('reader', 'searcher', 'writer', 'verifier')
 UNION SELECT component_name, 'reader' FROM r WHERE (contains({_L}, 'reader') AND NOT contains({_L}, 'searcher')) OR contains({_L}, 'reader-searcher converged')
 UNION SELECT component_name, 'searcher' FROM r WHERE (contains({_L}, 'searcher') AND NOT contains({_L}, 'reader')) OR contains({_L}, 'reader-searcher converged')
 UNION SELECT component_name, 'writer' FROM r WHERE contains({_L}, 'writer') UNION SELECT component_name, 'verifier' FROM r WHERE contains({_L}, 'verifier')),
 s AS (SELECT component_name, string_agg(agent, ',' ORDER BY agent) AS agents FROM a GROUP BY 1)
SELECT r.component_name, any_value(agents) AS agents, count(*) AS executions, CASE WHEN count(*) FILTER (status = 'failed' AND agent_name IN ('reader', 'searcher', 'writer', 'verifier')) > 0 THEN 'failed' ELSE 'success' END AS status
FROM r JOIN s ON r.component_name = s.component_name GROUP BY r.component_name HAVING count(*) FILTER (agent_name IN ('reader', 'searcher', 'writer', 'verifier')) > 0"""


def transparency(spark, sf):
    return agentlog.transparency(_rows(spark, sf), "doc_id", "agent_name", list(agentlog.TRACKED))


SQL_TRANSPARENCY = f"""WITH c AS (SELECT doc_id, count(DISTINCT agent_name) FILTER (agent_name IN ('reader', 'searcher', 'writer', 'verifier')) AS agents FROM {PARSED} GROUP BY 1)
SELECT doc_id, agents, CAST(CASE WHEN agents = 4 THEN 1.0 WHEN agents >= 2 THEN 0.5 ELSE 0.0 END AS DOUBLE) AS score FROM c"""


def log_handoffs(spark, sf):
    rows = _rows(spark, sf)
    return agentlog.handoff_matrix(agentlog.handoffs(rows, ["doc_id"], ["line_no"]))


def repo_windows(spark, sf):
    starts = files(spark, sf).select("repo", F.col("scanned_at").alias("ts"))
    return agentlog.windows(starts)


SQL_WINDOWS = f"""WITH f AS {FILES}, l AS (SELECT repo, max(scanned_at) AS start FROM f GROUP BY repo)
SELECT repo, start, (SELECT min(scanned_at) FROM f WHERE scanned_at > l.start) AS "end" FROM l"""


def window_rows(spark, sf):
    f = files(spark, sf).select("repo", "file_id", F.col("scanned_at").alias("ts"))
    return agentlog.inside(f, agentlog.windows(f.select("repo", "ts"))).groupBy("repo").agg(F.count("*").alias("files"))


SQL_INSIDE = f"WITH w AS ({SQL_WINDOWS}) SELECT f.repo, count(*) AS files FROM {FILES} f JOIN w ON f.repo = w.repo AND scanned_at >= start AND (w.\"end\" IS NULL OR scanned_at < w.\"end\") GROUP BY f.repo"


def _latencies(spark, sf):
    return agentlog.latencies(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"])


_DELTA = """(SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1000.0 AS d FROM events)"""


def latency(spark, sf):
    out = agentlog.latency_summary(_latencies(spark, sf), "event_type")
    return out.select("event_type", "total", *[F.round(c, 3).alias(c) for c in ("mean", "least", "greatest", "p50", "p90", "p99")])


SQL_LATENCY = f"""WITH d AS (SELECT event_type, d FROM {_DELTA} WHERE d > 0 AND d < 300000), s AS (SELECT event_type, list_sort(list(d)) AS l, count(*) AS n, avg(d) AS m FROM d GROUP BY 1)
SELECT event_type, n AS total, round(m, 3) AS mean, round(l[1], 3) AS least, round(l[n], 3) AS greatest, round(l[n // 2 + 1], 3) AS p50, round(l[CAST(floor(n * 0.9) AS INT) + 1], 3) AS p90, round(CASE WHEN n > 100 THEN l[CAST(floor(n * 0.99) AS INT) + 1] ELSE l[n] END, 3) AS p99 FROM s"""


def _event_handoffs(spark, sf):
    e = table(spark, sf, "events").withColumn("status", F.when(F.col("event_type") == "error", "failed").otherwise("success"))
    return agentlog.handoffs(e, ["user_id"], ["ts", "event_id"], "event_type")


def handoff_matrix(spark, sf):
    return agentlog.handoff_matrix(_event_handoffs(spark, sf))


_HAND = "(SELECT s AS source, event_type AS target, event_type <> 'error' AS ok FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM events) WHERE s IS NOT NULL AND s <> event_type)"
SQL_HANDOFF = f"SELECT source, target, count(*) AS n, count(*) FILTER (ok) AS succeeded FROM {_HAND} GROUP BY 1, 2"


def collaboration(spark, sf):
    return agentlog.collaboration(_event_handoffs(spark, sf), F.lit(0.25))


SQL_COLLAB = f"SELECT count(*) AS handoffs, round(count(*) FILTER (ok) / greatest(count(*), 1), 4) AS success_rate, round(greatest(count(*) FILTER (ok) / greatest(count(*), 1) - 0.3 * 0.25, 0), 4) AS score FROM {_HAND}"


def learning_curve(spark, sf):
    return agentlog.learning_curve(table(spark, sf, "events").filter("value IS NOT NULL"), "user_id", ["ts", "event_id"], "value")


SQL_CURVE = """WITH p AS (SELECT user_id, value, row_number() OVER w - 1 AS i, abs(lead(value) OVER w - value) AS d FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT user_id, arg_min(value, i) AS first, arg_max(value, i) AS last, CAST(min(CASE WHEN d < 0.01 THEN i + 1 END) AS INT) AS converged_at FROM p GROUP BY 1), c AS (SELECT *, CASE WHEN first = 0 THEN 0.0 ELSE (last - first) / first END AS ch FROM b)
SELECT user_id, first, last, round(ch, 6) AS improvement, CASE WHEN ch > 0.1 THEN 'improving' WHEN ch < -0.1 THEN 'declining' ELSE 'stable' END AS trend, converged_at FROM c"""


def running_offset(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "ts", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return graph.running_offset(e, ["user_id"], ["ts", "event_id"], "k").select("event_id", F.col("shift").cast("long").alias("shift"))


SQL_OFFSET = "SELECT event_id, CAST(coalesce(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS shift FROM events"


def last_definition(spark, sf):
    e = table(spark, sf, "events")
    out = joins.last_before(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "click", "event_id")
    return out.filter("event_type = 'purchase'").select("event_id", "last_event_id")


SQL_LAST = "SELECT event_id, c AS last_event_id FROM (SELECT *, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM events) WHERE event_type = 'purchase'"


def recent_events(spark, sf):
    return agentlog.recent(table(spark, sf, "events"), [F.desc("ts"), F.desc("event_id")]).select("event_id", "event_type")


SQL_RECENT = "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50"


def batches(spark, sf):
    c = components(spark, sf).filter("scan_ord IS NOT NULL")
    return graph.batches(c, ["repo"], ["scan_ord", "id"]).groupBy("repo", "batch").agg(F.count("*").alias("n"), F.min("id").alias("first"))


SQL_BATCHES = f"SELECT repo, batch, count(*) AS n, min(id) AS first FROM (SELECT repo, id, CAST(floor((row_number() OVER (PARTITION BY repo ORDER BY scan_ord, id) - 1) / 5) AS BIGINT) AS batch FROM {COMPONENTS} WHERE scan_ord IS NOT NULL) GROUP BY 1, 2"


def misalignment(spark, sf):
    return agentlog.misalignment(components(spark, sf), "existing_docstring", "source_code", "type")


def instruction_following(spark, sf):
    return agentlog.instruction_following(components(spark, sf), "existing_docstring")


_T = "trim(coalesce(existing_docstring, ''), ' ')"
SQL_FOLLOW = f"""WITH f AS (SELECT length({_T}) > 50 AS l, regexp_matches({_T}, 'Args:|@param|:param|Parameters') AS p, regexp_matches({_T}, 'Returns:|@returns|@return|:returns') AS r FROM {COMPONENTS})
SELECT CASE WHEN l AND p AND r THEN 'followed' WHEN l AND (p OR r) THEN 'partial' ELSE 'not_followed' END AS state, count(*) AS n FROM f GROUP BY 1"""

QUERIES = {
    "log_parse": (log_parse, SQL_PARSE), "agent_statistics": (agent_statistics, SQL_AGENTS), "error_taxonomy": (error_taxonomy, SQL_ERRORS), "component_flow": (component_flow, SQL_FLOW), "transparency": (transparency, SQL_TRANSPARENCY),
    "log_handoffs": (log_handoffs, None), "repo_windows": (repo_windows, SQL_WINDOWS), "window_rows": (window_rows, SQL_INSIDE), "latency": (latency, SQL_LATENCY), "handoff_matrix": (handoff_matrix, SQL_HANDOFF), "collaboration": (collaboration, SQL_COLLAB),
    "learning_curve": (learning_curve, SQL_CURVE), "running_offset": (running_offset, SQL_OFFSET), "last_definition": (last_definition, SQL_LAST), "recent_events": (recent_events, SQL_RECENT), "batches": (batches, SQL_BATCHES), "misalignment": (misalignment, None),
    "instruction_following": (instruction_following, SQL_FOLLOW),
}
