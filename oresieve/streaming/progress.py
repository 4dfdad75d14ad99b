"""Streams of progress events, and state with a time to live."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from oresieve.functions.text import sse_event

EVENT = "repo_id string, stage string, percent double, message string, ts timestamp"


def stamped(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.coalesce("ts", F.current_timestamp()))


def published(events: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Every micro-batch goes to handler once; without replay for what came before the subscription."""
    return stamped(events).writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def sse_lines(events: DataFrame, name: str = "progress") -> DataFrame:
    return events.select("repo_id", sse_event(name, F.to_json(F.struct("stage", "percent", "message"))).alias("value"))


def windowed_counts(events: DataFrame, ts: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by tumbling window and key; rows later than the watermark are dropped."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n"))


def latest_state(snapshot: DataFrame, events: DataFrame) -> DataFrame:
    """(repo_id, stage, percent): the newest of snapshot and events for each repository."""
    both = snapshot.select("repo_id", "stage", "percent", "ts").unionByName(events.select("repo_id", "stage", "percent", "ts"))
    return both.groupBy("repo_id").agg(F.max_by(F.struct("stage", "percent"), "ts").alias("s")).select("repo_id", "s.stage", "s.percent")


def unexpired(cache: DataFrame, now, ttl_seconds: int, created: str = "created") -> DataFrame:
    """Cache rows that have not outlived their time."""
    return cache.filter(F.unix_timestamp(now) - F.unix_timestamp(created) <= ttl_seconds)


def cached_replies(requests: DataFrame, ttl_ms: int, late: str = "1 minute") -> DataFrame:
    """(key, hit, hits): whether an equal request came within the time to live before; requests: (key, ts).

    The state of a key leaves once the watermark has passed its time to live.
    """

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, hits = state.get if state.exists else (None, 0)
        for frame in frames:
            rows = []
            for t in sorted(int(x.timestamp() * 1000) for x in pd.to_datetime(frame["ts"])):
                hit = last is not None and t - last <= ttl_ms
                hits = hits + 1 if hit else 0
                last = last if hit else t
                rows.append((key[0], hit, hits))
            yield pd.DataFrame(rows, columns=["key", "hit", "hits"]).astype({"key": object, "hit": bool, "hits": "int64"})
        state.update((last, hits))
        state.setTimeoutTimestamp(max(last + ttl_ms, state.getCurrentWatermarkMs()) + 1)

    return requests.withWatermark("ts", late).groupBy("key").applyInPandasWithState(step, "key string, hit boolean, hits long", "last long, hits long", "append", "EventTimeTimeout")


def convergence(rounds: DataFrame, key: str, order: str, request: str, empties: int = 2, most: int = 3) -> DataFrame:
    """(key, rounds, reason): where a loop of requests stops: an unchanged request, two empty ones in a row, or the limit."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(order)
    empty = F.coalesce(F.col(request), F.lit("")) == ""
    placed = rounds.withColumn("i", F.row_number().over(w)).withColumn("same", F.col(request) == F.lag(request).over(w)).withColumn("idle", empty & F.coalesce(F.lag(empty).over(w), F.lit(False)))
    stop = F.when(F.coalesce("same", F.lit(False)) & ~empty, "unchanged").when(F.col("idle"), "exhausted").when(F.col("i") >= most, "limit")
    ends = placed.withColumn("reason", stop).groupBy(key).agg(F.min(F.when(F.col("reason").isNotNull(), F.struct("i", "reason"))).alias("e"), F.max("i").alias("n"))
    return ends.select(key, F.coalesce("e.i", "n").alias("rounds"), F.coalesce("e.reason", F.lit("ended")).alias("reason"))
