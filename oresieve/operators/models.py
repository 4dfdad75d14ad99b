"""The surface of model-backed steps: batches go to an injected callable text -> text; nothing here needs a model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oresieve.functions.text import col, tag_text, tag_true


def answered(rows: DataFrame, prompt: str, model: Callable[[str], str], retries: int = 3, name: str = "reply") -> DataFrame:
    """rows with the model's reply; a call that raises is tried again, and gives null after the last time."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            replies = []
            for text in batch.column(batch.schema.get_field_index(prompt)).to_pylist():
                reply = None
                for _ in range(retries):
                    try:
                        reply = model(text or "")
                        break
                    except Exception:
                        continue
                replies.append(reply)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(replies, pa.string())], names=[*batch.schema.names, name])

    return rows.mapInArrow(run, f"{fields}, {name} string")


def short_circuit(rows: DataFrame, simple: Column, constant: str, prompt: str, model: Callable[[str], str], name: str = "reply") -> DataFrame:
    """Simple rows get a constant; only the others reach the model, as the table is split before the call."""
    easy = rows.filter(simple).withColumn(name, F.lit(constant))
    return answered(rows.filter(~F.coalesce(simple, F.lit(False))), prompt, model, name=name).unionByName(easy)


def batch_decision(reply, index: Column, fallback: Column) -> Column:
    """yes or no of the line COMPONENT n: YES|NO, else the fallback."""
    all_ = F.regexp_extract_all(F.coalesce(col(reply), F.lit("")), F.lit(r"(?i)COMPONENT\s+(\d+)\s*:\s*(?:YES|NO)"), F.lit(1))
    answers = F.regexp_extract_all(F.coalesce(col(reply), F.lit("")), F.lit(r"(?i)COMPONENT\s+\d+\s*:\s*(YES|NO)"), F.lit(1))
    at = F.array_position(all_, index.cast("string"))
    return F.when(at > 0, F.upper(F.get(answers, (at - 1).cast("int"))) == "YES").otherwise(fallback)


def verdict(reply) -> dict[str, Column]:
    """The tagged parts of a verifier's reply; flags are false where absent."""
    return {
        "needs_revision": tag_true(reply, "NEED_REVISION"),
        "needs_context": tag_true(reply, "MORE_CONTEXT"),
        "suggestion": F.coalesce(tag_text(reply, "SUGGESTION"), F.lit("")),
        "context_suggestion": F.coalesce(tag_text(reply, "SUGGESTION_CONTEXT"), F.lit("")),
    }


def overridden(needs_revision: Column, needs_context: Column, exhausted: Column, category: Column, suggestion: Column) -> dict[str, Column]:
    """A verdict after the rules: no more context where it is exhausted, minimal documentation is not revised for context or without a reason."""
    context = needs_context & ~exhausted & (category != "minimal")
    revise = F.when((category == "minimal") & (F.length(F.trim(suggestion)) == 0), False).when(exhausted & needs_context & (F.length(F.trim(suggestion)) == 0), False).otherwise(needs_revision)
    return {"needs_revision": revise, "needs_context": context}


def request_xml(calls: Column, callers: Column, queries: Column) -> Column:
    """The request of a reader as XML text."""
    part = lambda tag, items: F.concat(F.lit(f"<{tag}>"), F.array_join(F.coalesce(items, F.array().cast("array<string>")), ","), F.lit(f"</{tag}>"))
    return F.concat(F.lit("<REQUEST><INTERNAL>"), part("CALLS", calls), part("CALL_BY", callers), F.lit("</INTERNAL>"), part("RETRIEVAL", queries), F.lit("</REQUEST>"))


def parsed_request(xml) -> dict[str, Column]:
    items = lambda tag: F.filter(F.transform(F.split(F.coalesce(tag_text(xml, tag), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return {"calls": items("CALLS"), "callers": items("CALL_BY"), "queries": items("RETRIEVAL")}


def call_cost(model, prompt_tokens, completion_tokens, prices: dict[str, tuple[float, float]], default: tuple[float, float] = (0.001, 0.002)) -> Column:
    """Cost of a call by a price table for a thousand tokens of prompt and completion."""
    a, b = F.lit(default[0]), F.lit(default[1])
    for name, (x, y) in prices.items():
        a, b = F.when(col(model) == name, x).otherwise(a), F.when(col(model) == name, y).otherwise(b)
    return col(prompt_tokens) / 1000 * a + col(completion_tokens) / 1000 * b
