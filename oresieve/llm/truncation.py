"""Problem 3: values that stop before the writer's text was finished.

1. Each value gives its length and what its end shows by itself: finished (a full stop, a closed tag, closed code), cut (inside a tag or
   a letter, a mark for the missing rest), or open: the template of its last segment and its last word.
2. The corpus tells of a template how often segments that are surely whole end with it and how often they go on, and which words occur
   inside texts: an open end whose template goes on, or whose last word occurs nowhere, is unfinished.
3. For each source and field a log-normal length distribution is fitted by maximum likelihood, values at a candidate limit taken as
   censored there. The posterior that a value of that length was censored, and for other lengths the rate of cuts that the ends show,
   are the prior odds; the end's evidence is the likelihood ratio. A finished end is decisive at any length.

Only lengths, templates and words are shuffled, counted before they are; the fit reads one histogram of lengths a source.

   What ends that no template and no word explain (an unknown template, a bare tag) are worth comes from the corpus: the share of them
   among open ends at limits, weighted by the posterior, over their share elsewhere.

Templates are compared by hashes of their beginnings, one for each piece, so segments of any length count. Only open ends look for a
template: all other values would meet under one key.

Defined results: null, empty and wordless values are not truncated; a value delivered again counts once; a null writer is a source of
its own; texts are read whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oresieve.llm.common import checkpointed, held, map_columns
from oresieve.llm.spam import FUNCTION

FIELDS = ("raw_llm_response", "generated_docstring")
#: Likelihood ratios of an end: cut by itself, template that goes on, word that never ends it, unknown template of a sentence's length,
#: template that ends; those of shorter unknown templates and bare tags are counted.
RATIOS = {"cut": 1e6, "goes_on": 400.0, "unknown_word": 400.0, "unknown_prose": 30.0, "ends": 1e-3, "finished": 1e-6}
COUNTED = ("unknown", "bare_tag")
#: Factor for a docstring that is a true beginning of its reply, or the other way round.
BEGINNING = 200.0
#: Uses of a template's end for each of its last words from which on another word is no end of it; pieces of a sentence.
USES, SENTENCE = 12, 6

_FUNCTION = frozenset(w for words in FUNCTION.values() for w in words.split())
# The marks that stand for a missing rest.
MARK = re.compile(
    r"(?:[\[(<{]\s*(?:\.\.\.|…|cut(?: off)?|truncated|trunc\.?|continued|cont\.?|continues|snip(?:ped)?|omitted|rest omitted|more|\+?\d+ (?:more )?(?:chars?|characters|bytes|tokens|lines)(?: \w+)?|"
    r"abgeschnitten|gekürzt|fortsetzung|tronqué|coupé|suite|truncado|cortado|continúa|continua)\b[^\])>}\n]*[\])>}]|<\|?(?:endoftext|eot|max_tokens|length)\|?>|\(\.\.\.\)|\[…\]|\[\.\.\.\])\s*$",
    re.I,
)
_ELLIPSIS = re.compile(r"(?:\.\.\.+|…)$")
_OPEN_TAG = re.compile(r"^\s*<([A-Za-z_][\w-]*)>")
_CLOSE_TAG = re.compile(r"\s*</[A-Za-z_][\w-]*>\s*$")
_TAG_CUT = re.compile(r"</?[A-Za-z_]*$|<!-*$|&\w*$")
_TERMINAL = re.compile(r"[.!?。！？…][\"'’”»)\]*_`]*$")
_SEGMENTS = re.compile(r"(?<=[.!?。！？])[\"'’”»)\]]*\s+|\n+")
_PIECE = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|\d+|[@:]\w+:?|\S")
_CODE_END = re.compile(
    r"(?:[;{}]|\*/|\"{3}|'{3}|`{3})$|^\s*(?:return|raise|throw|yield|import|break|continue|pass)(?:\s+[\w.\[\]()'\"]+)?$|^\s*(?:const|let|var|def|class|#|//)\s.*$"
    r"|^\s*[\w.$\[\]\"']+\s*[-+*/|&]?=\s*\S.*$|^\s*[\w.]+\(.*\)$"
)
_WORDS = re.compile(r"[^\W_]")
# Texts that stand for nothing said.
PLACEHOLDERS = frozenset("null none nil n/a na tbd todo fixme undefined empty docs docstring documentation".split())


class _Masks(dict):
    """Piece → what stands for it in a template; filled as pieces come, emptied at a size."""

    def __missing__(self, p: str) -> str:
        if len(self) > 500_000:
            self.clear()
        low = p.lower()
        self[p] = out = (low if low in _FUNCTION else "_") if p[0].isalpha() else "0" if p.isdigit() else p
        return out


_MASKS = _Masks()


def template(segment: str) -> tuple[str, str, int]:
    """(function words, tags and signs of a segment with its other words masked, its last word, the number of its pieces)."""
    pieces = _PIECE.findall(segment)
    at = _last_word(pieces)
    return " ".join([_MASKS[p] for p in pieces]), pieces[at].lower() if at >= 0 else "", len(pieces)


def content(text: str) -> str:
    """The text inside a leading tag, closed or not."""
    m = _OPEN_TAG.match(text)
    if not m:
        return text.strip()
    end = text.find(f"</{m.group(1)}>", m.end())
    return text[m.end() : end if end >= 0 else len(text)].strip()


def ending(text: str) -> tuple[str, str, str]:
    """(cut, finished or open; for open ends the last segment's template and last word)."""
    t = text.rstrip()
    closed = _CLOSE_TAG.search(t, max(0, len(t) - 200))
    body = t[: closed.start()].rstrip() if closed else t
    if not _WORDS.search(body) or body.strip("<>/*#'\"` \n").lower() in PLACEHOLDERS:
        return "finished", "", ""
    if MARK.search(body, max(0, len(body) - 120)):
        return "cut", "", ""
    if closed:
        return "finished", "", ""
    m = _OPEN_TAG.match(t)
    if m and f"</{m.group(1)}>" not in t:
        return "cut", "", ""
    if t.endswith("�") or _TAG_CUT.search(t, max(0, len(t) - 60)):
        return "cut", "", ""
    if not _ELLIPSIS.search(t, max(0, len(t) - 8)) and _TERMINAL.search(t, max(0, len(t) - 12)):
        return "finished", "", ""
    if t.count("```") % 2:
        return "cut", "", ""
    tail = t[t.rfind("\n") + 1 :]
    last = _SEGMENTS.split(tail)[-1] if tail.strip() else _SEGMENTS.split(t)[-1]
    line = t[t.rfind("\n") + 1 :]
    if re.search(r"^\s*return\s+\w+$|[;}]$|`{3}$", line) or (line.endswith(":") and len(_PIECE.findall(line)) > SENTENCE):
        return "finished", "", ""
    if _CODE_END.search(line) and not line.lstrip().startswith(("@", "* @", ":")) and all(t.count(a) == t.count(b) for a, b in ("()", "[]", "{}")):
        return "finished", "", ""
    masked, word, _ = template(last)
    return "open", masked, word


def _last_word(pieces: list[str]) -> int:
    """Where the last piece that is a word or tag stands; -1 if none is."""
    for i in range(len(pieces) - 1, -1, -1):
        p = pieces[i]
        if p[0].isalpha() or (len(p) > 1 and not p.isdigit()):
            return i
    return -1


def scanned(text: str) -> tuple[list[tuple[str, str]], set[str]]:
    """(template, last word) of the segments that are surely whole, and the words that are.

    Whole are all segments but the last, all words but the last, and both of those before a closing tag.
    """
    t = text.rstrip()
    closed = _CLOSE_TAG.search(t, max(0, len(t) - 200))
    parts = [_PIECE.findall(s) for s in _SEGMENTS.split(t[: closed.start()].rstrip() if closed else t)]
    parts = [p for p in parts if p]
    whole = []
    for pieces in parts if closed else parts[:-1]:
        at = _last_word(pieces)
        whole.append((" ".join([_MASKS[p] for p in pieces]), pieces[at].lower() if at >= 0 else ""))
    words: set[str] = set()
    for pieces in parts if closed else parts[:-1]:
        words.update(pieces)
    if parts and not closed:
        words.update(parts[-1][: max(0, _last_word(parts[-1]))])
    return whole, {p.lower() for p in words if p[0].isalpha() or len(p) > 1}


def fit_lognormal(lengths: np.ndarray, counts: np.ndarray, censored: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Mean and deviation of log length by maximum likelihood, values where censored is true only known to be at least their length.

    By expectation and maximisation: a censored value counts with the first two moments of the normal tail beyond it.
    """
    x = np.log(np.maximum(lengths, 1.0))
    n = counts.sum()
    mu, sigma = float((counts * x).sum() / n), 0.5
    sigma = max(0.05, math.sqrt(float((counts * (x - mu) ** 2).sum() / n)))
    tail = np.vectorize(lambda z: 0.5 * math.erfc(z / math.sqrt(2)))
    for _ in range(rounds):
        z = (x - mu) / sigma
        hazard = np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi) / np.maximum(tail(z), 1e-12)
        first = np.where(censored, mu + sigma * hazard, x)
        second = np.where(censored, sigma**2 * (1 + z * hazard - hazard**2) + (mu + sigma * hazard) ** 2, x * x)
        new_mu = float((counts * first).sum() / n)
        new_sigma = max(0.05, math.sqrt(max(1e-6, float((counts * second).sum() / n) - new_mu**2)))
        if abs(new_mu - mu) + abs(new_sigma - sigma) < 1e-6:
            break
        mu, sigma = new_mu, new_sigma
    return mu, sigma


def limits(lengths: np.ndarray, counts: np.ndarray, least: int = 5, peak: float = 6.0) -> list[int]:
    """Candidate limits: lengths that hold far more values than their neighbourhood and that few values exceed."""
    order = np.argsort(lengths)
    lengths, counts = lengths[order], counts[order].astype(float)
    total, out = counts.sum(), []
    above = total - np.cumsum(counts)
    for i in np.flatnonzero(counts >= least):
        width = max(10, int(0.06 * lengths[i]))
        lo, hi = np.searchsorted(lengths, [lengths[i] - width, lengths[i] + width + 1])
        near = (counts[lo:hi].sum() - counts[i]) / (2 * width)
        if lengths[i] >= 16 and counts[i] > peak * max(near, 0.2) and (counts[i] > above[i] or counts[i] > 12 * max(near, 0.5)):
            out.append(int(lengths[i]))
    return out


_LIMITS = pa.schema([("writer", pa.string()), ("field_name", pa.string()), ("length", pa.int32()), ("posterior", pa.float64())])


def _fit(hist: pa.Table) -> pa.Table:
    """The candidate limits of one source with the posterior that a value of that length was censored there."""
    lengths, counts = hist["length"].to_numpy().astype(float), hist["n"].to_numpy().astype(float)
    writer, field = hist["writer"][0].as_py(), hist["field_name"][0].as_py()
    found = limits(lengths, counts)
    rows = []
    if found:
        mu, sigma = fit_lognormal(lengths, counts, np.isin(lengths, found))
        for limit in found:
            n = counts[lengths == limit].sum()
            z = (math.log(limit) - mu) / sigma
            usual = counts.sum() * math.exp(-0.5 * z * z) / (limit * sigma * math.sqrt(2 * math.pi))
            rows.append({"writer": writer, "field_name": field, "length": limit, "posterior": float(min(0.999, max(0.0, 1 - usual / n)))})
    return pa.Table.from_pylist(rows, schema=_LIMITS)


def values(pairs: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(record_id, writer, field_name, text, other): one row a value of the fields, rows delivered again once."""
    raw, doc = FIELDS
    both = pairs.select("record_id", F.coalesce("writer", F.lit("")).alias("writer"), raw, doc).distinct()
    one = F.struct(F.lit(raw).alias("field_name"), F.col(raw).alias("text"), F.col(doc).alias("other"))
    two = F.struct(F.lit(doc).alias("field_name"), F.col(doc).alias("text"), F.col(raw).alias("other"))
    wanted = [v for f, v in ((raw, one), (doc, two)) if f in fields]
    return both.select("record_id", "writer", F.explode(F.array(*wanted)).alias("v")).select("record_id", "writer", "v.*").filter("length(trim(text)) > 0")


FACTS = "record_id long, writer string, field_name string, length int, what string, template string, word string, beginning boolean, n long"


def facts(pairs: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Of each value its end; and as what = 'whole' and 'inner' the templates and words that its batch holds, counted.

    Docstrings are drawn from replies, so only replies are counted.
    """

    def run(batches):
        for batch in batches:
            rows, whole, inner = [], {}, {}
            for key, writer, field, text, other in zip(*(batch.column(i).to_pylist() for i in range(5))):
                what, masked, word = ending(text)
                beginning = False
                if other:
                    a, b = content(text), content(other)
                    beginning = 0 < len(a) < len(b) and b.startswith(a)
                rows.append((key, writer, field, len(text), what, masked, word, beginning, 1))
                if field != FIELDS[0]:
                    continue
                segments, words = scanned(text)
                for s in segments:
                    whole[s] = whole.get(s, 0) + 1
                for w in words:
                    inner[w] = inner.get(w, 0) + 1
            rows += [(None, None, None, None, "whole", s, w, None, n) for (s, w), n in whole.items()]
            rows += [(None, None, None, None, "inner", None, w, None, n) for w, n in inner.items()]
            if rows:
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64()]
                names = [x.split()[0] for x in FACTS.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), type=k) for c, k in zip(zip(*rows), kinds)], names=names)

    return values(pairs, fields).mapInArrow(run, FACTS)


def _beginnings(masked: str) -> Iterator[int]:
    """A hash of each beginning of a template."""
    import xxhash

    h = 0
    for piece in masked.split(" "):
        h = xxhash.xxh3_64_intdigest(piece, seed=h)
        yield h - (1 << 63)


_TAGGED = re.compile(r"^[*#/ ]*[@:]")


def evidence(found: DataFrame) -> DataFrame:
    """(template, word, open_end): what the corpus says of each open end."""

    def begun(masked, n, words) -> Iterator[tuple]:
        every = list(_beginnings(masked))
        for h in every[:-1]:
            yield h, 0, n, None
        yield every[-1], n, n, words

    def ended(masked, word) -> Iterator[tuple]:
        every = list(_beginnings(masked))
        yield masked, word, every[-1], every[max(0, len(every) - 2)], len(every) >= SENTENCE and not _TAGGED.search(masked), masked[masked.rfind(" ") + 1 :][0:1] in ("@", ":") and len(masked[masked.rfind(" ") + 1 :]) > 1

    last = found.filter("what = 'whole'").groupBy("template", "word").agg(F.sum("n").alias("n"))
    whole = last.groupBy("template").agg(F.sum("n").alias("n"), F.count("*").alias("words"))
    # how often whole segments end with a template, and how often they go on after it
    known = map_columns(whole, ["template", "n", "words"], begun, "hash long, ends long, n long, words long").groupBy("hash").agg(F.sum("ends").alias("ends"), F.sum("n").alias("all"), F.max("words").alias("words"))
    inner = found.filter("what = 'inner'").groupBy("word").agg(F.sum("n").alias("uses"))
    open_ends = map_columns(found.filter("what = 'open'").select("template", "word").distinct(), ["template", "word"], ended, "template string, word string, hash long, shorter long, prose boolean, tag boolean")
    before = known.select(F.col("hash").alias("shorter"), F.col("ends").alias("before_ends"), F.col("all").alias("before_all"))
    seen = last.withColumnRenamed("n", "seen")
    joined = open_ends.join(known, "hash", "left").join(inner, "word", "left").join(seen, ["template", "word"], "left").join(before, "shorter", "left")
    verdict = (
        F.when(F.coalesce("uses", F.lit(0)) == 0, "unknown_word")
        .when(F.col("seen").isNull() & (F.col("ends") >= USES * F.col("words")), "unknown_word")
        .when(F.col("ends") / F.col("all") >= 0.5, "ends")
        .when(F.col("all") >= 3, "goes_on")
        .when((F.col("before_all") >= 3) & (F.col("before_ends") < 0.2 * F.col("before_all")), "goes_on")
        .when(F.col("tag"), "bare_tag")
        .when(F.col("prose"), "unknown_prose")
        .otherwise("unknown")
    )
    return joined.select("template", "word", verdict.alias("open_end"))


def judged(pairs: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(record_id, writer, field_name, length, what, at_limit, log_odds, without) of every value; truncated where the log odds are positive.

    without: the log odds that the value would have if lengths said nothing, of it and of the ends that they tell the worth of.
    """
    found = held(facts(pairs, fields))
    ends = found.filter("record_id IS NOT NULL").drop("n")
    hist = ends.groupBy("writer", "field_name", "length").agg(F.count("*").alias("n"))
    at = hist.groupBy("writer", "field_name").applyInArrow(_fit, "writer string, field_name string, length int, posterior double")
    opened = ends.filter("what = 'open'").join(evidence(found), ["template", "word"]).withColumn("what", F.col("open_end")).select(*ends.columns)
    joined = opened.unionByName(ends.filter("what <> 'open'")).drop("template", "word").join(at, ["writer", "field_name", "length"], "left")
    joined = checkpointed(joined)
    found.unpersist()
    rate = joined.groupBy("writer", "field_name").agg(((F.count_if(F.col("what").isin("cut", "goes_on", "unknown_word")) + 1) / (F.count("*") + 20)).alias("rate"))
    # one row: what open ends at limits are, and elsewhere
    is_open = ~F.col("what").isin("cut", "finished")
    limited, free = F.when(is_open, F.coalesce("posterior", F.lit(0.0))), F.when(is_open & F.col("posterior").isNull(), 1.0).otherwise(0.0)
    shares = [((F.sum(F.when(F.col("what") == k, x).otherwise(0.0)) + 0.5) / (F.sum(x) + 1)).alias(f"{k}_{n}") for k in COUNTED for n, x in (("limited", limited), ("free", free))]
    counted = joined.agg(*shares).select(*[(F.coalesce(F.col(f"{k}_limited") / F.col(f"{k}_free"), F.lit(1.0))).alias(k) for k in COUNTED])
    fixed = F.create_map(*[x for k, v in RATIOS.items() for x in (F.lit(k), F.lit(v))])[F.col("what")]
    ratio = F.coalesce(fixed, *[F.when(F.col("what") == k, F.col(k)) for k in COUNTED])
    odds = lambda prior, ratio: F.round(F.log(prior / (1 - prior) * ratio * F.when(F.col("beginning"), F.lit(BEGINNING)).otherwise(1.0)), 3)
    return joined.join(rate, ["writer", "field_name"], "left").crossJoin(F.broadcast(counted)).select(
        "record_id", "writer", "field_name", "length", "what", F.col("posterior").isNotNull().alias("at_limit"), odds(F.coalesce("posterior", "rate"), ratio).alias("log_odds"), odds(F.col("rate"), F.coalesce(fixed, F.lit(1.0))).alias("without")
    )


def truncated(pairs: DataFrame) -> DataFrame:
    return judged(pairs).filter("log_odds > 0").select("record_id", "field_name").distinct()


def rates(pairs: DataFrame) -> DataFrame:
    """How often each source truncates, and how much of it at a limit."""
    bad = F.col("log_odds") > 0
    return judged(pairs).groupBy("writer", "field_name").agg(
        F.count("*").alias("values"), F.count_if(bad).alias("truncated"), F.count_if(bad & F.col("at_limit")).alias("at_limit"), F.round(F.count_if(bad) / F.count("*"), 4).alias("rate")
    )
