"""Problem 9: pages of keywords, links, tags or product lines instead of sentences.

A text falls into blocks of about BLOCK characters that end where a line or sentence ends; code and logs stand apart. Links, host names,
tags and prices are masked to one sign each, and a block's compression ratio is the compressed size of the masked block over its length.
The corpus gives the usual ratio of blocks of each length and language. A block far below it (EXTREME) is stuffing, however its phrases
are framed: keywords inside sentences as well. A block less far below it (REDUNDANT) is stuffing as far as its parts without sentences
go: lines of links, tags, products or words with few ends of sentences and few function words, measured by themselves. A page is found
when more than half of its characters are stuffing.

Defined results: null, empty and blank text is not found; whole texts count; language spellings are reduced to their first two letters,
unknown ones share a baseline.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oresieve.llm.common import held, map_columns, spread

#: Characters after which a block ends with its line or sentence; from EVIDENCE on it is long enough to be judged by its ratio alone.
BLOCK, EVIDENCE = 1000, 500
#: Kinds of units that stand apart.
APART = ("code", "log")
#: Shares of the usual ratio under which a block is stuffing by itself, and under which its bare parts may be: under SHORT signs, and longer.
EXTREME, REDUNDANT, SHORT = 0.46, (0.72, 0.85), 200
#: What still passes for sentences: function words, ends of sentences for each hundred words.
FUNCTION_WORDS, ENDS = 0.12, 2.5

# Frequent function words of the languages that are told apart.
FUNCTION = {
    "en": "the a an of to in is it and or for with that as by on at be this are was not from its has have which when than then but if so no only they their where who what how into over",
    "de": "der die das den dem des ein eine einer einen und oder ist im in zu von mit auf für nicht wird werden dass als auch bei nach aus wenn er sie es sich noch man wie",
    "fr": "le la les un une de des du et ou est dans pour par sur avec que qui ne pas se sa son au aux l d n qu en il elle ce cette sont a encore",
    "es": "el la los las un una de del y o es en por para con que no se su al lo como más si sus esta este cuando hasta",
    "pt": "o a os as um uma de e ou do da dos das no na nos nas em por para com que não se seu sua ao é como ainda mais esta este quando",
}
_KNOWN = frozenset(w for words in FUNCTION.values() for w in words.split())
_LINK = re.compile(
    r"<a\s[^>]*>.*?</a>|\[[^\]\n]*\]\([^)\n]*\)|\[\d+\]:\s*\S+|(?:https?|ftp)://\S+|www\.\S+"
    r"|(?<![\w.@-])[\w-]{1,63}(?:\.[\w-]{1,63}){0,8}\.(?:com|net|org|edu|gov|example|test|invalid|io|info|biz|dev|app|shop|store|site|online|xyz|club|top|co|us|uk|eu|de|fr|es|pt|br|it|nl|ru|cn|jp|in)\b(?:/\S*)?",
    re.I,
)
#: Without one of these a unit holds no link.
_MAYBE = re.compile(r"\w\.\w|\]\(|<a\s|//|\]:", re.I)
_HASH = re.compile(r"(?<!\w)#\w+")
_PRICE = re.compile(r"(?:[$€£¥]\s?\d[\d.,]*|\d[\d.,]*\s?(?:[$€£¥]|EUR|USD|GBP|BRL|CHF)\b)")
_DIGITS = re.compile(r"\d+")
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCES = re.compile(r"(?<=[.!?…。！？])[\"')\]]*\s+")
_END = re.compile(r"[.!?…。！？][\"')\]]*(?:\s|$)")
_LOG = re.compile(r"^\W{0,2}(?:\d{4}-\d\d-\d\d|\d\d:\d\d:\d\d|\d\d/\w{3}/\d{4}|(?:INFO|WARN(?:ING)?|ERROR|DEBUG|TRACE|FATAL)\b|\w{3} +\d+ \d\d:\d\d)")
_CODE = re.compile(r"[;{}]\s*$|^\s*(?:def|class|return|import|from|if|for|while|const|let|var|public|private|@|//|/\*|\*|#!|>>>|\$ |pip |npm |print).*[(){}=:;]|\w\([^)]*\)|\w\s*[-+]?=\s*\S|[{}\[\]]\s*,?\s*$")
_ENTRY = re.compile(r"^\s*(?:[-*•]|\d+[.)])\s+\S+(?:\s+\S+){4,}")


def _kind(unit: str) -> str:
    if _LOG.match(unit):
        return "log"
    links = sum(len(m.group(0)) for m in _LINK.finditer(unit)) if _MAYBE.search(unit) else 0
    rest = _WORD.findall((_LINK.sub(" ", unit) if links else unit).lower())
    if links >= 0.5 * len(unit) or (links and len(rest) < 4):
        return "bare"
    known = len([w for w in rest if w in _KNOWN])
    if len(rest) >= 4 and known >= FUNCTION_WORDS * len(rest) and not (_DIGITS.search(unit) and _PRICE.search(unit)):
        return "entry" if links else "text"
    if _CODE.search(unit) and not links:
        return "code"
    return "bare"


def units(text: str) -> Iterator[tuple[str, str]]:
    """(kind, unit): lines, cut at ends of sentences and where they exceed BLOCK; kind is bare, text, entry (a link that a sentence describes), code or log."""
    fence = False
    for line in text.split("\n"):
        if line.lstrip().startswith(("```", "~~~")):
            fence = not fence
            continue
        for unit in _SENTENCES.split(line):
            if unit.strip():
                kind = "code" if fence else _kind(unit.strip())
                for start in range(0, len(unit), BLOCK):
                    yield kind, unit[start : start + BLOCK]


def blocks(text: str) -> Iterator[list[tuple[str, str]]]:
    """Runs of neighbouring units: of sentences and bare ones together, of code or logs by themselves."""
    run: list[tuple[str, str]] = []
    size = 0
    for kind, unit in units(text):
        if run and (size >= BLOCK or (run[0][0] in APART) != (kind in APART)):
            yield run
            run, size = [], 0
        run.append((kind, unit))
        size += len(unit) + 1
    if run:
        yield run


def unlinked(block: str, sign: str) -> str:
    return _LINK.sub(sign, block) if _MAYBE.search(block) else block


def masked(block: str) -> str:
    block = unlinked(block, "~")
    block = _HASH.sub("#", block) if "#" in block else block
    return _DIGITS.sub("0", _PRICE.sub("$", block)) if _DIGITS.search(block) else block


def ratio(block: str) -> float:
    """Bytes of the compressed masked block for each character; the ten bytes of frame do not count."""
    return max(0, len(zlib.compress(masked(block).encode("utf-8", "replace"), 6)) - 10) / len(block)


def octave(chars: int) -> int:
    """Half octaves of a length."""
    return int(2 * math.log2(chars + 1))


def measures(text: str) -> Iterator[tuple[int, int, float, int, int, float, float, float]]:
    """Of each block (characters, size, ratio) and of its bare parts (characters, size, ratio, ends a hundred words, function words).

    Code, logs and lists whose entries are described have the ratio 9, which is never redundant.
    """
    for run in blocks(text):
        whole = "\n".join(unit for _, unit in run)
        bare = [unit for kind, unit in run if kind == "bare"]
        if run[0][0] in APART or 2 * sum(len(unit) for kind, unit in run if kind == "entry") > len(whole):
            yield len(whole), octave(len(whole)), 9.0, 0, 0, 9.0, 100.0, 1.0
            continue
        share = ratio(whole)
        if not bare:
            yield len(whole), octave(len(whole)), share, 0, 0, 9.0, 100.0, 1.0
            continue
        part = "\n".join(bare)
        words = _WORD.findall(unlinked(part, " ").lower())
        n = max(1, len(words))
        ends = 100.0 * len(_END.findall(unlinked(part, "~ "))) / n
        yield len(whole), octave(len(whole)), share, len(part), octave(len(part)), share if len(bare) == len(run) else ratio(part), ends, sum(w in _KNOWN for w in words) / n


def language(column):
    short = F.lower(F.substring(F.coalesce(column, F.lit("")), 1, 2))
    return F.when(short.isin(*FUNCTION), short).otherwise("un")


FOUND = "doc_id long, lang string, chars int, size int, ratio double, bare int, bare_size int, bare_ratio double, ends double, known double"


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """A row a block (FOUND)."""

    def rule(k, code, value) -> Iterator[tuple]:
        for row in measures(value):
            yield k, code, *row

    some = docs.filter(F.length(F.trim(text)) > 0).select(F.col(key).alias("doc_id"), language(F.col(lang)).alias("lang"), F.col(text).alias("text"))
    return map_columns(spread(some), ["doc_id", "lang", "text"], rule, FOUND)


def baselines(found: DataFrame) -> DataFrame:
    """(size, lang, usual): the median ratio of blocks that are sentences for the most part; at most some 24 lengths by 6 languages."""
    text = found.filter("ratio < 9 AND 2 * bare < chars")
    return text.groupBy("size", "lang").agg(F.percentile_approx("ratio", 0.5, 1000).alias("usual"), F.count("*").alias("blocks")).filter("blocks >= 5").drop("blocks")


def stuffed_share(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, chars, stuffed, share) of every document that has text."""
    found = held(measured(docs, key, text, lang))
    # all sides are broadcast: their bound is a row a length and language
    base = baselines(found)
    usual = {x: F.coalesce(f"{x}_usual", f"{x}_any", F.lit(0.6)) for x in ("whole", "part")}
    for name, size in (("whole", "size"), ("part", "bare_size")):
        one = base.select(F.col("size").alias(size), "lang", F.col("usual").alias(f"{name}_usual"))
        every = base.groupBy(F.col("size").alias(size)).agg(F.avg("usual").alias(f"{name}_any"))
        found = found.join(F.broadcast(one), [size, "lang"], "left").join(F.broadcast(every), size, "left")
    extreme = (F.col("ratio") < EXTREME * usual["whole"]) & (F.col("chars") >= EVIDENCE)
    bare = (F.col("ends") < ENDS) & (F.col("known") < FUNCTION_WORDS + 0.08) & (F.col("bare_ratio") < F.when(F.col("bare") < SHORT, REDUNDANT[0]).otherwise(REDUNDANT[1]) * usual["part"])
    stuffing = F.when(extreme, F.col("chars")).when(bare, F.col("bare")).otherwise(0)
    return found.groupBy("doc_id").agg(F.sum("chars").alias("chars"), F.sum(stuffing).alias("stuffed")).withColumn("share", F.col("stuffed") / F.col("chars"))


def stuffed(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    return stuffed_share(docs, key, text, lang).filter("share > 0.5").select("doc_id")
