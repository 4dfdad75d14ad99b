"""Text measures and parsers as column expressions: token overlap, unigram precision, comment cleaning, tags, replies of models."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_tokens(text) -> Column:
    """Lower-case tokens between blanks, without empty ones; [] for null."""
    return F.filter(F.split(F.lower(F.coalesce(col(text), F.lit(""))), r"\s+"), lambda t: t != "")


def word_tokens(text) -> Column:
    """Lower-case identifiers of a text, in order."""
    return F.transform(F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(r"([A-Za-z_]\w*)"), F.lit(1)), F.lower)


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two token arrays as sets: 1 if both are empty, 0 if one is."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def bound(value: Column, rule) -> Column:
    """rule(value) with value computed once a row; an expression inside a lambda is computed again for each element."""
    return F.element_at(F.transform(F.array(value), rule), 1)


def unigram_precision(reference: Column, hypothesis: Column) -> Column:
    """Share of the hypothesis' tokens that the reference holds, each counted as often as it stands there."""
    hits = bound(hypothesis, lambda h: bound(F.array_intersect(reference, h), lambda common: F.size(F.filter(h, lambda t: F.array_contains(common, t))) / F.size(h)))
    return F.when(F.size(hypothesis) == 0, 0.0).otherwise(hits)


def _numbered(tokens: Column) -> Column:
    """Tokens with the number of their occurrence, in order of the token, so that equal tokens differ."""
    return bound(F.array_sort(tokens), lambda ordered: F.transform(ordered, lambda t, i: F.concat_ws(" ", t, (i - F.array_position(ordered, t)).cast("string"))))


def clipped_bleu1(reference: Column, hypothesis: Column) -> Column:
    """Unigram precision with each token counted at most as often as in the reference, times the brevity penalty.

    Tokens hold no blanks.
    """
    n, m = F.size(hypothesis), F.size(reference)
    hits = F.size(F.array_intersect(_numbered(reference), _numbered(hypothesis)))
    return F.when((n == 0) | (m == 0), 0.0).otherwise(hits / n * F.least(F.lit(1.0), F.exp(1 - m / n)))


def clean_comment(text) -> Column:
    """The text of a block comment on one line, without its decoration."""
    lines = F.transform(F.split(F.coalesce(col(text), F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^\*+", "")))
    return F.array_join(F.filter(lines, lambda x: ~x.isin("/**", "*/", "/", "")), " ")


def tags(text) -> Column:
    """Distinct @tag names in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(r"@(\w+)"), F.lit(1)))


def summary_line(text) -> Column:
    """The first line that is neither empty nor a tag nor a comment mark; empty if there is none."""
    lines = F.transform(F.split(F.coalesce(col(text), F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^[* ]+", "")))
    good = F.filter(lines, lambda x: (x != "") & ~x.startswith("@") & ~x.isin("/**", "*/", "/"))
    return F.coalesce(F.try_element_at(good, F.lit(1)), F.lit(""))


# Openings that say little of a function.
LOW_VALUE = (
    r"(?i)^(?:(?:This\s+)?(?:function|method|class|constructor)\b|(?:A|An)\s+(?:function|method|class)\b|(?:Used\s+to|Helper\s+function\b)"
    r"|(?:Calculates|Computes|Determines\s+if|Checks\s+whether|Returns\s+whether)\b|(?:Initializes\s+a\s+new|Creates\s+a\s+new|Represents\s+a)\b)"
)


def low_value_summary(text) -> Column:
    """Whether a summary line is boilerplate or has at most four words."""
    s = F.trim(F.coalesce(col(text), F.lit("")))
    return (s == "") | s.rlike(LOW_VALUE) | (F.size(F.split(s, r"\s+")) <= 4)


def tag_text(reply, tag: str) -> Column:
    """The trimmed text between <TAG> and </TAG>; null if absent."""
    found = F.regexp_extract(F.coalesce(col(reply), F.lit("")), rf"(?is)<{tag}>(.*?)</{tag}>", 1)
    return F.nullif(F.trim(found), F.lit(""))


def tag_true(reply, tag: str) -> Column:
    return F.coalesce(F.lower(tag_text(reply, tag)) == "true", F.lit(False))


# The ways a reply states its score, in order.
SCORES = (r"(?i)<score>(\d)</score>", r"(?i)score:\s*(\d)", r"(?i)score\s*=\s*(\d)", r"(?i)(\d)\s*/\s*5", r"(?i)level\s*(\d)")


def reply_score(reply) -> Column:
    """The first score from 1 to 5 by the first way of stating it that matches; 3 otherwise."""
    text = F.coalesce(col(reply), F.lit(""))
    each = [F.nullif(F.regexp_extract(text, p, 1), F.lit("")).try_cast("int") for p in SCORES]
    valid = [F.when(e.between(1, 5), e) for e in each]
    return F.coalesce(*valid, F.lit(3))


def strip_thinking(text) -> Column:
    """A reply without its <think> blocks and stray marks of them."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"(?is)<think>.*?</think>", ""), r"(?i)</?think>", ""))


def extracted_docstring(reply) -> Column:
    """The documentation inside a reply: of the tags docstring, summary, describe, description the first with at least two words, else of any tag."""
    text = strip_thinking(reply)
    known = [tag_text(text, t) for t in ("docstring", "summary", "describe", "description")]
    anything = F.nullif(F.trim(F.regexp_extract(text, r"(?s)<(\w+)>(.*?)</\1>", 2)), F.lit(""))
    return F.coalesce(*[F.when(F.size(F.split(k, r"\s+")) >= 2, k) for k in (*known, anything)])


def clean_artifacts(doc) -> Column:
    """A docstring without triple quotes and blank edges."""
    return F.trim(F.regexp_replace(F.coalesce(col(doc), F.lit("")), r"^\s*(?:\"\"\"|''')|(?:\"\"\"|''')\s*$", ""))


def repo_name(url) -> Column:
    """The repository's name in an https or ssh address."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(col(url), F.lit("")), r"/+$", ""), r"\.git$", "")
    return F.regexp_replace(F.regexp_extract(bare, r"([^/:]+)$", 1), r"[^\w-]", "_")


def stable_id(prefix: str, *parts) -> Column:
    """prefix_ and eight hexadecimal digits of the parts' digest."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.md5(F.concat_ws(":", *[col(p) for p in parts])), 1, 8))


def cache_key(*columns: str) -> Column:
    """A digest of a request's fields, their order fixed."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])), 256)


def sse_event(event: str, payload: Column) -> Column:
    return F.concat(F.lit(f"event: {event}\ndata: "), payload, F.lit("\n\n"))


# Words that name no component.
COMMON_WORDS = (
    "error string number boolean array object true false null undefined void return value result data input output type adds sum throws the and for with "
    "this that from into operation function method class module list dict set tuple str int float print len range enumerate zip map filter console log warn "
    "push pop shift slice splice join split trim tolowercase system out println tostring equals hashcode determines represents initialize returns checks "
    "creates calculates extracts uses computes gets sets loads saves validates processes converts args arguments parameters raises yields examples example "
    "attributes notes seealso todo warnings refs reference references methods properties"
).split()
# Headings of sections, and verbs that open a sentence.
HEADINGS = (
    "args arguments parameters returns raises yields examples example attributes notes seealso todo warnings refs reference references methods properties".split() + ["see also", "constructor parameters"]
)
VERBS = r"^(?:Determines|Represents|Initialize|Returns|Checks|Creates|Calculates|Extracts|Uses|Computes|Gets|Sets|Loads|Saves|Validates|Processes|Converts)\b"


def mentions_kept(names: Column) -> Column:
    """Ordered distinct names without common words, numbers and names of up to two letters."""
    return F.filter(F.array_distinct(names), lambda x: ~F.lower(x).isin(*COMMON_WORDS) & (F.length(x) > 2) & ~x.rlike(r"^\d+$"))


def backtick_mentions(doc) -> Column:
    return mentions_kept(F.regexp_extract_all(F.coalesce(col(doc), F.lit("")), F.lit(r"`([a-zA-Z_][a-zA-Z0-9_]*)`"), F.lit(1)))


def explicit_mentions(doc, language) -> Column:
    """Names in backticks, capitalised names outside headings and leading verbs, calls, and members after a dot."""
    text = F.coalesce(col(doc), F.lit(""))
    lines = F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x))
    prose = F.filter(lines, lambda x: (x != "") & ~F.regexp_replace(F.lower(x), ":+$", "").isin(*HEADINGS))
    capital = F.flatten(F.transform(prose, lambda x: F.regexp_extract_all(F.trim(F.regexp_replace(x, VERBS, "")), F.lit(r"\b([A-Z][A-Za-z0-9]*)\b"), F.lit(1))))
    member = F.when(col(language) == "python", F.regexp_extract_all(text, F.lit(r"\.([a-z_][a-z0-9_]*)\b"), F.lit(1))).when(
        col(language).isin("javascript", "typescript", "java"), F.regexp_extract_all(text, F.lit(r"\.([a-zA-Z_][a-zA-Z0-9_]*)\b"), F.lit(1))
    )
    return mentions_kept(
        F.concat(
            F.regexp_extract_all(text, F.lit(r"`([a-zA-Z_][a-zA-Z0-9_]*)`"), F.lit(1)),
            capital,
            F.regexp_extract_all(text, F.lit(r"\b([a-zA-Z_][a-zA-Z0-9_]*)\s*\(\)"), F.lit(1)),
            F.coalesce(member, F.array().cast("array<string>")),
        )
    )


def merged_mentions(first: Column, second: Column) -> Column:
    return mentions_kept(F.concat(first, second))


def attribute_descriptions(doc) -> Column:
    """Name → description of the lines of an Attributes section."""
    text = F.regexp_extract(F.coalesce(col(doc), F.lit("")), r"(?is)Attributes:\s*\n(.*?)(?:\n\s*\n|\z)", 1)
    names = F.regexp_extract_all(text, F.lit(r"(?m)^\s*(\w+)[^:\n]*:"), F.lit(1))
    values = F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^\s*\w+[^:\n]*:\s*(.*)$"), F.lit(1)), lambda x: F.trim(x))
    return F.map_from_entries(F.array_distinct(F.arrays_zip(names.alias("k"), values.alias("v"))))


def example_text(doc) -> Column:
    """The text of an example section of either style; null if there is none."""
    text = F.coalesce(col(doc), F.lit(""))
    return F.nullif(F.trim(F.coalesce(F.nullif(F.regexp_extract(text, r"(?is)(?:^|\n)\s*Examples?:\s*\n?(.*)", 1), F.lit("")), F.regexp_extract(text, r"(?is)@example\s*(.*?)(?:\n\s*@|\z)", 1))), F.lit(""))


def expected_call(example: Column) -> Column:
    """The first line that holds a call."""
    lines = F.filter(F.transform(F.split(example, "\n"), lambda x: F.trim(x)), lambda x: F.contains(x, F.lit("(")) & F.contains(x, F.lit(")")))
    return F.try_element_at(lines, F.lit(1))


def described(doc) -> Column:
    """The text between a docstring's first line and its first section heading."""
    lines = F.transform(F.split(F.coalesce(col(doc), F.lit("")), "\n"), lambda x: F.trim(x))
    rest = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    heading = F.transform(rest, lambda x: F.regexp_replace(F.lower(x), ":$", "").isin(*HEADINGS) | x.startswith("@") | x.startswith(":"))
    at = F.array_position(heading, F.lit(True))
    return F.trim(F.array_join(F.when(at > 0, F.slice(rest, 1, (at - 1).cast("int"))).otherwise(rest), "\n"))
