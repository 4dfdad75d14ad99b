"""Problem 5: prompt and response pairs that are no usable question and answer.

Openings of responses (their first words, names masked, in three lengths) are clustered by MinHash: bands of signatures give candidates, a
Jaccard similarity of at least SIMILAR over shingles of five words verifies them, and labels spread over verified links until none
changes. Only responses count that speak of themselves or to the reader and document nothing: a cluster of them that recurs over
unrelated prompts and keeps off the prompts' code is a refusal template, whose members are refusals; no word of declining is asked for.
Phrases of declining find those that no other response repeats. Copies are found by the runs of words that a response shares with its
prompt, other languages by function words and script against the language that the prompt asks for, truncated responses by problem 3.

In a bucket only openings meet that also share one of their rarest shingles, as any two of that similarity do, so no link is lost and a
full bucket does not yield all its pairs.

Of several defects the first of empty, refusal, copy, wrong_language, truncated counts. Defined results: null, blank and wordless
responses are empty; a null prompt asks for English and can't be copied; a pair delivered again counts once; extra columns don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oresieve.llm import truncation
from oresieve.llm.common import checkpointed, map_columns
from oresieve.llm.docpairs import words as telling_words
from oresieve.llm.spam import _KNOWN, FUNCTION

#: Words of openings, of a shingle, hashes, bands, similarity, functions over which a template recurs.
OPENINGS, SHINGLE, HASHES, BANDS, SIMILAR, PROMPTS = (5, 12, 60), 5, 64, 16, 0.8, 3
#: Words beside the refusal that still document nothing, and words of the code from which on a response is about it.
TOLD, ABOUT = 24, 2
#: Share of a copied response's words that stand in its prompt, and words that may be added to it.
COPIED, ADDED = 0.7, 4

_WORD = re.compile(r"\w+(?:['’]\w+)?")
_SENTENCE = re.compile(r"(?<=[.!?。！？;])\s+|\n+")
_FENCE = re.compile(r"```[\w-]*")
_TAG_LINE = re.compile(r"^\s*\*?\s*(?:@\w+|:\w+[^:]*:|(?:Args|Returns?|Raises|Parameters|Example)\s*:).*$", re.M)
_COMMENTS = re.compile(r"/\*[\s\S]*?\*/|//[^\n]*|(?<![\w'\"])#[^\n]*|\"{3}[\s\S]*?\"{3}|'{3}[\s\S]*?'{3}")

# Words that stand for nothing said, names of languages, and phrases of declining.
NOTHING = frozenset("null none nil n a na tbd todo fixme undefined empty docstring documentation doc docs description no string text placeholder".split())
LANGUAGE_NAMES = {
    "en": "english englisch anglais inglés ingles inglês",
    "de": "german deutsch allemand alemán aleman alemão",
    "fr": "french französisch français francais francés frances francês",
    "es": "spanish spanisch espagnol español espanol espanhol castellano",
    "pt": "portuguese portugiesisch portugais portugués portugues português",
}
_ASKED = re.compile(r"\b(?:in|into|auf|ins|en|em|au|para|al)\s+(?:the\s+)?(" + "|".join(sorted((n for v in LANGUAGE_NAMES.values() for n in v.split()), key=len, reverse=True)) + r")\b", re.I)
DECLINES = re.compile(
    r"\b(?:can(?:no|')?t|cannot|can not|unable|not able|won['’]t|will not|would(?:n['’]t| not)|may not|must not|decline[ds]?|refuse[ds]?|rather not|not (?:be )?(?:possible|appropriate|comfortable|allowed|permitted|willing)|"
    r"isn['’]t (?:something|possible|appropriate)|could not be|can be (?:given|provided|written|produced) (?:here|by)|have to (?:pass|decline|refuse)|pass on the request|against (?:the|my|our)|goes against|nothing will be|no docstring can|"
    r"need a human|not going to|sorry|apolog(?:y|ies|i[sz]e)|regret(?:tably)?|unfortunately)\b"
    r"|\b(?:leider|tut mir leid|lehne|ablehnen|verweiger\w+|nicht (?:möglich|helfen|beantworten|erfüllen|dokumentieren|bearbeiten)|kann (?:ich|diese\w*|das) \w*\s?nicht|kann ich)\b"
    r"|\b(?:désolée?|ne (?:peux|puis|peut) pas|impossible|refuse|refuser|décline|regrette)\b"
    r"|\b(?:lo siento|no (?:puedo|me es posible|es posible|podré)|rechaz\w+|lamento|negarme)\b"
    r"|\b(?:não (?:posso|consigo|me é possível|é possível)|recus\w+|desculp\w+|lamento)\b",
    re.I,
)
SPEAKER = re.compile(
    r"\b(?:I|I['’]m|I['’]d|I['’]ve|(?i:me|my|we|this (?:assistant|model|request|component|service)|the (?:assistant|model|request|usage rules|content filter)|(?:as )?an AI|AI model|human reviewer|documentation could|no docstring|help with|you asked|"
    r"ich|mir|mich|diese[rs]? (?:anfrage|bitte)|je|j['’]|cette demande|demande|yo|puedo|siento|debo|esta solicitud|(?:la|esta) petición|solicitud|posso|consigo|eu|este pedido|pedido))\b"
)


# Words by which a writer speaks of itself or to the reader.
ADDRESS = re.compile(
    r"\b(?:i|i['’](?:m|d|ve|ll)|me|my|we|us|our|you|your|(?:this|the) (?:assistant|model|request)|ich|mir|mich|meine?|wir|je|j['’]\w+|moi|mon|vous|nous|yo|mí|puedo|siento|nosotros|usted|eu|mim|posso|consigo|nós|você|"
    r"diese anfrage|cette demande|esta solicitud|este pedido)\b",
    re.I,
)


def plain(text: str) -> str:
    """The response without its frame: tags, fences and comment marks."""
    return _FENCE.sub(" ", truncation.content(text))


_UNSEEN = re.compile(r"</?[A-Za-z_][\w-]*>|[\u200b-\u200f\u2060\ufeff]")


def says_nothing(text: str | None) -> bool:
    bare = _FENCE.sub(" ", _UNSEEN.sub(" ", text or ""))
    n, told = 0, False
    for m in re.finditer(r"[^\W_]+", bare):
        n, told = n + 1, told or m.group(0).lower() not in NOTHING
        if n >= 3 and told:
            return False
    return not told or (n < 3 and not telling_words(bare))


def instruction(prompt: str | None) -> str:
    """What the prompt asks, without the code that follows."""
    return re.split(r"\n\s*\n", (prompt or "").strip(), maxsplit=1)[0]


_CODES: dict[str, tuple[str, ...]] = {}
for _code, _listed in FUNCTION.items():
    for _w in _listed.split():
        _CODES[_w] = (*_CODES.get(_w, ()), _code)


def language(text: str, least: int = 3) -> str | None:
    """The language that most function words speak for; None where too few do or two are near each other."""
    if not text.isascii():
        letters = re.findall(r"[^\W\d_]", text)
        if letters and sum(c > "\u02af" for c in letters) > 0.3 * len(letters):
            return "other"
    found = re.findall(r"[^\W\d_]+", text.lower())
    counts = dict.fromkeys(FUNCTION, 0)
    for w in found:
        for c in _CODES.get(w, ()):
            counts[c] += 1
    best = sorted(counts, key=lambda c: -counts[c])
    if counts[best[0]] < least or counts[best[0]] < 0.12 * len(found) or counts[best[0]] < 1.15 * counts[best[1]]:
        return None
    return best[0]


_NAMED = {n: code for code, names in LANGUAGE_NAMES.items() for n in names.split()}


def wanted_language(prompt: str | None) -> str:
    asked = _ASKED.findall(instruction(prompt))
    return _NAMED[asked[-1].lower()] if asked else language(re.sub(r"`[^`]*`", " ", instruction(prompt)), 2) or "en"


def other_language(prompt: str | None, response: str) -> bool:
    text = plain(response)
    prose = _TAG_LINE.sub(" ", re.sub(r"`[^`]*`", " ", text))
    found = language(prose) or language(text)
    return found is not None and found != wanted_language(prompt)


def _covered(response: list[str], prompt: list[str], run: int = 3) -> int:
    known = {tuple(prompt[i : i + run]) for i in range(len(prompt) - run + 1)}
    mark = [False] * len(response)
    for i in range(len(response) - run + 1):
        if tuple(response[i : i + run]) in known:
            mark[i : i + run] = [True] * run
    return sum(mark)


def copies(prompt: str | None, response: str) -> bool:
    """Whether the response gives back the instruction or the code and adds next to nothing; comments of the code are no code."""
    said = [w.lower() for w in _WORD.findall(plain(response))]
    if not prompt or len(said) < 3:
        return False
    told = [w.lower() for w in _WORD.findall(prompt)]
    known = set(told)
    if sum(w in known for w in said) < 0.6 * len(said):
        return False
    code = [w.lower() for w in _WORD.findall(_COMMENTS.sub(" ", prompt))]
    run = 3 if len(said) > 3 else 2
    some = _covered(said, code, run)
    if some >= COPIED * len(said) and len(said) - some <= ADDED:
        return True
    every = _covered(said, told, run)
    return (every >= 0.95 * len(said) and len(said) > 8) or (every >= 0.88 * len(said) and some >= 0.3 * len(said) and len(said) - every <= ADDED)


def declines(response: str) -> tuple[bool, bool]:
    """(whether the opening declines, whether nothing else is documented)."""
    parts = [s for s in _SENTENCE.split(plain(response)) if s.strip()]
    if not parts:
        return False, True
    says = lambda s: bool(DECLINES.search(s) and SPEAKER.search(s))
    start = says(parts[0])
    first = start or (len(parts) > 1 and len(_WORD.findall(parts[0])) <= 4 and says(parts[1]))
    if _TAG_LINE.search(response):
        return first, False
    told = 0
    for s in parts[(0 if start else 1) :]:
        if not (first and says(s)):
            told += len(_WORD.findall(s))
            if told > TOLD:
                return first, False
    return first, True


def addresses(prompt: str | None, response: str) -> bool:
    """Whether the first sentence speaks of the writer or to the reader and is none of the prompt's own."""
    start = next((s for s in _SENTENCE.split(plain(response)) if s.strip()), "")
    if not ADDRESS.search(start):
        return False
    return " ".join(_WORD.findall(start.lower())) not in " ".join(_WORD.findall((prompt or "").lower()))


def about(prompt: str | None, response: str, name: str | None) -> bool:
    """Whether the response has words of the prompt's code in it, parts of names counted, besides the function's own name."""
    code = (prompt or "")[len(instruction((prompt or "").lstrip())) :]
    parts = {w.lower() for w in re.findall(r"[A-Z]?[a-z]{3,}|[A-Z]{3,}", code)}
    own = {w.lower() for w in re.findall(r"[A-Z]?[a-z]{3,}|[A-Z]{3,}", name or "")}
    said = {w.lower() for w in re.findall(r"[^\W\d_]{3,}", re.sub(r"`[^`]*`", " ", plain(response)))}
    return len((said & parts) - own - _KNOWN) >= ABOUT


def openings(response: str, name: str | None) -> list[str]:
    """The first words of each length, the function's name and other quoted names masked."""
    text = re.sub(r"`[^`]*`", " X ", plain(response))
    if name:
        text = text.replace(name, " X ")
    found: list[str] = []
    for m in _WORD.finditer(text):
        found.append(m.group(0).lower())
        if len(found) == OPENINGS[-1]:
            break
    return [" ".join(found[:n]) for i, n in enumerate(OPENINGS) if not i or len(found) > OPENINGS[i - 1]]


def shingles(text: str) -> list[str]:
    found = text.split()
    return sorted({" ".join(found[i : i + SHINGLE]) for i in range(max(1, len(found) - SHINGLE + 1))})


_RANDOM = np.random.RandomState(7)
_A, _B = _RANDOM.randint(1, 1 << 31, HASHES, dtype=np.int64).astype(np.uint64) | np.uint64(1), _RANDOM.randint(0, 1 << 31, HASHES, dtype=np.int64).astype(np.uint64)


def bands(parts: list[int]) -> list[int]:
    """A key for each band of the MinHash signature of hashed shingles."""
    import xxhash

    base = np.array([p & 0xFFFFFFFF for p in parts], dtype=np.uint64)
    signature = ((base[:, None] * _A + _B) & np.uint64(0xFFFFFFFFFF)).min(axis=0)
    rows = HASHES // BANDS
    return [xxhash.xxh3_64_intdigest(signature[i * rows : (i + 1) * rows].tobytes(), seed=i) - (1 << 63) for i in range(BANDS)]


def links(nodes: DataFrame) -> DataFrame:
    """(id, to) of all pairs that share a bucket and are similar, both ways; nodes: id, parts (hashes of shingles), bands.

    parts of two sets of similarity SIMILAR, ordered from the rarest on, meet within the first n - ceil(SIMILAR n) + 1, so the key of a
    bucket is widened by one of those.
    """
    uses = nodes.select(F.explode("parts").alias("part")).groupBy("part").agg(F.count("*").alias("uses"))
    ordered = nodes.select("id", F.explode("parts").alias("part")).join(uses, "part").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("uses", "part"))).alias("o"))
    first = F.expr(f"slice(o.part, 1, size(o) - cast(ceil({SIMILAR} * size(o)) AS int) + 1)")
    keys = nodes.join(ordered.select("id", first.alias("first")), "id").select("id", F.explode("first").alias("part"), "bands").select("id", "part", F.posexplode("bands").alias("band", "key"))
    # a part of these that nobody else has meets nothing
    met = keys.groupBy("part", "band", "key").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    keys = keys.join(met, ["part", "band", "key"])
    near = keys.join(keys.withColumnRenamed("id", "to"), ["part", "band", "key"]).filter("id < to").select("id", "to").distinct()
    parts = nodes.select("id", "parts")
    both = near.join(parts, "id").join(parts.select(F.col("id").alias("to"), F.col("parts").alias("others")), "to")
    same = F.size(F.array_intersect("parts", "others"))
    similar = both.filter(same >= SIMILAR * (F.size("parts") + F.size("others") - same)).select("id", "to")
    return similar.unionByName(similar.select(F.col("to").alias("id"), F.col("id").alias("to")))


def clusters(openings: DataFrame) -> DataFrame:
    """(opening, cluster): openings joined by verified links, through chains of any length; cluster is the least id of its members."""

    def rule(text) -> Iterator[tuple]:
        import xxhash

        parts = [xxhash.xxh3_64_intdigest(p) - (1 << 63) for p in shingles(text)]
        yield text, xxhash.xxh3_64_intdigest(text) - (1 << 63), parts, bands(parts) if len(parts) > 1 else []

    nodes = checkpointed(map_columns(openings, ["opening"], rule, "opening string, id long, parts array<long>, bands array<long>"))
    # an opening of one shingle is like no other
    both = checkpointed(links(nodes.filter("size(parts) > 1")))
    if both.isEmpty():
        return nodes.select("opening", F.col("id").alias("cluster"))
    labels = both.select("id").distinct().withColumn("cluster", F.col("id"))
    while True:
        spread_ = both.join(labels.withColumnRenamed("id", "to"), "to").groupBy("id").agg(F.min("cluster").alias("near"))
        near = labels.join(spread_, "id").select("id", F.least("cluster", "near").alias("near"), "cluster")
        # the label's own label: chains halve with each round
        of = near.select(F.col("id").alias("near"), F.col("near").alias("further"))
        new = checkpointed(near.join(of, "near").select("id", F.least("near", "further").alias("cluster"), (F.col("further") < F.col("cluster")).alias("moved")))
        labels = new.select("id", "cluster")
        if new.filter("moved").isEmpty():
            break
    return nodes.join(labels, "id", "left").select("opening", F.coalesce("cluster", "id").alias("cluster"))


def templates(spoken: DataFrame) -> DataFrame:
    """record_id of the responses that follow a refusal template; spoken: record_id, name, about, openings of responses that speak of their writer."""
    each = spoken.select("record_id", "name", "about", F.explode("openings").alias("opening")).filter("opening <> ''")
    texts = each.groupBy("opening").agg(F.count("*").alias("n"), F.count_if("about").alias("about"))
    named = checkpointed(clusters(texts.select("opening")))
    votes = texts.join(named, "opening").groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("about").alias("about"))
    functions = each.select("opening", "name").distinct().join(named, "opening").select("cluster", "name").distinct().groupBy("cluster").agg(F.count("name").alias("functions"))
    recurring = functions.filter(F.col("functions") >= PROMPTS).join(votes, "cluster").filter("2 * about < n").select("cluster")
    return each.join(named.join(recurring, "cluster"), "opening").select("record_id").distinct()


def signs(pairs: DataFrame) -> DataFrame:
    """Of each pair what it shows by itself; openings only where the response speaks of its writer and documents nothing."""

    def rule(key, prompt, response, name) -> Iterator[tuple]:
        if says_nothing(response):
            yield key, "empty", False, True, False, [], name
            return
        first, silent = declines(response)
        found = "copy" if copies(prompt, response) else "wrong_language" if other_language(prompt, response) else None
        speaks = silent and found != "copy" and addresses(prompt, response)
        yield key, found, first and found != "copy", silent, speaks and about(prompt, response, name), openings(response, name) if speaks else [], name

    one = pairs.select("record_id", "prompt", "raw_llm_response", "function_name").distinct()
    return map_columns(one, ["record_id", "prompt", "raw_llm_response", "function_name"], rule, "record_id long, found string, declines boolean, silent boolean, about boolean, openings array<string>, name string")


def judged(pairs: DataFrame) -> DataFrame:
    """(record_id, defect_type, by_template) of every pair; null for usable ones."""
    found = checkpointed(signs(pairs))
    refusals = templates(found.filter("size(openings) > 0")).withColumn("by_template", F.lit(True))
    cut = truncation.judged(pairs, ("raw_llm_response",)).filter("log_odds > 0").select("record_id", F.lit(True).alias("cut")).distinct()
    whole = found.join(refusals, "record_id", "left").join(cut, "record_id", "left").withColumn("by_template", F.coalesce("by_template", F.lit(False)))
    defect = (
        F.when(F.col("found") == "empty", "empty")
        .when(F.col("silent") & (F.col("by_template") | F.col("declines")), "refusal")
        .when(F.col("found").isNotNull(), F.col("found"))
        .when(F.col("cut"), "truncated")
    )
    return whole.select("record_id", defect.alias("defect_type"), "by_template")


def defective(pairs: DataFrame) -> DataFrame:
    return judged(pairs).filter("defect_type IS NOT NULL").groupBy("record_id").agg(F.min("defect_type").alias("defect_type"))
