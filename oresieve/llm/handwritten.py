"""Problem 2: generated, minified, vendored files and data blobs saved as code.

A Re-Pair grammar is inferred over the token sequence of every file, with names, numbers and strings reduced to their kind. A rule that
is used again and again and makes up most of the file shows a template that a program filled in. Literals that take most of a file and
hardly compress show a blob; text without blanks in very long lines shows a minifier.

Rules that repositories share come from a grammar of the true tokens that is consistent between files: in each round a phrase ends
where the hash of a symbol is least among its neighbours, and phrases get the hash of what they stand for as their name, so equal text
gets equal rules in whatever file it stands. The rules of the last round go into one corpus-wide count of repositories; a file most of
whose tokens stand in rules of other repositories is a copy. Counts are combined before the shuffle, and what is sent is a hash and a
size, never text, so a library that a third of all repositories hold is one hot key of small rows.

Of a file that none of these judges (one function from a generator, a library that nobody else holds), what it says of itself at its
top or foot and the folders and names that tools use decide; the evidence column tells by what a file was found.

Defined results: null and empty text is hand-written; damaged files are judged by what is there; rows delivered again count once; a
file that only one repository holds is no copy, unless it says so, and fewer than COPY tokens show no copy.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oresieve.llm.common import LANGUAGES, held, spread

#: Share of a file's tokens in one template, its least size and number of uses.
TEMPLATE, TEMPLATE_SIZE, TEMPLATE_USES = 0.6, 8, 4
#: Share of a file's signs in literals, bits a sign from which on they count as incompressible, and signs from which on that shows.
LITERALS, BITS, BLOB = 0.72, 2.6, 400
#: Share of a file in long lines, length of a long line, and share of blanks that a person would exceed.
LONG_LINES, LONG, BLANKS = 0.6, 200, 0.09
#: Share of tokens in rules of other repositories, and tokens of a file from which on it can be a copy.
SHARED, COPY = 0.5, 40
ROUNDS = 4
#: A rule with more than this share of all rows is hot: there are no more than 1 / HOT of them.
HOT = 1e-4

_TOKEN = re.compile(
    r"//[^\n]*|/\*[\s\S]*?\*/|(?<![\w)\]'\"])#[^\n]*|\"{3}[\s\S]*?\"{3}|'{3}[\s\S]*?'{3}|(\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`)|([^\W\d][\w$]*|\$[\w$]*)|(\d[\w.]*)|(\S)"
)
# The words of the four languages that keep their own symbol.
KEYWORDS = frozenset(
    "def return if else for while class const let var function new this import from try except catch public private protected static final void self "
    "not in is None null true false True False async await export default extends throw raise switch case break continue with as assert and or elif "
    "yield lambda int long double boolean interface enum package finally do typeof instanceof super implements abstract".split()
)

# What generators and libraries say of a file, and where tools put theirs.
GENERATED_SAYS = re.compile(
    r"@generated\b|<auto-?generated|\bauto-?generated\b|\b(?:automatically|auto|machine)[- ]generated\b|\bgenerated (?:by|from|with|using|code|file)\b|\bcode generated\b|"
    r"\bdo not (?:edit|modify|change)\b|\bdon't edit\b|\bchanges will be (?:lost|overwritten)\b|\b(?:produced|written|created|emitted|built|made|output) by [\w.-]+ v?\d[\w.]* (?:from|on|at)\b|\bedit the \w+, not this file\b|"
    r"\bautomatisch (?:erzeugt|generiert|erstellt)\b|\bnicht (?:bearbeiten|ändern|editieren)\b|\bgenerado (?:por|automáticamente|a partir)\b|\bno (?:editar|modificar)\b|\bgerado (?:por|automaticamente|a partir)\b|"
    r"\bnão (?:editar?|edite|modificar)\b|\bgénéré (?:par|automatiquement|à partir)\b|\bne pas (?:modifier|éditer)\b|自動生成|自动生成|编辑不要|请勿",
    re.I,
)
GENERATED_MARK = re.compile(r"^[^\n'\"`#*]*?(?:__generated(?:_by)?__\s*=|\b__generatedBy\s*=|@(?:javax?\.annotation\.(?:processing\.)?)?Generated\s*\()", re.I | re.M)
SPEAKS_ABOUT = re.compile(r"['\"‘“`][^'\"\n]*(?:generated|edit|modify)[^'\"\n]*['\"’”`]|\b(?:below|writer|emits?|puts?|adds?|prints?|when|if|whether|how)\b[^\n]*\b(?:generated|do not edit)", re.I)
LIBRARY_SAYS = re.compile(
    r"\bcopied from \S+|\bthis file is part of [\w.-]+\b[^\n]*\b(?:upstream|see)\b|^[\W]*[\w.@/-]+ v?\d+\.\d+(?:\.\d+)?\S* (?:\||-|–|—|\*|\()[^\n]*(?:licen[cs]e|released|copyright|\(c\)|https?:)|\bvendored (?:from|copy)\b|\bupstream version\b",
    re.I | re.M,
)
TOOL_PATH = re.compile(
    r"(?:^|/)(?:__generated__|generated-(?:stubs|sources|src)|gen)/|(?:^|/)(?:build|target|out)/generated|_pb2(?:_grpc)?\.pyi?$|\.pb\.\w+$|\.g\.\w+$|\.generated\.\w+$|_generated\.\w+$|\.designer\.\w+$", re.I
)
LIBRARY_PATH = re.compile(r"(?:^|/)(?:node_modules|bower_components|third_party|third-party|site-packages|vendor|extern|externals?|deps)/", re.I)
MINIFIED_PATH = re.compile(r"[.-]min\.(?:js|jsx|mjs|cjs|ts|tsx)$", re.I)


class _Symbols(dict):
    """Name, keyword or sign → its symbol; filled as they come, emptied at a size."""

    def __missing__(self, word: str) -> str:
        if len(self) > 500_000:
            self.clear()
        self[word] = out = word if word in KEYWORDS or not (word[0] == "_" or word[0] == "$" or word[0].isalpha()) else "I"
        return out


_SYMBOLS = _Symbols()


def tokens(text: str) -> tuple[list[str], list[str], int]:
    """(tokens, their symbols with names, numbers and strings reduced, characters in literals)."""
    true, kinds, literal = [], [], 0
    for string, word, number, sign in _TOKEN.findall(text):
        if word or sign:
            t = word or sign
            true.append(t)
            kinds.append(_SYMBOLS[t])
        elif string or number:
            t = string or number
            true.append(t)
            kinds.append("S" if string else "N")
            literal += len(t)
    return true, kinds, literal


class Grammar:
    """Re-Pair: the most frequent pair becomes a rule until no pair occurs least times.

    A pair only becomes rarer once it is there, so pairs below least are never kept, and rules of at least that many uses are the same
    as those of the whole grammar.
    """

    def __init__(self, symbols: list[str], least: int = 2):
        names: dict[str, int] = {}
        seq = [names.setdefault(s, len(names)) for s in symbols]
        self.terminals = list(names)
        self.rules: dict[int, tuple[int, int]] = {}
        n = len(seq)
        often = {pair for pair, count in Counter(zip(seq, seq[1:])).items() if count >= least}
        places: dict[tuple[int, int], set[int]] = {pair: set() for pair in often}
        for i, pair in enumerate(zip(seq, seq[1:])):
            if pair in often and not (pair[0] == pair[1] and i - 1 in places[pair]):
                places[pair].add(i)
        heap = [(-len(where), pair) for pair, where in places.items() if len(where) >= least]
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        new = len(names)
        none: set[int] = set()
        while heap:
            count, pair = heapq.heappop(heap)
            where = places.get(pair, none)
            if len(where) != -count:
                if len(where) >= least:
                    heapq.heappush(heap, (-len(where), pair))
                continue
            del places[pair]
            self.rules[new] = pair
            fresh: dict[tuple[int, int], set[int]] = {}
            for i in sorted(where):
                j = after[i]
                if j >= n or seq[i] != pair[0] or seq[j] != pair[1]:
                    continue
                left, right = before[i], after[j]
                if left >= 0:
                    p = (seq[left], pair[0])
                    places.get(p, none).discard(left)
                    fresh.get(p, none).discard(left)
                if right < n:
                    places.get((pair[1], seq[right]), none).discard(j)
                seq[i], seq[j] = new, -1
                after[i] = right
                if right < n:
                    before[right] = i
                    fresh.setdefault((new, seq[right]), set()).add(i)
                if left >= 0:
                    p = (seq[left], new)
                    if not (p[0] == p[1] and before[left] in fresh.get(p, none)):
                        fresh.setdefault(p, set()).add(left)
            for p, found in fresh.items():
                if len(found) >= least:
                    places[p] = found
                    heapq.heappush(heap, (-len(found), p))
            new += 1
        self.start = [s for s in seq if s >= 0]

    def template(self, n: int) -> float:
        """The greatest share of n symbols that one rule's uses stand for, among rules that look like code."""
        size = dict.fromkeys(range(len(self.terminals)), 1)
        named = {i: int(t == "I") for i, t in enumerate(self.terminals)}
        other = {i: int(t not in ("N", "S", ",", "-", "[", "]", "{", "}", "+", "\0")) for i, t in enumerate(self.terminals)}
        for r, (a, b) in self.rules.items():
            size[r], named[r], other[r] = size[a] + size[b], named[a] + named[b], other[a] + other[b]
        uses = Counter(self.start)
        for r in sorted(self.rules, reverse=True):
            for part in self.rules[r]:
                uses[part] += uses[r]
        return max((uses[r] * size[r] / n for r in self.rules if size[r] >= TEMPLATE_SIZE and uses[r] >= TEMPLATE_USES and named[r] >= 1 and other[r] >= 0.5 * size[r]), default=0.0)


def template_share(kinds: list[str]) -> float:
    """Grammar.template of the symbols, 0 where it can't exceed TEMPLATE.

    Every run of TEMPLATE_SIZE symbols inside a template occurs as often as the template, so where runs of TEMPLATE_USES places cover no
    more than TEMPLATE of the file, no grammar has to be built.
    """
    n = len(kinds)
    if n < TEMPLATE_SIZE * TEMPLATE_USES:
        return 0.0
    codes = np.array([_CODES[k] for k in kinds], dtype=np.uint64)
    runs = np.zeros(n - TEMPLATE_SIZE + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(TEMPLATE_SIZE):
            runs = runs * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + len(runs)]
    _, which, count = np.unique(runs, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(count[which] >= TEMPLATE_USES)
    marks = np.zeros(n + 1, dtype=np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + TEMPLATE_SIZE, -1)
    if np.count_nonzero(np.cumsum(marks)) <= TEMPLATE * n:
        return 0.0
    return Grammar(kinds, TEMPLATE_USES).template(n)


class _Codes(dict):
    """Symbol → a number of 64 bits."""

    def __missing__(self, symbol: str) -> int:
        import xxhash

        self[symbol] = out = xxhash.xxh3_64_intdigest(symbol)
        return out


_CODES = _Codes()


def incompressible(text: str) -> float:
    """Bits a character that the literals of text take when compressed, commas and blanks aside."""
    literals = "".join("".join(x) for x in re.findall(r"\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)'|`([^`]*)`|(\d[\w.]*)", text))
    return 8 * len(zlib.compress(literals.encode("utf-8", "replace"), 9)) / max(1, len(literals))


def minified(text: str) -> bool:
    """Most of the text in long lines of hardly any blanks."""
    long = [x for x in text.split("\n") if len(x) >= LONG]
    long = [x for x in long if len(re.findall(r"[;{}]", x)) >= len(x) / 120 and x.count(" ") < BLANKS * len(x)]
    return sum(map(len, long)) > LONG_LINES * len(text.strip())


_COMMENTS = re.compile(r"(?:\s+|//[^\n]*|#[^\n]*|/\*(?:[^*]|\*(?!/))*+(?:\*/|\Z)|\"{3}(?:[^\"]|\"(?!\"\"))*+\"{3}|'{3}(?:[^']|'(?!''))*+'{3}|['\"]use strict['\"];?)*+")


def head(text: str) -> str:
    """The comments and blank lines before the first code."""
    return _COMMENTS.match(text).group(0)


def foot(text: str) -> str:
    """The comments after the last code."""
    lines = []
    for line in reversed(text.rstrip().split("\n")):
        if line.strip() and not re.match(r"\s*(?://|#|/?\*)", line):
            break
        lines.append(line)
    return "\n".join(reversed(lines))


def says_generated(top: str, text: str) -> bool:
    return any(not SPEAKS_ABOUT.search(line) for line in top.split("\n") if GENERATED_SAYS.search(line)) or ("enerated" in text and GENERATED_MARK.search(text) is not None)


def own_reason(path: str, text: str, found: tuple[list[str], list[str], int] | None = None) -> tuple[str, str] | None:
    """(reason, evidence) why the file itself is not hand-written: by its lines, its grammar, its literals, and else by what it says."""
    true, kinds, literal = found or tokens(text)
    if minified(text):
        return "minified", "lines"
    if template_share(kinds) > TEMPLATE:
        return "generated", "grammar"
    dense = sum(map(len, true)) or 1
    signs = sum(1 for k in kinds if k in ",[]{}-")
    if literal >= BLOB and literal + signs > LITERALS * dense and sum(k in ("S", "N") for k in kinds) > 0.25 * len(kinds) and incompressible(text) > BITS:
        return "blob", "literals"
    top = head(text)
    if says_generated(top + "\n" + foot(text), text):
        return "generated", "comment"
    if TOOL_PATH.search(path):
        return "generated", "path"
    if MINIFIED_PATH.search(path):
        return "minified", "path"
    if LIBRARY_SAYS.search(top):
        return "vendored", "comment"
    return ("vendored", "path") if LIBRARY_PATH.search(path) else None


class _Hashes(dict):
    """Token → 64 bits; filled as they come, emptied at a size."""

    def __missing__(self, token: str) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        self[token] = out = xxhash.xxh3_64_intdigest(token)
        return out


_HASHES = _Hashes()


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A permutation of 64 bits that depends on a seed."""
    x = x ^ np.uint64(0x9E3779B97F4A7C15 * (seed + 1) & 0xFFFFFFFFFFFFFFFF)
    for _ in range(2):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def consistent_rules(files: list[list[str]], rounds: int = ROUNDS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each file's tokens (names, tokens) of the rules of the last round; a phrase ends at each symbol whose mixed hash is a local minimum.

    All files of a batch lie in one line, and no phrase crosses the end of a file.
    """
    counts = np.array([len(f) for f in files], dtype=np.int64)
    names = np.array([_HASHES[t] for f in files for t in f], dtype=np.uint64)
    sizes = np.ones(len(names), dtype=np.int64)
    which = np.repeat(np.arange(len(files)), counts)
    with np.errstate(over="ignore"):
        for level in range(rounds if len(names) else 0):
            keys = _mixed(names, 2 * level)
            last = np.append(which[1:] != which[:-1], True)
            first = np.insert(last[:-1], 0, True)
            lowest = np.append(keys[:-1] <= keys[1:], False) & np.insert(keys[1:] < keys[:-1], 0, False)
            starts = np.concatenate(([0], np.flatnonzero(last | (lowest & ~first)) + 1))[:-1]
            place = np.arange(len(names)) - np.repeat(starts, np.diff(np.append(starts, len(names))))
            parts = _mixed(names + place.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03), 2 * level + 1)
            names, sizes, which = _mixed(np.add.reduceat(parts, starts), 100 + level), np.add.reduceat(sizes, starts), which[starts]
    ends = np.searchsorted(which, np.arange(len(files) + 1))
    return [(names[i:j], sizes[i:j]) for i, j in zip(ends[:-1], ends[1:])]


SCHEMA = "file_id long, owner string, path string, reason string, evidence string, rule long, weight long"


def analysed(files: DataFrame, file_id: str = "file_id", repo: str = "repo", path: str = "path", text: str = "value") -> DataFrame:
    """Of each code file a row with the reason it gives itself (rule 0), and a row for each rule of the consistent grammar."""

    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]

    def run(batches):
        for batch in batches:
            keys, owners, paths, texts = (batch.column(i).to_pylist() for i in range(4))
            found = [tokens(text or "") for text in texts]
            reasons = [(own_reason(where, text, own) if (text or "").strip() else None) or (None, None) for where, text, own in zip(paths, texts, found)]
            empty, zero = [None] * len(keys), [0] * len(keys)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip((keys, owners, paths, *zip(*reasons), zero, zero), kinds)] if keys else [pa.array(empty, type=k) for k in kinds], names=names)
            at, rules, weights = [], [], []
            for i, (rule, size) in enumerate(consistent_rules([own[0] for own in found])):
                each, where = np.unique(rule, return_inverse=True)
                at.append(np.full(len(each), i)), rules.append(each), weights.append(np.bincount(where, size, len(each)).astype(np.int64))
            if at and sum(map(len, at)):
                at = pa.array(np.concatenate(at))
                nothing = pa.nulls(len(at), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at).cast(pa.int64()), batch.column(1).take(at).cast(pa.string()), nothing, nothing, nothing, pa.array(np.concatenate(rules).astype(np.int64)), pa.array(np.concatenate(weights))], names=names
                )

    code = files.filter(F.lower(F.regexp_extract(path, r"\.(\w+)$", 1)).isin(*LANGUAGES))
    return spread(code).select(F.col(file_id).cast("long"), repo, path, text).mapInArrow(run, SCHEMA)


def _marked(rules: DataFrame) -> DataFrame:
    """rules with elsewhere: whether another repository holds the rule.

    Rules with more than a share HOT of all rows are broadcast, of which there are 1 / HOT at most; no other key is large.
    """
    held_by = rules.groupBy("rule").agg(F.min("owner").alias("a"), F.max("owner").alias("b"), F.count("*").alias("n"))
    total = F.broadcast(rules.agg(F.count("*").alias("total")))  # one row
    copied = held_by.filter("a <> b").crossJoin(total).select("rule", (F.col("n") > HOT * F.col("total")).alias("hot"))
    one = rules.join(F.broadcast(copied.filter("hot")), "rule", "left")
    rest = one.filter("hot IS NULL").drop("hot").join(copied.filter("NOT hot").select("rule", F.lit(True).alias("elsewhere")), "rule", "left")
    return rest.unionByName(one.filter("hot").withColumnRenamed("hot", "elsewhere"))


def classified(files: DataFrame, shared: float = SHARED, **names: str) -> DataFrame:
    """(file_id, owner, path, reason, evidence, share): reason is generated, minified, vendored, blob or null for hand-written files."""
    found = held(analysed(files, **names))
    rules = found.filter("rule <> 0").select("file_id", "owner", "rule", "weight")
    sums = _marked(rules).groupBy("file_id").agg(F.sum(F.when(F.col("elsewhere"), F.col("weight")).otherwise(0)).alias("copied"), F.sum("weight").alias("tokens"))
    own = found.filter("rule = 0").groupBy("file_id").agg(F.first("owner", True).alias("owner"), F.first("path", True).alias("path"), F.max("reason").alias("reason"), F.max("evidence").alias("evidence"), F.count("*").alias("times"))
    share = F.coalesce(F.col("copied") / F.col("tokens"), F.lit(0.0))
    copy = (share > shared) & (F.col("tokens") >= COPY * F.col("times"))
    return own.join(sums, "file_id", "left").select(
        "file_id", "owner", "path", F.when(copy, "vendored").otherwise(F.col("reason")).alias("reason"), F.when(copy, "shared rules").otherwise(F.col("evidence")).alias("evidence"), F.round(share, 4).alias("share")
    )


def not_handwritten(files: DataFrame, **names: str) -> DataFrame:
    return classified(files, **names).filter("reason IS NOT NULL").select("file_id")
