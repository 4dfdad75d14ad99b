"""Problem 4: credentials embedded in source code.

1. Every text gives its literals: values under names that speak of secrets, values of a credential's own format, logins in URLs and
   commands.
2. Owners (repositories) of each named value are counted over the corpus: a value that many share and that has neither a format
   nor the look of random characters is a placeholder.
3. What remains is confirmed. All texts are searched for all confirmed secrets: a Bloom filter of a piece of each secret finds the
   files that may hold one, and these are scanned again by an automaton of the secrets that concern them.

What is collected and broadcast is the filter, eight bytes a secret and 256 MB at most (a fuller filter lets more files through and
loses none); a secret that a third of all files hold only adds rows to its own group of counts, which are combined before the shuffle.

Defined results: null and empty text gives nothing; a secret cut into pieces that are joined in code, or put on the line after its
name, counts at the line where its text starts; rows delivered again count once; a component (id) with other text in another row
gives the lines of both.
"""

from __future__ import annotations

import base64
import binascii
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oresieve.llm.common import held, map_columns, spread

#: Repositories from which on a value without format or randomness is a placeholder.
SHARED_BY = 6

# Words of names that hold secrets, words that end names of something else, and texts that stand for a secret.
SECRET_WORDS = frozenset(
    "password passwd passphrase passwort kennwort pass pwd pw secret secrets cred creds credential credentials contrasena clave senha mdp "
    "motdepasse apikey authtoken accesstoken".split()
)
SECRET_PAIRS = frozenset(
    (a, b) for b in ("key", "token") for a in "api secret signing private access auth bot client encryption master service session refresh deploy tls ssl ssh id bearer webhook app account admin user".split()
) - {("user", "key"), ("id", "key")}
OTHER_ENDS = frozenset(
    "field fields name label hash digest url uri path file id ids length len min max count policy header type regex pattern env prefix "
    "suffix param column expiry ttl limit hint error message prompt reset status size index plan rows state batch once".split()
)
STAND_INS = re.compile(
    r"^(?:x+|\*+|\.+|-+|_+|0+|n/?a|none|null|nil|true|false|todo|tbd|redacted|removed|hidden|masked|secret|password|passwd|token|key|test|dummy|"
    r"example|empty|default|undefined|foo|bar|baz|abc|123456?7?8?9?0?)$"
    r"|change[-_ ]?me|replace[-_ ]?me|place[-_ ]?holder|your[-_ ]|[-_ ]here$|insert[-_ ]|dummy|example|sample|redacted|fixme|todo|set in |from vault|in vault|xxxx|\*\*\*|<[^>]*>",
    re.I,
)
REFERENCE = re.compile(r"^(?:\$\{.*\}?|\$\(.*|\$[A-Za-z_]\w*|%[A-Za-z_]\w*%|\{\{.*|@\w+@|(?:env|vault|ssm|secret|arn|ref|file|kms|op|aws|gcp|config)[:.].*|process\.env.*|os\.environ.*|os\.getenv.*|System\.getenv.*|!\w.*)$", re.I)

FORMATS = re.compile(
    r"(?P<aws>(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9]))"
    r"|(?P<forge>(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{30,}|glpat-[\w-]{18,}|npm_[A-Za-z0-9]{30,}|pypi-[\w-]{40,}))"
    r"|(?P<pay>(?<![A-Za-z0-9])(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{16,})"
    r"|(?P<chat>(?<![A-Za-z0-9])xox[abeoprs]-[\w-]{16,})"
    r"|(?P<web>(?<![A-Za-z0-9])(?:AIza[\w-]{30,}|SG\.[\w-]{16,}\.[\w-]{16,}|ya29\.[\w-]{20,}|sk-[A-Za-z0-9-]{20,}))"
    r"|(?P<jwt>(?<![A-Za-z0-9+/])eyJ[\w-]{8,}\.eyJ[\w-]{4,}\.[\w-]{8,})"
    r"|(?P<pem>-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----)"
)
LOGIN = re.compile(r"[a-zA-Z][\w+.-]*://[^\s/:@\"'`<>]*:([^\s/@\"'`<>]+)@[\w.\[$-]")
QUERY = re.compile(r"[?&;](?:access_token|api_?key|apikey|auth|auth_token|token|key|secret|client_secret|password|passwd|pwd|sig|signature|code)=([^&\s\"'`<>#]+)", re.I)
BEARER = re.compile(r"\b(?:Bearer|Basic|Token)\s+([\w+/=.~-]{8,})")
COMMAND = re.compile(r"(?:--?(?:password|passwd|pass|pwd|token|secret|api-?key|access-key|auth-token)[ =]+|(?<!\S)-p(?=\S{6,})|(?<!\S)-u\s+[\w.-]+:(?!//))[\"']?([^\s\"'`]+)")
#: What -p has before it in other commands: ports, paths and the rest of a longer option.
OTHER_P = re.compile(r"-p[\"']?(?:(?:[\d.]+:)?\d{1,5}(?:-\d{1,5})?(?::\d{1,5}(?:-\d{1,5})?)?(?:/(?:tcp|udp))?$|\.{0,2}/|[a-z][a-z-]*=(?!=|$))")
NAMED = re.compile(
    r"""(?P<name>[A-Za-z_$][\w$.-]*)["'`]?\s*\]?\s*(?::\s*[\w<>\[\] |]+?\s*=|=>|:=|[:=](?!=)|,)\s*(?P<value>)"""
    r"""|(?P<called>[A-Za-z_$][\w$.-]*)["'`]\s*,?\s*$"""
)
CALL_WORDS = re.compile(r"(?:getOrDefault|getenv|get|environ\.get|put|set|setProperty|put_string|env|option|config|header|setHeader)\s*\(", re.I)
LITERAL = re.compile(r""""((?:[^"\\]|\\.)*)"|'((?:[^'\\]|\\.)*)'|`((?:[^`\\]|\\.)*)`""")
#: Steps of an expression: a literal, a bracket or separator, other text.
STEP = re.compile(LITERAL.pattern + r"""|(?P<sign>[()\[\]{},;])|[^"'`()\[\]{},;]+|.""")
#: Text up to a literal that is open, and text that nothing divides.
CLOSED = re.compile(r"""[^"'`]*(?:(?:""" + LITERAL.pattern + r""")[^"'`]*)*""")
UNBROKEN = re.compile(r"""[^\s,;&"'`}]*""")
#: Signs of a value that are looked at in any case; longer ones are taken whole, once from left to right.
FAR = 400
JOINED = re.compile(r"""(["'`])\s*\+\s*(["'`])""")
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-zäöüßç]+|\d+")
# Signs (in lower case) of a line that may hold a credential.
HINTS = (
    "pass pwd pw secret cred kennwort contrase clave senha mdp key token bearer basic akia asia ghp_ gho_ ghu_ ghs_ ghr_ github_pat_ glpat- "
    "npm_ pypi- sk_live_ sk_test_ rk_live_ rk_test_ sk- xoxa- xoxb- xoxe- xoxo- xoxp- xoxr- xoxs- aiza sg. ya29 eyj -----begin :// --user --pa --pw -p -u "
    "auth= sig= signature= code="
).split()
#: Signs that begin many other words: they count inside a longer name, after a dash, as the key of a query or before the value of a header.
INNER = frozenset(["key", "token", "pw"])
#: Bytes of the pieces by which the corpus is searched for a secret: the longest piece that the secret holds.
PIECES = (12, 6)
#: Bits of the filter for each secret, hashes of a piece, most bits (as a power of 2), and bytes that are hashed at once.
BITS, PROBES, MOST_BITS, CHUNK = 64, 3, 31, 1 << 17


def entropy(text: str) -> float:
    """Bits per character."""
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def speaks_of_secret(name: str) -> bool:
    words = [w.lower() for w in WORDS.findall(name) if not w.isdigit()]
    if not words or words[-1] in OTHER_ENDS or "public" in words:
        return False
    tail = words[-2:]
    return words[-1] in SECRET_WORDS or any(w in SECRET_WORDS for w in tail) or tuple(tail) in SECRET_PAIRS or "".join(tail) in SECRET_WORDS


def random_looking(text: str) -> bool:
    """Letters and digits in no order of words: hexadecimal, base 64 and the like."""
    if len(text) < 10:
        return False
    kinds = bool(re.search(r"[a-z]", text)) + bool(re.search(r"[A-Z]", text)) + bool(re.search(r"\d", text))
    if kinds < 2:
        return False
    if re.fullmatch(r"[0-9a-fA-F]{16,}", text):
        return entropy(text) > 2.5
    if kinds == 3 and len(text) >= 16 and entropy(text) > 3.6 and not re.search(r"[\s._-]", text):
        return True
    runs = re.findall(r"[A-Za-z][a-z]{3,}", text)
    return entropy(text) > 2.8 and sum(map(len, runs)) < 0.5 * len(text)


def chosen_looking(text: str) -> bool:
    """A password that a person would choose: letters with digits or signs, no blanks, no path, call or sentence."""
    if not 6 <= len(text) <= 80 or re.search(r"\s", text) or re.search(r"[(){}\[\]<>;,\\]", text):
        return False
    if re.match(r"^(?:/|\./|\w+://|\d+(?:\.\d+)*$|\w+\.\w+\.\w+)", text):
        return False
    if re.fullmatch(r"[a-z]+(?:[-_.][a-z]+)*|[A-Z]+(?:_[A-Z]+)*|[a-z]+(?:[A-Z][a-z]+)+|[A-Za-z]+(?:[-.][a-z]+)*", text):
        return False
    return bool(re.search(r"[A-Za-z]", text)) and bool(re.search(r"[\d!@#$%^&*+=?~|:/_.-]", text))


def plausible(value: str) -> bool:
    return bool(value) and not STAND_INS.search(value) and not REFERENCE.match(value)


def _named_value(raw: str, config: bool) -> tuple[str, bool]:
    """The text that a value expression holds, and whether it is a literal."""
    literals = LITERAL.findall(raw)
    if literals and not config:
        if re.match(r"""^\s*[\w.$]*\(?\s*$""", raw[: raw.find(next(x for x in raw if x in "\"'`"))]) is None and not CALL_WORDS.search(raw) and "||" not in raw and "??" not in raw and " or " not in raw:
            return "", False
        # of a call such as getOrDefault(name, fallback), the last literal
        return next(("".join(x) for x in reversed(literals) if "".join(x)), ""), True
    if literals and re.match(r"""^\s*["']""", raw):
        return "".join(literals[0]), True
    if config:
        return re.sub(r"\s+#.*$", "", raw).strip().rstrip(","), True
    return "", False


def _basic(text: str) -> bool:
    """Whether a Basic credential holds user:password."""
    try:
        return b":" in base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return False


def _value_end(line: str, start: int, config: bool, known: list[int]) -> int:
    """Where the text ends that may belong to the value at start.

    In long lines a value of code ends with its expression, one of configuration with the line. Names inside such a value have theirs
    to the end of its literal or unbroken text. known: where values that were taken so end, so that none is taken again and again.
    """
    near = start + FAR
    if near >= len(line):
        return len(line)
    if start < known[0]:
        opened = CLOSED.match(line, start, near).end()
        literal = LITERAL.match(line, opened) if opened < near else None
        end = literal.end() if literal else UNBROKEN.match(line, near).end() if config and opened == near else near
        if end <= known[1]:
            return near
        known[1] = end
        return end
    end, depth = len(line), 0
    for m in STEP.finditer(line, start) if not config else ():
        sign = m.group("sign")
        if sign and sign in "([{":
            depth += 1
        elif sign and (depth == 0 or sign in ")]}"):
            depth -= 1
            if depth < 0:
                end = m.start()
                break
    known[0] = end
    return end


def _of_line(line: str, pending: bool, config: bool) -> tuple[list[tuple[str, str]], bool]:
    """[(kind, secret)] of a line, and whether its last name still waits for a value on the next one."""
    joined = JOINED.sub(lambda m: "" if m.group(1) == m.group(2) else m.group(0), line)
    out: list[tuple[str, str]] = []
    for m in FORMATS.finditer(joined):
        value = m.group(0)
        if m.lastgroup == "pem" or (not STAND_INS.search(value) and entropy(value[4:]) > 2.2):
            out.append((m.lastgroup, value))
    for m in LOGIN.finditer(joined):
        if plausible(m.group(1)) and len(m.group(1)) >= 4:
            out.append(("login", m.group(1)))
    for m in QUERY.finditer(joined):
        if plausible(m.group(1)) and random_looking(m.group(1)):
            out.append(("query", m.group(1)))
    for m in BEARER.finditer(joined):
        value = m.group(1)
        if plausible(value) and (random_looking(value) or (m.group(0).startswith("Basic") and _basic(value))):
            out.append(("header", value))
    if "-" in joined:
        for m in COMMAND.finditer(joined):
            value = m.group(1)
            if not OTHER_P.match(m.group(0)) and plausible(value) and len(value) >= 6 and (random_looking(value) or chosen_looking(value) or re.search(r"[a-z][A-Z]|[A-Z][A-Z][a-z]|\d", value)):
                out.append(("command", value))
    waits = False
    if pending:
        raw, literal = _named_value(joined, config and not re.match(r"""^\s*["']""", joined))
        out += _judge(raw, literal)
    known = [0, 0]
    for m in re.finditer(r"[A-Za-z_$][\w$.-]*", joined):
        if not speaks_of_secret(m.group(0)):
            continue
        n = NAMED.match(joined, m.start())
        if n is None:
            continue
        if n.group("called"):
            waits = True
            continue
        raw = joined[n.start("value") : _value_end(joined, n.start("value"), config, known)]
        if re.match(r"^\s*(?:\\|[|>][+-]?)?\s*$", raw):
            waits = not config or bool(raw.strip())
            continue
        value, literal = _named_value(raw, config)
        out += _judge(value, literal)
    return out, waits


def _judge(value: str, literal: bool) -> list[tuple[str, str]]:
    value = re.sub(r"^(?:Bearer|Basic|Token)\s+", "", value.strip())
    if literal and plausible(value) and not FORMATS.search(value) and "://" not in value and (random_looking(value) or chosen_looking(value)):
        return [("random" if random_looking(value) else "chosen", value)]
    return []


def secrets_of(text: str | None, language: str | None = None) -> list[tuple[int, str, str]]:
    """(1-based line, kind, secret) of all candidates in text."""
    if not text:
        return []
    config = (language or "").lower() in ("yaml", "properties", "dotenv", "ini", "toml")
    wanted: list[int] = []
    low = text.lower()
    if len(low) != len(text):  # a few letters have a longer lower case
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    line, at, until = 1, 0, -1
    for end, sign in _hints().iter(low):
        if end < until:
            continue
        start = end - len(sign) + 1
        if sign in INNER:
            before, after = low[start - 1] if start else " ", text[end + 1 : end + 2]
            if not (before.isalnum() or before in "_-.") and not (sign == "pw" and not after.islower()) and not (sign == "token" and after.isspace()) and not (before in "?&;" and after == "="):
                continue
        elif sign in ("-p", "-u"):
            after = low[end + 1 : end + 2]
            if (start and not low[start - 1].isspace()) or after.isspace() != (sign == "-u"):
                continue
        elif sign == "://":
            stop = low.find("\n", end)
            rest = low[end : stop if stop >= 0 else len(low)]
            if "@" not in rest and "=" not in rest:
                continue
        line += low.count("\n", at, start)
        at = start
        until = low.find("\n", end)
        if until < 0:
            until = len(low)
        if not wanted or wanted[-1] != line:
            wanted.append(line)
    if not wanted:
        return []
    lines = text.split("\n")
    out, i, pending = [], 0, 0
    while i < len(wanted) or pending:
        n = pending or wanted[i]
        if not pending or (i < len(wanted) and wanted[i] == n):
            i += 1
        if n > len(lines):
            break
        found, waits = _of_line(lines[n - 1], bool(pending), config)
        out += [(n, kind, value) for kind, value in dict.fromkeys(found)]
        pending = n + 1 if waits else 0
    return out


@lru_cache(maxsize=1)
def _hints():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for sign in HINTS:
        automaton.add_word(sign, sign)
    automaton.make_automaton()
    return automaton


def candidates(components: DataFrame, key: str = "id", owner: str = "repo", language: str = "language", text: str = "source_code") -> DataFrame:
    """(id, owner, line_no, kind, value, context): the candidates of every text with a hash of their line."""

    def rule(k, o, lang, source) -> Iterator[tuple]:
        import xxhash

        found = secrets_of(source, lang)
        lines = source.split("\n") if found else []
        for n, kind, value in found:
            yield k, o, n, kind, value, xxhash.xxh3_64_intdigest(lines[n - 1].strip()) - (1 << 63) if kind == "chosen" else None

    return map_columns(spread(components), [key, owner, language, text], rule, "id string, owner string, line_no int, kind string, value string, context long")


def _shared(places: DataFrame, shared_by: int) -> DataFrame:
    """(value) of those that many owners have, in as many different lines; places: value, owner, context."""
    lines = places.select("value", "context").distinct().groupBy("value").agg(F.count("*").alias("lines"))
    owners = places.select("value", "owner").distinct().groupBy("value").agg(F.count("*").alias("owners"))
    return owners.filter(F.col("owners") >= shared_by).join(lines.filter(F.col("lines") >= shared_by), "value").select("value")


def confirmed(found: DataFrame, shared_by: int = SHARED_BY) -> DataFrame:
    """found without values that many owners share in as many different lines and that have neither format nor randomness.

    A line that copies of one file repeat counts once, so a secret in a library that many owners hold is none of theirs.
    """
    chosen = found.filter("kind = 'chosen'")
    chosen = chosen.join(_shared(chosen, shared_by), "value", "left_anti").select(found.columns)
    return found.filter("kind <> 'chosen'").unionByName(chosen)


def _small(df: DataFrame, most: int = 20_000) -> DataFrame:
    """df to be broadcast where a count shows that it is small, so that texts need not be shuffled for it; else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def pieces(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of each size (6 or 12) following bytes of data."""
    wide = data.astype(np.uint64)
    two = (wide[:-1] << np.uint64(8)) | wide[1:]
    six = (two[:-4] << np.uint64(32)) | (two[2:-2] << np.uint64(16)) | two[4:]
    if size == 12:
        six = (six[:-6] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (six[6:] + np.uint64(0x165667B19E3779F9))
    six = six * np.uint64(0x9E3779B97F4A7C15)
    six ^= six >> np.uint64(29)
    return six * np.uint64(0xBF58476D1CE4E5B9)


def anchor(secret: str) -> tuple[int, int] | None:
    """(size, hash) of the piece of a secret that is least like a word; null where it is too short to tell it from other text."""
    data = np.frombuffer(secret.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    size = next((n for n in PIECES if n <= len(data)), None)
    if size is None:
        return None
    odd = np.concatenate([[0], np.cumsum((data < 97) | (data > 122))])
    at = int(np.argmax(odd[size:] - odd[:-size]))
    return size, int(pieces(data[at : at + size], size).astype(np.int64)[0])


def _probe(hashes: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The n-th bit of each hash in a filter."""
    return (hashes * np.uint64((0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)[n])) >> np.uint64(64 - bits)


def _filter(hashes: np.ndarray) -> tuple[int, np.ndarray]:
    """(power of 2 of its bits, bytes) of a Bloom filter."""
    bits = min(MOST_BITS, max(16, (BITS * max(1, len(hashes)) - 1).bit_length()))
    table = np.zeros(1 << (bits - 3), dtype=np.uint8)
    for n in range(PROBES):
        at = _probe(hashes, n, bits)
        np.bitwise_or.at(table, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
    return bits, table


def _hits(texts: list[str | None], sizes: list[int], bits: int, table: np.ndarray) -> dict[int, set[int]]:
    """Hashes of pieces that pass the filter, for the texts (by number) that hold any."""
    coded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(c) + 1 for c in coded])
    data = np.frombuffer(b"\n".join(coded) + b"\n", dtype=np.uint8)
    found: dict[int, set[int]] = {}
    for size in sizes:
        for start in range(0, len(data) - size + 1, CHUNK):
            hashes = pieces(data[start : start + CHUNK + size - 1], size)
            at = np.arange(len(hashes))
            for probe in range(PROBES):
                bit = _probe(hashes[at], probe, bits)
                at = at[(table[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1]
            for row, key in zip(np.searchsorted(ends, at + start, side="right").tolist(), hashes[at].astype(np.int64).tolist()):
                found.setdefault(row, set()).add(key)
    return found


def stands_alone(text: str, start: int, end: int) -> bool:
    """Whether text[start:end] is no part of a longer word; the letter of an escape such as \\n belongs to no word."""
    word = lambda c: c.isalnum() or c == "_"
    if start and word(text[start]) and word(text[start - 1]) and not (text[start - 1] in "ntr" and text[start - 2 : start - 1] == "\\"):
        return False
    return not (end < len(text) and word(text[end - 1]) and word(text[end]))


def rescan(components: DataFrame, sure: DataFrame, shared_by: int = SHARED_BY, key: str = "id", owner: str = "repo", text: str = "source_code") -> DataFrame:
    """(id, line_no, secret) of all places of confirmed secrets, in every text.

    A Bloom filter of one piece of each secret passes over all texts; the pieces that it lets through are joined with the secrets, and
    the texts that remain are searched by an automaton of the secrets that concern them. Secrets of a format or of random characters
    count anywhere; those that a person chose count where they are no part of a longer word, unless as many owners hold them as make a
    placeholder. Values that would not do for a password (a login such as root, fewer than six characters) say nothing elsewhere.
    """

    def known(value) -> Iterator[tuple]:
        loose = random_looking(value) or FORMATS.search(value) is not None
        found = anchor(value) if loose or chosen_looking(value) else None
        if found:
            yield value, not loose, *found

    session = components.sparkSession
    secrets = map_columns(sure.filter("kind <> 'pem'").select("value").distinct(), ["value"], known, "secret string, chosen boolean, size int, piece long").persist()
    told = secrets.select("size", "piece").distinct().toArrow()
    sizes = sorted(set(told.column("size").to_pylist()))
    shipped = session.sparkContext.broadcast(_filter(told.column("piece").to_numpy().astype(np.uint64)))
    schema = "id string, owner string, text string, pieces array<long>"
    arrow = session.createDataFrame([], schema).schema

    def pass_over(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        wanted = to_arrow_schema(arrow)
        bits, table = shipped.value
        for batch in batches:
            ids, owners, texts = (batch.column(i).to_pylist() for i in range(3))
            found = _hits(texts, sizes, bits, table)
            if found:
                columns = zip(*((ids[n], owners[n], texts[n], sorted(found[n])) for n in sorted(found)))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(columns, wanted)], names=wanted.names)

    def rule(k, o, source, values, chosen) -> Iterator[tuple]:
        import ahocorasick
        import xxhash

        automaton = ahocorasick.Automaton()
        for v, c in zip(values, chosen):
            automaton.add_word(v, (v, c))
        automaton.make_automaton()
        line, at, lines = 1, 0, source.split("\n")
        for start, v, c in sorted((end - len(v) + 1, v, c) for end, (v, c) in automaton.iter(source)):
            if not c or stands_alone(source, start, start + len(v)):
                line += source.count("\n", at, start)
                at = start
                yield k, o, line, v, xxhash.xxh3_64_intdigest(lines[line - 1].strip().encode("utf-8", "surrogatepass")) - (1 << 63) if c else None

    if not sizes:
        return session.createDataFrame([], "id string, line_no int, secret string")
    concerned = spread(components).select(F.col(key), F.col(owner), F.col(text)).mapInArrow(pass_over, schema).distinct().persist()
    met = concerned.select("id", F.explode("pieces").alias("piece")).distinct().join(_small(secrets), "piece").groupBy("id").agg(F.collect_set(F.struct("secret", "chosen")).alias("met"))
    places = map_columns(concerned.join(met, "id"), ["id", "owner", "text", "met.secret", "met.chosen"], rule, "id string, owner string, line_no int, value string, context long").persist()
    chosen = places.filter("context IS NOT NULL")
    kept = chosen.join(_shared(chosen, shared_by), "value", "left_anti").select(places.columns)
    return places.filter("context IS NULL").unionByName(kept).select("id", "line_no", F.col("value").alias("secret")).distinct()


def found_secrets(components: DataFrame, shared_by: int = SHARED_BY) -> DataFrame:
    """Distinct (id, line_no) of credentials."""
    found = held(candidates(components))
    sure = confirmed(found, shared_by)
    return sure.select("id", "line_no").unionByName(rescan(components, sure, shared_by).select("id", "line_no")).distinct()


def redact(text: str, secrets: list[str]) -> str:
    """text with each secret replaced by as many signs that are valid wherever the secret was, whole private keys included."""
    import ahocorasick

    text = re.sub(
        r"(-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----)([\s\S]*?)(-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----|\Z)",
        lambda m: m.group(1) + re.sub(r"(?<!\\)[A-Za-z0-9+/=]{16,}", lambda b: "x" * len(b.group(0)), m.group(2)) + m.group(3),
        text,
    )
    secrets = [s for s in secrets if not s.startswith("-----BEGIN")]
    if not secrets:
        return text
    automaton = ahocorasick.Automaton()
    for s in secrets:
        automaton.add_word(s, len(s))
    automaton.make_automaton()
    out = list(text)
    for end, size in automaton.iter(text):
        out[end - size + 1 : end + 1] = "x" * size
    text = "".join(out)
    for s in secrets:  # in pieces that code joins
        if s not in text:
            pieces = r"""(["'`]\s*\+\s*["'`])?""".join(map(re.escape, s))
            text = re.sub(pieces, lambda m: re.sub(r"""(["'`]\s*\+\s*["'`])|[\s\S]""", lambda c: c.group(1) or "x", m.group(0)), text)
    return text


def redacted(components: DataFrame, shared_by: int = SHARED_BY, key: str = "id", text: str = "source_code") -> DataFrame:
    """(id, secrets, redacted): each text that holds credentials, with their number and without them."""
    sure = confirmed(held(candidates(components)), shared_by)
    values = sure.select("id", "value").unionByName(rescan(components, sure, shared_by, key, text=text).select("id", F.col("secret").alias("value")))
    wanted = _small(values.groupBy("id").agg(F.collect_set("value").alias("values")))

    def rule(k, source, values) -> Iterator[tuple]:
        yield k, len(values), redact(source or "", sorted(values, key=len, reverse=True))

    texts = components.select(F.col(key).alias("id"), F.col(text).alias("text")).join(wanted, "id").distinct()
    return map_columns(texts, ["id", "text", "values"], rule, "id string, secrets int, redacted string")
