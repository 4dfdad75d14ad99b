"""Problem 7: encoding of a corpus by a public byte-level BPE.

Pre-tokenisation uses no regular expression. The texts of a batch become one array of code points; a class array (letter, number,
other, apostrophe of a contraction, the kinds of white space) feeds a small automaton that tells where tokens start. Its transition
functions under composition form a finite monoid, so the state before every code point comes from an associative prefix scan over
monoid elements: scanned inside blocks for all blocks at once, then over the blocks, then put together. The slices between starts
are merged by rank, through a cache of slices already merged. Offsets of the slices and the bytes of the ids give the text back.

Defined results: null and empty text give an empty list; texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import heapq
import os
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oresieve.llm.common import spread

#: Folder of the public vocabularies; a parameter of every operator here.
TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Slices kept merged in a worker before its cache starts anew.
CACHE = 200_000
#: Code points that are put together for one scan.
BATCH = 1 << 20

# The code points with the White_Space property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

# Code point classes.
LETTER, NUMBER, OTHER, QUOTE1, QUOTE2, LEAD, SPACE_START, SPACE_MORE, BREAK = range(9)
# States: nothing open, in a run of letters, numbers or others, after a leading space, one or two letters of a contraction to come.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, LED, ONE_MORE, TWO_MORE = range(7)
_OPENS = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, QUOTE1: ONE_MORE, QUOTE2: TWO_MORE, LEAD: LED, SPACE_START: FRESH, SPACE_MORE: FRESH, BREAK: FRESH}
_JOINS = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, QUOTE1: IN_OTHERS, QUOTE2: IN_OTHERS}


def _step(state: int, kind: int) -> tuple[int, bool]:
    """Next state, and whether a token starts at this code point."""
    if kind == BREAK:
        return FRESH, True
    if kind == SPACE_MORE:
        return FRESH, False
    if state == TWO_MORE:
        return ONE_MORE, False
    if state == ONE_MORE:
        return FRESH, False
    if kind in _JOINS and (state == LED or _JOINS[kind] == state):
        return _JOINS[kind], False
    return _OPENS[kind], True


@lru_cache(maxsize=1)
def _automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(element of each class, product table, state reached from FRESH by each element, starts by state and class)."""
    functions = [tuple(_step(s, c)[0] for s in range(7)) for c in range(9)]
    elements = [tuple(range(7))]
    index = {elements[0]: 0}
    for f in functions:
        if f not in index:
            index[f] = len(elements)
            elements.append(f)
    done = 0
    while done < len(elements):
        for f in functions:
            h = tuple(f[s] for s in elements[done])
            if h not in index:
                index[h] = len(elements)
                elements.append(h)
        done += 1
    table = np.array([[index[tuple(g[s] for s in f)] for g in elements] for f in elements], dtype=np.int16)
    return (
        np.array([index[f] for f in functions], dtype=np.int16),
        table,
        np.array([f[FRESH] for f in elements], dtype=np.int8),
        np.array([[_step(s, c)[1] for c in range(9)] for s in range(7)]),
    )


def _prefix(elements: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Inclusive prefix products of monoid elements, by blocks."""
    n = len(elements)
    if n <= 64:
        out = elements.copy()
        for i in range(1, n):
            out[i] = table[out[i - 1], out[i]]
        return out
    width = 64
    rows = -(-n // width)
    block = np.zeros(rows * width, dtype=elements.dtype)
    block[:n] = elements
    block = np.ascontiguousarray(block.reshape(rows, width).T)
    for i in range(1, width):
        block[i] = table[block[i - 1], block[i]]
    before = np.zeros(rows, dtype=elements.dtype)
    before[1:] = _prefix(block[-1], table)[:-1]
    return table[before[None, :], block].T.reshape(-1)[:n]


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Letter, number, other or white space (as SPACE_MORE) of every code point."""
    kinds = np.full(0x110000, OTHER, dtype=np.int8)
    category = unicodedata.category
    for start in range(0, 0x110000, 0x1000):
        for c in range(start, start + 0x1000):
            first = category(chr(c))[0]
            if first == "L":
                kinds[c] = LETTER
            elif first == "N":
                kinds[c] = NUMBER
    kinds[WHITE_SPACE] = SPACE_MORE
    return kinds


def token_starts(points: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Where pre-tokens start in an array of code points; breaks marks the separators between texts."""
    n = len(points)
    kinds = _classes()[np.where(breaks, 0, points)]
    space = (kinds == SPACE_MORE) & ~breaks
    end = np.ones(n, dtype=bool)  # no code point of the same text follows
    end[:-1] = breaks[1:]
    follows = np.zeros(n, dtype=bool)
    follows[:-1] = ~space[1:] & ~breaks[1:]
    before = np.zeros(n, dtype=bool)
    before[1:] = space[:-1]
    last = space & follows
    kinds[space & (~before | last)] = SPACE_START
    kinds[last & (points == 32)] = LEAD
    quotes = np.flatnonzero((points == 39) & ~breaks)
    if len(quotes):
        padded = np.append(np.where(breaks, 0, points), [0, 0])
        one, two = padded[quotes + 1], padded[quotes + 2]
        kinds[quotes[np.isin(one, [ord(c) for c in "stmd"])]] = QUOTE1
        pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        kinds[quotes[pair]] = QUOTE2
    kinds[breaks] = BREAK
    element, table, reached, starts = _automaton()
    state = np.zeros(n, dtype=np.int8)
    if n > 1:
        state[1:] = reached[_prefix(element[kinds], table)][:-1]
    return starts[state, kinds]


@lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Merger:
    """Merges the bytes of a slice by rank."""

    def __init__(self, path: str, cache: int = CACHE):
        self.ranks, self.cache, self.most = ranks(path), {}, cache

    def __call__(self, piece: str) -> list[int]:
        found = self.cache.get(piece)
        if found is None:
            if len(self.cache) >= self.most:
                self.cache.clear()
            raw = piece.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(raw)
            found = [whole] if whole is not None else self.merge(raw)
            if len(raw) <= 256:
                self.cache[piece] = found
        return found

    def merge(self, raw: bytes) -> list[int]:
        """By a heap of neighbouring pairs, so a slice of n bytes takes n log n."""
        rank = self.ranks
        parts: list[bytes | None] = [raw[i : i + 1] for i in range(len(raw))]
        n = len(parts)
        after, ahead = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank[p], i, p) for i in range(n - 1) if (p := parts[i] + parts[i + 1]) in rank]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else n
            if j >= n or len(parts[i]) + len(parts[j]) != len(pair) or parts[i] + parts[j] != pair:
                continue
            parts[i], parts[j] = pair, None
            after[i] = after[j]
            if after[j] < n:
                ahead[after[j]] = i
                p = pair + parts[after[j]]
                if p in rank:
                    heapq.heappush(heap, (rank[p], i, p))
            if ahead[i] >= 0:
                p = parts[ahead[i]] + pair
                if p in rank:
                    heapq.heappush(heap, (rank[p], ahead[i], p))
        return [rank[p] for p in parts if p is not None]


def slices(texts: list[str | None]) -> list[list[int]]:
    """Offsets of the pre-tokens of each text, the end included; [0] for an empty one."""
    out: list[list[int]] = []
    group: list[str] = []
    size = 0

    def flush():
        joined = "\0".join(group) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        ends = np.cumsum([len(t) + 1 for t in group]) - 1
        breaks = np.zeros(len(points), dtype=bool)
        breaks[ends] = True
        starts = np.flatnonzero(token_starts(points, breaks))
        first = np.searchsorted(starts, np.concatenate(([0], ends[:-1] + 1)))
        last = np.searchsorted(starts, ends)
        begin = np.concatenate(([0], ends[:-1] + 1))
        for a, b, at in zip(first.tolist(), last.tolist(), begin.tolist()):
            out.append((starts[a : b + 1] - at).tolist())
        group.clear()

    for text in texts:
        group.append(text or "")
        size += len(group[-1]) + 1
        if size >= BATCH:
            flush()
            size = 0
    if group:
        flush()
    return out


def encode(texts: list[str | None], merger: Merger) -> list[list[int]]:
    out = []
    for text, cuts in zip(texts, slices(texts)):
        ids: list[int] = []
        a = 0
        for b in cuts[1:]:
            ids += merger(text[a:b])
            a = b
        out.append(ids)
    return out


def decode(ids: list[int], path: str) -> str:
    """The text of ids."""
    return b"".join(_pieces(path)[i] for i in ids).decode("utf-8", "surrogatepass")


@lru_cache(maxsize=2)
def _pieces(path: str) -> dict[int, bytes]:
    return {i: piece for piece, i in ranks(path).items()}


@lru_cache(maxsize=2)
def merger_of(path: str) -> Merger:
    return Merger(path)


def encoded(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: list[str] = (), what: str = "ids", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """The key, the columns kept, and of each text: ids, their number (what="n_tokens"), or both with the offsets of the slices (what="offsets")."""
    path = os.path.join(folder, vocabulary)
    columns = [key, *keep]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    schema = kinds + {"ids": ", ids array<int>", "n_tokens": ", n_tokens int", "offsets": ", ids array<int>, offsets array<int>"}[what]

    def lists(rows: list[list[int]]) -> pa.Array:
        sizes = np.zeros(len(rows) + 1, dtype=np.int32)
        np.cumsum([len(r) for r in rows], out=sizes[1:])
        flat = np.fromiter((x for r in rows for x in r), dtype=np.int32, count=int(sizes[-1]))
        return pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat))

    def run(batches):
        merger = merger_of(path)
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                texts = batch.column(batch.num_columns - 1).to_pylist()
                ids = encode(texts, merger)
                arrays = [batch.column(i) for i in range(len(columns))]
                if what == "n_tokens":
                    arrays.append(pa.array([len(x) for x in ids], type=pa.int32()))
                else:
                    arrays.append(lists(ids))
                if what == "offsets":
                    arrays.append(lists(slices(texts)))
                yield pa.RecordBatch.from_arrays(arrays, names=[*columns, *(["ids", "offsets"] if what == "offsets" else [what])])

    return spread(docs.select(*[F.col(c) for c in columns], F.col(text).alias("__text"))).mapInArrow(run, schema)
