"""Byte-level BPE encoding and decoding without a regex.

Pre-tokenisation is a finite automaton over codepoint classes. Each character is a
transition function; functions compose associatively, so the states of a whole batch
come from a blocked prefix scan over the automaton's transition monoid. The slices
between boundaries go through a bounded cache of merged pieces, and offsets are kept
so that any token can be decoded or located again.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import sha256_hex, text_slices

# Symbols: what a character is, with up to three characters of look-ahead.
LETTER, NUMBER, OTHER, SPACE_RUN, SPACE_JOIN, SPACE_LONE, QUOTE_1, QUOTE_2, BREAK = range(9)
# States: what the token that holds the last character still accepts.
DONE, IN_L, IN_N, IN_O, IN_W, JOINING, TAKE_1, TAKE_2 = range(8)
_STATES, _SYMBOLS = 8, 9

# Unicode's White_Space characters.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"


def _rules() -> tuple[np.ndarray, np.ndarray]:
    """(next state, boundary before the character) by [symbol, state]."""
    to = np.zeros((_SYMBOLS, _STATES), np.uint8)
    cut = np.ones((_SYMBOLS, _STATES), bool)
    for symbol, state in ((LETTER, IN_L), (NUMBER, IN_N), (OTHER, IN_O), (QUOTE_1, IN_O), (QUOTE_2, IN_O)):
        to[symbol] = state
        cut[symbol, [state, JOINING]] = False
    for symbol, state in ((QUOTE_1, TAKE_1), (QUOTE_2, TAKE_2)):
        for before in range(_STATES):
            if before not in (IN_O, JOINING):
                to[symbol, before] = state
    to[LETTER, TAKE_1], cut[LETTER, TAKE_1] = DONE, False
    to[LETTER, TAKE_2], cut[LETTER, TAKE_2] = TAKE_1, False
    to[SPACE_RUN] = IN_W
    cut[SPACE_RUN, IN_W] = False
    to[SPACE_JOIN] = JOINING
    to[SPACE_LONE] = DONE
    to[BREAK] = DONE
    return to, cut


def _monoid(to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Close the symbols' functions under composition: (symbol -> element,
    composition table, element -> state reached from DONE)."""
    elements = [tuple(range(_STATES))]
    ids = {elements[0]: 0}
    of_symbol = []
    for row in to:
        f = tuple(int(x) for x in row)
        if f not in ids:
            ids[f] = len(elements)
            elements.append(f)
        of_symbol.append(ids[f])
    known = 0
    while known < len(elements):
        f = elements[known]
        known += 1
        for g in [elements[i] for i in set(of_symbol)]:
            h = tuple(g[x] for x in f)
            if h not in ids:
                ids[h] = len(elements)
                elements.append(h)
    n = len(elements)
    compose = np.zeros((n, n), np.uint8 if n <= 256 else np.uint16)
    for i, f in enumerate(elements):
        for j, g in enumerate(elements):
            compose[i, j] = ids[tuple(g[x] for x in f)]
    return np.array(of_symbol, compose.dtype), compose, np.array([f[DONE] for f in elements], np.uint8)


_TO, _CUT = _rules()
_OF_SYMBOL, _COMPOSE, _FROM_DONE = _monoid(_TO)
_FLAT, _WIDTH = _COMPOSE.ravel(), _COMPOSE.shape[0]


def scan(elements: np.ndarray, block: int = 128) -> np.ndarray:
    """Inclusive prefix composition of monoid elements, by blocks in parallel."""
    n = len(elements)
    if n <= block:
        out, acc = np.empty_like(elements), 0
        for i, x in enumerate(elements.tolist()):
            acc = int(_COMPOSE[acc, x])
            out[i] = acc
        return out
    rows = -(-n // block)
    padded = np.zeros(rows * block, elements.dtype)
    padded[:n] = elements
    columns = np.ascontiguousarray(padded.reshape(rows, block).T)
    for t in range(1, block):
        columns[t] = _FLAT[columns[t - 1].astype(np.intp) * _WIDTH + columns[t]]
    carry = np.zeros(rows, elements.dtype)
    carry[1:] = scan(columns[-1][:-1], block) if rows > 1 else 0
    whole = _FLAT[(carry.astype(np.intp) * _WIDTH)[None, :] + columns]
    return np.ascontiguousarray(whole.T).reshape(-1)[:n]


@lru_cache(1)
def classes() -> np.ndarray:
    """Codepoint -> LETTER, NUMBER, SPACE_RUN (any white space) or OTHER."""
    out = np.full(0x110000, OTHER, np.uint8)
    for i in range(0x110000):
        kind = unicodedata.category(chr(i))[0]
        if kind == "L":
            out[i] = LETTER
        elif kind == "N":
            out[i] = NUMBER
    out[[ord(x) for x in WHITE_SPACE]] = SPACE_RUN
    return out


def boundaries(text: str, breaks: np.ndarray) -> np.ndarray:
    """Start offsets of the pieces of ``text``; characters at ``breaks`` part documents
    and belong to none."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(points)
    symbol = classes()[points]
    symbol[breaks] = BREAK
    after = np.full(n + 3, BREAK, np.uint8)
    after[:n] = symbol
    space = symbol == SPACE_RUN
    last = space & (after[1 : n + 1] != SPACE_RUN) & (after[1 : n + 1] != BREAK)
    symbol[last & (points == 0x20)] = SPACE_JOIN
    symbol[last & (points != 0x20)] = SPACE_LONE
    quotes = np.flatnonzero((points == 0x27) & (symbol == OTHER))
    if len(quotes):
        ahead = np.zeros(n + 3, np.uint32)
        ahead[:n] = points
        ahead[breaks] = 0
        a, b = ahead[quotes + 1], ahead[quotes + 2]
        one = np.isin(a, [ord(x) for x in "stmd"])
        two = np.zeros(len(quotes), bool)
        for pair in ("re", "ve", "ll"):
            two |= (a == ord(pair[0])) & (b == ord(pair[1]))
        symbol[quotes[one]] = QUOTE_1
        symbol[quotes[two]] = QUOTE_2
    states = _FROM_DONE[scan(_OF_SYMBOL[symbol])]
    before = np.zeros(n, np.uint8)
    before[1:] = states[:-1]
    return np.flatnonzero(_CUT[symbol, before] & (symbol != BREAK))


class Grown:
    """An array that takes appended lists; they wait in a list until it is viewed."""

    def __init__(self, dtype: type) -> None:
        self.held, self.waiting, self.size, self.filled = np.zeros(1024, dtype), [], 0, 0

    def add(self, values: list[int]) -> None:
        self.waiting += values
        self.size += len(values)

    def view(self) -> np.ndarray:
        if self.waiting:
            while self.size > len(self.held):
                self.held = np.concatenate([self.held, np.zeros_like(self.held)])
            self.held[self.filled : self.size] = self.waiting
            self.filled, self.waiting = self.size, []
        return self.held[: self.size]


class Codec:
    """Ranks, and a bounded cache of merged pieces."""

    def __init__(self, ranks: dict[bytes, int], cache_limit: int = 400_000) -> None:
        self.ranks, self.cache_limit = ranks, cache_limit
        size = max(ranks.values(), default=-1) + 1
        parts = [b""] * size
        for token, rank in ranks.items():
            parts[rank] = token
        self.token_len = np.array([len(x) for x in parts], np.int64)
        self.token_at = np.concatenate([[0], np.cumsum(self.token_len)])
        self.blob = np.frombuffer(b"".join(parts), np.uint8)
        self.clear()

    def clear(self) -> None:
        self.cache: dict[str, int] = {}
        self.flat, self.ends = Grown(np.uint32), Grown(np.int64)
        self.ends.add([0])

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece: the lowest-ranked neighbours join first, leftmost at ties."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        parts: list[bytes | None] = [piece[i : i + 1] for i in range(len(piece))]
        if len(parts) > 64:
            return self._merge_long(parts)
        never, get = len(self.token_len), ranks.get
        pairs = [get(piece[i : i + 2], never) for i in range(len(parts) - 1)]
        while pairs:
            best = min(pairs)
            if best == never:
                break
            at = pairs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = get(parts[at - 1] + parts[at], never)
            if at < len(pairs):
                pairs[at] = get(parts[at] + parts[at + 1], never)
        return [ranks[x] for x in parts]

    def _merge_long(self, parts: list[bytes | None]) -> list[int]:
        """As merge(), with a heap: near-linear in the piece's length."""
        ranks, n = self.ranks, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if (rank := ranks.get(parts[i] + parts[i + 1])) is not None:
                heap.append((rank, i, parts[i], parts[i + 1]))
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j >= n or parts[j] != right:
                continue
            parts[i], parts[j] = left + right, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (rank := ranks.get(parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (rank, a, parts[a], parts[b]))
        return [ranks[x] for x in parts if x is not None]

    def _piece(self, piece: str) -> int:
        ids = self.merge(piece.encode("utf-8", "replace"))
        self.cache[piece] = index = self.ends.size - 1
        self.flat.add(ids)
        self.ends.add([self.flat.size])
        return index

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, offsets of each text's ids)."""
        joined = "\n".join(texts)
        sizes = np.array([len(x) for x in texts], np.int64)
        ends = np.cumsum(sizes + 1) - 1
        starts = boundaries(joined, ends[:-1])
        if len(self.cache) > self.cache_limit:
            self.clear()
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        owner = np.searchsorted(ends, starts, "right")
        stops = np.minimum(np.append(starts[1:], len(joined)), ends[owner])
        get, miss = self.cache.get, self._piece
        pieces = [
            i if (i := get(x)) is not None else miss(x)
            for x in [joined[a:b] for a, b in zip(starts.tolist(), stops.tolist())]
        ]
        index = np.array(pieces, np.int64)
        bounds = self.ends.view()
        ids = self.flat.view()[gather(bounds[index], bounds[index + 1])]
        counts = np.bincount(owner, bounds[index + 1] - bounds[index], len(texts)).astype(np.int64)
        return ids, np.concatenate([[0], np.cumsum(counts)])

    def decode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(bytes, offset of each token's bytes, and the end)."""
        at, size = self.token_at[ids], self.token_len[ids]
        return self.blob[gather(at, at + size)].tobytes(), np.concatenate([[0], np.cumsum(size)])


def gather(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The concatenated ranges [start, stop) as one index array."""
    size = stop - start
    total = int(size.sum())
    if not total:
        return np.zeros(0, np.int64)
    keep = size > 0
    start, size = start[keep], size[keep]
    step = np.ones(total, np.int64)
    heads = np.cumsum(size)[:-1]
    step[0] = start[0]
    step[heads] = start[1:] - (start[:-1] + size[:-1] - 1)
    return np.cumsum(step)


def parse_ranks(lines: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines()) if a}


@lru_cache(2)
def load_codec(path: str, cache_limit: int = 400_000) -> Codec:
    """One codec a worker process. The file is part of an installed package, so that
    each executor has it at the same place."""
    with open(path, "rb") as f:
        return Codec(parse_ranks(f.read()), cache_limit)


def encode_documents(docs: DataFrame, ranks_path: str, *, text: str = "text", keep: list[str] | None = None,
                     with_ids: bool = False, slice_bytes: int = 1 << 20, cache_limit: int | None = None) -> DataFrame:
    """Encode each whole text and decode its ids again.

    Adds n_tokens, ids_sha256 and decoded_sha256; with ``with_ids`` also token_ids and
    token_ends (byte offset of each token's end). A null or empty text has no tokens.
    Other columns in ``keep`` (all by default, except those that clash) pass through. With a
    ``cache_limit`` a worker holds about so many merged pieces at most, and none after a task.
    """
    added = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["token_ids", "token_ends"] * with_ids
    keep = [c for c in docs.columns if c not in added] if keep is None else keep
    out_schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema
    out_schema = out_schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if with_ids:
        out_schema = out_schema.add("token_ids", T.ArrayType(T.IntegerType())).add("token_ends", T.ArrayType(T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load_codec(ranks_path, cache_limit) if cache_limit else load_codec(ranks_path)
        for part, texts in text_slices(batches, slice_bytes, "__girasol_text"):
            ids, at = codec.encode(texts)
            shas, decoded, token_ids, token_ends = [], [], [], []
            for i in range(len(texts)):
                own = ids[at[i] : at[i + 1]]
                raw, ends = codec.decode(own)
                shas.append(sha256_hex(own.astype("<u4").tobytes()))
                decoded.append(sha256_hex(raw))
                if with_ids:
                    token_ids.append(own.astype(np.int32))
                    token_ends.append(ends[1:])
            columns = [part.column(c) for c in keep]
            columns += [pa.array(np.diff(at), pa.int64()), pa.array(shas, pa.string()), pa.array(decoded, pa.string())]
            if with_ids:
                columns += [pa.array(token_ids, pa.list_(pa.int32())), pa.array(token_ends, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *added])
        if cache_limit:
            # The worker process stays for tasks of other stages, the pieces need not.
            codec.clear()

    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__girasol_text"))
    return source.mapInArrow(run, out_schema)
