"""Exact removal of repeated passages by deep-shallow suffix sorting.

Every string of ``length`` bytes holds a minimiser: the least-hashed short gram among all
that start in it. Equal strings have it at the same place, so only the suffixes around
minimisers need to be ordered, in buckets of those that share a core of some 200 bytes. In a
bucket, multikey quicksort orders suffixes to a shallow depth and blind tries order the
groups that are still tied; the same for reversed prefixes. From the two orders follows, for
each occurrence, how far it agrees with any other on both sides of the core together.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sha256_hex, text_slices
from .components import saved
from .ngramjoin import mix

_U = np.uint64
_VALUES = np.random.default_rng(20240209).integers(1, 2**63, (2, 256), dtype=np.uint64) * _U(2) + _U(1)
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
GRAM = 32
#: Depth to which multikey quicksort goes before blind tries take over.
SHALLOW = 12


def lcp(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


class BlindTrie:
    """Strings by the places where they part, without the characters in between. Each string
    is compared once, with the leaf that a blind descent reaches."""

    def __init__(self, strings: list[bytes]) -> None:
        self.strings = strings
        self.root: list | None = None

    def insert(self, i: int) -> None:
        """A node is [depth, {next character (-1: end): child}]; a leaf [None, [numbers]]."""
        s = self.strings[i]
        if self.root is None:
            self.root = [None, [i]]
            return
        node = self.root
        while node[0] is not None:
            c = s[node[0]] if node[0] < len(s) else -1
            node = node[1].get(c) or next(iter(node[1].values()))
        other = self.strings[node[1][0]]
        depth = lcp(s, other)
        if depth == len(s) == len(other):
            node[1].append(i)
            return
        above, node = None, self.root
        while node[0] is not None and node[0] < depth:
            above, node = node, node[1][s[node[0]] if node[0] < len(s) else -1]
        mine = s[depth] if depth < len(s) else -1
        if node[0] == depth:
            node[1][mine] = [None, [i]]
            return
        fork = [depth, {mine: [None, [i]], other[depth] if depth < len(other) else -1: node}]
        if above is None:
            self.root = fork
        else:
            above[1][s[above[0]] if above[0] < len(s) else -1] = fork

    def ordered(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if node[0] is None:
                out += node[1]
            else:
                stack += [node[1][c] for c in sorted(node[1], reverse=True)]
        return out


def deep_shallow(strings: list[bytes]) -> list[int]:
    """Numbers of the strings in their order; equal strings by number."""
    out: list[int] = []
    stack = [(list(range(len(strings))), 0)]
    while stack:
        group, depth = stack.pop()
        if len(group) == 1:
            out += group
            continue
        if depth >= SHALLOW:
            trie = BlindTrie(strings)
            for i in group:
                trie.insert(i)
            out += trie.ordered()
            continue
        at = [strings[i][depth] if depth < len(strings[i]) else -1 for i in group]
        pivot = sorted((at[0], at[len(at) // 2], at[-1]))[1]
        less = [i for i, c in zip(group, at) if c < pivot]
        same = [i for i, c in zip(group, at) if c == pivot]
        more = [i for i, c in zip(group, at) if c > pivot]
        if more:
            stack.append((more, depth))
        if same:
            if pivot == -1:
                stack += [([i], depth) for i in reversed(same)]
            else:
                stack.append((same, depth + 1))
        if less:
            stack.append((less, depth))
    return out


def agreements(lefts: list[bytes], rights: list[bytes], side: int) -> list[list[tuple[int, int]]]:
    """For each of some different (reversed left, right) contexts: pairs (l, r) of agreements
    with others with l + r >= side, of which every repeated string of side bytes around the
    core lies in one.

    Neighbours in the order of the lefts are joined from the longest common left down, the
    smaller set into the larger. Among those that agree on l bytes of the left, the longest
    agreement on the right is with a neighbour in the order of the rights.
    """
    n = len(lefts)
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]

    def meet(i: int, j: int) -> None:
        l, r = lcp(lefts[i], lefts[j]), lcp(rights[i], rights[j])
        if l + r >= side:
            out[i].append((l, r))
            out[j].append((l, r))

    if n == 2:
        meet(0, 1)
        return out
    rank = [0] * n
    by_rank = deep_shallow(rights)
    for k, i in enumerate(by_rank):
        rank[i] = k
    order = deep_shallow(lefts)
    depth = sorted(((lcp(lefts[a], lefts[b]), k) for k, (a, b) in enumerate(zip(order, order[1:]))), reverse=True)
    owner, sets = list(range(n)), [[rank[i]] for i in order]

    def find(k: int) -> int:
        while owner[k] != k:
            owner[k] = owner[owner[k]]
            k = owner[k]
        return k

    for _, k in depth:
        a, b = find(k), find(k + 1)
        if len(sets[a]) < len(sets[b]):
            a, b = b, a
        large, small = sets[a], sets[b]
        # Pairs within either set have met already, with more of the left in common.
        for r in small:
            at = bisect_left(large, r)
            for near in large[max(at - 1, 0) : at + 1]:
                meet(by_rank[r], by_rank[near])
        if 16 * len(small) < len(large):
            for r in small:
                insort(large, r)
        else:
            large += small
            large.sort()
        owner[b], sets[b] = a, []
    return out


@lru_cache(4)
def _powers(which: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    base = _BASES[which]
    up = np.cumprod(np.full(size, _U(base)))
    return up, np.cumprod(np.full(size, _U(pow(base, -1, 2**64))))


class Hashes:
    """Hashes of any stretches of one byte array."""

    def __init__(self, data: np.ndarray, which: int) -> None:
        size = 1 << max(20, int(len(data)).bit_length())
        self.up, self.down = _powers(which, size) if size <= 1 << 22 else _powers.__wrapped__(which, size)
        self.sums = np.concatenate([np.zeros(1, _U), np.cumsum(_VALUES[which][data] * self.up[: len(data)])])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.down[start] + (stop - start).astype(_U))

    def all(self, size: int) -> np.ndarray:
        n = max(len(self.sums) - size, 0)
        return mix((self.sums[size:] - self.sums[:n]) * self.down[:n])


def minimisers(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, hashes: Hashes, length: int) -> np.ndarray:
    """Places of the leftmost least-hashed gram of every string of ``length`` bytes."""
    window = length - GRAM + 1
    grams = hashes.all(GRAM)
    if len(grams) < window:
        return np.zeros(0, np.int64)
    # A gram's place is in the low bits of its hash, as many as the places need.
    bits = max(28, len(grams).bit_length())
    packed = (grams >> _U(bits) << _U(bits)) | np.arange(len(grams), dtype=_U)
    rows = -(-len(packed) // window) + 1
    block = np.full(rows * window, ~_U(0))
    block[: len(packed)] = packed
    block = block.reshape(rows, window)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(packed) - window + 1
    least = np.minimum(behind[:n], ahead[window - 1 : window - 1 + n])
    inside = np.zeros(n + 1, np.int8)
    long = stops - starts >= length
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, np.minimum(stops[long] - length + 1, n), -1)
    ok = np.cumsum(inside[:n]) > 0
    return np.unique(least[ok] & _U((1 << bits) - 1)).astype(np.int64)


def _sides(length: int) -> tuple[int, int]:
    """(bytes on each side, bytes of the core): they add up to length + side."""
    side = (length - GRAM) // 2
    return side, length - side


def _cores(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(key, text's number, place in it) of the cores that may hold repeats, one for each
    different context, and the stretches (number, start, stop) repeated among these texts.

    A key is one hash: texts that it confuses would also have to agree on the sides."""
    side, core = _sides(length)
    sizes = np.array([len(x) for x in texts], np.int64)
    stops = np.cumsum(sizes)
    starts = stops - sizes
    data = np.frombuffer(b"".join(texts), np.uint8)
    first = Hashes(data, 0)
    places = minimisers(data, starts, stops, first, length)
    owner = np.searchsorted(stops, places, "right")
    both, of = np.concatenate([places, places - side]), np.concatenate([owner, owner])
    left, right = np.minimum(both - starts[of], side), np.minimum(stops[of] - both - core, side)
    ok = (left >= 0) & (right >= 0) & (left + right >= side)
    at = np.unique(both[ok])
    of = np.searchsorted(stops, at, "right")
    left, right = np.minimum(at - starts[of], side), np.minimum(stops[of] - at - core, side)
    begin, end = at - left, at + core + right
    context = first.of(begin, end) ^ mix(left.astype(_U) * _U(1 << 20) + right.astype(_U), 5)
    _, one, back, count = np.unique(context, return_index=True, return_inverse=True, return_counts=True)
    again = count[back] > 1
    return first.of(at[one], at[one] + core), of[one], at[one] - starts[of[one]], of[again], begin[again] - starts[of[again]], end[again] - starts[of[again]]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _scan(docs: DataFrame, length: int, slice_bytes: int) -> DataFrame:
    """Rows with stop 0: a core's key and place; others: a stretch found within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for part, texts in text_slices(batches, slice_bytes, "__girasol_text"):
            t1, t2 = part.column("t1").to_pylist(), part.column("t2").to_pylist()
            own, ids = [], []
            for text, a, b in zip(texts, t1, t2):
                raw = text.encode("utf-8", "replace")
                if len(raw) >= length and (a, b) not in seen:
                    seen.add((a, b))
                    own.append(raw)
                    ids.append((a, b))
            if not own:
                continue
            key, of, at, rof, begin, end = _cores(own, length)
            spans: dict[int, list[tuple[int, int]]] = {}
            for i, a, b in zip(rof.tolist(), begin.tolist(), end.tolist()):
                spans.setdefault(i, []).append((a, b))
            found = [(i, a, b) for i, s in spans.items() for a, b in _merged(s)]
            ids_np = np.array(ids, np.int64).reshape(-1, 2)
            fof = np.array([x[0] for x in found], np.int64)
            t = np.concatenate([ids_np[of], ids_np[fof]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([key.view(np.int64), ids_np[fof, 0]])), pa.array(t[:, 0]), pa.array(t[:, 1]),
                 pa.array(np.concatenate([at, np.array([x[1] for x in found], np.int64)]).astype(np.int32)),
                 pa.array(np.concatenate([np.zeros(len(at), np.int64), np.array([x[2] for x in found], np.int64)]).astype(np.int32))],
                names=["k1", "t1", "t2", "at", "stop"],
            )

    return docs.mapInArrow(run, "k1 long, t1 long, t2 long, at int, stop int")


def _shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of key: those whose key has two rows or more, and all stretches. One row
    is held back between batches."""
    held: pa.RecordBatch | None = None
    held_same = False

    def flagged(batch: pa.RecordBatch, after: int | None, same_before: bool) -> tuple[pa.RecordBatch, bool]:
        key, stop = (batch.column(i).to_numpy() for i in (0, 4))
        equal = key[1:] == key[:-1]
        keep = stop > 0
        keep[1:] |= equal
        keep[:-1] |= equal
        keep[0] |= same_before
        joins = after is not None and key[-1] == after
        keep[-1] |= joins
        return batch.filter(pa.array(keep)), joins

    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            out, held_same = flagged(held, batch.column(0)[0].as_py(), held_same)
            if out.num_rows:
                yield out
        held = batch
    if held is not None:
        out, _ = flagged(held, None, held_same)
        if out.num_rows:
            yield out


def _contexts(rows: DataFrame, length: int, hot: bool) -> DataFrame:
    """For cores in texts (_text, cores): their contexts, or (hot) hashes of all strings around them."""
    side, core = _sides(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, 1 << 20, "__girasol_text"):
            out = []
            for a, b, cores, text in zip(part.column("t1").to_pylist(), part.column("t2").to_pylist(), part.column("cores").to_pylist(), texts):
                raw = text.encode("utf-8", "replace")
                hashes = [Hashes(np.frombuffer(raw, np.uint8), i) for i in (0, 1)] if hot else []
                for key, at in {(c["k1"], c["at"]) for c in cores}:
                    if hot:
                        begin = np.arange(max(at - side, 0), min(at, len(raw) - length) + 1)
                        one, two = (h.of(begin, begin + length).view(np.int64) for h in hashes)
                        out += [(p, q, a, b, s, None, None) for p, q, s in zip(one.tolist(), two.tolist(), begin.tolist())]
                    else:
                        out.append((key, None, a, b, at, raw[max(at - side, 0) : at][::-1], raw[at + core : at + core + side]))
                if len(out) > 20_000:
                    yield batch(out)
                    out = []
            yield batch(out)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) or [()] * 7
        types = [pa.int64()] * 5 + [pa.binary()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["k1", "k2", "t1", "t2", "at", "before", "after"])

    return rows.select("t1", "t2", "cores", "__girasol_text").mapInArrow(run, "k1 long, k2 long, t1 long, t2 long, at long, before binary, after binary")


def _bucket_spans(members: list[tuple], side: int, length: int) -> list[tuple[int, int, int, int]]:
    """(t1, t2, start, stop) repeated, from one bucket's (t1, t2, at, left, right)."""
    classes: dict[tuple[bytes, bytes], set[tuple[int, int, int]]] = {}
    for t1, t2, at, left, right in members:
        classes.setdefault((left, right), set()).add((t1, t2, at))
    keys = list(classes)
    found = [[(len(l), len(r))] if len(classes[l, r]) > 1 else [] for l, r in keys]
    if len(keys) > 1:
        for mine, more in zip(found, agreements([k[0] for k in keys], [k[1] for k in keys], side)):
            mine += more
    out = []
    for key, pairs in zip(keys, found):
        reach = {(l, side - r if r < side else 0) for l, r in pairs}
        for t1, t2, at in classes[key]:
            out += [(t1, t2, a, b) for a, b in _merged([(at - l, at - low + length) for l, low in reach if low <= l])]
    return out


def _ordered(length: int):  # noqa: ANN202
    """Streams buckets out of rows in order of key; one bucket is held at a time."""
    side, _ = _sides(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, out = None, [], []

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["t1", "t2", "at", "stop"])

        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(7)]
            for k1, _, t1, t2, at, left, right in zip(*cols):
                if k1 != key:
                    if len(members) > 1:
                        out += _bucket_spans(members, side, length)
                    key, members = k1, []
                members.append((t1, t2, at, left, right))
            if len(out) > 20_000:
                yield batch(out)
                out = []
        if len(members) > 1:
            out += _bucket_spans(members, side, length)
        yield batch(out)

    return run


def repeated_spans(docs: DataFrame, *, length: int = 400, hot: int = 100_000, slice_bytes: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """(rows: the columns of docs and two hashes of the text; spans: t1, t2, at, stop).

    Spans are the stretches of bytes, not merged, of a different text that are covered by
    strings of ``length`` bytes that start anywhere else, in another text or the same one.
    Buckets of more than ``hot`` suffixes are not gathered in a task: there the strings'
    hashes are counted instead, which gives the same spans.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.withColumn("__girasol_text", text).withColumn("__girasol_t1", F.xxhash64("__girasol_text")).withColumn("__girasol_t2", F.xxhash64(F.lit(7), "__girasol_text"))
    named = rows.select(F.col("__girasol_t1").alias("t1"), F.col("__girasol_t2").alias("t2"), "__girasol_text")
    scanned = _scan(named, length, slice_bytes)
    by_key = scanned.repartition("k1").sortWithinPartitions("k1")
    kept = saved(by_key.mapInArrow(_shared_keys, scanned.schema))
    cores = kept.where("stop = 0").select("k1", "t1", "t2", "at")
    large = cores.groupBy("k1").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("k1", F.lit(True).alias("_hot"))
    any_hot = not large.isEmpty()
    # Without a hot bucket, as a rule, the cores need no join.
    cores = cores.join(large, "k1", "left") if any_hot else cores.withColumn("_hot", F.lit(False))
    cores = cores.withColumn("_hot", F.coalesce("_hot", F.lit(False)))
    by_text = cores.groupBy("t1", "t2").agg(*[
        F.collect_list(F.when(F.col("_hot") == x, F.struct("k1", "at"))).alias(name) for name, x in (("cold", False), ("many", True))
    ])
    texts = named.where(F.octet_length("__girasol_text") >= length).groupBy("t1", "t2").agg(F.first("__girasol_text").alias("__girasol_text"))
    joined = by_text.join(texts, ["t1", "t2"])
    cold = _contexts(joined.withColumnRenamed("cold", "cores"), length, False)
    spans = cold.repartition("k1").sortWithinPartitions("k1").mapInArrow(_ordered(length), "t1 long, t2 long, at long, stop long")
    spans = spans.union(kept.where("stop > 0").select("t1", "t2", F.col("at").cast("long"), F.col("stop").cast("long")))
    if any_hot:
        strings = _contexts(joined.where(F.size("many") > 0).withColumnRenamed("many", "cores"), length, True).select("k1", "k2", "t1", "t2", "at").distinct()
        often = strings.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k1", "k2")
        spans = spans.union(strings.join(often, ["k1", "k2"]).select("t1", "t2", "at", (F.col("at") + length).alias("stop")))
    return rows, spans


def remove_repeats(docs: DataFrame, *, length: int = 400, **options) -> DataFrame:
    """Adds n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) to every row.

    A byte goes if a string of ``length`` bytes that also starts anywhere else covers it, as
    the texts stand before removal. Null texts are empty; shorter texts lose nothing. A text
    that other rows have too goes wholly. Clashing columns are replaced.
    """
    added = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
    keep = [c for c in docs.columns if c not in added]
    rows, spans = repeated_spans(docs, length=length, **options)
    # A span is one long, its start above its stop: a text's spans are a compact array.
    span = F.shiftleft(F.col("at"), 32).bitwiseOR(F.col("stop"))
    spans = saved(spans.select("t1", "t2", span.alias("span")).groupBy("t1", "t2").agg(F.collect_set("span").alias("__girasol_spans")))
    keys = ["__girasol_t1", "__girasol_t2"]
    copies = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__girasol_copies")).where("__girasol_copies > 1")
    about = copies.join(spans.withColumnsRenamed(dict(zip(("t1", "t2"), keys))), keys, "full")
    out = rows.select(*[F.col(f"`{c}`") for c in keep], "__girasol_text", *keys).join(about, keys, "left")
    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema
    for name, kind in (("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept_sha256", "string"), ("kept", "binary")):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, 4 << 20, "__girasol_text"):
            made = []
            for text, found, copies in zip(texts, part.column("__girasol_spans").to_pylist(), part.column("__girasol_copies").to_pylist()):
                raw = text.encode("utf-8", "replace")
                whole = bool(copies) and len(raw) >= length
                cut = [(0, len(raw))] if whole else _merged([(s >> 32, s & 0xFFFFFFFF) for s in found or ()])
                edges = [0, *[x for span in cut for x in span], len(raw)]
                left = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
                made.append((len(raw), len(raw) - len(left), len(cut), sha256_hex(left), left))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *[pa.array(c, t) for c, t in zip(zip(*made), types)]], names=[*keep, *added])

    return out.select(*[F.col(f"`{c}`") for c in keep], "__girasol_text", "__girasol_spans", "__girasol_copies").mapInArrow(run, schema)
