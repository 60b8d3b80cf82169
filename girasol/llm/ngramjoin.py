"""Exact Jaccard join of documents' word n-gram sets by universe partitioning.

Grams are hashed into m segments, m set by a band of set sizes. Two sets of the band that
differ in at most H grams agree on one of H + 1 segments, or are one deletion apart on one
of about H / 2. Small sets use one-deletion neighbourhoods, large ones segments as they are,
whichever needs fewer signatures; each large set has some segments more than it needs and
probes only with those that are fullest, so that empty ones are skipped, and has to share
several of them with the other set. Such pairs are verified on their whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from girasol.operators import packing

from .common import text_slices
from .components import connected_components, saved

_U = np.uint64
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUES = np.random.default_rng(20240131).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))
#: About how many sets, and grams that part them from their centre, a block has when a component's links are counted.
BLOCK_SETS, BLOCK_GRAMS = 1024, 400_000


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x + _U((0x632BE59BD9B4E019 * (2 * salt + 1)) % 2**64)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in a row, and how many each text has."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    data = _LOWER[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)]
    solid = ~_WHITE[data]
    edge = np.diff(solid.astype(np.int8), prepend=0)
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power = np.cumprod(np.full(len(data), _BASE))
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(_VALUES[data] * power)])
    back = np.cumprod(np.full(len(data), _INVERSE))
    hashes = mix((sums[stop] - sums[start]) * back[start] + (stop - start).astype(_U))
    ends = np.cumsum([len(x) + 1 for x in raw])
    return hashes, np.diff(np.searchsorted(start, ends, "left"), prepend=0)


def gram_sets(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct gram hashes of each text in a row, offsets). A text with fewer than
    ``size`` words has the one gram of all its words; one without words has none."""
    words, counts = word_hashes(texts)
    at = np.cumsum(counts) - counts
    grams = np.maximum(counts - size + 1, (counts > 0).astype(counts.dtype))
    total = int(grams.sum())
    owner = np.repeat(np.arange(len(texts)), grams)
    first = np.repeat(at - (np.cumsum(grams) - grams), grams) + np.arange(total)
    out = np.zeros(total, _U)
    padded = np.concatenate([words, np.zeros(size, _U)])
    for k in range(size):
        inside = k < counts[owner]
        out = mix(out + np.where(inside, padded[np.minimum(first + k, len(padded) - 1)], _U(k + 1)), k + 1)
    order = np.lexsort((out, owner))
    out, owner = out[order], owner[order]
    new = np.ones(total, bool)
    new[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    out, owner = out[new], owner[new]
    return out, np.searchsorted(owner, np.arange(len(texts) + 1))


def bands(percent: int, most: int = 2**31) -> np.ndarray:
    """Least sizes of the bands: sets that may link are in the same or in neighbouring bands."""
    out = [1]
    while out[-1] <= most:
        out.append(out[-1] * 100 // percent + 1)
    return np.array(out, np.int64)


def difference(total: np.ndarray, percent: int) -> np.ndarray:
    """Most grams in one of two linked sets only, by the sum of their sizes."""
    return total * (100 - percent) // (100 + percent)


def allotment(scheme: np.ndarray, low: np.ndarray, percent: int) -> tuple[np.ndarray, ...]:
    """For schemes by number (their lower band; -1: none): (segments, whether one-deletion
    neighbourhoods are used, segments that probe, signatures that a linked pair shares at least).

    A linked pair differs in at most h grams, so of h + k segments that probe at least k agree.
    """
    # A pair of the scheme is one of its lower band with one of either.
    lower, top = (low[np.minimum(np.maximum(scheme, 0) + k, len(low) - 1)] - 1 for k in (1, 2))
    h = difference(lower + top, percent)
    # Cost: signatures of one-deletion neighbourhoods against those of whole segments, for the
    # scheme's largest sets, so that both sets of a pair choose alike.
    whole = h + 1 + h // 8
    pieces = (h + 2) // 2
    deletion = pieces + top <= 3 * whole
    ok = (scheme >= 0) & (h > 0)
    more = np.where(deletion, 0, h // 16)
    return np.where(ok, np.where(deletion, pieces, whole), 0), deletion, h + 1 + more, 1 + more


def signatures(grams: np.ndarray, at: np.ndarray, percent: int, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, number of the set, whether the set probes with it)."""
    sizes = np.diff(at)
    band = np.searchsorted(low, sizes, "right") - 1
    item, place, value = np.repeat(np.arange(len(sizes)), sizes), mix(grams, 11) >> _U(20), mix(grams, 12)
    parts = []
    for step in (0, 1):  # with sets of the same and the next band, then with the band before
        scheme = band - step
        m, deletion, probes, _ = allotment(np.where(sizes > 0, scheme, -1), low, percent)
        ok = m > 0
        base = np.cumsum(m) - m
        count = int(m.sum())
        if not count:
            continue
        live = ok[item]
        own = item[live]
        segment = base[own] + (place[live] % m[own].astype(_U)).astype(np.int64)
        sums = np.zeros(count, _U)
        np.add.at(sums, segment, value[live])
        held = np.bincount(segment, minlength=count)
        of = np.repeat(np.arange(len(sizes)), m)
        salt = mix((np.arange(count) - base[of]).astype(_U) + (scheme[of].astype(_U) << _U(32)), 13)
        # Whole segments: the fullest of a set probe.
        order = np.lexsort((-held, of))
        rank = np.empty(count, np.int64)
        rank[order] = np.arange(count) - base[of[order]]
        parts.append((mix(sums + salt, 14), of, deletion[of] | (rank < probes[of])))
        small = deletion[own]
        segment, own, gone = segment[small], own[small], value[live][small]
        parts.append((mix(sums[segment] - gone + salt[segment], 14), own, np.ones(len(own), bool)))
    if not parts:
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*parts))


def _bits(words: int) -> list[str]:
    return [f"b{i}" for i in range(words)]


def _describe(docs: DataFrame, size: int, percent: int, words: int, slice_bytes: int) -> DataFrame:
    """doc_id, n, need (signatures that it has to share with a larger set), c1, c2 (a 128-bit signature
    of the set) and a parity bitmap of ``words`` longs."""
    names, low = ["doc_id", "n", "need", "c1", "c2", *_bits(words)], bands(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, slice_bytes, "__girasol_text"):
            grams, at = gram_sets(texts, size)
            c1, c2 = signatures_of_sets(grams, at)
            bits = parities(grams, at, words)
            need = allotment(np.searchsorted(low, np.diff(at), "right") - 1, low, percent)[3]
            columns = [part.column("doc_id"), pa.array(np.diff(at), pa.int64()), pa.array(need.astype(np.int64)), pa.array(c1.view(np.int64)), pa.array(c2.view(np.int64))]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(np.ascontiguousarray(bits[:, i])) for i in range(words)]], names=names)

    return docs.mapInArrow(run, ", ".join(f"{x} long" for x in names))


def signatures_of_sets(grams: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums of scrambled grams and the size, for each set."""
    item, sums = np.repeat(np.arange(len(at) - 1), np.diff(at)), []
    for salt in (21, 22):
        s = np.zeros(len(at) - 1, _U)
        np.add.at(s, item, mix(grams, salt))
        sums.append(mix(s + np.diff(at).astype(_U), salt))
    return sums[0], sums[1]


def parities(grams: np.ndarray, at: np.ndarray, words: int) -> np.ndarray:
    """[sets, words]: a bit is whether an odd number of a set's grams fall into its cell, so two
    sets differ in at least as many grams as their bitmaps do in bits."""
    n, cells = len(at) - 1, 64 * words
    item = np.repeat(np.arange(n), np.diff(at))
    bit = (mix(grams, 23) % _U(cells)).astype(np.int64)
    odd = (np.bincount(item * cells + bit, minlength=n * cells) & 1).astype(np.uint8).reshape(n, cells)
    return np.packbits(odd, axis=1).view(np.int64)


def _signed(docs: DataFrame, size: int, percent: int, slice_bytes: int, part: int, parts: int) -> DataFrame:
    """key, cid, probe: the signatures of each different set of a task; of ``parts`` parts of all
    keys the one numbered ``part``."""
    low = bands(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, texts in text_slices(batches, slice_bytes, "__girasol_text"):
            grams, at = gram_sets(texts, size)
            # Keys' low bits choose the part; Spark's own hash deals out the rest.
            cid = signatures_of_sets(grams, at)[0].view(np.int64)
            key, of, probe = signatures(grams, at, percent, low)
            first = np.zeros(len(cid), bool)
            for i, c in enumerate(cid.tolist()):
                if c not in seen:
                    seen.add(c)
                    first[i] = True
            keep = first[of] & (key % _U(parts) == _U(part))
            yield pa.RecordBatch.from_arrays([pa.array(key[keep].view(np.int64)), pa.array(cid[of[keep]]), pa.array(probe[keep])], names=["key", "cid", "probe"])

    return docs.select("__girasol_text").mapInArrow(run, "key long, cid long, probe boolean")


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of (key, cid): each set but a key's first, beside the one before it
    and the first. Only the last row is kept between batches."""
    last = None
    for batch in batches:
        key, cid = (batch.column(i).to_numpy() for i in (0, 1))
        probe = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
        if not len(key):
            continue
        k0, c0, f0, p0, q0 = last or (0, 0, 0, False, False)
        same = np.empty(len(key), bool)
        same[0] = last is not None and key[0] == k0
        same[1:] = key[1:] == key[:-1]
        before = np.concatenate([[c0], cid[:-1]])
        start = np.where(~same, np.arange(len(key)), -1)
        head = np.maximum.accumulate(start)
        first = np.where(head >= 0, cid[head], f0)
        first_probe = np.where(head >= 0, probe[head], q0)
        out = same & (cid != before)
        yield pa.RecordBatch.from_arrays(
            [pa.array(key[out]), pa.array(cid[out]), pa.array(before[out]), pa.array(first[out]), pa.array(probe[out]), pa.array(first_probe[out])],
            names=["key", "cid", "before", "first", "probe", "first_probe"],
        )
        last = (key[-1], cid[-1], first[-1], probe[-1], first_probe[-1])


def _verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int, slice_bytes: int) -> DataFrame:
    """Of pairs (a, b) of ids, those whose texts' sets link."""
    wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    texts = docs.join(wanted, "doc_id").select("doc_id", "__girasol_text")
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("__girasol_text").alias("_ta")), "a")
    both = both.join(texts.select(F.col("doc_id").alias("b"), F.col("__girasol_text").alias("_tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, left in text_slices(batches, slice_bytes, "_ta"):
            right = [x or "" for x in part.column("_tb").to_pylist()]
            ga, ata = gram_sets(left, size)
            gb, atb = gram_sets(right, size)
            ok = np.zeros(len(left), bool)
            for i in range(len(left)):
                x, y = ga[ata[i] : ata[i + 1]], gb[atb[i] : atb[i + 1]]
                shared = len(np.intersect1d(x, y, assume_unique=True))
                ok[i] = 100 * shared >= percent * (len(x) + len(y) - shared) > 0
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([part.column("a").filter(keep), part.column("b").filter(keep)], names=["a", "b"])

    return both.select("a", "b", "_ta", "_tb").mapInArrow(run, "a long, b long")


def _fits(percent: int, words: int) -> Column:
    """Whether sizes and bitmaps of two sets, x and y, allow a link."""
    left, right = F.col("x_n"), F.col("y_n")
    apart = sum((F.bit_count(F.col(f"x_{b}").bitwiseXOR(F.col(f"y_{b}"))) for b in _bits(words)), F.lit(0))
    near = F.least(left, right) * 100 >= F.greatest(left, right) * percent
    return near & (apart <= F.floor((left + right) * (100 - percent) / (100 + percent))) & (F.col("x_rep") != F.col("y_rep"))


def _need() -> Column:
    """Signatures that linked sets x and y share at least: those of the smaller one's scheme."""
    return F.when(F.col("x_n") <= F.col("y_n"), F.col("x_need")).otherwise(F.col("y_need"))


def _passing(pairs: DataFrame, classes: DataFrame, percent: int, words: int) -> DataFrame:
    """Pairs of sets (x, y) as pairs of first ids (a, b) whose sizes and bitmaps allow a link, and
    that came by a good part of the signatures which they have to share."""
    about = ("rep", "n", "need", *_bits(words))
    left, right = (classes.select(F.col("c1").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in about]) for s in "xy")
    often = pairs.groupBy("x", "y").agg(F.count(F.lit(1)).alias("_times"))
    fit = often.join(left, "x").join(right, "y").where(_fits(percent, words) & (4 * F.col("_times") >= _need()))
    return fit.select(F.least("x_rep", "y_rep").alias("a"), F.greatest("x_rep", "y_rep").alias("b")).distinct()


def _cross(members: DataFrame, classes: DataFrame, components: DataFrame, percent: int, words: int) -> DataFrame:
    """Pairs (a, b) of first ids of sets that share enough signatures, one of the two probing with
    each, but no component yet, and whose sizes and bitmaps allow a link. The test is part of the join."""
    comps = classes.join(components, F.col("rep") == F.col("node"), "left").select(F.col("c1").alias("cid"), F.coalesce("component", "rep").alias("comp"))
    own = members.join(comps, "cid")
    open_ = own.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("probe").alias("some")).where("lo != hi AND some").select("key")
    about = ("rep", "n", "need", *_bits(words))
    left = own.join(open_, "key").join(classes.select(F.col("c1").alias("cid"), *about), "cid")
    x, y = (left.select(F.col("key").alias(f"{s}_key"), *[F.col(c).alias(f"{s}_{c}") for c in (*about, "cid", "comp", "probe")]) for s in "xy")
    # x probes; where y does too, the pair is taken once.
    once = (F.col("x_cid") != F.col("y_cid")) & (~F.col("y_probe") | (F.col("x_cid") < F.col("y_cid")))
    pairs = x.where("x_probe").join(y, (F.col("x_key") == F.col("y_key")) & once & (F.col("x_comp") != F.col("y_comp")) & _fits(percent, words))
    pairs = pairs.select(F.least("x_rep", "y_rep").alias("a"), F.greatest("x_rep", "y_rep").alias("b"), _need().alias("need"))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("_times"), F.min("need").alias("need")).where("_times >= need").select("a", "b")


def shared_grams(grams: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, *, rare: int = 32, width: int = 8192) -> np.ndarray:
    """[sets of low, sets of high]: how many of their grams two sets have in common. A gram of up to ``rare``
    sets is counted pair by pair, others as columns of a product."""
    n = len(at) - 1
    _, column, times = np.unique(grams, return_inverse=True, return_counts=True)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], np.repeat(np.arange(n), np.diff(at))[order]
    of_low, of_high = np.cumsum(low) - 1, np.cumsum(high) - 1
    out = np.zeros((int(low.sum()), int(high.sum())), np.int64)
    few = times[column] <= rare
    seldom, holder = column[few], owner[few]
    flat = []
    for step in range(min(rare, len(seldom))):
        same = seldom[step:] == seldom[: len(seldom) - step]
        x, y = holder[: len(seldom) - step][same], holder[step:][same]
        for a, b in ((x, y), (y, x)) if step else ((x, y),):
            inside = low[a] & high[b]
            flat.append(of_low[a[inside]] * out.shape[1] + of_high[b[inside]])
    if flat:
        out += np.bincount(np.concatenate(flat), minlength=out.size).reshape(out.shape)
    often = np.cumsum(times > rare) - 1
    column, owner = often[column[~few]], owner[~few]
    for start in range(0, int((times > rare).sum()), width):
        a, b = np.searchsorted(column, [start, start + width])
        has = np.zeros((n, width), np.float32)
        has[owner[a:b], column[a:b] - start] = 1
        out += (has[low] @ has[high].T).astype(np.int64)
    return out


def _deltas(many: DataFrame, source: DataFrame, size: int) -> DataFrame:
    """(component, rep, c1, c2, n, common, delta): of each set its size, how many grams it shares with the text
    of its component's least id, the centre, and the grams that one of the two has alone."""
    texts = source.withColumnRenamed("doc_id", "rep").join(many.select("rep").distinct(), "rep").distinct()
    # A centre is copied for each BLOCK_SETS of its sets, so that no task has all of a component.
    spread = many.select("component", F.ceil(F.col("_sets") / BLOCK_SETS).alias("_copies")).distinct()
    centres = source.join(spread, F.col("doc_id") == F.col("component")).groupBy("component", "_copies").agg(F.min("__girasol_text").alias("_centre"))
    centres = centres.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1))).drop("_copies")
    own = many.withColumn("_copy", F.pmod(F.xxhash64("rep", F.lit(1)), F.ceil(F.col("_sets") / BLOCK_SETS)))
    both = own.join(texts, "rep").join(centres, ["component", "_copy"]).select("component", "rep", "c1", "c2", "__girasol_text", "_centre")
    schema = many.select("component", "rep", "c1", "c2").schema.add("n", "long").add("common", "long").add("delta", ArrayType(LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_text, centre = None, None
        for part, texts in text_slices(batches, 1 << 20, "__girasol_text"):
            c1, c2 = (part.column(c).to_numpy() for c in ("c1", "c2"))
            grams, at = gram_sets(texts, size)
            s1, s2 = signatures_of_sets(grams, at)
            # A repeated id may bring texts of other sets.
            keep = np.flatnonzero((s1.view(np.int64) == c1) & (s2.view(np.int64) == c2))
            common, delta = [], []
            for i in keep.tolist():
                if (text := part.column("_centre")[i].as_py() or "") != at_text:
                    at_text, centre = text, gram_sets([text], size)[0]
                mine = grams[at[i] : at[i + 1]]
                alone = np.setxor1d(mine, centre, assume_unique=True)
                common.append((len(mine) + len(centre) - len(alone)) // 2)
                delta.append(alone.view(np.int64))
            rows = part.take(pa.array(keep)).select(["component", "rep", "c1", "c2"])
            values = pa.array(np.concatenate(delta) if delta else np.zeros(0, np.int64))
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in delta])]).astype(np.int32))
            columns = [*rows.columns, pa.array(np.diff(at)[keep].astype(np.int64)), pa.array(common, pa.int64()), pa.ListArray.from_arrays(offsets, values)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return both.mapInArrow(run, schema)


def _count_links(classes: DataFrame, reached: DataFrame, source: DataFrame, size: int, percent: int) -> DataFrame:
    """(c1, c2, n_links): with how many other sets each set of a component links.

    All links are inside components. A set is told by what parts it from its component's centre: sets x and y
    have common(x) + common(y) - |centre| grams of the centre in common, and one more for each gram that both
    lack or both have beyond it. What is left of alike sets is short. These rests are dealt into blocks, and every
    two blocks (and each by itself) are a group in which all sets are compared. Two sets alone are linked.
    """
    own = classes.select("c1", "c2", "rep").join(reached.select(F.col("node").alias("rep"), "component"), "rep")
    own = saved(own.join(own.groupBy("component").agg(F.count(F.lit(1)).alias("_sets")), "component"))
    deltas = saved(_deltas(own.where("_sets > 2"), source, size))
    sums = deltas.groupBy("component").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_SETS, F.sum(F.size("delta")) / BLOCK_GRAMS)).alias("_blocks"))
    dealt = deltas.join(sums, "component").withColumn("_block", F.pmod(F.xxhash64("rep"), F.col("_blocks")))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    dealt = dealt.select("component", "c1", "c2", "n", "common", "delta", F.least("_block", "_other").alias("_lo"), F.greatest("_block", "_other").alias("_hi"), (F.col("_block") <= F.col("_other")).alias("_low"))

    def count(group: pa.Table) -> pa.Table:
        c1, c2, n, common = (group.column(c).to_numpy() for c in ("c1", "c2", "n", "common"))
        # A repeated id may bring a set more than once.
        keep = np.sort(np.unique(np.stack([c1, c2]), axis=1, return_index=True)[1])
        c1, c2, n, common = c1[keep], c2[keep], n[keep], common[keep]
        delta = group.column("delta").combine_chunks().take(pa.array(keep))
        at = np.concatenate([[0], np.cumsum(delta.value_lengths().to_numpy())]).astype(np.int64)
        alone = group.column("_lo")[0] == group.column("_hi")[0]
        low = group.column("_low").to_numpy()[keep].astype(bool)
        high = low if alone else ~low
        both = shared_grams(delta.flatten().to_numpy().view(_U), at, low, high)
        # |centre|, by any of the sets.
        whole = int(at[1] - n[0] + 2 * common[0])
        both += common[low][:, None] + common[high][None, :] - whole
        linked = 100 * both >= percent * (n[low][:, None] + n[high][None, :] - both)
        if alone:
            np.fill_diagonal(linked, False)
        out = np.zeros(len(keep), np.int64)
        out[low] = linked.sum(1)
        if not alone:
            out[high] = linked.sum(0)
        return pa.table({"c1": c1, "c2": c2, "n_links": out})

    counted = dealt.groupBy("component", "_lo", "_hi").applyInArrow(count, "c1 long, c2 long, n_links long")
    counted = counted.groupBy("c1", "c2").agg(F.sum("n_links").alias("n_links"))
    return saved(counted.union(own.where("_sets = 2").select("c1", "c2", F.lit(1).cast("long"))))


def link_documents(docs: DataFrame, *, size: int = 3, percent: int = 90, passes: int = 2, staged: bool = False, bitmap_words: int = 4, slice_bytes: int = 1 << 20, count_links: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for every row of ``docs``.

    A text's set has its different grams of ``size`` words (lower-cased A-Z, parted by ASCII
    white space); with fewer words it has the whole sequence as one gram, without any (or
    null) none. Sets link when 100 x intersection >= ``percent`` x union. component_id is
    the least id reachable by links; n_links counts all links of the row's set to other sets
    (copies are not links here). Without ``count_links`` there is no such column.

    First every set that shares a signature is tried with its neighbour and with the first
    of the signature; then, among sets that share enough signatures but ended in different
    components, all that sizes and bitmaps allow. ``staged`` verifies one pair of each set
    before the other pairs of the first step, which moves fewer texts and takes more rounds;
    components are the same. ``bitmap_words`` longs a set tell unlike sets apart before their
    texts are moved; lower thresholds and larger sets need more of them. So no link between components is missed,
    and components of many alike texts need no comparison of all pairs; n_links needs it, and
    has it by blocks. Ids may repeat; rows
    without an id take part by their text.
    """
    source = docs.select("doc_id", F.col("text").cast("string").alias("__girasol_text"))
    base = saved(_describe(source, size, percent, bitmap_words, slice_bytes))
    numbers = [F.min(c).alias(c) for c in ("n", "need", *_bits(bitmap_words))]
    classes = saved(base.where("n > 0").groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), *numbers))
    # Keys are taken part by part: each part's shuffle is gone before the next begins.
    shared = None
    for part in range(passes):
        rows = _signed(source, size, percent, slice_bytes, part, passes)
        one = saved(rows.repartition("key").sortWithinPartitions("key", "cid").mapInArrow(
            _grouped, "key long, cid long, before long, first long, probe boolean, first_probe boolean"))
        shared = one if shared is None else shared.union(one)
    near = shared.select(F.least("cid", "before").alias("x"), F.greatest("cid", "before").alias("y")).union(
        shared.select(F.least("cid", "first"), F.greatest("cid", "first"))).where("x != y")
    near = saved(_passing(near, classes, percent, bitmap_words))
    if staged:
        # One verified pair for each set joins most of what belongs together; of the other pairs
        # only those between components are left to do.
        first = near.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
        links = saved(_verified(first, source, size, percent, slice_bytes))
        reached = connected_components(links)
        apart = near
        for end in ("a", "b"):
            apart = apart.join(reached.select(F.col("node").alias(end), F.col("component").alias(f"_{end}")), end, "left")
        apart = apart.where(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b").join(first, ["a", "b"], "left_anti")
        links = saved(links.union(_verified(apart, source, size, percent, slice_bytes)))
    else:
        links = saved(_verified(near, source, size, percent, slice_bytes))
    reached = connected_components(links)
    members = shared.select("key", "cid", "probe").union(shared.select("key", "first", "first_probe")).groupBy("key", "cid").agg(F.max("probe").alias("probe"))
    more = saved(_verified(_cross(members, classes, reached, percent, bitmap_words), source, size, percent, slice_bytes))
    reached = connected_components(links.union(more))
    named = classes.select("c1", "c2", "rep").join(reached.select(F.col("node").alias("rep"), "component"), "rep", "left")
    counts = []
    if count_links:
        named = named.join(_count_links(classes, reached, source, size, percent), ["c1", "c2"], "left")
        counts = [F.coalesce("n_links", F.lit(0)).alias("n_links")]
    out = base.join(named, ["c1", "c2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"), *counts)


def first_of_groups(docs: DataFrame, **options) -> DataFrame:
    """One row of each group of linked documents: that of the least id. Rows that repeat an id with the
    same text are one document and stay or go together; with other texts they are documents of their own, of
    which the first by a hash of the text counts as the least. Rows without an id, or without words, stay."""
    print_ = F.md5(F.col("text").cast("string").cast("binary"))
    known = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    if known.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("x"), F.max(F.xxhash64("text")).alias("y")).where("x != y").isEmpty():
        return _first_of_ids(docs, options)
    # Numbers in the order of (id, hash) stand for the ids; parts of the order are not counted through.
    own = known.select("doc_id", print_.alias("_print"), "text").dropDuplicates(["doc_id", "_print"])
    table = packing.in_order(own, [F.col("doc_id"), F.col("_print")])
    number = (F.shiftleft(F.col("_part").cast("long"), 33) + F.col("_in")).alias("_number")
    linked = link_documents(table.select(number.alias("doc_id"), "text"), count_links=False, **options).where("doc_id != component_id").select(F.col("doc_id").alias("_number"))
    gone = table.select("doc_id", "_print", number).join(linked, "_number").select(F.col("doc_id").alias("_id"), "_print")
    return docs.withColumn("_own", print_).join(gone, (F.col("doc_id") == F.col("_id")) & (F.col("_own") == F.col("_print")), "left_anti").select(docs.columns)


def _first_of_ids(docs: DataFrame, options: dict) -> DataFrame:
    linked = link_documents(docs, count_links=False, **options).where("doc_id != component_id").select("doc_id").distinct()
    return docs.join(linked, "doc_id", "left_anti").select(docs.columns)
