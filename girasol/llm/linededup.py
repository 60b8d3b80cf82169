"""Near-duplicate lines by an exact set-similarity join, in DataFrame functions only.

A line is the set of its lower-case words, parted by white space; scripts that are written
without spaces count by three neighbouring characters. Words are ordered by rarity; two lines of
similarity t share a word among the first few of each (prefix filter; the shorter line's prefix
may be about half as long), at places that leave enough words for the overlap (positional
filter), and are of like length (length filter). What passes, and a parity bitmap that bounds
the difference, is verified by the Jaccard similarity of the whole sets. A line that matches an
earlier one is removed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import dropped, release, saved, written

#: Cells of the word-frequency sketch; a fixed size, whatever the vocabulary.
CELLS = 1 << 17
#: Sets of more words have a bitmap of 128 bits instead of 64; where even that says little, the
#: prefixes of a pair are compared before its lines are moved.
LONG, VERY_LONG = 100, 200
#: Sets that share a key of their prefix are a crowd if there are more than this.
CROWD = 16
#: Crowds are first thinned out where their pairs outnumber this many times the sets.
DENSE = 0.125
#: Crowds are thinned out again, by other keys, while a round closes at least this share of their
#: open sets; and so often at most.
GAIN, ROUNDS = 0.2, 4
#: Parts of all words, by hash.
PARTS = 2
#: One in so many sets is looked at to estimate those pairs.
SPARSE = 8
#: White space other than U+0020 and the newline that parts lines.
WHITE = "[\t\x0b\x0c\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Thai, Lao, Burmese, Khmer, kana and Han.
UNSPACED = "[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U000323af]"


def _spaced(text: Column) -> Column:
    """The text with words parted by U+0020 alone, lines as they are. Three characters in a row
    of an unspaced script are a word each time; most texts only need the first look."""
    apart = F.regexp_replace(F.regexp_replace(text, WHITE, " "), f"(?=({UNSPACED}{{3}})){UNSPACED}", " $1 ")
    return F.when(text.rlike("[\t\x0b\x0c\r\x85\xa0\u0e00-\U0010ffff]"), apart).otherwise(text)


def _hashes(line: Column) -> Column:
    """Hashes of the distinct words of a lower-case line with spaces."""
    return F.array_distinct(F.transform(F.array_remove(F.split(line, " "), ""), lambda w: F.xxhash64(w)))


def rarity(docs: DataFrame) -> DataFrame:
    """One row with an array: for each cell of the sketch, four times the binary logarithm of how
    many words of the whole corpus fall into it, in the place that it has in a key. CELLS small
    numbers reach the driver."""
    word = docs.select(F.explode(F.split(F.replace("__girasol_text", F.lit("\n"), F.lit(" ")), " ")).alias("_word"))
    cell = F.xxhash64("_word").bitwiseAND(F.lit(CELLS - 1)).cast("int").alias("cell")
    counts = word.select(cell).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).toArrow()
    out = np.zeros(CELLS, np.int64)
    out[counts.column("cell").to_numpy()] = np.minimum(4 * np.log2(counts.column("n").to_numpy() + 1), 127).astype(np.int64)
    return docs.sparkSession.createDataFrame([((out << 56).tolist(),)], "ranks array<bigint>")


def _classes(docs: DataFrame, ranks: DataFrame, similarity: float) -> DataFrame:
    """One row for each set of words: its first place (d, l), size n, prefix, bitmap and two
    keys of the prefix. A word's key is its frequency and 56 bits of its hash, so that keys sort by rarity. A bit is the parity
    of how many keys fall into its cell; a long set's second half of the cells is in high."""
    lines = docs.select("doc_id", F.posexplode(F.split("__girasol_text", "\n")).alias("_at", "_line")).where(F.trim("_line") != "")
    # The ranks are a scalar subquery (a literal of their size would fill plans and event logs),
    # named in a projection of its own, which the optimizer merges into the next.
    named = lines.select("doc_id", "_at", "_line", ranks.scalar().alias("_ranks"))

    def key(h: Column) -> Column:
        # Never null; that the plan knows it lets the keys be sorted as plain numbers.
        rank = F.coalesce(F.get(F.col("_ranks"), h.bitwiseAND(F.lit(CELLS - 1)).cast("int")), F.lit(0).cast("long"))
        return rank.bitwiseOR(F.shiftrightunsigned(h, 8))

    def flipped(bits: Column, k: Column) -> Column:
        return bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k.bitwiseAND(F.lit(63)).cast("int")))

    def parity(keys: Column) -> Column:
        return F.aggregate(keys, F.lit(0).cast("long"), flipped)

    keyed = named.select("doc_id", "_at", F.sort_array(F.transform(_hashes(F.col("_line")), key)).alias("_keys")).withColumn("n", F.size("_keys"))
    least = F.ceil(F.col("n") * F.lit(similarity) - 1e-9).cast("int")
    keyed = keyed.select(
        F.xxhash64("_keys", "n").alias("_set"), F.hash("_keys").alias("_set2"), F.struct("doc_id", "_at").alias("_place"), "n",
        F.transform(F.slice("_keys", F.lit(1), F.col("n") - least + 1), lambda k: F.hash(k)).alias("prefix"),
        parity(F.col("_keys")).alias("bits"),
        F.when(F.col("n") > LONG, parity(F.filter("_keys", lambda k: k.bitwiseAND(F.lit(64)) != 0))).otherwise(F.lit(0).cast("long")).alias("high"),
    )
    firsts = keyed.groupBy("_set", "_set2").agg(F.min("_place").alias("_place"), *[F.first(c).alias(c) for c in ("n", "prefix", "bits", "high")])
    least, greatest = _ends(F.col("prefix"))
    return firsts.select(
        F.col("_place.doc_id").alias("d"), F.col("_place._at").alias("l"), "n", "prefix", F.col("bits").bitwiseXOR(F.col("high")).alias("bits"), "high",
        least.alias("least"), greatest.alias("greatest"),
    )


def _sided(rows: DataFrame, side: str) -> DataFrame:
    return rows.select(*[F.col(c).alias(side + c) for c in rows.columns])


def _before(one: str, two: str) -> Column:
    return (F.col(f"{one}d") < F.col(f"{two}d")) | ((F.col(f"{one}d") == F.col(f"{two}d")) & (F.col(f"{one}l") < F.col(f"{two}l")))


def _overlap(an: Column, bn: Column, similarity: float) -> Column:
    """Words that sets of an and bn words have in common at least, if they match."""
    return F.ceil((an + bn) * F.lit(similarity / (1 + similarity)) - 1e-9)


def _fits(an: Column, bn: Column, similarity: float) -> Column:
    """Whether sizes and bitmaps of sets a and b allow a match."""
    near = F.least(an, bn) >= F.greatest(an, bn) * F.lit(similarity) - 1e-9
    bits, high = (F.col(f"a{c}").bitwiseXOR(F.col(f"b{c}")) for c in ("bits", "high"))
    # A long set is compared with another one in all of its cells, with a short one in 64.
    apart = F.when(F.least(an, bn) > LONG, F.bit_count(bits) + F.bit_count(high)).otherwise(F.bit_count(bits.bitwiseXOR(high)))
    return near & (apart <= an + bn - 2 * _overlap(an, bn, similarity))


def _ends(prefix: Column) -> tuple[Column, Column]:
    """Keys of a prefix: its two least and its two greatest hashes. One hash alone is shared by
    many sets that have nothing else in common."""
    least, greatest = F.array_min(prefix), F.array_max(prefix)
    return F.hash(least, F.array_min(F.array_remove(prefix, least))), F.hash(greatest, F.array_max(F.array_remove(prefix, greatest)))


def _keyed(sets: DataFrame, salt: int, *columns: str) -> DataFrame:
    """Sets by their two keys; by keys of other hashes for each salt but 0."""
    if salt:
        ends = _ends(F.transform("prefix", lambda t: F.hash(t, F.lit(salt))))
        sets = sets.select(*columns, *[e.alias(k) for e, k in zip(ends, ("least", "greatest"))])
    return sets.select(*columns, F.explode(F.array_distinct(F.array("least", "greatest"))).alias("key"))


def _crowds(classes: DataFrame, limit: int) -> DataFrame | None:
    """The saved sets in crowds, or None where crowds are so small that the join of their sets is
    no more than the rest. Which keys have crowds, and how many pairs those have, is estimated on
    some of the sets; whatever is found, the result is the same."""
    some = classes.where(F.pmod(F.xxhash64("d", "l"), F.lit(SPARSE)) == 0)
    keys = saved(_keyed(some, 0).groupBy("key").agg(F.count(F.lit(1)).cast("double").alias("m")).where(F.col("m") * SPARSE > CROWD))
    many, pairs = keys.agg(F.count(F.lit(1)), F.sum(F.col("m") * F.col("m") * (SPARSE * SPARSE / 2))).first()
    if (pairs or 0) <= DENSE * classes.count():
        return None
    inside = classes
    for end in ("least", "greatest"):
        known = _sent_out(keys.select(F.col("key").alias(end), F.lit(True).alias(f"_in_{end}")), many, limit)
        inside = inside.join(known, end, "left")
    return saved(inside.where("_in_least OR _in_greatest").select("d", "l", "n", "prefix", "bits", "high", "least", "greatest"))


def _crowded(members: DataFrame, similarity: float, salt: int) -> DataFrame:
    """Pairs (a before b) of an open set and the earliest one that has the same least, or greatest,
    hashes in its prefix: two at most for each set, however large the crowd."""
    about = ("d", "l", "n", "bits", "high")
    least = _keyed(members, salt, *about).groupBy("key").agg(F.min(F.struct(*about)).alias("a"))
    least = least.select("key", *[F.col(f"a.{c}").alias(f"a{c}") for c in about])
    later = _sided(_keyed(members.where("open"), salt, *about), "b").withColumnRenamed("bkey", "key")
    return later.join(least, "key").where(_fits(F.col("an"), F.col("bn"), similarity) & _before("a", "b")).select("ad", "al", "bd", "bl", (F.greatest("an", "bn") > VERY_LONG).alias("long")).distinct()


def _thinned(docs: DataFrame, members: DataFrame, similarity: float, limit: int) -> DataFrame:
    """(d, l): sets of crowds that match an earlier one, by the earliest sets of their keys."""
    lines, path = written(_lines(docs, members.select("d", "l"), limit))
    found, left = None, members.count()
    for salt in range(ROUNDS):
        now = members.withColumn("open", F.lit(True))
        if found is not None:
            known = found.select("d", "l", F.lit(False).alias("open"))
            now = members.join(known, ["d", "l"], "left").withColumn("open", F.coalesce("open", F.lit(True)))
        more = _verified(_likely(_crowded(now, similarity, salt), members, similarity), lines, similarity)
        closed = more.count()
        found = more if found is None else found.union(more)
        if closed < GAIN * left:
            break
        left -= closed
    dropped(docs.sparkSession, path)
    return found


def _candidates(classes: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a before b) of places, b one of the open sets, that pass the prefix, length,
    positional and bitmap filters. In the join, a is the set of fewer words. Words are joined in
    PARTS parts, so that the postings of one are gone before the next begins."""
    size = F.shiftleft(F.col("n").cast("long"), 32)
    posted = classes.select("d", "l", size.bitwiseOR(F.col("open").cast("long")).alias("n"), "bits", "high", F.posexplode("prefix").alias("p", "tok"))
    # n, p and open in one long: a posting is as short as it can be.
    posted = posted.select("tok", "d", "l", "bits", "high", F.col("n").bitwiseOR(F.shiftleft("p", 1).cast("long")).alias("npo"))
    an, bn = (F.shiftright(F.col(f"{s}npo"), 32).cast("int") for s in "ab")
    ap, bp = (F.shiftright(F.col(f"{s}npo").bitwiseAND(F.lit(0xFFFFFFFF)), 1).cast("int") for s in "ab")
    aopen, bopen = (F.col(f"{s}npo").bitwiseAND(F.lit(1)) == 1 for s in "ab")
    first = _before("a", "b")
    early, late = (F.when(x, F.struct(F.col("ad").alias("d"), F.col("al").alias("l"))).otherwise(F.struct(F.col("bd").alias("d"), F.col("bl").alias("l"))) for x in (first, ~first))

    def of_part(part: int) -> DataFrame:
        some = posted.where(F.pmod("tok", F.lit(PARTS)) == part)
        a, b = _sided(some, "a"), _sided(some, "b")
        a = a.where(ap <= an - F.ceil(an * F.lit(2 * similarity / (1 + similarity)) - 1e-9))
        pairs = a.join(
            b,
            (F.col("atok") == F.col("btok")) & ((an < bn) | ((an == bn) & first)) & F.when(first, bopen).otherwise(aopen)
            & _fits(an, bn, similarity) & (F.least(an - ap, bn - bp) >= _overlap(an, bn, similarity)),
        )
        pairs = pairs.select(early.alias("a"), late.alias("b"), (bn > VERY_LONG).alias("long"))
        return pairs.select(F.col("a.d").alias("ad"), F.col("a.l").alias("al"), F.col("b.d").alias("bd"), F.col("b.l").alias("bl"), "long").distinct()

    out = None
    for part in range(PARTS):
        one = saved(of_part(part))
        out = one if out is None else out.union(one)
    return out.distinct()


def _likely(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """Pairs, of very long sets only those whose prefixes have enough words in common.

    Words are in one order, so either all of a's prefix that b's has not is missing in b, or all of
    b's that a's has not is missing in a: the sets share no more than the larger rest and what
    the prefixes share. (Words of one hash in a prefix are allowed for.)
    """
    # The smaller set of such a pair may be shorter itself.
    some = classes.where(F.col("n") >= F.floor(F.lit(VERY_LONG * similarity)))
    a, b = (_sided(some.select("d", "l", "n", "prefix"), s) for s in "ab")
    both = pairs.where("long").join(a, ["ad", "al"]).join(b, ["bd", "bl"])
    rest = F.greatest(F.col("an") - F.size("aprefix"), F.col("bn") - F.size("bprefix"))
    shared = F.size(F.array_intersect("aprefix", "bprefix")) + F.size("aprefix") - F.size(F.array_distinct("aprefix"))
    alike = both.where(rest + shared >= _overlap(F.col("an"), F.col("bn"), similarity)).select("ad", "al", "bd", "bl")
    return pairs.where("NOT long").select("ad", "al", "bd", "bl").union(alike)


def _sent_out(rows: DataFrame, lines: int, limit: int) -> DataFrame:
    """Rows with places of lines by document: broadcast while they are few enough; a shuffled join beyond that."""
    return F.broadcast(rows) if lines <= limit else rows


def _lines(docs: DataFrame, places: DataFrame, limit: int) -> DataFrame:
    """(d, l, line): the lines at distinct places (d, l). Only these are put in lower case and parted."""
    wanted = saved(places.select(F.col("d").alias("doc_id"), F.col("l").alias("_at")).groupBy("doc_id").agg(F.collect_list("_at").alias("_asked")))
    lines = wanted.agg(F.sum(F.size("_asked"))).first()[0] or 0
    found = docs.join(_sent_out(wanted, lines, limit), "doc_id").select("doc_id", F.split("text", "\n").alias("__girasol_lines"), F.explode("_asked").alias("_at"))
    return found.select(F.col("doc_id").alias("d"), F.col("_at").alias("l"), F.lower(_spaced(F.get("__girasol_lines", F.col("_at")))).alias("line"))


def _verified(pairs: DataFrame, lines: DataFrame, similarity: float) -> DataFrame:
    """(d, l): the later line of each pair whose sets are alike."""
    both = pairs.join(_sided(lines, "a"), ["ad", "al"]).join(_sided(lines, "b"), ["bd", "bl"])
    sets = both.select("bd", "bl", _hashes(F.col("aline")).alias("aset"), _hashes(F.col("bline")).alias("bset"))
    shared = F.size(F.array_intersect("aset", "bset"))
    alike = shared >= (F.size("aset") + F.size("bset") - shared) * F.lit(similarity) - 1e-9
    return saved(sets.where(alike).select(F.col("bd").alias("d"), F.col("bl").alias("l")).distinct())


def _matched(docs: DataFrame, pairs: DataFrame, similarity: float, limit: int) -> DataFrame:
    """(d, l): later lines of saved pairs that match. Each is tried with its earliest partner, and
    only what that leaves open with the others."""
    places = pairs.select(F.col("ad").alias("d"), F.col("al").alias("l")).union(pairs.select("bd", "bl")).distinct()
    lines, path = written(_lines(docs, places, limit))
    earliest = pairs.groupBy("bd", "bl").agg(F.min(F.struct("ad", "al")).alias("a")).select(F.col("a.ad").alias("ad"), F.col("a.al").alias("al"), "bd", "bl")
    found = _verified(earliest, lines, similarity)
    rest = pairs.join(found.select(F.col("d").alias("bd"), F.col("l").alias("bl")), ["bd", "bl"], "left_anti").join(earliest, ["ad", "al", "bd", "bl"], "left_anti")
    more = _verified(rest, lines, similarity)
    dropped(docs.sparkSession, path)
    return found.union(more)


def matched_later(docs: DataFrame, classes: DataFrame, *, similarity: float, limit: int) -> DataFrame:
    """(d, l): first places of saved sets that match a set with an earlier first place.

    One match is enough. In crowds of alike sets nearly all match one of the earliest, which takes
    as many comparisons as there are sets; where crowds are dense, that comes first, and what it
    leaves open is joined with all sets.
    """
    found, marked = None, classes.withColumn("open", F.lit(True))
    members = _crowds(classes, limit)
    if members is not None:
        found = _thinned(docs, members, similarity, limit)
        many = found.count()
        known = _sent_out(found.select("d", "l", F.lit(False).alias("open")), many, limit)
        marked = classes.join(known, ["d", "l"], "left").withColumn("open", F.coalesce("open", F.lit(True)))
        # Without a broadcast the classes would be shuffled for each part and side of the join.
        marked = marked if many <= limit else saved(marked)
        del members, known
    candidates = saved(_candidates(marked, similarity))
    more = _matched(docs, saved(_likely(candidates, classes, similarity)), similarity, limit)
    return more if found is None else found.union(more)


def dedup_lines(docs: DataFrame, *, similarity: float = 0.8, broadcast_lines: int = 2_000_000) -> DataFrame:
    """Replaces text by its kept lines; adds n_lines and n_removed.

    A line (parted by newlines) is removed if its words' set has a Jaccard similarity of at
    least ``similarity`` with that of a line that comes before it by (doc_id, place in the
    text), whether or not that one is kept. Words are lower-case and parted by white space (see
    ``_spaced``). Blank lines stay. A null text stays null and has no lines; an empty one has
    one. Rows without an id pass unchanged; rows with equal ids are taken for one document.
    Other columns pass through. Places of lines are broadcast to the texts while they number at
    most ``broadcast_lines`` (some 16 bytes each), and joined by a shuffle beyond that.
    """
    kept_columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    whole = docs.select(*[F.col(f"`{c}`") for c in kept_columns])
    named = whole.where(F.col("doc_id").isNotNull())
    texts = named.where(F.col("text").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"))
    source = texts.select("doc_id", F.lower(_spaced(F.col("text"))).alias("__girasol_text"))
    classes, path = written(_classes(source, rarity(source), similarity))
    later = matched_later(texts, classes, similarity=similarity, limit=broadcast_lines)
    kept = classes.select("d", "l").join(later, ["d", "l"], "left_anti")
    kept = saved(kept.groupBy(F.col("d").alias("doc_id")).agg(F.collect_set("l").alias("__girasol_kept")))
    del classes, later
    dropped(docs.sparkSession, path)
    release(docs.sparkSession)
    lines = kept.agg(F.sum(F.size("__girasol_kept"))).first()[0] or 0
    kept = _sent_out(kept, lines, broadcast_lines)
    nameless = whole.where(F.col("doc_id").isNull()).withColumn("__girasol_kept", F.lit(None).cast("array<int>"))
    text = F.col("text").cast("string")
    parted = named.join(kept, "doc_id", "left").unionByName(nameless).withColumn("__girasol_lines", F.split(text, "\n"))
    every = F.sequence(F.lit(0), F.size("__girasol_lines") - 1)
    white = f"[ {WHITE[1:]}"
    # Only lines that begin with white space are looked at whole.
    is_blank = lambda x: (x == "") | (F.substring(x, 1, 1).rlike(white) & x.rlike(f"^{white}*$"))
    blank = F.filter(F.transform("__girasol_lines", lambda x, i: F.when(is_blank(x), i)), lambda i: i.isNotNull())
    stay = F.sort_array(F.concat(F.coalesce("__girasol_kept", F.expr("cast(array() as array<int>)")), blank))
    out = parted.withColumn("__girasol_stay", F.when(F.col("text").isNull(), F.lit(None)).when(F.col("doc_id").isNull(), every).otherwise(stay))
    text = F.array_join(F.transform("__girasol_stay", lambda i: F.get("__girasol_lines", i)), "\n")
    return out.select(
        *[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in kept_columns],
        F.when(F.col("text").isNull(), 0).otherwise(F.size("__girasol_lines")).cast("long").alias("n_lines"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size("__girasol_lines") - F.size("__girasol_stay")).cast("long").alias("n_removed"),
    )
