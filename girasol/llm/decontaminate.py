"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Fixed masks select some of the words in a window and ignore the others, so a replaced
word spoils only the windows in which a mask selects it. Hashes of both sides are
joined; each hit fixes a diagonal, along which the words around it are compared.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 1: the word counts; 0: it is ignored. Wherever up to a fifth of 10 to 20 words are replaced,
#: one of the masks still has a place where it selects none of them.
MASKS = ("11111", "111011", "11010011")


def masks_for(length: int, similarity: float) -> tuple[str, ...]:
    """Masks of which one hits any passage of ``length`` words that has enough equal ones. Where
    MASKS don't serve: so many equal words must be neighbours, as the others part them."""
    need = max(math.ceil(length * similarity - 1e-9), 1)
    apart = length - need
    if 10 <= length <= 20 and apart <= length // 5:
        return MASKS
    return ("1" * -(-need // (apart + 1)),)


def word_hashes(text: Column) -> Column:
    """Hashes of the lower-case runs of letters and digits."""
    words = F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _seeds(words: str, at: Column, masks: dict[str, list[int]], length: Column | None = None) -> Column:
    """One hash for each mask of the words from ``at`` on; null where they end before it, and
    with ``length`` for masks that passages of that length do without."""
    out = []
    for mask, lengths in masks.items():
        picked = [F.get(F.col(words), at + F.lit(k)) for k, x in enumerate(mask) if x == "1"]
        fits = at + F.lit(len(mask)) <= F.size(words)
        out.append(F.when(fits if length is None else fits & length.isin(lengths), F.xxhash64(F.lit(mask), *picked)))
    return F.array(*out)


def _windows(rows: DataFrame, words: str, at: str, masks: dict[str, list[int]], length: Column | None = None) -> DataFrame:
    """A row for each place of a mask in the words: _mask (its number) and _seed."""
    least = min(map(len, masks))
    started = rows.where(F.size(words) >= least).withColumn(at, F.explode(F.sequence(F.lit(0), F.size(words) - least)))
    return started.select("*", F.posexplode(_seeds(words, F.col(at), masks, length)).alias("_mask", "_seed")).where("_seed IS NOT NULL")


def _best_window(doc: Column, item: Column, shift: Column, length: Column) -> Column:
    """Most equal words in ``length`` neighbouring places of the item, along a diagonal."""
    places = F.sequence(F.lit(0), F.size(item) - 1)
    equal = F.transform(
        places,
        lambda p: F.when((p + shift >= 0) & (p + shift < F.size(doc)) & (F.get(doc, p + shift) == F.get(item, p)), 1).otherwise(0),
    )

    def step(acc: Column, p: Column) -> Column:
        left = F.when(p >= length, F.get(acc["bits"], p - length)).otherwise(0)
        now = acc["now"] + F.get(acc["bits"], p) - left
        return F.struct(acc["bits"].alias("bits"), now.alias("now"), F.greatest(acc["best"], now).alias("best"))

    start = F.struct(equal.alias("bits"), F.lit(0).alias("now"), F.lit(0).alias("best"))
    return F.aggregate(places, start, step, lambda acc: acc["best"])


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    window: int = 20,
    similarity: float = 0.8,
    broadcast_rows: int = 2_000_000,
    max_item_words: int = 2_000,
) -> DataFrame:
    """(doc_id, item_id, doc_word, matched, compared, overlap): one row for each document and
    item that share a passage.

    A passage is ``window`` neighbouring words of the item (all of a shorter item) of which
    the share ``similarity`` or more are equal and in the same places in the text. Where
    several qualify, the row has the best (then the first) diagonal: doc_word is the place
    in the document of the item's first word, and may be negative if the item's start is
    missing. No such passage is missed (see ``masks_for``), so an item of one word is in each
    text that has it; null and empty texts have no words. Rows with equal ids count as one document.
    Items of equal words are looked for once.

    The benchmark's seeds are broadcast while they number at most ``broadcast_rows`` and no
    item is longer than ``max_item_words``; beyond that, seeds are shuffled and the words
    are joined back to the distinct diagonals.
    """
    listed = benchmark.where("item_id IS NOT NULL").select("item_id", word_hashes(F.col("text")).alias("_item"))
    listed = listed.withColumn("_class", F.xxhash64("_item"))
    items = listed.groupBy("_class", "_item").agg(F.count(F.lit(1)).alias("_n"))
    words = docs.select("doc_id", word_hashes(F.col("text")).alias("_doc"))
    length = F.least(F.size("_item"), F.lit(window))
    total, longest, lengths, ids = items.agg(
        F.coalesce(F.sum(F.size("_item")), F.lit(0)), F.coalesce(F.max(F.size("_item")), F.lit(0)), F.collect_set(length), F.coalesce(F.sum("_n"), F.lit(0))
    ).first()
    items = items.drop("_n")
    masks: dict[str, list[int]] = {}
    for n in sorted(lengths) if longest else [window]:
        for mask in masks_for(n, similarity) if n else ():
            masks.setdefault(mask, []).append(n)
    seeds = _windows(items, "_item", "_j", masks, length)
    small = total * len(masks) <= broadcast_rows and longest <= max_item_words
    own = _windows(words, "_doc", "_i", masks)
    if small:
        # Of hits that follow one another along a diagonal the first will do.
        before = F.when(F.col("_j") > 0, F.get(_seeds("_item", F.col("_j") - 1, masks), F.col("_mask"))).alias("_before")
        seeds = seeds.select("_seed", "_class", "_j", "_mask", before).distinct()
        follows = F.when(F.col("_i") > 0, F.get(_seeds("_doc", F.col("_i") - 1, masks), F.col("_mask")) == F.col("_before"))
        hits = own.drop("_mask").join(F.broadcast(seeds), "_seed").where(~F.coalesce(follows, F.lit(False))).join(F.broadcast(items), "_class")
    else:
        # Rows are told apart by their id, null or not, and a hash of their words.
        row = F.struct("doc_id", F.xxhash64("_doc").alias("h"), F.size("_doc").alias("n")).alias("_row")
        diagonals = own.select(row, "_i", "_seed").join(seeds.select("_seed", "_class", "_j").distinct(), "_seed")
        diagonals = diagonals.select("_row", "_class", (F.col("_i") - F.col("_j")).alias("_i"), F.lit(0).alias("_j")).distinct()
        texts = words.select(row, "_doc").dropDuplicates(["_row"])
        hits = diagonals.join(items, "_class").join(texts, "_row").withColumn("doc_id", F.col("_row.doc_id"))
    # A text's hits are held together, so that each has the words beside the item's and not the whole text.
    shift = F.col("_i") - F.col("_j")
    start = F.greatest(shift, F.lit(0))
    beside = F.slice("_doc", start + 1, F.greatest(F.least(F.size("_doc"), shift + F.size("_item")) - start, F.lit(0)))
    found = hits.select("doc_id", "_class", "_item", shift.alias("doc_word"), beside.alias("_beside")).select(
        "doc_id", "_class", "doc_word", length.alias("compared"),
        _best_window(F.col("_beside"), F.col("_item"), F.least(F.col("doc_word"), F.lit(0)), length).alias("matched"),
    ).where(F.col("matched") >= F.ceil(F.col("compared") * F.lit(similarity) - 1e-9))
    best = F.max(F.struct(F.col("matched"), (-F.col("doc_word")).alias("_at"), F.col("compared"))).alias("_best")
    found = found.groupBy("doc_id", "_class").agg(best).select("doc_id", "_class", "_best.matched", (-F.col("_best._at")).alias("doc_word"), "_best.compared")
    members = listed.select("_class", "item_id").distinct()
    found = found.join(F.broadcast(members) if ids <= broadcast_rows else members, "_class")
    return found.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", (-F.col("_best._at")).alias("doc_word"), F.col("_best.matched").alias("matched"),
        F.col("_best.compared").alias("compared"), (F.col("_best.matched") / F.col("_best.compared")).alias("overlap"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of documents that share no passage with the benchmark; rows without an id stay."""
    bad = find_contamination(docs, benchmark, **options).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(docs.columns)
