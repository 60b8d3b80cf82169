"""Toxicity by cumulative-link ordinal regression.

P(grade <= k) is the logistic of threshold k less a weighted sum of sparse text
features, one weight vector for all thresholds. The labels are binary, so grades above
0 are set within the training sample: a toxic text's grade is 1, 2 or 3 by how many
different indicative words (words much commoner in toxic texts of the sample) it has. So
the label says whether a text is above 0; the steps above that order texts by how much
of what makes them toxic they have, and carry no labelled meaning.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import is_held_out, text_slices
from .components import saved

GRADES = 4
_WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> tuple[str, ...]:
    """A word is itself and its beginnings of four and five letters."""
    return (word, word[:4] + "~", word[:5] + "~") if len(word) > 5 else (word,)


def features(text: str) -> Counter:
    """Features of the different lower-case words of the whole text, with counts."""
    return Counter(f for w in set(_WORD.findall(text.lower())) for f in word_features(w))


@dataclass(frozen=True)
class Model:
    """Word -> weight, shared by the ordered thresholds."""

    weights: dict[str, float]
    thresholds: np.ndarray

    def latent(self, text: str, cache: dict[str, float]) -> float:
        """``cache`` keeps the weight of words already seen."""
        total = 0.0
        for w in set(_WORD.findall(text.lower())):
            if (x := cache.get(w)) is None:
                x = cache[w] = sum(self.weights.get(f, 0.0) for f in word_features(w))
            total += x
        return total

    def probabilities(self, latent: np.ndarray) -> np.ndarray:
        """[n, grades]"""
        below = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - latent[:, None], -30, 30)))
        edges = np.concatenate([np.zeros((len(latent), 1)), below, np.ones((len(latent), 1))], 1)
        return np.diff(edges, axis=1)


@dataclass(frozen=True)
class Vocabulary:
    """Features that tell the labels apart, numbered, and those that are indicative of toxicity."""

    numbers: dict[str, int]
    marks: frozenset[str]

    @staticmethod
    def of(counts: list[tuple[str, int, int]], n0: int, n1: int, *, size: int, least: float = 2.0, support: int = 3) -> Vocabulary:
        """From (feature, texts of label 0 and of label 1 that have it): the ``size`` features of the
        greatest G statistic. Indicative are those in at least ``support`` toxic texts and much
        commoner there, by ``least`` in the logarithm."""

        def strength(a: int, b: int) -> float:
            p, q, r = (a + 0.5) / (n1 + 1), (b + 0.5) / (n0 + 1), (a + b + 0.5) / (n0 + n1 + 1)
            return n1 * (p * np.log(p / r) + (1 - p) * np.log((1 - p) / (1 - r))) + n0 * (q * np.log(q / r) + (1 - q) * np.log((1 - q) / (1 - r)))

        ranked = sorted(((strength(a, b), f, a, b) for f, b, a in counts if a + b >= 3), key=lambda x: (-x[0], x[1]))
        best = [x for x in ranked[:size] if x[0] >= 4.0]
        marks = {f for _, f, a, b in best if a >= support and np.log((a + 0.5) / n1) - np.log((b + 0.5) / n0) >= least}
        return Vocabulary({f: i for i, (_, f, _, _) in enumerate(best)}, frozenset(marks))

    def encode(self, text: str) -> tuple[list[int], int]:
        """The numbers of the text's features, one for each word that has it, and how many of its different words are indicative."""
        found, hits = [], 0
        for w in sorted(set(_WORD.findall(text.lower()))):
            own = word_features(w)
            found += [self.numbers[f] for f in own if f in self.numbers]
            hits += any(f in self.marks for f in own)
        return found, hits


def grades(hits: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """0 for texts that are not toxic; 1, 2 or 3 for up to 1, 2 to 3 or more different indicative words."""
    return np.where(toxic == 1, 1 + (hits >= 2) + (hits >= 4), 0)


def fit(texts: list[str], toxic: np.ndarray, *, vocabulary: int = 2000, **options) -> Model:
    """Fit on texts at hand."""
    counts = [Counter(), Counter()]
    for t, label in zip(texts, toxic.tolist()):
        counts[label].update(features(t).keys())
    n0, n1 = int((toxic == 0).sum()), int((toxic == 1).sum())
    words = Vocabulary.of([(f, counts[0][f], counts[1][f]) for f in counts[0] | counts[1]], max(n0, 1), max(n1, 1), size=vocabulary)
    return fit_encoded(words, [words.encode(t) for t in texts], toxic, **options)


def fit_encoded(words: Vocabulary, encoded: list[tuple[list[int], int]], toxic: np.ndarray, *, l2: float = 1e-3, steps: int = 400, rate: float = 0.05) -> Model:
    """Full-batch Adam on the ordinal likelihood; without both labels no word has weight."""
    if len(set(toxic.tolist())) < 2:
        return Model({}, np.array([3.0, 4.0, 5.0]) if not toxic.any() else np.array([-3.0, 4.0, 5.0]))
    vocab = words.numbers
    y = grades(np.array([h for _, h in encoded]), toxic)
    rows = np.repeat(np.arange(len(encoded)), [len(f) for f, _ in encoded])
    cols = np.array([i for f, _ in encoded for i in f], np.int64)
    vals = np.ones(len(cols))
    k = np.arange(GRADES - 1)
    share = [(y <= j).mean() for j in k]
    start = np.log(np.clip(share, 1e-3, 1 - 1e-3) / (1 - np.clip(share, 1e-3, 1 - 1e-3)))
    # Thresholds stay ordered: the first, then logs of the gaps.
    p = np.concatenate([np.zeros(len(vocab)), start[:1], np.log(np.maximum(np.diff(start), 0.05))])
    m, s = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        w, theta = p[: len(vocab)], np.cumsum(np.concatenate([p[len(vocab) : len(vocab) + 1], np.exp(p[len(vocab) + 1 :])]))
        z = np.bincount(rows, w[cols] * vals, len(y))
        edge = np.concatenate([[-40.0], theta, [40.0]])
        hi, lo = (1 / (1 + np.exp(-np.clip(edge[y + d] - z, -40, 40))) for d in (1, 0))
        like = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi) / like, lo * (1 - lo) / like
        dz = (dhi - dlo) / len(y)
        dtheta = np.array([(dlo[y == j + 1]).sum() - (dhi[y == j]).sum() for j in k]) / len(y)
        tail = np.cumsum(dtheta[::-1])[::-1]
        grad = np.concatenate([np.bincount(cols, dz[rows] * vals, len(vocab)) + l2 * w, tail[:1], tail[1:] * np.exp(p[len(vocab) + 1 :])])
        m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad**2
        p = p - rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    theta = np.cumsum(np.concatenate([p[len(vocab) : len(vocab) + 1], np.exp(p[len(vocab) + 1 :])]))
    return Model({w: float(p[i]) for w, i in vocab.items()}, theta)


def train(docs: DataFrame, labels: DataFrame, *, sample: int = 2000, vocabulary: int = 2000, **options) -> Model:
    """Fit on at most ``sample`` labelled texts of each class (those with the least hash of
    the id, none held out; an id that is repeated counts once).

    Features are counted in the tasks; the driver gets ``vocabulary`` of them, and of each text
    the numbers of those that it has, so its memory does not depend on how long texts are.
    """
    own = labels.select("doc_id", F.col("toxic").cast("int").alias("_y")).where(
        F.col("_y").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id"))
    )
    picked = None
    for y in (0, 1):
        part = own.where(F.col("_y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        picked = part if picked is None else picked.unionByName(part)
    chosen = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__girasol_text")).join(F.broadcast(picked), "doc_id")
    chosen = saved(chosen.groupBy("doc_id").agg(F.min(F.struct("_y", "__girasol_text")).alias("_one")).select("doc_id", "_one.*"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, 1 << 20, "__girasol_text"):
            found = [sorted(features(t)) for t in texts]
            of = np.repeat(np.arange(len(texts)), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([part.column("_y").take(pa.array(of)), pa.array([f for x in found for f in x], pa.string())], names=["_y", "feature"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, 1 << 20, "__girasol_text"):
            numbers, hits = zip(*[words.encode(t) for t in texts])
            columns = [pa.array(list(numbers), pa.list_(pa.int32())), pa.array(hits, pa.int32())]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("_y"), *columns], names=["doc_id", "_y", "numbers", "hits"])

    n0, n1 = chosen.agg(F.count_if(F.col("_y") == 0), F.count_if(F.col("_y") == 1)).first()
    counted = chosen.select("_y", "__girasol_text").mapInArrow(each, "_y int, feature string").groupBy("feature").agg(F.count_if(F.col("_y") == 0).alias("b"), F.count_if(F.col("_y") == 1).alias("a"))
    # In the order of a normal approximation of the G statistic; four times as many as are kept.
    gap = F.abs(F.col("a") / max(n1, 1) - F.col("b") / max(n0, 1)) / F.sqrt((F.col("a") + F.col("b") + 1.0) / (n0 + n1 + 1))
    likely = counted.where("a + b >= 3").orderBy(F.desc(gap), "feature").limit(4 * vocabulary)
    words = Vocabulary.of([tuple(r) for r in likely.select("feature", "b", "a").collect()], max(n0, 1), max(n1, 1), size=vocabulary)
    kind = chosen.select("doc_id", "_y").schema.add("numbers", T.ArrayType(T.IntegerType())).add("hits", "integer")
    got = chosen.mapInArrow(encode, kind).toArrow().sort_by([("doc_id", "ascending")]).to_pydict()
    return fit_encoded(words, list(zip(got["numbers"], got["hits"])), np.array(got["_y"], np.int64), **options)


def score_documents(docs: DataFrame, model: Model, *, keep: list[str] | None = None, threshold: float = 0.5,
                    slice_bytes: int = 4 << 20) -> DataFrame:
    """Adds severity (expected grade, 0 to 3), grade (the likeliest), toxic_score
    (probability of any grade above 0) and is_toxic to every row.

    A null or empty text has no features: its scores are those of the thresholds alone.
    Clashing columns are replaced; others pass through.
    """
    added = ("severity", "grade", "toxic_score", "is_toxic")
    keep = [c for c in docs.columns if c not in added] if keep is None else keep
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias("__girasol_text"))
    schema = source.drop("__girasol_text").schema.add("severity", "double").add("grade", "integer").add("toxic_score", "double").add("is_toxic", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        for part, texts in text_slices(batches, slice_bytes, "__girasol_text"):
            if len(cache) > 500_000:
                cache = {}
            prob = model.probabilities(np.array([model.latent(t, cache) for t in texts], np.float64))
            any_grade = 1 - prob[:, 0]
            columns = [pa.array(prob @ np.arange(GRADES)), pa.array(prob.argmax(1).astype(np.int32)), pa.array(any_grade), pa.array(any_grade >= threshold)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *columns], names=[*keep, *added])

    return source.mapInArrow(run, schema)
