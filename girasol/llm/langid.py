"""Language identification by a byte convolutional network.

Bytes are embedded, filters of several widths run over fixed-length windows, each
filter is max-pooled over its window, and a softmax layer reads the pooled values.
Training is plain numpy (Adam) on a bounded sample of labelled windows. Applying the
network covers every window of a whole text; a document's language is the one with
the greatest mean probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import is_held_out, text_slices

UNKNOWN = "und"


@dataclass(frozen=True)
class Network:
    """embed [256, e]; filters: per width w an array [w * e, k]; a softmax layer."""

    languages: tuple[str, ...]
    window: int
    widths: tuple[int, ...]
    embed: np.ndarray
    filters: tuple[np.ndarray, ...]
    biases: tuple[np.ndarray, ...]
    out: np.ndarray
    out_bias: np.ndarray

    def _columns(self, windows: np.ndarray) -> np.ndarray:
        """The widest filter's inputs at each position: [n, positions, widest * e]."""
        e = self.embed.shape[1]
        x = self.embed[np.pad(windows, ((0, 0), (0, max(self.widths) - 1)))].reshape(len(windows), -1)
        view = np.lib.stride_tricks.sliding_window_view(x, max(self.widths) * e, axis=1)
        return view[:, ::e]

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        """Rectified maxima of all filters; narrow filters are padded with zeros, so one
        matrix product serves all widths."""
        wide = max(self.widths) * self.embed.shape[1]
        bank = np.concatenate([np.pad(f, ((0, wide - len(f)), (0, 0))) for f in self.filters], 1)
        cols = np.ascontiguousarray(self._columns(windows))
        n, p, _ = cols.shape
        hit = (cols.reshape(n * p, wide) @ bank).reshape(n, p, -1).max(1)
        return np.maximum(hit + np.concatenate(self.biases), 0)

    def probabilities(self, windows: np.ndarray, chunk: int = 256) -> np.ndarray:
        parts = [softmax(self.pooled(windows[i : i + chunk]) @ self.out + self.out_bias) for i in range(0, len(windows), chunk)]
        return np.concatenate(parts) if parts else np.zeros((0, len(self.languages)), np.float32)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def cut_windows(texts: list[str], window: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts as rows of ``window`` bytes, and the text each row belongs to. The last
    row of a text is filled up with zeros; an empty text has none."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    sizes = np.array([len(x) for x in raw], np.int64)
    rows = -(-sizes // window)
    owner = np.repeat(np.arange(len(raw)), rows)
    flat = np.zeros(int(rows.sum()) * window, np.uint8)
    source = np.frombuffer(b"".join(raw), np.uint8)
    at = np.concatenate([[0], np.cumsum(rows)])[:-1] * window
    shift = np.repeat(at - (np.cumsum(sizes) - sizes), sizes)
    flat[np.arange(len(source)) + shift] = source
    return flat.reshape(-1, window), owner


def fit(windows: np.ndarray, y: np.ndarray, languages: tuple[str, ...], *, widths: tuple[int, ...] = (2, 3, 4),
        filters: int = 8, embed: int = 8, epochs: int = 6, batch: int = 128, rate: float = 0.01, seed: int = 7) -> Network:
    """Train with Adam on windows [n, window] and language numbers y."""
    rng = np.random.default_rng(seed)
    window, n_lang = windows.shape[1] if windows.ndim == 2 else 128, len(languages)
    p: dict[str, np.ndarray] = {"embed": rng.normal(0, 0.3, (256, embed))}
    for w in widths:
        p[f"f{w}"] = rng.normal(0, 1 / np.sqrt(w * embed), (w * embed, filters))
        p[f"b{w}"] = np.zeros(filters)
    p["out"] = rng.normal(0, 0.1, (len(widths) * filters, n_lang))
    p["out_bias"] = np.zeros(n_lang)
    p = {k: v.astype(np.float32) for k, v in p.items()}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}

    def network() -> Network:
        return Network(languages, window, widths, p["embed"], tuple(p[f"f{w}"] for w in widths),
                       tuple(p[f"b{w}"] for w in widths), p["out"], p["out_bias"])

    step, wide, offset = 0, max(widths) * embed, np.arange(max(widths))
    for _ in range(epochs if n_lang > 1 else 0):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            x = windows[rows].copy()
            # Crops of any length, so that short texts and last windows are known too.
            length = rng.integers(8, window + 1, len(rows))
            x[np.arange(window)[None, :] >= np.where(rng.random(len(rows)) < 0.5, length, window)[:, None]] = 0
            net, n = network(), len(rows)
            cols = np.ascontiguousarray(net._columns(x))
            pooled, arg = [], []
            for w in widths:
                hit = cols[:, :, : w * embed].reshape(-1, w * embed) @ p[f"f{w}"]
                hit = hit.reshape(n, -1, filters) + p[f"b{w}"]
                arg.append(hit.argmax(1))
                pooled.append(hit.max(1))
            h = np.concatenate(pooled, 1)
            live = h > 0
            h = h * live
            d = softmax(h @ p["out"] + p["out_bias"])
            d[np.arange(n), y[rows]] -= 1
            d /= n
            grad = {"out": h.T @ d, "out_bias": d.sum(0), "embed": np.zeros_like(p["embed"])}
            back = (d @ p["out"].T) * live
            padded = np.pad(x, ((0, 0), (0, len(offset) - 1)))
            for i, w in enumerate(widths):
                g = back[:, i * filters : (i + 1) * filters]
                hit_cols = cols[np.arange(n)[:, None], arg[i]][:, :, : w * embed]
                grad[f"f{w}"] = np.einsum("nk,nkd->dk", g, hit_cols)
                grad[f"b{w}"] = g.sum(0)
                into = np.einsum("nk,dk->nkd", g, p[f"f{w}"]).reshape(-1, embed)
                bytes_hit = padded[np.arange(n)[:, None, None], arg[i][:, :, None] + np.arange(w)]
                np.add.at(grad["embed"], bytes_hit.ravel(), into)
            step += 1
            pace = rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, v in p.items():
                m, s = moments[k]
                m *= 0.9
                m += 0.1 * grad[k]
                s *= 0.999
                s += 0.001 * grad[k] ** 2
                v -= (pace * m / (np.sqrt(s) + 1e-7)).astype(np.float32)
    return network()


def train(docs: DataFrame, *, per_language: int = 500, windows_a_text: int = 6, window: int = 128, **options) -> Network:
    """Fit on at most ``per_language`` texts of each language, none held out, and on
    ``windows_a_text`` evenly spread windows of each: that many bytes reach the driver.

    Rows with a null text, language or id teach nothing, rows that repeat an id once; without any,
    every prediction is the one language ``und``.
    """
    known = docs.where(
        F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~is_held_out(F.col("doc_id"))
    )
    # Of a common language only about four times the sample is sorted: those with low hashes.
    # That filter is part of the scan: the languages' sizes are few rows and go to every task.
    hashed = known.select("doc_id", "lang", F.xxhash64("doc_id").alias("_h"))
    # A size within some hundredths will do, as four times the sample passes; ids count, not rows.
    sizes = F.broadcast(known.groupBy("lang").agg(F.approx_count_distinct("doc_id", 0.02).alias("_size")))
    low = F.pmod("_h", F.lit(1 << 20)) * F.col("_size") < F.lit(4 * per_language * (1 << 20))
    order = Window.partitionBy("lang").orderBy(F.pmod("_h", F.lit(1 << 20)), "_h", "doc_id")
    picked = hashed.join(sizes, "lang").where(low).distinct().withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_language)
    chosen = known.select("doc_id", F.col("lang").alias("_lang"), F.col("text").cast("string").alias("__girasol_text")).join(
        F.broadcast(picked.select("doc_id", F.col("lang").alias("_lang"))), ["doc_id", "_lang"]
    )
    # Of rows that repeat an id in a language one text counts.
    chosen = chosen.groupBy("doc_id", "_lang").agg(F.min("__girasol_text").alias("__girasol_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, 4 << 20, "__girasol_text"):
            rows, owner = cut_windows(texts, window)
            first = np.searchsorted(owner, np.arange(len(texts)))
            count = np.bincount(owner, minlength=len(texts))
            keep = [first[i] + j for i in range(len(texts)) for j in sorted({k * count[i] // windows_a_text for k in range(windows_a_text)} if count[i] else ())]
            own = pa.array(owner[keep].astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(own), part.column("_lang").take(own), pa.array([rows[i].tobytes() for i in keep], pa.binary())],
                names=["doc_id", "_lang", "_window"],
            )

    schema = docs.select("doc_id", F.col("lang").alias("_lang")).schema.add("_window", "binary")
    got = chosen.mapInArrow(run, schema).toArrow().to_pydict()
    rows = sorted(zip(got["doc_id"], got["_lang"], got["_window"]))
    languages = tuple(sorted({r[1] for r in rows})) or (UNKNOWN,)
    x = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(-1, window)
    return fit(x, np.array([languages.index(r[1]) for r in rows], np.int64), languages, **options)


def identify(docs: DataFrame, network: Network, *, keep: list[str] | None = None, slice_bytes: int = 1 << 20) -> DataFrame:
    """Adds lang_pred and score (0 to 1: mean probability over all windows) to every row.

    ``und`` with score 0 where the text is null or has no letter. Columns named
    lang_pred or score are replaced; others pass through.
    """
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")] if keep is None else keep
    source = docs.select(
        *[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias("__girasol_text"),
        F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False)).alias("__girasol_letters"),
    )
    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema.add("lang_pred", "string").add("score", "double")
    n_lang = len(network.languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, slice_bytes, "__girasol_text"):
            letters = part.column("__girasol_letters").to_numpy(zero_copy_only=False).astype(bool)
            rows, owner = cut_windows([t if ok else "" for t, ok in zip(texts, letters)], network.window)
            prob = network.probabilities(rows).astype(np.float64)
            total = np.stack([np.bincount(owner, prob[:, i], len(texts)) for i in range(n_lang)], 1)
            mean = total / np.maximum(np.bincount(owner, minlength=len(texts)), 1)[:, None]
            best = mean.argmax(1)
            names = [network.languages[i] if ok else UNKNOWN for i, ok in zip(best.tolist(), letters)]
            score = np.where(letters, np.clip(mean[np.arange(len(texts)), best], 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in keep), pa.array(names, pa.string()), pa.array(score)], names=[*keep, "lang_pred", "score"]
            )

    return source.mapInArrow(run, schema)
