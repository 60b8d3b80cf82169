"""Windows of a byte-level tokenizer's ids that are decoded and encoded again."""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REASONS = ("special_id_in_window", "blank", "roundtrip_fail", "ok")


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str):  # noqa: ANN201
    """The tokenizer of a file of ranks, once a process; its one special token ends a document."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={"<|end|>": len(ranks)})


def reasons(enc, windows: list[list[int]]) -> list[str]:  # noqa: ANN001
    """The first that holds for each window: a special id in it, fewer than three characters, other ids
    when encoded again (as where it cuts a character or a merge), or none of these."""
    end = enc.max_token_value
    return [_reason(enc, w, end) for w in windows]


def _reason(enc, w: list[int], end: int) -> str:  # noqa: ANN001
    if end in w:
        return REASONS[0]
    text = enc.decode_bytes(w).decode("utf-8", "replace")
    return REASONS[1] if len(text.strip()) < 3 else REASONS[2] if enc.encode_ordinary(text) != w else REASONS[3]


def round_trips(docs: DataFrame, key: str, text: Column, path: str, pattern: str, *, size: int = 16, chars: int = 1 << 20) -> DataFrame:
    """(key, window, n_ids, reason) of consecutive windows of ``size`` ids, the last one shorter, of a text's ids
    and the special one that ends it. A null text has none. Texts are taken some million characters at a time."""

    @F.pandas_udf("array<struct<n_ids: int, reason: string>>")
    def trips(texts: pd.Series) -> pd.Series:
        enc, out, held, waiting = encoding(path, pattern), [], 0, []

        def done() -> None:
            ids = [e + [enc.max_token_value] for e in enc.encode_ordinary_batch(waiting, num_threads=1)]
            windows = [[v[i : i + size] for i in range(0, len(v), size)] for v in ids]
            found = iter(reasons(enc, [w for ws in windows for w in ws]))
            out.extend([{"n_ids": len(w), "reason": next(found)} for w in ws] for ws in windows)
            waiting.clear()

        for t in texts:
            if t is None:
                done()
                out.append(None)
                held = 0
                continue
            waiting.append(t)
            held += len(t)
            if held >= chars:
                done()
                held = 0
        done()
        return pd.Series(out, dtype=object)

    found = docs.select(F.col(key), trips(text.cast("string")).alias("w"))
    return found.select(key, F.posexplode("w").alias("window", "r")).select(key, "window", "r.n_ids", "r.reason")
