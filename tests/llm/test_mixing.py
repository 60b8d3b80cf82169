"""The source mix against a plain loop, and its odd rows."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import pytest

from girasol.llm import mixing

SCHEMA = "doc_id long, source string, text string, size string, at int, taken int, part int"


def brute_mix(rows, weights=(5, 2, 1), share=1.5, most=2):
    """(doc_id, size, source_size, target, taken), a loop over each source's documents."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by = defaultdict(list)
    for i, s, t in rows:
        by[s].append((i, size(t)))
    order = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + ([None] if None in by else [])
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total = {s: sum(n for _, n in by[s]) for s in order}
    target, left, open_ = {}, share * sum(total.values()), set(order)
    while open_:
        each = left / sum(w[s] for s in open_)
        full = {s for s in open_ if most * total[s] <= w[s] * each}
        if not full:
            target |= {s: w[s] * each for s in open_}
            break
        for s in full:
            target[s] = float(most * total[s])
            left -= target[s]
        open_ -= full
    out = []
    for s in order:
        epochs, rest = divmod(int(target[s]), total[s]) if total[s] else (0, 0)
        key = lambda d: (int(hashlib.md5(f"13:{d[0]}".encode() if d[0] is not None else b"13").hexdigest()[:15], 16), d[0] or 0, d[1])
        for i, n in sorted(by[s], key=key):
            more = max(0, min(n, rest))
            rest -= more
            out.append((i, n, total[s], round(target[s], 6), epochs * n + more))
    return out


def mixed(spark, rows, **conf):
    df = spark.createDataFrame([(*r, "clash", 1, 2, 3) for r in rows], SCHEMA).repartition(5)
    return mixing.mix_documents(df, keep=["doc_id", "source", "text", "at", "part"], **conf).collect()


def held(rows):
    return Counter((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in rows)


def words(n):
    return " ".join(["w"] * n)


ROWS = (
    [(i, "hot", words(i % 90)) for i in range(300)] + [(1000 + i, "b", words(3 + i % 5)) for i in range(40)] + [(2000 + i, "\U0001f600", words(7)) for i in range(60)]
    + [(3000 + i, "￮", " \t\n") for i in range(5)] + [(4000, "one", words(5000)), (4001, "", None), (4002, "", "x y z"), (None, None, words(30)), (None, None, words(31)), (4003, None, "")]
)


@pytest.mark.parametrize("rows_per_range", [65_536, 3])
def test_the_mix_equals_a_loop(spark, rows_per_range):
    got = mixed(spark, ROWS, rows_per_range=rows_per_range)
    assert held(got) == Counter(brute_mix(ROWS))
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert all(taken[r.source] == int(r.target) for r in got)
    assert sum(taken.values()) == pytest.approx(1.5 * sum(r["size"] for r in got), abs=6)


def test_a_document_that_is_a_third_of_all_rows(spark):
    rows = [(7, "a", words(10))] * 200 + [(i, "a", words(4)) for i in range(100, 300)] + [(i, "b", words(9)) for i in range(300, 500)] + [(500, None, words(2))]
    got = mixed(spark, rows)
    assert held(got) == Counter(brute_mix(rows))
    # The budget of a source of copies alone ends among them.
    rows = [(7, "a", words(10))] * 30 + [(8, "b", words(100))] * 3
    got = mixed(spark, rows)
    assert held(got) == Counter(brute_mix(rows)) and sum(r.is_cut for r in got) <= 2
    assert sum(r.taken for r in got if r.source == "b") == int(next(r.target for r in got if r.source == "b"))


def test_many_sources_in_turn(spark):
    rows = [(i, f"s{i % 97:03d}", words(1 + (i * 7) % 50)) for i in range(900)]
    assert held(mixed(spark, rows)) == Counter(brute_mix(rows))
    assert held(mixed(spark, rows, weights=(1,), share=1.0, most=1)) == Counter(brute_mix(rows, (1,), 1.0, 1))


def test_reruns_agree_and_no_rows_give_none(spark):
    once = held(mixed(spark, ROWS))
    df = spark.createDataFrame([(*r, "", 1, 2, 3) for r in ROWS[::-1]], SCHEMA).repartition(11)
    assert held(mixing.mix_documents(df).collect()) == once
    assert mixed(spark, []) == []
    assert held(mixed(spark, [(1, "a", None), (2, None, "")])) == Counter([(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)])


def test_texts_are_repeated_and_cut(spark):
    rows = [(i, "ab"[i % 2], " ".join(f"w{k}" for k in range(1 + i % 7))) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    mix = mixing.mix_documents(df, keep=["doc_id", "source", "text"])
    got = Counter()
    for r in mixing.mixed_texts(mix).collect():
        assert r.text == " ".join(f"w{k}" for k in range(len(r.text.split())))
        got[r.doc_id] += len(r.text.split())
    assert got == Counter({r.doc_id: r.taken for r in mix.collect() if r.taken})
