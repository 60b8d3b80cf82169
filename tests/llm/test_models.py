"""Models held against their plain formulas, and the rows that earlier versions lost."""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import functions as F

from girasol.llm import decontaminate, imatch, langid, ngramjoin, quality, toxicity


def test_a_window_by_a_plain_convolution():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 256, (60, 40)).astype(np.uint8)
    net = langid.fit(x, rng.integers(0, 3, 60), ("a", "b", "c"), epochs=1)
    got = net.probabilities(x[:4])
    for row, p in zip(x[:4], got):
        pooled = []
        for width, bank, bias in zip(net.widths, net.filters, net.biases):
            for k in range(bank.shape[1]):
                best = -math.inf
                # Every place of the window; beyond its end the bytes are 0.
                for at in range(len(row)):
                    taken = [int(row[at + j]) if at + j < len(row) else 0 for j in range(width)]
                    best = max(best, sum(float(net.embed[b] @ bank[j * net.embed.shape[1] : (j + 1) * net.embed.shape[1], k]) for j, b in enumerate(taken)))
                pooled.append(max(best + float(bias[k]), 0.0))
        logits = [sum(h * float(net.out[i, c]) for i, h in enumerate(pooled)) + float(net.out_bias[c]) for c in range(3)]
        e = [math.exp(v - max(logits)) for v in logits]
        assert np.allclose(p, np.array(e) / sum(e), atol=1e-4)


def test_quality_scores_by_determinants_and_solves():
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(0, 1, (300, 4)) @ rng.normal(size=(4, 4)), rng.normal(1, 2, (200, 4))])
    y = np.array([1] * 300 + [0] * 200)
    shrink, ridge = 0.1, 0.05
    model = quality.fit(x, y, shrink, ridge)
    z = np.clip((x - x.mean(0)) / (x.std(0) + 1e-6), -8, 8)
    parts = [z[y == k] for k in (0, 1)]
    covs = [np.cov(p.T, bias=True) for p in parts]
    pooled = sum(len(p) * c for p, c in zip(parts, covs)) / len(z)
    density = []
    for p, own in zip(parts, covs):
        cov = (1 - ridge) * ((1 - shrink) * own + shrink * pooled) + ridge * np.diag(np.diag(pooled)) + 1e-6 * np.eye(4)
        gone = z - p.mean(0)
        density.append(-0.5 * (gone * np.linalg.solve(cov, gone.T).T).sum(1) - 0.5 * np.linalg.slogdet(cov)[1])
    margin = (density[1] - density[0]) / 4
    assert np.allclose(model.margin(x), margin, atol=1e-9)
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-np.clip(model.slope * margin + model.offset, -30, 30))))


def test_toxicity_is_at_the_top_of_its_likelihood():
    rng = random.Random(2)
    clean = [" ".join(rng.choices([f"w{i}" for i in range(60)], k=20)) for _ in range(150)]
    rude = [f"{t} {' '.join(rng.sample(['scum', 'trash', 'moron', 'loser', 'idiot'], rng.randint(1, 5)))}" for t in clean[:70]]
    texts, toxic = clean + rude, np.array([0] * 150 + [1] * 70)
    model = toxicity.fit(texts, toxic, vocabulary=40, steps=1500)
    latent = np.array([model.latent(t, {}) for t in texts])
    plain = [sum(model.weights.get(f, 0.0) for w in {*toxicity._WORD.findall(t.lower())} for f in toxicity.word_features(w)) for t in texts]
    assert np.allclose(latent, plain)
    sigmoid = lambda v: 1 / (1 + math.exp(-max(-30.0, min(30.0, v))))
    prob = model.probabilities(latent)
    for p, z in zip(prob[::17], latent[::17]):
        below = [0.0, *(sigmoid(t - z) for t in model.thresholds), 1.0]
        assert np.allclose(p, np.diff(below))
    # A like shift of all weights' sum, or of a threshold, does not raise the plain likelihood.
    counts = [{}, {}]
    for t, label in zip(texts, toxic.tolist()):
        for f in toxicity.features(t):
            counts[label][f] = counts[label].get(f, 0) + 1
    words = toxicity.Vocabulary.of([(f, counts[0].get(f, 0), counts[1].get(f, 0)) for f in counts[0] | counts[1]], 150, 70, size=40)
    grade = toxicity.grades(np.array([words.encode(t)[1] for t in texts]), toxic)

    def loss(latent, thresholds):
        below = [[0.0, *(sigmoid(t - z) for t in thresholds), 1.0] for z in latent]
        return -np.mean([math.log(max(b[g + 1] - b[g], 1e-12)) for b, g in zip(below, grade)])

    best = loss(latent, model.thresholds)
    for j in range(len(model.thresholds)):
        for step in (-0.3, 0.3):
            moved = model.thresholds.copy()
            moved[j] += step
            assert loss(latent, moved) > best - 1e-3
    assert loss(latent * 0.7, model.thresholds) > best and loss(np.zeros(len(texts)), model.thresholds) > best + 0.1


def test_a_language_of_few_ids_that_repeat_is_learned(spark):
    rng = random.Random(4)
    say = lambda letters: " ".join("".join(rng.choices(letters, k=5)) for _ in range(30))
    rows = [(i, say("abcde"), "one") for i in range(60)] + [(1000 + i % 3, f"{say('vwxyz')}", "two") for i in range(9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    network = langid.train(df, per_language=20, epochs=1)
    assert network.languages == ("one", "two")


def test_rows_without_an_id_are_found_on_both_ways(spark):
    words = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(None, " ".join(words)), (None, "other words here"), (None, "x " + " ".join(words[5:])), (1, " ".join(words)), (1, " ".join(words)), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(words[:25])), (8, "w3")], "item_id long, text string")
    one, two = (sorted(map(str, decontaminate.find_contamination(docs, bench, broadcast_rows=n).collect())) for n in (2_000_000, 0))
    assert one == two and sum("doc_id=None" in r for r in one) == 2


def test_texts_that_share_an_id_are_documents_of_their_own(spark):
    rng = random.Random(5)
    text = lambda: " ".join(rng.choice("abcdefghij") + str(rng.randint(0, 99)) for _ in range(60))
    a, b, c = text(), text(), text()
    near = a.replace(a.split()[7], "zz", 1)
    rows = [(5, a), (7, a), (7, b), (7, b), (9, c), (9, near), (None, a), (11, None), (11, ""), (12, c)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, _number int")
    kept = ngramjoin.first_of_groups(df)
    assert kept.columns == df.columns
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in kept.collect())
    assert got == sorted([(5, a), (7, b), (7, b), (9, c), (-1, a), (11, ""), (11, "")])


def test_imatch_blocks_of_any_ids(spark):
    rng = random.Random(6)
    ids = [*range(300), 2**62, -(2**62), 2**63 - 1, -(2**63), *[5] * 120, *[None] * 120]
    rows = [(i, f"text {rng.randint(0, 10**9)} of {i}") for i in ids]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    blocked = imatch.with_next(df, rows_a_block=20).collect()
    own = [r for r in blocked if not r._copy]
    assert len(own) == len(rows)
    sizes = np.bincount([r._block for r in own])
    assert len(sizes) > 15 and sizes.max() < 90
    # A block streams rows in order and ends with the first row of the next one that has any.
    lexicon = imatch.build_lexicon(df, least=0.0, most=0.5)
    out = imatch.fingerprint_documents(df, lexicon).collect()
    texts = {r.doc_id for r in out}
    assert len(out) == len(rows) and texts == set(ids)
    plain = df.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    order = sorted(plain, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.h))
    want = sorted((str(r.doc_id), len(r.text), imatch.sha256_hex(imatch.edited(r.text, order[(k + 1) % len(order)].text).encode())) for k, r in enumerate(order))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in out) == want
