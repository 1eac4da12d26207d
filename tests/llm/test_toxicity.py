"""Features, class counts, ratios and the fit against plain versions; samples bounded in rows and bytes."""

import math
import random
from collections import Counter

import numpy as np

from factloom.llm import toxicity

BITS = 14


def code(gram):
    """The bucket of one n-gram, by whole numbers."""
    value = gram[0] + 1
    for b in gram[1:]:
        value = (value * 257 + b + 1) % 2**64
    return (value + len(gram)) * 0x9E3779B97F4A7C15 % 2**64 >> (64 - BITS)


def brute_features(text):
    """Buckets of a text, once per distinct word that holds the n-gram."""
    out = []
    for word in set((text or "").lower().encode().split()):
        padded = b" " + word + b" "
        out += [code(padded[i : i + n]) for n in range(2, 7) for i in range(len(padded) - n + 1)]
    return sorted(out)


def corpus(n=300, seed=2):
    rng = random.Random(seed)
    good, bad = [[f"{a}{b}" for a in s for b in ("an", "el", "or", "ühl")] for s in (("st", "br", "tr", "gr"), ("zk", "xv", "qw"))]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = [rng.choice(good) for _ in range(rng.randint(5, 40))] + ([rng.choice(bad) for _ in range(3)] if toxic else [])
        docs.append((i, " ".join(words), 1.0))
        labels.append((i, int(toxic)))
    return docs, labels


def test_features_equal_brute_force():
    texts = ["Ab abc, ab", None, "", "é🦊 ß", "x" * 3000, "a a a b"]
    assert [sorted(f.tolist()) for f in toxicity.features_of(texts, BITS)] == [brute_features(t) for t in texts]


def test_counts_ratios_and_scores_equal_brute_force(spark):
    docs, labels = corpus()
    rows = spark.createDataFrame([(t, y, 1 + i % 3) for (i, t, _), (_, y) in zip(docs, labels)], "text string, label int, times long").repartition(3)
    sums, total = toxicity._class_counts(rows, BITS)
    want, texts = [Counter(), Counter()], [0, 0]
    for (i, t, _), (_, y) in zip(docs, labels):
        texts[y] += 1 + i % 3
        for f in set(brute_features(t)):
            want[y][f] += 1 + i % 3
    assert total.tolist() == texts and all({f: int(n) for f, n in enumerate(sums[y]) if n} == dict(want[y]) for y in (0, 1))
    ratio = toxicity.log_ratio(sums, total, 4.0)
    for f in random.Random(1).sample(sorted(want[0].keys() | want[1].keys()), 200):
        a, b = want[1][f] + 0.5, want[0][f] + 0.5
        r = math.log(a / (texts[1] + 1)) - math.log(b / (texts[0] + 1))
        assert math.isclose(ratio[f], 0.0 if abs(r) < 4 * math.sqrt(1 / a + 1 / b) else r, abs_tol=1e-9)
    model = toxicity.Model(BITS, ratio.astype(np.float32), 0.7, -1.0)
    own = model.scores([t for _, t, _ in docs])
    for (_, t, _), s in zip(docs, own):
        margin = sum(float(np.float32(ratio[f])) for f in brute_features(t))
        assert math.isclose(s, 1 / (1 + math.exp(-(0.7 * margin - 1.0))), rel_tol=1e-4)


def test_weights_count_as_repeated_rows():
    rng = np.random.default_rng(0)
    found = [rng.integers(0, 50, 20).astype(np.int32) for _ in range(40)]
    y, times = (np.array([f[0] > 25 for f in found])).astype(float), rng.integers(1, 4, 40)
    again = np.repeat(np.arange(40), times)
    ratio = rng.normal(size=64)
    one = toxicity._fit(found, y, times.astype(float), ratio, 50, 0.05, 0.02)
    two = toxicity._fit([found[i] for i in again], y[again], np.ones(len(again)), ratio, 50, 0.05, 0.02)
    assert np.allclose(one[0], two[0], atol=1e-5) and math.isclose(one[1], two[1], abs_tol=1e-6)


def test_learns_and_samples_are_bounded(spark):
    docs, labels = corpus(800)
    table = spark.createDataFrame(docs, "doc_id long, text string, score double").repartition(4)
    model = toxicity.train(table, spark.createDataFrame([x for x in labels if x[0] % 5], "doc_id long, toxic int"), bits=BITS)
    got = {r.id: r.score for r in toxicity.score(table, model).collect()}
    held = [(got[i], y) for i, y in labels if i % 5 == 0]
    assert np.mean([(s >= 0.3) == y for s, y in held]) > 0.97
    many = spark.createDataFrame([(1, f"text {i}", 0.0) for i in range(500)] + [(2, "y" * 10_000, 0.0), (3, "z", 0.0)] * 40, "doc_id long, text string, score double")
    named = spark.createDataFrame([(1, 0), (1, 0), (2, 1), (3, 1), (None, 1), (3, 5)], "doc_id long, toxic int")
    whole = toxicity._sample(many, named, "toxic", "doc_id", "text", 10_000, 64_000_000)
    assert sorted((r.label, r.times, r.n) for r in whole.groupBy("label", "times").count().withColumnRenamed("count", "n").collect()) == [(0, 2, 500), (1, 40, 2)]
    few = toxicity._sample(many, named, "toxic", "doc_id", "text", 50, 100_000)
    assert 0 < few.count() < 150 and few.where("length(text) > 6250").count() == 0
