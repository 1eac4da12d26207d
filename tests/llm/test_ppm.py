import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import ppm


def fold(text):
    return [b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()]


def brute(texts, learned):
    """Scores by a plain trie of dictionaries."""
    trie = {}

    def steps(text):
        symbols = [0] * ppm.ORDER + [b + 1 for b in fold(text)] + [0]
        for i in range(ppm.ORDER, len(symbols)):
            yield symbols[i - ppm.ORDER : i], symbols[i]

    for text in learned:
        for context, s in steps(text):
            for k in range(ppm.ORDER + 1):
                trie.setdefault(tuple(context[ppm.ORDER - k :]), Counter())[s] += 1
    out = []
    for text in texts:
        total = 0.0
        for context, s in steps(text):
            seen = set()
            for k in range(ppm.ORDER, -1, -1):
                node = {x: n for x, n in trie.get(tuple(context[ppm.ORDER - k :]), {}).items() if x not in seen}
                if s in node:
                    total += math.log10((node[s] - 0.5) / sum(node.values()))
                    break
                if node:
                    total += math.log10(len(node) / (2 * sum(node.values())))
                seen |= node.keys()
            else:
                total -= math.log10(ppm.SYMBOLS - len(seen))
        out.append(total)
    return out


def sample():
    rng = random.Random(3)
    parts = ["the ", "an", "er", "Ing ", "é", "\n", "on ", "x", "🦊", "  "]
    return ["".join(rng.choices(parts, k=rng.randrange(0, 60))) for _ in range(80)] + ["", None, "zzzz", "q" * 3000]


@pytest.mark.parametrize(("chunk_bytes", "fan_bits"), [(300, 2), (300, 7), (10**9, 7)])
def test_equals_brute_force(spark, chunk_bytes, fan_bits):
    """Also through a tree of several levels (more chunks than a node may merge)."""
    texts = sample()
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, bucket int").repartition(3)
    got = {r.id: r for r in ppm.score(docs, F.col("doc_id") % 3 != 0, chunk_bytes=chunk_bytes, fan_bits=fan_bits).collect()}
    learned = [t for i, t in enumerate(texts) if i % 3]
    assert np.allclose([got[i].score for i in range(len(texts))], brute(texts, learned), rtol=1e-5)
    words = lambda t: bytes(fold(t)).split() + [None]
    counts = Counter(w for t in learned for w in words(t))
    n, v = sum(counts.values()), len(counts)
    for i, t in enumerate(texts):
        assert (got[i].n_tokens, got[i].train_tokens) == (len(words(t)), n)
        assert got[i].n_known == sum(counts[w] > 0 for w in words(t))
        assert math.isclose(got[i].base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words(t)), rel_tol=1e-9)


def test_edges(spark):
    docs = spark.createDataFrame([(1, "abc"), (1, "abc"), (None, None)], "doc_id long, text string")
    got = ppm.score(docs, F.lit(False)).collect()
    assert sorted(round(r.score, 3) for r in got) == sorted(round(-n * math.log10(257), 3) for n in (4, 4, 1))
    assert all(r.train_tokens == 0 and r.n_known == 0 for r in got)
    assert ppm.score(docs.limit(0), F.lit(True)).count() == 0
    assert ppm.score(docs, F.lit(None).cast("boolean")).where("train").count() == 3


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 101, 4000).astype(np.uint8)
    seen = ppm.grams(data, np.array([0, 4000]))
    context = seen[100] >> np.int64(9) << np.int64(9)
    asked = context | np.arange(ppm.SYMBOLS)
    codes, counts = np.unique(seen, return_counts=True)
    every = np.union1d(codes, asked)
    n = np.zeros(len(every), np.int64)
    n[np.searchsorted(every, codes)] = counts
    tri, at = np.unique(codes & ppm.mask(2), return_inverse=True)
    p = ppm.costs(every, n, (tri, np.bincount(at, counts).astype(np.int64)))
    assert math.isclose((10 ** p[np.searchsorted(every, asked)]).sum(), 1, rel_tol=1e-9)


def test_adaptive_code_length():
    assert ppm.code_length("abcabcabcabcabcabc" * 5) < ppm.code_length("".join(random.Random(1).choices("abcdefghij", k=90))) < 90 * 8
    assert ppm.code_length("") == pytest.approx(math.log2(257))
