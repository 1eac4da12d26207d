import random
from collections import defaultdict

import numpy as np
import pytest

from factloom.llm import ngram_join as J
from factloom.llm.components import components


def fold(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def shingles(text):
    words = fold(text).split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    close = lambda a, b: a == b or (bool(a and b) and len(a & b) * 10 >= 8 * len(a | b))
    near = [[j for j in range(len(rows)) if j != i and close(sets[i], sets[j])] for i in range(len(rows))]
    label = list(range(len(rows)))
    for _ in rows:
        label = [min([label[i], *(label[j] for j in near[i])]) for i in range(len(rows))]
    groups = defaultdict(list)
    for i, x in enumerate(label):
        groups[x].append(rows[i][0])
    return {(rows[i][0], min(groups[label[i]]), len(near[i])) for i in range(len(rows))}


def corpus(seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgé", k=rng.randint(2, 6)))
    texts = ["", None, "  ", "one two", "One  two", "one two three"]
    for _ in range(12):
        base = [word() for _ in range(rng.randint(30, 200))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 45))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(rng.choice([" ", "\n", "  "]).join(copy))
    texts += [" ".join(word() for _ in range(40)) for _ in range(20)]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("block", [512, 4])
def test_equals_brute_force(spark, block):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, label string, size int").repartition(3)
    got = J.join_similar(docs, block=block).collect()
    assert {(r.id, r.class_id, r.n_links) for r in got} == brute(rows) and len(got) == len(rows)
    left = J.drop_similar(docs, block=block)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted({c for _, c, _ in brute(rows)})


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None)], "doc_id long, text string")
    got = J.join_similar(docs).collect()
    assert sorted((r.id or 0, r.class_id or 0, r.n_links) for r in got) == [(0, 0, 0), (0, 1, 2), (1, 1, 2), (1, 1, 2)]
    assert J.join_similar(docs.limit(0)).count() == 0


def test_words_do_not_run_over_texts():
    texts = ["ab", "c d", "", "e"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    words, counts = J._word_hashes(data, at)
    assert counts.tolist() == [1, 2, 0, 1] and len(set(words.tolist())) == 4


def test_pruning_keeps_what_is_similar():
    least = J.least_matches(0.8, 1e-6)
    assert len(least) == J.HASHES // J.CHUNK and all(m <= 0.8 * J.CHUNK * (k + 1) for k, m in enumerate(least))
    assert least[-1] > 0.5 * J.HASHES


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (7, 7), (3, 1), (10, 11), (11, 12), (12, 13), (13, 14), (14, 9), (None, 1)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, **dict.fromkeys([9, 10, 11, 12, 13, 14], 9)}


def test_links_equal_exact_word_shingles_on_the_drivers_documents(spark):
    """Every link of the driver's documents, by sets of words: recall and precision are both one there."""
    import os

    path = "/root/testdata/sf0.001/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no driver tables")
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(path).collect()]
    got = {(r.id, r.class_id, r.n_links) for r in J.join_similar(spark.read.parquet(path)).collect()}
    want = brute(rows)
    assert got == want and sum(n > 0 for *_, n in want) > 10
