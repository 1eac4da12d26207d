import random

import numpy as np
import pyarrow as pa

from factloom.llm import quality

WORDS = "the of and to in is it that was for on are with as be at by this from or one had not but what all were when we there can an your which their said if do".split()


def corpus(n=600):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.25
        words = [rng.choice(WORDS) + rng.choice(["", "er", "ing", "ly"]) for _ in range(rng.randrange(5, 300))]
        text = rng.choice([" | ".join(words), " ".join(w + "$$$" for w in words), " ".join(w for w in words for _ in range(9))]) if bad else " ".join(words).capitalize() + "."
        docs.append((i, text, "src" + str(rng.randrange(3) if bad else rng.randrange(6)), rng.choice(["en", None]), "x"))
        if i % 2:
            labels.append((i, int(not bad)))
    truth = {d[0]: int(d[1][0].isupper()) for d in docs}
    return docs, labels, truth


def test_learns_and_keeps_good_ones(spark):
    docs, labels, truth = corpus()
    table = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, score string").repartition(4)
    model = quality.train(table, spark.createDataFrame(labels, "doc_id long, quality int"))
    got = {r.id: r.score for r in quality.score(table, model).collect()}
    unseen = [i for i in got if i % 2 == 0]
    assert np.mean([(got[i] >= 0.5) == truth[i] for i in unseen]) > 0.97
    assert model.content.share > model.metadata.share >= 0
    kept = quality.keep_good(table, model)
    assert kept.columns == table.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, s in got.items() if s >= 0.5}


def test_edges(spark):
    schema = "doc_id long, text string, source string, lang string"
    docs = spark.createDataFrame([(1, None, None, None), (1, "", "a", "en"), (None, "x " * 100_000, "a", "en")], schema)
    nothing = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.train(docs, nothing)
    assert [r.score for r in quality.score(docs, model).collect()] == [1.0] * 3
    assert quality.keep_good(docs.limit(0), model).count() == 0
    assert quality.train(docs.limit(0), nothing).content is None


def test_measures_do_not_depend_on_length():
    words = [random.Random(i).choice(WORDS) for i in range(50)]
    short, long = quality.content_view(pa.array([" ".join(words), " ".join(words * 200)]))
    assert np.abs(short - long).max() < 0.02
    assert (quality.content_view(pa.array([None, ""])) == 0).all()


def test_repetition_is_seen_to_the_last_word():
    plain, closing = quality.content_view(pa.array([" ".join(f"w{i}" for i in range(37)), " ".join([f"w{i}" for i in range(25)] + ["x"] * 12)]))
    assert (plain[10], plain[11]) == (1.0, 0.0)
    assert (closing[10], closing[11]) == (26 / 37, 12 / 37)


def test_calibrated_views_exchange_labels():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 900)
    content = rng.normal(size=(900, quality.MEASURES))
    content[:, 0] += 3 * y
    columns = np.stack([np.where(rng.random(900) < 0.8, y, 1 - y), np.full(900, 70), np.full(900, 140)], axis=1)
    labels = np.where(np.arange(900) < 300, y, -1)
    model = quality.co_train(content, columns, labels)
    p = model.scores(content, columns)[0]
    alone = model.scores(content, columns)
    assert ((p > 0.5) == y).mean() >= max(0.88, *(((v > 0.5) == y).mean() - 0.02 for v in alone[1:])) and abs(p.mean() - y.mean()) < 0.1


def brute_measures(text):
    data = (text or "").encode()
    n, words = max(1, len(data)), data.split()
    kinds = [0] * 8
    for b in data:
        c = chr(b)
        kinds[0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3 if b in (9, 11, 12, 32) else 4 if b in (10, 13) else 5 if c in ".,;:'\"()?-" else 6 if b < 128 else 7] += 1
    out = [k / n for k in kinds] + [data.count(b"!") / n] + [0.0] * 7
    if words:
        m = len(words)
        held = [words[k : k + 25] for k in range(0, m, 25)]
        out[9] = sum(a == b for a, b in zip(words, words[1:])) / m
        out[10] = sum(len(set(h)) for h in held) / m
        out[11] = sum(len(h) for h in held if 2 * len(set(h)) < len(h)) / m
        out[12] = min(len(data) / m, 40) / 10
        out[13] = sum(w.isalpha() or any(b > 127 for b in w) for w in words) / m
        out[14] = sum(len(w) == 1 for w in words) / m
        out[15] = min(3.0, 10 * kinds[4] / m)
    return out


def test_measures_equal_brute_force():
    texts = ["", None, "One two two, 3!\n\nVier fünf\tsix", "a " * 70, "x" * 5000, " ", "é b\r\nc"]
    assert np.allclose(quality.content_view(pa.array(texts)), [brute_measures(t) for t in texts])


def test_regression_is_at_its_optimum_and_weights_are_repeats():
    rng = np.random.default_rng(3)
    x, y, times = rng.normal(size=(120, 4)), rng.integers(0, 2, 120).astype(float), rng.integers(1, 4, 120)
    w = quality._solve(x, y, 3.0, times=times)
    again = np.repeat(np.arange(120), times)
    assert np.allclose(w, quality._solve(x[again], y[again], 3.0), atol=1e-6)

    def loss(v):
        z = x[again] @ v[:-1] + v[-1]
        return np.log1p(np.exp(-np.where(y[again] == 1, z, -z))).sum() + 1.5 * (v[:-1] ** 2).sum()

    assert all(loss(w) <= loss(w + d) + 1e-6 for d in rng.normal(scale=0.01, size=(50, 5)))


def test_scores_equal_the_model_by_hand(spark):
    docs, labels, _ = corpus(200)
    table = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, score string").repartition(3)
    model = quality.train(table, spark.createDataFrame(labels, "doc_id long, quality int"))
    got = {r.id: r for r in quality.score(table, model).collect()}
    for i, text, source, lang, _ in docs[:40]:
        logits = []
        for view, x in ((model.content, brute_measures(text)), (model.metadata, quality.one_hot(quality.metadata_view(pa.array([source]), pa.array([lang], pa.string()), pa.array([text])))[0])):
            z = sum(min(6, max(-6, (a - m) / s)) * w for a, m, s, w in zip(x, view.mean, view.spread, view.weights)) + view.intercept
            logits.append(view.slope * z + view.shift)
        want = 1 / (1 + np.exp(-(model.content.share * logits[0] + model.metadata.share * logits[1])))
        assert np.isclose(got[i].score, want, atol=1e-6)


def test_samples_are_bounded(spark):
    rows = [(None, f"text {i} words", "s", "en") for i in range(600)] + [(1, f"copy {i}", "s", "en") for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(1, i % 2) for i in range(30)], "doc_id long, quality int")
    model = quality.train(table, labels, sample_rows=20)
    assert 0 <= model.prior <= 1 and quality.score(table, model).count() == 1000
