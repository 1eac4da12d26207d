import random

import numpy as np

import corpus_pipeline
from factloom.llm.sentencepiece import Vocabulary


def tables(spark, path):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdeghiklmnorstu", k=rng.randint(2, 7)))
    docs, labels = [], []
    for i in range(300):
        words = [word() for _ in range(rng.randint(20, 120))]
        bad = i % 6 == 0
        text = " | ".join(words) if bad else " ".join(words) + "."
        if i % 7 == 3 and not bad:
            text = docs[-1][1] if docs[-1][4] else text  # an exact copy of a good one
        elif i % 7 == 5 and not bad:
            old = docs[-1][1].split(" ")
            text = " ".join(old[:-1] + [word()]) if docs[-1][4] and len(old) > 40 else text
        docs.append((i, text, "en" if i % 3 else "de", f"src{i % 20}", not bad))
        if i % 4 < 2:
            labels.append((i, int(not bad), 0))
    docs = [(i, t, la, s, len(t)) for i, t, la, s, _ in docs]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return docs


def test_stages_by_brute_force(spark, tmp_path):
    path = "file://" + str(tmp_path)
    rows = {d[0]: d for d in tables(spark, path)}
    docs = spark.read.parquet(path + "/documents.parquet")
    kept = [set(rows)]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, path)
        if k < 4:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(f"{path}/out{k}")
        docs = spark.read.parquet(f"{path}/out{k}")
        kept.append({r.doc_id for r in docs.collect()})
        assert kept[-1] <= kept[-2] and docs.count() == len(kept[-1])
    assert all(" | " in rows[i][1] for i in kept[0] - kept[1]) and sum(" | " in rows[i][1] for i in kept[1]) <= 2
    best = {}
    for i in kept[1]:
        best[rows[i][1].lower()] = max(i, best.get(rows[i][1].lower(), -1))
    assert kept[2] == set(best.values())

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[j : j + 5]) for j in range(len(w) - 4)}

    label = {i: i for i in kept[2]}
    sets = {i: shingles(rows[i][1]) for i in label}
    pairs = [(a, b) for a in label for b in label if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert pairs and kept[3] == set(label.values())
    total = sum(-(-len(rows[i][1].encode()) // 4) for i in kept[3])
    taken = sum(-(-len(rows[i][1].encode()) // 4) for i in kept[4])
    assert 0.5 * total < taken <= 0.9 * total
    decode = Vocabulary.load().decoder()
    assert {(r.doc_id, decode(np.array(r.ids)).decode()) for r in docs.collect()} == {(i, rows[i][1]) for i in kept[4]}


def test_run_equals_its_stages(spark, tmp_path):
    path = "file://" + str(tmp_path)
    tables(spark, path)
    assert [n for n, _ in corpus_pipeline.STAGES] and corpus_pipeline.ORACLE_SQL is None
    got = corpus_pipeline.run(spark, path)
    docs = spark.read.parquet(path + "/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, path).write.parquet(f"{path}/s{k}")
        docs = spark.read.parquet(f"{path}/s{k}")
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in docs.collect())


def test_edges_of_the_whole_pipeline(spark, tmp_path):
    """Empty tables, nulls in every column, empty and very long texts, repeated rows and columns with the stages' own names."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, id long, kept boolean, label string, locator long, epoch int"
    more = (7, True, "l", 1, 2)
    good = " ".join(f"word{i} and the" for i in range(60)) + "."
    rows = [(None, None, None, None, None, *more), (1, "", None, "src1", 0, *more), (2, good, "en", None, 9, *more), (2, good, "en", None, 9, *more), (3, good.upper(), "de", "src3", 1, *more), (4, "long " * 60_000, "en", "src4", 2, *more), (None, good + " end", None, None, None, *more)]
    for k, part in enumerate((rows, [])):
        path = f"file://{tmp_path}/{k}"
        spark.createDataFrame(part, schema).write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        docs = spark.read.parquet(f"{path}/documents.parquet")
        counts = []
        for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, path)
            assert n == 4 or out.columns == docs.columns
            out.write.parquet(f"{path}/s{n}")
            docs = spark.read.parquet(f"{path}/s{n}")
            counts.append(docs.count())
        # without labels nothing is rejected; two rows fold to one text three times; the near copy goes; the mix takes most
        assert counts[:3] == ([7, 4, 3] if part else [0, 0, 0]) and counts[3] == counts[4] <= counts[2]
        assert corpus_pipeline.run(spark, path).count() == counts[4]
