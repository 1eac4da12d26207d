import json
import re
from collections import Counter

import pytest

from factloom.operators import index, search
from factloom.streaming.refresh import refresh_index

TEXTS = {1: "Alpha beta beta license", 2: "beta gamma", 3: None, 4: "the LICENSE line\nnothing", 5: "alpha"}


def words(text):
    return re.findall("[a-z0-9_]+", (text or "").lower())


def want(texts, terms):
    found = {k: sorted(set(words(t)) & set(terms)) for k, t in texts.items()}
    return sorted(((k, " ".join(m), len(m)) for k, m in found.items() if m), key=lambda x: (-x[2], x[0]))


def table(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string")


def test_build_refresh_delete_compact(spark, tmp_path):
    path, terms = f"file://{tmp_path}/ix", ["alpha", "beta", "license", "zeta"]
    index.build(table(spark, TEXTS), path)
    found = lambda: [tuple(r) for r in index.search(spark, path, terms, 10).collect()]
    assert found() == want(TEXTS, terms)
    now = {**TEXTS, 1: "", 2: "zeta zeta alpha", 6: "Beta license"}
    del now[4]
    index.refresh(table(spark, {k: now[k] for k in (1, 2, 5, 6)}), path, removed=spark.createDataFrame([(4,)], "doc_id long"))
    assert found() == want(now, terms) and index.segments(spark, path) == [0, 1]
    assert [tuple(r) for r in spark.read.parquet(f"{path}/segment=1/files").select("key").orderBy("key").collect()] == [(1,), (2,), (6,)]  # 5 had not changed
    got = index.coverage(table(spark, now), path).first()
    assert (got.indexed, got.stale, got.missing, got.orphaned, got.postings) == (5, 0, 0, 0, sum(len(Counter(words(t))) for t in now.values()))
    assert index.coverage(table(spark, {**now, 5: "changed", 9: "new"}), path).first()[:3] == (4, 1, 1)
    scores = sorted(map(tuple, index.bm25(spark, path, terms).collect()))
    index.compact(spark, path)
    assert index.segments(spark, path) == [2] and found() == want(now, terms) and sorted(map(tuple, index.bm25(spark, path, terms).collect())) == scores
    assert scores == sorted(map(tuple, search.bm25(table(spark, now), terms).collect()))
    assert [r.key for r in index.page_of_files(spark, path, 2, after=1).collect()] == [2, 3] and index.file(spark, path, 6).first().chars == 12
    assert {r.segment for r in index.manifest(spark, path).collect()} == {2}


def test_only_the_terms_buckets_are_read(spark, tmp_path):
    path = f"file://{tmp_path}/ix"
    index.build(table(spark, TEXTS), path)
    plan = index.postings(spark, path, ["alpha"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and re.search(r"PushedFilters: \[[^\]]*term", plan)


def test_literals_by_probes(spark, tmp_path):
    path = f"file://{tmp_path}/ix"
    index.build(table(spark, TEXTS), path)
    assert {r.key for r in index.candidates(spark, path, "License l").collect()} == {4}
    rows = [tuple(r) for r in index.locate_global(table(spark, TEXTS), path, "license", 10).collect()]
    assert rows == [(1, 1, TEXTS[1]), (4, 1, "the LICENSE line")]
    assert [tuple(r)[:2] for r in index.locate_global(table(spark, TEXTS), path, "license", 10, after=(1, 1)).collect()] == [(4, 1)]
    assert index.locate_global(table(spark, TEXTS), path, "no such thing", 10).count() == 0


def test_posting_pages_and_manifests(spark, tmp_path):
    rows = spark.createDataFrame([("a", k) for k in range(5)] + [("b", 9)], "term string, key long")
    got = {(r.term, r.page): r["keys"] for r in index.posting_pages(rows, 2, 3).collect()}
    assert got == {("a", 0): [0, 1], ("a", 1): [2, 3], ("a", 2): [4], ("b", 0): [9]}
    path = f"file://{tmp_path}/ix"
    index.build(table(spark, {}), path)
    assert index.search(spark, path, ["a"], 5).count() == 0 and index.manifest(spark, path).count() == 1
    spark.createDataFrame([("0" * 64, json.dumps({"segment": 0}))], "revision string, body string").coalesce(1).write.mode("overwrite").parquet(f"{path}/segment=0/manifest")
    with pytest.raises(ValueError):
        index.manifest(spark, path)


def test_stream_takes_newest_and_deletes(spark, tmp_path):
    path, source = f"file://{tmp_path}/ix", f"{tmp_path}/in"
    schema = "doc_id long, text string, version long, deleted boolean"
    run = lambda: refresh_index(spark, source, schema, path, f"{tmp_path}/ck")
    spark.createDataFrame([(1, "old words", 1, False), (1, "alpha", 2, False), (2, "alpha beta", 1, False), (3, "beta", 1, False)], schema).coalesce(1).write.parquet(source)
    run()
    assert [tuple(r) for r in index.search(spark, path, ["alpha", "beta", "words"], 9).collect()] == [(2, "alpha beta", 2), (1, "alpha", 1), (3, "beta", 1)]
    spark.createDataFrame([(1, "", 3, False), (2, None, 2, True), (4, "beta", 1, False)], schema).coalesce(1).write.mode("append").parquet(source)
    run()
    assert [tuple(r) for r in index.search(spark, path, ["alpha", "beta", "words"], 9).collect()] == [(3, "beta", 1), (4, "beta", 1)]
