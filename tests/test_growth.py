"""Queries whose time, shuffle or memory grew too fast: results by brute force, and that the costly step is gone."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factloom.functions import text as X
from factloom.operators import graph, index, search
from factloom.plans import registry


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def texts_of(n, seed=1):
    rng = random.Random(seed)
    return ["", "a", "_", "ab", "\n", "é日"] + ["".join(rng.choice("abz09_ .-\né日") for _ in range(rng.choice([0, 1, 3, 5, 40, 300]))) for _ in range(n)]


def test_probes_and_counts_by_batch():
    texts = texts_of(600) + ["a b" * 2_000_000]
    for batch in (pa.array(texts), pa.array(["x"] + texts[:50]).slice(1), pa.array([], pa.string()), pa.array(["", ""])):
        got = batch.to_pylist()
        assert X.probe_lists(batch, 3, 8192).to_pylist() == [X.probe_values(t[:9000]) for t in got]
        counted = X.count_lists(batch).to_pylist()
        assert [{d["term"]: d["tf"] for d in row} for row in counted] == [dict(Counter(re.findall("[a-z0-9_]+", t))) for t in got]
        assert all(d["slot"] == hashlib.sha256(d["term"].encode()).digest()[0] for row in counted for d in row)


def test_ngram_signature_in_one_batch_pass(spark, tmp_path):
    texts = [None, "AbC", "Ünder Köln K"] + texts_of(80)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = registry.QUERIES["ngram_signature"](spark, str(tmp_path))
    plan = plan_of(df)
    assert plan.count("ArrowEvalPython") == 1 and "lambda" not in plan
    want = {i: X.probe_values(t or "") for i, t in enumerate(texts)}
    assert {tuple(r) for r in df.collect()} == {(i, len(p), sum(p)) for i, p in want.items() if p}


LINES = "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long"


def test_edges_and_hubs_are_made_once(spark, tmp_path):
    rows = [(i, 1, 1 + i * 7 % 23, 1 + i * i % 11) for i in range(60)]
    spark.createDataFrame(rows, LINES).write.parquet(f"{tmp_path}/lineitem.parquet")
    df = registry.QUERIES["hub_limited_closure"](spark, str(tmp_path))
    assert "lineitem" not in plan_of(df)  # levels and hubs are written
    assert {r.node for r in df.collect()} <= {f"p{r[2]}" for r in rows} | {f"s{r[3]}" for r in rows}


def test_hubs_count_distinct_callers(spark):
    pairs = [(f"c{i % 9}", "h") for i in range(30)] + [("a", "b")] * 20 + [(None, "b"), ("b", None)]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    got = {tuple(r) for r in graph.hubs(edges, 8).collect()}
    assert got == {("h", 9)}
    graph.FEW, few = 1, graph.FEW  # levels that start from many nodes are joined without a broadcast
    try:
        reached = graph.bfs(edges, spark.createDataFrame([("c0",), ("c1",), ("a",)], "node string"), 3)
    finally:
        graph.FEW = few
    assert {tuple(r) for r in reached.collect()} == {("c0", 0), ("c1", 0), ("a", 0), ("h", 1), ("b", 1)}


def test_formals_are_hashed_and_stand_at_every_position(spark, tmp_path):
    spark.createDataFrame([(1, 8, 5, 1), (1, 1, 6, 1), (2, 2, 7, 1)], LINES).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(5, "STANDARD", 3), (6, "STANDARD", 44)], "p_partkey long, p_type string, p_size long").write.parquet(f"{tmp_path}/part.parquet")
    df = registry.QUERIES["call_binding_positions"](spark, str(tmp_path))
    plan = plan_of(df)
    assert "Generate" not in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" in plan
    assert {tuple(r) for r in df.collect()} == {(1, 8, 5, 5, "confirmed", None), (1, 1, 6, 6, "candidate", "layout_differs"), (2, 2, 7, None, "unresolved", "formal_missing")}


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_unique_keys_move_no_texts(spark):
    alone = index._once(docs_of(spark, [(1, "a b"), (2, None)]), "doc_id")
    assert "Exchange" not in plan_of(alone) and {tuple(r) for r in alone.collect()} == {(1, "a b"), (2, None)}
    twice = index._once(docs_of(spark, [(1, "a"), (1, "c"), (1, "b"), (2, "x"), (None, "p"), (None, "q"), (3, None), (3, None)]), "doc_id")
    assert sorted(map(tuple, twice.collect()), key=repr) == [(1, "c"), (2, "x"), (3, None), (None, "q")]


def test_coverage_reads_no_postings_of_one_segment(spark, tmp_path, monkeypatch):
    texts = {i: t for i, t in enumerate(texts_of(40, seed=3))}
    terms = ["a", "b", "ab", "z_9"]
    folders = lambda df: {f.split("segment=0/")[1].split("/")[0] for f in df.inputFiles() if "segment=0/" in f}
    for large, part in ((1, 10**7), (10**10, 60)):  # with 256 buckets, and with 16 in several parts
        monkeypatch.setattr(index, "LARGE", large)
        monkeypatch.setattr(index, "PART", part)
        path = f"file://{tmp_path}/ix{large}"
        index.build(docs_of(spark, list(texts.items())), path)
        df = index.coverage(docs_of(spark, list(texts.items())), path)
        assert folders(df) == {"files", "routes"}
        sets = [set(re.findall("[a-z0-9_]+", t.lower())) for t in texts.values()]
        want = (len(texts), 0, 0, 0, len(set().union(*sets)), sum(map(len, sets)))
        assert tuple(df.first()) == want
        assert {r.key for r in index.search(spark, path, terms).collect()} == {k for k, s in zip(texts, sets, strict=True) if s & set(terms)}
        scores = sorted(map(tuple, index.bm25(spark, path, terms).collect()))
        index.refresh(docs_of(spark, [(2, "a new"), (900, "z_9")]), path)
        assert tuple(index.standing(docs_of(spark, list(texts.items())), path).first()) == (len(texts) - 1, 1, 0, 1)
        assert folders(index.standing(docs_of(spark, list(texts.items())), path)) == {"files"}
        index.refresh(docs_of(spark, [(2, texts[2])]), path, removed=spark.createDataFrame([(900,)], "doc_id long"))
        assert tuple(index.coverage(docs_of(spark, list(texts.items())), path).first()) == want
        index.compact(spark, path)
        assert sorted(map(tuple, index.bm25(spark, path, terms).collect())) == scores


def test_a_refresh_of_many_texts_is_joined(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "FEW", 1)
    path = f"file://{tmp_path}/ix"
    index.build(docs_of(spark, [(i, f"old w{i}") for i in range(6)] + [(1, "old w9")]), path)
    index.refresh(docs_of(spark, [(i, f"new w{i}") for i in range(1, 5)] + [(0, "old w0")]), path)
    assert {r.key for r in index.search(spark, path, ["new"]).collect()} == {1, 2, 3, 4} and {r.key for r in index.search(spark, path, ["old"]).collect()} == {0, 5}


def counted(texts, keys):
    return sorted(((w, k, n) for t, k in zip(texts, keys, strict=True) for w, n in Counter(re.findall("[a-z0-9_]+", t)).items()), key=repr)


@pytest.mark.parametrize("form", [0, 1, 2, 3, None])
def test_postings_packed_by_batch(form):
    texts = texts_of(700, seed=5) + (["a " * 300] if form == 1 else [])
    of = {2: lambda i: i - 3, 3: lambda i: None if i == 7 else i, None: lambda i: f"k{i}\né"}.get(form, lambda i: i + (1 << 32) - 9000)
    keys, part = [of(i) for i in range(len(texts))], np.arange(len(texts), dtype=np.int32) * 7 % 3
    got, where = [], {k: p for k, p in zip(keys, part.tolist(), strict=True)}
    for size in (1 << 24, 2000):  # one piece, and many
        got = []
        for rows in (X.pack_texts(pa.array(["x", *texts]).slice(1), pa.array(keys), part, size), [X.pack_rows(*(pa.array(v) for v in list(zip(*counted(texts, keys), strict=True))[:2]), *(np.array(v) for v in zip(*((n, where[k]) for _, k, n in counted(texts, keys)), strict=True)))]):
            found = []
            for batch in rows:
                term, cf, df = (batch[c].to_pylist() for c in ("term", "cf", "df"))
                assert len(set(zip(term, batch["part"].to_pylist(), strict=True))) == len(term)  # one row each
                if form is None:
                    lists = list(zip(range(len(term)), batch["keys"].to_pylist(), batch["tfs"].to_pylist(), strict=True))
                else:
                    assert set(batch["form"].to_pylist()) <= {form} or size == 2000 or form == 1
                    lists = [(i, [k], [n]) for at, ks, ns in X.unpack(batch["form"].to_numpy(), batch["packed"]) for i, k, n in zip(at.tolist(), ks.to_pylist(), ns.tolist(), strict=True)]
                sums = Counter()
                for i, ks, ns in lists:
                    found += [(term[i], k, n) for k, n in zip(ks, ns, strict=True)]
                    assert {where[k] for k in ks} == {batch["part"][i].as_py()}
                    sums[i, 0] += len(ks)
                    sums[i, 1] += sum(ns)
                assert all((sums[i, 0], sums[i, 1]) == (df[i], cf[i]) for i in range(len(term)))
            assert sorted(found, key=repr) == counted(texts, keys)


def test_probe_sets(spark):
    texts = texts_of(300, seed=8)
    assert X.probe_sets(pa.array(texts), 3, 8192).to_pylist() == [np.packbits(np.isin(np.arange(8192), X.probe_values(t)), bitorder="little").tobytes() for t in texts]
    assert X.probe_lists(pa.array(texts), 4, 1000).to_pylist() == [X.probe_values(t, 4, 1000) for t in texts]
    for literal in ("z09", "ab z", "", "a", "zz" * 40):
        wanted = X.probe_values(literal)
        df = docs_of(spark, list(enumerate(texts))).select("doc_id", X.probe_bits(F.col("text")).alias("p")).where(X.has_probes(F.col("p"), wanted))
        assert {r.doc_id for r in df.collect()} == {i for i, t in enumerate(texts) if set(wanted) <= set(X.probe_values(t))}


def test_a_row_of_postings_per_term_and_batch(spark, tmp_path):
    texts = texts_of(90, seed=4)
    path = f"file://{tmp_path}/ix"
    index.build(docs_of(spark, list(enumerate(texts))).coalesce(1), path)
    every = counted(texts, range(len(texts)))
    rows = spark.read.parquet(f"{path}/segment=0/postings")
    assert rows.count() == len({w for w, _, _ in every}) < len(every) and rows.agg(F.sum("df")).first()[0] == len(every)
    assert sorted(map(tuple, index._posted(spark, path).select("term", "key", "tf").collect()), key=repr) == every
    sorts = plan_of(index._dealt(search.packed_postings(docs_of(spark, [(1, "a")]), "doc_id", 1), 1, 1).select("bucket"))
    assert "Empty2Null" not in sorts and not index._dealt(rows.withColumn("part", F.lit(0)), 1, 1).schema["bucket"].nullable


@pytest.mark.parametrize("kind", ["string", "int", "date"])
def test_keys_of_any_kind(spark, tmp_path, kind):
    texts, path, terms = texts_of(40, seed=6), f"file://{tmp_path}/ix", ["a", "b", "ab", "z_9"]
    key = F.expr({"string": "'k' || doc_id", "int": "cast(doc_id as int)", "date": "date_add(date'2020-01-01', cast(doc_id as int))"}[kind])
    docs = docs_of(spark, [*enumerate(texts), (None, "a b")]).select(key.alias("doc_id"), "text")
    index.build(docs, path)
    read = lambda: [sorted(map(tuple, rows.collect()), key=repr) for rows in (index.search(spark, path, terms), index.bm25(spark, path, terms))]
    want = lambda: [sorted(map(tuple, rows.collect()), key=repr) for rows in (search.any_term(docs, terms, 1000), search.bm25(docs, terms))]
    assert read() == want() and index.search(spark, path, terms).schema["key"].dataType == docs.schema["doc_id"].dataType
    docs = docs.where("doc_id is not null")
    index.build(docs, path)
    index.refresh(docs.limit(3).withColumn("text", F.lit("a new")), path)
    index.refresh(docs, path)
    index.compact(spark, path)
    assert read() == want()
