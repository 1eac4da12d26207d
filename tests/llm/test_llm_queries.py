"""Queries of the subpackage that have SQL, on the driver's smallest tables; all of them by their columns."""

import glob
import os

import pytest

from factloom.llm import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    got, want = registry.QUERIES[name](spark, SF), con.sql(registry.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(repr(tuple(r[c] for c in columns)) for r in got.collect()) == sorted(repr(tuple(r[want.columns.index(c)] for c in columns)) for r in want.fetchall())


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES if n != "pipeline") == list(range(1, 11))


def test_held_out_toxicity(spark):
    from factloom.llm import toxicity

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs.where("doc_id % 3 > 0"), labels.where("doc_id % 3 > 0"))
    scored = {r.id: r.score for r in toxicity.score(docs, model).collect()}
    held = [(scored[r.doc_id], r.toxic) for r in labels.where("doc_id % 3 = 0").collect()]
    ones, zeros = [s for s, y in held if y], [s for s, y in held if not y]
    assert sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) / (len(ones) * len(zeros)) > 0.7


def test_toxicity_edges(spark):
    from factloom.llm import toxicity

    docs = spark.createDataFrame([(1, None, 0.5), (1, "", 0.1), (None, "idiot " * 50_000, None)], "doc_id long, text string, score double")
    nothing = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(docs, nothing)
    assert all(r.score < 1e-6 for r in toxicity.score(docs, model).collect())
    assert toxicity.score(docs.limit(0), model).count() == 0
    only = spark.createDataFrame([(1, 1), (None, 0)], "doc_id long, toxic int")
    assert all(r.score > 0.999 for r in toxicity.score(docs, toxicity.train(docs, only)).collect())
