"""Queries over whole tables, compared with brute force on small fixtures."""

import re

import pytest

from factloom.plans import registry


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    """A folder with lineitem and supplier, and the edges of all lines; few lines are expensive."""
    rows = [(i, 1 + i % 5, 1 + i * 7 % 23, 1 + i * i % 11, 100_000.0 if i % 9 == 0 else 10.0) for i in range(40)] + [(90, 1, 100, 50, 10.0)]
    path = tmp_path_factory.mktemp("whole")
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_extendedprice double").write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame([(i, 9500.0 if i in (2, 50) else 0.0) for i in range(1, 60)], "s_suppkey long, s_acctbal double").write.parquet(f"{path}/supplier.parquet")
    return str(path), rows, {(f"p{r[2]}", f"s{r[3]}") for r in rows}


def neighbours(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return near


def walk(near, seeds, depth, closed=()):
    found, newest = dict.fromkeys(seeds, 0), set(seeds)
    for d in range(1, depth + 1):
        newest = {n for x in newest if d == 1 or x not in closed for n in near.get(x, ())} - found.keys()
        found.update(dict.fromkeys(newest, d))
    return found


def rows_of(spark, name, path):
    return {tuple(r[c] for c in sorted(r.asDict())) for r in registry.QUERIES[name](spark, path).collect()}


def test_graphs_have_all_lines(spark, lines):
    path, _, edges = lines
    near, seed = neighbours(edges), [min(a for a, _ in edges)]
    sinks = [f"s{i}" for i in (2, 50)]
    assert rows_of(spark, "trace_relations", path) == {(d, n) for n, d in walk(near, seed, 3).items()}
    far = walk(near, sinks, 4)
    assert ("p100" in far) and rows_of(spark, "impact_distance", path) == {(d, n) for n, d in far.items()}
    parent = lambda n: min((m for m in near.get(n, ()) if far.get(m) == far[n] - 1), default=None)
    assert rows_of(spark, "witness_path", path) == {(d, n, parent(n)) for n, d in far.items()}
    two = walk(near, seed, 2)
    hidden = {n: near[n] - two.keys() for n, d in two.items() if d == 2}
    assert rows_of(spark, "outgoing_frontier", path) == {(len(h), n, "depth_limit") for n, h in hidden.items() if h}
    four = walk(near, seed, 4)
    back = {m for n, d in four.items() if d == 1 for m in near[n]}
    assert rows_of(spark, "input_backprop", path) == {(d > 1 and n in back, d, n) for n, d in four.items()}
    hubs = {n for n, m in near.items() if len(m) >= max(8, -(-len(near) // 4))}
    assert rows_of(spark, "hub_limited_closure", path) == {(d, n in hubs, n) for n, d in walk(near, seed, 4, hubs).items()}


def test_calls_bind_at_every_position(spark, lines, tmp_path):
    _, rows, _ = lines
    parts = {p: ("PROMO" if p % 5 == 0 else "STANDARD", 20 + p) for p in range(1, 24)}
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(p, *x) for p, x in parts.items()], "p_partkey long, p_type string, p_size long").write.parquet(f"{tmp_path}/part.parquet")
    want = set()
    for order, position, actual, *_ in rows:
        kind, size = parts.get(actual, ("PROMO", 0))
        status, reason = ("unresolved", "formal_missing") if kind == "PROMO" else ("candidate", "layout_differs") if size >= 40 else ("confirmed", None)
        want.add((actual, None if kind == "PROMO" else actual, order, position, reason, status))
    assert rows_of(spark, "call_binding_positions", str(tmp_path)) == want


def test_cooccurring_terms_of_the_whole_text(spark, tmp_path):
    texts = [" ".join(f"w{i % 20}" for i in range(30)) + " license late", "License late late", "late only", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r.term, r.n) for r in registry.QUERIES["concept_cooccurrence"](spark, str(tmp_path)).collect()]
    assert got == [("late", 2), *sorted((f"w{i}", 1) for i in range(20))]


def test_literals_are_located_whole(spark, tmp_path):
    items = [(0, "a b c d e f g h"), (1, "x y"), (2, "a b c d e f"), (3, ""), (4, None), (5, "y")]
    texts = ["A b, c d e f g h. a b c d e f g h", "a b c d e f only", "c d e f g h", "xx y x y", None]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    tokens = lambda text: re.findall("[a-z0-9_]+", (text or "").lower())
    want = set()
    for item, literal in items:
        for doc, text in enumerate(texts):
            t, x = tokens(literal), tokens(text)
            n = sum(x[i : i + len(t)] == t for i in range(len(x))) if t else 0
            want |= {(doc, item, n)} if n else set()
    assert (0, 0, 2) in want and rows_of(spark, "literal_global_page", str(tmp_path)) == want


def test_hubs_by_share_of_nodes(spark, tmp_path):
    star = [(i, 1, i, s, 10.0) for s, parts in ((1, range(1, 11)), (2, range(10, 13)), (3, [1, 40])) for i in parts]
    spark.createDataFrame(star, "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    edges = {(f"p{x[2]}", f"s{x[3]}") for x in star}
    near = neighbours(edges)
    hubs = {n for n, m in near.items() if len(m) >= max(8, -(-len(near) // 4))}
    assert hubs == {"s1"}
    want = {(d, n in hubs, n) for n, d in walk(near, [min(a for a, _ in edges)], 4, hubs).items()}
    assert rows_of(spark, "hub_limited_closure", str(tmp_path)) == want
