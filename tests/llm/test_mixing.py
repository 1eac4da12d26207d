import hashlib
import random
from collections import defaultdict

import duckdb
import pytest

from factloom.llm import mixing
from factloom.llm.mixing import Plan

PLANS = [
    Plan(share=(1, 2), domains={"a": "web", "b": "web"}, domain_weights={"web": 3}, lang_weights={"en": 5}, source_weights={"c": 0, "a": 7}),
    Plan(share=(9, 10), max_epochs=1, seed=7),
    Plan(share=(3, 1), max_epochs=3),
    Plan(share=(1, 50), max_epochs=2, domains={"a": "x", "b": "y", "c": "z"}, domain_weights={"x": 100}),
]


def rows(n=400):
    rng = random.Random(2)
    out = [(i, "w" * rng.choice([0, 1, 40, 400, 3000]), rng.choice(["en", "en", "de", None]), rng.choice(["a", "a", "a", "b", "c", None]), "keep") for i in range(n)]
    return out + [(3, "dup " * 10, "en", "a", "keep"), (3, "dup " * 10, "en", "a", "keep"), (None, "none", "en", "a", "keep"), (n + 1, None, "de", "b", "keep")]


def fill(budget, children):
    """Water-filling in steps: whoever is full leaves, the others share anew. children: name -> (cap, weight)"""
    given, left = {}, dict(children)
    while left:
        weights = sum(w for _, w in left.values())
        full = [k for k, (c, w) in left.items() if (budget - sum(given.values())) * w >= c * weights]
        if not full:
            free = budget - sum(given.values())
            given |= {k: free * w // weights for k, (_, w) in left.items()}
            break
        for k in full:
            given[k] = left.pop(k)[0]
    return given


def brute(data, plan):
    leaf = defaultdict(list)
    for i, text, lang, source, _ in data:
        leaf[plan.domains.get(source or "", plan.other), lang or "", source or ""].append((i, -(-len((text or "").encode()) // 4)))
    caps = {k: plan.max_epochs * sum(n for _, n in v) for k, v in leaf.items()}
    weight = lambda k, m: m.get(k, plan.default_weight)
    caps = {k: c for k, c in caps.items() if weight(k[0], plan.domain_weights) and weight(k[1], plan.lang_weights) and weight(k[2], plan.source_weights)}
    cap = lambda *p: sum(c for k, c in caps.items() if k[: len(p)] == p)
    budget = min(sum(n for v in leaf.values() for _, n in v) * plan.share[0] // plan.share[1], cap())
    out = []
    for d, b in fill(budget, {d: (cap(d), weight(d, plan.domain_weights)) for d in {k[0] for k in caps}}).items():
        for la, b2 in fill(b, {x: (cap(d, x), weight(x, plan.lang_weights)) for x in {k[1] for k in caps if k[0] == d}}).items():
            for s, b3 in fill(b2, {x: (cap(d, la, x), weight(x, plan.source_weights)) for x in {k[2] for k in caps if k[:2] == (d, la)}}).items():
                own = leaf[d, la, s]
                size = sum(n for _, n in own)
                whole = min(b3 // size, plan.max_epochs) if size else 0
                out += [(i, e) for e in range(whole) for i, _ in own]
                rest = b3 - whole * size if whole < plan.max_epochs else 0
                key = lambda i: hashlib.sha256(f"{plan.seed}:{whole}:{'' if i is None else i}".encode()).hexdigest()  # noqa: B023, E731
                for i, _ in own if rest > 0 else ():
                    if sum(n for j, n in own if key(j) <= key(i)) <= rest:
                        out.append((i, whole))
    return sorted(out, key=str)


@pytest.mark.parametrize("plan", PLANS)
@pytest.mark.parametrize("slice_rows", [20_000, 3])
def test_equals_brute_force_and_sql(spark, plan, slice_rows, monkeypatch):
    monkeypatch.setattr(mixing, "SLICE_ROWS", slice_rows)
    data = rows()
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, epoch string").repartition(3)
    want = brute(data, plan)
    assert sorted(((r.id, r.epoch) for r in mixing.mix(docs, plan).collect()), key=str) == want
    kept = mixing.mix_rows(docs, plan)
    assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect()), key=str) == sorted((i for i, _ in want), key=str)
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    assert sorted(con.sql("SELECT id, epoch FROM (" + mixing.sql(plan) + ")").fetchall(), key=str) == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert mixing.mix(docs, Plan()).count() == 0 and mixing.mix_rows(docs, Plan()).count() == 0
