import pytest
from pyspark.sql import functions as F

from factloom.functions import cobol
from factloom.operators import business, facts, investigate

PROGRAM = """program-id. pay.
procedure division.
main.
  move 'SUB1' to ws-target.
  call ws-target.
  if amount > 10
     compute tax = amount * rate
  else
     compute tax = amount * rate
  end-if.
  add tax to total.
  move total to amount.
  evaluate code when 1 when 2 move 0 to tax when other continue end-evaluate.
"""
OTHER = "program-id. sub1.\nprocedure division.\np.\n  move 1 to x.\n"


@pytest.fixture(scope="module")
def found(spark):
    sources = spark.createDataFrame([("/s/pay.cbl", PROGRAM), ("/s/sub1.cbl", OTHER), ("/s/null.cbl", None)], "path string, text string")
    return business.occurrences(sources).cache(), facts.extract(sources).cache()


def test_rules_and_occurrences(spark, found):
    occ, _ = found
    rules = {(r.shape, r.first_line): r for r in business.rules(occ).collect()}
    assert occ.where("shape like 'COMPUTE%'").count() == 2 and sum(s.startswith("COMPUTE") for s, _ in rules) == 2  # other guards, other rules
    assert rules[("EVALUATE CODE", 13)].reads == ["CODE"] and any(g.startswith("evaluate:code:true:1 | 2") for r in occ.where("shape = 'MOVE 0 TO TAX'").collect() for g in r.guards)
    first = business.rules(occ)
    merged = business.merge_rules(first, first).where("shape = 'ADD TAX TO TOTAL'").first()
    assert (merged.occurrences, merged.first_line, merged.writes) == (2, 11, ["TOTAL"])
    assert {(r.table, r.n) for r in business.counts({"rules": first, "none": first.limit(0)}).collect()} == {("rules", first.count()), ("none", 0)}
    assert [r.start_line for r in business.arithmetic(occ, "/s/pay.cbl", 2, 1).collect()] == [7, 9]
    roles = {r.field: (r.writes, r.reads) for r in business.field_roles(occ, 50).collect()}
    assert roles["TAX"] == (3, 1) and roles["AMOUNT"] == (1, 3)
    inside = business.in_scope(occ, spark.createDataFrame([("/s/pay.cbl", 6, 10)], "path string, first int, last int"))
    assert {r.start_line for r in inside.collect()} == {6, 7, 9}
    got = business.leads(occ, spark.createDataFrame([("/s/pay.cbl", 11, 11)], "path string, first int, last int"), ["total"], near=0, per_file=3).collect()
    assert [r.start_line for r in got][0] == 11 and len(got) == 3
    back = {r.field: (r.depth, r.cyclic) for r in business.inputs_of(occ, "/s/pay.cbl", ["TAX"]).collect()}
    assert back["TAX"] == (0, True) and back["AMOUNT"] == (1, True) and back["RATE"] == (1, False) and back["TOTAL"][0] == 2
    assert business.guarded(occ, F.contains("guard", F.lit("amount > 10"))).count() == 2
    assert business.first_write(occ, ["path"], ["start_line", "place"]).count() == 2


def test_identity_and_symbols(spark, found):
    _, all_facts = found
    files = spark.createDataFrame([("/s/pay.cbl",), ("/t/pay.cpy",), ("/s/sub1.cbl",)], "path string")
    programs = all_facts.where("kind = 'program'").select("name", "path")
    got = {r.asked: (r.status, r.paths) for r in investigate.identify(files, programs, ["Pay", "s/sub1.cbl", "pay.cpy", "zz", "sub1"]).collect()}
    assert got["Pay"] == ("resolved", ["/s/pay.cbl"]) and got["s/sub1.cbl"] == ("resolved", ["/s/sub1.cbl"]) and got["pay.cpy"][0] == "resolved" and got["zz"] == ("missing", [])
    identity = investigate.identify(files, programs, ["Pay"])
    assert investigate.scoped(files, identity).count() == 1
    relations = spark.createDataFrame([("/s/pay.cbl", "SUB1", "confirmed", "/s/sub1.cbl"), ("/q", "SUB1", "unresolved", None)], "path string, name string, status string, target string")
    rows = {(r.way, r.source) for r in investigate.inspect(programs, relations, "sub1").collect()}
    assert rows == {("definition", "/s/sub1.cbl"), ("incoming", "/s/pay.cbl"), ("incoming", "/q")}
    assert {(r.field, r.program, r.target) for r in investigate.dynamic_targets(all_facts).collect()} == {("WS-TARGET", "SUB1", "/s/sub1.cbl")}
    definitions = programs.withColumn("kind", F.lit("call")).unionByName(spark.createDataFrame([("TWO", "/a", "call"), ("TWO", "/b", "call")], "name string, path string, kind string"))
    wanted = spark.createDataFrame([("/x", "call", "SUB1"), ("/x", "call", "TWO"), ("/x", "call", "GONE")], "path string, kind string, name string")
    assert {(r.name, r.availability) for r in investigate.available(wanted, definitions).collect()} == {("SUB1", "indexed"), ("TWO", "ambiguous"), ("GONE", "missing")}
    assert [r.q for r in spark.createDataFrame([("list all rules",), ("what is tax",)], "t string").select(investigate.wants_everything(F.col("t")).alias("q")).collect()] == [True, False]
    kinds = spark.createDataFrame([("a",), ("a",), ("c",)], "kind string")
    assert {(r.kind, r.n) for r in investigate.kinds_present(kinds, ["a", "b"]).collect()} == {("a", 2), ("b", 0), ("c", 1)}


def test_discovery_context_and_ranges(spark, found):
    occ, _ = found
    pages = spark.createDataFrame([("f1", 0, 1, 5, "tax rate tax"), ("f1", 1, 6, 9, "nothing"), ("f2", 0, 1, 5, "rate"), ("f3", 0, 1, 5, "zzz")], "path string, page int, start_line int, end_line int, text string")
    edges = spark.createDataFrame([("f1", "f3"), ("f3", "f4"), ("f4", "f5")], "src string, dst string")
    got = {r.path: (r.depth, r.matched, r.score) for r in investigate.discover(pages, ["tax", "rate"], edges, 2).collect()}
    assert got == {"f1": (0, ["rate", "tax"], 3), "f2": (0, ["rate"], 1), "f3": (1, None, None), "f4": (2, None, None)}
    taken = investigate.context(pages, ["tax", "rate"], 13).collect()
    assert [(r.path, r.used, r.truncated) for r in taken] == [("f1", 12, True)] and not investigate.context(pages, ["tax", "rate"], 100).first().truncated
    lines = spark.createDataFrame([("f", i, "abcd") for i in range(1, 10)], "path string, line_no int, line string")
    assert [(r.line_no, r.truncated) for r in investigate.excerpt(lines, "f", 3, 6, 11).orderBy("line_no").collect()] == [(3, True), (4, True)]
    ranges = spark.createDataFrame([("f", 1, 5, 3), ("f", 4, 9, 1), ("f", 10, 12, 2), ("f", 20, 21, 4), ("g", 2, 2, 0), ("f", 2, 3, 9)], "path string, start_line int, end_line int, priority int")
    assert {tuple(r) for r in investigate.merged_ranges(ranges).collect()} == {("f", 1, 12, 1), ("f", 20, 21, 4), ("g", 2, 2, 0)}
    spans = spark.createDataFrame([("f", 1, 5, 3), ("f", 1, 5, 1)], "path string, start_line int, end_line int, rank int")
    assert [tuple(r) for r in investigate.distinct_spans(spans).collect()] == [("f", 1, 5, 1)]
    seen = investigate.seen_by(spark.createDataFrame([("f", "c1", 2, 4), ("f", "c2", 4, 8)], "path string, candidate string, start_line int, end_line int"), spark.createDataFrame([("f", 0, 1, 5)], "path string, page int, start_line int, end_line int"))
    assert [tuple(r) for r in seen.collect()] == [("c1", 0)]
    anchor = occ.where("shape = 'ADD TAX TO TOTAL'").first().occurrence_id
    roles = [(r.start_line, r.role) for r in investigate.evidence(occ, anchor, 5).collect()]
    assert roles[0] == (11, "anchor") and all(role == "writes" for _, role in roles[1:4])
    investigate.register_ranker("longest", F.length("text"))
    assert [r.path for r in investigate.ranked(pages, "longest", 2, "path", "page").collect()] == ["f1", "f1"]


def test_commands_shapes_and_sufficiency(spark):
    texts = [("/l/NIGHT.clle", "CALL PGM(PAY)\nOVRDBF FILE(X) TOFILE(Y)\n"), ("/l/START.clle", "SBMJOB CMD(CALL PGM(NIGHT))\n")]
    found = facts.extract(spark.createDataFrame(texts, "path string, text string"))
    assert [(r.path, r.level) for r in investigate.command_evidence(found, ["pay"], 5).collect()] == [("/l/NIGHT.clle", 0), ("/l/START.clle", 1)]
    rows = spark.createDataFrame([("a", 1, "s1"), ("b", 2, "s1"), ("c", 3, "s2")], "path string, rank int, calls string")
    assert [r.path for r in investigate.diverse(rows, ["calls"]).collect()] == ["a", "c", "b"]
    front = lambda *x: spark.createDataFrame(list(x), "path string, state string")
    assert {tuple(r) for r in investigate.merge_frontier(front(("a", "open"), ("b", "expanded")), front(("a", "expanded"), ("c", "open"))).collect()} == {("a", "expanded"), ("b", "expanded"), ("c", "open")}
    items = spark.createDataFrame([("i", [["u1", "u2"], ["u3"]]), ("j", [["u9"]])], "item string, sets array<array<string>>")
    loaded = spark.createDataFrame([("u1",), ("u2",)], "unit string")
    assert {tuple(r) for r in investigate.sufficient(items, loaded).collect()} == {("i", True, 2), ("j", False, None)}
    gold = spark.createDataFrame([("q", "a", 1)], "query string, key string, relevance int")
    arm = lambda *keys: spark.createDataFrame([("q", k, n) for n, k in enumerate(keys, 1)], "query string, key string, rank int")
    assert {(r.arm, r.mrr) for r in investigate.ablation(gold, {"good": arm("a", "b"), "late": arm("b", "a")}, 5).collect()} == {("good", 1.0), ("late", 0.5)}
    assert cobol.facts("procedure division.\np.\n move 'X' to y.", False)[1].detail["literal"] == "X"


def test_paths_name_what_is_missing(spark):
    from factloom.operators import graph

    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("d", "c"), ("c", "e")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "node string")
    got = {("".join(r.path), r.boundary) for r in graph.paths(edges, seeds, 3).collect()}
    assert got == {("a", None), ("ab", None), ("ad", None), ("abc", None), ("adc", None), ("abca", "cycle"), ("adca", "cycle"), ("abce", None), ("adce", None)}
    assert {r.boundary for r in graph.paths(edges, seeds, 2).collect()} == {None, "depth"} and "limit" in {r.boundary for r in graph.paths(edges, seeds, 3, limit=1).collect()}
