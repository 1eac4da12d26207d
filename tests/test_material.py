import pytest

from factloom.functions import cobol, explore, flow, statements
from factloom.operators import facts, material

PROGRAM = """program-id. m.
environment division.
input-output section.
file-control.
    select custfile assign to "CUSTPF".
data division.
file section.
fd custfile.
01 cust-rec.
   05 cust-no pic 9(5).
   05 cust-name pic x(20).
working-storage section.
01 ws-f pic x(4).
01 n pic 9.
01 grp-a.
   05 a1 pic 9(3) comp-3.
   05 a2 redefines a1 pic x(2).
01 grp-b.
   10 b1 pic 9(3) comp-3.
   10 b2 pic x(2).
procedure division.
p.
    move 1 to n.
    move 'READ' to ws-f.
    if n = 1 move 2 to n else move 3 to n end-if.
    if n > 2 display 'never' end-if.
    call 'IOPGM' using ws-f cust-rec.
    goback.
"""
DDS = "     A          R CUSTFMT                   TEXT('x')\n     A            CUSTNO         5S 0\n     A*           COMMENT\n"
MANUAL = "# Access\n\n| Program | Function | Status | Effect |\n|---|---|---|---|\n| iopgm | read | 00 | reads record |\n| iopgm | save | 00 | writes record |\n\ntext\n\n# Other\n| Program | Effect |\n|---|---|\n| solo | none |\n"


def items(text=PROGRAM):
    return [f for f in cobol.facts(text, False) if f.kind == "item"]


def test_layouts_regions_and_directives():
    own = items()
    by = {own[p].name: held for p, held in cobol.layouts(own).items()}
    assert by["GRP-B"] == [(0, "", "DISPLAY"), (1, "9(3)", "COMP-3"), (1, "X(2)", "DISPLAY")] and by["GRP-A"] == by["GRP-B"]
    assert cobol.overlapping(own, "A1") == {"GRP-A", "A2"} and cobol.overlapping(own, "N") == set() and cobol.unbounded(own) == set()
    lost = items("data division.\n01 g.\n 05 x pic 9.\n01 h redefines gone.\n 05 y pic 9.\n01 z pic 9.\n")
    assert cobol.unbounded(lost) == {"H", "Y"} and cobol.overlapping(lost, "Z") == {"G", "X", "H", "Y"}
    text = "a.\n>>IF DEBUG IS DEFINED\nb.\n>>ELSE\nc.\n>>IF Q = 1\nd.\n>>END-IF\n>>END-IF\ne.\n"
    assert [(n, v) for n, v in cobol.conditional(text, {"debug": True}, False) if n in (1, 3, 5, 7, 10)] == [(1, True), (3, True), (5, False), (7, False), (10, True)]
    assert dict(cobol.conditional(text, {}, False))[7] is None and dict(cobol.conditional(text, {}, False))[3] is False


def test_files_and_descriptions():
    assert ("CUSTFILE", "assigned", "CUSTPF") in cobol.files_of(PROGRAM, False) and ("CUSTFILE", "record", "CUST-REC") in cobol.files_of(PROGRAM, False) and ("CUST-REC", "field", "CUST-NO") in cobol.files_of(PROGRAM, False)
    assert cobol.dds(DDS) == [("", "format", "CUSTFMT"), ("CUSTFMT", "field", "CUSTNO")]


def test_exploration_decides_by_constants():
    g = flow.graph(statements.parse(PROGRAM, False))
    found = explore.explore(g, {"N": "9", "WS-F": "X(4)"})
    never = next(n.number for n in g.nodes if n.verb == "DISPLAY")
    assert never not in found.reached and [sorted(v) for _, v in sorted(found.decided.items())] == [["true"], ["false"]] and not found.cut
    assert never in explore.explore(g, {}).reached  # without pictures nothing is known
    assert explore.explore(g, {"N": "9"}, max_states=2).cut and found.ends[0][1].get("N") is None  # the call is an unknown effect
    assert explore.fits("12", "99") and not explore.fits("123", "99") and not explore.fits("-1", "9") and explore.fits("AB", "X(2)") and not explore.fits("ABC", "XX") and not explore.fits("A", "9")


@pytest.fixture(scope="module")
def tables(spark):
    rows = [("/s/m.cbl", PROGRAM), ("/d/custpf.pf", DDS), ("/s/n.cbl", None)]
    return spark.createDataFrame(rows, "path string, text string")


def test_file_impact_and_forms(spark, tables):
    relations = material.file_relations(tables)
    assert [tuple(r) for r in material.file_impact(relations, ["cust-no"]).collect()] == [("/s/m.cbl", "CUST-NO", "CUST-REC", "CUSTFILE", "CUSTPF", "/d/custpf.pf")]
    same = material.layouts(tables).where("item in ('GRP-A', 'GRP-B')").select("layout").distinct()
    assert same.count() == 1
    form = material.normalized(tables)
    changed = material.normalized(spark.createDataFrame([("/s/m.cbl", PROGRAM.replace("move 1 to n", "move 5 to n"))], "path string, text string"))
    assert sorted((r.side, r.value) for r in material.compare(form.where("path = '/s/m.cbl'"), changed).collect()) == [("candidate", "MOVE 5 TO N"), ("expected", "MOVE 1 TO N")]
    rows = material.explored(tables).collect()
    assert [(r.line, r.reached) for r in rows if r.verb == "DISPLAY"] == [(26, False)] and [r.decided for r in rows if r.verb == "IF"] == ["true", "false"]


def test_manual_rules_bind_calls(spark, tables):
    rules = material.operations(material.manual_rules(spark.createDataFrame([("m.md", MANUAL)], "path string, text string")))
    assert {(r.program, r.function, r.effect) for r in rules.collect()} == {("IOPGM", "READ", "READS RECORD"), ("IOPGM", "SAVE", "WRITES RECORD"), ("SOLO", None, "NONE")}
    found = facts.extract(tables)
    assert [(r.program, r.state, r.function, r.effect) for r in material.bind_operations(found, rules).collect()] == [("IOPGM", "confirmed", "READ", "READS RECORD")]


def test_contexts_budgets_and_handoffs(spark):
    resolved = spark.createDataFrame([("a", "call", "confirmed", "b"), ("b", "call", "confirmed", "c"), ("b", "call", "candidate", "d"), ("c", "call", "confirmed", "a")], "path string, kind string, status string, target string")
    contexts = material.call_contexts(resolved, spark.createDataFrame([("a",)], "path string"), 4)
    assert {("".join(r.chain), r.boundary) for r in contexts.collect()} == {("a", None), ("ab", None), ("abc", None), ("abca", "cycle")}
    found = spark.createDataFrame([("c", "ignored"), ("z", "checked")], "entry string, finding string")
    assert {(r.entry, None if r.chain is None else "".join(r.chain)) for r in material.in_contexts(found, contexts).collect()} == {("c", "abc"), ("z", None)}
    reached = spark.createDataFrame([("a", 0), ("b", 1), ("c", 1), ("d", 2)], "path string, depth int")
    sizes = spark.createDataFrame([("a", 10), ("b", 5), ("c", 9), ("d", 1)], "path string, size int")
    assert {(r.path, r.used, r.taken) for r in material.working_set(reached, sizes, 16).collect()} == {("a", 10, True), ("b", 15, True), ("c", 24, False), ("d", 25, False)}
    wanted = spark.createDataFrame([("n1", "f", 2, 4), ("n1", "f", 8, 9), ("n2", "f", 1, 3)], "need string, path string, start_line int, end_line int")
    seen = spark.createDataFrame([("f", 1, 5)], "path string, start_line int, end_line int")
    assert {tuple(r) for r in material.obligations(wanted, seen).collect()} == {("n1", 2, 1, 1), ("n2", 1, 1, 0)}
    links = material.handoffs(spark.createDataFrame([("p", "X"), ("q", "X")], "path string, name string"), spark.createDataFrame([("q", "X")], "path string, name string"))
    assert [tuple(r) for r in links.collect()] == [("p", "X", "q")]
