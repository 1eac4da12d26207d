"""Statement trees and data flow: authored programs, and reaching definitions against all paths of random programs."""

import random

import pytest

from factloom.functions import cobol, flow, statements
from factloom.operators import facts
from factloom.operators import flow as tables

PROGRAM = """       PROGRAM-ID. MAIN.
       DATA DIVISION.
       WORKING-STORAGE SECTION.
       01 GRP.
          05 A PIC 9.
          05 B PIC 9.
       01 C PIC 9.
       PROCEDURE DIVISION.
       P1.
           MOVE 1 TO A
           MOVE 2 TO C
           IF A > 1 AND NOT (C = 3 OR C NUMERIC)
              MOVE C TO B
           ELSE
              PERFORM P2
           END-IF
           PERFORM UNTIL C > 9
              ADD 1 TO C
              READ F AT END EXIT PERFORM NOT AT END MOVE 7 TO D END-READ
           END-PERFORM
           CALL 'SUB' USING C BY CONTENT B
           DISPLAY A B C D
           GOBACK.
       P2.
           MOVE A TO B.
"""
SUB = """       PROGRAM-ID. SUB.
       PROCEDURE DIVISION USING X Y.
       S1.
           MOVE Y TO X
           MOVE X TO A.
"""


def lines(g, numbers):
    return sorted(g.nodes[n].start for n in numbers)


def at(g, line):
    return next(n.number for n in g.nodes if n.start == line and n.program == "MAIN")


def test_tree_and_boundaries():
    tree = statements.parse(PROGRAM)
    assert tree.program == "MAIN" and list(tree.paragraphs) == ["P1", "P2"] and tree.boundaries == []
    found = [(p, s.verb, [g.outcome for g in guards]) for p, s, guards, _ in statements.walk(tree)]
    assert ("P1", "MOVE", ["true"]) in found and ("P1", "PERFORM", ["false"]) in found and ("P1", "EXIT", ["true", "true"]) in found
    part = statements.parse("p. move 1 to a. go to p. move 2 to b.\nq. move 3 to c.", False)
    assert [len(x) for x in part.paragraphs.values()] == [1, 1] and [b[3] for b in part.boundaries] == ["GO"]
    assert statements.parse('p. move "a to b.', False).paragraphs == {} and statements.parse("p. move a ~ b.", False).boundaries
    for bad in ("if a = then move 1 to b end-if.", "evaluate x when other move 1 to a when 1 move 2 to b end-evaluate.", "perform until a = 1 move 1 to b.", "compute a = b +.", "move corresponding a to b.", "move 1 to."):
        tree = statements.parse("p. " + bad, False)
        assert tree.paragraphs["P"] == [] and len(tree.boundaries) == 1, bad
    size = statements.parse("p. add 1 to t on size error move 9 to w end-add.", False).paragraphs["P"][0]
    assert size.unknown and size.writes == [] and size.detail["may_write"] == "T" and size.blocks[0][1][0].writes == ["W"]


@pytest.mark.parametrize("text,reads", [
    ("A = 1", ["A"]), ("NOT A = B AND (C > 1 OR D)", ["A", "B", "C", "D"]), ("A (I) OF B", None), ("A OF B (I J) < 3", ["A OF B", "I", "J"]), ("(A + B) * 2 >= C ** 2", ["A", "B", "C"]), ("A IS NOT GREATER THAN OR EQUAL TO B", ["A", "B"]),
    ("A NUMERIC", ["A"]), ("A = ", None), ("A AND", None), ("(A = 1", None), ("ON-FLAG", ["ON-FLAG"]), ("(" * 70 + "A" + ")" * 70, None), ("A B", None),
])
def test_conditions(text, reads):
    assert statements.condition(cobol.lex(text, False)) == reads


def test_arithmetic_forms():
    def one(text):
        s = statements.parse("p. " + text + ".", False).paragraphs["P"][0]
        return s.reads, s.writes

    assert one("add a b to c d") == (["A", "B", "C", "D"], ["C", "D"]) and one("add a b giving c") == (["A", "B"], ["C"]) and one("add a to b giving c rounded") == (["A", "B"], ["C"])
    assert one("subtract a from b giving c") == (["A", "B"], ["C"]) and one("divide a into b") == (["A", "B"], ["B"]) and one("divide a by b giving c remainder d") == (["A", "B"], ["C", "D"])
    assert one("multiply a by b (i)") == (["A", "I", "B"], ["B"]) and one("compute a (k) = - b + 1") == (["K", "B"], ["A"]) and one("move a (i:2) to b c") == (["A", "I"], ["B", "C"])
    assert statements.reference("A OF B (I)") == ["A OF B", "I"] and statements.reference("A +") is None
    assert statements.sentence_terminated("move 1 to a.") and not statements.sentence_terminated('display "x.')


def test_graph_of_a_program():
    known = {"SUB": statements.parse(SUB)}
    g = flow.graph(statements.parse(PROGRAM), known)
    labels = {(g.nodes[a].start, g.nodes[b].start, x) for a, b, x in g.edges}
    assert {(12, 13, "branch:0"), (12, 15, "branch:1"), (15, 25, "perform_entry"), (17, 18, "branch:0"), (17, 21, "branch:1"), (21, 4, "call_entry")} <= labels
    shown = at(g, 22)
    found = {(x, g.nodes[d].program, g.nodes[d].start) for x, d in flow.reaching(g)[shown]}
    assert ("B", "MAIN", 13) in found and ("B", "MAIN", 25) in found and ("C", "SUB", 4) in found and ("C", "MAIN", 18) not in found and ("A", "MAIN", 10) in found
    assert ("SUB::A", "SUB", 5) in found  # the callee's own storage
    assert {10, 11, 12, 13, 17, 18} <= set(lines(g, flow.backward_slice(g, shown)))
    assert set(lines(g, flow.backward_slice(g, at(g, 13), "C"))) == {10, 11, 12, 13}
    assert 22 in lines(g, flow.forward_slice(g, at(g, 10))) and 11 not in lines(g, flow.forward_slice(g, at(g, 10)))
    why = flow.origins(g, shown)
    assert ("A", (at(g, 10),), "constant") in why and {end for name, _, end in why if name == "D"} <= {"input", "constant"}
    told = flow.summary(g)
    assert told["inputs"] == ["D"]
    assert ("file", 19) in {(kind, line) for kind, line, _ in told["external"]}
    explained = flow.explain(g, at(g, 11))
    assert explained["definitions"] == [] and at(g, 13) in explained["read_later"] and at(g, 18) in explained["written_later"]


def test_limits_are_unknown_effects():
    text = "program-id. r.\nprocedure division.\np. perform q. display a.\nq. perform p. call 'r'. call x. perform nowhere.\n"
    g = flow.graph(statements.parse(text, False), {"R": statements.parse(text, False)})
    assert {n.unknown for n in g.nodes if n.unknown} == {"recursion", "dynamic_target", "missing_paragraph"}
    shown = next(n.number for n in g.nodes if n.verb == "DISPLAY")
    assert any(x == flow.ANY for x, _ in flow.reaching(g)[shown]) and any(end == "unknown" for *_, end in flow.origins(g, shown))
    long = "p. " + "move 1 to a. " * 50
    assert flow.graph(statements.parse(long, False), max_nodes=10).nodes[-1].unknown == "too_many_nodes"


def random_body(rng, depth=0):
    out = []
    for _ in range(rng.randint(1, 3)):
        kind = rng.choice("wwwiel" if depth < 2 else "www")
        if kind == "w":
            out.append(f"move {rng.choice('abc1')} to {rng.choice('abc')}")
        elif kind == "i":
            out.append(f"if a = 1 {random_body(rng, depth + 1)}" + (f" else {random_body(rng, depth + 1)}" if rng.random() < 0.6 else "") + " end-if")
        elif kind == "e":
            out.append(f"evaluate b when 1 {random_body(rng, depth + 1)} when 2 when 3 {random_body(rng, depth + 1)} end-evaluate")
        else:
            out.append(f"perform until c = 1 {random_body(rng, depth + 1)} end-perform")
    return " ".join(out)


def test_reaching_equals_all_paths():
    """Every walk of up to two rounds of each loop, by hand: the last writer of each name is what reaches."""
    rng = random.Random(5)
    for _ in range(40):
        g = flow.graph(statements.parse(f"p. {random_body(rng)}. display a b c.", False))
        after = g.successors()
        want = {n.number: set() for n in g.nodes}
        todo, seen = [(0, frozenset())], set()
        while todo:
            k, known = todo.pop()
            if (k, known) in seen:
                continue
            seen.add((k, known))
            want[k] |= known
            own = {w: k for w in g.nodes[k].writes}
            out = frozenset({(x, d) for x, d in known if x not in own} | set(own.items()))
            todo += [(s, out) for s in after[k]]
        assert flow.reaching(g) == want


def test_tables(spark):
    files = spark.createDataFrame([("/m.cbl", PROGRAM), ("/s.cbl", SUB), ("/n.cbl", None)], "path string, text string")
    calls = facts.resolve(facts.extract(files)).where("kind = 'call' and status = 'confirmed'").select("path", "target")
    rows = tables.graphs(tables.with_callees(files, calls)).cache()
    g = flow.graph(statements.parse(PROGRAM), {"SUB": statements.parse(SUB)}, aliases=tables._aliases(PROGRAM))
    mine = rows.where("entry = '/m.cbl'")
    assert {(r.node, r.other, r.label) for r in mine.where("kind = 'edge'").collect()} == set(g.edges)
    shown = at(g, 22)
    seeds = spark.createDataFrame([("/m.cbl", shown)], "entry string, node int")
    assert {r.node for r in tables.slices(rows, seeds).collect()} == flow.backward_slice(g, shown)
    first = at(g, 10)
    assert {r.node for r in tables.slices(rows, spark.createDataFrame([("/m.cbl", first)], "entry string, node int"), forward=True).collect()} == flow.forward_slice(g, first)
    told = tables.program_summary(rows).where("entry = '/m.cbl'").first()
    assert told.inputs == flow.summary(g)["inputs"] and told.outputs == flow.summary(g)["outputs"]
    assert tables._aliases(PROGRAM)["GRP"] == {"A", "B"} and tables._aliases(PROGRAM)["A"] == {"GRP"}


def test_status_checks(spark):
    text = "program-id. m.\nprocedure division.\np.\n call 'io' using st.\n if st = 1 move 1 to x end-if.\n call 'io' using st.\n call 'io' using st.\n display 'end'.\n"
    files = spark.createDataFrame([("/m.cbl", text)], "path string, text string")
    rows = tables.graphs(files.selectExpr("path as entry", "path", "text"))
    got = tables.status_checks(rows, spark.createDataFrame([("IO", "ST")], "target string, status string")).collect()
    assert sorted((r.node, r.finding) for r in got) == [(0, "checked"), (3, "overwritten"), (4, "ignored")]
