import pytest

from factloom.functions import cobol
from factloom.operators import versions


def test_replacing_and_expansion():
    assert cobol.replacing_pairs("COPY B REPLACING ==:T:== BY ==WS==, OLD BY NEW.") == [(":T:", "WS"), ("OLD", "NEW")]
    assert cobol.replace("  01 OLD PIC X.\n  02 OLD-2 PIC 9.", [("OLD", "NEW")], False) == "  01 NEW PIC X.\n  02 OLD-2 PIC 9."
    sources = {"main": "program-id. m.\ncopy bk replacing a by b.\nmove 1 to x.\ncopy gone.\n", "BK": "01 a pic 9.\ncopy bk2.\n", "BK2": "01 c pic 9.\ncopy bk.\n"}
    rows, stops = cobol.expand_copies("main", sources)
    assert [(f, n, c.strip()) for f, n, c, _ in rows] == [("main", 1, "program-id. m."), ("BK", 1, "01 b pic 9."), ("BK2", 1, "01 c pic 9."), ("main", 3, "move 1 to x.")]
    assert rows[2][3] == "main/BK/BK2" and stops == [("BK", "cycle"), ("GONE", "missing")]
    assert cobol.expand_copies("main", sources, max_depth=1)[1][0] == ("BK2", "depth")


@pytest.mark.parametrize("expression,want", [
    ("A IS DEFINED", True), ("Z IS DEFINED", False), ("Z IS NOT DEFINED", True), ("A", True), ("Z", None), ("Z OR A", True), ("Z AND A", None), ("Z AND NOT A", False), ("M = 'X'", True), ("M = 'Y'", False), ("Q = 1", None), ("(A OR Z) AND NOT (M = 'Y')", True), ("A +", None), ("A A", None),
])
def test_condition_values(expression, want):
    assert cobol.condition_value(expression, {"a": True, "m": "x"}) is want


def items():
    text = "DATA DIVISION.\n01 REC.\n  05 GRP-A.\n    10 F PIC 9.\n    88 F-ON VALUE 1.\n  05 GRP-B REDEFINES GRP-A.\n    10 F PIC X.\n77 ALONE PIC 9.\n"
    return [f for f in cobol.facts(text, False) if f.kind == "item"]


def test_regions_and_binding():
    assert cobol.regions(items()) == [("REC", "contains", "GRP-A"), ("GRP-A", "contains", "F"), ("F", "condition", "F-ON"), ("REC", "contains", "GRP-B"), ("GRP-B", "aliases", "GRP-A"), ("GRP-B", "contains", "F")]
    assert cobol.bind("F", items())[0] == "ambiguous" and cobol.bind("F OF GRP-B", items()) == ("bound", [5])
    assert cobol.bind("F IN GRP-A OF REC", items()) == ("bound", [2]) and cobol.bind("F OF REC OF GRP-A", items())[0] == "unresolved"
    assert cobol.bind("ALONE", items())[0] == "bound"


def test_mask_sql():
    code = "SELECT ':no''t', :yes -- :no\n/* :no */ FROM t"
    masked, closed = cobol.mask_sql(code)
    assert len(masked) == len(code) and closed and ":no" not in masked and masked.index(":yes") == code.index(":yes")
    assert cobol.mask_sql("a 'open")[1] is False and cobol.mask_sql("/* x")[1] is False


def test_commit_is_scd2_and_idempotent(spark):
    history = spark.createDataFrame([("a", "1", 1, None), ("b", "1", 1, None), ("c", "0", 1, 2), ("c", "1", 2, None)], "k string, payload string, start_version int, end_version int")
    changed = spark.createDataFrame([("a", "2"), ("b", "1"), ("d", "1")], "k string, payload string")
    once = versions.commit(history, changed, "k", 5)
    want = {("a", "1", 1, 5), ("a", "2", 5, None), ("b", "1", 1, None), ("c", "0", 1, 2), ("c", "1", 2, None), ("d", "1", 5, None)}
    assert {tuple(r) for r in once.collect()} == want
    assert {tuple(r) for r in versions.commit(once, changed, "k", 5).collect()} == want


def test_changes(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "k string, h string")
    assert tuple(versions.changes(rows(("a", "1"), ("b", "1")), rows(("b", "2"), ("c", "1")), "k", "h").first()) == (1, 1, 1)
