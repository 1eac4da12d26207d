from decimal import Decimal

import pytest

from factloom.functions import cobol
from factloom.operators import facts
from factloom.sources import files

MAIN = """       IDENTIFICATION DIVISION.
       PROGRAM-ID. MAINPGM.
       DATA DIVISION.
       WORKING-STORAGE SECTION.
       01  WS-TOTAL   PIC S9(5)V99 COMP-3.
       01  WS-RATE    PIC 9(3).
           COPY BOOK1.
      * a comment with CALL 'NOPE'
       PROCEDURE DIVISION.
       MAIN-PARA.
           MOVE 5 TO WS-RATE
           IF WS-RATE > 3
              COMPUTE WS-TOTAL ROUNDED = WS-RATE * 2
           ELSE
              ADD 1 TO WS-TOTAL
           END-IF
           CALL 'SUBPGM' USING WS-TOTAL BY CONTENT WS-RATE
           CALL WS-NAME
           DISPLAY "it's *> no comment" *> but this is
           PERFORM NEXT-PARA THRU LAST-PARA.
       NEXT-PARA.
           EXEC SQL SELECT A INTO :WS-TOTAL FROM T
             WHERE B = :WS-RATE END-EXEC.
           READ CUSTFILE.
       LAST-PARA.
           GOBACK.
"""
SUB = """       PROGRAM-ID. SUBPGM.
       DATA DIVISION.
       LINKAGE SECTION.
       01  L-A PIC S9(5)V99 COMP-3.
       01  L-B PIC 9(4).
       PROCEDURE DIVISION USING L-A L-B.
       S1.
           MOVE L-A TO L-B.
"""
SOURCES = {"/s/main.cbl": MAIN, "/s/sub.cbl": SUB, "/s/book1.cpy": "       01 B-ITEM PIC X(3).\n           COPY BOOK2.\n", "/s/book2.cpy": "       01 C-ITEM PIC 9.\n           COPY BOOK1.\n"}


def test_program_facts():
    found = cobol.facts(MAIN)
    by = lambda kind: [f for f in found if f.kind == kind]
    assert [f.name for f in by("program")] == ["MAINPGM"] and [f.name for f in by("paragraph")] == ["MAIN-PARA", "NEXT-PARA", "LAST-PARA"]
    assert [(f.name, f.detail.get("pic")) for f in by("item")] == [("WS-TOTAL", "S9(5)V99"), ("WS-RATE", "9(3)")]
    assert [(f.name, f.detail["dynamic"]) for f in by("call")] == [("SUBPGM", "false"), ("WS-NAME", "true")]
    assert by("call")[0].detail["using"] == "reference:WS-TOTAL content:WS-RATE"
    assign = by("assign")
    assert [(f.name, f.reads, f.writes) for f in assign] == [("MOVE", [], ["WS-RATE"]), ("COMPUTE", ["WS-RATE"], ["WS-TOTAL"]), ("ADD", ["WS-TOTAL"], ["WS-TOTAL"])]
    assert assign[1].guards == ["WS-RATE > 3"] and assign[2].guards == ["not WS-RATE > 3"] and assign[0].guards == []
    assert (by("sql")[0].reads, by("sql")[0].writes) == (["WS-RATE"], ["WS-TOTAL"])
    assert by("perform")[0].detail == {"thru": "LAST-PARA"} and by("file")[0].name == "CUSTFILE" and by("copy")[0].name == "BOOK1"


def test_tables(spark):
    found = facts.extract(spark.createDataFrame(list(SOURCES.items()) + [("/s/null.cbl", None)], "path string, text string")).cache()
    resolved = facts.resolve(found)
    got = {(r.path, r.name): (r.status, r.reason) for r in resolved.collect()}
    assert got[("/s/main.cbl", "SUBPGM")] == ("confirmed", None) and got[("/s/main.cbl", "WS-NAME")] == ("unresolved", "dynamic_target")
    assert got[("/s/main.cbl", "BOOK1")] == ("confirmed", None)
    seen = facts.expand(found, resolved).where("path = '/s/main.cbl'").collect()
    assert {(r.item, r.depth) for r in seen if r.boundary is None} == {("WS-TOTAL", 0), ("WS-RATE", 0), ("B-ITEM", 1), ("C-ITEM", 2)}
    assert {r.boundary for r in seen} == {None, "cycle"}
    bound = {r.position: r for r in facts.call_bindings(found).collect()}
    assert (bound[1].formal, bound[1].status, bound[1].may_write_back) == ("L-A", "confirmed", True)
    assert (bound[2].formal, bound[2].status, bound[2].reason, bound[2].may_write_back) == ("L-B", "candidate", "layout_differs", False)
    sources = spark.createDataFrame(list(SOURCES.items()), "path string, text string")
    flow = {(r.field, r.read_line, r.write_line) for r in facts.reaching(sources).where("path = '/s/main.cbl'").collect()}
    assert {("WS-RATE", 13, 11), ("WS-TOTAL", 17, 13), ("WS-TOTAL", 17, 15), ("WS-RATE", 22, None)} <= flow and ("WS-TOTAL", 15, 13) not in flow


def test_bindings_follow_the_resolution(spark):
    """Two programs of one name bind nothing; a name declared twice has no layout."""
    two = {**SOURCES, "/s/sub_b.cbl": SUB.replace("9(4)", "X(2)")}
    found = facts.extract(spark.createDataFrame(list(two.items()), "path string, text string"))
    rows = facts.call_bindings(found).where("callee = 'SUBPGM'").collect()
    assert sorted((r.position, r.formal, r.status, r.reason, r.may_write_back) for r in rows) == [(1, None, "candidate", "several_definitions", False), (2, None, "candidate", "several_definitions", False)]
    twice = {"/s/main.cbl": MAIN.replace("       01  WS-RATE    PIC 9(3).", "       01  WS-RATE    PIC 9(3).\n       01  WS-TOTAL   PIC 9."), "/s/sub.cbl": SUB}
    got = {r.position: (r.status, r.reason) for r in facts.call_bindings(facts.extract(spark.createDataFrame(list(twice.items()), "path string, text string"))).collect()}
    assert got[1] == ("candidate", "layout_unknown")


def test_bad_fragments_and_handlers_yield_no_guesses():
    text = """procedure division.
p.
 move "abc to y.
 move q ~ to r.
 move a to b.
 evaluate x when 1 when 2 move 3 to c when other move 4 to c end-evaluate.
 add 1 to t on size error move 9 to w not on size error move 8 to w end-add.
 read f at end move 1 to eof not at end move 2 to eof end-read move 5 to five.
"""
    found = [f for f in cobol.facts(text, False) if f.kind in ("assign", "boundary")]
    assert [(f.kind, f.start, f.end) for f in found if f.kind == "boundary"] == [("boundary", 3, 4)]
    assert [(f.reads, f.writes, f.guards) for f in found if f.kind == "assign"] == [
        (["A"], ["B"], []), ([], ["C"], ["EVALUATE x = 1 or 2"]), ([], ["C"], ["EVALUATE x = other"]), (["T"], [], []), ([], ["W"], ["SIZE ERROR of ADD at line 7"]), ([], ["W"], ["not SIZE ERROR of ADD at line 7"]),
        ([], ["EOF"], ["AT END of READ at line 8"]), ([], ["EOF"], ["not AT END of READ at line 8"]), ([], ["FIVE"], []),
    ]
    assert found[4].detail == {"rounded": "false", "effects": "unknown", "may_write": "T"}
    assert not cobol.compatible(["EVALUATE x = 1 or 2"], ["EVALUATE x = 3"]) and cobol.compatible(["EVALUATE x = 1 or 2"], ["EVALUATE x = 2"])


def test_parsers_are_registered_and_failures_stay_alone(spark):
    def shout(text):
        if "!" not in text:
            raise ValueError("quiet")
        return [cobol.Fact("program", text.strip("!").upper(), 1, 1)]

    facts.register_parser(".zz", shout)
    try:
        got = facts.extract(spark.createDataFrame([("/a.zz", "one!"), ("/b.zz", "two"), ("/c.cbl", SUB)], "path string, text string")).collect()
    finally:
        del facts._PARSERS["zz"]
    by = {(r.path, r.kind): r.name for r in got}
    assert by["/a.zz", "program"] == "ONE" and by["/b.zz", "failed"] == "ValueError" and by["/c.cbl", "program"] == "SUBPGM"


@pytest.mark.parametrize("value,pic,options,want", [
    ("12.345", "9(3)V99", {}, ("stored", "12.34")), ("12.345", "9(3)V99", {"rounded": True}, ("stored", "12.35")), ("-7.5", "9(3)", {}, ("stored", "7")), ("-7.5", "S9(3)", {"rounded": True}, ("stored", "-8")),
    ("12345", "9(3)", {}, ("truncated", "345")), ("12345", "9(3)", {"on_size_error": True, "old": Decimal(1)}, ("size_error", "1")), ("1", "X(3)", {}, ("unsupported", None)),
])
def test_receivers(value, pic, options, want):
    status, kept = cobol.store(Decimal(value), cobol.picture(pic), **options)
    assert (status, None if kept is None else str(kept)) == want


def test_commands():
    got = cobol.commands("PGM\n /* CALL PGM(NO) */\nCALL PGM(LIB/ONE) +\n  PARM('a(b' &X)\nSBMJOB CMD(CALL PGM(TWO)) JOB(J)\nOVRDBF FILE(F1) TOFILE(L/F2)\n")
    assert [(f.detail["verb"], f.name, f.start, f.end) for f in got] == [("PGM", "", 1, 1), ("CALL", "ONE", 3, 4), ("SBMJOB", "TWO", 5, 5), ("OVRDBF", "F1", 6, 6)]


def test_free_form_and_continuation():
    assert not cobol.is_fixed("program-id. x.\nprocedure division.\n  move a to b.\n")
    tokens = cobol.lex("       MOVE 'abc\n      -    'def' TO X.\n", True)
    assert [t.value for t in tokens] == ["MOVE", "'abcdef'", "TO", "X", "."]


def test_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.cbl").write_text(MAIN)
    (tmp_path / "a/y.cpy").write_bytes("* é".encode("cp1252"))
    (tmp_path / "a/z.cl").write_bytes(b"\x00" * 50)
    (tmp_path / "a/n.exe").write_text("no")
    scanned = files.scan(spark, str(tmp_path))
    assert scanned.count() == 3 and [tuple(r) for r in files.excluded(spark, str(tmp_path)).collect()] == [("exe", "suffix", 1)]
    by = {r.path.rpartition("/")[2]: r for r in files.decoded(scanned).collect()}
    kinds = spark.createDataFrame([("cpy", MAIN), ("cbl", MAIN), ("pf", ""), ("jcl", ""), ("src", "  01 A PIC 9."), ("sql", "select"), ("txt", "x")], "s string, t string")
    assert [r.k for r in kinds.select(files.artifact_kind(kinds.s, kinds.t).alias("k")).collect()] == ["copybook", "cobol_program", "ddl_or_db_file_definition", "job_or_command", "cobol_fragment_or_copybook", "sql_or_ddl", "unclassified_text"]
    assert by["x.cbl"].encoding == "utf-8" and by["y.cpy"].encoding != "utf-8" and by["z.cl"].text is None
