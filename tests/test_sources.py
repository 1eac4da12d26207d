import json

from factloom.functions import text as X
from factloom.operators import versions
from factloom.sources import files


def test_decoding_by_marks():
    text = "é MOVE 1"
    for codec, mark, name in (("utf-8", b"\xef\xbb\xbf", "utf-8-sig"), ("utf-16-le", b"\xff\xfe", "utf-16-le"), ("utf-16-be", b"\xfe\xff", "utf-16-be"), ("utf-32-le", b"\xff\xfe\x00\x00", "utf-32-le"), ("utf-32-be", b"\x00\x00\xfe\xff", "utf-32-be")):
        assert files.decode(mark + text.encode(codec)) == (text, name, False)
    assert files.decode(b"\xef\xbb\xbfabc\xff") == (None, "damaged", False) and files.decode(b"\xff\xfeabc") == (None, "damaged", False)
    assert files.decode(b"") == ("", "utf-8", False) and files.decode("顧客".encode("cp950"))[1] == "cp950"


def test_listing_catalog_and_prefix(spark, tmp_path):
    root = tmp_path / "src"
    (root / "node_modules").mkdir(parents=True)
    for name, body in (("a.cbl", "one"), ("b.cpy", "two"), ("noext", "three"), ("x.exe", "no"), ("node_modules/c.cbl", "hidden")):
        (root / name).write_text(body)
    name = lambda rows: sorted(r.path.rpartition("/")[2] for r in rows)
    assert name(files.scan(spark, str(root)).collect()) == ["a.cbl", "b.cpy"] and name(files.scan(spark, str(root), extensionless=True).collect()) == ["a.cbl", "b.cpy", "noext"]
    assert {(r.suffix, r.reason, r.n) for r in files.excluded(spark, str(root)).collect()} == {("", "suffix", 1), ("exe", "suffix", 1), ("cbl", "ignored_folder", 1)}
    first = files.catalog(None, spark, str(root))
    rows = [tuple(r) for r in first.collect()]
    known = spark.createDataFrame(rows, first.schema)
    (root / "a.cbl").write_text("changed")
    now = {r.path.rpartition("/")[2]: (r.origin, r.sha256) for r in files.catalog(known, spark, str(root)).collect()}
    assert now["b.cpy"][0] == "kept" and now["a.cbl"][0] == "read" and now["a.cbl"][1] not in {r[4] for r in rows}
    head = {r.path.rpartition("/")[2]: (bytes(r["head"]), r.whole) for r in files.prefix(files.scan(spark, str(root)), 3).collect()}
    assert head == {"a.cbl": (b"cha", False), "b.cpy": (b"two", True)}
    assert name(files.verified(files.scan(spark, str(root)), known).collect()) == ["b.cpy"]


def test_pages_and_sections(spark):
    lines = spark.createDataFrame([("f", i, "x" * n) for i, n in enumerate((3, 3, 20, 1, 1, 1), 1)], "path string, line_no int, line string")
    got = sorted((r.page, r.start_line, r.end_line, r.text) for r in files.pages(lines, 8).collect())
    assert got == [(0, 1, 2, "xxx\nxxx"), (1, 3, 3, "x" * 20), (2, 4, 6, "x\nx\nx")]
    manual = "intro\n# One\ntext\n```\n# no heading\n```\n## Two\nend"
    rows = sorted(tuple(r)[1:6] for r in files.sections(spark.createDataFrame([("m", manual), ("n", None)], "path string, text string")).where("path = 'm'").collect())
    assert rows == [(0, 0, None, 1, 1), (1, 1, "One", 2, 6), (2, 2, "Two", 7, 8)]


def test_snapshots_objects_and_reports(spark, tmp_path):
    schema = "path string, sha256 string, content string"
    local = spark.createDataFrame([("a", "1", "la"), ("b", "2", "lb")], schema)
    remote = spark.createDataFrame([("a", "1", "ra"), ("b", "3", "rb"), ("c", "4", "rc")], schema)
    assert {(r.path, r.content, r.origin) for r in files.next_snapshot(local, remote).collect()} == {("a", "la", "local"), ("b", "rb", "remote"), ("c", "rc", "remote")}
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x")], "k int, body string")
    for _ in range(2):
        named = {r.k: r.object for r in files.put_objects(rows, f"{tmp_path}/objects").collect()}
    assert named[1] == named[3] and {r.body for r in files.get_objects(spark, f"{tmp_path}/objects", [named[1], "0" * 64]).collect()} == {"x"}
    files.write_report(spark.createDataFrame([("a|b", 1), ("c", None)], "name string, n int"), f"{tmp_path}/report", "Title")
    text = [r.value for r in spark.read.text(f"{tmp_path}/report/markdown").collect()]
    assert text[0] == "# Title" and "| name | n |" in text and any("c" in x for x in text[4:]) and spark.read.json(f"{tmp_path}/report/json").count() == 2


def test_unicode_tokens(spark):
    assert X.unicode_tokens("CustomerNo-12 Straße ﬁ") == ["customerno-12", "customer", "no", "12", "strasse", "fi"]
    assert set(X.unicode_tokens("顧客番号")) == {"顧客番号", "顧客番", "客番号", "顧客", "客番", "番号"} and X.unicode_tokens(None) == []
    got = X.with_unicode_tokens(spark.createDataFrame([(1, "Ａ b"), (2, None)], "doc_id long, text string")).collect()
    assert {(r.doc_id, tuple(r.terms)) for r in got} == {(1, ("a", "b")), (2, ())}


def test_version_log(spark, tmp_path):
    log = spark.createDataFrame([("k", "a", 1, "x"), ("k", "b", 2, "y")], "kind string, key string, seq long, data string")
    longer, newest = versions.put(log, spark.createDataFrame([("k", "a", "z"), ("j", "c", "w")], "kind string, key string, data string"))
    assert {tuple(r) for r in longer.collect()} == {("k", "a", 1, "x"), ("k", "b", 2, "y"), ("j", "c", 3, "w"), ("k", "a", 4, "z")}
    assert {(r.key, r.data) for r in newest.collect()} == {("a", "z"), ("b", "y"), ("c", "w")}
    history = spark.createDataFrame([("a", '{"n": "One"}', 1, 3), ("a", '{"n": "Two"}', 3, None), ("b", "{}", 2, None)], "key string, payload string, start_version int, end_version int")
    assert {r.payload for r in versions.at_version(history, 2).collect()} == {'{"n": "One"}', "{}"} and versions.search(versions.at_version(history, 3), "two", 5).first().key == "a"
    assert versions.search(history, "n", 5, after="a").count() == 0
    runs = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "run_id int, started int")
    requests = spark.createDataFrame([(1, "started"), (1, "done"), (3, "started"), (2, "done")], "run_id int, status string")
    assert [r.run_id for r in versions.uncertain(runs, requests).collect()] == [3, 1]
    ledger = spark.createDataFrame([("e1", "a", "1", "old", 1)], "entry_id string, path string, source_sha256 string, payload string, generation int")
    entries = spark.createDataFrame([("e1", "a", "1", "new"), ("e2", "a", "9", "x"), ("e3", "q", "1", "x"), ("e4", "a", "1", None)], "entry_id string, path string, source_sha256 string, payload string")
    kept, refused = versions.accept(ledger, entries, spark.createDataFrame([("a", "1")], "path string, sha256 string"), 2)
    assert [tuple(r) for r in kept.collect()] == [("e1", "a", "1", "new", 2)] and {(r.entry_id, r.reason) for r in refused.collect()} == {("e2", "other_content"), ("e3", "unknown_source"), ("e4", "empty")}
    past = spark.createDataFrame([(1, "s1", 5, 0, 0)], "version int, snapshot_id string, added long, changed long, removed long")
    counts = spark.createDataFrame([(1, 2, 3)], "added long, changed long, removed long")
    assert [tuple(r) for r in versions.record(past, "s2", counts).where("version = 2").collect()] == [(2, "s2", 1, 2, 3)] and versions.record(past, "s1", counts).count() == 1
    assert [r.n for r in versions.batches(spark.range(100), ["id"], 30).groupBy("batch").count().withColumnRenamed("count", "n").collect()] and versions.cached(spark.createDataFrame([("l", "k", 1)], "layer string, key string, v int"), "l", "k").count() == 1
    versions.export(history, f"{tmp_path}/export")
    assert {json.loads(r.value)["key"] for r in spark.read.text(f"{tmp_path}/export").collect()} == {"a", "b"}
