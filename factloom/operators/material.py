"""Joins over what sources say of files, layouts, manuals and effects, and packing under budgets."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions import cobol, explore, flow, statements
from factloom.operators import graph
from factloom.sources import files as sources


def _rows(files: DataFrame, schema: str, fields: list, make) -> DataFrame:
    """One Arrow pass: make(path, text) yields tuples after the path."""
    form = pa.schema([("path", pa.string()), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, *x) for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for x in make(p or "", t or "")]
            yield pa.RecordBatch.from_pylist([dict(zip(form.names, r, strict=True)) for r in rows], schema=form)

    return files.select("path", "text").mapInArrow(run, schema)


def file_relations(files: DataFrame) -> DataFrame:
    """path, owner, relation, name: SELECT, FD and record fields of programs, formats and fields of data descriptions."""
    make = lambda p, t: cobol.dds(t) if p.lower().endswith((".pf", ".lf", ".dds")) else cobol.files_of(t)
    return _rows(files, "path string, owner string, relation string, name string", [(c, pa.string()) for c in ("owner", "relation", "name")], make)


def file_impact(relations: DataFrame, fields: list[str]) -> DataFrame:
    """path, field, record, file, external, described: which files, and which descriptions of them, a field belongs to.

    field -> record -> file -> external name -> description with that member name: equi-joins, left where a link is missing.
    """
    part = lambda r, *names: relations.where(F.col("relation") == r).select("path", F.col("owner").alias(names[0]), F.col("name").alias(names[1]))
    asked = part("field", "record", "field").where(F.col("field").isin(*[f.upper() for f in fields]))
    member = F.upper(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1))
    described = relations.where("relation = 'format'").select(member.alias("external"), F.col("path").alias("described")).distinct()
    chain = asked.join(part("record", "file", "record"), ["path", "record"], "left").join(part("assigned", "file", "external"), ["path", "file"], "left")
    return chain.join(described, "external", "left").select("path", "field", "record", "file", "external", "described")


def layouts(files: DataFrame) -> DataFrame:
    """path, item, line, layout of every declared item: its storage as text, the same for groups laid out alike."""

    def make(path: str, text: str):
        for f in cobol.facts(text):
            if "layout" in f.detail:
                yield f.name, f.start, f.detail["layout"]

    return _rows(files, "path string, item string, line int, layout string", [("item", pa.string()), ("line", pa.int32()), ("layout", pa.string())], make)


def normalized(files: DataFrame) -> DataFrame:
    """path, part, name, value: a program's neutral form (items, storage regions, statements), one row per element."""

    def make(path: str, text: str):
        items = [f for f in cobol.facts(text) if f.kind == "item"]
        yield from (("item", i.name, f"{i.detail.get('level')} {i.detail.get('pic', '')} {i.detail.get('usage', '')}".strip()) for i in items)
        yield from (("region", a, f"{relation} {b}") for a, relation, b in cobol.regions(items))
        yield from (("statement", paragraph, s.text.upper()) for paragraph, s, _, _ in statements.walk(statements.parse(text)))

    return _rows(files, "path string, part string, name string, value string", [(c, pa.string()) for c in ("part", "name", "value")], make)


def compare(expected: DataFrame, candidate: DataFrame) -> DataFrame:
    """side, and the columns, of rows that only one of two normalised forms has (as often as they differ)."""
    return expected.exceptAll(candidate).withColumn("side", F.lit("expected")).unionByName(candidate.exceptAll(expected).withColumn("side", F.lit("candidate")))


def explored(files: DataFrame, max_states: int = 20_000) -> DataFrame:
    """path, line, verb, reached, decided, cut: the statements that abstract execution reaches, and conditions that only
    ever go one way. A statement that is not reached while cut is true may still be."""

    def make(path: str, text: str):
        g = flow.graph(statements.parse(text))
        pictures = {f.name: f.detail["pic"] for f in cobol.facts(text) if f.kind == "item" and "pic" in f.detail}
        found = explore.explore(g, pictures, max_states=max_states)
        for n in g.nodes:
            way = found.decided.get(n.number, set())
            yield n.start, n.verb, n.number in found.reached, next(iter(way)) if len(way) == 1 else None, found.cut

    return _rows(files, "path string, line int, verb string, reached boolean, decided string, cut boolean", [("line", pa.int32()), ("verb", pa.string()), ("reached", pa.bool_()), ("decided", pa.string()), ("cut", pa.bool_())], make)


def call_contexts(resolved: DataFrame, roots: DataFrame, max_depth: int = 6, limit: int = 100_000) -> DataFrame:
    """path, chain, boundary: every chain of confirmed calls from the roots (path); cycles, depth and limits are named."""
    edges = resolved.where("kind = 'call' and status = 'confirmed'").select(F.col("path").alias("src"), F.col("target").alias("dst"))
    return graph.paths(edges, roots.select(F.col("path").alias("node")), max_depth, limit).select(F.col("node").alias("path"), F.col("path").alias("chain"), "boundary")


def in_contexts(findings: DataFrame, contexts: DataFrame) -> DataFrame:
    """findings (entry, ...) with every chain of calls that leads to their program."""
    return findings.join(contexts.select(F.col("path").alias("entry"), "chain"), "entry", "left")


def manual_rules(manual: DataFrame) -> DataFrame:
    """section, row, column, value: the tables of a manual's sections, cell by cell, by the heads of their columns."""
    cut = sources.sections(manual)
    lines = cut.select("path", "section", "heading", F.posexplode(F.split("text", "\n")).alias("at", "line")).where(F.col("line").rlike(r"^\s*\|.*\|\s*$"))
    cells = lines.withColumn("cells", F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x)))
    rule = F.forall("cells", lambda x: x.rlike(r"^:?-+:?$"))
    node = Window.partitionBy("path", "section").orderBy("at")
    table = cells.withColumn("table", F.sum((F.col("at") - F.coalesce(F.lag("at").over(node), F.lit(-9)) > 1).cast("int")).over(node)).withColumn("rule", rule)
    head = F.first("cells").over(Window.partitionBy("path", "section", "table").orderBy("at"))
    turn = F.row_number().over(Window.partitionBy("path", "section", "table").orderBy("at"))
    body = table.withColumn("head", head).withColumn("turn", turn).where("turn > 2 and not rule")
    return body.select("path", "heading", "section", (F.col("turn") - 2).alias("row"), F.explode(F.arrays_zip(F.transform("head", lambda x: F.lower(x)).alias("column"), F.col("cells").alias("value"))).alias("c")).select("path", "heading", "section", "row", "c.column", "c.value")


def operations(rules: DataFrame, columns: tuple[str, ...] = ("program", "function", "status", "effect")) -> DataFrame:
    """Manual rules as operations: one row per table row that names a program, with its other columns, upper case."""
    pick = [F.upper(F.max(F.when(F.col("column") == c, F.col("value")))).alias(c) for c in columns]
    return rules.groupBy("path", "heading", "section", "row").agg(*pick).where(F.col(columns[0]).isNotNull()).withColumnRenamed("path", "manual")


def bind_operations(found: DataFrame, operation_rules: DataFrame) -> DataFrame:
    """CALL facts bound to the operations of their program: by the literal that was moved to a passed name, or, where the
    program has one operation only, by itself. status: confirmed, candidate (several fit), or unresolved."""
    calls = found.where("kind = 'call'").select("path", F.col("name").alias("program"), "start_line", F.split(F.regexp_replace(F.col("detail")["using"], r"\w+:", ""), " ").alias("passed"))
    moved = found.where("kind = 'assign' and detail['literal'] is not null").select("path", F.explode("writes").alias("field"), F.upper(F.col("detail")["literal"]).alias("function")).distinct()
    given = calls.select("path", "program", "start_line", F.explode_outer("passed").alias("field")).join(moved, ["path", "field"], "left").groupBy("path", "program", "start_line").agg(F.collect_set("function").alias("functions"))
    joined = given.join(operation_rules, "program", "left")
    alone = F.count("row").over(Window.partitionBy("path", "program", "start_line"))
    fits = joined.withColumn("known", alone).withColumn("fit", (F.col("row").isNotNull()) & (F.array_contains("functions", F.col("function")) | (F.col("known") == 1)))
    n = F.sum(F.col("fit").cast("int")).over(Window.partitionBy("path", "program", "start_line"))
    bound = fits.withColumn("n", n).where("fit or n = 0")
    status = F.when(F.col("n") == 0, "unresolved").when(F.col("n") == 1, "confirmed").otherwise("candidate")
    keep = lambda c: F.when(F.col("n") > 0, F.col(c)).alias(c)
    return bound.select("path", "program", "start_line", status.alias("state"), keep("function"), keep("status"), keep("effect")).distinct()


def working_set(reached: DataFrame, sizes: DataFrame, budget: int) -> DataFrame:
    """path, depth, size, used, taken: whole files, nearest to the roots first, while they fit the budget.

    reached (path, depth), sizes (path, size). The order is cut before it is summed: a file that starts beyond the budget in
    its own depth cannot be taken, so one task sees no more than depths of the graph and files that may fit.
    """
    rows = reached.join(sizes, "path")
    within = F.sum("size").over(Window.partitionBy("depth").orderBy("path").rowsBetween(Window.unboundedPreceding, 0))
    own = rows.withColumn("within", within)
    depths = rows.groupBy("depth").agg(F.sum("size").alias("total"))
    before = depths.withColumn("before", F.coalesce(F.sum("total").over(Window.orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row per depth
    used = own.join(before.select("depth", "before"), "depth").withColumn("used", F.col("before") + F.col("within"))
    return used.select("path", "depth", "size", "used", (F.col("used") <= budget).alias("taken"))


def obligations(wanted: DataFrame, evidence: DataFrame) -> DataFrame:
    """wanted (need, path, start_line, end_line), evidence (path, start_line, end_line) -> need, spans, covered, open: which
    needs are met by whole spans, and how many spans are still to be read."""
    from factloom.operators import investigate

    pages = evidence.withColumn("page", F.monotonically_increasing_id())
    named = wanted.withColumn("candidate", F.struct("need", "path", "start_line", "end_line"))
    seen = investigate.seen_by(named, pages).select("candidate").distinct().withColumn("seen", F.lit(True))
    return named.join(seen, "candidate", "left").groupBy("need").agg(F.count(F.lit(1)).alias("spans"), F.count("seen").alias("covered")).withColumn("open", F.col("spans") - F.col("covered"))


def handoffs(produced: DataFrame, consumed: DataFrame) -> DataFrame:
    """source, name, target: facts that one program writes (path, name) and another reads, as directed links."""
    left, right = produced.select(F.col("path").alias("source"), "name").distinct(), consumed.select(F.col("path").alias("target"), "name").distinct()
    return left.join(right, "name").where("source <> target").select("source", "name", "target")
