"""Rules and their occurrences: statement shapes, merged across files, and the questions asked of them.

A rule is a shape (file, program, paragraph, kind, normalised text, guards) whose id is a hash; an occurrence is where it
stands. Identical text in two branches is one rule and two occurrences. Rules come from statement trees (functions.
statements), one Arrow task per file; everything after is joins and aggregates.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions import statements
from factloom.functions import text as X
from factloom.operators import intervals

OCCURRENCES = "path string, program string, paragraph string, kind string, shape string, guards array<string>, start_line int, end_line int, place int, reads array<string>, writes array<string>, unknown boolean"
_FORM = pa.schema([("path", pa.string()), ("program", pa.string()), ("paragraph", pa.string()), ("kind", pa.string()), ("shape", pa.string()), ("guards", pa.list_(pa.string())), ("start_line", pa.int32()), ("end_line", pa.int32()), ("place", pa.int32()), ("reads", pa.list_(pa.string())), ("writes", pa.list_(pa.string())), ("unknown", pa.bool_())])
KINDS = {"IF": "condition", "EVALUATE": "condition", "MOVE": "assignment", "COMPUTE": "calculation", "ADD": "calculation", "SUBTRACT": "calculation", "MULTIPLY": "calculation", "DIVIDE": "calculation", "CALL": "call", "EXEC": "sql"}


def occurrences(files: DataFrame) -> DataFrame:
    """files (path, text) -> every statement that is a rule, where it stands and what guards it, with its rule's id.

    A statement's shape is its own words: those of a nested block are not part of it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tree, rows = statements.parse(text or ""), []
                for place, (paragraph, s, guards, _) in enumerate(statements.walk(tree)):
                    if s.verb in KINDS:
                        own = f"{s.verb} {s.detail.get('condition') or s.detail.get('subject')}" if s.verb in ("IF", "EVALUATE") else s.text
                        told = [f"{g.kind}:{g.condition}:{g.outcome}" + (f":{' | '.join(g.alternatives)}" if g.alternatives else "") for g in guards]
                        rows.append({"path": path, "program": tree.program, "paragraph": paragraph, "kind": KINDS[s.verb], "shape": own.upper(), "guards": told, "start_line": s.start, "end_line": s.end, "place": place, "reads": s.reads, "writes": s.writes, "unknown": s.unknown})
                yield pa.RecordBatch.from_pylist(rows, schema=_FORM)

    found = files.select("path", "text").mapInArrow(run, OCCURRENCES)
    rule = X.stable_id("rule", F.col("path"), F.col("program"), F.col("paragraph"), F.col("kind"), F.col("shape"), F.array_join("guards", "\x1e"))
    return found.withColumn("rule_id", rule).withColumn("occurrence_id", X.stable_id("occ", F.col("path"), F.col("place"), F.col("start_line")))


def rules(found: DataFrame) -> DataFrame:
    """One row per rule: first and last line, how often, what it reads and writes. The merge is by minimum, maximum and
    sum, so rules of several batches can be merged again (merge_rules)."""
    return found.groupBy("rule_id", "path", "program", "paragraph", "kind", "shape").agg(
        F.min("start_line").alias("first_line"), F.max("end_line").alias("last_line"), F.count(F.lit(1)).alias("occurrences"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("reads")))).alias("reads"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("writes")))).alias("writes"),
    )


def merge_rules(known: DataFrame, more: DataFrame) -> DataFrame:
    """Rules of two batches as one table."""
    both = known.unionByName(more)
    return both.groupBy("rule_id", "path", "program", "paragraph", "kind", "shape").agg(
        F.min("first_line").alias("first_line"), F.max("last_line").alias("last_line"), F.sum("occurrences").alias("occurrences"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("reads")))).alias("reads"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("writes")))).alias("writes"),
    )


def first_write(facts: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first in the given order."""
    return facts.withColumn("__turn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__turn = 1").drop("__turn")


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """table, n for each of the tables."""
    out = None
    for name, rows in sorted(tables.items()):
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def boundaries(relations: DataFrame, kind: str = "kind") -> DataFrame:
    """How many relations of each type have which status and reason."""
    return relations.groupBy(kind, "status", "reason").agg(F.count(F.lit(1)).alias("n"))


def arithmetic(found: DataFrame, path: str, limit: int, offset: int = 0) -> DataFrame:
    """The calculations and assignments of one file, in order, a page at a time."""
    own = found.where((F.col("path") == path) & F.col("kind").isin("calculation", "assignment"))
    return own.orderBy("start_line", "place").offset(offset).limit(limit)


def field_roles(found: DataFrame, limit: int, per_field: int = 3) -> DataFrame:
    """field, writes, reads, place and its first rules: fields by how often rules write (three times the weight) or read
    them."""
    use = lambda column, role: found.select(F.explode(column).alias("field"), "rule_id", "start_line", "path", F.lit(role).alias("role"))
    uses = use("writes", "write").unionByName(use("reads", "read"))
    ranked = uses.groupBy("field").agg(F.count_if(F.col("role") == "write").alias("writes"), F.count_if(F.col("role") == "read").alias("reads"))
    top = ranked.orderBy(F.desc(3 * F.col("writes") + F.col("reads")), "field").limit(limit)
    firsts = uses.join(top.select("field"), "field", "left_semi").select("field", "rule_id", "path", "start_line").distinct()
    turn = F.row_number().over(Window.partitionBy("field").orderBy("path", "start_line", "rule_id"))
    kept = firsts.withColumn("turn", turn).where(F.col("turn") <= per_field).groupBy("field").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "rule_id"))), lambda x: x["rule_id"]).alias("rules"))
    return top.join(kept, "field")


def in_scope(found: DataFrame, scopes: DataFrame) -> DataFrame:
    """Occurrences that lie wholly in one of the scopes (path, first, last)."""
    spans = found.select("path", "occurrence_id", F.col("start_line").alias("l_start"), F.col("end_line").alias("l_end"))
    marks = scopes.select("path", F.col("first").alias("r_start"), F.col("last").alias("r_end"))
    inside = intervals.overlaps(spans, marks, "path", 64).where("r_start <= l_start and l_end <= r_end").select("occurrence_id").distinct()
    return found.join(inside, "occurrence_id", "left_semi")


def leads(found: DataFrame, previews: DataFrame, terms: list[str], per_file: int = 4, limit: int = 48, near: int = 12) -> DataFrame:
    """Rules near the previews (path, first, last), holding a term, or sharing a field with one near; best first.

    Near counts 4, a term 2 each, a shared field 1; at most per_file of a file and limit in all, ties by place.
    """
    spans = found.select("path", "occurrence_id", F.col("start_line").alias("l_start"), F.col("end_line").alias("l_end"))
    marks = previews.select("path", (F.col("first") - near).alias("r_start"), (F.col("last") + near).alias("r_end"))
    close = intervals.overlaps(spans, marks, "path", 64).select("occurrence_id").distinct().withColumn("close", F.lit(4))
    named = lambda rows: rows.select("path", F.explode(F.concat("reads", "writes")).alias("field"), "occurrence_id")
    fields = named(found.join(close, "occurrence_id", "left_semi")).select("path", "field").distinct()
    shared = named(found).join(fields, ["path", "field"], "left_semi").select("occurrence_id").distinct().withColumn("shared", F.lit(1))
    hits = sum((F.contains(F.lower("shape"), F.lit(t.lower())).cast("int") for t in terms), F.lit(0))
    scored = found.join(close, "occurrence_id", "left").join(shared, "occurrence_id", "left").withColumn("score", F.coalesce("close", F.lit(0)) + F.coalesce("shared", F.lit(0)) + 2 * hits).where("score > 0")
    best = first_write(scored, ["rule_id"], [F.desc("score"), F.col("start_line"), F.col("place")])
    turn = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("score"), "start_line", "place"))
    return best.withColumn("turn", turn).where(F.col("turn") <= per_file).orderBy(F.desc("score"), "path", "start_line", "place").limit(limit).drop("turn", "close", "shared")


def inputs_of(found: DataFrame, path: str, fields: list[str], max_depth: int = 4) -> DataFrame:
    """field, depth, cyclic: what the fields of one file are computed from, back over its writes; cyclic fields come from
    themselves."""
    from factloom.operators import graph

    own = found.where(F.col("path") == path)
    edges = own.select(F.explode("writes").alias("src"), "reads").select("src", F.explode("reads").alias("dst")).distinct()
    seeds = edges.sparkSession.createDataFrame([(f,) for f in fields], "node string")
    reached = graph.bfs(edges, seeds, max_depth)
    ways = graph.paths(edges, reached.select("node"), max_depth)
    back = ways.where("size(path) > 1 and path[0] = node").select("node").distinct().withColumn("cyclic", F.lit(True))
    return reached.join(back, "node", "left").select(F.col("node").alias("field"), "depth", F.coalesce("cyclic", F.lit(False)).alias("cyclic"))


def declarations(found_facts: DataFrame, path: str, fields: list[str]) -> DataFrame:
    """Declarations of fields in one file, by name or by the last part of a qualified one."""
    names = sorted({f.upper().split(" OF ")[0].split(" IN ")[0].strip() for f in fields})
    return found_facts.where((F.col("path") == path) & (F.col("kind") == "item") & F.col("name").isin(*names)).select("path", "name", "start_line", "end_line", "detail")


def guarded(found: DataFrame, condition: Column) -> DataFrame:
    """Occurrences with a guard for which the condition (over a column `guard`) holds."""
    at = found.select("occurrence_id", F.explode("guards").alias("guard")).where(condition).select("occurrence_id").distinct()
    return found.join(at, "occurrence_id", "left_semi")
