"""Control and data flow of programs as tables: one bounded graph per entry program, joined and sliced across programs.

A program and the programs that it may call are brought together by a bounded closure over confirmed calls; each group is
laid out by functions.flow in one Arrow task, so a graph is bounded by its own node limit, whatever the corpus. What comes
out is rows: nodes, edges and dependencies, keyed by entry and node number. Slices over all programs are closures over the
dependency rows (operators.graph).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import cobol, flow, statements
from factloom.operators import graph
from factloom.storage import materialize

ROWS = "entry string, kind string, node int, other int, label string, program string, paragraph string, start_line int, end_line int, text string, context array<string>, reads array<string>, writes array<string>, unknown string, external string"
_NAMES = [c.split(" ")[0] for c in ROWS.split(", ")]
_LISTS = ("context", "reads", "writes")
_FORM = pa.schema([(c, pa.list_(pa.string()) if c in _LISTS else pa.int32() if c in ("node", "other", "start_line", "end_line") else pa.string()) for c in _NAMES])


def with_callees(files: DataFrame, calls: DataFrame, max_depth: int = 4) -> DataFrame:
    """files (path, text), calls (path, target: path) -> entry, path, text: each file and those that it may reach by calls."""
    edges = calls.where("target is not null").select(F.col("path").alias("src"), F.col("target").alias("dst")).distinct()
    level = materialize(files.select(F.col("path").alias("entry"), "path"), "flow-callees")
    reached = level
    for _ in range(max_depth):
        step = level.join(edges, level.path == edges.src).select("entry", F.col("dst").alias("path")).distinct().join(reached, ["entry", "path"], "left_anti")
        level = materialize(step, "flow-callees")
        if level.isEmpty():
            break
        reached = reached.unionByName(level)
    return reached.join(files.select("path", "text"), "path").select("entry", "path", "text")


def _aliases(text: str) -> dict[str, set[str]]:
    """Names that share storage: a group and what it holds, and both sides of REDEFINES with what they hold."""
    items = [f for f in cobol.facts(text) if f.kind == "item"]
    held: dict[str, set[str]] = {}
    for a, relation, b in cobol.regions(items):
        if relation == "contains":
            held.setdefault(a, set()).add(b)
    below = lambda x: set().union({x}, *(below(y) for y in held.get(x, ())))
    out: dict[str, set[str]] = {}
    for a, relation, b in cobol.regions(items):
        if relation == "contains":
            for x in below(b):
                out.setdefault(a, set()).add(x)
                out.setdefault(x, set()).add(a)
        elif relation == "aliases":
            for x in below(a):
                out.setdefault(x, set()).update(below(b))
            for x in below(b):
                out.setdefault(x, set()).update(below(a))
    return {x: y - {x} for x, y in out.items()}


def graphs(reach: DataFrame, max_nodes: int = flow.MAX_NODES, max_depth: int = flow.MAX_DEPTH) -> DataFrame:
    """entry, path, text -> rows of kind node, edge, dependency, input, output and frontier for each entry program.

    node and other are places in the entry's graph; label is the verb of a node, the label of an edge, why a dependency
    holds, or the name of an input or output.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        entry = key[0].as_py()
        texts = dict(zip(table["path"].to_pylist(), table["text"].to_pylist(), strict=True))
        trees = {p: statements.parse(t or "") for p, t in sorted(texts.items())}
        named: dict[str, list[statements.Tree]] = {}
        for tree in trees.values():
            named.setdefault(tree.program, []).append(tree)
        known = {name: found[0] for name, found in named.items() if name and len(found) == 1}
        g = flow.graph(trees[entry], known, aliases=_aliases(texts[entry] or ""), max_nodes=max_nodes, max_depth=max_depth)
        blank = dict.fromkeys(_NAMES) | {"entry": entry}
        rows = [blank | {"kind": "node", "node": n.number, "other": n.control, "label": n.verb, "program": n.program, "paragraph": n.paragraph, "start_line": n.start, "end_line": n.end, "text": n.text, "context": list(n.context), "reads": n.reads, "writes": n.writes, "unknown": n.unknown, "external": n.external} for n in g.nodes]
        rows += [blank | {"kind": "edge", "node": a, "other": b, "label": label} for a, b, label in g.edges]
        rows += [blank | {"kind": "dependency", "node": a, "other": b, "label": why} for a, b, why in flow.dependencies(g)]
        told = flow.summary(g)
        rows += [blank | {"kind": kind[:-1], "label": x} for kind in ("inputs", "outputs") for x in told[kind]]
        rows += [blank | {"kind": "frontier", "start_line": line, "unknown": why} for line, why in told["unknown"]]
        rows += [blank | {"kind": "frontier", "paragraph": p, "start_line": a, "end_line": b, "unknown": why} for p, a, b, why in trees[entry].boundaries]
        return pa.Table.from_pylist(rows, schema=_FORM)

    return reach.select("entry", "path", "text").groupBy("entry").applyInArrow(run, ROWS)


def _name(entry: str, number: str):
    return F.concat_ws("#", entry, F.col(number).cast("string"))


def slices(rows: DataFrame, seeds: DataFrame, forward: bool = False, max_depth: int = 64) -> DataFrame:
    """rows of graphs(), seeds (entry, node) -> entry, node, depth: what the seeds depend on, or what depends on them."""
    found = rows.where("kind = 'dependency'").select(_name("entry", "node").alias("a"), _name("entry", "other").alias("b"))
    edges = found.select(F.col("b" if forward else "a").alias("src"), F.col("a" if forward else "b").alias("dst"))
    reached = graph.bfs(edges, seeds.select(_name("entry", "node").alias("node")), max_depth)
    return reached.select(F.substring_index("node", "#", 1).alias("entry"), F.substring_index("node", "#", -1).cast("int").alias("node"), "depth")


def program_summary(rows: DataFrame) -> DataFrame:
    """entry, inputs, outputs, external, unknown: sorted sets per program."""
    collect = lambda kind, value: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, value)))
    external = F.when(F.col("external") != "", F.concat_ws(" ", "external", "text"))
    return rows.groupBy("entry").agg(collect("input", F.col("label")).alias("inputs"), collect("output", F.col("label")).alias("outputs"), collect("node", external).alias("external"), collect("frontier", F.concat_ws(" ", F.col("start_line").cast("string"), "unknown")).alias("unknown"))


def status_checks(rows: DataFrame, contracts: DataFrame) -> DataFrame:
    """contracts (target, status: field) -> entry, node, target, status, finding of each external call or file access.

    checked: a condition reads the status that this access set; overwritten: another access sets it and no condition had
    read it; ignored: nothing reads it.
    """
    nodes = rows.where("kind = 'node'")
    access = nodes.where("external <> ''").select("entry", "node", F.explode(F.split(F.regexp_replace("text", "[^A-Za-z0-9_-]+", " "), " ")).alias("word"))
    access = access.join(contracts, F.upper("word") == F.upper("target")).select("entry", "node", "target", F.upper("status").alias("status")).distinct()
    uses = rows.where("kind = 'dependency' and (label like 'data:%' or label = 'unknown')").select("entry", F.col("node").alias("user"), F.col("other").alias("node"), F.when(F.col("label") == "unknown", F.lit(None)).otherwise(F.substring("label", 6, 1_000)).alias("name"))
    tests = nodes.where("label in ('IF', 'EVALUATE', 'PERFORM')").select("entry", F.col("node").alias("user"), F.explode("reads").alias("read"))
    checks = uses.join(tests, ["entry", "user"]).where("name is null or name = read").select("entry", "node", F.col("read").alias("status")).distinct().withColumn("checked", F.lit(True))
    after = rows.where("kind = 'edge'").select("entry", F.col("node").alias("node"), F.col("other").alias("next"))
    again = after.join(access.select("entry", F.col("node").alias("next"), "status"), ["entry", "next"]).select("entry", "node", "status").distinct().withColumn("again", F.lit(True))
    joined = access.join(checks, ["entry", "node", "status"], "left").join(again, ["entry", "node", "status"], "left")
    return joined.select("entry", "node", "target", "status", F.when(F.col("checked"), "checked").when(F.col("again"), "overwritten").otherwise("ignored").alias("finding"))
