"""Facts of source files as rows, and what follows from them: resolution, expansion and call bindings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import cobol, flow, statements
from factloom.operators import graph

FACTS = "path string, kind string, name string, scope string, start_line int, end_line int, detail map<string,string>, reads array<string>, writes array<string>, guards array<string>"


Parser = Callable[[str], "list[cobol.Fact]"]
_PARSERS: dict[str, Parser] = {suffix: cobol.commands for suffix in ("cl", "clle", "clp")}


def register_parser(suffix: str, parser: Parser) -> None:
    """Use parser (text -> facts) for files of a suffix, in extractions that begin after this."""
    _PARSERS[suffix.lower().lstrip(".")] = parser


def extract(files: DataFrame) -> DataFrame:
    """files (path, text) -> one row per fact; a file's parse is bounded by the file, and a null text has no facts.

    A file whose parser fails has one fact of kind `failed` with the error, and nothing else.
    """
    parsers = dict(_PARSERS)
    form = pa.schema([("path", pa.string()), ("kind", pa.string()), ("name", pa.string()), ("scope", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("detail", pa.map_(pa.string(), pa.string())), *((c, pa.list_(pa.string())) for c in ("reads", "writes", "guards"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parse = parsers.get((path or "").lower().rpartition(".")[2], cobol.facts)
                try:
                    found = list(parse(text or ""))
                except Exception as error:  # noqa: BLE001  one file must not fail the others
                    found = [cobol.Fact("failed", type(error).__name__, 0, 0, "", {"error": str(error)})]
                rows = [{"path": path, "kind": f.kind, "name": f.name, "scope": f.scope, "start_line": f.start, "end_line": f.end, "detail": list(f.detail.items()), "reads": f.reads, "writes": f.writes, "guards": f.guards} for f in found]
                yield pa.RecordBatch.from_pylist(rows, schema=form)

    return files.select("path", "text").mapInArrow(run, FACTS)


def statuses(wanted: DataFrame, definitions: DataFrame, on: list[str], target: str, open_when: Column | None = None) -> DataFrame:
    """wanted with n, status, reason and target: how many definitions (on, target) a name has.

    One is confirmed, several are candidates, none is unresolved; rows where open_when holds are unresolved before anything
    is counted. Definitions are counted before the join, so a name with many of them costs one row.
    """
    known = definitions.groupBy(*on).agg(F.countDistinct(target).alias("n"), F.min(target).alias("target"))
    joined = wanted.join(known, on, "left")
    n = F.col("n") if open_when is None else F.when(open_when, F.lit(None)).otherwise(F.col("n"))
    reason = F.when(n.isNull(), "no_definition").when(n > 1, "several_definitions")
    reason = reason if open_when is None else F.when(open_when, "dynamic_target").otherwise(reason)
    return joined.select(*wanted.columns, n.alias("n"), F.when(n.isNull(), "unresolved").when(n == 1, "confirmed").otherwise("candidate").alias("status"), reason.alias("reason"), F.when(n == 1, F.col("target")).alias("target"))


def resolve(found: DataFrame) -> DataFrame:
    """CALL and COPY targets: confirmed for one definition, candidate for several, unresolved for none or a data name."""
    programs = found.where("kind = 'program'").select(F.lit("call").alias("kind"), "name", F.col("path").alias("file"))
    books = found.select("path").distinct().select(F.lit("copy").alias("kind"), F.upper(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)).alias("name"), F.col("path").alias("file"))
    wanted = found.where("kind in ('call', 'copy')").select("path", "kind", "name", "start_line", F.coalesce(F.col("detail")["dynamic"] == "true", F.lit(False)).alias("dynamic"))
    return statuses(wanted, programs.union(books), ["kind", "name"], "file", F.col("dynamic")).select("path", "kind", "name", "start_line", "status", "reason", "target")


def expand(found: DataFrame, resolved: DataFrame, max_depth: int = 8, limit: int = 1_000_000) -> DataFrame:
    """Data items that each file sees through confirmed COPY, with the ways they came: path, item, pic, via, depth, boundary.

    A way that returns to a file on it ends there with boundary `cycle`; one at max_depth that would go on ends with
    `depth`, one in a level of more than `limit` ways with `limit` (ways multiply where books share books).
    """
    copies = resolved.where("kind = 'copy' and status = 'confirmed'").select(F.col("path").alias("src"), F.col("target").alias("dst")).distinct()
    ways = graph.paths(copies, found.select(F.col("path").alias("node")).distinct(), max_depth, limit)
    reached = ways.select(F.col("path")[0].alias("path"), F.col("node").alias("at"), F.col("path").alias("via"), "boundary")
    items = found.where("kind = 'item'").select(F.col("path").alias("at"), F.col("name").alias("item"), F.col("detail")["pic"].alias("pic"))
    return reached.join(items, "at", "left").where("item is not null or boundary is not null").select("path", "item", "pic", "via", (F.size("via") - 1).alias("depth"), "boundary")


def positions(actual: DataFrame, formal: DataFrame, on: list[str], callee: list[str]) -> DataFrame:
    """actual (on, position, ...) bound to formal (callee, formal_position, formal, ...) of one definition by position; a
    formal without formal_position stands at every one.

    Both sides are dealt out and the formals of a part are hashed, so a task holds its part of the formals and neither sorts
    nor keeps the actuals, which are many more.
    """
    pairs = zip([*on, "position"], [*callee, "formal_position"], strict=True) if "formal_position" in formal.columns else zip(on, callee, strict=True)
    return actual.join(formal.hint("shuffle_hash"), [actual[a] == formal[c] for a, c in pairs], "left")


def call_bindings(found: DataFrame) -> DataFrame:
    """Actual parameters bound to formal ones by position; BY REFERENCE may write back, as a candidate.

    The callee is what resolve() says: a confirmed one binds; several definitions, none, or a data name leave every
    position as resolved (candidate or unresolved, with the same reason), and nothing is bound to any of them. Layouts are
    compared whole (pictures, usages and depths of all that a group holds); an item name that a file declares more than
    once has none to compare.
    """
    calls = resolve(found).where("kind = 'call'").select("path", F.col("name").alias("callee"), "start_line", F.col("status").alias("resolved"), F.col("reason").alias("why"), F.col("target").alias("callee_path"))
    actual = found.where("kind = 'call' and detail['using'] <> ''").select("path", "start_line", F.col("name").alias("callee"), F.posexplode(F.split(F.col("detail")["using"], " ")).alias("position", "one"))
    actual = actual.withColumn("mode", F.substring_index("one", ":", 1)).withColumn("actual", F.substring_index("one", ":", -1)).drop("one")
    actual = actual.join(calls.distinct(), ["path", "callee", "start_line"])
    formal = found.where("kind = 'signature'").select(F.col("path").alias("formal_path"), F.col("name").alias("formal_program"), F.posexplode(F.split(F.col("detail")["using"], " ")).alias("formal_position", "formal"))
    bound = positions(actual, formal, ["callee_path", "callee"], ["formal_path", "formal_program"])
    items = found.where("kind = 'item'").groupBy("path", F.col("name").alias("item")).agg(F.when(F.count(F.lit(1)) == 1, F.first(F.col("detail")["layout"])).alias("layout"))
    bound = bound.join(items.select("path", F.col("item").alias("actual"), F.col("layout").alias("actual_layout")), ["path", "actual"], "left")
    bound = bound.join(items.select(F.col("path").alias("callee_path"), F.col("item").alias("formal"), F.col("layout").alias("formal_layout")), ["callee_path", "formal"], "left")
    missing, literal = F.col("formal").isNull(), F.col("actual") == "literal"
    unknown = F.col("actual_layout").isNull() | F.col("formal_layout").isNull()
    differs = F.col("actual_layout") != F.col("formal_layout")
    resolved = F.col("resolved") == "confirmed"
    status = F.when(~resolved, F.col("resolved")).when(missing, "unresolved").when(literal | unknown | differs, "candidate").otherwise("confirmed")
    reason = F.when(~resolved, F.col("why")).when(missing, "formal_missing").when(literal, "literal").when(unknown, "layout_unknown").when(differs, "layout_differs")
    return bound.select("path", "start_line", "callee", (F.col("position") + 1).alias("position"), "mode", "actual", "formal", status.alias("status"), reason.alias("reason"), (resolved & ~missing & ~literal & (F.col("mode") == "reference")).alias("may_write_back"))


def reaching(files: DataFrame, max_nodes: int = flow.MAX_NODES) -> DataFrame:
    """files (path, text) -> path, read_line, field, write_line: the definitions that may reach each read, over the
    program's control flow with its PERFORMs inlined; write_line is null for an effect that is not known."""
    form = pa.schema([("path", pa.string()), ("field", pa.string()), ("read_line", pa.int32()), ("write_line", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                g = flow.graph(statements.parse(text or ""), max_nodes=max_nodes)
                come = flow.reaching(g)
                rows = {(f, n.start, None if x == flow.ANY else g.nodes[d].start) for n in g.nodes for f in n.reads for x, d in come[n.number] if x in (f, flow.ANY)}
                yield pa.RecordBatch.from_pylist([{"path": path, "field": f, "read_line": r, "write_line": w} for f, r, w in sorted(rows, key=repr)], schema=form)

    return files.select("path", "text").mapInArrow(run, "path string, field string, read_line int, write_line int")
