"""Composed questions over a corpus: identity of what is asked about, discovery, context under budgets, and evidence.

Each takes tables (lines or pages, facts, edges) and gives rows with what was left out named: a budget that cuts says so,
an ambiguous name stays ambiguous, and no hit is never the same as absence.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.operators import graph, intervals, search

#: Words of a question that ask for a list of everything (kept plain: they are the feature).
EVERYTHING = r"(?i)\b(all|every|each|list|complete|entire|whole|inventory|how many|count)\b"
#: Names that register_ranker has added: name -> score expression.
_RANKERS: dict[str, Column] = {}


def register_ranker(name: str, score: Column) -> None:
    """A named score expression over the columns of what is ranked."""
    _RANKERS[name] = score


def ranked(rows: DataFrame, ranker: str, limit: int, *ties: str) -> DataFrame:
    """The best rows by a registered ranker, ties by the given columns."""
    return rows.withColumn("score", _RANKERS[ranker]).orderBy(F.desc("score"), *ties).limit(limit)


def identify(files: DataFrame, programs: DataFrame, names: Sequence[str]) -> DataFrame:
    """names against programs (name, path) and files (path): asked, status (resolved, ambiguous, missing), paths.

    A name is a program, a path, the end of a path, or a file name with or without its suffix; programs come first.
    """
    spark = files.sparkSession
    asked = spark.createDataFrame([(n, n.upper()) for n in names], "asked string, upper string")
    stem = F.upper(F.regexp_extract("path", r"([^/]+)$", 1))
    aliases = files.select("path", F.explode(F.array_distinct(F.array(F.upper("path"), stem, F.regexp_replace(stem, r"\.[^.]*$", "")))).alias("upper"), F.lit(1).alias("tier"))
    parts = F.split(F.upper("path"), "/")
    ends = files.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("upper"), F.lit(1).alias("tier"))
    known = programs.select("path", F.upper("name").alias("upper"), F.lit(0).alias("tier")).unionByName(aliases).unionByName(ends).distinct()
    hits = asked.join(known, "upper", "left")
    best = hits.withColumn("least", F.min("tier").over(Window.partitionBy("asked"))).where("tier is null or tier = least")
    grouped = best.groupBy("asked").agg(F.array_sort(F.collect_set("path")).alias("paths"))
    n = F.size("paths")
    return grouped.select("asked", F.when(n == 0, "missing").when(n == 1, "resolved").otherwise("ambiguous").alias("status"), "paths")


def scoped(rows: DataFrame, identity: DataFrame) -> DataFrame:
    """rows (path, ...) of what was resolved; all rows if nothing was named."""
    paths = identity.where("status = 'resolved'").select(F.explode("paths").alias("path")).distinct()
    return rows if identity.isEmpty() else rows.join(paths, "path", "left_semi")


def wants_everything(question: Column) -> Column:
    return question.rlike(EVERYTHING)


def kinds_present(artifacts: DataFrame, expected: Sequence[str]) -> DataFrame:
    """kind, n: how many artifacts of each expected or present kind there are; 0 names what is missing."""
    wanted = artifacts.sparkSession.createDataFrame([(k,) for k in expected], "kind string")
    have = artifacts.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    return wanted.join(have, "kind", "full").select("kind", F.coalesce("n", F.lit(0)).alias("n"))


def inspect(symbols: DataFrame, relations: DataFrame, name: str, limit: int = 50) -> DataFrame:
    """way, source, target, status of a symbol (name, path): its definitions, what it refers to, and what refers to it by
    resolved path or, unresolved, by name. A symbol's incoming rows are two equi-joins, not one OR."""
    mine = symbols.where(F.upper("name") == name.upper()).select("name", "path")
    defined = mine.select(F.lit("definition").alias("way"), F.col("path").alias("source"), F.col("name").alias("target"), F.lit("confirmed").alias("status"))
    out = relations.join(mine.select("path").distinct(), "path", "left_semi").select(F.lit("outgoing").alias("way"), F.col("path").alias("source"), F.col("name").alias("target"), "status")
    by_path = relations.join(mine.select(F.col("path").alias("target")).distinct(), "target", "left_semi")
    by_name = relations.where((F.col("status") != "confirmed") & (F.upper("name") == name.upper()))
    incoming = by_path.unionByName(by_name.select(by_path.columns)).select(F.lit("incoming").alias("way"), F.col("path").alias("source"), F.col("name").alias("target"), "status").distinct()
    turn = F.row_number().over(Window.partitionBy("way").orderBy("source", "target", "status"))
    return defined.unionByName(out.distinct()).unionByName(incoming).withColumn("turn", turn).where(F.col("turn") <= limit).drop("turn")


def discover(pages: DataFrame, terms: Sequence[str], edges: DataFrame, max_depth: int = 2, hubs: DataFrame | None = None) -> DataFrame:
    """path, depth, matched, score of all files that hold a term, and those that they depend on (edges src -> dst).

    pages (path, page, text). A file's matched terms are those of all its pages; files found by dependency only have none.
    """
    hits = search.hits(pages.groupBy("path").agg(F.array_join(F.collect_list("text"), "\n").alias("text")), terms, "path")
    matched = hits.groupBy("path").agg(F.array_sort(F.collect_set("term")).alias("matched"), F.sum("tf").alias("score"))
    reached = graph.bfs(edges, matched.select(F.col("path").alias("node")), max_depth, hubs).withColumnRenamed("node", "path")
    return reached.join(matched, "path", "left")


def context(pages: DataFrame, terms: Sequence[str], budget: int, per_file: int = 2) -> DataFrame:
    """path, page, start_line, end_line, text, hits, used, truncated: the best pages under a budget of characters.

    At most per_file pages of a file, files in turn (the first page of each before the second of any), best first; taken in
    that order while they fit. truncated says that something was left out.
    """
    sized = pages.withColumn("hits", sum((F.contains(F.lower("text"), F.lit(t.lower())).cast("int") for t in terms), F.lit(0))).where("hits > 0")
    turn = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("hits"), "page"))
    best = sized.withColumn("turn", turn).where(F.col("turn") <= per_file).orderBy("turn", F.desc("hits"), "path", "page").limit(max(1, budget // 2))
    running = F.sum(F.length("text")).over(Window.orderBy("turn", F.desc("hits"), "path", "page").rowsBetween(Window.unboundedPreceding, 0))  # at most budget / 2 rows
    used = best.withColumn("used", running)
    left = sized.agg(F.count(F.lit(1)).alias("n_hits"))
    taken = used.where(F.col("used") <= budget)
    total = taken.agg(F.count(F.lit(1)).alias("n_taken"))
    return taken.crossJoin(F.broadcast(left)).crossJoin(F.broadcast(total)).withColumn("truncated", F.col("n_taken") < F.col("n_hits")).drop("n_hits", "n_taken", "turn")


def excerpt(lines: DataFrame, path: str, first: int, last: int, budget: int) -> DataFrame:
    """The lines of a range while they fit the budget, and whether any was left out."""
    own = lines.where((F.col("path") == path) & F.col("line_no").between(first, last))
    return search.within_budget(own, "path", "line_no", (F.length("line") + 1).cast("long"), budget)


def merged_ranges(pages: DataFrame) -> DataFrame:
    """path, start_line, end_line, priority: overlapping or touching ranges as one, with the best priority of its parts."""
    before = F.max("end_line").over(Window.partitionBy("path").orderBy("start_line", "end_line").rowsBetween(Window.unboundedPreceding, -1))
    cut = pages.withColumn("before", before)
    found = intervals.islands(cut, "path", F.col("start_line"), F.col("before").isNotNull() & (F.col("start_line") > F.col("before") + 1), "end_line")
    return found.groupBy("path", "island").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.min("priority").alias("priority")).drop("island")


def distinct_spans(pages: DataFrame) -> DataFrame:
    """Pages (path, start_line, end_line, rank) with the same span once, at its best rank."""
    return pages.groupBy("path", "start_line", "end_line").agg(F.min("rank").alias("rank"))


def seen_by(candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """candidate, page of the pages that hold a candidate's whole span (candidates and pages: path, start_line, end_line)."""
    left = candidates.select("path", "candidate", F.col("start_line").alias("l_start"), F.col("end_line").alias("l_end"))
    right = pages.select("path", "page", F.col("start_line").alias("r_start"), F.col("end_line").alias("r_end"))
    return intervals.overlaps(left, right, "path", 64).where("r_start <= l_start and l_end <= r_end").select("candidate", "page").distinct()


def evidence(occurrences: DataFrame, anchor: str, limit: int = 12) -> DataFrame:
    """Occurrences of the anchor's paragraph and of others that read or write the same fields: writers first, nearest
    first; role is anchor, same_paragraph, writes or reads."""
    at = occurrences.where(F.col("occurrence_id") == anchor).select("path", F.col("paragraph").alias("home"), F.col("start_line").alias("here"), F.concat("reads", "writes").alias("wanted"))
    joined = occurrences.join(at, "path")  # one anchor
    role = F.when(F.col("occurrence_id") == anchor, "anchor").when(F.arrays_overlap("writes", "wanted"), "writes").when(F.arrays_overlap("reads", "wanted"), "reads").when(F.col("paragraph") == F.col("home"), "same_paragraph")
    order = F.when(F.col("role") == "anchor", 0).when(F.col("role") == "writes", 1).when(F.col("role") == "reads", 2).otherwise(3)
    return joined.withColumn("role", role).where("role is not null").withColumn("distance", F.abs(F.col("start_line") - F.col("here"))).orderBy(order, "distance", "start_line", "place").limit(limit).drop("home", "here", "wanted")


def available(relations: DataFrame, definitions: DataFrame) -> DataFrame:
    """relations (path, kind, name) with how the target's source is to be had: indexed, ambiguous or missing."""
    known = definitions.groupBy("kind", "name").agg(F.countDistinct("path").alias("n"), F.min("path").alias("source"))
    joined = relations.join(known, ["kind", "name"], "left")
    return joined.select("path", "kind", "name", F.when(F.col("n").isNull(), "missing").when(F.col("n") == 1, "indexed").otherwise("ambiguous").alias("availability"), F.when(F.col("n") == 1, F.col("source")).alias("source"))


def dynamic_targets(found: DataFrame) -> DataFrame:
    """path, field, start_line, program, target: programs that literals moved to a dynamic CALL's field name, as candidates."""
    calls = found.where("kind = 'call' and detail['dynamic'] = 'true'").select("path", F.col("name").alias("field"), "start_line")
    moves = found.where("kind = 'assign' and name = 'MOVE' and detail['literal'] is not null").select("path", F.explode("writes").alias("field"), F.upper(F.col("detail")["literal"]).alias("program"))
    programs = found.where("kind = 'program'").select(F.col("name").alias("program"), F.col("path").alias("target"))
    return calls.join(moves.distinct(), ["path", "field"]).join(programs, "program", "left").select("path", "field", "start_line", "program", "target")


def command_evidence(found: DataFrame, targets: Sequence[str], limit: int) -> DataFrame:
    """CL commands on the targets, and one level up the commands that submit or call their files; direct ones first."""
    commands = found.where("kind = 'command'").select("path", "name", "start_line", F.col("detail")["verb"].alias("verb"))
    direct = commands.where(F.col("name").isin(*[t.upper() for t in targets])).withColumn("level", F.lit(0))
    member = F.upper(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1))
    above = direct.select(member.alias("name")).distinct()
    up = commands.where(F.col("verb").isin("CALL", "SBMJOB")).join(above, "name", "left_semi").withColumn("level", F.lit(1))
    order = F.when(F.col("verb") == "CALL", 0).when(F.col("verb") == "SBMJOB", 1).otherwise(2)
    return direct.unionByName(up.join(direct, ["path", "start_line"], "left_anti").select(direct.columns)).orderBy("level", order, "path", "start_line").limit(limit)


def diverse(paths: DataFrame, shape: list[str]) -> DataFrame:
    """Ranked rows (rank) in an order that shows each shape's best first: the first of every shape, then the second."""
    turn = F.row_number().over(Window.partitionBy(*shape).orderBy("rank"))
    return paths.withColumn("turn", turn).orderBy("turn", "rank")


def merge_frontier(saved: DataFrame, now: DataFrame) -> DataFrame:
    """path, state: frontiers of two runs as one; what either has expanded is expanded."""
    return saved.unionByName(now).groupBy("path").agg(F.max(F.when(F.col("state") == "expanded", 1).otherwise(0)).alias("done")).select("path", F.when(F.col("done") == 1, "expanded").otherwise("open").alias("state"))


def ablation(gold: DataFrame, arms: dict[str, DataFrame], k: int) -> DataFrame:
    """arm, recall, precision, ndcg, mrr: retrieval metrics of several ranked arms against the same gold."""
    from factloom.operators import evaluation

    out = None
    for name, ranked_rows in sorted(arms.items()):
        one = evaluation.metrics(ranked_rows, gold, "query", "key", k).withColumn("arm", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def sufficient(items: DataFrame, loaded: DataFrame) -> DataFrame:
    """items (item, sets: arrays of units), loaded (unit) -> item, sufficient, smallest: is any of its sets wholly loaded,
    and the size of the smallest that is."""
    sets = items.select("item", F.posexplode("sets").alias("number", "units")).withColumn("size", F.size("units"))
    have = sets.select("item", "number", "size", F.explode("units").alias("unit")).join(loaded.select("unit").distinct(), "unit", "left_semi").groupBy("item", "number", "size").agg(F.countDistinct("unit").alias("n"))
    whole = have.where("n = size").groupBy("item").agg(F.min("size").alias("smallest"))
    return items.select("item").distinct().join(whole, "item", "left").select("item", F.col("smallest").isNotNull().alias("sufficient"), "smallest")
