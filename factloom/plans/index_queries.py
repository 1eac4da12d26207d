"""Queries over a persisted search index, and over operators whose tables are built from the driver's.

The index of a folder of tables is built once per application and read by every question after that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import business, corpus, graph, index, investigate, search, versions
from factloom.plans.fact_queries import _CONTAINS, _contains
from factloom.plans.registry import query
from factloom.plans.text_queries import _BM25, _IN, _LINE_ROWS, _OLD, _SHA, _TOKENS, TERMS
from factloom.storage import fresh_path, table

_BUILT: dict[tuple[str, str, str], str] = {}


def _index(spark: SparkSession, sf_dir: str, kind: str = "documents") -> str:
    """The path of the index of sf_dir's documents; kind `refreshed` is one that went from an older snapshot to a newer."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _BUILT:
        path, docs = fresh_path(spark, "index"), table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
        if kind == "documents":
            index.build(docs.drop("lang"), path)
        else:
            index.build(docs.where("lang <> 'es'").select("doc_id", F.translate("text", "#$%&*", "").alias("text")), path)
            index.refresh(docs.where("lang <> 'de'").drop("lang"), path, removed=docs.where("lang = 'de'").select("doc_id"))
        _BUILT[key] = path
    return _BUILT[key]


_ANY = lambda docs: f"SELECT doc_id, string_agg(term, ' ' ORDER BY term) AS matched, count(*) AS score FROM (SELECT DISTINCT doc_id, unnest({_TOKENS}) AS term FROM {docs}) t WHERE term IN ({_IN(TERMS)}) GROUP BY doc_id ORDER BY score DESC, doc_id"


@query("index_search", f"{_ANY('documents')} LIMIT 100 OFFSET 20")
def index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.search(spark, _index(spark, sf_dir), TERMS, 100, 20).withColumnRenamed("key", "doc_id")


@query("index_bm25", f"WITH {_BM25(TERMS)} SELECT doc_id, score FROM bm ORDER BY score DESC, doc_id LIMIT 50")
def index_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.bm25(spark, _index(spark, sf_dir), TERMS).withColumnRenamed("key", "doc_id").orderBy(F.desc("score"), "doc_id").limit(50)


@query("index_refreshed_search", _ANY("(SELECT * FROM documents WHERE lang <> 'de') d"))
def index_refreshed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All hits after a refresh that changed, added and removed texts."""
    return index.search(spark, _index(spark, sf_dir, "refreshed"), TERMS).withColumnRenamed("key", "doc_id")


@query("index_coverage", f"SELECT (SELECT count(*) FROM documents) AS indexed, 0::BIGINT AS stale, 0::BIGINT AS missing, 0::BIGINT AS orphaned, count(DISTINCT term) AS terms, count(*) AS postings FROM (SELECT DISTINCT doc_id, unnest({_TOKENS}) AS term FROM documents) t")
def index_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.coverage(table(spark, sf_dir, "documents"), _index(spark, sf_dir))


@query("index_stale", f"WITH {_OLD} SELECT count(*) FILTER (o.sha256 = n.sha256) AS indexed, count(*) FILTER (o.sha256 <> n.sha256) AS stale, count(*) FILTER (n.sha256 IS NULL) AS missing, count(*) FILTER (o.sha256 IS NULL) AS orphaned FROM old o FULL JOIN new n USING (doc_id)")
def index_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the index of the newer snapshot stands to the texts of the older one."""
    old = table(spark, sf_dir, "documents").where("lang <> 'es'").withColumn("text", F.translate("text", "#$%&*", ""))
    return index.standing(old, _index(spark, sf_dir, "refreshed"))


@query("index_file_page", f"SELECT doc_id, {_SHA} AS sha256, length(coalesce(text, '')) AS chars FROM documents WHERE doc_id > 40 ORDER BY doc_id LIMIT 30")
def index_file_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.page_of_files(spark, _index(spark, sf_dir), 30, 40).select(F.col("key").alias("doc_id"), "sha256", "chars")


@query("index_locate", f"WITH {_LINE_ROWS} SELECT doc_id, line_no, line FROM l WHERE contains(lower(line), 'licen') AND (doc_id, line_no) > (30, 2) ORDER BY doc_id, line_no LIMIT 40")
def index_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next page of lines with a literal, after a cursor: by n-gram probes, then verified."""
    return index.locate_global(table(spark, sf_dir, "documents"), _index(spark, sf_dir), "Licen", 40, after=(30, 2))


@query("posting_pages", """WITH t AS (SELECT DISTINCT p_partkey AS key, unnest(regexp_extract_all(lower(p_name), '[a-z0-9_]+')) AS term FROM part),
    n AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY key) - 1 AS turn, count(*) OVER (PARTITION BY term) AS total FROM t)
    SELECT term, CAST(CASE WHEN total <= 100 THEN 0 ELSE turn // 40 END AS BIGINT) AS page, count(*) AS n, min(key) AS first_key, max(key) AS last_key FROM n GROUP BY 1, 2""")
def posting_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    posted = search.postings(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("text")), "key")
    pages = index.posting_pages(posted, 40, 100)
    return pages.select("term", "page", F.size("keys").cast("long").alias("n"), F.element_at("keys", 1).alias("first_key"), F.element_at("keys", -1).alias("last_key"))


@query("containment_paths", f"WITH RECURSIVE {_CONTAINS}, t AS (SELECT 'r' || r_regionkey AS node, 'r' || r_regionkey AS way, 0 AS depth FROM region UNION ALL SELECT dst, way || '/' || dst, depth + 1 FROM t JOIN e ON src = node WHERE depth < 2) SELECT node, way, CASE WHEN depth = 2 AND node IN (SELECT src FROM e) THEN 'depth' END AS boundary FROM t")
def containment_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ways, not only depths: region / nation / customer, with those that would go on named."""
    roots = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"))
    return graph.paths(_contains(spark, sf_dir), roots, 2, 100_000_000).select("node", F.array_join("path", "/").alias("way"), "boundary")


@query("merged_ranges", f"""WITH {_LINE_ROWS}, m AS (SELECT doc_id, line_no - 2 AS a, line_no + 2 AS b, line_no % 3 AS priority FROM l WHERE contains(lower(line), 'the')),
    o AS (SELECT *, max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM m),
    i AS (SELECT *, sum(CASE WHEN a > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM o)
    SELECT doc_id, min(a) AS start_line, max(b) AS end_line, min(priority) AS priority FROM i GROUP BY doc_id, island""")
def merged_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = corpus.physical_lines(table(spark, sf_dir, "documents")).where(F.contains(F.lower("line"), F.lit("the")))
    spans = lines.select(F.col("doc_id").alias("path"), (F.col("line_no") - 2).alias("start_line"), (F.col("line_no") + 2).alias("end_line"), (F.col("line_no") % 3).alias("priority"))
    return investigate.merged_ranges(spans).withColumnRenamed("path", "doc_id")


@query("first_write_wins", "SELECT user_id, event_type, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def first_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return business.first_write(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], ["event_id"])


@query("snapshot_counts", f"WITH {_OLD} SELECT count(*) FILTER (o.sha256 IS NULL) AS added, count(*) FILTER (o.sha256 <> n.sha256) AS changed, count(*) FILTER (n.sha256 IS NULL) AS removed FROM old o FULL JOIN new n USING (doc_id)")
def snapshot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    old = corpus.files(docs.where("lang <> 'es'").withColumn("text", F.translate("text", "#$%&*", "")))
    return versions.changes(old, corpus.files(docs.where("lang <> 'de'")), "doc_id", "sha256")


@query("json_search_page", "SELECT event_id, props FROM events WHERE contains(lower(props), '7') AND event_id > 50 ORDER BY event_id LIMIT 60")
def json_search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.search(table(spark, sf_dir, "events").select("event_id", "props"), "7", 60, 50, "event_id", "props")


@query("uncertain_runs", "SELECT c_custkey, c_acctbal FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') ORDER BY c_acctbal DESC, c_custkey")
def uncertain_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderstatus") == "O", "started").otherwise("done").alias("status"))
    return versions.uncertain(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), requests, "c_custkey", "c_acctbal")


@query("kinds_present", "WITH w AS (SELECT unnest(['de', 'en', 'it']) AS kind), h AS (SELECT lang AS kind, count(*) AS n FROM documents GROUP BY lang) SELECT kind, coalesce(n, 0) AS n FROM w FULL JOIN h USING (kind)")
def kinds_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    return investigate.kinds_present(table(spark, sf_dir, "documents").select(F.col("lang").alias("kind")), ["de", "en", "it"])


@query("seen_spans", f"""WITH {_LINE_ROWS}, c AS (SELECT doc_id, line_no AS a, line_no + 1 AS b FROM l WHERE contains(lower(line), 'license')), p AS (SELECT DISTINCT doc_id, (line_no - 1) // 5 AS page FROM l)
    SELECT DISTINCT c.doc_id, c.a AS candidate, page FROM c JOIN p ON c.doc_id = p.doc_id AND page * 5 + 1 <= a AND b <= page * 5 + 5""")
def seen_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = corpus.physical_lines(table(spark, sf_dir, "documents"))
    n = F.col("line_no")
    hits = lines.where(F.contains(F.lower("line"), F.lit("license"))).select(F.col("doc_id").alias("path"), F.struct("doc_id", "line_no").alias("candidate"), n.alias("start_line"), (n + 1).alias("end_line"))
    pages = lines.select(F.col("doc_id").alias("path"), F.floor((n - 1) / 5).alias("page")).distinct().select("path", "page", (F.col("page") * 5 + 1).alias("start_line"), (F.col("page") * 5 + 5).alias("end_line"))
    return investigate.seen_by(hits, pages).select("candidate.doc_id", F.col("candidate.line_no").alias("candidate"), "page")


@query("diverse_order", "SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS turn FROM orders")
def diverse_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.col("o_orderkey").alias("rank"))
    return investigate.diverse(ranked, ["o_orderpriority"]).select("o_orderkey", "o_orderpriority", F.col("turn").cast("long").alias("turn"))


@query("named_context", f"""WITH {_LINE_ROWS}, h AS (SELECT doc_id, line_no, length(line) AS size, CAST(contains(lower(line), 'license') AS INT) + CAST(contains(lower(line), 'the') AS INT) AS hits FROM l),
    t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, line_no) AS turn FROM h WHERE hits > 0),
    u AS (SELECT *, CAST(sum(size) OVER (ORDER BY turn, hits DESC, doc_id, line_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM t WHERE turn <= 2)
    SELECT doc_id, line_no, hits, used, count(*) OVER () < (SELECT count(*) FROM h WHERE hits > 0) AS truncated FROM u WHERE used <= 4000""")
def named_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best lines of all documents under one budget of characters."""
    lines = corpus.physical_lines(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("path"), F.col("line_no").alias("page"), F.col("line").alias("text"))
    return investigate.context(lines, ["license", "the"], 4000).select(F.col("path").alias("doc_id"), F.col("page").alias("line_no"), "hits", "used", "truncated")
