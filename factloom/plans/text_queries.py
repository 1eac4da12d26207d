"""Corpus, index and search queries over `documents`, `pages`, `benchmark` and `part`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions import text as X
from factloom.operators import corpus, search
from factloom.plans.registry import query
from factloom.sources import files
from factloom.storage import table

TERMS = ["erthion", "license", "the", "ention", "version", "que", "idiot"]
LEADS = [["license", "version"], ["idiot", "clown", "trash"], ["que", "de", "la"]]
_IN = lambda terms: ", ".join(f"'{t}'" for t in terms)
_TOKENS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+')"
_LINES = "string_split(coalesce(text, ''), chr(10))"
_SHA = "sha256(coalesce(text, ''))"


@query("corpus_profile", f"SELECT source, lang, count(*) AS n_docs, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(len({_LINES})) AS BIGINT) AS lines, min(length(text)) AS shortest, max(length(text)) AS longest, count(DISTINCT {_SHA}) AS contents FROM documents GROUP BY source, lang")
def corpus_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.profile(table(spark, sf_dir, "documents"), "source", "lang")


@query("content_hash_files", f"SELECT doc_id, {_SHA} AS sha256, length(text) AS chars, len({_LINES}) AS lines FROM documents")
def content_hash_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.files(table(spark, sf_dir, "documents"))


@query("duplicate_groups", f"SELECT {_SHA} AS sha256, count(*) AS n, count(*) - 1 AS extras, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.duplicates(table(spark, sf_dir, "documents"))


@query("snapshot_id", f"""WITH p AS (SELECT substr(sha256(CAST(doc_id AS VARCHAR)), 1, 2) AS bucket, CAST(doc_id AS VARCHAR) || ':' || {_SHA} AS pair FROM documents),
    b AS (SELECT bucket, sha256(string_agg(pair, chr(10) ORDER BY pair)) AS hash, count(*) AS n FROM p GROUP BY bucket)
    SELECT sha256(string_agg(bucket || ':' || hash, chr(10) ORDER BY bucket)) AS snapshot_id, CAST(sum(n) AS BIGINT) AS n_files FROM b""")
def snapshot_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.snapshot_id(corpus.files(table(spark, sf_dir, "documents")))


@query("stable_ids", f"SELECT doc_id, 'ev_' || substr(sha256(CAST(doc_id AS VARCHAR) || chr(31) || {_SHA} || chr(31) || '1' || chr(31) || CAST(len({_LINES}) AS VARCHAR)), 1, 24) AS evidence_id FROM documents")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", X.stable_id("ev", F.col("doc_id"), X.content_hash(text), F.lit(1), F.size(X.lines(text))).alias("evidence_id"))


@query("physical_lines", f"SELECT doc_id, generate_subscripts({_LINES}, 1) AS line_no, unnest({_LINES}) AS line FROM documents")
def physical_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.physical_lines(table(spark, sf_dir, "documents"))


_PROGRAM = r"(?im)^.{0,11}(PROGRAM-ID\s*\.|\bPROCEDURE\s+DIVISION\b)"
_FRAGMENT = r"(?im)(^.{0,11}\bDATA\s+DIVISION\b|^\s*(01|77|78)\s+[A-Z0-9_$#@-]+\b)"


@query("artifact_kinds", f"""WITH f AS (SELECT 'page' AS origin, page_id AS id, coalesce(lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)), '') AS suffix, coalesce(html, '') AS body FROM pages UNION ALL SELECT 'document', doc_id, 'txt', coalesce(text, '') FROM documents)
    SELECT origin, id, CASE WHEN suffix IN ('cpy', 'copy', 'cpb') THEN 'copybook' WHEN suffix IN ('ddl', 'dds', 'pf', 'lf') THEN 'ddl_or_db_file_definition' WHEN suffix IN ('cl', 'clle', 'clp', 'jcl', 'job') THEN 'job_or_command'
    WHEN regexp_matches(body, '{_PROGRAM}') THEN 'cobol_program' WHEN regexp_matches(body, '{_FRAGMENT}') THEN 'cobol_fragment_or_copybook' WHEN suffix = 'sql' THEN 'sql_or_ddl' ELSE 'unclassified_text' END AS kind,
    contains(lower(body), '<script') AS scripted, regexp_extract(body, '<html lang="([a-z]+)"', 1) AS lang FROM f""")
def artifact_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and documents as artifacts: by suffix first, then by what the text holds."""
    pages = table(spark, sf_dir, "pages").select(F.lit("page").alias("origin"), F.col("page_id").alias("id"), F.lower(F.regexp_extract("url", r"\.([A-Za-z0-9]+)$", 1)).alias("suffix"), F.coalesce("html", F.lit("")).alias("body"))
    docs = table(spark, sf_dir, "documents").select(F.lit("document"), "doc_id", F.lit("txt"), F.coalesce("text", F.lit("")))
    every = pages.union(docs)
    return every.select("origin", "id", files.artifact_kind(F.col("suffix"), F.col("body")).alias("kind"), F.lower("body").contains("<script").alias("scripted"), F.regexp_extract("body", '<html lang="([a-z]+)"', 1).alias("lang"))


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two versions of the corpus: the older without Spanish and with junk marks removed, the newer without German."""
    docs = table(spark, sf_dir, "documents")
    old = docs.where("lang <> 'es'").withColumn("text", F.translate("text", "#$%&*", ""))
    return corpus.files(old), corpus.files(docs.where("lang <> 'de'"))


_OLD = f"""old AS (SELECT doc_id, sha256(translate(text, '#$%&*', '')) AS sha256, length(translate(text, '#$%&*', '')) AS chars, len(string_split(translate(text, '#$%&*', ''), chr(10))) AS lines FROM documents WHERE lang <> 'es'),
    new AS (SELECT doc_id, {_SHA} AS sha256, length(text) AS chars, len({_LINES}) AS lines FROM documents WHERE lang <> 'de')"""


@query("snapshot_diff", f"WITH {_OLD} SELECT doc_id, CASE WHEN o.sha256 IS NULL THEN 'added' WHEN n.sha256 IS NULL THEN 'removed' WHEN o.sha256 <> n.sha256 THEN 'changed' ELSE 'same' END AS status FROM old o FULL JOIN new n USING (doc_id)")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.diff(*_snapshots(spark, sf_dir))


@query("changed_delete_insert", f"WITH {_OLD} SELECT n.*, CASE WHEN o.sha256 = n.sha256 THEN 'kept' ELSE 'indexed' END AS origin FROM new n LEFT JOIN old o USING (doc_id)")
def changed_delete_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.refresh(*_snapshots(spark, sf_dir))


@query("tokens_distinct", f"SELECT doc_id, unnest(list_distinct({_TOKENS})) AS term FROM documents")
def tokens_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("term"))


@query("postings_stats", f"WITH t AS (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) SELECT term, substr(sha256(term), 1, 2) AS bucket, count(DISTINCT doc_id) AS df, count(*) AS cf FROM t GROUP BY term")
def postings_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.routes(search.postings(table(spark, sf_dir, "documents")))


@query("any_term_search", f"""WITH t AS (SELECT DISTINCT doc_id, unnest({_TOKENS}) AS term FROM documents)
    SELECT doc_id, string_agg(term, ' ' ORDER BY term) AS matched, count(*) AS score FROM t WHERE term IN ({_IN(TERMS)}) GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 100""")
def any_term_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.any_term(table(spark, sf_dir, "documents"), TERMS, 100)


_BM25 = lambda terms: f"""t AS (SELECT doc_id, {_TOKENS} AS toks FROM documents), c AS (SELECT count(*) AS n, avg(len(toks)) AS mean FROM t),
    h AS (SELECT doc_id, term, count(*) AS tf, any_value(size) AS size FROM (SELECT doc_id, len(toks) AS size, unnest(toks) AS term FROM t) WHERE term IN ({_IN(terms)}) GROUP BY doc_id, term),
    d AS (SELECT term, count(*) AS df FROM h GROUP BY term),
    bm AS (SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS score FROM h JOIN d USING (term), c GROUP BY doc_id)"""  # noqa: E731


@query("bm25_topk", f"WITH {_BM25(TERMS)} SELECT doc_id, score FROM bm ORDER BY score DESC, doc_id LIMIT 50")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25(table(spark, sf_dir, "documents"), TERMS).orderBy(F.desc("score"), "doc_id").limit(50)


@query("diversified_rank", f"WITH {_BM25(TERMS)} SELECT doc_id, source, score, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS rank FROM bm JOIN documents USING (doc_id)")
def diversified_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return search.diversified(search.bm25(docs, TERMS).join(docs.select("doc_id", "source"), "doc_id"), "source").select("doc_id", "source", "score", "rank")


_LEAD_SQL = " UNION ALL ".join(f"SELECT doc_id, {i} AS lead, row_number() OVER (ORDER BY count(*) DESC, doc_id) AS rn FROM t WHERE term IN ({_IN(terms)}) GROUP BY doc_id QUALIFY rn <= 60" for i, terms in enumerate(LEADS))


@query("interleaved_leads", f"""WITH t AS (SELECT DISTINCT doc_id, unnest({_TOKENS}) AS term FROM documents), r AS ({_LEAD_SQL}),
    f AS (SELECT doc_id, CAST(lead AS BIGINT) AS lead, rn FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY rn, lead) = 1)
    SELECT doc_id, lead, rn, row_number() OVER (ORDER BY rn, lead, doc_id) AS place FROM f QUALIFY place <= 60""")
def interleaved_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return search.interleaved([search.any_term(docs, terms, 60).select("doc_id", "score") for terms in LEADS], 60)


@query("query_terms_roundrobin", f"""WITH t AS (SELECT item_id, term, min(pos) AS pos FROM (SELECT item_id, unnest({_TOKENS}) AS term, generate_subscripts({_TOKENS}, 1) AS pos FROM benchmark) GROUP BY ALL),
    r AS (SELECT item_id, term, row_number() OVER (PARTITION BY item_id ORDER BY pos) AS turn FROM t)
    SELECT term, turn, item_id FROM r QUALIFY row_number() OVER (PARTITION BY term ORDER BY turn, item_id) = 1 ORDER BY turn, item_id, term LIMIT 128""")
def query_terms_roundrobin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.round_robin_terms(table(spark, sf_dir, "benchmark"), "item_id", 128)


_LINE_ROWS = f"l AS (SELECT doc_id, generate_subscripts({_LINES}, 1) AS line_no, unnest({_LINES}) AS line FROM documents)"


@query("literal_locate", f"WITH {_LINE_ROWS} SELECT doc_id, line_no, line FROM l WHERE contains(lower(line), 'license')")
def literal_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.locate(corpus.physical_lines(table(spark, sf_dir, "documents")), "License")


@query("literal_global_page", f"""WITH b AS (SELECT item_id AS item, {_TOKENS} AS t FROM benchmark), d AS (SELECT doc_id, {_TOKENS} AS toks FROM documents),
    p AS (SELECT doc_id, toks, unnest(range(1, len(toks) + 1)) AS i FROM d)
    SELECT item, doc_id, count(*) AS n FROM (SELECT doc_id, toks, i, toks[i] AS first FROM p) x JOIN (SELECT item, t, t[1] AS first FROM b WHERE len(t) > 0) y USING (first) WHERE list_slice(toks, i, i + len(t) - 1) = t GROUP BY item, doc_id ORDER BY item, doc_id LIMIT 500""")
def literal_global_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of all places of all items, by every token of an item."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("item"), X.tokens(F.col("text")).alias("t")).where("size(t) > 0")
    return search.locate_whole(table(spark, sf_dir, "documents"), items).orderBy("item", "doc_id").limit(500)


@query("ngram_signature", """WITH c AS (SELECT doc_id, list_transform(string_split(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9 ]', '', 'g'), ''), lambda x: ascii(x)) AS a FROM documents),
    p AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, greatest(len(a) - 1, 1)), lambda i: (((a[i] % 8192) * 131 + a[i + 1]) % 8192 * 131 + a[i + 2]) % 8192))) AS probe FROM c)
    SELECT doc_id, count(*) AS n_probes, CAST(sum(probe) AS BIGINT) AS probe_sum FROM p GROUP BY doc_id""")
def ngram_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", X.totals(X.probes(F.col("text"))).alias("p"))
    return found.select("doc_id", F.col("p.n").alias("n_probes"), F.col("p.total").alias("probe_sum")).where("n_probes > 0")


@query("snippet", "SELECT doc_id, substr(text, greatest(strpos(lower(text), 'license') - 20, 1), 80) AS excerpt FROM documents WHERE strpos(lower(text), 'license') > 0")
def snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.snippet(F.col("text"), "license").alias("excerpt")).where("excerpt is not null")


@query("page_crop_budget", f"""WITH {_LINE_ROWS}, u AS (SELECT doc_id, line_no, CAST(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) AS used FROM l)
    SELECT doc_id, line_no, used, max(used) OVER (PARTITION BY doc_id) > 1200 AS truncated FROM u QUALIFY used <= 1200""")
def page_crop_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = corpus.physical_lines(table(spark, sf_dir, "documents"))
    return search.within_budget(lines, "doc_id", "line_no", (F.length("line") + 1).cast("long"), 1200).select("doc_id", "line_no", "used", "truncated")


@query("evidence_integrity", f"SELECT doc_id, sha256(trim(text)) AS indexed_sha256, {_SHA} AS current_sha256, sha256(trim(text)) = {_SHA} AS intact FROM documents")
def evidence_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    indexed, now = X.content_hash(F.trim("text")), X.content_hash(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", indexed.alias("indexed_sha256"), now.alias("current_sha256"), (indexed == now).alias("intact"))


@query("ranked_union_search", """SELECT p_partkey, p_name, CASE WHEN p_name = 'red bolt' THEN 0 WHEN starts_with(p_name, 'red') THEN 1 ELSE 2 END AS tier, count(*) OVER () AS total, count(*) OVER () > 200 AS truncated
    FROM part WHERE p_name = 'red bolt' OR starts_with(p_name, 'red') OR contains(p_name, 'bolt') ORDER BY tier, p_name, p_partkey LIMIT 200""")
def ranked_union_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    tier = F.when(name == "red bolt", 0).when(name.startswith("red"), 1).when(name.contains("bolt"), 2)
    found = table(spark, sf_dir, "part").select("p_partkey", "p_name", tier.alias("tier")).where("tier is not null")
    total = found.agg(F.count(F.lit(1)).alias("total"))
    return found.orderBy("tier", "p_name", "p_partkey").limit(200).crossJoin(F.broadcast(total)).withColumn("truncated", F.col("total") > 200)


@query("catalog_priority_order", """SELECT kind, id, name, row_number() OVER (PARTITION BY name ORDER BY CASE kind WHEN 'brand' THEN 0 WHEN 'part' THEN 1 ELSE 2 END, id) AS place FROM
    (SELECT 'part' AS kind, p_partkey AS id, p_name AS name FROM part UNION ALL SELECT 'brand', p_partkey, p_brand FROM part UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier) s QUALIFY place <= 5""")
def catalog_priority_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    named = lambda t, kind, id, name: t.select(F.lit(kind).alias("kind"), F.col(id).alias("id"), F.col(name).alias("name"))  # noqa: E731, A002
    every = named(part, "part", "p_partkey", "p_name").union(named(part, "brand", "p_partkey", "p_brand")).union(named(supplier, "supplier", "s_suppkey", "s_name"))
    rank = F.when(F.col("kind") == "brand", 0).when(F.col("kind") == "part", 1).otherwise(2)
    return every.withColumn("place", F.row_number().over(Window.partitionBy("name").orderBy(rank, "id")).cast("long")).where("place <= 5")


@query("concept_cooccurrence", f"""WITH t AS (SELECT doc_id, list_distinct({_TOKENS}) AS terms FROM documents WHERE list_contains({_TOKENS}, 'license')),
    u AS (SELECT doc_id, unnest(terms) AS term FROM t) SELECT term, count(*) AS n FROM u WHERE term <> 'license' GROUP BY term ORDER BY n DESC, term LIMIT 50""")
def concept_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms by the number of matching texts that hold them."""
    docs = table(spark, sf_dir, "documents").select(X.tokens(F.col("text")).alias("t")).where(F.array_contains("t", "license"))
    terms = docs.select(F.explode(F.array_distinct("t")).alias("term")).where("term <> 'license'")
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "term").limit(50)


@query("manual_section_score", f"""WITH {_LINE_ROWS}, s AS (SELECT doc_id, line_no, len(list_filter(regexp_extract_all(lower(line), '[a-z0-9_]+'), lambda x: x IN ({_IN(TERMS)}))) AS hits FROM l)
    SELECT doc_id, CAST(sum(hits) + 2 * sum(CASE WHEN line_no = 1 THEN hits ELSE 0 END) AS BIGINT) AS score FROM s GROUP BY doc_id HAVING sum(hits) > 0""")
def manual_section_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = corpus.physical_lines(table(spark, sf_dir, "documents"))
    hit = F.size(F.filter(X.tokens(F.col("line")), lambda t: t.isin(*TERMS))).cast("long")
    scored = lines.select("doc_id", "line_no", hit.alias("hits")).groupBy("doc_id").agg(F.sum("hits").alias("hits"), F.sum(F.when(F.col("line_no") == 1, F.col("hits")).otherwise(0)).alias("heading"))
    return scored.where("hits > 0").select("doc_id", (F.col("hits") + 2 * F.col("heading")).alias("score"))
