"""Inverted index, ranking, interleaving, literal location and budgets.

Postings are hash-partitioned rows (term, document, frequency). A query's terms are few, so they are a literal filter
on the postings; statistics of the corpus are one row. Every order ends in a unique key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from pyspark.sql.window import Window

from factloom.functions import text as X


def postings(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """term, key, tf: how often each term occurs in each text. One pass, no shuffle: a row holds all of its tokens."""
    return docs.select(key, F.explode(X.counts(F.col("text"))).alias("one")).select("one.term", key, "one.tf")


def _part(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("part")


def _packed_schema(rows: DataFrame, key: str) -> str:
    kind = rows.schema[key].dataType
    return X.packed_schema(kind.simpleString(), isinstance(kind, IntegralType))


def packed_postings(docs: DataFrame, key: str, parts: int) -> DataFrame:
    """postings() as rows of X.packed_schema(), which hold the texts of a batch that share a term and a part, dealt by key."""

    def run(batches):
        for batch in batches:
            yield from X.pack_texts(batch.column(1), batch.column(0), batch.column(2).to_numpy())

    texts = docs.select(key, F.lower(F.coalesce("text", F.lit(""))).alias("text"), _part(key, parts))
    return texts.mapInArrow(run, _packed_schema(docs, key))


def packed(posted: DataFrame, key: str, parts: int) -> DataFrame:
    """Rows term, key, tf as packed_postings() has them."""

    def run(batches):
        for batch in batches:
            yield X.pack_rows(batch.column(0), batch.column(1), batch.column(2).to_numpy(), batch.column(3).to_numpy())

    rows = posted.select("term", key, "tf", _part(key, parts)).sortWithinPartitions("term")
    return rows.mapInArrow(run, _packed_schema(posted, key))


def unpacked(rows: DataFrame, key: str, kind: str) -> DataFrame:
    """term, key (of a kind), tf, segment of packed rows."""
    if "packed" not in rows.columns:
        return rows.select("term", F.explode(F.arrays_zip("keys", "tfs")).alias("one"), "segment").select("term", F.col("one.keys").alias(key), F.col("one.tfs").cast("long").alias("tf"), "segment")

    def run(batches):
        for batch in batches:
            for at, keys, tf in X.unpack(batch.column(1).to_numpy(), batch.column(2)):
                at = pa.array(at)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), keys, pa.array(tf), batch.column(3).take(at)], names=["term", key, "tf", "segment"])

    single = rows.select("term", "form", "packed", "segment").mapInArrow(run, f"term string, {key} bigint, tf bigint, segment int")
    return single.withColumn(key, F.col(key).cast(kind))


def routes(posted: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per term: its bucket (two hex digits of its hash), document frequency and total frequency."""
    return posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")).withColumn("bucket", F.substring(F.sha2("term", 256), 1, 2))


def hits(docs: DataFrame, terms: Sequence[str], key: str = "doc_id") -> DataFrame:
    """term, key, tf for the given terms only, counted inside each text."""
    wanted = F.array(*map(F.lit, dict.fromkeys(terms)))
    count = X.once(X.tokens(F.col("text")), lambda v: F.transform(F.array_intersect(wanted, v), lambda t: F.struct(t.alias("term"), F.size(F.filter(v, lambda x: x == t)).cast("long").alias("tf"))))
    return docs.select(key, F.explode(count).alias("one")).select("one.term", key, "one.tf")


def any_term(docs: DataFrame, terms: Sequence[str], limit: int, key: str = "doc_id") -> DataFrame:
    """Texts with any of the terms; score is how many different ones, ties by key."""
    found = F.array_intersect(X.tokens(F.col("text")), F.array(*map(F.lit, terms)))
    scored = docs.select(key, F.array_join(F.array_sort(found), " ").alias("matched"), F.size(found).cast("long").alias("score")).where("score > 0")
    return scored.orderBy(F.desc("score"), key).limit(limit)


def bm25(docs: DataFrame, terms: Sequence[str], key: str = "doc_id", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """key and BM25 score, rounded to six places, of every text with any of the terms."""
    sized = docs.select(key, F.size(X.tokens(F.col("text"))).alias("size"))
    corpus = sized.agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("mean"))
    found = hits(docs, terms, key)
    frequency = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    joined = found.join(F.broadcast(frequency), "term").join(sized, key).crossJoin(F.broadcast(corpus))  # a row per query term; one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / F.col("mean")))
    return joined.groupBy(key).agg(F.round(F.sum(part), 6).alias("score"))


def diversified(scored: DataFrame, group: str, key: str = "doc_id") -> DataFrame:
    """Every group's best first, then every group's second: rank is the place within the group."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), key))
    return scored.withColumn("rank", rank.cast("long"))


def interleaved(leads: Sequence[DataFrame], limit: int, key: str = "doc_id") -> DataFrame:
    """The leads' best in turn; a key counts where it is seen first. leads: (key, score) each; columns key, lead, rn, place."""
    ranked = None
    for number, lead in enumerate(leads):
        top = lead.orderBy(F.desc("score"), key).limit(limit)
        own = top.select(key, F.lit(number).cast("long").alias("lead"), F.row_number().over(Window.orderBy(F.desc("score"), key)).cast("long").alias("rn"))
        ranked = own if ranked is None else ranked.unionByName(own)
    first = ranked.groupBy(key).agg(F.min(F.struct("rn", "lead")).alias("seen")).select(key, "seen.lead", "seen.rn")
    return first.orderBy("rn", "lead", key).limit(limit).withColumn("place", F.row_number().over(Window.orderBy("rn", "lead", key)).cast("long"))


def round_robin_terms(groups: DataFrame, group: str, limit: int) -> DataFrame:
    """Query terms taken in turn from groups of text: each group's first, then each group's second, distinct."""
    at = groups.select(group, F.posexplode(X.tokens(F.col("text"))).alias("pos", "term")).groupBy(group, "term").agg(F.min("pos").alias("pos"))
    turn = at.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy("pos")))
    first = turn.groupBy("term").agg(F.min(F.struct("turn", group)).alias("seen")).select("term", F.col("seen.turn").cast("long").alias("turn"), F.col(f"seen.{group}").alias(group))
    return first.orderBy("turn", group, "term").limit(limit)


def locate(lines: DataFrame, literal: str) -> DataFrame:
    """Lines that hold the literal, whatever its case."""
    return lines.where(F.contains(F.lower("line"), F.lit(literal.lower())))


def locate_whole(docs: DataFrame, items: DataFrame, key: str = "doc_id", head: int = 3, bound: int = 20_000) -> DataFrame:
    """items (item, t: tokens) -> item, key, n: how often the whole token sequence occurs.

    Places are picked by the first tokens of the items (up to `head` of them) and verified there against all tokens.
    While there are at most `bound` different beginnings, they are tested inside each row, so only promising places
    leave it; beyond, every place goes to the same join. The join is on the beginning, so no pairs are tried.
    """
    sized = items.where("size(t) > 0").select("item", "t", F.size("t").alias("len")).withColumn("width", F.least("len", F.lit(head)))
    sized = sized.withColumn("head", F.array_join(F.slice("t", 1, head), " "))
    starts = sized.select("width", "head").distinct().limit(bound + 1).collect()
    longest = sized.agg(F.max("len")).first()[0] or 0
    widths = sorted({r.width for r in starts}) if len(starts) <= bound else list(range(1, head + 1))

    def places(v: Column) -> Column:
        def at(i: Column) -> Column:
            phrase = lambda w: F.array_join(F.slice(v, i, w), " ")
            every = F.array(*(F.struct(F.lit(w).alias("width"), phrase(w).alias("head")) for w in widths))
            return F.struct(F.slice(v, i, max(longest, 1)).alias("rest"), every.alias("heads"))

        spots = F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)))
        if len(starts) <= bound:
            first = sorted({r.head.split(" ")[0] for r in starts})
            by_width = {w: sorted(r.head for r in starts if r.width == w) for w in widths}
            spots = F.filter(spots, lambda i: F.coalesce(F.get(v, i - 1).isin(*first), F.lit(False)))
            hit = lambda i: reduce(lambda a, b: a | b, (F.array_join(F.slice(v, i, w), " ").isin(*by_width[w]) for w in widths))
            spots = F.filter(spots, hit)
        return F.transform(spots, at)

    if not widths:
        return docs.select(F.lit(None).cast(sized.schema["item"].dataType).alias("item"), key, F.lit(0).cast("long").alias("n")).limit(0)
    found = docs.select(key, F.explode(X.once(X.tokens(F.col("text")), places)).alias("p")).select(key, "p.rest", F.explode("p.heads").alias("h")).select(key, "rest", "h.width", "h.head")
    hit = found.join(sized, ["width", "head"]).where(F.slice("rest", 1, F.col("len")) == F.col("t"))
    return hit.groupBy("item", key).agg(F.count(F.lit(1)).alias("n"))


def within_budget(rows: DataFrame, group: str, order: str, size: Column, budget: int) -> DataFrame:
    """Rows of each group in order while their running size fits the budget, and whether anything was left out."""
    node = Window.partitionBy(group)
    running = F.sum(size).over(node.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    used = rows.withColumn("used", running).withColumn("truncated", F.max("used").over(node) > budget)
    return used.where(F.col("used") <= budget)
