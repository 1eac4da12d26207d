"""Thin queries over the driver's tables: each runs its operator over the whole table and derives the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import exact_dedup, html_text, media, mixing, ngram_join, pii, ppm, quality, sentencepiece, toxicity
from factloom.storage import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Register the decorated (spark, sf_dir) -> DataFrame under name."""

    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


@query(
    "op4_exact_dedup",
    """
    WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
    FROM t WINDOW g AS (PARTITION BY text_sha256)
    """,
)
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.find_copies(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query("op3_media_columns")
def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.with_media(table(spark, sf_dir, "documents"), keep_media=False)
    return found.select(F.col("id").alias("doc_id"), *(c[0] for c in media.COLUMNS[:6]), F.lower(F.hex("phash")).alias("feature"))


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))  # a null id is not held out
    model = toxicity.train(docs.where(~held), table(spark, sf_dir, "labels").where(~held))
    scored = toxicity.score(docs, model).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op1_ppm_scoring")
def op1_ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2, F.lit(False))  # a null id is learned from
    found = ppm.score(table(spark, sf_dir, "documents"), ~held)
    return found.select(F.col("id").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op5_html_extraction")
def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.with_text(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


@query("op7_ngram_jaccard_join")
def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.join_similar(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "rep_id", "n_links", "n_linked_classes")


@query("op8_pii_weak_supervision")
def op8_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["base"])
    count = lambda i: F.size(F.filter(base, lambda x: x["kind"] == i)).cast("long")
    return found.select(
        F.col("id").alias("doc_id"), *(count(i).alias(f"n_{kind}") for i, kind in enumerate(pii.BASE)), F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size(base)).cast("long").alias("n_added"), F.array_join(F.transform("spans", lambda x: F.round(x["probability"], 4).cast("string")), ",").alias("probabilities"),
    )


@query("op9_quality_co_training")
def op9_quality_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return found.select(F.col("id").alias("doc_id"), "score", "content_score", "metadata_score", (F.col("score") >= 0.5).alias("kept"))


#: Half of all tokens: web, book and reference sources 5 : 3 : 2, English twice as much as each other language.
MIX = mixing.Plan(
    share=(1, 2), max_epochs=2, seed=42, other="reference", domains={**{f"src{i}": "web" for i in range(5)}, **{f"src{i}": "books" for i in range(5, 13)}},
    domain_weights={"web": 5, "books": 3, "reference": 2}, lang_weights={"en": 4, "de": 2, "fr": 2, "es": 2},
)


@query("op10_source_mixing", "SELECT id AS doc_id, epoch, domain, lang, source, n_tokens FROM (" + mixing.sql(MIX) + ") m")
def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), MIX).withColumnRenamed("id", "doc_id")


@query("op2_sentencepiece")
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.encode(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
