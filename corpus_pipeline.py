"""A training-data pipeline over `documents`: each stage works on all that the stage before it kept.

Defined results: without labels the quality stage keeps everything; a null text is an empty one, and all empty texts are
copies of each other; null identifiers, languages and sources are values of their own; of repeated rows one is left after
the second stage; all stages but the last keep every column of the input, whatever its name; empty tables give an empty
result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import exact_dedup, mixing, ngram_join, quality, sentencepiece
from factloom.storage import materialize, release, table

#: Nine tenths of the tokens that reach the stage, each text at most once; English and the web weigh most.
MIX = mixing.Plan(
    share=(9, 10), max_epochs=1, seed=42, other="reference", domains={**{f"src{i}": "web" for i in range(5)}, **{f"src{i}": "books" for i in range(5, 13)}},
    domain_weights={"web": 5, "books": 3, "reference": 2}, lang_weights={"en": 4, "de": 2, "fr": 2, "es": 2},
)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the co-trained quality classifier rejects."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the largest doc_id of equal texts."""
    return exact_dedup.drop_copies(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of texts that are linked by shingle similarity."""
    return ngram_join.drop_similar(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Selects each leaf's token-prefix under the hierarchical budgets."""
    return mixing.mix_rows(docs, MIX)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_pieces and round_trip of each document that is left."""
    return sentencepiece.encode(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality classifier", quality_stage), ("exact dedup", exact_dedup_stage), ("n-gram Jaccard join", near_dedup_stage),
    ("mixing sources to target weights", mixing_stage), ("SentencePiece encoding and decoding", encoding_stage),
]

#: Classifiers, similarity and pieces are beyond SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{number}")
            release(before)
    return docs
