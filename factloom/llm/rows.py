"""Rows named by identifier and content locator: taking some out of a table without moving the table.

A locator is a 64-bit hash of a row's identifier and text; a row is named by both. Rows that share identifier and text
share the name, so one of them is chosen by all columns that have an order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Names that are broadcast at most; beyond, the join is the optimizer's.
BOUND = 2_000_000


def locator(identifier: Column, text: Column) -> Column:
    return F.xxhash64(identifier, F.coalesce(text, F.lit("")))


def small(df: DataFrame, bound: int = BOUND) -> DataFrame:
    """df, marked for a broadcast if it has at most `bound` rows; df should be cheap to count (a written table)."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


def _ordered(docs: DataFrame) -> list[Column]:
    plain = lambda t: not isinstance(t, (T.MapType, T.VariantType)) and (not isinstance(t, T.ArrayType) or plain(t.elementType)) and (not isinstance(t, T.StructType) or all(plain(f.dataType) for f in t.fields))
    return [docs[f.name] for f in docs.schema.fields if plain(f.dataType)]


def without(docs: DataFrame, gone: DataFrame, repeated: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose (id, locator) is not in gone; of those in repeated, the first by all columns only."""
    names = lambda df: small(df.select(F.col("id").alias("__name_id"), F.col("locator").alias("__name_locator")).distinct())

    def match(named: DataFrame) -> Column:
        return (locator(docs[id_col], docs[text_col]) == named["__name_locator"]) & docs[id_col].eqNullSafe(named["__name_id"])

    taken = names(gone)
    if repeated is None or repeated.isEmpty():
        return docs.join(taken, match(taken), "left_anti")
    several = names(repeated)
    both = names(gone.select("id", "locator").union(repeated.select("id", "locator")))
    turn = F.row_number().over(Window.partitionBy(docs[id_col], locator(docs[id_col], docs[text_col])).orderBy(*_ordered(docs)))
    own = F.struct(*(docs[c] for c in docs.columns)).alias("row")
    firsts = docs.join(several, match(several), "left_semi").select(own, turn.alias("turn")).where("turn = 1").select("row.*")
    return docs.join(both, match(both), "left_anti").union(firsts)
