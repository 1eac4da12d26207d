"""Receivers, last writes and record views in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def last_write_before(rows: DataFrame, key: str, order: str, written: Column) -> Column:
    """The value of the latest write before each row of a straight-line sequence; null if there is none."""
    return F.last(written, ignorenulls=True).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))


def receive(value: Column, digits: int, scale: int, rounded: bool, old: Column | None = None, signed: bool = True) -> Column:
    """What a decimal receiver of `digits` digits and `scale` places holds after a store.

    Half away from zero if rounded, else cut; too many digits lose the high ones, or with old (ON SIZE ERROR) the
    receiver keeps its value; an unsigned receiver drops the sign.
    """
    wide = value.cast("decimal(30,10)")
    scaled = F.round(wide * (10**scale), 0) if rounded else F.when(wide < 0, F.ceil(wide * (10**scale))).otherwise(F.floor(wide * (10**scale)))
    scaled = scaled.cast("decimal(38,0)")
    limit = F.lit(10 ** (digits)).cast("decimal(38,0)")
    kept = F.when(F.abs(scaled) >= limit, F.lit(None) if old is not None else scaled % limit).otherwise(scaled)
    kept = kept if signed else F.abs(kept)
    out = (kept / F.lit(10**scale).cast("decimal(20,0)")).cast(f"decimal({digits + 2},{scale})")
    return F.coalesce(out, old.cast(f"decimal({digits + 2},{scale})")) if old is not None else out


def size_error(value: Column, digits: int, scale: int, rounded: bool) -> Column:
    wide = F.abs(value.cast("decimal(30,10)")) * (10**scale)
    return (F.round(wide, 0) if rounded else F.floor(wide)).cast("decimal(38,0)") >= F.lit(10**digits).cast("decimal(38,0)")


def effective(committed: DataFrame, pending: DataFrame, key: str) -> DataFrame:
    """Committed records with the pending ones laid over them by key."""
    return committed.join(pending.select(key), key, "left_anti").unionByName(pending)
