"""As-of joins as one union and one window; linear, with one shuffle by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _beside(left: DataFrame, right: DataFrame, by: list[str], on: str, values: list[str], side: int, parts: int | None) -> DataFrame:
    """Both tables' rows, the left one's as "l ", the right one's as "r "; ``side`` tells whether a right row comes before (1) a left one of its time."""
    one = left.select(F.struct("*").alias("l "), *[F.col(c) for c in by], F.col(on), F.lit(side).alias("side "))
    two = right.where(F.col(on).isNotNull()).select(*by, F.col(on), F.struct(F.col(on).alias("right_on"), *values).alias("r "), F.lit(1 - side).alias("side "))
    rows = one.unionByName(two, allowMissingColumns=True)
    return rows.repartition(parts, *by) if parts else rows


def _left(left: DataFrame, by: list[str]) -> list:
    """The left table's columns; ``by`` as the rows are partitioned, so that what follows by the same keys needs no shuffle."""
    return [F.col(c).cast(left.schema[c].dataType).alias(c) if c in by else F.col("`l `")[c].alias(c) for c in left.columns]


def _latest(by: list[str], on: str, forward: bool):
    """The last right row so far, in time order or (``forward``) against it: either frame grows row by row."""
    order = [F.desc(on), F.desc("side ")] if forward else [F.asc(on), F.asc("side ")]
    return F.last("r ", ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def asof_join(left: DataFrame, right: DataFrame, by: list[str], on: str, values: list[str], forward: bool = False, exact: bool = True, parts: int | None = None) -> DataFrame:
    """``left`` with ``values`` of the latest row of ``right`` (the earliest with ``forward``) whose ``on`` is not after (before) the
    left one's, or strictly before (after) it unless ``exact``; null if there is none. ``right_on`` is that row's ``on``.

    Rows of ``right`` should be unique by (by, on). Rows are partitioned by ``by``, in ``parts`` partitions if given: where that has few values, join distinct keys (``asof_lookup``).
    """
    both = _beside(left, right, by, on, values, 1 if exact != forward else 0, parts)
    found = both.withColumn("f ", _latest(by, on, forward)).where(F.col("`l `").isNotNull())
    return found.select(*_left(left, by), *[F.col("`f `")[v].alias(v) for v in ["right_on", *values]])


def asof_both(left: DataFrame, right: DataFrame, by: list[str], on: str, values: list[str], parts: int | None = None) -> DataFrame:
    """``left`` with the rows of ``right`` at or next to ``on``, in one shuffle: structs ``ahead`` (the earliest not before) and ``back`` (the latest not after) of right_on and ``values``."""
    rows = _beside(left, right, by, on, values, 1, parts)
    # a row of the same time comes before the left one in time order; against it, a strictly later one does
    same = F.max("r ").over(Window.partitionBy(*by, on))
    found = rows.withColumns({"back ": _latest(by, on, False), "later ": _latest(by, on, True), "same ": same}).where(F.col("`l `").isNotNull())
    return found.select(*_left(left, by), F.coalesce("`same `", "`later `").alias("ahead"), F.col("`back `").alias("back"))


def asof_lookup(left: DataFrame, right: DataFrame, by: list[str], on: str, values: list[str], **how) -> DataFrame:
    """As ``asof_join`` by way of the distinct (by, on) of ``left``: few keys with many rows, such as currencies, are no hot partitions."""
    keys = left.select(*by, on).distinct()
    return left.join(asof_join(keys, right, by, on, values, **how).drop("right_on"), [*by, on], "left")
