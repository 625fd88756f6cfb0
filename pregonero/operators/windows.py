"""First-per-key, per-group caps, ranks and running totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def first_per_key(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key. Spark cuts each task to one row per key before the shuffle
    (WindowGroupLimit), so a key with very many copies costs one row per task."""
    return top_per_key(df, keys, order, 1)


def top_per_key(df: DataFrame, keys: list[str], order: list[str | Column], n: int) -> DataFrame:
    """The first n rows of each key, cut per task before the shuffle like first_per_key."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def latest_per_key(df: DataFrame, keys: list[str], newest_first: list[Column]) -> DataFrame:
    return top_per_key(df, keys, newest_first, 1)


def with_rank(report: DataFrame, order: list[Column], name: str = "posicion") -> DataFrame:
    """Numbers the rows of a report that is already aggregated and limited."""
    return report.withColumn(name, F.row_number().over(W.orderBy(*order)))


def running_total(report: DataFrame, order: str, value: str, name: str = "acumulado") -> DataFrame:
    """Running sum over an aggregated report (one row per period, so one task is enough)."""
    window = W.orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return report.withColumn(name, F.sum(value).over(window))


def unseen(items: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """One row per new key: rows without a key and keys already known are left out."""
    fresh = items.filter(F.col(key).isNotNull()).join(known.select(key).distinct(), key, "left_anti")
    return fresh.dropDuplicates([key])
