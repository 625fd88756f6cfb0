"""Measures shared by the reports. Sums of amounts stay exact decimals until the last cast."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

AMOUNT_COLUMN = "monto_estimado"


def rows(name: str = "cantidad") -> Column:
    return F.count(F.lit(1)).alias(name)


def total_amount(name: str = "monto_total") -> Column:
    return F.sum(AMOUNT_COLUMN).cast("double").alias(name)


def mean_amount(name: str = "monto_promedio") -> Column:
    return F.try_divide(F.sum(AMOUNT_COLUMN).cast("double"), F.count(AMOUNT_COLUMN)).alias(name)


def highest_amount(name: str = "monto_maximo") -> Column:
    return F.max(AMOUNT_COLUMN).cast("double").alias(name)


def lowest_amount(name: str = "monto_minimo") -> Column:
    return F.min(AMOUNT_COLUMN).cast("double").alias(name)


def distinct(column: str, name: str) -> Column:
    return F.count_distinct(column).alias(name)


def filled(column: str, name: str) -> Column:
    return F.count(column).alias(name)


def first_day(name: str = "primera_licitacion") -> Column:
    return F.min("fecha_publicacion").alias(name)


def last_day(name: str = "ultima_licitacion") -> Column:
    return F.max("fecha_publicacion").alias(name)


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """Share in percent, half-up, 0 for an empty whole."""
    share = F.round(F.try_divide(part.cast("decimal(20,0)") * 100, whole.cast("decimal(20,0)")), digits)
    return F.coalesce(share.cast("double"), F.lit(0.0))
