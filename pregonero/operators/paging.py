"""Pages, page counts, work lists and samples."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.jsons import flag
from ..schema import GAZETTE, LIST_COLUMNS, QUICK_COLUMNS
from .filters import filter_tenders, library_filter, pending_parse, quick_search

MAX_PAGE_SIZE = 500
MAX_QUICK = 50
ID_RANGES = 65_536


def newest_first() -> list[Column]:
    """Missing dates come first, as in the stored order; the id makes the order total."""
    return [F.col("fecha_publicacion").desc_nulls_first(), F.col("id").desc()]


def page(df: DataFrame, number: int = 1, size: int = 50) -> DataFrame:
    """One page of the newest tenders (number from 1, size 1..500), by one top-k. For pages far down the list `deep_page`
    and `page_after` do less work."""
    if number < 1 or not 1 <= size <= MAX_PAGE_SIZE:
        raise ValueError("page number from 1, page size 1 to 500")
    offset = (number - 1) * size
    return df.orderBy(*newest_first()).offset(offset).limit(size)


def deep_page(df: DataFrame, offset: int, size: int) -> DataFrame:
    """The same page without sorting everything above it. Tenders are counted per day, then, in the days the page
    touches, per id range; only the ranges it touches are ranked. Both histograms are small at any table size, and a
    day that holds much of the table is cut into many ranges."""
    day = F.coalesce("fecha_publicacion", F.lit("9999-12-31").cast("date"))
    dated = df.withColumn("_day", day)
    days = _touched(dated.groupBy("_day").agg(F.count(F.lit(1)).alias("n")), [F.col("_day").desc()], F.lit(offset), size)
    hits = dated.join(days.select("_day"), "_day")

    bounds = hits.agg(F.min("id").cast("double").alias("_lo"), F.max("id").cast("double").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / ID_RANGES + 1
    ranged = hits.crossJoin(F.broadcast(bounds)).withColumn(
        "_range", F.floor((F.col("id").cast("double") - F.col("_lo")) / width)
    )
    above = days.agg(F.coalesce(F.min("before"), F.lit(0)).alias("_above"))  # one row
    ranges = ranged.groupBy("_day", "_range").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(above))
    cut = _touched(ranges, [F.col("_day").desc(), F.col("_range").desc()], F.lit(offset) - F.col("_above"), size)
    rank = F.row_number().over(W.partitionBy("_day", "_range").orderBy(F.col("id").desc())) + F.col("before") + F.col("_above")
    return (
        ranged.join(cut, ["_day", "_range"])
        .withColumn("_rank", rank)
        .filter((F.col("_rank") > offset) & (F.col("_rank") <= offset + size))
        .select(*df.columns)
        .orderBy(*newest_first())
    )


def _touched(counts: DataFrame, order: list[Column], offset: Column, size: int) -> DataFrame:
    """The groups of a histogram that overlap a page, with the number of rows before each."""
    upto = F.sum("n").over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    before = F.col("before")
    return (
        counts.withColumn("before", upto - F.col("n"))
        .filter((before < offset + size) & (before + F.col("n") > offset))
        .drop("n")
    )


def page_after(df: DataFrame, last_date: date | str | None, last_id: int, size: int = 50) -> DataFrame:
    """The page after a known last row: a filter and a top-k, however deep."""
    if last_date is None:
        older = F.col("fecha_publicacion").isNotNull() | (F.col("id") < last_id)
    else:
        day = F.lit(last_date).cast("date")
        older = (F.col("fecha_publicacion") < day) | ((F.col("fecha_publicacion") == day) & (F.col("id") < last_id))
    return df.filter(older).orderBy(*newest_first()).limit(size)


def list_page(df: DataFrame, number: int = 1, size: int = 50, **criteria) -> DataFrame:
    return page(filter_tenders(df, **criteria), number, size).select(*[c for c in LIST_COLUMNS if c in df.columns])


def page_info(df: DataFrame, number: int = 1, size: int = 50, **criteria) -> DataFrame:
    """Total rows and pages of a filtered list."""
    total = F.count(F.lit(1))
    return (
        filter_tenders(df, **criteria)
        .agg(total.alias("total"))
        .select(
            "total",
            F.lit(number).alias("page"),
            F.lit(size).alias("page_size"),
            F.ceil(F.col("total") / size).cast("long").alias("total_pages"),
        )
    )


def quick_results(df: DataFrame, q: str, limit: int = 10) -> DataFrame:
    if not 1 <= limit <= MAX_QUICK:
        raise ValueError("limit 1 to 50")
    columns = [c for c in QUICK_COLUMNS if c in df.columns]
    return quick_search(df, q).orderBy(*newest_first()).limit(limit).select(*columns)


def library_page(df: DataFrame, filtros: dict | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    return library_filter(df, filtros).orderBy(*newest_first()).offset(offset).limit(limit)


def top(df: DataFrame, n: int, measure: str, *tie: str) -> DataFrame:
    """The n largest, ties broken by the group keys; runs as a top-k, not as a sort."""
    return df.orderBy(F.col(measure).desc(), *[F.col(t).asc_nulls_first() for t in tie]).limit(n)


def random_sample(df: DataFrame, n: int = 3, seed: int | None = None) -> DataFrame:
    return df.orderBy(F.rand(seed)).limit(n)


def parsed_examples(df: DataFrame, n: int = 3, seed: int | None = None) -> DataFrame:
    """A few random gazette rows that are parsed and have a state."""
    done = (F.col("fuente") == GAZETTE) & flag(F.col("datos_especificos"), "procesado")
    return random_sample(df.filter(done & F.col("entidad_federativa").isNotNull()), n, seed)


def parse_work_list(df: DataFrame, only_pending: bool = True, limit: int | None = None) -> DataFrame:
    """Gazette rows to parse, newest capture first."""
    rows = df.filter(F.col("fuente") == GAZETTE)
    if only_pending:
        specifics = F.col("datos_especificos")
        rows = rows.filter(pending_parse(flag(specifics, "procesado"), specifics))
    rows = rows.orderBy(F.col("fecha_captura").desc_nulls_first(), F.col("id").desc())
    return rows.limit(limit) if limit else rows
