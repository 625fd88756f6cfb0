"""Predicates of the list, search and library queries, folded into one filter that reaches the scan."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import like_pattern, strip

# Columns searched by each kind of text search, and words of the procedures left out by default.
SEARCH_COLUMNS = ["titulo", "descripcion", "numero_procedimiento"]
QUICK_SEARCH_COLUMNS = ["numero_procedimiento", "titulo", "entidad_compradora", "entidad_federativa", "municipio"]
LIBRARY_SEARCH_COLUMNS = ["titulo", "descripcion"]
DIRECT_AWARD_WORDS = ["ADJUDICACION", "DIRECTA"]



def any_like(columns: Iterable[str], text: str) -> Column:
    """Case-insensitive substring in any column. % and _ in the text act as wildcards."""
    return reduce(lambda a, b: a | b, [F.col(c).ilike(like_pattern(text)) for c in columns])


def conjunction(predicates: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def list_predicates(
    fuente: str | None = None,
    estado: str | None = None,
    entidad_federativa: str | None = None,
    municipio: str | None = None,
    tipo_contratacion: list[str] | None = None,
    tipo_procedimiento: list[str] | None = None,
    entidad_compradora: list[str] | None = None,
    fecha_desde: date | str | None = None,
    fecha_hasta: date | str | None = None,
    monto_min: float | None = None,
    monto_max: float | None = None,
    dias_apertura: int | None = None,
    busqueda: str | None = None,
    as_of: date | str | None = None,
) -> list[Column]:
    """The optional predicates of the tender list. Empty values, and 0 for amounts, mean no filter."""
    out: list[Column] = []
    for name, value in (("fuente", fuente), ("estado", estado), ("entidad_federativa", entidad_federativa)):
        if value:
            out.append(F.col(name) == value)
    if municipio:
        out.append(F.col("municipio").ilike(like_pattern(municipio)))
    for name, values in (
        ("tipo_contratacion", tipo_contratacion),
        ("tipo_procedimiento", tipo_procedimiento),
        ("entidad_compradora", entidad_compradora),
    ):
        if values:
            out.append(F.col(name).isin(list(values)))
    if fecha_desde:
        out.append(F.col("fecha_publicacion") >= F.lit(fecha_desde).cast("date"))
    if fecha_hasta:
        out.append(F.col("fecha_publicacion") <= F.lit(fecha_hasta).cast("date"))
    if monto_min:
        out.append(F.col("monto_estimado") >= monto_min)
    if monto_max:
        out.append(F.col("monto_estimado") <= monto_max)
    if dias_apertura is not None:
        out.append(opens_within(dias_apertura, as_of))
    if busqueda:
        out.append(any_like(SEARCH_COLUMNS, busqueda))
    return out


def opens_within(days: int, as_of: date | str | None = None) -> Column:
    """Opening date from today to `days` ahead; today alone for 0."""
    today = F.lit(as_of).cast("date") if as_of else F.current_date()
    return F.col("fecha_apertura").between(today, F.date_add(today, days))


def filter_tenders(df: DataFrame, **criteria) -> DataFrame:
    return df.filter(conjunction(list_predicates(**criteria)))


def library_filter(df: DataFrame, filtros: dict[str, str] | None = None) -> DataFrame:
    """The smaller filter set of the library call: agency by substring, exact municipality, two-column text."""
    filtros = filtros or {}
    tests = [F.col(k) == filtros[k] for k in ("fuente", "estado", "entidad_federativa", "municipio") if k in filtros]
    if "entidad" in filtros:
        tests.append(F.col("entidad_compradora").ilike(like_pattern(filtros["entidad"])))
    if "q" in filtros:
        tests.append(any_like(LIBRARY_SEARCH_COLUMNS, filtros["q"]))
    return df.filter(conjunction(tests))


def quick_search(df: DataFrame, q: str) -> DataFrame:
    if len(q) < 2:
        raise ValueError("q needs at least two characters")
    return df.filter(any_like(QUICK_SEARCH_COLUMNS, q))


def by_id(df: DataFrame, tender_id: int) -> DataFrame:
    """No row means not found."""
    return df.filter(F.col("id") == tender_id)


def not_null(df: DataFrame, *columns: str) -> DataFrame:
    return df.filter(conjunction(F.col(c).isNotNull() for c in columns))


def not_blank(df: DataFrame, *columns: str) -> DataFrame:
    return df.filter(conjunction(F.length(strip(F.col(c))) > 0 for c in columns))


def without_direct_awards(facet: DataFrame, column: str) -> DataFrame:
    """The procedure options selected at first: all that do not name a direct award."""
    return facet.filter(conjunction(~F.upper(column).contains(w) for w in DIRECT_AWARD_WORDS))


def filter_computed(df: DataFrame, columns: list[str], test: Callable[[Column], Column]) -> DataFrame:
    """Keeps the rows whose computed columns pass a test on them. A plain filter would be pushed below the projection
    that computes them, where Spark would evaluate their expressions a second time."""
    rest = [F.col(c) for c in df.columns if c not in columns]
    return df.select(*rest, F.inline(F.filter(F.array(F.struct(*columns)), test)))


def valid_rows() -> Column:
    """A row can be stored only with a procedure number and a source."""
    return (F.coalesce("numero_procedimiento", F.lit("")) != "") & (F.coalesce("fuente", F.lit("")) != "")


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with the reason)."""
    no_number = F.coalesce("numero_procedimiento", F.lit("")) == ""
    reason = F.when(no_number, "sin numero_procedimiento").otherwise("sin fuente")
    return df.filter(valid_rows()), df.filter(~valid_rows()).withColumn("motivo", reason)


def long_enough(df: DataFrame, column: str, n: int, strict: bool = False) -> DataFrame:
    """Rows whose stripped text has at least (or, strictly, more than) n characters."""
    size = F.length(strip(F.col(column)))
    return df.filter(size > n if strict else size >= n)


def pending_parse(flag: Column, specifics: Column) -> Column:
    """Not yet parsed: no specifics, no flag, or the flag is false."""
    return specifics.isNull() | flag.isNull() | ~flag
