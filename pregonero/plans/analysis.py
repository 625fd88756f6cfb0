"""Analyses by state, type, buyer, source and time."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dates import month_label, week_label
from ..operators.filters import not_null
from ..operators.joins import with_share
from ..operators.paging import top
from ..operators.windows import running_total, with_rank
from . import measures as m


def by_state(df: DataFrame) -> DataFrame:
    return (
        not_null(df, "entidad_federativa")
        .groupBy("entidad_federativa")
        .agg(
            m.rows("total_licitaciones"),
            m.distinct("entidad_compradora", "entidades_unicas"),
            m.distinct("tipo_contratacion", "tipos_contratacion"),
            m.distinct("municipio", "municipios_unicos"),
            m.total_amount(),
            m.mean_amount(),
            m.highest_amount(),
            m.first_day(),
            m.last_day(),
            m.distinct("fuente", "fuentes_datos"),
        )
    )


def towns_of_state(df: DataFrame, state: str) -> DataFrame:
    return (
        not_null(df.filter(F.col("entidad_federativa") == state), "municipio")
        .groupBy("municipio")
        .agg(
            m.rows(),
            m.total_amount(),
            m.mean_amount(),
            m.distinct("entidad_compradora", "entidades_unicas"),
            m.distinct("tipo_contratacion", "tipos_contratacion"),
        )
    )


def state_summary(df: DataFrame, state: str) -> DataFrame:
    return df.filter(F.col("entidad_federativa") == state).agg(
        m.rows("total"), m.distinct("municipio", "municipios_totales"), m.total_amount(), m.mean_amount()
    )


def national_distribution(df: DataFrame) -> DataFrame:
    """Per state, with its share of all rows that have a state."""
    states = (
        not_null(df, "entidad_federativa")
        .groupBy("entidad_federativa")
        .agg(m.rows(), m.total_amount(), m.mean_amount(), m.distinct("municipio", "municipios_activos"))
    )
    return with_share(states, "cantidad")


def by_contract_type(df: DataFrame) -> DataFrame:
    return (
        not_null(df, "tipo_contratacion")
        .groupBy("tipo_contratacion")
        .agg(
            m.rows(),
            m.total_amount(),
            m.mean_amount(),
            m.highest_amount(),
            m.lowest_amount(),
            m.distinct("entidad_compradora", "entidades_unicas"),
            m.distinct("entidad_federativa", "estados_involucrados"),
        )
    )


def by_buyer(df: DataFrame, limit: int = 20, state: str | None = None) -> DataFrame:
    if not 1 <= limit <= 100:
        raise ValueError("limit 1 to 100")
    rows = not_null(df, "entidad_compradora")
    if state:
        rows = rows.filter(F.col("entidad_federativa") == state)
    buyers = rows.groupBy("entidad_compradora").agg(
        m.rows("cantidad_licitaciones"),
        m.total_amount(),
        m.mean_amount(),
        m.distinct("tipo_contratacion", "tipos_contratacion"),
        m.distinct("tipo_procedimiento", "tipos_procedimiento"),
        m.distinct("entidad_federativa", "estados_cobertura"),
        m.first_day(),
        m.last_day(),
    )
    return top(buyers, limit, "cantidad_licitaciones", "entidad_compradora")


def ranked_buyers(df: DataFrame, limit: int = 20, state: str | None = None) -> DataFrame:
    order = [F.col("cantidad_licitaciones").desc(), F.col("entidad_compradora")]
    return with_rank(by_buyer(df, limit, state), order)


def by_source(df: DataFrame) -> DataFrame:
    return df.groupBy("fuente").agg(
        m.rows("total_licitaciones"),
        m.distinct("entidad_compradora", "entidades_unicas"),
        m.distinct("tipo_contratacion", "tipos_contratacion"),
        m.distinct("entidad_federativa", "estados_cubiertos"),
        m.distinct("municipio", "municipios_cubiertos"),
        m.filled("entidad_federativa", "con_estado"),
        m.filled("municipio", "con_municipio"),
        F.count_if(F.col("monto_estimado") > 0).alias("con_monto"),
        m.total_amount(),
        m.mean_amount(),
        m.first_day("fecha_mas_antigua"),
        m.last_day("fecha_mas_reciente"),
        F.max("fecha_captura").alias("ultima_actualizacion"),
    )


def period(granularity: str, day: Column) -> Column:
    forms = {"dia": "yyyy-MM-dd", "mes": "yyyy-MM", "año": "yyyy"}
    if granularity == "semana":
        return week_label(day)
    if granularity not in forms:
        raise ValueError("granularidad: dia, semana, mes or año")
    return F.date_format(day, forms[granularity])


def over_time(
    df: DataFrame, granularity: str = "mes", state: str | None = None, as_of: date | str | None = None
) -> DataFrame:
    """Periods of the year before `as_of`."""
    today = F.lit(as_of).cast("date") if as_of else F.current_date()
    rows = df.filter(F.col("fecha_publicacion") >= F.add_months(today, -12))
    if state:
        rows = rows.filter(F.col("entidad_federativa") == state)
    return (
        rows.groupBy(period(granularity, F.col("fecha_publicacion")).alias("periodo"))
        .agg(
            m.rows(),
            m.total_amount(),
            m.distinct("entidad_compradora", "entidades_unicas"),
            m.distinct("fuente", "fuentes"),
            m.distinct("entidad_federativa", "estados_involucrados"),
        )
    )


def cumulative(df: DataFrame, year: int) -> DataFrame:
    """Tenders per month of a year and their running total; at most twelve rows reach the window."""
    first = F.lit(f"{year:04d}-01-01").cast("date")
    months = (
        df.filter((F.col("fecha_publicacion") >= first) & (F.col("fecha_publicacion") < F.add_months(first, 12)))
        .groupBy(F.date_format("fecha_publicacion", "yyyy-MM").alias("mes"))
        .agg(m.rows())
    )
    return running_total(months, "mes", "cantidad")


def cumulative_labels(df: DataFrame, year: int) -> DataFrame:
    return cumulative(df, year).withColumn("etiqueta", month_label(F.col("mes")))


def dashboard_rollup(df: DataFrame) -> DataFrame:
    """Roll-ups over the sources, with both the sum of per-source buyers and the true number of buyers. One scan: rows are
    first folded to combinations of source, buyer and contract type."""
    folded = df.groupBy("fuente", "entidad_compradora", "tipo_contratacion").agg(
        m.rows("n"), F.count_if(F.col("monto_estimado") > 0).alias("con_monto")
    )
    return folded.agg(
        F.sum("n").alias("total_licitaciones"),
        F.count_distinct(F.coalesce("fuente", F.lit("")), F.col("entidad_compradora")).alias("entidades_suma"),
        F.sum("con_monto").alias("con_monto"),
        m.distinct("entidad_compradora", "entidades_distintas"),
        m.distinct("tipo_contratacion", "tipos_contratacion"),
    )


def relative_to_top(df: DataFrame, n: int = 8) -> DataFrame:
    """The leading contract types, each in percent of the first (the bar widths of the dashboard)."""
    types = top(by_contract_type(df).select("tipo_contratacion", "cantidad"), n, "cantidad", "tipo_contratacion")
    largest = types.agg(F.max("cantidad").alias("_max"))
    width = F.least(F.try_divide(F.col("cantidad").cast("double"), F.col("_max")) * 100, F.lit(100.0))
    return types.crossJoin(F.broadcast(largest)).withColumn("ancho", width).drop("_max")
