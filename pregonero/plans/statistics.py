"""Counts, facets and library statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.filters import not_null
from ..operators.paging import top
from ..schema import PORTAL
from . import measures as m

# The facets offered and the sizes of the top lists.
FACETS = ["fuente", "estado", "tipo_contratacion", "tipo_procedimiento"]
TOP_STATES, TOP_BUYERS, TOP_TOWNS = 10, 100, 50
NOT_AVAILABLE = "No disponible"


def total(df: DataFrame) -> DataFrame:
    return df.agg(m.rows("total"))


def counts_by(df: DataFrame, *columns: str, keep_null: bool = False) -> DataFrame:
    """Rows per value, missing values left out unless asked for."""
    rows = df if keep_null else not_null(df, columns[0])
    return rows.groupBy(*columns).agg(m.rows())


def top_counts(df: DataFrame, n: int, *columns: str) -> DataFrame:
    return top(counts_by(df, *columns), n, "cantidad", *columns)


def completeness(df: DataFrame) -> DataFrame:
    return df.agg(
        m.filled("entidad_federativa", "con_entidad"),
        m.filled("municipio", "con_municipio"),
        m.filled("datos_especificos", "con_datos_especificos"),
    )


def last_capture(df: DataFrame) -> DataFrame:
    return df.groupBy("fuente").agg(F.max("fecha_captura").alias("ultima_actualizacion"))


def unpivot_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(faceta, valor) pairs without missing values."""
    return df.select([F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        [], columns, "faceta", "valor"
    ).filter("valor is not null")


def facets(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """All facet counts in one scan and one shuffle of already counted values."""
    return unpivot_values(df, columns or FACETS).groupBy("faceta", "valor").agg(m.rows())


def general_report(df: DataFrame) -> DataFrame:
    """The whole statistics page as (faceta, valor, cantidad, momento): total and completeness, counts by source, status,
    state and contract type, the buyer with most tenders, and the last capture of each source.

    One scan counts the combinations of the four low-cardinality columns; all but the buyer is added up from these.
    """
    columns = ["fuente", "estado", "entidad_federativa", "tipo_contratacion"]
    combinations = df.groupBy(*columns).agg(
        F.count(F.lit(1)).alias("total"), F.count("municipio").alias("con_municipio"),
        F.count("datos_especificos").alias("con_datos_especificos"), F.max("fecha_captura").alias("ultima"),
    )
    counters = ["total", "con_municipio", "con_datos_especificos"]
    none, text = F.lit(None), "string"
    entries = F.array(
        *[F.struct(F.lit(c).alias("faceta"), F.col(c).alias("valor"), F.col("total").alias("n"), none.cast("timestamp").alias("t")) for c in columns],
        *[F.struct(F.lit(c).alias("faceta"), none.cast(text).alias("valor"), F.col(c).alias("n"), none.cast("timestamp").alias("t")) for c in counters],
        F.struct(F.lit("ultima_actualizacion").alias("faceta"), F.col("fuente").alias("valor"), none.cast("long").alias("n"), F.col("ultima").alias("t")),
    )
    counted = (
        combinations.select(F.inline(entries)).filter(F.col("valor").isNotNull() | F.col("faceta").isin(counters))
        .groupBy("faceta", "valor").agg(F.sum("n").alias("cantidad"), F.max("t").alias("momento"))
    )
    buyer = top_counts(df, 1, "entidad_compradora").select(
        F.lit("entidad_compradora").alias("faceta"), F.col("entidad_compradora").alias("valor"), "cantidad", none.cast("timestamp").alias("momento")
    )
    return counted.unionByName(buyer)


def state_facet(df: DataFrame) -> DataFrame:
    return (
        not_null(df, "entidad_federativa")
        .groupBy("entidad_federativa")
        .agg(m.rows(), m.distinct("municipio", "municipios_unicos"))
    )


def town_facet(df: DataFrame, n: int = TOP_TOWNS) -> DataFrame:
    return top_counts(df, n, "municipio", "entidad_federativa")


def geographic_coverage(df: DataFrame) -> DataFrame:
    return df.agg(
        m.distinct("entidad_federativa", "estados_con_datos"),
        m.distinct("municipio", "municipios_con_datos"),
        m.filled("entidad_federativa", "licitaciones_con_estado"),
        m.filled("municipio", "licitaciones_con_municipio"),
        m.rows("total_licitaciones"),
    )


def coverage_percent(df: DataFrame) -> DataFrame:
    return geographic_coverage(df).select(
        m.percent(F.col("licitaciones_con_estado"), F.col("total_licitaciones")).alias("porcentaje_cobertura")
    )


def top_or_default(df: DataFrame, column: str) -> DataFrame:
    """The most frequent value, or one default row for an empty table."""
    best = top_counts(df, 1, column).select(F.struct(column, "cantidad").alias("best"))
    none = F.struct(F.lit(NOT_AVAILABLE).alias(column), F.lit(0).cast("long").alias("cantidad"))
    return best.agg(F.coalesce(F.first("best"), none).alias("r")).select("r.*")


def detail_coverage(df: DataFrame) -> DataFrame:
    """Portal rows with an integrated detail, all portal rows, and the share in percent."""
    has_detail = F.col("datos_especificos").contains("detalle_individual")
    return (
        df.filter(F.col("fuente") == PORTAL)
        .agg(F.count_if(has_detail).alias("comprasmx_con_detalles"), m.rows("comprasmx_total"))
        .withColumn(
            "porcentaje_detalles_comprasmx",
            F.coalesce(F.try_divide(F.col("comprasmx_con_detalles").cast("double"), F.col("comprasmx_total")) * 100, F.lit(0.0)),
        )
    )


def library_statistics(df: DataFrame, top_states: int = TOP_STATES) -> DataFrame:
    """One row: total, counts by source, status and leading states as maps, detail coverage. One scan counts the
    combinations of source, status and state; the rest is added up from these."""
    keys = ["fuente", "estado", "entidad_federativa"]
    portal = F.col("fuente") == PORTAL
    detailed = portal & F.col("datos_especificos").contains("detalle_individual")
    combinations = df.groupBy(*keys).agg(m.rows("n"), F.count_if(portal).alias("portal"), F.count_if(detailed).alias("detalle"))
    entry = lambda facet, value, n: F.struct(F.lit(facet).alias("faceta"), value.alias("valor"), F.col(n).alias("n"))
    none = F.lit(None).cast("string")
    sums = (
        combinations.select(F.inline(F.array(*[entry(k, F.col(k), "n") for k in keys], *[entry(c, none, c) for c in ("n", "portal", "detalle")])))
        .filter(F.col("valor").isNotNull() | ~F.col("faceta").isin(keys))
        .groupBy("faceta", "valor")
        .agg(F.sum("n").alias("n"))
    )

    def number(facet: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("faceta") == facet, F.col("n"))), F.lit(0))

    def entries(facet: str, most: int | None = None) -> Column:
        found = F.sort_array(F.collect_list(F.when(F.col("faceta") == facet, F.struct((-F.col("n")).alias("minus"), "valor", "n"))))
        pairs = F.transform(found if most is None else F.slice(found, 1, most), lambda e: F.struct(e["valor"], e["n"].alias("cantidad")))
        return F.map_from_entries(F.sort_array(pairs))

    row = sums.agg(
        number("n").alias("total"), entries("fuente").alias("por_fuente"), entries("estado").alias("por_estado"),
        entries("entidad_federativa", top_states).alias("por_entidad_federativa"),
        number("detalle").alias("comprasmx_con_detalles"), number("portal").alias("comprasmx_total"),
    )
    share = F.try_divide(F.col("comprasmx_con_detalles").cast("double"), F.col("comprasmx_total")) * 100
    return row.withColumn("porcentaje_detalles_comprasmx", F.coalesce(share, F.lit(0.0)))


def status_overview(df: DataFrame, n: int = 5) -> DataFrame:
    """Counts by source, number of states and the leading states as (seccion, clave, cantidad)."""

    def section(name: str, rows: DataFrame, key: Column, value: str = "cantidad") -> DataFrame:
        return rows.select(F.lit(name).alias("seccion"), key.alias("clave"), F.col(value).alias("cantidad"))

    states = df.agg(m.distinct("entidad_federativa", "cantidad"))
    return (
        section("fuente", counts_by(df, "fuente"), F.col("fuente"))
        .unionByName(section("estados", states, F.lit("distintos")))
        .unionByName(section("entidad", top_counts(df, n, "entidad_federativa"), F.col("entidad_federativa")))
    )
