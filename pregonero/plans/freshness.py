"""Cursors, last runs and due flags per source, always relative to a given moment."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import first_filled
from ..schema import GAZETTE, OCDS, PORTAL, SITES, SOURCES
from . import measures as m

# How often each source is due.
MIN_HOURS = 6
GAZETTE_DAYS = [3, 5]  # Tuesday and Thursday, Sunday is 1
GAZETTE_HOURS = [9, 21]
SITES_DAY = 1
SITES_MIN_DAYS = 7


def added_since(df: DataFrame, since: datetime | str) -> DataFrame:
    return df.filter(F.col("fecha_captura") >= F.lit(since).cast("timestamp")).groupBy("fuente").agg(m.rows("nuevos"))


def last_cursor(df: DataFrame) -> DataFrame:
    """Per source the cursor of the newest capture (uuid, else procedure number) and the last publication day."""
    cursor = first_filled(F.col("uuid_procedimiento"), F.col("numero_procedimiento"))
    usable = F.when(cursor.isNotNull(), F.struct("fecha_captura", cursor.alias("cursor")))
    return df.groupBy("fuente").agg(
        F.max(usable)["cursor"].alias("cursor"), F.max("fecha_publicacion").alias("ultima_publicacion")
    )


def with_all_sources(df: DataFrame) -> DataFrame:
    """(fuente, fecha_captura, _filas) of all rows, and a row that counts for nothing for each known source, so that a
    source which never ran is reported too."""
    known = df.sparkSession.createDataFrame([(s,) for s in SOURCES], "fuente string")
    rows = df.select("fuente", "fecha_captura", F.lit(1).alias("_filas"))
    return rows.unionByName(known.select("fuente", F.lit(None).cast(rows.schema["fecha_captura"].dataType).alias("fecha_captura"), F.lit(0).alias("_filas")))


def processed_on(df: DataFrame, day: str) -> DataFrame:
    return with_all_sources(df).groupBy("fuente").agg(
        F.coalesce(F.bool_or(F.to_date("fecha_captura") == F.lit(day).cast("date")), F.lit(False)).alias("procesado_hoy")
    )


def last_processing(df: DataFrame) -> DataFrame:
    return with_all_sources(df).groupBy("fuente").agg(F.max("fecha_captura").alias("ultimo_proceso"), F.sum("_filas").alias("cantidad"))


def report(df: DataFrame, as_of: datetime | str) -> DataFrame:
    """Per source: last run, hours since, rows of the last 24 hours, due flag and the reason of a skip."""
    now = F.lit(as_of).cast("timestamp")
    captured = F.col("fecha_captura")
    runs = with_all_sources(df).groupBy("fuente").agg(
        F.max("fecha_captura").alias("ultimo_proceso"),
        F.count_if(captured >= now - F.expr("INTERVAL 24 HOURS")).alias("registros_24h"),
        F.coalesce(F.bool_or(F.to_date(captured) == F.to_date(now)), F.lit(False)).alias("procesado_hoy"),
    )
    hours = (F.unix_micros(now) - F.unix_micros("ultimo_proceso")).cast("double") / 3_600_000_000
    return runs.withColumn("horas_desde", hours).withColumns({"ejecutar": due(now), "razon": skip_reason(now)})


def due(now: Column) -> Column:
    hours = F.col("horas_desde")
    weekday = F.dayofweek(now)
    never = F.col("ultimo_proceso").isNull()
    gazette = weekday.isin(GAZETTE_DAYS) & F.hour(now).isin(GAZETTE_HOURS) & ~F.col("procesado_hoy")
    sites = (weekday == SITES_DAY) & (never | (F.floor(hours / 24) >= SITES_MIN_DAYS))
    return (
        F.when(F.col("fuente") == GAZETTE, gazette)
        .when(F.col("fuente") == SITES, sites)
        .when(F.col("fuente").isin(PORTAL, OCDS), never | (hours >= MIN_HOURS))
        .otherwise(F.lit(True))
    )


def skip_reason(now: Column) -> Column:
    hours = F.format_string("%.1f", F.col("horas_desde"))
    text = (
        F.when(F.col("fuente") == GAZETTE, "No es martes/jueves o ya procesado")
        .when(F.col("ultimo_proceso").isNull(), "Primera ejecución")
        .otherwise(F.concat(F.lit("Ejecutado hace "), hours, F.lit(f"h (< {MIN_HOURS}h)")))
    )
    return F.when(~due(now), text)
