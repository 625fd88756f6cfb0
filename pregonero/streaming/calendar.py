"""Edition calendar and the processing state of editions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Weekdays of an edition (Sunday is 1), edition names, weekday names.
EDITION_DAYS = [3, 5]
EDITIONS = ["MAT", "VES"]
WEEKDAYS = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]


def edition_days(bounds: DataFrame, since: Column, until: Column) -> DataFrame:
    """Tuesdays and Thursdays between two dates of a one-row DataFrame."""
    return bounds.select(F.explode(F.sequence(since, until)).alias("fecha")).filter(
        F.dayofweek("fecha").isin(EDITION_DAYS)
    )


def edition_calendar(spark: SparkSession, since: str, until: str) -> DataFrame:
    one = spark.range(1)
    return edition_days(one, F.lit(since).cast("date"), F.lit(until).cast("date"))


def editions(days: DataFrame) -> DataFrame:
    """Each day with both editions."""
    return days.select("fecha", F.explode(F.array(*[F.lit(e) for e in EDITIONS])).alias("edicion"))


def missing_editions(days: DataFrame, loaded: DataFrame) -> DataFrame:
    """Editions of the calendar that were not loaded; loaded(fecha, edicion)."""
    return editions(days).join(loaded.select("fecha", "edicion"), ["fecha", "edicion"], "left_anti")


def day_progress(days: DataFrame, loaded: DataFrame) -> DataFrame:
    """Number of calendar days, and of those with at least one loaded edition."""
    done = loaded.select("fecha", F.lit(True).alias("_done")).distinct()
    return days.join(done, "fecha", "left").agg(
        F.count(F.lit(1)).alias("fechas_total"), F.count("_done").alias("fechas_procesadas")
    )


def processing_report(days: DataFrame, files: DataFrame, pages: DataFrame, notices: DataFrame) -> DataFrame:
    """One row per edition: downloaded, text_extracted or fully_processed, or the step that failed.

    files, pages and notices hold (fecha, edicion); their number of rows per edition is all that is joined.
    """
    keys = ["fecha", "edicion"]

    def count(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))

    state = (
        F.when(F.col("archivos").isNull(), "download_failed")
        .when(F.col("paginas").isNull(), "text_extraction_failed")
        .when(F.col("licitaciones").isNull(), "text_extracted")
        .otherwise("fully_processed")
    )
    names = F.array(*[F.lit(w) for w in WEEKDAYS])
    return (
        editions(days)
        .join(count(files, "archivos"), keys, "left")
        .join(count(pages, "paginas"), keys, "left")
        .join(count(notices, "licitaciones"), keys, "left")
        .select(
            *keys,
            F.get(names, F.dayofweek("fecha") - 1).alias("dia_semana"),
            F.coalesce("paginas", F.lit(0).cast("long")).alias("paginas"),
            F.coalesce("licitaciones", F.lit(0).cast("long")).alias("licitaciones"),
            state.alias("status"),
        )
    )


def processing_counters(report: DataFrame) -> DataFrame:
    return report.groupBy("status").agg(F.count(F.lit(1)).alias("ediciones"))
