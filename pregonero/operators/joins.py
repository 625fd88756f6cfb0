"""Look-ups and updates by join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.jsons import merge
from ..functions.text import blank_to_null
from ..schema import GAZETTE
from .windows import first_per_key


def with_share(counts: DataFrame, measure: str, name: str = "porcentaje_nacional") -> DataFrame:
    """Share of the total of a grouped report, half-up at two decimals. The total is one row."""
    total = counts.agg(F.sum(measure).alias("_total"))
    share = F.round(F.col(measure).cast("decimal(20,0)") * 100 / F.col("_total").cast("decimal(20,0)"), 2)
    return counts.crossJoin(F.broadcast(total)).withColumn(name, share.cast("double")).drop("_total")


def facet_of(facet: DataFrame, column: str, value: str | None) -> DataFrame:
    """Drill-down: the rows of one parent value, or all of them."""
    return facet.filter(F.col(column) == value) if value else facet


def not_in(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    return df.join(table.select(key), key, "left_anti")


def patch_by_number(table: DataFrame, patches: DataFrame) -> DataFrame:
    """patches(numero_licitacion, orden, parche JSON) merged into datos_originales of gazette rows with that number.
    Of several patches for one number the last one stays, as if applied in order."""
    latest = first_per_key(
        patches.filter(blank_to_null(F.col("numero_licitacion")).isNotNull()),
        ["numero_licitacion"],
        [F.col("orden").desc()],
    ).select(F.col("numero_licitacion").alias("_numero"), F.col("parche").alias("_parche"))
    gazette = table.filter(F.col("fuente") == GAZETTE)
    return _patched(gazette.join(latest, F.col("numero_procedimiento") == F.col("_numero"), "left"), table)


def _patched(gazette: DataFrame, table: DataFrame) -> DataFrame:
    """Gazette rows with their patch (`_parche` or null) merged, then the rows of the other sources, which no join touches."""
    merged = F.when(
        F.col("_parche").isNotNull() & F.col("datos_originales").isNotNull(), merge(F.col("datos_originales"), F.col("_parche"))
    ).otherwise(F.col("datos_originales"))
    rows = gazette.withColumn("actualizada", F.col("_parche").isNotNull()).withColumn("datos_originales", merged)
    others = table.filter(~F.col("fuente").eqNullSafe(GAZETTE)).withColumn("actualizada", F.lit(False))
    return rows.select(*table.columns, "actualizada").unionByName(others)


def patch_by_agency_and_object(table: DataFrame, patches: DataFrame, prefix: int = 50) -> DataFrame:
    """For patches without number: same agency, and the title contains the first `prefix` characters of the object (taken
    literally). Each row keeps its last matching patch.

    Containment is turned into an equi-join: every distinct title of an agency with patches gives the hashes of its
    substrings of the lengths that occur among the agency's patches, and these meet the hashed object texts. So a large
    agency is spread over its texts instead of comparing all its titles with all its patches; the candidates are then
    verified on the text itself.
    """
    nameless = patches.filter(
        blank_to_null(F.col("numero_licitacion")).isNull()
        & blank_to_null(F.col("dependencia")).isNotNull()
        & blank_to_null(F.col("objeto_licitacion")).isNotNull()
    ).withColumn("_prefijo", F.substring("objeto_licitacion", 1, prefix))
    latest = first_per_key(nameless, ["dependencia", "_prefijo"], [F.col("orden").desc()]).select(
        F.col("dependencia").alias("_dependencia"),
        F.xxhash64("_prefijo").alias("_trozo"),
        "_prefijo",
        F.col("orden").alias("_orden"),
        F.col("parche").alias("_parche"),
    )
    lengths = latest.groupBy("_dependencia").agg(F.collect_set(F.length("_prefijo")).alias("_largos"))  # at most `prefix` values each
    gazette = table.filter(F.col("fuente") == GAZETTE)
    titles = (
        gazette.select(F.col("entidad_compradora").alias("_dependencia"), F.col("titulo").alias("_titulo"))
        .join(lengths, "_dependencia")
        .groupBy("_dependencia", "_titulo")
        .agg(F.first("_largos").alias("_largos"))
        .withColumn("_clave", F.xxhash64("_titulo"))
    )

    def pieces(n: Column) -> Column:
        starts = F.sequence(F.lit(1), F.length("_titulo") - n + 1)
        return F.when(
            F.length("_titulo") >= n, F.transform(starts, lambda at: F.xxhash64(F.substring(F.col("_titulo"), at, n)))
        ).otherwise(F.array().cast("array<bigint>"))

    grams = titles.select(
        "_dependencia", "_clave", F.explode(F.array_distinct(F.flatten(F.transform("_largos", pieces)))).alias("_trozo")
    )
    chosen = (
        grams.join(latest, ["_dependencia", "_trozo"])
        .join(titles.drop("_largos"), ["_dependencia", "_clave"])
        .filter(F.col("_titulo").contains(F.col("_prefijo")))
        .groupBy("_dependencia", "_titulo")
        .agg(F.max_by("_parche", "_orden").alias("_parche"))
    )
    own = (F.col("entidad_compradora") == F.col("_dependencia")) & (F.col("titulo") == F.col("_titulo"))
    return _patched(gazette.join(chosen, own, "left"), table)


def fill_from(table: DataFrame, source: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Left look-up that only fills what is missing."""
    right = source.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    return (
        table.join(right, key, "left")
        .withColumns({c: F.coalesce(F.col(c), F.col(f"_{c}")) for c in columns})
        .drop(*[f"_{c}" for c in columns])
    )


def longer(a: Column, b: Column) -> Column:
    return F.when(F.length(b) > F.length(F.coalesce(a, F.lit(""))), b).otherwise(a)
