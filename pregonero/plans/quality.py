"""Migration, integrity, load, extraction and schema reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.jsons import flag
from ..functions.text import blank_to_null
from ..operators.paging import top
from ..schema import GAZETTE, PORTAL, TENDER
from . import measures as m

# Labels for missing parts and the bounds of the confidence classes.
NO_AGENCY, NO_CHARACTER, NO_STATE = "SIN DEPENDENCIA", "NO ESPECIFICADO", "No especificado"
HIGH, MIDDLE = 0.8, 0.5
DATE_FIELDS = ["fecha_publicacion", "fecha_junta_aclaraciones", "fecha_presentacion_apertura", "fecha_fallo"]


def migration_statistics(df: DataFrame) -> DataFrame:
    portal, gazette = F.col("fuente") == PORTAL, F.col("fuente") == GAZETTE
    pending = flag(F.col("datos_especificos"), "procesado_parser") == F.lit(False)
    return df.agg(
        m.rows("total_registros"),
        m.filled("datos_originales", "con_datos_originales"),
        m.filled("datos_especificos", "con_datos_especificos"),
        F.count_if(portal & F.col("entidad_federativa").isNotNull()).alias("comprasmx_con_estado"),
        F.count_if(gazette).alias("total_dof"),
        F.count_if(gazette & pending).alias("dof_pendientes"),
    )


def migration_by_source(df: DataFrame) -> DataFrame:
    return df.groupBy("fuente").agg(
        m.rows("total"), m.filled("datos_especificos", "migrados"), m.filled("entidad_federativa", "con_estado")
    )


def not_migrated(df: DataFrame) -> DataFrame:
    """Rows with originals but no specifics."""
    return df.filter(F.col("datos_originales").isNotNull() & F.col("datos_especificos").isNull())


def integrity(df: DataFrame) -> DataFrame:
    return df.agg(
        m.rows("total"),
        F.count_if(F.col("datos_originales").isNotNull() & F.col("datos_especificos").isNull()).alias("sin_migrar"),
    )


def load_report(df: DataFrame) -> DataFrame:
    """Gazette rows: totals, distinct places, filled places with percent."""
    return (
        df.filter(F.col("fuente") == GAZETTE)
        .agg(
            m.rows("total"),
            m.distinct("entidad_federativa", "entidades"),
            m.distinct("municipio", "municipios"),
            m.filled("entidad_federativa", "con_entidad"),
            m.filled("municipio", "con_municipio"),
        )
        .withColumns(
            {
                "porcentaje_entidad": m.percent(F.col("con_entidad"), F.col("total")),
                "porcentaje_municipio": m.percent(F.col("con_municipio"), F.col("total")),
            }
        )
    )


def load_top_states(df: DataFrame, n: int = 5) -> DataFrame:
    rows = df.filter((F.col("fuente") == GAZETTE) & F.col("entidad_federativa").isNotNull())
    return top(rows.groupBy("entidad_federativa").agg(m.rows()), n, "cantidad", "entidad_federativa")


def success_rate(counts: DataFrame) -> DataFrame:
    """counts(insertadas, actualizadas, duplicadas) -> with tasa_exito in percent."""
    good = F.col("insertadas") + F.col("actualizadas")
    return counts.withColumn("tasa_exito", m.percent(good, good + F.col("duplicadas")))


def parse_progress(df: DataFrame) -> DataFrame:
    """Gazette rows parsed and placed, percentages cut to whole numbers."""
    done = flag(F.col("datos_especificos"), "procesado")

    def whole(c: str) -> Column:
        return F.floor(F.try_divide(F.col(c) * 100, F.col("total_dof"))).cast("long")

    return (
        df.filter(F.col("fuente") == GAZETTE)
        .agg(
            m.rows("total_dof"),
            m.filled("entidad_federativa", "con_estado"),
            m.filled("municipio", "con_municipio"),
            F.count_if(done).alias("procesadas"),
        )
        .withColumns({"porcentaje_estado": whole("con_estado"), "porcentaje_municipio": whole("con_municipio")})
    )


# --- extraction reports over notices -----------------------------------------------------------------------------

def _extraction_measures() -> list[Column]:
    dates_present = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in DATE_FIELDS])
    return [
        m.rows("total"),
        m.filled("numero_licitacion", "con_numero_completo"),
        m.filled("entidad_federativa", "con_ubicacion"),
        F.count_if(dates_present >= 3).alias("con_fechas_completas"),
        # Confidences are whole hundredths, so the mean is taken over exact integers and rounded half-even.
        F.bround(F.sum(_hundredths()).cast("decimal(20,0)") / F.count(F.lit(1)).cast("decimal(20,0)") / 100, 2)
        .cast("double")
        .alias("confianza_promedio"),
        F.bround(F.sum("campos_extraidos").cast("decimal(20,0)") / F.count(F.lit(1)).cast("decimal(20,0)"), 1)
        .cast("double")
        .alias("campos_promedio"),
        F.min("fecha_publicacion").alias("fecha_min"),
        F.max("fecha_publicacion").alias("fecha_max"),
    ]


def _hundredths() -> Column:
    return F.round(F.col("confianza_extraccion") * 100).cast("long")


def extraction_by_file(notices: DataFrame) -> DataFrame:
    return notices.groupBy("archivo").agg(*_extraction_measures())


def extraction_overall(notices: DataFrame) -> DataFrame:
    """The same over all files; the mean is the true mean, not that of the last file."""
    return notices.agg(*_extraction_measures())


def extraction_facets(notices: DataFrame, per_file: bool = True, agency_label: int = 50) -> DataFrame:
    """Counts by state, type, character, agency and, overall, edition date, in one shuffle. Agencies are told apart by their
    whole names; only the label is cut."""
    values = {
        "entidad": F.col("entidad_federativa"),
        "tipo": F.col("tipo_contratacion"),
        "caracter": F.col("caracter_procedimiento"),
        "dependencia": F.col("dependencia"),
    }
    if not per_file:
        values["fecha_ejemplar"] = F.col("fecha_ejemplar")
    keys = ["archivo"] if per_file else []
    return (
        notices.select(*keys, *[v.alias(k) for k, v in values.items()])
        .unpivot(keys, list(values), "faceta", "valor")
        .filter("valor is not null")
        .groupBy(*keys, "faceta", "valor")
        .agg(m.rows())
        .withColumn("valor", F.when(F.col("faceta") == "dependencia", F.substring("valor", 1, agency_label)).otherwise(F.col("valor")))
    )


def file_status(files: DataFrame, notices: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Each file with its number of notices and EXITOSO, SIN_DATOS or ERROR."""
    counts = notices.groupBy("archivo").agg(m.rows("licitaciones"))
    out = files.select("archivo").join(counts, "archivo", "left").withColumn(
        "licitaciones", F.coalesce("licitaciones", F.lit(0).cast("long"))
    )
    status = F.when(F.col("licitaciones") > 0, "EXITOSO").otherwise("SIN_DATOS")
    if failed is not None:
        out = out.join(failed.select("archivo", F.lit(True).alias("_error")).distinct(), "archivo", "left")
        status = F.when(F.col("_error"), "ERROR").otherwise(status)
    return out.withColumn("status", status).drop("_error")


def file_status_counts(status: DataFrame) -> DataFrame:
    return status.groupBy("status").agg(m.rows("archivos"), F.sum("licitaciones").alias("licitaciones"))


def confidence_classes(notices: DataFrame) -> DataFrame:
    c = F.col("confianza_extraccion")
    return notices.agg(
        F.count_if(c >= HIGH).alias("alta"),
        F.count_if((c >= MIDDLE) & (c < HIGH)).alias("media"),
        F.count_if(c < MIDDLE).alias("baja"),
        F.try_divide(F.sum(_hundredths()).cast("double"), F.count(F.lit(1)) * 100).alias("confianza_promedio"),
    )


def labelled_counts(notices: DataFrame, column: str, missing: str) -> DataFrame:
    """Counts with a label for missing and empty values."""
    label = F.coalesce(blank_to_null(F.col(column)), F.lit(missing))
    return notices.groupBy(label.alias(column)).agg(m.rows())


def pages_with_notices(notices: DataFrame, file: str = "archivo", page: str = "pagina") -> DataFrame:
    return notices.groupBy(file).agg(F.count_distinct(page).alias("paginas"))


def corpus_totals(texts: DataFrame, results: DataFrame) -> DataFrame:
    """Number of text files, result files and notices in them; results(archivo, text)."""
    notices = F.json_array_length(F.get_json_object("text", "$.licitaciones"))
    counted = results.agg(m.rows("archivos_json"), F.coalesce(F.sum(notices), F.lit(0)).cast("long").alias("licitaciones"))
    return texts.agg(m.rows("archivos_txt")).crossJoin(F.broadcast(counted))


def capture_coverage(captured: DataFrame, system_total: Column) -> DataFrame:
    """Distinct cases against the total the portal names, and the share of rows with a real hash, in percent."""
    ids = F.count_distinct("cod_expediente").cast("double")
    return captured.agg(
        F.count_distinct("cod_expediente").alias("total_expedientes_capturados"),
        F.count_if(F.col("hash_uuid_real").isNotNull()).alias("expedientes_con_hash_real"),
        F.coalesce(F.try_divide(F.count("hash_uuid_real").cast("double"), F.count(F.lit(1))) * 100, F.lit(0.0)).alias(
            "porcentaje_hash_real"
        ),
        F.coalesce(F.try_divide(ids, F.max(system_total)) * 100, F.lit(0.0)).alias("cobertura_sistema"),
    )


def field_profile(recs: DataFrame, source: str = "fuente", json: str = "datos_originales") -> DataFrame:
    """Per source and top-level field: rows, rows with a value, kinds of value and one example."""
    entries = F.explode(F.map_entries(F.from_json(json, "map<string,variant>"))).alias("e")
    kind = F.regexp_extract(F.schema_of_variant("v"), r"^[A-Z]+", 0)
    return (
        recs.select(source, entries)
        .select(source, F.col("e.key").alias("campo"), F.col("e.value").alias("v"))
        .withColumns({"tipo": kind, "ejemplo": F.substring(F.col("v").cast("string"), 1, 100)})
        .groupBy(source, "campo")
        .agg(
            m.rows("registros"),
            F.count("ejemplo").alias("con_valor"),
            F.array_join(F.sort_array(F.collect_set("tipo")), ",").alias("tipos"),
            F.min("ejemplo").alias("ejemplo"),
        )
    )


def schema_check(df: DataFrame) -> DataFrame:
    """Each canonical column with its expected and actual type and its number of filled rows, from one scan."""
    actual = {f.name: f.dataType.simpleString() for f in df.schema}
    filled = df.agg(*[(F.count(f.name) if f.name in actual else F.lit(0).cast("long")).alias(f.name) for f in TENDER])
    entries = F.array(
        *[
            F.struct(
                F.lit(f.name).alias("columna"),
                F.lit(f.dataType.simpleString()).alias("esperado"),
                F.lit(actual.get(f.name)).cast("string").alias("actual"),
                F.lit(actual.get(f.name) == f.dataType.simpleString()).alias("ok"),
                F.col(f.name).alias("con_valor"),
            )
            for f in TENDER
        ]
    )
    return filled.select(F.inline(entries))
