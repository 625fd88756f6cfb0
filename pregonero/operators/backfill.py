"""Completion of normalised rows before the write, and the same steps on rows already stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.jsons import KEEP_NULLS, field, has_key, member
from ..functions.keys import content_key
from ..functions.text import blank_to_null, first_filled, truncate
from ..schema import GAZETTE, OCDS, PORTAL
from ..sources.portal import longer_text, specifics

# Defaults on write.
NO_TITLE, NO_AGENCY, NO_CURRENCY = "Sin título", "No especificada", "MXN"
SOURCE_SPELLINGS = {"COMPRASMX": PORTAL}


def with_defaults(df: DataFrame) -> DataFrame:
    """Title from the description, agency, currency and the canonical source name."""
    source = F.col("fuente")
    for spelling, name in SOURCE_SPELLINGS.items():
        source = F.when(source == spelling, name).otherwise(source)
    return df.withColumns(
        {
            "titulo": F.coalesce(blank_to_null(F.col("titulo")), truncate(F.col("descripcion"), 500), F.lit(NO_TITLE)),
            "entidad_compradora": F.coalesce(blank_to_null(F.col("entidad_compradora")), F.lit(NO_AGENCY)),
            "moneda": F.coalesce(blank_to_null(F.col("moneda")), F.lit(NO_CURRENCY)),
            "fuente": source,
        }
    )


def with_geography(df: DataFrame) -> DataFrame:
    """State and municipality by source: portal from detail, record, specifics; open contracting from the address."""
    originals = F.try_parse_json("datos_originales")
    own = F.try_parse_json("datos_especificos")
    info = "detalle_individual"
    address = "tender.procuringEntity.address"

    def portal(detail_key: str, record_key: str) -> Column:
        return first_filled(
            field(own, f"{info}.informacion_extraida.{detail_key}"),
            field(own, f"{info}.{detail_key}"),
            field(originals, record_key),
            field(own, detail_key),
        )

    def fill(column: str, portal_value: Column, ocds_key: str) -> Column:
        found = F.when(F.col("fuente") == PORTAL, portal_value).when(
            F.col("fuente") == OCDS, first_filled(field(originals, f"{address}.{ocds_key}"))
        )
        return F.coalesce(found, F.col(column))

    return df.withColumns(
        {
            "entidad_federativa": fill("entidad_federativa", portal("entidad_federativa", "entidad_federativa_contratacion"), "region"),
            "municipio": fill("municipio", portal("municipio", "municipio"), "locality"),
        }
    )


def gazette_specifics(originals: Column) -> Column:
    return F.to_json(
        F.struct(
            F.col("titulo").alias("titulo_original"),
            F.col("descripcion").alias("descripcion_original"),
            *[field(originals, k).alias(k) for k in ("fecha_ejemplar", "seccion", "organismo", "notas")],
            F.lit(False).alias("procesado_parser"),
        ),
        KEEP_NULLS,
    )


def ocds_specifics(originals: Column) -> Column:
    return F.to_json(
        F.struct(
            F.when(has_key(originals, "ocid"), originals).alias("ocds_data"),
            member(originals, "tender.classification").alias("classification"),
            member(originals, "tender.procuringEntity").alias("procuring_entity"),
            member(originals, "tender.items").alias("items"),
            member(originals, "tender.documents").alias("documents"),
            member(originals, "tender.milestones").alias("milestones"),
        ),
        KEEP_NULLS,
    )


def source_specifics() -> Column:
    """The source-specific JSON built from a row's original data; null for other sources."""
    originals = F.try_parse_json(F.coalesce("datos_originales", F.lit("{}")))
    return (
        F.when(F.col("fuente") == PORTAL, specifics(originals, F.col("tipo_procedimiento"), F.col("caracter")))
        .when(F.col("fuente") == GAZETTE, gazette_specifics(originals))
        .when(F.col("fuente") == OCDS, ocds_specifics(originals))
    )


def with_specifics(df: DataFrame) -> DataFrame:
    """Specifics as given, else built; the longer detail text replaces a shorter description."""
    full = F.get_json_object("datos_especificos", "$.detalle_individual.descripcion_completa")
    return df.withColumns(
        {
            "descripcion": longer_text(F.col("descripcion"), full),
            "datos_especificos": F.coalesce("datos_especificos", source_specifics()),
        }
    )


def with_key(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "hash_contenido",
        content_key(F.col("fuente"), F.col("uuid_procedimiento"), F.col("numero_procedimiento"), F.col("entidad_compradora")),
    )


def finish(df: DataFrame) -> DataFrame:
    """Defaults, geography, specifics and key: a normalised row made ready for the write."""
    return with_key(with_specifics(with_geography(with_defaults(df))))


def backfill(table: DataFrame) -> DataFrame:
    """One pass over stored rows: state and municipality of portal rows, specifics per source, and the copy of the
    originals only where nothing else could be built."""
    originals = F.col("datos_originales")
    portal = F.col("fuente") == PORTAL

    def from_originals(column: str, key: str) -> Column:
        return F.coalesce(F.col(column), F.when(portal, F.get_json_object(originals, f"$.{key}")))

    built = F.when(originals.isNotNull() | (F.col("fuente").isin(PORTAL, GAZETTE, OCDS)), source_specifics())
    return table.withColumns(
        {
            "entidad_federativa": from_originals("entidad_federativa", "entidad_federativa_contratacion"),
            "municipio": from_originals("municipio", "municipio"),
            "datos_especificos": F.coalesce("datos_especificos", built, originals),
        }
    )


def cornerstone_gazette(recs: DataFrame, model: str | None = None) -> DataFrame:
    """Records of the alternative gazette extractor (variant `rec`) -> canonical fields."""
    rec = F.col("rec")
    return recs.withColumns(
        {
            "numero_procedimiento": first_filled(field(rec, "numero_identificacion"), field(rec, "numero_procedimiento_contratacion")),
            "titulo": F.coalesce(first_filled(field(rec, "titulo_basico")), F.lit(NO_TITLE)),
            "descripcion": field(rec, "descripcion_detallada"),
            "entidad_compradora": field(rec, "dependencia_entidad"),
            "unidad_compradora": field(rec, "unidad_compradora"),
            "tipo_procedimiento": field(rec, "tipo_procedimiento_contratacion"),
            "estado": F.lit("Publicada"),
            "fecha_publicacion": F.to_date(F.try_to_timestamp(field(rec, "fecha_publicacion"))),
            "fecha_apertura": F.to_date(F.try_to_timestamp(field(rec, "fecha_apertura_proposiciones"))),
            "fecha_junta_aclaraciones": F.to_date(F.try_to_timestamp(field(rec, "fecha_junta_aclaraciones"))),
            "uuid_procedimiento": field(rec, "uuid"),
            "fuente": F.lit(GAZETTE),
            "url_original": field(rec, "url_detalle"),
            "datos_originales": field(rec, "datos_originales"),
            "entidad_federativa": field(rec, "entidad_federativa_contratacion"),
            "datos_especificos": F.to_json(
                F.struct(
                    F.coalesce(F.try_variant_get(rec, "$.procesado_haiku", "boolean"), F.lit(True)).alias("procesado_haiku"),
                    F.lit(model).cast("string").alias("modelo_ia"),
                    F.lit(True).alias("cornerstone_dof"),
                )
            ),
        }
    )


def cornerstone_portal(recs: DataFrame) -> DataFrame:
    """Records of the alternative portal extractor (variant `rec`) -> canonical fields."""
    rec = F.col("rec")
    return recs.withColumns(
        {
            "numero_procedimiento": field(rec, "numero_identificacion"),
            "titulo": F.coalesce(first_filled(field(rec, "titulo_basico")), F.lit(NO_TITLE)),
            "descripcion": field(rec, "descripcion_detallada"),
            "entidad_compradora": first_filled(field(rec, "dependencia"), field(rec, "dependencia_entidad")),
            "unidad_compradora": field(rec, "unidad_compradora"),
            "tipo_procedimiento": field(rec, "tipo_procedimiento_contratacion"),
            "caracter": field(rec, "caracter"),
            "estado": F.coalesce(field(rec, "estatus"), F.lit("Publicada")),
            "fecha_publicacion": F.to_date(F.try_to_timestamp(field(rec, "fecha_publicacion"))),
            "fecha_apertura": F.to_date(F.try_to_timestamp(field(rec, "fecha_apertura_proposiciones"))),
            "fecha_junta_aclaraciones": F.to_date(F.try_to_timestamp(field(rec, "fecha_junta_aclaraciones"))),
            "uuid_procedimiento": field(rec, "uuid"),
            "fuente": F.lit(PORTAL),
            "url_original": field(rec, "url_detalle"),
            "entidad_federativa": field(rec, "entidad_federativa_contratacion"),
            "datos_especificos": F.to_json(
                F.struct(
                    F.coalesce(F.try_variant_get(rec, "$.procesado_haiku", "boolean"), F.lit(False)).alias("procesado_haiku"),
                    F.lit(True).alias("cornerstone_comprasmx"),
                )
            ),
        }
    )
