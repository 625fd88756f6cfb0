"""The tender table: column names, types and source names."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

# Source names as stored in `fuente`.
PORTAL = "ComprasMX"
GAZETTE = "DOF"
OCDS = "Tianguis Digital"
OCDS_ZIP = "TIANGUIS_ZIP"
SITES = "SITIOS_MASIVOS"
SOURCES = [PORTAL, GAZETTE, OCDS, OCDS_ZIP, SITES]

AMOUNT = T.DecimalType(15, 2)

TENDER = T.StructType(
    [
        T.StructField("numero_procedimiento", T.StringType()),
        T.StructField("titulo", T.StringType()),
        T.StructField("descripcion", T.StringType()),
        T.StructField("entidad_compradora", T.StringType()),
        T.StructField("unidad_compradora", T.StringType()),
        T.StructField("tipo_procedimiento", T.StringType()),
        T.StructField("tipo_contratacion", T.StringType()),
        T.StructField("estado", T.StringType()),
        T.StructField("fecha_publicacion", T.DateType()),
        T.StructField("fecha_apertura", T.DateType()),
        T.StructField("fecha_fallo", T.DateType()),
        T.StructField("fecha_junta_aclaraciones", T.DateType()),
        T.StructField("monto_estimado", AMOUNT),
        T.StructField("moneda", T.StringType()),
        T.StructField("proveedor_ganador", T.StringType()),
        T.StructField("caracter", T.StringType()),
        T.StructField("uuid_procedimiento", T.StringType()),
        T.StructField("fuente", T.StringType()),
        T.StructField("url_original", T.StringType()),
        T.StructField("fecha_captura", T.TimestampType()),
        T.StructField("hash_contenido", T.StringType()),
        T.StructField("datos_originales", T.StringType()),
        T.StructField("entidad_federativa", T.StringType()),
        T.StructField("municipio", T.StringType()),
        T.StructField("datos_especificos", T.StringType()),
    ]
)

COLUMNS = TENDER.fieldNames()

# The columns of the dashboard list and of the quick search.
LIST_COLUMNS = [
    "id", "numero_procedimiento", "titulo", "descripcion", "entidad_compradora", "unidad_compradora",
    "tipo_procedimiento", "tipo_contratacion", "estado", "entidad_federativa", "municipio",
    "fecha_publicacion", "fecha_apertura", "fecha_fallo", "monto_estimado", "moneda", "fuente",
    "url_original", "datos_originales", "datos_especificos",
]
QUICK_COLUMNS = [
    "id", "numero_procedimiento", "titulo", "entidad_compradora", "entidad_federativa", "municipio",
    "fecha_publicacion", "monto_estimado", "fuente", "url_original", "datos_originales",
]


def conform(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Canonical columns in canonical order; absent ones become typed nulls, `keep` columns are appended."""
    present = set(df.columns)
    columns = [
        (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name) for f in TENDER
    ]
    return df.select(*columns, *[F.col(name) for name in keep])
