"""Federal portal: JSON envelopes, detail files, enrichment and normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import amounts, classify, dates, urls
from ..functions.jsons import KEEP_NULLS, field, member
from ..functions.text import blank_to_null, first_filled, grab, strip, truncate
from ..schema import PORTAL, conform

# Contract members kept per portal record, after type and character.
CONTRACT_KEYS = [
    "forma_procedimiento", "medio_utilizado", "codigo_contrato", "plantilla_convenio", "fecha_inicio_contrato",
    "fecha_fin_contrato", "convenio_modificatorio", "ramo", "clave_programa", "aportacion_federal",
    "fecha_celebracion", "contrato_marco", "compra_consolidada", "plurianual", "clave_cartera_shcp",
]
# Members of a detail file, with the empty value they default to.
DETAIL_INFO_KEYS = {
    "descripcion_completa": None, "documentos_adjuntos": "[]", "fechas_detalladas": "{}", "ubicacion_especifica": None,
    "contacto": "{}", "montos_detallados": "{}", "requisitos": "[]", "cronograma": "[]",
    "email_unidad_compradora": None, "responsable_captura": None, "descripcion_detallada": None,
    "año_ejercicio": None, "fechas_cronograma": "{}", "partidas_especificas": "[]", "requisitos_economicos": "[]",
    "documentos_anexos": "[]",
}

_ENVELOPE = (
    "data array<string>, registros array<string>, licitaciones array<string>, expedientes array<string>, "
    "total_expedientes string, total_expedientes_capturados string"
)


def records(docs: DataFrame) -> DataFrame:
    """docs(file_name, modified, text) -> one row per record: file_name, pos, rec (variant).

    The envelope is read as arrays of JSON text, so a document may be far larger than one variant value.
    """
    env = F.from_json("text", _ENVELOPE)
    parsed = docs.select("file_name", env.alias("e"), F.from_json("text", "array<string>").alias("items"), "text")
    inner = F.from_json(F.get("e.data", F.lit(0)), "registros array<string>")["registros"]
    is_list = F.ltrim("text").startswith("[")
    summary = F.col("file_name").startswith("resumen_") & F.col("e.total_expedientes_capturados").isNotNull()
    bundle = (
        F.col("file_name").startswith("todos_expedientes_")
        & F.col("e.expedientes").isNotNull()
        & F.col("e.total_expedientes").isNotNull()
    )
    chosen = (
        F.when(summary, None)
        .when(bundle, F.col("e.expedientes"))
        .when(is_list, F.col("items"))
        .otherwise(
            F.coalesce(inner, F.col("e.data"), F.col("e.registros"), F.col("e.licitaciones"), F.col("e.expedientes"))
        )
    )
    return parsed.select("file_name", F.posexplode(chosen).alias("pos", "json")).select(
        "file_name", "pos", F.try_parse_json("json").alias("rec")
    )


def details(docs: DataFrame) -> DataFrame:
    """Detail files by case code; of several the newest file wins."""
    code = blank_to_null(F.get_json_object("text", "$.codigo_expediente"))
    return (
        docs.filter(F.col("file_name").startswith("detalle_"))
        .select(code.alias("codigo"), "modified", "file_name", "text")
        .filter("codigo is not null")
        .groupBy("codigo")
        .agg(F.max_by("text", F.struct("modified", "file_name")).alias("text"))
        .select("codigo", F.try_parse_json("text").alias("detalle"))
    )


def with_details(recs: DataFrame, detail: DataFrame) -> DataFrame:
    """Left look-up by case code, then by procedure number. The join strategy is left to the size seen at run time."""
    code = blank_to_null(field(F.col("rec"), "cod_expediente"))
    number = blank_to_null(field(F.col("rec"), "numero_procedimiento"))
    tried = F.array(F.struct(F.lit(0).alias("nth"), code.alias("codigo")), F.struct(F.lit(1).alias("nth"), number.alias("codigo")))
    # which detail belongs to which record is settled on narrow rows; the record itself is shuffled once
    wanted = recs.select("file_name", "pos", F.inline(tried)).filter("codigo is not null")
    settled = wanted.join(detail.select("codigo"), "codigo", "left_semi").groupBy("file_name", "pos").agg(F.min_by("codigo", "nth").alias("codigo"))
    found = settled.join(detail, "codigo").select(F.col("file_name").alias("_f"), F.col("pos").alias("_p"), "detalle")
    return recs.join(found, F.col("file_name").eqNullSafe(F.col("_f")) & (F.col("pos") == F.col("_p")), "left").drop("_f", "_p")


def longer_text(current: Column, candidate: Column) -> Column:
    """The candidate only if it is longer."""
    return F.when(F.length(candidate) > F.length(F.coalesce(current, F.lit(""))), candidate).otherwise(current)


def specifics(rec: Column, procedure: Column, character: Column, detail: Column | None = None) -> Column:
    """Source-specific JSON: the contract members and, where a detail exists, the member `detalle_individual`."""
    base = [
        F.coalesce(field(rec, "tipo_procedimiento"), procedure).alias("tipo_procedimiento"),
        F.coalesce(field(rec, "caracter"), character).alias("caracter"),
        *[field(rec, k).alias(k) for k in CONTRACT_KEYS],
    ]
    plain = F.to_json(F.struct(*base), KEEP_NULLS)
    if detail is None:
        return plain
    info = member(detail, "informacion_extraida")

    def part(key: str, empty: str | None) -> Column:
        value = member(info, key)
        return (value if empty is None else F.coalesce(value, F.parse_json(F.lit(empty)))).alias(key)

    inner = F.struct(
        field(detail, "url_completa_con_hash").alias("url_completa_hash"),
        field(detail, "timestamp_procesamiento").alias("timestamp_procesamiento"),
        member(detail, "pagina_origen").alias("pagina_origen"),
        F.coalesce(F.try_variant_get(detail, "$.procesado_exitosamente", "boolean"), F.lit(False)).alias(
            "procesado_exitosamente"
        ),
        *[part(k, empty) for k, empty in DETAIL_INFO_KEYS.items()],
        F.coalesce(member(info, "datos_especificos"), F.parse_json(F.lit("{}"))).alias("datos_especificos_detalle"),
    )
    rich = F.to_json(F.struct(*base, inner.alias("detalle_individual")), KEEP_NULLS)
    return F.when(detail.isNotNull(), rich).otherwise(plain)


def normalise(recs: DataFrame) -> DataFrame:
    """Records (with an optional `detalle` variant) -> canonical rows plus file_name and pos."""
    rec = F.col("rec")
    df = recs if "detalle" in recs.columns else recs.withColumn("detalle", F.lit(None).cast("variant"))
    detail = F.col("detalle")
    full_text = field(detail, "informacion_extraida.descripcion_completa")

    def is_number(v: Column) -> Column:
        return F.schema_of_variant(v).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")

    def filled(key: str) -> Column:
        """Null for a missing member, empty text and the number zero; the text '0' counts as filled."""
        zero = is_number(member(rec, key)) & (field(rec, key).try_cast("double") == 0)
        return F.when((field(rec, key) != "") & ~F.coalesce(zero, F.lit(False)), member(rec, key))

    raw_amount = F.coalesce(filled("monto_estimado"), filled("presupuesto_estimado"))
    amount_is_number = is_number(raw_amount)
    uuid = field(rec, "uuid_procedimiento")
    description = first_filled(
        field(rec, "descripcion_detallada_procedimiento"), field(rec, "descripcion_detallada"), field(rec, "descripcion")
    )
    out = df.withColumns(
        {
            "numero_procedimiento": first_filled(field(rec, "numero_procedimiento"), field(rec, "cod_expediente")),
            "titulo": truncate(F.coalesce(first_filled(field(rec, "nombre_procedimiento"), field(rec, "titulo")), F.lit("")), 500),
            "descripcion": longer_text(F.coalesce(description, F.lit("")), full_text),
            "entidad_compradora": F.coalesce(first_filled(field(rec, "siglas"), field(rec, "entidad_compradora")), F.lit("")),
            "unidad_compradora": field(rec, "unidad_compradora"),
            "tipo_procedimiento": classify.portal_procedure(field(rec, "tipo_procedimiento")),
            "tipo_contratacion": classify.portal_contract(field(rec, "tipo_contratacion")),
            "estado": classify.portal_status(first_filled(field(rec, "estatus_alterno"), field(rec, "estado"))),
            "fecha_publicacion": dates.portal_date(field(rec, "fecha_publicacion")),
            "fecha_apertura": dates.portal_date(field(rec, "fecha_apertura")),
            "fecha_fallo": dates.portal_date(field(rec, "fecha_fallo")),
            "fecha_junta_aclaraciones": dates.portal_date(field(rec, "fecha_aclaraciones")),
            "monto_estimado": amounts.portal_amount(F.try_variant_get(raw_amount, "$", "string"), amount_is_number),
            "moneda": F.lit("MXN"),
            "caracter": field(rec, "caracter"),
            "uuid_procedimiento": uuid,
            "fuente": F.lit(PORTAL),
            "url_original": urls.portal_url(field(detail, "url_completa_con_hash"), field(rec, "url_original"), uuid),
            "datos_originales": F.to_json("rec"),
        }
    ).filter("numero_procedimiento is not null")
    return conform(
        out.withColumn(
            "datos_especificos",
            F.when(detail.isNotNull(), specifics(rec, F.col("tipo_procedimiento"), F.col("caracter"), detail)),
        ),
        keep=("file_name", "pos"),
    )


def merge_capture(captured: DataFrame, detail: DataFrame) -> DataFrame:
    """Captured cases with real hash, link and full text of their detail, joined on the case code."""
    d = F.col("detalle")
    known = detail.select(
        F.col("codigo").alias("cod_expediente"),
        field(d, "hash_uuid_real").alias("hash_uuid_real"),
        field(d, "url_completa_con_hash").alias("url_completa_con_hash"),
        field(d, "descripcion_completa").alias("descripcion_completa"),
    )
    return captured.join(known, "cod_expediente", "left")


# Labels of the pasted portal page and the member each one fills.
PASTED_LABELS = {
    "codigo_expediente": r"Código del expediente:\s*([A-Z0-9\-]+)",
    "numero_procedimiento": r"Número de procedimiento de contratación:\s*([A-Z0-9\-]+)",
    "estatus": r"(?U)Estatus del procedimiento de contratación:\s*(\w+)",
    "nombre_procedimiento": r"Nombre del procedimiento de contratación:\s*([^\n]+)",
    "descripcion_completa": r"Descripción detallada del procedimiento de contratación:\s*([^\n]+)",
    "dependencia_entidad": r"Dependencia o Entidad:\s*([^\n]+)",
    "ramo": r"Ramo:\s*([^\n]+)",
    "unidad_compradora": r"Unidad compradora:\s*([^\n]+)",
    "responsable_captura": r"Responsable de la captura:\s*([^\n]+)",
    "correo_electronico": r"Correo electrónico unidad compradora:\s*([^\s\n]+)",
    "tipo_procedimiento": r"Tipo de procedimiento de contratación:\s*([^\n]+)",
    "tipo_contratacion": r"Tipo de contratación:\s*([^\n]+)",
    "entidad_federativa": r"Entidad Federativa donde se llevará a cabo la contratación:\s*([^\n]+)",
    "fecha_apertura": r"Fecha y hora de presentación y apertura de proposiciones:\s*([^\n]+)",
    "fecha_aclaraciones": r"Fecha y hora de junta de aclaraciones:\s*([^\n]+)",
    "fecha_fallo": r"Fecha y hora del acto del Fallo:\s*([^\n]+)",
    "caracter": r"Carácter:\s*([^\n]+)",
    "referencia_control": r"Referencia / Número de control interno:\s*([^\n]+)",
}


def parse_pasted(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds one column per label of a pasted portal page."""
    return df.withColumns({name: strip(grab(F.col(text), p)) for name, p in PASTED_LABELS.items()})


def pasted_detail(df: DataFrame) -> DataFrame:
    """Parsed page columns -> detail JSON of the same shape as a detail file."""
    info = F.struct(
        *[F.col(k) for k in PASTED_LABELS if k not in ("codigo_expediente", "fecha_apertura", "fecha_aclaraciones", "fecha_fallo")],
        F.struct(
            F.col("fecha_apertura").alias("apertura_proposiciones"),
            F.col("fecha_aclaraciones").alias("junta_aclaraciones"),
            F.col("fecha_fallo").alias("acto_fallo"),
        ).alias("fechas_detalladas"),
        F.struct(
            F.array_compact(F.array("correo_electronico")).alias("emails"),
            F.col("responsable_captura").alias("responsable"),
        ).alias("contacto"),
    )
    detail = F.struct("codigo_expediente", F.lit(True).alias("procesado_exitosamente"), info.alias("informacion_extraida"))
    return df.withColumn("detalle", F.to_json(detail, KEEP_NULLS))
