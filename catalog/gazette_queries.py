"""Gazette pages, blocks and notices, and the reports over them.

The check SQL never parses a notice: it states the values the notice text was composed from.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pregonero.operators import filters, gazette
from pregonero.operators import gazette_patterns as P
from pregonero.operators.windows import first_per_key
from pregonero.plans import quality
from pregonero.session import work_dir
from pregonero.sources import sinks
from pregonero.streaming import calendar

from .inputs import AS_OF, table, text_agg, view
from .registry import contract_kind, plain, register


def as_of():
    return F.lit(AS_OF).cast("date")


def pages(spark, sf):
    """Pages of all editions with their edition columns, as the page reader gives them."""
    from pregonero.sources.files import edition_columns

    return view(spark, sf, "gazette_pages").withColumns(edition_columns(F.col("archivo"), as_of()))


def notices(spark, sf):
    return gazette.extract_notices(gazette.split_blocks(pages(spark, sf)))


def blocks(spark, sf):
    """One notice text per order, with the keys a block carries."""
    return view(spark, sf, "blocks").select(
        "archivo", F.col("pagina_aprox").alias("pagina"), F.col("k").alias("bloque"), "texto", F.lit(None).cast("string").alias("referencia"),
        F.lit("1998-01-01").alias("fecha_ejemplar"), F.lit("MAT").alias("edicion_ejemplar"),
    )


def written_pages(spark, sf):
    """The pages written as marked text, one folder per edition, and read back page by page."""
    path = work_dir(spark, "gazette")
    sinks.write_marked_text(view(spark, sf, "gazette_pages"), path)
    return gazette.read_pages(spark, path, as_of())


register(
    "s7_s20_g1_marked_text_pages",
    lambda spark, sf: written_pages(spark, sf).select("archivo", "pagina", F.md5("contenido").alias("h"), "fecha_ejemplar", "edicion_ejemplar"),
    """SELECT archivo, pagina, md5(contenido) AS h, substr(archivo, 5, 4) || '-' || substr(archivo, 3, 2) || '-' || substr(archivo, 1, 2) AS fecha_ejemplar,
    substr(archivo, 10) AS edicion_ejemplar FROM gazette_pages""",
    "gazette_pages",
)
register(
    "s20_marked_pages",
    lambda spark, sf: sinks.marked_pages(view(spark, sf, "gazette_pages")).select("archivo", "pagina", F.md5("value").alias("h")),
    "SELECT archivo, pagina, md5(chr(10) || chr(10) || '===== [PÁGINA ' || CAST(pagina AS VARCHAR) || '] =====' || chr(10) || contenido) AS h FROM gazette_pages",
    "gazette_pages",
)


def texts_with_marks(spark, sf):
    """Texts in a column: two marked pages per order, or an unmarked text."""
    b = view(spark, sf, "blocks")
    text = F.when(F.col("k") % 4 == 0, F.col("texto")).otherwise(
        F.concat(F.lit("previo ===== [PÁGINA 7] =====\n"), "texto", F.lit("\n===== [PÁGINA 12] ===== fin "), "seg")
    )
    return gazette.split_pages(b.select("k", text.alias("texto"))).select("k", "pagina", F.md5("contenido").alias("h"))


register(
    "g1_w3_page_split",
    texts_with_marks,
    """SELECT k, 1 AS pagina, md5(texto) AS h FROM blocks WHERE k % 4 = 0 UNION ALL SELECT k, 7, md5(texto) FROM blocks WHERE k % 4 <> 0
    UNION ALL SELECT k, 12, md5('fin ' || seg) FROM blocks WHERE k % 4 <> 0""",
    "blocks",
)
RANGES = """SELECT archivo, CASE WHEN substr(archivo, 4, 1) IN ('3','6','9') THEN COALESCE(MIN(CASE WHEN pagina = 10 THEN 10 END), 1) ELSE 10 END AS inicio,
    CASE WHEN substr(archivo, 4, 1) IN ('2','5','8') THEN MAX(pagina) WHEN substr(archivo, 4, 1) IN ('3','6','9') THEN
      CASE WHEN MIN(CASE WHEN pagina = 10 THEN 10 END) IS NULL THEN MAX(pagina) ELSE MAX(pagina) - 1 END ELSE MAX(pagina) - 1 END AS fin
    FROM gazette_pages GROUP BY archivo"""
register("g2_call_range", lambda spark, sf: gazette.call_range(pages(spark, sf)), RANGES, "gazette_pages")
register("g2_call_range_loose_heads", lambda spark, sf: gazette.call_range(pages(spark, sf), loose=True), RANGES, "gazette_pages")
register(
    "g2_call_pages",
    lambda spark, sf: (lambda p: gazette.call_pages(p, gazette.call_range(p)).select("archivo", "pagina"))(pages(spark, sf)),
    f"SELECT archivo, pagina FROM gazette_pages JOIN ({RANGES}) r USING (archivo) WHERE pagina BETWEEN inicio AND fin",
    "gazette_pages",
)
BODY = "substr(texto, 1, length(texto) - 13)"
register(
    "g3_block_split",
    lambda spark, sf: gazette.split_blocks(pages(spark, sf)).select("referencia", F.length(F.btrim("texto", F.lit(" \n"))).alias("n")).filter("referencia is not null"),
    f"""SELECT referencia, length(trim({BODY}, ' ' || chr(10))) + CASE WHEN k = primero AND pagina_aprox = 10 AND substr(archivo, 4, 1) IN ('3','6','9')
      THEN length('CONVOCATORIAS PARA CONCURSOS DE OBRA') + 1 ELSE 0 END AS n
    FROM (SELECT *, MIN(k) OVER (PARTITION BY archivo, pagina_aprox) AS primero FROM blocks) x""",
    "blocks",
)


def summary_pages(spark, sf):
    """Pages without references, whose notices begin with a summary head, or with an agency head."""
    b = view(spark, sf, "blocks").select(
        "archivo", F.col("k").alias("pagina"), F.regexp_replace("texto", P.REFERENCE_END, "").alias("t"), F.col("k"), "seg"
    )
    heads = F.concat(
        F.lit("\nRESUMEN DE CONVOCATORIA\n"), "t", F.lit("\nRESUMEN DE LA CONVOCATORIA\n"), "t", F.lit("\nRESUMEN DE CONVOCATORIA\n"), "t"
    )
    agencies = F.concat(F.lit("SECRETARÍA DE SALUD\n"), "t", F.lit("\nSECRETARIA DE OBRAS\n"), "t")
    return b.select("archivo", "pagina", F.when(F.col("k") % 2 == 0, heads).otherwise(agencies).alias("contenido"))


register(
    "g3_block_split_v2",
    lambda spark, sf: gazette.split_blocks_v2(summary_pages(spark, sf)).groupBy("pagina").agg(F.count(F.lit(1)).alias("bloques")),
    """SELECT k AS pagina, CASE WHEN k % 2 = 0 THEN 3 ELSE 2 + CASE WHEN dependencia LIKE 'SECRETAR%' THEN 2 ELSE 0 END
      - CASE WHEN dependencia LIKE 'SECRETAR%' THEN 2 ELSE 0 END END AS bloques FROM blocks""",
    "blocks",
)
register(
    "g4_unique_blocks_of_documents",
    lambda spark, sf: gazette.unique_blocks(
        table(spark, sf, "documents").select(F.col("source").alias("archivo"), F.col("doc_id").alias("pagina"), F.lit(0).alias("bloque"), F.col("text").alias("texto")),
        opening=100,
    ).select("archivo", F.col("pagina").alias("doc_id")),
    "SELECT source AS archivo, MIN(doc_id) AS doc_id FROM documents GROUP BY source, substr(text, 1, 100)",
)
register(
    "f21_minimum_content",
    lambda spark, sf: filters.long_enough(table(spark, sf, "documents"), "text", 500, strict=True).select("doc_id"),
    r"SELECT doc_id FROM documents WHERE length(regexp_replace(text, '^\s+|\s+$', '', 'g')) > 500",
)

# --- fields of a notice -------------------------------------------------------------------------------------------

KEY = "referencia"


def fields(*columns):
    return lambda spark, sf: plain(notices(spark, sf).select(*[c if isinstance(c, str) else c for c in (KEY, *columns)]))


REF = "'(R.- ' || referencia || ')' AS referencia"
# A notice is kept if it has a number, or an agency (every notice has a title).
KEPT = "(numero IS NOT NULL OR dependencia IS NOT NULL)"
HOUR = "' 00:00:00'"


def notice_field(name, columns, exprs, more=""):
    register(name, fields(*columns), f"SELECT {REF}, {exprs} FROM blocks WHERE {KEPT}{more}", "blocks")


notice_field("g5_number", ["numero_licitacion"], "numero AS numero_licitacion")
# A page with the section head starts its first block with that head, which moves the agency one line down.
notice_field(
    "g6_agency",
    ["dependencia", "subdependencia"],
    """COALESCE(dependencia, CASE WHEN segunda = 'INSTITUTO DE VIVIENDA' THEN segunda END) AS dependencia,
    CASE WHEN dependencia IS NOT NULL AND k % 3 = 0 THEN segunda END AS subdependencia""",
)
VOLUME = "cantidad || ' piezas para ' || lower(seg)"
NO_BLANK_TAIL = "CASE WHEN k % 4 = 3 THEN NULL ELSE " + VOLUME + " END"
notice_field(
    "g7_title_and_description",
    ["titulo", "descripcion"],
    f"""objeto AS titulo, CASE WHEN k % 3 = 0 THEN 'Los detalles se determinan en la convocatoria'
    WHEN k % 4 = 3 THEN NULL ELSE trim(regexp_extract(texto, 'Volumen a adquirir: ([^.]+)', 1), ' ' || chr(10)) END AS descripcion""",
)
DATE = "strftime({0}, '%Y-%m-%d') || ' {1}:00'"
notice_field(
    "g9_event_dates",
    list(P.EVENTS),
    f"""{DATE.format('d', '00:00')} AS fecha_publicacion,
    CASE WHEN k % 3 = 0 THEN {DATE.format('d_junta', '10:30')} ELSE {DATE.format('d_junta', '00:00')} END AS fecha_junta_aclaraciones,
    CASE WHEN k % 4 <> 0 THEN {DATE.format('d_junta', '09:00')} END AS fecha_visita_instalaciones,
    CASE WHEN k % 6 <> 5 THEN {DATE.format('d_apertura', '00:00')} END AS fecha_presentacion_apertura,
    CASE WHEN k % 7 <> 0 THEN {DATE.format('d_fallo', '00:00')} END AS fecha_fallo""",
)
notice_field(
    "g10_location",
    ["entidad_federativa", "municipio", "localidad", "direccion_completa"],
    """estado_nombre AS entidad_federativa, municipio_nombre AS municipio, CAST(NULL AS VARCHAR) AS localidad,
    CASE WHEN k % 5 = 2 THEN 'Avenida Central ' || cantidad || ', Colonia Centro' END AS direccion_completa""",
)
notice_field(
    "g11_technical",
    gazette.TECHNICAL,
    f"""{NO_BLANK_TAIL} AS volumen_obra, CASE WHEN k % 4 <> 3 THEN cantidad END AS cantidad, CASE WHEN k % 4 <> 3 THEN 'piezas' END AS unidad_medida,
    CASE WHEN k % 3 = 0 THEN 'Los detalles se determinan en la convocatoria' END AS especificaciones_tecnicas, CAST(NULL AS VARCHAR) AS lugar_eventos""",
)
notice_field(
    "g12_reduction",
    ["reduccion_plazos", "autoridad_reduccion"],
    "k % 9 = 0 AS reduccion_plazos, CASE WHEN k % 9 = 0 THEN 'Titular de ' || seg END AS autoridad_reduccion",
)
notice_field(
    "g11_type_and_character",
    ["tipo_procedimiento", "caracter_procedimiento"],
    """CASE WHEN numero IS NULL THEN 'Licitación Pública' ELSE 'Licitación Pública' END AS tipo_procedimiento,
    CASE WHEN k % 8 = 0 OR k % 5 = 1 THEN 'Nacional' ELSE 'Internacional' END AS caracter_procedimiento""",
)
AGENCY_FOUND = "(dependencia IS NOT NULL OR segunda = 'INSTITUTO DE VIVIENDA')"
OTHERS = """(2 + CAST(k % 4 <> 0 AS INT) + CAST(k % 6 <> 5 AS INT) + CAST(k % 7 <> 0 AS INT) + 3 * CAST(k % 4 <> 3 AS INT) + CAST(k % 3 = 0 AS INT))"""
CONFIDENCE = f"""CAST(least(100, 20 * (CAST(numero IS NOT NULL AS INT) + CAST({AGENCY_FOUND} AS INT) + 1) + 4 * least(10, {OTHERS})) AS DOUBLE) / 100"""
EXTRACTED = f"""(CAST(numero IS NOT NULL AS INT) + CAST({AGENCY_FOUND} AS INT) + CAST(dependencia IS NOT NULL AND k % 3 = 0 AS INT) + 1
    + CAST(k % 3 = 0 OR k % 4 <> 3 AS INT) + 1 + CAST(numero IS NOT NULL AS INT) + CAST(numero IS NOT NULL AS INT) + 2 + CAST(k % 5 = 2 AS INT)
    + {OTHERS} + 1 + 2 * CAST(k % 9 = 0 AS INT))"""
notice_field(
    "g13_confidence", ["confianza_extraccion", "campos_extraidos"], f"{CONFIDENCE} AS confianza_extraccion, {EXTRACTED} AS campos_extraidos"
)
GATE = f"(numero IS NOT NULL OR {AGENCY_FOUND})"
register(
    "g14_notice_gate",
    lambda spark, sf: notices(spark, sf).groupBy("archivo").agg(F.count(F.lit(1)).alias("n")),
    f"SELECT archivo, COUNT(*) AS n FROM blocks WHERE {GATE} GROUP BY 1",
    "blocks",
)
register(
    "g15_canonical_rows",
    lambda spark, sf: gazette.to_canonical(notices(spark, sf)).select(
        F.get_json_object("datos_originales", "$.referencia").alias("referencia"), "numero_procedimiento", "titulo", "entidad_compradora",
        "estado", "fuente", "fecha_publicacion", "fecha_apertura", "fecha_fallo", "entidad_federativa",
        F.get_json_object("datos_especificos", "$.campos_extraidos").cast("long").alias("campos"),
    ),
    f"""SELECT {REF}, COALESCE(numero, '') AS numero_procedimiento, objeto AS titulo,
    COALESCE(dependencia, CASE WHEN segunda = 'INSTITUTO DE VIVIENDA' THEN segunda END, 'No especificada') AS entidad_compradora,
    'Publicada' AS estado, 'DOF' AS fuente, d AS fecha_publicacion, CASE WHEN k % 6 <> 5 THEN d_apertura END AS fecha_apertura,
    CASE WHEN k % 7 <> 0 THEN d_fallo END AS fecha_fallo, estado_nombre AS entidad_federativa, {EXTRACTED} AS campos FROM blocks WHERE {GATE}""",
    "blocks",
)

# --- second structurer --------------------------------------------------------------------------------------------


def notices_v2(spark, sf):
    return gazette.extract_notices_v2(gazette.unique_blocks(blocks(spark, sf)))


def fields_v2(spark, sf):
    n = notices_v2(spark, sf)
    return n.select(
        F.col("bloque").alias("k"), "numero_licitacion", "titulo", "dependencia", F.col("fecha_publicacion.fecha").alias("publicacion"),
        F.col("fecha_junta_aclaraciones.fecha").alias("junta"), F.col("fecha_presentacion_apertura.fecha").alias("apertura"), "volumen_adquirir",
        "tipo_procedimiento", "referencia", "autoridad_firmante", "reduccion_plazos", "autoridad_reduccion",
        "confianza_extraccion", F.array_join("campos_faltantes", ",").alias("faltan"),
    )


NUMBER_2 = """CASE WHEN k % 8 = 0 THEN NULL WHEN k % 5 = 1 THEN NULL ELSE numero END"""
AGENCY_SQL_2 = """COALESCE(CASE WHEN k % 6 IN (0, 1, 2, 3, 4) THEN dependencia END, CASE WHEN segunda = 'INSTITUTO DE VIVIENDA' THEN segunda END)"""
register(
    "g7_g12_g13_second_structurer",
    fields_v2,
    f"""SELECT k, numero_licitacion, objeto || CASE WHEN k % 3 = 0 THEN ' Los detalles se determinan en la convocatoria' ELSE '' END AS titulo, dep AS dependencia, strftime(d, '%Y-%m-%d') AS publicacion, strftime(d_junta, '%Y-%m-%d') AS junta,
    CASE WHEN k % 6 <> 5 THEN strftime(d_apertura, '%Y-%m-%d') END AS apertura, {NO_BLANK_TAIL} AS volumen_adquirir, 'LICITACION_PUBLICA' AS tipo_procedimiento,
    referencia, 'EL DIRECTOR DE ' || seg AS autoridad_firmante, k % 9 = 0 AS reduccion_plazos, CASE WHEN k % 9 = 0 THEN 'Titular de ' || seg END AS autoridad_reduccion,
    CAST(5 - m AS DOUBLE) / 5 AS confianza_extraccion,
    concat_ws(',', CASE WHEN numero_licitacion IS NULL THEN 'numero_licitacion' END, CASE WHEN dep IS NULL THEN 'dependencia' END,
      CASE WHEN k % 6 = 5 THEN 'fecha_presentacion_apertura' END) AS faltan
    FROM (SELECT *, CAST(numero_licitacion IS NULL AS INT) + CAST(dep IS NULL AS INT) + CAST(k % 6 = 5 AS INT) AS m FROM (
      SELECT *, {NUMBER_2} AS numero_licitacion, {AGENCY_SQL_2} AS dep FROM blocks) x) y
    WHERE k IN (SELECT MIN(k) FROM blocks GROUP BY archivo, texto)""",
    "blocks",
)

# --- older notices, stored rows -----------------------------------------------------------------------------------


def old_texts(spark, sf):
    n = view(spark, sf, "notices")
    text = F.concat(
        F.lit("Prólogo\nLICITACIÓN PÚBLICA de "), "objeto", F.lit("\nSECRETARÍA DE "), "seg", F.lit(" invita\nLicitación PÚBLICA número "), F.col("k").cast("string"),
        F.when(F.col("k") % 2 == 0, F.concat(F.lit("\nINVITACIÓN a proveedores de "), "seg")).otherwise(""),
    )
    return n.select("k", text.alias("texto"))


register(
    "g18_older_notices",
    lambda spark, sf: gazette.old_notices(old_texts(spark, sf)).select("k", "tipo_procedimiento", "titulo", "entidad_compradora", F.length("texto_completo").alias("n")),
    """WITH t AS (SELECT k, seg, 'LICITACIÓN PÚBLICA de ' || objeto AS a, 'LICITACIÓN PÚBLICA de ' || objeto || chr(10) || 'SECRETARÍA DE ' || seg || ' invita' || chr(10) AS uno,
      'Licitación PÚBLICA número ' || CAST(k AS VARCHAR) || CASE WHEN k % 2 = 0 THEN chr(10) || 'INVITACIÓN a proveedores de ' || seg ELSE '' END AS dos,
      'INVITACIÓN a proveedores de ' || seg AS tres FROM notices)
    SELECT k, 'Licitación Pública' AS tipo_procedimiento, a AS titulo, 'SECRETARÍA DE ' || seg AS entidad_compradora, length(uno) AS n FROM t
    UNION ALL SELECT k, 'Licitación Pública', 'Licitación PÚBLICA número ' || CAST(k AS VARCHAR), 'Entidad DOF', length(dos) FROM t
    UNION ALL SELECT k, 'Invitación', CASE WHEN length(tres) > 20 THEN tres ELSE 'Licitación DOF' END, 'Entidad DOF', length(tres) FROM t WHERE k % 2 = 0""",
    "notices",
)


def stored_parts(spark, sf):
    d = gazette.parse_stored(view(spark, sf, "stored"))
    return d


EVENT = "strftime({0}, '%Y-%m-%d') || ' {1}:00'"
register(
    "g8_title_split",
    lambda spark, sf: view(spark, sf, "stored").select(
        "id", gazette.split_title(F.col("titulo"))[0].alias("titulo"), gazette.split_title(F.col("titulo"))[1].alias("resto"),
        gazette.clean_title(F.concat(F.lit('"'), "objeto", F.lit(' Los detalles en otra parte"'))).alias("limpio"),
    ),
    """SELECT id, CASE WHEN id % 3 = 2 THEN titulo ELSE objeto END AS titulo,
    CASE WHEN id % 3 = 2 THEN '' ELSE trim(substr(titulo, length(objeto) + 2)) END AS resto, objeto AS limpio FROM stored""",
    "stored",
)
register(
    "g16_composite_parse",
    lambda spark, sf: stored_parts(spark, sf).select(
        "id", "titulo_limpio", F.col("fechas_parseadas.junta_aclaraciones").alias("junta"), F.col("fechas_parseadas.fallo").alias("fallo"),
        F.col("fechas_parseadas.visita_sitio").alias("visita"), F.col("fechas_parseadas.fecha_publicacion_compranet").alias("publicacion"),
        F.col("info_tecnica.cantidad").alias("cantidad"), F.col("info_tecnica.unidad").alias("unidad"), F.col("info_tecnica.visita_requerida").alias("requerida"),
        F.col("info_tecnica.caracter_procedimiento").alias("caracter"), F.col("info_tecnica.detalles_convocatoria").alias("detalles"),
        "entidad_parseada", "municipio_parseado",
    ),
    f"""SELECT id, CASE WHEN id % 3 = 2 THEN titulo ELSE objeto END AS titulo_limpio, CASE WHEN id % 2 = 0 THEN {EVENT.format('j', '10:30')} END AS junta,
    {EVENT.format('f', '00:00')} AS fallo, CASE WHEN id % 4 = 0 THEN 'No aplica' ELSE {EVENT.format('j', '00:00')} END AS visita,
    CASE WHEN id % 3 = 1 THEN {EVENT.format('d', '00:00')} END AS publicacion, CASE WHEN id % 3 = 0 THEN cantidad END AS cantidad,
    CASE WHEN id % 3 = 0 THEN 'pieza' END AS unidad, id % 4 <> 0 AS requerida, 'Internacional' AS caracter,
    CASE WHEN id % 3 = 0 THEN 'Los detalles se determinan en la convocatoria' END AS detalles, estado_nombre AS entidad_parseada, municipio_nombre AS municipio_parseado
    FROM (SELECT *, CAST(d + 7 AS DATE) AS j, CAST(d + 30 AS DATE) AS f FROM stored) x""",
    "stored",
)

# --- reports ------------------------------------------------------------------------------------------------------

FULL_DATES = "CAST(2 + CAST(k % 6 <> 5 AS INT) + CAST(k % 7 <> 0 AS INT) >= 3 AS INT)"
MEASURES = f"""COUNT(*) AS total, COUNT(numero) AS con_numero_completo, COUNT(*) AS con_ubicacion, CAST(SUM({FULL_DATES}) AS BIGINT) AS con_fechas_completas,
    CAST(round_even(CAST(SUM(CAST(round({CONFIDENCE} * 100) AS BIGINT)) AS DOUBLE) / COUNT(*) / 100, 2) AS DOUBLE) AS confianza_promedio,
    CAST(round_even(CAST(SUM({EXTRACTED}) AS DOUBLE) / COUNT(*), 1) AS DOUBLE) AS campos_promedio,
    MIN({EVENT.format('d', '00:00')}) AS fecha_min, MAX({EVENT.format('d', '00:00')}) AS fecha_max"""
register(
    "a34_extraction_by_file",
    lambda spark, sf: quality.extraction_by_file(notices(spark, sf)),
    f"SELECT archivo, {MEASURES} FROM blocks WHERE {GATE} GROUP BY 1",
    "blocks",
)
register("a35_extraction_overall", lambda spark, sf: quality.extraction_overall(notices(spark, sf)), f"SELECT {MEASURES} FROM blocks WHERE {GATE}", "blocks")
AGENCY_SQL = "COALESCE(dependencia, CASE WHEN segunda = 'INSTITUTO DE VIVIENDA' THEN segunda END)"
CHARACTER_SQL = "CASE WHEN k % 8 = 0 OR k % 5 = 1 THEN 'Nacional' ELSE 'Internacional' END"
FACET_ROWS = f"""SELECT archivo, 'entidad' AS faceta, estado_nombre AS valor FROM blocks WHERE {GATE}
    UNION ALL SELECT archivo, 'caracter', {CHARACTER_SQL} FROM blocks WHERE {GATE}
    UNION ALL SELECT archivo, 'dependencia', {AGENCY_SQL} FROM blocks WHERE {GATE}
    UNION ALL SELECT archivo, 'tipo', {contract_kind('t')} FROM (SELECT *, CASE WHEN pagina_aprox = 10 AND substr(archivo, 4, 1) IN ('3','6','9')
      AND k = MIN(k) OVER (PARTITION BY archivo, pagina_aprox) THEN 'CONVOCATORIAS PARA CONCURSOS DE OBRA' || texto ELSE texto END AS t FROM blocks) b WHERE {GATE}"""
register(
    "a34_extraction_facets_by_file",
    lambda spark, sf: quality.extraction_facets(notices(spark, sf)),
    f"SELECT archivo, faceta, CASE WHEN faceta = 'dependencia' THEN substr(valor, 1, 50) ELSE valor END AS valor, COUNT(*) AS cantidad FROM ({FACET_ROWS}) f WHERE f.valor IS NOT NULL GROUP BY archivo, faceta, f.valor",
    "blocks",
)
register(
    "a35_extraction_facets",
    lambda spark, sf: quality.extraction_facets(notices(spark, sf), per_file=False),
    f"""SELECT faceta, CASE WHEN faceta = 'dependencia' THEN substr(valor, 1, 50) ELSE valor END AS valor, COUNT(*) AS cantidad FROM ({FACET_ROWS} UNION ALL SELECT archivo, 'fecha_ejemplar',
    substr(archivo, 5, 4) || '-' || substr(archivo, 3, 2) || '-' || substr(archivo, 1, 2) FROM blocks WHERE {GATE}) f WHERE f.valor IS NOT NULL GROUP BY faceta, f.valor""",
    "blocks",
)


def status_of_files(spark, sf):
    p = pages(spark, sf)
    extra = p.select("archivo").distinct().select(F.concat("archivo", F.lit("_vacio")).alias("archivo"))
    failed = p.select("archivo").distinct().filter(F.col("archivo").like("%1995%"))
    return quality.file_status(p.select("archivo").distinct().unionByName(extra), notices(spark, sf), failed)


STATUS = f"""SELECT archivo, n AS licitaciones, CASE WHEN archivo LIKE '%1995%' THEN 'ERROR' ELSE 'EXITOSO' END AS status
    FROM (SELECT archivo, COUNT(*) FILTER (WHERE {GATE}) AS n FROM blocks GROUP BY 1) x UNION ALL SELECT DISTINCT archivo || '_vacio', 0, 'SIN_DATOS' FROM blocks"""
register("a36_file_status", status_of_files, STATUS, "blocks")
register(
    "a36_file_status_counts",
    lambda spark, sf: quality.file_status_counts(status_of_files(spark, sf)),
    f"SELECT status, COUNT(*) AS archivos, CAST(SUM(licitaciones) AS BIGINT) AS licitaciones FROM ({STATUS}) s GROUP BY 1",
    "blocks",
)
register(
    "a37_confidence_classes",
    lambda spark, sf: quality.confidence_classes(notices(spark, sf)),
    f"""SELECT COUNT(*) FILTER (WHERE c >= 80) AS alta, COUNT(*) FILTER (WHERE c >= 50 AND c < 80) AS media, COUNT(*) FILTER (WHERE c < 50) AS baja,
    CAST(SUM(c) AS DOUBLE) / (COUNT(*) * 100) AS confianza_promedio FROM (SELECT CAST(round({CONFIDENCE} * 100) AS BIGINT) AS c FROM blocks WHERE {GATE}) x""",
    "blocks",
)
register(
    "a38_agency_counts",
    lambda spark, sf: quality.labelled_counts(notices(spark, sf), "dependencia", quality.NO_AGENCY),
    f"SELECT COALESCE({AGENCY_SQL}, 'SIN DEPENDENCIA') AS dependencia, COUNT(*) AS cantidad FROM blocks WHERE {GATE} GROUP BY 1",
    "blocks",
)
register(
    "a38_character_counts",
    lambda spark, sf: quality.labelled_counts(notices(spark, sf), "caracter_procedimiento", quality.NO_CHARACTER),
    f"SELECT {CHARACTER_SQL} AS caracter_procedimiento, COUNT(*) AS cantidad FROM blocks WHERE {GATE} GROUP BY 1",
    "blocks",
)
register(
    "a42_pages_with_notices",
    lambda spark, sf: quality.pages_with_notices(notices(spark, sf)),
    f"SELECT archivo, COUNT(DISTINCT pagina_aprox) AS paginas FROM blocks WHERE {GATE} GROUP BY 1",
    "blocks",
)


def daily(spark, sf, modulus):
    """Loaded editions by day, without the orders a step failed for."""
    n = view(spark, sf, "notices").filter(F.col("k") % modulus != 0)
    return n.select(F.col("d").alias("fecha"), F.when(F.col("k") % 2 == 0, "MAT").otherwise("VES").alias("edicion"))


def calendar_days(spark, sf):
    bounds = table(spark, sf, "orders").agg(F.to_date(F.min("o_orderdate")).alias("a"), F.to_date(F.max("o_orderdate")).alias("b"))
    return calendar.edition_days(bounds, F.col("a"), F.col("b"))


DAYS = """days AS (SELECT CAST(x AS DATE) AS fecha FROM (SELECT unnest(generate_series((SELECT MIN(d) FROM notices)::TIMESTAMP, (SELECT MAX(d) FROM notices)::TIMESTAMP, INTERVAL 1 DAY)) AS x) y
    WHERE dayofweek(x) IN (2, 4)), loaded AS (SELECT k, d AS fecha, CASE WHEN k % 2 = 0 THEN 'MAT' ELSE 'VES' END AS edicion FROM notices),
    cal AS (SELECT fecha, unnest(['MAT', 'VES']) AS edicion FROM days)"""
register("t5_edition_calendar", calendar_days, f"WITH {DAYS} SELECT fecha FROM days", "notices")
register(
    "t6_missing_editions",
    lambda spark, sf: calendar.missing_editions(calendar_days(spark, sf), daily(spark, sf, 7)),
    f"WITH {DAYS} SELECT fecha, edicion FROM cal WHERE (fecha, edicion) NOT IN (SELECT (fecha, edicion) FROM loaded WHERE k % 7 <> 0)",
    "notices",
)
register(
    "t6_day_progress",
    lambda spark, sf: calendar.day_progress(calendar_days(spark, sf), daily(spark, sf, 7)),
    f"WITH {DAYS} SELECT COUNT(*) AS fechas_total, COUNT(*) FILTER (WHERE fecha IN (SELECT fecha FROM loaded WHERE k % 7 <> 0)) AS fechas_procesadas FROM days",
    "notices",
)


def editions_report(spark, sf):
    return calendar.processing_report(calendar_days(spark, sf), daily(spark, sf, 2**40), daily(spark, sf, 3), daily(spark, sf, 2 * 3))


REPORT = f"""WITH {DAYS}, r AS (SELECT cal.fecha, cal.edicion, dayname(cal.fecha) AS dia_semana,
    (SELECT COUNT(*) FROM loaded l WHERE l.fecha = cal.fecha AND l.edicion = cal.edicion AND k > 0) AS f,
    (SELECT COUNT(*) FROM loaded l WHERE l.fecha = cal.fecha AND l.edicion = cal.edicion AND k % 3 <> 0) AS paginas,
    (SELECT COUNT(*) FROM loaded l WHERE l.fecha = cal.fecha AND l.edicion = cal.edicion AND k % 6 <> 0) AS licitaciones FROM cal),
    s AS (SELECT fecha, edicion, dia_semana, paginas, licitaciones, CASE WHEN f = 0 THEN 'download_failed' WHEN paginas = 0 THEN 'text_extraction_failed'
      WHEN licitaciones = 0 THEN 'text_extracted' ELSE 'fully_processed' END AS status FROM r)"""
register("a45_edition_report", editions_report, f"{REPORT} SELECT * FROM s", "notices")
register(
    "a45_edition_counters",
    lambda spark, sf: calendar.processing_counters(editions_report(spark, sf)),
    f"{REPORT} SELECT status, COUNT(*) AS ediciones FROM s GROUP BY 1",
    "notices",
)


def totals(spark, sf):
    view(spark, sf, "gazette_json")
    body = text_agg("spark", "rec", "k", "','")
    results = spark.sql(
        f"""SELECT CAST(floor(k / 200) AS STRING) AS archivo, '{{"licitaciones":[' || {body} || ']}}' AS text FROM gazette_json GROUP BY floor(k / 200)"""
    )
    return quality.corpus_totals(pages(spark, sf).select("archivo").distinct(), results)


register(
    "a46_corpus_totals",
    totals,
    """SELECT (SELECT COUNT(DISTINCT archivo) FROM notices) AS archivos_txt, COUNT(DISTINCT k // 200) AS archivos_json, COUNT(*) AS licitaciones FROM gazette_json""",
    "notices",
    "gazette_json",
)
