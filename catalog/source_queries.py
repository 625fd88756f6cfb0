"""Readers, normalisers and sinks, on files written from the test tables or on the same documents as columns."""

from __future__ import annotations

import io
import sys
import zipfile
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F

from pregonero.functions.jsons import field
from pregonero.operators import backfill, gazette, joins
from pregonero.operators.backfill import finish
from pregonero.schema import COLUMNS, conform
from pregonero.session import work_dir
from pregonero.sources import csv_ranges, files, ocds, portal, rejects, sinks, sites
from pregonero.sources.ocds import packed, rows_of
from pregonero.sources.registry import SOURCES

from .inputs import AS_OF, iso, table, text_agg, view
from .registry import plain, register

# Functions of this module run inside tasks; sent by value they need no installation on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

def as_of_day():
    return F.lit(AS_OF).cast("date")


DAY = f"DATE '{AS_OF}'"


def on(name, source, build, sql, *views):
    register(name, lambda spark, sf: plain(build(view(spark, sf, source))), sql, *(views or (source,)))


# --- portal -------------------------------------------------------------------------------------------------------

NUMBER = "CASE WHEN k % 10 = 0 THEN 'E-' ELSE 'LA-' END || CAST(k AS VARCHAR)"

on(
    "s1_s2_portal_envelopes",
    "portal_files",
    lambda d: portal.records(d).select("file_name", F.col("pos").cast("long").alias("pos"), field(F.col("rec"), "cod_expediente").alias("codigo")),
    """SELECT CASE chunk % 7 WHEN 5 THEN 'todos_expedientes_' ELSE 'captura_' END || lpad(CAST(chunk AS VARCHAR), 9, '0') || '.json' AS file_name,
    ROW_NUMBER() OVER (PARTITION BY chunk ORDER BY k) - 1 AS pos, 'E-' || CAST(k AS VARCHAR) AS codigo
    FROM (SELECT k, k // 100 AS chunk FROM portal) x WHERE chunk % 7 <> 6""",
    "portal_files",
)


def written_documents(spark, sf, label):
    """The documents written as files of one folder. A folder for each file would be made, moved and listed one after the other
    by the driver; here tasks move their files themselves."""
    path = work_dir(spark, label)
    docs = view(spark, sf, "portal_files").select("text").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    docs.write.options(**{"maxRecordsPerFile": 1, "mapreduce.fileoutputcommitter.algorithm.version": 2}).text(path)
    return path


def portal_scan(spark, sf):
    """The documents written as files of one folder, read back whole."""
    back = files.documents(spark, written_documents(spark, sf, "portal"), "*.txt")
    return portal.records(back).select(field(F.col("rec"), "cod_expediente").alias("codigo"), F.col("pos").cast("long").alias("pos"))


register(
    "s1_portal_files",
    portal_scan,
    """SELECT 'E-' || CAST(k AS VARCHAR) AS codigo, ROW_NUMBER() OVER (PARTITION BY k // 100 ORDER BY k) - 1 AS pos FROM portal
    WHERE (k // 100) % 7 NOT IN (5)
    UNION ALL SELECT 'E-' || CAST(k AS VARCHAR), ROW_NUMBER() OVER (PARTITION BY k // 100 ORDER BY k) - 1 FROM portal WHERE (k // 100) % 7 = 5""",
    "portal",
)


def detail_documents(spark, sf):
    """Detail documents with a modification time; a second copy is a day younger."""
    return view(spark, sf, "portal_details").withColumn(
        "modified", F.timestamp_add("DAY", F.col("copia"), F.lit("2025-01-01").cast("timestamp"))
    )


DETAIL_KEY = "CASE WHEN k % 10 = 1 THEN 'LA-' ELSE 'E-' END || CAST(k AS VARCHAR)"
DETAIL_LINK = "CASE WHEN k % 20 = 0 THEN 'https://portal.example/nuevo/' ELSE 'https://portal.example/#/' END || CAST(k AS VARCHAR)"
register(
    "s3_latest_detail",
    lambda spark, sf: portal.details(detail_documents(spark, sf)).select("codigo", field(F.col("detalle"), "url_completa_con_hash").alias("url")),
    f"SELECT {DETAIL_KEY} AS codigo, {DETAIL_LINK} AS url FROM src WHERE k % 2 = 0 OR k % 10 = 1",
    "src",
)


def portal_records(spark, sf):
    return view(spark, sf, "portal").select(
        F.lit("captura.json").alias("file_name"), F.col("k").alias("pos"), F.parse_json("rec").alias("rec")
    )


def enriched(spark, sf):
    return portal.with_details(portal_records(spark, sf), portal.details(detail_documents(spark, sf)))


# A detail is found by code for even k, by number for k % 10 = 1; k % 10 = 0 has no number of its own.
HAS_DETAIL = "(k % 2 = 0 OR k % 10 = 1)"
FULL = "CASE WHEN k % 20 = 0 THEN 'corta' WHEN k % 3 = 0 THEN 'x' ELSE 'Descripcion completa de la obra ' || buyer END"
OWN = "CASE WHEN k % 3 = 0 THEN buyer ELSE 'Obra ' || buyer END"
register(
    "j1_detail_lookup",
    lambda spark, sf: enriched(spark, sf).select(F.col("pos").alias("k"), field(F.col("detalle"), "url_completa_con_hash").alias("url")),
    f"SELECT k, CASE WHEN {HAS_DETAIL} THEN {DETAIL_LINK} END AS url FROM src",
    "src",
)
on(
    "j2_longer_text_wins",
    "tenders",
    lambda t: t.select("id", joins.longer(F.col("descripcion"), F.concat(F.col("titulo"), F.lit(" en la región "), F.col("entidad_federativa"))).alias("texto")),
    """SELECT id, CASE WHEN length(titulo || ' en la región ' || entidad_federativa) > length(COALESCE(descripcion, ''))
    THEN titulo || ' en la región ' || entidad_federativa ELSE descripcion END AS texto FROM tenders""",
)


def captured(spark, sf):
    """Captured cases of the portal, each case twice in the raw capture."""
    recs = portal_records(spark, sf).select(field(F.col("rec"), "cod_expediente").alias("cod_expediente"), "pos")
    from pregonero.operators.windows import first_per_key

    return first_per_key(recs.unionAll(recs.withColumn("pos", F.col("pos") + 1)), ["cod_expediente"], ["pos"])


register(
    "j3_capture_detail_merge",
    lambda spark, sf: portal.merge_capture(captured(spark, sf), portal.details(detail_documents(spark, sf))).select(
        "cod_expediente", "url_completa_con_hash"
    ),
    f"SELECT 'E-' || CAST(k AS VARCHAR) AS cod_expediente, CASE WHEN k % 2 = 0 THEN {DETAIL_LINK} END AS url_completa_con_hash FROM src",
    "src",
)

PORTAL_SQL = f"""SELECT k AS pos, {NUMBER} AS numero_procedimiento, CASE WHEN k % 17 = 0 THEN prio ELSE 'Contrato ' || seg END AS titulo,
  CASE WHEN {HAS_DETAIL} AND length({FULL}) > length({OWN}) THEN {FULL} ELSE {OWN} END AS descripcion,
  CASE WHEN k % 5 = 0 THEN nation ELSE region END AS entidad_compradora,
  CASE k % 4 WHEN 1 THEN 'INVITACION_3' WHEN 2 THEN 'ADJUDICACION_DIRECTA' ELSE 'LICITACION_PUBLICA' END AS tipo_procedimiento,
  CASE k % 4 WHEN 0 THEN 'SERVICIOS' WHEN 1 THEN 'OBRA_PUBLICA' ELSE 'ADQUISICIONES' END AS tipo_contratacion,
  CASE k % 5 WHEN 0 THEN 'CERRADO' WHEN 1 THEN 'CERRADO' WHEN 2 THEN 'CANCELADO' WHEN 3 THEN 'DESIERTO' ELSE 'VIGENTE' END AS estado,
  CASE WHEN k % 5 < 3 THEN d END AS fecha_publicacion, d AS fecha_apertura,
  CAST(CASE k % 4 WHEN 2 THEN 1234.5 WHEN 3 THEN NULL ELSE price END AS DOUBLE) AS monto_estimado, 'MXN' AS moneda,
  CASE WHEN k % 4 = 0 THEN 'u-' || CAST(k % 3000 AS VARCHAR) END AS uuid_procedimiento, 'ComprasMX' AS fuente,
  CASE WHEN {HAS_DETAIL} THEN {DETAIL_LINK} WHEN k % 6 = 0 THEN 'https://sitio.example/' || CAST(k AS VARCHAR)
    WHEN k % 4 = 0 THEN 'https://comprasmx.buengobierno.gob.mx/sitiopublico/#/sitiopublico/detalle/u-' || CAST(k % 3000 AS VARCHAR) || '/procedimiento'
    ELSE 'https://comprasmx.buengobierno.gob.mx/' END AS url_original"""
PORTAL_COLUMNS = [
    "pos", "numero_procedimiento", "titulo", "descripcion", "entidad_compradora", "tipo_procedimiento", "tipo_contratacion",
    "estado", "fecha_publicacion", "fecha_apertura", "monto_estimado", "moneda", "uuid_procedimiento", "fuente", "url_original",
]
register(
    "n1_portal_normalise",
    lambda spark, sf: plain(portal.normalise(enriched(spark, sf)).select(*PORTAL_COLUMNS)),
    f"{PORTAL_SQL} FROM portal",
    "portal",
)


def detail_members(spark, sf):
    s = F.col("datos_especificos")
    at = "$.detalle_individual"
    return portal.normalise(enriched(spark, sf)).select(
        "pos",
        F.get_json_object(s, "$.ramo").alias("ramo"),
        F.get_json_object(s, "$.tipo_procedimiento").alias("tipo"),
        F.get_json_object(s, f"{at}.url_completa_hash").alias("url"),
        F.get_json_object(s, f"{at}.procesado_exitosamente").alias("procesado"),
        F.get_json_object(s, f"{at}.requisitos").alias("requisitos"),
        F.get_json_object(s, f"{at}.cronograma").alias("cronograma"),
        F.get_json_object(s, f"{at}.contacto").alias("contacto"),
    )


register(
    "n2_detail_integration",
    detail_members,
    f"""SELECT k AS pos, seg AS ramo, CASE k % 4 WHEN 0 THEN 'Licitación Pública' WHEN 1 THEN 'INVITACIÓN A TRES' WHEN 2 THEN 'Adjudicación directa' ELSE 'otro' END AS tipo,
    {DETAIL_LINK} AS url, CASE WHEN k % 20 = 0 THEN 'false' ELSE 'true' END AS procesado,
    CASE WHEN k % 20 = 0 THEN '[]' ELSE '["' || seg || '"]' END AS requisitos, '[]' AS cronograma, '{{}}' AS contacto FROM portal WHERE {HAS_DETAIL}
    UNION ALL SELECT k, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM portal WHERE NOT {HAS_DETAIL}""",
    "portal",
)

# --- open contracting ---------------------------------------------------------------------------------------------

CSV_NAMES = {
    "ocid": "ocid", "id": "id", "date": "date", "buyer_name": "buyer/name", "tender_id": "tender/id", "tender_title": "tender/title",
    "tender_description": "tender/description", "tender_method": "tender/procurementMethod", "tender_category": "tender/mainProcurementCategory",
    "tender_start": "tender/tenderPeriod/startDate", "tender_amount": "tender/value/amount", "project_id": "planning/budget/projectID",
    "budget_description": "planning/budget/description", "budget_amount": "planning/budget/amount",
}


def ocds_csv_folder(spark, sf):
    """The rows written as CSV with slash-path headers."""
    path = work_dir(spark, "ocds")
    rows = view(spark, sf, "ocds").select(*[F.col(c).alias(h) for c, h in CSV_NAMES.items()])
    rows.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return path


def ocds_csv(spark, sf):
    return ocds.read_csv(spark, ocds_csv_folder(spark, sf))


def broken_rows(spark, sf):
    """Cells with line breaks, doubled quotes and commas, in one task, which only writes. The joins stay with many tasks: in one
    (coalesce) the buffers of all their partitions would be held until it ends."""
    rows = view(spark, sf, "ocds").select("k", "ocid", F.concat(F.lit('say "'), "tender_title", F.lit('",\n"x"\n'), "buyer").alias("texto"))
    return rows.repartition(1)


def broken_cells(spark, sf):
    """One file of such cells, read by ranges."""
    path = work_dir(spark, "ocds")
    broken_rows(spark, sf).write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return csv_ranges.read_csv(spark, path)


register(
    "s4_ocds_csv",
    lambda spark, sf: ocds_csv(spark, sf).select(
        *[F.coalesce(F.col(f"`{h}`"), F.lit("")).alias(c) for c, h in CSV_NAMES.items()]
    ),
    "SELECT " + ", ".join(CSV_NAMES) + " FROM ocds",
    "ocds",
)
register(
    "s4_csv_ranges",
    lambda spark, sf: csv_ranges.read_csv(spark, ocds_csv_folder(spark, sf)).select(
        *[F.coalesce(F.col(f"`{h}`"), F.lit("")).alias(c) for c, h in CSV_NAMES.items()]
    ),
    "SELECT " + ", ".join(CSV_NAMES) + " FROM ocds",
    "ocds",
)
register(
    "s4_csv_ranges_with_line_breaks",
    lambda spark, sf: broken_cells(spark, sf).select(F.col("k").cast("long").alias("k"), "ocid", "texto"),
    """SELECT k, ocid, 'say "' || tender_title || '",' || chr(10) || '"x"' || chr(10) || buyer AS texto FROM ocds""",
    "ocds",
)
register(
    "n4_ocds_csv_normalise",
    lambda spark, sf: plain(
        ocds.normalise_csv(ocds_csv(spark, sf), as_of_day()).select(
            "numero_procedimiento", "titulo", "descripcion", "entidad_compradora", "tipo_procedimiento", "tipo_contratacion",
            "fecha_publicacion", "fecha_apertura", "monto_estimado", "url_original", "fuente", "estado",
        )
    ),
    f"""SELECT CASE WHEN k % 7 = 0 THEN 'P-' || CAST(k AS VARCHAR) WHEN k % 3 = 0 THEN CAST(k AS VARCHAR) WHEN k % 3 = 1 THEN ocid ELSE 'T-' || CAST(k AS VARCHAR) END AS numero_procedimiento,
    titulo, CASE WHEN k % 4 <> 0 THEN 'Mantenimiento ' || seg END AS descripcion, buyer AS entidad_compradora,
    CASE k % 5 WHEN 0 THEN 'LICITACION_PUBLICA' WHEN 1 THEN 'INVITACION_3' ELSE 'ADJUDICACION_DIRECTA' END AS tipo_procedimiento,
    CASE k % 4 WHEN 0 THEN 'ADQUISICIONES' WHEN 1 THEN 'OBRA_PUBLICA' WHEN 2 THEN 'SERVICIOS' ELSE 'SERVICIOS' END AS tipo_contratacion,
    CASE WHEN k % 4 < 3 THEN d ELSE {DAY} END AS fecha_publicacion, d AS fecha_apertura,
    CAST(CASE WHEN k % 3 < 2 OR k % 2 = 0 THEN price END AS DOUBLE) AS monto_estimado,
    'https://datosabiertostianguisdigital.cdmx.gob.mx/proceso/' || CASE WHEN k % 3 = 0 OR (k % 3 = 1 AND k % 7 <> 0) THEN CAST(k AS VARCHAR) ELSE id END AS url_original,
    'Tianguis Digital' AS fuente, 'VIGENTE' AS estado
    FROM (SELECT *, CASE WHEN k % 6 = 0 THEN 'Presupuesto ' || seg ELSE tender_title END AS titulo FROM ocds) x WHERE k % 5 <> 2""",
    "ocds",
)


def release_documents(spark, sf, dialect="spark"):
    """Documents of up to a hundred releases: plain, with a transport header, or as a quoted JSON text."""
    view(spark, sf, "releases")
    body = text_agg(dialect, "rec", "k", "','")
    return spark.sql(f"""SELECT 'doc' || CAST(chunk AS STRING) || '.zip' AS file_name, CASE chunk % 3 WHEN 0 THEN body
      WHEN 1 THEN 'HTTP/1.1 200 OK' || chr(10) || 'Content-Type: application/json' || chr(10) || chr(10) || body
      ELSE '"' || replace(body, '"', chr(92) || '"') || '"' END AS text
      FROM (SELECT CAST(floor(k / 100) AS BIGINT) AS chunk, '[' || {body} || ']' AS body FROM releases GROUP BY 1) x""")


ARCHIVE = pa.schema([("file_name", pa.string()), ("content", pa.binary())])


def _zip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def archives():
        for name, text in rows_of(batches):
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
                archive.writestr("leeme.txt", "x")
                archive.writestr("releases.json", text.encode())
            yield name, buffer.getvalue()

    return packed(archives(), ARCHIVE)


def zipped_releases(spark, sf):
    zips = release_documents(spark, sf).mapInArrow(_zip, "file_name string, content binary")
    return ocds.releases(ocds.unzip(zips))


register(
    "s5_ocds_zip",
    lambda spark, sf: zipped_releases(spark, sf).select(
        "file_name", F.col("pos").cast("long").alias("pos"), field(F.col("rec"), "id").alias("id")
    ),
    """SELECT 'doc' || CAST(k // 100 AS VARCHAR) || '.zip' AS file_name, ROW_NUMBER() OVER (PARTITION BY k // 100 ORDER BY k) - 1 AS pos,
    'R' || CAST(k AS VARCHAR) AS id FROM releases""",
    "releases",
)
register(
    "n4_ocds_zip_normalise",
    lambda spark, sf: plain(
        ocds.normalise_releases(zipped_releases(spark, sf)).select(
            "numero_procedimiento", "titulo", "descripcion", "entidad_compradora", "tipo_procedimiento", "tipo_contratacion", "estado",
            "fecha_publicacion", "fecha_apertura", "monto_estimado", "moneda", "fuente", "url_original",
        )
    ),
    """SELECT CASE WHEN k % 9 = 0 THEN 'R' ELSE 'ocds-87sd3t-' END || CAST(k AS VARCHAR) AS numero_procedimiento,
    CASE WHEN k % 5 = 0 THEN seg ELSE 'Compra ' || seg END AS titulo, prio AS descripcion, CASE WHEN k % 3 < 2 THEN buyer ELSE '' END AS entidad_compradora,
    CASE k % 4 WHEN 0 THEN 'LICITACION_PUBLICA' WHEN 1 THEN 'INVITACION_3' ELSE 'ADJUDICACION_DIRECTA' END AS tipo_procedimiento,
    CASE k % 3 WHEN 0 THEN 'ADQUISICIONES' WHEN 1 THEN 'OBRA_PUBLICA' ELSE 'SERVICIOS' END AS tipo_contratacion,
    CASE k % 5 WHEN 1 THEN 'CERRADO' WHEN 2 THEN 'CANCELADO' ELSE 'VIGENTE' END AS estado, d AS fecha_publicacion, d AS fecha_apertura,
    CAST(CASE WHEN k % 4 < 2 THEN price ELSE k END AS DOUBLE) AS monto_estimado, CASE WHEN k % 4 = 1 THEN 'USD' ELSE 'MXN' END AS moneda,
    'TIANGUIS_ZIP' AS fuente, CASE WHEN k % 9 <> 0 THEN 'https://tianguisdigital.cdmx.gob.mx/ocds/tender/ocds-87sd3t-' || CAST(k AS VARCHAR) END AS url_original FROM releases""",
    "releases",
)
register(
    "n7_page_api_normalise",
    lambda spark, sf: plain(
        ocds.normalise_page_api(
            view(spark, sf, "tenders").select(
                F.parse_json(
                    F.to_json(F.struct(
                        F.col("numero_procedimiento"), F.col("titulo").alias("nombre"), F.col("descripcion").alias("objeto"),
                        F.when(F.col("id") % 3 != 0, F.col("unidad_compradora")).alias("unidad_compradora"), F.col("estado").alias("status"),
                        F.format_string("$%s", F.col("monto_estimado").cast("string")).alias("monto_estimado"),
                        F.date_format("fecha_publicacion", "dd/MM/yyyy").alias("created_at"), F.col("id"),
                    ))
                ).alias("rec")
            )
        ).select("numero_procedimiento", "titulo", "descripcion", "entidad_compradora", "estado", "monto_estimado", "entidad_federativa", "fecha_publicacion", "url_original")
    ),
    """SELECT numero_procedimiento, titulo, COALESCE(descripcion, '') AS descripcion, CASE WHEN id % 3 <> 0 THEN unidad_compradora ELSE 'CDMX' END AS entidad_compradora,
    estado, CAST(COALESCE(monto_estimado, 0) AS DOUBLE) AS monto_estimado, 'Ciudad de México' AS entidad_federativa, fecha_publicacion,
    'https://tianguis.cdmx.gob.mx/licitacion/' || CAST(id AS VARCHAR) AS url_original FROM tenders""",
    "tenders",
)


def cornerstone_records(spark, sf):
    return view(spark, sf, "tenders").select(
        F.parse_json(
            F.to_json(F.struct(
                F.when(F.col("id") % 2 == 0, F.col("numero_procedimiento")).otherwise("").alias("numero_identificacion"),
                F.col("numero_procedimiento").alias("numero_procedimiento_contratacion"),
                F.when(F.col("id") % 5 != 0, F.col("titulo")).alias("titulo_basico"),
                F.col("entidad_compradora").alias("dependencia_entidad"), F.col("caracter"),
                F.when(F.col("id") % 3 == 0, F.col("estado")).alias("estatus"),
                F.date_format("fecha_publicacion", "yyyy-MM-dd").alias("fecha_publicacion"), F.col("uuid_procedimiento").alias("uuid"),
                F.when(F.col("id") % 4 == 0, False).alias("procesado_haiku"),
            ))
        ).alias("rec")
    )


CORNERSTONE = ["numero_procedimiento", "titulo", "entidad_compradora", "estado", "fecha_publicacion", "uuid_procedimiento", "fuente"]
register(
    "n7_alternative_gazette",
    lambda spark, sf: backfill.cornerstone_gazette(cornerstone_records(spark, sf)).select(
        *CORNERSTONE, F.get_json_object("datos_especificos", "$.procesado_haiku").alias("procesado")
    ),
    """SELECT numero_procedimiento, CASE WHEN id % 5 <> 0 THEN titulo ELSE 'Sin título' END AS titulo, entidad_compradora, 'Publicada' AS estado,
    fecha_publicacion, uuid_procedimiento, 'DOF' AS fuente, CASE WHEN id % 4 = 0 THEN 'false' ELSE 'true' END AS procesado FROM tenders""",
    "tenders",
)
register(
    "n7_alternative_portal",
    lambda spark, sf: backfill.cornerstone_portal(cornerstone_records(spark, sf)).select(*CORNERSTONE, "caracter"),
    """SELECT CASE WHEN id % 2 = 0 THEN numero_procedimiento ELSE '' END AS numero_procedimiento, CASE WHEN id % 5 <> 0 THEN titulo ELSE 'Sin título' END AS titulo,
    entidad_compradora, CASE WHEN id % 3 = 0 THEN estado ELSE 'Publicada' END AS estado, fecha_publicacion, uuid_procedimiento, 'ComprasMX' AS fuente, caracter FROM tenders""",
    "tenders",
)

# --- sites --------------------------------------------------------------------------------------------------------

def site_records(spark, sf):
    """The lines written as text and read back line by line."""
    path = work_dir(spark, "sites")
    view(spark, sf, "site_lines").select("line").write.text(path)
    return sites.read_lines(spark, path, "*.txt")


LINE_OK = "k % 50 NOT IN (48, 49)"
register(
    "s6_json_lines",
    lambda spark, sf: site_records(spark, sf).select(F.to_json("rec").alias("j")).select(
        F.coalesce(F.get_json_object("j", "$.Organismo"), F.get_json_object("j", "$.source")).alias("organismo")
    ).groupBy("organismo").agg(F.count(F.lit(1)).alias("n")),
    f"SELECT buyer AS organismo, COUNT(*) AS n FROM site_lines WHERE {LINE_OK} GROUP BY 1",
    "site_lines",
)
register(
    "n5_site_normalise",
    lambda spark, sf: plain(
        sites.normalise(sites.parse_lines(view(spark, sf, "site_lines").select("line")), as_of_day())
        .select("numero_procedimiento", "titulo", "entidad_compradora", "unidad_compradora", "tipo_procedimiento", "tipo_contratacion",
                "fecha_publicacion", "monto_estimado", "url_original", "fuente")
    ),
    f"""SELECT CASE k % 6 WHEN 0 THEN 'LP-' || CAST(k AS VARCHAR) || '-EST' WHEN 1 THEN '123/2024' WHEN 2 THEN 'XYZ-' || lpad(CAST(k AS VARCHAR), 4, '0')
      WHEN 3 THEN 'No. 45.B' ELSE 'SM-' || substr(sha256(titulo), 1, 24) END AS numero_procedimiento, titulo, buyer AS entidad_compradora,
    CASE WHEN k % 4 = 0 THEN NULL WHEN k % 2 = 0 THEN region ELSE nation END AS unidad_compradora,
    CASE WHEN k % 6 = 0 THEN 'LICITACION_PUBLICA' WHEN k % 6 = 1 THEN 'INVITACION_3' ELSE 'ADJUDICACION_DIRECTA' END AS tipo_procedimiento,
    CASE k % 6 WHEN 0 THEN 'OBRA_PUBLICA' WHEN 1 THEN 'SERVICIOS' WHEN 2 THEN 'OBRA_PUBLICA' ELSE 'ADQUISICIONES' END AS tipo_contratacion,
    {DAY} AS fecha_publicacion, CAST(CASE WHEN k % 2 = 0 THEN CASE k % 6 WHEN 0 THEN 1234567.50 WHEN 2 THEN 1234 END END AS DOUBLE) AS monto_estimado,
    CASE WHEN k % 2 = 1 THEN 'https://doc.example/' || CAST(k AS VARCHAR) || '.pdf' WHEN k % 3 <> 0 THEN 'https://sitio.example/' || CAST(k AS VARCHAR) END AS url_original,
    'SITIOS_MASIVOS' AS fuente FROM site_lines WHERE {LINE_OK} AND k % 6 <> 5""",
    "site_lines",
)
HARVEST = ["page_id", "pos", "code", "title", "date", "doc_url"]


def harvested(spark, sf):
    pages = view(spark, sf, "link_pages")
    return sites.harvest(pages.select("page_id", "url", "html"), F.lit("sitio"), F.lit("estatal"))


LINKS_SQL = """SELECT page_id, 0 AS pos, CASE WHEN page_id < 10 THEN 'LPN-' || CAST(page_id AS VARCHAR) ELSE 'LPN-' || CAST(page_id AS VARCHAR) END AS code,
    'Convocatoria LPN-' || CAST(page_id AS VARCHAR) || ' obra SAF-1' AS title, d AS date,
    regexp_extract(url, '^https://[^/]+') || '/doc/' || CAST(page_id AS VARCHAR) AS doc_url FROM link_pages
    UNION ALL SELECT page_id, 1, NULL, 'https://otro.example/x.pdf?v=' || CAST(page_id AS VARCHAR), d, 'https://otro.example/x.pdf?v=' || CAST(page_id AS VARCHAR) FROM link_pages
    UNION ALL SELECT page_id, 3, NULL, 'Documento general', NULL, url || 'bases/' || CAST(page_id AS VARCHAR) || '.html' FROM link_pages"""
register("s14_f18_link_harvest", lambda spark, sf: harvested(spark, sf).select(*HARVEST), LINKS_SQL, "link_pages")
register(
    "s14_links_of_stored_pages",
    lambda spark, sf: sites.page_links(table(spark, sf, "pages")).select("page_id", F.col("pos").cast("long").alias("pos"), "href", "label"),
    """SELECT page_id, generate_subscripts(l, 1) - 1 AS pos, regexp_extract(unnest(l), 'href="([^"]*)"', 1) AS href,
    regexp_extract(unnest(l), '>([^<]*)$', 1) AS label FROM (SELECT page_id, regexp_extract_all(html, '<a [^>]*>[^<]*') AS l FROM pages) x""",
)
register(
    "s14_harvest_of_stored_pages",
    lambda spark, sf: sites.harvest(table(spark, sf, "pages"), F.lit("web"), F.lit(""), keywords=["tion", "en", "ción"]).select("page_id", "title", "doc_url"),
    """SELECT DISTINCT page_id, label AS title, regexp_extract(url, '^https?://[^/]+') || href AS doc_url FROM (
      SELECT page_id, url, regexp_extract(a, 'href="([^"]*)"', 1) AS href, trim(regexp_extract(a, '>([^<]*)$', 1)) AS label FROM (
        SELECT page_id, url, unnest(regexp_extract_all(html, '<a [^>]*>[^<]*')) AS a FROM pages) x) y
    WHERE contains(lower(label || ' ' || href), 'tion') OR contains(lower(label || ' ' || href), 'en') OR contains(lower(label || ' ' || href), 'ción')
      OR regexp_matches(href, '(?i)\\.pdf($|\\?)')""",
)
register(
    "f17_w4_harvest_in_window",
    lambda spark, sf: sites.harvest(
        view(spark, sf, "link_pages").select("page_id", "url", "html"), F.lit("s"), F.lit("j"),
        F.lit("1997-01-01").cast("date"), F.lit("1997-12-31").cast("date"),
    ).select("page_id", "pos"),
    """SELECT page_id, unnest([0, 1, 3]) AS pos FROM link_pages WHERE d BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'
    UNION ALL SELECT page_id, 3 FROM link_pages WHERE d NOT BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'""",
    "link_pages",
)
register(
    "n6_item_mapping",
    lambda spark, sf: sites.map_items(harvested(spark, sf).withColumn("raw_text", F.concat(F.lit("Costo $"), F.col("page_id").cast("string"), F.lit(".50 mxn")))),
    r"""SELECT 'sitio' AS Organismo, 'estatal' AS localidad, title AS Proyecto, doc_url AS "Vínculo",
    CASE WHEN page_id < 1000 THEN '$' || CAST(page_id AS VARCHAR) || '.50' ELSE '$' || substr(CAST(page_id AS VARCHAR), 1, 3) END AS Monto
    FROM (""" + LINKS_SQL + ") y",
    "link_pages",
)

# --- pasted pages -------------------------------------------------------------------------------------------------

on(
    "g17_pasted_portal_text",
    "pasted",
    lambda d: portal.pasted_detail(portal.parse_pasted(d)).select(
        "k", "codigo_expediente", "numero_procedimiento", "estatus", "nombre_procedimiento", "dependencia_entidad", "correo_electronico",
        "entidad_federativa", "fecha_fallo", "caracter", "ramo",
        F.get_json_object("detalle", "$.informacion_extraida.contacto.emails[0]").alias("correo_del_detalle"),
        F.get_json_object("detalle", "$.informacion_extraida.fechas_detalladas.acto_fallo").alias("fallo_del_detalle"),
    ),
    """SELECT k, 'E-' || CAST(k AS VARCHAR) AS codigo_expediente, 'LA-' || CAST(k AS VARCHAR) AS numero_procedimiento, 'VIGENTE' AS estatus,
    CASE WHEN k % 3 <> 0 THEN 'Compra ' || seg END AS nombre_procedimiento, buyer AS dependencia_entidad, 'a' || CAST(k AS VARCHAR) || '@x.example' AS correo_electronico,
    region AS entidad_federativa, strftime(d, '%d/%m/%Y') || ' 10:00' AS fecha_fallo, 'Nacional' AS caracter, CAST(NULL AS VARCHAR) AS ramo,
    'a' || CAST(k AS VARCHAR) || '@x.example' AS correo_del_detalle, strftime(d, '%d/%m/%Y') || ' 10:00' AS fallo_del_detalle FROM pasted""",
)

# --- gazette files ------------------------------------------------------------------------------------------------

def gazette_documents(spark, sf):
    """Gazette JSON documents of up to two hundred records: second version, first version as object or as list."""
    view(spark, sf, "gazette_json")
    body = text_agg("spark", "rec", "k", "','")
    return spark.sql(f"""SELECT 'g' || CAST(chunk AS STRING) || '_' || CAST(par AS STRING) || '.json' AS file_name,
      CASE WHEN par = 0 THEN '{{"version_extractor":"2.0","fecha_ejemplar":"2025-08-05","edicion_ejemplar":"MAT","licitaciones":[' || body || ']}}'
        WHEN chunk % 2 = 0 THEN '{{"licitaciones":[' || body || ']}}' ELSE '[' || body || ']' END AS text
      FROM (SELECT CAST(floor(k / 200) AS BIGINT) AS chunk, k % 2 AS par, {body} AS body FROM gazette_json GROUP BY 1, 2) x""")


register(
    "s8_gazette_json",
    lambda spark, sf: gazette.file_records(gazette_documents(spark, sf)).select(
        "file_name", "mejorado", F.col("pos").cast("long").alias("pos"), field(F.col("rec"), "referencia").alias("referencia")
    ),
    """SELECT 'g' || CAST(k // 200 AS VARCHAR) || '_' || CAST(k % 2 AS VARCHAR) || '.json' AS file_name, k % 2 = 0 AS mejorado,
    ROW_NUMBER() OVER (PARTITION BY k // 200, k % 2 ORDER BY k) - 1 AS pos, referencia FROM gazette_json""",
    "gazette_json",
)
register(
    "n3_gazette_json_normalise",
    lambda spark, sf: gazette.normalise_file_records(gazette.file_records(gazette_documents(spark, sf)), as_of_day()).select(
        "numero_procedimiento", "titulo", "entidad_compradora", "unidad_compradora", "tipo_procedimiento", "tipo_contratacion", "caracter",
        "fecha_publicacion", "fecha_junta_aclaraciones", "fecha_apertura", "fecha_fallo",
        F.get_json_object("datos_originales", "$.fecha_ejemplar").alias("ejemplar"), F.get_json_object("datos_originales", "$.pagina").alias("pagina"),
    ),
    """SELECT numero AS numero_procedimiento, CASE WHEN k % 2 = 0 AND k % 5 = 0 THEN objeto || ' Volumen a Adquirir 10 piezas' ELSE objeto END AS titulo,
    dependencia AS entidad_compradora, CASE WHEN k % 3 <> 0 THEN segunda WHEN k % 2 = 0 THEN 'Unidad ' || seg ELSE '' END AS unidad_compradora,
    'LICITACION_PUBLICA' AS tipo_procedimiento, CASE k % 4 WHEN 0 THEN 'OBRA_PUBLICA' WHEN 1 THEN 'SERVICIOS' ELSE 'ADQUISICIONES' END AS tipo_contratacion,
    CASE WHEN k % 4 = 0 THEN 'INTERNACIONAL' END AS caracter, d AS fecha_publicacion, d_junta AS fecha_junta_aclaraciones, d_apertura AS fecha_apertura,
    CASE WHEN k % 3 <> 0 THEN d_fallo END AS fecha_fallo, CASE WHEN k % 2 = 0 THEN '2025-08-05' END AS ejemplar, CAST(k % 100 AS VARCHAR) AS pagina
    FROM (SELECT *, CASE WHEN k % 3 = 1 THEN 'Subdirección de compras' ELSE 'INSTITUTO DE VIVIENDA' END AS segunda FROM gazette_json) x
    WHERE numero IS NOT NULL AND dependencia IS NOT NULL""",
    "gazette_json",
)


def file_listing(spark, sf):
    """A file listing shaped like the result folder: one plain file per edition, some improved, some answers."""
    n = view(spark, sf, "notices")
    stem = F.concat(F.date_format("d", "ddMMyyyy"), F.when(F.col("k") % 2 == 0, "_MAT").otherwise("_VES"))
    kinds = F.array(
        F.concat(stem, F.lit("_licitaciones")),
        F.when(F.col("k") % 3 == 0, F.concat(stem, F.lit("_licitaciones_mejorado"))),
        F.when(F.col("k") % 5 == 0, F.concat(stem, F.lit("_ai"))),
        F.when(F.col("k") % 7 == 0, F.concat(F.lit("dof_consolidado_"), F.date_format("d", "yyyyMMdd"))),
    )
    rows = n.select(F.explode(F.array_compact(kinds)).alias("stem"), F.col("d").cast("timestamp").alias("modified")).distinct()
    return rows.select(
        F.concat(F.lit("/datos/"), "stem", F.lit(".json")).alias("path"), F.concat("stem", F.lit(".json")).alias("file_name"), "stem", "modified"
    )


register(
    "s9_prefer_improved",
    lambda spark, sf: files.prefer_improved(file_listing(spark, sf)).select("base", "file_name"),
    """SELECT base, base || CASE WHEN MAX(CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END) = 1 THEN '_licitaciones_mejorado.json' ELSE '_licitaciones.json' END AS file_name
    FROM (SELECT k, strftime(d, '%d%m%Y') || CASE WHEN k % 2 = 0 THEN '_MAT' ELSE '_VES' END AS base FROM notices) x GROUP BY 1""",
    "notices",
)
register(
    "s10_latest_consolidated",
    lambda spark, sf: files.latest_consolidated(file_listing(spark, sf)),
    "SELECT '/datos/dof_consolidado_' || strftime(MAX(d), '%Y%m%d') || '.json' AS path FROM notices WHERE k % 7 = 0",
    "notices",
)
register(
    "s10_answers_without_consolidated",
    lambda spark, sf: files.latest_consolidated(file_listing(spark, sf).filter(~F.col("stem").contains("consolidado"))),
    """SELECT DISTINCT '/datos/' || strftime(d, '%d%m%Y') || CASE WHEN k % 2 = 0 THEN '_MAT' ELSE '_VES' END || '_ai.json' AS path FROM notices WHERE k % 5 = 0""",
    "notices",
)


def text_listing(spark, sf):
    n = view(spark, sf, "notices")
    stem = F.concat(F.date_format("d", "ddMMyyyy"), F.when(F.col("k") % 2 == 0, "_MAT").otherwise("_VES"))
    name = F.concat(F.when(F.col("k") % 9 == 0, "DOF_").otherwise(""), stem, F.when(F.col("k") % 11 == 0, ".log").otherwise(".txt"))
    return n.select(name.alias("file_name")).distinct().select(
        F.concat(F.lit("/datos/"), "file_name").alias("path"), "file_name", F.regexp_replace("file_name", r"\.[^.]*$", "").alias("stem")
    )


TEXT_NAME = "CASE WHEN k % 9 = 0 THEN 'DOF_' ELSE '' END || strftime(d, '%d%m%Y') || CASE WHEN k % 2 = 0 THEN '_MAT' ELSE '_VES' END"
register(
    "s12_text_work_list",
    lambda spark, sf: files.text_work_list(text_listing(spark, sf)).select("file_name"),
    f"SELECT DISTINCT {TEXT_NAME} || '.txt' AS file_name FROM notices WHERE k % 11 <> 0",
    "notices",
)


def processed_split(spark, sf):
    texts = text_listing(spark, sf).filter("file_name like '%.txt'").select("stem")
    results = view(spark, sf, "notices").select(
        F.concat(F.date_format(F.date_add("d", 1), "ddMMyyyy"), F.when(F.col("k") % 2 == 0, "_MAT").otherwise("_VES"), F.lit("_mejorado")).alias("stem")
    ).distinct()
    todo, known, orphan = files.split_by_processed(texts, results)
    part = lambda df, name: df.select(F.lit(name).alias("parte"), "stem")
    return part(todo, "pendiente").unionByName(part(known, "hecho")).unionByName(part(orphan, "sin texto"))


register(
    "s13_u_3_already_processed",
    processed_split,
    f"""WITH t AS (SELECT DISTINCT {TEXT_NAME} AS stem FROM notices WHERE k % 11 <> 0),
    r AS (SELECT DISTINCT strftime(d + 1, '%d%m%Y') || CASE WHEN k % 2 = 0 THEN '_MAT' ELSE '_VES' END AS stem FROM notices)
    SELECT 'pendiente' AS parte, stem FROM t WHERE stem NOT IN (SELECT stem FROM r)
    UNION ALL SELECT 'hecho', stem FROM r WHERE stem IN (SELECT stem FROM t)
    UNION ALL SELECT 'sin texto', stem FROM r WHERE stem NOT IN (SELECT stem FROM t)""",
    "notices",
)
register(
    "s7_edition_from_name",
    lambda spark, sf: text_listing(spark, sf).select("file_name").withColumns(files.edition_columns(F.col("file_name"), as_of_day())),
    f"""SELECT DISTINCT {TEXT_NAME} || CASE WHEN k % 11 = 0 THEN '.log' ELSE '.txt' END AS file_name, {iso('d')} AS fecha_ejemplar,
    CASE WHEN k % 2 = 0 THEN 'MAT' ELSE 'VES' END AS edicion_ejemplar FROM notices""",
    "notices",
)


def recent_documents(spark, sf):
    """Documents just written, read with a limit on their age; an age limit in the future finds none."""
    path = written_documents(spark, sf, "recent")
    recent = files.documents(spark, path, "*.txt", modified_after="2020-01-01T00:00:00")
    later = files.listing(spark, path, "*.txt", modified_after="2999-01-01T00:00:00")
    found = recent.select(F.md5(F.rtrim(F.regexp_replace("text", "\n$", ""))).alias("h"))
    return found.unionByName(later.select(F.lit("futuro").alias("h")))


register("s11_recent_files", recent_documents, "SELECT md5(text) AS h FROM portal_files", "portal_files")

# --- stored answers -----------------------------------------------------------------------------------------------

on(
    "x30_answer_cleanup",
    "answers",
    lambda d: gazette.answer_records(d).select(
        "file", "page", F.col("pos").cast("long").alias("pos"), "numero_procedimiento", "titulo", "fecha_publicacion", "estado",
        F.get_json_object("datos_originales", "$.pagina_dof").alias("pagina_dof"),
    ),
    """SELECT file, page, pos, CASE WHEN k % 4 <> 0 THEN 'LA-' || CAST(k AS VARCHAR) END AS numero_procedimiento, seg AS titulo,
    strftime(d, '%Y-%m-%d') AS fecha_publicacion, 'PUBLICADA' AS estado, CAST(page AS VARCHAR) AS pagina_dof
    FROM (SELECT *, unnest(CASE WHEN k % 5 = 1 THEN [0, 1] WHEN k % 5 = 4 THEN [] ELSE [0] END) AS pos FROM answers) x""",
)
on(
    "f22_drop_unnumbered",
    "answers",
    lambda d: gazette.numbered(gazette.answer_records(d))[1],
    """SELECT file, SUM(CASE WHEN k % 4 = 0 THEN n ELSE 0 END)::BIGINT AS sin_numero, SUM(CASE WHEN k % 4 <> 0 THEN n ELSE 0 END)::BIGINT AS validas
    FROM (SELECT *, CASE k % 5 WHEN 1 THEN 2 WHEN 4 THEN 0 ELSE 1 END AS n FROM answers) x WHERE n > 0 GROUP BY 1""",
)

# --- sinks --------------------------------------------------------------------------------------------------------

def jsonl_round_trip(spark, sf):
    path = work_dir(spark, "jsonl")
    t = plain(view(spark, sf, "tenders")).select("id", "titulo", "descripcion", "fecha_publicacion", "monto_estimado")
    sinks.write_jsonl(t, path)
    return spark.read.schema(t.schema).json(path)


register(
    "s16_json_lines_sink",
    jsonl_round_trip,
    "SELECT id, titulo, descripcion, fecha_publicacion, CAST(monto_estimado AS DOUBLE) AS monto_estimado FROM tenders",
    "tenders",
)


def csv_round_trip(spark, sf):
    path = work_dir(spark, "csv")
    sinks.write_csv(view(spark, sf, "tenders").select("id", "titulo", "descripcion", "datos_originales"), path)
    back = spark.read.option("header", True).option("escape", '"').schema("id long, titulo string, descripcion string, datos_originales string").csv(path)
    return back.select("id", "titulo", *[F.coalesce(c, F.lit("")).alias(c) for c in ("descripcion", "datos_originales")])


register(
    "s16_csv_sink",
    csv_round_trip,
    "SELECT id, titulo, COALESCE(descripcion, '') AS descripcion, COALESCE(datos_originales, '') AS datos_originales FROM tenders",
    "tenders",
)


def export_round_trip(spark, sf):
    path = work_dir(spark, "export")
    rows = view(spark, sf, "portal").select("k", "seg", F.col("rec").alias("texto_completo"))
    sinks.export_details(rows, path)
    return spark.read.option("header", True).csv(f"{path}/csv").join(spark.read.json(f"{path}/json"), ["k", "seg"]).select(F.col("k").cast("long").alias("k"), "seg")


register("s21_detail_export", export_round_trip, "SELECT k, seg FROM portal", "portal")
on(
    "s18_serialised_rows",
    "tenders",
    lambda t: sinks.serialise(t.select("id", "titulo", "fecha_publicacion", "monto_estimado", "descripcion")),
    """SELECT CAST(json_object('id', id, 'titulo', titulo, 'fecha_publicacion', strftime(fecha_publicacion, '%Y-%m-%d'),
    'monto_estimado', CAST(monto_estimado AS DOUBLE), 'descripcion', descripcion) AS VARCHAR) AS json FROM tenders""",
)

# --- what can't be read -------------------------------------------------------------------------------------------

CHUNK = "CAST(regexp_extract(file_name, '([0-9]+)', 1) AS INT)"
BROKEN = f"""CASE {CHUNK} % 4 WHEN 1 THEN substr(text, 1, length(text) - 1) WHEN 2 THEN '{{"otro":[1]}}' ELSE text END"""
BROKEN_SQL = "SELECT '{}' AS fuente, file_name AS archivo, CASE c % 4 WHEN 1 THEN 'no es JSON' ELSE 'sin lista de registros' END AS motivo, 1 AS n FROM ({}) x WHERE c % 4 IN (1, 2)"
register(
    "s1_portal_rejects",
    lambda spark, sf: rejects.portal_rejects(view(spark, sf, "portal_files").select("file_name", F.expr(BROKEN).alias("text"))),
    BROKEN_SQL.format("ComprasMX", f"SELECT file_name, {CHUNK} AS c FROM portal_files"),
    "portal_files",
)
register(
    "s8_gazette_rejects",
    lambda spark, sf: rejects.gazette_rejects(gazette_documents(spark, sf).select("file_name", F.expr(BROKEN).alias("text"))),
    BROKEN_SQL.format("DOF", "SELECT DISTINCT 'g' || CAST(k // 200 AS VARCHAR) || '_' || CAST(k % 2 AS VARCHAR) || '.json' AS file_name, k // 200 AS c FROM gazette_json"),
    "gazette_json",
)


def _spoiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Archives by number: damaged, without JSON, with the JSON in a folder, with JSON that is no list, or whole."""

    def archives():
        for name, text in rows_of(batches):
            kind, buffer = int(name[3:-4]) % 5, io.BytesIO()
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
                archive.writestr("leeme.txt", "x")
                if kind != 2:
                    archive.writestr("datos/releases.json" if kind == 3 else "releases.json", "{}" if kind == 4 else text)
            content = buffer.getvalue()
            yield name, content[: len(content) // 2] if kind == 1 else content

    return packed(archives(), ARCHIVE)


def spoiled_zips(spark, sf):
    return ocds.unpack(release_documents(spark, sf).mapInArrow(_spoiled, "file_name string, content binary"))


register(
    "s5_zip_rejects",
    lambda spark, sf: (lambda u: rejects.zip_rejects(u, ocds.releases(u.filter("problema is null").select("file_name", "text"))))(spoiled_zips(spark, sf)),
    """SELECT DISTINCT 'TIANGUIS_ZIP' AS fuente, 'doc' || CAST(k // 100 AS VARCHAR) || '.zip' AS archivo, CASE k // 100 % 5 WHEN 1 THEN 'archivo dañado: BadZipFile'
    WHEN 2 THEN 'sin JSON' ELSE 'sin lista de registros' END AS motivo, 1 AS n FROM releases WHERE k // 100 % 5 IN (1, 2, 4)""",
    "releases",
)
register(
    "s5_zip_with_folders",
    lambda spark, sf: ocds.releases(spoiled_zips(spark, sf).filter("problema is null").select("file_name", "text")).select(
        "file_name", F.col("pos").cast("long").alias("pos"), field(F.col("rec"), "id").alias("id")
    ),
    """SELECT 'doc' || CAST(k // 100 AS VARCHAR) || '.zip' AS file_name, ROW_NUMBER() OVER (PARTITION BY k // 100 ORDER BY k) - 1 AS pos,
    'R' || CAST(k AS VARCHAR) AS id FROM releases WHERE k // 100 % 5 IN (0, 3)""",
    "releases",
)
register(
    "s4_csv_rejects",
    lambda spark, sf: rejects.csv_rejects(ocds_csv(spark, sf).withColumn("file_name", F.lit("a.csv"))),
    "SELECT 'Tianguis Digital' AS fuente, 'a.csv' AS archivo, 'sin comprador' AS motivo, COUNT(*) AS n FROM ocds WHERE k % 5 = 2",
    "ocds",
)
register(
    "s6_line_rejects",
    lambda spark, sf: rejects.line_rejects(view(spark, sf, "site_lines").select(F.lit("a.jsonl").alias("file_name"), F.col("line").alias("value"))),
    "SELECT 'SITIOS_MASIVOS' AS fuente, 'a.jsonl' AS archivo, 'no es JSON' AS motivo, COUNT(*) AS n FROM site_lines WHERE k % 50 = 48",
    "site_lines",
)


def source_rows(spark, sf):
    """The rows of all sources as the registry unites them: normalised and completed."""
    from .gazette_queries import pages

    portal_recs = view(spark, sf, "portal").select(F.lit("a").alias("file_name"), F.col("k").alias("pos"), F.parse_json("rec").alias("rec"))
    read = {
        "comprasmx": portal_recs, "dof": gazette.file_records(gazette_documents(spark, sf)), "dof_texto": pages(spark, sf),
        "tianguis": ocds_csv(spark, sf), "zip": zipped_releases(spark, sf),
        "sitios-masivos": sites.parse_lines(view(spark, sf, "site_lines").select("line")),
    }
    parts = [conform(finish(SOURCES[name].normalise(rows, as_of_day()))).withColumn("origen", F.lit(name)) for name, rows in read.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


register(
    "n_batch_of_all_sources",
    lambda spark, sf: source_rows(spark, sf).groupBy("origen", "fuente").agg(
        F.count(F.lit(1)).alias("n"), F.count("hash_contenido").alias("con_clave"), F.count_if(F.col("titulo") != "").alias("con_titulo")
    ),
    f"""SELECT 'comprasmx' AS origen, 'ComprasMX' AS fuente, COUNT(*) AS n, COUNT(*) AS con_clave, COUNT(*) AS con_titulo FROM portal
    UNION ALL SELECT 'dof', 'DOF', COUNT(*), COUNT(*), COUNT(*) FROM gazette_json WHERE numero IS NOT NULL AND dependencia IS NOT NULL
    UNION ALL SELECT 'dof_texto', 'DOF', COUNT(*), COUNT(*), COUNT(*) FROM blocks WHERE numero IS NOT NULL OR dependencia IS NOT NULL OR segunda = 'INSTITUTO DE VIVIENDA'
    UNION ALL SELECT 'tianguis', 'Tianguis Digital', COUNT(*), COUNT(*), COUNT(*) FROM ocds WHERE k % 5 <> 2
    UNION ALL SELECT 'zip', 'TIANGUIS_ZIP', COUNT(*), COUNT(*), COUNT(*) FROM releases
    UNION ALL SELECT 'sitios-masivos', 'SITIOS_MASIVOS', COUNT(*), COUNT(*), COUNT(*) FROM site_lines WHERE {LINE_OK} AND k % 6 <> 5""",
    "portal", "gazette_json", "blocks", "ocds", "releases", "site_lines",
)
