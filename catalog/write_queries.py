"""Completion, insert, upsert, back-fill and streaming, on tables written from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pregonero.functions.jsons import build
from pregonero.operators import backfill, changes, gazette, joins, upsert
from pregonero.plans import quality
from pregonero.schema import TENDER, conform
from pregonero.session import work_dir
from pregonero.sources import portal, rejects
from pregonero.streaming import ingest

from .inputs import table, view
from .registry import plain, register, stamp


def tenders(spark, sf):
    return view(spark, sf, "tenders")


def on_tenders(name, build_df, sql):
    register(name, lambda spark, sf: plain(build_df(tenders(spark, sf))), sql, "tenders")


# --- completion ---------------------------------------------------------------------------------------------------

on_tenders(
    "n8_geography_by_source",
    lambda t: backfill.with_geography(t.withColumns({"entidad_federativa": F.lit(None).cast("string"), "municipio": F.lit(None).cast("string")})).select(
        "id", "entidad_federativa", "municipio"
    ),
    """SELECT id, CASE WHEN id % 4 = 0 THEN json_extract_string(datos_originales, '$.entidad_federativa_contratacion')
      WHEN id % 4 = 2 THEN json_extract_string(datos_originales, '$.tender.procuringEntity.address.region') END AS entidad_federativa,
    CASE WHEN id % 4 IN (0, 2) THEN unidad_compradora END AS municipio FROM tenders""",
)
PORTAL_KEYS = ["tipo_procedimiento", "caracter", "ramo", "plurianual"]
on_tenders(
    "n9_source_specific_json",
    lambda t: t.select("id", "fuente", backfill.source_specifics().alias("j")).select(
        "id", F.size(F.json_object_keys("j")).alias("n"), *[F.get_json_object("j", f"$.{k}").alias(k) for k in PORTAL_KEYS],
        F.get_json_object("j", "$.titulo_original").alias("titulo_original"), F.get_json_object("j", "$.procesado_parser").alias("procesado_parser"),
        F.get_json_object("j", "$.ocds_data.ocid").alias("ocid"), F.get_json_object("j", "$.items").alias("items"),
    ),
    """SELECT id, CASE id % 4 WHEN 0 THEN 17 WHEN 1 THEN 7 WHEN 2 THEN 6 END AS n,
    CASE WHEN id % 4 = 0 THEN json_extract_string(datos_originales, '$.tipo_procedimiento') END AS tipo_procedimiento,
    CASE WHEN id % 4 = 0 THEN caracter END AS caracter, CASE WHEN id % 4 = 0 THEN json_extract_string(datos_originales, '$.ramo') END AS ramo,
    CAST(NULL AS VARCHAR) AS plurianual, CASE WHEN id % 4 = 1 THEN titulo END AS titulo_original, CASE WHEN id % 4 = 1 THEN 'false' END AS procesado_parser,
    CASE WHEN id % 4 = 2 THEN 'ocds-87sd3t-' || CAST(id AS VARCHAR) END AS ocid,
    CASE WHEN id % 4 = 2 THEN '[{"id":"' || CAST(id AS VARCHAR) || '"}]' END AS items FROM (SELECT * FROM tenders) t""",
)
on_tenders(
    "n10_content_key",
    lambda t: backfill.with_key(t).select("id", "hash_contenido"),
    """SELECT id, CASE WHEN id % 8 = 0 THEN uuid_procedimiento ELSE sha256(numero_procedimiento || '_' || entidad_compradora || '_' || fuente) END AS hash_contenido FROM tenders""",
)
on_tenders(
    "n11_defaults",
    lambda t: backfill.with_defaults(
        t.withColumns({
            "titulo": F.when(F.col("id") % 4 == 0, "").otherwise(F.col("titulo")), "moneda": F.when(F.col("id") % 2 == 0, "").otherwise("USD"),
            "entidad_compradora": F.when(F.col("id") % 3 != 0, F.col("entidad_compradora")), "fuente": F.upper("fuente"),
        })
    ).select("id", "titulo", "entidad_compradora", "moneda", "fuente"),
    """SELECT id, CASE WHEN id % 4 = 0 THEN COALESCE(descripcion, 'Sin título') ELSE titulo END AS titulo,
    CASE WHEN id % 3 <> 0 THEN entidad_compradora ELSE 'No especificada' END AS entidad_compradora, CASE WHEN id % 2 = 0 THEN 'MXN' ELSE 'USD' END AS moneda,
    CASE WHEN fuente = 'ComprasMX' THEN fuente ELSE upper(fuente) END AS fuente FROM tenders""",
)

# --- insert, upsert -----------------------------------------------------------------------------------------------

# The batch names each buyer and number again and again; every fifth order's key is already in the table.
BATCH_NUMBER = "'B-' || CAST(id % 4000 AS VARCHAR)"
BATCH_SOURCE = "CASE WHEN id % 4000 % 3 = 0 THEN 'Tianguis Digital' ELSE 'DOF' END"


def batch(spark, sf):
    t = tenders(spark, sf).withColumns({
        "numero_procedimiento": F.when(F.col("id") % 97 == 0, "").otherwise(F.concat(F.lit("B-"), (F.col("id") % 4000).cast("string"))),
        "entidad_compradora": F.col("estado"), "fuente": F.expr(BATCH_SOURCE),
    })
    return backfill.with_key(t).withColumn("_ord", F.col("id"))


def stored_table(spark, sf):
    t = batch(spark, sf).filter("id % 4000 % 5 = 0 and id % 97 <> 0")
    return conform(t).dropDuplicates(["hash_contenido"])


def insert(spark, sf):
    path = work_dir(spark, "table")
    upsert.append_rows(stored_table(spark, sf), path)
    return upsert.insert_if_absent(batch(spark, sf), path)


STATUS_SQL = f"""SELECT id, {BATCH_SOURCE} AS fuente, CASE WHEN id % 97 = 0 THEN 'rechazado' WHEN en_tabla OR rn > 1 THEN 'duplicado' ELSE 'insertado' END AS estatus FROM (
    SELECT id, id % 4000 % 5 = 0 AS en_tabla, ROW_NUMBER() OVER (PARTITION BY id % 97 = 0, numero, estado ORDER BY id) AS rn
    FROM (SELECT id, estado, {BATCH_NUMBER} AS numero FROM tenders) x) y"""
register("u1_j7_insert_if_absent", lambda spark, sf: insert(spark, sf).select("id", "fuente", "estatus"), STATUS_SQL, "tenders")
register(
    "a39_u8_run_metrics",
    lambda spark, sf: upsert.run_metrics(insert(spark, sf)),
    f"""SELECT f AS fuente, COUNT(*) AS extraidos, COUNT(*) FILTER (WHERE estatus = 'insertado') AS insertados, COUNT(*) FILTER (WHERE estatus = 'duplicado') AS duplicados,
    COUNT(*) FILTER (WHERE estatus = 'error') AS errores, COUNT(*) FILTER (WHERE estatus = 'rechazado') AS rechazados
    FROM (SELECT estatus, unnest([fuente, 'TOTAL']) AS f FROM ({STATUS_SQL}) s) z GROUP BY 1""",
    "tenders",
)


CHAIN = 500  # rows of a chain in which each row shares its hash with one neighbour and its triple with the other


def two_key_batch(spark, sf):
    """Chains of conflicts, each row twice, and rows without hash.

    Row p of a chain has hash (p + 1) // 2 and triple p // 2. So even rows get in and odd rows meet the triple of the row
    before. The copies, which come later, find the hash of the next even row taken, but for the last odd row of a chain.
    """
    t = tenders(spark, sf)
    p, chain = F.col("id") % CHAIN, F.floor(F.col("id") / CHAIN).cast("string")
    first = t.withColumns({
        "numero_procedimiento": F.concat_ws("-", F.lit("N"), chain, F.floor(p / 2).cast("string")), "entidad_compradora": F.lit("E"),
        "fuente": F.lit("ComprasMX"), "hash_contenido": F.concat_ws("-", F.lit("u"), chain, F.floor((p + 1) / 2).cast("string")), "_ord": F.col("id"),
    })
    copies = first.withColumn("_ord", F.col("_ord") + 1_000_000_000)
    keyless = first.filter("id % 97 = 0").withColumns({"hash_contenido": F.lit(None).cast("string"), "_ord": F.col("_ord") + 2_000_000_000})
    return first.unionByName(copies).unionByName(keyless)


register(
    "u1_insert_two_unique_keys",
    lambda spark, sf: upsert.insert_status(two_key_batch(spark, sf), two_key_batch(spark, sf).limit(0)).select(F.col("_ord").alias("orden"), "estatus", "motivo"),
    f"""SELECT id AS orden, CASE WHEN id % {CHAIN} % 2 = 0 THEN 'insertado' ELSE 'error' END AS estatus, NULL AS motivo FROM tenders
    UNION ALL SELECT id + 1000000000, CASE WHEN id % {CHAIN} % 2 = 1 AND (id % {CHAIN} = {CHAIN} - 1 OR id = (SELECT MAX(id) FROM tenders)) THEN 'error' ELSE 'duplicado' END, NULL FROM tenders
    UNION ALL SELECT id + 2000000000, 'rechazado', 'sin hash_contenido' FROM tenders WHERE id % 97 = 0""",
    "tenders",
)


def upserted(spark, sf):
    changed = batch(spark, sf).filter("id % 97 <> 0").withColumns({"municipio": F.concat(F.lit("m"), F.col("id").cast("string")), "titulo": F.concat(F.lit("t"), F.col("id").cast("string"))})
    return upsert.upsert(stored_table(spark, sf).withColumns({"titulo": F.lit("viejo"), "municipio": F.lit("viejo")}), changed)


register(
    "u2_upsert",
    lambda spark, sf: upserted(spark, sf).select("numero_procedimiento", "entidad_compradora", "titulo", "municipio", "operacion", "actualizaciones"),
    f"""SELECT numero AS numero_procedimiento, estado AS entidad_compradora, CASE WHEN en_tabla THEN 'viejo' ELSE 't' || CAST(MIN(id) AS VARCHAR) END AS titulo,
    'm' || CAST(MAX(id) AS VARCHAR) AS municipio, CASE WHEN en_tabla THEN 'actualizada' ELSE 'insertada' END AS operacion,
    COUNT(*) - CASE WHEN en_tabla THEN 0 ELSE 1 END AS actualizaciones
    FROM (SELECT id, estado, {BATCH_NUMBER} AS numero, id % 4000 % 5 = 0 AS en_tabla FROM tenders WHERE id % 97 <> 0) x GROUP BY 1, 2, en_tabla""",
    "tenders",
)
def changed_rows(spark, sf):
    return batch(spark, sf).filter("id % 97 <> 0").withColumns({
        "municipio": F.concat(F.lit("m"), F.col("id").cast("string")), "titulo": F.concat(F.lit("t"), F.col("id").cast("string")),
        "hash_contenido": F.when(F.col("id") % 89 != 0, F.col("hash_contenido")),
    })


def table_to_change(spark, sf):
    path = work_dir(spark, "table")
    others = conform(tenders(spark, sf).filter("fuente <> 'DOF'"))
    upsert.append_rows(stored_table(spark, sf).withColumns({"titulo": F.lit("viejo"), "municipio": F.lit("viejo")}).unionByName(others), path)
    return path


def upserted_table(spark, sf):
    """The same upsert on a stored table: buckets rewritten, rows of other sources and rows without hash left alone."""
    path = table_to_change(spark, sf)
    upsert.upsert_table(changed_rows(spark, sf), path)
    return upsert.read_table(spark, path)


def upserted_in_batches(spark, sf, folded=False):
    """The same again in three batches that are merged when the table is read, or written into it."""
    path, rows = table_to_change(spark, sf), changed_rows(spark, sf)
    last = rows.agg(F.max("id")).first()[0]
    for k in range(3):
        changes.append_upsert(rows.filter((F.col("id") > last * k // 3) & (F.col("id") <= last * (k + 1) // 3)), path)
    if folded:
        changes.fold(spark, path)
    return upsert.read_table(spark, path)


UPSERTED = ["numero_procedimiento", "entidad_compradora", "fuente", "titulo", "municipio"]
UPSERTED_SQL = f"""WITH b AS (SELECT id, estado, {BATCH_SOURCE} AS origen, {BATCH_NUMBER} AS numero, id % 4000 % 5 = 0 AS en_tabla FROM tenders WHERE id % 97 <> 0),
    k AS (SELECT numero, estado, en_tabla, origen, MIN(id) FILTER (WHERE id % 89 <> 0) AS primero, MAX(id) FILTER (WHERE id % 89 <> 0) AS ultimo FROM b GROUP BY 1, 2, 3, 4)
    SELECT numero AS numero_procedimiento, estado AS entidad_compradora, origen AS fuente, CASE WHEN en_tabla THEN 'viejo' ELSE 't' || CAST(primero AS VARCHAR) END AS titulo,
    CASE WHEN ultimo IS NULL THEN 'viejo' ELSE 'm' || CAST(ultimo AS VARCHAR) END AS municipio FROM k WHERE en_tabla OR primero IS NOT NULL
    UNION ALL SELECT numero_procedimiento, entidad_compradora, fuente, titulo, municipio FROM tenders WHERE fuente <> 'DOF'"""
register("u2_upsert_stored_table", lambda spark, sf: upserted_table(spark, sf).select(*UPSERTED), UPSERTED_SQL, "tenders")
register("u2_merge_on_read_three_batches", lambda spark, sf: upserted_in_batches(spark, sf).select(*UPSERTED), UPSERTED_SQL, "tenders")
register("u2_changes_folded", lambda spark, sf: upserted_in_batches(spark, sf, folded=True).select(*UPSERTED), UPSERTED_SQL, "tenders")
register(
    "a28_load_counters",
    lambda spark, sf: quality.success_rate(upsert.upsert_counts(upserted(spark, sf)).withColumn("duplicadas", F.lit(0))),
    f"""SELECT n AS insertadas, total - n AS actualizadas, 0 AS duplicadas, 100.0::DOUBLE AS tasa_exito FROM (SELECT COUNT(*) AS total,
    COUNT(DISTINCT CASE WHEN id % 4000 % 5 <> 0 THEN {BATCH_NUMBER} || estado END) AS n FROM tenders WHERE id % 97 <> 0) x""",
    "tenders",
)


def table_round_trip(spark, sf):
    path = work_dir(spark, "tenders")
    upsert.append_rows(tenders(spark, sf), path)
    return upsert.read_table(spark, path)


register(
    "s17_table_scan_one_source",
    lambda spark, sf: plain(table_round_trip(spark, sf).filter("fuente = 'DOF'").select("numero_procedimiento", "monto_estimado", "fecha_captura", "fuente")),
    """SELECT numero_procedimiento, CAST(monto_estimado AS DOUBLE) AS monto_estimado, strftime(fecha_captura, '%Y-%m-%d %H:%M:%S') AS fecha_captura, fuente
    FROM tenders WHERE fuente = 'DOF'""",
    "tenders",
)


def replaced(spark, sf):
    """One source rewritten, one deleted, the others untouched."""
    path = work_dir(spark, "tenders")
    t = tenders(spark, sf)
    upsert.create_table(spark, path)
    upsert.append_rows(t, path)
    upsert.replace_sources(t.filter("fuente = 'DOF'").withColumn("titulo", F.lit("nuevo")), path)
    upsert.delete_source(spark, path, "SITIOS_MASIVOS")
    return upsert.read_table(spark, path).groupBy("fuente").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("titulo") == "nuevo").alias("nuevos"))


register(
    "u6_u7_replace_and_delete_source",
    replaced,
    "SELECT fuente, COUNT(*) AS n, CASE WHEN fuente = 'DOF' THEN COUNT(*) ELSE 0 END AS nuevos FROM tenders WHERE fuente <> 'SITIOS_MASIVOS' GROUP BY 1",
    "tenders",
)
on_tenders(
    "u6_delete_by_predicate",
    lambda t: upsert.delete_rows(t, F.col("municipio") == "NATION_3").select("id"),
    "SELECT id FROM tenders WHERE municipio IS NULL OR municipio <> 'NATION_3'",
)
register(
    "u3_fill_missing",
    lambda spark, sf: (lambda s: upsert.fill_missing(
        s.drop("titulo_limpio"),
        gazette.parse_stored(s).select("id", F.col("entidad_parseada").alias("entidad_federativa"), F.col("municipio_parseado").alias("municipio"), "resultado"),
    ).select("id", "entidad_federativa", "municipio", F.get_json_object("datos_especificos", "$.nota").alias("nota"), F.get_json_object("datos_especificos", "$.procesado").alias("procesado")))(
        view(spark, sf, "stored")
    ),
    """SELECT id, COALESCE(entidad_federativa, estado_nombre) AS entidad_federativa, municipio_nombre AS municipio, CASE WHEN id % 2 = 0 THEN seg END AS nota, 'true' AS procesado FROM stored""",
    "stored",
)
on_tenders(
    "u4_backfill",
    lambda t: backfill.backfill(t).select(
        "id", "entidad_federativa", "municipio", F.get_json_object("datos_especificos", "$.ramo").alias("ramo"),
        F.get_json_object("datos_especificos", "$.titulo_original").alias("titulo_original"), F.col("datos_especificos").isNotNull().alias("migrada"),
    ),
    """SELECT id, CASE WHEN id % 4 = 0 THEN COALESCE(entidad_federativa, json_extract_string(datos_originales, '$.entidad_federativa_contratacion')) ELSE entidad_federativa END AS entidad_federativa,
    CASE WHEN id % 4 = 0 THEN unidad_compradora ELSE municipio END AS municipio, CASE WHEN id % 4 = 0 AND id % 12 <> 0 THEN json_extract_string(datos_originales, '$.ramo') END AS ramo,
    CASE WHEN id % 12 = 5 THEN titulo END AS titulo_original, id % 4 <> 3 AS migrada FROM tenders""",
)


def patches(t):
    return t.select(
        F.when(F.col("id") % 3 == 0, F.col("numero_procedimiento")).alias("numero_licitacion"), F.col("entidad_compradora").alias("dependencia"),
        F.substring("titulo", 1, 12).alias("objeto_licitacion"), F.col("id").alias("orden"), build(pagina=F.col("id"), fecha_ejemplar=F.lit("2025-08-05")).alias("parche"),
    )


on_tenders(
    "j5_u5_patch_by_number",
    lambda t: joins.patch_by_number(t, patches(t).unionAll(patches(t).withColumn("orden", F.col("orden") - 1_000_000))).select(
        "id", "actualizada", F.get_json_object("datos_originales", "$.pagina").alias("pagina"), F.get_json_object("datos_originales", "$.organismo").alias("organismo")
    ),
    """SELECT id, id % 12 = 9 AS actualizada, CASE WHEN id % 12 = 9 THEN CAST(id AS VARCHAR) END AS pagina, CASE WHEN id % 4 = 1 THEN entidad_compradora END AS organismo FROM tenders""",
)
on_tenders(
    "j6_u5_patch_by_agency_and_object",
    lambda t: joins.patch_by_agency_and_object(t, patches(t)).select("id", "actualizada", F.get_json_object("datos_originales", "$.pagina").alias("pagina")),
    """WITH p AS (SELECT entidad_compradora AS dep, substr(titulo, 1, 12) AS obj, MAX(id) AS orden FROM tenders WHERE id % 3 <> 0 GROUP BY 1, 2),
    best AS (SELECT t.id, MAX(p.orden) AS orden FROM tenders t JOIN p ON p.dep = t.entidad_compradora AND contains(t.titulo, p.obj) WHERE t.fuente = 'DOF' GROUP BY 1)
    SELECT id, orden IS NOT NULL AS actualizada, CAST(orden AS VARCHAR) AS pagina FROM tenders LEFT JOIN best USING (id)""",
)

# --- reports on stored rows ---------------------------------------------------------------------------------------

on_tenders(
    "a27_migration_statistics",
    quality.migration_statistics,
    """SELECT COUNT(*) AS total_registros, COUNT(datos_originales) AS con_datos_originales, COUNT(datos_especificos) AS con_datos_especificos,
    COUNT(*) FILTER (WHERE fuente = 'ComprasMX' AND entidad_federativa IS NOT NULL) AS comprasmx_con_estado, COUNT(*) FILTER (WHERE fuente = 'DOF') AS total_dof,
    COUNT(*) FILTER (WHERE id % 12 = 9) AS dof_pendientes FROM tenders""",
)
on_tenders(
    "a27_migration_by_source",
    quality.migration_by_source,
    "SELECT fuente, COUNT(*) AS total, COUNT(datos_especificos) AS migrados, COUNT(entidad_federativa) AS con_estado FROM tenders GROUP BY 1",
)
on_tenders(
    "a27_integrity",
    quality.integrity,
    "SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE datos_originales IS NOT NULL AND datos_especificos IS NULL) AS sin_migrar FROM tenders",
)
on_tenders(
    "u_3_not_migrated",
    lambda t: quality.not_migrated(t).select("id"),
    "SELECT id FROM tenders WHERE datos_originales IS NOT NULL AND datos_especificos IS NULL",
)


def tenth(part, whole="COUNT(*)"):
    return f"CAST(({part} * 2000 + {whole}) // (2 * {whole}) AS DOUBLE) / 10"


on_tenders(
    "a28_load_report",
    quality.load_report,
    f"""SELECT COUNT(*) AS total, COUNT(DISTINCT entidad_federativa) AS entidades, COUNT(DISTINCT municipio) AS municipios, COUNT(entidad_federativa) AS con_entidad,
    COUNT(municipio) AS con_municipio, {tenth('COUNT(entidad_federativa)')} AS porcentaje_entidad, {tenth('COUNT(municipio)')} AS porcentaje_municipio
    FROM tenders WHERE fuente = 'DOF'""",
)
on_tenders(
    "a28_load_top_states",
    quality.load_top_states,
    "SELECT entidad_federativa, COUNT(*) AS cantidad FROM tenders WHERE fuente = 'DOF' AND entidad_federativa IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
)
on_tenders(
    "a29_parse_progress",
    quality.parse_progress,
    """SELECT COUNT(*) AS total_dof, COUNT(entidad_federativa) AS con_estado, COUNT(municipio) AS con_municipio, COUNT(*) FILTER (WHERE id % 12 = 9) AS procesadas,
    COUNT(entidad_federativa) * 100 // COUNT(*) AS porcentaje_estado, COUNT(municipio) * 100 // COUNT(*) AS porcentaje_municipio FROM tenders WHERE fuente = 'DOF'""",
)
on_tenders(
    "a41_capture_coverage",
    lambda t: quality.capture_coverage(
        t.select(F.concat(F.lit("E-"), (F.col("id") % 700).cast("string")).alias("cod_expediente"), F.col("uuid_procedimiento").alias("hash_uuid_real")), F.lit(1000)
    ),
    """SELECT COUNT(DISTINCT id % 700) AS total_expedientes_capturados, COUNT(uuid_procedimiento) AS expedientes_con_hash_real,
    CAST(COUNT(uuid_procedimiento) AS DOUBLE) / COUNT(*) * 100 AS porcentaje_hash_real, CAST(COUNT(DISTINCT id % 700) AS DOUBLE) / 1000 * 100 AS cobertura_sistema FROM tenders""",
)
on_tenders(
    "a43_field_profile",
    # members of objects come in another order on the checking engine, so only examples of texts are compared
    lambda t: quality.field_profile(t).withColumn("ejemplo", F.when(F.col("tipos") == "STRING", F.col("ejemplo"))),
    """SELECT fuente, campo, COUNT(*) AS registros, COUNT(*) AS con_valor, CASE WHEN campo = 'tender' THEN 'OBJECT' ELSE 'STRING' END AS tipos,
    CASE WHEN campo <> 'tender' THEN MIN(json_extract_string(datos_originales, '$."' || campo || '"')) END AS ejemplo FROM (
    SELECT fuente, datos_originales, unnest(json_keys(datos_originales)) AS campo FROM tenders WHERE datos_originales IS NOT NULL) x GROUP BY 1, 2""",
)
register(
    "a43_field_profile_of_events",
    lambda spark, sf: quality.field_profile(table(spark, sf, "events"), "event_type", "props"),
    """SELECT event_type, 'k' AS campo, COUNT(*) AS registros, COUNT(*) AS con_valor, 'BIGINT' AS tipos, MIN(json_extract_string(props, '$.k')) AS ejemplo FROM events GROUP BY 1""",
)
on_tenders(
    "s19_schema_check",
    lambda t: quality.schema_check(t),
    " UNION ALL ".join(
        f"SELECT '{f.name}' AS columna, '{f.dataType.simpleString()}' AS esperado, "
        + ("NULL AS actual, false AS ok, COUNT(NULL) AS con_valor FROM tenders" if f.name == "hash_contenido" else f"'{f.dataType.simpleString()}' AS actual, true AS ok, COUNT({f.name}) AS con_valor FROM tenders")
        for f in TENDER
    ),
)


def statistics_round_trip(spark, sf):
    from pregonero.sources import sinks

    path = work_dir(spark, "stats")
    t = tenders(spark, sf)
    sinks.write_with_statistics(t.select("id", "fuente"), quality.integrity(t), path)
    rows = spark.read.json(f"{path}/licitaciones").agg(F.count(F.lit(1)).alias("filas"), F.sum("id").alias("suma"))
    return rows.crossJoin(spark.read.json(f"{path}/estadisticas"))


register(
    "s15_rows_with_statistics",
    statistics_round_trip,
    """SELECT COUNT(*) AS filas, CAST(SUM(id) AS BIGINT) AS suma, COUNT(*) AS total,
    COUNT(*) FILTER (WHERE datos_originales IS NOT NULL AND datos_especificos IS NULL) AS sin_migrar FROM tenders""",
    "tenders",
)

# --- streams ------------------------------------------------------------------------------------------------------


def landing(spark, sf):
    """Portal records as JSON lines in a landing folder, several files."""
    path = work_dir(spark, "landing")
    view(spark, sf, "portal").select(F.col("rec").alias("value")).write.text(path)
    return path


def streamed(spark, sf, files_per_trigger=1000, every_seconds=None):
    out = work_dir(spark, "stream")
    upsert.create_table(spark, f"{out}/table")
    lines = ingest.landing_stream(spark, landing(spark, sf), "value string", "text", files_per_trigger)

    def normalise(batch):
        recs = batch.select(F.lit("landing").alias("file_name"), F.lit(0).alias("pos"), F.try_parse_json("value").alias("rec"))
        return backfill.finish(portal.normalise(recs))

    running = ingest.ingest(normalise(lines), None, f"{out}/table", f"{out}/checkpoint", ["numero_procedimiento"], every_seconds)
    if every_seconds:  # goes on until it is stopped
        running.processAllAvailable()
        running.stop()
    else:
        running.awaitTermination()
    return upsert.read_table(spark, f"{out}/table")


INGESTED = (
    """SELECT DISTINCT CASE WHEN k % 4 = 0 THEN 'u-' || CAST(k % 3000 AS VARCHAR) ELSE sha256(CASE WHEN k % 10 = 0 THEN 'E-' ELSE 'LA-' END || CAST(k AS VARCHAR) || '_'
    || CASE WHEN k % 5 = 0 THEN nation ELSE region END || '_ComprasMX') END AS hash_contenido, 'ComprasMX' AS fuente FROM portal"""
)
register("t1_incremental_ingest", lambda spark, sf: streamed(spark, sf, 3).select("hash_contenido", "fuente"), INGESTED, "portal")
register("t2_ingest_every_second", lambda spark, sf: streamed(spark, sf, 4, every_seconds=1).select("hash_contenido", "fuente"), INGESTED, "portal")
register(
    "a39_run_metrics_with_rejects",
    lambda spark, sf: upsert.run_metrics(insert(spark, sf), rejects.line_rejects(
        view(spark, sf, "site_lines").select(F.lit("a.jsonl").alias("file_name"), F.col("line").alias("value")))),
    f"""SELECT f AS fuente, COUNT(*) AS extraidos, COUNT(*) FILTER (WHERE estatus = 'insertado') AS insertados, COUNT(*) FILTER (WHERE estatus = 'duplicado') AS duplicados,
    COUNT(*) FILTER (WHERE estatus = 'error') AS errores, COUNT(*) FILTER (WHERE estatus = 'rechazado') AS rechazados
    FROM (SELECT estatus, unnest([fuente, 'TOTAL']) AS f FROM ({STATUS_SQL}) s
    UNION ALL SELECT 'rechazado', unnest(['SITIOS_MASIVOS', 'TOTAL']) FROM site_lines WHERE k % 50 = 48) z GROUP BY 1""",
    "tenders", "site_lines",
)
on_tenders(
    "t4_history_from_date",
    lambda t: ingest.history(t, "2000-01-01").select("id"),
    "SELECT id FROM tenders WHERE fecha_publicacion >= DATE '2000-01-01'",
)


def event_stream(spark, sf, batches=1):
    """The events as a stream; with several batches, of as many files, one file a batch."""
    events = table(spark, sf, "events")
    if batches == 1:
        stream = ingest.landing_stream(spark, sf, events.schema, "parquet", pathGlobFilter="events.parquet")
    else:
        path = work_dir(spark, "events")
        events.repartitionByRange(batches, "ts").write.parquet(path)
        stream = ingest.landing_stream(spark, path, events.schema, "parquet", 1)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def run_to_folder(df, mode):
    """Runs a stream over all that is there. Every batch writes a folder of its own, so a repeated batch replaces itself;
    in complete mode the last batch holds the whole result, otherwise all batches together do."""
    spark = df.sparkSession
    out = work_dir(spark, "stream")

    def keep(batch, n):
        batch.write.mode("overwrite").parquet(f"{out}/rows/lote={n}")

    df.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{out}/rows")
    if mode == "complete":
        rows = rows.join(rows.agg(F.max("lote").alias("lote")), "lote")
    return rows.drop("lote")


def live(spark, sf):
    counts = run_to_folder(ingest.live_counts(event_stream(spark, sf), "ts", "event_type"), "complete")
    return counts.select(stamp("desde"), stamp("hasta"), "event_type", "cantidad")


LIVE = """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS desde, strftime(date_trunc('day', ts) + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS hasta,
    event_type, COUNT(*) AS cantidad FROM events GROUP BY ALL"""
register("t8_live_counts_stream", live, LIVE)
register(
    "t8_live_counts_batch",
    lambda spark, sf: ingest.live_counts(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type").select(
        stamp("desde"), stamp("hasta"), "event_type", "cantidad"
    ),
    LIVE,
)
register(
    "t3_overlap_dedup",
    lambda spark, sf: run_to_folder(
        ingest.overlap_dedup(event_stream(spark, sf, 4).withColumn("clave", F.concat_ws("-", "user_id", "event_type")), "clave", "ts", "60 days"), "append"
    ).select("clave"),
    "SELECT DISTINCT CAST(user_id AS VARCHAR) || '-' || event_type AS clave FROM events",
)
register(
    "n_batch_of_sources",
    lambda spark, sf: backfill.finish(
        portal.normalise(view(spark, sf, "portal").select(F.lit("a").alias("file_name"), F.col("k").alias("pos"), F.parse_json("rec").alias("rec")))
    ).groupBy("fuente", "entidad_federativa").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("hash_contenido").alias("claves")),
    """SELECT 'ComprasMX' AS fuente, region AS entidad_federativa, COUNT(*) AS n, COUNT(DISTINCT CASE WHEN k % 4 = 0 THEN 'u-' || CAST(k % 3000 AS VARCHAR) ELSE CAST(k AS VARCHAR) END) AS claves
    FROM portal GROUP BY 2""",
    "portal",
)
