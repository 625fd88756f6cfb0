"""Procurement-shaped inputs derived from the test tables.

Each input is one SQL text that runs on Spark and on the checking engine, so both sides start from the same rows.
The texts only compose values (joins, CASE, ||); reading them back is the work of the operators. Missing values,
spelling variants and date forms are brought in by remainders of the order key; every row of the tables is used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pregonero.session import work_dir

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]
AS_OF = "2001-08-01"


def two(expr: str) -> str:
    return f"LPAD(CAST({expr} AS STRING), 2, '0')"


def slash(d: str) -> str:
    """dd/mm/yyyy"""
    return f"({two(f'day({d})')} || '/' || {two(f'month({d})')} || '/' || CAST(year({d}) AS STRING))"


def iso(d: str) -> str:
    return f"(CAST(year({d}) AS STRING) || '-' || {two(f'month({d})')} || '-' || {two(f'day({d})')})"


def compact(d: str) -> str:
    """ddmmyyyy"""
    return f"({two(f'day({d})')} || {two(f'month({d})')} || CAST(year({d}) AS STRING))"


MONTHS = ["enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre",
          "noviembre", "diciembre"]
SHORT = ["Ene", "Feb", "Mar", "Abr", "May", "Jun", "Jul", "Ago", "Sep", "Oct", "Nov", "Dic"]


def month_name(d: str, names: list[str] = MONTHS) -> str:
    return f"(CASE month({d}) " + " ".join(f"WHEN {i + 1} THEN '{m}'" for i, m in enumerate(names)) + " END)"


def worded(d: str) -> str:
    """d de mes de yyyy"""
    return f"(CAST(day({d}) AS STRING) || ' de ' || {month_name(d)} || ' de ' || CAST(year({d}) AS STRING))"


def plus(d: str, n: str) -> str:
    return f"CAST({d} + CAST({n} AS INT) AS DATE)"


# State as printed in a notice, and as stored. Printed forms vary in accents and short forms on purpose.
STATES = [
    ("Aguascalientes", "Aguascalientes"), ("Baja California Sur", "Baja California Sur"),
    ("Baja California", "Baja California"), ("Michoacán", "Michoacán"), ("Nuevo León", "Nuevo León"),
    ("Ciudad de México", "Ciudad de México"), ("Estado de México", "Estado de México"),
    ("San Luis Potosi", "San Luis Potosí"), ("VERACRUZ DE IGNACIO DE LA LLAVE", "Veracruz"),
    ("CDMX", "Ciudad de México"), ("Querétaro", "Querétaro"), ("Yucatán", "Yucatán"), ("Oaxaca", "Oaxaca"),
    ("PUEBLA", "Puebla"), ("Sonora", "Sonora"), ("Coahuila de Zaragoza", "Coahuila"), ("Quintana Roo", "Quintana Roo"),
    ("Tlaxcala", "Tlaxcala"), ("Zacatecas", "Zacatecas"), ("Jalisco", "Jalisco"), ("Nayarit", "Nayarit"),
    ("EDOMEX", "Estado de México"), ("Chiapas", "Chiapas"), ("Tabasco", "Tabasco"), ("Sinaloa", "Sinaloa"),
]
TOWNS = ["SAN PEDRO", "Villa Juárez", "río verde", "Santa Ana", "el Fuerte"]
TITLED_TOWNS = ["San Pedro", "Villa Juárez", "Río Verde", "Santa Ana", "El Fuerte"]


def pick(expr: str, values: list[str], size: int | None = None) -> str:
    return f"(CASE {expr} % {size or len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END)"


def seconds_after(dialect: str, ts: str, n: str) -> str:
    return f"timestampadd(SECOND, CAST({n} AS INT), {ts})" if dialect == "spark" else f"({ts} + to_seconds(CAST({n} AS INT)))"


def text_agg(dialect: str, expr: str, order: str, sep: str = "''") -> str:
    if dialect == "spark":
        return f"listagg({expr}, {sep}) WITHIN GROUP (ORDER BY {order})"
    return f"string_agg({expr}, {sep} ORDER BY {order})"


def _orders(_: str) -> str:
    return """
SELECT o.o_orderkey AS k, CAST(o.o_orderdate AS DATE) AS d, o.o_orderdate AS ts, o.o_orderstatus AS status,
  o.o_orderpriority AS prio, CAST(o.o_totalprice AS DECIMAL(15,2)) AS price, c.c_custkey AS ck, c.c_name AS buyer,
  c.c_mktsegment AS seg, n.n_nationkey AS nk, n.n_name AS nation, r.r_name AS region
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey"""


def _tenders(dialect: str) -> str:
    captured = seconds_after(dialect, "ts", "k % 86400")
    if dialect == "spark":
        captured = f"CAST({captured} AS TIMESTAMP)"
    return f"""
SELECT k AS id,
  CASE k % 3 WHEN 0 THEN 'LA-' WHEN 1 THEN 'IA-' ELSE 'AD-' END || CAST(k AS STRING) AS numero_procedimiento,
  seg || ' ' || prio AS titulo,
  CASE WHEN k % 6 = 0 THEN NULL ELSE 'Suministro ' || buyer || ' ' || prio END AS descripcion,
  buyer AS entidad_compradora, nation AS unidad_compradora,
  CASE WHEN k % 11 = 0 THEN NULL ELSE prio END AS tipo_procedimiento,
  CASE WHEN k % 13 = 0 THEN NULL ELSE seg END AS tipo_contratacion,
  status AS estado,
  CASE WHEN k % 7 = 0 THEN NULL ELSE region END AS entidad_federativa,
  CASE WHEN k % 5 = 0 THEN NULL ELSE nation END AS municipio,
  d AS fecha_publicacion,
  CASE WHEN k % 4 = 0 THEN NULL ELSE {plus('d', '15')} END AS fecha_apertura,
  CASE WHEN k % 5 = 1 THEN NULL ELSE {plus('d', '30')} END AS fecha_fallo,
  CASE WHEN k % 3 = 1 THEN NULL ELSE {plus('d', '7')} END AS fecha_junta_aclaraciones,
  CASE WHEN k % 9 = 0 THEN NULL ELSE price END AS monto_estimado,
  'MXN' AS moneda, CAST(NULL AS STRING) AS proveedor_ganador,
  CASE WHEN k % 10 = 0 THEN 'INTERNACIONAL' END AS caracter,
  CASE WHEN k % 8 = 0 THEN 'uuid-' || CAST(k AS STRING) END AS uuid_procedimiento,
  CASE k % 4 WHEN 0 THEN 'ComprasMX' WHEN 1 THEN 'DOF' WHEN 2 THEN 'Tianguis Digital' ELSE 'SITIOS_MASIVOS' END AS fuente,
  CASE WHEN k % 12 = 1 THEN 'https://sitio.example/dof/' || {compact('d')} || '-MAT.pdf'
       WHEN k % 12 = 5 THEN 'https://dof.gob.mx/nota/' || CAST(k AS STRING)
       WHEN k % 12 = 9 THEN NULL ELSE 'https://sitio.example/' || CAST(k AS STRING) END AS url_original,
  {captured} AS fecha_captura,
  CASE k % 4
    WHEN 0 THEN '{{"cod_expediente":"E-' || CAST(k AS STRING) || '","entidad_federativa_contratacion":"' || region
      || '","municipio":"' || nation || '","tipo_procedimiento":"' || prio || '","ramo":"' || seg || '"}}'
    WHEN 1 THEN '{{"fecha_ejemplar":"' || CASE WHEN k % 3 = 0 THEN {iso('d')} || 'T00:00:00' ELSE '' END
      || '","seccion":"' || seg || '","organismo":"' || buyer || '"}}'
    WHEN 2 THEN '{{"ocid":"ocds-87sd3t-' || CAST(k AS STRING) || '","tender":{{"classification":"' || seg
      || '","procuringEntity":{{"address":{{"region":"' || region || '","locality":"' || nation
      || '"}}}},"items":[{{"id":"' || CAST(k AS STRING) || '"}}]}}}}'
    ELSE NULL END AS datos_originales,
  CASE WHEN k % 12 = 0 THEN '{{"detalle_individual":{{"descripcion_completa":"' || prio || '"}}}}'
       WHEN k % 12 = 9 THEN '{{"procesado":true,"procesado_parser":false}}'
       WHEN k % 12 = 1 THEN '{{"procesado":false}}'
       ELSE NULL END AS datos_especificos
FROM src"""


def _notices(_: str) -> str:
    """One gazette notice per order: the values and the text made of them."""
    number = "'LO-' || LPAD(CAST(100 + k % 900 AS STRING), 3, '0') || '-JZL-' || LPAD(CAST(k % 10000 AS STRING), 4, '0') || '-N-' || CAST(k AS STRING) || '-' || CAST(year(d) AS STRING)"
    return f"""
SELECT k, d, seg, nk, buyer, prio,
  '01' || {two('month(d)')} || CAST(year(d) AS STRING) || CASE WHEN k % 2 = 0 THEN '_MAT' ELSE '_VES' END AS archivo,
  CAST(10 + floor(k / 640) AS INT) AS pagina_aprox,
  CASE WHEN k % 8 = 0 THEN NULL ELSE {number} END AS numero,
  CASE WHEN k % 8 = 0 THEN 'Sin clave' WHEN k % 5 = 1
    THEN 'Licitación Pública Nacional Electrónica No. lo - ' || LPAD(CAST(100 + k % 900 AS STRING), 3, '0') || ' -JZL -- '
      || LPAD(CAST(k % 10000 AS STRING), 4, '0') || '-N-' || CAST(k AS STRING) || '-' || CAST(year(d) AS STRING)
    ELSE 'Licitación Pública Internacional Abierta ' || {number} END AS linea_numero,
  CASE k % 6 WHEN 0 THEN 'SECRETARIA DE ' || seg WHEN 1 THEN 'INSTITUTO FEDERAL DE ' || seg
    WHEN 2 THEN 'COMISION DE ' || seg WHEN 3 THEN 'HOSPITAL GENERAL DE ' || seg
    WHEN 4 THEN 'SECRETARÍA DE ' || seg ELSE NULL END AS dependencia,
  CASE k % 3 WHEN 0 THEN 'DIRECCION GENERAL DE RECURSOS' WHEN 1 THEN 'Subdirección de compras' ELSE 'INSTITUTO DE VIVIENDA' END AS segunda,
  CASE k % 4 WHEN 0 THEN 'Construcción de obra vial y pavimentación' WHEN 1 THEN 'Servicio de limpieza y vigilancia'
    WHEN 2 THEN 'Adquisición de equipo e insumos' ELSE 'Concesión de espacios' END || ' para ' || lower(seg) AS objeto,
  CAST(10 + k % 990 AS STRING) AS cantidad,
  k % 5 AS forma, {plus('d', '7')} AS d_junta, {plus('d', '15')} AS d_apertura, {plus('d', '30')} AS d_fallo,
  {pick('nk', [a for a, _ in STATES])} AS estado_texto, {pick('nk', [b for _, b in STATES])} AS estado_nombre,
  {pick('k', TOWNS)} AS municipio_texto, {pick('k', TITLED_TOWNS)} AS municipio_nombre,
  CAST(500000 + k AS STRING) AS referencia
FROM src"""


def _blocks(_: str) -> str:
    nl = "chr(10)"
    return f"""
SELECT *, COALESCE(dependencia, 'Convocante sin nombre') || {nl} || segunda || {nl} || 'Resumen' || {nl} || linea_numero || {nl}
  || 'Objeto de la licitación: ' || objeto || CASE WHEN k % 3 = 0 THEN ' Los detalles se determinan en la convocatoria' ELSE '' END || {nl}
  || {nl} || CASE WHEN k % 4 = 3 THEN '' ELSE 'Volumen a adquirir: ' || cantidad || ' piezas para ' || lower(seg) || {nl} END
  || 'Fecha de publicación en Compras MX: ' || CASE WHEN k % 2 = 0 THEN {slash('d')} ELSE {worded('d')} END || {nl}
  || 'Junta de aclaraciones: ' || {slash('d_junta')} || CASE WHEN k % 3 = 0 THEN ', a las 10:30' ELSE '' END || {nl}
  || 'Visita a las instalaciones: ' || CASE WHEN k % 4 = 0 THEN 'No habrá' ELSE {slash('d_junta')} || ' 09:00' END || {nl}
  || CASE WHEN k % 6 = 5 THEN '' ELSE 'Presentación y apertura de proposiciones: ' || {worded('d_apertura')} || {nl} END
  || 'Fallo: ' || CASE WHEN k % 7 = 0 THEN '31/02/' || CAST(year(d) AS STRING) ELSE {slash('d_fallo')} END || {nl}
  || CASE WHEN k % 9 = 0 THEN 'La reducción de plazos fue autorizada por el Titular de ' || seg || ', con esta fecha' || {nl} ELSE '' END
  || 'Los trabajos se harán en el municipio de ' || municipio_texto || ', ' || estado_texto || '.' || {nl}
  || CASE WHEN k % 5 = 2 THEN 'Ubicado en Avenida Central ' || cantidad || ', Colonia Centro.' || {nl} ELSE '' END
  || 'ATENTAMENTE' || {nl} || 'EL DIRECTOR DE ' || seg || {nl} || '(R.- ' || referencia || ')' AS texto
FROM notices"""


def _gazette_pages(dialect: str) -> str:
    """Editions by month: an index page, call pages with up to a handful of notices each, and a closing page."""
    nl = "chr(10)"
    return f"""
SELECT archivo, pagina_aprox AS pagina,
  CASE WHEN pagina_aprox = 10 AND substr(archivo, 4, 1) IN ('3','6','9') THEN 'CONVOCATORIAS PARA CONCURSOS DE OBRA' || {nl} ELSE '' END
  || {text_agg(dialect, 'texto', 'k', "chr(10)")} AS contenido
FROM blocks GROUP BY archivo, pagina_aprox
UNION ALL
SELECT archivo, 2 AS pagina,
  'INDICE' || {nl} || CASE
    WHEN substr(archivo, 4, 1) IN ('3','6','9') THEN 'PODER EJECUTIVO ..... 3'
    WHEN substr(archivo, 4, 1) IN ('2','5','8') THEN 'CONVOCATORIAS PARA CONCURSOS DE ADQUISICIONES, OBRAS Y SERVICIOS ..... 10'
    ELSE 'CONVOCATORIAS PARA CONCURSOS DE ADQUISICIONES, OBRAS Y SERVICIOS ..... 10' || {nl} || 'AVISOS' || {nl}
      || 'JUDICIALES Y GENERALES ..... ' || CAST(MAX(pagina_aprox) + 1 AS STRING) END AS contenido
FROM blocks GROUP BY archivo
UNION ALL
SELECT archivo, MAX(pagina_aprox) + 1 AS pagina, 'AVISOS' || {nl} || 'Edicto del juzgado primero.' AS contenido
FROM blocks GROUP BY archivo"""


def _portal(dialect: str) -> str:
    """One portal record per order as JSON text; dates and amounts in all their written forms."""
    return f"""
SELECT k, d, seg, price, prio, buyer, nation, region, status,
  '{{"cod_expediente":"E-' || CAST(k AS STRING) || '"'
  || CASE WHEN k % 10 = 0 THEN ',"numero_procedimiento":""' ELSE ',"numero_procedimiento":"LA-' || CAST(k AS STRING) || '"' END
  || CASE WHEN k % 4 = 0 THEN ',"uuid_procedimiento":"u-' || CAST(k % 3000 AS STRING) || '"' ELSE '' END
  || ',"nombre_procedimiento":"' || CASE WHEN k % 17 = 0 THEN '' ELSE 'Contrato ' || seg END || '","titulo":"' || prio || '"'
  || CASE WHEN k % 3 = 0 THEN ',"descripcion":"' || buyer || '"' ELSE ',"descripcion_detallada":"Obra ' || buyer || '","descripcion":"x"' END
  || CASE WHEN k % 5 = 0 THEN ',"siglas":null,"entidad_compradora":"' || nation || '"' ELSE ',"siglas":"' || region || '"' END
  || ',"tipo_procedimiento":"' || {pick('k', ['Licitación Pública', 'INVITACIÓN A TRES', 'Adjudicación directa', 'otro'])} || '"'
  || ',"tipo_contratacion":"' || {pick('k', ['Servicios', 'OBRA PUBLICA', 'Adquisiciones', ''])} || '"'
  || ',"estatus_alterno":"' || {pick('k', ['', 'Concluido', 'CANCELADO', 'desierto', 'Publicado'])} || '","estado":"CERRADO"'
  || ',"fecha_publicacion":"' || CASE k % 5 WHEN 0 THEN {iso('d')} || 'T10:20:30Z' WHEN 1 THEN {slash('d')} || ' 09:15'
      WHEN 2 THEN {iso('d')} WHEN 3 THEN '-' ELSE '31/02/2025' END || '"'
  || ',"fecha_apertura":"' || {iso('d')} || ' 12:00"'
  || CASE k % 4 WHEN 0 THEN ',"monto_estimado":' || CAST(price AS STRING)
      WHEN 1 THEN ',"monto_estimado":"$ ' || CAST(price AS STRING) || '"'
      WHEN 2 THEN ',"monto_estimado":0,"presupuesto_estimado":"1,234.50"'
      ELSE ',"monto_estimado":"por definir"' END
  || CASE WHEN k % 6 = 0 THEN ',"url_original":"https://sitio.example/' || CAST(k AS STRING) || '"' ELSE '' END
  || ',"entidad_federativa_contratacion":"' || region || '","ramo":"' || seg || '"}}' AS rec
FROM src"""


def _portal_files(dialect: str) -> str:
    """Portal documents in all envelopes, up to a few hundred records each."""
    body = text_agg(dialect, "rec", "k", "','")
    return f"""
SELECT CASE kind WHEN 5 THEN 'todos_expedientes_' WHEN 6 THEN 'resumen_' ELSE 'captura_' END || LPAD(CAST(chunk AS STRING), 9, '0') || '.json' AS file_name,
  CASE kind WHEN 0 THEN '[' || body || ']' WHEN 1 THEN '{{"data":[{{"registros":[' || body || ']}}]}}'
    WHEN 2 THEN '{{"data":[' || body || ']}}' WHEN 3 THEN '{{"registros":[' || body || '],"otro":1}}'
    WHEN 4 THEN '{{"licitaciones":[' || body || ']}}'
    WHEN 5 THEN '{{"total_expedientes":' || CAST(n AS STRING) || ',"expedientes":[' || body || ']}}'
    ELSE '{{"total_expedientes_capturados":' || CAST(n AS STRING) || ',"expedientes":[' || body || ']}}' END AS text
FROM (SELECT CAST(floor(k / 100) AS BIGINT) AS chunk, CAST(floor(k / 100) AS BIGINT) % 7 AS kind, COUNT(*) AS n, {body} AS body
  FROM portal GROUP BY CAST(floor(k / 100) AS BIGINT)) x"""


def _portal_details(dialect: str) -> str:
    """Detail documents: for every second order by case code, for every tenth by number; some come twice."""
    return f"""
SELECT k, 0 AS copia, 'detalle_' || CAST(k AS STRING) || '_a.json' AS file_name,
  '{{"codigo_expediente":"' || CASE WHEN k % 10 = 1 THEN 'LA-' ELSE 'E-' END || CAST(k AS STRING)
  || '","url_completa_con_hash":"https://portal.example/#/' || CAST(k AS STRING) || '","procesado_exitosamente":true,'
  || '"informacion_extraida":{{"descripcion_completa":"' || CASE WHEN k % 3 = 0 THEN 'x' ELSE 'Descripcion completa de la obra ' || buyer END
  || '","entidad_federativa":"' || region || '","requisitos":["' || seg || '"]}}}}' AS text
FROM src WHERE k % 2 = 0 OR k % 10 = 1
UNION ALL
SELECT k, 1 AS copia, 'detalle_' || CAST(k AS STRING) || '_b.json' AS file_name,
  '{{"codigo_expediente":"E-' || CAST(k AS STRING) || '","url_completa_con_hash":"https://portal.example/nuevo/' || CAST(k AS STRING)
  || '","informacion_extraida":{{"descripcion_completa":"corta"}}}}' AS text
FROM src WHERE k % 20 = 0"""


def _ocds(_: str) -> str:
    """One open-contracting CSV row per order; cells are plain, JSON, 'null' or empty."""
    return f"""
SELECT k, d, seg, price, buyer, prio, nation,
  'ocds-87sd3t-' || CAST(k AS STRING) AS ocid, CAST(k * 10 AS STRING) AS id,
  CASE k % 4 WHEN 0 THEN {iso('d')} || 'T00:00:00' WHEN 1 THEN {iso('d')} WHEN 2 THEN {slash('d')} ELSE 'fecha de publicacion' END AS date,
  CASE k % 5 WHEN 0 THEN '{{"name":"' || buyer || '","id":"7"}}' WHEN 1 THEN '[{{"id":"9","name":"' || buyer || '"}}]'
    WHEN 2 THEN 'null' WHEN 3 THEN buyer ELSE buyer END AS buyer_name,
  CASE k % 3 WHEN 0 THEN CAST(k AS STRING) WHEN 1 THEN '' ELSE 'T-' || CAST(k AS STRING) END AS tender_id,
  CASE WHEN k % 6 = 0 THEN '' ELSE {pick('k', ['Servicio de limpieza', 'Obra vial', 'Compra de papel'])} END AS tender_title,
  CASE WHEN k % 4 = 0 THEN 'null' ELSE 'Mantenimiento ' || seg END AS tender_description,
  {pick('k', ['open', 'Selective', 'limited', '', 'direct'])} AS tender_method,
  {pick('k', ['goods', 'works', 'services', ''])} AS tender_category,
  {iso('d')} || 'T09:00:00Z' AS tender_start,
  CASE k % 3 WHEN 0 THEN CAST(price AS STRING) WHEN 1 THEN '$ ' || CAST(price AS STRING) || ' MXN' ELSE '' END AS tender_amount,
  CASE WHEN k % 7 = 0 THEN 'P-' || CAST(k AS STRING) ELSE '' END AS project_id,
  'Presupuesto ' || seg AS budget_description,
  CASE WHEN k % 2 = 0 THEN '{{"amount":' || CAST(price AS STRING) || ',"currency":"MXN"}}' ELSE '' END AS budget_amount
FROM src"""


def _releases(_: str) -> str:
    """One open-contracting release per order as JSON text."""
    return f"""
SELECT k, d, seg, price, buyer, prio,
  '{{"ocid":"' || CASE WHEN k % 9 = 0 THEN '' ELSE 'ocds-87sd3t-' || CAST(k AS STRING) END || '","id":"R' || CAST(k AS STRING) || '"'
  || ',"date":"' || {iso('d')} || CASE WHEN k % 2 = 0 THEN 'T00:00:00.000Z' ELSE '' END || '"'
  || ',"buyer":' || CASE k % 3 WHEN 0 THEN '"' || buyer || '"' WHEN 1 THEN '{{"name":"' || buyer || '"}}' ELSE '{{}}' END
  || ',"planning":{{"budget":{{"amount":' || CASE k % 4 WHEN 0 THEN CAST(price AS STRING)
      WHEN 1 THEN '{{"amount":' || CAST(price AS STRING) || ',"currency":"USD"}}' WHEN 2 THEN '{{"amount":0}}' ELSE 'null' END
  || ',"project":"' || seg || '"}}}}'
  || ',"tender":{{' || CASE WHEN k % 5 = 0 THEN '' ELSE '"title":"Compra ' || seg || '",' END || '"description":"' || prio || '"'
  || ',"procurementMethod":"' || {pick('k', ['open', 'selective', 'limited', 'Open'])} || '"'
  || ',"mainProcurementCategory":"' || {pick('k', ['Goods', 'works', 'services'])} || '"'
  || ',"status":"' || {pick('k', ['active', 'complete', 'cancelled', 'Planning', 'unsuccessful'])} || '"'
  || ',"value":{{"amount":' || CAST(k AS STRING) || ',"currency":"MXN"}}'
  || ',"tenderPeriod":{{"startDate":"' || {iso('d')} || 'T09:00:00Z"}}}}}}' AS rec
FROM src"""


def _site_lines(_: str) -> str:
    """JSON lines of local sites in both member sets, with blank and broken lines between them."""
    amount = pick("k", ["$1,234,567.50", "1234,5", "1,234", "", "abc", "$ 987.6 MXN"])
    title = (
        "CASE k % 6 WHEN 0 THEN 'Licitación pública LP-' || CAST(k AS STRING) || '-EST obra' WHEN 1 THEN 'Invitación 123/2024 mantenimiento' "
        "WHEN 2 THEN 'Concurso XYZ-' || LPAD(CAST(k AS STRING), 4, '0') || ' infraestructura' WHEN 3 THEN 'Convocatoria No. 45.B compra' "
        "WHEN 4 THEN 'Compra de ' || lower(seg) ELSE '' END"
    )
    return f"""
SELECT k, seg, buyer, region, nation, {title} AS titulo, {amount} AS monto,
  CASE WHEN k % 50 = 49 THEN '   ' WHEN k % 50 = 48 THEN '{{"Proyecto": roto'
    WHEN k % 2 = 0 THEN ' {{"Organismo":"' || buyer || '","localidad":"' || CASE WHEN k % 4 = 0 THEN buyer ELSE region END
      || '","Proyecto":"' || {title} || '","Vínculo":"' || CASE WHEN k % 3 = 0 THEN 'ftp://x' ELSE 'https://sitio.example/' || CAST(k AS STRING) END
      || '","Monto":"' || {amount} || '"}}'
    ELSE '{{"source":"' || buyer || '","jurisdiction":"' || nation || '","title":"' || {title} || '","url":"https://lista.example/","doc_url":"https://doc.example/' || CAST(k AS STRING) || '.pdf"}}'
  END AS line
FROM src"""


def _answers(_: str) -> str:
    """Stored model answers: a list, a fenced list, a bare object, chatter around it, or no JSON."""
    one = (
        "'{\"numero_procedimiento\":' || CASE WHEN k % 4 = 0 THEN 'null' ELSE '\"LA-' || CAST(k AS STRING) || '\"' END "
        "|| ',\"titulo\":\"' || seg || '\",\"fecha_publicacion\":\"' || " + iso("d") + " || '\",\"referencia\":null}'"
    )
    return f"""
SELECT k, seg, d, '01' || {two('month(d)')} || CAST(year(d) AS STRING) || '_MAT.txt' AS file, CAST(k % 300 AS INT) AS page,
  CASE k % 5 WHEN 0 THEN '[' || {one} || ']' WHEN 1 THEN '```json' || chr(10) || '[' || {one} || ',' || {one} || ']' || chr(10) || '```'
    WHEN 2 THEN {one} WHEN 3 THEN 'Encontré estas: [' || {one} || '] en la página' ELSE 'No hay licitaciones.' END AS answer
FROM src"""


def _link_pages(_: str) -> str:
    """One stored web page per order with a list of links, some near a date."""
    return f"""
SELECT k AS page_id, d, 'https://sitio' || CAST(nk AS STRING) || '.example/lista/' AS url, region, nation,
  '<html><body><h1>Avisos</h1><ul>'
  || '<li><a href="/doc/' || CAST(k AS STRING) || '">Convocatoria <b>LPN-' || CAST(k AS STRING) || '</b> obra SAF-1</a> publicada ' || {slash('d')} || '</li>'
  || '<li><a href="https://otro.example/x.pdf?v=' || CAST(k AS STRING) || '"> </a> ' || CAST(day(d) AS STRING) || ' ' || lower({month_name('d', SHORT)}) || ' ' || CAST(year(d) AS STRING) || '</li>'
  || '<li><a href="/inicio">Inicio</a></li>'
  || '<li><a href="bases/' || CAST(k AS STRING) || '.html">Documento&nbsp;general</a></li>'
  || '<li><a href="bases/' || CAST(k AS STRING) || '.html">Documento general</a></li></ul></body></html>' AS html
FROM src"""


def _pasted(_: str) -> str:
    """Pasted portal pages, label by label."""
    nl = "chr(10)"
    return f"""
SELECT k, seg, buyer, region, d,
  'Código del expediente:' || {nl} || 'E-' || CAST(k AS STRING) || {nl}
  || 'Número de procedimiento de contratación: LA-' || CAST(k AS STRING) || {nl}
  || 'Estatus del procedimiento de contratación: VIGENTE' || {nl}
  || CASE WHEN k % 3 = 0 THEN '' ELSE 'Nombre del procedimiento de contratación: Compra ' || seg || {nl} END
  || 'Dependencia o Entidad: ' || buyer || {nl} || 'Correo electrónico unidad compradora: a' || CAST(k AS STRING) || '@x.example otro' || {nl}
  || 'Entidad Federativa donde se llevará a cabo la contratación: ' || region || {nl}
  || 'Fecha y hora del acto del Fallo: ' || {slash('d')} || ' 10:00' || {nl} || 'Carácter:   Nacional' AS text
FROM src"""


def _stored(_: str) -> str:
    """Stored gazette rows whose title still carries the rest of the notice."""
    return f"""
SELECT k AS id, 'DOF' AS fuente, d, seg, estado_texto, estado_nombre, municipio_texto, municipio_nombre, cantidad, objeto, buyer,
  objeto || CASE k % 3 WHEN 0 THEN ' Volumen a adquirir ' || cantidad || ' piezas Los detalles se determinan en la convocatoria '
      WHEN 1 THEN ' Fecha de publicación en Compras MX ' || {worded('d')} ELSE ' "fin"' END
    || CASE WHEN k % 2 = 0 THEN ' Junta de aclaraciones ' || {slash('d_junta')} || ', a las 10:30' ELSE '' END AS titulo,
  'Trabajos en el municipio de ' || municipio_texto || ', ' || estado_texto || '. Visita al sitio de los trabajos '
    || CASE WHEN k % 4 = 0 THEN 'No habrá visita' ELSE {slash('d_junta')} END || '. Fallo ' || {slash('d_fallo')} || ' carácter Internacional' AS descripcion,
  CASE WHEN k % 5 = 0 THEN 'Previo' END AS entidad_federativa, CAST(NULL AS STRING) AS municipio,
  CASE WHEN k % 2 = 0 THEN '{{"nota":"' || seg || '","procesado":false}}' END AS datos_especificos
FROM notices"""


def _gazette_json(_: str) -> str:
    """One record of a gazette JSON file per order: flat (first version) or with nested dates (second)."""
    return f"""
SELECT k, d, seg, objeto, dependencia, numero, d_junta, d_apertura, d_fallo, referencia,
  CASE WHEN k % 2 = 0 THEN '2.0' END AS version,
  '{{"numero_licitacion":"' || COALESCE(numero, '') || '","dependencia":"' || COALESCE(dependencia, '') || '"'
  || ',"subdependencia":"' || CASE WHEN k % 3 = 0 THEN '' ELSE segunda END || '","unidad_responsable":"Unidad ' || seg || '"'
  || ',"objeto_licitacion":"' || objeto || ' Volumen a Adquirir 10 piezas","titulo":"' || CASE WHEN k % 5 = 0 THEN '' ELSE objeto END || '"'
  || ',"caracter_licitacion":"' || CASE WHEN k % 4 = 0 THEN 'Internacional abierta' ELSE 'Nacional' END || '"'
  || ',"fecha_publicacion":' || CASE WHEN k % 2 = 0 THEN '{{"fecha":"' || CASE WHEN k % 4 = 0 THEN {iso('d')} ELSE '' END
      || '","hora":"","texto_original":"' || {worded('d')} || '"}}' ELSE '"' || {slash('d')} || ', 10:00 horas"' END
  || ',"fecha_junta_aclaraciones":"10:00 horas, ' || CAST(day(d_junta) AS STRING) || ' ' || {month_name('d_junta', SHORT)} || '. ' || CAST(year(d_junta) AS STRING) || '"'
  || ',"fecha_presentacion_apertura":"' || {iso('d_apertura')} || ' 10:00"'
  || ',"fecha_fallo":"' || CASE WHEN k % 3 = 0 THEN '' ELSE {worded('d_fallo')} || ' en CompraNet' END || '"'
  || ',"pagina":' || CAST(k % 100 AS STRING) || ',"referencia":"' || referencia || '"}}' AS rec
FROM notices"""


VIEWS = {
    "src": ((), _orders),
    "tenders": (("src",), _tenders),
    "notices": (("src",), _notices),
    "blocks": (("notices",), _blocks),
    "gazette_pages": (("blocks",), _gazette_pages),
    "portal": (("src",), _portal),
    "portal_files": (("portal",), _portal_files),
    "portal_details": (("src",), _portal_details),
    "ocds": (("src",), _ocds),
    "releases": (("src",), _releases),
    "site_lines": (("src",), _site_lines),
    "answers": (("src",), _answers),
    "link_pages": (("src",), _link_pages),
    "pasted": (("src",), _pasted),
    "stored": (("notices",), _stored),
    "gazette_json": (("notices",), _gazette_json),
}


def needs(name: str) -> list[str]:
    """The input and the inputs it is built on, innermost first."""
    out: list[str] = []
    for parent in VIEWS[name][0]:
        out += [n for n in needs(parent) if n not in out]
    return [*out, name]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """The table dealt out by its key, so that composing long texts from it is shared by all tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


_prepared: dict[tuple[str, str], str] = {}


def prepare(spark: SparkSession, sf_dir: str, name: str) -> None:
    """Writes a derived input once; from then on `view` reads it instead of composing it."""
    if (sf_dir, name) not in _prepared:
        path = work_dir(spark, name)
        view(spark, sf_dir, name).write.parquet(path)
        _prepared[sf_dir, name] = path


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived input as a DataFrame."""
    if (sf_dir, name) in _prepared:
        df = spark.read.parquet(_prepared[sf_dir, name])
        df.createOrReplaceTempView(name)
        return df
    for base in ("customer", "nation", "region"):
        table(spark, sf_dir, base).createOrReplaceTempView(base)
    orders = table(spark, sf_dir, "orders")
    # the tenders view only renames and joins columns; all other inputs compose texts
    (orders if name == "tenders" else dealt(orders, "o_orderkey")).createOrReplaceTempView("orders")
    df = None
    for step in needs(name):
        df = spark.sql(VIEWS[step][1]("spark"))
        df.createOrReplaceTempView(step)
    return df


def with_views(sql: str, *names: str) -> str:
    """The check SQL with the inputs it names put in front."""
    steps: list[str] = []
    for name in names:
        steps += [n for n in needs(name) if n not in steps]
    body = sql.strip()
    heads = ",\n".join(f"{n} AS ({VIEWS[n][1]('duckdb')})" for n in steps)
    if body[:4].upper() == "WITH":
        return f"WITH {heads},\n{body[4:]}"
    return f"WITH {heads}\n{body}"
