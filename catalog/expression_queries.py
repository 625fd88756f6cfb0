"""Scalar functions and classes, each over whole columns of the test tables or inputs derived from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from pregonero.functions import amounts, classify, dates, jsons, keys, text, urls
from pregonero.functions.jsons import field, member

from .inputs import iso, table, view
from .registry import contract_kind, plain, register


def on(name, source, build, sql, *views):
    register(name, lambda spark, sf: plain(build(view(spark, sf, source))), sql, *(views or (source,)))


def on_table(name, source, build, sql):
    register(name, lambda spark, sf: plain(build(table(spark, sf, source))), sql)


def js(path):
    return F.get_json_object("rec", f"$.{path}")


def cut(expr, n):
    return f"substr({expr}, 1, {n})"


# --- text ---------------------------------------------------------------------------------------------------------

on_table(
    "x1_whitespace",
    "documents",
    lambda d: d.select("doc_id", F.md5(text.normspace(F.col("text"))).alias("h")),
    r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS h FROM documents",
)
on_table(
    "x2_truncate",
    "documents",
    lambda d: d.select("doc_id", *[F.md5(text.truncate(F.col("text"), n)).alias(f"h{n}") for n in (50, 220, 500, 1000)]),
    "SELECT doc_id, " + ", ".join(f"md5(substr(text, 1, {n})) AS h{n}" for n in (50, 220, 500, 1000)) + " FROM documents",
)
on(
    "x3_first_filled",
    "portal",
    lambda d: d.select(
        "k",
        text.first_filled(js("numero_procedimiento"), js("cod_expediente")).alias("numero"),
        text.first_filled(js("nombre_procedimiento"), js("titulo")).alias("titulo"),
        text.first_filled(js("siglas"), js("entidad_compradora")).alias("entidad"),
    ),
    """SELECT k, CASE WHEN k % 10 = 0 THEN 'E-' ELSE 'LA-' END || CAST(k AS VARCHAR) AS numero,
    CASE WHEN k % 17 = 0 THEN prio ELSE 'Contrato ' || seg END AS titulo, CASE WHEN k % 5 = 0 THEN nation ELSE region END AS entidad FROM portal""",
)
on(
    "x4_portal_date",
    "portal",
    lambda d: d.select("k", dates.portal_date(js("fecha_publicacion")).alias("a"), dates.portal_date(js("fecha_apertura")).alias("b")),
    "SELECT k, CASE WHEN k % 5 IN (0, 1, 2) THEN d END AS a, d AS b FROM portal",
)
on(
    "x5_gazette_date",
    "gazette_json",
    lambda d: d.select(
        "k",
        dates.gazette_date(F.when(F.col("k") % 2 == 1, js("fecha_publicacion"))).alias("con_hora"),
        dates.gazette_date(js("fecha_junta_aclaraciones")).alias("corta"),
        dates.gazette_date(js("fecha_presentacion_apertura")).alias("iso"),
        dates.gazette_date(js("fecha_fallo")).alias("larga"),
        dates.gazette_date(F.concat(F.lit("12 de brumario de "), F.year("d").cast("string"))).alias("mes_desconocido"),
    ),
    """SELECT k, CASE WHEN k % 2 = 1 THEN d END AS con_hora, d_junta AS corta, d_apertura AS iso,
    CASE WHEN k % 3 <> 0 THEN d_fallo END AS larga, make_date(year(d), 1, 12) AS mes_desconocido FROM gazette_json""",
)
on(
    "x6_structured_date",
    "gazette_json",
    lambda d: d.select("k", dates.structured_date(js("fecha_publicacion.fecha"), js("fecha_publicacion.texto_original")).alias("fecha")),
    "SELECT k, CASE WHEN k % 2 = 0 THEN d END AS fecha FROM gazette_json",
)
on(
    "x7_event_timestamp",
    "notices",
    lambda d: d.select(
        "k",
        dates.event_timestamp(F.concat(F.date_format("d", "d/M/yyyy"), F.lit(", a las 10:30"))).alias("a"),
        dates.event_timestamp(F.concat(F.date_format("d", "d"), F.lit(" DE AGOSTO DE "), F.year("d").cast("string"), F.lit(" 9:05 HORAS"))).alias("b"),
        dates.event_timestamp(F.concat(F.lit("31/02/"), F.year("d").cast("string"))).alias("c"),
        dates.event_timestamp(F.concat(F.lit("14/agosto/"), F.year("d").cast("string"), F.lit(" 11:00 hrs"))).alias("e"),
    ),
    """SELECT k, strftime(d, '%Y-%m-%d') || ' 10:30:00' AS a, CAST(year(d) AS VARCHAR) || '-08-' || lpad(CAST(day(d) AS VARCHAR), 2, '0') || ' 09:05:00' AS b,
    CAST(NULL AS VARCHAR) AS c, CAST(year(d) AS VARCHAR) || '-08-14 11:00:00' AS e FROM notices""",
)
on(
    "x8_date_parts",
    "blocks",
    lambda d: d.select(
        "k",
        *[
            x
            for name, pattern in {"junta": "Junta de aclaraciones: ([^\n]+)", "apertura": "proposiciones: ([^\n]+)"}.items()
            for p in [dates.date_parts(text.grab(F.col("texto"), pattern))]
            for x in (p["fecha"].alias(f"{name}_fecha"), p["hora"].alias(f"{name}_hora"), p["texto_original"].alias(f"{name}_texto"))
        ],
    ),
    """SELECT k, strftime(d_junta, '%Y-%m-%d') AS junta_fecha, '' AS junta_hora,
    strftime(d_junta, '%d/%m/%Y') || CASE WHEN k % 3 = 0 THEN ', a las 10:30' ELSE '' END AS junta_texto,
    CASE WHEN k % 6 <> 5 THEN strftime(d_apertura, '%Y-%m-%d') END AS apertura_fecha, CASE WHEN k % 6 <> 5 THEN '' END AS apertura_hora,
    CASE WHEN k % 6 <> 5 THEN CAST(day(d_apertura) AS VARCHAR) || ' de ' || list_extract(['enero','febrero','marzo','abril','mayo','junio','julio','agosto',
      'septiembre','octubre','noviembre','diciembre'], month(d_apertura)) || ' de ' || CAST(year(d_apertura) AS VARCHAR) END AS apertura_texto FROM blocks""",
)
on(
    "x9_any_date",
    "link_pages",
    lambda d: d.select("page_id", dates.any_date(text.grab(F.col("html"), "publicada ([^<]+)")).alias("a"),
                       dates.any_date(text.grab(F.col("html"), "</a> ([^<]+\\d{4})<")).alias("b")),
    "SELECT page_id, d AS a, d AS b FROM link_pages",
)
on("x10_ocds_date", "ocds", lambda d: d.select("k", dates.ocds_date(F.col("date")).alias("fecha")), "SELECT k, CASE WHEN k % 4 < 3 THEN d END AS fecha FROM ocds")
on(
    "x11_five_format_date",
    "ocds",
    lambda d: d.select(
        "k",
        dates.five_format_date(F.lit(""), F.col("date")).alias("a"),
        dates.five_format_date(F.date_format("d", "dd-MM-yyyy")).alias("b"),
        dates.five_format_date(F.col("tender_start")).alias("c"),
    ),
    "SELECT k, CASE WHEN k % 4 < 3 THEN d END AS a, d AS b, d AS c FROM ocds",
)
on("x12_date_cut", "portal", lambda d: d.select("k", dates.date_cut(js("fecha_apertura")).alias("dia")), f"SELECT k, {iso('d')} AS dia FROM portal")

# --- amounts ------------------------------------------------------------------------------------------------------

on(
    "x13_portal_amount",
    "portal",
    lambda d: d.select("k", amounts.portal_amount(js("monto_estimado")).alias("a"), amounts.portal_amount(js("presupuesto_estimado")).alias("b")),
    """SELECT k, CAST(CASE WHEN k % 4 < 2 THEN price WHEN k % 4 = 2 THEN 0 END AS DOUBLE) AS a,
    CAST(CASE WHEN k % 4 = 2 THEN 1234.50 END AS DOUBLE) AS b FROM portal""",
)
on(
    "x14_ocds_amount",
    "ocds",
    lambda d: d.select("k", amounts.ocds_amount(F.col("tender_amount")).alias("monto")),
    "SELECT k, CAST(CASE WHEN k % 3 < 2 THEN price END AS DOUBLE) AS monto FROM ocds",
)
on(
    "x15_site_amount",
    "site_lines",
    lambda d: d.select("k", amounts.site_amount(F.col("monto")).alias("monto")),
    "SELECT k, CAST(CASE k % 6 WHEN 0 THEN 1234567.50 WHEN 1 THEN 1234.5 WHEN 2 THEN 1234 WHEN 5 THEN 987.6 END AS DOUBLE) AS monto FROM site_lines",
)
on(
    "x16_amount_in_text",
    "portal",
    lambda d: d.select(
        "k",
        amounts.amount_in_text(F.concat(F.lit("Inversión de $"), F.col("price").cast("string"), F.lit(" según "), F.col("seg"))).alias("pesos"),
        amounts.amount_in_text(F.concat(F.lit("unos "), (F.col("k") + 1).cast("string"), F.lit(" MDP en total"))).alias("millones"),
        amounts.amount_in_text(F.col("seg")).alias("nada"),
    ),
    r"""SELECT k, regexp_extract('$' || CAST(price AS VARCHAR), '(?i)(\$\s?\d{1,3}(?:[.,]\d{3})*(?:[.,]\d{2})?|\$\s?\d+(?:[.,]\d{2})?)', 1) AS pesos,
    CAST(k + 1 AS VARCHAR) || ' MDP' AS millones, CAST(NULL AS VARCHAR) AS nada FROM portal""",
)
on(
    "x17_nested_amount_and_name",
    "releases",
    lambda d: d.select("k", F.parse_json("rec").alias("v")).select(
        "k", amounts.nested_amount(member(F.col("v"), "planning.budget.amount")).alias("monto"), amounts.nested_name(member(F.col("v"), "buyer")).alias("nombre")
    ),
    """SELECT k, CAST(CASE WHEN k % 4 < 2 THEN price WHEN k % 4 = 2 THEN 0 END AS DOUBLE) AS monto,
    CASE WHEN k % 3 < 2 THEN buyer ELSE '' END AS nombre FROM releases""",
)

# --- JSON ---------------------------------------------------------------------------------------------------------

on(
    "x18_cell_unwrap",
    "ocds",
    lambda d: d.select(
        "k", *[jsons.unwrap_cell(F.col(c)).alias(c) for c in ("buyer_name", "tender_title", "tender_description")],
        jsons.unwrap_cell(F.col("budget_amount")).cast("double").alias("budget_amount"),
    ),
    """SELECT k, CASE WHEN k % 5 <> 2 THEN buyer END AS buyer_name, NULLIF(tender_title, '') AS tender_title,
    NULLIF(tender_description, 'null') AS tender_description, CASE WHEN k % 2 = 0 THEN CAST(price AS DOUBLE) END AS budget_amount
    FROM ocds""",
)
on(
    "x19_json_build",
    "tenders",
    lambda d: d.select(
        "id",
        jsons.build(
            tipo_procedimiento=F.coalesce(jsons.path_text(F.col("datos_originales"), "tipo_procedimiento"), "tipo_procedimiento"),
            ramo=jsons.path_text(F.col("datos_originales"), "ramo"),
            fuente=F.col("fuente"),
        ).alias("datos"),
    ),
    """SELECT id, CAST(json_object('tipo_procedimiento', COALESCE(json_extract_string(datos_originales, '$.tipo_procedimiento'), tipo_procedimiento),
    'ramo', json_extract_string(datos_originales, '$.ramo'), 'fuente', fuente) AS VARCHAR) AS datos FROM tenders""",
)
on(
    "x20_json_path",
    "tenders",
    lambda d: d.select(
        "id",
        jsons.path_text(F.col("datos_originales"), "tender", "procuringEntity", "address", "region").alias("region"),
        jsons.path_text(F.col("datos_originales"), "tender", "items").alias("items"),
        F.get_json_object("datos_originales", "$.tender.items[0].id").alias("item"),
    ),
    """SELECT id, json_extract_string(datos_originales, '$.tender.procuringEntity.address.region') AS region,
    CAST(json_extract(datos_originales, '$.tender.items') AS VARCHAR) AS items, json_extract_string(datos_originales, '$.tender.items[0].id') AS item FROM tenders""",
)
on_table(
    "x20_event_property",
    "events",
    lambda d: d.groupBy("event_type").agg(F.sum(jsons.path_text(F.col("props"), "k").cast("long")).alias("suma")),
    "SELECT event_type, CAST(SUM(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS suma FROM events GROUP BY 1",
)
on(
    "x21_json_merge",
    "tenders",
    lambda d: d.select("id", jsons.merge(F.col("datos_originales"), jsons.build(seccion=F.lit("nueva"), pagina=F.col("id"))).alias("j")).select(
        "id", *[F.get_json_object("j", f"$.{p}").alias(p) for p in ("seccion", "pagina", "ocid", "ramo")], F.size(F.json_object_keys("j")).alias("n")
    ),
    """SELECT id, 'nueva' AS seccion, CAST(id AS VARCHAR) AS pagina, CASE WHEN id % 4 = 2 THEN 'ocds-87sd3t-' || CAST(id AS VARCHAR) END AS ocid,
    CASE WHEN id % 4 = 0 THEN json_extract_string(datos_originales, '$.ramo') END AS ramo, CASE id % 4 WHEN 0 THEN 7 WHEN 1 THEN 4 WHEN 2 THEN 4 ELSE 2 END AS n FROM tenders""",
)

# --- keys, titles, links ------------------------------------------------------------------------------------------

on(
    "x22_hashes",
    "tenders",
    lambda d: d.select("id", keys.triple_sha(*[F.col(c) for c in ("numero_procedimiento", "entidad_compradora", "fuente")]).alias("sha"),
                       keys.triple_md5(*[F.col(c) for c in ("numero_procedimiento", "entidad_compradora", "fuente")]).alias("md5")),
    "SELECT id, sha256(numero_procedimiento || '_' || entidad_compradora || '_' || fuente) AS sha, md5(numero_procedimiento || entidad_compradora || fuente) AS md5 FROM tenders",
)
on_table(
    "x23_title_case",
    "part",
    lambda d: d.select("p_partkey", text.title_case(F.concat_ws(" ", F.upper("p_name"), F.lower("p_type"), F.lit("de-la o'neil 3er"))).alias("t")),
    """SELECT p_partkey, array_to_string(list_transform(string_split(p_name || ' ' || p_type, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')
    || ' De-La O''Neil 3Er' AS t FROM part""",
)
on(
    "x24_gazette_url",
    "tenders",
    lambda d: d.select("id", urls.gazette_url(F.col("url_original"), F.col("datos_originales"), F.col("fecha_publicacion")).alias("url")).filter("id % 4 = 1"),
    """SELECT id, CASE WHEN id % 12 = 5 THEN url_original ELSE 'https://dof.gob.mx/index_111.php?year=' || strftime(fecha_publicacion, '%Y') || '&month='
    || strftime(fecha_publicacion, '%m') || '&day=' || strftime(fecha_publicacion, '%d') || '#gsc.tab=0' END AS url FROM tenders WHERE id % 4 = 1""",
)
on(
    "x25_portal_url",
    "portal",
    lambda d: d.select("k", urls.portal_url(F.when(F.col("k") % 7 == 0, F.lit("https://hash.example/")), js("url_original"), js("uuid_procedimiento")).alias("url")),
    """SELECT k, CASE WHEN k % 7 = 0 THEN 'https://hash.example/' WHEN k % 6 = 0 THEN 'https://sitio.example/' || CAST(k AS VARCHAR)
    WHEN k % 4 = 0 THEN 'https://comprasmx.buengobierno.gob.mx/sitiopublico/#/sitiopublico/detalle/u-' || CAST(k % 3000 AS VARCHAR) || '/procedimiento'
    ELSE 'https://comprasmx.buengobierno.gob.mx/' END AS url FROM portal""",
)
on(
    "x26_ocds_url",
    "ocds",
    lambda d: d.select(
        "k",
        urls.ocds_url(jsons.unwrap_cell(F.col("tender_id")), text.first_filled(F.col("project_id"), F.col("tender_id"), F.col("ocid")),
                      F.when(F.col("k") % 2 == 0, F.col("id")), F.col("ocid")).alias("url"),
    ),
    """SELECT k, 'https://datosabiertostianguisdigital.cdmx.gob.mx/proceso/' || CASE WHEN k % 3 = 0 THEN CAST(k AS VARCHAR)
    WHEN k % 3 = 1 AND k % 7 <> 0 THEN CAST(k AS VARCHAR) WHEN k % 2 = 0 THEN id ELSE ocid END AS url FROM ocds""",
)
on(
    "x27_number_in_title",
    "site_lines",
    lambda d: d.select("k", keys.number_in_title(F.col("titulo")).alias("numero")),
    r"""SELECT k, CASE k % 6 WHEN 0 THEN 'LP-' || CAST(k AS VARCHAR) || '-EST' WHEN 1 THEN '123/2024' WHEN 2 THEN 'XYZ-' || lpad(CAST(k AS VARCHAR), 4, '0')
    WHEN 3 THEN 'No. 45.B' END AS numero FROM site_lines""",
)
on(
    "x27_longest_code",
    "link_pages",
    lambda d: d.select("page_id", keys.longest_code(F.concat(F.lit("SAF-1 obra LPN-"), F.col("page_id").cast("string"), F.lit(" ADQ/7"))).alias("code")),
    "SELECT page_id, CASE WHEN page_id < 10 THEN 'SAF-1' ELSE 'LPN-' || CAST(page_id AS VARCHAR) END AS code FROM link_pages",
)
on_table(
    "x29_rounding",
    "lineitem",
    lambda d: d.groupBy("l_returnflag", "l_linenumber").agg(
        F.round(F.sum(F.col("l_quantity").cast("decimal(15,2)")) / F.count(F.lit(1)), 2).cast("double").alias("medio"),
        F.bround(F.sum(F.col("l_quantity").cast("long")).cast("decimal(20,0)") / 8, 2).cast("double").alias("al_par"),
    ),
    """SELECT l_returnflag, l_linenumber, CAST((SUM(CAST(l_quantity * 100 AS HUGEINT)) * 2 + COUNT(*)) // (2 * COUNT(*)) AS DOUBLE) / 100 AS medio,
    round_even(CAST(SUM(CAST(l_quantity AS BIGINT)) AS DOUBLE) / 8, 2) AS al_par FROM lineitem GROUP BY 1, 2""",
)

# --- classes ------------------------------------------------------------------------------------------------------

on(
    "c1_procedure_from_text",
    "site_lines",
    lambda d: d.select("k", classify.procedure_from_text(F.col("titulo")).alias("c")),
    "SELECT k, CASE WHEN k % 6 = 0 THEN 'LICITACION_PUBLICA' WHEN k % 6 = 1 THEN 'INVITACION_3' ELSE 'ADJUDICACION_DIRECTA' END AS c FROM site_lines",
)
on(
    "c2_contract_from_text",
    "site_lines",
    lambda d: d.select("k", classify.contract_from_text(F.col("titulo")).alias("c")),
    "SELECT k, CASE k % 6 WHEN 0 THEN 'OBRA_PUBLICA' WHEN 1 THEN 'SERVICIOS' WHEN 2 THEN 'OBRA_PUBLICA' ELSE 'ADQUISICIONES' END AS c FROM site_lines",
)
on(
    "c3_portal_classes",
    "portal",
    lambda d: d.select(
        "k", classify.portal_procedure(js("tipo_procedimiento")).alias("procedimiento"), classify.portal_contract(js("tipo_contratacion")).alias("contratacion"),
        classify.portal_status(text.first_filled(js("estatus_alterno"), js("estado"))).alias("estado"),
    ),
    """SELECT k, CASE k % 4 WHEN 1 THEN 'INVITACION_3' WHEN 2 THEN 'ADJUDICACION_DIRECTA' ELSE 'LICITACION_PUBLICA' END AS procedimiento,
    CASE k % 4 WHEN 0 THEN 'SERVICIOS' WHEN 1 THEN 'OBRA_PUBLICA' ELSE 'ADQUISICIONES' END AS contratacion,
    CASE k % 5 WHEN 0 THEN 'CERRADO' WHEN 1 THEN 'CERRADO' WHEN 2 THEN 'CANCELADO' WHEN 3 THEN 'DESIERTO' ELSE 'VIGENTE' END AS estado FROM portal""",
)
on(
    "c4_procedure_from_number",
    "tenders",
    lambda d: d.select("id", classify.procedure_from_number(F.lower("numero_procedimiento")).alias("c")),
    "SELECT id, CASE id % 3 WHEN 0 THEN 'LICITACION_PUBLICA' WHEN 1 THEN 'INVITACION_3' ELSE 'ADJUDICACION_DIRECTA' END AS c FROM tenders",
)
on(
    "c5_character",
    "gazette_json",
    lambda d: d.select("k", classify.character(js("caracter_licitacion")).alias("c"), classify.stored_character(js("caracter_licitacion")).alias("guardado")),
    "SELECT k, CASE WHEN k % 4 = 0 THEN 'INTERNACIONAL' ELSE 'NACIONAL' END AS c, CASE WHEN k % 4 = 0 THEN 'INTERNACIONAL' END AS guardado FROM gazette_json",
)
on(
    "c6_ocds_classes",
    "releases",
    lambda d: d.select("k", F.parse_json("rec").alias("v")).select(
        "k", classify.release_method(field(F.col("v"), "tender.procurementMethod")).alias("metodo"),
        classify.release_category(field(F.col("v"), "tender.mainProcurementCategory")).alias("categoria"),
        classify.release_status(field(F.col("v"), "tender.status")).alias("estado"),
    ),
    """SELECT k, CASE k % 4 WHEN 0 THEN 'LICITACION_PUBLICA' WHEN 1 THEN 'INVITACION_3' ELSE 'ADJUDICACION_DIRECTA' END AS metodo,
    CASE k % 3 WHEN 0 THEN 'ADQUISICIONES' WHEN 1 THEN 'OBRA_PUBLICA' ELSE 'SERVICIOS' END AS categoria,
    CASE k % 5 WHEN 1 THEN 'CERRADO' WHEN 2 THEN 'CANCELADO' ELSE 'VIGENTE' END AS estado FROM releases""",
)
on(
    "c6_ocds_cell_classes",
    "ocds",
    lambda d: d.select(
        "k", classify.cell_procedure(text.blank_to_null(F.col("tender_method")), F.col("ocid"), F.col("tender_title")).alias("metodo"),
        classify.cell_contract(text.blank_to_null(F.col("tender_category")), F.col("tender_title"), F.col("tender_description")).alias("categoria"),
    ),
    """SELECT k, CASE k % 5 WHEN 0 THEN 'LICITACION_PUBLICA' WHEN 1 THEN 'INVITACION_3' ELSE 'ADJUDICACION_DIRECTA' END AS metodo,
    CASE WHEN k % 4 = 0 THEN 'ADQUISICIONES' WHEN k % 4 = 1 THEN 'OBRA_PUBLICA' ELSE 'SERVICIOS' END AS categoria FROM ocds""",
)
on(
    "c7_contract_by_score",
    "blocks",
    lambda d: d.select("k", classify.contract_by_score(F.col("texto")).alias("texto"), classify.contract_by_score(F.col("objeto")).alias("objeto"),
                       classify.contract_by_score(F.coalesce("numero", F.lit("nada"))).alias("numero")),
    f"""SELECT k, CASE k % 4 WHEN 0 THEN 'OBRA' WHEN 1 THEN 'SERVICIO' WHEN 2 THEN 'ADQUISICION' ELSE 'No especificado' END AS objeto,
    CASE WHEN numero IS NULL THEN 'No especificado' ELSE 'OBRA' END AS numero, {contract_kind('texto')} AS texto FROM blocks""",
)
on_table(
    "c7_contract_by_score_of_documents",
    "documents",
    lambda d: d.select(classify.contract_by_score(F.col("text")).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n")),
    f"SELECT {contract_kind('text')} AS c, COUNT(*) AS n FROM documents GROUP BY 1",
)
on(
    "c8_invitation_detail",
    "site_lines",
    lambda d: d.select("k", classify.invitation_detail(F.concat_ws(" ", F.col("titulo"), F.when(F.col("k") % 12 == 1, F.lit("tres personas")))).alias("c"),
                       classify.invitation_detail(F.when(F.col("k") % 2 == 0, F.lit("Adjudicación directa")).otherwise(F.lit("Invitación abierta"))).alias("otra")),
    """SELECT k, CASE WHEN k % 6 = 1 THEN 'INVITACION_3_PERSONAS' ELSE 'LICITACION_PUBLICA' END AS c,
    CASE WHEN k % 2 = 0 THEN 'ADJUDICACION_DIRECTA' ELSE 'INVITACION' END AS otra FROM site_lines""",
)
