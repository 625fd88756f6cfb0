"""List, search, facet and analysis queries over the tender view."""

from __future__ import annotations

from pyspark.sql import functions as F

from pregonero.functions.jsons import flag, text_has_key
from pregonero.operators import filters, joins, paging, windows
from pregonero.plans import analysis, freshness, statistics
from pregonero.schema import LIST_COLUMNS, QUICK_COLUMNS
from pregonero.sources.sites import within

from .inputs import AS_OF, view
from .registry import plain, register


def tenders(spark, sf):
    return view(spark, sf, "tenders")


def on_tenders(name, build, sql):
    register(name, lambda spark, sf: plain(build(tenders(spark, sf))), sql, "tenders")


SUM = "CAST(SUM(monto_estimado) AS DOUBLE) AS monto_total"
MEAN = "CAST(SUM(monto_estimado) AS DOUBLE) / NULLIF(COUNT(monto_estimado), 0) AS monto_promedio"
MAX = "CAST(MAX(monto_estimado) AS DOUBLE) AS monto_maximo"
MIN = "CAST(MIN(monto_estimado) AS DOUBLE) AS monto_minimo"
STAMP = "strftime({0}, '%Y-%m-%d %H:%M:%S')"
COUNT = "COUNT(*) AS cantidad"


def columns_sql(names):
    special = {"monto_estimado": "CAST(monto_estimado AS DOUBLE) AS monto_estimado"}
    return ", ".join(special.get(n, n) for n in names)


# --- filters ------------------------------------------------------------------------------------------------------

on_tenders("f1_list_projection", lambda t: t.select(*LIST_COLUMNS), f"SELECT {columns_sql(LIST_COLUMNS)} FROM tenders")
on_tenders("f2_quick_projection", lambda t: t.select(*QUICK_COLUMNS), f"SELECT {columns_sql(QUICK_COLUMNS)} FROM tenders")
on_tenders(
    "f3_equality_filters",
    lambda t: filters.filter_tenders(t, fuente="DOF", estado="F", entidad_federativa="ASIA").select("id", "fuente", "estado"),
    "SELECT id, fuente, estado FROM tenders WHERE fuente = 'DOF' AND estado = 'F' AND entidad_federativa = 'ASIA'",
)
on_tenders(
    "f4_substring_filter",
    lambda t: filters.filter_tenders(t, municipio="ation_1").select("id", "municipio"),
    "SELECT id, municipio FROM tenders WHERE municipio ILIKE '%ation_1%'",
)
on_tenders(
    "f5_in_list_filters",
    lambda t: filters.filter_tenders(
        t, tipo_contratacion=["BUILDING", "MACHINERY"], tipo_procedimiento=["1-URGENT", "5-LOW"]
    ).select("id", "tipo_contratacion", "tipo_procedimiento"),
    "SELECT id, tipo_contratacion, tipo_procedimiento FROM tenders WHERE tipo_contratacion IN ('BUILDING', 'MACHINERY') "
    "AND tipo_procedimiento IN ('1-URGENT', '5-LOW')",
)
on_tenders(
    "f6_date_range",
    lambda t: filters.filter_tenders(t, fecha_desde="1997-01-01", fecha_hasta="1997-12-31").select("id", "fecha_publicacion"),
    "SELECT id, fecha_publicacion FROM tenders WHERE fecha_publicacion BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'",
)
on_tenders(
    "f7_amount_range",
    lambda t: filters.filter_tenders(t, monto_min=100000, monto_max=200000).select("id", "monto_estimado"),
    "SELECT id, CAST(monto_estimado AS DOUBLE) AS monto_estimado FROM tenders WHERE monto_estimado >= 100000 AND monto_estimado <= 200000",
)
on_tenders(
    "f7_zero_amount_means_no_filter",
    lambda t: filters.filter_tenders(t, monto_min=0).agg(F.count(F.lit(1)).alias("n")),
    "SELECT COUNT(*) AS n FROM tenders",
)
on_tenders(
    "f8_opening_horizon",
    lambda t: filters.filter_tenders(t, dias_apertura=30, as_of=AS_OF).select("id", "fecha_apertura"),
    f"SELECT id, fecha_apertura FROM tenders WHERE fecha_apertura BETWEEN DATE '{AS_OF}' AND CAST(DATE '{AS_OF}' + INTERVAL 30 DAY AS DATE)",
)
on_tenders(
    "f9_text_search",
    lambda t: filters.filter_tenders(t, busqueda="00077").select("id", "titulo", "descripcion"),
    "SELECT id, titulo, descripcion FROM tenders WHERE titulo ILIKE '%00077%' OR descripcion ILIKE '%00077%' OR numero_procedimiento ILIKE '%00077%'",
)
on_tenders(
    "f10_quick_search",
    lambda t: paging.quick_results(t, "build", 50),
    f"SELECT {columns_sql(QUICK_COLUMNS)} FROM tenders WHERE numero_procedimiento ILIKE '%build%' OR titulo ILIKE '%build%' "
    "OR entidad_compradora ILIKE '%build%' OR entidad_federativa ILIKE '%build%' OR municipio ILIKE '%build%' "
    "ORDER BY fecha_publicacion DESC NULLS FIRST, id DESC LIMIT 50",
)
on_tenders(
    "f11_combined_filters",
    lambda t: filters.filter_tenders(
        t, fuente="ComprasMX", municipio="nation", tipo_contratacion=["BUILDING"], fecha_desde="1996-01-01",
        monto_min=50000, busqueda="building",
    ).select("id", "monto_estimado"),
    "SELECT id, CAST(monto_estimado AS DOUBLE) AS monto_estimado FROM tenders WHERE fuente = 'ComprasMX' AND municipio ILIKE '%nation%' "
    "AND tipo_contratacion IN ('BUILDING') AND fecha_publicacion >= DATE '1996-01-01' AND monto_estimado >= 50000 "
    "AND (titulo ILIKE '%building%' OR descripcion ILIKE '%building%' OR numero_procedimiento ILIKE '%building%')",
)
on_tenders(
    "f12_library_filter",
    lambda t: filters.library_filter(t, {"entidad": "customer#00000001", "municipio": "NATION_3", "q": "urgent"}).select("id"),
    "SELECT id FROM tenders WHERE entidad_compradora ILIKE '%customer#00000001%' AND municipio = 'NATION_3' "
    "AND (titulo ILIKE '%urgent%' OR descripcion ILIKE '%urgent%')",
)
on_tenders(
    "f13_point_lookup", lambda t: filters.by_id(t, 42).select(*LIST_COLUMNS), f"SELECT {columns_sql(LIST_COLUMNS)} FROM tenders WHERE id = 42"
)
on_tenders(
    "f14_non_null_guard",
    lambda t: filters.not_null(t, "entidad_federativa", "municipio", "tipo_contratacion").select("id"),
    "SELECT id FROM tenders WHERE entidad_federativa IS NOT NULL AND municipio IS NOT NULL AND tipo_contratacion IS NOT NULL",
)
on_tenders(
    "f15_procedure_options_without_direct_awards",
    lambda t: filters.without_direct_awards(
        statistics.counts_by(
            t.withColumn(
                "tipo_procedimiento",
                F.when(F.col("tipo_procedimiento") == "5-LOW", "Adjudicacion directa").otherwise(F.col("tipo_procedimiento")),
            ),
            "tipo_procedimiento",
        ),
        "tipo_procedimiento",
    ),
    "SELECT tipo_procedimiento, COUNT(*) AS cantidad FROM tenders WHERE tipo_procedimiento IS NOT NULL "
    "AND tipo_procedimiento <> '5-LOW' GROUP BY 1",
)
on_tenders(
    "f16_non_blank",
    lambda t: filters.not_blank(
        t.withColumn("municipio", F.when(F.col("municipio") == "NATION_3", "  ").otherwise(F.col("municipio"))), "municipio"
    ).select("id", "municipio"),
    "SELECT id, municipio FROM tenders WHERE municipio IS NOT NULL AND municipio <> 'NATION_3'",
)
on_tenders(
    "f17_null_passing_window",
    lambda t: t.filter(within(F.col("fecha_apertura"), F.lit("1996-01-01").cast("date"), F.lit("1996-12-31").cast("date"))).select("id", "fecha_apertura"),
    "SELECT id, fecha_apertura FROM tenders WHERE fecha_apertura IS NULL OR fecha_apertura BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'",
)
on_tenders(
    "f19_json_predicates",
    lambda t: t.filter(
        F.get_json_object("datos_originales", "$.entidad_federativa_contratacion").isNotNull()
        | text_has_key(F.col("datos_originales"), "ocid")
        | (flag(F.col("datos_especificos"), "procesado") == F.lit(False))
        | F.col("datos_especificos").contains("detalle_individual")
    ).select("id"),
    "SELECT id FROM tenders WHERE id % 4 IN (0, 2) OR id % 12 = 1",
)
on_tenders(
    "f20_validity_gate_rejects",
    lambda t: filters.split_valid(
        t.withColumns(
            {
                "numero_procedimiento": F.when(F.col("id") % 10 == 0, "").otherwise(F.col("numero_procedimiento")),
                "fuente": F.when(F.col("id") % 15 != 0, F.col("fuente")),
            }
        )
    )[1].groupBy("motivo").agg(F.count(F.lit(1)).alias("n")),
    "SELECT CASE WHEN id % 10 = 0 THEN 'sin numero_procedimiento' ELSE 'sin fuente' END AS motivo, COUNT(*) AS n FROM tenders "
    "WHERE id % 10 = 0 OR id % 15 = 0 GROUP BY 1",
)

# --- look-ups -----------------------------------------------------------------------------------------------------

on_tenders(
    "j4_share_of_total",
    lambda t: joins.with_share(statistics.counts_by(t, "tipo_contratacion"), "cantidad", "porcentaje"),
    "SELECT tipo_contratacion, cantidad, CAST((cantidad * 20000 + total) // (2 * total) AS DOUBLE) / 100 AS porcentaje FROM ("
    "SELECT tipo_contratacion, COUNT(*) AS cantidad, CAST(SUM(COUNT(*)) OVER () AS BIGINT) AS total FROM tenders "
    "WHERE tipo_contratacion IS NOT NULL GROUP BY 1) x",
)
on_tenders(
    "j8_facet_drill_down",
    lambda t: joins.facet_of(statistics.counts_by(t, "municipio", "entidad_federativa"), "entidad_federativa", "EUROPE"),
    f"SELECT municipio, entidad_federativa, {COUNT} FROM tenders WHERE municipio IS NOT NULL AND entidad_federativa = 'EUROPE' GROUP BY 1, 2",
)

# --- aggregates ---------------------------------------------------------------------------------------------------

on_tenders("a1_total", statistics.total, "SELECT COUNT(*) AS total FROM tenders")
on_tenders("a2_count_by_source", lambda t: statistics.counts_by(t, "fuente", keep_null=True), f"SELECT fuente, {COUNT} FROM tenders GROUP BY 1")
on_tenders("a3_count_by_status", lambda t: statistics.counts_by(t, "estado"), f"SELECT estado, {COUNT} FROM tenders WHERE estado IS NOT NULL GROUP BY 1")
on_tenders(
    "a4_top_states",
    lambda t: statistics.top_counts(t, 10, "entidad_federativa"),
    f"SELECT entidad_federativa, {COUNT} FROM tenders WHERE entidad_federativa IS NOT NULL GROUP BY 1 ORDER BY cantidad DESC, 1 LIMIT 10",
)
on_tenders(
    "a5_count_by_contract_type",
    lambda t: statistics.counts_by(t, "tipo_contratacion"),
    f"SELECT tipo_contratacion, {COUNT} FROM tenders WHERE tipo_contratacion IS NOT NULL GROUP BY 1",
)
on_tenders(
    "a6_completeness",
    statistics.completeness,
    "SELECT COUNT(entidad_federativa) AS con_entidad, COUNT(municipio) AS con_municipio, COUNT(datos_especificos) AS con_datos_especificos FROM tenders",
)
on_tenders(
    "a7_top_buyer",
    lambda t: statistics.top_counts(t, 1, "entidad_compradora"),
    f"SELECT entidad_compradora, {COUNT} FROM tenders WHERE entidad_compradora IS NOT NULL GROUP BY 1 ORDER BY cantidad DESC, 1 LIMIT 1",
)
on_tenders(
    "a8_last_capture",
    statistics.last_capture,
    f"SELECT fuente, {STAMP.format('MAX(fecha_captura)')} AS ultima_actualizacion FROM tenders GROUP BY 1",
)
FACET = "SELECT '{0}' AS faceta, {0} AS valor, COUNT(*) AS cantidad FROM tenders WHERE {0} IS NOT NULL GROUP BY 2"
on_tenders("a9_facets", statistics.facets, " UNION ALL ".join(FACET.format(c) for c in statistics.FACETS))
on_tenders(
    "a1_a8_statistics_page",
    statistics.general_report,
    "SELECT *, NULL AS momento FROM ("
    + " UNION ALL ".join(FACET.format(c) for c in ("fuente", "estado", "entidad_federativa", "tipo_contratacion"))
    + " UNION ALL SELECT 'total', NULL, COUNT(*) FROM tenders"
    + " UNION ALL SELECT 'con_municipio', NULL, COUNT(municipio) FROM tenders"
    + " UNION ALL SELECT 'con_datos_especificos', NULL, COUNT(datos_especificos) FROM tenders"
    + " UNION ALL (SELECT 'entidad_compradora', entidad_compradora, COUNT(*) FROM tenders WHERE entidad_compradora IS NOT NULL GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 1)"
    + f") x UNION ALL SELECT 'ultima_actualizacion', fuente, NULL, {STAMP.format('MAX(fecha_captura)')} FROM tenders GROUP BY fuente",
)
on_tenders(
    "a10_top_buyers",
    lambda t: statistics.top_counts(t, 100, "entidad_compradora"),
    f"SELECT entidad_compradora, {COUNT} FROM tenders WHERE entidad_compradora IS NOT NULL GROUP BY 1 ORDER BY cantidad DESC, 1 LIMIT 100",
)
on_tenders(
    "a11_state_facet",
    statistics.state_facet,
    f"SELECT entidad_federativa, {COUNT}, COUNT(DISTINCT municipio) AS municipios_unicos FROM tenders WHERE entidad_federativa IS NOT NULL GROUP BY 1",
)
on_tenders(
    "a12_top_towns",
    statistics.town_facet,
    f"SELECT municipio, entidad_federativa, {COUNT} FROM tenders WHERE municipio IS NOT NULL GROUP BY 1, 2 "
    "ORDER BY cantidad DESC, 1 NULLS FIRST, 2 NULLS FIRST LIMIT 50",
)
on_tenders(
    "a13_geographic_coverage",
    statistics.geographic_coverage,
    "SELECT COUNT(DISTINCT entidad_federativa) AS estados_con_datos, COUNT(DISTINCT municipio) AS municipios_con_datos, "
    "COUNT(entidad_federativa) AS licitaciones_con_estado, COUNT(municipio) AS licitaciones_con_municipio, COUNT(*) AS total_licitaciones FROM tenders",
)
on_tenders(
    "a14_coverage_percent",
    statistics.coverage_percent,
    "SELECT CAST((COUNT(entidad_federativa) * 2000 + COUNT(*)) // (2 * COUNT(*)) AS DOUBLE) / 10 AS porcentaje_cobertura FROM tenders",
)
on_tenders(
    "a15_analysis_by_state",
    analysis.by_state,
    f"""SELECT entidad_federativa, COUNT(*) AS total_licitaciones, COUNT(DISTINCT entidad_compradora) AS entidades_unicas,
    COUNT(DISTINCT tipo_contratacion) AS tipos_contratacion, COUNT(DISTINCT municipio) AS municipios_unicos, {SUM}, {MEAN}, {MAX},
    MIN(fecha_publicacion) AS primera_licitacion, MAX(fecha_publicacion) AS ultima_licitacion, COUNT(DISTINCT fuente) AS fuentes_datos
    FROM tenders WHERE entidad_federativa IS NOT NULL GROUP BY 1""",
)
on_tenders(
    "a16_towns_of_state",
    lambda t: analysis.towns_of_state(t, "ASIA"),
    f"""SELECT municipio, {COUNT}, {SUM}, {MEAN}, COUNT(DISTINCT entidad_compradora) AS entidades_unicas,
    COUNT(DISTINCT tipo_contratacion) AS tipos_contratacion FROM tenders
    WHERE entidad_federativa = 'ASIA' AND municipio IS NOT NULL GROUP BY 1""",
)
on_tenders(
    "a17_state_summary",
    lambda t: analysis.state_summary(t, "ASIA"),
    f"SELECT COUNT(*) AS total, COUNT(DISTINCT municipio) AS municipios_totales, {SUM}, {MEAN} FROM tenders WHERE entidad_federativa = 'ASIA'",
)
on_tenders(
    "a18_national_distribution",
    analysis.national_distribution,
    f"""SELECT entidad_federativa, cantidad, monto_total, monto_promedio, municipios_activos,
    CAST((cantidad * 20000 + total) // (2 * total) AS DOUBLE) / 100 AS porcentaje_nacional FROM (
    SELECT entidad_federativa, {COUNT}, {SUM}, {MEAN}, COUNT(DISTINCT municipio) AS municipios_activos,
    CAST(SUM(COUNT(*)) OVER () AS BIGINT) AS total FROM tenders WHERE entidad_federativa IS NOT NULL GROUP BY 1) x""",
)
on_tenders(
    "a19_by_contract_type",
    analysis.by_contract_type,
    f"""SELECT tipo_contratacion, {COUNT}, {SUM}, {MEAN}, {MAX}, {MIN}, COUNT(DISTINCT entidad_compradora) AS entidades_unicas,
    COUNT(DISTINCT entidad_federativa) AS estados_involucrados FROM tenders WHERE tipo_contratacion IS NOT NULL GROUP BY 1""",
)
BUYERS = """SELECT entidad_compradora, COUNT(*) AS cantidad_licitaciones, {sums},
    COUNT(DISTINCT tipo_contratacion) AS tipos_contratacion, COUNT(DISTINCT tipo_procedimiento) AS tipos_procedimiento,
    COUNT(DISTINCT entidad_federativa) AS estados_cobertura, MIN(fecha_publicacion) AS primera_licitacion,
    MAX(fecha_publicacion) AS ultima_licitacion FROM tenders WHERE entidad_compradora IS NOT NULL{more}
    GROUP BY 1 ORDER BY cantidad_licitaciones DESC, 1 LIMIT {n}"""
on_tenders("a20_by_buyer", analysis.by_buyer, BUYERS.format(sums=f"{SUM}, {MEAN}", more="", n=20))
on_tenders(
    "a20_by_buyer_of_state",
    lambda t: analysis.by_buyer(t, 100, "AFRICA"),
    BUYERS.format(sums=f"{SUM}, {MEAN}", more=" AND entidad_federativa = 'AFRICA'", n=100),
)
on_tenders(
    "a21_by_source",
    analysis.by_source,
    f"""SELECT fuente, COUNT(*) AS total_licitaciones, COUNT(DISTINCT entidad_compradora) AS entidades_unicas,
    COUNT(DISTINCT tipo_contratacion) AS tipos_contratacion, COUNT(DISTINCT entidad_federativa) AS estados_cubiertos,
    COUNT(DISTINCT municipio) AS municipios_cubiertos, COUNT(entidad_federativa) AS con_estado, COUNT(municipio) AS con_municipio,
    COUNT(*) FILTER (WHERE monto_estimado > 0) AS con_monto, {SUM}, {MEAN}, MIN(fecha_publicacion) AS fecha_mas_antigua,
    MAX(fecha_publicacion) AS fecha_mas_reciente, {STAMP.format('MAX(fecha_captura)')} AS ultima_actualizacion FROM tenders GROUP BY 1""",
)
PERIODS = """SELECT {period} AS periodo, COUNT(*) AS cantidad, {total}, COUNT(DISTINCT entidad_compradora) AS entidades_unicas,
    COUNT(DISTINCT fuente) AS fuentes, COUNT(DISTINCT entidad_federativa) AS estados_involucrados FROM tenders
    WHERE fecha_publicacion >= CAST(DATE '{as_of}' - INTERVAL 1 YEAR AS DATE){more} GROUP BY 1"""
for grain, form in {"dia": "%Y-%m-%d", "semana": "%Y-%V", "mes": "%Y-%m", "año": "%Y"}.items():
    on_tenders(
        f"a22_over_time_{grain.replace('ñ', 'n')}",
        lambda t, grain=grain: analysis.over_time(t, grain, as_of=AS_OF),
        PERIODS.format(period=f"strftime(fecha_publicacion, '{form}')", total=SUM, as_of=AS_OF, more=""),
    )
on_tenders(
    "a22_over_time_of_state",
    lambda t: analysis.over_time(t, "mes", "EUROPE", AS_OF),
    PERIODS.format(period="strftime(fecha_publicacion, '%Y-%m')", total=SUM, as_of=AS_OF, more=" AND entidad_federativa = 'EUROPE'"),
)
CUMULATIVE = """SELECT mes, cantidad, CAST(SUM(cantidad) OVER (ORDER BY mes) AS BIGINT) AS acumulado{more} FROM (
    SELECT strftime(fecha_publicacion, '%Y-%m') AS mes, COUNT(*) AS cantidad FROM tenders WHERE year(fecha_publicacion) = 1998 GROUP BY 1) x"""
on_tenders("a23_cumulative", lambda t: analysis.cumulative(t, 1998), CUMULATIVE.format(more=""))
on_tenders(
    "x28_month_labels",
    lambda t: analysis.cumulative_labels(t, 1998),
    CUMULATIVE.format(
        more=", list_extract(['Ene','Feb','Mar','Abr','May','Jun','Jul','Ago','Sep','Oct','Nov','Dic'], CAST(substr(mes, 6) AS INT)) || ' ' || substr(mes, 3, 2) AS etiqueta"
    ),
)
on_tenders(
    "a24_top_or_default",
    lambda t: statistics.top_or_default(t, "tipo_contratacion"),
    f"SELECT tipo_contratacion, {COUNT} FROM tenders WHERE tipo_contratacion IS NOT NULL GROUP BY 1 ORDER BY cantidad DESC, 1 LIMIT 1",
)
on_tenders(
    "a24_default_of_nothing",
    lambda t: statistics.top_or_default(t.filter("fuente = 'ninguna'"), "entidad_compradora"),
    "SELECT 'No disponible' AS entidad_compradora, COUNT(*) AS cantidad FROM tenders WHERE fuente = 'ninguna'",
)
on_tenders(
    "a25_detail_coverage",
    statistics.detail_coverage,
    "SELECT COUNT(*) FILTER (WHERE id % 12 = 0) AS comprasmx_con_detalles, COUNT(*) AS comprasmx_total, "
    "CAST(COUNT(*) FILTER (WHERE id % 12 = 0) AS DOUBLE) / COUNT(*) * 100 AS porcentaje_detalles_comprasmx FROM tenders WHERE fuente = 'ComprasMX'",
)


def library_statistics(t):
    stats = statistics.library_statistics(t)
    maps = ["por_fuente", "por_estado", "por_entidad_federativa"]
    text = [F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias(c) for c in maps]
    return stats.select("total", *text, "comprasmx_con_detalles", "comprasmx_total", "porcentaje_detalles_comprasmx")


def _pairs(column, more=""):
    return (
        f"(SELECT string_agg({column} || '=' || CAST(n AS VARCHAR), ',' ORDER BY {column}) FROM (SELECT {column}, COUNT(*) AS n "
        f"FROM tenders WHERE {column} IS NOT NULL GROUP BY 1{more}) y)"
    )


on_tenders(
    "a26_library_statistics",
    library_statistics,
    f"""SELECT COUNT(*) AS total, {_pairs('fuente')} AS por_fuente, {_pairs('estado')} AS por_estado,
    {_pairs('entidad_federativa', ' ORDER BY n DESC, 1 LIMIT 10')} AS por_entidad_federativa,
    COUNT(*) FILTER (WHERE id % 12 = 0) AS comprasmx_con_detalles, COUNT(*) FILTER (WHERE id % 4 = 0) AS comprasmx_total,
    CAST(COUNT(*) FILTER (WHERE id % 12 = 0) AS DOUBLE) / COUNT(*) FILTER (WHERE id % 4 = 0) * 100 AS porcentaje_detalles_comprasmx FROM tenders""",
)
on_tenders(
    "a40_dashboard_rollup",
    analysis.dashboard_rollup,
    """SELECT CAST(SUM(n) AS BIGINT) AS total_licitaciones, CAST(SUM(b) AS BIGINT) AS entidades_suma, CAST(SUM(m) AS BIGINT) AS con_monto,
    (SELECT COUNT(DISTINCT entidad_compradora) FROM tenders) AS entidades_distintas,
    (SELECT COUNT(DISTINCT tipo_contratacion) FROM tenders) AS tipos_contratacion FROM (
    SELECT fuente, COUNT(*) AS n, COUNT(DISTINCT entidad_compradora) AS b, COUNT(*) FILTER (WHERE monto_estimado > 0) AS m FROM tenders GROUP BY 1) x""",
)
on_tenders(
    "a40_share_of_top_type",
    analysis.relative_to_top,
    """SELECT tipo_contratacion, cantidad, CAST(cantidad AS DOUBLE) / MAX(cantidad) OVER () * 100 AS ancho FROM (
    SELECT tipo_contratacion, COUNT(*) AS cantidad FROM tenders WHERE tipo_contratacion IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8) x""",
)
on_tenders(
    "a44_status_overview",
    statistics.status_overview,
    """SELECT 'fuente' AS seccion, fuente AS clave, COUNT(*) AS cantidad FROM tenders GROUP BY 2
    UNION ALL SELECT 'estados', 'distintos', COUNT(DISTINCT entidad_federativa) FROM tenders
    UNION ALL (SELECT 'entidad', entidad_federativa, COUNT(*) AS cantidad FROM tenders WHERE entidad_federativa IS NOT NULL GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 5)""",
)

# --- cursors and freshness ----------------------------------------------------------------------------------------

on_tenders(
    "a30_added_since",
    lambda t: freshness.added_since(t, "2001-07-01 00:00:00"),
    "SELECT fuente, COUNT(*) AS nuevos FROM tenders WHERE fecha_captura >= TIMESTAMP '2001-07-01 00:00:00' GROUP BY 1",
)
on_tenders(
    "a31_last_cursor",
    freshness.last_cursor,
    """SELECT fuente, first(cursor ORDER BY fecha_captura DESC, cursor DESC) AS cursor, MAX(fecha_publicacion) AS ultima_publicacion
    FROM (SELECT *, COALESCE(uuid_procedimiento, numero_procedimiento) AS cursor FROM tenders) x GROUP BY 1""",
)
on_tenders(
    "a32_processed_on_day",
    lambda t: freshness.processed_on(t, "2001-07-31"),
    "SELECT fuente, bool_or(CAST(fecha_captura AS DATE) = DATE '2001-07-31') AS procesado_hoy FROM tenders GROUP BY 1 UNION ALL SELECT 'TIANGUIS_ZIP', false",
)
on_tenders(
    "a33_last_processing",
    freshness.last_processing,
    f"SELECT fuente, {STAMP.format('MAX(fecha_captura)')} AS ultimo_proceso, {COUNT} FROM tenders GROUP BY 1 UNION ALL SELECT 'TIANGUIS_ZIP', NULL, 0",
)
for label, moment in {"tuesday_morning": "2001-07-31 09:30:00", "sunday": "2001-08-12 12:00:00"}.items():
    on_tenders(
        f"t7_freshness_{label}",
        lambda t, moment=moment: freshness.report(t, moment),
        f"""SELECT fuente, {STAMP.format('ultimo')} AS ultimo_proceso, registros_24h, procesado_hoy, horas_desde, ejecutar,
        CASE WHEN NOT ejecutar THEN CASE WHEN fuente = 'DOF' THEN 'No es martes/jueves o ya procesado'
          ELSE 'Ejecutado hace ' || printf('%.1f', horas_desde) || 'h (< 6h)' END END AS razon FROM (
        SELECT *, CASE WHEN fuente = 'DOF' THEN dayofweek(ahora) IN (2, 4) AND hour(ahora) IN (9, 21) AND NOT procesado_hoy
          WHEN fuente = 'SITIOS_MASIVOS' THEN dayofweek(ahora) = 0 AND floor(horas_desde / 24) >= 7
          ELSE horas_desde >= 6 END AS ejecutar FROM (
        SELECT fuente, TIMESTAMP '{moment}' AS ahora, MAX(fecha_captura) AS ultimo,
          COUNT(*) FILTER (WHERE fecha_captura >= TIMESTAMP '{moment}' - INTERVAL 24 HOUR) AS registros_24h,
          bool_or(CAST(fecha_captura AS DATE) = CAST(TIMESTAMP '{moment}' AS DATE)) AS procesado_hoy,
          CAST(epoch_us(TIMESTAMP '{moment}') - epoch_us(MAX(fecha_captura)) AS DOUBLE) / 3600000000 AS horas_desde
        FROM tenders GROUP BY 1) x) y UNION ALL SELECT 'TIANGUIS_ZIP', NULL, 0, false, NULL, true, NULL""",
    )
on_tenders(
    "t7_freshness_sources_that_never_ran",
    lambda t: freshness.report(t.filter("fuente = 'DOF'"), "2001-08-12 12:00:00"),
    f"""SELECT 'DOF' AS fuente, {STAMP.format('MAX(fecha_captura)')} AS ultimo_proceso,
    COUNT(*) FILTER (WHERE fecha_captura >= TIMESTAMP '2001-08-11 12:00:00') AS registros_24h, false AS procesado_hoy,
    CAST(epoch_us(TIMESTAMP '2001-08-12 12:00:00') - epoch_us(MAX(fecha_captura)) AS DOUBLE) / 3600000000 AS horas_desde, false AS ejecutar,
    'No es martes/jueves o ya procesado' AS razon FROM tenders WHERE fuente = 'DOF'
    UNION ALL SELECT unnest(['ComprasMX', 'Tianguis Digital', 'TIANGUIS_ZIP', 'SITIOS_MASIVOS']), NULL, 0, false, NULL, true, NULL""",
)

# --- windows, pages ------------------------------------------------------------------------------------------------

on_tenders(
    "w2_ranked_buyers",
    lambda t: analysis.ranked_buyers(t, 50).select("entidad_compradora", "cantidad_licitaciones", F.col("posicion").cast("long").alias("posicion")),
    """SELECT entidad_compradora, cantidad_licitaciones, ROW_NUMBER() OVER (ORDER BY cantidad_licitaciones DESC, entidad_compradora) AS posicion
    FROM (SELECT entidad_compradora, COUNT(*) AS cantidad_licitaciones FROM tenders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50) x""",
)
on_tenders(
    "w4_first_wins",
    lambda t: windows.first_per_key(t, ["entidad_compradora", "tipo_contratacion"], ["id"]).select("id", "entidad_compradora", "tipo_contratacion"),
    "SELECT MIN(id) AS id, entidad_compradora, tipo_contratacion FROM tenders GROUP BY 2, 3",
)
on_tenders(
    "w5_cap_per_group",
    lambda t: windows.top_per_key(t, ["entidad_compradora"], ["id"], 10).select("id", "entidad_compradora"),
    "SELECT id, entidad_compradora FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY entidad_compradora ORDER BY id) AS rn FROM tenders) x WHERE rn <= 10",
)
on_tenders(
    "w6_latest_per_key",
    lambda t: windows.latest_per_key(t, ["municipio"], [F.col("fecha_captura").desc(), F.col("id").desc()]).select("municipio", "id"),
    "SELECT municipio, first(id ORDER BY fecha_captura DESC, id DESC) AS id FROM tenders GROUP BY 1",
)
ORDER = "ORDER BY fecha_publicacion DESC NULLS FIRST, id DESC"
on_tenders(
    "l1_page",
    lambda t: paging.list_page(t, 3, 50, fuente="DOF"),
    f"SELECT {columns_sql(LIST_COLUMNS)} FROM tenders WHERE fuente = 'DOF' {ORDER} LIMIT 50 OFFSET 100",
)
on_tenders(
    "l1_deep_page",
    lambda t: paging.deep_page(t, 1200, 50).select("id", "fecha_publicacion"),
    f"SELECT id, fecha_publicacion FROM tenders {ORDER} LIMIT 50 OFFSET 1200",
)
on_tenders(
    "l1_page_after",
    lambda t: paging.page_after(t, "1998-06-15", 500, 50).select("id", "fecha_publicacion"),
    f"SELECT id, fecha_publicacion FROM tenders WHERE fecha_publicacion < DATE '1998-06-15' OR (fecha_publicacion = DATE '1998-06-15' AND id < 500) {ORDER} LIMIT 50",
)
on_tenders(
    "l2_page_info",
    lambda t: paging.page_info(t, 1, 50, fuente="DOF"),
    "SELECT COUNT(*) AS total, 1 AS page, 50 AS page_size, (COUNT(*) + 49) // 50 AS total_pages FROM tenders WHERE fuente = 'DOF'",
)
on_tenders(
    "l3_library_page",
    lambda t: paging.library_page(t, {"estado": "O"}, 100, 20).select("id", "fecha_publicacion"),
    f"SELECT id, fecha_publicacion FROM tenders WHERE estado = 'O' {ORDER} LIMIT 100 OFFSET 20",
)
on_tenders(
    "l4_top_k",
    lambda t: paging.top(t.select("id", "monto_estimado").filter("monto_estimado is not null"), 25, "monto_estimado", "id"),
    "SELECT id, CAST(monto_estimado AS DOUBLE) AS monto_estimado FROM tenders WHERE monto_estimado IS NOT NULL ORDER BY 2 DESC, id LIMIT 25",
)
on_tenders(  # which rows come is chance; that they are distinct, eligible and as many as asked for is not
    "l5_random_examples",
    lambda t: paging.parsed_examples(t, 3, seed=7).agg(
        F.count_distinct("id").alias("n"), F.bool_and((F.col("fuente") == "DOF") & (F.col("id") % 12 == 9)).alias("analizadas"),
        F.bool_and(F.col("entidad_federativa").isNotNull()).alias("con_entidad"),
    ),
    "SELECT least(3, COUNT(*)) AS n, true AS analizadas, true AS con_entidad FROM tenders WHERE fuente = 'DOF' AND id % 12 = 9 AND entidad_federativa IS NOT NULL",
)
on_tenders(
    "l6_parse_work_list",
    lambda t: paging.parse_work_list(t, limit=200).select("id", "fecha_captura"),
    f"SELECT id, {STAMP.format('fecha_captura')} AS fecha_captura FROM tenders WHERE fuente = 'DOF' AND id % 12 <> 9 ORDER BY tenders.fecha_captura DESC NULLS FIRST, id DESC LIMIT 200",
)
on_tenders(
    "u_1_union_of_sources",
    lambda t: t.filter("fuente = 'DOF'").select("id", "titulo")
    .unionByName(t.filter("fuente = 'ComprasMX'").select("titulo", "id", "municipio"), allowMissingColumns=True)
    .unionByName(t.filter("fuente = 'Tianguis Digital'").select("estado", "id"), allowMissingColumns=True)
    .unionByName(t.filter("fuente = 'SITIOS_MASIVOS'").select("id", "municipio", "titulo"), allowMissingColumns=True),
    """SELECT id, CASE WHEN fuente <> 'Tianguis Digital' THEN titulo END AS titulo, CASE WHEN fuente IN ('ComprasMX', 'SITIOS_MASIVOS') THEN municipio END AS municipio,
    CASE WHEN fuente = 'Tianguis Digital' THEN estado END AS estado FROM tenders""",
)
on_tenders(
    "u_2_unseen_keys",
    lambda t: windows.unseen(t.select("entidad_compradora"), t.filter("fuente = 'DOF'"), "entidad_compradora"),
    "SELECT DISTINCT entidad_compradora FROM tenders WHERE entidad_compradora NOT IN (SELECT entidad_compradora FROM tenders WHERE fuente = 'DOF')",
)
