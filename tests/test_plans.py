"""What the physical plans must show: pruned partitions and columns, pushed filters, top-k, no sort of everything."""

import pytest
from pyspark.sql import functions as F

from pregonero.functions import dates
from pregonero.operators import filters, gazette, paging, upsert
from pregonero.plans import analysis, statistics
from pregonero.schema import TENDER


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plan") / "t")
    row = {f.name: None for f in TENDER} | {"numero_procedimiento": "n", "fuente": "DOF", "hash_contenido": "h"}
    upsert.append_rows(spark.createDataFrame([tuple(row[f.name] for f in TENDER)], TENDER), path)
    return upsert.read_table(spark, path)


def plan(df):
    return df._jdf.queryExecution().toString()


def test_filters_reach_the_scan(table):
    text = plan(filters.filter_tenders(table, fuente="DOF", fecha_desde="2025-01-01", monto_min=5, tipo_contratacion=["OBRA"]).select("titulo"))
    assert "PartitionFilters: [isnotnull(fuente" in text and "(fuente" in text
    pushed = text[text.index("PushedFilters") :].split("\n")[0]
    assert "GreaterThanOrEqual(fecha_publicacion" in pushed and "EqualTo(tipo_contratacion" in pushed
    schema = text[text.index("ReadSchema") :].split("\n")[0]
    assert "titulo" in schema and "datos_originales" not in schema and "descripcion" not in schema


def test_reports_read_only_their_columns(table):
    schema = plan(analysis.by_state(table)).split("ReadSchema")[1].split("\n")[0]
    assert "monto_estimado" in schema and "titulo" not in schema and "datos_originales" not in schema


def test_pages_and_top_lists_are_top_k(table):
    with_id = table.withColumn("id", F.xxhash64("hash_contenido"))
    assert "TakeOrderedAndProject" in plan(paging.page(with_id, 2, 10))
    assert "TakeOrderedAndProject" in plan(statistics.top_counts(table, 10, "entidad_federativa"))


def test_all_facets_come_from_one_scan(table):
    physical = plan(statistics.facets(table)).split("== Physical Plan ==")[1]
    assert physical.count("FileScan") == 1


def test_a_text_is_cut_at_its_closing_formula_once(spark):
    texts = spark.createDataFrame([("x",)], "texto string")
    signed = gazette.with_signature(texts.repartition(1)).select("autoridad_firmante")
    assert signed._jdf.queryExecution().optimizedPlan().toString().count("ATENTAMENTE") == 1


def test_stored_events_and_places_are_taken_once(spark):
    rows = spark.createDataFrame([("a", "b")], "titulo string, descripcion string").repartition(1)
    text = gazette.parse_stored(rows).select("fechas_parseadas", "ubicacion_extraida", "info_tecnica")._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("misi[óo]n\\s+del\\s+Fallo") == 1 and text.count("(?iu)municipio") == 1 and text.count("(?isuUd)Volumen\\s+a?") == 1


def test_an_event_date_is_matched_and_taken_in_one_pass(spark):
    texts = spark.createDataFrame([("x",)], "c string").repartition(1)
    text = texts.select(dates.event_timestamp(F.col("c")).alias("r"))._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in text and text.count("regexp_replace(") == 2
