"""Readers on small files of every kind."""

import hashlib
import io
import json
import os
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pregonero.functions.jsons import field
from pregonero.operators.upsert import create_table, insert_if_absent, read_table, run_metrics
from pregonero.sources import files, ocds, portal, registry, rejects, sites

AS_OF = "2025-09-01"


def day():
    return F.lit(AS_OF).cast("date")


def put(folder, name, content):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content if isinstance(content, str) else json.dumps(content, ensure_ascii=False), encoding="utf-8")
    return path


def record(code, **more):
    return {"cod_expediente": code, "numero_procedimiento": f"LA-{code}", "nombre_procedimiento": "Compra", "siglas": "SALUD", **more}


def test_portal_envelopes(spark, tmp_path):
    put(tmp_path, "a.json", [record("1")])
    put(tmp_path, "b.json", {"data": [{"registros": [record("2"), record("3")]}], "registros": [record("x")]})
    put(tmp_path, "c.json", {"data": [record("4")]})
    put(tmp_path, "d.json", {"registros": [record("5")]})
    put(tmp_path, "e.json", {"licitaciones": [record("6")]})
    put(tmp_path, "f.json", {"expedientes": [record("7")]})
    put(tmp_path, "todos_expedientes_1.json", {"total_expedientes": 1, "expedientes": [record("8")], "registros": [record("x")]})
    put(tmp_path, "resumen_1.json", {"total_expedientes_capturados": 9, "expedientes": [record("x")]})
    put(tmp_path, "roto.json", "{no json")
    docs = files.documents(spark, str(tmp_path))
    got = portal.records(docs).select("file_name", "pos", field(F.col("rec"), "cod_expediente").alias("c"))
    assert sorted((r.file_name, r.pos, r.c) for r in got.collect()) == [
        ("a.json", 0, "1"), ("b.json", 0, "2"), ("b.json", 1, "3"), ("c.json", 0, "4"), ("d.json", 0, "5"), ("e.json", 0, "6"),
        ("f.json", 0, "7"), ("todos_expedientes_1.json", 0, "8")]
    assert [r.archivo for r in rejects.portal_rejects(docs).collect()] == ["roto.json"]


def test_portal_details_newest_wins_and_enrich(spark, tmp_path):
    put(tmp_path, "a.json", [record("1", descripcion="corta"), record("2"), {"numero_procedimiento": "", "cod_expediente": ""}])
    old = put(tmp_path, "detalles/detalle_9.json", {"codigo_expediente": "1", "url_completa_con_hash": "viejo"})
    put(tmp_path, "detalles/detalle_1.json", {"codigo_expediente": "1", "url_completa_con_hash": "nuevo", "informacion_extraida": {"descripcion_completa": "mucho más larga", "requisitos": ["r"]}})
    put(tmp_path, "detalles/detalle_2.json", {"codigo_expediente": "LA-2", "url_completa_con_hash": "por número"})
    put(tmp_path, "detalles/indice_detalles.json", {"total_detalles": 3})
    os.utime(old, (1, 1))
    source = registry.SOURCES["comprasmx"]
    rows = {r.numero_procedimiento: r for r in source.normalise(source.read(spark, str(tmp_path)), day()).collect()}
    assert sorted(rows) == ["LA-1", "LA-2"]
    assert rows["LA-1"].url_original == "nuevo" and rows["LA-1"].descripcion == "mucho más larga"
    assert rows["LA-2"].url_original == "por número"
    inner = json.loads(rows["LA-1"].datos_especificos)["detalle_individual"]
    assert inner["requisitos"] == ["r"] and inner["cronograma"] == [] and inner["procesado_exitosamente"] is False


def test_portal_amount_forms(spark):
    amounts = [5, 0, "0", "$ 1,000.5", None, "x", 12.345]
    recs = [(i, json.dumps(record(str(i), monto_estimado=a, presupuesto_estimado="7"))) for i, a in enumerate(amounts)]
    df = spark.createDataFrame(recs, "pos int, j string").select(F.lit("f").alias("file_name"), "pos", F.parse_json("j").alias("rec"))
    got = [r.monto_estimado for r in portal.normalise(df).orderBy("pos").collect()]
    assert [str(x) if x is not None else None for x in got] == ["5.00", "7.00", "0.00", "1000.50", "7.00", None, "12.35"]


def test_csv_with_json_cells_and_line_breaks(spark, tmp_path):
    head = "ocid,id,date,buyer/name,tender/id,tender/title,tender/description,tender/procurementMethod,tender/value/amount"
    rows = [
        'ocds-a-7,70,2025-08-05T00:00:00Z,"{""name"":""SEDUVI""}",77,"Obra, con\nsalto",null,open,"$1,000"',
        'ocds-a-8,x,05/08/2025,"[{""id"":""1"",""name"":""SOBSE""}]",,Servicio,"{""a"":1}",direct,',
        "ocds-a-9,9,,null,1,t,d,open,1",
    ]
    put(tmp_path, "x.csv", head + "\n" + "\n".join(rows) + "\n")
    got = ocds.normalise_csv(ocds.read_csv(spark, str(tmp_path)), day()).orderBy("numero_procedimiento").collect()
    assert [(r.numero_procedimiento, r.titulo, r.entidad_compradora) for r in got] == [("77", "Obra, con\nsalto", "SEDUVI"), ("ocds-a-8", "Servicio", "SOBSE")]
    assert str(got[0].fecha_publicacion) == str(got[1].fecha_publicacion) == "2025-08-05" and str(got[0].monto_estimado) == "1000.00"
    assert got[0].url_original.endswith("/proceso/77") and got[1].url_original.endswith("/proceso/8")
    assert got[0].descripcion is None and got[0].tipo_procedimiento == "LICITACION_PUBLICA"
    assert json.loads(got[0].datos_originales)["tender/id"] == "77"


def test_zip_forms(spark, tmp_path):
    body = json.dumps([{"ocid": "o-1", "buyer": "B", "tender": {"title": "T", "value": {"amount": 3, "currency": "USD"}}}])
    texts = {"plano": body, "cabecera": "HTTP/1.1 200\r\nA: b\r\n\r\n" + body, "doble": json.dumps(body), "entre_comillas": '"' + body + '"'}
    for name, text in texts.items():
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as z:
            z.writestr("otro.txt", "x")
            z.writestr("carpeta/no.json", "[]")
            z.writestr("si.json", text)
        (tmp_path / f"{name}.zip").write_bytes(buffer.getvalue())
    source = registry.SOURCES["zip"]
    got = source.normalise(source.read(spark, str(tmp_path)), day()).collect()
    assert sorted(r.file_name for r in got) == sorted(f"{n}.zip" for n in texts)
    assert {(r.numero_procedimiento, r.entidad_compradora, str(r.monto_estimado), r.moneda, r.fuente) for r in got} == {("o-1", "B", "3.00", "USD", "TIANGUIS_ZIP")}


def test_json_lines(spark, tmp_path):
    lines = ['{"Organismo":"O","Proyecto":"Licitación LP-1 obra","Monto":"1,5","localidad":"O","Vínculo":"http://a"}', "", "  ", "{roto",
             '{"source":"S","title":"T","doc_url":"ftp://x","jurisdiction":"J"}', '{"Organismo":"O"}']
    put(tmp_path, "a.jsonl", "\n".join(lines))
    put(tmp_path, "b.txt", lines[0])
    got = sites.normalise(sites.read_lines(spark, str(tmp_path)), day()).orderBy("titulo").collect()
    assert [(r.titulo, r.entidad_compradora, r.unidad_compradora, r.url_original) for r in got] == [
        ("Licitación LP-1 obra", "O", None, "http://a"), ("T", "S", "J", None)]
    assert got[0].numero_procedimiento == "LP-1" and str(got[0].monto_estimado) == "1.50" and str(got[0].fecha_publicacion) == AS_OF


def test_link_harvest(spark):
    html = """<html><body><script>var a='<a href="x.pdf">no</a>';</script><div><p>Publicado 19 jul 2025 <a href='/c.html'>Convocatoria <i>LPN-12</i></a></p>
    <p><a href="d.PDF?x=1"></a> 05/08/2025 y 19 jul 2025</p><a href="/otro">Otro</a><a>sin enlace</a><a href="/c.html">Convocatoria LPN-12</a></div></body>"""
    pages = spark.createDataFrame([(1, "https://s.example/a/b", html), (2, "https://s.example/", None)], "page_id long, url string, html string")
    got = sites.harvest(pages, F.lit("s"), F.lit("j")).orderBy("pos").collect()
    assert [(r.title, r.code, str(r.date), r.doc_url) for r in got] == [
        ("Convocatoria LPN-12", "LPN-12", "2025-07-19", "https://s.example/c.html"),
        ("https://s.example/a/d.PDF?x=1", None, "2025-08-05", "https://s.example/a/d.PDF?x=1"),
    ]
    late = sites.harvest(pages, F.lit("s"), F.lit("j"), since=F.lit("2025-08-01").cast("date"))
    assert [r.title for r in late.orderBy("pos").collect()] == ["https://s.example/a/d.PDF?x=1", "Convocatoria LPN-12"]


def test_listing_and_age_filter(spark, tmp_path):
    old = put(tmp_path, "viejo.json", "[]")
    put(tmp_path, "nuevo.json", "[]")
    os.utime(old, (1_000_000_000, 1_000_000_000))
    assert {r.file_name for r in files.listing(spark, str(tmp_path)).collect()} == {"viejo.json", "nuevo.json"}
    assert [r.stem for r in files.listing(spark, str(tmp_path), "*.json", "2020-01-01T00:00:00").collect()] == ["nuevo"]


def test_gazette_folder_prefers_improved(spark, tmp_path):
    rec = {"numero_licitacion": "IA-1", "dependencia": "D", "objeto_licitacion": "Obra Fallo mañana", "fecha_publicacion": "5 de agosto de 2025"}
    put(tmp_path, "05082025_MAT_licitaciones.json", {"licitaciones": [{**rec, "numero_licitacion": "viejo"}]})
    put(tmp_path, "05082025_MAT_licitaciones_mejorado.json",
        {"version_extractor": "2.0", "fecha_ejemplar": "2025-08-05", "licitaciones": [{**rec, "titulo": "Obra", "fecha_publicacion": {"fecha": "", "texto_original": "05/08/2025"}}]})
    put(tmp_path, "06082025_VES_licitaciones.json", [rec])
    source = registry.SOURCES["dof"]
    got = source.normalise(source.read(spark, str(tmp_path)), day()).orderBy("file_name").collect()
    assert [(r.numero_procedimiento, r.titulo, str(r.fecha_publicacion), r.tipo_procedimiento) for r in got] == [
        ("IA-1", "Obra", "2025-08-05", "INVITACION_3"), ("IA-1", "Obra", "2025-08-05", "INVITACION_3")]
    assert json.loads(got[0].datos_originales)["fecha_ejemplar"] == "2025-08-05"


def test_text_editions_without_a_stamp_take_the_day_given(spark, tmp_path):
    page = "===== [PÁGINA 1] =====\nINSTITUTO DE SALUD\nObjeto de la licitación: Obra\nLA-012-NBS-0045-N-17-2025\n" + "x" * 80 + " (R.- 1)"
    put(tmp_path, "05082025_MAT.txt", page)
    put(tmp_path, "suelta.txt", page)
    source = registry.SOURCES["dof_texto"]
    got = [json.loads(r.datos_originales) for r in source.normalise(source.read(spark, str(tmp_path)), day()).collect()]
    assert {r["archivo"]: r["fecha_ejemplar"] for r in got} == {"05082025_MAT": "2025-08-05", "suelta": AS_OF}


def test_all_sources_into_one_table(spark, tmp_path):
    """Landing folders -> table, twice: the second run inserts nothing."""
    put(tmp_path, "portal/a.json", [record("1", uuid_procedimiento="u1"), record("1", uuid_procedimiento="u1"), record("2")])
    put(tmp_path, "sitios/a.jsonl", '{"Organismo":"O","Proyecto":"Compra"}\n{"Organismo":"O","Proyecto":"Compra"}\n')
    put(tmp_path, "texto/05082025_MAT.txt", "===== [PÁGINA 1] =====\nINSTITUTO DE SALUD\nObjeto de la licitación: Obra\nLA-012-NBS-0045-N-17-2025\n" + "x" * 80 + " (R.- 1)")
    paths = {"comprasmx": f"{tmp_path}/portal", "sitios-masivos": f"{tmp_path}/sitios", "dof_texto": f"{tmp_path}/texto"}
    table = f"{tmp_path}/tabla"
    create_table(spark, table)
    first = insert_if_absent(registry.ingest_batch(spark, paths, day()), table)
    assert {r.fuente: (r.extraidos, r.insertados, r.duplicados) for r in run_metrics(first).collect()} == {
        "ComprasMX": (3, 2, 1), "SITIOS_MASIVOS": (2, 1, 1), "DOF": (1, 1, 0), "TOTAL": (6, 4, 2)}
    second = insert_if_absent(registry.ingest_batch(spark, paths, day()), table)
    assert run_metrics(second).filter("fuente = 'TOTAL'").first().insertados == 0
    assert read_table(spark, table).count() == 4


def test_unpacked_texts_are_passed_on_in_small_batches():
    texts = [json.dumps(["x" * 600_000, i]) for i in range(8)]
    archives = []
    for text in texts:
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("a.json", text)
        archives.append(buffer.getvalue())
    batch = pa.RecordBatch.from_arrays([pa.array([*"abcdefghi"]), pa.array([*archives, None], pa.binary())], ["file_name", "content"])
    out = list(ocds._first_json(iter([batch])))
    assert len(out) > 3 and all(b.nbytes < 2 * ocds.PACKED_BYTES for b in out)
    rows = [tuple(r.values()) for b in out for r in b.to_pylist()]
    assert rows == [*zip("abcdefgh", texts, [None] * 8), ("i", None, "archivo dañado: BadZipFile")]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables not present")
def test_portal_documents_lie_in_one_folder(spark, tmp_path, monkeypatch):
    from catalog import source_queries

    folder = tmp_path / "portal"
    monkeypatch.setattr(source_queries, "work_dir", lambda spark, label: f"file://{folder}")
    assert source_queries.portal_scan(spark, "/root/testdata/sf0.001").count() > 0
    assert not [p for p in folder.iterdir() if p.is_dir()]
    assert len(list(folder.glob("*.txt"))) == source_queries.view(spark, "/root/testdata/sf0.001", "portal_files").count()


def test_links_are_joined_as_the_standard_does():
    from urllib.parse import urljoin

    pages = [
        "https://a.example/lista/", "https://a.example/", "https://a.example", "http://a.example/x/y.html", "https://a.example//x/", "",
        "https://a.example/x/../y/", "https://a.example/x?y=/z/", "HTTPS://A.example/x/", "https://a.example/x.y/z", "ftp://a/x/", "a/b/c", None,
    ]
    links = [
        "/doc/1", "bases/2.html", "x", "../x", "./x", "//b.example/x", "/x/../y", "x?y", "#z", "", "/", "x/", "a//b", "mailto:x@y", "x.tar.gz",
        "é", ".html", "x.", " x", "/x\n",
    ]
    for page in pages:
        join = sites._joiner(page)
        assert [join(x) for x in links] == [urljoin(page, x) for x in links], page


def test_tags_with_quotes_and_open_ends():
    page = (
        """<ul><li><a class='x>y' href="/1">uno</a> 03/04/2024 <p>más</li></ul></i><a title="a 'b' > c" href='/5'>cinco</b></a></p>"""
        """<a href='/6>seis</a>"""
    )
    assert sites._anchors(page) == [("/1", "uno", "03/04/2024"), ("/5", "cinco", "03/04/2024")]


def test_recent_documents_are_files_of_one_folder(spark, monkeypatch):
    from catalog import source_queries

    texts = [f'[{{"n":{i}}}]' for i in range(12)]
    docs = spark.createDataFrame([(f"captura_{i}.json", t) for i, t in enumerate(texts)], "file_name string, text string")
    read, documents = [], files.documents
    monkeypatch.setattr(source_queries, "view", lambda *a: docs)
    monkeypatch.setattr(files, "documents", lambda spark, path, *a, **b: read.append(path) or documents(spark, path, *a, **b))
    found = source_queries.recent_documents(spark, "unused").collect()
    assert sorted(r.h for r in found) == sorted(hashlib.md5(t.encode()).hexdigest() for t in texts)
    folder = read[0].removeprefix("file://").removeprefix("file:")
    assert len([f for f in os.listdir(folder) if f.endswith(".txt")]) == 12 and not any(e.is_dir() for e in os.scandir(folder))
