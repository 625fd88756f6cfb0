"""Gazette pages, blocks and notices on small synthetic texts."""

import random
import re

from pyspark.sql import functions as F

from pregonero.functions import dates
from pregonero.functions.places import state_in_text
from pregonero.functions.text import grab
from pregonero.operators import gazette, gazette_patterns as P
from pregonero.sources import sinks

NOTICE = """SECRETARÍA DE SALUD PÚBLICA
DIRECCIÓN GENERAL DE RECURSOS
RESUMEN DE CONVOCATORIA
Licitación Pública Internacional No. LA - 012-NBS -- 0045-N-17-2025
Objeto de la licitación: Servicio de limpieza Volumen a adquirir 1,200 piezas
Volumen a adquirir: 1,200 piezas de limpieza
Fecha de publicación en Compras MX: 05/08/2025
Junta de aclaraciones: 12/08/2025, 10:30
Visita a las instalaciones: No habrá
Presentación y apertura de proposiciones: 20 de agosto de 2025
Fallo: 31/02/2025
en el municipio de SAN JUAN del RÍO, Querétaro. Ubicado en Calle Real 5, Centro.
La reducción de plazos fue
autorizada por el Titular del Área, hoy
"""


def blocks(spark, *texts):
    rows = [("e", "2025-08-05", "MAT", 1, i, t, "777") for i, t in enumerate(texts)]
    return spark.createDataFrame(
        rows, "archivo string, fecha_ejemplar string, edicion_ejemplar string, pagina int, bloque int, texto string, referencia string"
    )


def test_notice_fields(spark):
    n = gazette.extract_notices(blocks(spark, NOTICE)).first()
    assert n.numero_licitacion == "LA-012-NBS-0045-N-17-2025"
    assert (n.dependencia, n.subdependencia) == ("SECRETARÍA DE SALUD PÚBLICA", "DIRECCIÓN GENERAL DE RECURSOS")
    assert n.titulo == "Servicio de limpieza"
    assert n.descripcion.startswith("Volumen a adquirir 1,200 piezas")
    assert n.tipo_contratacion == "SERVICIO" and n.caracter_procedimiento == "Internacional"
    assert (n.entidad_federativa, n.municipio, n.direccion_completa) == ("Querétaro", "San Juan Del Río", "Calle Real 5, Centro")
    assert n.fecha_publicacion == "2025-08-05 00:00:00" and n.fecha_junta_aclaraciones == "2025-08-12 10:30:00"
    assert n.fecha_visita_instalaciones is None and n.fecha_fallo is None
    assert n.fecha_presentacion_apertura == "2025-08-20 00:00:00"
    assert (n.cantidad, n.unidad_medida) == ("1,200", "piezas")
    assert n.referencia == "(R.- 777)" and n.reduccion_plazos and n.autoridad_reduccion == "Titular del Área"
    # 3 critical fields, 3 dates, 3 technical fields
    assert n.confianza_extraccion == 0.84


def test_gate_and_canonical_row(spark):
    texts = ["sin nada " * 20, "INSTITUTO DE VIVIENDA\nObjeto de la licitación: Obra nueva\n" + "x" * 100, NOTICE]
    rows = gazette.to_canonical(gazette.extract_notices(blocks(spark, *texts))).orderBy("bloque").collect()
    assert [r.bloque for r in rows] == [1, 2]
    assert rows[0].numero_procedimiento == "" and rows[0].entidad_compradora == "INSTITUTO DE VIVIENDA"
    assert str(rows[1].fecha_publicacion) == "2025-08-05" and rows[1].estado == "Publicada" and rows[1].fuente == "DOF"


def test_pages_from_text_column(spark):
    df = spark.createDataFrame([("a", "pre ===== [PÁGINA 3] =====\nuno\n===== [PÁGINA 9] ===== dos"), ("b", "sin marcas")], "archivo string, texto string")
    got = {(r.archivo, r.pagina): r.contenido for r in gazette.split_pages(df).collect()}
    assert got == {("a", 3): "uno", ("a", 9): "dos", ("b", 1): "sin marcas"}


def test_pages_from_files(spark, tmp_path):
    (tmp_path / "05082025_MAT.txt").write_text("\n\n===== [PÁGINA 1] =====\nuno ñ\n\n\n===== [PÁGINA 2] =====\ndos\n", encoding="utf-8")
    (tmp_path / "suelto.txt").write_text("todo en una\npágina", encoding="utf-8")
    rows = gazette.read_pages(spark, str(tmp_path), F.lit("2025-01-01").cast("date")).collect()
    got = {(r.archivo, r.pagina): (r.contenido, r.fecha_ejemplar, r.edicion_ejemplar) for r in rows}
    assert got == {
        ("05082025_MAT", 1): ("uno ñ", "2025-08-05", "MAT"),
        ("05082025_MAT", 2): ("dos", "2025-08-05", "MAT"),
        ("suelto", 1): ("todo en una\npágina", "2025-01-01", "DESCONOCIDA"),
    }


def test_marked_text_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([("05082025_MAT", i, f"texto {i}\nlínea") for i in range(1, 40)], "archivo string, pagina int, contenido string")
    sinks.write_marked_text(pages, str(tmp_path / "out"))
    back = gazette.read_pages(spark, str(tmp_path / "out"), F.current_date())
    assert sorted((r.archivo, r.pagina, r.contenido) for r in back.collect()) == sorted(tuple(r) for r in pages.collect())


def test_call_range_variants(spark):
    head = "CONVOCATORIAS PARA CONCURSOS DE ADQUISICIONES, OBRAS ... "
    rows = [
        ("con_avisos", 2, head + "12\nAVISOS\nJUDICIALES ... 30"), ("con_avisos", 40, "fin"),
        ("sin_avisos", 3, head + "5"), ("sin_avisos", 22, "fin"),
        ("cuerpo", 1, "portada"), ("cuerpo", 11, "CONVOCATORIAS PARA CONCURSOS"), ("cuerpo", 15, "AVISOS"), ("cuerpo", 16, "x"),
        ("cuerpo_abierto", 11, "Convocatoria para concurso"), ("cuerpo_abierto", 14, "x"),
        ("nada", 1, "a"), ("nada", 7, "b"),
    ]
    df = spark.createDataFrame(rows, "archivo string, pagina int, contenido string")
    got = {r.archivo: (r.inicio, r.fin) for r in gazette.call_range(df).collect()}
    assert got == {"con_avisos": (12, 29), "sin_avisos": (5, 22), "cuerpo": (11, 14), "cuerpo_abierto": (11, 14), "nada": (1, 7)}


def test_block_split_keeps_references(spark):
    text = "a" * 120 + " (R.- 111)\n" + "b" * 120 + " (R.- 222)\n" + "corto (R.- 333)" + "c" * 120
    df = spark.createDataFrame([("e", 1, text)], "archivo string, pagina int, contenido string")
    got = [(r.referencia, r.texto.strip()[0]) for r in gazette.split_blocks(df).orderBy("bloque").collect()]
    assert got == [("111", "a"), ("222", "b"), (None, "c")]


def test_second_structurer(spark):
    text = NOTICE.replace("LA - 012-NBS -- 0045-N-17-2025", "LA-012-NBS-0045-N-17-2025").replace("SALUD PÚBLICA", "SALUD").replace(
        "DIRECCIÓN GENERAL", "DIRECCION GENERAL") + "\nMEXICO, CIUDAD DE MEXICO\nATENTAMENTE\nEL DIRECTOR\n"
    n = gazette.extract_notices_v2(blocks(spark, text)).first()
    assert n.numero_licitacion == "LA-012-NBS-0045-N-17-2025" and n.titulo == "Servicio de limpieza"
    assert n.dependencia == "SECRETARÍA DE SALUD" and n.subdependencia == "DIRECCION GENERAL DE RECURSOS"
    assert n.fecha_junta_aclaraciones.fecha == "2025-08-12" and n.fecha_junta_aclaraciones.hora == "10:30"
    assert n.confianza_extraccion == 1.0 and n.campos_faltantes == [] and n.autoridad_firmante == "EL DIRECTOR"
    assert gazette.extract_notices_v2(blocks(spark, "Descripción: algo\n" + "x" * 100)).count() == 0


def test_stored_row_parse(spark):
    rows = spark.createDataFrame(
        [(1, "Obra vial Volumen a adquirir 50 piezas Los detalles se determinan en la convocatoria",
          "En la ciudad de LÓPEZ MATEOS, estado de México. Visita al sitio de los trabajos No habrá visita. Fallo 05/08/2025, a las 9:00"),
         (2, None, None)],
        "id int, titulo string, descripcion string",
    )
    a, b = gazette.parse_stored(rows).orderBy("id").collect()
    assert a.titulo_limpio == "Obra vial" and a.descripcion_completa.startswith("Volumen a adquirir 50")
    assert a.fechas_parseadas.visita_sitio == "No aplica" and a.fechas_parseadas.fallo == "2025-08-05 09:00:00"
    assert (a.entidad_parseada, a.municipio_parseado) == ("Estado de México", "López Mateos")
    assert a.info_tecnica.cantidad == "50" and a.info_tecnica.unidad == "pieza" and a.info_tecnica.visita_requerida is False
    assert b.titulo_limpio in ("", None) and b.entidad_parseada is None


def test_answers(spark):
    one = '{"numero_procedimiento":"LA-1","titulo":"t"}'
    rows = [("f", 1, f"[{one}]"), ("f", 2, f"```json\n[{one},{one}]\n```"), ("f", 3, one), ("f", 4, "nada"), ("f", 5, f"x [{one}] y"), ("f", 6, "[roto")]
    got = gazette.answer_records(spark.createDataFrame(rows, "file string, page int, answer string"))
    assert sorted((r.page, r.pos) for r in got.collect()) == [(1, 0), (2, 0), (2, 1), (3, 0), (5, 0)]


def test_the_first_letter_of_a_label_is_spelt_out(values):
    assert P.quick("Fallo") == "(?-i:[Ff])allo" and P.EVENTS["fecha_fallo"].startswith("(?iuU)(?=(?-i:[EeFf]))")
    texts = ["FALLO: 1/2/2024", "emiſión del fallo 3-4-2025 10:30", "Emisión de Fallo: 5 de mayo de 2024", "allo 1/2/2024"]
    assert values(lambda c: grab(c, P.EVENTS["fecha_fallo"]), texts) == ["1/2/2024", "3-4-2025 10:30", "5 de mayo de 2024", None]
    assert values(state_in_text, ["en SİNALOA.", "ſonora", "xSonora, Pueblas", "NUEVO LEON y México", "Estado de méxico"]) == [
        None, "Sonora", None, "Nuevo León", "Estado de México"]
    moments = ["31/02/2024", "5 de Mayo de 2024, a las 9:05", "1/1/2024 24:00", "٣ de mayo de 2024", "29-2-2024"]
    assert values(dates.event_timestamp, moments) == [None, "2024-05-05 09:05:00", None, None, "2024-02-29 00:00:00"]


def test_an_address_is_looked_for_once(spark):
    text = F.concat(F.lit("ubicado en Avenida Central "), F.col("id").cast("string"), F.lit(", Puebla."))
    df = gazette.with_location(spark.range(12, 13).select(text.alias("texto")))
    assert df.first().direccion_completa == "Avenida Central 12, Puebla"
    assert df._jdf.queryExecution().optimizedPlan().toString().count("bicad(?:o|a)") == 1


def test_a_look_at_two_letters_changes_no_match(values):
    patterns = [P.SIGNATURE, P.OBJECT_2, P.OBJECT_END_2, P.EVENTS["fecha_presentacion_apertura"], P.EVENTS["fecha_fallo"]]
    rng = random.Random(1)
    words = ["EL", "la", "Jefe", "DIRECTORA", "ſufragio", "SUFRAGIO", "efectivo", "atentamente", "objeto de la licitación", "Descripcion", "vıſita", "VİSITA", "a",
             "Fecha de publicaci", "junta de", "PRESENTACIÓN", "y", "Apertura de las proposiciones:", "emiſión del", "Fallo", ": 01/02/2025", "no", "de"]
    texts = [rng.choice(["", " ", "\n"]).join(rng.choice(words) + " " for _ in range(12)) for _ in range(300)]
    for pattern in patterns:
        plain = re.sub(r"\(\?=\(\?-i:\[[^]]*\]\)\)\(\?=\.\(\?-i:\[[^]]*\]\)\)", "", pattern)
        assert plain != pattern
        want, got = (values(lambda c, p=p: F.regexp_replace(c, p, "#"), texts) for p in (plain, pattern))
        assert got == want and want != texts
