"""Column functions on hand-written values: nulls, blanks, accents, invalid dates, odd amounts."""

from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from pregonero.functions import amounts, classify, dates, jsons, keys, places, text, urls


def test_text(values):
    assert values(text.normspace, [" a \n\t b c ", "", None]) == ["a b c", "", None]
    assert values(text.title_case, ["SAN JOSÉ-del ñandú o'neil 3er", "", None]) == ["San José-Del Ñandú O'Neil 3Er", "", None]
    assert values(text.capitalise_words, ["  río   VERDE ", None]) == ["Río Verde", None]
    assert values(text.is_upper, ["ÁREA 5", "Área", "123", ""]) == [True, False, False, False]
    assert values(lambda c: text.first_filled(c, F.lit(""), F.lit("z")), ["", None, "a"]) == ["z", "z", "a"]
    assert values(lambda c: text.grab(c, r"(\d+)x"), ["12x", "x", None]) == ["12", None, None]


def test_portal_date(values):
    got = values(
        dates.portal_date,
        ["2025-08-05T10:00:00Z", "5/8/2025 09:00", "2025-08-05 10:00", "-", " ", None, "31/02/2025", "2025-08-05Tx", "texto", "05/08/25"],
    )
    d = date(2025, 8, 5)
    assert got == [d, d, d, None, None, None, None, None, None, None]


def test_gazette_date(values):
    got = values(
        dates.gazette_date,
        ["05/08/2025, 10:00 horas", "5 de agosto de 2025", "10:00 horas, 5 Ago. 2025", "2025-08-05 10:00", "5/8/2025 hrs",
         "12 de brumario de 2025", "31/02/2025, 10:00", "", None, "5 de septiembre de 2025 en CompraNet"],
    )
    d = date(2025, 8, 5)
    assert got == [d, d, d, d, d, date(2025, 1, 12), None, None, None, date(2025, 9, 5)]


def test_event_timestamp(values):
    got = values(
        dates.event_timestamp,
        ["20/08/2025, a las 10:30", "12 de agosto de 2025", "14/agosto/2025 11:00 hrs", "12 DE AGOSTO DE 2025 11:00 HORAS", "31/02/2025",
         "12 de ago de 2025", "20-08-2025 9:05", "20/08/2025 25:00", None],
    )
    assert got == ["2025-08-20 10:30:00", "2025-08-12 00:00:00", "2025-08-14 11:00:00", "2025-08-12 11:00:00", None, None,
                   "2025-08-20 09:05:00", None, None]


def test_date_parts(values):
    got = values(
        lambda c: F.concat_ws("|", *[dates.date_parts(c)[k] for k in ("fecha", "hora", "texto_original")]),
        ["el 5/8/2025, 9:30 horas", "10:00 horas, 5 Ago. 2025", "5 de agosto del 2025 a las 12:15", "5 Sept 2025", "por definir"],
    )
    assert got == ["2025-08-05|09:30|el 5/8/2025, 9:30 horas", "2025-08-05|10:00|10:00 horas, 5 Ago. 2025",
                   "2025-08-05|12:15|5 de agosto del 2025 a las 12:15", "2025-09-05||5 Sept 2025", "||por definir"]
    assert values(lambda c: dates.date_parts(c).isNull(), ["No aplica", "", None]) == [True, True, True]


def test_other_dates(values):
    assert values(dates.any_date, ["publicado 05/08/2025 aquí", "19 jul 2025", "3 septiembre 2025", "40/13/2025", None]) == [
        date(2025, 8, 5), date(2025, 7, 19), date(2025, 9, 3), None, None]
    assert values(dates.ocds_date, ["2025-08-05T00:00:00Z", "2025-08-05", "05/08/2025", "fecha de publicacion", None]) == [
        date(2025, 8, 5)] * 3 + [None, None]
    assert values(lambda c: dates.five_format_date(F.lit(None).cast("string"), c), ["05-08-2025", "2025-08-05T01:02:03Z", "5/8/2025", ""]) == [
        date(2025, 8, 5)] * 3 + [None]
    assert values(lambda c: dates.week_label(c.cast("date")), ["2024-12-30", "2025-01-06"]) == ["2024-01", "2025-02"]
    assert values(dates.month_label, ["2025-01", "1999-12", "x"]) == ["Ene 25", "Dic 99", None]


def test_amounts(values):
    D = Decimal
    assert values(amounts.portal_amount, ["$ 1,234.50", "1.2.3", "-5", "", None, "abc", "7"]) == [
        D("1234.50"), None, None, None, None, None, D("7.00")]
    assert values(amounts.ocds_amount, ["$1,000.5 MXN", "", None, "sin"]) == [D("1000.50"), None, None, None]
    assert values(amounts.site_amount, ["1,234,567.50", "1234,5", "1,234", "12,34,56", "", None, ","]) == [
        D("1234567.50"), D("1234.50"), D("1234.00"), D("123456.00"), None, None, None]
    assert values(amounts.amount_in_text, ["cuesta $ 1,500.00 netos", "unos 25 mdp", "nada", None]) == ["$ 1,500.00", "25 mdp", None, None]
    got = values(lambda c: amounts.nested_amount(F.parse_json(c)), ["5.5", '{"amount":7}', '{"x":1}', '"t"', "null"])
    assert got == [D("5.50"), D("7.00"), D("0.00"), None, None]


def test_json(values):
    cells = ['[{"id":1,"name":"A"}]', '{"amount":12.5}', "[1,2]", '{"z":1}', "null", "", None, "plano", "{roto", '["x"]']
    assert values(jsons.unwrap_cell, cells) == ["A", "12.5", "[1,2]", '{"z":1}', None, None, None, "plano", "{roto", "x"]
    merged = values(lambda c: jsons.merge(c, F.lit('{"b":{"n":null},"c":2}')), ['{"a":1,"b":"x"}', None])
    assert merged == ['{"a":1,"b":{"n":null},"c":2}', '{"b":{"n":null},"c":2}']
    assert values(lambda c: jsons.merge(F.lit('{"a":1}'), c), [None]) == ['{"a":1}']


def test_classes(values):
    assert values(classify.procedure_from_text, ["LICITACIÓN PÚBLICA 1", "Invitación", "otra", ""]) == [
        "LICITACION_PUBLICA", "INVITACION_3", "ADJUDICACION_DIRECTA", "ADJUDICACION_DIRECTA"]
    assert values(classify.portal_status, ["activo", "Sin postores", "anulado", "raro", None]) == [
        "VIGENTE", "DESIERTO", "CANCELADO", "VIGENTE", "VIGENTE"]
    assert values(classify.contract_by_score, ["obra y servicio", "suministro de equipo", "clave LS-12", "nada", "LO 5"]) == [
        "OBRA", "ADQUISICION", "SERVICIO", "No especificado", "OBRA"]
    assert values(classify.invitation_detail, ["invitación a tres", "INVITACION", "Adjudicación Directa", "x"]) == [
        "INVITACION_3_PERSONAS", "INVITACION", "ADJUDICACION_DIRECTA", "LICITACION_PUBLICA"]
    assert values(classify.release_method, ["open", "Open", "limited", None]) == [
        "LICITACION_PUBLICA", "ADJUDICACION_DIRECTA", "ADJUDICACION_DIRECTA", "ADJUDICACION_DIRECTA"]


def test_places(values):
    got = values(
        places.state_in_text,
        ["en La Paz, Baja California Sur.", "Puebla, México", "obras en MICHOACÁN", "Estado de México", "CIUDAD DE MÉXICO", "colimador", "México",
         "Veracruz de Ignacio de la Llave", "", None, "Hidalgo y Coahuila de Zaragoza"],
    )
    assert got == ["Baja California Sur", "Puebla", "Michoacán", "Estado de México", "Ciudad de México", None, "Estado de México", "Veracruz",
                   None, None, "Coahuila"]


def test_keys_and_links(values):
    assert values(keys.number_in_title, ["Licitación LA-009/2025 obra", "núm 123/2024", "ABC-1234", "No. 45.B fin", "sin"]) == [
        "LA-009/2025", "123/2024", "ABC-1234", "No. 45.B", None]
    assert values(keys.longest_code, ["LA-1 y LPN-0099", "nada"]) == ["LPN-0099", None]
    site = values(keys.stable_site_number, ["obra", "obra", "otra"])
    assert site[0] == site[1] != site[2] and site[0].startswith("SM-") and len(site[0]) == 27
    got = values(
        lambda c: urls.gazette_url(c, F.lit('{"fecha_ejemplar":""}'), F.lit("2025-01-02").cast("date")),
        ["https://dof.gob.mx/x", "http://a/05082025-MAT.pdf", "http://a/99992025-VES", None],
    )
    page = "https://dof.gob.mx/index_111.php?year=%s&month=%s&day=%s#gsc.tab=0"
    assert got == ["https://dof.gob.mx/x", page % ("2025", "08", "05"), page % ("2025", "01", "02"), page % ("2025", "01", "02")]
