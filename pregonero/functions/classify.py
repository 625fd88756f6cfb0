"""Class expressions (CASE rules) for procedures, contracts, status and character."""

from __future__ import annotations

from functools import reduce
from os.path import commonprefix

from pyspark.sql import Column, functions as F

from .text import constant_array, constant_map, first_filled, let

# Words that decide a class.
PROCEDURE_WORDS = {
    "LICITACION_PUBLICA": ["licitación pública", "licitacion publica", "art.30"],
    "INVITACION_3": ["invitación", "invitacion", "art.54"],
}
CONTRACT_WORDS = {
    "SERVICIOS": ["servicio", "mantenimiento", "consultoría"],
    "OBRA_PUBLICA": ["obra", "construcción", "infraestructura"],
}
PORTAL_PROCEDURE_WORDS = {
    "LICITACION_PUBLICA": ["LICITACIÓN PÚBLICA", "LICITACION PUBLICA"],
    "INVITACION_3": ["INVITACIÓN", "INVITACION"],
    "ADJUDICACION_DIRECTA": ["ADJUDICACIÓN", "ADJUDICACION"],
}
PORTAL_CONTRACT_WORDS = {"SERVICIOS": ["SERVICIO"], "OBRA_PUBLICA": ["OBRA"]}
PORTAL_STATUS_WORDS = {
    "VIGENTE": ["ACTIV", "VIGENTE", "ABIERTO", "PUBLICADO"],
    "CERRADO": ["CERRADO", "FINALIZADO", "CONCLUIDO"],
    "CANCELADO": ["CANCELADO", "ANULADO"],
    "DESIERTO": ["DESIERTO", "SIN POSTORES"],
}
OCDS_METHODS = {"open": "LICITACION_PUBLICA", "selective": "INVITACION_3", "limited": "ADJUDICACION_DIRECTA"}
OCDS_CATEGORIES = {"goods": "ADQUISICIONES", "works": "OBRA_PUBLICA", "services": "SERVICIOS"}
OCDS_STATUS = {
    "active": "VIGENTE", "planning": "VIGENTE", "complete": "CERRADO", "terminated": "CERRADO",
    "cancelled": "CANCELADO",
}
KEYWORD_LISTS = {
    "OBRA": ["obra", "obras", "construcción", "construccion", "edificación", "pavimentación", "rehabilitación",
             "mantenimiento de infraestructura"],
    "SERVICIO": ["servicio", "servicios", "consultoría", "consultoria", "asesoría", "asesoria", "mantenimiento",
                 "limpieza", "vigilancia", "seguridad"],
    "ADQUISICION": ["adquisición", "adquisicion", "compra", "suministro", "abastecimiento", "material", "equipo",
                    "insumos"],
}
NUMBER_HINTS = {"OBRA": ["LO-", "LO "], "ADQUISICION": ["LA-", "LA "], "SERVICIO": ["LS-", "LS "]}


def by_words(c: Column, rules: dict[str, list[str]], default: str) -> Column:
    """The first class one of whose words occurs; null text gets the default."""
    tests = list(rules.items())

    def read(text: Column) -> Column:
        chain = F
        for name, words in tests:
            chain = chain.when(reduce(lambda a, b: a | b, [text.contains(w) for w in words]), name)
        return chain.otherwise(default)

    return let(c, read)


def by_table(c: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(constant_map(table), c)


def procedure_from_text(c: Column) -> Column:
    return by_words(F.lower(c), PROCEDURE_WORDS, "ADJUDICACION_DIRECTA")


def contract_from_text(c: Column) -> Column:
    return by_words(F.lower(c), CONTRACT_WORDS, "ADQUISICIONES")


def portal_procedure(c: Column) -> Column:
    return by_words(F.upper(c), PORTAL_PROCEDURE_WORDS, "LICITACION_PUBLICA")


def portal_contract(c: Column) -> Column:
    return by_words(F.upper(c), PORTAL_CONTRACT_WORDS, "ADQUISICIONES")


def portal_status(c: Column) -> Column:
    return by_words(F.upper(c), PORTAL_STATUS_WORDS, "VIGENTE")


def procedure_from_number(c: Column) -> Column:
    return let(
        F.upper(c),
        lambda n: F.when(n.startswith("LA-") | n.contains("LICITACI"), "LICITACION_PUBLICA")
        .when(n.startswith("IA-") | n.startswith("I3P-"), "INVITACION_3")
        .when(n.startswith("AD-") | n.contains("ADJUDICACI"), "ADJUDICACION_DIRECTA")
        .otherwise("LICITACION_PUBLICA"),
    )


def character(c: Column) -> Column:
    return F.when(F.upper(c).contains("INTERNACIONAL"), "INTERNACIONAL").otherwise("NACIONAL")


def stored_character(c: Column) -> Column:
    """Only a character other than the national default is stored."""
    return F.nullif(character(c), F.lit("NACIONAL"))


def ocds_method(c: Column) -> Column:
    return by_table(F.lower(c), OCDS_METHODS)


def ocds_category(c: Column) -> Column:
    return by_table(F.lower(c), OCDS_CATEGORIES)


def release_method(c: Column) -> Column:
    """In releases every method that is neither open nor selective is a direct award; case matters."""
    return F.when(c.isin("open", "selective"), by_table(c, OCDS_METHODS)).otherwise("ADJUDICACION_DIRECTA")


def release_category(c: Column) -> Column:
    return F.coalesce(ocds_category(c), F.lit("ADQUISICIONES"))


def release_status(c: Column) -> Column:
    return F.coalesce(by_table(F.lower(c), OCDS_STATUS), F.lit("VIGENTE"))


def contract_by_score(c: Column) -> Column:
    """The keyword list with most words present wins, earlier lists on ties; then number prefixes."""

    def scores(text: Column) -> Column:
        def score(words: list[str]) -> Column:
            # words with a common beginning are looked for where that occurs
            kin = [[w for w in words if w[:4] == start] for start in dict.fromkeys(w[:4] for w in words)]
            counts = [reduce(lambda a, b: a + b, [text.contains(w).cast("int") for w in ws]) for ws in kin]
            return reduce(
                lambda a, b: a + b,
                [F.when(text.contains(commonprefix(ws)), n).otherwise(0) if len(ws) > 1 else n for ws, n in zip(kin, counts)],
            )

        return F.array_max(
            F.array(
                *[
                    F.struct(score(words).alias("score"), F.lit(-i).alias("rank"), F.lit(name).alias("name"))
                    for i, (name, words) in enumerate(KEYWORD_LISTS.items())
                ]
            )
        )

    winner = let(let(F.lower(c), scores), lambda best: F.when(best["score"] > 0, best["name"]))
    return F.coalesce(winner, by_words(c, NUMBER_HINTS, "No especificado"))


def invitation_detail(c: Column) -> Column:
    def read(t: Column) -> Column:
        invited = t.contains("INVITACIÓN") | t.contains("INVITACION")
        return (
            F.when(invited & (t.contains("TRES") | t.contains("3")), "INVITACION_3_PERSONAS")
            .when(invited, "INVITACION")
            .when(t.contains("ADJUDICACIÓN DIRECTA") | t.contains("ADJUDICACION DIRECTA"), "ADJUDICACION_DIRECTA")
            .otherwise("LICITACION_PUBLICA")
        )

    return let(F.upper(c), read)


def cell_procedure(method: Column, number: Column, title: Column) -> Column:
    """OCDS method, else the words of number and title."""
    return F.coalesce(ocds_method(method), procedure_from_text(F.concat_ws(" ", number, title)))


def cell_contract(category: Column, title: Column, description: Column) -> Column:
    return F.coalesce(
        ocds_category(category),
        contract_from_text(F.concat_ws(" ", title, F.coalesce(first_filled(description), F.lit("")))),
    )
