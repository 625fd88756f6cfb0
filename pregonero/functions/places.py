"""State look-up in free text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import ACCENTED, PLAIN, constant_array, constant_map, matches_all, unaccent

# State names and usual short forms, without accents, and the stored name.
STATES = {
    "AGUASCALIENTES": "Aguascalientes",
    "BAJA CALIFORNIA": "Baja California",
    "BAJA CALIFORNIA SUR": "Baja California Sur",
    "CAMPECHE": "Campeche",
    "CHIAPAS": "Chiapas",
    "CHIHUAHUA": "Chihuahua",
    "CIUDAD DE MEXICO": "Ciudad de México",
    "CDMX": "Ciudad de México",
    "COAHUILA": "Coahuila",
    "COAHUILA DE ZARAGOZA": "Coahuila",
    "COLIMA": "Colima",
    "DURANGO": "Durango",
    "GUANAJUATO": "Guanajuato",
    "GUERRERO": "Guerrero",
    "HIDALGO": "Hidalgo",
    "JALISCO": "Jalisco",
    "MEXICO": "Estado de México",
    "ESTADO DE MEXICO": "Estado de México",
    "EDO MEX": "Estado de México",
    "EDOMEX": "Estado de México",
    "MICHOACAN": "Michoacán",
    "MICHOACAN DE OCAMPO": "Michoacán",
    "MORELOS": "Morelos",
    "NAYARIT": "Nayarit",
    "NUEVO LEON": "Nuevo León",
    "OAXACA": "Oaxaca",
    "PUEBLA": "Puebla",
    "QUERETARO": "Querétaro",
    "QUINTANA ROO": "Quintana Roo",
    "SAN LUIS POTOSI": "San Luis Potosí",
    "SINALOA": "Sinaloa",
    "SONORA": "Sonora",
    "TABASCO": "Tabasco",
    "TAMAULIPAS": "Tamaulipas",
    "TLAXCALA": "Tlaxcala",
    "VERACRUZ": "Veracruz",
    "VERACRUZ DE IGNACIO DE LA LLAVE": "Veracruz",
    "YUCATAN": "Yucatán",
    "ZACATECAS": "Zacatecas",
}

# Longest name first; the country's own name says least and comes last.
_PRIORITY = sorted(STATES, key=lambda k: (k == "MEXICO", -len(k), list(STATES).index(k)))


def _class(letter: str) -> str:
    """A letter in both cases, with all its accented forms, as the look-up strips accents, and with what (?iu) takes for it. Spelt
    out, the regex tells it by a table, much faster than a letter of which the case is ignored."""
    forms = "".join(a for a, p in zip(ACCENTED, PLAIN) if p in (letter, letter.lower()))
    return letter if letter == " " else "[" + letter + letter.lower() + forms + {"I": "İı", "K": "\u212a", "S": "ſ"}.get(letter, "") + "]"


def _accents(name: str) -> str:
    return "".join(map(_class, name))


def _names_pattern() -> str:
    """All names in any case and accent as whole words. Names are grouped by their first letter, and longer names come
    before those they begin with, so that few alternatives are tried at a word and the whole name is taken. A look at the first
    letter comes before all else."""
    groups, letters = [], "".join(_class(x)[1:-1] for x in sorted({k[0] for k in STATES}))
    for letter in sorted({k[0] for k in STATES}):
        rest = [_accents(k[1:]) for k in sorted(STATES, key=len, reverse=True) if k[0] == letter]
        groups.append(f"{_accents(letter)}(?:{'|'.join(rest)})")
    return rf"(?=[{letters}])" + r"(?<![\p{L}\d_])(?:" + "|".join(groups) + r")(?![\p{L}\d_])"


NAMES_PATTERN = _names_pattern()


def state_name(c: Column) -> Column:
    """The stored name of a text that is exactly one state name."""
    return F.try_element_at(constant_map(STATES), unaccent(F.upper(c)))


def state_in_text(c: Column) -> Column:
    """The most specific state named in a text. One regex pass finds all names; their ranks decide."""
    ranks = constant_map({k: i for i, k in enumerate(_PRIORITY)})
    found = F.transform(matches_all(c, NAMES_PATTERN), lambda k: F.try_element_at(ranks, unaccent(F.upper(k))))
    return F.get(constant_array([STATES[k] for k in _PRIORITY]), F.array_min(found))
