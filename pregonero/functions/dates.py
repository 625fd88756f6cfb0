"""Date expressions. Every parser returns null for text it cannot read; none of them throws in ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import blank_to_null, constant_array, constant_map, first_filled, let, strip

# Month names and their short forms.
MONTHS = {
    "enero": 1, "febrero": 2, "marzo": 3, "abril": 4, "mayo": 5, "junio": 6,
    "julio": 7, "agosto": 8, "septiembre": 9, "octubre": 10, "noviembre": 11, "diciembre": 12,
}
SHORT_MONTHS = {
    "ene": 1, "feb": 2, "mar": 3, "abr": 4, "may": 5, "jun": 6, "jul": 7, "ago": 8, "agos": 8,
    "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dic": 12,
}
MONTH_LABELS = ["Ene", "Feb", "Mar", "Abr", "May", "Jun", "Jul", "Ago", "Sep", "Oct", "Nov", "Dic"]


def month_number(name: Column, short: bool = True) -> Column:
    names = {**MONTHS, **SHORT_MONTHS} if short else MONTHS
    return F.try_element_at(constant_map(names), F.lower(name))


def ymd(year: Column, month: Column, day: Column) -> Column:
    """A date from three text or number parts, null if there is no such day."""
    dash = F.lit("-")
    return F.try_to_date(F.concat(year.cast("string"), dash, month.cast("string"), dash, day.cast("string")), "yyyy-M-d")


def slash_date(c: Column) -> Column:
    """Exactly d/m/yyyy."""
    return let(c, lambda x: F.when(x.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(x, "d/M/yyyy")))


def iso_date(c: Column) -> Column:
    """Exactly yyyy-m-d."""
    return let(c, lambda x: F.when(x.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(x, "yyyy-M-d")))


def portal_date(c: Column) -> Column:
    """ISO with time, d/m/yyyy [hh:mm] or yyyy-mm-dd [hh:mm]; '-' and blanks are missing values."""

    def read(s: Column) -> Column:
        day = F.split_part(s, F.lit(" "), F.lit(1))
        with_time = F.when(F.try_to_timestamp(s).isNotNull(), iso_date(F.substring(s, 1, 10)))
        return F.when(strip(s).isin("", "-"), None).when(s.contains("T"), with_time).when(
            s.contains("/"), slash_date(day)
        ).otherwise(iso_date(day))

    return let(c, read)


_SHORT_FORM = r"(?U)(\d{1,2})\s+(\w{3,})\.?\s+(\d{4})"
_LOOSE_FORM = r"^([^/]*)/([^/]*)/[^/]*?(\d{4})[^/]*$"


def gazette_date(c: Column) -> Column:
    """Five printed forms; an unknown month name counts as January."""

    def read(s: Column) -> Column:
        return F.when(s.rlike(r"^[^/,]*/[^/,]*/[^/,]*,"), slash_date(strip(F.split_part(s, F.lit(","), F.lit(1))))).otherwise(
            F.coalesce(
                F.when(s.contains(" "), F.coalesce(let(F.split(F.lower(s), " de "), long_form), short_form(s))),
                let(F.split_part(s, F.lit(" "), F.lit(1)), lambda word: F.when(
                    word.rlike(r"^[^-]{4}-[^-]*-[^-]*$"), iso_date(word)
                ).otherwise(loose_form(s))),
            )
        )

    def long_form(words: Column) -> Column:
        month = F.coalesce(month_number(strip(F.get(words, F.lit(1)))), F.lit(1))
        year = F.substring(strip(F.get(words, F.lit(2))), 1, 4)
        return F.when(F.size(words) >= 3, ymd(year, month, strip(F.get(words, F.lit(0)))))

    def short_form(s: Column) -> Column:
        month = F.coalesce(month_number(F.regexp_extract(s, _SHORT_FORM, 2)), F.lit(1))
        return F.when(s.rlike(_SHORT_FORM), ymd(F.regexp_extract(s, _SHORT_FORM, 3), month, F.regexp_extract(s, _SHORT_FORM, 1)))

    def loose_form(s: Column) -> Column:
        return F.when(s.rlike(_LOOSE_FORM), slash_date(F.regexp_replace(s, _LOOSE_FORM, "$1/$2/$3")))

    return let(strip(F.regexp_replace(strip(c), r"en CompraNet|en Compras Mx|\.", "")), read)


def structured_date(fecha: Column, texto_original: Column) -> Column:
    """A date given as {fecha, texto_original}: the parsed part first, then the printed text."""
    return F.coalesce(iso_date(fecha), gazette_date(texto_original))


_CLOCK = r"(?:,?\s*(?:a?\s*las?\s*)?(\d{1,2}):(\d{2}))?"
_NUMERIC_EVENT = r"(?isu)^(\d{1,2})[/-](\d{1,2})[/-](\d{4})" + _CLOCK + ".*$"
_NAMED_EVENT = r"(?isuU)^(\d{1,2})(?:\s+de\s+|/)(\w+)(?:\s+de\s+|\s+|/)(\d{4})" + _CLOCK + ".*$"


def event_timestamp(c: Column) -> Column:
    """Date with optional clock time of a notice event, as 'yyyy-MM-dd HH:mm:ss' text; null if invalid."""

    def stamp(parts: Column, month: Column) -> Column:
        hour, minute = (F.coalesce(F.nullif(F.get(parts, F.lit(i)), F.lit("")), F.lit("0")) for i in (3, 4))
        numbers = [c.try_cast("int") for c in (F.get(parts, F.lit(2)), month, F.get(parts, F.lit(0)), hour, minute)]
        return F.date_format(F.try_make_timestamp(*numbers, F.lit(0)), "yyyy-MM-dd HH:mm:ss")

    def read(s: Column, pattern: str, month_of, otherwise: Column) -> Column:
        """One pass finds out whether the pattern fits and takes the parts: a text that fits has no bar after its first digits."""
        taken = F.regexp_replace(s, pattern, "$1|$2|$3|$4|$5")
        return let(taken, lambda t: F.when(t != s, let(F.split(t, r"\|"), lambda p: stamp(p, month_of(F.get(p, F.lit(1)))))).otherwise(otherwise))

    def named(s: Column) -> Column:
        return read(s, _NAMED_EVENT, lambda m: month_number(m, short=False), F.lit(None).cast("string"))

    return let(strip(c), lambda s: read(s, _NUMERIC_EVENT, lambda m: m, named(s)))


_PADDED = r"(?s)^.*?(\d{1,2})[/-](\d{1,2})[/-](\d{4})(?:,?\s*(\d{1,2}):(\d{2}))?.*$"
_HOUR_FIRST = r"(?isuU)^.*?(\d{1,2}):(\d{2})\s*(?:horas?|hrs?)?,?\s*(\d{1,2})\s+(\w{3,})\s*\.?\s*(\d{4}).*$"
_WITH_DE = r"(?isuU)^.*?(\d{1,2})\s+de\s+(\w+)\s+de(?:l?)?\s+(\d{4}).*$"
_PLAIN_MONTH = r"(?isuU)^.*?(\d{1,2})\s+(\w{3,})\.?\s+(\d{4}).*$"
_ANY_CLOCK = r"(\d{1,2}):(\d{2})"


def date_parts(c: Column) -> Column:
    """Printed date as struct(fecha, hora, texto_original); text no form fits keeps only texto_original."""

    def two(x: Column) -> Column:
        return F.lpad(x.cast("string"), 2, "0")

    def pack(s: Column, year: Column, month: Column, day: Column, hour: Column, minute: Column) -> Column:
        clock = F.when(hour != "", F.concat(two(hour), F.lit(":"), minute)).otherwise("")
        dash = F.lit("-")
        return F.struct(
            F.concat(year, dash, two(month), dash, two(day)).alias("fecha"), clock.alias("hora"), s.alias("texto_original")
        )

    def parts(s: Column, pattern: str, groups: int) -> Column:
        return F.split(F.regexp_replace(s, pattern, "|".join(f"${i + 1}" for i in range(groups))), r"\|")

    def at(p: Column, i: int) -> Column:
        return F.get(p, F.lit(i))

    def named(p: Column, i: int) -> Column:
        return F.coalesce(month_number(at(p, i)), F.lit(1))

    def with_clock(s: Column, pattern: str) -> Column:
        hour, minute = (F.regexp_extract(s, _ANY_CLOCK, i) for i in (1, 2))
        return let(parts(s, pattern, 3), lambda p: pack(s, at(p, 2), named(p, 1), at(p, 0), hour, minute))

    def read(s: Column) -> Column:
        return (
            F.when(s.isin("", "No aplica"), None)
            .when(s.rlike(_PADDED), let(parts(s, _PADDED, 5), lambda p: pack(s, at(p, 2), at(p, 1), at(p, 0), at(p, 3), at(p, 4))))
            .when(s.rlike(_HOUR_FIRST), let(parts(s, _HOUR_FIRST, 5), lambda p: pack(s, at(p, 4), named(p, 3), at(p, 2), at(p, 0), at(p, 1))))
            .when(s.rlike(_WITH_DE), with_clock(s, _WITH_DE))
            .when(s.rlike(_PLAIN_MONTH), with_clock(s, _PLAIN_MONTH))
            .when(s.isNotNull(), F.struct(F.lit("").alias("fecha"), F.lit("").alias("hora"), s.alias("texto_original")))
        )

    return let(strip(c), read)


_SLASH_ANY = r"(?s)^.*?\b(\d{1,2})/(\d{1,2})/(\d{4})\b.*$"
_WORDED_ANY = r"(?s)^.*?\b(\d{1,2})\s+([a-záéíóú]+)\s+(\d{4})\b.*$"


def any_date(c: Column) -> Column:
    """d/m/yyyy or 'd month yyyy' anywhere in the text, month in long or short form."""

    def worded(p: Column) -> Column:
        name = F.get(p, F.lit(1))
        month = month_number(F.when(name.startswith("sept"), "sept").otherwise(name))
        return ymd(F.get(p, F.lit(2)), month, F.get(p, F.lit(0)))

    def read(s: Column) -> Column:
        return F.coalesce(
            F.when(s.rlike(_SLASH_ANY), F.try_to_date(F.regexp_replace(s, _SLASH_ANY, "$3-$2-$1"), "yyyy-M-d")),
            F.when(s.rlike(_WORDED_ANY), let(F.split(F.regexp_replace(s, _WORDED_ANY, "$1|$2|$3"), r"\|"), worded)),
        )

    return let(F.lower(strip(c)), read)


def ocds_date(c: Column) -> Column:
    """ISO date-time, yyyy-mm-dd or d/m/yyyy."""
    return let(
        c,
        lambda s: F.when(s.contains("T"), iso_date(F.split_part(s, F.lit("T"), F.lit(1))))
        .when(s.rlike(r"^[^-]{4}-"), iso_date(s))
        .otherwise(slash_date(s)),
    )


def release_date(c: Column) -> Column:
    """The day part of an OCDS release timestamp."""
    return iso_date(F.split_part(c, F.lit("T"), F.lit(1)))


def five_format_date(*keys: Column) -> Column:
    """The first filled of several fields, read in one of five formats."""

    def read(s: Column) -> Column:
        dashed = F.when(s.rlike(r"^\d{1,2}-\d{1,2}-\d{4}$"), F.try_to_date(s, "d-M-yyyy"))
        return F.coalesce(iso_date(F.split_part(s, F.lit("T"), F.lit(1))), slash_date(s), dashed)

    return let(first_filled(*keys), read)


def date_cut(c: Column) -> Column:
    """The text before the first blank."""
    return F.split_part(blank_to_null(c), F.lit(" "), F.lit(1))


def month_label(c: Column) -> Column:
    """'2025-01' -> 'Ene 25'."""
    labels = constant_array(MONTH_LABELS)
    month = F.split_part(c, F.lit("-"), F.lit(2)).try_cast("int")
    name = F.get(labels, month - 1)
    return F.concat(name, F.lit(" "), F.substring(F.split_part(c, F.lit("-"), F.lit(1)), 3, 4))


def week_label(d: Column) -> Column:
    """Calendar year and ISO week, the mixed form the reports use."""
    return F.concat_ws("-", F.year(d).cast("string"), F.lpad(F.weekofyear(d).cast("string"), 2, "0"))
