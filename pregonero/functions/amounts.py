"""Amount expressions. Amounts are DECIMAL(15,2); unreadable text gives null."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..schema import AMOUNT
from .text import grab, let, strip

# The shapes of an amount in running text.
AMOUNT_IN_TEXT = (
    r"(?iu)(\$\s?\d{1,3}(?:[.,]\d{3})*(?:[.,]\d{2})?|\$\s?\d+(?:[.,]\d{2})?\s*(?:mxn|m\.n\.)?"
    r"|\b\d+(?:[.,]\d{3})*(?:[.,]\d{2})?\s*(?:mdp|millones)\b)"
)


def to_amount(c: Column) -> Column:
    return c.try_cast(AMOUNT)


def portal_amount(c: Column, is_number: Column | None = None) -> Column:
    """Text: drop $ , and blanks, accept digits and dots only. A JSON number is taken as it is."""
    from_text = let(F.regexp_replace(c, "[$, ]", ""), lambda s: F.when(s.rlike(r"^[\d.]*\d[\d.]*$"), to_amount(s)))
    return from_text if is_number is None else F.when(is_number, to_amount(c)).otherwise(from_text)


def ocds_amount(c: Column) -> Column:
    """Keep digits and dots."""
    return to_amount(F.regexp_replace(c, r"[^\d.]", ""))


def site_amount(c: Column) -> Column:
    """Comma and dot: comma groups thousands. Comma only: decimal if at most two digits follow one comma."""

    def read(s: Column) -> Column:
        decimal_comma = s.rlike(r"^[^,.]*,[^,.]{0,2}$")
        return to_amount(
            F.when(decimal_comma, F.replace(s, F.lit(","), F.lit("."))).otherwise(F.replace(s, F.lit(","), F.lit("")))
        )

    return let(F.regexp_replace(c, r"[^\d.,]", ""), read)


def amount_in_text(c: Column) -> Column:
    """The first amount mentioned in a text, as printed."""
    return strip(grab(c, AMOUNT_IN_TEXT, 1))


def nested_amount(v: Column) -> Column:
    """A variant that is a number or an object with `amount`; an object without one counts as 0."""

    def read(x: Column) -> Column:
        kind = F.schema_of_variant(x)
        inner = F.coalesce(to_amount(F.try_variant_get(x, "$.amount", "string")), F.lit(0).cast(AMOUNT))
        return F.when(kind.startswith("OBJECT"), inner).when(
            kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT)"), to_amount(F.try_variant_get(x, "$", "string"))
        )

    return let(v, read)


def nested_name(v: Column) -> Column:
    """A variant that is a text or an object with `name`."""

    def read(x: Column) -> Column:
        kind = F.schema_of_variant(x)
        return (
            F.when(kind == "STRING", F.try_variant_get(x, "$", "string"))
            .when(kind.startswith("OBJECT"), F.coalesce(F.try_variant_get(x, "$.name", "string"), F.lit("")))
            .otherwise("")
        )

    return let(v, read)
