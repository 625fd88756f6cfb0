"""Content keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..schema import PORTAL
from .text import blank_to_null, grab, grab_first, matches_all

# Shapes of a procedure number in a title, tried in this order.
TITLE_NUMBER_PATTERNS = [
    r"(?iu)\b(?:LP|LA|IA|AD|SPFA|LPN|LPE|LPI|ADQ)[A-Z0-9/\-\._]*\b",
    r"(?iu)\b\d{3,}/\d{4}\b",
    r"(?iu)\b[A-Z]{2,}-\d{3,}\b",
    r"(?iu)\bNo\.\s*([A-Z0-9/\-\.]+)\b",
]
# Prefixes of procedure codes in link labels.
LABEL_CODE_PATTERN = (
    r"(?iu)\b(?:SPFA|LPN|LP|LPE|LPI|LA|IA|AC|DGAS|SAF|GEP|GESAL|PLEJ|SCEM|SMOV|ADQ|"
    r"LPNSC|LPLSC|HCES|SACMEX|SOBSE|LES|LO|LPEJ|LPE\-|DGAP|PJENL|ASCM|LPEF|LPEM)[A-Z0-9/\-\._]*\b"
)


def triple_sha(number: Column, agency: Column, source: Column) -> Column:
    return F.sha2(F.concat_ws("_", number, agency, source), 256)


def triple_md5(number: Column, agency: Column, source: Column) -> Column:
    empty = F.lit("")
    return F.md5(F.concat(F.coalesce(number, empty), F.coalesce(agency, empty), F.coalesce(source, empty)))


def content_key(source: Column, uuid: Column, number: Column, agency: Column) -> Column:
    """Portal rows with a real identifier use it; all others hash number, agency and source."""
    own = (source == PORTAL) & blank_to_null(uuid).isNotNull()
    return F.when(own, uuid).otherwise(triple_sha(number, agency, source))


def number_in_title(c: Column) -> Column:
    return grab_first(c, TITLE_NUMBER_PATTERNS, 0)


def longest_code(c: Column) -> Column:
    """The longest code in a label, the earlier one on ties."""
    codes = F.transform(
        matches_all(c, LABEL_CODE_PATTERN),
        lambda code, i: F.struct(F.length(code).alias("n"), (-i).alias("at"), code.alias("code")),
    )
    return F.array_max(codes)["code"]


def stable_site_number(title: Column) -> Column:
    """SM- and 24 hex digits of a hash of the title: the same in every run, different for different titles."""
    return F.concat(F.lit("SM-"), F.substring(F.sha2(F.encode(title, "utf-8"), 256), 1, 24))


def first_code(c: Column) -> Column:
    return grab(c, LABEL_CODE_PATTERN, 0)
