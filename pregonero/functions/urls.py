"""Link expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .dates import iso_date, ymd
from .jsons import path_text
from .text import blank_to_null, first_filled, grab

# Public addresses of the sources.
GAZETTE_HOST = "dof.gob.mx"
GAZETTE_DAY = "https://dof.gob.mx/index_111.php?year=%s&month=%s&day=%s#gsc.tab=0"
PORTAL_DETAIL = "https://comprasmx.buengobierno.gob.mx/sitiopublico/#/sitiopublico/detalle/%s/procedimiento"
PORTAL_BASE = "https://comprasmx.buengobierno.gob.mx/"
OCDS_PROCESS = "https://datosabiertostianguisdigital.cdmx.gob.mx/proceso/%s"
OCDS_RELEASE = "https://tianguisdigital.cdmx.gob.mx/ocds/tender/%s"

_DIGITS = r"^\d+$"


def gazette_url(url: Column, originals: Column, published: Column) -> Column:
    """The day page of the gazette: edition date, else the date in the link, else the publication date."""
    edition = iso_date(F.split_part(path_text(originals, "fecha_ejemplar"), F.lit("T"), F.lit(1)))
    stamp = r"(\d{2})(\d{2})(\d{4})-(?:MAT|VES)"
    in_link = ymd(grab(url, stamp, 3), grab(url, stamp, 2), grab(url, stamp, 1))
    day = F.coalesce(edition, in_link, published.cast("date"))
    page = F.format_string(
        GAZETTE_DAY, F.date_format(day, "yyyy"), F.date_format(day, "MM"), F.date_format(day, "dd")
    )
    return F.when(url.contains(GAZETTE_HOST), url).when(day.isNotNull(), page).otherwise(url)


def portal_url(detail_link: Column, url: Column, uuid: Column) -> Column:
    own = blank_to_null(uuid)
    return F.coalesce(
        blank_to_null(detail_link),
        blank_to_null(url),
        F.when(own.isNotNull(), F.format_string(PORTAL_DETAIL, own)),
        F.lit(PORTAL_BASE),
    )


def ocds_url(tender_id: Column, number: Column, row_id: Column, ocid: Column) -> Column:
    """Numeric tender id, else the last part of an ocds- number, else the numeric row id, else the ocid."""
    parts = F.split(number, "-")
    tail = F.element_at(parts, -1)
    from_number = F.when(number.contains("ocds-") & (F.size(parts) >= 3) & tail.rlike(_DIGITS), tail)
    key = F.coalesce(
        F.when(tender_id.rlike(_DIGITS), tender_id),
        from_number,
        F.when(row_id.rlike(_DIGITS), row_id),
        blank_to_null(ocid),
    )
    return F.when(key.isNotNull(), F.format_string(OCDS_PROCESS, key))


def release_url(ocid: Column) -> Column:
    key = first_filled(ocid)
    return F.when(key.isNotNull(), F.format_string(OCDS_RELEASE, key))
