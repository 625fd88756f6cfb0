"""Local sites: JSON-lines items, link harvest from stored pages, item mapping."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from html import unescape
from urllib.parse import urljoin

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import amounts, classify, dates, keys
from ..functions.text import blank_to_null, contains_any, first_filled, strip, truncate
from ..operators.windows import first_per_key
from ..schema import SITES, conform

# Functions of this module run inside tasks; sent by value they need no installation on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Words that make a link worth keeping, and date shapes near it.
LINK_KEYWORDS = ["licit", "convoc", "obra", "adquis", "contrat", "bases", "acta", "obras públicas", "licitación"]
PDF_LINK = r"(?i)\.pdf($|\?)"
LINKS_AT_ONCE = 5000
NEAR_NUMERIC_DATE = re.compile(r"\b(\d{2}/\d{2}/\d{4})\b")
NEAR_WORDED_DATE = re.compile(r"\b(\d{1,2}\s+(?:ene|feb|mar|abr|may|jun|jul|ago|sep|oct|nov|dic)\s+\d{4})\b", re.IGNORECASE)


def raw_lines(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """(file_name, value): all lines. Files are split by line."""
    return spark.read.option("pathGlobFilter", glob).text(path).select(F.col("_metadata.file_name").alias("file_name"), "value")


def read_lines(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """JSON lines as (file_name, rec variant); blank lines are skipped, malformed ones are `rejects.line_rejects`."""
    rec = F.try_parse_json(strip(F.col("value")))
    return raw_lines(spark, path, glob).select("file_name", rec.alias("rec")).filter("rec is not null")


def parse_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    """The same on a column of lines."""
    return lines.withColumn("rec", F.try_parse_json(strip(F.col(column)))).filter("rec is not null").drop(column)


def _get(name: str) -> Column:
    return F.try_variant_get("rec", f"$['{name}']", "string")


def normalise(recs: DataFrame, as_of: Column) -> DataFrame:
    """Items in mapped or harvested form -> canonical rows; title and agency are required."""
    named = recs.withColumns(
        {
            "_titulo": first_filled(_get("Proyecto"), _get("titulo"), _get("title")),
            "_organismo": first_filled(_get("Organismo"), _get("organismo"), _get("source")),
            "_localidad": first_filled(_get("localidad"), _get("jurisdiccion"), _get("jurisdiction")),
            "_enlace": first_filled(_get("Vínculo"), _get("doc_url"), _get("url"), _get("vinculo")),
        }
    ).filter("_titulo is not null and _organismo is not null")
    title = F.col("_titulo")
    return conform(
        named.withColumns(
            {
                "numero_procedimiento": F.coalesce(
                    blank_to_null(_get("code")), keys.number_in_title(title), keys.stable_site_number(title)
                ),
                "titulo": truncate(title, 500),
                "descripcion": _get("descripcion"),
                "entidad_compradora": F.col("_organismo"),
                "unidad_compradora": F.nullif("_localidad", F.col("_organismo")),
                "tipo_procedimiento": classify.procedure_from_text(title),
                "tipo_contratacion": classify.contract_from_text(title),
                "estado": F.lit("VIGENTE"),
                "moneda": F.lit("MXN"),
                "fecha_publicacion": F.coalesce(dates.iso_date(_get("date")), as_of),
                "monto_estimado": amounts.site_amount(first_filled(_get("Monto"), _get("monto"))),
                "url_original": F.when(F.col("_enlace").startswith("http"), F.col("_enlace")),
                "fuente": F.lit(SITES),
                "datos_originales": F.to_json("rec"),
            }
        )
    )


_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|([^<]+)|<",
    re.IGNORECASE | re.DOTALL,
)
_HREF = re.compile(r"(?:^|[\s\"'])href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)


def _anchors(page: str) -> list[tuple[str, str, str]]:
    """(href, own text, text of the element around it) of each link. Elements are spans of the list of text pieces, so
    a piece is stored once however deep it lies."""
    pieces: list[str] = []
    open_elements: list[dict] = []
    links: list[tuple[str, dict, dict]] = []
    whole = {"tag": "", "from": 0, "to": None}
    for _, closing, tag, attributes, text in _TOKEN.findall(page):
        if text:
            text = " ".join(unescape(text).split())
            if text:
                pieces.append(text)
        elif closing:
            tag = tag.lower()
            if open_elements and open_elements[-1]["tag"] == tag:
                open_elements.pop()["to"] = len(pieces)
            elif any(e["tag"] == tag for e in open_elements):
                while (element := open_elements.pop())["tag"] != tag:
                    element["to"] = len(pieces)
                element["to"] = len(pieces)
        elif tag and tag.lower() not in _VOID and not attributes.endswith("/"):
            element = {"tag": tag.lower(), "from": len(pieces), "to": None}
            href = _HREF.search(attributes) if element["tag"] == "a" else None
            if href and any(href.groups()):
                links.append((unescape(next(g for g in href.groups() if g)), element, open_elements[-1] if open_elements else whole))
            open_elements.append(element)

    def text_of(element: dict) -> str:
        if "text" not in element:
            element["text"] = " ".join(pieces[element["from"] : element["to"]])
        return element["text"]

    return [(href, text_of(own), _near_date(around, text_of)) for href, own, around in links]


def _near_date(element: dict, text_of) -> str | None:
    """The first date printed in an element, numeric form first. Kept on the element, as many links may share it."""
    if "date" not in element:
        text = text_of(element)
        found = NEAR_NUMERIC_DATE.search(text) or NEAR_WORDED_DATE.search(text)
        element["date"] = found.group(1) if found else None
    return element["date"]


# Addresses that a link is joined to by writing it behind the host or the folder: no dots but before an ending, no empty parts.
_PLAIN_BASE = re.compile(r"(https?://[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*)((?:/[A-Za-z0-9_-]+)*/)(?:[A-Za-z0-9_-]+(?:\.[A-Za-z0-9]+)?)?")
_PLAIN_LINK = re.compile(r"/?[A-Za-z0-9_-]+(?:/[A-Za-z0-9_-]+)*(?:\.[A-Za-z0-9]+)?")


def _joiner(url: str | None):
    """urljoin to one page's address."""
    base = _PLAIN_BASE.fullmatch(url or "")
    host, folder = base.groups() if base else ("", "")

    def join(href: str) -> str:
        if base and _PLAIN_LINK.fullmatch(href):
            return host + (href if href[0] == "/" else folder + href)
        return urljoin(url, href)

    return join


_LINK_COLUMNS = {"page_id": pa.int64(), "url": pa.string(), "pos": pa.int64()} | dict.fromkeys(["href", "doc_url", "label", "near"], pa.string())


def _link_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(_LINK_COLUMNS)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _LINK_COLUMNS.values())], list(_LINK_COLUMNS))


def _page_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links are passed on every so many rows, so a worker never holds those of a whole batch."""
    for batch in batches:
        rows = []
        for page_id, url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            join = _joiner(url)
            for pos, (href, label, near) in enumerate(_anchors(html.as_py() or "")):
                full = href if href.startswith("http") else join(href)
                rows.append((page_id, url, pos, href, full, label, near))
            if len(rows) >= LINKS_AT_ONCE:
                yield _link_rows(rows)
                rows = []
        yield _link_rows(rows)


def page_links(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> every link. Which element surrounds a link takes a scan of the open tags, which no
    column expression can do."""
    schema = "page_id long, url string, pos long, href string, doc_url string, label string, near string"
    linked = pages.filter(F.col("html").rlike(r"(?i)<a\s"))  # a page without a link needs no Python
    return linked.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(_page_links, schema)


def harvest(
    pages: DataFrame,
    source: Column,
    jurisdiction: Column,
    since: Column | None = None,
    until: Column | None = None,
    keywords: list[str] | None = None,
    title_length: int = 220,
) -> DataFrame:
    """Links whose text or address names a keyword or a PDF, as items; the first of equal items per page is kept."""
    words = [w.lower() for w in (keywords or LINK_KEYWORDS)]
    links = page_links(pages).withColumn("date", dates.any_date(F.col("near")))
    wanted = contains_any(F.lower(F.concat_ws(" ", "label", "href")), words) | F.col("href").rlike(PDF_LINK)
    items = links.filter(wanted & within(F.col("date"), since, until)).select(
        "page_id",
        "pos",
        source.alias("source"),
        jurisdiction.alias("jurisdiction"),
        keys.longest_code(F.col("label")).alias("code"),
        truncate(F.coalesce(blank_to_null(F.col("label")), F.col("doc_url")), title_length).alias("title"),
        "date",
        "url",
        "doc_url",
    )
    return unique_items(items, ["page_id", "pos"], per=["page_id"])


def within(day: Column, since: Column | None, until: Column | None) -> Column:
    """A missing day passes; otherwise both ends count."""
    test = F.lit(True)
    if since is not None:
        test = test & (day >= since)
    if until is not None:
        test = test & (day <= until)
    return day.isNull() | test


def unique_items(items: DataFrame, order: list[str], per: list[str] | None = None) -> DataFrame:
    """The first item of each (source, code, document or page link)."""
    link = F.coalesce(blank_to_null(F.col("doc_url")), F.col("url"))
    keyed = items.withColumn("_link", link)
    return first_per_key(keyed, [*(per or []), "source", "code", "_link"], order).drop("_link")


def map_items(items: DataFrame) -> DataFrame:
    """Harvested items -> the five-member form; the amount is looked for in raw text and title."""
    raw = F.col("raw_text") if "raw_text" in items.columns else F.lit(None).cast("string")
    text = strip(F.concat(F.coalesce(raw, F.lit("")), F.lit(" "), F.coalesce("title", F.lit(""))))
    return items.select(
        F.col("source").alias("Organismo"),
        F.col("jurisdiction").alias("localidad"),
        F.col("title").alias("Proyecto"),
        first_filled(F.col("doc_url"), F.col("url")).alias("Vínculo"),
        amounts.amount_in_text(text).alias("Monto"),
    )
