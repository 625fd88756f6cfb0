"""Open-contracting data of the capital: CSV rows and zipped JSON releases."""

from __future__ import annotations

import io
import sys
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import amounts, classify, dates, urls
from ..functions.jsons import field, member, unwrap_cell
from ..functions.text import first_filled, strip, truncate
from ..schema import OCDS, OCDS_ZIP, conform

# Functions of this module run inside tasks; sent by value they need no installation on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Columns of the CSV export.
CSV_COLUMNS = [
    "ocid", "id", "date", "buyer/name", "tender/id", "tender/title", "tender/description",
    "tender/procurementMethod", "tender/mainProcurementCategory", "tender/tenderPeriod/startDate",
    "tender/value/amount", "planning/budget/projectID", "planning/budget/description", "planning/budget/amount",
]


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; cells may hold JSON and line breaks, so quotes are doubled inside quotes."""
    return (
        spark.read.option("header", True)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("encoding", "UTF-8")
        .option("pathGlobFilter", "*.csv")
        .csv(path)
    )


def normalise_csv(rows: DataFrame, as_of: Column) -> DataFrame:
    """CSV rows -> canonical rows. Rows without number or buyer are left out."""

    def raw(name: str) -> Column:
        return F.col(f"`{name}`") if name in rows.columns else F.lit(None).cast("string")

    cells = rows.select(
        *[unwrap_cell(raw(n)).alias(n.replace("/", "_")) for n in CSV_COLUMNS if "/" in n],
        raw("ocid").alias("ocid"),
        raw("id").alias("row_id"),
        raw("date").alias("date"),
        F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("datos_originales"),
    )
    number = first_filled(F.col("planning_budget_projectID"), F.col("tender_id"), F.col("ocid"))
    named = cells.withColumns(
        {
            "numero_procedimiento": number,
            "titulo": F.coalesce(first_filled(F.col("tender_title"), F.col("planning_budget_description")), F.lit("")),
        }
    ).filter("numero_procedimiento is not null and buyer_name is not null")
    return conform(
        named.withColumns(
            {
                "descripcion": F.col("tender_description"),
                "entidad_compradora": F.col("buyer_name"),
                "tipo_procedimiento": classify.cell_procedure(
                    F.col("tender_procurementMethod"), F.col("numero_procedimiento"), F.col("titulo")
                ),
                "tipo_contratacion": classify.cell_contract(
                    F.col("tender_mainProcurementCategory"), F.col("titulo"), F.col("tender_description")
                ),
                "titulo": truncate(F.col("titulo"), 500),
                "estado": F.lit("VIGENTE"),
                "moneda": F.lit("MXN"),
                "fuente": F.lit(OCDS),
                "fecha_publicacion": F.coalesce(dates.ocds_date(F.col("date")), as_of),
                "fecha_apertura": dates.ocds_date(F.col("tender_tenderPeriod_startDate")),
                "monto_estimado": amounts.ocds_amount(
                    first_filled(F.col("tender_value_amount"), F.col("planning_budget_amount"))
                ),
                "url_original": urls.ocds_url(
                    F.col("tender_id"), F.col("numero_procedimiento"), F.col("row_id"), F.col("ocid")
                ),
            }
        )
    )


def read_zips(spark: SparkSession, path: str) -> DataFrame:
    """Zip files as (file_name, content)."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.zip")
        .load(path)
        .select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "content")
    )


PACKED_BYTES = 1 << 20  # texts or archives of a batch that a task passes on


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows as Python values, made one at a time."""
    for batch in batches:
        for cells in zip(*batch.columns):
            yield tuple(c.as_py() for c in cells)


def packed(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about PACKED_BYTES, so that a task never holds more than that and one row of its results."""
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    for row in rows:
        held.append(row)
        size += sum(len(c) for c in row if c is not None)
        if size >= PACKED_BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


UNPACKED = pa.schema([("file_name", pa.string()), ("text", pa.string()), ("problema", pa.string())])


def _first_json(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per archive: the text of its first JSON member, or what is wrong."""

    def opened():
        for name, content in rows_of(batches):
            text = problem = None
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    members = sorted((n for n in archive.namelist() if n.endswith(".json")), key=lambda n: (n.count("/"), n))
                    if members:
                        text = archive.read(members[0]).decode("utf-8", errors="ignore")
                    else:
                        problem = "sin JSON"
            except (zipfile.BadZipFile, zlib.error, EOFError, RuntimeError, NotImplementedError) as error:
                problem = f"archivo dañado: {type(error).__name__}"
            yield name, text, problem

    return packed(opened(), UNPACKED)


def unpack(zips: DataFrame) -> DataFrame:
    """The first JSON member of each archive (those at the top first) as text, or the problem. Spark has no zip codec, hence
    the one Python step."""
    return zips.select("file_name", "content").mapInArrow(_first_json, "file_name string, text string, problema string")


def unzip(zips: DataFrame) -> DataFrame:
    """The texts of the readable archives."""
    return unpack(zips).filter("problema is null").select("file_name", "text")


def releases(texts: DataFrame) -> DataFrame:
    """Texts -> one row per release. A transport header ends at the first blank line; JSON may be quoted twice."""
    unix = F.regexp_replace("text", r"\r\n?", "\n")
    body = strip(F.when(unix.contains("\n\n"), F.regexp_replace(unix, r"(?s)\A.*?\n\n", "")).otherwise(unix))
    quoted = body.startswith('"')
    inner = F.from_json(F.concat(F.lit('{"s":'), body, F.lit("}")), "s string")["s"]
    bare = F.btrim(body, F.lit('"'))
    opened = F.when(quoted, F.coalesce(inner, bare)).otherwise(body)
    items = F.coalesce(
        F.from_json(opened, "array<string>"), F.from_json(F.btrim(opened, F.lit('"')), "array<string>")
    )
    return texts.select("file_name", F.posexplode(items).alias("pos", "json")).select(
        "file_name", "pos", F.try_parse_json("json").alias("rec")
    )


def normalise_releases(recs: DataFrame) -> DataFrame:
    """Releases -> canonical rows."""
    rec = F.col("rec")
    ocid = field(rec, "ocid")
    budget = member(rec, "planning.budget.amount")
    value = member(rec, "tender.value")
    budget_amount = amounts.nested_amount(budget)
    zero = F.lit(0).cast("decimal(15,2)")
    out = recs.withColumns(
        {
            "numero_procedimiento": F.coalesce(first_filled(ocid, field(rec, "id")), F.lit("")),
            "titulo": F.coalesce(first_filled(field(rec, "tender.title"), field(rec, "planning.budget.project")), F.lit("")),
            "descripcion": field(rec, "tender.description"),
            "entidad_compradora": amounts.nested_name(member(rec, "buyer")),
            "tipo_procedimiento": classify.release_method(field(rec, "tender.procurementMethod")),
            "tipo_contratacion": classify.release_category(field(rec, "tender.mainProcurementCategory")),
            "estado": classify.release_status(field(rec, "tender.status")),
            "fecha_publicacion": dates.release_date(field(rec, "date")),
            "fecha_apertura": dates.release_date(field(rec, "tender.tenderPeriod.startDate")),
            "monto_estimado": F.coalesce(F.nullif(budget_amount, zero), amounts.nested_amount(value), budget_amount),
            "moneda": F.coalesce(
                first_filled(field(rec, "planning.budget.amount.currency")), field(rec, "tender.value.currency"), F.lit("MXN")
            ),
            "fuente": F.lit(OCDS_ZIP),
            "url_original": urls.release_url(ocid),
            "datos_originales": F.to_json("rec"),
        }
    )
    return conform(out, keep=("file_name", "pos"))


def normalise_page_api(recs: DataFrame) -> DataFrame:
    """Records of the city's page API (variant `rec`) -> canonical rows."""
    rec = F.col("rec")
    fixed = F.lit("Ciudad de México")
    agency = field(rec, "unidad_compradora")
    return conform(
        recs.withColumns(
            {
                "numero_procedimiento": F.coalesce(field(rec, "numero_procedimiento"), F.lit("")),
                "titulo": F.coalesce(field(rec, "titulo"), field(rec, "nombre"), F.lit("")),
                "descripcion": F.coalesce(field(rec, "descripcion"), field(rec, "objeto"), F.lit("")),
                "entidad_compradora": F.coalesce(agency, F.lit("CDMX")),
                "unidad_compradora": F.coalesce(agency, F.lit("")),
                "tipo_procedimiento": F.coalesce(field(rec, "tipo_procedimiento"), F.lit("Licitación Pública")),
                "tipo_contratacion": F.coalesce(field(rec, "tipo_contratacion"), F.lit("")),
                "estado": F.coalesce(field(rec, "estatus"), field(rec, "status"), F.lit("")),
                "caracter": F.coalesce(field(rec, "caracter"), F.lit("")),
                "monto_estimado": F.coalesce(
                    amounts.ocds_amount(field(rec, "monto_estimado")), F.lit(0).cast("decimal(15,2)")
                ),
                "moneda": F.lit("MXN"),
                "entidad_federativa": fixed,
                "municipio": fixed,
                "fuente": F.lit(OCDS),
                "fecha_publicacion": dates.five_format_date(
                    field(rec, "fecha_publicacion"), field(rec, "published_at"), field(rec, "created_at")
                ),
                "fecha_apertura": dates.five_format_date(
                    field(rec, "fecha_apertura"), field(rec, "fecha_apertura_proposiciones")
                ),
                "fecha_fallo": dates.five_format_date(field(rec, "fecha_fallo"), field(rec, "fecha_fallo_tecnico")),
                "fecha_junta_aclaraciones": dates.five_format_date(field(rec, "fecha_junta_aclaraciones")),
                "url_original": F.concat(
                    F.lit("https://tianguis.cdmx.gob.mx/licitacion/"), F.coalesce(field(rec, "id"), F.lit(""))
                ),
                "datos_originales": F.to_json("rec"),
            }
        )
    )
