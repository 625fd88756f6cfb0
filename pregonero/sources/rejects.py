"""Input that a source can't read, as rows (fuente, archivo, motivo, n) instead of a silent gap."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.jsons import unwrap_cell
from ..functions.text import strip
from ..schema import GAZETTE, OCDS, OCDS_ZIP, PORTAL, SITES


def _rejects(rows: DataFrame, source: str, reason: Column | str) -> DataFrame:
    """rows(file_name) counted by file and reason."""
    why = F.lit(reason) if isinstance(reason, str) else reason
    return rows.groupBy(F.lit(source).alias("fuente"), F.col("file_name").alias("archivo"), why.alias("motivo")).agg(
        F.count(F.lit(1)).alias("n")
    )


def json_problem(text: Column, members: list[str]) -> Column:
    """Why a JSON document gives no records: not JSON, or neither a list nor an object with one of the members; else null."""
    is_list = F.from_json(text, "array<string>").isNotNull()
    keys = F.json_object_keys(text)
    known = F.arrays_overlap(keys, F.array(*[F.lit(m) for m in members]))
    return F.when(keys.isNull() & ~is_list, "no es JSON").when(keys.isNotNull() & ~known, "sin lista de registros")


def portal_rejects(docs: DataFrame) -> DataFrame:
    """docs(file_name, text)."""
    members = ["data", "registros", "licitaciones", "expedientes", "total_expedientes_capturados"]
    problem = json_problem(F.col("text"), members)
    return _rejects(docs.withColumn("_motivo", problem).filter("_motivo is not null"), PORTAL, F.col("_motivo"))


def gazette_rejects(docs: DataFrame) -> DataFrame:
    """docs(file_name, text)."""
    problem = json_problem(F.col("text"), ["licitaciones", "data"])
    return _rejects(docs.withColumn("_motivo", problem).filter("_motivo is not null"), GAZETTE, F.col("_motivo"))


def zip_rejects(unpacked: DataFrame, releases: DataFrame) -> DataFrame:
    """unpacked(file_name, text, problema) as `ocds.unpack` gives it, and the releases read from it."""
    read = releases.select("file_name").distinct().withColumn("_leido", F.lit(True))
    judged = unpacked.join(read, "file_name", "left").withColumn(
        "_motivo", F.coalesce("problema", F.when(F.col("_leido").isNull(), "sin lista de registros"))
    )
    return _rejects(judged.filter("_motivo is not null"), OCDS_ZIP, F.col("_motivo"))


def csv_rejects(rows: DataFrame) -> DataFrame:
    """rows(file_name, and the columns of the CSV): rows that name neither a procedure nor a buyer."""
    def empty(name: str) -> Column:
        return F.coalesce(strip(unwrap_cell(F.col(f"`{name}`"))), F.lit("")) == "" if name in rows.columns else F.lit(True)

    numberless = empty("planning/budget/projectID") & empty("tender/id") & empty("ocid")
    problem = F.when(numberless, "sin número").when(empty("buyer/name"), "sin comprador")
    return _rejects(rows.withColumn("_motivo", problem).filter("_motivo is not null"), OCDS, F.col("_motivo"))


def line_rejects(lines: DataFrame) -> DataFrame:
    """lines(file_name, value): lines that are filled but no JSON."""
    line = strip(F.col("value"))
    return _rejects(lines.filter((F.length(line) > 0) & F.try_parse_json(line).isNull()), SITES, "no es JSON")


def all_rejects(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
