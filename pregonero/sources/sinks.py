"""Writers: rows with a statistics header, JSON lines, CSV, page-marked text, detail export."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.jsons import row_json

# The marker line before each page of an edition text.
PAGE_MARK = "===== [PÁGINA %d] ====="


def serialise(df: DataFrame) -> DataFrame:
    """Each row as one JSON text: ISO dates, amounts as plain numbers, nulls kept."""
    amounts = [f.name for f in df.schema if f.dataType.typeName() == "decimal"]
    plain = df.withColumns({c: F.col(c).cast("double") for c in amounts}) if amounts else df
    return plain.select(row_json(plain.columns).alias("json"))


def write_with_statistics(rows: DataFrame, statistics: DataFrame, path: str) -> None:
    """Rows and their one-row statistics side by side, both as JSON lines."""
    rows.write.mode("error").json(f"{path}/licitaciones")
    statistics.write.mode("error").json(f"{path}/estadisticas")


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("error").option("ignoreNullFields", False).json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with header; null becomes an empty cell."""
    rows.write.mode("error").option("header", True).option("nullValue", "").option("emptyValue", "").option(
        "escape", '"'
    ).csv(path)


def marked_pages(pages: DataFrame) -> DataFrame:
    """pages(archivo, pagina, contenido) -> the same rows with the marker line in front of the text."""
    return pages.select(
        "archivo",
        "pagina",
        F.concat(F.lit("\n\n"), F.format_string(PAGE_MARK, "pagina"), F.lit("\n"), "contenido").alias("value"),
    )


def write_marked_text(pages: DataFrame, path: str) -> None:
    """One folder per edition, its pages in order. Ranges of (edition, page) are written side by side, so even an
    edition that holds much of the data is neither collected into one row nor written by one task."""
    (
        marked_pages(pages)
        .repartitionByRange("archivo", "pagina")
        .sortWithinPartitions("archivo", "pagina")
        .select("value", "archivo")
        .write.mode("error")
        .partitionBy("archivo")
        .text(path)
    )


def export_details(details: DataFrame, path: str, drop: tuple[str, ...] = ("texto_completo",)) -> None:
    """Detail records without the bulky text, as CSV and JSON."""
    slim = details.drop(*drop)
    write_csv(slim, f"{path}/csv")
    write_jsonl(slim, f"{path}/json")
