"""The sources: each is a pair of pure functions, one that reads files and one that normalises what was read."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import gazette
from ..operators.backfill import finish
from ..operators.upsert import stage
from ..schema import conform
from . import csv_ranges, ocds, portal, rejects, sites
from .files import documents, edition_columns, listing, prefer_improved

Read = Callable[[SparkSession, str], DataFrame]
Normalise = Callable[[DataFrame, Column], DataFrame]
Rejects = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Source:
    read: Read
    normalise: Normalise
    rejects: Rejects | None = None


def _read_portal(spark: SparkSession, path: str) -> DataFrame:
    recs = portal.records(documents(spark, path))
    details = f"{path.rstrip('/')}/detalles"
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(details)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return recs
    return portal.with_details(recs, portal.details(documents(spark, details)))


def _read_gazette(spark: SparkSession, path: str) -> DataFrame:
    kept = prefer_improved(listing(spark, path, "*.json")).select("file_name")
    return gazette.file_records(documents(spark, path).join(kept, "file_name", "left_semi"))


def _normalise_gazette_text(pages: DataFrame, as_of: Column) -> DataFrame:
    dated = pages.withColumns(edition_columns(F.col("archivo"), as_of))
    return gazette.to_canonical(gazette.extract_notices(gazette.split_blocks(dated)))


def _zip_rejects(spark: SparkSession, path: str) -> DataFrame:
    unpacked = ocds.unpack(ocds.read_zips(spark, path))
    return rejects.zip_rejects(unpacked, ocds.releases(unpacked.filter("problema is null").select("file_name", "text")))


def _csv_rejects(spark: SparkSession, path: str) -> DataFrame:
    return rejects.csv_rejects(csv_ranges.read_csv(spark, path, file_name=True))


SOURCES: dict[str, Source] = {
    "comprasmx": Source(
        _read_portal, lambda df, _: portal.normalise(df), lambda spark, path: rejects.portal_rejects(documents(spark, path))
    ),
    "dof": Source(
        _read_gazette, gazette.normalise_file_records, lambda spark, path: rejects.gazette_rejects(documents(spark, path))
    ),
    "dof_texto": Source(
        lambda spark, path: gazette.read_pages(spark, path, F.lit(None).cast("date"), "*.txt"), _normalise_gazette_text
    ),
    "tianguis": Source(csv_ranges.read_csv, ocds.normalise_csv, _csv_rejects),
    "zip": Source(
        lambda spark, path: ocds.releases(ocds.unzip(ocds.read_zips(spark, path))),
        lambda df, _: ocds.normalise_releases(df),
        _zip_rejects,
    ),
    "sitios-masivos": Source(
        sites.read_lines, sites.normalise, lambda spark, path: rejects.line_rejects(sites.raw_lines(spark, path))
    ),
}


def unreadable(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """What several sources could not read: fuente, archivo, motivo, n."""
    return rejects.all_rejects(*[SOURCES[name].rejects(spark, path) for name, path in paths.items() if SOURCES[name].rejects])


def ingest_batch(spark: SparkSession, paths: dict[str, str], as_of: Column) -> DataFrame:
    """Reads, normalises and completes several sources, unites them and stages the result with its order `_ord`:
    source by source, file by file, record by record."""
    parts = []
    for i, (name, path) in enumerate(paths.items()):
        source = SOURCES[name]
        rows = finish(source.normalise(source.read(spark, path), as_of))
        position = [F.col(c) if c in rows.columns else F.lit(None) for c in ("file_name", "archivo", "pagina", "bloque", "pos")]
        types = ("string", "string", "int", "int", "int")
        names = ("_file", "_archivo", "_pagina", "_bloque", "_pos")
        parts.append(
            conform(rows.select("*", F.lit(i).alias("_fuente"), *[c.cast(t).alias(n) for c, t, n in zip(position, types, names)]),
                    keep=("_fuente", *names))
        )
    return stage(reduce(DataFrame.unionByName, parts), ["_fuente", "_file", "_archivo", "_pagina", "_bloque", "_pos"])
