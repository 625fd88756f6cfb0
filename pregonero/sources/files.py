"""File listings and whole-document reads shared by the sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions.dates import iso_date

# Name suffixes and prefixes of the landing files.
IMPROVED_SUFFIX = "_licitaciones_mejorado"
PLAIN_SUFFIX = "_licitaciones"
PROCESSED_SUFFIX = "_mejorado"
CONSOLIDATED_PREFIX = "dof_consolidado_"
ANSWER_SUFFIX = "_ai.json"
TEXT_NAME_PATTERNS = [r"_MAT\.txt$", r"_VES\.txt$", r"^DOF_.*\.txt$", r"\.txt$"]
EXCLUDED_NAME_PARTS = ["_mejorado.json", "_licitaciones.json", ".log"]
EDITION_STAMP = r"(\d{2})(\d{2})(\d{4})_(MAT|VES)"
UNKNOWN_EDITION = "DESCONOCIDA"


def listing(spark: SparkSession, path: str, glob: str = "*", modified_after: str | None = None) -> DataFrame:
    """path, file_name, stem, modified, bytes. The content column is pruned, so no file is opened."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob)
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    name = F.element_at(F.split("path", "/"), -1)
    return reader.load(path).select(
        "path",
        name.alias("file_name"),
        F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"),
        F.col("modificationTime").alias("modified"),
        F.col("length").alias("bytes"),
    )


def documents(
    spark: SparkSession, path: str | list[str], glob: str = "*.json", modified_after: str | None = None
) -> DataFrame:
    """One row per file: file_name, modified, text. A JSON document cannot be split, so the file is the unit."""
    reader = spark.read.option("wholetext", True).option("pathGlobFilter", glob)
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    return reader.text(path).select(
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_modification_time").alias("modified"),
        F.col("value").alias("text"),
    )


def prefer_improved(files: DataFrame) -> DataFrame:
    """Per base name the improved extraction, or the plain one where no improved one exists."""
    improved = F.col("stem").contains(IMPROVED_SUFFIX)
    base = F.regexp_replace("stem", f"{IMPROVED_SUFFIX}|{PLAIN_SUFFIX}", "")
    first = W.partitionBy("base").orderBy(F.col("improved").desc(), "path")
    return (
        files.filter(F.col("stem").contains(PLAIN_SUFFIX))
        .withColumns({"base": base, "improved": improved})
        .withColumn("rank", F.row_number().over(first))
        .filter("rank = 1")
        .drop("rank", "improved")
    )


def latest_consolidated(files: DataFrame) -> DataFrame:
    """The newest consolidated file; where there is none, every single-edition answer file."""
    consolidated = files.filter(F.col("file_name").startswith(CONSOLIDATED_PREFIX) & F.col("file_name").endswith(".json"))
    newest = consolidated.agg(F.max_by("path", F.struct("modified", "path")).alias("path")).filter("path is not null")
    singles = files.filter(F.col("file_name").endswith(ANSWER_SUFFIX)).select("path")
    return newest.unionByName(
        singles.join(newest.select(F.lit(True).alias("found")), F.lit(True), "left_anti")
    )


def text_work_list(files: DataFrame) -> DataFrame:
    """The union of several name patterns, each file once, output and log files left out, sorted."""
    wanted = F.col("file_name").rlike("|".join(TEXT_NAME_PATTERNS))
    excluded = F.col("file_name").rlike("|".join(p.replace(".", r"\.") for p in EXCLUDED_NAME_PARTS))
    return files.filter(wanted & ~excluded).dropDuplicates(["path"]).orderBy("path")


def split_by_processed(texts: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts still to do, result files of known texts, result files without a text), matched on the stem."""
    done = results.withColumn("stem", F.regexp_replace("stem", f"{PROCESSED_SUFFIX}$", ""))
    return (
        texts.join(done, "stem", "left_anti"),
        done.join(texts, "stem", "left_semi"),
        done.join(texts, "stem", "left_anti"),
    )


def edition_columns(file_name, as_of) -> dict:
    """fecha_ejemplar (ISO text) and edicion_ejemplar read off DDMMYYYY_(MAT|VES)."""
    stamped = file_name.rlike(EDITION_STAMP)
    day = F.concat_ws("-", *[F.regexp_extract(file_name, EDITION_STAMP, i) for i in (3, 2, 1)])
    return {
        "fecha_ejemplar": F.when(stamped, day).otherwise(F.date_format(as_of, "yyyy-MM-dd")),
        "edicion_ejemplar": F.when(stamped, F.regexp_extract(file_name, EDITION_STAMP, 4)).otherwise(UNKNOWN_EDITION),
    }


def edition_day(c):
    return iso_date(c)
