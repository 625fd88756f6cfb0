"""Spark session settings and the shared working folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
_folders: dict[str, str] = {}


def build_session(name: str = "pregonero", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors see: `spark.checkpoint.dir`, or a folder in the warehouse where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return (folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/pregonero-work").rstrip("/")


def hadoop_path(spark: SparkSession, path: str):
    """(Hadoop file system, path) of a path."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def application_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one; it goes when the application ends."""
    app = spark.sparkContext.applicationId
    folder = f"{shared_dir(spark)}/pregonero-{app}"
    if _folders.get(app) != folder:
        files, target = hadoop_path(spark, folder)
        files.mkdirs(target)
        files.deleteOnExit(target)
        _folders[app] = folder
    return folder


def work_dir(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{application_dir(spark)}/{label}-{uuid.uuid4().hex}"


def drop_dir(spark: SparkSession, path: str) -> None:
    """Deletes a folder that is no longer read."""
    files, target = hadoop_path(spark, path)
    files.delete(target, True)


#: For tables of few, very long rows. Parquet counts bytes after a hundred rows only, and its reader takes a row group at once.
LONG_ROWS = {"parquet.block.row.count.limit": "4", "parquet.page.row.count.limit": "1"}


def written(df: DataFrame, label: str, below: str | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """Writes to the shared folder and reads back: cuts the lineage, survives lost executors, and fixes row numbers.

    below: a folder of the caller's that it drops itself; otherwise the files stay until the application ends.
    options: of the writer, as LONG_ROWS.
    """
    spark = df.sparkSession
    path = f"{below}/{label}-{uuid.uuid4().hex}" if below else work_dir(spark, label)
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Deletes the files of a table that `written` returned. It must not be read any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        drop_dir(df.sparkSession, folder)

