"""Landing folders -> normalised rows -> tender table, exactly once by content key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.upsert import insert_if_absent, stage
from ..session import drop_written

Normaliser = Callable[[DataFrame], DataFrame]


def landing_stream(
    spark: SparkSession, path: str, schema: StructType | str, fmt: str = "json", files_per_trigger: int = 1000, **options
) -> DataFrame:
    """New files of a landing folder, each read once. File name and size limit make the batches repeatable."""
    return (
        spark.readStream.format(fmt)
        .schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .options(**options)
        .load(path)
    )


def ingest(
    stream: DataFrame,
    normalise: Normaliser | None,
    table_path: str,
    checkpoint: str,
    order_by: list[str],
    every_seconds: int | None = None,
) -> StreamingQuery:
    """Runs insert-if-absent on each micro-batch: all that is there now, or on and on every so many seconds.

    The anti-join by key in the batch is what makes a replayed batch harmless; the checkpoint is the cursor.
    normalise: for steps that need a batch's rows together. Steps row by row belong into the stream, where they are built once
    and not with every batch; with None the stream's rows are canonical rows already.
    """

    def load(batch: DataFrame, _: int) -> None:
        staged = stage(normalise(batch) if normalise else batch, order_by)
        status = insert_if_absent(staged, table_path)
        for done in (status, staged):  # a stream must not fill the shared folder
            drop_written(done)

    writer = stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": f"{every_seconds} seconds"} if every_seconds else {"availableNow": True}
    return writer.trigger(**trigger).start()


def overlap_dedup(stream: DataFrame, key: str = "hash_contenido", time: str = "fecha_captura", margin: str = "6 hours") -> DataFrame:
    """Drops rows re-read within an overlap margin. State is kept only as long as the margin, so the anti-join of the
    write stays the final guard."""
    return stream.withWatermark(time, margin).dropDuplicatesWithinWatermark([key])


def history(df: DataFrame, since: Column | str, day: str = "fecha_publicacion") -> DataFrame:
    """Back-fill: the same pipeline on the rows from a date on; rows without date are kept."""
    start = F.lit(since).cast("date") if isinstance(since, str) else since
    return df.filter(F.col(day).isNull() | (F.col(day) >= start))


def live_counts(stream: DataFrame, time: str = "fecha_captura", by: str = "fuente", window: str = "24 hours", late: str = "1 hour") -> DataFrame:
    """Rows per time window and source, on a stream or a table."""
    rows = stream.withWatermark(time, late) if stream.isStreaming else stream
    return (
        rows.groupBy(F.window(time, window).alias("w"), by)
        .agg(F.count(F.lit(1)).alias("cantidad"))
        .select(F.col("w.start").alias("desde"), F.col("w.end").alias("hasta"), by, "cantidad")
    )
