"""Intermediate tables in the shared folder, and small helpers of several operators."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import written as stage  # noqa: F401

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Java pattern of a word: everything but space and the five control characters from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches in parts of few rows, so that results for long texts leave the task bit by bit."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def broadcast_if_small(df: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """A broadcast hint if the table (written, of short rows) has no more than so many rows; else it is left to a shuffle."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def shipped(spark: SparkSession, thing: object) -> Broadcast:
    """Broadcasts an object's attributes. Broadcasts are pickled by reference, so the object itself would need this package
    on the executors; plain values don't."""
    return spark.sparkContext.broadcast(dict(vars(thing)))


def unpacked(kind: type, shared: Broadcast):
    """The object again, in a task; its class comes with the task."""
    thing = object.__new__(kind)
    thing.__dict__.update(shared.value)
    return thing


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def columns_clear_of(df: DataFrame, *names: str) -> dict[str, str]:
    """For each name one that no column of df has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = {}
    for name in names:
        new = name
        while new.lower() in taken:
            new = f"_{new}"
        taken.add(new.lower())
        out[name] = new
    return out
