"""Large CSV files read by many tasks, although cells may hold line breaks.

Spark deals a text file to tasks by byte ranges, each line to the range it starts in. Whether a range begins inside a quoted
cell depends on all before it, so a first pass works out for each range where it would end for both cases: outside -> ?,
inside -> ?. These small functions, one row per range, are composed along each file. A second pass then knows how its range
begins and cuts records out of its lines; what a range leaves unfinished is put together from the few pieces at the borders.
Cells are parsed by the CSV reader's own rules, record by record.

A quote opens a cell only at the cell's beginning, so a stray quote within a cell changes nothing. A cell may be longer than a
range. Blank lines are left out, as the plain reader does.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CLOSING = re.compile(r'(?:[^"]|"")*"(?!")', re.S)
OPTIONS = {"quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}
RANGE = "file string, start long, outside boolean, inside boolean"
PIECE = "file string, start long, n int, part string, record string"


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a quoted cell is open at the end of a line."""
    at = 0
    while True:
        if inside:
            closed = CLOSING.match(line, at)
            if not closed:
                return True
            at = line.find(",", closed.end()) + 1
        elif line.startswith('"', at):
            inside, at = True, at + 1
            continue
        else:
            at = line.find(",", at) + 1
        if not at:
            return False
        inside = False


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines in order within their ranges. The separator is the line feed alone: a cell keeps its carriage returns."""
    text = spark.read.option("lineSep", "\n").option("pathGlobFilter", "*.csv").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _runs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, list[tuple[str, bool]]]]:
    """Runs of lines of one range: the other columns' values, and each line with whether it holds a quote."""
    for batch in batches:
        starts = batch.column(1)
        quoted = pc.match_substring(batch.column(width - 1), '"').to_pylist()
        lines = batch.column(width - 1).to_pylist()
        at = 0
        while at < batch.num_rows:
            key = tuple(batch.column(c)[at].as_py() for c in range(width - 1))
            same = pc.and_(pc.equal(starts.slice(at), starts[at]), pc.equal(batch.column(0).slice(at), batch.column(0)[at]))
            n = pc.index(same, False).as_py()
            upto = batch.num_rows if n < 0 else at + n
            yield key, list(zip(lines[at:upto], quoted[at:upto]))
            at = upto


def _transitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each range the end of both cases."""
    kind = pa.schema([("file", pa.string()), ("start", pa.int64()), ("outside", pa.bool_()), ("inside", pa.bool_())])
    now, ends = None, [False, True]

    def row():
        return pa.RecordBatch.from_arrays([pa.array([v]) for v in (*now, *ends)], schema=kind)

    for key, lines in _runs(batches, 3):
        if key != now:
            if now:
                yield row()
            now, ends = key, [False, True]
        for line, quoted in lines:
            if quoted:
                ends = [ends_inside(line, e) for e in ends]
    if now:
        yield row()


def _pieces(wanted: str):
    """The records of each range whose beginning is known: whole ones, or the pieces at its borders."""
    kind = pa.schema([("file", pa.string()), ("start", pa.int64()), ("n", pa.int32()), ("part", pa.string()), ("record", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, inside, held, n, first = None, False, [], 0, True
        out: list[tuple] = []

        def add(part: str, text: str):
            if (part == "whole") == (wanted == "whole") and (part != "whole" or text.strip("\r")):
                out.append((*now, n, part, text))

        def packed():
            rows, out[:] = list(zip(*out)), []
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, kind)], schema=kind)

        for (file, start, begins), lines in _runs(batches, 4):
            if (file, start) != now:
                if held:
                    add("middle" if first else "begin", "\n".join(held))
                now, inside, held, n, first = (file, start), begins, [], 0, begins
            for line, quoted in lines:
                if quoted:
                    inside = ends_inside(line, inside)
                held.append(line)
                if not inside:
                    add("end" if first else "whole", "\n".join(held))
                    held, n, first = [], n + (first or any(t.strip("\r") for t in held)), False
            if len(out) >= 4096:
                yield packed()
        if held:
            add("middle" if first else "begin", "\n".join(held))
        if out:
            yield packed()

    return run


def _begins(ranges: DataFrame) -> DataFrame:
    """(file, start, begins): whether each range begins inside a cell, from the functions of the ranges before it."""
    listed = ranges.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("start", "outside", "inside"))).alias("ranges"))

    def step(state: Column, r: Column) -> Column:
        begun = F.array_append(state["begun"], F.struct(r["start"].alias("start"), state["open"].alias("begins")))
        return F.struct(F.when(state["open"], r["inside"]).otherwise(r["outside"]).alias("open"), begun.alias("begun"))

    nothing = F.struct(F.lit(False).alias("open"), F.array().cast("array<struct<start:bigint,begins:boolean>>").alias("begun"))
    return listed.select("file", F.explode(F.aggregate("ranges", nothing, step)["begun"]).alias("r")).select("file", "r.start", "r.begins")


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, n, record): the text of each record, with the range it starts in and its number there."""
    lines = _lines(spark, path)
    # a row per range of spark.sql.files.maxPartitionBytes: a millionth of the input's size
    begins = F.broadcast(_begins(lines.mapInArrow(_transitions, RANGE)).withColumnsRenamed({"file": "_file", "start": "_start"}))
    known = lines.join(begins, (F.col("file") == F.col("_file")) & (F.col("start") == F.col("_start"))).select("file", "start", "begins", "value")
    whole = known.mapInArrow(_pieces("whole"), PIECE)
    # a record over a border: its beginning in one range, its end in the next or, over whole ranges, a later one
    in_order = Window.partitionBy("file").orderBy("start", "n")
    parts = known.mapInArrow(_pieces("parts"), PIECE).withColumn("of", F.sum(F.when(F.col("part") == "begin", 1).otherwise(0)).over(in_order))
    pieces = F.array_sort(F.collect_list(F.struct("start", "n", "record")))
    joined = parts.groupBy("file", "of").agg(pieces.alias("p")).select(
        "file", F.col("p")[0]["start"].alias("start"), F.col("p")[0]["n"].alias("n"), F.array_join("p.record", "\n").alias("record")
    )
    return whole.select("file", "start", "n", "record").unionByName(joined)


def read_csv(spark: SparkSession, path: str, file_name: bool = False) -> DataFrame:
    """All columns as text, named by the header of the first file, on request with the file's name. Every file has a header."""
    reader = spark.read.options(**OPTIONS).option("header", True).option("pathGlobFilter", "*.csv")
    names = reader.csv(path).columns
    text = F.regexp_replace("record", "\r$", "")
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    cells = F.from_csv(text, schema, OPTIONS)
    return records(spark, path).filter("not (start = 0 and n = 0)").select(
        "file", cells.alias("cells")
    ).select("cells.*", *[F.regexp_extract("file", "[^/]+$", 0).alias("file_name")] * file_name)
