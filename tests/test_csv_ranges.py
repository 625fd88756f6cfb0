"""CSV files read by ranges against the plain reader, with cells that hold line breaks, quotes and whole ranges."""

import csv
import io
import os
import random

import pytest

from pregonero.sources import csv_ranges, ocds


def line_state(text, inside):
    """Character by character: whether a quoted cell is open at the end."""
    state, at = ("quoted" if inside else "start"), 0
    while at < len(text):
        c = text[at]
        if state == "quoted":
            if c == '"':
                if text[at + 1 : at + 2] == '"':
                    at += 1
                else:
                    state = "cell"
        elif c == ",":
            state = "start"
        else:
            state = "quoted" if state == "start" and c == '"' else "cell"
        at += 1
    return state == "quoted"


def test_line_states():
    rng = random.Random(4)
    for _ in range(20_000):
        line = "".join(rng.choice('",ab') for _ in range(rng.randrange(12)))
        for inside in (False, True):
            assert csv_ranges.ends_inside(line, inside) == line_state(line, inside), (line, inside)


@pytest.fixture
def small_ranges(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def made(rng, n):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(["id", "text", "more"])
    for i in range(n):
        text = "".join(rng.choice(['"', ",", "\n", "word ", "ñ", '""', "\r\n", "x"]) for _ in range(rng.randrange(40)))
        writer.writerow([i, text if i % 50 else "long\n" * 400, rng.choice(["", "plain", 'a "quoted" word', "line\nbreak"])])
    return out.getvalue()


def test_ranges_equal_the_plain_reader(spark, tmp_path, small_ranges):
    rng = random.Random(2)
    for k in range(3):
        (tmp_path / f"f{k}.csv").write_bytes(made(rng, 120).encode())
    (tmp_path / "other.txt").write_text("not,read\n")
    (tmp_path / "header.csv").write_text("id,text,more\n")
    path = str(tmp_path)
    got = csv_ranges.read_csv(spark, path)
    wanted = sorted(map(str, ocds.read_csv(spark, path).collect()))
    assert got.columns == ["id", "text", "more"] and sorted(map(str, got.collect())) == wanted and len(wanted) == 360
    assert csv_ranges._lines(spark, path).rdd.getNumPartitions() > 30
    names = csv_ranges.read_csv(spark, path, file_name=True).groupBy("file_name").count().collect()
    assert {(r.file_name, r["count"]) for r in names} == {(f"f{k}.csv", 120) for k in range(3)}


def test_stray_quotes_blank_lines_and_an_open_end(spark, tmp_path, small_ranges):
    text = 'id,text\n1,5" pipe\n\n2,"a ""b""\nc"\r\n3,x"y"z\n4,\n5,""\n6,"never closed\nto the end'
    (tmp_path / "a.csv").write_text(text, newline="")
    got = [tuple(r) for r in csv_ranges.read_csv(spark, str(tmp_path)).orderBy("id").collect()]
    plain = [tuple(r) for r in ocds.read_csv(spark, str(tmp_path)).orderBy("id").collect()]
    assert got == plain and got[:3] == [("1", '5" pipe'), ("2", 'a "b"\nc'), ("3", 'x"y"z')] and len(got) == 6


def test_empty_folder_of_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,text\n")
    assert csv_ranges.read_csv(spark, str(tmp_path)).collect() == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables not present")
def test_the_task_that_writes_one_file_does_not_join(spark):
    from catalog.source_queries import broken_rows

    plan = broken_rows(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" in plan and "Coalesce" not in plan
