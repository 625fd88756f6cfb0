"""Insert, upsert and paging against a plain sequential model; streams against batches."""

import random
import re

import pytest
from pyspark.sql import Row, functions as F

from pregonero.operators import joins, paging, upsert, windows
from pregonero.schema import COLUMNS, TENDER, conform
from pregonero.session import application_dir, drop_written, hadoop_path
from pregonero.streaming import calendar, ingest


def tenders(spark, rows):
    """rows of (order, hash, number, agency, source)."""
    df = spark.createDataFrame(rows, "_ord long, hash_contenido string, numero_procedimiento string, entidad_compradora string, fuente string")
    return conform(df, keep=("_ord",))


def sequential(rows, table=()):
    """What row-by-row inserts with two unique keys give; rows without a key are rejected."""
    hashes, triples, out = {h for h, _ in table}, {t for _, t in table}, {}
    for o, h, n, a, f in sorted(rows):
        if not n or not f or h is None:
            out[o] = "rechazado"
        elif h in hashes:
            out[o] = "duplicado"
        elif (n, a, f) in triples:
            out[o] = "error"
        else:
            hashes.add(h)
            triples.add((n, a, f))
            out[o] = "insertado"
    return out


@pytest.mark.parametrize("seed", range(4))
def test_insert_status_equals_sequential_inserts(spark, seed):
    rng = random.Random(seed)
    rows = [
        (i, f"h{rng.randrange(25)}", "" if rng.random() < 0.05 else f"n{rng.randrange(20)}", f"a{rng.randrange(2)}", "ComprasMX")
        for i in rng.sample(range(1000), 150)
    ]
    old = [(10_000 + i, f"h{i * 5}", f"n{i}", "a0", "ComprasMX") for i in range(4)]
    got = upsert.insert_status(tenders(spark, rows), tenders(spark, old))
    want = sequential(rows, [(h, (n, a, f)) for _, h, n, a, f in old])
    assert {r._ord: r.estatus for r in got.collect()} == want


def test_long_chains_stars_and_missing_keys(spark):
    rows = [(i, f"h{(i + 1) // 2}", f"n{i // 2}", "a", "DOF") for i in range(300)]
    rows += [(1000 + i, f"s{i}", "star", "a", "DOF") for i in range(40)] + [(2000 + i, "star", f"t{i}", "a", "DOF") for i in range(40)]
    rows += [(3000 + i, None, f"x{i}", "a", "DOF") for i in range(3)] + [(3010, "y", None, "a", "DOF"), (3011, "z", "1", "a", None)]
    got = upsert.insert_status(tenders(spark, rows), tenders(spark, [])).collect()
    assert {r._ord: r.estatus for r in got} == sequential(rows)
    assert {r._ord: r.motivo for r in got if r.motivo} == {
        3000: "sin hash_contenido", 3001: "sin hash_contenido", 3002: "sin hash_contenido", 3010: "sin numero_procedimiento", 3011: "sin fuente",
    }


def test_a_long_chain_takes_few_rounds(spark, tmp_path, monkeypatch):
    n, rounds = 100_000, []
    racing = spark.range(n).select(F.floor((F.col("id") + 1) / 2).cast("string").alias("h"), F.floor(F.col("id") / 2).cast("string").alias("t"), F.col("id").alias("o"))
    plain = upsert.written
    monkeypatch.setattr(upsert, "written", lambda df, label, below=None: (rounds.append(label), plain(df, label, below))[1])
    won = upsert._accepted(racing, f"file://{tmp_path}/below")
    assert won.agg(F.count("*"), F.max(F.col("o") % 2), F.countDistinct("o")).first() == (n // 2, 0, n // 2)
    assert rounds.count("links") <= 18 and rounds.count("told") == 2


def test_finished_links_and_long_digests_are_not_carried_on(spark, tmp_path, monkeypatch):
    """A chain's links are doubled until they are known to end, without a round that only finds that out; the triple's digest
    travels as bytes."""
    seen, plain = [], upsert.written

    def noted(df, label, below=None):
        seen.append((label, dict(df.dtypes).get("t")))
        return plain(df, label, below)

    monkeypatch.setattr(upsert, "written", noted)
    rows = [(i, f"h{(i + 1) // 2}", f"n{i // 2}", "a", "DOF") for i in range(16)]
    got = upsert.insert_status(tenders(spark, rows), tenders(spark, []))
    assert {r._ord: r.estatus for r in got.collect()} == sequential(rows)
    labels = [label for label, _ in seen]
    assert labels.count("links") == 4 and ("rows", "binary") in seen


def test_batches_leave_no_folders(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    upsert.create_table(spark, path)
    work = hadoop_path(spark, application_dir(spark))
    names = lambda: {s.getPath().getName() for s in work[0].listStatus(work[1])}
    before = names()
    for k in range(2):
        rows = tenders(spark, [(i, f"h{i % 7}", f"n{i % 5}", "a", "DOF") for i in range(k, 30)])
        drop_written(upsert.insert_if_absent(rows, path))
    assert names() == before


def test_upsert_leaves_rows_without_key_alone(spark):
    rows = conform(spark.createDataFrame([(None, "a"), (None, "b"), ("h", "c")], "hash_contenido string, titulo string"))
    batch = spark.createDataFrame([(1, None, "x"), (2, None, "y"), (3, "h", "z"), (4, "i", "w")], "_ord long, hash_contenido string, titulo string")
    got = upsert.upsert(rows, conform(batch, keep=("_ord",)))
    assert sorted((r.hash_contenido or "", r.titulo, r.operacion or "") for r in got.collect()) == [
        ("", "a", ""), ("", "b", ""), ("h", "c", "actualizada"), ("i", "w", "insertada"),
    ]


def test_a_batch_reads_and_rewrites_only_its_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    upsert.append_rows(tenders(spark, [(i, f"h{i}", str(i), "x", "DOF") for i in range(200)]), path)
    batch = tenders(spark, [(1, "h7", "7", "x", "DOF")])
    number = batch.select(upsert.bucket()).first()[0]
    read = upsert.stored(spark, path).filter(upsert.touched(batch))
    scanned = [r[0] for r in read.select(F.input_file_name()).distinct().collect()]
    assert re.search(rf"PartitionFilters: \[[^\]]*{upsert.BUCKET}#", read._jdf.queryExecution().executedPlan().toString())
    assert scanned and all(f"fuente=DOF/{upsert.BUCKET}={number}/" in f for f in scanned)
    before = set(upsert.stored(spark, path).inputFiles())
    upsert.upsert_table(batch, path)
    after = set(upsert.stored(spark, path).inputFiles())
    assert all(f"{upsert.BUCKET}={number}/" in f for f in before ^ after)
    assert upsert.read_table(spark, path).count() == 200
    upsert.compact(spark, path, "DOF")
    assert upsert.read_table(spark, path).count() == 200


def test_replaced_source_loses_its_old_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    upsert.append_rows(tenders(spark, [(i, f"h{i}", str(i), "x", f) for i in range(60) for f in ("DOF", "ComprasMX")]), path)
    upsert.replace_sources(tenders(spark, [(1, "h1", "1", "x", "DOF")]), path)
    assert {r.fuente: r["count"] for r in upsert.read_table(spark, path).groupBy("fuente").count().collect()} == {"DOF": 1, "ComprasMX": 60}


def test_insert_twice_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    upsert.create_table(spark, path)
    rows = tenders(spark, [(1, "a", "1", "x", "DOF"), (2, "a", "1", "x", "DOF"), (3, "b", "2", "x", "ComprasMX")])
    assert upsert.insert_if_absent(rows, path).filter("estatus = 'insertado'").count() == 2
    assert upsert.insert_if_absent(rows, path).filter("estatus = 'insertado'").count() == 0
    assert upsert.read_table(spark, path).count() == 2


def test_upsert_equals_sequential_updates(spark, tmp_path):
    path = str(tmp_path / "t")
    old = conform(spark.createDataFrame([("a", "viejo", "m0", "DOF"), ("z", "otro", "mz", "ComprasMX")], "hash_contenido string, titulo string, municipio string, fuente string"))
    upsert.append_rows(old, path)
    batch = spark.createDataFrame(
        [(1, "a", "t1", "m1", "DOF"), (2, "b", "t2", "m2", "DOF"), (3, "b", "t3", None, "DOF")],
        "_ord long, hash_contenido string, titulo string, municipio string, fuente string",
    )
    result = upsert.upsert_table(conform(batch, keep=("_ord",)), path)
    assert upsert.upsert_counts(result).first() == Row(insertadas=1, actualizadas=2)
    got = {r.hash_contenido: (r.titulo, r.municipio, r.fuente) for r in upsert.read_table(spark, path).collect()}
    assert got == {"a": ("viejo", "m1", "DOF"), "b": ("t2", None, "DOF"), "z": ("otro", "mz", "ComprasMX")}


def test_delete_source(spark, tmp_path):
    path = str(tmp_path / "t")
    upsert.append_rows(tenders(spark, [(1, "a", "1", "x", "test"), (2, "b", "1", "x", "DOF")]), path)
    upsert.delete_source(spark, path, "test")
    assert [r.fuente for r in upsert.read_table(spark, path).collect()] == ["DOF"]


@pytest.mark.parametrize("offset", [0, 95, 399, 480])
def test_deep_page_equals_plain_page(spark, offset):
    rng = random.Random(1)
    days = [None, "2025-01-01"] + ["2025-01-02"] * 6 + ["2025-03-01"]
    rows = [(rng.randrange(-(2**62), 2**62), rng.choice(days)) for _ in range(500)]
    df = spark.createDataFrame(rows, "id long, f string").select("id", F.col("f").cast("date").alias("fecha_publicacion"))
    plain = df.orderBy(*paging.newest_first()).offset(offset).limit(20).collect()
    assert paging.deep_page(df, offset, 20).collect() == plain


def test_pages_after_a_known_row_cover_everything(spark):
    rows = [(i, None if i % 7 == 0 else f"2025-01-{1 + i % 3:02d}") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, f string").select("id", F.col("f").cast("date").alias("fecha_publicacion"))
    seen, part = [], paging.page(df, 1, 13).collect()
    while part:
        seen += part
        part = paging.page_after(df, part[-1].fecha_publicacion, part[-1].id, 13).collect()
    assert seen == df.orderBy(*paging.newest_first()).collect()


def test_first_per_key_cuts_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("o"))
    first = windows.first_per_key(df, ["k"], ["o"])
    assert {(r.k, r.o) for r in first.collect()} == {(0, 0), (1, 1), (2, 2)}
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_patch_by_agency_equals_nested_loop(spark):
    rng = random.Random(3)
    words = ["obra", "vial", "agua", "luz"]
    titles = [(i, "DOF" if i % 5 else "X", f"a{i % 2}", " ".join(rng.choices(words, k=5)), '{"x":1}') for i in range(60)]
    patches = [(i, "" if i % 4 else f"n{i}", f"a{i % 3}", " ".join(rng.choices(words, k=2 + i % 3)), f'{{"p":{i}}}') for i in range(40)]
    t = spark.createDataFrame(titles, "id int, fuente string, entidad_compradora string, titulo string, datos_originales string")
    p = spark.createDataFrame(patches, "orden int, numero_licitacion string, dependencia string, objeto_licitacion string, parche string")
    got = joins.patch_by_agency_and_object(t, p).select("id", F.get_json_object("datos_originales", "$.p").cast("int").alias("p"))
    want = {}
    for i, f, a, title, _ in titles:
        hits = [o for o, n, d, obj, _ in patches if not n and d == a and obj[:50] in title]
        want[i] = max(hits) if hits and f == "DOF" else None
    assert {r.id: r.p for r in got.collect()} == want


def test_stream_equals_batch_and_survives_a_replay(spark, tmp_path):
    landing, table = tmp_path / "landing", str(tmp_path / "table")
    landing.mkdir()
    for i in range(3):
        (landing / f"f{i}.json").write_text("\n".join(f'{{"h":"k{(i * 4 + j) % 7}","n":"{(i * 4 + j) % 7}"}}' for j in range(4)))
    upsert.create_table(spark, table)

    def normalise(batch):
        return conform(batch.select(F.col("h").alias("hash_contenido"), F.col("n").alias("numero_procedimiento"), F.lit("a").alias("entidad_compradora"), F.lit("DOF").alias("fuente")))

    for checkpoint in ("c1", "c2"):  # the second run starts without a memory of the first
        stream = ingest.landing_stream(spark, str(landing), "h string, n string", "json", 1)
        ingest.ingest(stream, normalise, table, str(tmp_path / checkpoint), ["hash_contenido"]).awaitTermination()
        assert sorted(r.hash_contenido for r in upsert.read_table(spark, table).collect()) == [f"k{i}" for i in range(7)]


def test_stream_of_canonical_rows_needs_no_normaliser(spark, tmp_path):
    """The rows are normalised in the stream, so the plan is built once, not with every batch."""
    landing, table = tmp_path / "landing", str(tmp_path / "table")
    landing.mkdir()
    for i in range(3):
        (landing / f"f{i}.json").write_text("\n".join(f'{{"h":"k{(i * 4 + j) % 7}"}}' for j in range(4)))
    upsert.create_table(spark, table)
    stream = ingest.landing_stream(spark, str(landing), "h string", "json", 1)
    rows = conform(stream.select(F.col("h").alias("hash_contenido"), F.col("h").alias("numero_procedimiento"), F.lit("DOF").alias("fuente")))
    ingest.ingest(rows, None, table, str(tmp_path / "c"), ["hash_contenido"]).awaitTermination()
    assert sorted(r.hash_contenido for r in upsert.read_table(spark, table).collect()) == [f"k{i}" for i in range(7)]


def test_a_batch_writes_few_tables(spark, tmp_path, monkeypatch):
    path, labels, plain = f"file://{tmp_path}/t", [], upsert.written
    upsert.create_table(spark, path)
    monkeypatch.setattr(upsert, "written", lambda df, label, below=None: (labels.append(label), plain(df, label, below))[1])
    rows = [(i, f"h{i % 7}", f"n{i}", "a", "DOF") for i in range(30)]
    got = upsert.insert_if_absent(tenders(spark, rows), path)
    assert {r._ord: r.estatus for r in got.collect()} == sequential(rows)
    assert labels == ["rows", "known", "racing", "told", "racing", "insert"]


def test_edition_calendar(spark):
    days = calendar.edition_calendar(spark, "2025-08-01", "2025-08-14")
    assert [str(r.fecha) for r in days.orderBy("fecha").collect()] == ["2025-08-05", "2025-08-07", "2025-08-12", "2025-08-14"]
    loaded = spark.createDataFrame([("2025-08-05", "MAT")], "f string, edicion string").select(F.col("f").cast("date").alias("fecha"), "edicion")
    assert calendar.missing_editions(days, loaded).count() == 7


def test_schema_round_trip(spark, tmp_path):
    path = str(tmp_path / "t")
    upsert.create_table(spark, path)
    table = upsert.read_table(spark, path)
    assert table.columns == COLUMNS and [f.dataType for f in table.schema] == [f.dataType for f in TENDER]
