"""Changes merged on read against a sequential model, files written, and folds."""

import json
import random

from pyspark.sql import functions as F

from pregonero.operators import changes, upsert
from pregonero.schema import COLUMNS, conform
from pregonero.session import hadoop_path


def rows(spark, values):
    """(hash, fuente, titulo, municipio, entidad, originales, especificos)"""
    names = ["hash_contenido", "fuente", "titulo", "municipio", "entidad_federativa", "datos_originales", "datos_especificos"]
    return conform(spark.createDataFrame(values, ", ".join(f"{n} string" for n in names)))


def state(spark, path):
    return {
        r.hash_contenido: (r.titulo, r.municipio, r.entidad_federativa, json.loads(r.datos_originales or "null"), json.loads(r.datos_especificos or "null"))
        for r in upsert.read_table(spark, path).collect()
    }


def test_random_changes_equal_a_sequential_model(spark, tmp_path):
    rng, path = random.Random(11), f"file://{tmp_path}/t"
    base = [(f"h{i}", "DOF" if i % 2 else "X", f"t{i}", None if i % 3 else "m", None, '{"a":1}' if i % 4 else None, None) for i in range(30)]
    upsert.append_rows(rows(spark, base), path)
    model = {h: [t, m, e, json.loads(o or "null"), None] for h, _, t, m, e, o, _ in base}
    for step in range(9):
        keys = rng.sample([f"h{i}" for i in range(36)], 8)
        kind = ["upsert", "fill", "patch", "delete"][step % 4]
        if kind == "upsert":
            batch = [(h, "DOF" if int(h[1:]) % 2 else "X", f"n{step}{c}", f"m{step}{c}", None, '{"z":0}', None) for h in keys for c in "ab"]
            frame = rows(spark, batch).withColumn("_ord", F.concat("titulo"))
            changes.append_upsert(frame, path)
            for h in keys:
                if h in model:
                    model[h][1], model[h][2], model[h][4] = f"m{step}b", None, None
                else:
                    model[h] = [f"n{step}a", f"m{step}b", None, {"z": 0}, None]
        elif kind == "fill":
            parsed = spark.createDataFrame([(h, f"e{step}", f"f{step}", f'{{"k":{step}}}' if h > "h2" else None) for h in keys], "hash_contenido string, entidad_federativa string, municipio string, resultado string")
            changes.append_fill(parsed, path)
            for h in keys:
                if h in model:
                    m = model[h]
                    m[1], m[2] = m[1] or f"f{step}", m[2] or f"e{step}"
                    if h > "h2":
                        m[4] = {**(m[4] or {}), "k": step, "procesado": True}
        elif kind == "patch":
            changes.append_patch(spark.createDataFrame([(h, f'{{"p":{step}}}') for h in keys], "hash_contenido string, parche string"), path)
            for h in keys:
                if h in model:
                    model[h][3] = {**(model[h][3] or {}), "p": step}
        else:
            changes.append_delete(spark.createDataFrame([(h,) for h in keys], "hash_contenido string"), path)
            for h in keys:
                model.pop(h, None)
        if step in (4, 8):
            assert state(spark, path) == {h: tuple(v) for h, v in model.items()}
        if step == 5:
            changes.fold(spark, path)
            assert changes.batches(spark, path) == []
    changes.fold(spark, path)
    assert state(spark, path) == {h: tuple(v) for h, v in model.items()}
    assert upsert.read_table(spark, path).columns == COLUMNS


def files(spark, path):
    return set(spark.read.parquet(path).inputFiles())


def test_a_batch_writes_only_its_own_rows(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    upsert.append_rows(rows(spark, [(f"h{i}", "DOF", "t", "viejo", None, None, None) for i in range(500)]), path)
    before = files(spark, path)
    for k in range(3):
        batch = rows(spark, [(f"h{i + k}", "DOF", "t", f"m{k}", None, None, None) for i in range(10)]).withColumn("_ord", F.col("hash_contenido"))
        changes.append_upsert(batch, path)
    assert files(spark, path) == before and changes.pending(spark, path).count() == 30
    plan = upsert.read_table(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "FullOuter" not in plan
    got = state(spark, path)
    assert len(got) == 500 and [got[f"h{i}"][1] for i in (0, 1, 2, 9, 11, 12)] == ["m0", "m1", "m2", "m2", "m2", "viejo"]
    changes.append_upsert(batch, path, number=3)  # a batch that is written again
    assert state(spark, path) == got
    changes.fold(spark, path)
    assert state(spark, path) == got
    untouched = [f for f in before if f in files(spark, path)]
    changed = {r.n for r in spark.createDataFrame([(f"h{i}",) for i in range(12)], "hash_contenido string").select(changes.bucket().alias("n")).collect()}
    assert {f.split(f"{changes.BUCKET}=")[1].split("/")[0] for f in before} - {f.split(f"{changes.BUCKET}=")[1].split("/")[0] for f in untouched} == {str(n) for n in changed}


def test_inserts_see_keys_that_only_changes_hold(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    upsert.create_table(spark, path)
    one = rows(spark, [("h1", "DOF", "t", "m", None, None, None)]).withColumns({"_ord": F.lit(1), "numero_procedimiento": F.lit("1")})
    changes.append_upsert(one, path)
    assert upsert.insert_if_absent(one, path).first().estatus == upsert.DUPLICATE
    changes.append_delete(one, path)
    assert upsert.insert_if_absent(one.withColumn("hash_contenido", F.lit("h2")), path).first().estatus == upsert.INSERTED
    upsert.delete_source(spark, path, "DOF")
    assert state(spark, path) == {} and not changes.batches(spark, path)


def test_nothing_to_fold(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    upsert.create_table(spark, path)
    changes.fold(spark, path)
    assert changes.pending(spark, path) is None and not hadoop_path(spark, f"{path}/_cambios")[0].exists(hadoop_path(spark, f"{path}/_cambios")[1])
