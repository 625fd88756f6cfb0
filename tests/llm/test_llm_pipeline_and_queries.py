"""The pipeline's stages against the operators' plain versions, the registered queries, and the guard of the entry file."""

import os
import subprocess
import sys

import pytest

import corpus_pipeline
from catalog.check import connect, normalised
from pregonero.llm import quality_rules
from pregonero.llm.queries import CHECKS, QUERIES

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")

GOOD = "Every document of this kind starts with words that nobody else uses, number {0}, and so it is clean. "
LONG = (
    "A passage that several documents share has to be of some length before it counts as shared at all. It goes on with a "
    "second sentence that is long enough as well, so that both of them are found together."
)


def inputs(spark, folder):
    texts = {i: GOOD.format(i) + " ".join(f"w{i}x{j}" for j in range(60)) + "." for i in range(40)}
    texts[40] = "a | b | c | d | e | f | g | h | i | j | k"  # navigation only
    texts[41] = texts[1] + "\n" + LONG
    texts[42] = texts[2].replace("number 2", "number 2b") + "\n" + LONG
    texts[43] = texts[3]  # a copy
    texts[44] = texts[4].replace("w4x30", "changed")  # line dedup leaves the sentence that differs
    texts[45] = texts[5] + "\nthe answer to this benchmark question is forty two of course my friend"
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in texts.items()] + [(None, None, None, None, None), (60, "", "en", None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    bench = [(1, "The answer to this benchmark question is forty two of course, my friend."), (2, None)]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return texts


def test_stages_have_effect_and_keep_clean_documents(spark, tmp_path):
    texts = inputs(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "simhash_near_dedup", "decontamination", "mixing"]
    ids = {}
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, str(tmp_path))
        if name != "mixing":
            assert out.columns == docs.columns
        rows = out.collect()
        assert all(r.n_chars == len(r.text) for r in rows)
        ids[name] = {r.doc_id: r.text for r in rows}
        if name == "quality_rules":
            assert set(ids[name]) == {i for i, t in texts.items() if quality_rules.judge_text(t)[6]}
        docs = spark.createDataFrame(rows, out.schema)
    assert 40 not in ids["quality_rules"] and 60 not in ids["quality_rules"] and None not in ids["quality_rules"]
    assert LONG in ids["line_dedup"][41] and LONG not in ids["line_dedup"].get(42, "")
    assert 43 not in ids["line_dedup"]  # nothing is left of the copy
    assert 44 in ids["line_dedup"] and 44 not in ids["simhash_near_dedup"]
    assert 45 not in ids["decontamination"] or "forty two" not in ids["decontamination"][45]
    clean = set(range(40))
    assert clean <= set(ids["decontamination"])
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in final) == sorted(ids["mixing"]) and all(0 < r.taken <= 3 * r["size"] for r in final)


def test_stages_on_an_empty_table(spark, tmp_path):
    inputs(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, str(tmp_path))
        assert docs.count() == 0


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(CHECKS) <= set(QUERIES)


@needs_data
@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_matches_check(spark, name):
    con, df = connect(SF), QUERIES[name](spark, SF)
    got = normalised(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(CHECKS[name])
    assert got == normalised([d[0] for d in rel.description], rel.fetchall())


@needs_data
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(CHECKS)))
def test_query_has_a_row_for_each_document(spark, name):
    rows = QUERIES[name](spark, SF).count()
    assert rows == spark.read.parquet(f"{SF}/documents.parquet").count() or name == "op8_secret_scan"


def test_entry_file_works_without_the_subpackage(tmp_path):
    for item in ("__spark_entry__.py", "catalog"):
        os.symlink(f"{ROOT}/{item}", tmp_path / item)
    os.mkdir(tmp_path / "pregonero")
    for item in os.listdir(f"{ROOT}/pregonero"):
        if item not in ("llm", "__pycache__"):
            os.symlink(f"{ROOT}/pregonero/{item}", tmp_path / "pregonero" / item)
    code = (
        f"import sys; sys.path.insert(0, {str(tmp_path)!r}); import importlib.util as u; s = u.spec_from_file_location('e', {str(tmp_path / '__spark_entry__.py')!r});"
        "m = u.module_from_spec(s); s.loader.exec_module(m); q = m.queries(); assert len(q) > 200 and not any(n.startswith('op') or n == 'pipeline' for n in q), 'found'"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_simhash_takes_what_line_dedup_and_minimum_hashes_leave(spark, tmp_path):
    """Fingerprints count repeats: here a passage said again and again outweighs the words that differ, of which sets are made."""
    passage = " ".join(f"p{j}" for j in range(11)) + " "
    rows = [(i, passage * 300 + " ".join(f"w{i}x{j}" for j in range(60)), "en", "s", 1) for i in range(2)]
    rows.append((2, " ".join(f"other{j}" for j in range(80)), "en", "s", 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()) == [0, 2]


def test_stages_leave_no_large_tables_behind(spark):
    """Windows, marks and the positional index go as soon as what they tell is written."""
    import os

    import corpus_pipeline
    from pregonero.llm import decontamination, line_dedup
    from pregonero.session import application_dir

    def labels():
        return {f.rsplit("-", 1)[0] for f in os.listdir(folder) if f not in before}

    folder = application_dir(spark).removeprefix("file:")
    long = " ".join(f"palabra{i}" for i in range(40))
    docs = spark.createDataFrame([(1, long), (2, f"{long}\notra"), (3, "tres " * 30), (4, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "tres " * 10)], "item_id long, text string")
    before = set(os.listdir(folder))
    assert decontamination.drop_contaminated(docs, bench).count() == 3
    assert labels() == {"hits"}
    assert line_dedup.clean(docs).count() == 4
    assert labels() == {"hits", "line-blocks"}
    docs.write.parquet(f"{folder}/given/documents.parquet")
    assert corpus_pipeline.near_duplicates(spark, docs, f"{folder}/given").count() == 3
    assert not labels() & {"near", "near-rows", "near-left", "near-later", "near-bands", "near-dealt"}
