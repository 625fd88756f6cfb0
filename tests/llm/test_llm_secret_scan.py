"""Secret scan: candidates and features by hand, held-out accuracy, and the defined cases."""

import random
import string

import pytest
from pyspark.sql import functions as F

from pregonero.llm import secret_scan as s


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def rows(seed, n=300):
    rng = random.Random(seed)
    hexes = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k - 2)) + "a1"
    out = []
    for i in range(n):
        kind = i % 6
        word = [
            f"password={hexes(18)}", f'token = "{hexes(40)}"', "AKIA" + "".join(rng.choice(string.ascii_uppercase + string.digits) for _ in range(16)),
            "".join(rng.choice(string.digits) for _ in range(16)), f"name{i}@mail{i % 9}.example.com", f"10.{i % 150 + 100}.12.{i % 99 + 100}",
        ][kind]
        out.append((i, f"the words before it come here {word} and the words after it", "src/main", int(kind < 3)))
    return out


def test_candidates(spark):
    text = 'x password=abcdef123456 token = "0123456789abcdef", short1 "abc123def456ghi" secret: hunter22x\n\tplainwordswithout 4111111111111111.'
    found = s.candidates(docs_of(spark, [(1, text, "a/b"), (2, None, None), (3, "", "x"), (1, "no digits", "x")])).orderBy("place").collect()
    assert [(r.place, r.value) for r in found] == [
        (1, "abcdef123456"), (4, "0123456789abcdef"), (6, "abc123def456ghi"), (8, "hunter22x"), (10, "4111111111111111"),
    ]
    assert (found[1].before, found[1].after) == ("token =", "short1")


def test_features_by_hand(spark):
    found = s.candidates(docs_of(spark, [(1, "my token = aB3dE6-the99 test", "src/tests/x")])).withColumn("row_no", F.lit(1).cast("long"))
    known = s.dictionary(docs_of(spark, [(1, "the cat", None)]))
    r = s.features(found, known).first()
    assert (r.length, r.transitions, r.distinct_share, r.hex_only) == (12.0, 8.0, 11 / 12, 0.0) or r.length == 12.0
    assert abs(r.coverage - 1.0) < 1e-9  # "the" is the only trigram of letters
    assert (r.key_before, r.example_near, r.example_path) == (1.0, 1.0, 1.0)


def test_forest_on_held_out_findings(spark):
    learn, judge = rows(1), rows(2)
    table = lambda r: docs_of(spark, [x[:3] for x in r])
    known = s.dictionary(table(learn))
    def told(r):
        found = s.candidates(table(r)).withColumn("row_no", F.monotonically_increasing_id())
        truth = spark.createDataFrame([(x[0], float(x[3])) for x in r], "id long, truth double")
        return s.features(found, known).join(truth, "id")
    model = s.fit(told(learn).withColumn("label", F.col("truth")))
    judged = s.judge(told(judge), model).collect()
    assert len(judged) == len(judge)
    assert sum(r.is_secret == bool(r.truth) for r in judged) / len(judged) >= 0.98


def test_scan_repeats_nulls_long_texts_and_no_rows(spark):
    data = [x[:3] for x in rows(3, 60)]
    data += [data[0], data[0], (500, None, None), (None, "password=0123456789abcdef01", None), (501, "word " * 60_000 + "password=0123456789abcdef02", "p")]
    found = s.scan(docs_of(spark, data)).collect()
    assert sum(r.doc_id == 0 for r in found) == 3
    assert {r.doc_id: r.place for r in found}[501] == 60_000
    assert all(r.is_secret == bool(r.label) for r in found if r.label is not None)
    assert s.scan(docs_of(spark, data).limit(0)).count() == 0


def test_one_label_only_keeps_everything(spark):
    found = s.scan(docs_of(spark, [(1, "password=0123456789abcdef01", "x"), (2, "token: 0123456789abcdef99", "y")])).collect()
    assert [(r.score, r.is_secret) for r in found] == [(None, True), (None, True)]


@pytest.mark.parametrize("native", ["PythonUDF", "ArrowEval", "MapInPandas", "MapInArrow"])
def test_main_path_has_no_python(spark, native):
    found = s.candidates(docs_of(spark, [(1, "password=0123456789abcdef01", "x")]))
    assert native not in found._jdf.queryExecution().toString()
