"""Language identification: held-out accuracy, features, and the defined cases."""

import random

import numpy as np

from pregonero.llm import language_id as li

STEMS = {
    "aa": ["shra", "kto", "ghen", "ulm", "dra"], "bb": ["lou", "mei", "éa", "oui", "sée"], "cc": ["zzy", "xyl", "qwo", "vix", "jaz"],
}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(STEMS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n)) + "."


def rows(seed=1, n=240):
    rng = random.Random(seed)
    return [(i, text(rng, lang, rng.randint(3, 40)), lang) for i, lang in enumerate(rng.choices(list(STEMS), k=n))]


def test_held_out_accuracy_and_rejection(spark):
    learn, judge = rows(1), rows(2)
    model = li.fit(spark.createDataFrame(learn, "id long, text string, lang string"))
    found = li.identify(spark.createDataFrame(judge, "id long, text string, lang string"), model).collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) >= 0.99
    assert np.mean([r.accepted for r in found]) >= 0.9 and all(0 <= r.score <= 1 for r in found)
    strange = spark.createDataFrame([(1, "бвгд жзик лмно прст уфхц")], "id long, text string")
    assert not li.identify(strange, model).first().accepted


def test_bucket_counts_by_hand():
    counts = li.bucket_counts("Ab--B")
    assert counts.sum() == 6 + 5 + 4  # " ab b " has so many 1-, 2- and 3-grams
    assert (counts == li.bucket_counts("aB 77 b")).all()  # digits and punctuation are one space
    assert li.bucket_counts(" 12 .,!") is None and li.bucket_counts(None) is None and li.bucket_counts("") is None


def test_clusters_are_separate_and_of_length_one():
    rng = np.random.default_rng(0)
    groups = np.eye(40)[[0, 10, 20]]
    vectors = np.abs(np.repeat(groups, 30, axis=0) + rng.normal(0, 0.02, (90, 40)))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    centroids, limits = li.fit_centroids(vectors.astype(np.float32), 3)
    assert sorted(np.argmax(centroids, axis=1)) == [0, 10, 20]
    assert np.allclose(np.linalg.norm(centroids, axis=1), 1, atol=1e-5) and (limits < 1).all()


def test_nulls_no_letters_long_texts_repeats_and_clashing_names(spark):
    learn = rows(3) + [(1, None, "aa"), (2, "text", None), (3, "", "bb"), (None, "shra kto", "aa")]
    model = li.fit(spark.createDataFrame(learn, "id long, text string, lang string"))
    rng = random.Random(5)
    long = text(rng, "cc", 60_000)
    judge = [(1, None, "x"), (2, " 12! ", "x"), (3, "", "x"), (4, long, "x"), (4, long, "x"), (None, "lou mei", None)]
    out = li.identify(spark.createDataFrame(judge, "id long, text string, SCORE string"), model)
    assert out.columns == ["id", "text", "SCORE", "lang_pred", "_score", "accepted"]
    got = out.collect()
    assert [r.lang_pred for r in got] == ["und", "und", "und", "cc", "cc", "bb"] and [r["_score"] for r in got[:3]] == [0.0] * 3
    assert li.identify(spark.createDataFrame(judge, "id long, text string, s string").limit(0), model).count() == 0


def test_nothing_to_learn_from_and_one_document(spark):
    none = li.fit(spark.createDataFrame([], "id long, text string, lang string"))
    judge = spark.createDataFrame([(1, "some text")], "id long, text string")
    assert li.identify(judge, none).first().lang_pred == "und"
    one = li.fit(spark.createDataFrame([(1, "shra", "aa")] * 50, "id long, text string, lang string"))
    assert li.identify(judge, one).first().lang_pred == "aa"


def test_sample_is_bounded_and_does_not_depend_on_partitions(spark):
    table = spark.createDataFrame(rows(6, 300), "id long, text string, lang string")
    a, b = li.fit(table, sample=20), li.fit(table.repartition(5), sample=20)
    assert a.languages == b.languages and np.allclose(a.idf, b.idf)
