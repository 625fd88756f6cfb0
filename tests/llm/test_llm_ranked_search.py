"""Ranked search against a plain scorer, with pruning and many slices, and the defined cases."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from pregonero.llm import ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def plain(docs, items, k):
    counts = [(key, Counter(terms(text))) for key, text in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for row, (key, c) in enumerate(counts):
            score = 0
            for t in terms(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    m = 100 - 25 + 25 * sum(c.values()) * n_docs // n_terms
                    score += w * (1000000000 * c[t] // (1000 * c[t] + 12 * m))
            if score > 0:
                found.append((-score, key is None, key or 0, row))
        out += [(item, rank, None if none else key, -score) for rank, (score, none, key, _) in enumerate(sorted(found)[:k], 1)]
    return out


def run(spark, docs, items, k, slice_docs=4096, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("TERM", F.lit(1)).withColumn("slice", F.lit(1)).repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(0)).withColumn("item", F.lit(0))
    found = ranked_search.search(ranked_search.build_index(d, slice_docs=slice_docs), i, k=k, **more)
    return [tuple(r) for r in found.select("item_id", "rank", "id", "score").collect()]


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def made(rng, n, words):
    """Texts of words with falling frequencies."""
    return [" ".join(f"W{int(rng.paretovariate(0.6)) % words}" for _ in range(rng.randrange(1, 60))) for _ in range(n)]


def test_against_plain_scores(spark):
    rng = random.Random(8)
    docs = list(enumerate(made(rng, 400, 300)))
    items = list(enumerate(made(rng, 15, 300)))
    for k, slice_docs, more in ((20, 4096, {}), (3, 20, {"stages": 5, "bundle_items": 4}), (1, 50, {"stages": 1}), (500, 64, {"stages": 2})):
        assert order(run(spark, docs, items, k, slice_docs, **more)) == order(plain(docs, items, k)), (k, slice_docs)


def test_defined_cases(spark):
    docs = [(5, None), (4, ""), (3, "Ärger ärger a-b_C"), (2, "a b c"), (1, "a b c"), (None, "a b c"), (1, "a b c"), (9, "?!"), (7, "a " * 30_000), (8, "éa")]
    items = [(1, "a A zzz"), (1, "a"), (None, "c"), (3, None), (4, "Ärger"), (5, "éA É")]
    assert order(run(spark, docs, items, 4, 2)) == order(plain(docs, items, 4))
    assert run(spark, docs[:0], items, 4) == [] and run(spark, docs, items[:0], 4) == [] and run(spark, docs[:2], items, 4) == []


def test_accumulators_that_cannot_win_are_left_out():
    """One stage by hand: the bound of later owners decides who stays."""
    import numpy as np
    import pyarrow as pa

    left = pa.table(
        {
            "slice": pa.array([0]), "bundle": pa.array([0]), "lengths": pa.array([[5, 5, 5]], pa.list_(pa.int32())), "items": pa.array([[7]], pa.list_(pa.int32())),
            "later": pa.array([[[9, 100]]]), "places": pa.array([[[0, 1, 2]]], pa.list_(pa.list_(pa.int32()))), "scores": pa.array([[[500, 399, 400]]]),
        }
    )
    right = pa.table(
        {
            "places": pa.array([[2]], pa.list_(pa.int32())), "times": pa.array([[1]], pa.list_(pa.int32())), "weight": [0], "n_docs": [3], "n_terms": [15],
            "items": [[7]], "repeats": [[1]],
        }
    )
    done = ranked_search._add_stage(1, 0, False)(left, right)
    assert done.column("places").to_pylist() == [[[0, 2]]] and done.column("scores").to_pylist() == [[[500, 400]]]
    assert ranked_search._best(np.array([3, 0, 5, 5]), 2).tolist() == [2, 3]
