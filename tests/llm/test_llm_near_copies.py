"""Near copies: links against all pairs, pairs that differ in a few words, and the defined cases."""

import random

import numpy as np

from pregonero.llm import near_copies as n
from pregonero.llm.store import stage


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def changed(rng, text, share):
    return " ".join(f"new{rng.random()}" if rng.random() < share else w for w in text.split())


def plain_first(rows):
    """Ids that stay: the smallest of each component."""
    sets, label = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if similar(sets[i], sets[j]) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    first = {}
    for (i, _), x in zip(rows, label):
        first[x] = min(first.get(x, i), i)
    return sorted(first.values())


def test_forest_against_all_pairs():
    rng = np.random.default_rng(4)
    for _ in range(30):
        sets = [np.unique(rng.choice(14, rng.integers(4, 14)).astype(np.uint64)) for _ in range(rng.integers(2, 20))]
        label = list(range(len(sets)))
        for i in range(len(sets)):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = sorted((label[i], label[j]))
                    label = [a if x == b else x for x in label]
        assert n.forest(sets).tolist() == label


def test_texts_with_changed_words_go_and_less_similar_ones_stay(spark):
    rng = random.Random(5)
    rows = []
    for d in range(60):
        text = " ".join(f"w{rng.randrange(5000)}" for _ in range(200))
        rows += [(10 * d, text), (10 * d + 1, changed(rng, text, 0.01)), (10 * d + 2, changed(rng, text, 0.02)), (10 * d + 3, changed(rng, text, 0.08))]
    want = plain_first(rows)
    assert 60 < len(want) < 180
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in n.keep_one(docs).collect()) == want


def test_large_groups_are_cut_into_chunks(spark):
    rng = random.Random(6)
    texts = [" ".join(f"t{k}w{rng.randrange(5000)}" for _ in range(150)) for k in range(3)]
    rows = [(i, changed(rng, texts[i % 3], 0.006)) for i in range(90)]
    docs = spark.createDataFrame(rows, "row long, text string").withColumnRenamed("row", "id")
    marked = n.marked(docs, "text", 5, "fp", "bands").withColumnRenamed("id", "row")
    marked = stage(marked, "test")
    label = {}
    for a, b in n.links(marked, marked, chunk=8).collect():
        x, y = label.get(a, a), label.get(b, b)
        label = {k: (x if v == y else v) for k, v in {**label, a: x, b: y}.items()}
    assert len(set(label.values())) + len({n.text_key(n.folded(t)) for _, t in rows} - set(label)) == len(plain_first(rows))


def test_nulls_copies_short_texts_clashing_names_and_no_rows(spark):
    rows = [(3, "A  b c", 1), (1, "a B\nc", 2), (None, "a b c", 3), (2, None, 4), (4, " \n", 5), (5, "a b", 6), (6, "x " * 50_000, 7), (7, "x " * 9, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, FP int")
    kept = n.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 5, 6]
    assert n.keep_one(docs.limit(0)).count() == 0


def test_near_copies_of_which_a_rest_is_left_go_by_their_earlier_texts(spark):
    rng = random.Random(7)
    before, now, rest = [], [], "thank you for reading"
    for d in range(20):
        text = " ".join(f"w{rng.randrange(5000)}" for _ in range(100))
        near = changed(rng, text, 0.01)
        shares_half = " ".join(text.split()[:50]) + " " + " ".join(f"v{rng.randrange(5000)}" for _ in range(50))
        before += [(10 * d, text), (10 * d + 1, near), (10 * d + 2, shares_half)]
        now += [(10 * d, text), (10 * d + 1, near[-40:]), (10 * d + 2, shares_half[-200:])]
    before += [(500, before[0][1] + " " + rest), (501, before[3][1] + " " + rest)]
    now += [(500, rest), (501, rest)]
    # ids that are new, repeated, or null are judged by their present texts
    before += [(600, "same a b c d e f"), (600, "same a b c d e f"), (None, "null a b c d"), (700, None)]
    now += [(600, "one text of six hundred"), (600, "another text of the same id"), (None, "null a b c d"), (700, None), (800, "a new one")]
    docs = spark.createDataFrame(now, "doc_id long, text string")
    kept = [r.doc_id for r in n.keep_one(docs, earlier=spark.createDataFrame(before, "doc_id long, text string")).collect()]
    near = [r for r in before[:60] if r[0] % 10 < 2]
    gone = {i for i, _ in near} - set(plain_first(near))
    want = [i for i, _ in now[:60] if i not in gone]
    assert len(gone) > 15
    # 500 and 501 are near copies of 0 and 10 (four words more), and go with them
    assert sorted(i for i in kept if i is not None) == sorted(want + [600, 600, 700, 800]) and None in kept
    assert n.keep_one(docs.limit(0), earlier=docs).count() == 0 and n.keep_one(docs, earlier=docs.limit(0)).count() > 0


def test_equal_rests_do_not_join_what_they_were_cut_from(spark):
    rng = random.Random(8)
    a, b = ("".join(f"{k}{rng.randrange(5000)} " for _ in range(100)) for k in "ab")
    extra = "".join(f"c{rng.randrange(5000)} " for _ in range(60))
    before = [(1, a), (2, b), (3, a + extra), (4, b + extra)]
    now = [(1, a), (2, b), (3, extra), (4, extra)]
    docs, earlier = (spark.createDataFrame(r, "doc_id long, text string") for r in (now, before))
    assert sorted(r.doc_id for r in n.keep_one(docs, earlier=earlier).collect()) == [1, 2, 3]
