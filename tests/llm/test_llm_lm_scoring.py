"""Language model: base figures by hand, probabilities that sum to 1, gain over the base, and the defined cases."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from pregonero.llm import lm_scoring as lm


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), "\n"]


def corpus(seed, n=200):
    """Two kinds of sentences, so the words before tell much about the next."""
    rng = random.Random(seed)
    a, b = [f"a{i}" for i in range(30)], [f"b{i}é" for i in range(30)]
    return [(i, " ".join(rng.choice(kind) for _ in range(rng.randint(1, 30)))) for i, kind in enumerate(rng.choices([a, b], k=n))]


@pytest.fixture(scope="module")
def learned(spark):
    rows = corpus(1) + [(1000, None), (1001, ""), (1002, "Rare WORD " + "x" * 100)]
    return rows, lm.fit(spark.createDataFrame(rows, "id long, text string"), words=40, head=50, passes=5)


def test_base_score_and_counts_by_hand(spark, learned):
    rows, model = learned
    counts = Counter(t for _, text in rows for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    assert (model.n, model.v) == (n, v) and len(model.lookup.numbers) <= 50
    judged = [(i, t) for i, t in corpus(2, 40)] + [(90, None), (91, ""), (92, "never seen words here " + "x" * 100), (92, "B1é b1É A1")]
    found = lm.score(spark.createDataFrame(judged, "id long, text string"), model).collect()
    got = sorted((r.id, r.n_tokens, r.n_known, round(r.base_score, 8)) for r in found)
    want = []
    for i, text in judged:
        ts = tokens(text)
        base = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts)
        want.append((i, len(ts), sum(counts[t] > 0 for t in ts), round(base, 8)))
    assert got == sorted(want)
    assert sum(r.score for r in found if r.id < 40) > sum(r.base_score for r in found if r.id < 40)


def test_probabilities_sum_to_one(spark, learned):
    rows, model = learned
    one, two, b, sums = model.lookup.tables
    n = model.lookup.n_classes
    rng = np.random.default_rng(0)
    for _ in range(50):
        u, w = rng.integers(0, n + 1, 2)
        assert abs(np.exp(one[w] + two[u] + b - sums[w, u]).sum() - 1) < 1e-4
    # and within a tail class: all its counted tokens and one unseen token share the class's probability
    counts = Counter(t for _, text in rows for t in tokens(text))
    own = set(sorted(counts, key=lambda t: (-counts[t], t))[: model.lookup.words]) & set(t for t in counts if len(t.encode()) <= 64)
    tail = [t for t in counts if t not in own]
    for k in {lm.tail_class(t.encode()) for t in tail}:
        total = sum(counts[t] + 0.1 for t in tail if lm.tail_class(t.encode()) == k) + 0.1
        assert abs(math.log10(total) - model.lookup.log_sum[k]) < 1e-9


def test_score_is_the_sum_of_its_parts(spark, learned):
    rows, model = learned
    counts = Counter(t for _, text in rows for t in tokens(text))
    text = "a1 a2 zzz rare b3é"
    _, classes, _ = model.lookup.read(text)
    want = float(model.lookup.log_probabilities(classes).sum()) / math.log(10)
    for t, c in zip(tokens(text), classes):
        if c >= model.lookup.words:
            want += math.log10(counts[t] + 0.1) - model.lookup.log_sum[c - model.lookup.words]
    got = lm.score(spark.createDataFrame([(1, text)], "id long, text string"), model).first().score
    assert abs(got - want) < 1e-6


def test_nothing_to_learn_from_long_text_and_no_rows(spark):
    empty = spark.createDataFrame([], "id long, text string")
    model = lm.fit(empty, words=8, head=8)
    row = lm.score(spark.createDataFrame([(1, "some words " * 40_000)], "id long, text string"), model).first()
    assert (row.n_tokens, row.n_known) == (80_001, 0) and math.isfinite(row.score) and math.isfinite(row.base_score)
    assert lm.score(empty, model).count() == 0


def test_all_tokens_train_the_model_whatever_the_size(spark, monkeypatch):
    rows = [(i, f"p{i} q{i} r{i}") for i in range(300)] + [(1000 + i, t) for i, t in corpus(3, 100)] + [(2000 + i, "p1 q1") for i in range(3000)]
    seen, most = spark.sparkContext.accumulator(0.0), spark.sparkContext.accumulator(0)
    plain = lm.train

    def counted(triples, weights, *rest):
        seen.add(float(weights.sum(dtype=float)))
        most.add(len(triples))
        return plain(triples, weights, *rest)

    monkeypatch.setattr(lm, "train", counted)
    model = lm.fit(spark.createDataFrame(rows, "id long, text string").repartition(4), words=40, head=50, passes=2, fit_rows=20)
    assert abs(seen.value - 2 * model.n) < 1e-3 * model.n
    assert most.value < model.n / 2  # a triple that occurs 3000 times is trained in shares


def test_triples_against_plain_counts(spark):
    rows = corpus(4, 60) + [(100, None), (101, "")]
    docs = spark.createDataFrame(rows, "id long, text string")
    order = [t for t, _ in sorted(Counter(t for _, x in rows for t in tokens(x)).items(), key=lambda c: (-c[1], c[0]))][:20]
    lookup = lm.Lookup([(t, 1) for t in order], 20, np.ones(lm.TAIL_CLASSES))
    want = Counter()
    for _, text in rows:
        kinds = [order.index(t) if t in order else 20 + lm.tail_class(t.encode()) for t in tokens(text)]
        padded = [20 + lm.TAIL_CLASSES] * 2 + kinds
        want.update(zip(padded, padded[1:], kinds))
    found = lm.count_triples(docs.select("text"), lm.shipped(spark, lookup))
    n, distinct = sum(want.values()), found.count()
    got = found.toPandas()
    assert dict(zip(map(tuple, lm.decoded(got["code"].to_numpy(), lookup.n_classes).tolist()), got["n"].tolist())) == dict(want)
    shares = lm.dealt(found, n, distinct).toPandas()
    back = shares.groupby("code")["weight"].sum()
    assert np.allclose(back[got["code"]], got["n"]) and shares["weight"].max() <= lm.MOST * n / distinct + 1e-6


def test_training_step_against_plain_numpy():
    rng = np.random.default_rng(5)
    counts = rng.integers(1, 50, 30).astype(float)
    triples = np.column_stack((rng.integers(0, 31, 200), rng.integers(0, 31, 200), rng.integers(0, 30, 200))).astype(np.int16)
    weights = rng.random(200).astype(np.float32) + 0.5
    p = lm.start_state(counts)
    before = {k: v.astype(float) for k, v in p.items()}
    lm.train(triples, weights, p, counts, np.random.default_rng(6))
    again = np.random.default_rng(6)
    order = again.permutation(200)
    noise = counts / counts.sum()
    drawn = np.minimum(np.searchsorted(np.cumsum(noise), again.random(lm.NOISE)), 29)
    gradient = {k: np.zeros_like(v) for k, v in before.items()}
    for i in order:
        (two, one, word), weight = triples[i], weights[i] / weights.mean()
        context = before["c1"] * before["r"][one] + before["c2"] * before["r"][two]
        for w, real in [(word, 1.0), *((k, 0.0) for k in drawn)]:
            score = context @ before["q"][w] + before["b"][w] - math.log(lm.NOISE * noise[w])
            d = (1 / (1 + math.exp(-score)) - real) * weight
            gradient["q"][w] += d * context
            gradient["b"][w] += d
            gradient["r"][one] += d * before["q"][w] * before["c1"]
            gradient["r"][two] += d * before["q"][w] * before["c2"]
            gradient["c1"] += d * before["q"][w] * before["r"][one] / 200
            gradient["c2"] += d * before["q"][w] * before["r"][two] / 200
    for k in ("q", "b", "r", "c1", "c2"):
        want = before[k] - lm.RATE * gradient[k] / np.sqrt(1 + gradient[k] ** 2)
        assert np.allclose(p[k], want, atol=1e-4), k


def test_states_are_averaged_by_tokens(spark):
    states = [(float(i), np.array([i, 2.0 * i]).tobytes()) for i in range(1, 20)]
    total, mean = lm.averaged(spark.createDataFrame(states, "n double, state binary"), 19)
    assert total == 190 and np.allclose(mean, np.array([1, 2]) * sum(i * i for i in range(20)) / 190)
    assert lm.averaged(spark.createDataFrame([], "n double, state binary"), 1) is None


def test_tokens_outside_the_head_make_one_column():
    column = lm.rest_column([Counter(["é".encode(), b"x", b"x"]), Counter(), Counter([b"x"])])
    assert column.to_pylist() == [[{"token": "é", "n": 1}, {"token": "x", "n": 2}], [], [{"token": "x", "n": 1}]]
    assert lm.rest_column([]).to_pylist() == []


def test_texts_in_a_row_are_read_as_each_alone(monkeypatch):
    monkeypatch.setattr(lm, "TOGETHER", 20)
    texts = [t for _, t in corpus(7, 50)] + [None, "", "x", "A b", "a1 a2 zzz b3é"]
    groups = list(lm.in_groups(lm.pa.array(texts, lm.pa.string())))
    assert [n for _, lengths in groups for n in lengths] == [len(tokens(t)) for t in texts] and len(groups) > 5
    lookup = lm.Lookup([(f"a{i}", 30 - i) for i in range(30)], 20, np.ones(lm.TAIL_CLASSES))
    got = np.concatenate([lookup.codes(lookup.read_tokens(ts)[1], lengths) for ts, lengths in groups])
    assert got.tolist() == [c for t in texts for c in lookup.codes(lookup.read(t)[1]).tolist()]
    start = lookup.n_classes
    assert lm.decoded(lookup.codes(np.array([1, 2, 3, 4]), [1, 2, 1]), start).tolist() == [
        [start, start, 1], [start, start, 2], [start, 2, 3], [start, start, 4]
    ]
