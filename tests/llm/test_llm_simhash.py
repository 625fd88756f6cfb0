"""SimHash against pairwise comparison, and the defined cases."""

import random
import re

import numpy as np
import xxhash

from pregonero.llm import simhash
from pregonero.operators.components import connected


def plain_fingerprint(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values, radius):
    """Index of the first member of each value's component."""
    label = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label


def test_fingerprint(spark):
    texts = [None, "", " \n", "One", "one two", "A b c", "a B C d e e e a b c É é", "x " * 70_000, "\x0bq\x0cw\x1fe r"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.fp & (1 << 64) - 1 for r in simhash.fingerprints(docs).collect()}
    assert got == {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    native = spark.sql("select xxhash64('a b c') h").first()[0] & (1 << 64) - 1
    assert got[5] == native


def family(rng, n):
    """Values near each other in chains, copies, and far ones."""
    values = [rng.getrandbits(64) for _ in range(n // 3)]
    while len(values) < n:
        v = rng.choice(values)
        for b in rng.sample(range(64), rng.randint(0, 5)):
            v ^= 1 << b
        values.append(v)
    return values


def test_bit_sliced_forest_equals_pairwise_comparison():
    rng = random.Random(1)
    for radius in (0, 1, 2, 3, 5):
        values = family(rng, 300)
        signed = np.array(values, np.uint64).view(np.int64)
        buckets = np.array([i % 4 for i in range(300)], np.int64)
        a, b = simhash.forest(buckets, signed, radius)
        links = {(int(x), int(y)) for x, y in zip(a, b)}
        want = set()
        for k in range(4):
            own = sorted(int(v) for v in signed[buckets == k])
            label = plain_components([v & (1 << 64) - 1 for v in own], radius)
            want |= {(own[i], own[label[i]]) for i in range(len(own)) if own[i] != own[label[i]]}
        assert {x for x in links if x[0] != x[1]} == want


def test_components_equal_pairwise_comparison(spark):
    rng = random.Random(2)
    values = family(rng, 250) + [0, 0, 7]
    rows = [(i * 3 % 251, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(values)]
    marked = spark.createDataFrame(rows, "doc_id long, fp long")
    label = plain_components(values, 3)
    smallest = {}
    for (d, _), x in zip(rows, label):
        smallest[x] = min(d, smallest.get(x, d))
    want = sorted((d, smallest[x]) for (d, _), x in zip(rows, label))
    for chunk in (2048, 4):  # with chunks of 4 the large buckets are cut and dealt in pairs
        old, simhash.CHUNK = simhash.CHUNK, chunk
        try:
            edges = simhash.links(marked.select("fp").distinct(), 3, chunk)
            star = {r.node: r.root for r in connected(edges).collect()}
        finally:
            simhash.CHUNK = old
        roots = {}
        for (d, v) in rows:
            roots.setdefault(star.get(v, v), []).append(d)
        assert sorted((d, min(ds)) for ds in roots.values() for d in ds) == want
    found = marked.join(simhash.group(marked, "doc_id", 3), "fp")
    assert sorted((r.doc_id, r.component_id) for r in found.collect()) == want


def test_nulls_copies_ties_and_keeping_one(spark):
    text = "the quick brown fox jumps over the lazy dog and runs away from all the others that came " * 3
    rows = [(5, text, 1), (3, text, 1), (3, text, 1), (None, text, 2), (9, None, 1), (8, "", 1), (7, "quite another text altogether, told at length", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, FP int")
    got = sorted(((r.doc_id or -1), r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == [(-1, 3), (3, 3), (3, 3), (5, 3), (7, 7), (8, 8), (9, 8)]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 7, 8]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.keep_one(docs.limit(0)).count() == 0


def test_large_group_of_copies_and_near_copies(spark):
    words = [f"w{i}" for i in range(400)]
    rng = random.Random(4)
    rows = [(i, " ".join(words)) for i in range(300)]
    for i in range(300, 600):
        own = list(words)
        own[rng.randrange(400)] = f"x{i}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    values = [plain_fingerprint(t) for _, t in rows]
    label = plain_components(values, 3)
    assert sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()) == [(i, x) for i, x in enumerate(label)]
