"""Cross-tokenizer alignment against a plain version, galloping against binary search, and the defined cases."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pregonero.llm import bpe, token_alignment
from pregonero.llm.queries import QUERIES, vocabulary

JSON = open(vocabulary("byte_bpe_50k.json"), encoding="utf-8").read()
MODEL = open(vocabulary("piece_bpe_32k.model"), "rb").read()
NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def plain(rows):
    a_lib, b_lib = Tokenizer.from_str(JSON), sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    a_lib.encode_special_tokens = True
    alphabet = bpe.byte_level_bytes()
    linked, out, held = [], [], Counter()
    for _, text in rows:
        links, groups, n = Counter(), [], (0, 0)
        if text:
            whole = (" " + text).encode()
            a = [(i, bytes(alphabet[c] for c in a_lib.id_to_token(i))) for i in a_lib.encode(" " + text, add_special_tokens=False).ids]
            b = []
            for i in b_lib.encode(text):
                name = b_lib.id_to_piece(i)
                b.append((i, bytes([int(name[3:5], 16)]) if b_lib.is_byte(i) else name.replace("▁", " ").encode()))
            if b"".join(x[1] for x in a) == whole == b"".join(x[1] for x in b):
                n = len(a), len(b)
                i = j = ends_a = ends_b = 0
                group = ([], [])
                while i < len(a) or j < len(b):
                    if ends_a <= ends_b:
                        ends_a += len(a[i][1])
                        group[0].append(a[i][0])
                        i += 1
                    else:
                        ends_b += len(b[j][1])
                        group[1].append(b[j][0])
                        j += 1
                    if ends_a == ends_b:
                        groups.append(group)
                        group = ([], [])
                for x, y in groups:
                    links.update((p, q) for p in x for q in y)
        linked.append(links)
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append([*n, len(groups), sum(links.values()), hashlib.sha256(said.encode()).hexdigest() if groups else ""])
        held.update(links.keys())
    most = defaultdict(int)
    for (p, _), n in held.items():
        most[p] = max(most[p], n)
    return [
        (key, *row[:4], sum(v for x, v in links.items() if held[x] == most[x[0]]), sum(v * held[x] for x, v in links.items()), row[4])
        for (key, _), row, links in zip(rows, out, linked)
    ]


def run(docs, **more):
    found = token_alignment.link_counts(token_alignment.align(docs, JSON, MODEL), **more)
    return sorted((tuple(r) for r in found.withColumnRenamed("id", "doc_id").select(*NAMES).collect()), key=lambda r: (r[0] is not None, r))


def test_gallop_is_a_binary_search():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 1000):
        longer = np.unique(rng.integers(0, 5 * n, n))
        driver = rng.integers(-2, 5 * n + 3, 500)
        low = rng.integers(0, len(longer), 500)
        high = low + 1 + rng.integers(0, len(longer), 500) % (len(longer) - low)
        got = token_alignment.gallop(driver, longer, rng.integers(-3, len(longer) + 3, 500), low, high)
        assert got.tolist() == [int(lo + np.searchsorted(longer[lo:hi], d)) for d, lo, hi in zip(driver, low, high)]


def test_against_plain_version(spark):
    rng = random.Random(5)
    texts = [
        None, "", " ", "a", " a", "a  b", "ends with space ", "two\nlines", "tab\there", "ſtrange ﬁ ligature ①", "<s> </s> <unk> <0x0A> <|endoftext|> ▁", "日本語の文章です",
        "Ñandú über naïve façade", "12345 67.89", "😀😀 ok", "x" * 3000, "ab " * 2000, "no break", "é combined", "\x00\x01", "same text here", "same text here",
    ]
    words = ["the", "Cat", "sat,", "on", "über", "12", "naïve", "pre-order", "\n", "tokenization", "ación", "ß", "don't"]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 80))) for _ in range(60)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("PAIRS", F.lit(1)).withColumn("row", F.lit(2)).repartition(3)
    wanted = sorted(plain(rows))
    assert run(docs) == wanted
    assert run(docs, most_frequent=3) == wanted  # nearly all pairs go through the shuffle
    assert any(w[1] for w in wanted) and any(w[1] != w[3] for w in wanted)


def test_wide_groups_are_counted_by_distinct_ids():
    a, b = np.array([1, 2, 1, 3]), np.array([7, 7, 8])
    args = a, b, np.array([0, 4]), np.array([0, 3]), np.array([0])
    narrow = [x.tolist() for x in token_alignment._linked_pairs(*args)]
    token_alignment.WIDE, kept = 1, token_alignment.WIDE
    try:
        assert [x.tolist() for x in token_alignment._linked_pairs(*args)] == narrow
    finally:
        token_alignment.WIDE = kept
    assert dict(zip(narrow[1], narrow[2]))[token_alignment.SHIFT + 7] == 4


def test_null_ids_and_empty_table(spark):
    rows = [(None, "one two"), ("x", "one two"), ("x", "one two"), ("y", None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    assert run(docs) == sorted(plain(rows), key=lambda r: (r[0] is not None, r))
    assert run(docs.limit(0)) == []


def test_query_against_plain_version(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, QUERIES["op13_token_alignment"](spark, sf).select(*NAMES).collect())) == sorted(plain(rows))
