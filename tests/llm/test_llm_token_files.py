"""Token files: exact round trips, damaged files, single blocks, and the pieces against whole texts."""

import json
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F, types as T
from tokenizers import Tokenizer

from pregonero.llm import bpe, context_coder, token_files
from pregonero.llm.queries import QUERIES, vocabulary

JSON = open(vocabulary("byte_bpe_50k.json"), encoding="utf-8").read()
MODEL = open(vocabulary("piece_bpe_32k.model"), "rb").read()
TEXTS = [
    None, "", " ", "  ", "\n", "one", " one", "one ", "one two", "one  two", "one \n two", "a\n b", "a \nb", "a\tb c", "x   y z  ", "it's 12 o'clock, don't",
    "<|endoftext|>", "say <|endoftext|> now", "say<|endoftext|>now x", "ß ñ é ü ö", "日本 語 の テキスト", "a b c　d e", "  x   y", "emoji 😀 😀x 😀",
    "a\x00b \x1c c \x85 d", "word " * 3000, "no-spaces-" * 2000,
]


def test_pieces_give_the_ids_of_whole_texts():
    rng = random.Random(1)
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(["a", "Bc", " ", " ", "\n", ".", "'s", "\t", "é", " ", "9"]) for _ in range(rng.randrange(60))) for _ in range(3000)]
    plain, pieces = Tokenizer.from_str(JSON), sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    for most in (5, 1_000_000):
        for before in ("", " "):
            cache = bpe.PieceCache(bpe.ByteLevel(JSON), after_space=before == " ", most=most)
            cache.known.clear()
            wanted = [plain.encode(before + t, add_special_tokens=False).ids if before + t != " " else [220] for t in texts]
            assert [i.tolist() for i in cache.ids(texts)] == [w if before + t else [] for w, t in zip(wanted, texts)]
            cache = bpe.PieceCache(bpe.SentencePieces(MODEL), after_space=True, most=most)
            cache.known.clear()
            assert [i.tolist() for i in cache.ids(texts)] == pieces.encode(texts)


class Counted:
    """A library that counts the texts it is given."""

    def __init__(self, library):
        self.library, self.texts = library, 0

    def encode(self, texts, **more):
        self.texts += 1 if isinstance(texts, str) else len(texts)
        return self.library.encode(texts, **more)

    def encode_batch_fast(self, texts, **more):
        self.texts += len(texts)
        return self.library.encode_batch_fast(texts, **more)


def test_new_pieces_are_learnt_together():
    """One text for many pieces, and the ids each has alone."""
    rng = random.Random(3)
    pieces = sorted({"".join(rng.choices("abcdeFGHé09.,-*\n", k=rng.randrange(1, 12))).strip("\n") or "x" for _ in range(2000)})
    pieces += ["it's", "<|endoftext|>", "a<|endoftext|>b", "c\n\nd", "e\tf", "日本", "a\u00a0b", "g\u3000h", "soft\u00adhyphen"]
    wholly, alone = Tokenizer.from_str(JSON), sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    library, known = bpe.ByteLevel(JSON), {}
    library.tokenizer, library.joined = Counted(library.tokenizer), Counted(library.joined)
    library.learn(pieces, known)
    assert [np.frombuffer(known[p], np.uint32).tolist() for p in pieces] == [wholly.encode(" " + p, add_special_tokens=False).ids for p in pieces]
    assert library.joined.texts + library.tokenizer.texts < len(pieces) // 2
    library, known = bpe.SentencePieces(MODEL), {}
    library.model = Counted(library.model)
    library.learn(pieces, known)
    assert [np.frombuffer(known[p], np.uint32).tolist() for p in pieces] == alone.encode(pieces)
    assert library.model.texts < len(pieces) // 2 + sum(not (p.isascii() and p.isprintable()) for p in pieces)


def test_joined_pieces_that_a_token_crosses_are_encoded_alone():
    """A vocabulary with a token over a letter and a full stop, which the pre-tokenizer never lets come about."""
    said = json.loads(JSON)
    said["model"]["vocab"]["a."] = len(said["model"]["vocab"]) + 10
    first = said["model"]["merges"][0]
    said["model"]["merges"].insert(0, "a ." if isinstance(first, str) else ["a", "."])
    text, known = json.dumps(said), {}
    assert bpe.crosses("a.") and not bpe.crosses(bpe.SPACE + "a") and bpe.crosses(bpe.SPACE * 2) and bpe.crosses("a" + bpe.SPACE)
    bpe.ByteLevel(text).learn(["a.", "b", "ba.c"], known)
    plain = Tokenizer.from_str(text)
    assert {p: np.frombuffer(i, np.uint32).tolist() for p, i in known.items()} == {p: plain.encode(" " + p).ids for p in ("a.", "b", "ba.c")}


@pytest.mark.parametrize("n", [1, 2, 511, 512, 513, 5000])
def test_coder_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (np.zeros(n, np.int64), rng.integers(0, 3, n), rng.integers(0, 60_000, n), np.r_[np.full(n - 1, 7), 59_999], np.arange(n) % 17):
        table = context_coder.histogram(ids)
        blocks = context_coder.encode(ids, table, 512)
        assert (context_coder.decode(blocks, table, n, 512) == ids).all()
        last = len(blocks) - 1  # a block alone
        assert (context_coder.decode_block(blocks[last], table, n - last * 512) == ids[last * 512 :]).all()


def test_coder_learns():
    """Repetition is cheaper than the histogram's entropy; what is rare still has a code."""
    rng = np.random.default_rng(0)
    phrase = rng.integers(0, 1000, 40)
    ids = np.tile(phrase, 100)
    size = sum(map(len, context_coder.encode(ids, context_coder.histogram(ids), 1000)))
    assert size < len(ids) * np.log2(40) / 8 / 3
    with pytest.raises(ValueError):
        context_coder.histogram(np.array([context_coder.MOST_IDS]))


def test_record_checks():
    ids = np.arange(3000, dtype=np.uint32) % 50
    data = token_files.pack_record(3, 4, 99, pa.array(["a", None]), [1000, 2000], ids, block=512) + b"\n"
    record = next(token_files.records_of(data + data))
    assert (record.shard, record.number, record.before, record.ids.to_pylist(), record.end) == (3, 4, 99, ["a", None], len(data))
    assert (record.tokens() == ids).all() and (record.block_tokens(5) == ids[2560:]).all()
    assert len(list(token_files.records_of(data * 3))) == 3
    for at in (5, 60, len(data) - 5):
        broken = bytearray(data)
        broken[at] ^= 1
        with pytest.raises((ValueError, zlib.error)):
            next(token_files.records_of(bytes(broken))).tokens()
    with pytest.raises((ValueError, struct.error)):
        next(token_files.records_of(data[:-200])).tokens()


def plain_rows(rows):
    """(doc_id, start, n_tokens, ids_crc32) in order of id."""
    tokenizer, at, out = Tokenizer.from_str(JSON), 0, []
    for key, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((key, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def read_back(spark, path, kind):
    docs = token_files.read_ids(spark, path, kind).select("doc_id", "shard", "before", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    found = token_files.with_starts(docs).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    return sorted(map(tuple, found), key=lambda r: r[1])


def test_files_against_plain_encoding(spark, tmp_path):
    rows = list(enumerate(TEXTS))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("TIE", F.lit(1)).withColumn("Place", F.lit(1)).repartition(5)
    token_files.write_ids(docs, f"file://{tmp_path}/a", JSON, record_ids=2000, records_per_file=2)
    assert read_back(spark, f"file://{tmp_path}/a", T.LongType()) == plain_rows(rows)


def test_repeated_rows_null_ids_and_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([("b", "same text")] * 30 + [(None, "x"), ("a", None)], "doc_id string, text string")
    token_files.write_ids(docs, f"file://{tmp_path}/b", JSON, record_ids=10)
    assert read_back(spark, f"file://{tmp_path}/b", T.StringType()) == plain_rows([(None, "x"), ("a", None)] + [("b", "same text")] * 30)
    token_files.write_ids(docs.limit(0), f"file://{tmp_path}/c", JSON)
    assert read_back(spark, f"file://{tmp_path}/c", T.StringType()) == []


def test_query_against_plain_encoding(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    found = sorted(map(tuple, QUERIES["op12_token_files"](spark, sf).collect()), key=lambda r: r[1])
    assert found == plain_rows(rows)
    assert public_tokenizers.path("byte_bpe_50k.json") == vocabulary("byte_bpe_50k.json")
