"""Token ids of documents in binary files of their own format, and back.

Documents are sorted by id; each task encodes a range of them and writes records. A record is

    magic, version, shard, number, ids before it in its shard, documents, ids, ids a block, and the lengths of
    the parts (HEADER, little-endian); CRC-32 of the header; then
    documents (Arrow stream, zlib: id and number of ids each), histogram (zlib), block index (bytes and CRC-32 of each
    block), blocks (`context_coder`), one line feed.

Blocks begin at equal numbers of ids and are coded from a fresh state, so one block can be checked and decoded alone. Header,
parts and blocks have checksums of their own; damage raises an error that names shard and record. Shards are numbered in the
order of document ids and records in their shard; file names play no part.

Spark writes the records (a text sink copies bytes as they are) and reads whole files, so any store that Spark reaches will
do. A file holds at most `records_per_file` records of about `record_ids` ids, documents being kept whole.

Defined cases: a null text is empty, its ids are the end id alone; null document ids come first; rows equal in id are in the
order of their texts' hashes; an empty table gives no record and an empty result.
"""

from __future__ import annotations

import struct
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import bpe, context_coder
from .store import broadcast_if_small, text_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAGIC, VERSION = b"PGTI", 1
HEADER = "<4sHIIQIQIIIII"
HEADER_SIZE = struct.calcsize(HEADER)
BLOCK_IDS = 1024
RECORD_IDS = BLOCK_IDS * context_coder.LANES
RECORDS_PER_FILE = 8


def pack_record(shard: int, number: int, before: int, ids: pa.Array, lengths: list[int], tokens: np.ndarray, block: int = BLOCK_IDS) -> bytes:
    """One record without its line feed, which the sink adds; ids and lengths of the documents, their token ids in a row."""
    sink = pa.BufferOutputStream()
    documents = pa.record_batch([ids, pa.array(lengths, pa.uint32())], ["id", "n"])
    with pa.ipc.new_stream(sink, documents.schema) as out:
        out.write_batch(documents)
    listed = zlib.compress(sink.getvalue().to_pybytes())
    table = context_coder.histogram(tokens)
    blocks = context_coder.encode(tokens, table, block)
    index = b"".join(struct.pack("<II", len(b), zlib.crc32(b)) for b in blocks)
    packed = zlib.compress(table)
    parts = listed + packed + index
    header = struct.pack(HEADER, MAGIC, VERSION, shard, number, before, len(lengths), len(tokens), block, len(listed), len(packed), len(blocks), zlib.crc32(parts))
    return b"".join([header, struct.pack("<I", zlib.crc32(header)), parts, *blocks])


class Record:
    """A record's header and parts at a place in a file; `end` is the place after it."""

    def __init__(self, data: memoryview, at: int):
        head = data[at : at + HEADER_SIZE]
        body = at + HEADER_SIZE + 4
        if len(head) < HEADER_SIZE or struct.unpack("<I", data[body - 4 : body])[0] != zlib.crc32(head):
            raise ValueError(f"no record at byte {at}")
        magic, version, self.shard, self.number, self.before, self.n_docs, self.n, self.block, listed, packed, n_blocks, check = struct.unpack(HEADER, head)
        if (magic, version) != (MAGIC, VERSION):
            raise ValueError(f"format {magic!r} {version} is not known")
        ends = [body, body + listed, body + listed + packed, body + listed + packed + 8 * n_blocks]
        if zlib.crc32(data[body : ends[3]]) != check:
            raise ValueError(f"shard {self.shard}, record {self.number}: the record's parts are damaged")
        documents = pa.ipc.open_stream(zlib.decompress(data[ends[0] : ends[1]])).read_all().combine_chunks()
        self.ids = documents.column(0).combine_chunks() if documents.num_rows else pa.array([], documents.schema[0].type)
        self.lengths = documents.column(1).to_numpy().astype(np.int64)
        self.table = zlib.decompress(data[ends[1] : ends[2]])
        self.index = np.frombuffer(data[ends[2] : ends[3]], "<u4").reshape(-1, 2)
        self.data, self.places = data, ends[3] + np.concatenate(([0], np.cumsum(self.index[:, 0].astype(np.int64))))
        self.end = int(self.places[-1]) + 1

    def block_bytes(self, k: int) -> bytes:
        found = bytes(self.data[self.places[k] : self.places[k + 1]])
        if len(found) != self.index[k, 0] or zlib.crc32(found) != self.index[k, 1]:
            raise ValueError(f"shard {self.shard}, record {self.number}: block {k} is damaged")
        return found

    def tokens(self) -> np.ndarray:
        return context_coder.decode([self.block_bytes(k) for k in range(len(self.index))], self.table, self.n, self.block)

    def block_tokens(self, k: int) -> np.ndarray:
        """One block alone."""
        return context_coder.decode_block(self.block_bytes(k), self.table, min(self.block, self.n - k * self.block))


def records_of(data: bytes) -> Iterator[Record]:
    view, at = memoryview(data), 0
    while at < len(view):
        record = Record(view, at)
        yield record
        at = record.end


def write_ids(
    docs: DataFrame, path: str, tokenizer_json: str, id_column: str = "doc_id", text_column: str = "text", end_id: int = 2,
    record_ids: int = RECORD_IDS, records_per_file: int = RECORDS_PER_FILE,
) -> None:
    """Encodes each text with the tokenizer, adds the end id and writes the files."""
    # equal rows are told apart by their place in the input, so that a large group of them is split as well
    ordered = docs.select(F.col(id_column).alias("id"), text_of(text_column).alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = ordered.withColumn("place", F.monotonically_increasing_id()).orderBy(F.col("id").asc_nulls_first(), "tie", "place")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = bpe.PieceCache(bpe.ByteLevel(tokenizer_json), after_space=False)
        shard, number, before = TaskContext.get().partitionId(), 0, 0
        ids, tokens, held = [], [], 0

        def record():
            whole = np.concatenate(tokens)
            lengths = [len(t) for t in tokens]
            return pa.RecordBatch.from_arrays([pa.array([pack_record(shard, number, before, pa.concat_arrays(ids), lengths, whole)], pa.binary())], ["record"])

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = cache.ids(part.column(1).to_pylist())
                for row, t in enumerate(found):
                    if held and held + len(t) >= record_ids:
                        yield record()
                        number, before = number + 1, before + held
                        ids, tokens, held = [], [], 0
                    ids.append(part.column(0).slice(row, 1))
                    tokens.append(np.append(t, np.uint32(end_id)))
                    held += len(t) + 1
        if tokens:
            yield record()

    records = ordered.select("id", "text").mapInArrow(encode, "record binary")
    records.select(F.col("record").cast("string")).write.option("maxRecordsPerFile", records_per_file).option("lineSep", "\n").text(path)


def read_ids(spark: SparkSession, path: str, id_type: T.DataType, id_name: str = "doc_id") -> DataFrame:
    """One row per document: id, shard, before (ids before it in its shard), n_tokens, ids (little-endian 32-bit numbers)."""
    schema = T.StructType(
        [
            T.StructField(id_name, id_type), T.StructField("shard", T.LongType()), T.StructField("before", T.LongType()),
            T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()),
        ]
    )
    kind = to_arrow_type(id_type)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                for record in records_of(data.as_py()):
                    tokens = record.tokens().astype("<u4")
                    ends = np.cumsum(record.lengths)
                    for at in range(0, record.n_docs, 512):
                        upto = min(at + 512, record.n_docs)
                        begins = ends[at:upto] - record.lengths[at:upto]
                        yield pa.RecordBatch.from_arrays(
                            [
                                record.ids.slice(at, upto - at).cast(kind), pa.array([record.shard] * (upto - at), pa.int64()),
                                pa.array(record.before + begins), pa.array(record.lengths[at:upto]),
                                pa.array([tokens[b:e].tobytes() for b, e in zip(begins, ends[at:upto])], pa.binary()),
                            ],
                            schema.names,
                        )

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(read, schema)


def with_starts(docs: DataFrame) -> DataFrame:
    """Replaces shard and before by `start`, the ids of all documents before. docs must be written: it is read twice."""
    totals = docs.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    # one row per shard, whatever the number of documents
    earlier = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("earlier"))
    return docs.join(broadcast_if_small(earlier), "shard").withColumn("start", F.col("earlier") + F.col("before")).drop("shard", "before", "earlier")
