"""Benchmark passages in documents, found with a positional inverted index over the documents.

The index is a table: one row per block of whole documents (about BLOCK_WORDS words, more where one document is longer),
with the block's terms and for each term the sorted positions at which it stands. Blocks are independent, so a lost
executor costs the blocks it was reading, and a common word's postings are spread over all blocks. The index covers every
word of every document and is written once; any number of benchmarks can be run against it.

A search starts from the postings of each window's rarest term in the block, takes off the term's offset to get possible
starts, and intersects with the offset postings of the next rarest term, and so on: all windows of a benchmark slice
advance together. The benchmark is dealt into slices of bounded size by the number of its characters; each slice is sent to
the tasks and all slices' hits are united.

Words are runs of 0-9, a-z (A-Z lower-cased) and all non-ASCII characters. A window is `size` consecutive words of an item; an
item of fewer words, but not none, is one window. A near hit has the window's rarest word in place and every other word
within `slop` words of its place.

Defined cases: null texts have no words; items without words never occur; repeated rows are reported one by one; items of
equal id count once, and all items without id as one item, listed as null; an empty benchmark hits nothing; an empty table gives an empty table.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..session import LONG_ROWS, drop_written
from .store import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_WORDS = 1 << 19
GAP = 1024  # free positions between documents: no window or near hit reaches over it
MOST_SLOP = 100
SLICE_CHARS = 8 << 20
# bytes that are part of a word, lower-cased; all others become spaces
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


def _block(part: int, number: int, ids: list, lengths: list[int], numbers: dict[bytes, int], codes: list[np.ndarray], schema: pa.Schema):
    places = [
        np.arange(len(c), dtype=np.int32) + np.int32(at)
        for c, at in zip(codes, np.concatenate(([0], np.cumsum(np.array(lengths[:-1], np.int64) + GAP))) if lengths else [])
    ]
    all_codes = np.concatenate(codes) if codes else np.empty(0, np.int64)
    order = np.argsort(all_codes, kind="stable")
    positions = (np.concatenate(places) if places else np.empty(0, np.int32))[order]
    starts = np.concatenate(([0], np.cumsum(np.bincount(all_codes, minlength=len(numbers))))).astype(np.int32)
    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    columns = [
        pa.array([part], pa.int32()), pa.array([number], pa.int32()), one(pa.array(ids, schema.field("ids").type.value_type)),
        one(pa.array(lengths, pa.int64())), one(pa.array([w.decode() for w in numbers], pa.string())), one(pa.array(starts)),
        one(pa.array(positions)),
    ]
    return pa.RecordBatch.from_arrays(columns, schema.names)


def build_index(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """Writes the index: part, number, ids, n_words (per document), terms, starts (per term, into positions), positions."""
    id_type = docs.schema[id_column].dataType
    schema = T.StructType(
        [
            T.StructField("part", T.IntegerType()), T.StructField("number", T.IntegerType()), T.StructField("ids", T.ArrayType(id_type)),
            T.StructField("n_words", T.ArrayType(T.LongType())), T.StructField("terms", T.ArrayType(T.StringType())),
            T.StructField("starts", T.ArrayType(T.IntegerType())), T.StructField("positions", T.ArrayType(T.IntegerType())),
        ]
    )
    arrow = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in schema])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, total = TaskContext.get().partitionId(), 0, 0
        ids, lengths, numbers, codes = [], [], {}, []
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                words = words_of(text.as_py())
                ids.append(key.as_py())
                lengths.append(len(words))
                codes.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)))
                total += len(words)
                if total >= block_words or len(ids) >= block_words // 8:
                    yield _block(part, number, ids, lengths, numbers, codes, arrow)
                    number, total = number + 1, 0
                    ids, lengths, numbers, codes = [], [], {}, []
        if ids:
            yield _block(part, number, ids, lengths, numbers, codes, arrow)

    return stage(docs.select(F.col(id_column), F.col(text_column)).mapInArrow(build, schema), "positions", options=LONG_ROWS)


class Windows:
    """The distinct windows of a benchmark slice: terms, a matrix of term numbers (-1 beyond the end), and their items."""

    def __init__(self, items: list[tuple[str, str]], size: int):
        found: dict[tuple, dict[str, None]] = {}
        for item, text in items:
            words = words_of(text)
            for at in range(max(1, len(words) - size + 1) if words else 0):
                found.setdefault(tuple(words[at : at + size]), {})[item] = None
        numbers: dict[bytes, int] = {}
        self.lengths = np.array([len(w) for w in found], np.int64)
        self.matrix = np.full((len(found), size), -1, np.int64)
        for row, window in enumerate(found):
            self.matrix[row, : len(window)] = [numbers.setdefault(w, len(numbers)) for w in window]
        self.terms = [w.decode() for w in numbers]
        self.items = [list(names) for names in found.values()]


def search_block(windows: Windows, terms: pa.Array, starts: np.ndarray, positions: np.ndarray, slop: int):
    """(window, start, place of the rarest term, exact) of the near hits of one block; exact ones are the phrase matches."""
    none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    if not len(windows.matrix) or not len(terms):
        return none
    here = pc.index_in(pa.array(windows.terms, pa.string()), terms).fill_null(-1).to_numpy().astype(np.int64)
    counts = np.diff(starts.astype(np.int64))
    pad = windows.matrix < 0
    local = np.where(pad, -1, here[windows.matrix])
    rows = np.flatnonzero((pad | (local >= 0)).all(axis=1))
    if not len(rows):
        return none
    local, pad = local[rows], pad[rows]
    size = np.where(pad, np.iinfo(np.int64).max, counts[local])
    rarest = np.argsort(size, axis=1, kind="stable")
    first = local[np.arange(len(rows)), rarest[:, 0]]
    n = counts[first]
    window = np.repeat(np.arange(len(rows)), n)
    within = np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n)
    start = positions[starts[first][window] + within].astype(np.int64) - rarest[window, 0]
    # postings of all terms as one sorted array of (term, position)
    base = int(positions.max()) + 2 * GAP
    keys = np.repeat(np.arange(len(counts)), counts) * base + positions
    exact = start >= 0
    for k in range(1, local.shape[1]):
        offset = rarest[window, k]
        real = ~pad[window, offset]
        wanted = local[window, offset] * base + np.maximum(start + offset, 0)
        at = np.searchsorted(keys, wanted)
        hit = keys[np.minimum(at, len(keys) - 1)] == wanted
        low, high = local[window, offset] * base + np.maximum(start + offset - slop, 0), wanted + slop
        at = np.searchsorted(keys, low)
        near = (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] <= high)
        exact &= hit | ~real
        keep = near | ~real
        window, start, exact = window[keep], start[keep], exact[keep]
        if not len(window):
            return none
    return rows[window], start, start + rarest[window, 0], exact


def _search(windows: Windows, id_type: T.DataType, slop: int):
    names = ["part", "number", "place", "id", "n_words", "spans", "items", "near_items"]
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kinds = [pa.int32(), pa.int32(), pa.int32(), to_arrow_type(id_type), pa.int64(), span, pa.list_(pa.string()), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, number, ids, lengths, terms, starts, positions = (batch.column(i)[row] for i in range(7))
                lengths = lengths.values.to_numpy()
                begins = np.concatenate(([0], np.cumsum(lengths[:-1] + GAP)))
                spans, items, near = ([[] for _ in lengths] for _ in range(3))
                hits = search_block(windows, terms.values, starts.values.to_numpy(), positions.values.to_numpy(), slop)
                places = np.searchsorted(begins, hits[2], side="right") - 1
                for w, at, exact, place in zip(hits[0].tolist(), hits[1].tolist(), hits[3].tolist(), places.tolist()):
                    near[place].extend(windows.items[w])
                    if exact:
                        begin = at - int(begins[place])
                        spans[place].append({"start": begin, "end": begin + int(windows.lengths[w])})
                        items[place].extend(windows.items[w])
                n = len(lengths)
                columns = [
                    [part.as_py()] * n, [number.as_py()] * n, list(range(n)), ids.values, lengths, spans,
                    *[[sorted(set(i), key=lambda x: (x is None, x)) for i in found] for found in (items, near)],
                ]
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds)], names
                )

    return run


def search(
    index: DataFrame, benchmark: DataFrame, size: int = 10, slop: int = 2, item_column: str = "item_id", text_column: str = "text",
    slice_chars: int = SLICE_CHARS,
) -> DataFrame:
    """One row per document: id, n_words, spans (start, end in words of exact hits), n_hit, items, near_items (sorted texts)."""
    if not 0 <= slop <= MOST_SLOP or not 1 <= size <= GAP // 2:
        raise ValueError(f"slop must be 0 to {MOST_SLOP}, size 1 to {GAP // 2}")
    id_type = index.schema["ids"].dataType.elementType
    items = benchmark.select(F.col(item_column).cast("string").alias("item"), F.col(text_column).alias("text")).filter("text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n_slices = 1 + int(chars) // slice_chars
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType(
        [
            *[T.StructField(n, T.IntegerType()) for n in ("part", "number", "place")],
            T.StructField("id", id_type), T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(span)),
            *[T.StructField(n, T.ArrayType(T.StringType())) for n in ("items", "near_items")],
        ]
    )

    def hits(number: int) -> DataFrame:
        mine = items.filter(F.pmod(F.xxhash64("item"), F.lit(n_slices)) == number)
        return index.mapInArrow(_search(Windows([tuple(r) for r in mine.toLocalIterator()], size), id_type, slop), schema)

    united = reduce(DataFrame.unionAll, [hits(i) for i in range(n_slices)]).groupBy("part", "number", "place").agg(
        F.first("id").alias("id"), F.first("n_words").alias("n_words"),
        *[F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "items", "near_items")],
    )
    covered = F.aggregate(
        F.array_sort("spans"), F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(
            F.greatest(a["end"], s["end"]).alias("end"),
            (a["n"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(a["end"], s["start"]))).alias("n"),
        ),
        lambda a: a["n"],
    )
    return united.select(
        "id", "n_words", "spans", covered.alias("n_hit"),
        *[F.array_sort(F.array_distinct(c)).alias(c) for c in ("items", "near_items")],
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = 10) -> DataFrame:
    """docs without the rows in which a window occurs. Rows equal in id and text share their verdict."""
    text_hash = F.when(F.col(text_column).isNotNull(), F.xxhash64(F.col(text_column)))
    keyed = docs.select(F.struct(F.col(id_column).alias("id"), text_hash.alias("hash")).alias("key"), F.col(text_column).alias("text"))
    index = build_index(keyed, "key", "text")
    found = search(index, benchmark, size).filter("n_hit > 0")
    hit = stage(found.select(F.col("id.id").alias("hit_id"), F.col("id.hash").alias("hit_hash")).distinct(), "hits")
    drop_written(index)
    return docs.join(
        hit, F.col(f"`{id_column}`").eqNullSafe(F.col("hit_id")) & text_hash.eqNullSafe(F.col("hit_hash")), "left_anti"
    )
