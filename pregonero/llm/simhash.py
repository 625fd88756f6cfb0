"""SimHash near-duplicates: 64-bit fingerprints, linked at `radius` or fewer differing bits, and their components.

Fingerprint: A-Z lower-cased, words, shingles of words joined by spaces (repeats included), XXH64 of each with seed 42; a
bit is 1 if set in over half the hashes. A text with fewer words is one shingle; one without words has fingerprint zero.

Linking is exact. Copies are folded first: only distinct fingerprints are compared. Two of them that differ in at most r of
64 bits agree in one of r + 1 parts, and of the other bits again in one of r + 1 parts, so they share one of (r + 1)^2
masked keys. Fingerprints with equal key are compared bit-sliced: 64 bit planes hold one bit of every fingerprint, lane i
is compared with lane i + d by shifting the planes by d, and carry-save counters add up the differing bits of all lanes at
once; blocks of 64 lanes are abandoned when every lane is over the radius. A large bucket is cut into chunks, and pairs of
chunks are dealt out as buckets of their own, so no task holds more than two chunks; tasks return a spanning forest, not
all pairs. Components of the links come from `operators.components`.

Defined cases: null text counts as empty; rows without words are all linked; ties and repeated rows belong to one
component; component_id is the smallest id, null only if all ids of the component are null; an empty table gives an empty
table.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T

from ..operators.components import connected
from .store import columns_clear_of, slices, stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BITS = 64
SEED = 42
CHUNK = 2048
HASHES_AT_ONCE = 1 << 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The fingerprint as an unsigned number."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    starts, ends = starts[:n].tolist(), ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, HASHES_AT_ONCE):
        part = slice(at, at + HASHES_AT_ONCE)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[part], ends[part])], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text_column: str = "text", shingle: int = 3, name: str = "fp") -> DataFrame:
    """The columns of docs, then the fingerprint as a signed long."""
    at = docs.columns.index(text_column)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(at)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values)], [*batch.schema.names, name])

    return docs.mapInArrow(add, schema)


def band_masks(radius: int) -> list[int]:
    """Masks, as signed longs, of which two fingerprints within the radius agree under one at least."""
    masks = []
    for part in np.array_split(np.arange(BITS), radius + 1):
        rest = np.setdiff1d(np.arange(BITS), part)
        for inner in np.array_split(rest, radius + 1):
            mask = sum(1 << int(b) for b in [*part, *inner])
            masks.append(mask - (1 << BITS) if mask >> (BITS - 1) else mask)
    return masks


def _planes(values: np.ndarray) -> np.ndarray:
    """(64, words): plane b holds bit b of every value, one lane each, with a spare word at the end."""
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    packed = np.packbits(bits.T, axis=1, bitorder="little")
    room = np.zeros((BITS, (len(values) + 63) // 64 * 8 + 8), np.uint8)
    room[:, : packed.shape[1]] = packed
    return room.view(np.uint64)


def close_lanes(planes: np.ndarray, shift: int, valid: np.ndarray, radius: int) -> np.ndarray:
    """Lanes i of valid (boolean) whose value differs from that of lane i + shift in at most radius bits."""
    n_words = (len(valid) + 63) // 64
    lanes = np.zeros(n_words * 64, np.uint8)
    lanes[: len(valid)] = valid
    over = ~np.packbits(lanes, bitorder="little").view(np.uint64)
    word, bit = divmod(shift, 64)
    blocks = np.flatnonzero(~over)
    over = over[blocks]
    # counters start so high that the last carry comes with difference radius + 1
    n_counters = radius.bit_length()
    preset = (1 << n_counters) - 1 - radius
    full = ~np.uint64(0)
    counters = [np.full(len(blocks), full if preset >> k & 1 else 0, np.uint64) for k in range(n_counters)]
    last = planes.shape[1] - 1
    for b in range(BITS):
        plane = planes[b]
        near = np.minimum(blocks + word, last)
        other = plane[near] >> np.uint64(bit)
        if bit:
            other = other | plane[np.minimum(near + 1, last)] << np.uint64(64 - bit)
        carry = plane[blocks] ^ other
        for k in range(n_counters):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry
        if b % 8 == 7:
            alive = np.flatnonzero(over != full)
            if len(alive) < len(blocks):
                blocks, over = blocks[alive], over[alive]
                counters = [c[alive] for c in counters]
                if not len(blocks):
                    break
    hits = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").reshape(len(blocks), 64)
    block, lane = np.nonzero(hits)
    return blocks[block] * 64 + lane


def forest(buckets: np.ndarray, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Within each bucket links every value to the smallest one it is connected to: (value, smallest), without self-links."""
    _, codes, sizes = np.unique(buckets, return_inverse=True, return_counts=True)
    order = np.lexsort((values, codes, -sizes[codes]))
    codes, values = codes[order], values[order]
    size = sizes[codes]
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    start = np.repeat(first, size[first])
    place = np.arange(len(values)) - start
    label = np.arange(len(values))
    planes = _planes(np.ascontiguousarray(values))
    for shift in range(1, int(size[0]) if len(size) else 0):
        active = int(np.searchsorted(-size, -shift, side="left"))  # buckets are in order of falling size
        close = close_lanes(planes, shift, (place + shift < size)[:active], radius)
        for i in close[label[close] != label[close + shift]]:
            a, b = sorted((label[i], label[i + shift]))
            if a != b:
                mine = label[start[i] : start[i] + size[i]]
                mine[mine == b] = a
    linked = label != np.arange(len(values))
    return values[linked], values[label[linked]]


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(buckets, values):
            a, b = forest(buckets, values, radius)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        buckets, values = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            buckets = np.concatenate((buckets, batch.column(0).to_numpy()))
            values = np.concatenate((values, batch.column(1).to_numpy()))
            whole = int(np.searchsorted(buckets, buckets[-1])) if len(buckets) else 0  # the last bucket may go on
            if whole:
                yield links(buckets[:whole], values[:whole])
                buckets, values = buckets[whole:], values[whole:]
        if len(buckets):
            yield links(buckets, values)

    return run


def links(distinct: DataFrame, radius: int = 3, chunk: int = CHUNK) -> DataFrame:
    """(fp) without repeats -> links (a, b), a != b, that connect exactly what differs by radius bits or fewer, in chains."""
    bands = F.array(*[F.struct(F.lit(i).alias("band"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(band_masks(radius))])
    keyed = distinct.select("fp", F.explode(bands).alias("at")).select("fp", "at.band", "at.key")
    sizes = keyed.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1")
    chunks = F.ceil(F.col("n") / chunk).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    others = F.when(F.col("chunks") == 1, F.array(F.lit(0))).otherwise(
        F.array_except(F.sequence(F.lit(0), F.col("chunks") - 1), F.array(F.col("own")))
    )
    dealt = (
        keyed.join(sizes, ["band", "key"]).withColumn("chunks", chunks).withColumn("own", own)
        .select("fp", "band", "key", "own", F.explode(others).alias("other"))
        .select(F.xxhash64("band", "key", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"), "fp")
    )
    compared = dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_compare(radius), "a long, b long")
    return compared.distinct()


def group(marked: DataFrame, id_column: str = "doc_id", radius: int = 3) -> DataFrame:
    """marked (a written table with id and fp) -> (fp, root, component_id), one row per distinct fingerprint."""
    distinct = stage(marked.groupBy("fp").agg(F.min(id_column).alias("first_id")), "fingerprints")
    star = connected(links(distinct.select("fp"), radius))
    rooted = distinct.join(star, distinct.fp == star.node, "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rooted.join(smallest, "root").select("fp", "root", "component_id")


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 3, radius: int = 3
) -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id), one row per row of docs."""
    marked = stage(
        fingerprints(docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")), shingle=shingle).drop("text"), "simhash"
    )
    found = group(marked, "id", radius)
    return marked.join(found, "fp").select(
        F.col("id").alias(id_column), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 5, radius: int = 3) -> DataFrame:
    """The rows of docs that come first, by id and then by place, in their component; the columns of docs."""
    names = columns_clear_of(docs, "fp", "row_no")
    numbered = fingerprints(docs, text_column, shingle, names["fp"]).withColumn(names["row_no"], F.monotonically_increasing_id())
    rows = stage(numbered, "simhash-rows")  # written row numbers don't change when a task runs again
    narrow = rows.select(F.col(id_column).alias("id"), F.col(names["fp"]).alias("fp"), F.col(names["row_no"]).alias("row"))
    found = group(narrow, "id", radius)
    first = narrow.join(found, "fp").groupBy("root").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))["row"].alias("first_row")
    )
    return rows.join(first, rows[names["row_no"]] == first.first_row, "left_semi").select(*[f"`{c}`" for c in docs.columns])
