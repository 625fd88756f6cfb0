"""Near copies: texts whose sets of word shingles have a Jaccard similarity of `similarity` or more, and their components.

Words and their hashes are those of `simhash`: A-Z lower-cased, shingles of words joined by spaces, XXH64 with seed 42; a
text with fewer words is one shingle. Each text gets BANDS * ROWS independent minimum-hash fingerprints; two texts are
candidates if they agree in all ROWS fingerprints of a band. A pair with similarity s is missed with probability
(1 - s^ROWS)^BANDS: 0.0004 at 0.8, less above. Every pair of candidates is confirmed by the exact similarity of the two
sets before it links anything.

Copies (equal after folding case and spaces) are folded first, by a 64-bit hash of their words. Buckets with the same
members are compared once. A large bucket is cut into chunks, and pairs of chunks are dealt out as buckets of their own, so
no task holds more than two chunks; tasks return a spanning forest, not all pairs.

Defined cases: null text counts as empty; rows without words are all copies of each other; an empty table gives an empty
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
from ..session import drop_dir, drop_written, work_dir
from .store import broadcast_if_small, columns_clear_of, slices, stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEED = 42
BANDS, ROWS = 20, 5
CHUNK = 512
HASHES_AT_ONCE = 1 << 13
SIMILARITY = 0.8
_RNG = np.random.default_rng(SEED)
FACTORS = _RNG.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
MIXERS = _RNG.integers(0, 1 << 63, ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def folded(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def shingle_set(words: list[bytes], shingle: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[-n:].tolist())], np.uint64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One signed key a band; none for an empty set."""
    if not len(hashes):
        return np.empty(0, np.int64)
    lowest = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(hashes), HASHES_AT_ONCE):
        np.minimum(lowest, (FACTORS * hashes[at : at + HASHES_AT_ONCE]).min(axis=1), out=lowest)
    return (lowest.reshape(BANDS, ROWS) * MIXERS).sum(axis=1, dtype=np.uint64).view(np.int64)


def text_key(words: list[bytes]) -> int:
    """Signed hash of the folded text; 0 for one without words."""
    key = xxhash.xxh64_intdigest(b" ".join(words), SEED) if words else 0
    return key - (1 << 64) if key >> 63 else key


def marked(docs: DataFrame, text_column: str, shingle: int, fp: str, bands: str) -> DataFrame:
    """The columns of docs, then the key of the folded text and the keys of its bands."""
    at = docs.columns.index(text_column)
    schema = T.StructType([*docs.schema.fields, T.StructField(fp, T.LongType()), T.StructField(bands, T.ArrayType(T.LongType()))])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = [folded(t.as_py()) for t in batch.column(at)]
            keys = pa.array(map(text_key, words), pa.int64())
            found = pa.array([band_keys(shingle_set(w, shingle)) for w in words], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, keys, found], [*batch.schema.names, fp, bands])

    return docs.mapInArrow(add, schema)


def forest(sets: list[np.ndarray], similarity: float = SIMILARITY) -> np.ndarray:
    """For each set the place of the first set it is connected to by pairs of that similarity or more."""
    sizes = np.array([len(s) for s in sets])
    label = np.arange(len(sets))
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    mark = np.zeros(len(codes), bool)
    for i in range(len(sets) - 1):
        if not (label[i + 1 :] != label[i]).any():
            continue
        mine = codes[starts[i] : starts[i + 1]]
        mark[mine] = True
        shared = np.add.reduceat(mark[codes[starts[i + 1] :]], starts[i + 1 : -1] - starts[i + 1], dtype=np.int64)
        mark[mine] = False
        close = np.flatnonzero(shared >= similarity * (sizes[i] + sizes[i + 1 :] - shared) - 1e-9) + i + 1
        for other in np.unique(label[close]):
            a, b = sorted((label[i], other))
            label[label == b] = a
    return label


def _compare(shingle: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(keys: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
            label = forest(sets, similarity)
            pairs = [(keys[i], keys[j]) for i, j in enumerate(label.tolist()) if i != j]
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

        bucket, keys, sets = None, [], []
        for batch in batches:
            for its, key, text in zip(*(batch.column(i) for i in range(3))):
                if its.as_py() != bucket:
                    if len(keys) > 1:
                        yield links(keys, sets)
                    bucket, keys, sets = its.as_py(), [], []
                keys.append(key.as_py())
                sets.append(shingle_set(folded(text.as_py()), shingle))
        if len(keys) > 1:
            yield links(keys, sets)

    return run


def links(
    marks: DataFrame, texts: DataFrame, shingle: int = 5, similarity: float = SIMILARITY, chunk: int = CHUNK, below: str | None = None
) -> DataFrame:
    """marks (written: row, fp, bands) and texts (row, text) -> links (a, b) of keys, which connect the confirmed candidates in chains.

    Rows that only texts has are left alone. below: a folder for written tables that the caller drops.
    """
    keyed = stage(marks.select("fp", F.posexplode("bands").alias("band", "key")).distinct(), "near-bands", below)
    # two hashes of the members tell buckets with the same members
    sizes = keyed.groupBy("band", "key").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("fp")).alias("x"), F.bit_xor(F.xxhash64("fp", F.lit(1))).alias("y")
    ).filter("n > 1")
    once = sizes.groupBy("n", "x", "y").agg(F.min(F.struct("band", "key")).alias("at")).select("n", "at.*")
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    others = F.when(F.col("chunks") == 1, F.array(F.lit(0))).otherwise(
        F.array_except(F.sequence(F.lit(0), F.col("chunks") - 1), F.array(F.col("own")))
    )
    dealt = stage(
        keyed.join(once, ["band", "key"]).withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int")).withColumn("own", own)
        .select("fp", "band", "key", "own", F.explode(others).alias("other"))
        .select(F.xxhash64("band", "key", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"), "fp"),
        "near-dealt", below,
    )
    # one text of each key that has a candidate; the other texts are not shuffled
    wanted = stage(
        marks.select("row", "fp").join(dealt.select("fp").distinct(), "fp", "left_semi").groupBy("fp").agg(F.min("row").alias("first")),
        "near-wanted", below,
    )
    held = texts.select("row", "text").join(broadcast_if_small(wanted), F.col("row") == F.col("first")).select("fp", "text")
    held = dealt.join(held, "fp").select("bucket", "fp", "text")
    return held.repartition("bucket").sortWithinPartitions("bucket", "fp").mapInArrow(_compare(shingle, similarity), "a long, b long").distinct()


def _firsts(marks: DataFrame, links: DataFrame, below: str | None = None) -> DataFrame:
    """marks (id, fp, row) -> (first_row) of each component: the first by id, nulls last, and then by row."""
    star = connected(links, below)
    firsts = marks.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first"))
    return firsts.join(star, F.col("fp") == F.col("node"), "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(
        F.min("first")["row"].alias("first_row")
    )


def later_ids(ids: DataFrame, documents: DataFrame, shingle: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """ids (id) and documents (id, text) -> (id), written: those of ids whose document is a near copy of that of a smaller one.

    Ids that documents has not, or more than once, and null are nobody's copy. Texts are marked where they lie; only marks,
    and the texts of candidates, are shuffled.
    """
    marks = marked(documents.select("id", "text"), "text", shingle, "fp", "bands").drop("text")
    once = marks.groupBy("id").agg(F.count("*").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands")).filter("n = 1")
    below = work_dir(documents.sparkSession, "near-earlier")
    marks = stage(once.join(ids.distinct(), "id", "left_semi").select("id", F.col("id").alias("row"), "fp", "bands"), "marks", below)
    texts = documents.select(F.col("id").alias("row"), "text")
    first = _firsts(marks, links(marks, texts, shingle, similarity, below=below), below)
    later = stage(marks.join(first, F.col("row") == F.col("first_row"), "left_anti").select("id"), "near-later")
    drop_dir(documents.sparkSession, below)
    return later


def keep_one(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 5, similarity: float = SIMILARITY,
    earlier: DataFrame | None = None, below: str | None = None,
) -> DataFrame:
    """The rows of docs that come first, by id and then by place, in their component; the columns of docs.

    earlier: the documents (same two columns) as they were before a step that cut shared passages out of the later of two,
    which leaves a near copy as a rest that is no near copy any more. Ids whose earlier texts are near copies go first, all
    but the smallest of each component; what stays is compared by its present texts. The two kinds of links form components
    of their own: equal rests of two documents say nothing about what they were cut from.
    below: a folder for the written rows, which the result reads; a caller that gives it drops it.
    """
    names = columns_clear_of(docs, "fp", "bands", "row_no")
    fp, row_no = names["fp"], names["row_no"]
    numbered = marked(docs, text_column, shingle, fp, names["bands"]).withColumn(row_no, F.monotonically_increasing_id())
    rows = stage(numbered, "near-rows", below)  # written row numbers don't change when a task runs again
    now = work_dir(docs.sparkSession, "near-now")
    marks = rows.select(
        F.col(f"`{id_column}`").alias("id"), F.col(row_no).alias("row"), F.col(fp).alias("fp"), F.col(names["bands"]).alias("bands")
    )
    if earlier is not None:
        before = earlier.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text"))
        later = later_ids(marks.select("id"), before, shingle, similarity)
        marks = stage(marks.join(later, "id", "left_anti"), "near-left", now)
        drop_written(later)
    texts = rows.select(F.col(row_no).alias("row"), F.col(f"`{text_column}`").alias("text"))
    first = stage(_firsts(marks, links(marks, texts, shingle, similarity, below=now), now), "near-firsts")
    drop_dir(docs.sparkSession, now)
    return rows.join(first, rows[row_no] == first.first_row, "left_semi").select(*[f"`{c}`" for c in docs.columns])
