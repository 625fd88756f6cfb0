"""Ranked lexical search by pipelined term partitioning.

The index is written once: documents are dealt into slices of at most `SLICE_DOCS`, in the order of their ids within a slice;
a row per slice and term holds the places of the documents, how often the term stands in each, and their lengths.

A search gives the benchmark's terms to `stages` owners, rare terms to the first, with about equal numbers of postings each.
Items travel in bundles of `BUNDLE_ITEMS`. A bundle of a slice passes the owners one after the other: each owner's postings
of the slice and the bundle meet in a cogroup, which adds the owner's integer contributions to the bundle's sparse
accumulators and hands them on. What a document may still gain is bounded by the owners' remaining weights, so an
accumulator that cannot reach its slice's best `k` any more is left out; no result changes by that. After the last owner
each item keeps the best k of each slice, and the best k of all slices are selected, folded per task before the shuffle.

A slice bounds every group: a common term's postings and a common item's accumulators are spread over all slices.

Terms are runs of 0-9, a-z (A-Z lower-cased) and all non-ASCII characters. Defined cases: null texts have no terms and do not
count as documents; each benchmark row is an item of its own, also where item_id repeats or is null; an item without terms
finds nothing; equal scores are in the order of ids, null ids last, repeated rows after each other; empty tables give an
empty result. Columns other than the id and the text are not used.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from .decontamination import WORD_BYTES
from .store import broadcast_if_small, stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SLICE_DOCS, SLICE_WORDS = 4096, 1 << 22
BUNDLE_ITEMS, STAGES = 64, 4
#: The scale of a contribution, and of weights.
SCALE, WEIGHT = 1_000_000_000, 1000
# Lengths count for 25 of 100, a term's repeats saturate with 12 hundredths of that measure.
LENGTH_SHARE, SATURATION = 25, 12


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


def build_index(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", slice_docs: int = SLICE_DOCS) -> tuple[DataFrame, DataFrame]:
    """Writes and returns (slice, ids, lengths) with a value per document, and (slice, term, places, times) with one per document
    that holds the term."""
    id_type = docs.schema[id_column].dataType
    kind = to_arrow_type(id_type)
    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType(
        [
            T.StructField("slice", T.LongType()), T.StructField("term", T.BinaryType()), T.StructField("places", ints),
            T.StructField("times", ints), T.StructField("ids", T.ArrayType(id_type)), T.StructField("lengths", ints),
        ]
    )
    out_type = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in schema])

    def rows(number: int, ids: list[pa.Array], texts: list[list[int]], numbers: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
        keys = pa.concat_arrays(ids)
        order = pc.sort_indices(keys, null_placement="at_end").to_numpy()
        lengths = np.array([len(texts[i]) for i in order], np.int64)
        codes = np.concatenate([np.array(texts[i], np.int64) for i in order])
        place = np.repeat(np.arange(len(order)), lengths)
        found, times = np.unique(codes * len(order) + place, return_counts=True)
        code, place = found // len(order), found % len(order)
        starts = np.searchsorted(code, np.arange(len(numbers) + 1)).astype(np.int32)
        one = lambda values, t: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.cast(t))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([number]), pa.array([None], pa.binary()), pa.array([None], pa.list_(pa.int32())), pa.array([None], pa.list_(pa.int32())),
                one(keys.take(pa.array(order)), kind), one(pa.array(lengths), pa.int32()),
            ],
            schema=out_type,
        )
        terms, n = list(numbers), len(numbers)
        lists = [pa.array(v.astype(np.int32)) for v in (place, times)]
        for at in range(0, n, 50_000):
            upto = min(n, at + 50_000)
            begin, end = int(starts[at]), int(starts[upto])
            offsets = pa.array(starts[at : upto + 1] - begin)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(upto - at, number)), pa.array(terms[at:upto], pa.binary()),
                    *[pa.ListArray.from_arrays(offsets, v.slice(begin, end - begin)) for v in lists],
                    pa.nulls(upto - at, pa.list_(kind)), pa.nulls(upto - at, pa.list_(pa.int32())),
                ],
                schema=out_type,
            )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, words = TaskContext.get().partitionId() << 32, 0
        ids, texts, numbers = [], [], {}
        for batch in batches:
            for row, text in enumerate(batch.column(1)):
                terms = terms_of(text.as_py())
                if not terms:
                    continue
                ids.append(batch.column(0).slice(row, 1).cast(kind))
                texts.append(np.fromiter((numbers.setdefault(t, len(numbers)) for t in terms), np.int32, len(terms)))
                words += len(terms)
                if len(ids) >= slice_docs or words >= SLICE_WORDS:
                    yield from rows(number, ids, texts, numbers)
                    number, words = number + 1, 0
                    ids, texts, numbers = [], [], {}
        if ids:
            yield from rows(number, ids, texts, numbers)

    written = stage(docs.select(F.col(id_column), F.col(text_column)).mapInArrow(build, schema), "search-index")
    return written.filter("term is null").select("slice", "ids", "lengths"), written.filter("term is not null").drop("ids", "lengths")


def weighted_terms(slices: DataFrame, postings: DataFrame) -> DataFrame:
    """(term, df, weight, n_docs, n_terms) of the terms in the postings."""
    sizes = slices.select(F.size("ids").cast("long").alias("docs"), F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("terms"))
    totals = sizes.agg(F.sum("docs").alias("n_docs"), F.sum("terms").alias("n_terms"))  # one row
    counted = postings.groupBy("term").agg(F.sum(F.size("places")).cast("long").alias("df"))
    ratio = (2 * F.col("n_docs") + 2).cast("double") / (2 * F.col("df") + 1).cast("double")
    return counted.join(F.broadcast(totals)).withColumn("weight", F.floor(WEIGHT * F.log(ratio)).cast("long"))


def _owned(terms: DataFrame, stages: int) -> DataFrame:
    """Adds `owner`: terms in order of df, cut where the postings before make up another share."""
    in_order = Window.orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)  # a row per term of the benchmark
    before = F.coalesce(F.sum("df").over(in_order), F.lit(0))
    return terms.withColumn("owner", F.least(F.floor(before * stages / F.sum("df").over(Window.partitionBy())), F.lit(stages - 1)).cast("int"))


#: A bundle in a slice: its items, what each owner and those after it may still add to each, and the accumulators so far.
BUNDLE = (
    "slice long, bundle long, lengths array<int>, items array<int>, later array<array<bigint>>, places array<array<int>>, "
    "scores array<array<bigint>>"
)


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the best k scores above 0, ties by place."""
    some = np.flatnonzero(scores)
    return some[np.lexsort((some, -scores[some]))[:k]]


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """One row that holds a list of lists."""
    offsets = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    flat = pa.array(np.concatenate(values) if values else np.empty(0, np.int64)).cast(kind)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), flat))


def _add_stage(k: int, owner: int, last: bool):
    """The cogroup of a bundle in a slice with an owner's postings for it."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows and not last:
            return left
        row = {c: left.column(c)[0] for c in left.column_names}
        lengths, items = row["lengths"].values.to_numpy().astype(np.int64), row["items"].as_py()
        scores = np.zeros((len(items), len(lengths)), np.int64)
        for line, (places, sums) in enumerate(zip(row["places"].values, row["scores"].values)):
            scores[line, places.values.to_numpy()] = sums.values.to_numpy()
        at = {item: line for line, item in enumerate(items)}
        for n in range(right.num_rows):
            places, times = (right.column(c)[n].values.to_numpy().astype(np.int64) for c in ("places", "times"))
            weight, n_docs, n_terms = (right.column(c)[n].as_py() for c in ("weight", "n_docs", "n_terms"))
            measure = 100 - LENGTH_SHARE + (LENGTH_SHARE * lengths[places] * n_docs) // n_terms
            gain = weight * ((SCALE * times) // (1000 * times + SATURATION * measure))
            for item, repeats in zip(right.column("items")[n].as_py(), right.column("repeats")[n].as_py()):
                scores[at[item], places] += gain * repeats
        kept = []
        for line, later in enumerate(row["later"].as_py()):
            own = scores[line]
            some = np.flatnonzero(own)
            if last:
                some = _best(own, k)
            elif len(some) > k:
                # the k-th score so far is sure: a document that cannot come up to it is out, whatever it finds later
                least = np.partition(own[some], len(some) - k)[len(some) - k]
                some = some[own[some] + later[owner + 1] >= least]
            kept.append(some)
        done = {"places": _lists(kept, pa.int32()), "scores": _lists([scores[line, p] for line, p in enumerate(kept)], pa.int64())}
        return pa.table([done.get(c, left.column(c)) for c in left.column_names], names=left.column_names)

    return run


def search(
    index: tuple[DataFrame, DataFrame], benchmark: DataFrame, k: int = 20, item_column: str = "item_id", text_column: str = "text",
    stages: int = STAGES, bundle_items: int = BUNDLE_ITEMS,
) -> DataFrame:
    """(item_id, rank, id, score): the best k documents of each benchmark row."""
    spark = benchmark.sparkSession
    slices, postings = index

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([terms_of(t) for t in batch.column(1).to_pylist()], pa.list_(pa.binary()))], ["item", "terms"])

    rows = stage(benchmark.select(F.monotonically_increasing_id().alias("n"), F.col(item_column).alias("item_id"), F.col(text_column).alias("text")), "items")
    # rows numbered without gaps, so that bundles are full; one row per benchmark item
    numbered = stage(rows.select("item_id", "text", (F.row_number().over(Window.orderBy("n")) - 1).alias("item")), "items")
    said = numbered.select("item", "text").mapInArrow(cut, "item int, terms array<binary>").select("item", F.explode("terms").alias("term"))
    asked = stage(said.groupBy("item", "term").agg(F.count(F.lit(1)).alias("repeats")), "item-terms")
    matched = stage(postings.join(broadcast_if_small(stage(asked.select("term").distinct(), "wanted")), "term", "left_semi"), "matched")
    terms = stage(_owned(weighted_terms(slices, matched), stages), "terms")
    told = asked.withColumn("bundle", F.floor(F.col("item") / bundle_items)).join(terms, "term")
    # the most that one occurrence of a term in an item can add: the quotient is below SCALE / 1000
    bounds = [
        F.coalesce(F.sum(F.when(F.col("owner") >= o, F.col("weight") * F.col("repeats") * (SCALE // 1000))), F.lit(0)) for o in range(stages + 1)
    ]
    bundles = told.groupBy("bundle", "item").agg(F.array(*bounds).alias("later")).groupBy("bundle").agg(F.collect_list(F.struct("item", "later")).alias("x"))
    asks = told.groupBy("bundle", "term", "owner", "weight", "n_docs", "n_terms").agg(F.collect_list(F.struct("item", "repeats")).alias("x"))
    asks = stage(asks.select("*", F.col("x.item").alias("items"), "x.repeats").drop("x"), "asks")
    met = matched.join(broadcast_if_small(asks, 20_000), "term")
    visits = met.select("slice", "bundle").distinct().join(broadcast_if_small(stage(bundles, "bundles"), 20_000), "bundle").join(slices, "slice")
    none = lambda t: F.transform("x", lambda _: F.array().cast(t))
    held = stage(
        visits.select(
            "slice", "bundle", "lengths", F.col("x.item").alias("items"), F.col("x.later").alias("later"),
            none("array<int>").alias("places"), none("array<bigint>").alias("scores"),
        ),
        "bundles",
    )
    for owner in range(stages):
        mine = met.filter(F.col("owner") == owner).select("slice", "bundle", "places", "times", "items", "repeats", "weight", "n_docs", "n_terms")
        add = _add_stage(k, owner, owner == stages - 1)
        held = stage(held.groupBy("slice", "bundle").cogroup(mine.groupBy("slice", "bundle")).applyInArrow(add, BUNDLE), "bundles")
    flat = held.select("slice", F.explode(F.arrays_zip("items", "places", "scores")).alias("x")).select(
        "slice", F.col("x.items").alias("item"), F.explode(F.arrays_zip("x.places", "x.scores")).alias("y")
    ).select("slice", "item", F.col("y.places").alias("place"), F.col("y.scores").alias("score"))
    named = flat.join(slices.select("slice", "ids"), "slice").select("item", "slice", "place", "score", F.get("ids", F.col("place")).alias("id"))
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "slice", "place")
    best = named.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.join(broadcast_if_small(numbered.select("item", "item_id")), "item").select("item_id", "rank", "id", "score")
