"""Nearest-centroid language identification on normalised TF-IDF vectors of character n-grams.

Features: letters lower-cased, every run of other characters one space; n-grams of 1 to 3 characters hashed into DIM
buckets; 1 + log of each count, times the bucket's inverse document frequency, normalised to length 1. Document frequencies
are counted over all learning documents. Each language gets up to CLUSTERS centroids by spherical k-means over a bounded
sample of its documents: the SAMPLE documents with the smallest hashes of their id. The sample bounds the fit
only; every document is counted and judged by its whole text.

A text belongs to the language of the centroid with the highest cosine. It is accepted if that cosine reaches the centroid's
own threshold: the lowest cosine among REACH of its members, less MARGIN.

Defined cases: a text that is null or has no letter is `und` with score 0 and not accepted; with nothing to learn from
every text is; ties go to the language first in order; rows without language are not learned from; repeated rows are judged
alike. An empty table gives an empty table.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .store import broadcast_if_small, columns_clear_of, shipped, slices, stage, unpacked

cloudpickle.register_pickle_by_value(sys.modules[__name__])

DIM = 1 << 13
CLUSTERS = 3
#: Most documents of a language that its centroids are fitted on.
SAMPLE = 600
ROUNDS = 10
REACH = 0.98
MARGIN = 0.05
UNKNOWN = "und"
_PLAIN: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point: itself if it is a letter, else a space. Made once per worker."""
    if not _PLAIN:
        table = np.full(0x110000, 0x20, np.uint32)
        points = np.fromiter((c for c in range(0x110000) if chr(c).isalpha()), np.uint32)
        table[points] = points
        _PLAIN.append(table)
    return _PLAIN[0]


def bucket_counts(text: str | None, dim: int = DIM) -> np.ndarray | None:
    """Counts of hashed n-grams; None if there is no letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    plain = _letters()[points]
    space = plain == 0x20
    if space.all():
        return None
    keep = np.ones(len(plain), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    plain = plain[keep]
    one = np.concatenate(([0x20], plain, [0x20])).astype(np.uint64)
    counts = np.zeros(dim, np.int64)
    code = np.zeros(len(one), np.uint64)
    for n in range(1, 4):
        code = code[: len(one) - n + 1] * np.uint64(0x110000 + 7) + one[n - 1 :]
        mixed = (code + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        counts += np.bincount((mixed >> np.uint64(64 - dim.bit_length() + 1)).astype(np.int64), minlength=dim)
    return counts


def unit_vector(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values) of the normalised TF-IDF vector."""
    at = np.flatnonzero(counts)
    values = (1 + np.log(counts[at])) * idf[at]
    return at.astype(np.int32), (values / max(np.linalg.norm(values), 1e-12)).astype(np.float32)


def fit_centroids(vectors: np.ndarray, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from the farthest points on: (centroids of length 1, threshold of each)."""
    mean = vectors.mean(axis=0)
    chosen = [int(np.argmax(vectors @ mean))]
    near = vectors @ vectors[chosen[0]]
    while len(chosen) < min(clusters, len(vectors)):
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, vectors @ vectors[chosen[-1]])
    centroids = vectors[chosen]
    for _ in range(rounds):
        own = np.argmax(vectors @ centroids.T, axis=1)
        sums = np.stack([vectors[own == k].sum(axis=0) if (own == k).any() else centroids[k] for k in range(len(centroids))])
        new = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
        if np.allclose(new, centroids):
            break
        centroids = new
    cosines = vectors @ centroids.T
    own = np.argmax(cosines, axis=1)
    reach = [np.sort(cosines[own == k, k])[::-1] for k in range(len(centroids))]
    limits = [float(r[min(len(r) - 1, int(len(r) * REACH))]) - MARGIN if len(r) else 1.0 for r in reach]
    return centroids.astype(np.float32), np.array(limits, np.float32)


def inverse_frequencies(learn: DataFrame, dim: int = DIM) -> np.ndarray:
    """Smoothed idf by bucket over all texts; the driver gets `dim` numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros(dim, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                counts = bucket_counts(text.as_py(), dim)
                if counts is not None:
                    sums += counts > 0
                    n += 1
        if n:  # bucket -1 counts the documents
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, dim)), pa.array(np.concatenate(([n], sums)))], ["bucket", "n"])

    frequencies = np.zeros(dim + 1)
    for bucket, n in learn.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        frequencies[bucket + 1] = n
    return np.log((1 + frequencies[0]) / (1 + frequencies[1:])) + 1


class Model:
    def __init__(self, languages: list[str], centroids: np.ndarray, limits: np.ndarray, idf: np.ndarray):
        self.languages, self.centroids, self.limits, self.idf = languages, np.ascontiguousarray(centroids.T), limits, idf

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        counts = bucket_counts(text, len(self.idf))
        if counts is None or not self.languages:
            return UNKNOWN, 0.0, False
        at, values = unit_vector(counts, self.idf)
        cosines = values @ self.centroids[at]
        best = int(np.argmax(cosines))
        return self.languages[best], float(np.clip(cosines[best], 0, 1)), bool(cosines[best] >= self.limits[best])


def fit(learn: DataFrame, sample: int = SAMPLE, dim: int = DIM, clusters: int = CLUSTERS) -> Model:
    """learn: (id, text, lang). Each language's centroids are fitted in a task of its own."""
    known = learn.filter("lang is not null")
    idf = inverse_frequencies(known, dim)
    # documents whose hash lies under a share that lets about twice the sample in; the smallest hashes of these are taken
    counts = stage(known.groupBy("lang").agg(F.count("*").alias("n")), "language-counts")
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    near = known.select("lang", "text", place.alias("h")).join(broadcast_if_small(counts), "lang").filter(F.col("h") * F.col("n") < 2 * sample)
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    picked = stage(near.withColumn("nth", nth).filter(F.col("nth") <= sample).select("lang", "text"), "language-sample")

    def cluster(rows: pd.DataFrame) -> pd.DataFrame:
        vectors = []
        for text in rows["text"]:
            counts = bucket_counts(text, dim)
            if counts is not None:
                vectors.append(np.zeros(dim, np.float32))
                at, values = unit_vector(counts, idf)
                vectors[-1][at] = values
        if not vectors:
            return pd.DataFrame({"lang": [], "centroid": [], "threshold": []})
        centroids, limits = fit_centroids(np.stack(vectors), clusters)
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "centroid": [c.tobytes() for c in centroids], "threshold": limits.astype(float)})

    found = picked.groupBy("lang").applyInPandas(cluster, "lang string, centroid binary, threshold double").collect()
    found.sort(key=lambda r: (r[0], r[1]))
    centroids = np.stack([np.frombuffer(r[1], np.float32) for r in found]) if found else np.zeros((0, dim), np.float32)
    return Model([r[0] for r in found], centroids, np.array([r[2] for r in found]), idf)


def identify(docs: DataFrame, model: Model, text_column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns of docs (or those named in keep), then lang_pred, score and accepted."""
    keep = docs.columns if keep is None else keep
    names = columns_clear_of(docs.select(*[f"`{c}`" for c in keep]), "lang_pred", "score", "accepted")
    schema = T.StructType(
        [*[docs.schema[c] for c in keep], T.StructField(names["lang_pred"], T.StringType()), T.StructField(names["score"], T.DoubleType()),
         T.StructField(names["accepted"], T.BooleanType())]
    )
    at, shared = docs.columns.index(text_column), shipped(docs.sparkSession, model)
    kept = [docs.columns.index(c) for c in keep]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = unpacked(Model, shared)
        for batch in slices(batches):
            found = list(zip(*(known.predict(t.as_py()) for t in batch.column(at)))) or [(), (), ()]
            new = [pa.array(c, k) for c, k in zip(found, (pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], *new], [*keep, *names.values()])

    return docs.mapInArrow(judge, schema)
