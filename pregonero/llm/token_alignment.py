"""Two tokenizers' tokens of one text aligned by the byte offsets where tokens of both end.

Both end lists are sorted. The shorter one drives: each of its ends gallops from the place that its rank suggests in the
longer list, in steps that double, and a binary search ends in the bracket found; all ends of a batch of texts advance
together, each within its own text. Common ends cut both token lists into groups, differences of the ranks of neighbouring
common ends give the tokens of each group, and every A-B pair of occurrences in a group is linked.

A pair of ids counts the documents that hold it linked. Tasks write a row per document with its groups' text digest and its
distinct id pairs with their numbers of links; Spark sums pairs over documents (folded per task before the shuffle), takes the
highest count of each A id, and joins both back. Pairs that many documents hold are joined by broadcast, a table cut to
`most_frequent` rows by a threshold of the counts that a histogram gives; all others are joined by a shuffle, where a pair
stands in fewer documents than the threshold, so neither side has a hot key.

Space + text must come out of both tokenizers byte by byte; a text that doesn't has no tokens, as null and empty texts.
Defined cases: repeated rows count as documents of their own; a group of many tokens is counted by distinct ids, not pair by
pair; an empty table gives an empty result; columns of the input other than id and text are not used.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import bpe
from .store import broadcast_if_small, stage, text_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A pair is A id * SHIFT + B id.
SHIFT = 1 << 20
BATCH_BYTES = 1 << 20
CACHED_PIECES = 300_000
#: Groups with more links are counted by distinct ids.
WIDE = 4096
MOST_FREQUENT = 200_000


def gallop(driver: np.ndarray, longer: np.ndarray, guess: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each value of driver the first place in longer[low:high] that is not below it (high if none is).

    Starts at guess, doubles the step towards the value until it is passed, then halves the bracket.
    """
    guess = np.clip(guess, low, high - 1)
    right = longer[guess] < driver  # the place lies right of the guess
    left_end, right_end = np.where(right, guess + 1, low), np.where(right, high, guess)
    # left_end..right_end holds the place; narrow the far end in growing steps
    step, going = 1, np.flatnonzero(left_end < right_end)
    while len(going):
        r = right[going]
        probe = np.where(r, left_end[going] + step - 1, right_end[going] - step)
        inside = (probe >= left_end[going]) & (probe < right_end[going])
        going, r, probe = going[inside], r[inside], probe[inside]
        below = longer[probe] < driver[going]
        # going right: below moves the near end on, else the bracket is found; going left the other way round
        left_end[going[below]] = probe[below] + 1
        right_end[going[~below]] = probe[~below]
        going = going[r == below]
        step *= 2
    while len(going := np.flatnonzero(left_end < right_end)):
        middle = (left_end[going] + right_end[going]) >> 1
        below = longer[middle] < driver[going]
        left_end[going[below]] = middle[below] + 1
        right_end[going[~below]] = middle[~below]
    return left_end


def common_ends(a_ends: np.ndarray, b_ends: np.ndarray, a_at: np.ndarray, b_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks in both lists of the ends that both have. Texts lie in a row: text k has a_ends[a_at[k] : a_at[k + 1]], and ends
    rise over all texts."""
    n_a, n_b = np.diff(a_at), np.diff(b_at)
    ranks_a, ranks_b = [], []
    for a_drives in (True, False):
        texts = np.flatnonzero((n_a > 0) & (n_b > 0) & ((n_a <= n_b) == a_drives))
        if not len(texts):
            continue
        (ends, at, n), (longer, to, m) = ((a_ends, a_at, n_a), (b_ends, b_at, n_b)) if a_drives else ((b_ends, b_at, n_b), (a_ends, a_at, n_a))
        of = np.repeat(texts, n[texts])
        within = np.arange(len(of)) - np.repeat(np.cumsum(n[texts]) - n[texts], n[texts])
        rank = at[of] + within
        place = gallop(ends[rank], longer, to[of] + within * m[of] // n[of], to[of], to[of + 1])
        hit = (place < to[of + 1]) & (longer[np.minimum(place, len(longer) - 1)] == ends[rank])
        ranks_a.append(rank[hit] if a_drives else place[hit])
        ranks_b.append(place[hit] if a_drives else rank[hit])
    if not ranks_a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = np.concatenate(ranks_a), np.concatenate(ranks_b)
    order = np.argsort(a, kind="stable")
    return a[order], b[order]


class Vocabularies:
    """Both tokenizers in a task, with the bytes, lengths and printed forms of their tokens."""

    def __init__(self, a_json: str, b_model: bytes):
        a, b = bpe.ByteLevel(a_json, specials_are_text=True), bpe.SentencePieces(b_model)
        self.caches = bpe.PieceCache(a, after_space=True, most=CACHED_PIECES), bpe.PieceCache(b, after_space=True, most=CACHED_PIECES)
        self.bytes = a.token_bytes(), b.token_bytes()
        self.lengths = [np.array([len(t) for t in tokens]) for tokens in self.bytes]
        # what follows an id: another of its kind in the group, or the group's next part
        n = [len(t) for t in self.bytes]
        self.printed = [f"{i}{mark}" for kind, marks in enumerate((",|", ",;")) for mark in marks for i in range(n[kind])]
        self.n = n

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both tokenizers; none where the bytes differ from space + text."""
        a, b = self.caches[0].ids(texts), self.caches[1].ids(texts)
        none = np.empty(0, np.uint32)
        for k, text in enumerate(texts):
            whole = b" " + text.encode()
            if not text or any(b"".join(map(table.__getitem__, ids[k].tolist())) != whole for table, ids in zip(self.bytes, (a, b))):
                a[k] = b[k] = none
        return a, b


def _linked_pairs(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, pair, links): distinct id pairs of each text. group_a, group_b: group bounds; text: the groups' text."""
    n_a, n_b = np.diff(group_a), np.diff(group_b)
    wide = n_a * n_b > WIDE
    few = np.flatnonzero(~wide)
    links = n_a[few] * n_b[few]
    of = np.repeat(few, links)
    within = np.arange(len(of)) - np.repeat(np.cumsum(links) - links, links)
    # ids are below 2**20 both, so a batch of fewer than 2**23 texts fits into one sorted key
    key = text[of] << 40 | a[group_a[of] + within // n_b[of]].astype(np.int64) * SHIFT + b[group_b[of] + within % n_b[of]]
    key, numbers = np.unique(key, return_counts=True)
    if wide.any():
        keys, counts = [key], [numbers]
        for g in np.flatnonzero(wide):
            ids_a, times_a = np.unique(a[group_a[g] : group_a[g + 1]], return_counts=True)
            ids_b, times_b = np.unique(b[group_b[g] : group_b[g + 1]], return_counts=True)
            keys.append(text[g] << 40 | (ids_a.astype(np.int64)[:, None] * SHIFT + ids_b[None, :]).reshape(-1))
            counts.append((times_a[:, None] * times_b[None, :]).reshape(-1))
        key, numbers = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(key, kind="stable")
        key, numbers = key[order], numbers[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        key, numbers = key[first], np.add.reduceat(numbers, first)
    return key >> 40, key & ((1 << 40) - 1), numbers


def align_texts(words: Vocabularies, texts: list[str]) -> list[tuple]:
    """Per text: n_a, n_b, n_groups, n_links, groups_sha256, distinct linked id pairs, their numbers of links."""
    ids_a, ids_b = words.encode(texts)
    at = [np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int64) for ids in (ids_a, ids_b)]
    a, b = np.concatenate([*ids_a, np.empty(0, np.uint32)]).astype(np.int64), np.concatenate([*ids_b, np.empty(0, np.uint32)]).astype(np.int64)
    # both kinds have the same bytes in each text, so running sums over the batch agree at the texts' ends
    a_ends, b_ends = np.cumsum(words.lengths[0][a]), np.cumsum(words.lengths[1][b])
    rank_a, rank_b = common_ends(a_ends, b_ends, *at)
    group_a, group_b = np.concatenate(([0], rank_a + 1)), np.concatenate(([0], rank_b + 1))
    text = np.searchsorted(at[0], rank_a, side="right") - 1
    links = np.diff(group_a) * np.diff(group_b)
    n_links = np.zeros(len(texts), np.int64)
    np.add.at(n_links, text, links)
    bounds = np.searchsorted(text, np.arange(len(texts) + 1))
    # the printed groups: A tokens of a group come before its B tokens
    last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    last_a[rank_a], last_b[rank_b] = True, True
    # the groups that have ended before each token
    number_a, number_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    codes = np.empty(len(a) + len(b), np.int64)
    codes[np.arange(len(a)) + group_b[number_a]] = a + last_a * words.n[0]
    codes[np.arange(len(b)) + group_a[number_b + 1]] = 2 * words.n[0] + b + last_b * words.n[1]
    owner, pairs, numbers = _linked_pairs(a, b, group_a, group_b, text)
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    out, get = [], words.printed.__getitem__
    for k in range(len(texts)):
        n_a, n_b = len(ids_a[k]), len(ids_b[k])
        said = "".join(map(get, codes[at[0][k] + at[1][k] : at[0][k + 1] + at[1][k + 1]].tolist()))[:-1]
        digest = hashlib.sha256(said.encode()).hexdigest() if n_a else ""
        own = slice(cuts[k], cuts[k + 1])
        out.append((n_a, n_b, int(bounds[k + 1] - bounds[k]), int(n_links[k]), digest, pairs[own], numbers[own]))
    return out


def align(docs: DataFrame, a_json: str, b_model: bytes, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Writes a row per document: row (its number), id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, links (arrays)."""
    id_type = docs.schema[id_column].dataType
    longs, kind = T.LongType(), to_arrow_type(id_type)
    names = ["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "links"]
    types = [longs, id_type, longs, longs, longs, longs, T.StringType(), T.ArrayType(longs), T.ArrayType(T.IntegerType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, row = Vocabularies(a_json, b_model), TaskContext.get().partitionId(), 0
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False), dtype=np.int64)
            at = 0
            while at < batch.num_rows:
                upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BATCH_BYTES, side="right")))
                done = align_texts(words, batch.column(1).slice(at, upto - at).to_pylist())
                columns = list(zip(*done))
                sizes_of = np.concatenate(([0], np.cumsum([len(p) for p in columns[5]]))).astype(np.int32)
                arrays = [pa.ListArray.from_arrays(pa.array(sizes_of), pa.array(np.concatenate(c).astype(t))) for c, t in ((columns[5], np.int64), (columns[6], np.int32))]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + upto - at) + (part << 40)), batch.column(0).slice(at, upto - at).cast(kind),
                        *[pa.array(c, pa.int64()) for c in columns[:4]], pa.array(columns[4], pa.string()), *arrays,
                    ],
                    names,
                )
                row, at = row + upto - at, upto

    schema = T.StructType([T.StructField(n, t) for n, t in zip(names, types)])
    return stage(docs.select(F.col(id_column), text_of(text_column)).mapInArrow(run, schema), "alignment")


def frequent_threshold(counts: DataFrame, most: int) -> int:
    """The smallest document count that at most so many pairs reach, found in a histogram by powers of two."""
    level = F.floor(F.log2("n")).cast("int")
    above, least = 0, 1
    for k, pairs in sorted(((r[0], r[1]) for r in counts.groupBy(level.alias("k")).count().collect()), reverse=True):
        above += pairs
        if above > most:
            return 1 << k + 1
        least = 1 << k
    return least


def link_counts(aligned: DataFrame, most_frequent: int = MOST_FREQUENT) -> DataFrame:
    """Adds n_best and count_sum to what `align` wrote, and takes row, pairs and links away."""
    counts = stage(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")), "pair-counts")
    best = counts.groupBy(F.floor(F.col("pair") / SHIFT).alias("a")).agg(F.max("n").alias("most"))  # a row per A id
    told = counts.join(broadcast_if_small(stage(best, "best-counts")), F.floor(F.col("pair") / SHIFT) == F.col("a")).select(
        "pair", "n", (F.col("n") == F.col("most")).alias("best")
    )
    limit = frequent_threshold(counts, most_frequent)
    frequent = F.broadcast(told.filter(F.col("n") >= limit).select(F.col("pair").alias("known"), "n", "best"))
    held = aligned.select("row", F.explode(F.arrays_zip("pairs", "links")).alias("held")).select(
        "row", F.col("held.pairs").alias("pair"), F.col("held.links").cast("long").alias("links")
    )
    measures = [F.sum(F.when(F.col("best"), F.col("links"))).alias("n_best"), F.sum(F.col("links") * F.col("n")).alias("count_sum")]
    common = held.join(frequent, F.col("pair") == F.col("known")).groupBy("row").agg(*measures)
    rare = held.join(frequent, F.col("pair") == F.col("known"), "left_anti").join(told.filter(F.col("n") < limit), "pair").groupBy("row").agg(*measures)
    sums = common.unionAll(rare).groupBy("row").agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")])
    return aligned.drop("pairs", "links").join(sums, "row", "left").na.fill(0, ["n_best", "count_sum"]).drop("row")
