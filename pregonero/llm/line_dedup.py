"""Line dedup: common blocks of lines go from the later of two documents.

1. Texts are cut into lines; a line is cut further after each sentence of at least `sentence_words` words, so passages that
   begin or end within a long line, and near copies of it, are found too. "Line" below means such a piece.
2. Every line with a word gets a token: the hash of its words, with that of the line before if it has fewer than
   `context_words`. So a short line counts as shared only where its neighbour is shared too.
3. From every line the shortest window of lines in a row with `min_block_words` words or more begins, and at every line the
   shortest such window ends. The windows within any run of that many words cover all of the run.
4. Windows elect partners: a window found in several documents pairs each later one with the first that holds it. So every
   run of `min_block_words` words or more that an earlier document holds in a row has a partner for each window in it, and a
   common passage gives one pair per document, not one per two documents; no window is too common to count.
5. Each pair is aligned by patience diff: of the windows that occur once on both sides the longest run that rises on both
   sides is taken, and the gaps between are aligned in the same way. What crosses the alignment (moved passages, repeats) is
   aligned again, dealt by patience into as few rising runs as there can be, until nothing shared is left over.
6. Aligned blocks are deleted from the later document, blocks of several pairs that overlap or touch as one, with the line
   breaks of lines that go as a whole. `common_blocks` gives the blocks pair by pair.

Documents are ordered by id (nulls last), those of equal id by the hash of their text. Rows equal in id and text are one
document: they are never compared with each other and get the same result.

Defined cases: null texts and texts without words stay as they are; a document that repeats its own lines keeps them; the
first document of any copies keeps its text whole; a document may end up empty, its text is then ''. An empty table gives
an empty table.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import drop_dir, work_dir
from .store import WORD, columns_clear_of, slices, stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SENTENCE_WORDS = 8
CONTEXT_WORDS = 5
MIN_BLOCK_WORDS = 20
MASK = (1 << 63) - 1
SENTENCE_END = re.compile(r"[.!?]+(?=[\x20\x09-\x0D])")
LINE_FIRST, LINE_LAST, REPEATED = 1, 2, 4
FIELDS = ["token", "place", "last", "before", "after", "start", "end", "flags"]


def line_spans(text: str, sentence_words: int = SENTENCE_WORDS) -> list[tuple[int, int, int]]:
    """(start, end, flags) of the lines; they lie end to end, a line break belongs to the line before it."""
    spans, at = [], 0
    for line in text.split("\n"):
        start = sentence = 0
        for m in SENTENCE_END.finditer(line):
            end = m.end()
            if len(line[sentence:end].encode().split()) >= sentence_words:
                spans.append((at + start, at + end, LINE_FIRST if not start else 0))
                start = end
            sentence = end
        ends = at + len(line) + 1
        flags = (0 if start else LINE_FIRST) | (LINE_LAST if ends <= len(text) else 0)
        spans.append((at + start, min(ends, len(text)), flags))
        at = ends
    return spans


def line_tokens(text: str | None, sentence_words: int = SENTENCE_WORDS, context_words: int = CONTEXT_WORDS) -> list[tuple]:
    """(token, words, start, end, flags) of the lines with a word."""
    found: list[tuple] = []
    text = text or ""
    before = b""
    for start, end, flags in line_spans(text, sentence_words):
        words = text[start:end].encode().split()
        if not words:
            continue
        whole = b" ".join(words)
        token = xxhash.xxh64_digest(whole if len(words) >= context_words else before + b"\n" + whole)
        before = whole
        found.append((token, len(words), start, end, flags))
    return found


def line_windows(
    text: str | None, sentence_words: int = SENTENCE_WORDS, context_words: int = CONTEXT_WORDS, min_block_words: int = MIN_BLOCK_WORDS
) -> list[tuple]:
    """The values of FIELDS for each window: its token, first and last line, words of the text before it and up to its end,
    start, end, and flags of its first and last line; REPEATED if the text has it more than once."""
    lines = line_tokens(text, sentence_words, context_words)
    tokens = b"".join(line[0] for line in lines)
    upto = [0]
    for line in lines:
        upto.append(upto[-1] + line[1])
    bounds = set()
    last = 0
    for first in range(len(lines)):  # shortest window that begins here
        while last < len(lines) and upto[last + 1] - upto[first] < min_block_words:
            last += 1
        if last == len(lines):
            break
        bounds.add((first, last))
    first = 0
    for last in range(len(lines)):  # shortest window that ends here
        while first < last and upto[last + 1] - upto[first + 1] >= min_block_words:
            first += 1
        if upto[last + 1] - upto[first] >= min_block_words:
            bounds.add((first, last))
    places = sorted(bounds)
    keys = [xxhash.xxh64_intdigest(tokens[8 * a : 8 * (b + 1)]) & MASK for a, b in places]
    times = Counter(keys)
    return [
        (
            key, a, b, upto[a], upto[b + 1], lines[a][2], lines[b][3],
            lines[a][4] & LINE_FIRST | lines[b][4] & LINE_LAST | (REPEATED if times[key] > 1 else 0),
        )
        for key, (a, b) in zip(keys, places)
    ]


def longest_run(places: list[int]) -> list[int]:
    """Indices of a longest strictly rising subsequence, by patience piles."""
    tops: list[int] = []
    pile_of: list[int] = []
    back: list[int] = []
    for i, p in enumerate(places):
        at = bisect_left(tops, p)
        back.append(pile_of[at - 1] if at else -1)
        if at == len(tops):
            tops.append(p)
            pile_of.append(i)
        else:
            tops[at], pile_of[at] = p, i
    run, i = [], pile_of[-1] if pile_of else -1
    while i >= 0:
        run.append(i)
        i = back[i]
    return run[::-1]


def rising_runs(places: list[int]) -> list[list[int]]:
    """Indices dealt into as few strictly rising subsequences as there can be."""
    tops: list[int] = []
    runs: list[list[int]] = []  # in the order of their tops
    for i, p in enumerate(places):
        at = bisect_left(tops, p) - 1
        if at < 0:
            tops.insert(0, p)
            runs.insert(0, [i])
        else:
            tops[at] = p
            runs[at].append(i)
    return runs


def patience(shared: list[dict]) -> list[int]:
    """Indices of the windows aligned by patience diff. shared: windows of a later document in the order of their places,
    each with its first place in the earlier one (`spot`) and whether it is repeated there (`repeated`)."""
    kept: list[int] = []
    regions = [list(range(len(shared)))]
    while regions:
        region = regions.pop()
        times = Counter(shared[i]["spot"] for i in region)
        # at the top a window is an anchor if both documents have it once; within a gap, if the gap does
        whole = len(region) == len(shared)
        once = [i for i in region if times[shared[i]["spot"]] == 1 and not (whole and (shared[i]["repeated"] or shared[i]["flags"] & REPEATED))]
        anchors = once or region
        run = [anchors[k] for k in longest_run([shared[i]["spot"] for i in anchors])]
        kept += run
        if not once or len(run) == len(region):
            continue
        here, there, taken = [shared[i]["place"] for i in run], [shared[i]["spot"] for i in run], set(run)
        gaps: dict[int, list[int]] = {}
        for i in region:
            gap = bisect_left(here, shared[i]["place"])
            spot = shared[i]["spot"]
            if i not in taken and gap == bisect_left(there, spot) and (gap == len(there) or there[gap] != spot):
                gaps.setdefault(gap, []).append(i)
        regions += gaps.values()
    return sorted(kept)


def _extend(block: dict, window: dict) -> None:
    if window["last"] > block["last"]:
        flags = block["flags"] & LINE_FIRST | window["flags"] & LINE_LAST
        block.update(last=window["last"], after=window["after"], end=window["end"], flags=flags)


def aligned_pair(shared: list[dict]) -> list[dict]:
    """The common blocks of a pair: windows aligned one behind the other in both documents, joined. `spot` is the first line
    in the earlier document; `moved` says that the block crosses the alignment or repeats. Every window given is aligned."""
    shared = sorted(shared, key=lambda s: (s["place"], s["last"]))
    straight = patience(shared)
    taken = set(straight)
    rest = [i for i in range(len(shared)) if i not in taken]
    runs = [straight, *([rest[k] for k in run] for run in rising_runs([shared[i]["spot"] for i in rest]))]
    blocks: list[dict] = []
    for number, run in enumerate(runs):
        before = len(blocks)
        for i in run:
            window = shared[i]
            last = blocks[-1] if len(blocks) > before else None
            if last and window["place"] <= last["last"] + 1 and window["place"] - last["place"] == window["spot"] - last["spot"]:
                _extend(last, window)
            else:
                blocks.append({**window, "moved": number > 0})
    return blocks


def common_with_partners(shared: list[dict]) -> list[dict]:
    """The common blocks of a later document with each of its partners. shared: its windows, each with the `holder`."""
    pairs: dict[tuple, list[dict]] = {}
    for s in shared:
        pairs.setdefault((s["holder"], s["holder_hash"]), []).append(s)
    return [block for its in pairs.values() for block in aligned_pair(its)]


def joined_blocks(common: list[dict]) -> list[tuple[int, int, int]]:
    """(start, end, words) of the blocks to delete: common blocks that overlap or touch, joined."""
    blocks: list[dict] = []
    for s in sorted(common, key=lambda s: s["place"]):
        if blocks and s["place"] <= blocks[-1]["last"] + 1:
            _extend(blocks[-1], s)
        else:
            blocks.append(dict(s))
    # the break after a line stays if the text before the block stands in front of it
    return [
        (b["start"], b["end"] - (b["flags"] & (LINE_FIRST | LINE_LAST) == LINE_LAST), b["after"] - b["before"]) for b in blocks
    ]


def _windows(docs: DataFrame, sentence_words: int, context_words: int, min_block_words: int) -> DataFrame:
    """(id, hash, text) -> (id, hash, windows)."""
    window = T.StructType([T.StructField(n, T.IntegerType() if i else T.LongType()) for i, n in enumerate(FIELDS)])
    schema = T.StructType([*docs.schema.fields[:2], T.StructField("windows", T.ArrayType(window))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, columns = [0], [[] for _ in FIELDS]
            for text in batch.column(2):
                found = line_windows(text.as_py(), sentence_words, context_words, min_block_words)
                for column, values in zip(columns, zip(*found)):
                    column.extend(values)
                offsets.append(offsets[-1] + len(found))
            kinds = [pa.int64(), *[pa.int32()] * (len(FIELDS) - 1)]
            structs = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], FIELDS)
            windows = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), windows], ["id", "hash", "windows"])

    return docs.mapInArrow(run, schema)


def _align(shared: DataFrame) -> DataFrame:
    """(id, hash, shared) -> (id, hash, blocks, common)."""
    block = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("words", pa.int32())])
    id_type = shared.schema["id"].dataType
    common_type = T.StructType(
        [
            T.StructField("holder", id_type), *[T.StructField(n, T.IntegerType()) for n in ("place", "last", "spot", "words")],
            T.StructField("moved", T.BooleanType()),
        ]
    )
    schema = T.StructType(
        [
            T.StructField("id", id_type), T.StructField("hash", T.LongType()),
            T.StructField("blocks", T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("start", "end", "words")]))),
            T.StructField("common", T.ArrayType(common_type)),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            kind = batch.schema.field(0).type
            common_kind = pa.list_(
                pa.struct([("holder", kind), *[(n, pa.int32()) for n in ("place", "last", "spot", "words")], ("moved", pa.bool_())])
            )
            found, pairs = [], []
            for s in batch.column(2):
                common = common_with_partners(s.as_py())
                found.append([{"start": a, "end": b, "words": w} for a, b, w in joined_blocks(common)])
                pairs.append([{**{n: c[n] for n in ("holder", "place", "last", "spot", "moved")}, "words": c["after"] - c["before"]} for c in common])
            columns = [batch.column(0), batch.column(1), pa.array(found, pa.list_(block)), pa.array(pairs, common_kind)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "hash", "blocks", "common"])

    return shared.mapInArrow(run, schema)


def duplicate_blocks(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    sentence_words: int = SENTENCE_WORDS, context_words: int = CONTEXT_WORDS, min_block_words: int = MIN_BLOCK_WORDS,
    below: str | None = None,
) -> DataFrame:
    """(id, hash, blocks, common), for documents that have any: the blocks to delete, and the blocks common with each partner;
    hash as text_hash() gives it. below: a folder for written windows that the caller drops."""
    keyed = docs.select(F.col(id_column).alias("id"), text_hash(text_column).alias("hash"), F.col(text_column).alias("text"))
    cut = stage(_windows(keyed, sentence_words, context_words, min_block_words), "line-windows", below)
    windows = cut.select("id", "hash", F.explode("windows").alias("window")).select("id", "hash", "window.*")
    repeated = F.col("flags").bitwiseAND(F.lit(REPEATED)) > 0
    holder = F.struct(F.col("id").isNull().alias("none"), "id", "hash", F.col("place").alias("spot"), repeated.alias("repeated"))
    first = windows.groupBy("token").agg(F.min(holder).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    own = F.col("id").eqNullSafe(F.col("first.id")) & F.col("hash").eqNullSafe(F.col("first.hash"))
    one = F.struct(*FIELDS[1:], F.col("first.id").alias("holder"), F.col("first.hash").alias("holder_hash"), "first.spot", "first.repeated")
    shared = windows.join(first, "token").filter(~own).select("id", "hash", one.alias("one"))
    return _align(shared.groupBy("id", "hash").agg(F.collect_set("one").alias("shared")))


def common_blocks(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, holder, place, last, spot, words, moved): each block of lines that a document has in common with an earlier one,
    `holder`: its first and last line, its first line there, its words, and whether it crosses the alignment or repeats."""
    return duplicate_blocks(docs, id_column, text_column).select("id", F.explode("common").alias("one")).select("id", "one.*")


def text_hash(text_column: str) -> Column:
    return F.when(F.col(text_column).isNotNull(), F.xxhash64(F.col(text_column)))


def dedup_lines(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    sentence_words: int = SENTENCE_WORDS, context_words: int = CONTEXT_WORDS, min_block_words: int = MIN_BLOCK_WORDS,
) -> DataFrame:
    """docs with blocks deleted from the text, then n_blocks and n_removed_words (names prefixed by `_` if taken)."""
    names = columns_clear_of(docs, "n_blocks", "n_removed_words", "dup_id", "dup_hash", "blocks")
    below = work_dir(docs.sparkSession, "line-dedup")
    written = stage(duplicate_blocks(docs, id_column, text_column, sentence_words, context_words, min_block_words, below), "line-blocks")
    drop_dir(docs.sparkSession, below)  # the windows are larger than the texts
    found = written.select(
        F.col("id").alias(names["dup_id"]), F.col("hash").alias(names["dup_hash"]), F.col("blocks").alias(names["blocks"])
    )
    joined = docs.join(
        found,
        F.col(f"`{id_column}`").eqNullSafe(F.col(names["dup_id"])) & text_hash(text_column).eqNullSafe(F.col(names["dup_hash"])),
        "left",
    )
    blocks = F.col(names["blocks"])
    # what is kept lies between the blocks, which are in order: from the end of one to the start of the next
    begins = F.concat(F.array(F.lit(0)), F.transform(blocks, lambda b: b["end"]))
    ends = F.concat(F.transform(blocks, lambda b: b["start"]), F.array(F.length(text_column)))
    pieces = F.zip_with(begins, ends, lambda a, b: F.substr(F.col(text_column), a + 1, b - a))
    text = F.when(blocks.isNull(), F.col(text_column)).otherwise(F.array_join(pieces, ""))
    return joined.select(
        *[text.alias(c) if c == text_column else F.col(f"`{c}`") for c in docs.columns],
        F.when(blocks.isNull(), 0).otherwise(F.size(blocks)).cast("long").alias(names["n_blocks"]),
        F.coalesce(F.aggregate(blocks, F.lit(0).cast("long"), lambda a, b: a + b["words"]), F.lit(0).cast("long")).alias(names["n_removed_words"]),
    )


def clean(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs without the duplicate blocks and without the documents of which nothing is left; the columns of docs."""
    names = columns_clear_of(docs, "n_blocks")
    left = dedup_lines(docs, id_column, text_column)
    emptied = (F.col(names["n_blocks"]) > 0) & ~F.col(text_column).rlike(WORD)
    return left.filter(~F.coalesce(emptied, F.lit(False))).select(*[f"`{c}`" for c in docs.columns])
