"""Line-first cleaning: rules judge each line, failing lines go, and documents that lose too much text are rejected.

A line with a word fails if it is
* navigation: at least 3 separators (`|`, `»`, `›`, `·`) and a third as many separators as words, or more;
* symbols: 3 of its characters and a quarter of them, or more, are among `#*$%&|<>`;
* shouting: at least 3 words, and 70 % of 10 or more cased letters are capitals;
* exclamation: at least 3 words, and half of its words or more end in `!`;
* a repeat: at least 5 words, and its commonest word makes up over half of them, or a third of them or more equal the word before;
* boilerplate: a fixed phrase of script, cookie and navigation notices, on word boundaries, in a line of at most `SHORT_LINE` words;
* unpunctuated: at least `long_line` words with no `.`, `!`, `?`, `:`, `;`, `,` or closing quote anywhere.
Lines without a word are kept and count for nothing. A document is rejected if its base check fails (fewer than 10 words,
or over 20 % of its words in 5-word windows found twice or more), or if failing lines hold more than `most_lost` of its
words.

Defined cases: null text has no words and fails the base check; its cleaned text is null. Rows are judged one by one, so
repeated rows, null ids and clashing names of further columns change nothing. An empty table gives an empty table.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T

from .store import columns_clear_of, slices

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPACES = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
SEPARATORS = "|»›·"
MOST_LOST = 0.3
LONG_LINE = 40
SHORT_LINE = 12
WINDOW = 5

# Phrases of boilerplate lines, in lower case.
BOILERPLATE = (
    "enable javascript", "javascript is disabled", "cookie policy", "use cookies", "accept cookies", "privacy policy",
    "terms of use", "terms of service", "all rights reserved", "skip to content", "read more", "sign in", "log in", "click here",
    "lorem ipsum",
)
PHRASE = re.compile(rf"(?<!\w)(?:{'|'.join(BOILERPLATE)})(?!\w)")

FIELDS = [
    ("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()),
    ("n_repeat_words", T.LongType()), ("base_failed", T.BooleanType()), ("kept", T.BooleanType()),
    ("n_lines", T.LongType()), ("n_failed_lines", T.LongType()), ("lost_words", T.LongType()),
    ("failed_rules", T.StringType()), ("cleaned", T.StringType()),
]


def line_fault(line: str, words: list[bytes], long_line: int = LONG_LINE) -> str | None:
    """Name of the first rule that the line fails."""
    n = len(words)
    separators = sum(line.count(c) for c in SEPARATORS)
    if separators >= 3 and 3 * separators >= n:
        return "navigation"
    raw = line.encode()
    chars = sum(map(len, words))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    if symbols >= 3 and 4 * symbols >= chars:
        return "symbols"
    if n >= 3:
        capitals = sum(map(str.isupper, line))
        cased = capitals + sum(map(str.islower, line)) if 10 * capitals >= len(line) else 0
        if cased >= 10 and 10 * capitals >= 7 * cased:
            return "shouting"
        if 2 * sum(w.endswith(b"!") for w in words) >= n:
            return "exclamation"
    if n >= 5 and (2 * Counter(words).most_common(1)[0][1] > n or 3 * sum(map(bytes.__eq__, words, words[1:])) >= n):
        return "repeat"
    if n <= SHORT_LINE and PHRASE.search(line.lower()):
        return "boilerplate"
    if n >= long_line and not any(c in line for c in ".!?:;,”»"):
        return "unpunctuated"
    return None


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows whose word sequence occurs twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    # windows of 2, 3, ... words get consecutive numbers, so a pair of numbers always fits 64 bits
    codes, counts = ids[:n], None
    for k in range(1, window):
        _, codes, counts = np.unique(codes * len(numbers) + ids[k : k + n], return_inverse=True, return_counts=True)
        if len(counts) == n:
            return 0
    starts = np.flatnonzero(counts[codes] > 1)
    steps = np.zeros(len(words) + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + window, -1)
    return int(np.count_nonzero(np.cumsum(steps)))


def judge_text(text: str | None, most_lost: float = MOST_LOST, long_line: int = LONG_LINE) -> tuple:
    """The values of FIELDS for one text."""
    if text is None:
        return 0, 0, 0, 0, 0, True, False, 0, 0, 0, "", None
    raw = text.encode()
    words = raw.split()
    n = len(words)
    word_chars = len(text) - (len(raw) - len(raw.translate(None, SPACES)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    seen: set[str] = set()
    lines = duplicates = failed = lost = 0
    faults: set[str] = set()
    kept_lines = []
    for line in text.split("\n"):
        line_words = line.encode().split()
        if line_words:
            lines += 1
            duplicates += line in seen
            seen.add(line)
            fault = line_fault(line, line_words, long_line)
            if fault:
                failed, lost = failed + 1, lost + len(line_words)
                faults.add(fault)
                continue
        kept_lines.append(line)
    repeats = repeated_words(words)
    base_failed = n < 10 or 100 * repeats > 20 * n
    kept = not base_failed and lost <= most_lost * n
    return (
        n, word_chars, symbols, duplicates, repeats, base_failed, kept, lines, failed, lost, ",".join(sorted(faults)),
        "\n".join(kept_lines) if failed else text,
    )


def apply_rules(
    docs: DataFrame, text_column: str = "text", most_lost: float = MOST_LOST, long_line: int = LONG_LINE,
    keep: list[str] | None = None, cleaned: bool = True,
) -> DataFrame:
    """The columns of docs (or those named in keep), then those of FIELDS; `cleaned` is the text without its failing lines
    (null if not asked for)."""
    keep = docs.columns if keep is None else keep
    names = columns_clear_of(docs.select(*[f"`{c}`" for c in keep]), *[n for n, _ in FIELDS])
    schema = T.StructType([*[docs.schema[c] for c in keep], *[T.StructField(names[n], t) for n, t in FIELDS]])
    at, kept = docs.columns.index(text_column), [docs.columns.index(c) for c in keep]
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 3 + [pa.string()] * 2
    labels = [names[n] for n, _ in FIELDS]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            results = [judge_text(t.as_py(), most_lost, long_line) for t in batch.column(at)]
            columns = list(zip(*results)) or [()] * len(kinds)
            if not cleaned:
                columns[-1] = [None] * len(results)
            columns = [pa.array(c, k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], *columns], [*keep, *labels])

    return docs.mapInArrow(judge, schema)


def clean(docs: DataFrame, text_column: str = "text", most_lost: float = MOST_LOST, long_line: int = LONG_LINE) -> DataFrame:
    """The kept documents, without their failing lines; the columns of docs."""
    others = [c for c in docs.columns if c != text_column]
    names = columns_clear_of(docs.select(*[f"`{c}`" for c in others]), *[n for n, _ in FIELDS])
    judged = apply_rules(docs, text_column, most_lost, long_line, others).filter(F.col(names["kept"]))
    return judged.select(*[F.col(names["cleaned"]).alias(c) if c == text_column else F.col(f"`{c}`") for c in docs.columns])
