"""Turns chat records of unlike layouts into canonical turns, and turns into a training text with a loss mask.

Schema fingerprinting: those nested field paths of a record that any layout names are hashed; each distinct fingerprint
picks, once, the first declarative mapping whose paths it has, and the records of that fingerprint are read by that
mapping. With n paths in LAYOUTS there are at most 2^n fingerprints, so their table may be broadcast. DataFrame functions
only.

The template writes `<|im_start|>role`, a line break, the text and `<|im_end|>` with a line break. Inside texts every
`<`, backslashes, `|` gets one backslash more, so no control string can stand in a text and unescaping takes it away
again. In roles a backslash is doubled and a line break written as backslash n.

Defined cases: null text is empty, null role is the empty role; turns are ordered by turn number (nulls first), ties by
role and text; rows without conversation id form one conversation; a record that is null, not JSON or of unknown layout
has `layout` null and no turns (so has one with anything behind the object); of a field that stands twice the last counts;
records are read by the JSON functions on strings, whose limit is that of a string (2 GB); a conversation is one row, as its formatted text is.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from .store import columns_clear_of

START, END, LOSS_ROLE = "<|im_start|>", "<|im_end|>\n", "assistant"
TURNS = "array<struct<role:string,text:string>>"

#: Layouts in order of choice: name, field paths a record must have, expression of its turns over the record `v` read as RECORD.
LAYOUTS: list[tuple[str, list[str], str]] = [
    (
        "messages", ["messages[].content", "messages[].role"],
        "transform(v.messages, m -> struct(m['role'] as role, m['content'] as text))",
    ),
    (
        "from_value", ["conversations[].from", "conversations[].value"],
        "transform(v.conversations, m -> struct("
        "case m['from'] when 'human' then 'user' when 'gpt' then 'assistant' else m['from'] end as role, m['value'] as text))",
    ),
    (
        "instruction", ["instruction", "output"],
        "array(struct('user' as role, concat(v.instruction, if(coalesce(v.input, '') = '', '', concat('\\n', v.input))) as text),"
        " struct('assistant' as role, v.output as text))",
    ),
    (
        "prompt_response", ["prompt", "response"],
        "array(struct('user' as role, v.prompt as text), struct('assistant' as role, v.response as text))",
    ),
    (
        "prompt_completion", ["prompt", "completion"],
        "array(struct('user' as role, v.prompt as text), struct('assistant' as role, v.completion as text))",
    ),
    (
        "question_answer", ["question", "answer"],
        "array(struct('user' as role, v.question as text), struct('assistant' as role, v.answer as text))",
    ),
]
PATHS = sorted({p for _, needed, _ in LAYOUTS for p in needed})
LISTS = sorted({p.split("[].")[0] for p in PATHS if "[]." in p})
#: What is read of a record. Fields of list elements are a map, so further fields of any depth are in no one's way.
RECORD = ", ".join([*[f"{n} array<map<string,string>>" for n in LISTS], *[f"{p} string" for p in PATHS if "[]." not in p], "input string"])
NO_LIMIT = {"maxStringLen": str((1 << 31) - 1)}


def read_record(record: Column) -> Column:
    """The record's RECORD fields; null if it isn't one JSON object. Values that are no strings are their JSON text."""
    # an array of one value: nothing stands behind the object
    whole = F.json_object_keys(record).isNotNull() & (F.json_array_length(F.concat(F.lit("["), record, F.lit("]"))) == 1)
    return F.when(whole, F.from_json(record, RECORD, NO_LIMIT))


def field_paths(record: Column, v: Column) -> Column:
    """Those of PATHS that a record (read as v) has, sorted; a field of list elements counts if one of them has it."""
    nested = [
        F.flatten(
            F.transform(
                F.coalesce(v[n], F.array()), lambda m: F.coalesce(F.transform(F.map_keys(m), lambda k: F.concat(F.lit(f"{n}[]."), k)), F.array())
            )
        )
        for n in LISTS
    ]
    named = F.array(*[F.lit(p) for p in PATHS])
    return F.when(v.isNotNull(), F.array_intersect(named, F.concat(F.json_object_keys(record), *nested)))


def canonical_turns(records: DataFrame, record_column: str = "record") -> DataFrame:
    """The columns of records, then layout (null if unknown) and turns: array of (role, text).

    The names `layout` and `turns` are prefixed with `_` where records already has them.
    """
    names = columns_clear_of(records, "layout", "turns", "v", "fingerprint", "paths", "known")
    v, fingerprint, paths = names["v"], names["fingerprint"], names["paths"]
    parsed = records.withColumn(v, read_record(F.col(record_column))).withColumn(paths, field_paths(F.col(record_column), F.col(v)))
    parsed = parsed.withColumn(fingerprint, F.xxhash64(F.col(paths)))
    # one row per fingerprint: its mapping is chosen once, not per record
    choice = F.coalesce(
        *[
            F.when(F.size(F.array_except(F.array(*[F.lit(p) for p in needed]), F.col(paths))) == 0, F.lit(name))
            for name, needed, _ in LAYOUTS
        ]
    )
    known = (
        parsed.filter(F.col(paths).isNotNull()).groupBy(F.col(fingerprint).alias(names["known"]))
        .agg(F.first(paths).alias(paths)).select(names["known"], choice.alias(names["layout"]))
    )
    joined = parsed.drop(paths).join(F.broadcast(known), F.col(fingerprint) == F.col(names["known"]), "left")
    turns = F.coalesce(
        *[
            F.when(F.col(names["layout"]) == name, F.expr(re.sub(r"\bv\.", f"`{v}`.", how))).cast(TURNS)
            for name, _, how in LAYOUTS
        ],
        F.array().cast(TURNS),
    )
    return joined.withColumn(names["turns"], turns).select(*[f"`{c}`" for c in records.columns], names["layout"], names["turns"])


def records_of_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) rows -> (conv_id, record): one record in the `messages` layout per conversation."""
    turn = F.struct(
        F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content")
    )
    return rows.groupBy("conv_id").agg(
        F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(turn)), lambda t: t.dropFields("turn")).alias("messages"))).alias("record")
    )


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    parts = F.transform(F.split(role, r"\\\\"), lambda p: F.replace(p, F.lit("\\n"), F.lit("\n")))
    return unescape(F.array_join(parts, "\\"))


def format_chats(chats: DataFrame, key: str, turns: str = "turns") -> DataFrame:
    """(key, formatted, loss_mask): loss_mask has (start, length) in code points of the assistant texts, in order.

    key must be unique; null is a key as well. A chat without turns has an empty text.
    """
    pieces = chats.select(key, F.posexplode_outer(turns).alias("pos", "turn")).select(
        key, "pos",
        F.concat(F.lit(START), escape_role(F.coalesce("turn.role", F.lit(""))), F.lit("\n")).alias("head"),
        escape(F.coalesce("turn.text", F.lit(""))).alias("body"),
        (F.coalesce("turn.role", F.lit("")) == LOSS_ROLE).alias("learned"),
    )
    piece = F.when(F.col("pos").isNotNull(), F.concat("head", "body", F.lit(END))).otherwise("")
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumn("piece", piece).withColumn(
        "start", (F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.length("head")).cast("long")
    )
    span = F.when(F.col("learned"), F.struct(F.col("start"), F.length("body").cast("long").alias("length")))
    return placed.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda p: p["piece"]), "").alias("formatted"),
        F.array_sort(F.collect_list(span)).alias("loss_mask"),
    )


def read_turns(formatted: Column) -> Column:
    """Turns (role, text) read back from a formatted text."""
    pieces = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda p: p.startswith(START))
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape_role(F.substring_index(F.substr(p, F.lit(len(START) + 1)), "\n", 1)).alias("role"),
            unescape(F.regexp_replace(p, r"^[^\n]*\n", "")).alias("text"),
        ),
    )


def read_masked(formatted: Column, loss_mask: Column) -> Column:
    """The unescaped text under the mask, spans joined without anything between."""
    return F.array_join(
        F.transform(loss_mask, lambda m: unescape(F.substr(formatted, (m["start"] + 1).cast("int"), m["length"].cast("int")))), ""
    )
