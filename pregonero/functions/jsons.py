"""JSON expressions over text and variant columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import blank_to_null, let

# Keys looked up, in this order, when a table cell holds a JSON object.
CELL_KEYS = ["name", "title", "value", "amount", "id"]
KEEP_NULLS = {"ignoreNullFields": "false"}


def field(v: Column, path: str) -> Column:
    """One member of a variant as text; missing, JSON null and wrong shapes are null."""
    return F.try_variant_get(v, f"$.{path}", "string")


def member(v: Column, path: str) -> Column:
    """One member of a variant as a variant."""
    return F.try_variant_get(v, f"$.{path}", "variant")


def has_key(v: Column, key: str) -> Column:
    """The key is present, even with a JSON null."""
    return member(v, key).isNotNull()


def text_has_key(json_text: Column, key: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(json_text), key), F.lit(False))


def path_text(json_text: Column, *path: str) -> Column:
    """A value deep in JSON text, as text."""
    return F.get_json_object(json_text, "$." + ".".join(path))


def flag(json_text: Column, key: str) -> Column:
    """A member read as boolean."""
    return F.get_json_object(json_text, f"$.{key}").try_cast("boolean")


def unwrap_cell(cell: Column) -> Column:
    """A table cell that may hold JSON: a one-element list is opened, an object gives its first known key."""

    def read(text: Column) -> Column:
        return F.when(~text.isin("", "null"), F.when(text.rlike(r"^[\[{]"), let(F.try_parse_json(text), opened(text))).otherwise(text))

    def opened(text: Column):
        def unwrap(v: Column) -> Column:
            only = F.get(F.try_variant_get(v, "$", "array<variant>"), F.lit(0))
            single = F.when(F.size(F.try_variant_get(v, "$", "array<variant>")) == 1, only).otherwise(v)
            return F.when(v.isNull(), text).otherwise(let(single, first_member))

        return unwrap

    def first_member(v: Column) -> Column:
        known = F.coalesce(*[F.try_variant_get(v, f"$.{k}", "variant") for k in CELL_KEYS], v)
        return blank_to_null(F.try_variant_get(known, "$", "string"))

    return let(cell, read)


def merge(old: Column, new: Column) -> Column:
    """Top-level merge of two JSON objects given as text; the right side wins and value types are kept."""
    kind = "map<string,variant>"
    left = F.coalesce(F.from_json(old, kind), F.from_json(F.lit("{}"), kind))
    right = F.from_json(new, kind)
    both = F.map_zip_with(left, right, lambda _, a, b: F.coalesce(b, a))
    return F.when(new.isNull(), old).otherwise(F.to_json(both, KEEP_NULLS))


def build(**members: Column) -> Column:
    """A JSON object with every key present, nulls included."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in members.items()]), KEEP_NULLS)


def row_json(columns: list[str]) -> Column:
    """A whole row as JSON with ISO dates and amounts as plain numbers."""
    return F.to_json(F.struct(*[F.col(c) for c in columns]), KEEP_NULLS)
