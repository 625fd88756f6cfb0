"""Text expressions. All run JVM-side inside code generation; none uses Python rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F

SPACES = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
ACCENTED = "ÁÀÄÂÉÈËÊÍÌÏÎÓÒÖÔÚÙÜÛáàäâéèëêíìïîóòöôúùüû"
PLAIN = "AAAAEEEEIIIIOOOOUUUUaaaaeeeeiiiioooouuuu"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates `value` once per row and uses it many times in `body`. Spark shares common subexpressions only
    outside conditional branches, so a regex or JSON path named in several branches would otherwise run in each."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _literal(value) -> str:
    return str(value) if isinstance(value, int) else "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def constant_map(table: dict) -> Column:
    """A look-up table as one constant expression."""
    return F.expr("map(" + ", ".join(f"{_literal(k)}, {_literal(v)}" for k, v in table.items()) + ")")


def constant_array(values: list) -> Column:
    return F.expr("array(" + ", ".join(_literal(v) for v in values) + ")")


def strip(c: Column) -> Column:
    """Trim every Unicode space, not only the blank."""
    return F.btrim(c, F.lit(SPACES))


def normspace(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def blank_to_null(c: Column) -> Column:
    return let(c, lambda x: F.when(x != "", x))


def first_filled(*cols: Column) -> Column:
    """`a or b or c`: the first value that is neither null nor empty."""
    return F.coalesce(*[blank_to_null(c) for c in cols])


def truncate(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def unaccent(c: Column) -> Column:
    return F.translate(c, ACCENTED, PLAIN)


def grab(c: Column, pattern: str, group: int = 1) -> Column:
    """One group of the first match, null when the pattern is absent (or the group empty)."""
    return blank_to_null(F.regexp_extract(c, pattern, group))


def grab_first(c: Column, patterns: list[str], group: int = 1) -> Column:
    return F.coalesce(*[grab(c, p, group) for p in patterns])


def grab_hinted(c: Column, patterns: dict[str, str], group: int = 1) -> Column:
    """Like grab_first for patterns given with a piece of text each of their matches holds. The regex only runs where
    that text occurs, which a plain byte search finds out much faster."""
    return F.coalesce(*[F.when(c.contains(hint), grab(c, p, group)) for p, hint in patterns.items()])


def matches_all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def contains_any(c: Column, words: list[str]) -> Column:
    return let(c, lambda x: reduce(lambda a, b: a | b, [x.contains(w) for w in words]))


def title_case(c: Column) -> Column:
    """Capital after every non-letter. initcap only looks at blanks, so a marker blank is put in and taken out."""
    marked = F.regexp_replace(c, r"([^\p{L}\s])(?=\p{L})", "$1\u0001 ")
    return F.replace(F.initcap(marked), F.lit("\u0001 "), F.lit(""))


def capitalise_words(c: Column) -> Column:
    """Whitespace-separated words, each with one leading capital, joined by one blank."""
    return F.initcap(normspace(c))


def is_upper(c: Column) -> Column:
    """At least one cased letter and no lower-case one."""
    return let(c, lambda x: (x == F.upper(x)) & (x != F.lower(x)))


def like_pattern(text: str) -> str:
    return f"%{text}%"
