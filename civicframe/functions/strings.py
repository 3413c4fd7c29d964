"""Scalar string functions (X1-X14) as Spark column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from civicframe.functions.regex import java_regex


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def lower(col) -> Column:
    """X1."""
    return F.lower(_c(col))


# A word starts at a letter that follows anything but a letter or an
# apostrophe, so "homeowner's" keeps its lower-case "s" and
# "(white alone) family-owned" becomes "(White Alone) Family-Owned".
_WORD_START = r"(?<=[^\p{L}'])(?=\p{L})"


def title_case(col) -> Column:
    """R ``str_to_title``. ``initcap`` only splits on spaces, so split at
    each word start, capitalise each piece and glue them back."""
    pieces = F.split(F.lower(_c(col)), _WORD_START)
    return F.array_join(F.transform(pieces, lambda s: F.initcap(s)), "")


def squish(col) -> Column:
    """Collapse runs of white space to one space and trim the ends."""
    return F.trim(F.regexp_replace(_c(col), r"(?U)\s+", " "))


def detect(col, pattern: str) -> Column:
    """Pattern test (R ``str_detect``)."""
    return _c(col).rlike(java_regex(pattern))


def starts_with(col, prefix: str) -> Column:
    return _c(col).startswith(prefix)


def remove_all(col, pattern: str) -> Column:
    """Remove every match."""
    return F.regexp_replace(_c(col), java_regex(pattern), "")


def remove_first(col, pattern: str) -> Column:
    """Remove the first match only (R ``str_remove``)."""
    return F.regexp_replace(_c(col), "(?U)(?s)^(.*?)(?:" + java_regex(pattern, unicode=False) + ")", "$1")


def replace_all(col, pattern: str, replacement: str) -> Column:
    """X6."""
    return F.regexp_replace(_c(col), java_regex(pattern), replacement)


def replace_chain(col, pairs) -> Column:
    """Apply (pattern, replacement) pairs in order; each sees the
    result of the previous one (R ``str_replace_all(x, named_vector)``)."""
    return reduce(lambda acc, pr: F.regexp_replace(acc, java_regex(pr[0]), pr[1]), pairs, _c(col))


def extract_all(col, pattern: str) -> Column:
    """Every match as ``array<string>``."""
    return F.regexp_extract_all(_c(col), F.lit(java_regex(pattern)), 0)


def concat_ws_skip_null(sep: str, *cols) -> Column:
    """Join with a separator; nulls are skipped."""
    return F.concat_ws(sep, *[_c(c) for c in cols])


def text_length(col) -> Column:
    """X11: characters, not bytes."""
    return F.char_length(_c(col))


def thousands(col) -> Column:
    """``402,687``."""
    return F.format_number(_c(col), 0)


def to_number(col, type_: str = "double") -> Column:
    """Cast that yields null instead of failing."""
    return _c(col).try_cast(type_)


def row_mean(*cols) -> Column:
    """Row-wise mean; null if any input is null (R default)."""
    return reduce(lambda a, b: a + b, [_c(c) for c in cols]) / F.lit(len(cols))


def blank_to_null(col) -> Column:
    """empty string becomes null."""
    return F.nullif(_c(col), F.lit(""))
