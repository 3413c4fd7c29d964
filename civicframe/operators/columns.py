"""Projection, filter and column operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicframe.functions.regex import java_regex


def column_range(df: DataFrame, first: str, last: str) -> list[str]:
    """names from ``first`` to ``last`` inclusive, in table order (R ``A:B``)."""
    cols = df.columns
    i, j = cols.index(first), cols.index(last)
    return cols[i:j + 1]


def select_spec(df: DataFrame, *spec) -> DataFrame:
    """select by names, ``"A:B"`` ranges, ``"^prefix"`` / ``"suffix$"``
    patterns (kept in table order)."""
    out: list[str] = []
    for s in spec:
        if ":" in s and not s.startswith("^"):
            a, b = s.split(":", 1)
            names = column_range(df, a, b)
        elif s.startswith("^") or s.endswith("$"):
            import re
            rx = re.compile(s)
            names = [c for c in df.columns if rx.search(c)]
        else:
            names = [s]
        out += [n for n in names if n not in out]
    return df.select(*out)


def drop_matching(df: DataFrame, prefix: str | None = None, suffix: str | None = None) -> DataFrame:
    """``select(-starts_with(...))``."""
    gone = [c for c in df.columns if (prefix and c.startswith(prefix)) or (suffix and c.endswith(suffix))]
    return df.drop(*gone)


def rename_positional(df: DataFrame, names, positions=None) -> DataFrame:
    """rename columns by position, 1 for the first: those in
    ``positions``, or the first ``len(names)``."""
    names = list(names)
    at = list(positions) if positions is not None else list(range(1, len(names) + 1))
    if len(at) != len(names):
        raise ValueError("as many names as positions")
    new = dict(zip(at, names))
    return df.toDF(*[new.get(i, c) for i, c in enumerate(df.columns, 1)])


def relocate(df: DataFrame, first, after: str | None = None) -> DataFrame:
    """move columns to the front (or after ``after``)."""
    first = list(first)
    rest = [c for c in df.columns if c not in first]
    if after is None:
        return df.select(*first, *rest)
    i = rest.index(after) + 1
    return df.select(*rest[:i], *first, *rest[i:])


def across(df: DataFrame, fn, prefix: str | None = None, suffix: str | None = None, cols=None) -> DataFrame:
    """apply one column function to every matching column."""
    targets = list(cols) if cols else [c for c in df.columns
                                       if (prefix and c.startswith(prefix)) or (suffix and c.endswith(suffix))]
    return df.withColumns({c: fn(F.col(c)) for c in targets})


def not_in(col, values) -> Column:
    """R ``!(x %in% set)``: null ``x`` counts as not in the set (kept)."""
    c = F.col(col) if isinstance(col, str) else col
    return ~F.coalesce(c.isin(list(values)), F.lit(False))


def matches(col, pattern: str) -> Column:
    """pattern filter; null text is not a match."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.rlike(java_regex(pattern)), F.lit(False))


def if_else(cond: Column, yes, no, missing=None) -> Column:
    """dplyr ``if_else(cond, yes, no, missing)``: a null condition gives
    ``missing`` rather than ``no``."""
    yes = yes if isinstance(yes, Column) else F.lit(yes)
    no = no if isinstance(no, Column) else F.lit(no)
    out = F.when(cond, yes)
    if missing is not None:
        out = out.when(cond.isNull(), missing if isinstance(missing, Column) else F.lit(missing))
    else:
        out = out.when(cond.isNull(), F.lit(None))
    return out.otherwise(no)


def tag(df: DataFrame, name: str, value) -> DataFrame:
    """F8: constant column, e.g. ``dataset = "ACS1"``."""
    return df.withColumn(name, F.lit(value))


def blank_to_null(df: DataFrame, cols) -> DataFrame:
    """F9."""
    return df.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in cols})


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """F11."""
    return df.select(col).distinct()


def request_query(df: DataFrame, date_cols=(), lowered: bool = False, **equals) -> DataFrame:
    """keep rows where every given column equals its value: text
    case-insensitively, date columns on the day only. No arguments gives
    every row.

    ``lower()`` is not pushed into the Parquet scan (only ``IsNotNull`` is),
    so where pushdown matters store a lower-cased copy of the column and
    query that with ``lowered=True``: plain equality then reaches the scan.
    """
    cond = F.lit(True)
    types = {f.name: f.dataType.typeName() for f in df.schema.fields}
    for k, v in equals.items():
        if v is None:
            continue
        if k in date_cols and types.get(k) in ("timestamp", "timestamp_ntz"):
            # same day as a half-open range: a plain comparison the scan can prune on
            day = F.lit(v).cast(df.schema[k].dataType)
            cond = cond & (F.col(k) >= day) & (F.col(k) < F.timestamp_add("DAY", F.lit(1), day))
        elif k in date_cols and types.get(k) == "string":
            # ISO text starts with the day: a prefix test, which the scan can prune on
            cond = cond & F.col(k).startswith(str(v)[:10])
        elif k in date_cols:
            cond = cond & (F.to_date(F.col(k)) == F.to_date(F.lit(v)))
        elif isinstance(v, str) and lowered:
            cond = cond & (F.col(k) == F.lit(v.lower()))
        elif isinstance(v, str):
            cond = cond & (F.lower(F.col(k)) == F.lit(v.lower()))
        else:
            cond = cond & (F.col(k) == F.lit(v))
    return df.where(cond)


def label_by_position(df: DataFrame, key_col: str, labels, out: str, start: int = 1) -> DataFrame:
    """R's ``mutate(year = years[i])`` written as a join on the key the
    list position stands for (never on row position, which Spark does not
    keep). The label list is short and broadcast."""
    spark = df.sparkSession
    lk = spark.createDataFrame([(i, v) for i, v in enumerate(labels, start)], f"_pos long, {out} string")
    return df.join(F.broadcast(lk), F.col(key_col).cast("long") == F.col("_pos"), "left").drop("_pos")
