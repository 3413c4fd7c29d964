"""Sort, limit, paging, union."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicframe.operators.joins import stack_tables


def sort_r(df: DataFrame, *keys) -> DataFrame:
    """O1: R ``arrange``: ``"-col"`` for descending; missing values last in
    both directions."""
    cols = [F.desc_nulls_last(k[1:]) if k.startswith("-") else F.asc_nulls_last(k) for k in keys]
    return df.orderBy(*cols)


def head(df: DataFrame, n: int, *keys) -> DataFrame:
    """O2: first n rows of a fully ordered table (a top-k: Spark keeps n rows
    per task, then merges)."""
    return sort_r(df, *keys).limit(n)


def newest(df: DataFrame, n: int, date_col: str, tie_col: str) -> DataFrame:
    """O3: newest n items."""
    return sort_r(df, f"-{date_col}", tie_col).limit(n)


def having_category(df: DataFrame, cats_col: str, category: str) -> DataFrame:
    """O3: items whose multi-valued field holds the category."""
    return df.where(F.array_contains(F.col(cats_col), category))


def category_counts(df: DataFrame, cats_col: str, out: str = "n") -> DataFrame:
    """O3: items per category of a multi-valued field."""
    return df.select(F.explode(F.array_distinct(F.col(cats_col))).alias("category")) \
        .groupBy("category").agg(F.count(F.lit(1)).alias(out))


def page(df: DataFrame, page_no: int, *keys, size: int = 12) -> DataFrame:
    """One page of a sorted table (1-based page number)."""
    return sort_r(df, *keys).offset((page_no - 1) * size).limit(size)


def union_by_name(*frames) -> DataFrame:
    """O5."""
    return stack_tables(frames)
