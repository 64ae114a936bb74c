"""Filters and lookups.

All predicates are plain Column expressions folded into one ``where`` so
Catalyst can push them into the parquet scan (or below the joins of the sales
view) and prune row groups by their min/max statistics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALL = "All"


def _no_filter(value, empty_is_all: bool) -> bool:
    return value is None or value == ALL or (empty_is_all and value == "")


def equals_filter(df: DataFrame, column: str, value, empty_is_all: bool = False) -> DataFrame:
    """``column = value``; ``'All'``, None or a missing column = no filter."""
    if column not in df.columns or _no_filter(value, empty_is_all):
        return df
    return df.where(F.col(column) == F.lit(value))


def filter_category(df, value, column="product_line", empty_is_all=False):
    return equals_filter(df, column, value, empty_is_all)


def filter_customer_type(df, value, column="customer_type", empty_is_all=False):
    return equals_filter(df, column, value, empty_is_all)


def filter_gender(df, value, column="gender", empty_is_all=False):
    return equals_filter(df, column, value, empty_is_all)


def date_range_predicate(date_col: str, start=None, end=None, whole_days: bool = False) -> Column:
    """Start <= date <= end. ``whole_days`` compares the date part, so the
    last day is complete; otherwise ``end`` is midnight and later times drop.
    NULL dates never pass."""
    d = F.to_date(F.col(date_col)) if whole_days else F.col(date_col)
    conv = (lambda v: F.to_date(F.lit(v))) if whole_days else (lambda v: F.to_timestamp(F.lit(v)))
    p = F.col(date_col).isNotNull()
    if start is not None:
        p = p & (d >= conv(start))
    if end is not None:
        p = p & (d <= conv(end))
    return p


def filter_date_range(df, start=None, end=None, date_col="date"):
    return df.where(date_range_predicate(date_col, start, end, whole_days=False))


def filter_date_range_days(df, start=None, end=None, date_col="date"):
    return df.where(date_range_predicate(date_col, start, end, whole_days=True))


def filter_predicate(df: DataFrame, category=None, customer_type=None, gender=None,
                     start=None, end=None, date_col="date", empty_is_all=False,
                     whole_days=False) -> F.Column:
    """All filters as one conjunctive predicate; true if there are none."""
    hit = F.lit(True)
    for column, value in (("product_line", category), ("customer_type", customer_type),
                          ("gender", gender)):
        if column in df.columns and not _no_filter(value, empty_is_all):
            hit = hit & (F.col(column) == F.lit(value))
    if (start is not None or end is not None) and date_col in df.columns:
        hit = hit & date_range_predicate(date_col, start, end, whole_days)
    return hit


def filter_compose(df: DataFrame, category=None, customer_type=None, gender=None,
                   start=None, end=None, **options) -> DataFrame:
    """the rows that pass all filters."""
    return df.where(filter_predicate(df, category, customer_type, gender, start, end, **options))


def filter_count(df: DataFrame, **filters) -> DataFrame:
    """F6, count: matching rows beside all rows, from one pass over the input."""
    hit = filter_predicate(df, **filters)
    return df.agg(F.count_if(hit).alias("matching"), F.count(F.lit(1)).alias("all_rows"))


def filter_isin(df: DataFrame, keys: DataFrame, column: str, key_col: str | None = None) -> DataFrame:
    """keep rows whose ``column`` is in the ``keys`` frame (semi join).

    No broadcast hint: a top-k key frame measures tiny and AQE broadcasts it;
    a large key frame gets a shuffled semi join instead of an unbounded
    broadcast."""
    k = keys.select(F.col(key_col or column).alias(column)).distinct()
    return df.join(k, column, "left_semi")


def filter_values(df: DataFrame, column: str) -> DataFrame:
    """F8: sorted distinct non-null values of one column."""
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def date_bounds(df: DataFrame, date_col: str = "date") -> DataFrame:
    """min and max date."""
    return df.agg(F.min(date_col).alias("min_date"), F.max(date_col).alias("max_date"))
