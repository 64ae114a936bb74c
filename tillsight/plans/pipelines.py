"""Cleaning pipelines (C13-C15): compositions of the cleaning operators.

Order matters and follows each copy of the reference: filters never move above
the fill, because a filled value can come from a row the filter would drop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.functions import expressions as X
from tillsight.operators import clean
from tillsight.session import materialize


def _parse_and_parts(df: DataFrame, date_col: str, month_year: bool) -> DataFrame:
    out = df if dict(df.dtypes)[date_col].startswith("timestamp") else \
        df.withColumn(date_col, X.parse_date(date_col))
    cols = {"day": X.day_name(date_col)}
    if month_year:
        cols["month"] = X.month_name(date_col)
        cols["year"] = F.year(date_col)
    return out.withColumns(cols)


def _hour(df: DataFrame, time_col: str) -> DataFrame:
    if time_col in df.columns:
        return df.withColumn("hour", X.hour_of_time(time_col))
    return df


def clean_basic(df: DataFrame, order_cols, date_col="date", time_col="time") -> DataFrame:
    """Dedupe -> forward fill -> parse date -> day name -> hour."""
    order_cols = list(order_cols)
    # One shuffle into ranges serves both: equal rows are neighbours there.
    d = clean.dedupe(clean.by_ranges(df, order_cols), ranged=True)
    d = clean.forward_fill(d, order_cols, cols=d.columns, ranged=True)
    d = _parse_and_parts(d, date_col, month_year=False)
    return _hour(d, time_col)


def clean_prepare(df: DataFrame, order_cols, date_col="date", time_col="time") -> DataFrame:
    """C14: C13 with month and year, plus average item price."""
    order_cols = list(order_cols)
    # One shuffle into ranges serves both: equal rows are neighbours there.
    d = clean.dedupe(clean.by_ranges(df, order_cols), ranged=True)
    d = clean.forward_fill(d, order_cols, cols=d.columns, ranged=True)
    d = _parse_and_parts(d, date_col, month_year=True)
    d = _hour(d, time_col)
    return d.withColumn("avg_item_price", X.avg_item_price())


def process_sales(df: DataFrame, date_col="date", time_col="time", accuracy: int = 100000,
                  keys=("invoice_id", "customer_id")) -> DataFrame:
    """Dedupe -> parse date -> parts -> hour -> median / mode impute -> profit.

    The derived year and hour are imputed too, as in the copy this follows,
    because the parts are added before imputation. Numeric ``keys`` get no median; text
    columns, keys among them, take their most frequent value, as in that copy.
    """
    d = clean.dedupe(df)
    d = _parse_and_parts(d, date_col, month_year=True)
    d = _hour(d, time_col)
    # Both imputers and the final projection read the parsed rows.
    d = materialize(d)
    d = clean.impute_median(d, clean.numeric_columns(d, exclude=keys), accuracy=accuracy)
    d = clean.impute_mode(d)
    p = X.profit()
    return d.withColumns({"profit": p, "profit_margin": X.profit_margin(p)})
