"""Windows, ranking, top-k and limits.

Windows here only run over small aggregates (categories, weeks, 168 grid cells)
or are partitioned; no unpartitioned window ever sees raw rows. Ties are broken
by an explicit key so results do not depend on partitioning (T9).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillsight.functions import expressions as X
from tillsight.operators import aggregate as A
from tillsight.session import materialize


def week_over_week(df, date_col="date", value="total") -> DataFrame:
    """% change of each Sunday-ending week vs the previous one; last week flagged.

    The weekly series has one row per week (a few hundred per decade), so the
    lag window over it is tiny.
    """
    wk = A.weekly_sales(df, date_col, value)
    w = Window.orderBy("week")
    return (wk.withColumn("prev_sales", F.lag("sales").over(w))
              .withColumn("pct_change", X.pct_change("sales", "prev_sales"))
              .withColumn("is_last", F.row_number().over(Window.orderBy(F.desc("week"))) == 1))


def top_bottom_products(df, n: int = 3, key="product_line", value="total") -> DataFrame:
    """Top-n and bottom-n categories by Σ value (ties: name ascending).

    Returns (which, rank, key, sales). Ranking runs over the per-category sums.
    """
    sums = A.sum_by(df, key, value, "sales")
    # Distributed top-k (each task keeps k rows, then k x tasks are merged);
    # the rank window afterwards only sees the k survivors.
    top_order, bot_order = [F.desc("sales"), F.col(key)], [F.asc("sales"), F.col(key)]
    top = sums.orderBy(*top_order).limit(n)
    bot = sums.orderBy(*bot_order).limit(n)
    top = top.withColumn("rank", F.row_number().over(Window.orderBy(*top_order)))
    bot = bot.withColumn("rank", F.row_number().over(Window.orderBy(*bot_order)))
    return (top.withColumn("which", F.lit("top"))
               .unionByName(bot.withColumn("which", F.lit("bottom")))
               .select("which", "rank", key, "sales"))


def peak_periods(df, date_col="date", hour_col="hour", value="total") -> DataFrame:
    """Busiest and slowest (weekday, hour) cell; ties go to the earliest cell.

    NULL hours count as hour 0 (C8 rule of the peak finder)."""
    d = df.withColumn(hour_col, F.coalesce(F.col(hour_col).cast("int"), F.lit(0)))
    cells = A.day_hour_sales(d, date_col, hour_col, value)
    hi = F.row_number().over(Window.orderBy(F.desc("sales"), "weekday", "hour"))
    lo = F.row_number().over(Window.orderBy(F.asc("sales"), "weekday", "hour"))
    c = cells.withColumn("_hi", hi).withColumn("_lo", lo)
    return (c.where("_hi = 1").withColumn("which", F.lit("busiest"))
             .unionByName(c.where("_lo = 1").withColumn("which", F.lit("slowest")))
             .select("which", "weekday", "day", "hour", "sales"))


def top_products_share(df, k: int = 5, key="product_line", value="total", qty="quantity") -> DataFrame:
    """Top-k categories with sales, quantity and % of all sales."""
    # The total and the top-k both read the sums: written once, the input is read once.
    g = materialize(df.where(F.col(key).isNotNull()).groupBy(key)
                      .agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("sales"),
                           F.coalesce(F.sum(qty), F.lit(0)).cast("long").alias("quantity")))
    tot = g.agg(F.sum("sales").alias("_all"))
    order = [F.desc("sales"), F.col(key)]
    top = g.orderBy(*order).limit(k)  # distributed top-k
    ranked = (top.join(F.broadcast(tot), on=F.lit(True))
                 .withColumn("share_pct", F.try_divide(F.col("sales") * 100.0, F.col("_all")))
                 .withColumn("rank", F.row_number().over(Window.orderBy(*order))))
    return ranked.select("rank", key, "sales", "quantity", "share_pct")


def head_n(df, n: int, order) -> DataFrame:
    """First n rows under an explicit order (top-k: each task keeps n rows)."""
    return df.orderBy(*order).limit(n)


#: Rows up to which a page is a top-k of the whole input; deeper pages go by an index.
SHALLOW = 10_000


@dataclass(frozen=True)
class PageIndex:
    """Rows dealt by range of an order, and the number of rows per range with those before it."""

    rows: DataFrame  # the input's columns and _range, a folder per range
    ranges: DataFrame  # (_range, n, before)
    total: int
    order: tuple


def page_index(df, order) -> PageIndex:
    """Write ``df`` by ranges of ``order`` once, so that any page reads a range or two.

    Spark samples the bounds; columns that ``order`` leaves out break its ties, so that
    a value of a third of all rows spans as many ranges as it needs. The number of ranges
    is the session's shuffle setting. The counts are a row per range; an empty input has
    no ranges.
    """
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    ties = [F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    dealt = df.repartitionByRange(*order, *ties).withColumn("_range", F.spark_partition_id())
    rows = materialize(dealt, partition_by="_range")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = materialize(rows.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
                             .withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))))
    total = ranges.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return PageIndex(rows, ranges, total, (*order, *ties))


def page_at(index: PageIndex, page_no: int, size: int, with_pages: bool = True) -> DataFrame:
    """Page ``page_no`` (1-based) of an index: only the ranges that hold its rows are read and ordered.

    A page past the end has no rows.
    """
    first = (page_no - 1) * size
    held = index.ranges.where((F.col("before") < first + size) & (F.col("before") + F.col("n") > first))
    held = held.orderBy("_range").collect()  # at most as many as the page has rows
    rows = index.rows.where(F.col("_range").isin([r["_range"] for r in held])) if held else index.rows.where(F.lit(False))
    skip = first - held[0]["before"] if held else 0
    rows = rows.orderBy(*index.order).offset(skip).limit(size).drop("_range")
    return rows.withColumn("pages", F.lit(-(-index.total // size)).cast("long")) if with_pages else rows


def page(df, page_no: int, size: int, order, with_pages: bool = True) -> DataFrame:
    """Page ``page_no`` (1-based) of ``size`` rows, plus the page count if asked for.

    A page within the first ``SHALLOW`` rows is a top-k (each task keeps that many rows).
    A deeper one goes by a ``page_index``, which callers with many pages keep and ask by
    ``page_at``; walking forward by unique keys is for ``page_after``.
    """
    if page_no * size > SHALLOW:
        return page_at(page_index(df, order), page_no, size, with_pages)
    rows = df.orderBy(*order).offset((page_no - 1) * size).limit(size)
    if not with_pages:
        return rows
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    return rows.join(F.broadcast(total.select(F.ceil(F.col("_n") / size).cast("long").alias("pages"))),
                     on=F.lit(True))


def page_after(df, size: int, keys, last_seen=None) -> DataFrame:
    """W7, keyset form: the ``size`` rows that follow ``last_seen`` in order of ``keys``.

    ``last_seen`` holds the keys of the page before's last row (None: first
    page). The predicate reaches the scan and each task keeps ``size`` rows,
    however deep the page. The keys must be unique and not null.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    if last_seen is not None:
        seen = list(last_seen) if isinstance(last_seen, (list, tuple)) else [last_seen]
        later, equal = F.lit(False), F.lit(True)
        for k, v in zip(keys, seen):
            later = later | (equal & (F.col(k) > F.lit(v)))
            equal = equal & (F.col(k) == F.lit(v))
        df = df.where((F.col(keys[0]) >= F.lit(seen[0])) & later)
    return df.orderBy(*keys).limit(size)


def last_n(df, n: int, order_col="ds") -> DataFrame:
    """Last n rows of a series (a top-k by descending order)."""
    return df.orderBy(F.desc(order_col)).limit(n)
