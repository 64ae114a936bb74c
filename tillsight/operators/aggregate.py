"""Aggregations.

Every grouping drops NULL keys first (pandas ``groupby`` semantics, T1) and
sums of an all-NULL group are 0 (T2). All of them are hash aggregates with a
map-side partial step, so low-cardinality keys (a handful of categories) never
concentrate rows in one task: each task ships one partial row per key.
Dense grids (weekday x hour, weeks, hours) are built from ``range`` /
``sequence`` spines and left-joined, never from a pair-producing join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillsight.functions import expressions as X
from tillsight.operators.stats import attach_scalars, exact_quantiles
from tillsight.session import materialize


def _sum0(c) -> F.Column:
    return F.coalesce(F.sum(c), F.lit(0.0))


def sum_by(df: DataFrame, key, value: str = "total", alias: str = "sales",
           sort_desc: bool = False) -> DataFrame:
    """Generic Σ value per key (A1-A5, A11 shape)."""
    keys = [key] if isinstance(key, str) else list(key)
    cond = None
    for k in keys:
        c = F.col(k).isNotNull()
        cond = c if cond is None else cond & c
    out = df.where(cond).groupBy(*keys).agg(_sum0(value).alias(alias))
    return out.orderBy(F.desc(alias), *keys) if sort_desc else out


def sales_by_category(df, value="total", key="product_line", sort_desc=True):
    """A1."""
    return sum_by(df, key, value, "sales", sort_desc)


def sales_by_payment(df, value="total", key="payment"):
    """A2."""
    return sum_by(df, key, value, "sales", True)


def sales_by_gender(df, value="total", key="gender"):
    """A3."""
    return sum_by(df, key, value, "sales", False)


def sales_by_customer_type(df, value="total", key="customer_type"):
    """A4."""
    return sum_by(df, key, value, "sales", False)


def daily_sales(df, date_col="date", value="total"):
    """A5: Σ per calendar date."""
    d = df.where(F.col(date_col).isNotNull()).withColumn("day", F.to_date(date_col))
    return d.groupBy("day").agg(_sum0(value).alias("sales"))


def hourly_sales(df, hour_col="hour", value="total"):
    """Σ per hour."""
    return sum_by(df, hour_col, value, "sales")


def weekday_sales(df, date_col="date", value="total"):
    """Σ per weekday, Monday = 0 first."""
    d = df.where(F.col(date_col).isNotNull())
    return (d.groupBy(X.weekday_index(date_col).alias("weekday"), X.day_name(date_col).alias("day"))
             .agg(_sum0(value).alias("sales")).orderBy("weekday"))


def day_hour_sales(df, date_col="date", hour_col="hour", value="total"):
    """Σ per (weekday, hour), only cells that occur."""
    d = df.where(F.col(date_col).isNotNull() & F.col(hour_col).isNotNull())
    return d.groupBy(X.weekday_index(date_col).alias("weekday"), X.day_name(date_col).alias("day"),
                     F.col(hour_col).cast("int").alias("hour")).agg(_sum0(value).alias("sales"))


def weekday_hour_spine(spark) -> DataFrame:
    """168 (weekday, hour) cells from one ``range``; Monday = 0."""
    r = spark.range(7 * X.HOURS_PER_DAY)
    names = F.array(*[F.lit(n) for n in X.WEEKDAYS])
    return r.select((F.col("id") / X.HOURS_PER_DAY).cast("int").alias("weekday"),
                    (F.col("id") % X.HOURS_PER_DAY).cast("int").alias("hour")) \
            .withColumn("day", F.element_at(names, F.col("weekday") + 1))


def sales_heatmap(df, date_col="date", hour_col="hour", value="total"):
    """A8 on the dense 7x24 grid, missing cells 0 (168 rows, broadcast side)."""
    cells = day_hour_sales(df, date_col, hour_col, value).drop("day")
    spine = weekday_hour_spine(df.sparkSession)
    return (spine.join(cells, ["weekday", "hour"], "left")
                 .select("weekday", "day", "hour", F.coalesce("sales", F.lit(0.0)).alias("sales")))


def avg_price_by_category(df, key="product_line", price="unit_price"):
    """A10: mean unit price per category."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.avg(price).alias("avg_price"))


def quantity_by_category(df, key="product_line", qty="quantity"):
    """Σ quantity per category."""
    return (df.where(F.col(key).isNotNull()).groupBy(key)
              .agg(F.coalesce(F.sum(qty), F.lit(0)).cast("long").alias("quantity")))


def payment_counts(df, key="payment"):
    """Rows per payment method and its share of all rows."""
    g = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    tot = g.agg(F.sum("n").alias("_all"))
    return (attach_scalars(g, tot)
            .select(key, "n", (F.col("n") * 100.0 / F.col("_all")).alias("share_pct")))


def kpi_summary(df, value="total", invoice="invoice_id", qty="quantity"):
    """Total sales, distinct invoices, sales per invoice, items (exact, all rows)."""
    one = df.agg(_sum0(value).alias("total_sales"),
                 F.count_distinct(invoice).alias("invoices"),
                 F.coalesce(F.sum(qty), F.lit(0)).cast("long").alias("items"))
    return one.select("total_sales", "invoices",
                      F.try_divide(F.col("total_sales"), F.col("invoices")).alias("sales_per_invoice"),
                      "items")


def describe_numeric(df, cols, accuracy: int = 100000, approx: bool = False):
    """Pandas ``describe`` per numeric column as rows.

    count, mean, sample std, min, 25/50/75 % (exact, linear interpolation), max.
    ``approx`` answers the quartiles from the sketch alone (rank error at most
    1/accuracy of the rows, one pass, no value-count table).
    """
    if approx:
        from tillsight.operators.stats import long_values
        lv = long_values(df, cols)
        qs = F.percentile_approx("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), accuracy)
        return lv.groupBy("column").agg(
            F.count(F.lit(1)).alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
            F.min("v").alias("min"), qs.alias("_q"), F.max("v").alias("max")).select(
            "column", "count", "mean", "std", "min", F.col("_q")[0].alias("p25"), F.col("_q")[1].alias("p50"),
            F.col("_q")[2].alias("p75"), "max")
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75], accuracy=accuracy)
    return q.groupBy("column").agg(
        F.first("n").alias("count"), F.first("mean").alias("mean"), F.first("std").alias("std"),
        F.first("min").alias("min"),
        *[F.max(F.when(F.col("p") == p, F.col("value"))).alias(n)
          for p, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))],
        F.first("max").alias("max"))


def customer_features(df, key="customer_id", date_col="date", value="total", qty="quantity"):
    """Per entity first/last date, purchases, Σ/mean total and quantity."""
    return (df.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.min(date_col).alias("first_date"), F.max(date_col).alias("last_date"),
        F.count(date_col).alias("purchases"),
        _sum0(value).alias("total_sum"), F.avg(value).alias("total_mean"),
        F.coalesce(F.sum(qty), F.lit(0)).cast("long").alias("quantity_sum"),
        F.avg(qty).alias("quantity_mean")))


def weekly_sales(df, date_col="date", value="total"):
    """Σ per week ending Sunday; weeks without sales inside the span are 0.

    Each week with sales also gives the empty weeks up to the next one (a window
    over one row per week), so the input is read once.
    """
    d = df.where(F.col(date_col).isNotNull()).withColumn("week", X.week_end_sunday(date_col))
    sums = d.groupBy("week").agg(_sum0(value).alias("sales"))
    following = F.lead("week").over(Window.orderBy("week")).cast("date")
    until = F.coalesce(F.date_sub(following, 7), F.col("week").cast("date")).cast(sums.schema["week"].dataType)
    sums = sums.withColumn("until", until)
    weeks = F.explode(F.sequence("week", "until", F.expr("interval 7 days"))).alias("w")
    return sums.select("week", "sales", weeks).select(
        F.col("w").alias("week"), F.when(F.col("w") == F.col("week"), F.col("sales")).otherwise(F.lit(0.0)).alias("sales"))


def weekly_category_pivot(df, keys_df, date_col="date", key="product_line", value="total", names=None):
    """Σ per (Monday week, category) for the categories in ``keys_df``, 0 filled.

    The grid comes as rows: sums of the chosen categories (semi join), joined to
    the product of the weeks and categories that occur. With an explicit list of
    ``names`` the sums of those categories come as columns instead.
    """
    rows = df.where(F.col(date_col).isNotNull()).withColumn("week", X.week_start_monday(date_col))
    if names is not None:
        return rows.where(F.col(key).isin(list(names))).groupBy("week").pivot(key, list(names)).agg(F.sum(value)).fillna(
            0.0, subset=list(names))
    chosen = keys_df.select(key).where(F.col(key).isNotNull()).distinct()
    sums = materialize(rows.join(chosen, key, "left_semi").groupBy("week", key).agg(_sum0(value).alias("sales")))
    weeks = sums.agg(F.array_sort(F.collect_set("week")).alias("_weeks"))  # one row, one entry per week
    grid = attach_scalars(sums.select(key).distinct(), weeks).select(key, F.explode("_weeks").alias("week"))
    return grid.join(sums, ["week", key], "left").select("week", key, F.coalesce("sales", F.lit(0.0)).alias("sales"))


def peak_day_hours(df, which="busiest", date_col="date", hour_col="hour", value="total"):
    """Hour profile 0-23, missing 0, of the weekday with the busiest (or slowest) cell.

    The profile is read off the 168 cells that also decide the weekday, so the
    input is read once. NULL hours count as hour 0, as in peak finding.
    """
    cells = day_hour_sales(df.withColumn(hour_col, F.coalesce(F.col(hour_col).cast("int"), F.lit(0))),
                           date_col, hour_col, value)
    order = [F.desc("sales") if which == "busiest" else F.asc("sales"), "weekday", "hour"]
    first = F.first("weekday").over(Window.orderBy(*order))  # at most 168 rows
    day = cells.withColumn("_first", first).where("weekday = _first")
    profile = day.groupBy("weekday").agg(F.map_from_entries(F.collect_list(F.struct("hour", "sales"))).alias("_m"))
    hours = F.explode(F.sequence(F.lit(0), F.lit(X.HOURS_PER_DAY - 1))).alias("hour")
    return profile.select("weekday", "_m", hours).select(
        "weekday", "hour", F.coalesce(F.try_element_at("_m", F.col("hour")), F.lit(0.0)).alias("sales"))


def count_by(df, keys, alias="n"):
    """Rows per key combination (NULL keys dropped)."""
    keys = list(keys)
    cond = None
    for k in keys:
        c = F.col(k).isNotNull()
        cond = c if cond is None else cond & c
    return df.where(cond).groupBy(*keys).agg(F.count(F.lit(1)).alias(alias))


def box_stats(df, group="cluster", value="total", accuracy: int = 100000):
    """Five-number summary per group plus 1.5 IQR whisker ends.

    Quartiles are exact; whiskers are the most extreme values inside the
    fences, found by joining the (#groups-row) fence table back and aggregating.
    """
    v = F.col(value).cast("double")
    # Quartiles and whiskers both read (group, value): evaluate the input once.
    rows = materialize(df.where(F.col(group).isNotNull() & v.isNotNull()).select(group, v.alias("v")))
    q = exact_quantiles(rows, ["v"], [0.25, 0.5, 0.75], group_cols=[group], accuracy=accuracy)
    qw = q.groupBy(group).agg(*[F.max(F.when(F.col("p") == p, F.col("value"))).alias(n)
                                for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])
    fences = qw.select("*", (F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).alias("lo_fence"),
                       (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("hi_fence"))
    ext = (rows.join(fences.select(group, "lo_fence", "hi_fence"), group, "inner")
               .groupBy(group).agg(
                   F.min("v").alias("min"), F.max("v").alias("max"),
                   F.min(F.when(F.col("v") >= F.col("lo_fence"), F.col("v"))).alias("lower_whisker"),
                   F.max(F.when(F.col("v") <= F.col("hi_fence"), F.col("v"))).alias("upper_whisker"),
                   F.count_if((F.col("v") < F.col("lo_fence")) | (F.col("v") > F.col("hi_fence")))
                    .alias("outliers")))
    return qw.join(ext, group, "inner").select(group, "min", "q1", "median", "q3", "max",
                                               "lower_whisker", "upper_whisker", "outliers")


def probability_histogram(df, p="probability", bins: int = 20):
    """Rows per equal-width bin on [0, 1]; p = 1 falls in the last bin."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return (df.where(F.col(p).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
              .select("bin", (F.col("bin") / bins).alias("bin_start"),
                      ((F.col("bin") + 1) / bins).alias("bin_end"), "n"))


def churn_distribution(df, label="churn"):
    """Rows per churn class, labelled Retained / Churned."""
    return (df.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("int").alias("churn"))
              .agg(F.count(F.lit(1)).alias("n")).withColumn("status", X.churn_text("churn")))


def has_time_of_day(df, date_col="date"):
    """More than one distinct time of day among the timestamps?"""
    return df.agg((F.count_distinct(F.date_format(date_col, "HH:mm:ss")) > 1).alias("has_time"))
