"""Insight rules (R1-R15): small tables of findings computed from aggregates.

Every rule reads an aggregate that is already small (a forecast frame with one
row per day, per-cluster means, a correlation pair list) and emits rows with
the numbers that drive the rule, a ``kind`` (success / info / warning / alert)
and a text built with ``format_string``. No rule collects data to the driver.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillsight.functions import expressions as X
from tillsight.operators import correlate as CR
from tillsight.operators import ranking as R
from tillsight.operators.clean import hour_column, numeric_columns
from tillsight.operators.stats import attach_scalars
from tillsight.session import materialize

# Rule thresholds.
TREND_UP_STRONG, TREND_DOWN_STRONG = 10.0, -10.0
VOLATILITY_HIGH, VOLATILITY_STABLE = 20.0, 10.0
SEGMENT_HIGH, SEGMENT_LOW = 1.2, 0.8
FIXED_HIGH_TOTAL, FIXED_BULK_QTY, FIXED_LOW_TOTAL = 100.0, 5.0, 50.0
CHURN_ALERT_RATE = 0.3
WOW_NOTABLE = 5.0

# The feature that explains churn best -> code of the advice.
CHURN_FEATURE_CODES = [
    ("days_since_last", "win_back"), ("avg_purchase_value", "value_segments"),
    ("total", "spending_tiers"), ("quantity", "volume_offers"),
]
#: Own wording per code of R13.
CHURN_TEXTS = {
    "churn_alert": "More customers have lapsed than the alert level allows.",
    "win_back": "Customers mostly lapse by staying away; write to those whose last visit is some weeks old.",
    "value_segments": "What a customer spends per visit tells lapsing ones apart; treat the spending levels differently.",
    "spending_tiers": "Lifetime spend tells lapsing customers apart; let benefits grow with it.",
    "volume_offers": "How much customers buy tells lapsing ones apart; make larger baskets cheaper per item.",
    "feedback": "Survey customers at intervals, so that reasons for leaving are known early.",
}

# Mark in a suggestion -> (symbol, colour) of its card, tried in this order.
MARKS = [
    ("⭐", "star", "warning"), ("⚠️", "exclamation-triangle", "danger"), ("📈", "chart-line", "success"),
    ("📉", "chart-line", "danger"), ("⏱️", "clock", "info"), ("🐢", "hourglass-half", "secondary"),
    ("🔗", "link", "primary"), ("🎯", "bullseye", "danger"), ("🛒", "shopping-cart", "success"),
    ("📊", "chart-bar", "primary"),
]
UNMARKED = ("lightbulb", "warning")
NO_TEXT = ("info-circle", "info")

#: Code -> (mark, own wording; %s is the subject, %.f the number).
SUGGESTIONS = {
    "top_categories": ("⭐", "Best sellers are %s; give them more room."),
    "low_categories": ("⚠️", "Weakest sellers are %s; try a price or display change."),
    "sales_up": ("📈", "The last week sold %.1f%% more than the one before."),
    "sales_down": ("📉", "The last week sold %.1f%% less than the one before."),
    "busiest": ("⏱️", "Most is sold on %s; plan shifts around it."),
    "slowest": ("🐢", "Least is sold on %s; a good time for offers."),
    "no_periods": ("ℹ️", "There are no dated sales to find busy and slow times in."),
    "correlation": ("🔗", "%s move together (r = %.2f)."),
    "no_correlation": ("ℹ️", "No two numeric columns move together noticeably."),
    "few_numbers": ("ℹ️", "Fewer than two numeric columns vary, so none can be compared."),
    "cluster_spends": ("🎯", "Cluster %s spends well above average (%.0f a sale); offer it a loyalty tier."),
    "cluster_small": ("🛒", "Cluster %s buys few items at a time (%.1f); offer it sets."),
    "forecast_low": ("📊", "On %s sales are expected below %.0f."),
}


def forecast_change(joined: DataFrame) -> DataFrame:
    """(last yhat - last actual) / last actual, classified."""
    one = joined.agg(
        F.max(F.when(F.col("y").isNotNull(), F.struct("ds", "y"))).getField("y").alias("last_actual"),
        F.max(F.struct("ds", "yhat")).getField("yhat").alias("last_forecast"))
    pct = X.pct_change("last_forecast", "last_actual")
    return one.select("last_actual", "last_forecast", pct.alias("pct_change"),
                      X.trend_class(pct).alias("trend"))


def _last_n(joined: DataFrame, n: int) -> DataFrame:
    return joined.orderBy(F.desc("ds")).limit(n)


def forecast_vs_history(joined: DataFrame, n: int = 30) -> DataFrame:
    """R2: mean yhat of the last n days vs mean of the positive actuals."""
    hist = joined.agg(F.avg(F.when(F.col("y") > 0, F.col("y"))).alias("hist_mean"))
    fut = _last_n(joined, n).agg(F.avg("yhat").alias("forecast_mean"))
    one = attach_scalars(fut, hist)
    pct = X.pct_change("forecast_mean", "hist_mean")
    return one.select("hist_mean", "forecast_mean", pct.alias("pct_change"), X.trend_class(pct).alias("trend"))


def forecast_extremes(joined: DataFrame, last_n: int | None = None) -> DataFrame:
    """Date and value of the highest and lowest yhat (ties: earliest date)."""
    src = _last_n(joined, last_n) if last_n else joined
    one = src.agg(F.min(F.struct((-F.col("yhat")).alias("k"), F.col("ds"))).alias("hi"),
                  F.min(F.struct(F.col("yhat").alias("k"), F.col("ds"))).alias("lo"))
    return one.select(F.col("hi.ds").alias("peak_date"), (-F.col("hi.k")).alias("peak_yhat"),
                      F.col("lo.ds").alias("trough_date"), F.col("lo.k").alias("trough_yhat"))


def forecast_accuracy(joined: DataFrame) -> DataFrame:
    """MAPE over days with y > 0 (paired by date) and accuracy = max(0, 100 - MAPE)."""
    pos = joined.where(F.col("y") > 0)
    one = pos.agg((F.avg(F.abs(F.try_divide(F.col("y") - F.col("yhat"), F.col("y")))) * 100).alias("mape"),
                  F.count(F.lit(1)).alias("days"))
    return one.select("mape", F.greatest(F.lit(0.0), 100 - F.col("mape")).alias("accuracy"), "days")


def forecast_volatility(joined: DataFrame, n: int = 30) -> DataFrame:
    """Population std / mean of the last n yhat, in %; > 20 high, < 10 stable."""
    one = _last_n(joined, n).agg(F.stddev_pop("yhat").alias("std"), F.avg("yhat").alias("mean"))
    v = F.try_divide(F.col("std"), F.col("mean")) * 100
    return one.select(v.alias("volatility_pct"),
                      F.when(v > VOLATILITY_HIGH, "high").when(v < VOLATILITY_STABLE, "stable")
                       .when(v.isNotNull(), "moderate").alias("level"))


def critical_threshold(series: DataFrame) -> DataFrame:
    """Slider bounds and default for the critical sales threshold."""
    one = series.agg(F.min("y").alias("min_y"), F.avg("y").alias("mean_y"))
    mn = F.greatest(F.lit(1.0), 0.5 * F.col("min_y"))
    default = F.greatest(mn, F.round(0.7 * F.col("mean_y"), -2))
    return one.select(mn.alias("min_threshold"), default.alias("default_threshold"),
                      F.greatest(2 * default, 1.5 * F.col("mean_y")).alias("max_threshold"))


def critical_periods(joined: DataFrame, threshold) -> DataFrame:
    """R7 (list): the first 7 days with yhat below the threshold, rounded."""
    below = joined.where(F.col("yhat") < threshold)
    return (below.orderBy("ds").limit(7)
                 .select("ds", *[F.round(c, 2).alias(c) for c in ("yhat", "yhat_lower", "yhat_upper")]))


def critical_summary(joined: DataFrame, threshold) -> DataFrame:
    """R7 (summary): days below, % of the frame, first date."""
    one = joined.agg(F.count_if(F.col("yhat") < threshold).alias("days_below"),
                     F.count(F.lit(1)).alias("days"),
                     F.min(F.when(F.col("yhat") < threshold, F.col("ds"))).alias("first_date"))
    return one.select("days_below", (F.col("days_below") * 100.0 / F.col("days")).alias("pct_below"),
                      "first_date")


def forecast_alert(joined: DataFrame, share: float = 0.8, first_n: int = 3) -> DataFrame:
    """threshold = share * mean yhat; the first ``first_n`` dates below it."""
    thr = joined.agg((F.avg("yhat") * share).alias("threshold"))
    below = attach_scalars(joined, thr).where(F.col("yhat") < F.col("threshold"))
    return below.orderBy("ds").limit(first_n).select("ds", "threshold")


def _segment_means(df, label, value, qty):
    per = df.where(F.col(label).isNotNull()).groupBy(label).agg(
        F.avg(value).alias("avg_total"), F.avg(qty).alias("avg_quantity"))
    overall = df.agg(F.avg(value).alias("all_total"), F.avg(qty).alias("all_quantity"))
    return attach_scalars(per, overall)


def segment_actions(df, label="cluster", value="total", qty="quantity") -> DataFrame:
    """High spender / bulk buyer / average per cluster."""
    m = _segment_means(df, label, value, qty)
    action = (F.when(F.col("avg_total") > SEGMENT_HIGH * F.col("all_total"), "high spender")
               .when(F.col("avg_quantity") > SEGMENT_HIGH * F.col("all_quantity"), "bulk buyer")
               .otherwise("average"))
    return m.select(label, "avg_total", "avg_quantity", action.alias("segment"))


def segment_offers(df, label="cluster", value="total", qty="quantity", else_bundle: bool = False) -> DataFrame:
    """VIP / bundle / none per cluster (``else_bundle``: the older copy's fallback)."""
    return _offers(_segment_means(df, label, value, qty), label, else_bundle)


def _offers(m: DataFrame, label: str, else_bundle: bool = False) -> DataFrame:
    offer = (F.when(F.col("avg_total") > SEGMENT_HIGH * F.col("all_total"), "vip")
              .when(F.col("avg_quantity") < SEGMENT_LOW * F.col("all_quantity"), "bundle"))
    offer = offer.otherwise("bundle" if else_bundle else None)
    return m.select(label, "avg_total", "avg_quantity", offer.alias("offer"))


def segment_actions_fixed(df, label="cluster", value="total", qty="quantity") -> DataFrame:
    """Fixed thresholds on the cluster means."""
    m = df.where(F.col(label).isNotNull()).groupBy(label).agg(
        F.avg(value).alias("avg_total"), F.avg(qty).alias("avg_quantity"))
    a = (F.when(F.col("avg_total") > FIXED_HIGH_TOTAL, "high value")
          .when(F.col("avg_quantity") > FIXED_BULK_QTY, "bulk buyer")
          .when(F.col("avg_total") < FIXED_LOW_TOTAL, "low spender").otherwise("average"))
    return m.select(label, "avg_total", "avg_quantity", a.alias("segment"))


def correlation_notes(df, cols, k: int = 3, min_abs: float = 0.5) -> DataFrame:
    """Top pairs with |r| > min_abs: direction, strength and implication."""
    m = CR.correlation_matrix(df, cols).where((F.col("i") < F.col("j")) & (F.abs("r") > min_abs))
    top = m.orderBy(F.desc(F.abs("r")), "i", "j").limit(k)
    pair = F.array_sort(F.array(F.lower("col1"), F.lower("col2")))
    pos = F.col("r") > 0
    special = (F.when(pair == F.array(F.lit("quantity"), F.lit("total")),
                      F.when(pos, "volume drives revenue").otherwise("volume lowers totals"))
                .when(pair == F.array(F.lit("total"), F.lit("unit_price")),
                      F.when(pos, "premium items drive revenue").otherwise("cheaper items sell more"))
                .when(F.array_contains(pair, "total") & (F.lower("col1").contains("rating") |
                                                        F.lower("col2").contains("rating")),
                      F.when(pos, "ratings lift sales").otherwise("ratings do not lift sales"))
                .otherwise(F.when(pos, F.format_string("%s rises with %s", "col2", "col1"))
                            .otherwise(F.format_string("%s falls as %s rises", "col2", "col1"))))
    return top.select("col1", "col2", "r",
                      F.when(pos, "positive").otherwise("negative").alias("direction"),
                      F.when(F.abs("r") > 0.7, "strong").otherwise("moderate").alias("strength"),
                      special.alias("implication"))


def churn_recommendations(summary: DataFrame, importances: DataFrame) -> DataFrame:
    """(rank, kind, code, number, text): churn-rate alert, advice for the top
    feature, and the standing feedback advice.

    ``summary`` is M16 (churn_rate in %), ``importances`` is M12; ``number`` is the
    rate, or the top feature's importance.
    """
    spark = summary.sparkSession
    no_number = F.lit(None).cast("double").alias("number")
    alert = summary.where(F.col("churn_rate") / 100 > CHURN_ALERT_RATE).select(
        F.lit(1).alias("rank"), F.lit("alert").alias("kind"), F.lit("churn_alert").alias("code"),
        F.col("churn_rate").cast("double").alias("number"))
    rules = spark.createDataFrame(CHURN_FEATURE_CODES, "feature string, code string")
    top = importances.orderBy(F.desc("importance"), "feature").limit(1)
    best = top.join(F.broadcast(rules), "feature").select(
        F.lit(2).alias("rank"), F.lit("warning").alias("kind"), "code", F.col("importance").alias("number"))
    always = spark.range(1).select(F.lit(3).alias("rank"), F.lit("info").alias("kind"), F.lit("feedback").alias("code"), no_number)
    texts = F.create_map(*[F.lit(x) for pair in CHURN_TEXTS.items() for x in pair])
    return alert.unionByName(best).unionByName(always).withColumn("text", F.element_at(texts, F.col("code")))


def insight_kind(text_col) -> F.Column:
    """struct(symbol, colour) of a suggestion by the first mark of the list that it holds."""
    t = F.col(text_col) if isinstance(text_col, str) else text_col

    def kind(symbol, colour):
        return F.struct(F.lit(symbol).alias("symbol"), F.lit(colour).alias("colour"))

    out = F.when(t.isNull() | (t == ""), kind(*NO_TEXT))
    for mark, symbol, colour in MARKS:
        out = out.when(t.contains(mark), kind(symbol, colour))
    return out.otherwise(kind(*UNMARKED))


def _suggestion_text() -> F.Column:
    """The wording of a row's code with its subject and number."""
    out = F.lit(None).cast("string")
    for code, (mark, words) in SUGGESTIONS.items():
        args = [F.col("subject") if spec == "%s" else F.col("number") for spec in re.findall(r"%s|%\.\df", words)]
        text = F.concat(F.lit(mark + " "), F.format_string(words, *args) if args else F.lit(words))
        out = F.when(F.col("code") == code, text).otherwise(out)
    return out


def _suggestion_sums(rows: DataFrame, label: str) -> DataFrame:
    """Σ and count of total and quantity per category, per week, per (weekday, hour), per cluster and overall.

    One scan: GROUPING SETS over whichever of these columns there are. ``part`` names the
    set; a row per value, so the result is small and is written once.
    """
    cols = set(rows.columns)
    keys, sets = {}, {"all": []}
    if "product_line" in cols:
        keys["product_line"] = F.col("product_line")
        sets["product_line"] = ["product_line"]
    if "date" in cols:
        keys |= {"week": X.week_end_sunday("date"), "weekday": X.weekday_index("date"), "slot": F.coalesce("_slot", F.lit(0))}
        sets |= {"week": ["week"], "period": ["weekday", "slot"]}
    if label in cols:
        keys["_label"] = F.col(label)
        sets["cluster"] = ["_label"]
    qty = F.col("quantity") if "quantity" in cols else F.lit(None).cast("double")
    narrow = rows.select(*[c.alias(k) for k, c in keys.items()], "total", qty.alias("quantity"))
    names = list(keys)
    sums = narrow.groupingSets([[F.col(c) for c in of] for of in sets.values()], *names).agg(
        F.grouping_id().alias("_g"), F.coalesce(F.sum("total"), F.lit(0.0)).alias("total"), F.count("total").alias("n_total"),
        F.sum("quantity").cast("double").alias("quantity"), F.count("quantity").alias("n_quantity"))
    part = F.lit(None).cast("string")
    for name, of in sets.items():  # a bit per column, the first one highest, set where the column is summed over
        part = F.when(F.col("_g") == sum(1 << (len(names) - 1 - i) for i, c in enumerate(names) if c not in of), name).otherwise(part)
    return materialize(sums.withColumn("part", part).drop("_g"))


def business_suggestions(df, forecast: DataFrame | None = None, label="cluster", corr_cols=None) -> DataFrame:
    """The ordered suggestions (rank, code, subject, number, symbol, colour, text).

    Rules whose columns are missing are skipped. Order: top / bottom categories,
    week-over-week change beyond +-5 %, busiest and slowest period, the two
    strongest correlations with |r| >= 0.1 among all numeric columns (or
    ``corr_cols``; a constant one correlates with nothing), cluster offers,
    forecast alert. The columns in use are written once; one scan of that copy gives
    every sum, another one the correlations, and the rules read these small results.
    """
    cols = set(df.columns)
    num = list(corr_cols) if corr_cols is not None else numeric_columns(df)
    df = df.withColumn("_slot", hour_column(df))
    used = ["_slot", *[c for c in ("date", "total", "quantity", "product_line", label, *num) if c in cols]]
    df = materialize(df.select(*dict.fromkeys(used)))
    sums = _suggestion_sums(df, label) if "total" in cols else None
    nothing = F.lit(None).cast("string").alias("subject"), F.lit(None).cast("double").alias("number")
    parts = []

    def add(frame, rank, code, subject=nothing[0], number=nothing[1]):
        parts.append(frame.select(rank.cast("int").alias("rank"), code.alias("code"), subject.cast("string").alias("subject"),
                                  number.cast("double").alias("number")))

    if {"product_line", "total"} <= cols:
        tb = R.top_bottom_products(sums.where("part = 'product_line'"), 3)
        names = tb.groupBy("which").agg(F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "product_line"))), lambda s: s["product_line"]),
            ", ").alias("names"))
        is_top = F.col("which") == "top"
        add(names, F.when(is_top, 10).otherwise(11), F.when(is_top, "top_categories").otherwise("low_categories"), F.col("names"))
    if {"date", "total"} <= cols:
        weeks = sums.where("part = 'week'").select(F.col("week").alias("date"), "total")
        wow = R.week_over_week(weeks).where("is_last").where(F.abs("pct_change") > WOW_NOTABLE)
        up = F.col("pct_change") > 0
        add(wow, F.lit(20), F.when(up, "sales_up").otherwise("sales_down"), number=F.abs("pct_change"))
        monday = F.lit("1970-01-05").cast("date")
        cells = sums.where("part = 'period'").select(F.date_add(monday, F.col("weekday")).alias("date"), F.col("slot").alias("hour"), "total")
        pk = R.peak_periods(cells)
        busy = F.col("which") == "busiest"
        add(pk, F.when(busy, 30).otherwise(31), F.col("which"), F.format_string("%s %d:00", "day", "hour"), F.col("sales"))
        add(pk.agg(F.count(F.lit(1)).alias("n")).where("n = 0"), F.lit(30), F.lit("no_periods"))
    if len(num) > 1:
        pairs = materialize(CR.correlation_matrix(df, num).where("i < j and r is not null"))
        best = pairs.where(F.abs("r") >= 0.1).orderBy(F.desc(F.abs("r")), "i", "j").limit(2)
        place = F.row_number().over(Window.orderBy(F.desc(F.abs("r")), "i", "j"))
        add(best, 40 + place, F.lit("correlation"), F.concat_ws(" and ", "col1", "col2"), F.col("r"))
        known = pairs.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs("r") >= 0.1).alias("strong"))
        add(known.where("strong = 0"), F.lit(41), F.when(F.col("n") > 0, "no_correlation").otherwise("few_numbers"))
    else:
        add(df.sparkSession.range(1), F.lit(41), F.lit("few_numbers"))
    if label in cols and {"total", "quantity"} <= cols:
        means = F.try_divide("total", F.col("n_total")), F.try_divide("quantity", F.col("n_quantity"))
        per = sums.where("part = 'cluster' and _label is not null").select(
            F.col("_label").alias(label), means[0].alias("avg_total"), means[1].alias("avg_quantity"))
        overall = sums.where("part = 'all'").select(means[0].alias("all_total"), means[1].alias("all_quantity"))
        so = _offers(attach_scalars(per, overall), label).where(F.col("offer").isNotNull())
        vip = F.col("offer") == "vip"
        add(so, 50 + F.col(label), F.when(vip, "cluster_spends").otherwise("cluster_small"), F.col(label),
            F.when(vip, F.col("avg_total")).otherwise(F.col("avg_quantity")))
    if forecast is not None:
        fa = forecast_alert(forecast).agg(F.min("threshold").alias("t"), F.array_join(F.array_sort(
            F.collect_list(F.date_format("ds", "yyyy-MM-dd"))), ", ").alias("d")).where(F.col("t").isNotNull())
        add(fa, F.lit(60), F.lit("forecast_low"), F.col("d"), F.col("t"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    words = out.withColumn("text", _suggestion_text())
    return words.withColumn("_k", insight_kind("text")).select("rank", "code", "subject", "number", "_k.symbol", "_k.colour", "text")
