"""Column expressions (JVM-side, codegen friendly) shared by all operators.

Each helper takes and returns ``Column`` objects; nothing here touches data.
House rules from the pandas/Spark differences: bad input becomes NULL through
``try_*`` functions (ANSI stays on), divisions go through ``try_divide`` and
"today" is always an explicit ``as_of`` argument.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weekday names in Monday-first order and the hour span of a day.
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
HOURS_PER_DAY = 24

# Date formats tried in order when parsing strings (ISO date with
# and without time of day, then the month/day/year form the browser accepts).
DATE_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSS",
                "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "M/d/yyyy HH:mm", "M/d/yyyy")

# Shape each format can possibly accept. A failed parse is far more expensive
# than a regex test, so a format is only tried on strings of its shape; the
# parser still validates, so results equal trying every format.
_YMD, _MDY, _HM = r"\d{4}-\d{1,2}-\d{1,2}", r"\d{1,2}/\d{1,2}/\d{4}", r"\d{1,2}:\d{1,2}"
FORMAT_SHAPES = {
    "yyyy-MM-dd HH:mm:ss": rf"^{_YMD} {_HM}:\d{{1,2}}$",
    "yyyy-MM-dd'T'HH:mm:ss": rf"^{_YMD}T{_HM}:\d{{1,2}}$",
    "yyyy-MM-dd'T'HH:mm:ss.SSS": rf"^{_YMD}T{_HM}:\d{{1,2}}\.\d{{1,9}}$",
    "yyyy-MM-dd HH:mm": rf"^{_YMD} {_HM}$",
    "yyyy-MM-dd": rf"^{_YMD}$",
    "M/d/yyyy HH:mm": rf"^{_MDY} {_HM}$",
    "M/d/yyyy": rf"^{_MDY}$",
}


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_date(c, formats=DATE_FORMATS) -> Column:
    """String -> timestamp; unparseable -> NULL. Timestamps pass through."""
    s = col(c).cast("string")
    tries = []
    for f in formats:
        parsed = F.try_to_timestamp(s, F.lit(f))
        shape = FORMAT_SHAPES.get(f)
        tries.append(F.when(s.rlike(shape), parsed) if shape else parsed)
    # Zone-less result (the session zone is UTC), like the parquet timestamps.
    return F.coalesce(*tries).cast("timestamp_ntz")


def weekday_index(d) -> Column:
    """0 = Monday ... 6 = Sunday (Spark's ``weekday``)."""
    return F.weekday(col(d))


def day_name(d) -> Column:
    """English weekday name."""
    return F.date_format(col(d), "EEEE")


def month_name(d) -> Column:
    return F.date_format(col(d), "MMMM")


def hour_of_time(t) -> Column:
    """Hour of an ``H:mm`` string, else the integer before ``:``, else NULL."""
    s = col(t).cast("string")
    return F.coalesce(F.hour(F.try_to_timestamp(s, F.lit("H:mm"))),
                      F.split(s, ":").getItem(0).try_cast("int")).cast("int")


def format_date(d) -> Column:
    """``yyyy-MM-dd`` text."""
    return F.date_format(col(d), "yyyy-MM-dd")


def inf_to_null(x) -> Column:
    """+-inf and NaN become NULL."""
    c = col(x)
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None)).otherwise(c)


def profit(total="total", quantity="quantity", unit_price="unit_price") -> Column:
    """Total - Quantity * Unit price."""
    return col(total) - col(quantity) * col(unit_price)


def profit_margin(profit_col, total="total") -> Column:
    """Profit / Total * 100; Total = 0 -> NULL."""
    return F.try_divide(col(profit_col), col(total)) * F.lit(100.0)


def avg_item_price(total="total", quantity="quantity") -> Column:
    """Total / Quantity; Quantity = 0 -> NULL."""
    return F.try_divide(col(total).cast("double"), col(quantity))


def avg_purchase_value(total="total", quantity="quantity") -> Column:
    """Total / Quantity, a zero quantity counted as one."""
    q = col(quantity)
    return col(total).cast("double") / F.when(q == 0, F.lit(1)).otherwise(q)


def days_since(d, as_of) -> Column:
    """Whole calendar days from ``d`` to ``as_of`` (a date string or Column)."""
    ref = F.to_date(F.lit(as_of)) if isinstance(as_of, str) else F.to_date(as_of)
    return F.datediff(ref, F.to_date(col(d)))


def churn_label(days, threshold: int = 60) -> Column:
    """P5: 1 when more than ``threshold`` days passed (60 for copy A, 30 for B)."""
    return (col(days) > F.lit(threshold)).cast("int")


def purchase_frequency(days_first, n) -> Column:
    """Days since first purchase per purchase."""
    return col(days_first) / F.greatest(col(n), F.lit(1))


def risk_bucket(p) -> Column:
    """(0, .3] Low, (.3, .7] Medium, (.7, 1] High; 0 and NULL stay NULL."""
    c = col(p)
    return (F.when((c > 0) & (c <= 0.3), F.lit("Low"))
            .when((c > 0.3) & (c <= 0.7), F.lit("Medium"))
            .when((c > 0.7) & (c <= 1.0), F.lit("High")))


def churn_text(label) -> Column:
    """0 / 1 -> Retained / Churned."""
    c = col(label)
    return F.when(c == 0, F.lit("Retained")).when(c == 1, F.lit("Churned"))


def week_end_sunday(d) -> Column:
    """The Sunday that closes the week of ``d`` (Sunday maps to itself)."""
    return F.date_add(F.to_date(F.date_trunc("week", col(d))), 6)


def week_start_monday(d) -> Column:
    return F.to_date(F.date_trunc("week", col(d)))


def pct_change(cur, prev) -> Column:
    """Percent change; a zero or missing previous value gives NULL."""
    return F.try_divide(col(cur) - col(prev), col(prev)) * F.lit(100.0)


def trend_class(pct) -> Column:
    """R1/R2 classes: > 10 strong up, > 0 moderate up, > -10 slight down, else down."""
    c = col(pct)
    return (F.when(c > 10, F.lit("strong increase"))
            .when(c > 0, F.lit("moderate increase"))
            .when(c > -10, F.lit("slight decrease"))
            .when(c.isNotNull(), F.lit("significant decrease")))
