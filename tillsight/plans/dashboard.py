"""One dashboard request (the reference's interactive session) as a Spark plan.

load -> clean -> filter once, write the filtered rows once to the shared
checkpoint folder, then build every chart / table from that copy. Each chart is
an independent lazy DataFrame; nothing is collected here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.functions import expressions as X
from tillsight.operators import aggregate as A
from tillsight.operators import correlate as CR
from tillsight.operators import filters as FL
from tillsight.operators import ranking as R
from tillsight.session import materialize

NUMERIC = ("total", "quantity", "unit_price")


def dashboard(df: DataFrame, category=None, customer_type=None, gender=None, start=None, end=None,
              corr_cols=NUMERIC) -> dict[str, DataFrame]:
    """Charts of one filtered view: name -> DataFrame."""
    rows = FL.filter_compose(df, category, customer_type, gender, start, end)
    if "time" in rows.columns and "hour" not in rows.columns:
        rows = rows.withColumn("hour", X.hour_of_time("time"))
    base = materialize(rows)
    charts = {
        "kpis": A.kpi_summary(base),
        "by_category": A.sales_by_category(base),
        "by_payment": A.sales_by_payment(base),
        "by_gender": A.sales_by_gender(base),
        "by_customer_type": A.sales_by_customer_type(base),
        "daily": A.daily_sales(base),
        "weekly": A.weekly_sales(base),
        "weekday": A.weekday_sales(base),
        "heatmap": A.sales_heatmap(base),
        "avg_price": A.avg_price_by_category(base),
        "quantity": A.quantity_by_category(base),
        "payment_counts": A.payment_counts(base),
        "describe": A.describe_numeric(base, [c for c in corr_cols if c in base.columns]),
        "correlation": CR.correlation_matrix(base, [c for c in corr_cols if c in base.columns]),
        "top_bottom": R.top_bottom_products(base),
        "week_over_week": R.week_over_week(base),
        "peaks": R.peak_periods(base),
        "top_share": R.top_products_share(base),
        "first_rows": R.head_n(base, 50, [F.desc("total"), *[c for c in base.columns if c != "total"]]),
    }
    return charts
