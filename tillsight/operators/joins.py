"""Joins (J1-J3). J1 lives with the forecast, J3 with segmentation; J2 is here.

The reference combines its price and quantity frames by position; here both
come out of one ``groupBy`` (the equi-join on the category key is implicit), so
there is no join to shuffle at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.operators.forecast import forecast_actual_join  # noqa: F401  (J1)
from tillsight.operators.segment import attach_labels  # noqa: F401  (J3)

# Performance rating thresholds (revenue, quantity, price).
HIGH_REVENUE, HIGH_QTY = 1000.0, 50
GOOD_REVENUE, GOOD_QTY = 500.0, 30
PREMIUM_PRICE = 50.0
LOW_REVENUE, LOW_QTY = 200.0, 10


def product_matrix(df: DataFrame, key="product_line", price="unit_price", qty="quantity") -> DataFrame:
    """Avg price and Σ quantity per category, revenue = price x quantity, rating."""
    g = (df.where(F.col(key).isNotNull()).groupBy(key)
           .agg(F.avg(price).alias("avg_price"), F.sum(qty).cast("long").alias("quantity")))
    rev = F.col("avg_price") * F.col("quantity")
    q = F.col("quantity")
    rating = (F.when((rev > HIGH_REVENUE) & (q > HIGH_QTY), "High Performer")
               .when((rev > GOOD_REVENUE) | (q > GOOD_QTY), "Good Performer")
               .when(F.col("avg_price") > PREMIUM_PRICE, "Premium")
               .when((rev < LOW_REVENUE) & (q < LOW_QTY), "Under Performer")
               .otherwise("Average"))
    return g.select(key, "avg_price", "quantity", rev.alias("revenue"), rating.alias("rating"))
