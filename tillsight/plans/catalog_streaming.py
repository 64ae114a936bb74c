"""Registered queries, part 3: the chart aggregates as Structured Streaming jobs."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from tillsight.plans.catalog_base import SALES
from tillsight.plans.registry import register, rounded
from tillsight.streaming import incremental as ST


@register("streaming_daily_sales", """select cast(ts as date) as day, round(coalesce(sum(value), 0), 2) as sales,
  count(*) as n from events group by 1""")
def q_streaming_daily_sales(spark, sf):
    """A5 on the event stream: running Σ value per day."""
    path = os.path.join(sf, "events.parquet")
    schema = spark.read.parquet(path).schema
    out = ST.run_to_table(spark, sf, schema, {"day": F.to_date("ts")}, "value", name="daily",
                          file_glob="events.parquet")
    return rounded(out)


@register("streaming_sales_by_category", SALES + """select product_line, round(coalesce(sum(total), 0), 2) as sales,
  count(*) as n from sales where product_line is not null group by 1""")
def q_streaming_sales_by_category(spark, sf):
    """A1 with the line table as a stream joined to static orders, customers, parts."""
    return rounded(ST.stream_sales_by_key(spark, sf, "product_line"))
