"""Driver tables -> the sales and events views every query starts from.

The sales view is one row per invoice line (``FIXTURES.md`` §3). It is built by
joining the line table to orders, customers and parts; Catalyst prunes the
columns each query needs and pushes filters into the parquet scans. Join order
is orders+customers first (the order-sized side), then lines (the big side) on
the order key, then parts, so the widest table is shuffled as few times as the
keys allow; AQE turns any side that turns out small into a broadcast at run time
from measured sizes.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

# Column contract of the sales table (snake_case of the upload headers).
SALES_COLUMNS = ("invoice_id", "customer_id", "date", "time", "total", "quantity",
                 "unit_price", "product_line", "payment", "gender", "customer_type")

# The same view as SQL text, for the DuckDB oracle and for ``spark.sql``.
SALES_SQL = """
select o.o_orderkey as invoice_id, o.o_custkey as customer_id, o.o_orderdate as date,
       concat(cast(10 + o.o_orderkey % 11 as varchar(10)), ':',
              lpad(cast(o.o_orderkey % 60 as varchar(10)), 2, '0')) as time,
       l.l_extendedprice * (1 - l.l_discount) * (1 + l.l_tax) as total,
       cast(l.l_quantity as int) as quantity, p.p_retailprice as unit_price,
       p.p_type as product_line, o.o_orderpriority as payment,
       case when o.o_custkey % 2 = 0 then 'Female' else 'Male' end as gender,
       c.c_mktsegment as customer_type
from lineitem l
join orders o on l.l_orderkey = o.o_orderkey
join customer c on o.o_custkey = c.c_custkey
join part p on l.l_partkey = p.p_partkey
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def sales(spark: SparkSession, sf_dir: str, lineitem: DataFrame | None = None) -> DataFrame:
    """The sales view as a lazy DataFrame (see module docstring).

    ``lineitem`` may be a streaming DataFrame: the view is then a stream-static
    join against the order, customer and part tables.
    """
    li = (lineitem if lineitem is not None else table(spark, sf_dir, "lineitem")).select(
        "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_retailprice")
    oc = o.join(c, o.o_custkey == c.c_custkey, "inner")
    lo = li.join(oc, li.l_orderkey == oc.o_orderkey, "inner")
    full = lo.join(p, lo.l_partkey == p.p_partkey, "inner")
    key = F.col("o_orderkey")
    return full.select(
        key.alias("invoice_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").alias("date"),
        F.concat((F.lit(10) + key % 11).cast("string"), F.lit(":"),
                 F.lpad((key % 60).cast("string"), 2, "0")).alias("time"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("total"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.col("p_retailprice").alias("unit_price"),
        F.col("p_type").alias("product_line"),
        F.col("o_orderpriority").alias("payment"),
        F.when(F.col("o_custkey") % 2 == 0, F.lit("Female")).otherwise(F.lit("Male")).alias("gender"),
        F.col("c_mktsegment").alias("customer_type"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event stream table: real time of day and a unique order key (``event_id``)."""
    return table(spark, sf_dir, "events")


def events_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in the sales contract: ``date`` (with time of day) and ``total``."""
    return events(spark, sf_dir).select(
        F.col("event_id").alias("invoice_id"), F.col("user_id").alias("customer_id"),
        F.col("ts").alias("date"), F.col("value").alias("total"),
        F.col("event_type").alias("product_line"))


EVENTS_SALES_SQL = """
select event_id as invoice_id, user_id as customer_id, ts as date, value as total,
       event_type as product_line from events
"""
