"""Partition invariance: operators give the same answer with 1 and 16 shuffle
partitions (no result may depend on how rows happen to be split)."""

import pytest

import __spark_entry__ as E
from oracle_check import canon

from conftest import SF_SMALL

NAMES = ["dedupe", "forward_fill", "impute_median", "impute_mode", "describe_numeric", "box_stats",
         "weekly_sales", "week_over_week", "top_bottom_products", "peak_periods", "cluster_demographics",
         "correlation_matrix", "head_n", "page", "clean_basic", "critical_periods", "forecast_alert"]


@pytest.mark.parametrize("name", NAMES)
def test_same_result_for_1_and_16_partitions(spark, name):
    q = E.queries()[name]
    out = []
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            df = q(spark, SF_SMALL)
            out.append(canon(df.columns, [tuple(r) for r in df.collect()]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert out[0] == out[1]
