"""The minimum slice: sales view -> C13 cleaning -> F6 filters -> A1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillsight.operators import aggregate as A
from tillsight.operators import filters as FL
from tillsight.plans.pipelines import clean_basic
from tillsight.plans.registry import rounded
from tillsight.sources import tables as TB


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = clean_basic(TB.sales(spark, sf_dir), TB.SALES_COLUMNS)
    s = FL.filter_compose(s, customer_type="BUILDING", start="1996-01-01", end="2000-12-31")
    return rounded(A.sales_by_category(s))
