"""Registered queries: name -> (Spark builder, DuckDB oracle SQL or None).

Builders take ``(spark, sf_dir)`` and return a lazy DataFrame over the whole
driver tables. The oracle SQL runs on DuckDB views with the table names;
``SALES`` / ``EVENTS`` below are the CTE headers both sides agree on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillsight.sources.tables import EVENTS_SALES_SQL, SALES_SQL

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}

SALES = f"with sales as ({SALES_SQL})\n"
EV = f"with ev as ({EVENTS_SALES_SQL})\n"


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def rounded(df: DataFrame, digits: int = 2) -> DataFrame:
    """Round every floating column (sums in a different order differ in the last bits)."""
    return df.select([F.round(F.col(f.name), digits).alias(f.name)
                      if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
                      for f in df.schema.fields])
