"""Exact quantiles by range: same values as numpy, no window over a whole column."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillsight.operators import stats
from tillsight.operators.stats import exact_quantiles

PROBS = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]


@pytest.fixture
def many_ranges(spark):
    """Ranges are not merged, however few rows they have."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def expected(values):
    return {p: float(np.quantile(values, p)) for p in PROBS}


@pytest.mark.parametrize("widths", [(2, 64, None), (None,)])
def test_quantiles_over_many_ranges(spark, many_ranges, widths):
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), (F.pmod(F.hash("id"), F.lit(997)) / 7).alias("x"),
                                  F.when(F.col("id") % 5 == 0, F.lit(4.0)).alias("same"),
                                  F.when(F.col("id") < 0, F.lit(1.0)).alias("none"))
    pdf = df.toPandas()
    got = {(r["column"], r.p): r.value for r in exact_quantiles(df, ["x", "same", "none"], PROBS, widths=widths).collect()}
    want = {("x", p): v for p, v in expected(pdf.x).items()} | {("same", p): 4.0 for p in PROBS}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    got = {(r.k, r.p): r.value for r in exact_quantiles(df, ["x"], PROBS, ["k"], widths=widths).collect()}
    for k, part in pdf.groupby("k"):
        for p, v in expected(part.x).items():
            assert got[k, p] == pytest.approx(v, abs=1e-12)


def test_two_rows_in_two_ranges(spark, many_ranges):
    df = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    assert [r.value for r in exact_quantiles(df, ["x"], [0.5]).collect()] == [1.5]


def test_only_ranges_with_a_rank_are_ordered(spark, capsys):
    places = spark.range(1000).select(F.lit("x").alias("column"), F.struct(F.col("id").cast("double").alias("at"), F.lit(0).alias("above")).alias("place"),
                                      F.lit(1).cast("long").alias("cnt"))
    targets = spark.createDataFrame([("x", 1000, 0.0, 0.0, 0.0, 999.0, 0.5, 499.5)],
                                    "column string, n long, mean double, std double, min double, max double, p double, h double")
    found = stats._at_ranks(places, targets, [])
    found.explain("simple")
    windows = re.findall(r"Window \[.*", capsys.readouterr().out)
    over_places = [w for w in windows if "place" in w]
    assert over_places and all(re.search(r"windowspecdefinition\(column#\d+, _range#\d+, place", w) for w in over_places)
    row = found.first()
    assert (row.a.at, row.b.at) == (499.0, 500.0)
