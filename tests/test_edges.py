"""Hand-made fixtures, one per pandas/Spark trap."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillsight.functions import expressions as X
from tillsight.operators import aggregate as A
from tillsight.operators import clean as C
from tillsight.operators import correlate as CR
from tillsight.operators import ranking as R
from tillsight.operators.stats import column_modes, exact_quantiles
from tillsight.sources import files as IO


def test_null_group_key_dropped_and_all_null_sum_is_zero(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 2.0), ("b", None)], "product_line string, total double")
    got = {r[0]: r[1] for r in A.sales_by_category(df).collect()}
    assert got == {"a": 1.0, "b": 0.0}


def test_bad_and_us_dates(spark):
    df = spark.createDataFrame([("2023-01-15",), ("1/5/2019",), ("junk",), (None,)], "d string")
    got = [r[0] for r in df.select(X.parse_date("d")).collect()]
    assert got == [dt.datetime(2023, 1, 15), dt.datetime(2019, 1, 5), None, None]


def test_hour_of_time(spark):
    df = spark.createDataFrame([("13:45",), ("9:05",), ("7",), ("x",)], "t string")
    assert [r[0] for r in df.select(X.hour_of_time("t")).collect()] == [13, 9, 7, None]


def test_zero_quantity(spark):
    df = spark.createDataFrame([(10.0, 0), (10.0, 4)], "total double, quantity int")
    r = df.select(X.avg_item_price().alias("a"), X.avg_purchase_value().alias("b")).collect()
    assert (r[0].a, r[0].b) == (None, 10.0)
    assert (r[1].a, r[1].b) == (2.5, 2.5)


def test_constant_column_correlation_is_null(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "x double, c double")
    m = {(r.col1, r.col2): r.r for r in CR.correlation_matrix(df, ["x", "c"]).collect()}
    assert m[("x", "c")] is None and abs(m[("x", "x")] - 1) < 1e-12


def test_pairwise_complete_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.1), (3.0, None), (4.0, 8.3), (None, 1.0)], "x double, y double")
    r = CR.correlation_matrix(df, ["x", "y"]).where("col1 = 'x' and col2 = 'y'").first().r
    x, y = np.array([1.0, 2.0, 4.0]), np.array([2.0, 4.1, 8.3])
    assert abs(r - np.corrcoef(x, y)[0, 1]) < 1e-12


def test_tied_mode_takes_lowest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "s string")
    assert column_modes(df, ["s"]).first().value == "a"


def test_impute_mode_all_null_column_stays_null(spark):
    df = spark.createDataFrame([(None, "x"), (None, None)], "a string, b string")
    got = C.impute_mode(df).collect()
    assert [r.a for r in got] == [None, None] and [r.b for r in got] == ["x", "x"]


def test_tied_max_goes_to_earliest_cell(spark):
    rows = [(dt.datetime(2024, 1, 1, 10), 5.0), (dt.datetime(2024, 1, 2, 9), 5.0),
            (dt.datetime(2024, 1, 3, 8), 1.0)]
    df = spark.createDataFrame(rows, "date timestamp, total double").withColumn("hour", F.hour("date"))
    pk = {r.which: (r.day, r.hour) for r in R.peak_periods(df).collect()}
    assert pk["busiest"] == ("Monday", 10) and pk["slowest"] == ("Wednesday", 8)


def test_sunday_week_end_and_gap_week(spark):
    rows = [(dt.datetime(2024, 1, 7), 1.0), (dt.datetime(2024, 1, 8), 2.0), (dt.datetime(2024, 1, 22), 4.0)]
    df = spark.createDataFrame(rows, "date timestamp, total double")
    got = [(r.week, r.sales) for r in A.weekly_sales(df).orderBy("week").collect()]
    assert got == [(dt.date(2024, 1, 7), 1.0), (dt.date(2024, 1, 14), 2.0),
                   (dt.date(2024, 1, 21), 0.0), (dt.date(2024, 1, 28), 4.0)]


def test_forward_fill_long_null_run_and_leading_nulls(spark):
    n = 5000
    vals = [None if (i < 3 or 100 <= i < 3000 or i % 7 == 0) else float(i) for i in range(n)]
    df = spark.createDataFrame(list(enumerate(vals)), "k long, v double").repartition(8)
    got = {r.k: r.v for r in C.forward_fill(df, "k").collect()}
    last = None
    for i, v in enumerate(vals):
        last = v if v is not None else last
        assert got[i] == last


@pytest.mark.parametrize("seed", [1, 2])
def test_exact_quantiles_match_numpy(spark, seed):
    rnd = random.Random(seed)
    rows = [(g, rnd.choice([rnd.random() * 100, float(rnd.randint(0, 5))]))
            for g in range(4) for _ in range([1, 2, 7, 3000][g])]
    df = spark.createDataFrame(rows, "g int, x double")
    got = exact_quantiles(df, ["x"], [0.0, 0.25, 0.5, 0.75, 1.0], group_cols=["g"], accuracy=1000).collect()
    assert len(got) == 20
    for r in got:
        xs = np.array([x for g, x in rows if g == r.g])
        assert math.isclose(r.value, float(np.quantile(xs, r.p)), rel_tol=1e-12, abs_tol=1e-12)


def test_dedupe_keeps_first_order_value(spark):
    df = spark.createDataFrame([("a", 1, 3), ("a", 1, 1), ("b", 2, 2)], "k string, v int, o int")
    got = sorted(tuple(r) for r in C.dedupe(df, subset=["k", "v"], order_col="o").collect())
    assert got == [("a", 1, 1), ("b", 2, 2)]


def test_latin1_csv_detected(spark, tmp_path):
    p = tmp_path / "latin1.csv"
    p.write_bytes("Invoice ID,Date,Total,Quantity,Product line\nINV-1,2023-01-15,10.5,2,Caf\xe9\n".encode("latin1"))
    df = IO.csv_scan_fallback(spark, str(p))
    r = df.first()
    assert r.product_line == "Café" and r.total == 10.5 and r.quantity == 2


def test_missing_csv_gives_empty_frame(spark, tmp_path):
    df = IO.csv_scan_fallback(spark, str(tmp_path / "nope.csv"))
    assert df.count() == 0 and len(df.columns) == 4


def test_partition_invariance(spark):
    from tillsight.sources import tables as TB
    s = TB.sales(spark, "/root/testdata/sf0.001")
    a = sorted(tuple(r) for r in A.describe_numeric(s.repartition(1), ["total", "quantity"]).collect())
    b = sorted(tuple(r) for r in A.describe_numeric(s.repartition(8), ["total", "quantity"]).collect())
    for x, y in zip(a, b):
        assert x[0] == y[0] and all(math.isclose(u, v, rel_tol=1e-9) for u, v in zip(x[1:], y[1:]))


def test_probability_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (0.3,), (0.7,), (1.0,)], "p double")
    got = {r.bin: r.n for r in A.probability_histogram(df, "p").collect()}
    assert got == {0: 1, 6: 1, 14: 1, 19: 1}
    rb = [r[0] for r in df.select(X.risk_bucket("p")).collect()]
    assert rb == [None, "Low", "Medium", "High"]


def test_exact_quantiles_hot_group_with_duplicates(spark):
    rnd = random.Random(7)
    rows = [("hot", float(rnd.choice([1, 2, 2, 3, 50]))) for _ in range(6000)]
    rows += [(f"g{i % 40}", rnd.random()) for i in range(12000)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(8)
    got = exact_quantiles(df, ["x"], [0.1, 0.5, 0.9], group_cols=["g"], accuracy=2000).collect()
    assert len(got) == 41 * 3
    for r in got:
        xs = np.array([x for g, x in rows if g == r.g])
        assert math.isclose(r.value, float(np.quantile(xs, r.p)), rel_tol=1e-12, abs_tol=1e-12)


def test_forward_fill_hot_partition(spark):
    rows = []
    for i in range(6000):
        part = "hot" if i % 3 else f"p{i % 7}"
        rows.append((part, i, None if i % 4 else float(i)))
    df = spark.createDataFrame(rows, "part string, k long, v double")
    got = {(r.part, r.k): r.v for r in C.forward_fill(df, "k", ["v"], partition_cols=["part"]).collect()}
    last = {}
    for part, k, v in sorted(rows, key=lambda t: t[1]):
        last[part] = v if v is not None else last.get(part)
        assert got[(part, k)] == last[part]


def test_dedupe_hot_duplicate_group(spark):
    rows = [("same", 1)] * 5000 + [(f"u{i}", i) for i in range(2000)]
    df = spark.createDataFrame(rows, "a string, b int").repartition(8)
    assert C.dedupe(df).count() == 2001


def test_dashboard_builds_every_chart_from_one_filtered_copy(spark):
    from tillsight.plans.dashboard import dashboard
    from tillsight.sources import tables as TB
    charts = dashboard(TB.sales(spark, "/root/testdata/sf0.001"), customer_type="BUILDING",
                       start="1996-01-01", end="2000-12-31")
    assert charts["heatmap"].count() == 168
    assert charts["first_rows"].count() == 50
    total = charts["kpis"].first().total_sales
    assert math.isclose(sum(r.sales for r in charts["by_category"].collect()), total, rel_tol=1e-9)
    for name, df in charts.items():
        assert df.count() >= 1, name


def test_describe_approx_close_to_exact(spark):
    from tillsight.sources import tables as TB
    s = TB.sales(spark, "/root/testdata/sf0.001")
    ex = {r.column: r for r in A.describe_numeric(s, ["total", "quantity"]).collect()}
    ap = {r.column: r for r in A.describe_numeric(s, ["total", "quantity"], approx=True).collect()}
    for c in ex:
        assert ex[c]["count"] == ap[c]["count"] and math.isclose(ex[c]["mean"], ap[c]["mean"], rel_tol=1e-9)
        for k in ("p25", "p50", "p75"):
            assert abs(ex[c][k] - ap[c][k]) <= 0.02 * (ex[c]["max"] - ex[c]["min"])


def test_nan_in_csv_becomes_null(spark, tmp_path):
    p = tmp_path / "nan.csv"
    p.write_text("Invoice ID,Total,Quantity\nA,NaN,1\nB,2.5,2\n")
    df = IO.csv_scan(spark, str(p))
    assert [r.total for r in df.orderBy("invoice_id").collect()] == [None, 2.5]
    assert A.kpi_summary(df).first().total_sales == 2.5


def test_weekly_category_pivot_wide_and_long_agree(spark):
    rows = [(dt.datetime(2024, 1, 1), "a", 1.0), (dt.datetime(2024, 1, 2), "b", 2.0),
            (dt.datetime(2024, 1, 9), "a", 4.0), (dt.datetime(2024, 1, 9), "c", 8.0)]
    df = spark.createDataFrame(rows, "date timestamp, product_line string, total double")
    keys = spark.createDataFrame([("a",), ("b",)], "product_line string")
    wide = {r.week: (r.a, r.b) for r in A.weekly_category_pivot(df, keys, names=["a", "b"]).collect()}
    assert wide == {dt.date(2024, 1, 1): (1.0, 2.0), dt.date(2024, 1, 8): (4.0, 0.0)}
    long = {(r.week, r.product_line): r.sales for r in A.weekly_category_pivot(df, keys).collect()}
    assert long[(dt.date(2024, 1, 8), "b")] == 0.0 and len(long) == 4
