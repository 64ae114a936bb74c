"""Property tests for the MLlib-backed operators (labels are not compared to
scikit-learn / Prophet; their invariants are)."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tillsight.operators import churn as CH
from tillsight.operators import forecast as FC
from tillsight.operators import segment as SG
from tillsight.sources import tables as TB

from conftest import SF_SMALL

AS_OF = "2001-08-01"


@pytest.fixture(scope="module")
def sales(spark):
    df = TB.sales(spark, SF_SMALL).cache()
    yield df
    df.unpersist()


def test_kmeans_labels_valid_and_deterministic(sales):
    s = sales.withColumn("unit_price", F.when(F.col("invoice_id") % 5 == 0, None).otherwise(F.col("unit_price")))
    a = SG.segment_customers(s, k=3, seed=42)
    b = SG.segment_customers(s, k=3, seed=42)
    assert a.count() == s.count()
    labs = {r.cluster for r in a.select("cluster").distinct().collect()}
    assert labs <= {0, 1, 2, None} and {0, 1, 2} <= labs
    assert a.where("unit_price is null and cluster is not null").count() == 0
    assert a.where("unit_price is not null and cluster is null").count() == 0
    key = ["invoice_id", "total", "quantity", "unit_price", "product_line"]
    assert a.select(*key, "cluster").exceptAll(b.select(*key, "cluster")).count() == 0
    means = [r.m for r in a.where("cluster is not null").groupBy("cluster").agg(F.avg("total").alias("m"))
             .orderBy("cluster").collect()]
    assert len(means) == 3 and means == sorted(means)  # labels are renumbered by mean Total


def test_split_disjoint_and_covering(sales):
    e = CH.churn_features_entity(sales, AS_OF)
    s = CH.train_test_split(e, "customer_id")
    n, t = s.count(), s.where("is_test").count()
    assert n == e.count() and 0.2 < t / n < 0.4


def test_forest_probabilities_and_importances(spark, sales):
    rows = CH.train_test_split(CH.churn_features_row(sales, AS_OF), "invoice_id")
    model = CH.churn_train(rows, num_trees=20, seed=42)
    scored = model.score(rows.where("is_test"))
    p = scored.agg(F.min("probability_1"), F.max("probability_1")).first()
    assert 0.0 <= p[0] <= p[1] <= 1.0
    imp = model.importances(spark).collect()
    assert math.isclose(sum(r.importance for r in imp), 1.0, rel_tol=1e-9)
    acc = CH.churn_accuracy(scored).first().accuracy
    majority = max(rows.where("is_test").agg(F.avg("churn")).first()[0], 1 - rows.where("is_test").agg(F.avg("churn")).first()[0])
    assert acc >= majority


def test_forecast_recovers_planted_signal(spark):
    start = dt.date(2022, 1, 1)
    rows = []
    for i in range(730):
        d = start + dt.timedelta(days=i)
        weekly = 20.0 if d.weekday() >= 5 else 0.0
        rows.append((dt.datetime(d.year, d.month, d.day), 1000.0 + 0.5 * i + weekly))
    df = spark.createDataFrame(rows, "date timestamp, total double")
    out = FC.sales_forecast(df, periods=30, yearly=False).orderBy("ds").collect()
    assert len(out) == 760
    for r in out:
        assert r.yhat_lower <= r.yhat <= r.yhat_upper
        assert math.isclose(r.trend + r.weekly, r.yhat, rel_tol=1e-9)
    for r in out[-30:]:
        i = (r.ds - start).days
        truth = 1000.0 + 0.5 * i + (20.0 if r.ds.weekday() >= 5 else 0.0)
        assert abs(r.yhat - truth) / truth < 0.01


def test_forecast_keeps_a_planted_break_and_widens(spark):
    start = dt.date(2022, 1, 1)
    truth = [500.0 + 2.0 * i - (3.0 * (i - 300) if i > 300 else 0.0) for i in range(790)]
    rows = [(dt.datetime(2022, 1, 1) + dt.timedelta(days=i), truth[i] + 8.0 * math.sin(i * 12.9898)) for i in range(730)]
    df = spark.createDataFrame(rows, "date timestamp, total double")
    out = FC.sales_forecast(df, periods=60, yearly=False).orderBy("ds").collect()
    assert all(abs(r.yhat - truth[(r.ds - start).days]) < 15 for r in out)
    widths = [r.yhat_upper - r.yhat_lower for r in out]
    assert max(widths[:730]) - min(widths[:730]) < 1e-9 and all(a < b for a, b in zip(widths[730:], widths[731:]))
    model = FC.fit_forecast(FC.materialized_series(df), yearly=False)
    changes = [c for n, c in model.coef.items() if n.startswith("cp")]
    assert sum(abs(c) < 1e-6 for c in changes) >= 15  # sparse


def test_daily_season_of_an_hourly_series(spark):
    start = dt.datetime(2024, 1, 1)
    y = lambda at: 100.0 + (30.0 if 10 <= at.hour < 18 else 0.0) + at.hour
    hours = [start + dt.timedelta(hours=i) for i in range(24 * 60)]
    df = spark.createDataFrame([(h, y(h)) for h in hours], "date timestamp, total double")
    out = FC.sales_forecast(df, periods=3, yearly=False, daily=True).orderBy("ds").collect()
    assert len(out) == 24 * 63 and {"daily", "weekly", "trend"} <= set(out[0].asDict())
    assert all(math.isclose(r.trend + r.weekly + r.daily, r.yhat, rel_tol=1e-9) for r in out)
    mean = [sum(r.yhat for r in out[-72:] if r.ds.hour == h) / 3 for h in range(24)]
    assert all(abs(m - y(start.replace(hour=h))) < 12 for h, m in enumerate(mean))  # four harmonics of a step


def test_multiplicative_forecast_recovers_a_product(spark):
    start = dt.date(2022, 1, 1)

    def truth(i):
        d = start + dt.timedelta(days=i)
        return (300.0 + 1.0 * i) * (1.3 if d.weekday() == 5 else 0.0 if d.weekday() == 6 else 0.94)

    rows = [(dt.datetime(2022, 1, 1) + dt.timedelta(days=i), truth(i)) for i in range(700)]  # no sales on Sundays
    df = spark.createDataFrame(rows, "date timestamp, total double")
    out = FC.sales_forecast_multiplicative(df, periods=28).orderBy("ds").collect()
    for r in out[-28:]:
        assert abs(r.yhat - truth((r.ds - start).days)) < 60
        assert math.isclose(r.trend * (1 + r.weekly + r.yearly + r.monthly), r.yhat, rel_tol=1e-9, abs_tol=1e-6)


def test_multiplicative_forecast_positive(sales):
    out = FC.sales_forecast_multiplicative(sales, periods=7)
    r = out.agg(F.min("yhat"), F.count(F.lit(1))).first()
    assert r[0] > 0 and r[1] == FC.forecast_series(sales).count() + 7


def test_forecast_by_group_recovers_each_group(spark):
    start = dt.date(2022, 1, 1)
    rows = []
    for g, (base, slope) in {"a": (500.0, 1.0), "b": (2000.0, -0.5)}.items():
        for i in range(400):
            d = start + dt.timedelta(days=i)
            rows.append((g, dt.datetime(d.year, d.month, d.day), base + slope * i + (15.0 if d.weekday() == 0 else 0.0)))
    df = spark.createDataFrame(rows, "product_line string, date timestamp, total double")
    out = FC.forecast_by_group(df, "product_line", periods=14).collect()
    assert len(out) == 2 * (400 + 14)
    for r in out:
        assert r.yhat_lower <= r.yhat <= r.yhat_upper
        i = (r.ds - start).days
        base, slope = (500.0, 1.0) if r.product_line == "a" else (2000.0, -0.5)
        truth = base + slope * i + (15.0 if r.ds.weekday() == 0 else 0.0)
        assert abs(r.yhat - truth) / truth < 0.02


def test_suggestions_ordered_with_kinds(spark):
    from tillsight.operators import insights as IN
    from tillsight.plans.catalog_analytics import labelled, standin
    from tillsight.functions import expressions as X
    s = labelled(spark, SF_SMALL).withColumn("hour", X.hour_of_time("time"))
    out = IN.business_suggestions(s, forecast=standin(spark, SF_SMALL))
    rows = out.collect()
    ranks = [r["rank"] for r in rows]
    assert len(ranks) == len(set(ranks)) and {10, 11, 30, 31} <= set(ranks)
    colours = {c for _, _, c in IN.MARKS} | {"warning", "info"}
    assert all(r.colour in colours and r.text for r in rows)
    kinds = out.select("symbol", "colour", IN.insight_kind("text").alias("k")).collect()
    assert all((r.symbol, r.colour) == (r.k.symbol, r.k.colour) for r in kinds)


def test_churn_recommendations_rules(spark):
    from tillsight.operators import insights as IN
    summ = spark.createDataFrame([(40, 100, 40.0, 60.0)], "churned bigint, entities bigint, churn_rate double, retention_rate double")
    imp = spark.createDataFrame([("days_since_last", 0.9), ("total", 0.1)], "feature string, importance double")
    got = {r["rank"]: r for r in IN.churn_recommendations(summ, imp).collect()}
    assert set(got) == {1, 2, 3} and got[2].code == "win_back"
    low = spark.createDataFrame([(10, 100, 10.0, 90.0)], "churned bigint, entities bigint, churn_rate double, retention_rate double")
    assert {r["rank"] for r in IN.churn_recommendations(low, imp).collect()} == {2, 3}
