"""Pages by an index of ranges, and whole rows deduplicated by digest."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from tillsight.operators import clean as C
from tillsight.operators import ranking as R


@pytest.fixture
def many_ranges(spark):
    """Ranges are not merged, however few rows they have."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def plan_of(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.fixture
def hot(spark):
    """A key that holds two thirds of all rows, NULLs, and other columns that break ties."""
    return spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.pmod(F.hash("id"), F.lit(50)))
                                     .when(F.col("id") % 7 != 0, F.lit(7)).alias("a"), F.col("id").alias("b"))


@pytest.mark.parametrize("order", ["ties", "unique", "falling"])
def test_pages_of_an_index_make_the_table(spark, many_ranges, hot, order):
    order = {"ties": ["a"], "unique": ["a", "b"], "falling": [F.desc("a"), F.desc("b")]}[order]
    index = R.page_index(hot, order)
    assert index.ranges.count() > 4 and index.total == 3000
    ties = [] if len(order) == 2 else ["b"]
    want = [tuple(r) for r in hot.orderBy(*order, *ties).collect()]
    for no, size in ((1, 7), (2, 500), (6, 500), (300, 10), (1, 3000), (3, 1400)):
        got = R.page_at(index, no, size).collect()
        assert [(r.a, r.b) for r in got] == want[(no - 1) * size:no * size]
        assert all(r.pages == -(-3000 // size) for r in got)
    assert R.page_at(index, 301, 10).collect() == []


def test_a_deep_page_reads_the_ranges_that_hold_it(spark, many_ranges, hot):
    index = R.page_index(hot, ["a", "b"])
    plan = plan_of(R.page_at(index, 250, 10))
    read = re.search(r"PartitionFilters: \[(.*?)\]", plan).group(1)
    assert "_range" in read and len(re.findall(r"\d+", read.split("_range", 1)[1])) <= 4


def test_deep_pages_equal_ordered_rows(spark, hot, monkeypatch):
    want = hot.orderBy("a", "b").collect()
    for shallow in (0, 10_000):
        monkeypatch.setattr(R, "SHALLOW", shallow)
        got = R.page(hot, 41, 50, ["a", "b"])
        assert got.columns == ["a", "b", "pages"]
        assert [(r.a, r.b) for r in got.collect()] == [tuple(r) for r in want[2000:2050]]
        assert R.page(hot.where("false"), 1, 5, ["a"]).collect() == []


AWKWARD = [(1, "a", 1.0), (1, "a", 1.0), (None, "a", None), (None, "a", None), (None, None, None), (None, None, None),
           (1, None, None), (2, "", 0.0), (2, "", -0.0), (3, "x", float("nan")), (3, "x", float("nan")), (4, "y", 2.0)]


@pytest.mark.parametrize("most", [10**6, 1])
def test_rows_are_distinct_whatever_way(spark, most):
    df = spark.createDataFrame(AWKWARD * 3, "`_h1` int, `b.c` string, n double").repartition(5)
    got, want = C.dedupe(df, broadcast_digests=most), df.dropDuplicates()
    assert got.columns == df.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert C.dedupe(df.where("false"), broadcast_digests=most).collect() == []


@pytest.mark.parametrize("most", [10**6, 1])
def test_rows_that_share_a_digest_by_chance_stay(spark, monkeypatch, most):
    monkeypatch.setattr(C.F, "xxhash64", lambda *_: F.lit(5).cast("long"))
    df = spark.createDataFrame(AWKWARD, "a int, b string, n double")
    assert sorted(map(repr, C.dedupe(df, broadcast_digests=most).collect())) == sorted(map(repr, df.dropDuplicates().collect()))


def test_rows_without_a_copy_are_not_shuffled(spark):
    df = spark.range(1000).select("id", F.lit("x").alias("wide"))
    plan = plan_of(C.dedupe(df))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    moved = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*?)\]", plan)
    assert len(moved) == 1  # of the rows whose digest repeats


def test_neighbours_in_ranges_are_distinct_and_filled(spark):
    df = spark.createDataFrame(AWKWARD * 3, "`_h1` int, `b.c` string, n double").repartition(5).toDF("_h1", "b", "n")
    ranged = C.by_ranges(df, ["_h1", "b"])
    got = C.dedupe(ranged, ranged=True)
    shown = lambda rows: sorted(repr(tuple(r)).replace("-0.0", "0.0") for r in rows)
    assert shown(got.collect()) == shown(df.dropDuplicates().collect())
    nested = df.select("_h1", F.array("b", "b").alias("a"), F.struct("n").alias("s"))
    assert shown(C.dedupe(C.by_ranges(nested, "_h1"), ranged=True).collect()) == shown(nested.dropDuplicates().collect())
    seen, want = [None] * 3, []
    for r in sorted(got.collect(), key=lambda r: [(v is not None, v != v, 0 if v is None or v != v else v) for v in r]):
        seen = [old if new is None else new for old, new in zip(seen, r)]
        want.append(tuple(seen))
    assert shown(C.forward_fill(got, ["_h1", "b"], cols=df.columns, ranged=True).collect()) == shown(want)


def test_clean_rows_move_into_ranges_once(spark):
    from tillsight.plans.pipelines import clean_basic
    cols = ["invoice_id", "date", "time", "total"]
    df = spark.range(500).selectExpr("id % 100 as invoice_id", "'2024-01-02' as date", "'10:00' as time",
                                     "if(id % 3 = 0, null, double(id % 7)) as total")
    out = clean_basic(df, cols)
    assert out.count() == df.dropDuplicates().count()
    assert "hashpartitioning" not in plan_of(out)  # the rows of the last step are not dealt again
    plan = plan_of(C.dedupe(C.by_ranges(df, cols), ranged=True))
    assert plan.count("rangepartitioning") and "hashpartitioning" not in plan


def test_broken_rows_join_the_view_once(spark):
    from conftest import SF_SMALL
    from tillsight.plans.catalog_base import dirty_sales
    assert plan_of(dirty_sales(spark, SF_SMALL)).count("lineitem.parquet") == 1
