"""Uploads with odd keys and bytes, fills, quantiles, and fits that do not depend on partitioning."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillsight.operators import aggregate as A
from tillsight.operators import churn as CH
from tillsight.operators import clean as C
from tillsight.operators import ranking as R
from tillsight.operators import segment as SG
from tillsight.operators.stats import cut_points, exact_quantiles
from tillsight.plans.pipelines import clean_basic
from tillsight.sources import files as IO


def filled(rows):
    """Fill in order of (key, nulls first; then value, nulls first)."""
    out, last = [], None
    for k, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, r[1] is not None, r[1] or 0)):
        last = v if v is not None else last
        out.append((k, last))
    return sorted(out, key=repr)


KEYS = {
    "text": lambda i: f"INV-{i:05d}", "number": lambda i: i, "all null": lambda i: None,
    "mostly null": lambda i: i if i % 10 == 0 else None,
}


@pytest.mark.parametrize("kind", KEYS)
@pytest.mark.parametrize("parts", [1, 16])
def test_fill_on_any_key(spark, kind, parts):
    rows = [(KEYS[kind](i), float(i) if i % 4 else None) for i in range(400)]
    schema = f"k {'string' if kind == 'text' else 'long'}, v double"
    df = spark.createDataFrame(rows, schema).repartition(parts)
    assert sorted([tuple(r) for r in C.forward_fill(df, "k").collect()], key=repr) == filled(rows)


def test_fill_of_nothing(spark):
    assert C.forward_fill(spark.createDataFrame([], "k string, v double"), "k").collect() == []


def test_empty_upload_is_cleaned(spark):
    none = IO.csv_scan_fallback(spark, "/no/such/folder")
    assert clean_basic(none, none.columns).collect() == []


def test_fallback_reads_files_of_any_size(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("Invoice ID,Total,Gender\nINV-1,2.5,Frau Müller\nINV-2,3,x\n".encode("latin1"))
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "10")
    try:
        rows = IO.csv_scan_fallback(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert [(r.invoice_id, r.total, r.gender) for r in rows] == [("INV-1", 2.5, "Frau Müller"), ("INV-2", 3.0, "x")]


def test_other_header_order_is_not_read_by_position(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Gender,Payment\nFemale,Cash\n")
    (tmp_path / "b.csv").write_text("Payment,Gender\nCash,Female\n")
    with pytest.raises(Exception, match="(?i)header"):
        IO.csv_scan(spark, str(tmp_path)).collect()


def test_records_keep_other_keys(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"Total": 2.5, "Rating": 9.1}\n{"Branch": "A", "Total": 1}\n')
    rows = {r.total: (r.Rating, r.Branch) for r in IO.records_scan(spark, str(tmp_path)).collect()}
    assert rows == {2.5: ("9.1", None), 1.0: (None, "A")}


def test_cluster_without_shared_folder_is_an_error():
    from tillsight.session import ensure_checkpoint_dir

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())


def model_rows(spark, parts):
    rows = [(i, math.sin(i) * 50 + 60, i % 9, (i * 37) % 90, int(i % 90 > 45 or i % 7 == 0)) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, total double, quantity int, days_since_last int, churn int")
    return df.withColumn("avg_purchase_value", F.col("total") / 3).repartition(parts)


def test_a_fit_task_takes_a_bounded_number_of_rows():
    from tillsight.session import FIT_ROWS, fit_partitions
    assert [fit_partitions(n) for n in (0, 1, 50_001, 400_000)] == [1, 1, 2, 8]
    assert all(n / fit_partitions(n) <= FIT_ROWS for n in (10**6, 25_200_000, 151_200_000, 10**9))


def test_models_do_not_depend_on_partitions(spark):
    trees, labels = [], []
    for parts in (2, 40):
        df = model_rows(spark, parts)
        trees.append(CH.churn_train(df, num_trees=5).model.toDebugString.split("\n", 1)[1])
        seg = SG.segment_customers(df, ("total", "quantity"), k=3)
        labels.append({r.id: r.cluster for r in seg.collect()})
    assert trees[0] == trees[1] and labels[0] == labels[1]


def test_scores_keep_rows_with_null_features(spark):
    df = model_rows(spark, 3)
    model = CH.churn_train(df, num_trees=5)
    holed = df.withColumn("total", F.when(F.col("id") % 5 != 0, F.col("total")))
    out = model.score(holed).collect()
    assert len(out) == 600
    assert all((r.probability_1 is None) == (r.id % 5 == 0) for r in out)


def test_median_of_integers_lies_between(spark):
    df = spark.createDataFrame([(5,), (6,), (None,)], "q int")
    assert sorted(r.q for r in C.impute_median(df).collect()) == [5.0, 5.5, 6.0]


@pytest.mark.parametrize("accuracy", [5, 100, 100000])
def test_quantiles_with_coarse_sketches(spark, accuracy):
    rng = np.random.default_rng(3)
    data = {"u": rng.random(3000), "ties": rng.integers(0, 4, 3000).astype(float), "one": np.full(3000, 2.0)}
    rows = [(i % 3, *(float(data[c][i]) if i % 11 else None for c in data)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g int, u double, ties double, one double").repartition(5)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    for group in ([], ["g"]):
        got = {(r["g"] if group else 0, r.column, r.p): r.value for r in exact_quantiles(df, list(data), probs, group, accuracy).collect()}
        for g in range(3 if group else 1):
            for c in data:
                v = [r[1 + list(data).index(c)] for r in rows if r[1] is not None and (not group or r[0] == g)]
                for p in probs:
                    assert got[g, c, p] == pytest.approx(float(np.quantile(v, p)), abs=1e-12)


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan")


def test_inputs_are_scanned_once(spark):
    from tillsight.plans.catalog_base import events_hourly
    e = events_hourly(spark, "/root/testdata/sf0.001")
    for df in (A.weekly_sales(e), R.week_over_week(e), A.peak_day_hours(e)):
        assert scans(df) == 1


def test_keyset_pages_walk_the_table(spark):
    df = spark.createDataFrame([(i % 4, i) for i in range(30)], "a int, b int")
    seen, last = [], None
    while page := R.page_after(df, 7, ["a", "b"], last).collect():
        seen += [tuple(r) for r in page]
        last = tuple(page[-1])
    assert seen == sorted(tuple(r) for r in df.collect())


def test_clusters_match_plain_lloyd(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.3, (200, 2)) for c in ((0, 0), (4, 1), (1, 5))])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in x] + [(None, 1.0), (float("nan"), 2.0), (float("inf"), 0.0)], "a double, b double")
    scale, runs = SG.fit_clusters(df, ["a", "b"], ks=(2, 3, 4), restarts=4)
    assert len(runs) == 12
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    best = {k: min((r for r in runs if r[0] == k), key=lambda r: r[2]) for k in (2, 3, 4)}
    for k, (_, _, cost, centers) in best.items():
        d = ((z[:, None] - centers[None]) ** 2).sum(axis=2)
        assert cost == pytest.approx(d.min(axis=1).sum(), rel=1e-3)
        own = d.argmin(axis=1)  # settled: every center is the mean of its points
        assert np.allclose([z[own == j].mean(axis=0) for j in range(k)], centers, atol=1e-3)
    assert best[2][2] > best[3][2] > best[4][2]
    got = SG.segment_customers(df, ["a", "b"], k=3, restarts=4).groupBy("cluster").count().collect()
    assert {r["cluster"]: r["count"] for r in got} == {0: 200, 1: 200, 2: 200, None: 3}


def test_restarts_share_one_scan_per_iteration(spark, monkeypatch):
    df = model_rows(spark, 3)
    jobs = []
    collect = type(df).collect

    def counted(self):
        if "far" in self.columns:
            jobs.append(self._jdf.queryExecution().executedPlan().toString().count("FileScan"))
        return collect(self)

    monkeypatch.setattr(type(df), "collect", counted)
    _, runs = SG.fit_clusters(df, ("total", "quantity"), ks=(2, 3, 4, 5, 6), restarts=10, max_iter=6)
    assert len(runs) == 50 and 1 <= len(jobs) <= 7 and set(jobs) == {1}


def test_clusters_of_few_points(spark):
    schema = "total double, quantity int"
    assert SG.segment_customers(spark.createDataFrame([], schema), ("total", "quantity")).collect() == []
    same = spark.createDataFrame([(1.0, 2)] * 5 + [(None, 2)], schema)
    assert {r["cluster"] for r in SG.segment_customers(same, ("total", "quantity")).collect()} == {0, None}


def test_correlations_of_many_columns(spark):
    """300 columns with holes: pairwise-complete r; a column without values, and a constant one, correlate with nothing."""
    from tillsight.operators.correlate import correlation_matrix
    rng = np.random.default_rng(6)
    x = rng.normal(size=(40, 300)) @ np.diag(rng.random(300) * 100) + 1e6
    x[:, 7] = 3.0
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 9] = np.nan
    names = [f"c{i}" for i in range(300)]
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in row) for row in x], ", ".join(f"{n} double" for n in names))
    got = {(r["i"], r["j"]): r["r"] for r in correlation_matrix(df, names).collect()}
    assert len(got) == 90_000
    for i, j in [(0, 1), (1, 0), (5, 5), (17, 250), (299, 3), (100, 101), (7, 8), (9, 2), (9, 9), (7, 7)]:
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        if 7 in (i, j) or 9 in (i, j):
            assert got[i, j] is None
        else:
            assert got[i, j] == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-9)
    assert correlation_matrix(df.limit(0), names[:3]).where("r is null").count() == 9


def test_suggestions_read_their_copy_twice(spark, monkeypatch):
    from tillsight.operators import insights as IN
    plans, write = [], IN.materialize

    def counted(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString().count("Relation ["))
        return write(df)

    monkeypatch.setattr(IN, "materialize", counted)
    df = model_rows(spark, 3).withColumns({"date": F.expr("date_add(date'2024-01-01', cast(id % 90 as int))"), "cluster": F.col("id") % 3,
                                          "product_line": F.concat(F.lit("p"), F.col("id") % 5)})
    df = write(df)
    out = IN.business_suggestions(df, corr_cols=["total", "quantity"])
    # The copy, then every sum and the correlations from one scan of it each; the rules read those.
    assert plans == [1, 1, 1] and out.count() >= 4


def many_rows(spark, parts):
    """More rows than two features have pairs of bins: 1,600 pairs of values, most of them twice or more."""
    d = spark.range(6000).select(((F.col("id") * 7919) % 40).alias("total"), F.pmod(F.xxhash64("id"), F.lit(4000)).alias("q"))
    noise = F.pmod(F.xxhash64("total", "q"), F.lit(10)) == 0
    return d.withColumn("churn", (((F.col("total") > 25) | (F.col("q") < 700)) != noise).cast("int")).repartition(parts)


def test_a_forest_takes_cells_of_many_rows(spark, monkeypatch):
    fitted, fit = [], CH.RandomForestClassifier._fit
    monkeypatch.setattr(CH.RandomForestClassifier, "_fit", lambda self, d: fitted.append(d.count()) or fit(self, d))
    models = [CH.churn_train(many_rows(spark, parts), ("total", "q"), num_trees=6) for parts in (2, 9)]
    assert max(fitted) <= 2 * 32 ** 2 < 6000
    assert len({m.model.toDebugString.split("\n", 1)[1] for m in models}) == 1
    assert len(models[0].model.trees) == 6 and math.isclose(sum(r.importance for r in models[0].importances(spark).collect()), 1)


def test_cells_count_all_rows_and_draw_as_rows_do(spark):
    rows = many_rows(spark, 3)
    cells = CH.bagged_cells(rows, cut_points(rows, ["total", "q"], 32), "churn", 40, seed=7).toPandas()
    n, w = cells["n"].to_numpy(), cells[[f"w{i}" for i in range(40)]].to_numpy()
    assert n.sum() == 6000 and len(cells) <= 2 * 32 ** 2
    assert abs(w.sum() / 40 - 6000) < 5 * math.sqrt(6000 / 40)
    # Poisson(n): the variance is n as well.
    assert np.mean((w - n[:, None]) ** 2 / n[:, None]) == pytest.approx(1, abs=0.1)
    assert len({tuple(x) for x in w.T}) == 40


def test_a_forest_on_cells_scores_as_one_on_rows(spark, monkeypatch):
    rows = many_rows(spark, 4).withColumn("id", F.monotonically_increasing_id())
    rows = spark.createDataFrame(rows.collect())
    on_cells = CH.churn_train(rows, ("total", "q"), num_trees=30)
    monkeypatch.setattr(CH, "MAX_BINS", 1000)
    on_rows = CH.churn_train(rows, ("total", "q"), num_trees=30)
    assert on_cells.points and not on_rows.points
    holed = rows.withColumn("total", F.when(F.col("id") % 5 != 0, F.col("total")))
    a, b = ({r.id: r for r in m.score(holed).collect()} for m in (on_cells, on_rows))
    assert len(a) == 6000 and all((r.probability_1 is None) == (i % 5 == 0) for i, r in a.items())
    known = [i for i, r in a.items() if r.probability_1 is not None]
    assert np.mean([abs(a[i].probability_1 - b[i].probability_1) for i in known]) < 0.05
    right = [np.mean([m[i].predicted == m[i].churn for i in known]) for m in (a, b)]
    assert abs(right[0] - right[1]) < 0.03 and min(right) > 0.8


def test_cut_points_are_exact(spark):
    rng, n = np.random.default_rng(1), 5000
    data = {"wide": rng.lognormal(3, 2, n), "few": rng.integers(0, 5, n).astype(float), "one": np.full(n, 7.0),
            "heavy": np.where(rng.random(n) < 0.98, 0.0, rng.random(n)), "rare": (np.arange(n) == 77).astype(float),
            "far": np.where(rng.random(n) < 0.01, np.inf, rng.normal(size=n))}
    df = spark.createDataFrame([(*map(float, r),) for r in zip(*data.values())], list(data))
    got = cut_points(df.repartition(2), list(data), 32)
    assert got == cut_points(df.repartition(11), list(data), 32) == cut_points(df, list(data), 32, accuracy=20)
    for c in ("wide", "far"):
        x = np.sort(data[c][np.isfinite(data[c])])
        assert got[c] == [x[(len(x) - 1) * i // 32] for i in range(1, 32)]
    assert got["few"] == [1, 2, 3, 4] and got["one"] == [] and got["rare"] == [1]
    assert got["heavy"][0] == 0 and 0 < got["heavy"][1] <= data["heavy"][data["heavy"] > 0].min()
    assert cut_points(df.where("wide < 0"), list(data), 32) == {c: [] for c in data}
