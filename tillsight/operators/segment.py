"""Customer segmentation (M1-M6, P7, J3): k-means by batched Lloyd iterations.

Scaling is the population z-score (T6, not MLlib's sample-std scaler); the
scaling constants are one global aggregate attached by broadcast. Clusters are
renumbered by the mean of the first feature (Total) so labels are stable across
runs and seeds. Rows with a NULL feature keep a NULL label (J3).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillsight.operators.stats import attach_scalars
from tillsight.session import materialize

#: Rows that starts are drawn from, about.
START_ROWS = 10_000
#: A run has settled when its centers move, or its cost falls, by less (of 1).
TOLERANCE, GAIN = 1e-4, 1e-4


def zscore(df: DataFrame, cols, suffix: str = "_z") -> DataFrame:
    """(x - mean) / population std per column; zero variance -> 0."""
    cols = list(cols)
    stats = df.agg(*[F.avg(c).alias(f"_mu_{c}") for c in cols],
                   *[F.stddev_pop(c).alias(f"_sd_{c}") for c in cols])
    out = attach_scalars(df, stats)
    z = {f"{c}{suffix}": F.coalesce(F.try_divide(F.col(c) - F.col(f"_mu_{c}"), F.col(f"_sd_{c}")),
                                    F.when(F.col(c).isNotNull(), F.lit(0.0)))
         for c in cols}
    return out.withColumns(z).drop(*[f"_mu_{c}" for c in cols], *[f"_sd_{c}" for c in cols])


def _valid(feats) -> Column:
    """Rows whose features are all finite numbers."""
    known = F.lit(True)
    for c in feats:
        x = F.col(c).cast("double")
        known = known & x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return known


def _start_rows(points: DataFrame, n: int, size: int = START_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct points of about ``size`` rows, chosen by a hash of their values, and how many rows each stands for."""
    share = max(1, n // size)
    drawn = points.where(F.pmod(F.xxhash64(*points.columns), F.lit(share)) == 0)
    rows = drawn.groupBy(*points.columns).agg(F.count(F.lit(1)).alias("_w")).orderBy(*points.columns).limit(4 * size).collect()
    if not rows:  # few different points, none of them drawn
        rows = points.groupBy(*points.columns).agg(F.count(F.lit(1)).alias("_w")).orderBy(F.desc("_w"), *points.columns).limit(size).collect()
    table = np.array([tuple(r) for r in rows], float).reshape(len(rows), len(points.columns) + 1)
    return table[:, :-1], table[:, -1]


def _distances(rows: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return ((rows[:, None, :] - centers[None, :, :]) ** 2).sum(axis=2)


def _start(rows: np.ndarray, weights: np.ndarray, k: int, seed: int, max_iter: int = 200) -> np.ndarray:
    """Weighted k-means++ on the drawn rows, brought to rest on them alone: few scans of all points are left to do."""
    draw = np.random.RandomState(seed)
    centers = rows[[draw.choice(len(rows), p=weights / weights.sum())]]
    while len(centers) < k:
        far = weights * _distances(rows, centers).min(axis=1)
        if far.sum() <= 0:
            break
        centers = np.vstack([centers, rows[draw.choice(len(rows), p=far / far.sum())]])
    for _ in range(max_iter):
        own = _distances(rows, centers).argmin(axis=1)
        moved = np.array([np.average(rows[own == j], axis=0, weights=weights[own == j]) if (own == j).any() else centers[j] for j in range(len(centers))])
        if np.abs(moved - centers).max() < TOLERANCE:
            break
        centers = moved
    return centers


def _nearest(zs: list[Column], centers: np.ndarray) -> Column:
    """struct(distance, number) of the nearest center; the first on ties."""
    return F.array_min(F.array(*[F.struct(reduce(Column.__add__, [(z - F.lit(float(x))) * (z - F.lit(float(x))) for z, x in zip(zs, center)]).alias("far"),
                                          F.lit(j).alias("no")) for j, center in enumerate(centers)]))


def fit_clusters(df: DataFrame, features, ks=(3,), seed: int = 42, restarts: int = 1, max_iter: int = 20):
    """Batched Lloyd: k-means for every k of ``ks`` and every restart, one scan of the points per iteration.

    Returns (scale, runs): the mean and population std per feature, and a list of
    (k, restart, cost, centers) in z-scores, centers in ascending order. The points are
    written once; starts come from a bounded sample by a hash of the values; an
    iteration reads the points in Arrow batches. Neither depends on how the input is partitioned. Runs
    that have settled leave the batch. Identical rows may leave fewer centers than k;
    without a valid row there are no runs.
    """
    feats = list(features)
    points = materialize(df.where(_valid(feats)).select(*[F.col(c).cast("double").alias(c) for c in feats]))
    scale = points.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"mu_{c}") for c in feats], *[F.stddev_pop(c).alias(f"sd_{c}") for c in feats]).first()
    if not scale["n"]:
        return scale, []
    sample, weights = _start_rows(points, scale["n"])
    mu, sd = np.array([scale[f"mu_{c}"] for c in feats]), np.array([scale[f"sd_{c}"] for c in feats])
    sample = np.divide(sample - mu, sd, out=np.zeros_like(sample), where=sd > 0)
    live = {(k, r): _start(sample, weights, k, seed + r) for k in ks for r in range(max(1, restarts))}
    done, before = [], {}
    for step in range(max_iter + 1):
        keys = list(live)
        cost, moved = _lloyd_step(points, mu, sd, [live[key] for key in keys])
        for i, key in enumerate(keys):
            settled = np.abs(moved[i] - live[key]).max() < TOLERANCE or before.get(key, np.inf) - cost[i] <= GAIN * cost[i]
            if step == max_iter or settled:
                done.append((*key, cost[i], np.unique(live.pop(key), axis=0)))
            else:
                live[key], before[key] = moved[i], cost[i]
        if not live:
            break
    return scale, sorted(done, key=lambda d: (d[0], d[1]))


def _lloyd_step(points: DataFrame, mu: np.ndarray, sd: np.ndarray, runs: list[np.ndarray]) -> tuple[list[float], list[np.ndarray]]:
    """Cost of every run's centers and the means of the points nearest to each, from one scan.

    A task adds up its batches in arrays and gives one row per run and center; these are
    summed by an aggregate, so what reaches the driver does not grow with the data.
    """
    width = len(mu)
    schema = pa.schema([("run", pa.int32()), ("no", pa.int32()), ("n", pa.int64()), ("far", pa.float64()), ("at", pa.list_(pa.float64()))])

    def partial(batches):
        n = [np.zeros(len(c), np.int64) for c in runs]
        far, at = [np.zeros(len(c)) for c in runs], [np.zeros((len(c), width)) for c in runs]
        for batch in batches:
            z = np.column_stack([c.to_numpy() for c in batch.columns]) - mu
            z = np.divide(z, sd, out=np.zeros_like(z), where=sd > 0)
            for i, centers in enumerate(runs):
                d = ((z[:, None, :] - centers[None, :, :]) ** 2).sum(axis=2)
                own = d.argmin(axis=1)
                n[i] += np.bincount(own, minlength=len(centers))
                far[i] += np.bincount(own, d[np.arange(len(d)), own], len(centers))
                for f in range(width):
                    at[i][:, f] += np.bincount(own, z[:, f], len(centers))
        rows = [(i, j, int(n[i][j]), float(far[i][j]), at[i][j].tolist()) for i in range(len(runs)) for j in range(len(runs[i])) if n[i][j]]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    parts = points.mapInArrow(partial, "run int, no int, n long, far double, at array<double>")
    sums = parts.groupBy("run", "no").agg(F.sum("n").alias("n"), F.sum("far").alias("far"),
                                          *[F.sum(F.get("at", F.lit(f))).alias(f"s{f}") for f in range(width)]).collect()
    cost, moved = [0.0] * len(runs), [c.copy() for c in runs]
    for r in sorted(sums, key=lambda r: (r["run"], r["no"])):
        cost[r["run"]] += r["far"]
        # Rounded: the order of the sums must not decide when a run has settled.
        moved[r["run"]][r["no"]] = [round(r[f"s{f}"] / r["n"], 12) for f in range(width)]
    return cost, moved


def _zed(c: str, scale) -> Column:
    mu, sd = scale[f"mu_{c}"], scale[f"sd_{c}"]
    return (F.col(c).cast("double") - F.lit(mu)) / F.lit(sd) if sd else F.lit(0.0)


def segment_customers(df: DataFrame, features=("total", "quantity", "unit_price"), k: int = 3,
                      seed: int = 42, restarts: int = 1, label: str = "cluster", max_iter: int = 20) -> DataFrame:
    """M1 / M2: k-means on z-scored features; the best of ``restarts`` starts by cost.

    Only the k centers are on the driver; the input is scored by a plain expression of
    them, numbered by their first feature. Rows with a NULL, NaN or infinite feature keep
    a NULL label.
    """
    feats = list(features)
    scale, runs = fit_clusters(df, feats, (k,), seed, restarts, max_iter)
    if not runs:
        return df.withColumn(label, F.lit(None).cast("int"))
    centers = min(runs, key=lambda r: (r[2], r[1]))[3]
    own = _nearest([_zed(c, scale) for c in feats], centers)["no"]
    return df.withColumn(label, F.when(_valid(feats), own))


def segment_choices(df: DataFrame, features=("total", "quantity", "unit_price"), ks=(2, 3, 4, 5, 6), seed: int = 42,
                    restarts: int = 3, max_iter: int = 20) -> DataFrame:
    """Per number of clusters: clusters found, cost of the best start, share of the variance it explains."""
    scale, runs = fit_clusters(df, features, ks, seed, restarts, max_iter)
    best = {}
    for k, _, cost, centers in runs:
        if k not in best or cost < best[k][0]:
            best[k] = (cost, len(centers))
    whole = scale["n"] * sum(1.0 for c in features if scale[f"sd_{c}"])
    rows = [(k, n, float(cost), 1.0 - cost / whole if whole else None) for k, (cost, n) in sorted(best.items())]
    return df.sparkSession.createDataFrame(rows, "k int, clusters int, cost double, explained double")


def attach_labels(scored: DataFrame, unscored: DataFrame, label: str = "cluster") -> DataFrame:
    """Labelled rows plus the rows that could not be scored, with a NULL label."""
    return scored.unionByName(unscored.withColumn(label, F.lit(None).cast("int")))


def cluster_stats(df, label="cluster", value="total", qty="quantity"):
    """M3: per cluster Total mean/sum/count and Quantity mean/sum."""
    return df.where(F.col(label).isNotNull()).groupBy(label).agg(
        F.avg(value).alias("total_mean"), F.sum(value).alias("total_sum"),
        F.count(value).alias("total_count"), F.avg(qty).alias("quantity_mean"),
        F.sum(qty).cast("long").alias("quantity_sum"))


def cluster_stats_range(df, label="cluster", value="total", qty="quantity"):
    """M4: per cluster Total mean/min/max/count and Quantity mean/min/max."""
    return df.where(F.col(label).isNotNull()).groupBy(label).agg(
        F.avg(value).alias("total_mean"), F.min(value).alias("total_min"),
        F.max(value).alias("total_max"), F.count(value).alias("total_count"),
        F.avg(qty).alias("quantity_mean"), F.min(qty).alias("quantity_min"),
        F.max(qty).alias("quantity_max"))


def cluster_profiles(df, label="cluster", value="total", qty="quantity"):
    """M5: per cluster mean Total and Quantity rounded to 2."""
    return df.where(F.col(label).isNotNull()).groupBy(label).agg(
        F.round(F.avg(value), 2).alias("total_mean"), F.round(F.avg(qty), 2).alias("quantity_mean"))


def cluster_ratios(df, label="cluster", attrs=("gender", "customer_type")) -> DataFrame:
    """M6, whole map: count and share of every value per (cluster, attribute)."""
    items = [F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value")) for a in attrs]
    long = (df.where(F.col(label).isNotNull()).select(label, F.explode(F.array(*items)).alias("kv"))
              .select(label, "kv.attribute", "kv.value").where(F.col("value").isNotNull()))
    counts = long.groupBy(label, "attribute", "value").agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy(label, "attribute")  # a row per value
    return counts.withColumn("share", F.col("n") / F.sum("n").over(every))


def cluster_demographics(df, label="cluster", attrs=None) -> DataFrame:
    """M6: dominant value and its share per (cluster, attribute); top-3 products.

    ``attrs`` maps attribute column -> how many top values to keep. Counts per
    (cluster, attribute, value) come from one aggregate over an unpivot; the
    ranking windows run over those counts, one partition per (cluster,
    attribute), i.e. over distinct values only.
    """
    attrs = attrs or {"gender": 1, "customer_type": 1, "product_line": 3, "payment": 1}
    items = [F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value"))
             for a in attrs]
    long = (df.where(F.col(label).isNotNull())
              .select(label, F.explode(F.array(*items)).alias("kv"))
              .select(label, "kv.attribute", "kv.value").where(F.col("value").isNotNull()))
    counts = long.groupBy(label, "attribute", "value").agg(F.count(F.lit(1)).alias("n"))
    tot = counts.groupBy(label, "attribute").agg(F.sum("n").alias("_tot"))
    w = Window.partitionBy(label, "attribute").orderBy(F.desc("n"), "value")
    keep = F.create_map(*[x for a, n in attrs.items() for x in (F.lit(a), F.lit(n))])
    # The literal bound lets Spark insert a per-task WindowGroupLimit before the
    # shuffle, so each task ships at most max(k) values per (cluster, attribute).
    ranked = (counts.withColumn("rank", F.row_number().over(w))
                    .where(F.col("rank") <= max(attrs.values()))
                    .where(F.col("rank") <= F.element_at(keep, F.col("attribute")))
                    .join(tot, [label, "attribute"]))
    return ranked.select(label, "attribute", "rank", "value", "n",
                         (F.col("n") / F.col("_tot")).alias("share"))
