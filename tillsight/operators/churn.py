"""Churn features, split, random forest and the tables around it.

"Today" is always the ``as_of`` argument (T13). The split is a stable hash of
the entity key, so it does not depend on partitioning or task retries the way
``randomSplit`` does.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import TaskContext, inheritable_thread_target
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillsight.functions import expressions as X
from tillsight.operators.stats import attach_scalars, cut_points
from tillsight.session import deal_for_fit, materialize

ROW_FEATURES = ("total", "quantity", "avg_purchase_value", "days_since_last")
ENTITY_FEATURES = ("total_sum", "total_mean", "quantity_sum", "quantity_mean", "purchases", "days_since_first", "frequency")


def churn_features_row(df, as_of: str, date_col="date", threshold: int = 60,
                       label="churn", subset=None) -> DataFrame:
    """M7: per row P3 + P4 + P5; rows with a NULL (or non-finite feature) in any
    column are dropped, or only in the ``subset`` columns if given.

    An existing ``churn`` column wins over the derived label.
    """
    d = df.where(F.col(date_col).isNotNull()).withColumns({
        "days_since_last": X.days_since(date_col, as_of),
        "avg_purchase_value": X.inf_to_null(X.avg_purchase_value())})
    if label not in d.columns:
        d = d.withColumn(label, X.churn_label("days_since_last", threshold))
    return d.na.drop(subset=list(subset) if subset else None)


def churn_features_entity(df, as_of: str, key="customer_id", date_col="date", value="total",
                          qty="quantity", threshold: int = 30) -> DataFrame:
    """M8: per entity aggregates + days since first / last, frequency, 30-day label."""
    g = (df.where(F.col(key).isNotNull() & F.col(date_col).isNotNull()).groupBy(key).agg(
        F.min(date_col).alias("first_date"), F.max(date_col).alias("last_date"),
        F.count(F.lit(1)).alias("purchases"), F.sum(value).alias("total_sum"),
        F.avg(value).alias("total_mean"), F.sum(qty).cast("long").alias("quantity_sum"),
        F.avg(qty).alias("quantity_mean")))
    g = g.withColumns({"days_since_first": X.days_since("first_date", as_of),
                       "days_since_last": X.days_since("last_date", as_of)})
    return g.withColumns({
        "frequency": X.purchase_frequency("days_since_first", "purchases"),
        "churn": X.churn_label("days_since_last", threshold)})


def split_bucket(key, method: str = "hash") -> F.Column:
    """Bucket 0..9 of a key: ``hash`` = pmod(xxhash64), ``modulo`` = pmod(key, 10)."""
    k = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.xxhash64(k), F.lit(10)) if method == "hash" else F.pmod(k, F.lit(10))


def train_test_split(df, key, test_share: int = 3, method: str = "hash") -> DataFrame:
    """M9: adds ``is_test``; buckets < ``test_share`` of 10 form the test set."""
    return df.withColumn("is_test", split_bucket(key, method) < test_share)


@dataclass
class ChurnModel:
    model: RandomForestClassificationModel
    features: list
    label: str
    points: dict | None = None  # split points per feature, if the trees were grown on bins

    def score(self, df: DataFrame) -> DataFrame:
        """Probability of class 1 and the predicted class for every row.

        A row with a NULL or NaN feature stays, with a NULL probability and class.
        """
        known = F.lit(True)
        for c in self.features:
            known = known & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
        filled = {f"_f_{c}": F.when(known, F.col(c).cast("double")).otherwise(F.lit(0.0)) for c in self.features}
        d, inputs = df.withColumns({**filled, "_known": known}), list(filled)
        if self.points:
            d, inputs = binned(d, {f"_f_{c}": self.points[c] for c in self.features})
        out = self.model.transform(VectorAssembler(inputCols=inputs, outputCol="_features").transform(d))
        return (out.withColumn("probability_1", F.when(F.col("_known"), vector_to_array("probability").getItem(1)))
                   .withColumn("predicted", F.when(F.col("_known"), F.col("prediction")))
                   .drop("_features", "rawPrediction", "probability", "prediction", "_known", *filled, *inputs))

    def importances(self, spark) -> DataFrame:
        """(feature, importance) sorted desc; k rows from the model."""
        imp = self.model.featureImportances.toArray().tolist()
        rows = list(zip(self.features, [float(x) for x in imp]))
        return (spark.createDataFrame(rows, "feature string, importance double")
                     .orderBy(F.desc("importance"), "feature"))


#: Bins of a feature that a tree's splits lie between (MLlib's default).
MAX_BINS = 32
#: Trees grown on cells that are fitted at the same time.
PARALLEL_FITS = 8


def binned(df, points: dict) -> tuple:
    """``df`` with the number of its bin per column of ``points``; and the names of these columns."""
    out = [f"_b_{c}" for c in points]
    splits = [[-math.inf, *(p or [0.0]), math.inf] for p in points.values()]
    return Bucketizer(splitsArray=splits, inputCols=list(points), outputCols=out).transform(df), out


def bagged_cells(rows, points: dict, label: str, num_trees: int, seed: int) -> DataFrame:
    """Rows of the same bins and label as one row, with their number ``n`` and its bootstrap counts
    ``w0``, ``w1``, ... per tree.

    Bagging repeats each row of a tree's sample Poisson(1) times. Over n rows that no tree can tell
    apart these sum to Poisson(n), which is drawn here at once: the samples have the same
    distribution, though other draws than row by row.
    """
    d, bins = binned(rows, points)
    cells = deal_for_fit(materialize(d.groupBy(*bins, F.col(label).cast("double").alias(label)).agg(F.count(F.lit(1)).alias("n"))))
    bags = [f"w{i}" for i in range(num_trees)]

    def draw(batches):
        # Cells lie in partitions and an order of their own (deal_for_fit), so reruns draw alike.
        rng = np.random.default_rng([seed % 2**32, TaskContext.get().partitionId()])
        for batch in batches:
            counts = rng.poisson(batch["n"].to_numpy()[:, None], (len(batch), num_trees)).astype(float)
            yield pd.concat([batch, pd.DataFrame(counts, columns=bags, index=batch.index)], axis=1)

    schema = T.StructType([*cells.schema, *(T.StructField(w, T.DoubleType()) for w in bags)])
    return materialize(cells.mapInPandas(draw, schema))


def _forest_on_cells(cells, bins, label, num_trees, seed, max_depth) -> RandomForestClassificationModel:
    """Each tree grown by MLlib on all cells, weighted by its bootstrap counts."""
    vec = VectorAssembler(inputCols=bins, outputCol="_features").transform(cells)
    # MLlib looks for split points in max(10,000, maxBins^2) of its rows: so many bins that it takes
    # all cells, of which no feature has more than MAX_BINS values.
    rf = RandomForestClassifier(numTrees=1, bootstrap=False, featureSubsetStrategy="sqrt" if num_trees > 1 else "all",
                                featuresCol="_features", labelCol=label, maxDepth=max_depth,
                                maxBins=max(MAX_BINS, math.isqrt(cells.count()) + 1))
    seeds = np.random.default_rng(seed % 2**32).integers(2**62, size=num_trees).tolist()
    fits = rf.fitMultiple(vec, [{rf.weightCol: f"w{i}", rf.seed: s} for i, s in enumerate(seeds)])
    with ThreadPool(PARALLEL_FITS) as pool:
        one = inheritable_thread_target(cells.sparkSession)(lambda: next(fits))
        grown = dict(pool.imap_unordered(lambda _: one(), range(num_trees)))
    sc = cells.sparkSession.sparkContext
    ml = sc._jvm.org.apache.spark.ml.classification
    trees = sc._gateway.new_array(ml.DecisionTreeClassificationModel, num_trees)
    for i, m in grown.items():
        trees[i] = m.trees[0]._java_obj
    forest = RandomForestClassificationModel(ml.RandomForestClassificationModel(trees, len(bins), grown[0].numClasses))
    return forest.setFeaturesCol("_features")


def churn_train(df, features=ROW_FEATURES, label="churn", num_trees: int = 100, seed: int = 42,
                split_col="is_test", max_depth: int = 5) -> ChurnModel:
    """Random forest on the training rows (``is_test`` false).

    Up to MAX_BINS ^ features rows, MLlib bags and fits a copy of features and label
    alone, dealt by the rows' own hash into a number of partitions that grows with their
    count (``fit_partitions``), so that the model does not depend on how the input is
    partitioned. With more rows than features have bins together, rows must share their
    bins, and a tree cannot tell those apart: all rows are counted per cell of bins and
    label (``bagged_cells``), and the trees grow on cells, whose number is bounded.
    """
    feats = list(features)
    train = df.where(~F.col(split_col)) if split_col in df.columns else df
    rows = materialize(train.select(*feats, label).na.drop())
    if rows.count() > MAX_BINS ** len(feats):
        points = cut_points(rows, feats, MAX_BINS)
        cells = bagged_cells(rows, points, label, num_trees, seed)
        model = _forest_on_cells(cells, [f"_b_{c}" for c in feats], label, num_trees, seed, max_depth)
        return ChurnModel(model, feats, label, points)
    vec = VectorAssembler(inputCols=feats, outputCol="_features", handleInvalid="skip").transform(deal_for_fit(rows))
    # Node ids are cached per row between levels (checkpointed every 10
    # iterations into the shared checkpoint folder) instead of re-walking every
    # tree for every row at each level.
    rf = RandomForestClassifier(numTrees=num_trees, seed=seed, featuresCol="_features",
                                labelCol=label, maxDepth=max_depth, cacheNodeIds=True,
                                checkpointInterval=10)
    model = rf.fit(vec.withColumn(label, F.col(label).cast("double")))
    return ChurnModel(model, feats, label)


def churn_accuracy(scored, label="churn", split_col="is_test") -> DataFrame:
    """Accuracy on the test rows and the test size."""
    t = scored.where(F.col(split_col)) if split_col in scored.columns else scored
    return t.agg(F.avg((F.col(label).cast("double") == F.col("predicted")).cast("double")).alias("accuracy"),
                 F.count(F.lit(1)).alias("test_size"))


def at_risk(scored, key="customer_id", p="probability_1", threshold: float = 0.7,
            cols=("days_since_last", "total_sum")) -> DataFrame:
    """Entities with probability above the threshold."""
    return scored.where(F.col(p) > threshold).select(key, p, *cols)


def risk_summary(scored, p="probability_1") -> DataFrame:
    """Count and share per risk bucket."""
    g = (scored.withColumn("risk", X.risk_bucket(p)).where(F.col("risk").isNotNull())
               .groupBy("risk").agg(F.count(F.lit(1)).alias("n")))
    tot = g.agg(F.sum("n").alias("_all"))
    return attach_scalars(g, tot).select("risk", "n", (F.col("n") * 100.0 / F.col("_all")).alias("share_pct"))


def churn_summary(df, label="churn") -> DataFrame:
    """Churned count, entity count, churn and retention rate (%)."""
    one = df.agg(F.sum(F.col(label).cast("long")).alias("churned"), F.count(F.lit(1)).alias("entities"))
    rate = F.try_divide(F.col("churned") * 100.0, F.col("entities"))
    return one.select("churned", "entities", rate.alias("churn_rate"), (F.lit(100.0) - rate).alias("retention_rate"))
