"""Pearson correlation (A15, A16, W5) in one aggregate pass.

A row's values are one array; every pair of columns that are both present in it
(pairwise-complete, as pandas ``corr``) becomes a short row (i, j, x, y), and one hash
aggregate over (i, j) takes covariance and deviations. Its partial sums are a row per
task and pair, and the plan of a wide table does not grow with its columns, so that it
compiles as well. Constant columns give NULL instead of a division error (T5).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Columns up to which the pairs are written out in the plan; more are paired by array functions.
NARROW = 12


def pair_sums(df: DataFrame, cols) -> DataFrame:
    """(i, j, n, r), i <= j, over the rows where columns i and j are both present; no row for pairs that never are."""
    def value(c):
        x = F.col(c).cast("double")
        return F.when(~F.isnan(x), x)

    def aggregated(each):
        r = F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y"))
        return each.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"), r.alias("r"))

    if len(cols) <= NARROW:
        # Spelled out, the pairs stay in generated code.
        v = df.select(*[value(c).alias(f"v{i}") for i, c in enumerate(cols)])
        spelled = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"v{i}").alias("x"), F.col(f"v{j}").alias("y"))
                   for i in range(len(cols)) for j in range(i, len(cols))]
        return aggregated(v.select(F.explode(F.array(*spelled)).alias("p")).select("p.*").where("x is not null and y is not null"))
    values = df.select(F.array(*[value(c) for c in cols]).alias("v"))
    # (place, value) of what is present, then each with itself and those after it.
    known = values.select(F.filter(F.transform("v", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda e: e["x"].isNotNull()).alias("k"))
    pairs = F.flatten(F.transform("k", lambda a, at: F.transform(F.slice("k", at + 1, F.size("k")), lambda b: F.struct(
        a["i"].alias("i"), b["i"].alias("j"), a["x"].alias("x"), b["x"].alias("y")))))
    return aggregated(known.select(F.explode(pairs).alias("p")).select("p.*"))


def correlation_matrix(df: DataFrame, cols, fill_zero: bool = False) -> DataFrame:
    """Long matrix (col1, col2, r) over all ordered pairs incl. the diagonal."""
    cols = list(cols)
    names, k = F.array(*[F.lit(c) for c in cols]), len(cols)
    grid = df.sparkSession.range(k * k).select((F.col("id") / F.lit(k)).cast("int").alias("i"), (F.col("id") % F.lit(k)).cast("int").alias("j"))
    half = pair_sums(df, cols).select(F.col("i").alias("lo"), F.col("j").alias("hi"), "r")
    found = grid.join(half, (F.least("i", "j") == F.col("lo")) & (F.greatest("i", "j") == F.col("hi")), "left")
    r = F.coalesce("r", F.lit(0.0)) if fill_zero else F.col("r")
    return found.select(F.element_at(names, F.col("i") + 1).alias("col1"), F.element_at(names, F.col("j") + 1).alias("col2"), "i", "j", r.alias("r"))


def strong_correlations(df: DataFrame, cols, threshold: float = 0.7) -> DataFrame:
    """Ordered pairs i != j with |r| > threshold."""
    m = correlation_matrix(df, cols)
    return m.where((F.col("i") != F.col("j")) & (F.abs("r") > threshold)).select("col1", "col2", "r")


def ranked_correlations(df: DataFrame, cols, k: int = 2, min_abs: float | None = 0.1,
                        fill_zero: bool = True) -> DataFrame:
    """Unordered pairs by |r| descending, top k (ties: column order).

    Variants: |r| >= 0.1 top 2; no floor top 2 (``min_abs=None``); > 0.5 top 3.
    """
    m = correlation_matrix(df, cols, fill_zero=fill_zero).where(F.col("i") < F.col("j"))
    if min_abs is not None:
        m = m.where(F.abs("r") >= min_abs)
    return (m.orderBy(F.desc(F.abs("r")), "i", "j").limit(k)
             .select("col1", "col2", "r"))
