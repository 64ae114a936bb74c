"""Distributed building blocks: exact quantiles, modes, scalar attach, unpivot.

Spark's ``percentile`` and ``mode`` aggregates keep a value->count map per
group and merge it in one task, so a global median over a high-cardinality
column would put every distinct value of that column into one task. The
versions here stay partial-aggregable:

* ``exact_quantiles``: a Greenwald-Khanna sketch (``percentile_approx``,
  mergeable, bounded size) brackets each target rank; one counting pass keeps the
  values inside a bracket (a ~4/accuracy slice of the column) and only counts the
  rows between brackets, so next to nothing is shuffled; the kept values are
  dealt into ranges, and only the ranges that hold a target rank are ordered.
  Linear interpolation between ranks floor(h) and ceil(h), h = (n-1)p, is the
  pandas / DuckDB ``quantile_cont`` rule.
* ``column_modes``: count per (column, value) with map-side combine, then
  ``min(struct(-count, value))`` per column: most frequent, lowest on ties.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def long_values(df: DataFrame, cols, group_cols=(), cast: str | None = "double",
                drop_nulls: bool = True) -> DataFrame:
    """Unpivot ``cols`` into (group..., column, v); NULL / NaN values dropped."""
    items = [F.struct(F.lit(c).alias("column"),
                      (F.col(c).cast(cast) if cast else F.col(c)).alias("v")) for c in cols]
    out = (df.select(*group_cols, F.explode(F.array(*items)).alias("_kv"))
             .select(*group_cols, "_kv.column", "_kv.v"))
    if drop_nulls:
        cond = F.col("v").isNotNull()
        if cast == "double":
            cond = cond & ~F.isnan("v")
        out = out.where(cond)
    return out


def attach_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Append the columns of a one-row aggregate to every row.

    ``one_row`` is a global aggregate, so exactly one row: broadcasting it is
    size-bounded by construction and no pairs are formed.
    """
    return df.join(F.broadcast(one_row), on=F.lit(True), how="inner")


def exact_quantiles(df: DataFrame, cols, probs, group_cols=(), accuracy: int = 100000,
                    widths=(2, 64, None)) -> DataFrame:
    """Exact linear-interpolated quantiles per (group..., column, p).

    Returns columns ``group..., column, p, n, mean, std, min, max, value``
    (the moments come from the same pass as the sketch); a column with no
    non-null values gives no rows.

    The input is read twice. Pass 1: moments and, per p, the sketch's values at
    p -+ width/accuracy. Pass 2: rows per (column, place), where the place of a
    value inside a bracket is the value itself and that of any other value is the
    nearest bracket below; partial sums leave a few rows per task and column.
    The places at the target ranks are selected by ranges (``_at_ranks``). Should a target rank lie
    outside of its bracket (the sketch promises it does not), pass 2 is repeated
    with the next width, at last with the whole range.

    Callers holding an expensive input (a fact-table join) should materialize it
    first (``session.materialize``).
    """
    from tillsight.session import materialize
    g, cols, probs = list(group_cols), list(cols), [float(p) for p in probs]

    def value(c):
        v = F.col(c).cast("double")
        return F.when(~F.isnan(v), v)

    edges = [e for w in widths if w for p in probs for e in (max(0.0, p - w / accuracy), min(1.0, p + w / accuracy))]
    aggs = []
    for c in cols:
        v = value(c)
        aggs.append(F.struct(
            F.lit(c).alias("column"), F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
            F.min(v).alias("min"), F.max(v).alias("max"),
            F.percentile_approx(v, F.array(*[F.lit(e) for e in edges]), accuracy).alias("edges")))
    sketch = df.groupBy(*g).agg(F.array(*aggs).alias("_s")).select(*g, F.explode("_s").alias("_s")).select(*g, "_s.*")
    sketch = materialize(sketch.where("n > 0"))  # a row per group and column

    for step, width in enumerate(widths):
        lo, hi = F.array(F.col("min")), F.array(F.col("max"))
        if width:
            at = [2 * len(probs) * step + 2 * i for i in range(len(probs))]
            lo = F.array(*[F.get("edges", F.lit(i)) for i in at])
            hi = F.array(*[F.get("edges", F.lit(i + 1)) for i in at])
        brackets = sketch.withColumns({"_lo": lo, "_hi": hi})
        wide = brackets.groupBy(*g).agg(F.map_from_entries(F.collect_list(F.struct("column", F.struct("_lo", "_hi")))).alias("_b"))
        rows = attach_scalars(df.select(*dict.fromkeys(g + cols)), wide) if not g else df.select(*dict.fromkeys(g + cols)).join(wide, g)
        items = [F.struct(F.lit(c).alias("column"), value(c).alias("v"), F.element_at("_b", F.lit(c)).alias("b")) for c in cols]
        each = rows.select(*g, F.explode(F.array(*items)).alias("_i")).select(*g, "_i.*").where("v is not null")
        inside, below = F.lit(False), F.lit(float("-inf"))
        for i in range(len(probs) if width else 1):
            inside = inside | F.col("v").between(F.get("b._lo", F.lit(i)), F.get("b._hi", F.lit(i)))
            below = F.greatest(below, F.when(F.get("b._hi", F.lit(i)) < F.col("v"), F.get("b._hi", F.lit(i))))
        place = F.when(inside, F.struct(F.col("v").alias("at"), F.lit(0).alias("above"))).otherwise(
            F.struct(below.alias("at"), F.lit(1).alias("above")))
        places = each.groupBy(*g, "column", place.alias("place")).agg(F.count(F.lit(1)).alias("cnt"))
        targets = sketch.select(*g, "column", "n", "mean", "std", "min", "max",
                                F.explode(F.array(*[F.lit(p) for p in probs])).alias("p"))
        targets = targets.withColumn("h", (F.col("n") - 1).cast("double") * F.col("p"))
        hit = _at_ranks(places, targets, g)
        hit = materialize(hit)  # a row per group, column and p
        if not width or hit.where("a.above = 1 or b.above = 1").isEmpty():
            break
    frac = F.col("h") - F.floor("h")
    return hit.select(*g, "column", "p", "n", "mean", "std", "min", "max",
                      (F.col("a.at") + frac * (F.col("b.at") - F.col("a.at"))).alias("value"))


def _at_ranks(places: DataFrame, targets: DataFrame, g: list) -> DataFrame:
    """The places ``a`` and ``b`` at ranks floor(h) and ceil(h) of every target.

    Places are dealt by range (Spark samples the bounds) and written, so that ranges
    keep their rows. Counts per range, a row each, tell which range holds a rank; only
    those are ordered, each by a window of its own. No column is gathered in one task.
    """
    from tillsight.session import materialize
    dealt = places.repartitionByRange(*g, "column", "place.at", "place.above")
    dealt = materialize(dealt.withColumn("_range", F.spark_partition_id()))
    earlier = Window.partitionBy(*g, "column").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (dealt.groupBy(*g, "column", "_range").agg(F.sum("cnt").alias("_n"))
                   .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))))
    held = (F.col("_before") <= F.ceil("h")) & (F.col("_before") + F.col("_n") > F.floor("h"))
    wanted = ranges.join(targets, g + ["column"]).where(held)
    keys = [*g, "column", "_range"]
    inside = Window.partitionBy(*keys).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ordered = (dealt.join(wanted.select(*keys, "_before").distinct(), keys)
                    .withColumn("cum", F.col("_before") + F.sum("cnt").over(inside)).drop("_before"))
    return ordered.join(wanted.drop("_n", "_before"), keys).groupBy(*g, "column", "p", "n", "mean", "std", "min", "max", "h").agg(
        F.min(F.when(F.col("cum") > F.floor("h"), F.col("place"))).alias("a"),
        F.min(F.when(F.col("cum") > F.ceil("h"), F.col("place"))).alias("b"))


def cut_points(df: DataFrame, cols, bins: int, accuracy: int = 10000) -> dict:
    """At most ``bins`` - 1 points per column that deal all rows into bins; x >= point is above.

    Between all values of a column that has ``bins`` values or fewer, else at its exact
    quantiles (ranks floor((n - 1)p), no interpolation), however rows are partitioned; a
    value that fills several quantiles is parted from both sides. Infinities lie in the
    outer bins. ``exact_quantiles`` without groups for many quantiles: the brackets are
    collected, 2 * ``bins`` numbers per column, and values find theirs by binary search.
    """
    from tillsight.session import materialize
    cols, probs, top = list(cols), [i / bins for i in range(1, bins)], math.nextafter(math.inf, 0)
    finite = df.select(*[F.when(F.abs(F.col(c).cast("double")) <= top, F.col(c).cast("double")).alias(c) for c in cols])
    edges = F.array(*[F.lit(e) for p in probs for e in (max(0.0, p - 2 / accuracy), min(1.0, p + 2 / accuracy))])
    sketch = finite.agg(*[F.struct(F.count(c).alias("n"), F.percentile_approx(c, edges, accuracy).alias("edges")).alias(c) for c in cols]).first()
    points = {c: [] for c in cols}
    many = []
    for c in (c for c in cols if sketch[c].n):
        if len(set(sketch[c].edges)) <= bins:
            values = sorted(r[0] for r in finite.select(c).where(F.col(c).isNotNull()).distinct().limit(bins + 1).collect())
            if len(values) <= bins:
                points[c] = values[1:]
                continue
        many.append(c)
    ranks = [(c, p, sketch[c].n, float(math.floor((sketch[c].n - 1) * p))) for c in many for p in probs]
    for whole in (False, True):
        if not many:
            break
        starts = {}  # of brackets and of the gaps behind them, in turn
        for c in many:
            starts[c] = [-top] if whole else []
            for lo, hi in [] if whole else sorted(zip(sketch[c].edges[::2], sketch[c].edges[1::2])):
                after = min(math.nextafter(hi, math.inf), top)
                if starts[c] and lo <= starts[c][-1]:
                    starts[c][-1] = max(starts[c][-1], after)
                else:
                    starts[c] += [lo, after]
        bucket = Bucketizer(splitsArray=[sorted({-math.inf, *starts[c], math.inf}) for c in many], inputCols=many,
                            outputCols=[f"_in_{c}" for c in many], handleInvalid="keep")
        items = [F.struct(F.lit(c).alias("column"), F.col(c).alias("v"), F.col(f"_in_{c}").cast("int").alias("bin")) for c in many]
        each = bucket.transform(finite).select(F.explode(F.array(*items)).alias("_i")).select("_i.*").where("v is not null")
        counts = each.groupBy("column", "bin", F.when(F.col("bin") % 2 == 1, F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("cnt"))
        gaps = F.create_map(*[x for c in many for x in (F.lit(c), F.array(*[F.lit(v) for v in (-math.inf, *starts[c])]))])
        place = F.struct(F.coalesce("v", F.get(F.element_at(gaps, F.col("column")), F.col("bin"))).alias("at"), (F.col("bin") % 2 == 0).cast("int").alias("above"))
        targets = df.sparkSession.createDataFrame(ranks, "column string, p double, n long, h double").withColumns(
            {m: F.lit(None).cast("double") for m in ("mean", "std", "min", "max")})
        hit = materialize(_at_ranks(counts.select("column", place.alias("place"), "cnt"), targets, [])).collect()
        if whole or not any(r.a.above for r in hit):
            for c in many:
                for v in sorted(r.a.at for r in hit if r.column == c):
                    points[c].append(math.nextafter(v, math.inf) if v in points[c] else v)
            break
    return {c: sorted({v for v in points[c] if abs(v) <= top}) for c in cols}


def column_modes(df: DataFrame, cols) -> DataFrame:
    """Most frequent non-null value per column, lowest value on ties.

    Returns (column, value) with ``value`` as string.
    """
    lv = long_values(df, cols, cast="string")
    counts = lv.groupBy("column", "v").agg(F.count(F.lit(1)).alias("cnt"))
    best = counts.groupBy("column").agg(F.min(F.struct((-F.col("cnt")).alias("k"), F.col("v"))).alias("m"))
    return best.select("column", F.col("m.v").alias("value"))
