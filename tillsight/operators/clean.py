"""Cleaning operators.

Row order does not exist in a DataFrame, so every order-dependent step (keep the
first duplicate, fill from the previous row) takes an explicit order column.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillsight.functions import expressions as X
from tillsight.operators.stats import attach_scalars, column_modes, exact_quantiles
from tillsight.session import materialize

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
           T.DecimalType)


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    """P10: names of the numeric columns, in schema order."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC) and f.name not in exclude]


def string_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in exclude]


#: Digests of repeated rows (16 bytes each) that are broadcast; beyond them rows are shuffled whole.
BROADCAST_DIGESTS = 1_000_000


def by_ranges(df: DataFrame, order_cols) -> DataFrame:
    """Rows range-partitioned and sorted by ``order_cols`` (NULLs first), the other columns breaking ties.

    Equal rows share a range and are neighbours, so ``dedupe`` and ``forward_fill``
    take them (``ranged=True``) without another shuffle. Spark samples the bounds
    and takes as many ranges as the session's shuffle setting asks for. The rows are
    written once, since the bounds and the ranges both read them.
    """
    order = [F.col(c).asc_nulls_first() for c in _total_order(df, order_cols)]
    return materialize(df).repartitionByRange(*order).sortWithinPartitions(*order)


def _total_order(df: DataFrame, order_cols) -> list[str]:
    first = [order_cols] if isinstance(order_cols, str) else list(order_cols)
    return first + [c for c in df.columns if c not in first]


def dedupe(df: DataFrame, subset=None, order_col: str | None = None,
           broadcast_digests: int = BROADCAST_DIGESTS, ranged: bool = False) -> DataFrame:
    """Drop rows equal in all (or ``subset``) columns; NULLs compare equal.

    With ``order_col`` the surviving row carries the smallest order value of its
    duplicates (the first row, T17). With ``order_col`` or ``subset`` this is a hash
    aggregate with map-side combine, so a duplicate group holding a large share of
    the rows is collapsed before the shuffle. Whole rows are compared in two phases
    (``_distinct_rows``), or with their neighbours alone if ``df`` comes from
    ``by_ranges`` (``ranged``).
    """
    if ranged:
        names = [f"_c{i}" for i in range(len(df.columns))]
        rows = df.toDF(*names)
        return rows.mapInArrow(_unlike_neighbours, rows.schema).toDF(*df.columns)
    if order_col is None:
        return df.dropDuplicates(subset) if subset else _distinct_rows(df, broadcast_digests)
    data_cols = list(subset) if subset else [c for c in df.columns if c != order_col]
    others = [c for c in df.columns if c not in data_cols and c != order_col]
    aggs = [F.min(order_col).alias(order_col)]
    if others:  # non-key columns come from the first row of the group
        aggs.append(F.min(F.struct(F.col(order_col), *[F.col(c) for c in others])).alias("_first"))
    out = df.groupBy(*data_cols).agg(*aggs)
    if others:
        out = out.select(*data_cols, order_col, *[F.col(f"_first.{c}").alias(c) for c in others])
    return out.select(*df.columns)


def _distinct_rows(df: DataFrame, broadcast_digests: int) -> DataFrame:
    """The different rows of ``df``: only digests of 128 bits are shuffled, and rows whose digest repeats.

    The rows are written with their digest, and digests are counted with map-side
    combine. A row whose digest occurs once is kept as it is. The others, copies and
    rows that share a digest by chance, are compared column by column, so the digest
    decides nothing but which rows to compare. Repeated digests are broadcast if their
    counted number is at most ``broadcast_digests``; with more of them a large share
    of the table repeats, and all rows are compared.
    """
    names = [f"_c{i}" for i in range(len(df.columns))]
    rows = df.toDF(*names)
    digest = {"_h1": F.xxhash64(*names), "_h2": F.xxhash64(F.lit(1), *reversed(names))}
    rows = materialize(rows.withColumns(digest))
    repeated = materialize(rows.groupBy(*digest).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*digest))
    if repeated.count() > broadcast_digests:
        return rows.drop(*digest).dropDuplicates().toDF(*df.columns)
    alone = rows.join(F.broadcast(repeated), [*digest], "left_anti")
    copies = rows.join(F.broadcast(repeated), [*digest], "left_semi").dropDuplicates(names)
    return alone.unionByName(copies).select(*names).toDF(*df.columns)


def _plain(value):
    """A nested value in which NaN equals NaN (zeros of either sign are equal in Python too)."""
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return "NaN" if isinstance(value, float) and value != value else (type(value), value)


def _same(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Where two columns are equal as Spark's grouping sees it: NULLs, NaNs and zeros of either sign are equal."""
    if pa.types.is_nested(a.type) or pa.types.is_null(a.type):
        return np.fromiter(map(lambda x, y: _plain(x) == _plain(y), a.to_pylist(), b.to_pylist()), bool, len(a))
    equal = pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False)
    if a.null_count or b.null_count:
        equal = equal | pc.and_(pc.is_null(a), pc.is_null(b)).to_numpy(zero_copy_only=False)
    if pa.types.is_floating(a.type):
        equal = equal | pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False).to_numpy(zero_copy_only=False)
    return equal


def _unlike_neighbours(batches):
    """Sorted batches without the rows that equal the row before them."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        like = np.ones(batch.num_rows, dtype=bool)
        like[0] = last is not None
        if last is not None:
            like[0] = all(_same(c.slice(0, 1), k)[0] for c, k in zip(batch.columns, last))
        for c in batch.columns:
            like[1:] &= _same(c.slice(1), c.slice(0, len(c) - 1))
        last = [c.slice(len(c) - 1) for c in batch.columns]
        yield batch.filter(pa.array(~like))


def _filled_ranges(filled: list[bool]):
    """Sorted batches -> ``filled`` columns filled within the task's range, its number, and a mark on its last row."""
    def fill(batches):
        number, carry, held = TaskContext.get().partitionId(), None, None

        def marked(columns, end):
            n = len(columns[0])
            last = np.zeros(n, dtype=bool)
            last[-1] = end
            return pa.RecordBatch.from_arrays(
                [*columns, pa.array(np.full(n, number, dtype=np.int32)), pa.array(last)],
                names=[*(f"_c{i}" for i in range(len(filled))), "_range", "_last"])

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            columns = []
            for i, column in enumerate(batch.columns):
                if filled[i] and column.null_count:
                    known = column.is_valid().to_numpy(zero_copy_only=False)
                    at = np.maximum.accumulate(np.where(known, np.arange(1, n + 1), 0))
                    before = carry[i] if carry else pa.nulls(1, column.type)
                    column = pa.concat_arrays([before, column]).take(pa.array(at))
                columns.append(column)
            carry = [c.slice(n - 1) for c in columns]
            if held:
                yield marked(held, False)
            held = columns
        if held:
            yield marked(held, True)

    return fill


def forward_fill(df: DataFrame, order_col, cols=None, partition_cols=(), ranged: bool = False) -> DataFrame:
    """Fill NULLs with the last non-null value in ``order_col`` order (NULLs first).

    ``order_col`` is a column or a list; rows that it leaves equal are ordered
    by the remaining columns. Rows are shuffled once, into ranges (``by_ranges``; not
    at all if ``df`` comes from there, ``ranged``). A task fills its sorted range from
    the range's own rows, batch by batch. What is still NULL precedes every value of
    its range and takes the last value of the ranges before: a window over the
    ranges' last rows (one row per range, broadcast).
    """
    if partition_cols:
        return _fill_partitions(df, order_col, cols, list(partition_cols))
    order_cols = [order_col] if isinstance(order_col, str) else list(order_col)
    cols = list(cols) if cols is not None else [c for c in df.columns if c not in order_cols]
    rows = df if ranged else by_ranges(df, order_cols)
    names = [f"_c{i}" for i in range(len(df.columns))]
    into = {f"_c{i}" for i, c in enumerate(df.columns) if c in cols}
    rows = rows.toDF(*names)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields]) \
        .add("_range", T.IntegerType()).add("_last", T.BooleanType())
    rows = materialize(rows.mapInArrow(_filled_ranges([n in into for n in names]), schema))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carry = rows.where("_last").select("_range", *[F.last(n, ignorenulls=True).over(before).alias(f"_in{n}") for n in names if n in into])
    return rows.join(F.broadcast(carry), "_range", "left").select(*[
        F.coalesce(F.col(n), F.col(f"_in{n}")).alias(n) if n in into else F.col(n) for n in names]).toDF(*df.columns)


def _fill_partitions(df: DataFrame, order_col, cols, partition_cols) -> DataFrame:
    """``forward_fill`` within each value of ``partition_cols``.

    No window sees more than one range of the order key:

    1. rows are range-partitioned on the key itself (any orderable type), the
       other columns breaking ties, so that neither equal nor NULL keys make a
       large partition; Spark samples the bounds and takes as many partitions as
       the session's shuffle setting asks for. The ranges are written once;
    2. the last non-null value of each column per range is a partial maximum,
       and a window over those (one row per range) gives what each range
       receives from earlier ones;
    3. inside a range a window fills from earlier rows, else with that value.
    """
    order_cols = [order_col] if isinstance(order_col, str) else list(order_col)
    by = list(partition_cols)
    cols = list(cols) if cols is not None else [c for c in df.columns if c not in order_cols and c not in by]
    total_order = order_cols + [c for c in df.columns if c not in order_cols and c not in by]
    ranged = df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in by + total_order])
    ranged = materialize(ranged.withColumn("_range", F.spark_partition_id()))

    key = F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(total_order)])
    last_in_range = ranged.groupBy(*by, "_range").agg(*[
        F.max(F.when(F.col(c).isNotNull(), F.struct(key.alias("k"), F.col(c).alias("v")))).getField("v").alias(c)
        for c in cols])
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carry = last_in_range.select(*by, "_range", *[F.last(c, ignorenulls=True).over(before).alias(f"_in_{c}") for c in cols])
    # One row per range (and partition value): Spark broadcasts it if it measures small.
    inside = (Window.partitionBy(*by, "_range").orderBy(*[F.col(c).asc_nulls_first() for c in total_order])
                    .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    joined = ranged.alias("r").join(carry.alias("c"), [F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}")) for c in by + ["_range"]], "left")
    joined = joined.select("r.*", *[F.col(f"c._in_{c}") for c in cols])
    return joined.select(*[
        F.coalesce(F.last(c, ignorenulls=True).over(inside), F.col(f"_in_{c}")).alias(c) if c in cols else F.col(c)
        for c in df.columns])


def impute_median(df: DataFrame, cols=None, accuracy: int = 100000) -> DataFrame:
    """Numeric NULLs -> exact column median (pandas ``median``).

    Imputed integer columns become double, since a median may lie between two
    integers. The one-row result is attached by broadcast and applied with
    ``coalesce``. A column with no values keeps its NULLs.
    """
    cols = list(cols) if cols is not None else numeric_columns(df)
    if not cols:
        return df
    med = exact_quantiles(df, cols, [0.5], accuracy=accuracy)
    one = med.groupBy().agg(*[F.max(F.when(F.col("column") == c, F.col("value"))).alias(f"_m_{c}") for c in cols])
    out = attach_scalars(df, one)
    integers = ("tinyint", "smallint", "int", "bigint")
    types = {c: "double" if t in integers else t for c, t in df.dtypes}
    return out.select(*[
        F.coalesce(F.col(c).cast(types[c]), F.col(f"_m_{c}").cast(types[c])).alias(c) if c in cols else F.col(c)
        for c in df.columns])


def impute_mode(df: DataFrame, cols=None) -> DataFrame:
    """C4: string NULLs -> most frequent value, lowest on ties; all-NULL stays NULL."""
    cols = list(cols) if cols is not None else string_columns(df)
    if not cols:
        return df
    modes = column_modes(df, cols)
    one = modes.groupBy().pivot("column", cols).agg(F.first("value"))
    one = one.select(*[F.col(c).alias(f"_m_{c}") for c in cols])
    out = attach_scalars(df, one)
    return out.select(*[F.coalesce(F.col(c), F.col(f"_m_{c}")).alias(c) if c in cols else F.col(c)
                        for c in df.columns])


def hour_column(df: DataFrame, hour_col="hour", time_col="time", date_col="date"):
    """Existing hour, else from the time string, else from the timestamp, of the columns that ``df`` has."""
    cands = []
    if hour_col in df.columns:
        cands.append(F.col(hour_col).cast("int"))
    if time_col in df.columns:
        cands.append(X.hour_of_time(time_col))
    if date_col in df.columns:
        cands.append(F.hour(F.col(date_col)).cast("int"))
    return F.coalesce(*cands) if cands else F.lit(None).cast("int")


def hour_fallback(df: DataFrame, hour_col="hour", time_col="time", date_col="date",
                  null_as_zero: bool = False) -> DataFrame:
    """C8 as a column of ``df``."""
    h = hour_column(df, hour_col, time_col, date_col)
    if null_as_zero:
        h = F.coalesce(h, F.lit(0))
    return df.withColumn(hour_col, h)


def drop_null_rows(df: DataFrame, subset=None, how: str = "any") -> DataFrame:
    """Drop rows NULL in ``subset`` (or in any column)."""
    return df.na.drop(how=how, subset=list(subset) if subset else None)


def inf_to_null(df: DataFrame, cols=None) -> DataFrame:
    """+-inf / NaN -> NULL in floating columns."""
    cols = cols or [f.name for f in df.schema.fields
                    if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: X.inf_to_null(c) for c in cols})


def null_counts(df: DataFrame) -> DataFrame:
    """C11: NULLs per column as rows (column, nulls), one aggregate pass."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    items = [F.struct(F.lit(c).alias("column"), F.col(c).cast("long").alias("nulls"))
             for c in df.columns]
    return one.select(F.explode(F.array(*items)).alias("r")).select("r.column", "r.nulls")
