"""File sources and sinks: CSV / JSON records in, CSV / JSON out.

Known columns get an explicit schema (no inference pass over the data, and
``Time`` stays a string instead of turning into a timestamp on today's date);
any other header column is read as a string. Upload headers are renamed to the
snake_case contract used everywhere else.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Upload headers of the sales contract and their Spark types.
UPLOAD_HEADERS = {
    "Invoice ID": ("invoice_id", T.StringType()),
    "Date": ("date", T.StringType()),
    "Time": ("time", T.StringType()),
    "Total": ("total", T.DoubleType()),
    "Quantity": ("quantity", T.IntegerType()),
    "Unit price": ("unit_price", T.DoubleType()),
    "Product line": ("product_line", T.StringType()),
    "Payment": ("payment", T.StringType()),
    "Gender": ("gender", T.StringType()),
    "Customer type": ("customer_type", T.StringType()),
}
SNAKE_TO_HEADER = {v[0]: k for k, v in UPLOAD_HEADERS.items()}

# Encodings tried in order by the fallback reader.
FALLBACK_ENCODINGS = ("utf-8", "latin1", "ISO-8859-1", "cp1252")

# Required column -> analyses it enables.
REQUIRED_RULES = [
    ("invoice_id", "upload"), ("date", "upload"), ("total", "upload"), ("quantity", "upload"),
    ("total", "segmentation"), ("quantity", "segmentation"), ("unit_price", "segmentation"),
    ("date", "forecast"), ("total", "forecast"),
    ("date", "churn"), ("total", "churn"), ("quantity", "churn"),
    ("product_line", "product analysis"), ("unit_price", "product analysis"),
    ("quantity", "product analysis"),
]


# Charsets Spark 4 accepts without the legacy switch.
STANDARD_CHARSETS = {"iso-8859-1", "us-ascii", "utf-16", "utf-16be", "utf-16le", "utf-32", "utf-8"}


def allow_charset(spark: SparkSession, encoding: str) -> None:
    """Enable Spark's full Java charset list when a legacy one (cp1252, latin1
    aliases) is requested; the standard ones need nothing."""
    if encoding.lower() not in STANDARD_CHARSETS:
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")


def _header_schema(spark: SparkSession, path: str, encoding: str, sep: str) -> T.StructType:
    """Schema from the header line only (one tiny read, no inference pass)."""
    head = (spark.read.option("header", False).option("encoding", encoding)
            .option("sep", sep).csv(path).limit(1).collect())
    names = [c for c in head[0]] if head else []
    return T.StructType([T.StructField(n, UPLOAD_HEADERS.get(n, (n, T.StringType()))[1], True)
                         for n in names])


def standardize(df: DataFrame) -> DataFrame:
    """Rename upload headers to the snake_case contract; other columns unchanged.

    NaN in floating columns becomes NULL here, at ingest (pandas treats NaN as
    missing; Spark would carry it into sums and maxima)."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.nanvl(c, F.lit(None).cast(f.dataType))
        out.append(c.alias(UPLOAD_HEADERS[f.name][0] if f.name in UPLOAD_HEADERS else f.name))
    return df.select(out)


def csv_scan(spark: SparkSession, path: str, encoding: str = "utf-8", sep: str = ",",
             schema: T.StructType | None = None, rename: bool = True) -> DataFrame:
    """Header CSV in a chosen encoding with pinned types for known columns."""
    allow_charset(spark, encoding)
    schema = schema or _header_schema(spark, path, encoding, sep)
    # Every file's header is held against the schema: files whose columns stand in
    # another order raise instead of being read by position.
    df = (spark.read.schema(schema).option("header", True).option("encoding", encoding)
          .option("sep", sep).option("mode", "PERMISSIVE").option("enforceSchema", False).csv(path))
    return standardize(df) if rename else df


def detect_encoding(spark: SparkSession, path: str,
                    encodings=FALLBACK_ENCODINGS) -> str:
    """S2 helper: first encoding in the list that decodes every file.

    Spark's CSV reader replaces undecodable bytes instead of failing, so the
    check runs on the raw bytes of lines (a line end never lies inside a UTF-8
    character): files of any size are read in splits and only one boolean comes
    back. The single-byte encodings decode any byte, so the first of them wins
    when UTF-8 fails.
    """
    lines = spark.read.text(path)
    ok = lines.agg(F.coalesce(F.min(F.is_valid_utf8("value").cast("int")), F.lit(1)).alias("ok")).first()["ok"]
    if ok == 1:
        return encodings[0]
    return next((e for e in encodings if e.lower().replace("-", "") not in ("utf8",)), "latin1")


def csv_scan_fallback(spark: SparkSession, path: str, encodings=FALLBACK_ENCODINGS,
                      empty_columns=("invoice_id", "date", "total", "quantity")) -> DataFrame:
    """S1 with the first encoding that decodes; a missing path gives an empty frame.

    Any other failure (permissions, lost storage) is raised, not read as no data.
    """
    try:
        enc = detect_encoding(spark, path, encodings)
        return csv_scan(spark, path, encoding=enc)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        schema = T.StructType([T.StructField(c, T.StringType(), True) for c in empty_columns])
        return spark.createDataFrame([], schema)


def records_scan(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """S3: JSON records (one object per line) with the contract's schema.

    Keys outside of the contract follow as strings in order of name; one pass
    over the lines collects the different key names.
    """
    if schema is None:
        schema = T.StructType([T.StructField(h, t, True) for h, (_, t) in UPLOAD_HEADERS.items()])
        keys = spark.read.text(path).select(F.explode(F.json_object_keys("value")).alias("k")).distinct().collect()
        for name in sorted(r["k"] for r in keys if r["k"] not in UPLOAD_HEADERS):
            schema = schema.add(name, T.StringType(), True)
    return standardize(spark.read.schema(schema).json(path))


def sample_sales(spark: SparkSession, n: int = 100) -> DataFrame:
    """The demo table (linear ramp in Total and price, cyclic categories).

    Library helper for trying the operators without a file; not a registered
    query because it reads no input table.
    """
    i = F.col("id")
    # Demo category cycles.
    lines = F.array(*[F.lit(x) for x in ("Electronics", "Clothing", "Food", "Home", "Sports")])
    pays = F.array(*[F.lit(x) for x in ("Cash", "Credit card", "Ewallet")])
    return spark.range(n).select(
        F.concat(F.lit("INV-"), (i + 1).cast("string")).alias("invoice_id"),
        F.date_add(F.to_date(F.lit("2023-01-01")), i.cast("int")).cast("timestamp").alias("date"),
        F.when(i % 2 == 0, F.lit("8:00")).otherwise(F.lit("9:36")).alias("time"),
        F.round(100 + 9 * i.cast("double"), 2).alias("total"),
        (i % 10 + 1).cast("int").alias("quantity"),
        F.round(10 + 0.9 * i.cast("double"), 2).alias("unit_price"),
        F.element_at(lines, (i % 5 + 1).cast("int")).alias("product_line"),
        F.element_at(pays, (i % 3 + 1).cast("int")).alias("payment"),
        F.when(i % 2 == 0, F.lit("Male")).otherwise(F.lit("Female")).alias("gender"),
        F.when(i % 2 == 0, F.lit("Member")).otherwise(F.lit("Normal")).alias("customer_type"),
    )


def schema_profile(df: DataFrame) -> DataFrame:
    """One row per column (position, name, type) plus the table's row count.

    The count is a distributed aggregate; the schema rows are a few dozen
    literals joined to that one-row result.
    """
    spark = df.sparkSession
    cols = spark.createDataFrame(
        [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)],
        "position int, column string, type string")
    n = df.agg(F.count(F.lit(1)).alias("row_count"))
    return cols.join(F.broadcast(n), how="inner", on=F.lit(True))


def required_columns(df: DataFrame, rules=REQUIRED_RULES) -> DataFrame:
    """Required columns missing from ``df`` and the analysis each disables."""
    spark = df.sparkSession
    rule_df = spark.createDataFrame(rules, "column string, analysis string")
    present = spark.createDataFrame([(c,) for c in df.columns], "column string")
    return rule_df.join(F.broadcast(present), "column", "left_anti")


def csv_export(df: DataFrame, path: str, headers: bool = True, upload_names: bool = False,
               encoding: str = "utf-8") -> None:
    """Write CSV with a header line (one file per partition; no coalesce to one task)."""
    allow_charset(df.sparkSession, encoding)
    out = df
    if upload_names:
        out = df.select([F.col(c).alias(SNAKE_TO_HEADER.get(c, c)) for c in df.columns])
    out.write.mode("overwrite").option("header", headers).option("encoding", encoding).csv(path)


def records_export(df: DataFrame, path: str | None = None) -> DataFrame:
    """Rows as JSON records; writes them when ``path`` is given."""
    if path:
        df.write.mode("overwrite").json(path)
    return df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("record"))


def write_partitioned_table(df: DataFrame, path: str, date_col: str = "date",
                            by=("year", "month")) -> None:
    """Write a table partitioned by the year / month of ``date_col``.

    Later reads that filter on those columns skip whole folders (partition
    pruning); filters on other columns still reach the parquet row groups.
    Rows are range-partitioned on the date before the write: each task holds a
    contiguous, row-balanced date range (Spark samples the bounds, so a month
    holding a large share of the rows is split over several tasks rather than
    written by one), touches only one or two month folders, and writes its rows
    in date order, which keeps the row-group min/max of the date tight.
    """
    parts = {"year": F.year(date_col), "month": F.month(date_col)}
    out = df.withColumns({k: parts[k] for k in by})
    (out.repartitionByRange(F.col(date_col)).sortWithinPartitions(date_col)
        .write.mode("overwrite").partitionBy(*by).parquet(path))


def read_months(spark: SparkSession, path: str, start: str | None = None,
                end: str | None = None, date_col: str = "date") -> DataFrame:
    """Read a month-partitioned table, pruning folders outside [start, end]."""
    df = spark.read.parquet(path)
    ym = F.col("year") * 100 + F.col("month")
    if start:
        df = df.where(ym >= int(start[:4]) * 100 + int(start[5:7]))
    if end:
        df = df.where(ym <= int(end[:4]) * 100 + int(end[5:7]))
    if start:
        df = df.where(F.col(date_col) >= F.to_timestamp(F.lit(start)))
    if end:
        df = df.where(F.col(date_col) <= F.to_timestamp(F.lit(end)))
    return df
