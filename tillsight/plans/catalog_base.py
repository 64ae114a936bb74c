"""Registered queries, part 1: sources, cleaning, projections, filters, aggregates.

Each query runs over the whole driver tables. Floating results are rounded to
2 decimals on both sides (sums in a different order differ in the last bits).
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from tillsight.functions import expressions as X
from tillsight.operators import aggregate as A
from tillsight.operators import clean as C
from tillsight.operators import filters as FL
from tillsight.plans import pipelines as PL
from tillsight.plans.registry import EV, SALES, register, rounded
from tillsight.session import ensure_checkpoint_dir
from tillsight.sources import files as IO
from tillsight.sources import tables as TB

SALES_COLS = list(TB.SALES_COLUMNS)


def sales(spark, sf):
    return TB.sales(spark, sf)


def hourly(spark, sf):
    return sales(spark, sf).withColumn("hour", X.hour_of_time("time"))


def events_hourly(spark, sf):
    return TB.events_sales(spark, sf).withColumn("hour", F.hour("date"))


def dirty_sales(spark, sf):
    """Sales view with deterministic defects: text dates (two formats plus junk),
    NULLs in several columns and exact duplicate rows."""
    s = sales(spark, sf)
    k = F.col("invoice_id")
    d = (F.when(k % 13 == 0, F.lit("not a date"))
          .when(k % 2 == 0, F.date_format("date", "yyyy-MM-dd"))
          .otherwise(F.date_format("date", "M/d/yyyy")))
    nul = lambda m, c: F.when(k % m == 0, F.lit(None)).otherwise(F.col(c))
    base = s.select("invoice_id", "customer_id", d.alias("date"), nul(17, "time").alias("time"),
                    nul(7, "total").alias("total"), "quantity", nul(5, "unit_price").alias("unit_price"),
                    nul(11, "product_line").alias("product_line"), "payment", "gender", "customer_type")
    # Copies of rows by a short array, so that the view is joined once.
    copies = F.when(k % 9 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return base.select("*", F.explode(copies).alias("copy")).drop("copy")


DIRTY = SALES + """, dirty as (
  select invoice_id, customer_id,
         case when invoice_id % 13 = 0 then 'not a date'
              when invoice_id % 2 = 0 then strftime(date, '%Y-%m-%d')
              else strftime(date, '%-m/%-d/%Y') end as date,
         case when invoice_id % 17 = 0 then null else time end as time,
         case when invoice_id % 7 = 0 then null else total end as total,
         quantity,
         case when invoice_id % 5 = 0 then null else unit_price end as unit_price,
         case when invoice_id % 11 = 0 then null else product_line end as product_line,
         payment, gender, customer_type
  from sales),
dirty_all as (select * from dirty union all select * from dirty where invoice_id % 9 = 0)
"""

PARSE_SQL = ("coalesce(try_strptime({c}, '%Y-%m-%d %H:%M:%S'), try_strptime({c}, '%Y-%m-%dT%H:%M:%S'), "
             "try_strptime({c}, '%Y-%m-%dT%H:%M:%S.%g'), "
             "try_strptime({c}, '%Y-%m-%d %H:%M'), try_strptime({c}, '%Y-%m-%d'), "
             "try_strptime({c}, '%m/%d/%Y %H:%M'), try_strptime({c}, '%m/%d/%Y'))")
HOUR_SQL = ("cast(coalesce(hour(try_strptime({t}, '%H:%M')), "
            "try_cast(split_part({t}, ':', 1) as integer)) as integer)")
ORDER_ALL = ", ".join(f"{c} nulls first" for c in SALES_COLS)


def _fill_sql(cols, src):
    sel = []
    for c in SALES_COLS:
        if c in cols:
            sel.append(f"last_value({c} ignore nulls) over (order by {ORDER_ALL} "
                       f"rows between unbounded preceding and current row) as {c}")
        else:
            sel.append(c)
    return f"select {', '.join(sel)} from {src}"


def _scratch(spark, name):
    """A new folder below the shared checkpoint folder, deleted when the application ends."""
    path = os.path.join(ensure_checkpoint_dir(spark), "exports", f"{name}-{uuid.uuid4().hex}")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def _sum_sql(key, src="sales", value="total"):
    return (f"select {key}, round(coalesce(sum({value}), 0), 2) as sales from {src} "
            f"where {key} is not null group by {key}")


UPLOAD_SQL = SALES + """select cast(invoice_id as varchar) as invoice_id, date, time,
  total, quantity, unit_price, product_line,
  payment, gender, customer_type from sales"""


def _upload_frame(spark, sf):
    return sales(spark, sf).drop("customer_id")


def _contract(df):
    out = df.withColumn("date", X.parse_date("date"))
    return out.select("invoice_id", "date", "time", "total", "quantity", "unit_price",
                      "product_line", "payment", "gender", "customer_type")


# ---------------------------------------------------------------- sources

@register("csv_export", UPLOAD_SQL)
def q_csv_export(spark, sf):
    """S7 + S1: write the sales table as header CSV with upload names, read it back."""
    path = _scratch(spark, "csv")
    IO.csv_export(_upload_frame(spark, sf), path, upload_names=True)
    return _contract(IO.csv_scan(spark, path))


@register("csv_scan_fallback", UPLOAD_SQL)
def q_csv_scan_fallback(spark, sf):
    """A latin1-encoded export read back through encoding detection."""
    path = _scratch(spark, "csv-latin1")
    IO.csv_export(_upload_frame(spark, sf), path, upload_names=True, encoding="ISO-8859-1")
    return _contract(IO.csv_scan_fallback(spark, path))


@register("records_scan", UPLOAD_SQL)
def q_records_scan(spark, sf):
    """S3: JSON records with upload names read back with the contract schema."""
    path = _scratch(spark, "json")
    up = _upload_frame(spark, sf)
    up.select([F.col(c).alias(IO.SNAKE_TO_HEADER.get(c, c)) for c in up.columns]) \
      .withColumn("Date", F.date_format("Date", "yyyy-MM-dd HH:mm:ss")) \
      .write.mode("overwrite").json(path)
    return _contract(IO.records_scan(spark, path))


@register("records_export", SALES + _sum_sql("product_line"))
def q_records_export(spark, sf):
    """Category sums written as JSON records and read back with their schema
    (the text of JSON numbers differs between engines, the values do not)."""
    out = rounded(A.sales_by_category(sales(spark, sf)))
    path = _scratch(spark, "records")
    IO.records_export(out, path)
    return spark.read.schema(out.schema).json(path)


@register("schema_profile", SALES + """, d as (select row_number() over () - 1 as position, column_name,
  column_type from (describe select * from sales))
select cast(position as integer) as position, column_name as column,
  case column_type when 'BIGINT' then 'bigint' when 'INTEGER' then 'int' when 'DOUBLE' then 'double'
       when 'VARCHAR' then 'string' when 'TIMESTAMP' then 'timestamp_ntz' else lower(column_type) end as type,
  (select count(*) from sales) as row_count from d""")
def q_schema_profile(spark, sf):
    """Columns, types and row count of the sales table."""
    return IO.schema_profile(sales(spark, sf))


_RULES_SQL = ", ".join(f"('{c}', '{a}')" for c, a in IO.REQUIRED_RULES)


@register("required_columns", EV + f"""select r.column_name as column, r.analysis
from (values {_RULES_SQL}) r(column_name, analysis)
where r.column_name not in (select column_name from (describe select * from ev))""")
def q_required_columns(spark, sf):
    """Required columns missing from the events table and what they disable."""
    return IO.required_columns(TB.events_sales(spark, sf))


# ---------------------------------------------------------------- cleaning

@register("dedupe", DIRTY + "select distinct * from dirty_all")
def q_dedupe(spark, sf):
    """Exact duplicate rows removed (NULLs equal)."""
    return C.dedupe(dirty_sales(spark, sf))


@register("dedupe_first", SALES + """select product_line, payment, min(invoice_id) as invoice_id
from sales group by product_line, payment""")
def q_dedupe_first(spark, sf):
    """C1 with an order column: one row per data key carrying the first order value."""
    s = sales(spark, sf).select("product_line", "payment", "invoice_id")
    return C.dedupe(s, subset=["product_line", "payment"], order_col="invoice_id")


@register("forward_fill", """select event_id,
  last_value(case when event_id % 7 <> 0 then value end ignore nulls)
    over (order by event_id rows between unbounded preceding and current row) as value,
  last_value(case when event_id % 5 <> 0 then event_type end ignore nulls)
    over (order by event_id rows between unbounded preceding and current row) as event_type
from events""")
def q_forward_fill(spark, sf):
    """Ordered fill on events, holes every 7th / 5th id."""
    e = TB.events(spark, sf)
    k = F.col("event_id")
    holes = e.select("event_id", F.when(k % 7 != 0, F.col("value")).alias("value"),
                     F.when(k % 5 != 0, F.col("event_type")).alias("event_type"))
    return C.forward_fill(holes, "event_id")


_NUM = ["invoice_id", "customer_id", "total", "quantity", "unit_price"]
_STR = ["date", "time", "product_line", "payment", "gender", "customer_type"]


def _median_sql(src, cols):
    sel = []
    for c in SALES_COLS:
        if c in cols:
            med = f"(select quantile_cont({c}, 0.5) from {src})"
            sel.append(f"coalesce(cast({c} as double), {med}) as {c}")
        else:
            sel.append(c)
    return ", ".join(sel)


#: Also an integer column with NULLs whose median may lie between two integers.
HOLES = """, dirty_holes as (select * replace (
  case when invoice_id % 3 = 0 or quantity % 2 = 0 then null else quantity * 2 + invoice_id % 2 end as quantity) from dirty_all)
"""


def holed_sales(spark, sf):
    k, q = F.col("invoice_id"), F.col("quantity")
    return dirty_sales(spark, sf).withColumn("quantity", F.when((k % 3 == 0) | (q % 2 == 0), F.lit(None)).otherwise(
        (q * 2 + k % 2).cast("int")))


@register("impute_median", DIRTY + HOLES + "select " + _median_sql(
    "dirty_holes", _NUM) + " from dirty_holes")
def q_impute_median(spark, sf):
    """Numeric NULLs -> exact median."""
    return C.impute_median(holed_sales(spark, sf), _NUM)


def _mode_sql(src, c):
    return (f"(select {c} from {src} where {c} is not null group by {c} "
            f"order by count(*) desc, {c} asc limit 1)")


@register("impute_mode", DIRTY + "select " + ", ".join(
    f"coalesce({c}, {_mode_sql('dirty_all', c)}) as {c}" if c in _STR else c
    for c in SALES_COLS) + " from dirty_all")
def q_impute_mode(spark, sf):
    """C4: string NULLs -> most frequent value, lowest on ties."""
    return C.impute_mode(dirty_sales(spark, sf), _STR)


@register("parse_date", DIRTY + f"""select invoice_id, date as raw, {PARSE_SQL.format(c='date')} as date
from dirty_all""")
def q_parse_date(spark, sf):
    """Text dates in two formats plus junk -> timestamp or NULL."""
    d = dirty_sales(spark, sf)
    return d.select("invoice_id", F.col("date").alias("raw"), X.parse_date("date").alias("date"))


@register("date_parts", SALES + """select invoice_id, date, dayname(date) as day,
  monthname(date) as month, cast(year(date) as integer) as year from sales""")
def q_date_parts(spark, sf):
    """Weekday name, month name, year."""
    return sales(spark, sf).select("invoice_id", "date", X.day_name("date").alias("day"),
                                   X.month_name("date").alias("month"), F.year("date").alias("year"))


@register("hour_of_time", DIRTY + f"select invoice_id, time, {HOUR_SQL.format(t='time')} as hour from dirty_all")
def q_hour_of_time(spark, sf):
    """Hour from an H:mm string."""
    return dirty_sales(spark, sf).select("invoice_id", "time", X.hour_of_time("time").alias("hour"))


@register("hour_fallback", DIRTY + f"""select invoice_id, time,
  coalesce({HOUR_SQL.format(t='time')}, cast(hour({PARSE_SQL.format(c='date')}) as integer), 0) as hour
from dirty_all""")
def q_hour_fallback(spark, sf):
    """Hour from time, else from the timestamp; NULL -> 0 as in peak finding."""
    d = dirty_sales(spark, sf).withColumn("date", X.parse_date("date"))
    return C.hour_fallback(d, null_as_zero=True).select("invoice_id", "time", "hour")


@register("drop_null_rows", DIRTY + """select * from dirty_all
where total is not null and unit_price is not null and product_line is not null and time is not null""")
def q_drop_null_rows(spark, sf):
    """Rows with a NULL in any column dropped."""
    return C.drop_null_rows(dirty_sales(spark, sf))


@register("inf_to_null", SALES + """select invoice_id,
  case when isinf(r) or isnan(r) then null else r end as ratio
from (select invoice_id, case quantity % 4 when 0 then total * 'inf'::double
                              when 1 then -total * 'inf'::double
                              when 2 then 'nan'::double else total end as r from sales)""")
def q_inf_to_null(spark, sf):
    """+-inf and NaN (as IEEE division by zero would give) become NULL."""
    q = F.col("quantity") % 4
    r = (F.when(q == 0, F.col("total") * F.lit(float("inf")))
          .when(q == 1, -F.col("total") * F.lit(float("inf")))
          .when(q == 2, F.lit(float("nan"))).otherwise(F.col("total")))
    return C.inf_to_null(sales(spark, sf).select("invoice_id", r.alias("ratio")), ["ratio"])


@register("null_counts", DIRTY + "select * from (" + " union all ".join(
    f"select '{c}' as column, cast(count(*) - count({c}) as bigint) as nulls from dirty_all"
    for c in SALES_COLS) + ")")
def q_null_counts(spark, sf):
    """C11: NULLs per column."""
    return C.null_counts(dirty_sales(spark, sf))


@register("format_date", SALES + "select invoice_id, strftime(date, '%Y-%m-%d') as day from sales")
def q_format_date(spark, sf):
    """Date -> yyyy-MM-dd text."""
    return sales(spark, sf).select("invoice_id", X.format_date("date").alias("day"))


def _clean_sql(month_year: bool):
    parts = ["dayname(date) as day"]
    if month_year:
        parts += ["monthname(date) as month", "cast(year(date) as integer) as year"]
    extra = ", total / nullif(quantity, 0) as avg_item_price" if month_year else ""
    return (DIRTY + f", dd as (select distinct * from dirty_all), ff as ({_fill_sql(SALES_COLS, 'dd')}),"
            f" pp as (select * replace ({PARSE_SQL.format(c='date')} as date) from ff)\n"
            f"select invoice_id, customer_id, date, time, total, quantity, "
            f"unit_price, product_line, payment, gender, customer_type, "
            f"{', '.join(parts)}, {HOUR_SQL.format(t='time')} as hour{extra} from pp")


@register("clean_basic", _clean_sql(False))
def q_clean_basic(spark, sf):
    """Dedupe -> fill -> parse -> weekday -> hour."""
    return PL.clean_basic(dirty_sales(spark, sf), SALES_COLS)


@register("clean_prepare", _clean_sql(True))
def q_clean_prepare(spark, sf):
    """C14: C13 + month, year, average item price."""
    return PL.clean_prepare(dirty_sales(spark, sf), SALES_COLS)


_P_NUM = ["total", "quantity", "unit_price", "year", "hour"]
_P_STR = ["date_s", "time", "product_line", "payment", "gender", "customer_type", "day", "month"]


def _process_sql():
    base = (DIRTY + ", dd as (select distinct * from dirty_all), pp as (select invoice_id, customer_id, "
            f"{PARSE_SQL.format(c='date')} as date, time, total, quantity, unit_price, product_line, payment, "
            f"gender, customer_type from dd), parts as (select *, dayname(date) as day, monthname(date) as month, "
            f"cast(year(date) as integer) as year, {HOUR_SQL.format(t='time')} as hour from pp), "
            "imp as (select ")
    sel = []
    for c in ["invoice_id", "customer_id", "date", "time", "total", "quantity", "unit_price",
              "product_line", "payment", "gender", "customer_type", "day", "month", "year", "hour"]:
        if c in _P_NUM:
            med = f"(select quantile_cont({c}, 0.5) from parts)"
            sel.append(f"coalesce(cast({c} as double), {med}) as {c}")
        elif c in ("date", "invoice_id", "customer_id"):
            sel.append(c)
        else:
            sel.append(f"coalesce({c}, {_mode_sql('parts', c)}) as {c}")
    return (base + ", ".join(sel) + " from parts)\n"
            "select *, total - quantity * unit_price as profit, "
            "(total - quantity * unit_price) / nullif(total, 0) * 100 as profit_margin from imp")


@register("process_sales", _process_sql())
def q_process_sales(spark, sf):
    """Dedupe -> parse -> parts -> hour -> median/mode impute -> profit."""
    return PL.process_sales(dirty_sales(spark, sf))


# ---------------------------------------------------------------- projections

@register("profit", SALES + """select invoice_id, total - quantity * unit_price as profit,
  (total - quantity * unit_price) / nullif(total, 0) * 100 as profit_margin from sales""")
def q_profit(spark, sf):
    """Profit and margin %."""
    s = sales(spark, sf)
    p = X.profit()
    return s.select("invoice_id", p.alias("profit"), X.profit_margin(p).alias("profit_margin"))


@register("avg_item_price", SALES + """select invoice_id,
  total / nullif(quantity, 0) as avg_item_price from sales""")
def q_avg_item_price(spark, sf):
    """P2."""
    return sales(spark, sf).select("invoice_id", X.avg_item_price().alias("avg_item_price"))


@register("avg_purchase_value", SALES + """select invoice_id,
  total / case when quantity = 0 then 1 else quantity end as avg_purchase_value from sales""")
def q_avg_purchase_value(spark, sf):
    """P3."""
    return sales(spark, sf).select("invoice_id", X.avg_purchase_value().alias("avg_purchase_value"))


AS_OF = "2001-08-01"


@register("days_since", SALES + f"""select invoice_id,
  cast(date_diff('day', cast(date as date), date '{AS_OF}') as integer) as days_since from sales""")
def q_days_since(spark, sf):
    """Whole days from the sale to the as-of date."""
    return sales(spark, sf).select("invoice_id", X.days_since("date", AS_OF).alias("days_since"))


@register("churn_label", SALES + f"""select invoice_id,
  cast(date_diff('day', cast(date as date), date '{AS_OF}') > 60 as integer) as churn_60,
  cast(date_diff('day', cast(date as date), date '{AS_OF}') > 30 as integer) as churn_30 from sales""")
def q_churn_label(spark, sf):
    """P5: label at 60 days (copy A) and 30 days (copy B)."""
    d = X.days_since("date", AS_OF)
    return sales(spark, sf).select("invoice_id", X.churn_label(d, 60).alias("churn_60"),
                                   X.churn_label(d, 30).alias("churn_30"))


@register("purchase_frequency", SALES + f"""select customer_id,
  round(date_diff('day', cast(min(date) as date), date '{AS_OF}') / greatest(count(*), 1), 2) as frequency
from sales group by customer_id""")
def q_purchase_frequency(spark, sf):
    """Days since first purchase per purchase, per customer."""
    g = sales(spark, sf).groupBy("customer_id").agg(F.min("date").alias("first"), F.count(F.lit(1)).alias("n"))
    return rounded(g.select("customer_id", X.purchase_frequency(X.days_since("first", AS_OF), "n")
                            .alias("frequency")))


@register("numeric_columns", SALES + "select invoice_id, customer_id, total, quantity, unit_price from sales")
def q_numeric_columns(spark, sf):
    """P10: the numeric columns of the sales table (rows only)."""
    s = sales(spark, sf)
    return s.select(*C.numeric_columns(s))


@register("series_rename", SALES + "select date as ds, total as y from sales")
def q_series_rename(spark, sf):
    """(date, total) -> (ds, y), not aggregated."""
    return sales(spark, sf).select(F.col("date").alias("ds"), F.col("total").alias("y"))


# ---------------------------------------------------------------- filters

CAT, CTYPE, GENDER, D0, D1 = "PROMO", "BUILDING", "Female", "1997-01-01", "1998-12-31"


@register("filter_category", SALES + f"select * from sales where product_line = '{CAT}'")
def q_filter_category(spark, sf):
    return FL.filter_category(sales(spark, sf), CAT)


@register("filter_customer_type",
          SALES + f"select * from sales where customer_type = '{CTYPE}'")
def q_filter_customer_type(spark, sf):
    return FL.filter_customer_type(sales(spark, sf), CTYPE)


@register("filter_gender", SALES + f"select * from sales where gender = '{GENDER}'")
def q_filter_gender(spark, sf):
    return FL.filter_gender(sales(spark, sf), GENDER)


@register("filter_date_range", EV + """select * from ev
where date >= timestamp '2024-01-05' and date <= timestamp '2024-01-12'""")
def q_filter_date_range(spark, sf):
    """end is midnight, so later times on the last day drop."""
    return FL.filter_date_range(TB.events_sales(spark, sf), "2024-01-05", "2024-01-12")


@register("filter_date_range_days", EV + """select * from ev
where cast(date as date) between date '2024-01-05' and date '2024-01-12'""")
def q_filter_date_range_days(spark, sf):
    """the last day is whole."""
    return FL.filter_date_range_days(TB.events_sales(spark, sf), "2024-01-05", "2024-01-12")


@register("filter_compose", SALES + f"""select * from sales
where product_line = '{CAT}' and customer_type = '{CTYPE}' and gender = '{GENDER}'
  and date >= timestamp '{D0}' and date <= timestamp '{D1}'""")
def q_filter_compose(spark, sf):
    """all filters conjunctively."""
    return FL.filter_compose(sales(spark, sf), CAT, CTYPE, GENDER, D0, D1)


@register("filter_compose_count", SALES + f"""select count(*) filter (where product_line = '{CAT}'
  and customer_type = '{CTYPE}' and gender = '{GENDER}' and date >= timestamp '{D0}' and date <= timestamp '{D1}') as matching,
  count(*) as all_rows from sales""")
def q_filter_compose_count(spark, sf):
    """how many rows match."""
    return FL.filter_count(sales(spark, sf), category=CAT, customer_type=CTYPE, gender=GENDER, start=D0, end=D1)


UPLOAD_COLS = [c for c in SALES_COLS if c != "customer_id"]


@register("upload_clean_chart", DIRTY + f""", up as (select 'INV-' || invoice_id as invoice_id, date, time, total, quantity,
  unit_price, product_line, payment, gender, customer_type from dirty_all),
dd as (select distinct * from up), ff as (select {', '.join(
    f"last_value({c} ignore nulls) over (order by {', '.join(k + ' nulls first' for k in UPLOAD_COLS)} "
    f"rows between unbounded preceding and current row) as {c}" for c in UPLOAD_COLS)} from dd)
select product_line, round(coalesce(sum(total), 0), 2) as sales from ff
where gender = 'Female' and customer_type = 'BUILDING' and product_line is not null group by 1""")
def q_upload_clean_chart(spark, sf):
    """The upload path: CSV with text invoice ids -> C13 -> F6 -> A1."""
    rows = dirty_sales(spark, sf).drop("customer_id")
    rows = rows.withColumn("invoice_id", F.concat(F.lit("INV-"), F.col("invoice_id").cast("string")))
    path = _scratch(spark, "upload")
    IO.csv_export(rows, path, upload_names=True)
    clean = PL.clean_basic(IO.csv_scan(spark, path).select(UPLOAD_COLS), UPLOAD_COLS)
    return rounded(A.sum_by(FL.filter_compose(clean, gender="Female", customer_type="BUILDING"), "product_line"))


@register("filter_isin", SALES + """, top as (select product_line from sales group by product_line
  order by sum(total) desc, product_line limit 3)
select * from sales where product_line in (select product_line from top)""")
def q_filter_isin(spark, sf):
    """rows of the top-3 categories (semi join with the 3-row frame)."""
    from tillsight.operators import ranking as R
    s = sales(spark, sf)
    top = R.top_bottom_products(s, 3).where("which = 'top'")
    return FL.filter_isin(s, top, "product_line")


@register("filter_values", SALES + "select distinct payment from sales where payment is not null")
def q_filter_values(spark, sf):
    """F8."""
    return FL.filter_values(sales(spark, sf), "payment")


@register("date_bounds", SALES + "select min(date) as min_date, max(date) as max_date from sales")
def q_date_bounds(spark, sf):
    """F9."""
    return FL.date_bounds(sales(spark, sf))


# ---------------------------------------------------------------- aggregates

@register("sales_by_category", SALES + _sum_sql("product_line"))
def q_sales_by_category(spark, sf):
    """A1."""
    return rounded(A.sales_by_category(sales(spark, sf)))


@register("sales_by_payment", SALES + _sum_sql("payment"))
def q_sales_by_payment(spark, sf):
    """A2."""
    return rounded(A.sales_by_payment(sales(spark, sf)))


@register("sales_by_gender", SALES + _sum_sql("gender"))
def q_sales_by_gender(spark, sf):
    """A3."""
    return rounded(A.sales_by_gender(sales(spark, sf)))


@register("sales_by_customer_type", SALES + _sum_sql("customer_type"))
def q_sales_by_customer_type(spark, sf):
    """A4."""
    return rounded(A.sales_by_customer_type(sales(spark, sf)))


@register("daily_sales", SALES + """select cast(date as date) as day, round(sum(total), 2) as sales
from sales where date is not null group by 1""")
def q_daily_sales(spark, sf):
    """A5."""
    return rounded(A.daily_sales(sales(spark, sf)))


@register("hourly_sales", SALES + f"""select {HOUR_SQL.format(t='time')} as hour,
  round(sum(total), 2) as sales from sales where {HOUR_SQL.format(t='time')} is not null group by 1""")
def q_hourly_sales(spark, sf):
    """A6."""
    return rounded(A.hourly_sales(hourly(spark, sf)))


@register("weekday_sales", SALES + """select cast(isodow(date) - 1 as integer) as weekday, dayname(date) as day,
  round(sum(total), 2) as sales from sales where date is not null group by 1, 2""")
def q_weekday_sales(spark, sf):
    """A7."""
    return rounded(A.weekday_sales(sales(spark, sf)))


@register("day_hour_sales", EV + """select cast(isodow(date) - 1 as integer) as weekday, dayname(date) as day,
  cast(hour(date) as integer) as hour, round(sum(total), 2) as sales from ev group by 1, 2, 3""")
def q_day_hour_sales(spark, sf):
    """A8 on events (real time of day)."""
    return rounded(A.day_hour_sales(events_hourly(spark, sf)))


@register("sales_heatmap", SALES + f""", cells as (select cast(isodow(date) - 1 as integer) as weekday,
  {HOUR_SQL.format(t='time')} as hour, sum(total) as s from sales
  where date is not null and {HOUR_SQL.format(t='time')} is not null group by 1, 2),
spine as (select cast(i // 24 as integer) as weekday, cast(i % 24 as integer) as hour from range(168) t(i))
select spine.weekday, ['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday'][spine.weekday + 1] as day,
  spine.hour, round(coalesce(s, 0), 2) as sales
from spine left join cells using (weekday, hour)""")
def q_sales_heatmap(spark, sf):
    """Dense 7x24 grid over all sales; hours outside 10-20 have no sales and show 0."""
    return rounded(A.sales_heatmap(hourly(spark, sf)))


@register("avg_price_by_category", SALES + """select product_line, round(avg(unit_price), 2) as avg_price
from sales where product_line is not null group by 1""")
def q_avg_price_by_category(spark, sf):
    """A10."""
    return rounded(A.avg_price_by_category(sales(spark, sf)))


@register("quantity_by_category", SALES + """select product_line, cast(sum(quantity) as bigint) as quantity
from sales where product_line is not null group by 1""")
def q_quantity_by_category(spark, sf):
    """A11."""
    return A.quantity_by_category(sales(spark, sf))


@register("payment_counts", SALES + """select payment, count(*) as n,
  round(count(*) * 100.0 / sum(count(*)) over (), 2) as share_pct from sales
where payment is not null group by payment""")
def q_payment_counts(spark, sf):
    """A12."""
    return rounded(A.payment_counts(sales(spark, sf)))


@register("kpi_summary", SALES + """select round(sum(total), 2) as total_sales, count(distinct invoice_id) as invoices,
  round(sum(total) / count(distinct invoice_id), 2) as sales_per_invoice,
  cast(sum(quantity) as bigint) as items from sales""")
def q_kpi_summary(spark, sf):
    """Exact on all rows."""
    return rounded(A.kpi_summary(sales(spark, sf)))


_DESC_COLS = ["total", "quantity", "unit_price"]


@register("describe_numeric", SALES + " union all ".join(
    f"""select '{c}' as column, count({c}) as count, round(avg({c}), 2) as mean, round(stddev_samp({c}), 2) as std,
  round(min({c}), 2) as min, round(quantile_cont({c}, 0.25), 2) as p25, round(quantile_cont({c}, 0.5), 2) as p50,
  round(quantile_cont({c}, 0.75), 2) as p75, round(max({c}), 2) as max from sales""" for c in _DESC_COLS))
def q_describe_numeric(spark, sf):
    """Pandas describe, exact quartiles."""
    return rounded(A.describe_numeric(sales(spark, sf), _DESC_COLS))


@register("customer_features", SALES + """select customer_id, min(date) as first_date, max(date) as last_date,
  count(date) as purchases, round(sum(total), 2) as total_sum, round(avg(total), 2) as total_mean,
  cast(sum(quantity) as bigint) as quantity_sum, round(avg(quantity), 2) as quantity_mean
from sales where customer_id is not null group by customer_id""")
def q_customer_features(spark, sf):
    """A17."""
    return rounded(A.customer_features(sales(spark, sf)))


WEEK_END_SQL = "cast(date_trunc('week', {d}) as date) + 6"


@register("weekly_sales", SALES + f""", w as (select {WEEK_END_SQL.format(d='date')} as week, sum(total) as s
  from sales where date is not null group by 1),
spine as (select cast(unnest(generate_series(min(week), max(week), interval 7 day)) as date) as week from w)
select spine.week, round(coalesce(s, 0), 2) as sales from spine left join w using (week)""")
def q_weekly_sales(spark, sf):
    """Weeks end on Sunday; empty weeks 0."""
    return rounded(A.weekly_sales(sales(spark, sf)))


def _topk_sql(k, desc=True):
    return (f"select product_line from sales where product_line is not null group by product_line "
            f"order by sum(total) {'desc' if desc else 'asc'}, product_line limit {k}")


@register("weekly_category_pivot", SALES + f""", top as ({_topk_sql(3)}),
w as (select cast(date_trunc('week', date) as date) as week, product_line, sum(total) as s
  from sales where date is not null and product_line in (select product_line from top) group by 1, 2),
weeks as (select distinct week from w)
select weeks.week, top.product_line, round(coalesce(w.s, 0), 2) as sales
from weeks join top on true left join w on w.week = weeks.week and w.product_line = top.product_line""")
def q_weekly_category_pivot(spark, sf):
    """Monday weeks x top-3 categories, 0 filled (pivot, returned as rows)."""
    from tillsight.operators import ranking as R
    s = sales(spark, sf)
    top = R.top_bottom_products(s, 3).where("which = 'top'")
    return rounded(A.weekly_category_pivot(s, top))


@register("weekly_category_pivot_bottom", SALES + f""", bot as ({_topk_sql(3, False)}),
w as (select cast(date_trunc('week', date) as date) as week, product_line, sum(total) as s
  from sales where date is not null and product_line in (select product_line from bot) group by 1, 2),
weeks as (select distinct week from w)
select weeks.week, bot.product_line, round(coalesce(w.s, 0), 2) as sales
from weeks join bot on true left join w on w.week = weeks.week and w.product_line = bot.product_line""")
def q_weekly_category_pivot_bottom(spark, sf):
    """A19 for the bottom-3 categories."""
    from tillsight.operators import ranking as R
    s = sales(spark, sf)
    bot = R.top_bottom_products(s, 3).where("which = 'bottom'")
    return rounded(A.weekly_category_pivot(s, bot))


@register("churn_distribution", SALES + f"""select cast(date_diff('day', cast(date as date), date '{AS_OF}') > 60 as integer) as churn,
  count(*) as n, case when date_diff('day', cast(date as date), date '{AS_OF}') > 60 then 'Churned' else 'Retained' end as status
from sales group by 1, 3""")
def q_churn_distribution(spark, sf):
    """Rows per churn class."""
    s = sales(spark, sf).withColumn("churn", X.churn_label(X.days_since("date", AS_OF), 60))
    return A.churn_distribution(s)


@register("has_time_of_day", EV + "select count(distinct strftime(date, '%H:%M:%S')) > 1 as has_time from ev")
def q_has_time_of_day(spark, sf):
    """A27 on events (times of day present)."""
    return A.has_time_of_day(TB.events_sales(spark, sf))


@register("has_time_of_day_sales", SALES + "select count(distinct strftime(date, '%H:%M:%S')) > 1 as has_time from sales")
def q_has_time_of_day_sales(spark, sf):
    """A27 on the sales table (dates at midnight only)."""
    return A.has_time_of_day(sales(spark, sf))


@register("csv_scan", UPLOAD_SQL)
def q_csv_scan(spark, sf):
    """Header CSV in a chosen encoding (cp1252, which needs Spark's legacy charsets)."""
    path = _scratch(spark, "csv-cp1252")
    IO.csv_export(_upload_frame(spark, sf), path, upload_names=True, encoding="cp1252")
    return _contract(IO.csv_scan(spark, path, encoding="cp1252"))


@register("partitioned_sales_range", SALES + f"""select product_line, round(coalesce(sum(total), 0), 2) as sales,
  count(*) as n from sales where date >= timestamp '{D0}' and date <= timestamp '{D1}'
  and product_line is not null group by 1""")
def q_partitioned_sales_range(spark, sf):
    """Sales table written once partitioned by month; a date-range query reads only
    the months in range (PartitionFilters) and sums per category."""
    path = _scratch(spark, "sales-by-month")
    IO.write_partitioned_table(sales(spark, sf), path)
    rng = IO.read_months(spark, path, D0, D1)
    g = rng.where(F.col("product_line").isNotNull()).groupBy("product_line").agg(
        F.coalesce(F.sum("total"), F.lit(0.0)).alias("sales"), F.count(F.lit(1)).alias("n"))
    return rounded(g)
