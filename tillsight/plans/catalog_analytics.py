"""Registered queries, part 2: windows, correlation, joins, models and rules.

Operators that take a model output (cluster label, churn probability, forecast)
are checked twice: with the trained MLlib output (rows-only, property tests in
``tests/``) and with a deterministic stand-in input that DuckDB can compute
(``customer_id % 3`` as cluster, ``(customer_id % 101) / 100`` as probability,
a weekday-mean forecast).
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tillsight.functions import expressions as X
from tillsight.operators import aggregate as A
from tillsight.operators import churn as CH
from tillsight.operators import correlate as CR
from tillsight.operators import forecast as FC
from tillsight.operators import insights as IN
from tillsight.operators import ranking as R
from tillsight.operators import segment as SG
from tillsight.plans.catalog_base import AS_OF, EV, SALES, WEEK_END_SQL, events_hourly, sales
from tillsight.plans.registry import register, rounded
from tillsight.sources import tables as TB
from tillsight.session import materialize

CORR_COLS = ["total", "quantity", "unit_price"]


def labelled(spark, sf):
    """Sales rows with the stand-in cluster label."""
    return sales(spark, sf).withColumn("cluster", (F.col("customer_id") % 3).cast("int"))


LABELLED = SALES + ", lab as (select *, cast(customer_id % 3 as integer) as cluster from sales)\n"


def series(spark, sf):
    return FC.forecast_series(sales(spark, sf))


def standin(spark, sf, periods=30):
    # The forecast reads the daily series several times: written once.
    return FC.weekday_mean_forecast(FC.materialized_series(sales(spark, sf)), periods)


SERIES_CTE = """, series as (select cast(date as date) as ds, cast(sum(total) as double) as y
  from sales where date is not null group by 1)"""
STANDIN = SALES + SERIES_CTE + """,
means as (select isodow(ds) as wd, avg(y) as yhat from series group by 1),
frame as (select ds from series union all
  select cast(unnest(generate_series((select max(ds) from series) + 1, (select max(ds) from series) + 30,
                                     interval 1 day)) as date) as ds),
fb as (select f.ds, case when s.y is null then m.yhat else (m.yhat + s.y) / 2 end as yhat
  from frame f left join means m on isodow(f.ds) = m.wd left join series s on s.ds = f.ds),
fc as (select ds, yhat, yhat * 0.9 as yhat_lower, yhat * 1.1 as yhat_upper from fb),
joined as (select fc.*, s.y from fc left join series s using (ds))
"""


def _pair_sql(a, b):
    return f"covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0)"


def _matrix_sql(cols, src="sales"):
    parts = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            parts.append(f"select '{a}' as col1, '{b}' as col2, {i} as i, {j} as j, "
                         f"round({_pair_sql(a, b)}, 4) as r from {src}")
    return " union all ".join(parts)


# ---------------------------------------------------------------- windows

@register("week_over_week", SALES + f""", w as (select {WEEK_END_SQL.format(d='date')} as week, sum(total) as s
  from sales where date is not null group by 1),
spine as (select cast(unnest(generate_series(min(week), max(week), interval 7 day)) as date) as week from w),
wk as (select spine.week, coalesce(s, 0) as sales from spine left join w using (week))
select week, round(sales, 2) as sales, round(lag(sales) over (order by week), 2) as prev_sales,
  round((sales - lag(sales) over (order by week)) / nullif(lag(sales) over (order by week), 0) * 100, 2) as pct_change,
  week = max(week) over () as is_last from wk""")
def q_week_over_week(spark, sf):
    """W1."""
    return rounded(R.week_over_week(sales(spark, sf)))


@register("top_bottom_products", SALES + """, s as (select product_line, sum(total) as sales from sales
  where product_line is not null group by 1),
r as (select *, row_number() over (order by sales desc, product_line) as rt,
             row_number() over (order by sales asc, product_line) as rb from s)
select 'top' as which, rt as rank, product_line, round(sales, 2) as sales from r where rt <= 3
union all select 'bottom', rb, product_line, round(sales, 2) from r where rb <= 3""")
def q_top_bottom_products(spark, sf):
    """Top-3 and bottom-3 categories."""
    return rounded(R.top_bottom_products(sales(spark, sf), 3)).withColumn("rank", F.col("rank").cast("long"))


@register("peak_periods", EV + """, c as (select cast(isodow(date) - 1 as integer) as weekday, dayname(date) as day,
  cast(hour(date) as integer) as hour, sum(total) as sales from ev where date is not null group by 1, 2, 3),
r as (select *, row_number() over (order by sales desc, weekday, hour) as hi,
             row_number() over (order by sales asc, weekday, hour) as lo from c)
select 'busiest' as which, weekday, day, hour, round(sales, 2) as sales from r where hi = 1
union all select 'slowest', weekday, day, hour, round(sales, 2) from r where lo = 1""")
def q_peak_periods(spark, sf):
    """W3 on events."""
    return rounded(R.peak_periods(events_hourly(spark, sf)))


@register("top_products_share", SALES + """, g as (select product_line, sum(total) as sales,
  cast(sum(quantity) as bigint) as quantity from sales where product_line is not null group by 1)
select * from (select row_number() over (order by sales desc, product_line) as rank, product_line,
  round(sales, 2) as sales, quantity, round(sales * 100.0 / sum(sales) over (), 2) as share_pct from g)
where rank <= 5""")
def q_top_products_share(spark, sf):
    """Top 5 categories and their share."""
    return rounded(R.top_products_share(sales(spark, sf), 5)).withColumn("rank", F.col("rank").cast("long"))


@register("ranked_correlations", SALES + f""", m as ({_matrix_sql(CORR_COLS)})
select col1, col2, r from m where i < j order by abs(r) desc, i, j limit 2""")
def q_ranked_correlations(spark, sf):
    """Two strongest unordered pairs, no floor."""
    return CR.ranked_correlations(sales(spark, sf), CORR_COLS, k=2, min_abs=None).withColumn(
        "r", F.round("r", 4))


HEAD_ORDER = ["total", "invoice_id", "quantity", "unit_price", "product_line"]


@register("head_n", SALES + """select * from sales
order by total desc, invoice_id, quantity, unit_price, product_line limit 10""")
def q_head_n(spark, sf):
    """First 10 rows by total (a top-k report)."""
    return R.head_n(sales(spark, sf), 10, [F.desc(HEAD_ORDER[0]), *HEAD_ORDER[1:]])


@register("page", SALES + """select *, (select cast(ceil(count(*) / 10.0) as bigint) from sales) as pages
from sales order by invoice_id, total, quantity, unit_price, product_line limit 10 offset 20""")
def q_page(spark, sf):
    """Page 3 of 10 rows and the page count."""
    return R.page(sales(spark, sf), 3, 10, ["invoice_id", "total", "quantity", "unit_price", "product_line"])


@register("page_deep", SALES + """select *, (select cast(ceil(count(*) / 50.0) as bigint) from sales) as pages
from sales order by invoice_id, total, quantity, unit_price, product_line limit 50 offset 49950""")
def q_page_deep(spark, sf):
    """Page 1,000 of 50 rows, by the page index."""
    return R.page(sales(spark, sf), 1000, 50, ["invoice_id", "total", "quantity", "unit_price", "product_line"])


@register("page_after", EV + "select * from ev where invoice_id > 1000 order by invoice_id limit 25")
def q_page_after(spark, sf):
    """W7, keyset form: the page after event 1000."""
    return R.page_after(TB.events_sales(spark, sf), 25, "invoice_id", 1000)


@register("last_n", SALES + SERIES_CTE + " select ds, round(y, 2) as y from series order by ds desc limit 30")
def q_last_n(spark, sf):
    """Last 30 days of the daily series."""
    return rounded(R.last_n(series(spark, sf), 30))


# ---------------------------------------------------------------- correlation

@register("correlation_matrix", SALES + _matrix_sql(CORR_COLS))
def q_correlation_matrix(spark, sf):
    """All ordered pairs, pairwise complete."""
    return CR.correlation_matrix(sales(spark, sf), CORR_COLS).withColumn("r", F.round("r", 4))


@register("strong_correlations", SALES + f", m as ({_matrix_sql(CORR_COLS + ['profit'], 'sp')})"
          .replace("from sp", "from (select *, total - quantity * unit_price as profit from sales)")
          + " select col1, col2, r from m where i <> j and abs(r) > 0.7")
def q_strong_correlations(spark, sf):
    """Ordered pairs with |r| > 0.7 (profit included, so some pairs qualify)."""
    s = sales(spark, sf).withColumn("profit", X.profit())
    return CR.strong_correlations(s, CORR_COLS + ["profit"], 0.7).withColumn("r", F.round("r", 4))


@register("zscore", SALES + """select invoice_id,
  round(coalesce((total - avg(total) over ()) / nullif(stddev_pop(total) over (), 0), 0), 6) as total_z,
  round(coalesce((quantity - avg(quantity) over ()) / nullif(stddev_pop(quantity) over (), 0), 0), 6) as quantity_z
from sales""")
def q_zscore(spark, sf):
    """Population z-score."""
    z = SG.zscore(sales(spark, sf), ["total", "quantity"])
    return z.select("invoice_id", F.round("total_z", 6).alias("total_z"), F.round("quantity_z", 6).alias("quantity_z"))


# ---------------------------------------------------------------- joins

@register("forecast_actual_join", STANDIN + """select ds, round(yhat, 2) as yhat, round(yhat_lower, 2) as yhat_lower,
  round(yhat_upper, 2) as yhat_upper, round(y, 2) as y from joined""")
def q_forecast_actual_join(spark, sf):
    """J1 with the stand-in forecast (actuals summed per day first)."""
    return rounded(standin(spark, sf))


@register("product_matrix", SALES + """, g as (select product_line, avg(unit_price) as avg_price,
  cast(sum(quantity) as bigint) as quantity from sales where product_line is not null group by 1)
select product_line, round(avg_price, 2) as avg_price, quantity, round(avg_price * quantity, 2) as revenue,
  case when avg_price * quantity > 1000 and quantity > 50 then 'High Performer'
       when avg_price * quantity > 500 or quantity > 30 then 'Good Performer'
       when avg_price > 50 then 'Premium'
       when avg_price * quantity < 200 and quantity < 10 then 'Under Performer'
       else 'Average' end as rating from g""")
def q_product_matrix(spark, sf):
    """Price and quantity per category combined, revenue and rating."""
    from tillsight.operators import joins as J
    return rounded(J.product_matrix(sales(spark, sf)))


# ---------------------------------------------------------------- label-driven aggregates

@register("peak_day_hours", EV + """, c as (select cast(isodow(date) - 1 as integer) as weekday,
  cast(hour(date) as integer) as hour, sum(total) as s from ev group by 1, 2),
pk as (select weekday from c order by s desc, weekday, hour limit 1),
hh as (select cast(isodow(date) - 1 as integer) as weekday, cast(hour(date) as integer) as hour, sum(total) as s
  from ev where cast(isodow(date) - 1 as integer) in (select weekday from pk) group by 1, 2)
select pk.weekday, cast(h.i as integer) as hour, round(coalesce(hh.s, 0), 2) as sales
from pk join range(24) h(i) on true left join hh on hh.weekday = pk.weekday and hh.hour = h.i""")
def q_peak_day_hours(spark, sf):
    """Hour profile of the busiest weekday."""
    e = events_hourly(spark, sf)
    return rounded(A.peak_day_hours(e))


@register("cluster_sizes", LABELLED + "select cluster, count(*) as n from lab group by 1")
def q_cluster_sizes(spark, sf):
    """A21 (stand-in label)."""
    return A.count_by(labelled(spark, sf), ["cluster"])


@register("cluster_product_gender", LABELLED + """select cluster, product_line, gender, count(*) as n from lab
where product_line is not null and gender is not null group by 1, 2, 3""")
def q_cluster_product_gender(spark, sf):
    """A22."""
    return A.count_by(labelled(spark, sf), ["cluster", "product_line", "gender"])


@register("cluster_payment_gender", LABELLED + """select cluster, payment, gender, count(*) as n from lab
where payment is not null and gender is not null group by 1, 2, 3""")
def q_cluster_payment_gender(spark, sf):
    """A23."""
    return A.count_by(labelled(spark, sf), ["cluster", "payment", "gender"])


@register("box_stats", LABELLED + """, q as (select cluster, quantile_cont(total, 0.25) as q1,
  quantile_cont(total, 0.5) as median, quantile_cont(total, 0.75) as q3, min(total) as mn, max(total) as mx
  from lab group by 1),
f as (select *, q1 - 1.5 * (q3 - q1) as lo, q3 + 1.5 * (q3 - q1) as hi from q)
select f.cluster, round(mn, 2) as min, round(q1, 2) as q1, round(median, 2) as median, round(q3, 2) as q3,
  round(mx, 2) as max, round(min(case when total >= lo then total end), 2) as lower_whisker,
  round(max(case when total <= hi then total end), 2) as upper_whisker,
  count(case when total < lo or total > hi then 1 end) as outliers
from lab join f using (cluster) group by f.cluster, mn, q1, median, q3, mx""")
def q_box_stats(spark, sf):
    """Five numbers and whiskers per cluster (exact quartiles)."""
    return rounded(A.box_stats(labelled(spark, sf)))


P_STANDIN = "(customer_id % 101) / 100.0"


def scored_standin(spark, sf):
    """Entity features with the stand-in churn probability."""
    ent = CH.churn_features_entity(sales(spark, sf), AS_OF)
    p = (F.col("customer_id") % 101) / 100.0
    return ent.withColumns({"probability_1": p, "predicted": F.when(p > 0.5, 1.0).otherwise(0.0)})


ENTITY_SQL = SALES + f""", ent as (select customer_id, min(date) as first_date, max(date) as last_date,
  count(*) as purchases, sum(total) as total_sum, avg(total) as total_mean,
  cast(sum(quantity) as bigint) as quantity_sum, avg(quantity) as quantity_mean
  from sales where customer_id is not null and date is not null group by 1),
feat as (select *, cast(date_diff('day', cast(first_date as date), date '{AS_OF}') as integer) as days_since_first,
  cast(date_diff('day', cast(last_date as date), date '{AS_OF}') as integer) as days_since_last from ent),
ef as (select *, days_since_first / greatest(purchases, 1) as frequency,
  cast(days_since_last > 30 as integer) as churn from feat),
sc as (select *, {P_STANDIN} as probability_1,
  case when {P_STANDIN} > 0.5 then 1.0 else 0.0 end as predicted from ef)
"""


@register("probability_histogram", ENTITY_SQL + """select cast(least(floor(probability_1 * 20), 19) as integer) as bin,
  cast(least(floor(probability_1 * 20), 19) as integer) / 20 as bin_start,
  (cast(least(floor(probability_1 * 20), 19) as integer) + 1) / 20 as bin_end, count(*) as n
from sc group by 1""")
def q_probability_histogram(spark, sf):
    """20 bins on [0, 1] (stand-in probability)."""
    return A.probability_histogram(scored_standin(spark, sf), "probability_1")


@register("risk_bucket", ENTITY_SQL + """select customer_id, probability_1,
  case when probability_1 > 0 and probability_1 <= 0.3 then 'Low'
       when probability_1 > 0.3 and probability_1 <= 0.7 then 'Medium'
       when probability_1 > 0.7 and probability_1 <= 1.0 then 'High' end as risk from sc""")
def q_risk_bucket(spark, sf):
    """P8 (stand-in probability; exactly 0 stays NULL)."""
    s = scored_standin(spark, sf)
    return s.select("customer_id", "probability_1", X.risk_bucket("probability_1").alias("risk"))


@register("churn_label_text", ENTITY_SQL + """select customer_id, churn,
  case when churn = 0 then 'Retained' when churn = 1 then 'Churned' end as status from ef""")
def q_churn_label_text(spark, sf):
    """P9."""
    e = CH.churn_features_entity(sales(spark, sf), AS_OF)
    return e.select("customer_id", "churn", X.churn_text("churn").alias("status"))


# ---------------------------------------------------------------- segmentation

@register("segment_customers")
def q_segment_customers(spark, sf):
    """M1: k-means (k=3, seed 42) on z-scored total, quantity, unit price; labels per row."""
    return SG.segment_customers(sales(spark, sf), k=3, seed=42)


@register("segment_customers_profit")
def q_segment_customers_profit(spark, sf):
    """M2: k-means on total, quantity, profit, margin; best of 10 seeds."""
    s = sales(spark, sf)
    p = X.profit()
    s = s.withColumns({"profit": p, "profit_margin": X.profit_margin(p)})
    return SG.segment_customers(s, ["total", "quantity", "profit", "profit_margin"], k=3, seed=42,
                                restarts=10)


@register("segment_choices", SALES + """select * from (select unnest([2, 3, 4, 5, 6]) as k) t, (select count(*) > 0 as rising from sales) u""")
def q_segment_choices(spark, sf):
    """M1 for every number of clusters that the page offers: each finds as many, and explains more than the one before."""
    found = SG.segment_choices(sales(spark, sf))
    before = F.coalesce(F.lag("explained").over(Window.orderBy("k")), F.lit(0.0))
    return found.withColumn("rising", (F.col("explained") > before) & (F.col("clusters") == F.col("k"))).select("k", "rising")


@register("attach_labels", LABELLED + """select invoice_id, total, case when invoice_id % 7 = 0 then null else unit_price end
  as unit_price, case when invoice_id % 7 = 0 then null else cluster end as cluster from lab""")
def q_attach_labels(spark, sf):
    """Labelled rows and those that could not be scored (stand-in label)."""
    s = labelled(spark, sf).withColumn("unit_price", F.when(F.col("invoice_id") % 7 != 0, F.col("unit_price")))
    s = s.select("invoice_id", "total", "unit_price", "cluster")
    return SG.attach_labels(s.where("unit_price is not null"), s.where("unit_price is null").drop("cluster"))


def _label_facts(labelled_rows):
    """What SQL can say of trained labels: rows, labelled rows, clusters, and that the
    clusters' totals (M3) sum to those of the table."""
    facts = labelled_rows.agg(F.count(F.lit(1)).alias("n"), F.count("cluster").alias("labelled"),
                              F.count_distinct("cluster").alias("clusters"), F.min("cluster").alias("first"),
                              F.max("cluster").alias("last"))
    sums = SG.cluster_stats(labelled_rows).agg(F.round(F.sum("total_sum"), 2).alias("total"),
                                               F.sum("total_count").alias("n_total"),
                                               F.sum("quantity_sum").alias("quantity"))
    ordered = SG.cluster_stats(labelled_rows).select(F.lag("total_mean").over(Window.orderBy("cluster")).alias("b"), "total_mean")
    rising = ordered.agg(F.coalesce(F.min(F.col("total_mean") > F.col("b")), F.lit(True)).alias("means_rise"))
    return facts.join(F.broadcast(sums), F.lit(True)).join(F.broadcast(rising), F.lit(True))


def _label_facts_sql(labelled_if):
    return SALES + f"""select count(*) as n, count(*) filter (where {labelled_if}) as labelled, 3 as clusters, 0 as first,
  2 as last, round(sum(total) filter (where {labelled_if}), 2) as total,
  count(total) filter (where {labelled_if}) as n_total, sum(quantity) filter (where {labelled_if})::bigint as quantity,
  true as means_rise from sales"""


@register("segment_customers_facts", _label_facts_sql("unit_price is not null and invoice_id % 7 <> 0"))
def q_segment_customers_facts(spark, sf):
    """M1 -> J3 -> M3 on trained labels, a seventh of the rows without a unit price."""
    s = sales(spark, sf).withColumn("unit_price", F.when(F.col("invoice_id") % 7 != 0, F.col("unit_price")))
    return _label_facts(materialize(SG.segment_customers(s, k=3, seed=42)))


@register("segment_customers_profit_facts", _label_facts_sql("true"))
def q_segment_customers_profit_facts(spark, sf):
    """M2 -> M3 on trained labels."""
    return _label_facts(materialize(q_segment_customers_profit(spark, sf)))


@register("segment_chain_trained", SALES + """select gender, count(*) as n, 3 as clusters,
  round(sum(total), 2) as total from sales group by 1""")
def q_segment_chain_trained(spark, sf):
    """Trained labels -> whole ratio maps (M6): counts and totals per gender over the clusters are the table's."""
    lab = materialize(SG.segment_customers(sales(spark, sf), k=3, seed=42).select("cluster", "gender", "customer_type", "total"))
    ratios = SG.cluster_ratios(lab).where("attribute = 'gender'")
    per = ratios.groupBy(F.col("value").alias("gender")).agg(F.sum("n").alias("n"), F.count_distinct("cluster").cast("int").alias("clusters"))
    return per.join(rounded(lab.groupBy("gender").agg(F.sum("total").alias("total"))), "gender")


@register("cluster_ratios", LABELLED + """, lng as (select cluster, 'gender' as attribute, gender as value from lab union all
  select cluster, 'customer_type', customer_type from lab),
c as (select cluster, attribute, value, count(*) as n from lng where value is not null group by 1, 2, 3)
select *, round(n / sum(n) over (partition by cluster, attribute), 6) as share from c""")
def q_cluster_ratios(spark, sf):
    """M6: the whole ratio maps of gender and customer type."""
    return SG.cluster_ratios(labelled(spark, sf)).withColumn("share", F.round("share", 6))


@register("cluster_stats", LABELLED + """select cluster, round(avg(total), 2) as total_mean,
  round(sum(total), 2) as total_sum, count(total) as total_count, round(avg(quantity), 2) as quantity_mean,
  cast(sum(quantity) as bigint) as quantity_sum from lab group by 1""")
def q_cluster_stats(spark, sf):
    """M3."""
    return rounded(SG.cluster_stats(labelled(spark, sf)))


@register("cluster_stats_range", LABELLED + """select cluster, round(avg(total), 2) as total_mean,
  round(min(total), 2) as total_min, round(max(total), 2) as total_max, count(total) as total_count,
  round(avg(quantity), 2) as quantity_mean, min(quantity) as quantity_min, max(quantity) as quantity_max
from lab group by 1""")
def q_cluster_stats_range(spark, sf):
    """M4."""
    return rounded(SG.cluster_stats_range(labelled(spark, sf)))


@register("cluster_profiles", LABELLED + """select cluster, round(avg(total), 2) as total_mean,
  round(avg(quantity), 2) as quantity_mean from lab group by 1""")
def q_cluster_profiles(spark, sf):
    """M5."""
    return SG.cluster_profiles(labelled(spark, sf))


@register("cluster_demographics", LABELLED + """, lng as (
  select cluster, 'gender' as attribute, gender as value from lab union all
  select cluster, 'customer_type', customer_type from lab union all
  select cluster, 'product_line', product_line from lab union all
  select cluster, 'payment', payment from lab),
c as (select cluster, attribute, value, count(*) as n from lng where value is not null group by 1, 2, 3),
r as (select *, row_number() over (partition by cluster, attribute order by n desc, value) as rank,
  n * 1.0 / sum(n) over (partition by cluster, attribute) as share from c)
select cluster, attribute, rank, value, n, round(share, 6) as share from r
where rank <= case when attribute = 'product_line' then 3 else 1 end""")
def q_cluster_demographics(spark, sf):
    """M6: dominant gender / customer type / payment and top-3 products per cluster."""
    return SG.cluster_demographics(labelled(spark, sf)).withColumn("share", F.round("share", 6)) \
        .withColumn("rank", F.col("rank").cast("long"))


# ---------------------------------------------------------------- churn

@register("churn_features_row", SALES + f"""select invoice_id, total, quantity,
  total / case when quantity = 0 then 1 else quantity end as avg_purchase_value,
  cast(date_diff('day', cast(date as date), date '{AS_OF}') as integer) as days_since_last,
  cast(date_diff('day', cast(date as date), date '{AS_OF}') > 60 as integer) as churn
from sales where date is not null""")
def q_churn_features_row(spark, sf):
    """M7: row-level churn features (label at 60 days)."""
    f = CH.churn_features_row(sales(spark, sf), AS_OF)
    return f.select("invoice_id", "total", "quantity", "avg_purchase_value", "days_since_last", "churn")


@register("churn_features_entity", ENTITY_SQL + """select customer_id, first_date, last_date, purchases,
  round(total_sum, 2) as total_sum, round(total_mean, 2) as total_mean, quantity_sum,
  round(quantity_mean, 2) as quantity_mean, days_since_first, days_since_last, round(frequency, 2) as frequency,
  churn from ef""")
def q_churn_features_entity(spark, sf):
    """M8: per customer features and the 30-day label."""
    e = CH.churn_features_entity(sales(spark, sf), AS_OF)
    return rounded(e)


@register("train_test_split", ENTITY_SQL + """select customer_id, customer_id % 10 < 3 as is_test from ef""")
def q_train_test_split(spark, sf):
    """M9: stable 70/30 split of customers (modulo form; ``method='hash'`` is the default)."""
    e = CH.churn_features_entity(sales(spark, sf), AS_OF)
    return CH.train_test_split(e, "customer_id", method="modulo").select("customer_id", "is_test")


def _trained(spark, sf):
    rows = CH.churn_features_row(sales(spark, sf), AS_OF)
    rows = CH.train_test_split(rows, "invoice_id", method="hash")
    # Fit, scoring and summaries read the key, the features, the label and the split: written once.
    rows = materialize(rows.select("invoice_id", *CH.ROW_FEATURES, "churn", "is_test"))
    model = CH.churn_train(rows, num_trees=100, seed=42)
    return rows, model


@register("churn_accuracy", SALES + f"""select avg(case when (total > 20000)::int = (date_diff('day', cast(date as date),
  date '{AS_OF}') > 60)::int then 1.0 else 0.0 end) as accuracy, count(*) as test_size from sales where invoice_id % 10 < 3""")
def q_churn_accuracy(spark, sf):
    """M11 on the held-out 30 % (modulo split, stand-in prediction)."""
    rows = CH.train_test_split(CH.churn_features_row(sales(spark, sf), AS_OF), "invoice_id", method="modulo")
    return CH.churn_accuracy(rows.withColumn("predicted", (F.col("total") > 20000).cast("double")))


@register("churn_accuracy_trained")
def q_churn_accuracy_trained(spark, sf):
    """M10 + M11: 100-tree forest on row features; accuracy on the held-out 30 %."""
    rows, model = _trained(spark, sf)
    return CH.churn_accuracy(model.score(rows.where("is_test")))


@register("churn_forest_facts", SALES + f"""select count(*) as n, count(*) filter (where quantity % 5 <> 0) as scored,
  true as in_range, true as class_fits, 4 as features, 1.0::double as importances, 100 as trees from sales""")
def q_churn_forest_facts(spark, sf):
    """All rows come back, NULL features give NULL scores, probabilities fit the
    classes, importances sum to 1, 100 trees."""
    rows, model = _trained(spark, sf)
    holed = rows.withColumn("total", F.when(F.col("quantity") % 5 != 0, F.col("total")))
    p = F.col("probability_1")
    facts = model.score(holed).agg(
        F.count(F.lit(1)).alias("n"), F.count(p).alias("scored"), F.min(p.between(0, 1)).alias("in_range"),
        F.min((p > 0.5) == (F.col("predicted") == 1)).alias("class_fits"))
    imp = model.importances(spark).agg(F.count(F.lit(1)).cast("int").alias("features"), F.round(F.sum("importance"), 6).alias("importances"))
    return facts.join(F.broadcast(imp), F.lit(True)).withColumn("trees", F.lit(len(model.model.trees)))


def _trained_customers(spark, sf):
    """Copy B: forest on seven customer features; every customer scored."""
    ent = materialize(CH.train_test_split(CH.churn_features_entity(sales(spark, sf), AS_OF), "customer_id", method="modulo"))
    model = CH.churn_train(ent, features=CH.ENTITY_FEATURES, num_trees=100, seed=42)
    return materialize(model.score(ent)), model


@register("at_risk_trained")
def q_at_risk_trained(spark, sf):
    """M14 on the trained customer-level probability."""
    return CH.at_risk(_trained_customers(spark, sf)[0])


@register("risk_summary_trained", ENTITY_SQL + """select count(*) as customers, count(*) as scored, true as buckets_fit,
  true as at_risk_fits, 7 as features, 1.0::double as importances from ef""")
def q_risk_summary_trained(spark, sf):
    """M12-M15 on the trained customer-level probability: every customer scored; the risk table and
    the at-risk list count what the scores say."""
    scored, model = _trained_customers(spark, sf)
    p = F.col("probability_1")
    facts = scored.agg(F.count(F.lit(1)).alias("customers"), F.count(p).alias("scored"),
                       F.count_if(p > 0).alias("positive"), F.count_if(p > 0.7).alias("high"))
    risk = CH.risk_summary(scored).agg(F.sum("n").alias("in_buckets"), F.sum(F.when(F.col("risk") == "High", F.col("n"))).alias("in_high"))
    listed = CH.at_risk(scored).agg(F.count(F.lit(1)).alias("listed"))
    imp = model.importances(spark).agg(F.count(F.lit(1)).cast("int").alias("features"), F.round(F.sum("importance"), 6).alias("importances"))
    one = facts.join(F.broadcast(risk), F.lit(True)).join(F.broadcast(listed), F.lit(True)).join(F.broadcast(imp), F.lit(True))
    return one.select("customers", "scored",
                      ((F.col("positive") == F.col("in_buckets")) & (F.col("high") == F.coalesce("in_high", F.lit(0)))).alias("buckets_fit"),
                      (F.col("high") == F.col("listed")).alias("at_risk_fits"), "features", "importances")


@register("feature_importance")
def q_feature_importance(spark, sf):
    """M12."""
    _, model = _trained(spark, sf)
    return model.importances(spark)


@register("churn_score")
def q_churn_score(spark, sf):
    """Probability of churn for every row."""
    rows, model = _trained(spark, sf)
    return model.score(rows).select("invoice_id", "churn", "predicted", "probability_1")


@register("at_risk_customers", ENTITY_SQL + """select customer_id, probability_1, days_since_last,
  round(total_sum, 2) as total_sum from sc where probability_1 > 0.7""")
def q_at_risk_customers(spark, sf):
    """M14 (stand-in probability)."""
    return rounded(CH.at_risk(scored_standin(spark, sf)))


@register("risk_summary", ENTITY_SQL + """, b as (select case when probability_1 > 0 and probability_1 <= 0.3 then 'Low'
       when probability_1 > 0.3 and probability_1 <= 0.7 then 'Medium'
       when probability_1 > 0.7 and probability_1 <= 1.0 then 'High' end as risk from sc)
select risk, count(*) as n, round(count(*) * 100.0 / sum(count(*)) over (), 2) as share_pct
from b where risk is not null group by 1""")
def q_risk_summary(spark, sf):
    """M15 (stand-in probability)."""
    return rounded(CH.risk_summary(scored_standin(spark, sf)))


@register("churn_summary", ENTITY_SQL + """select cast(sum(churn) as bigint) as churned, count(*) as entities,
  round(sum(churn) * 100.0 / count(*), 2) as churn_rate, round(100.0 - sum(churn) * 100.0 / count(*), 2) as retention_rate
from ef""")
def q_churn_summary(spark, sf):
    """M16 on customer-level labels."""
    return rounded(CH.churn_summary(CH.churn_features_entity(sales(spark, sf), AS_OF)))


# ---------------------------------------------------------------- forecast

@register("forecast_series", SALES + SERIES_CTE + " select ds, round(y, 2) as y from series")
def q_forecast_series(spark, sf):
    """M17."""
    return rounded(series(spark, sf))


@register("forecast_frame", SALES + SERIES_CTE + """ select ds from series union all
  select cast(unnest(generate_series((select max(ds) from series) + 1, (select max(ds) from series) + 30,
                                     interval 1 day)) as date)""")
def q_forecast_frame(spark, sf):
    """History + 30 days."""
    return FC.forecast_frame(series(spark, sf), 30)


@register("sales_forecast")
def q_sales_forecast(spark, sf):
    """Additive trend + yearly + weekly regression, 30 days ahead."""
    return FC.sales_forecast(sales(spark, sf), 30)


@register("sales_forecast_multiplicative")
def q_sales_forecast_multiplicative(spark, sf):
    """M20."""
    return FC.sales_forecast_multiplicative(sales(spark, sf), 30)


@register("forecast_components")
def q_forecast_components(spark, sf):
    """Trend / weekly / yearly per date (they sum to yhat)."""
    return FC.sales_forecast(sales(spark, sf), 30).select("ds", "trend", "weekly", "yearly", "yhat")


def _forecast_facts(fc):
    parts = F.col("trend") + F.col("weekly") + F.col("yearly")
    near = F.abs(parts - F.col("yhat")) <= 1e-6 * (1 + F.abs("yhat"))
    return fc.agg(F.count(F.lit(1)).alias("days"), F.min("ds").alias("first"), F.max("ds").alias("last"),
                  F.min((F.col("yhat_lower") <= F.col("yhat")) & (F.col("yhat") <= F.col("yhat_upper"))).alias("in_band"),
                  F.min(near).alias("parts_make_yhat"))


FORECAST_FACTS = SALES + SERIES_CTE + """ select count(*) + 30 as days, min(ds) as first,
  cast(max(ds) + interval 30 day as date) as last, true as in_band, true as parts_make_yhat from series"""


@register("sales_forecast_facts", FORECAST_FACTS)
def q_sales_forecast_facts(spark, sf):
    """Days, span, bands, components that sum to the forecast."""
    return _forecast_facts(FC.sales_forecast(sales(spark, sf), 30))


@register("sales_forecast_multiplicative_facts", SALES + SERIES_CTE + """ select count(*) + 30 as days, min(ds) as first,
  cast(max(ds) + interval 30 day as date) as last, true as in_band from series""")
def q_sales_forecast_multiplicative_facts(spark, sf):
    """Days, span, bands."""
    fc = FC.sales_forecast_multiplicative(sales(spark, sf), 30)
    return fc.agg(F.count(F.lit(1)).alias("days"), F.min("ds").alias("first"), F.max("ds").alias("last"),
                  F.min((F.col("yhat_lower") <= F.col("yhat")) & (F.col("yhat") <= F.col("yhat_upper"))).alias("in_band"))


@register("forecast_chain_trained", SALES + SERIES_CTE + """, h as (select max(ds) as d from series)
select (select round(y, 2) from series, h where ds = d) as last_actual, (select count(*) from series where y > 0) as days,
  (select count(*) + 30 from series) as rows, true as peak_above_trough, true as below_listed""")
def q_forecast_chain_trained(spark, sf):
    """The trained forecast sent through M22, R1, R3, R4 and R8."""
    joined = materialize(FC.sales_forecast(sales(spark, sf), 30))
    one = IN.forecast_change(joined).select("last_actual")
    acc = IN.forecast_accuracy(joined).select("days")
    out = FC.forecast_output(joined).agg(F.count(F.lit(1)).alias("rows"))
    ext = IN.forecast_extremes(joined).select((F.col("peak_yhat") >= F.col("trough_yhat")).alias("peak_above_trough"))
    low = IN.forecast_alert(joined).agg((F.count(F.lit(1)) <= 3).alias("below_listed"))
    for part in (acc, out, ext, low):
        one = one.join(F.broadcast(part), F.lit(True))
    return rounded(one)


@register("forecast_output", STANDIN + """select ds, round(coalesce(y, 0), 2) as y, round(yhat, 2) as yhat,
  round(yhat_lower, 2) as yhat_lower, round(yhat_upper, 2) as yhat_upper from joined""")
def q_forecast_output(spark, sf):
    """M22 (stand-in forecast)."""
    return rounded(FC.forecast_output(standin(spark, sf)))


# ---------------------------------------------------------------- rules

@register("forecast_change", STANDIN + """, one as (select arg_max(y, ds) filter (where y is not null) as la,
  arg_max(yhat, ds) as lf from joined)
select round(la, 2) as last_actual, round(lf, 2) as last_forecast, round((lf - la) / nullif(la, 0) * 100, 2) as pct_change,
  case when (lf - la) / nullif(la, 0) * 100 > 10 then 'strong increase'
       when (lf - la) / nullif(la, 0) * 100 > 0 then 'moderate increase'
       when (lf - la) / nullif(la, 0) * 100 > -10 then 'slight decrease'
       when la is not null and la <> 0 then 'significant decrease' end as trend from one""")
def q_forecast_change(spark, sf):
    """R1."""
    return rounded(IN.forecast_change(standin(spark, sf)))


@register("forecast_vs_history", STANDIN + """, h as (select avg(case when y > 0 then y end) as hm from joined),
f as (select avg(yhat) as fm from (select yhat from joined order by ds desc limit 30)),
v as (select hm, fm, (fm - hm) / nullif(hm, 0) * 100 as pct from h, f)
select round(hm, 2) as hist_mean, round(fm, 2) as forecast_mean, round(pct, 2) as pct_change,
  case when pct > 10 then 'strong increase' when pct > 0 then 'moderate increase'
       when pct > -10 then 'slight decrease' when pct is not null then 'significant decrease' end as trend from v""")
def q_forecast_vs_history(spark, sf):
    """R2."""
    return rounded(IN.forecast_vs_history(standin(spark, sf), 30))


@register("forecast_extremes", STANDIN + """select
  (select ds from joined order by yhat desc, ds limit 1) as peak_date,
  (select round(max(yhat), 2) from joined) as peak_yhat,
  (select ds from joined order by yhat asc, ds limit 1) as trough_date,
  (select round(min(yhat), 2) from joined) as trough_yhat""")
def q_forecast_extremes(spark, sf):
    """R3."""
    return rounded(IN.forecast_extremes(standin(spark, sf)))


@register("forecast_accuracy", STANDIN + """select round(avg(abs((y - yhat) / y)) * 100, 4) as mape,
  round(greatest(0, 100 - avg(abs((y - yhat) / y)) * 100), 4) as accuracy, count(*) as days
from joined where y > 0""")
def q_forecast_accuracy(spark, sf):
    """R4 (pairs by date)."""
    return rounded(IN.forecast_accuracy(standin(spark, sf)), 4)


@register("forecast_volatility", STANDIN + """, l as (select yhat from joined order by ds desc limit 30),
v as (select stddev_pop(yhat) / nullif(avg(yhat), 0) * 100 as vp from l)
select round(vp, 2) as volatility_pct, case when vp > 20 then 'high' when vp < 10 then 'stable'
  when vp is not null then 'moderate' end as level from v""")
def q_forecast_volatility(spark, sf):
    """R5."""
    return rounded(IN.forecast_volatility(standin(spark, sf), 30))


@register("critical_threshold", SALES + SERIES_CTE + """, a as (select min(y) as mn, avg(y) as mu from series)
select round(greatest(1.0, 0.5 * mn), 2) as min_threshold,
  round(greatest(greatest(1.0, 0.5 * mn), round(0.7 * mu, -2)), 2) as default_threshold,
  round(greatest(2 * greatest(greatest(1.0, 0.5 * mn), round(0.7 * mu, -2)), 1.5 * mu), 2) as max_threshold from a""")
def q_critical_threshold(spark, sf):
    """R6 on the daily series."""
    return rounded(IN.critical_threshold(series(spark, sf)))


CRIT_SQL = """, thr as (select greatest(greatest(1.0, 0.5 * min(y)), round(0.7 * avg(y), -2)) as t
  from series)"""


def _default_threshold(spark, sf):
    """R6's default threshold as a one-row frame (the slider's starting value)."""
    return IN.critical_threshold(series(spark, sf)).select(F.col("default_threshold").alias("_thr"))


@register("critical_periods", STANDIN + CRIT_SQL + """ select ds, round(yhat, 2) as yhat,
  round(yhat_lower, 2) as yhat_lower, round(yhat_upper, 2) as yhat_upper from joined, thr
  where yhat < t order by ds limit 7""")
def q_critical_periods(spark, sf):
    """R7 list: first 7 days under R6's default threshold."""
    from tillsight.operators.stats import attach_scalars
    j = attach_scalars(standin(spark, sf), _default_threshold(spark, sf))
    return IN.critical_periods(j, F.col("_thr"))


@register("critical_summary", STANDIN + CRIT_SQL + """ select count(case when yhat < t then 1 end) as days_below,
  round(count(case when yhat < t then 1 end) * 100.0 / count(*), 2) as pct_below,
  min(case when yhat < t then ds end) as first_date from joined, thr""")
def q_critical_summary(spark, sf):
    """R7 summary under R6's default threshold."""
    from tillsight.operators.stats import attach_scalars
    j = attach_scalars(standin(spark, sf), _default_threshold(spark, sf))
    return rounded(IN.critical_summary(j, F.col("_thr")))


@register("forecast_alert", STANDIN + """, t as (select avg(yhat) * 0.8 as threshold from joined)
select ds, round(threshold, 2) as threshold from joined, t where yhat < threshold order by ds limit 3""")
def q_forecast_alert(spark, sf):
    """First 3 dates under 0.8 x mean forecast."""
    return rounded(IN.forecast_alert(standin(spark, sf)))


def _seg_sql(case_sql):
    return LABELLED + f""", m as (select cluster, avg(total) as avg_total, avg(quantity) as avg_quantity
  from lab group by 1), o as (select avg(total) as all_total, avg(quantity) as all_quantity from lab)
select cluster, round(avg_total, 2) as avg_total, round(avg_quantity, 2) as avg_quantity, {case_sql} from m, o"""


@register("segment_actions", _seg_sql("""case when avg_total > 1.2 * all_total then 'high spender'
  when avg_quantity > 1.2 * all_quantity then 'bulk buyer' else 'average' end as segment"""))
def q_segment_actions(spark, sf):
    """R9."""
    return rounded(IN.segment_actions(labelled(spark, sf)))


@register("segment_offers", _seg_sql("""case when avg_total > 1.2 * all_total then 'vip'
  when avg_quantity < 0.8 * all_quantity then 'bundle' end as offer"""))
def q_segment_offers(spark, sf):
    """R10."""
    return rounded(IN.segment_offers(labelled(spark, sf)))


@register("segment_actions_fixed", LABELLED + """select cluster, round(avg(total), 2) as avg_total,
  round(avg(quantity), 2) as avg_quantity,
  case when avg(total) > 100 then 'high value' when avg(quantity) > 5 then 'bulk buyer'
       when avg(total) < 50 then 'low spender' else 'average' end as segment from lab group by 1""")
def q_segment_actions_fixed(spark, sf):
    """R11."""
    return rounded(IN.segment_actions_fixed(labelled(spark, sf)))


@register("correlation_notes", SALES + f""", m as ({_matrix_sql(CORR_COLS + ['profit'], 'sp')})
select col1, col2, r, case when r > 0 then 'positive' else 'negative' end as direction,
  case when abs(r) > 0.7 then 'strong' else 'moderate' end as strength,
  case when list_sort([lower(col1), lower(col2)]) = ['quantity', 'total'] then
         case when r > 0 then 'volume drives revenue' else 'volume lowers totals' end
       when list_sort([lower(col1), lower(col2)]) = ['total', 'unit_price'] then
         case when r > 0 then 'premium items drive revenue' else 'cheaper items sell more' end
       when r > 0 then col2 || ' rises with ' || col1 else col2 || ' falls as ' || col1 || ' rises' end as implication
from m where i < j and abs(r) > 0.5 order by abs(r) desc, i, j limit 3"""
          .replace("from sp", "from (select *, total - quantity * unit_price as profit from sales)"))
def q_correlation_notes(spark, sf):
    """R12."""
    s = sales(spark, sf).withColumn("profit", X.profit())
    return IN.correlation_notes(s, CORR_COLS + ["profit"]).withColumn("r", F.round("r", 4))


@register("churn_recommendations", SALES + f""", l as (select avg((date_diff('day', cast(date as date), date '{AS_OF}') > 60)::int) * 100
  as rate from sales)
select 1 as rank, 'alert' as kind, 'churn_alert' as code, round(rate, 2) as number,
  'More customers have lapsed than the alert level allows.' as text from l where rate > 30 union all
select 2, 'warning', 'value_segments', 0.4,
  'What a customer spends per visit tells lapsing ones apart; treat the spending levels differently.' union all
select 3, 'info', 'feedback', null, 'Survey customers at intervals, so that reasons for leaving are known early.'""")
def q_churn_recommendations(spark, sf):
    """R13 from the churn summary and stand-in importances."""
    summ = CH.churn_summary(CH.churn_features_row(sales(spark, sf), AS_OF))
    imp = spark.createDataFrame([("total", 0.3), ("avg_purchase_value", 0.4), ("quantity", 0.2), ("days_since_last", 0.1)],
                                "feature string, importance double")
    return rounded(IN.churn_recommendations(summ, imp))


@register("churn_recommendations_trained")
def q_churn_recommendations_trained(spark, sf):
    """R13 from the trained forest's importances."""
    rows, model = _trained(spark, sf)
    return IN.churn_recommendations(CH.churn_summary(rows), model.importances(spark))


SUGGESTION_COLS = ["total", "quantity", "unit_price", "invoice_id", "customer_id"]
SUGGESTIONS_SQL = STANDIN.rstrip() + f""",
lab as (select *, cast(customer_id % 3 as integer) as cluster, cast(split_part(time, ':', 1) as integer) as hour from sales),
cat as (select product_line, sum(total) as s from lab where product_line is not null group by 1),
tops as (select * from cat order by s desc, product_line limit 3),
lows as (select * from cat order by s, product_line limit 3),
wk as (select {WEEK_END_SQL.format(d='date')} as week, sum(total) as s from lab where date is not null group by 1),
lw as (select (select s from wk order by week desc limit 1) as b,
  coalesce((select s from wk where week = (select max(week) - 7 from wk)), 0) as a),
wow as (select (b - a) / nullif(a, 0) * 100 as pct from lw),
cells as (select isodow(date) as wd, dayname(date) || ' ' || coalesce(hour, 0) || ':00' as cell, coalesce(hour, 0) as hour,
  sum(total) as s from lab where date is not null group by 1, 2, 3),
pairs as (select * from ({_matrix_sql(SUGGESTION_COLS, 'lab').replace(', 4) as r', ', 12) as r')}) where i < j and abs(r) >= 0.1
  order by abs(r) desc, i, j limit 2),
low as (select ds, t from joined, (select avg(yhat) * 0.8 as t from joined) where yhat < t order by ds limit 3),
out as (
  select 10 as rank, 'top_categories' as code, (select string_agg(product_line, ', ' order by s desc, product_line) from tops) as subject,
    null::double as number, 'star' as symbol, 'warning' as colour
  union all select 11, 'low_categories', (select string_agg(product_line, ', ' order by s, product_line) from lows), null,
    'exclamation-triangle', 'danger'
  union all select 20, case when pct > 0 then 'sales_up' else 'sales_down' end, null, abs(pct), 'chart-line',
    case when pct > 0 then 'success' else 'danger' end from wow where abs(pct) > 5
  union all (select 30, 'busiest', cell, s, 'clock', 'info' from cells order by s desc, wd, hour limit 1)
  union all (select 31, 'slowest', cell, s, 'hourglass-half', 'secondary' from cells order by s, wd, hour limit 1)
  union all select 40 + row_number() over (order by abs(r) desc, i, j), 'correlation', col1 || ' and ' || col2, r, 'link', 'primary' from pairs
  union all select 41, 'no_correlation', null, null, 'lightbulb', 'warning' where not exists (from pairs)
  union all select 50 + cluster, case when t > 1.2 * all_t then 'cluster_spends' else 'cluster_small' end, cluster::varchar,
    case when t > 1.2 * all_t then t else q end, case when t > 1.2 * all_t then 'bullseye' else 'shopping-cart' end,
    case when t > 1.2 * all_t then 'danger' else 'success' end
    from (select cluster, avg(total) as t, avg(quantity) as q from lab group by 1),
         (select avg(total) as all_t, avg(quantity) as all_q from lab) where t > 1.2 * all_t or q < 0.8 * all_q
  union all select 60, 'forecast_low', string_agg(strftime(ds, '%Y-%m-%d'), ', ' order by ds), min(t), 'chart-bar', 'primary'
    from low having count(*) > 0)
select rank::int as rank, code, subject, round(number, 2) as number, symbol, colour from out"""


@register("business_suggestions", SUGGESTIONS_SQL)
def q_business_suggestions(spark, sf):
    """R14 + R15: ordered suggestions with symbol and colour (stand-in labels and forecast, all numeric columns)."""
    s = labelled(spark, sf).withColumn("hour", X.hour_of_time("time"))
    return rounded(IN.business_suggestions(s, forecast=standin(spark, sf), corr_cols=SUGGESTION_COLS).drop("text"))


@register("business_suggestions_texts")
def q_business_suggestions_texts(spark, sf):
    """R14 with its wording, on trained labels and the trained forecast, hours from the timestamp."""
    lab = SG.segment_customers(sales(spark, sf), k=3, seed=42).drop("time")
    fc = FC.sales_forecast(sales(spark, sf), 30)
    return IN.business_suggestions(lab, forecast=fc, corr_cols=SUGGESTION_COLS)


@register("insight_kind", SALES + "select invoice_id, case invoice_id % 12 " + " ".join(
    f"when {i} then '{symbol}'" for i, (_, symbol, _) in enumerate(IN.MARKS)) + " when 10 then 'lightbulb' else 'info-circle' end as symbol, "
    "case invoice_id % 12 " + " ".join(f"when {i} then '{colour}'" for i, (_, _, colour) in enumerate(IN.MARKS))
    + " when 10 then 'warning' else 'info' end as colour from sales")
def q_insight_kind(spark, sf):
    """Symbol and colour by mark, over texts that hold each mark, none, or nothing."""
    k = F.col("invoice_id") % 12
    marks = F.array(*[F.lit(f"{m} text") for m, _, _ in IN.MARKS], F.lit("no mark"), F.lit(""))
    texts = sales(spark, sf).select("invoice_id", F.get(marks, k.cast("int")).alias("text"))
    return texts.select("invoice_id", IN.insight_kind("text").alias("k")).select("invoice_id", "k.symbol", "k.colour")


# ---------------------------------------------------------------- variants and remaining keys

@register("churn_train")
def q_churn_train(spark, sf):
    """The trained 100-tree forest, one row per tree (nodes, depth)."""
    _, model = _trained(spark, sf)
    rows = [(i, t.numNodes, t.depth) for i, t in enumerate(model.model.trees)]
    return spark.createDataFrame(rows, "tree int, nodes int, depth int")


@register("ranked_correlations_floor", SALES + f""", m as ({_matrix_sql(CORR_COLS + ['profit'], 'sp')})
select col1, col2, r from m where i < j and abs(r) >= 0.1 order by abs(r) desc, i, j limit 2"""
          .replace("from sp", "from (select *, total - quantity * unit_price as profit from sales)"))
def q_ranked_correlations_floor(spark, sf):
    """W5 variant: |r| >= 0.1, top 2 (the suggestion list's rule)."""
    s = sales(spark, sf).withColumn("profit", X.profit())
    return CR.ranked_correlations(s, CORR_COLS + ["profit"], k=2, min_abs=0.1).withColumn("r", F.round("r", 4))


@register("peak_day_hours_slowest", EV + """, c as (select cast(isodow(date) - 1 as integer) as weekday,
  cast(hour(date) as integer) as hour, sum(total) as s from ev group by 1, 2),
pk as (select weekday from c order by s asc, weekday, hour limit 1),
hh as (select cast(isodow(date) - 1 as integer) as weekday, cast(hour(date) as integer) as hour, sum(total) as s
  from ev where cast(isodow(date) - 1 as integer) in (select weekday from pk) group by 1, 2)
select pk.weekday, cast(h.i as integer) as hour, round(coalesce(hh.s, 0), 2) as sales
from pk join range(24) h(i) on true left join hh on hh.weekday = pk.weekday and hh.hour = h.i""")
def q_peak_day_hours_slowest(spark, sf):
    """A20 for the slowest weekday."""
    e = events_hourly(spark, sf)
    return rounded(A.peak_day_hours(e, "slowest"))


@register("segment_offers_else_bundle", _seg_sql("""case when avg_total > 1.2 * all_total then 'vip'
  when avg_quantity < 0.8 * all_quantity then 'bundle' else 'bundle' end as offer"""))
def q_segment_offers_else_bundle(spark, sf):
    """R10, older copy: clusters that are not VIP get the bundle offer."""
    return rounded(IN.segment_offers(labelled(spark, sf), else_bundle=True))


@register("forecast_extremes_last_n", STANDIN + """, l as (select * from joined order by ds desc limit 30)
select (select ds from l order by yhat desc, ds limit 1) as peak_date,
  (select round(max(yhat), 2) from l) as peak_yhat,
  (select ds from l order by yhat asc, ds limit 1) as trough_date,
  (select round(min(yhat), 2) from l) as trough_yhat""")
def q_forecast_extremes_last_n(spark, sf):
    """R3, browser form: extremes over the last 30 forecast days."""
    return rounded(IN.forecast_extremes(standin(spark, sf), last_n=30))


@register("sales_forecast_by_category")
def q_sales_forecast_by_category(spark, sf):
    """M19 per category: one small model per category's daily series (applyInPandas)."""
    return FC.forecast_by_group(sales(spark, sf), "product_line", periods=30)
