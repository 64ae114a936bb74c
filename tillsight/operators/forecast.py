"""Daily sales forecast (M17-M22) as a regression on trend and seasonal terms.

The heavy part at scale is the daily aggregate (distributed scan + partial
aggregation). The fit reads the series once per aggregate of products, a small matrix,
and solves it by coordinate descent:

* a piecewise-linear trend: scaled time t in [0, 1] over the history plus hinge
  terms ``max(t - c, 0)`` at ``n_changepoints`` points spread over the first
  80 % of the history (the published default layout of Prophet's trend), with an L1
  penalty, so that only the changes that the history shows are kept;
* Fourier terms for yearly (period 365.25 days, order 10) and weekly (period 7,
  order 3) seasonality, optionally monthly (30.5, order 5) and, on an hourly series,
  daily (1, order 4), with a small ridge penalty.

Predictions are computed from the coefficients as Column expressions, so each
component (trend / weekly / yearly / ...) is a column and they make up ``yhat``
exactly. The interval widens beyond the history, as the trend may change there.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillsight.operators.stats import attach_scalars
from tillsight.session import materialize

# Seasonal periods (days) and Fourier orders, Prophet's published
# defaults; z for an 80 % interval; changepoint layout.
YEARLY = (365.25, 10)
WEEKLY = (7.0, 3)
MONTHLY = (30.5, 5)
DAILY = (1.0, 4)
Z80 = 1.2815515655446004
N_CHANGEPOINTS = 25
CHANGEPOINT_RANGE = 0.8
CHANGEPOINT_SCALE = 0.05


def forecast_series(df, date_col="date", value="total") -> DataFrame:
    """Daily Σ value as (ds date, y double)."""
    return (df.where(F.col(date_col).isNotNull()).groupBy(F.to_date(date_col).alias("ds"))
              .agg(F.coalesce(F.sum(value), F.lit(0.0)).cast("double").alias("y")))


def materialized_series(df, date_col="date", value="total") -> DataFrame:
    """M17 written once to the shared checkpoint folder.

    The fit, the bounds, the prediction and the actuals join all read the
    series; without the cut each of them would rescan and re-aggregate the
    whole fact table. The series has one row per day, so the write is tiny and
    survives executor loss (unlike a cache).
    """
    from tillsight.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    return forecast_series(df, date_col, value).checkpoint(eager=True)


def forecast_frame(series: DataFrame, periods: int = 30) -> DataFrame:
    """History dates plus the next ``periods`` days after the last one."""
    last = series.agg(F.max("ds").alias("_last"))
    fut = last.select(F.explode(F.sequence(F.date_add("_last", 1), F.date_add("_last", periods)))
                      .alias("ds")) if periods > 0 else None
    hist = series.select("ds")
    return hist.unionByName(fut) if fut is not None else hist


def _fourier(d: Column, period: float, order: int, prefix: str) -> dict:
    out = {}
    for k in range(1, order + 1):
        ang = d * (2.0 * math.pi * k / period)
        out[f"{prefix}_s{k}"] = F.sin(ang)
        out[f"{prefix}_c{k}"] = F.cos(ang)
    return out


@dataclass
class ForecastModel:
    groups: dict          # component name -> list of feature names
    coef: dict            # feature name -> coefficient
    intercept: float
    sigma: float          # of the residuals, in units of y
    drift: float          # variance of the trend at one history span beyond its end, in units of y squared
    multiplicative: bool
    changepoints: list
    seasonalities: dict   # prefix -> (period, order)


def _days(ds: Column, hourly: bool) -> Column:
    """Days since 1970 as a double."""
    return F.unix_timestamp(ds.cast("timestamp")) / 86400.0 if hourly else F.datediff(ds, F.to_date(F.lit("1970-01-01"))).cast("double")


def _bounds(series: DataFrame, hourly: bool) -> DataFrame:
    d = _days(F.col("ds"), hourly)
    return series.agg(F.min(d).alias("_t0"), F.greatest(F.max(d) - F.min(d), F.lit(1.0)).alias("_span"))


def _features(frame: DataFrame, bounds: DataFrame, changepoints, seasonalities, hourly: bool = False) -> tuple[DataFrame, dict]:
    """The frame with a column per feature; _past is the part of the history span beyond its end."""
    f = attach_scalars(frame, bounds)
    d = _days(F.col("ds"), hourly)
    t = F.coalesce(F.try_divide(d - F.col("_t0"), F.col("_span")), F.lit(0.0))
    cols = {"t": t, "_past": F.greatest(t - F.lit(1.0), F.lit(0.0))}
    for j, c in enumerate(changepoints):
        cols[f"cp{j}"] = F.greatest(t - F.lit(c), F.lit(0.0))
    groups = {"trend": ["t"] + [f"cp{j}" for j in range(len(changepoints))]}
    for name, (period, order) in seasonalities.items():
        fc = _fourier(d, period, order, name)
        cols.update(fc)
        groups[name] = list(fc)
    return f.withColumns(cols).drop("_t0", "_span"), groups


def _gram(rows: DataFrame, xs: list[Column], y: Column) -> tuple[np.ndarray, int]:
    """Sums of products of (xs..., y) over the rows: one aggregate, of a matrix per task."""
    width = len(xs) + 1

    def partial(batches):
        total, n = np.zeros((width, width)), 0
        for batch in batches:
            v = batch.column(0).flatten().to_numpy().reshape(-1, width)
            total, n = total + v.T @ v, n + len(v)
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()]), pa.array([n], pa.int64())], names=["m", "n"])

    parts = rows.select(F.array(*xs, y).alias("v")).mapInArrow(partial, "m array<double>, n long")
    sums = parts.select("n", F.posexplode("m").alias("at", "m")).groupBy("at").agg(F.sum("m").alias("m"), F.sum("n").alias("n")).collect()
    matrix = np.zeros(width * width)
    for r in sums:
        matrix[r["at"]] = r["m"]
    return matrix.reshape(width, width), sums[0]["n"] if sums else 0


def _descend(gram: np.ndarray, n: int, sparse: list[bool], free: list[bool], prior: float, rounds: int = 4, sweeps: int = 2_000):
    """Coefficients and sigma by coordinate descent on the sums of products.

    ``sparse`` ones have a Laplace prior of scale ``prior`` (L1, so that most are zero), the
    others that are not ``free`` a normal one of scale 10. The weight of the priors follows
    from sigma, which is estimated again in every round. Units are those of a y around 1.
    """
    p = len(gram) - 1
    a, b, yy = gram[:p, :p] + 1e-9 * np.diag(np.diag(gram)[:p]), gram[:p, p], gram[p, p]
    loose, held = np.flatnonzero(free), np.flatnonzero(~np.array(free))
    # What the free coefficients explain is taken out first; they follow from the others.
    lift = np.linalg.lstsq(a[np.ix_(loose, loose)], np.column_stack([a[np.ix_(loose, held)], b[loose]]), rcond=None)[0]
    inner = a[np.ix_(held, held)] - a[np.ix_(held, loose)] @ lift[:, :-1]
    right = b[held] - a[np.ix_(held, loose)] @ lift[:, -1]
    thin = np.array(sparse)[held]
    beta, part = np.zeros(p), np.zeros(len(held))

    def spent(beta):
        return max((yy - 2 * beta @ b + beta @ a @ beta) / max(n, 1), 1e-12)

    # Start from the spread that the free coefficients leave.
    beta[loose] = lift[:, -1]
    sigma2 = spent(beta)
    for _ in range(rounds):
        l1, l2 = np.where(thin, sigma2 / prior, 0.0), np.where(thin, 0.0, sigma2 / 100.0)
        for _ in range(sweeps):
            before = part.copy()
            for j in range(len(held)):
                if inner[j, j] <= 1e-12:
                    continue
                rho = right[j] - inner[j] @ part + inner[j, j] * part[j]
                part[j] = np.sign(rho) * max(abs(rho) - l1[j], 0.0) / (inner[j, j] + l2[j])
            if np.abs(part - before).max(initial=0.0) < 1e-7:
                break
        beta[held], beta[loose] = part, lift[:, -1] - lift[:, :-1] @ part
        sigma2 = spent(beta)
    return beta, float(np.sqrt(sigma2))


def fit_forecast(series: DataFrame, yearly: bool = True, weekly: bool = True, monthly: bool = False,
                 multiplicative: bool = False, n_changepoints: int = N_CHANGEPOINTS,
                 changepoint_scale: float = CHANGEPOINT_SCALE, daily: bool = False, alternations: int = 4) -> ForecastModel:
    """M19 / M20 fit: a trend with sparse change points and Fourier seasons, on y itself.

    Additive: y = trend + Σ season. Multiplicative: y = trend x (1 + Σ season) by alternating
    least squares, so days with y <= 0 stay in the fit. Each fit is one aggregate of products
    over the series and a coordinate descent on that matrix. ``daily`` needs hourly ds.
    """
    hist = series.where(F.col("y").isNotNull() & ~F.isnan("y"))
    seas = {name: spec for name, spec, on in (("yearly", YEARLY, yearly), ("weekly", WEEKLY, weekly), ("monthly", MONTHLY, monthly), ("daily", DAILY, daily)) if on}
    cps = [CHANGEPOINT_RANGE * (j + 1) / (n_changepoints + 1) for j in range(n_changepoints)]
    feats, groups = _features(hist, _bounds(series, daily), cps, seas, daily)
    trend, season = groups["trend"], [n for g, names in groups.items() if g != "trend" for n in names]
    feats = materialize(feats.select(F.col("y").cast("double").alias("y"), *trend, *season))
    unit = feats.agg(F.max(F.abs("y"))).first()[0] or 1.0
    y = F.col("y") / F.lit(float(unit))
    sparse = [n.startswith("cp") for n in trend]
    free = [not x for x in sparse]

    def line(names, beta) -> Column:
        return reduce(Column.__add__, [F.lit(float(c)) * F.col(n) for n, c in zip(names, beta)], F.lit(0.0))

    one = F.lit(1.0)
    if not multiplicative:
        gram, n = _gram(feats, [one, *map(F.col, trend + season)], y)
        beta, sigma = _descend(gram, n, [False, *sparse, *[False] * len(season)], [True, *free, *[False] * len(season)], changepoint_scale)
    else:
        factor, parts = one, np.zeros(len(season))
        for _ in range(alternations):
            gram, n = _gram(feats, [factor, *[F.col(c) * factor for c in trend]], y)
            own, sigma = _descend(gram, n, [False, *sparse], [True, *free], changepoint_scale)
            level = F.lit(float(own[0])) + line(trend, own[1:])
            if not season:
                break
            gram, n = _gram(feats, [F.col(c) * level for c in season], y - level)
            parts, sigma = _descend(gram, n, [False] * len(season), [False] * len(season), changepoint_scale)
            factor = one + line(season, parts)
        beta = np.concatenate([own, parts])
    scaled = beta if multiplicative else beta * unit
    coef = dict(zip(trend + season, [float(c) for c in scaled[1:]]))
    if multiplicative:
        coef |= {c: v * unit for c, v in coef.items() if c in trend}
    # As many changes per span as the history may have, of the size that its own ones have on average:
    # the variance of their sum at x spans beyond the end is 2 n size^2 x^3 / 3.
    sizes = [abs(coef[c]) for c in trend if c.startswith("cp")]
    drift = 2.0 * len(sizes) * (sum(sizes) / len(sizes)) ** 2 / 3.0 if sizes else 0.0
    return ForecastModel(groups, coef, float(beta[0] * unit), float(sigma * unit), drift, multiplicative, cps, seas)


def predict(model: ForecastModel, frame: DataFrame, series: DataFrame) -> DataFrame:
    """Forecast rows with components: ds, yhat, yhat_lower, yhat_upper, trend, <seasonal>...

    Additive: yhat = trend + Σ season. Multiplicative: yhat = trend x (1 + Σ season). The
    interval holds 80 % of the residuals in the history and widens beyond it, as the
    trend may change there.
    """
    hourly = "daily" in model.seasonalities
    f, groups = _features(frame, _bounds(series, hourly), model.changepoints, model.seasonalities, hourly)
    parts = {}
    for g, names in groups.items():
        expr = F.lit(model.intercept if g == "trend" else 0.0)
        for n in names:
            expr = expr + F.lit(model.coef[n]) * F.col(n)
        parts[g] = expr
    feat_cols = [n for g in groups.values() for n in g]
    out = f.withColumns({f"_{g}": e for g, e in parts.items()}).drop(*feat_cols)
    seas = reduce(Column.__add__, [F.col(f"_{g}") for g in groups if g != "trend"], F.lit(0.0))
    factor = F.lit(1.0) + seas if model.multiplicative else F.lit(1.0)
    yhat = F.col("_trend") * factor if model.multiplicative else F.col("_trend") + seas
    width = Z80 * F.sqrt(F.lit(model.sigma ** 2) + F.lit(model.drift) * factor * factor * F.col("_past") ** 3)
    return out.select("ds", yhat.alias("yhat"), (yhat - width).alias("yhat_lower"), (yhat + width).alias("yhat_upper"),
                      *[F.col(f"_{g}").alias(g) for g in groups])


def hourly_series(df, date_col="date", value="total") -> DataFrame:
    """Σ value per hour that has sales: (ds timestamp, y)."""
    hour = F.date_trunc("hour", F.col(date_col).cast("timestamp"))
    return materialize(df.where(F.col(date_col).isNotNull()).groupBy(hour.alias("ds")).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("y")))


def hourly_frame(series: DataFrame, periods: int = 30) -> DataFrame:
    """The hours of the series and every hour of the ``periods`` days after its last day."""
    if periods <= 0:
        return series.select("ds")
    last = series.agg(F.to_date(F.max("ds")).alias("_last"))
    first, end = F.date_add("_last", 1).cast("timestamp"), F.date_add("_last", periods + 1).cast("timestamp") - F.expr("interval 1 hour")
    return series.select("ds").unionByName(last.where("_last is not null").select(F.explode(F.sequence(first, end, F.expr("interval 1 hour"))).alias("ds")))


def sales_forecast(df, periods: int = 30, date_col="date", value="total", yearly=True, weekly=True, daily=False) -> DataFrame:
    """Additive forecast joined with the actuals (J1, summed first).

    With ``daily`` the series has a row per hour and the forecast a season of the day.
    """
    series = hourly_series(df, date_col, value) if daily else materialized_series(df, date_col, value)
    model = fit_forecast(series, yearly=yearly, weekly=weekly, daily=daily)
    frame = hourly_frame(series, periods) if daily else forecast_frame(series, periods)
    return forecast_actual_join(predict(model, frame, series), series)


def sales_forecast_multiplicative(df, periods: int = 30, date_col="date", value="total") -> DataFrame:
    """Multiplicative seasonality; monthly term when the history spans > 60 days."""
    series = materialized_series(df, date_col, value)
    span = series.agg(F.datediff(F.max("ds"), F.min("ds")).alias("s")).first()["s"] or 0
    model = fit_forecast(series, monthly=span > 60, multiplicative=True)
    return forecast_actual_join(predict(model, forecast_frame(series, periods), series), series)


def forecast_actual_join(forecast: DataFrame, series: DataFrame) -> DataFrame:
    """Forecast left join the daily actuals on ds (actuals summed per day first)."""
    return forecast.join(series.select("ds", "y"), "ds", "left")


def forecast_output(joined: DataFrame) -> DataFrame:
    """Ds, y (NULL -> 0), yhat, lower, upper."""
    return joined.select("ds", F.coalesce("y", F.lit(0.0)).alias("y"), "yhat", "yhat_lower", "yhat_upper")


def weekday_mean_forecast(series: DataFrame, periods: int = 30) -> DataFrame:
    """Deterministic stand-in forecast (oracle-checkable) joined with the actuals.

    Future days: mean y of the same weekday; history days: the average of that
    mean and the day's actual, so the rules see days above and below the
    thresholds. Bounds are +-10 %. The weekday table has 7 rows (broadcast).
    """
    means = series.groupBy(F.weekday("ds").alias("_wd")).agg(F.avg("y").alias("_m"))
    frame = forecast_frame(series, periods).withColumn("_wd", F.weekday("ds"))
    fc = (frame.join(F.broadcast(means), "_wd", "left")
               .join(series.select("ds", F.col("y").alias("_y")), "ds", "left"))
    yhat = F.when(F.col("_y").isNull(), F.col("_m")).otherwise((F.col("_m") + F.col("_y")) / 2)
    fc = fc.select("ds", yhat.alias("yhat"), (yhat * 0.9).alias("yhat_lower"), (yhat * 1.1).alias("yhat_upper"))
    return forecast_actual_join(fc, series)


def _group_design(days: "np.ndarray", t0: float, span: float, changepoints, seasonalities):
    import numpy as np
    t = (days - t0) / span
    cols = [np.ones_like(t), t] + [np.maximum(t - c, 0.0) for c in changepoints]
    for period, order in seasonalities:
        for k in range(1, order + 1):
            ang = days * (2.0 * math.pi * k / period)
            cols += [np.sin(ang), np.cos(ang)]
    return np.column_stack(cols)


def forecast_by_group(df, group: str, periods: int = 30, date_col="date", value="total",
                      reg_param: float = 1e-3, n_changepoints: int = N_CHANGEPOINTS) -> DataFrame:
    """M19, one model per group (e.g. per category).

    The data is first reduced to one row per (group, day) by a distributed
    aggregate, so each group handed to ``applyInPandas`` is a daily series
    (bounded by the number of days, not by the data volume, even for a group
    holding most of the rows). Each group is fitted with the same trend +
    Fourier design as ``fit_forecast`` (ridge normal equations in numpy) and
    returns history + ``periods`` future days.
    """
    daily = (df.where(F.col(date_col).isNotNull() & F.col(group).isNotNull())
               .groupBy(F.col(group).alias("grp"), F.to_date(date_col).alias("ds"))
               .agg(F.sum(value).cast("double").alias("y")))
    cps = [CHANGEPOINT_RANGE * (j + 1) / (n_changepoints + 1) for j in range(n_changepoints)]
    seas = [YEARLY, WEEKLY]

    def fit(pdf):
        import numpy as np
        import pandas as pd
        pdf = pdf.sort_values("ds")
        epoch = pd.Timestamp("1970-01-01")
        days = ((pd.to_datetime(pdf["ds"]) - epoch).dt.days).to_numpy(dtype=float)
        y = pdf["y"].to_numpy(dtype=float)
        t0, span = days.min(), max(days.max() - days.min(), 1.0)
        X_ = _group_design(days, t0, span, cps, seas)
        mu, sd = X_[:, 1:].mean(axis=0), X_[:, 1:].std(axis=0)
        sd[sd == 0] = 1.0
        Z = np.column_stack([np.ones(len(y)), (X_[:, 1:] - mu) / sd])
        pen = reg_param * len(y) * np.eye(Z.shape[1])
        pen[0, 0] = 0.0
        beta = np.linalg.solve(Z.T @ Z + pen, Z.T @ y)
        sigma = float(np.sqrt(np.mean((y - Z @ beta) ** 2)))
        fut = np.arange(days.max() + 1, days.max() + periods + 1, dtype=float)
        all_days = np.concatenate([days, fut])
        Xa = _group_design(all_days, t0, span, cps, seas)
        yhat = np.column_stack([np.ones(len(all_days)), (Xa[:, 1:] - mu) / sd]) @ beta
        actual = np.concatenate([y, np.full(len(fut), np.nan)])
        return pd.DataFrame({
            "grp": pdf["grp"].iloc[0],
            "ds": (epoch + pd.to_timedelta(all_days, unit="D")).date,
            "y": actual, "yhat": yhat,
            "yhat_lower": yhat - Z80 * sigma, "yhat_upper": yhat + Z80 * sigma})

    schema = "grp string, ds date, y double, yhat double, yhat_lower double, yhat_upper double"
    out = daily.groupBy("grp").applyInPandas(fit, schema)
    return out.withColumnRenamed("grp", group)
