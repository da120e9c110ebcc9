"""Monthly demand series: rollup, densification, statistics, classification, smoothing, backtests, model choice.

Series hang on a key of (material, plant). Arrays hold one key's months, so their length is the length of the window.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partlake.functions.semantics import month, month_number, ratio

KEY = ["material", "plant"]
#: Fixed policy values.
ADI_CUTOFF, CV2_CUTOFF = 1.32, 0.49
GATE_NON_ZERO, GATE_MONTHS = 5, 6
FULL_MONTHS, LIMITED_MONTHS = 24, 12
DECLINE_MONTHS, DECLINE_NON_ZERO, DECLINE_EARLY, DECLINE_SHARE, DECLINE_SILENT = 12, 4, 3, 0.5, 3
SES_GRID = [round(0.05 * k, 2) for k in range(1, 20)]
SBA_GRID = [0.05, 0.10, 0.15, 0.20]
TSB_ALPHA = TSB_BETA = 0.10
MIN_TRAINING, REQUIRED_ORIGINS = 3, 12
MIN_IMPROVEMENT, MAX_BIAS_CHANGE = 0.05, 0.05


def monthly_consumption(moves: DataFrame) -> DataFrame:
    """Net issues by material, plant and month of posting. ``moves``: material, plant, day, qty, reversal.

    A reversal subtracts in its own month. Sums are partial before the one shuffle.
    """
    signed = F.when(F.col("reversal"), -F.col("qty")).otherwise(F.col("qty"))
    return moves.groupBy(*KEY, month(F.col("day")).alias("month")).agg(
        F.sum(signed).alias("quantity"),
        F.count(F.lit(1)).alias("movements"),
        F.count_if(~F.col("reversal")).alias("issues"),
        F.count_if(F.col("reversal")).alias("reversals"),
    )


def densify(monthly: DataFrame, start: str, end: str) -> DataFrame:
    """Every key at every month of the window: a missing month is 0, a negative one 0."""
    window = monthly.where(F.col("month").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    by_month = F.map_from_entries(F.collect_list(F.struct("month", "quantity")))
    spine = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 1 month"))
    # a key's months meet in one row, so the spine costs no second shuffle
    keyed = window.groupBy(*KEY).agg(by_month.alias("have")).withColumn("month", F.explode(spine))
    return keyed.select(*KEY, "month", F.greatest(F.coalesce(F.col("have")[F.col("month")], F.lit(0.0)), F.lit(0.0)).alias("quantity"))


def series(monthly: DataFrame, start: str, end: str) -> DataFrame:
    """Each key's dense quantities as one array in month order."""
    window = monthly.where(F.col("month").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    by_month = F.map_from_entries(F.collect_list(F.struct("month", "quantity")))
    spine = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 1 month"))
    keyed = window.groupBy(*KEY).agg(by_month.alias("have"))
    return keyed.select(*KEY, F.transform(spine, lambda m: F.greatest(F.coalesce(F.col("have")[m], F.lit(0.0)), F.lit(0.0))).alias("q"))


def demand_statistics(dense: DataFrame) -> DataFrame:
    """Counts, means and sample deviations over all and over non-zero months, ADI and CV2 with their status."""
    q, nz = F.col("quantity"), F.when(F.col("quantity") != 0, F.col("quantity"))
    out = dense.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(nz).alias("n_nz"),
        F.sum(q).alias("total"),
        F.avg(q).alias("mean_all"),
        F.stddev_samp(q).alias("std_all"),
        F.avg(nz).alias("mean_nz"),
        F.stddev_samp(nz).alias("std_nz"),
    )
    out = out.withColumn("adi", ratio(F.col("n"), F.col("n_nz"))).withColumn("cv2", F.pow(ratio(F.col("std_nz"), F.col("mean_nz")), F.lit(2)))
    return out.withColumn(
        "cv2_status",
        F.when(F.col("n") == 0, "NO_HISTORY").when(F.col("n_nz") == 0, "NO_NON_ZERO_DEMAND").when(F.col("n_nz") < 2, "INSUFFICIENT_NON_ZERO_OBSERVATIONS").when(F.col("mean_nz") == 0, "ZERO_MEAN").otherwise("AVAILABLE"),
    )


def classify(statistics: DataFrame) -> DataFrame:
    """History gate, sufficiency, Syntetos-Boylan class and the models it routes to."""
    n, nz, adi, cv2 = (F.col(c) for c in ("n", "n_nz", "adi", "cv2"))
    history = F.when(n == 0, "NO_HISTORY").when((nz < GATE_NON_ZERO) | (n < GATE_MONTHS), "COLD_START").otherwise("SUFFICIENT")
    enough = F.when(n >= FULL_MONTHS, "FULL").when(n >= LIMITED_MONTHS, "LIMITED").otherwise("INSUFFICIENT")
    pattern = (
        F.when(adi.isNull() | cv2.isNull(), "UNCLASSIFIED")
        .when(adi <= ADI_CUTOFF, F.when(cv2 <= CV2_CUTOFF, "SMOOTH").otherwise("ERRATIC"))
        .otherwise(F.when(cv2 <= CV2_CUTOFF, "INTERMITTENT").otherwise("LUMPY"))
    )
    out = statistics.withColumn("history_status", history).withColumn("sufficiency", enough).withColumn("pattern", pattern)
    regular, sparse = F.col("pattern").isin("SMOOTH", "ERRATIC"), F.col("pattern").isin("INTERMITTENT", "LUMPY")
    return out.withColumn("baseline", F.when(regular, "SES").when(sparse, "SBA")).withColumn("challenger", F.when(regular, "AUTO_ARIMA").when(sparse, "LIGHTGBM"))


def declining(keyed: DataFrame) -> DataFrame:
    """Ordered gates over the last months of an array ``q``: enough demand, enough early, a fall, and silence at the end."""
    half = DECLINE_MONTHS // 2
    last = F.slice("q", -DECLINE_MONTHS, DECLINE_MONTHS)
    count = lambda a: F.size(F.filter(a, lambda x: x > 0))
    long = F.size("q") >= DECLINE_MONTHS
    out = keyed.where(F.size("q") > 0).withColumn("_w", F.when(long, last).otherwise(F.col("q")))
    out = out.select(
        *KEY,
        F.size("q").alias("months"),
        count(F.col("_w")).alias("nonzero_months"),
        count(F.slice("_w", 1, half)).alias("early_nonzero"),
        F.when(long, count(F.slice("_w", half + 1, half))).alias("recent_nonzero"),
        F.when(long, count(F.slice("_w", -DECLINE_SILENT, DECLINE_SILENT)) == 0).alias("latest_zero"),
    )
    fall = 1 - ratio(F.col("recent_nonzero"), F.col("early_nonzero"))
    out = out.withColumn("decline", F.when((F.col("nonzero_months") >= DECLINE_NON_ZERO) & (F.col("early_nonzero") >= DECLINE_EARLY), fall))
    status = (
        F.when(F.col("months") < DECLINE_MONTHS, "INSUFFICIENT_HISTORY")
        .when(F.col("nonzero_months") < DECLINE_NON_ZERO, "INSUFFICIENT_HISTORY")
        .when(F.col("early_nonzero") < DECLINE_EARLY, "INSUFFICIENT_EARLY_DEMAND")
        .when(F.col("decline") < DECLINE_SHARE, "DECLINE_THRESHOLD_NOT_MET")
        .when(~F.col("latest_zero"), "RECENT_DEMAND_PRESENT")
        .otherwise("DECLINING_DEMAND")
    )
    return out.withColumn("status", status)


def lag_features(dense: DataFrame) -> DataFrame:
    """Features of each month from strictly earlier ones: rolling sums, expanding ADI and CV2, months since demand."""
    order = Window.partitionBy(*KEY).orderBy("month")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    q, nz = F.col("quantity"), F.when(F.col("quantity") != 0, F.col("quantity"))
    last = F.max(F.when(q > 0, month_number(F.col("month")))).over(before)
    n, n_nz = F.count(q).over(before), F.count(nz).over(before)
    return dense.select(
        *KEY,
        "month",
        "quantity",
        (month_number(F.col("month")) - last).cast("int").alias("months_since_demand"),
        *[F.sum(q).over(order.rowsBetween(-k, -1)).alias(f"sum_{k}") for k in (3, 6, 12)],
        F.lag(q, 1).over(order).alias("lag_1"),
        ratio(n, n_nz).alias("adi"),
        F.pow(ratio(F.stddev_samp(nz).over(before), F.avg(nz).over(before)), F.lit(2)).alias("cv2"),
    )


# ---- smoothing: recurrences over months, for a batch of series at once. A fold in SQL would run interpreted, once for each
# alpha of the grid; here a step is one array operation over all series and alphas.


def _matrix(series: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(series, months) filled up with zeros, and the lengths."""
    lengths = np.array([len(x) for x in series], dtype=np.int64)
    out = np.zeros((len(series), max(1, int(lengths.max(initial=0)))))
    out[np.arange(out.shape[1]) < lengths[:, None]] = np.concatenate([*series, np.zeros(0)])
    return out, lengths


def _pick(errors: np.ndarray) -> np.ndarray:
    """The column of each row's least error to nine places, the first of equals; the first if none is known."""
    return np.where(np.isnan(errors), np.inf, np.round(errors, 9)).argmin(axis=1)


def ses_batch(q: np.ndarray, lengths: np.ndarray, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(alpha, level) of each series: the grid's least sum of one-step absolute errors."""
    level, error = np.repeat(q[:, :1], len(grid), axis=1), np.zeros((len(q), len(grid)))
    for k in range(1, q.shape[1]):
        x, live = q[:, k : k + 1], (lengths > k)[:, None]
        error = np.where(live, error + np.abs(x - level), error)
        level = np.where(live, grid * x + (1 - grid) * level, level)
    best, rows = _pick(error), np.arange(len(q))
    return grid[best], level[rows, best]


def sba_batch(q: np.ndarray, lengths: np.ndarray, grid: np.ndarray) -> tuple[np.ndarray, ...]:
    """(alpha, events, size, interval) of each series: the grid's rate nearest to the mean."""
    shape = (len(q), len(grid))
    size, interval, events, gap = np.zeros(shape), np.zeros(shape), np.zeros(len(q), np.int32), np.zeros(len(q))
    for k in range(q.shape[1]):
        x = q[:, k]
        live = lengths > k
        gap = np.where(live, gap + 1, gap)
        hit, first = (live & (x > 0))[:, None], (events == 0)[:, None]
        size = np.where(hit, np.where(first, x[:, None], grid * x[:, None] + (1 - grid) * size), size)
        interval = np.where(hit, np.where(first, gap[:, None], grid * gap[:, None] + (1 - grid) * interval), interval)
        events = events + hit[:, 0]
        gap = np.where(hit[:, 0], 0, gap)
    with np.errstate(divide="ignore", invalid="ignore"):
        error = np.abs((1 - grid / 2) * size / interval - (q.sum(axis=1) / lengths)[:, None])
    best, rows = _pick(np.where(events[:, None] >= 2, error, np.nan)), np.arange(len(q))
    return grid[best], events, size[rows, best], interval[rows, best]


def ses(keyed: DataFrame) -> DataFrame:
    """Simple exponential smoothing with the grid's best alpha; fewer than two months have no rate."""

    @F.pandas_udf("alpha double, level double")
    def fit(series: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(("alpha", "level"), ses_batch(*_matrix(series), np.array(SES_GRID)))))

    out = keyed.where(F.size("q") >= 2).withColumn("_f", fit("q"))
    return out.withColumn("alpha", F.col("_f.alpha")).withColumn("rate", F.greatest(F.col("_f.level"), F.lit(0.0))).drop("_f")


def mean_of(q: Column) -> Column:
    return F.aggregate(q, F.lit(0.0), lambda a, x: a + x) / F.size(q)


def sba(keyed: DataFrame) -> DataFrame:
    """Syntetos-Boylan approximation; fewer than two demand events have no rate but a status."""

    @F.pandas_udf("alpha double, events int, size double, interval double")
    def fit(series: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(("alpha", "events", "size", "interval"), sba_batch(*_matrix(series), np.array(SBA_GRID)))))

    events = F.col("_f.events")
    out = keyed.withColumn("_f", fit("q"))
    status = F.when(events == 0, "NO_NON_ZERO_DEMAND").when(events < 2, "INSUFFICIENT_NON_ZERO_OBSERVATIONS").otherwise("SUCCESS")
    out = out.withColumn("alpha", F.col("_f.alpha")).withColumn("status", status).withColumn("events", events)
    out = out.withColumn("z_final", F.when(events >= 2, F.col("_f.size"))).withColumn("p_final", F.when(events >= 2, F.col("_f.interval")))
    return out.withColumn("rate", (1 - F.col("alpha") / 2) * F.col("z_final") / F.col("p_final")).drop("_f")


def tsb(keyed: DataFrame, alpha: float = TSB_ALPHA, beta: float = TSB_BETA) -> DataFrame:
    """Teunter-Syntetos-Babai: probability of demand times size, both starting at their means."""
    q = F.col("q")
    hits = F.filter(q, lambda x: x > 0)
    start = F.struct((F.size(hits) / F.size(q)).alias("p"), F.when(F.size(hits) > 0, mean_of(hits)).otherwise(F.lit(0.0)).alias("z"))

    def step(s: Column, x: Column) -> Column:
        return F.struct(
            F.when(x > 0, s["p"] + beta * (1 - s["p"])).otherwise(s["p"] + beta * (0 - s["p"])).alias("p"),
            F.when(x > 0, s["z"] + alpha * (x - s["z"])).otherwise(s["z"]).alias("z"),
        )

    out = keyed.withColumn("_s", F.aggregate(q, start, step))
    status = F.when(F.size("q") < 2, "INSUFFICIENT_HISTORY").when(F.size(hits) == 0, "NO_NON_ZERO_DEMAND").otherwise("SUCCESS")
    out = out.withColumn("status", status).withColumn("p_final", F.col("_s.p")).withColumn("z_final", F.col("_s.z"))
    return out.withColumn("rate", F.when(F.col("status") == "SUCCESS", F.greatest(F.col("p_final") * F.col("z_final"), F.lit(0.0)))).drop("_s")


# ---- backtest


def rolling_origins(keyed: DataFrame, horizon: int, minimum: int = MIN_TRAINING) -> DataFrame:
    """One row for each key and origin: the months up to it, and the actuals of the horizon, cut at the data's end."""
    grown = keyed.where(F.size("q") > minimum).withColumn("origin", F.explode(F.sequence(F.lit(minimum), F.size("q") - 1)))
    return grown.select(*KEY, "origin", F.slice("q", F.lit(1), F.col("origin")).alias("q"), F.slice("q", F.col("origin") + 1, F.least(F.lit(horizon), F.size("q") - F.col("origin"))).alias("actuals"))


def forecast_paths(forecasts: DataFrame, model: str) -> DataFrame:
    """(key, model, origin, step, predicted, actual) of origins that have a rate."""
    known = forecasts.where(F.col("rate").isNotNull())
    return known.select(*KEY, F.lit(model).alias("model"), "origin", F.col("rate").alias("predicted"), F.posexplode("actuals").alias("step", "actual"))


def backtest_metrics(paths: DataFrame, quantile: float, unit_price: float | None = None, holding_rate: float | None = None) -> DataFrame:
    """Pinball loss, mean error, bias, mean absolute error, fill rate, holding cost of each key and model."""
    p, a = F.col("predicted"), F.col("actual")
    error = a - p
    pinball = F.when(error >= 0, quantile * error).otherwise((quantile - 1) * error)
    out = paths.groupBy(*KEY, "model").agg(
        F.countDistinct("origin").alias("origins"),
        F.avg(pinball).alias("pinball"),
        F.avg(p - a).alias("mean_error"),
        F.avg(F.abs(p - a)).alias("mae"),
        ratio(F.sum(p - a), F.sum(a)).alias("bias"),
        ratio(F.sum(F.least(p, a)), F.sum(a)).alias("fill_rate"),
        F.sum(F.greatest(p - a, F.lit(0.0))).alias("excess"),
    )
    cost = F.lit(None).cast("double") if unit_price is None or holding_rate is None else F.col("excess") * unit_price * holding_rate / 12
    return out.withColumn("holding_cost", cost).drop("excess")


def decide(metrics: DataFrame, baseline: str, challenger: str) -> DataFrame:
    """Whether the challenger may replace the baseline: enough origins, a large enough gain, no worse bias."""
    one = lambda name, p: metrics.where(F.col("model") == name).select(*KEY, *[F.col(c).alias(f"{p}_{c}") for c in ("pinball", "bias", "origins")])
    both = one(baseline, "b").join(one(challenger, "c"), KEY, "left")
    gain = F.when(F.col("b_pinball") != 0, (F.col("b_pinball") - F.col("c_pinball")) / F.col("b_pinball"))
    both = both.withColumn("improvement", gain).withColumn("bias_change", F.abs("c_bias") - F.abs("b_bias"))
    status = (
        F.when(F.col("improvement").isNull(), "NOT_EVALUABLE")
        .when(F.col("c_origins") < REQUIRED_ORIGINS, "NOT_ELIGIBLE_INSUFFICIENT_ORIGINS")
        .when(F.col("improvement") <= MIN_IMPROVEMENT, "BASELINE_RETAINED")
        .when(F.col("bias_change") > MAX_BIAS_CHANGE, "BASELINE_RETAINED")
        .otherwise("CHALLENGER_ELIGIBLE")
    )
    return both.withColumn("status", status)


def assess_months(volumes: list[tuple], reference: int = 6, minimum: int = 3, least: float = 0.25) -> list[tuple]:
    """(month, volume, complete, reference) over a spine of months: each compared with the median of the last complete ones.

    A fold on the driver over one row for each calendar month; what counts as complete depends on earlier verdicts.
    """
    from statistics import median

    held, out = [], []
    for when, volume in volumes:
        usual = float(median(held[-reference:])) if len(held) >= minimum else None
        complete = volume > 0 and (usual is None or volume / usual >= least)
        if complete:
            held.append(volume)
        out.append((when, volume, complete, usual if volume > 0 else None))
    return out


def month_completeness(moves: DataFrame) -> DataFrame:
    """month, volume, complete, reference of every month from the first to the last of a day column."""
    counted = moves.groupBy(month(F.col("day")).alias("month")).agg(F.count(F.lit(1)).alias("volume"))
    spine = counted.agg(F.min("month").alias("a"), F.max("month").alias("b")).select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))
    rows = spine.join(counted, "month", "left").select("month", F.coalesce("volume", F.lit(0)).alias("volume")).orderBy("month").collect()  # calendar months
    return moves.sparkSession.createDataFrame(assess_months([tuple(r) for r in rows]), "month date, volume long, complete boolean, reference double")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
