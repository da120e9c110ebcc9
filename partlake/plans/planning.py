"""Demand and stock queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partlake.functions.semantics import whole_up
from partlake.operators import demand, stock
from partlake.plans.registry import AS_OF, DENSE, END, MONTHLY, MOVES, SERIES, START, STATS, Registry, moves, rounded
from partlake.session import read_table

queries = Registry()
KEY = demand.KEY


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demand.monthly_consumption(moves(spark, sf_dir))


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demand.series(monthly(spark, sf_dir), START, END)


def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demand.demand_statistics(demand.densify(monthly(spark, sf_dir), START, END))


@queries.add(f"WITH {MONTHLY} SELECT * FROM monthly")
def monthly_net_consumption(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monthly(spark, sf_dir)


@queries.add(f"WITH {DENSE} SELECT * FROM dense")
def densified_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demand.densify(monthly(spark, sf_dir), START, END)


@queries.add(f"""WITH {STATS} SELECT material, plant, n, n_nz, round(total, 6) AS total, round(mean_all, 6) AS mean_all, round(std_all, 6) AS std_all,
  round(mean_nz, 6) AS mean_nz, round(std_nz, 6) AS std_nz, round(adi, 6) AS adi, round(cv2, 6) AS cv2,
  CASE WHEN n = 0 THEN 'NO_HISTORY' WHEN n_nz = 0 THEN 'NO_NON_ZERO_DEMAND' WHEN n_nz < 2 THEN 'INSUFFICIENT_NON_ZERO_OBSERVATIONS'
  WHEN mean_nz = 0 THEN 'ZERO_MEAN' ELSE 'AVAILABLE' END AS cv2_status FROM rated""")
def demand_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics(spark, sf_dir))


CLASSES = STATS + """, classed AS (SELECT *, CASE WHEN n_nz < 5 OR n < 6 THEN 'COLD_START' ELSE 'SUFFICIENT' END AS history_status,
  CASE WHEN n >= 24 THEN 'FULL' WHEN n >= 12 THEN 'LIMITED' ELSE 'INSUFFICIENT' END AS sufficiency,
  CASE WHEN adi IS NULL OR cv2 IS NULL THEN 'UNCLASSIFIED' WHEN adi <= 1.32 THEN CASE WHEN cv2 <= 0.49 THEN 'SMOOTH' ELSE 'ERRATIC' END
  WHEN cv2 <= 0.49 THEN 'INTERMITTENT' ELSE 'LUMPY' END AS pattern FROM rated)"""


@queries.add(f"""WITH {CLASSES} SELECT material, plant, history_status, sufficiency, pattern,
  CASE WHEN pattern IN ('SMOOTH', 'ERRATIC') THEN 'SES' WHEN pattern IN ('INTERMITTENT', 'LUMPY') THEN 'SBA' END AS baseline,
  CASE WHEN pattern IN ('SMOOTH', 'ERRATIC') THEN 'AUTO_ARIMA' WHEN pattern IN ('INTERMITTENT', 'LUMPY') THEN 'LIGHTGBM' END AS challenger FROM classed""")
def demand_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demand.classify(statistics(spark, sf_dir)).select(*KEY, "history_status", "sufficiency", "pattern", "baseline", "challenger")


@queries.add(f"""WITH {SERIES}, w AS (SELECT material, plant, len(q) AS months, list_filter(q[-12:], lambda x: x > 0) AS nz, list_filter(q[-12:-7], lambda x: x > 0) AS early,
  list_filter(q[-6:], lambda x: x > 0) AS recent, list_filter(q[-3:], lambda x: x > 0) AS latest FROM keyed),
  c AS (SELECT material, plant, months::INTEGER AS months, len(nz)::INTEGER AS nonzero_months, len(early)::INTEGER AS early_nonzero, len(recent)::INTEGER AS recent_nonzero, len(latest) = 0 AS latest_zero FROM w),
  d AS (SELECT *, CASE WHEN nonzero_months >= 4 AND early_nonzero >= 3 THEN 1 - recent_nonzero / early_nonzero::DOUBLE END AS decline FROM c)
  SELECT material, plant, months, nonzero_months, early_nonzero, recent_nonzero, latest_zero, round(decline, 6) AS decline,
  CASE WHEN nonzero_months < 4 THEN 'INSUFFICIENT_HISTORY' WHEN early_nonzero < 3 THEN 'INSUFFICIENT_EARLY_DEMAND' WHEN decline < 0.5 THEN 'DECLINE_THRESHOLD_NOT_MET'
  WHEN NOT latest_zero THEN 'RECENT_DEMAND_PRESENT' ELSE 'DECLINING_DEMAND' END AS status FROM d""")
def declining_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(demand.declining(keyed(spark, sf_dir)))


@queries.add(f"""WITH {DENSE} SELECT material, plant, month, quantity,
  (date_part('year', month) * 12 + date_part('month', month) - max(CASE WHEN quantity > 0 THEN date_part('year', month) * 12 + date_part('month', month) END) OVER b)::INTEGER AS months_since_demand,
  sum(quantity) OVER (o ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS sum_3, sum(quantity) OVER (o ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS sum_6,
  sum(quantity) OVER (o ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS sum_12, lag(quantity) OVER (PARTITION BY material, plant ORDER BY month) AS lag_1,
  round(count(*) OVER b / nullif(count(nullif(quantity, 0)) OVER b, 0)::DOUBLE, 6) AS adi,
  round(pow(stddev_samp(nullif(quantity, 0)) OVER b / nullif(avg(nullif(quantity, 0)) OVER b, 0), 2), 6) AS cv2
  FROM dense WINDOW o AS (PARTITION BY material, plant ORDER BY month), b AS (PARTITION BY material, plant ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""".replace("OVER (o ROWS", "OVER (PARTITION BY material, plant ORDER BY month ROWS").replace("WINDOW o AS (PARTITION BY material, plant ORDER BY month), b", "WINDOW b"))
def lag_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(demand.lag_features(demand.densify(monthly(spark, sf_dir), START, END)))


SES_SQL = """list_reduce(list_transform({q}, lambda v: {{'l': v, 'e': 0.0::DOUBLE}}), lambda s, x: {{'l': a * x.l + (1 - a) * s.l, 'e': s.e + abs(x.l - s.l)}})"""


@queries.add(f"""WITH {SERIES}, grid AS (SELECT round(0.05 * k, 2)::DOUBLE AS a FROM range(1, 20) t(k)),
  runs AS (SELECT material, plant, a, {SES_SQL.format(q='q')} AS s FROM keyed, grid),
  best AS (SELECT material, plant, min({{'error': round(s.e, 9), 'alpha': a, 'rate': greatest(s.l, 0)}}) AS b FROM runs GROUP BY ALL)
  SELECT material, plant, round(b.alpha + 1e-9, 6) AS alpha, round(b.rate + 1e-9, 6) AS rate FROM best""")
def forecast_ses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(demand.ses(keyed(spark, sf_dir)).select(*KEY, "alpha", "rate"), nudge=1e-9)


EVENTS = SERIES + """, hits AS (SELECT material, plant, quantity AS size, (date_part('year', month) * 12 + date_part('month', month)) AS spot,
  row_number() OVER (PARTITION BY material, plant ORDER BY month) AS k FROM dense WHERE quantity > 0),
  gaps AS (SELECT material, plant, size, k, (spot - coalesce(lag(spot) OVER (PARTITION BY material, plant ORDER BY k), {before}))::DOUBLE AS gap FROM hits),
  lists AS (SELECT material, plant, list(size ORDER BY k) AS sizes, list(gap ORDER BY k) AS gaps FROM gaps GROUP BY ALL)""".format(before=int(START[:4]) * 12 + int(START[5:7]) - 1)


@queries.add(f"""WITH {EVENTS}, grid AS (SELECT unnest([0.05, 0.10, 0.15, 0.20]::DOUBLE[]) AS a),
  runs AS (SELECT material, plant, a, list_reduce(sizes, lambda s, x: a * x + (1 - a) * s) AS z, list_reduce(gaps, lambda s, x: a * x + (1 - a) * s) AS p FROM lists, grid WHERE len(sizes) >= 2),
  best AS (SELECT material, plant, min({{'error': round(abs((1 - a / 2) * z / p - list_sum(q) / len(q)), 9), 'alpha': a, 'z': z, 'p': p}}) AS b FROM runs JOIN keyed USING (material, plant) GROUP BY ALL)
  SELECT k.material, k.plant, round(coalesce(b.alpha, 0.05::DOUBLE) + 1e-9, 6) AS alpha, CASE WHEN sizes IS NULL THEN 'NO_NON_ZERO_DEMAND' WHEN len(sizes) < 2 THEN 'INSUFFICIENT_NON_ZERO_OBSERVATIONS' ELSE 'SUCCESS' END AS status,
  coalesce(len(sizes), 0)::INTEGER AS events, round(b.z + 1e-9, 6) AS z_final, round(b.p + 1e-9, 6) AS p_final, round((1 - b.alpha / 2) * b.z / b.p + 1e-9, 6) AS rate
  FROM keyed k LEFT JOIN lists USING (material, plant) LEFT JOIN best USING (material, plant)""")
def forecast_sba(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(demand.sba(keyed(spark, sf_dir)).select(*KEY, "alpha", "status", "events", "z_final", "p_final", "rate"), nudge=1e-9)


@queries.add(f"""WITH {SERIES}, start AS (SELECT material, plant, q, list_filter(q, lambda x: x > 0) AS hits FROM keyed),
  runs AS (SELECT material, plant, q, hits, list_reduce(list_prepend(len(hits) / len(q)::DOUBLE, list_transform(q, lambda x: CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END::DOUBLE)), lambda p, x: p + 0.1::DOUBLE * (x - p)) AS p_final,
  list_reduce(list_prepend(coalesce(list_sum(hits) / nullif(len(hits), 0), 0)::DOUBLE, hits), lambda z, x: z + 0.1::DOUBLE * (x - z)) AS z_final FROM start)
  SELECT material, plant, CASE WHEN len(q) < 2 THEN 'INSUFFICIENT_HISTORY' WHEN len(hits) = 0 THEN 'NO_NON_ZERO_DEMAND' ELSE 'SUCCESS' END AS status,
  round(p_final, 6) AS p_final, round(z_final, 6) AS z_final, CASE WHEN len(q) >= 2 AND len(hits) > 0 THEN round(greatest(p_final * z_final, 0), 6) END AS rate FROM runs""")
def forecast_tsb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(demand.tsb(keyed(spark, sf_dir)).select(*KEY, "status", "p_final", "z_final", "rate"))


HORIZON, QUANTILE, PRICE, HOLDING = 3, 0.95, 10.0, 0.2
PATHS = SERIES + f""", origins AS (SELECT material, plant, origin, q[1:origin] AS t, q[origin + 1:origin + {HORIZON}] AS actuals FROM keyed, range(3, 24) r(origin)),
  grid AS (SELECT round(0.05 * k, 2)::DOUBLE AS a FROM range(1, 20) t(k)),
  runs AS (SELECT material, plant, origin, actuals, a, {SES_SQL.format(q='t')} AS s FROM origins, grid),
  best AS (SELECT material, plant, origin, any_value(actuals) AS actuals, min({{'error': round(s.e, 9), 'alpha': a, 'rate': greatest(s.l, 0)}}) AS b FROM runs GROUP BY material, plant, origin),
  paths AS (SELECT material, plant, 'SES' AS model, origin, b.rate AS predicted, unnest(actuals) AS actual FROM best)"""
METRICS = PATHS + f""", metrics AS (SELECT material, plant, model, count(DISTINCT origin) AS origins,
  avg(CASE WHEN actual >= predicted THEN {QUANTILE} * (actual - predicted) ELSE {QUANTILE - 1:.2f} * (actual - predicted) END) AS pinball, avg(predicted - actual) AS mean_error,
  avg(abs(predicted - actual)) AS mae, sum(predicted - actual) / nullif(sum(actual), 0) AS bias, sum(least(predicted, actual)) / nullif(sum(actual), 0) AS fill_rate,
  sum(greatest(predicted - actual, 0)) * {PRICE} * {HOLDING} / 12 AS holding_cost FROM paths GROUP BY ALL)"""


def ses_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demand.forecast_paths(demand.ses(demand.rolling_origins(keyed(spark, sf_dir), HORIZON)), "SES")


def metrics(paths: DataFrame) -> DataFrame:
    return demand.backtest_metrics(paths, QUANTILE, PRICE, HOLDING)


@queries.add(f"WITH {METRICS} SELECT material, plant, model, origins, round(pinball + 1e-7, 3) AS pinball, round(mean_error + 1e-7, 3) AS mean_error, round(mae + 1e-7, 3) AS mae, round(bias + 1e-7, 3) AS bias, round(fill_rate + 1e-7, 3) AS fill_rate, round(holding_cost + 1e-7, 3) AS holding_cost FROM metrics")
def backtest_ses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics(ses_paths(spark, sf_dir)), 3, 1e-7)


CHAMPIONS = PATHS.replace("paths AS (", "ses_paths AS (") + """, ev AS (SELECT material, plant, origin, t, actuals, list_filter(t, lambda x: x > 0) AS sizes, list_filter(range(1, len(t) + 1), lambda i: t[i] > 0) AS spots FROM origins),
  ev2 AS (SELECT *, list_transform(range(1, len(spots) + 1), lambda i: (spots[i] - CASE WHEN i > 1 THEN spots[i - 1] ELSE 0 END)::DOUBLE) AS gaps FROM ev WHERE len(sizes) >= 2),
  sruns AS (SELECT *, list_reduce(sizes, lambda s, x: a * x + (1 - a) * s) AS z, list_reduce(gaps, lambda s, x: a * x + (1 - a) * s) AS p FROM ev2, (SELECT unnest([0.05, 0.10, 0.15, 0.20]::DOUBLE[]) AS a)),
  sbest AS (SELECT material, plant, origin, any_value(actuals) AS actuals, min({'error': round(abs((1 - a / 2) * z / p - list_sum(t) / len(t)), 9), 'alpha': a, 'rate': (1 - a / 2) * z / p}) AS b FROM sruns GROUP BY material, plant, origin),
  paths AS (SELECT * FROM ses_paths UNION ALL SELECT material, plant, 'SBA', origin, b.rate, unnest(actuals) FROM sbest)""" + METRICS.removeprefix(PATHS)


@queries.add(f"""WITH {CHAMPIONS}, both_ AS (SELECT b.material, b.plant, b.pinball AS b_pinball, b.bias AS b_bias, b.origins AS b_origins, c.pinball AS c_pinball, c.bias AS c_bias, c.origins AS c_origins,
  (b.pinball - c.pinball) / nullif(b.pinball, 0) AS improvement, abs(c.bias) - abs(b.bias) AS bias_change FROM metrics b LEFT JOIN metrics c ON c.material = b.material AND c.plant = b.plant AND c.model = 'SES' WHERE b.model = 'SBA')
  SELECT material, plant, b_origins, c_origins, round(b_pinball + 1e-7, 3) AS b_pinball, round(c_pinball + 1e-7, 3) AS c_pinball, round(b_bias + 1e-7, 3) AS b_bias, round(c_bias + 1e-7, 3) AS c_bias, round(improvement + 1e-7, 3) AS improvement, round(bias_change + 1e-7, 3) AS bias_change,
  CASE WHEN improvement IS NULL THEN 'NOT_EVALUABLE' WHEN c_origins < {demand.REQUIRED_ORIGINS} THEN 'NOT_ELIGIBLE_INSUFFICIENT_ORIGINS' WHEN improvement <= {demand.MIN_IMPROVEMENT} THEN 'BASELINE_RETAINED' WHEN bias_change > {demand.MAX_BIAS_CHANGE} THEN 'BASELINE_RETAINED' ELSE 'CHALLENGER_ELIGIBLE' END AS status FROM both_""")
def champion_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SBA against SES by rolling origins. A fold over events at each origin; tested against plain Python too."""
    origins = demand.rolling_origins(keyed(spark, sf_dir), HORIZON)
    paths = demand.forecast_paths(demand.sba(origins), "SBA").unionByName(demand.forecast_paths(demand.ses(origins), "SES"))
    return rounded(demand.decide(metrics(paths), "SBA", "SES"), 3, 1e-7)


@queries.add(f"""WITH RECURSIVE {MOVES}, n AS (SELECT date_trunc('month', day)::DATE AS month, count(*) AS volume FROM moves GROUP BY 1), v AS (SELECT s.month, coalesce(volume, 0) AS volume, row_number() OVER (ORDER BY s.month) AS k
    FROM (SELECT unnest(generate_series((SELECT min(month) FROM n), (SELECT max(month) FROM n), INTERVAL 1 MONTH))::DATE AS month) s LEFT JOIN n USING (month)),
  f AS (SELECT 0::BIGINT AS k, NULL::DATE AS month, 0::BIGINT AS volume, false AS complete, NULL::DOUBLE AS reference, []::BIGINT[] AS held UNION ALL
    SELECT k, month, volume, complete, CASE WHEN volume > 0 THEN usual END, CASE WHEN complete THEN list_append(held, volume) ELSE held END FROM (SELECT *, volume > 0 AND (usual IS NULL OR volume / usual >= 0.25) AS complete
      FROM (SELECT v.k, v.month, v.volume, f.held, CASE WHEN len(f.held) >= 3 THEN list_aggregate(f.held[-6:], 'median')::DOUBLE END AS usual FROM f JOIN v ON v.k = f.k + 1)))
  SELECT month, volume, complete, reference FROM f WHERE k > 0""")
def month_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict depends on earlier ones; tested against a plain fold too."""
    return demand.month_completeness(moves(spark, sf_dir))


# ---- stock

INPUTS = STATS + f""", lead AS (SELECT material, plant, *, (material % 90)::DOUBLE AS lead_days FROM rated)""".replace("SELECT material, plant, *,", "SELECT *,")
LEVEL, ORDER_COST = 0.95, 50.0
Z = stock.z_factor(LEVEL)


def inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics with a planned delivery time in days (0 is none)."""
    return stock.planned_lead_time(statistics(spark, sf_dir).withColumn("lead_days", (F.col("material") % 90).cast("double")), "lead_days")


STOCK = INPUTS + f""", lt AS (SELECT *, CASE WHEN lead_days > 0 THEN 'LIMITED' ELSE 'NOT_EVALUABLE_LEAD_TIME' END AS lead_status, CASE WHEN lead_days > 0 THEN lead_days / 30.44 END AS lt_months,
  CASE WHEN lead_days > 0 THEN lead_days * 0.3 / 30.44 END AS sigma_lt_months FROM lead),
  ss AS (SELECT *, {Z!r}::DOUBLE * sqrt(lt_months * std_all * std_all + mean_all * mean_all * sigma_lt_months * sigma_lt_months) AS raw_ss,
  CASE WHEN adi > 0 THEN {Z!r}::DOUBLE * sqrt(lt_months / adi * (std_nz * std_nz + mean_nz * mean_nz)) END AS raw_ss_compound FROM lt),
  rop AS (SELECT *, ceil(round(raw_ss, 6))::BIGINT AS safety_stock, ceil(round(raw_ss_compound, 6))::BIGINT AS safety_stock_compound FROM ss),
  parameters AS (SELECT r.*, ceil(round(mean_all * lt_months + safety_stock, 6))::BIGINT AS rop, ceil(round(safety_stock + sqrt(2 * mean_all * 12 * {ORDER_COST} / (0.2 * p_retailprice)), 6))::BIGINT AS max_eoq,
  ceil(round(ceil(round(mean_all * lt_months + safety_stock, 6)) + mean_all * 3, 6))::BIGINT AS max_review FROM rop r JOIN part ON p_partkey = material)"""


def parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    up = lambda c: whole_up(F.round(c, 6))
    c = F.col
    out = inputs(spark, sf_dir)
    out = out.withColumn("safety_stock", up(stock.safety_stock_normal(Z, c("lt_months"), c("std_all"), c("mean_all"), c("sigma_lt_months"))))
    out = out.withColumn("safety_stock_compound", up(stock.safety_stock_compound(Z, c("lt_months"), c("adi"), c("mean_nz"), c("std_nz"))))
    prices = read_table(spark, sf_dir, "part").select(c("p_partkey").alias("material"), "p_retailprice")
    out = out.join(prices, "material").withColumn("rop", up(stock.reorder_point(c("mean_all"), c("lt_months"), c("safety_stock"))))
    out = out.withColumn("max_eoq", up(stock.max_stock_eoq(c("safety_stock"), c("mean_all"), F.lit(ORDER_COST), F.lit(0.2), c("p_retailprice"))))
    return out.withColumn("max_review", up(stock.max_stock_review(c("rop"), c("mean_all"), F.lit(3.0))))


@queries.add(f"WITH {STOCK} SELECT material, plant, lead_status, safety_stock, safety_stock_compound, rop, max_eoq, max_review FROM parameters")
def stock_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parameters(spark, sf_dir).select(*KEY, "lead_status", "safety_stock", "safety_stock_compound", "rop", "max_eoq", "max_review")


@queries.add(f"""WITH {STOCK}, need AS (SELECT *, CASE WHEN lead_days > 0 THEN mean_all * lead_days / 30.4375 + 1.645 * std_all * sqrt(lead_days / 30.4375) END AS requirement FROM parameters),
  checked AS (SELECT *, CASE WHEN rop IS NULL THEN 'NOT_APPLICABLE' WHEN n < 12 THEN 'INSUFFICIENT_DATA_INCOMPLETE_WINDOW' WHEN total = 0 THEN 'ZERO_CONSUMPTION' WHEN std_all IS NULL THEN 'INSUFFICIENT_DATA_NO_VARIABILITY'
  WHEN requirement > 0 AND rop > 2 * requirement THEN 'HIGH_VS_DEMAND' ELSE 'PLAUSIBLE' END AS check_status FROM need)
  SELECT material, plant, rop, round(requirement, 6) AS requirement, check_status, (check_status = 'HIGH_VS_DEMAND' OR (check_status = 'ZERO_CONSUMPTION' AND coalesce(rop, 0) > 0)) AS flagged FROM checked""")
def demand_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stock.demand_check(parameters(spark, sf_dir))
    return rounded(out.select(*KEY, "rop", "requirement", "check_status", F.coalesce("flagged", F.lit(False)).alias("flagged")))


@queries.add()
def monte_carlo_safety_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded simulation; tested for determinism and against the closed form."""
    out = inputs(spark, sf_dir).select(*KEY, F.col("mean_all").alias("d_avg"), F.col("std_all").alias("sigma_d"), "lt_months", "sigma_lt_months")
    return stock.monte_carlo_safety_stock(out, LEVEL)


@queries.add(f"""WITH {MOVES}, u AS (SELECT material, plant, max(day) FILTER (NOT reversal) AS last_issue_date,
  greatest(coalesce(sum(CASE WHEN reversal THEN -qty ELSE qty END) FILTER (day > DATE '{AS_OF}' - 90), 0), 0)::DOUBLE AS usage FROM moves WHERE day <= DATE '{AS_OF}' GROUP BY ALL)
  SELECT * FROM u WHERE last_issue_date IS NOT NULL""")
def stockout_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stock.stockout_usage(moves(spark, sf_dir), AS_OF)


VALUED = """rows AS (SELECT p_partkey % 300 AS material, CASE p_size % 4 WHEN 0 THEN 'NEW' WHEN 1 THEN 'NEW-INS' WHEN 2 THEN '' END AS valuation_type,
  CASE WHEN p_size % 7 = 0 THEN 1.0 ELSE round(p_size * 2.5, 2) END::DOUBLE AS price FROM part WHERE p_size < 25)"""


@queries.add(f"""WITH {VALUED}, g AS (SELECT material, bool_or(nullif(trim(valuation_type), '') IS NOT NULL) AS split, list(DISTINCT price) FILTER (valuation_type = 'NEW' AND price > 1) AS a,
  list(DISTINCT price) FILTER (valuation_type = 'NEW-INS' AND price > 1) AS b, list(DISTINCT price) FILTER (nullif(valuation_type, '') IS NULL AND price > 1) AS c,
  count(*) FILTER (price <= 1) AS tokens FROM rows GROUP BY ALL), h AS (SELECT *, CASE WHEN len(a) > 0 THEN a WHEN len(b) > 0 THEN b WHEN NOT split AND len(c) > 0 THEN c END AS pick FROM g)
  SELECT material, CASE WHEN len(pick) = 1 THEN pick[1] END AS unit_price, CASE WHEN len(pick) = 1 THEN 'PRICED' WHEN len(pick) > 1 THEN 'AMBIGUOUS' WHEN tokens > 0 THEN 'TOKEN_PRICE' ELSE 'NO_PRICE' END AS price_status FROM h""")
def unit_price_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    kind = F.when(size % 4 == 0, "NEW").when(size % 4 == 1, "NEW-INS").when(size % 4 == 2, "")
    price = F.when(size % 7 == 0, F.lit(1.0)).otherwise(F.round(size * 2.5, 2))
    rows = read_table(spark, sf_dir, "part").where(size < 25).select((F.col("p_partkey") % 300).alias("material"), kind.alias("valuation_type"), price.alias("price"))
    return stock.choose_price(rows)


COVER = STATS + """, c AS (SELECT material, plant, n_nz AS events, mean_all AS rate, (material % 40)::DOUBLE AS stock, (plant * 2)::DOUBLE AS open_po, (material % 60)::DOUBLE AS requested,
  CASE WHEN material % 3 = 0 THEN (material % 50)::DOUBLE END AS plan_need FROM rated)"""


def cover_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("material")
    return statistics(spark, sf_dir).select(
        *KEY,
        F.col("n_nz").alias("events"),
        F.col("mean_all").alias("rate"),
        (m % 40).cast("double").alias("stock"),
        (F.col("plant") * 2).cast("double").alias("open_po"),
        (m % 60).cast("double").alias("requested"),
        F.when(m % 3 == 0, (m % 50).cast("double")).alias("plan_need"),
    )


@queries.add(f"""WITH {COVER}, s AS (SELECT *, CASE WHEN events < 3 THEN 'INSUFFICIENT_HISTORY' WHEN rate <= 0 THEN 'NO_CONSUMPTION_RATE' END AS refused FROM c),
  t AS (SELECT *, CASE WHEN refused IS NULL THEN least(floor(greatest(rate * 6 - (stock + open_po), 0)), requested) END AS suggested FROM s)
  SELECT material, plant, refused, suggested, CASE WHEN rate > 0 THEN round((stock + open_po + suggested) / rate, 1) END AS cover_if_suggested, CASE WHEN rate > 0 THEN round((stock + open_po + requested) / rate, 1) END AS cover_if_requested FROM t""")
def quantity_suggestion_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stock.quantity_suggestion_floor(cover_inputs(spark, sf_dir), 6.0, 3).select(*KEY, "refused", "suggested", "cover_if_suggested", "cover_if_requested")


@queries.add(f"""WITH {COVER}, s AS (SELECT *, CASE WHEN rate > 0 THEN greatest(rate * 6 - stock - open_po, 0) END AS ceiling, coalesce(CASE WHEN plan_need IS NOT NULL THEN greatest(plan_need - stock - open_po, 0) END, requested) AS need FROM c)
  SELECT material, plant, round(CASE WHEN ceiling IS NULL THEN need ELSE least(need, ceiling) END, 6) AS suggested,
  CASE WHEN ceiling IS NULL THEN 'NO_RATE' WHEN round(need, 9) > round(ceiling, 9) THEN 'COVER_CEILING' WHEN plan_need IS NOT NULL THEN 'PLAN_NEED' ELSE 'REQUEST' END AS basis FROM s""")
def quantity_suggestion_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stock.quantity_suggestion_cover(cover_inputs(spark, sf_dir), 6.0).select(*KEY, "suggested", "basis")


