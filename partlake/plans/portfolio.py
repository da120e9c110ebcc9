"""Scope, stock position and portfolio report queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partlake.operators import demand, portfolio, scope
from partlake.plans.planning import HORIZON, keyed
from partlake.plans.registry import AS_OF, MONTHLY, MOVES, SERIES, Registry, day_of, moves, rounded
from partlake.session import read_table

queries = Registry()
c = F.col
STATUSES = ["READY_FOR_REVIEW", "PENDING_APPROVAL", "HELD", "APPROVED", "NOT_EVALUABLE", "RETURNED"]
TIERS = ["CRITICAL", "IMPACT", "INSURANCE", "NORMAL"]
RATES = {"ZAR": 1.0, "USD": 18.0, "EUR": 20.0}

#: One recommendation for each part.
RECS = f"""recs AS (SELECT p_partkey AS material, p_partkey % 5 AS plant, p_name AS description, {STATUSES}[p_size % 6 + 1] AS status, {TIERS}[p_size % 5 + 1] AS criticality, p_type AS circuit, p_brand AS demand_class,
  p_size % 3 = 0 AS is_oar, CASE WHEN p_size % 11 <> 0 THEN p_retailprice - 950 END AS unit_price, ['ZAR', 'USD', 'EUR'][p_size % 4 + 1] AS currency, CASE WHEN p_size % 7 <> 0 THEN p_size::DOUBLE END AS current_rop,
  CASE WHEN p_size % 9 <> 0 THEN (p_size * 3 % 50)::DOUBLE END AS recommended_rop, CASE WHEN p_size % 8 <> 0 THEN p_size / 2.0::DOUBLE END AS current_ss, CASE WHEN p_size % 10 <> 0 THEN (p_size * 7 % 20)::DOUBLE END AS recommended_ss,
  CASE WHEN p_size % 4 > 0 THEN (p_partkey % 40)::DOUBLE END AS usage FROM part)"""
CHANGED = RECS + """, changed AS (SELECT *, CASE WHEN status <> 'NOT_EVALUABLE' THEN unit_price * (current_rop - recommended_rop) END AS value_change FROM recs)"""
RISK = "CASE WHEN status IN ('READY_FOR_REVIEW', 'PENDING_APPROVAL', 'HELD', 'RETURNED') THEN CASE WHEN criticality = 'CRITICAL' THEN 'High' ELSE 'Medium' END ELSE 'Low' END"


def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as RECS."""
    size, key = c("p_size"), c("p_partkey")
    pick = lambda names, n: F.try_element_at(F.array(*map(F.lit, names)), (size % n + 1).cast("int"))
    return read_table(spark, sf_dir, "part").select(
        key.alias("material"),
        (key % 5).alias("plant"),
        c("p_name").alias("description"),
        pick(STATUSES, 6).alias("status"),
        pick(TIERS, 5).alias("criticality"),
        c("p_type").alias("circuit"),
        c("p_brand").alias("demand_class"),
        (size % 3 == 0).alias("is_oar"),
        F.when(size % 11 != 0, c("p_retailprice") - 950).alias("unit_price"),
        pick(["ZAR", "USD", "EUR"], 4).alias("currency"),
        F.when(size % 7 != 0, size.cast("double")).alias("current_rop"),
        F.when(size % 9 != 0, (size * 3 % 50).cast("double")).alias("recommended_rop"),
        F.when(size % 8 != 0, size / 2.0).alias("current_ss"),
        F.when(size % 10 != 0, (size * 7 % 20).cast("double")).alias("recommended_ss"),
        F.when(size % 4 > 0, (key % 40).cast("double")).alias("usage"),
    )


#: Storage locations: a supplier's line of a part at a plant; some without a quantity, some inactive.
STOCK = """stock AS (SELECT l_partkey AS material, l_partkey % 5 AS plant, CASE WHEN l_linenumber % 7 <> 0 OR l_quantity < 40 THEN l_quantity END AS quantity, l_linestatus = 'F' AS is_active, l_discount, l_tax, l_returnflag FROM lineitem WHERE l_suppkey % 3 = 0)"""


def stock_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem").where("l_suppkey % 3 = 0")
    quantity = F.when((c("l_linenumber") % 7 != 0) | (c("l_quantity") < 40), c("l_quantity"))
    return lines.select(c("l_partkey").alias("material"), (c("l_partkey") % 5).alias("plant"), quantity.alias("quantity"), (c("l_linestatus") == "F").alias("is_active"), "l_discount", "l_tax", "l_returnflag")


# ---- scope


@queries.add("SELECT s_suppkey, trim(p) IN ('1', '3') AND p IS NOT NULL AS served, p IS NULL OR trim(p) = '' OR trim(p) IN ('1', '3') AS passed FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 11 = 0 THEN NULL WHEN s_suppkey % 7 = 0 THEN '  ' ELSE ' ' || (s_suppkey % 5) || ' ' END AS p FROM supplier)".replace("trim(p) IN ('1', '3') AND p IS NOT NULL AS served", "coalesce(trim(p) IN ('1', '3'), false) AS served"))
def plant_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = c("s_suppkey")
    plant = F.when(key % 11 == 0, None).when(key % 7 == 0, "  ").otherwise(F.concat(F.lit(" "), (key % 5).cast("string"), F.lit(" ")))
    return read_table(spark, sf_dir, "supplier").select(key, scope.in_plants(plant, ["1", "3"]).alias("served"), scope.in_plants_or_malformed(plant, ["1", "3"]).alias("passed"))


@queries.add("SELECT p_partkey, CASE WHEN p_size % 4 IN (0, 1) THEN 'OAR' ELSE 'EXCLUDED' END AS scope FROM part")
def material_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(c("p_size") % 4 == 0, " nd").when(c("p_size") % 4 == 1, "PD ").when(c("p_size") % 4 == 2, "VB")
    return read_table(spark, sf_dir, "part").select("p_partkey", scope.material_scope(kind, ["ND", "PD"]).alias("scope"))


DELETED = """plants AS (SELECT DISTINCT l_partkey AS material, l_suppkey AS plant, CASE WHEN (l_partkey + l_suppkey) % 9 = 0 THEN ' x' END AS flag FROM lineitem), materials AS (SELECT p_partkey AS material, CASE WHEN p_size % 6 = 0 THEN 'X' ELSE '' END AS flag FROM part WHERE p_size < 45 UNION ALL SELECT p_partkey, 'X' FROM part WHERE p_size % 12 = 0)"""


@queries.add(f"WITH {DELETED} SELECT material, plant, coalesce(upper(trim(flag)) = 'X', false) OR material IN (SELECT material FROM materials WHERE upper(flag) = 'X') AS deleted FROM plants")
def deleted_material_plants(spark: SparkSession, sf_dir: str) -> DataFrame:
    plants = read_table(spark, sf_dir, "lineitem").select(c("l_partkey").alias("material"), c("l_suppkey").alias("plant")).distinct().withColumn("flag", F.when((c("material") + c("plant")) % 9 == 0, " x"))
    part = read_table(spark, sf_dir, "part").select(c("p_partkey").alias("material"), "p_size")
    materials = part.where("p_size < 45").select("material", F.when(c("p_size") % 6 == 0, "X").otherwise("").alias("flag")).unionByName(part.where("p_size % 12 = 0").select("material", F.lit("X").alias("flag")))
    return scope.with_deletion(plants, materials).select("material", "plant", "deleted")


@queries.add("""WITH u AS (SELECT DISTINCT l_partkey AS material, l_partkey % 5 AS plant FROM lineitem), p AS (SELECT p_partkey AS material, p_partkey % 5 AS plant, p_size AS lead_days, CASE WHEN p_size % 3 > 0 THEN p_size % 3 = 1 AND p_size > 30 END AS deleted FROM part WHERE p_size < 40), m AS (SELECT p_partkey AS material, p_brand AS brand, p_size % 13 = 0 AS deleted FROM part WHERE p_size > 5)
  SELECT u.material, u.plant, p.lead_days, m.brand FROM u LEFT JOIN p ON p.material = u.material AND p.plant = u.plant LEFT JOIN m ON m.material = u.material WHERE NOT coalesce(p.deleted, false) AND NOT coalesce(m.deleted, false)""")
def universe_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    universe = read_table(spark, sf_dir, "lineitem").select(c("l_partkey").alias("material"), (c("l_partkey") % 5).alias("plant")).distinct()
    part, size = read_table(spark, sf_dir, "part"), c("p_size")
    plants = part.where("p_size < 40").select(c("p_partkey").alias("material"), (c("p_partkey") % 5).alias("plant"), size.alias("lead_days"), F.when(size % 3 > 0, (size % 3 == 1) & (size > 30)).alias("deleted"))
    materials = part.where("p_size > 5").select(c("p_partkey").alias("material"), c("p_brand").alias("brand"), (size % 13 == 0).alias("deleted"))
    return scope.attributes(universe, plants, materials)


@queries.add("SELECT l_partkey AS material, coalesce(max(CASE WHEN l_returnflag = 'A' THEN l_linestatus || l_linenumber END), max(l_linestatus || l_linenumber)) AS description FROM lineitem GROUP BY 1")
def preferred_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = read_table(spark, sf_dir, "lineitem").select(c("l_partkey").alias("material"), c("l_returnflag").alias("language"), F.concat("l_linestatus", c("l_linenumber").cast("string")).alias("description"))
    return scope.preferred_text(texts, "material", "language", "description", ["A", "E"])


@queries.add(f"""WITH {STOCK} SELECT material, plant, sum(quantity) AS unrestricted, sum(CASE WHEN l_returnflag = 'R' THEN quantity END) AS inspection, sum(CASE WHEN l_tax > 0.07 THEN 1.0::DOUBLE END) AS blocked, sum(CASE WHEN l_discount > 0.09 THEN 2.0::DOUBLE END) AS transfer,
  NULL::DOUBLE AS restricted, sum(0.0::DOUBLE) AS returns, count(*) AS locations FROM stock WHERE is_active GROUP BY ALL""")
def stock_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stock_rows(spark, sf_dir)
    parts = {"unrestricted": c("quantity"), "inspection": F.when(c("l_returnflag") == "R", c("quantity")), "blocked": F.when(c("l_tax") > 0.07, 1.0), "transfer": F.when(c("l_discount") > 0.09, 2.0), "restricted": F.lit(None).cast("double"), "returns": F.lit(0.0)}
    return scope.stock_position(rows.select("material", "plant", "is_active", *[x.alias(n) for n, x in parts.items()]))


@queries.add(f"""WITH {STOCK}, b AS (SELECT material, plant, CASE l_returnflag WHEN 'A' THEN 'NEW' WHEN 'R' THEN 'DAM' ELSE '' END AS condition, quantity FROM stock WHERE material % 2 = 0), v AS (SELECT material, plant, CASE WHEN is_active THEN 'SCRAP' ELSE 'USED' END AS condition, quantity FROM stock),
  x AS (SELECT 'BATCH' AS source, * FROM b WHERE condition <> '' AND quantity IS NOT NULL UNION ALL SELECT 'VALUATION', * FROM v WHERE quantity IS NOT NULL),
  g AS (SELECT material, plant, source, sum(CASE WHEN condition IN ('NEW', 'USED') THEN quantity ELSE 0 END) AS usable, sum(CASE WHEN condition = 'DAM' THEN quantity ELSE 0 END) AS damaged, count(DISTINCT condition) AS conditions FROM x GROUP BY ALL)
  SELECT material, plant, usable, damaged, conditions, source FROM g QUALIFY row_number() OVER (PARTITION BY material, plant ORDER BY source) = 1""")
def condition_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stock_rows(spark, sf_dir)
    flag = c("l_returnflag")
    batch = rows.where("material % 2 = 0").withColumn("condition", F.when(flag == "A", "New").when(flag == "R", " dam").otherwise(""))
    valued = rows.withColumn("condition", F.when(c("is_active"), "SCRAP").otherwise("USED"))
    return scope.condition_split([("BATCH", batch), ("VALUATION", valued)], ["NEW", "USED"], ["DAM"])


@queries.add("SELECT l_partkey AS material, l_suppkey AS plant, count(*) AS n FROM lineitem WHERE l_linenumber <> 3 AND l_returnflag <> 'R' GROUP BY ALL")
def usable_lead_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem")
    return scope.usable_lead_times(lines.select(c("l_partkey").alias("material"), c("l_suppkey").alias("plant"), F.when(c("l_linenumber") != 3, c("l_linenumber")).alias("lead_days"), (c("l_returnflag") == "R").alias("cancelled")))


@queries.add("SELECT l_orderkey AS po, l_linenumber AS item, min(CASE WHEN l_returnflag <> 'N' THEN l_shipdate::DATE END) AS first_date, count(CASE WHEN l_returnflag <> 'N' THEN 1 END) AS schedules FROM lineitem GROUP BY ALL")
def first_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("po"), c("l_linenumber").alias("item"), F.when(c("l_returnflag") != "N", c("l_shipdate").cast("date")).alias("day"))
    return scope.schedule(lines, ["po", "item"], "day")


@queries.add(f"WITH {MONTHLY} SELECT material, plant, greatest(coalesce(sum(issues - reversals) FILTER (month BETWEEN DATE '2000-01-01' AND DATE '{AS_OF}'), 0), 0)::BIGINT AS events FROM monthly GROUP BY ALL")
def trailing_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope.trailing_events(demand.monthly_consumption(moves(spark, sf_dir)), day_of(AS_OF), 12)


@queries.add(f"WITH {MOVES} SELECT max(day) AS anchor FROM moves WHERE NOT reversal")
def usage_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope.anchor(moves(spark, sf_dir))


@queries.add("SELECT l_orderkey AS change, l_linenumber AS field, o_orderdate::DATE AS day, o_custkey AS user FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' AND o_orderdate::DATE BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'")
def change_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers = read_table(spark, sf_dir, "orders").select(c("o_orderkey").alias("change"), c("o_orderpriority").alias("object_class"), c("o_orderdate").cast("date").alias("day"), c("o_custkey").alias("user"))
    items = read_table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("change"), c("l_linenumber").alias("field"))
    return scope.header_changes(headers, items, "1-URGENT", "1997-01-01", "1998-12-31").select("change", "field", "day", "user")


RUNS = """res AS (SELECT l_partkey AS material, l_linenumber AS run, max(l_quantity) AS rate FROM lineitem GROUP BY ALL), wins AS (SELECT l_partkey AS material, l_shipdate::DATE AS window_end FROM lineitem WHERE l_returnflag = 'R')"""


@queries.add(f"WITH {RUNS} SELECT p_partkey AS material, rate, window_end FROM part LEFT JOIN res ON res.material = p_partkey AND run = 2 LEFT JOIN (SELECT material, max(window_end) AS window_end FROM wins GROUP BY 1) w ON w.material = p_partkey")
def pinned_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem")
    results = lines.groupBy(c("l_partkey").alias("material"), c("l_linenumber").alias("run")).agg(F.max("l_quantity").alias("rate"))
    windows = lines.where("l_returnflag = 'R'").select(c("l_partkey").alias("material"), c("l_shipdate").cast("date").alias("window_end"))
    wanted = read_table(spark, sf_dir, "part").select(c("p_partkey").alias("material"))
    return scope.with_last_window(scope.with_known_parameters(wanted, results, ["material"], 2), windows, ["material"])


@queries.add("SELECT p_partkey, CASE WHEN low = high THEN low END AS price FROM part LEFT JOIN (SELECT l_partkey, min(l_tax) AS low, max(l_tax) AS high FROM lineitem WHERE l_quantity > 46 GROUP BY 1) ON l_partkey = p_partkey")
def unique_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "lineitem").where("l_quantity > 46").select(c("l_partkey").alias("p_partkey"), c("l_tax").alias("price"))
    return scope.unique_lookup(read_table(spark, sf_dir, "part").select("p_partkey"), table, ["p_partkey"], "price")


# ---- reports


@queries.add(f"""WITH {CHANGED} SELECT material, status, criticality, value_change IS NULL AS unknown FROM changed WHERE status IN ('READY_FOR_REVIEW', 'HELD', 'APPROVED') AND plant IN (0, 1, 2, 3) AND (contains(lower(material::VARCHAR), 'e') OR contains(lower(description), 'e')) AND {RISK} = 'Medium'
  AND CASE criticality WHEN 'CRITICAL' THEN 'Critical' WHEN 'IMPACT' THEN 'High' WHEN 'INSURANCE' THEN 'Medium' ELSE 'Low' END = 'Low' AND unit_price >= 0 AND usage <= 35 AND NOT is_oar AND current_rop IS NOT NULL AND value_change > 0""")
def filter_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = portfolio.value_change(recommendations(spark, sf_dir))
    wanted = {"statuses": ["READY_FOR_REVIEW", "HELD", "APPROVED"], "plants": [0, 1, 2, 3], "search": "E", "risk_level": "Medium", "criticality_level": "Low", "price_from": 0, "usage_to": 35, "is_oar": False, "has_current": True, "value_change": "released", "circuit": None}
    return portfolio.filtered(rows, **wanted).select("material", "status", "criticality", c("value_change").isNull().alias("unknown"))


@queries.add(f"""WITH {RECS}, r AS (SELECT *, {RISK} AS risk FROM recs) SELECT 'total' AS facet, NULL AS value, count(*) AS n FROM r UNION ALL SELECT 'status', status, count(*) FROM r GROUP BY 2 UNION ALL SELECT 'criticality', criticality, count(*) FROM r GROUP BY 2
  UNION ALL SELECT 'circuit', circuit, count(*) FROM r GROUP BY 2 UNION ALL SELECT 'risk', risk, count(*) FROM r GROUP BY 2 UNION ALL SELECT 'plant', plant::VARCHAR, count(*) FROM r GROUP BY 2""")
def portfolio_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.summary(recommendations(spark, sf_dir))


@queries.add(f"WITH {RECS} SELECT round(sum(unit_price * (current_ss - recommended_ss)), 3) AS value, count(unit_price * (current_ss - recommended_ss)) AS priced, count(*) AS rows FROM recs")
def value_at_stake(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(portfolio.value_at_stake(recommendations(spark, sf_dir)), 3)


ON_HAND = "held AS (SELECT material, plant, CASE WHEN count(*) = count(quantity) THEN sum(quantity) END AS on_hand FROM stock GROUP BY ALL)"


@queries.add(f"""WITH {RECS}, {STOCK}, {ON_HAND}, b AS (SELECT recs.*, on_hand, CASE WHEN unit_price > 1 THEN unit_price * CASE currency WHEN 'ZAR' THEN 1.0 WHEN 'USD' THEN 18.0 WHEN 'EUR' THEN 20.0 END END AS worth, coalesce(on_hand >= 0 AND current_rop > 0, false) AS judged FROM recs LEFT JOIN held USING (material, plant))
  SELECT round(sum(on_hand * worth), 3) AS inventory_value, count(on_hand * worth) AS inventory_priced, round(sum(current_ss * worth), 3) AS safety_value, count(current_ss * worth) AS safety_priced, count(*) FILTER (judged AND on_hand < current_rop) AS below_reorder, count(*) FILTER (judged) AS judged FROM b""")
def inventory_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(portfolio.inventory_value(recommendations(spark, sf_dir), stock_rows(spark, sf_dir), RATES), 3)


@queries.add(f"""WITH {MOVES}, {RECS}, {STOCK}, {ON_HAND}, u AS (SELECT material, material % 5 AS plant, sum(qty) FILTER (day > DATE '{AS_OF}' - 90) AS used, max(day) AS last_issue FROM moves WHERE NOT reversal AND material % 5 < 4 GROUP BY ALL), l AS (SELECT p_partkey AS material, p_partkey % 5 AS plant, p_size::DOUBLE AS lead_days FROM part WHERE p_size % 6 > 0),
  f AS (SELECT u.*, on_hand, lead_days, coalesce(used > 0 AND on_hand >= 0 AND lead_days > 0, false) AS fine FROM u LEFT JOIN held USING (material, plant) LEFT JOIN l USING (material, plant) WHERE last_issue >= DATE '{AS_OF}' - 730)
  SELECT count(*) FILTER (fine AND on_hand < used / 90 * lead_days) AS at_risk, count(*) FILTER (fine) AS evaluated, count(*) - count(*) FILTER (fine) + (SELECT count(*) FROM recs WHERE plant NOT IN (SELECT plant FROM u)) AS insufficient FROM f""")
def stockout_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_of = day_of(AS_OF)
    issues = moves(spark, sf_dir).where("NOT reversal AND material % 5 < 4")
    usage = issues.groupBy("material", (c("material") % 5).alias("plant")).agg(F.sum(F.when(c("day") > F.date_sub(as_of, 90), c("qty"))).alias("used"), F.max("day").alias("last_issue"))
    lead = read_table(spark, sf_dir, "part").where("p_size % 6 > 0").select(c("p_partkey").alias("material"), (c("p_partkey") % 5).alias("plant"), c("p_size").cast("double").alias("lead_days"))
    return portfolio.stockout_counts(usage, stock_rows(spark, sf_dir), lead, recommendations(spark, sf_dir), as_of)


@queries.add(f"WITH {MOVES} SELECT date_trunc('month', day)::DATE AS month, count(DISTINCT (material, plant)) AS material_plants, count(DISTINCT doc) AS events FROM moves GROUP BY 1")
def distinct_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.distinct_by_month(moves(spark, sf_dir).withColumnRenamed("doc", "event"), "day")


@queries.add(f"WITH {MOVES} SELECT plant, date_trunc('month', day)::DATE AS month, count(*) AS movements, count(*) FILTER (NOT reversal) AS issues, count(*) FILTER (reversal) AS reversals, count(DISTINCT material) AS materials FROM moves GROUP BY ALL")
def source_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.source_activity(moves(spark, sf_dir))


@queries.add(f"""WITH {RECS}, v AS (SELECT is_oar, CASE WHEN usage IS NULL THEN 'UNKNOWN' WHEN usage > 4 THEN 'YES' ELSE 'NO' END AS verdict, coalesce(current_rop = recommended_rop, false) AS adopted FROM recs)
  SELECT count(*) FILTER (is_oar) AS on_demand, count(*) FILTER (is_oar AND verdict = 'YES') AS wanted, count(*) FILTER (is_oar AND verdict = 'NO') AS not_wanted, count(*) FILTER (is_oar AND verdict = 'UNKNOWN') AS unknown, count(*) FILTER (is_oar AND verdict = 'YES' AND adopted) AS converted FROM v""")
def conversion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = F.when(c("usage").isNull(), "UNKNOWN").when(c("usage") > 4, "YES").otherwise("NO")
    return portfolio.conversion_counts(recommendations(spark, sf_dir).select("is_oar", verdict.alias("verdict"), F.coalesce(c("current_rop") == c("recommended_rop"), F.lit(False)).alias("adopted")))


@queries.add(f"WITH {RECS} SELECT * FROM (SELECT 'review' AS stage, count(*) FILTER (status IN ('READY_FOR_REVIEW', 'RETURNED')) AS n FROM recs UNION ALL SELECT 'approval', count(*) FILTER (status IN ('PENDING_APPROVAL', 'HELD')) FROM recs UNION ALL SELECT 'done', count(*) FILTER (status = 'APPROVED') FROM recs UNION ALL SELECT 'in_sap', 0)")
def stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.stage_counts(recommendations(spark, sf_dir), {"review": ["READY_FOR_REVIEW", "RETURNED"], "approval": ["PENDING_APPROVAL", "HELD"], "done": ["APPROVED"], "in_sap": ["IN_SAP"]})


@queries.add(f"""WITH {RECS} SELECT round(avg(current_ss) FILTER (recommended_ss IS NOT NULL), 6) AS current_ss, round(avg(recommended_ss) FILTER (current_ss IS NOT NULL), 6) AS recommended_ss, round(avg(current_rop) FILTER (recommended_rop IS NOT NULL), 6) AS current_rop, round(avg(recommended_rop) FILTER (current_rop IS NOT NULL), 6) AS recommended_rop FROM recs""")
def stock_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(portfolio.stock_levels(recommendations(spark, sf_dir)))


@queries.add(f"""WITH {SERIES}, p AS (SELECT material, plant, (DATE '1999-01-01' + to_months(o::INTEGER))::DATE AS month, list_sum(q[1:o]) / o AS predicted, q[o + 1] AS actual FROM (SELECT *, unnest(range(3, len(q))) AS o FROM keyed)),
  g AS (SELECT month, sum(predicted) AS forecast, sum(actual) AS actual, count(*) AS keys, avg(abs(predicted - actual)) AS mae, sum(predicted - actual) / nullif(sum(actual), 0) AS bias FROM p GROUP BY 1)
  SELECT m.month, round(forecast, 3) AS forecast, round(actual, 3) AS actual, coalesce(keys, 0) AS keys, round(mae, 3) AS mae, round(bias, 3) AS bias FROM (SELECT unnest(generate_series(DATE '1999-01-01', DATE '2000-12-01', INTERVAL 1 MONTH))::DATE AS month) m LEFT JOIN g USING (month)""")
def forecast_actual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of all months so far against the next month, month by month."""
    origins = demand.rolling_origins(keyed(spark, sf_dir), HORIZON)
    mean = F.aggregate("q", F.lit(0.0), lambda s, x: s + x) / F.size("q")
    paths = demand.forecast_paths(origins.withColumn("rate", mean), "MEAN").withColumn("month", F.add_months(day_of("1999-01-01"), c("origin") + c("step")))
    return rounded(portfolio.forecast_against_actual(paths, "1999-01-01", "2000-12-01"), 3)


@queries.add("""WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS f FROM orders GROUP BY 1), old AS (SELECT month, '{"n":' || n || '}' AS payload FROM m WHERE month < DATE '1998-01-01'), fresh AS (SELECT month, '{"n":' || CASE WHEN month(month) = 3 THEN n + 1 ELSE n END || '}' AS payload FROM m)
  SELECT month, payload, 1 AS revision FROM old UNION ALL SELECT f.month, f.payload, CASE WHEN o.month IS NULL THEN 1 ELSE 2 END FROM fresh f LEFT JOIN old o USING (month) WHERE o.payload IS DISTINCT FROM f.payload""")
def kpi_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured once, then with later figures for March, then the same again, which changes nothing."""
    m = read_table(spark, sf_dir, "orders").groupBy(F.trunc("o_orderdate", "month").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    old = m.where("month < '1998-01-01'").select("month", F.to_json(F.struct("n")).alias("payload"))
    fresh = m.select("month", F.to_json(F.struct(F.when(F.month("month") == 3, c("n") + 1).otherwise(c("n")).alias("n"))).alias("payload"))
    first = portfolio.capture(old.limit(0).withColumn("revision", F.lit(0)), old)
    return portfolio.capture(portfolio.capture(first, fresh), fresh)


@queries.add(f"""WITH {CHANGED}, o AS (SELECT material, round(value_change, 6) AS value_change, row_number() OVER (ORDER BY CASE WHEN value_change > 0 THEN 0 WHEN value_change < 0 THEN 1 WHEN value_change = 0 THEN 2 ELSE 3 END, abs(value_change) DESC NULLS LAST, material) AS k FROM changed)
  SELECT material, value_change, (SELECT count(*) FROM recs) AS total FROM o WHERE k BETWEEN 41 AND 90""")
def value_change_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of a report ordered by value change, with the number of all rows."""
    rows = portfolio.value_change(recommendations(spark, sf_dir)).select("material", "value_change")
    return rounded(portfolio.page_and_total(rows, [*portfolio.value_order(), c("material").asc()], 50, 40))


@queries.add("""WITH w AS (SELECT l_partkey AS k, count(*) AS w FROM lineitem GROUP BY 1), r AS (SELECT *, (sum(w) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) - w) // 500 AS range FROM w) SELECT min(k) AS low, max(k) AS high, count(*) AS keys, sum(w)::BIGINT AS weight FROM r GROUP BY range""")
def key_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = read_table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("w"))
    return portfolio.key_ranges(weights, "l_partkey", "w", 500)
