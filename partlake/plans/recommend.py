"""Routing, recommendations, prices, repairs, identity and blend queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partlake.operators import blend, identity, ledger, recommend, similarity
from partlake.plans.planning import keyed
from partlake.plans.registry import AS_OF, MOVES, SERIES, Registry, day_of, moves, rounded
from partlake.session import read_table

queries = Registry()
c = F.col
CLASSES = ["SMOOTH", "ERRATIC", "LUMPY", "INTERMITTENT", "UNCLASSIFIED"]

#: What routing needs of each part; calculated levels stand in for the stock formulas, which have queries of their own.
ROUTED = f"""r0 AS (SELECT p_partkey AS material, p_partkey % 5 AS plant, p_size % 4 = 0 AS is_oar, {CLASSES}[p_partkey % 5 + 1] AS demand_class, CASE WHEN p_size % 17 = 0 THEN 'OBSOLETE' WHEN p_size % 2 = 0 THEN 'CRITICAL' END AS criticality,
  CASE WHEN p_size % 13 > 0 THEN p_size::DOUBLE END AS lead_days, CASE WHEN p_size % 19 > 0 THEN 1.645::DOUBLE END AS z, CASE WHEN p_size % 11 > 0 THEN p_size / 4.0::DOUBLE END AS rate, CASE WHEN p_size % 5 > 0 THEN p_size / 8.0::DOUBLE END AS calc_ss, p_size / 3.0::DOUBLE AS calc_rop, p_size * 1.5::DOUBLE AS calc_max_stock,
  CASE WHEN p_size % 3 = 0 THEN p_size::BIGINT END AS current_ss, CASE WHEN p_size % 3 = 1 THEN p_size::BIGINT + 1 END AS current_rop, CASE WHEN p_size % 6 = 2 THEN p_size::BIGINT * 2 END AS current_max_stock FROM part),
  r1 AS (SELECT *, CASE WHEN is_oar THEN 'DEFERRED_TO_OAR' WHEN demand_class = 'UNCLASSIFIED' THEN 'NOT_EVALUABLE_NO_HISTORY' WHEN criticality = 'OBSOLETE' THEN 'NOT_APPLICABLE_OBSOLETE' WHEN lead_days IS NULL THEN 'NOT_EVALUABLE_LEAD_TIME' WHEN z IS NULL THEN 'NOT_EVALUABLE_SERVICE_LEVEL_UNSET' END AS blocked,
  demand_class IN ('SMOOTH', 'ERRATIC') AND NOT is_oar AND coalesce(criticality <> 'OBSOLETE', true) AS stands FROM r0),
  r2 AS (SELECT *, CASE WHEN stands AND current_ss IS NOT NULL THEN 'SUCCESS_FROM_CURRENT_VALUE' WHEN blocked IS NOT NULL THEN blocked WHEN calc_ss IS NULL THEN 'NOT_EVALUABLE_INPUT' ELSE 'SUCCESS' END AS ss_status,
  CASE WHEN stands AND current_rop IS NOT NULL THEN 'SUCCESS_FROM_CURRENT_VALUE' WHEN blocked IS NOT NULL THEN blocked WHEN rate IS NULL THEN 'NOT_EVALUABLE_INVALID_FORECAST' ELSE 'SUCCESS' END AS rop_status,
  CASE WHEN stands AND current_max_stock IS NOT NULL THEN 'SUCCESS_FROM_CURRENT_VALUE' WHEN blocked IS NOT NULL THEN blocked WHEN rate IS NULL THEN 'NOT_EVALUABLE_INVALID_FORECAST' ELSE 'SUCCESS' END AS max_stock_status FROM r1),
  routed AS (SELECT *, CASE ss_status WHEN 'SUCCESS_FROM_CURRENT_VALUE' THEN current_ss WHEN 'SUCCESS' THEN ceil(calc_ss)::BIGINT END AS ss, CASE rop_status WHEN 'SUCCESS_FROM_CURRENT_VALUE' THEN current_rop WHEN 'SUCCESS' THEN ceil(calc_rop)::BIGINT END AS rop,
  CASE max_stock_status WHEN 'SUCCESS_FROM_CURRENT_VALUE' THEN current_max_stock WHEN 'SUCCESS' THEN ceil(calc_max_stock)::BIGINT END AS max_stock FROM r2)"""


def inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as r0 of ROUTED."""
    size, key = c("p_size"), c("p_partkey")
    number = lambda test, x, kind="double": F.when(test, x.cast(kind))
    return read_table(spark, sf_dir, "part").select(
        key.alias("material"),
        (key % 5).alias("plant"),
        (size % 4 == 0).alias("is_oar"),
        F.element_at(F.array(*map(F.lit, CLASSES)), (key % 5 + 1).cast("int")).alias("demand_class"),
        F.when(size % 17 == 0, "OBSOLETE").when(size % 2 == 0, "CRITICAL").alias("criticality"),
        number(size % 13 > 0, size).alias("lead_days"),
        F.when(size % 19 > 0, 1.645).alias("z"),
        number(size % 11 > 0, size / 4.0).alias("rate"),
        number(size % 5 > 0, size / 8.0).alias("calc_ss"),
        (size / 3.0).alias("calc_rop"),
        (size * 1.5).alias("calc_max_stock"),
        number(size % 3 == 0, size, "long").alias("current_ss"),
        number(size % 3 == 1, size + 1, "long").alias("current_rop"),
        number(size % 6 == 2, size * 2, "long").alias("current_max_stock"),
    )


@queries.add(f"WITH {ROUTED} SELECT material, plant, ss_status, rop_status, max_stock_status, ss, rop, max_stock FROM routed")
def formula_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend.route(inputs(spark, sf_dir)).select("material", "plant", "ss_status", "rop_status", "max_stock_status", "ss", "rop", "max_stock")


@queries.add(f"""WITH {ROUTED}, e AS (SELECT p_partkey AS material, p_partkey % 5 AS plant, p_size::BIGINT AS est_ss, p_size::BIGINT + 5 AS est_rop, p_size::BIGINT + 9 AS est_max FROM part WHERE p_size % 8 > 0), gone AS (SELECT p_partkey AS material FROM part WHERE p_size = 7),
  b AS (SELECT r.material, r.plant, is_oar, current_ss, current_rop, current_max_stock, CASE WHEN is_oar THEN est_ss ELSE ss END AS ss, CASE WHEN is_oar THEN est_rop ELSE rop END AS rop, CASE WHEN is_oar THEN greatest(est_max, est_rop + est_ss) ELSE max_stock END AS max_stock FROM routed r LEFT JOIN e USING (material, plant) WHERE r.material NOT IN (SELECT material FROM gone))
  SELECT material, plant, ss, rop, max_stock, rop - current_rop AS delta_rop, round((rop - current_rop) * 100.0 / nullif(current_rop, 0), 6)::DOUBLE AS pct_rop, CASE WHEN is_oar THEN 'OAR' ELSE 'NORMAL' END AS circuit_of, CASE WHEN coalesce(ss, rop, max_stock) IS NOT NULL THEN 'READY_FOR_REVIEW' ELSE 'NOT_EVALUABLE' END AS status,
  CASE WHEN coalesce(ss, rop, max_stock) IS NULL THEN 'NOT_EVALUABLE_MISSING_RECOMMENDED' WHEN coalesce(current_ss, current_rop, current_max_stock) IS NULL THEN 'NOT_EVALUABLE_MISSING_CURRENT' ELSE 'AVAILABLE' END AS impact FROM b""")
def recommendation_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, size = read_table(spark, sf_dir, "part"), c("p_size").cast("long")
    estimates = part.where("p_size % 8 > 0").select(c("p_partkey").alias("material"), (c("p_partkey") % 5).alias("plant"), size.alias("est_ss"), (size + 5).alias("est_rop"), (size + 9).alias("est_max_stock"), F.lit("HIGH").alias("confidence"))
    gone = part.where("p_size = 7").select(c("p_partkey").alias("material"), (c("p_partkey") % 5).alias("plant"))
    out = recommend.assemble(recommend.route(inputs(spark, sf_dir)), estimates, gone)
    return rounded(out.select("material", "plant", "ss", "rop", "max_stock", "delta_rop", "pct_rop", "circuit_of", "status", "impact"))


@queries.add("""WITH v AS (SELECT l_partkey AS material, l_suppkey % 4 AS plant, CASE WHEN l_partkey % 3 > 0 THEN CASE l_returnflag WHEN 'A' THEN 'NEW' WHEN 'R' THEN 'USED' ELSE '' END ELSE '' END AS kind, CASE WHEN l_linenumber % 5 > 0 THEN l_tax * 25 END AS price FROM lineitem WHERE l_quantity > 30),
  g AS (SELECT material, plant, max(kind <> '') AS split, max(price) FILTER (kind = 'NEW') AS new, max(price) AS any_ FROM v GROUP BY ALL), w AS (SELECT *, CASE WHEN split THEN new ELSE any_ END AS value FROM g)
  SELECT material, plant, CASE WHEN value > 1 THEN value END AS price, value, CASE WHEN value IS NULL THEN CASE WHEN split THEN 'NO_NEW_VALUATION' ELSE 'NOT_VALUED' END WHEN value <= 1 THEN 'TOKEN_VALUE' END AS missing FROM w""")
def new_item_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = c("l_returnflag")
    kind = F.when(c("l_partkey") % 3 > 0, F.when(flag == "A", " new").when(flag == "R", "USED").otherwise("")).otherwise("  ")
    lines = read_table(spark, sf_dir, "lineitem").where("l_quantity > 30")
    return recommend.new_item_price(lines.select(c("l_partkey").alias("material"), (c("l_suppkey") % 4).alias("plant"), kind.alias("kind"), F.when(c("l_linenumber") % 5 > 0, c("l_tax") * 25).alias("price")))


@queries.add(f"""WITH u AS (SELECT p_partkey AS material, p_partkey % 5 AS plant, CASE WHEN p_size % 5 > 0 THEN (p_size % 7)::DOUBLE END AS stock, CASE WHEN p_size % 3 = 0 THEN (p_size % 2)::DOUBLE END AS usable, 1 AS locations FROM part),
  l AS (SELECT l_partkey AS material, count(*) AS open_lines, sum(l_quantity) AS under_repair, min(l_shipdate::DATE) AS soonest_due, count(*) FILTER (l_shipdate::DATE < DATE '{AS_OF}') AS overdue FROM lineitem WHERE l_returnflag = 'R' AND l_partkey % 3 = 0 GROUP BY 1),
  q AS (SELECT l_partkey AS material, count(*) AS requests, min(l_shipdate::DATE) AS oldest_request FROM lineitem WHERE l_returnflag = 'A' AND l_partkey % 4 = 0 GROUP BY 1),
  b AS (SELECT u.*, open_lines, under_repair, soonest_due, overdue, requests, oldest_request, array_to_string(list_filter([CASE WHEN coalesce(usable, stock) > 0 THEN 'STOCK' END, CASE WHEN open_lines > 0 THEN 'ON_REPAIR_ORDER' END, CASE WHEN requests > 0 THEN 'REPAIR_REQUESTED' END], lambda x: x IS NOT NULL), '+') AS sources FROM u LEFT JOIN l USING (material) LEFT JOIN q USING (material))
  SELECT material, plant, stock, usable, locations, coalesce(open_lines, 0) AS open_lines, coalesce(under_repair, 0) AS under_repair, soonest_due, coalesce(overdue, 0) AS overdue, coalesce(requests, 0) AS requests, oldest_request, sources <> '' AS exists, sources FROM b""")
def repairable_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, lines = c("p_size"), read_table(spark, sf_dir, "lineitem")
    universe = read_table(spark, sf_dir, "part").select(c("p_partkey").alias("material"), (c("p_partkey") % 5).alias("plant"), F.when(size % 5 > 0, (size % 7).cast("double")).alias("stock"), F.when(size % 3 == 0, (size % 2).cast("double")).alias("usable"), F.lit(1).alias("locations"))
    one = lambda flag, n, day: lines.where((c("l_returnflag") == flag) & (c("l_partkey") % n == 0)).select(c("l_partkey").alias("material"), (c("l_partkey") % 5).alias("plant"), c("l_quantity").alias("qty"), c("l_shipdate").cast("date").alias(day))
    return recommend.repairable(universe, one("R", 3, "due"), one("A", 4, "requested_on"), day_of(AS_OF))


@queries.add(f"""WITH k AS (SELECT p_partkey AS material, p_size % 9 = 0 AS corroborated, {recommend.VERDICTS}[p_size % 5 + 1] AS verdict, CASE WHEN p_size % 4 > 0 THEN p_size % 4 END AS sure, p_size % 6 AS lines, p_size % 5 AS v FROM part)
  SELECT material, row_number() OVER (ORDER BY corroborated DESC, v, coalesce(sure, 0) DESC, lines DESC, material)::INTEGER AS rank FROM k""")
def candidate_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = c("p_size")
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), n.cast("int"))
    rows = read_table(spark, sf_dir, "part").select(c("p_partkey").alias("material"), (size % 9 == 0).alias("corroborated"), pick(recommend.VERDICTS, size % 5 + 1).alias("verdict"), F.when(size % 4 > 0, pick(recommend.CONFIDENCE, F.greatest(size % 4, F.lit(1)))).alias("confidence"), (size % 6).alias("lines"))
    return recommend.ranked_candidates(rows).select("material", "rank")


@queries.add("""WITH g AS (SELECT l_orderkey AS po, l_linenumber AS item, sum(l_quantity) AS ordered, coalesce(sum(l_quantity) FILTER (l_linestatus = 'F'), 0) AS got, coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0) AS issued FROM lineitem GROUP BY ALL),
  s AS (SELECT *, got - CASE WHEN item % 4 = 0 THEN 10 ELSE 0 END AS received, CASE WHEN po % 9 = 0 THEN 'CLOSED' END AS state FROM g)
  SELECT po, item, CASE WHEN state IS NOT NULL AND received < ordered THEN state WHEN received <= 0 THEN 'OPEN' WHEN received < ordered THEN 'PARTIALLY_RECEIVED' ELSE 'RECEIVED' END AS procurement, CASE WHEN po % 50 = 0 THEN 'BEFORE_ISSUE_HISTORY' WHEN issued <= 0 THEN 'NOT_ISSUED' WHEN issued < received THEN 'PARTIALLY_ISSUED' ELSE 'FULLY_ISSUED' END AS utilisation FROM s""")
def line_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = c("l_quantity")
    s = read_table(spark, sf_dir, "lineitem").groupBy(c("l_orderkey").alias("po"), c("l_linenumber").alias("item")).agg(F.sum(q).alias("ordered"), F.coalesce(F.sum(F.when(c("l_linestatus") == "F", q)), F.lit(0.0)).alias("received"), F.coalesce(F.sum(F.when(c("l_returnflag") == "R", q)), F.lit(0.0)).alias("issued"))
    received = c("received") - F.when(c("item") % 4 == 0, 10).otherwise(0)
    return s.select("po", "item", recommend.procurement_status(received, c("ordered"), F.when(c("po") % 9 == 0, "CLOSED")).alias("procurement"), recommend.utilisation_status(c("issued"), received, c("po") % 50 == 0).alias("utilisation"))


@queries.add(f"""WITH {MOVES}, r AS (SELECT material, plant, max(day) AS last_movement_date, max(day) FILTER (NOT reversal) AS last_issue_date, min(day) FILTER (reversal) AS receipt_date, coalesce(sum(qty) FILTER (reversal), 0) - 20 AS outstanding FROM moves GROUP BY ALL), d AS (SELECT *, DATE '{AS_OF}' - last_movement_date AS m, DATE '{AS_OF}' - last_issue_date AS i, DATE '{AS_OF}' - receipt_date AS g FROM r)
  SELECT material, plant, m::INTEGER AS days_since_movement, i::INTEGER AS days_since_issue, g::INTEGER AS receipt_days, CASE WHEN i <= 90 THEN 'FAST' WHEN i <= 365 THEN 'SLOW' ELSE 'NON_MOVING' END AS band, coalesce(outstanding > 0 AND g >= 30, false) AS receipt_flag FROM d""")
def forward_aged(spark: SparkSession, sf_dir: str) -> DataFrame:
    day, rev = c("day"), c("reversal")
    rows = moves(spark, sf_dir).groupBy("material", "plant").agg(F.max(day).alias("last_movement_date"), F.max(F.when(~rev, day)).alias("last_issue_date"), F.min(F.when(rev, day)).alias("receipt_date"), (F.coalesce(F.sum(F.when(rev, c("qty"))), F.lit(0.0)) - 20).alias("outstanding"))
    return recommend.aged(rows, day_of(AS_OF)).select("material", "plant", "days_since_movement", "days_since_issue", "receipt_days", "band", "receipt_flag")


@queries.add(f"""WITH l AS (SELECT l_returnflag AS status, l_quantity AS qty, l_shipdate::DATE + 30 < DATE '{AS_OF}' AS overdue, CASE WHEN l_linenumber % 3 > 0 THEN DATE '{AS_OF}' - l_shipdate::DATE END AS age FROM lineitem)
  SELECT status, count(*) AS lines, sum(qty) AS units, count(*) FILTER (overdue) AS overdue, median(age)::DOUBLE AS median_age, count(*) FILTER (age IS NULL) AS undated FROM l GROUP BY 1""")
def register_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = c("l_shipdate").cast("date")
    lines = read_table(spark, sf_dir, "lineitem").select(c("l_returnflag").alias("status"), c("l_quantity").alias("qty"), (F.date_add(day, 30) < day_of(AS_OF)).alias("overdue"), F.when(c("l_linenumber") % 3 > 0, F.datediff(day_of(AS_OF), day)).alias("age"))
    return recommend.register_statistics(lines)


# ---- identity


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with a description made of their name, component words and numbers."""
    words = ["Spray nozzles", "FILTER PRESS seals", "proximity switch", "gear box", "bearing 6310-2RS", "Spare part assy", "sensor M12x1.5", "pump 55KW"]
    kind = F.element_at(F.array(*map(F.lit, words)), (c("p_size") % 8 + 1).cast("int"))
    number = F.when(c("p_partkey") % 3 == 0, F.concat(F.lit(" PN:AB-"), F.lpad((c("p_partkey") % 40).cast("string"), 5, "0"))).otherwise("")
    return read_table(spark, sf_dir, "part").select(c("p_partkey").alias("id"), c("p_type").alias("group"), "p_brand", F.concat("p_name", F.lit(" "), kind, number).alias("text"))


@queries.add()
def identity_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each description says. Its patterns look around themselves, which DuckDB's cannot; tested against plain Python."""
    rows = identity.with_profile(described(spark, sf_dir), "text", "")
    return rows.select("id", *[F.array_join(F.array_sort(x), " ").alias(x) for x in ("types", "numbers", "distinctive", "generic")])


@queries.add()
def identity_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that share a part number or a specific word, with the verdict on them: candidates come by an inverted index of
    both, one pair once. Tested against plain Python."""
    rows = identity.with_profile(described(spark, sf_dir), "text", "")
    # equal descriptions have one profile: pairs are between different ones of a brand
    distinct = rows.groupBy("p_brand", "text").agg(F.min("id").alias("id"), F.min("group").alias("group"), *[F.first(x).alias(x) for x in ("words", "types", "numbers", "distinctive", "generic")])
    tokens = distinct.select("p_brand", "id", F.explode(F.array_union("numbers", "types")).alias("token"))
    met = tokens.withColumnRenamed("id", "t_id").join(tokens.withColumnRenamed("id", "d_id"), ["p_brand", "token"]).where("t_id < d_id").select("t_id", "d_id").distinct()
    side = lambda p: distinct.select(*[c(x).alias(f"{p}_{x}") for x in ("id", "group", "words", "types", "numbers", "distinctive", "generic")])
    pairs = met.join(side("t"), "t_id").join(side("d"), "d_id")
    return pairs.select("t_id", "d_id", identity.verdict(c("t_group") == c("d_group"), F.lit(None).cast("double")).alias("verdict"))


# ---- blend


@queries.add(f"""WITH {MOVES}, s AS (SELECT material, plant, qty FROM moves WHERE NOT reversal AND qty > 0) SELECT material, plant, round(quantile_cont(qty, 0.9), 6) AS issue_floor, count(*) AS issues FROM s GROUP BY ALL""")
def issue_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(blend.issue_floor(moves(spark, sf_dir).where("NOT reversal"), ["material", "plant"]))


PEERS = """peers AS (SELECT k.material, k.plant, 0.55 + (k.material % 9) * 0.05 AS similarity, CASE WHEN d.p_size % 7 > 0 THEN d.p_size * 4.0 END AS annual, d.p_size * 1.0 AS rop, d.p_size / 2.0 AS ss, d.p_size * 2.0 + 1 AS max_stock, CASE WHEN d.p_size % 4 > 0 THEN d.p_size * 1.0 END AS lead_days
  FROM keys k JOIN part t ON t.p_partkey = k.material JOIN part d ON d.p_partkey // 8 = t.p_partkey // 8 AND d.p_partkey <> t.p_partkey)"""


@queries.add(f"""WITH {SERIES}, keys AS (SELECT material, plant FROM keyed), {PEERS}, w AS (SELECT *, pow(greatest(similarity - 0.5, 0), 3) AS w, annual > 0 AND rop > 0 AS fine FROM peers)
  SELECT material, plant, count(*) FILTER (fine) AS used_peers, round(sum(w * rop / (annual / 12)) FILTER (fine) / sum(w) FILTER (fine), 6) AS r_rop, round(sum(w * ss / (annual / 12)) FILTER (fine) / sum(w) FILTER (fine), 6) AS r_ss, round(sum(w * max_stock / rop) FILTER (fine) / sum(w) FILTER (fine), 6) AS r_max,
  round(pow(sum(w * similarity) FILTER (fine) / sum(w) FILTER (fine), 2), 6) AS quality, round(sum(w * lead_days) FILTER (lead_days > 0) / sum(w) FILTER (lead_days > 0), 6) AS peer_lead_days FROM w GROUP BY ALL""")
def peer_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(blend.peer_ratios(peers(spark, sf_dir), ["material", "plant"]))


def peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours by number stand in for the similar materials, which have queries of their own."""
    part, size = read_table(spark, sf_dir, "part"), c("p_size")
    d = part.select(c("p_partkey").alias("d_id"), F.floor(c("p_partkey") / 8).alias("b"), F.when(size % 7 > 0, size * 4.0).alias("annual"), (size * 1.0).alias("rop"), (size / 2.0).alias("ss"), (size * 2.0 + 1).alias("max_stock"), F.when(size % 4 > 0, size * 1.0).alias("lead_days"))
    keys = keyed(spark, sf_dir).select("material", "plant", F.floor(c("material") / 8).alias("b"))
    met = keys.join(part.select(c("p_partkey").alias("material")), "material").join(d, "b").where("d_id <> material")
    return met.select("material", "plant", (0.55 + (c("material") % 9) * 0.05).alias("similarity"), "annual", "rop", "ss", "max_stock", "lead_days")


@queries.add()
def credibility_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of every series from its own bootstrap and its peers' ratios. Drawn by a seeded generator; tested against plain
    Python with the same draws."""
    key = ["material", "plant"]
    issues = ledger.cancel_equal(moves(spark, sf_dir))
    rows = keyed(spark, sf_dir).join(blend.peer_ratios(peers(spark, sf_dir), key), key, "left")
    rows = rows.join(blend.issue_floor(issues, key), key, "left").join(issues.groupBy(*key).agg(F.count(F.lit(1)).alias("events")), key, "left")
    rows = blend.with_lead_time(rows.withColumn("master_days", F.when(c("material") % 4 > 0, c("material") % 60)).withColumn("events", F.coalesce("events", F.lit(0))).withColumn("unit_price", (c("material") % 900).cast("double")))
    out = blend.blend(blend.own_estimates(rows, key), [(500.0, 4.0)])
    return rounded(out.select(*key, "status", "lead_source", "w_own", "rop", "ss", "max_stock", "guardrails"))


# ---- similarity: text dimension, manufacturer, eligibility, refusals


@queries.add("""WITH p AS (SELECT t.p_partkey AS t_id, d.p_partkey AS d_id, t.p_brand = d.p_brand AS kin, d.p_size AS n, CASE WHEN t.p_partkey = d.p_partkey THEN 'SAME_MATERIAL' WHEN d.p_size % 10 = 0 THEN 'INACTIVE' WHEN t.p_type <> d.p_type THEN 'OTHER_CRITICALITY' WHEN d.p_size < 12 THEN 'SHORT_HISTORY' WHEN t.p_partkey % 5 <> d.p_partkey % 5 THEN 'OTHER_PLANT' END AS reason FROM part t JOIN part d ON t.p_partkey // 40 = d.p_partkey // 40)
  SELECT t_id, coalesce(reason, 'ELIGIBLE') AS reason, count(*) AS n FROM p GROUP BY ALL""")
def eligibility_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, sf_dir, "part")
    side = lambda p: part.select(c("p_partkey").alias(f"{p}_id"), c("p_type").alias(f"{p}_partition"), (c("p_partkey") % 5).alias(f"{p}_plant"), (c("p_size") % 10 != 0).alias(f"{p}_active"), c("p_size").alias(f"{p}_history"), F.floor(c("p_partkey") / 40).alias("b"))
    pairs = side("t").join(side("d"), "b").withColumn("reason", similarity.eligibility(same_plant_required=True))
    return pairs.groupBy("t_id", F.coalesce("reason", F.lit("ELIGIBLE")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@queries.add("""WITH p AS (SELECT t.p_partkey AS t_id, d.p_partkey AS d_id, CASE WHEN d.p_size % 6 > 0 THEN abs(t.p_size - d.p_size) / 50.0 END AS cosine, CASE WHEN t.p_type = d.p_type THEN 0.75::DOUBLE END AS fuzzy, t.p_brand = d.p_brand AS kin, t.p_retailprice AS a, d.p_retailprice AS b FROM part t JOIN part d ON t.p_partkey // 40 = d.p_partkey // 40 AND t.p_partkey <> d.p_partkey),
  s AS (SELECT *, CASE WHEN cosine IS NOT NULL AND fuzzy IS NOT NULL THEN 0.6 * cosine + 0.4 * fuzzy ELSE coalesce(cosine, fuzzy) END AS text, (CASE WHEN kin THEN 1 ELSE 0 END + 1 - least(abs(ln(a) - ln(b)) / 0.5, 1)) / 2 AS business FROM p)
  SELECT t_id, d_id, round(text, 6) AS text, round(business, 6) AS business FROM s""")
def text_and_business(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, sf_dir, "part")
    side = lambda p: part.select(*[c(x).alias(f"{p}_{y}") for x, y in (("p_partkey", "id"), ("p_brand", "maker"), ("p_type", "type"), ("p_size", "size"), ("p_retailprice", "price"))], F.floor(c("p_partkey") / 40).alias("b"))
    pairs = side("t").join(side("d"), "b").where("t_id <> d_id")
    cosine, fuzzy = F.when(c("d_size") % 6 > 0, F.abs(c("t_size") - c("d_size")) / 50.0), F.when(c("t_type") == c("d_type"), 0.75)
    return rounded(pairs.select("t_id", "d_id", similarity.text_dimension(cosine, fuzzy).alias("text"), similarity.business(c("t_maker"), c("d_maker"), c("t_price"), c("d_price"), 0.5).alias("business")))


@queries.add("""WITH p AS (SELECT t.p_partkey AS t_id, d.p_partkey AS d_id, CASE WHEN d.p_size % 9 > 0 THEN (t.p_partkey * 7 + d.p_partkey * 13) % 100 / 100.0 END AS score, CASE WHEN d.p_size % 4 > 0 THEN 'CONFIRMED_TEXT' ELSE 'INSUFFICIENT_TEXT' END AS identity, d.p_size % 5 AS evidence FROM part t JOIN part d ON t.p_partkey // 40 = d.p_partkey // 40 AND t.p_partkey <> d.p_partkey),
  r AS (SELECT *, CASE WHEN score IS NULL THEN 'NO_DIMENSION' WHEN identity NOT LIKE 'CONFIRMED%' THEN identity WHEN evidence < 2 THEN 'TOO_LITTLE_EVIDENCE' WHEN score < 0.6 THEN 'BELOW_FLOOR' END AS reason FROM p)
  SELECT t_id, d_id, score::DOUBLE AS score, reason, rank FROM (SELECT *, row_number() OVER (PARTITION BY t_id ORDER BY score DESC NULLS LAST, d_id)::INTEGER AS rank FROM r WHERE reason IS NOT NULL) WHERE rank <= 10""")
def refused_donors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of ten refusals for each target, the best-scoring ones."""
    part = read_table(spark, sf_dir, "part")
    side = lambda p: part.select(c("p_partkey").alias(f"{p}_id"), c("p_size").alias(f"{p}_size"), F.floor(c("p_partkey") / 40).alias("b"))
    pairs = side("t").join(side("d"), "b").where("t_id <> d_id")
    score = F.when(c("d_size") % 9 > 0, (c("t_id") * 7 + c("d_id") * 13) % 100 / 100.0)
    scored = pairs.select("t_id", "d_id", score.alias("score"), F.when(c("d_size") % 4 > 0, "CONFIRMED_TEXT").otherwise("INSUFFICIENT_TEXT").alias("identity"), (c("d_size") % 5).alias("evidence"))
    return recommend.refusals(scored, 0.6).select("t_id", "d_id", "score", "reason", "rank")
