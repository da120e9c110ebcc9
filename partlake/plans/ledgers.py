"""Movement ledgers, document chains, status and matching queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partlake.functions import semantics
from partlake.operators import ledger, relational
from partlake.plans.registry import AS_OF, MOVES, Registry, day_of, moves, rounded
from partlake.session import read_table

queries = Registry()
KEY = ledger.KEY


@queries.add(f"""WITH {MOVES} SELECT material, plant, sum(CASE WHEN reversal THEN -qty ELSE qty END) AS net_quantity,
  greatest(count(*) FILTER (NOT reversal) - count(*) FILTER (reversal), 0) AS net_events, min(day) FILTER (NOT reversal) AS first_date, max(day) FILTER (NOT reversal) AS last_date FROM moves GROUP BY ALL""")
def net_movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.net(moves(spark, sf_dir))


CLAMPED = """events AS (SELECT material, plant, list(CASE WHEN reversal THEN -qty ELSE qty END ORDER BY day, reversal, qty) AS e FROM moves GROUP BY ALL)"""


@queries.add(f"""WITH {MOVES}, {CLAMPED} SELECT material, plant, list_reduce(list_prepend(0.0::DOUBLE, e), lambda t, x: CASE WHEN x < 0 THEN greatest(t + x, 0) ELSE t + x END) AS standing FROM events""")
def clamped_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.clamped_net(moves(spark, sf_dir))


STANDING = """o AS (SELECT *, row_number() OVER w AS n, sum(CASE WHEN reversal THEN -qty ELSE qty END) OVER (PARTITION BY material, plant ORDER BY day, reversal, doc, line, qty ROWS UNBOUNDED PRECEDING) AS s FROM moves WHERE day IS NOT NULL {until} WINDOW w AS (PARTITION BY material, plant ORDER BY day, reversal, doc, line, qty)),
  h AS (SELECT *, s - least(min(s) OVER (PARTITION BY material, plant ORDER BY n ROWS UNBOUNDED PRECEDING), 0) AS height FROM o),
  standing AS (SELECT * FROM (SELECT material, plant, day, doc, line, qty, reversal, greatest(0, least(qty, min(height) OVER (PARTITION BY material, plant ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - (height - qty)))::DOUBLE AS standing FROM h) WHERE NOT reversal)"""


@queries.add(f"WITH {MOVES}, {STANDING.format(until='')} SELECT material, plant, day, doc, line, qty, standing FROM standing")
def standing_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each issue with what later reversals left of it; tested against a stack in plain Python too."""
    return ledger.standing_events(moves(spark, sf_dir))


@queries.add(f"WITH {MOVES}, {STANDING.format(until='')} SELECT material, plant, date_trunc('month', day)::DATE AS month, sum(standing) AS quantity FROM standing GROUP BY ALL")
def standing_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.standing_by_month(ledger.standing_events(moves(spark, sf_dir)))


def stock_on_hand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moves(spark, sf_dir).groupBy(*KEY).agg((F.max("qty") - F.min("qty")).alias("stock"))


@queries.add(f"""WITH {MOVES}, {STANDING.format(until=f"AND day <= DATE '{AS_OF}'")}, l AS (SELECT material, plant, max(day) AS last_movement_date, max(qty) - min(qty) AS stock FROM moves GROUP BY ALL),
  i AS (SELECT material, plant, max(day) AS last_issue_date, count(*) FILTER (day >= DATE '{AS_OF}' - INTERVAL 12 MONTH) AS events, coalesce(sum(standing) FILTER (day >= DATE '{AS_OF}' - INTERVAL 12 MONTH), 0) AS consumed FROM standing WHERE standing > 0 GROUP BY ALL)
  SELECT material, plant, last_movement_date, last_issue_date, coalesce(events, 0) AS events, coalesce(consumed, 0) AS consumed, round(coalesce(consumed, 0) / nullif(stock, 0), 6) AS turns, CASE WHEN stock = 0 THEN 'INSUFFICIENT_HISTORY' END AS turns_reason,
  CASE WHEN DATE '{AS_OF}' - last_issue_date <= 90 THEN 'FAST' WHEN DATE '{AS_OF}' - last_issue_date <= 365 THEN 'SLOW' ELSE 'NON_MOVING' END AS band FROM l LEFT JOIN i USING (material, plant)""")
def movement_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ledger.movement_metrics(moves(spark, sf_dir), stock_on_hand(spark, sf_dir), AS_OF))


@queries.add(f"""WITH {MOVES}, r AS (SELECT *, CASE WHEN line % 3 > 0 THEN doc % 2 END AS reservation FROM moves), n AS (SELECT material, plant, qty, reservation, count(*) AS undone FROM r WHERE reversal GROUP BY ALL),
  k AS (SELECT *, row_number() OVER (PARTITION BY material, plant, qty, reservation ORDER BY day, doc, line) AS k FROM r WHERE NOT reversal)
  SELECT k.material, k.plant, k.day, k.qty FROM k LEFT JOIN n ON n.material = k.material AND n.plant = k.plant AND n.qty = k.qty AND n.reservation IS NOT DISTINCT FROM k.reservation WHERE k > coalesce(undone, 0) AND k.qty > 0""")
def uncancelled_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    reservation = F.when(F.col("line") % 3 > 0, F.col("doc") % 2)
    return ledger.cancel_equal(moves(spark, sf_dir).withColumn("reservation", reservation), ("reservation",))


@queries.add(f"""WITH {MOVES}, r AS (SELECT *, sum(qty) OVER (PARTITION BY material, plant ORDER BY day, doc, line, qty ROWS UNBOUNDED PRECEDING) AS upto FROM moves WHERE NOT reversal),
  i AS (SELECT material, plant, sum(qty) AS total FROM moves WHERE reversal GROUP BY ALL)
  SELECT r.material, r.plant, r.day, r.doc, r.line, r.qty, greatest(0, least(r.qty, coalesce(total, 0) - (upto - r.qty)))::DOUBLE AS issued FROM r LEFT JOIN i USING (material, plant)""")
def oldest_first_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = moves(spark, sf_dir)
    return ledger.oldest_first(m.where(~F.col("reversal")), m.where("reversal"))


@queries.add()
def fifo_with_reversals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts are lines of status F, issues the others, undone where returned; planned demand is every seventh order."""
    lines = read_table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_orderkey") % 7 == 0, "planned").when(F.col("l_linestatus") == "F", "receipt").when(F.col("l_returnflag") == "R", "undo").otherwise("issue")
    events = lines.select(F.col("l_partkey").alias("material"), F.lit(0).alias("plant"), F.col("l_shipdate").cast("date").alias("day"), kind.alias("kind"), F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("qty"))
    return ledger.allocate(events)


LINES = """l AS (SELECT l_orderkey AS po, l_linenumber AS item, sum(l_quantity) AS qty, max(l_partkey) AS material, max(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) = 1 AS closed FROM lineitem GROUP BY ALL),
  orders_ AS (SELECT *, CASE WHEN po % 5 <> 0 THEN po // 2 END AS pr FROM l),
  requests AS (SELECT o_orderkey AS pr, CAST(o_orderdate AS DATE) AS requested_on, o_orderstatus = 'P' AS deleted FROM orders),
  receipts AS (SELECT l_orderkey AS po, l_linenumber AS item, sum(l_quantity) AS received, min(CAST(l_shipdate AS DATE)) AS first_receipt FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL),
  issues AS (SELECT l_orderkey AS pr, sum(l_quantity) AS issued FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)"""


def documents_of(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    lines = read_table(spark, sf_dir, "lineitem")
    c = F.col
    orders = lines.groupBy(c("l_orderkey").alias("po"), c("l_linenumber").alias("item")).agg(F.sum("l_quantity").alias("qty"), F.max("l_partkey").alias("material"), F.max(c("l_returnflag") == "A").alias("closed"))
    orders = orders.withColumn("pr", F.when(c("po") % 5 != 0, F.floor(c("po") / 2)))
    requests = read_table(spark, sf_dir, "orders").select(c("o_orderkey").alias("pr"), c("o_orderdate").cast("date").alias("requested_on"), (c("o_orderstatus") == "P").alias("deleted"))
    receipts = lines.where("l_linestatus = 'F'").select(c("l_orderkey").alias("po"), c("l_linenumber").alias("item"), c("l_quantity").alias("qty"), c("l_shipdate").cast("date").alias("day"))
    issues = lines.where("l_returnflag = 'R'").select(c("l_orderkey").alias("pr"), c("l_quantity").alias("qty"))
    return {"orders": orders, "requests": requests, "receipts": receipts, "issues": issues}


@queries.add(f"""WITH {LINES}, base AS (SELECT o.po, o.item, o.pr, r.requested_on, o.qty, o.closed, g.received, g.first_receipt, i.issued FROM orders_ o LEFT JOIN requests r USING (pr)
  LEFT JOIN receipts g ON g.po = o.po AND g.item = o.item LEFT JOIN issues i ON i.pr = o.pr
  UNION ALL SELECT NULL, NULL, q.pr, q.requested_on, NULL, NULL, NULL, NULL, NULL FROM requests q WHERE NOT deleted AND NOT EXISTS (SELECT 1 FROM orders_ o WHERE o.pr = q.pr))
  SELECT po, item, pr, requested_on, qty, received, first_receipt, issued, CASE WHEN po IS NULL THEN 'REQUESTED' WHEN coalesce(received, 0) <= 0 AND closed THEN 'CLOSED_UNRECEIVED' WHEN coalesce(received, 0) <= 0 THEN 'ORDERED'
  WHEN coalesce(issued, 0) >= received THEN 'CONSUMED' WHEN coalesce(issued, 0) > 0 THEN 'PARTLY_CONSUMED' WHEN received < qty THEN 'PARTLY_RECEIVED' ELSE 'RECEIVED' END AS status FROM base""")
def procurement_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ledger.procurement_chain(**documents_of(spark, sf_dir))
    return out.select("po", "item", "pr", "requested_on", "qty", "received", "first_receipt", "issued", "status")


@queries.add(f"WITH {LINES} SELECT po, item, pr, pr IS NOT NULL AND count(*) OVER (PARTITION BY pr) > 1 AS unresolved FROM orders_")
def fan_out_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.fan_out_guard(documents_of(spark, sf_dir)["orders"], ["pr"]).select("po", "item", "pr", "unresolved")


@queries.add(f"""WITH {LINES}, n AS (SELECT pr, count(DISTINCT po) AS orders FROM orders_ WHERE pr IS NOT NULL GROUP BY pr)
  SELECT count(*) AS requests, count(*) FILTER (n.orders IS NULL) AS without_order, count(*) FILTER (n.orders = 1) AS with_one, count(*) FILTER (n.orders > 1) AS with_many,
  (SELECT count(*) FROM n WHERE pr NOT IN (SELECT pr FROM requests)) AS unknown_requests FROM requests LEFT JOIN n USING (pr)""")
def chain_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents_of(spark, sf_dir)
    return ledger.chain_diagnostics(d["orders"], d["requests"])


@queries.add("""WITH b AS (SELECT l_partkey AS part, l_orderkey * 8 + l_linenumber AS left_id, CAST(l_shipdate AS DATE) AS left_day, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_shipdate, l_suppkey, l_quantity, l_extendedprice) AS k FROM lineitem WHERE l_returnflag = 'R'),
  l AS (SELECT part, left_id, left_day FROM b WHERE k = 1), r AS (SELECT l_partkey AS part, min(l_orderkey) AS right_id, CAST(l_shipdate AS DATE) AS right_day FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL),
  m AS (SELECT l.left_id, min({'gap': abs(right_day - left_day), 'before': right_day < left_day, 'id': right_id, 'day': right_day}) AS b FROM l JOIN r ON l.part = r.part AND abs(right_day - left_day) <= 30 GROUP BY 1)
  SELECT part, left_id, left_day, b.id AS right_id, b.day AS right_day FROM l LEFT JOIN m USING (left_id)""")
def nearest_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem")
    c = F.col
    left = lines.where("l_returnflag = 'R'").withColumn("left_id", c("l_orderkey") * 8 + c("l_linenumber"))
    left = relational.newest(left, ["left_id"], c("l_partkey"), c("l_shipdate"), c("l_suppkey"), c("l_quantity"), c("l_extendedprice")).select(c("l_partkey").alias("part"), "left_id", c("l_shipdate").cast("date").alias("left_day"))
    right = lines.where("l_returnflag = 'A'").groupBy(c("l_partkey").alias("part"), c("l_shipdate").cast("date").alias("right_day")).agg(F.min("l_orderkey").alias("right_id"))
    return ledger.nearest_in_window(left, right, ["part"], 30)


@queries.add(f"""WITH {LINES} SELECT material % 100 AS material, 0 AS plant, sum(greatest(qty - coalesce(received, 0), 0)) AS open_quantity, count(*) AS open_lines FROM orders_ LEFT JOIN receipts USING (po, item) WHERE NOT closed GROUP BY ALL""")
def open_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents_of(spark, sf_dir)
    got = d["receipts"].groupBy("po", "item").agg(F.sum("qty").alias("received"))
    lines = d["orders"].join(got, ["po", "item"], "left").withColumn("material", F.col("material") % 100).withColumn("plant", F.lit(0))
    return ledger.open_quantity(lines)


@queries.add(f"""WITH d AS (SELECT o_orderkey AS doc, DATE '{AS_OF}' - CAST(o_orderdate AS DATE) AS age, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) + 30 END AS due, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 400)::INTEGER END AS lead FROM orders)
  SELECT doc, CASE WHEN greatest(age, 0) <= 15 THEN '0-15' WHEN age <= 30 THEN '16-30' WHEN age <= 45 THEN '31-45' WHEN age <= 60 THEN '46-60' ELSE '60+' END AS bucket,
  CASE WHEN age <= 90 THEN 'FAST' WHEN age <= 365 THEN 'SLOW' ELSE 'NON_MOVING' END AS band,
  CASE WHEN due IS NULL THEN 'NO_DUE_DATE' WHEN DATE '{AS_OF}' > due + 7 THEN 'OVERDUE' ELSE 'ON_TIME' END AS overdue,
  CASE WHEN lead IS NULL OR lead <= 0 THEN 'NO_LEAD_TIME' WHEN age > lead THEN 'BEYOND_LEAD_TIME' ELSE 'WITHIN_LEAD_TIME' END AS lead_state FROM d""")
def order_aging(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders")
    on = F.col("o_orderdate").cast("date")
    age = F.datediff(day_of(AS_OF), on)
    due = F.when(F.col("o_orderstatus") != "P", F.date_add(on, 30))
    lead = F.when(F.col("o_orderkey") % 3 == 0, (F.col("o_orderkey") % 400).cast("int"))
    return orders.select(
        F.col("o_orderkey").alias("doc"),
        semantics.aging_bucket(age).alias("bucket"),
        semantics.aging_band(age, 90, 365).alias("band"),
        semantics.overdue_state(due, day_of(AS_OF), 7).alias("overdue"),
        semantics.lead_time_state(age, lead).alias("lead_state"),
    )


@queries.add("""SELECT l_orderkey AS po, count(*) AS movements, min(CAST(l_shipdate AS DATE)) FILTER (l_returnflag = 'N') AS first_dispatch, max(CAST(l_shipdate AS DATE)) FILTER (l_returnflag = 'N') AS last_dispatch,
  coalesce(sum(l_quantity) FILTER (l_returnflag = 'N'), 0) AS dispatched, coalesce(sum(CASE l_returnflag WHEN 'A' THEN l_quantity WHEN 'R' THEN -l_quantity END), 0) AS received FROM lineitem GROUP BY ALL""")
def conditional_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem")
    rows = lines.select(F.col("l_orderkey").alias("po"), F.col("l_returnflag").alias("kind"), F.col("l_shipdate").cast("date").alias("day"), F.col("l_quantity").alias("qty"))
    return ledger.line_movements(rows, "po", "N", "A", "R")


@queries.add(f"""WITH {LINES}, w AS (SELECT o.material, o.po, o.item, r.first_receipt, DATE '{AS_OF}' - r.first_receipt AS days, coalesce(i.issued, 0) AS issued FROM orders_ o JOIN receipts r ON r.po = o.po AND r.item = o.item LEFT JOIN issues i ON i.pr = o.pr)
  SELECT material, count(*) AS lines, max(days)::INTEGER AS oldest_days, max(days) > 30 AS flagged FROM w WHERE issued = 0 AND days >= 0 GROUP BY ALL""")
def received_not_issued(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents_of(spark, sf_dir)
    return ledger.received_not_issued(d["orders"], d["receipts"], d["issues"], day_of(AS_OF))


@queries.add(f"""WITH {LINES}, w AS (SELECT o.po, o.item, o.qty, coalesce(r.received, 0) AS received, CASE WHEN o.po % 4 = 0 THEN o.qty * 0.8 END AS plan FROM orders_ o LEFT JOIN receipts r ON r.po = o.po AND r.item = o.item)
  SELECT po, item, qty > plan AS plan_breach, CASE WHEN plan IS NULL THEN 'NO_PLAN' WHEN received > plan THEN 'ABOVE_PLAN' WHEN received < plan THEN 'BELOW_PLAN' ELSE 'AS_PLANNED' END AS acquired FROM w""")
def plan_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents_of(spark, sf_dir)
    got = d["receipts"].groupBy("po", "item").agg(F.sum("qty").alias("received"))
    plan = F.when(F.col("po") % 4 == 0, F.col("qty") * 0.8)
    lines = d["orders"].join(got, ["po", "item"], "left").withColumn("plan", plan).withColumn("received", F.coalesce("received", F.lit(0.0)))
    return ledger.plan_exceptions(lines).select("po", "item", "plan_breach", "acquired")


@queries.add("""WITH i AS (SELECT p_partkey AS material, p_size > 40 AS dear, CASE WHEN p_size % 5 <> 0 THEN p_retailprice > 1200 END AS critical, p_size % 7 = 0 AS moved FROM part),
  t AS (SELECT *, list_filter([CASE WHEN dear THEN 'DEAR' END, CASE WHEN critical THEN 'CRITICAL' END, CASE WHEN moved THEN 'MOVED' END], lambda x: x IS NOT NULL) AS reasons FROM i)
  SELECT material, array_to_string(reasons, '+') AS reasons, CASE WHEN len(reasons) > 0 THEN 'CANDIDATE' WHEN critical IS NULL THEN 'UNKNOWN' ELSE 'NO' END AS verdict FROM t""")
def reclassification(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    tests = {"DEAR": size > 40, "CRITICAL": F.when(size % 5 != 0, F.col("p_retailprice") > 1200), "MOVED": size % 7 == 0}
    return ledger.reclassify(read_table(spark, sf_dir, "part"), tests).select(F.col("p_partkey").alias("material"), "reasons", "verdict")


@queries.add("""WITH c AS (SELECT l_partkey AS material, list(DISTINCT l_suppkey) AS owners FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)
  SELECT p_partkey AS material, coalesce(len(owners), 0)::INTEGER AS candidates, CASE WHEN len(owners) = 1 THEN owners[1] END AS owner, CASE WHEN owners IS NULL THEN 'NONE' WHEN len(owners) = 1 THEN 'ATTRIBUTED' ELSE 'AMBIGUOUS' END AS status FROM part LEFT JOIN c ON material = p_partkey""")
def ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("material"), "l_suppkey")
    parts = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("material"))
    return ledger.attribute_owner(parts, lines, "material", "l_suppkey")
