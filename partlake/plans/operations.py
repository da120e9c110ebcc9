"""Status, incremental and set-shaped queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partlake.functions import normalise
from partlake.operators import incremental, relational, status
from partlake.plans.ledgers import LINES, documents_of
from partlake.plans.registry import AS_OF, DENSE, Registry, day_of, rounded
from partlake.session import read_table, shared_folder
from partlake.sources.paged import duplicate_keys
from partlake.streaming import streams

queries = Registry()
c = F.col


@queries.add("""SELECT p_partkey, CASE WHEN p_size % 6 = 0 THEN CASE WHEN upper(p_brand) = 'BRAND#5' THEN 'UNKNOWN' ELSE 'NO' END WHEN upper(p_brand) <> 'BRAND#5' THEN 'NO' WHEN p_size % 4 < 2 THEN 'YES' ELSE 'NO' END AS verdict
  FROM (SELECT p_partkey, p_brand, p_size FROM part)""")
def policy_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(c("p_size") % 6 != 0, (c("p_size") % 4).cast("string"))
    verdict = status.policy([status.predicate(c("p_brand"), "EQ", ["Brand#5"]), status.predicate(kind, "IN", ["0", "1"])])
    return read_table(spark, sf_dir, "part").select("p_partkey", verdict.alias("verdict"))


REPAIR = """r AS (SELECT l_orderkey AS po, l_linenumber AS item, CASE l_orderkey % 11 WHEN 0 THEN 'L' WHEN 1 THEN 'S' ELSE '' END AS del, CASE WHEN max(l_linestatus) = 'F' THEN 'X' END AS done, CASE WHEN l_orderkey % 13 = 0 THEN 'AN' ELSE 'NB' END AS kind,
  sum(l_quantity) AS ordered, coalesce(sum(l_quantity) FILTER (l_returnflag = 'A'), 0) AS received, coalesce(sum(l_quantity) FILTER (l_returnflag = 'N'), 0) AS dispatched FROM lineitem GROUP BY ALL),
  s AS (SELECT *, CASE WHEN del = 'L' THEN 'DELETED' WHEN del = 'S' THEN 'BLOCKED' WHEN kind = 'AN' THEN 'NOT_AN_ORDER' WHEN done = 'X' THEN 'CLOSED' ELSE 'OPEN' END AS state FROM r)"""


@queries.add(f"""WITH {REPAIR} SELECT po, item, state, CASE WHEN state = 'DELETED' THEN 'CANCELLED' WHEN received >= ordered THEN 'RETURNED' WHEN state = 'CLOSED' THEN 'CLOSED_SHORT' WHEN received > 0 THEN 'PARTLY_RETURNED' WHEN dispatched > 0 THEN 'AT_VENDOR' ELSE 'NOT_DISPATCHED' END AS repair FROM s""")
def repair_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, flag = c("l_quantity"), c("l_returnflag")
    lines = read_table(spark, sf_dir, "lineitem").groupBy(c("l_orderkey").alias("po"), c("l_linenumber").alias("item")).agg(
        F.max("l_linestatus").alias("done"),
        F.sum(q).alias("ordered"),
        F.coalesce(F.sum(F.when(flag == "A", q)), F.lit(0.0)).alias("received"),
        F.coalesce(F.sum(F.when(flag == "N", q)), F.lit(0.0)).alias("dispatched"),
    )
    deleted = F.when(c("po") % 11 == 0, "L").when(c("po") % 11 == 1, "S").otherwise("")
    state = status.po_line_state(deleted, F.when(c("done") == "F", "X"), F.when(c("po") % 13 == 0, "AN").otherwise("NB"))
    return lines.withColumn("state", state).select("po", "item", "state", status.repair_status(c("state"), c("ordered"), c("received"), c("dispatched")).alias("repair"))


@queries.add(f"""WITH {LINES}, q AS (SELECT pr, CASE WHEN pr % 3 = 0 THEN pr + 1 END AS po, deleted, pr % 7 = 0 AS closed FROM requests), lv AS (SELECT po, pr FROM orders_ WHERE po % 6 <> 0 AND po % 8 <> 0)
  SELECT q.pr, CASE WHEN deleted THEN 'DELETED' WHEN EXISTS (SELECT 1 FROM lv WHERE lv.pr = q.pr) OR EXISTS (SELECT 1 FROM lv WHERE lv.po = q.po) THEN 'LIVE_ORDER' WHEN closed THEN 'CLOSED' ELSE 'OPEN' END AS verdict FROM q""")
def request_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents_of(spark, sf_dir)
    requests = d["requests"].select("pr", F.when(c("pr") % 3 == 0, c("pr") + 1).alias("po"), "deleted", (c("pr") % 7 == 0).alias("closed"))
    lines = d["orders"].select("po", "pr", (c("po") % 6 == 0).alias("deleted"), (c("po") % 8 == 0).alias("rfq"))
    return status.classify_requests(requests, lines)


@queries.add("""WITH l AS (SELECT o_orderkey AS line, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey // 8 END AS session, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey // 6 END AS doc, o_custkey AS part, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate::DATE END AS raised FROM orders WHERE o_orderkey % 2 = 0),
  a AS (SELECT o_orderkey AS att, CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey // 8 END AS session, CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey // 6 END AS doc, o_custkey AS part, o_orderdate::DATE AS day FROM orders WHERE o_orderkey % 2 = 1),
  s AS (SELECT line, max({'day': day, 'att': att}) AS b FROM l JOIN a USING (session) GROUP BY 1), d AS (SELECT line, max({'day': day, 'att': att}) AS b FROM l JOIN a USING (doc) GROUP BY 1),
  w AS (SELECT line, max({'day': day, 'att': att}) AS b FROM l JOIN a USING (part) WHERE raised IS NULL OR abs(day - raised) <= 60 GROUP BY 1)
  SELECT line, coalesce(s.b.att, d.b.att, w.b.att) AS att, CASE WHEN s.b IS NOT NULL THEN 'SESSION' WHEN d.b IS NOT NULL THEN 'DOCUMENT' WHEN w.b IS NOT NULL THEN 'WINDOW' ELSE 'NONE' END AS rule FROM l LEFT JOIN s USING (line) LEFT JOIN d USING (line) LEFT JOIN w USING (line)""")
def attestation_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, day = c("o_orderkey"), c("o_orderdate").cast("date")
    orders = read_table(spark, sf_dir, "orders")
    lines = orders.where(k % 2 == 0).select(k.alias("line"), F.when(k % 5 == 0, F.floor(k / 8)).alias("session"), F.when(k % 3 == 0, F.floor(k / 6)).alias("doc"), c("o_custkey").alias("part"), F.when(k % 4 != 0, day).alias("raised"))
    given = orders.where(k % 2 == 1).select(k.alias("att"), F.when(k % 7 == 0, F.floor(k / 8)).alias("session"), F.when(k % 11 == 0, F.floor(k / 6)).alias("doc"), c("o_custkey").alias("part"), day.alias("day"))
    return status.attest(lines, given, 60)


@queries.add(f"""WITH {DENSE}, k AS (SELECT material, plant, avg(quantity) AS rate FROM dense GROUP BY ALL), w AS (SELECT *, CASE WHEN material % 4 <> 0 THEN (material % 45)::DOUBLE END AS stock, (plant * 3)::DOUBLE AS open_po, CASE WHEN material % 5 = 0 THEN 10.0::DOUBLE END AS planned, (material % 20)::DOUBLE AS acquired FROM k),
  v AS (SELECT *, CASE WHEN rate > 0 THEN round(coalesce(stock, 0) / rate, 6) END AS cover, CASE WHEN rate > 0 THEN round((coalesce(stock, 0) + open_po) / rate, 6) END AS projected_cover, acquired - planned AS variance FROM w)
  SELECT material, plant, cover, projected_cover, variance, CASE WHEN rate > 0 AND coalesce(stock, 0) <= 0 THEN 'OUT_OF_STOCK' WHEN projected_cover > 24 THEN 'OVERSTOCK' WHEN cover < 1 THEN 'LOW_COVER' WHEN variance > 0 THEN 'ABOVE_PLAN' ELSE 'NORMAL' END AS flag FROM v""")
def watch_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from partlake.operators import demand
    from partlake.plans.planning import monthly
    from partlake.plans.registry import END, START

    rates = demand.densify(monthly(spark, sf_dir), START, END).groupBy("material", "plant").agg(F.avg("quantity").alias("rate"))
    m = c("material")
    spine = rates.withColumns({"stock": F.when(m % 4 != 0, (m % 45).cast("double")), "open_po": (c("plant") * 3).cast("double"), "planned": F.when(m % 5 == 0, F.lit(10.0)), "acquired": (m % 20).cast("double")})
    return rounded(status.watch(spine).select("material", "plant", "cover", "projected_cover", "variance", "flag"))


@queries.add("""WITH t AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_size END AS po, CASE WHEN p_size % 2 = 0 THEN p_size * 20 END AS marc FROM part)
  SELECT p_partkey, CASE WHEN po BETWEEN 1 AND 730 THEN po WHEN marc BETWEEN 1 AND 730 THEN marc END AS days, CASE WHEN po BETWEEN 1 AND 730 THEN 'PO_HISTORY' WHEN marc BETWEEN 1 AND 730 THEN 'PLANNED' END AS source FROM t""")
def lead_time_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = c("p_size")
    days, label = status.lead_time_source(("PO_HISTORY", F.when(size % 3 == 0, size)), ("PLANNED", F.when(size % 2 == 0, size * 20)))
    return read_table(spark, sf_dir, "part").select("p_partkey", days.alias("days"), label.alias("source"))


@queries.add("""WITH t AS (SELECT p_partkey, CASE WHEN p_size % 4 <> 0 THEN p_size % 9 END AS uses, CASE WHEN p_size % 5 <> 0 THEN p_size % 10 = 1 END AS obsolete, CASE WHEN p_size % 3 <> 0 THEN p_size > 45 END AS critical FROM part)
  SELECT p_partkey, CASE WHEN obsolete THEN 'NO' WHEN (uses > 4) OR critical THEN CASE WHEN obsolete IS NULL THEN 'UNKNOWN' ELSE 'YES' END WHEN ((uses > 4) OR critical) IS NULL THEN 'UNKNOWN' ELSE 'NO' END AS verdict FROM t""")
def conversion_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = c("p_size")
    verdict = status.conversion(F.when(size % 4 != 0, size % 9), F.when(size % 5 != 0, size % 10 == 1), F.when(size % 3 != 0, size > 45))
    return read_table(spark, sf_dir, "part").select("p_partkey", verdict.alias("verdict"))


@queries.add("""WITH t AS (SELECT p_partkey, [CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size % 2 = 0 END, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size % 7 < 5 END] AS same FROM part), n AS (SELECT p_partkey, len(list_filter(same, lambda x: x IS NOT NULL)) AS seen, len(list_filter(same, lambda x: x)) AS hits FROM t)
  SELECT p_partkey, CASE WHEN seen = 0 THEN 'UNKNOWN' WHEN hits = seen THEN 'ADOPTED' WHEN hits > 0 THEN 'PARTLY' ELSE 'NOT_ADOPTED' END AS adoption FROM n""")
def parameter_adoption(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = c("p_size")
    text = size.cast("string")
    now = {"rop": F.when(size % 3 != 0, F.when(size % 2 == 0, F.concat(text, F.lit(".00"))).otherwise("-1")), "max": F.when(size % 5 != 0, F.when(size % 7 < 5, F.concat(F.lit(" "), text)).otherwise("-1"))}
    return read_table(spark, sf_dir, "part").select("p_partkey", status.adoption({"rop": text, "max": text}, now).alias("adoption"))


@queries.add("""SELECT DISTINCT l_orderkey AS doc, l_partkey AS material, 'REQUEST' AS origin FROM lineitem WHERE l_linenumber = 1 AND l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
  UNION ALL SELECT DISTINCT l_orderkey, l_partkey, 'DIRECT' FROM lineitem WHERE l_linenumber = 2 AND l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def new_acquisitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("doc"), c("l_partkey").alias("material"), "l_linenumber", "l_returnflag")
    one = lambda n: lines.where(c("l_linenumber") == n).select("doc", "material").distinct()
    return status.new_acquisitions(one(1), one(2), lines.where("l_returnflag = 'R'"))


@queries.add("""SELECT coalesce(sum(n - 1), 0)::BIGINT AS duplicates, coalesce(sum(n), 0)::BIGINT AS rows FROM (SELECT count(*) AS n FROM lineitem WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL GROUP BY l_orderkey, l_linenumber)""")
def duplicate_key_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_keys(read_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@queries.add("""WITH f AS (SELECT event_id, user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 20 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh, event_id % 10 AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM f), g AS (SELECT user_id AS request, min(ts) AS started, count(*) AS chunks, sum(n)::BIGINT AS rows, arg_max(n, ts) AS last, count(*) FILTER (n < 9) AS short FROM s GROUP BY user_id, k)
  SELECT request, started, chunks, rows, CASE WHEN last < 9 AND short = 1 THEN 'BOUNDED' ELSE 'INCOMPLETE' END AS verdict FROM g""")
def chunk_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = read_table(spark, sf_dir, "events").select(c("user_id").alias("request"), "ts", (c("event_id") % 10).alias("rows"))
    return incremental.chunk_requests(chunks, "20 minutes", 9)


@queries.add(f"SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_orderdate::DATE < DATE '{AS_OF}' - INTERVAL 12 MONTH")
def open_row_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders")
    return incremental.open_row_keys(orders, ["o_custkey"], c("o_orderstatus") == "O", c("o_orderdate").cast("date"), incremental.window_begin("12m", day_of(AS_OF)))


@queries.add("SELECT s_suppkey, s_name, s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity >= 49) AS is_active FROM supplier")
def soft_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = read_table(spark, sf_dir, "lineitem").where("l_quantity >= 49").select(c("l_suppkey").alias("s_suppkey"))
    return relational.soft_delete(read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), seen, ["s_suppkey"], True)


@queries.add("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'CODED' WHEN doc_id % 3 = 0 THEN 'MATERIAL' ELSE 'TEXT_ONLY' END AS partition FROM documents WHERE regexp_matches(lower(text), 'license|idiot|the')""")
def keyword_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    material = F.when(c("doc_id") % 4 == 0, F.concat(F.lit("80"), F.lpad(c("doc_id").cast("string"), 8, "0"))).when(c("doc_id") % 3 == 0, F.concat(F.lit("50"), c("doc_id").cast("string"))).otherwise("")
    return status.keyword_partition(docs, normalise.like_any(c("text"), ["license", "idiot", "the"]), F.lit(False), material, "80").select("doc_id", "partition")


@queries.add("SELECT p_partkey AS material, p_name AS text FROM part WHERE contains(upper(p_name), upper('a')) ORDER BY CASE WHEN upper(p_name) = 'A' THEN 0 WHEN starts_with(upper(p_name), 'A') THEN 1 ELSE 2 END, material LIMIT 20")
def material_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-20 report."""
    return status.search(read_table(spark, sf_dir, "part").select(c("p_partkey").alias("material"), c("p_name").alias("text")), "a", 20)


@queries.add("""WITH n AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1) SELECT o_orderstatus, n, round(n * 100.0 / sum(n) OVER (), 6)::DOUBLE AS share FROM n""")
def status_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read_table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # over one row for each status
    return n.select("o_orderstatus", "n", F.round(c("n") * 100.0 / total, 6).alias("share"))


# ---- streams: what has landed, read once as a stream


@queries.add("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value::DECIMAL(18,4))::DOUBLE, 4) AS total FROM events GROUP BY ALL""")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = read_table(spark, sf_dir, "events").schema
    events = streams.timed(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)).withColumn("value", c("value").cast("decimal(18,4)"))
    folder = shared_folder(spark, "tumbling")
    out = streams.updates_once(streams.tumbling(events, "1 hour", "1 day", ["event_type"], "value"), f"{folder}/out", f"{folder}/state", ["start", "event_type"])
    return out.select(c("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round(c("total").cast("double"), 4).alias("total"))


@queries.add("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ts) AS k FROM events) WHERE k = 1")
def stream_once_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = read_table(spark, sf_dir, "events").schema
    events = streams.timed(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir))
    folder = shared_folder(spark, "once")
    streams.append_once(streams.once_within(events, "60 days", ["event_id"]), f"{folder}/out", f"{folder}/state")
    return spark.read.parquet(f"{folder}/out").select("event_id", "user_id", "event_type")
