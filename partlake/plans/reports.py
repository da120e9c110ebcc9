"""Summaries, relational shapes, similarity, normalisation and formula queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partlake.functions import formula, normalise
from partlake.functions.semantics import greatest_known, least_known, ratio
from partlake.operators import kpi, relational, similarity
from partlake.plans.registry import MOVES, Registry, moves, rounded
from partlake.session import read_table

queries = Registry()
c = F.col


# ---- relational shapes


@queries.add("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def newest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.newest(read_table(spark, sf_dir, "orders"), ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey", "o_totalprice")


@queries.add("SELECT p_brand, p_partkey, rank FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey)::INTEGER AS rank FROM part) WHERE rank <= 5")
def top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.top_per_key(read_table(spark, sf_dir, "part"), ["p_brand"], 5, F.desc("p_retailprice"), F.asc("p_partkey")).select("p_brand", "p_partkey", "rank")


@queries.add("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50 OFFSET 100)")
def page_late_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return relational.page(orders, "o_orderkey", [F.desc_nulls_last("o_totalprice"), F.asc("o_orderkey")], 50, 100)


@queries.add("""SELECT coalesce(a.k, b.k, d.k) AS material, (a.k IS NOT NULL)::INTEGER AS in_master, (b.k IS NOT NULL)::INTEGER AS in_moves, (d.k IS NOT NULL)::INTEGER AS in_returns
  FROM (SELECT p_partkey AS k FROM part WHERE p_size < 30) a FULL JOIN (SELECT DISTINCT l_partkey AS k FROM lineitem) b ON a.k = b.k FULL JOIN (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45) d ON coalesce(a.k, b.k) = d.k""")
def universe_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem")
    sources = {
        "master": read_table(spark, sf_dir, "part").where("p_size < 30").select(c("p_partkey").alias("material")),
        "moves": lines.select(c("l_partkey").alias("material")),
        "returns": lines.where("l_returnflag = 'R' AND l_quantity > 45").select(c("l_partkey").alias("material")),
    }
    return relational.universe(sources, ["material"])


@queries.add("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join_uncovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "customer").join(read_table(spark, sf_dir, "orders"), c("c_custkey") == c("o_custkey"), "left_anti").select("c_custkey", "c_name")


@queries.add("SELECT p_partkey, p_brand FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50 AND l_returnflag = 'R')")
def semi_join_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = read_table(spark, sf_dir, "lineitem").where("l_quantity = 50 AND l_returnflag = 'R'")
    return read_table(spark, sf_dir, "part").join(wanted, c("p_partkey") == c("l_partkey"), "left_semi").select("p_partkey", "p_brand")


@queries.add("""SELECT l_orderkey, count(*) AS lines, any_value(h.o_orderdate) AS ordered FROM lineitem l LEFT JOIN (SELECT o_orderkey, max(CAST(o_orderdate AS DATE)) AS o_orderdate FROM orders GROUP BY 1) h ON l.l_orderkey = h.o_orderkey GROUP BY 1""")
def line_to_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    header = read_table(spark, sf_dir, "orders").groupBy("o_orderkey").agg(F.max(c("o_orderdate").cast("date")).alias("ordered"))
    lines = read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"))  # summed first: a header row for each order
    return lines.join(header, c("l_orderkey") == c("o_orderkey"), "left").select("l_orderkey", "lines", "ordered")


@queries.add("""SELECT s_suppkey, s_name, n_name, r_name, coalesce(k.lines, 0) AS lines FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT l_suppkey, count(*) AS lines FROM lineitem GROUP BY 1) k ON l_suppkey = s_suppkey""")
def dimension_widen(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("lines"))
    s, n, r = (read_table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    wide = s.join(n, c("s_nationkey") == c("n_nationkey")).join(r, c("n_regionkey") == c("r_regionkey")).join(lines, c("l_suppkey") == c("s_suppkey"), "left")
    return wide.select("s_suppkey", "s_name", "n_name", "r_name", F.coalesce("lines", F.lit(0)).alias("lines"))


@queries.add("""(SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R') EXCEPT ALL (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A')""")
def row_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem")
    one = lambda f: lines.where(c("l_returnflag") == f).select("l_partkey", "l_suppkey")
    return relational.row_difference(one("R"), one("A"))


@queries.add("(SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') INTERSECT (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A')")
def key_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem")
    return lines.where("l_returnflag = 'R'").select("l_partkey").intersect(lines.where("l_returnflag = 'A'").select("l_partkey"))


@queries.add("""SELECT CASE WHEN l_quantity > 45 THEN 'TOO_LARGE' WHEN l_shipdate < o_orderdate THEN 'BEFORE_ORDER' WHEN l_discount > 0.09 THEN 'DISCOUNT' END AS reject_reason, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1 HAVING reject_reason IS NOT NULL""")
def reject_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "lineitem").join(read_table(spark, sf_dir, "orders"), c("l_orderkey") == c("o_orderkey"))
    rules = {"TOO_LARGE": c("l_quantity") > 45, "BEFORE_ORDER": c("l_shipdate") < c("o_orderdate"), "DISCOUNT": c("l_discount") > 0.09}
    return relational.reject_split(rows, rules)[1].groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))


MERGED = """t AS (SELECT o_orderkey AS k, o_totalprice AS price, o_orderstatus AS status FROM orders WHERE o_orderkey % 3 <> 0),
  b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS price, o_orderstatus AS status FROM orders WHERE o_orderkey % 5 < 3)"""


@queries.add(f"""WITH {MERGED}, m AS (SELECT coalesce(t.k, b.k) AS k, coalesce(b.price, t.price) AS price, coalesce(b.status, t.status) AS status,
  CASE WHEN t.k IS NULL THEN 'inserted' WHEN b.k IS NULL THEN 'kept' WHEN t.price = b.price AND t.status = b.status THEN 'unchanged' ELSE 'updated' END AS change FROM t FULL JOIN b ON t.k = b.k) SELECT * FROM m""")
def merge_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders").dropDuplicates(["o_orderkey"])
    k, price = c("o_orderkey"), c("o_totalprice")
    target = orders.where(k % 3 != 0).select(k.alias("k"), price.alias("price"), c("o_orderstatus").alias("status"))
    batch = orders.where(k % 5 < 3).select(k.alias("k"), F.when(k % 2 == 0, price + 1).otherwise(price).alias("price"), c("o_orderstatus").alias("status"))
    return relational.merge(target, batch, ["k"])


@queries.add("SELECT user_id, event_type, min_by(value, ts) AS before, max_by(value, ts) AS after, count(*) AS changes FROM (SELECT user_id, event_type, ts, any_value(value) AS value FROM events GROUP BY ALL) GROUP BY ALL")
def field_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events").select("user_id", c("event_type").alias("field"), c("ts").alias("at"), c("value").alias("old"), c("value").alias("new"))
    return relational.changes_of_fields(e, ["user_id"]).withColumnRenamed("field", "event_type")


@queries.add("SELECT o_custkey, arg_max(o_totalprice, o_orderdate) FILTER (o_orderstatus = 'F') AS last_f, arg_max(o_orderpriority, o_orderdate) AS last_priority FROM (SELECT * FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey, o_orderdate) = 1) GROUP BY ALL")
def newest_known_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    single = F.count(F.lit(1)).over(Window.partitionBy("o_custkey", "o_orderdate"))
    orders = read_table(spark, sf_dir, "orders").withColumn("n", single).where("n = 1").select("o_custkey", "o_orderdate", F.when(c("o_orderstatus") == "F", c("o_totalprice")).alias("last_f"), c("o_orderpriority").alias("last_priority"))
    return relational.fill_forward_newest(orders, ["o_custkey"], "o_orderdate", ["last_f", "last_priority"])


# ---- summaries


@queries.add("""SELECT 'total' AS facet, NULL AS value, count(*) AS n FROM orders UNION ALL SELECT 'o_orderstatus', o_orderstatus, count(*) FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2""")
def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpi.facet_counts(read_table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


@queries.add("""WITH r AS (SELECT CASE WHEN p_size % 6 <> 0 THEN p_size::DOUBLE END AS b, CASE WHEN p_size % 5 <> 0 THEN p_retailprice END AS a FROM part)
  SELECT count(*) AS n, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS compared, count(*) FILTER (b IS NULL) AS missing_before, count(*) FILTER (a IS NULL) AS missing_after, round(avg(b) FILTER (a IS NOT NULL), 4) AS avg_before, round(avg(a) FILTER (b IS NOT NULL), 4) AS avg_after,
  round(avg(a - b), 4) AS avg_delta, round(avg((a - b) / nullif(b, 0) * 100), 4) AS pct_change, count(*) FILTER (a > b) AS increased, count(*) FILTER (a < b) AS decreased FROM r""")
def baseline_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = c("p_size")
    rows = read_table(spark, sf_dir, "part").select(F.when(size % 6 != 0, size.cast("double")).alias("b"), F.when(size % 5 != 0, c("p_retailprice")).alias("a"))
    return rounded(kpi.compare_metric(rows, "b", "a"), 4)


@queries.add("""WITH m AS (SELECT unnest(generate_series(DATE '1996-01-01', DATE '1999-12-01', INTERVAL 1 MONTH))::DATE AS month), e AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS orders, count(DISTINCT o_custkey) AS customers FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
  SELECT month, coalesce(orders, 0) AS orders, coalesce(customers, 0) AS customers FROM m LEFT JOIN e USING (month)""")
def monthly_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return kpi.by_month(orders, c("o_orderdate").cast("date"), "1996-01-01", "1999-12-01", F.count(F.lit(1)).alias("orders"), F.countDistinct("o_custkey").alias("customers"))


@queries.add("""WITH q AS (SELECT n_regionkey AS region, date_trunc('quarter', o_orderdate)::DATE AS quarter, sum(o_totalprice::DECIMAL(18,2)) AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
  SELECT region, quarter, value::DOUBLE AS value, round((value - lag(value) OVER w)::DOUBLE, 2) AS change, round((value - lag(value) OVER w)::DOUBLE / lag(value) OVER w::DOUBLE * 100, 4) AS change_pct FROM q WINDOW w AS (PARTITION BY region ORDER BY quarter)""".replace("lag(value) OVER w::DOUBLE", "(lag(value) OVER w)::DOUBLE"))
def quarter_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = read_table(spark, sf_dir, "orders").join(read_table(spark, sf_dir, "customer"), c("o_custkey") == c("c_custkey")).join(read_table(spark, sf_dir, "nation"), c("c_nationkey") == c("n_nationkey"))
    q = joined.groupBy(c("n_regionkey").alias("region"), F.trunc("o_orderdate", "quarter").alias("quarter")).agg(F.sum(c("o_totalprice").cast("decimal(18,2)")).cast("double").alias("value"))
    out = kpi.with_change(q, ["region"], "quarter", "value")
    return out.select("region", "quarter", "value", F.round("change", 2).alias("change"), F.round("change_pct", 4).alias("change_pct"))


@queries.add("""WITH r AS (SELECT CASE WHEN l_linenumber <> 3 THEN (l_quantity - 25)::DECIMAL(18,2) END AS delta, l_extendedprice::DECIMAL(18,2) AS price, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 END AS fx FROM lineitem), v AS (SELECT delta * price * fx AS worth FROM r)
  SELECT count(worth) AS included, count(*) - count(worth) AS excluded, sum(worth)::DOUBLE AS net, sum(worth) FILTER (worth > 0)::DOUBLE AS tied_up, sum(worth) FILTER (worth < 0)::DOUBLE AS released FROM v""".replace("FILTER (worth > 0)::DOUBLE", "FILTER (worth > 0)").replace("FILTER (worth < 0)::DOUBLE", "FILTER (worth < 0)").replace("sum(worth) FILTER (worth > 0)", "(sum(worth) FILTER (worth > 0))::DOUBLE").replace("sum(worth) FILTER (worth < 0)", "(sum(worth) FILTER (worth < 0))::DOUBLE"))
def working_capital(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = F.when(c("l_returnflag") == "A", 1).when(c("l_returnflag") == "R", 2)
    rows = read_table(spark, sf_dir, "lineitem").select(F.when(c("l_linenumber") != 3, (c("l_quantity") - 25).cast("decimal(12,2)")).alias("delta"), c("l_extendedprice").cast("decimal(12,2)").alias("price"), fx.alias("fx"))
    out = kpi.working_capital(rows)
    return out.select("included", "excluded", *[c(x).cast("double").alias(x) for x in ("net", "tied_up", "released")])


@queries.add("""WITH r AS (SELECT p_brand, ln(p_retailprice) AS v, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice) AS k, count(*) OVER (PARTITION BY p_brand) AS n FROM part WHERE p_retailprice > 0)
  SELECT p_brand, round(max(v) FILTER (k = greatest(ceil(round(0.05 * n, 9)), 1)), 6) AS low, round(max(v) FILTER (k = ceil(round(0.95 * n, 9))), 6) AS high, max(n) AS n FROM r GROUP BY ALL""")
def price_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read_table(spark, sf_dir, "part").where("p_retailprice > 0")
    return rounded(kpi.nearest_rank(parts, ["p_brand"], F.log("p_retailprice")))


@queries.add("""WITH n AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL) SELECT p_brand, p_type AS mode, n FROM n QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) = 1""")
def commonest_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpi.mode_first(read_table(spark, sf_dir, "part"), ["p_brand"], "p_type")


@queries.add("""WITH r AS (SELECT l_suppkey, count(*) AS computed, CASE WHEN l_suppkey % 4 <> 0 THEN (count(*) * (98 + l_suppkey % 5)) // 100 END AS reference FROM lineitem GROUP BY 1),
  d AS (SELECT *, abs(computed - reference) AS difference, CASE WHEN reference = 0 THEN CASE WHEN computed <> 0 THEN 100.0 ELSE 0.0 END ELSE abs(computed - reference) / abs(reference)::DOUBLE * 100 END::DOUBLE AS pct FROM r)
  SELECT l_suppkey, difference, round(pct, 4) AS pct, CASE WHEN reference IS NULL THEN 'REFERENCE_UNAVAILABLE' WHEN pct <= 1.0 THEN 'RECONCILED' ELSE 'OUT_OF_TOLERANCE' END AS status FROM d""")
def reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count(F.lit(1))
    rows = read_table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(n.alias("computed"))
    rows = rows.withColumn("reference", F.when(c("l_suppkey") % 4 != 0, F.floor(c("computed") * (98 + c("l_suppkey") % 5) / 100)))
    return rounded(kpi.reconcile(rows, "computed", "reference", 1.0).select("l_suppkey", "difference", "pct", "status"), 4)


@queries.add("""SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity, grouping_id(l_returnflag, l_linestatus) AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def extension_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"), F.grouping_id().alias("level"))


@queries.add("""SELECT o_orderstatus, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderpriority = '5-LOW') AS low FROM orders GROUP BY ALL""")
def pivot_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "orders").groupBy("o_orderstatus").pivot("o_orderpriority", ["1-URGENT", "5-LOW"]).count()
    return p.select("o_orderstatus", F.coalesce(c("1-URGENT"), F.lit(0)).alias("urgent"), F.coalesce(c("5-LOW"), F.lit(0)).alias("low"))


@queries.add("""SELECT p_brand, round(median(p_retailprice), 6) AS median, round(quantile_cont(p_retailprice, 0.9), 6) AS p90, avg(p_size) AS avg_size FROM part GROUP BY ALL""")
def exact_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "part").groupBy("p_brand").agg(F.round(F.median("p_retailprice"), 6).alias("median"), F.round(F.percentile("p_retailprice", F.lit(0.9)), 6).alias("p90"), F.avg("p_size").alias("avg_size"))


# ---- similarity


VECTORS = """v AS (SELECT vec_id AS id, label AS p, embedding AS e FROM embeddings), s AS (SELECT a.id AS t_id, b.id AS d_id, round(greatest(least(list_cosine_similarity(a.e::DOUBLE[], b.e::DOUBLE[]), 1), 0), 6) AS score FROM v a JOIN v b ON a.p = b.p AND a.id <> b.id WHERE a.id % 10 = 0)"""


@queries.add(f"WITH {VECTORS} SELECT t_id, d_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY t_id ORDER BY score DESC, d_id)::INTEGER AS rank FROM s) WHERE rank <= 5")
def cosine_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.cosine_top(read_table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", 10, 5)


GOWER = """t AS (SELECT * FROM part WHERE p_partkey % 20 = 0), pairs AS (SELECT t.p_partkey AS t_id, d.p_partkey AS d_id, d.p_size AS d_size, d.p_retailprice AS d_price,
  CASE WHEN t.p_type = d.p_type THEN 1.0 ELSE 0.0 END AS kind, 1 - least(abs(t.p_size - d.p_size) / 49.0, 1) AS size, CASE WHEN t.p_retailprice > 0 AND d.p_retailprice > 0 THEN 1 - least(abs(ln(t.p_retailprice) - ln(d.p_retailprice)) / 0.8, 1) END AS price
  FROM t JOIN part d ON t.p_brand = d.p_brand AND t.p_partkey <> d.p_partkey),
  scored AS (SELECT *, round((0.4 * (kind + size) / 2 + CASE WHEN price IS NOT NULL THEN 0.2 * price ELSE 0 END) / (0.4 + CASE WHEN price IS NOT NULL THEN 0.2 ELSE 0 END), 6) AS score FROM pairs),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY t_id ORDER BY score DESC, d_id)::INTEGER AS rank FROM scored WHERE score >= 0.6)"""


def gower(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, sf_dir, "part")
    side = lambda p, df: df.select(*[c(x).alias(f"{p}_{y}") for x, y in (("p_partkey", "id"), ("p_brand", "partition"), ("p_type", "type"), ("p_size", "size"), ("p_retailprice", "price"))])
    return similarity.gower_top(side("t", part.where("p_partkey % 20 = 0")), side("d", part), 49.0, 0.8, keep=("d_size",))


@queries.add(f"WITH {GOWER} SELECT t_id, d_id, score, rank FROM ranked WHERE rank <= 5")
def gower_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gower(spark, sf_dir).select("t_id", "d_id", "score", "rank")


@queries.add(f"""WITH {GOWER}, top AS (SELECT * FROM ranked WHERE rank <= 5), run AS (SELECT t_id, d_size AS value, score, sum(score) OVER (PARTITION BY t_id ORDER BY d_size, score, d_id ROWS UNBOUNDED PRECEDING) AS run, sum(score) OVER (PARTITION BY t_id) AS total FROM top),
  med AS (SELECT t_id, (min(value) FILTER (round(2 * run - total, 9) >= 0) + min(value) FILTER (round(2 * run - total, 9) > 0)) / 2.0 AS m FROM run GROUP BY 1), n AS (SELECT t_id, count(*) AS neighbours, max(score) AS best FROM top GROUP BY 1)
  SELECT t_id, neighbours, CASE WHEN neighbours >= 2 THEN 'SUCCESS' ELSE 'NOT_EVALUABLE_INSUFFICIENT_NEIGHBOURS' END AS status, CASE WHEN neighbours >= 4 AND best >= 0.85 THEN 'HIGH' WHEN neighbours >= 2 AND best >= 0.7 THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
  CASE WHEN neighbours >= 2 THEN ceil(round(m, 6))::BIGINT END AS d_size FROM n JOIN med USING (t_id)""")
def neighbour_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.estimate(gower(spark, sf_dir), ["d_size"])


@queries.add()
def fuzzy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ratios of a brand's different names that share a word; insertion-deletion similarity is not in SQL. Tested
    against plain Python."""
    names = read_table(spark, sf_dir, "part").select("p_brand", similarity.normalise_description(c("p_name")).alias("name")).distinct()
    words = names.select("p_brand", "name", F.explode(F.array_distinct(F.split("name", " "))).alias("word"))
    met = words.withColumnRenamed("name", "t_name").join(words.withColumnRenamed("name", "d_name"), ["p_brand", "word"]).where("t_name < d_name")
    return similarity.fuzzy(met.select("p_brand", "t_name", "d_name").distinct(), "t_name", "d_name")


BOOTSTRAP_DRAWS = 20_000


@queries.add()
def bootstrap_issue_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every material's, at the draws of the blend that the bootstrap is part of. Tested against draws one by one."""
    return rounded(similarity.bootstrap_interval(moves(spark, sf_dir).where("NOT reversal"), "material", "qty", draws=BOOTSTRAP_DRAWS))


# ---- normalisation and formulas


@queries.add(r"""WITH t AS (SELECT p_partkey, lpad(p_partkey::VARCHAR, 18, '0') AS k, ' 00' || p_size || ' ' AS s, CASE p_size % 5 WHEN 0 THEN '19990' || (1 + p_size % 9) || '15' WHEN 1 THEN '15.0' || (1 + p_size % 9) || '.1999' WHEN 2 THEN '1999-0' || (1 + p_size % 9) || '-15T00:00:00' WHEN 3 THEN '00000000' ELSE 'unknown' END AS d,
  CASE p_size % 3 WHEN 0 THEN '1,' || lpad(p_size::VARCHAR, 3, '0') || '.5' WHEN 1 THEN p_size || '.25-' ELSE 'n/a' END AS n FROM part)
  SELECT p_partkey, ltrim(k, '0') AS key, ltrim(trim(s), '0') AS short, CASE WHEN d = '00000000' THEN NULL WHEN regexp_full_match(d, '[0-9]{8}') THEN d[1:4] || '-' || d[5:6] || '-' || d[7:8] WHEN d LIKE '%.%' THEN d[7:10] || '-' || d[4:5] || '-' || d[1:2] WHEN d LIKE '%T%' THEN d[1:10] ELSE d END AS date_text,
  CASE WHEN n LIKE '%-' THEN -TRY_CAST(rtrim(n, '-') AS DOUBLE) ELSE TRY_CAST(replace(n, ',', '') AS DOUBLE) END AS number FROM t""")
def normalised_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, text = c("p_size"), c("p_size").cast("string")
    digit = (1 + size % 9).cast("string")
    d = F.when(size % 5 == 0, F.concat(F.lit("19990"), digit, F.lit("15"))).when(size % 5 == 1, F.concat(F.lit("15.0"), digit, F.lit(".1999"))).when(size % 5 == 2, F.concat(F.lit("1999-0"), digit, F.lit("-15T00:00:00"))).when(size % 5 == 3, "00000000").otherwise("unknown")
    n = F.when(size % 3 == 0, F.concat(F.lit("1,"), F.lpad(text, 3, "0"), F.lit(".5"))).when(size % 3 == 1, F.concat(text, F.lit(".25-"))).otherwise("n/a")
    return read_table(spark, sf_dir, "part").select(
        "p_partkey",
        normalise.key(normalise.pad_key(c("p_partkey").cast("string"))).alias("key"),
        normalise.key(F.concat(F.lit(" 00"), text, F.lit(" "))).alias("short"),
        normalise.date_text(d).alias("date_text"),
        normalise.number(n).cast("double").alias("number"),
    )


KEYWORDS = ["trash", "licensed", "réeux", "100%", "###"]


@queries.add("SELECT doc_id, regexp_matches(lower(text), 'trash|licensed|réeux|100%|###') AS hit FROM documents")
def keyword_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", normalise.like_any(c("text"), KEYWORDS).alias("hit"))


@queries.add(r"""WITH t AS (SELECT doc_id, upper(regexp_replace(trim(text, E' \n\t'), '\s+', ' ', 'g')) AS twin FROM documents WHERE text IS NOT NULL), g AS (SELECT md5(twin) AS twin, count(*) AS copies, min(doc_id) AS first_doc FROM t GROUP BY 1) SELECT first_doc, copies FROM g WHERE copies > 1""")
def text_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    twin = F.md5(normalise.twin_text(c("text")).cast("binary"))  # the digest moves, not the text
    t = read_table(spark, sf_dir, "documents").where("text IS NOT NULL").groupBy(twin.alias("twin")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc"))
    return t.where("copies > 1").select("first_doc", "copies")


NAMES = {"price": "p_retailprice", "size": "p_size", "key": "p_partkey"}
VALUE = formula.parse("max(price * size / (size - 10), min(price, key)) - abs(-size)", set(NAMES))
RISK = formula.parse("price / (size - 10) > 100 and not (key < 50 or size >= 40)", set(NAMES), "condition")


@queries.add(f"SELECT p_partkey, round({formula.to_sql(VALUE, NAMES)}, 6) AS value, {formula.to_sql(RISK, NAMES)} AS risk FROM part")
def kpi_formula(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {k: c(v) for k, v in NAMES.items()}
    return read_table(spark, sf_dir, "part").select("p_partkey", F.round(formula.to_column(VALUE, columns), 6).alias("value"), formula.to_column(RISK, columns).alias("risk"))


@queries.add("SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN least(p_size, 25) END AS low, CASE WHEN p_size % 3 <> 0 THEN greatest(p_size, 25) END AS high, CASE WHEN p_size <> 10 THEN p_retailprice / (p_size - 10) END AS quotient FROM part")
def null_safe_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.when(c("p_size") % 3 != 0, c("p_size"))
    return read_table(spark, sf_dir, "part").select("p_partkey", least_known(size, F.lit(25)).alias("low"), greatest_known(size, F.lit(25)).alias("high"), ratio(c("p_retailprice"), c("p_size") - 10).alias("quotient"))


# ---- events: extensions beyond the planning operators


@queries.add("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value::DECIMAL(18,4))::DOUBLE, 4) AS total FROM events GROUP BY ALL""")
def extension_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(c("value").cast("decimal(18,4)")).cast("double").alias("total"))
    return e.select(c("w.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@queries.add("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, k""")
def extension_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return e.select("user_id", c("w.start").alias("started"), "n")


@queries.add("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) // 10 AS bucket, count(*) AS n FROM events GROUP BY ALL")
def extension_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.floor(F.get_json_object("props", "$.k").try_cast("long") / 10)
    return read_table(spark, sf_dir, "events").groupBy("event_type", k.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@queries.add(f"WITH {MOVES}, m AS (SELECT plant, day, sum(qty) AS q FROM moves GROUP BY ALL) SELECT plant, day, q, sum(q) OVER (PARTITION BY plant ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS week, rank() OVER (PARTITION BY plant ORDER BY q DESC)::INTEGER AS rank FROM m")
def extension_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = moves(spark, sf_dir).groupBy("plant", "day").agg(F.sum("qty").alias("q"))
    return m.select("plant", "day", "q", F.sum("q").over(Window.partitionBy("plant").orderBy("day").rowsBetween(-6, 0)).alias("week"), F.rank().over(Window.partitionBy("plant").orderBy(F.desc("q"))).alias("rank"))
