"""Matching, evaluation and contract queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partlake.operators import matching, similarity
from partlake.plans.registry import Registry, rounded
from partlake.plans.reports import GOWER, gower
from partlake.session import cut_lineage, read_table

queries = Registry()
c = F.col


@queries.add("""WITH a AS (SELECT * FROM (VALUES ('documents', 'doc_id', 'bigint', true), ('documents', 'text', 'string', false), ('documents', 'lang', 'string', false), ('labels', 'toxic', 'int', false)) t(entity, name, kind, is_key)),
  b AS (SELECT * FROM (VALUES ('documents', 'doc_id', 'bigint', true), ('documents', 'text', 'varchar', false), ('labels', 'toxic', 'int', true), ('labels', 'quality', 'int', false)) t(entity, name, kind, is_key))
  SELECT coalesce(a.entity, b.entity) AS entity, coalesce(a.name, b.name) AS name, CASE WHEN a.name IS NULL THEN 'ADDED' WHEN b.name IS NULL THEN 'REMOVED' WHEN a.kind <> b.kind THEN 'TYPE_CHANGED' ELSE 'KEY_CHANGED' END AS drift
  FROM a FULL JOIN b ON a.entity = b.entity AND a.name = b.name WHERE a.name IS NULL OR b.name IS NULL OR a.kind <> b.kind OR a.is_key <> b.is_key""")
def contract_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "entity string, name string, kind string, is_key boolean"
    old = spark.createDataFrame([("documents", "doc_id", "bigint", True), ("documents", "text", "string", False), ("documents", "lang", "string", False), ("labels", "toxic", "int", False)], schema)
    new = spark.createDataFrame([("documents", "doc_id", "bigint", True), ("documents", "text", "varchar", False), ("labels", "toxic", "int", True), ("labels", "quality", "int", False)], schema)
    return matching.contract_drift(old, new)


@queries.add("""WITH m AS (SELECT p_partkey AS material, CASE WHEN p_size % 3 = 0 THEN 'TIER ' || p_size % 4 END AS tier FROM part WHERE p_size < 40), f AS (SELECT DISTINCT l_partkey AS material, 'FROM LEDGER' AS tier FROM lineitem WHERE l_quantity > 48)
  SELECT p_partkey AS material, coalesce(m.tier, f.tier) AS tier, CASE WHEN m.tier IS NOT NULL THEN 'REPORT' WHEN f.tier IS NOT NULL THEN 'FALLBACK' ELSE 'NONE' END AS source FROM part LEFT JOIN m ON m.material = p_partkey LEFT JOIN f ON f.material = p_partkey""")
def criticality_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, sf_dir, "part")
    first = part.where("p_size < 40").select(c("p_partkey").alias("material"), F.when(c("p_size") % 3 == 0, F.concat(F.lit("TIER "), (c("p_size") % 4).cast("string"))).alias("tier"))
    second = read_table(spark, sf_dir, "lineitem").where("l_quantity > 48").select(c("l_partkey").alias("material"), F.lit("FROM LEDGER").alias("tier")).distinct()
    return matching.with_fallback(part.select(c("p_partkey").alias("material")), ["material"], "tier", [("REPORT", first), ("FALLBACK", second)])


PLANS = """plans AS (SELECT o_orderkey AS plan, o_orderkey // 200 AS part, o_orderkey % 60 AS a, o_orderkey % 70 AS b FROM orders WHERE o_orderkey % 2 = 0), items AS (SELECT o_orderkey AS item, o_orderkey // 200 AS part, o_orderkey % 55 AS link FROM orders WHERE o_orderkey % 2 = 1),
  hits AS (SELECT DISTINCT plan, item FROM (SELECT plan, part, a AS link FROM plans UNION ALL SELECT plan, part, b FROM plans) p JOIN items USING (part, link)), claimed AS (SELECT item, min(plan) AS plan FROM hits GROUP BY 1)"""


@queries.add(f"WITH {PLANS} SELECT p.plan, count(c.item) AS items, CASE WHEN count(c.item) > 0 THEN 'MATCHED' ELSE 'UNMATCHED' END AS outcome FROM plans p LEFT JOIN claimed c USING (plan) GROUP BY 1")
def plan_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, k = read_table(spark, sf_dir, "orders"), c("o_orderkey")
    plans = orders.where(k % 2 == 0).select(k.alias("plan"), F.floor(k / 200).alias("part"), F.array(k % 60, k % 70).alias("links"))
    items = orders.where(k % 2 == 1).select(k.alias("item"), F.floor(k / 200).alias("part"), (k % 55).alias("link"))
    return matching.claim(plans, items, "plan", "item", ["part"])


@queries.add(f"""WITH {GOWER}, top AS (SELECT t_id, d_id, rank FROM ranked WHERE rank <= 5), gone AS (SELECT p_partkey AS d_id FROM part WHERE p_size % 4 = 0) SELECT t_id, d_id, rank FROM top WHERE d_id NOT IN (SELECT d_id FROM gone)""")
def exclusions_after_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = read_table(spark, sf_dir, "part").where("p_size % 4 = 0").select(c("p_partkey").alias("d_id"))
    return gower(spark, sf_dir).join(gone, "d_id", "left_anti").select("t_id", "d_id", "rank")


RELEVANT = """rel AS (SELECT t.p_partkey AS t_id, d.p_partkey AS d_id FROM part t JOIN part d ON t.p_brand = d.p_brand AND t.p_type = d.p_type AND t.p_partkey <> d.p_partkey WHERE t.p_partkey % 20 = 0)"""


@queries.add(f"""WITH {GOWER}, {RELEVANT}, h AS (SELECT r.t_id, count(*) AS shown, count(rel.d_id) AS hits FROM ranked r LEFT JOIN rel ON rel.t_id = r.t_id AND rel.d_id = r.d_id WHERE rank <= 5 GROUP BY 1), n AS (SELECT t_id, count(*) AS relevant FROM rel GROUP BY 1)
  SELECT t_id, round(coalesce(hits, 0) / coalesce(shown, 1)::DOUBLE, 6) AS precision, round(coalesce(hits, 0) / relevant::DOUBLE, 6) AS recall FROM n LEFT JOIN h USING (t_id)""")
def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, (t, d) = cut_lineage(gower(spark, sf_dir).select("t_id", "d_id", "rank")), classed(spark, sf_dir)
    return rounded(similarity.precision_recall(found, similarity.same_class(found, t, d, CLASS), 5, similarity.class_totals(t, d, CLASS)))


CLASS = ["p_brand", "p_type"]


def classed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Targets and donors with what makes two of them relevant to each other."""
    part = read_table(spark, sf_dir, "part").select("p_partkey", *CLASS)
    return part.where("p_partkey % 20 = 0").withColumnRenamed("p_partkey", "t_id"), part.withColumnRenamed("p_partkey", "d_id")


@queries.add(f"""WITH {GOWER}, {RELEVANT}, g AS (SELECT unnest([0.6, 0.7, 0.8, 0.9]::DOUBLE[]) AS threshold), j AS (SELECT r.score, rel.d_id IS NOT NULL AS hit, r.t_id FROM ranked r LEFT JOIN rel ON rel.t_id = r.t_id AND rel.d_id = r.d_id WHERE rank <= 5)
  SELECT threshold, count(*) AS admitted, count(*) FILTER (hit) AS hits, count(DISTINCT t_id) AS targets FROM g JOIN j ON score >= threshold GROUP BY 1""")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cut_lineage(gower(spark, sf_dir).select("t_id", "d_id", "score"))
    return matching.threshold_sweep(found, similarity.same_class(found, *classed(spark, sf_dir), CLASS), [0.6, 0.7, 0.8, 0.9])


@queries.add("""WITH t AS (SELECT p_partkey AS t_id, p_brand AS t_partition FROM part WHERE p_partkey % 100 = 0), d AS (SELECT p_partkey AS d_id, p_brand AS partition, p_size % 5 <> 0 AS active, p_size AS history FROM part)
  SELECT t_id, CASE WHEN t_id = d_id THEN 'SAME_MATERIAL' WHEN NOT active THEN 'INACTIVE' WHEN t_partition <> partition THEN 'OTHER_CRITICALITY' WHEN history < 12 THEN 'SHORT_HISTORY' ELSE 'ELIGIBLE' END AS reason, count(*) AS n FROM t CROSS JOIN d GROUP BY ALL""")
def rejection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, sf_dir, "part")
    targets = part.where("p_partkey % 100 = 0").select(c("p_partkey").alias("t_id"), c("p_brand").alias("t_partition"))
    donors = part.select(c("p_partkey").alias("d_id"), c("p_brand").alias("d_partition"), (c("p_size") % 5 != 0).alias("d_active"), c("p_size").alias("d_history"))
    return matching.rejection_counts(targets, donors, 12)


@queries.add("""WITH r AS (SELECT l_orderkey AS k, sum(l_quantity) AS qty FROM lineitem GROUP BY 1), x AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE (o_custkey % 60)::DOUBLE END AS qty FROM orders WHERE o_orderkey % 3 <> 0),
  m AS (SELECT CASE WHEN r.k IS NULL THEN 'MISSING_HERE' WHEN x.k IS NULL THEN 'MISSING_IN_REPORT' WHEN x.qty IS NULL THEN 'NO_REPORT_VALUE' WHEN abs(r.qty - x.qty) > 5 THEN 'QUANTITY_DIFFERS' ELSE 'EQUAL' END AS reason FROM r FULL JOIN x ON r.k = x.k)
  SELECT reason, count(*) AS n FROM m GROUP BY 1""")
def report_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    ours = read_table(spark, sf_dir, "lineitem").groupBy(c("l_orderkey").alias("k")).agg(F.sum("l_quantity").alias("qty"))
    theirs = read_table(spark, sf_dir, "orders").where("o_orderkey % 3 <> 0").select(c("o_orderkey").alias("k"), F.when(c("o_orderkey") % 10 != 0, (c("o_custkey") % 60).cast("double")).alias("qty"))
    return matching.mismatch_reasons(ours, theirs, "k", "qty", 5.0)
