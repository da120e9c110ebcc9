"""Where queries and their SQL are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partlake.session import read_table

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
        """Register a query under its function's name, with SQL for DuckDB if it can be expressed."""

        def keep(f: Query) -> Query:
            key = name or f.__name__
            if key in self.queries:
                raise ValueError(f"two queries named {key}")
            self.queries[key] = f
            if sql:
                self.sql[key] = sql
            return f

        return keep


#: Goods movements in SQL: material = part, plant = region of the supplier, reversal = returned line.
MOVES = """moves AS (SELECT l_partkey AS material, n_regionkey AS plant, CAST(l_shipdate AS DATE) AS day, l_quantity AS qty,
  l_returnflag = 'R' AS reversal, l_orderkey AS doc, l_linenumber AS line
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""
START, END, AS_OF = "1999-01-01", "2000-12-01", "2000-12-31"
MONTHLY = MOVES + """, monthly AS (SELECT material, plant, date_trunc('month', day)::DATE AS month,
  sum(CASE WHEN reversal THEN -qty ELSE qty END) AS quantity, count(*) AS movements,
  count(*) FILTER (NOT reversal) AS issues, count(*) FILTER (reversal) AS reversals FROM moves GROUP BY ALL)"""
DENSE = MONTHLY + f""", win AS (SELECT * FROM monthly WHERE month BETWEEN DATE '{START}' AND DATE '{END}'),
  dense AS (SELECT k.material, k.plant, m.month, greatest(coalesce(w.quantity, 0), 0)::DOUBLE AS quantity
  FROM (SELECT DISTINCT material, plant FROM win) k
  CROSS JOIN (SELECT unnest(generate_series(DATE '{START}', DATE '{END}', INTERVAL 1 MONTH))::DATE AS month) m
  LEFT JOIN win w ON w.material = k.material AND w.plant = k.plant AND w.month = m.month)"""
STATS = DENSE + """, stats AS (SELECT material, plant, count(*) AS n, count(*) FILTER (quantity <> 0) AS n_nz, sum(quantity) AS total,
  avg(quantity) AS mean_all, stddev_samp(quantity) AS std_all, avg(quantity) FILTER (quantity <> 0) AS mean_nz,
  stddev_samp(quantity) FILTER (quantity <> 0) AS std_nz FROM dense GROUP BY ALL),
  rated AS (SELECT *, n / nullif(n_nz, 0)::DOUBLE AS adi, pow(std_nz / nullif(mean_nz, 0), 2) AS cv2 FROM stats)"""
SERIES = DENSE + ", keyed AS (SELECT material, plant, list(quantity ORDER BY month) AS q FROM dense GROUP BY ALL)"


def moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Goods movements of the driver's tables; the same as MOVES."""
    lines = read_table(spark, sf_dir, "lineitem")
    suppliers = read_table(spark, sf_dir, "supplier").join(read_table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_regionkey")
    return lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("l_partkey").alias("material"),
        F.col("n_regionkey").alias("plant"),
        F.col("l_shipdate").cast("date").alias("day"),
        F.col("l_quantity").alias("qty"),
        (F.col("l_returnflag") == "R").alias("reversal"),
        F.col("l_orderkey").alias("doc"),
        F.col("l_linenumber").alias("line"),
    )


def rounded(df: DataFrame, places: int = 6, nudge: float = 0.0) -> DataFrame:
    """Doubles rounded, so that summation order does not show; ``nudge`` takes values that end in a 5 off the edge."""
    return df.select(*[F.round(F.col(f.name) + nudge, places).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in df.schema.fields])


def day_of(text: str) -> Column:
    return F.lit(text).cast("date")
