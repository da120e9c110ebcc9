"""Summaries: several groupings in one pass, comparisons with a baseline, calendar activity, working capital."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partlake.functions.semantics import ratio


def facet_counts(rows: DataFrame, facets: list[str]) -> DataFrame:
    """Counts by each of several columns over one scan (grouping sets): facet, value, n; total is a facet of its own."""
    short = rows.select(*[F.col(f).cast("string").alias(f) for f in facets])
    stacked = F.explode(F.array(F.struct(F.lit("total").alias("facet"), F.lit(None).cast("string").alias("value")), *[F.struct(F.lit(f).alias("facet"), F.col(f).alias("value")) for f in facets]))
    return short.select(stacked.alias("x")).groupBy("x.facet", "x.value").agg(F.count(F.lit(1)).alias("n"))


def compare_metric(rows: DataFrame, before: str, after: str) -> DataFrame:
    """Counts of both, missing on either side, averages, delta, and the mean row-wise change over non-zero baselines."""
    b, a = F.col(before), F.col(after)
    both = b.isNotNull() & a.isNotNull()
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(both).alias("compared"),
        F.count_if(b.isNull()).alias("missing_before"),
        F.count_if(a.isNull()).alias("missing_after"),
        F.avg(F.when(both, b)).alias("avg_before"),
        F.avg(F.when(both, a)).alias("avg_after"),
        F.avg(F.when(both, a - b)).alias("avg_delta"),
        F.avg(F.when(both & (b != 0), (a - b) / b * 100)).alias("pct_change"),
        F.count_if(both & (a > b)).alias("increased"),
        F.count_if(both & (a < b)).alias("decreased"),
    )


def by_month(events: DataFrame, day: Column, start: str, end: str, *aggregates: Column) -> DataFrame:
    """Aggregates for every calendar month of a range, empty months as zeros."""
    own = events.where((day >= F.lit(start).cast("date")) & (day < F.add_months(F.lit(end).cast("date"), 1))).groupBy(F.trunc(day, "month").alias("month")).agg(*aggregates)
    spine = events.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 1 month"))).alias("month"))
    return spine.join(own, "month", "left").na.fill(0)


def with_change(rows: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """Change against the previous row where both exist."""
    before = F.lag(value).over(Window.partitionBy(*key).orderBy(order))
    return rows.withColumn("change", F.col(value) - before).withColumn("change_pct", ratio(F.col(value) - before, before) * 100)


def working_capital(rows: DataFrame) -> DataFrame:
    """Value of what a change ties up (delta, price, fx): rows without all three are counted, not valued."""
    usable = F.col("delta").isNotNull() & F.col("price").isNotNull() & F.col("fx").isNotNull()
    worth = F.col("delta") * F.col("price") * F.col("fx")
    return rows.agg(
        F.count_if(usable).alias("included"),
        F.count_if(~usable).alias("excluded"),
        F.sum(F.when(usable, worth)).alias("net"),
        F.sum(F.when(usable & (worth > 0), worth)).alias("tied_up"),
        F.sum(F.when(usable & (worth < 0), worth)).alias("released"),
    )


def nearest_rank(rows: DataFrame, key: list[str], value: Column, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Nearest-rank percentiles by key, not interpolated: the value at position ceil(p * n)."""
    w = Window.partitionBy(*key)
    ranked = rows.select(*key, value.alias("v")).where("v IS NOT NULL")
    ranked = ranked.withColumn("k", F.row_number().over(w.orderBy("v"))).withColumn("n", F.count(F.lit(1)).over(w))
    at = lambda p: F.max(F.when(F.col("k") == F.greatest(F.ceil(F.round(F.lit(p) * F.col("n"), 9)), F.lit(1)), F.col("v")))
    return ranked.groupBy(*key).agg(at(low).alias("low"), at(high).alias("high"), F.max("n").alias("n"))


def mode_first(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """The commonest value of each key, the least of equals."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(*key).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias("mode"), F.max("n").alias("n"))


def reconcile(rows: DataFrame, computed: str, reference: str, tolerance: float) -> DataFrame:
    """Difference in percent of the reference, and whether it is within tolerance; no reference, no verdict."""
    c, r = F.col(computed), F.col(reference)
    gap = F.abs(c - r)
    pct = F.when(r == 0, F.when(gap > 0, 100.0).otherwise(0.0)).otherwise(gap / F.abs(r) * 100)
    status = F.when(r.isNull(), "REFERENCE_UNAVAILABLE").when(F.col("pct") <= tolerance, "RECONCILED").otherwise("OUT_OF_TOLERANCE")
    return rows.withColumn("difference", gap).withColumn("pct", pct).withColumn("status", status)
