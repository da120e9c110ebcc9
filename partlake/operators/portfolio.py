"""Reports over one row for each material and plant: filters, facets, values, risks, snapshots, paging, batches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partlake.functions.semantics import known, ratio
from partlake.operators.kpi import facet_counts
from partlake.session import cut_lineage

c = F.col
#: Fixed policy values: an open status, named tiers, and a price that is none.
OPEN = ["READY_FOR_REVIEW", "PENDING_APPROVAL", "HELD", "RETURNED"]
TIERS = {"CRITICAL": "Critical", "IMPACT": "High", "INSURANCE": "Medium"}
TOKEN_PRICE = 1.0


def level(tier: Column) -> Column:
    """The display level of a criticality: the three named tiers, Low for everything else."""
    out = F.lit("Low")
    for name, shown in TIERS.items():
        out = F.when(tier == name, shown).otherwise(out)
    return out


def risk(status: Column, tier: Column) -> Column:
    """High for an open row of the highest tier, Medium for other open ones, Low for the rest."""
    opened = F.coalesce(status.isin(OPEN), F.lit(False))
    return F.when(opened & (tier == "CRITICAL"), "High").when(opened, "Medium").otherwise("Low")


def value_change(rows: DataFrame) -> DataFrame:
    """Adds ``value_change``: what a new reorder point releases (above 0) or ties up; null where it cannot be said."""
    fine = (c("status") != "NOT_EVALUABLE") & known(c("unit_price"), c("current_rop"), c("recommended_rop"))
    return rows.withColumn("value_change", F.when(fine, c("unit_price") * (c("current_rop") - c("recommended_rop"))))


def value_order() -> list[Column]:
    """Released first, then tied up, then no change, then unknown; in each the largest amount first."""
    v = c("value_change")
    group = F.when(v > 0, 0).when(v < 0, 1).when(v == 0, 2).otherwise(3)
    return [group.asc(), F.abs(v).desc_nulls_last()]


def filtered(rows: DataFrame, **wanted) -> DataFrame:
    """Rows that pass every filter given; a filter that is None does not apply.

    By equality: status, plant, demand_class, is_oar, confidence, criticality, circuit. By set: statuses, plants. By text:
    search (in material or description). By level or risk: criticality_level, risk_level. By number or day: price_from,
    price_to, usage_from, usage_to, generated_from, generated_to (inclusive). By presence: has_price, has_current,
    has_recommended. By change: value_change (released or tied_up).
    """
    tests: dict[str, object] = {x: (lambda v, x=x: c(x) == v) for x in ("status", "plant", "demand_class", "is_oar", "confidence", "criticality", "circuit")}
    tests |= {"statuses": lambda v: c("status").isin(v), "plants": lambda v: c("plant").isin(v)}
    tests["search"] = lambda v: F.contains(F.lower(c("material").cast("string")), F.lit(v.lower())) | F.contains(F.lower("description"), F.lit(v.lower()))
    tests |= {"criticality_level": lambda v: level(c("criticality")) == v, "risk_level": lambda v: risk(c("status"), c("criticality")) == v}
    for name, column in (("price", "unit_price"), ("usage", "usage"), ("generated", "generated")):
        tests |= {f"{name}_from": lambda v, x=column: c(x) >= v, f"{name}_to": lambda v, x=column: c(x) <= v}
    for name, column in (("has_price", "unit_price"), ("has_current", "current_rop"), ("has_recommended", "recommended_rop")):
        tests[name] = lambda v, x=column: c(x).isNotNull() == F.lit(v)
    tests["value_change"] = lambda v: c("value_change") > 0 if v == "released" else c("value_change") < 0
    if unknown := wanted.keys() - tests.keys():
        raise ValueError(f"no such filters: {sorted(unknown)}")
    used = [tests[name](value) for name, value in wanted.items() if value is not None]
    return rows.where(reduce(lambda a, b: a & b, used)) if used else rows


def summary(rows: DataFrame) -> DataFrame:
    """Counts by status, criticality, circuit, risk and plant, and of all, in one pass: facet, value, n."""
    shown = rows.select("status", "criticality", "circuit", "plant", risk(c("status"), c("criticality")).alias("risk"))
    return facet_counts(shown, ["status", "criticality", "circuit", "risk", "plant"])


def value_at_stake(rows: DataFrame) -> DataFrame:
    """Sum of price times the change of safety stock over rows that have all three, and how many those are."""
    worth = c("unit_price") * (c("current_ss") - c("recommended_ss"))
    return rows.agg(F.sum(worth).alias("value"), F.count(worth).alias("priced"), F.count(F.lit(1)).alias("rows"))


def on_hand(stock: DataFrame) -> DataFrame:
    """Stock of a key over its locations; a location without a quantity makes the sum unknown."""
    blank = F.count_if(c("quantity").isNull())
    return stock.groupBy("material", "plant").agg(F.when(blank == 0, F.sum("quantity")).alias("on_hand"))


def inventory_value(rows: DataFrame, stock: DataFrame, rates: dict[str, float], token: float = TOKEN_PRICE) -> DataFrame:
    """What is held and what safety stock is worth in one currency, and how many are below their reorder point.

    ``rows``: material, plant, unit_price, currency, current_ss, current_rop; ``stock``: material, plant, quantity. Rows
    without a rate, with a price up to ``token``, or with unknown or negative stock are not valued; those without a
    reorder point are not judged, and none judged gives null, not 0.
    """
    rate = F.lit(None).cast("double")
    for name, x in rates.items():
        rate = F.when(c("currency") == name, F.lit(x)).otherwise(rate)
    both = rows.join(on_hand(stock), ["material", "plant"], "left").withColumn("_worth", F.when(c("unit_price") > token, c("unit_price") * rate))
    held = F.when(c("on_hand") >= 0, c("on_hand") * c("_worth"))
    safe = F.when(c("current_ss") >= 0, c("current_ss") * c("_worth"))
    judged = F.coalesce((c("on_hand") >= 0) & (c("current_rop") > 0), F.lit(False))
    below = F.count_if(judged & (c("on_hand") < c("current_rop")))
    return both.agg(
        F.sum(held).alias("inventory_value"), F.count(held).alias("inventory_priced"), F.sum(safe).alias("safety_value"), F.count(safe).alias("safety_priced"),
        F.when(F.count_if(judged) > 0, below).alias("below_reorder"), F.count_if(judged).alias("judged"),
    )


def stockout_counts(usage: DataFrame, stock: DataFrame, lead: DataFrame, recommended: DataFrame, as_of: Column, window: int = 90, lookback: int = 730) -> DataFrame:
    """at_risk, evaluated and insufficient keys of those issued within the look-back.

    A key is at risk if its stock is under its daily use times its lead time. ``usage``: material, plant, used (in the
    window), last_issue; ``stock``: material, plant, quantity; ``lead``: material, plant, lead_days; ``recommended``:
    material, plant. What lacks use, stock or lead time is insufficient, and so are recommended keys of plants without any
    usage.
    """
    key = ["material", "plant"]
    live = usage.where(c("last_issue") >= F.date_sub(as_of, lookback))
    facts = live.join(on_hand(stock), key, "left").join(lead, key, "left")
    fine = F.coalesce((c("used") > 0) & (c("on_hand") >= 0) & (c("lead_days") > 0), F.lit(False))
    counted = facts.agg(F.count(F.lit(1)).alias("_all"), F.count_if(fine).alias("evaluated"), F.count_if(fine & (c("on_hand") < c("used") / window * c("lead_days"))).alias("at_risk"))
    silent = recommended.select(*key).distinct().join(usage.select("plant").distinct(), "plant", "left_anti").agg(F.count(F.lit(1)).alias("_silent"))
    return counted.crossJoin(silent).select("at_risk", "evaluated", (c("_all") - c("evaluated") + c("_silent")).alias("insufficient"))  # one row each


def distinct_by_month(events: DataFrame, day: str) -> DataFrame:
    """Different (material, plant) and different events of each month that has any."""
    return events.groupBy(F.trunc(day, "month").alias("month")).agg(F.countDistinct(F.struct("material", "plant")).alias("material_plants"), F.countDistinct("event").alias("events"))


def source_activity(moves: DataFrame) -> DataFrame:
    """Movements, issues, reversals and moved keys of each plant and month."""
    own = moves.groupBy("plant", F.trunc("day", "month").alias("month"))
    return own.agg(F.count(F.lit(1)).alias("movements"), F.count_if(~c("reversal")).alias("issues"), F.count_if("reversal").alias("reversals"), F.countDistinct("material").alias("materials"))


def conversion_counts(rows: DataFrame) -> DataFrame:
    """How many on-demand rows should be planned, should not, cannot be judged, and have been converted. ``rows``: is_oar,
    verdict, adopted."""
    own = c("is_oar")
    return rows.agg(
        F.count_if(own).alias("on_demand"), F.count_if(own & (c("verdict") == "YES")).alias("wanted"), F.count_if(own & (c("verdict") == "NO")).alias("not_wanted"),
        F.count_if(own & (c("verdict") == "UNKNOWN")).alias("unknown"), F.count_if(own & (c("verdict") == "YES") & c("adopted")).alias("converted"),
    )


def stage_counts(rows: DataFrame, stages: dict[str, list[str]]) -> DataFrame:
    """Rows in each stage, stages without rows as 0: stage, n. ``stages``: the statuses of each."""
    named = F.lit(None).cast("string")
    for name, statuses in stages.items():
        named = F.when(c("status").isin(statuses), name).otherwise(named)
    counted = rows.groupBy(named.alias("stage")).agg(F.count(F.lit(1)).alias("n"))
    every = rows.sparkSession.createDataFrame([(x,) for x in stages], "stage string")
    return every.join(F.broadcast(counted.where("stage IS NOT NULL")), "stage", "left").select("stage", F.coalesce("n", F.lit(0)).alias("n"))  # a row for each stage


def stock_levels(rows: DataFrame) -> DataFrame:
    """Average current and recommended levels over rows that have both."""
    both = lambda x, of: F.avg(F.when(known(c(f"current_{x}"), c(f"recommended_{x}")), c(f"{of}_{x}")))
    return rows.agg(*[both(x, of).alias(f"{of}_{x}") for x in ("ss", "rop") for of in ("current", "recommended")])


def forecast_against_actual(paths: DataFrame, start: str, end: str) -> DataFrame:
    """Forecast and actual demand of every month of a range, from the first step of each path; months without stay unknown.

    ``paths``: material, plant, month, step, predicted, actual. Adds the months' mean absolute error and bias (a share of
    actual demand, unknown without any).
    """
    inside = paths.where((c("step") == 0) & c("month").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    gap = c("predicted") - c("actual")
    own = inside.groupBy("month").agg(
        F.sum("predicted").alias("forecast"), F.sum("actual").alias("actual"), F.countDistinct(F.struct("material", "plant")).alias("keys"),
        F.avg(F.abs(gap)).alias("mae"), ratio(F.sum(gap), F.sum("actual")).alias("bias"),
    )
    spine = paths.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 1 month"))).alias("month"))
    return spine.join(own, "month", "left").withColumn("keys", F.coalesce("keys", F.lit(0)))


def capture(history: DataFrame, fresh: DataFrame) -> DataFrame:
    """A month's figures appended to their history, as a new revision where they differ from the last one, else not at all.

    Both have month and payload (canonical JSON); the history also revision. Capturing the same twice changes nothing.
    """
    last = history.groupBy("month").agg(F.max("revision").alias("_revision"), F.max_by("payload", "revision").alias("_payload"))
    both = fresh.join(last, "month", "left").where(~c("payload").eqNullSafe(c("_payload")))
    return history.unionByName(both.select("month", "payload", (F.coalesce("_revision", F.lit(0)) + 1).cast("int").alias("revision")).select(*history.columns))


def page_and_total(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """The rows of one page, each with the number of all rows; an empty page has none to carry it."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))  # one row


def key_ranges(weights: DataFrame, key: str, weight: str, most: int) -> DataFrame:
    """Contiguous key ranges (low, high, keys, weight) of about equal weight: each begins a new multiple of ``most``.

    A running sum places keys, so ranges need no walk: one holds less than ``most`` before its last key. A key heavier than
    that ends its range. The sum is taken by chunks of the sorted keys, whose totals alone meet in one task.
    """
    spark = weights.sparkSession
    chunks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parted = weights.select(c(key).alias("k"), c(weight).cast("long").alias("w")).repartitionByRange(chunks, "k").withColumn("p", F.spark_partition_id())
    parted = cut_lineage(parted)  # ranges are drawn from a sample: once for both uses
    inside = parted.withColumn("upto", F.sum("w").over(Window.partitionBy("p").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)))
    totals = parted.groupBy("p").agg(F.sum("w").alias("total"))  # a row for each chunk
    before = totals.withColumn("before", F.coalesce(F.sum("total").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = inside.join(F.broadcast(before.select("p", "before")), "p").withColumn("range", F.floor((c("before") + c("upto") - c("w")) / most))
    return placed.groupBy("range").agg(F.min("k").alias("low"), F.max("k").alias("high"), F.count(F.lit(1)).alias("keys"), F.sum("w").alias("weight")).drop("range")
