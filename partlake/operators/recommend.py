"""Recommendations: which formula a material goes by, what it proposes against what is set, and how repairs stand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partlake.functions.semantics import aging_band, known, ratio
from partlake.operators.blend import max_floor

c = F.col
#: Demand classes whose current levels stand, and the verdicts of a coding screen in their order.
BASELINE_CLASSES = ["SMOOTH", "ERRATIC"]
VERDICTS = ["MISCODED_REPAIRABLE", "UNCLEAR", "CONSUMABLE_FOR_REPAIR", "REPAIR_SERVICE", "UNSCREENED"]
CONFIDENCE = ["LOW", "MEDIUM", "HIGH"]
LEVELS = ["ss", "rop", "max_stock"]


def route(rows: DataFrame) -> DataFrame:
    """Adds status and value of each level by the formula that applies.

    In order: on-demand materials are deferred (their levels come from similar ones), then those without enough history,
    without a lead time, obsolete, without a service level or a forecast. For smooth and erratic demand a level that is set
    today stands, level by level. ``rows``: is_oar, demand_class, criticality, lead_days, z, rate, and calc_ and
    current_ levels.
    """
    blocked = (
        F.when(c("is_oar"), "DEFERRED_TO_OAR")
        .when(c("demand_class") == "UNCLASSIFIED", "NOT_EVALUABLE_NO_HISTORY")
        .when(c("criticality") == "OBSOLETE", "NOT_APPLICABLE_OBSOLETE")
        .when(c("lead_days").isNull(), "NOT_EVALUABLE_LEAD_TIME")
        .when(c("z").isNull(), "NOT_EVALUABLE_SERVICE_LEVEL_UNSET")
    )
    routed, deferred = rows, c("is_oar") | c("demand_class").isin("UNCLASSIFIED") | F.coalesce(c("criticality") == "OBSOLETE", F.lit(False))
    for level in LEVELS:
        kept = c("demand_class").isin(BASELINE_CLASSES) & c(f"current_{level}").isNotNull() & ~deferred
        own = F.coalesce(blocked, F.when(F.lit(level != "ss") & c("rate").isNull(), "NOT_EVALUABLE_INVALID_FORECAST"), F.when(c(f"calc_{level}").isNull(), "NOT_EVALUABLE_INPUT"), F.lit("SUCCESS"))
        status = F.when(kept, "SUCCESS_FROM_CURRENT_VALUE").otherwise(own)
        value = F.when(kept, c(f"current_{level}").cast("long")).when(own == "SUCCESS", F.ceil(c(f"calc_{level}")))
        routed = routed.withColumn(f"{level}_status", status).withColumn(level, value)
    return routed


def deltas(rows: DataFrame) -> DataFrame:
    """Adds delta_ and pct_ of each level, proposed against current, and impact: what is missing for a comparison, or AVAILABLE."""
    none = lambda prefix: F.coalesce(*[c(f"{prefix}{x}") for x in LEVELS]).isNull()
    out = rows
    for level in LEVELS:
        delta = c(level) - c(f"current_{level}")
        out = out.withColumn(f"delta_{level}", delta).withColumn(f"pct_{level}", ratio(delta, c(f"current_{level}")) * 100)
    return out.withColumn("impact", F.when(none(""), "NOT_EVALUABLE_MISSING_RECOMMENDED").when(none("current_"), "NOT_EVALUABLE_MISSING_CURRENT").otherwise("AVAILABLE"))


def assemble(normal: DataFrame, on_demand: DataFrame, newest: DataFrame | None = None) -> DataFrame:
    """One recommendation for each material and plant: routed ones, with on-demand ones filled from their estimates.

    ``on_demand``: material, plant, est_ss, est_rop, est_max_stock, confidence. An estimate's maximum is at least point plus
    safety stock. ``newest``: material, plant of protected rows, which are left out. status: READY_FOR_REVIEW if any level is
    proposed, else NOT_EVALUABLE.
    """
    both = normal.join(on_demand, ["material", "plant"], "left")
    est = {"ss": c("est_ss"), "rop": c("est_rop"), "max_stock": max_floor(c("est_rop"), c("est_ss"), c("est_max_stock"))}
    deferred = c("is_oar")
    for level in LEVELS:
        both = both.withColumn(level, F.when(deferred, est[level]).otherwise(c(level)))
        both = both.withColumn(f"{level}_status", F.when(deferred & est[level].isNotNull(), "SUCCESS_FROM_SIMILAR").otherwise(c(f"{level}_status")))
    if newest is not None:
        both = both.join(newest.select("material", "plant"), ["material", "plant"], "left_anti")
    shown = F.when(F.coalesce(*[c(x) for x in LEVELS]).isNotNull(), "READY_FOR_REVIEW").otherwise("NOT_EVALUABLE")
    return deltas(both).withColumn("circuit_of", F.when(deferred, "OAR").otherwise("NORMAL")).withColumn("status", shown)


def new_item_price(valuations: DataFrame, wanted: str = "NEW", token: float = 1.0) -> DataFrame:
    """The price of a new item by material and plant: of the wanted valuation type where stock is split by type, else any.

    The highest of several. ``missing`` names why there is none: NO_NEW_VALUATION, NOT_VALUED, or TOKEN_VALUE for a price up to
    ``token``. ``valuations``: material, plant, kind (blank: not split), price.
    """
    kind = F.nullif(F.upper(F.trim("kind")), F.lit(""))
    one = valuations.groupBy("material", "plant").agg(F.max(kind.isNotNull()).alias("split"), F.max(F.when(kind == wanted, c("price"))).alias("_new"), F.max("price").alias("_any"))
    value = F.when(c("split"), c("_new")).otherwise(c("_any"))
    missing = F.when(value.isNull(), F.when(c("split"), "NO_NEW_VALUATION").otherwise("NOT_VALUED")).when(value <= token, "TOKEN_VALUE")
    return one.select("material", "plant", F.when(value > token, value).alias("price"), value.alias("value"), missing.alias("missing"))


def repairable(universe: DataFrame, lines: DataFrame, requests: DataFrame, as_of: Column) -> DataFrame:
    """Whether a repairable unit exists for each (material, plant) of the universe, and where: in stock, on a repair order, or
    requested.

    ``universe``: material, plant, stock, usable (null: its condition is unknown), locations; ``lines``: material, plant, qty,
    due, dispatched; ``requests``: material, plant, qty, requested_on. Stock counts if its usable part does, or all of it where the
    condition is unknown; unknown stock stays unknown.
    """
    key = ["material", "plant"]
    stock = universe.groupBy(*key).agg(F.sum("stock").alias("stock"), F.sum("usable").alias("usable"), F.sum("locations").alias("locations"))
    repairs = lines.groupBy(*key).agg(F.count(F.lit(1)).alias("open_lines"), F.sum("qty").alias("under_repair"), F.min("due").alias("soonest_due"), F.count_if(c("due") < as_of).alias("overdue"))
    asked = requests.groupBy(*key).agg(F.count(F.lit(1)).alias("requests"), F.min("requested_on").alias("oldest_request"))
    both = stock.join(repairs, key, "left").join(asked, key, "left")
    found = F.array_compact(F.array(F.when(F.coalesce("usable", "stock") > 0, "STOCK"), F.when(c("open_lines") > 0, "ON_REPAIR_ORDER"), F.when(c("requests") > 0, "REPAIR_REQUESTED")))
    zero = lambda x, kind: F.coalesce(x, F.lit(0)).cast(kind).alias(x)
    return both.select(*key, "stock", "usable", "locations", zero("open_lines", "long"), zero("under_repair", "double"), "soonest_due", zero("overdue", "long"), zero("requests", "long"), "oldest_request", (F.size(found) > 0).alias("exists"), F.array_join(found, "+").alias("sources"))


def ranked_candidates(candidates: DataFrame) -> DataFrame:
    """Adds rank for review: corroborated first, then by verdict, confidence, number of lines, material.

    ``candidates``: material, corroborated, verdict, confidence (null: none), lines. The rank is taken over all rows, of which a
    screen has few.
    """
    place = lambda names, x: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, names)), x), F.lit(0)), F.lit(len(names) + 1))
    sure = F.when(c("confidence").isNull(), 0).otherwise(F.array_position(F.array(*map(F.lit, CONFIDENCE)), c("confidence")))
    order = Window.orderBy(c("corroborated").desc(), place(VERDICTS, c("verdict")), sure.desc(), c("lines").desc(), "material")
    return candidates.withColumn("rank", F.row_number().over(order))


def procurement_status(received: Column, ordered: Column, line_state: Column) -> Column:
    """A line's closed state unless all has come, else OPEN, PARTIALLY_RECEIVED or RECEIVED by its quantities."""
    full = F.coalesce((ordered > 0) & (received >= ordered), F.lit(False))
    return F.when(line_state.isNotNull() & ~full, line_state).when(received <= 0, "OPEN").when((ordered > 0) & (received < ordered), "PARTIALLY_RECEIVED").otherwise("RECEIVED")


def utilisation_status(issued: Column, received: Column, before_history: Column) -> Column:
    return F.when(before_history, "BEFORE_ISSUE_HISTORY").when(issued <= 0, "NOT_ISSUED").when(issued < received, "PARTIALLY_ISSUED").otherwise("FULLY_ISSUED")


def aged(rows: DataFrame, today: Column, fast: int = 90, slow: int = 365, threshold: int = 30) -> DataFrame:
    """Rows of an earlier day brought to today: ages, band and the flag of goods received and not issued; quantities stay.

    ``rows``: last_movement_date, last_issue_date, receipt_date, outstanding.
    """
    since = lambda x: F.datediff(today, c(x))
    out = rows.withColumn("days_since_movement", since("last_movement_date")).withColumn("days_since_issue", since("last_issue_date")).withColumn("receipt_days", since("receipt_date"))
    return out.withColumn("band", aging_band(c("days_since_issue"), fast, slow)).withColumn("receipt_flag", F.coalesce((c("outstanding") > 0) & (c("receipt_days") >= threshold), F.lit(False)))


def refusals(scored: DataFrame, floor: float, limit: int = 10) -> DataFrame:
    """The best-scoring refused donors of each target with the reason, in a fixed order. ``scored``: t_id, d_id, score,
    identity (a status), evidence (features compared)."""
    reason = F.when(c("score").isNull(), "NO_DIMENSION").when(~c("identity").startswith("CONFIRMED"), c("identity")).when(c("evidence") < 2, "TOO_LITTLE_EVIDENCE").when(c("score") < floor, "BELOW_FLOOR")
    refused = scored.withColumn("reason", reason).where("reason IS NOT NULL")
    rank = F.row_number().over(Window.partitionBy("t_id").orderBy(F.desc_nulls_last("score"), "d_id"))
    return refused.withColumn("rank", rank).where(c("rank") <= limit)


def register_statistics(lines: DataFrame) -> DataFrame:
    """Lines, units, overdue lines and median age of each status. ``lines``: status, qty, overdue, age."""
    return lines.groupBy("status").agg(F.count(F.lit(1)).alias("lines"), F.sum("qty").alias("units"), F.count_if("overdue").alias("overdue"), F.median("age").alias("median_age"), F.count_if(~known(c("age"))).alias("undated"))
