"""Which rows count: plants, deleted materials, descriptions by language; stock positions and other keyed facts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col
#: The parts of a storage location's stock.
STOCK_PARTS = ["unrestricted", "inspection", "blocked", "transfer", "restricted", "returns"]


def tidy(column: Column) -> Column:
    """Trimmed text; blank is unknown."""
    return F.nullif(F.trim(column.cast("string")), F.lit(""))


def in_plants(column: Column, plants: list[str]) -> Column:
    """Whether a plant is served: a blank or unknown one is not."""
    return F.coalesce(tidy(column).isin(plants), F.lit(False))


def in_plants_or_malformed(column: Column, plants: list[str], *keys: Column) -> Column:
    """Lets rows of served plants through, and those without plant or key, which are to be counted as rejected."""
    blank = reduce(lambda a, b: a | b, [tidy(x).isNull() for x in (column, *keys)])
    return blank | tidy(column).isin(plants) if plants else F.lit(True)


def material_scope(mrp_type: Column, on_demand: list[str]) -> Column:
    """OAR for an MRP type that is ordered on demand; EXCLUDED for any other, a blank or an unknown one."""
    return F.when(F.coalesce(F.upper(F.trim(mrp_type)).isin(on_demand), F.lit(False)), "OAR").otherwise("EXCLUDED")


def flagged(column: Column) -> Column:
    return F.coalesce(F.upper(F.trim(column)) == "X", F.lit(False))


def with_deletion(plants: DataFrame, materials: DataFrame, material: str = "material") -> DataFrame:
    """Adds ``deleted``: flagged at its plant, or its material flagged at all. ``plants``: material, flag; ``materials``: the
    same. The flagged materials are reduced to one row each, so repeated ones cannot multiply plants."""
    gone = materials.where(flagged(c("flag"))).select(material).distinct().withColumn("_gone", F.lit(True))
    return plants.join(gone, material, "left").withColumn("deleted", flagged(c("flag")) | c("_gone").isNotNull()).drop("_gone")


def attributes(universe: DataFrame, plants: DataFrame, materials: DataFrame) -> DataFrame:
    """A universe of (material, plant) with plant and material facts, without those that either says are deleted.

    A key without a row in either stays: unknown is not deleted. ``plants`` and ``materials`` have one row a key, with a
    boolean ``deleted`` that may be null.
    """
    one = plants.withColumnRenamed("deleted", "_plant_deleted")
    other = materials.withColumnRenamed("deleted", "_material_deleted")
    kept = ~F.coalesce("_plant_deleted", F.lit(False)) & ~F.coalesce("_material_deleted", F.lit(False))
    return universe.join(one, ["material", "plant"], "left").join(other, "material", "left").where(kept).drop("_plant_deleted", "_material_deleted")


def preferred_text(texts: DataFrame, key: str, language: str, text: str, wanted: list[str]) -> DataFrame:
    """One text for each key: the greatest of the wanted languages, else the greatest of any."""
    own = F.max(F.when(c(language).isin(wanted), c(text)))
    return texts.groupBy(key).agg(F.coalesce(own, F.max(text)).alias(text))


def stock_position(locations: DataFrame) -> DataFrame:
    """Sums of the six parts over active storage locations, and their number; a part nobody knows stays unknown."""
    return locations.where("is_active").groupBy("material", "plant").agg(*[F.sum(x).alias(x) for x in STOCK_PARTS], F.count(F.lit(1)).alias("locations"))


def condition_split(sources: list[tuple[str, DataFrame]], usable: list[str], damaged: list[str]) -> DataFrame:
    """Usable and damaged stock of each (material, plant), from the first source that says anything about its condition.

    Each source: material, plant, condition, quantity. Rows without condition or quantity say nothing. Other conditions
    count in neither, but keep the key known.
    """
    stacked = reduce(DataFrame.unionByName, [df.select("material", "plant", F.upper(tidy(c("condition"))).alias("condition"), "quantity", F.lit(k).alias("source")) for k, (_, df) in enumerate(sources)])
    fine = stacked.where("condition IS NOT NULL AND quantity IS NOT NULL")
    part = lambda names: F.sum(F.when(c("condition").isin(names), c("quantity")).otherwise(0.0))
    by_source = fine.groupBy("material", "plant", "source").agg(part(usable).alias("usable"), part(damaged).alias("damaged"), F.countDistinct("condition").alias("conditions"))
    best = by_source.groupBy("material", "plant").agg(F.min_by(F.struct("usable", "damaged", "conditions", "source"), "source").alias("x"))
    name = F.element_at(F.array(*[F.lit(n) for n, _ in sources]), c("x.source") + 1)
    return best.select("material", "plant", "x.usable", "x.damaged", "x.conditions", name.alias("source"))


def usable_lead_times(orders: DataFrame) -> DataFrame:
    """Order lines of each (material, plant) that have a lead time and were not cancelled."""
    return orders.where("lead_days IS NOT NULL AND NOT cancelled").groupBy("material", "plant").agg(F.count(F.lit(1)).alias("n"))


def schedule(lines: DataFrame, key: list[str], day: str) -> DataFrame:
    """The earliest schedule date of each order line and how many it has."""
    return lines.groupBy(*key).agg(F.min(day).alias("first_date"), F.count(day).alias("schedules"))


def trailing_events(monthly: DataFrame, reference: Column, months: int) -> DataFrame:
    """Issues minus reversals of the last so many months up to a reference month, never below 0. ``monthly``: material,
    plant, month, issues, reversals."""
    start = F.add_months(F.trunc(reference, "month"), 1 - months)
    inside = (c("month") >= start) & (c("month") <= reference)
    net = F.sum(F.when(inside, c("issues") - c("reversals")).otherwise(0))
    return monthly.groupBy("material", "plant").agg(F.greatest(net, F.lit(0)).cast("long").alias("events"))


def anchor(moves: DataFrame) -> DataFrame:
    """The day of the last issue: one row."""
    return moves.where("NOT reversal").agg(F.max("day").alias("anchor"))


def header_changes(headers: DataFrame, items: DataFrame, object_class: str, start: str, end: str) -> DataFrame:
    """Change items with their header's day and user, of one object class within [start, end]. Both have change; headers
    object_class, day, user."""
    day = c("day").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return items.join(headers.where((c("object_class") == object_class) & day), "change")


def with_known_parameters(wanted: DataFrame, results: DataFrame, key: list[str], run: int) -> DataFrame:
    """Every wanted key with the result of one run: the run is chosen before the join, so other runs add no rows."""
    return wanted.join(results.where(c("run") == run).drop("run"), key, "left")


def with_last_window(rows: DataFrame, windows: DataFrame, key: list[str]) -> DataFrame:
    """Rows with the latest end of their windows."""
    return rows.join(windows.groupBy(*key).agg(F.max("window_end").alias("window_end")), key, "left")


def unique_lookup(rows: DataFrame, table: DataFrame, key: list[str], value: str) -> DataFrame:
    """A value looked up by a key that should be unique; where the table has several different ones it is unknown."""
    one = table.groupBy(*key).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    return rows.join(one, key, "left").withColumn(value, F.when(c("_low") == c("_high"), c("_low"))).drop("_low", "_high")
