"""Joins, latest rows, paging, set differences, merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partlake.session import cut_lineage


def newest(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """One row for each key, the first by ``order``. A window with rank 1, which Spark prunes before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def top_per_key(rows: DataFrame, key: list[str], k: int, *order: Column) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= k)


def fill_forward_newest(rows: DataFrame, key: list[str], order: str, columns: list[str]) -> DataFrame:
    """One row for each key: of each column the value of the newest row that has one."""
    return rows.groupBy(*key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def page(rows: DataFrame, id_column: str, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """The rows of one page. Only ids and sort keys are sorted; wide columns are fetched for that page alone."""
    ids = rows.orderBy(*order).select(id_column).offset(offset).limit(limit)
    return rows.join(F.broadcast(ids), id_column, "left_semi")  # at most ``limit`` ids


def universe(sources: dict[str, DataFrame], key: list[str]) -> DataFrame:
    """Every key of any source once, with a flag for each source it is in. One shuffle for all of them."""
    tagged = [df.select(*key, F.lit(name).alias("_source")) for name, df in sources.items()]
    every = reduce(DataFrame.unionByName, tagged)
    flags = [F.max((F.col("_source") == n).cast("int")).alias(f"in_{n}") for n in sources]
    return every.groupBy(*key).agg(*flags)


def row_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a that b lacks, nulls equal, with multiplicity."""
    return a.exceptAll(b)


def reject_split(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected): the first rule that holds gives a row's reject_reason."""
    reason = F.lit(None).cast("string")
    for name, rule in reversed(list(rules.items())):
        reason = F.when(F.coalesce(rule, F.lit(False)), name).otherwise(reason)
    marked = rows.withColumn("reject_reason", reason)
    return marked.where("reject_reason IS NULL").drop("reject_reason"), marked.where("reject_reason IS NOT NULL")


class MergeError(ValueError):
    pass


def merge(target: DataFrame, batch: DataFrame, key: list[str], *, full: bool = False, most_new: float | None = None) -> DataFrame:
    """The target after a batch: last duplicate wins (by _order if there, else the greatest row), changed rows are replaced.

    Adds ``change``: inserted, updated, unchanged, kept, and deleted where a full batch lacks a row (those rows stay in the
    result with that mark). Rows without a key are dropped. More new rows than the share ``most_new`` of a full batch
    raises: its keys do not match the target's.
    """
    others = [c for c in target.columns if c not in key]
    some = reduce(lambda a, b: a & b, [F.col(k).isNotNull() & (F.trim(F.col(k).cast("string")) != "") for k in key])
    order = F.desc("_order") if "_order" in batch.columns else F.struct(*others).desc()
    fresh = newest(batch.where(some), key, order).select(*key, F.struct(*others).alias("new"))
    old = target.select(*key, F.struct(*others).alias("old"))
    both = old.join(fresh, key, "full")
    change = (
        F.when(F.col("old").isNull(), "inserted")
        .when(F.col("new").isNull(), F.lit("deleted" if full else "kept"))
        .when(F.col("old").eqNullSafe(F.col("new")), "unchanged")
        .otherwise("updated")
    )
    out = both.withColumn("change", change).withColumn("row", F.coalesce("new", "old"))
    if full and most_new is not None:
        out = cut_lineage(out)
        counts = out.agg(F.count_if(F.col("change") == "inserted").alias("new"), F.count_if(F.col("new").isNotNull()).alias("all")).first()
        if counts["all"] and counts["new"] / counts["all"] > most_new:
            raise MergeError(f"{counts['new']} of {counts['all']} rows are new: do the keys match?")
    return out.select(*key, *[F.col(f"row.{c}").alias(c) for c in others], "change")


def soft_delete(target: DataFrame, seen: DataFrame, key: list[str], complete: bool) -> DataFrame:
    """is_active by whether a complete snapshot has the key; an incomplete one changes nothing."""
    if not complete:
        return target
    marks = seen.select(*key).distinct().withColumn("_seen", F.lit(True))
    return target.drop("is_active").join(marks, key, "left").withColumn("is_active", F.coalesce("_seen", F.lit(False))).drop("_seen")


def changes_of_fields(changes: DataFrame, key: list[str]) -> DataFrame:
    """First old and last new value of each field. ``changes``: key, field, at, old, new; repeated rows count once."""
    return changes.dropDuplicates([*key, "field", "at"]).groupBy(*key, "field").agg(F.min_by("old", "at").alias("before"), F.max_by("new", "at").alias("after"), F.count(F.lit(1)).alias("changes"))


def single_value(rows: DataFrame, column: str) -> DataFrame:
    """The one value of a column, null where there are several or none."""
    return rows.agg(F.when(F.countDistinct(column) == 1, F.first(column, ignorenulls=True)).alias(column))
