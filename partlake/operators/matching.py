"""Claims, fallbacks, drift between contracts, rejection counts, evaluation of rankings, mismatch reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

c = F.col


def contract_drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """What changed between two contracts (entity, name, kind, is_key): added, removed, other type, other key."""
    both = old.withColumn("was", F.struct("kind", "is_key")).select("entity", "name", "was").join(new.withColumn("now", F.struct("kind", "is_key")).select("entity", "name", "now"), ["entity", "name"], "full")
    drift = F.when(c("was").isNull(), "ADDED").when(c("now").isNull(), "REMOVED").when(~c("was.kind").eqNullSafe(c("now.kind")), "TYPE_CHANGED").when(~c("was.is_key").eqNullSafe(c("now.is_key")), "KEY_CHANGED")
    return both.select("entity", "name", drift.alias("drift")).where("drift IS NOT NULL")


def with_fallback(spine: DataFrame, key: list[str], value: str, sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """The first source's value for each key, and which source it was; sources have one row for each key."""
    out, label = spine, F.lit("NONE")
    for k, (_, df) in enumerate(sources):
        out = out.join(df.select(*key, c(value).alias(f"_v{k}")), key, "left")
    for k, (name, _) in reversed(list(enumerate(sources))):
        label = F.when(c(f"_v{k}").isNotNull(), name).otherwise(label)
    return out.select(*key, F.coalesce(*[c(f"_v{k}") for k in range(len(sources))]).alias(value), label.alias("source"))


def claim(plans: DataFrame, items: DataFrame, plan: str, item: str, key: list[str]) -> DataFrame:
    """How many items each plan gets through any of its links; an item goes to the least plan that names it, once."""
    linked = plans.select(plan, *key, F.explode("links").alias("link")).distinct()
    claimed = linked.join(items, [*key, "link"]).groupBy(item).agg(F.min(plan).alias(plan))
    counted = claimed.groupBy(plan).agg(F.count(F.lit(1)).alias("items"))
    n = F.coalesce("items", F.lit(0))
    return plans.select(plan).join(counted, plan, "left").select(plan, n.alias("items"), F.when(n > 0, "MATCHED").otherwise("UNMATCHED").alias("outcome"))


def rejection_counts(targets: DataFrame, donors: DataFrame, history: int) -> DataFrame:
    """How many donors each target would refuse and why, in closed form: counts of the donors by what decides, no pairs."""
    short = F.coalesce(c("d_history"), F.lit(0)) < history
    kinds = donors.groupBy("d_partition").agg(F.count_if(~c("d_active")).alias("inactive"), F.count_if(c("d_active") & short).alias("short"), F.count_if(c("d_active") & ~short).alias("fine"))
    total = kinds.agg(F.sum("inactive").alias("all_inactive"), F.sum(c("short") + c("fine")).alias("all_active"))
    own = donors.select(c("d_id").alias("t_id"), c("d_active").alias("own_active"), short.alias("own_short"))
    t = targets.join(own, "t_id", "left").join(kinds, c("t_partition") == c("d_partition"), "left").crossJoin(F.broadcast(total))  # one row
    here = lambda x: F.coalesce(c(x), F.lit(0))
    one = lambda cond: F.coalesce(cond, F.lit(False)).cast("long")
    active = c("own_active")
    counts = {
        "SAME_MATERIAL": one(active.isNotNull()),
        "INACTIVE": c("all_inactive") - one(~active),
        "OTHER_CRITICALITY": c("all_active") - here("short") - here("fine"),
        "SHORT_HISTORY": here("short") - one(active & c("own_short")),
        "ELIGIBLE": here("fine") - one(active & ~c("own_short")),
    }
    pairs = F.array(*[F.struct(F.lit(k).alias("reason"), v.cast("long").alias("n")) for k, v in counts.items()])
    return t.select("t_id", F.explode(pairs).alias("x")).select("t_id", "x.reason", "x.n").where("n > 0")


def threshold_sweep(ranked: DataFrame, relevant: DataFrame, thresholds: list[float]) -> DataFrame:
    """Admitted neighbours, hits and targets at each threshold, over one pass of the ranking."""
    marked = ranked.join(relevant.select("t_id", "d_id", F.lit(True).alias("hit")), ["t_id", "d_id"], "left")
    grid = F.explode(F.filter(F.array(*map(F.lit, thresholds)), lambda x: x <= c("score")))
    return marked.select("t_id", "hit", grid.alias("threshold")).groupBy("threshold").agg(F.count(F.lit(1)).alias("admitted"), F.count("hit").alias("hits"), F.countDistinct("t_id").alias("targets"))


def mismatch_reasons(ours: DataFrame, theirs: DataFrame, key: str, value: str, tolerance: float) -> DataFrame:
    """Rows of two reports by why they disagree."""
    a, b = ours.select(key, F.struct(c(value).alias("v")).alias("a")), theirs.select(key, F.struct(c(value).alias("v")).alias("b"))
    reason = (
        F.when(c("a").isNull(), "MISSING_HERE")
        .when(c("b").isNull(), "MISSING_IN_REPORT")
        .when(c("b.v").isNull(), "NO_REPORT_VALUE")
        .when(F.abs(c("a.v") - c("b.v")) > tolerance, "QUANTITY_DIFFERS")
        .otherwise("EQUAL")
    )
    return a.join(b, key, "full").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))
