"""Editable KPI rules: default formulas, stages that feed each other, guards on the facts a rule uses, versions."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partlake.functions import formula
from partlake.functions.formula import FormulaError, Node

c = F.col
#: The editable fields, what kind each is, and its default.
NUMBERS = {"window_days": 90, "lookback_days": 730}
DEFAULTS = {
    "avg_daily_use": ("number", "usage_in_window / window_days"),
    "stock_needed": ("number", "avg_daily_use * lead_time_days"),
    "at_risk": ("condition", "stock_on_hand < stock_needed"),
    "excess_condition": ("condition", "current_max_stock > recommended_max_stock"),
    "excess_value": ("number", "unit_price * (current_max_stock - recommended_max_stock)"),
    "working_capital_value": ("number", "unit_price * (current_rop - recommended_rop)"),
    "adoption_rate": ("number", "(adopted + partially_adopted) / (adopted + partially_adopted + not_adopted)"),
    "adopted_card": ("number", "adopted"),
}
STAGES = ["avg_daily_use", "stock_needed"]
#: The facts of the three data sets.
STOCKOUT = ["usage_in_window", "window_days", "lead_time_days", "stock_on_hand", "demand_history"]
PLANNING = ["unit_price", "current_ss", "recommended_ss", "current_rop", "recommended_rop", "current_max_stock", "recommended_max_stock"]
ADOPTION = ["adopted", "partially_adopted", "not_adopted", "pending"]
FACTS = dict.fromkeys(["avg_daily_use", "stock_needed", "at_risk"], STOCKOUT) | dict.fromkeys(["excess_condition", "excess_value", "working_capital_value"], PLANNING) | dict.fromkeys(["adoption_rate", "adopted_card"], ADOPTION)


def parsed(edits: dict[str, str] | None = None) -> dict[str, Node]:
    """Every formula's checked tree, edited ones in place of defaults. A stage may use the stages before it."""
    edits = edits or {}
    if unknown := edits.keys() - DEFAULTS.keys():
        raise FormulaError(f"no such fields: {sorted(unknown)}")
    out = {}
    for name, (kind, source) in DEFAULTS.items():
        earlier = STAGES[: STAGES.index(name)] if name in STAGES else STAGES if name == "at_risk" else []
        out[name] = formula.parse(edits.get(name, source), {*FACTS[name], *earlier}, kind)
    return out


def facts_of(rules: dict[str, Node], name: str) -> set[str]:
    """The facts that a formula rests on, through the stages it uses."""
    used = rules[name].names()
    return (used - set(STAGES)).union(*(facts_of(rules, x) for x in used & set(STAGES)))


def at_risk(rows: DataFrame, rules: dict[str, Node]) -> DataFrame:
    """Adds the stages, evaluated and at_risk. A row is judged if the facts that the rule uses are usable: a lead time above
    0, stock known and not below 0, others known; a rule that does not use a fact asks nothing of it."""
    used, out = facts_of(rules, "at_risk"), rows
    columns: dict[str, Column] = {x: c(x) for x in STOCKOUT if x in rows.columns}
    for stage in STAGES:
        out = out.withColumn(stage, formula.to_column(rules[stage], columns))
        columns[stage] = c(stage)
    guards = [c("window_days") > 0, c("usage_in_window") >= 0] + [c("lead_time_days") > 0] * ("lead_time_days" in used) + [c("stock_on_hand") >= 0] * ("stock_on_hand" in used)
    rule = formula.to_column(rules["at_risk"], columns)
    fine = F.coalesce(reduce(lambda a, b: a & b, guards), F.lit(False)) & rule.isNotNull()
    return out.withColumn("evaluated", fine).withColumn("at_risk", fine & rule)


def at_risk_sql(rules: dict[str, Node], columns: dict[str, str]) -> tuple[str, str]:
    """(evaluated, at_risk) in SQL, the stages written out."""
    names, used = dict(columns), facts_of(rules, "at_risk")
    for stage in STAGES:
        names[stage] = formula.to_sql(rules[stage], names)
    rule = formula.to_sql(rules["at_risk"], names)
    guards = [f"{columns['window_days']} > 0", f"{columns['usage_in_window']} >= 0"] + [f"{columns['lead_time_days']} > 0"] * ("lead_time_days" in used) + [f"{columns['stock_on_hand']} >= 0"] * ("stock_on_hand" in used)
    fine = f"coalesce({' AND '.join(guards)}, false) AND ({rule}) IS NOT NULL"
    return fine, f"({fine}) AND ({rule})"


def sums(rows: DataFrame, rules: dict[str, Node]) -> DataFrame:
    """How many rows the excess condition holds for, and sums of the excess and working capital values: unknown ones add none."""
    columns = {x: c(x) for x in PLANNING}
    read = lambda x: formula.to_column(rules[x], columns)
    over = F.coalesce(read("excess_condition"), F.lit(False))
    return rows.agg(F.count_if(over).alias("excess"), F.sum(F.when(over, read("excess_value"))).alias("excess_value"), F.sum(read("working_capital_value")).alias("working_capital"))


def save(history: DataFrame, edits: dict[str, str], author: str) -> DataFrame:
    """The versions with a new one after them, if it differs from the active (last) one. Formulas are checked first.

    ``history``: version, author, edits (JSON by name). Earlier versions stay, so any can be made active by saving it again.
    """
    parsed(edits)
    text = json.dumps(edits, sort_keys=True)
    last = history.agg(F.max("version").alias("v"), F.max_by("edits", "version").alias("e"))  # one row
    fresh = last.where(~c("e").eqNullSafe(F.lit(text))).select((F.coalesce("v", F.lit(0)) + 1).cast("long").alias("version"), F.lit(author).alias("author"), F.lit(text).alias("edits"))
    return history.unionByName(fresh)


def active(history: DataFrame) -> dict[str, Node]:
    """The formulas in force: those of the last version, or the defaults."""
    row = history.agg(F.max_by("edits", "version")).first()
    return parsed(json.loads(row[0]) if row[0] else None)


def preview(rows: DataFrame, edits: dict[str, str], history: DataFrame) -> DataFrame:
    """Evaluated and at risk now and under the edits, without saving: one row."""
    now, then = at_risk(rows, active(history)), at_risk(rows, parsed(edits))
    count = lambda df, p: df.agg(F.count_if("evaluated").alias(f"{p}_evaluated"), F.count_if("at_risk").alias(f"{p}_at_risk"))
    return count(now, "now").crossJoin(count(then, "edited"))  # one row each
