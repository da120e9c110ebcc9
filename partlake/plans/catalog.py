"""Name -> query and oracle of the planning operators."""

from __future__ import annotations

from partlake.plans import ledgers, matching, operations, planning, portfolio, recommend, reports, rules
from partlake.plans.registry import Query

MODULES = [planning, ledgers, reports, operations, matching, portfolio, recommend, rules]


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for module in MODULES:
        if both := out.keys() & module.queries.queries.keys():
            raise ValueError(f"registered twice: {sorted(both)}")
        out |= module.queries.queries
    return out


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.queries.sql.items()}
