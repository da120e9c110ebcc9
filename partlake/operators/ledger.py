"""Order-dependent movement logic: netting, reversals, oldest-first allocation, document chains.

Netting, last-in-first-out reversals and equal cancellation have closed forms and are windows over one sort. Allocation with
undo is a walk over sorted partitions that stream by key; it is sequential, so its key (a material at a plant) cannot be
salted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["material", "plant"]
RECEIPT, ISSUE, UNDO, PLANNED = range(4)  # in the order of one day


def net(moves: DataFrame) -> DataFrame:
    """Base minus reversal quantity, events likewise floored at 0, first and last base date, by key."""
    q, rev = F.col("qty"), F.col("reversal")
    return moves.groupBy(*KEY).agg(
        F.sum(F.when(rev, -q).otherwise(q)).alias("net_quantity"),
        F.greatest(F.count_if(~rev) - F.count_if(rev), F.lit(0)).alias("net_events"),
        F.min(F.when(~rev, F.col("day"))).alias("first_date"),
        F.max(F.when(~rev, F.col("day"))).alias("last_date"),
    )


def heights(moves: DataFrame, order: list[str]) -> DataFrame:
    """Adds n (the place in a key's order) and height: the running net, which a reversal takes to 0 at the least.

    The clamped sum has a closed form, the running sum less its least value so far (if below 0), so a key's rows stream
    through two windows over one sort, however many they are.
    """
    w = Window.partitionBy(*KEY).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    signed = F.when(F.col("reversal"), -F.col("qty")).otherwise(F.col("qty"))
    sums = moves.withColumn("n", F.row_number().over(w)).withColumn("_sum", F.sum(signed).over(upto))
    return sums.withColumn("height", F.col("_sum") - F.least(F.min("_sum").over(upto), F.lit(0.0))).drop("_sum")


def clamped_net(moves: DataFrame) -> DataFrame:
    """Net quantity in date order (a day's base movements before its reversals), clamped at 0 by each reversal."""
    return heights(moves, ["day", "reversal", "qty"]).groupBy(*KEY).agg(F.max_by("height", "n").alias("standing"))


def walk_keys(rows: DataFrame, key: list[str], order: list[str], columns: list[str], walk: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """Apply ``walk`` to each key's rows in order. ``rows`` is shuffled by key and sorted once; keys then stream by in Arrow
    batches, so that a small key costs no group of its own. Rows are tuples of key, ``columns``; so are the results.
    """
    names = [f.split()[0] for f in schema.split(", ")]
    width = len(key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for pdf in batches:
            out: list[tuple] = []
            for row in zip(*[pdf[c].tolist() for c in [*key, *columns]]):
                if held and held[0][:width] != row[:width]:
                    out += walk(held)
                    held = []
                held.append(row)
            if out:
                yield pd.DataFrame(out, columns=names)
        if held and (out := walk(held)):
            yield pd.DataFrame(out, columns=names)

    tidy = rows.select(*key, *columns).repartition(*key).sortWithinPartitions(*key, *order)
    return tidy.mapInPandas(run, schema)


def kinds_of(rows: DataFrame, columns: list[str]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return ", ".join(f"{c} {kinds[c]}" for c in columns)


def standing_events(moves: DataFrame, as_of: str | None = None) -> DataFrame:
    """Each base movement with what later reversals left of it: a reversal takes from the latest still standing.

    A movement lies between the heights before and after it; of that stretch stands what no later height falls below. Ties
    on a day go base first, then by document, line and quantity.
    """
    usable = moves.where(F.col("day").isNotNull())
    if as_of:
        usable = usable.where(F.col("day") <= F.lit(as_of).cast("date"))
    placed = heights(usable, ["day", "reversal", "doc", "line", "qty"])
    # backwards, so that the least later height is a running one too
    later = F.min("height").over(Window.partitionBy(*KEY).orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0))
    left = F.greatest(F.lit(0.0), F.least(F.col("qty"), F.col("later") - (F.col("height") - F.col("qty"))))
    return placed.withColumn("later", later).where(~F.col("reversal")).select(*KEY, "day", "doc", "line", "qty", left.alias("standing"))


def standing_by_month(standing: DataFrame) -> DataFrame:
    """Standing quantity in the month of the movement that was cancelled; fully reversed months keep a row."""
    return standing.groupBy(*KEY, F.trunc("day", "month").alias("month")).agg(F.sum("standing").alias("quantity"))


def movement_metrics(moves: DataFrame, stock: DataFrame, as_of: str, months: int = 12, fast: int = 90, slow: int = 365) -> DataFrame:
    """Last movement, last standing issue, twelve-month events and quantity, turns, aging band. ``stock``: key, stock."""
    from partlake.functions.semantics import aging_band, ratio

    anchor = F.lit(as_of).cast("date")
    last = moves.groupBy(*KEY).agg(F.max("day").alias("last_movement_date"))
    live = standing_events(moves, as_of).where("standing > 0")
    inside = F.col("day") >= F.add_months(anchor, -months)
    issues = live.groupBy(*KEY).agg(F.max("day").alias("last_issue_date"), F.count_if(inside).alias("events"), F.coalesce(F.sum(F.when(inside, F.col("standing"))), F.lit(0.0)).alias("consumed"))
    out = last.join(issues, KEY, "left").join(stock, KEY, "left")
    days = F.datediff(anchor, F.col("last_issue_date"))
    return out.select(
        *KEY,
        "last_movement_date",
        "last_issue_date",
        F.coalesce("events", F.lit(0)).alias("events"),
        F.coalesce("consumed", F.lit(0.0)).alias("consumed"),
        ratio(F.coalesce("consumed", F.lit(0.0)), F.col("stock")).alias("turns"),
        F.when(F.coalesce(F.col("stock"), F.lit(0.0)) == 0, "INSUFFICIENT_HISTORY").alias("turns_reason"),
        aging_band(days, fast, slow).alias("band"),
    )


def cancel_equal(moves: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """Issues that no reversal of the same key, quantity and ``also`` columns cancels (unknown ones equal each other).

    Each reversal cancels the earliest issue not yet cancelled, whatever its day; one without an issue left cancels nothing.
    So of a group as many of the first issues go as it has reversals. Only issues above 0 are returned.
    """
    group = Window.partitionBy(*KEY, "qty", *also).orderBy(F.desc("reversal"), "day", "doc", "line")
    upto = group.rowsBetween(Window.unboundedPreceding, 0)
    undone = F.sum(F.col("reversal").cast("long")).over(upto)  # reversals stand first: at an issue, all of them
    placed = moves.where(F.col("day").isNotNull()).withColumn("_n", F.row_number().over(group)).withColumn("_undone", undone)
    return placed.where(~F.col("reversal") & (F.col("_n") > 2 * F.col("_undone")) & (F.col("qty") > 0)).select(*KEY, "day", "qty")


def oldest_first(receipts: DataFrame, issues: DataFrame) -> DataFrame:
    """Issues without reversals, allocated to deliveries oldest first, as overlaps of running totals.

    ``receipts``: key, day, doc, line, qty; ``issues``: key, day, qty. Each delivery's share is the overlap of its
    interval of the running receipts with [0, all issues). Deliveries count whether or not they had arrived.
    """
    order = Window.partitionBy(*KEY).orderBy("day", "doc", "line", "qty").rowsBetween(Window.unboundedPreceding, 0)
    ends = receipts.withColumn("upto", F.sum("qty").over(order))
    total = issues.groupBy(*KEY).agg(F.sum("qty").alias("issued_total"))
    left = F.coalesce("issued_total", F.lit(0.0)) - (F.col("upto") - F.col("qty"))
    return ends.join(total, KEY, "left").select(*KEY, "day", "doc", "line", "qty", F.greatest(F.lit(0.0), F.least(F.col("qty"), left)).alias("issued"))


def allocate(events: DataFrame) -> DataFrame:
    """Allocation of issues to arrived deliveries oldest first; reversals undo the latest; open demand takes what is left.

    ``events``: key, day, kind, doc, line, qty. Kinds: receipt, issue, undo (of issues), planned. Returns each receipt with
    issued, first and last issue day, and what the earliest planned demand that reaches it takes and when.
    """

    def walk(rows: list[tuple]) -> list[tuple]:
        receipts = [r for r in rows if r[3] == RECEIPT]
        day, qty = [r[2] for r in receipts], [r[6] for r in receipts]
        issued, planned = [0.0] * len(qty), [0.0] * len(qty)
        stack: list[list] = []  # [delivery or None, quantity, day]
        head = 0
        for row in rows:
            on, kind, need = row[2], row[3], row[6]
            if kind == ISSUE:
                while head < len(qty) and issued[head] >= qty[head]:
                    head += 1
                k = head
                while need > 0 and k < len(qty) and day[k] <= on:
                    take = min(need, qty[k] - issued[k])
                    if take > 0:
                        issued[k] += take
                        need -= take
                        stack.append([k, take, on])
                    k += 1
                if need > 0:
                    stack.append([None, need, on])
            while kind == UNDO and need > 0 and stack:
                top = stack[-1]
                back = min(need, top[1])
                top[1] -= back
                need -= back
                if top[0] is not None:
                    issued[top[0]] -= back
                    head = min(head, top[0])
                if top[1] <= 0:
                    stack.pop()
        first, last = [None] * len(qty), [None] * len(qty)
        for k, left, on in stack:
            if k is not None and left > 0:
                first[k] = on if first[k] is None else min(first[k], on)
                last[k] = on if last[k] is None else max(last[k], on)
        when, k = [None] * len(qty), 0
        for row in rows:
            need = row[6] if row[3] == PLANNED else 0
            while need > 0 and k < len(qty):
                free = qty[k] - issued[k] - planned[k]
                if free <= 0:
                    k += 1
                    continue
                take = min(need, free)
                planned[k] += take
                need -= take
                when[k] = when[k] or row[2]
        return [(*r[:3], *r[4:7], *x) for r, *x in zip(receipts, issued, first, last, planned, when)]

    ranks = F.when(F.col("kind") == "receipt", RECEIPT).when(F.col("kind") == "issue", ISSUE).when(F.col("kind") == "undo", UNDO).otherwise(PLANNED)
    schema = kinds_of(events, [*KEY, "day", "doc", "line", "qty"]) + ", issued double, first_issue date, last_issue date, planned double, next_planned date"
    order = ["day", "rank", "doc", "line", "qty"]
    return walk_keys(events.withColumn("rank", ranks), KEY, order, order, walk, schema)


def procurement_chain(orders: DataFrame, requests: DataFrame, receipts: DataFrame, issues: DataFrame) -> DataFrame:
    """Request -> order item -> receipt -> issue. Every order item once, then undeleted requests that no item names.

    ``orders``: po, item, pr, qty, closed; ``requests``: pr, requested_on, deleted; ``receipts``: po, item, qty, day;
    ``issues``: pr, qty. Receipts and issues are summed before they are joined, so they cannot fan out.
    """
    got = receipts.groupBy("po", "item").agg(F.sum("qty").alias("received"), F.min("day").alias("first_receipt"))
    used = issues.groupBy("pr").agg(F.sum("qty").alias("issued"))
    base = orders.join(requests.select("pr", "requested_on"), "pr", "left").join(got, ["po", "item"], "left").join(used, "pr", "left")
    alone = requests.where(~F.col("deleted")).join(orders.select("pr"), "pr", "left_anti").select("pr", "requested_on")
    out = base.unionByName(alone, allowMissingColumns=True)
    return out.withColumn("status", lifecycle_status(F.col("po"), F.col("qty"), F.col("closed"), F.coalesce("received", F.lit(0.0)), F.coalesce("issued", F.lit(0.0))))


def lifecycle_status(po: Column, qty: Column, closed: Column, received: Column, issued: Column) -> Column:
    return (
        F.when(po.isNull(), "REQUESTED")
        .when((received <= 0) & F.coalesce(closed, F.lit(False)), "CLOSED_UNRECEIVED")
        .when(received <= 0, "ORDERED")
        .when(issued >= received, "CONSUMED")
        .when(issued > 0, "PARTLY_CONSUMED")
        .when(received < qty, "PARTLY_RECEIVED")
        .otherwise("RECEIVED")
    )


def fan_out_guard(rows: DataFrame, key: list[str]) -> DataFrame:
    """Marks rows whose key several rows claim: which one is meant is unresolved."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*key))
    some = F.lit(True)
    for k in key:
        some = some & F.col(k).isNotNull()
    return rows.withColumn("unresolved", some & (n > 1))


def nearest_in_window(left: DataFrame, right: DataFrame, key: list[str], days: int) -> DataFrame:
    """For each left row the right row of the same key within so many days: nearest, then not before, then least id.

    ``left``: key, left_id, left_day; ``right``: key, right_id, right_day. The range is cut into buckets as wide as the
    window, so that a hot key's rows meet only those of their own and the neighbouring buckets.
    """
    bucket = lambda c: F.floor(F.unix_date(c) / max(days, 1))
    l = left.withColumn("_b", F.explode(F.array(bucket(F.col("left_day")) - 1, bucket(F.col("left_day")), bucket(F.col("left_day")) + 1)))
    r = right.withColumn("_b", bucket(F.col("right_day")))
    gap = F.datediff("right_day", "left_day")
    met = l.join(r, [*key, "_b"]).where(F.abs(gap) <= days)
    best = F.min_by(F.struct("right_id", "right_day"), F.struct(F.abs(gap), gap < 0, F.col("right_id")))
    found = met.groupBy("left_id").agg(best.alias("best"))
    return left.join(found, "left_id", "left").select(*key, "left_id", "left_day", "best.right_id", "best.right_day")


def open_quantity(orders: DataFrame) -> DataFrame:
    """Still to come by key: ordered minus received, never negative, of lines that are not closed."""
    due = F.greatest(F.col("qty") - F.coalesce("received", F.lit(0.0)), F.lit(0.0))
    return orders.where(~F.col("closed")).groupBy(*KEY).agg(F.sum(due).alias("open_quantity"), F.count(F.lit(1)).alias("open_lines"))


def chain_diagnostics(orders: DataFrame, requests: DataFrame) -> DataFrame:
    """One row: requests, those without, with one and with many orders, and orders' requests that are unknown. ``orders``: po, pr;
    ``requests``: pr."""
    n = orders.where("pr IS NOT NULL").groupBy("pr").agg(F.countDistinct("po").alias("orders"))
    both = requests.select("pr", F.lit(1).alias("known")).join(n, "pr", "full")
    known = F.col("known").isNotNull()
    return both.agg(
        F.count("known").alias("requests"),
        F.count_if(known & F.col("orders").isNull()).alias("without_order"),
        F.count_if(known & (F.col("orders") == 1)).alias("with_one"),
        F.count_if(known & (F.col("orders") > 1)).alias("with_many"),
        F.count_if(~known).alias("unknown_requests"),
    )


def line_movements(moves: DataFrame, key: str, out: str, back: str, undo: str) -> DataFrame:
    """Movements of each order in one pass: first and last dispatch and quantity (kind ``out``), received (``back`` less ``undo``).

    ``moves``: key, kind, day, qty.
    """
    kind, q, zero = F.col("kind"), F.col("qty"), F.lit(0.0)
    return moves.groupBy(key).agg(
        F.count(F.lit(1)).alias("movements"),
        F.min(F.when(kind == out, F.col("day"))).alias("first_dispatch"),
        F.max(F.when(kind == out, F.col("day"))).alias("last_dispatch"),
        F.coalesce(F.sum(F.when(kind == out, q)), zero).alias("dispatched"),
        F.coalesce(F.sum(F.when(kind == back, q).when(kind == undo, -q)), zero).alias("received"),
    )


def received_not_issued(orders: DataFrame, receipts: DataFrame, issues: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Lines of each material that came in by a day and whose request nothing was issued for; the oldest decides the flag.

    ``orders``: po, item, pr, material; ``receipts``: po, item, day; ``issues``: pr.
    """
    got = receipts.groupBy("po", "item").agg(F.min("day").alias("first_receipt"))
    waiting = orders.join(got, ["po", "item"]).join(issues.select("pr").distinct(), "pr", "left_anti")
    waiting = waiting.withColumn("days", F.datediff(as_of, F.col("first_receipt"))).where("days >= 0")
    return waiting.groupBy("material").agg(F.count(F.lit(1)).alias("lines"), F.max("days").alias("oldest_days"), (F.max("days") > days).alias("flagged"))


def plan_exceptions(lines: DataFrame) -> DataFrame:
    """plan_breach (ordered above plan; unknown without one) and acquired against plan. ``lines``: qty, received, plan."""
    acquired = F.when(F.col("plan").isNull(), "NO_PLAN").when(F.col("received") > F.col("plan"), "ABOVE_PLAN").when(F.col("received") < F.col("plan"), "BELOW_PLAN").otherwise("AS_PLANNED")
    return lines.withColumn("plan_breach", F.col("qty") > F.col("plan")).withColumn("acquired", acquired)


def reclassify(rows: DataFrame, indicators: dict[str, Column]) -> DataFrame:
    """reasons (indicators that hold, joined by +) and verdict: a candidate if any does, unknown if none does and one is unknown."""
    held = F.array_compact(F.array(*[F.when(test, name) for name, test in indicators.items()]))
    unsure = F.lit(False)
    for test in indicators.values():
        unsure = unsure | test.isNull()
    verdict = F.when(F.size(held) > 0, "CANDIDATE").when(unsure, "UNKNOWN").otherwise("NO")
    return rows.withColumn("reasons", F.array_join(held, "+")).withColumn("verdict", verdict)


def attribute_owner(rows: DataFrame, candidates: DataFrame, key: str, owner: str) -> DataFrame:
    """The owner of each key if it has one candidate: candidates, owner and status NONE, ATTRIBUTED or AMBIGUOUS.

    A count and a least say whether there is one; no set of them is kept.
    """
    found = candidates.groupBy(key).agg(F.countDistinct(owner).cast("int").alias("_n"), F.min(owner).alias("_one"))
    n = F.coalesce("_n", F.lit(0))
    status = F.when(n == 0, "NONE").when(n == 1, "ATTRIBUTED").otherwise("AMBIGUOUS")
    return rows.join(found, key, "left").select(*rows.columns, n.alias("candidates"), F.when(n == 1, F.col("_one")).alias("owner"), status.alias("status"))
