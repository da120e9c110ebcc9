"""Incremental loading: marks, windows, delta sweeps over dependent sets, completeness, fingerprints, snapshots."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partlake.operators.relational import merge


@dataclass(frozen=True)
class Delta:
    """How a set is read again: by its own day field and look-back, and/or for keys that its parents changed."""

    name: str
    key: tuple[str, ...]
    field: str | None = None
    lookback_days: int = 0
    parents: tuple[tuple[str, str], ...] = ()  # (parent set, key column both have)


@dataclass
class Mark:
    """High-water marks: a day for each set, never ahead of today."""

    days: dict[str, date] = field(default_factory=dict)

    def advance(self, name: str, seen: date | None, today: date) -> None:
        if seen is not None:
            self.days[name] = max(self.days.get(name, date.min), min(seen, today))


def parse_window(text: str) -> tuple[int, str]:
    """(count, unit) of 12m, 90d, 2y."""
    found = re.fullmatch(r"\s*([0-9]+)\s*([dmy])\s*", text.lower())
    if not found or int(found[1]) == 0:
        raise ValueError(f"{text!r} is not a window such as 90d, 12m or 2y")
    return int(found[1]), {"d": "days", "m": "months", "y": "years"}[found[2]]


def window_begin(text: str, today: Column) -> Column:
    n, unit = parse_window(text)
    return F.date_sub(today, n) if unit == "days" else F.add_months(today, -n * (12 if unit == "years" else 1))


def window_start(delta: Delta, mark: date | None, today: date) -> date | None:
    """The day to read from, its whole day included: the mark, or an earlier look-back from today; all if there is no mark."""
    if mark is None:
        return None
    return min(mark, today - timedelta(days=delta.lookback_days)) if delta.lookback_days else mark


def window_filter(rows: DataFrame, delta: Delta, mark: date | None, today: date) -> DataFrame:
    """The rows of a set's window; the comparison reaches the scan."""
    start = window_start(delta, mark, today)
    return rows if delta.field is None or start is None else rows.where(F.col(delta.field) >= F.lit(start))


def order_of(deltas: list[Delta]) -> list[Delta]:
    """Parents before the sets that follow them."""
    by_name, done, out = {d.name: d for d in deltas}, set(), []

    def visit(d: Delta, above: tuple[str, ...]) -> None:
        if d.name in above:
            raise ValueError(f"sets follow each other in a circle: {' > '.join([*above, d.name])}")
        if d.name not in done:
            for parent, _ in d.parents:
                if parent in by_name:
                    visit(by_name[parent], (*above, d.name))
            done.add(d.name)
            out.append(d)

    for d in deltas:
        visit(d, ())
    return out


def changed_keys(merged: DataFrame, key: str) -> DataFrame:
    """Keys of rows that a merge inserted or updated."""
    return merged.where(F.col("change").isin("inserted", "updated")).select(key).distinct()


def sweep(deltas: list[Delta], source: Callable[[str], DataFrame], target: Callable[[str], DataFrame], save: Callable[[str, DataFrame], DataFrame], mark: Mark, today: date) -> dict[str, dict[str, int]]:
    """One pass over the sets in order: read each one's window and its parents' changed keys, merge, save, then move the mark.

    ``save`` writes a set and returns it as read back. Running a sweep twice changes nothing the second time.
    """
    merged: dict[str, DataFrame] = {}
    counts: dict[str, dict[str, int]] = {}
    for d in order_of(deltas):
        rows = source(d.name)
        parts = [window_filter(rows, d, mark.days.get(d.name), today)] if d.field or not d.parents else []
        for parent, key in d.parents:
            if parent in merged:
                parts.append(rows.join(changed_keys(merged[parent], key), key, "left_semi"))
        batch = parts[0]
        for p in parts[1:]:
            batch = batch.unionByName(p)
        merged[d.name] = save(d.name, merge(target(d.name), batch.distinct(), list(d.key)))
        counts[d.name] = {r[0]: r[1] for r in merged[d.name].groupBy("change").count().collect()}
        if d.field:
            mark.advance(d.name, batch.agg(F.max(F.col(d.field).cast("date"))).first()[0], today)
    return counts


def judge(received: int, expected: int | None, chunks: list[int], size: int) -> str:
    """EXACT where the count is known and met, BOUNDED where a last short chunk shows the end, else INCOMPLETE."""
    if expected is not None:
        return "EXACT" if received == expected else "INCOMPLETE"
    return "BOUNDED" if chunks and chunks[-1] < size and all(c == size for c in chunks[:-1]) else "INCOMPLETE"


def chunk_requests(chunks: DataFrame, quiet: str, size: int) -> DataFrame:
    """Pushed chunks (request, ts, rows) collected into requests that end after a quiet period, with a verdict."""
    w = F.session_window("ts", quiet)
    out = chunks.groupBy("request", w.alias("w")).agg(F.count(F.lit(1)).alias("chunks"), F.sum("rows").alias("rows"), F.max_by("rows", "ts").alias("last"), F.count_if(F.col("rows") < size).alias("short"))
    bounded = (F.col("last") < size) & (F.col("short") == 1)
    return out.select("request", F.col("w.start").alias("started"), "chunks", "rows", F.when(bounded, "BOUNDED").otherwise("INCOMPLETE").alias("verdict"))


def requested_chunks(asked: DataFrame, chunks: DataFrame, quiet: str, size: int, first: str) -> DataFrame:
    """A verdict on each request: TIMED_OUT without a chunk within ``first`` of asking, EXACT where the expected rows came,
    BOUNDED where none were told but a last short chunk shows the end, else INCOMPLETE.

    ``asked``: request, asked_at, expected (null: not told); ``chunks``: request, ts, rows. Of a request's bursts the first after
    asking counts; chunks before it belong to an earlier request.
    """
    own = chunks.join(asked.select("request", "asked_at"), "request").where(F.col("ts") >= F.col("asked_at")).select("request", "ts", "rows")
    bursts = chunk_requests(own, quiet, size)
    burst = bursts.groupBy("request").agg(F.min_by(F.struct("started", "chunks", "rows", "verdict"), "started").alias("b"))
    late = F.col("b.started").isNull() | (F.col("b.started") > F.col("asked_at") + F.expr(f"interval {first}"))
    told = F.when(F.col("b.rows") == F.col("expected"), "EXACT").otherwise("INCOMPLETE")
    verdict = F.when(late, "TIMED_OUT").when(F.col("expected").isNotNull(), told).otherwise(F.col("b.verdict"))
    return asked.join(burst, "request", "left").select("request", F.coalesce("b.rows", F.lit(0)).alias("rows"), F.coalesce("b.chunks", F.lit(0)).alias("chunks"), verdict.alias("verdict"))


def open_row_keys(rows: DataFrame, key: list[str], is_open: Column, day: Column, before: Column) -> DataFrame:
    """Keys of rows that are still open and older than the window, to be read again."""
    return rows.where(is_open & (day < before)).select(*key).distinct()


def fingerprint(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: number of rows and an order-free digest, equal only for equal content (up to hash collisions)."""
    h = F.xxhash64(*[F.col(c) for c in columns])
    return rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("mixed"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("total"))


class Snapshots:
    """Versions of a frame in a folder; a pointer row names the current one, and readers pin a version."""

    SCHEMA = "version long, as_of date, rows long"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def versions(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.SCHEMA).parquet(f"{self.root}/_versions")
        except Exception as error:  # no version yet
            if "PATH_NOT_FOUND" in str(error):
                return self.spark.createDataFrame([], self.SCHEMA)
            raise

    def current(self) -> int | None:
        return self.versions().agg(F.max("version")).first()[0]

    def build(self, rows: DataFrame, as_of: date, partition_by: list[str] | None = None) -> int:
        """Write a new version, then point to it."""
        version = (self.current() or 0) + 1
        rows.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(f"{self.root}/version={version}")
        n = self.spark.read.parquet(f"{self.root}/version={version}").count()
        self.spark.createDataFrame([(version, as_of, n)], self.SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.root}/_versions")
        return version

    def read(self, version: int | None = None) -> DataFrame:
        version = version or self.current()
        if version is None:
            raise ValueError("no version has been built")
        return self.spark.read.parquet(f"{self.root}/version={version}")

    def reage(self, as_of: date, expressions: dict[str, Column]) -> int:
        """A new version in which only what depends on the day is computed anew."""
        return self.build(self.read().withColumns(expressions), as_of)

    def refresh(self, rows: DataFrame, key: list[str], as_of: date) -> int:
        """A new version in which the given keys' rows are replaced."""
        old = self.read().join(rows.select(*key).distinct(), key, "left_anti")
        return self.build(old.unionByName(rows.select(*old.columns)), as_of)
