"""A paged OData-like service as a Spark data source, with filters pushed only where the service honours them.

Register with ``register(spark)``; read with ``spark.read.format("paged").schema(...).options(...).load()``. The service is
an object with ``count(filter)`` and ``page(skip, top, filter)``, made on each executor by the importable factory that
option ``service`` names (module:function), called with option ``root``. ``FolderService`` serves JSON-lines files.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

HONOURED, IGNORED, REJECTED = "HONOURED", "IGNORED", "REJECTED"
SIGNS = {EqualTo: "eq", GreaterThan: "gt", GreaterThanOrEqual: "ge", LessThan: "lt", LessThanOrEqual: "le"}
MOST_PAGES = 1_000_000


@dataclass
class Capabilities:
    """What a service does with a filter on each field; unlisted fields are taken to be ignored."""

    fields: dict[str, str] = field(default_factory=dict)

    def honours(self, name: str) -> bool:
        return self.fields.get(name, IGNORED) == HONOURED


class PagingError(RuntimeError):
    pass


class FolderService:
    """Rows of the JSON-lines files of a folder, in file order; honours eq, gt, ge, lt, le on any field."""

    def __init__(self, root: str):
        from pathlib import Path

        self.rows = [json.loads(line) for p in sorted(Path(root).glob("*.jsonl")) for line in p.read_text().splitlines() if line]

    def select(self, where: list[tuple[str, str, object]]) -> list[dict]:
        test = {"eq": lambda a, b: a == b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b}
        return [r for r in self.rows if all(r.get(f) is not None and test[op](r[f], v) for f, op, v in where)]

    def count(self, where: list) -> int:
        return len(self.select(where))

    def page(self, skip: int, top: int, where: list) -> list[dict]:
        return self.select(where)[skip : skip + top]


def make_service(spec: str, root: str):
    module, _, name = spec.partition(":")
    return getattr(importlib.import_module(module), name)(root)


@dataclass
class Span(InputPartition):
    skip: int
    top: int


class PagedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, dict(options)
        self.where: list[tuple[str, str, object]] = []
        self.capabilities = Capabilities(json.loads(self.options.get("capabilities", "{}")))

    def service(self):
        return make_service(self.options.get("service", "partlake.sources.paged:FolderService"), self.options["root"])

    def pushFilters(self, filters: list) -> Iterator:
        """Hand honoured comparisons to the service; Spark applies all others itself."""
        for f in filters:
            if type(f) in SIGNS and len(f.attribute) == 1 and self.capabilities.honours(f.attribute[0]):
                self.where.append((f.attribute[0], SIGNS[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[Span]:
        size, pages = int(self.options.get("pagesize", 1000)), int(self.options.get("pages", 16))
        total = self.service().count(self.where)
        step = size * pages
        return [Span(k, min(step, total - k)) for k in range(0, total, step)] or [Span(0, 0)]

    def read(self, span: Span) -> Iterator[tuple]:
        service, size = self.service(), int(self.options.get("pagesize", 1000))
        names, got = [f.name for f in self.schema.fields], 0
        while got < span.top:
            rows = service.page(span.skip + got, min(size, span.top - got), self.where)
            if not rows:
                raise PagingError(f"{got} of {span.top} rows from {span.skip} on: the service ended early")
            for r in rows:
                yield tuple(r.get(n) for n in names)
            got += len(rows)


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        raise ValueError("a paged source needs a declared schema")

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedSource)


def iter_pages(page: Callable[[int, int], list[dict]], size: int, total: int | None = None) -> Iterator[list[dict]]:
    """Pages until a short one, or until ``total`` rows; more pages than MOST_PAGES raise."""
    got = 0
    for _ in range(MOST_PAGES):
        rows = page(got, size)
        got += len(rows)
        if rows:
            yield rows
        if len(rows) < size and (total is None or got >= total or not rows):
            if total is not None and got < total:
                raise PagingError(f"{got} of {total} rows")
            return
    raise PagingError("the service does not end")


def duplicate_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    """How many rows repeat a key that an earlier one has (rows that miss a part of it do not count)."""
    keyed = rows.dropna(subset=key).groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return keyed.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))


def read_keys(rows: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    """Rows of the given keys: a semi join in place of batched or-filters."""
    return rows.join(keys.select(*key).distinct(), key, "left_semi")


def check_filter(capabilities: Capabilities, fields: list[str]) -> None:
    """Refuse a filter on a field that the service would ignore or reject."""
    bad = {f: capabilities.fields.get(f, IGNORED) for f in fields if not capabilities.honours(f)}
    if bad:
        raise ValueError("the service does not honour filters on " + ", ".join(f"{f} ({how})" for f, how in sorted(bad.items())))
