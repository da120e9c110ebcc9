"""Text files: repaired CSV, JSON-lines landing with manifests, workbooks, report parsing, skip of loaded files."""

from __future__ import annotations

import re
import zipfile
from datetime import date
from io import BytesIO
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from partlake.functions.normalise import unique_names

SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATED = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def read_csv(spark: SparkSession, path: str, *, delimiter: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """All columns as text, header repaired, NUL characters and blank rows dropped, short rows filled with nulls."""
    plain = spark.read.options(sep=delimiter, encoding=encoding, multiLine=True, escape='"', header=False, inferSchema=False, ignoreLeadingWhiteSpace=False)
    head = plain.csv(path).limit(1).collect()
    if not head:
        return spark.createDataFrame([], StructType([]))
    names = unique_names([(x or "").replace("\x00", "").lstrip("﻿") for x in head[0]])
    schema = StructType([StructField(n, StringType()) for n in names])
    rows = plain.option("header", True).option("enforceSchema", True).schema(schema).csv(path)
    rows = rows.select(*[F.translate(F.col(f"`{n}`"), "\x00", "").alias(n) for n in names])
    return rows.where(F.coalesce(*[F.nullif(F.trim(F.col(f"`{n}`")), F.lit("")) for n in names]).isNotNull())


def write_landing(rows: DataFrame, root: str, name: str, run_date: str) -> dict:
    """Rows as JSON lines under name/run_date=.../, then a manifest row; the manifest is what makes a run visible."""
    path = f"{root}/{name}/run_date={run_date}"
    rows.write.mode("overwrite").json(path)
    entry = {"name": name, "run_date": run_date, "rows": rows.sparkSession.read.schema(rows.schema).json(path).count(), "columns": ",".join(rows.columns)}
    rows.sparkSession.createDataFrame([entry]).coalesce(1).write.mode("append").json(f"{root}/_manifest")
    return entry


def latest_run(spark: SparkSession, root: str, name: str) -> str | None:
    """The newest run date of a set that the manifest knows."""
    return spark.read.schema("name string, run_date string, rows long, columns string").json(f"{root}/_manifest").where(F.col("name") == name).agg(F.max("run_date")).first()[0]


def read_landing(spark: SparkSession, root: str, name: str, schema: str, run_date: str | None = None) -> DataFrame:
    """A run of a set in column order; one partition folder is read."""
    run_date = run_date or latest_run(spark, root, name)
    if run_date is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(f"{root}/{name}/run_date={run_date}")


def fingerprints(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length and SHA-256 of the files of a folder, hashed where they are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def not_yet_loaded(found: DataFrame, manifest: DataFrame) -> DataFrame:
    return found.join(manifest.select("sha256"), "sha256", "left_anti")


def workbook_rows(data: bytes, sheet: str | None = None) -> list[list[str | None]]:
    """Cells of a sheet of an .xlsx file as text, by their column letters."""
    book = zipfile.ZipFile(BytesIO(data))
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{SHEET}si"):
            shared.append("".join(t.text or "" for t in item.iter(f"{SHEET}t")))
    sheets = {s.get("name"): s.get(f"{RELATED}id") for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{SHEET}sheet")}
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    target = targets[sheets[sheet] if sheet else next(iter(sheets.values()))]
    out = []
    for row in ElementTree.fromstring(book.read("xl/" + target.lstrip("/").removeprefix("xl/"))).iter(f"{SHEET}row"):
        cells: dict[int, str | None] = {}
        for cell in row.iter(f"{SHEET}c"):
            letters = re.match("[A-Z]+", cell.get("r", "A")).group()
            at = 0
            for ch in letters:
                at = at * 26 + ord(ch) - 64
            value, kind = cell.find(f"{SHEET}v"), cell.get("t")
            if kind == "inlineStr":
                cells[at] = "".join(t.text or "" for t in cell.iter(f"{SHEET}t"))
            elif value is not None:
                cells[at] = shared[int(value.text)] if kind == "s" else {"1": "TRUE", "0": "FALSE"}[value.text] if kind == "b" else value.text
        out.append([cells.get(k) for k in range(1, max(cells, default=0) + 1)])
    return out


def read_workbooks(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """Workbooks of a folder as one frame of text columns; each file is parsed by the task that reads it.

    The header is the first row of the first file; a file is as large as a task can hold.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")
    first = files.orderBy("path").limit(1).collect()
    if not first:
        return spark.createDataFrame([], "file string")
    rows = workbook_rows(bytes(first[0]["content"]), sheet)
    names = unique_names([x or "" for x in (rows[0] if rows else [])])

    def parse(batches):
        import pandas as pd

        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                body = [r for r in workbook_rows(bytes(content), sheet)[1:] if any(r)]
                fixed = [[name, *(r + [None] * len(names))[: len(names)]] for r in body]
                yield pd.DataFrame(fixed, columns=["file", *names], dtype=object)

    return files.mapInPandas(parse, ", ".join(["file string", *[f"`{n}` string" for n in names]]))


def parse_report(rows: DataFrame, material: str, tier: str, tiers: list[str]) -> tuple[DataFrame, DataFrame]:
    """(material, tier) of a criticality report, and counts of what was left out.

    Blank materials, unknown tiers and repeats after the first tier (the first of tiers' order) are counted, not kept.
    """
    m, t = F.trim(F.col(material)), F.upper(F.trim(F.col(tier)))
    rank = F.lit(None).cast("int")
    for k, name in enumerate(tiers):
        rank = F.when(t == name.upper(), k).otherwise(rank)
    read = rows.select(F.nullif(m, F.lit("")).alias("material"), rank.alias("rank"))
    fine = read.where("material IS NOT NULL AND rank IS NOT NULL")
    kept = fine.groupBy("material").agg(F.min("rank").alias("rank"), F.count(F.lit(1)).alias("n"))
    names = F.array(*[F.lit(x) for x in tiers])
    counts = read.agg(F.count_if(F.col("material").isNull()).alias("blank"), F.count_if(F.col("material").isNotNull() & F.col("rank").isNull()).alias("unknown_tier"))
    repeats = kept.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated"), F.count(F.lit(1)).alias("kept"))
    return kept.select("material", names[F.col("rank")].alias("tier")), counts.crossJoin(repeats)  # one row each


def day_or_none(text: str) -> date | None:
    try:
        return date.fromisoformat(text[:10])
    except ValueError:
        return None


def csv_number(c: Column, declared: str) -> Column:
    from partlake.functions.normalise import plain_number

    return plain_number(c, declared)
