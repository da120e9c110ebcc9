"""Files in any Hadoop store: listing, whole reads, all-or-nothing writes, bulk tables, workbooks, seeded plans, ordered scans."""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Callable, Iterator
from io import BytesIO
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partlake.sources.paged import MOST_PAGES, PagingError


def _place(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def list_files(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files of a folder, by name; none if it is not there."""
    fs, where = _place(spark, folder)
    if not fs.exists(where):
        return []
    return sorted((str(s.getPath().toString()), s.getLen()) for s in fs.listStatus(where) if s.isFile())


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """A whole small file, through the driver."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A whole file or nothing: written under another name, then renamed over the old one."""
    fs, where = _place(spark, path)
    part = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(part, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    if fs.exists(where):
        fs.delete(where, False)
    if not fs.rename(part, where):
        fs.delete(part, False)
        raise OSError(f"{path} could not be put in place")


def replace_table(rows: DataFrame, path: str) -> None:
    """A Parquet folder replaced as a whole: readers see the old or the new one, never a part."""
    spark = rows.sparkSession
    fs, where = _place(spark, path)
    fresh, old = f"{path}.{uuid.uuid4().hex}.new", f"{path}.{uuid.uuid4().hex}.old"
    rows.write.parquet(fresh)
    make = spark._jvm.org.apache.hadoop.fs.Path
    if fs.exists(where):
        fs.rename(where, make(old))
    fs.rename(make(fresh), where)
    fs.delete(make(old), True)


def bulk_load(rows: DataFrame, table: str, key: list[str], buckets: int = 16) -> DataFrame:
    """A raw table in buckets of its key, sorted in each: what an index after loading gives. Joins on the key do not shuffle it."""
    rows.write.mode("overwrite").bucketBy(buckets, *key).sortBy(*key).format("parquet").saveAsTable(table)
    return rows.sparkSession.table(table)


def letters(k: int) -> str:
    out = ""
    while k:
        k, r = divmod(k - 1, 26)
        out = chr(65 + r) + out
    return out


def workbook(sheets: dict[str, tuple[list[str], Iterator[tuple]]]) -> bytes:
    """An .xlsx file of named sheets of a header and rows; numbers stay numbers, all else is text, null is an empty cell.

    A report is as large as a person reads: rows are taken from iterators, but the file is made in memory.
    """
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pack = "http://schemas.openxmlformats.org/package/2006"

    def cell(r: int, k: int, x) -> str:
        at = f"{letters(k)}{r}"
        if x is None:
            return ""
        if isinstance(x, (int, float)) and not isinstance(x, bool):
            return f'<c r="{at}"><v>{x}</v></c>'
        return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(str(x))}</t></is></c>'

    out = BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, len(sheets) + 1))
        book.writestr("[Content_Types].xml", f'<Types xmlns="{pack}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        book.writestr("_rels/.rels", f'<Relationships xmlns="{pack}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        names = "".join(f'<sheet name="{escape(n[:31], {chr(34): "&quot;"})}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(sheets, 1))
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{k}" Type="{rel}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1))
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{pack}/relationships">{links}</Relationships>')
        for k, (head, rows) in enumerate(sheets.values(), 1):
            lines = [f'<worksheet xmlns="{main}"><sheetData>']
            for r, row in enumerate([head, *rows], 1):
                lines.append(f'<row r="{r}">' + "".join(cell(r, j, x) for j, x in enumerate(row, 1)) + "</row>")
            book.writestr(f"xl/worksheets/sheet{k}.xml", "".join([*lines, "</sheetData></worksheet>"]))
    return out.getvalue()


def export_workbook(frames: dict[str, DataFrame], path: str, most_rows: int = 100_000) -> int:
    """Frames as sheets of one workbook; more rows than ``most_rows`` in one raise, since a sheet is for reading. Bytes written."""
    sheets = {}
    for name, df in frames.items():
        rows = df.limit(most_rows + 1).collect()
        if len(rows) > most_rows:
            raise ValueError(f"sheet {name} has more than {most_rows} rows")
        sheets[name] = (df.columns, (tuple(r) for r in rows))
    data = workbook(sheets)
    write_bytes(next(iter(frames.values())).sparkSession, path, data)
    return len(data)


def seeded_plans(spark: SparkSession, path: str, schema: str, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(plans, rejected) of a captured CSV: typed rows with a whole key once each, the last line of equal keys; and the others
    with a reason."""
    from partlake.operators.relational import newest, reject_split
    from partlake.sources.files import read_csv

    raw = read_csv(spark, path).withColumn("_line", F.monotonically_increasing_id())
    kinds = dict(f.split() for f in schema.split(", "))
    typed = raw.select("_line", *[F.trim(n).try_cast(kind).alias(n) for n, kind in kinds.items()], *[F.nullif(F.trim(n), F.lit("")).alias(f"_raw_{n}") for n in kinds])
    lacks = F.coalesce(*[F.when(F.col(f"_raw_{k}").isNull(), True) for k in key])
    wrong = F.coalesce(*[F.when(F.col(f"_raw_{n}").isNotNull() & F.col(n).isNull(), True) for n in kinds])
    kept, rejected = reject_split(typed, {"MISSING_KEY": lacks, "NOT_OF_ITS_TYPE": wrong})
    return newest(kept, key, F.desc("_line")).select(*kinds), rejected.select(*kinds, "reject_reason")


def negotiate_order(page: Callable[[list[str]], object], keys: list[str]) -> list[str]:
    """The longest leading part of the keys that a service accepts as an order; none if it refuses all.

    ``page`` asks for one row in an order and raises where the service refuses.
    """
    for n in range(len(keys), 0, -1):
        try:
            page(keys[:n])
            return keys[:n]
        except PagingError:
            continue
    return []


def ordered_scan(page: Callable[[int, int, list[str]], list[dict]], keys: list[str], size: int, total: int | None = None, most_pages: int = MOST_PAGES) -> Iterator[list[dict]]:
    """Pages in the order of the keys, with the proof that none was lost: keys must rise from row to row, across pages too,
    and the count must be met. A service that reorders between pages is found out, not trusted."""
    got, before = 0, None
    for _ in range(most_pages):
        rows = page(got, size, keys)
        for r in rows:
            now = tuple(r.get(k) for k in keys)
            if before is not None and not before < now:
                raise PagingError(f"row {now} after {before}: repeated or out of order")
            before = now
        got += len(rows)
        if rows:
            yield rows
        if not rows or (len(rows) < size and (total is None or got >= total)):
            if total is not None and got != total:
                raise PagingError(f"{got} of {total} rows")
            return
    raise PagingError("the service does not end")


def select_columns(service, fields: list[str]) -> Callable[[int, int, list], list[dict]]:
    """Pages of a service with only the wanted fields, asked of it if it can (a ``fields`` argument), else cut here."""
    import inspect

    if "fields" in inspect.signature(service.page).parameters:
        return lambda skip, top, where: service.page(skip, top, where, fields=fields)
    return lambda skip, top, where: [{f: r.get(f) for f in fields} for r in service.page(skip, top, where)]
