import json
import zipfile

import pytest
from pyspark.sql import functions as F

from partlake.sources import files, paged
from partlake.streaming import streams


def test_paged_source(spark, tmp_path):
    rows = [{"id": k, "plant": k % 3, "text": f"t{k}"} for k in range(230)]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, rows[:100])))
    (tmp_path / "b.jsonl").write_text("\n".join(map(json.dumps, rows[100:])))
    paged.register(spark)
    options = {"root": str(tmp_path), "pagesize": "7", "pages": "4", "capabilities": json.dumps({"plant": "HONOURED", "text": "IGNORED"})}
    df = spark.read.format("paged").schema("id long, plant long, text string").options(**options).load()
    assert df.count() == 230
    assert sorted(r.id for r in df.where("plant = 1 AND text >= 't5'").collect()) == sorted(r["id"] for r in rows if r["plant"] == 1 and r["text"] >= "t5")
    assert paged.duplicate_keys(df.unionByName(df.where("id < 10")), ["id"]).first().duplicates == 10


def test_pages():
    data = list(range(25))
    assert [len(p) for p in paged.iter_pages(lambda s, n: data[s : s + n], 10)] == [10, 10, 5]
    with pytest.raises(paged.PagingError):
        list(paged.iter_pages(lambda s, n: data[s : s + n], 10, 30))
    with pytest.raises(ValueError):
        paged.check_filter(paged.Capabilities({"a": "IGNORED"}), ["a"])


def test_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text('Material,,Material\n"0001","a\nb",\x00c\n,,\n0002,d\n')
    df = files.read_csv(spark, str(tmp_path / "x.csv"))
    assert df.columns == ["material", "column_2", "material_2"]
    assert sorted(map(tuple, df.collect())) == [("0001", "a\nb", "c"), ("0002", "d", None)]


def test_landing(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "k long, v string")
    files.write_landing(df, str(tmp_path), "set", "2024-01-01")
    files.write_landing(df.withColumn("v", F.lit("b")), str(tmp_path), "set", "2024-01-02")
    assert files.latest_run(spark, str(tmp_path), "set") == "2024-01-02"
    assert files.read_landing(spark, str(tmp_path), "set", "k long, v string").first() == (1, "b")
    found = files.fingerprints(spark, f"{tmp_path}/set/run_date=2024-01-01", "*.json")
    assert found.count() >= 1 and files.not_yet_loaded(found, found).count() == 0


def test_workbook(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>Material</t></si><si><t>Qty</t></si><si><t>A1</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2" t="s"><v>2</v></c><c r="C2"><v>5</v></c></row></sheetData></worksheet>')
    df = files.read_workbooks(spark, str(tmp_path))
    assert df.columns == ["file", "material", "column_2", "qty"] and df.select("material", "qty").first() == ("A1", "5")


def test_report(spark):
    rows = spark.createDataFrame([("a", "A"), ("a", "b"), ("", "A"), ("c", "?"), ("d", "B")], "m string, t string")
    kept, counts = files.parse_report(rows, "m", "t", ["A", "B"])
    assert sorted(map(tuple, kept.collect())) == [("a", "A"), ("d", "B")]
    assert counts.first().asDict() == {"blank": 1, "unknown_tier": 1, "repeated": 1, "kept": 2}


def test_streams(spark, tmp_path):
    schema = "k string, ts timestamp, v long"
    make = lambda rows, n: spark.createDataFrame(rows, "k string, t string, v long").select("k", F.col("t").cast("timestamp").alias("ts"), "v").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{n}")
    make([("a", "2024-01-01 00:05:00", 1), ("a", "2024-01-01 00:50:00", 2), ("b", "2024-01-01 01:10:00", 3)], 1)
    read = lambda: streams.landing(spark, f"{tmp_path}/in/*", schema)
    windows = lambda: streams.updates_once(streams.tumbling(read(), "1 hour", "2 hours", ["k"], "v"), f"{tmp_path}/out", f"{tmp_path}/state", ["start", "k"])
    assert sorted((r.k, r.n, r.total) for r in windows().collect()) == [("a", 2, 3), ("b", 1, 3)]
    make([("a", "2024-01-01 00:55:00", 10)], 2)
    assert sorted((r.k, r.n, r.total) for r in windows().collect()) == [("a", 3, 13), ("b", 1, 3)]
    streams.append_once(streams.once_within(read(), "1 day", ["k"]), f"{tmp_path}/once", f"{tmp_path}/once-state")
    assert sorted(r.k for r in spark.read.parquet(f"{tmp_path}/once").collect()) == ["a", "b"]


def test_changed_only(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for n, rows in enumerate([[("a", 1), ("b", 1)], [("a", 1), ("b", 2)]]):
            spark.createDataFrame(rows, "k string, v long").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
            stream = streams.changed_only(streams.landing(spark, f"{tmp_path}/in/*", "k string, v long"), "k", ["v"])
            streams.append_once(stream, f"{tmp_path}/out", f"{tmp_path}/state")
        assert sorted(r.k for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "b", "b"]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_store_round_trips(spark, tmp_path):
    from partlake.sources import store

    path = str(tmp_path / "a" / "x.bin")
    store.write_bytes(spark, path, b"one")
    store.write_bytes(spark, path, b"\x00two")
    assert store.read_bytes(spark, path) == b"\x00two" and [n for _, n in store.list_files(spark, str(tmp_path / "a"))] == [4]
    assert store.list_files(spark, str(tmp_path / "none")) == []
    table = str(tmp_path / "t")
    store.replace_table(spark.range(3), table)
    store.replace_table(spark.range(5), table)
    assert spark.read.parquet(table).count() == 5 and sorted(p.name for p in tmp_path.iterdir() if p.is_dir()) == ["a", "t"]


def test_exported_workbooks_read_back(spark, tmp_path):
    from partlake.sources import files, store

    one = spark.createDataFrame([(1, "a & b", None), (2, "<c>", 2.5)], "k int, t string, x double")
    path = str(tmp_path / "report.xlsx")
    assert store.export_workbook({"First": one, "Second": one.select("t")}, path) > 0
    data = store.read_bytes(spark, path)
    assert files.workbook_rows(data, "First") == [["k", "t", "x"], ["1", "a & b"], ["2", "<c>", "2.5"]]
    assert files.workbook_rows(data, "Second")[2] == ["<c>"]
    assert [store.letters(k) for k in (1, 26, 27, 703)] == ["A", "Z", "AA", "AAA"]
    with pytest.raises(ValueError):
        store.export_workbook({"First": one}, path, most_rows=1)


def test_ordered_scan_finds_a_service_out():
    from partlake.sources import store
    from partlake.sources.paged import PagingError

    rows = [{"k": k} for k in range(10)]
    page = lambda skip, top, keys: sorted(rows, key=lambda r: r["k"])[skip : skip + top]
    assert [r["k"] for p in store.ordered_scan(page, ["k"], 4, 10) for r in p] == list(range(10))
    with pytest.raises(PagingError):
        list(store.ordered_scan(page, ["k"], 4, 11))
    shuffled = lambda skip, top, keys: (rows if skip == 0 else rows[::-1])[skip : skip + top]
    with pytest.raises(PagingError):
        list(store.ordered_scan(shuffled, ["k"], 4))

    def picky(keys):
        if len(keys) > 2:
            raise PagingError("too long")

    assert store.negotiate_order(picky, ["a", "b", "c"]) == ["a", "b"]


def test_seeded_plans(spark, tmp_path):
    from partlake.sources import store

    (tmp_path / "plans.csv").write_text("plan,qty,day\n1,2.5,2024-01-01\n1,3,2024-01-02\n,4,2024-01-01\n2,many,2024-01-01\n3,,2024-02-01\n")
    kept, rejected = store.seeded_plans(spark, str(tmp_path / "plans.csv"), "plan long, qty double, day date", ["plan"])
    assert sorted((r.plan, r.qty) for r in kept.collect()) == [(1, 3.0), (3, None)]
    assert sorted(r.reject_reason for r in rejected.collect()) == ["MISSING_KEY", "NOT_OF_ITS_TYPE"]
