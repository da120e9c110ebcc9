import datetime

import pytest
from pyspark.sql import functions as F

from partlake.functions import formula, normalise, semantics
from partlake.operators import status


def values(spark, inputs, expression, kind="string"):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(inputs)], f"k int, x {kind}")
    return [r[0] for r in df.orderBy("k").select(expression(F.col("x"))).collect()]


def test_keys(spark):
    assert values(spark, [" 000123 ", "000", "AB01", None], normalise.key) == ["123", "", "AB01", None]
    assert values(spark, ["000", "7"], normalise.key_or_null) == [None, "7"]
    assert values(spark, ["123", "A1", "1234567890123456789"], normalise.pad_key) == ["000000000000000123", "A1", "1234567890123456789"]
    assert values(spark, ["000123", "0", "A01"], normalise.strip_padding) == ["123", "0", "A01"]
    assert values(spark, ["000000008000000000", "5000000800", None], lambda c: normalise.is_series(c, "80")) == [True, False, False]


def test_dates(spark):
    texts = ["20240105", "2024-01-05T10:00:00", "05.01.2024", "00000000", "0000-00-00", "soon", None]
    assert values(spark, texts, normalise.date_text) == ["2024-01-05"] * 3 + [None, None, "soon", None]
    assert values(spark, ["20240105", "2024-01-05", "/Date(1704412800000)/", "20241399", "x"], normalise.day) == [datetime.date(2024, 1, 5)] * 3 + [None, None]


def test_numbers(spark):
    assert values(spark, ["1,234.5", "12.5-", "x"], lambda c: normalise.number(c).cast("double")) == [1234.5, -12.5, None]
    assert values(spark, ["0,989", "1.234,5"], lambda c: normalise.number(c, "german").cast("double")) == [0.989, 1234.5]
    assert values(spark, ["5", "5.0", "5.5", ""], normalise.integer) == [5, 5, None, None]
    assert values(spark, ["x", " X", "", None], normalise.flag) == [True, True, False, False]
    assert values(spark, ["PT1H2M3S", "PT5M"], lambda c: normalise.decode(c, "Edm.Time")) == ["01:02:03", "00:05:00"]


def test_header_and_vocabulary(spark):
    assert normalise.unique_names(["A b", "", "a-B", None]) == ["a_b", "column_2", "a_b_2", "column_4"]
    df = spark.createDataFrame([("0012", "1,5-")], "MATNR string, labst string")
    wanted = {"material": (["MATNR"], "key"), "unrestricted": (["LABST"], "num"), "plant": (["WERKS"], "text")}
    assert normalise.normalise(df, wanted, "german").first() == ("12", "-1.5", None)


def test_buckets(spark):
    assert semantics.bucket_labels((15, 30, 45, 60)) == ["0-15", "16-30", "31-45", "46-60", "60+"]
    assert values(spark, [0, 15, 16, 61, -3, None], semantics.aging_bucket, "int") == ["0-15", "0-15", "16-30", "60+", "0-15", None]


def test_formula_readers_agree(spark):
    import duckdb

    source = "max(a / b, -c) * 2 + abs(a - c) - min(a, b)"
    node = formula.parse(source, {"a", "b", "c"})
    rows = [(1.0, 2.0, 3.0), (4.0, 0.0, 1.0), (None, 1.0, 1.0), (5.0, -2.0, 9.5)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = [r[0] for r in df.select(formula.to_column(node, {k: F.col(k) for k in "abc"})).collect()]
    con = duckdb.connect()
    for row, x in zip(rows, got):
        here = dict(zip("abc", row))
        assert formula.evaluate(node, here) == x
        assert con.execute(f"SELECT {formula.to_sql(node, {k: 'NULL' if v is None else str(v) for k, v in here.items()})}").fetchone()[0] == x
    assert formula.evaluate(formula.parse("a > 1 or b > 1", {"a", "b"}, "condition"), {"a": None, "b": 2}) is True
    assert formula.to_text(node, {"a": "use"}).startswith("((max(use / b, -c) * 2)")
    assert formula.parse("+a × 2 ÷ b", {"a", "b"}) == formula.parse("a * 2 / b", {"a", "b"})
    assert formula.parse("a ≤ b and b ≥ 1", {"a", "b"}, "condition") == formula.parse("a <= b and b >= 1", {"a", "b"}, "condition")
    for bad in ("a.b", "__import__('x')", "a <", "a < b < c", "d + 1", "a and b", "[a]", "a ** 2", "a" * 301, "a > 1", "min(a, b, c)", "a + 9e13", "a\0"):
        with pytest.raises(formula.FormulaError):
            formula.parse(bad, {"a", "b", "c"})


def test_session_ids(spark):
    alphabet = status.ALPHABET
    body = "A1B2C3"
    check = alphabet[sum((alphabet.index(ch)) * k for k, ch in enumerate(body, 1)) % len(alphabet)]
    wrong = alphabet[(alphabet.index(check) + 1) % len(alphabet)]
    assert values(spark, [f"see S-{body}-{check} and S-{body}-{wrong}", "none"], status.session_ids) == [[f"{body}-{check}"], []]


def test_identity(spark):
    df = spark.createDataFrame([("PUMP SEAL 1234A", "PUMP SEAL 9999B"), ("BEARING BIG", "SEAL BIG"), ("KIT SPARE", "KIT OTHER"), ("PUMP SEAL", "SEAL, PUMP")], "a string, b string")
    got = df.select(status.identity_conflict(F.col("a"), F.col("b"), ["BEARING", "SEAL"], ["KIT", "BIG"])).collect()
    assert [r[0] for r in got] == ["PART_NUMBER", "COMPONENT", "GENERIC_ONLY", None]
