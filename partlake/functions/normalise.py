"""ERP text to typed values. A bad cell becomes null and never fails a job."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MATERIAL_WIDTH = 18


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def key(c: Column) -> Column:
    """Trimmed, without leading zeros; an all-zero key is empty, null stays null."""
    return F.regexp_replace(F.trim(c), "^0+", "")


def key_or_null(c: Column) -> Column:
    return F.nullif(key(c), F.lit(""))


def pad_key(c: Column, width: int = MATERIAL_WIDTH) -> Column:
    """Digits padded with zeros to a width; longer or other keys as they are."""
    t = F.trim(c)
    return F.when(t.rlike("^[0-9]+$") & (F.length(t) < width), F.lpad(t, width, "0")).otherwise(t)


def strip_padding(c: Column) -> Column:
    """Leading zeros off an all-digit key (one zero of an all-zero one stays); other keys as they are."""
    t = F.trim(c)
    return F.when(t.rlike("^[0-9]+$"), F.regexp_replace(t, "^0+(?=.)", "")).otherwise(t)


def date_text(c: Column) -> Column:
    """ISO text of yyyymmdd, yyyy-mm-dd with or without a time, and dd.mm.yyyy; zero dates are null, other text stays."""
    t = F.trim(c)
    return (
        F.when((t == "") | t.rlike("^0+$") | t.rlike("^0000-00-00"), F.lit(None).cast("string"))
        .when(t.rlike("^[0-9]{8}$"), F.concat_ws("-", F.substring(t, 1, 4), F.substring(t, 5, 2), F.substring(t, 7, 2)))
        .when(t.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.substring(t, 1, 10))
        .when(t.rlike("^[0-9]{2}[.][0-9]{2}[.][0-9]{4}$"), F.concat_ws("-", F.substring(t, 7, 4), F.substring(t, 4, 2), F.substring(t, 1, 2)))
        .otherwise(t)
    )


def day(c: Column) -> Column:
    """A date of compact, ISO or /Date(ms)/ text; null otherwise."""
    t = F.trim(c)
    wire = F.regexp_extract(t, r"^/Date\((-?[0-9]+)", 1)
    return F.coalesce(
        F.when(t.rlike("^[0-9]{8}$"), F.try_to_date(t, "yyyyMMdd")),
        F.when(t.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.try_to_date(F.substring(t, 1, 10), "yyyy-MM-dd")),
        F.when(wire != "", F.timestamp_millis(wire.try_cast("long")).cast("date")),
    )


def plain_number(c: Column, form: str = "us") -> Column:
    """Number text in plain form: grouping off, decimal point, a trailing minus in front. ``form`` is us or german."""
    t = F.regexp_replace(F.trim(c), r"\s", "")
    if form == "german":
        t = F.translate(t, ".", "")
        t = F.translate(t, ",", ".")
    elif form == "us":
        t = F.translate(t, ",", "")
    else:
        raise ValueError(f"number form {form!r} is neither us nor german")
    return F.when(t.endswith("-"), F.concat(F.lit("-"), F.substring(t, F.lit(1), F.length(t) - 1))).otherwise(t)


def number(c: Column, form: str = "us") -> Column:
    return plain_number(c, form).try_cast("decimal(38,6)")


def integer(c: Column, form: str = "us") -> Column:
    """A whole number; null for fractions."""
    n = number(c, form)
    return F.when(n == F.floor(n), n).try_cast("long")


def flag(c: Column) -> Column:
    """X, in either case, is set; anything else is not."""
    return F.coalesce(F.upper(F.trim(c)) == "X", F.lit(False))


def decode(c: Column, edm: str) -> Column:
    """A wire value by its declared type, never by what it looks like."""
    t = F.trim(c)
    if edm in ("Edm.DateTime", "Edm.DateTimeOffset"):
        wire = F.regexp_extract(t, r"^/Date\((-?[0-9]+)", 1)
        return F.coalesce(F.when(wire != "", F.timestamp_millis(wire.try_cast("long"))), F.try_to_timestamp(t))
    if edm == "Edm.Time":
        part = lambda unit: F.coalesce(F.regexp_extract(t, f"([0-9]+){unit}", 1).try_cast("int"), F.lit(0))
        return F.when(t.rlike("^PT"), F.format_string("%02d:%02d:%02d", part("H"), part("M"), part("S")))
    if edm == "Edm.Boolean":
        return F.when(F.lower(t).isin("true", "x", "1"), True).when(F.lower(t).isin("false", "", "0"), False)
    if edm in ("Edm.Decimal", "Edm.Double"):
        return t.try_cast("decimal(38,6)")
    if edm in ("Edm.Int16", "Edm.Int32", "Edm.Int64", "Edm.Byte"):
        return t.try_cast("long")
    return c


KINDS = {"key": key, "date": date_text, "num": plain_number, "text": lambda c: c}


def resolve(wanted: dict[str, tuple[list[str], str]], present: list[str]) -> dict[str, str | None]:
    """The input column of each wanted one: its label first, then its alternates, regardless of case."""
    have = {c.lower(): c for c in reversed(present)}
    return {name: next((have[x.lower()] for x in [name, *others] if x.lower() in have), None) for name, (others, _) in wanted.items()}


def normalise(df: DataFrame, wanted: dict[str, tuple[list[str], str]], form: str = "us") -> DataFrame:
    """One vocabulary over several: each wanted column by its kind, missing ones typed nulls."""
    found = resolve(wanted, df.columns)

    def one(name: str) -> Column:
        source, kind = found[name], wanted[name][1]
        if source is None:
            return F.lit(None).cast("string").alias(name)
        c = F.col(f"`{source}`").cast("string")
        return (plain_number(c, form) if kind == "num" else KINDS[kind](c)).alias(name)

    return df.select(*[one(n) for n in wanted])


def like_any(c: Column, words: list[str]) -> Column:
    """Whether a text holds any of the words, case ignored, wildcards taken literally."""
    return F.coalesce(F.lower(c).rlike("|".join(re.escape(w.lower()) for w in words)), F.lit(False)) if words else F.lit(False)


def is_series(c: Column, prefix: str, width: int = 10) -> Column:
    """Whether a key, padding off, has the width, digits only and the prefix."""
    k = strip_padding(c)
    return F.coalesce((F.length(k) == width) & k.rlike("^[0-9]+$") & k.startswith(prefix), F.lit(False))


def twin_text(c: Column) -> Column:
    """Upper case, single blanks: what two descriptions of one thing share."""
    return F.upper(F.regexp_replace(F.trim(c), r"\s+", " "))


def unique_names(names: list[str]) -> list[str]:
    """Header repair: other characters to _, blanks named by place, repeats numbered."""
    out: list[str] = []
    for k, raw in enumerate(names, 1):
        base = re.sub(r"\W+", "_", (raw or "").strip()).strip("_").lower() or f"column_{k}"
        name, n = base, 2
        while name in out:
            name, n = f"{base}_{n}", n + 1
        out.append(name)
    return out
