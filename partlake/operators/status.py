"""Verdicts as ordered conditions: policy predicates, repair lines, requests, universe, watch rows, adoption, search."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partlake.functions.normalise import is_series, strip_padding
from partlake.functions.semantics import known, text_equal_numbers

c = F.col


def predicate(column: Column, op: str, values: list[str]) -> Column:
    """A policy predicate; a null or blank field is unknown (null)."""
    t = F.nullif(F.upper(F.trim(column)), F.lit(""))
    wanted = [v.upper() for v in values]
    tests = {"IN": t.isin(wanted), "NOT_IN": ~t.isin(wanted), "EQ": t == wanted[0], "NE": t != wanted[0], "STARTS": reduce(lambda a, b: a | b, [t.startswith(v) for v in wanted])}
    return F.when(t.isNotNull(), tests[op])


def policy(predicates: list[Column]) -> Column:
    """YES, NO or UNKNOWN of predicates that must all hold: one that fails decides, else one that is unknown."""
    every = reduce(lambda a, b: a & b, predicates)
    return F.when(every.isNull(), "UNKNOWN").when(every, "YES").otherwise("NO")


def po_line_state(deleted: Column, delivered: Column, doc_type: Column) -> Column:
    d = F.upper(F.trim(deleted))
    return F.when(d == "L", "DELETED").when(d == "S", "BLOCKED").when(F.upper(F.trim(doc_type)) == "AN", "NOT_AN_ORDER").when(F.upper(F.trim(delivered)) == "X", "CLOSED").otherwise("OPEN")


def repair_status(state: Column, ordered: Column, received: Column, dispatched: Column) -> Column:
    return (
        F.when(state == "DELETED", "CANCELLED")
        .when(received >= ordered, "RETURNED")
        .when(state == "CLOSED", "CLOSED_SHORT")
        .when(received > 0, "PARTLY_RETURNED")
        .when(dispatched > 0, "AT_VENDOR")
        .otherwise("NOT_DISPATCHED")
    )


def classify_requests(requests: DataFrame, lines: DataFrame) -> DataFrame:
    """Each request's one verdict, in fixed order: deleted, has a live order (either pointer), closed, open.

    ``requests``: pr, po (its pointer), deleted, closed; ``lines``: po, pr (back pointer), deleted, rfq. Blocked lines live.
    """
    live = lines.where(~c("deleted") & ~c("rfq"))
    back = live.where(c("pr").isNotNull()).select("pr").distinct().withColumn("_back", F.lit(True))
    forward = live.select("po").distinct().withColumn("_forward", F.lit(True))
    out = requests.join(back, "pr", "left").join(forward, "po", "left")
    ordered = c("_back").isNotNull() | c("_forward").isNotNull()
    return out.select("pr", F.when(c("deleted"), "DELETED").when(ordered, "LIVE_ORDER").when(c("closed"), "CLOSED").otherwise("OPEN").alias("verdict"))


def attest(lines: DataFrame, attestations: DataFrame, days: int) -> DataFrame:
    """The attestation of each repair line by the first rule that hits: named session, named document, newest in the window.

    ``lines``: line, session, doc, part, raised; ``attestations``: att, session, doc, part, day. A line without a raised
    date matches any day; ties go to the newest, then the greatest id.
    """
    pick = lambda rule: F.max_by(F.struct("att", F.lit(rule).alias("rule")), F.struct(c("day"), c("att")))

    def by(key: str, rule: str) -> DataFrame:
        right = attestations.where(c(key).isNotNull()).select(key, "att", "day")
        return lines.where(c(key).isNotNull()).select("line", key).join(right, key).groupBy("line").agg(pick(rule).alias(rule))

    # one attestation for each part and day, one question for each part and raised day, met in buckets as wide as the window
    daily = attestations.where(c("part").isNotNull() & c("day").isNotNull()).groupBy("part", "day").agg(F.max("att").alias("att"))
    bucket = lambda day: F.floor(F.unix_date(day) / max(days, 1))
    asked = lines.where(c("raised").isNotNull()).select("part", "raised").distinct().withColumn("_b", F.explode(F.array(*[bucket(c("raised")) + k for k in (-1, 0, 1)])))
    met = asked.join(daily.withColumn("_b", bucket(c("day"))), ["part", "_b"]).where(F.abs(F.datediff("day", "raised")) <= days)
    dated = met.groupBy("part", "raised").agg(pick("WINDOW").alias("WINDOW"))
    newest = daily.groupBy("part").agg(pick("WINDOW").alias("WINDOW"))
    near = lines.where(c("raised").isNotNull()).join(dated, ["part", "raised"]).unionByName(lines.where(c("raised").isNull()).join(newest, "part").select(*lines.columns, "WINDOW"))
    near = near.select("line", "WINDOW")
    out = lines.select("line").join(by("session", "SESSION"), "line", "left").join(by("doc", "DOCUMENT"), "line", "left").join(near, "line", "left")
    best = F.coalesce("SESSION", "DOCUMENT", "WINDOW")
    return out.select("line", best["att"].alias("att"), F.coalesce(best["rule"], F.lit("NONE")).alias("rule"))


def watch(spine: DataFrame) -> DataFrame:
    """Cover, cover with open orders, and the first exception. ``spine``: key, stock, open_po, rate, planned, acquired."""
    stock, po = F.coalesce("stock", F.lit(0.0)), F.coalesce("open_po", F.lit(0.0))
    cover = lambda x: F.when(c("rate") > 0, F.round(x / c("rate"), 6))
    out = spine.withColumn("cover", cover(stock)).withColumn("projected_cover", cover(stock + po)).withColumn("variance", F.when(known(c("planned"), c("acquired")), c("acquired") - c("planned")))
    flag = F.when((c("rate") > 0) & (stock <= 0), "OUT_OF_STOCK").when(c("projected_cover") > 24, "OVERSTOCK").when(c("cover") < 1, "LOW_COVER").when(c("variance") > 0, "ABOVE_PLAN").otherwise("NORMAL")
    return out.withColumn("flag", flag)


def lead_time_source(*sources: tuple[str, Column]) -> tuple[Column, Column]:
    """(days, label) of the first source that has a valid lead time, 1 to 730 days."""
    fine = [(name, F.when(x.between(1, 730), x)) for name, x in sources]
    label = F.lit(None).cast("string")
    for name, x in reversed(fine):
        label = F.when(x.isNotNull(), name).otherwise(label)
    return F.coalesce(*[x for _, x in fine]), label


def conversion(uses: Column, obsolete: Column, critical: Column, least: int = 4) -> Column:
    """Whether a material should be planned: often used or critical, unless obsolete; three-valued."""
    wanted = (uses > least) | critical
    return F.when(obsolete, "NO").when(wanted, F.when(obsolete.isNull(), "UNKNOWN").otherwise("YES")).when(wanted.isNull(), "UNKNOWN").otherwise("NO")


def adoption(proposed: dict[str, Column], current: dict[str, Column]) -> Column:
    """ADOPTED, PARTLY, NOT_ADOPTED by how many proposed parameters the current ones equal as numbers; UNKNOWN if none shows."""
    same = F.array(*[text_equal_numbers(proposed[k], current[k]) for k in proposed])
    seen, hits = F.size(F.filter(same, lambda x: x.isNotNull())), F.size(F.filter(same, lambda x: x))
    return F.when(seen == 0, "UNKNOWN").when(hits == seen, "ADOPTED").when(hits > 0, "PARTLY").otherwise("NOT_ADOPTED")


def identity_conflict(a: Column, b: Column, parts: list[str], generic: list[str]) -> Column:
    """Why two descriptions cannot be one thing: other part numbers, other component words, only generic words in common."""
    words = lambda x: F.array_distinct(F.split(F.trim(F.regexp_replace(F.upper(x), "[^A-Z0-9]+", " ")), " "))
    numbers = lambda w: F.filter(w, lambda t: t.rlike("[0-9]") & (F.length(t) >= 4))
    kinds = lambda w: F.array_intersect(w, F.array(*map(F.lit, parts)))
    x, y = words(a), words(b)
    both = lambda f: (F.size(f(x)) > 0) & (F.size(f(y)) > 0) & ~F.arrays_overlap(f(x), f(y))
    shared = F.array_except(F.array_intersect(x, y), F.array(*map(F.lit, generic)))
    return F.when(both(numbers), "PART_NUMBER").when(both(kinds), "COMPONENT").when(F.size(shared) == 0, "GENERIC_ONLY")


def new_acquisitions(requests: DataFrame, direct: DataFrame, repairs: DataFrame) -> DataFrame:
    """New-buy requests and direct orders, without documents that are repairs. All have doc, material."""
    return requests.select("doc", "material", F.lit("REQUEST").alias("origin")).unionByName(direct.select("doc", "material", F.lit("DIRECT").alias("origin"))).join(repairs.select("doc").distinct(), "doc", "left_anti")


def keyword_partition(lines: DataFrame, hit: Column, coded: Column, material: Column, prefix: str) -> DataFrame:
    """Lines with the wanted words as CODED (a series number), MATERIAL (another number) or TEXT_ONLY."""
    kind = F.when(coded | is_series(material, prefix), "CODED").when(F.nullif(strip_padding(material), F.lit("")).isNotNull(), "MATERIAL").otherwise("TEXT_ONLY")
    return lines.where(hit).withColumn("partition", kind)


def search(rows: DataFrame, query: str, limit: int) -> DataFrame:
    """Materials by number prefix (digits) or by all words of their text; exact, then prefix, then others, then by number.

    ``rows``: material, text.
    """
    q = query.strip()
    if re.fullmatch("[0-9]+", q):
        key = strip_padding(c("material"))
        wanted = q.lstrip("0") or "0"
        return rows.where(key.startswith(wanted)).orderBy(F.when(key == wanted, 0).otherwise(1), "material").limit(limit)
    words = [w for w in re.split(r"\W+", q.upper()) if w]
    if not words:
        return rows.limit(0)
    text = F.upper("text")
    every = reduce(lambda a, b: a & b, [text.contains(w) for w in words])
    return rows.where(every).orderBy(F.when(text == " ".join(words), 0).when(text.startswith(words[0]), 1).otherwise(2), "material").limit(limit)


#: Alphabet of session ids: digits and capitals without those that are easily mistaken.
ALPHABET = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def check_character(body: Column) -> Column:
    """The check character of an id: places weighted 1, 2, 3, ... modulo the alphabet."""
    weighted = F.zip_with(F.split(F.upper(body), ""), F.sequence(F.lit(1), F.length(body)), lambda ch, k: (F.position(ch, F.lit(ALPHABET)) - 1) * k)
    total = F.aggregate(weighted, F.lit(0), lambda s, x: s + x)
    return F.substring(F.lit(ALPHABET), F.pmod(total, F.lit(len(ALPHABET))) + 1, F.lit(1))


def session_ids(text: Column, prefix: str = "S") -> Column:
    """Ids such as S-ABC123-K in a free text whose check character is right."""
    found = F.regexp_extract_all(F.upper(text), F.lit(rf"\b{prefix}-([0-9A-Z]{{6}}-[0-9A-Z])\b"), 1)
    return F.filter(found, lambda x: check_character(F.substring(x, 1, 6)) == F.substring(x, 8, 1))
