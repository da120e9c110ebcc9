"""Identity, blend, pagination-like and similarity operators against plain Python."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from partlake.operators import blend, identity, portfolio, recommend, scope, similarity
from partlake.plans import recommend as plans

SMALL = "/root/testdata/sf0.001"


def plain_profile(text):
    """Types, numbers, distinctive and generic words of a description by a walk over its words."""
    words = re.findall(identity.WORD, (text or "").upper())
    singular = [identity.one(w) if not re.search("[0-9]", w) else w for w in words]
    taken = [None] * len(words)

    def mark(phrases, label):
        for i in range(len(words)):
            for phrase, name in phrases:
                span = range(i, i + len(phrase))
                if i + len(phrase) <= len(words) and singular[i : i + len(phrase)] == phrase and not any(taken[j] for j in span):
                    for j in span:
                        taken[j] = (label, name)
                    break

    for phrase in identity.CONTEXTS:
        mark([(phrase.split(), "")], "context")
    mark([(p.split(), name) for p, name in identity.phrases_of(identity.TYPES).items()], "type")
    common = {identity.one(w) for term in identity.GENERIC for w in [term, *re.findall(identity.WORD, term)]} | set(identity.GENERIC)
    number = lambda w: len(re.sub("[-/.]", "", w)) >= 6 and re.search("[0-9]", w) and not re.match(identity.SPECIFICATION, w)
    short = lambda w: re.sub("[-/.]", "", w)
    return (
        {t[1] for t in taken if t and t[0] == "type"},
        {short(w) for w in words if number(w)},
        {short(w) if number(w) else s for w, s, t in zip(words, singular, taken) if not (t and t[0] == "type") and s not in common and len(s) > 1},
        {s for s in singular if s in common},
    )


TEXTS = ["FILTER PRESS FILTER ELEMENTS", "Spray nozzles 100x50x6 PN:5112305242", "Proximity switch, M12X1.5 sensor", "gear box bearings 6310-2RS", "V-belt kit 55KW AB-12345", "O-ring; gaskets", "bus glass", None, "", "spare part", "wrenches & spanners", "press filter press"]


def test_profiles_against_a_walk(spark):
    df = identity.with_profile(spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "id int, text string"), "text", "")
    for r in df.collect():
        if r.text != "press filter press":  # which machine's name comes first is a matter of order
            assert (set(r.types), set(r.numbers), set(r.distinctive), set(r.generic)) == plain_profile(r.text), r.text
    names = plans.described(spark, SMALL).collect()
    got = {r.id: r for r in identity.with_profile(spark.createDataFrame(names), "text", "").collect()}
    assert all((set(got[n.id].types), set(got[n.id].numbers), set(got[n.id].distinctive), set(got[n.id].generic)) == plain_profile(n.text) for n in names)


def verdicts(spark, rows):
    df = spark.createDataFrame(rows, "a string, b string, same boolean, text double")
    df = identity.with_profile(identity.with_profile(df, "a", "t_"), "b", "d_")
    return [r[0] for r in df.select(identity.verdict(F.col("same"), F.col("text"))).collect()]


def test_identity_verdicts(spark):
    rows = [
        ("BEARING BIG", "SEAL BIG", True, 0.9, "REJECTED_COMPONENT_CONFLICT"),
        ("SENSOR AB-123456", "PROXIMITY SWITCH AB123456", False, 0.1, "CONFIRMED_PART_NUMBER"),
        ("PUMP SHAFT", "PUMP SHAFT LONG", True, 0.1, "CONFIRMED_GROUP_COMPONENT_TYPE"),
        ("PUMP SHAFT", "PUMP IMPELLER", True, 0.1, "INSUFFICIENT_GROUP_ONLY"),
        ("ROTOR ASSY", "STATOR ASSY", True, 0.9, "INSUFFICIENT_GENERIC_OVERLAP"),
        ("ROTOR", "ROTOR LONG", True, 0.9, "CONFIRMED_GROUP_TEXT"),
        ("ROTOR", "STATOR", False, None, "INSUFFICIENT_NO_TEXT"),
        ("rotor  a", "ROTOR A", False, None, "CONFIRMED_TEXT"),
        ("ROTOR", "STATOR", False, 0.5, "INSUFFICIENT_TEXT"),
        ("ROTOR", "STATOR", None, 0.7, "CONFIRMED_TEXT"),
        (None, "STATOR", True, None, "INSUFFICIENT_GROUP_ONLY"),
    ]
    assert verdicts(spark, [r[:4] for r in rows]) == [r[4] for r in rows]


def plain_blend(r, draws, caps):
    q = [max(x, 0) for x in r["q"]] if r["q"] else None
    if not q:
        return ("NO_BUCKETS",)
    annual = sum(q)
    if annual <= 0:
        return ("NO_CONSUMPTION",)
    if r["lead_days"] is None:
        return ("NO_LEAD_TIME",)
    months = max(1, math.ceil(r["lead_days"] / 30.44))
    rng = np.random.default_rng(int.from_bytes(hashlib.sha256(f"42|{r['material']}".encode()).digest()[:8], "big"))
    sums = np.array(q)[rng.integers(0, len(q), (draws, months))].sum(axis=1)
    rop, monthly, ratio, w = float(np.percentile(sums, 85)), annual / len(q), 1.2, 1.0
    ss = max(0.0, rop - float(sums.mean()))
    if r["used_peers"]:
        w = r["events"] / (r["events"] + 4 * r["quality"]) if r["events"] > 0 else 0.0
        rop, ss, ratio = w * rop + (1 - w) * r["r_rop"] * monthly, w * ss + (1 - w) * r["r_ss"] * monthly, max(r["r_max"], 1.2)
    if r["issue_floor"] is not None and rop < r["issue_floor"]:
        rop = r["issue_floor"]
    most = min(rop * ratio, annual)
    for price, cover in sorted(caps, reverse=True):
        if r["unit_price"] is not None and r["unit_price"] >= price:
            most = min(most, cover * monthly)
            break
    most = max(most, rop)
    return ("BLENDED" if r["used_peers"] else "OWN_ONLY", *(math.ceil(x - 1e-9) for x in (rop, ss, most)))


def test_blend_against_plain_python(spark):
    rng = random.Random(4)
    rows = []
    for k in range(60):
        peers = rng.choice([0, 3])
        rows.append({
            "material": k, "q": rng.choice([None, [0.0] * 12, [float(rng.choice([0, 0, 3, 8])) for _ in range(24)]]), "lead_days": rng.choice([None, 5.0, 70.0]), "events": rng.choice([0, 2, 9]), "used_peers": peers,
            "r_rop": 2.5 if peers else None, "r_ss": 1.2 if peers else None, "r_max": rng.choice([1.1, 1.9]) if peers else None, "quality": 0.6 if peers else None, "issue_floor": rng.choice([None, 3.0, 40.0]), "unit_price": rng.choice([None, 10.0, 900.0]),
        })
    schema = "material long, q array<double>, lead_days double, events long, used_peers long, r_rop double, r_ss double, r_max double, quality double, issue_floor double, unit_price double"
    frame = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    caps = [(5.0, 3.0), (500.0, 1.0)]
    out = {x.material: x for x in blend.blend(blend.own_estimates(frame, ["material"], draws=500), caps).collect()}
    for r in rows:
        want = plain_blend(r, 500, caps)
        x = out[r["material"]]
        assert x.status == want[0]
        assert (x.rop, x.ss, x.max_stock) == (want[1:] if len(want) > 1 else (None, None, None)), r


def test_registered_blend_covers_every_series(spark):
    out = plans.credibility_blend(spark, SMALL).collect()
    assert len(out) == plans.keyed(spark, SMALL).count() and {r.status for r in out} <= {"BLENDED", "OWN_ONLY", "NO_CONSUMPTION", "NO_LEAD_TIME"}
    assert all(r.max_stock >= r.rop for r in out if r.rop is not None)


def test_cosine_slices_change_nothing(spark):
    rng = np.random.default_rng(2)
    rows = [(int(k % 3), k, rng.normal(size=8).tolist()) for k in range(300)] + [(0, 1000, [0.0] * 8), (None, 7, [1.0] * 8)]
    frame = spark.createDataFrame(rows, "p int, id long, v array<double>")
    want = {}
    for p, k, v in rows[:300]:
        if k % 10 == 0:
            scores = sorted((-round(min(max(float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), 0), 1), 6), j) for q, j, w in rows[:300] if q == p and j != k)
            want[k] = [j for _, j in scores[:5]]
    for size in (1 << 20, 512):
        got = {}
        for r in similarity.cosine_top(frame, "p", "id", "v", 10, 5, slice_bytes=size).orderBy("t_id", "rank").collect():
            got.setdefault(r.t_id, []).append(r.d_id)
        assert {k: v for k, v in got.items() if k != 1000} == want


def test_filters_that_do_not_exist(spark):
    with pytest.raises(ValueError):
        portfolio.filtered(spark.range(1), colour="red")


def test_capture_is_idempotent(spark):
    empty = spark.createDataFrame([], "month date, payload string, revision int")
    one = spark.createDataFrame([("a", "{}")], "m string, payload string").select(F.lit("2024-01-01").cast("date").alias("month"), "payload")
    once = portfolio.capture(empty, one)
    assert portfolio.capture(once, one).count() == 1
    other = portfolio.capture(once, one.withColumn("payload", F.lit("{1}")))
    assert sorted(r.revision for r in other.collect()) == [1, 2]


def test_key_ranges_cover_and_balance(spark):
    rows = [(k, 1 + (k * 7) % 50) for k in range(2000)] + [(5000, 900)]
    out = sorted(portfolio.key_ranges(spark.createDataFrame(rows, "k long, w long"), "k", "w", 200).collect())
    assert sum(r.keys for r in out) == len(rows) and all(a.high < b.low for a, b in zip(out, out[1:]))
    assert all(r.weight < 200 + 50 for r in out[:-1])


def test_unknown_plants_and_texts(spark):
    df = spark.createDataFrame([("1300 ",), ("",), (None,), ("9",)], "p string")
    got = [tuple(r) for r in df.select(scope.in_plants(F.col("p"), ["1300"]), scope.in_plants_or_malformed(F.col("p"), ["1300"])).collect()]
    assert got == [(True, True), (False, True), (False, True), (False, False)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "material long, plant int, quantity double, is_active boolean")
    assert portfolio.on_hand(none).collect() == []
    priced = spark.createDataFrame([], "material long, plant int, kind string, price double")
    assert recommend.new_item_price(priced).collect() == []


def test_arima_finds_the_order_that_made_a_series():
    from partlake.operators import challengers

    rng = np.random.default_rng(3)
    hits = 0
    for _ in range(10):
        x = np.zeros(400)
        for k in range(1, 400):
            x[k] = 5 + 0.8 * (x[k - 1] - 5) + rng.normal()
        found = [(challengers.fit_order(x, o, 1), o) for o in challengers.ORDERS]
        best = min((f[0], o) for f, o in found if f)
        hits += best[1][0] >= 1
        # one step of an AR(1) is its least-squares line
        a, b = np.linalg.lstsq(np.column_stack([np.ones(399), x[:-1]]), x[1:], rcond=None)[0]
        assert abs(challengers.fit_order(x, (1, 0, 0), 1)[1] - (a + b * x[-1])) < 1e-9
    assert hits >= 9
    flat = challengers.fit_order(np.full(24, 4.0), (0, 0, 0), 3)
    assert abs(flat[1] - 4) < 1e-9 and challengers.fit_order(np.ones(4), (0, 1, 2), 3) is None


def test_pooled_model_learns_a_quantile():
    from partlake.operators import challengers

    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 3))
    y = np.where(x[:, 0] > 0, 10.0, 2.0) + rng.exponential(size=3000)
    model = challengers.boost(x[:2000], y[:2000], 0.9, rounds=80)
    p = model.predict(x[2000:])
    assert 0.85 < (y[2000:] <= p).mean() < 0.95
    pinball = lambda f: np.where(y[2000:] > f, 0.9 * (y[2000:] - f), 0.1 * (f - y[2000:])).mean()
    assert pinball(p) < 0.6 * pinball(np.full(1000, np.quantile(y[:2000], 0.9)))


def test_challengers_cover_every_series(spark):
    from partlake.plans import rules as rule_plans

    series = plans.keyed(spark, SMALL).count()
    out = rule_plans.forecast_arima(spark, SMALL).collect()
    assert len(out) == series and all(r.rate is None or r.rate >= 0 for r in out) and sum(r.status == "SUCCESS" for r in out) > 0.9 * series
    pooled = rule_plans.forecast_pooled(spark, SMALL).collect()
    assert len(pooled) == series and all(r.predicted >= 0 for r in pooled)
    assert sum(r.actual <= r.predicted for r in pooled) > 0.8 * series


def test_rules_are_versioned_and_checked(spark):
    from partlake.functions.formula import FormulaError
    from partlake.operators import rules

    none = spark.createDataFrame([], "version long, author string, edits string")
    with pytest.raises(FormulaError):
        rules.save(none, {"at_risk": "colour > 1"}, "me")
    with pytest.raises(FormulaError):
        rules.parsed({"avg_daily_use": "stock_needed * 2"})  # a stage cannot use a later one
    once = rules.save(none, {"at_risk": "stock_on_hand < 5"}, "me")
    twice = rules.save(rules.save(once, {"at_risk": "stock_on_hand < 5"}, "you"), {}, "you")
    assert [(r.version, r.author) for r in twice.orderBy("version").collect()] == [(1, "me"), (2, "you")]
    assert rules.facts_of(rules.active(once), "at_risk") == {"stock_on_hand"}
    assert rules.facts_of(rules.active(twice), "at_risk") == {"stock_on_hand", "usage_in_window", "window_days", "lead_time_days"}


def test_embeddings_are_made_once_for_a_text(spark):
    texts = spark.createDataFrame([("Pump  seal",), ("PUMP SEAL",), ("bolt",), (None,), (" - ",)], "text string")
    store = spark.createDataFrame([("BOLT", [9.0])], "text string, embedding array<float>")
    out = similarity.ensure_embeddings(texts, store, lambda batch: np.array([[float(len(t))] for t in batch])).collect()
    assert sorted((r.text, r.embedding) for r in out) == [("BOLT", [9.0]), ("PUMP SEAL", [9.0])]


def test_requested_chunks(spark):
    from datetime import datetime

    from partlake.operators import incremental

    at = lambda h, m: datetime(2024, 1, 1, h, m)
    asked = spark.createDataFrame([(1, at(1, 0), 25), (2, at(1, 0), 25), (3, at(1, 0), None), (4, at(1, 0), 5), (5, at(1, 0), 5), (6, at(1, 0), None)], "request int, asked_at timestamp, expected long")
    rows = [(1, at(1, 1), 10), (1, at(1, 2), 10), (1, at(1, 3), 5), (1, at(0, 50), 7), (2, at(1, 1), 10), (3, at(1, 1), 10), (3, at(1, 2), 4), (4, at(2, 0), 5), (6, at(1, 1), 10)]
    chunks = spark.createDataFrame(rows, "request int, ts timestamp, rows long")
    out = {r.request: (r.rows, r.verdict) for r in incremental.requested_chunks(asked, chunks, "10 minutes", 10, "15 minutes").collect()}
    assert out == {1: (25, "EXACT"), 2: (10, "INCOMPLETE"), 3: (14, "BOUNDED"), 4: (5, "TIMED_OUT"), 5: (0, "TIMED_OUT"), 6: (10, "INCOMPLETE")}
