import datetime as dt
import random

import pytest

import lodestone.operators.asof as asof
from lodestone.operators.asof import as_known, latest_at_or_before
from lodestone.operators.asof_stats import totals_before
from lodestone.operators.selection import keyed_selection
from lodestone.operators.splits import rolling_targets

DAY = dt.datetime(2024, 1, 1)
EVENTS = "event_id string, entity string, t timestamp_ntz, id int"
VERSIONS = "id string, entity string, valid_from timestamp_ntz, recorded timestamp_ntz, t string"


def days(n):
    return None if n is None else DAY + dt.timedelta(days=n)


@pytest.mark.parametrize("task_rows", [10**6, 25])
def test_as_known_equals_brute_force_with_and_without_slices(spark, monkeypatch, task_rows):
    rnd = random.Random(4)
    entity = lambda: "hot" if rnd.random() < 0.4 else rnd.choice(["a", "b", None])
    events = [(f"e{i}", entity(), days(rnd.randrange(30)) if rnd.random() < 0.95 else None, 1) for i in range(150)]
    versions = [(f"v{i}" if rnd.random() < 0.97 else None, entity(), days(rnd.randrange(30)), days(rnd.randrange(30)) if rnd.random() < 0.9 else None, "x") for i in range(120)]
    monkeypatch.setattr(asof, "TASK_ROWS", task_rows)
    rows = as_known(spark.createDataFrame(events + events[:20], EVENTS), spark.createDataFrame(versions * 2, VERSIONS)).collect()
    expected = {}
    for e, key, t, _ in events:
        fit = [(vf, r, v) for v, k, vf, r, _ in versions if None not in (v, k, r, t, key) and k == key and vf <= t and r <= t]
        expected[e] = max(fit)[2] if fit else None
    assert {r.event_id: r.attribute_id for r in rows} == expected
    assert len(rows) == len(events)


def test_as_known_with_empty_tables(spark):
    e, v = spark.createDataFrame([("e", "a", DAY, 1)], EVENTS), spark.createDataFrame([("v", "a", DAY, DAY, "")], VERSIONS)
    assert as_known(e.limit(0), v).count() == 0
    assert [r.attribute_id for r in as_known(e, v.limit(0)).collect()] == [None]
    assert [r.attribute_id for r in as_known(e, v).collect()] == ["v"]  # equal times count as known


def test_latest_at_or_before_resolves_ties_and_strictness(spark):
    probes = spark.createDataFrame([(1, "a", days(2)), (2, "a", days(0)), (3, None, days(2)), (4, "a", None)], "n int, k string, at timestamp_ntz")
    facts = spark.createDataFrame([("a", days(1), "x"), ("a", days(2), "y"), ("a", days(2), "z")], "k string, known timestamp_ntz, id string")
    of = lambda strict: {r.n: r.id for r in latest_at_or_before(probes, facts, "k", "at", "known", "id", strict).collect()}
    assert of(False) == {1: "z", 2: None, 3: None, 4: None}
    assert of(True) == {1: "x", 2: None, 3: None, 4: None}


def test_totals_before_exclude_equal_times_and_the_future(spark):
    rnd = random.Random(1)
    facts = [(rnd.choice("ab"), days(rnd.randrange(20)), float(rnd.randrange(5))) for _ in range(200)]
    probes = [(k, days(d), i) for i, (k, d) in enumerate((k, d) for k in "abc" for d in range(-1, 22))]
    got = totals_before(spark.createDataFrame(facts, "k string, at timestamp_ntz, stars double"), spark.createDataFrame(probes, "k string, at timestamp_ntz, i int"), ["k"], "at", ["stars"], slices=5)
    expected = {i: (sum(f[0] == k and f[1] < t for f in facts), sum(f[2] for f in facts if f[0] == k and f[1] < t)) for k, t, i in probes}
    assert {r.i: (r.n, r.stars) for r in got.collect()} == expected
    future = facts + [("a", days(100), 5.0)]
    again = totals_before(spark.createDataFrame(future, "k string, at timestamp_ntz, stars double"), spark.createDataFrame(probes, "k string, at timestamp_ntz, i int"), ["k"], "at", ["stars"], slices=5)
    assert {r.i: (r.n, r.stars) for r in again.collect()} == expected


@pytest.mark.parametrize("kind, values", [("bigint", [None, -(2**63), 2**63 - 1, 0, 5, 5, 5, 7]), ("double", [None, float("nan"), float("inf"), -1.5, 2.25, 2.25, 1e300, -1e300])])
def test_keyed_selection_is_exact_for_hot_keys_and_extremes(spark, kind, values):
    rnd = random.Random(3)
    rows = [(rnd.choice(["hot", "hot", "hot", "b", None]), rnd.choice(values) if rnd.random() < 0.3 else (rnd.randrange(-1000, 1000) if kind == "bigint" else rnd.gauss(0, 10))) for _ in range(800)] + [("none", None)]
    rows = [(k, v if v is None or kind == "bigint" else float(v)) for k, v in rows]
    probs = (0.0, 0.1, 0.5, 0.9, 1.0)
    got = {r.k: r for r in keyed_selection(spark.createDataFrame(rows, f"k string, v {kind}").selectExpr("k", "v", "1 as n", "2 as lo"), "k", "v", probs, bins=16).collect()}
    assert set(got) == {"hot", "b", "none"}
    for key, r in got.items():
        own = [v for k, v in rows if k == key]
        fine = sorted(v for v in own if v is not None and v == v and abs(v) != float("inf"))
        assert (r.n, r.n_values) == (len(own), len(fine))
        import math

        assert (list(r.quantiles) if r.quantiles else None) == ([fine[max(1, math.ceil(p * len(fine))) - 1] for p in probs] if fine else None)


def test_keyed_selection_of_nothing(spark):
    assert keyed_selection(spark.createDataFrame([], "k string, v bigint"), "k", "v").count() == 0


def test_rolling_targets_equal_the_greedy_choice(spark):
    rnd = random.Random(2)
    rows = []
    for u in range(30):
        at = 0
        for i in range(rnd.randrange(5, 45)):
            at += rnd.choice([0, 1, 1, 2])
            rows.append((f"u{u}", f"r{u}-{i:03d}", days(at)))
    got = {}
    for r in rolling_targets(spark.createDataFrame(rows, "user_id string, review_id string, t timestamp_ntz")).collect():
        got.setdefault(r.user_id, []).append(r.target_position)
    for u in {r[0] for r in rows}:
        own = sorted((t, i) for x, i, t in rows if x == u)
        safe = [p for p in range(8, len(own) - 2) if own[p - 1][0] < own[p][0]]
        spaced = []
        for p in safe:
            if not spaced or p - spaced[-1] >= 2:
                spaced.append(p)
        if spaced:
            spaced[-1] = safe[-1]
        if len(spaced) > 6:
            spaced = [spaced[round(i * (len(spaced) - 1) / 5)] for i in range(6)]
        assert sorted(got.get(u, [])) == spaced


def test_hot_entity_is_sliced_alone_and_in_any_zone(spark, monkeypatch):
    monkeypatch.setattr(asof, "TASK_ROWS", 40)
    rnd = random.Random(2)
    base = dt.datetime(2024, 3, 30)  # over the change to summer time
    at = lambda: base + dt.timedelta(minutes=10 * rnd.randrange(300))
    events = [(f"e{i}", "hot" if i % 3 else f"c{i % 17}", at(), 1) for i in range(600)]
    versions = [(f"v{i}", "hot" if i % 2 else f"c{i % 17}", at(), at(), "x") for i in range(200)]
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        got = {r.event_id: r.attribute_id for r in as_known(spark.createDataFrame(events, EVENTS), spark.createDataFrame(versions, VERSIONS)).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    for event_id, entity, t, _ in events:
        known = [(f, r, i) for i, e, f, r, _ in versions if e == entity and f <= t and r <= t]
        assert got[event_id] == (max(known)[2] if known else None)


def test_micros_ignore_the_zone(spark):
    from pyspark.sql import functions as F

    from lodestone.functions.scalars import micros

    times = [dt.datetime(1969, 12, 31, 23, 59, 58, 250_000), dt.datetime(2024, 3, 31, 2, 30), dt.datetime(2024, 3, 31, 3, 30, 0, 1)]
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        got = [r.m for r in spark.createDataFrame([(t,) for t in times], "t timestamp_ntz").select(micros(F.col("t")).alias("m")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == [round((t - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1)) for t in times]
