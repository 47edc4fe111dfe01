"""History, incidents and scores against plain Python."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plumbline.operators import history, incidents, scoring

START = datetime(2024, 1, 1)


def test_earlier_reading_band_is_closed_below_and_open_above(spark):
    now = START + timedelta(days=10)
    minutes = {"at": 24 * 60, "inside": 23 * 60 + 1, "edge": 23 * 60, "old": 24 * 60 + 1}
    past = spark.createDataFrame(
        [(k, now - timedelta(minutes=m), 5.0) for k, m in minutes.items()], "check_id string, executed_at timestamp, actual_value double"
    )
    current = spark.createDataFrame([(k, now, 6.0) for k in [*minutes, "none"]], past.schema)
    got = {r.check_id: r.earlier_value for r in history.with_earlier(current, past, ["check_id"], 1).collect()}
    assert got == {"at": 5.0, "inside": 5.0, "edge": None, "old": None, "none": None}


@pytest.mark.parametrize("days", [1, 7])
def test_earlier_reading_against_brute_force(spark, days):
    rng = random.Random(days)
    rows = [("hot" if i % 3 else f"c{i % 4}", START + timedelta(minutes=rng.randint(0, 9 * 24 * 60)), float(i)) for i in range(600)]
    rows = list({(k, t): (k, t, v) for k, t, v in rows}.values())
    df = spark.createDataFrame(rows, "check_id string, executed_at timestamp, actual_value double")
    got = {(r.check_id, r.executed_at): r.earlier_value for r in history.with_earlier(df, df, ["check_id"], days).collect()}
    assert len(got) == len(rows)
    for k, t, _ in rows:
        low, high = t - timedelta(days=days), t - timedelta(days=days) + timedelta(hours=1)
        band = [(u, v) for c, u, v in rows if c == k and low <= u < high]
        assert got[(k, t)] == (max(band)[1] if band else None)


def test_change_formula(spark):
    df = spark.createDataFrame([(5.0, 4.0), (5.0, -4.0), (5.0, 0.0), (5.0, None)], "v double, e double")
    plain = [r[0] for r in df.select(history.percent_change(F.col("v"), F.col("e"), False)).collect()]
    absolute = [r[0] for r in df.select(history.percent_change(F.col("v"), F.col("e"), True)).collect()]
    assert plain == [25.0, -225.0, None, None] and absolute == [25.0, 225.0, None, None]


def test_fence_of_ninety_days(spark):
    now = START + timedelta(days=200)
    rows = [("long", now - timedelta(minutes=i), float(i % 100)) for i in range(1, 1501)]
    rows += [("short", now - timedelta(days=i), 1.0) for i in range(1, 7)]
    rows += [("old", now - timedelta(days=91 + i), 1.0) for i in range(20)]
    rows += [("nulls", now - timedelta(days=1), None)]
    df = spark.createDataFrame(rows, "check_id string, executed_at timestamp, actual_value double")
    for newest, n in ((None, 1500), (1000, 1000)):
        got = {r.check_id: r for r in history.anomaly_fence(df, ["check_id"], str(now), newest=newest).collect()}
        assert set(got) == {"long", "short"}
        kept = sorted(float(i % 100) for i in range(1, n + 1))
        q1, q3 = kept[n // 4], kept[n * 3 // 4]
        assert (got["long"].history_count, got["long"].q1, got["long"].q3) == (n, q1, q3)
        assert got["long"].fence_high == q3 + 1.5 * (q3 - q1) and got["short"].history_count == 6


def test_partitions_of_a_check_have_a_history_of_their_own(spark):
    at = [START + timedelta(hours=h) for h in range(6)]
    rows = [("c", "p1", at[0], False), ("c", "p2", at[1], True), ("c", "p1", at[2], False), ("c", "p2", at[3], False), ("c", "p1", at[4], True), ("c", None, at[0], False)]
    df = spark.createDataFrame([(*r, 1.0, "passed" if r[3] else "error", "m") for r in rows], "check_id string, partition string, executed_at timestamp, passed boolean, actual_value double, severity string, message string")
    found = {(r.partition, r.status, r.failure_count) for r in incidents.fold(df).collect()}
    assert found == {("p1", "resolved", 2), ("p2", "open", 1), (None, "open", 1)}
    checks = spark.createDataFrame([("c", "row_count", True)], "check_id string, check_type string, is_active boolean")
    assert {(r.partition, r.passed) for r in scoring.latest_of_checks(checks, df).collect()} == {("p1", True), ("p2", False), (None, False)}


def _fold(rows):
    """The lifecycle, one result after the other."""
    done, held = [], {}
    for check, at, passed, severity, message in sorted(rows, key=lambda r: (r[0], r[1])):
        if not passed:
            if check in held:
                held[check][3] += 1
                held[check][2], held[check][4] = at, message
            else:
                level = {"warning": "low", "error": "medium", "fatal": "high"}[severity]
                held[check] = [check, at, at, 1, message, level]
        elif check in held:
            done.append((*held.pop(check), at))
    return sorted([*done, *[(*h, None) for h in held.values()]], key=str)


def test_incidents_against_brute_force(spark):
    rng = random.Random(9)
    rows = []
    for i in range(900):
        check = "hot" if i % 3 else f"c{i % 7}"
        passed = rng.random() < 0.4
        severity = "passed" if passed else rng.choice(["warning", "error", "fatal"])
        rows.append((check, START + timedelta(minutes=17 * i), passed, severity, f"m{i}"))
    schema = "check_id string, executed_at timestamp, passed boolean, severity string, message string"
    columns = ["check_id", "first_failure_at", "last_failure_at", "failure_count", "description", "severity", "resolved_at"]
    whole = incidents.fold(spark.createDataFrame(rows, schema)).select(*columns).collect()
    assert sorted([tuple(r) for r in whole], key=str) == _fold(rows)
    # In two pieces, the open incidents of the first carried into the second.
    first = incidents.fold(spark.createDataFrame(rows[:400], schema))
    second = incidents.fold(spark.createDataFrame(rows[400:], schema), first.filter("status = 'open'"))
    pieces = first.filter("status = 'resolved'").unionByName(second).select(*columns).collect()
    assert sorted([tuple(r) for r in pieces], key=str) == _fold(rows)


def test_illegal_moves(spark):
    steps = {"fine": ["open", "acknowledged", "open", "resolved", "open"], "bad": ["acknowledged", "acknowledged"], "back": ["open", "resolved", "acknowledged"]}
    rows = [(k, START + timedelta(hours=13 * i), s) for k, moves in steps.items() for i, s in enumerate(moves)]
    df = spark.createDataFrame(rows, "incident_id string, changed_at timestamp, status string")
    got = sorted((r.incident_id, str(r.from_status), r.status) for r in incidents.illegal_moves(df).collect())
    assert got == [("back", "resolved", "acknowledged"), ("bad", "None", "acknowledged"), ("bad", "acknowledged", "acknowledged")]


@pytest.mark.parametrize(
    "counts, points, light",
    [
        ((0, 0, 0, 0), None, "not_assessed"),
        ((10, 0, 0, 0), 100.0, "green"),
        ((0, 10, 0, 0), 80.0, "green"),
        ((0, 0, 10, 0), 50.0, "red"),
        ((0, 0, 0, 10), 0.0, "red"),
        ((7, 1, 1, 1), 83.0, "green"),
        ((3, 1, 1, 1), 71.7, "amber"),
    ],
)
def test_scores(spark, counts, points, light):
    df = spark.createDataFrame([counts], "p bigint, w bigint, e bigint, f bigint")
    score = scoring.score(F.col("p"), F.col("w"), F.col("e"), F.col("f"))
    row = df.select(score.alias("s"), scoring.traffic_light(score).alias("l")).first()
    assert (row.s, row.l) == (points, light)


@pytest.mark.parametrize("limit", [0, 100])
def test_lookup_join_broadcast_and_salted(spark, limit):
    from plumbline.functions.joins import lookup_join

    rows = spark.createDataFrame([("hot" if i % 3 else f"k{i % 5}", i) for i in range(300)], "k string, i int")
    lookup = spark.createDataFrame([("hot", 1), ("k0", 2), ("k3", 3)], "k string, v int")
    got = lookup_join(rows, lookup, ["k"], "left", broadcast_up_to=limit)
    assert got.columns == ["k", "i", "v"]
    expected = rows.join(lookup, "k", "left").select("k", "i", "v")
    assert got.exceptAll(expected).count() == 0 and expected.exceptAll(got).count() == 0
