"""Sensors on planted faults, on empty tables, and against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import text
from plumbline.operators.measure import Probe, invalid_reason, measure
from plumbline.operators.percentiles import exact_percentiles
from plumbline.operators.sensors import SENSORS
from plumbline import fixed


def value(df, sensor, column=None, **params):
    return measure(df, [Probe("x", sensor, column, params)]).first().sensor_value


@pytest.mark.parametrize(
    "sensor, column, params, expected",
    [
        ("invalid_email_format_count", "email", {}, 1),
        ("invalid_uuid_format_count", "uuid_col", {}, 1),
        ("invalid_ip4_format_count", "ip4_address", {}, 1),
        ("invalid_ip6_format_count", "ip6_address", {}, 4),
        ("invalid_phone_format_count", "phone", {}, 10),
        ("invalid_zipcode_format_count", "zipcode", {}, 2),
        ("invalid_latitude_count", "latitude", {}, 1),
        ("invalid_longitude_count", "longitude", {}, 1),
        ("nulls_percent", "email", {}, 5.0),
        ("duplicate_count", "email", {}, 1),
        ("distinct_percent", "email", {}, 100.0 * 18 / 19),
        ("empty_text_count", "description", {}, 1),
        ("whitespace_text_count", "description", {}, 1),
        ("text_surrounded_whitespace_count", "description", {}, 2),
        ("true_percent", "is_active", {}, 70.0),
        ("false_percent", "is_active", {}, 25.0),
        ("future_date_count", "event_date", {"as_of": "2024-02-01 00:00:00"}, 3),
        ("contains_email_percent", "email", {}, 90.0),
        ("text_length_below_min_percent", "description", {"min_length": 5}, 15.0),
        ("number_in_range_percent", "score", {"min_value": 5, "max_value": 50}, 50.0),
        ("median_value", "score", {}, 52.5),
        ("text_match_date_percent", "event_date", {}, 100.0),
        ("detected_datatype", "score", {}, 1),
        ("column_exists", "nothing", {}, 0),
    ],
)
def test_planted_faults(people, sensor, column, params, expected):
    assert value(people, sensor, column, **params) == pytest.approx(expected)


def test_foreign_keys(spark, people):
    categories = spark.createDataFrame([(i,) for i in range(1, 6)], "id int")
    probes = [
        Probe("lost", "foreign_key_not_found_count", "category_id", {"reference_table": "categories"}),
        Probe("found", "foreign_key_found_percent", "category_id", {"reference_table": "categories"}),
    ]
    got = {r.probe_id: r.sensor_value for r in measure(people, probes, tables={"categories": categories}).collect()}
    assert got == {"lost": 2.0, "found": 90.0}


def test_empty_tables_give_the_documented_values(people):
    nothing = people.filter("id < 0")
    expected = {
        ("nulls_percent", "email"): 0.0,
        ("not_nulls_percent", "email"): 100.0,
        ("distinct_percent", "email"): 0.0,
        ("number_in_range_percent", "score"): 100.0,
        ("text_length_in_range_percent", "email"): 100.0,
        ("sum_value", "score"): None,
        ("median_value", "score"): None,
        ("row_count", None): 0.0,
        ("detected_datatype", "email"): 5.0,
        ("duplicate_record_percent", None): 0.0,
        ("data_freshness", "event_date"): None,
    }
    probes = [Probe(f"{s}/{c}", s, c) for s, c in expected]
    got = {r.probe_id: r.sensor_value for r in measure(nothing, probes).collect()}
    assert got == {f"{s}/{c}": v for (s, c), v in expected.items()}


def test_filters_and_partitions(people):
    probes = [
        Probe("young", "row_count", None, {}, "score <= 25"),
        Probe("all", "row_count"),
        Probe("mean", "mean_value", "score"),
        Probe("middle", "median_value", "score"),
        Probe("kinds", "distinct_count", "category_id"),
        Probe("copies", "duplicate_record_count", None, {"columns": ["is_active", "latitude"]}),
    ]
    got = {(r.is_active, r.probe_id): r.sensor_value for r in measure(people, probes, by=["is_active"]).collect()}
    rows = people.collect()
    for flag in (True, False, None):
        mine = [r for r in rows if r.is_active is flag]
        assert got[(flag, "all")] == len(mine)
        assert got[(flag, "mean")] == pytest.approx(np.mean([r.score for r in mine]))
        assert got[(flag, "middle")] == pytest.approx(np.median([r.score for r in mine]))
        assert got[(flag, "kinds")] == len({r.category_id for r in mine})
        assert got[(flag, "copies")] == len(mine) - len({r.latitude for r in mine})
        young = [r for r in mine if r.score <= 25]
        assert got.get((flag, "young")) == (len(young) or None)


def test_probes_that_cannot_run_are_named(people):
    assert invalid_reason(people, Probe("x", "nulls_count", "email")) is None
    assert "unknown sensor" in invalid_reason(people, Probe("x", "nonsense"))
    assert "column is required" in invalid_reason(people, Probe("x", "nulls_count"))
    assert "unknown column" in invalid_reason(people, Probe("x", "nulls_count", "fax"))
    assert "missing parameters" in invalid_reason(people, Probe("x", "sql_aggregate_value"))
    assert "fax" in invalid_reason(people, Probe("x", "sql_condition_failed_count", None, {"sql_condition": "fax = 1"}))


def test_sketches_come_close(people):
    probes = [Probe("d", "distinct_count", "email"), Probe("m", "median_value", "score")]
    got = {r.probe_id: r.sensor_value for r in measure(people, probes, exact=False).collect()}
    assert got["d"] == pytest.approx(18, abs=1) and got["m"] == pytest.approx(52.5, abs=5)


def test_every_sensor_has_a_case():
    from workload.sensor_cases import CASES

    assert set(CASES) == set(SENSORS)


def _linear(values, fraction):
    return float(np.quantile(np.array(values), fraction))


@pytest.mark.parametrize("kind", ["spread", "hot", "tiny range", "wide range", "negative", "single"])
def test_percentiles_against_numpy(spark, kind):
    rng = random.Random(kind)
    values = {
        "spread": [rng.gauss(0, 1000) for _ in range(5000)],
        "hot": [7.0] * 2000 + [rng.uniform(0, 1e6) for _ in range(4000)],
        "tiny range": [1.7e9 + rng.random() / 1e3 for _ in range(3000)],
        "wide range": [rng.choice([-1, 1]) * 10 ** rng.uniform(-200, 200) for _ in range(3000)],
        "negative": [-rng.expovariate(0.001) for _ in range(3000)],
        "single": [42.0],
    }[kind]
    fractions = [0.0, 0.1, 0.25, 0.333, 0.5, 0.75, 0.9, 1.0]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").withColumn("series", F.lit("a"))
    got = {r.fraction: r.value for r in exact_percentiles(df, [], {"a": fractions}).collect()}
    for f in fractions:
        assert got[f] == pytest.approx(_linear(values, f), rel=1e-9, abs=1e-300)


@pytest.mark.parametrize("few_groups", [0, 10_000])
def test_percentiles_per_group_with_a_hot_group_and_a_null_group(spark, few_groups):
    rng = random.Random(5)
    rows = [(g, rng.uniform(-5, 5)) for g in ["hot"] * 3000 + ["a"] * 40 + ["b"] * 7 + [None] * 11]
    df = spark.createDataFrame(rows, "g string, v double").withColumn("series", F.lit("s"))
    got = {(r.g, r.fraction): r.value for r in exact_percentiles(df, ["g"], {"s": [0.25, 0.5]}, few_groups=few_groups).collect()}
    for g in ("hot", "a", "b", None):
        for f in (0.25, 0.5):
            assert got[(g, f)] == pytest.approx(_linear([v for k, v in rows if k == g], f))


@pytest.mark.parametrize("accuracy", [20, 100])
def test_percentiles_inside_narrow_brackets(spark, accuracy):
    rng = random.Random(accuracy)
    values = {
        "spread": [rng.gauss(0, 1000) for _ in range(5000)],
        "hot": [7.0] * 2000 + [rng.uniform(0, 1e6) for _ in range(4000)],
        "steps": [float(rng.randint(0, 9)) for _ in range(3000)],
        "endless": [rng.choice([float("inf"), float("-inf"), 0.0, 1.0, -2.5]) for _ in range(2000)],
    }
    fractions = [0.0, 0.001, 0.1, 0.25, 0.333, 0.5, 0.75, 0.9, 0.9999, 1.0]
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "series string, v double")
    found = exact_percentiles(df.repartition(7), [], {k: fractions for k in values}, accuracy=accuracy).collect()
    got = {(r.series, r.fraction): r.value for r in found}
    for k, vs in values.items():
        for f in fractions:
            want = _linear(vs, f)
            if want == want:  # between two equal infinities the plain formula has no value
                assert got[(k, f)] == pytest.approx(want, rel=1e-9, abs=1e-300)


@pytest.mark.parametrize("pattern", [fixed.EMAIL, fixed.US_PHONE, fixed.US_ZIPCODE, fixed.IP4, fixed.IP6_FULL])
def test_finders_find_what_the_patterns_find(spark, pattern):
    rng = random.Random(pattern)
    alphabet = "aZ09.@-_(): +x" if pattern != fixed.IP6_FULL else "af09::g"
    good = {"@": "joe@mail.org", ":": "1:2:3:4:5:6:7:8", ".": "10.2.33.255", "3": "+1-(555)555-1234 12345-6789"}
    words = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    words += [w[:5] + s + w[5:] for w in words[:400] for s in good.values()]
    df = spark.createDataFrame([(w,) for w in words], "t string")
    differ = df.filter(text.contains_pattern(F.col("t"), pattern) != F.col("t").rlike(pattern))
    assert differ.count() == 0
    assert df.filter(F.col("t").rlike(pattern)).count() > 0


def test_country_codes_are_those_of_the_standard(spark):
    codes = text.country_codes(spark)
    assert len(codes) == 249 and {"DE", "FR", "US", "ZW", "AX"} <= set(codes) and "ZZ" not in codes
