"""Profiles, inference, promises and proposals on small literal samples."""

import re

import pytest
from pyspark.sql import functions as F

from plumbline.operators import promises, suggest
from plumbline.operators.duplicates import duplicate_rows
from plumbline.operators.inference import infer
from plumbline.operators.ordering import ordered_pairs
from plumbline.operators.sample import repeatable_sample


def inferred(spark, values, kind="string"):
    return infer(spark.createDataFrame([(v,) for v in values], f"v {kind}"), "t").first()


@pytest.mark.parametrize(
    "values, pattern",
    [
        (["TXN-1234", "TXN-5678", "TXN-9012"], r"^TXN\-\d{4}$"),
        (["ORD-1", "ORD-12", "ORD-123"], r"^ORD\-\d{1,3}$"),
        (["abc", "xyz", "def"], "^[a-z]{3}$"),
        (["Ab", "cD", "ef"], "^[A-Za-z]{2}$"),
        (["a1", "1b", "22"], r"^\w{2}$"),
        (["a-", "-b", "cc"], None),
        (["red", "green"], None),
        (["x..", "x.."], r"^x\.{2}$"),
        (["aaZ", "aaaaZ"], r"^aa[A-Za-z]{1,3}$"),
        (["Éa", "Öb"], "^[A-Z][a-z]$"),
    ],
)
def test_patterns(spark, values, pattern):
    got = inferred(spark, values).regex
    assert got == pattern
    if got:
        assert all(re.match(got, v) for v in values if v.isascii())


def test_formats_and_code_lists(spark):
    assert inferred(spark, ["a@b.org", "c.d@e.com"] * 20).format == "email"
    assert inferred(spark, ["a@b.org"] * 9 + ["nope"]).format is None
    assert inferred(spark, ["2024-01-01", "2024-02-30"]).format == "iso_date"
    assert inferred(spark, ["+4930123456", "+15551234567"]).format == "e164"
    assert inferred(spark, ["https://x.org/a", "http://y.com"]).format == "url"
    assert inferred(spark, ["de", "FR", "ES", "long value"]).codelist == "ISO_3166_alpha2"
    assert inferred(spark, ["USD", "eur", "CHF"]).codelist == "ISO_4217"
    assert inferred(spark, ["QQ", "ZZ", "DE"]).codelist is None


def test_enums_and_ranges(spark):
    assert inferred(spark, ["b", "a", "b", None]).enum_values == ["a", "b"]
    assert inferred(spark, ["MTR-001", "MTR-002", "MTR-003"]).enum_values is None
    assert inferred(spark, [str(i) for i in range(21)] * 3).enum_values is None
    row = inferred(spark, list(range(10, 110)), "int")
    assert (row.numeric_min, row.numeric_max) == (10.0, 109.0) and row.regex is None and row.format is None
    assert inferred(spark, [1, 2, 3, 4] * 3, "int").numeric_min is None
    row = inferred(spark, ["x" * 10, "y" * 20])
    assert (row.length_min, row.length_max) == (9, 21)
    row = inferred(spark, ["x" * 3])
    assert (row.length_min, row.length_max) == (2, 3)


def test_personal_columns_are_counted_only(spark):
    df = spark.createDataFrame([("a@b.org", 1), ("c@d.org", 2)], "mail string, n int")
    row = infer(df, "t", pii=("mail",)).filter("column_name = 'mail'").first()
    assert row.value_count == 2 and row.format is None and row.min_value is None and row.distinct_count is None


@pytest.mark.parametrize(
    "rule, promise, warning, error",
    [
        ("min_percent", "95", {"min_percent": 97}, {"min_percent": 95}),
        ("min_percent", "100%", {"min_percent": 100}, {"min_percent": 100}),
        ("max_percent", "99", {"max_percent": 0}, {"max_percent": 1}),
        ("max_percent", "95", {"max_percent": 3}, {"max_percent": 5}),
        ("min_max_percent", "100", {"min_percent": 100, "max_percent": 100}, {"min_percent": 100, "max_percent": 100}),
        ("max_count", "99", None, {"max_count": 0}),
        ("max_count", "95", None, None),
        ("max_change_percent", "98", {"max_change_percent": 0}, {"max_change_percent": 2}),
        ("max_value", "24h", {"max_value": 86400}, {"max_value": 129600}),
        ("max_value", "1h", {"max_value": 3600}, {"max_value": 7200}),
        ("max_value", "5min", {"max_value": 300}, {"max_value": 3900}),
        ("max_value", "2 days", {"max_value": 172800}, {"max_value": 259200}),
        ("max_value", "weekly", None, None),
        ("min_percent", "-5%", None, None),
        ("min_percent", "101", None, None),
        ("min_count", "100", None, None),
        ("min_value", "5", None, None),
        ("equal_to", "10", None, None),
        ("is_true", "100", None, None),
    ],
)
def test_thresholds_of_promises(spark, rule, promise, warning, error):
    df = spark.createDataFrame([(rule, promise)], "r string, p string")
    got = df.select(promises.thresholds_of(F.col("r"), F.col("p")).alias("t")).first().t

    def limits(level):
        found = {k: v for k, v in (got[level].asDict() if got and got[level] else {}).items() if v is not None}
        return found or None

    assert (limits("warning"), limits("error")) == (warning, error)


def proposals(spark, fields, tables, promised):
    f = spark.createDataFrame(fields, "table_name string, column_name string, logical_type string, primary_key boolean, is_pii boolean, declared_format string, accepted_values array<string>, enum_values array<string>, regex string")
    t = spark.createDataFrame(tables, "table_name string, freshness_column string")
    p = spark.createDataFrame(promised, "table_name string, dimension string, promise string")
    made = suggest.suggest(f, t, p)
    return made.collect(), suggest.not_assessed(p, t, made).collect()


def test_proposals_follow_the_promises(spark):
    fields = [
        ("t", "id", "integer", True, False, None, None, None, None),
        ("t", "status", "string", False, False, None, None, ["a", "b"], "^[a-z]$"),
        ("t", "mail", "string", False, True, "email", None, ["x"], "^x$"),
        ("t", "country", "string", False, False, "country_code", None, None, None),
        ("t", "kind", "string", False, False, None, ["k"], None, None),
    ]
    promised = [("t", "uniqueness", "99"), ("t", "validity", "98"), ("t", "accuracy", "95"), ("t", "conformity", "90"), ("t", "timeliness", "1h"), ("t", "coverage", " ")]
    rows, open_ = proposals(spark, fields, [("t", None)], promised)
    got = {(r.check_type, r.column_name): r for r in rows}
    assert {r.dimension for r in rows} <= {"uniqueness", "validity", "accuracy", "conformity"}
    assert got[("distinct_percent", "id")].error == '{"min_percent":100.0,"max_percent":100.0}'
    assert ("nulls_count", "id") not in got  # completeness is not promised
    assert ("duplicate_record_percent", None) not in got  # there is a key
    assert got[("text_found_in_set_percent", "status")].source == "inference"
    assert got[("text_found_in_set_percent", "kind")].source == "declaration"
    assert ("text_found_in_set_percent", "mail") not in got  # personal: no inference
    assert got[("text_matching_regex_percent", "mail")].source == "declaration"
    assert got[("text_valid_country_code_percent", "country")].warning == '{"min_percent":97.0}'
    assert ("text_matching_regex_percent", "country") not in got
    assert [(r.dimension, r.reason) for r in open_] == [("timeliness", "no_freshness_column")]
    again, _ = proposals(spark, fields, [("t", None)], promised)
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_duplicate_rows_keep_null_positions_apart(spark):
    rows = [(None, "a")] * 3 + [("a", None)] * 2 + [(None, None)] + [("x", "y")] * 400 + [(f"{i}", "z") for i in range(200)]
    df = spark.createDataFrame(rows, "p string, q string")
    got = duplicate_rows(df).first()
    assert (got.rows, got.duplicates) == (len(rows), len(rows) - len(set(rows)))
    assert duplicate_rows(df, broadcast_up_to=0).first() == got
    assert duplicate_rows(df.filter("q = 'z'")).first().duplicates == 0


@pytest.mark.parametrize("descending, strictly", [(False, False), (False, True), (True, False), (True, True)])
def test_order_against_brute_force(spark, descending, strictly):
    import random

    rng = random.Random(3)
    rows = [("hot" if i % 3 else f"g{i % 5}", i, rng.randint(0, 3) + i // 200 if i % 11 else None) for i in range(2000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, at int, v int").repartition(5)
    pairs = ordered = 0
    for g in {r[0] for r in rows}:
        vs = [v for _, _, v in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]) if v is not None]
        for a, b in zip(vs, vs[1:]):
            pairs += 1
            a, b = (b, a) if descending else (a, b)
            ordered += a < b if strictly else a <= b
    got = ordered_pairs(df, "v", ["at"], by=["g"], descending=descending, strictly=strictly).first()
    assert (got.pairs, got.ordered) == (pairs, ordered)
    empty = ordered_pairs(df.filter("v > 99"), "v", ["at"]).first()
    assert (empty.pairs, empty.ordered) == (0, 0)


def test_samples_repeat_and_differ_by_seed(spark):
    df = spark.range(5000).withColumn("secret", F.lit("x"))
    one = {r.id for r in repeatable_sample(df, ["id"], 1, 200, pii=("secret",)).collect()}
    again = {r.id for r in repeatable_sample(df.repartition(7), ["id"], 1, 200).collect()}
    other = {r.id for r in repeatable_sample(df, ["id"], 2, 200).collect()}
    assert one == again and len(one) == 200 and len(one & other) < 50
    assert repeatable_sample(df, ["id"], 1, 10, pii=("secret",)).columns == ["id"]


def test_reconcile(spark):
    owned = spark.createDataFrame(
        [("t", "a", "c", "1", True, "x"), ("t", "a", "c", "2", True, "x"), ("t", "b", None, "3", True, "x"), ("t", "d", None, "4", False, "x"), ("t", "e", None, "5", True, "x")],
        "table_name string, check_type string, column_name string, check_id string, is_active boolean, thresholds string",
    )
    desired = spark.createDataFrame(
        [("t", "a", "c", "y"), ("t", "d", None, None), ("t", "e", None, "x"), ("t", "f", None, "x")],
        "table_name string, check_type string, column_name string, thresholds string",
    )
    got = {(r.check_type, r.check_id): r.action for r in suggest.reconcile(owned, desired).collect()}
    assert got == {("a", "1"): "update", ("a", "2"): "delete", ("b", "3"): "delete", ("d", "4"): "update", ("e", "5"): "keep", ("f", None): "create"}
