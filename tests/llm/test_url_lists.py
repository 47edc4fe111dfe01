import datetime
import os

import duckdb

from plumbline.llm.url_lists import OP5_SQL, decide, intervals, keys, op5_temporal_url_lists

DAY = [datetime.date(2024, 1, 1) + datetime.timedelta(days=n) for n in range(400)]


def test_query_against_sql(spark):
    folder = "/root/testdata/sf0.01"
    found = {r.page_id: r for r in op5_temporal_url_lists(spark, folder).collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{os.path.join(folder, 'pages.parquet')}'")
    relation = con.sql(OP5_SQL)
    wanted = [dict(zip(relation.columns, row)) for row in relation.fetchall()]
    assert len(wanted) == len(found) and sum(w["blocked"] for w in wanted) > 5
    for row in wanted:
        assert found[row["page_id"]].asDict() == row


def entries(spark):
    return spark.createDataFrame(
        [
            ("a", "host:example.com", "block", "list", DAY[10]), ("a", "host:example.com", "block", "delist", DAY[20]),
            ("a", "host:example.com", "block", "list", DAY[30]), ("a", "host:example.com", "block", "delist", DAY[30]),
            ("b", "prefix:news.example.com/free", "allow", "list", DAY[0]), ("c", "url:http://x.org/?q=1", None, "list", DAY[5]),
            ("c", "host:x.org", "allow", "list", DAY[5]), (None, "host:y.org", "block", "list", DAY[1]), ("a", None, "block", "list", DAY[1]),
            ("a", "host:z.org", "block", None, DAY[1]), ("a", "host:z.org", "block", "list", None), ("a", "host:example.com", "block", "list", DAY[10]),
        ],
        "list string, pattern string, verdict string, action string, at date",
    )


def test_intervals(spark):
    rows = {(r.pattern, r.valid_from, r.valid_until) for r in intervals(entries(spark)).collect()}
    assert {r for r in rows if r[0] == "host:example.com"} == {("host:example.com", DAY[10], DAY[20]), ("host:example.com", DAY[30], None)}


def test_captures_are_judged_at_their_time(spark):
    cases = [
        ("http://www.Example.com/a", 9, False), ("http://www.Example.com/a", 10, True), ("https://deep.sub.example.com", 19, True),
        ("http://example.com/", 20, False), ("http://example.com/", 30, True), ("http://news.example.com/free/1?x#y", 12, False),
        ("http://news.example.com/paid", 12, True), ("http://notexample.com/", 12, False), ("http://x.org/?q=1#top", 6, True),
        ("http://x.org/?q=2", 6, False), ("http://y.org/a", 3, True), (None, 12, False), ("no address", 12, False), ("", 12, False),
        ("http://example.com/" + "a" * 100_000, 12, True), ("http://z.org", 50, False), ("http://example.com/", None, False),
    ]
    rows = [(i, url, None if at is None else DAY[at], "x") for i, (url, at, _) in enumerate(cases)]
    captures = spark.createDataFrame([*rows, rows[1], (None, *rows[1][1:])], "page_id long, url string, fetched_at date, pattern string")
    found = decide(captures, entries(spark)).collect()
    assert len(found) == len(cases) + 2
    for r in found:
        assert r.blocked == (True if r.page_id is None else cases[r.page_id][2]), r
    assert decide(captures.limit(0), entries(spark)).count() == 0
    assert not any(r.blocked for r in decide(captures, entries(spark).limit(0)).collect())


def test_keys(spark):
    row = spark.sql("SELECT 'HTTP://www.A.b.co.uk:80/x/y#z' AS url").select(keys(__import__("pyspark.sql.functions", fromlist=["col"]).col("url")).alias("k")).first()
    assert [k.pattern for k in row.k] == ["url:HTTP://www.A.b.co.uk:80/x/y", "prefix:a.b.co.uk/x", "host:a.b.co.uk", "host:b.co.uk", "host:co.uk"]
