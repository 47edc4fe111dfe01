"""A few whole queries against their SQL, as the driver compares all of them."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from check_oracle import rows  # noqa: E402
from workload import registry  # noqa: E402
from workload.tables import GIVEN  # noqa: E402


@pytest.mark.parametrize(
    "name",
    [
        "checks_on_lineitem",
        "checks_on_event_points",
        "checks_on_contacts",
        "checks_for_anomalies",
        "check_messages",
        "expectations_about_lineitem",
        "profile_of_events",
        "catalog_of_all_tables",
        "dimension_scores",
        "change_against_1_days_before",
        "stream_daily_sensors",
    ],
)
def test_query_equals_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in GIVEN:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = registry.queries()[name](spark, sf_dir)
    cursor = con.execute(registry.oracle_sql()[name])
    theirs = rows([d[0] for d in cursor.description], cursor.fetchall())
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == theirs


def test_entry_and_names(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() == 3
    assert set(contract.oracle_sql()) <= set(contract.queries())
