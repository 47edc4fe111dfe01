import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from plumbline.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    made = session(
        "local[8]",
        "tests",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="plumbline-tests-"),
        },
    )
    made.sparkContext.setLogLevel("OFF")
    yield made
    made.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def people(spark):
    """Twenty rows with planted faults, in the shape of the fixture the checks are usually tried on."""
    rows = []
    for i in range(1, 21):
        rows.append(
            (
                i,
                None if i == 11 else "not-an-email" if i == 3 else "user1@example.com" if i == 15 else f"user{i}@example.com",
                None if i == 12 else "not-a-uuid" if i == 4 else f"123e4567-e89b-12d3-a456-4266141740{i % 15:02d}",
                "256.256.256.256" if i == 5 else f"192.168.1.{i}",
                "not-valid-ipv6" if i == 6 else "fe80::1%eth0" if i == 8 else "::ffff:10.0.0.1" if i in (5, 10) else f"2001:db8::{i}",
                "invalid-phone" if i == 7 else "(555) 123-4567" if i % 2 else "555-123-4567",
                "ABCDE" if i == 8 else "12345-6789" if i == 4 else "12345\n" if i == 9 else f"100{i:02d}",
                95.0 if i == 9 else 40.5,
                -200.0 if i == 10 else -73.9,
                None if i == 18 else i % 3 != 0,
                i * 5,
                "" if i == 7 else "   " if i == 8 else "Hi" if i == 16 else " padded text" if i == 6 else f"Description number {i}",
                "2099-01-01" if i in (4, 9, 17) else f"2024-01-{i:02d}",
                99 if i == 13 else 100 if i == 14 else i % 5 + 1,
            )
        )
    return spark.createDataFrame(
        rows,
        "id int, email string, uuid_col string, ip4_address string, ip6_address string, phone string, zipcode string, "
        "latitude double, longitude double, is_active boolean, score int, description string, event_date string, category_id int",
    ).selectExpr("* except (event_date)", "CAST(event_date AS DATE) AS event_date")
