import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallybrook.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "4g")
    yield session
    session.stop()


@pytest.fixture
def make_orders(spark):
    """Order lines from (order_id, date, customer_id, amount[, sku[, store_id]])."""

    def make(rows, extra=""):
        schema = "order_id string, order_date timestamp, customer_id string, amount double" + extra
        fixed = [
            (r[0], dt.datetime.fromisoformat(r[1]) if isinstance(r[1], str) else r[1], *r[2:]) for r in rows
        ]
        return spark.createDataFrame(fixed, schema)

    return make


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]
