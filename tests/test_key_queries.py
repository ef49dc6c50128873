"""P3 and P4 take every key of the train spine, whatever the rows' values."""

import datetime as dt

import duckdb
import pytest

import __spark_entry__ as E
from vellum.plans.registry import ORACLE

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _events(spark, folder):
    day = dt.datetime(2024, 1, 5)
    rows = [(1, day, 1, "signup", 3.0, "a"), (2, day, 1, "view", 9.0, "b"),      # a low value: a key as well
            (3, day, 2, "signup", 500.0, "c"), (4, day, 3, "view", 500.0, "d"),  # 3 never signs up
            (5, day + dt.timedelta(days=20), 4, "signup", 500.0, "e"),           # outside the train range
            (6, day, 5, "signup", None, "f"), (7, day, None, "signup", 1.0, "g")]
    spark.createDataFrame(rows, EVENTS).write.parquet(f"{folder}/events.parquet")


@pytest.mark.parametrize("name", ["p3_key_semi_join", "p4_raw_fetch"])
def test_every_train_key_is_fetched(spark, tmp_path, name):
    _events(spark, tmp_path)
    got = E.queries()[name](spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    twin = con.execute(ORACLE[name]).df()
    assert sorted(got["UserLoanId"]) == sorted(twin["UserLoanId"]) == [1, 1, 2, 5]
