"""The streams over more files than one batch held, the latest events first."""

import functools
import os

import duckdb
import pandas as pd
import pytest
from tidemill.plans import streams
from tidemill.registry import QUERIES, SQL

from oracle import rows


@pytest.fixture(scope="module")
def many(tmp_path_factory):
    """2010 files, one event each, ten hours apart from file to file; later files hold earlier events."""
    path = tmp_path_factory.mktemp("many")
    os.mkdir(folder := path / "events.parquet")
    for i in range(2010):
        ts = pd.Timestamp("2024-12-01") - pd.Timedelta(hours=10 * i)
        frame = pd.DataFrame({"event_id": [i], "user_id": [i % 3], "event_type": ["click"], "ts": pd.Series([ts], dtype="datetime64[us]"), "value": [1.0 + i]})
        frame.to_parquet(file := folder / f"part-{i:04}.parquet")
        os.utime(file, (1_700_000_000 + i,) * 2)
    return str(path)


@pytest.mark.parametrize("name", ["k02_event_time_bars", "k08_session_groups", "k06_first_accepted_stream"])
def test_no_row_is_late(spark, many, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{many}/events.parquet/*.parquet')")
    assert rows(QUERIES[name](spark, many).toPandas()) == rows(con.sql(SQL[name]).df())


def test_a_key_is_accepted_once_over_many_batches(spark, tmp_path, monkeypatch):
    os.mkdir(folder := tmp_path / "events.parquet")
    for i, day in enumerate(["2024-01-01", "2024-04-01", "2024-08-01", "2024-12-01", "2025-04-01", "2025-08-01"]):
        frame = pd.DataFrame({"event_id": [i], "user_id": [1], "event_type": ["click"], "ts": pd.Series([pd.Timestamp(day)], dtype="datetime64[us]"), "value": [1.0]})
        frame.to_parquet(file := folder / f"part-{i}.parquet")
        os.utime(file, (1_700_000_000 + i,) * 2)
    monkeypatch.setattr(streams, "_events", functools.partial(streams._events, files_per_batch=1))
    assert [tuple(r) for r in streams.first_accepted(spark, str(tmp_path)).collect()] == [(1, "click")]
