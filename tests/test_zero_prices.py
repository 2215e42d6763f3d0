"""Queries on events some of which have a value of zero, single lows and closes: against their SQL."""

import os
from collections import Counter

import __spark_entry__  # noqa: F401  registers the queries
import duckdb
import pytest
from tidemill.registry import QUERIES, SQL

from oracle import SF, TABLES, duck_rows, rows

PIVOTS = ["j01_confirmed_pivots", "j02_developing_extreme", "f09_leg_maximum"]
FEATURES = ["p03_leg_features", "p04_relation_features", "p05_position_features", "p06_channel_features", "p07_level_features", "p08_context_features", "p09_positioning_features", "p10_more_direction_features", "f06_ewm_volatility", "f07_trend", "f08_path_statistics"]
OTHERS = ["i01_scalar_functions", "p01_window_features", "p02_direction_features", "e34_random_nulls", "j04_simulate_exits", "j05_limit_pullback", "j08_live_book", "j08_live_pullback"]


@pytest.fixture(scope="module")
def zeros(tmp_path_factory):
    """The smallest tables; zero are single values within hours of several, and the first value of all."""
    place = tmp_path_factory.mktemp("zeros")
    for name in TABLES:
        if name != "events":
            os.symlink(f"{SF}/{name}.parquet", place / f"{name}.parquet")
    low = "row_number() OVER w = 2 AND count(*) OVER h >= 3 AND hash(event_type, date_trunc('hour', ts)) % 3 = 0"
    duckdb.sql(f"""COPY (SELECT * EXCLUDE (low, first) REPLACE (CASE WHEN low OR event_id = first THEN 0.0 ELSE value END AS value) FROM (SELECT *, {low} AS low, min_by(event_id, ts) OVER () AS first FROM read_parquet('{SF}/events.parquet')
      WINDOW h AS (PARTITION BY event_type, date_trunc('hour', ts)), w AS (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY ts)) ORDER BY event_id) TO '{place}/events.parquet'""")
    return str(place)


@pytest.mark.parametrize("name", PIVOTS + FEATURES + OTHERS)
def test_zero_prices(spark, zeros, name):
    found, wanted = rows(QUERIES[name](spark, zeros).toPandas()), duck_rows(SQL[name], zeros)
    assert found[0] == wanted[0] and Counter(found[1]) == Counter(wanted[1])  # in any order: 0.0 and -0.0 are the same
