"""Queries whose rows turn on how a double is rounded: against their SQL."""

import os

import __spark_entry__  # noqa: F401  registers the queries
import pytest
from tidemill.registry import QUERIES, SQL

from oracle import SF, TABLES, duck_rows, rows


@pytest.fixture
def place(tmp_path):
    """The smallest tables but for those that a test writes itself."""

    def of(*own):
        for name in TABLES:
            if name not in own:
                os.symlink(f"{SF}/{name}.parquet", tmp_path / f"{name}.parquet")
        return str(tmp_path)

    return of


def test_losses_equal_when_rounded_go_to_the_first_scale(spark, place):
    """A logit near zero: the losses of many scales are one when rounded, and the least before that is not the first."""
    path = place("documents", "labels")
    spark.createDataFrame([(1, "en", 1096)], "doc_id long, lang string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    found = rows(QUERIES["e37_temperature"](spark, path).toPandas())
    assert found == duck_rows(SQL["e37_temperature"].replace("FROM labels", f"FROM '{path}/labels.parquet/*.parquet'").replace("JOIN documents", f"JOIN '{path}/documents.parquet/*.parquet'"))


def test_digits_are_those_of_sql(spark, place):
    """Square roots so near to a half of the last digit that it turns on the product's last bit, and values that are no numbers."""
    path = place("events")
    values = [75924.67, 0.0, 1e300, float("inf"), float("nan"), None, *((k + 0.5) ** 2 / 1e16 for k in range(27_000_000_000, 27_000_002_000))]
    frame = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "event_id long, value double").selectExpr("event_id", "timestamp_seconds(event_id * 3600) AS ts", "0L AS user_id", "'view' AS event_type", "value", "'' AS props")
    frame.write.parquet(f"{path}/events.parquet")
    text = lambda found: sorted(map(repr, found[1]))  # noqa: E731  NaN is NaN
    assert text(rows(QUERIES["i01_scalar_functions"](spark, path).toPandas())) == text(duck_rows(SQL["i01_scalar_functions"].replace("FROM events", f"FROM '{path}/events.parquet/*.parquet'")))
