"""Messages of trades, by rows stated by hand."""

from pyspark.sql import functions as F

from tidemill.functions.text import fixed, trade_message


def test_messages(spark):
    rows = [
        ("TP", 1, 7, 100.0, 110.005, 1.0, 0.984), ("CUT", -1, 8, 100.0, 99.0, 0.125, 0.1), (None, 1, 9, 1234.5, 1000.0, -2.345678, None),
        ("SL", -1, 10, 0.004, 0.006, -0.004, -1.0), ("min_gap", 1, 11, None, None, None, None), (None, 1, 12, None, None, None, None),
    ]
    found = spark.createDataFrame(rows, "kind string, side int, id long, entry double, price double, r double, net double")
    said = found.select(trade_message(*[F.col(c) for c in ("kind", "side", "id", "entry", "price", "r", "net")]))
    assert [r[0] for r in said.collect()] == [
        "TP LONG #7 100.00 -> 110.01 +1.00 R (net +0.98 R)", "OPEN SHORT #8 100.00 -> 99.00 +0.13 R", "OPEN LONG #9 1234.50 -> 1000.00 -2.35 R",
        "SL SHORT #10 0.00 -> 0.01 +0.00 R (net -1.00 R)", "SKIPPED LONG #11: min_gap", "SKIPPED LONG #12: unknown",
    ]


def test_fixed(spark):
    rows = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,), (-0.5,), (12.3456,)], "x double")
    assert [r[0] for r in rows.select(fixed(F.col("x"), 3, True)).collect()] == [None, None, None, "-0.500", "+12.346"]
