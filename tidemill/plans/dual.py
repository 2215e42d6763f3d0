"""Queries stated once in SQL for Spark, with the same text in DuckDB's dialect as their check.

{name} is a table; @epoch(x) whole seconds since 1970; @quantile(x, q) the linearly interpolated quantile;
@ln(x) and @over(a, b) a logarithm and a quotient that take zero by IEEE rules, as DuckDB's do. Numbers with a point are doubles.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tidemill.functions import ieee
from tidemill.registry import query, table

_SPARK = (*ieee.SPARK, (r"('[^']*')|(?<![\w.])(\d+\.\d+)(?![\w.])", lambda m: m[1] or f"{m[2]}D"), (r"@epoch\(", "unix_timestamp("), (r"@quantile\(", "percentile("), (r"@json\((\w+), '(\w+)'\)", r"get_json_object(\1, '$.\2')"))
_DUCK = (*ieee.DUCK, (r"@epoch\(([^()]+)\)", r"CAST(floor(epoch(\1)) AS BIGINT)"), (r"@quantile\(", "quantile_cont("), (r"@json\((\w+), '(\w+)'\)", r"json_extract_string(\1, '$.\2')"), (r"\{(\w+)\}", r"\1"))


def rewritten(text: str, rules) -> str:
    for pattern, to in rules:
        text = re.sub(pattern, to, text)
    return text


def run(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    tables = {name: table(spark, sf_dir, name) for name in set(re.findall(r"\{(\w+)\}", text))}
    return spark.sql(rewritten(text, _SPARK), **tables)


def duck(text: str) -> str:
    return rewritten(text, _DUCK)


def dual(name: str, text: str) -> None:
    """Registers a query given by one SQL text."""
    query(name, duck(text))(lambda spark, sf_dir: run(spark, sf_dir, text))


#: Hourly bars of each event type, the stand-in for instruments.
BARS = """bars AS (
  SELECT event_type AS instrument, date_trunc('hour', ts) AS hour, @epoch(date_trunc_hour) AS t, min_by(value, ts) AS open, max(value) AS high, min(value) AS low,
         max_by(value, ts) AS close, sum(value) AS volume, count(*) AS ticks
  FROM (SELECT *, date_trunc('hour', ts) AS date_trunc_hour FROM {events}) AS e GROUP BY event_type, date_trunc('hour', ts), @epoch(date_trunc_hour))"""
#: One hourly bar series over all events, without gaps at the larger scales.
SERIES = """series AS (
  SELECT @epoch(h) AS t, min_by(value, ts) AS open, max(value) AS high, min(value) AS low, max_by(value, ts) AS close, sum(value) AS volume, count(*) AS ticks
  FROM (SELECT *, date_trunc('hour', ts) AS h FROM {events}) AS e GROUP BY h, @epoch(h))"""
