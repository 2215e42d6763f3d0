"""Sinks that drain a stream into a table of the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_place(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one (spark.checkpoint.dir). A local one where none is set, but only if the executors are threads
    of this machine; on a cluster they would not see it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tidemill-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tidemill/{name}-{uuid.uuid4().hex}"


def settled(rows: DataFrame, name: str) -> DataFrame:
    """rows, written to a new folder of the shared one and read again: a cut in the lineage that lost executors do not undo."""
    place = shared_place(rows.sparkSession, name)
    rows.write.parquet(place)
    return rows.sparkSession.read.schema(rows.schema).parquet(place)


def drain(stream: DataFrame, name: str) -> DataFrame:
    """All that the stream appends until its source is exhausted. The file sink's log makes each batch count once, also
    when a batch is run again after a failure."""
    place = shared_place(stream.sparkSession, name)
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{place}/log").option("path", f"{place}/rows")
    writer.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{place}/rows")


def drain_idempotent(stream: DataFrame, name: str, routes: dict[str, Callable[[DataFrame], DataFrame]]) -> dict[str, DataFrame]:
    """Several tables of one stream. Each batch overwrites its own folder in each, so that a batch delivered twice leaves
    one effect; no table depends on what another one has."""
    spark, place = stream.sparkSession, shared_place(stream.sparkSession, name)

    def write(batch: DataFrame, number: int) -> None:
        for route, rows in routes.items():
            rows(batch).write.mode("overwrite").parquet(f"{place}/{route}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{place}/log").trigger(availableNow=True).start().awaitTermination()
    return {route: spark.read.schema(rows(spark.createDataFrame([], stream.schema)).schema).parquet(f"{place}/{route}/batch=*") for route, rows in routes.items()}


def write_routes(place: str, batch: DataFrame, number: int) -> None:
    """One batch's rows by route, written once and in place of what an earlier delivery of the batch left."""
    batch.write.mode("overwrite").partitionBy("route").parquet(f"{place}/rows/batch={number}")


def drain_routes(stream: DataFrame, name: str) -> DataFrame:
    """All that a stream with a column `route` gives, in folders by batch and route: the tables of all routes are of one batch."""
    spark, place = stream.sparkSession, shared_place(stream.sparkSession, name)
    writer = stream.writeStream.foreachBatch(lambda batch, number: write_routes(place, batch, number)).outputMode("append")
    writer.option("checkpointLocation", f"{place}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/rows").select(stream.columns)


def write_months(rows: DataFrame, time: str, order: list[str], name: str, form: str = "csv") -> str:
    """rows as files, a folder a month, sorted within each file; the folder appears as a whole when the job commits. Months are
    dealt over tasks with their days, so that a long one is several files."""
    place = shared_place(rows.sparkSession, name)
    month = rows.withColumn("month", F.date_format(time, "yyyy-MM")).repartition("month", F.dayofmonth(time)).sortWithinPartitions("month", *order)
    writer = month.write.partitionBy("month")
    (writer.option("header", True) if form == "csv" else writer).format(form).save(place)
    return place


def table_in_order(rows: DataFrame, order: str, size: int, name: str) -> str:
    """rows as files that a stream reads one after the other: file k has the rows of order from k * size on. They are written in one
    job; then their times are set in order, which is what a file stream goes by."""
    spark, place = rows.sparkSession, shared_place(rows.sparkSession, name)
    numbered = rows.withColumn("_file", F.floor(F.col(order) / size))
    numbered.repartition("_file").write.partitionBy("_file").parquet(place)
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(place).getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted((int(f.rsplit("_file=", 1)[1].split("/")[0]), f) for f in spark.read.parquet(place).inputFiles())
    for k, (_, f) in enumerate(found):  # a second apart, some files have coarse times
        files.setTimes(path(f), 1_600_000_000_000 + k * 1000, -1)
    return place
