"""Tables that batches are added to: what is new, what replaces, what is still to be sent. Each is a plain function of tables, so a
foreachBatch sink, a batch job and a test run the same one, and a batch delivered twice has one effect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def insert_new(target: DataFrame, batch: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The rows of batch to insert: of each key that target lacks the first by order. What target has stays as it is."""
    first = batch.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")
    return first.join(target.select(keys).distinct(), keys, "left_anti").select(batch.columns)


def upsert(target: DataFrame, batch: DataFrame, keys: list[str], newest: Column) -> DataFrame:
    """target with the rows of batch in place of those of the same key that are older; of equal age batch's."""
    values = [c for c in target.columns if c not in keys]
    both = target.withColumn("_side", F.lit(0)).unionByName(batch.select(target.columns).withColumn("_side", F.lit(1)))
    last = both.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(newest.alias("a"), F.col("_side").alias("s"), F.struct(*values).alias("v"))).alias("x"))
    return last.select(*keys, "x.*").select(target.columns)


def publish(outbox: DataFrame, order: str, published: str, limit: int, stamp: Column) -> tuple[DataFrame, DataFrame]:
    """The `limit` oldest rows without a mark, and outbox with the mark on them. Only ids are sorted, `limit` a task."""
    due = outbox.where(F.col(published).isNull()).orderBy(order).limit(limit).select(order, F.lit(True).alias("_due"))
    marked = outbox.join(F.broadcast(due), order, "left")
    sent = outbox.join(F.broadcast(due), order, "left_semi")
    return sent, marked.withColumn(published, F.when(F.col("_due"), stamp).otherwise(F.col(published))).select(outbox.columns)
