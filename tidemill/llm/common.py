"""What the corpus operators share: shared-folder tables, skew-safe joins, per-process caches."""

from __future__ import annotations

import contextlib
import sys
import tempfile
import types
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Functions of this package travel to executors by value, so a cluster needs no copy of it installed.
cloudpickle.register_pickle_by_value(sys.modules["tidemill.llm"])


def process_cache() -> types.ModuleType:
    """A module that lives as long as the Python worker, for tokenizers and power tables."""
    return sys.modules.setdefault("_tidemill_worker_cache", types.ModuleType("_tidemill_worker_cache"))


#: Bytes of a batch of rows on its way to a Python worker; a longer single row is a batch of its own.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes where the session sets nothing: 10000 rows of long texts are no bound on memory."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). A local one where none is set, but only if the executors are
    threads of this machine; on a cluster they would not see it."""
    bound_batches(spark)
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tidemill-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tidemill"


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def session_conf(spark: SparkSession, **settings: str):
    """Sets SQL settings (dots written as __) for the actions inside, then puts the old ones back."""
    keys = {k.replace("__", "."): v for k, v in settings.items()}
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: cuts lineage, survives lost executors, and
    gives Catalyst the real size of what follows. The shuffle files behind it go as soon as it is written."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    with session_conf(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Deletes a table of materialize() that nothing reads any more."""
    spark = df.sparkSession
    for f in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/tidemill/" in f:
            path = spark._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: A key with at least this share of the rows is heavy; so at most 1 / HEAVY_SHARE keys are.
HEAVY_SHARE = 1e-3


def heavy_split_join(rows: DataFrame, table: DataFrame, key: str, counts: DataFrame, total: int, how: str = "left") -> DataFrame:
    """rows JOIN table (one row a key) ON key, safe where one key has a third of all rows.

    counts has (key, n), n the key's number of rows. Keys with n >= HEAVY_SHARE * total number 1000 at most, so their
    part of the table is broadcast; all other keys are joined by an ordinary shuffle. No row is dropped or sampled.
    Null keys match nothing and stay with how="left".
    """
    heavy = counts.where(F.col("n") >= F.lit(max(2.0, HEAVY_SHARE * total))).select(key).orderBy(key).limit(int(1 / HEAVY_SHARE) + 1)
    found = [r[0] for r in heavy.collect()]  # 1000 keys at most
    if not found:
        return rows.join(table, key, how)
    is_heavy = F.coalesce(F.col(key).isin(found), F.lit(False))
    hot = rows.where(is_heavy).join(F.broadcast(table.where(is_heavy)), key, how)
    return hot.unionByName(rows.where(~is_heavy).join(table.where(~is_heavy), key, how))


def input_columns(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only (doc_id, text), whatever other columns there are; null texts become empty."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
