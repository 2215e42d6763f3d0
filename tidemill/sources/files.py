"""Tables as file streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemill.registry import table


def stream_table(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """The Parquet table as a stream, files_per_batch files at a time or all at once; the table may be one file or a folder of files."""
    schema = table(spark, sf_dir, name).schema
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{sf_dir}/{name}.parquet") if folder else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
