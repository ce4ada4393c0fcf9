"""Message tables and event logs, read whole or as a stream, and append-only sinks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only a local session may do without:
    it gets a temporary one, which it keeps."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def stream(spark: SparkSession, directory: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """The same table as a stream of its files; the schema is that of the files present.

    A table may be one file or a folder of files; a stream's source is always a folder.
    """
    path = f"{directory}/{name}.parquet"
    now = spark.read.parquet(path)
    reader = spark.readStream.schema(now.schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    one_file = all(f.endswith(f"/{name}.parquet") for f in now.inputFiles())
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(directory) if one_file else reader.parquet(path)


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, computed once, written to the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession)}/airlock-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append(df: DataFrame, path: str) -> None:
    """Appends rows to an audit table."""
    df.write.mode("append").parquet(path)


def append_stream(df: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Appends a stream to an audit table: at an interval such as "2 seconds", or what is there now."""
    writer = df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder or file, wherever its file system is; one that isn't there is no error."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
