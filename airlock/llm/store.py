"""Tables written between steps, where every executor can read them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from airlock.sources.tables import shared_dir


#: Rows and bytes that a Python worker gets at once. Texts and shingle arrays are long: the defaults of
#: 10,000 rows and 64 MB would be held several times over on both sides, outside the JVM's heap.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def written(df: DataFrame, name: str, small: bool = False) -> DataFrame:
    """df, computed once and read back from Parquet: later steps don't repeat its work, and a lost
    executor costs only a read. What is `small` next to the text (links, labels, counts of keys) goes
    to an eighth as many files as there are shuffle partitions, but no fewer than 8."""
    spark = df.sparkSession
    if small:
        df = df.coalesce(max(8, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    path = f"{shared_dir(spark)}/airlock-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a table of written() that later tables have replaced; nothing may read it any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.rsplit("/", 1)[1].startswith("airlock-"):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
