"""Batches that are committed as a whole: tables under one folder, and a manifest that readers follow.

A micro-batch writes what it adds to each table under its own number (<table>/batch=<number>) and then
one manifest of a single file, which appears in one step. Readers see the batches up to the manifest's
number and no more, so they never see one table of a batch without the others. A batch that was not
committed is run again by the stream, with the same rows and number, and overwrites what it left; one
that was committed is not run again.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from airlock.sources.tables import remove

#: Manifests that are kept; the last one counts.
KEPT = 3


def last_commit(spark: SparkSession, path: str, fields: str) -> Row | None:
    """The newest manifest, or None."""
    try:
        found = spark.read.schema(f"{fields}, batch long").parquet(f"{path}/manifest")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    newest = found.orderBy(F.col("batch").desc()).limit(1).collect()
    return newest[0] if newest else None


def one_row(spark: SparkSession, fields: str, values: tuple) -> DataFrame:
    """A table of one row made of literals, in one partition."""
    schema = StructType.fromDDL(fields)
    return spark.range(0, 1, 1, 1).select(*(_literal(v, f.dataType).alias(f.name) for v, f in zip(values, schema, strict=True)))


def _literal(value, kind: DataType) -> Column:
    if isinstance(kind, ArrayType):
        return F.array(*(_literal(v, kind.elementType) for v in value)).cast(kind)
    if isinstance(kind, StructType):
        return F.struct(*(_literal(v, f.dataType).alias(f.name) for v, f in zip(value, kind, strict=True)))
    return F.lit(value).cast(kind)


def commit(spark: SparkSession, path: str, number: int, fields: str, values: tuple) -> None:
    one_row(spark, fields, values).write.mode("overwrite").parquet(f"{path}/manifest/batch={number}")
    remove(spark, f"{path}/manifest/batch={number - KEPT}")


def add(rows: DataFrame, path: str, table: str, number: int, *by: str) -> None:
    """Writes a batch's rows of a table, in place of what a failed run of the batch has left."""
    rows.write.mode("overwrite").partitionBy(*by).parquet(f"{path}/{table}/batch={number}")


def committed(spark: SparkSession, path: str, table: str, schema: str, number: int | None) -> DataFrame:
    """All rows of a table up to a batch, with the batch they came in."""
    if number is None:
        return spark.createDataFrame([], f"{schema}, batch long")
    return spark.read.schema(f"{schema}, batch long").parquet(f"{path}/{table}").where(F.col("batch") <= number)


def of_batch(spark: SparkSession, path: str, table: str, schema: str, number: int) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/{table}/batch={number}")
