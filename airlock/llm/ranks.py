"""Row numbers within groups, without any group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airlock.llm.store import written

_IN_PART = (1 << 33) - 1


def ranked(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """df with `rank`, from 1 in each group in the given order; rows that tie are numbered in any order.

    One range sort deals the rows out, hot groups over as many parts as they need. A row's number in
    its part is then known, and what stands before the part is a sum over parts: tables of one row for
    each part and group, of which only those of one group meet in a task. Null is a group of its own.
    An empty table gives an empty one. Columns named rank, _row, _part and _before are taken.
    """
    sorted_rows = df.orderBy(*(F.col(g).asc_nulls_first() for g in group), *order).withColumn("_row", F.monotonically_increasing_id())
    kept = written(sorted_rows, name).withColumn("_part", F.shiftright("_row", 33))
    starts = kept.groupBy("_part", *group).agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first").bitwiseAND(_IN_PART)).drop("_n", "_first")
    known = starts.select("_part", "_before", *(F.col(g).alias(f"_g_{g}") for g in group))
    same = F.col("_part") == F.col("_p")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    placed = kept.join(known.withColumnRenamed("_part", "_p"), same)
    rank = F.col("_row").bitwiseAND(_IN_PART) + F.col("_before") + 1
    return placed.select(*df.columns, rank.alias("rank"))
