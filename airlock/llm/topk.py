"""Exact top-k search by inner product, a block at a time.

Vectors are held in blocks of so many rows in the order of their ids: a forward index of the block's vectors and, for each
component ("term"), its greatest and least value. A query's score with any vector of a block is at
most the sum over components of what the extreme value can add. Queries travel in chunks.

Bounds come first, from the blocks' extremes alone; where blocks are many, from the extremes of groups
of blocks before that, and only the blocks of groups that are admitted are looked at. Each query's block of the highest bound is
scored, which gives it a k-th score; then only the blocks whose bound reaches that score for some
query of a chunk are sent to the chunk. There, each query visits blocks in the order of their bounds
and stops when the bound falls below its k-th score so far.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airlock.llm.ranks import ranked
from airlock.llm.store import written

SCALE = 1024
BLOCK_ROWS = 1024
#: Blocks that a task scores at a time, at most; with few blocks, so few that all cores have work.
PART_BLOCKS = 32
#: Blocks whose extremes are compared with a chunk of queries at a time.
BOUND_BLOCKS = 4096
CHUNK_QUERIES = 1024
_RESULT = "query_id long, vec_id long, score long"


def _dims(*columns: tuple[pa.Table, str]) -> int:
    return max(int(t.column(c).combine_chunks().value_lengths().to_numpy(zero_copy_only=False).max(initial=0)) for t, c in columns)


def _matrix(table: pa.Table, name: str, dims: int) -> np.ndarray:
    """Rows of an array column as exact integers; short rows are filled with zeros."""
    column = table.column(name).combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), dims))
    at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(column)), sizes), at] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in whole numbers: by floating point where that is exact, else by 64-bit integers."""
    if a.shape[1] * max(np.abs(a).max(initial=0), 1) * max(np.abs(b).max(initial=0), 1) < 2**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """What each query's score with a vector between `low` and `high` is at most, for each of these."""
    return _product(np.maximum(queries, 0), high) + _product(np.minimum(queries, 0), low)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k columns of each row with the highest scores, ties to smaller ids."""
    by_id = np.argsort(ids, axis=1, kind="stable")
    scores, ids = np.take_along_axis(scores, by_id, 1), np.take_along_axis(ids, by_id, 1)
    top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(scores, top, 1), np.take_along_axis(ids, top, 1)


_NONE = np.iinfo(np.int64).min + 1


def search_part(queries: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, rows: np.ndarray, ids: np.ndarray, blocks: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Scores and ids of each query's best k of the rows, which are sorted by id, and how many
    (query, block) pairs were scored. `floor` is a score that a result must reach to matter."""
    names, first = np.unique(blocks, return_index=True)
    last = np.append(first[1:], len(blocks))
    high = np.maximum.reduceat(rows, first, axis=0)
    low = np.minimum.reduceat(rows, first, axis=0)
    bound = _bounds(queries, high, low)
    order = np.argsort(-bound, axis=1, kind="stable")
    scores = np.full((len(queries), k), _NONE)
    found = np.full((len(queries), k), np.iinfo(np.int64).max)
    active, scored = np.arange(len(queries)), 0
    for turn in range(len(names)):
        kth = np.maximum(scores[active, -1], floor[active])
        active = active[bound[active, order[active, turn]] >= kth]
        if not active.size:
            break
        scored += active.size
        for b in np.unique(order[active, turn]):
            who = active[order[active, turn] == b]
            here = ids[first[b] : last[b]]
            got = _product(queries[who], rows[first[b] : last[b]])
            got[here[None, :] == query_ids[who][:, None]] = _NONE
            top = np.argsort(-got, axis=1, kind="stable")[:, :k]
            scores[who], found[who] = _best(np.hstack([scores[who], np.take_along_axis(got, top, 1)]), np.hstack([found[who], here[top]]), k)
    return scores, found, scored


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best other vectors by integer inner product.

    Every component x counts as floor(1024 * x). Vectors that are null or hold null or non-finite
    components, and null ids, take no part. Rows that share an id are one vector (the least of
    theirs); a missing last component counts as 0. Ties go to the smaller id. A query gets fewer
    than k rows only if there are no more vectors. Other columns are not read.
    """
    x = F.col(vector_col)
    whole = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    clean = vectors.where(F.col(id_col).isNotNull() & whole).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.min(vector_col).alias("_x"))
    number = F.transform("_x", lambda v: F.floor(v.cast("double") * SCALE).cast("long"))
    flags = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), is_query.alias("_q")).where("_q").distinct()
    placed = ranked(clean.select("_id", number.alias("_x")), [], [F.col("_id").asc()], "vectors")
    table = written(placed.select("_id", "_x", F.floor((F.col("rank") - 1) / BLOCK_ROWS).alias("_block")), "blocks")
    asked = table.join(flags, "_id", "left_semi").select(F.col("_id").alias("_qid"), F.col("_x").alias("_qx"))
    chunks = -(-asked.count() // CHUNK_QUERIES)
    if chunks == 0:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    asked = written(asked.withColumn("_chunk", F.pmod(F.xxhash64("_qid"), F.lit(chunks))).withColumn("_floor", F.lit(_NONE)), "queries", small=True)

    def extremes_of(rows: pa.Table) -> pa.Table:
        dims = _dims((rows, "_x"))
        x = _matrix(rows, "_x", dims).astype(np.int64)
        return pa.table({"_block": rows.column("_block").slice(0, 1), "high": pa.array([x.max(0).tolist()], pa.list_(pa.int64())), "low": pa.array([x.min(0).tolist()], pa.list_(pa.int64())), "dims": pa.array([dims], pa.int64())})

    extremes = written(table.groupBy("_block").applyInArrow(extremes_of, "_block long, high array<long>, low array<long>, dims long"), "extremes")
    blocks, widest = extremes.agg(F.count("*"), F.max("dims")).first()
    size = max(1, min(PART_BLOCKS, blocks // (3 * vectors.sparkSession.sparkContext.defaultParallelism)))
    extremes = extremes.select("_block", "high", "low", F.floor(F.col("_block") / BOUND_BLOCKS).alias("_group"))
    chunk_ids = asked.select("_chunk").distinct()

    def top_of(rows: pa.Table) -> pa.Table:
        high, low = _matrix(rows, "high", widest).max(0), _matrix(rows, "low", widest).min(0)
        return pa.table({"_block": rows.column("_group").slice(0, 1), "high": pa.array([high.astype(np.int64).tolist()], pa.list_(pa.int64())), "low": pa.array([low.astype(np.int64).tolist()], pa.list_(pa.int64()))})

    tops = None
    if blocks > BOUND_BLOCKS:
        tops = written(extremes.groupBy("_group").applyInArrow(top_of, "_block long, high array<long>, low array<long>"), "tops", small=True).withColumn("_group", F.floor(F.col("_block") / BOUND_BLOCKS))

    def admit(first: bool) -> Callable:
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            """The blocks that a chunk needs: each query's with the highest bound, or all that reach its floor."""
            out = {"_chunk": pa.array([], pa.int64()), "_block": pa.array([], pa.int64())}
            if left.num_rows and right.num_rows:
                bound = _bounds(_matrix(right, "_qx", max(1, widest)), _matrix(left, "high", max(1, widest)), _matrix(left, "low", max(1, widest)))
                need = np.unique(bound.argmax(1)) if first else np.flatnonzero((bound >= right.column("_floor").to_numpy()[:, None]).any(0))
                out = {"_chunk": pa.array(np.full(need.size, right.column("_from")[0].as_py())), "_block": left.column("_block").combine_chunks().take(pa.array(need))}
            return pa.table(out)

        return run

    def compared(rows: DataFrame, places: DataFrame, queries: DataFrame, first: bool) -> DataFrame:
        sent = places.join(rows, "_group")
        calls = places.join(queries, "_chunk").select(F.col("_group").alias("_to"), F.col("_chunk").alias("_from"), "_qx", "_floor")
        return sent.groupBy("_group", "_chunk").cogroup(calls.groupBy("_to", "_from")).applyInArrow(admit(first), "_chunk long, _block long")

    def needed(queries: DataFrame, first: bool) -> DataFrame:
        """The (chunk, block) pairs that queries need, by way of the groups that they need."""
        if tops is None:
            return compared(extremes, chunk_ids.withColumn("_group", F.lit(0).cast("long")), queries, first)
        above = -(-(-(-blocks // BOUND_BLOCKS)) // BOUND_BLOCKS)
        all_tops = chunk_ids.withColumn("_group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(above - 1).cast("long"))))
        groups = written(compared(tops, all_tops, queries, first), "groups", small=True)
        return compared(extremes, groups.select("_chunk", F.col("_block").alias("_group")), queries, first)

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        if not left.num_rows or not right.num_rows:
            return none
        left = left.sort_by("_id")
        dims = _dims((left, "_x"), (right, "_qx"))
        query_ids, floor = right.column("_qid").to_numpy(), right.column("_floor").to_numpy()
        scores, ids, _ = search_part(_matrix(right, "_qx", dims), query_ids, floor, _matrix(left, "_x", dims), left.column("_id").to_numpy(), left.column("_block").to_numpy(), k)
        keep = (scores != _NONE) & (scores >= floor[:, None])
        return pa.table({"query_id": np.repeat(query_ids, keep.sum(1)), "vec_id": ids[keep], "score": scores[keep]})

    def scored(which: DataFrame, queries: DataFrame) -> DataFrame:
        """Results of the (chunk, block) pairs `which`; only the vectors of these blocks are sent."""
        part = F.floor(F.col("_block") / size)
        rows = which.join(table, "_block").select(part.alias("_part"), "_chunk", "_id", "_x", "_block")
        calls = which.select(part.alias("_to"), F.col("_chunk").alias("_from")).distinct().join(queries.withColumnRenamed("_chunk", "_from"), "_from").select("_to", "_from", "_qid", "_qx", "_floor")
        return rows.groupBy("_part", "_chunk").cogroup(calls.groupBy("_to", "_from")).applyInArrow(search, _RESULT)

    ahead = written(needed(asked, first=True), "ahead")
    seen = written(scored(ahead, asked), "seen")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    first_k = lambda found: found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    kth = first_k(seen).groupBy(F.col("query_id").alias("_qid")).agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(_NONE)).alias("_kth"))
    floored = asked.join(kth, "_qid", "left").withColumn("_floor", F.coalesce("_kth", F.lit(_NONE))).drop("_kth")
    rest = written(needed(floored, first=False).join(ahead, ["_chunk", "_block"], "left_anti"), "rest")
    return first_k(seen.unionByName(scored(rest, floored))).select("query_id", "rank", "vec_id", "score")
