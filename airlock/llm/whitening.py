"""Whitening of embeddings: principal components of unit variance, by products of block matrices.

Vectors become whole numbers, so that their sums and with them the centred rows (n * x - S) / n have
one rounding only, however far the values lie from zero. Centred rows are dealt into blocks; the
blocks are a BlockMatrix A. The scatter matrix is the transpose of A times A: blocks are taken in
groups, each group's transposed blocks form one block row of the left factor, and so the product
holds one partial scatter for each group, made where the group's blocks meet. Their sum is as large as
one vector squared; its eigenvectors are found on the driver. A times the whitening matrix gives the
whitened rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlock.llm.store import written

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: Rows of a block, columns of a block at most, and blocks whose products are added in one task.
BLOCK_ROWS, BLOCK_COLS, GROUP_BLOCKS = 1024, 512, 16
_IN_PART = (1 << 33) - 1


def whole(vector: Column, scale: int = SCALE, offset: int = OFFSET) -> Column:
    """floor(scale * c) + offset of each entry as a double."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale) + offset)


def usable(vector: Column) -> Column:
    """True for vectors that are there and hold finite numbers only."""
    odd = lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf"))
    return F.coalesce(~F.exists(vector, odd), F.lit(False))


def _rows(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """Rows of a column of lists of longs; those that are shorter are filled with the offset."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.full((len(column), dims), OFFSET, np.int64)
    out[np.arange(dims) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _totals(rows: DataFrame, dims: int) -> tuple[int, np.ndarray]:
    """How many vectors there are, and their exact sums by dimension: a partial sum for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros(dims, np.int64), 0
        for batch in batches:
            sums += _rows(batch.column(0), dims).sum(axis=0)
            n += batch.num_rows
        yield pa.record_batch([pa.array(np.arange(dims + 1)), pa.array(np.append(sums, n))], ["at", "sum"])

    parts = rows.select("_x").mapInArrow(run, "at long, sum long")
    got = parts.groupBy("at").agg(F.sum("sum").alias("sum")).orderBy("at").collect()
    return int(got[-1]["sum"]), np.array([r["sum"] for r in got[:-1]], np.int64)


def _exact_squares(y: np.ndarray) -> list[int]:
    """Sums of squares of the rows of whole numbers, in as many bits as they take."""
    most = int(np.abs(y).max(initial=0))
    if most < 1 << 31 and most * most * max(1, y.shape[1]) < 1 << 63:
        return (y * y).sum(axis=1).tolist()
    exact = y.astype(object)
    return (exact * exact).sum(axis=1).tolist()


def centred_blocks(rows: DataFrame, n: int, sums: np.ndarray, width: int) -> DataFrame:
    """(block, ids, deviations, data): BLOCK_ROWS centred rows each, filled up with zeros to the width
    and height of a block; data holds them column by column."""
    counts = rows.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect()
    # A part of the table fills its own blocks; only the numbers of rows of the parts come here.
    heights = [-(-r["n"] // BLOCK_ROWS) for r in counts]
    first = np.concatenate([[0], np.cumsum(heights)]).tolist()
    spark = rows.sparkSession
    starts = spark.createDataFrame([(r["_part"], b) for r, b in zip(counts, first, strict=False)], "_p long, _first long")
    placed = rows.join(starts, F.col("_part") == F.col("_p")).select("_id", "_x", F.col("_at"), (F.col("_first") + F.floor(F.col("_at") / BLOCK_ROWS)).alias("_block"))
    kind = rows.schema["_id"].dataType.simpleString()
    dims = sums.size

    def gather(table: pa.Table) -> pa.Table:
        table = table.sort_by("_at")
        y = _rows(table.column("_x"), dims) * n - sums
        block = np.zeros((BLOCK_ROWS, width))
        block[: len(y), :dims] = y / n
        deviations = pa.array([_exact_squares(y)], pa.list_(pa.decimal128(38, 0)))
        ids = pa.ListArray.from_arrays(pa.array([0, len(y)], pa.int32()), table.column("_id").combine_chunks())
        return pa.table([table.column("_block")[:1], ids, deviations, pa.array([block.tobytes(order="F")])], ["block", "ids", "deviations", "data"])

    return placed.groupBy("_block").applyInArrow(gather, f"block long, ids array<{kind}>, deviations array<decimal(38,0)>, data binary")


def _matrix(raw: bytes, cols: int) -> np.ndarray:
    return np.frombuffer(raw).reshape((-1, cols), order="F")


def _dense(values: np.ndarray) -> DenseMatrix:
    return DenseMatrix(values.shape[0], values.shape[1], values.ravel(order="F"))


def scatter(blocks: RDD, count: int, width: int) -> np.ndarray:
    """The transpose of a matrix times the matrix, of (block, rows) of `count` blocks: one partial
    product for each GROUP_BLOCKS blocks, which are then added in a tree."""
    cols = min(width, BLOCK_COLS)
    across = width // cols
    cut = lambda rows, c: rows[:, c * cols : (c + 1) * cols]
    left = blocks.flatMap(lambda b: [((b[0] // GROUP_BLOCKS * across + c, b[0]), _dense(cut(b[1], c).T)) for c in range(across)])
    right = blocks.flatMap(lambda b: [((b[0], c), _dense(cut(b[1], c))) for c in range(across)])
    groups = -(-count // GROUP_BLOCKS)
    a = BlockMatrix(left, cols, BLOCK_ROWS, groups * width, count * BLOCK_ROWS)
    b = BlockMatrix(right, BLOCK_ROWS, cols, count * BLOCK_ROWS, width)

    def place(block) -> np.ndarray:
        (i, j), part = block
        out = np.zeros((width, width))
        i %= across
        out[i * cols : i * cols + part.numRows, j * cols : j * cols + part.numCols] = part.toArray()
        return out

    return a.multiply(b).blocks.map(place).treeReduce(np.add)


def whiten(df: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id_col, component, n, deviation, whitened, explained, identity_error) of every usable row.

    Rows whose vector is null or holds null or non-finite entries are left out; shorter vectors are
    filled with zeros. Repeated rows count each; null ids stay. `deviation` (a decimal, as it may pass
    64 bits) is the sum over dimensions of (n * x - S) ** 2. Components are numbered by falling
    variance; there are no more of them than dimensions with a variance that is not rounding alone, so
    a table of equal vectors, of one vector or of none gives no rows. Entries so large that the number
    of vectors times one passes 62 bits are an error. `identity_error` is the largest
    entry of the result's own covariance less the identity. Other columns are not read.
    """
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    chosen = df.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_v")).where(usable(F.col("_v")))
    kept = written(chosen.select("_id", whole(F.col("_v"), scale).alias("_x"), F.monotonically_increasing_id().alias("_row")), "vectors")
    rows = kept.select("_id", "_x", F.shiftright("_row", 33).alias("_part"), F.col("_row").bitwiseAND(_IN_PART).alias("_at"))
    seen = rows.agg(F.count("*"), F.max(F.size("_x")), F.max(F.greatest(F.array_max("_x"), -F.array_min("_x")))).first()
    dims = seen[1] or 0
    empty = spark.createDataFrame([], schema).withColumnRenamed("_id", id_col)
    if dims == 0:
        return empty
    if seen[0] * (2 * seen[2] + OFFSET) >= 1 << 63:
        raise ValueError("entries are too large for exact sums of so many vectors")
    n, sums = _totals(rows, dims)
    width = dims if dims <= BLOCK_COLS else -(-dims // BLOCK_COLS) * BLOCK_COLS
    blocks = written(centred_blocks(rows, n, sums, width), "blocks")
    count = blocks.count()
    data = blocks.select("block", "data").rdd.map(lambda r: (r[0], _matrix(r[1], width)))
    covariance = scatter(data, count, width)[:dims, :dims] / n
    trace = float(np.trace(covariance))
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    many = min(components, int((values > values[0] * dims * np.finfo(float).eps).sum())) if values[0] > 0 else 0
    if many == 0:
        return empty
    projection = np.zeros((width, many))
    projection[:dims] = vectors[:, :many] / np.sqrt(values[:many])

    # The projected blocks, read back beside the ids of their rows.
    cols = min(width, BLOCK_COLS)
    left = data.flatMap(lambda b: [((b[0], c), _dense(b[1][:, c * cols : (c + 1) * cols])) for c in range(width // cols)])
    right = spark.sparkContext.parallelize([((c, 0), _dense(projection[c * cols : (c + 1) * cols])) for c in range(width // cols)])
    product = BlockMatrix(left, BLOCK_ROWS, cols, count * BLOCK_ROWS, width).multiply(BlockMatrix(right, cols, many, width, many))
    made = spark.createDataFrame(product.blocks.map(lambda b: (b[0][0], bytearray(b[1].toArray().tobytes(order="F")))), "block long, z binary")
    white = written(made.join(blocks.select("block", "ids", "deviations"), "block"), "whitened")

    # Padded rows stay zero when the others are centred.
    real = white.select("block", "z", F.size("ids").alias("rows")).rdd.map(lambda r: (r[0], _matrix(r[1], many), r[2]))
    mean = real.map(lambda b: b[1].sum(axis=0)).treeReduce(np.add) / n
    centred = real.map(lambda b: (b[0], np.where(np.arange(BLOCK_ROWS)[:, None] < b[2], b[1] - mean, 0.0)))
    wide = many if many <= BLOCK_COLS else -(-many // BLOCK_COLS) * BLOCK_COLS
    padded = centred.map(lambda b: (b[0], np.pad(b[1], ((0, 0), (0, wide - many)))))
    error = float(np.abs(scatter(padded, count, wide)[:many, :many] / n - np.eye(many)).max())
    explained = values[:many] / trace

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, deviations = batch.column("ids")[k].values, batch.column("deviations")[k].values
                z = _matrix(batch.column("z")[k].as_py(), many)[: len(ids)]
                at = np.repeat(np.arange(len(ids)), many)
                columns = [ids.take(pa.array(at)), pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), len(ids))), pa.array(np.full(at.size, n)), deviations.take(pa.array(at)), pa.array(z.ravel()), pa.array(np.tile(explained, len(ids))), pa.array(np.full(at.size, error))]
                yield pa.record_batch(columns, ["_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return white.mapInArrow(unfold, schema).withColumnRenamed("_id", id_col)
