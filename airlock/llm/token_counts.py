"""Token counts of documents in flat token files, found by their separators.

A flat token file is nothing but ids one after the other, each document closed by an
end-of-document id, with no index. It is handled as a table of blocks (file, block, data), cut
anywhere. Each block is searched for separators with one array comparison; how many documents
ended before a block, and how much of a document was open at its start, come from prefix sums over
the blocks of the file, so blocks are read independently and in any order. The prefix sums have two
levels, inside groups of blocks and over the groups, so a long file does not meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airlock.llm.store import written
from airlock.llm.tokens import default_path, encoder

#: The end-of-document id of the tokenizer file used here, and the bytes of an id.
SEPARATOR, WIDTH = 50256, 2
BLOCK_BYTES = 1 << 18
#: Blocks of a group of the prefix sums.
GROUP_BLOCKS = 1024
#: Blocks whose offsets are broadcast to their documents' lengths; more are joined by a shuffle.
BROADCAST_BLOCKS = 1 << 20
#: Raw files up to this size are read whole by a task; larger ones are cut into ranges of this size.
WHOLE_BYTES = 1 << 28


def token_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, separator: int = SEPARATOR, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Documents as flat token files, one for each task, and the order of documents in them.

    Returns blocks (file long, block long, data binary; little-endian ids of `width` bytes, blocks
    cut without regard to documents) and order (file, ordinal, id_col). Both are read from one
    written table. Strings of special tokens in a text are ordinary text, so a separator never
    comes from a text. A null or empty text is a document of no ids.
    """
    if block_bytes % width:
        raise ValueError("a block must hold whole ids")
    if separator >> 8 * width:
        raise ValueError(f"{width} bytes do not hold the separator")
    path = tokenizer or default_path()
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["file", "block", "data", "ordinal", id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, specials_as_text=True)
        file, block, seen, held = TaskContext.get().partitionId(), 0, 0, b""

        def data_rows(raw: bytes, at: int) -> pa.RecordBatch:
            cut = [raw[i : i + block_bytes] for i in range(0, len(raw), block_bytes)]
            n = len(cut)
            return pa.record_batch([pa.array([file] * n, pa.int64()), pa.array(range(at, at + n), pa.int64()), pa.array(cut, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, key.type)], names)

        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                key = part.column(0)
                ids, offs = enc.encode(part.column(1))
                if ids.size and int(ids.max()) >> 8 * width:
                    raise ValueError(f"the tokenizer has ids that {width} bytes do not hold")
                held += np.insert(ids, offs[1:], separator).astype(f"<u{width}").tobytes()
                n = part.num_rows
                yield pa.record_batch([pa.array(np.full(n, file)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(np.arange(seen, seen + n)), key], names)
                seen += n
                whole = len(held) // block_bytes * block_bytes
                if whole:
                    yield data_rows(held[:whole], block)
                    block, held = block + whole // block_bytes, held[whole:]
        if held:
            yield data_rows(held, block)

    schema = f"file long, block long, data binary, ordinal long, `{id_col}` {kind}"
    table = written(docs.select(id_col, text_col).mapInArrow(run, schema), "tokens")
    return table.where("block is not null").select("file", "block", "data"), table.where("block is null").select("file", "ordinal", id_col)


def read_token_files(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Raw token files under a path as blocks (file, block, data).

    Files of at most WHOLE_BYTES are read by Spark, whole. Larger ones, of any size, are cut into
    ranges of whole blocks that tasks open for themselves, by way of Arrow's file systems.
    """
    names = ["file", "block", "data"]

    def cut(name: str, raw: memoryview, at: int) -> pa.RecordBatch:
        parts = [bytes(raw[i : i + block_bytes]) for i in range(0, len(raw), block_bytes)]
        return pa.record_batch([pa.array([name] * len(parts), pa.string()), pa.array(range(at, at + len(parts)), pa.int64()), pa.array(parts, pa.binary())], names)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield cut(name, memoryview(raw.as_buffer()), 0)

    def ranges_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, where = FileSystem.from_uri(name.replace("file:/", "file:///", 1) if name.startswith("file:/") and not name.startswith("file://") else name)
                with system.open_input_file(where) as f:
                    f.seek(start)
                    yield cut(name, memoryview(f.read(span)), start // block_bytes)

    files = spark.read.format("binaryFile").load(path)
    span = max(1, WHOLE_BYTES // block_bytes) * block_bytes
    schema = "file string, block long, data binary"
    small = files.where(F.col("length") <= WHOLE_BYTES).select("path", "content").mapInArrow(whole, schema)
    large = files.where(F.col("length") > WHOLE_BYTES).select("path", "length")
    if large.isEmpty():
        return small
    starts = large.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(span).cast("long"))).alias("start"))
    return small.unionByName(starts.repartition("path", "start").mapInArrow(ranges_of, schema))


def token_counts(blocks: DataFrame, separator: int = SEPARATOR, width: int = WIDTH) -> DataFrame:
    """(file, ordinal, n_tokens) of every document of flat token files given as blocks.

    `n_tokens` leaves out the separator. Ids after a file's last separator are a last document, if
    there are any. Two separators in a row enclose an empty document. A file without ids has none.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {n: [] for n in ("n", "ends", "first", "last", "inner")}
            for raw in batch.column(2):
                ids = np.frombuffer(raw.as_buffer(), f"<u{width}") if raw.is_valid else np.zeros(0, f"<u{width}")
                found = np.flatnonzero(ids == separator)
                out["n"].append(ids.size)
                out["ends"].append(found.size)
                out["first"].append(int(found[0]) if found.size else None)
                out["last"].append(int(found[-1]) if found.size else None)
                out["inner"].append(np.diff(found) - 1)
            yield pa.record_batch([batch.column(0), batch.column(1), *(pa.array(out[n], pa.int64()) for n in ("n", "ends", "first", "last")), pa.array(out["inner"], pa.list_(pa.int64()))], ["file", "block", "n", "ends", "first", "last", "inner"])

    kind = blocks.schema["file"].dataType.simpleString()
    found = written(blocks.select("file", "block", "data").mapInArrow(scan, f"file {kind}, block long, n long, ends long, first long, last long, inner array<long>"), "scanned")
    slim = found.select("file", "block", "n", "ends", "first", "last").withColumn("group", F.floor(F.col("block") / GROUP_BLOCKS))
    inside = Window.partitionBy("file", "group").orderBy("block")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    # Inside a group: ids and ends before a block, and where the last end was (null: before the group).
    local = slim.withColumn("at", zero(F.sum("n").over(before))).withColumn("base", zero(F.sum("ends").over(before)))
    local = local.withColumn("closed", F.max(F.col("at") + F.col("last") + 1).over(before))
    groups = local.groupBy("file", "group").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"), F.max(F.col("at") + F.col("last") + 1).alias("closed"))
    over = Window.partitionBy("file").orderBy("group")
    earlier = over.rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("g_at", zero(F.sum("n").over(earlier))).withColumn("g_base", zero(F.sum("ends").over(earlier)))
    groups = groups.withColumn("g_closed", zero(F.max(F.col("g_at") + F.col("closed")).over(earlier))).withColumn("is_last", F.lead("group").over(over).isNull())
    placed = local.join(groups.select("file", "group", "g_at", "g_base", "g_closed", "is_last"), ["file", "group"])
    start = F.col("g_at") + F.col("at")
    placed = placed.select(
        "file", "block", "n", "ends", "first", "last",
        (F.col("g_base") + F.col("base")).alias("base"),
        (start - F.coalesce(F.col("g_at") + F.col("closed"), F.col("g_closed"))).alias("open"),
        (F.col("is_last") & F.lead("block").over(inside).isNull()).alias("is_last"),
    )
    head = F.when(F.col("ends") > 0, F.array(F.struct(F.col("base").alias("ordinal"), (F.col("open") + F.col("first")).alias("n_tokens"))))
    rest = F.when(F.col("ends") > 0, F.col("n") - F.col("last") - 1).otherwise(F.col("open") + F.col("n"))
    tail = F.when(F.col("is_last") & (rest > 0), F.array(F.struct((F.col("base") + F.col("ends")).alias("ordinal"), rest.alias("n_tokens"))))
    none = F.array().cast("array<struct<ordinal:bigint,n_tokens:bigint>>")
    edges = placed.select("file", F.explode(F.concat(F.coalesce(head, none), F.coalesce(tail, none))).alias("d")).select("file", "d.ordinal", "d.n_tokens")
    # The lengths inside a block stay where they are: only the blocks' offsets travel.
    offsets = placed.where("ends > 1").select("file", "block", "base")
    few = found.count() <= BROADCAST_BLOCKS
    within = found.where("ends > 1").select("file", "block", "inner").join(F.broadcast(offsets) if few else offsets, ["file", "block"])
    within = within.select("file", "base", F.posexplode("inner").alias("k", "n_tokens")).select("file", (F.col("base") + F.col("k") + 1).alias("ordinal"), "n_tokens")
    return edges.unionByName(within)


def document_token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(id_col, file, ordinal, n_tokens) of every row: its count, read back from flat token files.

    Repeated rows count each. Columns other than the two named are not read, whatever their names.
    """
    blocks, order = token_blocks(docs, id_col, text_col, tokenizer)
    return order.join(token_counts(blocks), ["file", "ordinal"]).select(id_col, "file", "ordinal", "n_tokens")
