"""Repeated byte strings removed, with suffix arrays built by induced sorting.

Only stretches whose seeds repeat (repeats.py) can hold a repeated string. Copies of a stretch are
one entry; where a seed has more than one entry, all of them go to the same shard. A shard's suffix
array puts equal strings next to each other, the permuted common prefixes of neighbours tell where
they end, and of equal strings all but the first stand later in the corpus.

A seed with very many entries (a passage that a share of all documents quotes, at its edges) is
dealt over several shards, each with the seed's first entry. Strings that no shard has found earlier
are candidates once more: those whose hash occurs again are the entries of the next round, under
that hash, until a round leaves none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlock.llm.flat import flat, prefix, ranges, span_hash
from airlock.llm.repeats import BROADCAST_RUNS, by_document, byte_symbols, covered, find, joined, keyed, lists, with_runs
from airlock.llm.store import discard, written
from airlock.llm.suffix_array import permuted_prefixes, suffix_array

LENGTH = 100
SEED = 40
#: Entries of one seed that a shard takes; those of a seed with more are dealt over several.
SHARD_ENTRIES = 512
SHARD_BYTES = 1 << 20
_PLACE = "_doc long, _t int, start long, count long"


def _stretches(docs: DataFrame, entries: DataFrame, length: int) -> DataFrame:
    """The bytes that each entry's run of strings covers, with its key and whether it comes again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, at = lists(batch.column(3))
            counts, _ = lists(batch.column(4))
            more = batch.column(5).flatten()
            buf, offs = flat(batch.column(2))
            owner = np.repeat(np.arange(batch.num_rows), np.diff(at))
            for k in range(0, owner.size, 4096):
                who, start, count = owner[k : k + 4096], starts[k : k + 4096], counts[k : k + 4096]
                size = count - 1 + length
                raw = buf[ranges(offs[who] + start, size)]
                ends = np.concatenate([[0], np.cumsum(size)])
                data = pa.Array.from_buffers(pa.large_binary(), size.size, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary())
                pick = pa.array(who)
                key, part, first = (more.field(n).slice(k, who.size) for n in ("seed", "part", "first"))
                yield pa.record_batch([key, part, first, batch.column(0).take(pick), batch.column(1).take(pick), pa.array(start), pa.array(count), data], ["seed", "part", "first", "_doc", "_t", "start", "count", "data"])

    return with_runs(docs, entries, "more").mapInArrow(run, f"seed long, part int, first boolean, {_PLACE}, data binary")


def _shard(table: pa.Table, length: int) -> Iterator[pa.RecordBatch]:
    """Runs of strings of these entries that stand earlier in one of them; of entries dealt over
    several shards, the other strings too, each with its hash."""
    doc, tag, start, count, part = (table.column(c).to_numpy() for c in ("_doc", "_t", "start", "count", "part"))
    first_of_seed = table.column("first").to_numpy()
    data = table.column("data").combine_chunks().cast(pa.large_binary())
    offs = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    raw = np.frombuffer(data.buffers()[2], np.uint8)[offs[0] : offs[-1]]
    size = count - 1 + length
    begin = np.cumsum(size + 1) - size - 1
    t = np.ones(int((size + 1).sum()) + 1, np.int32)  # 1 between entries, 0 at the end
    t[ranges(begin, size)] = raw.astype(np.int32) + 2
    t[-1] = 0
    order = suffix_array(t)
    shared = permuted_prefixes(t, order, length)[order]
    whole = np.zeros(t.size, bool)
    whole[ranges(begin, count)] = True
    use = np.flatnonzero(whole[order])
    at = order[use].astype(np.int64)
    # Strings of the full length stand together in the order, with none but equal ones between.
    group = np.cumsum((shared[use] < length) | (np.diff(use, prepend=-1) != 1))
    of = np.searchsorted(begin, at, side="right") - 1
    place = start[of] + at - begin[of]
    by = np.lexsort((place, tag[of], doc[of], group))
    of, place, group, at = of[by], place[by], group[by], at[by]
    new = np.concatenate([[True], group[1:] != group[:-1]]) if group.size else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(new, np.arange(group.size), 0)) if group.size else group
    # Later than the group's first row, or than a place of the row itself.
    late = doc[of] > doc[of][first]
    late[1:] |= ~new[1:] & (doc[of][1:] == doc[of][:-1]) & (tag[of][1:] == tag[of][:-1]) & (place[1:] > place[:-1])
    row, begins, n = joined(of[late], place[late])
    yield pa.record_batch([pa.nulls(n.size, pa.int64()), pa.array(doc[row]), pa.array(tag[row]), pa.array(begins), pa.array(n)], ["h", "_doc", "_t", "start", "count"])
    left = np.flatnonzero(~late & (part[of] >= 0) & ~first_of_seed[of])
    if left.size:
        sums = prefix(t.astype(np.uint64) + np.uint64(0x51ED))
        h = span_hash(sums, at[left], at[left] + length).view(np.int64)
        yield pa.record_batch([pa.array(h), pa.array(doc[of[left]]), pa.array(tag[of[left]]), pa.array(place[left]), pa.array(np.ones(left.size, np.int64))], ["h", "_doc", "_t", "start", "count"])


def _sorted_shards(stretches: DataFrame, length: int) -> DataFrame:
    """(h, _doc, _t, start, count) as _shard gives them. The entries of one (seed, part) meet in a shard,
    and a shard takes those of as many as it has room for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size, last = 0, None
        for batch in batches:
            seeds, parts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero((seeds[1:] != seeds[:-1]) | (parts[1:] != parts[:-1])) + 1, [seeds.size]])
            sizes = np.concatenate([[0], np.cumsum(batch.column(6).to_numpy() + length)])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if size >= SHARD_BYTES and (seeds[a], parts[a]) != last:
                    yield from _shard(pa.concat_tables(held), length)
                    held, size = [], 0
                held.append(pa.Table.from_batches([batch.slice(a, b - a)]))
                size += int(sizes[b] - sizes[a])
                last = seeds[a], parts[a]
        if held:
            yield from _shard(pa.concat_tables(held), length)

    return stretches.repartition("seed", "part").sortWithinPartitions("seed", "part").mapInArrow(run, f"h long, {_PLACE}")


def _repeated(docs: DataFrame, entries: DataFrame, length: int) -> DataFrame:
    """Runs of the entries' strings that stand earlier in an entry of the same seed. `entries` has
    (_doc, _t, start, count, seed). Entries of one row go to one shard of their seed, so what two
    shards can have in common is strings of different rows."""
    place = F.struct("_doc", "_t", "start")
    found = None
    while True:
        crowded = written(entries.groupBy("seed").agg(F.count("*").alias("n"), F.min(place).alias("f")).where(F.col("n") > SHARD_ENTRIES), "crowded", small=True)
        many = crowded.count()
        if many:
            parts = F.ceil(F.col("n") / SHARD_ENTRIES).cast("int")
            dealt = entries.join(F.broadcast(crowded) if many <= BROADCAST_RUNS else crowded, "seed", "left").withColumn("first", F.coalesce(place == F.col("f"), F.lit(False)))
            own = F.when(F.col("n").isNull(), F.array(F.lit(-1))).when(F.col("first"), F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.pmod(F.xxhash64("_doc", "_t"), parts).cast("int")))
            dealt = dealt.withColumn("part", F.explode(own))
        else:
            dealt = entries.withColumns({"first": F.lit(False), "part": F.lit(-1)})
        told = written(_sorted_shards(_stretches(docs, dealt.withColumn("more", F.struct("seed", "part", "first")), length), length), "sorted")
        discard(crowded)
        late = told.where("h is null").select("_doc", "_t", "start", "count")
        found = late if found is None else found.unionByName(late)
        if not many:
            return found
        left = told.where("h is not null")
        again = written(left.groupBy("h").agg(F.min("_doc").alias("a"), F.max("_doc").alias("b")).where("a < b").select("h"), "again", small=True)
        n = again.count()
        if not n:
            return found
        entries = written(left.join(F.broadcast(again) if n <= BROADCAST_RUNS else again, "h").select("_doc", "_t", "start", "count", F.col("h").alias("seed")), "entries")
        discard(again)


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept) of every row, without byte strings seen before.

    A byte goes if a string of `length` bytes that covers it also starts earlier: in a row with a
    smaller id, or in the same row before. Strings are judged on the input and never cross rows.
    `kept` is the remaining bytes, n_spans the number of maximal removed runs. A null or empty text
    has no bytes. Rows that share an id remove nothing from each other, and each gives a row; a
    null id removes and loses nothing. Other columns are not read, whatever their names.
    """
    base = keyed(docs, id_col, text_col)
    found = find(base, byte_symbols, length, (min(SEED, length),), within_rows=True, name="byte-seeds")
    repeated = _repeated(found.docs, found.open.select("_doc", "_t", "start", "count", "seed"), length)
    known = drop_bytes(found.docs, found.lost.unionByName(repeated), length)
    rest = drop_bytes(base.where(F.col("_doc").isNull()), None, length)
    return known.unionByName(rest).withColumnRenamed("_doc", id_col)


def drop_bytes(docs: DataFrame, runs: DataFrame | None, length: int) -> DataFrame:
    """(_doc, n_bytes, n_removed, n_spans, kept) of every row, without the bytes that the runs cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, at = lists(batch.column(3))
            counts, _ = lists(batch.column(4))
            buf, offs = flat(batch.column(2))
            removed, spans, kept = [], [], []
            for k in range(batch.num_rows):
                text, part = buf[offs[k] : offs[k + 1]], slice(at[k], at[k + 1])
                if part.stop > part.start:
                    gone = covered(text.size, starts[part], counts[part], length)
                    removed.append(int(gone.sum()))
                    spans.append(int((gone[1:] & ~gone[:-1]).sum() + gone[0]))
                    text = text[~gone]
                else:
                    removed.append(0)
                    spans.append(0)
                kept.append(text.tobytes())
            yield pa.record_batch([batch.column(0), pa.array(np.diff(offs)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], ["_doc", "n_bytes", "n_removed", "n_spans", "kept"])

    if runs is None:
        joined = docs.select("_doc", "_t", "_text", *(F.lit(None).cast("array<long>").alias(c) for c in ("starts", "counts")))
    else:
        joined = docs.join(by_document(runs), ["_doc", "_t"], "left").select("_doc", "_t", "_text", "starts", "counts")
    return joined.mapInArrow(run, "_doc long, n_bytes long, n_removed long, n_spans long, kept binary")
