"""Sequence packing by the harmonic rule.

A document's ids (with the end id) are cut into pieces, and a piece of length n belongs to class
capacity // n: as many pieces of one class as its number fit into a sequence whatever their exact
lengths. Every task fills sequences of each class with that fixed count of pieces, alone, in one
pass and without a shuffle. Cuts are placed at the upper ends of classes (capacity // j), where a
full sequence has next to no padding. What a task has left of incomplete sequences (fewer pieces
than the sum of all class numbers, however large the task) is joined and cut at the capacity; the
last remainder goes into sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from airlock.llm.flat import ranges
from airlock.llm.tokens import default_path, encoder

CAPACITY = 2048
#: Remainders under this are not cut further.
SMALLEST_CUT = 128
END_ID = 1
#: Texts that are packed at a time: their ids are held several times over.
ROWS = 250
_SEQUENCE_BITS = 32


def cut_lengths(n: np.ndarray, capacity: int = CAPACITY, smallest: int = SMALLEST_CUT) -> tuple[np.ndarray, np.ndarray]:
    """For documents of n ids: how many pieces each is cut into, and the lengths of all pieces in order."""
    owner, lengths, order = [], [], []
    full = n // capacity
    owner.append(np.repeat(np.arange(n.size), full))
    lengths.append(np.full(int(full.sum()), capacity))
    order.append(np.zeros(int(full.sum()), np.int64))
    rest, row, turn = n % capacity, np.arange(n.size), 1
    while row.size:
        row, rest = row[rest > 0], rest[rest > 0]
        head = np.where(rest < smallest, rest, capacity // -(-capacity // np.maximum(rest, 1)))
        owner.append(row)
        lengths.append(head)
        order.append(np.full(row.size, turn))
        rest, turn = rest - head, turn + 1
    who, size, at = np.concatenate(owner), np.concatenate(lengths), np.concatenate(order)
    by = np.lexsort((at, who))
    return np.bincount(who, minlength=n.size), size[by]


class _Pieces:
    """Columns of pieces: id of the document (Arrow), start, length, the document's length, and ids."""

    def __init__(self, key: pa.Array, start: np.ndarray, length: np.ndarray, total: np.ndarray, ids: np.ndarray) -> None:
        self.key, self.start, self.length, self.total, self.ids = key, start, length, total, ids

    def take(self, which: np.ndarray) -> _Pieces:
        at = np.cumsum(self.length) - self.length
        return _Pieces(self.key.take(pa.array(which)), self.start[which], self.length[which], self.total[which], self.ids[ranges(at[which], self.length[which])])

    def plus(self, other: _Pieces) -> _Pieces:
        both = lambda name: np.concatenate([getattr(self, name), getattr(other, name)])
        return _Pieces(pa.concat_arrays([self.key, other.key]), both("start"), both("length"), both("total"), both("ids"))

    def rows(self, sequence: np.ndarray, offset: np.ndarray, names: list[str]) -> pa.RecordBatch:
        ends = np.concatenate([[0], np.cumsum(self.length)]) * 4
        raw = pa.Array.from_buffers(pa.large_binary(), self.length.size, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(self.ids.astype("<u4"))])
        return pa.record_batch([self.key, pa.array(self.start), pa.array(self.length), raw.cast(pa.binary()), pa.array(self.total), pa.array(sequence), pa.array(offset)], names)


def _offsets(length: np.ndarray, sequence: np.ndarray) -> np.ndarray:
    """Where each piece begins in its sequence; pieces of a sequence stand together."""
    ends = np.cumsum(length)
    first = np.concatenate([[True], sequence[1:] != sequence[:-1]]) if sequence.size else np.zeros(0, bool)
    base = (ends - length)[first]
    return ends - length - np.repeat(base, np.diff(np.append(np.flatnonzero(first), sequence.size)))


def _full(p: _Pieces, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces in complete sequences, by class; the number of each one's sequence; the other pieces."""
    group = capacity // p.length
    by = np.argsort(group, kind="stable")
    kinds, first, count = np.unique(group[by], return_index=True, return_counts=True)
    rank = np.arange(by.size) - np.repeat(first, count)
    whole = count // kinds
    inside = rank < np.repeat(whole * kinds, count)
    before = np.cumsum(whole) - whole
    return by[inside], (np.repeat(before, count) + rank // np.repeat(kinds, count))[inside], by[~inside]


def _recut(p: _Pieces, capacity: int) -> tuple[_Pieces, np.ndarray]:
    """The pieces joined and cut anew at the capacity, the end at powers of two; the sequence of each."""
    total = int(p.length.sum())
    sizes, rest = [capacity] * (total // capacity), total % capacity
    sizes += [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]
    ends = np.cumsum(p.length)
    marks = np.union1d(ends, np.cumsum(sizes))
    begin = np.concatenate([[0], marks[:-1]])
    of = np.searchsorted(ends, begin, side="right")
    start = p.start[of] + begin - (ends - p.length)[of]
    return _Pieces(p.key.take(pa.array(of)), start, marks - begin, p.total[of], p.ids), np.searchsorted(np.cumsum(sizes), begin, side="right")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of tokenised documents, each with its place in a training sequence.

    Returns id_col, start (ids of the document before the piece), length, ids (little-endian
    unsigned 32-bit), doc_tokens (ids of the document, end id included), sequence_id (unique over
    all tasks) and offset (pieces of a sequence follow each other from 0). Sequences hold at most
    `capacity` ids, a power of two.

    A null or empty text is one end id. Repeated rows are packed each; equal ids stay apart by
    their rows. Other columns, whatever their names, are not read. No rows give no pieces.
    """
    if capacity & (capacity - 1) or capacity < 1:
        raise ValueError("the capacity must be a power of two")
    path = tokenizer or default_path()
    names = [id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        base = TaskContext.get().partitionId() << _SEQUENCE_BITS
        used, left = 0, None
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                ids, offs = enc.encode(part.column(1))
                n = np.diff(offs) + 1
                ids = np.insert(ids, offs[1:], end_id)
                count, length = cut_lengths(n, capacity)
                ends = np.cumsum(length)
                doc_at = np.repeat(np.cumsum(n) - n, count)
                new = _Pieces(part.column(0).take(pa.array(np.repeat(np.arange(n.size), count))), ends - length - doc_at, length, np.repeat(n, count), ids)
                left = left.plus(new) if left else new
                inside, sequence, others = _full(left, capacity)
                if inside.size:
                    done = left.take(inside)
                    yield done.rows(base + used + sequence, _offsets(done.length, sequence), names)
                    used += int(sequence[-1]) + 1
                left = left.take(others)
            # Arrow would keep what earlier batches and tasks of this worker have freed.
            pa.default_memory_pool().release_unused()
        if left and left.length.size:
            done, sequence = _recut(left, capacity)
            yield done.rows(base + used + sequence, _offsets(done.length, sequence), names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return docs.select(id_col, text_col).mapInArrow(run, schema)
