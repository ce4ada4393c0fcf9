"""Where windows of a fixed length repeat across a corpus, without comparing every window.

Used by the two substring operators: one counts windows in words, the other in bytes. Windows are
judged by levels of shorter windows ("seeds"). On each level a window is named by the seed inside
it that has the least hash; equal windows have equal seeds at equal places, and neighbouring windows
mostly share theirs, so windows come in short runs, one row for each run. A window can only repeat
where its seed does, so a level looks at nothing but the windows that all levels before left, and
the search ends where a level leaves none. Where all runs of a seed are the same text, the first
keeps its windows and the others lose theirs. Only the rest has to be compared window by window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlock.llm.flat import flat, mix, pieces, powers, prefix, ranges, span_hash, window_hashes, window_starts, word_hashes, words
from airlock.llm.store import discard, written

#: A run's row keeps its number of windows in the low bits of the text's hash.
_RUN_BITS = 12
#: A filter of repeated seeds has about 8 bits for each, and at most 2 ** 28 (32 MB). It only spares
#: rows a shuffle; when it is too full to tell seeds apart, the join alone decides.
_FILTER_BITS = 28
#: Runs that are broadcast to their documents; more are joined by a shuffle.
BROADCAST_RUNS = 1 << 20


@dataclass(frozen=True)
class Runs:
    """Of each run: its row, first window, number of windows, seed hash and text hash."""

    row: np.ndarray
    start: np.ndarray
    count: np.ndarray
    seed: np.ndarray
    text: np.ndarray


def word_symbols(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = words(buf, offs)
    return word_hashes(buf, starts, ends), first


def byte_symbols(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return buf.astype(np.uint64) + np.uint64(0x9E37), offs


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """At each place, where the least of the next `width` values is (the first of equal ones)."""
    # High halves of the hashes with places below them: the least of these is found without gathers.
    best, span = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(h.size, dtype=np.uint64), 1
    while span * 2 <= width:
        best, span = np.minimum(best[:-span], best[span:]), span * 2
    if span < width:
        best = np.minimum(best[: span - width], best[width - span :])
    return (best & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _windows(symbols: np.ndarray, first: np.ndarray, window: int, level: int, filters: list) -> Runs:
    """Runs of the level's seeds, of windows whose seeds of all levels before are in their filters
    (and those of this one, if it has a filter already)."""
    none = np.zeros(0, np.int64)
    start, row = window_starts(first, window)
    sums = prefix(symbols) if start.size else none
    for depth, (seed, held) in enumerate(filters):
        if not start.size:
            break
        h = (sums[seed:] - sums[:-seed]) * powers(symbols.size)[1][: symbols.size - seed + 1]
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        least = _least(h, window - seed + 1)[start]
        new = np.concatenate([[True], (least[1:] != least[:-1]) | (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)])
        i = np.flatnonzero(new)
        count = np.diff(np.append(i, start.size))
        name = h[least[i]]
        if held is not None:
            table, bits = held.value
            at = name & np.uint64((1 << bits) - 1)
            maybe = (table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
            if depth < level:
                stay = np.repeat(maybe, count)
                start, row = start[stay], row[stay]
                continue
            i, count, name = i[maybe], count[maybe], name[maybe]
        text = span_hash(sums, start[i], start[i] + count - 1 + window)
        text = mix(text + count.astype(np.uint64)) >> np.uint64(_RUN_BITS) << np.uint64(_RUN_BITS) | count.astype(np.uint64)
        return Runs(row[i], start[i] - first[row[i]], count, name.view(np.int64), text.view(np.int64))
    return Runs(none, none, none, none, none)


@dataclass(frozen=True)
class Repeats:
    """What is known of the repeats in `docs` (_doc, _t, _text) before windows are compared.

    lost: (_doc, _t, start, count) runs of windows of which each stands somewhere earlier.
    open: the same with `seed` and the number of different texts of that seed, of runs whose
    windows may stand earlier in a run of another text.
    """

    docs: DataFrame
    lost: DataFrame
    open: DataFrame


def keyed(docs: DataFrame, id_col: str, text_col: str, carry: bool = False) -> DataFrame:
    """_doc, _t (tells rows of one id apart by their texts) and _text; null counts as empty. With
    `carry` also _row, a struct of all columns."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    more = [F.struct("*").alias("_row")] if carry else []
    return docs.select(F.col(id_col).cast("long").alias("_doc"), text.alias("_text"), *more).withColumn("_t", F.hash("_text").bitwiseAND(0x7FFFFFFF))


def _filter(seeds: DataFrame) -> tuple[np.ndarray, int]:
    """A bit for each of 2 ** bits endings of a seed, set where a seed ends so. (Seeds are the least
    of many hashes: their leading bits are mostly alike.)"""
    bits = min(_FILTER_BITS, max(16, (8 * seeds.count()).bit_length()))
    at = F.col("seed").bitwiseAND((1 << bits) - 1)
    parts = seeds.select(F.shiftright(at, 6).alias("word"), F.expr("shiftleft(1L, cast(seed & 63 AS INT))").alias("bit"))
    table = parts.groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[table["word"].to_numpy()] = table["bit"].to_numpy().view(np.uint64)
    return out, bits


def find(docs: DataFrame, symbols: Callable, window: int, levels: tuple[int, ...], within_rows: bool, name: str) -> Repeats:
    """Runs that repeat in other rows, and with `within_rows` in the row itself; the levels are the
    lengths of the seeds, each longer than the one before."""
    if not levels or min(levels) < 1 or window < max(levels) or window - min(levels) >= (1 << _RUN_BITS) - 1:
        raise ValueError(f"seeds must be no longer than the window and shorter by less than {1 << _RUN_BITS}")

    def emit(filters: list, full: bool) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, tags = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
                for i, _, buf, offs in pieces(*flat(batch.column(2)), limit=1 << 19):
                    r = _windows(*symbols(buf, offs), window, len(filters) - 1, filters)
                    if not full:
                        yield pa.record_batch([pa.array(r.seed), pa.array(ids[i + r.row])], ["seed", "_doc"])
                        continue
                    loc = tags[i + r.row].astype(np.int64) << 32 | r.start
                    if within_rows:  # a later run of the same text in one row: marked by the sign
                        by = np.lexsort((r.start, r.text, r.seed, r.row))
                        same = np.zeros(by.size, bool)
                        for k in (r.row, r.seed, r.text):
                            same[1:] |= k[by][1:] != k[by][:-1]
                        again = by[1:][~same[1:]]
                        loc[again] |= np.int64(-(1 << 63))
                    yield pa.record_batch([pa.array(r.seed), pa.array(r.text), pa.array(ids[i + r.row]), pa.array(loc)], ["seed", "text", "_doc", "loc"])

        return run

    slim = docs.where(F.col("_doc").isNotNull()).select("_doc", "_t", "_text")
    filters, seeds = [], None
    for level in levels:
        found = slim.mapInArrow(emit([*filters, (level, None)], False), "seed long, _doc long").groupBy("seed")
        if within_rows:
            found = found.agg(F.count("*").alias("n")).where("n > 1")
        else:
            found = found.agg(F.min("_doc").alias("a"), F.max("_doc").alias("b")).where("a < b")
        if seeds is not None:
            discard(seeds)
        seeds = written(found.select("seed"), f"{name}-repeated")
        if seeds.isEmpty():  # no candidate survives
            discard(seeds)
            none = docs.sparkSession.createDataFrame([], "_doc long, _t int, start long, count long, seed long, n_texts long")
            return Repeats(slim, none.select("_doc", "_t", "start", "count"), none)
        filters.append((level, docs.sparkSession.sparkContext.broadcast(_filter(seeds))))
    rows = slim.mapInArrow(emit(filters, True), "seed long, text long, _doc long, loc long")
    hit = written(rows.join(seeds, "seed"), name)
    discard(seeds)
    for _, held in filters:
        held.unpersist()
    texts = hit.groupBy("seed", "text").agg(F.min("_doc").alias("first"))
    several = texts.groupBy("seed").agg(F.count("*").alias("n_texts"))
    told = hit.join(texts.join(several, "seed"), ["seed", "text"])
    place = [F.col("_doc"), F.shiftrightunsigned("loc", 32).bitwiseAND(0x7FFFFFFF).cast("int").alias("_t"), F.col("loc").bitwiseAND(0xFFFFFFFF).alias("start"), F.col("text").bitwiseAND((1 << _RUN_BITS) - 1).alias("count")]
    late = ((F.col("_doc") > F.col("first")) | (F.col("loc") < 0)).alias("late")
    told = written(told.select("seed", "n_texts", late, *place).where("late or n_texts > 1"), f"{name}-told")
    discard(hit)
    return Repeats(slim, told.where("late").select("_doc", "_t", "start", "count"), told.where("not late").drop("late"))


def with_runs(docs: DataFrame, runs: DataFrame, more: str = "seed") -> DataFrame:
    """_doc, _t, _text of the documents that have runs, with the runs' starts, counts and one more column."""
    grouped = runs.groupBy("_doc", "_t").agg(F.collect_set(F.struct("start", "count", more)).alias("r"))
    named = grouped.select("_doc", "_t", F.col("r.start").alias("starts"), F.col("r.count").alias("counts"), F.col(f"r.{more}").alias("more"))
    small = runs.count() <= BROADCAST_RUNS
    return docs.join(F.broadcast(named) if small else named, ["_doc", "_t"]).select("_doc", "_t", "_text", "starts", "counts", "more")


def joined(row: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in rows as runs of neighbours: row, start and count."""
    by = np.lexsort((place, row))
    row, place = row[by], place[by]
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (place[1:] > place[:-1] + 1)])) if row.size else row
    return row[new], place[new], place[np.append(new[1:], place.size) - 1] - place[new] + 1 if row.size else place


def _window_arrays(docs: DataFrame, runs: DataFrame, symbols: Callable, window: int) -> DataFrame:
    """Each run with two hashes of every one of its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, at = lists(batch.column(3))
            counts, _ = lists(batch.column(4))
            seeds, _ = lists(batch.column(5))
            for i, j, buf, offs in pieces(*flat(batch.column(2)), limit=1 << 19):
                values, first = symbols(buf, offs)
                part = slice(at[i], at[j])
                owner = np.repeat(np.arange(j - i), np.diff(at[i : j + 1]))
                a, b = window_hashes(values, ranges(first[owner] + starts[part], counts[part]), window)
                ends = pa.array(np.concatenate([[0], np.cumsum(counts[part])]).astype(np.int32))
                pick = pa.array(owner + i)
                h, g = (pa.ListArray.from_arrays(ends, pa.array(x.view(np.int64))) for x in (a, b))
                yield pa.record_batch([pa.array(seeds[part]), batch.column(0).take(pick), batch.column(1).take(pick), pa.array(starts[part]), h, g], ["seed", "_doc", "_t", "start", "h", "g"])

    return with_runs(docs, runs).mapInArrow(run, "seed long, _doc long, _t int, start long, h array<long>, g array<long>")


def late_windows(docs: DataFrame, runs: DataFrame, symbols: Callable, window: int, name: str) -> DataFrame:
    """Of the runs' windows, those that a document with a smaller id has.

    All runs of a seed are compared with its first one, which settles what they have in common
    with it; equal windows have equal seeds, so what is left only has to be compared with what is
    left, by 128-bit hash.
    """
    rows = written(_window_arrays(docs, runs, symbols, window), f"{name}-windows")
    firsts = rows.groupBy("seed").agg(F.min(F.struct("_doc", "_t", "start", "h", "g")).alias("f"))
    firsts = firsts.select("seed", *(F.col(f"f.{c}").alias(f"f{c}") for c in ("_doc", "_t", "start", "h", "g")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, tag, start, f_doc = (batch.column(c).to_numpy() for c in ("_doc", "_t", "start", "f_doc"))
            (h, at), (g, _), (fh, f_at), (fg, _) = (lists(batch.column(c)) for c in ("h", "g", "fh", "fg"))
            row = np.repeat(np.arange(batch.num_rows), np.diff(at))
            f_row = np.repeat(np.arange(batch.num_rows), np.diff(f_at))
            place = start[row] + np.arange(h.size) - at[row]
            # A window is its first run's, if a window of that run sorts right before it.
            r, x, y = np.concatenate([f_row, row]), np.concatenate([fh, h]), np.concatenate([fg, g])
            mine = np.repeat([False, True], [fh.size, h.size])
            by = np.lexsort((mine, y, x, r))
            new = np.ones(by.size, bool)
            new[1:] = (r[by][1:] != r[by][:-1]) | (x[by][1:] != x[by][:-1]) | (y[by][1:] != y[by][:-1])
            shared = np.empty(by.size, bool)
            shared[by] = ~mine[by][np.maximum.accumulate(np.where(new, np.arange(by.size), 0))]
            shared = shared[fh.size :]
            # Late windows that follow each other are one row; their hashes no longer matter.
            late = np.flatnonzero(shared & (doc > f_doc)[row])
            of, begin, n = joined(row[late], place[late])
            yield pa.record_batch([pa.array(np.full(n.size, True)), pa.array(n), pa.array(n), pa.array(doc[of]), pa.array(tag[of]), pa.array(begin)], ["late", "h", "g", "_doc", "_t", "start"])
            w = np.flatnonzero(~shared)
            yield pa.record_batch([pa.array(np.full(w.size, False)), pa.array(h[w]), pa.array(g[w]), pa.array(doc[row[w]]), pa.array(tag[row[w]]), pa.array(place[w])], ["late", "h", "g", "_doc", "_t", "start"])

    told = written(rows.join(firsts, "seed").mapInArrow(compare, "late boolean, h long, g long, _doc long, _t int, start long"), f"{name}-compared")
    discard(rows)
    windows = told.where("not late").drop("late")
    least = windows.groupBy("h", "g").agg(F.min("_doc").alias("first"), F.max("_doc").alias("last")).where("first < last")
    least = written(least.select("h", "g", "first"), f"{name}-least", small=True)
    small = least.count() <= BROADCAST_RUNS
    rest = windows.join(F.broadcast(least) if small else least, ["h", "g"]).where("_doc > first")
    late = told.where("late").select("_doc", "_t", "start", F.col("h").alias("count"))
    return late.unionByName(rest.select("_doc", "_t", "start", F.lit(1).cast("long").alias("count")))


def by_document(runs: DataFrame) -> DataFrame:
    """Runs of windows as two lists for each document: their starts and counts, in the same order."""
    pairs = runs.groupBy("_doc", "_t").agg(F.collect_set(F.struct("start", "count")).alias("r"))
    return pairs.select("_doc", "_t", F.col("r.start").alias("starts"), F.col("r.count").alias("counts"))


def covered(n: int, starts: np.ndarray, counts: np.ndarray, window: int) -> np.ndarray:
    """Which of n symbols some window of the runs covers."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + counts - 1 + window, -1)
    return np.cumsum(change[:n]) > 0


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column; null counts as empty."""
    sizes = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])
