"""Benchmark items found inside documents.

Every window of an item's length is compared with the items of that length. SimHash fingerprints
of the windows' word shingles meet the items' through a multi-index: two fingerprints within RADIUS
of each other differ in at most RADIUS // BLOCKS bits of some block, so probing every block with
all patterns of that many bits misses none. What is within the radius is then compared by its
shingles themselves, each weighted by how often it occurs. Windows that hold too few shingles of
any item to reach the threshold are left out before their fingerprints are made; none that could
pass is lost by that.

The fingerprints alone say which pairs are compared. A pair just at the threshold may have
fingerprints further apart than the radius; of pairs with a similarity from 0.8 to 0.85 that is
about one in 500 (RECALL, measured by a test). With `exact` such pairs are found as well: an
inverted index over the items' shingles adds every pair that has enough of them in common.

The benchmark travels to the executors in slices of bounded size, one slice at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, cached_property
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlock.llm.flat import flat, mix, pieces, powers, prefix, ranges, span_hash, word_hashes, words
from airlock.llm.store import discard, written

SHINGLE = 5
SIMILARITY = 0.8
BITS, BLOCKS = 128, 8
#: Texts with 0.8 of their shingles in common differ in 19 bits of 128 on average, with a standard
#: deviation of 4; texts that are equal in none.
RADIUS = 31
#: Share of the pairs with a similarity of 0.8 to 0.85 that lie within the radius, at least.
RECALL = 0.99
#: Characters of a slice of the benchmark, as it is sent to the executors.
SLICE_CHARS = 16_000_000
_BLOCK_BITS = BITS // BLOCKS
_MARK_BITS = 20
#: Up to so many patterns of items' blocks are laid out in a table; else windows' blocks are probed.
_SPREAD = 1 << 20

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _plain(text_col: str) -> Column:
    """The text in lower case, with spaces for signs beyond ASCII; letters keep their marks."""
    return F.regexp_replace(F.lower(text_col), r"[^\p{L}\p{M}\p{N}\x00-\x7F]", " ")


def _words_of(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words (letters and digits; other ASCII signs count as spaces), and each row's first."""
    data = np.where(_WORD[buf], buf, np.uint8(32))
    starts, ends, first = words(data, offs)
    return word_hashes(data, starts, ends), first


@cache
def _probes() -> np.ndarray:
    """All patterns of at most RADIUS // BLOCKS bits of a block."""
    most = RADIUS // BLOCKS
    return np.array([sum(1 << b for b in c) for n in range(most + 1) for c in combinations(range(_BLOCK_BITS), n)], np.int64)


def fingerprints(shingles: np.ndarray) -> np.ndarray:
    """SimHash of each row of shingle hashes, as two 64-bit halves: a bit is what most shingles have."""
    out = np.empty((len(shingles), 2), np.uint64)
    for half, salt in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
        h = shingles * np.uint64(salt)
        h ^= h >> np.uint64(29)
        votes = np.unpackbits(h.view(np.uint8).reshape(*h.shape, 8), axis=-1).sum(1, dtype=np.int32)
        out[:, half] = np.packbits(votes * 2 > shingles.shape[1], axis=-1).view(np.uint64)[:, 0]
    return out


def _blocks(prints: np.ndarray) -> np.ndarray:
    return prints.view(np.uint16).reshape(len(prints), BLOCKS).astype(np.int64)


def _numbered(rows: np.ndarray) -> np.ndarray:
    """Sorted rows in which the k-th copy of a shingle has a name of its own."""
    rows = np.sort(rows, axis=1)
    at = np.broadcast_to(np.arange(rows.shape[1]), rows.shape)
    begins = np.ones(rows.shape, bool)
    begins[:, 1:] = rows[:, 1:] != rows[:, :-1]
    copy = at - np.maximum.accumulate(np.where(begins, at, 0), axis=1)
    return np.sort(rows + copy.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), axis=1)


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of the shingles of each row of a and of b, which have equal widths."""
    both = np.sort(np.concatenate([_numbered(a), _numbered(b)], axis=1), axis=1)
    shared = (both[:, 1:] == both[:, :-1]).sum(1)
    return shared / (both.shape[1] - shared)


@dataclass
class _Length:
    """Items of one number of words: their ids, shingles and fingerprints."""

    words: int
    shingle: int
    items: list
    shingles: np.ndarray
    prints: np.ndarray

    @cached_property
    def blocks(self) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """The patterns that a window's block is probed with; and for each block values in order, with
        the item that each belongs to. With few items it is their blocks that take the patterns."""
        mine, probes, own = _blocks(self.prints), _probes(), np.zeros(1, np.int64)
        if len(self.items) * probes.size <= _SPREAD:
            probes, own = own, probes
        tables = []
        for b in range(BLOCKS):
            values = (mine[:, b, None] ^ own[None, :]).ravel().astype(np.uint16)
            by = np.argsort(values, kind="stable")
            tables.append((values[by], (by // own.size).astype(np.int32)))
        return probes, tables

    @cached_property
    def owners(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The different shingles in order, the (shingle, item) pairs, and each shingle's first pair."""
        n = len(self.items)
        known, back = np.unique(self.shingles.ravel(), return_inverse=True)
        pairs = np.unique(back * n + np.repeat(np.arange(n), self.shingles.shape[1]))
        return known, pairs % n, np.searchsorted(pairs, np.arange(known.size + 1) * n)

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of (window, item) whose fingerprints are within the radius."""
        theirs, pairs, n = _blocks(prints), [np.zeros(0, np.int64)], len(self.items)
        probes, tables = self.blocks
        for b, (values, items) in enumerate(tables):
            for k in range(0, len(prints), 4096):
                seen = (theirs[k : k + 4096, b, None] ^ probes[None, :]).ravel().astype(np.uint16)
                low = np.searchsorted(values, seen)
                hit = np.flatnonzero(values[np.minimum(low, values.size - 1)] == seen)
                low = low[hit]
                count = np.searchsorted(values, seen[hit], side="right") - low
                window = np.repeat(k + hit // probes.size, count)
                pairs.append(np.unique(window * n + items[ranges(low, count)]))
        pair = np.unique(np.concatenate(pairs))
        window, item = pair // n, pair % n
        near = np.bitwise_count(prints[window] ^ self.prints[item]).sum(1) <= RADIUS
        return window[near], item[near]

    def sharing(self, shingles: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of (window, item) with as many places in common as the threshold takes at least."""
        n, inside = len(self.items), self.shingles.shape[1]
        known, owner, first = self.owners
        at = np.minimum(np.searchsorted(known, shingles.ravel()), known.size - 1)
        hit = np.flatnonzero(known[at] == shingles.ravel())
        low = first[at[hit]]
        count = first[at[hit] + 1] - low
        pair, times = np.unique(np.repeat(hit // inside, count) * n + owner[ranges(low, count)], return_counts=True)
        enough = pair[times >= 2 * inside * threshold / (1 + threshold) - 1e-9]
        return enough // n, enough % n


@dataclass
class Index:
    lengths: list[_Length]
    known: dict[int, np.ndarray]  # of each shingle length, the items' shingle hashes in order
    marks: dict[int, np.ndarray]  # and which leading bits they have


def index_of(ids: list, texts: list[str]) -> Index:
    """An index of benchmark texts as _plain gives them; those without a word are left out."""
    symbols, first = _words_of(*flat(pa.array(texts, pa.string())))
    sums = prefix(symbols)
    n = np.diff(first)
    lengths, known = [], {}
    for m in np.unique(n[n > 0]).tolist():
        k = min(SHINGLE, m)
        rows = np.flatnonzero(n == m)
        at = first[rows][:, None] + np.arange(m - k + 1)
        shingles = span_hash(sums, at, at + k)
        lengths.append(_Length(m, k, [ids[i] for i in rows.tolist()], shingles, fingerprints(shingles)))
        known.setdefault(k, []).append(shingles.ravel())
    hashes = {k: np.unique(np.concatenate(v)) for k, v in known.items()}
    marks = {k: np.zeros(1 << _MARK_BITS, bool) for k in hashes}
    for k, h in hashes.items():
        marks[k][(h >> np.uint64(64 - _MARK_BITS)).astype(np.int64)] = True
    return Index(lengths, hashes, marks)


def search(index: Index, buf: np.ndarray, offs: np.ndarray, threshold: float, exact: bool = False) -> tuple[np.ndarray, list, np.ndarray, np.ndarray, np.ndarray]:
    """Row, item, first word, words and similarity of the best window of each row and item found."""
    symbols, first = _words_of(buf, offs)
    sums = prefix(symbols)
    out: list[tuple] = []
    flags = {}
    for k, known in index.known.items():
        n = symbols.size - k + 1
        if n <= 0:
            flags[k] = np.zeros(0, np.int64)
            continue
        h = mix((sums[k:] - sums[:-k]) * powers(symbols.size)[1][:n])
        start = np.flatnonzero(index.marks[k][(h >> np.uint64(64 - _MARK_BITS)).astype(np.int64)])
        at = np.minimum(np.searchsorted(known, h[start]), known.size - 1)
        flags[k] = start[known[at] == h[start]]  # also across rows, which no window does
    for group in index.lengths:
        inside = group.words - group.shingle + 1
        need = max(1, int(np.ceil(threshold * inside - 1e-9)))
        f = flags[group.shingle]
        if f.size < need:
            continue
        low, high = f[need - 1 :] - inside + 1, f[: f.size - need + 1]
        ok = np.flatnonzero(low <= high)
        starts = np.unique(ranges(low[ok], (high - low)[ok] + 1))
        starts = starts[(starts >= 0) & (starts + group.words <= symbols.size)]
        row = np.searchsorted(first, starts, side="right") - 1
        starts = starts[starts + group.words <= first[row + 1]]
        for k in range(0, starts.size, 2048):
            part = starts[k : k + 2048]
            at = part[:, None] + np.arange(inside)
            shingles = span_hash(sums, at, at + group.shingle)
            found = [group.candidates(fingerprints(shingles))]
            if exact:
                found.append(group.sharing(shingles, threshold))
            pair = np.unique(np.concatenate([w * len(group.items) + i for w, i in found]))
            window, item = pair // len(group.items), pair % len(group.items)
            alike = similarity(shingles[window], group.shingles[item])
            good = np.flatnonzero(alike >= threshold - 1e-12)
            rows = np.searchsorted(first, part[window[good]], side="right") - 1
            out += zip(rows.tolist(), [group.items[i] for i in item[good].tolist()], (part[window[good]] - first[rows]).tolist(), [group.words] * good.size, alike[good].tolist(), strict=True)
    best: dict[tuple, tuple] = {}
    for row, item, start, n, alike in out:
        if (row, item) not in best or (-alike, start) < best[row, item][:2]:
            best[row, item] = (-alike, start, n)
    keys = sorted(best, key=lambda x: x[0])
    return np.array([x[0] for x in keys], np.int64), [x[1] for x in keys], *(np.array([best[x][c] * s for x in keys], t) for c, s, t in ((1, 1, np.int64), (2, 1, np.int64), (0, -1, float)))


def _slices(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[tuple[int, Index]]:
    """The number of slices, and the index of one slice after the other: the driver holds one."""
    chars = benchmark.agg(F.sum(F.length(text_col))).first()[0] or 0
    slices = max(1, -(-chars // SLICE_CHARS))
    named = benchmark.where(F.col(text_col).isNotNull()).select(F.col(item_col).alias("i"), _plain(text_col).alias("t"))
    for k in range(slices):
        part = named.where(F.pmod(F.xxhash64("i", "t"), F.lit(slices)) == k).collect()
        yield slices, index_of([r.i for r in part], [r.t for r in part])


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", exact: bool = False) -> DataFrame:
    """(id_col, item, start_word, n_words, similarity): each row and benchmark item that it holds.

    Words are compared without regard to case and punctuation. Of several windows that match, the
    most alike is given, of equals the first. Items of under five words are matched whole, those
    without words match nothing. Null or empty texts hold nothing; repeated rows are reported each.
    Other columns are not read. With `exact` pairs at the threshold are found whatever their
    fingerprints (see above).
    """
    id_kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType
    schema = f"_id {id_kind}, item {item_kind.simpleString()}, start_word long, n_words long, similarity double"
    found = None
    for slices, index in _slices(benchmark, item_col, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, _, buf, offs in pieces(*flat(batch.column(1))):
                    row, item, start, n, alike = search(shared.value, buf, offs, threshold, exact)
                    if row.size:
                        yield pa.record_batch([batch.column(0).take(pa.array(row + i)), pa.array(item), pa.array(start), pa.array(n), pa.array(alike)], ["_id", "item", "start_word", "n_words", "similarity"])

        part = docs.select(F.col(id_col).alias("_id"), _plain(text_col).alias("_text")).mapInArrow(run, schema)
        if slices > 1:
            part = written(part, "leaks")
            shared.destroy()
        found = part if found is None else found.unionByName(part)
    return found.withColumnRenamed("_id", id_col)


def without_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = SIMILARITY, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", exact: bool = False) -> DataFrame:
    """The rows of docs, with all their columns, that hold no benchmark item (see find_leaks)."""
    columns, schema, before = docs.columns, docs.schema, None
    for slices, index in _slices(benchmark, item_col, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for i, _, buf, offs in pieces(*flat(batch.column(len(columns)))):
                    keep[search(shared.value, buf, offs, threshold, exact)[0] + i] = False
                yield batch.filter(pa.array(keep)).select(range(len(columns)))

        docs = docs.select("*", _plain(text_col).alias("_airlock_lower")).mapInArrow(run, schema)
        if slices > 1:
            docs = written(docs, "clean")
            shared.destroy()
            if before is not None:
                discard(before)
            before = docs
    return docs
