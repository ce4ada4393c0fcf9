"""Similarity join of documents by their word n-grams, and the components of its links.

Two sets can only be similar if their sizes are close and if they share one of their few first
shingles in a common order (rare ones first). Tiles are therefore pairs of neighbouring size bands
that share such a shingle. Inside a tile a pair is dropped if its bitmaps say so: every shingle
flips one bit, so the number of bits in which two bitmaps differ is at most the number of shingles
that are in one set alone, which bounds the overlap from above. What is left is compared exactly,
by the sorted arrays of shingles.

Equal sets are one node. Every tile first links its sets to its least one; pairs that are not in
one component after that are compared in a second step. These links give the components. The number
of links counts all similar pairs: those inside a component of the first step are compared in blocks
of bounded size, each pair in one block, by multiplying the incidence matrices of their shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airlock.llm.flat import flat, lowered, mix, pieces, prefix, ranges, span_hash, word_hashes, words
from airlock.llm.store import discard, written

#: Bits of the smallest bitmap; larger sets get at least as many bits as they have shingles.
BITMAP_BITS = 1024
_FOLDED = 4
#: Shingles are counted in slots to tell frequent from rare ones; only the order in which shingles
#: are looked at depends on it. There are as many slots as keep a slot's share of all shingles near
#: SLOT_SHINGLES, within these powers of two. What a slot holds beyond its share tells a shingle of
#: more documents than SLOT_NOISE times the share's square root.
SLOT_SHINGLES, SLOT_BITS, SLOT_PART, SLOT_NOISE = 32, (16, 22), 1 << 12, 4
#: Ids that are broadcast to pick documents out; more are joined by a shuffle.
BROADCAST_IDS = 1 << 20
#: Bytes of bitmaps that are broadcast to the pairs they belong to; more are joined by a shuffle.
BROADCAST_BYTES = 16 << 20
#: Sets of a tile that meet in one group; a larger tile is dealt into blocks, and every two of them meet.
TILE_SETS = 4096
#: Sets and shingles of a block of a component, about: two blocks at a time are compared by one group.
BLOCK_SETS, BLOCK_SHINGLES = 1024, 1 << 19


def shingle_sets(buf: np.ndarray, offs: np.ndarray, n: int, fold_case: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The different shingles of each row, in order, as 64-bit hashes, and the offsets of the rows.
    A row of fewer than n words has its whole sequence as one shingle."""
    data = lowered(buf) if fold_case else buf
    starts, ends, first = words(data, offs)
    sums = prefix(word_hashes(data, starts, ends))
    count = np.diff(first)
    number = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    row = np.repeat(np.arange(count.size), number)
    at = ranges(first[:-1], number)
    size = np.minimum(n, count)[row]
    h = mix(span_hash(sums, at, at + size) + size.astype(np.uint64))
    by = np.lexsort((h, row))
    h, row = h[by], row[by]
    keep = np.ones(h.size, bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[keep], row[keep]
    return h, np.searchsorted(row, np.arange(count.size + 1))


def _bitmaps(h: np.ndarray, edges: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The parity bitmap of each row's shingles as 64-bit words, and the same folded to _FOLDED words.
    A bitmap of twice the words folds to the smaller one by combining its halves."""
    size = np.diff(edges)
    width = np.maximum(BITMAP_BITS, 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
    count = width // 64
    at = np.cumsum(width) - width
    flips = np.repeat(at, size) + (h & (np.repeat(width, size) - 1).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(flips, minlength=int(width.sum())) & 1).astype(np.uint8)
    words_of = np.packbits(odd, bitorder="little").view(np.int64)
    first = np.cumsum(count) - count
    maps = pa.ListArray.from_arrays(pa.array(np.append(first, words_of.size).astype(np.int32)), pa.array(words_of))
    short = np.stack([np.bitwise_xor.reduceat(words_of[k::_FOLDED], first // _FOLDED) for k in range(_FOLDED)]) if size.size else np.zeros((_FOLDED, 0), np.int64)
    return maps, short


def _difference(p: str, q: str) -> Column:
    """In how many bits two bitmaps differ, the larger one folded to the size of the smaller."""
    n = F.least(F.size(p), F.size(q))
    fit = lambda x: F.when(F.size(x) > n, F.zip_with(F.slice(x, 1, n), F.slice(x, n + 1, n), lambda s, t: s.bitwiseXOR(t))).otherwise(F.col(x))
    return F.aggregate(F.zip_with(fit(p), fit(q), lambda s, t: F.bit_count(s.bitwiseXOR(t))), F.lit(0), lambda s, v: s + v)


def _sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[edges[1:]] - total[edges[:-1]]


def _batches(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Pieces of batches with their rows' shingle sets; the text is the last column."""
    for batch in batches:
        for i, j, buf, offs in pieces(*flat(batch.column(batch.num_columns - 1)), limit=1 << 19):
            yield batch.slice(i, j - i), *shingle_sets(buf, offs, n)


def _names(h: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """64 bits that equal sets share."""
    return mix(_sums(mix(h.copy()), edges) + np.diff(edges).astype(np.uint64)).view(np.int64)


def _common(h: np.ndarray, edges: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """How many shingles each of the sets p shares with each of the sets q; edges are the sets' offsets in h."""
    row = np.repeat(np.arange(edges.size - 1), np.diff(edges))
    _, at, count = np.unique(h, return_inverse=True, return_counts=True)
    column = np.where(count > 1, np.cumsum(count > 1) - 1, -1)[at]
    by = np.argsort(column, kind="stable")
    row, column = row[by], column[by]
    out, wide = np.zeros((p.size, q.size), np.int64), max(1, (1 << 21) // max(edges.size, 1))
    for c in range(0, int(column[-1]) + 1 if column.size else 0, wide):
        i, j = np.searchsorted(column, (c, c + wide))
        has = np.zeros((edges.size - 1, min(wide, int(column[-1]) + 1 - c)), np.float32)
        has[row[i:j], column[i:j] - c] = 1
        out += (has[p] @ has[q].T).astype(np.int64)
    return out


def _by_node(linked: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Nodes of the rows with their numbers of partners among the columns' nodes, and the other way
    round; a node may have several sets."""
    (rows, row), (columns, column) = np.unique(p, return_inverse=True), np.unique(q, return_inverse=True)
    if rows.size < p.size or columns.size < q.size:
        s, t = np.nonzero(linked)
        linked = np.zeros((rows.size, columns.size), bool)
        linked[row[s], column[t]] = True
    else:
        linked = linked[np.ix_(np.argsort(p), np.argsort(q))]
    return (rows, linked.sum(axis=1).astype(np.int64)), (columns, linked.sum(axis=0).astype(np.int64))


class NgramJoin:
    """Similarity join of `docs` on sets of `n` consecutive words, in whole numbers: two sets link
    if 100 * intersection >= percent * union."""

    def __init__(self, docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> None:
        self.spark: SparkSession = docs.sparkSession
        self.n, self.percent, self.id_col = n, percent, id_col
        self.source, self.text_col = docs, text_col
        self.docs = docs.select(F.col(id_col).cast("long").alias("_doc"), F.col(text_col).alias("_text"))

    def sets(self) -> DataFrame:
        """(_doc, t, size, a, b, bitmap, m0...) of every row; a and b are the same for equal sets alone,
        t is a hash of the text, m0... the folded bitmap."""
        n, folded = self.n, [f"m{k}" for k in range(_FOLDED)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, h, edges in _batches(batches, n):
                size = np.diff(edges)
                second = mix(_sums(mix(h ^ np.uint64(0xA0761D6478BD642F)), edges)).view(np.int64)
                maps, short = _bitmaps(h, edges)
                yield pa.record_batch([part.column(0), part.column(1), pa.array(size), pa.array(_names(h, edges)), pa.array(second), maps, *map(pa.array, short)], ["_doc", "t", "size", "a", "b", "bitmap", *folded])

        tagged = self.docs.select("_doc", F.xxhash64("_text").alias("t"), "_text")
        return tagged.mapInArrow(run, "_doc long, t long, size long, a long, b long, bitmap array<long>, " + ", ".join(f"{m} long" for m in folded))

    def _slot_levels(self, total: int) -> tuple[np.ndarray, int]:
        """How many doublings above what slots differ by at random each slot of shingles is, and the
        slots' bits; `total` is the number of all shingles. Tasks send their counts as arrays of
        SLOT_PART slots in as few bytes as hold them."""
        n, bits = self.n, min(SLOT_BITS[1], max(SLOT_BITS[0], (total // SLOT_SHINGLES).bit_length()))
        mean, part = max(total / (1 << bits), 1), min(SLOT_PART, 1 << bits)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count = np.zeros(1 << bits, np.uint32)
            for _, h, _ in _batches(batches, n):
                at, times = np.unique((h >> np.uint64(64 - bits)).astype(np.int32), return_counts=True)
                count[at] += times.astype(np.uint32)
            for k, some in enumerate(count.reshape(-1, part)):
                if some.any():
                    yield pa.record_batch([pa.array([k], pa.int32()), pa.array([some.astype(np.min_scalar_type(int(some.max()))).tobytes()], pa.binary())], ["part", "counts"])

        def levels(group: pa.Table) -> pa.Table:
            parts = [np.frombuffer(x.as_buffer(), f"<u{len(x.as_buffer()) // part}") for x in group.column("counts")]
            above = np.sum(parts, axis=0, dtype=np.int64) - mean
            level = np.floor(np.log2(np.maximum(above / SLOT_NOISE / math.sqrt(mean), 0.5))) + 1
            return pa.table([group.column("part").slice(0, 1), pa.array([level.astype(np.uint8).tobytes()], pa.binary())], ["part", "levels"])

        counted = self.docs.mapInArrow(run, "part int, counts binary").groupBy("part").applyInArrow(levels, "part int, levels binary").toArrow()  # a byte for each slot
        out = np.zeros(1 << bits, np.uint8)
        for k, found in zip(counted["part"].to_pylist(), counted["levels"].to_pylist(), strict=True):
            out[k * part : (k + 1) * part] = np.frombuffer(found, np.uint8)
        return out, bits

    def _postings(self, total: int) -> DataFrame:
        """(token, a, at): the first shingles of each set, of which similar sets share one; `at` is
        the set's size in the high half and the shingle's place, from 1, in the low half."""
        n, percent = self.n, self.percent
        levels, bits = self._slot_levels(total)
        shared = self.spark.sparkContext.broadcast(levels)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, h, edges in _batches(batches, n):
                size = np.diff(edges)
                row = np.repeat(np.arange(size.size), size)
                level = shared.value[(h >> np.uint64(64 - bits)).astype(np.int64)]
                by = np.lexsort((mix(h.copy()), level, row))
                first = np.where(size > 0, size - -(-size * percent // 100) + 1, 0)
                pick = by[ranges(edges[:-1], first)]
                owner = np.repeat(np.arange(size.size), first)
                place = ranges(np.ones(size.size, np.int64), first)
                yield pa.record_batch([pa.array(h[pick].view(np.int64)), pa.array(_names(h, edges)[owner]), pa.array(size[owner].astype(np.int64) << 32 | place)], ["token", "a", "at"])

        return self.docs.where(F.col("_doc").isNotNull()).mapInArrow(run, "token long, a long, at long")

    def _arrays(self, nodes: DataFrame, name: str) -> DataFrame:
        """(node, shingles) of the documents that stand for the nodes."""
        n = self.n
        few = nodes.count() <= BROADCAST_IDS
        chosen = self.docs.join(F.broadcast(nodes) if few else nodes, F.col("_doc") == F.col("node"), "left_semi")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, h, edges in _batches(batches, n):
                raw = pa.Array.from_buffers(pa.large_binary(), edges.size - 1, [None, pa.py_buffer((edges * 8).astype(np.int64)), pa.py_buffer(h)]).cast(pa.binary())
                yield pa.record_batch([part.column(0), pa.array(_names(h, edges)), raw], ["node", "a", "shingles"])

        return written(chosen.mapInArrow(run, "node long, a long, shingles binary"), name)

    def _possible(self, pairs: DataFrame, maps: DataFrame, name: str) -> DataFrame:
        """The pairs (x, y) whose sizes and bitmaps allow a link."""
        pairs = written(pairs, f"{name}-met")
        ends = pairs.select(F.col("x").alias("node")).union(pairs.select("y")).distinct()
        used = written(maps.join(ends, "node", "left_semi").select("node", "size", "bitmap"), f"{name}-bitmaps")
        small = (used.agg(F.sum(F.size("bitmap"))).first()[0] or 0) * 8 <= BROADCAST_BYTES
        left, right = (used.select(F.col("node").alias(n), F.col("bitmap").alias(b), F.col("size").alias(s)) for n, b, s in (("x", "p", "s"), ("y", "q", "t")))
        if small:
            left, right = F.broadcast(left), F.broadcast(right)
        both = pairs.join(left, "x").join(right, "y").where(self._similar_size("s", "t"))
        found = written(both.where(self._few_differences("s", "t", _difference("p", "q"))).select("x", "y").distinct(), name)
        discard(pairs)
        discard(used)
        return found

    def _linked(self, pairs: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
        """The pairs (x, y) whose sets are similar, by their arrays."""
        percent = self.percent
        ends = pairs.select(F.col("x").alias("node")).union(pairs.select("y")).distinct()
        made = self._arrays(ends, f"{name}-arrays")
        arrays = made.join(nodes.select("node", "a"), ["node", "a"], "left_semi")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.zeros(batch.num_rows, bool)
                for i, (p, q) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                    s, t = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                    both = np.concatenate([s, t])
                    both.sort()
                    common = int((both[1:] == both[:-1]).sum())
                    keep[i] = 100 * common >= percent * (both.size - common)
                yield batch.filter(pa.array(keep)).select([0, 1])

        left = arrays.select(F.col("node").alias("x"), F.col("shingles").alias("p"))
        right = arrays.select(F.col("node").alias("y"), F.col("shingles").alias("q"))
        found = written(pairs.join(left, "x").join(right, "y").select("x", "y", "p", "q").mapInArrow(run, "x long, y long").distinct(), name)
        discard(made)
        return found

    def _linked_within(self, label: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
        """(node, n): to how many others of its label a node is similar, for each two blocks of a label's
        nodes that meet, of labels with three nodes or more. Pairs are counted where they meet, and
        never written: a label gives as many rows as nodes times blocks."""
        percent = self.percent
        members = label.join(nodes.groupBy("node").agg(F.sum("size").alias("size")), "node")
        large = members.groupBy("label").agg(F.count("*").alias("k"), F.sum("size").alias("size")).where("k > 2")
        blocks = F.ceil(F.greatest(F.col("k") / BLOCK_SETS, F.col("size") / BLOCK_SHINGLES)).cast("int")
        large = written(large.select("label", blocks.alias("blocks")), f"{name}-labels", small=True)
        placed = label.join(F.broadcast(large) if large.count() <= BROADCAST_IDS else large, "label")
        placed = written(placed.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")), f"{name}-placed", small=True)
        made = self._arrays(placed.select("node"), f"{name}-arrays")
        arrays = made.join(nodes.select("node", "a"), ["node", "a"], "left_semi")
        if not made.groupBy("node", "a").count().where("count > 1").isEmpty():
            arrays = arrays.dropDuplicates(["node", "a"])
        few = placed.count() <= BROADCAST_IDS
        spread = arrays.join(F.broadcast(placed) if few else placed, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        spread = spread.select("label", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "shingles")

        def run(group: pa.Table) -> pa.Table:
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("shingles")]
            h, edges = np.concatenate(sets), np.cumsum([0, *map(len, sets)])
            node, block = (group.column(c).to_numpy() for c in ("node", "block"))
            i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
            p, q = np.flatnonzero(block == i), np.flatnonzero(block == j)
            common, size = _common(h, edges, p, q), np.diff(edges)
            linked = 100 * common >= percent * (size[p][:, None] + size[q][None, :] - common)
            linked &= node[p][:, None] != node[q][None, :]
            left, right = _by_node(linked, node[p], node[q])
            if i == j:
                return pa.table([pa.array(left[0]), pa.array(left[1])], ["node", "n"])
            return pa.table([pa.array(np.concatenate([left[0], right[0]])), pa.array(np.concatenate([left[1], right[1]]))], ["node", "n"])

        found = written(spread.groupBy("label", "i", "j").applyInArrow(run, "node long, n long").where("n > 0"), name)
        for done in (made, placed, large):
            discard(done)
        return found

    def _similar_size(self, s: str, t: str) -> Column:
        small, large = F.least(s, t), F.greatest(s, t)
        return small * 100 >= large * self.percent

    def _early_enough(self, p: str, q: str) -> Column:
        """If a shingle is the first that two sets share, so many come after it that they can be similar."""
        s, t = F.col(f"{p}.size"), F.col(f"{q}.size")
        after = F.least(s - F.col(f"{p}.place"), t - F.col(f"{q}.place"))
        return (100 + self.percent) * (after + 1) >= self.percent * (s + t)

    def _few_differences(self, s: str, t: str, differ: Column) -> Column:
        # 100 * i >= p * u with i = (s + t - d) / 2 and u = (s + t + d) / 2
        return (100 + self.percent) * differ <= (100 - self.percent) * (F.col(s) + F.col(t))

    def components(self) -> DataFrame:
        """(id_col, n_shingles, n_links, component_id) of every row.

        component_id is the least id that links reach, through any number of rows; n_links counts
        all other sets that the row's set is similar to, copies of one set as one. Rows
        without words have no shingles and stand alone, also among themselves; copies with at least
        one shingle are linked. A null id takes no part, and has itself as its component. Rows that
        share an id are one document: what one of them links to, all do.
        """
        return self._components(count_links=True).drop("t").withColumnRenamed("_doc", self.id_col)

    def first_of_each(self) -> DataFrame:
        """The source's rows with all their columns, without those that links connect to a smaller
        id; of rows with equal id and text one stays."""
        t = F.xxhash64(self.text_col)
        source = self.source.withColumns({"_airlock_doc": F.col(self.id_col).cast("long"), "_airlock_t": t})
        found = written(self._components(), "components")
        gone = found.where("_doc <> component_id").select(F.col("_doc").alias("_airlock_doc"), F.col("t").alias("_airlock_t")).distinct()
        few = gone.count() <= BROADCAST_IDS
        kept = source.join(F.broadcast(gone) if few else gone, ["_airlock_doc", "_airlock_t"], "left_anti")
        if not found.where(F.col("_doc").isNotNull()).groupBy("_doc", "t").count().where("count > 1").isEmpty():
            kept = kept.dropDuplicates(["_airlock_doc", "_airlock_t"])
        return kept.select(*self.source.columns)

    def _components(self, count_links: bool = False) -> DataFrame:
        sets = written(self.sets(), "sets")
        nodes = written(sets.where((F.col("size") > 0) & F.col("_doc").isNotNull()).groupBy("a", "b").agg(F.min("_doc").alias("node"), F.min("size").alias("size")), "nodes")
        stars, rest, star_label = self._links(sets, nodes)
        label = least_reachable(stars.unionByName(rest).unionByName(self._of_one_id(sets, nodes)), "component")
        known = nodes.select("a", "b", "node").join(label, "node", "left")
        if count_links:
            # Of a label with two nodes the star's link is the only one.
            pairs = star_label.groupBy("label").count().where("count = 2").select(F.col("label").alias("x"))
            links = rest.unionByName(stars.join(pairs, "x", "left_semi"))
            ends = links.select(F.col("x").alias("node")).union(links.select("y")).withColumn("n", F.lit(1).cast("long"))
            degree = ends.unionByName(self._linked_within(star_label, nodes, "links")).groupBy("node").agg(F.sum("n").alias("n_links"))
            known = known.join(degree, "node", "left")
        else:
            known = known.withColumn("n_links", F.lit(None).cast("long"))
        per_set = known.select("a", "b", F.coalesce("label", "node").alias("component_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
        keyed = sets.select("_doc", "t", F.col("size").alias("n_shingles"), *(F.when((F.col("size") > 0) & F.col("_doc").isNotNull(), F.col(c)).alias(c) for c in ("a", "b")))
        lone, rest = keyed.where(F.col("a").isNull()), keyed.where(F.col("a").isNotNull())
        found = rest.join(per_set, ["a", "b"]).select("_doc", "t", "n_shingles", "n_links", "component_id")
        alone = lone.select("_doc", "t", "n_shingles", F.lit(0).cast("long").alias("n_links"), F.col("_doc").alias("component_id"))
        return found.unionByName(alone)

    def _of_one_id(self, sets: DataFrame, nodes: DataFrame) -> DataFrame:
        """Pairs (x, y) of nodes that rows of one id stand for; few, unless ids repeat."""
        known = sets.where((F.col("size") > 0) & F.col("_doc").isNotNull()).select("_doc", "a", "b")
        several = known.groupBy("_doc").agg(F.min("a").alias("least"), F.max("a").alias("most")).where("least < most").select("_doc")
        held = known.join(several, "_doc", "left_semi").join(nodes.select("a", "b", "node"), ["a", "b"]).select("_doc", "node").distinct()
        first = held.groupBy("_doc").agg(F.min("node").alias("x"))
        return written(held.join(first, "_doc").where("x < node").select("x", F.col("node").alias("y")).distinct(), "one-id", small=True)

    def _links(self, sets: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Links (x, y) of tiles' sets to their least ones, all links between the components of these,
        and these components as (node, label)."""
        postings = self._postings(int(sets.agg(F.sum("size")).first()[0] or 0))
        # A set is in the tile of its own size band and in that of the next: sets of similar size meet.
        # Only tiles that hold two different sets are kept; bands of a token say which, so each posting moves once.
        step = -math.log(self.percent / 100)
        found = postings.repartition("token").distinct()
        found = found.select("token", "a", F.shiftright("at", 32).alias("size"), F.col("at").bitwiseAND(0xFFFFFFFF).alias("place"))
        found = found.withColumn("band", F.floor(F.log("size") / F.lit(step)))
        bands = Window.partitionBy("token").orderBy("band")

        def rows_in(first: int, last: int) -> Column:
            over = bands.rangeBetween(first, last)
            return F.when(F.min("a").over(over) < F.max("a").over(over), F.count("*").over(over).cast("int"))

        found = found.withColumns({"own": rows_in(-1, 0), "next": rows_in(0, 1)}).where("own is not null or next is not null")
        folded = [f"m{k}" for k in range(_FOLDED)]
        maps = sets.join(nodes.select(F.col("node").alias("_doc"), "a", "b"), ["_doc", "a", "b"], "left_semi").select(F.col("_doc").alias("node"), "a", "size", "bitmap", *folded)
        maps = written(maps.dropDuplicates(["node", "a"]), "bitmaps")
        columns = ["node", "size", "place", *folded]
        stored = written(found.join(maps.select("node", "a", *folded), "a").select("token", "band", "own", "next", *columns), "tiles")
        held = lambda rows, tile: F.when(F.col(rows).isNotNull(), F.struct(tile.alias("tile"), F.col(rows).alias("rows")))
        both = F.array_compact(F.array(held("own", F.col("band")), held("next", F.col("band") + 1)))
        tiles = stored.select("token", F.explode(both).alias("t"), *columns).select("token", "t.tile", "t.rows", *columns)

        together = Window.partitionBy("token", "tile")
        firsts = tiles.withColumn("f", F.min(F.struct("node", "size", *folded)).over(together))
        differ = sum((F.bit_count(F.col(m).bitwiseXOR(F.col(f"f.{m}"))) for m in folded[1:]), F.bit_count(F.col("m0").bitwiseXOR(F.col("f.m0"))))
        fits = (F.col("f.node") < F.col("node")) & self._similar_size("size", "f.size") & self._few_differences("size", "f.size", differ)
        stars = firsts.where(fits).select(F.col("f.node").alias("x"), F.col("node").alias("y")).distinct()
        tried = self._possible(stars, maps, "stars")
        links = self._linked(tried, nodes, "star-links")

        label = least_reachable(links, "star-component")
        named = tiles.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
        none_large = stored.where(F.greatest("own", "next") > TILE_SETS).isEmpty()
        open_tiles = lambda df: df.withColumns({"l": F.min("label").over(together), "m": F.max("label").over(together)}).where("l < m").drop("l", "m")
        # Both sides of a small tile are one exchange; a large one is dealt into blocks.
        small = open_tiles(named if none_large else named.where(F.col("rows") <= TILE_SETS)).drop("rows")
        rest = self._met(small.alias("p"), small.alias("q"), F.col("p.node") < F.col("q.node"), ["token", "tile"])
        if not none_large:
            blocks = open_tiles(named.where(F.col("rows") > TILE_SETS)).withColumn("blocks", F.ceil(F.col("rows") / TILE_SETS).cast("int"))
            large = written(blocks.drop("rows").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")), "open-tiles")
            p = large.withColumn("i", F.col("block")).withColumn("j", F.explode(F.sequence("block", F.col("blocks") - 1))).alias("p")
            q = large.withColumn("j", F.col("block")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("block")))).alias("q")
            once = (F.col("p.i") < F.col("p.j")) | (F.col("p.node") < F.col("q.node"))
            rest = rest.unionByName(self._met(p, q, once, ["token", "tile", "i", "j"]))
        rest = rest.distinct()
        rest = self._possible(rest.join(tried, ["x", "y"], "left_anti"), maps, "rest")
        for done in (stored, maps, tried) if none_large else (large, stored, maps, tried):
            discard(done)
        return links, rest if rest.isEmpty() else self._linked(rest, nodes, "rest-links"), label

    def _met(self, p: DataFrame, q: DataFrame, once: Column, keys: list[str]) -> DataFrame:
        """Pairs (x, y) of sets p and q that share the keys and have different labels, as far as sizes,
        places and folded bitmaps allow a link."""
        differ = sum((F.bit_count(F.col(f"p.m{k}").bitwiseXOR(F.col(f"q.m{k}"))) for k in range(1, _FOLDED)), F.bit_count(F.col("p.m0").bitwiseXOR(F.col("q.m0"))))
        together = [F.col(f"p.{k}") == F.col(f"q.{k}") for k in keys]
        fits = once & (F.col("p.label") != F.col("q.label")) & self._early_enough("p", "q") & self._similar_size("p.size", "q.size") & self._few_differences("p.size", "q.size", differ)
        return p.join(q, [*together, fits]).select(F.least("p.node", "q.node").alias("x"), F.greatest("p.node", "q.node").alias("y"))


def least_reachable(links: DataFrame, name: str) -> DataFrame:
    """(node, label) of every node in the links (x, y): the least node that it is connected to.

    Labels pass to neighbours and then on to the nodes that they name, which halves distances;
    each round is written, and the rounds end when no label changes.
    """
    both = links.select(F.col("x").alias("node"), F.col("y").alias("other")).unionByName(links.select(F.col("y").alias("node"), F.col("x").alias("other")))
    both = written(both.distinct(), f"{name}-edges", small=True)
    label = written(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")), name, small=True)
    while True:
        heard = both.join(label.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("heard"))
        new = label.join(heard, "node").select("node", F.least("label", "heard").alias("next"), F.col("label").alias("old"))
        jump = label.select(F.col("node").alias("next"), F.col("label").alias("far"))
        new = written(new.join(jump, "next", "left").select("node", F.least("next", "far").alias("label"), "old"), name, small=True)
        discard(label)
        label = new.select("node", "label")
        if new.where("label <> old").isEmpty():
            discard(both)
            return label
