"""Collocations: phrases of two and three words that are commoner than their parts let expect.

Phrases are counted level by level. In each task a HAT-trie (see hat_trie) counts what the task has
read; when it holds too much, its largest subtrees leave as sorted runs. Runs are dealt by the first
two words of their phrases, so all counts of a prefix are merged in one place; as a prefix of two
words has been summed in the tries before, a frequent one is a few rows from each task. Phrases of
three words are only counted where both pairs in them are frequent enough, which every candidate's
are: a bit table of the frequent pairs keeps most of the others out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlock.llm.flat import PIECE_BYTES, flat, lowered, mix, word_hashes
from airlock.llm.hat_trie import HatTrie, Table, ids_of, path
from airlock.llm.ranks import ranked
from airlock.llm.store import written

LEAST, TOP, INSIDE = 10, 2000, 50
SCALE = 1_000_000
#: Phrases and words that a task holds before subtrees leave; rows of a batch of a run.
TRIE_PHRASES, TASK_WORDS, RUN_ROWS = 1 << 20, 1 << 19, 1 << 15
#: The bit table of frequent pairs has about 8 bits for each, and at most 2 ** 28 (32 MB). It only
#: spares rows a shuffle: a phrase that it lets through is judged by its count.
_FILTER_BITS = 28
_SPLIT = np.zeros(256, bool)
_SPLIT[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09]] = True
_NEXT = np.uint64(0x9E3779B97F4A7C15)
_RUN = pa.schema([("lang", pa.string()), ("size", pa.int8()), ("head", pa.string()), ("tail", pa.string()), ("n", pa.int64())])


def _chunks(buf: np.ndarray, offs: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Stretches of about `limit` bytes that end where no phrase can go on: at a sign that splits, or
    at the end of a text."""
    a = 0
    while a < buf.size:
        b, span = a + limit, limit
        while b < buf.size:
            end = int(offs[np.searchsorted(offs, b, side="right") - 1])
            signs = np.flatnonzero(_SPLIT[buf[max(a, b - span) : b]])
            b = max(end, max(a, b - span) + int(signs[-1]) + 1 if signs.size else 0)
            if b > a:
                break
            b, span = a + 2 * span, 2 * span  # a piece longer than that
        b = min(b, buf.size)
        yield a, b
        a = b


def _words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of each word; the texts stand one behind the other, from offs on."""
    inside = np.zeros(data.size + 1, bool)
    inside[:-1] = ~(_SPLIT[data] | _BLANK[data])
    new = np.zeros(data.size + 1, bool)  # a text begins here
    new[offs[(offs >= 0) & (offs <= data.size)]] = True
    before = np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(inside & (~before | new))
    ends = np.flatnonzero(before & (~inside | new))
    return starts, ends, np.searchsorted(offs, starts, side="right") - 1


def _seeds(langs: list[str]) -> np.ndarray:
    """A hash of each language. Not the one that words have: a word must not look like another one with
    their languages exchanged."""
    known = {g: int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest()) for g in set(langs)}
    return np.array([known[g] for g in langs], np.uint64)


def _named(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """A hash other than 0 of each word in its language."""
    h = mix(word_hashes(data, starts, ends) ^ seed)
    h[h == 0] = 1
    return h


class Counter:
    """Counts the phrases of some sizes in one task, by language."""

    def __init__(self, sizes: tuple[int, ...], admitted: tuple[np.ndarray, int] | None, phrases: int = TRIE_PHRASES, words: int = TASK_WORDS) -> None:
        self.sizes, self.admitted, self.most, self.most_words = sizes, admitted, phrases, words
        self.totals: dict[str, int] = {}
        self._forget()

    def _forget(self) -> None:
        self.trie, self.ids = HatTrie(), Table(12)
        self.langs: dict[str, int] = {}
        self.text: list[pa.Array] = []
        self.lang_of = [np.zeros(1, np.int32)]

    def add(self, buf: np.ndarray, offs: np.ndarray, langs: list[str]) -> Iterator[pa.RecordBatch]:
        seed = _seeds(langs)
        for a, b in _chunks(buf, offs, PIECE_BYTES):
            data = lowered(buf[a:b])
            starts, ends, doc = _words(data, offs - a)
            if starts.size == 0:
                continue
            h = _named(data, starts, ends, seed[doc])
            for g, n in zip(*np.unique(doc, return_counts=True), strict=True):
                self.totals[langs[g]] = self.totals.get(langs[g], 0) + int(n)
            self._learn(data, starts, ends, h, doc, langs)
            if len(self.trie) > self.most:
                yield from self._runs(self.most // 2)
            if self.known > self.most_words:
                yield from self._runs(0)
                self._forget()

    @property
    def known(self) -> int:
        return self.ids.size

    def _learn(self, data, starts, ends, h, doc, langs) -> None:
        new_words, where, back = np.unique(h, return_index=True, return_inverse=True)
        at, new = self.ids.slots(new_words)
        fresh = np.flatnonzero(new)
        if fresh.size:
            self.ids.values[at[fresh]] = 1 + self.ids.size - fresh.size + np.arange(fresh.size)
            spans = where[fresh]
            sizes = ends[spans] - starts[spans]
            edges = np.concatenate([[0], np.cumsum(sizes)])
            chars = data[np.arange(edges[-1]) + np.repeat(starts[spans] - edges[:-1], sizes)]
            self.text.append(pa.LargeStringArray.from_buffers(fresh.size, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(chars)).cast(pa.string()))
            self.lang_of.append(np.array([self.langs.setdefault(langs[d], len(self.langs)) for d in doc[spans]], np.int32))
        ids = self.ids.values[at][back]
        split = np.concatenate([[0], np.cumsum(_SPLIT[data])])[starts]
        along = lambda k: (split[k:] == split[: split.size - k]) & (doc[k:] == doc[: doc.size - k])
        paths = []
        if 1 in self.sizes:
            paths.append(path(ids))
        if 2 in self.sizes and ids.size > 1:
            ok = np.flatnonzero(along(1))
            paths.append(path(ids[ok], ids[ok + 1]))
        if 3 in self.sizes and ids.size > 2:
            ok = along(2)
            if self.admitted is not None:
                table, bits = self.admitted
                mark = _marks(h[:-1], h[1:]) & np.uint64((1 << bits) - 1)
                pair = (table[(mark >> np.uint64(6)).astype(np.int64)] >> (mark & np.uint64(63))) & np.uint64(1) != 0
                ok &= pair[:-1] & pair[1:]
            ok = np.flatnonzero(ok)
            paths.append(path(ids[ok], ids[ok + 1], ids[ok + 2]))
        if paths:
            self.trie.add(np.concatenate(paths))

    def _runs(self, down_to: int) -> Iterator[pa.RecordBatch]:
        text = pa.concat_arrays([pa.array([""]), *self.text])
        lang_of = np.concatenate(self.lang_of)
        self.text, self.lang_of = [text[1:]], [lang_of]
        names = pa.array(list(self.langs), pa.string())
        for paths, counts in self.trie.spill(down_to):
            for k in range(0, paths.size, RUN_ROWS):
                one, two, three = ids_of(paths[k : k + RUN_ROWS])
                first = text.take(pa.array(one))
                head = pc.if_else(pa.array(two > 0), pc.binary_join_element_wise(first, text.take(pa.array(two)), " "), first)
                size = 1 + (two > 0) + (three > 0)
                columns = [names.take(pa.array(lang_of[one])), pa.array(size.astype(np.int8)), head, text.take(pa.array(three)), pa.array(counts[k : k + RUN_ROWS])]
                yield pa.record_batch(columns, schema=_RUN)

    def rest(self) -> Iterator[pa.RecordBatch]:
        yield from self._runs(0)
        if 1 in self.sizes:
            rows = [(g, 0, "", "", n) for g, n in self.totals.items()]
            yield pa.record_batch([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_RUN)], schema=_RUN)


def _marks(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * _NEXT + second)


def _counted(texts: DataFrame, sizes: tuple[int, ...], admitted=None) -> DataFrame:
    """(lang, size, head, tail, n) of all phrases of these sizes: runs from the tasks, merged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(sizes, admitted.value if admitted is not None else None)
        for batch in batches:
            yield from counter.add(*flat(batch.column(1)), batch.column(0).to_pylist())
        yield from counter.rest()

    runs = texts.mapInArrow(run, "lang string, size byte, head string, tail string, n long")
    return runs.repartition("lang", "head").groupBy("lang", "size", "head", "tail").agg(F.sum("n").alias("n"))


def _bits(pairs: DataFrame) -> tuple[np.ndarray, int]:
    """A bit for each of 2 ** bits endings of a pair's mark, set where a frequent pair ends so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = flat(batch.column(1))
            starts, ends, row = _words(data, offs)
            h = _named(data, starts, ends, _seeds(batch.column(0).to_pylist())[row])
            yield pa.record_batch([pa.array(_marks(h[::2], h[1::2]).view(np.int64))], ["mark"])

    bits = min(_FILTER_BITS, max(16, (8 * pairs.count()).bit_length()))
    at = F.col("mark").bitwiseAND((1 << bits) - 1)
    marks = pairs.select("lang", "head").mapInArrow(run, "mark long")
    parts = marks.select(F.shiftright(at, 6).alias("word"), F.expr("shiftleft(1L, cast(mark & 63 AS INT))").alias("bit"))
    table = parts.groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[table["word"].to_numpy()] = table["bit"].to_numpy().view(np.uint64)
    return out, bits


def counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, size, head, tail, n) of words and pairs, and of phrases of three words, that occur at
    least so often; the row of size 0 has a language's number of words."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text")).where("text is not null")
    frequent = F.col("n") >= least
    short = written(_counted(texts, (1, 2)).where(frequent | (F.col("size") == 0)), "pairs")
    held = spark.sparkContext.broadcast(_bits(short.where("size = 2")))
    long = written(_counted(texts, (3,), held).where(frequent), "triples")
    held.unpersist()
    return short, long


def _score(a: Column, left: Column, right: Column) -> Column:
    wide = lambda c: c.cast("decimal(38,0)")
    return F.floor(F.call_function("div", wide(F.lit(SCALE)) * a * a, wide(left) * right)).cast("long")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP, inside: int = INSIDE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases.

    Texts are lower-cased (A-Z) and split into pieces at signs and line ends, and those into words at
    spaces and tabs; phrases stay within pieces. a, l and r are exact counts of the phrase and of the
    two parts of the cut that scores lowest; n is the language's number of words. A pair that lies in
    a phrase of three words with at least `inside` per cent of its count is left out. Ties go to the
    more frequent phrase, then to the first in byte order. A null language is "und"; null and empty
    texts hold nothing; repeated rows count each; an empty table gives an empty one. Texts of any length
    are counted in stretches that end at signs. Other columns are not read.
    """
    short, long = counts(docs, text_col, lang_col, least)
    word = short.where("size = 1").select("lang", F.col("head").alias("w"), F.col("n").alias("f"))
    pair = short.where("size = 2").select("lang", F.col("head").alias("phrase"), F.col("n").alias("a"))
    first, last = (F.substring_index("phrase", " ", k) for k in (1, -1))
    known = lambda name, as_n: word.select("lang", F.col("w").alias(name), F.col("f").alias(as_n))
    triple = long.select("lang", F.col("head").alias("h12"), F.col("tail").alias("w3"), F.col("n").alias("a"))
    triple = triple.withColumns({"w1": F.substring_index("h12", " ", 1), "h23": F.concat_ws(" ", F.substring_index("h12", " ", -1), "w3")})
    parts = triple.select("lang", F.explode(F.array("h12", "h23")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))

    alone = pair.join(parts, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("_longer") < inside * F.col("a"), F.lit(True))).drop("_longer")
    alone = alone.withColumns({"w1": first, "w2": last}).join(known("w1", "l"), ["lang", "w1"]).join(known("w2", "r"), ["lang", "w2"])
    alone = alone.select("lang", "phrase", "a", "l", "r", _score(F.col("a"), F.col("l"), F.col("r")).alias("score"))

    pairs = lambda name, as_n: pair.select("lang", F.col("phrase").alias(name), F.col("a").alias(as_n))
    cut = triple.join(pairs("h12", "f12"), ["lang", "h12"]).join(pairs("h23", "f23"), ["lang", "h23"]).join(known("w1", "f1"), ["lang", "w1"]).join(known("w3", "f3"), ["lang", "w3"])
    cut = cut.withColumns({"s1": _score(F.col("a"), F.col("f1"), F.col("f23")), "s2": _score(F.col("a"), F.col("f12"), F.col("f3"))})
    lower = lambda x, y: F.when(F.col("s1") <= F.col("s2"), F.col(x)).otherwise(F.col(y))
    whole = cut.select("lang", F.concat_ws(" ", "h12", "w3").alias("phrase"), "a", lower("f1", "f12").alias("l"), lower("f23", "f3").alias("r"), F.least("s1", "s2").alias("score"))

    best = ranked(alone.union(whole), ["lang"], [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()], "collocations").where(F.col("rank") <= top)
    totals = short.where("size = 0").groupBy("lang").agg(F.sum("n").alias("n"))
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
