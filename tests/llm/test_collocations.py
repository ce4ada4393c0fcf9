"""Collocations against counting by hand, with tries that burst and spill, odd rows and long texts."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from airlock.llm import collocations as co
from airlock.llm.flat import flat
from airlock.llm.hat_trie import HatTrie, Table, ids_of, path

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _by_hand(rows):
    counts = [Counter(), Counter(), Counter()]
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in range(3):
                counts[k].update((lang or "und", *words[i : i + k + 1]) for i in range(len(words) - k))
    return counts


def _ranked_by_hand(rows, least=10, top=2000, inside=50):
    one, two, three = _by_hand(rows)
    f = {**one, **two, **three}
    n = Counter()
    for (lang, _), k in one.items():
        n[lang] += k
    longer = {k: v for k, v in three.items() if v >= least}
    found = defaultdict(list)
    for phrase, a in {**two, **three}.items():
        lang, *words = phrase
        if a < least:
            continue
        if any(len(p) > len(phrase) and p[0] == lang and words in ([*p[1:3]], [*p[2:4]]) and 100 * b >= inside * a for p, b in longer.items()):
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = f[(lang, *words[:k])], f[(lang, *words[k:])]
            cuts.append((10**6 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        found[lang].append((-score, -a, " ".join(words).encode(), left, right))
    return sorted((lang, r + 1, p.decode(), -a, left, right, n[lang], -s) for lang, rows in found.items() for r, (s, a, p, left, right) in enumerate(sorted(rows)[:top]))


def _texts(seed, n):
    rng = random.Random(seed)
    words = ["the", "of", "Über", "x1", "New", "york", "city", "é", "a" * 40, "straße"]
    weights = [30, 20, 3, 5, 8, 8, 6, 2, 1, 2]
    glue = [" ", "  ", "\t", " ", ". ", ",", "\n", "\x0b", "! ", " "]
    return [("".join(w + rng.choice(glue) for w in rng.choices(words, weights, k=rng.randrange(60))), rng.choice(["en", "en", "en", "de", None, "und", "x y"])) for _ in range(n)]


def _got(df, **more):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in co.collocations(df, **more).collect())


def test_by_hand_and_odd_rows(spark):
    rows = _texts(1, 400) + [(None, "en"), ("", None), ("...", "en"), ("word", "fr"), ("\x00 a\x85b\xa0c", "en")] + [("New York City again", "en")] * 12
    df = spark.createDataFrame([(t, g, 1, "h", "t") for t, g in rows], "text string, lang string, n int, head string, rank string").repartition(5)
    want = _ranked_by_hand(rows)
    assert len(want) > 100 and _got(df) == want
    assert _got(df, top=7, least=3) == _ranked_by_hand(rows, least=3, top=7)
    assert co.collocations(df.limit(0)).isEmpty() and co.collocations(df.where("lang = 'fr'")).isEmpty()


@pytest.mark.parametrize(("phrases", "words", "piece", "burst"), [(200, 10_000, 300, 16), (10_000, 4, 100, 64), (5, 3, 50, 2)])
def test_spilling_loses_nothing(monkeypatch, phrases, words, piece, burst):
    monkeypatch.setattr(co, "PIECE_BYTES", piece)
    monkeypatch.setattr(HatTrie.__init__, "__defaults__", (burst,))
    rows = _texts(2, 150) + [("no sign here " * 300, "en"), ("a", "en"), ("b", "en")]
    counter = co.Counter((1, 2, 3), None, phrases, words)
    texts, langs = pa.array([t for t, _ in rows], pa.string()), [g or "und" for _, g in rows]
    runs = [*counter.add(*flat(texts), langs), *counter.rest()]
    got = [Counter(), Counter(), Counter()]
    for r in pa.Table.from_batches(runs).to_pylist():
        if r["size"]:
            got[r["size"] - 1][(r["lang"], *r["head"].split(" "), *([r["tail"]] if r["tail"] else []))] += r["n"]
    assert got == _by_hand(rows) and len(runs) > 3


def test_trie_and_table():
    rng = np.random.default_rng(3)
    trie, want = HatTrie(burst=50), Counter()
    for _ in range(30):
        ids = [rng.integers(1, 9, 400) for _ in range(3)]
        ids[2][rng.random(400) < 0.5] = 0
        trie.add(path(*ids))
        want.update(zip(*(x.tolist() for x in ids), strict=True))
    assert len(trie.containers) > 5 and (np.diff(trie.borders.astype(np.int64)) > 0).all() and len(trie) == len(want)
    before, got = len(trie), Counter()
    for down_to in (before // 2, 0):
        for paths, counts in trie.spill(down_to):
            assert (np.diff(paths.astype(np.int64)) > 0).all()
            got.update(dict(zip(zip(*(x.tolist() for x in ids_of(paths)), strict=True), counts.tolist(), strict=True)))
        assert len(trie) <= down_to
    assert got == want
    table, keys = Table(2), np.arange(1, 5000, dtype=np.uint64)
    table.add(keys, keys.astype(np.int64))
    table.add(keys[::2].copy(), np.ones(2500, np.int64))
    k, v = table.items()
    assert (k == keys).all() and (v[::2] == keys[::2].astype(np.int64) + 1).all() and table.size == 4999


def test_exact_beyond_64_bits(spark):
    big = 3 * 10**12
    row = spark.createDataFrame([(big, big + 1, big + 2)], "a long, l long, r long")
    from pyspark.sql import functions as F

    assert row.select(co._score(F.col("a"), F.col("l"), F.col("r"))).first()[0] == 10**6 * big * big // ((big + 1) * (big + 2))


def test_languages_do_not_mix(spark):
    """A word's name in one language must not be another's with word and language exchanged."""
    df = spark.createDataFrame([("es la es la", "en"), ("en la en la", "es")] * 12, "text string, lang string")
    assert {(r.lang, r.phrase, r.a) for r in co.collocations(df, inside=1000).collect() if len(r.phrase) == 5} == {("en", "es la", 24), ("en", "la es", 12), ("es", "en la", 24), ("es", "la en", 12)}
