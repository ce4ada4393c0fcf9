"""Substring removal, similarity join, decontamination, packing and token counts against plain versions."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from airlock.llm import decontamination, ngram_join, packing, repeats, substring_dedup, suffix_array, suffix_dedup, token_counts
from airlock.llm.flat import flat, words
from airlock.llm.tokens import default_path, encoder

DOCS = "doc_id long, text string, start string, node long, ids int, h long"


def _corpus(seed=3, n=60):
    """Copies, near copies, shared passages, repeats inside a text, and every odd text."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    text = lambda k: " ".join(word() for _ in range(k))
    passage, long_one = text(70), text(400)
    out = [text(rng.randint(1, 120)) for _ in range(n)]
    for i in range(0, n, 6):
        out[i] = f"{text(rng.randint(0, 20))} {passage} {text(rng.randint(0, 20))}"
    for i in range(1, n, 10):
        w = long_one.split()
        w[rng.randrange(400)] = word()
        out[i] = " ".join(w)
    out[3] = out[9] = "ab " * 300
    out[4], out[5] = "x" * 500, "x" * 99
    out += [None, "", "   \t\n", "one", "two words", "Two  Words", out[7], out[7], "日本語 " * 60, "\x0b\x0c"]
    return list(enumerate(out))


@pytest.fixture(scope="module")
def corpus():
    return _corpus()


def _frame(spark, rows, parts=3):
    """With columns whose names the operators use themselves."""
    return spark.createDataFrame([(d, t, "s", 1, 2, 3) for d, t in rows], DOCS).repartition(parts)


def _odd_rows(rows):
    return [*rows, rows[0], rows[0], (None, "no id " * 80), (None, None), (7, "another text of the same id " * 20)]


def _passages(rows, window=50):
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    least: dict[tuple, int] = {}
    for d, w in split:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            least[key] = min(d, least.get(key, d))
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def _strings(rows, length=100):
    least: dict[bytes, tuple[int, int]] = {}
    texts = [(d, (t or "").encode()) for d, t in rows]
    for d, b in texts:
        for i in range(len(b) - length + 1):
            key = b[i : i + length]
            least[key] = min((d, i), least.get(key, (d, i)))
    out = []
    for d, b in texts:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if least[b[i : i + length]] < (d, i):
                gone[i : i + length] = True
        kept = bytes(x for x, g in zip(b, gone.tolist(), strict=False) if not g)
        out.append((d, len(b), int(gone.sum()), int((gone[:-1] & ~gone[1:]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_words():
    import pyarrow as pa

    texts = [" a\tb\x0bc\x0c", None, "", "é ü d", "\x1cx"]
    buf, offs = flat(pa.array(texts))
    starts, ends, first = words(buf, offs)
    got = [[bytes(buf[a:b]).decode() for a, b in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]], strict=True)] for i in range(5)]
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]


def test_remove_passages(spark, corpus):
    got = substring_dedup.remove_passages(_frame(spark, corpus)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got)) == sorted(_passages(corpus))
    assert sum(r.n_removed for r in got) > 100


def test_remove_passages_odd_rows(spark, corpus):
    rows = _odd_rows(corpus)
    got = Counter((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.remove_passages(_frame(spark, rows)).collect())
    known = [r for r in rows if r[0] is not None]
    want = Counter(x[:3] for x in _passages(known))
    want.update([(None, 160, 0), (None, 0, 0)])
    assert got == want


def test_without_passages_keeps_columns(spark, corpus):
    df = _frame(spark, corpus)
    out = substring_dedup.without_passages(df)
    assert out.columns == df.columns and out.count() == len(corpus)
    texts, changed = dict(corpus), {x[0] for x in _passages(corpus) if x[2]}
    assert all((r.text != texts[r.doc_id]) == (r.doc_id in changed) for r in out.collect())


def test_remove_repeats(spark, corpus):
    got = suffix_dedup.remove_repeats(_frame(spark, corpus)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got)) == sorted(_strings(corpus))


def _noisy(corpus):
    """Also texts that quote one passage between different words: many entries of a few seeds."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    passage = " ".join(word() for _ in range(60))
    quotes = [f"{' '.join(word() for _ in range(rng.randint(1, 9)))} {passage} {' '.join(word() for _ in range(rng.randint(1, 9)))}" for _ in range(40)]
    quotes += [f"{quotes[3][:80]} {word()} {quotes[3]}", f"{quotes[5]} {quotes[5]}"]
    return [*corpus, *((200 + k, t) for k, t in enumerate(quotes))]


@pytest.mark.parametrize("switch", [None, (suffix_dedup, "SHARD_ENTRIES", 2), (suffix_dedup, "SHARD_BYTES", 1), (repeats, "_FILTER_BITS", 6), "joins"])
def test_remove_repeats_either_way(spark, corpus, monkeypatch, switch):
    """Seeds dealt over many shards, a shard for each seed, a filter that admits all, joins by shuffle."""
    if switch == "joins":
        monkeypatch.setattr(repeats, "BROADCAST_RUNS", -1)
        monkeypatch.setattr(suffix_dedup, "BROADCAST_RUNS", -1)
        monkeypatch.setattr(suffix_dedup, "SHARD_ENTRIES", 3)
    elif switch:
        monkeypatch.setattr(*switch)
    rows = _noisy(corpus)
    got = suffix_dedup.remove_repeats(_frame(spark, rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got)) == sorted(_strings(rows))


def test_rows_of_one_id_over_many_shards(spark, monkeypatch):
    """Hardly any shard room and all rows of two ids: the rounds end, and only the larger id loses."""
    monkeypatch.setattr(suffix_dedup, "SHARD_ENTRIES", 1)
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    shared = text(150)
    rows = [(1 + k // 8, text(30) + chr(65 + k) + shared + chr(65 + k) + text(30)) for k in range(16)]
    got = sorted((r.doc_id, r.n_removed) for r in suffix_dedup.remove_repeats(_frame(spark, rows)).collect())
    assert got == [(1, 0)] * 8 + [(2, 150)] * 8


@pytest.mark.parametrize("switch", [(repeats, "_FILTER_BITS", 6), (repeats, "BROADCAST_RUNS", -1)])
def test_remove_passages_either_way(spark, corpus, monkeypatch, switch):
    monkeypatch.setattr(*switch)
    rows = _noisy(corpus)
    got = substring_dedup.remove_passages(_frame(spark, rows)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got)) == sorted(_passages(rows))


@pytest.mark.parametrize("window", [1, 2, 5, 13, 300])
def test_remove_passages_of_any_length(spark, corpus, window):
    rows = [*corpus, (300, " ".join(f"w{i}" for i in range(700))), (301, "x " + " ".join(f"w{i}" for i in range(50, 500)))]
    got = substring_dedup.remove_passages(_frame(spark, rows), window).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got)) == sorted(_passages(rows, window))


def test_levels():
    assert substring_dedup.levels_of(50) == (7, 13, 25) and substring_dedup.levels_of(1) == (1,)


def test_remove_repeats_odd_rows(spark, corpus):
    rows = _odd_rows(corpus)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(_frame(spark, rows)).collect())
    want = Counter()
    for d, t in rows:  # rows of one id don't remove from each other: judge each with the rows of other ids
        if d is None:
            want.update([(None, len((t or "").encode()), 0, 0)])
        else:
            others = [r for r in rows if r[0] is not None and r[0] != d]
            want.update([next(x[:4] for x in _strings([(d, t), *others]) if x[0] == d)])
    assert got == want


@pytest.mark.parametrize("buckets", [1024, 0])
def test_suffix_arrays(monkeypatch, buckets):
    """Bucket by bucket and all buckets together."""
    monkeypatch.setattr(suffix_array, "BUCKET_SYMBOLS", buckets)
    rng = random.Random(5)
    for trial in range(80):
        n, k = rng.randint(0, 60), rng.choice([1, 2, 3, 200])
        t = np.array([rng.randint(1, k) for _ in range(n)] + [0])
        want = sorted(range(t.size), key=lambda i, t=t: t[i:].tolist())
        assert suffix_array.suffix_array(t).tolist() == want, trial
        shared = suffix_array.permuted_prefixes(t, np.array(want), 5)
        for r in range(1, t.size):
            a, b = t[want[r] :].tolist(), t[want[r - 1] :].tolist()
            m = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert shared[want[r]] == min(m, 5)


def test_suffix_array_of_many_names():
    """Long enough that the substrings of the first level have over 4,096 names; and a run of one symbol."""
    rng = np.random.default_rng(1)
    raw = rng.integers(0, 8, 60_000).astype(np.uint8)
    raw[30_000:50_000] = raw[:20_000]
    t = np.append(raw.astype(np.int32) + 1, 0)
    order = suffix_array.suffix_array(t)
    assert sorted(order.tolist()) == list(range(t.size))
    text = bytes(t.astype(np.uint8))
    assert all(text[a : a + 25_000] < text[b : b + 25_000] for a, b in zip(order[:-1].tolist(), order[1:].tolist(), strict=True))
    shared = suffix_array.permuted_prefixes(t, order, 100)[order]
    assert (shared >= 100).sum() >= 19_900
    began = time.time()
    same = suffix_array.suffix_array(np.append(np.ones(1 << 20, np.int32), 0))
    assert same.tolist() == list(range(1 << 20, -1, -1)) and time.time() - began < 2


def _components(rows, n, percent):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    label = {d: d for d in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {d: (len(sets[d]), label[d]) for d in sets}


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_ngram_join(spark, corpus, n, percent):
    got = ngram_join.NgramJoin(_frame(spark, corpus), n, percent).components()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == _components(corpus, n, percent)


@pytest.mark.parametrize("tile", [4096, 2])
def test_ngram_join_chain_of_near_copies(spark, monkeypatch, tile):
    """Links only from each text to the next: the ends are not alike, and the star of the first step misses most."""
    monkeypatch.setattr(ngram_join, "TILE_SETS", tile)
    rng = random.Random(1)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for k in range(12):
        rows.append((100 - k, " ".join(base)))
        at = rng.randrange(280)
        base[at : at + 4] = [f"n{k}{j}" for j in range(4)]
    got = ngram_join.NgramJoin(_frame(spark, rows), 3, 90).components()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == _components(rows, 3, 90)


def _degrees(rows, n, percent):
    sets = {}
    for d, t in rows:
        w = t.split()
        sets.setdefault(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)), []).append(d)
    return {d: sum(a != b and 100 * len(a & b) >= percent * len(a | b) for b in sets) for a, ids in sets.items() for d in ids}


@pytest.mark.parametrize("block", [256, 4])
def test_ngram_join_counts_all_links(spark, monkeypatch, block):
    """A group of mutually near texts, a group that is near in part, copies and a chain, in one block and in many."""
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", block)
    rng = random.Random(4)
    rows = []
    for g, (k, changes) in enumerate([(3, 1), (2, 1), (20, 1), (25, 3)]):
        base = [f"g{g}w{i}" for i in range(120)]
        for m in range(k):
            w = list(base)
            for c in range(changes):
                w[rng.randrange(120)] = f"n{g}.{m}.{c}"
            rows.append((1000 - len(rows), " ".join(w)))
    rows += [(2000, rows[0][1]), (1, rows[30][1]), (1, rows[30][1])]
    chain = [f"c{i}" for i in range(200)]
    for k in range(10):
        rows.append((50 - k, " ".join(chain)))
        at = rng.randrange(196)
        chain[at : at + 3] = [f"m{k}{j}" for j in range(3)]
    got = ngram_join.NgramJoin(_frame(spark, rows), 3, 90).components().collect()
    assert len(got) == len(rows)
    want = _degrees(rows, 3, 90)
    assert {r.doc_id: r.n_links for r in got} == want
    assert max(want.values()) >= 19


def test_ngram_join_writes_no_pairs(spark, monkeypatch):
    """A large group of near copies: links are counted where they meet, so no table grows with its square."""
    n, sizes = 1500, {}
    base = " ".join(f"w{k}" for k in range(60)).split()
    rows = [(k, " ".join([*base[:30], f"x{k}", *base[31:]])) for k in range(n)]
    real = ngram_join.written

    def counting(df, name, **more):
        table = real(df, name, **more)
        sizes[name] = max(sizes.get(name, 0), table.count())
        return table

    monkeypatch.setattr(ngram_join, "written", counting)
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 200)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.NgramJoin(docs, n=3, percent=90).components().collect()
    assert {(r.component_id, r.n_links) for r in got} == {(0, n - 1)}
    assert max(sizes.values()) < 30 * n and sizes["links"] <= 10 * n


def test_ngram_join_odd_rows(spark, corpus):
    """Null ids stand alone, also next to copies; repeated rows and rows of one id are one document."""
    long = " ".join(f"v{i}" for i in range(50))
    rows = [*corpus, corpus[7], (None, long), (None, long), (None, None), (500, long), (501, long), (501, "another text of the same id " * 9), (502, "another text of the same id " * 9)]
    got = ngram_join.NgramJoin(_frame(spark, rows), 3, 90).components().collect()
    assert len(got) == len(rows)
    assert sorted((r.n_shingles, r.n_links, r.component_id) for r in got if r.doc_id is None) == sorted([(48, 0, None), (48, 0, None), (0, 0, None)], key=str)
    assert {r.component_id for r in got if r.doc_id in (500, 501, 502)} == {500}
    assert len({r.component_id for r in got if r.doc_id == 7}) == 1


@pytest.mark.parametrize("switch", [("BROADCAST_IDS", -1), ("BROADCAST_BYTES", -1), ("SLOT_BITS", (4, 4)), ("SLOT_SHINGLES", 1), ("TILE_SETS", 2)])
def test_ngram_join_either_way(spark, corpus, monkeypatch, switch):
    """Joins by shuffle, and slots so few or so many that they tell nothing or every shingle."""
    monkeypatch.setattr(ngram_join, *switch)
    got = ngram_join.NgramJoin(_frame(spark, corpus), 3, 90).components()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == _components(corpus, 3, 90)


def test_first_of_each(spark, corpus):
    rows = [*corpus, corpus[7], (None, "no id")]
    df = _frame(spark, rows)
    out = ngram_join.NgramJoin(df).first_of_each()
    want = [d for d, (_, low) in _components(corpus, 5, 80).items() if d == low]
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect() if r.doc_id is not None) == sorted(want)
    assert out.where("doc_id is null").count() == 1


def test_bitmaps_bound_differences():
    rng = np.random.default_rng(2)
    for n in (10, 1000, 5000):
        common = rng.integers(0, 1 << 63, n).astype(np.uint64)
        sets = [np.unique(np.concatenate([common, rng.integers(0, 1 << 63, n // 9 + 1).astype(np.uint64)])) for _ in range(2)]
        h, edges = np.concatenate(sets), np.array([0, sets[0].size, sets[0].size + sets[1].size])
        _, short = ngram_join._bitmaps(h, edges)
        assert np.bitwise_count(short[:, 0] ^ short[:, 1]).sum() <= np.setxor1d(*sets).size


def _leaks(docs, items):
    norm = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    shingles = lambda w: Counter(tuple(w[i : i + min(5, len(w))]) for i in range(max(len(w) - 4, 1 if w else 0)))
    out = {}
    for d, t in docs:
        w = norm(t)
        for i, x in items:
            v = norm(x)
            best = None
            for s in range(len(w) - len(v) + 1 if v else 0):
                a, b = shingles(w[s : s + len(v)]), shingles(v)
                sim = sum((a & b).values()) / sum((a | b).values())
                if sim >= 0.8 and (best is None or sim > best[1]):
                    best = s, sim
            if best:
                out[d, i] = best[0], len(v), round(best[1], 9)
    return out


@pytest.mark.parametrize(("n", "spread"), [(5, 1 << 20), (900, 1 << 20), (5, 0), (900, 0)])
def test_multi_index_misses_none(monkeypatch, n, spread):
    """With few items and with many, patterns on either side, every fingerprint within the radius is found."""
    monkeypatch.setattr(decontamination, "_SPREAD", spread)
    rng = np.random.default_rng(n)
    items = rng.integers(0, 1 << 63, (n, 2)).astype(np.uint64)
    flips = (rng.random((60, 128)) < rng.choice([0.1, 0.2, 0.26], (60, 1))).astype(np.uint8)
    prints = items[rng.integers(0, n, 60)] ^ np.packbits(flips, axis=1).view(np.uint64)
    group = decontamination._Length(10, 5, list(range(n)), np.zeros((n, 6), np.uint64), items)
    window, item = group.candidates(prints)
    apart = np.bitwise_count(prints[:, None, :] ^ items[None, :, :]).sum(2)
    assert set(zip(window.tolist(), item.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(apart <= decontamination.RADIUS)), strict=True))


def _borderline(seed=6, n=40):
    """Items, and texts that have just enough, or just too few, of their shingles."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 6)))
    items, docs = [], []
    for i in range(n):
        w = [word() for _ in range(rng.choice([40, 47, 58]))]
        items.append((i, " ".join(w)))
        for cut in (2, 3, 4, 5, 6):
            docs.append((10 * i + cut, " ".join([*w[:-cut], *(word() for _ in range(cut))])))
    return docs, items


def test_threshold_is_exact_beyond_the_radius(spark, monkeypatch):
    """No pair at the threshold is lost, whatever its fingerprints; slices of the benchmark change nothing."""
    docs, items = _borderline()
    want = _leaks(docs, items)
    df, bench = _frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    found = lambda: {(r.doc_id, r.item): (r.start_word, r.n_words, round(r.similarity, 9)) for r in decontamination.find_leaks(df, bench, exact=True).collect()}
    assert found() == want and 0 < len(want) < len(docs)
    monkeypatch.setattr(decontamination, "RADIUS", 0)
    decontamination._probes.cache_clear()
    monkeypatch.setattr(decontamination, "SLICE_CHARS", 4000)
    assert found() == want
    assert {r.doc_id for r in decontamination.without_leaks(df, bench, exact=True).collect()} == {d for d, _ in docs} - {d for d, _ in want}
    decontamination._probes.cache_clear()


def test_recall_of_the_fingerprints_alone():
    """Of pairs just above the threshold, nearly all are within the radius; without the fingerprints none
    is found, so it is they that find them."""
    rng, near, met = np.random.default_rng(9), 0, 0
    for size in (9, 16, 26, 36, 46, 96):
        for shared in range(size):
            alike = shared / (2 * size - shared)
            if not 0.8 <= alike < 0.85:
                continue
            items = rng.integers(0, 1 << 63, (400, size)).astype(np.uint64)
            other = np.concatenate([items[:, :shared], rng.integers(0, 1 << 63, (400, size - shared)).astype(np.uint64)], axis=1)
            apart = np.bitwise_count(decontamination.fingerprints(items) ^ decontamination.fingerprints(other)).sum(1)
            near += int((apart <= decontamination.RADIUS).sum())
            met += len(items)
    assert met > 2000 and near / met >= decontamination.RECALL, near / met


def test_the_result_depends_on_the_fingerprints(spark, monkeypatch):
    docs, items = _borderline()
    df, bench = _frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    want = _leaks(docs, items)
    found = {(r.doc_id, r.item) for r in decontamination.find_leaks(df, bench).collect()}
    assert found <= set(want) and len(found) >= 0.97 * len(want)
    index = decontamination.index_of([i for i, _ in items], [t for _, t in items])
    buf, offs = flat(pa.array([t for _, t in docs]))
    rows, ids, *_ = decontamination.search(index, buf, offs, 0.8)
    assert {(docs[r][0], i) for r, i in zip(rows.tolist(), ids, strict=True)} == found
    monkeypatch.setattr(decontamination, "RADIUS", -1)
    assert decontamination.search(index, buf, offs, 0.8)[0].size == 0
    assert decontamination.search(index, buf, offs, 0.8, exact=True)[0].size == len(want)


def test_find_leaks(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(2, 5)))
    items = [(i, " ".join(word() for _ in range(rng.randint(8, 50)))) for i in range(12)] + [(50, "short item"), (51, None), (52, ""), (53, "rep rep rep rep rep rep rep rep")]
    docs = []
    for k in range(60):
        w = items[k % 12][1].split()
        for _ in range(k % 4):
            w[rng.randrange(len(w))] = "changed"
        docs.append((k, f"{' '.join(word() for _ in range(k % 7))} {' '.join(w).upper() if k % 2 else ', '.join(w)} {word()}"))
    docs += [(100, "a Short, ITEM!"), (101, None), (102, ""), (103, "rep " * 30), (104, "clean text " * 50)]
    df, bench = _frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item): (r.start_word, r.n_words, round(r.similarity, 9)) for r in decontamination.find_leaks(df, bench).collect()}
    want = _leaks(docs, items)
    assert got == want and len(want) > 15
    kept = decontamination.without_leaks(df, bench)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want}
    assert decontamination.find_leaks(df, bench.limit(0)).isEmpty()
    assert decontamination.find_leaks(df.limit(0), bench).isEmpty()


def test_find_leaks_with_typographic_signs(spark):
    """Signs beyond ASCII on either side, within words' bounds and between words, and letters beyond ASCII."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefé日") for _ in range(rng.randint(2, 5)))
    signs = ["“{}”", "{}…", "«{}»", "{}—", "\u00a0{}", "‘{}’", "{}–", "{}€"]
    dressed = lambda w: "".join(rng.choice(signs).format(x) + (" " if k % 2 else "\u00a0") for k, x in enumerate(w))
    texts = [[word() for _ in range(rng.randint(8, 30))] for _ in range(8)]
    items = [(i, dressed(w) if i % 2 else " ".join(w)) for i, w in enumerate(texts)]
    docs = [(k, f"{word()} {dressed(texts[k % 8]) if k < 8 else ', '.join(texts[k % 8])} {word()}") for k in range(16)]
    df, bench = _frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    want = _leaks(docs, items)
    got = {(r.doc_id, r.item): (r.start_word, r.n_words, round(r.similarity, 9)) for r in decontamination.find_leaks(df, bench).collect()}
    assert got == want and len(want) == 16
    assert decontamination.without_leaks(df, bench).isEmpty()


@pytest.mark.parametrize("store", [1 << 22, 10])
def test_ids_are_the_tokenizers(monkeypatch, store):
    """With a table that is kept, and with one that is started anew for every piece."""
    import pyarrow as pa

    from airlock.llm import tokens

    monkeypatch.setattr(tokens, "_STORE", store)

    rng = random.Random(1)
    parts = ["a", "B", "é", " ", "  ", "\n", "'s", "'", "'ll", "1", "23", "٣", "!", "#", "\t", " ", "it's", "'re", "日本", "😀", "<|endoftext|>", "\x1c", "'d"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(800)] + [None, "", "x" * 3000]
    for as_text in (False, True):
        e = encoder(default_path(), as_text)
        ids, offs = e.encode(pa.array(texts, pa.string()))
        want = e.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
        assert [ids[offs[i] : offs[i + 1]].tolist() for i in range(len(texts))] == [w.ids for w in want]


def test_packing(spark, corpus):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(default_path())
    rows = [*corpus, corpus[0], (900, "long text of many words " * 3000)]
    pieces = packing.pack(_frame(spark, rows)).select("*", F.crc32("ids").alias("crc")).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
        assert p.crc == zlib.crc32(bytes(p.ids)) and len(p.ids) == 4 * p.length and p.length > 0
    for d, t in rows:
        want = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        got = sorted((p for p in by_doc[d]), key=lambda p: p.start)
        copies = sum(r[0] == d for r in rows)
        assert sum(p.length for p in got) == copies * len(want) and all(p.doc_tokens == len(want) for p in got)
        assert all(np.frombuffer(bytes(p.ids), "<u4").tolist() == want[p.start : p.start + p.length] for p in got)
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    total = sum(p.length for p in pieces)
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in (sum(p.length for p in ps) for ps in by_sequence.values()))
    assert padding < 0.02 * total
    assert packing.pack(_frame(spark, rows).limit(0)).isEmpty()
    with pytest.raises(ValueError, match="power"):
        packing.pack(_frame(spark, rows), capacity=1000)


def test_packing_null_ids_and_many_batches(spark, corpus):
    """A text of many sequences among rows that come in batches of three, and rows without an id."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(default_path())
    rows = [*corpus[:30], (None, "no id"), (None, None), (901, "a very long text " * 20_000)]
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        pieces = packing.pack(_frame(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    got = Counter()
    for p in pieces:
        got[p.doc_id] += p.length
    want = Counter()
    for d, t in rows:
        want[d] += len(tok.encode(t or "", add_special_tokens=False).ids) + 1
    assert got == want and max(p.length for p in pieces) == 2048


def test_cut_lengths():
    n = np.array([1, 127, 128, 2047, 2048, 2049, 5000, 100_000])
    count, length = packing.cut_lengths(n)
    assert np.add.reduceat(length, np.cumsum(count) - count).tolist() == n.tolist() and length.max() <= 2048


def test_token_counts(spark, corpus):
    e = encoder(default_path(), True)
    rows = [*corpus, corpus[0], (901, "with <|endoftext|> inside"), (None, "no id")]
    got = Counter((r.doc_id, r.n_tokens) for r in token_counts.document_token_counts(_frame(spark, rows)).collect())
    assert got == Counter((d, len(e.tokenizer.encode(t or "", add_special_tokens=False).ids)) for d, t in rows)
    assert token_counts.document_token_counts(_frame(spark, rows).limit(0)).isEmpty()


@pytest.mark.parametrize("block", [2, 6, 10, 1000])
def test_flat_files_in_any_blocks(spark, tmp_path, block):
    ids = [[0, 7, 7, 0, 0, 7, 7, 7, 7, 7, 7, 0, 7], [0], [7, 7], [7, 0]]
    for i, x in enumerate(ids):
        (tmp_path / f"{i}.bin").write_bytes(np.array(x, "<u2").tobytes())
    (tmp_path / "empty.bin").write_bytes(b"")
    got = token_counts.token_counts(token_counts.read_token_files(spark, f"file://{tmp_path}", block), separator=0, width=2).collect()
    by_file = {}
    for r in got:
        by_file.setdefault(r.file.rsplit("/", 1)[1], {})[r.ordinal] = r.n_tokens
    assert by_file == {"0.bin": {0: 0, 1: 2, 2: 0, 3: 6, 4: 1}, "1.bin": {0: 0}, "2.bin": {0: 2}, "3.bin": {0: 1}}


@pytest.mark.parametrize("switch", [("GROUP_BLOCKS", 2), ("BROADCAST_BLOCKS", -1), ("WHOLE_BYTES", 8)])
def test_flat_files_either_way(spark, tmp_path, monkeypatch, switch):
    """Prefix sums over many groups, offsets by shuffle, files cut into ranges."""
    monkeypatch.setattr(token_counts, *switch)
    rng = random.Random(7)
    want = {}
    for name in range(3):
        lengths = [rng.choice([0, 1, 3, 40, 200]) for _ in range(rng.randint(1, 30))]
        ids = [i for n in lengths for i in [*([9] * n), 0]] + [9] * name
        want[f"{name}.bin"] = dict(enumerate([*lengths, *([name] if name else [])]))
        (tmp_path / f"{name}.bin").write_bytes(np.array(ids, "<u2").tobytes())
    got = {}
    for r in token_counts.token_counts(token_counts.read_token_files(spark, f"file://{tmp_path}", 8), separator=0, width=2).collect():
        got.setdefault(r.file.rsplit("/", 1)[1], {})[r.ordinal] = r.n_tokens
    assert got == want


def test_ids_must_fit(spark):
    with pytest.raises(ValueError, match="separator"):
        token_counts.token_blocks(_frame(spark, [(1, "a")]), width=1)
    with pytest.raises(Exception, match="do not hold"):
        token_counts.token_blocks(_frame(spark, [(1, "many different words")]), separator=0, width=1)


def test_text_longer_than_a_block(spark):
    e = encoder(default_path(), True)
    rows = [(1, "one"), (2, "many words of a long text " * 2000), (3, ""), (4, "four")]
    blocks, order = token_counts.token_blocks(_frame(spark, rows, 1), block_bytes=512)
    counts = {(r.file, r.ordinal): r.n_tokens for r in token_counts.token_counts(blocks).collect()}
    got = {r.doc_id: counts[r.file, r.ordinal] for r in order.collect()}
    assert got == {d: len(e.tokenizer.encode(t, add_special_tokens=False).ids) for d, t in rows}


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert substring_dedup.remove_passages(none).isEmpty()
    assert suffix_dedup.remove_repeats(none).isEmpty()
    assert ngram_join.NgramJoin(none).components().isEmpty()
    assert ngram_join.NgramJoin(none).first_of_each().isEmpty()
