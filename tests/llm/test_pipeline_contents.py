"""What each stage of the pipeline leaves, row by row and text by text, against plain versions."""

import re
from collections import Counter

from pyspark.sql import functions as F
from test_text_operators import _components

import corpus_pipeline
from airlock.llm.tokens import default_path

SPACES = r"[^\x20\x09-\x0D]+"


def _without_passages(rows, window=50):
    split = {d: re.findall(SPACES, t or "") for d, t in rows}
    least = {}
    for d, w in split.items():
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            least[key] = min(d, least.get(key, d))
    out = {}
    for d, t in rows:
        w, gone = split[d], set()
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        out[d] = " ".join(x for i, x in enumerate(w) if i not in gone) if gone else t
    return out


def _leaking(rows, items, threshold=0.8):
    norm = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    shingles = lambda w: Counter(tuple(w[i : i + min(5, len(w))]) for i in range(max(len(w) - 4, 1 if w else 0)))
    wanted = [(v, shingles(v)) for v in (norm(x) for x in items) if v]
    found = set()
    for d, t in rows:
        w = norm(t)
        have = set(shingles(w))
        for v, s in wanted:
            if len(v) >= 5 and sum(x in have for x in s) < threshold * len(s) / (1 + threshold):
                continue
            for i in range(len(w) - len(v) + 1):
                a = shingles(w[i : i + len(v)])
                if sum((a & s).values()) >= threshold * sum((a | s).values()) - 1e-9:
                    found.add(d)
                    break
    return found


def test_every_stage(spark, sf_dir):
    stages = dict(corpus_pipeline.STAGES)
    more = [(10_000, "123 456", None, "s", 7), (10_001, None, None, "s", 0), (10_002, "the and of that with", None, "s", 20)]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))

    def through(name, docs):
        out = stages[name](spark, docs, sf_dir)
        assert out.columns == docs.columns
        before, after = {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in out.collect()}
        assert out.count() == len(after) and after.keys() <= before.keys()
        return spark.createDataFrame(list(after.values()), docs.schema), before, after

    docs, before, after = through("language_id", docs)
    assert before.keys() - after.keys() == {10_000, 10_001}
    for d, r in after.items():
        assert (r.text, r.source, r.n_chars) == (before[d].text, before[d].source, before[d].n_chars)
        assert r.lang is not None and (before[d].lang is not None or r.lang == "en")
    changed = [d for d, r in after.items() if before[d].lang not in (None, r.lang)]
    assert len(changed) <= 0.02 * len(after)

    docs, before, after = through("ngram_join", docs)
    label = _components([(d, r.text) for d, r in before.items()], 5, 80)
    assert after.keys() == {d for d, (_, first) in label.items() if d == first} and len(after) < len(before)
    assert all(after[d] == before[d] for d in after)

    docs, before, after = through("substring_dedup", docs)
    want = _without_passages([(d, r.text) for d, r in before.items()])
    assert {d: r.text for d, r in after.items()} == want and any(want[d] != before[d].text for d in want)
    assert all(r.n_chars == len(r.text) and (r.lang, r.source) == (before[d].lang, before[d].source) for d, r in after.items())

    docs, before, after = through("decontamination", docs)
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert before.keys() - after.keys() == _leaking([(d, r.text) for d, r in before.items()], items)
    assert all(after[d] == before[d] for d in after)

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_path())
    pieces = stages["packing"](spark, docs, sf_dir)
    sizes = {r.doc_id: r.n for r in pieces.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert sizes == {d: len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for d, r in after.items()}
    assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 2048


def test_run_is_the_stages_in_turn(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    key = lambda df: sorted((r.doc_id, r.start, r.length) for r in df.collect())
    assert key(corpus_pipeline.run(spark, sf_dir)) == key(docs)
