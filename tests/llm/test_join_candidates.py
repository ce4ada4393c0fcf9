"""Which pairs the similarity join compares."""

import pytest

from airlock.llm import ngram_join


@pytest.mark.parametrize("share", [32, 1024])
def test_a_shared_passage_brings_no_pairs_together(spark, monkeypatch, share):
    """Long texts that have one passage in common and else nothing: their pairs are not candidates, with fine
    slots and with coarse ones; near copies still link."""
    n, met = 300, {}

    def counting(df, name, **more):
        table = real(df, name, **more)
        met[name] = table.count()
        return table

    real = ngram_join.written
    monkeypatch.setattr(ngram_join, "written", counting)
    monkeypatch.setattr(ngram_join, "SLOT_BITS", (6, 22))
    monkeypatch.setattr(ngram_join, "SLOT_SHINGLES", share)
    passage = [f"p{i}" for i in range(60)]
    texts = [[*(f"w{k}x{i}" for i in range(300)), *passage, *(f"v{k}y{i}" for i in range(300))] for k in range(n)]
    texts += [[*w[:200], "other", *w[201:]] for w in texts[:10]]
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: (r.component_id, r.n_links) for r in ngram_join.NgramJoin(docs, n=5, percent=80).components().collect()}
    assert found == {k: (k % n, 1 if k % n < 10 else 0) for k in range(n + 10)}
    assert met["stars-met"] + met["rest-met"] < n
