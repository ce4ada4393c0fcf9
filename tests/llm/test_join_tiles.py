"""What the similarity join writes for its tiles."""

from airlock.llm import ngram_join


def test_tiles_of_one_set_are_not_kept(spark, monkeypatch):
    """Short texts and long ones that begin like them share shingles, but can't be similar: no tile holds both."""
    kept = {}

    def written(df, name, small=False):
        kept[name] = original(df, name, small)
        return kept[name]

    original = ngram_join.written
    monkeypatch.setattr(ngram_join, "written", written)
    monkeypatch.setattr(ngram_join, "discard", lambda df: None)
    short = [" ".join(f"w{k}x{i}" for i in range(60)) for k in range(12)]
    texts = [*short, *(f"{t} " + " ".join(f"v{k}y{i}" for i in range(90)) for k, t in enumerate(short)), short[0] + " end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: (r.component_id, r.n_links) for r in ngram_join.NgramJoin(docs, n=3, percent=90).components().collect()}
    assert found == {k: ((0, 1) if k in (0, 24) else (k, 0)) for k in range(25)}
    assert {r.node for r in kept["tiles"].select("node").distinct().collect()} == {0, 24}
