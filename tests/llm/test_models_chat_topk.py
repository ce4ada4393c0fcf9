"""Classifiers by held-out accuracy, chats by round trip, search against brute force, and the pipeline."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from airlock.llm import chat, language_id, topk, toxicity
from airlock.llm.packing import pack
from airlock.llm.queries import ORACLE_SQL, QUERIES


def test_codewords_are_apart():
    for n in (2, 3, 4, 6, 7, 30):
        code = language_id.codewords(n)
        apart = [int((code[a] != code[b]).sum()) for a in range(n) for b in range(a)]
        assert min(apart) >= (1 if n == 2 else code.shape[1] // 4)


def test_rare_languages_and_one_id_for_many_rows(spark):
    """A language of few rows is learnt whatever its share, and rows that share an id are bounded."""
    rng = random.Random(6)
    text = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(12))
    rows = [(k, text("abcdefg"), "aa") for k in range(400)] + [(7, text("hijklmn"), "bb") for _ in range(400)] + [(900 + k, text("opqrstu"), "cc") for k in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs, F.lit(True), rows=30)
    assert model.languages == ["aa", "bb", "cc"]
    right = language_id.identify(docs, model).where("lang = lang_pred").groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in right} == {"aa": 400, "bb": 400, "cc": 2}


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(docs, ~language_id.held_out())
    found = language_id.identify(docs, model).where(language_id.held_out())
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert right[0] > 0.97 and 0 <= right[1] <= right[2] <= 1
    long = " ".join(r.text for r in docs.where("lang = 'de' AND text is not null").limit(150).collect())
    row = language_id.identify(spark.createDataFrame([(1, long)], "doc_id long, text string"), model).first()
    assert len(long) > 150_000 and row.lang_pred == "de" and not row.ambiguous
    odd = spark.createDataFrame([(1, None, 1.0), (2, "", 2.0), (3, "123 !?", 3.0), (4, "the and of with that", 4.0), (4, "the and of with that", 4.0)], "doc_id long, text string, score double")
    got = language_id.identify(odd, model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got[:3]] == ["und"] * 3 and got[3] == got[4] and got[3].lang_pred == "en"
    assert language_id.identify(odd.limit(0), model).isEmpty()


def test_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert language_id.train(docs, F.lit(True)) is None
    assert language_id.identify(docs, None).first().lang_pred == "und"


def test_one_language(spark):
    docs = spark.createDataFrame([(1, "some text", "en"), (2, None, "en")], "doc_id long, text string, lang string")
    assert language_id.identify(docs, language_id.train(docs, F.lit(True))).where("lang_pred = 'en'").count() == 1


def test_toxicity_with_few_labels(spark):
    """286 labelled rows, 33 of them toxic: found without learning them by heart. A misspelling that no
    text holds counts as well, and clean text around toxic text lowers its score but slowly."""
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    tested = language_id.held_out(parts=3, part=1)
    model = toxicity.train(docs, labels, ~tested)
    got = toxicity.score(docs, model).join(labels, "doc_id").where(tested).toPandas()
    y, s = got["toxic"].to_numpy(), got["score"].to_numpy()
    flagged = s >= toxicity.THRESHOLD
    assert y[flagged].mean() > 0.85 and flagged[y == 1].mean() > 0.85
    ranks = np.argsort(np.argsort(s, kind="stable"), kind="stable") + 1
    n = y.sum()
    assert (ranks[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n)) > 0.95
    clean = " ".join(r.text for r in docs.join(labels.where("toxic = 0"), "doc_id").where(tested & (F.col("lang") == "en")).orderBy("doc_id").limit(40).collect())
    words = clean.split()
    mixed = lambda bad, n: " ".join([*words[: n // 2], bad, *words[n // 2 : n]])
    rows = [(1, mixed("pathetik moronn", 40)), (2, mixed("you idiiot", 30)), (3, " ".join(words[:40])), (4, clean)]
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got[1] > 0.7 and got[2] > 0.7 and got[3] < 0.5 and got[4] < 0.1


def test_toxicity_of_one_text_each(spark):
    """Hardly any labels at all give a model that tells the two apart."""
    model = toxicity.fit(["you idiot moron", "a calm day", "idiot", ""], np.array([1, 0, 1, 0]))
    bad, good = model.scores(*_flat(["idiot moron", "a calm day"]))
    assert 0 <= good < bad <= 1
    assert 0 <= toxicity.fit(["x", ""], np.array([1, 0])).scores(*_flat(["", "x"])).min()


def _flat(texts):
    import pyarrow as pa

    from airlock.llm.flat import flat

    return flat(pa.array(texts, pa.string()))


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    tested = language_id.held_out(parts=3, part=1)
    model = toxicity.train(docs, labels, ~tested)
    got = toxicity.score(docs, model).join(labels, "doc_id").where(tested).toPandas()
    y, s = got["toxic"].to_numpy(), got["score"].to_numpy()
    flagged = s >= toxicity.THRESHOLD
    assert y[flagged].mean() > 0.9 and flagged[y == 1].mean() > 0.9
    # Text of one kind does not move the score, however long it gets; other columns are not read.
    clean = [r.text for r in docs.join(labels.where("toxic = 0"), "doc_id").where(tested & (F.length("text") > 2000)).orderBy("doc_id").limit(700).collect()]
    joined = [" ".join(clean[:n]) for n in (5, 50, 700)]
    assert len(joined[2].split()) > 50_000
    rows = [(1, None), (2, ""), (None, "idiot moron"), (4, "idiot moron"), (4, "idiot moron"), *((10 + k, t) for k, t in enumerate(joined))]
    odd = spark.createDataFrame([(d, t, 0.5, 1, "x") for d, t in rows], "doc_id long, text string, score double, toxic int, _id string")
    rows = toxicity.score(odd, model).collect()
    assert rows[0].score == rows[1].score < 0.3 and rows[2].score == rows[3].score == rows[4].score > 0.7
    assert all(r.score < 0.1 for r in rows[5:])
    assert toxicity.score(odd, None).agg(F.max("score")).first()[0] == 0
    assert toxicity.score(odd.limit(0), model).isEmpty()
    assert toxicity.train(docs, labels.where("toxic = 0"), F.lit(True)) is None
    assert toxicity.train(docs.limit(0), labels, F.lit(True)) is None and toxicity.train(docs, labels.limit(0), F.lit(True)) is None


def test_toxicity_training_rows(spark, monkeypatch):
    """Repeated ids and labels give one row, texts over the limit none, before the rows are chosen."""
    taken = {}
    monkeypatch.setattr(toxicity, "fit", lambda texts, y: taken.update(zip(texts, y.tolist(), strict=True)))
    monkeypatch.setattr(toxicity, "TRAIN_CHARS", 10)
    rows = [(k, f"t{k}") for k in range(20)] + [(k, f"u{k}") for k in range(20)] + [(30 + k, "x" * 11) for k in range(20)] + [(60, None)]
    marks = [(k, k % 2) for k in range(20)] + [(1, 0), (1, 1), (3, None)] + [(30 + k, 1) for k in range(20)] + [(60, 1), (99, 1), (None, 1)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    toxicity.train(docs, labels, F.lit(True), rows={1: 50, 0: 4})
    assert {t for t, y in taken.items() if y == 1} == {f"t{k}" for k in range(1, 20, 2)}
    assert sum(y == 0 for y in taken.values()) == 4 and len(taken) == 14


def test_misspellings_share_vectors():
    rng = random.Random(0)
    clean = [" ".join(rng.choice("alpha bravo charlie delta echo foxtrot golf hotel".split()) for _ in range(30)) for _ in range(120)]
    texts = clean + [f"{t} horrible {t}" for t in clean]
    model = toxicity.fit(texts, np.array([0] * 120 + [1] * 120))
    score = lambda t: model.scores(*toxicity.flat(toxicity.pa.array([t])))[0]
    assert score("alpha horribble bravo") > 10 * score("alpha bravo") and score("horrible") > 0.9


def test_chat_round_trip(spark):
    rng = random.Random(2)
    parts = ["\\", "###", "### ", "</turn>", ":", "\n", "\\s", "\\h", "é", "a", "#", "<"]
    said = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))
    rows = [(c, t // 2, rng.choice(["user", "assistant", "a: b###", "", None]), rng.choice([None, said()])) for c in range(40) for t in range(rng.randint(1, 7))]
    rows += [(None, None, None, None), (None, 1, "assistant", "x"), rows[0], rows[0]]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted int, t string")
    out = chat.format_chats(df).select("*", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    want = {}
    for c, t, r, x in rows:
        want.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    got = {r.conv_id: r for r in out.collect()}
    assert got.keys() == want.keys()
    for c, turns in want.items():
        turns.sort()
        assert [(t.role, t.text) for t in got[c].turns] == [t[1:] for t in turns]
        assert got[c].loss == "".join(x for _, r, x in turns if r == "assistant")
    assert chat.format_chats(df.limit(0)).isEmpty()


def test_chat_of_many_turns(spark):
    """More turns than are gathered at a time; spans point at what the loss mask covers."""
    rows = [(1, i, "assistant" if i % 3 else "user", f"turn {i} \\ ###") for i in range(1000)]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    r = out.select("*", chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), chat.read_back(F.col("formatted")).alias("turns")).first()
    assert r.loss == "".join(x for _, _, role, x in rows if role == "assistant") and len(r.loss_spans) == 666
    assert [(t.role, t.text) for t in r.turns] == [x[2:] for x in rows]


def test_adjacent_turns_share_a_header(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(df).first().formatted == "### user: a</turn>b</turn>\n### assistant: c</turn>"


def _search(rows, k, every):
    clean = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            clean[i] = min(v, clean.get(i, v))
    number = {i: [int(np.floor(1024 * x)) for x in v] for i, v in clean.items()}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for q in number:
        if q % every == 0:
            best = sorted((-dot(number[q], number[v]), v) for v in number if v != q)[:k]
            out += [(q, r + 1, v, -s) for r, (s, v) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 1e5])
def test_top_k(spark, monkeypatch, scale):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 16)
    monkeypatch.setattr(topk, "PART_BLOCKS", 2)
    monkeypatch.setattr(topk, "CHUNK_QUERIES", 5)
    monkeypatch.setattr(topk, "BOUND_BLOCKS", 4)
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in rng.normal(0, scale, 8).astype("f4")]) for i in range(-40, 160)]
    same = rows[20][1]
    rows = [(i, same if i % 7 == 0 else v) for i, v in rows]
    rows += [(500, None), (501, [1.0, None]), (502, [float("nan")]), (503, [float("inf")]), (None, same), rows[3], (510, [1.0, 2.0]), (511, [])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, score int, rank int")
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 10 == 0, 3).collect()))
    assert got == _search(rows, 3, 10)


def test_blocks_that_cannot_win_are_not_sent(spark, monkeypatch):
    """Clusters of neighbouring ids: of all (chunk, block) pairs few are shipped, and the result is exact."""
    monkeypatch.setattr(topk, "BLOCK_ROWS", 20)
    monkeypatch.setattr(topk, "CHUNK_QUERIES", 2)
    shipped, real = {}, topk.written
    monkeypatch.setattr(topk, "written", lambda df, name, small=False: shipped.setdefault(name, real(df, name)))
    rng = np.random.default_rng(3)
    centres = np.eye(24)[np.arange(600) // 25] * 10
    rows = [(i, (centres[i] + rng.normal(0, 0.05, 24)).tolist()) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0, 3).collect()))
    assert got == _search(rows, 3, 50)
    chunks = shipped["queries"].select("_chunk").distinct().count()
    pairs = shipped["ahead"].count() + shipped["rest"].count()
    assert chunks > 3 and pairs < 0.4 * chunks * 30


def test_sparse_ids_fill_their_blocks(spark, monkeypatch):
    """Blocks hold rows by their place among the ids, however far these are apart; with the query's own
    block size, clusters of neighbours prune most of the blocks."""
    shipped, real = {}, topk.written
    monkeypatch.setattr(topk, "written", lambda df, name, small=False: shipped.setdefault(name, real(df, name)))
    monkeypatch.setattr(topk, "CHUNK_QUERIES", 4)
    rng, n = np.random.default_rng(7), 12 * 1024
    x = np.eye(12)[np.arange(n) // 1024] * 8 + rng.normal(0, 0.05, (n, 12))
    ids = np.arange(n) * 1_000_003
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id") % 1_024_003_072 == 0).collect()
    assert shipped["extremes"].count() == 12
    chunks = shipped["queries"].select("_chunk").distinct().count()
    assert shipped["ahead"].count() + shipped["rest"].count() < 0.5 * chunks * 12
    whole = np.floor(1024 * x).astype(np.int64)
    for q in (0, 5 * 1024, 11 * 1024):
        scores = whole @ whole[q]
        want = sorted(set(range(n)) - {q}, key=lambda j: (-scores[j], j))[:10]
        assert [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == ids[q]), key=lambda r: r["rank"])] == [(int(ids[j]), int(scores[j])) for j in want]


def test_top_k_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 2048 * 1024)]
    assert topk.top_k(df.limit(0), F.lit(True)).isEmpty() and topk.top_k(df, F.lit(False)).isEmpty()


def test_blocks_are_skipped():
    rng = np.random.default_rng(0)
    ids = np.arange(4000)
    rows = np.round(rng.normal(0, 10, (4000, 8)) + 200 * np.sign(rng.normal(size=(20, 8))).repeat(200, axis=0))
    _, _, scored = topk.search_part(rows[:50], ids[:50], np.full(50, topk._NONE), rows, ids, ids // 200, 10)
    assert scored < 50 * 20 / 2


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("embeddings", "conversations", "documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    got = QUERIES[name](spark, sf_dir)
    want = con.execute(ORACLE_SQL[name]).df()[got.columns]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.to_numpy(object)))


def test_queries_return_a_row_for_each_document(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    wanted = {"op2_ngram_join", "op3_toxicity", "op6_substring_dedup", "op8_token_counts", "op9_language_id", "op10_suffix_dedup"}
    for name in wanted:
        ids = [r[0] for r in QUERIES[name](spark, sf_dir).select("doc_id").collect()]
        assert sorted(ids) == list(range(n)), name


def test_pipeline(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_join", "substring_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    more = spark.createDataFrame([(10_000, "123 456", None, "s", 7), (10_001, None, None, "s", 0), (10_002, "the and of that with", None, "s", 20)], docs.schema)
    docs = docs.unionByName(more)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        rows = {r.doc_id: r for r in out.collect()}
        before = {r.doc_id: r for r in docs.collect()}
        assert rows.keys() <= before.keys()
        if name == "language_id":
            assert before.keys() - rows.keys() == {10_000, 10_001} and rows[10_002].lang == "en"
        docs = spark.createDataFrame(list(rows.values()), docs.schema)
    whole = {r.doc_id: r.n for r in pack(docs).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert whole.keys() == rows.keys()


def test_digest_columns(spark, sf_dir):
    r = QUERIES["op4_chat_format"](spark, sf_dir).where("conv_id = -7").first()
    said = r"\### Assistant: </turn> ok"
    assert (r.n_turns, r.loss_chars) == (2, len(said))
    assert r.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
