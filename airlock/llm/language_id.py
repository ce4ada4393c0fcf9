"""Language identification by error-correcting output codes.

Each language gets a codeword of bits that differ from every other's in many places. One binary
classifier per bit learns from hashed character n-grams whether the bit is set. A text's language
is the codeword with the least loss against all classifiers' outputs, each bit weighted by how well
its classifier did on that language; a small lead over the second-best codeword flags ambiguity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airlock.llm.flat import flat, lowered, pieces

FEATURES = 4096
ORDERS = (2, 3, 4)
#: Rows that a model is fitted on at most, shared evenly by the languages, and how many of them a
#: language gets at least if there are very many: of each language those whose ids hash lowest.
TRAIN_ROWS, LEAST_ROWS = 4000, 50
#: A lead in probability under this is ambiguous.
CLEAR_LEAD = 0.2
UNDETERMINED = "und"
_ROWS_AT_ONCE = 64


def ngram_counts(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Hashed byte n-gram counts of each text, letters A-Z as a-z, rows of unit length after log(1 + n)."""
    n = len(offs) - 1
    out = np.zeros(n * FEATURES, np.int64)
    data = lowered(buf).astype(np.uint32)
    row = np.repeat(np.arange(n, dtype=np.int64) * FEATURES, np.diff(offs))
    left = np.repeat(offs[1:], np.diff(offs)) - np.arange(buf.size)
    for k in ORDERS:
        if buf.size < k:
            continue
        h = np.full(buf.size - k + 1, k, np.uint32)
        for j in range(k):
            h = h * np.uint32(0x01000193) ^ data[j : buf.size - k + 1 + j]
        h *= np.uint32(0x9E3779B1)
        inside = left[: h.size] >= k
        out += np.bincount((row[: h.size] + (h >> np.uint32(20)))[inside], minlength=out.size)
    x = np.log1p(out.reshape(n, FEATURES).astype(np.float32))
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """One row of +1 and -1 for each of n languages; all splits of up to 6, else the best of random codes."""
    if n < 2:
        return np.ones((n, 1), np.float32)
    if n <= 6:
        splits = np.arange(1, 1 << (n - 1))
        bits = (splits[None, :] >> np.arange(n - 1)[:, None]) & 1
        code = np.vstack([np.zeros((1, splits.size), int), bits])
    else:
        rng = np.random.default_rng(seed)
        length = 8 * int(np.ceil(np.log2(n))) + 7

        def apart(c: np.ndarray) -> int:
            same = (2 * c - 1) @ (2 * c - 1).T
            return int((length - same[~np.eye(n, dtype=bool)]).min())

        code = max((rng.integers(0, 2, (n, length)) for _ in range(200)), key=apart)
        code = code[:, (code.min(0) != code.max(0))]
    return (2 * code - 1).astype(np.float32)


@dataclass
class CodeModel:
    languages: list[str]
    code: np.ndarray
    weight: np.ndarray
    bias: np.ndarray
    trust: np.ndarray  # of each bit, for each language; rows add up to 1

    def losses(self, x: np.ndarray) -> np.ndarray:
        f = x @ self.weight + self.bias
        return np.stack([(np.logaddexp(0, -c * f) * t).sum(1) for c, t in zip(self.code, self.trust, strict=True)], 1)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        e = -2.0 * self.losses(x)
        e = np.exp(e - e.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def fit(x: np.ndarray, names: list[str], rounds: int = 120) -> CodeModel:
    """Logistic classifiers of all bits, fitted together by gradient steps with momentum estimates."""
    languages = sorted(set(names))
    y = np.array([languages.index(v) for v in names])
    code = codewords(len(languages))
    target = code[y] * 0.5 + 0.5
    balance = (len(y) / (len(languages) * np.bincount(y, minlength=len(languages))))[y][:, None].astype(np.float32)
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        d = balance * (p - target) / len(y)
        for value, grad, first, second in ((w, x.T @ d + 1e-5 * w, m, v), (b, d.sum(0), mb, vb)):
            first *= 0.9
            first += 0.1 * grad
            second *= 0.99
            second += 0.01 * grad * grad
            value -= 0.3 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    right = (np.sign(x @ w + b) == code[y]).astype(np.float32)
    trust = np.stack([right[y == k].mean(0) for k in range(len(languages))]) + 1e-3
    return CodeModel(languages, code, w, b, (trust / trust.sum(1, keepdims=True)).astype(np.float32))


def train(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS) -> CodeModel | None:
    """A model of the labelled rows that `usable` admits; None if there are none.

    Of each language at most `rows` divided by the number of languages are used (LEAST_ROWS if that
    is more), those whose ids hash lowest, of one id those whose texts do; equal rows count once.
    Their n-gram counts are made by the executors; only these come to the driver.
    """
    known = docs.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    known = known.select(F.col(lang_col).cast("string").alias("lang"), F.struct(F.xxhash64(id_col).alias("i"), F.xxhash64(text_col).alias("t")).alias("_order"), F.col(text_col).alias("_text"))
    languages = known.select("lang").distinct().count()
    if not languages:
        return None
    each = max(LEAST_ROWS, rows // languages)
    # In parts first, so that no task gets all rows of a common language.
    part = F.pmod("_order.t", F.lit(64))
    keys = known.select("lang", "_order").distinct()
    for within in (["lang", part], ["lang"]):
        rank = F.row_number().over(Window.partitionBy(*within).orderBy("_order"))
        keys = keys.withColumn("_rank", rank).where(F.col("_rank") <= each).drop("_rank")
    cuts = keys.groupBy("lang").agg(F.max("_order").alias("_cut")).collect()  # a row for each language
    cuts = docs.sparkSession.createDataFrame(cuts, "lang string, _cut struct<i: long, t: long>")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = flat(batch.column(1))
            for i in range(0, batch.num_rows, _ROWS_AT_ONCE):
                j = min(i + _ROWS_AT_ONCE, batch.num_rows)
                x = ngram_counts(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                yield pa.record_batch([batch.column(0).slice(i, j - i), pa.array([r.astype("<f2").tobytes() for r in x], pa.binary())], ["lang", "x"])

    bounded = known.join(F.broadcast(cuts), "lang").where(F.col("_order") <= F.col("_cut")).dropDuplicates(["lang", "_order"])
    # Streamed to Python as they arrive; the JVM holds no more than some tasks' rows.
    batches = bounded.select("lang", "_text").mapInArrow(features, "lang string, x binary").toArrow().to_batches()
    return fit(*_in_order(batches))


def _in_order(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, list[str]]:
    """The rows (lang, x) of the batches as one matrix and their languages, in an order that does not
    depend on the one they came in. Batches are taken from the list as they are copied, so the
    driver holds each row once, and no copy of the matrix."""

    def parts(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        column = batch.column("x").cast(pa.large_binary())
        _, offsets, data = column.buffers()
        rows = np.frombuffer(data, "<f2", batch.num_rows * FEATURES, np.frombuffer(offsets, np.int64)[column.offset]).reshape(-1, FEATURES)
        for i in range(0, batch.num_rows, _ROWS_AT_ONCE):
            yield rows[i : i + _ROWS_AT_ONCE].astype(np.float32)

    batches[:] = [b for b in batches if b.num_rows]
    lang = np.array([v for b in batches for v in b.column("lang").to_pylist()], str)
    first, total = (np.concatenate(k) for k in zip(*((x[:, 0], x.sum(1)) for b in batches for x in parts(b)), strict=True))
    order = np.lexsort((first, total, lang))
    place = np.argsort(order)
    out, at = np.empty((lang.size, FEATURES), np.float32), 0
    while batches:
        for x in parts(batches.pop(0)):
            out[place[at : at + len(x)]] = x
            at += len(x)
    return out, lang[order].tolist()


def identify(docs: DataFrame, model: CodeModel | None, text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs with lang_pred, score (probability of that language) and ambiguous (a lead under CLEAR_LEAD).

    Every text is read whole. A null text, or one without a letter, is `und` with score 0, and so
    is every text if there is no model. Repeated rows get equal results. `prefix` goes before the
    three names; columns of the table that already have these names are replaced.
    """
    names = [f"{prefix}{n}" for n in ("lang_pred", "score", "ambiguous")]
    docs = docs.drop(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, score, close = [], [], []
            buf, offs = flat(batch.column(text_col))
            letters = batch.column("_airlock_letters").to_numpy(zero_copy_only=False)
            for i, j, part, at in pieces(buf, offs, 1 << 18):
                for k in range(0, j - i, _ROWS_AT_ONCE):
                    rows = at[k : k + _ROWS_AT_ONCE + 1]
                    p = model.probabilities(ngram_counts(part[rows[0] : rows[-1]], rows - rows[0]))
                    top = np.sort(p, 1)
                    best += [model.languages[b] for b in p.argmax(1)]
                    score += top[:, -1].tolist()
                    close += (top[:, -1] - (top[:, -2] if p.shape[1] > 1 else 0) < CLEAR_LEAD).tolist()
            out = [UNDETERMINED if not ok else b for b, ok in zip(best, letters, strict=True)]
            score = np.where(letters, score, 0.0).astype(float)
            close = np.where(letters, close, True).astype(bool)
            kept = [c for c in batch.schema.names if c != "_airlock_letters"]
            yield pa.record_batch([*(batch.column(c) for c in kept), pa.array(out, pa.string()), pa.array(score), pa.array(close)], [*kept, *names])

    if model is None:
        return docs.withColumns({names[0]: F.lit(UNDETERMINED), names[1]: F.lit(0.0), names[2]: F.lit(True)})
    schema = docs.select("*", F.lit("").alias(names[0]), F.lit(0.0).alias(names[1]), F.lit(True).alias(names[2])).schema
    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    return docs.withColumn("_airlock_letters", letters).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    """Rows kept from training: those whose id's checksum falls in one of `parts`."""
    return F.crc32(F.col(id_col).cast("string")) % parts == part
