"""Toxicity scores from subword-bag embeddings and a linear softmax, trained jointly in numpy.

A text is the bag of the character n-grams of all its words. Its vector is the average of their
embeddings, and a linear softmax over that vector gives the chances of the two classes, so a
misspelling that the model has never seen counts by the n-grams that it shares with the word it
comes from. Embeddings and softmax are fitted together to the labels of whole texts and of their
misspelt copies. How far an n-gram may move is set by the evidence that the training texts give for
it: by how many standard errors the shares of toxic and of other texts that have it differ. How much
evidence that takes, and the scale and shift of the scores, come from training texts that are left
out in turn. As a text is one average, more text of the same kind does not move its score, and a few
toxic words in a very long clean text do not show.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlock.llm.flat import SPACES, flat, lowered, pieces, ranges, word_hashes, words

ORDERS = (3, 4, 5, 6)
BUCKET_BITS = 19
DIMENSIONS = 4
#: A model is fitted on at most this many rows of each label, those whose ids hash lowest, of texts
#: up to this many characters. Scoring has no such bounds.
TRAIN_ROWS = {1: 800, 0: 1400}
TRAIN_CHARS = 200_000
THRESHOLD = 0.7
#: What an average is multiplied by before the softmax: one word in a hundred must be able to decide.
_GAIN = 100.0
#: Steps far under this move a value in proportion to their size.
_STEADY = 1e-4
#: The difference of the biases at the start: a text of unseen n-grams alone is not toxic.
_PRIOR = -4.0
#: Clean texts are also learnt in cuts of fewer words than this.
_CUT_WORDS = 40
#: Share of the toxic texts in the loss; the rest is for whole clean texts and cuts, half each.
_TOXIC_WEIGHT = 0.5
#: How strongly embeddings are drawn to zero.
_DECAY = 1e-6
#: Standard errors of evidence below which an n-gram is not learnt, of which left-out texts choose one;
#: so many more, and it may move freely.
_EVIDENCE, _EVIDENCE_SPAN = (2.0, 3.0), 2.0
#: Parts of the training texts that are left out in turn, and the scales of logits that they choose from.
_FOLDS, _SCALES = 4, tuple(2.0 ** (k / 2) for k in range(-4, 6))

_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def bare(buf: np.ndarray) -> np.ndarray:
    """Lower-case bytes; signs become spaces unless they stand between two letters or digits."""
    data = lowered(buf)
    keep = _LETTERS[data]
    if buf.size > 2:
        inner = keep[:-2] & keep[2:] & ~np.isin(data[1:-1], SPACES)
        keep = keep.copy()
        keep[1:-1] |= inner
    return np.where(keep, data, np.uint8(32))


def bags(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of words between boundary marks, and the word that each belongs to."""
    size = ends - starts + 2
    at = np.concatenate([[0], np.cumsum(size)])
    marked = np.empty(at[-1], np.uint32)
    marked[ranges(at[:-1] + 1, size - 2)] = buf[ranges(starts, size - 2)]
    marked[at[:-1]], marked[at[1:] - 1] = 1, 2
    owner = np.repeat(np.arange(size.size, dtype=np.int32), size)
    left = np.repeat(at[1:], size) - np.arange(at[-1])
    grams, owners = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for k in ORDERS:
        m = marked.size - k + 1
        if m <= 0:
            continue
        h = np.full(m, k * 7919, np.uint32)
        for j in range(k):
            h = (h ^ marked[j : m + j]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(12)
        inside = left[:m] >= k
        grams.append((h >> np.uint32(32 - BUCKET_BITS))[inside].astype(np.int32))
        owners.append(owner[:m][inside])
    return np.concatenate(grams), np.concatenate(owners)


@dataclass
class ToxicModel:
    """Embeddings times the softmax's weights, as the difference of the two classes: one number for
    each n-gram bucket, and one for the biases."""

    bucket: np.ndarray
    bias: float

    def scores(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        data = bare(buf)
        starts, ends, first = words(data, offs)
        total, count = np.zeros(starts.size + 1), np.zeros(starts.size + 1)
        if starts.size:
            _, where, back = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
            grams, owners = bags(data, starts[where], ends[where])
            np.cumsum(np.bincount(owners, self.bucket[grams], where.size)[back], out=total[1:])
            np.cumsum(np.bincount(owners, minlength=where.size)[back], out=count[1:])
        bag = np.maximum(np.diff(count[first]), 1)
        logit = _GAIN * np.diff(total[first]) / bag + self.bias
        return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))


def misspelt(word: bytes, rng: np.random.Generator) -> bytes:
    """The word with one character changed, doubled or left out."""
    i, kind = int(rng.integers(len(word))), int(rng.integers(3))
    if kind == 0:
        return word[:i] + bytes([b"abcdefghijklmnopqrstuvwxyz013457"[int(rng.integers(32))]]) + word[i + 1 :]
    return word[: i + 1] + word[i:] if kind == 1 else word[:i] + word[i + 1 :] or word


@dataclass
class _Examples:
    """Rows to learn from: whole texts, misspelt copies of them, and cuts of clean texts. `doc`, `word` and
    `times` say which words a row has, `gram` and `owner` which n-grams a word has."""

    doc: np.ndarray
    word: np.ndarray
    times: np.ndarray
    gram: np.ndarray
    owner: np.ndarray
    n_words: int
    parent: np.ndarray
    label: np.ndarray
    kind: np.ndarray  # 0 a text, 1 a misspelt copy, 2 a cut

    def within(self, grams: np.ndarray) -> _Examples:
        """The same with these n-grams alone, and the words that have any; all are numbered anew."""
        place = np.full(1 << BUCKET_BITS, -1, np.int32)
        place[grams] = np.arange(grams.size, dtype=np.int32)
        kept = place[self.gram] >= 0
        old, owner = np.unique(self.owner[kept], return_inverse=True)
        number = np.full(self.n_words, -1, np.int32)
        number[old] = np.arange(old.size, dtype=np.int32)
        held = number[self.word] >= 0
        return replace(self, doc=self.doc[held], word=number[self.word[held]], times=self.times[held], gram=place[self.gram[kept]], owner=owner, n_words=old.size)


def _examples(texts: list[str], toxic: np.ndarray, rng: np.random.Generator) -> tuple[_Examples, np.ndarray]:
    """The rows, and the number of n-grams of each."""
    buf, offs = flat(pa.array(texts, pa.string()))
    data = bare(buf)
    starts, ends, first = words(data, offs)
    _, where, back = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
    n, raw = where.size, data.tobytes()
    wrong = [misspelt(raw[a:b], rng) for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)]
    edges = np.concatenate([[0], np.cumsum([len(w) for w in wrong])]).astype(np.int64)
    right, other = bags(data, starts[where], ends[where]), bags(np.frombuffer(b"".join(wrong), np.uint8), edges[:-1], edges[1:])
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    clean = np.flatnonzero(toxic[owner] == 0)
    cuts = np.cumsum(rng.integers(1, _CUT_WORDS, clean.size + 1))
    new = np.searchsorted(cuts, np.arange(clean.size), side="right") + np.cumsum(np.diff(owner[clean], prepend=owner[clean][:1]) != 0)
    _, at, bit = np.unique(new, return_index=True, return_inverse=True)
    m = len(texts)
    rows = np.concatenate([owner, m + owner, 2 * m + bit])
    of_word = np.concatenate([back, n + back, back[clean]])
    pairs, times = np.unique(rows * max(2 * n, 1) + of_word, return_counts=True)
    doc, word = (pairs // max(2 * n, 1)).astype(np.int32), (pairs % max(2 * n, 1)).astype(np.int32)
    parent = np.concatenate([np.arange(m), np.arange(m), owner[clean][at]]).astype(np.int64)
    kind = np.repeat([0, 1, 2], [m, m, at.size])
    gram, by = np.concatenate([right[0], other[0]]), np.concatenate([right[1], n + other[1]])
    made = _Examples(doc, word, times.astype(float), gram, by, 2 * n, parent, toxic[parent].astype(float), kind)
    sizes = np.bincount(by, minlength=2 * n)
    return made, np.maximum(np.bincount(doc, times * sizes[word], parent.size), 1)


def _holders(rows: _Examples, n_texts: int, fold: np.ndarray) -> np.ndarray:
    """How many texts of each fold and label have each n-gram."""
    found = np.zeros((_FOLDS, 2, 1 << BUCKET_BITS), np.int32)
    order = np.argsort(rows.owner, kind="stable")
    grams, at = rows.gram[order], np.searchsorted(rows.owner[order], np.arange(rows.n_words + 1))
    edges = np.searchsorted(rows.doc, np.arange(n_texts + 1))
    for k in range(n_texts):
        w = rows.word[edges[k] : edges[k + 1]]
        found[fold[k], int(rows.label[k]), np.unique(grams[ranges(at[w], at[w + 1] - at[w])])] += 1
    return found


def _evidence(found: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """By how many standard errors the shares of the two labels' texts that have an n-gram differ."""
    share = found.sum(axis=0) / max(1, texts.sum())
    error = np.sqrt(share * (1 - share) * (1 / np.maximum(texts, 1)).sum())
    return np.abs(found[1] / max(1, texts[1]) - found[0] / max(1, texts[0])) / np.maximum(error, 1e-12)


def _weights(rows: _Examples, used: np.ndarray) -> np.ndarray:
    weight = np.zeros(used.size)
    whole = rows.kind < 2
    for group, share in ((whole & (rows.label == 1), _TOXIC_WEIGHT), (whole & (rows.label == 0), (1 - _TOXIC_WEIGHT) / 2), (rows.kind == 2, (1 - _TOXIC_WEIGHT) / 2)):
        group = group & used
        weight[group] = share / max(1, int(group.sum()))
    return weight


def _learn(rows: _Examples, bag: np.ndarray, used: np.ndarray, evidence: np.ndarray, least: float, rounds: int, rate: float, seed: int) -> tuple[np.ndarray, float, np.ndarray]:
    """Embeddings and softmax from the used rows, by full-batch steps with momentum estimates. Gives one
    number for each n-gram (the difference of its two logits), that of the biases, and all rows' logits."""
    least = min(least, evidence.max() / 2)  # hardly any texts give no more evidence than that
    grams = np.flatnonzero(evidence > least)
    freely = np.minimum((evidence[grams] - least) / _EVIDENCE_SPAN, 1)[:, None]
    few = rows.within(grams)
    rng = np.random.default_rng(seed)
    table, soft = np.zeros((grams.size, DIMENSIONS)), rng.normal(0, 1, (DIMENSIONS, 2))
    soft /= np.linalg.norm(soft[:, 1] - soft[:, 0])
    bias = np.array([-_PRIOR / 2, _PRIOR / 2])
    weight, part = _weights(rows, used), few.times * _GAIN / bag[few.doc]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (table, soft, bias)]

    def logits() -> np.ndarray:
        # Of two classes one's chance is the other's complement, so the logits' difference is enough.
        of_word = np.bincount(few.owner, ((freely * table) @ (soft[:, 1] - soft[:, 0]))[few.gram], few.n_words)
        return np.bincount(few.doc, part * of_word[few.word], used.size) + bias[1] - bias[0]

    for t in range(1, rounds + 1):
        slope = weight * (1 / (1 + np.exp(-np.clip(logits(), -60, 60))) - rows.label)
        by_gram = np.bincount(few.gram, np.bincount(few.word, part * slope[few.doc], few.n_words)[few.owner], grams.size)[:, None]
        by_gram = np.concatenate([-by_gram, by_gram], axis=1) * freely
        grads = (by_gram @ soft.T + _DECAY * table, table.T @ by_gram, np.array([-slope.sum(), slope.sum()]))
        for value, grad, (m, v) in zip((table, soft, bias), grads, moments, strict=True):
            m *= 0.9
            m += 0.1 * grad
            v *= 0.99
            v += 0.01 * grad * grad
            value -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + _STEADY)
    both = np.zeros(1 << BUCKET_BITS)
    both[grams] = (freely * table) @ (soft[:, 1] - soft[:, 0])
    return both, float(bias[1] - bias[0]), logits()


def _scaled(logit: np.ndarray, label: np.ndarray, cut: float) -> tuple[float, float]:
    """The scale around the cut, where a text scores THRESHOLD, that makes left-out texts likeliest, and
    the loss that is left."""
    best = (np.inf, 1.0)
    for scale in _SCALES:
        z = np.log(THRESHOLD / (1 - THRESHOLD)) + scale * (logit - cut)
        best = min(best, (float((np.logaddexp(0, z) - label * z).mean()), scale))
    return best[1], best[0]


def _cut_at(logit: np.ndarray, label: np.ndarray) -> float:
    """The logit from which left-out texts are best called toxic: the middle of the cuts whose precision
    and recall together (F1) are highest."""
    if logit.min() == logit.max():  # they tell nothing: nothing is toxic
        return float(logit.max()) - _PRIOR
    order = np.argsort(-logit, kind="stable")
    z, hits = logit[order], np.cumsum(label[order])
    f1 = 2 * hits / (np.arange(1, z.size + 1) + max(1.0, label.sum()))
    best = np.flatnonzero(f1 >= f1.max() - 1e-9)
    return float((z[best[0]] + z[min(best[-1] + 1, z.size - 1)]) / 2)


def fit(texts: list[str], toxic: np.ndarray, rounds: int = 100, rate: float = 0.1, seed: int = 1) -> ToxicModel:
    """A model of all texts, with the evidence, scale and shift that suit texts left out in turn; both
    labels weigh the same. N-grams without evidence keep the zero vector, so they only dilute a text."""
    toxic = np.asarray(toxic).astype(np.int64)
    rng = np.random.default_rng(seed)
    rows, bag = _examples(texts, toxic, rng)
    fold = np.empty(len(texts), np.int64)
    for label in (0, 1):  # each fold gets as many texts of a label
        own = rng.permutation(np.flatnonzero(toxic == label))
        fold[own] = np.arange(own.size) % _FOLDS
    found = _holders(rows, len(texts), fold)
    many = np.array([[int(((fold == f) & (toxic == label)).sum()) for label in (0, 1)] for f in range(_FOLDS)])
    tried = []
    for least in _EVIDENCE:
        logit = np.zeros(rows.parent.size)
        for f in range(_FOLDS):
            out = fold[rows.parent] == f
            evidence = _evidence(found.sum(axis=0) - found[f], many.sum(axis=0) - many[f])
            logit[out] = _learn(rows, bag, ~out, evidence, least, rounds, rate, seed)[2][out]
        held, label = logit[: len(texts)], rows.label[: len(texts)]
        cut = _cut_at(held, label)
        scale, loss = _scaled(held, label, cut)
        tried.append((loss, least, scale, np.log(THRESHOLD / (1 - THRESHOLD)) - scale * cut))
    _, least, scale, shift = min(tried)
    table, bias, _ = _learn(rows, bag, np.ones(rows.parent.size, bool), _evidence(found.sum(axis=0), many.sum(axis=0)), least, rounds, rate, seed)
    return ToxicModel(scale * table, scale * bias + shift)


def train(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: dict[int, int] | None = None) -> ToxicModel | None:
    """A model from the labels (1 toxic, 0 not) that `usable` admits; None unless both labels occur.

    Takes at most TRAIN_ROWS rows of each label, those whose ids hash lowest among the ids with a
    text of at most TRAIN_CHARS characters; no others come to the driver. Of rows that share an id
    the least such text counts, and the greatest label. A null text is no text; labels other than 0
    and 1 are not used.
    """
    short = docs.where(F.length(text_col) <= TRAIN_CHARS).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    known = labels.where(usable & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_label"))
    known = known.join(short.select("_id"), "_id", "left_semi")
    sample = None
    for label, most in (rows or TRAIN_ROWS).items():
        part = known.where(F.col("_label") == label).orderBy(F.xxhash64("_id"), "_id").limit(most)
        sample = part if sample is None else sample.union(part)
    texts = short.join(F.broadcast(sample), "_id").groupBy("_id", "_label").agg(F.min("_text").alias("_text"))
    got = texts.toPandas().sort_values("_id")
    if got["_label"].nunique() < 2:
        return None
    return fit(got["_text"].tolist(), got["_label"].to_numpy())


def score(docs: DataFrame, model: ToxicModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score) of every row: the chance that its text is toxic, 0 to 1.

    Whole texts are read. A null or empty text scores what the bias alone gives; everything scores
    0 if there is no model.
    Repeated rows score alike; other columns are not read, whatever their names.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    chosen = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    if model is None:
        return chosen.select(F.col("_id").alias(id_col), F.lit(0.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = flat(batch.column(1))
            parts = [np.zeros(0)] + [model.scores(part, at) for _, _, part, at in pieces(buf, offs)]
            yield pa.record_batch([batch.column(0), pa.array(np.concatenate(parts))], ["_id", "score"])

    return chosen.mapInArrow(run, f"_id {kind}, score double").select(F.col("_id").alias(id_col), "score")
