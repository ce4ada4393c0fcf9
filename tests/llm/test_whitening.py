"""Whitening against numpy's own decomposition, on the given table, on wide and on odd vectors."""

import math

import numpy as np
import pytest

from airlock.llm import whitening
from airlock.llm.queries import QUERIES


def _brute(vectors):
    x = np.floor(64 * np.array(vectors, np.float64)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    y = (n * x - sums) / n
    values, axes = np.linalg.eigh(y.T @ y / n)
    return n, ((n * x - sums).astype(object) ** 2).sum(axis=1), values[::-1], y @ axes[:, ::-1]


def _same(got, ids, vectors, components=32):
    n, deviation, values, y = _brute(vectors)
    many = min(components, len(values))
    assert len(got) == n * many and set(got.n) == {n} and set(got.component) == set(range(1, many + 1))
    table = got.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    want = y[:, :many] / np.sqrt(values[:many])
    signs = np.sign((table * want).sum(axis=0))
    assert np.abs(table * signs - want).max() < 1e-9
    assert dict(zip(got.vec_id, map(int, got.deviation), strict=True)) == dict(zip(ids, deviation.tolist(), strict=True))
    explained = got.groupby("component").explained.first().to_numpy()
    assert np.abs(explained / (values[:many] / values.sum()) - 1).max() < 1e-9
    cov = np.cov(table.T, bias=True)
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9 and np.abs(cov - np.eye(many)).max() < 1e-9


def test_given_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    _same(QUERIES["op13_whitening"](spark, sf_dir).toPandas(), [r.vec_id for r in rows], [r.embedding for r in rows])


def test_several_blocks_each_way(spark, monkeypatch):
    """More groups of blocks than one, blocks that are not full, and vectors wider than a block."""
    for name, value in (("BLOCK_ROWS", 16), ("BLOCK_COLS", 4), ("GROUP_BLOCKS", 2)):
        monkeypatch.setattr(whitening, name, value)
    rng = np.random.default_rng(4)
    vectors = (rng.normal(size=(150, 10)) @ rng.normal(size=(10, 10)) + 1e4).tolist()
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").repartition(3)
    _same(whitening.whiten(df, components=7).toPandas(), list(range(150)), vectors, 7)


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    vectors = [[float(v) for v in row] for row in rng.normal(size=(40, 3))]
    odd = [(100, None), (101, [1.0, None, 2.0]), (102, [math.nan, 0.0, 0.0]), (103, [math.inf, 0.0, 0.0])]
    rows = [*enumerate(vectors), *odd, (7, vectors[7]), (None, vectors[8]), (50, [1.5]), (51, [])]
    df = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], "vec_id long, embedding array<double>, n int, component string, _x double")
    got = whitening.whiten(df).toPandas()
    full = [v + [0.0] * (3 - len(v)) for k, v in rows if k not in (100, 101, 102, 103)]
    n, deviation, *_ = _brute(full)
    assert len(got) == n * 3 and sorted(map(int, got.deviation)) == sorted(deviation.tolist() * 3)
    twice = got[got.vec_id == 7].sort_values(["component", "whitened"])
    assert len(twice) == 6 and np.allclose(twice.whitened[::2].to_numpy(), twice.whitened[1::2].to_numpy()) and got.vec_id.isna().sum() == 3
    for few in (df.limit(0), df.limit(1), df.where("vec_id in (100, 101)"), df.where("vec_id = 7")):
        assert whitening.whiten(few).isEmpty()


def test_deviations_beyond_64_bits(spark):
    df = spark.createDataFrame([(1, [1e11, 0.0]), (2, [-1e11, 1.0]), (3, [5.0, 9.0])], "vec_id long, embedding array<double>")
    _, deviation, *_ = _brute([[1e11, 0.0], [-1e11, 1.0], [5.0, 9.0]])
    got = {r.vec_id: int(r.deviation) for r in whitening.whiten(df).collect()}
    assert got == dict(zip((1, 2, 3), deviation.tolist(), strict=True)) and max(got.values()) > 1 << 64
    with pytest.raises(ValueError, match="too large"):
        whitening.whiten(spark.createDataFrame([(1, [1e17])], "vec_id long, embedding array<double>"))
