"""Mixing sources: targets against repeated sharing, the order against integrals done numerically, odd rows."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from airlock.llm import mixing
from airlock.llm.ranks import ranked

SCHEMA = "doc_id long, text string, source string, size string, _source int, rank int"


def _docs(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)


def _shared(sizes, weights, budget=1.5, most=2.0):
    """Targets by handing out what is above the caps, again and again."""
    target, rest = dict.fromkeys(sizes, 0.0), budget * sum(sizes.values())
    while rest > 1e-9:
        free = [s for s in sizes if target[s] < most * sizes[s] - 1e-9]
        if not free:
            break
        total, rest_now = sum(weights[s] for s in free), rest
        rest = 0.0
        for s in free:
            target[s] += rest_now * weights[s] / total
            rest += max(0.0, target[s] - most * sizes[s])
            target[s] = min(target[s], most * sizes[s])
    return target


def test_targets_and_odd_rows(spark):
    rng = random.Random(2)
    rows = [(k, " ".join("ab" for _ in range(rng.randrange(40))), rng.choice(["b", "a", "é", "z", None])) for k in range(400)]
    rows += [(1, None, "b"), (2, "", "b"), (None, "one two", "a"), (7, "x y z", "c"), (7, "x y z", "c"), (8, "w\x0bv\x1cu t", None), (9, "long " * 30_000, "big"), (10, None, "empty")]
    docs = _docs(spark, rows)
    got = mixing.placed(docs).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    order = [*sorted(s for s in sizes if s is not None), None]
    want = _shared(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)})
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r.size
        assert r.taken == sum(c.words for c in r.copies) and all(0 <= c.due <= 1 for c in r.copies)
        taken[r.source] += r.taken
    assert all(0 <= want[s] - taken[s] < 1.001 for s in sizes)
    assert sorted((str(r.doc_id), r.size, str(r.source)) for r in got) == sorted((str(d), size(t), str(s)) for d, t, s in rows)
    again = mixing.placed(docs.repartition(7, "text")).collect()
    key = lambda r: (str(r.doc_id), str(r.source), r.size, r.taken, str(r.copies))
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.placed(docs.limit(0)).isEmpty()
    nothing = mixing.placed(_docs(spark, [(1, None, "a"), (2, " ", None)])).collect()
    assert [(r.size, r.target, r.taken, r.copies) for r in nothing] == [(0, 0.0, 0, [])] * 2


def test_order_follows_the_schedules(spark):
    """At every moment the words due so far are the integrals of the schedules."""
    docs = _docs(spark, [(k, "w " * (1 + k % 7), "abc"[k % 3]) for k in range(3000)])
    shapes = {"a": [(0.0, 1.0), (0.25, 0.0), (0.5, 2.0), (1.0, 2.0)], "b": [(0.0, 0.0), (1.0, 3.0)], "c": [(0.0, 1.0), (1.0, 1.0)]}

    def schedules(sources):
        knots = lambda s: F.array(*(F.struct(F.lit(a).alias("at"), F.lit(w).alias("weight")) for a, w in shapes[s]))
        return sources.withColumn("knots", F.coalesce(*(F.when(F.col("_source") == s, knots(s)) for s in shapes)))

    mixed = mixing.placed(docs, budget=1.2, schedules=schedules)
    order = mixing.training_order(mixed.join(docs.select("doc_id", F.col("source").alias("of")), "doc_id")).collect()
    assert [r.due for r in order] == sorted(r.due for r in order)
    rows = mixed.select("doc_id", "source", "target", F.inline("copies")).toPandas()
    t = np.linspace(0, 1, 4001)
    for s, knots in shapes.items():
        w = np.interp(t, *zip(*knots, strict=True))
        area = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2 * np.diff(t))])
        own = rows[rows.source == s].sort_values("due")
        begins = np.concatenate([[0], np.cumsum(own.words)[:-1]]) / own.target.iloc[0]
        assert np.abs(np.interp(own.due, t, area / area[-1]) - begins).max() < 2e-3


def test_ranks_of_hot_groups(spark):
    rows = [("hot" if k % 3 else None, k % 50, k) for k in range(2000)]
    df = spark.createDataFrame(rows, "g string, v int, k int")
    got = ranked(df, ["g"], [F.col("v").desc(), F.col("k").asc()], "ranks").collect()
    for g in ("hot", None):
        own = sorted((r for r in got if r.g == g), key=lambda r: r["rank"])
        assert [(r.v, r.k) for r in own] == sorted(((v, k) for x, v, k in rows if x == g), key=lambda p: (-p[0], p[1])) and [r["rank"] for r in own] == list(range(1, len(own) + 1))
    assert ranked(df.limit(0), ["g"], [F.col("v").asc()], "ranks").isEmpty()


def test_no_python(spark):
    plan = mixing.placed(_docs(spark, [(1, "a", "b")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
