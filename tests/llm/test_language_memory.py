"""What the driver holds while a language model is trained."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from airlock.llm import language_id


def test_training_holds_one_matrix_of_counts(spark, monkeypatch):
    """Rows as they come (half as wide) and one matrix of them; two matrices would be twice its size and more."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    seen, real = [], language_id.fit
    monkeypatch.setattr(language_id, "fit", lambda x, names: (seen.append(x.nbytes), real(x, names))[1])
    tracemalloc.start()
    language_id.train(docs, F.lit(True))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen[0] > 8 << 20 and peak < 1.8 * seen[0]


def test_order_of_training_rows_is_their_own():
    """Whatever batches the rows come in, sliced or empty ones too, the matrix and the languages are the same."""
    rng = np.random.default_rng(3)
    x = rng.random((150, language_id.FEATURES)).astype("<f2")
    lang = [("en", "de", "fr")[k % 3] for k in range(150)]

    def batches(order, cuts):
        rows = pa.record_batch([pa.array([lang[k] for k in order]), pa.array([x[k].tobytes() for k in order], pa.binary())], ["lang", "x"])
        return [rows.slice(i, j - i) for i, j in zip([0, *cuts], [*cuts, 150], strict=True)]

    given = batches(range(150), [])
    one, names = language_id._in_order(given)
    assert not given and names == sorted(lang) and one.dtype == np.float32
    assert sorted(r.tobytes() for r in one) == sorted(r.tobytes() for r in x.astype(np.float32))
    assert all(lang[int(np.flatnonzero((x.astype(np.float32) == r).all(1))[0])] == v for r, v in zip(one, names, strict=True))
    other, again = language_id._in_order(batches(rng.permutation(150).tolist(), [0, 7, 7, 90]))
    assert again == names and (other == one).all()
