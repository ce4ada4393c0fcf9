"""Event logs as files of steps: many files a step, one step a batch, and steps with hardly any rows."""

import datetime as dt
import tempfile

from pyspark.sql import functions as F

from airlock.plans import fixtures
from airlock.plans.queries import _steps
from airlock.sources.tables import append_stream

START = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def test_a_batch_is_a_step_of_many_files(spark, monkeypatch):
    monkeypatch.setattr(fixtures, "FILE_ROWS", 50)
    seconds = [*range(200), 250, *range(600, 1000)]
    rows = spark.createDataFrame([(k, START + dt.timedelta(seconds=s)) for k, s in enumerate(seconds)], "seq long, ts timestamp")
    beat = spark.createDataFrame([(-1, START + dt.timedelta(hours=1))], rows.schema)
    where = tempfile.mkdtemp(prefix="spark-")
    files = fixtures.in_arrival_order(rows, "ts", F.col("seq"), f"{where}/log", 1, beat)
    assert files == 3
    dealt = spark.read.parquet(f"{where}/log").groupBy(F.input_file_name()).count().collect()
    assert len(dealt) > 6 and max(r["count"] for r in dealt) < 100  # no step in one task
    source = _steps(rows, f"{where}/log", files)
    got = append_stream(source, f"{where}/out", f"{where}/checkpoint")
    got.awaitTermination()
    assert [p["numInputRows"] for p in got.recentProgress] == [200, 1, 0, 200, 200, 1]
    assert spark.read.parquet(f"{where}/out").count() == len(seconds) + 1
