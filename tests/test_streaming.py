from datetime import datetime, timedelta

import numpy as np
import pytest

from tidemark.plans import engine
from tidemark.request import Request
from tidemark.streaming import windows


def batches(spark, folder, parts):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, "cell string, time timestamp_ntz, value double").coalesce(1).write.parquet(f"{folder}/{i}")
    return spark.readStream.schema("cell string, time timestamp_ntz, value double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def drained(stream, name, folder):
    query = stream.writeStream.outputMode("update").format("memory").queryName(name).option("checkpointLocation", f"{folder}-c").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return query


@pytest.fixture
def rows():
    values = np.random.default_rng(8).random(72)
    return [("a", datetime(2024, 1, 1) + timedelta(hours=i), float(v)) for i, v in enumerate(values)]


@pytest.mark.parametrize("chunk", [17, 24, 72])
def test_stream_equals_batch_with_replays(spark, tmp_path, rows, chunk):
    parts = [rows[i : i + chunk] for i in range(0, 72, chunk)]
    request = Request("mean", "value", 60, "daily", "daily")
    stream = windows.complete_periods(batches(spark, tmp_path / "in", [*parts, parts[-1]]), request, ["cell"], lateness="2 days")
    drained(stream, f"daily{chunk}", tmp_path / "in")
    batch = engine.run(spark.createDataFrame(rows, "cell string, time timestamp_ntz, value double"), request, ["cell"])
    shown = lambda df: sorted((r.time.isoformat(), round(r.value, 9)) for r in df.collect())
    assert shown(spark.table(f"daily{chunk}")) == shown(batch)


def test_running_moments_skip_replays(spark, tmp_path, rows):
    stream = windows.running_moments(batches(spark, tmp_path / "in", [rows[:30], rows[20:30], rows[30:]]), ["cell"], 60)
    drained(stream, "moments", tmp_path / "in")
    last = spark.table("moments").orderBy("n", ascending=False).first()
    values = [v for _, _, v in rows]
    assert last.n == 72 and last.mean == pytest.approx(np.mean(values)) and last.var == pytest.approx(np.var(values, ddof=1)) and last.total == pytest.approx(sum(values))


def test_gap_is_an_error(spark, tmp_path, rows):
    stream = windows.running_moments(batches(spark, tmp_path / "in", [rows[:5], rows[8:]]), ["cell"], 60)
    with pytest.raises(Exception, match="gap"):
        drained(stream, "gaps", tmp_path / "in").awaitTermination()
