from datetime import datetime, timedelta

import numpy as np
import pytest

from tidemark.plans import bias, engine, incremental
from tidemark.request import Request, parse_request

START = datetime(2023, 1, 1)


def piece(spark, values, first=0, step=60, start=START):
    rows = [("a", start + timedelta(minutes=step * (first + i)), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "cell string, time timestamp_ntz, value double")


def shown(df):
    return sorted((r.time, round(r.value, 9)) for r in df.collect())


@pytest.fixture
def noise():
    return np.random.default_rng(4).normal(10, 4, 24 * 5)


@pytest.mark.parametrize("stat", ["var"])
def test_pieces_and_restarts_give_what_a_batch_gives(spark, tmp_path, noise, stat):
    r = Request(stat, "value", 60, "daily", "daily", checkpoint=True, checkpoint_filepath=str(tmp_path))
    found = []
    for a, b in ((0, 30), (25, 30), (30, 120)):  # two of them repeat what was seen
        found += shown(engine.execute(piece(spark, noise[a:b], a), r, ["cell"]))  # a new job each time
    assert sorted(found) == shown(engine.run(piece(spark, noise), r, ["cell"]))


def test_gap_between_pieces_is_an_error(spark, tmp_path, noise):
    r = Request("mean", "value", 60, "daily", "daily", checkpoint_filepath=str(tmp_path))
    job = incremental.Series(spark, r, ["cell"])
    job.add(piece(spark, noise[:10])).collect()
    with pytest.raises(ValueError, match="GapError"):
        job.add(piece(spark, noise[12:20], 12))
    assert shown(job.add(piece(spark, noise[10:24], 10))) == shown(engine.run(piece(spark, noise[:24]), r, ["cell"]))


def test_going_back_begins_anew(spark, tmp_path, noise):
    r = Request("mean", "value", 60, "daily", "daily", checkpoint_filepath=str(tmp_path))
    job = incremental.Series(spark, r, ["cell"])
    job.add(piece(spark, noise[:40])).collect()
    again = job.add(piece(spark, noise[:24] + 1))
    assert [v for _, v in shown(again)] == [pytest.approx(noise[:24].mean() + 1)]


def test_outputs_wait_for_all_their_periods_and_roll_back(spark, tmp_path, noise):
    r = Request("sum", "value", 60, "daily", "weekly", checkpoint_filepath=str(tmp_path))
    job = incremental.Series(spark, r, ["cell"])
    values, monday = np.arange(24 * 7.0), datetime(2023, 1, 2)
    assert job.add(piece(spark, values[: 24 * 4], start=monday)).count() == 0
    assert job.add(piece(spark, values[24 * 2 : 24 * 5] * 2, 24 * 2, start=monday)).count() == 0  # back to day 3
    rows = job.add(piece(spark, values[24 * 5 :], 24 * 5, start=monday)).orderBy("time").collect()
    days = values.reshape(7, 24).sum(axis=1)
    assert [r.value for r in rows] == [*days[:2], *(2 * days[2:5]), *days[5:]] and {r.output_time for r in rows} == {monday}


def test_running_statistic_in_pieces(spark, tmp_path, noise):
    r = Request("mean", "value", 60, "continuous", "daily", checkpoint_filepath=str(tmp_path))
    job = incremental.Series(spark, r, ["cell"])
    found = []
    for a, b in ((0, 30), (30, 100), (100, 120)):
        found += shown(job.add(piece(spark, noise[a:b], a)))
    assert [v for _, v in found] == [pytest.approx(noise[: 24 * (i + 1)].mean()) for i in range(5)]


def test_percentiles_of_pieces_come_from_a_sketch(spark, tmp_path, noise):
    r = Request("percentile", "value", 60, "daily", "daily", percentile_list=[0.5], checkpoint_filepath=str(tmp_path))
    job = incremental.Series(spark, r, ["cell"])
    job.add(piece(spark, noise[:7])).collect()
    (row,) = job.add(piece(spark, noise[7:24], 7)).collect()
    assert abs((noise[:24] <= row.value).mean() - 0.5) <= 0.05


def test_checkpoints_are_removed_or_kept(spark, tmp_path, noise):
    r = Request("mean", "value", 60, "daily", "daily", checkpoint_filepath=str(tmp_path))
    for keep, n in ((False, 1), (True, 5)):
        incremental.remove_checkpoints(spark, r)
        job = incremental.Series(spark, r, ["cell"], keep_checkpoints=keep)
        job.add(piece(spark, noise)).collect()
        assert job.state().count() == n
    incremental.remove_checkpoints(spark, r)
    assert job.state() is None


def test_bias_correction_gives_days_raw_values_and_months(spark, tmp_path):
    r = parse_request({"stat": "bias_correction", "variable": "pr", "time_step": 60, "stat_freq": "daily", "output_freq": "daily", "save": True, "checkpoint": True, "save_filepath": str(tmp_path / "out"), "checkpoint_filepath": str(tmp_path / "state")})
    values = np.arange(48.0)
    days = []
    for i in range(0, 48, 12):
        days += shown(engine.execute(piece(spark, values[i : i + 12], i).withColumnRenamed("value", "pr"), r, ["cell"]))
    assert [v for _, v in days] == [values[:24].sum(), values[24:].sum()]
    raw = list((tmp_path / "out" / "pr_raw").glob("file=*"))
    months = spark.read.parquet(bias.digest_folder(r)).collect()
    assert len(raw) == 4 and [(m.month, m.n) for m in months] == [(1, 2)]
    assert spark.read.parquet(str(tmp_path / "out" / "pr_daily_bias_correction")).count() == 2


def test_bias_adjust_is_the_callers(spark):
    r = Request("bias_correction", "value", 60, "daily", "daily", bias_adjust=True)
    data = piece(spark, np.ones(24))
    with pytest.raises(ImportError):
        bias.bias_correction(data, r, ["cell"])
    daily, raw, digests = bias.bias_correction(data, r, ["cell"], adjust=lambda df, r: df.withColumn("value", df.value * 3))
    assert daily.first().value == 3.0 and raw.count() == 24 and digests.first().n == 1
