from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.plans import engine
from tidemark.request import Request
from tidemark.sources import series, sinks

START = datetime(2023, 1, 1)


def frame(spark, values, start=START, step=60, cell="a"):
    rows = [(cell, start + timedelta(minutes=step * i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "cell string, time timestamp_ntz, value double")


@pytest.fixture(scope="module")
def noise():
    return np.random.default_rng(3).normal(10, 4, 24 * 62)


@pytest.mark.parametrize(("stat", "expected"), [("mean", np.mean), ("sum", np.sum), ("var", lambda x: np.var(x, ddof=1)), ("std", lambda x: np.std(x, ddof=1)), ("min", np.min), ("max", np.max)])
def test_daily_statistics_match_two_pass(spark, noise, stat, expected):
    rows = engine.run(frame(spark, noise), Request(stat, "value", 60, "daily", "daily"), ["cell"]).orderBy("time").collect()
    assert len(rows) == 62
    np.testing.assert_allclose([r.value for r in rows], [expected(d) for d in noise.reshape(62, 24)], atol=1e-6)


def test_result_does_not_depend_on_chunks(spark, noise):
    request = Request("var", "value", 60, "weekly", "weekly")
    whole = frame(spark, noise)
    results = [sorted(map(tuple, engine.run(whole.repartition(n), request, ["cell"]).selectExpr("time", "round(value, 8)").collect())) for n in (1, 5, 17)]
    assert results[0] == results[1] == results[2]


def test_incomplete_periods_are_left_out(spark):
    request = Request("sum", "value", 60, "daily", "daily")
    data = frame(spark, np.ones(24 * 3), start=START + timedelta(hours=5))
    assert [r.time for r in engine.run(data, request, ["cell"]).orderBy("time").collect()] == [START + timedelta(days=1), START + timedelta(days=2)]
    request.completeness = "allow_partial"
    assert engine.run(data, request, ["cell"]).count() == 4


def test_gap_policies(spark, caplog):
    data = frame(spark, np.ones(72)).filter("time <> timestamp_ntz '2023-01-02 03:00:00'")
    run = lambda policy: engine.run(data, Request("sum", "value", 60, "daily", "daily", gap_policy=policy), ["cell"]).collect()
    assert sorted(r.time.day for r in run("ignore")) == sorted(r.time.day for r in run("warn")) == [1, 3]
    assert "steps are missing" in caplog.text
    with pytest.raises(Exception, match="GapError"):
        run("error")
    whole_days = frame(spark, np.ones(96)).filter("day(time) <> 2")  # missing between periods
    with pytest.raises(Exception, match="GapError"):
        engine.run(whole_days, Request("sum", "value", 60, "continuous", "daily"), ["cell"]).collect()


def test_replays_count_once(spark, noise):
    data = frame(spark, noise[:48])
    again = data.unionByName(data.limit(5))
    for freq in ("daily", "continuous"):
        r = Request("sum", "value", 60, freq, "daily")
        results = [sorted(map(tuple, engine.run(d, r, ["cell"]).selectExpr("time", "round(value, 8)").collect())) for d in (data, again)]
        assert results[0] == results[1] and len(results[0]) == 2


def test_histogram_of_listed_edges(spark, noise):
    edges = [0.0, 5.0, 9.0, 20.0]
    for freq in ("daily", "continuous"):
        counts, ends = engine.run(frame(spark, noise[:24]), Request("histogram", "value", 60, freq, "daily", bins=edges), ["cell"])
        assert [r.value for r in counts.orderBy("bin_count").collect()] == np.histogram(noise[:24], edges)[0].tolist()
        assert [r.value for r in ends.orderBy("bin_edges").collect()] == edges


def test_running_histogram_from_a_sketch(spark, noise):
    counts, ends = engine.run(frame(spark, noise), Request("histogram", "value", 60, "continuous", "daily", bins=5), ["cell"])
    last = max(r.time for r in counts.select("time").collect())
    expected, edges = np.histogram(noise, 5)
    found = [r.value for r in counts.filter(F.col("time") == F.lit(last)).orderBy("bin_count").collect()]
    assert np.abs(np.array(found) - expected).max() <= 0.005 * len(noise)
    np.testing.assert_allclose([r.value for r in ends.filter(F.col("time") == F.lit(last)).orderBy("bin_edges").collect()], edges)


def test_rolling_maxima_need_all_their_time(spark):
    data = frame(spark, np.ones(10), step=1440).filter("day(time) not in (3, 4)")
    found = {r.durations: r.value for r in engine.run(data, Request("iams", "value", 1440, "yearly", "yearly", completeness="allow_partial", gap_policy="ignore"), ["cell"]).collect()}
    assert found[1440] == 1.0 and found[8640] == 6.0 and found[10080] is None


def test_decades_count_from_the_first_year(spark):
    data = frame(spark, np.ones(365 * 3), start=datetime(2001, 1, 1), step=1440)
    found = engine.run(data, Request("sum", "value", 1440, "10yearly", "10yearly", completeness="allow_partial"), ["cell"]).collect()
    assert [(r.time.year, r.value) for r in found] == [(2001, 1095.0)]


def test_earliest_of_equal_extremes(spark):
    found = engine.run(frame(spark, [2, 1, 5, 1, 5, 3] * 4), Request("max", "value", 60, "daily", "daily"), ["cell"]).first()
    assert (found.value, found.timings) == (5.0, START + timedelta(hours=2))


def test_noon_period_begins_at_13(spark):
    found = engine.run(frame(spark, np.arange(48)), Request("sum", "value", 60, "daily_noon", "daily_noon"), ["cell"]).collect()
    assert [(r.time, r.value) for r in found] == [(START + timedelta(hours=13), float(sum(range(13, 37))))]


def test_leap_february(spark):
    data = frame(spark, np.ones(29), start=datetime(2024, 2, 1), step=1440)
    assert engine.run(data, Request("sum", "value", 1440, "monthly", "monthly"), ["cell"]).first().value == 29


def test_thresholds_count_reached_magnitudes(spark):
    found = engine.run(frame(spark, [-9, 4, 5, 6] * 6), Request("thresh_exceed", "value", 60, "daily", "daily", thresh_exceed=[-5, 6]), ["cell"]).collect()
    assert {r.thresholds: r.value for r in found} == {-5.0: 12, 6.0: 6}


def test_percentiles_and_histograms(spark, noise):
    day = noise[:24]
    found = engine.run(frame(spark, day), Request("percentile", "value", 60, "daily", "daily", percentile_list=[0.1, 0.5, 0.77]), ["cell"]).orderBy("percentile").collect()
    np.testing.assert_allclose([r.value for r in found], np.percentile(day, [10, 50, 77]))
    counts, edges = engine.run(frame(spark, day), Request("histogram", "value", 60, "daily", "daily", bins=6), ["cell"])
    expected = np.histogram(day, 6)
    assert [r.value for r in counts.orderBy("bin_count").collect()] == expected[0].tolist()
    np.testing.assert_allclose([r.value for r in edges.orderBy("bin_edges").collect()], expected[1])


def test_histogram_of_equal_values(spark):
    counts, edges = engine.run(frame(spark, [3] * 24), Request("histogram", "value", 60, "daily", "daily", bins=2), ["cell"])
    assert sorted(r.value for r in counts.collect()) == [0, 24]
    assert sorted(r.value for r in edges.collect()) == [2.5, 3.0, 3.5]


def test_rolling_maxima(spark):
    values = np.random.default_rng(1).random(365)
    found = engine.run(frame(spark, values, step=1440), Request("iams", "value", 1440, "yearly", "yearly"), ["cell"]).collect()
    for r in found:
        n = r.durations // 1440
        assert r.value == pytest.approx(np.convolve(values, np.ones(n), "valid").max())
    assert len(found) == 7


@pytest.mark.parametrize("stat", ["mean", "sum", "var", "std", "min", "max"])
def test_running_statistics(spark, noise, stat):
    found = engine.run(frame(spark, noise), Request(stat, "value", 60, "continuous", "daily"), ["cell"]).orderBy("time").collect()
    how = {"mean": np.mean, "sum": np.sum, "min": np.min, "max": np.max, "var": lambda x: np.var(x, ddof=1), "std": lambda x: np.std(x, ddof=1)}[stat]
    np.testing.assert_allclose([r.value for r in found], [how(noise[: 24 * (i + 1)]) for i in range(62)], atol=1e-6)


def test_nan_and_null_are_skipped_but_counted(spark):
    found = engine.run(frame(spark, [float("nan"), None] + [2.0] * 22), Request("mean", "value", 60, "daily", "daily"), ["cell"]).collect()
    assert [r.value for r in found] == [2.0]


def test_gaps_steps_and_replays(spark):
    data = frame(spark, range(10)).filter("value not in (4, 5)")
    assert [(r.minutes, r.verdict) for r in series.gaps(data, ["cell"], 60).collect()] == [(180, "error")]
    assert series.infer_step(data, ["cell"]) == 60
    assert series.without_replays(data.unionByName(data), ["cell"]).count() == 8


def test_wrong_variable(spark):
    with pytest.raises(ValueError, match="no variable"):
        engine.run(frame(spark, [1]), Request("mean", "pr", 60, "daily", "daily"), ["cell"])


def test_names_and_parquet(spark, tmp_path):
    request = Request("mean", "value", 60, "daily", "daily")
    assert sinks.file_name(request, datetime(2023, 1, 1), datetime(2023, 1, 3)) == "2023_01_01_to_2023_01_03_value_timestep_60_daily_mean"
    result = engine.run(frame(spark, np.ones(48)), request, ["cell"])
    for _ in range(2):  # writing again replaces
        sinks.write(result, request, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/value_daily_mean").count() == 2


def test_run_with_save_writes_all_kinds(spark, tmp_path):
    data, folder = frame(spark, np.ones(24 * 7), start=datetime(2023, 1, 2)), str(tmp_path)
    names = lambda table: sorted(p.name.removeprefix("file=") for p in (tmp_path / table).glob("file=*"))
    engine.execute(data, Request("raw", "value", 60, save=True, save_filepath=folder), ["cell"])
    assert names("value_raw") == ["2023_01_02_T00_00_to_2023_01_08_T23_00_value_raw_data"]
    engine.execute(data, Request("histogram", "value", 60, "weekly", "weekly", bins=2, save=True, save_filepath=folder), ["cell"])
    assert names("value_weekly_histogram_bin_counts") == ["2023_01_02_value_timestep_60_weekly_histogram_bin_counts"]
    assert len(names("value_weekly_histogram_bin_edges")) == 1
    engine.execute(data, Request("sum", "value", 60, "daily", "weekly", save=True, save_filepath=folder), ["cell"])
    assert names("value_daily_sum") == ["2023_01_02_to_2023_01_08_value_timestep_60_daily_sum"]


def test_month_digests_pool_years(spark):
    daily = frame(spark, range(365 + 31), step=1440)
    found = {r.month: r.n for r in engine.month_digests(daily, ["cell"]).collect()}
    assert found[1] == 62 and found[2] == 28
