"""Structured Streaming: periods as they complete, whatever the micro-batches were."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.calendar import FIXED_MINUTES, NOON_START, canonical_word, expected_steps, period_start
from ..operators import stats
from ..plans.engine import size_of
from ..request import Request, parse_request
from ..sources.series import observations


def complete_periods(stream: DataFrame, request: dict | Request, keys: list[str], time: str = "time", lateness: str = "1 hour") -> DataFrame:
    """For ``update`` mode: a period's row as soon as its last point is there.

    Replayed points are dropped within the watermark.  A period is complete when it has all its
    points, so each comes once.  Periods of a fixed length are windows of event time, whose state
    the watermark drops, complete or not; of months and years a row per key and period stays.
    The session's time zone must be UTC, as time stamps have none.
    """
    r = request if isinstance(request, Request) else parse_request(request)
    seen = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness).dropDuplicates([*keys, time])
    aggregates = [F.count("*").alias("n"), F.min("time").alias("label"), *stats.aggregates(r.stat, r.thresh_exceed, r.percentile_list or (), size_of(r))]
    window = _window(r.stat_freq)
    if window is None:
        held = observations(seen, keys, time, r.variable).withColumn("period", period_start(F.col("time"), r.stat_freq))
        whole = held.groupBy(*keys, "period").agg(*aggregates)
    else:
        value = F.col(r.variable).cast("double")
        held = seen.select(*keys, F.col(time).alias("time"), F.when(~F.isnan(value), value).alias("value"))
        whole = held.groupBy(*keys, window.alias("_w")).agg(*aggregates).withColumn("period", F.col("_w.start").cast("timestamp_ntz")).drop("_w")
    done = whole.filter(F.col("n") == expected_steps(F.col("period"), r.stat_freq, r.time_step))
    named = done.select(*keys, F.col("label").cast("timestamp_ntz").alias("time"), *[c for c in done.columns if c not in (*keys, "period", "label", "n")])
    found = stats.finished(named, r.stat, r.percentile_list or ())
    return found.withColumn("timings", F.col("timings").cast("timestamp_ntz")) if "timings" in found.columns else found


def _window(word: str) -> Column | None:
    """Periods of a fixed length as windows of event time; None for months and years."""
    word = canonical_word(word)
    if word not in FIXED_MINUTES:
        return None
    length = f"{FIXED_MINUTES[word]} minutes"
    start = {"weekly": "4 days", "daily_noon": f"{NOON_START} hours"}.get(word, "0 minutes")  # the epoch is a Thursday
    return F.window(F.col("time"), length, length, start)


class GapError(ValueError):
    """Data jumped ahead by two steps or more."""


def running_moments(stream: DataFrame, keys: list[str], step_minutes: int, gap_policy: str = "error") -> DataFrame:
    """Running count, mean, variance and sum of each key, one row per key and micro-batch.

    State is six numbers per key.  Points at or before the last one seen are skipped as replays;
    a jump of two steps or more is an error, or with ``gap_policy`` ignore only counted.
    Needs columns ``time`` and ``value``; partial results merge by the pairwise formula.
    """
    out = ", ".join(f"{k} {dict(stream.dtypes)[k]}" for k in keys) + ", time timestamp, n long, mean double, var double, total double, gaps long"
    kept = "last long, n long, mean double, m2 double, total double, gaps long"

    def advance(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, n, mean, m2, total, gaps = state.get if state.exists else (-(1 << 62), 0, 0.0, 0.0, 0.0, 0)
        rows = pd.concat(list(parts)).sort_values("time", kind="stable").drop_duplicates("time")
        stamps = rows["time"].astype("datetime64[us]").astype("int64")
        rows, stamps = rows[stamps > last], stamps[stamps > last]
        if len(rows):
            before = [last if state.exists else None, *stamps.tolist()[:-1]]
            jumps = sum(b is not None and t - b >= 2 * step_minutes * 60_000_000 for b, t in zip(before, stamps.tolist(), strict=True))
            if jumps and gap_policy == "error":
                raise GapError(f"{jumps} gaps for {key}")
            values = rows["value"].to_numpy(float)
            values = values[~np.isnan(values)]  # NaN and NULL are skipped, as in a batch
            if len(values):
                m, c = float(values.mean()), len(values)
                d = m - mean
                m2 += float(((values - m) ** 2).sum()) + d * d * n * c / (n + c)
                mean += d * c / (n + c)
                n, total = n + c, total + float(values.sum())
            gaps, last = gaps + jumps, int(stamps.iloc[-1])
            state.update((last, n, mean, m2, total, gaps))
            yield pd.DataFrame([(*key, pd.Timestamp(last, unit="us"), n, mean, m2 / (n - 1) if n > 1 else 0.0, total, gaps)], columns=[*keys, "time", "n", "mean", "var", "total", "gaps"])

    typed = stream.withColumn("time", F.col("time").cast("timestamp"))
    return typed.groupBy(*keys).applyInPandasWithState(advance, out, kept, "update", GroupStateTimeout.NoTimeout)
