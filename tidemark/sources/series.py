"""Making a long series: key columns, ``time`` (TIMESTAMP_NTZ) and ``value`` (DOUBLE)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.calendar import period_start


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(df: DataFrame, keys: list[str], time: str, variable: str) -> DataFrame:
    """One row per key and time; NaN becomes NULL, which statistics skip but counts include."""
    if variable not in df.columns:
        raise ValueError(f"no variable {variable!r} in {df.columns}")
    value = F.col(variable).cast("double")
    return df.select(*keys, F.col(time).cast("timestamp_ntz").alias("time"), F.when(~F.isnan(value), value).alias("value"))


def without_replays(obs: DataFrame, keys: list[str]) -> DataFrame:
    """Each key and time once; of different values at one time the smallest stays, so that it
    doesn't depend on the order in which they came."""
    return obs.groupBy(*keys, "time").agg(F.min("value").alias("value"))


def from_array(df: DataFrame, keys: list[str], column: str, cell: str = "cell") -> DataFrame:
    """A grid held as an array per row, as one row per cell."""
    return df.select(*keys, F.posexplode(column).alias(cell, "value"))


def between(obs: DataFrame, start: str, end: str) -> DataFrame:
    """A half-open range of time, which reaches the Parquet scan as a filter."""
    return obs.filter((F.col("time") >= F.lit(start).cast("timestamp_ntz")) & (F.col("time") < F.lit(end).cast("timestamp_ntz")))


def gaps(obs: DataFrame, keys: list[str], step_minutes: int) -> DataFrame:
    """Neighbouring times that aren't a step apart: ``last, time, minutes, verdict``; the verdict
    is error from two steps on, else warning."""
    w = Window.partitionBy(*keys).orderBy("time")
    pairs = obs.withColumn("last", F.lag("time").over(w)).withColumn("minutes", F.timestamp_diff("MINUTE", F.col("last"), F.col("time")))
    verdict = F.when(F.col("minutes") >= 2 * step_minutes, "error").otherwise("warning")
    return pairs.filter(F.col("minutes") != step_minutes).select(*keys, "last", "time", "minutes", verdict.alias("verdict"))


def infer_step(obs: DataFrame, keys: list[str]) -> int | None:
    """The most frequent distance of neighbouring times, in minutes."""
    w = Window.partitionBy(*keys).orderBy("time")
    steps = obs.select(F.timestamp_diff("MINUTE", F.lag("time").over(w), F.col("time")).alias("m")).filter("m > 0")
    row = steps.groupBy("m").count().orderBy(F.desc("count"), "m").first()
    return row["m"] if row else None


def resample(df: DataFrame, keys: list[str], time: Column, value: Column, word: str) -> DataFrame:
    """A regular series from events: one aggregate value per key and period."""
    return df.groupBy(*keys, period_start(time, word).alias("time")).agg(value.alias("value"))


def zero_filled(obs: DataFrame, keys: list[str]) -> DataFrame:
    """Every day from the first to the last for every key, 0 where it has none.

    The calendar is a sequence per key, so no cross join is needed."""
    ends = obs.agg(F.min("time").alias("lo"), F.max("time").alias("hi")).first()
    days = F.explode(F.sequence(F.lit(ends.lo), F.lit(ends.hi), F.expr("interval 1 day"))).alias("time")
    frame = obs.select(*keys).distinct().select(*keys, days)
    return frame.join(obs, [*keys, "time"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
