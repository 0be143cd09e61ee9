"""Names of result files, and writing results as Parquet."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..request import Request

#: How a period's time stamp is written in a file name.
STAMPS = {"hour": "%Y_%m_%d_T%H", "day": "%Y_%m_%d", "month": "%Y_%m", "year": "%Y", "raw": "%Y_%m_%d_T%H_%M"}
_SPARK_STAMPS = {"hour": "yyyy_MM_dd_'T'HH", "day": "yyyy_MM_dd", "month": "yyyy_MM", "year": "yyyy"}


def _unit(word: str) -> str:
    if word in ("daily", "weekly"):
        return "day"
    if word in ("monthly", "3monthly"):
        return "month"
    return "year" if word in ("yearly", "10yearly") else "hour"


def file_name(r: Request, first: datetime, last: datetime | None = None, part: str = "") -> str:
    """``<stamp>[_to_<stamp>]_<variable>_timestep_<minutes>_<frequency>_<stat>[<part>]``."""
    word = r.output_freq if r.continuous else r.stat_freq
    stamp = STAMPS["raw" if r.stat == "raw" else _unit(word)]
    when = first.strftime(stamp) + (f"_to_{last.strftime(stamp)}" if last is not None and last != first else "")
    if r.stat == "raw":
        return f"{when}_{r.variable}_raw_data"
    return f"{when}_{r.variable}_timestep_{r.time_step}_{r.stat_freq}_{r.stat}{part}"


def named(df: DataFrame, r: Request, part: str = "") -> DataFrame:
    """Result rows with the name of the file they belong to: one of a period, or of all the periods
    of an output."""
    stamp = lambda t: F.date_format(t, _SPARK_STAMPS[_unit(r.output_freq if r.continuous else r.stat_freq)])
    when = stamp(F.col("time"))
    if "output_time" in df.columns:
        mine = Window.partitionBy("output_time")
        first, last = stamp(F.min("time").over(mine)), stamp(F.max("time").over(mine))
        when = F.when(first == last, first).otherwise(F.concat(first, F.lit("_to_"), last))
    return df.withColumn("file", F.concat(when, F.lit(f"_{r.variable}_timestep_{r.time_step}_{r.stat_freq}_{r.stat}{part}")))


def write(df: DataFrame | tuple[DataFrame, DataFrame], r: Request, folder: str | None = None) -> None:
    """One partition folder per file name, replacing those that are written again; a histogram's
    counts and edges are files of their own, and so is what was read where all of it is asked for."""
    if isinstance(df, tuple):
        for one, part in zip(df, ("_bin_counts", "_bin_edges"), strict=True):
            _write(named(one, r, part), f"{folder or r.save_filepath}/{r.variable}_{r.stat_freq}_{r.stat}{part}")
    elif r.stat == "raw":
        write_raw(df, r, folder)
    else:
        _write(named(df, r), f"{folder or r.save_filepath}/{r.variable}_{r.stat_freq}_{r.stat}")


def write_raw(df: DataFrame, r: Request, folder: str | None = None) -> None:
    """The values as they came, in one folder named by their first and last time."""
    ends = df.agg(F.min("time").alias("a"), F.max("time").alias("b")).first()
    if ends.a is not None:
        name = file_name(Request("raw", r.variable, r.time_step), ends.a, ends.b)
        _write(df.withColumn("file", F.lit(name)), f"{folder or r.save_filepath}/{r.variable}_raw")


def _write(df: DataFrame, target: str) -> None:
    df.write.mode("overwrite").partitionBy("file").option("partitionOverwriteMode", "dynamic").parquet(target)


def history(r: Request, now: datetime) -> str:
    """The text that goes beside results; it holds the clock, so it stays out of the rows."""
    return json.dumps({"history": f"{now:%Y-%m-%d %H:%M:%S} {r.stat} of {r.variable} every {r.stat_freq}", "time_step": r.time_step})
