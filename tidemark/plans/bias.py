"""What bias correction gives: daily values, raw values and a digest of each calendar month."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stats import sketch_k
from ..request import Request, parse_request
from ..sources.series import observations
from . import engine

Adjust = Callable[[DataFrame, Request], DataFrame]


def bias_correction(df: DataFrame, request: dict | str | Request, keys: list[str], time: str = "time", adjust: Adjust | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Daily values, the raw values they come from, and ``month, n, sketch`` of each calendar month.

    With ``bias_adjust`` the raw values go through ``adjust`` first, which is the caller's: the
    transform itself isn't part of this engine, and a request for it without one is an ImportError.
    """
    r = request if isinstance(request, Request) else parse_request(request)
    raw = observations(df, keys, time, r.variable)
    if r.bias_adjust:
        if adjust is None:
            raise ImportError("bias_adjust needs a function that adjusts the values")
        raw = adjust(raw, r)
    obs, _ = engine.prepared(raw, r, keys)
    daily = engine.daily_values(obs, keys, r)
    return daily, raw, month_digests(daily, keys, r)


def month_digests(daily: DataFrame, keys: list[str], r: Request) -> DataFrame:
    """A mergeable sketch of the daily values of each calendar month."""
    return daily.groupBy(*keys, F.month("time").alias("month")).agg(F.count("value").alias("n"), F.kll_sketch_agg_double("value", F.lit(sketch_k(r.compression))).alias("sketch"))


def merged(digests: DataFrame, keys: list[str]) -> DataFrame:
    """One digest per key and month from several."""
    return digests.groupBy(*keys, "month").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def digest_folder(r: Request) -> str:
    return f"{r.save_filepath}/months_{r.variable}_{r.stat}"


def add_to_months(spark: SparkSession, digests: DataFrame, r: Request, keys: list[str]) -> DataFrame:
    """Add digests to the ones that are kept beside the results, and give the sum.

    The sum is written beside the old one first and then takes its place, so that a job that ends
    in between leaves one or the other.
    """
    place = digest_folder(r)
    old = _path(spark, place)
    found = digests if not old.exists() else merged(spark.read.parquet(place).unionByName(digests), keys)
    fresh = f"{place}-{uuid.uuid4().hex}"
    found.write.parquet(fresh)
    old.delete()
    _path(spark, fresh).rename(place)
    return spark.read.parquet(place)


class _path:
    """A folder in whatever file system Spark has for its path."""

    def __init__(self, spark: SparkSession, place: str):
        self.jvm = spark.sparkContext._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path(place)
        self.files = self.path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        return self.files.exists(self.path)

    def delete(self) -> None:
        self.files.delete(self.path, True)

    def rename(self, place: str) -> None:
        self.files.rename(self.path, self.jvm.org.apache.hadoop.fs.Path(place))

    def names(self) -> list[str]:
        return sorted(f.getPath().getName() for f in self.files.listStatus(self.path)) if self.exists() else []
