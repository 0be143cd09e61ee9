"""Statistics over input that comes in pieces, with what is still open kept between them.

A piece is aggregated to one partial result per key and period, which is merged with the partial
results kept from the pieces before; periods that are complete by then are given, the others are
kept.  What is kept is a Parquet table of mergeable columns in the request's checkpoint folder,
one version per piece; a version replaces the one before only when it is written whole, so a piece
that fails can be given again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import append_count, expected_steps, period_end, period_start
from ..operators import stats
from ..request import Request, parse_request
from ..sources import sinks
from ..sources.series import observations
from . import bias, engine

#: The statistics whose partial results merge.
MERGEABLE = ("mean", "sum", "var", "std", "min", "max", "thresh_exceed", "percentile")


def checkpoint_folder(r: Request) -> str:
    return f"{r.checkpoint_filepath}/checkpoint_{r.variable}_{r.stat_freq}_{r.output_freq}_timestep_{r.time_step}_{r.stat}"


def _parts(obs: DataFrame, r: Request, keys: list[str], anchor_year: int | None) -> DataFrame:
    """One row of mergeable columns per key and period."""
    word = r.output_freq if r.continuous else r.stat_freq
    held = obs.withColumn("period", period_start(F.col("time"), word, anchor_year))
    return held.groupBy(*keys, "period").agg(*engine.period_ends(), F.lit(False).alias("given"), *_columns(r))


def _columns(r: Request) -> list:
    value = F.col("value")
    if r.stat in ("mean", "sum", "var", "std"):
        return [F.count(value).alias("c"), F.coalesce(F.avg(value), F.lit(0.0)).alias("m"), (F.coalesce(F.var_pop(value), F.lit(0.0)) * F.count(value)).alias("q")]
    if r.stat in ("min", "max"):
        return stats.aggregates(r.stat)
    if r.stat == "thresh_exceed":
        return [stats.exceeds(x).alias(f"t{i}") for i, x in enumerate(r.thresh_exceed)]
    return [F.kll_sketch_agg_double(value, F.lit(stats.sketch_k(r.compression))).alias("_k")]


def _merged(parts: DataFrame, r: Request, groups: list[str]) -> DataFrame:
    """Partial results of the same groups as one; moments by the pairwise formula."""
    ends = [F.sum("n").alias("n"), F.min("label").alias("label"), F.max("last").alias("last"), F.max("given").alias("given")]
    if r.stat in ("mean", "sum", "var", "std"):
        total = F.sum(F.col("c") * F.col("m"))
        pieces = parts.groupBy(*groups).agg(*ends, F.sum("c").alias("c"), total.alias("s"), F.collect_list(F.struct("c", "m", "q")).alias("_p"))
        mean = F.when(F.col("c") > 0, F.col("s") / F.col("c")).otherwise(0.0)
        spread = F.aggregate("_p", F.lit(0.0), lambda a, p: a + p["q"] + p["c"] * (p["m"] - F.col("_m")) * (p["m"] - F.col("_m")))
        return pieces.withColumn("_m", mean).withColumn("q", spread).withColumn("m", F.col("_m")).drop("_p", "_m", "s")
    if r.stat in ("min", "max"):
        return parts.groupBy(*groups).agg(*ends, F.min("_e").alias("_e"))
    if r.stat == "thresh_exceed":
        return parts.groupBy(*groups).agg(*ends, *[F.sum(f"t{i}").alias(f"t{i}") for i in range(len(r.thresh_exceed))])
    return parts.groupBy(*groups).agg(*ends, F.kll_merge_agg_double("_k").alias("_k"))


def _values(parts: DataFrame, r: Request, keys: list[str]) -> DataFrame:
    """The statistic itself from merged columns."""
    if r.stat in ("mean", "sum", "var", "std"):
        var = F.when(F.col("c") > 1, F.col("q") / (F.col("c") - 1)).otherwise(0.0)
        mean = F.when(F.col("c") > 0, F.col("m"))
        value = {"mean": mean, "sum": F.when(F.col("c") > 0, F.col("c") * F.col("m")), "var": var, "std": F.sqrt(var)}[r.stat]
        done = parts.withColumn("value", value).drop("c", "m", "q")
    elif r.stat == "thresh_exceed":
        dims = F.array(*[F.struct(F.lit(float(x)).alias("thresholds"), F.col(f"t{i}").alias("value")) for i, x in enumerate(r.thresh_exceed)])
        done = stats.finished(parts.withColumn("_d", dims).drop(*[f"t{i}" for i in range(len(r.thresh_exceed))]), r.stat)
    else:
        done = stats.finished(parts, r.stat, r.percentile_list or ())
    others = [c for c in done.columns if c not in (*keys, "period", "n", "label", "last", "given")]
    return done.select(*keys, "period", F.col("label").alias("time"), *others)


class Series:
    """A request over input that comes in pieces.

    Points at or before the last one seen of a key are replays and are skipped.  A piece that
    begins before the period that is open for a key goes back in time: what is kept of the
    key from there on is dropped and computed anew (a running statistic begins anew); where it
    begins in the middle of an earlier period, that period can't be completed and is left out.
    ``keep_checkpoints`` leaves the kept table where it is when an output period ends.
    """

    def __init__(self, spark: SparkSession, request: dict | str | Request, keys: list[str], keep_checkpoints: bool = False, anchor_year: int = 1970):
        self.spark, self.keys, self.keep = spark, keys, keep_checkpoints
        self.r = request if isinstance(request, Request) else parse_request(request)
        self.anchor_year = anchor_year
        if self.r.stat not in (*MERGEABLE, "bias_correction"):
            raise ValueError(f"{self.r.stat!r} has no partial results that merge")
        if not self.r.checkpoint_filepath:
            raise KeyError("partial results need a 'checkpoint_filepath'")
        self.folder = checkpoint_folder(self.r)

    def state(self) -> DataFrame | None:
        """What is kept: partial results of open periods, or of all since an output period began."""
        names = [n for n in bias._path(self.spark, self.folder).names() if n.startswith("v")]
        return self.spark.read.parquet(f"{self.folder}/{names[-1]}") if names else None

    def add(self, df: DataFrame, time: str = "time") -> DataFrame:
        """Take a piece in and give what it completes: the keys, ``time``, extra dimensions,
        ``value``; where outputs are longer than periods, whole outputs with ``output_time``.
        What is given is read from the kept table: read or write it before the next piece."""
        r, keys = self.r, self.keys
        if r.stat == "bias_correction":
            return self._add_days(df, time)
        word = r.output_freq if r.continuous else r.stat_freq
        obs, _ = engine.prepared(observations(df, keys, time, r.variable), r, keys, self.anchor_year)
        kept = self.state()
        if kept is not None:
            obs, kept = self._fitted(obs, kept)
        fresh = self._checked(_parts(obs, r, keys, self.anchor_year), kept)
        groups = [*keys, "period"]
        all_ = fresh if kept is None else _merged(kept.select(fresh.columns).unionByName(fresh), r, groups)
        version = self._write(all_)
        whole = self.spark.read.parquet(version)
        if r.continuous:
            return self._running(whole, kept, word)
        done = whole.filter(~F.col("given") & (F.col("n") == expected_steps(F.col("period"), r.stat_freq, r.time_step)))
        if r.output_freq == r.stat_freq:
            given = _values(done, r, keys).drop("period")
            self._forget(whole, done, version)
            return self._saved(given)
        return self._appended(whole, done, version)

    def _fitted(self, obs: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The piece without replays, and what is kept without what the piece goes back behind."""
        keys = self.keys
        word = self.r.output_freq if self.r.continuous else self.r.stat_freq
        seen = kept.groupBy(*keys).agg(F.max("last").alias("_last"), F.max("period").alias("_open"))
        first = obs.groupBy(*keys).agg(F.min("time").alias("_first")).join(seen, keys)
        back = first.filter("_first < _open").select(*keys, "_first", period_start(F.col("_first"), word, self.anchor_year).alias("_from"))
        if self.r.continuous:
            kept = kept.join(back, keys, "left_anti")
        else:
            marked = kept.join(back, keys, "left")
            kept = marked.filter("_from is null or period < _from").drop("_first", "_from")
        fresh = obs.join(seen.join(back, keys, "left_anti"), keys, "left")
        return fresh.filter("_last is null or time > _last").select(obs.columns), kept

    def _checked(self, fresh: DataFrame, kept: DataFrame | None) -> DataFrame:
        """The piece's partial results, with the gap policy seen from what is kept on."""
        r, keys = self.r, self.keys
        if r.gap_policy == "ignore":
            return fresh
        both = fresh.select(*keys, "period", "n", "label", "last", F.lit(True).alias("_new"))
        if kept is not None:
            both = both.unionByName(kept.select(*keys, F.col("period"), "n", "label", "last", F.lit(False).alias("_new")))
            both = both.groupBy(*keys, "period").agg(F.sum("n").alias("n"), F.min("label").alias("label"), F.max("last").alias("last"), F.max("_new").alias("_new"))
        found = both.withColumn("_gap", engine.gap_before(r, keys)).filter("_gap and _new")
        if not found.isEmpty():
            where = found.first().period
            if r.gap_policy == "error":
                raise ValueError(f"GapError: steps are missing in or before the period of {where}")
            engine.log.warning("steps are missing in or before %s", where)
        return fresh

    def _running(self, whole: DataFrame, kept: DataFrame | None, word: str) -> DataFrame:
        """A running statistic at the ends of the output periods that this piece completes."""
        r, keys = self.r, self.keys
        closed = period_end(F.col("period"), word) <= F.col("last") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(r.time_step))
        ends = whole.filter(closed).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("period").alias("_end"), F.col("label").alias("_label"))
        if kept is not None:
            before = kept.filter(closed).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("period").alias("_end"))
            ends = ends.join(before, [*[f"_{k}" for k in keys], "_end"], "left_anti")
        same = F.col("period") <= F.col("_end")
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        upto = whole.join(ends, same).drop(*[f"_{k}" for k in keys]).withColumn("period", F.col("_end"))
        found = _merged(upto, r, [*keys, "period", "_label"]).withColumn("label", F.col("_label")).drop("_label")
        return self._saved(_values(found, r, keys).drop("period"))

    def _appended(self, whole: DataFrame, done: DataFrame, version: str) -> DataFrame:
        """Whole outputs: those that have all the statistics they take from their first one on."""
        r, keys = self.r, self.keys
        output = period_start(F.col("period"), r.output_freq, self.anchor_year).alias("output_time")
        counted = done.withColumn("output_time", output).groupBy(*keys, "output_time").agg(F.count("*").alias("_have"), F.min("period").alias("_first"))
        ready = counted.filter(F.col("_have") >= append_count(F.col("_first"), r.stat_freq, r.output_freq, self.anchor_year)).select(*keys, "output_time")
        mine = done.withColumn("output_time", output).join(ready, [*keys, "output_time"])
        given = _values(mine.drop("output_time"), r, keys).withColumn("output_time", output).drop("period")
        self._forget(whole, mine.select(done.columns), version)
        return self._saved(given)

    def _write(self, parts: DataFrame) -> str:
        names = [n for n in bias._path(self.spark, self.folder).names() if n.startswith("v")]
        number = int(names[-1][1:9]) + 1 if names else 0
        working, version = f"{self.folder}/_{uuid.uuid4().hex}", f"{self.folder}/v{number:08d}"
        parts.write.parquet(working)
        bias._path(self.spark, working).rename(version)
        for name in names[:-1]:
            bias._path(self.spark, f"{self.folder}/{name}").delete()
        return version

    def _forget(self, whole: DataFrame, given: DataFrame, version: str) -> None:
        """Keep what isn't given yet, and of each key the last period, which says what was seen."""
        last = whole.groupBy(*self.keys).agg(F.max("period").alias("period")).withColumn("_last", F.lit(True))
        gone = given.select(*self.keys, "period").withColumn("_gone", F.lit(True))
        left = whole.join(last, [*self.keys, "period"], "left").join(gone, [*self.keys, "period"], "left")
        left = left.withColumn("given", F.col("given") | F.col("_gone").isNotNull())
        self._write((left if self.keep else left.filter("not given or _last")).select(whole.columns))

    def _add_days(self, df: DataFrame, time: str) -> DataFrame:
        """Bias correction: whole days are given and added to the months; raw values are kept until
        their day is whole, and of each key the last one, which says what was seen."""
        r, keys = self.r, self.keys
        raw = obs = observations(df, keys, time, r.variable)
        kept = self.state()
        if kept is not None:
            seen = kept.groupBy(*keys).agg(F.max("time").alias("_last"))
            obs = kept.unionByName(obs.join(seen, keys, "left").filter("_last is null or time > _last").select(obs.columns))
        whole = self.spark.read.parquet(self._write(engine.prepared(obs, r, keys)[0]))
        days = engine.daily_values(whole, keys, r)
        if r.save:
            sinks.write_raw(raw, r)
            if not days.isEmpty():
                bias.add_to_months(self.spark, bias.month_digests(days, keys, r), r, keys)
        ends = days.groupBy(*keys).agg(F.max(F.date_trunc("day", "time").cast("timestamp_ntz") + F.expr("interval 1 day")).alias("_given"))
        left = whole.join(ends, keys, "left").filter("_given is null or time >= _given").select(whole.columns)
        last = whole.groupBy(*keys).agg(F.max("time").alias("time"), F.max_by("value", "time").alias("value")).select(whole.columns)
        self._write(left.unionByName(last).dropDuplicates([*keys, "time"]))
        return self._saved(days)

    def _saved(self, given: DataFrame) -> DataFrame:
        """What is given, written to the request's folder where it asks for that."""
        if self.r.save:
            sinks.write(given, self.r)
        return given


def remove_checkpoints(spark: SparkSession, request: dict | str | Request) -> None:
    """Drop what is kept for a request."""
    r = request if isinstance(request, Request) else parse_request(request)
    bias._path(spark, checkpoint_folder(r)).delete()
