"""From a request to a DataFrame."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import expected_steps, period_end, period_start
from ..operators import stats
from ..request import PRECIPITATION, Request, parse_request
from ..sources.series import observations, without_replays

log = logging.getLogger("tidemark")

Result = DataFrame | tuple[DataFrame, DataFrame]


def run(df: DataFrame, request: dict | str | Request, keys: list[str], time: str = "time", anchor_year: int | None = None) -> Result:
    """Compute a request over a batch: key columns, ``time`` (the period's first stamp), extra
    dimensions, ``value``; a histogram gives two frames, counts and edges.

    Only complete periods are returned unless the request allows partial ones.  The result
    doesn't depend on how the input was split into files or chunks: a key and time counts once
    (unless ``replays`` says that none is repeated), and a gap of two steps or more is an error
    when the result is read (unless ``gap_policy`` says otherwise).  Decades count from
    ``anchor_year``, by default the first year there is.
    """
    r = request if isinstance(request, Request) else parse_request(request)
    obs = observations(df, keys, time, r.variable)
    if r.stat == "raw":
        return obs
    obs, anchor_year = prepared(obs, r, keys, anchor_year)
    if r.stat == "bias_correction":
        return daily_values(obs, keys, r)
    if r.continuous:
        return running(obs, r, keys, anchor_year)
    held = obs.withColumn("period", period_start(F.col("time"), r.stat_freq, anchor_year))
    groups = [*keys, "period"]
    if r.stat == "histogram":
        return tuple(_labelled(_complete(_watched(x, r, keys), r), r, keys, anchor_year) for x in stats.histogram(held, groups, r.bins, r.range))
    if r.stat == "iams":
        return _labelled(_complete(_watched(stats.rolling_maxima(held, keys, groups, r.time_step), r, keys), r), r, keys, anchor_year)
    whole = held.groupBy(*groups).agg(*period_ends(), *stats.aggregates(r.stat, r.thresh_exceed, r.percentile_list or (), size_of(r)))
    return _labelled(stats.finished(_complete(_watched(whole, r, keys), r), r.stat, r.percentile_list or ()), r, keys, anchor_year)


def execute(df: DataFrame, request: dict | str | Request, keys: list[str], time: str = "time", anchor_year: int | None = None) -> Result:
    """:func:`run`, with what the request asks for beside it: with ``save`` the result is written
    to its folder; with ``checkpoint`` the input is one piece of a series, and only what it
    completes is given (see :mod:`tidemark.plans.incremental`)."""
    from ..sources import sinks
    from .incremental import MERGEABLE, Series

    r = request if isinstance(request, Request) else parse_request(request)
    if r.checkpoint and r.stat in (*MERGEABLE, "bias_correction"):
        return Series(df.sparkSession, r, keys, anchor_year=anchor_year or 1970).add(df, time)
    found = run(df, r, keys, time, anchor_year)
    if r.save:
        sinks.write(found, r)
    return found


def period_ends() -> list[Column]:
    """What every aggregate of a period has beside its statistic."""
    return [F.count("*").alias("n"), F.min("time").alias("label"), F.max("time").alias("last")]


def prepared(obs: DataFrame, r: Request, keys: list[str], anchor_year: int | None = None) -> tuple[DataFrame, int | None]:
    """The observations without replays, and the year from which decades count."""
    if r.replays == "drop":
        obs = without_replays(obs, keys)
    if anchor_year is None and "10yearly" in (r.stat_freq, r.output_freq):
        first = obs.agg(F.min("time").alias("t")).first().t
        anchor_year = first.year if first else 1970
    return obs, anchor_year


def size_of(r: Request) -> int | None:
    """The size of a sketch where the request asks for one."""
    return stats.sketch_k(r.compression) if r.percentile_method == "sketch" else None


def gap_before(r: Request, keys: list[str]) -> Column:
    """Over one row per period: whether steps are missing in it or between it and the one before,
    told from the periods' ends and numbers of points alone."""
    before = F.lag("last").over(Window.partitionBy(*keys).orderBy("period"))
    between = F.timestamp_diff("MINUTE", before, F.col("label")) >= 2 * r.time_step
    inside = F.timestamp_diff("MINUTE", F.col("label"), F.col("last")) - (F.col("n") - 1) * r.time_step >= r.time_step
    return F.coalesce(between, F.lit(False)) | inside


def gap_periods(df: DataFrame, r: Request, keys: list[str], time: str = "time") -> DataFrame:
    """``period, label, last, n`` of the periods that the gap policy is about."""
    obs, anchor = prepared(observations(df, keys, time, r.variable), r, keys)
    word = r.output_freq if r.continuous else r.stat_freq
    whole = obs.groupBy(*keys, period_start(F.col("time"), word, anchor).alias("period")).agg(*period_ends())
    return whole.withColumn("_gap", gap_before(r, keys)).filter("_gap").drop("_gap")


def _watched(whole: DataFrame, r: Request, keys: list[str]) -> DataFrame:
    """whole, with the request's gap policy."""
    if r.gap_policy == "ignore":
        return whole
    seen = whole.withColumn("_gap", gap_before(r, keys))
    if r.gap_policy == "warn":
        if not (found := seen.filter("_gap")).isEmpty():
            log.warning("steps are missing in or before %s", found.first().period)
        return whole
    message = F.concat(F.lit("GapError: steps are missing in or before the period of "), F.col("period").cast("string"))
    return seen.filter(F.when(F.col("_gap"), F.raise_error(message).cast("boolean")).otherwise(True)).drop("_gap")


def _complete(df: DataFrame, r: Request) -> DataFrame:
    if r.completeness == "allow_partial":
        return df
    return df.filter(F.col("n") == expected_steps(F.col("period"), r.stat_freq, r.time_step))


def _labelled(df: DataFrame, r: Request, keys: list[str], anchor_year: int | None) -> DataFrame:
    """The label in the period's place; where outputs are longer than periods, also their start."""
    out = [] if r.output_freq == r.stat_freq else [period_start(F.col("period"), r.output_freq, anchor_year).alias("output_time")]
    others = [c for c in df.columns if c not in (*keys, "period", "label", "last", "n")]
    return df.select(*keys, *out, F.col("label").alias("time"), *others)


def running(obs: DataFrame, r: Request, keys: list[str], anchor_year: int | None = None) -> Result:
    """A statistic since the series began, at the end of each output period.

    Each period is aggregated first and only these partial results are accumulated in order, so a
    single long series still spreads over all tasks; exact percentiles alone accumulate the
    values, those of a sketch a sketch of bounded size.
    """
    held = obs.withColumn("period", period_start(F.col("time"), r.output_freq, anchor_year))
    order = Window.partitionBy(*keys).orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    closed = period_end(F.col("period"), r.output_freq) <= F.col("last") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(r.time_step))
    ends = period_ends()
    if r.stat == "histogram":
        return running_histogram(held, r, keys, order, closed)
    if r.stat == "percentile" and size_of(r) is not None:
        parts = _watched(held.groupBy(*keys, "period").agg(*ends, *stats.aggregates("percentile", k=size_of(r))), r, keys)
        upto = parts.withColumn("_k", F.kll_merge_agg_double("_k").over(order)).filter(closed)
        return stats.finished(upto, "percentile", r.percentile_list).select(*keys, F.col("label").alias("time"), "percentile", "value")
    if r.stat == "percentile":
        values = _watched(held.groupBy(*keys, "period").agg(*ends, F.collect_list("value").alias("_v")), r, keys)
        # The list of all values so far is the percentile's own input.
        upto = values.withColumn("_all", F.flatten(F.collect_list("_v").over(order))).filter(closed)
        rows = upto.select(*keys, "period", "label", F.explode("_all").alias("value"))
        found = rows.groupBy(*keys, "period", "label").agg(*stats.aggregates("percentile", percentiles=r.percentile_list))
        return stats.finished(found, "percentile", r.percentile_list).select(*keys, F.col("label").alias("time"), "percentile", "value")
    if r.stat in ("mean", "sum", "var", "std"):
        parts = held.groupBy(*keys, "period").agg(*ends, F.count("value").alias("c"), F.avg("value").alias("m"), (F.coalesce(F.var_pop("value"), F.lit(0.0)) * F.count("value")).alias("q"))
        parts = _watched(parts, r, keys)
        # Means are taken from the first period's, so that little is lost in the differences.
        parts = parts.withColumn("_o", F.first("m", ignorenulls=True).over(order)).withColumn("_d", F.coalesce(F.col("m") - F.col("_o"), F.lit(0.0)))
        c, s = F.sum("c").over(order), F.sum(F.col("c") * F.col("_d")).over(order)
        q = F.sum(F.col("q") + F.col("c") * F.col("_d") * F.col("_d")).over(order)
        var = F.when(c > 1, F.greatest((q - s * s / c) / (c - 1), F.lit(0.0))).otherwise(0.0)
        total = F.sum(F.col("c") * F.coalesce(F.col("m"), F.lit(0.0))).over(order)
        value = {"mean": F.col("_o") + s / c, "sum": total, "var": var, "std": F.sqrt(var)}[r.stat]
        return parts.withColumn("value", value).filter(closed).select(*keys, F.col("label").alias("time"), "value")
    if r.stat in ("min", "max"):
        parts = _watched(held.groupBy(*keys, "period").agg(*ends, *stats.aggregates(r.stat)), r, keys).withColumn("_e", F.min("_e").over(order))
        return stats.finished(parts.filter(closed), r.stat).select(*keys, F.col("label").alias("time"), "value", "timings")
    if r.stat == "thresh_exceed":
        parts = _watched(held.groupBy(*keys, "period").agg(*ends, *[stats.exceeds(x).alias(f"_{i}") for i, x in enumerate(r.thresh_exceed)]), r, keys)
        dims = F.array(*[F.struct(F.lit(float(x)).alias("thresholds"), F.sum(f"_{i}").over(order).alias("value")) for i, x in enumerate(r.thresh_exceed)])
        return stats.finished(parts.withColumn("_d", dims).filter(closed), "thresh_exceed").select(*keys, F.col("label").alias("time"), "thresholds", "value")
    raise ValueError(f"{r.stat!r} has no running form")


def running_histogram(held: DataFrame, r: Request, keys: list[str], order: Window, closed: Column) -> tuple[DataFrame, DataFrame]:
    """Counts and edges of all values so far.  With limits or a list of edges the counts are exact;
    otherwise the edges lie between the extremes so far, and the counts come from a sketch (ranks
    within about 0.2 % at compression 1)."""
    listed = None if isinstance(r.bins, int) else [float(b) for b in r.bins]
    number = r.bins if listed is None else len(listed) - 1
    limits = r.range if listed is None else (listed[0], listed[-1])
    k = stats.sketch_k(r.compression)
    if limits is not None:
        lo, hi = (limits[0] - 0.5, limits[1] + 0.5) if limits[0] == limits[1] else limits
        edges = listed or [lo + (hi - lo) * i / number for i in range(number + 1)]
        inside = [(F.col("value") >= a) & ((F.col("value") < b) if i + 1 < number else (F.col("value") <= b)) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
        parts = _watched(held.groupBy(*keys, "period").agg(*period_ends(), *[F.count_if(c).alias(f"_{i}") for i, c in enumerate(inside)]), r, keys)
        upto = parts.select(*keys, "label", "period", "last", F.array(*[F.sum(f"_{i}").over(order) for i in range(number)]).alias("_c")).filter(closed)
        upto = upto.withColumn("_e", F.array(*[F.lit(float(e)) for e in edges]))
    else:
        parts = _watched(held.groupBy(*keys, "period").agg(*period_ends(), F.min("value").alias("_a"), F.max("value").alias("_b"), F.count("value").alias("_n"), F.kll_sketch_agg_double("value", F.lit(k)).alias("_k")), r, keys)
        a, b = F.min("_a").over(order), F.max("_b").over(order)
        upto = parts.withColumn("_lo", F.when(a == b, a - 0.5).otherwise(a)).withColumn("_hi", F.when(a == b, b + 0.5).otherwise(b)).withColumn("_n", F.sum("_n").over(order))
        upto = upto.withColumn("_k", F.kll_merge_agg_double("_k").over(order)).filter(closed)
        edge = lambda i: F.col("_lo") + (F.col("_hi") - F.col("_lo")) * i / number
        grid = F.kll_sketch_get_quantile_double("_k", F.array(*[F.lit((i + 0.5) / 1000) for i in range(1000)]))
        upto = upto.withColumn("_q", F.when(F.col("_n") > 0, grid))
        below = lambda i: F.coalesce(F.size(F.filter("_q", lambda q: q < edge(i))) / 1000, F.lit(0.0))
        rank = [F.lit(0.0), *[below(i) for i in range(1, number)], F.lit(1.0)]
        counts = [F.rint(F.col("_n") * (q - p)).cast("long") for p, q in zip(rank, rank[1:], strict=False)]
        upto = upto.withColumn("_c", F.array(*counts)).withColumn("_e", F.array(*[edge(i) for i in range(number + 1)]))
    time = F.col("label").alias("time")
    counts = upto.select(*keys, time, F.posexplode("_c").alias("_at", "value")).select(*keys, "time", (F.col("_at") + 1).alias("bin_count"), F.col("value").cast("int").alias("value"))
    return counts, upto.select(*keys, time, F.posexplode("_e").alias("bin_edges", "value"))


def daily_values(obs: DataFrame, keys: list[str], r: Request) -> DataFrame:
    """One value per complete day: a sum for precipitation, a mean otherwise."""
    stat = "sum" if r.variable in PRECIPITATION else "mean"
    return run(obs, Request(stat, "value", r.time_step, "daily", "daily", gap_policy=r.gap_policy, replays="trusted"), keys)


def month_digests(daily: DataFrame, keys: list[str], quantiles: list[float] | None = None) -> DataFrame:
    """Distribution of the daily values of each calendar month, pooled over years: their number
    and a mergeable sketch, or exact quantiles."""
    groups = daily.withColumn("month", F.month("time")).groupBy(*keys, "month")
    if quantiles is None:
        return groups.agg(F.count("*").alias("n"), F.kll_sketch_agg_double("value").alias("sketch"))
    return stats.finished(groups.agg(F.count("*").alias("n"), F.percentile("value", quantiles).alias("_p")), "percentile", quantiles)
