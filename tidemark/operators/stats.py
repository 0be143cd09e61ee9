"""The statistics as aggregate expressions over ``time`` and ``value``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _earliest_least() -> Column:
    """Struct (v, t) of the smallest value, the earliest of equal ones."""
    return F.min(F.when(F.col("value").isNotNull(), F.struct(F.col("value").alias("v"), F.col("time").alias("t"))))


def _earliest_most() -> Column:
    """The same for the largest value, which is the smallest negated one."""
    return F.min(F.when(F.col("value").isNotNull(), F.struct((-F.col("value")).alias("v"), F.col("time").alias("t"))))


def exceeds(threshold: float) -> Column:
    """Values count that reach the threshold's magnitude."""
    return F.coalesce(F.sum((F.col("value") >= F.lit(float(abs(threshold)))).cast("long")), F.lit(0))


def sketch_k(compression: float) -> int:
    """Size of a KLL sketch: 4096 (ranks within about 0.1 %) at compression 1, less for more."""
    return max(8, min(65_535, round(4096 / max(1.0, float(compression)))))


def aggregates(stat: str, thresholds: list[float] = (), percentiles: list[float] = (), k: int | None = None) -> list[Column]:
    """Aggregate columns; partial aggregation happens before the shuffle in all of them."""
    if stat == "mean":
        return [F.avg("value").alias("value")]
    if stat == "sum":
        return [F.sum("value").alias("value")]
    if stat == "var":
        return [F.coalesce(F.var_samp("value"), F.lit(0.0)).alias("value")]
    if stat == "std":
        return [F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("value")]
    if stat == "min":
        return [_earliest_least().alias("_e")]
    if stat == "max":
        return [_earliest_most().alias("_e")]
    if stat == "thresh_exceed":
        return [F.array(*[F.struct(F.lit(float(x)).alias("thresholds"), exceeds(x).alias("value")) for x in thresholds]).alias("_d")]
    if stat == "percentile" and k is not None:
        return [F.kll_sketch_agg_double("value", F.lit(k)).alias("_k")]
    if stat == "percentile":
        return [F.percentile("value", list(percentiles)).alias("_p")]
    raise ValueError(f"{stat!r} isn't an aggregate")


def finished(df: DataFrame, stat: str, percentiles: list[float] = ()) -> DataFrame:
    """Turn aggregate columns into result columns, extra dimensions into rows."""
    if stat in ("min", "max"):
        value = F.col("_e.v") if stat == "min" else -F.col("_e.v")
        return df.withColumn("value", value).withColumn("timings", F.col("_e.t")).drop("_e")
    if stat == "thresh_exceed":
        others = [c for c in df.columns if c != "_d"]
        return df.select(*others, F.inline("_d"))
    if stat == "percentile" and "_k" in df.columns:
        df = df.withColumn("_p", F.array(*[F.kll_sketch_get_quantile_double("_k", F.lit(float(p))) for p in percentiles])).drop("_k")
    if stat == "percentile":
        others = [c for c in df.columns if c != "_p"]
        listed = F.array(*[F.lit(float(p)) for p in percentiles])
        return df.select(*others, F.explode(F.arrays_zip(listed.alias("percentile"), F.col("_p").alias("value"))).alias("_x")).select(*others, "_x.percentile", "_x.value")
    return df


def histogram(obs: DataFrame, groups: list[str], bins: int | list[float], limits: tuple[float, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """Counts and edges of bins, the last closed on the right; values outside don't count.

    A number of bins makes them equally wide between the limits, by default the group's extremes
    (equal ones are widened by a half); a list gives their edges.  The extremes of a group are
    aggregated first and joined back, so rows are combined before they shuffle.
    """
    edges_of = None if isinstance(bins, int) else F.array(*[F.lit(float(b)) for b in bins])
    number = bins if isinstance(bins, int) else len(bins) - 1
    fixed = limits if edges_of is None else (bins[0], bins[-1])
    lo, hi = (F.min("value"), F.max("value")) if fixed is None else (F.lit(float(fixed[0])), F.lit(float(fixed[1])))
    ends = obs.groupBy(*groups).agg(lo.alias("_a"), hi.alias("_b"), F.min("time").alias("label"), F.count("*").alias("n"), F.max("time").alias("last"))
    same = F.col("_a") == F.col("_b")
    ends = ends.select(*groups, "label", "last", "n", F.when(same, F.col("_a") - 0.5).otherwise(F.col("_a")).alias("lo"), F.when(same, F.col("_b") + 0.5).otherwise(F.col("_b")).alias("hi"))
    if fixed is None:
        same_group = None
        for g in groups:
            one = F.col(f"o.{g}").eqNullSafe(F.col(f"e.{g}"))
            same_group = one if same_group is None else same_group & one
        wide = obs.alias("o").join(ends.alias("e"), same_group).select(*[f"o.{g}" for g in groups], "value", "lo", "hi")
    else:
        a, b = (fixed[0] - 0.5, fixed[1] + 0.5) if fixed[0] == fixed[1] else fixed
        wide = obs.select(*groups, "value", F.lit(float(a)).alias("lo"), F.lit(float(b)).alias("hi"))
    if edges_of is None:
        at = F.floor(number * (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))) + 1
        edge = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("bin_edges") / number
    else:
        at = F.size(F.filter(edges_of, lambda e: e <= F.col("value")))
        edge = F.get(edges_of, F.col("bin_edges"))
    inside = wide.filter((F.col("value") >= F.col("lo")) & (F.col("value") <= F.col("hi")))
    filled = inside.groupBy(*groups, F.least(at, F.lit(number)).cast("int").alias("bin_count")).agg(F.count("*").alias("value"))
    frame = ends.select(*groups, "label", "last", "n", F.explode(F.sequence(F.lit(1), F.lit(number))).alias("bin_count"))
    counts = frame.join(filled, [*groups, "bin_count"], "left").withColumn("value", F.coalesce("value", F.lit(0)).cast("int"))
    edges = ends.select(*groups, "label", "last", "n", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(number))).alias("bin_edges")).withColumn("value", edge).drop("lo", "hi")
    return counts, edges


#: The durations of rolling sums, in minutes.
DURATIONS = (5, 10, 15, 20, 30, 45, 60, 90, 120, 180, 240, 360, 540, 720, 1080, 1440, 2880, 4320, 5760, 7200, 8640, 10080)


def rolling_maxima(obs: DataFrame, keys: list[str], groups: list[str], step_minutes: int) -> DataFrame:
    """Per group the largest rolling sum of each duration that is a whole number of steps, over
    stretches of time that have all their points; all windows share one exchange and one sort."""
    kept = [d for d in DURATIONS if d >= step_minutes and d % step_minutes == 0]
    if not kept:
        raise ValueError(f"no duration is a multiple of {step_minutes} minutes")
    minute = F.floor(F.unix_seconds(F.col("time").cast("timestamp")) / 60)
    order = Window.partitionBy(*groups).orderBy("_minute")
    since = lambda d: order.rangeBetween(step_minutes - d, 0)
    sums = [F.when(F.count("*").over(since(d)) == d // step_minutes, F.sum("value").over(since(d))).alias(f"_{d}") for d in kept]
    rolled = obs.withColumn("_minute", minute).select(*groups, "time", *sums)
    top = rolled.groupBy(*groups).agg(F.count("*").alias("n"), F.min("time").alias("label"), F.max("time").alias("last"), *[F.max(f"_{d}").alias(f"_{d}") for d in kept])
    rows = F.array(*[F.struct(F.lit(d).alias("durations"), F.col(f"_{d}").alias("value")) for d in kept])
    return top.select(*groups, "n", "label", "last", F.inline(rows))


def sketch(obs: DataFrame, groups: list[str]) -> DataFrame:
    """A mergeable KLL sketch per group, for sets too large for exact percentiles."""
    return obs.groupBy(*groups).agg(F.kll_sketch_agg_double("value").alias("sketch"), F.count("*").alias("n"))
