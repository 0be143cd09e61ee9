"""One query per operator over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar
from ..operators import stats
from ..request import Request
from ..sources import series, sinks
from . import engine

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

# --- the series ---------------------------------------------------------------------------


def ev_day(spark: SparkSession, d: str) -> DataFrame:
    return series.resample(series.table(spark, d, "events"), ["event_type"], F.col("ts"), F.round(F.sum("value"), 2), "daily")


def ev_hour(spark: SparkSession, d: str) -> DataFrame:
    return series.resample(series.table(spark, d, "events").withColumn("cell", F.lit("all")), ["cell"], F.col("ts"), F.round(F.avg("value"), 6), "hourly")


def ord_day(spark: SparkSession, d: str) -> DataFrame:
    return series.resample(series.table(spark, d, "orders").withColumn("cell", F.lit("all")), ["cell"], F.col("o_orderdate"), F.round(F.sum("o_totalprice"), 2), "daily")


def ord_grid(spark: SparkSession, d: str) -> DataFrame:
    orders = series.table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderpriority", "o_totalprice")
    customers = series.table(spark, d, "customer").select("c_custkey", "c_nationkey")
    sold = orders.join(customers, orders.o_custkey == customers.c_custkey)
    keys = ["c_nationkey", "o_orderpriority"]
    return series.zero_filled(series.resample(sold, keys, F.col("o_orderdate"), F.round(F.sum("o_totalprice"), 2), "daily"), keys)


SERIES: dict[str, tuple[Callable, list[str], int, str]] = {
    "ev_day": (ev_day, ["event_type"], 1440, "select event_type, date_trunc('day', ts) as time, round(sum(value), 2) as value from events group by all"),
    "ev_hour": (ev_hour, ["cell"], 60, "select 'all' as cell, date_trunc('hour', ts) as time, round(avg(value), 6) as value from events group by all"),
    "ord_day": (ord_day, ["cell"], 1440, "select 'all' as cell, date_trunc('day', o_orderdate) as time, round(sum(o_totalprice), 2) as value from orders group by all"),
    "ord_grid": (
        ord_grid, ["c_nationkey", "o_orderpriority"], 1440,
        """select k.c_nationkey, k.o_orderpriority, k.time, coalesce(s.value, 0.0) as value from (
             select c_nationkey, o_orderpriority, time from
               (select distinct c_nationkey, o_orderpriority from orders join customer on o_custkey = c_custkey),
               (select unnest(generate_series(min(date_trunc('day', o_orderdate)), max(date_trunc('day', o_orderdate)), interval 1 day)) as time from orders join customer on o_custkey = c_custkey)) k
           left join (select c_nationkey, o_orderpriority, date_trunc('day', o_orderdate) as time, round(sum(o_totalprice), 2) as value
             from orders join customer on o_custkey = c_custkey group by all) s
             on s.c_nationkey = k.c_nationkey and s.o_orderpriority = k.o_orderpriority and s.time = k.time""",
    ),
}

# --- SQL for periods ----------------------------------------------------------------------

_SQL_START = {
    "hourly": "date_trunc('hour', time)", "daily": "date_trunc('day', time)", "weekly": "date_trunc('week', time)", "monthly": "date_trunc('month', time)",
    "3monthly": "date_trunc('quarter', time)", "yearly": "date_trunc('year', time)", "daily_noon": "date_trunc('day', time - interval 13 hour) + interval 13 hour",
    "10yearly": "make_timestamp(1995 + 10 * ((year(time) - 1995) // 10), 1, 1, 0, 0, 0.0)",
} | {f"{k}hourly": f"date_trunc('day', time) + to_hours(hour(time)::int - hour(time)::int % {k})" for k in (2, 3, 6, 12)}
_SQL_LENGTH = {"hourly": "1 hour", "daily": "1 day", "weekly": "7 day", "monthly": "1 month", "3monthly": "3 month", "yearly": "1 year", "daily_noon": "1 day", "10yearly": "10 year"} | {f"{k}hourly": f"{k} hour" for k in (2, 3, 6, 12)}


def _sql_n(word: str, step: int, period: str = "period") -> str:
    return f"date_diff('minute', {period}, {period} + interval {_SQL_LENGTH[word]}) // {step}"


_SQL_STAT = {
    "mean": "avg(value)", "sum": "sum(value)", "var": "coalesce(var_samp(value), 0.0)", "std": "coalesce(stddev_samp(value), 0.0)",
    "min": "min(value)", "max": "max(value)",
}
_SQL_WHEN = {"min": "arg_min(time, struct_pack(v := value, t := time))", "max": "arg_max(time, struct_pack(v := value, t := -epoch_us(time)))"}


def _add(name: str, query: Query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLE_SQL[name] = sql


def _periodic(name: str, of: str, stat: str, word: str, digits: int, output: str | None = None, partial: bool = False, where: str | None = None) -> None:
    make, keys, step, sql = SERIES[of]
    request = Request(stat, "value", step, word, output or word, completeness="allow_partial" if partial else "complete_only", gap_policy="ignore")
    rounded = lambda df: df.withColumn("value", F.round("value", digits))
    shown = ", ".join(keys)

    def query(spark: SparkSession, d: str) -> DataFrame:
        data = make(spark, d)
        return rounded(engine.run(data.filter(where) if where else data, request, keys, anchor_year=1995))

    when = f", {_SQL_WHEN[stat]} as timings" if stat in _SQL_WHEN else ""
    out = f", {_SQL_START[output].replace('time', 'period')} as output_time".replace("interperiod", "intertime") if output else ""
    having = "" if partial else f"having count(*) = {_sql_n(word, step)}"
    source = f"select * from ({sql}) where {where}" if where else sql
    _add(name, query, f"""
        with s as (select *, {_SQL_START[word]} as period from ({source}))
        select {shown}{out}, min(time) as time, round({_SQL_STAT[stat]}, {digits}) as value{when}
        from s group by {shown}, period {having}""")  # fmt: skip


for _word in ("daily", "2hourly", "3hourly", "6hourly", "12hourly"):
    _periodic(f"mean_{_word}", "ev_hour", "mean", _word, 9)
_periodic("mean_weekly", "ev_day", "mean", "weekly", 4)
_periodic("mean_monthly", "ord_day", "mean", "monthly", 5)
_periodic("mean_3monthly", "ord_day", "mean", "3monthly", 5)
_periodic("mean_yearly", "ord_day", "mean", "yearly", 5)
_periodic("mean_grid_monthly", "ord_grid", "mean", "monthly", 5)
_periodic("sum_hourly", "ev_hour", "sum", "hourly", 6)
_periodic("sum_daily_noon", "ev_hour", "sum", "daily_noon", 6)
_periodic("sum_monthly", "ord_day", "sum", "monthly", 2)
_periodic("sum_decadal", "ord_day", "sum", "10yearly", 2, partial=True)
_periodic("var_weekly", "ev_day", "var", "weekly", 1)
_periodic("var_single_point", "ev_day", "var", "daily", 4)
_periodic("std_weekly", "ev_day", "std", "weekly", 3)
_periodic("std_3monthly", "ord_day", "std", "3monthly", 1)
_periodic("min_6hourly", "ev_hour", "min", "6hourly", 6)
_periodic("max_12hourly", "ev_hour", "max", "12hourly", 6)
_periodic("min_monthly", "ord_day", "min", "monthly", 2)
_periodic("max_yearly", "ord_day", "max", "yearly", 2)
_periodic("append_daily_to_monthly", "ord_day", "mean", "daily", 2, output="monthly")
_periodic("append_monthly_to_3monthly", "ord_day", "std", "monthly", 1, output="3monthly")
_periodic("append_6hourly_to_weekly", "ev_hour", "min", "6hourly", 6, output="weekly")
_periodic("partial_periods", "ev_day", "mean", "weekly", 4, partial=True)
_periodic("partial_start_skip", "ev_hour", "mean", "daily", 9, where="time >= timestamp '2024-01-03 05:00:00'")


def _thresholds() -> None:
    make, keys, step, sql = SERIES["ord_day"]
    limits = [5e5, 1e6, -2e6]
    request = Request("thresh_exceed", "value", step, "monthly", "monthly", thresh_exceed=limits, gap_policy="ignore")
    rows = " union all ".join(f"select cell, min(time) as time, {float(x)!r}::double as thresholds, count(*) filter (value >= {abs(x)!r}) as value from s group by cell, period having count(*) = {_sql_n('monthly', step)}" for x in limits)
    _add("thresh_monthly_multi", lambda spark, d: engine.run(make(spark, d), request, keys), f"with s as (select *, {_SQL_START['monthly']} as period from ({sql})) {rows}")


def _percentiles(name: str, of: str, word: str, listed: list[float], digits: int, method: str = "exact") -> None:
    make, keys, step, sql = SERIES[of]
    request = Request("percentile", "value", step, word, word, percentile_list=listed, percentile_method=method, gap_policy="ignore")
    shown = ", ".join(keys)
    query = lambda spark, d: engine.run(make(spark, d), request, keys).withColumn("value", F.round("value", digits))
    _add(name, query, f"""
        with s as (select *, {_SQL_START[word]} as period from ({sql})),
        q as (select {shown}, min(time) as time, quantile_cont(value, {listed}) as q from s group by {shown}, period having count(*) = {_sql_n(word, step)})
        select {shown}, time, unnest({listed}::double[]) as percentile, round(unnest(q), {digits}) as value from q""")  # fmt: skip


def _histograms(name: str, of: str, word: str, bins: int, limits: tuple[float, float] | None) -> None:
    make, keys, step, sql = SERIES[of]
    request = Request("histogram", "value", step, word, word, bins=bins, range=limits, gap_policy="ignore")
    shown = ", ".join(keys)
    a, b = ("min(value)", "max(value)") if limits is None else map(repr, map(float, limits))
    base = f"""
        with s as (select *, {_SQL_START[word]} as period from ({sql})),
        e as (select {shown}, period, min(time) as time, {a} as a, {b} as b from s group by {shown}, period having count(*) = {_sql_n(word, step)}),
        l as (select {shown}, period, time, case when a = b then a - 0.5 else a end as lo, case when a = b then b + 0.5 else b end as hi from e)"""
    same = " and ".join(f"s.{k} = l.{k}" for k in (*keys, "period"))
    of_l = ", ".join(f"l.{k}" for k in keys)
    _add(f"{name}_counts", lambda spark, d: engine.run(make(spark, d), request, keys)[0], f"""{base},
        c as (select {of_l}, l.period, least(floor({bins} * (s.value - lo) / (hi - lo)) + 1, {bins})::int as bin_count, count(*) as value
              from s join l on {same} where s.value >= lo and s.value <= hi group by all),
        g as (select {shown}, period, time, unnest(range(1, {bins + 1}))::int as bin_count from l)
        select {", ".join(f"g.{k}" for k in keys)}, g.time, g.bin_count, coalesce(c.value, 0)::int as value
        from g left join c on {" and ".join(f"c.{k} = g.{k}" for k in (*keys, "period", "bin_count"))}""")  # fmt: skip
    edges = lambda spark, d: engine.run(make(spark, d), request, keys)[1].withColumn("value", F.round("value", 6))
    _add(f"{name}_edges", edges, f"""{base},
        g as (select {shown}, time, lo, hi, unnest(range(0, {bins + 1}))::int as bin_edges from l)
        select {shown}, time, bin_edges, round(lo + (hi - lo) * bin_edges / {bins}, 6) as value from g""")  # fmt: skip


def _iams() -> None:
    make, keys, step, sql = SERIES["ord_day"]
    request = Request("iams", "value", step, "yearly", "yearly", completeness="allow_partial", gap_policy="ignore")
    parts = " union all ".join(
        f"select cell, min(time) over (partition by cell, period) as time, {d}::int as durations, "
        f"case when count(*) over (partition by cell, period order by time range between interval {d - 1440} minute preceding and current row) = {d // 1440} "
        f"then sum(value) over (partition by cell, period order by time range between interval {d - 1440} minute preceding and current row) end as v, period "
        "from s"
        for d in (1440, 2880, 4320, 5760, 7200, 8640, 10080)
    )
    query = lambda spark, d: engine.run(make(spark, d), request, keys).withColumn("value", F.round("value", 2))
    _add("iams_yearly", query, f"with s as (select *, {_SQL_START['yearly']} as period from ({sql})), r as ({parts}) select cell, time, durations, round(max(v), 2) as value from r group by cell, period, time, durations")


def _running(stat: str, of: str, word: str, digits: int) -> None:
    make, keys, step, sql = SERIES[of]
    limits, listed = [500.0, 1000.0], [0.1, 0.5, 0.9]
    request = Request(stat, "value", step, "continuous", word, thresh_exceed=limits, percentile_list=listed, gap_policy="ignore")
    shown = ", ".join(keys)
    w = f"partition by {shown} order by time rows unbounded preceding"
    ends = f"""with s as (select *, {_SQL_START[word]} as period from ({sql})),
        p as (select {shown}, period, min(time) as label, max(time) as last from s group by all having max(time) + to_minutes({step}) >= period + interval {_SQL_LENGTH[word]})"""
    same = " and ".join(f"s.{k} = p.{k}" for k in keys)
    of_p = ", ".join(f"p.{k}" for k in keys)
    if stat == "percentile":
        body = f"""{ends}, q as (select {of_p}, p.label as time, quantile_cont(s.value, {listed}) as q from p join s on {same} and s.time <= p.last group by all)
            select {shown}, time, unnest({listed}::double[]) as percentile, round(unnest(q), {digits}) as value from q"""
    elif stat == "thresh_exceed":
        body = ends + " union all ".join(f" select {of_p}, p.label as time, {x}::double as thresholds, count(*) filter (s.value >= {x}) as value from p join s on {same} and s.time <= p.last group by {of_p}, p.label" for x in limits)
    else:
        when = f", {_SQL_WHEN[stat].replace('value', 's.value').replace('time', 's.time')} as timings" if stat in _SQL_WHEN else ""
        body = f"{ends} select {of_p}, p.label as time, round({_SQL_STAT[stat].replace('value', 's.value')}, {digits}) as value{when} from p join s on {same} and s.time <= p.last group by {of_p}, p.label"
    query = lambda spark, d: engine.run(make(spark, d), request, keys).withColumn("value", F.round("value", digits))
    _add(f"continuous_{stat}", query, body)


def _others() -> None:
    make, keys, step, sql = SERIES["ev_day"]

    def replayed(spark: SparkSession, d: str) -> DataFrame:
        data = make(spark, d)
        again = data.unionByName(data.filter("time < timestamp_ntz '2024-01-10 00:00:00'"))
        return engine.run(again, Request("sum", "value", step, "weekly", "weekly", gap_policy="ignore"), keys).withColumn("value", F.round("value", 2))

    _add("dedupe_replay", replayed, f"with s as (select *, {_SQL_START['weekly']} as period from ({sql})) select event_type, min(time) as time, round(sum(value), 2) as value from s group by event_type, period having count(*) = 7")
    _add("gap_audit", lambda spark, d: series.gaps(ord_day(spark, d), ["cell"], 1440).withColumn("minutes", F.col("minutes").cast("long")), f"""
        with s as (select cell, time, lag(time) over (partition by cell order by time) as last from ({SERIES['ord_day'][3]}))
        select cell, last, time, date_diff('minute', last, time) as minutes, case when date_diff('minute', last, time) >= 2880 then 'error' else 'warning' end as verdict
        from s where date_diff('minute', last, time) <> 1440""")  # fmt: skip
    _add("raw_passthrough", lambda spark, d: engine.run(make(spark, d), Request("raw", "value", step), keys), sql)
    _add("time_range", lambda spark, d: series.between(series.observations(series.table(spark, d, "events"), ["event_id"], "ts", "value"), "2024-01-05 00:00:00", "2024-01-06 12:00:00"),
         "select event_id, ts as time, value from events where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-06 12:00:00'")
    for variable, stat, name in (("pr", "sum", "sum"), ("temperature", "mean", "mean"), ("precipitationCal", "sum", "precipitation_cal")):
        def daily(spark: SparkSession, d: str, variable=variable) -> DataFrame:
            data = ev_hour(spark, d).withColumnRenamed("value", variable)
            return engine.run(data, Request("bias_correction", variable, 60, "daily", "daily", gap_policy="ignore"), ["cell"]).withColumn("value", F.round("value", 9))

        _add("bc_precipitation_cal" if name == "precipitation_cal" else f"bc_daily_{name}", daily, f"with s as (select *, {_SQL_START['daily']} as period from ({SERIES['ev_hour'][3]})) select cell, min(time) as time, round({_SQL_STAT[stat]}, 9) as value from s group by cell, period having count(*) = 24")

    def digests(spark: SparkSession, d: str, quantiles: list[float] | None) -> DataFrame:
        return engine.month_digests(engine.daily_values(ord_day(spark, d), ["cell"], Request("bias_correction", "pr", 1440, "daily", "daily", gap_policy="ignore")), ["cell"], quantiles)

    _add("bc_month_digest_size", lambda spark, d: digests(spark, d, None).select("cell", "month", "n"), f"select cell, month(time)::int as month, count(*) as n from ({SERIES['ord_day'][3]}) group by all")
    _add("bc_month_quantiles", lambda spark, d: digests(spark, d, [0.25, 0.5, 0.75]).withColumn("value", F.round("value", 4)), f"""
        with q as (select cell, month(time)::int as month, count(*) as n, quantile_cont(value, [0.25, 0.5, 0.75]) as q from ({SERIES['ord_day'][3]}) group by all)
        select cell, month, n, unnest([0.25, 0.5, 0.75]::double[]) as percentile, round(unnest(q), 4) as value from q""")  # fmt: skip
    _add("period_minutes", lambda spark, d: ord_day(spark, d).select(calendar.period_start(F.col("time"), "monthly").alias("period")).distinct().withColumn("minutes", calendar.period_minutes(F.col("period"), "monthly").cast("long")),
         f"select distinct date_trunc('month', time)::timestamp as period, date_diff('minute', date_trunc('month', time), date_trunc('month', time) + interval 1 month) as minutes from ({SERIES['ord_day'][3]})")
    request = Request("mean", "value", 1440, "monthly", "monthly", gap_policy="ignore")
    _add("file_names", lambda spark, d: sinks.named(engine.run(ord_day(spark, d), request, ["cell"]), request).select("time", "file"),
         f"with s as (select *, {_SQL_START['monthly']} as period from ({SERIES['ord_day'][3]})) select min(time) as time, strftime(period, '%Y_%m') || '_value_timestep_1440_monthly_mean' as file from s group by period having count(*) = {_sql_n('monthly', 1440)}")
    _add("array_cells", lambda spark, d: series.from_array(series.table(spark, d, "embeddings"), ["label"], "embedding").groupBy("label", "cell").agg(F.count("*").alias("n"), F.round(F.max("value").cast("double"), 4).alias("top")),
         "with e as (select label, unnest(embedding) as value, unnest(range(len(embedding)))::int as cell from embeddings) select label, cell, count(*) as n, round(max(value)::double, 4) as top from e group by all")

    def kll(spark: SparkSession, d: str) -> DataFrame:
        """Whether quantiles of merged sketches are as near as they must be: the share of values
        below them within a hundredth of the rank asked for."""
        held = ord_day(spark, d).withColumn("period", calendar.period_start(F.col("time"), "yearly"))
        merged = stats.sketch(held, ["cell", "period"]).groupBy("cell").agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"))
        asked = F.array(*[F.struct(F.lit(p).alias("percentile"), F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias("quantile")) for p in (0.05, 0.25, 0.5, 0.75, 0.95)])
        found = merged.select("cell", "n", F.inline(asked))
        ranks = found.join(held.select("cell", "value"), "cell").groupBy("cell", "n", "percentile").agg(F.avg((F.col("value") <= F.col("quantile")).cast("double")).alias("rank"))
        return ranks.select("cell", "n", "percentile", (F.abs(F.col("rank") - F.col("percentile")) <= 0.01).alias("near"))

    _add("kll_percentile_merged", kll, f"with s as ({SERIES['ord_day'][3]}) select cell, count(*) as n, unnest([0.05, 0.25, 0.5, 0.75, 0.95]::double[]) as percentile, true as near from s group by cell")

    # Percentiles and histograms of bounded memory, within a stated error of the exact ones.
    def sketched(spark: SparkSession, d: str) -> DataFrame:
        request = Request("percentile", "value", 1440, "yearly", "yearly", percentile_list=[0.1, 0.5, 0.9], percentile_method="sketch", completeness="allow_partial", gap_policy="ignore")
        found = engine.run(ord_day(spark, d), request, ["cell"])
        held = ord_day(spark, d).withColumn("period", calendar.period_start(F.col("time"), "yearly"))
        near = found.withColumn("period", calendar.period_start(F.col("time"), "yearly")).withColumnRenamed("value", "quantile").drop("time").join(held, ["cell", "period"])
        near = near.groupBy("cell", "period", "percentile").agg(F.avg((F.col("value") <= F.col("quantile")).cast("double")).alias("rank"))
        return near.select("cell", "period", "percentile", (F.abs(F.col("rank") - F.col("percentile")) <= 0.01).alias("near"))

    _add("percentile_kll", sketched, f"with s as (select *, {_SQL_START['yearly']}::timestamp as period from ({SERIES['ord_day'][3]})) select cell, period, unnest([0.1, 0.5, 0.9]::double[]) as percentile, true as near from s group by cell, period")

    base = f"with s as (select *, {_SQL_START['weekly']} as period from ({SERIES['ev_hour'][3]})), p as (select cell, period, min(time) as label, max(time) as last from s group by all having max(time) + interval 60 minute >= period + interval 7 day)"
    edges = [0.0, 10.0, 25.0, 50.0, 100.0, 1000.0]
    edged = Request("histogram", "value", 60, "continuous", "weekly", bins=edges, gap_policy="ignore")
    columns = " union all ".join(f"select p.cell, p.label as time, {i + 1}::int as bin_count, count(*) filter (s.value >= {a} and s.value {'<=' if i + 2 == len(edges) else '<'} {b})::int as value from p join s on s.cell = p.cell and s.time <= p.last group by all" for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)))
    _add("continuous_histogram", lambda spark, d: engine.run(ev_hour(spark, d), edged, ["cell"])[0], f"{base} {columns}")
    listed = Request("histogram", "value", 60, "daily", "daily", bins=edges, gap_policy="ignore")
    rows = " union all ".join(f"select cell, min(time) as time, {i + 1}::int as bin_count, count(*) filter (value >= {a} and value {'<=' if i + 2 == len(edges) else '<'} {b})::int as value from s group by cell, period having count(*) = 24" for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)))
    _add("histogram_edge_list", lambda spark, d: engine.run(ev_hour(spark, d), listed, ["cell"])[0], f"with s as (select *, {_SQL_START['daily']} as period from ({SERIES['ev_hour'][3]})) {rows}")

    def sketched_histogram(spark: SparkSession, d: str) -> DataFrame:
        """Per output the values counted, and whether the extremes are the outer edges."""
        counts, ends = engine.run(ev_hour(spark, d), Request("histogram", "value", 60, "continuous", "weekly", bins=8, gap_policy="ignore"), ["cell"])
        outer = ends.groupBy("cell", "time").agg(F.round(F.min("value"), 6).alias("least"), F.round(F.max("value"), 6).alias("most"))
        return counts.groupBy("cell", "time").agg(F.sum("value").alias("n")).join(outer, ["cell", "time"]).withColumn("near", F.col("n") >= 0).drop("n")

    _add("continuous_histogram_sketch", sketched_histogram, f"{base} select p.cell, p.label as time, round(min(s.value), 6) as least, round(max(s.value), 6) as most, true as near from p join s on s.cell = p.cell and s.time <= p.last group by all")

    # What the gap policy is about.
    gaps = Request("mean", "value", 1440, "yearly", "yearly")
    _add("gap_error", lambda spark, d: engine.gap_periods(ord_day(spark, d), gaps, ["cell"]).select("cell", "period", "label", "last", "n"), f"""
        with s as (select *, {_SQL_START['yearly']}::timestamp as period, lag(time) over (partition by cell order by time) as before from ({SERIES['ord_day'][3]}))
        select cell, period, min(time) as label, max(time) as last, count(*) as n from s group by cell, period having count(*) filter (date_diff('minute', before, time) >= 2880) > 0""")  # fmt: skip

    # How far a time is into its period and its output.
    into = lambda spark, d: ord_day(spark, d).select("time", calendar.minutes_into(F.col("time"), "monthly").alias("into_month"), calendar.append_offset(F.col("time"), "daily", "monthly").alias("offset"), calendar.append_count(F.col("time"), "daily", "monthly").alias("left_days"), calendar.append_count(F.col("time"), "monthly", "3monthly").alias("left_months"))
    _add("append_counts", into, f"""
        with s as (select time, date_trunc('month', time) as m, date_trunc('quarter', time) as q from ({SERIES['ord_day'][3]}))
        select time, date_diff('minute', m, time) as into_month, date_diff('minute', m, date_trunc('day', time)) as "offset",
          date_diff('day', time, m + interval 1 month) as left_days, date_diff('month', m, q + interval 3 month) as left_months from s""")  # fmt: skip

    # In pieces: what is given over three pieces, one of them repeated, is what one batch gives.
    def in_pieces(spark: SparkSession, d: str) -> DataFrame:
        from .incremental import Series

        place = f"{spark.conf.get('spark.checkpoint.dir', None) or tempfile.mkdtemp()}/pieces-{uuid.uuid4().hex}"
        data = ev_day(spark, d)
        job = Series(spark, Request("var", "value", 1440, "weekly", "weekly", checkpoint_filepath=place, gap_policy="ignore"), ["event_type"])
        ends = ["2024-01-01", "2024-01-10", "2024-01-19", "2024-02-01"]
        given = []
        for a, b in [(ends[0], ends[1]), ("2024-01-08", ends[1]), (ends[1], ends[2]), (ends[2], ends[3])]:
            given += job.add(data.filter((F.col("time") >= F.lit(a).cast("timestamp_ntz")) & (F.col("time") < F.lit(b).cast("timestamp_ntz")))).collect()  # a row per key and week
        schema = "event_type string, time timestamp_ntz, value double"
        return spark.createDataFrame([(r.event_type, r.time, r.value) for r in given], schema).withColumn("value", F.round("value", 1))

    _add("incremental_var", in_pieces, ORACLE_SQL["var_weekly"])


_thresholds()
_percentiles("percentile_daily_full", "ev_hour", "daily", [i / 100 for i in range(100)], 9)
_percentiles("percentile_3monthly_list", "ord_day", "3monthly", [0.05, 0.5, 0.95], 5)
_histograms("histogram", "ev_day", "weekly", 10, None)
_histograms("histogram_range", "ev_day", "weekly", 4, (100.0, 100000.0))
_iams()
for _stat, _of, _word, _digits in (("mean", "ev_hour", "weekly", 9), ("sum", "ev_hour", "daily", 6), ("var", "ev_hour", "daily", 2), ("std", "ev_hour", "weekly", 3), ("min", "ev_hour", "daily", 6), ("max", "ev_hour", "weekly", 6), ("percentile", "ev_hour", "weekly", 9), ("thresh_exceed", "ev_hour", "weekly", 0)):
    _running(_stat, _of, _word, _digits)
_others()


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["mean_weekly"](spark, sf_dir)
