"""Calendar periods as column expressions on TIMESTAMP_NTZ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The frequency words with a length of so many minutes.
FIXED_MINUTES = {
    "half_hourly": 30, "hourly": 60, "2hourly": 120, "3hourly": 180, "6hourly": 360, "12hourly": 720,
    "daily": 1440, "daily_noon": 1440, "weekly": 10080,
}
#: The frequency words with a length of so many calendar months.
FIXED_MONTHS = {"monthly": 1, "3monthly": 3, "yearly": 12, "10yearly": 120}
ALIASES = {"annually": "yearly", "10annually": "10yearly"}
#: daily_noon periods begin an hour after noon.
NOON_START = 13


def canonical_word(word: str) -> str:
    word = ALIASES.get(word, word)
    if word not in FIXED_MINUTES and word not in FIXED_MONTHS:
        raise ValueError(f"unknown frequency {word!r}")
    return word


def _trunc(unit: str, t: Column) -> Column:
    return F.date_trunc(unit, t).cast("timestamp_ntz")


def _hours(n: Column | int) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(n) if isinstance(n, int) else n)


def period_start(t: Column, word: str, anchor_year: int | None = None) -> Column:
    """Start of the period that holds t.  Decades count from anchor_year."""
    word = canonical_word(word)
    if word == "half_hourly":
        return _trunc("hour", t) + F.make_dt_interval(F.lit(0), F.lit(0), F.when(F.minute(t) >= 30, 30).otherwise(0))
    if word in ("2hourly", "3hourly", "6hourly", "12hourly"):
        k = FIXED_MINUTES[word] // 60
        return _trunc("day", t) + _hours((F.hour(t) - F.hour(t) % k).cast("int"))
    if word == "daily_noon":
        return _trunc("day", t - _hours(NOON_START)) + _hours(NOON_START)
    if word == "10yearly":
        if anchor_year is None:
            raise ValueError("decades need the first year as their anchor")
        year = F.year(t) - F.pmod(F.year(t) - anchor_year, F.lit(10))
        return F.make_date(year, F.lit(1), F.lit(1)).cast("timestamp_ntz")
    unit = {"hourly": "hour", "daily": "day", "weekly": "week", "monthly": "month", "3monthly": "quarter", "yearly": "year"}[word]
    return _trunc(unit, t)


def period_end(start: Column, word: str) -> Column:
    """Start of the next period."""
    word = canonical_word(word)
    if word in FIXED_MINUTES:
        return start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(FIXED_MINUTES[word]))
    return start + F.make_ym_interval(F.lit(0), F.lit(FIXED_MONTHS[word]))


def period_minutes(start: Column, word: str) -> Column:
    return F.timestamp_diff("MINUTE", start, period_end(start, word))


def expected_steps(start: Column, word: str, step_minutes: int) -> Column:
    """How many points a full period has."""
    return (period_minutes(start, word) / step_minutes).cast("long")


def minutes_into(t: Column, word: str, anchor_year: int | None = None) -> Column:
    """How many minutes of its period lie before t."""
    return F.timestamp_diff("MINUTE", period_start(t, word, anchor_year), t)


def append_offset(t: Column, stat_word: str, output_word: str, anchor_year: int | None = None) -> Column:
    """Minutes of the output period before the statistic's period that holds t."""
    return F.timestamp_diff("MINUTE", period_start(t, output_word, anchor_year), period_start(t, stat_word, anchor_year))


def append_count(t: Column, stat_word: str, output_word: str, anchor_year: int | None = None) -> Column:
    """How many statistics the output period still takes from the period that holds t on."""
    start = period_start(t, output_word, anchor_year)
    left = period_minutes(start, output_word) - append_offset(t, stat_word, output_word, anchor_year)
    return F.rint(left / period_minutes(period_start(t, stat_word, anchor_year), stat_word)).cast("long")


def check_divides(word: str, step_minutes: int) -> None:
    """A period must be a whole number of steps, one at least; months and years, which differ in
    their numbers of days, must be so day by day."""
    if FIXED_MINUTES.get(canonical_word(word), 1440) % step_minutes:
        raise ValueError(f"a {word} period isn't a whole number of steps of {step_minutes} minutes")
