from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions.calendar import period_end, period_minutes, period_start


@pytest.mark.parametrize(
    ("word", "stamp", "start", "minutes"),
    [
        ("half_hourly", "2024-02-29 12:45", "2024-02-29 12:30", 30), ("hourly", "2024-02-29 12:45", "2024-02-29 12:00", 60),
        ("2hourly", "2024-02-29 13:45", "2024-02-29 12:00", 120), ("3hourly", "2024-02-29 13:45", "2024-02-29 12:00", 180),
        ("6hourly", "2024-02-29 11:59", "2024-02-29 06:00", 360), ("12hourly", "2024-02-29 12:00", "2024-02-29 12:00", 720),
        ("daily", "2024-02-29 23:59", "2024-02-29 00:00", 1440), ("daily_noon", "2024-02-29 12:59", "2024-02-28 13:00", 1440),
        ("daily_noon", "2024-02-29 13:00", "2024-02-29 13:00", 1440), ("weekly", "2024-03-03 10:00", "2024-02-26 00:00", 10080),
        ("monthly", "2024-02-29 10:00", "2024-02-01 00:00", 41760), ("monthly", "2023-02-02 10:00", "2023-02-01 00:00", 40320),
        ("3monthly", "2024-06-30 10:00", "2024-04-01 00:00", 131040), ("yearly", "2024-12-31 23:00", "2024-01-01 00:00", 527040),
        ("10yearly", "2004-12-31 23:00", "1995-01-01 00:00", 5260320), ("annually", "2023-05-05 00:00", "2023-01-01 00:00", 525600),
    ],
)
def test_periods(spark, word, stamp, start, minutes):
    t = spark.sql(f"select timestamp_ntz '{stamp}:00' as t")
    row = t.select(period_start(F.col("t"), word, 1995).alias("p")).select("p", period_end(F.col("p"), word).alias("e"), period_minutes(F.col("p"), word).alias("m")).first()
    assert row.p == datetime.fromisoformat(start) and row.m == minutes and (row.e - row.p).total_seconds() == 60 * minutes


def test_unknown_word(spark):
    with pytest.raises(ValueError, match="unknown frequency"):
        period_start(F.col("t"), "fortnightly")
