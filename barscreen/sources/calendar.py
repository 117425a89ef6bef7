"""Sessions that may have a file."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def weekdays(spark: SparkSession, start: dt.date | str, end: dt.date | str) -> DataFrame:
    """(day): Mondays to Fridays from start to end, both included; none if end is earlier."""
    first, last = (F.lit(str(x)).cast("date") for x in (start, end))
    days = spark.range(1).filter(first <= last).select(F.explode(F.sequence(first, last)).alias("day"))
    return days.filter(F.weekday("day") < 5)
