"""Wall-clock times and their parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hours that the wall clock of the news is ahead of UTC.
OFFSET_HOURS = 8
PARTS = ("year", "month", "day", "hour", "minute")


def wall_time(epoch_seconds: Column | str, crawl_zone: str = "UTC", offset_hours: int = OFFSET_HOURS) -> Column:
    """Epoch seconds as the wall clock of the news, without a zone; null for null and for what is no number.

    crawl_zone is the zone of the host that made the seconds from a wall time.
    """
    c = F.col(epoch_seconds) if isinstance(epoch_seconds, str) else epoch_seconds
    instant = F.timestamp_seconds(c.try_cast("double"))
    return (F.from_utc_timestamp(instant, crawl_zone) + F.make_interval(hours=F.lit(offset_hours))).cast("timestamp_ntz")


def with_time_parts(df: DataFrame, wall: str, text: str = "datetime") -> DataFrame:
    """Adds the time as 'yyyy-MM-dd HH:mm' and its five parts; all null where the time is."""
    c = F.col(wall)
    return df.withColumns(
        {text: F.date_format(c, "yyyy-MM-dd HH:mm"), "year": F.year(c), "month": F.month(c), "day": F.dayofmonth(c), "hour": F.hour(c), "minute": F.minute(c)}
    )


def half_open(c: Column | str, start: str, end: str) -> Column:
    """start <= c < end, in the column's own type, so that it reaches a Parquet scan."""
    c = F.col(c) if isinstance(c, str) else c
    return (c >= F.lit(start).cast("timestamp_ntz")) & (c < F.lit(end).cast("timestamp_ntz"))


def neighbour_days(df: DataFrame, day: str) -> DataFrame:
    """(day, previous_day, next_day, has_previous, has_next) of the days that occur."""
    days = df.select(F.col(day).cast("date").alias("day")).where("day is not null").distinct()
    before, after = days.select(F.date_add("day", 1).alias("day"), F.lit(True).alias("p")), days.select(F.date_sub("day", 1).alias("day"), F.lit(True).alias("n"))
    out = days.join(before, "day", "left").join(after, "day", "left")
    return out.select("day", F.date_sub("day", 1).alias("previous_day"), F.date_add("day", 1).alias("next_day"), F.coalesce("p", F.lit(False)).alias("has_previous"), F.coalesce("n", F.lit(False)).alias("has_next"))
