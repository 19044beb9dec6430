"""Clock and calendar expressions. Timestamps are TIMESTAMP_NTZ in UTC; weekdays count 1=Monday .. 7=Sunday."""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

HOURS_PER_YEAR = 24 * 365
HOURS_PER_WEEK = 24 * 7


def hour_floor(ts: str | Column) -> Column:
    """Start of the hour. ``date_trunc`` would pass through the session time zone, this does not."""
    return F.make_timestamp_ntz(F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts), F.lit(0), F.lit(0))


def day_hour(date: str | Column, hour: str | Column) -> Column:
    """Timestamp of a (date, hour) cell."""
    date = F.col(date) if isinstance(date, str) else date
    return F.make_timestamp_ntz(F.year(date), F.month(date), F.dayofmonth(date), hour, F.lit(0), F.lit(0))


def seconds_of(ts: str | Column) -> Column:
    """Whole seconds since 1970 on the clock of the stamp itself. A cast to TIMESTAMP would read it in the session
    time zone and lose an hour in spring."""
    day = F.unix_date(F.col(ts).cast("date") if isinstance(ts, str) else ts.cast("date"))
    return day.cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def from_seconds(seconds: Column) -> Column:
    """The stamp of ``seconds_of``."""
    day = F.floor(seconds / 86400)
    return (F.date_from_unix_date(day.cast("int")).cast("timestamp_ntz")
            + F.make_dt_interval(secs=(seconds - day * 86400).cast("decimal(18,6)")))


def to_local(ts: str | Column, tz: str) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), ts)


def slot_of_day(ts: str | Column, slots: int) -> Column:
    """Position of ``ts`` inside its day when the day has ``slots`` equal steps (a multiple of 24)."""
    per_hour = slots // 24
    if per_hour == 1:
        return F.hour(ts)
    return (F.hour(ts) * per_hour + F.floor(F.minute(ts) * per_hour / 60)).cast("int")


def weekday_number(date: str | Column) -> Column:
    return F.weekday(date) + 1


def is_last_sunday(date: str | Column, month: int) -> Column:
    """Last Sunday of a 31-day month: the European clock-change days are March and October."""
    return (F.month(date) == month) & (F.weekday(date) == 6) & (F.dayofmonth(date) >= 25)


def weekday_names(days: list[int]) -> list[str]:
    """Names of the weekday dummies; the list ``[0]`` switches them off."""
    return [] if list(days) == [0] else [f"WD_{k}" for k in days]


def weekday_dummies(date: str | Column, days: list[int]) -> dict[str, Column]:
    """0/1 columns ``WD_k``."""
    return {name: (weekday_number(date) == k).cast("int") for name, k in zip(weekday_names(days), days)}


def rush_hour(hour: str | Column) -> Column:
    hour = F.col(hour) if isinstance(hour, str) else hour
    return (hour.between(7, 9) | hour.between(17, 19)).cast("int")


def cycle(index: str | Column, period: float) -> tuple[Column, Column]:
    """Sine and cosine of a running index with the given period."""
    index = F.col(index) if isinstance(index, str) else index
    angle = F.lit(2 * math.pi) * index / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def hourly_cycles(hour: str | Column, running_hour: str | Column) -> dict[str, Column]:
    """Hour-of-day, week and year cycles; the long two run on the position in the series."""
    out = {}
    for name, index, period in (("hour", hour, 24), ("week", running_hour, HOURS_PER_WEEK),
                                ("year", running_hour, HOURS_PER_YEAR)):
        out[f"sin_{name}"], out[f"cos_{name}"] = cycle(index, period)
    return out


def daily_cycles(ts: str | Column) -> dict[str, Column]:
    """Season numbers of a day stamp (hour, hour of week, hour of year) with week and year cycles."""
    hour = F.hour(ts)
    of_week = F.weekday(ts) * 24 + hour
    of_year = (F.dayofyear(ts) - 1) * 24 + hour
    sin_week, cos_week = cycle(of_week, HOURS_PER_WEEK)
    sin_year, cos_year = cycle(of_year, HOURS_PER_YEAR)
    return {"D_t": hour, "W_t": of_week, "A_t": of_year, "W_t_sin": sin_week, "W_t_cos": cos_week,
            "A_t_sin": sin_year, "A_t_cos": cos_year}


def calendar_parts(ts: str | Column) -> dict[str, Column]:
    return {"hour": F.hour(ts), "weekday": weekday_number(ts), "day_name": F.date_format(ts, "EEEE"),
            "day_of_year": F.dayofyear(ts), "year": F.year(ts),
            # month followed by weekday with Sunday as 0, for example 30 = a Sunday in March
            "month_weekday": F.month(ts) * 10 + F.dayofweek(ts) - 1}
