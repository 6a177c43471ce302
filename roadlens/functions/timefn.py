"""Time expressions. All run JVM-side; the session time zone must be UTC so that
casting a wall-clock TIMESTAMP_NTZ to TIMESTAMP keeps the same digits."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCAL_TZ = "Asia/Ho_Chi_Minh"

# Peak hours of the verified batch path and of the lakehouse path.
PEAK_HOURS_A = (7, 8, 9, 16, 17, 18, 19)
PEAK_HOURS_B = (7, 8, 9, 11, 12, 13, 17, 18, 19)


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_seconds(ts) -> Column:
    """Whole seconds since 1970 of a wall-clock timestamp (NTZ read as UTC)."""
    return F.unix_seconds(col_(ts).cast("timestamp"))


def epoch_micros(ts) -> Column:
    return F.unix_micros(col_(ts).cast("timestamp"))


def to_local_time(c, tz: str = LOCAL_TZ) -> Column:
    """ISO/UTC text (or an instant) -> local wall clock as TIMESTAMP_NTZ; bad text -> null.

    An input that is already TIMESTAMP_NTZ is taken as local wall clock and kept.
    """
    c = col_(c)
    parsed = F.try_to_timestamp(c.cast("string"))
    return F.from_utc_timestamp(parsed, tz).cast("timestamp_ntz")


def floor_bucket(ts, minutes: int) -> Column:
    """Floor a timestamp to an N-minute grid anchored at 1970-01-01 00:00."""
    step = int(minutes) * 60
    secs = F.floor(epoch_micros(ts) / F.lit(1_000_000))
    return F.timestamp_seconds(F.floor(secs / F.lit(step)) * F.lit(step)).cast("timestamp_ntz")


def date_string(ts) -> Column:
    return F.date_format(col_(ts), "yyyy-MM-dd")


def day_of_week_monday0(ts) -> Column:
    return F.weekday(col_(ts))


def temporal_features(ts="time_bucket", peak_hours=PEAK_HOURS_A, holidays: tuple[str, ...] = ()) -> dict[str, Column]:
    """hour, weekday (Monday = 0), day, month, ISO week, date, weekend, peak-hour and holiday flags."""
    t = col_(ts)
    feats = {
        "hour_of_day": F.hour(t),
        "day_of_week": F.weekday(t),
        "day_of_month": F.dayofmonth(t),
        "month_of_year": F.month(t),
        "week_of_year": F.weekofyear(t),
        "date": date_string(t),
        "is_weekend": F.weekday(t).isin(5, 6).cast("int"),
        "is_peak_hour": F.hour(t).isin(*peak_hours).cast("int"),
    }
    feats["is_holiday"] = (
        date_string(t).isin(*holidays).cast("int") if holidays else F.lit(0)
    )
    return feats


def cyclic_time(ts="time_bucket") -> dict[str, Column]:
    t = col_(ts)
    two_pi = 2 * math.pi
    return {
        "hour_sin": F.sin(F.lit(two_pi) * F.hour(t) / F.lit(24.0)),
        "hour_cos": F.cos(F.lit(two_pi) * F.hour(t) / F.lit(24.0)),
        "dow_sin": F.sin(F.lit(two_pi) * F.weekday(t) / F.lit(7.0)),
        "dow_cos": F.cos(F.lit(two_pi) * F.weekday(t) / F.lit(7.0)),
    }


def add_minutes(ts, minutes) -> Column:
    m = minutes if isinstance(minutes, Column) else F.lit(int(minutes))
    return col_(ts) + F.make_dt_interval(F.lit(0), F.lit(0), m.cast("int"), F.lit(0))
