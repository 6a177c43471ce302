"""Silver cleaning: projections, filters, type coercion."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import traffic as TF
from ..functions.timefn import date_string, floor_bucket, to_local_time

TRAFFIC_REQUIRED = ("city", "segment_id", "event_time", "currentSpeed", "freeFlowSpeed", "jamFactor")
WEATHER_REQUIRED = ("city", "weather_cell_id", "event_time", "temp", "humidity", "visibility", "wind_speed")
TRAFFIC_KEEP = (
    "event_id", "source", "provider", "city", "segment_id", "segment_name", "weather_cell_id", "lat", "lon",
    "geometry", "event_time", "time_bucket", "currentSpeed", "freeFlowSpeed", "jamFactor", "confidence", "roadClosure",
)
WEATHER_KEEP = (
    "event_id", "source", "provider", "city", "weather_cell_id", "lat", "lon", "event_time", "time_bucket", "temp",
    "feels_like", "humidity", "pressure", "visibility", "rain_1h", "wind_speed", "wind_deg", "weather_main",
    "weather_desc",
)
TRAFFIC_NUMERIC = ("lat", "lon", "currentSpeed", "freeFlowSpeed", "jamFactor", "confidence")
WEATHER_NUMERIC = ("lat", "lon", "temp", "feels_like", "humidity", "pressure", "visibility", "rain_1h", "wind_speed", "wind_deg")


def _require(df: DataFrame, cols: Iterable[str], what: str) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"{what} raw data is missing required columns: {missing}")


def local_time_of(df: DataFrame, col: str):
    """Wall-clock local time of a column: NTZ input is already local; text/instants are UTC."""
    dtype = dict(df.dtypes)[col]
    if dtype == "timestamp_ntz":
        return F.col(col)
    return to_local_time(col)


def coerce_numeric(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Non-numeric values -> null on the listed columns (present ones only)."""
    present = [c for c in cols if c in df.columns]
    return df.withColumns({c: F.col(c).try_cast("double") for c in present})


def normalize_city(df: DataFrame, col: str = "city") -> DataFrame:
    return df.withColumn(col, TF.normalize_city(col))


def _time_columns(df: DataFrame, bucket_minutes: int) -> DataFrame:
    ts = local_time_of(df, "event_time")
    src_bucket = local_time_of(df, "time_bucket") if "time_bucket" in df.columns else None
    df = df.withColumn("timestamp", ts)
    df = df.withColumn("source_time_bucket", src_bucket if src_bucket is not None else F.col("timestamp"))
    return df.withColumn("time_bucket", floor_bucket("timestamp", bucket_minutes))


def clean_traffic(df: DataFrame, bucket_minutes: int = 5) -> DataFrame:
    """Silver traffic (verified path): keep known columns, local time, bucket, coerce, drop nulls, ranges, date."""
    _require(df, TRAFFIC_REQUIRED, "Traffic")
    df = df.select(*[c for c in TRAFFIC_KEEP if c in df.columns])
    df = normalize_city(df)
    df = _time_columns(df, bucket_minutes)
    df = coerce_numeric(df, TRAFFIC_NUMERIC)
    df = df.dropna(subset=["city", "segment_id", "timestamp", "time_bucket", "currentSpeed", "freeFlowSpeed", "jamFactor"])
    df = df.filter(
        F.col("currentSpeed").between(0, 150) & F.col("freeFlowSpeed").between(1, 180) & F.col("jamFactor").between(0, 10)
    )
    return df.withColumn("date", date_string("time_bucket"))


def clean_weather(df: DataFrame, bucket_minutes: int = 5) -> DataFrame:
    """Silver weather (verified path); a missing rain column becomes 0."""
    _require(df, WEATHER_REQUIRED, "Weather")
    df = df.select(*[c for c in WEATHER_KEEP if c in df.columns])
    df = normalize_city(df)
    df = _time_columns(df, bucket_minutes)
    df = coerce_numeric(df, WEATHER_NUMERIC)
    if "rain_1h" not in df.columns:
        df = df.withColumn("rain_1h", F.lit(0.0))
    df = df.dropna(subset=["city", "weather_cell_id", "timestamp", "time_bucket"])
    return df.filter(
        F.col("temp").between(-50, 60)
        & F.col("humidity").between(0, 100)
        & F.col("visibility").between(0, 10000)
        & (F.col("wind_speed") >= 0)
    )


def null_flags_and_drop(df: DataFrame, kind: str = "traffic") -> DataFrame:
    """``has_null_*`` flags, then drop rows lacking the key fields (lakehouse path)."""
    if kind == "traffic":
        flagged = ("currentSpeed", "freeFlowSpeed", "jamFactor", "event_time", "segment_id")
        required = ("currentSpeed", "event_time", "segment_id")
    else:
        flagged = ("temp", "humidity", "event_time", "city", "weather_cell_id")
        required = ("event_time", "city", "weather_cell_id")
    df = df.withColumns({f"has_null_{c}": F.col(c).isNull() for c in flagged if c in df.columns})
    return df.dropna(subset=[c for c in required if c in df.columns])


def bbox_filter(df: DataFrame, lat: str = "lat", lon: str = "lon", city: str = "city") -> DataFrame:
    """Keep rows whose point lies in the box of their own city (bounds inclusive).

    The box table has one row per configured city, so it is folded into one predicate
    instead of a join.
    """
    cond = None
    for name, (a, b, c, d) in TF.CITY_BOXES.items():
        one = (F.col(city) == name) & F.col(lat).between(a, b) & F.col(lon).between(c, d)
        cond = one if cond is None else cond | one
    return df.filter(cond)


def flag_outliers(df: DataFrame) -> DataFrame:
    return df.withColumn("is_outlier", TF.is_outlier())


def flag_invalid_weather(df: DataFrame) -> DataFrame:
    return df.withColumn("is_invalid", TF.invalid_weather())


def clean_traffic_lakehouse(df: DataFrame) -> DataFrame:
    """Lakehouse Silver traffic: stamp +7 h, null flags/drop, box filter, outlier flag and
    ``filter(is_outlier == False)`` (rows with a null flag are dropped, as in SQL)."""
    df = df.withColumn("event_time_std", F.col("event_time") + F.expr("INTERVAL 7 HOURS"))
    df = null_flags_and_drop(df, "traffic")
    df = bbox_filter(df)
    df = flag_outliers(df).filter(F.col("is_outlier") == F.lit(False))
    return df.withColumn("date", date_string("event_time_std"))


def clean_weather_lakehouse(df: DataFrame) -> DataFrame:
    df = df.withColumn("event_time_std", F.col("event_time") + F.expr("INTERVAL 7 HOURS"))
    if "rain_1h" not in df.columns:
        df = df.withColumn("rain_1h", F.lit(0.0))
    df = null_flags_and_drop(df, "weather")
    return flag_invalid_weather(df).filter(F.col("is_invalid") == F.lit(False))
