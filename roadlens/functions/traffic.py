"""Scalar traffic expressions (ratios, levels, severities, geo)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .timefn import col_

# City alias spellings, city boxes (min_lat, max_lat, min_lon, max_lon) and centres.
CITY_ALIASES = {
    "ha_noi": "hanoi", "hà nội": "hanoi", "hanoi": "hanoi",
    "tp.hcm": "hcmc", "tphcm": "hcmc", "hcm": "hcmc", "hcmc": "hcmc", "ho chi minh": "hcmc",
}
CITY_BOXES = {
    "hanoi": (20.9, 21.1, 105.7, 106.0),
    "hcmc": (10.5, 10.9, 106.5, 107.0),
}
# Labels returned by point-in-box city detection.
CITY_LABELS = {"hanoi": "Hanoi", "hcmc": "HCMC"}
CITY_CENTRES = {"hanoi": (21.0278, 105.8342), "hcmc": (10.7769, 106.7009)}
EARTH_RADIUS_KM = 6371.0


def normalize_city(c) -> Column:
    """lower/trim, rewrite 'ho_chi_minh'/'hochiminh' -> 'hcmc', then map known aliases; null stays null."""
    base = F.lower(F.trim(col_(c)))
    base = F.replace(F.replace(base, F.lit("ho_chi_minh"), F.lit("hcmc")), F.lit("hochiminh"), F.lit("hcmc"))
    mapping = F.create_map(*[x for k, v in CITY_ALIASES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(mapping, base), base)


def congestion_ratio(cur="currentSpeed", free="freeFlowSpeed") -> Column:
    """clip(1 - cur/free, 0, 1); 0 when free <= 0."""
    cur, free = col_(cur), col_(free)
    raw = F.when(free > 0, F.lit(1.0) - cur / free).otherwise(F.lit(0.0))
    return F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))


def speed_ratio(cur="currentSpeed", free="freeFlowSpeed") -> Column:
    cur, free = col_(cur), col_(free)
    return F.when(free > 0, cur / free).otherwise(F.lit(0.0))


def congestion_level(ratio) -> Column:
    r = col_(ratio)
    return (
        F.when(r >= 0.75, "Free").when(r >= 0.5, "Slow").when(r >= 0.3, "Congested").otherwise("Severe")
    )


def delay_minutes(ratio, jam) -> Column:
    """max(0, round_half_even((1 - clip(ratio,0,1)) * 18 + jam * 0.6))."""
    clipped = F.greatest(F.lit(0.0), F.least(col_(ratio), F.lit(1.0)))
    val = (F.lit(1.0) - clipped) * F.lit(18.0) + col_(jam) * F.lit(0.6)
    return F.greatest(F.lit(0), F.bround(val, 0).cast("bigint"))


def severity_from_jam(jam) -> Column:
    j = col_(jam)
    return F.when(j >= 8, "CRITICAL").when(j >= 6, "HIGH").when(j >= 3, "MEDIUM").otherwise("LOW")


def is_outlier(speed="currentSpeed", jam="jamFactor") -> Column:
    s, j = col_(speed), col_(jam)
    return (s < 0) | (s > 150) | (j < 0) | (j > 10)


def invalid_weather(temp="temp", humidity="humidity", pressure="pressure", visibility="visibility", wind="wind_speed") -> Column:
    t, h, p, v, w = map(col_, (temp, humidity, pressure, visibility, wind))
    return (
        (t < -50) | (t > 60) | (h < 0) | (h > 100) | (p < 800) | (p > 1100) | (v < 0) | (v > 10000) | (w < 0)
    )


def detect_city_by_point(lat="lat", lon="lon") -> Column:
    la, lo = col_(lat), col_(lon)
    expr = None
    for city, (a, b, c, d) in CITY_BOXES.items():
        cond = la.between(a, b) & lo.between(c, d)
        label = F.lit(CITY_LABELS[city])
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    la1, lo1, la2, lo2 = (F.radians(col_(x)) for x in (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin((la2 - la1) / 2), 2) + F.cos(la1) * F.cos(la2) * F.pow(F.sin((lo2 - lo1) / 2), 2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(a))


def jam_from_speeds(cur, free) -> Column:
    """clip((1 - cur/free) * 10, 0, 10) rounded to 2 (used when a provider omits jam factor)."""
    cur, free = col_(cur), col_(free)
    raw = F.when(free > 0, (F.lit(1.0) - cur / free) * F.lit(10.0)).otherwise(F.lit(0.0))
    return F.bround(F.least(F.greatest(raw, F.lit(0.0)), F.lit(10.0)), 2)
