"""Calendar dates, instants and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict_date(col: Column) -> Column:
    """A YYYY-MM-DD day, or null for any other shape or an impossible day."""
    return F.when(
        col.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(col, F.lit("yyyy-MM-dd")).cast("date")
    )


def days_between(start: Column, end: Column) -> Column:
    return F.date_diff(end, start)


def freshness(checked: Column, as_of: Column, cadence: Column, forced: Column | None = None) -> Column:
    """fresh / due / stale / undated; null where the class has no cadence.

    A date in the future is `undated` even for a forced-stale class. Age equal
    to the cadence is not stale; age equal to nine tenths of it is not due.
    """
    age = days_between(checked, as_of)
    forced = F.lit(False) if forced is None else forced
    return (
        F.when(cadence.isNull() | checked.isNull(), F.lit(None).cast("string"))
        .when(age < 0, "undated")
        .when(forced | (age > cadence), "stale")
        .when(age * 10 > cadence * 9, "due")
        .otherwise("fresh")
    )


def qualify_instant(naive: Column, offset_seconds: Column) -> Column:
    """Naive local time plus its own offset as an ISO instant string."""
    total = F.abs(offset_seconds)
    return F.concat(
        naive,
        F.when(offset_seconds < 0, "-").otherwise("+"),
        F.lpad(F.floor(total / 3600).cast("string"), 2, "0"),
        F.lit(":"),
        F.lpad(F.floor((total % 3600) / 60).cast("string"), 2, "0"),
    )


def round_half_up(col: Column) -> Column:
    """Halves go towards positive infinity."""
    return F.floor(col + F.lit(0.5)).cast("long")


def code_label(code: Column, labels: dict[int, str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.try_element_at(table, code), F.lit("unknown"))


# Weather condition codes and their catalogue keys.
CONDITIONS = {
    0: "clearSky",
    1: "mainlyClear",
    2: "partlyCloudy",
    3: "overcast",
    45: "fog",
    48: "freezingFog",
    51: "lightDrizzle",
    53: "drizzle",
    55: "heavyDrizzle",
    56: "lightFreezingDrizzle",
    57: "freezingDrizzle",
    61: "lightRain",
    63: "rain",
    65: "heavyRain",
    66: "lightFreezingRain",
    67: "freezingRain",
    71: "lightSnow",
    73: "snow",
    75: "heavySnow",
    77: "snowGrains",
    80: "lightRainShowers",
    81: "rainShowers",
    82: "heavyRainShowers",
    85: "lightSnowShowers",
    86: "snowShowers",
    95: "thunderstorms",
    96: "thunderstormsWithHail",
    99: "thunderstormsWithHeavyHail",
}
