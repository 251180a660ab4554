"""Display formats for the decision tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _dash(cond: Column, value: Column) -> Column:
    return F.when(cond, F.lit("-")).otherwise(value)


def fixed(x: Column, digits: int = 0) -> Column:
    """Plain decimal text with a fixed number of digits."""
    return F.format_string(f"%.{digits}f", x.cast("double"))


def half_up(x: Column) -> Column:
    """Nearest integer, a tie going up."""
    return F.floor(x + 0.5).cast("long")


def clock(t: Column) -> Column:
    return _dash(t.isNull(), F.concat(F.date_format(t, "HH:mm"), F.lit("Z")))


def date_clock(t: Column) -> Column:
    return _dash(t.isNull(), F.concat(F.date_format(t, "d MMM HH:mm"), F.lit("Z")))


def percent(x: Column, digits: int = 0) -> Column:
    return _dash(x.isNull() | F.isnan(x), F.concat(fixed(x * 100, digits), F.lit("%")))


def minutes(x: Column) -> Column:
    return _dash(x.isNull() | F.isnan(x), F.concat(half_up(x).cast("string"), F.lit(" min")))


def lead_band(lead: Column, low: Column, high: Column) -> Column:
    mid = half_up(lead)
    base = F.concat(mid.cast("string"), F.when(mid < 0, " min (past)").otherwise(" min"))
    band = F.concat(
        base,
        F.lit("  ·  80% band "),
        half_up(low).cast("string"),
        F.lit("-"),
        half_up(high).cast("string"),
    )
    return (
        F.when(lead.isNull(), F.lit("no ETA"))
        .when(low.isNull() | high.isNull(), base)
        .otherwise(band)
    )


def grouped_number(x: Column) -> Column:
    return _dash(x.isNull() | F.isnan(x), F.format_number(x, 0))


def area_km2(x: Column) -> Column:
    return _dash(x.isNull() | F.isnan(x), F.concat(fixed(x, 2), F.lit(" km²")))


def wind(ms: Column) -> Column:
    return F.concat(fixed(ms, 1), F.lit(" m/s · "), fixed(ms * 3.6, 0), F.lit(" km/h"))


def urgency_label(u: Column) -> Column:
    return F.when(u >= 0.66, "HIGH").when(u >= 0.33, "MODERATE").otherwise("LOW")
