"""Calendar derivations as native column expressions (no Python UDFs).

Everything here compiles into whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for equal results)
#   seasons by month:  12, 1, 2 -> Winter; 3, 4, 5 -> Spring; 6, 7, 8 -> Summer;
#                      any other month -> Fall
#   parts of day by hour: 5..11 -> morning; 12..16 -> afternoon;
#                         17..20 -> evening; any other hour -> night
#   defaults: missing hour -> 0, missing month -> 1, missing day name -> Unknown
#   risk bands: night = {night}; day = {morning, afternoon}; evening in neither
#   risk colour: score > 5 -> red, else orange
# ---------------------------------------------------------------------------
WINTER_MONTHS = (12, 1, 2)
SPRING_MONTHS = (3, 4, 5)
SUMMER_MONTHS = (6, 7, 8)
DEFAULT_HOUR = 0
DEFAULT_MONTH = 1
UNKNOWN_DAY = "Unknown"
NIGHT_PARTS = ("night",)
DAY_PARTS = ("morning", "afternoon")
RED_ABOVE = 5


def season_of_month(month: Column) -> Column:
    """Season name for a month number; anything not listed (incl. NULL) is Fall."""
    return (F.when(month.isin(*WINTER_MONTHS), "Winter")
            .when(month.isin(*SPRING_MONTHS), "Spring")
            .when(month.isin(*SUMMER_MONTHS), "Summer")
            .otherwise("Fall"))


def part_of_day(hour: Column) -> Column:
    """Part of day for an hour; out-of-range and NULL hours fall to night."""
    return (F.when((hour >= 5) & (hour < 12), "morning")
            .when((hour >= 12) & (hour < 17), "afternoon")
            .when((hour >= 17) & (hour < 21), "evening")
            .otherwise("night"))


def day_name(ts: Column) -> Column:
    """Full English weekday name (``Monday``), not the 3-letter ``dayname``."""
    return F.date_format(ts, "EEEE")


def hour_or_default(hour: Column) -> Column:
    return F.coalesce(hour, F.lit(DEFAULT_HOUR))


def month_or_default(ts: Column) -> Column:
    return F.coalesce(F.month(ts), F.lit(DEFAULT_MONTH))


def hour_label(hour: Column) -> Column:
    """12-hour clock label: 0 -> '12:00 AM', 13 -> '1:00 PM'."""
    h12 = F.coalesce(F.nullif(hour % 12, F.lit(0)), F.lit(12))
    ampm = F.when(hour >= 12, "PM").otherwise("AM")
    return F.concat(h12.cast("string"), F.lit(":00 "), ampm)


def risk_colour(score: Column) -> Column:
    return F.when(score > RED_ABOVE, "red").otherwise("orange")


def current_hour() -> Column:
    """Hour of the session clock (the UI's default hour); non-deterministic by nature."""
    return F.hour(F.current_timestamp())
