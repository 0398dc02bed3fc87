"""Typing, defaults and quarantine for raw incident records.

Three layouts arrive (stream JSON payload, landed CSV, historical snapshot);
each has an adapter that produces the one canonical typed incident.  All
parsing uses the ``try_*`` forms: under Spark 4 ANSI mode a plain
``to_timestamp('junk')`` raises and would kill a whole micro-batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwatch.functions import calendar as cal
from gridwatch.functions.geo import wkt_point
from gridwatch.schema import RAW_INCIDENT

# ---------------------------------------------------------------------------
# Fixed values
#   default address for graph keys: 'Unknown Location'
#   CSV defaults: id 'unknown-<row>', type 'Unspecified', coordinates 0.0
#   Location node type: 'street'
# ---------------------------------------------------------------------------
UNKNOWN_ADDRESS = "Unknown Location"
UNSPECIFIED_TYPE = "Unspecified"
LOCATION_KIND = "street"

RAW_FIELDS = [f.name for f in RAW_INCIDENT.fields]


def _try_cast(c: Column, to: str) -> Column:
    """NULL instead of an error on bad text (ANSI-safe).

    Timestamps parse to TIMESTAMP_NTZ: zone-free like the stored column, so the
    result does not depend on the session time zone.
    """
    return c.try_cast(to)


def parse_payload(value: DataFrame, value_col: str = "value", seq_col: str = "seq") -> DataFrame:
    """JSON text payloads -> raw string columns (+ ``seq``, ``payload_ok``).

    Garbage text gives a row of NULLs and a NULL value gives a NULL struct; both
    are kept and flagged so the quarantine can report them rather than losing them.
    """
    parsed = F.from_json(F.col(value_col).cast("string"), RAW_INCIDENT)
    out = value.select(F.col(seq_col).cast("long").alias("seq"), parsed.alias("j"))
    all_null = F.lit(True)
    for name in RAW_FIELDS:
        all_null = all_null & F.col(f"j.{name}").isNull()
    return out.select("seq", "j.*", (~all_null).alias("payload_ok"))


def type_incidents(raw: DataFrame) -> DataFrame:
    """Raw string payload columns -> canonical typed incident (stream layout).

    Hour and weekday come from the source columns (stream semantics); the month
    is taken from ``offense_date`` later.  Geometry is WKT ``POINT(lon lat)``.
    """
    lat = _try_cast(F.col("latitude"), "double")
    lon = _try_cast(F.col("longitude"), "double")
    return raw.select(
        F.col("id"),
        F.col("narrative").alias("incident_type"),
        F.col("narrative").alias("description"),
        _try_cast(F.col("offense_date"), "timestamp_ntz").alias("offense_date"),
        _try_cast(F.col("report_date"), "timestamp_ntz").alias("report_date"),
        lat.alias("latitude"),
        lon.alias("longitude"),
        F.col("address"),
        F.col("city"),
        F.col("state"),
        _try_cast(F.col("offense_hour_of_day"), "int").alias("offense_hour"),
        F.col("offense_day_of_week"),
        wkt_point(lon, lat).alias("geometry"),
        F.col("seq").cast("long").alias("seq"),
    )


def quarantine(raw: DataFrame) -> DataFrame:
    """Rows with a defect, with a comma-joined list of reasons in a fixed order.

    Reasons: ``unparseable_payload`` (stream only), ``missing_id``, ``bad_id``
    (structured JSON where text was expected), ``bad_offense_date``,
    ``bad_report_date``, ``bad_hour`` (non-integer text), ``bad_latitude``,
    ``bad_longitude``.  Only ``missing_id`` rows are kept out of the fact table;
    the others are stored with NULLs, as the reference stores them.
    """
    def bad(name: str, to: str) -> Column:
        return F.col(name).isNotNull() & _try_cast(F.col(name), to).isNull()

    checks = []
    if "payload_ok" in raw.columns:
        checks.append(("unparseable_payload", ~F.col("payload_ok")))
    checks += [
        ("missing_id", F.col("id").isNull() | (F.col("id") == "")),
        ("bad_id", F.col("id").rlike(r"^\s*[\[{]")),
        ("bad_offense_date", bad("offense_date", "timestamp_ntz")),
        ("bad_report_date", bad("report_date", "timestamp_ntz")),
        ("bad_hour", bad("offense_hour_of_day", "int")),
        ("bad_latitude", bad("latitude", "double")),
        ("bad_longitude", bad("longitude", "double")),
    ]
    reasons = F.concat_ws(",", *[F.when(cond, F.lit(name)) for name, cond in checks])
    return (raw.select(F.col("seq").cast("long").alias("seq"), F.col("id"), reasons.alias("reasons"))
            .filter(F.col("reasons") != ""))


def has_key(df: DataFrame) -> DataFrame:
    """Drop rows that cannot be keyed (NULL or empty id, or a structured id)."""
    return df.filter(F.col("id").isNotNull() & (F.col("id") != "") & ~F.col("id").rlike(r"^\s*[\[{]"))


def with_graph_columns(typed: DataFrame, location: bool = True) -> DataFrame:
    """Add the derived columns the graph and risk products use.

    ``hour`` defaults to 0 (so a missing hour reads as night, as in the
    reference) and ``hour_imputed`` records that it was defaulted; ``month``
    defaults to 1; NULL address / weekday become 'Unknown Location' / 'Unknown'.
    ``location=False`` leaves the address out (and does not need it).
    """
    hour = cal.hour_or_default(F.col("offense_hour"))
    return typed.select(
        "*",
        hour.alias("hour"),
        F.col("offense_hour").isNull().alias("hour_imputed"),
        cal.month_or_default(F.col("offense_date")).alias("month"),
        cal.season_of_month(cal.month_or_default(F.col("offense_date"))).alias("season"),
        cal.part_of_day(hour).alias("part_of_day"),
        F.coalesce(F.col("offense_day_of_week"), F.lit(cal.UNKNOWN_DAY)).alias("day_name"),
        *([F.coalesce(F.col("address"), F.lit(UNKNOWN_ADDRESS)).alias("location_key")] if location else []),
    )


def calendar_parts(typed: DataFrame) -> DataFrame:
    """Hour, month and weekday name computed from the timestamp itself."""
    ts = F.col("offense_date")
    return typed.select(
        "id", "seq",
        F.hour(ts).alias("ts_hour"),
        F.month(ts).alias("ts_month"),
        cal.day_name(ts).alias("ts_day_name"),
        cal.season_of_month(cal.month_or_default(ts)).alias("season"),
        cal.part_of_day(cal.hour_or_default(F.hour(ts))).alias("ts_part_of_day"),
    )


# ---------------------------------------------------------------------------
# Other layouts -> canonical
# ---------------------------------------------------------------------------

def csv_to_typed(csv: DataFrame, seq_col: str = "seq") -> DataFrame:
    """Landed CSV (header names) -> canonical typed incident (CSV semantics).

    Hour, weekday and month all come from the parsed timestamp; an unparseable
    date gives hour 0, weekday 'Unknown' and month 1.  Empty cells count as
    missing, so the column defaults apply to them too.
    """
    raw_date = F.col("`Incident Date`")
    ts = F.coalesce(
        _try_cast(raw_date, "timestamp_ntz"),
        F.try_to_timestamp(raw_date, F.lit("M/d/yyyy H:mm[:ss]")).cast("timestamp_ntz"),
        F.try_to_timestamp(raw_date, F.lit("M/d/yyyy")).cast("timestamp_ntz"),
    )
    seq = F.col(seq_col).cast("long")
    lat = F.coalesce(F.col("Latitude"), F.lit(0.0))
    lon = F.coalesce(F.col("Longitude"), F.lit(0.0))
    ctype = F.coalesce(F.nullif(F.col("`Crime Type`"), F.lit("")), F.lit(UNSPECIFIED_TYPE))
    return csv.select(
        F.coalesce(F.nullif(F.col("ID"), F.lit("")),
                   F.concat(F.lit("unknown-"), seq.cast("string"))).alias("id"),
        ctype.alias("incident_type"),
        ctype.alias("description"),
        ts.alias("offense_date"),
        F.lit(None).cast("timestamp_ntz").alias("report_date"),
        lat.alias("latitude"),
        lon.alias("longitude"),
        F.coalesce(F.nullif(F.col("Location"), F.lit("")), F.lit(UNKNOWN_ADDRESS)).alias("address"),
        F.lit(None).cast("string").alias("city"),
        F.lit(None).cast("string").alias("state"),
        F.coalesce(F.hour(ts), F.lit(cal.DEFAULT_HOUR)).alias("offense_hour"),
        F.coalesce(cal.day_name(ts), F.lit(cal.UNKNOWN_DAY)).alias("offense_day_of_week"),
        wkt_point(lon, lat).alias("geometry"),
        seq.alias("seq"),
    )


def snapshot_to_raw(snap: DataFrame, seq_col: str = "seq") -> DataFrame:
    """Historical snapshot record -> raw payload columns (then ``type_incidents``)."""
    cols = {name: F.lit(None).cast("string") for name in RAW_FIELDS}
    cols.update({
        "id": F.col("incident_id"),
        "narrative": F.col("incident_type"),
        "offense_date": F.col("incident_date"),
        "latitude": F.col("latitude"),
        "longitude": F.col("longitude"),
    })
    return snap.select(F.col(seq_col).cast("long").alias("seq"),
                       *[cols[n].alias(n) for n in RAW_FIELDS])
