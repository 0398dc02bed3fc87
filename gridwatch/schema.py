"""Declared schemas: raw payloads, canonical incident, stored tables.

Raw payloads are read with an explicit schema (never inferred), so a scan of
100 TB does not start with an inference pass and a malformed field cannot
change a column's type.
"""

from __future__ import annotations

from pyspark.sql import types as T

S = T.StringType()

# Stream payload: every field a nullable string (the topic carries JSON text).
RAW_INCIDENT = T.StructType([
    T.StructField(name, S, True) for name in (
        "id", "narrative", "report_date", "offense_date", "offense_hour_of_day",
        "offense_day_of_week", "address", "latitude", "longitude", "city", "state")
])

# Landed CSV: header names as they appear in the file.
CSV_INCIDENT = T.StructType([
    T.StructField("ID", S, True),
    T.StructField("Crime Type", S, True),
    T.StructField("Location", S, True),
    T.StructField("Latitude", T.DoubleType(), True),
    T.StructField("Longitude", T.DoubleType(), True),
    T.StructField("Incident Date", S, True),
])

# Historical snapshot records (the open-data list): strings only.
SNAPSHOT_INCIDENT = T.StructType([
    T.StructField("incident_id", S, True),
    T.StructField("incident_type", S, True),
    T.StructField("incident_date", S, True),
    T.StructField("latitude", S, True),
    T.StructField("longitude", S, True),
])

# Canonical typed incident (the fact table's columns plus ``seq``).
FACT_COLUMNS = [
    "id", "incident_type", "description", "offense_date", "report_date",
    "latitude", "longitude", "address", "city", "state", "offense_hour",
    "offense_day_of_week", "geometry",
]
FACT = T.StructType([
    T.StructField("id", S, False),
    T.StructField("incident_type", S, True),
    T.StructField("description", S, True),
    T.StructField("offense_date", T.TimestampNTZType(), True),
    T.StructField("report_date", T.TimestampNTZType(), True),
    T.StructField("latitude", T.DoubleType(), True),
    T.StructField("longitude", T.DoubleType(), True),
    T.StructField("address", S, True),
    T.StructField("city", S, True),
    T.StructField("state", S, True),
    T.StructField("offense_hour", T.IntegerType(), True),
    T.StructField("offense_day_of_week", S, True),
    T.StructField("geometry", S, True),
    T.StructField("seq", T.LongType(), False),
])

# Prediction cache table.  The serial id is replaced by the natural key
# (grid_id, incident_type, prediction_time, model_version).
PREDICTION = T.StructType([
    T.StructField("grid_id", S, False),
    T.StructField("incident_type", S, False),
    T.StructField("prediction_time", T.TimestampNTZType(), False),
    T.StructField("risk_score", T.DoubleType(), True),
    T.StructField("model_version", S, False),
    T.StructField("created_at", T.TimestampType(), True),
])

# One element of a POI dump: nodes carry lat/lon, ways carry a centre.
POI_ELEMENT = T.StructType([
    T.StructField("type", S, True),
    T.StructField("id", T.LongType(), True),
    T.StructField("lat", T.DoubleType(), True),
    T.StructField("lon", T.DoubleType(), True),
    T.StructField("center", T.StructType([
        T.StructField("lat", T.DoubleType(), True),
        T.StructField("lon", T.DoubleType(), True),
    ]), True),
    T.StructField("tags", T.MapType(S, S), True),
])
POI_DOCUMENT = T.StructType([T.StructField("elements", T.ArrayType(POI_ELEMENT), True)])
