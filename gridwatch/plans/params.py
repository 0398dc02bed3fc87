"""Parameters of the registered queries (shared by the Spark plans and the oracle SQL)."""

from gridwatch.functions import geo

HISTORY_DAY = "2024-01-15"        # date looked up by history_by_date
SNAPSHOT_ROWS = 4_321             # rows asked for by snapshot_limit
LOOKUP_HOUR = 23                  # hour requested by risk_at_hour / risk_labels
NEAR_PLACE_M = geo.NEAR_PLACE_M   # incident-to-place threshold (strict <), fixed value
NEAR_INCIDENT_M = 500.0           # incident-to-incident threshold (strict <)
NEAR_INCIDENT_DAYS = 7            # incident-to-incident time limit (<=)
RADIUS_M = 1000.0                 # radius lookup
# Points asked for by the radius lookup: (point_id, lat, lon).
RADIUS_POINTS = [(1, 29.6551, -82.3352), (2, 29.6243, -82.3617), (3, 29.6507, -82.4012)]
GRID_DEG = geo.GRID_DEG           # display / prediction grid cell size (degrees)
HIGH_RISK = 0.5                   # grid score threshold for HIGH_RISK_FOR
TOP_K = 20                        # top high-risk cells
EVIDENCE_DAYS = 30                # evidence look-back window
BAND_START_HOUR = 22              # evidence hour band start (wraps past midnight)
BAND_END_HOUR = 2                 # evidence hour band end (exclusive)
MODEL_VERSION = "count-v1"
MAP_VIEW = (29.6200, -82.3800, 29.6800, -82.3000)  # south, west, north, east of a map view
PREDICTION_TIME = "2024-01-26 23:00:00"   # a Friday night
PREDICTION_TIMES = ["2024-01-26 23:00:00", "2024-01-27 14:00:00"]
STREAM_BATCHES = 4                # micro-batches of the stream feeds
STREAM_FILE_ROWS = 20_000         # records in a landed file
WINDOW_SIZE = "1 day"
LATE_DAYS = 60                    # how much earlier the late rows of the late feed lie
CLUSTER_M = 300.0                 # clusters: NEAR means closer than this (strict <)
CLUSTER_DAYS = 1                  # ... and at most so many days apart
CLUSTER_MIN_NEAR = 4              # ... and a core has at least so many others NEAR
KERNEL_VERSION = "kernel-v1"
KERNEL_HALF_LIFE_DAYS = 7.0
KERNEL_BANDWIDTH_M = 250.0
KERNEL_REACH_M = 750.0
TERRAIN_REACH_M = 400.0           # risk terrain: a place counts for a cell whose centre is closer
