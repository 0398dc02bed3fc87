"""Independent SQL (DuckDB dialect) for every registered query.

These are the correctness oracles: written directly from the reference's
semantics (graph paths counted literally, row_number for first/last-wins,
brute-force distance for spatial joins), not from the Spark plans.
"""

from __future__ import annotations

# Stand-in raw payloads (same arithmetic as gridwatch.sources.standin).
RAW = r"""
raw AS (
  SELECT event_id AS seq,
    CAST(CASE WHEN event_id % 50 = 49 THEN event_id - 1 ELSE event_id END AS VARCHAR) AS id,
    event_type AS narrative,
    CAST(ts + INTERVAL 1 DAY AS VARCHAR) AS report_date,
    CASE WHEN event_id % 43 = 0 THEN 'bad' ELSE CAST(ts AS VARCHAR) END AS offense_date,
    CASE WHEN event_id % 47 = 0 THEN NULL ELSE CAST(hour(ts) AS VARCHAR) END AS offense_hour_of_day,
    dayname(ts) AS offense_day_of_week,
    'ADDR-' || CAST(user_id AS VARCHAR) AS address,
    CASE WHEN event_id % 41 = 0 THEN NULL ELSE CAST(round(29.59 + (user_id * 37 % 131) * 0.001
         + (event_id % 3) * 0.0001, 4) AS VARCHAR) END AS latitude,
    CAST(round(-82.42 + (user_id * 53 % 151) * 0.001 + (event_id % 5) * 0.0001, 4) AS VARCHAR) AS longitude,
    'Springfield' AS city, 'ST' AS state
  FROM events
)"""

TYPED = r"""
typed AS (
  SELECT id, narrative AS incident_type, narrative AS description,
    TRY_CAST(offense_date AS TIMESTAMP) AS offense_date,
    TRY_CAST(report_date AS TIMESTAMP) AS report_date,
    TRY_CAST(latitude AS DOUBLE) AS latitude,
    TRY_CAST(longitude AS DOUBLE) AS longitude,
    address, city, state,
    TRY_CAST(offense_hour_of_day AS INTEGER) AS offense_hour,
    offense_day_of_week,
    'POINT(' || CAST(TRY_CAST(longitude AS DOUBLE) AS VARCHAR) || ' '
      || CAST(TRY_CAST(latitude AS DOUBLE) AS VARCHAR) || ')' AS geometry,
    seq
  FROM raw
)"""

KEYED = r"""
keyed AS (
  SELECT * FROM typed
  WHERE id IS NOT NULL AND id <> '' AND NOT regexp_matches(id, '^\s*[\[{]')
)"""

G = r"""
g AS (
  SELECT *,
    COALESCE(offense_hour, 0) AS hour,
    offense_hour IS NULL AS hour_imputed,
    CAST(COALESCE(month(offense_date), 1) AS INTEGER) AS month,
    CASE WHEN COALESCE(month(offense_date), 1) IN (12, 1, 2) THEN 'Winter'
         WHEN COALESCE(month(offense_date), 1) IN (3, 4, 5) THEN 'Spring'
         WHEN COALESCE(month(offense_date), 1) IN (6, 7, 8) THEN 'Summer'
         ELSE 'Fall' END AS season,
    CASE WHEN COALESCE(offense_hour, 0) >= 5 AND COALESCE(offense_hour, 0) < 12 THEN 'morning'
         WHEN COALESCE(offense_hour, 0) >= 12 AND COALESCE(offense_hour, 0) < 17 THEN 'afternoon'
         WHEN COALESCE(offense_hour, 0) >= 17 AND COALESCE(offense_hour, 0) < 21 THEN 'evening'
         ELSE 'night' END AS part_of_day,
    COALESCE(offense_day_of_week, 'Unknown') AS day_name,
    COALESCE(address, 'Unknown Location') AS location_key
  FROM keyed
)"""

FACT = r"""
fact AS (
  SELECT id, incident_type, description, offense_date, report_date, latitude, longitude,
         address, city, state, offense_hour, offense_day_of_week, geometry, seq
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS rn FROM keyed) WHERE rn = 1
)"""

# Graph pieces, stated the way the graph patterns read.
EDGES = r"""
occ_at AS (SELECT DISTINCT id AS case_id, location_key AS address FROM g),
occ_during AS (SELECT DISTINCT id AS case_id, hour FROM g),
time_block AS (
  SELECT hour, part_of_day FROM (
    SELECT hour, part_of_day, row_number() OVER (PARTITION BY hour ORDER BY seq DESC) AS rn FROM g
  ) WHERE rn = 1
),
location AS (
  SELECT location_key AS address, latitude AS lat, longitude AS lon FROM (
    SELECT location_key, latitude, longitude,
           row_number() OVER (PARTITION BY location_key ORDER BY seq) AS rn FROM g
  ) WHERE rn = 1
),
paths AS (
  SELECT a.address, a.case_id, tb.part_of_day
  FROM occ_at a JOIN occ_during d ON a.case_id = d.case_id JOIN time_block tb ON d.hour = tb.hour
)"""


# Stand-in POI elements (same arithmetic as gridwatch.sources.standin).
ELEMENTS = r"""
el AS (
  SELECT CASE WHEN p_partkey % 2 = 0 THEN 'node' ELSE 'way' END AS type,
    p_partkey AS id,
    CASE WHEN p_partkey % 2 = 0 THEN
      CASE WHEN p_partkey % 97 = 0 THEN NULL WHEN p_partkey % 89 = 0 THEN 0.0::DOUBLE
           ELSE 29.59::DOUBLE + (p_partkey * 41 % 131) * 0.001::DOUBLE END END AS lat,
    CASE WHEN p_partkey % 2 = 0 AND p_partkey % 97 <> 0 THEN
      -82.42::DOUBLE + (p_partkey * 29 % 151) * 0.001::DOUBLE END AS lon,
    CASE WHEN p_partkey % 2 = 1 AND p_partkey % 97 <> 0 THEN
      29.59::DOUBLE + (p_partkey * 41 % 131) * 0.001::DOUBLE END AS c_lat,
    CASE WHEN p_partkey % 2 = 1 AND p_partkey % 97 <> 0 THEN
      -82.42::DOUBLE + (p_partkey * 29 % 151) * 0.001::DOUBLE END AS c_lon,
    ['bar', 'pub', 'nightclub', 'restaurant', 'cafe', 'atm', 'bank', 'school', 'university',
     'parking', 'fast_food', 'fuel', 'bicycle_parking'][(p_size % 13) + 1] AS amenity,
    CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_name END AS name, seq
  FROM (SELECT p_partkey, p_size, p_name, p_partkey AS seq FROM part
        UNION ALL SELECT p_partkey, p_size + 1, upper(p_name), p_partkey + 4294967296 FROM part WHERE p_partkey % 10 = 0)
)"""


def flat_pois(bbox=None) -> str:
    box = ""
    if bbox is not None:
        s, w, n, e = bbox
        box = f"AND lat BETWEEN {s} AND {n} AND lon BETWEEN {w} AND {e}"
    return f"""
flat AS (
  SELECT id, type, amenity, COALESCE(name, 'Unknown') AS name,
    COALESCE(NULLIF(lat, 0.0), c_lat) AS lat, COALESCE(NULLIF(lon, 0.0), c_lon) AS lon, seq
  FROM el
  WHERE type IN ('node', 'way')
    AND regexp_matches(amenity, 'bar|pub|nightclub|restaurant|cafe|atm|bank|school|university|parking')
),
pois AS (
  SELECT id, type, amenity, name, lat, lon FROM (
    SELECT *, row_number() OVER (PARTITION BY type, id ORDER BY seq DESC) AS rn
    FROM flat
    WHERE lat IS NOT NULL AND lat <> 0 AND lon IS NOT NULL AND lon <> 0 {box}
  ) WHERE rn = 1
),
places AS (
  SELECT type AS osm_type, id AS osm_id, COALESCE(name, 'Unknown') AS name,
         COALESCE(amenity, 'unknown') AS amenity_type, lat, lon
  FROM pois WHERE lat IS NOT NULL AND lon IS NOT NULL
)"""


def hav(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (f"(12756280.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, "
            f"pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) "
            f"* pow(sin(radians({lon2} - {lon1}) / 2), 2)))))")


NEAR_PATHS = """
lp AS (
  SELECT l.address, p.osm_type, p.osm_id, p.amenity_type, {d} AS d
  FROM location l, places p
  WHERE l.lat IS NOT NULL AND l.lon IS NOT NULL AND {d} < {radius}
),
near_paths AS (
  SELECT a.case_id, a.address, lp.osm_type, lp.osm_id, lp.amenity_type, lp.d
  FROM occ_at a JOIN lp ON a.address = lp.address
)"""


def near_paths(radius: float) -> str:
    return NEAR_PATHS.format(d=hav("l.lat", "l.lon", "p.lat", "p.lon"), radius=radius)


CELLS_TMPL = """
gf AS ({g_body}),
cells AS (
  SELECT *, CAST(cy AS VARCHAR) || ':' || CAST(cx AS VARCHAR) AS grid_id FROM (
    SELECT *, CAST(floor(latitude / {deg}::DOUBLE) AS BIGINT) AS cy,
              CAST(floor(longitude / {deg}::DOUBLE) AS BIGINT) AS cx
    FROM gf WHERE latitude IS NOT NULL AND longitude IS NOT NULL)
)"""


def cells(deg: float) -> str:
    g_body = G.strip()[len("g AS ("):-1].replace("FROM keyed", "FROM fact")
    return CELLS_TMPL.format(g_body=g_body, deg=deg)


def with_ctes(*ctes: str, body: str) -> str:
    return "WITH " + ",".join(ctes) + "\n" + body


BASE = (RAW, TYPED, KEYED, G)


def _risk_band(parts: str) -> str:
    return with_ctes(*BASE, EDGES, body=f"""
SELECT address, CAST(count(*) AS BIGINT) AS risk_score,
       CAST(count(DISTINCT case_id) AS BIGINT) AS incidents
FROM paths WHERE part_of_day IN ({parts})
GROUP BY address""")


def _risk_at_hour(hour: int) -> str:
    # A requested hour maps to its band by the part-of-day rule.
    if 5 <= hour < 17:
        parts = "'morning', 'afternoon'"
    elif 17 <= hour < 21:
        parts = "NULL"
    else:
        parts = "'night'"
    return f"""
risk AS (
  SELECT address, CAST(count(*) AS BIGINT) AS risk FROM paths
  WHERE part_of_day IN ({parts}) GROUP BY address
)"""


def sql() -> dict[str, str]:
    from gridwatch.plans import params as P

    q: dict[str, str] = {}

    q["typed_incidents"] = with_ctes(RAW, TYPED, body=
        "SELECT * REPLACE (CAST(offense_hour AS DOUBLE) AS offense_hour) FROM typed")

    q["risk_night"] = _risk_band("'night'")
    q["risk_table"] = with_ctes(*BASE, EDGES, body="""
SELECT address, CASE WHEN part_of_day = 'night' THEN 'night' ELSE 'day' END AS band,
       CAST(count(*) AS BIGINT) AS risk_score, CAST(count(DISTINCT case_id) AS BIGINT) AS incidents
FROM paths WHERE part_of_day IN ('night', 'morning', 'afternoon')
GROUP BY address, CASE WHEN part_of_day = 'night' THEN 'night' ELSE 'day' END""")
    q["risk_day"] = _risk_band("'morning', 'afternoon'")

    q["fact_first_wins"] = with_ctes(RAW, TYPED, KEYED, FACT, body=
        "SELECT * REPLACE (CAST(offense_hour AS DOUBLE) AS offense_hour) FROM fact")

    q["incident_last_wins"] = with_ctes(RAW, TYPED, KEYED, body="""
SELECT id AS case_id, incident_type, description FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn FROM keyed
) WHERE rn = 1""")

    q["quarantine"] = with_ctes(RAW, body=r"""
SELECT * FROM (
  SELECT seq, id, concat_ws(',',
    CASE WHEN id IS NULL OR id = '' THEN 'missing_id' END,
    CASE WHEN regexp_matches(id, '^\s*[\[{]') THEN 'bad_id' END,
    CASE WHEN offense_date IS NOT NULL AND TRY_CAST(offense_date AS TIMESTAMP) IS NULL THEN 'bad_offense_date' END,
    CASE WHEN report_date IS NOT NULL AND TRY_CAST(report_date AS TIMESTAMP) IS NULL THEN 'bad_report_date' END,
    CASE WHEN offense_hour_of_day IS NOT NULL AND TRY_CAST(offense_hour_of_day AS INTEGER) IS NULL THEN 'bad_hour' END,
    CASE WHEN latitude IS NOT NULL AND TRY_CAST(latitude AS DOUBLE) IS NULL THEN 'bad_latitude' END,
    CASE WHEN longitude IS NOT NULL AND TRY_CAST(longitude AS DOUBLE) IS NULL THEN 'bad_longitude' END
  ) AS reasons FROM raw
) WHERE reasons <> ''""")

    q["csv_incidents"] = with_ctes(RAW, body="""
SELECT id, narrative AS incident_type, address,
  COALESCE(TRY_CAST(latitude AS DOUBLE), 0.0) AS latitude,
  COALESCE(TRY_CAST(longitude AS DOUBLE), 0.0) AS longitude,
  COALESCE(CAST(hour(TRY_CAST(offense_date AS TIMESTAMP)) AS INTEGER), 0) AS offense_hour,
  COALESCE(dayname(TRY_CAST(offense_date AS TIMESTAMP)), 'Unknown') AS offense_day_of_week,
  TRY_CAST(offense_date AS TIMESTAMP) AS offense_date
FROM raw""")

    q["season_daypart"] = with_ctes(*BASE, body="""
SELECT id, seq, hour, hour_imputed, month, season, part_of_day, day_name FROM g""")

    q["calendar_parts"] = with_ctes(RAW, TYPED, KEYED, body="""
SELECT id, seq,
  CAST(hour(offense_date) AS DOUBLE) AS ts_hour,
  CAST(month(offense_date) AS DOUBLE) AS ts_month,
  dayname(offense_date) AS ts_day_name,
  CASE WHEN COALESCE(month(offense_date), 1) IN (12, 1, 2) THEN 'Winter'
       WHEN COALESCE(month(offense_date), 1) IN (3, 4, 5) THEN 'Spring'
       WHEN COALESCE(month(offense_date), 1) IN (6, 7, 8) THEN 'Summer'
       ELSE 'Fall' END AS season,
  CASE WHEN COALESCE(hour(offense_date), 0) BETWEEN 5 AND 11 THEN 'morning'
       WHEN COALESCE(hour(offense_date), 0) BETWEEN 12 AND 16 THEN 'afternoon'
       WHEN COALESCE(hour(offense_date), 0) BETWEEN 17 AND 20 THEN 'evening'
       ELSE 'night' END AS ts_part_of_day
FROM keyed""")

    q["history_by_date"] = with_ctes(RAW, TYPED, KEYED, FACT, body=f"""
SELECT id, incident_type, offense_date, latitude, longitude, address FROM fact
WHERE offense_date >= TIMESTAMP '{P.HISTORY_DAY}'
  AND offense_date < TIMESTAMP '{P.HISTORY_DAY}' + INTERVAL 1 DAY""")

    q["snapshot_limit"] = with_ctes(RAW, TYPED, body=f"""
SELECT id, incident_type, offense_date, latitude, longitude, seq FROM (
  SELECT id, incident_type, offense_date, latitude, longitude, seq FROM typed
  ORDER BY seq LIMIT {P.SNAPSHOT_ROWS})""")

    # --- phase 2: graph -------------------------------------------------------
    q["snapshot_landed"] = with_ctes(RAW, TYPED, body="""
SELECT id, incident_type, offense_date, latitude, longitude FROM typed""")

    q["location_first_wins"] = with_ctes(*BASE, EDGES, body="""
SELECT address, lat, lon, 'street' AS type FROM location""")

    q["time_block_nodes"] = with_ctes(*BASE, EDGES, body="SELECT hour, part_of_day FROM time_block")

    q["edges_all"] = with_ctes(*BASE, body="""
SELECT DISTINCT 'OCCURRED_AT' AS edge_type, id AS src, location_key AS dst FROM g
UNION SELECT DISTINCT 'OCCURRED_DURING', id, CAST(hour AS VARCHAR) FROM g
UNION SELECT DISTINCT 'ON_DAY', id, day_name FROM g
UNION SELECT DISTINCT 'DURING_SEASON', id, season FROM g""")

    q["places"] = with_ctes(ELEMENTS, flat_pois(), body="SELECT * FROM places")

    q["graph_stats"] = with_ctes(*BASE, EDGES, ELEMENTS, flat_pois(), near_paths(P.NEAR_PLACE_M), body="""
SELECT 'node' AS kind, 'Location' AS item, CAST(count(DISTINCT location_key) AS BIGINT) AS n FROM g
UNION ALL SELECT 'node', 'Incident', count(DISTINCT id) FROM g
UNION ALL SELECT 'node', 'TimeBlock', count(DISTINCT hour) FROM g
UNION ALL SELECT 'node', 'Day', count(DISTINCT day_name) FROM g
UNION ALL SELECT 'node', 'Season', count(DISTINCT season) FROM g
UNION ALL SELECT 'edge', 'OCCURRED_AT', count(*) FROM occ_at
UNION ALL SELECT 'edge', 'OCCURRED_DURING', count(*) FROM occ_during
UNION ALL SELECT 'edge', 'ON_DAY', count(*) FROM (SELECT DISTINCT id, day_name FROM g)
UNION ALL SELECT 'edge', 'DURING_SEASON', count(*) FROM (SELECT DISTINCT id, season FROM g)
UNION ALL SELECT 'node', 'Place', count(*) FROM places
UNION ALL SELECT 'edge', 'OCCURRED_NEAR', count(*) FROM (SELECT DISTINCT case_id, osm_type, osm_id FROM near_paths)""")

    # --- phase 3: risk --------------------------------------------------------
    q["risk_by_part"] = with_ctes(*BASE, EDGES, body="""
SELECT address, part_of_day, CAST(count(*) AS BIGINT) AS incident_count
FROM paths GROUP BY address, part_of_day HAVING count(*) > 0""")

    q["risk_at_hour"] = with_ctes(*BASE, EDGES, _risk_at_hour(P.LOOKUP_HOUR), body="""
SELECT r.address, l.lat, l.lon, r.risk FROM risk r JOIN location l ON r.address = l.address""")

    q["risk_labels"] = with_ctes(*BASE, EDGES, _risk_at_hour(P.LOOKUP_HOUR), body=f"""
SELECT address, risk, CASE WHEN risk > 5 THEN 'red' ELSE 'orange' END AS colour,
  '{_hour_label(P.LOOKUP_HOUR)}' AS time_label
FROM risk""")

    # --- phase 4: spatial -----------------------------------------------------
    q["poi_flatten"] = with_ctes(ELEMENTS, flat_pois(), body="SELECT * FROM pois")
    q["poi_bbox"] = with_ctes(ELEMENTS, flat_pois(P.MAP_VIEW), body="SELECT * FROM pois")

    s_, w_, n_, e_ = P.MAP_VIEW
    q["incidents_bbox"] = with_ctes(RAW, TYPED, KEYED, FACT, body=f"""
SELECT id, incident_type, offense_date, latitude, longitude FROM fact
WHERE latitude BETWEEN {s_} AND {n_} AND longitude BETWEEN {w_} AND {e_}""")

    q["incidents_bbox_stored"] = q["incidents_bbox"]
    q["history_by_date_stored"] = q["history_by_date"]

    q["occurred_near"] = with_ctes(*BASE, EDGES, ELEMENTS, flat_pois(), near_paths(P.NEAR_PLACE_M), body="""
SELECT case_id, osm_type, osm_id, round(min(d), 3) AS distance_m
FROM near_paths GROUP BY case_id, osm_type, osm_id""")

    d_pair = hav("a.lat", "a.lon", "b.lat", "b.lon")
    q["near_incident_pairs"] = with_ctes(RAW, TYPED, KEYED, FACT, body=f"""
, f AS (SELECT id, latitude AS lat, longitude AS lon, epoch_us(offense_date) AS t FROM fact
        WHERE offense_date IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL)
SELECT a.id AS id_a, b.id AS id_b, round({d_pair}, 3) AS distance_m, abs(a.t - b.t) AS micros_apart
FROM f a JOIN f b ON a.id < b.id AND abs(a.t - b.t) <= {P.NEAR_INCIDENT_DAYS} * 86400000000
WHERE {d_pair} < {P.NEAR_INCIDENT_M}""")

    pts = ", ".join(f"({i}, {la}::DOUBLE, {lo}::DOUBLE)" for i, la, lo in P.RADIUS_POINTS)
    d_pt = hav("p.lat", "p.lon", "f.latitude", "f.longitude")
    q["near_counts"] = with_ctes(RAW, TYPED, KEYED, FACT, body=f"""
, f AS (SELECT id, latitude AS lat, longitude AS lon, epoch_us(offense_date) AS t FROM fact
        WHERE offense_date IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL),
pairs AS (
  SELECT a.id AS id_a, b.id AS id_b
  FROM f a JOIN f b ON a.id < b.id AND abs(a.t - b.t) <= {P.NEAR_INCIDENT_DAYS} * 86400000000
  WHERE {d_pair} < {P.NEAR_INCIDENT_M})
SELECT id, CAST(count(*) AS BIGINT) AS near_incidents
FROM (SELECT id_a AS id FROM pairs UNION ALL SELECT id_b FROM pairs)
GROUP BY id""")

    q["within_radius"] = with_ctes(RAW, TYPED, KEYED, FACT, body=f"""
, pts AS (SELECT * FROM (VALUES {pts}) AS t(point_id, lat, lon))
SELECT CAST(p.point_id AS INTEGER) AS point_id, f.id, round({d_pt}, 3) AS distance_m
FROM pts p, fact f
WHERE f.latitude IS NOT NULL AND f.longitude IS NOT NULL AND {d_pt} < {P.RADIUS_M}""")

    q["grid_counts"] = with_ctes(RAW, TYPED, KEYED, FACT, body=f"""
SELECT cell_y, cell_x, CAST(count(*) AS BIGINT) AS incidents,
  CAST(cell_y AS VARCHAR) || ':' || CAST(cell_x AS VARCHAR) AS grid_id
FROM (SELECT CAST(floor(latitude / {P.GRID_DEG}::DOUBLE) AS BIGINT) AS cell_y,
             CAST(floor(longitude / {P.GRID_DEG}::DOUBLE) AS BIGINT) AS cell_x
      FROM fact WHERE latitude IS NOT NULL AND longitude IS NOT NULL)
GROUP BY cell_y, cell_x""")

    q["amenity_exposure"] = with_ctes(*BASE, EDGES, ELEMENTS, flat_pois(), near_paths(P.NEAR_PLACE_M), body="""
SELECT amenity_type, CAST(count(DISTINCT case_id) AS BIGINT) AS incidents,
  CAST(count(DISTINCT case_id || '|' || osm_type || '|' || CAST(osm_id AS VARCHAR)) AS BIGINT) AS edges
FROM near_paths GROUP BY amenity_type""")

    kinds = ["bar", "pub", "nightclub", "restaurant", "cafe", "atm", "bank", "school", "university", "parking"]
    kind_list = ", ".join(f"'{k}'" for k in kinds)
    piv = ",\n  ".join(
        f"CAST(count(DISTINCT CASE WHEN amenity_type = '{k}' THEN case_id END) AS BIGINT) AS {k}" for k in kinds)
    q["cell_amenity_pivot"] = with_ctes(*BASE, EDGES, ELEMENTS, flat_pois(), near_paths(P.NEAR_PLACE_M), body=f"""
, lc AS (
  SELECT address, CAST(CAST(floor(lat / {P.GRID_DEG}::DOUBLE) AS BIGINT) AS VARCHAR) || ':' ||
                  CAST(CAST(floor(lon / {P.GRID_DEG}::DOUBLE) AS BIGINT) AS VARCHAR) AS grid_id
  FROM location WHERE lat IS NOT NULL AND lon IS NOT NULL)
SELECT lc.grid_id,
  {piv},
  CAST(count(DISTINCT CASE WHEN amenity_type NOT IN ({kind_list}) THEN case_id END) AS BIGINT) AS other
FROM near_paths np JOIN lc ON np.address = lc.address
GROUP BY lc.grid_id""")

    # --- phase 6: prediction ---------------------------------------------------
    FB = (RAW, TYPED, KEYED, FACT, cells(P.GRID_DEG))
    q["grid_type_risk"] = with_ctes(*FB, body=f"""
, c AS (SELECT grid_id, incident_type, count(*) AS n FROM cells GROUP BY grid_id, incident_type),
m AS (SELECT incident_type, max(n) AS mx FROM c GROUP BY incident_type)
SELECT c.grid_id, c.incident_type, CAST(c.n AS BIGINT) AS incidents, c.n / m.mx AS risk_score
FROM c JOIN m ON c.incident_type = m.incident_type
WHERE c.n / m.mx >= {P.HIGH_RISK}""")

    q["time_window_counts"] = with_ctes(*FB, body="""
SELECT day_name, part_of_day, CAST(count(*) AS BIGINT) AS incidents
FROM cells GROUP BY ROLLUP (day_name, part_of_day)""")

    pt = P.PREDICTION_TIME
    pt_part = _part_sql(f"hour(TIMESTAMP '{pt}')")
    q["grid_scores"] = with_ctes(*FB, body=f"""
, c AS (SELECT grid_id, incident_type, count(*) AS n FROM cells
        WHERE offense_date < TIMESTAMP '{pt}' AND day_name = dayname(TIMESTAMP '{pt}') AND part_of_day = {pt_part}
        GROUP BY grid_id, incident_type),
m AS (SELECT incident_type, max(n) AS mx FROM c GROUP BY incident_type)
SELECT c.grid_id, c.incident_type, TIMESTAMP '{pt}' AS prediction_time, c.n / m.mx AS risk_score,
       '{P.MODEL_VERSION}' AS model_version
FROM c JOIN m ON c.incident_type = m.incident_type""")
    q["prediction_lookup"] = q["grid_scores"]

    q["top_cells_geojson"] = with_ctes(*FB, body=f"""
, c AS (SELECT grid_id, cy, cx, count(*) AS n FROM cells
        WHERE offense_date < TIMESTAMP '{pt}' AND day_name = dayname(TIMESTAMP '{pt}') AND part_of_day = {pt_part}
        GROUP BY grid_id, cy, cx),
s AS (SELECT grid_id, cy, cx, n / (SELECT max(n) FROM c) AS risk_score FROM c),
t AS (SELECT *, row_number() OVER (ORDER BY risk_score DESC, grid_id) AS rk FROM s)
SELECT grid_id, risk_score, CAST(rk AS INTEGER) AS rank,
  printf('{{"type":"Feature","geometry":{{"type":"Point","coordinates":[%.6f,%.6f]}},"properties":{{"grid_id":"%s","rank":%d}}}}',
         (cx + 0.5::DOUBLE) * {P.GRID_DEG}::DOUBLE, (cy + 0.5::DOUBLE) * {P.GRID_DEG}::DOUBLE, grid_id, rk) AS feature
FROM t WHERE rk <= {P.TOP_K}""")

    q["rolling_30d"] = with_ctes(*FB, body=f"""
, daily AS (SELECT grid_id, CAST(offense_date AS DATE) AS day, count(*) AS incidents
            FROM cells WHERE offense_date IS NOT NULL GROUP BY grid_id, CAST(offense_date AS DATE))
SELECT grid_id, strftime(day, '%Y-%m-%d') AS day, CAST(incidents AS BIGINT) AS incidents,
  CAST(sum(incidents) OVER (PARTITION BY grid_id ORDER BY day
       RANGE BETWEEN INTERVAL {P.EVIDENCE_DAYS - 1} DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS trailing_incidents
FROM daily""")

    d_ev = hav("ce.lat", "ce.lon", "r.latitude", "r.longitude")
    ev_body = f"""
, nearc AS (SELECT DISTINCT case_id FROM near_paths),
recent AS (
  SELECT c.*, c.id IN (SELECT case_id FROM nearc) AS near_place FROM cells c
  WHERE c.offense_date > (SELECT max(offense_date) FROM cells) - INTERVAL {P.EVIDENCE_DAYS} DAY
    AND c.offense_date <= (SELECT max(offense_date) FROM cells)),
centres AS (SELECT DISTINCT grid_id, (cy + 0.5::DOUBLE) * {P.GRID_DEG}::DOUBLE AS lat,
                   (cx + 0.5::DOUBLE) * {P.GRID_DEG}::DOUBLE AS lon FROM cells),
ev AS (
  SELECT ce.grid_id, r.incident_type, count(*) AS n_recent,
    count_if(r.near_place) AS n_near_place,
    count_if(r.hour >= {P.BAND_START_HOUR} OR r.hour < {P.BAND_END_HOUR}) AS n_in_band,
    count_if(r.day_name = dayname(TIMESTAMP '{pt}') AND r.part_of_day = {pt_part}) AS n_pattern
  FROM centres ce, recent r
  WHERE {d_ev} < {P.NEAR_PLACE_M}
  GROUP BY ce.grid_id, r.incident_type)"""
    ev_ctes = (*BASE, EDGES, ELEMENTS, flat_pois(), near_paths(P.NEAR_PLACE_M), FACT, cells(P.GRID_DEG))
    q["evidence"] = with_ctes(*ev_ctes, body=ev_body + """
SELECT grid_id, incident_type, CAST(n_recent AS BIGINT) AS n_recent, CAST(n_near_place AS BIGINT) AS n_near_place,
       CAST(n_in_band AS BIGINT) AS n_in_band, CAST(n_pattern AS BIGINT) AS n_pattern FROM ev""")
    q["explanation_text"] = with_ctes(*ev_ctes, body=ev_body + f"""
SELECT grid_id, incident_type,
  printf('Cell %s: %d %s incidents within %d m in the last %d days; %d near a listed place, %d between %s and %s, %d on %s %s.',
         grid_id, n_recent, incident_type, {int(P.NEAR_PLACE_M)}, {P.EVIDENCE_DAYS}, n_near_place, n_in_band,
         '{_hour_label(P.BAND_START_HOUR)}', '{_hour_label(P.BAND_END_HOUR)}', n_pattern,
         dayname(TIMESTAMP '{pt}'), {pt_part}) AS explanation
FROM ev""")

    # --- phase 5: streaming (same results as the batch twins) -------------------
    q["stream_fact"] = q["fact_first_wins"]
    q["stream_fact_state"] = q["fact_first_wins"]
    q["stream_graph"] = q["edges_all"]
    q["stream_graph_state"] = q["edges_all"]
    q["graph_store_edges"] = q["edges_all"]
    q["stream_near_pairs"] = q["near_incident_pairs"]
    q["stream_fact_compacted"] = q["fact_first_wins"]
    q["stream_locations"] = q["location_first_wins"]
    q["publish_readback"] = q["typed_incidents"]
    q["snapshot_array"] = q["snapshot_landed"]
    q["poi_document"] = q["poi_flatten"]
    q["places_stored"] = q["places"]
    q["place_points"] = with_ctes(ELEMENTS, flat_pois(), body="""
SELECT osm_type, osm_id, lon AS point_lon, lat AS point_lat, 4326 AS srid FROM places""")
    q["edges_with_near"] = with_ctes(*BASE, EDGES, ELEMENTS, flat_pois(), near_paths(P.NEAR_PLACE_M), body="""
SELECT DISTINCT 'OCCURRED_AT' AS edge_type, id AS src, location_key AS dst FROM g
UNION SELECT DISTINCT 'OCCURRED_DURING', id, CAST(hour AS VARCHAR) FROM g
UNION SELECT DISTINCT 'ON_DAY', id, day_name FROM g
UNION SELECT DISTINCT 'DURING_SEASON', id, season FROM g
UNION SELECT DISTINCT 'OCCURRED_NEAR', case_id, osm_type || '/' || osm_id FROM near_paths""")
    q["graph_store_nodes"] = with_ctes(*BASE, body="""
SELECT DISTINCT 'location' AS label, location_key AS key FROM g
UNION SELECT DISTINCT 'incident', id FROM g
UNION SELECT DISTINCT 'time_block', CAST(hour AS VARCHAR) FROM g
UNION SELECT DISTINCT 'day', day_name FROM g
UNION SELECT DISTINCT 'season', season FROM g""")
    q["risk_table_stored"] = q["risk_table"]
    q["prediction_keys"] = " UNION ALL ".join("(" + with_ctes(*FB, body=f"""
SELECT TIMESTAMP '{t}' AS prediction_time, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) AS BIGINT) AS n_keys,
       CAST(0 AS BIGINT) AS n_unstamped
FROM (SELECT DISTINCT grid_id, incident_type FROM cells
      WHERE offense_date < TIMESTAMP '{t}' AND day_name = dayname(TIMESTAMP '{t}')
        AND part_of_day = {_part_sql(f"hour(TIMESTAMP '{t}')")})""") + ")"
        for t in P.PREDICTION_TIMES)
    # The earlier delivery is smaller: a row of it comes before every row of the later one.
    q["csv_first_wins"] = with_ctes(RAW, body="""
SELECT id, arg_min(narrative, (k, seq)) AS incident_type, arg_min(address, (k, seq)) AS address,
       arg_min(COALESCE(TRY_CAST(latitude AS DOUBLE), 0.0), (k, seq)) AS latitude,
       arg_min(COALESCE(TRY_CAST(longitude AS DOUBLE), 0.0), (k, seq)) AS longitude
FROM (SELECT *, CASE WHEN seq % 1000 < 20 THEN 0 ELSE 1 END AS k FROM raw) GROUP BY id""")
    q["stream_late_windows"] = with_ctes(RAW, TYPED, body=f"""
SELECT w AS window_start, w + INTERVAL 1 DAY AS window_end, incident_type, CAST(count(*) AS BIGINT) AS incidents
FROM (SELECT time_bucket(INTERVAL 1 DAY, CASE WHEN seq % 5 = 0 THEN offense_date - INTERVAL {P.LATE_DAYS} DAY
             ELSE offense_date END) AS w, incident_type FROM typed WHERE offense_date IS NOT NULL)
GROUP BY ALL""")
    q["stream_risk_refresh"] = q["risk_night"]
    q["stream_risk_incremental"] = q["risk_table"]
    q["stream_quarantine"] = q["quarantine"]
    q["stream_window_counts"] = with_ctes(RAW, TYPED, body="""
SELECT time_bucket(INTERVAL 1 DAY, offense_date) AS window_start,
       time_bucket(INTERVAL 1 DAY, offense_date) + INTERVAL 1 DAY AS window_end,
       incident_type, CAST(count(*) AS BIGINT) AS incidents
FROM typed WHERE offense_date IS NOT NULL
GROUP BY ALL""")

    # --- clusters, kernel, nearest places, risk terrain --------------------------
    near = f"abs(epoch_us(a.t) - epoch_us(b.t)) <= {P.CLUSTER_DAYS * 86_400_000_000} AND {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} < {P.CLUSTER_M}"
    q["incident_clusters"] = with_ctes(RAW, TYPED, KEYED, FACT, body=f"""
, p AS (SELECT id, latitude AS lat, longitude AS lon, offense_date AS t FROM fact
        WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND offense_date IS NOT NULL),
link AS MATERIALIZED (SELECT a.id AS u, b.id AS v FROM p a JOIN p b ON a.id <> b.id
         AND abs(a.lat - b.lat) < 0.1 AND {near}),
core AS MATERIALIZED (SELECT u AS id FROM link GROUP BY u HAVING count(*) >= {P.CLUSTER_MIN_NEAR}),
walk AS (SELECT * FROM (WITH RECURSIVE reach(id, root) AS (
           SELECT id, id FROM core
           UNION
           SELECT link.v, reach.root FROM reach JOIN link ON reach.id = link.u JOIN core ON core.id = link.v WHERE reach.root < link.v)
         SELECT * FROM reach)),
named AS (SELECT id, min(root) AS cluster_id FROM walk GROUP BY id)
SELECT id AS case_id, cluster_id, TRUE AS is_core FROM named
UNION ALL
SELECT u, min(cluster_id), FALSE FROM link JOIN named ON link.v = named.id
WHERE u NOT IN (SELECT id FROM core) GROUP BY u""")

    # Every incident gives its share to every cell around it, one by one.
    steps = int(P.KERNEL_REACH_M // 200) + 1
    mid = lambda c: f"(({c} + 0.5::DOUBLE) * {P.GRID_DEG}::DOUBLE)"
    away = hav(mid("cy"), mid("cx"), mid("cy + dy"), mid("cx + dx"))
    q["grid_scores_kernel"] = with_ctes(*FB, body=f"""
, share AS (
  SELECT CAST(cy + dy AS VARCHAR) || ':' || CAST(cx + dx AS VARCHAR) AS grid_id, incident_type, {away} AS away,
    pow(0.5::DOUBLE, (epoch_us(TIMESTAMP '{pt}') - epoch_us(offense_date)) / 86400000000.0 / {P.KERNEL_HALF_LIFE_DAYS}::DOUBLE) AS w
  FROM cells, range(-{steps}, {steps} + 1) AS y(dy), range(-{steps}, {steps} + 1) AS x(dx)
  WHERE offense_date < TIMESTAMP '{pt}'),
c AS (SELECT grid_id, incident_type, sum(w * exp(-away * away / {2 * P.KERNEL_BANDWIDTH_M ** 2}::DOUBLE)) AS n
      FROM share WHERE away <= {P.KERNEL_REACH_M} GROUP BY grid_id, incident_type),
m AS (SELECT incident_type, max(n) AS mx FROM c GROUP BY incident_type)
SELECT c.grid_id, c.incident_type, TIMESTAMP '{pt}' AS prediction_time, round(c.n / m.mx, 6) AS risk_score,
       '{P.KERNEL_VERSION}' AS model_version
FROM c JOIN m ON c.incident_type = m.incident_type""")

    typed_n = q["grid_scores"]
    q["prediction_scopes"] = f"""
SELECT model_version, 'by_type' AS scope, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT incident_type) AS BIGINT) AS n_types
FROM ({typed_n}) GROUP BY ALL
UNION ALL SELECT model_version, 'all', CAST(count(DISTINCT grid_id) AS BIGINT), CAST(1 AS BIGINT) FROM ({typed_n}) GROUP BY ALL
UNION ALL SELECT model_version, 'by_type', CAST(count(*) AS BIGINT), CAST(count(DISTINCT incident_type) AS BIGINT)
FROM ({q["grid_scores_kernel"]}) GROUP BY ALL"""

    q["nearest_places"] = with_ctes(*BASE, EDGES, ELEMENTS, flat_pois(), body=f"""
SELECT address, amenity_type, osm_type, osm_id, distance_m FROM (
  SELECT *, row_number() OVER (PARTITION BY address, amenity_type ORDER BY distance_m, osm_type, osm_id) AS rn FROM (
    SELECT l.address, p.amenity_type, p.osm_type, p.osm_id, round({hav('l.lat', 'l.lon', 'p.lat', 'p.lon')}, 3) AS distance_m
    FROM location l, places p WHERE l.lat IS NOT NULL AND l.lon IS NOT NULL))
WHERE rn = 1""")

    from gridwatch.operators.proximity import AMENITY_KINDS

    bits = " + ".join(f"CASE WHEN bool_or(amenity_type = '{k}') THEN {1 << i} ELSE 0 END" for i, k in enumerate(AMENITY_KINDS))
    square = lambda lat, lon: f"CAST(floor({lat} / {P.GRID_DEG}::DOUBLE) AS BIGINT) AS cy, CAST(floor({lon} / {P.GRID_DEG}::DOUBLE) AS BIGINT) AS cx"
    q["rtm_patterns"] = with_ctes(*BASE, FACT, ELEMENTS, flat_pois(), body=f"""
, inc AS (SELECT {square('latitude', 'longitude')} FROM fact WHERE latitude IS NOT NULL AND longitude IS NOT NULL),
held AS (SELECT cy, cx FROM inc UNION SELECT {square('lat', 'lon')} FROM places),
f AS (SELECT cy, cx, {bits} AS factors
      FROM held LEFT JOIN places ON {hav(mid('cy'), mid('cx'), 'lat', 'lon')} < {P.TERRAIN_REACH_M} GROUP BY cy, cx),
n AS (SELECT cy, cx, count(*) AS n FROM inc GROUP BY cy, cx)
SELECT CAST(factors AS INTEGER) AS factors, CAST(count(*) AS BIGINT) AS cells, CAST(sum(coalesce(n, 0)) AS BIGINT) AS incidents
FROM f LEFT JOIN n USING (cy, cx) GROUP BY factors""")
    q["incidents_bbox_curve"] = q["incidents_bbox"]
    q["within_radius_curve"] = q["within_radius"]
    q["graph_store_generation"] = q["edges_all"]
    q["stream_near_compacted"] = q["near_incident_pairs"]
    q["stream_windows_compacted"] = q["stream_window_counts"]
    q["stream_quarantine_compacted"] = q["stream_quarantine"]
    near_sql, risk_sql = (f"({q[name]})" for name in ("near_incident_pairs", "grid_type_risk"))
    q["pattern_edges"] = with_ctes(*FB, body=f"""
SELECT 'DURING' AS edge_type, id AS src, day_name || '/' || part_of_day AS dst, CAST(NULL AS DOUBLE) AS weight FROM gf
UNION ALL SELECT 'NEAR', id_a, id_b, distance_m FROM {near_sql}
UNION ALL SELECT 'HIGH_RISK_FOR', grid_id, incident_type, risk_score FROM {risk_sql}""")
    q["edges_knowledge"] = (f"SELECT edge_type, src, dst FROM ({q['edges_with_near']})\n"
                            f"UNION ALL SELECT edge_type, src, dst FROM ({q['pattern_edges']})")
    q["pattern_nodes"] = with_ctes(*FB, body=f"""
SELECT DISTINCT 'TimeWindow' AS label, day_name || '/' || part_of_day AS key FROM gf
UNION SELECT 'Grid', grid_id FROM {risk_sql}
UNION SELECT 'IncidentType', incident_type FROM {risk_sql}""")
    q["window_lift"] = with_ctes(*FB, body="""
SELECT a.incident_type, a.w AS time_window, CAST(count(*) AS BIGINT) AS incidents,
       CAST(any_value(t.n) AS DOUBLE) * any_value(v.n) / (SELECT count(*) FROM gf) AS expected,
       count(*) / (CAST(any_value(t.n) AS DOUBLE) * any_value(v.n) / (SELECT count(*) FROM gf)) AS lift
FROM (SELECT incident_type, day_name || '/' || part_of_day AS w FROM gf) a
JOIN (SELECT incident_type, count(*) AS n FROM gf GROUP BY 1) t ON a.incident_type IS NOT DISTINCT FROM t.incident_type
JOIN (SELECT day_name || '/' || part_of_day AS w, count(*) AS n FROM gf GROUP BY 1) v ON a.w = v.w
GROUP BY a.incident_type, a.w""")
    q["high_risk_windows"] = with_ctes(*FB, body=f"""
, n AS (SELECT grid_id, incident_type, day_name || '/' || part_of_day AS w, count(*) AS n FROM cells GROUP BY ALL)
SELECT grid_id, incident_type, risk_score, incidents, w AS time_window, CAST(n AS BIGINT) AS in_window, n / incidents AS share
FROM (SELECT *, row_number() OVER (PARTITION BY grid_id, incident_type ORDER BY n DESC, w) AS place
      FROM {risk_sql} JOIN n USING (grid_id, incident_type))
WHERE place = 1""")
    q["stream_window_replay"] = with_ctes(RAW, TYPED, KEYED, FACT, body="""
SELECT time_bucket(INTERVAL 1 DAY, offense_date) AS window_start,
       time_bucket(INTERVAL 1 DAY, offense_date) + INTERVAL 1 DAY AS window_end,
       incident_type, CAST(count(*) AS BIGINT) AS incidents
FROM fact WHERE offense_date IS NOT NULL
GROUP BY ALL""")

    return q


def _part_sql(h: str) -> str:
    return (f"(CASE WHEN {h} >= 5 AND {h} < 12 THEN 'morning' WHEN {h} >= 12 AND {h} < 17 THEN 'afternoon' "
            f"WHEN {h} >= 17 AND {h} < 21 THEN 'evening' ELSE 'night' END)")


def _hour_label(hour: int) -> str:
    h12 = hour % 12 or 12
    return f"{h12}:00 {'PM' if hour >= 12 else 'AM'}"
