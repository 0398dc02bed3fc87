"""POI dump flattening (the reference's ingest tests, as DataFrame vectors)."""

import json
import os

from pyspark.sql.types import LongType, StructField, StructType

from gridwatch.operators import poi
from gridwatch.schema import POI_ELEMENT


def elements(spark, rows):
    """Elements in dump order."""
    schema = StructType(POI_ELEMENT.fields + [StructField("seq", LongType())])
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema)


def test_node_and_way(spark):
    el = elements(spark, [
        ("node", 1, 29.65, -82.32, None, {"amenity": "bar", "name": "Bar One"}),
        ("way", 2, None, None, (29.66, -82.33), {"amenity": "school", "name": "School Two"}),
    ])
    out = sorted(poi.flatten_elements(el).collect(), key=lambda r: r.id)
    assert [(r.id, r.type, r.amenity, r.name, r.lat, r.lon) for r in out] == [
        (1, "node", "bar", "Bar One", 29.65, -82.32), (2, "way", "school", "School Two", 29.66, -82.33)]


def test_way_without_name_uses_centre(spark):
    el = elements(spark, [("way", 3, None, None, (29.67, -82.34), {"amenity": "parking"})])
    r = poi.flatten_elements(el).first()
    assert (r.name, r.lat, r.lon) == ("Unknown", 29.67, -82.34)


def test_missing_coordinates_dropped(spark):
    el = elements(spark, [("node", 71, None, None, None, {"amenity": "bar"}),
                          ("node", 72, 29.6, -82.3, None, {"amenity": "bar"})])
    assert [r.id for r in poi.flatten_elements(el).collect()] == [72]


def test_zero_point_dropped_at_ingest_only(spark):
    el = elements(spark, [("node", 7, 0.0, -82.3, None, {"amenity": "bar"})])
    assert poi.flatten_elements(el).count() == 0
    # Place loading itself only drops NULL coordinates.
    flat = spark.createDataFrame([(7, "node", "bar", "X", 0.0, -82.3, 1)],
                                 "id long, type string, amenity string, name string, lat double, lon double, seq long")
    assert poi.place_nodes(flat).count() == 1


def test_empty_elements(spark, scratch):
    os.makedirs(scratch, exist_ok=True)
    with open(scratch + "/empty.json", "w") as fh:
        fh.write(json.dumps({"elements": []}))
    assert poi.flatten_elements(poi.read_overpass_document(spark, scratch + "/empty.json")).count() == 0


def test_document_count(spark, scratch):
    os.makedirs(scratch, exist_ok=True)
    doc = {"elements": [
        {"type": "node", "id": 10, "lat": 29.61, "lon": -82.31, "tags": {"amenity": "atm"}},
        {"type": "node", "id": 11, "lat": 29.62, "lon": -82.32, "tags": {"amenity": "cafe", "name": "C"}},
    ]}
    with open(scratch + "/doc.json", "w") as fh:
        fh.write(json.dumps(doc, indent=2))
    assert poi.flatten_elements(poi.read_overpass_document(spark, scratch + "/doc.json", 4)).count() == 2


def test_amenity_pattern_is_unanchored(spark):
    el = elements(spark, [("node", i, 29.6, -82.3, None, {"amenity": a} if a else {})
                          for i, a in enumerate(["bar", "bicycle_parking", "fast_food", None])])
    assert sorted(r.amenity for r in poi.flatten_elements(el).collect()) == ["bar", "bicycle_parking"]


def test_types_and_duplicates(spark):
    el = elements(spark, [("node", 1, 29.6, -82.3, None, {"amenity": "bar"}),
                          ("node", 1, 29.6, -82.3, None, {"amenity": "bar"}),
                          ("way", 1, None, None, (29.7, -82.4), {"amenity": "bar"}),
                          ("relation", 2, 29.6, -82.3, None, {"amenity": "bar"})])
    out = sorted((r.type, r.id) for r in poi.flatten_elements(el).collect())
    assert out == [("node", 1), ("way", 1)]
    places = poi.place_nodes(poi.flatten_elements(el))
    assert places.select("osm_type", "osm_id").distinct().count() == 2


def test_bbox_filters_on_point(spark):
    el = elements(spark, [("node", 1, 29.60, -82.30, None, {"amenity": "bar"}),
                          ("node", 2, 29.80, -82.30, None, {"amenity": "bar"})])
    assert [r.id for r in poi.flatten_elements(el, bbox=poi.DEFAULT_BBOX).collect()] == [1]


def test_last_element_wins(spark, scratch):
    from gridwatch.sources import tables

    el = elements(spark, [("node", 1, 29.6, -82.3, None, {"amenity": "bar", "name": "Old Name"}),
                          ("node", 1, 29.7, -82.3, None, {"amenity": "restaurant", "name": "New Name"})])
    r = poi.flatten_elements(el).first()
    assert (r.name, r.amenity, r.lat) == ("New Name", "restaurant", 29.7)
    for load, part in (("1", el.filter("seq = 1")), ("2", el.filter("seq = 0")), ("2", el.filter("seq = 0"))):
        tables.upsert_places(poi.place_nodes(poi.flatten_elements(part)), scratch, load)
    stored = tables.read_places(spark, scratch).collect()
    assert [(p.name, p.point.lon, p.point.lat, p.point.srid) for p in stored] == [("Old Name", -82.3, 29.6, 4326)]


def test_document_order_over_files(spark, scratch):
    os.makedirs(scratch, exist_ok=True)
    for name, n in (("a.json", 1), ("b.json", 40)):
        doc = {"elements": [{"type": "node", "id": 1, "lat": 29.6, "lon": -82.3, "tags": {"amenity": "bar", "name": f"{name}{i}"}}
                            for i in range(n)]}
        with open(f"{scratch}/{name}", "w") as fh:
            json.dump(doc, fh)
    assert poi.flatten_elements(poi.read_overpass_document(spark, scratch)).first().name == "b.json39"
