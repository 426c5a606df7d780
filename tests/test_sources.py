import json
import sqlite3
import struct

import pytest

from geolith.errors import CorruptDatasetError, UnsupportedFormatError
from geolith.geometry import wkb, wkt
from geolith.sources import discovery, geoparquet, vector
from geolith.streaming.audit import audit_counts, audit_stream, batch_counts

POINTS = ["POINT (0 0)", "POINT (1 1)", "POINT (2 2)"]


def as_wkb(text):
    return wkb.dump(wkt.parse(text))


def features(df):
    return [(r.feature_index, dict(r.attributes), None if r.geometry is None else wkt.dump(wkb.load(bytes(r.geometry)))) for r in df.orderBy("feature_index").collect()]


def test_geoparquet_round_trip_scan_and_refusals(spark, tmp_path):
    rows = spark.createDataFrame([(i, "west" if i in (1, 4) else "east", bytearray(as_wkb(f"POINT ({i} 0)"))) for i in range(1, 6)], "id long, region string, geometry binary").coalesce(1)
    target = tmp_path / "out.parquet"
    geoparquet.write(rows, target, crs='{"id": 4326}')
    part = next(target.glob("*.parquet"))
    assert geoparquet.inspect(part) == {"driver": "GeoParquet", "layer": None, "geometry_column": "geometry", "crs": '{"id": 4326}', "feature_count": 5, "encoding": "UTF-8"}
    out = geoparquet.scan(spark, str(target), ["id"], [("region", "==", "east"), ("id", ">", 2)])
    assert out.columns == ["id", "geometry", "feature_index"] and [(r.feature_index, r.id) for r in out.orderBy("feature_index").collect()] == [(0, 3), (1, 5)]
    with pytest.raises(Exception):
        geoparquet.write(rows, target)
    geoparquet.write(rows.limit(2), target, overwrite=True)
    assert spark.read.parquet(str(target)).count() == 2
    with pytest.raises(Exception):
        geoparquet.write(rows.limit(0), tmp_path / "none.parquet")
    assert not [p for p in tmp_path.iterdir() if p.name != "out.parquet"]
    for bad in ([], ["id", "id"], ["nope"]):
        with pytest.raises(ValueError):
            geoparquet.scan(spark, str(target), bad)
    with pytest.raises(ValueError):
        geoparquet.predicate("id", "in", "abc")


def test_geojson(spark, tmp_path):
    path = tmp_path / "a.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"name": f"n{i}", "k": i}, "geometry": {"type": "Point", "coordinates": [i, i]}} for i in range(3)] + [{"type": "Feature", "properties": None, "geometry": None}]}))
    assert features(vector.read(spark, str(path))) == [(i, {"name": f"n{i}", "k": str(i)}, p) for i, p in enumerate(POINTS)] + [(3, {}, None)]
    assert vector.inspect(str(path))["feature_count"] == 4
    vector.write_geojson(vector.read(spark, str(path)), str(tmp_path / "out"))
    lines = [json.loads(x) for p in (tmp_path / "out").glob("part-*") for x in p.read_text().splitlines()]
    assert sorted(x["id"] for x in lines) == [0, 1, 2, 3] and all(x["type"] == "Feature" for x in lines)


def test_geopackage_layers_and_splits(spark, tmp_path):
    path = tmp_path / "a.gpkg"
    with sqlite3.connect(path) as db:
        db.execute("create table gpkg_contents (table_name text, data_type text)")
        db.execute("create table gpkg_geometry_columns (table_name text, column_name text, srs_id int)")
        db.execute("create table gpkg_spatial_ref_sys (srs_id int, organization text, organization_coordsys_id int)")
        db.execute("insert into gpkg_spatial_ref_sys values (4326, 'EPSG', 4326)")
        for layer in ("one", "two"):
            db.execute("insert into gpkg_contents values (?, 'features')", (layer,))
            db.execute("insert into gpkg_geometry_columns values (?, 'geom', 4326)", (layer,))
            db.execute(f"create table {layer} (fid integer primary key, geom blob, name text)")
            db.executemany(f"insert into {layer} values (?, ?, ?)", [(10 * i + 1, b"GP\0\x01" + struct.pack("<i", 4326) + as_wkb(p), f"n{i}") for i, p in enumerate(POINTS)])
    with pytest.raises(ValueError):
        vector.resolve_layer(str(path))
    with pytest.raises(ValueError):
        vector.resolve_layer(str(path), "three")
    out = vector.read(spark, str(path), layer="two", rows_per_split=10)
    assert out.rdd.getNumPartitions() == 3 and features(out) == [(i, {"name": f"n{i}"}, p) for i, p in enumerate(POINTS)]
    assert vector.inspect(str(path), "one") == {"driver": "GPKG", "layer": "one", "crs": "EPSG:4326", "feature_count": 3, "geometry_column": "geom"}


def test_shapefile(spark, tmp_path):
    shell, hole = [(0, 0), (0, 4), (4, 4), (4, 0), (0, 0)], [(1, 1), (2, 1), (2, 2), (1, 2), (1, 1)]
    body = struct.pack("<i4d2i2i", 5, 0, 0, 4, 4, 2, 10, 0, 5) + b"".join(struct.pack("<2d", *map(float, p)) for p in shell + hole)
    records = [body, struct.pack("<i", 0)]
    shp, shx, at = b"", b"", 50
    for i, r in enumerate(records):
        shp += struct.pack(">2i", i + 1, len(r) // 2) + r
        shx += struct.pack(">2i", at, len(r) // 2)
        at += 4 + len(r) // 2
    head = lambda n: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, n) + struct.pack("<2i8d", 1000, 5, *[0.0] * 8)
    (tmp_path / "a.shp").write_bytes(head(at) + shp)
    (tmp_path / "a.shx").write_bytes(head(54 + 4 * len(records)) + shx)
    field = b"NAME".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([5, 0]) + b"\0" * 14
    rows = b"".join(b" " + n.encode("utf-8").ljust(5) for n in ("é", ""))
    (tmp_path / "a.dbf").write_bytes(struct.pack("<4BIHH20x", 3, 24, 1, 1, 2, 65, 6) + field + b"\r" + rows)
    assert features(vector.read(spark, str(tmp_path / "a.shp"))) == [(0, {"NAME": "é"}, "POLYGON ((0 0, 0 4, 4 4, 4 0, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))"), (1, {"NAME": None}, None)]
    assert vector.inspect(str(tmp_path / "a.shp"))["feature_count"] == 2


def test_discovery_and_bundles(tmp_path):
    for name in ("roads.GPKG", "parcels.shp", "notes.txt"):
        (tmp_path / name).write_text("")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "x.fgb").write_text("")
    assert [p.name for p in discovery.discover([tmp_path, tmp_path / "parcels.shp"])] == ["parcels.shp", "roads.GPKG"]
    assert len(discovery.discover([tmp_path], recursive=True)) == 3
    with pytest.raises(UnsupportedFormatError):
        discovery.discover([tmp_path / "notes.txt"])
    with pytest.raises(FileNotFoundError):
        discovery.discover([tmp_path / "gone.shp"])
    discovery.check_bundle(["a.shp", "a.shx", "a.dbf"])
    for bad in ([], ["a.shp"], ["a.shp", "a.shx", "b.dbf"], ["../a.gpkg"]):
        with pytest.raises(ValueError):
            discovery.check_bundle(bad)
    (tmp_path / "bad.fgb").write_bytes(b"nope")
    with pytest.raises(CorruptDatasetError):
        vector.inspect(str(tmp_path / "bad.fgb"))


def test_streamed_audit_equals_batch(spark, tmp_path):
    data, state = str(tmp_path / "in"), str(tmp_path / "state")
    frames = [spark.createDataFrame([(i, g) for i, g in enumerate(t)], "feature_index long, geometry string") for t in (["POINT (0 0)", None], ["POLYGON ((0 0, 2 2, 0 2, 2 0, 0 0))", "LINESTRING (0 0, 1 1, 1 1)"])]
    for f in frames:
        f.coalesce(1).write.mode("append").parquet(data)
        audit_stream(spark, data, "feature_index long, geometry string", state)
    audit_stream(spark, data, "feature_index long, geometry string", state)  # nothing new
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(audit_counts(spark, state)) == key(batch_counts(spark.read.parquet(data)))
