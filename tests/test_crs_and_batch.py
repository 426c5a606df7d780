import base64
import json
import math

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from geolith.errors import UnsupportedFormatError
from geolith.functions.crs import canonical_crs, reproject, to_utm
from geolith.operators import batch, engine
from geolith.sources import discovery, geoparquet, vector


def test_one_writing_for_each_system(spark):
    cases = {
        "EPSG:4326": "EPSG:4326", "epsg::3857": "EPSG:3857", "OGC:CRS84": "OGC:CRS84", "urn:ogc:def:crs:OGC:1.3:CRS84": "OGC:CRS84", "https://www.opengis.net/def/crs/EPSG/0/25832": "EPSG:25832",
        'GEOGCS["WGS 84",DATUM["WGS_1984",SPHEROID["WGS 84",6378137,298.257223563,AUTHORITY["EPSG","7030"]]],AUTHORITY["EPSG","4326"]]': "EPSG:4326",
        'GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]]]': "EPSG:4326", 'PROJCRS["WGS 84 / UTM zone 5S",BASEGEOGCRS["WGS 84"]]': "EPSG:32705", 'PROJCS["Local grid",GEOGCS["x"]]': "NAME:LOCAL GRID",
        '{"name": "WGS 84"}': "EPSG:4326", '{"id": {"authority": "EPSG", "code": "2056"}}': "EPSG:2056", "": None, "  ": None, "no system": None, "{}": None, None: None,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", canonical_crs(F.col("t")).alias("c")).collect()
    assert {r.t: r.c for r in rows} == cases


def test_projections(spark):
    lon, lat = F.lit(9.0), F.lit(0.0)
    row = lambda *c: spark.range(1).select(*c).first()
    assert row(*to_utm(lon, lat, 32))[0] == pytest.approx(500000, abs=1e-6)
    e, n = row(*to_utm(F.lit(9.0), F.lit(45.0), 32))
    assert e == pytest.approx(500000, abs=1e-6) and n == pytest.approx(0.9996 * 4984944.378, abs=0.01)  # the meridian arc to 45 degrees
    x, y = row(*reproject(F.lit(180.0), F.lit(0.0), "EPSG:4326", "EPSG:3857"))
    assert x == pytest.approx(math.pi * 6378137) and y == pytest.approx(0, abs=1e-6)
    assert row(*reproject(lon, F.lit(89.0), "OGC:CRS84", "EPSG:3857"))[1] is None
    assert row(*reproject(F.lit(10.0), F.lit(-20.0), "EPSG:4326", "EPSG:32733"))[1] > 7_000_000
    for pair in (("EPSG:2056", "EPSG:4326"), ("EPSG:4326", "EPSG:2056")):
        with pytest.raises(ValueError):
            reproject(lon, lat, *pair)


def test_files_are_isolated_and_in_order(spark, tmp_path):
    good = spark.createDataFrame([("POINT (1 1)",), (None,)], "geometry_wkt string")
    good.write.parquet(str(tmp_path / "good.parquet"))
    spark.range(2).write.parquet(str(tmp_path / "bare.parquet"))
    heard = []
    paths = [str(tmp_path / n) for n in ("gone.parquet", "good.parquet", "bare.parquet", "other.txt")]
    items = batch.process_files(spark, paths, progress=heard.append).collect()
    assert [(r.seq, r.status) for r in items] == [(0, "failed"), (1, "succeeded"), (2, "failed"), (3, "failed")]
    assert '"feature_count":2' in items[1].value and items[2].error.startswith("ValueError: ") and items[3].error.startswith(UnsupportedFormatError.__name__)
    assert [p.completed for p in heard] == [1, 2, 3, 4] and heard[-1].remaining_seconds == 0 and {p.source for p in heard} == set(paths)
    assert batch.process_files(spark, []).isEmpty()


def test_chunks_and_their_limits(spark):
    sizes = batch.ChunkPipeline(lambda c: pa.RecordBatch.from_arrays([pa.array([c.num_rows], pa.int64())], ["n"]), "n bigint", chunk_rows=256)
    got = [r.n for r in sizes.run(spark.range(0, 1000, 1, 1)).collect()]
    assert sum(got) == 1000 and max(got) == 256
    with pytest.raises(ValueError):
        batch.ChunkPipeline(lambda c: c, "n bigint", chunk_rows=10)

    def full(chunk):
        raise MemoryError

    with pytest.raises(Exception, match="does not fit"):
        batch.ChunkPipeline(full, "n bigint").run(spark.range(3)).collect()


def test_bundles_ceilings_and_samples(spark):
    assert discovery.decode_bundle({"a.geojson": base64.b64encode(b"{}").decode()}) == {"a.geojson": b"{}"}
    with pytest.raises(ValueError):
        discovery.decode_bundle({"a.geojson": "%%"})
    discovery.check_ceilings(5, 60_000)
    for args in ((1 << 30, None), (5, 2_000_000), (5, 60_000, True)):
        with pytest.raises(ValueError):
            discovery.check_ceilings(*args)
    frame = spark.createDataFrame([(0, "POINT (1 1)"), (1, "LINESTRING (0 0, 1 1, 2 2)"), (2, None), (3, "rubbish")], "feature_index long, geometry string")
    assert tuple(engine.vertex_sample(frame).first()) == (4, 1.0, 3) and tuple(engine.vertex_sample(frame.limit(0)).first()) == (0, 0.0, 0)
    recorder = engine.Recorder()
    recorder.measure("x", lambda: 1)
    assert recorder.records[0]["peak_memory_bytes"] > 0 and recorder.records[0]["memory_usage_bytes"] >= 0


def test_a_failed_overwrite_keeps_the_old_data(spark, tmp_path, monkeypatch):
    from geolith.geometry import wkb, wkt

    path = tmp_path / "kept.parquet"
    frame = spark.createDataFrame([(bytearray(wkb.dump(wkt.parse("POINT (1 2)"))),)], "geometry binary")
    geoparquet.write(frame, path)
    options = {"path": str(path)}
    writer = geoparquet._Writer(options, frame.schema, True)
    real, calls = geoparquet.os.replace, []

    def replace(a, b):
        calls.append((a, b))
        if len(calls) == 2:
            raise OSError("no room")
        real(a, b)

    message = writer.write(iter(frame.toArrow().to_batches()))
    monkeypatch.setattr(geoparquet.os, "replace", replace)
    with pytest.raises(OSError):
        writer.commit([message])
    monkeypatch.undo()
    assert geoparquet.scan(spark, str(path)).count() == 1
    writer.abort([])
    geoparquet.write(frame.unionByName(frame), path, overwrite=True)
    assert sorted(r.feature_index for r in geoparquet.scan(spark, str(path)).collect()) == [0, 1] and not [p for p in tmp_path.iterdir() if p.name.startswith(".kept")]


def test_geojson_of_web_mercator(spark, tmp_path):
    from geolith.geometry import wkb, wkt

    frame = spark.createDataFrame([(0, bytearray(wkb.dump(wkt.parse(f"POINT ({math.pi * 6378137 / 2} 0)"))))], "feature_index long, geometry binary")
    vector.write_geojson(frame, str(tmp_path / "out"), crs="EPSG:3857")
    text = spark.read.text(str(tmp_path / "out")).first()[0]
    x, y = json.loads(text)["geometry"]["coordinates"]
    assert x == pytest.approx(90) and y == pytest.approx(0)
    with pytest.raises(ValueError):
        vector.write_geojson(frame, str(tmp_path / "other"), crs="EPSG:2056")


def test_profiles_and_own_selection_rules(spark, tmp_path):
    path = str(tmp_path / "some.parquet")
    spark.createDataFrame([("LINESTRING (0 0, 1 1, 2 2)",), ("POINT (1 1)",)], "geometry_wkt string").write.parquet(path)
    profile = engine.dataset_profile(spark, path)
    row = profile.first()
    assert (row.average_vertices, row.maximum_vertices, row.feature_count) == (2.0, 3, None) and row.size_bytes > 0
    plain, own = engine.engine_decision(profile).first(), engine.engine_decision(profile, rules={"lines": F.col("maximum_vertices") > 2}).first()
    assert (plain.engine, own.engine, list(own.reasons)) == ("in_memory", "streaming", ["lines"])


def test_maps_and_quality_reports(spark, tmp_path):
    from geolith.operators import reports

    rows = spark.createDataFrame([(1, 1, "error", "fix", "POINT (1 2)"), (1, 0, "odd", "look", None), (1, 2, "error", "fix", "rubbish")], "report_id long, pos long, severity string, recommendation string, geometry string")
    found = [json.loads(r.feature) for r in reports.map_features(rows, label="recommendation").collect()]
    assert [f["geometry"] and f["geometry"]["type"] for f in found] == ["Point", None, None]
    assert found[0]["properties"]["colour"] == reports.COLOURS["error"] and found[0]["properties"]["label"] == "fix" and found[1]["properties"]["colour"] == "#6b7280"
    path = reports.write_quality_report(tmp_path / "r.json", "Title", "parcels", 5, 3, rows.drop("geometry"))
    facts = json.loads(path.read_text())["summary"]
    assert (facts["quality_score"], facts["quality_badge"], facts["failed_checks"], facts["recommendations"]) == (80.0, "Good", 2, "look; fix")
    assert json.loads(reports.write_quality_report(tmp_path / "e.json", "T", "d", 0, 0, rows.drop("geometry").limit(0)).read_text())["summary"]["quality_score"] == 100
    with pytest.raises(ValueError):
        reports.write_quality_report(tmp_path / "x.json", " ", "d", 1, 2, rows)
