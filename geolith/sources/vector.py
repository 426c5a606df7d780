"""Vector files as Spark data sources: GeoJSON, GeoPackage, Shapefile and FlatGeobuf, and metadata without features.

Each source splits a file into ranges that are read in parallel where the format has random access (GeoPackage by
row id, Shapefile by its record index); features carry their place in the file as feature_index, their attributes
as a map of texts and the geometry as WKB.
"""

from __future__ import annotations

import json
import math
import sqlite3
import struct
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from geolith.errors import CorruptDatasetError, EncodingError, MetadataReadError, UnsupportedFormatError
from geolith.geometry import wkb
from geolith.geometry.wkt import Geom, collect

SCHEMA = "feature_index bigint, attributes map<string,string>, geometry binary"
ROWS_PER_SPLIT = 65_536
FORMATS = {".geojson": "geolith_geojson", ".json": "geolith_geojson", ".gpkg": "geolith_gpkg", ".shp": "geolith_shapefile", ".fgb": "geolith_flatgeobuf", ".parquet": "parquet", ".geoparquet": "parquet"}


def text_of(value) -> str | None:
    if value is None:
        return None
    if isinstance(value, str):
        return value
    if isinstance(value, bytes):
        return value.hex()
    return json.dumps(value, ensure_ascii=False)


# ---- GeoJSON


def from_mapping(value: dict | None) -> Geom | None:
    """A GeoJSON geometry object."""
    if value is None:
        return None
    kind = value.get("type")
    if kind == "GeometryCollection":
        return collect(from_mapping(m) for m in value.get("geometries", []))
    c = value.get("coordinates", [])
    t = lambda path: [tuple(map(float, p)) for p in path]
    if kind == "Point":
        return Geom("POINT", points=t([c]) if c else [])
    if kind == "MultiPoint":
        return Geom("MULTIPOINT", points=t(c))
    if kind == "LineString":
        return Geom("LINESTRING", lines=[t(c)] if c else [])
    if kind == "MultiLineString":
        return Geom("MULTILINESTRING", lines=[t(x) for x in c])
    if kind == "Polygon":
        return Geom("POLYGON", polygons=[[t(r) for r in c]] if c else [])
    if kind == "MultiPolygon":
        return Geom("MULTIPOLYGON", polygons=[[t(r) for r in p] for p in c])
    raise CorruptDatasetError(f"unknown geometry type {kind!r}")


def to_mapping(g: Geom) -> dict:
    """The GeoJSON object of a geometry."""
    p = lambda path: [[float(v) for v in c] for c in path]
    if g.kind == "GEOMETRYCOLLECTION":
        return {"type": "GeometryCollection", "geometries": [to_mapping(m) for m in g.members]}
    if g.kind == "POINT":
        return {"type": "Point", "coordinates": p(g.points)[0] if g.points else []}
    if g.kind == "MULTIPOINT":
        return {"type": "MultiPoint", "coordinates": p(g.points)}
    if g.kind in ("LINESTRING", "LINEARRING"):
        return {"type": "LineString", "coordinates": p(g.lines[0]) if g.lines else []}
    if g.kind == "MULTILINESTRING":
        return {"type": "MultiLineString", "coordinates": [p(x) for x in g.lines]}
    if g.kind == "POLYGON":
        return {"type": "Polygon", "coordinates": [p(r) for r in g.polygons[0]] if g.polygons else []}
    return {"type": "MultiPolygon", "coordinates": [[p(r) for r in q] for q in g.polygons]}


def geojson_features(path: str, encoding: str = "utf-8"):
    try:
        value = json.loads(Path(path).read_text(encoding=encoding))
    except UnicodeError as error:
        raise EncodingError(path) from error
    except (OSError, ValueError) as error:
        raise CorruptDatasetError(path) from error
    features = value.get("features") if value.get("type") == "FeatureCollection" else [value] if value.get("type") == "Feature" else [{"geometry": value, "properties": {}}]
    for i, f in enumerate(features):
        g = from_mapping(f.get("geometry"))
        yield i, {k: text_of(v) for k, v in (f.get("properties") or {}).items()}, None if g is None else wkb.dump(g)


# ---- GeoPackage


def gpkg_blob(blob: bytes | None) -> bytes | None:
    """The WKB in a GeoPackage geometry blob."""
    if blob is None:
        return None
    if blob[:2] != b"GP":
        raise CorruptDatasetError("no GeoPackage geometry")
    return bytes(blob[8 + {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[(blob[3] >> 1) & 7] :])


def _connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{Path(path).resolve()}?mode=ro", uri=True)


def gpkg_layers(path: str) -> list[str]:
    """Names of the feature layers."""
    try:
        with _connect(path) as db:
            return [r[0] for r in db.execute("select table_name from gpkg_contents where data_type = 'features' order by table_name")]
    except sqlite3.Error as error:
        raise CorruptDatasetError(path) from error


def resolve_layer(path: str, layer: str | None = None) -> str | None:
    """The layer to read: only GeoPackages have layers; one of several must be chosen, and must exist."""
    if Path(path).suffix.lower() != ".gpkg":
        if layer is not None:
            raise ValueError("only GeoPackages have layers")
        return None
    layers = gpkg_layers(path)
    if layer is not None:
        if layer not in layers:
            raise ValueError(f"no layer {layer!r}")
        return layer
    if len(layers) != 1:
        raise ValueError(f"choose one of the layers {layers}")
    return layers[0]


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def gpkg_features(path: str, layer: str, lo: int, hi: int):
    """Features whose row ids are in lo..hi, numbered by row id order over the whole layer."""
    with _connect(path) as db:
        column = db.execute("select column_name from gpkg_geometry_columns where table_name = ?", (layer,)).fetchone()[0]
        before = db.execute(f"select count(*) from {_quoted(layer)} where rowid < ?", (lo,)).fetchone()[0]
        rows = db.execute(f"select * from {_quoted(layer)} where rowid between ? and ? order by rowid", (lo, hi))
        names = [d[0] for d in rows.description]
        key = {r[1] for r in db.execute(f"pragma table_info({_quoted(layer)})") if r[5]}
        for i, row in enumerate(rows):
            values = dict(zip(names, row))
            yield before + i, {k: text_of(v) for k, v in values.items() if k != column and k not in key}, gpkg_blob(values[column])


# ---- Shapefile


def _shape(data: bytes) -> Geom | None:
    (kind,) = struct.unpack_from("<i", data, 0)
    base = kind % 10
    if kind == 0:
        return None
    if base == 1:
        return Geom("POINT", points=[struct.unpack_from("<2d", data, 4)])
    if base == 8:
        (n,) = struct.unpack_from("<i", data, 36)
        c = struct.unpack_from(f"<{2 * n}d", data, 40)
        return Geom("MULTIPOINT", points=list(zip(c[::2], c[1::2])))
    if base not in (3, 5):
        raise CorruptDatasetError(f"unknown shape type {kind}")
    parts, n = struct.unpack_from("<2i", data, 36)
    starts = [*struct.unpack_from(f"<{parts}i", data, 44), n]
    c = struct.unpack_from(f"<{2 * n}d", data, 44 + 4 * parts)
    points = list(zip(c[::2], c[1::2]))
    paths = [points[a:b] for a, b in zip(starts, starts[1:])]
    if base == 3:
        return Geom("LINESTRING" if len(paths) == 1 else "MULTILINESTRING", lines=paths)
    area = lambda r: sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(r, r[1:]))
    polygons: list[list] = []
    for ring in paths:  # shells are clockwise; a hole follows its shell
        if area(ring) <= 0 or not polygons:
            polygons.append([ring])
        else:
            polygons[-1].append(ring)
    return Geom("POLYGON" if len(polygons) == 1 else "MULTIPOLYGON", polygons=polygons)


def _beside(path: str, suffix: str) -> Path | None:
    p = Path(path)
    return next((q for q in p.parent.iterdir() if q.stem == p.stem and q.suffix.lower() == suffix), None)


def dbf_rows(path: Path, encoding: str, lo: int, hi: int):
    with path.open("rb") as f:
        head = f.read(32)
        size, record = struct.unpack_from("<HH", head, 8)
        fields, at = [], 1
        for _ in range((size - 33) // 32):
            d = f.read(32)
            if d[:1] == b"\r":
                break
            fields.append((d[:11].split(b"\0")[0].decode(encoding), chr(d[11]), at, d[16]))
            at += d[16]
        f.seek(size + lo * record)
        for _ in range(lo, hi):
            row = f.read(record)
            try:
                values = {name: (kind, row[a : a + n].decode(encoding).strip()) for name, kind, a, n in fields}
            except UnicodeError as error:
                raise EncodingError(str(path)) from error
            yield {k: None if v == "" or (t == "L" and v == "?") else ("true" if v in "YyTt" else "false") if t == "L" else v for k, (t, v) in values.items()}


def shapefile_count(path: str) -> int:
    shx = _beside(path, ".shx")
    if shx is None:
        raise CorruptDatasetError(f"{path}: no index file")
    return (shx.stat().st_size - 100) // 8


def shapefile_features(path: str, lo: int, hi: int, encoding: str):
    with _beside(path, ".shx").open("rb") as f:
        f.seek(100 + 8 * lo)
        places = struct.unpack(f">{2 * (hi - lo)}i", f.read(8 * (hi - lo)))
    dbf = _beside(path, ".dbf")
    rows = dbf_rows(dbf, encoding, lo, hi) if dbf else ({} for _ in range(lo, hi))
    with open(path, "rb") as f:
        for i, (at, words), attributes in zip(range(lo, hi), zip(places[::2], places[1::2]), rows):
            f.seek(2 * at + 8)
            g = _shape(f.read(2 * words))
            yield i, attributes, None if g is None else wkb.dump(g)


# ---- FlatGeobuf


class _Table:
    """A flatbuffers table."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at
        self.vtable = at - struct.unpack_from("<i", data, at)[0]
        self.size = struct.unpack_from("<H", data, self.vtable)[0]

    def place(self, k: int) -> int | None:
        o = 4 + 2 * k
        v = struct.unpack_from("<H", self.data, self.vtable + o)[0] if o < self.size else 0
        return self.at + v if v else None

    def scalar(self, k: int, form: str, default=0):
        p = self.place(k)
        return default if p is None else struct.unpack_from("<" + form, self.data, p)[0]

    def _target(self, k: int) -> int | None:
        p = self.place(k)
        return None if p is None else p + struct.unpack_from("<I", self.data, p)[0]

    def text(self, k: int) -> str | None:
        t = self._target(k)
        return None if t is None else self.data[t + 4 : t + 4 + struct.unpack_from("<I", self.data, t)[0]].decode("utf-8")

    def table(self, k: int) -> _Table | None:
        t = self._target(k)
        return None if t is None else _Table(self.data, t)

    def vector(self, k: int, form: str) -> tuple:
        t = self._target(k)
        return () if t is None else struct.unpack_from(f"<{struct.unpack_from('<I', self.data, t)[0]}{form}", self.data, t + 4)

    def raw(self, k: int) -> bytes:
        t = self._target(k)
        return b"" if t is None else self.data[t + 4 : t + 4 + struct.unpack_from("<I", self.data, t)[0]]

    def tables(self, k: int) -> list[_Table]:
        t = self._target(k)
        if t is None:
            return []
        n = struct.unpack_from("<I", self.data, t)[0]
        return [_Table(self.data, p + struct.unpack_from("<I", self.data, p)[0]) for p in range(t + 4, t + 4 + 4 * n, 4)]


_FGB_KINDS = {1: "POINT", 2: "LINESTRING", 3: "POLYGON", 4: "MULTIPOINT", 5: "MULTILINESTRING", 6: "MULTIPOLYGON", 7: "GEOMETRYCOLLECTION"}
_FGB_FORMS = {0: "b", 1: "B", 2: "?", 3: "h", 4: "H", 5: "i", 6: "I", 7: "q", 8: "Q", 9: "f", 10: "d"}


def _fgb_geometry(t: _Table, kind: int) -> Geom:
    kind = kind or t.scalar(6, "B")
    name = _FGB_KINDS[kind]
    if kind in (6, 7):
        return collect_as(name, [_fgb_geometry(p, 3 if kind == 6 else 0) for p in t.tables(7)])
    xy, ends = t.vector(1, "d"), t.vector(0, "I")
    points = list(zip(xy[::2], xy[1::2]))
    paths = [points[a:b] for a, b in zip((0, *ends), ends)] if ends else [points] if points else []
    if kind in (1, 4):
        return Geom(name, points=points)
    return Geom(name, lines=paths) if kind in (2, 5) else Geom(name, polygons=[paths] if paths else [])


def collect_as(name: str, members: list[Geom]) -> Geom:
    whole = collect(members)
    return whole if name == "GEOMETRYCOLLECTION" else Geom(name, whole.points, whole.lines, whole.polygons)


def flatgeobuf(path: str):
    """(header, features) of a FlatGeobuf file; the header is name, crs code, count and geometry type."""
    try:
        data = Path(path).read_bytes()
        if data[:3] != b"fgb":
            raise CorruptDatasetError(path)
        (n,) = struct.unpack_from("<I", data, 8)
        head = _Table(data[12 : 12 + n], struct.unpack_from("<I", data, 12)[0])
        count, node = head.scalar(8, "Q"), head.scalar(9, "H", 16)
        columns = [(c.text(0), c.scalar(1, "B")) for c in head.tables(7)]
        crs = head.table(10)
        code = crs.scalar(1, "i") if crs else 0
        at, level, nodes = 12 + n, count, 0
        if node and count:
            nodes = level
            while level > 1:
                level = -(-level // node)
                nodes += level
            at += 40 * nodes
        header = {"name": head.text(0), "crs": f"EPSG:{code}" if code else None, "feature_count": count or None, "type": head.scalar(2, "B")}
    except (struct.error, IndexError, OSError) as error:
        raise CorruptDatasetError(path) from error

    def features():
        i, place = 0, at
        while place + 4 <= len(data):
            (size,) = struct.unpack_from("<I", data, place)
            body = data[place + 4 : place + 4 + size]
            f = _Table(body, struct.unpack_from("<I", body, 0)[0])
            g, props, values, k = f.table(0), f.raw(1), {name: None for name, _ in columns}, 0
            own = [(c.text(0), c.scalar(1, "B")) for c in f.tables(2)] or columns
            while k + 2 <= len(props):
                (c,) = struct.unpack_from("<H", props, k)
                name, kind = own[c]
                k += 2
                if kind in _FGB_FORMS:
                    (v,) = struct.unpack_from("<" + _FGB_FORMS[kind], props, k)
                    k += struct.calcsize("<" + _FGB_FORMS[kind])
                else:
                    (m,) = struct.unpack_from("<I", props, k)
                    raw = props[k + 4 : k + 4 + m]
                    v, k = (raw if kind == 14 else raw.decode("utf-8")), k + 4 + m
                values[name] = text_of(v)
            yield i, values, None if g is None else wkb.dump(_fgb_geometry(g, header["type"]))
            i, place = i + 1, place + 4 + size

    return header, features


# ---- data sources


class _Range(InputPartition):
    def __init__(self, lo: int, hi: int):
        super().__init__((lo, hi))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.options = options["path"], options

    def partitions(self):
        return [_Range(0, 0)]


class _GeoJson(_Reader):
    def read(self, partition):
        yield from geojson_features(self.path, self.options.get("encoding", "utf-8"))


class _FlatGeobuf(_Reader):
    def read(self, partition):
        yield from flatgeobuf(self.path)[1]()


class _Gpkg(_Reader):
    def __init__(self, options):
        super().__init__(options)
        self.layer = resolve_layer(self.path, options.get("layer"))

    def partitions(self):
        with _connect(self.path) as db:
            lo, hi = db.execute(f"select min(rowid), max(rowid) from {_quoted(self.layer)}").fetchone()
        step = int(self.options.get("rows_per_split", ROWS_PER_SPLIT))
        return [_Range(a, min(a + step - 1, hi)) for a in range(lo, hi + 1, step)] if lo is not None else [_Range(0, -1)]

    def read(self, partition):
        yield from gpkg_features(self.path, self.layer, *partition.value)


class _Shapefile(_Reader):
    def partitions(self):
        n, step = shapefile_count(self.path), int(self.options.get("rows_per_split", ROWS_PER_SPLIT))
        return [_Range(a, min(a + step, n)) for a in range(0, n, step)] or [_Range(0, 0)]

    def read(self, partition):
        cpg = _beside(self.path, ".cpg")
        encoding = self.options.get("encoding") or (cpg.read_text().strip() if cpg else "utf-8")
        yield from shapefile_features(self.path, *partition.value, encoding)


class _Source(DataSource):
    reader_class: type[_Reader]

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return self.reader_class(dict(self.options))


class GeoJsonSource(_Source):
    reader_class = _GeoJson

    @classmethod
    def name(cls):
        return "geolith_geojson"


class GpkgSource(_Source):
    reader_class = _Gpkg

    @classmethod
    def name(cls):
        return "geolith_gpkg"


class ShapefileSource(_Source):
    reader_class = _Shapefile

    @classmethod
    def name(cls):
        return "geolith_shapefile"


class FlatGeobufSource(_Source):
    reader_class = _FlatGeobuf

    @classmethod
    def name(cls):
        return "geolith_flatgeobuf"


def register(spark: SparkSession) -> None:
    for source in (GeoJsonSource, GpkgSource, ShapefileSource, FlatGeobufSource):
        spark.dataSource.register(source)


def format_of(path: str | Path) -> str:
    """The Spark format that reads a path, by its suffix in any case."""
    found = FORMATS.get(Path(path).suffix.lower())
    if found is None:
        raise UnsupportedFormatError(str(path))
    return found


def read(spark: SparkSession, path: str, layer: str | None = None, encoding: str | None = None, **options) -> DataFrame:
    """The features of a file by its suffix: feature_index, attributes, geometry; a GeoParquet file keeps its own columns."""
    kind = format_of(path)
    if kind == "parquet":
        from geolith.sources.geoparquet import scan

        return scan(spark, path)
    register(spark)
    reader = spark.read.format(kind).option("path", path)
    for k, v in {"layer": layer, "encoding": encoding, **options}.items():
        if v is not None:
            reader = reader.option(k, v)
    return reader.load()


def inspect(path: str, layer: str | None = None) -> dict:
    """driver, layer, crs, feature_count and geometry_column without reading features."""
    suffix = Path(path).suffix.lower()
    kind = format_of(path)
    if kind == "parquet":
        from geolith.sources.geoparquet import inspect as footer

        return footer(path)
    try:
        if suffix == ".gpkg":
            layer = resolve_layer(path, layer)
            with _connect(path) as db:
                column, srs = db.execute("select column_name, srs_id from gpkg_geometry_columns where table_name = ?", (layer,)).fetchone()
                row = db.execute("select organization, organization_coordsys_id from gpkg_spatial_ref_sys where srs_id = ?", (srs,)).fetchone()
                n = db.execute(f"select count(*) from {_quoted(layer)}").fetchone()[0]
            return {"driver": "GPKG", "layer": layer, "crs": f"{row[0]}:{row[1]}".upper() if row and srs > 0 else None, "feature_count": n, "geometry_column": column}
        if suffix == ".shp":
            prj = _beside(path, ".prj")
            return {"driver": "ESRI Shapefile", "layer": Path(path).stem, "crs": prj.read_text().strip() or None if prj else None, "feature_count": shapefile_count(path), "geometry_column": "geometry"}
        if suffix == ".fgb":
            head, _ = flatgeobuf(path)
            return {"driver": "FlatGeobuf", "layer": head["name"], "crs": head["crs"], "feature_count": head["feature_count"], "geometry_column": "geometry"}
        value = json.loads(Path(path).read_text(encoding="utf-8"))
        crs = ((value.get("crs") or {}).get("properties") or {}).get("name")
        n = len(value["features"]) if value.get("type") == "FeatureCollection" else 1
        return {"driver": "GeoJSON", "layer": Path(path).stem, "crs": crs or "EPSG:4326", "feature_count": n, "geometry_column": "geometry"}
    except (OSError, ValueError, KeyError, TypeError, sqlite3.Error) as error:
        if isinstance(error, ValueError) and "layer" in str(error):
            raise
        raise MetadataReadError(path, str(error)) from error


def write_geojson(features: DataFrame, path: str, geometry: str = "geometry", index: str = "feature_index", crs: str | None = None) -> None:
    """Write features as line-delimited GeoJSON features, attributes kept, ids by index; one file for each partition.

    crs: AUTHORITY:CODE of the coordinates; EPSG:3857 is written as longitude and latitude. A system without
    transformation raises ValueError.
    """
    if crs not in (None, "EPSG:4326", "OGC:CRS84", "EPSG:3857"):
        raise ValueError(f"no transformation from {crs}")

    def degrees(g: Geom) -> Geom:
        for part in g.members:
            degrees(part)
        turn = lambda path: [(math.degrees(c[0] / 6378137.0), math.degrees(2 * math.atan(math.exp(c[1] / 6378137.0)) - math.pi / 2), *c[2:]) for c in path]
        g.points, g.lines, g.polygons = turn(g.points), [turn(x) for x in g.lines], [[turn(r) for r in p] for p in g.polygons]
        return g

    def as_json(values: pd.Series) -> pd.Series:
        read = (lambda v: degrees(wkb.load(v))) if crs == "EPSG:3857" else wkb.load
        return pd.Series([None if v is None else json.dumps(to_mapping(read(v))) for v in values], dtype=object)

    g = F.pandas_udf(as_json, "string")(F.col(geometry))
    rest = [c for c in features.columns if c not in (geometry, index)]
    props = F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}) if rest else F.lit("{}")
    line = F.concat(F.lit('{"type":"Feature","id":'), F.col(index).cast("string"), F.lit(',"properties":'), props, F.lit(',"geometry":'), F.coalesce(g, F.lit("null")), F.lit("}"))
    features.select(line.alias("value")).write.text(path)
