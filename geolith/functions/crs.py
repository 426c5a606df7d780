"""Coordinate reference systems as column expressions: one writing for each, and the common projections both ways.

There is no database of systems here.  A text that names an authority and a code, in any of the usual writings, becomes
``AUTHORITY:CODE``; a definition without code is known by the names below; any other definition keeps its name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names under which definitions without a code are written.
NAMES = {"WGS 84": "EPSG:4326", "WGS_1984": "EPSG:4326", "GCS_WGS_1984": "EPSG:4326", "WGS 84 / PSEUDO-MERCATOR": "EPSG:3857", "WGS_1984_WEB_MERCATOR_AUXILIARY_SPHERE": "EPSG:3857", "ETRS89": "EPSG:4258", "NAD83": "EPSG:4269"}
RADIUS = 6378137.0
FLATTENING = 1 / 298.257223563
UTM_SCALE = 0.9996
WEB_MERCATOR_LATITUDE = math.degrees(2 * math.atan(math.exp(math.pi)) - math.pi / 2)


def canonical_crs(text: Column) -> Column:
    """AUTHORITY:CODE, or NAME:name for a definition without a code; null for null, blank and text that is no reference system.

    Read are authority:code, URN and URL of the OGC, WKT of both versions (its last identifier is the whole's) and PROJJSON.
    """
    t = F.trim(text)
    pair = lambda pattern: F.concat_ws(":", *[F.upper(F.regexp_extract(t, pattern, k)) for k in (1, 2)])
    short = r"(?i)\A([A-Z]+)\s*:{1,2}\s*([A-Z0-9]+)\z"
    urn = r"(?i)\Aurn:(?:x-)?ogc:def:crs:([A-Z]+):[^:]*:([A-Z0-9]+)\z"
    url = r"(?i)\Ahttps?://(?:www\.)?opengis\.net/def/crs/([A-Z]+)/[^/]+/([A-Z0-9]+)/?\z"
    ident = r"(?is)\A\s*[A-Z_]+\s*\[.*(?:AUTHORITY|ID)\s*\[\s*\"([A-Z]+)\"\s*,\s*\"?([A-Z0-9]+)\"?[^\[\]]*\]\s*\]\s*\z"
    named = r"(?is)\A\s*(?:GEOGCS|GEOGCRS|GEODCRS|GEODETICCRS|PROJCS|PROJCRS|PROJECTEDCRS|BOUNDCRS|COMPD_CS|COMPOUNDCRS)\s*\[\s*\"([^\"]+)\""
    name = F.upper(F.regexp_extract(t, named, 1))
    utm = r"\AWGS[ _](?:19)?84[ _/]+UTM[ _]ZONE[ _]([0-9]{1,2})([NS])\z"
    zone = F.regexp_extract(name, utm, 1).try_cast("int") + F.when(F.regexp_extract(name, utm, 2) == "N", 32600).otherwise(32700)
    known = F.create_map(*[F.lit(x) for k in NAMES.items() for x in k])
    json = t.startswith("{")
    code = F.get_json_object(t, "$.id.code")
    json_name = F.upper(F.coalesce(F.get_json_object(t, "$.name"), F.lit("")))
    by_name = lambda n: F.coalesce(F.try_element_at(known, n), F.when(n != "", F.concat(F.lit("NAME:"), n)))
    return (
        F.when(json & code.isNotNull(), F.concat_ws(":", F.upper(F.get_json_object(t, "$.id.authority")), F.upper(code)))
        .when(json, by_name(json_name))
        .when(t.rlike(short), pair(short))
        .when(t.rlike(urn), pair(urn))
        .when(t.rlike(url), pair(url))
        .when(t.rlike(ident), pair(ident))
        .when(name.rlike(utm), F.concat(F.lit("EPSG:"), zone.cast("string")))
        .when(name != "", by_name(name))
    )


def to_web_mercator(longitude: Column, latitude: Column) -> tuple[Column, Column]:
    """EPSG:4326 degrees to EPSG:3857 metres; null beyond the latitudes of the square."""
    inside = F.abs(latitude) <= WEB_MERCATOR_LATITUDE
    y = RADIUS * F.log(F.tan(math.pi / 4 + F.radians(latitude) / 2))
    return F.when(inside, RADIUS * F.radians(longitude)), F.when(inside, y)


def from_web_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    """EPSG:3857 metres to EPSG:4326 degrees."""
    return F.degrees(x / RADIUS), F.degrees(2 * F.atan(F.exp(y / RADIUS)) - math.pi / 2)


def _series():
    """Third flattening, rectifying radius and the coefficients of the transverse Mercator series to the fourth order."""
    n = FLATTENING / (2 - FLATTENING)
    radius = RADIUS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
    return n, radius, alpha


def to_utm(longitude: Column, latitude: Column, zone: int, north: bool = True) -> tuple[Column, Column]:
    """EPSG:4326 degrees to metres of a UTM zone on WGS 84, by the transverse Mercator series; good to a millimetre within some degrees of the zone."""
    if not 1 <= zone <= 60:
        raise ValueError("a zone is within 1 and 60")
    n, radius, alpha = _series()
    c = 2 * math.sqrt(n) / (1 + n)
    sin = F.sin(F.radians(latitude))
    t = F.sinh(F.atanh(sin) - c * F.atanh(c * sin))
    away = F.radians(longitude - (6 * zone - 183))
    xi, eta = F.atan2(t, F.cos(away)), F.atanh(F.sin(away) / F.sqrt(1 + t * t))
    north_of, east_of = xi, eta
    for j, a in enumerate(alpha, 1):
        north_of = north_of + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        east_of = east_of + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    return 500_000 + UTM_SCALE * radius * east_of, (0 if north else 10_000_000) + UTM_SCALE * radius * north_of


def reproject(x: Column, y: Column, source: str, target: str) -> tuple[Column, Column]:
    """Coordinates of one system in another: EPSG:4326 and OGC:CRS84 (longitude first for both), EPSG:3857, and UTM zones of WGS 84 as targets. Any other pair raises ValueError."""
    geodetic = ("EPSG:4326", "OGC:CRS84")
    if source == target or {source, target} <= set(geodetic):
        return x, y
    if source == "EPSG:3857":
        x, y = from_web_mercator(x, y)
    elif source not in geodetic:
        raise ValueError(f"no transformation from {source}")
    if target in geodetic:
        return x, y
    if target == "EPSG:3857":
        return to_web_mercator(x, y)
    if target[:8] in ("EPSG:326", "EPSG:327") and target[8:].isdigit() and len(target) == 10:
        return to_utm(x, y, int(target[8:]), target[7] == "6")
    raise ValueError(f"no transformation to {target}")
