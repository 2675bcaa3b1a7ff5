"""Geography: parsing, distances and relations, as columns where rows are many."""

from __future__ import annotations

import math
import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

TOLERANCE = 1e-6
UNITS = {
    "in": 0.0254, "inch": 0.0254, "yd": 0.9144, "yards": 0.9144, "ft": 0.3048, "feet": 0.3048, "km": 1000.0, "kilometers": 1000.0,
    "nm": 1852.0, "nauticalmiles": 1852.0, "mm": 0.001, "millimeters": 0.001, "cm": 0.01, "centimeters": 0.01, "mi": 1609.344,
    "miles": 1609.344, "m": 1.0, "meters": 1.0,
}
_AXIS, _POLE = 6378.137, 6356.7523142


def distance_metres(text: str) -> float:
    m = re.fullmatch(r"\s*([0-9.eE+-]+)\s*([a-z]*)\s*", text)
    if not m or m[2] and m[2] not in UNITS:
        raise ValueError(f"no distance: {text}")
    return float(m[1]) * UNITS[m[2] or "m"]


_BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def decode_geohash(code: str) -> tuple[float, float]:
    """(lon, lat) of the middle of a cell."""
    lon, lat, even = [-180.0, 180.0], [-90.0, 90.0], True
    for c in code:
        value = _BASE32.index(c)
        for bit in (16, 8, 4, 2, 1):
            own = lon if even else lat
            own[0 if value & bit else 1] = (own[0] + own[1]) / 2
            even = not even
    return (lon[0] + lon[1]) / 2, (lat[0] + lat[1]) / 2


def encode_geohash(lon: float, lat: float, length: int = 12) -> str:
    ranges, out, even, value = ([-180.0, 180.0], [-90.0, 90.0]), "", True, 0
    for i in range(length * 5):
        own, x = (ranges[0], lon) if even else (ranges[1], lat)
        middle = (own[0] + own[1]) / 2
        value = value * 2 + (x >= middle)
        own[0 if x >= middle else 1] = middle
        even = not even
        if i % 5 == 4:
            out, value = out + _BASE32[value], 0
    return out


def parse_point(value: Any) -> tuple[float, float] | None:
    """(lon, lat) of "lat,lon", a geohash, [lon, lat] or an object."""
    if isinstance(value, str):
        if "," in value:
            parts = value.split(",")
            try:
                return (float(parts[1]), float(parts[0])) if len(parts) == 2 else None
            except ValueError:
                return None
        return decode_geohash(value) if 0 < len(value) <= 12 and all(c in _BASE32 for c in value) else None
    if isinstance(value, (list, tuple)):
        return (float(value[0]), float(value[1])) if len(value) >= 2 and all(isinstance(x, (int, float)) for x in value[:2]) else None
    if isinstance(value, dict):
        lon = next((value[k] for k in ("lon", "lng") if k in value), None)
        return (float(lon), float(value["lat"])) if isinstance(lon, (int, float)) and isinstance(value.get("lat"), (int, float)) else None
    return None


# Morton codes: 32 bits each of longitude and latitude, interleaved


def morton(lon: float, lat: float) -> int:
    x, y = int((lon + 180) / 360 * 0xFFFFFFFF), int((lat + 90) / 180 * 0xFFFFFFFF)
    return sum(((x >> i & 1) << 2 * i) | ((y >> i & 1) << (2 * i + 1)) for i in range(32))


def unmorton(code: int) -> tuple[float, float]:
    x = sum((code >> 2 * i & 1) << i for i in range(32))
    y = sum((code >> 2 * i + 1 & 1) << i for i in range(32))
    return x / 0xFFFFFFFF * 360 - 180, y / 0xFFFFFFFF * 180 - 90


def diameter_km(lat: Any) -> Any:
    """The earth's diameter at a latitude (degrees); works on columns and numbers."""
    cos, sin, sqrt = (F.cos, F.sin, F.sqrt) if isinstance(lat, Column) else (math.cos, math.sin, math.sqrt)
    a = lat * (math.pi / 180)
    c, s = cos(a), sin(a)
    top = (_AXIS**2 * c) * (_AXIS**2 * c) + (_POLE**2 * s) * (_POLE**2 * s)
    return 2 * sqrt(top / ((_AXIS * c) * (_AXIS * c) + (_POLE * s) * (_POLE * s)))


def haversine_km(lon1: Any, lat1: Any, lon2: Any, lat2: Any) -> Any:
    """Great-circle distance with the diameter at the middle latitude; columns or numbers."""
    column = any(isinstance(x, Column) for x in (lon1, lat1, lon2, lat2))
    cos, asin, sqrt = (F.cos, F.asin, F.sqrt) if column else (math.cos, math.asin, math.sqrt)
    r = math.pi / 180
    dlat, dlon = (lat1 - lat2) * r, (lon1 - lon2) * r
    h = (1 - cos(dlat) + cos(lat1 * r) * cos(lat2 * r) * (1 - cos(dlon))) / 2
    middle = (lat1 + lat2) / 2
    root = F.least(F.lit(1.0), sqrt(h)) if column else min(1.0, sqrt(h))
    return diameter_km(F.abs(middle) if isinstance(middle, Column) else abs(middle)) * asin(root)


def in_box(lon: Column, lat: Column, left: float, top: float, right: float, bottom: float) -> Column:
    """Inside a box, borders included; a box whose left is right of its right crosses the dateline."""
    t = TOLERANCE
    tall = (lat >= bottom - t) & (lat <= top + t)
    wide = (lon >= left - t) & (lon <= right + t) if left <= right else (lon >= left - t) | (lon <= right + t)
    return tall & wide


def box_around(lon: float, lat: float, metres: float) -> tuple[float, float, float, float]:
    """left, top, right, bottom of a box that holds the circle."""
    radius = 6350.0 * 1000
    up = math.degrees(metres / radius) * 1.01
    top, bottom = lat + up, lat - up
    if top >= 90 or bottom <= -90:
        return -180.0, min(90.0, top), 180.0, max(-90.0, bottom)
    side = math.degrees(math.asin(min(1.0, math.sin(metres / radius) / math.cos(math.radians(lat))))) * 1.01 if metres < radius else 180.0
    left, right = lon - side, lon + side
    return left + 360 if left < -180 else left, top, right - 360 if right > 180 else right, bottom


def in_polygon(lon: Column, lat: Column, points: list[tuple[float, float]]) -> Column:
    """Ray casting over the edges, as one boolean expression; corners count as inside."""
    inside, corner = F.lit(False), F.lit(False)
    for (ax, ay), (bx, by) in zip(points, points[-1:] + points[:-1], strict=True):
        corner = corner | ((F.abs(lon - ax) <= TOLERANCE) & (F.abs(lat - ay) <= TOLERANCE))
        if ay != by:
            inside = inside != (((F.lit(ay) > lat) != (F.lit(by) > lat)) & (lon < (bx - ax) * (lat - ay) / (by - ay) + ax))
    return corner | inside


# shapes: planar relations on GeoJSON, by segments and rings


def shape_parts(shape: dict) -> list[tuple[str, Any]]:
    """point, line and polygon parts of a GeoJSON-like shape; circles become polygons of 72 corners."""
    kind, c = str(shape.get("type", "")).lower(), shape.get("coordinates")
    if kind == "point":
        return [("point", tuple(c[:2]))]
    if kind == "multipoint":
        return [("point", tuple(p[:2])) for p in c]
    if kind == "linestring":
        return [("line", [tuple(p[:2]) for p in c])]
    if kind == "multilinestring":
        return [("line", [tuple(p[:2]) for p in line]) for line in c]
    if kind == "polygon":
        return [("polygon", [[tuple(p[:2]) for p in ring] for ring in c])]
    if kind == "multipolygon":
        return [("polygon", [[tuple(p[:2]) for p in ring] for ring in poly]) for poly in c]
    if kind == "envelope":
        (left, top), (right, bottom) = c[0][:2], c[1][:2]
        return [("polygon", [[(left, bottom), (right, bottom), (right, top), (left, top), (left, bottom)]])]
    if kind == "circle":
        metres = distance_metres(shape["radius"])
        up = metres / 111_195
        side = up / max(1e-9, math.cos(math.radians(c[1])))
        ring = [(c[0] + side * math.cos(2 * math.pi * i / 72), c[1] + up * math.sin(2 * math.pi * i / 72)) for i in range(73)]
        return [("polygon", [ring])]
    if kind == "geometrycollection":
        return [p for g in shape.get("geometries", []) for p in shape_parts(g)]
    raise ValueError(f"unknown shape type {kind}")


def _cross(o: tuple, a: tuple, b: tuple) -> float:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def _on(p: tuple, a: tuple, b: tuple) -> bool:
    return abs(_cross(a, b, p)) < 1e-12 and min(a[0], b[0]) - 1e-12 <= p[0] <= max(a[0], b[0]) + 1e-12 and min(a[1], b[1]) - 1e-12 <= p[1] <= max(a[1], b[1]) + 1e-12


def _meet(a: tuple, b: tuple, c: tuple, d: tuple) -> bool:
    if any((_on(a, c, d), _on(b, c, d), _on(c, a, b), _on(d, a, b))):
        return True
    return (_cross(a, b, c) > 0) != (_cross(a, b, d) > 0) and (_cross(c, d, a) > 0) != (_cross(c, d, b) > 0)


def _proper(a: tuple, b: tuple, c: tuple, d: tuple) -> bool:
    return not any((_on(a, c, d), _on(b, c, d), _on(c, a, b), _on(d, a, b))) and _meet(a, b, c, d)


def _in_ring(p: tuple, ring: list) -> bool:
    inside = False
    for a, b in zip(ring, ring[1:], strict=False):
        if _on(p, a, b):
            return True
        if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0]:
            inside = not inside
    return inside


def _border(p: tuple, ring: list) -> bool:
    return any(_on(p, a, b) for a, b in zip(ring, ring[1:], strict=False))


def _in_polygon(p: tuple, rings: list) -> bool:
    return _in_ring(p, rings[0]) and not any(_in_ring(p, h) and not _border(p, h) for h in rings[1:])


def _segments(part: tuple[str, Any]) -> list[tuple[tuple, tuple]]:
    kind, c = part
    lines = [] if kind == "point" else [c] if kind == "line" else c
    return [s for line in lines for s in zip(line, line[1:], strict=False)]


def _corners(part: tuple[str, Any]) -> list[tuple]:
    kind, c = part
    return [c] if kind == "point" else c if kind == "line" else c[0]


def _holds_point(part: tuple[str, Any], p: tuple) -> bool:
    kind, c = part
    if kind == "point":
        return abs(c[0] - p[0]) <= TOLERANCE and abs(c[1] - p[1]) <= TOLERANCE
    if kind == "line":
        return any(_on(p, a, b) for a, b in zip(c, c[1:], strict=False))
    return _in_polygon(p, c)


def _parts_meet(a: tuple[str, Any], b: tuple[str, Any]) -> bool:
    return any(_holds_point(a, p) for p in _corners(b)) or any(_holds_point(b, p) for p in _corners(a)) or any(_meet(*s, *t) for s in _segments(a) for t in _segments(b))


def _part_holds(a: tuple[str, Any], b: tuple[str, Any]) -> bool:
    """Whether a covers b."""
    if not all(_holds_point(a, p) for p in _corners(b)):
        return False
    if a[0] != "polygon" or b[0] == "point":
        return all(_holds_point(a, ((p[0] + q[0]) / 2, (p[1] + q[1]) / 2)) for p, q in _segments(b))
    if any(_proper(*s, *t) for s in _segments(a) for t in _segments(b)):
        return False
    middles = [((p[0] + q[0]) / 2, (p[1] + q[1]) / 2) for p, q in _segments(b)]
    holes = b[0] == "polygon" and any(not _border(h[0], a[1][0]) and _in_polygon(h[0], b[1]) for h in a[1][1:])
    return all(_in_polygon(m, a[1]) for m in middles) and not holes


def relate(document: dict, query: dict, relation: str) -> bool:
    """Whether the document's shape intersects, contains, or is within the query's."""
    d, q = shape_parts(document), shape_parts(query)
    if relation == "intersects":
        return any(_parts_meet(a, b) for a in d for b in q)
    outer, inner = (d, q) if relation == "contains" else (q, d)
    return all(any(_part_holds(a, b) for a in outer) for b in inner)


def shape_box(shape: dict) -> tuple[float, float, float, float]:
    """left, bottom, right, top."""
    points = [p for part in shape_parts(shape) for p in _corners(part)]
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    return min(xs), min(ys), max(xs), max(ys)
