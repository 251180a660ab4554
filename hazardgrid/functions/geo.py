"""Geographic column functions (WGS84 degrees in, metres or degrees out).

The local frame of an event is the spherical azimuthal-equidistant projection at its centre, x east
and y north, in closed form.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from hazardgrid.constants import COMPASS_8, COMPASS_16, COMPASS_16_WORDS, EARTH_RADIUS_M, M_PER_DEG


def _lit(x):
    return x if isinstance(x, Column) else F.lit(float(x))


def _col(x):
    return F.col(x) if isinstance(x, str) else _lit(x)


def angular_distance(lon1, lat1, lon2, lat2) -> Column:
    """Great-circle angle in radians, stable for small distances."""
    lon1, lat1, lon2, lat2 = map(_col, (lon1, lat1, lon2, lat2))
    s_lat = F.sin(F.radians(lat2 - lat1) / 2)
    s_lon = F.sin(F.radians(lon2 - lon1) / 2)
    h = s_lat * s_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * s_lon * s_lon
    return F.lit(2.0) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def haversine_m(lon1, lat1, lon2, lat2) -> Column:
    return angular_distance(lon1, lat1, lon2, lat2) * F.lit(EARTH_RADIUS_M)


def bearing_deg(lon1, lat1, lon2, lat2) -> Column:
    """Initial bearing, 0 = north, clockwise, in [0, 360)."""
    lon1, lat1, lon2, lat2 = map(_col, (lon1, lat1, lon2, lat2))
    p1, p2, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    east = F.sin(dl) * F.cos(p2)
    north = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    return F.pmod(F.degrees(F.atan2(east, north)) + 360.0, F.lit(360.0))


def destination_point(lon, lat, bearing, dist_m) -> Column:
    """Point reached along a great circle, as ``struct<lon, lat>``."""
    lon, lat, bearing, dist_m = map(_col, (lon, lat, bearing, dist_m))
    ang, br, p1 = dist_m / F.lit(EARTH_RADIUS_M), F.radians(bearing), F.radians(lat)
    sin_p2 = F.sin(p1) * F.cos(ang) + F.cos(p1) * F.sin(ang) * F.cos(br)
    dl = F.atan2(F.sin(br) * F.sin(ang) * F.cos(p1), F.cos(ang) - F.sin(p1) * sin_p2)
    return F.struct(
        F.degrees(F.radians(lon) + dl).alias("lon"), F.degrees(F.asin(sin_p2)).alias("lat")
    )


def to_local(lon, lat, lon0, lat0) -> Column:
    """Degrees to local metres, as ``struct<x, y>``."""
    lon, lat, lon0, lat0 = map(_col, (lon, lat, lon0, lat0))
    c = angular_distance(lon0, lat0, lon, lat)
    k = F.when(c < 1e-12, F.lit(1.0)).otherwise(c / F.sin(c)) * F.lit(EARTH_RADIUS_M)
    dl, p, p0 = F.radians(lon - lon0), F.radians(lat), F.radians(lat0)
    return F.struct(
        (k * F.cos(p) * F.sin(dl)).alias("x"),
        (k * (F.cos(p0) * F.sin(p) - F.sin(p0) * F.cos(p) * F.cos(dl))).alias("y"),
    )


def to_wgs84(x, y, lon0, lat0) -> Column:
    """Local metres to degrees, as ``struct<lon, lat>``."""
    x, y, lon0, lat0 = map(_col, (x, y, lon0, lat0))
    rho = F.hypot(x, y)
    c, p0 = rho / F.lit(EARTH_RADIUS_M), F.radians(lat0)
    at_origin = rho < 1e-9
    sin_lat = F.cos(c) * F.sin(p0) + y * F.sin(c) * F.cos(p0) / rho
    dl = F.atan2(x * F.sin(c), rho * F.cos(p0) * F.cos(c) - y * F.sin(p0) * F.sin(c))
    return F.struct(
        F.when(at_origin, lon0).otherwise(lon0 + F.degrees(dl)).alias("lon"),
        F.when(at_origin, lat0).otherwise(F.degrees(F.asin(sin_lat))).alias("lat"),
    )


def axis_index(metres, n, cell_m) -> Column:
    """Cell index along one axis, rounded half to even and not bounded."""
    metres, n, cell_m = map(_col, (metres, n, cell_m))
    return F.rint(metres / cell_m + (n - 1) / 2.0).cast("int")


def axis_metres(k, n, cell_m) -> Column:
    """Centre of cell ``k`` along one axis, in local metres."""
    k, n, cell_m = map(_col, (k, n, cell_m))
    return (k - (n - 1) / 2.0) * cell_m


def clip_index(k, n) -> Column:
    k, n = _col(k), _col(n)
    return F.greatest(F.lit(0), F.least(k, n - 1)).cast("int")


def in_bounds(i, j, ny, nx) -> Column:
    i, j, ny, nx = map(_col, (i, j, ny, nx))
    return (i >= 0) & (i < ny) & (j >= 0) & (j < nx)


def pad_bbox_m(minlon, minlat, maxlon, maxlat, pad_m) -> Column:
    """Bounding box grown by metres on every side."""
    minlon, minlat, maxlon, maxlat, pad_m = map(_col, (minlon, minlat, maxlon, maxlat, pad_m))
    dlat = pad_m / F.lit(M_PER_DEG)
    shrink = F.greatest(F.lit(0.05), F.cos(F.radians((minlat + maxlat) / 2.0)))
    dlon = pad_m / (F.lit(M_PER_DEG) * shrink)
    return F.struct(
        (minlon - dlon).alias("minlon"),
        (minlat - dlat).alias("minlat"),
        (maxlon + dlon).alias("maxlon"),
        (maxlat + dlat).alias("maxlat"),
    )


def pad_bbox_fraction(minlon, minlat, maxlon, maxlat, frac=0.35, floor_deg=0.005) -> Column:
    """Bounding box grown by a share of its own size; a flat side grows by ``floor_deg``."""
    minlon, minlat, maxlon, maxlat = map(_col, (minlon, minlat, maxlon, maxlat))

    def pad(lo, hi):
        d = (hi - lo) * F.lit(float(frac))
        return F.when(d == 0, F.lit(float(floor_deg))).otherwise(d)

    dlon, dlat = pad(minlon, maxlon), pad(minlat, maxlat)
    return F.struct(
        (minlon - dlon).alias("minlon"),
        (minlat - dlat).alias("minlat"),
        (maxlon + dlon).alias("maxlon"),
        (maxlat + dlat).alias("maxlat"),
    )


def bbox_around(lon, lat, half_deg) -> Column:
    lon, lat, half_deg = map(_col, (lon, lat, half_deg))
    return F.struct(
        (lon - half_deg).alias("minlon"),
        (lat - half_deg).alias("minlat"),
        (lon + half_deg).alias("maxlon"),
        (lat + half_deg).alias("maxlat"),
    )



def ring_bbox(ring, x="lon", y="lat") -> Column:
    """Bounding box of an array of points."""
    ring = _col(ring)
    xs, ys = F.transform(ring, lambda p: p[x]), F.transform(ring, lambda p: p[y])
    return F.struct(
        F.array_min(xs).alias("minlon"),
        F.array_min(ys).alias("minlat"),
        F.array_max(xs).alias("maxlon"),
        F.array_max(ys).alias("maxlat"),
    )


def _shoelace(ring, term) -> Column:
    """Sum of a term over consecutive vertex pairs of a ring, closing it if it is open."""
    ring = _col(ring)
    nxt = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    pairs = F.arrays_zip(ring.alias("a"), nxt.alias("b"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, e: acc + term(e["a"], e["b"]))


def ring_area(ring, x="x", y="y") -> Column:
    """Unsigned planar area of a ring."""
    ring = _col(ring)
    return F.abs(_shoelace(ring, lambda a, b: a[x] * b[y] - b[x] * a[y])) / 2.0


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also inside array functions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ring_centroid(ring) -> Column:
    """Area centroid of a lon/lat ring, taken relative to its first vertex; mean point if flat."""
    ring = _col(ring)

    def cross(a, b):
        return a["x"] * b["y"] - b["x"] * a["y"]

    def moments(local):
        return F.struct(
            _shoelace(local, cross).alias("twice"),
            _shoelace(local, lambda a, b: (a["x"] + b["x"]) * cross(a, b)).alias("mx"),
            _shoelace(local, lambda a, b: (a["y"] + b["y"]) * cross(a, b)).alias("my"),
            (F.aggregate(local, F.lit(0.0), lambda s, p: s + p["x"]) / F.size(local)).alias("ax"),
            (F.aggregate(local, F.lit(0.0), lambda s, p: s + p["y"]) / F.size(local)).alias("ay"),
        )

    def centre(origin, m):
        flat = F.abs(m["twice"]) < 1e-15
        return F.struct(
            (origin["lon"] + F.when(flat, m["ax"]).otherwise(m["mx"] / (m["twice"] * 3.0))).alias("lon"),
            (origin["lat"] + F.when(flat, m["ay"]).otherwise(m["my"] / (m["twice"] * 3.0))).alias("lat"),
        )

    def relative(o):
        return F.transform(
            ring, lambda p: F.struct((p["lon"] - o["lon"]).alias("x"), (p["lat"] - o["lat"]).alias("y"))
        )

    origin = F.get(ring, F.lit(0))
    return let(origin, lambda o: let(let(relative(o), lambda v: moments(v)), lambda m: centre(o, m)))


def grow_ring(ring, dist, x="x", y="y", quad_steps: int = 16) -> Column:
    """Ring round all points within ``dist`` of a convex counter-clockwise ring, corners rounded by arcs.

    A quarter turn has ``quad_steps`` chords, whose ends lie on the true outline. One point grows to a disc,
    two to a capsule; an empty or NULL ring stays as it is. ``dist`` is in the ring's own units.
    """
    ring, dist = _col(ring), _lit(dist)
    n = F.size(ring)
    before = F.concat(F.slice(ring, n, F.lit(1)), F.slice(ring, F.lit(1), n - 1))
    after = F.concat(F.slice(ring, F.lit(2), n), F.slice(ring, F.lit(1), F.lit(1)))
    corners = F.arrays_zip(before.alias("a"), ring.alias("p"), after.alias("b"))

    def normal(u, v):
        """Angle of the outward normal of a side."""
        return F.atan2(u[x] - v[x], v[y] - u[y])

    def arc(c):
        turn = F.pmod(normal(c["p"], c["b"]) - normal(c["a"], c["p"]), F.lit(2 * math.pi))
        turn = F.when(n == 1, F.lit(2 * math.pi)).when(turn > 2 * math.pi - 1e-6, F.lit(0.0)).otherwise(turn)
        parts = F.greatest(F.ceil(turn * (2 * quad_steps / math.pi) - 1e-9), F.lit(1)).cast("int")
        spec = F.struct(c["p"].alias("p"), normal(c["a"], c["p"]).alias("start"), turn.alias("turn"), parts.alias("parts"))
        return let(spec, lambda w: F.transform(F.sequence(F.lit(0), w["parts"]), lambda k: at(w, k)))

    def at(w, k):
        angle = w["start"] + w["turn"] * k / w["parts"]
        return F.struct((w["p"][x] + dist * F.cos(angle)).alias(x), (w["p"][y] + dist * F.sin(angle)).alias(y))

    return F.when(n > 0, F.flatten(F.transform(corners, arc))).otherwise(ring)


def polygon_area_m2(ring, lon0=None, lat0=None) -> Column:
    """Area of a lon/lat ring in square metres, in the local frame at its centroid by default."""
    ring = _col(ring)
    if lon0 is None or lat0 is None:
        centre = ring_centroid(ring)
    else:
        centre = F.struct(_col(lon0).alias("lon"), _col(lat0).alias("lat"))

    def area(c):
        local = F.transform(ring, lambda p: to_local(p["lon"], p["lat"], c["lon"], c["lat"]))
        return let(local, lambda v: ring_area(v))

    return let(centre, lambda c: area(c))


def compass_8(bearing) -> Column:
    k = F.floor(F.pmod(_col(bearing) + 22.5, F.lit(360.0)) / 45.0).cast("int")
    return F.element_at(F.array(*[F.lit(d) for d in COMPASS_8]), k + 1)


def compass_16_words(bearing) -> Column:
    k = F.floor((F.pmod(_col(bearing), F.lit(360.0)) + 11.25) / 22.5).cast("int") % 16
    return F.element_at(F.array(*[F.lit(d) for d in COMPASS_16_WORDS]), k + 1)


def compass_16(bearing) -> Column:
    """Nearest of 16 labels; a tie goes up."""
    k = F.floor(F.pmod(_col(bearing), F.lit(360.0)) / 22.5 + 0.5).cast("int") % 16
    return F.element_at(F.array(*[F.lit(d) for d in COMPASS_16]), k + 1)


def _flat_offset(lon, lat, bearing, range_km) -> Column:
    lon, lat, bearing, range_km = map(_col, (lon, lat, bearing, range_km))
    rad = F.radians(bearing)
    return F.struct(
        (lon + F.sin(rad) * range_km / (F.lit(111.32) * F.cos(F.radians(lat)))).alias("lon"),
        (lat + F.cos(rad) * range_km / F.lit(110.574)).alias("lat"),
    )


def bearing_endpoint(lon, lat, bearing, range_km) -> Column:
    """End of a short direction mark, on a locally flat earth."""
    return _flat_offset(lon, lat, bearing, range_km)


def view_cone(lon, lat, pan_deg, fov_deg, range_km=2.2, steps=18) -> Column:
    """Closed ring of a camera's field of view."""
    lon, lat, pan_deg, fov_deg = map(_col, (lon, lat, pan_deg, fov_deg))
    apex = F.array(F.struct(lon.alias("lon"), lat.alias("lat")))
    arc = F.transform(
        F.sequence(F.lit(0), F.lit(int(steps))),
        lambda s: _flat_offset(lon, lat, pan_deg - fov_deg / 2 + fov_deg * s / float(steps), range_km),
    )
    return F.concat(apex, arc, apex)


def wind_to_uv(speed, dir_from_deg) -> Column:
    """Speed and direction-from to components of where the wind blows to."""
    speed, dir_from_deg = _col(speed), _col(dir_from_deg)
    to = F.radians(F.pmod(dir_from_deg + 180.0, F.lit(360.0)))
    return F.struct((speed * F.sin(to)).alias("u"), (speed * F.cos(to)).alias("v"))


def uv_speed(u, v) -> Column:
    return F.hypot(_col(u), _col(v))


def uv_dir_to(u, v) -> Column:
    return F.pmod(F.degrees(F.atan2(_col(u), _col(v))) + 360.0, F.lit(360.0))


def uv_dir_from(u, v) -> Column:
    return F.pmod(F.degrees(F.atan2(-_col(u), -_col(v))) + 360.0, F.lit(360.0))


def deg_to_tile(lon, lat, zoom) -> Column:
    """Fractional web-map tile address of a point."""
    lon, lat = _col(lon), _col(lat)
    n = float(2**zoom)
    return F.struct(
        ((lon + 180.0) / 360.0 * n).alias("x"),
        ((F.lit(1.0) - F.asinh(F.tan(F.radians(lat))) / F.pi()) / 2.0 * n).alias("y"),
    )


def tile_to_deg(x, y, zoom) -> Column:
    x, y = _col(x), _col(y)
    n = float(2**zoom)
    return F.struct(
        (x / n * 360.0 - 180.0).alias("lon"),
        F.degrees(F.atan(F.sinh(F.pi() * (F.lit(1.0) - y * 2.0 / n)))).alias("lat"),
    )


def landcover_tile(lon, lat) -> Column:
    """Name of the 3-degree land-cover tile holding a point."""
    tlat = (F.floor(_col(lat) / 3) * 3).cast("int")
    tlon = (F.floor(_col(lon) / 3) * 3).cast("int")
    return F.format_string(
        "%s%02d%s%03d",
        F.when(tlat >= 0, "N").otherwise("S"),
        F.abs(tlat),
        F.when(tlon < 0, "W").otherwise("E"),
        F.abs(tlon),
    )


def fixed_grid_to_lonlat(x, y, height, semi_major, semi_minor, lon0_deg) -> Column:
    """Geostationary scan angles (radians) to lon/lat; NULL where the ray misses the earth.

    Closed form of the published fixed-grid navigation equations.
    """
    x, y = _col(x), _col(y)
    height, semi_major, semi_minor, lon0 = map(_col, (height, semi_major, semi_minor, lon0_deg))
    big_h = height + semi_major
    ratio = semi_major * semi_major / (semi_minor * semi_minor)
    a = F.sin(x) * F.sin(x) + F.cos(x) * F.cos(x) * (
        F.cos(y) * F.cos(y) + ratio * F.sin(y) * F.sin(y)
    )
    b = F.lit(-2.0) * big_h * F.cos(x) * F.cos(y)
    c = big_h * big_h - semi_major * semi_major
    disc = b * b - a * c * 4.0
    rs = (-b - F.sqrt(disc)) / (a * 2.0)
    sx, sy, sz = rs * F.cos(x) * F.cos(y), -rs * F.sin(x), rs * F.cos(x) * F.sin(y)
    seen = disc >= 0
    return F.struct(
        F.when(seen, lon0 - F.degrees(F.atan(sy / (big_h - sx)))).alias("lon"),
        F.when(seen, F.degrees(F.atan(ratio * sz / F.hypot(big_h - sx, sy)))).alias("lat"),
    )
