"""Fragments of check SQL for geographic formulas."""

R = 6371008.8


def hav(lon1, lat1, lon2, lat2):
    s1 = f"sin(radians(({lat2}) - ({lat1})) / 2)"
    s2 = f"sin(radians(({lon2}) - ({lon1})) / 2)"
    h = f"{s1} * {s1} + cos(radians({lat1})) * cos(radians({lat2})) * {s2} * {s2}"
    return f"(2 * {R} * asin(least(1.0, sqrt({h}))))"


def bearing(lon1, lat1, lon2, lat2):
    p1, p2, dl = f"radians({lat1})", f"radians({lat2})", f"radians(({lon2}) - ({lon1}))"
    e = f"sin({dl}) * cos({p2})"
    n = f"cos({p1}) * sin({p2}) - sin({p1}) * cos({p2}) * cos({dl})"
    return f"((degrees(atan2({e}, {n})) + 360.0) % 360.0)"


def dest(lon, lat, brg, dist):
    a, b, p, q = f"(({dist}) / {R})", f"radians({brg})", f"radians({lat})", f"radians({lon})"
    s = f"(sin({p}) * cos({a}) + cos({p}) * sin({a}) * cos({b}))"
    dl = f"atan2(sin({b}) * sin({a}) * cos({p}), cos({a}) - sin({p}) * {s})"
    return f"degrees({q} + {dl})", f"degrees(asin({s}))"


def local(lon, lat, lon0, lat0):
    c = f"({hav(lon0, lat0, lon, lat)} / {R})"
    k = f"(CASE WHEN {c} < 1e-12 THEN 1.0 ELSE {c} / sin({c}) END * {R})"
    dl, p, p0 = f"radians(({lon}) - ({lon0}))", f"radians({lat})", f"radians({lat0})"
    return (
        f"({k} * cos({p}) * sin({dl}))",
        f"({k} * (cos({p0}) * sin({p}) - sin({p0}) * cos({p}) * cos({dl})))",
    )


def wgs(x, y, lon0, lat0):
    rho = f"sqrt(({x}) * ({x}) + ({y}) * ({y}))"
    c, p0 = f"({rho} / {R})", f"radians({lat0})"
    la = f"degrees(asin(cos({c}) * sin({p0}) + ({y}) * sin({c}) * cos({p0}) / {rho}))"
    lo = f"(({lon0}) + degrees(atan2(({x}) * sin({c}), {rho} * cos({p0}) * cos({c}) - ({y}) * sin({p0}) * sin({c}))))"
    z = f"{rho} < 1e-9"
    return f"CASE WHEN {z} THEN {lon0} ELSE {lo} END", f"CASE WHEN {z} THEN {lat0} ELSE {la} END"


def cell_of(lon, lat, s="s"):
    """Unbounded (i, j) of a point in site ``s``."""
    x, y = local(lon, lat, f"{s}.center_lon", f"{s}.center_lat")
    return (
        f"CAST(round_even({y} / {s}.cell_m + ({s}.ny - 1) / 2.0, 0) AS INT)",
        f"CAST(round_even({x} / {s}.cell_m + ({s}.nx - 1) / 2.0, 0) AS INT)",
    )


def clip(k, n):
    return f"greatest(0, least({k}, {n} - 1))"


def cell_center(i, j, s="s"):
    return wgs(
        f"(({j}) - ({s}.nx - 1) / 2.0) * {s}.cell_m",
        f"(({i}) - ({s}.ny - 1) / 2.0) * {s}.cell_m",
        f"{s}.center_lon",
        f"{s}.center_lat",
    )
