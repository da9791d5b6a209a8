"""Geodesy as SQL expressions, for Spark SQL (``expr``) and any engine with the usual trigonometry.

Points are pairs of column names or expressions in degrees, distances metres,
bearings radians unless named otherwise.  All are plain expressions, so they
stay inside generated code; arguments of asin and acos are clamped.
"""

from __future__ import annotations

R = "cast(6371008.8 as double)"
Point = tuple[str, str]


def num(x: float) -> str:
    return f"cast({x!r} as double)"


def haversine(a: Point, b: Point) -> str:
    p1, p2 = f"radians({a[0]})", f"radians({b[0]})"
    s1, s2 = f"sin(({p2} - {p1}) / 2)", f"sin((radians({b[1]}) - radians({a[1]})) / 2)"
    return f"(2 * {R} * asin(sqrt(least({num(1.0)}, {s1} * {s1} + cos({p1}) * cos({p2}) * {s2} * {s2}))))"


def bearing(a: Point, b: Point) -> str:
    p1, p2, dl = f"radians({a[0]})", f"radians({b[0]})", f"(radians({b[1]}) - radians({a[1]}))"
    return f"atan2(sin({dl}) * cos({p2}), cos({p1}) * sin({p2}) - sin({p1}) * cos({p2}) * cos({dl}))"


def wrapped(angle: str) -> str:
    """To [-pi, pi], for angles within a turn of it."""
    return f"(case when {angle} > pi() then {angle} - 2 * pi() when {angle} < -pi() then {angle} + 2 * pi() else {angle} end)"


def fast_bearing(a: Point, b: Point) -> str:
    dl = wrapped(f"(radians({b[1]}) - radians({a[1]}))")
    return f"atan2({dl} * cos((radians({a[0]}) + radians({b[0]})) / 2), radians({b[0]}) - radians({a[0]}))"


def cross_track(p: Point, a: Point, b: Point) -> str:
    return f"(asin(greatest({num(-1.0)}, least({num(1.0)}, sin({haversine(a, p)} / {R}) * sin({bearing(a, p)} - {bearing(a, b)})))) * {R})"


def along_track(p: Point, a: Point, b: Point) -> str:
    xt = cross_track(p, a, b)
    d = f"(acos(greatest({num(-1.0)}, least({num(1.0)}, cos({haversine(a, p)} / {R}) / cos({xt} / {R})))) * {R})"
    return f"(case when cos({bearing(a, p)} - {bearing(a, b)}) < 0 then -{d} else {d} end)"


def in_corridor(p: Point, a: Point, b: Point, half: str) -> str:
    return f"(abs({cross_track(p, a, b)}) <= {half} and {along_track(p, a, b)} between -{half} and {haversine(a, b)} + {half})"


def destination(a: Point, theta: str, dist: str) -> Point:
    p, d = f"radians({a[0]})", f"(({dist}) / {R})"
    s = f"greatest({num(-1.0)}, least({num(1.0)}, sin({p}) * cos({d}) + cos({p}) * sin({d}) * cos({theta})))"
    return f"degrees(asin({s}))", f"degrees(radians({a[1]}) + atan2(sin({theta}) * sin({d}) * cos({p}), cos({d}) - sin({p}) * {s}))"


def normal_degrees(x: str) -> str:
    return f"((({x}) % 360 + 360) % 360)"


def degrees_apart(a: str, b: str) -> str:
    d = f"(abs({a} - {b}) % 360)"
    return f"least({d}, 360 - {d})"


def east_north(p: Point, a: Point) -> Point:
    """Metres east and north of a in the local plane at mid latitude."""
    rad = f"({R} * pi() / 180)"
    return f"(({p[1]} - {a[1]}) * cos(radians(({p[0]} + {a[0]}) / 2)) * {rad})", f"(({p[0]} - {a[0]}) * {rad})"


def segment_distance(p: Point, a: Point, b: Point) -> str:
    """Metres from p to the segment a-b in the local plane of a."""
    (px, py), (bx, by) = east_north(p, a), east_north(b, a)
    t = f"(case when {bx} * {bx} + {by} * {by} > 0 then greatest({num(0.0)}, least({num(1.0)}, ({px} * {bx} + {py} * {by}) / ({bx} * {bx} + {by} * {by}))) else {num(0.0)} end)"
    return f"sqrt(({px} - {t} * {bx}) * ({px} - {t} * {bx}) + ({py} - {t} * {by}) * ({py} - {t} * {by}))"


def project_offset(anchor: Point, heading: str, x: str, y: str) -> Point:
    """x metres along the baseline ``heading``, y up from it (to its left)."""
    return destination(anchor, f"({heading} + atan2(-({y}), {x}))", f"sqrt(({x}) * ({x}) + ({y}) * ({y}))")
