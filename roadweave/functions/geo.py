"""Geometry as Column arithmetic: everything stays in whole-stage code generation.

Points are pairs of double columns. A line is ``array<struct<x: double, y: double>>`` in metres
unless said otherwise. Three earth models are kept apart, as the operators that use them need
different ones: local metres per degree (``offset``), the sphere (``haversine``) and the WGS84
ellipsoid's radii of curvature (``geodesic``). Bearings are compass degrees: 0 north, clockwise.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres per degree of longitude at the equator and of latitude; earth radius.
M_LON, M_LAT, R_EARTH = 111320.0, 110540.0, 6371000.0
#: WGS84 semi-major axis and squared eccentricity.
WGS84_A, WGS84_E2 = 6378137.0, 0.0066943799901413165

#: Published polynomial between WGS84 and RD New (Schreutelkamp, Strang van Hees):
#: (power of latitude offset, power of longitude offset, coefficient) and the way back.
RD_X = [(0, 1, 190094.945), (1, 1, -11832.228), (2, 1, -114.221), (0, 3, -32.391), (1, 0, -0.705), (3, 1, -2.340), (1, 3, -0.608), (0, 2, -0.008), (2, 3, 0.148)]
RD_Y = [(1, 0, 309056.544), (0, 2, 3638.893), (2, 0, 73.077), (1, 2, -157.984), (3, 0, 59.788), (0, 1, 0.433), (2, 2, -6.439), (1, 1, -0.032), (0, 4, 0.092), (1, 4, -0.054)]
WGS_LAT = [(0, 1, 3235.65389), (2, 0, -32.58297), (0, 2, -0.24750), (2, 1, -0.84978), (0, 3, -0.06550), (2, 2, -0.01709), (1, 0, -0.00738), (4, 0, 0.00530), (2, 3, -0.00039), (4, 1, 0.00033), (1, 1, -0.00012)]
WGS_LON = [(1, 0, 5260.52916), (1, 1, 105.94684), (1, 2, 2.45656), (3, 0, -0.81885), (1, 3, 0.05594), (3, 1, -0.05607), (0, 1, 0.01199), (3, 2, -0.00256), (1, 4, 0.00128), (0, 2, 0.00022), (2, 0, -0.00022), (5, 0, 0.00026)]
RD_ORIGIN = (155000.0, 463000.0, 52.15517440, 5.38720621)


def _c(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def _let(value: Column, f) -> Column:
    """``f(value)`` with ``value`` worked out once, however often ``f`` names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _power(x: Column, n: int) -> Column:
    out = F.lit(1.0)
    for _ in range(n):
        out = out * x
    return out


def _polynomial(terms: list[tuple[int, int, float]], p: Column, q: Column) -> Column:
    return sum((F.lit(c) * _power(p, i) * _power(q, j) for i, j, c in terms), F.lit(0.0))


def to_rd(lon, lat) -> tuple[Column, Column]:
    """RD New metres of a WGS84 position (within millimetres of the way back)."""
    p, q = (_c(lat) - RD_ORIGIN[2]) * 0.36, (_c(lon) - RD_ORIGIN[3]) * 0.36
    return _polynomial(RD_X, p, q) + RD_ORIGIN[0], _polynomial(RD_Y, p, q) + RD_ORIGIN[1]


def from_rd(x, y) -> tuple[Column, Column]:
    """WGS84 longitude and latitude of RD New metres."""
    p, q = (_c(x) - RD_ORIGIN[0]) * 1e-5, (_c(y) - RD_ORIGIN[1]) * 1e-5
    return _polynomial(WGS_LON, p, q) / 3600 + RD_ORIGIN[3], _polynomial(WGS_LAT, p, q) / 3600 + RD_ORIGIN[2]


def offset(lon0, lat0, lon, lat) -> tuple[Column, Column]:
    """Metres east and north of the first position, with constant metres per degree there."""
    return (_c(lon) - _c(lon0)) * M_LON * F.cos(F.radians(_c(lat0))), (_c(lat) - _c(lat0)) * M_LAT


def geodesic(lon0, lat0, lon, lat) -> Column:
    """Metres between near positions with the ellipsoid's radii of curvature at the first."""
    s = F.sin(F.radians(_c(lat0)))
    w = F.lit(1.0) - F.lit(WGS84_E2) * s * s
    north = F.radians(_c(lat) - _c(lat0)) * (WGS84_A * (1 - WGS84_E2)) / (w * F.sqrt(w))
    east = F.radians(_c(lon) - _c(lon0)) * WGS84_A / F.sqrt(w) * F.cos(F.radians(_c(lat0)))
    return F.sqrt(north * north + east * east)


def haversine(lon0, lat0, lon, lat) -> Column:
    a, b = F.radians(_c(lat0)), F.radians(_c(lat))
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(_c(lon) - _c(lon0)) / 2), 2)
    return 2 * R_EARTH * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def initial_bearing(lon0, lat0, lon, lat) -> Column:
    a, b, d = F.radians(_c(lat0)), F.radians(_c(lat)), F.radians(_c(lon) - _c(lon0))
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))), F.lit(360.0))


def destination(lon, lat, bearing, metres) -> tuple[Column, Column]:
    a, t, d = F.radians(_c(lat)), F.radians(_c(bearing)), _c(metres) / R_EARTH
    b = F.asin(F.sin(a) * F.cos(d) + F.cos(a) * F.sin(d) * F.cos(t))
    return _c(lon) + F.degrees(F.atan2(F.sin(t) * F.sin(d) * F.cos(a), F.cos(d) - F.sin(a) * F.sin(b))), F.degrees(b)


def rounded(x, digits: int) -> Column:
    """A number of at least 0 rounded half up as SQL rounds a double, without a decimal for each row."""
    scale = float(10**digits)
    return F.floor(_c(x) * scale + 0.5) / scale


def azimuth(dx, dy) -> Column:
    return F.pmod(F.degrees(F.atan2(_c(dx), _c(dy))), F.lit(360.0))


def angle_between(a, b) -> Column:
    """Unsigned difference of two bearings, 0 to 180."""
    return F.abs(F.pmod(_c(a) - _c(b) + 180.0, F.lit(360.0)) - 180.0)


def turn(a, b) -> Column:
    """Signed turn from bearing a to b in (-180, 180]; positive is right."""
    return F.lit(180.0) - F.pmod(F.lit(180.0) - (_c(b) - _c(a)), F.lit(360.0))


def along(dx, dy, heading) -> Column:
    """Metres ahead in the direction of ``heading``; 0 without one."""
    h = F.radians(_c(heading))
    return F.coalesce(_c(dx) * F.sin(h) + _c(dy) * F.cos(h), F.lit(0.0))


def segment_fraction(px, py, ax, ay, bx, by) -> Column:
    """Where on segment a-b (0 to 1) the nearest point to p lies; 0 for a segment without length."""
    dx, dy = _c(bx) - _c(ax), _c(by) - _c(ay)
    length = dx * dx + dy * dy
    t = ((_c(px) - _c(ax)) * dx + (_c(py) - _c(ay)) * dy) / length
    return F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))).otherwise(F.lit(0.0))


def segment_distance(px, py, ax, ay, bx, by) -> Column:
    t = segment_fraction(px, py, ax, ay, bx, by)
    x, y = _c(ax) + t * (_c(bx) - _c(ax)) - _c(px), _c(ay) + t * (_c(by) - _c(ay)) - _c(py)
    return F.sqrt(x * x + y * y)


# lines --------------------------------------------------------------------------------------


def segments(line) -> Column:
    """``array<struct<a, b, len, start>>``: segments with their length and running start."""
    line = _c(line)
    pairs = F.when(F.size(line) >= 2, F.zip_with(F.slice(line, 1, F.size(line) - 1), F.slice(line, 2, F.size(line) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"), F.hypot(b["x"] - a["x"], b["y"] - a["y"]).alias("len")))).otherwise(
        F.array().cast("array<struct<a:struct<x:double,y:double>,b:struct<x:double,y:double>,len:double>>")
    )

    def started(pairs: Column) -> Column:
        sums = F.aggregate(pairs, F.array(F.lit(0.0)), lambda acc, s: F.concat(acc, F.array(F.element_at(acc, -1) + s["len"])))
        return F.zip_with(pairs, F.slice(sums, 1, F.greatest(F.size(pairs), F.lit(1))), lambda s, t: F.when(s.isNotNull(), F.struct(s["a"].alias("a"), s["b"].alias("b"), s["len"].alias("len"), t.alias("start"))))

    return _let(pairs, started)


def line_length(line) -> Column:
    return F.aggregate(F.filter(segments(line), lambda s: s.isNotNull()), F.lit(0.0), lambda acc, s: acc + s["len"])


def project(line, px, py) -> Column:
    """``struct<dist, along, total, x, y, bearing>`` of the nearest point; the first of equals."""
    px, py = _c(px), _c(py)
    found = F.transform(
        F.filter(segments(line), lambda s: s.isNotNull()),
        lambda s: F.struct(
            segment_distance(px, py, s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"]).alias("dist"),
            (s["start"] + s["len"] * segment_fraction(px, py, s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"])).alias("along"),
            (s["a"]["x"] + (s["b"]["x"] - s["a"]["x"]) * segment_fraction(px, py, s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"])).alias("x"),
            (s["a"]["y"] + (s["b"]["y"] - s["a"]["y"]) * segment_fraction(px, py, s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"])).alias("y"),
            azimuth(s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]).alias("bearing"),
        ),
    )
    best = F.array_min(found)
    return F.when(F.size(found) > 0, F.struct(best["dist"].alias("dist"), best["along"].alias("along"), line_length(line).alias("total"), best["x"].alias("x"), best["y"].alias("y"), best["bearing"].alias("bearing")))


def point_at(line, metres) -> Column:
    """``struct<x, y>`` at this distance along the line, held to its ends."""
    m = _c(metres)
    held = F.filter(segments(line), lambda s: s.isNotNull() & (s["len"] > 0))

    def on(s: Column) -> Column:
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (m - s["start"]) / s["len"]))
        return F.when(s.isNotNull(), F.struct((s["a"]["x"] + t * (s["b"]["x"] - s["a"]["x"])).alias("x"), (s["a"]["y"] + t * (s["b"]["y"] - s["a"]["y"])).alias("y")))

    return _let(_let(held, lambda h: F.coalesce(F.try_element_at(F.filter(h, lambda s: s["start"] + s["len"] >= m), F.lit(1)), F.try_element_at(h, F.lit(-1)))), on)


def bearing_at(line, fraction, span: float = 0.001) -> Column:
    """Azimuth of a line around a fraction of its length: from ``span`` before it to ``span`` after it, held to the ends.

    Null where both points are one.
    """
    total = line_length(line)
    ends = F.struct(point_at(line, (_c(fraction) - span) * total).alias("a"), point_at(line, (_c(fraction) + span) * total).alias("b"))
    return _let(ends, lambda e: F.when(e["a"] != e["b"], azimuth(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"])))


def clip(line, start, end) -> Column:
    """The part of a line between two distances along it; reversed if start > end."""
    lo, hi = F.least(_c(start), _c(end)), F.greatest(_c(start), _c(end))
    inner = F.transform(F.filter(F.filter(segments(line), lambda s: s.isNotNull()), lambda s: (s["start"] > lo) & (s["start"] < hi)), lambda s: s["a"])
    out = F.filter(F.concat(F.array(point_at(line, lo)), inner, F.array(point_at(line, hi))), lambda p: p.isNotNull())
    return F.when(_c(start) > _c(end), F.reverse(out)).otherwise(out)


def bezier(x0, y0, bearing0, x1, y1, bearing1, reach, samples: int | Column = 12, most: float = 15.0, reach1=None) -> Column:
    """Cubic curve that leaves and arrives in these compass bearings, as samples + 1 points.

    Its handles are ``reach`` long (the second one ``reach1``, if given), from 0 to ``most``; 0.45 of
    the ends' distance where it is null.
    """
    span = F.hypot(_c(x1) - _c(x0), _c(y1) - _c(y0))
    held = lambda r: F.least(F.lit(most), F.greatest(F.lit(0.0), span * 0.45 if r is None else F.coalesce(_c(r), span * 0.45)))
    r0, r1 = held(reach), held(reach if reach1 is None else reach1)
    hx0, hy0 = _c(x0) + r0 * F.sin(F.radians(_c(bearing0))), _c(y0) + r0 * F.cos(F.radians(_c(bearing0)))
    hx1, hy1 = _c(x1) - r1 * F.sin(F.radians(_c(bearing1))), _c(y1) - r1 * F.cos(F.radians(_c(bearing1)))
    samples = samples if isinstance(samples, Column) else F.lit(samples)

    def at(k: Column) -> Column:
        t = k / samples.cast("double")
        u = F.lit(1.0) - t
        f = lambda a, b, c, d: u * u * u * a + 3 * u * u * t * b + 3 * u * t * t * c + t * t * t * d
        return F.struct(f(_c(x0), hx0, hx1, _c(x1)).alias("x"), f(_c(y0), hy0, hy1, _c(y1)).alias("y"))

    return F.transform(F.sequence(F.lit(0), samples), at)


def _cut(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether segments a-b and c-d cross within both (ends that touch don't)."""
    side = lambda p, q, r: (q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"])
    return (side(a, b, c) * side(a, b, d) < 0) & (side(c, d, a) * side(c, d, b) < 0)


def crosses(line, other) -> Column:
    """Whether two lines cross: a segment of one and a segment of the other do."""
    line, other = _c(line), _c(other)
    upto = lambda p: F.when(F.size(p) > 1, F.sequence(F.lit(1), F.size(p) - 1)).otherwise(F.array().cast("array<int>"))
    return F.exists(upto(line), lambda i: F.exists(upto(other), lambda j: _cut(F.get(line, i - 1), F.get(line, i), F.get(other, j - 1), F.get(other, j))))


def crosses_itself(line) -> Column:
    """Whether two segments of a line cross that don't follow each other."""
    line = _c(line)
    upto = F.when(F.size(line) > 1, F.sequence(F.lit(1), F.size(line) - 1)).otherwise(F.array().cast("array<int>"))
    return F.exists(upto, lambda i: F.exists(upto, lambda j: (j > i + 1) & _cut(F.get(line, i - 1), F.get(line, i), F.get(line, j - 1), F.get(line, j))))


def interpolated(x, table: list[tuple[float, float]]) -> Column:
    """Piecewise-linear lookup, held to the table's ends."""
    x = _c(x)
    out = F.when(x.isNull(), F.lit(None).cast("double")).when(x <= table[0][0], F.lit(float(table[0][1])))
    for (a, ya), (b, yb) in zip(table, table[1:], strict=False):
        out = out.when(x <= b, F.lit(float(ya)) + (x - a) * ((yb - ya) / (b - a)))
    return out.otherwise(F.lit(float(table[-1][1])))


def smoothed_angle(angles, weight: float = 0.4) -> Column:
    """Exponential mean of an ordered array of bearings along the shortest arcs."""
    a = _c(angles)
    return F.aggregate(F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), F.try_element_at(a, F.lit(1)), lambda acc, x: F.pmod(acc + turn(acc, x) * weight, F.lit(360.0)))


def positions(text, polygon: bool = False) -> Column:
    """Line from a list of latitude-longitude numbers; null unless even and long enough."""
    n = F.transform(F.filter(F.split(F.trim(_c(text)), r"[\s,]+"), lambda x: x != ""), lambda x: x.try_cast("double"))
    ok = (F.size(n) % 2 == 0) & (F.size(n) >= (6 if polygon else 4)) & ~F.exists(n, lambda x: x.isNull())
    return F.when(ok, F.transform(F.sequence(F.lit(0), (F.size(n) / 2).cast("int") - 1), lambda i: F.struct(F.get(n, i * 2 + 1).alias("x"), F.get(n, i * 2).alias("y"))))


def box_around(lon, lat, metres) -> tuple[Column, Column, Column, Column]:
    """min lon, min lat, max lon, max lat of the square of this half-width."""
    dx, dy = _c(metres) / (M_LON * F.cos(F.radians(_c(lat)))), _c(metres) / M_LAT
    return _c(lon) - dx, _c(lat) - dy, _c(lon) + dx, _c(lat) + dy


def forward_box(lon, lat, heading, ahead: float = 2500.0, behind: float = 700.0, side: float = 700.0) -> tuple[Column, Column, Column, Column]:
    """The box around a rectangle that reaches further ahead than behind and aside, six decimals; without a heading ``ahead`` counts all around."""
    east_m = M_LON * F.coalesce(F.nullif(F.cos(F.radians(_c(lat))), F.lit(0.0)), F.lit(1.0))
    sin, cos = F.sin(F.radians(_c(heading))), F.cos(F.radians(_c(heading)))
    corners = [(along, cross) for along in (-behind, ahead) for cross in (-side, side)]
    east, north = [a * sin + c * cos for a, c in corners], [a * cos - c * sin for a, c in corners]
    reach = lambda pick, metres, around: F.when(_c(heading).isNull(), F.lit(around)).otherwise(pick(*metres))
    place = lambda at, metres, scale: F.round(_c(at) + metres / scale, 6)
    low = place(lon, reach(F.least, east, -ahead), east_m), place(lat, reach(F.least, north, -ahead), F.lit(M_LON))
    return *low, place(lon, reach(F.greatest, east, ahead), east_m), place(lat, reach(F.greatest, north, ahead), F.lit(M_LON))


def padded_box(box: tuple[float, float, float, float], share: float = 0.75, least: tuple[float, float] = (0.015, 0.010)) -> tuple[float, float, float, float]:
    """A viewport wider by this share of its size on every side, by at least so many degrees, six decimals."""
    x, y = max((box[2] - box[0]) * share, least[0]), max((box[3] - box[1]) * share, least[1])
    return round(box[0] - x, 6), round(box[1] - y, 6), round(box[2] + x, 6), round(box[3] + y, 6)


def parse_bbox(text: str, most: float = 25.0) -> tuple[float, float, float, float]:
    """min lon, min lat, max lon, max lat of a request; raises where it makes no sense."""
    try:
        a, b, c, d = map(float, text.split(","))
    except ValueError:
        raise ValueError("bbox takes four numbers: min lon, min lat, max lon, max lat") from None
    if not all(map(math.isfinite, (a, b, c, d))) or a >= c or b >= d:
        raise ValueError("bbox is empty or not finite")
    if (c - a) * (d - b) > most:
        raise ValueError(f"bbox covers over {most:g} square degrees")
    return a, b, c, d


def point_in_box(lon, lat, box: tuple[float, float, float, float]) -> Column:
    return _c(lon).between(box[0], box[2]) & _c(lat).between(box[1], box[3])


def segment_in_box(ax, ay, bx, by, box: tuple[float, float, float, float]) -> Column:
    """Whether a segment meets a box (borders count): no side of the box and not the segment's own
    line has both on different sides."""
    ax, ay, bx, by = _c(ax), _c(ay), _c(bx), _c(by)
    overlap = (F.least(ax, bx) <= box[2]) & (F.greatest(ax, bx) >= box[0]) & (F.least(ay, by) <= box[3]) & (F.greatest(ay, by) >= box[1])
    corners = [(bx - ax) * (F.lit(y) - ay) - (by - ay) * (F.lit(x) - ax) for x in (box[0], box[2]) for y in (box[1], box[3])]
    return overlap & (F.least(*corners) <= 0) & (F.greatest(*corners) >= 0)


def line_in_box(line, box: tuple[float, float, float, float]) -> Column:
    return F.exists(F.filter(segments(line), lambda s: s.isNotNull()), lambda s: segment_in_box(s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"], box))


def polygon_in_box(ring, box: tuple[float, float, float, float]) -> Column:
    """Whether a polygon without holes meets a box (borders count): an edge does, or the box lies within it.

    ``ring`` may repeat its first point at the end or not. Null where the ring is null.
    """
    ring = _c(ring)
    closed, (x, y) = F.concat(ring, F.slice(ring, 1, 1)), box[:2]
    right_of = lambda s: F.when((s["a"]["y"] > y) != (s["b"]["y"] > y), s["a"]["x"] + (y - s["a"]["y"]) * (s["b"]["x"] - s["a"]["x"]) / (s["b"]["y"] - s["a"]["y"]) > x)
    crossed = F.size(F.filter(F.filter(segments(closed), lambda s: s.isNotNull()), lambda s: F.coalesce(right_of(s), F.lit(False))))
    return line_in_box(closed, box) | (crossed % 2 == 1)


def _unit(dx: Column, dy: Column) -> tuple[Column, Column]:
    n = F.nullif(F.hypot(dx, dy), F.lit(0.0))
    return dx / n, dy / n


def lateral_shift(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Metres between the end of a-b and the start of c-d, square to their mean direction; null where there is none."""
    (ux, uy), (vx, vy) = _unit(_c(bx) - _c(ax), _c(by) - _c(ay)), _unit(_c(dx) - _c(cx), _c(dy) - _c(cy))
    tx, ty = _unit(ux + vx, uy + vy)
    return F.abs((_c(cx) - _c(bx)) * ty - (_c(cy) - _c(by)) * tx)
