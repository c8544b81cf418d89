"""Planar and geodetic column arithmetic: no geometry library, no Python in the row path."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POINT_TYPE = "struct<x:double,y:double>"


def lit(v) -> Column:
    return F.lit(float(v))


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def segment_position(px, py, x0, y0, x1, y1) -> Column:
    """Share 0..1 along the segment of the point nearest to (px, py)."""
    dx, dy = x1 - x0, y1 - y0
    sq = dx * dx + dy * dy
    t = F.try_divide((px - x0) * dx + (py - y0) * dy, sq)
    return F.coalesce(F.greatest(lit(0), F.least(lit(1), t)), lit(0))


def point_segment_distance(px, py, x0, y0, x1, y1) -> Column:
    t = segment_position(px, py, x0, y0, x1, y1)
    return distance(px, py, x0 + t * (x1 - x0), y0 + t * (y1 - y0))


def crossing(a0x, a0y, a1x, a1y, b0x, b0y, b1x, b1y) -> tuple[Column, Column]:
    """Shares along a and b where their carrier lines meet; NULL when parallel."""
    ux, uy, vx, vy = a1x - a0x, a1y - a0y, b1x - b0x, b1y - b0y
    cx, cy = b0x - a0x, b0y - a0y
    den = ux * vy - uy * vx
    return F.try_divide(cx * vy - cy * vx, den), F.try_divide(cx * uy - cy * ux, den)


def segments_meet(*c) -> Column:
    t, u = crossing(*c)
    return F.coalesce((t >= 0) & (t <= 1) & (u >= 0) & (u <= 1), F.lit(False))


def segment_distance(a0x, a0y, a1x, a1y, b0x, b0y, b1x, b1y) -> Column:
    # No branch leaves the distances out, so parts that they share are computed once.
    return F.least(
        point_segment_distance(a0x, a0y, b0x, b0y, b1x, b1y),
        point_segment_distance(a1x, a1y, b0x, b0y, b1x, b1y),
        point_segment_distance(b0x, b0y, a0x, a0y, a1x, a1y),
        point_segment_distance(b1x, b1y, a0x, a0y, a1x, a1y),
        F.when(segments_meet(a0x, a0y, a1x, a1y, b0x, b0y, b1x, b1y), 0.0))


def ray_hits(px, py, x0, y0, x1, y1) -> Column:
    """1 when the ray from (px, py) to +x passes the segment: an odd total means inside."""
    straddles = (y0 > py) != (y1 > py)
    # The divisor is never zero where the straddle test holds.
    at = x0 + F.try_divide((py - y0) * (x1 - x0), y1 - y0)
    return F.coalesce((straddles & (px < at)).cast("int"), F.lit(0))


def bearing(x0, y0, x1, y1) -> Column:
    return F.atan2(y1 - y0, x1 - x0)


def turn_angle(first: Column, second: Column) -> Column:
    """Change of heading, 0..pi."""
    return F.acos(F.greatest(lit(-1), F.least(lit(1), F.cos(first - second))))


def joint_angle(heading: Column, axis: Column) -> Column:
    """Angle to an axis that has no direction, 0..pi/2."""
    return F.acos(F.least(lit(1), F.abs(F.cos(heading - axis))))


# Equivalent metres per kind of turn, and the extra for a near miss.
TURN_90, TURN_45, TURN_135, NEAR_EXTRA = 25.0, 50.0, 75.0, 10.0
TURN_TOLERANCE = 1e-5


TURN_NEAR = math.radians(4)
EIGHTH = math.pi / 4


def turn_penalty(angle: Column) -> Column:
    """Metres for a turn: by its nearest eighth of a circle, and by how far it misses that.

    A clean eighth costs its own metres, going straight on nothing; a near miss costs some more,
    and one of going straight on as much as that of a right angle. Everything else, turning back
    included, costs two clean turns of 45 degrees.
    """
    eighths = F.rint(angle / EIGHTH)
    miss = F.abs(angle - eighths * EIGHTH)
    metres = F.get(F.array(*[F.lit(m) for m in (TURN_90, TURN_45, TURN_90, TURN_135)]), eighths.cast("int"))
    clean = F.when(eighths == 0, 0.0).otherwise(metres)
    judged = F.when(miss < TURN_TOLERANCE, clean).when(miss < TURN_NEAR, metres + NEAR_EXTRA)
    return F.when(angle.isNotNull(), F.coalesce(judged, F.lit(2 * TURN_45)))


def turn_kind(angle: Column) -> Column:
    """45, 90, 135, other, or NULL when there is no turn."""
    def about(target):
        return F.abs(angle - target) < TURN_TOLERANCE
    return (F.when(angle < TURN_TOLERANCE, F.lit(None).cast("string"))
            .when(about(math.pi / 2), "90").when(about(math.pi / 4), "45")
            .when(about(3 * math.pi / 4), "135").otherwise("other"))


def frame_difference(a: Column, b: Column, period: float = math.pi / 2) -> Column:
    """Difference of two axes modulo a period, folded to at most half of it."""
    d = a - b
    d = F.abs(d - period * F.rint(d / period))
    return F.least(d, period - d)


def coordinate_key(x: Column, y: Column) -> Column:
    """Millimetre key; halves go up, as floor(v + 0.5) does."""
    def mm(v):
        return F.floor(v * 1000 + 0.5).cast("string")
    return F.concat_ws(":", mm(x), mm(y))


def in_range(lon: Column, lat: Column) -> Column:
    """Usable geographic coordinates: finite and in the northern band of the projection."""
    finite = lon.isNotNull() & lat.isNotNull() & ~F.isnan(lon) & ~F.isnan(lat)
    return finite & (F.abs(lon) <= 180) & (lat >= 0) & (lat <= 84)


# ---- transverse Mercator, zone 37 north, WGS 84 (Krueger series, sixth order) ----
_A, _F, _K0, _E0, _LON0 = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, math.radians(39)
_N = _F / (2 - _F)
_ECC = math.sqrt(_F * (2 - _F))
RADIUS = _K0 * _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)
# Series coefficients in powers of the third flattening (public closed forms).
_P = [_N**i for i in range(7)]
ALPHA = [
    _P[1]/2 - 2*_P[2]/3 + 5*_P[3]/16 + 41*_P[4]/180 - 127*_P[5]/288 + 7891*_P[6]/37800,
    13*_P[2]/48 - 3*_P[3]/5 + 557*_P[4]/1440 + 281*_P[5]/630 - 1983433*_P[6]/1935360,
    61*_P[3]/240 - 103*_P[4]/140 + 15061*_P[5]/26880 + 167603*_P[6]/181440,
    49561*_P[4]/161280 - 179*_P[5]/168 + 6601661*_P[6]/7257600,
    34729*_P[5]/80640 - 3418889*_P[6]/1995840,
    212378941*_P[6]/319334400,
]
BETA = [
    _P[1]/2 - 2*_P[2]/3 + 37*_P[3]/96 - _P[4]/360 - 81*_P[5]/512 + 96199*_P[6]/604800,
    _P[2]/48 + _P[3]/15 - 437*_P[4]/1440 + 46*_P[5]/105 - 1118711*_P[6]/3870720,
    17*_P[3]/480 - 37*_P[4]/840 - 209*_P[5]/4480 + 5569*_P[6]/90720,
    4397*_P[4]/161280 - 11*_P[5]/504 - 830251*_P[6]/7257600,
    4583*_P[5]/161280 - 108847*_P[6]/3991680,
    20648693*_P[6]/638668800,
]
DELTA = [
    2*_P[1] - 2*_P[2]/3 - 2*_P[3] + 116*_P[4]/45 + 26*_P[5]/45 - 2854*_P[6]/675,
    7*_P[2]/3 - 8*_P[3]/5 - 227*_P[4]/45 + 2704*_P[5]/315 + 2323*_P[6]/945,
    56*_P[3]/15 - 136*_P[4]/35 - 1262*_P[5]/105 + 73814*_P[6]/2835,
    4279*_P[4]/630 - 332*_P[5]/35 - 399572*_P[6]/14175,
    4174*_P[5]/315 - 144838*_P[6]/6237,
    601676*_P[6]/22275,
]


def to_utm(lon: Column, lat: Column) -> tuple[Column, Column]:
    s, lam = F.sin(F.radians(lat)), F.radians(lon) - _LON0
    t = F.sinh(F.atanh(s) - _ECC * F.atanh(_ECC * s))
    xi = F.atan2(t, F.cos(lam))
    eta = F.asinh(F.sin(lam) / F.sqrt(t * t + F.cos(lam) * F.cos(lam)))
    north, east = xi, eta
    for j, a in enumerate(ALPHA, 1):
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    return _E0 + RADIUS * east, RADIUS * north


def from_utm(x: Column, y: Column) -> tuple[Column, Column]:
    xi, eta = y / RADIUS, (x - _E0) / RADIUS
    xi0, eta0 = xi, eta
    for j, b in enumerate(BETA, 1):
        xi0 = xi0 - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta0 = eta0 - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi0) / F.cosh(eta0))
    lat = chi
    for j, d in enumerate(DELTA, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return F.degrees(_LON0 + F.atan2(F.sinh(eta0), F.cos(xi0))), F.degrees(lat)


# ---- vertex arrays of one line: array<struct<x,y>> ----

def path_segments(path: Column) -> Column:
    """Consecutive vertex pairs as array<struct<seq,x0,y0,x1,y1>>; zero-length pairs stay."""
    ends = F.slice(path, 2, F.greatest(F.size(path) - 1, F.lit(0)))
    starts = F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0)))
    return F.transform(
        F.arrays_zip(starts.alias("a"), ends.alias("b")),
        lambda s, i: F.struct(i.alias("seq"), s["a"]["x"].alias("x0"), s["a"]["y"].alias("y0"),
                              s["b"]["x"].alias("x1"), s["b"]["y"].alias("y1")))


def path_length(path: Column) -> Column:
    return F.aggregate(
        path_segments(path), lit(0),
        lambda acc, s: acc + distance(s["x0"], s["y0"], s["x1"], s["y1"]))


def measured_segments(path: Column) -> Column:
    """Segments with start and end measure, built by one left-to-right fold."""
    def step(acc, s):
        end = acc["at"] + distance(s["x0"], s["y0"], s["x1"], s["y1"])
        row = F.struct(s["seq"].alias("seq"), s["x0"].alias("x0"), s["y0"].alias("y0"),
                       s["x1"].alias("x1"), s["y1"].alias("y1"), acc["at"].alias("at0"),
                       end.alias("at1"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(row)).alias("out"))
    empty = F.from_json(F.lit("[]"), "array<struct<seq:int,x0:double,y0:double,x1:double,"
                                     "y1:double,at0:double,at1:double>>")
    return F.aggregate(path_segments(path), F.struct(lit(0).alias("at"), empty.alias("out")),
                       step, lambda acc: acc["out"])


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it by name in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def point_at(path: Column, measure: Column) -> Column:
    """Point of the line at a measure, clamped to its ends."""
    return let(measured_segments(path), lambda segs: let(
        _segment_at(segs, measure), lambda hit: _along(hit, measure)))


def _segment_at(segs: Column, measure: Column) -> Column:
    return F.coalesce(F.get(F.filter(segs, lambda s: (s["at1"] >= measure) & (s["at1"] > s["at0"])),
                           F.lit(0)),
                      F.element_at(segs, -1))


def _along(hit: Column, measure: Column) -> Column:
    share = F.greatest(lit(0), F.least(lit(1), F.coalesce(
        (measure - hit["at0"]) / F.nullif(hit["at1"] - hit["at0"], lit(0)), lit(0))))
    return F.struct((hit["x0"] + share * (hit["x1"] - hit["x0"])).alias("x"),
                    (hit["y0"] + share * (hit["y1"] - hit["y0"])).alias("y"))


def project(path: Column, px: Column, py: Column) -> Column:
    """Measure of the point of the line nearest to (px, py); the first one when several tie."""
    scored = F.transform(measured_segments(path), lambda s: F.struct(
        point_segment_distance(px, py, s["x0"], s["y0"], s["x1"], s["y1"]).alias("d"),
        (s["at0"] + segment_position(px, py, s["x0"], s["y0"], s["x1"], s["y1"])
         * (s["at1"] - s["at0"])).alias("at")))
    return F.array_min(scored)["at"]


def sub_line(path: Column, start: Column, end: Column) -> Column:
    """Vertices of the part of the line between two measures."""
    def build(segs):
        inner = F.transform(F.filter(segs, lambda s: (s["at1"] > start) & (s["at1"] < end)),
                            lambda s: F.struct(s["x1"].alias("x"), s["y1"].alias("y")))
        head = let(_segment_at(segs, start), lambda hit: _along(hit, start))
        tail = let(_segment_at(segs, end), lambda hit: _along(hit, end))
        return F.concat(F.array(head), inner, F.array(tail))
    return let(measured_segments(path), build)


def is_straight(path: Column) -> Column:
    """Every inner vertex lies within 1e-5 m of the chord; a closed chord is not straight."""
    return let(path, _straight)


def offset_across(heading: Column, x: Column, y: Column) -> Column:
    """How far a step (x, y) leads away from the line of a heading."""
    return F.abs(x * F.sin(heading) - y * F.cos(heading))


def _straight(path: Column) -> Column:
    start, end = F.element_at(path, 1), F.element_at(path, -1)
    course = bearing(start["x"], start["y"], end["x"], end["y"])
    strays = F.array_max(F.transform(path, lambda p: offset_across(course, p["x"] - start["x"], p["y"] - start["y"])))
    spread = distance(start["x"], start["y"], end["x"], end["y"])
    return (F.size(path) <= 2) | ((spread >= 1e-8) & (strays <= 1e-5))


def heading_at(path: Column, measure: Column) -> Column:
    """Bearing of the segment that arrives at the measure."""
    usable = F.filter(measured_segments(path), lambda s: s["at1"] - s["at0"] > 1e-8)
    hit = let(usable, lambda segs: F.coalesce(
        F.get(F.filter(segs, lambda s: s["at1"] + 1e-7 >= measure), F.lit(0)),
        F.element_at(segs, -1)))
    return let(hit, lambda h: bearing(h["x0"], h["y0"], h["x1"], h["y1"]))


def path_wkt(path: Column) -> Column:
    body = F.array_join(F.transform(path, lambda p: F.concat_ws(
        " ", p["x"].cast("string"), p["y"].cast("string"))), ", ")
    return F.concat(F.lit("LINESTRING ("), body, F.lit(")"))


def parse_wkt(text: Column) -> Column:
    """LINESTRING text to a vertex array; NULL for anything else or for a non-number."""
    inner = F.regexp_extract(text, r"^\s*LINESTRING\s*(?:Z\s*)?\(([^()]*)\)\s*$", 1)
    pts = F.transform(F.split(inner, ","), lambda p: F.split(F.trim(p), r"\s+"))
    path = F.transform(pts, lambda p: F.struct(
        F.get(p, F.lit(0)).try_cast("double").alias("x"),
        F.get(p, F.lit(1)).try_cast("double").alias("y")))
    good = F.forall(path, lambda p: p["x"].isNotNull() & p["y"].isNotNull()
                    & (F.abs(p["x"]) < float("inf")) & (F.abs(p["y"]) < float("inf")))
    return F.when((inner != "") & good & (F.size(path) >= 2), path)


def explode_segments(df: DataFrame, path: str = "path", keep: list[str] | None = None) -> DataFrame:
    """One row per segment of each line, with measures and the segment's own box."""
    cols = keep if keep is not None else [c for c in df.columns if c != path]
    out = df.select(*cols, F.explode(measured_segments(F.col(path))).alias("_s")).select(
        *cols, "_s.*")
    return with_box(out)


def with_box(df: DataFrame) -> DataFrame:
    return df.select("*", F.least("x0", "x1").alias("minx"), F.least("y0", "y1").alias("miny"),
                     F.greatest("x0", "x1").alias("maxx"), F.greatest("y0", "y1").alias("maxy"))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``value`` as a column that is computed once for each row, whatever is filtered by it later.

    A filter on a plain column moves below it, into the join underneath: the value is then computed for the
    filter, without sharing its parts, and again for the result. It does not move below a generated column.
    """
    return df.withColumn("_once", value).select("*", F.explode(F.array("_once")).alias(name)).drop("_once")
