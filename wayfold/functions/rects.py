"""Latitude-longitude rectangles as Column expressions, in degrees.

A rectangle is a struct (lat_lo, lat_hi, lng_lo, lng_hi), closed. With lng_lo > lng_hi it crosses the antimeridian. The empty
rectangle is null. Longitudes are taken as arcs (start, width): all operations follow from offsets along the circle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfold.functions.geo import EARTH_M

FULL_WIDTH = 360.0


def _offset(lng: Column, start: Column) -> Column:
    """How far east of ``start``, from 0 to below 360 degrees."""
    return F.pmod(lng - start, F.lit(FULL_WIDTH))


def _wrapped(lng: Column) -> Column:
    """In [-180, 180]."""
    return F.when(lng.between(-180, 180), lng).otherwise(F.pmod(lng + 180, F.lit(FULL_WIDTH)) - 180)


def rect(lat_lo: Column, lat_hi: Column, lng_lo: Column, lng_hi: Column) -> Column:
    """A rectangle; null (empty) if the latitudes are in the wrong order."""
    made = F.struct(lat_lo.cast("double").alias("lat_lo"), lat_hi.cast("double").alias("lat_hi"), lng_lo.cast("double").alias("lng_lo"), lng_hi.cast("double").alias("lng_hi"))
    return F.when(lat_lo <= lat_hi, made)


def width(r: Column) -> Column:
    """Width in longitude, 0 to 360 degrees."""
    return F.when(r["lng_lo"] <= r["lng_hi"], r["lng_hi"] - r["lng_lo"]).otherwise(r["lng_hi"] - r["lng_lo"] + FULL_WIDTH)


def _arc(start: Column, wide: Column) -> tuple[Column, Column]:
    """Ends of the arc of a start and a width; 360 degrees or more are the whole circle."""
    whole = wide >= FULL_WIDTH
    return F.when(whole, -180.0).otherwise(_wrapped(start)), F.when(whole, 180.0).otherwise(_wrapped(start + wide))


def _lng_has(r: Column, lng: Column) -> Column:
    return (_offset(lng, r["lng_lo"]) <= width(r)) | (width(r) >= FULL_WIDTH)


def contains(r: Column, lat: Column, lng: Column) -> Column:
    return lat.between(r["lat_lo"], r["lat_hi"]) & _lng_has(r, lng)


def contains_rect(a: Column, b: Column) -> Column:
    inside = (_offset(b["lng_lo"], a["lng_lo"]) + width(b) <= width(a)) | (width(a) >= FULL_WIDTH)
    return (a["lat_lo"] <= b["lat_lo"]) & (b["lat_hi"] <= a["lat_hi"]) & inside


def intersects(a: Column, b: Column) -> Column:
    return (a["lat_lo"] <= b["lat_hi"]) & (b["lat_lo"] <= a["lat_hi"]) & (_lng_has(a, b["lng_lo"]) | _lng_has(b, a["lng_lo"]))


def from_point_pair(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """The least rectangle of two points: the shorter way round (eastward from the first where both are as long)."""
    east = _offset(lng2, lng1) <= FULL_WIDTH / 2
    return rect(F.least(lat1, lat2), F.greatest(lat1, lat2), F.when(east, lng1).otherwise(lng2), F.when(east, lng2).otherwise(lng1))


def add_point(r: Column, lat: Column, lng: Column) -> Column:
    """The least rectangle that holds ``r`` and a point; of an empty one the point."""
    ahead, back = _offset(lng, r["lng_lo"]) - width(r), _offset(r["lng_lo"], lng)
    inside = _lng_has(r, lng)
    lo = F.when(~inside & (back < ahead), lng).otherwise(r["lng_lo"])
    hi = F.when(~inside & (back >= ahead), lng).otherwise(r["lng_hi"])
    return F.when(r.isNull(), rect(lat, lat, lng, lng)).otherwise(rect(F.least(r["lat_lo"], lat), F.greatest(r["lat_hi"], lat), lo, hi))


def expanded(r: Column, lat_margin, lng_margin) -> Column:
    """Grown (or, with negative margins, shrunk) on all sides; what would pass a pole ends there."""
    a, b = (x if isinstance(x, Column) else F.lit(float(x)) for x in (lat_margin, lng_margin))
    lo, hi = _arc(r["lng_lo"] - b, width(r) + 2 * b)
    grown = rect(F.greatest(r["lat_lo"] - a, F.lit(-90.0)), F.least(r["lat_hi"] + a, F.lit(90.0)), lo, hi)
    return F.when((width(r) + 2 * b >= 0) & r.isNotNull(), grown)


def expanded_by_distance(r: Column, metres) -> Column:
    """Holds all points within ``metres`` of ``r``; around a pole all longitudes."""
    reach = (metres if isinstance(metres, Column) else F.lit(float(metres))) / EARTH_M
    lo, hi = r["lat_lo"] - F.degrees(reach), r["lat_hi"] + F.degrees(reach)
    # the meridian circle that a cap of this radius touches lies furthest at the latitude nearest to a pole
    far = F.greatest(F.abs(r["lat_lo"]), F.abs(r["lat_hi"]))
    side = F.degrees(F.asin(F.least(F.lit(1.0), F.sin(reach) / F.cos(F.radians(far)))))
    west, east = _arc(r["lng_lo"] - side, width(r) + 2 * side)
    polar = (lo <= -90) | (hi >= 90)
    return F.when(r.isNotNull(), rect(F.greatest(lo, F.lit(-90.0)), F.least(hi, F.lit(90.0)), F.when(polar, -180.0).otherwise(west), F.when(polar, 180.0).otherwise(east)))


def union(a: Column, b: Column) -> Column:
    """The least rectangle that holds both; arcs that don't meet are joined over the smaller gap (the one east of ``a`` where
    both are as wide)."""
    wa, wb = width(a), width(b)
    ab, ba = _offset(b["lng_lo"], a["lng_lo"]), _offset(a["lng_lo"], b["lng_lo"])  # from one start to the other
    from_a, from_b = F.greatest(wa, ab + wb), F.greatest(wb, ba + wa)
    takes_a = F.when(ab <= wa, True).when(ba <= wb, False).otherwise(ab - wa <= ba - wb)
    both = (ab <= wa) & (ba <= wb) & (ab > 0)  # each begins in the other: together the whole circle
    lo_a, hi_a = _arc(a["lng_lo"], from_a)
    lo_b, hi_b = _arc(b["lng_lo"], from_b)
    lo, hi = F.when(both, -180.0).when(takes_a, lo_a).otherwise(lo_b), F.when(both, 180.0).when(takes_a, hi_a).otherwise(hi_b)
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(rect(F.least(a["lat_lo"], b["lat_lo"]), F.greatest(a["lat_hi"], b["lat_hi"]), lo, hi))


def intersection(a: Column, b: Column) -> Column:
    """The rectangle that both share, null if none; where they share two arcs, the narrower of the two rectangles' arcs."""
    wa, wb = width(a), width(b)
    ab, ba = _offset(b["lng_lo"], a["lng_lo"]), _offset(a["lng_lo"], b["lng_lo"])
    b_in_a, a_in_b = (ab <= wa) | (wa >= FULL_WIDTH), (ba <= wb) | (wb >= FULL_WIDTH)
    two = b_in_a & a_in_b & (ab > 0) & (wa < FULL_WIDTH) & (wb < FULL_WIDTH)
    start = F.when(two, F.when(wb < wa, b["lng_lo"]).otherwise(a["lng_lo"])).when(b_in_a, b["lng_lo"]).otherwise(a["lng_lo"])
    end_b = F.when(wa >= FULL_WIDTH, wb).otherwise(F.least(wb, wa - ab))
    wide = F.when(two, F.least(wa, wb)).when(b_in_a, end_b).otherwise(F.when(wb >= FULL_WIDTH, wa).otherwise(F.least(wa, wb - ba)))
    lo, hi = _arc(start, wide)
    return F.when(intersects(a, b), rect(F.greatest(a["lat_lo"], b["lat_lo"]), F.least(a["lat_hi"], b["lat_hi"]), lo, hi))


def center(r: Column) -> Column:
    return F.struct(((r["lat_lo"] + r["lat_hi"]) / 2).alias("lat"), _wrapped(r["lng_lo"] + width(r) / 2).alias("lng"))


def _to_meridian(lat: Column, lng: Column, at: Column, lo: Column, hi: Column) -> Column:
    """Distance in radians of a point to the stretch from latitude ``lo`` to ``hi`` of the meridian ``at``: that to the foot of
    the perpendicular where it lies on the stretch, else to the nearer end."""
    phi, turn = F.radians(lat), F.radians(at - lng)
    foot = F.degrees(F.atan2(F.sin(phi), F.cos(phi) * F.cos(turn)))
    aside = F.abs(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.cos(phi) * F.sin(turn)))))

    def apart(end: Column) -> Column:
        e = F.radians(end)
        h = F.pow(F.sin((e - phi) / 2), 2) + F.cos(phi) * F.cos(e) * F.pow(F.sin(turn / 2), 2)
        return 2 * F.asin(F.sqrt(F.least(F.lit(1.0), h)))

    return F.when(foot.between(lo, hi) & (F.cos(turn) > 0), aside).otherwise(F.least(apart(lo), apart(hi)))


def distance_to_point(r: Column, lat: Column, lng: Column) -> Column:
    """Metres from a point to the rectangle, 0 inside."""
    above = F.greatest(r["lat_lo"] - lat, lat - r["lat_hi"], F.lit(0.0))
    aside = F.least(*[_to_meridian(lat, lng, r[side], r["lat_lo"], r["lat_hi"]) for side in ("lng_lo", "lng_hi")])
    return EARTH_M * F.when(_lng_has(r, lng), F.radians(above)).otherwise(aside)


def distance(a: Column, b: Column) -> Column:
    """Metres between two rectangles, 0 where they meet: that of latitudes if they share a longitude, else the least distance of
    a corner of one to the near side of the other."""
    share = _lng_has(a, b["lng_lo"]) | _lng_has(b, a["lng_lo"])
    apart = F.greatest(b["lat_lo"] - a["lat_hi"], a["lat_lo"] - b["lat_hi"], F.lit(0.0))
    east = [("lng_hi", "lng_lo"), ("lng_lo", "lng_hi")]  # a's side, b's side, over either gap
    sides = [_to_meridian(p[k], p[x], q[y], q["lat_lo"], q["lat_hi"]) for s, t in east for p, x, q, y in ((a, s, b, t), (b, t, a, s)) for k in ("lat_lo", "lat_hi")]
    return EARTH_M * F.when(share, F.radians(apart)).otherwise(F.least(*sides))


def is_valid_point(lat: Column, lng: Column) -> Column:
    return lat.between(-90, 90) & lng.between(-180, 180)


def normalized_point(lat: Column, lng: Column) -> Column:
    """Latitude cut to the poles, longitude turned into (-180, 180]."""
    turned = F.pmod(lng, F.lit(FULL_WIDTH))
    return F.struct(F.greatest(F.lit(-90.0), F.least(F.lit(90.0), lat)).alias("lat"), F.when(turned > 180, turned - FULL_WIDTH).otherwise(turned).alias("lng"))
