"""Great-circle geometry as columns. Degrees and nautical miles; null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
EARTH_RADIUS_NM = 3440.065
MPS_TO_KNOTS = 1.9438444924406048


def c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def let(value: Column, body) -> Column:
    """body(value), where value is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def is_valid_position(lat, lon) -> Column:
    """Finite, latitude within 90 and longitude within 180 degrees."""
    lat, lon = c(lat), c(lon)
    return F.coalesce(~F.isnan(lat) & ~F.isnan(lon) & lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def normalize_degrees(x) -> Column:
    """To [0, 360)."""
    return F.pmod(c(x), F.lit(360.0))


def wrap_longitude(x) -> Column:
    """To [-180, 180)."""
    return F.pmod(c(x) + 180.0, F.lit(360.0)) - 180.0


def angular_difference(a, b) -> Column:
    """Smallest angle between two directions, 0 to 180."""
    d = F.pmod(F.abs(c(a) - c(b)), F.lit(360.0))
    return F.least(d, 360.0 - d)


def distance_nm(lat1, lon1, lat2, lon2) -> Column:
    """Haversine distance."""
    p1, p2 = F.radians(c(lat1)), F.radians(c(lat2))
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(c(lon2) - c(lon1)) / 2), 2)
    return 2 * EARTH_RADIUS_NM * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def initial_bearing(lat1, lon1, lat2, lon2) -> Column:
    p1, p2, dl = F.radians(c(lat1)), F.radians(c(lat2)), F.radians(c(lon2) - c(lon1))
    return normalize_degrees(F.degrees(F.atan2(F.sin(dl) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl))))


def destination(lat, lon, bearing, nm) -> Column:
    """struct(lat, lon) reached from a point on a bearing after a distance."""
    p, l, b, d = F.radians(c(lat)), F.radians(c(lon)), F.radians(c(bearing)), c(nm) / EARTH_RADIUS_NM
    s = F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(b)
    to = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s)))
    dl = F.atan2(F.sin(b) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * s)
    return F.struct(F.degrees(to).alias("lat"), wrap_longitude(F.degrees(l + dl)).alias("lon"))


def unit_vector(lat, lon) -> Column:
    """array(x, y, z) on the unit sphere."""
    p, l = F.radians(c(lat)), F.radians(c(lon))
    return F.array(F.cos(p) * F.cos(l), F.cos(p) * F.sin(l), F.sin(p))


def dot(a: Column, b: Column) -> Column:
    return F.get(a, F.lit(0)) * F.get(b, F.lit(0)) + F.get(a, F.lit(1)) * F.get(b, F.lit(1)) + F.get(a, F.lit(2)) * F.get(b, F.lit(2))


def cross(a: Column, b: Column) -> Column:
    at = lambda v, i: F.get(v, F.lit(i))
    return F.array(at(a, 1) * at(b, 2) - at(a, 2) * at(b, 1), at(a, 2) * at(b, 0) - at(a, 0) * at(b, 2), at(a, 0) * at(b, 1) - at(a, 1) * at(b, 0))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def angle_between(a: Column, b: Column) -> Column:
    """Radians, by atan2 of cross and dot."""
    return F.atan2(norm(cross(a, b)), dot(a, b))


def slerp(a: Column, b: Column, t) -> Column:
    """Point at share t of the arc from a to b; a where the ends coincide."""
    w, t = angle_between(a, b), c(t)
    wa, wb = F.sin((1 - t) * w) / F.sin(w), F.sin(t * w) / F.sin(w)
    return F.when(w < 1e-12, a).otherwise(F.zip_with(a, b, lambda x, y: x * wa + y * wb))


def planar_bucket(lat, lon, to_lat, to_lon, size_nm) -> Column:
    """struct(east, north): cell of a local grid around the destination."""
    east = wrap_longitude(c(lon) - c(to_lon)) * 60 * F.cos(F.radians((c(lat) + c(to_lat)) / 2))
    north = (c(lat) - c(to_lat)) * 60
    return F.struct(F.floor(east / c(size_nm)).cast("long").alias("east"), F.floor(north / c(size_nm)).cast("long").alias("north"))


def sector_bucket(lat, lon, to_lat, to_lon, size_nm, sector_degrees) -> Column:
    """struct(sector, ring): bearing sector and range ring seen from the destination."""
    bearing = initial_bearing(to_lat, to_lon, lat, lon)
    ring = distance_nm(lat, lon, to_lat, to_lon) / c(size_nm)
    return F.struct(F.floor(bearing / c(sector_degrees)).cast("long").alias("sector"), F.floor(ring).cast("long").alias("ring"))


def position_key(lat, lon, width_nm) -> Column:
    """array of three numbers: cell of the unit vector scaled to the earth, half away from zero."""
    return F.transform(unit_vector(lat, lon), lambda x: F.round(x * EARTH_RADIUS_NM / c(width_nm)).cast("long"))


def time_bucket(seconds: Column, width: int) -> Column:
    return F.floor(seconds / width).cast("long")


def arrival_fraction(lat, lon, to_lat, to_lon, heading, leg_nm, radius_nm, rounds: int = 60) -> Column:
    """Share of a leg after which it first comes within the radius of the destination; null where it doesn't.

    The closest approach is clamped to the leg; the entry before it is found by bisection.
    """
    start = distance_nm(lat, lon, to_lat, to_lon)
    leg, radius = c(leg_nm), c(radius_nm)
    s, d = start / EARTH_RADIUS_NM, leg / EARTH_RADIUS_NM
    off = F.radians(initial_bearing(lat, lon, to_lat, to_lon) - c(heading))
    along = F.atan2(F.sin(s) * F.cos(off), F.cos(s))
    near = F.greatest(F.lit(0.0), F.least(along, d)) / d

    def gap(share):
        to = destination(lat, lon, heading, leg * share)
        return let(to, lambda p: distance_nm(p["lat"], p["lon"], to_lat, to_lon))

    def halve(state, _):
        mid = (state["out"] + state["in"]) / 2
        kept = lambda hit: F.struct(F.when(hit, state["out"]).otherwise(mid).alias("out"), F.when(hit, mid).otherwise(state["in"]).alias("in"))
        return let(gap(mid) <= radius, kept)

    found = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(F.lit(0.0).alias("out"), near.alias("in")), halve)["in"]
    reach = (leg > 0) & (start - leg <= radius + 1e-6)
    return F.when(start <= radius, 0.0).when(reach & (gap(near) <= radius), found)
