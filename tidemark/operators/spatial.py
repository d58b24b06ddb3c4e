"""Zones, land and cells: theta joins of points and legs with small geometry tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.geodesy import EARTH_RADIUS_NM, angle_between, c, cross, dot, norm

from .interpolation import small

def active_zones(rows: DataFrame, zones: DataFrame, at: str = "ts") -> DataFrame:
    """Pairs of rows and zones active at the row's time: [active_from, active_until), open where null."""
    z = small(zones)
    ok = (F.coalesce(F.col("active_from") <= F.col(at), F.lit(True))) & (F.coalesce(F.col(at) < F.col("active_until"), F.lit(True)))
    return rows.join(z, ok)


def in_ring(v: Column, ring: Column) -> Column:
    """Whether a unit vector is inside a ring (array of unit vectors), by the angles it sees the edges under.

    Even and odd turns decide, so a ring that crosses itself has holes. The vector must not be opposite to the ring.
    """
    n = F.size(ring)

    def seen(i):
        a, b = F.get(ring, i), F.get(ring, F.pmod(i + 1, n))
        na, nb = cross(v, a), cross(v, b)
        return F.atan2(dot(v, cross(na, nb)), dot(na, nb))

    turned = F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), seen), F.lit(0.0), lambda s, x: s + x)
    return F.pmod(F.round(F.abs(turned) / 6.283185307179586), F.lit(2)) == 1


#: Arcs and vectors closer than this are taken for one (radians).
COINCIDENT = 1e-12


def distance_to_arc(v: Column, a: Column, b: Column) -> Column:
    """Radians from a unit vector to the arc between two others."""
    n = cross(a, b)
    within = (norm(n) > COINCIDENT) & (dot(cross(n, a), v) >= 0) & (dot(cross(b, n), v) >= 0)
    off = F.abs(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(n, v) / norm(n)))))
    return F.when(within, off).otherwise(F.least(angle_between(v, a), angle_between(v, b)))


def certified(distance_a, distance_b, leg_nm, required) -> Column:
    """Whether the signed land distances at both ends prove a whole leg clear: distance changes by at most the way gone."""
    return (c(distance_a) + c(distance_b) - c(leg_nm)) / 2 >= c(required)


def nearest_cell(rows: DataFrame, key: str, cells: DataFrame, v: str = "v") -> DataFrame:
    """(key, cell): the cell (cell, x) of largest dot product; lowest number among equals.

    cells: a bounded table of directions; rows of any number.
    """
    j = rows.select(key, v).join(small(cells), F.lit(True))
    return j.groupBy(key).agg(F.min_by("cell", F.struct((-F.round(dot(F.col(v), F.col("x")), 12)).alias("d"), F.col("cell"))).alias("cell"))


def containing_face(rows: DataFrame, key: str, faces: DataFrame, v: str = "v", slack: float = 1e-12) -> DataFrame:
    """(key, face): the first face (face, a, b, c unit vectors, counter-clockwise) that holds the point."""
    side = lambda p, q: dot(cross(F.col(p), F.col(q)), F.col(v)) >= -slack
    j = rows.select(key, v).join(small(faces), side("a", "b") & side("b", "c") & side("c", "a"))
    return j.groupBy(key).agg(F.min("face").alias("face"))


def distance_to_path(rows: DataFrame, key: str, segments: DataFrame, v: str = "v") -> DataFrame:
    """(key, radians): least angle from each point to the arcs (a, b unit vectors)."""
    d = distance_to_arc(F.col(v), F.col("a"), F.col("b"))
    return rows.select(key, v).join(small(segments), F.lit(True)).groupBy(key).agg(F.min(d).alias("radians"))


def corridor_faces(faces: DataFrame, route: DataFrame, width_nm, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """The faces (keys..., face, a, b, c unit vectors) that come within a width of the route (keys..., arcs a, b) of their keys: by centre and radius of each."""
    total = F.zip_with(F.zip_with("a", "b", lambda x, y: x + y), "c", lambda x, y: x + y)
    f = faces.withColumn("_t", total).withColumn("_m", F.transform("_t", lambda x: x / norm(F.col("_t")))).drop("_t")
    f = f.withColumn("_r", F.greatest(*(angle_between(F.col("_m"), F.col(x)) for x in "abc")))
    arcs = route.select(*keys, F.col("a").alias("_p"), F.col("b").alias("_q"))
    seen = f.select(*keys, "face", "_m").join(small(arcs), keys if keys else F.lit(True))
    near = seen.groupBy(*keys, "face").agg(F.min(distance_to_arc(F.col("_m"), F.col("_p"), F.col("_q"))).alias("radians"))
    return f.join(near, [*keys, "face"]).where(F.col("radians") <= c(width_nm) / EARTH_RADIUS_NM + F.col("_r")).drop("_m", "_r", "radians")


def planar_points(points: DataFrame, keys: list[str]) -> DataFrame:
    """points (keys..., lat, lon) with x, y in nautical miles around each group's mean latitude and circular mean longitude.

    Places that are equal once longitudes are canonical (both names of the antimeridian are one) count once.
    """
    lon = F.when(F.col("lon") == -180, 180.0).otherwise(F.col("lon"))
    p = points.withColumn("lon", lon).dropDuplicates([*keys, "lat", "lon"])
    rad = F.radians(lon)
    s, k = F.sum(F.sin(rad)), F.sum(F.cos(rad))
    none = (F.abs(s) <= 1e-12) & (F.abs(k) <= 1e-12)
    middle = points.groupBy(*keys).agg(F.avg("lat").alias("_lat0"), F.when(none, F.min(lon)).otherwise(F.degrees(F.atan2(s, k))).alias("_lon0"))
    j = p.join(middle, keys)
    delta = F.pmod(F.col("lon") - F.col("_lon0") + 180.0, F.lit(360.0)) - 180.0
    return j.withColumns({"x": delta * 60.0 * F.cos(F.radians("_lat0")), "y": (F.col("lat") - F.col("_lat0")) * 60.0}).drop("_lat0", "_lon0")


def circumradius(ax, ay, bx, by, cx, cy) -> Column:
    """Radius of the circle through three points of a plane; null where they are on a line."""
    side = lambda x1, y1, x2, y2: F.sqrt(F.pow(c(x1) - c(x2), 2) + F.pow(c(y1) - c(y2), 2))
    area = F.abs((c(bx) - c(ax)) * (c(cy) - c(ay)) - (c(cx) - c(ax)) * (c(by) - c(ay))) / 2
    return F.when(area > 0, side(ax, ay, bx, by) * side(bx, by, cx, cy) * side(cx, cy, ax, ay) / (4 * area))


def automatic_alpha(triangles: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., alpha): 1.05 times the median circumradius of triangles (ax, ay, bx, by, cx, cy)."""
    r = triangles.withColumn("_r", circumradius("ax", "ay", "bx", "by", "cx", "cy"))
    return r.where("_r > 0").groupBy(*keys).agg((1.05 * F.median("_r")).alias("alpha"))
