"""Exclusion zones: checked and prepared once, then joined with points and legs.

Zones are rows (zone_id, revision, active_from, active_until) with either `polygons`, an
array of struct(outer ring, holes array of rings) of struct(lat, lon), or `ring`, an array
of unit vectors. A zone is active in [active_from, active_until), open where null. The
join by time and bounding cap is Spark's; what it leaves is settled for all rows of a zone at once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.geodesy import angle_between, dot, norm, slerp, unit_vector

from .interpolation import small
from .shared import Steps

#: Contact with a boundary (radians), least mean of a ring's vertices, and how far from a hemisphere a ring must stay.
TOUCH, LEAST_CENTROID, MARGIN = 3e-9, 1e-6, 0.05
COINCIDENT = 1e-12
OUTSIDE, BOUNDARY, INSIDE = 0, 1, 2

_PREPARED = "zone_id string, revision long, active_from timestamp, active_until timestamp, outer array<array<double>>, holes array<array<array<double>>>, cap_x array<double>, cap_radius double, fault string"


def _angle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arctan2(np.linalg.norm(np.cross(a, b), axis=-1), (a * b).sum(-1))


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=-1, keepdims=True)


def _vectors(places) -> np.ndarray:
    """Unit vectors of (lat, lon) pairs in degrees."""
    lat, lon = np.radians(np.array(places, float).reshape(-1, 2)).T
    return np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], 1)


def arc_distance(v: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Radians from a point to each of the arcs a, b."""
    n = np.cross(a, b)
    size = np.linalg.norm(n, axis=-1)
    within = (size > COINCIDENT) & ((np.cross(n, a) * v).sum(-1) >= 0) & ((np.cross(b, n) * v).sum(-1) >= 0)
    off = np.abs(np.arcsin(np.clip((n * v).sum(-1) / np.maximum(size, COINCIDENT), -1, 1)))
    return np.where(within, off, np.minimum(_angle(a, v), _angle(b, v)))


def contacts_of_legs(s: np.ndarray, e: np.ndarray, a: np.ndarray, b: np.ndarray, slack: float = 1e-12) -> tuple[np.ndarray, np.ndarray]:
    """(leg, point) of all points that the arcs s, e share with the arcs a, b: crossings, or the ends that lie within where both follow one great circle."""
    n, m = np.cross(s, e), np.cross(a, b)
    real = np.linalg.norm(m, axis=-1) > COINCIDENT
    a, b, m = a[real], b[real], m[real]
    moves = np.linalg.norm(n, axis=-1) > COINCIDENT
    line = np.cross(n[:, None], m[None])
    size = np.linalg.norm(line, axis=-1)
    same = (size <= COINCIDENT) & moves[:, None]
    apart = (size > COINCIDENT) & moves[:, None]
    legs, points = [], []

    def add(leg: np.ndarray, point: np.ndarray) -> None:
        legs.append(leg)
        points.append(point)

    k, j = np.nonzero(apart)
    for sign in (1, -1):
        p = sign * line[k, j] / size[k, j][:, None]
        on = (arc_distance(p, s[k], e[k]) <= slack) & (arc_distance(p, a[j], b[j]) <= slack)
        add(k[on], p[on])
    k, j = np.nonzero(same)
    for end in (a, b):
        on = arc_distance(end[j], s[k], e[k]) <= slack
        add(k[on], end[j][on])
    for end in (s, e):
        on = np.unique(k[arc_distance(end[k], a[j], b[j]) <= slack])
        add(on, end[on])
    return np.concatenate(legs), np.concatenate(points)


def arc_contacts(s: np.ndarray, e: np.ndarray, a: np.ndarray, b: np.ndarray, slack: float = 1e-12) -> np.ndarray:
    """The points of contacts_of_legs for one arc."""
    return contacts_of_legs(s[None], e[None], a, b, slack)[1]


def ring_classes(ring: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The class of each point, by the angles it sees the edges under; even and odd turns decide, so a ring that crosses itself has holes."""
    a, b, p = ring, np.roll(ring, -1, 0), v[:, None, :]
    touches = (arc_distance(p, a, b) <= TOUCH).any(1)
    na, nb = np.cross(p, a), np.cross(p, b)
    turned = np.arctan2((np.cross(na, nb) * p).sum(-1), (na * nb).sum(-1)).sum(1)
    inside = (np.round(np.abs(turned) / (2 * np.pi)) % 2 == 1) & (v @ ring.sum(0) > 0)  # a ring stays within a hemisphere
    return np.where(touches, BOUNDARY, np.where(inside, INSIDE, OUTSIDE))


def ring_class(ring: np.ndarray, v: np.ndarray) -> int:
    return int(ring_classes(ring, v[None])[0])


def polygon_classes(outer: np.ndarray, holes: list[np.ndarray], v: np.ndarray) -> np.ndarray:
    kind = ring_classes(outer, v)
    for hole in holes:
        at = np.flatnonzero(kind == INSIDE)
        in_hole = ring_classes(hole, v[at])
        kind[at] = np.where(in_hole == OUTSIDE, INSIDE, np.where(in_hole == BOUNDARY, BOUNDARY, OUTSIDE))
    return kind


def legs_violate(outer: np.ndarray, holes: list[np.ndarray], s: np.ndarray, e: np.ndarray, open_end: np.ndarray, boundary_excluded: bool) -> np.ndarray:
    """Which of the arcs s, e meet a polygon. open_end: an arc's end does not count."""
    rings = [outer, *holes]
    leg, point = contacts_of_legs(s, e, np.concatenate(rings), np.concatenate([np.roll(r, -1, 0) for r in rings]))
    whole = _angle(s, e)
    long = np.where(whole > 0, whole, 1.0)
    along = np.where(whole[leg] > 0, np.clip(_angle(s[leg], point) / long[leg], 0, 1), 0.0)
    counts = ~open_end[leg] | (along < 1 - 1e-14)
    leg, along = leg[counts], along[counts]
    first, last = polygon_classes(outer, holes, s), np.where(open_end, OUTSIDE, polygon_classes(outer, holes, e))
    met = (first == INSIDE) | (last == INSIDE)
    if boundary_excluded:
        met |= (first == BOUNDARY) | (last == BOUNDARY)
        met[leg] = True
    # between two contacts an arc is all inside or all outside
    left = np.flatnonzero(~met & np.isin(np.arange(len(s)), leg) & (whole > 0))
    cut = np.isin(leg, left)
    leg, along = np.concatenate([leg[cut], left, left]), np.concatenate([along[cut], np.zeros(len(left)), np.ones(len(left))])
    order = np.lexsort((along, leg))
    leg, along = leg[order], along[order]
    pair = (leg[1:] == leg[:-1]) & (along[1:] > along[:-1])
    k, t = leg[1:][pair], ((along[1:] + along[:-1]) / 2)[pair]
    w = whole[k]
    middle = (np.sin((1 - t) * w)[:, None] * s[k] + np.sin(t * w)[:, None] * e[k]) / np.sin(w)[:, None]
    met[k[polygon_classes(outer, holes, middle) == INSIDE]] = True
    return met


def _ring(units: np.ndarray) -> np.ndarray:
    """Without vertices that repeat the one before."""
    kept: list[np.ndarray] = []
    for v in units:
        if not kept or _angle(kept[-1], v) > TOUCH:
            kept.append(v)
    while len(kept) > 1 and _angle(kept[0], kept[-1]) <= TOUCH:
        kept.pop()
    return np.array(kept).reshape(-1, 3)


def _cap(ring: np.ndarray) -> tuple[np.ndarray, float]:
    """A cap that holds a ring, edges included."""
    centre = _unit(ring.sum(0))
    return centre, float(_angle(centre, ring).max() + _angle(ring, np.roll(ring, -1, 0)).max() / 2)


def _ring_fault(places, ring: np.ndarray) -> str | None:
    p = np.array(places, float).reshape(-1, 2)
    if not (np.isfinite(p).all() and (np.abs(p[:, 0]) <= 90).all() and (np.abs(p[:, 1]) <= 180).all()):
        return "a coordinate is out of bounds"
    if len(ring) < 3:
        return "fewer than three distinct vertices"
    if np.linalg.norm(ring.sum(0)) < LEAST_CENTROID * len(ring):
        return "the vertices average to the centre"
    return "not within a hemisphere" if _cap(ring)[1] >= np.pi / 2 - MARGIN else None


def _prepare(frames):
    """One row for each polygon, or one with the fault."""
    for df in frames:
        out = []
        for z in df.itertuples(index=False):
            head = (z.zone_id, z.revision, z.active_from, z.active_until)
            fault = None
            if not z.zone_id:
                fault = "no identifier"
            elif not pd.isna(z.active_from) and not pd.isna(z.active_until) and z.active_until <= z.active_from:
                fault = "ends before it begins"
            elif z.polygons is None or not len(z.polygons):
                fault = "no polygon"
            rows = []
            for p in z.polygons if fault is None else []:
                places = [[(q["lat"], q["lon"]) for q in r] for r in (p["outer"], *(p["holes"] if p["holes"] is not None else []))]
                rings = [_ring(_vectors(r)) if len(r) else np.zeros((0, 3)) for r in places]
                faults = [x for x in map(_ring_fault, places, rings) if x]
                if not faults and any(ring_class(rings[0], v) == OUTSIDE for h in rings[1:] for v in h):
                    faults = ["a hole leaves its outer ring"]
                if faults:
                    fault = faults[0]
                    break
                centre, radius = _cap(rings[0])
                rows.append((*head, rings[0].tolist(), [h.tolist() for h in rings[1:]], centre.tolist(), radius, None))
            out += rows if fault is None else [(*head, None, None, None, None, fault)]
        yield pd.DataFrame(out, columns=[x.split()[0] for x in _PREPARED.split(", ")])


def _prepared(zones: DataFrame) -> DataFrame:
    if "outer" in zones.columns:
        return zones
    if "ring" in zones.columns:
        place = lambda v: F.struct(F.degrees(F.asin(F.get(v, F.lit(2)))).alias("lat"), F.degrees(F.atan2(F.get(v, F.lit(1)), F.get(v, F.lit(0)))).alias("lon"))
        ring = F.transform("ring", place)
        zones = zones.withColumn("polygons", F.array(F.struct(ring.alias("outer"), F.slice(F.array(ring), 1, 0).alias("holes"))))
    z = zones.select(F.col("zone_id").cast("string").alias("zone_id"), F.col("revision").cast("long").alias("revision"), "active_from", "active_until", "polygons")
    return z.mapInPandas(_prepare, _PREPARED)


def zone_faults(zones: DataFrame) -> DataFrame:
    """(zone_id, revision, fault) of zones that can't be used."""
    twice = zones.groupBy("zone_id", "revision").agg(F.count("*").alias("n")).where("n > 1").select("zone_id", F.col("revision").cast("long").alias("revision"), F.lit("repeated").alias("fault"))
    every = _prepared(zones).where("fault is not null").select("zone_id", "revision", "fault").unionByName(twice)
    return every.groupBy("zone_id", "revision").agg(F.min("fault").alias("fault"))


def prepare_zones(zones: DataFrame) -> DataFrame:
    """Polygons of the zones, ready to be joined; an error that names the first zone that can't be used."""
    first = zone_faults(zones).orderBy("zone_id", "revision").first()
    if first is not None:
        raise ValueError(f"exclusion zone {first['zone_id']!r}: {first['fault']}")
    return Steps(zones.sparkSession, "zones").save(_prepared(zones).orderBy("zone_id", "revision"))


def zone_summary(zones: DataFrame) -> DataFrame:
    """One row: zones, latest revision, zones with an end, first begin."""
    each = zones.select("zone_id", "revision", "active_from", "active_until").distinct()
    return each.agg(F.count("*").alias("zones"), F.max("revision").cast("long").alias("last"), F.count("active_until").alias("bounded"), F.min("active_from").alias("first_active"))


#: Points or legs times edges of a zone that are looked at at once.
_CELLS = 200_000


def _settle(key: str, columns: list[str], test):
    """Rows for which test(outer, holes, *columns) holds: their key and zone; the rows of a zone together."""

    def values(column: pa.Array) -> np.ndarray:
        return np.asarray(column.flatten()).reshape(-1, 3) if pa.types.is_list(column.type) else np.asarray(column.to_numpy(zero_copy_only=False))

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            caps = values(b.column("cap_x"))
            zone = pd.MultiIndex.from_arrays([b.column("zone_id").to_pandas(), b.column("revision").to_pandas(), *caps.T]).factorize()[0]
            given = [values(b.column(c)) for c in columns]
            keep = np.zeros(b.num_rows, bool)
            for z in range(zone.max() + 1):
                at = np.flatnonzero(zone == z)
                # the rings are read from one row of each zone
                outer = np.array(b.column("outer")[int(at[0])].as_py(), float)
                holes = [np.array(h, float) for h in b.column("holes")[int(at[0])].as_py()]
                step = max(1, _CELLS // (len(outer) + sum(map(len, holes))))
                for k in range(0, len(at), step):
                    part = at[k : k + step]
                    keep[part] = test(outer, holes, *(x[part] for x in given))
            keep = pa.array(keep)
            yield pa.RecordBatch.from_arrays([b.column(c).filter(keep) for c in (key, "zone_id", "revision")], names=[key, "zone_id", "revision"])

    return run


def _first_zone(pairs: DataFrame, key: str, columns: list[str], test) -> DataFrame:
    kind = pairs.schema[key].dataType.simpleString()
    rows = pairs.select(key, "zone_id", "revision", "outer", "holes", "cap_x", *columns)
    hit = rows.mapInArrow(_settle(key, columns, test), f"{key} {kind}, zone_id string, revision long")
    return hit.groupBy(key).agg(F.min(F.struct("zone_id", "revision")).alias("z")).select(key, "z.zone_id", "z.revision")


def zones_at(points: DataFrame, key: str, zones: DataFrame, at: str = "ts", boundary_excluded: bool = True) -> DataFrame:
    """(key, zone_id, revision): the first zone by (zone_id, revision) that holds a point (lat, lon) at its time."""
    least = BOUNDARY if boundary_excluded else INSIDE
    live = F.coalesce(F.col("active_from") <= F.col(at), F.lit(True)) & F.coalesce(F.col(at) < F.col("active_until"), F.lit(True))
    p = points.withColumn("_v", unit_vector("lat", "lon"))
    near = p.join(small(_prepared(zones)), live & (dot(F.col("_v"), F.col("cap_x")) >= F.cos(F.least(F.lit(3.14), F.col("cap_radius") + 1e-8))))
    return _first_zone(near, key, ["_v"], lambda outer, holes, v: polygon_classes(outer, holes, v) >= least)


def segment_zone_hits(legs: DataFrame, key: str, zones: DataFrame, boundary_excluded: bool = True) -> DataFrame:
    """(key, zone_id, revision): the first zone by (zone_id, revision) each leg meets.

    legs: (key, lat1, lon1, lat2, lon2, t1, t2). Only the part of a leg that is sailed while
    a zone is active counts; its end at active_until does not. A leg meets a zone when an end
    of that part lies inside, when some of it between two contacts with the boundary does, or
    when it touches the boundary and that counts as inside. Caps rule most pairs out.
    """
    swap = F.col("t2") < F.col("t1")
    end = lambda k: unit_vector(F.when(swap, F.col(f"lat{3 - k}")).otherwise(F.col(f"lat{k}")), F.when(swap, F.col(f"lon{3 - k}")).otherwise(F.col(f"lon{k}")))
    legs = legs.select(key, end(1).alias("_a"), end(2).alias("_b"), F.least("t1", "t2").alias("_t1"), F.greatest("t1", "t2").alias("_t2"))
    legs = legs.withColumn("_half", angle_between(F.col("_a"), F.col("_b")) / 2).withColumn("_sum", F.zip_with("_a", "_b", lambda x, y: x + y))
    legs = legs.withColumn("_m", F.when(norm(F.col("_sum")) > 0, F.transform("_sum", lambda x: x / norm(F.col("_sum")))).otherwise(F.col("_a")))
    live = F.coalesce(F.col("_t2") >= F.col("active_from"), F.lit(True)) & F.coalesce(F.col("_t1") < F.col("active_until"), F.lit(True))
    near = dot(F.col("_m"), F.col("cap_x")) >= F.cos(F.least(F.lit(3.14), F.col("cap_radius") + F.col("_half") + 1e-8))
    j = legs.join(small(_prepared(zones)), live & near)
    seconds = lambda x: F.col(x).cast("double")
    long = seconds("_t2") - seconds("_t1")
    begin = F.when(long > 0, F.greatest(F.lit(0.0), F.coalesce((seconds("active_from") - seconds("_t1")) / long, F.lit(0.0)))).otherwise(0.0)
    until = F.when(long > 0, (seconds("active_until") - seconds("_t1")) / long)
    j = j.withColumn("_begin", begin).withColumn("_open", F.coalesce(until <= 1, F.lit(False))).withColumn("_end", F.least(F.lit(1.0), F.coalesce(until, F.lit(1.0))))
    j = j.where((F.col("_begin") < F.col("_end")) | (long == 0))
    a, b = F.col("_a"), F.col("_b")
    j = j.withColumn("_s", F.when(F.col("_begin") > 0, slerp(a, b, F.col("_begin"))).otherwise(a)).withColumn("_e", F.when(F.col("_end") < 1, slerp(a, b, F.col("_end"))).otherwise(b))
    return _first_zone(j, key, ["_s", "_e", "_open"], lambda outer, holes, s, e, open_end: legs_violate(outer, holes, s, e, open_end, boundary_excluded))
