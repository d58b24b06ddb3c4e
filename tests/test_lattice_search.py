"""Lattice search in time against a search that settles one label after the other, on the same links."""

import datetime as dt
import heapq
import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions.geodesy import EARTH_RADIUS_NM, unit_vector
from tidemark.functions.polar import Polar
from tidemark.operators import lattice as L
from tidemark.operators import lattice_search as T
from tidemark.operators.frontier import Options
from tidemark.operators.interpolation import Field, GridSpec

START = dt.datetime(2026, 7, 14, 12)
POLAR = Polar([30.0, 60.0, 180.0], [0.0, 10.0, 30.0], [[0.0, 2.0, 3.0], [0.0, 6.0, 9.0], [0.0, 5.0, 8.0]])
#: (hours, u, v) of slices; the wind is the same everywhere.
SHIFT = [(0, 0.0, -0.5), (6, 0.0, -0.5), (12, -6.0, -6.0), (240, -6.0, -6.0)]
SPEC = GridSpec(-20.0, -20.0, 40.0, 40.0, 3, 3)
LEVEL = 4


def field(spark, slices):
    rows = [(START + dt.timedelta(hours=h), j, i, u, v) for h, u, v in slices for j in range(3) for i in range(3)]
    return Field(spark.createDataFrame(rows, "valid_time timestamp, j int, i int, u double, v double"), SPEC, ["u", "v"])


def blown(slices, s):
    h = s / 3600
    for (a, u0, v0), (b, u1, v1) in zip(slices, slices[1:]):
        if a <= h < b:
            x = (h - a) / (b - a)
            return u0 + x * (u1 - u0), v0 + x * (v1 - v0)
    return None


def boat(angle, tws):
    a = min(max(angle, POLAR.twa[0]), POLAR.twa[-1])
    i = max(k for k in range(len(POLAR.twa) - 1) if POLAR.twa[k] <= a)
    j = max(k for k in range(len(POLAR.tws) - 1) if POLAR.tws[k] <= tws) if tws < POLAR.tws[-1] else len(POLAR.tws) - 2
    t = min(1.0, (tws - POLAR.tws[j]) / (POLAR.tws[j + 1] - POLAR.tws[j]))
    row = [POLAR.speeds[k][j] + t * (POLAR.speeds[k][j + 1] - POLAR.speeds[k][j]) for k in (i, i + 1)]
    return row[0] + (a - POLAR.twa[i]) / (POLAR.twa[i + 1] - POLAR.twa[i]) * (row[1] - row[0])


def leg(slices, p, q, at, heading, side, tack):
    (a, b), (c, d) = [tuple(map(math.radians, x)) for x in (p, q)]
    nm = 2 * EARTH_RADIUS_NM * math.asin(math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2))
    course = math.degrees(math.atan2(math.sin(d - b) * math.cos(c), math.cos(a) * math.sin(c) - math.sin(a) * math.cos(c) * math.cos(d - b))) % 360
    wind = blown(slices, at)
    if wind is None or nm == 0:
        return None
    tws, twd = math.hypot(*wind) * 1.9438444924406048, math.degrees(math.atan2(-wind[0], -wind[1])) % 360
    fold = lambda x: min(abs(x) % 360, 360 - abs(x) % 360)
    v = boat(fold(course - twd), tws)
    if v <= 0:
        return None
    off = (course - twd + 180) % 360 - 180
    to = 0 if off in (0, -180) else 1 if off > 0 else -1
    lost = tack if side and to and side != to else 0
    return lost + math.ceil(nm / v * 3600), course, to


def dijkstra(slices, links, origin, goal, bucket, until, tack=0, waits=True):
    """Earliest arrival at the goal, settling the earliest label of each (cell, bucket, board)."""
    heap, settled = [(0, T.ORIGIN, 0, 0.0, origin)], set()
    while heap:
        at, cell, side, heading, place = heapq.heappop(heap)
        if (cell, at // bucket, side) in settled:
            continue
        settled.add((cell, at // bucket, side))
        if cell == T.DESTINATION:
            return at
        for b, to in links.get(cell, []):
            got = leg(slices, place, to, at, heading, side, tack)
            if got and at + got[0] <= until:
                heapq.heappush(heap, (at + got[0], b, got[2], got[1], to))
        nxt = (at // bucket + 1) * bucket
        if waits and nxt <= until:
            heapq.heappush(heap, (nxt, cell, side, heading, place))
    return None


@pytest.fixture(scope="module")
def lattice(spark):
    requests = spark.createDataFrame([(1, 4.0, 6.0, 3.2, 6.9, START), (2, 3.0, 3.0, 0.6, 4.1, START), (3, 5.0, 5.0, 5.2, 5.1, START)], "request_id long, lat double, lon double, to_lat double, to_lon double, depart timestamp").cache()
    faces = L.icosphere(spark, LEVEL)
    leaves = faces.withColumn("level", F.lit(LEVEL))
    lat, lon = L.position_of(L.midpoint("a", "b"))
    near = leaves.where(lat.between(-16, 24) & lon.between(-12, 24)).cache()
    links, ends = T.lattice_links(near).cache(), T.connectors(requests, near, LEVEL).cache()
    return requests, near, links, ends


def graph(links, ends, k):
    out = {}
    for r in [*links.collect(), *ends.where(F.col("request_id") == k).collect()]:
        out.setdefault(r["a"], []).append((r["b"], (r["to_lat"], r["to_lon"])))
    return out


@pytest.mark.parametrize(("slices", "tack", "bounded"), [(SHIFT, 5400, True), ([(0, 4.0, -5.0), (240, -5.0, -3.0)], 0, False)])
def test_arrivals(spark, lattice, slices, tack, bounded):
    requests, _, links, ends = lattice
    bucket, until = 24 * 3600, 96 * 3600
    routes, summary = T.lattice_search(requests, links, ends, field(spark, slices), POLAR, Options(max_duration=until, tack_s=tack, gybe_s=tack), bucket, bounded=bounded)
    got = {r["request_id"]: r["elapsed"] for r in summary.collect()}
    for r in requests.collect():
        want = dijkstra(slices, graph(links, ends, r["request_id"]), (r["lat"], r["lon"]), (r["to_lat"], r["to_lon"]), bucket, until, tack)
        assert got[r["request_id"]] == want
    assert sum(x is not None for x in got.values()) >= 2
    points = routes.orderBy("request_id", "seq").collect()
    for r in requests.collect():
        own = [p for p in points if p["request_id"] == r["request_id"]]
        if not own:
            assert got[r["request_id"]] is None
            continue
        assert (own[0]["lat"], own[-1]["lat"]) == (r["lat"], r["to_lat"])
        assert (own[-1]["time"] - START).total_seconds() == got[r["request_id"]]
        assert all(a["time"] < b["time"] for a, b in zip(own, own[1:]))
    if slices is SHIFT:  # waiting for the shift beats leaving at once
        assert any(p["waits"] for p in points)
        r = requests.where("request_id = 2").first()
        at_once = dijkstra(slices, graph(links, ends, 2), (r["lat"], r["lon"]), (r["to_lat"], r["to_lon"]), bucket, 10 * until, tack, waits=False)
        assert at_once > got[2]


def test_no_route_and_limits(spark, lattice):
    requests, _, links, ends = lattice
    _, s = T.lattice_search(requests, links, ends, field(spark, SHIFT), POLAR, Options(max_duration=3600), 1800)
    assert {r["completion"] for r in s.collect()} == {"no_route"}
    with pytest.raises(RuntimeError, match="did not end"):
        T.lattice_search(requests, links, ends, field(spark, SHIFT), POLAR, Options(max_duration=120 * 3600), 6 * 3600, max_rounds=1)


def test_cells_found_from_above(spark):
    points = spark.range(300).select(((F.col("id") * 37 % 179) - 89.3).alias("lat"), ((F.col("id") * 91 % 359) - 179.2).alias("lon")).withColumn("v", unit_vector("lat", "lon"))
    faces = L.icosphere(spark, 3)
    got = points.select("lat", "lon", "v", L.face_at(F.col("v"), 3)["face"].alias("face"), L.nearest_vertex(F.col("v"), 3)["cell"].alias("cell")).cache()
    side = lambda p, q: L.dot(L.cross(F.col(p), F.col(q)), F.col("v")) >= -1e-12
    plain = got.join(faces.withColumnRenamed("face", "f"), side("a", "b") & side("b", "c") & side("c", "a")).groupBy("lat", "lon", "face").agg(F.min("f").alias("f"))
    assert plain.where("f <> face").count() == 0 and plain.count() == 300
    near = got.select("lat", "lon", "v", "cell").join(L.vertices(faces).withColumnRenamed("cell", "c"), F.lit(True))
    near = near.groupBy("lat", "lon", "cell").agg(F.max_by("c", L.dot(F.col("v"), F.col("x"))).alias("c"))
    assert near.where("c <> cell").count() == 0


def test_mixed_lattice(spark, lattice):
    requests, near, _, _ = lattice
    coarse = near.drop("level")
    route = requests.select("request_id", F.explode(F.array(F.struct(F.lit(0).alias("seq"), "lat", "lon"), F.struct(F.lit(1).alias("seq"), F.col("to_lat").alias("lat"), F.col("to_lon").alias("lon")))).alias("p")).select("request_id", "p.*")
    leaves = T.mixed_leaves(requests, coarse, route, LEVEL, 1, 60.0).cache()
    n, every = coarse.count(), {r["request_id"]: (r["n"], r["fine"]) for r in leaves.groupBy("request_id").agg(F.count("*").alias("n"), F.sum((F.col("level") == LEVEL + 1).cast("int")).alias("fine")).collect()}
    for total, fine in every.values():
        assert 0 < fine < 4 * n / 2 and total == n + fine // 4 * 3
    links = T.lattice_links(leaves)
    back = links.select("request_id", F.col("b").alias("a"), F.col("a").alias("b"))
    assert links.select("request_id", "a", "b").exceptAll(back).count() == 0
    # no edge runs past a vertex in its middle, and all is one piece around each end
    assert links.groupBy("request_id", "a").count().where("count < 2").count() == 0
    ends = T.connectors(requests, leaves, LEVEL + 1)
    assert ends.where(F.col("a") == T.ORIGIN).groupBy("request_id").agg(F.count_distinct("b").alias("n")).where("n < 3").count() == 0


def test_refinement(spark, lattice):
    requests, near, _, _ = lattice
    air, o = field(spark, [(0, 4.0, -5.0), (240, -5.0, -3.0)]), Options(max_duration=72 * 3600)
    routes, summary = T.refined_search(requests, near.drop("level"), LEVEL, 1, air, POLAR, o, 72 * 3600, corridor_nm=200.0, retries=0)
    got = {r["request_id"]: r for r in summary.collect()}
    # inside the corridor the fine lattice is whole: the same arrival as on the uniformly split one
    leaves = L.split_faces(near).withColumn("level", F.lit(LEVEL + 1))
    whole = T.lattice_search(requests, T.lattice_links(leaves), T.connectors(requests, leaves, LEVEL + 1), air, POLAR, o, 72 * 3600)[1]
    w = {r["request_id"]: r["elapsed"] for r in whole.collect()}
    taken = [k for k, r in got.items() if r["fallback"] is None and r["completion"] == "destination_reached"]
    assert taken and all(got[k]["level"] == LEVEL + 1 and got[k]["elapsed"] == w[k] for k in taken)
    assert all(got[k]["level"] == LEVEL and w[k] > got[k]["elapsed"] for k, r in got.items() if r["fallback"] == "regressed")
    assert routes.groupBy("request_id").count().count() == sum(r["completion"] == "destination_reached" for r in got.values())
