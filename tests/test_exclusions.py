"""Zones with holes, windows and boundaries; arcs; members of ensembles."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions.geodesy import unit_vector
from tidemark.operators import ensemble as E
from tidemark.operators import environment as V
from tidemark.operators import exclusions as N
from tidemark.operators import lattice as L
from tidemark.operators import spatial as Z

NOW = dt.datetime(2026, 1, 1)
POLYGONS = "array<struct<outer: array<struct<lat: double, lon: double>>, holes: array<array<struct<lat: double, lon: double>>>>>"


def box(s, w, n, e):
    return [(s, w), (s, e), (n, e), (n, w)]


def zones(spark, *rows):
    return spark.createDataFrame([(z, r, a, u, p) for z, r, a, u, p in rows], f"zone_id string, revision int, active_from timestamp, active_until timestamp, polygons {POLYGONS}")


def hits(spark, z, legs, **more):
    rows = [(k, *p, NOW + dt.timedelta(minutes=a), NOW + dt.timedelta(minutes=b)) for k, p, a, b in legs]
    df = spark.createDataFrame(rows, "k int, lat1 double, lon1 double, lat2 double, lon2 double, t1 timestamp, t2 timestamp")
    return {r.k: r.zone_id for r in N.segment_zone_hits(df, "k", z, **more).collect()}


def test_holes_and_order(spark):
    holed = [(box(0.0, 0.0, 10.0, 10.0), [box(4.0, 4.0, 6.0, 6.0)])]
    z = N.prepare_zones(zones(spark, ("b", 1, None, None, holed), ("a", 2, None, None, [(box(20.0, 0.0, 30.0, 10.0), [])]), ("c", 1, None, None, [(box(8.0, 8.0, 12.0, 12.0), [])])))
    pts = spark.createDataFrame([(1, 2.0, 2.0), (2, 5.0, 5.0), (3, 25.0, 5.0), (4, -5.0, 5.0), (5, 9.0, 9.0), (6, 5.0, 0.0), (7, -2.0, -178.0)], "k int, lat double, lon double").withColumn("ts", F.lit(NOW))
    assert {r.k: r.zone_id for r in N.zones_at(pts, "k", z).collect()} == {1: "b", 3: "a", 5: "b", 6: "b"}
    assert 6 not in {r.k for r in N.zones_at(pts, "k", z, boundary_excluded=False).collect()}
    legs = [(1, (5.0, 4.5, 5.0, 5.5), 0, 60), (2, (5.0, 4.5, 5.0, 8.0), 0, 60), (3, (-5.0, 5.0, 15.0, 5.0), 0, 60), (4, (15.0, -5.0, 16.0, 20.0), 0, 60), (5, (5.0, -5.0, 5.0, -1.0), 0, 60)]
    assert hits(spark, z, legs) == {2: "b", 3: "b"}
    assert tuple(N.zone_summary(z).first())[:2] == (3, 2)


def test_windows_clip_legs(spark):
    """A leg crosses the ring before the zone opens, or after it has closed."""
    hour = NOW + dt.timedelta(hours=1)
    late = N.prepare_zones(zones(spark, ("late", 1, hour, None, [(box(-1.0, 1.0, 1.0, 2.0), [])])))
    early = N.prepare_zones(zones(spark, ("early", 1, None, hour, [(box(-1.0, 8.0, 1.0, 9.0), [])])))
    leg = (0.0, 0.0, 0.0, 10.0)  # five degrees an hour, from 0 to 10
    assert hits(spark, late, [(1, leg, 0, 120), (2, leg, 50, 170), (3, leg[2:] + leg[:2], 0, 120)]) == {2: "late", 3: "late"}
    assert hits(spark, early, [(1, leg, 0, 120), (2, leg, -60, 60), (3, (0.0, 8.5, 0.0, 8.5), 60, 60), (4, (0.0, 8.5, 0.0, 8.5), 59, 59)]) == {2: "early", 4: "early"}


def test_boundary_contact(spark):
    z = N.prepare_zones(zones(spark, ("z", 1, None, None, [([(0.0, 0.0), (0.0, 10.0), (10.0, 5.0)], [])])))
    along, through, off = (1, (0.0, 2.0, 0.0, 8.0), 0, 60), (2, (-1.0, 5.0, 5.0, 5.0), 0, 60), (3, (-3.0, 2.0, -3.0, 8.0), 0, 60)
    assert hits(spark, z, [along, through, off]) == {1: "z", 2: "z"}
    assert hits(spark, z, [along, through, off], boundary_excluded=False) == {2: "z"}


def test_zone_faults(spark):
    good = [(box(0.0, 0.0, 1.0, 1.0), [])]
    rows = [
        ("ok", 1, None, None, good),
        ("", 1, None, None, good),
        ("twice", 1, None, None, good),
        ("twice", 1, None, None, good),
        ("window", 1, NOW, NOW, good),
        ("empty", 1, None, None, []),
        ("thin", 1, None, None, [([(0.0, 0.0), (0.0, 0.0), (1.0, 1.0), (0.0, 0.0)], [])]),
        ("far", 1, None, None, [([(95.0, 0.0), (0.0, 1.0), (1.0, 1.0)], [])]),
        ("wide", 1, None, None, [(box(-80.0, -100.0, 80.0, 100.0), [])]),
        ("leak", 1, None, None, [(box(0.0, 0.0, 1.0, 1.0), [box(0.5, 0.5, 3.0, 3.0)])]),
    ]
    z = zones(spark, *rows)
    got = {r.zone_id for r in N.zone_faults(z).collect()}
    assert got == {r[0] for r in rows} - {"ok"}
    with pytest.raises(ValueError, match="exclusion zone"):
        N.prepare_zones(z)


def test_land_then_zones(spark):
    land = lambda p: p.select("pid", (60.0 * F.abs("lat")).alias("distance"))  # noqa: E731  along the equator
    z = N.prepare_zones(zones(spark, ("z", 1, None, None, [(box(4.0, 4.0, 6.0, 6.0), [])])))
    rows = [(1, 5.0, 3.0, 5.0, 7.0), (2, 2.0, 0.0, -2.0, 0.0), (3, 9.0, 0.0, 9.0, 2.0)]
    legs = spark.createDataFrame(rows, "k int, lat1 double, lon1 double, lat2 double, lon2 double").withColumn("t1", F.lit(NOW)).withColumn("t2", F.lit(NOW + dt.timedelta(hours=1)))
    left, counters = V.clear_legs(legs, "k", land, 5.0, z)
    assert [r.k for r in left.collect()] == [3]
    assert tuple(counters.first()) == (3, 1, 2, 1)


def test_arcs(spark):
    import numpy as np

    u = lambda a, b: N._vectors([(a, b)])
    contacts = lambda s, e, a, b: len(np.unique(np.round(N.arc_contacts(s[0], e[0], a, b, 1e-9), 9), axis=0))
    assert contacts(u(-1, 0), u(1, 0), u(0, -1), u(0, 1)) == 1
    assert contacts(u(1, 0), u(2, 0), u(0, -1), u(0, 1)) == 0
    assert contacts(u(0, 0), u(0, 5), u(0, 3), u(0, 9)) == 2
    assert np.degrees(N.arc_distance(u(2, 3)[0], u(0, 0), u(0, 9)))[0] == pytest.approx(2.0)
    v = lambda a, b: unit_vector(F.lit(float(a)), F.lit(float(b)))
    assert spark.range(1).select(F.degrees(Z.distance_to_arc(v(0, 12), v(0, 0), v(0, 9)))).first()[0] == pytest.approx(3.0)


def test_corridor(spark):
    faces = L.icosphere(spark, 2)
    route = spark.range(1).select(unit_vector(F.lit(0.0), F.lit(0.0)).alias("a"), unit_vector(F.lit(0.0), F.lit(20.0)).alias("b"))
    near = Z.corridor_faces(faces, route, 60.0)
    n = near.count()
    assert 0 < n < 60
    on = spark.range(41).select(F.col("id").alias("k"), unit_vector(F.lit(0.01), F.col("id") / 2.0).alias("v"))
    assert Z.containing_face(on, "k", faces).join(near, "face", "left_anti").count() == 0
    assert L.level_of([L.vertices(L.icosphere(spark, k)) for k in range(3)]).groupBy("level").count().orderBy("level").collect() == [(0, 12), (1, 30), (2, 120)]


def test_members(spark):
    members = spark.createDataFrame([("b", 3.0), ("a", 1.0)], "member string, weight double")
    same = (NOW, [NOW, NOW + dt.timedelta(hours=6)], -10.0, 350.0, 1.0, 1.0, 21, 21, ["wind"])
    kinds = "member string, initialized timestamp, valid_times array<timestamp>, south double, west double, dlat double, dlon double, nj int, ni int, variables array<string>"
    f = spark.createDataFrame([("a", *same), ("b", *same[:3], -10.0, *same[4:])], kinds)  # the same meridian by another name
    got, facts = E.load_members(members, f, strict=True)
    assert [(r.member, r.normalized_weight) for r in got.collect()] == [("a", 0.25), ("b", 0.75)] and all(facts.first())
    later = spark.createDataFrame([("a", *same), ("b", NOW + dt.timedelta(hours=6), *same[1:])], kinds)
    assert not E.load_members(members, later)[1].first().same_initialization
    with pytest.raises(ValueError, match="initialization"):
        E.load_members(members, later, strict=True)
    for bad in ([("a", 1.0), ("a", 1.0)], [("", 1.0)], [("a", -1.0)], [("a", float("inf"))], [("c", 1.0)], [("a", 0.0)]):
        with pytest.raises(ValueError):
            E.load_members(spark.createDataFrame(bad, "member string, weight double"), f)


def test_rival_documents(spark):
    rows = spark.createDataFrame([(1, "b", 0, 7.5), (1, "a", 4, None), (2, "a", 7, None)], "run int, member string, class_rank int, elapsed double")
    back = E.read_rival_json(E.rival_json(rows, ["run"]), ["run"])
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    with pytest.raises(Exception, match="unknown outcome class"):
        E.read_rival_json(spark.createDataFrame([(1, '{"outcomes":[{"memberIdentifier":"a","outcomeClass":"lost"}]}')], "run int, json string"), ["run"]).collect()


def test_dominance(spark):
    cols = "run int, label string, member string, weight double, class_rank int, elapsed double"
    rows = [(1, "x", "a", 1.0, 0, 5.0), (1, "x", "b", 0.0, 7, None), (1, "y", "a", 1.0, 0, 6.0), (1, "y", "b", 0.0, 0, 1.0), (1, "z", "a", 1.0, 0, 5.0), (1, "z", "b", 0.0, 0, 1.0)]
    df = spark.createDataFrame(rows, cols)
    assert {r.label for r in E.undominated_terminals(df, ["run"], "label").collect()} == {"x", "z"}
    ev = spark.createDataFrame([(1, x, o, 0.0, 0.0, 0.0, 0, 0, x) for x, o in (("x", 2.0), ("y", 1.0), ("z", 2.0))], "run int, label string, objective double, incomplete_weight double, finite_mean double, worst_finite double, generated int, settled int, identity string")
    assert [(r.label, r.rank) for r in E.policy_terminals(df, ev, ["run"], "label", 0).collect()] == [("x", 1)]
    states = [(1, "p", "a", "completed", 5.0, "h"), (1, "q", "a", "completed", 6.0, "h"), (1, "r", "a", "active", 5.0, "h"), (1, "s", "a", "active", 6.0, "h"), (1, "t", "a", "completed", 9.0, "g")]
    s = spark.createDataFrame(states, "run int, label string, member string, status string, elapsed double, place string")
    assert {r.label for r in E.undominated_labels(s, ["run"], "label", ["place"]).collect()} == {"p", "r", "s", "t"}


def test_beam_order_and_actions(spark):
    s = spark.createDataFrame([("x", 1.0, "active", 0.0, 1.0, None, 0.0, 0.0), ("y", 1.0, "completed", 0.0, 0.0, 5.0, 0.0, 0.0), ("z", 1.0, "failed", 0.0, 0.0, None, 0.0, 0.0)], "label string, weight double, status string, lat double, lon double, elapsed double, to_lat double, to_lon double")
    assert [r.label for r in E.beam_rank(s, ["label"]).orderBy(*E.beam_order("label")).collect()] == ["y", "x", "z"]
    a = spark.createDataFrame([("target", 1.5, -180.0, None, None), ("target", 1.5, 180.0, None, None), ("heading_for_duration", None, None, 370.0, 60), ("wait_for_duration", None, None, None, 60)], "kind string, lat double, lon double, heading double, seconds long")
    assert [r[0] for r in a.select(E.action_identity("kind", "lat", "lon", "heading", "seconds")).collect()] == ["target:1.5:180.0", "target:1.5:180.0", "heading:10.0:60", "wait:60"]
