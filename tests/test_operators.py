import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions.geodesy import angular_difference, unit_vector
from tidemark.functions.polar import Polar
from tidemark.operators import ensemble as E
from tidemark.operators import exclusions as N
from tidemark.operators import interpolation as I
from tidemark.operators import lattice as L
from tidemark.operators import policy as P
from tidemark.operators import ranking as K
from tidemark.operators import spatial as Z
from tidemark.operators.frontier import Options, search
from tidemark.plans import registry

T0 = dt.datetime(2026, 7, 14)


def test_trilinear(spark):
    """Wind that grows by a metre a second and hour; north to south rows."""
    u0 = [[8, 10, 12], [10, 12, 14], [12, 14, 16]]
    rows = [(T0 + dt.timedelta(hours=6 * t), j, i, float(u0[j][i] + 6 * t), float(4 + 2 * t)) for t in (0, 1) for j in range(3) for i in range(3)]
    grid = spark.createDataFrame(rows, "valid_time timestamp, j int, i int, u double, v double")
    spec = I.GridSpec(0.0, 0.0, 1.0, 1.0, 3, 3)
    at = T0 + dt.timedelta(hours=3)
    pts = spark.createDataFrame([(1, 1.0, 1.0, at), (2, 0.5, 0.5, at), (3, 5.0, 1.0, at), (4, 1.0, 1.0, T0 + dt.timedelta(hours=7)), (5, 2.0, 2.0, T0 + dt.timedelta(hours=6))], "k int, lat double, lon double, ts timestamp")
    got = {r.k: r for r in I.trilinear(pts, "k", grid, spec, ["u", "v"]).collect()}
    assert (got[1].u, got[1].v) == (15.0, 5.0) and got[2].u == 13.0
    assert [got[k].status for k in (1, 3, 4, 5)] == ["ok", "out_of_bounds", "out_of_time", "ok"]
    assert got[5].u == 22.0
    holed = grid.withColumn("v", F.when((F.col("j") == 2) & (F.col("i") == 2), float("nan")).otherwise(F.col("v")))
    got = {r.k: r.status for r in I.trilinear(pts, "k", holed, spec, ["u", "v"]).collect()}
    assert got[1] == "ok" and got[5] == "incomplete_forecast"  # a corner of weight 0 doesn't count


def test_wrapping_grid(spark):
    spec = I.GridSpec(-80.0, 0.0, 40.0, 45.0, 5, 8, wraps=True)
    grid = spark.range(40).select((F.col("id") / 8).cast("int").alias("j"), (F.col("id") % 8).cast("int").alias("i"), (F.col("id") % 8).cast("double").alias("u"))
    pts = spark.createDataFrame([(1, 0.0, 337.5), (2, 0.0, -22.5), (3, 80.0, 0.0)], "k int, lat double, lon double")
    got = {r.k: r.u for r in I.bilinear(pts, "k", grid, spec, ["u"]).collect()}
    assert got == {1: 3.5, 2: 3.5, 3: 0.0}


@pytest.fixture(scope="module")
def golden(spark):
    wind, spec = registry._constant_wind(spark)
    req = spark.createDataFrame([(1, 1.0, 0.5, 1.0, 1.0, dt.datetime(2026, 7, 14, 12)), (2, 1.0, 0.5, 1.0, 0.501, dt.datetime(2026, 7, 14, 12))], "request_id long, lat double, lon double, to_lat double, to_lon double, depart timestamp")
    return [x.collect() for x in search(req, wind, spec, Polar.builtin(), Options())]


def test_search_reaches(golden):
    routes, summary = golden
    s = {r.request_id: r for r in summary}[1]
    assert (s.completion, s.expanded, s.generated, s.retained, s.steps) == ("destination_reached", 1633, 47357, 1633, 7)
    route = sorted((r for r in routes if r.request_id == 1), key=lambda r: r.seq)
    assert len(route) == 8 and route[-1].time == dt.datetime(2026, 7, 14, 15, 21, 6)
    assert route[-1].lon == pytest.approx(0.99167101558771265, abs=1e-10)
    assert route[-1].cum_nm == pytest.approx(29.515658268059983, abs=1e-8)


def test_search_starts_there(golden):
    routes, summary = golden
    assert {r.request_id: r.completion for r in summary}[2] == "destination_reached"
    assert [r.seq for r in routes if r.request_id == 2] == [0]


def test_options():
    for bad in ({"heading_step": 0.0}, {"tiers": [(60, None)]}, {"per_bucket": 0}):
        with pytest.raises(ValueError):
            Options(**bad)


def test_diverse_top_k(spark):
    import random

    r = random.Random(4)
    rows = [(g, i, r.random(), float(r.randrange(36) * 10)) for g in range(6) for i in range(r.randrange(1, 30))]
    df = spark.createDataFrame(rows, "g int, i int, d double, h double").repartition(7)
    got = {(x.g, x.i): x.picked for x in K.diverse_top_k(df, ["g"], ["d", "i"], "h", 4).collect()}
    apart = lambda a, b: min(abs(a - b) % 360, 360 - abs(a - b) % 360)
    want = {}
    for g in range(6):
        own = sorted((x for x in rows if x[0] == g), key=lambda x: (x[2], x[1]))
        taken = [own[0]]
        while len(taken) < min(4, len(own)):
            taken.append(max((x for x in own if x not in taken), key=lambda x: (min(apart(x[3], t[3]) for t in taken), -own.index(x))))
        want |= {(g, x[1]): n + 1 for n, x in enumerate(taken)}
    assert got == want


def test_nearest_rank(spark):
    rows = [(1, "a", 1.0, 10.0), (1, "b", 2.0, 20.0), (1, "c", 1.0, None), (2, "a", 1.0, 5.0)]
    df = spark.createDataFrame(rows, "run int, member string, weight double, elapsed double")
    got = {r.run: r for r in E.nearest_rank(df, ["run"], {"p75": (3, 4), "p90": (9, 10)}).collect()}
    assert got[1].p75 == 20 and got[1].p90 == float("inf") and got[2].p90 == 5


def test_rings(spark):
    ring = F.array(*(unit_vector(float(a), float(b)) for a, b in ((0, 170), (0, -170), (10, -170), (10, 170))))
    pts = spark.createDataFrame([(1, 5.0, 179.0), (2, 5.0, -175.0), (3, 5.0, 160.0), (4, -5.0, 180.0)], "k int, lat double, lon double")
    got = {r.k: r.i for r in pts.select("k", Z.in_ring(unit_vector("lat", "lon"), ring).alias("i")).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False}
    now = dt.datetime(2026, 1, 1)
    zones = spark.range(1).select(F.lit("z").alias("zone_id"), F.lit(1).alias("revision"), F.lit(None).cast("timestamp").alias("active_from"), F.lit(now + dt.timedelta(hours=2)).alias("active_until"), ring.alias("ring"))
    legs = spark.createDataFrame([(1, 5.0, 165.0, 5.0, -165.0, now), (2, -9.0, 165.0, -9.0, -165.0, now), (3, 5.0, 179.0, 5.0, 179.5, now), (4, 5.0, 179.0, 5.0, 179.5, now + dt.timedelta(hours=2))], "k int, lat1 double, lon1 double, lat2 double, lon2 double, t1 timestamp").withColumn("t2", F.col("t1") + F.expr("interval 1 hour"))
    assert {r.k for r in N.segment_zone_hits(legs, "k", zones).collect()} == {1, 3}


def test_lattice(spark):
    faces = L.icosphere(spark, 2)
    assert faces.count() == 320 and L.vertices(faces).count() == 162 and L.edges(faces).count() == 960
    pts = spark.range(200).select(F.col("id").alias("k"), unit_vector((F.col("id") * 37 % 179 - 89).cast("double"), (F.col("id") * 91 % 360).cast("double")).alias("v"))
    assert Z.containing_face(pts, "k", faces).count() == 200
    seed = L.vertices(faces).orderBy("cell").limit(1).select(F.lit(1).cast("long").alias("request_id"), "cell")
    got = L.earliest_arrivals(seed, L.edges(faces).withColumn("kn", F.lit(10.0)), F.col("kn"))
    assert got.count() == 162
    import heapq

    edges = {}
    for e in L.edges(faces).collect():
        edges.setdefault(e.a, []).append((e.b, -(-e.nm // (10.0 / 3600)) ))
    start = seed.first().cell
    best, heap = {}, [(0, start)]
    while heap:
        d, a = heapq.heappop(heap)
        if a not in best:
            best[a] = d
            for b, w in edges[a]:
                heapq.heappush(heap, (d + w, b))
    assert all(abs(r.elapsed - best[r.cell]) <= 2 * 12 for r in got.collect())


def test_skyline_three(spark):
    df = spark.createDataFrame([(1, 1, 5, 5), (2, 2, 4, 4), (3, 2, 5, 5), (4, 1, 5, 5)], "k int, a int, b int, c int")
    assert {r.k for r in K.skyline(df, "k", ["a", "b", "c"]).collect()} == {1, 2, 4}


def test_limits(spark):
    with pytest.raises(ValueError):
        K.require_at_most(spark.range(5), 4, "rows")
    assert K.require_at_most(spark.range(4), 4, "rows").count() == 4


def test_root_paths(spark):
    df = spark.createDataFrame([(i, i - 1 if i else None) for i in range(100)] + [(200, 201), (201, 200)], "id long, parent long")
    got = {r.id: (r.root, r.depth) for r in P.root_paths(df).collect()}
    assert got == {i: (0, i) for i in range(100)}


def test_repartitioning_changes_nothing(spark):
    rows = spark.range(500).select(F.col("id"), (F.col("id") % 7).alias("g"), (F.col("id") * 37 % 360).cast("double").alias("h"))
    a, b = (sorted(map(tuple, K.diverse_top_k(rows.repartition(n), ["g"], ["id"], "h", 3).collect())) for n in (1, 9))
    assert a == b
    assert rows.where(angular_difference("h", "h") != 0).count() == 0


def test_missing_data_policies(spark):
    from tidemark.operators import environment as V

    spec = I.GridSpec(0.0, 0.0, 1.0, 1.0, 2, 2)
    grid = spark.createDataFrame([(0, 0, 1.0), (0, 1, None), (1, 0, 3.0), (1, 1, 4.0)], "j int, i int, x double")
    pts = spark.createDataFrame([(1, 0.5, 0.0), (2, 0.5, 0.5), (3, 9.0, 9.0)], "k int, lat double, lon double")
    rows, counters = V.sample(pts, "k", grid, spec, ["x"])
    assert {r.k: r.x for r in rows.collect()} == {1: 2.0, 2: 0.0, 3: 0.0}
    assert tuple(counters.first()) == (3, 2)
    assert [r.k for r in V.sample(pts, "k", grid, spec, ["x"], "reject")[0].collect()] == [1]
    with pytest.raises(Exception, match="missing environment data"):
        V.sample(pts, "k", grid, spec, ["x"], "fail")[0].collect()
    with pytest.raises(ValueError):
        V.checked_grid(grid, spec, ["x"])
    assert V.checked_grid(grid.fillna(2.0), spec, ["x"], least=0.0).count() == 4
    with pytest.raises(ValueError):
        V.uniform_field(spark, east=float("nan"))


def test_certified_legs(spark):
    from tidemark.operators import environment as V

    far = lambda p: p.select("pid", (60.0 * F.abs("lat")).alias("distance"))  # noqa: E731  land along the equator
    legs = spark.createDataFrame([(1, 3.0, 0.0, 3.0, 20.0), (2, 3.0, 0.0, -3.0, 1.0), (3, 0.4, 0.0, 0.4, 1.0), (4, 3.0, 0.0, 0.4, 0.0)], "k int, lat1 double, lon1 double, lat2 double, lon2 double")
    got = {r.k: r.clear for r in V.certify_legs(legs, "k", far, 30.0, depth=8).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False}
    assert {r.k for r in V.certify_legs(legs, "k", far, 30.0, depth=0).collect() if r.clear} == set()


def test_ensemble_search(spark):
    from tidemark.operators.ensemble_search import ensemble_search

    wind, spec = registry._constant_wind(spark)
    both = wind.withColumn("member", F.lit("a")).unionByName(wind.withColumn("v", F.col("v") * 0.8).withColumn("member", F.lit("b")))
    req = spark.createDataFrame([(1, 1.0, 0.5, 1.0, 0.8, dt.datetime(2026, 7, 14, 12))], "request_id long, lat double, lon double, to_lat double, to_lon double, depart timestamp")
    o = Options(tiers=[(3600, None)], heading_step=30.0, per_bucket=2)
    one = spark.createDataFrame([("a", 1.0)], "member string, weight double")
    courses, _ = ensemble_search(req, one, both, spec, Polar.builtin(), o, width=12)
    routes, _ = search(req, wind, spec, Polar.builtin(), o)
    alone = max(r.time for r in routes.collect()) - dt.datetime(2026, 7, 14, 12)
    assert courses.first().mean_s == alone.total_seconds() and set(courses.first().headings) == {90.0}
    two = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "member string, weight double")
    courses, outcomes = ensemble_search(req, two, both, spec, Polar.builtin(), o, width=12)
    by = {r.member: r.elapsed_s for r in outcomes.collect()}
    assert by["a"] < by["b"] and courses.first().mean_s == pytest.approx((by["a"] + 3 * by["b"]) / 4)


def test_members_fail_on_their_own(spark):
    """A member without wind ends as missing data, one whose forecast ends as exhausted; the others arrive."""
    from tidemark.operators.ensemble_search import ensemble_search

    wind, spec = registry._constant_wind(spark)
    gap = F.when(F.col("member") != "gap", F.col("v"))
    grids = wind.crossJoin(spark.createDataFrame([("a",), ("gap",), ("slow",)], "member string")).withColumn("v", gap * F.when(F.col("member") == "slow", 0.7).otherwise(1.0))
    req = spark.createDataFrame([(1, 1.0, 0.5, 1.0, 0.8, dt.datetime(2026, 7, 14, 12)), (2, 1.0, 0.5, 1.0, 0.5, dt.datetime(2026, 7, 14, 12)), (3, 1.0, 0.5, 1.0, 0.8, dt.datetime(2026, 7, 15, 12))], "request_id long, lat double, lon double, to_lat double, to_lon double, depart timestamp")
    members = spark.createDataFrame([("a", 1.0), ("gap", 1.0), ("slow", 2.0)], "member string, weight double")
    o = Options(tiers=[(3600, None)], heading_step=30.0, per_bucket=2)
    courses, outcomes = ensemble_search(req, members, grids, spec, Polar.builtin(), o, width=12)
    got = {(r.request_id, r.member): (r.outcome, r.elapsed_s) for r in outcomes.collect()}
    assert got[1, "gap"] == ("missing_data", None) and got[1, "a"][0] == got[1, "slow"][0] == "reached" and got[1, "a"][1] < got[1, "slow"][1]
    assert all(got[2, m] == ("reached", 0) for m in ("a", "gap", "slow"))
    assert {got[3, m][0] for m in ("a", "slow")} == {"forecast_exhausted"}
    by = {r.request_id: r for r in courses.collect()}
    assert by[1].objective == math.inf and by[1].incomplete_weight == 0.25 and set(by[1].headings) == {90.0}
    assert by[1].mean_s == pytest.approx((got[1, "a"][1] + 2 * got[1, "slow"][1]) / 3) and by[2].headings == []
    # the bound drops labels and changes no result
    free, _ = ensemble_search(req, members, grids, spec, Polar.builtin(), o, width=12, bounded=False)
    other = {r.request_id: r for r in free.collect()}
    assert all(other[k].mean_s == by[k].mean_s and other[k].settled >= by[k].settled for k in by)
    with pytest.raises(RuntimeError, match="did not end"):
        ensemble_search(req.where("request_id = 1"), members, grids, spec, Polar.builtin(), o, width=12, max_steps=1)


def _cheapest(polar_kn, weights, place, to, radius, step=3600, depth=3):
    """Least mean arrival over every sequence of headings up to `depth` steps, by plain arithmetic; winds don't change."""
    r = 3440.065

    def nm(a, b):
        p, q = math.radians(a[0]), math.radians(b[0])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 2 * r * math.asin(math.sqrt(h))

    def ahead(a, heading, d):
        p, l, b, d = math.radians(a[0]), math.radians(a[1]), math.radians(heading), d / r
        s = math.sin(p) * math.cos(d) + math.cos(p) * math.sin(d) * math.cos(b)
        return math.degrees(math.asin(s)), math.degrees(l + math.atan2(math.sin(b) * math.sin(d) * math.cos(p), math.cos(d) - math.sin(p) * s))

    headings = sorted({h for _, h in polar_kn})
    entry = {}  # a leg's first point within the radius, on a fine grid of shares
    best = math.inf
    level = [tuple((place, None) for _ in weights)]
    for n in range(depth):
        after = []
        for state in level:
            for h in headings:
                moved = []
                for m, (at, came) in zip(weights, state):
                    if came is not None:
                        moved.append((at, came))
                        continue
                    kn = polar_kn[m, h]
                    if kn <= 0:
                        break
                    leg = kn * step / 3600
                    if (at, m, h) not in entry:
                        hit = next((i / 400 for i in range(401) if nm(ahead(at, h, leg * i / 400), to) <= radius), None) if nm(at, to) - leg <= radius else None
                        entry[at, m, h] = hit, ahead(at, h, leg)
                    hit, end = entry[at, m, h]
                    moved.append((end, None) if hit is None else (to, n * step + hit * step))
                else:
                    if all(c is not None for _, c in moved):
                        best = min(best, sum(w * c for w, (_, c) in zip(weights.values(), moved)) / sum(weights.values()))
                    else:
                        after.append(tuple(moved))
        level = after
    return best


def test_ensemble_search_is_best_of_all_courses(spark):
    from tidemark.functions import geodesy as G
    from tidemark.operators.ensemble_search import ensemble_search

    wind, spec = registry._constant_wind(spark)
    shares, weights = {"a": 1.1, "b": 0.9}, {"a": 1.0, "b": 2.0}
    grids = wind.withColumn("member", F.lit("a")).unionByName(wind.withColumn("member", F.lit("b")))
    grids = grids.withColumn("v", F.col("v") * F.when(F.col("member") == "a", shares["a"]).otherwise(shares["b"]))
    members = spark.createDataFrame(list(weights.items()), "member string, weight double")
    places = {1: ((1.0, 0.5), (1.0, 0.7))}
    req = spark.createDataFrame([(k, *a, *b, dt.datetime(2026, 7, 14, 12)) for k, (a, b) in places.items()], "request_id long, lat double, lon double, to_lat double, to_lon double, depart timestamp")
    o = Options(tiers=[(3600, None)], heading_step=45.0, arrival_radius=3.0)
    h = spark.range(8).select((F.col("id") * 45.0).alias("h")).crossJoin(spark.createDataFrame([(m, s * 10 * G.MPS_TO_KNOTS) for m, s in shares.items()], "m string, tws double"))
    kn = {(r.m, r.h): r.kn for r in h.select("m", "h", Polar.builtin().speed(G.angular_difference("h", F.lit(0.0)), F.col("tws")).alias("kn")).collect()}
    got = {r.request_id: r.mean_s for r in ensemble_search(req, members, grids, spec, Polar.builtin(), o)[0].collect()}
    for k, (a, b) in places.items():
        assert got[k] == pytest.approx(_cheapest(kn, weights, a, b, 3.0), abs=10)


def test_routes_are_seeded_by_suppliers(spark, monkeypatch):
    """A request for each supplier row, also where nations repeat, and the library's options."""
    d, called = "/root/testdata/sf0.01", []
    assert registry._seeds(spark, d).select("request_id").distinct().count() == spark.read.parquet(f"{d}/supplier.parquet").count()
    monkeypatch.setattr(registry, "ensemble_search", lambda *a, **k: called.append((a, k)) or (spark.createDataFrame([], "request_id long, mean_s double"), spark.createDataFrame([], "request_id long, member string, elapsed_s long")))
    registry.ensemble_route(spark, d)
    assert called[0][0][0].count() == 100 and len(called[0][0]) == 5 and not called[0][1]
