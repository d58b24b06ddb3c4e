"""The search against published counters, and what bears on a leg besides the wind."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import geodesy as G
from tidemark.functions.polar import Polar
from tidemark.operators import interpolation as I
from tidemark.operators.frontier import Options, Surroundings, search, select_departures
from tidemark.plans import registry

NOON = dt.datetime(2026, 7, 14, 12)
REQUEST = "request_id long, lat double, lon double, to_lat double, to_lon double, depart timestamp"


def _global_wind(spark, hours=24):
    base = F.unix_timestamp(F.lit("2026-07-14 12:00:00").cast("timestamp"))
    k = F.col("id") % 40
    g = spark.range(80).select(F.timestamp_seconds(base + F.floor(F.col("id") / 40) * hours * 3600).alias("valid_time"), F.floor(k / 8).cast("int").alias("j"), (k % 8).cast("int").alias("i"), F.lit(0.0).alias("u"), F.lit(-10.0).alias("v"))
    return g, I.GridSpec(-80.0, 0.0, 40.0, 45.0, 5, 8, wraps=True)


def _one(spark, wind, spec, places, options=Options(), **more):
    req = spark.createDataFrame([(1, *places, NOON)], REQUEST)
    routes, summary = search(req, wind, spec, Polar.builtin(), options, **more)
    s = summary.first()
    return sorted(routes.collect(), key=lambda r: r.seq), (s.completion, s.expanded, s.generated, s.retained, s.steps)


def test_scheduled_intervals(spark):
    wind, spec = registry._constant_wind(spark)
    route, work = _one(spark, wind, spec, (1.0, 0.5, 1.0, 1.0), Options(tiers=[(1200, 3600), (2400, None)]))
    assert work == ("destination_reached", 1292, 37468, 1292, 7)
    assert route[-1].time == dt.datetime(2026, 7, 14, 15, 21, 6)


def test_accuracy_controls(spark):
    wind, spec = registry._constant_wind(spark)
    o = Options(tack_s=15, gybe_s=10, toward_destination=True, midpoint_wind=True, monotone=True, sector_degrees=5.0)
    route, work = _one(spark, wind, spec, (1.0, 0.5, 1.0, 1.0), o)
    assert work[0] == "destination_reached" and work[4] == 7
    assert work[1] == pytest.approx(4633, abs=1) and work[2] == pytest.approx(138969, abs=33)  # one tie of places may fall otherwise
    assert route[-1].time == dt.datetime(2026, 7, 14, 15, 21, 6) and route[-1].lon == pytest.approx(0.99167101558771265, abs=1e-10)


def test_high_latitude(spark):
    route, work = _one(spark, *_global_wind(spark), (70.0, 0.0, 70.0, 2.0))
    assert work == ("destination_reached", 4663, 135227, 4663, 10)
    assert route[-1].time == dt.datetime(2026, 7, 14, 16, 36, 27) and route[-1].lon == pytest.approx(1.9758921140173697, abs=1e-9)


def test_forecast_exhaustion(spark):
    wind, spec = registry._constant_wind(spark, hours=1)
    route, work = _one(spark, wind, spec, (1.0, 0.25, 1.0, 1.75), Options(max_duration=12 * 3600))
    assert work == ("forecast_exhausted", 23, 667, 110, 2)
    assert route[-1].time == dt.datetime(2026, 7, 14, 13) and route[-1].lon == pytest.approx(0.39669689139930142, abs=1e-10)


QUICK = Options(tiers=[(3600, None)], heading_step=45.0, per_bucket=2)


def _field(spark, columns, values):
    wind, spec = registry._constant_wind(spark)
    return I.Field(wind.select("valid_time", "j", "i", *(F.lit(v).alias(c) for c, v in zip(columns, values, strict=True))), spec, columns)


def test_current_and_waves(spark):
    """Two knots of current with the boat; a following sea slows it."""
    wind, spec = registry._constant_wind(spark)
    place = (1.0, 0.5, 1.0, 0.75)
    around = Surroundings(current=_field(spark, ["east", "north"], [2.0, 0.0]), waves=_field(spark, ["height", "period", "sin", "cos"], [2.0, 8.0, 0.0, 1.0]), midpoint=True)
    route, work = _one(spark, wind, spec, place, QUICK, around=around)
    flat = 8.8064074874010085
    hours = (route[-1].time - NOON).total_seconds() / 3600
    assert work[0] == "destination_reached" and 0.5 * flat < route[-1].boat_speed < flat
    assert hours == pytest.approx((15.0 - 0.5) / (route[-1].boat_speed + 2.0), rel=5e-3)


def test_missing_environment(spark):
    wind, spec = registry._constant_wind(spark)
    none = I.Field(wind.select("valid_time", "j", "i", F.lit(None).cast("double").alias("east"), F.lit(None).cast("double").alias("north")), spec, ["east", "north"])
    rows = spark.createDataFrame([(1, 1.0, 1.0, NOON)], "k int, lat double, lon double, ts timestamp")
    assert [(r.k, r.east) for r in Surroundings(current=none).sampled(rows, ["k"]).collect()] == [(1, None)]
    assert Surroundings(current=none, missing="reject").sampled(rows, ["k"]).count() == 0
    with pytest.raises(Exception, match="missing environment data"):
        Surroundings(current=none, missing="fail").sampled(rows, ["k"]).collect()
    with pytest.raises(ValueError):
        Surroundings(missing="guess")


def test_packed_and_joined_lookups(spark, monkeypatch):
    """Both ways to look a grid up give the same values and statuses."""
    wind, spec = registry._constant_wind(spark)
    grid = wind.withColumn("u", F.col("j") * 2.0 + F.col("i") + F.hour("valid_time")).withColumn("v", F.when((F.col("j") == 2) & (F.col("i") == 2), float("nan")).otherwise(F.col("i") * 1.0))
    places = [(k, 2.2 * (k * 37 % 100) / 100 - 0.1, 2.2 * (k * 61 % 100) / 100 - 0.1, NOON + dt.timedelta(minutes=k * 17)) for k in range(60)]
    rows = spark.createDataFrame(places, "k int, lat double, lon double, ts timestamp")
    packed = I.Field(grid, spec, ["u", "v"])
    monkeypatch.setattr(I, "PACKED_VALUES", 4)
    joined = I.Field(grid, spec, ["u", "v"])
    assert packed.packed is not None and joined.packed is None
    a, b = ({r.k: (r.status, r.u and round(r.u, 9), r.v and round(r.v, 9)) for r in f.at(rows, ["k"]).collect()} for f in (packed, joined))
    assert {k: x for k, x in a.items() if x[0] == "ok"} == {k: x for k, x in b.items() if x[0] == "ok"}
    assert {k: x[0] for k, x in a.items()} == {k: x[0] for k, x in b.items()} and len({x[0] for x in a.values()}) >= 3


def test_zones_land_and_eligibility(spark):
    wind, spec = registry._constant_wind(spark)
    place = (1.0, 0.5, 1.0, 0.8)
    land = lambda p: p.select("pid", F.lit(99.0).alias("distance"))
    corners = ((0.97, 0.6), (0.97, 0.65), (1.03, 0.65), (1.03, 0.6))
    ring = F.array(*(G.unit_vector(a, b) for a, b in corners))
    zones = spark.range(1).select(F.lit("z").alias("zone_id"), F.lit(1).alias("revision"), F.lit(None).cast("timestamp").alias("active_from"), F.lit(None).cast("timestamp").alias("active_until"), ring.alias("ring"))
    around, work = _one(spark, wind, spec, place, QUICK, around=Surroundings(zones=zones, land=land, land_clearance=1.0))
    assert work[0] == "destination_reached" and (around[-1].time - NOON).total_seconds() > 17.5 / 8.8064 * 3600
    assert not any(0.97 < r.lat < 1.03 and 0.6 < r.lon < 0.65 for r in around)
    none, _ = _one(spark, wind, spec, place, QUICK, around=Surroundings(eligible=F.col("new_heading") != 90.0))
    assert all(r.heading != 90.0 for r in none)


def test_departures_and_faults(spark):
    wind, spec = registry._constant_wind(spark)
    rows = [(1, 1.0, 0.5, 1.0, 0.6, NOON), (2, 1.0, 0.5, 1.0, 0.6, None), (3, 1.0, 0.5, 1.0, 0.6, NOON - dt.timedelta(days=1)), (4, 91.0, 0.5, 1.0, 0.6, NOON), (5, 1.0, 0.5, 1.0, 50.0, NOON)]
    req = spark.createDataFrame(rows, REQUEST)
    routes, summary = search(req, wind, spec, Polar.builtin(), QUICK)
    end = {r.request_id: r.completion for r in summary.collect()}
    assert end == {1: "destination_reached", 2: "destination_reached", 3: "departure_outside_forecast", 4: "invalid_argument", 5: "coordinate_outside_forecast"}
    assert {r.request_id for r in routes.collect()} == {1, 2}
    first, last = (F.lit(NOON + dt.timedelta(hours=h)) for h in (0, 12))
    for now, source, at in ((NOON + dt.timedelta(hours=1), "current_time", NOON + dt.timedelta(hours=1)), (NOON - dt.timedelta(hours=1), "forecast_start_fallback", NOON)):
        got = select_departures(req.where("request_id = 2"), first, last, F.lit(now)).first()
        assert (got.departure_source, got.depart) == (source, at)
    assert select_departures(req.where("request_id = 3"), first, last).first().departure_source == "explicit_time"


def test_progress_and_cancel(spark):
    wind, spec = registry._constant_wind(spark)
    seen = []
    _, work = _one(spark, wind, spec, (1.0, 0.5, 1.0, 1.0), QUICK, progress=lambda step, points: bool(seen.append((step, points.count())) or step == 2), every_n_steps=2)
    assert [s for s, _ in seen] == [2] and seen[0][1] > 0 and work[0] == "cancelled"


def test_best_vmg_headings(spark):
    best = {r.tws: r for r in Polar.builtin().best_angles(spark).collect()}
    both = spark.createDataFrame([(12.0,), (0.0,)], "w double").select(Polar.builtin().best_angles_at(spark, "w").alias("b")).collect()
    assert both[0].b.up == pytest.approx((best[10.0].up_angle + best[14.0].up_angle) / 2) and both[0].b.down == pytest.approx((best[10.0].down_angle + best[14.0].down_angle) / 2)
    assert (both[1].b.up, both[1].b.down) == (0.0, 180.0)
    wind, spec = registry._constant_wind(spark)
    _, work = _one(spark, wind, spec, (1.0, 0.5, 1.0, 0.6), Options(tiers=[(3600, None)], heading_step=90.0, per_bucket=1, best_vmg=True))
    assert work[0] == "destination_reached" and work[2] == 3 + 4  # the wind's eye is no heading


def _counted(seen, f):
    """f, noting how many requests its rows are of."""
    return lambda rows, *a, **k: seen.append(rows.select("request_id").distinct().count()) or f(rows, *a, **k)


def test_alike_requests_are_searched_once(spark, monkeypatch):
    from tidemark.operators import frontier

    wind, spec = registry._constant_wind(spark)
    rows = [(k, 1.0, 0.5, 1.0, 0.6 + k % 2 / 10, None if k % 3 == 0 else NOON) for k in range(60)]
    req = spark.createDataFrame(rows, REQUEST).repartition(5)
    seen = []
    monkeypatch.setattr(frontier, "expand", _counted(seen, frontier.expand))
    routes, summary = frontier.search(req, wind, spec, Polar.builtin(), QUICK)
    assert max(seen) <= 4 and summary.count() == 60  # two places, two kinds of departure
    ways = {}
    for r in routes.collect():
        ways.setdefault(r.request_id, []).append(tuple(r)[1:])
    work = {r.request_id: tuple(r)[1:] for r in summary.collect()}
    for k in range(60):
        alone, counts = _one(spark, wind, spec, rows[k][1:5], QUICK) if k in (1, 2) else (None, None)
        assert sorted(ways[k]) == sorted(ways[(1, 2)[k % 2 == 0]]) and work[k] == work[(1, 2)[k % 2 == 0]]
        assert alone is None or sorted(ways[k]) == [tuple(r)[1:] for r in alone] and work[k] == counts


def test_alike_requests_of_an_ensemble_are_searched_once(spark, monkeypatch):
    from tidemark.operators import ensemble_search as E

    wind, spec = registry._constant_wind(spark)
    req = spark.createDataFrame([(k, 1.0, 0.5, 1.0, 0.6 + k % 2 / 10, NOON) for k in range(40)], REQUEST).repartition(5)
    seen = []
    monkeypatch.setattr(E, "two_level_beam", _counted(seen, E.two_level_beam))
    members = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "member string, weight double")
    grids = wind.crossJoin(members.select("member"))
    courses, outcomes = E.ensemble_search(req, members, grids, spec, Polar.builtin(), QUICK, width=8)
    assert max(seen) <= 2 and courses.count() == 40 and outcomes.count() == 80
    assert courses.drop("request_id").distinct().count() == 2
