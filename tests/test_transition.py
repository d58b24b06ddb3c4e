"""Single legs: against currents, for a time, at the midpoint; documents of routes."""

import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions.polar import Polar
from tidemark.operators import ensemble as E
from tidemark.operators import interpolation as I
from tidemark.operators.frontier import Options, Surroundings, search
from tidemark.operators.transition import heading_legs, target_legs
from tidemark.plans import registry
from tidemark.sources import route_files

NOON = dt.datetime(2026, 7, 14, 12)
LEG = "k int, lat double, lon double, ts timestamp, heading double, side int, to_lat double, to_lon double, until timestamp"
POLAR = Polar([0.0, 90.0, 180.0], [0.0, 20.0], [[0.0, 1.0], [0.0, 8.0], [0.0, 6.0]])


def knots(angle, tws):
    return tws / 20 * (1 + 7 * angle / 90 if angle <= 90 else 8 - 2 * (angle - 90) / 90)


def current(spark, spec, wind, east, north):
    return I.Field(wind.select("valid_time", "j", "i", F.lit(east).alias("east"), F.lit(north).alias("north")), spec, ["east", "north"])


def test_track_is_held_against_a_current(spark):
    wind, spec = registry._constant_wind(spark)
    air = I.Field(wind, spec, ["u", "v"])
    rows = [(1, 1.0, 0.5, NOON, 0.0, 0, 1.0, 0.8, NOON + dt.timedelta(hours=9)), (2, 1.0, 0.5, NOON, 0.0, 0, 0.7, 0.7, NOON + dt.timedelta(hours=9)), (3, 1.0, 0.5, NOON, 0.0, 0, 0.4, 0.5, NOON + dt.timedelta(hours=9))]
    legs = spark.createDataFrame(rows, LEG)
    east, north = 1.5, -0.7
    got = {r.k: r for r in target_legs(legs, ["k"], air, POLAR, Options(), Surroundings(current=current(spark, spec, wind, east, north))).collect()}
    tws = 10 * 1.9438444924406048
    for r in got.values():
        # water velocity and current add up to the track
        course = math.atan2(r.speed * math.sin(math.radians(r.new_heading)) + east, r.speed * math.cos(math.radians(r.new_heading)) + north)
        bearing = math.radians({1: 89.9973, 2: 146.31, 3: 180.0}[r.k])
        assert abs(math.degrees(math.atan2(math.sin(course - bearing), math.cos(course - bearing)))) < 0.2
        assert r.speed == pytest.approx(knots(min(r.new_heading, 360 - r.new_heading), tws), abs=1e-6)
        sog = math.hypot(r.speed * math.sin(math.radians(r.new_heading)) + east, r.speed * math.cos(math.radians(r.new_heading)) + north)
        assert r.sog == pytest.approx(sog, abs=1e-6) and r.seconds == r.lost + math.ceil(r.nm / r.sog * 3600) and r.fault is None
    # a current that can't be met
    strong = target_legs(legs, ["k"], air, POLAR, Options(), Surroundings(current=current(spark, spec, wind, 0.0, -20.0))).collect()
    assert {r.k: r.fault for r in strong} == {1: "infeasible", 2: "infeasible", 3: None}


def test_target_faults(spark):
    wind, spec = registry._constant_wind(spark)
    air, late = I.Field(wind, spec, ["u", "v"]), NOON + dt.timedelta(hours=99)
    rows = [(1, 1.0, 0.5, NOON, 0.0, 0, 1.0, 0.5, late), (2, 5.0, 0.5, NOON, 0.0, 0, 1.0, 0.8, late), (3, 1.0, 0.5, NOON + dt.timedelta(hours=13), 0.0, 0, 1.0, 0.8, late), (4, 1.0, 0.5, NOON, 0.0, 0, 1.0, 0.8, NOON + dt.timedelta(minutes=5)), (5, 1.0, 0.5, NOON, 0.0, 0, 1.0, 0.8, late)]
    legs = spark.createDataFrame(rows, LEG)
    assert {r.k: r.fault for r in target_legs(legs, ["k"], air, POLAR).collect()} == {1: "infeasible", 2: "missing_data", 3: "forecast_exhausted", 4: "duration_exhausted", 5: None}
    assert {r.fault for r in target_legs(legs.where("k = 5"), ["k"], air, POLAR, Options(max_wind=10.0)).collect()} == {"infeasible"}
    # halfway the forecast is over
    slow = Polar([0.0, 180.0], [0.0, 20.0], [[0.0, 0.6], [0.0, 0.6]])
    assert [r.fault for r in target_legs(legs.where("k = 5"), ["k"], air, slow, Options(midpoint_wind=True)).collect()] == ["forecast_exhausted"]
    assert [r.fault for r in target_legs(legs.where("k = 5"), ["k"], air, slow).collect()] == [None]


def test_midpoint_wind_changes_the_time(spark):
    wind, spec = registry._constant_wind(spark)
    rising = I.Field(wind.withColumn("v", F.when(F.hour("valid_time") == 12, -5.0).otherwise(-10.0)), spec, ["u", "v"])
    leg = spark.createDataFrame([(1, 1.0, 0.5, NOON, 0.0, 0, 1.0, 0.8, NOON + dt.timedelta(hours=11))], LEG)
    a = target_legs(leg, ["k"], rising, POLAR).first()
    b = target_legs(leg, ["k"], rising, POLAR, Options(midpoint_wind=True)).first()
    middle = math.ceil(a.nm / a.sog * 1800)
    tws = (5 + 5 * middle / 43200) * 1.9438444924406048
    assert b.seconds == math.ceil(a.nm / knots(90, tws) * 3600) < a.seconds and b.tws == a.tws
    assert target_legs(leg, ["k"], rising, POLAR, Options(midpoint_wind=True, midpoint_least=99999)).first().seconds == a.seconds


def test_heading_legs(spark):
    wind, spec = registry._constant_wind(spark)
    air = I.Field(wind, spec, ["u", "v"])
    ddl = "k int, lat double, lon double, ts timestamp, heading double, side int, new_heading double, duration long, to_lat double, to_lon double"
    rows = [(1, 1.0, 0.5, NOON, 0.0, 0, 90.0, 3600, 1.0, 0.9), (2, 1.0, 0.5, NOON, 300.0, -1, 90.0, 3600, 1.0, 0.55), (3, 1.0, 0.5, NOON, 0.0, 0, 90.0, 0, 1.0, 0.9), (4, 1.0, 0.5, NOON + dt.timedelta(hours=20), 0.0, 0, 90.0, 60, 1.0, 0.9), (5, 1.0, 0.5, NOON, 300.0, -1, 90.0, 600, 1.0, 0.9)]
    legs = spark.createDataFrame(rows, ddl)
    o = Options(tack_s=600, gybe_s=600, arrival_radius=0.5)
    free, clipped = ({r.k: r for r in heading_legs(legs, ["k"], air, POLAR, o, clip=c).collect()} for c in (False, True))
    kn = knots(90, 10 * 1.9438444924406048)
    assert {k: r.fault for k, r in free.items()} == {1: None, 2: None, 3: "infeasible", 4: "forecast_exhausted", 5: "infeasible"}
    assert free[1].nm == pytest.approx(kn) and free[2].nm == pytest.approx(kn * 3000 / 3600) and free[2].lost == 600 and free[2].seconds == 3600
    assert not free[2].arrived and clipped[2].arrived and not clipped[1].arrived
    assert clipped[2].seconds < 3600 and clipped[2].nm == pytest.approx(3.0 - 0.5, abs=0.01)
    drift = heading_legs(legs.where("k = 1"), ["k"], air, POLAR, o, Surroundings(current=current(spark, spec, wind, 0.0, 2.0))).first()
    assert drift.sog == pytest.approx(math.hypot(kn, 2.0)) and drift.end_lat > 1.03 and drift.speed == pytest.approx(kn)
    shut = heading_legs(legs.where("k = 1"), ["k"], air, POLAR, o, Surroundings(eligible=F.col("took") < 60)).first()
    assert shut.fault == "infeasible"


def test_wrong_choice_cost_both_ways(spark):
    rows = [(1, "a", 1.0, 10.0), (1, "b", 1.0, 30.0), (1, "c", 1.0, None), (2, "a", 1.0, None), (2, "b", 1.0, 5.0), (2, "c", 1.0, None)]
    df = spark.createDataFrame(rows, "g int, choice string, weight double, elapsed double")
    by = lambda d: {(r.g, r.choice): r.cost for r in d.collect()}
    inf = math.inf
    assert by(E.wrong_choice_cost(df, ["g"], "choice", "a")) == {(1, "a"): 0.0, (1, "b"): 20.0, (1, "c"): inf, (2, "a"): 0.0, (2, "b"): 0.0, (2, "c"): 0.0}
    assert by(E.wrong_choice_cost(df, ["g"], "choice", "a", maximize=True)) == {(1, "a"): 0.0, (1, "b"): 0.0, (1, "c"): 0.0, (2, "a"): 0.0, (2, "b"): inf, (2, "c"): 0.0}
    share = E.probability_before(F.lit(20.0))
    assert by(E.wrong_choice_cost(df, ["g"], "choice", "a", share, maximize=True)) == {(1, "a"): 0.0, (1, "b"): 1.0, (1, "c"): 1.0, (2, "a"): 0.0, (2, "b"): 0.0, (2, "c"): 0.0}


def test_route_documents(spark):
    wind, spec = registry._constant_wind(spark)
    req = spark.createDataFrame([(1, 1.0, 0.5, 1.0, 0.55, NOON), (2, 91.0, 0.5, 1.0, 0.6, NOON), (3, 1.0, 0.5, 1.0, 1.9, NOON)], "request_id long, lat double, lon double, to_lat double, to_lon double, depart timestamp")
    routes, summary = search(req, wind, spec, Polar.builtin(), Options(tiers=[(1800, None)], heading_step=45.0, per_bucket=1, max_duration=1800))
    docs = {r.request_id: json.loads(r.json) for r in route_files.route_documents(req, routes, summary, "constant", "built in").collect()}
    assert docs[1]["completion"] == "destination_reached" and docs[1]["diagnostics"]["timeSteps"] == 1 and docs[1]["arrival"]["position"]["longitude"] == docs[1]["points"][-1]["position"]["longitude"]
    assert docs[1]["departure"] == {"time": "2026-07-14T12:00:00Z", "source": "explicit_time", "position": {"latitude": 1.0, "longitude": 0.5}}
    assert docs[2]["completion"] == "invalid_argument" and docs[2]["points"] == [] and docs[2]["arrival"] == {}
    assert docs[3]["completion"] == "forecast_exhausted" and docs[3]["partial_reason"] == "duration_exhausted" and "partial_reason" not in docs[1]
