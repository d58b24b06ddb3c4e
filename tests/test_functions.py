import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import geodesy as G
from tidemark.functions import sailing as S
from tidemark.functions import text as X
from tidemark.functions.polar import Polar


def one(spark, *cols):
    r = spark.range(1).select(*cols).first()
    return r[0] if len(cols) == 1 else tuple(r)


def test_geodesy(spark):
    assert one(spark, G.distance_nm(0.0, 0.0, 0.0, 90.0)) == pytest.approx(3440.065 * math.pi / 2)
    assert one(spark, G.initial_bearing(0.0, 0.0, 0.0, 1.0)) == pytest.approx(90)
    lat, lon = one(spark, G.destination(1.0, 0.5, 90.0, 4.403203743700504)["lat"], G.destination(1.0, 0.5, 90.0, 4.403203743700504)["lon"])
    assert lat == pytest.approx(0.9999991807464883, abs=1e-13) and lon == pytest.approx(0.5733484457088025, abs=1e-12)
    assert one(spark, G.destination(0.0, 179.9, 90.0, 60.0)["lon"]) < -178
    assert one(spark, G.angular_difference(350.0, 10.0)) == pytest.approx(20)
    assert one(spark, G.is_valid_position(91.0, 0.0)) is False


def test_arrival_fraction(spark):
    f = one(spark, G.arrival_fraction(0.0, 0.0, 0.0, 1.0, 90.0, 80.0, 5.0))
    assert f == pytest.approx((3440.065 * math.pi / 180 - 5) / 80, abs=1e-9)
    assert one(spark, G.arrival_fraction(0.0, 0.0, 0.0, 1.0, 0.0, 80.0, 5.0)) is None
    assert one(spark, G.arrival_fraction(0.0, 0.0, 0.0, 0.01, 0.0, 80.0, 5.0)) == 0


def test_wind_and_current(spark):
    assert one(spark, S.wind_from(0.0, -10.0)) == 0 and one(spark, S.wind_from(-10.0, 0.0)) == pytest.approx(90)
    assert one(spark, S.wind_speed(3.0, 4.0)) == pytest.approx(5 * 1.9438444924406048)
    assert one(spark, S.board(90.0, 0.0)) == 1 and one(spark, S.board(270.0, 0.0)) == -1 and one(spark, S.board(180.0, 0.0)) == 0
    assert one(spark, S.derated_speed(8.0, 0.0, 90.0, 8.0)) == 8
    assert one(spark, S.derated_speed(8.0, 2.0, 180.0, 8.0)) < one(spark, S.derated_speed(8.0, 2.0, 0.0, 8.0)) < 8
    g = S.ground_velocity(0.0, 6.0, 2.0, 0.0)
    assert one(spark, g["sog"]) == pytest.approx(math.hypot(6, 2))
    assert one(spark, S.course_to_steer_offset(0.0, 1.0, 2.0, 0.0)) is None
    p = Polar.builtin()
    speed = lambda h: p.speed(G.angular_difference(h, F.lit(0.0)), F.lit(14.0))
    h = one(spark, S.solve_heading(F.lit(90.0), speed, F.lit(0.0), F.lit(1.0)))
    v = one(spark, speed(F.lit(h)))
    track = one(spark, S.ground_velocity(h, v, 0.0, 1.0)["cog"])
    assert track == pytest.approx(90, abs=1e-6)


def test_polar(spark):
    p = Polar.builtin()
    assert one(spark, p.speed(90.0, 19.43844492440605)) == pytest.approx(8.8064074874010085)
    t = p.table(spark).withColumn("lin", p.speed("twa", "tws")).withColumn("cub", p.speed("twa", "tws", monotone=True))
    assert t.where("abs(lin - speed) > 1e-12 or abs(cub - speed) > 1e-12").count() == 0
    fine = spark.range(0, 1801).select((F.col("id") / 10.0).alias("a")).withColumn("v", p.speed("a", F.lit(14.0), monotone=True)).collect()
    up = [r.v for r in fine if 30 <= r.a <= 90]
    assert all(b >= a - 1e-9 for a, b in zip(up, up[1:], strict=False)) and max(r.v for r in fine) <= 8.0 + 1e-9
    assert one(spark, p.speed(90.0, 0.0)) == 0 and one(spark, p.speed(200.0, 20.0)) == one(spark, p.speed(160.0, 20.0))
    for r in p.best_angles(spark).collect():
        assert 30 < r.up_angle < 90 < r.down_angle < 180 and r.up_vmg > 0 > r.down_vmg


def test_text(spark):
    assert one(spark, X.parse_utc(F.lit("2026-07-14T12:00:00Z"))) is not None
    assert one(spark, X.parse_utc(F.lit("2026-07-14 12:00:00Z"))) is None and one(spark, X.parse_utc(F.lit("2026-13-14T12:00:00Z"))) is None
    assert X.parse_intervals("20m@1h,40m") == [(1200, 3600), (2400, None)]
    for bad in ("20m@1h", "20m,40m", "0m"):
        with pytest.raises(ValueError):
            X.parse_intervals(bad)
    assert X.parse_position("1.5,-2") == (1.5, -2.0)
    with pytest.raises(ValueError):
        X.parse_position("91,0")
    assert X.fnv1a64(b"") == "cbf29ce484222325" and X.fnv1a64(b"a") == "af63dc4c8601ec8c"
    assert X.coordinate_text(1.5) == "1.5" and X.number_text(0.1) == "0.10000000000000001"


def test_speed_along_a_row(spark):
    """Many angles in one wind give the speeds of single lookups, bit by bit."""
    from tidemark.functions.polar import Polar

    p = Polar.builtin()
    df = spark.range(3000).select(((F.col("id") * 37 % 800) - 400.0 + F.col("id") % 7 / 7).alias("a"), F.when(F.col("id") % 50 == 0, None).when(F.col("id") % 51 == 0, float("nan")).otherwise(F.col("id") * 13 % 700 / 10.0).alias("w"))
    got = df.withColumn("row", p.at_wind("w")).select("a", "w", p.speed("a", "w").alias("x"), p.along("a", "row").alias("y"))
    assert got.where("not (x <=> y)").count() == 0 and got.where("x > 0").count() > 2000
