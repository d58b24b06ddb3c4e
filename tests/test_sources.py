import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import interpolation as I
from tidemark.sources import grids, polar_text, route_files
from tidemark.streaming import cycles

TABLE = ["# a comment", "twa/tws;6;10;20", "45;4;5;6 # inline", "90;5;6;7", "180;3;4;5"]


def test_polar_text(spark, tmp_path):
    p = polar_text.parse(TABLE)
    assert p.tws == [0.0, 6.0, 10.0, 20.0] and p.twa == [45.0, 90.0, 180.0] and p.speeds[0] == [0.0, 4.0, 5.0, 6.0]
    for sep in (",", "\t", " "):
        assert polar_text.parse([x.replace(";", sep) for x in TABLE]) == p
    assert polar_text.parse(["6;10;20", *TABLE[2:]]) == p
    for bad in (["a;1"], ["x;6;5", "45;1;2", "90;1;2"], ["x;6;10", "45;1", "90;1;2"], ["x;6;10", "45;1;-2", "90;1;2"], ["x;6;10", "200;1;2", "210;1;2"], ["x;6;ten", "45;1;2", "90;1;2"]):
        with pytest.raises(ValueError):
            polar_text.parse(bad)
    (tmp_path / "a.pol").write_text("\n".join(TABLE))
    assert polar_text.read_polar(spark, str(tmp_path / "a.pol")) == p
    assert polar_text.polar_frame(spark, str(tmp_path / "a.pol")).count() == 12


def test_grids(spark):
    df = spark.createDataFrame([("10 kn",), ("m s**-1",), ("KM/H",)], "u string").select(grids.to_mps(F.lit(36.0), F.regexp_replace("u", "^10 ", "")).alias("v"))
    assert [round(r.v, 6) for r in df.collect()] == [round(36 * 0.5144444444444445, 6), 36.0, 10.0]
    with pytest.raises(Exception, match="unknown unit"):
        spark.range(1).select(grids.to_mps(F.lit(1.0), F.lit("mph"))).collect()
    names = spark.createDataFrame([("10u", None, None), ("u", "heightAboveGround", 10), ("v", "surface", 10), ("V10", None, None)], "n string, t string, l int")
    assert [r[0] for r in names.select(grids.wind_component(F.col("n"), F.col("t"), F.col("l"))).collect()] == ["u", "u", None, "v"]
    grid = spark.range(72).select(F.lit(dt.datetime(2026, 1, 1)).alias("valid_time"), (F.col("id") / 8).cast("int").alias("j"), (F.col("id") % 8).cast("int").alias("i"), F.col("id").alias("value"))
    assert grids.crop(grid, (1, 2), (6, 1), 8).count() == 8
    assert grids.pair_components(grid, grid.where("i > 0")).where("fault = 'unpaired'").count() == 9
    assert grids.coverage(grid).first()["rows"] == 9


def test_axes():
    spec, repeated = grids.grid_of_axes(80, -80, 0, 315, 5, 8)
    assert (spec, repeated) == (I.GridSpec(-80, 0, 40, 45, 5, 8, True), False)
    assert grids.grid_of_axes(-80, 80, 0, 360, 5, 9) == (I.GridSpec(-80, 0, 40, 45, 5, 8, True), True)
    assert grids.grid_of_axes(0, 2, 190, 188, 3, 3, eastward=False, dlon=1.0) == (I.GridSpec(0, -172, 1, 1, 3, 3), False)
    assert grids.grid_of_axes(0, 2, 359, 1, 3, 3)[0] == I.GridSpec(0, -1, 1, 1, 3, 3)
    for bad in ((0, 2, 0, 2, 3, 3, 0.5), (0, 2, 0, 2, 3, 3, 1.0, 0.7), (0, 0, 0, 2, 3, 3), (0, 2, 0, 2, 1, 3)):
        with pytest.raises(ValueError):
            grids.grid_of_axes(*bad)


@pytest.mark.parametrize(("spec", "boxes"), [
    (I.GridSpec(-90.0, 0.0, 10.0, 15.0, 19, 24, True), [(-12, 33, 170, -170), (0, 0, 0, 0), (-90, 90, -180, 180), (5, 6, -20, 40), (10, 20, -180, 180), (40, 50, 179, -179), (1, 2, -10, -20)]),
    (I.GridSpec(-20.0, 150.0, 5.0, 5.0, 9, 13), [(-3, 3, 170, -170), (-20, 20, 150, -150), (0, 1, 150, 151), (20, 20, -151, -150), (2.5, 7, 178, -177)]),
])
def test_crop_to_bounds(spark, spec, boxes):
    cells = [(dt.datetime(2026, 1, 1), j, i, float(j * 100 + i)) for j in range(spec.nj) for i in range(spec.ni)]
    grid = spark.createDataFrame(cells, "valid_time timestamp, j int, i int, u double").cache()
    lat, lon = (lambda s, j: s.south + j * s.dlat), (lambda s, i: (s.west + i * s.dlon + 180) % 360 - 180)
    for south, north, west, east in boxes:
        got, own = grids.crop_to_bounds(grid, spec, south, north, west, east)
        assert got.schema == grid.schema
        rows = {(round(lat(own, r.j), 6), round(lon(own, r.i), 6)): r.u for r in got.collect()}
        assert len(rows) == own.nj * own.ni and own.nj >= 2 and own.ni >= 2
        # each cell is the one of that place, and all that enclose the box are there
        assert all(grid_value == cells[[k for k, c in enumerate(cells) if (round(lat(spec, c[1]), 6), round(lon(spec, c[2]), 6)) == place][0]][3] for place, grid_value in list(rows.items())[:40])
        span = 360.0 if (west, east) == (-180, 180) else (east - west) % 360
        inside = lambda c: south <= lat(spec, c[1]) <= north and (lon(spec, c[2]) - west) % 360 <= span  # noqa: B023, E731
        assert {(round(lat(spec, c[1]), 6), round(lon(spec, c[2]), 6)) for c in cells if inside(c)} <= set(rows)
        # a lookup gives the same before and after
        r = random.Random(1)
        points = [(k, south + r.random() * (north - south), (west + r.random() * span + 180) % 360 - 180) for k in range(8)]
        at = spark.createDataFrame(points, "k int, lat double, lon double")
        a, b = ({x.k: x.u for x in I.bilinear(at, "k", g.drop("valid_time"), s, ["u"]).collect()} for g, s in ((grid, spec), (got, own)))
        assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)
    if not spec.wraps:
        for box in ((-30, 0, 160, 170), (0, 1, 140, 160), (0, 1, 170, -140)):
            with pytest.raises(ValueError, match="outside"):
                grids.window_of(spec, *box)
    with pytest.raises(ValueError):
        grids.window_of(spec, 10, 0, 160, 170)


def test_crop_reaches_the_scan(spark, tmp_path):
    spec = I.GridSpec(-90.0, -180.0, 1.0, 1.0, 181, 360, True)
    spark.range(181 * 360).select((F.col("id") / 360).cast("int").alias("j"), (F.col("id") % 360).cast("int").alias("i"), F.lit(1.0).alias("u")).write.parquet(str(tmp_path / "g"))
    got, own = grids.crop_to_bounds(spark.read.parquet(str(tmp_path / "g")), spec, 10, 20, 175, -175)
    assert got.count() == own.nj * own.ni == 121
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(j), GreaterThanOrEqual(j,100), LessThanOrEqual(j,110)" in plan


def test_unpaired_cells_raise(spark):
    u = spark.createDataFrame([(dt.datetime(2026, 1, 1), 0, i, 1.0) for i in range(2)], "valid_time timestamp, j int, i int, value double")
    assert grids.require_paired(grids.pair_components(u, u)).count() == 2
    with pytest.raises(Exception, match="unpaired"):
        grids.require_paired(grids.pair_components(u, u.where("i = 0"))).collect()


def test_route_files(spark):
    rows = [(1, s, dt.datetime(2026, 7, 14, 12, s), 1.0 + s / 3, 2.0, 90.0, 5.0, 10.0, 0.0, float(s)) for s in (1, 0)]
    df = spark.createDataFrame(rows, "request_id long, seq long, time timestamp, lat double, lon double, heading double, boat_speed double, tws double, twd double, cum_nm double")
    points = json.loads(route_files.route_json(df).first()["json"])["points"]
    assert [p["time"] for p in points] == ["2026-07-14T12:00:00Z", "2026-07-14T12:01:00Z"]
    gpx = route_files.route_gpx(df, "a<b").first()["gpx"]
    assert "<name>a&lt;b</name>" in gpx and '<trkpt lat="1" lon="2"><time>2026-07-14T12:00:00Z</time>' in gpx and 'lat="1.3333333333"' in gpx
    line = json.loads(route_files.isochrone_geojson(df.where("seq = 0")).first()["json"])
    assert line["geometry"] == {"type": "LineString", "coordinates": [[2.0, 1.0], [2.0, 1.0]]}
    with pytest.raises(Exception, match="not finite"):
        route_files.route_json(df.withColumn("lat", F.lit(float("nan")))).collect()


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(dt.datetime(2026, 1, 1, 0, m), "a", float(m)) for m in range(50)], "ts timestamp, event_type string, value double").write.parquet(str(src))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(src))
    q = cycles.on_each_cycle(stream, lambda b: b.groupBy("event_type").agg(F.sum("value").alias("s")), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).first()["s"] == sum(range(50))
    w = cycles.windowed_means(stream, width="10 minutes").writeStream.format("memory").queryName("means").outputMode("complete").trigger(availableNow=True).start()
    assert w.awaitTermination(60)
    assert spark.table("means").count() == 5 and spark.table("means").agg(F.sum("n")).first()[0] == 50
