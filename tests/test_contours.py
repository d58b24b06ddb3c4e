"""Broken lines, chains, isochrone files, exact quantiles."""

import datetime as dt
import json
import random
import xml.etree.ElementTree as ET
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tidemark.operators import contours as C
from tidemark.operators import ensemble as E
from tidemark.sources import route_files as R

NOON = dt.datetime(2026, 7, 14, 12)


def broken(points, closed):
    """Parts of a line, edge by edge."""
    parts, split = [[points[0]]], False
    edges = list(zip(points, points[1:])) + ([(points[-1], points[0])] if closed and len(points) > 1 else [])
    for k, ((a, x), (b, y)) in enumerate(edges):
        back = closed and k == len(edges) - 1
        if abs(y - x) <= 180:
            if not back:
                parts[-1].append((b, y))
            continue
        split = True
        way = (y - x + 180) % 360 - 180
        side = 180.0 if way > 0 else -180.0
        lat = a + ((side - x) / way if way else 1) * (b - a)
        parts[-1].append((lat, side))
        parts.append([(lat, -side)])
        if not back and abs(y) != 180:
            parts[-1].append((b, y))
    return parts, closed and not split


def test_split_at_antimeridian(spark):
    r = random.Random(1)
    lines = {k: ([(r.uniform(-60, 60), r.choice([-180.0, 180.0, r.uniform(-180, 180), 179.0, -179.5])) for _ in range(r.randint(1, 7))], k % 2 == 0) for k in range(80)}
    lines[99] = ([(10.0, 170.0), (20.0, -170.0), (0.0, -180.0), (5.0, 175.0)], False)
    rows = [(k, i, a, o, c) for k, (p, c) in lines.items() for i, (a, o) in enumerate(p)]
    df = spark.createDataFrame(rows, "k int, n int, lat double, lon double, ring boolean").repartition(3)
    got = {}
    for x in C.split_at_antimeridian(df, ["k"], "n", F.col("ring")).orderBy("k", "part", "seq").collect():
        parts, _ = got.setdefault(x.k, ([], x.closed))
        if x.part == len(parts):
            parts.append([])
        parts[x.part].append((x.lat, x.lon))
        assert x.seq == len(parts[x.part]) - 1
    for k, (p, c) in lines.items():
        want, closed = broken(p, c)
        assert got[k][1] == closed and [len(x) for x in got[k][0]] == [len(x) for x in want]
        assert all(a == pytest.approx(b) for x, y in zip(got[k][0], want) for a, b in zip(x, y))


def test_chains(spark):
    df = spark.createDataFrame([(1, x, 0.0) for x in (0.0, 1.0, 5.0, 6.0, 20.0)] + [(2, 3.0, 4.0)], "k int, x double, y double")
    got = [(r.k, r.x, r.chain) for r in C.chains(df, ["k"], ["x"], 1.5).orderBy("k", "x").collect()]
    assert [c for k, _, c in got] == [0, 0, 1, 1, 2, 0]
    assert {r.chain for r in C.chains(df, ["k"], ["x"]).collect()} == {0}


def test_isochrone_files(spark):
    rows = [(1, NOON, 0, 10.0, 170.0), (1, NOON, 1, 20.0, -170.0), (1, NOON, 2, 20.0, -160.0), (1, NOON + dt.timedelta(hours=1), 0, 1.5, 2.25), (1, NOON + dt.timedelta(hours=2), 0, 0.0, 0.0), (1, NOON + dt.timedelta(hours=2), 1, 0.0, 1.0), (1, NOON + dt.timedelta(hours=2), 2, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "request_id int, time timestamp, seq int, lat double, lon double")
    lines = C.split_at_antimeridian(df, ["request_id", "time"], closed=F.hour("time") == 14).join(df.groupBy("request_id", "time").agg(F.count("*").alias("kept")), ["request_id", "time"])
    doc = json.loads(R.isochrones_geojson(lines).first().json)
    a, b, c = doc["features"]
    assert a["geometry"] == {"type": "MultiLineString", "coordinates": [[[170.0, 10.0], [180.0, 15.0]], [[-180.0, 15.0], [-170.0, 20.0], [-160.0, 20.0]]]}
    assert a["properties"] == {"time": "2026-07-14T12:00:00Z", "retainedPointCount": 3}
    assert b["geometry"] == {"type": "LineString", "coordinates": [[2.25, 1.5], [2.25, 1.5]]}
    assert c["geometry"]["coordinates"] == [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]
    ns = {"g": "http://www.topografix.com/GPX/1/1"}
    root = ET.fromstring(R.isochrones_gpx(lines, "it's <A> & \"B\"").first().gpx.encode())
    assert root.find("g:metadata/g:desc", ns).text == "it's <A> & \"B\"" and root.find("g:metadata/g:time", ns).text == "2026-07-14T12:00:00Z"
    tracks = root.findall("g:trk", ns)
    assert [[len(s) for s in t.findall("g:trkseg", ns)] for t in tracks] == [[2, 3], [2], [4]]
    p = tracks[0].findall("g:trkseg/g:trkpt", ns)[1]
    assert (p.get("lat"), p.get("lon"), p.find("g:time", ns).text) == ("15", "180", "2026-07-14T12:00:00Z")
    with pytest.raises(Exception, match="XML"):
        R.isochrones_gpx(lines, "bell \x07").collect()


def test_exact_quantiles(spark):
    r = random.Random(7)
    groups = {}
    for k in range(60):
        kinds = [[0.1] * 10, [0.1, 0.2, 0.7, 1e-12, 0.3], [1.0, 1.0, 1.0, 1.0], [1e300, 1e-300, 3e299, 1e300], [r.random() for _ in range(8)], [0.1] * 9 + [0.9, 1e-17]][k % 6]
        groups[k] = [(f"m{i}", None if r.random() < 0.1 else float(r.randint(1, 6)), w) for i, w in enumerate(kinds)]
        if k % 6 == 4:  # a share that sums of doubles miss by their rounding
            groups[k] = [(f"m{i}", float(i), w) for i, w in enumerate([0.1, 0.2, 0.3, 0.15, 0.15, 0.1])]
    df = spark.createDataFrame([(k, *x) for k, g in groups.items() for x in g], "k int, member string, elapsed double, weight double").repartition(3)
    shares = {"p75": (3, 4), "p90": (9, 10), "p50": (1, 2)}
    got = {x.k: x for x in E.nearest_rank(df, ["k"], shares).collect()}
    for k, g in groups.items():
        g = sorted(g, key=lambda x: (x[1] is None, x[1] or 0, x[0]))
        total = sum(Fraction(w) for *_, w in g)
        for name, (n, d) in shares.items():
            so_far, want = Fraction(0), None
            for _, elapsed, w in g:
                so_far += Fraction(w)
                if so_far * d >= total * n:
                    want = float("inf") if elapsed is None else elapsed
                    break
            assert got[k][name] == want, (k, name)


def test_exact_sum(spark):
    r = random.Random(3)
    lists = [[r.choice([-1, 1]) * r.random() * 10.0 ** r.randint(-30, 30) for _ in range(12)] for _ in range(40)] + [[0.1, 0.2, -0.3], [1e308, -1e308], []]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, x array<double>")
    for row in df.select("x", E.exact_sum(F.col("x")).alias("parts")).collect():
        assert sum(map(Fraction, row.parts), Fraction(0)) == sum(map(Fraction, row.x), Fraction(0))
        assert all(abs(a) <= abs(b) for a, b in zip(row.parts, row.parts[1:]))
