"""Ensemble documents and the report on members."""

import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ensemble as E
from tidemark.operators.ensemble_search import ensemble_search
from tidemark.operators.frontier import Options
from tidemark.functions.polar import Polar
from tidemark.plans import registry
from tidemark.sources import ensemble_documents as D

NOON = dt.datetime(2026, 7, 14, 12)
FORECAST = "member string, initialized timestamp, valid_times array<timestamp>, south double, west double, dlat double, dlon double, nj int, ni int, variables array<string>"


def documents(spark, **change):
    members = spark.createDataFrame([("a", 1.0, 0.25, None), ("b", 3.0, 0.75, "file_io")], "member string, weight double, normalized_weight double, fault string")
    outcomes = spark.createDataFrame([(1, "b", "missing_data", None, 1.0, 2.0), (1, "a", "reached", 3600.5, 1.5, 2.5)], "request_id long, member string, outcome string, elapsed_s double, lat double, lon double")
    courses = spark.createDataFrame([(1, math.inf, 0.75, 3600.5, 3600, [90.0, 0.1])], "request_id long, objective double, incomplete_weight double, mean_s double, worst_s long, headings array<double>")
    nodes = spark.createDataFrame([(1, "n1", 0, False, 1), (1, "n2", 1, True, 0)], "request_id long, node string, depth long, terminal boolean, outgoing long")
    branches = spark.createDataFrame([(1, "b1", "n1", "n2", "sail", 0.0, True, False)], "request_id long, branch string, from_node string, to_node string, action string, cost double, selected boolean, needs_review boolean")
    parts = {"members": members, "outcomes": outcomes, "courses": courses, "nodes": nodes, "branches": branches} | {k: f(v) for k, (v, f) in {k: (dict(members=members, outcomes=outcomes, courses=courses, nodes=nodes, branches=branches)[k], f) for k, f in change.items()}.items()}
    return D.ensemble_documents(parts["courses"], parts["outcomes"], parts["members"], ["request_id"], "run 7", "model", policy=(parts["nodes"], parts["branches"]))


def test_round_trip(spark):
    written = documents(spark)
    doc = json.loads(written.first().json)
    assert list(doc) == ["schema_version", "run_metadata", "member_metadata", "result"] and "objective" not in doc["result"]
    assert [m["identifier"] for m in doc["result"]["members"]] == ["a", "b"] and doc["result"]["headings"] == [90.0, 0.1]
    back = D.read_ensemble_documents(written, ["request_id"])
    assert back.select(F.to_json("document")).first()[0] == written.first().json
    assert [tuple(r) for r in D.document_outcomes(back, ["request_id"]).orderBy("member").collect()] == [(1, "a", 1.0, 0, 3600.5), (1, "b", 3.0, 4, None)]


@pytest.mark.parametrize(("change", "message"), [
    ({"members": lambda m: m.withColumn("normalized_weight", F.lit(0.3))}, "add up"),
    ({"members": lambda m: m.where("member = 'a'").withColumn("normalized_weight", F.lit(1.0))}, "not those of the members"),
    ({"members": lambda m: m.withColumn("weight", F.lit(-1.0))}, "name or weight"),
    ({"outcomes": lambda o: o.withColumn("outcome", F.lit("sunk"))}, "unknown outcome"),
    ({"outcomes": lambda o: o.withColumn("elapsed_s", F.lit(1.0))}, "without an arrival"),
    ({"branches": lambda b: b.withColumn("to_node", F.lit("n9"))}, "without its nodes"),
])
def test_contradictions_are_not_written(spark, change, message):
    with pytest.raises(Exception, match=message):
        documents(spark, **change).collect()


@pytest.mark.parametrize("edit", [
    lambda t: t.replace('"depth":0', '"depth":0,"more":1'),
    lambda t: t.replace('"original_weight":1.0', '"original_weight":1.00'),
    lambda t: t.replace('"reached"', '"Reached"'),
    lambda t: t.replace("ensemble_route_result_v1", "v2"),
    lambda t: t.replace('"cost":0.0', '"cost":"free"'),
    lambda t: t[:-1],
    lambda t: " " + t,
])
def test_other_documents_are_refused(spark, edit):
    text = documents(spark).first().json
    assert edit(text) != text
    with pytest.raises(Exception):
        D.read_ensemble_documents(spark.createDataFrame([(1, edit(text))], "request_id long, json string"), ["request_id"]).collect()


def test_broken_members_are_reported_and_the_others_go_on(spark):
    times = [NOON, NOON + dt.timedelta(hours=12)]
    good = (NOON, times, 0.0, 0.0, 1.0, 1.0, 3, 3, ["u", "v"])
    forecasts = spark.createDataFrame([("a", *good), ("b", *good[:3], 360.0, *good[4:]), ("half", *good[:8], ["u"]), ("late", NOON + dt.timedelta(hours=6), *good[1:]), ("neg", *good), ("none", NOON, [], *good[2:])], FORECAST)
    members = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("half", 1.0), ("late", 0.0), ("gone", 1.0), ("neg", -2.0), ("none", 0.0), ("", 0.0), ("twice", 0.0), ("twice", 0.0)], "member string, weight double")
    report = E.member_report(members, forecasts)
    got = {r.member: (r.fault, r.message, r.differs) for r in report.collect()}
    assert report.count() == 10
    assert got["a"] == got["b"] == (None, None, []) and got["late"] == (None, None, ["initialization"])
    assert got["half"][:2] == ("incomplete_forecast", "wind components are missing") and got["none"][1] == "no times"
    assert got["gone"][:2] == ("file_io", "no forecast") and got["neg"][0] == got[""][0] == got["twice"][0] == "invalid_argument"
    assert {r.member: r.normalized_weight for r in report.collect()}["a"] == 0.25
    wind, spec = registry._constant_wind(spark)
    grids = wind.crossJoin(spark.createDataFrame([("a",), ("b",)], "member string"))
    req = spark.createDataFrame([(1, 1.0, 0.5, 1.0, 0.6, NOON)], "request_id long, lat double, lon double, to_lat double, to_lon double, depart timestamp")
    use = report.where("member in ('a', 'b', 'half', 'gone')")
    courses, outcomes = ensemble_search(req, use, grids, spec, Polar.builtin(), Options(tiers=[(3600, None)], heading_step=30.0, per_bucket=2), width=8)
    assert {r.member: r.outcome for r in outcomes.collect()} == {"a": "reached", "b": "reached", "half": "missing_data", "gone": "missing_data"}
    written = D.ensemble_documents(courses, outcomes, use, ["request_id"], "run", "model")
    assert D.read_ensemble_documents(written, ["request_id"]).count() == 1 and courses.first().incomplete_weight == 0.5


def pieces_of(spark, size=3, **change):
    rows = [(g, f"m{k:03d}", 1.0 + k, (1.0 + k) / 55, (None, "file_io")[k == 4], ("reached", "missing_data")[k % 4 == 0], None if k % 4 == 0 else 3600.5 + k, 1.0, 2.0) for g in (1, 2) for k in range(10)]
    rows = spark.createDataFrame(rows, "g int, member string, weight double, normalized_weight double, fault string, outcome string, elapsed_s double, lat double, lon double").repartition(5)
    courses = spark.createDataFrame([(g, math.inf, 0.75, 3600.5, 3600, [90.0, 0.1]) for g in (1, 2)], "g int, objective double, incomplete_weight double, mean_s double, worst_s long, headings array<double>")
    rows = change.get("rows", lambda r: r)(rows)
    return D.document_pieces(courses, rows, ["g"], "run 7", "model", size=size), rows, courses


def test_pieces_are_bounded_and_make_the_document(spark):
    pieces, rows, courses = pieces_of(spark)
    got = {g: sorted((r.section, r.part, r.json) for r in pieces.collect() if r.g == g) for g in (1, 2)}
    assert len(got[1]) == 3 + 2 * 4 and max(j.count("identifier\":\"m") for x in got.values() for _, _, j in x) == 3
    whole = D.ensemble_documents(courses, rows, rows.select("g", "member", "weight", "normalized_weight", "fault"), ["g"], "run 7", "model")
    assert {r.g: r.json for r in whole.collect()} == {g: "".join(j for _, _, j in x) for g, x in got.items()}
    want = sorted(map(tuple, D.document_outcomes(D.read_ensemble_documents(whole, ["g"]), ["g"]).collect()))
    assert sorted(map(tuple, D.read_document_pieces(pieces.repartition(3), ["g"]).collect())) == want and len(want) == 20


@pytest.mark.parametrize(("edit", "message"), [
    (lambda p: p.where("not (g = 1 and section = 3 and part = 1)"), "missing or there twice"),
    (lambda p: p.where("section <> 0"), "missing or there twice"),
    (lambda p: p.where("section <> 4"), "missing or there twice"),
    (lambda p: p.where("section <> 3"), "missing or there twice"),
    (lambda p: p.where("not (section = 3 and part = 3)"), "not those of the members"),
    (lambda p: p.unionByName(p.where("section = 2")), "missing or there twice"),
    (lambda p: p.withColumn("json", F.replace("json", F.lit("m007"), F.lit("m006"))), "a member twice"),
    (lambda p: p.withColumn("json", F.replace("json", F.lit('"original_weight":2.0'), F.lit('"original_weight":2.00'))), "another layout"),
    (lambda p: p.withColumn("json", F.replace("json", F.lit('"latitude":1.0'), F.lit('"latitude":1.0,"more":1'))), "another layout"),
    (lambda p: p.withColumn("json", F.replace("json", F.lit('"reached"'), F.lit('"sunk"'))), "unknown outcome"),
    (lambda p: p.withColumn("json", F.replace("json", F.lit("result_v1"), F.lit("result_v2"))), "unknown version"),
    (lambda p: p.withColumn("json", F.concat("json", F.lit(" "))), "another layout"),
])
def test_other_pieces_are_refused(spark, edit, message):
    with pytest.raises(Exception, match=message):
        D.read_document_pieces(edit(pieces_of(spark)[0]), ["g"]).collect()


def test_pieces_whose_weights_do_not_add_up(spark):
    with pytest.raises(Exception, match="add up"):
        D.read_document_pieces(pieces_of(spark, rows=lambda r: r.withColumn("normalized_weight", F.lit(0.3)))[0], ["g"]).collect()
