"""Routes as JSON, GeoJSON and GPX text, one value for each route."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import format_utc


#: How a GPX 1.1 file begins.
GPX_HEAD = '<?xml version="1.0" encoding="UTF-8"?><gpx version="1.1" creator="tidemark" xmlns="http://www.topografix.com/GPX/1/1">'


def finite_only(routes: DataFrame, columns: list[str]) -> DataFrame:
    """routes, with an error where a number isn't finite."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.isnan(c) | (F.abs(c) == float("inf"))
    checked = F.when(bad, F.raise_error(F.lit("a route number is not finite")).cast("boolean")).otherwise(F.lit(True))
    return routes.where(checked)


def _points(*fields: Column) -> Column:
    return F.transform(F.sort_array(F.collect_list(F.struct("seq", F.struct(*fields).alias("p")))), lambda x: x["p"])


def route_json(routes: DataFrame) -> DataFrame:
    """(request_id, json): the points in order."""
    p = _points(format_utc("time").alias("time"), F.struct(F.col("lat").alias("latitude"), F.col("lon").alias("longitude")).alias("position"), F.col("heading").alias("headingDegrees"), F.col("boat_speed").alias("boatSpeedKnots"), F.col("tws").alias("trueWindSpeedKnots"), F.col("twd").alias("trueWindDirectionDegrees"), F.col("cum_nm").alias("cumulativeDistanceNauticalMiles"))
    good = finite_only(routes, ["lat", "lon", "heading", "boat_speed", "tws", "twd", "cum_nm"])
    return good.groupBy("request_id").agg(p.alias("points")).select("request_id", F.to_json(F.struct("points")).alias("json"))


def route_documents(requests: DataFrame, routes: DataFrame, summary: DataFrame, forecast: str, polar: str) -> DataFrame:
    """(request_id, json): how each search ended, from where to where, what it was made of and did, and the points in order.

    requests: (request_id, depart) and departure_source where it is known. routes: as the
    searches give them. summary: (request_id, completion) and any of expanded, generated,
    retained, steps, settled, rounds, level, fallback. A request without points has a null
    arrival. An exhausted duration is written as an exhausted forecast with its reason beside
    it. An error where a number isn't finite.
    """
    points = [c for c in ("lat", "lon", "heading", "boat_speed", "tws", "twd", "cum_nm") if c in routes.columns]
    names = {"heading": "headingDegrees", "boat_speed": "boatSpeedKnots", "tws": "trueWindSpeedKnots", "twd": "trueWindDirectionDegrees", "cum_nm": "cumulativeDistanceNauticalMiles"}
    place = F.struct(F.col("lat").alias("latitude"), F.col("lon").alias("longitude"))
    p = _points(format_utc("time").alias("time"), place.alias("position"), *(F.col(c).alias(names[c]) for c in points[2:]))
    way = finite_only(routes, points).groupBy("request_id").agg(p.alias("points"))
    d = requests.join(summary, "request_id").join(way, "request_id", "left")
    partial = F.col("completion") == "duration_exhausted"
    end = lambda k, f: F.element_at("points", k)[f]
    source = F.col("departure_source") if "departure_source" in requests.columns else F.lit("explicit_time")
    counts = {"expanded": "expandedNodes", "generated": "generatedCandidates", "retained": "retainedCandidates", "steps": "timeSteps"}
    lattice = {"settled": "settledLabels", "rounds": "rounds", "level": "subdivisionLevel", "fallback": "fallbackReason"}
    facts = lambda of: F.struct(*(F.col(c).alias(n) for c, n in of.items() if c in summary.columns))
    parts = [
        F.when(partial, "forecast_exhausted").otherwise(F.col("completion")).alias("completion"),
        F.when(partial, F.col("completion")).alias("partial_reason"),
        F.struct(format_utc("depart").alias("time"), source.alias("source"), end(1, "position").alias("position")).alias("departure"),
        F.struct(end(-1, "time").alias("time"), end(-1, "position").alias("position")).alias("arrival"),
        F.struct(F.lit(forecast).alias("source")).alias("forecast"),
        F.struct(F.lit(polar).alias("source")).alias("polar"),
        *([facts(counts).alias("diagnostics")] if any(c in summary.columns for c in counts) else []),
        *([facts(lattice).alias("latticeDiagnostics")] if any(c in summary.columns for c in lattice) else []),
        F.coalesce("points", F.array().cast(way.schema["points"].dataType)).alias("points"),
    ]
    return d.select("request_id", F.to_json(F.struct(*parts)).alias("json"))


def isochrone_geojson(points: DataFrame) -> DataFrame:
    """(request_id, time, json): a LineString for each isochrone of (request_id, time, seq, lat, lon); a lone point is doubled."""
    line = F.transform(F.sort_array(F.collect_list(F.struct("seq", "lat", "lon"))), lambda x: F.array(x["lon"], x["lat"]))
    g = finite_only(points, ["lat", "lon"]).groupBy("request_id", "time").agg(line.alias("line"))
    line = F.when(F.size("line") == 1, F.concat("line", "line")).otherwise(F.col("line"))
    geometry = F.struct(F.lit("LineString").alias("type"), line.alias("coordinates"))
    return g.select("request_id", "time", F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(format_utc("time").alias("time")).alias("properties"), geometry.alias("geometry"))).alias("json"))


def _whole(line: Column, closed: Column) -> Column:
    """A line as it is written: closed ones and lone points end where they begin."""
    return F.when(closed | (F.size(line) == 1), F.concat(line, F.slice(line, 1, 1))).otherwise(line)


def _parts(lines: DataFrame, fields: list[Column]) -> DataFrame:
    """(request_id, time, kept, parts): for each isochrone its parts in order, each an array of its points."""
    point = F.transform(F.sort_array(F.collect_list(F.struct("seq", F.struct(*fields).alias("p")))), lambda x: x["p"])
    good = finite_only(lines, ["lat", "lon"])
    part = good.groupBy("request_id", "time", "part").agg(point.alias("line"), F.max("closed").alias("closed"), F.max("kept").alias("kept"))
    part = part.withColumn("line", _whole(F.col("line"), F.col("closed")))
    return part.groupBy("request_id", "time").agg(F.max("kept").alias("kept"), F.transform(F.sort_array(F.collect_list(F.struct("part", "line"))), lambda x: x["line"]).alias("parts"))


def isochrones_geojson(lines: DataFrame) -> DataFrame:
    """(request_id, json): a FeatureCollection with a feature for each time.

    lines: (request_id, time, part, seq, lat, lon, closed, kept), as split_at_antimeridian gives
    them; kept: how many points the isochrone has. One part is a LineString, several are a
    MultiLineString.
    """
    g = _parts(lines, [F.col("lon").alias("x"), F.col("lat").alias("y")])
    pairs = lambda line: F.transform(line, lambda p: F.array(p["x"], p["y"]))
    many = F.size("parts") != 1
    text = F.when(many, F.to_json(F.transform("parts", pairs))).otherwise(F.to_json(pairs(F.get("parts", F.lit(0)))))
    kind = F.when(many, F.lit("MultiLineString")).otherwise(F.lit("LineString"))
    feature = F.concat(F.lit('{"type":"Feature","properties":{"time":"'), format_utc("time"), F.lit('","retainedPointCount":'), F.col("kept").cast("string"), F.lit('},"geometry":{"type":"'), kind, F.lit('","coordinates":'), text, F.lit("}}"))
    every = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("time", feature.alias("f")))), lambda x: x["f"]), ",")
    return g.groupBy("request_id").agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), every, F.lit("]}")).alias("json"))


def isochrones_gpx(lines: DataFrame, about: str = "", started: Column | None = None) -> DataFrame:
    """(request_id, gpx): GPX 1.1 with a track for each time and a segment for each part of its line; lines as isochrones_geojson takes them.

    about: the description of the file. started: its time, by default that of the first isochrone.
    """
    g = _parts(lines, [coordinate("lat").alias("lat"), coordinate("lon").alias("lon"), format_utc("time").alias("t")])
    point = lambda p: F.concat(F.lit('<trkpt lat="'), p["lat"], F.lit('" lon="'), p["lon"], F.lit('"><time>'), p["t"], F.lit("</time></trkpt>"))
    segments = F.array_join(F.transform("parts", lambda line: F.concat(F.lit("<trkseg>"), F.array_join(F.transform(line, point), ""), F.lit("</trkseg>"))), "")
    track = F.concat(F.lit("<trk><name>isochrone "), format_utc("time"), F.lit("</name><desc>Retained frontier with "), F.col("kept").cast("string"), F.lit(" points</desc>"), segments, F.lit("</trk>"))
    every = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("time", track.alias("t")))), lambda x: x["t"]), "")
    first = format_utc("_first") if started is None else format_utc(started)
    g = g.groupBy("request_id").agg(every.alias("_t"), F.min("time").alias("_first"))
    head = F.concat(F.lit(GPX_HEAD + "<metadata><name>isochrones</name><desc>"), xml_escape(F.lit(about)), F.lit("</desc><time>"), first, F.lit("</time></metadata>"))
    return g.select("request_id", F.concat(head, F.col("_t"), F.lit("</gpx>")).alias("gpx"))


def xml_escape(x: Column) -> Column:
    """Text for XML: the five marks as entities; an error for a character that XML has no place for."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.when(x.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\uFFFE\uFFFF]"), F.raise_error(F.lit("a character that XML can't hold"))).otherwise(x)


def coordinate(x: str) -> Column:
    """Ten decimals without trailing zeros."""
    return F.regexp_replace(F.format_string("%.10f", F.col(x)), r"\.?0+$", "")


def route_gpx(routes: DataFrame, name: str = "route") -> DataFrame:
    """(request_id, gpx): GPX 1.1 with one track point for each route point."""
    point = F.concat(F.lit('<trkpt lat="'), coordinate("lat"), F.lit('" lon="'), coordinate("lon"), F.lit('"><time>'), format_utc("time"), F.lit("</time></trkpt>"))
    p = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", point.alias("x")))), lambda s: s["x"]), "")
    g = finite_only(routes, ["lat", "lon"]).groupBy("request_id").agg(p.alias("points"))
    return g.select("request_id", F.concat(F.lit(GPX_HEAD + "<trk><name>"), xml_escape(F.lit(name)), F.lit("</name><trkseg>"), F.col("points"), F.lit("</trkseg></trk></gpx>")).alias("gpx"))
