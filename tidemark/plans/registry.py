"""Named queries over the test tables and their SQL counterparts.

Positions, winds and weights are derived from keys without randomness, so that Spark
and the SQL engine see the same inputs. Floats are rounded to six digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import geodesy as G
from tidemark.functions import sailing as S
from tidemark.functions import text as X
from tidemark.functions.polar import Polar
from tidemark.operators import contours as C
from tidemark.operators import ensemble as E
from tidemark.operators import environment as V
from tidemark.operators import exclusions as N
from tidemark.operators import front as D
from tidemark.operators import interpolation as I
from tidemark.operators import lattice as L
from tidemark.operators import lattice_search as T
from tidemark.operators import policy as P
from tidemark.operators import ranking as K
from tidemark.operators import spatial as Z
from tidemark.operators.ensemble_search import ensemble_search
from tidemark.operators.frontier import Options, search
from tidemark.operators.shared import Steps
from tidemark.operators.transition import target_legs as fixed_legs
from tidemark.sources import ensemble_documents as M
from tidemark.sources import route_files

from . import sql as Q

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _lat(k) -> Column:
    return ((G.c(k) if not isinstance(k, Column) else k) * 37 % 1600).cast("double") / 10.0 - 80.0


def _lon(k) -> Column:
    return ((G.c(k) if not isinstance(k, Column) else k) * 91 % 3600).cast("double") / 10.0 - 180.0


def _r(x: Column, name: str, digits: int = 6) -> Column:
    return (F.round(x, digits) + 0.0).alias(name)


def _legs(spark: SparkSession, d: str, table: str = "supplier", key: str = "s_suppkey") -> DataFrame:
    k = F.col(key)
    return _t(spark, d, table).select(k.alias("k"), _lat(k).alias("lat1"), _lon(k).alias("lon1"), _lat(k + 7).alias("lat2"), _lon(k + 7).alias("lon2"))


_LEGS = f"(SELECT s_suppkey AS k, {Q.lat('s_suppkey')} AS lat1, {Q.lon('s_suppkey')} AS lon1, {Q.lat('s_suppkey + 7')} AS lat2, {Q.lon('s_suppkey + 7')} AS lon2 FROM supplier)"
_CUST = f"(SELECT c_custkey AS k, c_nationkey, c_acctbal, {Q.lat('c_custkey')} AS lat, {Q.lon('c_custkey')} AS lon FROM customer)"


def _customers(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_nationkey", "c_acctbal", _lat(F.col("c_custkey")).alias("lat"), _lon(F.col("c_custkey")).alias("lon"))


# --- geodesy -----------------------------------------------------------------


@query(f"SELECT k, {Q.r(Q.dist('lat1', 'lon1', 'lat2', 'lon2'), 'nm')} FROM {_LEGS}")
def haversine_legs(spark: SparkSession, d: str) -> DataFrame:
    return _legs(spark, d).select("k", _r(G.distance_nm("lat1", "lon1", "lat2", "lon2"), "nm"))


@query(f"SELECT k, {Q.r(Q.bearing('lat1', 'lon1', 'lat2', 'lon2'), 'bearing')} FROM {_LEGS}")
def initial_bearing(spark: SparkSession, d: str) -> DataFrame:
    return _legs(spark, d).select("k", _r(G.initial_bearing("lat1", "lon1", "lat2", "lon2"), "bearing"))


@query(f"SELECT k, {Q.r(Q.to_lat('lat1', '(k * 17) % 360', '(k % 90) + 1e0'), 'lat')}, {Q.r(Q.to_lon('lat1', 'lon1', '(k * 17) % 360', '(k % 90) + 1e0'), 'lon')} FROM {_LEGS}")
def destination_point(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    df = _legs(spark, d).withColumn("to", G.destination("lat1", "lon1", k * 17 % 360, k % 90 + 1.0))
    return df.select("k", _r(F.col("to.lat"), "lat"), _r(F.col("to.lon"), "lon"))


@query(f"SELECT k, {Q.r(Q.diff('(k * 53) % 720 - 360', '(k * 29) % 360'), 'diff')}, {Q.r(Q.norm('(k * 53) % 1440 - 720e0'), 'norm')}, coalesce(abs(lat1) <= 90 AND abs(lon1) <= 180, false) AS valid FROM {_LEGS}")
def angular_diff(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    return _legs(spark, d).select("k", _r(G.angular_difference((k * 53 % 720 - 360).cast("double"), (k * 29 % 360).cast("double")), "diff"), _r(G.normalize_degrees(k * 53 % 1440 - 720.0), "norm"), G.is_valid_position("lat1", "lon1").alias("valid"))


@query(f"SELECT k, {Q.r('degrees(acos(greatest(-1e0, least(1e0, sin(radians(lat1)) * sin(radians(lat2)) + cos(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2 - lon1))))))', 'arc', 4)}, {Q.r('cos(radians(lat1)) * cos(radians(lon1))', 'x')}, {Q.r('cos(radians(lat1)) * sin(radians(lon1))', 'y')}, {Q.r('sin(radians(lat1))', 'z')} FROM {_LEGS}")
def unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    df = _legs(spark, d).withColumn("a", G.unit_vector("lat1", "lon1")).withColumn("b", G.unit_vector("lat2", "lon2"))
    return df.select("k", _r(F.degrees(G.angle_between(F.col("a"), F.col("b"))), "arc", 4), *(_r(F.get("a", F.lit(i)), n) for i, n in enumerate("xyz")))


# --- wind, current, sea --------------------------------------------------------

_UV = "(SELECT o_orderkey AS k, (o_orderkey * 7) % 41 - 20e0 AS u, (o_orderkey * 11) % 37 - 18e0 AS v, (o_orderkey * 13) % 360 + 0e0 AS h, (o_orderkey * 29) % 360 + 0e0 AS h2 FROM orders)"


def _uv(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return _t(spark, d, "orders").select(k.alias("k"), (k * 7 % 41 - 20.0).alias("u"), (k * 11 % 37 - 18.0).alias("v"), (k * 13 % 360 + 0.0).alias("h"), (k * 29 % 360 + 0.0).alias("h2"))


@query(f"SELECT k, {Q.r(Q.speed('u', 'v'), 'tws')}, {Q.r(Q.wind_from('u', 'v'), 'twd')} FROM {_UV}")
def wind_polar_form(spark: SparkSession, d: str) -> DataFrame:
    return _uv(spark, d).select("k", _r(S.wind_speed("u", "v"), "tws"), _r(S.wind_from("u", "v"), "twd"))


@query(f"SELECT k, side, side2, CASE WHEN side = 0 OR side2 = 0 OR side = side2 THEN 0 WHEN (a + a2) / 2 >= 90 THEN 40 ELSE 25 END::BIGINT AS lost FROM (SELECT k, {Q.side('h', '70e0')} AS side, {Q.side('h2', '70e0')} AS side2, {Q.diff('h', '70e0')} AS a, {Q.diff('h2', '70e0')} AS a2 FROM {_UV})")
def board_and_maneuver(spark: SparkSession, d: str) -> DataFrame:
    df = _uv(spark, d).select("k", S.board("h", F.lit(70.0)).alias("side"), S.board("h2", F.lit(70.0)).alias("side2"), G.angular_difference("h", F.lit(70.0)).alias("a"), G.angular_difference("h2", F.lit(70.0)).alias("a2"))
    return df.select("k", "side", "side2", S.maneuver_delay("side", "side2", "a", "a2", 25, 40).alias("lost"))


_E, _N = "(6 * sin(radians(h)) + u / 10)", "(6 * cos(radians(h)) + v / 10)"


@query(f"SELECT k, {Q.r(f'sqrt({_E} * {_E} + {_N} * {_N})', 'sog')}, {Q.r(Q.norm(f'degrees(atan2({_E}, {_N}))'), 'cog', 5)}, {Q.r('sqrt(u * u + v * v)', 'drift')}, {Q.r(f'CASE WHEN u = 0 AND v = 0 THEN 0e0 ELSE {Q.norm("degrees(atan2(u, v))")} END', 'set_to')} FROM {_UV}")
def ground_velocity(spark: SparkSession, d: str) -> DataFrame:
    df = _uv(spark, d).withColumn("g", S.ground_velocity("h", F.lit(6.0), F.col("u") / 10, F.col("v") / 10))
    return df.select("k", _r(F.col("g.sog"), "sog"), _r(F.col("g.cog"), "cog", 5), _r(S.current_speed("u", "v"), "drift"), _r(S.current_set("u", "v"), "set_to"))


_SH = "(-(u * cos(radians(h)) - v * sin(radians(h))) / 12e0)"


@query(f"SELECT k, {Q.r(f'CASE WHEN abs({_SH}) <= 1 THEN degrees(asin({_SH})) END', 'course_offset', 5)} FROM {_UV}")
def course_to_steer_offset(spark: SparkSession, d: str) -> DataFrame:
    return _uv(spark, d).select("k", _r(S.course_to_steer_offset("h", F.lit(12.0), "u", "v"), "course_offset", 5))


_RA = "(180e0 - " + Q.diff("h", "h2") + ")"
_DER = f"(8 * (1 - greatest(0e0, least(0.6e0, 0.03e0 * power((k % 60) / 10e0, 1.5e0) * (1 + abs(cos(radians({_RA}))) * ((CASE WHEN cos(radians({_RA})) >= 0 THEN 0.35e0 ELSE 1.6e0 END) - 1))))))"


@query(f"SELECT k, {Q.r(_RA, 'angle')}, {Q.r(f'CASE WHEN k % 60 > 0 THEN {_DER} ELSE 8e0 END', 'derated')} FROM {_UV}")
def wave_derating(spark: SparkSession, d: str) -> DataFrame:
    df = _uv(spark, d).withColumn("angle", S.relative_wave_angle("h", "h2"))
    slow = S.derated_speed(F.lit(8.0), F.col("k") % 60 / 10.0, "angle", F.lit(8.0))
    return df.select("k", _r(F.col("angle"), "angle"), _r(S.checked_derating(slow, 8.0), "derated"))


@query()
def heading_under_current(spark: SparkSession, d: str) -> DataFrame:
    """Water heading that makes good a track, where boat speed follows the heading: fixed point, no SQL form."""
    p = Polar.builtin()
    speed = lambda h: p.speed(G.angular_difference(h, F.lit(40.0)), F.lit(16.0))
    return _uv(spark, d).select("k", _r(S.solve_heading("h", speed, F.col("u") / 10, F.col("v") / 10), "heading"))


@query()
def arrival_fractions(spark: SparkSession, d: str) -> DataFrame:
    """Share of a leg at which it enters the radius around its destination: bisection, no SQL form."""
    k = F.col("k")
    df = _legs(spark, d)
    hdg = G.initial_bearing("lat1", "lon1", "lat2", "lon2") + (k % 7 - 3).cast("double") / 10
    return df.select("k", _r(G.arrival_fraction("lat1", "lon1", "lat2", "lon2", hdg, G.distance_nm("lat1", "lon1", "lat2", "lon2") * 1.01, 5.0), "fraction"))


# --- buckets ---------------------------------------------------------------------

_EAST = f"({Q.wrap('lon - (-30.05e0)')} * 60 * cos(radians((lat + 20.05e0) / 2)))"


@query(f"SELECT k, floor({_EAST} / 3.1e0)::BIGINT AS east, floor((lat - 20.05e0) * 60 / 3.1e0)::BIGINT AS north FROM {_CUST}")
def planar_bucket(spark: SparkSession, d: str) -> DataFrame:
    return _customers(spark, d).withColumn("b", G.planar_bucket("lat", "lon", 20.05, -30.05, 3.1)).select("k", "b.east", "b.north")


@query(f"SELECT k, floor({Q.bearing('20.05e0', '-30.05e0', 'lat', 'lon')} / 5.3e0)::BIGINT AS sector, floor({Q.dist('lat', 'lon', '20.05e0', '-30.05e0')} / 3.1e0)::BIGINT AS ring FROM {_CUST}")
def sector_bucket(spark: SparkSession, d: str) -> DataFrame:
    return _customers(spark, d).withColumn("b", G.sector_bucket("lat", "lon", 20.05, -30.05, 3.1, 5.3)).select("k", "b.sector", "b.ring")


@query(f"SELECT k, round(cos(radians(lat)) * cos(radians(lon)) * {Q.R} / 7.3e0)::BIGINT AS bx, round(cos(radians(lat)) * sin(radians(lon)) * {Q.R} / 7.3e0)::BIGINT AS by_, round(sin(radians(lat)) * {Q.R} / 7.3e0)::BIGINT AS bz FROM {_CUST}")
def position_keys(spark: SparkSession, d: str) -> DataFrame:
    df = _customers(spark, d).withColumn("b", G.position_key("lat", "lon", 7.3))
    return df.select("k", *(F.get("b", F.lit(i)).alias(n) for i, n in enumerate(("bx", "by_", "bz"))))


@query("SELECT event_id, (floor(epoch(ts))::BIGINT // 5400)::BIGINT AS bucket, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS utc, date_trunc('second', ts) AS back FROM events")
def time_text(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events")
    utc = X.format_utc("ts")
    return e.select("event_id", G.time_bucket(F.unix_timestamp("ts"), 5400).alias("bucket"), utc.alias("utc"), X.parse_utc(utc).alias("back"))


# --- grids ------------------------------------------------------------------------

_SPEC = I.GridSpec(-90.0, -180.0, 5.0, 5.0, 37, 72, wraps=True)
_TIMES = 6


def _wind(spark: SparkSession) -> DataFrame:
    """Six-hourly slices on a 5-degree grid with whole-number winds."""
    base = F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    g = spark.range(_TIMES * 37 * 72).select((F.col("id") % 72).cast("int").alias("i"), (F.floor(F.col("id") / 72) % 37).cast("int").alias("j"), F.floor(F.col("id") / (72 * 37)).cast("int").alias("t"))
    i, j, t = F.col("i"), F.col("j"), F.col("t")
    return g.select(F.timestamp_seconds(base + t * 21600).alias("valid_time"), "j", "i", ((7 * j + 3 * i + 5 * t) % 41 - 20.0).alias("u"), ((11 * j + 5 * i + 3 * t) % 37 - 18.0).alias("v"))


_CELLS = "(SELECT k, s, (floor((lat + 90) / 5e0) + dj)::BIGINT AS j, (floor((lon + 180) / 5e0) + di)::BIGINT % 72 AS i, (CASE WHEN dj = 0 THEN 1 - ((lat + 90) / 5e0 - floor((lat + 90) / 5e0)) ELSE (lat + 90) / 5e0 - floor((lat + 90) / 5e0) END) * (CASE WHEN di = 0 THEN 1 - ((lon + 180) / 5e0 - floor((lon + 180) / 5e0)) ELSE (lon + 180) / 5e0 - floor((lon + 180) / 5e0) END) AS w, t FROM {rows}, (VALUES (0), (1)) AS a(dj), (VALUES (0), (1)) AS b(di))"
_UVT = "((7 * j + 3 * i + 5 * t) % 41 - 20e0)", "((11 * j + 5 * i + 3 * t) % 37 - 18e0)"


@query(f"SELECT k, {Q.r(f'sum(w * {_UVT[0]})', 'u')}, {Q.r(f'sum(w * {_UVT[1]})', 'v')} FROM {_CELLS.format(rows=f'(SELECT k, lat, lon, 0 AS t, 1e0 AS s FROM {_CUST})')} GROUP BY k")
def wind_bilinear(spark: SparkSession, d: str) -> DataFrame:
    first = _wind(spark).where(F.col("valid_time") == F.lit("2024-01-01 00:00:00").cast("timestamp"))
    got = I.bilinear(_customers(spark, d), "k", first, _SPEC, ["u", "v"])
    return got.select("k", _r(F.col("u"), "u"), _r(F.col("v"), "v"))


_EV = f"(SELECT event_id AS k, ts, {Q.lat('event_id')} AS lat, {Q.lon('event_id')} AS lon, epoch(date_trunc('second', ts)) - epoch(TIMESTAMP '2024-01-01 00:00:00') AS e FROM events)"
_EVT = f"(SELECT k, lat, lon, (floor(e / 21600e0) + dt)::BIGINT AS t, CASE WHEN dt = 0 THEN 1 - (e / 21600e0 - floor(e / 21600e0)) ELSE e / 21600e0 - floor(e / 21600e0) END AS s FROM {_EV}, (VALUES (0), (1)) AS c(dt) WHERE e BETWEEN 0 AND 108000)"


@query(
    f"SELECT ev.k, g.u, g.v, CASE WHEN e BETWEEN 0 AND 108000 THEN 'ok' ELSE 'out_of_time' END AS status FROM {_EV} ev LEFT JOIN (SELECT k, {Q.r(f'sum(s * w * {_UVT[0]})', 'u')}, {Q.r(f'sum(s * w * {_UVT[1]})', 'v')} FROM {_CELLS.format(rows=_EVT)} GROUP BY k) g ON ev.k = g.k"
)
def wind_trilinear(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    rows = _t(spark, d, "events").select(k.alias("k"), F.date_trunc("second", "ts").alias("ts"), _lat(k).alias("lat"), _lon(k).alias("lon"))
    got = I.Field(_wind(spark), _SPEC, ["u", "v"]).at(rows, ["k"])
    return got.select("k", _r(F.col("u"), "u"), _r(F.col("v"), "v"), "status")


@query("SELECT event_id, CASE WHEN t1 IS NOT NULL THEN t0 END AS t0, t1, round((epoch(date_trunc('second', ts)) - epoch(t0)) / (epoch(t1) - epoch(t0)), 9) AS share FROM events ASOF LEFT JOIN (SELECT TIMESTAMP '2024-01-02 00:00:00' + INTERVAL (a * a * 3) HOUR AS t0, CASE WHEN a < 9 THEN TIMESTAMP '2024-01-02 00:00:00' + INTERVAL ((a + 1) * (a + 1) * 3) HOUR END AS t1 FROM range(10) AS r(a)) s ON date_trunc('second', ts) >= t0")
def time_bracket_asof(spark: SparkSession, d: str) -> DataFrame:
    base = F.unix_timestamp(F.lit("2024-01-02 00:00:00").cast("timestamp"))
    slices = spark.range(10).select(F.timestamp_seconds(base + F.col("id") * F.col("id") * 10800).alias("valid_time"))
    e = _t(spark, d, "events").select("event_id", F.date_trunc("second", "ts").alias("ts"))
    got = I.time_brackets(e, I.time_slices(slices).where("t1 is not null"), "ts")
    return got.select("event_id", "t0", "t1", F.round("share", 9).alias("share"))


_BE = "(sin(radians(h)) * (1 - t) + sin(radians(h2)) * t)"
_BN = "(cos(radians(h)) * (1 - t) + cos(radians(h2)) * t)"


@query(f"SELECT k, {Q.r(f'CASE WHEN power({_BE}, 2) + power({_BN}, 2) < 1e-24 THEN h ELSE {Q.norm(f'degrees(atan2({_BE}, {_BN}))')} END % 360', 'direction', 5)}, {Q.r('u + t * (v - u)', 'lerp')} FROM (SELECT *, (k % 7) / 8e0 AS t FROM {_UV})")
def direction_vector_blend(spark: SparkSession, d: str) -> DataFrame:
    df = _uv(spark, d).withColumn("t", F.col("k") % 7 / 8.0)
    return df.select("k", _r(I.blend_directions("h", "h2", "t") % 360, "direction", 5), _r(F.col("u") + F.col("t") * (F.col("v") - F.col("u")), "lerp"))


def _tiles(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "lineitem").select(F.col("l_linenumber").alias("tile"), F.date_trunc("month", "l_shipdate").alias("valid_time"), (F.col("l_partkey") % 40).cast("long").alias("j"), (F.col("l_suppkey") % 40).cast("long").alias("i"), F.when(F.col("l_quantity") > 2, F.col("l_quantity")).alias("value"), F.lit(3.0).alias("packing_error"), "l_orderkey", "l_partkey")


_TILES = "(SELECT l_linenumber AS tile, date_trunc('month', l_shipdate) AS valid_time, (l_partkey % 40)::BIGINT AS j, (l_suppkey % 40)::BIGINT AS i, CASE WHEN l_quantity > 2 THEN l_quantity END AS value FROM lineitem)"
_TILE1 = f"(SELECT tile, valid_time::TIMESTAMP AS valid_time, j, i, max(value) AS value FROM {_TILES} GROUP BY ALL)"


def _one_tile(spark: SparkSession, d: str) -> DataFrame:
    return _tiles(spark, d).groupBy("tile", "valid_time", "j", "i").agg(F.max("value").alias("value"), F.max("packing_error").alias("packing_error"))


@query(f"SELECT tile, valid_time, j, i, value, owner FROM (SELECT *, first_value(value) OVER w AS owner, row_number() OVER w AS n FROM {_TILE1} WHERE value IS NOT NULL WINDOW w AS (PARTITION BY valid_time, j, i ORDER BY tile)) WHERE n > 1 AND abs(value - owner) > 6 + 1e-6 * greatest(abs(value), abs(owner))")
def tile_mosaic_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return I.mosaic_conflicts(_one_tile(spark, d))


@query(f"SELECT valid_time, j, i, arg_min(value, tile) AS value FROM {_TILE1} WHERE value IS NOT NULL GROUP BY ALL")
def tile_mosaic(spark: SparkSession, d: str) -> DataFrame:
    return I.mosaic(_one_tile(spark, d))


@query(f"SELECT * FROM (SELECT valid_time, count(*) AS cells, ((max(j) - min(j) + 1) * (max(i) - min(i) + 1))::BIGINT AS expected FROM (SELECT DISTINCT valid_time, j, i FROM {_TILE1}) GROUP BY 1) WHERE cells <> expected")
def tile_gaps(spark: SparkSession, d: str) -> DataFrame:
    return I.mosaic_gaps(_one_tile(spark, d))


# --- boat speeds -----------------------------------------------------------------

_LINE = "(SELECT l_orderkey, l_linenumber, l_quantity * 0.9e0 + 0.01371e0 AS w, ((l_partkey * 7) % 1810) / 10e0 + 0.00317e0 AS a FROM lineitem)"
_B = f"""
pol AS (SELECT * FROM {Q.polar_rows()}),
tw AS (SELECT tws AS w0, lead(tws) OVER (ORDER BY tws) AS w1 FROM (SELECT DISTINCT tws FROM pol)),
ta AS (SELECT twa AS a0, lead(twa) OVER (ORDER BY twa) AS a1 FROM (SELECT DISTINCT twa FROM pol)),
ln AS (SELECT *, least(w, 40e0) AS wc, least(a, 180e0) AS ac FROM {_LINE}),
br AS (SELECT ln.*, w0, w1, a0, a1, (wc - w0) / (w1 - w0) AS t FROM ln JOIN tw ON wc >= w0 AND (wc < w1 OR (w1 = 40 AND wc = 40)) JOIN ta ON ac >= a0 AND (ac < a1 OR (a1 = 180 AND ac = 180)))
"""


def _line(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("l_partkey") * 7 % 1810 / 10.0 + 0.00317
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 0.9 + 0.01371).alias("w"), F.least(a, F.lit(180.0)).alias("a"))


@query(f"WITH {_B} SELECT l_orderkey, l_linenumber, {Q.r('y0 + (ac - a0) / (a1 - a0) * (y1 - y0)', 'speed')}, w > 40 AS above FROM (SELECT br.*, p00.speed + t * (p01.speed - p00.speed) AS y0, p10.speed + t * (p11.speed - p10.speed) AS y1 FROM br JOIN pol p00 ON p00.twa = a0 AND p00.tws = w0 JOIN pol p01 ON p01.twa = a0 AND p01.tws = w1 JOIN pol p10 ON p10.twa = a1 AND p10.tws = w0 JOIN pol p11 ON p11.twa = a1 AND p11.tws = w1)")
def polar_linear(spark: SparkSession, d: str) -> DataFrame:
    p = Polar.builtin()
    return _line(spark, d).select("l_orderkey", "l_linenumber", _r(p.speed("a", "w"), "speed"), p.above_range("w").alias("above"))


@query()
def polar_pchip(spark: SparkSession, d: str) -> DataFrame:
    """Monotone-cubic lookup along the angle; checked against table values and monotonicity in tests."""
    return _line(spark, d).select("l_orderkey", "l_linenumber", _r(Polar.builtin().speed("a", "w", monotone=True), "speed"))


@query(f"WITH pol AS (SELECT * FROM {Q.polar_rows()}), ta AS (SELECT twa AS a0, lead(twa) OVER (ORDER BY twa) AS a1 FROM (SELECT DISTINCT twa FROM pol)), sw AS (SELECT p0.tws, a.a, (p0.speed + (a.a - a0) / (a1 - a0) * (p1.speed - p0.speed)) * cos(radians(a.a)) AS vmg FROM (SELECT range + 0e0 AS a FROM range(181)) a JOIN ta ON a.a >= a0 AND (a.a < a1 OR (a1 = 180 AND a.a = 180)) JOIN pol p0 ON p0.twa = a0 JOIN pol p1 ON p1.twa = a1 AND p1.tws = p0.tws WHERE p0.tws > 0) SELECT tws, round(max(vmg), 6) AS up_vmg, round(min(vmg), 6) AS down_vmg FROM sw GROUP BY tws")
def vmg_sweep(spark: SparkSession, d: str) -> DataFrame:
    p = Polar.builtin()
    rows = p.table(spark).where("tws > 0").select("tws").distinct().withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(180)))).withColumn("a", F.col("a").cast("double"))
    vmg = p.speed("a", "tws") * F.cos(F.radians("a"))
    return rows.groupBy("tws").agg(F.round(F.max(vmg), 6).alias("up_vmg"), F.round(F.min(vmg), 6).alias("down_vmg"))


@query()
def vmg_optimum(spark: SparkSession, d: str) -> DataFrame:
    """Best upwind and downwind angles by golden section."""
    return Polar.builtin().best_angles(spark).select("tws", *(_r(F.col(x), x, 5) for x in ("up_angle", "up_vmg", "down_angle", "down_vmg")))


# --- ensembles -------------------------------------------------------------------

_RANK = "CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 0 ELSE 3 END"
_OUT = f"(SELECT o_custkey % 97 AS run, l_linenumber AS choice, l_orderkey * 10 + l_linenumber AS member, l_quantity AS weight, CASE WHEN l_returnflag <> 'R' THEN epoch(l_shipdate) - epoch(o_orderdate) + 1e9 END AS elapsed, {_RANK} AS class_rank FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    j = _t(spark, d, "lineitem").join(_t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    took = (F.unix_timestamp("l_shipdate") - F.unix_timestamp("o_orderdate")).cast("double") + 1e9
    return j.select((F.col("o_custkey") % 97).alias("run"), F.col("l_linenumber").alias("choice"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("member"), F.col("l_quantity").alias("weight"), F.when(F.col("l_returnflag") != "R", took).alias("elapsed"), F.when(F.col("l_returnflag") == "R", 3).otherwise(0).alias("class_rank"))


@query(f"SELECT run, choice, CASE WHEN max(CASE WHEN elapsed IS NULL THEN 1 ELSE 0 END) = 1 THEN 'infinite' ELSE round(sum(weight * elapsed) / sum(weight), 3)::DECIMAL(18,3)::VARCHAR END AS mean, round(sum(CASE WHEN elapsed IS NULL THEN weight ELSE 0 END) / sum(weight), 6) AS incomplete_weight, round(sum(weight * elapsed) / sum(CASE WHEN elapsed IS NOT NULL THEN weight END), 3) AS finite_mean, max(elapsed) AS worst_finite FROM {_OUT} GROUP BY 1, 2")
def weighted_mean_arrival(spark: SparkSession, d: str) -> DataFrame:
    g = _outcomes(spark, d).groupBy("run", "choice").agg(E.weighted_mean().alias("m"), *E.audits())
    mean = F.when(F.col("m") == float("inf"), "infinite").otherwise(F.round("m", 3).cast("decimal(18,3)").cast("string"))
    return g.select("run", "choice", mean.alias("mean"), F.round("incomplete_weight", 6).alias("incomplete_weight"), F.round("finite_mean", 3).alias("finite_mean"), "worst_finite")


@query(f"WITH o AS (SELECT *, sum(weight::DECIMAL(28,10)) OVER (PARTITION BY run ORDER BY elapsed NULLS LAST, member ROWS UNBOUNDED PRECEDING) AS c, sum(weight::DECIMAL(28,10)) OVER (PARTITION BY run) AS a, row_number() OVER (PARTITION BY run ORDER BY elapsed NULLS LAST, member) AS n FROM {_OUT}) SELECT run, coalesce(arg_min(coalesce(elapsed, 'inf'::DOUBLE), n) FILTER (c * 4 >= a * 1)) AS p25, arg_min(coalesce(elapsed, 'inf'::DOUBLE), n) FILTER (c * 2 >= a) AS p50, arg_min(coalesce(elapsed, 'inf'::DOUBLE), n) FILTER (c * 4 >= a * 3) AS p75, arg_min(coalesce(elapsed, 'inf'::DOUBLE), n) FILTER (c * 10 >= a * 9) AS p90 FROM o GROUP BY run")
def weighted_p75_p90(spark: SparkSession, d: str) -> DataFrame:
    return E.nearest_rank(_outcomes(spark, d), ["run"], {"p25": (1, 4), "p50": (1, 2), "p75": (3, 4), "p90": (9, 10)})


@query(f"SELECT run, choice, round(sum(CASE WHEN elapsed < 1e9 THEN weight ELSE 0 END) / sum(weight), 6) AS p FROM {_OUT} GROUP BY 1, 2")
def prob_before_target(spark: SparkSession, d: str) -> DataFrame:
    return _outcomes(spark, d).groupBy("run", "choice").agg(F.round(E.probability_before(1e9), 6).alias("p"))


@query(f"SELECT a.run, round(sum(a.weight * (CASE WHEN a.class_rank < b.class_rank THEN 1e0 WHEN a.class_rank > b.class_rank THEN 0e0 WHEN a.class_rank = 0 AND a.elapsed < b.elapsed THEN 1e0 WHEN a.class_rank = 0 AND a.elapsed > b.elapsed THEN 0e0 ELSE 0.5e0 END)) / sum(a.weight), 6) AS score FROM (SELECT run, member // 10 AS member, weight, elapsed, class_rank FROM {_OUT} WHERE choice = 1) a JOIN (SELECT run, member // 10 AS member, elapsed, class_rank FROM {_OUT} WHERE choice = 2) b ON a.run = b.run AND a.member = b.member GROUP BY 1")
def rival_score(spark: SparkSession, d: str) -> DataFrame:
    o = _outcomes(spark, d).withColumn("member", F.floor(F.col("member") / 10).cast("long"))
    return E.rival_score(o.where("choice = 1"), o.where("choice = 2"), ["run"]).select("run", F.round("score", 6).alias("score"))


@query(f"WITH r AS (SELECT *, rank() OVER (PARTITION BY run, m ORDER BY class_rank, elapsed NULLS LAST) AS k FROM (SELECT *, member // 10 AS m FROM {_OUT})), w AS (SELECT *, count(*) OVER (PARTITION BY run, m) AS n FROM r WHERE k = 1) SELECT run, choice, round(sum(weight / n), 6) AS support FROM w GROUP BY 1, 2")
def member_support(spark: SparkSession, d: str) -> DataFrame:
    o = _outcomes(spark, d).withColumn("member", F.floor(F.col("member") / 10).cast("long"))
    return E.member_support(o, ["run"], "choice").select("run", "choice", F.round("support", 6).alias("support"))


@query(f"WITH m AS (SELECT run, choice, CASE WHEN bool_or(elapsed IS NULL AND weight > 0) THEN 'inf'::DOUBLE ELSE sum(weight * elapsed) / sum(weight) END AS mean FROM {_OUT} GROUP BY 1, 2) SELECT run, choice, CASE WHEN own IS NULL THEN NULL WHEN mean <= own THEN 'none' WHEN mean = 'inf'::DOUBLE THEN 'infinite' ELSE round(greatest(0e0, mean - own), 3)::DECIMAL(18,3)::VARCHAR END AS cost FROM (SELECT *, max(CASE WHEN choice = 1 THEN mean END) OVER (PARTITION BY run) AS own FROM m)")
def wrong_choice_cost(spark: SparkSession, d: str) -> DataFrame:
    """What each choice costs over the first; infinite where a member does not arrive."""
    got = E.wrong_choice_cost(_outcomes(spark, d), ["run"], "choice", F.lit(1))
    c = F.col("cost")
    text = F.when(c == 0, "none").when(c == float("inf"), "infinite").otherwise(F.round(c, 3).cast("decimal(18,3)").cast("string"))
    return got.select("run", "choice", text.alias("cost"))


@query(f"SELECT run, member, round(weight / sum(weight) OVER (PARTITION BY run), 9) AS share FROM {_OUT}")
def weight_normalisation(spark: SparkSession, d: str) -> DataFrame:
    return E.normalize_weights(_outcomes(spark, d), ["run"]).select("run", "member", F.round("normalized_weight", 9).alias("share"))


@query("SELECT count(DISTINCT n_regionkey) <= 1 AS same_n_regionkey, count(DISTINCT n_nationkey % 1) <= 1 AS same_zero FROM nation")
def alignment_check(spark: SparkSession, d: str) -> DataFrame:
    n = _t(spark, d, "nation").withColumn("zero", F.col("n_nationkey") % 1)
    return E.alignment(n, ["n_regionkey", "zero"])


@query("SELECT coalesce(a.k, b.k) AS member, CASE WHEN b.k IS NULL THEN 'missing' WHEN a.k IS NULL THEN 'unknown' WHEN b.n > 1 THEN 'repeated' ELSE 'contradictory' END AS fault FROM (SELECT c_custkey AS k FROM customer) a FULL JOIN (SELECT o_custkey AS k, count(*) AS n, bool_or(o_orderkey % 3 = 0 OR o_orderkey % 3 = 1 AND o_orderkey % 2 = 1) AS bad FROM orders GROUP BY 1) b ON a.k = b.k WHERE b.k IS NULL OR a.k IS NULL OR b.n > 1 OR b.bad")
def outcome_faults(spark: SparkSession, d: str) -> DataFrame:
    """Of every third order the arrival lacks its time; of every third one that failed each odd one has a time."""
    k = F.col("o_orderkey")
    rank = F.when(k % 3 == 1, 3).otherwise(0)
    rows = _t(spark, d, "orders").select(F.lit(0).alias("run"), F.col("o_custkey").alias("member"), rank.alias("class_rank"), F.when((k % 3 == 2) | (k % 3 == 1) & (k % 2 == 1), 1.0).alias("elapsed"))
    members = _t(spark, d, "customer").select(F.lit(0).alias("run"), F.col("c_custkey").alias("member"))
    return E.outcome_faults(rows, members, ["run"]).select("member", "fault")


_XYZ = "sum(w * cos(radians(lat)) * cos(radians(lon)))", "sum(w * cos(radians(lat)) * sin(radians(lon)))", "sum(w * sin(radians(lat)))"


@query(f"SELECT c_nationkey, round(degrees(atan2({_XYZ[2]}, sqrt({_XYZ[0]} * {_XYZ[0]} + {_XYZ[1]} * {_XYZ[1]}))), 5) + 0e0 AS lat, round(degrees(atan2({_XYZ[1]}, {_XYZ[0]})), 5) + 0e0 AS lon FROM (SELECT *, abs(c_acctbal) + 1 AS w FROM {_CUST}) GROUP BY 1")
def spherical_centroid(spark: SparkSession, d: str) -> DataFrame:
    lat, lon = E.spherical_centroid("lat", "lon", F.abs("c_acctbal") + 1)
    return _customers(spark, d).groupBy("c_nationkey").agg(_r(lat, "lat", 5), _r(lon, "lon", 5))


@query(f"SELECT c_nationkey, round(degrees(atan2(avg(sin(radians(lon))), avg(cos(radians(lon))))), 5) + 0e0 AS lon FROM {_CUST} GROUP BY 1")
def circular_mean_lon(spark: SparkSession, d: str) -> DataFrame:
    return _customers(spark, d).groupBy("c_nationkey").agg(_r(E.circular_mean("lon"), "lon", 5))


_TRI = "(SELECT o_custkey % 50 AS g, (o_orderkey % 97) + 0e0 AS ax, (o_orderkey % 89) + 0e0 AS ay, (o_orderkey % 83) + 0e0 AS bx, (o_orderkey % 79) + 0e0 AS by_, (o_orderkey % 73) + 0e0 AS cx, (o_orderkey % 71) + 0e0 AS cy FROM orders)"
_SIDE = "sqrt(power({a}x - {b}x, 2) + power({a}y{u} - {b}y{w}, 2))"


@query(f"SELECT g, round(1.05e0 * median(r), 6) AS alpha FROM (SELECT g, {_SIDE.format(a='a', b='b', u='', w='_')} * {_SIDE.format(a='b', b='c', u='_', w='')} * {_SIDE.format(a='c', b='a', u='', w='')} / (2 * abs((bx - ax) * (cy - ay) - (cx - ax) * (by_ - ay))) AS r FROM {_TRI} WHERE (bx - ax) * (cy - ay) <> (cx - ax) * (by_ - ay)) WHERE r > 0 GROUP BY 1")
def automatic_alpha(spark: SparkSession, d: str) -> DataFrame:
    """1.05 times the median circumradius of triangles."""
    k = F.col("o_orderkey")
    t = _t(spark, d, "orders").select((F.col("o_custkey") % 50).alias("g"), *((k % m + 0.0).alias(x) for m, x in ((97, "ax"), (89, "ay"), (83, "bx"), (79, "by"), (73, "cx"), (71, "cy"))))
    return Z.automatic_alpha(t, ["g"]).select("g", F.round("alpha", 6).alias("alpha"))


@query(f"WITH p AS (SELECT DISTINCT c_nationkey, round(lat, 0) AS lat, CASE WHEN round(lon, 0) = -180 THEN 180e0 ELSE round(lon, 0) END AS lon FROM {_CUST}), m AS (SELECT c_nationkey, avg(round(lat, 0)) AS lat0, degrees(atan2(sum(sin(radians(round(lon, 0)))), sum(cos(radians(round(lon, 0)))))) AS lon0 FROM {_CUST} GROUP BY 1) SELECT c_nationkey, lat + 0e0 AS lat, lon + 0e0 AS lon, {Q.r(Q.wrap('lon - lon0') + ' * 60 * cos(radians(lat0))', 'x', 4)}, {Q.r('(lat - lat0) * 60', 'y', 4)} FROM p JOIN m USING (c_nationkey)")
def planar_points(spark: SparkSession, d: str) -> DataFrame:
    """Places on a plane around each nation's middle."""
    c = _customers(spark, d).select("c_nationkey", F.round("lat", 0).alias("lat"), F.round("lon", 0).alias("lon"))
    return Z.planar_points(c, ["c_nationkey"]).select("c_nationkey", (F.col("lat") + 0.0).alias("lat"), (F.col("lon") + 0.0).alias("lon"), _r(F.col("x"), "x", 4), _r(F.col("y"), "y", 4))


# --- ranking -----------------------------------------------------------------------


@query("SELECT least(l_partkey % 500, l_suppkey) AS a, greatest(l_partkey % 500, l_suppkey) AS b, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) = 1")
def edge_multiplicity(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "lineitem").select((F.col("l_partkey") % 500).alias("a"), F.col("l_suppkey").alias("b"))
    return K.edge_multiplicity(e).where("n = 1")


@query("SELECT l_orderkey, l_linenumber, rank FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice, l_quantity DESC, l_orderkey, l_linenumber) AS rank FROM lineitem) WHERE rank <= 3")
def bucket_rank_topk(spark: SparkSession, d: str) -> DataFrame:
    top = K.top_k(_t(spark, d, "lineitem"), ["l_suppkey"], ["l_extendedprice", F.desc("l_quantity"), "l_orderkey", "l_linenumber"], 3)
    return top.select("l_orderkey", "l_linenumber", "rank")


_APART = "least(abs(heading - {h}) % 360, 360 - abs(heading - {h}) % 360)"


@query(
    f"WITH a AS (SELECT l_suppkey, l_orderkey, l_linenumber, (l_partkey * 10 % 360)::DOUBLE AS heading, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice, l_orderkey, l_linenumber) AS r FROM lineitem), b AS (SELECT *, {_APART.format(h='h1')} AS d FROM (SELECT *, max(CASE WHEN r = 1 THEN heading END) OVER (PARTITION BY l_suppkey) AS h1 FROM a)), c AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, r = 1 ORDER BY d DESC, r) AS n2 FROM b), e AS (SELECT *, least(d, {_APART.format(h='h2')}) AS d2 FROM (SELECT *, max(CASE WHEN r > 1 AND n2 = 1 THEN heading END) OVER (PARTITION BY l_suppkey) AS h2 FROM c)), f AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, r = 1 OR n2 = 1 ORDER BY d2 DESC, r) AS n3 FROM e) SELECT l_suppkey, l_orderkey, l_linenumber, heading, CASE WHEN r = 1 THEN 1 WHEN n2 = 1 THEN 2 ELSE 3 END::INT AS picked FROM f WHERE r = 1 OR n2 = 1 OR n3 = 1"
)
def diverse_heading_topk(spark: SparkSession, d: str) -> DataFrame:
    """The greedy heading-diverse choice of three."""
    li = _t(spark, d, "lineitem").withColumn("heading", (F.col("l_partkey") * 10 % 360).cast("double"))
    got = K.diverse_top_k(li, ["l_suppkey"], ["l_extendedprice", "l_orderkey", "l_linenumber"], "heading", 3)
    return got.select("l_suppkey", "l_orderkey", "l_linenumber", "heading", "picked")


_SECT = f"floor({Q.bearing('20.05e0', '-30.05e0', 'lat', 'lon')} / 5.3e0)::BIGINT"


@query(f"SELECT sector, k FROM (SELECT k, {_SECT} AS sector, row_number() OVER (PARTITION BY {_SECT} ORDER BY c_acctbal DESC, k) AS n FROM {_CUST}) WHERE n = 1")
def band_winner(spark: SparkSession, d: str) -> DataFrame:
    df = _customers(spark, d).withColumn("sector", G.sector_bucket("lat", "lon", 20.05, -30.05, 3.1, 5.3)["sector"])
    return K.band_winners(df, [], "sector", [F.desc("c_acctbal"), "k"]).select("sector", "k")


@query("WITH d AS (SELECT DISTINCT user_id, floor(epoch(ts))::BIGINT // 86400 AS band FROM events), g AS (SELECT *, band - row_number() OVER (PARTITION BY user_id ORDER BY band) AS g FROM d) SELECT user_id, min(band) AS run_start, max(band) AS run_end, count(*) AS n FROM g GROUP BY user_id, g")
def gaps_islands_runs(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events").select("user_id", F.floor(F.unix_timestamp("ts") / 86400).alias("band"))
    return K.contiguous_runs(e, ["user_id"], "band")


@query("SELECT l_orderkey, l_linenumber, round(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice ROWS UNBOUNDED PRECEDING), 4) AS cum FROM lineitem")
def route_cumulative(spark: SparkSession, d: str) -> DataFrame:
    got = K.running_total(_t(spark, d, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_extendedprice"], "l_quantity", "cum")
    return got.select("l_orderkey", "l_linenumber", F.round("cum", 4).alias("cum"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_extendedprice <= a.l_extendedprice AND b.l_discount <= a.l_discount AND (b.l_extendedprice < a.l_extendedprice OR b.l_discount < a.l_discount))")
def pareto_skyline(spark: SparkSession, d: str) -> DataFrame:
    return K.skyline(_t(spark, d, "lineitem"), "l_orderkey", ["l_extendedprice", "l_discount"], on=["l_orderkey"]).select("l_orderkey", "l_linenumber")


@query("SELECT user_id, event_id FROM (SELECT *, value < 20 AS ok, max(CASE WHEN value < 20 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id) AS hits FROM events) WHERE ok OR hits = 0")
def aperture_filter(spark: SparkSession, d: str) -> DataFrame:
    return K.within_aperture(_t(spark, d, "events"), ["user_id"], F.col("value") < 20).select("user_id", "event_id")


# --- zones, land, cells ---------------------------------------------------------------

_ZONES = "(SELECT a AS zone, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL (a * 31) HOUR AS active_from, CASE WHEN a % 5 > 0 THEN TIMESTAMP '2024-01-01 00:00:00' + INTERVAL (a * 31 + 20) HOUR END AS active_until, (a * 13) % 140 - 70e0 AS south, (a * 29) % 340 - 180e0 AS west FROM range(20) AS r(a))"


def _zones(spark: SparkSession) -> DataFrame:
    base, a = F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp")), F.col("id")
    z = spark.range(20).select(a.alias("zone"), F.timestamp_seconds(base + a * 31 * 3600).alias("active_from"), F.when(a % 5 > 0, F.timestamp_seconds(base + (a * 31 + 20) * 3600)).alias("active_until"), (a * 13 % 140 - 70.0).alias("south"), (a * 29 % 340 - 180.0).alias("west"))
    return z


@query(f"SELECT event_id, zone FROM (SELECT *, {Q.lat('event_id')} AS lat, {Q.lon('event_id')} AS lon FROM events) e JOIN {_ZONES} z ON e.ts >= active_from AND (active_until IS NULL OR e.ts < active_until) AND lat >= south AND lat < south + 20 AND lon >= west AND lon < west + 20")
def zone_active_points(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events").select("event_id", "ts", _lat(F.col("event_id")).alias("lat"), _lon(F.col("event_id")).alias("lon"))
    got = Z.active_zones(e, _zones(spark))
    return got.where("lat >= south and lat < south + 20 and lon >= west and lon < west + 20").select("event_id", "zone")


def _side(p: int, q: int) -> str:
    """Which side of the arc between two corners of a zone a point is on."""
    x, y, z = (f"({a} * {b} - {c} * {d})" for a, b, c, d in ((f"y{p}", f"z{q}", f"z{p}", f"y{q}"), (f"z{p}", f"x{q}", f"x{p}", f"z{q}"), (f"x{p}", f"y{q}", f"y{p}", f"x{q}")))
    return f"({x} * px + {y} * py + {z} * pz)"


_CORNERS = ", ".join(f"cos(radians({lat})) * cos(radians({lon})) AS x{i}, cos(radians({lat})) * sin(radians({lon})) AS y{i}, sin(radians({lat})) AS z{i}" for i, (lat, lon) in enumerate((("south", "west"), ("south", "west + 18"), ("south + 12", "west + 7"))))


@query(f"SELECT event_id, min(zone)::VARCHAR AS zone_id FROM (SELECT event_id, ts, cos(radians(lat)) * cos(radians(lon)) AS px, cos(radians(lat)) * sin(radians(lon)) AS py, sin(radians(lat)) AS pz FROM (SELECT *, {Q.lat('event_id')} + 0.031e0 AS lat, {Q.lon('event_id')} + 0.017e0 AS lon FROM events)) e JOIN (SELECT *, {_CORNERS} FROM (SELECT * FROM {_ZONES} WHERE zone < 10)) z ON e.ts >= active_from AND (active_until IS NULL OR e.ts < active_until) AND {_side(0, 1)} >= 0 AND {_side(1, 2)} >= 0 AND {_side(2, 0)} >= 0 GROUP BY 1")
def zone_polygon_points(spark: SparkSession, d: str) -> DataFrame:
    """The first zone, a spherical triangle, that holds each event's place while it is active."""
    corner = lambda dy, dx: F.struct((F.col("south") + dy).alias("lat"), (F.col("west") + dx).alias("lon"))
    outer = F.array(corner(0.0, 0.0), corner(0.0, 18.0), corner(12.0, 7.0))
    zones = _zones(spark).where("zone < 10").select(F.col("zone").cast("string").alias("zone_id"), F.lit(1).alias("revision"), "active_from", "active_until", F.array(F.struct(outer.alias("outer"), F.slice(F.array(outer), 1, 0).alias("holes"))).alias("polygons"))
    k = F.col("event_id")
    e = _t(spark, d, "events").select("event_id", "ts", (_lat(k) + 0.031).alias("lat"), (_lon(k) + 0.017).alias("lon"))
    return N.zones_at(e, "event_id", N.prepare_zones(zones)).select("event_id", "zone_id")


@query()
def segment_zone_filter(spark: SparkSession, d: str) -> DataFrame:
    """Legs that meet a spherical polygon while it is active: arcs have no short SQL form."""
    corner = lambda dy, dx: G.unit_vector(F.col("south") + dy, F.col("west") + dx)
    zones = _zones(spark).select(F.col("zone").alias("zone_id"), F.lit(1).alias("revision"), "active_from", "active_until", F.array(corner(0, 0), corner(0, 15), corner(15, 15), corner(15, 0)).alias("ring"))
    k = F.col("event_id")
    legs = _t(spark, d, "events").select(k.alias("k"), _lat(k).alias("lat1"), _lon(k).alias("lon1"), (_lat(k) + 4).alias("lat2"), (_lon(k) + 3).alias("lon2"), F.col("ts").alias("t1"), F.timestamp_seconds(F.unix_timestamp("ts") + 7200).alias("t2"))
    return N.segment_zone_hits(legs, "k", zones)


@query(f"SELECT k, (da + db - nm) / 2 >= 10 AS certified, (da + db - nm) / 2 < 10 AS undecided FROM (SELECT k, (k * 31) % 4000 / 2e0 AS da, (k * 17) % 4000 / 2e0 AS db, {Q.dist('lat1', 'lon1', 'lat1 + 1', 'lon1 + 1')} AS nm FROM {_LEGS})")
def landmask_certify_depth0(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    ok = Z.certified(k * 31 % 4000 / 2.0, k * 17 % 4000 / 2.0, G.distance_nm("lat1", "lon1", F.col("lat1") + 1, F.col("lon1") + 1), 10.0)
    return _legs(spark, d).select("k", ok.alias("certified"), (~ok).alias("undecided"))


_ICO = "WITH ring AS (SELECT k, 2 / sqrt(5e0) * cos(radians(36e0 * k)) AS x, 2 / sqrt(5e0) * sin(radians(36e0 * k)) AS y, (CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) / sqrt(5e0) AS z FROM range(10) AS r(k)), cells AS (SELECT k AS cell, x, y, z FROM ring UNION ALL SELECT 10, 0e0, 0e0, 1e0 UNION ALL SELECT 11, 0e0, 0e0, -1e0)"


@query(f"{_ICO} SELECT k, arg_min(cell, (-round(d, 12), cell))::BIGINT AS cell FROM (SELECT c.k, cell, cos(radians(lat)) * cos(radians(lon)) * x + cos(radians(lat)) * sin(radians(lon)) * y + sin(radians(lat)) * z AS d FROM {_CUST} c, cells) GROUP BY k")
def nearest_cell(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id")
    ring = spark.range(10).select(k.alias("cell"), F.array(*(2 / F.sqrt(F.lit(5.0)) * f(F.radians(36.0 * k)) for f in (F.cos, F.sin)), F.when(k % 2 == 0, 1).otherwise(-1) / F.sqrt(F.lit(5.0))).alias("x"))
    poles = spark.createDataFrame([(10, [0.0, 0.0, 1.0]), (11, [0.0, 0.0, -1.0])], "cell long, x array<double>")
    return Z.nearest_cell(_customers(spark, d).withColumn("v", G.unit_vector("lat", "lon")), "k", ring.union(poles))


@query()
def containing_face(spark: SparkSession, d: str) -> DataFrame:
    """Face of a 320-face icosphere each customer lies in."""
    v = _customers(spark, d).select("k", G.unit_vector("lat", "lon").alias("v"))
    return v.select("k", L.face_at(F.col("v"), 2)["face"].alias("face"))


@query("SELECT q.vec_id, arg_min(c.label, (-round(d, 9), c.label)) AS label FROM (SELECT q.vec_id, c.label, sum(q.x::DOUBLE * c.x) AS d FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS p FROM embeddings) q JOIN (SELECT label, p, avg(x::DOUBLE) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS p FROM embeddings) GROUP BY label, p) c ON q.p = c.p GROUP BY q.vec_id, c.label) q, LATERAL (SELECT q.label AS label) c GROUP BY q.vec_id")
def embedding_argmax(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "embeddings")
    mean = e.select("label", F.posexplode("embedding").alias("p", "x")).groupBy("label", "p").agg(F.avg(F.col("x").cast("double")).alias("x"))
    cells = mean.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "x"))), lambda s: s["x"]).alias("c"))
    j = e.select("vec_id", "embedding").join(I.small(cells), F.lit(True))
    score = F.aggregate(F.zip_with("embedding", "c", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    return j.groupBy("vec_id").agg(F.min_by("label", F.struct((-F.round(score, 9)).alias("d"), F.col("label"))).alias("label"))


# --- graphs, routes, policies ---------------------------------------------------------


@query("WITH RECURSIVE n AS (SELECT o_orderkey AS id, (o_orderkey + 1) // 2 - 1 AS parent FROM orders WHERE o_orderkey > 0), p AS (SELECT id, id AS root, 0 AS depth FROM n WHERE parent NOT IN (SELECT id FROM n) UNION ALL SELECT n.id, p.root, p.depth + 1 FROM n JOIN p ON n.parent = p.id) SELECT id, root, depth::BIGINT AS depth FROM p")
def route_reconstruct(spark: SparkSession, d: str) -> DataFrame:
    n = _t(spark, d, "orders").where("o_orderkey > 0").select(F.col("o_orderkey").alias("id"), (F.floor((F.col("o_orderkey") + 1) / 2) - 1).alias("parent"))
    return P.root_paths(n)


_PATHS = "(SELECT o_custkey AS route, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq, o_orderpriority AS action, 1e0 AS weight FROM orders)"


def _paths(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return _t(spark, d, "orders").select(F.col("o_custkey").alias("route"), F.row_number().over(w).alias("seq"), F.col("o_orderpriority").alias("action"), F.lit(1.0).alias("weight"))


_GRAPH = f"WITH p AS (SELECT *, sha256(string_agg(action, '>') OVER (PARTITION BY route ORDER BY seq ROWS UNBOUNDED PRECEDING)) AS node FROM {_PATHS}), q AS (SELECT *, lead(node) OVER (PARTITION BY route ORDER BY seq) AS nxt FROM p), g AS (SELECT node, min(seq)::BIGINT AS depth, count(*) AS routes, sum(weight) AS support, count(DISTINCT nxt) AS branches FROM q GROUP BY node)"


@query(f"{_GRAPH} SELECT * FROM g")
def policy_prefix_merge(spark: SparkSession, d: str) -> DataFrame:
    return P.policy_graph(_paths(spark, d), "route", "seq", "action", "weight")


@query(f"{_GRAPH} SELECT node, depth, branches FROM g WHERE branches >= 2")
def decision_points(spark: SparkSession, d: str) -> DataFrame:
    return P.policy_graph(_paths(spark, d), "route", "seq", "action", "weight").where("branches >= 2").select("node", "depth", "branches")


@query("SELECT o_orderkey, least(CASE WHEN e < 3600 THEN least(1200, 3600 - e) WHEN e < 7000 THEN least(2400, 7000 - e) ELSE 3600 END, 90000 - e)::BIGINT AS step FROM (SELECT o_orderkey, (o_orderkey * 607) % 90000 AS e FROM orders)")
def interval_schedule(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("o_orderkey") * 607 % 90000
    return _t(spark, d, "orders").select("o_orderkey", S.step_seconds(e, [(1200, 3600), (2400, 7000), (3600, None)], 90000).alias("step"))


def _constant_wind(spark: SparkSession, u: float = 0.0, v: float = -10.0, hours: int = 12) -> tuple[DataFrame, I.GridSpec]:
    """A 3 x 3 grid over 0..2 degrees, two slices."""
    base = F.unix_timestamp(F.lit("2026-07-14 12:00:00").cast("timestamp"))
    g = spark.range(18).select(F.timestamp_seconds(base + F.floor(F.col("id") / 9) * hours * 3600).alias("valid_time"), (F.floor(F.col("id") / 3) % 3).cast("int").alias("j"), (F.col("id") % 3).cast("int").alias("i"), F.lit(u).alias("u"), F.lit(v).alias("v"))
    return g, I.GridSpec(0.0, 0.0, 1.0, 1.0, 3, 3)


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    """Requests within the small grid, one for each supplier."""
    k = F.col("s_suppkey").cast("long")
    s = _t(spark, d, "supplier")
    start = F.lit("2026-07-14 12:00:00").cast("timestamp")
    return s.select(k.alias("request_id"), (0.8 + k % 5 / 10.0).alias("lat"), F.lit(0.5).alias("lon"), F.lit(1.0).alias("to_lat"), (0.7 + k % 3 / 10.0).alias("to_lon"), start.alias("depart"))


@query()
def beam_route(spark: SparkSession, d: str) -> DataFrame:
    """Points of the fastest routes of all requests, searched at once."""
    wind, spec = _constant_wind(spark)
    routes, _ = search(_seeds(spark, d), wind, spec, Polar.builtin(), Options())
    return routes.select("request_id", "seq", "time", *(_r(F.col(x), x) for x in ("lat", "lon", "heading", "boat_speed", "cum_nm")))


@query()
def lattice_route(spark: SparkSession, d: str) -> DataFrame:
    """Earliest arrivals at all cells of a geodesic lattice from each nation's nearest cell, in a steady wind."""
    faces = L.icosphere(spark, 2)
    links = L.edges(faces)
    cells = L.vertices(faces)
    k = F.col("n_nationkey").cast("long")
    seeds = _t(spark, d, "nation").select(k.alias("k"), G.unit_vector(_lat(k), _lon(k)).alias("v"))
    sources = Z.nearest_cell(seeds, "k", cells).select(F.col("k").alias("request_id"), "cell")
    la, lo = L.position_of(F.col("va"))
    lb, lob = L.position_of(F.col("vb"))
    links = links.withColumn("kn", Polar.builtin().speed(G.angular_difference(G.initial_bearing(la, lo, lb, lob), F.lit(225.0)), F.lit(18.0)))
    got = L.earliest_arrivals(sources, links.select("a", "b", "nm", "kn"), F.col("kn"))
    return got.select("request_id", "cell", "elapsed")


# --- environment, fronts, sets ------------------------------------------------------------


def _land(spark: SparkSession) -> DataFrame:
    """Signed distances on the 5-degree grid; some cells have none."""
    g = spark.range(37 * 72).select((F.col("id") % 72).cast("int").alias("i"), F.floor(F.col("id") / 72).cast("int").alias("j"))
    i, j = F.col("i"), F.col("j")
    return g.select("j", "i", F.when((i + j) % 11 > 0, (5 * j + 7 * i) % 900 - 100.0).alias("signed_nm"))


_LAND = "(CASE WHEN (i + j) % 11 > 0 THEN (5 * j + 7 * i) % 900 - 100e0 END)"
_LAND_AT = f"(SELECT k, CASE WHEN count(*) FILTER (w <> 0 AND {_LAND} IS NULL) = 0 THEN sum(w * {_LAND}) FILTER (w <> 0) END AS nm FROM {_CELLS.format(rows=f'(SELECT k, lat, lon, 0 AS t, 1e0 AS s FROM {_CUST})')} GROUP BY k)"


@query(f"SELECT k, round(nm, 5) + 0e0 AS nm, CASE WHEN nm IS NULL THEN 'missing' ELSE 'ok' END AS status FROM {_LAND_AT}")
def landmask_lookup(spark: SparkSession, d: str) -> DataFrame:
    got = I.bilinear(_customers(spark, d), "k", _land(spark), _SPEC, ["signed_nm"])
    return got.select("k", _r(F.col("signed_nm"), "nm", 5), F.when(F.col("signed_nm").isNull(), "missing").otherwise("ok").alias("status"))


@query(f"SELECT k, round(nm, 5) + 0e0 AS nm FROM {_LAND_AT} WHERE nm IS NOT NULL")
def missing_data_rejects(spark: SparkSession, d: str) -> DataFrame:
    rows, _ = V.sample(_customers(spark, d), "k", _land(spark), _SPEC, ["signed_nm"], "reject")
    return rows.select("k", _r(F.col("signed_nm"), "nm", 5))


@query(f"SELECT count(*) AS sampled, count(*) FILTER (nm IS NULL) AS missing FROM {_LAND_AT}")
def environment_counters(spark: SparkSession, d: str) -> DataFrame:
    _, counters = V.sample(_customers(spark, d), "k", _land(spark), _SPEC, ["signed_nm"])
    return counters


@query()
def landmask_certify(spark: SparkSession, d: str) -> DataFrame:
    """Legs proved clear of land by halving; tests hold it against dense sampling."""
    grid = spark.range(37 * 72).select((F.col("id") % 72).cast("int").alias("i"), F.floor(F.col("id") / 72).cast("int").alias("j"))
    grid = grid.withColumn("distance", 60.0 * F.abs(F.col("j") * 5 - 90.0))  # land along the equator
    legs = _legs(spark, d).select("k", "lat1", "lon1", F.greatest(F.lit(-89.0), F.least(F.lit(89.0), F.col("lat1") + F.col("k") % 9 - 4)).alias("lat2"), (F.col("lon1") + 2).alias("lon2"))
    return V.certify_legs(legs, "k", lambda p: I.bilinear(p, "pid", grid, _SPEC, ["distance"]), 30.0)


_AXIS = "((c_nationkey * 14) % 360)"
_OFF = Q.wrap(f"{Q.bearing('20.05e0', '-30.05e0', 'lat', 'lon')} - {_AXIS}")


@query(
    f"WITH p AS (SELECT *, {_OFF} AS o, {Q.dist('lat', 'lon', '20.05e0', '-30.05e0')} AS togo FROM {_CUST}), a AS (SELECT *, max(CASE WHEN abs(o) <= 60 THEN 1 ELSE 0 END) OVER (PARTITION BY c_nationkey) AS hits FROM p), b AS (SELECT *, floor(o / 10.3e0 + 0.5e0)::BIGINT AS band FROM a WHERE abs(o) <= 60 OR hits = 0), w AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey, band ORDER BY togo, k) AS n FROM b), r AS (SELECT *, band - row_number() OVER (PARTITION BY c_nationkey ORDER BY band) AS run FROM w WHERE n = 1), f AS (SELECT *, count(*) OVER (PARTITION BY c_nationkey, run) >= 2 OR max(CASE WHEN band = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY c_nationkey, run) = 1 AS keep FROM r), g AS (SELECT *, max(CASE WHEN keep THEN 1 ELSE 0 END) OVER (PARTITION BY c_nationkey) AS kept FROM f) SELECT c_nationkey, band, run, {Q.r('togo', 'to_go', 4)} FROM g WHERE keep OR kept = 0"
)
def destination_front(spark: SparkSession, d: str) -> DataFrame:
    p = _customers(spark, d).withColumn("seq", F.col("k")).withColumn("to_lat", F.lit(20.05)).withColumn("to_lon", F.lit(-30.05)).withColumn("axis", (F.col("c_nationkey") * 14 % 360).cast("double"))
    return D.destination_front(p, "c_nationkey", 10.3, aperture=60.0).select("c_nationkey", "band", "run", _r(F.col("to_go"), "to_go", 4))


@query("WITH a AS (SELECT *, (l_partkey * 10) % 360 AS h, l_suppkey % 20 AS b, l_orderkey % 50 AS g FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY g, b, h ORDER BY l_extendedprice, l_orderkey, l_linenumber) AS x FROM a), s AS (SELECT *, row_number() OVER (PARTITION BY g, b ORDER BY x, l_extendedprice, l_orderkey, l_linenumber) AS n FROM r), t AS (SELECT *, row_number() OVER (PARTITION BY g, h ORDER BY l_extendedprice, l_orderkey, l_linenumber) AS y FROM s WHERE n <= 3), u AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY y, l_extendedprice, l_orderkey, l_linenumber) AS m FROM t) SELECT g, l_orderkey, l_linenumber, h FROM u WHERE m <= 25")
def two_level_beam(spark: SparkSession, d: str) -> DataFrame:
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", (F.col("l_partkey") * 10 % 360).alias("h"), (F.col("l_suppkey") % 20).alias("b"), (F.col("l_orderkey") % 50).alias("g"))
    got = D.two_level_beam(li, ["g"], "b", "h", ["l_extendedprice", "l_orderkey", "l_linenumber"], 3, 25)
    return got.select("g", "l_orderkey", "l_linenumber", "h")


@query(f"WITH m AS (SELECT run, choice, round(sum(CASE WHEN elapsed IS NULL THEN weight ELSE 0 END) / sum(weight), 2) AS lost, round(sum(weight * elapsed) / sum(CASE WHEN elapsed IS NOT NULL THEN weight END), -6) AS mean, round(max(elapsed), -6) AS worst, count(*) % 3 AS made, count(*) % 2 AS settled FROM {_OUT} GROUP BY 1, 2), u AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY round(lost, 1), lost, mean NULLS LAST, worst NULLS LAST, made, settled, choice) AS up, row_number() OVER (PARTITION BY run ORDER BY round(lost, 1) DESC, lost, mean NULLS LAST, worst NULLS LAST, made, settled, choice) AS down FROM m) SELECT run, choice, up, down FROM u")
def objective_order(spark: SparkSession, d: str) -> DataFrame:
    """Every choice's place under the least and under the greatest objective."""
    g = _outcomes(spark, d).groupBy("run", "choice").agg(*E.audits(), F.count("*").alias("n"))
    lost = F.round("incomplete_weight", 2)
    g = g.select("run", "choice", F.round(lost, 1).alias("objective"), lost.alias("incomplete_weight"), F.round("finite_mean", -6).alias("finite_mean"), F.round("worst_finite", -6).alias("worst_finite"), (F.col("n") % 3).alias("generated"), (F.col("n") % 2).alias("settled"), F.col("choice").alias("identity"))
    up, down = (F.row_number().over(Window.partitionBy("run").orderBy(*E.objective_order(maximize=m))).cast("long") for m in (False, True))
    return g.select("run", "choice", up.alias("up"), down.alias("down"))


_TERMINAL = f"(SELECT o_custkey % 97 AS run, l_linenumber AS label, o_orderkey % 4 AS member, max(l_quantity % 3)::DOUBLE AS weight, max(CASE WHEN l_returnflag = 'R' THEN 1 + l_orderkey % 3 ELSE 0 END)::INT AS class_rank, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS lost, (max(l_orderkey) % 11)::DOUBLE AS e FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3)"


@query(f"WITH t AS (SELECT *, CASE WHEN class_rank = 0 THEN e END AS elapsed FROM {_TERMINAL}), w AS (SELECT * FROM t WHERE weight > 0), n AS (SELECT run, label, count(*) AS n FROM w GROUP BY 1, 2), b AS (SELECT x.run, x.label, y.label AS o, count(*) AS m, bool_and(CASE WHEN x.class_rank = 0 AND y.class_rank = 0 THEN y.elapsed <= x.elapsed ELSE y.class_rank <= x.class_rank END) AS ok, bool_or(CASE WHEN x.class_rank = 0 AND y.class_rank = 0 THEN y.elapsed < x.elapsed ELSE y.class_rank < x.class_rank END) AS one FROM w x JOIN w y ON x.run = y.run AND x.member = y.member AND x.label <> y.label GROUP BY 1, 2, 3) SELECT DISTINCT run, label FROM t WHERE NOT EXISTS (SELECT 1 FROM b JOIN n ON n.run = b.run AND n.label = b.label WHERE b.run = t.run AND b.label = t.label AND m = n AND ok AND one)")
def policy_terminal_front(spark: SparkSession, d: str) -> DataFrame:
    """Labels that no other one of the run beats member by member; members without weight don't count."""
    j = _t(spark, d, "lineitem").join(_t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    lost = F.max(F.when(F.col("l_returnflag") == "R", 1 + F.col("l_orderkey") % 3).otherwise(0)).cast("int")
    t = j.groupBy((F.col("o_custkey") % 97).alias("run"), F.col("l_linenumber").alias("label"), (F.col("o_orderkey") % 4).alias("member")).agg(F.max(F.col("l_quantity") % 3).cast("double").alias("weight"), lost.alias("class_rank"), (F.max("l_orderkey") % 11).cast("double").alias("e"))
    t = t.withColumn("elapsed", F.when(F.col("class_rank") == 0, F.col("e"))).drop("e")
    return E.undominated_terminals(t, ["run"], "label").select("run", "label").distinct()


@query(f"SELECT c_nationkey AS g, round(sum(CASE WHEN k % 3 = 2 THEN w ELSE 0 END), 4) AS failed_weight, round(sum(CASE WHEN k % 3 = 1 THEN w ELSE 0 END), 4) AS completed_weight, round(sum(CASE WHEN k % 3 = 1 THEN w * k ELSE 0 END), 3) AS completed_elapsed, coalesce(max(CASE WHEN k % 3 = 1 AND w > 0 THEN k END), 0)::DOUBLE AS worst_completed, round(sum(w * nm), 3) AS weighted_distance, round(coalesce(max(CASE WHEN w > 0 THEN nm END), 0), 4) AS worst_distance FROM (SELECT *, (k % 5)::DOUBLE AS w, {Q.dist('lat', 'lon', '20.05e0', '-30.05e0')} AS nm FROM {_CUST}) GROUP BY 1")
def beam_rank(spark: SparkSession, d: str) -> DataFrame:
    """The measures by which labels of a common-course beam are ranked."""
    k = F.col("k")
    status = F.get(F.array(F.lit("active"), F.lit("completed"), F.lit("failed")), (k % 3).cast("int"))
    s = _customers(spark, d).select(F.col("c_nationkey").alias("g"), (k % 5).cast("double").alias("weight"), status.alias("status"), "lat", "lon", k.cast("double").alias("elapsed"), F.lit(20.05).alias("to_lat"), F.lit(-30.05).alias("to_lon"))
    got = E.beam_rank(s, ["g"])
    return got.select("g", *(F.round(c, n).alias(c) for c, n in (("failed_weight", 4), ("completed_weight", 4), ("completed_elapsed", 3))), "worst_completed", F.round("weighted_distance", 3).alias("weighted_distance"), F.round("worst_distance", 4).alias("worst_distance"))


@query("SELECT o_orderkey, (d + (s - d) // 2)::BIGINT AS middle FROM (SELECT o_orderkey, o_orderkey % 1200 + 600 AS s, o_orderkey % 61 AS d FROM orders)")
def midpoint_offset(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return _t(spark, d, "orders").select("o_orderkey", S.sailing_midpoint_offset(k % 1200 + 600, k % 61).alias("middle"))


@query()
def vmg_blend(spark: SparkSession, d: str) -> DataFrame:
    """Angles of best progress for a wind speed, blended between the table's columns; tests hold them against plain arithmetic."""
    w = F.col("o_orderkey") % 450 / 10.0
    best = Polar.builtin().best_angles_at(spark, w)
    return _t(spark, d, "orders").select("o_orderkey", best.alias("b")).select("o_orderkey", _r(F.col("b.up"), "up", 3), _r(F.col("b.down"), "down", 3))


@query("SELECT DISTINCT a FROM (SELECT o_custkey AS a FROM orders UNION SELECT c_custkey * 2 FROM customer)")
def distinct_union(spark: SparkSession, d: str) -> DataFrame:
    return K.distinct_union([_t(spark, d, "orders").select(F.col("o_custkey").alias("a")), _t(spark, d, "customer").select((F.col("c_custkey") * 2).alias("a"))])


@query("SELECT DISTINCT least(o_custkey, o_orderkey % 7) AS a, greatest(o_custkey, o_orderkey % 7) AS b FROM orders ANTI JOIN (SELECT least(c_custkey, c_nationkey % 7) AS x, greatest(c_custkey, c_nationkey % 7) AS y FROM customer) ON least(o_custkey, o_orderkey % 7) = x AND greatest(o_custkey, o_orderkey % 7) = y")
def edge_difference(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "orders").select(F.col("o_custkey").alias("a"), (F.col("o_orderkey") % 7).alias("b"))
    gone = _t(spark, d, "customer").select((F.col("c_nationkey") % 7).cast("long").alias("a"), F.col("c_custkey").alias("b"))
    return K.edge_difference(e, gone)


@query(f"SELECT DISTINCT round(lat, 0) + 0e0 AS lat, CASE WHEN round(lon, 0) = -180 THEN 180e0 ELSE round(lon, 0) + 0e0 END AS lon FROM {_CUST}")
def distinct_positions(spark: SparkSession, d: str) -> DataFrame:
    """Positions rounded to degrees; both names of the antimeridian are one."""
    return K.distinct_positions(_customers(spark, d), 0)


@query(f"WITH e AS (SELECT k % 10 AS cell, {Q.dist('lat1', 'lon1', 'lat2', 'lon2')} AS nm FROM {_LEGS}) SELECT cell, round(max(nm), 5) AS longest FROM e GROUP BY 1 UNION ALL SELECT NULL, round(max(nm), 5) FROM e")
def longest_edges(spark: SparkSession, d: str) -> DataFrame:
    links = _legs(spark, d).select((F.col("k") % 10).alias("a"), G.distance_nm("lat1", "lon1", "lat2", "lon2").alias("nm"))
    return L.longest_edges(links).select("cell", F.round("longest", 5).alias("longest"))


@query(f"SELECT k, ceil(round({Q.dist('lat1', 'lon1', 'lat2', 'lon2')} / 11e0 * 3600, 3))::BIGINT AS bound FROM {_LEGS}")
def arrival_bound(spark: SparkSession, d: str) -> DataFrame:
    """Seconds no route can beat: the way at the table's highest speed."""
    s = G.distance_nm("lat1", "lon1", "lat2", "lon2") / Polar.builtin().maximum_speed() * 3600
    return _legs(spark, d).select("k", F.ceil(F.round(s, 3)).alias("bound"))


_W = "acos(greatest(-1e0, least(1e0, sin(radians(lat1)) * sin(radians(lat2)) + cos(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2 - lon1)))))"


@query(f"SELECT k, {Q.r(f'(sin(0.7e0 * {_W}) * sin(radians(lat1)) + sin(0.3e0 * {_W}) * sin(radians(lat2))) / sin({_W})', 'z', 5)} FROM {_LEGS}")
def arc_points(spark: SparkSession, d: str) -> DataFrame:
    df = _legs(spark, d).withColumn("p", G.slerp(G.unit_vector("lat1", "lon1"), G.unit_vector("lat2", "lon2"), 0.3))
    return df.select("k", _r(F.get("p", F.lit(2)), "z", 5))


_NAMES = "['reached', 'forecast_exhausted', 'duration_exhausted', 'infeasible_no_route', 'missing_data', 'provider_failure', 'cancelled', 'other_error']"


@query(f"SELECT o_orderkey, o_orderkey % 8 AS rank, {_NAMES}[(o_orderkey % 8) + 1] AS name, list_position({_NAMES}, {_NAMES}[(o_orderkey % 8) + 1])::INT - 1 AS back, ['forecast_exhausted', 'cancelled', 'infeasible_no_route', 'missing_data', 'provider_failure', 'other_error', 'missing_data'][(o_orderkey % 7) + 1] AS of_error FROM orders")
def outcome_names(spark: SparkSession, d: str) -> DataFrame:
    rank = F.col("o_orderkey") % 8
    errors = ["forecast_exhausted", "cancelled", "no_route", "file_io", "invalid_environment", "invalid_polar", "coordinate_outside_forecast"]
    code = F.get(F.array(*map(F.lit, errors)), (F.col("o_orderkey") % 7).cast("int"))
    named = _t(spark, d, "orders").select("o_orderkey", rank.alias("rank"), F.get(F.array(*map(F.lit, E.OUTCOMES)), rank.cast("int")).alias("name"), E.outcome_of_error(code).alias("of_error"))
    return named.withColumn("back", E.class_rank("name"))


@query("SELECT user_id, count(*)::BIGINT AS expanded, coalesce(sum(CASE WHEN value > 50 THEN floor(value)::BIGINT END), 0)::BIGINT AS generated FROM events GROUP BY 1")
def search_counters(spark: SparkSession, d: str) -> DataFrame:
    """Counters of parts of a search (here one for each event) summed as `search` sums those of its steps."""
    parts = _t(spark, d, "events").select("user_id", F.lit(1).alias("expanded"), F.when(F.col("value") > 50, F.floor("value")).alias("generated"))
    return K.total_counters(parts, ["user_id"], ["expanded", "generated"])


@query(f"SELECT count(*) AS zones, max(zone % 3)::BIGINT AS last, count(active_until) AS bounded, min(active_from) AS first_active FROM {_ZONES}")
def zone_summary(spark: SparkSession, d: str) -> DataFrame:
    return N.zone_summary(_zones(spark).withColumnRenamed("zone", "zone_id").withColumn("revision", F.col("zone_id") % 3))


# --- files -------------------------------------------------------------------------------


def _track(spark: SparkSession, d: str) -> DataFrame:
    c = _customers(spark, d)
    return c.select(F.col("c_nationkey").alias("request_id"), F.lit("2026-07-14 12:00:00").cast("timestamp").alias("time"), F.col("k").alias("seq"), "lat", "lon")


@query(f"""SELECT c_nationkey AS request_id, '{{"type":"Feature","properties":{{"time":"2026-07-14T12:00:00Z"}},"geometry":{{"type":"LineString","coordinates":[' || string_agg('[' || lon || ',' || lat || ']', ',' ORDER BY k) || ']}}}}' AS json FROM {_CUST} GROUP BY 1""")
def isochrone_geojson(spark: SparkSession, d: str) -> DataFrame:
    return route_files.isochrone_geojson(_track(spark, d)).select("request_id", "json")


def _coord(x: str) -> str:
    return rf"regexp_replace(printf('%.10f', {x}), '\.?0+$', '')"


@query(f"""SELECT c_nationkey AS request_id, '<?xml version="1.0" encoding="UTF-8"?><gpx version="1.1" creator="tidemark" xmlns="http://www.topografix.com/GPX/1/1"><trk><name>route</name><trkseg>' || string_agg('<trkpt lat="' || {_coord('lat')} || '" lon="' || {_coord('lon')} || '"><time>2026-07-14T12:00:00Z</time></trkpt>', '' ORDER BY k) || '</trkseg></trk></gpx>' AS gpx FROM {_CUST} GROUP BY 1""")
def route_gpx(spark: SparkSession, d: str) -> DataFrame:
    return route_files.route_gpx(_track(spark, d))


@query()
def ensemble_route(spark: SparkSession, d: str) -> DataFrame:
    """The course of least mean arrival over three members, each with its own wind."""
    wind, spec = _constant_wind(spark)
    members = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 1.0)], "member string, weight double")
    share = members.select("member", (1.3 - F.col("weight") / 5).alias("share"))
    grids = wind.join(F.broadcast(share), F.lit(True)).withColumn("v", F.col("v") * F.col("share")).drop("share")
    courses, outcomes = ensemble_search(_seeds(spark, d), members, grids, spec, Polar.builtin())
    return outcomes.join(courses, "request_id").select("request_id", "member", "elapsed_s", _r(F.col("mean_s"), "mean_s"))


# --- legs to a place, the lattice in time, policies that meet again, lines -------------------

#: A boat of 4 knots into the wind and 12 before it at 40 knots of wind, less in proportion.
_STRAIGHT = Polar([0.0, 180.0], [0.0, 40.0], [[0.0, 4.0], [0.0, 12.0]])
_LEG_SQL = f"""
WITH l AS (SELECT k, lat1, lon1, lat2, lon2, (k * 17) % 360 + 0e0 AS h0, k % 3 - 1 AS s0, {Q.dist('lat1', 'lon1', 'lat2', 'lon2')} AS nm, {Q.bearing('lat1', 'lon1', 'lat2', 'lon2')} AS course FROM {_LEGS}),
v AS (SELECT *, {Q.diff('course', '0e0')} AS angle, {Q.side('course', '0e0')} AS s1, 10 * 1.9438444924406048e0 / 40 * (4 + 8 * {Q.diff('course', '0e0')} / 180) AS kn FROM l),
t AS (SELECT *, CASE WHEN s0 <> 0 AND s1 <> 0 AND s0 <> s1 THEN CASE WHEN ({Q.diff('h0', '0e0')} + angle) / 2 >= 90 THEN 300 ELSE 120 END ELSE 0 END AS lost FROM v)
SELECT k, lost::BIGINT AS lost, (lost + ceil(nm / kn * 3600))::BIGINT AS seconds, {Q.r('kn', 'speed')}, {Q.r('course', 'heading', 5)}, CASE WHEN lost + ceil(nm / kn * 3600) > (k % 5 + 1) * 1000000 THEN 'duration_exhausted' END AS fault FROM t
"""


@query(_LEG_SQL)
def target_legs(spark: SparkSession, d: str) -> DataFrame:
    """Legs to fixed places in a steady northerly: heading, maneuver, time and what rules a leg out."""
    noon, k = F.lit("2026-07-14 12:00:00").cast("timestamp"), F.col("k")
    grid = spark.range(8).select(F.timestamp_seconds(F.unix_timestamp(noon) + F.floor(F.col("id") / 4) * 86400 * 365).alias("valid_time"), (F.floor(F.col("id") / 2) % 2).cast("int").alias("j"), (F.col("id") % 2).cast("int").alias("i"), F.lit(0.0).alias("u"), F.lit(-10.0).alias("v"))
    wind = I.Field(grid, I.GridSpec(-90.0, -180.0, 180.0, 180.0, 2, 2, wraps=True), ["u", "v"])
    legs = _legs(spark, d).select("k", F.col("lat1").alias("lat"), F.col("lon1").alias("lon"), F.col("lat2").alias("to_lat"), F.col("lon2").alias("to_lon"), noon.alias("ts"), (k * 17 % 360).cast("double").alias("heading"), (k % 3 - 1).cast("int").alias("side"), F.timestamp_seconds(F.unix_timestamp(noon) + (k % 5 + 1) * 1000000).alias("until"))
    got = fixed_legs(legs, ["k"], wind, _STRAIGHT, Options(tack_s=120, gybe_s=300))
    return got.select("k", "lost", "seconds", _r(F.col("speed"), "speed"), _r(F.col("new_heading"), "heading", 5), "fault")


@query()
def lattice_time_route(spark: SparkSession, d: str) -> DataFrame:
    """Fastest ways over a lattice for one request of each supplier, in a wind that fills in after twelve hours; waiting is allowed."""
    noon = F.unix_timestamp(F.lit("2026-07-14 12:00:00").cast("timestamp"))
    slices = spark.createDataFrame([(0, 0.5, -1.5), (12, -4.0, -6.0), (36, 3.0, -8.0), (120, 3.0, -8.0)], "h long, u double, v double")
    cells = spark.range(9).select((F.col("id") % 3).cast("int").alias("i"), F.floor(F.col("id") / 3).cast("int").alias("j"))
    grid = slices.join(F.broadcast(cells), F.lit(True)).select(F.timestamp_seconds(noon + F.col("h") * 3600).alias("valid_time"), "j", "i", "u", "v")
    wind = I.Field(grid, I.GridSpec(-10.0, -10.0, 20.0, 20.0, 3, 3), ["u", "v"])
    k = F.col("s_suppkey").cast("long")
    requests = _t(spark, d, "supplier").select(k.alias("request_id"), (0.8 + k % 5 / 10.0).alias("lat"), (0.2 + k % 11 / 10.0).alias("lon"), (2.0 + k % 7 / 5.0).alias("to_lat"), (2.1 + k % 3 / 2.0).alias("to_lon"), F.timestamp_seconds(noon).alias("depart"))
    lat, lon = L.position_of(L.midpoint("a", "b"))
    leaves = L.icosphere(spark, 5).withColumn("level", F.lit(5)).where(lat.between(-4, 8) & lon.between(-4, 8))
    _, summary = T.lattice_search(requests, T.lattice_links(leaves), T.connectors(requests, leaves, 5), wind, Polar.builtin(), Options(max_duration=72 * 3600, tack_s=120, gybe_s=60), 12 * 3600)
    return summary.select("request_id", "completion", "elapsed", "settled")


_STEPS = "(SELECT o_custkey % 50 AS g, o_custkey AS route, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq, o_orderpriority || ' ' || row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place, o_orderstatus AS action, o_custkey % 13 + 0e0 AS cost, o_custkey % 17 = 0 AS selected FROM orders)"
_NODE = "sha256('[\"' || place || '\"]')"


@query(
    f"WITH s AS (SELECT *, {_NODE} AS node, lag({_NODE}) OVER w AS f FROM {_STEPS} WINDOW w AS (PARTITION BY route ORDER BY seq)) "
    "SELECT g, f AS from_node, node AS to_node, action, count(DISTINCT route) AS routes, min(cost) AS cost, max(selected::INT)::BOOLEAN AS selected, NOT max(selected::INT)::BOOLEAN AS needs_review FROM s WHERE f IS NOT NULL GROUP BY g, f, node, action"
)
def policy_branches(spark: SparkSession, d: str) -> DataFrame:
    """Branches of the graphs in which the states of many routes are shared, also behind different beginnings."""
    c = F.col("o_custkey")
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    steps = _t(spark, d, "orders").select((c % 50).alias("g"), c.alias("route"), n.alias("seq"), F.concat_ws(" ", "o_orderpriority", n.cast("string")).alias("place"), F.col("o_orderstatus").alias("action"), (c % 13).cast("double").alias("cost"), (c % 17 == 0).alias("selected"))
    return P.merged_policy(steps, ["g"], "route", "seq", ["place"], "action", "cost", "selected")[1].drop("branch")


_TAILS = "WITH l AS (SELECT l_orderkey % 10 AS g, l_orderkey AS route, l_returnflag || l_partkey % 3 AS a, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem), w AS (SELECT g, route, list(a ORDER BY n) AS w FROM l GROUP BY ALL), p AS (SELECT g, route, w[:k] AS pre, w[k + 1:] AS tail FROM w, LATERAL (SELECT unnest(range(0, len(w) + 1)) AS k)), f AS (SELECT g, pre, list_sort(list_distinct(list(tail))) AS lang FROM p GROUP BY ALL)"


@query(f"{_TAILS} SELECT g, height, routes, outgoing FROM (SELECT g, lang, list_max(list_transform(lang, lambda t: len(t)))::BIGINT AS height, len(list_distinct(list_filter(list_transform(lang, lambda t: t[1]), lambda x: x IS NOT NULL)))::BIGINT AS outgoing, count(DISTINCT route) AS routes FROM p JOIN f USING (g, pre) GROUP BY g, lang)")
def policy_shared_endings(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of the smallest graphs whose ways are what became of orders, line after line."""
    act = F.concat("l_returnflag", (F.col("l_partkey") % 3).cast("string"))
    steps = _t(spark, d, "lineitem").select((F.col("l_orderkey") % 10).alias("g"), F.col("l_orderkey").alias("route"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("seq"), act.alias("action"))
    return P.shared_endings(steps, ["g"], "route", "seq", "action")[0].drop("node")


_LINE = f"(SELECT c_nationkey AS nation, k AS n, lat, lon, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM {_CUST} WINDOW w AS (PARTITION BY c_nationkey ORDER BY k))"


@query(f"""
WITH e AS (SELECT *, {Q.wrap('lon2 - lon')} AS way, coalesce(abs(lon2 - lon) > 180, false) AS broken FROM {_LINE}),
c AS (SELECT nation, n, broken, lat, lon, CASE WHEN way > 0 THEN 180e0 ELSE -180e0 END AS edge, way, lat2 FROM e),
p AS (SELECT nation, n, 0 AS k, lat, lon, 0 AS start FROM e WHERE NOT (coalesce(abs(lon - lon0) > 180, false) AND abs(lon) = 180)
  UNION ALL SELECT nation, n, 1, lat + coalesce((edge - lon) / nullif(way, 0), 1) * (lat2 - lat), edge, 0 FROM c WHERE broken
  UNION ALL SELECT nation, n, 2, lat + coalesce((edge - lon) / nullif(way, 0), 1) * (lat2 - lat), -edge, 1 FROM c WHERE broken),
q AS (SELECT *, sum(start) OVER (PARTITION BY nation ORDER BY n, k)::BIGINT AS part FROM p)
SELECT nation, part, row_number() OVER (PARTITION BY nation, part ORDER BY n, k) - 1 AS seq, {Q.r('lat', 'lat')}, {Q.r('lon', 'lon')}, false AS closed FROM q
""")
def antimeridian_split(spark: SparkSession, d: str) -> DataFrame:
    """A line through the customers of each nation, broken where it crosses the antimeridian."""
    line = _customers(spark, d).select(F.col("c_nationkey").alias("nation"), F.col("k").alias("n"), "lat", "lon")
    got = C.split_at_antimeridian(line, ["nation"], "n")
    return got.select("nation", "part", "seq", _r(F.col("lat"), "lat"), _r(F.col("lon"), "lon"), "closed")


@query(f"SELECT k, coalesce(sum(CASE WHEN gap > 20 THEN 1 END) OVER (PARTITION BY c_nationkey ORDER BY k), 0)::BIGINT AS chain FROM (SELECT *, sqrt(power(lon - lag(lon) OVER w, 2) + power(lat - lag(lat) OVER w, 2)) AS gap FROM {_CUST} WINDOW w AS (PARTITION BY c_nationkey ORDER BY k))")
def point_chains(spark: SparkSession, d: str) -> DataFrame:
    """Customers of each nation in chains without wide gaps."""
    p = _customers(spark, d).withColumns({"x": F.col("lon"), "y": F.col("lat")})
    return C.chains(p, ["c_nationkey"], ["k"], 10.0).select("k", "chain")


@query(f"""
WITH s AS (SELECT c_nationkey AS request_id, k % 3 AS h, k, lat, lon FROM {_CUST}),
p AS (SELECT request_id, h, count(*) AS n, '<trkseg>' || string_agg('<trkpt lat="' || {_coord('lat')} || '" lon="' || {_coord('lon')} || '"><time>2026-07-14T1' || (2 + h) || ':00:00Z</time></trkpt>', '' ORDER BY k) || CASE WHEN count(*) = 1 THEN any_value('<trkpt lat="' || {_coord('lat')} || '" lon="' || {_coord('lon')} || '"><time>2026-07-14T1' || (2 + h) || ':00:00Z</time></trkpt>') ELSE '' END || '</trkseg>' AS seg FROM s GROUP BY ALL)
SELECT request_id, '<?xml version="1.0" encoding="UTF-8"?><gpx version="1.1" creator="tidemark" xmlns="http://www.topografix.com/GPX/1/1"><metadata><name>isochrones</name><desc>customers</desc><time>' || '2026-07-14T1' || (2 + min(h)) || ':00:00Z</time></metadata>' || string_agg('<trk><name>isochrone 2026-07-14T1' || (2 + h) || ':00:00Z</name><desc>Retained frontier with ' || n || ' points</desc>' || seg || '</trk>', '' ORDER BY h) || '</gpx>' AS gpx FROM p GROUP BY 1
""")
def isochrone_gpx(spark: SparkSession, d: str) -> DataFrame:
    """Isochrones as GPX, a track for each time."""
    time = F.timestamp_seconds(F.unix_timestamp(F.lit("2026-07-14 12:00:00").cast("timestamp")) + F.col("k") % 3 * 3600)
    p = _customers(spark, d).select(F.col("c_nationkey").alias("request_id"), time.alias("time"), F.lit(0).cast("long").alias("part"), F.col("k").alias("seq"), "lat", "lon", F.lit(False).alias("closed"))
    kept = p.groupBy("request_id", "time").agg(F.count("*").alias("kept"))
    return route_files.isochrones_gpx(p.join(kept, ["request_id", "time"]), "customers")


@query(f"SELECT run, choice, member::VARCHAR AS member, sum(weight)::DOUBLE AS weight, max(class_rank)::INT AS class_rank, CASE WHEN max(class_rank) = 0 THEN min(elapsed) END AS elapsed FROM {_OUT} GROUP BY 1, 2, 3")
def ensemble_document(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes of runs written as documents, a document for each choice, in pieces, and read back."""
    keys = ["run", "choice"]
    o = _outcomes(spark, d).repartition(*keys).groupBy(*keys, "member").agg(F.sum("weight").cast("double").alias("weight"), F.max("class_rank").alias("class_rank"), F.min("elapsed").alias("elapsed"))
    o = o.withColumn("elapsed", F.when(F.col("class_rank") == 0, F.col("elapsed")))
    courses = o.groupBy(*keys).agg(E.weighted_mean().alias("objective"), *E.audits(), F.sum("weight").alias("total"))
    courses = Steps(spark, "documents").save(courses.select(*keys, "objective", "incomplete_weight", F.col("finite_mean").alias("mean_s"), F.col("worst_finite").alias("worst_s"), F.array(F.lit(90.0)).alias("headings"), "total"))
    o = o.join(I.small(courses.select(*keys, "total")), keys)
    rows = o.select(*keys, F.lpad(F.col("member").cast("string"), 12, "0").alias("member"), "weight", (F.col("weight") / F.col("total")).alias("normalized_weight"), F.get(F.array(*map(F.lit, E.OUTCOMES)), "class_rank").alias("outcome"), F.when(F.col("class_rank") == 0, F.col("elapsed")).alias("elapsed_s"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"))
    back = M.read_document_pieces(M.document_pieces(courses, rows, keys, "run", "model"), keys)
    return back.select(*keys, F.ltrim("member", F.lit("0")).alias("member"), "weight", "class_rank", "elapsed")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fastest-route search seeded from supplier rows."""
    return beam_route(spark, sf_dir)
