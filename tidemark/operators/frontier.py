"""Fastest-arrival search as a loop of DataFrame steps over many requests at once.

Each step looks the wind up for every frontier point, multiplies the points by the
headings, moves them, takes arrivals out and keeps a heading-diverse few of each
bucket. A step is one narrow expansion and one shuffle by bucket; its result is
written to the shared folder, which cuts lineage. Positions within a step carry the
order of expansion, so results don't depend on how rows are partitioned.

Wind, current and waves are looked up by `Field`. Boat speed and waves are in the water's
frame; only the way made over the ground counts the current. With midpoint sampling a
leg's speed is taken again from what blows halfway along it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import geodesy as G
from tidemark.functions import sailing as S
from tidemark.functions.polar import Polar

from .environment import clear_of_land
from .exclusions import prepare_zones, segment_zone_hits
from .interpolation import Field, GridSpec
from .ranking import diverse_top_k, total_counters
from .shared import Alike, Steps


@dataclass(frozen=True)
class Options:
    """best_vmg: the four headings of best progress up and down the wind are tried too.

    midpoint_wind: speed from the wind halfway along a leg, for steps of midpoint_least
    seconds and more. turn_angle: mean wind angle from which a change of board is a gybe.
    """

    tiers: list[tuple[int, int | None]] = field(default_factory=lambda: [(1800, None)])
    heading_step: float = 10.0
    toward_destination: bool = False
    best_vmg: bool = False
    midpoint_wind: bool = False
    midpoint_least: int = 0
    turn_angle: float = 90.0
    arrival_radius: float = 0.5
    bucket_nm: float = 3.0
    per_bucket: int = 3
    sector_degrees: float | None = None
    max_duration: int = 24 * 3600
    min_speed: float = 0.0
    max_wind: float | None = None
    tack_s: int = 0
    gybe_s: int = 0
    monotone: bool = False

    def __post_init__(self):
        ranges = {
            "heading_step": 0 < self.heading_step <= 180 and 360 / self.heading_step <= 1_000_000,
            "arrival_radius": 0 < self.arrival_radius < float("inf"),
            "bucket_nm": 0 < self.bucket_nm < float("inf"),
            "per_bucket": self.per_bucket >= 1,
            "max_duration": self.max_duration > 0,
            "min_speed": 0 <= self.min_speed < float("inf"),
            "max_wind": self.max_wind is None or 0 < self.max_wind < float("inf"),
            "tack_s": self.tack_s >= 0,
            "gybe_s": self.gybe_s >= 0,
            "turn_angle": 0 <= self.turn_angle <= 180,
            "midpoint_least": self.midpoint_least >= 0,
            "sector_degrees": self.sector_degrees is None or 0 < self.sector_degrees <= 180,
            "tiers": bool(self.tiers) and all(i >= 300 for i, _ in self.tiers),
        }
        bad = [name for name, ok in ranges.items() if not ok]
        if bad:
            raise ValueError(f"out of range: {', '.join(bad)}")


@dataclass
class Surroundings:
    """What besides the wind bears on a leg; whatever is None is not looked at.

    current: Field of (east, north) in knots. waves: Field of (height, period, sin, cos) of
    metres, seconds and the direction waves come from. missing: what a place without data
    does, `ignore` it, `reject` the leg or `fail`. midpoint: sample again halfway along a
    leg. land: takes (pid, lat, lon) and gives (pid, distance). zones: as segment_zone_hits
    takes them. eligible: a condition on a leg's columns.
    """

    current: Field | None = None
    waves: Field | None = None
    missing: str = "ignore"
    midpoint: bool = False
    derating: Callable[..., Column] = S.derated_speed
    land: Callable[[DataFrame], DataFrame] | None = None
    land_clearance: float = 0.0
    zones: DataFrame | None = None
    boundary_excluded: bool = True
    eligible: Column | None = None

    def __post_init__(self):
        if self.missing not in ("ignore", "reject", "fail"):
            raise ValueError(f"unknown policy {self.missing!r}")

    def sampled(self, rows: DataFrame, keys: list[str], lat: str = "lat", lon: str = "lon", when: str = "ts") -> DataFrame:
        """rows with the current and the sea at a place; null where there is none or it is ignored."""
        for f, names in ((self.current, ["east", "north"]), (self.waves, ["height", "period", "sin", "cos"])):
            if f is None:
                continue
            rows = f.at(rows.drop(*names), keys, when, lat, lon)
            gone = F.col("status") != "ok"
            if self.missing == "fail":
                rows = rows.where(F.when(gone, F.raise_error(F.lit("missing environment data")).cast("boolean")).otherwise(F.lit(True)))
            elif self.missing == "reject":
                rows = rows.where(~gone)
            rows = rows.withColumns({n: F.when(~gone, F.col(n)) for n in names}).drop("status")
        return rows

    def derated(self, speed: Column, heading: Column | str = "new_heading") -> Column:
        """The speed of a heading in the sea at a row; unchanged where there is none."""
        if self.waves is None:
            return speed
        along = S.relative_wave_angle(heading, F.degrees(F.atan2("sin", "cos")))
        return F.when(F.col("height").isNotNull(), S.checked_derating(self.derating(speed, "height", along, "period"), speed)).otherwise(speed)

    def over_ground(self) -> Column:
        """struct(sog, cog) of a row's heading and speed."""
        still = F.struct(F.col("speed").alias("sog"), F.col("new_heading").alias("cog"))
        if self.current is None:
            return still
        return F.when(F.col("east").isNotNull(), S.ground_velocity("new_heading", "speed", "east", "north")).otherwise(still)


def expand(frontier: DataFrame, polar: Polar, o: Options, wind: Field | None = None, around: Surroundings = Surroundings(), save: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Candidates of frontier rows that carry wind (u, v), destination, step and time; fraction is set where one arrives.

    wind: where to look the wind halfway up. save: writes a table and reads it again, so that
    expressions as long as a boat speed's are not repeated in every filter behind them.
    """
    tws, twd = S.wind_speed("u", "v"), S.wind_from("u", "v")
    f = frontier.drop("h_ord", "p_ord", "speed", "dist", "fraction").withColumn("tws", tws).withColumn("twd", twd)
    f = f.where(F.col("tws") <= o.max_wind) if o.max_wind is not None else f
    f = around.sampled(f, ["request_id", "node"])
    n = int(-(-360 // o.heading_step))
    headings = F.array(*(F.lit(i * o.heading_step) for i in range(n)))
    if o.toward_destination:
        headings = F.concat(headings, F.array(G.initial_bearing("lat", "lon", "to_lat", "to_lon")))
    if o.best_vmg:
        best = polar.best_angles_at(frontier.sparkSession, "tws", o.monotone)
        f = f.withColumn("_best", best)
        headings = F.concat(headings, F.array(*(G.normalize_degrees(F.col("twd") + k * F.col(f"_best.{x}")) for x in ("up", "down") for k in (1, -1))))
    if not o.monotone:  # the wind is looked up in the table once for all headings
        f = f.withColumn("_row", polar.at_wind("tws"))
    e = f.select("*", F.posexplode(headings).alias("h_ord", "new_heading"))
    e = e.withColumn("angle", G.angular_difference("new_heading", "twd"))
    sails = (F.col("speed") > 0) & (F.col("speed") >= o.min_speed)
    e = e.withColumn("speed", polar.speed("angle", "tws", True) if o.monotone else polar.along("angle", "_row")).where(sails).drop("_row")
    if around.waves is not None:
        e = save(e.withColumn("_flat", F.col("speed")))
        e = save(e.withColumn("speed", around.derated(F.col("_flat")))).where(sails)
    e = e.withColumn("side", S.board("new_heading", "twd"))
    if o.tack_s or o.gybe_s:
        was_side = F.when(F.col("parent").isNull(), 0).otherwise(S.board("heading", "twd"))
        was_angle = F.when(F.col("parent").isNull(), 0.0).otherwise(G.angular_difference("heading", "twd"))
        e = e.withColumn("lost", S.maneuver_delay(was_side, "side", was_angle, "angle", o.tack_s, o.gybe_s, o.turn_angle)).where("lost < step")
    else:
        e = e.withColumn("lost", F.lit(0).cast("long"))
    hours = (F.col("step") - F.col("lost")) / 3600.0
    e = e.withColumn("_g", around.over_ground())
    if o.midpoint_wind or around.midpoint:
        e = save(e if around.waves is not None else e.withColumn("_flat", F.col("speed")))
        e = e.withColumn("_m", G.destination("lat", "lon", "_g.cog", F.col("_g.sog") * hours * 0.5)).withColumn("_mlat", F.col("_m.lat")).withColumn("_mlon", F.col("_m.lon"))
        e = e.withColumn("_mts", F.timestamp_seconds(F.unix_timestamp("ts") + S.sailing_midpoint_offset("step", "lost"))).drop("_m")
        keys = ["request_id", "node", "h_ord"]
        if around.midpoint:
            e = around.sampled(e, keys, "_mlat", "_mlon", "_mts")
        if o.midpoint_wind:
            e = wind.at(e.drop("u", "v"), keys, "_mts", "_mlat", "_mlon")
            mid = S.wind_speed("u", "v")
            usable = (F.col("status") == "ok") & (F.col("step") >= o.midpoint_least) & S.within_envelope(mid, o.max_wind)
            refined = polar.speed(G.angular_difference("new_heading", S.wind_from("u", "v")), mid, o.monotone)
            e = save(e.withColumn("_refined", F.when(usable, refined)).drop("status"))
            refined = F.col("_refined")
            e = e.withColumn("_flat", F.when((refined > 0) & (refined >= o.min_speed), refined).otherwise(F.col("_flat")))
        e = save(e.withColumn("speed", around.derated(F.col("_flat")))).where(sails).withColumn("_g", around.over_ground())
    e = e.where("_g.sog > 0").withColumn("leg", F.col("_g.sog") * hours)
    e = e.withColumn("fraction", G.arrival_fraction("lat", "lon", "to_lat", "to_lon", "_g.cog", "leg", o.arrival_radius))
    e = e.withColumn("gone", F.col("leg") * F.coalesce("fraction", F.lit(1.0))).withColumn("to", G.destination("lat", "lon", "_g.cog", "gone"))
    took = F.coalesce(F.col("lost") + F.round((F.col("step") - F.col("lost")) * F.col("fraction")), F.col("step")).cast("long")
    e = e.withColumn("took", took)
    if around.land is not None or around.zones is not None or around.eligible is not None:
        e = legs_allowed(e, around)
    return e.select("request_id", F.col("node").alias("parent"), F.col("pos").alias("p_ord"), "h_ord", F.col("to.lat").alias("lat"), F.col("to.lon").alias("lon"), (F.col("elapsed") + F.col("took")).alias("elapsed"), F.col("new_heading").alias("heading"), "speed", "tws", "twd", "side", (F.col("cum") + F.col("gone")).alias("cum"), G.distance_nm("to.lat", "to.lon", "to_lat", "to_lon").alias("dist"), "fraction", "to_lat", "to_lon", "depart")


def legs_allowed(e: DataFrame, around: Surroundings, keys: list[str] | tuple[str, ...] = ("request_id", "node", "h_ord"), eligibility: bool = True) -> DataFrame:
    """Candidates (keys..., lat, lon, to, ts, took) whose leg is clear of land, then of zones, and eligible."""
    legs = e.withColumn("leg_id", F.struct(*keys)).withColumns({"lat1": F.col("lat"), "lon1": F.col("lon"), "lat2": F.col("to.lat"), "lon2": F.col("to.lon"), "t1": F.col("ts"), "t2": F.timestamp_seconds(F.unix_timestamp("ts") + F.col("took"))})
    if around.land is not None:
        legs = clear_of_land(legs, "leg_id", around.land, around.land_clearance)
    if around.zones is not None:
        legs = legs.join(segment_zone_hits(legs.select("leg_id", "lat1", "lon1", "lat2", "lon2", "t1", "t2"), "leg_id", around.zones, around.boundary_excluded), "leg_id", "left_anti")
    return legs.where(around.eligible) if around.eligible is not None and eligibility else legs


def prune(candidates: DataFrame, o: Options) -> DataFrame:
    """The heading-diverse few of each bucket."""
    if o.sector_degrees:
        b = G.sector_bucket("lat", "lon", "to_lat", "to_lon", o.bucket_nm, o.sector_degrees)
        c = candidates.withColumn("_b", b).withColumn("b1", F.col("_b.sector")).withColumn("b2", F.col("_b.ring"))
    else:
        b = G.planar_bucket("lat", "lon", "to_lat", "to_lon", o.bucket_nm)
        c = candidates.withColumn("_b", b).withColumn("b1", F.col("_b.east")).withColumn("b2", F.col("_b.north"))
    keys = ["request_id", "b1", "b2", *(["side"] if o.tack_s or o.gybe_s else [])]
    return diverse_top_k(c, keys, ["dist", F.desc("speed"), "p_ord", "h_ord"], "heading", o.per_bucket).drop("_b", "b1", "b2", "picked")


def select_departures(requests: DataFrame, first, last, now=None) -> DataFrame:
    """requests with depart and departure_source: the one asked for, else now where the forecast holds it, else the forecast's start.

    first, last, now: timestamps as columns.
    """
    now = F.current_timestamp() if now is None else now
    asked, held = F.col("depart").isNotNull(), (now >= first) & (now <= last)
    source = F.when(asked, "explicit_time").when(held, "current_time").otherwise("forecast_start_fallback")
    return requests.withColumn("departure_source", source).withColumn("depart", F.when(asked, F.col("depart")).when(held, F.date_trunc("second", now)).otherwise(first))


def request_faults(requests: DataFrame, wind: Field, first, last) -> DataFrame:
    """(request_id, fault) of requests that can't be searched; first, last: the forecast's times as columns."""
    placed = G.is_valid_position("lat", "lon") & G.is_valid_position("to_lat", "to_lon")
    r = requests.withColumn("fault", F.when(~placed, "invalid_argument").when((F.col("depart") < first) | (F.col("depart") > last), "departure_outside_forecast"))
    ends = r.where("fault is null").select("request_id", "depart", F.posexplode(F.array(F.struct("lat", "lon"), F.struct(F.col("to_lat").alias("lat"), F.col("to_lon").alias("lon")))).alias("end", "p")).select("request_id", "depart", "end", "p.lat", "p.lon")
    air = wind.at(ends, ["request_id", "end"], "depart").where("status <> 'ok'")
    why = F.when(F.col("status") == "out_of_bounds", "coordinate_outside_forecast").otherwise(F.col("status"))
    lost = air.groupBy("request_id").agg(F.min_by(why, "end").alias("fault"))
    return r.where("fault is not null").select("request_id", "fault").unionByName(lost)


def search(requests: DataFrame, wind: DataFrame, spec: GridSpec, polar: Polar, options: Options = Options(), max_steps: int = 2000, around: Surroundings = Surroundings(), progress: Callable[[int, DataFrame], bool | None] | None = None, every_n_steps: int = 1) -> tuple[DataFrame, DataFrame]:
    """(routes, summary) of requests (request_id, lat, lon, to_lat, to_lon, depart).

    wind: (valid_time, j, i, u, v). routes: the points of each request's best route in order.
    summary: how each search ended and how much it did. A request that can't be searched
    has its fault there; one without a route has no points. A null depart is chosen by
    select_departures. Requests of the same places and departure are searched once, and each has
    the result. progress: called with the step and its kept points after every
    every_n_steps steps; a true answer cancels what is not finished. max_steps: an error beyond.
    """
    t = Steps(requests.sparkSession, "search")
    if around.zones is not None:
        around = replace(around, zones=prepare_zones(around.zones))  # once, not in each step
    air = Field(wind, spec, ["u", "v"])
    begin, end = wind.agg(F.unix_timestamp(F.min("valid_time")), F.unix_timestamp(F.max("valid_time"))).first()
    first, last = (F.timestamp_seconds(F.lit(x)) for x in (begin, end))
    alike = Alike(t.save(select_departures(requests, first, last)), ["lat", "lon", "to_lat", "to_lon", "depart", "departure_source"], t)
    asked = alike.once
    faults = t.save(request_faults(asked, air, first, last))
    # now was only a guess: where there is no wind yet, the forecast's start
    retry = faults.join(asked.where("departure_source = 'current_time'"), "request_id", "left_semi").select(F.col("request_id").alias("again"))
    asked = asked.join(retry, F.col("request_id") == F.col("again"), "left").withColumn("depart", F.when(F.col("again").isNotNull(), first).otherwise(F.col("depart"))).drop("again", "departure_source")
    faults = t.save(request_faults(asked, air, first, last))
    horizon = F.least(F.lit(options.max_duration).cast("long"), F.lit(end) - F.unix_timestamp("depart"))
    zero = F.lit(0).cast("long")
    start = asked.join(faults, "request_id", "left_anti").select("request_id", "lat", "lon", "to_lat", "to_lon", "depart", F.lit(None).cast("long").alias("parent"), zero.alias("p_ord"), F.lit(0).alias("h_ord"), zero.alias("elapsed"), F.lit(0.0).alias("heading"), F.lit(0.0).alias("speed"), F.lit(0.0).alias("tws"), F.lit(0.0).alias("twd"), F.lit(0.0).alias("cum"), G.distance_nm("lat", "lon", "to_lat", "to_lon").alias("dist"), horizon.alias("horizon"), zero.alias("node"), zero.alias("pos"))
    frontier = t.save(start)
    limits = frontier.select("request_id", "horizon")
    levels, ends, counts = [frontier], [frontier.where(F.col("dist") <= options.arrival_radius).select("request_id", F.lit("destination_reached").alias("completion"), zero.alias("level"), zero.alias("node"))], []
    frontier = frontier.where(F.col("dist") > options.arrival_radius)
    for level in range(1, max_steps + 1):
        # times come from the rows, so that the code of every step is the same and is compiled once
        step = F.least(S.step_seconds(F.col("elapsed"), options.tiers), F.col("horizon") - F.col("elapsed"))
        live = frontier.withColumn("step", step)
        over = live.where("step <= 0")
        nearest = over.groupBy("request_id").agg(F.min_by("node", F.struct("dist", "pos")).alias("node"), F.first("horizon").alias("horizon"))
        why = F.when(F.col("horizon") < options.max_duration, "forecast_exhausted").otherwise("duration_exhausted")
        ends.append(nearest.select("request_id", why.alias("completion"), F.lit(level - 1).cast("long").alias("level"), "node"))
        live = live.where("step > 0").withColumn("ts", F.timestamp_seconds(F.unix_timestamp("depart") + F.col("elapsed")))
        live = t.save(air.at(live, ["request_id", "node"]).where("status = 'ok'").drop("status"))
        cand = t.save(expand(live, polar, options, air, around, t.save))
        counts.append(live.groupBy("request_id").agg(F.count("*").alias("expanded")).join(cand.groupBy("request_id").agg(F.count("*").alias("generated")), "request_id", "left"))
        won = cand.where("fraction is not null").groupBy("request_id").agg(F.min(F.struct("elapsed", "fraction", "p_ord", "h_ord")).alias("w"))
        won = won.select("request_id", "w.elapsed", "w.fraction", "w.p_ord", "w.h_ord")
        there = cand.join(won, ["request_id", "elapsed", "fraction", "p_ord", "h_ord"], "left_semi").withColumn("node", F.lit(-1).cast("long")).withColumn("pos", F.lit(-1).cast("long"))
        kept = prune(cand.where("fraction is null").join(won, "request_id", "left_anti"), options)
        kept = kept.withColumn("pos", F.row_number().over(Window.partitionBy("request_id").orderBy("p_ord", "h_ord")).cast("long") - 1).withColumn("node", F.col("pos"))
        both = t.save(there.unionByName(kept).join(limits, "request_id").select(*levels[0].columns))
        levels.append(both)
        ends.append(both.where("node = -1").select("request_id", F.lit("destination_reached").alias("completion"), F.lit(level).cast("long").alias("level"), "node"))
        frontier = both.where("node >= 0")
        if frontier.isEmpty():
            break
        if progress is not None and level % every_n_steps == 0 and progress(level, alike.each(frontier.select("request_id", "node", "lat", "lon", "elapsed", "dist"))):
            ends.append(frontier.select("request_id").distinct().select("request_id", F.lit("cancelled").alias("completion"), F.lit(level).cast("long").alias("level"), F.lit(None).cast("long").alias("node")))
            break
    else:
        raise RuntimeError(f"search did not end in {max_steps} steps")
    done = ends[0]
    for e in ends[1:]:
        done = done.union(e)
    done = t.save(done)
    return alike.each(_routes(done, levels, t)), alike.each(t.save(_summary(alike.once, done, levels, counts, faults)))


def _routes(done: DataFrame, levels: list[DataFrame], t: Steps) -> DataFrame:
    """Points of the routes that end at `done`, walked back level by level."""
    at, out = None, None
    for level in range(len(levels) - 1, -1, -1):
        here = done.where(F.col("level") == level).select("request_id", "node")
        want = here if at is None else here.union(at.where("parent is not null").select("request_id", F.col("parent").alias("node")))
        at = levels[level].join(want, ["request_id", "node"], "left_semi")
        at = t.save(at) if level % 8 == 0 else at  # so that plans of long routes stay small
        row = at.withColumn("seq", F.lit(level).cast("long"))
        out = row if out is None else out.unionByName(row)
    time = F.timestamp_seconds(F.unix_timestamp("depart") + F.col("elapsed"))
    return t.save(out.select("request_id", "seq", time.alias("time"), "lat", "lon", "heading", F.col("speed").alias("boat_speed"), "tws", "twd", F.col("cum").alias("cum_nm"), F.col("dist").alias("to_go_nm")))


def _summary(requests: DataFrame, done: DataFrame, levels: list[DataFrame], counts: list[DataFrame], faults: DataFrame) -> DataFrame:
    kept = levels[1].select("request_id") if len(levels) > 1 else levels[0].select("request_id").limit(0)
    for x in levels[2:]:
        kept = kept.union(x.select("request_id"))
    kept = kept.groupBy("request_id").agg(F.count("*").alias("retained"))
    work = requests.select("request_id", F.lit(0).cast("long").alias("expanded"), F.lit(0).cast("long").alias("generated"), F.lit(0).cast("long").alias("one"))
    for x in counts:
        work = work.union(x.select("request_id", "expanded", F.coalesce("generated", F.lit(0)), F.lit(1).cast("long")))
    work = total_counters(work.withColumnRenamed("one", "steps"), ["request_id"], ["expanded", "generated", "steps"])
    end = done.groupBy("request_id").agg(F.max_by("completion", "level").alias("completion"))
    return work.join(kept, "request_id", "left").join(end, "request_id", "left").join(faults, "request_id", "left").select("request_id", F.coalesce("fault", "completion", F.lit("no_route")).alias("completion"), "expanded", "generated", F.coalesce("retained", F.lit(0)).alias("retained"), "steps")
