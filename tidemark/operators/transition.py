"""Single legs: to a fixed place, or on a heading for a time.

For a leg to a place the ground track is given and the heading that holds it is found; it
takes the maneuver's delay and then the whole seconds that the way needs at the speed made
good over the ground. A leg on a heading sails through the water what the delay leaves of its
time and goes where the current takes it; it may end earlier, within a radius of a place. With
midpoint sampling the speed is taken again from what blows and runs halfway along the leg.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import geodesy as G
from tidemark.functions import sailing as S
from tidemark.functions.polar import Polar

from .frontier import Options, Surroundings, legs_allowed
from .interpolation import Field

#: What a status of a lookup makes of a leg.
_LOST = {"out_of_bounds": "missing_data", "incomplete_forecast": "missing_data", "out_of_time": "forecast_exhausted"}


def _solved(e: DataFrame, polar: Polar, o: Options, around: Surroundings, save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """e with new_heading, speed (through the water) and sog, null where the track can't be held; of _course, tws, twd."""
    flat = lambda h: polar.speed(G.angular_difference(h, "twd"), "tws", o.monotone)
    sails = lambda v: F.when((v > 0) & (v >= o.min_speed), v)
    if around.current is None:
        e = save(e.withColumn("new_heading", F.col("_course")).withColumn("_flat", flat(F.col("_course"))))
        return e.withColumn("speed", sails(around.derated(sails(F.col("_flat"))))).withColumn("sog", F.col("speed"))
    still = F.col("east").isNull()
    solved = S.solve_heading("_course", lambda h: sails(around.derated(sails(flat(h)), h)), F.coalesce("east", F.lit(0.0)), F.coalesce("north", F.lit(0.0)))
    e = save(e.withColumn("new_heading", F.when(still, F.col("_course")).otherwise(solved)))
    # the speed once more at the heading found, and what it makes good along the track
    e = save(e.withColumn("_flat", flat(F.col("new_heading")))).withColumn("speed", sails(around.derated(sails(F.col("_flat")))))
    track = F.radians("_course")
    good = F.col("speed") * F.cos(F.radians(F.col("new_heading") - F.col("_course"))) + F.col("east") * F.sin(track) + F.col("north") * F.cos(track)
    return e.withColumn("sog", F.when(still, F.col("speed")).when(good > 0, good))


def _envelope(e: DataFrame, o: Options) -> DataFrame:
    """tws and twd of a row's wind; both null where it is too strong."""
    tws = S.wind_speed("u", "v")
    fits = F.lit(True) if o.max_wind is None else tws <= o.max_wind
    return e.withColumns({"tws": F.when(fits, tws), "twd": F.when(fits, S.wind_from("u", "v"))})


def target_legs(legs: DataFrame, keys: list[str], wind: Field, polar: Polar, o: Options = Options(), around: Surroundings = Surroundings(), save: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """legs with new_heading, speed, sog, new_side, tws, twd, nm, lost, seconds and fault.

    legs: (keys..., lat, lon, ts, heading, side, to_lat, to_lon, until); keys tell them apart.
    side is 0 and heading of no account where a leg is the first. until: the last moment of
    arrival. fault: null, or infeasible, missing_data, forecast_exhausted, duration_exhausted.
    """
    e = wind.at(legs, keys)
    fault = F.lit(None).cast("string")
    for status, name in _LOST.items():
        fault = F.when(F.col("status") == status, name).otherwise(fault)
    e = e.withColumn("fault", fault).drop("status")
    e = e.withColumns({"nm": G.distance_nm("lat", "lon", "to_lat", "to_lon"), "_course": G.initial_bearing("lat", "lon", "to_lat", "to_lon")})
    e = _solved(around.sampled(_envelope(e, o), keys), polar, o, around, save)
    e = e.withColumn("new_side", S.board("new_heading", "twd")).withColumn("_angle", G.angular_difference("new_heading", "twd"))
    lost = S.maneuver_delay("side", "new_side", G.angular_difference("heading", "twd"), "_angle", o.tack_s, o.gybe_s, o.turn_angle)
    e = e.withColumn("lost", F.coalesce(lost, F.lit(0).cast("long")))
    sailing = F.col("nm") / F.col("sog") * 3600
    if o.midpoint_wind or around.midpoint:
        names = ["tws", "twd", "u", "v", "new_side", "new_heading", "speed"]
        e = save(e.withColumns({f"_start_{n}": F.col(n) for n in names}).withColumn("_sailing", sailing))
        middle = G.destination("lat", "lon", "_course", F.col("nm") * 0.5)
        when = F.timestamp_seconds(F.unix_timestamp("ts") + F.col("lost") + F.ceil(F.col("_sailing") * 0.5))
        e = e.withColumn("_m", middle).withColumns({"_mlat": F.col("_m.lat"), "_mlon": F.col("_m.lon"), "_mts": when}).drop("_m")
        again = F.col("fault").isNull() & F.col("_sailing").isNotNull()
        if around.midpoint:
            e = around.sampled(e, keys, "_mlat", "_mlon", "_mts")
        if o.midpoint_wind:
            again = again & (F.col("_sailing") >= o.midpoint_least)
            e = wind.at(e.drop("u", "v"), keys, "_mts", "_mlat", "_mlon")
            e = e.withColumn("_lost", F.when(again & (F.col("status") != "ok"), F.when(F.col("status") == "out_of_time", "forecast_exhausted").otherwise("missing_data")))
            e = e.withColumn("fault", F.coalesce("fault", "_lost")).drop("status", "_lost")
            # too short legs keep the wind at their start
            e = e.withColumns({n: F.when(again, F.col(n)).otherwise(F.col(f"_start_{n}")) for n in ("u", "v")})
            e = _envelope(e, o)
        e = _solved(e, polar, o, around, save)
        # side and recorded wind are those at the start
        e = e.withColumns({n: F.col(f"_start_{n}") for n in ("tws", "twd", "new_side")}).drop("_sailing", "_mlat", "_mlon", "_mts", *(f"_start_{n}" for n in names))
    seconds = F.col("lost") + F.ceil(sailing)
    e = e.withColumn("seconds", F.when(F.col("nm") > 0, seconds).cast("long"))
    late = F.unix_timestamp("ts") + F.col("seconds") > F.unix_timestamp("until")
    e = e.withColumn("fault", F.coalesce("fault", F.when(F.col("seconds").isNull() | (F.col("seconds") <= 0), "infeasible").when(late, "duration_exhausted")))
    if around.land is not None or around.zones is not None or around.eligible is not None:
        open_ = e.where("fault is null").withColumns({"to": F.struct(F.col("to_lat").alias("lat"), F.col("to_lon").alias("lon")), "took": F.col("seconds")})
        clear = legs_allowed(open_, around, keys).select(*keys, F.lit(True).alias("_clear"))
        e = e.join(clear, keys, "left").withColumn("fault", F.coalesce("fault", F.when(F.col("_clear").isNull(), "infeasible"))).drop("_clear")
    return save(e.drop("_course", "_flat", "_angle", "u", "v", "east", "north", "height", "period", "sin", "cos"))


def heading_legs(legs: DataFrame, keys: list[str], wind: Field, polar: Polar, o: Options = Options(), around: Surroundings = Surroundings(), clip: bool = False, save: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """legs with speed, sog, cog, new_side, tws, twd, nm, lost, seconds, arrived, end_lat, end_lon and fault.

    legs: (keys..., lat, lon, ts, heading, side, new_heading, duration), and (to_lat, to_lon)
    where clip is true: a leg that comes within the options' arrival radius of that place ends
    there. fault: null, or infeasible (no speed, a wind too strong, a delay as long as the
    leg, a leg that is not allowed), missing_data, forecast_exhausted.
    """
    e = wind.at(legs, keys)
    fault = F.when(F.col("duration") <= 0, "infeasible")
    for status, name in _LOST.items():
        fault = fault.when(F.col("status") == status, name)
    e = around.sampled(_envelope(e.withColumn("fault", fault).drop("status"), o), keys)

    def sailed(e: DataFrame) -> DataFrame:
        """e with the speed of its heading in its wind and sea, and the way over the ground; null where it can't be sailed."""
        sails = lambda v: F.when((v > 0) & (v >= o.min_speed), v)
        e = save(e.withColumn("_flat", polar.speed(G.angular_difference("new_heading", "twd"), "tws", o.monotone)))
        e = e.withColumn("speed", sails(around.derated(sails(F.col("_flat"))))).withColumn("_g", around.over_ground())
        return e.withColumns({"sog": F.when(F.col("_g.sog") > 0, F.col("_g.sog")), "cog": F.col("_g.cog")}).drop("_flat", "_g")

    e = sailed(e).withColumn("new_side", S.board("new_heading", "twd"))
    lost = S.maneuver_delay("side", "new_side", G.angular_difference("heading", "twd"), G.angular_difference("new_heading", "twd"), o.tack_s, o.gybe_s, o.turn_angle)
    e = e.withColumn("lost", F.coalesce(lost, F.lit(0).cast("long")))
    sailing = F.col("duration") - F.col("lost")
    if o.midpoint_wind or around.midpoint:
        names = ["tws", "twd", "u", "v", "new_side"]
        e = save(e.withColumns({f"_start_{n}": F.col(n) for n in names}))
        middle = G.destination("lat", "lon", "cog", F.col("sog") * sailing / 7200.0)
        e = e.withColumn("_m", middle).withColumns({"_mlat": F.col("_m.lat"), "_mlon": F.col("_m.lon"), "_mts": F.timestamp_seconds(F.unix_timestamp("ts") + F.col("lost") + F.floor(sailing / 2))}).drop("_m")
        again = F.col("fault").isNull() & F.col("sog").isNotNull() & (sailing > 0)
        if around.midpoint:
            e = around.sampled(e, keys, "_mlat", "_mlon", "_mts")
        if o.midpoint_wind:
            again = again & (sailing >= o.midpoint_least)
            e = wind.at(e.drop("u", "v"), keys, "_mts", "_mlat", "_mlon")
            gone = F.when(again & (F.col("status") != "ok"), F.when(F.col("status") == "out_of_time", "forecast_exhausted").otherwise("missing_data"))
            e = e.withColumn("fault", F.coalesce("fault", gone)).drop("status")
            e = _envelope(e.withColumns({n: F.when(again, F.col(n)).otherwise(F.col(f"_start_{n}")) for n in ("u", "v")}), o)
        e = sailed(e.drop("speed", "sog", "cog"))
        e = e.withColumns({n: F.col(f"_start_{n}") for n in ("tws", "twd", "new_side")}).drop("_mlat", "_mlon", "_mts", *(f"_start_{n}" for n in names))
    way = F.when(sailing > 0, F.col("sog") * sailing / 3600.0)
    e = save(e.withColumn("_way", way))
    part = G.arrival_fraction("lat", "lon", "to_lat", "to_lon", "cog", "_way", o.arrival_radius) if clip else F.lit(None).cast("double")
    e = e.withColumn("_part", part).withColumn("nm", F.col("_way") * F.coalesce("_part", F.lit(1.0)))
    took = F.col("lost") + F.when(F.col("_part").isNotNull(), F.round(sailing * F.col("_part"))).otherwise(sailing)
    e = e.withColumns({"seconds": took.cast("long"), "arrived": F.col("_part").isNotNull(), "_to": G.destination("lat", "lon", "cog", "nm")})
    e = e.withColumns({"end_lat": F.col("_to.lat"), "end_lon": F.col("_to.lon"), "fault": F.coalesce("fault", F.when(F.col("nm").isNull(), "infeasible"))})
    if around.land is not None or around.zones is not None or around.eligible is not None:
        open_ = e.where("fault is null").withColumns({"to": F.col("_to"), "took": F.col("seconds")})
        clear = legs_allowed(open_, around, keys).select(*keys, F.lit(True).alias("_clear"))
        e = e.join(clear, keys, "left").withColumn("fault", F.coalesce("fault", F.when(F.col("_clear").isNull(), "infeasible"))).drop("_clear")
    return save(e.drop("_to", "_part", "_way", "u", "v", "east", "north", "height", "period", "sin", "cos"))


def waits_allowed(rows: DataFrame, keys: list[str], around: Surroundings) -> DataFrame:
    """rows (keys..., lat, lon, ts, took) that may stay where they are for `took` seconds: no land there, no zone meanwhile."""
    if around.land is None and around.zones is None:
        return rows
    here = F.struct("lat", "lon")
    return rows.join(legs_allowed(rows.withColumn("to", here), around, keys, eligibility=False).select(*keys), keys, "left_semi")
