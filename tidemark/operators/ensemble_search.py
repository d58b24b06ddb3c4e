"""One course for all members of a forecast ensemble, searched as a beam of DataFrame steps.

A label is a sequence of headings that all members sail for the same times; each member has
its own place under it. A step multiplies the members under way by the headings and moves
them with their own winds. Members that arrive, or that can't go on, leave the label with
their outcome and weight; the others go on, so one member's missing data does not end a
course. A heading that some member can't sail for want of wind or speed is not taken, unless
such failures are to be kept too. Labels are ranked by `beam_order` and kept in two levels: a
few of each bucket of weighted centroids, then a few of each request, headings not taken yet
first. A label with no member under way is finished; of those the best by `objective_order`
stays, and labels that can't be better any more are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import geodesy as G
from tidemark.functions import sailing as S
from tidemark.functions.polar import Polar

from .ensemble import beam_order, objective_order, outcome_of_error
from .front import two_level_beam
from .frontier import Options
from .interpolation import Field, GridSpec, small
from .ranking import top_k
from .shared import Alike, Steps

#: What a status of a lookup makes of a member.
_LOST = {"out_of_bounds": "missing_data", "incomplete_forecast": "missing_data", "out_of_time": "forecast_exhausted"}
#: What a label knows of the members that have left it.
_LEFT = ["failed_weight", "completed_weight", "completed_elapsed", "worst_completed", "left_distance", "left_worst", "left_x", "left_y", "left_z"]


def _gone(prefix: str = "") -> list[Column]:
    """Aggregates over member rows with outcome, weight, elapsed, to_go, lat and lon: what the label gains of members that leave it."""
    w, there = F.col("weight"), F.col("outcome") == "reached"
    left = F.col("outcome").isNotNull()
    p, l = F.radians("lat"), F.radians("lon")
    own = {
        "failed_weight": F.sum(F.when(left & ~there, w).otherwise(0.0)),
        "completed_weight": F.sum(F.when(there, w).otherwise(0.0)),
        "completed_elapsed": F.sum(F.when(there, w * F.col("elapsed")).otherwise(0.0)),
        "worst_completed": F.max(F.when(there & (w > 0), F.col("elapsed").cast("double")).otherwise(0.0)),
        "left_distance": F.sum(F.when(left, w * F.col("to_go")).otherwise(0.0)),
        "left_worst": F.max(F.when(left & (w > 0), F.col("to_go")).otherwise(0.0)),
        "left_x": F.sum(F.when(left, w * F.cos(p) * F.cos(l)).otherwise(0.0)),
        "left_y": F.sum(F.when(left, w * F.cos(p) * F.sin(l)).otherwise(0.0)),
        "left_z": F.sum(F.when(left, w * F.sin(p)).otherwise(0.0)),
    }
    return [v.alias(prefix + k) for k, v in own.items()]


def _both(now: str, before: str) -> list[Column]:
    """What has left a label with this step and before it."""
    return [(F.greatest(F.col(now + c), F.col(before + c)) if "worst" in c else F.col(now + c) + F.col(before + c)).alias(c) for c in _LEFT]


def _before(facts: DataFrame) -> DataFrame:
    """What had left each label before this step."""
    return facts.select("request_id", "label", *(F.col(c).alias(f"b_{c}") for c in _LEFT))


def ensemble_search(requests: DataFrame, members: DataFrame, wind: DataFrame, spec: GridSpec, polar: Polar, options: Options = Options(), width: int = 64, max_steps: int = 2000, keep_infeasible: bool = False, bounded: bool = True, progress: Callable[[int, DataFrame], bool | None] | None = None) -> tuple[DataFrame, DataFrame]:
    """(courses, outcomes) of requests (request_id, lat, lon, to_lat, to_lon, depart).

    members: (member, weight), and fault where one could not be loaded: it has its outcome from
    the start. wind: (member, valid_time, j, i, u, v). courses: for each
    request the headings of the best course, its objective (mean arrival in seconds, infinite
    where a member of positive weight does not arrive), mean_s (over those that do),
    incomplete_weight, worst_s, and the labels settled and dropped by the bound. outcomes: each
    member's outcome class under it, its arrival and its last place.
    keep_infeasible: a member that can't sail a heading fails instead of ruling it out.
    bounded: drop labels that can't be better than a finished one. max_steps: an error beyond.
    Requests of the same places and departure are searched once, and each has the result.
    progress: called with the step and its labels; a true answer ends the search with what it has.
    """
    t = Steps(requests.sparkSession, "ensemble")
    fast = polar.maximum_speed()
    air = Field(wind, spec, ["u", "v"], ["member"])
    total = float(members.agg(F.sum("weight")).first()[0])
    near = lambda lat, lon: G.distance_nm(lat, lon, "to_lat", "to_lon")
    alike = Alike(requests, ["lat", "lon", "to_lat", "to_lon", "depart"], t)
    state = alike.once.join(small(members.select("member", "weight", F.col("fault") if "fault" in members.columns else F.lit(None).cast("string").alias("fault"))), F.lit(True))
    state = state.withColumns({"label": F.lit(0).cast("long"), "elapsed": F.lit(0).cast("long"), "to_go": near("lat", "lon")})
    begun = F.when(F.col("fault").isNotNull(), outcome_of_error("fault")).when(F.col("to_go") <= options.arrival_radius, "reached")
    state = t.save(state.withColumn("outcome", begun).drop("fault"))
    ends = [(state.where("outcome is not null").select("request_id", "label", "member", "weight", "outcome", "elapsed", "lat", "lon"), 0)]
    facts = state.groupBy("request_id", "label").agg(F.count(F.when(F.col("outcome").isNull(), 1)).alias("active"), *_gone())
    facts = t.save(facts.withColumns({"parent": F.lit(None).cast("long"), "heading": F.lit(None).cast("double")}))
    tree, best = [facts], t.save(_finished(facts.where("active = 0"), 0, total))
    state = t.save(state.where("outcome is null").drop("outcome", "to_go"))
    cut = state.limit(0).select("request_id")
    elapsed, n = 0, int(-(-360 // options.heading_step))
    headings = F.explode(F.array(*(F.lit(i * options.heading_step) for i in range(n)))).alias("heading")
    for k in range(1, max_steps + 1):
        if state.isEmpty():
            break
        tier = next((i, u) for i, u in options.tiers if u is None or elapsed < u)
        step = min(tier[0], (tier[1] or 1 << 62) - elapsed, options.max_duration - elapsed)
        if step <= 0:  # nobody can go on: what is left ends here
            over = state.withColumns({"outcome": F.lit("duration_exhausted"), "to_go": near("lat", "lon")})
            ends.append((over.select(*ends[0][0].columns), k - 1))
            now = over.groupBy("request_id", "label").agg(F.lit(0).cast("long").alias("active"), *_gone("n_")).join(_before(facts), ["request_id", "label"])
            best = t.save(_better(best, _finished(now.select("request_id", "label", "active", *_both("n_", "b_")), k - 1, total)))
            break
        # times come from the rows, so that the code of every step is the same and is compiled once
        live = state.withColumns({"ts": F.timestamp_seconds(F.unix_timestamp("depart") + F.col("elapsed")), "step": S.step_seconds(F.col("elapsed"), options.tiers, options.max_duration)})
        live = air.at(live, ["request_id", "label", "member"])
        lost = F.lit(None).cast("string")
        for status, name in _LOST.items():
            lost = F.when(F.col("status") == status, name).otherwise(lost)
        go = live.withColumns({"lost": lost, "tws": S.wind_speed("u", "v"), "twd": S.wind_from("u", "v")}).drop("u", "v", "status", "ts")
        if options.monotone:
            go = go.select("*", headings)
            speed = polar.speed(G.angular_difference("heading", "twd"), "tws", True)
        else:  # the wind is looked up in the table once for all headings
            go = go.withColumn("_row", polar.at_wind("tws")).select("*", headings)
            speed = polar.along(G.angular_difference("heading", "twd"), "_row")
        if options.max_wind is not None:
            speed = F.when(F.col("tws") <= options.max_wind, speed)
        go = go.withColumn("speed", speed).drop("tws", "twd", "_row")
        sails = (F.col("speed") > 0) & (F.col("speed") >= options.min_speed)
        go = go.withColumn("bad", F.when(F.col("lost").isNotNull(), F.col("lost")).when(F.coalesce(sails, F.lit(False)), F.lit(None).cast("string")).otherwise("infeasible_no_route")).drop("lost")
        leg = F.when(F.col("bad").isNull(), F.col("speed") * (F.col("step") / 3600)).otherwise(0.0)
        go = go.withColumn("leg", leg).withColumn("part", F.when((F.col("leg") > 0) & (near("lat", "lon") <= F.col("leg") + options.arrival_radius + 1e-6), G.arrival_fraction("lat", "lon", "to_lat", "to_lon", "heading", "leg", options.arrival_radius)))
        go = go.withColumn("to", G.destination("lat", "lon", "heading", F.col("leg") * F.coalesce("part", F.lit(1.0))))
        arrived = F.col("part").isNotNull()
        moved = go.select("request_id", "label", "heading", "member", "weight", F.col("to.lat").alias("lat"), F.col("to.lon").alias("lon"), "to_lat", "to_lon", "depart",
            F.when(arrived, "reached").otherwise(F.col("bad")).alias("outcome"),
            F.when(arrived, (F.round(F.col("part") * F.col("step")) + F.col("elapsed")).cast("long")).when(F.col("bad").isNotNull(), F.col("elapsed")).otherwise(F.col("elapsed") + F.col("step")).alias("elapsed"))
        moved = t.save(moved.withColumn("to_go", near("lat", "lon")))
        alive, w = F.col("outcome").isNull(), F.col("weight")
        p, l = F.radians("lat"), F.radians("lon")
        cand = moved.groupBy("request_id", "label", "heading").agg(
            F.max((F.col("outcome") == "infeasible_no_route").cast("int")).alias("stuck"), F.count(F.when(alive, 1)).alias("under_way"),
            F.sum(F.when(alive, w * F.col("to_go")).otherwise(0.0)).alias("d"), F.max(F.when(alive & (w > 0), F.col("to_go")).otherwise(0.0)).alias("worst"),
            F.sum(F.when(alive, w * (F.col("elapsed") + F.col("to_go") / fast * 3600)).otherwise(0.0)).alias("least"),
            *(F.sum(F.when(alive, w * x).otherwise(0.0)).alias(name) for name, x in (("x", F.cos(p) * F.cos(l)), ("y", F.cos(p) * F.sin(l)), ("z", F.sin(p)))),
            *(F.first(c).alias(c) for c in ("to_lat", "to_lon")), *_gone("n_"))
        if not keep_infeasible:
            cand = cand.where("coalesce(stuck, 0) = 0")
        cand = cand.join(_before(facts), ["request_id", "label"]).select("request_id", "label", "heading", "under_way", "d", "worst", "least", "x", "y", "z", "to_lat", "to_lon", *_both("n_", "b_"))
        if bounded:
            cand = t.save(cand.join(best.select("request_id", F.col("incomplete_weight").alias("i"), F.col("finite_mean").alias("m")), "request_id", "left"))
            mean = (F.col("completed_elapsed") + F.col("least")) / F.lit(total)
            failed = F.col("failed_weight") / total
            worse = F.col("i").isNotNull() & ((failed > F.col("i") + 1e-12) | (failed >= F.col("i") - 1e-12) & (mean - 1 > F.col("m") * (1 - F.col("i"))))
            cut = cut.unionByName(cand.where(worse).select("request_id"))
            cand = cand.where(~worse).drop("i", "m")
        done = cand.where("under_way = 0")
        x, y, z = (F.col(c) + F.col(f"left_{c}") for c in "xyz")
        on = cand.where("under_way > 0").withColumns({"_lat": F.degrees(F.atan2(z, F.sqrt(x * x + y * y))), "_lon": F.degrees(F.atan2(y, x))})
        on = on.withColumns({"weighted_distance": F.round(F.col("d") + F.col("left_distance"), 9), "worst_distance": F.round(F.greatest("worst", "left_worst"), 9), "centroid_distance": F.round(near("_lat", "_lon"), 9), "bucket": G.planar_bucket("_lat", "_lon", "to_lat", "to_lon", options.bucket_nm), "identity": F.struct("label", "heading")})
        kept = two_level_beam(on, ["request_id"], "bucket", "heading", beam_order("identity"), options.per_bucket, width)
        columns = ["request_id", F.col("label").alias("parent"), "heading", F.col("under_way").alias("active"), *_LEFT]
        facts = kept.select(*columns).unionByName(done.select(*columns))
        facts = t.save(facts.withColumn("label", F.lit(k << 40) + F.monotonically_increasing_id()))
        tree.append(facts)
        best = t.save(_better(best, _finished(facts.where("active = 0"), k, total)))
        nxt = t.save(moved.withColumnRenamed("label", "parent").join(small(facts.select("request_id", "parent", "heading", "label")), ["request_id", "parent", "heading"]))
        ends.append((nxt.where("outcome is not null").select(*ends[0][0].columns), k))
        state = nxt.where("outcome is null").select(*state.columns)
        elapsed += step
        if progress is not None and progress(k, alike.each(facts.select("request_id", "label", "parent", "heading", "active"))):
            break
    else:
        raise RuntimeError(f"ensemble search did not end in {max_steps} steps")
    courses, outcomes = _courses(best, tree, ends, cut, t)
    return alike.each(courses), alike.each(outcomes)


def _finished(labels: DataFrame, step: int, total: float) -> DataFrame:
    """The measures of objective_order of labels that no member is under way in."""
    arrived = F.col("completed_weight")
    mean = F.when(arrived > 0, F.col("completed_elapsed") / arrived)
    return labels.select("request_id", "label", F.lit(step).alias("step"), F.when(F.col("failed_weight") > 0, F.lit(None).cast("double")).otherwise(mean).alias("objective"), (F.col("failed_weight") / total).alias("incomplete_weight"), mean.alias("finite_mean"), F.when(arrived > 0, F.col("worst_completed")).alias("worst_finite"), F.lit(0).alias("generated"), F.lit(0).alias("settled"), F.col("label").alias("identity"))


def _better(a: DataFrame, b: DataFrame) -> DataFrame:
    """The best of each request by objective_order."""
    return top_k(a.unionByName(b), ["request_id"], objective_order(), 1).select(*a.columns)


def _courses(best: DataFrame, tree: list[DataFrame], ends: list[tuple[DataFrame, int]], cut: DataFrame, t: Steps) -> tuple[DataFrame, DataFrame]:
    """Headings and members' outcomes along the way from each best label back to its root."""
    want, way, out = best.select("request_id", "label", "step"), [], None
    left = best.select("request_id", F.lit(None).cast("long").alias("label")).limit(0)
    by_step: dict[int, list[DataFrame]] = {}
    for e, k in ends:
        by_step.setdefault(k, []).append(e)
    for k in range(len(tree) - 1, -1, -1):
        here = t.save(left.unionByName(want.where(F.col("step") == k).select("request_id", "label")))
        at = t.save(tree[k].join(small(here), ["request_id", "label"], "left_semi").select("request_id", "label", "parent", "heading", F.lit(k).alias("k")))
        way.append(at)
        for e in by_step.get(k, []):
            got = e.join(small(here), ["request_id", "label"], "left_semi")
            out = got if out is None else out.unionByName(got)
        left = at.where("parent is not null").select("request_id", F.col("parent").alias("label"))
    path = way[0]
    for x in way[1:]:
        path = path.unionByName(x)
    headings = path.where("heading is not null").groupBy("request_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "heading"))), lambda s: s["heading"]).alias("headings"))
    labels = tree[0].select("request_id")
    for x in tree[1:]:
        labels = labels.unionByName(x.select("request_id"))
    settled = labels.groupBy("request_id").agg(F.count("*").alias("settled"))
    pruned = cut.groupBy("request_id").agg(F.count("*").alias("pruned"))
    courses = best.drop("settled", "generated").join(headings, "request_id", "left").join(settled, "request_id", "left").join(pruned, "request_id", "left")
    courses = courses.select("request_id", F.coalesce("headings", F.array().cast("array<double>")).alias("headings"), F.coalesce("objective", F.lit(float("inf"))).alias("objective"), F.col("finite_mean").alias("mean_s"), "incomplete_weight", F.col("worst_finite").alias("worst_s"), "settled", F.coalesce("pruned", F.lit(0)).alias("pruned"))
    outcomes = out.select("request_id", "member", "weight", "outcome", F.when(F.col("outcome") == "reached", F.col("elapsed")).alias("elapsed_s"), "lat", "lon")
    return t.save(courses), t.save(outcomes)
