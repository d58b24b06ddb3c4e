"""Fastest arrival over a lattice in time: labels by cell, time bucket and board, waits, refinement.

Legs between cells change with the wind at the time of leaving, and a boat may stay where it
is until the next time boundary. A label is settled once no open one of its request could
still lead to an earlier one: a round settles all labels within the least time that any leg
takes of the earliest open one, and expands them together. Of the labels of one key the
earliest stays, the lowest predecessor among equals. So results are those of a search that
settles one label after the other, while a round is one join for all requests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import geodesy as G
from tidemark.functions import sailing as S
from tidemark.functions.polar import Polar

from . import lattice as L
from .frontier import Options, Surroundings
from .interpolation import Field, GridSpec, small
from .shared import Steps
from .spatial import corridor_faces
from .transition import target_legs, waits_allowed

#: Cells of the two ends of a request; no vertex has these numbers but by a chance of one in 2**62.
ORIGIN, DESTINATION = -2, -1
KEY = ["request_id", "cell", "bucket", "side"]


def connectors(requests: DataFrame, leaves: DataFrame, level: int) -> DataFrame:
    """(request_id, a, b, to_lat, to_lon): ways between a request's ends and the corners of the faces that hold them.

    leaves: (level, face, a, b, c), of one lattice for all, or (request_id, ...) of one each;
    ends in the same face are joined directly.
    """
    own = ["request_id"] if "request_id" in leaves.columns else []
    ends = requests.select("request_id", F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("end"), F.col(p + "lat").alias("lat"), F.col(p + "lon").alias("lon")) for k, p in ((ORIGIN, ""), (DESTINATION, "to_"))))).alias("e")).select("request_id", "e.*")
    at = ends.withColumn("_f", L.face_at(G.unit_vector("lat", "lon"), level)["face"])
    # a face's number begins with those of the faces it was split from
    up = F.explode(F.transform(F.sequence(F.lit(0), F.lit(level)), lambda k: F.struct((level - k).alias("level"), F.floor(F.col("_f") / F.pow(F.lit(4.0), k)).cast("long").alias("face")))).alias("_u")
    held = at.select("*", up).select("request_id", "end", "lat", "lon", "_u.level", "_u.face").join(leaves, [*own, "level", "face"])
    corner = held.select("request_id", "end", "lat", "lon", "face", F.explode(F.array("a", "b", "c")).alias("x"))
    la, lo = L.position_of(F.col("x"))
    corner = corner.select("request_id", "end", L.vertex_id("x").alias("cell"), la.alias("clat"), lo.alias("clon"), "lat", "lon")
    out = corner.where(F.col("end") == ORIGIN).select("request_id", F.lit(ORIGIN).cast("long").alias("a"), F.col("cell").alias("b"), F.col("clat").alias("to_lat"), F.col("clon").alias("to_lon"))
    home = corner.where(F.col("end") == DESTINATION).select("request_id", F.col("cell").alias("a"), F.lit(DESTINATION).cast("long").alias("b"), F.col("lat").alias("to_lat"), F.col("lon").alias("to_lon"))
    faces = held.select("request_id", "end", "level", "face", "lat", "lon")
    same = faces.where(F.col("end") == ORIGIN).select("request_id", "level", "face").join(faces.where(F.col("end") == DESTINATION).drop("end"), ["request_id", "level", "face"])
    direct = same.select("request_id", F.lit(ORIGIN).cast("long").alias("a"), F.lit(DESTINATION).cast("long").alias("b"), F.col("lat").alias("to_lat"), F.col("lon").alias("to_lon"))
    return out.unionByName(home).unionByName(direct)


def lattice_links(leaves: DataFrame) -> DataFrame:
    """(request_id if there, a, b, to_lat, to_lon): every edge of the leaves in both directions, without those that a finer face has split."""
    own = ["request_id"] if "request_id" in leaves.columns else []
    pair = lambda p, q: F.struct(F.col(p).alias("p"), F.col(q).alias("q"))
    e = leaves.select(*own, F.explode(F.array(pair("a", "b"), pair("b", "c"), pair("c", "a"), pair("b", "a"), pair("c", "b"), pair("a", "c"))).alias("e")).select(*own, "e.p", "e.q")
    lat, lon = L.position_of(F.col("q"))
    e = e.select(*own, L.vertex_id("p").alias("a"), L.vertex_id("q").alias("b"), lat.alias("to_lat"), lon.alias("to_lon"), L.vertex_id(L.midpoint("p", "q")).alias("m"))
    e = e.groupBy(*own, "a", "b").agg(F.first("to_lat").alias("to_lat"), F.first("to_lon").alias("to_lon"), F.first("m").alias("m"))
    known = e.select(*own, F.col("a").alias("m")).distinct()
    return e.join(known, [*own, "m"], "left_anti").drop("m")


def mixed_leaves(requests: DataFrame, coarse: DataFrame, route: DataFrame, level: int, refinements: int, width_nm: Column | float) -> DataFrame:
    """(request_id, level, face, a, b, c): for each request the coarse faces, split as often as `refinements` near its route.

    coarse: (face, a, b, c) of a level. route: (request_id, seq, lat, lon). width_nm: how near.
    """
    faces = requests.select("request_id").join(small(coarse.withColumn("level", F.lit(level))), F.lit(True))
    arcs = route_arcs(route)
    for k in range(refinements):
        here = faces.where(F.col("level") == level + k)
        near = corridor_faces(here, arcs, width_nm, ["request_id"]).select("request_id", "face", F.lit(level + k).alias("level"))
        split = L.split_faces(here.join(near, ["request_id", "face", "level"], "left_semi"), ["request_id"]).withColumn("level", F.lit(level + k + 1))
        faces = faces.join(near, ["request_id", "face", "level"], "left_anti").unionByName(split)
    return faces


def route_arcs(route: DataFrame) -> DataFrame:
    """(request_id, a, b): the legs of routes as unit vectors; a single point is a leg to itself."""
    v = G.unit_vector("lat", "lon")
    w = Window.partitionBy("request_id").orderBy("seq")
    r = route.select("request_id", "seq", v.alias("b")).withColumn("a", F.lag("b").over(w)).withColumn("n", F.count("*").over(Window.partitionBy("request_id")))
    return r.where("a is not null or n = 1").select("request_id", F.coalesce("a", "b").alias("a"), "b")


def lattice_search(requests: DataFrame, links: DataFrame, ends: DataFrame, wind: Field, polar: Polar, options: Options = Options(), bucket_s: int = 3600, until: Column | None = None, around: Surroundings = Surroundings(), bounded: bool = True, waits: bool = True, max_rounds: int = 2000, progress: Callable[[int, DataFrame], bool | None] | None = None) -> tuple[DataFrame, DataFrame]:
    """(routes, summary) of requests (request_id, lat, lon, to_lat, to_lon, depart).

    links: (a, b, to_lat, to_lon) between cells, for all requests or with a request_id for each;
    ends: as `connectors` gives them. bucket_s: the time between boundaries, counted from the
    departure. until: the last moment, by default the departure and max_duration.
    bounded: drop labels that can't arrive before one that has. progress: called with the
    round and its settled labels; a true answer cancels what is not finished.
    routes: (request_id, seq, time, lat, lon, heading, boat_speed, cum_nm, waits) of those that
    arrive. summary: (request_id, completion, elapsed, settled, generated, rounds).
    """
    t = Steps(requests.sparkSession, "lattice-search")
    own = ["request_id"] if "request_id" in links.columns else []
    last = F.timestamp_seconds(F.unix_timestamp("depart") + options.max_duration) if until is None else F.least(until, F.timestamp_seconds(F.unix_timestamp("depart") + options.max_duration))
    fast = polar.maximum_speed() if around.current is None else None
    links, ends = t.save(links), t.save(ends)  # read in every round
    zero = F.lit(0).cast("long")
    start = requests.select("request_id", F.lit(ORIGIN).cast("long").alias("cell"), zero.alias("bucket"), F.lit(0).alias("side"), zero.alias("elapsed"), "lat", "lon", F.lit(0.0).alias("heading"), F.lit(0.0).alias("speed"), F.lit(0.0).alias("cum"), F.lit(False).alias("waited"), zero.alias("id"), F.lit(None).cast("long").alias("parent"), F.lit(None).cast("int").alias("parent_round"))
    names = start.columns
    fixed = t.save(requests.select("request_id", "depart", last.alias("until"), F.col("to_lat").alias("goal_lat"), F.col("to_lon").alias("goal_lon")))
    least = t.save(_least_leg(links, ends, requests, fast, around))
    links = small(links)

    def marked(open_: DataFrame) -> DataFrame:
        """Open labels with state 2 where no other one could still lead to an earlier one, else 0."""
        low = open_.groupBy("request_id").agg(F.min("elapsed").alias("_low")).join(least, "request_id", "left")
        limit = F.least(F.col("_low") + F.greatest(F.lit(1), F.coalesce("least", F.lit(1))), (F.floor(F.col("_low") / bucket_s) + 1) * bucket_s)
        low = low.select("request_id", limit.alias("_limit"), F.floor(F.col("_low") / bucket_s).alias("now"))
        return open_.join(low, "request_id").withColumn("state", F.when(F.col("elapsed") < F.col("_limit"), 2).otherwise(0)).select(*names, "state", "now")

    # state: 0 open, 1 settled in a bucket that is still met, 2 settled in this round
    table = t.save(marked(start))
    rounds, counts, wins = [], [], []
    for k in range(max_rounds):
        safe, open_ = table.where("state = 2").drop("state"), table.where("state = 0").drop("state")
        rounds.append(safe.drop("now"))
        home = safe.where(F.col("cell") == DESTINATION)
        wins.append(home.groupBy("request_id").agg(F.min(F.struct("elapsed", "side", "id")).alias("w")).select("request_id", F.lit(k).alias("round"), F.col("w.elapsed").alias("elapsed"), F.col("w.id").alias("id")))
        over = home.select("request_id").distinct()
        go = safe.drop("now").join(over, "request_id", "left_anti").join(fixed, "request_id").withColumn("ts", F.timestamp_seconds(F.unix_timestamp("depart") + F.col("elapsed")))
        legs = go.join(links.withColumnRenamed("a", "cell"), [*own, "cell"]).unionByName(go.join(ends.withColumnRenamed("a", "cell"), ["request_id", "cell"]))
        legs = target_legs(legs, ["request_id", "id", "b"], wind, polar, options, around, t.save)
        counts.append(legs.select("request_id"))
        elapsed = F.col("elapsed") + F.col("seconds")
        nothing = F.lit(None).cast("long").alias("id")
        came = [F.col("id").alias("parent"), F.lit(k).alias("parent_round"), "goal_lat", "goal_lon"]
        made = legs.where("fault is null").select("request_id", F.col("b").alias("cell"), F.floor(elapsed / bucket_s).cast("long").alias("bucket"), F.col("new_side").cast("int").alias("side"), elapsed.alias("elapsed"), F.col("to_lat").alias("lat"), F.col("to_lon").alias("lon"), F.col("new_heading").alias("heading"), "speed", (F.col("cum") + F.col("nm")).alias("cum"), F.lit(False).alias("waited"), nothing, *came)
        if waits:
            boundary = (F.col("bucket") + 1) * bucket_s
            rest = go.where(F.unix_timestamp("depart") + boundary <= F.unix_timestamp("until")).withColumn("took", boundary - F.col("elapsed"))
            rest = waits_allowed(rest, ["request_id", "id"], around)
            made = made.unionByName(rest.select("request_id", "cell", (F.col("bucket") + 1).alias("bucket"), "side", boundary.alias("elapsed"), "lat", "lon", "heading", F.lit(0.0).alias("speed"), "cum", F.lit(True).alias("waited"), nothing, *came))
        if bounded and fast:
            best = F.ceil(F.col("elapsed") + G.distance_nm("lat", "lon", "goal_lat", "goal_lon") / fast * 3600 - 1e-6)
            reached = made.where(F.col("cell") == DESTINATION).select("request_id", "elapsed").unionByName(open_.where(F.col("cell") == DESTINATION).select("request_id", "elapsed")).groupBy("request_id").agg(F.min("elapsed").alias("_home"))
            made = made.join(reached, "request_id", "left").where(F.col("_home").isNull() | (best <= F.col("_home"))).drop("_home")
        # settled labels of a key are earlier than any that come; those of past buckets can't be met again
        settled = table.where("state > 0 and bucket >= now")
        left = open_.drop("now").unionByName(made.drop("goal_lat", "goal_lon")).join(over, "request_id", "left_anti").join(settled.select(*KEY).distinct(), KEY, "left_anti")
        row = F.struct("elapsed", F.coalesce("parent_round", F.lit(-1)).alias("pr"), F.coalesce("parent", F.lit(-1)).alias("p"), "waited", "lat", "lon", "heading", "speed", "cum", "parent", "parent_round")
        left = left.groupBy(*KEY).agg(F.min(row).alias("r")).select(*KEY, "r.elapsed", "r.lat", "r.lon", "r.heading", "r.speed", "r.cum", "r.waited", "r.parent", "r.parent_round")
        left = t.save(left.withColumn("id", F.lit((k + 1) << 40) + F.monotonically_increasing_id()).select(*names))
        if left.isEmpty():
            break
        if progress is not None and progress(k, safe.select("request_id", "cell", "lat", "lon", "elapsed")):
            break
        table = t.save(marked(left).unionByName(settled.withColumn("state", F.lit(1))))
    else:
        raise RuntimeError(f"lattice search did not end in {max_rounds} rounds")
    cancelled = left.select("request_id").distinct().withColumn("_open", F.lit(True))
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
    arrived = t.save(union(wins))
    work = union([x.select("request_id", F.lit(1).alias("settled"), F.lit(0).alias("generated")) for x in rounds] + [x.select("request_id", F.lit(0).alias("settled"), F.lit(1).alias("generated")) for x in counts])
    work = work.groupBy("request_id").agg(F.sum("settled").alias("settled"), F.sum("generated").alias("generated"))
    summary = requests.select("request_id").join(arrived.select("request_id", "elapsed", (F.col("round") + 1).alias("rounds")), "request_id", "left").join(work, "request_id", "left").join(cancelled, "request_id", "left")
    completion = F.when(F.col("elapsed").isNotNull(), "destination_reached").when(F.col("_open"), "cancelled").otherwise("no_route")
    summary = t.save(summary.select("request_id", completion.alias("completion"), "elapsed", F.coalesce("settled", F.lit(0)).alias("settled"), F.coalesce("generated", F.lit(0)).alias("generated"), "rounds"))
    return _walk_back(arrived, rounds, fixed, t), summary


def _least_leg(links: DataFrame, ends: DataFrame, requests: DataFrame, fast: float | None, around: Surroundings) -> DataFrame:
    """(request_id, least): whole seconds that any leg of a request takes at least; a current makes that unknown."""
    if fast is None:
        return requests.select("request_id", F.lit(1).cast("long").alias("least"))
    own = ["request_id"] if "request_id" in links.columns else []
    at = links.select(*own, F.col("b").alias("a"), F.col("to_lat").alias("lat"), F.col("to_lon").alias("lon")).distinct()
    way = links.join(at, [*own, "a"]).withColumn("nm", G.distance_nm("lat", "lon", "to_lat", "to_lon"))
    own_least = way.groupBy(*own).agg(F.min("nm").alias("nm")) if own else way.agg(F.min("nm").alias("nm"))
    lat, lon = requests.select("request_id", "lat", "lon"), requests.select("request_id", "to_lat", "to_lon")
    out = ends.where(F.col("a") == ORIGIN).join(lat, "request_id").select("request_id", G.distance_nm("lat", "lon", "to_lat", "to_lon").alias("nm"))
    place = at.withColumnsRenamed({"lat": "alat", "lon": "alon"})
    home = ends.where(F.col("a") != ORIGIN).join(place, [*own, "a"], "left").select("request_id", G.distance_nm("alat", "alon", "to_lat", "to_lon").alias("nm"))
    ends_least = out.unionByName(home).groupBy("request_id").agg(F.min("nm").alias("e"))
    both = ends_least.join(own_least, "request_id", "left") if own else ends_least.join(F.broadcast(own_least), F.lit(True))
    return both.select("request_id", F.floor(F.least("e", "nm") / fast * 3600).cast("long").alias("least"))


def _walk_back(arrived: DataFrame, rounds: list[DataFrame], fixed: DataFrame, t: Steps) -> DataFrame:
    """The labels from each arrival back to its origin, round by round; only what is on a route is kept."""
    want = arrived.select("request_id", F.col("round").alias("parent_round"), F.col("id").alias("parent"))
    parts = []
    for k in range(len(rounds) - 1, -1, -1):
        at = t.save(rounds[k].join(small(want.where(F.col("parent_round") == k).select("request_id", F.col("parent").alias("id"))), ["request_id", "id"], "left_semi"))
        parts.append(at)
        want = t.save(want.where(F.col("parent_round") != k).unionByName(at.where("parent is not null").select("request_id", "parent_round", "parent")))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    order = Window.partitionBy("request_id").orderBy("elapsed", F.asc_nulls_first("parent_round"), "id")
    time = F.timestamp_seconds(F.unix_timestamp("depart") + F.col("elapsed"))
    return t.save(out.join(fixed, "request_id").select("request_id", (F.row_number().over(order) - 1).cast("long").alias("seq"), time.alias("time"), "lat", "lon", "heading", F.col("speed").alias("boat_speed"), F.col("cum").alias("cum_nm"), F.col("waited").alias("waits")))


def refined_search(requests: DataFrame, coarse: DataFrame, level: int, refinements: int, wind: Field, polar: Polar, options: Options = Options(), bucket_s: int = 3600, corridor_nm: float = 60.0, retries: int = 2, **search) -> tuple[DataFrame, DataFrame]:
    """(routes, summary) as lattice_search gives them, from coarse to fine.

    coarse: faces (face, a, b, c) of a level. Each refinement splits the faces within a corridor
    of the best route so far once more and searches again; its route stands if it arrives and
    not later, else the corridor is doubled up to `retries` times, and then the route before
    stays. summary adds level (of the lattice the route is from), corridor_nm and fallback: why
    the last refinement was not taken, disconnected or regressed, retry_exhausted where it was
    tried more than once.
    """
    t = Steps(requests.sparkSession, "refined")
    leaves = coarse.withColumn("level", F.lit(level))
    routes, best = lattice_search(requests, lattice_links(leaves), connectors(requests, leaves, level), wind, polar, options, bucket_s, **search)
    best = t.save(best.withColumns({"level": F.lit(level), "corridor_nm": F.lit(None).cast("double"), "fallback": F.lit(None).cast("string")}))
    for r in range(1, refinements + 1):
        for retry in range(retries + 1):
            pending = best.where((F.col("completion") == "destination_reached") & (F.col("level") < level + r) & (F.col("fallback").isNull() if retry == 0 else F.col("fallback").startswith("?")))
            todo = t.save(requests.join(pending.select("request_id"), "request_id", "left_semi"))
            if todo.isEmpty():
                break
            width = corridor_nm * 2**retry
            mixed = t.save(mixed_leaves(todo, coarse, routes.select("request_id", "seq", "lat", "lon"), level, r, width))
            ways, found = lattice_search(todo, lattice_links(mixed), connectors(todo, mixed, level + r), wind, polar, options, bucket_s, **search)
            n = best.select("request_id", *(F.col(c).alias(f"o_{c}") for c in best.columns[1:])).join(found, "request_id", "left")
            tried, better = F.col("completion").isNotNull(), F.col("elapsed") <= F.col("o_elapsed")
            taken = F.coalesce(better, F.lit(False))
            why = F.when(F.col("completion") == "destination_reached", "?regressed").otherwise("?disconnected")
            pick = lambda c: F.when(taken, F.col(c)).otherwise(F.col(f"o_{c}")).alias(c)
            best = t.save(n.select("request_id", *map(pick, ("completion", "elapsed")), *((F.coalesce(F.col(c), F.lit(0)) + F.coalesce(F.col(f"o_{c}"), F.lit(0))).alias(c) for c in ("settled", "generated")), pick("rounds"), F.when(taken, level + r).otherwise(F.col("o_level")).alias("level"), F.when(taken, width).otherwise(F.col("o_corridor_nm")).alias("corridor_nm"), F.when(taken, F.lit(None).cast("string")).when(tried, why).otherwise(F.col("o_fallback")).alias("fallback")))
            won = best.where((F.col("level") == level + r) & (F.col("corridor_nm") == width)).select("request_id")
            routes = t.save(ways.join(won, "request_id", "left_semi").unionByName(routes.join(won, "request_id", "left_anti")))
        settled = F.when(F.col("fallback").startswith("?"), F.lit("retry_exhausted") if retries else F.substring("fallback", 2, 20)).otherwise(F.col("fallback"))
        best = t.save(best.withColumn("fallback", settled))
    return routes, best
