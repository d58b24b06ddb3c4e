"""Weighted statistics over ensemble members, and the order among routes they give.

Outcomes are (run keys..., member, weight, elapsed, reached, class_rank): elapsed
seconds where reached, null otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.geodesy import distance_nm, normalize_degrees

from .ranking import top_k

#: Outcome classes in their order, best first.
OUTCOMES = ["reached", "forecast_exhausted", "duration_exhausted", "infeasible_no_route", "missing_data", "provider_failure", "cancelled", "other_error"]
#: The outcome class that each error of a member's search falls under; any other one is other_error.
ERROR_OUTCOMES = {
    "forecast_exhausted": "forecast_exhausted",
    "cancelled": "cancelled",
    "no_route": "infeasible_no_route",
    "incomplete_forecast": "missing_data",
    "departure_outside_forecast": "missing_data",
    "coordinate_outside_forecast": "missing_data",
    "environment_data_unavailable": "missing_data",
    "file_io": "missing_data",
    "grib_decode": "missing_data",
    "unsupported_grib": "missing_data",
    "invalid_environment": "provider_failure",
}


def class_rank(name: Column | str) -> Column:
    """The place of an outcome class in OUTCOMES, -1 for none of them."""
    name = F.col(name) if isinstance(name, str) else name
    return (F.array_position(F.array(*map(F.lit, OUTCOMES)), name) - 1).cast("int")


def outcome_of_error(code: Column | str) -> Column:
    code = F.col(code) if isinstance(code, str) else code
    out = F.when(F.lit(False), F.lit(""))
    for error, name in ERROR_OUTCOMES.items():
        out = out.when(code == error, name)
    return out.otherwise("other_error")


def normalize_weights(rows: DataFrame, keys: list[str], weight: str = "weight") -> DataFrame:
    """rows with normalized_weight: scaled by the largest, then by the sum, of each group."""
    w = Window.partitionBy(*keys)
    scaled = F.col(weight) / F.max(weight).over(w)
    return rows.withColumn("_scaled", scaled).withColumn("normalized_weight", F.col("_scaled") / F.sum("_scaled").over(w)).drop("_scaled")


def weighted_mean(elapsed: str = "elapsed", weight: str = "weight") -> Column:
    """Infinite where a member of positive weight did not arrive."""
    lost = F.max(F.when((F.col(weight) > 0) & F.col(elapsed).isNull(), 1).otherwise(0))
    mean = F.sum(F.when(F.col(weight) > 0, F.col(weight) * F.col(elapsed))) / F.sum(weight)
    return F.when(lost == 1, F.lit(float("inf"))).otherwise(mean)


def probability_before(target: float | Column, elapsed: str = "elapsed", weight: str = "weight") -> Column:
    return F.sum(F.when(F.col(elapsed) < target, F.col(weight)).otherwise(0.0)) / F.sum(weight)


def audits(elapsed: str = "elapsed", weight: str = "weight") -> list[Column]:
    """Weight that did not arrive, mean over those that did, and the worst of them."""
    there = F.col(elapsed).isNotNull() & (F.col(weight) > 0)
    return [
        (F.sum(F.when(F.col(elapsed).isNull(), F.col(weight)).otherwise(0.0)) / F.sum(weight)).alias("incomplete_weight"),
        (F.sum(F.when(there, F.col(weight) * F.col(elapsed))) / F.sum(F.when(there, F.col(weight)))).alias("finite_mean"),
        F.max(F.when(there, F.col(elapsed))).alias("worst_finite"),
    ]


def _grown(parts: Column, x: Column) -> Column:
    """Doubles that don't overlap, least first, whose sum is exactly that of `parts` and x."""

    def add(s: Column, p: Column) -> Column:
        total = s["q"] + p
        back = total - s["q"]
        lost = (s["q"] - (total - back)) + (p - back)
        return F.struct(total.alias("q"), F.when(lost != 0, F.array_append(s["h"], lost)).otherwise(s["h"]).alias("h"))

    start = F.struct(x.alias("q"), F.array().cast("array<double>").alias("h"))
    return F.aggregate(parts, start, add, lambda s: F.when(s["q"] != 0, F.array_append(s["h"], s["q"])).otherwise(s["h"]))


def exact_sum(values: Column) -> Column:
    """The exact sum of an array of doubles, as doubles that don't overlap, least first; none for a sum of 0."""
    return F.aggregate(values, F.array().cast("array<double>"), _grown)


def _first_to_reach(members: Column, n: int, d: int) -> Column:
    """Number (from 1) of the first member at which the weights so far, times d, reach all of them, times n: settled on exact sums."""
    times = lambda w, k: F.array_repeat(w, k)
    short = exact_sum(F.flatten(F.transform(members, lambda m: times(-m["weight"], n))))

    def step(s: Column, m: Column) -> Column:
        parts = F.aggregate(times(m["weight"], d), s["parts"], _grown)
        there = F.coalesce(F.element_at(F.when(F.size(parts) > 0, parts), -1) > 0, F.lit(True))
        return F.struct(parts.alias("parts"), (s["k"] + 1).alias("k"), F.coalesce(s["hit"], F.when(there, s["k"] + 1)).alias("hit"))

    start = F.struct(short.alias("parts"), F.lit(0).alias("k"), F.lit(None).cast("int").alias("hit"))
    return F.aggregate(members, start, step, lambda s: s["hit"])


def nearest_rank(rows: DataFrame, keys: list[str], shares: dict[str, tuple[int, int]], elapsed: str = "elapsed", weight: str = "weight", member: str = "member") -> DataFrame:
    """Weighted nearest-rank quantiles: the first elapsed time, members that did not arrive last, at which the
    weights so far reach the share (numerator, denominator, small integers) of all. Infinite where that member did not arrive.

    Sums of weights are exact: where rounding could decide (weights that are no whole numbers
    and a sum close to the share) they are added without error, of any size side by side. The
    members of one group are in one row there.
    """
    order = Window.partitionBy(*keys).orderBy(F.asc_nulls_last(elapsed), member)
    every = Window.partitionBy(*keys)
    x = F.col(weight).cast("double")
    w = rows.withColumns({"_so_far": F.sum(x).over(order.rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum(x).over(every), "_rank": F.row_number().over(order), "_value": F.coalesce(F.col(elapsed).cast("double"), F.lit(float("inf")))})
    whole = F.min((x == F.floor(x)).cast("int")).over(every) * (F.col("_all") < 2**46).cast("int")
    doubt = F.lit(False)
    for n, d in shares.values():
        doubt = doubt | (F.abs(F.col("_so_far") * d - F.col("_all") * n) <= F.col("_all") * 1e-9)
    w = w.withColumn("_doubt", F.max(((whole == 0) & doubt).cast("int")).over(every) == 1)
    plain = {name: F.min_by("_value", F.when(F.col("_so_far") * d >= F.col("_all") * n, F.col("_rank"))) for name, (n, d) in shares.items()}
    held = F.sort_array(F.collect_list(F.when(F.col("_doubt"), F.struct("_rank", x.alias("weight"), F.col("_value").alias("value")))))
    g = w.groupBy(*keys).agg(*(v.alias(name) for name, v in plain.items()), F.max("_doubt").alias("_doubt"), held.alias("_members"))
    exact = lambda n, d: F.get(F.col("_members"), _first_to_reach(F.col("_members"), n, d) - 1)["value"]
    return g.select(*keys, *(F.when(F.col("_doubt"), exact(n, d)).otherwise(F.col(name)).alias(name) for name, (n, d) in shares.items()))


def rival_score(rows: DataFrame, rival: DataFrame, keys: list[str], weight: str = "weight") -> DataFrame:
    """(keys..., score): weighted share of members that beat the rival; half for a tie.

    A better outcome class wins; between two arrivals the earlier one.
    """
    r = rival.select(*keys, "member", F.col("class_rank").alias("rank_r"), F.col("elapsed").alias("elapsed_r"))
    j = rows.join(r, [*keys, "member"])
    both = (F.col("class_rank") == 0) & (F.col("rank_r") == 0)
    win = F.when(F.col("class_rank") < F.col("rank_r"), 1.0).when(F.col("class_rank") > F.col("rank_r"), 0.0)
    win = win.when(both & (F.col("elapsed") < F.col("elapsed_r")), 1.0).when(both & (F.col("elapsed") > F.col("elapsed_r")), 0.0).otherwise(0.5)
    return j.groupBy(*keys).agg((F.sum(F.col(weight) * win) / F.sum(weight)).alias("score"))


def outcome_faults(rows: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., member, fault): members without exactly one outcome, and outcomes that contradict themselves.

    members: (keys..., member).
    """
    n = rows.groupBy(*keys, "member").agg(F.count("*").alias("n"), F.max(F.when((F.col("class_rank") == 0) & (F.col("elapsed").isNull() | (F.col("elapsed") < 0)) | (F.col("class_rank") > 0) & F.col("elapsed").isNotNull(), 1).otherwise(0)).alias("bad"))
    j = members.withColumn("_m", F.lit(1)).join(n, [*keys, "member"], "full_outer")
    fault = F.when(F.col("n").isNull(), "missing").when(F.col("_m").isNull(), "unknown").when(F.col("n") > 1, "repeated").when(F.col("bad") == 1, "contradictory")
    return j.withColumn("fault", fault).where("fault is not null").select(*keys, "member", "fault")


def member_support(rows: DataFrame, keys: list[str], choice: str, weight: str = "weight") -> DataFrame:
    """(keys..., choice, support): each member's weight goes to its best choices in equal parts."""
    best = F.rank().over(Window.partitionBy(*keys, "member").orderBy("class_rank", F.asc_nulls_last("elapsed")))
    won = rows.withColumn("_r", best).where("_r = 1")
    won = won.withColumn("_n", F.count("*").over(Window.partitionBy(*keys, "member")))
    return won.groupBy(*keys, choice).agg(F.sum(F.col(weight) / F.col("_n")).alias("support"))


def wrong_choice_cost(rows: DataFrame, keys: list[str], choice: str, selected: str, objective: Column | None = None, maximize: bool = False) -> DataFrame:
    """(keys..., choice, cost): how much worse each choice's objective is than that of the selected one, at least 0.

    objective: an aggregate, the mean arrival where none is given; less is better unless
    maximize. Infinite where only the worse one of both is without bound, 0 where both are.
    """
    mean = rows.groupBy(*keys, choice).agg((weighted_mean() if objective is None else objective).alias("mean"))
    own = F.max(F.when(F.col(choice) == selected, F.col("mean"))).over(Window.partitionBy(*keys))
    bad, good = (own, F.col("mean")) if maximize else (F.col("mean"), own)
    cost = F.when(F.isnull(own), F.lit(None).cast("double")).when(F.col("mean") == own, 0.0).when(good == float("inf"), 0.0).when(bad == float("inf"), float("inf"))
    cost = cost.otherwise(F.greatest(F.lit(0.0), F.when(F.lit(maximize), own - F.col("mean")).otherwise(F.col("mean") - own)))
    return mean.select(*keys, choice, cost.alias("cost"))


def spherical_centroid(lat: str = "lat", lon: str = "lon", weight: Column | None = None) -> tuple[Column, Column]:
    """Aggregates (lat, lon) of the weighted mean of unit vectors."""
    w = weight if weight is not None else F.lit(1.0)
    p, l = F.radians(lat), F.radians(lon)
    x, y, z = F.sum(w * F.cos(p) * F.cos(l)), F.sum(w * F.cos(p) * F.sin(l)), F.sum(w * F.sin(p))
    return F.degrees(F.atan2(z, F.sqrt(x * x + y * y))), F.degrees(F.atan2(y, x))


def circular_mean(degrees: str) -> Column:
    return F.degrees(F.atan2(F.avg(F.sin(F.radians(degrees))), F.avg(F.cos(F.radians(degrees)))))


def alignment(members: DataFrame, facts: list[str]) -> DataFrame:
    """One row: whether all members agree on each fact."""
    return members.agg(*((F.count_distinct(F.struct(F.col(f))) <= 1).alias(f"same_{f}") for f in facts))


def objective_order(prefix: str = "", maximize: bool = False) -> list[Column]:
    """Sort order of evaluated routes: objective (least first, or most), then incomplete weight, finite mean, worst
    arrival, states generated, states settled, identity. Null stands for infinite and comes last, first when maximizing.
    """
    first = F.desc_nulls_first if maximize else F.asc_nulls_last
    return [first(prefix + "objective"), *(F.asc_nulls_last(prefix + x) for x in ("incomplete_weight", "finite_mean", "worst_finite", "generated", "settled", "identity"))]


def beam_rank(states: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., the measures of beam_order) of labels, from their members' states.

    states: (keys..., weight, status `active`, `completed` or `failed`, lat, lon, elapsed, to_lat, to_lon).
    """
    w, away = F.col("weight"), distance_nm("lat", "lon", "to_lat", "to_lon")
    done = F.col("status") == "completed"
    lat, lon = spherical_centroid("lat", "lon", w)
    g = states.groupBy(*keys).agg(
        F.sum(F.when(F.col("status") == "failed", w).otherwise(0.0)).alias("failed_weight"),
        F.sum(F.when(done, w).otherwise(0.0)).alias("completed_weight"),
        F.sum(F.when(done, w * F.col("elapsed")).otherwise(0.0)).alias("completed_elapsed"),
        F.coalesce(F.max(F.when(done & (w > 0), F.col("elapsed"))), F.lit(0)).cast("double").alias("worst_completed"),
        F.sum(w * away).alias("weighted_distance"),
        F.coalesce(F.max(F.when(w > 0, away)), F.lit(0.0)).alias("worst_distance"),
        lat.alias("_lat"), lon.alias("_lon"), F.first("to_lat").alias("_to_lat"), F.first("to_lon").alias("_to_lon"),
    )
    return g.withColumn("centroid_distance", distance_nm("_lat", "_lon", "_to_lat", "_to_lon")).drop("_lat", "_lon", "_to_lat", "_to_lon")


def beam_order(identity: str) -> list[Column]:
    """Sort order of labels of a common-course beam, best first."""
    least = ("completed_elapsed", "worst_completed", "weighted_distance", "worst_distance", "centroid_distance", identity)
    return [F.asc("failed_weight"), F.desc("completed_weight"), *map(F.asc, least)]


def _beaten(rows: DataFrame, keys: list[str], label: str, comparable: Column, better: Column) -> DataFrame:
    """(keys..., label) of labels that another one of the group beats: comparable in all members, better in one."""
    b = rows.select(*keys, "member", *(F.col(x).alias(f"o_{x}") for x in rows.columns if x not in (*keys, "member")))
    j = rows.join(b, [*keys, "member"]).where(F.col(label) != F.col(f"o_{label}"))
    n = rows.groupBy(*keys, label).agg(F.count("*").alias("_n"))
    g = j.groupBy(*keys, label, f"o_{label}").agg(F.count("*").alias("_m"), F.min(comparable.cast("int")).alias("_all"), F.max(better.cast("int")).alias("_any"))
    return g.join(n, [*keys, label]).where("_m = _n and _all = 1 and _any = 1").select(*keys, label).distinct()


def undominated_terminals(outcomes: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Outcomes (keys..., label, member, weight, class_rank, elapsed) of the labels that no other one beats.

    One beats another when no member of positive weight fares worse under it and one fares
    better: arrivals by time, an arrival over none, and else by class.
    """
    rows = outcomes.where("weight > 0")
    here, there = F.col("class_rank"), F.col("o_class_rank")
    both = (here == 0) & (there == 0)
    no_worse = F.when(both, F.col("o_elapsed") <= F.col("elapsed")).otherwise(there <= here)
    better = F.when(both, F.col("o_elapsed") < F.col("elapsed")).otherwise(there < here)
    return outcomes.join(_beaten(rows, keys, label, no_worse, better), [*keys, label], "left_anti")


def policy_terminals(outcomes: DataFrame, evaluated: DataFrame, keys: list[str], label: str, most: int, maximize: bool = False) -> DataFrame:
    """(keys..., label, rank): of the undominated labels the best and at most `most` alternatives, by objective_order.

    evaluated: (keys..., label, the columns of objective_order).
    """
    left = undominated_terminals(outcomes, keys, label).select(*keys, label).distinct()
    return top_k(evaluated.join(left, [*keys, label], "left_semi"), keys, [*objective_order(maximize=maximize), F.asc(label)], most + 1).select(*keys, label, "rank")


def undominated_labels(states: DataFrame, keys: list[str], label: str, same: list[str]) -> DataFrame:
    """States (keys..., label, member, status, elapsed, same...) of the labels that no other one beats.

    Two labels compare only where every member stands at the same place in the same state
    (`same`, `status`), and, unless it has arrived, at the same time; the one beats the
    other where a member arrived earlier.
    """
    alike = F.col("status") == F.col("o_status")
    for c in same:
        alike = alike & F.col(c).eqNullSafe(F.col(f"o_{c}"))
    done = F.col("status") == "completed"
    comparable = alike & F.when(done, F.col("o_elapsed") <= F.col("elapsed")).otherwise(F.col("o_elapsed").eqNullSafe(F.col("elapsed")))
    return states.join(_beaten(states, keys, label, F.coalesce(comparable, F.lit(False)), F.coalesce(done & (F.col("o_elapsed") < F.col("elapsed")), F.lit(False))), [*keys, label], "left_anti")


def action_identity(kind, lat, lon, heading, seconds) -> Column:
    """A text that names a common action: a target, a heading for a time, or a wait; numbers by all their digits."""
    exact = lambda x: x.cast("string")
    target = F.concat(F.lit("target:"), exact(F.col(lat) + 0.0), F.lit(":"), exact(F.when(F.col(lon) == -180, 180.0).otherwise(F.col(lon) + 0.0)))
    sail = F.concat(F.lit("heading:"), exact(normalize_degrees(heading)), F.lit(":"), F.col(seconds).cast("string"))
    return F.when(F.col(kind) == "target", target).when(F.col(kind) == "heading_for_duration", sail).when(F.col(kind) == "wait_for_duration", F.concat(F.lit("wait:"), F.col(seconds).cast("string")))


def load_members(members: DataFrame, forecasts: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(members with normalized_weight, in order of their names, one row of alignment facts).

    members: (member, weight). forecasts: (member, initialized, valid_times array, south, west,
    dlat, dlon, nj, ni, variables array), a row each. An error for a member without a name, a
    name twice, a weight that is negative or not finite, weights that are all 0, or a member
    without a forecast; and, if strict, for members that differ in any fact.
    """
    w = F.col("weight")
    bad = members.select("member", F.when(F.coalesce(F.col("member"), F.lit("")) == "", "no name").when(w.isNull() | F.isnan(w) | (w < 0) | (w == float("inf")), "weight must be finite and not negative").alias("fault"))
    twice = members.groupBy("member").agg(F.count("*").alias("n")).where("n > 1").select("member", F.lit("name twice").alias("fault"))
    lone = members.join(forecasts, "member", "left_anti").select("member", F.lit("no forecast").alias("fault"))
    first = bad.unionByName(twice).unionByName(lone).where("fault is not null").orderBy("member", "fault").first()
    if first is not None:
        raise ValueError(f"ensemble member {first['member']!r}: {first['fault']}")
    if not (members.agg(F.max("weight")).first()[0] or 0) > 0:
        raise ValueError("the weights of an ensemble must not all be 0")
    f = forecasts.join(members.select("member"), "member", "left_semi")
    east = F.col("west") + F.col("dlon") * (F.col("ni") - 1)
    facts = {
        "initialization": [F.col("initialized")],
        "valid_times": [F.array_sort("valid_times")],
        "horizon": [F.array_min("valid_times"), F.array_max("valid_times")],
        "grid": [F.col(x) for x in ("south", "dlat", "dlon", "nj", "ni")] + [F.pmod("west", F.lit(360.0))],
        "coverage": [F.col("south"), F.col("south") + F.col("dlat") * (F.col("nj") - 1), F.pmod("west", F.lit(360.0)), F.pmod(east, F.lit(360.0))],
        "variables": [F.array_sort("variables")],
    }
    rows = f.select(*(F.struct(*(x.alias(f"_{i}") for i, x in enumerate(xs))).alias(name) for name, xs in facts.items()))
    aligned = alignment(rows, list(facts))
    if strict:
        got = aligned.first().asDict()
        off = [x for x in ("initialization", "valid_times", "grid", "coverage", "variables") if not got[f"same_{x}"]]
        if off:
            raise ValueError(f"members of a strict ensemble differ in {', '.join(off)}")
    return normalize_weights(members, []).orderBy("member"), aligned


def member_report(members: DataFrame, forecasts: DataFrame) -> DataFrame:
    """(member, weight, normalized_weight, fault, message, differs): a row for each member, broken ones too.

    members and forecasts as load_members takes them. fault: null, or the error that
    outcome_of_error knows: invalid_argument (no name, a name twice, a weight that is negative
    or not finite), file_io (no forecast), incomplete_forecast (no times, or not both wind
    components). normalized_weight is a share of all valid weights, so what a broken member had
    is missing from the others' sum. differs: the facts in which a sound member is unlike the
    first sound one by name.
    """
    w = F.col("weight")
    named = F.coalesce(F.col("member"), F.lit("")) != ""
    valid = F.coalesce(~F.isnan(w) & (w >= 0) & (w < float("inf")), F.lit(False))
    per_name = F.count("*").over(Window.partitionBy("member"))
    held = forecasts.select(F.col("member").alias("_member"), F.struct(*(F.col(x) for x in forecasts.columns if x != "member")).alias("_f"))
    m = members.withColumn("_n", per_name).join(held, F.col("member") == F.col("_member"), "left")
    times, both = F.size("_f.valid_times"), F.array_contains("_f.variables", "u") & F.array_contains("_f.variables", "v")
    why = F.when(~named, F.struct(F.lit("invalid_argument").alias("fault"), F.lit("no name").alias("message")))
    for wrong, fault, message in (
        (F.col("_n") > 1, "invalid_argument", "name twice"),
        (~valid, "invalid_argument", "weight must be finite and not negative"),
        (F.col("_member").isNull(), "file_io", "no forecast"),
        (F.coalesce(times < 1, F.lit(True)), "incomplete_forecast", "no times"),
        (~F.coalesce(both, F.lit(False)), "incomplete_forecast", "wind components are missing"),
    ):
        why = why.when(wrong, F.struct(F.lit(fault).alias("fault"), F.lit(message).alias("message")))
    m = m.withColumn("_w", why).withColumn("_ok", F.when(valid, w).otherwise(0.0))
    m = m.join(F.broadcast(m.agg(F.max("_ok").alias("_most"), F.sum("_ok").alias("_sum"))), F.lit(True))
    first = m.where("_w is null").agg(F.min_by("_f", "member").alias("_first"))
    m = m.join(F.broadcast(first), F.lit(True))
    lon = lambda f, x: F.pmod(f[x], F.lit(360.0))
    facts = {
        "initialization": lambda f: f["initialized"],
        "valid_times": lambda f: F.array_sort(f["valid_times"]),
        "grid": lambda f: F.struct(f["south"], f["dlat"], f["dlon"], f["nj"], f["ni"], lon(f, "west")),
        "variables": lambda f: F.array_sort(f["variables"]),
    }
    unlike = F.filter(F.array(*(F.when(~of(F.col("_f")).eqNullSafe(of(F.col("_first"))), name) for name, of in facts.items())), lambda x: x.isNotNull())
    share = F.when(F.col("_sum") > 0, F.col("_ok") / F.col("_sum"))
    return m.select("member", "weight", share.alias("normalized_weight"), "_w.fault", "_w.message", F.when(F.col("_w").isNull(), unlike).alias("differs"))


def rival_json(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., json): the outcomes (member, class_rank, elapsed) of a rival as a document, by member."""
    name = F.get(F.array(*map(F.lit, OUTCOMES)), F.col("class_rank").cast("int"))
    one = F.struct(F.col("member").alias("memberIdentifier"), name.alias("outcomeClass"), F.col("elapsed").alias("elapsedArrivalSeconds"))
    return rows.groupBy(*keys).agg(F.to_json(F.struct(F.sort_array(F.collect_list(one)).alias("outcomes"))).alias("json"))


def read_rival_json(documents: DataFrame, keys: list[str], text: str = "json") -> DataFrame:
    """(keys..., member, class_rank, elapsed) of rival documents; an error for a class that is none of OUTCOMES."""
    kind = "struct<outcomes: array<struct<memberIdentifier: string, outcomeClass: string, elapsedArrivalSeconds: double>>>"
    rows = documents.select(*keys, F.explode(F.from_json(text, kind, {"mode": "FAILFAST"})["outcomes"]).alias("o"))
    rank = class_rank(F.col("o.outcomeClass"))
    return rows.select(*keys, F.col("o.memberIdentifier").alias("member"), F.when(rank < 0, F.raise_error(F.concat(F.lit("unknown outcome class "), F.col("o.outcomeClass"))).cast("int")).otherwise(rank).alias("class_rank"), F.col("o.elapsedArrivalSeconds").alias("elapsed"))
