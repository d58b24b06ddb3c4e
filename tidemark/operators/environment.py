"""Current, wave and land fields: sampling with a policy for missing data, and certified legs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import geodesy as G

from .exclusions import segment_zone_hits
from .interpolation import GridSpec, bilinear
from .shared import Steps


def uniform_field(spark: SparkSession, **values: float) -> DataFrame:
    """One row of constants."""
    bad = [k for k, v in values.items() if v != v or abs(v) == float("inf")]
    if bad:
        raise ValueError(f"not finite: {bad}")
    return spark.range(1).select(*(F.lit(float(v)).alias(k) for k, v in values.items()))


def checked_grid(grid: DataFrame, spec: GridSpec, values: list[str], least: float | None = None) -> DataFrame:
    """grid, after a look that every cell is there once with finite values (at least `least`)."""
    ok = F.lit(True)
    for v in values:
        ok = ok & F.col(v).isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
        ok = ok & (F.col(v) >= least) if least is not None else ok
    n, cells, good = grid.agg(F.count("*"), F.count_distinct("j", "i"), F.sum(F.coalesce(ok, F.lit(False)).cast("long"))).first()
    if not n == cells == good == spec.nj * spec.ni:
        raise ValueError(f"{spec.nj * spec.ni} cells wanted, {n} rows with {cells} cells and {good} good ones found")
    return grid


#: The counters of a search's environment, each a sum over rows.
COUNTERS = ["current_samples", "current_missing", "current_rejections", "wave_samples", "wave_missing", "wave_rejections", "land_checks", "land_rejections", "exclusion_checks", "exclusion_rejections", "derating_evaluations"]


def total_counters(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by..., counters): COUNTERS summed over rows that carry some of them; those they lack are 0."""
    return rows.groupBy(*by).agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) if c in rows.columns else F.lit(0).cast("long").alias(c) for c in COUNTERS))


def sample(rows: DataFrame, key: str, grid: DataFrame, spec: GridSpec, values: list[str], policy: str = "ignore", default: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(rows with values, one row of counters).

    policy where a value is missing: `ignore` puts the default, `reject` drops the row,
    `fail` raises an error when the row is read.
    """
    if policy not in ("ignore", "reject", "fail"):
        raise ValueError(f"unknown policy {policy!r}")
    got = bilinear(rows, key, grid, spec, values)
    j = rows.join(got, key, "left")
    lost = F.lit(False)
    for v in values:
        lost = lost | F.col(v).isNull()
    j = j.withColumn("_lost", lost)
    counters = j.agg(F.count("*").alias("sampled"), F.sum(F.col("_lost").cast("long")).alias("missing"))
    if policy == "reject":
        j = j.where("not _lost")
    elif policy == "fail":
        j = j.where(F.when(F.col("_lost"), F.raise_error(F.lit("missing environment data")).cast("boolean")).otherwise(F.lit(True)))
    return j.withColumns({v: F.coalesce(F.col(v), F.lit(default)) for v in values}).drop("_lost"), counters


def certify_legs(legs: DataFrame, key: str, land_distance: Callable[[DataFrame], DataFrame], required: float, depth: int = 6) -> DataFrame:
    """(key, clear): legs (key, lat1, lon1, lat2, lon2) whose distance from land is proved to be enough all along.

    land_distance: takes (pid, lat, lon) and gives (pid, distance), signed, positive over
    water. Distance changes by at most the way gone, so a leg whose ends are far enough
    for its length is clear. Others are halved up to `depth` times, one round each for
    all legs; what then is undecided, or has no distance, is not clear.
    """
    t = Steps(legs.sparkSession, "legs")
    open_ = legs.select(F.col(key).alias("key"), F.lit(1).cast("long").alias("part"), "lat1", "lon1", "lat2", "lon2")
    failed = None
    for level in range(depth + 1):
        ends = open_.select(F.posexplode(F.array(F.struct("key", "part", F.col("lat1").alias("lat"), F.col("lon1").alias("lon")), F.struct("key", "part", F.col("lat2").alias("lat"), F.col("lon2").alias("lon")))).alias("side", "e"))
        ends = ends.select(F.struct("e.key", "e.part", "side").alias("pid"), "e.lat", "e.lon")
        far = land_distance(ends).select(F.col("pid.key").alias("key"), F.col("pid.part").alias("part"), F.col("pid.side").alias("side"), "distance")
        far = far.groupBy("key", "part").agg(F.sum("distance").alias("both"), F.count("distance").alias("n"), F.min("distance").alias("least"))
        j = open_.join(far, ["key", "part"], "left").withColumn("leg", G.distance_nm("lat1", "lon1", "lat2", "lon2"))
        ok = F.coalesce((F.col("n") == 2) & ((F.col("both") - F.col("leg")) / 2 >= required), F.lit(False))
        hopeless = F.coalesce((F.col("n") < 2) | (F.col("least") < required), F.lit(True))
        j = j.withColumn("ok", ok).withColumn("hopeless", hopeless if level < depth else F.lit(True))
        j = t.save(j).where("not ok")
        lost = j.where("hopeless").select("key")
        failed = lost if failed is None else failed.union(lost)
        open_ = j.join(failed.distinct(), "key", "left_anti")
        if open_.isEmpty():
            break
        a, b = G.unit_vector("lat1", "lon1"), G.unit_vector("lat2", "lon2")
        mid = G.slerp(a, b, 0.5)
        open_ = open_.withColumn("m", mid)
        m = F.degrees(F.asin(F.get("m", F.lit(2)))), F.degrees(F.atan2(F.get("m", F.lit(1)), F.get("m", F.lit(0))))
        half = lambda k, *p: F.struct((F.col("part") * 2 + k).alias("part"), *(x.alias(n) for x, n in zip(p, ("lat1", "lon1", "lat2", "lon2"), strict=True)))
        both = F.array(half(0, F.col("lat1"), F.col("lon1"), *m), half(1, *m, F.col("lat2"), F.col("lon2")))
        open_ = open_.select("key", F.explode(both).alias("h")).select("key", "h.part", "h.lat1", "h.lon1", "h.lat2", "h.lon2")
    return legs.select(key).join(failed.distinct().select(F.col("key").alias(key), F.lit(False).alias("clear")), key, "left").select(key, F.coalesce("clear", F.lit(True)).alias("clear"))


def clear_of_land(legs: DataFrame, key: str, land_distance: Callable[[DataFrame], DataFrame], required: float, depth: int = 6) -> DataFrame:
    """The legs (key, lat1, lon1, lat2, lon2, ...) that certify_legs proves clear."""
    proved = certify_legs(legs, key, land_distance, required, depth).where("clear").select(key)
    return legs.join(proved, key, "left_semi")


def clear_legs(legs: DataFrame, key: str, land_distance: Callable[[DataFrame], DataFrame] | None, required: float, zones: DataFrame | None, boundary_excluded: bool = True) -> tuple[DataFrame, DataFrame]:
    """(legs clear of land and of zones, one row of counters). Zones are looked at only for legs that land leaves.

    legs: (key, lat1, lon1, lat2, lon2, t1, t2). counters: land_checks, land_rejections, exclusion_checks, exclusion_rejections.
    """
    dry = clear_of_land(legs, key, land_distance, required) if land_distance is not None else legs
    left = dry.join(segment_zone_hits(dry.select(key, "lat1", "lon1", "lat2", "lon2", "t1", "t2"), key, zones, boundary_excluded), key, "left_anti") if zones is not None else dry
    n = lambda df, name: df.agg(F.count("*").alias(name))
    c = n(legs, "a").join(n(dry, "b"), F.lit(True)).join(n(left, "c"), F.lit(True))
    land, zone = F.lit(int(land_distance is not None)), F.lit(int(zones is not None))
    return left, c.select((land * F.col("a")).alias("land_checks"), (F.col("a") - F.col("b")).alias("land_rejections"), (zone * F.col("b")).alias("exclusion_checks"), (F.col("b") - F.col("c")).alias("exclusion_rejections"))
