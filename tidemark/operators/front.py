"""The destination front, and beams in two levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import geodesy as G

from .ranking import band_winners, within_aperture


def destination_front(points: DataFrame, key: str, band_degrees: float, aperture: float = 180.0, least_run: int = 2) -> DataFrame:
    """(key, band, run, lat, lon, to_go): the point of each band nearest to the destination.

    points: (key, seq, lat, lon, to_lat, to_lon, axis): bands are by bearing seen from the
    destination relative to `axis`. Points outside the aperture don't count unless all are.
    Neighbouring bands make runs; the run of the axis' band and runs of at least
    `least_run` bands stay, all of them where none would.
    """
    off = G.wrap_longitude(G.initial_bearing("to_lat", "to_lon", "lat", "lon") - F.col("axis"))
    p = points.withColumn("off", off).withColumn("to_go", G.distance_nm("lat", "lon", "to_lat", "to_lon"))
    p = within_aperture(p, [key], F.abs("off") <= aperture).withColumn("band", F.floor(F.col("off") / band_degrees + 0.5).cast("long"))
    best = band_winners(p, [key], "band", ["to_go", "seq"])
    best = best.withColumn("run", F.col("band") - F.row_number().over(Window.partitionBy(key).orderBy("band")))
    run = Window.partitionBy(key, "run")
    best = best.withColumn("_keep", (F.count("*").over(run) >= least_run) | (F.max((F.col("band") == 0).cast("int")).over(run) == 1))
    return within_aperture(best, [key], F.col("_keep")).select(key, "band", "run", "lat", "lon", "to_go")


def two_level_beam(rows: DataFrame, keys: list[str], bucket: str, heading: str, order: list, per_bucket: int, width: int) -> DataFrame:
    """At most per_bucket rows of each bucket and width rows of each group of keys; rows of a heading not taken yet go first."""
    w = lambda *k: Window.partitionBy(*keys, *k)
    d = rows.withColumn("_again", F.row_number().over(w(bucket, heading).orderBy(*order)))
    d = d.withColumn("_n", F.row_number().over(w(bucket).orderBy("_again", *order))).where(F.col("_n") <= per_bucket)
    d = d.withColumn("_again", F.row_number().over(w(heading).orderBy(*order)))
    d = d.withColumn("_n", F.row_number().over(w().orderBy("_again", *order))).where(F.col("_n") <= width)
    return d.drop("_again", "_n")
