"""Lines for display: chains of points, and lines broken where they cross the antimeridian."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.geodesy import wrap_longitude


def split_at_antimeridian(paths: DataFrame, keys: list[str], seq: str = "seq", closed: Column | None = None) -> DataFrame:
    """(keys..., part, seq, lat, lon, closed): lines (keys..., seq, lat, lon), broken where an edge spans more than 180 degrees of longitude.

    The broken edge gets the latitude of its crossing on both sides; the part behind it starts
    there. A point that lies on the antimeridian itself is that start, not a second point.
    closed: whether a line returns to its first point (a condition that is the same in all
    its rows); that edge is looked at too, but its end is not repeated, and a line that is
    broken is not closed any more. Parts and their points are numbered from 0.
    """
    ring = F.lit(False) if closed is None else closed
    p = paths.select(*keys, F.col(seq).alias("_s"), "lat", "lon", ring.alias("_ring"))
    order = Window.partitionBy(*keys).orderBy("_s")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    here = F.struct("lat", "lon")
    around = F.when(F.col("_ring") & (F.count("*").over(whole) > 1), F.first(here).over(whole))
    p = p.withColumns({"_to": F.coalesce(F.lead(here).over(order), around), "_from": F.lag(here).over(order)})
    spans = lambda a, b: F.abs(b - a) > 180
    breaks = F.coalesce(spans(F.col("lon"), F.col("_to.lon")), F.lit(False))
    way = wrap_longitude(F.col("_to.lon") - F.col("lon"))
    # a way of exactly half the world is not a break, so the sign of the way tells its side
    edge = F.when(way > 0, 180.0).otherwise(-180.0)
    # an edge between both names of the antimeridian has no way to go
    at = F.col("lat") + F.coalesce(F.try_divide(edge - F.col("lon"), way), F.lit(1.0)) * (F.col("_to.lat") - F.col("lat"))
    onto = F.coalesce(spans(F.col("_from.lon"), F.col("lon")) & (F.abs("lon") == 180), F.lit(False))
    row = lambda lat, lon, start: F.struct(lat.alias("lat"), lon.alias("lon"), F.lit(start).alias("start"))
    own = F.when(onto, F.array()).otherwise(F.array(row(F.col("lat"), F.col("lon"), 0)))
    crossing = F.when(breaks, F.array(row(at, edge, 0), row(at, -edge, 1))).otherwise(F.array())
    p = p.select(*keys, "_s", "_ring", breaks.cast("int").alias("_broken"), F.posexplode(F.concat(own, crossing)).alias("_k", "_p"))
    order = Window.partitionBy(*keys).orderBy("_s", "_k")
    p = p.withColumn("part", F.sum("_p.start").over(order).cast("long"))
    p = p.withColumn("closed", F.col("_ring") & (F.max("_broken").over(Window.partitionBy(*keys)) == 0))
    number = F.row_number().over(Window.partitionBy(*keys, "part").orderBy("_s", "_k")) - 1
    return p.select(*keys, "part", number.cast("long").alias("seq"), "_p.lat", "_p.lon", "closed")


def chains(points: DataFrame, keys: list[str], order: list[str], alpha: Column | float | None = None) -> DataFrame:
    """points (keys..., x, y) with `chain`, numbered from 0: points in order, a new chain where the gap is more than twice alpha.

    For points that have no area (on a line, or fewer than three). Without alpha all are one chain.
    """
    if alpha is None:
        return points.withColumn("chain", F.lit(0).cast("long"))
    w = Window.partitionBy(*keys).orderBy(*order)
    gap = F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), 2) + F.pow(F.col("y") - F.lag("y").over(w), 2))
    far = F.coalesce(gap > 2 * (alpha if isinstance(alpha, Column) else F.lit(float(alpha))), F.lit(False))
    return points.withColumn("_far", far.cast("int")).withColumn("chain", F.sum("_far").over(w).cast("long")).drop("_far")
