"""Ranking within buckets, diverse top-k, skylines, fronts and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.geodesy import angular_difference


def top_k(rows: DataFrame, keys: list[str], order: list[Column | str], k: int) -> DataFrame:
    """The k first rows of each group, with their rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col("rank") <= k)


def diverse_top_k(rows: DataFrame, keys: list[str], order: list[Column | str], heading: str, k: int) -> DataFrame:
    """At most k rows of each group: the first by `order`, then each time the row whose heading is farthest from
    all taken ones, earlier rows first among equals. `picked` numbers them from 1.

    One window over the group for each pick; all share one shuffle and none gathers a group in memory as objects.
    """
    group = Window.partitionBy(*keys)
    df = rows.withColumn("_rank", F.row_number().over(group.orderBy(*order)))
    df = df.withColumn("picked", F.when(F.col("_rank") == 1, 1))
    df = df.withColumn("_apart", angular_difference(heading, F.max(F.when(F.col("_rank") == 1, F.col(heading))).over(group)))
    for pick in range(2, k + 1):
        best = F.max(F.when(F.col("picked").isNull(), F.struct(F.col("_apart"), (-F.col("_rank")).alias("r"), F.col(heading).alias("h")))).over(group)
        df = df.withColumn("_best", best)
        df = df.withColumn("picked", F.when(F.col("picked").isNotNull(), F.col("picked")).when(-F.col("_rank") == F.col("_best.r"), pick))
        df = df.withColumn("_apart", F.least("_apart", angular_difference(heading, F.col("_best.h"))))
    return df.where("picked is not null").drop("_rank", "_apart", "_best")


def skyline(rows: DataFrame, key: str, minimize: list[str], on: list[str] | None = None) -> DataFrame:
    """Rows of each group that no other row beats: at least as good in all and better in one of `minimize`.

    Rows can be beaten only by rows before them in the order of all columns, so two
    passes do: a running minimum drops most, an anti join among the survivors settles.
    """
    on = on or []
    first, rest = minimize[0], minimize[1:]
    if len(rest) == 1:
        w = Window.partitionBy(*on).orderBy(first).rangeBetween(Window.unboundedPreceding, -1) if on else Window.orderBy(first)
        return _skyline2(rows, on, first, rest[0], w)
    other = rows.select(*(F.col(c).alias(f"o_{c}") for c in [*on, *minimize]))
    cond = F.lit(True)
    for c in on:
        cond = cond & (F.col(c) == F.col(f"o_{c}"))
    some = F.lit(False)
    for c in minimize:
        cond = cond & (F.col(f"o_{c}") <= F.col(c))
        some = some | (F.col(f"o_{c}") < F.col(c))
    return rows.join(other, cond & some, "left_anti")


def _skyline2(rows: DataFrame, on: list[str], a: str, b: str, w) -> DataFrame:
    """Two criteria: per value of the first the least second; it must be under all seconds before it."""
    best = rows.groupBy(*on, a).agg(F.min(b).alias("_b"))
    order = (Window.partitionBy(*on) if on else Window.partitionBy(F.lit(1))).orderBy(a).rowsBetween(Window.unboundedPreceding, -1)
    best = best.withColumn("_before", F.min("_b").over(order)).where("_before is null or _b < _before")
    keep = best.select(*(F.col(c).alias(f"k_{c}") for c in on), F.col(a).alias("_ka"), F.col("_b").alias("_kb"))
    cond = (F.col(a) == F.col("_ka")) & (F.col(b) == F.col("_kb"))
    for c in on:
        cond = cond & (F.col(c) == F.col(f"k_{c}"))
    return rows.join(keep, cond, "left_semi")


def band_winners(rows: DataFrame, keys: list[str], band: str, order: list[Column | str]) -> DataFrame:
    """The first row of each band."""
    return top_k(rows, [*keys, band], order, 1).drop("rank")


def contiguous_runs(rows: DataFrame, keys: list[str], band: str) -> DataFrame:
    """(keys..., run_start, run_end, n): maximal runs of consecutive bands."""
    d = rows.select(*keys, band).distinct()
    d = d.withColumn("_island", F.col(band) - F.row_number().over(Window.partitionBy(*keys).orderBy(band)))
    return d.groupBy(*keys, "_island").agg(F.min(band).alias("run_start"), F.max(band).alias("run_end"), F.count("*").alias("n")).drop("_island")


def within_aperture(rows: DataFrame, keys: list[str], inside: Column) -> DataFrame:
    """Rows inside; all rows of a group that has none inside."""
    any_in = F.max(inside.cast("int")).over(Window.partitionBy(*keys))
    return rows.withColumn("_in", inside).withColumn("_any", any_in).where("_in or _any = 0").drop("_in", "_any")


def running_total(rows: DataFrame, keys: list[str], order: list[Column | str], value: str, name: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.sum(value).over(w))


def edge_multiplicity(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(a, b, n): undirected edges with how often they occur; those with n = 1 bound the shape."""
    return edges.groupBy(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).agg(F.count("*").alias("n"))


def require_at_most(rows: DataFrame, limit: int, what: str) -> DataFrame:
    """rows, or an error where there are more than the limit. Nothing is cut off."""
    n = rows.limit(limit + 1).count()
    if n > limit:
        raise ValueError(f"more than {limit} {what}")
    return rows


def total_counters(rows: DataFrame, keys: list[str], counters: list[str]) -> DataFrame:
    """(keys..., counters): counters of parts of a search summed; a part that lacks one counts 0."""
    return rows.groupBy(*keys).agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in counters))


def distinct_union(tables: list[DataFrame]) -> DataFrame:
    """Rows of any of the tables, each once."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.distinct()


def edge_difference(edges: DataFrame, gone: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Undirected edges (a <= b), each once, that are not among those gone."""
    ordered = lambda e: e.select(F.least(a, b).alias(a), F.greatest(a, b).alias(b)).distinct()
    return ordered(edges).join(ordered(gone), [a, b], "left_anti")


def distinct_positions(points: DataFrame, digits: int | None = None) -> DataFrame:
    """(lat, lon): places, each once, rounded to digits where given; both names of the antimeridian are one."""
    at = lambda x: (F.col(x) if digits is None else F.round(x, digits)) + 0.0
    return points.select(at("lat").alias("lat"), F.when(at("lon") == -180, 180.0).otherwise(at("lon")).alias("lon")).distinct()
