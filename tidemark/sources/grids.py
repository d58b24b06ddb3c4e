"""Forecast and environment grids from Parquet or CSV, checked on the way in."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.interpolation import GridSpec

#: Factors to m/s by unit, blanks and case aside.
UNITS = {"m/s": 1.0, "ms-1": 1.0, "ms**-1": 1.0, "kn": 0.5144444444444445, "kt": 0.5144444444444445, "knots": 0.5144444444444445, "km/h": 1 / 3.6, "kmh-1": 1 / 3.6, "cm/s": 0.01, "cms-1": 0.01}


def to_mps(value: Column, unit: Column) -> Column:
    """Value in m/s; an error for an unknown unit."""
    name = F.lower(F.regexp_replace(unit, r"\s", ""))
    out = F.when(unit.isNull(), F.lit(None).cast("double"))
    for u, f in UNITS.items():
        out = out.when(name == u, value * f)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown unit "), name)).cast("double"))


def wind_component(short_name: Column, level_type: Column, level: Column) -> Column:
    """u, v or null by a message's name and level (10 m above ground)."""
    ten = (level_type == "heightAboveGround") & (level == 10)
    n = F.lower(short_name)
    return F.when(n.isin("10u", "u10", "165") | (n == "u") & ten, "u").when(n.isin("10v", "v10", "166") | (n == "v") & ten, "v")


def crop(grid: DataFrame, j: tuple[int, int], i: tuple[int, int], ni: int) -> DataFrame:
    """Rows and columns of a window, ends included; a first column behind the last one wraps around. The predicate reaches the scan."""
    cols = F.col("i").between(*i) if i[0] <= i[1] else (F.col("i") >= i[0]) & (F.col("i") < ni) | (F.col("i") <= i[1])
    return grid.where(F.col("j").between(*j) & cols)


#: Shares of a span within which two places on an axis are one.
_CLOSE = 1e-8


def _same(a: float, b: float) -> bool:
    return abs(a - b) <= _CLOSE * max(1.0, abs(a), abs(b))


def grid_of_axes(first_lat: float, last_lat: float, first_lon: float, last_lon: float, nj: int, ni: int, dlat: float | None = None, dlon: float | None = None, eastward: bool = True) -> tuple[GridSpec, bool]:
    """The grid that a message's ends and counts describe, and whether its last column repeats the first one.

    A step that is not given, or not positive, follows from the ends. An error where steps,
    counts and last places contradict each other. A grid all around the earth wraps; a
    repeated column is not one of the grid's `ni` (see without_repeated_column).
    """
    if nj < 2 or ni < 2:
        raise ValueError("a grid needs two rows and columns")
    if not (dlon and math.isfinite(dlon) and dlon > 0):
        way = (last_lon - first_lon if eastward else first_lon - last_lon) % 360.0
        dlon = (way or 360.0) / (ni - 1)
    if not (dlat and math.isfinite(dlat) and dlat > 0):
        dlat = abs(last_lat - first_lat) / (nj - 1)
    if not (math.isfinite(dlat) and dlat > 0 and math.isfinite(dlon)):
        raise ValueError("a grid's steps must be positive")
    if not _same(abs(last_lat - first_lat), dlat * (nj - 1)):
        raise ValueError("the last latitude is not where the grid's step leads")
    ahead = first_lon + (dlon if eastward else -dlon) * (ni - 1)
    off = (ahead - last_lon + 180.0) % 360.0 - 180.0
    if abs(off) > _CLOSE * max(1.0, dlon * (ni - 1)):
        raise ValueError("the last longitude is not where the grid's step leads")
    repeated = _same(dlon * (ni - 1), 360.0)
    wraps = repeated or _same(dlon * ni, 360.0)
    west = (first_lon if eastward else last_lon) % 360.0
    return GridSpec(min(first_lat, last_lat), west - 360.0 if west >= 180.0 else west, dlat, dlon, nj, ni - repeated, wraps), repeated


def without_repeated_column(grid: DataFrame, spec: GridSpec) -> DataFrame:
    """The cells that a wrapping grid counts."""
    return grid.where(F.col("i") < spec.ni)


def window_of(spec: GridSpec, south: float, north: float, west: float, east: float) -> tuple[int, int, int, int]:
    """(first row, rows, first column, columns) that enclose a box, two of each at least; columns may run past the last one of a wrapping grid.

    A box whose east is less than its west crosses the antimeridian; -180 to 180 is all
    around. An error where the box reaches outside the grid.
    """
    if not (-90 <= south <= north <= 90 and -180 <= west <= 180 and -180 <= east <= 180):
        raise ValueError("a box needs latitudes in order and longitudes within 180")
    top = spec.south + spec.dlat * (spec.nj - 1)
    slack = _CLOSE * max(1.0, top - spec.south)
    if south < spec.south - slack or north > top + slack:
        raise ValueError("the box reaches outside the grid's latitudes")

    def enclosing(a: float, b: float, last: int) -> tuple[int, int]:
        first = min(math.floor(a), last - 1)
        return first, max(min(math.ceil(b), last), first + 1)

    at = lambda lat: (min(max(lat, spec.south), top) - spec.south) / spec.dlat
    j0, j1 = enclosing(at(south), at(north), spec.nj - 1)
    span = 360.0 if (west, east) == (-180.0, 180.0) else (east - west) % 360.0
    if spec.wraps and _same(span, 360.0):
        return j0, j1 - j0 + 1, 0, spec.ni
    ahead = (west - spec.west) % 360.0
    if not spec.wraps:
        own = spec.dlon * (spec.ni - 1)
        slack = _CLOSE * max(1.0, own)
        ahead = 0.0 if ahead > own + slack and 360.0 - ahead <= slack else ahead
        if ahead + span > own + slack:
            raise ValueError("the box reaches outside the grid's longitudes")
        i0, i1 = enclosing(ahead / spec.dlon, (ahead + span) / spec.dlon, spec.ni - 1)
        return j0, j1 - j0 + 1, i0, i1 - i0 + 1
    i0 = math.floor(ahead / spec.dlon)
    return j0, j1 - j0 + 1, i0 % spec.ni, min(max(math.ceil((ahead + span) / spec.dlon), i0 + 1) - i0 + 1, spec.ni)


def crop_to_bounds(grid: DataFrame, spec: GridSpec, south: float, north: float, west: float, east: float) -> tuple[DataFrame, GridSpec]:
    """The cells of a grid that enclose a box, numbered anew, and their grid.

    Rows and columns are ranges of the stored numbers, so the predicate reaches the scan and
    row groups outside are not read.
    """
    j0, nj, i0, ni = window_of(spec, south, north, west, east)
    end = i0 + ni - 1
    columns = F.col("i").between(i0, end) if end < spec.ni else (F.col("i") >= i0) & (F.col("i") < spec.ni) | (F.col("i") <= end - spec.ni)
    out = grid.where(F.col("j").between(j0, j0 + nj - 1) & columns)
    number = lambda name, x: x.cast(grid.schema[name].dataType).alias(name)
    kept = [number("j", F.col("j") - j0) if c == "j" else number("i", F.pmod(F.col("i") - i0, F.lit(spec.ni))) if c == "i" else F.col(c) for c in grid.columns]
    edge = (spec.west + i0 * spec.dlon + 180.0) % 360.0 - 180.0
    return out.select(*kept), GridSpec(spec.south + j0 * spec.dlat, edge, spec.dlat, spec.dlon, nj, ni, spec.wraps and ni == spec.ni)


def require_paired(cells: DataFrame) -> DataFrame:
    """Cells of pair_components; an error where one has a fault."""
    sound = F.when(F.col("fault").isNotNull(), F.raise_error(F.concat(F.lit("a wind cell is "), F.col("fault"))).cast("boolean")).otherwise(F.lit(True))
    return cells.where(sound).drop("fault")


def pair_components(u: DataFrame, v: DataFrame) -> DataFrame:
    """(valid_time, j, i, u, v); an error in `fault` where a cell has one component only."""
    keys = ["valid_time", "j", "i"]
    j = u.select(*keys, F.col("value").alias("u")).join(v.select(*keys, F.col("value").alias("v")), keys, "full_outer")
    return j.withColumn("fault", F.when(F.col("u").isNull() | F.col("v").isNull(), "unpaired"))


def read_grid(spark: SparkSession, path: str, columns: str = "valid_time timestamp, j int, i int, u double, v double") -> DataFrame:
    return spark.read.schema(columns).parquet(path)


def coverage(grid: DataFrame) -> DataFrame:
    """One row: first and last time, number of times, rows and columns."""
    return grid.agg(F.min("valid_time").alias("first"), F.max("valid_time").alias("last"), F.count_distinct("valid_time").alias("times"), F.count_distinct("j").alias("rows"), F.count_distinct("i").alias("columns"))
