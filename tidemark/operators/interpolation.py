"""Forecast grids as long tables, and lookups in them as bracket joins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.geodesy import c, let


@dataclass(frozen=True)
class GridSpec:
    """Regular grid: row j at south + j * dlat, column i at west + i * dlon; a global one wraps."""

    south: float
    west: float
    dlat: float
    dlon: float
    nj: int
    ni: int
    wraps: bool = False

    def __post_init__(self):
        if self.nj < 2 or self.ni < 2 or self.dlat <= 0 or self.dlon <= 0:
            raise ValueError("a grid needs two rows and columns and positive steps")

    def corners(self, lat, lon) -> Column:
        """array of struct(j, i, w): the four corners around a position with their bilinear weights; null outside."""
        y = (c(lat) - self.south) / self.dlat
        away = F.pmod(c(lon) - self.west, F.lit(360.0))
        x = away / self.dlon
        j = F.least(F.floor(y), F.lit(self.nj - 2)).cast("int")
        i = F.floor(x).cast("int") if self.wraps else F.least(F.floor(x), F.lit(self.ni - 2)).cast("int")
        fy, fx = y - j, x - i
        i1 = F.pmod(i + 1, F.lit(self.ni)) if self.wraps else i + 1
        i0 = F.pmod(i, F.lit(self.ni)) if self.wraps else i
        cell = lambda jj, ii, w: F.struct(jj.alias("j"), ii.alias("i"), w.alias("w"))
        inside = (y >= 0) & (y <= self.nj - 1) & (F.lit(True) if self.wraps else x <= self.ni - 1)
        return F.when(inside, F.array(cell(j, i0, (1 - fy) * (1 - fx)), cell(j, i1, (1 - fy) * fx), cell(j + 1, i0, fy * (1 - fx)), cell(j + 1, i1, fy * fx)))


#: Rows that a join sends to every executor; a larger table is left to Spark's own choice.
BROADCAST_ROWS = 100_000
#: Values of a grid that are sent to every executor as arrays; a larger grid is joined cell by cell.
PACKED_VALUES = 2_000_000


def small(df: DataFrame) -> DataFrame:
    """The table marked for broadcast when a count shows that it is small enough."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def time_slices(times: DataFrame, t: str = "valid_time") -> DataFrame:
    """(t0, t1): each slice with the next one; t1 is null for the last."""
    return times.select(F.col(t).alias("t0")).distinct().withColumn("t1", F.lead("t0").over(Window.orderBy("t0")))


def time_brackets(rows: DataFrame, slices: DataFrame, at: str) -> DataFrame:
    """rows with t0, t1 and share (0 at t0): the slices around `at`; t0 is null outside the forecast.

    slices: a few rows, one for each forecast time; sent to every executor after a count of them.
    """
    s = small(slices)
    ok = (F.col(at) >= s["t0"]) & (F.col(at) < s["t1"]) | (F.col(at) == s["t0"]) & s["t1"].isNull()
    j = rows.join(s, ok, "left")
    gap = F.unix_timestamp("t1") - F.unix_timestamp("t0")
    return j.withColumn("share", F.when(F.col("t0").isNotNull(), F.coalesce((F.unix_timestamp(at) - F.unix_timestamp("t0")) / gap, F.lit(0.0))))


def bilinear(rows: DataFrame, key: str, grid: DataFrame, spec: GridSpec, values: list[str], lat: str = "lat", lon: str = "lon", on: list[str] | None = None) -> DataFrame:
    """(key, on..., values): each row's position looked up in `grid` (j, i, on..., values).

    Corners of weight 0 don't count; a missing or NaN corner of other weight makes the value null.
    """
    on = on or []
    four = rows.select(key, *on, F.explode(spec.corners(lat, lon)).alias("_c")).select(key, *on, "_c.j", "_c.i", "_c.w").where("w <> 0")
    j = four.join(grid, [*on, "j", "i"], "left")
    whole = lambda v: F.count(F.when(F.col(v).isNotNull() & ~F.isnan(v), 1)) == F.count("*")
    return j.groupBy(key, *on).agg(*(F.when(whole(v), F.sum(F.col("w") * F.col(v))).alias(v) for v in values))


def trilinear(rows: DataFrame, key: str, grid: DataFrame, spec: GridSpec, values: list[str], at: str = "ts", lat: str = "lat", lon: str = "lon", on: list[str] | None = None) -> DataFrame:
    """(key, values..., status) by bilinear lookup in the two slices around `at`, then linear in time.

    grid: (valid_time, j, i, on..., values); all of `on` share the times. status: ok, or what fails first of out_of_bounds,
    out_of_time, incomplete_forecast.
    """
    on = on or []
    inside = rows.withColumn("_in", spec.corners(lat, lon).isNotNull())
    b = time_brackets(inside, time_slices(grid), at)
    both = F.array(F.struct(F.col("t0").alias("valid_time"), (1 - F.col("share")).alias("s")), F.struct(F.col("t1").alias("valid_time"), F.col("share").alias("s")))
    two = b.where("_in and t0 is not null").withColumn("_t", F.explode(both)).select("*", "_t.valid_time", "_t.s").where("s > 0")
    cells = two.select(key, *on, "valid_time", "s", F.explode(spec.corners(lat, lon)).alias("_c")).select(key, *on, "valid_time", "s", "_c.j", "_c.i", "_c.w").where("w <> 0")
    j = cells.join(grid, [*on, "valid_time", "j", "i"], "left")
    whole = lambda v: F.count(F.when(F.col(v).isNotNull() & ~F.isnan(v), 1)) == F.count("*")
    got = j.groupBy(key).agg(*(F.when(whole(v), F.sum(F.col("s") * F.col("w") * F.col(v))).alias(v) for v in values))
    out = b.select(key, "_in", "t0").join(got, key, "left")
    missing = F.lit(False)
    for v in values:
        missing = missing | F.col(v).isNull()
    status = F.when(~F.col("_in"), "out_of_bounds").when(F.col("t0").isNull(), "out_of_time").when(missing, "incomplete_forecast").otherwise("ok")
    return out.select(key, *values, status.alias("status"))


def packed_slices(grid: DataFrame, spec: GridSpec, values: list[str], on: list[str] | None = None) -> DataFrame | None:
    """(on..., t0, t1, a0_value.., a1_value..): for each slice its values and the next one's as arrays by cell; null cells stay null.

    None where the grid has more than PACKED_VALUES values.
    """
    on = on or []
    if grid.limit(PACKED_VALUES // len(values) + 1).count() > PACKED_VALUES // len(values):
        return None
    places = grid.sparkSession.range(spec.nj * spec.ni).select(F.col("id").alias("_c"))
    every = grid.select(*on, "valid_time").distinct().join(F.broadcast(places), F.lit(True))
    at = grid.select(*on, "valid_time", (F.col("j") * spec.ni + F.col("i")).cast("long").alias("_c"), *values)
    dense = every.join(at, [*on, "valid_time", "_c"], "left").groupBy(*on, "valid_time")
    finite = lambda v: F.when(~F.isnan(v), F.col(v))
    cells = dense.agg(F.sort_array(F.collect_list(F.struct("_c", *(finite(v).alias(v) for v in values)))).alias("_s"))
    cells = cells.select(*on, F.col("valid_time").alias("t0"), *(F.col(f"_s.{v}").alias(f"a0_{v}") for v in values))
    order = Window.partitionBy(*on).orderBy("t0") if on else Window.partitionBy(F.lit(0)).orderBy("t0")
    return cells.select("*", F.lead("t0").over(order).alias("t1"), *(F.lead(f"a0_{v}").over(order).alias(f"a1_{v}") for v in values))


def trilinear_packed(rows: DataFrame, packed: DataFrame, spec: GridSpec, values: list[str], at: str = "ts", lat: str = "lat", lon: str = "lon", on: list[str] | None = None) -> DataFrame:
    """rows with values and status as `trilinear` gives them, from packed_slices: one broadcast, no shuffle, no key needed."""
    p = packed.select(*(F.col(x).alias(f"_{x}") for x in packed.columns))
    ok = (F.col(at) >= F.col("_t0")) & (F.col(at) < F.col("_t1")) | (F.col(at) == F.col("_t0")) & F.col("_t1").isNull()
    for x in on or []:
        ok = ok & (F.col(x) == F.col(f"_{x}"))
    j = rows.join(F.broadcast(p), ok, "left")
    gap = F.unix_timestamp("_t1") - F.unix_timestamp("_t0")
    j = j.withColumn("_share", F.coalesce((F.unix_timestamp(at) - F.unix_timestamp("_t0")) / gap, F.lit(0.0)))

    def looked_up(corners):
        """All values and the status in one expression, so that the corners are worked out once."""
        share = F.col("_share")

        def flat(column: str) -> Column:
            term = lambda k: F.when(k["w"] == 0, 0.0).otherwise(k["w"] * F.get(F.col(column), k["j"] * spec.ni + k["i"]))
            return F.aggregate(corners, F.lit(0.0), lambda s, k: s + term(k))

        def named(got):
            missing = F.lit(False)
            for v in values:
                missing = missing | got[v].isNull()
            status = F.when(corners.isNull(), "out_of_bounds").when(F.col("_t0").isNull(), "out_of_time").when(missing, "incomplete_forecast").otherwise("ok")
            return F.struct(*(got[v].alias(v) for v in values), status.alias("status"))

        blended = lambda v: let(flat(f"_a0_{v}"), lambda first: F.when(share == 0, first).otherwise((1 - share) * first + share * flat(f"_a1_{v}")))
        return let(F.struct(*(blended(v).alias(v) for v in values)), named)

    j = j.withColumn("_got", let(spec.corners(lat, lon), looked_up))
    return j.select(*rows.columns, *(F.col(f"_got.{v}").alias(v) for v in values), F.col("_got.status").alias("status"))


@dataclass
class Field:
    """A forecast grid (valid_time, j, i, on..., values) to look up; small ones are packed once and sent to every executor."""

    grid: DataFrame
    spec: GridSpec
    values: list[str]
    on: list[str] | None = None

    def __post_init__(self):
        self.packed = packed_slices(self.grid, self.spec, self.values, self.on)

    def at(self, rows: DataFrame, keys: list[str], when: str = "ts", lat: str = "lat", lon: str = "lon") -> DataFrame:
        """rows with values and status; keys tell the rows apart."""
        if self.packed is not None:
            return trilinear_packed(rows, self.packed, self.spec, self.values, when, lat, lon, self.on)
        on = self.on or []
        keyed = rows.withColumn("_id", F.struct(*keys))
        got = trilinear(keyed.select("_id", *on, F.col(lat).alias("lat"), F.col(lon).alias("lon"), F.col(when).alias("ts")), "_id", self.grid, self.spec, self.values, on=on)
        return keyed.join(got, "_id").drop("_id")


def blend_directions(a, b, share) -> Column:
    """Direction between two directions, blended as unit vectors; the first one where they cancel."""
    e = F.sin(F.radians(c(a))) * (1 - c(share)) + F.sin(F.radians(c(b))) * c(share)
    n = F.cos(F.radians(c(a))) * (1 - c(share)) + F.cos(F.radians(c(b))) * c(share)
    return F.pmod(F.when(e * e + n * n < 1e-24, c(a)).otherwise(F.degrees(F.atan2(e, n))), F.lit(360.0))


def mosaic_conflicts(tiles: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Cells on which tiles disagree. tiles: (tile, valid_time, j, i, value, packing_error).

    The first finite value by tile order owns a cell; a later finite one must be within
    both packing errors and the relative tolerance of it.
    """
    keys = ["valid_time", "j", "i"]
    finite = tiles.where(F.col("value").isNotNull() & ~F.isnan("value"))
    w = Window.partitionBy(*keys).orderBy("tile")
    owned = finite.withColumn("owner", F.first("value").over(w)).withColumn("owner_error", F.first("packing_error").over(w)).withColumn("n", F.row_number().over(w))
    bound = F.col("packing_error") + F.col("owner_error") + tolerance * F.greatest(F.abs("value"), F.abs("owner"))
    return owned.where((F.col("n") > 1) & (F.abs(F.col("value") - F.col("owner")) > bound)).select("tile", *keys, "value", "owner")


def mosaic(tiles: DataFrame) -> DataFrame:
    """(valid_time, j, i, value): the first finite value of each cell by tile order."""
    finite = tiles.where(F.col("value").isNotNull() & ~F.isnan("value"))
    return finite.groupBy("valid_time", "j", "i").agg(F.min_by("value", "tile").alias("value"))


def mosaic_gaps(tiles: DataFrame) -> DataFrame:
    """(valid_time, cells, expected): slices whose tiles leave cells of their common rectangle empty."""
    a = tiles.select("valid_time", "j", "i").distinct().groupBy("valid_time")
    a = a.agg(F.count("*").alias("cells"), ((F.max("j") - F.min("j") + 1) * (F.max("i") - F.min("i") + 1)).cast("long").alias("expected"))
    return a.where("cells <> expected")
