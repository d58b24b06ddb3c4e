"""Boat speed tables as columns: bilinear and monotone-cubic lookup, best upwind and downwind angles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .geodesy import c, let

#: The built-in table. Rows by true wind angle, columns by true wind speed.
TWS = [0.0, 6.0, 10.0, 14.0, 20.0, 30.0, 40.0]
TABLE = {
    0.0: [0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0],
    30.0: [0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0],
    45.0: [0.0, 4.1, 5.6, 6.5, 7.1, 7.3, 7.3],
    60.0: [0.0, 4.7, 6.2, 7.1, 7.8, 8.1, 8.1],
    75.0: [0.0, 5.1, 6.7, 7.6, 8.5, 9.0, 9.0],
    90.0: [0.0, 5.3, 6.9, 7.9, 8.9, 9.7, 9.7],
    110.0: [0.0, 5.2, 6.9, 8.0, 9.2, 10.2, 10.4],
    120.0: [0.0, 5.1, 6.8, 7.9, 9.3, 10.5, 10.8],
    135.0: [0.0, 4.8, 6.5, 7.7, 9.2, 10.6, 11.0],
    150.0: [0.0, 4.5, 6.2, 7.4, 9.0, 10.5, 11.0],
    165.0: [0.0, 4.1, 5.8, 7.0, 8.7, 10.2, 10.8],
    180.0: [0.0, 3.8, 5.4, 6.6, 8.3, 9.8, 10.4],
}


def _literal(values: list[float]) -> Column:
    return F.expr("array(" + ", ".join(f"{float(v)!r}D" for v in values) + ")")


def _bracket(x: Column, axis: list[float]) -> Column:
    """Index of the interval of the axis that holds x, clamped to the ends."""
    out = F.lit(len(axis) - 2)
    for i in range(len(axis) - 2, 0, -1):
        out = F.when(x < axis[i], i - 1).otherwise(out)
    return out


def hermite(s: Column, h: Column, y0: Column, y1: Column, d0: Column, d1: Column) -> Column:
    """Cubic through two values with two slopes, at share s of an interval of length h."""
    s2, s3 = s * s, s * s * s
    return y0 * (2 * s3 - 3 * s2 + 1) + h * d0 * (s3 - 2 * s2 + s) + y1 * (3 * s2 - 2 * s3) + h * d1 * (s3 - s2)


@dataclass(frozen=True)
class Polar:
    """speeds[i][j]: boat speed at twa[i] and tws[j], both ascending."""

    twa: list[float]
    tws: list[float]
    speeds: list[list[float]]

    @classmethod
    def builtin(cls) -> Polar:
        return cls(list(TABLE), TWS, list(TABLE.values()))

    def table(self, spark: SparkSession) -> DataFrame:
        """(twa, tws, speed), one row a cell."""
        return spark.createDataFrame([(a, w, self.speeds[i][j]) for i, a in enumerate(self.twa) for j, w in enumerate(self.tws)], "twa double, tws double, speed double")

    def maximum_speed(self) -> float:
        return max(map(max, self.speeds))

    def above_range(self, tws) -> Column:
        return c(tws) > self.tws[-1]

    def _at(self, tws: Column) -> Column:
        """struct(j, t): left column of the table and share to the next one, both clamped."""
        j = _bracket(tws, self.tws)
        x = _literal(self.tws)
        t = (tws - F.get(x, j)) / (F.get(x, j + 1) - F.get(x, j))
        return F.struct(j.alias("j"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)).alias("t"))

    def _cell(self, i: Column, w: Column) -> Column:
        """Speed in row i, blended between two columns."""
        flat = _literal([v for row in self.speeds for v in row])
        at = i * len(self.tws) + w["j"]
        return F.get(flat, at) + w["t"] * (F.get(flat, at + 1) - F.get(flat, at))

    def speed(self, twa, tws, monotone: bool = False) -> Column:
        """Knots at a wind angle (folded to 0..180) and a wind speed; 0 in a calm, clamped to the table's ends."""
        a = F.pmod(F.abs(c(twa)), F.lit(360.0))
        a = F.greatest(F.lit(self.twa[0]), F.least(F.lit(self.twa[-1]), F.least(a, 360.0 - a)))
        place = F.struct(a.alias("a"), _bracket(a, self.twa).alias("i"), self._at(c(tws)).alias("w"))
        got = let(place, self._cubic if monotone else self._linear)
        return F.when((c(tws) > 0) & ~F.isnan(c(tws)), F.greatest(F.lit(0.0), got)).otherwise(0.0)

    def at_wind(self, tws) -> Column:
        """array: the speed at each angle of the table for a wind speed; 0 in a calm. With `along` it is `speed`, for many angles in one wind."""
        rows = let(self._at(c(tws)), lambda w: F.array(*(self._cell(F.lit(i), w) for i in range(len(self.twa)))))
        return F.when((c(tws) > 0) & ~F.isnan(c(tws)), rows).otherwise(_literal([0.0] * len(self.twa)))

    def along(self, twa, row: Column | str) -> Column:
        """Knots at a wind angle from what at_wind gave."""
        a, row = F.pmod(F.abs(c(twa)), F.lit(360.0)), c(row)
        a = F.greatest(F.lit(self.twa[0]), F.least(F.lit(self.twa[-1]), F.least(a, 360.0 - a)))
        i, x = _bracket(a, self.twa), _literal(self.twa)
        s = (a - F.get(x, i)) / (F.get(x, i + 1) - F.get(x, i))
        return F.greatest(F.lit(0.0), F.get(row, i) + s * (F.get(row, i + 1) - F.get(row, i)))

    def _linear(self, p: Column) -> Column:
        x = _literal(self.twa)
        s = (p["a"] - F.get(x, p["i"])) / (F.get(x, p["i"] + 1) - F.get(x, p["i"]))
        return let(self._cell(p["i"], p["w"]), lambda y: y + s * (self._cell(p["i"] + 1, p["w"]) - y))

    def _cubic(self, p: Column) -> Column:
        x, i = _literal(self.twa), p["i"]
        h = F.get(x, i + 1) - F.get(x, i)
        # the slopes at both ends of an interval depend on the rows beside it alone
        n = min(4, len(self.twa))
        first = F.greatest(F.lit(0), F.least(i - 1, F.lit(len(self.twa) - n)))

        def curve(y):
            at = lambda k: F.get(y, k - first)
            knots = F.struct(((p["a"] - F.get(x, i)) / h).alias("s"), self._slope(i, at).alias("d0"), self._slope(i + 1, at).alias("d1"))
            return let(knots, lambda k: hermite(k["s"], h, at(i), at(i + 1), k["d0"], k["d1"]))

        return let(F.array(*(self._cell(first + k, p["w"]) for k in range(n))), curve)

    def _slope(self, i: Column, at) -> Column:
        """Slope at row i of speeds at(row) that keeps a cubic monotone where the table is (Fritsch and Carlson)."""
        n, x = len(self.twa), _literal(self.twa)
        gap = lambda k: F.get(x, k + 1) - F.get(x, k)
        rise = lambda k: (at(k + 1) - at(k)) / gap(k)

        def inner(l, r, hl, hr):
            return F.when(l * r <= 0, 0.0).otherwise(3 * (hl + hr) / ((2 * hr + hl) / l + (hr + 2 * hl) / r))

        def end(near, far, hn, hf):
            slope = ((2 * hn + hf) * near - hn * far) / (hn + hf)
            return F.when(slope * near <= 0, 0.0).when((near * far <= 0) & (F.abs(slope) > F.abs(3 * near)), 3 * near).otherwise(slope)

        k = F.greatest(F.least(i, F.lit(n - 2)), F.lit(1))
        first, last = F.lit(0), F.lit(n - 2)
        return F.when(i == 0, end(rise(first), rise(first + 1), gap(first), gap(first + 1))).when(i == n - 1, end(rise(last), rise(last - 1), gap(last), gap(last - 1))).otherwise(inner(rise(k - 1), rise(k), gap(k - 1), gap(k)))

    def best_angles(self, spark: SparkSession, refine: int = 40) -> DataFrame:
        """(tws, up_angle, up_vmg, down_angle, down_vmg) of each table column: a sweep by degree, then golden section around its best."""
        rows = spark.createDataFrame([(w,) for w in self.tws if w > 0], "tws double").withColumn("twa", F.explode(F.sequence(F.lit(0), F.lit(180)))).withColumn("twa", F.col("twa").cast("double"))
        vmg = lambda a: self.speed(a, "tws") * F.cos(F.radians(a))
        seen = rows.withColumn("vmg", vmg(F.col("twa")))
        best = seen.groupBy("tws").agg(F.max_by("twa", F.struct("vmg", -F.col("twa"))).alias("u"), F.max_by("twa", F.struct(-F.col("vmg"), -F.col("twa"))).alias("d"))
        g = (5**0.5 - 1) / 2

        def golden(centre: Column, sign: int) -> Column:
            def narrow(s, _):
                a, b = s["a"], s["b"]
                p, q = b - g * (b - a), a + g * (b - a)
                better = sign * vmg(p) >= sign * vmg(q)
                return F.struct(F.when(better, a).otherwise(p).alias("a"), F.when(better, q).otherwise(b).alias("b"))

            ends = F.struct(F.greatest(centre - 1, F.lit(0.0)).alias("a"), F.least(centre + 1, F.lit(180.0)).alias("b"))
            return F.aggregate(F.sequence(F.lit(1), F.lit(refine)), ends, narrow, lambda s: (s["a"] + s["b"]) / 2)

        out = best.select("tws", golden(F.col("u"), 1).alias("up_angle"), golden(F.col("d"), -1).alias("down_angle"))
        return out.select("tws", "up_angle", vmg(F.col("up_angle")).alias("up_vmg"), "down_angle", vmg(F.col("down_angle")).alias("down_vmg"))

    def best_angles_at(self, spark: SparkSession, tws, monotone: bool = False) -> Column:
        """struct(up, down): the angles of best progress for a wind speed, blended between the table's columns.

        A column without progress counts with 0 and 180 degrees.
        """
        found = {r["tws"]: r for r in self.best_angles(spark).collect()}  # one row for each column of the table
        angles = [(found[w]["up_angle"], found[w]["down_angle"]) if w in found else (0.0, 180.0) for w in self.tws]

        def blend(k: int, w: Column) -> Column:
            x = _literal([a[k] for a in angles])
            return F.get(x, w["j"]) + w["t"] * (F.get(x, w["j"] + 1) - F.get(x, w["j"]))

        return let(self._at(c(tws)), lambda w: F.struct(blend(0, w).alias("up"), blend(1, w).alias("down")))
