"""Geodesic lattice and earliest arrivals over it, as DataFrame rounds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.geodesy import EARTH_RADIUS_NM, angle_between, cross, dot, let, norm

from .shared import Steps

MAX_LEVEL = 8


def _unit(v: Column) -> Column:
    return let(v, lambda w: F.transform(w, lambda x: x / norm(w)))


def midpoint(p: Column | str, q: Column | str) -> Column:
    """The middle of an arc."""
    return _unit(F.zip_with(p, q, lambda x, y: x + y))


def _seeds() -> list[tuple[list[float], list[float], list[float]]]:
    """The faces of an icosahedron, counter-clockwise, two corners at the poles."""
    z, r = 1 / math.sqrt(5), 2 / math.sqrt(5)
    ring = lambda k, up: [r * math.cos(math.radians(36 * k)), r * math.sin(math.radians(36 * k)), z if up else -z]
    north, south = [0.0, 0.0, 1.0], [0.0, 0.0, -1.0]
    rows = []
    for k in range(0, 10, 2):
        u, u2, d, d2 = ring(k, True), ring(k + 2, True), ring(k + 1, False), ring(k + 3, False)
        rows += [(north, u, u2), (u, d, u2), (u2, d, d2), (south, d2, d)]
    return rows


#: Corners of the four faces that one is split into, by their names.
_FOUR = (("a", "ab", "ca"), ("ab", "b", "bc"), ("ca", "bc", "c"), ("ab", "bc", "ca"))


def split_faces(faces: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """(keys..., face, a, b, c): the four faces of each face."""
    df = faces.select(*keys, "face", "a", "b", "c", midpoint("a", "b").alias("ab"), midpoint("b", "c").alias("bc"), midpoint("c", "a").alias("ca"))
    four = F.array(*(F.struct(F.col(p).alias("a"), F.col(q).alias("b"), F.col(s).alias("c")) for p, q, s in _FOUR))
    df = df.select(*keys, "face", F.posexplode(four).alias("k", "f"))
    return df.select(*keys, (F.col("face") * 4 + F.col("k")).alias("face"), "f.a", "f.b", "f.c")


def icosphere(spark: SparkSession, level: int) -> DataFrame:
    """Faces (face, a, b, c unit vectors, counter-clockwise) of an icosahedron split `level` times: 20 * 4**level rows."""
    if not 0 <= level <= MAX_LEVEL:
        raise ValueError(f"level must be 0 to {MAX_LEVEL}")
    df = spark.createDataFrame([(i, *f) for i, f in enumerate(_seeds())], "face long, a array<double>, b array<double>, c array<double>")
    for _ in range(level):
        df = split_faces(df)
    return df


def face_at(v: Column, level: int, slack: float = 1e-12) -> Column:
    """struct(face, a, b, c): the first face of a level that holds a unit vector, found from the icosahedron downwards.

    An expression of one row: no table of faces is joined or sent anywhere.
    """
    vector = lambda x: "array(" + ", ".join(f"{float(n)!r}D" for n in x) + ")"
    seeds = F.expr("array(" + ", ".join(f"named_struct('face', {i}L, 'a', {vector(a)}, 'b', {vector(b)}, 'c', {vector(c)})" for i, (a, b, c) in enumerate(_seeds())) + ")")
    side = lambda p, q: dot(cross(p, q), v)
    inside = lambda f: F.least(side(f["a"], f["b"]), side(f["b"], f["c"]), side(f["c"], f["a"]))

    def held(faces: Column) -> Column:
        # rounding may leave a point on an edge outside of all; then the face that it misses least has it
        first = F.get(F.filter(faces, lambda f: inside(f) >= -slack), F.lit(0))
        return F.coalesce(first, F.element_at(F.array_sort(F.transform(faces, lambda f: F.struct(inside(f).alias("d"), f.alias("f")))), -1)["f"])

    def down(f: Column, _) -> Column:
        def four(m: Column) -> Column:
            at = lambda x: f[x] if len(x) == 1 else m[x]
            return held(F.array(*(F.struct((f["face"] * 4 + k).alias("face"), at(p).alias("a"), at(q).alias("b"), at(s).alias("c")) for k, (p, q, s) in enumerate(_FOUR))))

        return let(F.struct(*(midpoint(f[x[0]], f[x[1]]).alias(x) for x in ("ab", "bc", "ca"))), four)

    return F.aggregate(F.sequence(F.lit(1), F.lit(level)), held(seeds), down) if level else held(seeds)


def nearest_vertex(v: Column, level: int) -> Column:
    """struct(cell, x): the nearest vertex of a level; its triangles are acute, so it is a corner of the face that holds the point."""

    def pick(f: Column) -> Column:
        one = lambda x: F.struct((-F.round(dot(f[x], v), 12)).alias("d"), vertex_id(f[x]).alias("cell"), f[x].alias("x"))
        return F.array_min(F.array(one("a"), one("b"), one("c")))

    return let(let(face_at(v, level), pick), lambda n: F.struct(n["cell"].alias("cell"), n["x"].alias("x")))


def vertex_id(v: Column | str) -> Column:
    """A number for a vertex that depends on its rounded place alone."""
    v = F.col(v) if isinstance(v, str) else v
    return F.xxhash64(F.transform(v, lambda x: F.round(x, 9) + 0.0))


def vertices(faces: DataFrame) -> DataFrame:
    """(cell, x): 10 * 4**level + 2 rows."""
    v = faces.select(F.explode(F.array("a", "b", "c")).alias("x"))
    return v.withColumn("cell", vertex_id("x")).groupBy("cell").agg(F.first("x").alias("x"))


def edges(faces: DataFrame) -> DataFrame:
    """(a, b, nm, va, vb): every edge in both directions."""
    e = faces.select(F.explode(F.array(F.struct(F.col("a").alias("p"), F.col("b").alias("q")), F.struct(F.col("b").alias("p"), F.col("c").alias("q")), F.struct(F.col("c").alias("p"), F.col("a").alias("q")))).alias("e")).select("e.p", "e.q")
    e = e.union(e.select("q", "p")).withColumn("a", vertex_id("p")).withColumn("b", vertex_id("q"))
    return e.groupBy("a", "b").agg(F.first("p").alias("va"), F.first("q").alias("vb")).withColumn("nm", angle_between(F.col("va"), F.col("vb")) * EARTH_RADIUS_NM)


def position_of(v: Column) -> tuple[Column, Column]:
    """(lat, lon) of a unit vector."""
    x, y, z = (F.get(v, F.lit(i)) for i in range(3))
    return F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), z)))), F.degrees(F.atan2(y, x))


def earliest_arrivals(sources: DataFrame, links: DataFrame, speed: Column, max_rounds: int = 200) -> DataFrame:
    """(request_id, cell, elapsed, parent): earliest time each cell can be reached, by label correction.

    sources: (request_id, cell). links: (a, b, nm and what `speed` reads; `elapsed` is the
    time of leaving). speed: knots along a link, null or 0 where it can't be taken. Only
    labels that improved go into the next round; a later start must not arrive earlier.
    """
    save = Steps(sources.sparkSession, "lattice").save
    best = save(sources.select("request_id", "cell", F.lit(0).cast("long").alias("elapsed"), F.lit(None).cast("long").alias("parent")))
    fresh = best
    for _ in range(max_rounds):
        go = fresh.join(links, fresh["cell"] == links["a"]).withColumn("_v", speed).where("_v > 0")
        go = go.select("request_id", F.col("b").alias("cell"), (F.col("elapsed") + F.ceil(F.col("nm") / F.col("_v") * 3600)).alias("elapsed"), F.col("a").alias("parent"))
        new = go.groupBy("request_id", "cell").agg(F.min(F.struct("elapsed", "parent")).alias("n"))
        j = best.join(new, ["request_id", "cell"], "full_outer")
        better = F.col("elapsed").isNull() | (F.col("n.elapsed") < F.col("elapsed"))
        j = j.select("request_id", "cell", F.when(better & F.col("n").isNotNull(), F.col("n.elapsed")).otherwise(F.col("elapsed")).alias("elapsed"), F.when(better & F.col("n").isNotNull(), F.col("n.parent")).otherwise(F.col("parent")).alias("parent"), F.coalesce(better & F.col("n").isNotNull(), F.lit(False)).alias("fresh"))
        j = save(j)
        best, fresh = j.drop("fresh"), j.where("fresh").drop("fresh")
        if fresh.isEmpty():
            return best
    raise RuntimeError(f"arrivals did not settle in {max_rounds} rounds")


def longest_edges(links: DataFrame) -> DataFrame:
    """(cell, longest): the longest edge at each cell; the longest of all is in the row whose cell is null."""
    own = links.groupBy(F.col("a").alias("cell")).agg(F.max("nm").alias("longest"))
    return own.unionByName(links.agg(F.max("nm").alias("longest")).select(F.lit(None).cast("long").alias("cell"), "longest"))


def level_of(levels: list[DataFrame]) -> DataFrame:
    """(cell, level, x): each vertex with the coarsest level that has it; splitting keeps vertices, so finer levels have it too."""
    every = None
    for k, v in enumerate(levels):
        v = v.select("cell", F.lit(k).alias("level"), "x")
        every = v if every is None else every.unionByName(v)
    return every.groupBy("cell").agg(F.min("level").alias("level"), F.min_by("x", "level").alias("x"))
