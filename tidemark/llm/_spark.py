"""Shared-folder tables, checkpoints and connected components."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Held while a table is written: shuffle files go as soon as the action ends, Arrow batches stay small.
_SETTINGS = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}

#: Narrow rows for a file of a table whose size is known, and files that it may have in any case.
FILE_ROWS, MIN_FILES = 200_000, 4


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and all run on this machine."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = sc._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(root)
        root = sc._jsc.sc().getCheckpointDir().get()
    return root


@contextlib.contextmanager
def settings_held(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in _SETTINGS}
    for k, v in _SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def save(self, df: DataFrame, name: str = "t", sort: list[str] | None = None, rows: int | None = None) -> DataFrame:
        """rows: how many there are about, where known; few of them are written to few files."""
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        if rows is not None:
            df = df.coalesce(max(MIN_FILES, rows // FILE_ROWS))
        if sort:
            df = df.sortWithinPartitions(*sort)
        with settings_held(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tidemark_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables of which nothing reads any more."""
        self.delete(self.spark, [t._tidemark_path for t in tables])

    @staticmethod
    def delete(spark: SparkSession, paths: list[str]) -> None:
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for p in paths:
            path = spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)


def list_folder(spark: SparkSession, folder: str) -> list[str]:
    """Names of what a folder holds; none if there is no such folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []


#: A key with more than one part in so many of the rows is hot; there can be no more hot keys than this.
HOT_PARTS = 1000


def join_hot(rows: DataFrame, facts: DataFrame, on: str, weight: str, how: str = "inner") -> DataFrame:
    """rows joined with facts (one for each key, saved, with `weight`: how many of the rows have it).

    Keys that hold over a thousandth of the rows, a thousand at most by that, are named
    in the plan and their facts broadcast to where their rows are; the others hold too
    few rows to fill a task.
    """
    total = facts.agg(F.sum(weight)).first()[0] or 0
    hot = facts.where(F.col(weight) * HOT_PARTS > total)
    keys = [r[0] for r in hot.select(on).where(F.col(on).isNotNull()).collect()]  # fewer than HOT_PARTS
    if not keys:
        return rows.join(facts, on, how).drop(weight)
    is_hot = F.coalesce(F.col(on).isin(keys), F.lit(False))
    rest = rows.where(~is_hot).join(facts.where(~is_hot), on, how)
    return rows.where(is_hot).join(F.broadcast(hot), on, how).unionByName(rest).drop(weight)


def connected_components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): for every node of an edge its smallest reachable node.

    Alternates large-star and small-star rounds, so the number of rounds grows with
    the logarithm of the longest chain, no group is gathered in one task, and only a
    count and a checksum of the edges come to the driver.
    """
    cur = edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where("lo <> hi").distinct()
    cur = scratch.save(cur, "edges")
    mark, size = None, cur.count()
    for _ in range(max_rounds):
        both = cur.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(cur.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        # large star: every larger neighbour points at the least of the neighbourhood
        large = join_hot(both.where("v > u"), scratch.save(least, "least", rows=2 * size), "u", "n").select(F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo <> hi").distinct()
        # small star: the smaller neighbours and the node itself point at the least
        low = large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
        links = large.select(F.col("hi").alias("u"), F.col("lo").alias("v")).join(low, "u")
        small = links.select(F.col("m").alias("lo"), F.col("v").alias("hi")).union(low.select(F.col("m").alias("lo"), F.col("u").alias("hi")))
        nxt = scratch.save(small.where("lo <> hi").distinct(), "edges", rows=size)
        new = nxt.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        scratch.drop(cur)
        cur = nxt
        if tuple(new) == mark:
            break
        mark, size = tuple(new), new[0]
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return cur.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(cur.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
