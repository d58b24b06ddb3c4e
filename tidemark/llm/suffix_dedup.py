"""Suffix-array dedup with a logarithmic index family.

The index is a family of levels. A level is a sparse suffix array: sampled suffixes,
each distinct context once, with a count, sorted by the suffix's first eight bytes and
then by a name of its first K bytes. A new batch gets such an array, is merge-scanned
against the existing levels for suffixes that start alike (a sort-merge join in that
order), and becomes a level; levels of equal size merge, so every suffix is rewritten a
logarithmic number of times. Suffixes are sampled by minimizers: any two equal strings
of LENGTH bytes hold sampled suffixes at equal offsets, so no match is lost. Matches
are then settled on the bytes around them.

An index can be kept in a folder: a later batch is then scanned against what the
earlier ones left there, and only the earlier texts that it matches are read again.

Every byte covered by a LENGTH-byte string that starts anywhere else too is removed,
judged on the input. Defined cases: null text is empty; texts shorter than LENGTH lose
nothing; a text of any length is handled whole, within one task; repeated rows are
copies of each other; null or shared doc_ids are told apart by text; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _repeats as R
from . import _text as T
from ._spark import Scratch, join_hot, list_folder, settings_held

LENGTH, K = 200, 48
BATCHES = 4
#: Bytes of text that a task looks at together: each is a symbol.
CHUNK = 1 << 18
#: String starts that are looked at together; names are packed with positions counted from the first of them.
PIECE = 1 << 25
_LOW = np.uint64((1 << 26) - 1)


def choose_suffixes(s: R.Symbols, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each string of `length` bytes the least-named suffix start within it, by the suffix's first K bytes."""
    n = len(s.names)
    starts = np.flatnonzero(T.lengths_left(s.first) >= length)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    at = np.arange(n - K + 1)
    names = T.range_names(T.prefix_sums(s.names), at, at + K)
    width, chosen = length - K + 1, np.zeros(len(starts), np.int64)
    for base in range(0, len(names) - width + 1, PIECE):
        part = names[base : base + PIECE + width - 1]
        packed = (part & ~_LOW) | np.arange(len(part), dtype=np.uint64)
        a, z = np.searchsorted(starts, (base, base + PIECE))
        chosen[a:z] = base + (R.sliding_min(packed, width)[starts[a:z] - base] & _LOW).astype(np.int64)
    return starts, chosen, names[chosen], chosen


def suffix_order(s: R.Symbols, at: np.ndarray) -> np.ndarray:
    """The first eight bytes of each suffix as a number whose order is the bytes' order."""
    out = np.zeros(len(at), np.uint64)
    for j in range(8):
        out = (out << np.uint64(8)) | s.data[at + j]
    return (out ^ np.uint64(1 << 63)).view(np.int64)


BYTES = R.Method(LENGTH, R.read_bytes, choose_suffixes, b"", suffix_order, CHUNK)


class SuffixIndex:
    """Levels of sorted suffix samples: (prefix, key, ctx, n, e), one row for each distinct context.

    root: a folder that driver and executors share. What it holds of an earlier index is
    continued: each add writes the tables first and then a new list of them, which counts.
    """

    SCHEMA = "prefix long, key long, ctx binary, n long, e struct<uid: long, lo: int, hi: int>"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        lists = sorted(x for x in list_folder(spark, self.root) if x.startswith("levels-"))
        rows = spark.read.parquet(f"{self.root}/{lists[-1]}").collect() if lists else []
        self.levels: list[tuple[int, str]] = sorted(((r["size"], r["name"]) for r in rows), reverse=True)
        self.version = int(lists[-1].split("-")[1]) + 1 if lists else 0

    def _write(self, df: DataFrame) -> str:
        name = f"level-{uuid.uuid4().hex}"
        with settings_held(self.spark):
            df.sortWithinPartitions("prefix", "key").write.option("compression", "zstd").parquet(f"{self.root}/{name}")
        return name

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(f"{self.root}/{name}")

    def add(self, entries: DataFrame) -> DataFrame:
        """(key, m) of the keys of a batch that occur twice in it or in an earlier one; m: contexts seen for it, at least those there are."""
        by = ["prefix", "key"]
        name = self._write(R.distinct_contexts(entries))
        new = self._read(name)
        mine = new.groupBy(*by).agg(F.count("*").alias("c"), F.sum("n").alias("t"))  # each key once, so no common one gathers in a task
        found = mine.where("t > 1").select("key", F.col("c").alias("m"))
        for _, level in self.levels:
            theirs = self._read(level).groupBy(*by).agg(F.count("*").alias("d"))
            found = found.union(mine.hint("merge").join(theirs, by).select("key", (F.col("c") + F.col("d")).alias("m")))
        found = Scratch(self.spark, "found").save(found.groupBy("key").agg(F.sum("m").alias("m")), "found")
        size, rows, gone = 1, new, []
        while self.levels and self.levels[-1][0] == size:  # all that meet are merged at once
            _, old = self.levels.pop()
            rows, size = rows.union(self._read(old)), 2 * size
            gone.append(old)
        if gone:
            gone.append(name)
            name = self._write(rows.groupBy(*by, "ctx").agg(F.sum("n").alias("n"), F.min("e").alias("e")))
        self.levels.append((size, name))
        self.spark.createDataFrame(self.levels, "size long, name string").coalesce(1).write.parquet(f"{self.root}/levels-{self.version:06d}")
        self.version += 1
        Scratch.delete(self.spark, [f"{self.root}/{x}" for x in gone])
        return found

    def delete(self) -> None:
        """Delete the index; for one that no later batch continues."""
        Scratch.delete(self.spark, [self.root])
        self.levels = []

    def contexts(self, keys: DataFrame) -> DataFrame:
        """The contexts of `keys` (key, m) in all levels, those that several levels hold once."""
        rows = self._read(self.levels[0][1])
        for _, level in self.levels[1:]:
            rows = rows.union(self._read(level))
        rows = join_hot(rows, keys, "key", "m")
        return rows.groupBy("prefix", "key", "ctx").agg(F.sum("n").alias("n"), F.min("e").alias("e"))


def remove_repeated_strings(docs: DataFrame, batches: int = BATCHES, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of `docs` (doc_id, text).

    The texts go through an index of their own in so many batches.
    """
    scratch = scratch or Scratch(docs.sparkSession, "suffix")
    index = SuffixIndex(docs.sparkSession, f"{scratch.root}/index")
    classes = R.text_classes(docs, scratch)
    sampled = R.sample_entries(docs, classes, BYTES).withColumn("batch", F.pmod(F.xxhash64("uid"), F.lit(batches)).cast("int"))
    sampled = scratch.save(sampled, "sampled", sort=["batch"])
    found = None
    for i in range(batches):
        new = index.add(sampled.where(F.col("batch") == i).drop("batch"))
        found = new if found is None else found.union(new)
    return _judged(docs, docs, classes, sampled, index, found, scratch, kept=False)


def add_to_index(docs: DataFrame, earlier: DataFrame | None, root: str, scratch: Scratch | None = None) -> DataFrame:
    """Adds the batch `docs` to the index in `root` and gives its rows' result, judged on all batches so far.

    earlier: the texts of the batches before (doc_id, text), None for the first. Ids must differ between batches.
    """
    scratch = scratch or Scratch(docs.sparkSession, "suffix")
    both = docs.select("doc_id", "text") if earlier is None else earlier.select("doc_id", "text").unionByName(docs.select("doc_id", "text"))
    classes = R.text_classes(both, scratch)
    # texts that an earlier batch holds too are in the index already
    own = R.with_digest(docs).select(F.col("digest").alias("own"), F.col("doc_id").alias("own_id")).distinct()
    fresh = classes.join(own, (classes["digest"] == own["own"]) & classes["rep"].eqNullSafe(own["own_id"]), "left_semi")
    entries = scratch.save(R.sample_entries(docs, fresh, BYTES), "sampled")
    index = SuffixIndex(docs.sparkSession, root)
    return _judged(docs, both, classes, entries, index, index.add(entries), scratch)


def _judged(docs: DataFrame, texts: DataFrame, classes: DataFrame, entries: DataFrame, index: SuffixIndex, found: DataFrame, scratch: Scratch, kept: bool = True) -> DataFrame:
    """kept: whether the index outlives the call. Other tables go once nothing reads them."""
    keys = scratch.save(found.groupBy("key").agg(F.sum("m").alias("m")), "found")
    contexts = scratch.save(index.contexts(keys), "contexts")
    if not kept:
        index.delete()
    marks = R.edge_marks(texts, classes, entries, contexts, BYTES, scratch, spent=True)
    return R.remove_marked(docs, classes, marks, BYTES, scratch).withColumnRenamed("n_symbols", "n_bytes")
