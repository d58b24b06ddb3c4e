"""Exact removal of long repeats by sampled positions.

Texts are sequences of symbols (bytes or words). A chooser picks, for every window of
W symbols, one anchor inside it by the window's content alone, so equal windows have
equal anchors at equal offsets. Anchors are far fewer than windows. An entry is an
anchor with the run of window starts [lo, hi] that chose it; its context are the
symbols those windows cover, its key a name of what made it the anchor.

Names (64 bits) only choose what is compared. Entries whose contexts have equal 128-bit
digests are repeated as a whole. Of the others, each distinct context of a key that
has several takes part once: its bytes are sent to where the key's others are, windows
of equal name are compared there byte by byte, and each window that another context
holds is marked. Where a key has more than HOT contexts their windows travel by 128-bit
digest instead of the contexts' bytes, so no key fills a task; both ways mark the same
windows.

Equal texts (by SHA-256) form one class, of which one text is looked at, so groups of
copies of any size cost nothing further.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._spark import Scratch, join_hot

#: Contexts of one key that are still compared within one task; beyond, each window travels by its own name.
HOT = 4000

_UNNAMED = np.zeros(0, np.uint64)

ENTRY = "prefix long, key long, ctx binary, uid long, lo int, hi int"


@dataclass
class Symbols:
    """Symbols of a chunk of texts: names (none if not asked for), where each text's begin, and their bytes, of which ranges are equal where the symbols are."""

    names: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray


@dataclass
class Method:
    """window: symbols of a window. read: texts to Symbols. choose: Symbols to (window starts, anchor number, key, anchor symbol).

    prefix: Symbols and anchors to the order of the entries, None for none. chunk: bytes of
    text that a task looks at together (one text or one key at least); a symbol takes some
    hundred bytes of memory meanwhile.
    """

    window: int
    read: Callable[..., Symbols]
    choose: Callable[[Symbols, int], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    join: bytes
    prefix: Callable[[Symbols, np.ndarray], np.ndarray] | None = None
    chunk: int = T.CHUNK_BYTES


def read_bytes(column: pa.Array, named: bool = True) -> Symbols:
    data, off = T.utf8(column)
    at = np.arange(len(data))
    return Symbols(T.byte_symbols(data) if named else _UNNAMED, off, at, at + 1, data)


def read_words(column: pa.Array, named: bool = True) -> Symbols:
    data, off = T.utf8(column)
    w = T.Words(data, off, T.NOT_SPACE)
    spaced, start, end = w.spaced()
    return Symbols(w.names() if named else _UNNAMED, w.first, start, end, spaced)


def bytes_of(s: Symbols, begin: np.ndarray, end: np.ndarray) -> list[memoryview]:
    """The bytes of ranges of symbols (begin, behind the last)."""
    whole = memoryview(np.ascontiguousarray(s.data))
    return [whole[a:z] for a, z in zip(s.start[begin].tolist(), s.end[end - 1].tolist(), strict=True)]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    n = len(x) - w + 1
    pad = -len(x) % w
    y = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(y, axis=1).ravel()
    behind = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def _entries(method: Method):
    w = method.window

    def run(batches):
        for batch in T.chunks(batches, size=method.chunk):
            s = method.read(batch.column("text"))
            starts, chosen, key, at = method.choose(s, w)
            if len(starts):
                new = np.flatnonzero((np.diff(chosen) != 0) | (np.diff(starts) != 1)) + 1
                a, z = np.concatenate([[0], new]), np.concatenate([new, [len(starts)]]) - 1
                lo, hi, key, at = starts[a], starts[z], key[a], at[a]
                prefix = np.zeros(len(at), np.int64) if method.prefix is None else method.prefix(s, at)
                ctx = [T.digest(x) for x in bytes_of(s, lo, hi + w)]
                doc = np.searchsorted(s.first, lo, "right") - 1
                base = s.first[doc]
                cols = [prefix, key.view(np.int64), ctx, np.asarray(batch.column("uid"))[doc], (lo - base).astype(np.int32), (hi - base).astype(np.int32)]
            else:
                cols = [np.zeros(0, np.int64)] * 2 + [[]] + [np.zeros(0, np.int64)] + [np.zeros(0, np.int32)] * 2
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["prefix", "key", "ctx", "uid", "lo", "hi"])

    return run


def _contexts(method: Method):
    """Bytes under each edge entry; windows of hot keys one by one, keyed by their digests (key and more)."""
    w = method.window

    def run(batches):
        for batch in T.chunks(batches, size=method.chunk):
            s = method.read(batch.column("text"), named=False)
            out = {k: [] for k in ("key", "more", "uid", "single", "start", "body")}
            for i, (uid, rows) in enumerate(zip(batch.column("uid").to_pylist(), batch.column("edges").to_pylist(), strict=True)):
                base = int(s.first[i])
                for e in rows:
                    lo, hi = base + e["lo"], base + e["hi"]
                    if e["hot"]:
                        at = np.arange(lo, hi + 1)
                        names = T.digests(bytes_of(s, at, at + w)).view(np.int64)
                        out["key"] += names[:, 0].tolist()
                        out["more"] += names[:, 1].tolist()
                        out["uid"] += [uid] * len(at)
                        out["single"] += [e["single"]] * len(at)
                        out["start"] += (at - base).tolist()
                        out["body"] += [None] * len(at)
                    else:
                        out["key"].append(e["key"])
                        out["more"].append(0)
                        out["uid"].append(uid)
                        out["single"].append(e["single"])
                        out["start"].append(e["lo"])
                        out["body"].append(s.data[s.start[lo] : s.end[hi + w - 1]].tobytes())
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out.values(), kinds, strict=True)], names=list(out))

    return run


def found_twice(s: Symbols, key: np.ndarray, at: np.ndarray, w: int) -> np.ndarray:
    """Which of the windows at `at` hold the same bytes as another one of the same key."""
    name = T.mix(T.range_names(T.prefix_sums(s.names), at, at + w) ^ T.mix(key.astype(np.int64).view(np.uint64)))
    _, first, where = np.unique(name, return_index=True, return_inverse=True)
    times = np.bincount(where, minlength=len(first))
    twice = times[where] > 1
    # each window against the first one of its name, run by run
    i = np.flatnonzero(twice & (first[where] != np.arange(len(at))))
    p, q = at[i], at[first[where[i]]]
    new = np.flatnonzero((np.diff(p) != 1) | (np.diff(q) != 1)) + 1
    a, z = np.concatenate([[0], new]).astype(np.int64), np.concatenate([new, [len(i)]]).astype(np.int64) - 1
    bad = set()
    if len(i):
        same_key = key[i] == key[first[where[i]]]
        for x, y, b, e in zip(bytes_of(s, p[a], p[z] + w), bytes_of(s, q[a], q[z] + w), a.tolist(), z.tolist(), strict=True):
            if x != y or not same_key[b : e + 1].all():
                bad.update(where[i[b : e + 1]].tolist())
    if bad:  # different windows of one name: by their bytes
        i = np.flatnonzero(np.isin(where, list(bad)))
        own = [(int(k), bytes(x)) for k, x in zip(key[i], bytes_of(s, at[i], at[i] + w), strict=True)]
        count = Counter(own)
        twice[i] = [count[x] > 1 for x in own]
    return twice


def _runs(uid: np.ndarray, start: np.ndarray, w: int) -> list[np.ndarray]:
    """(uid, first symbol, symbol behind the last) of runs of consecutive windows."""
    if not len(uid):
        return [uid, start, start]
    new = np.flatnonzero((np.diff(uid) != 0) | (np.diff(start) != 1)) + 1
    a, z = np.concatenate([[0], new]), np.concatenate([new, [len(uid)]]) - 1
    return [uid[a], start[a], start[z] + w]


def _compare(method: Method):
    """Rows sorted by key: windows of single entries that occur in another entry of the key."""
    w = method.window

    def windows(batch: pa.RecordBatch) -> list[np.ndarray]:
        key, uid, start = (np.asarray(batch.column(c)) for c in ("key", "uid", "start"))
        single = np.asarray(batch.column("single").to_numpy(zero_copy_only=False))
        s = method.read(batch.column("body"))
        at = np.flatnonzero(T.lengths_left(s.first) >= w)
        row = T.owner(s.first)[at]
        twice = found_twice(s, key[row], at, w) & single[row]
        at, row = at[twice], row[twice]
        # rows of one text may follow each other: keep their runs apart
        runs = _runs(row, at - s.first[row] + start[row], w)
        return [uid[runs[0]], runs[1], runs[2]]

    def run(batches):
        held: list[pa.RecordBatch] = []
        size, last_named = 0, None
        for batch in batches:
            body = batch.column("body")
            named = batch.filter(body.is_null())
            if named.num_rows:  # windows by name: those with an equal neighbour
                key, more, uid, start = (np.asarray(named.column(c)) for c in ("key", "more", "uid", "start"))
                single = np.asarray(named.column("single").to_numpy(zero_copy_only=False))
                if last_named is not None:
                    key, more, uid, start, single = (np.concatenate([x, y]) for x, y in zip(last_named, (key, more, uid, start, single), strict=True))
                same = (key[1:] == key[:-1]) & (more[1:] == more[:-1])
                twice = np.concatenate([[False], same]) | np.concatenate([same, [False]])
                pick = twice & single
                yield _marks([uid[pick], start[pick], start[pick] + w])
                last_named = tuple(x[-1:] for x in (key, more, uid, start, single))
            bodies = batch.filter(body.is_valid())
            if bodies.num_rows:
                held.append(bodies)
                size += bodies.nbytes
                if size > method.chunk:
                    whole = pa.concat_batches(held)
                    key = np.asarray(whole.column("key"))
                    cut = int(np.searchsorted(key, key[-1]))
                    if cut:
                        yield _marks(windows(whole.slice(0, cut)))
                        held = [whole.slice(cut)]
                        size = held[0].nbytes
        if held:
            yield _marks(windows(pa.concat_batches(held)))

    return run


def _marks(cols: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols[0].astype(np.int64)), pa.array(cols[1].astype(np.int32)), pa.array(cols[2].astype(np.int32))], names=["uid", "begin", "end"])


def _kept_runs(gone: np.ndarray, base: int) -> list[tuple[int, int]]:
    """(first, last) symbol of each run that stays."""
    edge = np.diff(np.concatenate([[0], (~gone).astype(np.int8), [0]]))
    return list(zip((np.flatnonzero(edge == 1) + base).tolist(), (np.flatnonzero(edge == -1) + base - 1).tolist(), strict=True))


def _finish(method: Method):
    def run(batches):
        for batch in T.chunks(batches, size=method.chunk):
            s = method.read(batch.column("text"), named=False)
            rows = []
            for i, (copies, marks) in enumerate(zip(batch.column("copies").to_pylist(), batch.column("marks").to_pylist(), strict=True)):
                a, z = int(s.first[i]), int(s.first[i + 1])
                gone = np.zeros(z - a + 1, np.int32)
                if copies > 1 and z - a >= method.window:
                    gone[0] += 1
                    gone[-1] -= 1
                elif marks:
                    m = np.array([(x["begin"], x["end"]) for x in marks])
                    np.add.at(gone, m[:, 0], 1)
                    np.add.at(gone, m[:, 1], -1)
                gone = np.cumsum(gone[:-1]) > 0
                spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                if not gone.any() and method.join == b"":
                    kept = s.data[s.start[a] : s.end[z - 1]].tobytes() if z > a else b""
                elif method.join == b"":
                    kept = s.data[a:z][~gone].tobytes()
                else:
                    kept = method.join.join(s.data[s.start[b] : s.end[e]].tobytes() for b, e in _kept_runs(gone, a))
                rows.append((z - a, int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], names=["doc_id", "n_symbols", "n_removed", "n_spans", "kept_sha256"])

    return run


def with_digest(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))


def text_classes(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(digest, rep, copies, uid): the classes of equal texts. uid: rep, or a number of its own where ids are null or shared."""
    rows = with_digest(docs).select("doc_id", "digest")
    classes = rows.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    shared = classes.groupBy("rep").agg(F.count("*").alias("n")).where("n > 1 and rep is not null").select(F.col("rep").alias("s"))
    own = F.xxhash64("digest")
    return scratch.save(classes.join(shared, classes["rep"] == F.col("s"), "left").select("digest", "rep", "copies", F.when(F.col("rep").isNull() | F.col("s").isNotNull(), own).otherwise(F.col("rep")).alias("uid")), "classes")


def texts_of(docs: DataFrame, classes: DataFrame, *columns: str) -> DataFrame:
    """One text of each class of `classes`, with the class's uid and columns."""
    d = with_digest(docs)
    # by the id too, so copies of one text are dealt to many tasks
    on = (d["digest"] == classes["digest"]) & d["doc_id"].eqNullSafe(classes["rep"])
    return d.join(classes, on).select(classes["uid"], d["text"], *(classes[c] for c in columns))


def sample_entries(docs: DataFrame, classes: DataFrame, method: Method) -> DataFrame:
    return texts_of(docs, classes).mapInArrow(_entries(method), ENTRY)


def distinct_contexts(entries: DataFrame) -> DataFrame:
    """(prefix, key, ctx, n, e): each context once, with the number of entries that have it and the first of them."""
    return entries.groupBy("prefix", "key", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("uid", "lo", "hi")).alias("e"))


def edge_marks(docs: DataFrame, classes: DataFrame, entries: DataFrame, contexts: DataFrame, method: Method, scratch: Scratch, spent: bool = False) -> DataFrame:
    """(uid, begin, end): the symbols of each text that repeated windows cover.

    contexts: those whose key may be repeated, of the entries and of any earlier ones.
    spent: entries and contexts, both saved, are dropped here once nothing reads them.
    """
    repeated = scratch.save(contexts.where("n > 1").select("ctx", "n"), "repeated")
    whole = join_hot(entries, repeated, "ctx", "n").select("uid", F.col("lo").alias("begin"), (F.col("hi") + method.window).alias("end"))
    if spent:
        whole = scratch.save(whole, "whole")
        scratch.drop(entries, repeated)
    many = scratch.save(contexts.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "keys")
    edges = join_hot(contexts, many.select("key", "m", (F.col("m") > HOT).alias("hot")), "key", "m")
    edges = edges.select("e.uid", F.struct("key", (F.col("n") == 1).alias("single"), "e.lo", "e.hi", "hot").alias("edge"))
    edges = edges.groupBy("uid").agg(F.collect_list("edge").alias("edges"))
    edges = scratch.save(classes.join(edges, "uid"), "edges")
    if spent:
        scratch.drop(contexts, many)
    bodies = texts_of(docs, edges, "edges").mapInArrow(_contexts(method), "key long, more long, uid long, single boolean, start int, body binary")
    bodies = bodies.repartition("key").sortWithinPartitions("key", "more", "uid", "start")
    marks = bodies.mapInArrow(_compare(method), "uid long, begin int, end int")
    return scratch.save(whole.unionByName(marks), "marks")


def remove_marked(docs: DataFrame, classes: DataFrame, marks: DataFrame, method: Method, scratch: Scratch) -> DataFrame:
    """doc_id, n_symbols, n_removed, n_spans, kept_sha256 of every row of `docs`."""
    lists = marks.groupBy("uid").agg(F.collect_list(F.struct("begin", "end")).alias("marks"))
    # a text with copies goes as a whole, so its marks need not travel with each of them
    marked = F.when(F.col("copies") == 1, F.col("marks")).alias("marks")
    facts = scratch.save(classes.join(lists, "uid", "left").select("digest", "copies", F.col("copies").alias("times"), marked), "facts")
    rows = join_hot(with_digest(docs), facts, "digest", "times").select("doc_id", "text", "copies", "marks")
    # saved here, as the caller's own write would hand whole texts to Python ten thousand at a time
    return scratch.save(rows.mapInArrow(_finish(method), "doc_id long, n_symbols long, n_removed long, n_spans long, kept_sha256 string"), "result")
