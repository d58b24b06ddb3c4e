"""Benchmark decontamination with Wu-Manber multi-pattern search over words.

Symbols are the numbers of the benchmark's words, looked up by the words' bytes; every
other word is 0. For each pattern length m there are Wu-Manber's tables: blocks of two
words (one for one-word patterns) with the shift each allows, buckets of patterns by
the hash of their last block, and the patterns themselves for direct comparison. Many
cursors walk the words of a chunk in lockstep; a cursor jumps by the shift of the
block it stands on, m - 1 words where the block is in no pattern. Hashes choose
positions and buckets only: an occurrence is one where all m words are equal.

Defined cases: null text or text without words: no words, no hits; a benchmark item
without words or without an id matches nothing; a text of any length is scanned whole,
within one task; repeated rows each get a result; items with equal windows are all
counted; extra columns are ignored; empty tables give an empty result or no hits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._spark import Scratch

WINDOW = 10
SEGMENT = 1024
#: Benchmark text scanned for at once; a larger benchmark is scanned for in several blocks.
BLOCK_BYTES = 32 << 20

_RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


class PatternTable:
    """Patterns of one length."""

    def __init__(self, patterns: np.ndarray, items: np.ndarray):
        self.m = m = patterns.shape[1]
        self.b = b = min(2, m)
        ends = np.concatenate([T.chained(patterns[:, j - b + 1 : j + 1]) for j in range(b - 1, m)])
        shifts = np.repeat(np.arange(m - b, -1, -1), len(patterns))
        order = np.lexsort((shifts, ends))
        self.blocks, at = np.unique(ends[order], return_index=True)
        self.shifts = shifts[order][at]
        last = T.chained(patterns[:, m - b :])
        order = np.argsort(last, kind="stable")
        self.last, self.patterns, self.items = last[order], patterns[order], items[order]

    def shift(self, blocks: np.ndarray) -> np.ndarray:
        i = np.minimum(np.searchsorted(self.blocks, blocks), len(self.blocks) - 1)
        return np.where(self.blocks[i] == blocks, self.shifts[i], self.m - self.b + 1)

    def find(self, numbers: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(last word, pattern) of each occurrence within one text; text: text number of each word."""
        n, m = len(numbers), self.m
        if n < m:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        blocks = np.zeros(n, np.uint64)
        blocks[self.b - 1 :] = T.chained(np.stack([numbers[j : n - self.b + 1 + j] for j in range(self.b)], 1))
        begin = np.arange(0, n, SEGMENT)
        stop = np.minimum(begin + SEGMENT, n)
        at = np.maximum(begin, m - 1)
        hits = []
        while True:
            go = at < stop
            if not go.all():
                at, stop = at[go], stop[go]
            if not len(at):
                break
            step = self.shift(blocks[at])
            hits.append(at[step == 0])
            at = at + np.maximum(step, 1)
        at = np.concatenate(hits)
        at = at[text[at] == text[at - m + 1]]
        lo, hi = np.searchsorted(self.last, blocks[at]), np.searchsorted(self.last, blocks[at], "right")
        found_at, found = [], []
        for part in np.array_split(np.arange(len(at)), max(1, int((hi - lo).sum()) // 1_000_000 + 1)):
            many = hi[part] - lo[part]
            where = np.repeat(at[part], many)
            which = np.repeat(lo[part] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum()) if len(part) else np.zeros(0, np.int64)
            for j in range(m):  # direct comparison, word by word
                same = numbers[where - m + 1 + j] == self.patterns[which, j]
                where, which = where[same], which[same]
            found_at.append(where)
            found.append(which)
        return np.concatenate(found_at), np.concatenate(found)


def _words(column: pa.Array) -> T.Words:
    data, off = T.utf8(column)
    return T.Words(T.LOWER[data], off, T.ALNUM)


def pattern_tables(items: list[tuple[int, str | None]], window: int = WINDOW) -> tuple[dict[bytes, int], list[PatternTable]]:
    """The number of each word, from 1, and a table for each length of pattern."""
    by_length: dict[int, tuple[list, list]] = {}
    vocabulary: dict[bytes, int] = {}
    items = [(i, t) for i, t in items if i is not None]
    for at in range(0, len(items), 1000):
        part = items[at : at + 1000]
        w = _words(pa.array([t for _, t in part], pa.string()))
        ids, words = w.encoded()
        numbers = np.array([vocabulary.setdefault(x, len(vocabulary) + 1) for x in words], np.int64)[ids]
        for (item, _), a, z in zip(part, w.first[:-1], w.first[1:], strict=True):
            m = min(window, z - a)
            if m:
                p, i = by_length.setdefault(int(m), ([], []))
                own = np.unique(np.lib.stride_tricks.sliding_window_view(numbers[a:z], m), axis=0)
                p.append(own)
                i.append(np.full(len(own), item, np.int64))
    return vocabulary, [PatternTable(np.concatenate(p), np.concatenate(i)) for _, (p, i) in sorted(by_length.items())]


def _scan(vocabulary: dict[bytes, int], tables: list[PatternTable], first: bool, last: bool):
    """One block of patterns. Between blocks, spans (pairs of word positions) and items travel with the text."""

    def run(batches):
        for batch in T.chunks(batches):
            w = _words(batch.column("text"))
            ids, words = w.encoded()
            numbers, text = np.array([vocabulary.get(x, 0) for x in words], np.int64)[ids], T.owner(w.first)
            starts, ends, docs, items = [], [], [], []
            for t in tables:
                at, which = t.find(numbers, text)
                starts.append(at - t.m + 1)
                ends.append(at + 1)
                docs.append(text[at])
                items.append(t.items[which])
            cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
            starts, ends, docs, items = map(cat, (starts, ends, docs, items))
            if not first:
                for i, (s, k) in enumerate(zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True)):
                    s = np.frombuffer(s, np.int64).reshape(-1, 2) + w.first[i]
                    k = np.frombuffer(k, np.int64)
                    starts, ends = np.concatenate([starts, s[:, 0]]), np.concatenate([ends, s[:, 1]])
                    docs, items = np.concatenate([docs, np.full(len(s), i)]), np.concatenate([items, k])
            own = {}
            for d, i in set(zip(docs.tolist(), items.tolist(), strict=True)):
                own.setdefault(d, []).append(i)
            if not last:
                spans = [b""] * batch.num_rows
                kept = [b""] * batch.num_rows
                for d in own:
                    m = docs == d
                    spans[d] = np.stack([starts[m], ends[m]], 1).astype(np.int64).__sub__(w.first[d]).tobytes()
                    kept[d] = items[m].astype(np.int64).tobytes()
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(spans, pa.binary()), pa.array(kept, pa.binary())], names=["doc_id", "text", "spans", "items"])
                continue
            edge = np.zeros(len(numbers) + 1, np.int64)
            np.add.at(edge, starts, 1)
            np.add.at(edge, ends, -1)
            hit = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
            n_hit = hit[w.first[1:]] - hit[w.first[:-1]]
            lists = [",".join(sorted(map(str, own.get(i, ())))) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(w.counts()), pa.array(n_hit), pa.array([len(own.get(i, ())) for i in range(batch.num_rows)], pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in lists]), pa.array(n_hit > 0)], names=[x.split()[0] for x in _RESULT.split(", ")])

    return run


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of `docs`.

    Patterns travel in blocks of at most about block_bytes of benchmark text each (or one
    item). Each block but the last is a job of its own whose result is written, so driver
    and workers hold the tables of one block at a time.
    """
    total = benchmark.agg(F.coalesce(F.sum(F.octet_length("text") + 8), F.lit(0))).first()[0]
    n = max(1, -(-int(total) // block_bytes))
    df, before = docs.select("doc_id", "text"), None
    for i in range(n):
        block = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
        block = block.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i) if n > 1 else block
        vocabulary, tables = pattern_tables([tuple(r) for r in block.collect()], window)
        scan = _scan(vocabulary, tables, i == 0, i == n - 1)
        if i == n - 1:
            return df.mapInArrow(scan, _RESULT)
        scratch = scratch or Scratch(docs.sparkSession, "decontamination")
        df = scratch.save(df.mapInArrow(scan, "doc_id long, text string, spans binary, items binary"), "scanned")
        if before is not None:
            scratch.drop(before)
        before = df


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of `docs` (doc_id, text and any others) without an occurrence of a benchmark window.

    Rows that share a doc_id go together; a null doc_id is kept unless its own text is hit.
    """
    bad = benchmark_hits(docs, benchmark, window).where("contaminated").select(F.col("doc_id").alias("named_id")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["named_id"]), "left_anti")
