r"""Packing of tokenized documents into sequences of a fixed length, as few as can be.

A document is its token ids and an end id. Longer ones than a sequence are cut into full
pieces and a rest; full pieces are sequences of their own. The others are packed by a grouping
genetic algorithm. Items are dealt at random to shards of bounded size; each shard is packed on
several islands, each a task of its own with its own population. Crossover takes whole well
filled bins of one parent into the other, drops the bins that then hold an item twice, and puts
the displaced items back by best fit. After each epoch an island sends its best packing to the
next one; a shard that has as few bins as its tokens allow leaves the rounds. The emptiest bins
of all shards are then opened and their items packed again in fewer shards, until one is left.

A worker remembers the ids of words: the tokenizer drops white space, so the ids of a text are
those of its words in turn.

Defined cases: null and empty texts are the end id alone; a row is a document, repeated rows
are packed each; texts of any length are cut, never shortened; equal lengths are dealt with in
the order in which the pieces were written; columns other than doc_id and text are not read.
An empty table has no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import Scratch
from ._text import LOWER, NOT_SPACE, Words, chunks, utf8

CAPACITY = 4096
END_ID = 1
#: Items of a shard, and how many of its bins are opened for the next level (one at least).
SHARD, OPENED = 8192, 1 / 64
ISLANDS, EPOCHS, POPULATION, GENERATIONS = 3, 2, 5, 12
#: Words that a worker remembers at once (about 200 bytes each).
MEMORY = 1_000_000
#: Bytes of text tokenized at once.
BATCH_BYTES = 2 << 20

#: Bytes by kind: 0 white space, 1 letters (A-Z counted with a-z, all beyond ASCII), 2 the rest.
_KIND = np.full(256, 2, np.int8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Token ids of strings, kept in one array as they are first met."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.last[i] = token.endswith("</w>")
        self._empty()

    def _empty(self) -> None:
        self.known: dict[bytes, int] = {}
        self.start, self.length, self.alone, self.met = (np.zeros(1024, t) for t in (np.int64, np.int64, bool, np.int32))
        self.ids, self.used = np.zeros(8192, np.int32), 0

    def _forget(self) -> None:
        """Keep what has been met more than once."""
        keep = [w for w, k in self.known.items() if self.met[k] > 1]
        at = np.array([self.known[w] for w in keep], np.int64)
        length, alone = self.length[at], self.alone[at]
        ids = self.ids[np.repeat(self.start[at] - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))]
        self._empty()
        if len(keep) * 2 <= MEMORY:
            self._add(keep, length, ids, alone)

    def _add(self, words: list[bytes], lengths: np.ndarray, ids: np.ndarray, alone) -> None:
        n, k = len(self.known), len(words)
        while n + k > len(self.start):
            self.start, self.length, self.alone, self.met = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length, self.alone, self.met))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.start[n : n + k] = self.used + np.cumsum(lengths) - lengths
        self.length[n : n + k], self.alone[n : n + k] = lengths, alone
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.known.update(zip(words, range(n, n + k)))

    def _learn(self, words: list[bytes]) -> None:
        texts = b" ".join(words).decode().split(" ")
        letters = [t.isalpha() for t in texts]
        plain = [k for k, x in enumerate(letters) if x]
        other = [k for k, x in enumerate(letters) if not x]
        for k in range(0, len(plain), 200):
            part = plain[k : k + 200]
            ids = np.array(self.tokenizer.encode(" ".join([texts[i] for i in part]), add_special_tokens=False).ids, np.int32)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(part):  # each is one group of tokens at least
                self._add([words[i] for i in part], np.diff(ends, prepend=0), ids, True)
            else:
                other += part
        if other:
            ids = [e.ids for e in self.tokenizer.encode_batch([texts[i] for i in other], add_special_tokens=False)]
            ascii_marks = [not letters[i] and texts[i].isascii() and "'" not in texts[i] and not re.search("[A-Za-z]", texts[i]) for i in other]
            self._add([words[i] for i in other], np.array([len(x) for x in ids], np.int64), np.array([i for x in ids for i in x], np.int32), ascii_marks)

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each string's ids begin in `ids`, how many there are, and whether its ids are the same beside strings of another kind."""
        if len(self.known) > MEMORY:
            self._forget()
        fresh = [w for w in words if w not in self.known]
        if fresh:
            self._learn(fresh)
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        self.met[at] += 1
        return self.start[at], self.length[at], self.alone[at]


_word_ids: dict[str, WordIds] = {}


def _encoded(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The number of each range of bytes, and the distinct ones by number."""
    size = end - start
    # up to seven bytes and their number are one integer
    short = size < 8
    eight = np.ndarray(len(data), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    n = size[short].astype(np.uint64)
    value = (eight[start[short]] & ((np.uint64(1) << (n * np.uint64(8))) - np.uint64(1))) | (n << np.uint64(56))
    code, values = pd.factorize(value)
    packed = values.astype("<u8").tobytes()
    words = [packed[8 * k : 8 * k + packed[8 * k + 7]] for k in range(len(values))]
    ids = np.empty(len(start), np.int64)
    ids[short] = code
    long = ~short
    if long.any():
        off = np.zeros(int(long.sum()) + 1, np.int64)
        np.cumsum(size[long], out=off[1:])
        held = pa.py_buffer(data[np.repeat(start[long] - off[:-1], size[long]) + np.arange(off[-1])])
        held = pa.Array.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(off), held]).dictionary_encode()
        ids[long] = np.asarray(held.indices).astype(np.int64) + len(words)
        words += held.dictionary.to_pylist()
    return ids, words


def token_ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts with the end id behind each, and where each text begins (one more entry than texts).

    Letters and other characters of a word are looked up apart where both are plain, words
    with an apostrophe or a sign beyond ASCII that is no letter as a whole.
    """
    memory = _word_ids.get(path) or _word_ids.setdefault(path, WordIds(path))
    data, off = utf8(texts)
    # the tokenizer lower-cases, but the names of its special tokens are told by case and are no words
    special = b"<|" in data.tobytes()
    data = data if special else LOWER[data]
    kind = _KIND[data]
    if special:
        kind = np.minimum(kind, 1)
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[off] = True
    edges = np.flatnonzero(edge)
    inside = kind[edges[:-1]] > 0
    start, end = edges[:-1][inside], edges[1:][inside]
    ids, distinct = _encoded(data, start, end)
    at, length, alone = (x[ids] for x in memory.of(distinct)) if len(ids) else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
    if special or not alone.all():
        words = Words(data, off, NOT_SPACE)
        owner = np.searchsorted(words.start, start, "right") - 1
        parts = np.bincount(owner, minlength=len(words.start))
        whole = np.zeros(len(words.start), bool)
        whole[owner[~alone]] = True
        whole &= parts > 1
        if whole.any():
            wids, wdistinct = _encoded(data, words.start[whole], words.end[whole])
            # what is remembered may have been sorted out meanwhile: look both up at once
            size = len(distinct)
            at, length, _ = memory.of(distinct + wdistinct)
            ids, start = np.concatenate([ids[~whole[owner]], wids + size]), np.concatenate([start[~whole[owner]], words.start[whole]])
            order = np.argsort(start, kind="stable")
            start, at, length = start[order], at[ids[order]], length[ids[order]]
    sizes = np.bincount(np.searchsorted(off, start, "right") - 1, weights=length, minlength=len(texts)).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(sizes + 1)])
    out = np.full(first[-1], END_ID, np.int32)
    places = np.ones(len(out), bool)
    places[first[1:] - 1] = False
    ends = np.cumsum(length)
    out[places] = memory.ids[np.repeat(at - (ends - length), length) + np.arange(int(ends[-1]) if len(ends) else 0)]
    return out, first


def tokenized_pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the pieces of each document."""
    path = path or tokenizer_path()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, size=BATCH_BYTES):
            ids, first = token_ids(b.column(1), path)
            size = np.diff(first)
            count = -(-size // capacity)
            doc = np.repeat(np.arange(b.num_rows), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * capacity
            length = np.minimum(capacity, size[doc] - start)
            little = ids.astype("<u4")
            crc = [zlib.crc32(little[a : a + n]) for a, n in zip(first[doc] + start, length)]
            yield pa.record_batch([b.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(pieces, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class _BestFit:
    """Bins by the room they have left; the fullest one that still has room takes an item."""

    def __init__(self, capacity: int):
        self.capacity, self.mask, self.by_room, self.n = capacity, 0, {}, 0

    def bin(self, number: int, room: int) -> None:
        self.by_room.setdefault(room, []).append(number)
        self.mask |= 1 << room

    def put(self, length: int) -> int:
        fits = self.mask >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            number = self.by_room[room].pop()
            if not self.by_room[room]:
                self.mask &= ~(1 << room)
        else:
            room, number, self.n = self.capacity, self.n, self.n + 1
        self.bin(number, room - length)
        return number


def _filled(assigned: np.ndarray, length: np.ndarray, order: np.ndarray, capacity: int) -> np.ndarray:
    """A packing in which the items of `order`, not assigned yet (-1), have gone in by best fit; bins are numbered anew."""
    out = np.full(len(assigned), -1)
    held = assigned >= 0
    bins, out[held] = np.unique(assigned[held], return_inverse=True)
    room = capacity - np.bincount(out[held], weights=length[held], minlength=len(bins)).astype(int)
    fit = _BestFit(capacity)
    fit.n = len(bins)
    for number, left in enumerate(room.tolist()):
        if left:
            fit.bin(number, left)
    out[order] = [fit.put(n) for n in length[order].tolist()]
    return out


def _worth(packing: np.ndarray, length: np.ndarray) -> tuple[int, float]:
    """Less is better: bins, then how evenly they are filled."""
    load = np.bincount(packing, weights=length)
    return len(load), -float((load**2).sum())


def _cross(a: np.ndarray, b: np.ndarray, length: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """a with whole well filled bins of b: a's bins that hold an item of those go, what they held besides is put back."""
    load = np.bincount(b, weights=length)
    well = np.flatnonzero(load >= np.quantile(load, 0.5))
    chosen = np.zeros(len(load), bool)
    chosen[rng.choice(well, max(1, len(well) // 4), replace=False)] = True
    taken = chosen[b]
    gone = np.zeros(a.max() + 1, bool)
    gone[a[taken]] = True
    # the emptiest bins are opened too, so that what is displaced finds new company
    own = np.bincount(a, weights=length)
    gone[np.argsort(own, kind="stable")[: max(1, len(own) // 50)]] = True
    child = np.where(gone[a], -1, a)
    child[taken] = len(own) + b[taken]
    loose = np.flatnonzero(child < 0)
    return _filled(child, length, loose[np.argsort(-length[loose], kind="stable")], capacity)


def evolve(length: np.ndarray, given: list[np.ndarray], seed: int, capacity: int = CAPACITY) -> np.ndarray:
    """The best packing (bin of each item) after some generations from the given ones and best fits in noisy orders of size."""
    rng = np.random.default_rng(seed)
    least = -(-int(length.sum()) // capacity)
    people = list(given)
    none = np.full(len(length), -1)
    while len(people) < POPULATION:
        noise = rng.normal(0, 0.08, len(length)) if people else 0.0
        people.append(_filled(none, length, np.argsort(-length * (1 + noise), kind="stable"), capacity))
        if len(people) == 1 and people[0].max() + 1 == least:
            return people[0]
    people = sorted(((_worth(p, length), k, p) for k, p in enumerate(people)), key=lambda x: x[:2])
    for g in range(GENERATIONS):
        if people[0][0][0] <= least:
            break
        i, j = rng.choice(len(people), 2, replace=False)
        i, j = (i, j) if rng.random() < 0.5 else (j, i)
        child = _cross(people[i][2], people[j][2], length, capacity, rng)
        people[-1] = max(people[-1], (_worth(child, length), len(people) + g, child), key=lambda x: (-x[0][0], -x[0][1], -x[1]))
        people.sort(key=lambda x: x[:2])
    return people[0][2]


_PACKED = "shard long, island int, uid long, length long, bin int, offset long, bins int, square double, least int"


def _island(capacity: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        shard, island = key[0].as_py(), key[1].as_py()
        t = rows.to_pandas().sort_values(["slot", "uid"], kind="stable")
        items = t[t["slot"] == t["slot"].min()] if len(t) else t
        uid, length = items["uid"].to_numpy(np.int64), items["length"].to_numpy(np.int64)
        given = [x["bin"].to_numpy(np.int64) for _, x in t[t["bin"].notna()].groupby("slot")]
        best = evolve(length, given, shard * 31 + island + 1_000_003 * len(given), capacity)
        bins, negative = _worth(best, length)
        order = np.argsort(best, kind="stable")
        before = np.cumsum(length[order]) - length[order]
        head = np.concatenate([[True], np.diff(best[order]) > 0])
        offset = before - np.repeat(before[head], np.diff(np.append(np.flatnonzero(head), len(order))))
        n, least = len(order), -(-int(length.sum()) // capacity)
        fixed = lambda v, kind: pa.array(np.full(n, v), kind)
        return pa.table([fixed(shard, pa.int64()), fixed(island, pa.int32()), pa.array(uid[order]), pa.array(length[order]), pa.array(best[order], pa.int32()), pa.array(offset, pa.int64()), fixed(bins, pa.int32()), fixed(-negative, pa.float64()), fixed(least, pa.int32())], names=["shard", "island", "uid", "length", "bin", "offset", "bins", "square", "least"])

    return run


def _pack_shards(items: DataFrame, shards: int, level: int, capacity: int, scratch: Scratch) -> DataFrame:
    """(shard, uid, length, bin, offset): each shard's best packing of any island and epoch."""
    shard = F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(shards)).alias("shard")
    state = items.select(shard, F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), F.lit(0).alias("slot"), "uid", "length", F.lit(None).cast("int").alias("bin"))
    rank = F.struct("bins", -F.col("square"), "island")
    for epoch in range(EPOCHS):
        packed = scratch.save(state.groupBy("shard", "island").applyInArrow(_island(capacity), _PACKED), "islands")
        top = packed.groupBy("shard").agg(F.min(rank).alias("top"), F.first("least").alias("least"))
        last = epoch == EPOCHS - 1
        settled = packed.join(top.where(F.lit(last) | (F.col("top.bins") <= F.col("least"))).select("shard", F.col("top.island").alias("island")), ["shard", "island"])
        done = settled if epoch == 0 else done.unionByName(settled)
        if last:
            break
        going = packed.join(top.where(F.col("top.bins") > F.col("least")).select("shard"), "shard")
        if going.isEmpty():
            break
        # elites stay at home and go to the next island
        state = going.select("shard", F.explode(F.array(F.struct("island", F.lit(0).alias("slot")), F.struct(((F.col("island") + 1) % ISLANDS).alias("island"), F.lit(1).alias("slot")))).alias("e"), "uid", "length", "bin").select("shard", "e.island", "e.slot", "uid", "length", "bin")
    return done.select("shard", "uid", "length", "bin", "offset")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): where each piece of each document goes."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = scratch.save(tokenized_pieces(docs, capacity, path).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    whole = pieces.where(F.col("length") == capacity).select(*columns, (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    items = pieces.where(F.col("length") < capacity).select("uid", "length")
    left, level, placed = items.count(), 0, None
    while left:
        shards = -(-left // SHARD)
        packed = _pack_shards(items, shards, level, capacity, scratch)
        if shards > 1:
            packed = scratch.save(packed, "packed")
            bins = packed.groupBy("shard", "bin").agg(F.sum("length").alias("load"))
            emptiest = Window.partitionBy("shard").orderBy("load", "bin")
            bins = bins.withColumns({"_k": F.row_number().over(emptiest), "_n": F.count("*").over(Window.partitionBy("shard"))})
            bins = scratch.save(bins.where((F.col("_k") <= F.greatest(F.lit(1), F.floor(F.col("_n") * OPENED))) & (F.col("load") < capacity)).select("shard", "bin"), "opened")
            items = scratch.save(packed.join(bins, ["shard", "bin"]).select("uid", "length"), "items")
            packed, left = packed.join(bins, ["shard", "bin"], "left_anti"), items.count()
        else:
            left = 0
        # level, shard and bin as one number: a shard has at most SHARD items or a few more, so 20 bits hold its bins
        number = F.lit(level) * (1 << 58) + F.col("shard") * (1 << 20) + F.col("bin")
        packed = packed.select("uid", number.cast("long").alias("sequence_id"), "offset")
        placed, level = packed if placed is None else placed.unionByName(packed), level + 1
    if placed is None:
        return whole
    return pieces.join(placed, "uid").select(*columns, "sequence_id", "offset").unionByName(whole)
