"""MinHash near-dedup with sequential Bayesian verification.

Sets of word shingles are linked when their Jaccard similarity reaches the threshold.

1. One pass over the texts names every shingle and keeps, per document, the set's
   size, a 128-bit digest of its words and a MinHash signature. Documents with equal sets
   form one class; only its smallest id goes on, so groups of copies cost nothing further.
2. Signatures are cut into bands; rows of a band that collide are candidates. In each
   bucket one leader is compared with the members, never all with all.
3. The signatures of a candidate pair are compared batch by batch. After each batch a
   pair goes when the posterior probability (uniform prior) that its similarity
   reaches the threshold is under `miss`.
4. Survivors are verified on the full sets of both texts, word by word.
5. In buckets that still hold more than one component, the members outside the largest
   one are compared with all of the others, block by block inside the tasks: first
   signatures alone, then those rows that any partner survived for, with their texts.
   Pairs are verified where they meet and only links that join something are written.
   Components are star-contracted in Spark.

A family of many texts that collide but don't link is compared block with block: memory
is bounded, its signatures (not its texts) travel once for each block of 1024.

Defined cases: null, empty or wordless text: empty set, linked with nothing. Fewer
words than a shingle: the whole sequence is the one shingle. A text of any length is
one set, within one task. Repeated rows and rows that share a doc_id share a component.
A null doc_id is its own component (null) and kept. The smallest id names a component,
so ties in similarity don't matter. Extra columns are ignored. An empty table gives an
empty result.

Probability that banding misses a pair at the threshold 0.8: (1 - 0.8**5)**32 = 3e-6.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._spark import Scratch, connected_components, join_hot

BANDS, ROWS = 32, 5
SLOTS = BANDS * ROWS
BATCH = 32
MISS = 1e-7

_rng = np.random.default_rng(7)
_MUL = _rng.integers(1, 2**31, SLOTS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_XOR = _rng.integers(0, 2**32, SLOTS, dtype=np.uint32)


class Shingles:
    """Distinct k-word shingles of each text of a chunk (of the whole sequence where it is shorter).

    first: where each text's shingles begin; names: 64-bit names, for signatures and first
    looks; words: the digests of each shingle's words, zero where it has fewer than k.
    """

    def __init__(self, text: pa.Array, k: int):
        data, off = T.utf8(text)
        w = T.Words(T.LOWER[data], off, T.NOT_SPACE)
        ids, words = w.encoded()
        counts, left = w.counts(), T.lengths_left(w.first)
        short = w.first[:-1][(counts > 0) & (counts < k)]
        start = np.sort(np.concatenate([np.flatnonzero(left >= k), short]))
        owner = T.owner(w.first)[start]
        # the words by number, from 1; 0 where a short text ends
        columns = np.stack([np.where(j < left[start], ids[np.minimum(start + j, len(ids) - 1)] + 1, 0) for j in range(k)], 1) if len(start) else np.zeros((0, k), np.int64)
        at = T.first_seen(T.row_numbers(np.column_stack([owner, columns])))
        columns, owner = columns[at], owner[at]
        held = np.concatenate([np.zeros((1, 2), np.uint64), T.digests(words)])
        names = T.chained(held[columns, 0])
        order = np.lexsort((names, owner))
        names, owner, columns = names[order], owner[order], columns[order]
        if ((names[1:] == names[:-1]) & (owner[1:] == owner[:-1])).any():  # different shingles of one name
            order = np.lexsort((*held[columns].reshape(len(columns), -1).T, names, owner))
            names, owner, columns = names[order], owner[order], columns[order]
        self.names, self.words = names, held[columns].reshape(len(columns), 2 * k)
        self.first = np.searchsorted(owner, np.arange(len(text) + 1))

    def sets(self) -> list[np.ndarray]:
        return [self.names[a:z] for a, z in zip(self.first[:-1], self.first[1:], strict=True)]

    def digests(self) -> list[bytes | None]:
        """The digest of each text's whole set."""
        return [T.digest(self.words[a:z].tobytes()) if z > a else None for a, z in zip(self.first[:-1], self.first[1:], strict=True)]


def real_shingles(text: str, k: int) -> set[tuple[bytes, ...]]:
    """The set itself: tuples of words."""
    w = text.encode().lower().split()  # of bytes: lowers A-Z alone and splits at \x20 and \x09-\x0D alone
    return set(zip(*(w[j:] for j in range(k)), strict=False)) if len(w) >= k else {tuple(w)} if w else set()


class Links:
    """Decides pairs: by the names first, then on the words themselves, whose sets are kept for a few texts."""

    def __init__(self, k: int, percent: int, held: int = 64):
        self.k, self.percent, self.held, self.sets = k, percent, held, {}

    def _real(self, key, text: str) -> set[tuple[bytes, ...]]:
        if key not in self.sets:
            if len(self.sets) >= self.held:
                self.sets.pop(next(iter(self.sets)))
            self.sets[key] = real_shingles(text, self.k)
        return self.sets[key]

    def linked(self, lead, names: np.ndarray, text: str, other: np.ndarray, other_text: str) -> bool:
        if not _similar(names, other, self.percent):
            return False
        x, y = self._real(lead, text), real_shingles(other_text, self.k)
        both = len(x & y)
        return both > 0 and 100 * both >= self.percent * (len(x) + len(y) - both)


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    out = np.empty((len(sets), SLOTS), np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return out
    h = np.concatenate([sets[i] for i in full])
    h = (h >> np.uint64(32)).astype(np.uint32)
    first = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])[:-1]])
    x = np.empty_like(h)
    for j in range(SLOTS):
        np.bitwise_xor(h, _XOR[j], out=x)
        np.multiply(x, _MUL[j], out=x)
        np.bitwise_xor(x, x >> np.uint32(15), out=x)
        np.multiply(x, np.uint32(0x2C1B3C6D), out=x)
        out[full, j] = np.minimum.reduceat(x, first)
    return out


def _describe(k: int):
    def run(batches):
        for batch in T.chunks(batches):
            s = Shingles(batch.column("text"), k)
            sig, n = _signatures(s.sets()), np.diff(s.first)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(s.digests(), pa.binary()), pa.array([r.tobytes() if c else None for r, c in zip(sig, n)], pa.binary())], names=["doc_id", "n_shingles", "digest", "sig"])

    return run


def _bands(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, BANDS, ROWS).astype(np.uint64)
        h = np.zeros(sig.shape[:2], np.uint64)
        for r in range(ROWS):
            h = T.mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, r])
        h = T.mix(h + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)).view(np.int64)
        node = np.repeat(np.asarray(batch.column("node")), BANDS)
        low = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, SLOTS).astype(np.uint8)
        s8: list[bytes | None] = [None] * len(node)
        s8[::BANDS] = [r.tobytes() for r in low]  # with the first band only
        yield pa.RecordBatch.from_arrays([pa.array(h.ravel()), pa.array(node), pa.array(s8, pa.binary())], names=["band", "node", "s8"])


def prune_table(threshold: float, miss: float, batch: int = BATCH, slots: int = SLOTS) -> list[tuple[int, int]]:
    """(n, least): of n compared slots at least so many must agree for a pair to go on.

    With a uniform prior, P(similarity >= t | m of n agree) = P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(batch, slots + 1, batch):
        total = 0.0
        for m in range(n + 1):
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= miss:
                out.append((n, m))
                break
    return out


def _alive(x: np.ndarray, y: np.ndarray, table: list[tuple[int, int]]) -> np.ndarray:
    """Rows of x and y that no batch of slots prunes."""
    alive = np.arange(len(x))
    agree = np.zeros(len(x), np.int32)
    at = 0
    for n, least in table:
        agree[alive] += (x[alive, at:n] == y[alive, at:n]).sum(1, dtype=np.int32)
        alive, at = alive[agree[alive] >= least], n
    return alive


def _slots(column: pa.Array) -> np.ndarray:
    """Compared slots, one byte each: the low byte of each signature value."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SLOTS)


def _prune(table: list[tuple[int, int]]):
    def run(batches):
        for b in batches:
            if b.num_rows:
                take = pa.array(_alive(_slots(b.column("sa")), _slots(b.column("sb")), table))
                yield pa.RecordBatch.from_arrays([b.column("a").take(take), b.column("b").take(take)], names=["a", "b"])

    return run


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sets (sorted, distinct) reach the similarity."""
    small, large = min(len(x), len(y)), max(len(x), len(y))
    if 100 * small < percent * large:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def _runs(*columns: list) -> list[tuple[int, int]]:
    """Bounds of runs of rows that are equal in all columns."""
    rows = list(zip(*columns, strict=True))
    cut = [0, *(i for i in range(1, len(rows)) if rows[i] != rows[i - 1]), len(rows)]
    return [(a, z) for a, z in zip(cut, cut[1:], strict=False) if z > a]


def _hopeful(table: list[tuple[int, int]]):
    """Rows sorted by (cl, lead_block, block, role): those with a partner that no batch of slots prunes.

    Leads (role 0) come first, at most a block of them; a lead is given when its first
    such member is seen, so no pairs are written.
    """

    def run(batches):
        key, leads, given = None, [], set()
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = _slots(batch.column("s8"))
            cl, lb, block, role, node, comp, shown = (batch.column(c).to_pylist() for c in ("cl", "lead_block", "block", "role", "node", "comp", "shown"))
            out = []
            for at, end in _runs(cl, lb, block, role):
                if (cl[at], lb[at], block[at]) != key:
                    key, leads, given = (cl[at], lb[at], block[at]), [], set()
                if role[at] == 0:
                    leads += [(node[i], comp[i], sig[i].copy(), i) for i in range(at, end)]
                    continue
                own, kinds, ids = sig[at:end], np.array(comp[at:end]), np.array(node[at:end])
                seen, first = np.array(shown[at:end]) == 1, own[:, : table[0][0]]
                hope = np.zeros(end - at, bool)
                for n, c, x, _ in leads:
                    near = (kinds != c) & ~(seen & (ids < n)) & ((first == x[None, : table[0][0]]).sum(1) >= table[0][1])
                    near = np.flatnonzero(near)
                    near = near[_alive(np.broadcast_to(x, own[near].shape), own[near], table)]
                    if len(near):
                        hope[near] = True
                        if n not in given:
                            given.add(n)
                            out.append((*key, 0, n, c, 1))
                out += [(*key, 1, node[i + at], comp[i + at], shown[i + at]) for i in np.flatnonzero(hope).tolist()]
            cols = list(zip(*out, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(),) * 3 + (pa.int32(),) + (pa.int64(),) * 2 + (pa.int32(),), strict=True)], names=["cl", "lead_block", "block", "role", "node", "comp", "shown"])

    return run


def _meet(k: int, percent: int, table: list[tuple[int, int]]):
    """Rows sorted by (cl, lead_block, block, role): the leads (role 0), then the members each of them is compared with.

    Signatures first, batch by batch; pairs that survive are verified on the full sets at
    once, likeliest first. Pairs that links of this block have joined already are passed
    over, so a block gives fewer links than it has rows.
    """

    def run(batches):
        key, leads, up, links = None, [], {}, Links(k, percent)

        def root(c):
            while up.get(c, c) != c:
                up[c] = up.get(up[c], up[c])
                c = up[c]
            return c

        for batch in T.chunks(batches):
            text = batch.column("text")
            sets = Shingles(text, k).sets()
            sig = _slots(batch.column("s8"))
            cl, lb, block, role, node, comp, shown = (batch.column(c).to_pylist() for c in ("cl", "lead_block", "block", "role", "node", "comp", "shown"))
            la, lb_ = [], []
            for at, end in _runs(cl, lb, block, role):
                if (cl[at], lb[at], block[at]) != key:
                    key, leads, up, links = (cl[at], lb[at], block[at]), [], {}, Links(k, percent)
                if role[at] == 0:
                    leads += [(node[i], comp[i], sig[i].copy(), sets[i].copy(), text[i].as_py()) for i in range(at, end)]
                    continue
                own, kinds = sig[at:end], np.array(comp[at:end])
                first = own[:, : table[0][0]]
                for n, c, x, mine, words in leads:
                    same = [q for q in np.unique(kinds).tolist() if root(q) == root(c)]
                    near = np.flatnonzero(~np.isin(kinds, same) & ((first == x[None, : table[0][0]]).sum(1) >= table[0][1]))
                    near = near[_alive(np.broadcast_to(x, own[near].shape), own[near], table)]
                    near = near[np.argsort(-(own[near] == x[None]).sum(1), kind="stable")]
                    for i in (near + at).tolist():
                        if node[i] == n or (shown[i] and node[i] < n) or root(comp[i]) == root(c):
                            continue
                        if links.linked(n, mine, words, sets[i], text[i].as_py()):
                            up[root(comp[i])] = root(c)
                            la.append(n)
                            lb_.append(node[i])
            yield pa.RecordBatch.from_arrays([pa.array(la, pa.int64()), pa.array(lb_, pa.int64())], names=["a", "b"])

    return run


def _verify(k: int, percent: int):
    """Rows sorted by (cl, block), leads (leads is null) first, then members with the leads to compare with."""

    def run(batches):
        held: dict[int, tuple[np.ndarray, str]] = {}
        key, links = None, Links(k, percent)
        for batch in T.chunks(batches):
            text = batch.column("text")
            sets = Shingles(text, k).sets()
            cl, block, node, leads = (batch.column(c).to_pylist() for c in ("cl", "block", "node", "leads"))
            la, lb = [], []
            for i, mine in enumerate(sets):
                if (cl[i], block[i]) != key:
                    key, held, links = (cl[i], block[i]), {}, Links(k, percent)
                if leads[i] is None:
                    held[node[i]] = mine.copy(), text[i].as_py()
                    continue
                for a in leads[i]:
                    if links.linked(a, *held[a], mine, text[i].as_py()):
                        la.append(a)
                        lb.append(node[i])
            yield pa.RecordBatch.from_arrays([pa.array(la, pa.int64()), pa.array(lb, pa.int64())], names=["a", "b"])

    return run


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """rows (cl, node, ...) with `block` and `blocks`: groups of more than `size` nodes are split by a hash."""
    n = rows.groupBy("cl").agg(F.ceil(F.count("*") / size).alias("blocks"))
    return rows.join(n, "cl").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))


def _confirm(pairs: DataFrame, texts: DataFrame, scratch: Scratch, k: int, percent: int) -> DataFrame:
    """Those of the pairs (cl, a, b) whose sets pass. Within a block of cl each text travels once."""
    members = pairs.groupBy("cl", F.col("b").alias("node")).agg(F.collect_list("a").alias("leads"))
    members = scratch.save(_blocks(members, 512).select("cl", "block", "node", "leads"), "members")
    leads = members.select("cl", "block", F.explode("leads").alias("node")).distinct().withColumn("leads", F.lit(None).cast("array<bigint>"))
    rows = leads.unionByName(members).join(texts, "node").repartition("cl", "block").sortWithinPartitions("cl", "block", F.size("leads") > 0)
    return scratch.save(rows.mapInArrow(_verify(k, percent), "a long, b long"), "links")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, miss: float = MISS, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of `docs` (doc_id, text)."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "near-dedup")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    seen = scratch.save(docs.mapInArrow(_describe(shingle), "doc_id long, n_shingles long, digest binary, sig binary"), "signatures")
    full = seen.where("n_shingles > 0 and doc_id is not null")
    classes = scratch.save(full.groupBy("digest").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")), "classes")
    nodes = classes.select("node").distinct()
    sigs = full.select(F.col("doc_id").alias("node"), "sig")
    bands = scratch.save(sigs.join(nodes, "node", "left_semi").mapInArrow(_bands, "band long, node long, s8 binary"), "bands")
    shared = bands.groupBy("band").agg(F.min("node").alias("leader"), F.max("node").alias("last"), F.count("*").alias("n")).where("leader <> last")
    shared = scratch.save(shared, "shared")
    members = scratch.save(join_hot(bands.select("band", "node"), shared.select("band", "leader", "n"), "band", "n").distinct(), "buckets")
    near = members.select("node").distinct()
    held = scratch.save(bands.where("s8 is not null").select("node", "s8").join(near, "node", "left_semi").distinct(), "held")
    texts = scratch.save(docs.withColumnRenamed("doc_id", "node").join(near, "node", "left_semi"), "texts")
    scratch.drop(bands, shared)
    table = prune_table(percent / 100, miss)
    # each bucket's members against its leader
    pairs = members.where("leader <> node").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    pairs = pairs.join(held.select(F.col("node").alias("b"), F.col("s8").alias("sb")), "b")
    leaders = scratch.save(members.where("leader <> node").groupBy(F.col("leader").alias("a")).agg(F.count("*").alias("n")), "leaders")
    leaders = leaders.join(held.select(F.col("node").alias("a"), F.col("s8").alias("sa")), "a")
    pairs = scratch.save(join_hot(pairs, leaders, "a", "n").select("a", "b", "sa", "sb").mapInArrow(_prune(table), "a long, b long"), "pairs")
    links = _confirm(pairs.select(F.col("a").alias("cl"), "a", "b").distinct(), texts, scratch, shingle, percent)
    parts = scratch.save(connected_components(links, scratch), "components", rows=links.count())
    # what is not yet together: leaders have met all others of their bucket
    known = members.where("leader <> node").select("band", "node").join(parts, "node", "left").select("band", "node", F.coalesce("component", "node").alias("comp"))
    known = scratch.save(known, "known")
    per = known.groupBy("band", "comp").agg(F.count("*").alias("n"))
    per = per.groupBy("band").agg(F.max(F.struct("n", "comp")).alias("top"), F.count("*").alias("comps"), F.sum("n").alias("n")).where("comps > 1")
    per = scratch.save(per.select("band", F.col("top.comp").alias("cl"), "n"), "mixed")
    open_ = join_hot(known, per, "band", "n").groupBy("cl", "node", "comp").agg(F.max((F.col("comp") != F.col("cl")).cast("int")).alias("shown"))
    open_ = scratch.save(open_, "open")
    if not open_.isEmpty():
        blocked = scratch.save(_blocks(open_, 1024), "blocked")
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
        leads = blocked.where("shown = 1").withColumn("lead_block", F.col("block")).drop("block").withColumn("block", every)
        rows = leads.withColumn("role", F.lit(0)).unionByName(blocked.withColumn("lead_block", every).withColumn("role", F.lit(1)))
        by, order = ["cl", "lead_block", "block"], ["cl", "lead_block", "block", "role", "node"]
        rows = rows.select(*order, "comp", "shown").join(held, "node").repartition(*by).sortWithinPartitions(*order)
        hopeful = scratch.save(rows.mapInArrow(_hopeful(table), "cl long, lead_block long, block long, role int, node long, comp long, shown int"), "hopeful")
        # a lead may be given once in each Arrow batch of its members
        rows = hopeful.distinct().join(held, "node").join(texts, "node").repartition(*by).sortWithinPartitions(*order)
        more = scratch.save(rows.mapInArrow(_meet(shingle, percent, table), "a long, b long"), "links")
        if not more.isEmpty():
            parts = scratch.save(connected_components(links.union(more), scratch), "components", rows=links.count() + more.count())
    by_class = scratch.save(classes.join(parts, "node", "left").select("digest", "copies", F.coalesce("component", "node").alias("component_id")), "named")
    # rows with a null id and those without shingles are components of their own
    named = join_hot(full.select("doc_id", "n_shingles", "digest"), by_class, "digest", "copies").select("doc_id", "n_shingles", "component_id")
    lone = seen.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return named.unionByName(lone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` whose doc_id names its component.

    Rows that share such an id stay once for each different text, the one whose other
    columns, as JSON, come first.
    """
    scratch = Scratch(docs.sparkSession, "near-dedup")
    kept = near_duplicates(docs, shingle, percent, scratch=scratch).where("kept and doc_id is not null")
    kept = scratch.save(kept.groupBy("doc_id").agg(F.count("*").alias("rows_of_id")), "kept")
    ids = kept.where("rows_of_id = 1").select(F.col("doc_id").alias("kept_id"))
    out = docs.join(ids, docs["doc_id"] == ids["kept_id"], "left_semi").unionByName(docs.where("doc_id is null"))
    shared = kept.where("rows_of_id > 1")
    if shared.isEmpty():
        return out
    rest = F.struct(F.lit(0).alias("_"), *(c for c in docs.columns if c not in ("doc_id", "text")))
    rows = join_hot(docs.select("doc_id", "text", rest.alias("rest")), shared, "doc_id", "rows_of_id")
    rows = rows.groupBy("doc_id", "text").agg(F.min_by("rest", F.to_json("rest")).alias("rest"))
    return out.unionByName(rows.select("doc_id", "text", "rest.*").select(docs.columns))
