r"""How much the sources of a language differ in their words.

Terms are runs of letters (A-Z lower-cased, every character beyond ASCII a letter) of whole
texts. A language keeps the terms that enough of its documents hold. A group, (lang, source),
and the language as a whole give each kept term a smoothed share of 10**9, as an exact integer:
1 + floor(10**9 * (count + 5) / (N + 5 * V)).

One pass over the texts counts terms, added up before the shuffle. Kept terms fall into blocks
by hash, groups into blocks by number; a tile is a dense int64 matrix, group by term, of two
blocks of groups and one of terms. A tile compares all its pairs of groups at once and keeps a
heap of the leading terms of each group. Spark adds up the pair matrices and merges the heaps.
No tile grows with the number of terms, sources or documents, and nothing is broadcast.

Defined cases: null text, lang and source are empty strings; a row is a document, so repeated
rows count each; a group without terms is compared like any other; a language that keeps no
term has distances of 0 and no leading terms; equal values are ordered by the item's UTF-8
bytes; columns other than text, lang and source are not read. An empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import Scratch
from ._text import LOWER, Words, chunks, utf8

MIN_DOCUMENTS = 30
TOP = 50
#: The integers that shares are parts of, and what is added to every count.
SCALE, PRIOR = 10**9, 5
#: Terms and groups of a tile.
TERMS, GROUPS = 1024, 128
#: Cells of a comparison held at once.
CELLS = 1 << 21
#: Bytes of text whose terms are counted at once.
COUNTED_BYTES = 8 << 20

_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in chunks(batches, size=COUNTED_BYTES):
        data, off = utf8(b.column(0))
        words = Words(LOWER[data], off, _LETTERS)
        ids, terms = words.encoded()
        groups = pd.MultiIndex.from_arrays([b.column(1).to_pandas(), b.column(2).to_pandas()])
        group, names = groups.factorize()
        per_text = words.counts()
        text = np.repeat(np.arange(b.num_rows), per_text)
        # (text, term) once with its count, then (group, term)
        pair, n = np.unique(text * max(1, len(terms)) + ids, return_counts=True)
        which, term = np.divmod(pair, max(1, len(terms)))
        cell, at = np.unique(group[which] * max(1, len(terms)) + term, return_inverse=True)
        held, total = np.bincount(at, minlength=len(cell)), np.bincount(at, weights=n, minlength=len(cell)).astype(np.int64)
        g, term = np.divmod(cell, max(1, len(terms)))
        g, held, total = (np.concatenate([x, y]) for x, y in ((g, np.arange(len(names))), (held, np.zeros(len(names), np.int64)), (total, np.zeros(len(names), np.int64))))
        column = pa.array(terms, pa.binary()).take(pa.array(term)) if len(term) else pa.array([], pa.binary())
        column = pa.concat_arrays([column.cast(pa.string()), pa.nulls(len(names), pa.string())])
        lang, source = (pa.array(names.get_level_values(k), pa.string()).take(pa.array(g)) for k in (0, 1))
        yield pa.record_batch([lang, source, column, pa.array(held, pa.int64()), pa.array(total, pa.int64())], ["lang", "source", "term", "docs", "n"])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, docs, n): documents of a group that hold a term and how often they do; a row without term for each group."""
    d = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    return d.mapInArrow(_count, "lang string, source string, term string, docs long, n long").groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (counts + PRIOR) / total), exact: long division by thousands (total below 9 * 10**15)."""
    whole, rest = np.divmod(counts + PRIOR, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + digit
    return 1 + whole


def _tile(min_heap: int):
    def compare(key: tuple, rows: pa.Table) -> pa.Table:
        t = rows.to_pandas()
        first, second = key[1].as_py(), key[2].as_py()
        heads, cells = t[t["term"].isna()], t[t["term"].notna()]
        heads = heads.sort_values("gid", kind="stable")
        gid, total = heads["gid"].to_numpy(np.int64), heads["total"].to_numpy(np.int64)
        n_terms = int(heads["terms"].iloc[0])
        code, names = pd.factorize(cells["term"])
        counts = np.zeros((len(gid), n_terms), np.int64)  # terms that none of these groups holds stay without a name
        row = np.searchsorted(gid, cells["gid"].to_numpy(np.int64))
        counts[row, code] = cells["n"].to_numpy(np.int64)
        p = shares(counts, total[:, None])
        a, b = np.flatnonzero(gid // GROUPS == first), np.flatnonzero(gid // GROUPS == second)
        apart = np.zeros((len(a), len(b)), np.int64)
        step = max(1, CELLS // max(1, len(a) * len(b)))
        for k in range(0, n_terms, step):
            apart += np.abs(p[a, None, k : k + step] - p[None, b, k : k + step]).sum(axis=2)
        x, y = (m.ravel() for m in np.meshgrid(gid[a], gid[b], indexing="ij"))
        out = [(x, y, apart.ravel(), None)] if first != second else [(x[x < y], y[x < y], apart.ravel()[x < y], None)]
        if first == second and len(cells):
            whole = np.zeros(len(names), np.int64)
            whole[code] = cells["all"].to_numpy(np.int64)
            more = p[:, : len(names)] - shares(whole, heads["lang_total"].to_numpy(np.int64)[:1])
            more[counts[:, : len(names)] == 0] = 0
            rank = np.empty(len(names), np.int64)
            rank[np.argsort(np.array([s.encode() for s in names], object), kind="stable")] = np.arange(len(names))
            for g in range(len(gid)):
                lead = np.flatnonzero(more[g] > 0)
                lead = lead[np.lexsort((rank[lead], -more[g][lead]))][:min_heap]
                out.append((np.full(len(lead), gid[g]), np.full(len(lead), -1), more[g][lead], names[lead]))
        lang = key[0].as_py()
        size = [len(o[0]) for o in out]
        term = np.concatenate([np.full(n, None, object) if o[3] is None else np.asarray(o[3], object) for n, o in zip(size, out)])
        columns = [np.concatenate([np.asarray(o[k], np.int64) for o in out]) for k in range(3)]
        return pa.table({"lang": pa.array([lang] * sum(size), pa.string()), "x": columns[0], "y": columns[1], "value": columns[2], "term": pa.array(term, pa.string())})

    return compare


def source_divergence(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank).

    Part `pair`: every other source of the language with the sum of the absolute differences
    of shares, all ranks. Part `term`: the terms whose share in the group is the most above
    the language's, `top` of them.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    counts = scratch.save(term_counts(docs), "counts")
    held = counts.where("term is not null")
    vocabulary = held.groupBy("lang", "term").agg(F.sum("docs").alias("_d"), F.sum("n").alias("all")).where(F.col("_d") >= min_documents).drop("_d")
    kept = scratch.save(held.join(vocabulary, ["lang", "term"]).select("lang", "source", "term", "n", "all"), "kept")
    vocabulary = kept.groupBy("lang", "term").agg(F.first("all").alias("all"))
    langs = counts.where("term is null").select("lang").distinct().join(vocabulary.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all").alias("lang_n")), "lang", "left").na.fill(0, ["v", "lang_n"])
    langs = scratch.save(langs.select("lang", "v", (F.col("lang_n") + PRIOR * F.col("v")).alias("lang_total"), F.ceil(F.col("v") / TERMS).alias("blocks")), "langs")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    groups = counts.where("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang")
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = scratch.save(groups.select("lang", "source", number.cast("long").alias("gid"), (F.coalesce("group_n", F.lit(0)) + PRIOR * F.col("v")).alias("total"), "lang_total", "blocks"), "groups")
    per_lang = groups.groupBy("lang").agg(F.floor(F.max("gid") / GROUPS).alias("last"), F.max("blocks").alias("blocks"))
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block")
    cells = kept.join(groups.select("lang", "source", "gid", "blocks"), ["lang", "source"]).select("lang", block, "gid", "term", "n", "all")
    sizes = vocabulary.join(per_lang, "lang").select("lang", block).groupBy("lang", "block").agg(F.count("*").alias("terms"))
    heads = groups.select("lang", "gid", "total", "lang_total").join(sizes, "lang")
    nothing = F.lit(None)
    rows = cells.select("lang", "block", "gid", "term", "n", "all", *(nothing.cast("long").alias(c) for c in ("total", "lang_total", "terms")))
    rows = rows.unionByName(heads.select("lang", "block", "gid", nothing.cast("string").alias("term"), nothing.cast("long").alias("n"), nothing.cast("long").alias("all"), "total", "lang_total", "terms"))
    # a row goes to the tiles of its block of groups with every block
    other = F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("_o")
    mine = F.floor(F.col("gid") / GROUPS)
    rows = rows.join(per_lang.select("lang", "last"), "lang").select("*", other).withColumns({"first": F.least(mine, "_o"), "second": F.greatest(mine, "_o")}).drop("_o", "last")
    tiles = scratch.save(rows.groupBy("lang", "first", "second", "block").applyInArrow(_tile(top), "lang string, x long, y long, value long, term string"), "tiles")
    # pairs start from every pair of groups, so a language without kept terms has its zeros
    names = groups.select("lang", "gid", "source")
    pairs = tiles.where("term is null").groupBy("lang", "x", "y").agg(F.sum("value").alias("value"))
    pairs = pairs.unionByName(pairs.select("lang", F.col("y").alias("x"), F.col("x").alias("y"), "value"))
    none = groups.where("blocks = 0").select("lang", F.col("gid").alias("x"))
    none = none.join(none.select("lang", F.col("x").alias("y")), "lang").where("x <> y").withColumn("value", F.lit(0).cast("long"))
    pairs = pairs.unionByName(none).join(names.withColumnRenamed("gid", "x"), ["lang", "x"]).join(names.select("lang", F.col("gid").alias("y"), F.col("source").alias("item")), ["lang", "y"])
    terms = tiles.where("term is not null").select("lang", "x", "value", F.col("term").alias("item")).join(names.withColumnRenamed("gid", "x"), ["lang", "x"])
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return ranked(pairs, "pair").unionByName(ranked(terms, "term").where(F.col("rank") <= top))

