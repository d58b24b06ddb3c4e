"""Substring dedup by recompression.

Rounds rename the words of a text: first runs of equal words get one symbol, then in
each round adjacent symbols (left-class, right-class) become one. Classes and new
symbols depend on the old symbols alone: a name is a 64-bit fingerprint of what it
stands for, which makes naming global, the same on every executor and in every later
batch, without exchanging a dictionary. Equal substrings so get equal symbols in their
interior. With each symbol the words its existence depends on are kept; a window of
WINDOW words always holds a symbol that depends on nothing outside of it (or three
equal words in a row), and the least-named such symbol is the window's anchor. Shared
anchors reveal long repeats, which are then verified window by window.

Words covered by a window whose word sequence also starts anywhere else are removed,
judged on the input. Defined cases: null text has no words; texts shorter than a
window lose nothing; a text of any length is handled whole, within one task; repeated
rows are copies of each other; null or shared doc_ids are told apart by text; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from . import _repeats as R
from . import _text as T
from ._spark import Scratch

WINDOW = 35
#: At most 35 - 2 * (2 + 2 + 4 + 8) = 3 words of a window lie outside its own symbols' reach after three rounds.
ROUNDS = 3
_U = np.uint64
#: Windows of one text that are looked at together; names are packed with symbol numbers counted from the first of them.
PIECE = 1 << 22
_LOW = np.uint64((1 << 24) - 1)


def recompress(names: np.ndarray, first: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, ...]:
    """(name, first word, dependence begin, dependence end) of each symbol after the rounds."""
    n = len(names)
    edge = np.zeros(n + 1, bool)
    edge[first] = True  # a text begins here (or all ends)
    # runs of equal words
    head = np.ones(n, bool)
    head[1:] = (names[1:] != names[:-1]) | edge[1:n]
    a = np.flatnonzero(head)
    b = np.concatenate([a[1:], [n]])
    sym = names[a].copy()
    run = b - a > 1
    sym[run] = T.mix(sym[run] * _U(0x9E3779B97F4A7C15) + (b - a)[run].astype(np.uint64))
    lo, hi = a - 1, b + 1
    for r in range(rounds):
        opens = edge[a]  # first symbol of a text
        right = (T.mix(sym + _U((r + 1) * 0xA24BAED4963EE407 % 2**64)) >> _U(63)).astype(bool)
        m = len(sym)
        pair = np.zeros(m, bool)  # with the next one
        pair[:-1] = ~right[:-1] & right[1:] & ~opens[1:]
        second = np.concatenate([[False], pair[:-1]])
        last = np.concatenate([opens[1:], [True]])  # last symbol of a text
        nlo, nhi = lo.copy(), hi.copy()
        nxt = np.flatnonzero(pair | (~right & ~last))
        nhi[nxt] = np.maximum(hi[nxt], hi[nxt + 1])
        prv = np.flatnonzero(right & ~second & ~opens)
        nlo[prv] = np.minimum(lo[prv], lo[prv - 1])
        at = np.flatnonzero(~second)
        new = sym.copy()
        p = np.flatnonzero(pair)
        new[p] = T.mix(sym[p] * _U(0xD1342543DE82EF95) + T.mix(sym[p + 1] + _U(r + 1)))
        sym, a, lo, hi = new[at], a[at], nlo[at], nhi[at]
    return sym, a, lo, hi


def choose_symbols(s: R.Symbols, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each window the least-named symbol that depends on the window's words alone, or else its first three equal words."""
    starts = np.flatnonzero(T.lengths_left(s.first) >= window)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    n = len(s.names)
    sym, at, lo, hi = recompress(s.names, s.first)
    m = len(sym)
    i, j = np.searchsorted(lo, starts), np.searchsorted(hi, starts + window, "right")
    high, chosen = T.mix(sym) & ~_LOW, np.zeros(len(starts), np.int64)
    for p in range(0, len(starts), PIECE):  # each piece spans no more symbols than the low bits count
        a, z = np.minimum(i[p : p + PIECE], m), np.minimum(np.maximum(j[p : p + PIECE], i[p : p + PIECE]), m)
        base, top = int(a[0]), int(z[-1])
        packed = np.concatenate([high[base:top] | np.arange(top - base, dtype=np.uint64), [np.iinfo(np.uint64).max]])
        pairs = np.empty(2 * len(a), np.int64)
        pairs[::2], pairs[1::2] = a - base, z - base
        chosen[p : p + PIECE] = base + (np.minimum.reduceat(packed, pairs)[::2] & _LOW).astype(np.int64)
    chosen = np.minimum(chosen, m - 1)
    # a short symbol alone would be common by chance: its key names all words it depends on, which the window holds
    reach = np.maximum(lo[chosen], 0), np.minimum(hi[chosen], n)
    place = at[chosen]
    key = T.range_names(T.prefix_sums(s.names), *reach) + T.mix(sym[chosen] + (place - reach[0]).astype(np.uint64))
    # three equal words in a row, where no symbol depends on the window alone
    same = np.flatnonzero((s.names[: n - 2] == s.names[1 : n - 1]) & (s.names[1 : n - 1] == s.names[2:]))
    if len(same):
        k = np.minimum(np.searchsorted(same, starts), len(same) - 1)
        has = (same[k] >= starts) & (same[k] + 3 <= starts + window) & (i >= j)
        chosen = np.where(has, m + same[k], chosen)
        place = np.where(has, same[k], place)
        key = np.where(has, T.mix(s.names[same[k]] + _U(0x9E6C63D0876A9A47)), key)
    else:
        has = np.zeros(len(starts), bool)
    if not (has | (i < j)).all():
        raise AssertionError("a window without an anchor")
    return starts, chosen, key, place


WORDS = R.Method(WINDOW, R.read_words, choose_symbols, b" ")


def remove_repeated_windows(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, n_spans, kept_sha256 of every row of `docs` (doc_id, text)."""
    scratch = scratch or Scratch(docs.sparkSession, "recompression")
    classes = R.text_classes(docs, scratch)
    entries = scratch.save(R.sample_entries(docs, classes, WORDS), "symbols")
    contexts = scratch.save(R.distinct_contexts(entries), "contexts")
    marks = R.edge_marks(docs, classes, entries, contexts, WORDS, scratch)
    scratch.drop(entries, contexts)
    return R.remove_marked(docs, classes, marks, WORDS, scratch).withColumnRenamed("n_symbols", "n_words")
