"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sha(x: str | bytes) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def near_duplicates(rows: list[tuple[int, str | None]], k: int) -> dict[int, tuple[int, int, bool]]:
    sets = {}
    for i, t in rows:
        w = SPACED.findall((t or "").translate(_LOW))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    ids, post = sorted(sets), defaultdict(list)
    for i in ids:
        both = Counter(j for s in sets[i] for j in post[s])
        for j, n in both.items():
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                up[b] = a
        for s in sets[i]:
            post[s].append(i)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def conversations(rows: list[tuple]) -> dict:
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t, r, x))
    out = {}
    for c, turns in by.items():
        key = lambda x: tuple((v is not None, v if v is not None else 0) for v in x[:1]) + tuple((v is not None, v or "") for v in x[1:])
        turns = [((r or ""), (x or "")) for _, r, x in sorted(turns, key=key)]
        loss = "".join(x for r, x in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(loss), sha(loss))
    return out


def benchmark_hits(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], window: int = 10) -> dict:
    grams = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall((t or "").translate(_LOW))
        m = min(window, len(w))
        for j in range(len(w) - m + 1 if m else 0):
            grams[tuple(w[j : j + m])].add(i)
    sizes = sorted({len(g) for g in grams})
    out = {}
    for d, t in docs:
        w = ALNUM.findall((t or "").translate(_LOW))
        hit, found = set(), set()
        for m in sizes:
            for j in range(len(w) - m + 1):
                g = tuple(w[j : j + m])
                if g in grams:
                    hit.update(range(j, j + m))
                    found |= grams[g]
        out[d] = (len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit))
    return out


def repeated_strings(rows: list[tuple[int, str | None]], length: int = 200) -> dict:
    seen = Counter()
    raw = {i: (t or "").encode() for i, t in rows}
    for b in raw.values():
        seen.update(hash(b[j : j + length]) for j in range(len(b) - length + 1))
    out = {}
    for i, b in raw.items():
        gone, reach = bytearray(len(b)), 0
        for j in range(len(b) - length + 1):
            if seen[hash(b[j : j + length])] > 1:
                for q in range(max(reach, j), j + length):
                    gone[q] = 1
                reach = j + length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        out[i] = (len(b), sum(gone), spans, sha(kept))
    return out


def repeated_windows(rows: list[tuple[int, str | None]], window: int = 35) -> dict:
    words = {i: SPACED.findall(t or "") for i, t in rows}
    seen = Counter(tuple(w[j : j + window]) for w in words.values() for j in range(len(w) - window + 1))
    out = {}
    for i, w in words.items():
        gone = set()
        for j in range(len(w) - window + 1):
            if seen[tuple(w[j : j + window])] > 1:
                gone.update(range(j, j + window))
        out[i] = (len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def base_quality(text: str | None) -> tuple[int, int, int, int, int, bool]:
    text = text or ""
    w = SPACED.findall(text)
    seen = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = set()
    for j, g in enumerate(zip(w, w[1:], w[2:], strict=False)):
        if seen[g] > 1:
            hit.update((j, j + 1, j + 2))
    earlier, dup = set(), 0
    for line in text.split("\n"):
        if SPACED.search(line):
            dup += line in earlier
            earlier.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)
