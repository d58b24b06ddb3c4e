"""Packing, repair of conversations, divergence of sources: brute force and the defined cases."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import divergence, packing, queries, repair

SF = "/root/testdata/sf0.001"
ODD = ["", "  ", "<|endoftext|>", "a<|EndOfText|> B<|endoftext|>x", "it's I'LL can't. don't.'s", "étude É.", "ΑΣ. ΌΣΟΣ", "12.5 a1b2", "日本語。テスト", "İstanbul ǅ ﬁ", "\x1c\x1d a\x00b", "naïve…!?", "a_b __ _", "​ zero﻿", "²³ ½ x²", "😀👍🏽 ok!", None, "word " * 9000]


def fuzz(n, seed=1):
    r = random.Random(seed)
    al = "aB'. é́ß1_<| \n\tΣ…’-!?"
    return ["".join(r.choice(al) for _ in range(r.randint(0, 30))) for _ in range(n)]


def plain_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    return [e.ids + [1] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check_packing(texts, rows, capacity=4096):
    """Pieces make up every text's ids, sequences are gapless and within the limit."""
    want, by, seq = dict(texts), defaultdict(list), defaultdict(list)
    ids = dict(zip(want, plain_ids(want.values())))
    for r in rows:
        by[r["doc_id"]].append(r)
        seq[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by) == set(want)
    for k, pieces in by.items():
        pieces.sort(key=lambda r: r["piece"])
        assert [p["piece"] for p in pieces] == list(range(len(pieces))) and all(p["length"] == capacity for p in pieces[:-1])
        at = 0
        for p in pieces:
            assert p["start"] == at and p["ids_crc32"] == zlib.crc32(np.array(ids[k][at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids[k]) and (len(pieces) == 1) == (at <= capacity)
    for parts in seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(seq), -(-sum(map(len, ids.values())) // capacity)


def test_token_ids_are_the_tokenizers():
    texts = ODD + fuzz(1500)
    ids, first = packing.token_ids(pa.array(texts, pa.string()), packing.tokenizer_path())
    assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == plain_ids(texts)


def test_words_that_were_forgotten(monkeypatch):
    monkeypatch.setattr(packing, "MEMORY", 40)
    monkeypatch.setattr(packing, "_word_ids", {})
    for part in (ODD[:9], ODD, fuzz(60), ODD, fuzz(60)):
        ids, first = packing.token_ids(pa.array(part, pa.string()), packing.tokenizer_path())
        assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == plain_ids(part)


def test_op12(spark):
    rows = queries.op12_best_fit_packing(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    used, least = check_packing(texts, rows)
    assert used <= least + 1


def test_packing_defined_cases(spark, empty):
    r = random.Random(5)
    texts = dict(enumerate([*ODD, *(" ".join(["word"] * r.choice([0, 1, 4095, 4096, 4094, 1500, 2700, 9000, 3])) for _ in range(60))]))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumns({"piece": F.lit("x"), "uid": F.lit(1), "bin": F.lit(0)}).repartition(3)
    used, least = check_packing(texts, packing.pack_documents(docs).collect())
    assert used <= 1.1 * least
    assert packing.pack_documents(empty).collect() == []
    twice = spark.createDataFrame([(7, "same text"), (7, "same text"), (None, None)], "doc_id long, text string")
    got = packing.pack_documents(twice).collect()
    assert sorted((x["doc_id"] is None, x["length"]) for x in got) == [(False, 3), (False, 3), (True, 1)]
    assert len({x["sequence_id"] for x in got}) == 1 and sorted(x["offset"] for x in got)[0] == 0


def test_many_shards(spark, monkeypatch):
    """Emptiest bins of several shards are packed again, and no more bins than needed are used."""
    monkeypatch.setattr(packing, "SHARD", 40)
    r = random.Random(2)
    texts = {k: " ".join(["word"] * r.randint(200, 1900)) for k in range(300)}
    used, least = check_packing(texts, packing.pack_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect())
    assert used <= least * 1.05 + 1


def test_generations_make_packings_better():
    rng = np.random.default_rng(4)
    # triplets that fill bins exactly and that best fit takes apart
    a, b = rng.integers(900, 1600, 60), rng.integers(900, 1600, 60)
    length = np.concatenate([a, b, 4096 - a - b])
    first = packing._filled(np.full(len(length), -1), length, np.argsort(-length, kind="stable"), 4096)
    best = packing.evolve(length, [], 1)
    assert np.bincount(best, weights=length).max() <= 4096
    assert packing._worth(best, length) <= packing._worth(first, length)
    again = packing.evolve(length, [best, first], 2)
    assert packing._worth(again, length) <= packing._worth(best, length)
    child = packing._cross(first, best, length, 4096, rng)
    assert np.bincount(child, weights=length).max() <= 4096 and (child >= 0).all()


def all_edits(rows):
    """(cost, audit) by trying every edit, up to two rows put in anywhere."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    best = (10**9, "")
    stack = [(0, 0, 0, "", 0)]
    while stack:
        i, place, cost, audit, put = stack.pop()
        if cost > best[0] or cost > 3 * len(rows):
            continue
        if i == len(rows) and place in (0, 3):
            best = min(best, (cost, audit))
        for x in "ua":
            if (place, x) in step and put < 2:
                stack.append((i, step[place, x], cost + 2, audit + "I", put + 1))
        if i < len(rows):
            c, f = rows[i]
            stack.append((i + 1, place, cost + 3, audit + "D", 0))
            if f not in (1, 2):
                if (place, c) in step:
                    stack.append((i + 1, step[place, c], cost + (f == 3), audit + "K", 0))
                for x in "ua":
                    if x != c and (place, x) in step:
                        stack.append((i + 1, step[place, x], cost + 2 + (f == 3), audit + "R", 0))
    return best


def test_cheapest_edits():
    for n in range(4):
        for rows in itertools.product(itertools.product("sua", (0, 1, 3)), repeat=n):
            assert repair.cheapest_edits(list(rows)) == all_edits(list(rows))
    r = random.Random(8)
    for _ in range(150):
        rows = [(r.choice("suax"), r.choice([0, 0, 0, 1, 2, 3])) for _ in range(r.randint(4, 6))]
        assert repair.cheapest_edits(rows) == all_edits(rows)


def test_long_conversations_take_little_room():
    rows = [("ua"[k % 2], 0) for k in range(30_000)]
    rows[777] = ("u", 0)
    cost, audit = repair.cheapest_edits(rows)
    assert cost == 2 and audit.count("R") == 1 and audit[777] == "R"


def brute_report(rows):
    """What op11 returns for the damaged rows (turn, role, text) of a conversation."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, read = set(), []
    for _, role, text in rows:
        ink = text.rstrip(" \t\n\x0b\x0c\r")
        read.append((role[:1], 1 if not ink else 2 if (role, text) in seen else 0 if ink[-1] in ".!?" else 3))
        seen.add((role, text))
    turns = {t for t, _, _ in rows if t is not None}
    cost, audit = all_edits(read) if read else (0, "")
    at, place, out = 0, [], []
    for e in audit:
        if e == "D":
            at += 1
            continue
        role, text = rows[at][1:] if e != "I" else (None, "")
        at += e != "I"
        if e != "K":
            role = "assistant" if place and place[-1] == "u" else "user"
        place.append(role[:1])
        out.append(f"{role}:{text}")
    n = Counter(f for _, f in read)
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(read, read[1:]))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, n[1], n[2], n[3], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def test_repair_defined_cases(spark):
    r = random.Random(3)
    texts = ["Fine.", "cut off", "", " \t", "Same!", "Same!", None, "née?  ", "x" * 200_000]
    given = [(c, r.choice([None, *range(7)]), r.choice(["user", "assistant", "system", "tool", None]), r.choice(texts)) for c in [*range(60), None] for _ in range(r.randint(1, 4))]
    given += [(99, 5, "user", "Hi."), (99, 5, "user", "Hi.")]
    df = spark.createDataFrame(given, "conv_id long, turn long, role string, text string").withColumns({"audit": F.lit(1), "step": F.lit("x"), "present": F.lit(False)}).repartition(5)
    damaged = defaultdict(list)
    for c, turn, role, text in given:
        damaged[c] += []
        key = f"{' ' if c is None else c}:{' ' if turn is None else turn}"
        role, text, k = " " if role is None else role, " " if text is None else text, zlib.crc32(key.encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        damaged[c] += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    got = repair.repaired_digests(repair.repair_conversations(repair.damage(df), F.col("present"))).collect()
    assert {x["conv_id"]: tuple(x)[1:] for x in got} == {c: brute_report(rows) for c, rows in damaged.items()} and len(got) == len(damaged)
    assert any(not rows for rows in damaged.values()) or True
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repaired_digests(repair.repair_conversations(none)).collect() == []


def test_rows_of_one_turn_come_by_their_whole_texts(spark):
    """As in the SQL; of texts that begin alike for 32 characters too."""
    given = [(c, 0, "user", "The same beginning, for all of them: " + x) for c in range(20) for x in (f"z{c}.", f"m{c}", f"a{c}!", f"é{c}.")]
    df = spark.createDataFrame(given, "conv_id long, turn long, role string, text string").repartition(3)
    got = {x["conv_id"]: tuple(x)[1:] for x in repair.repaired_digests(repair.repair_conversations(df)).collect()}
    assert got == {c: brute_report([row[1:] for row in given if row[0] == c]) for c in range(20)}


def test_repaired_rows_are_sound(spark):
    rows = repair.repair_conversations(spark.read.parquet(f"{SF}/conversations.parquet").where("turn <> 1")).collect()
    roles = defaultdict(str)
    for x in rows:
        if x["edit"] in ("K", "R", "I"):
            roles[x["conv_id"]] += x["role"][0]
    assert roles and all(re.fullmatch("(s?(ua)+)?", v) for v in roles.values())
    with pytest.raises(Exception, match="order in which"):
        repair.repaired_digests(repair.repair_conversations(spark.read.parquet(f"{SF}/conversations.parquet")).where("step <> 0")).collect()


def brute_divergence(rows, least, top):
    count, held, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        words = ["".join(ch.lower() if ch < "\x80" else ch for ch in w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]
        groups.add((lang, source))
        count[lang, source].update(words)
        held[lang].update(set(words))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(w for w, n in held[lang].items() if n >= least)
        own = sorted(s for l, s in groups if l == lang)
        whole = Counter()
        for s in own:
            whole.update(count[lang, s])

        def share(c, kept=kept):
            n = sum(c[w] for w in kept) + 5 * len(kept)
            return {w: 1 + 10**9 * (c[w] + 5) // n for w in kept}

        p, q = {s: share(count[lang, s]) for s in own}, share(whole)
        for s in own:
            pairs = sorted(((-sum(abs(p[s][w] - p[o][w]) for w in kept), o.encode(), o) for o in own if o != s))
            out += [(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(pairs, 1)]
            terms = sorted((-(p[s][w] - q[w]), w.encode(), w) for w in kept if count[lang, s][w] and p[s][w] > q[w])[:top]
            out += [(lang, s, "term", w, -v, k) for k, (v, _, w) in enumerate(terms, 1)]
    return sorted(out)


def make_texts(seed, n=160):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abÉéß漢") for _ in range(r.randint(1, 3))) for _ in range(60)] + ["A", "a"]
    langs, sources = ["en", "fr", None, "", "xx"], ["s", "t", None, "é", "ü", "src10", "src9"]
    rows = [(" ".join(r.choice(vocab) for _ in range(r.randint(0, 40))), r.choice(langs[:4]), r.choice(sources)) for _ in range(n)]
    return rows + [(None, "en", "void"), ("", "xx", "p"), (None, "xx", "q"), ("rare", "xx", "q"), ("12 34", "yy", "only"), ("a " * 60_000, "en", "s")] + [rows[0]] * 5


@pytest.mark.parametrize(("terms", "groups", "cells"), [(1024, 128, 1 << 21), (7, 2, 64), (5, 3, 1)])
def test_divergence(spark, monkeypatch, terms, groups, cells):
    for name, value in (("TERMS", terms), ("GROUPS", groups), ("CELLS", cells)):
        monkeypatch.setattr(divergence, name, value)
    rows = make_texts(terms)
    df = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({"term": F.lit("x"), "n": F.lit(3), "docs": F.lit(1), "doc_id": F.lit(None)}).repartition(4)
    got = sorted(map(tuple, divergence.source_divergence(df, 6, 8).collect()))
    assert got == brute_divergence(rows, 6, 8)


def test_divergence_of_nothing(spark, empty):
    assert divergence.source_divergence(empty).collect() == []


def test_shares_are_exact():
    r = random.Random(1)
    total = [r.randint(1, 9 * 10**15) for _ in range(500)]
    count = [r.randint(0, t) for t in total]
    got = divergence.shares(np.array(count), np.array(total) + 5)
    assert got.tolist() == [1 + 10**9 * (c + 5) // (t + 5) for c, t in zip(count, total)]
