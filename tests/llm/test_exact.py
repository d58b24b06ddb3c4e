"""Operators with an exact result, against plain Python."""

import hashlib

import brute
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, near_dedup, recompression, suffix_dedup
from tidemark.llm import _repeats as R
from tidemark.llm._spark import MIN_FILES, Scratch, connected_components, join_hot, list_folder


def rows(df, n):
    return {r[0]: tuple(r[1 : n + 1]) for r in df.collect()}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(docs, corpus, k):
    assert rows(near_dedup.near_duplicates(docs, k), 3) == brute.near_duplicates([r[:2] for r in corpus], k)


def test_near_duplicates_cases(spark, empty):
    assert near_dedup.near_duplicates(empty).count() == 0
    text = "a b c d e f g h"
    df = spark.createDataFrame([(5, text, 1), (5, text, 2), (None, text, 3), (None, None, 4), (7, text, 5), (9, " ", 6)], "doc_id long, text string, node long")
    got = sorted(map(tuple, near_dedup.near_duplicates(df, 2).collect()), key=str)
    assert got == sorted([(5, 7, 5, True), (5, 7, 5, True), (None, 7, None, True), (None, 0, None, True), (7, 7, 5, False), (9, 0, 9, True)], key=str)
    kept = near_dedup.drop_near_duplicates(df, 2)
    assert kept.columns == df.columns
    assert sorted((r[0] is not None, r[0]) for r in kept.collect()) == [(False, None), (False, None), (True, 5), (True, 9)]


def test_drop_near_duplicates_keeps_texts_that_share_an_id(spark):
    text, other = "a b c d e f g h", "p q r s t u v w"
    df = spark.createDataFrame([(text, 2, 5), (text, 1, 5), (other, 1, 5), (None, 3, 6), (text, 0, 7)], "text string, rows_of_id long, doc_id int")
    for parts in (1, 4):
        kept = near_dedup.drop_near_duplicates(df.repartition(parts), 2)
        assert kept.columns == df.columns
        assert sorted(map(tuple, kept.collect()), key=str) == sorted([(text, 1, 5), (other, 1, 5), (None, 3, 6)], key=str)


def test_near_duplicates_without_star(spark):
    """A chain in which only neighbours are similar, and a group whose smallest id is not its centre."""
    words = [f"w{i}" for i in range(400)]
    chain = [(i, " ".join(words[3 * i : 3 * i + 100])) for i in range(40)]
    got = rows(near_dedup.near_duplicates(spark.createDataFrame(chain, "doc_id long, text string"), 2), 3)
    assert got == brute.near_duplicates(chain, 2)
    assert {v[1] for v in got.values()} == {0}


def test_prune_table():
    table = near_dedup.prune_table(0.8, 1e-7)
    assert [n for n, _ in table] == [32, 64, 96, 128, 160]
    assert all(0 < m < n * 0.8 for n, m in table)


def test_benchmark_hits(spark, docs, corpus):
    items = [(1, corpus[2][1]), (2, corpus[7][1]), (11, corpus[7][1]), (3, "one"), (4, "two words"), (5, None), (6, " ,; "), (7, "ab ab ab"), (None, "x y")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute.benchmark_hits([r[:2] for r in corpus], [i for i in items if i[0] is not None])
    assert rows(decontaminate.benchmark_hits(docs, bench), 5) == want
    assert rows(decontaminate.benchmark_hits(docs, bench, block_bytes=300), 5) == want
    clash = docs.withColumn("item_id", F.lit(1)).withColumn("spans", F.lit(2)).withColumn("items", F.lit(3))
    assert rows(decontaminate.benchmark_hits(clash, bench.withColumn("doc_id", F.lit(1))), 5) == want
    long = spark.createDataFrame([(1, "filler " * 200_000 + corpus[2][1])], "doc_id long, text string")
    assert rows(decontaminate.benchmark_hits(long, bench), 5) == brute.benchmark_hits([(1, "filler " * 200_000 + corpus[2][1])], [i for i in items if i[0] is not None])
    kept = decontaminate.drop_contaminated(docs, bench)
    assert {r.doc_id for r in kept.collect()} == {i for i, v in want.items() if not v[4]}
    assert kept.columns == docs.columns


def test_benchmark_hits_empty(spark, docs, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.benchmark_hits(docs, bench).where("contaminated").count() == 0
    assert decontaminate.benchmark_hits(empty, bench).count() == 0


def test_repeated_strings(docs, corpus):
    assert rows(suffix_dedup.remove_repeated_strings(docs), 4) == brute.repeated_strings([r[:2] for r in corpus])


def test_repeated_windows(docs, corpus):
    df = recompression.remove_repeated_windows(docs).drop("n_spans")
    assert rows(df, 3) == brute.repeated_windows([r[:2] for r in corpus])


def thue_morse(n: int) -> tuple[str, str]:
    """Two words of n letters that polynomials modulo a power of two can't tell apart."""
    w = "a"
    while len(w) < n:
        w += w.translate(str.maketrans("ab", "ba"))
    return w, w.translate(str.maketrans("ab", "ba"))


def test_words_that_hash_alike(spark):
    a, b = thue_morse(256)
    x, y = thue_morse(1024)
    prose = [f"w{i}" for i in range(120)]
    texts = [a, b, x, y, " ".join([*prose[:40], a, *prose[40:80]]), " ".join([*prose[:40], b, *prose[40:80]]), " ".join([*prose[:10], x, *prose[10:20], y]), f"{x}{a}{x} {b}", f"{y}{a}{y} {a}"]
    rows_ = list(enumerate(texts))
    df = spark.createDataFrame(rows_, "doc_id long, text string")
    assert rows(near_dedup.near_duplicates(df, 2), 3) == brute.near_duplicates(rows_, 2)
    items = [(1, a), (2, x), (3, f"w39 {b} w40")]
    assert rows(decontaminate.benchmark_hits(df, spark.createDataFrame(items, "item_id long, text string")), 5) == brute.benchmark_hits(rows_, items)
    assert rows(suffix_dedup.remove_repeated_strings(df), 4) == brute.repeated_strings(rows_)
    assert rows(recompression.remove_repeated_windows(df).drop("n_spans"), 3) == brute.repeated_windows(rows_)


def test_windows_of_one_name(monkeypatch):
    """Where all names collide, bytes decide."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(R.T, "range_names", lambda sums, a, z, inverse=0: np.zeros(len(a), np.uint64))
    s = R.read_bytes(pa.array(["abcdefgh", "xxcdefyy", "abcd"]))
    at = np.array([i for a, z in zip(s.first[:-1], s.first[1:]) for i in range(a, z - 3)])
    texts = ["abcdefgh", "xxcdefyy", "abcd"]
    windows = [t[i : i + 4] for t in texts for i in range(len(t) - 3)]
    assert R.found_twice(s, np.zeros(len(at), np.int64), at, 4).tolist() == [windows.count(w) > 1 for w in windows]


def test_long_texts_in_pieces(corpus, monkeypatch):
    """Anchors of texts longer than the positions that are packed together."""
    import numpy as np
    import pyarrow as pa

    texts = pa.array([t for _, t, *_ in corpus])
    for read, choose, window, module in ((R.read_bytes, suffix_dedup.choose_suffixes, 200, suffix_dedup), (R.read_words, recompression.choose_symbols, 35, recompression)):
        s = read(texts)
        want = choose(s, window)
        monkeypatch.setattr(module, "PIECE", 37)
        assert all(np.array_equal(x, y) for x, y in zip(choose(s, window), want, strict=True))


def test_batches_to_a_kept_index(spark, docs, corpus, tmp_path):
    """A saved index takes later batches; each batch's rows are judged on all so far."""
    parts = [(docs.where(F.col("doc_id") % 3 == k), [r[:2] for r in corpus if r[0] % 3 == k]) for k in range(3)]
    earlier, seen = None, []
    for df, own in parts:
        seen += own
        want = brute.repeated_strings(seen)
        got = rows(suffix_dedup.add_to_index(df, earlier, str(tmp_path / "index")), 4)
        assert got == {i: want[i] for i, _ in own}
        earlier = df if earlier is None else earlier.union(df)
    assert [n for n, _ in suffix_dedup.SuffixIndex(spark, str(tmp_path / "index")).levels] == [2, 1]


def test_large_tables_go_early(spark, docs):
    """Of the suffixes, the index and the contexts nothing is left once the marks are known."""
    scratch = Scratch(spark, "suffix")
    suffix_dedup.remove_repeated_strings(docs, scratch=scratch)
    left = {x.split("-", 1)[-1] for x in list_folder(spark, scratch.root)}
    assert {"classes", "marks"} <= left and not left & {"index", "sampled", "contexts", "repeated", "keys"}


def test_repeats_by_name(docs, corpus, monkeypatch):
    """The way for keys with very many contexts."""
    monkeypatch.setattr(R, "HOT", 1)
    assert rows(suffix_dedup.remove_repeated_strings(docs, batches=3), 4) == brute.repeated_strings([r[:2] for r in corpus])
    assert rows(recompression.remove_repeated_windows(docs).drop("n_spans"), 3) == brute.repeated_windows([r[:2] for r in corpus])


@pytest.mark.parametrize("remove", [suffix_dedup.remove_repeated_strings, recompression.remove_repeated_windows])
def test_repeats_cases(spark, empty, remove):
    assert remove(empty).count() == 0
    text = " ".join(f"w{i}" for i in range(90))
    df = spark.createDataFrame([(5, text, 1), (5, text, 2), (None, text, 3), (None, None, 4), (6, text + " tail", 5), (6, "short", 6)], "doc_id long, text string, key long")
    got = remove(df)
    lost = {(r[0], r[1]): r[2] for r in got.collect()}
    assert got.count() == 6
    assert all((n > 0) == (total > 1 and total != 5) for (_, total), n in lost.items() if total)


def test_symbols_are_named_for_anchors_alone(monkeypatch):
    """Cutting contexts and removing what is marked needs no names."""
    import pyarrow as pa

    def unasked(*_):
        raise AssertionError("named")

    monkeypatch.setattr(R.T.Words, "names", unasked)
    monkeypatch.setattr(R.T, "byte_symbols", unasked)
    for method, text, kept in ((recompression.WORDS, " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}" for i in (*range(5), *range(45, 60)))), (suffix_dedup.BYTES, "abcde" * 60, "abcde" * 8)):
        w = method.window
        marks = [{"begin": 5, "end": 45}] if w == 35 else [{"begin": 40, "end": 300}]
        (out,) = R._finish(method)([pa.RecordBatch.from_pylist([{"doc_id": 1, "text": text, "copies": 1, "marks": marks}])])
        assert out.to_pylist()[0]["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest()
        for hot, n in ((False, 1), (True, 4)):
            edges = [{"key": 7, "single": True, "lo": 2, "hi": 5, "hot": hot}]
            (out,) = R._contexts(method)([pa.RecordBatch.from_pylist([{"uid": 1, "text": text, "edges": edges}])])
            assert out.num_rows == n and (hot or out.column("body")[0].as_py() == (b" ".join(f"w{i}".encode() for i in range(2, 40)) if w == 35 else text[2:205].encode()))


def test_every_window_has_an_anchor():
    """Random words with runs: choose_symbols raises where a window has none."""
    import numpy as np

    r = np.random.default_rng(1)
    for size in (2, 3, 5, 50):
        for _ in range(30):
            n = int(r.integers(35, 400))
            names = r.integers(0, size, n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(3)
            s = R.Symbols(names, np.array([0, n]), np.arange(n), np.arange(n), np.zeros(0, np.uint8))
            starts, chosen, key, at = recompression.choose_symbols(s, 35)
            assert (at >= starts).all() and (at < starts + 35).all()
            seen = {}
            for b, k, a in zip(starts, key, at, strict=True):
                w = names[b : b + 35].tobytes()
                assert seen.setdefault(w, (int(k), int(a - b))) == (int(k), int(a - b))


def test_extra_columns(docs, corpus):
    clash = docs.withColumn("band", F.lit(1)).withColumn("uid", F.lit(2)).withColumn("component_id", F.lit(3))
    assert near_dedup.near_duplicates(clash, 2).count() == len(corpus)
    assert suffix_dedup.remove_repeated_strings(clash).count() == len(corpus)


def test_suffix_tasks_hold_little():
    """Each byte is a symbol, so a task must look at few bytes together whatever it is given."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(3)
    texts = ["".join(map(chr, r.integers(97, 123, 2000))) for _ in range(2000)]
    uid = pa.array(range(2000), pa.int64())
    given = pa.RecordBatch.from_arrays([uid, pa.array(texts)], names=["uid", "text"])
    bodies = [x[:400].encode() for x in texts for _ in range(5)]
    key = pa.array(np.repeat(np.arange(2000), 5), pa.int64())
    zero = pa.array(np.zeros(10000), pa.int64())
    kept = pa.RecordBatch.from_arrays([key, zero, key, pa.array([True] * 10000), zero.cast(pa.int32()), pa.array(bodies)], names=["key", "more", "uid", "single", "start", "body"])
    for task, batches in ((R._entries, [given]), (R._compare, [kept.slice(i, 1000) for i in range(0, 10000, 1000)])):
        tracemalloc.start()
        n = sum(b.num_rows for b in task(suffix_dedup.BYTES)(iter(batches)))
        most = tracemalloc.get_traced_memory()[1] / 1e6
        tracemalloc.stop()
        assert n >= 10000 and most < 80


def test_components_of_few_edges_are_few_files(spark, tmp_path):
    """A round over few edges writes few files however many partitions shuffles have; keys of any kind may be hot."""
    n = spark.conf.get("spark.sql.shuffle.partitions")
    held = ("spark.sql.shuffle.partitions", "60"), ("spark.sql.adaptive.coalescePartitions.enabled", "false")
    for k, v in held:
        spark.conf.set(k, v)
    try:
        scratch = Scratch(spark, "few")
        edges = spark.range(2000).select(F.col("id").alias("a"), (F.col("id") - F.col("id") % 100).alias("b"))
        got = connected_components(edges, scratch)
        assert got.inputFiles() and len(got.inputFiles()) <= MIN_FILES
        assert {r[0] - r[0] % 100 == r[1] for r in got.collect()} == {True} and got.count() == 2000
        plan = join_hot(edges, scratch.save(edges.groupBy("b").agg(F.count("*").alias("n"))), "b", "n")
        assert "LeftAnti" not in plan._jdf.queryExecution().optimizedPlan().toString() and plan.count() == 2000
    finally:
        spark.conf.set(held[0][0], n)
        spark.conf.unset(held[1][0])
    rows = spark.createDataFrame([(bytes([i % 3]), i) for i in range(30)] + [(None, 99)], "k binary, i int")
    facts = scratch.save(rows.groupBy("k").agg(F.count("*").alias("n"), F.sum("i").alias("s")))
    assert join_hot(rows, facts, "k", "n").agg(F.count("*"), F.sum("s")).first() == (30, sum(10 * sum(range(j, 30, 3)) for j in range(3)))
    assert join_hot(rows, facts, "k", "n", "left").count() == 31
