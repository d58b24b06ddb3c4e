"""Policy graphs: routes that part and meet again."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import policy as P


def rows(paths):
    """Steps of routes given as (states, actions): state k is reached by action k - 1."""
    return [(1, r, k, s, a[k - 1] if k else None, float(r), r == 0) for r, (states, a) in enumerate(paths) for k, s in enumerate(states)]


SCHEMA = "g int, route int, seq int, place string, action string, cost double, selected boolean"


def test_states_meet_again(spark):
    paths = [("SABE", "xyz"), ("SCBE", "uvz"), ("SABF", "xyw")]
    steps = spark.createDataFrame(rows(paths), SCHEMA).repartition(3)
    nodes, branches = P.merged_policy(steps, ["g"], "route", "seq", ["place"], "action", "cost", "selected")
    got = sorted((r.depth, r.terminal, r.routes, r.outgoing) for r in nodes.collect())
    assert got == [(0, False, 3, 2), (1, False, 1, 1), (1, False, 2, 1), (2, False, 3, 2), (3, True, 1, 0), (3, True, 2, 0)]
    b = {r.action: r for r in branches.collect()}
    assert set(b) == set("xyzuvw") and b["z"].routes == 2 and b["z"].cost == 0.0 and b["x"].routes == 2
    assert [k for k in "xyzuvw" if b[k].needs_review] == ["u", "v", "w"]
    member = [(1, 0, "m", 1.0, 0, 10.0), (1, 1, "m", 1.0, 0, 12.0), (1, 2, "m", 1.0, 0, 10.0), (1, 0, "n", 3.0, 1, None), (1, 1, "n", 3.0, 0, 9.0), (1, 2, "n", 3.0, 0, 11.0)]
    outcomes = spark.createDataFrame(member, "g int, route int, member string, weight double, class_rank int, elapsed double")
    support = P.branch_support(steps, ["g"], "route", "seq", ["place"], "action", outcomes, ["class_rank", "elapsed"])
    by = {r.action: r.support for r in support.join(branches.select("branch", "action"), "branch").collect()}
    # m: z and w are equal at B; n: u is best at S, z (by route 1) at B
    assert by == {"x": 1.0, "y": 4.0, "z": 3.5, "w": 0.5, "u": 3.0, "v": 4.0}


@pytest.mark.parametrize("seed", range(3))
def test_shared_endings_is_the_least_graph(spark, seed):
    r = random.Random(seed)
    routes = [tuple(r.choice("ab") for _ in range(r.randint(1, 5))) for _ in range(9)]
    steps = spark.createDataFrame([(1, k, i, a) for k, w in enumerate(routes) for i, a in enumerate(w)], "g int, route int, seq int, action string").repartition(4)
    nodes, branches = P.shared_endings(steps, ["g"], "route", "seq", "action")
    words = set(routes)
    prefixes = {w[:i] for w in words for i in range(len(w) + 1)}
    right = {p: frozenset(w[len(p):] for w in words if w[: len(p)] == p) for p in prefixes}
    assert nodes.count() == len(set(right.values()))
    edges = {(right[p], a, right[p + (a,)]) for p, a in itertools.product(prefixes, "ab") if p + (a,) in prefixes}
    assert branches.count() == len(edges)
    root = max(nodes.collect(), key=lambda n: n.height)
    assert root.routes == len(routes) and root.height == max(map(len, words))
    # every route, and nothing else, is a way from the root to an end
    out = {}
    for b in branches.collect():
        out.setdefault(b.from_node, []).append((b.action, b.to_node))
    seen = set()

    def walk(node, word):
        seen.add(word)
        for a, to in out.get(node, []):
            walk(to, word + (a,))

    walk(root.node, ())
    assert seen == prefixes


def test_chained_names(spark):
    w = ["abcdefg", "abcdxfg", "a", "abcdefg"]
    df = spark.createDataFrame([(k, i, a) for k, x in enumerate(w) for i, a in enumerate(x)], "k int, i int, a string")
    got = {(r.k, r.i): r.name for r in P.chain_names(df, ["k"], F.col("i"), "a").collect()}
    pairs = [(k, i) for k, x in enumerate(w) for i in range(len(x))]
    assert all((got[p] == got[q]) == (w[p[0]][: p[1] + 1] == w[q[0]][: q[1] + 1]) for p in pairs for q in pairs)


def test_no_routes(spark):
    steps = spark.createDataFrame([], "g int, route int, seq int, action string")
    nodes, branches = P.shared_endings(steps, ["g"], "route", "seq", "action")
    assert nodes.count() == branches.count() == 0


def test_shared_endings_keeps_alike_routes_as_one(spark, monkeypatch):
    """What is saved grows with the different routes, not with their number; ways and nodes are counted in routes."""
    kept = []
    save = P.Steps.save

    def counted(self, df):
        out = save(self, df)
        kept.append(out.count())
        return out

    monkeypatch.setattr(P.Steps, "save", counted)
    c = F.col("id")
    steps = spark.range(3000).select(F.lit(1).alias("g"), (c % 1000).alias("route"), F.floor(c / 1000).alias("seq"), F.when((c % 1000 == 7) & (c > 1000), None).when(c < 1000, F.concat(F.lit("a"), (c % 2).cast("string"))).otherwise("").alias("action"))
    nodes, branches = P.shared_endings(steps.repartition(5), ["g"], "route", "seq", "action")
    assert sorted((r.height, r.routes, r.outgoing) for r in nodes.collect()) == [(0, 1000, 0), (1, 1, 1), (1, 999, 1), (2, 500, 1), (2, 500, 2), (3, 1000, 2)]
    assert max(kept) <= 10
    ways = {(r.action, r.routes) for r in branches.collect()}
    assert {("a0", 500), ("a1", 500)} <= ways and sum(r.routes for r in branches.collect()) == 3000
