"""Routes of alternatives merged into one graph: by common beginnings, by states, by common endings; walks along parent pointers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Steps


def _digest(*parts: Column | str) -> Column:
    """A name for a list of values that depends on them alone; null and the empty text differ."""
    return F.sha2(F.to_json(F.array(*(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts)), {"ignoreNullFields": "false"}), 256)


def _name(*parts: Column | str) -> Column:
    """The first sixteen bytes of a digest."""
    return F.unhex(F.substring(_digest(*parts), 1, 32))


def chain_names(steps: DataFrame, keys: list[str], order: Column, value: str, name: str = "name") -> DataFrame:
    """steps with a name of all values from the first step up to each: equal beginnings have equal names.

    Names are chained by doubling, log2 of the longest chain joins: a step's name covers twice
    as many steps in each round, so nothing grows with the length of a chain.
    """
    t = Steps(steps.sparkSession, "chains")
    cur = steps.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    cur = t.save(cur.withColumn("_d", _digest(value)))
    most = cur.agg(F.max("_n")).first()[0] or 0
    reach = 1
    while reach < most:
        before = cur.select(*keys, (F.col("_n") + reach).alias("_n"), F.col("_d").alias("_b"))
        cur = t.save(cur.join(before, [*keys, "_n"], "left").withColumn("_d", F.when(F.col("_b").isNotNull(), _digest("_b", "_d")).otherwise(F.col("_d"))).select(*cur.columns))
        reach *= 2
    return cur.withColumnRenamed("_d", name).drop("_n")


def prefix_nodes(paths: DataFrame, route: str, seq: str, action: str) -> DataFrame:
    """paths with `node`, the content of the route up to and with the step, and `next_node`."""
    order = Window.partitionBy(route).orderBy(seq)
    so_far = F.concat_ws(">", F.collect_list(action).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = paths.withColumn("node", F.sha2(so_far, 256))
    return out.withColumn("next_node", F.lead("node").over(order))


def policy_graph(paths: DataFrame, route: str, seq: str, action: str, weight: str) -> DataFrame:
    """(node, depth, routes, support, branches): nodes shared by all routes with the same prefix.

    branches: how many different nodes follow; two or more make a decision point.
    """
    n = prefix_nodes(paths, route, seq, action)
    n = n.withColumn("_depth", F.row_number().over(Window.partitionBy(route).orderBy(seq)))
    return n.groupBy("node").agg(F.first("_depth").cast("long").alias("depth"), F.count("*").alias("routes"), F.sum(weight).alias("support"), F.count_distinct("next_node").alias("branches"))


def merged_policy(steps: DataFrame, keys: list[str], route: str, seq: str, state: list[str], action: str, cost: str, selected: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, branches) of the graph that routes make when equal states are one node, so those that part may meet again.

    steps: (keys..., route, seq, state..., action, cost, selected), a row for each state of a
    route; action is the one that led there, null for its first. nodes: (keys..., node, depth,
    terminal, routes, outgoing); two outgoing branches or more make a decision point. branches:
    (keys..., branch, from_node, to_node, action, routes, cost, selected, needs_review): cost
    is the least of the routes that use it, and one that no selected route uses has to be
    looked at again before it is taken.
    """
    order = Window.partitionBy(*keys, route).orderBy(seq)
    s = steps.withColumn("node", _digest(*state)).withColumn("_from", F.lag("node").over(order)).withColumn("_last", F.lead(seq).over(order).isNull())
    s = s.withColumn("_depth", F.row_number().over(order) - 1)
    used = s.where(F.col("_from").isNotNull()).withColumn("branch", _digest("_from", action, "node"))
    branches = used.groupBy(*keys, "branch").agg(F.first("_from").alias("from_node"), F.first("node").alias("to_node"), F.first(action).alias("action"), F.count_distinct(route).alias("routes"), F.min(cost).alias("cost"), F.max(selected).alias("selected"))
    branches = branches.withColumn("needs_review", ~F.col("selected"))
    out = branches.groupBy(*keys, F.col("from_node").alias("node")).agg(F.count("*").alias("outgoing"))
    nodes = s.groupBy(*keys, "node").agg(F.min("_depth").cast("long").alias("depth"), F.max("_last").alias("terminal"), F.count_distinct(route).alias("routes"))
    return nodes.join(out, [*keys, "node"], "left").na.fill(0, ["outgoing"]), branches


def branch_support(steps: DataFrame, keys: list[str], route: str, seq: str, state: list[str], action: str, outcomes: DataFrame, order: list[str]) -> DataFrame:
    """(keys..., branch, support): where a node has several branches each member's weight goes to the best of them, in equal parts among equals.

    A branch is as good for a member as the best of the routes that use it. outcomes: (keys..., route,
    member, weight, the columns of `order`, least first, null last).
    """
    w = Window.partitionBy(*keys, route).orderBy(seq)
    s = steps.withColumn("node", _digest(*state)).withColumn("_from", F.lag("node").over(w)).where("_from is not null")
    used = s.select(*keys, F.col(route).alias("route"), "_from", _digest("_from", action, "node").alias("branch")).distinct()
    worth = F.struct(*(x for c in order for x in (F.col(c).isNull().alias(f"{c}_none"), F.col(c))))
    won = used.join(outcomes.withColumnRenamed(route, "route"), [*keys, "route"]).groupBy(*keys, "_from", "branch", "member").agg(F.min(worth).alias("_w"), F.first("weight").alias("weight"))
    best = Window.partitionBy(*keys, "_from", "member")
    won = won.withColumn("_top", F.min("_w").over(best)).where(F.col("_w") == F.col("_top"))
    return won.withColumn("_n", F.count("*").over(best)).groupBy(*keys, "branch").agg(F.sum(F.col("weight") / F.col("_n")).alias("support"))


def shared_endings(steps: DataFrame, keys: list[str], route: str, seq: str, action: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, branches) of the smallest graph in which each route is a way from the root to the end.

    Nodes are what may still follow: routes that go on alike share the rest, also where they
    have come by different ways. nodes: (keys..., node, height, routes, outgoing), the root has
    every route. branches: (keys..., from_node, action, to_node, routes).

    Routes that do the same from beginning to end are one word with a count; words share their
    beginnings in a tree whose places are named by sixteen bytes. From the ends up, one round for
    each step of the longest word, a place is named by the actions and names of what follows it.
    What follows gets shorter along a route, so no route passes a node twice and counts add up.
    """
    t = Steps(steps.sparkSession, "endings")
    by = [*keys, "prefix"]
    done = F.sort_array(F.collect_list(F.struct(F.col(seq).alias("at"), F.col(action).alias("action"))))
    words = steps.groupBy(*keys, route).agg(F.transform(done, lambda s: s["action"]).alias("word"))
    words = t.save(words.groupBy(*keys, "word").agg(F.count("*").alias("routes")))
    grown = F.aggregate("word", F.array(F.unhex(F.lit(""))), lambda s, a: F.concat(s, F.array(_name(F.hex(F.element_at(s, -1)), a))))
    places = words.select(*keys, "word", "routes", F.posexplode(grown).alias("depth", "prefix"), grown.alias("_g"))
    places = places.select(*by, "depth", "routes", (F.col("depth") == F.size("word")).alias("ends"), F.get("_g", F.col("depth") - 1).alias("parent"), F.get("word", F.col("depth") - 1).alias("action"))
    tree = places.groupBy(*by).agg(F.first("depth").alias("depth"), F.sum("routes").alias("routes"), F.max("ends").alias("ends"), F.first("parent").alias("parent"), F.first("action").alias("action"))
    tree = t.save(tree.sortWithinPartitions("depth"))
    t.drop(words)
    most = tree.agg(F.max("depth")).first()[0] or 0
    levels = []
    for depth in range(most, -1, -1):
        here = tree.where(F.col("depth") == depth).select(*by, "routes", "ends", F.struct("parent", "action").alias("_up"), F.lit(None).cast("struct<action:string,node:binary>").alias("_next"), F.lit(0).cast("long").alias("height"))
        if levels:
            none = {"routes": F.lit(None).cast("long"), "ends": F.lit(None).cast("boolean"), "_up": F.lit(None).cast(here.schema["_up"].dataType)}
            after = levels[-1].select(*keys, F.col("parent").alias("prefix"), *(v.alias(k) for k, v in none.items()), F.struct(F.col("action").cast("string").alias("action"), "node").alias("_next"), (F.col("height") + 1).alias("height"))
            here = here.unionByName(after)
        level = here.groupBy(*by).agg(F.sort_array(F.collect_list("_next")).alias("_follow"), F.max("height").alias("height"), F.max("routes").alias("routes"), F.max("ends").alias("ends"), F.first("_up", True).alias("_up"))
        node = _name(F.to_json("_follow"), "ends")
        levels.append(t.save(level.select(*by, node.alias("node"), "height", F.size("_follow").cast("long").alias("outgoing"), "routes", "_up.parent", "_up.action")))
    t.drop(tree)
    every = levels[0]
    for x in levels[1:]:
        every = every.unionByName(x)
    told = lambda x: F.lower(F.hex(x))
    nodes = every.groupBy(*keys, "node").agg(F.max("height").alias("height"), F.sum("routes").alias("routes"), F.first("outgoing").alias("outgoing")).withColumn("node", told("node"))
    above = every.select(*keys, F.col("prefix").alias("parent"), F.col("node").alias("from_node"))
    ways = every.where("parent is not null").select(*keys, "parent", "action", F.col("node").alias("to_node"), "routes").join(above, [*keys, "parent"])
    branches = ways.groupBy(*keys, "from_node", "action", "to_node").agg(F.sum("routes").alias("routes")).withColumns({"from_node": told("from_node"), "to_node": told("to_node")})
    return nodes, branches


def root_paths(nodes: DataFrame, node: str = "id", parent: str = "parent", rounds: int = 40) -> DataFrame:
    """(id, root, depth) of every node, by doubling the reach of parent pointers: log2(depth) joins.

    A node whose parent is missing is a root; nodes on a cycle have no row.
    """
    t = Steps(nodes.sparkSession, "paths")
    known = nodes.select(F.col(node).alias("k"))
    j = nodes.select(F.col(node).alias("id"), F.col(parent).alias("up")).join(known, F.col("up") == F.col("k"), "left")
    j = j.select("id", F.coalesce("k", "id").alias("root"), F.when(F.col("k").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.col("k").isNull().alias("done"))
    before = None
    for _ in range(rounds):
        j = t.save(j)
        open_ = j.where("not done").count()
        if open_ in (0, before):
            break
        before = open_
        up = j.select(F.col("id").alias("uid"), F.col("root").alias("uroot"), F.col("depth").alias("udepth"), F.col("done").alias("udone"))
        j = j.join(up, (F.col("root") == F.col("uid")) & ~F.col("done"), "left").select("id", F.coalesce("uroot", "root").alias("root"), (F.col("depth") + F.coalesce("udepth", F.lit(0))).alias("depth"), (F.col("done") | F.coalesce("udone", F.lit(False))).alias("done"))
    return j.where("done").select("id", "root", "depth")
