r"""Chat formatting of reply trees.

Messages (tree, id, parent, role, text, score) form trees. Iterative self-joins double
the reach of every message's ancestor pointer, so a path of length d takes log2(d)
joins; branches are ranked by the sum of their scores; each chosen root-to-leaf path
becomes one conversation.

Template: `<s>` opens a conversation; then `<<SYS>> t <</SYS>>`, `[INST] t [/INST]`,
` t </s>` (assistant) or `[ROLE]role[SEP] t [/ROLE]` (any other role) per turn. Inside
texts a control string gets one more backslash behind its first character than it
has, so reading takes exactly one away.

Defined cases: null text or role reads as empty; a null tree is a tree of its own;
messages whose parent is missing are roots; messages on or under a cycle have no root
and are left out; of messages that repeat (tree, id) one is used; ties in score go to
the longer path, then the smaller leaf. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import Scratch

CONTROLS = r"/?s>|<SYS>>|</SYS>>|/?INST\]|/?ROLE\]|SEP\]"
_ESCAPE = re.compile(rf"([\[<])(\\*)({CONTROLS})")
_UNESCAPE = re.compile(rf"([\[<])(\\*)\\({CONTROLS})")
_FRAMES = {"system": ("<<SYS>> ", " <</SYS>>"), "user": ("[INST] ", " [/INST]"), "assistant": (" ", " </s>")}


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\2\\\3", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of it that count for the loss (assistant texts)."""
    parts, mask, at = ["<s>"], [], 3
    for role, text in turns:
        before, after = _FRAMES.get(role) or (f"[ROLE]{escape(role)}[SEP] ", " [/ROLE]")
        body = escape(text)
        if role == "assistant":
            mask.append((at + len(before), at + len(before) + len(body)))
        parts += [before, body, after]
        at += len(before) + len(body) + len(after)
    return "".join(parts), mask


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    if not formatted.startswith("<s>"):
        raise ValueError("not a formatted conversation")
    turns, at = [], 3
    while at < len(formatted):
        role = "assistant"
        for r, opening in (("system", "<<SYS>> "), ("user", "[INST] "), (None, "[ROLE]")):
            if formatted.startswith(opening, at):
                role = r
                break
        if role is None:
            mid = formatted.index("[SEP] ", at)
            end = formatted.index(" [/ROLE]", mid)
            turns.append((unescape(formatted[at + 6 : mid]), unescape(formatted[mid + 6 : end])))
            at = end + 8
            continue
        before, after = _FRAMES[role]
        end = formatted.index(after, at + len(before))
        turns.append((role, unescape(formatted[at + len(before) : end])))
        at = end + len(after)
    return turns


def branch_paths(messages: DataFrame, top: int | None = 1, scratch: Scratch | None = None) -> DataFrame:
    """(tree, leaf, rank, path_score, seq, role, text): the messages of the chosen paths.

    top: branches to take of each tree by score, None for all of them.
    """
    scratch = scratch or Scratch(messages.sparkSession, "reply-trees")
    m = messages.select("tree", "id", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    m = scratch.save(m.where("id is not null").dropDuplicates(["tree", "id"]).withColumn("key", F.struct("tree", "id")), "messages")
    # the tables compress well, so their files say little about their size: no join may send one side to all executors
    known = m.select(F.col("tree").alias("kt"), F.col("id").alias("ki")).hint("merge")
    first = m.select("tree", "id", "parent", "score").join(known, F.col("tree").eqNullSafe(F.col("kt")) & (F.col("parent") == F.col("ki")), "left").select("tree", "id", F.col("ki").alias("anc"), F.lit(1).cast("long").alias("steps"), F.col("score").alias("sum"))
    first = scratch.save(first, "jump")
    # sum: scores from a message up to, not including, anc; messages that have reached their root leave the rounds
    rooted, jump = first.where("anc is null").drop("anc"), first.where("anc is not null")
    jumps, left = [], jump.count()
    while left:
        jumps.append(jump)
        up = jump.unionByName(rooted.withColumn("anc", F.lit(None).cast(jump.schema["anc"].dataType)))
        up = up.select(F.col("tree").alias("ut"), F.col("id").alias("ui"), F.col("anc").alias("uanc"), F.col("steps").alias("usteps"), F.col("sum").alias("usum")).hint("merge")
        on = F.col("tree").eqNullSafe(F.col("ut")) & (F.col("anc") == F.col("ui"))
        # a message whose ancestor is on a cycle finds it among the open ones for ever
        nxt = jump.join(up, on).select("tree", "id", F.col("uanc").alias("anc"), (F.col("steps") + F.col("usteps")).alias("steps"), (F.col("sum") + F.col("usum")).alias("sum"))
        nxt = scratch.save(nxt, "jump")
        rooted, jump = rooted.unionByName(nxt.where("anc is null").drop("anc")), nxt.where("anc is not null")
        before, left = left, jump.count()
        if left == before:  # only cycles are left
            break
    rooted = rooted.select("tree", "id", F.col("steps").alias("depth"), F.col("sum").alias("path_score"))
    inner = first.where("anc is not null").select(F.col("tree").alias("pt"), F.col("anc").alias("pi")).distinct().hint("merge")
    leaves = rooted.join(inner, F.col("tree").eqNullSafe(F.col("pt")) & (F.col("id") == F.col("pi")), "left_anti")
    order = Window.partitionBy("tree").orderBy(F.desc("path_score"), F.desc("depth"), "id")
    leaves = leaves.withColumn("rank", F.row_number().over(order).cast("long"))
    leaves = leaves.where(F.col("rank") <= top) if top is not None else leaves
    path = leaves.select("tree", F.col("id").alias("leaf"), "rank", "path_score", "depth", F.lit(0).cast("long").alias("off"), "id")
    path = scratch.save(path, "path")
    for k in range(len(jumps) - 1, -1, -1):
        j = jumps[k].select(F.col("tree").alias("jt"), F.col("id").alias("ji"), "anc").hint("merge")
        more = path.join(j, F.col("tree").eqNullSafe(F.col("jt")) & (F.col("id") == F.col("ji"))).select("tree", "leaf", "rank", "path_score", "depth", (F.col("off") + 2**k).alias("off"), F.col("anc").alias("id"))
        path = scratch.save(path.union(more), "path")
    text = m.select(F.col("tree").alias("mt"), F.col("id").alias("mi"), "role", "text").hint("merge")
    return path.join(text, F.col("tree").eqNullSafe(F.col("mt")) & (F.col("id") == F.col("mi"))).select("tree", "leaf", "rank", "path_score", (F.col("depth") - F.col("off")).alias("seq"), "role", "text")


def _render(batches):
    for b in batches:
        out = [render([(t["role"], t["text"]) for t in turns]) for turns in b.column("turns").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("tree", "leaf", "rank", "path_score")), pa.array([x[0] for x in out], pa.string()), pa.array([[list(s) for s in x[1]] for x in out], pa.list_(pa.list_(pa.int64())))], names=["tree", "leaf", "rank", "path_score", "formatted", "loss_spans"])


def format_trees(messages: DataFrame, top: int | None = 1, scratch: Scratch | None = None) -> DataFrame:
    """(tree, leaf, rank, path_score, formatted, loss_spans): one row for each chosen path."""
    rows = branch_paths(messages, top, scratch).groupBy("tree", "leaf", "rank", "path_score").agg(F.sort_array(F.collect_list(F.struct("seq", "role", "text"))).alias("turns"))
    kind = rows.schema
    return rows.mapInArrow(_render, f"tree {kind['tree'].dataType.simpleString()}, leaf {kind['leaf'].dataType.simpleString()}, rank long, path_score double, formatted string, loss_spans array<array<bigint>>")


def chain_messages(conversations: DataFrame) -> DataFrame:
    """Messages of plain conversations (conv_id, turn, role, text): each row answers the one before it.

    Rows go by turn (null first), then role, then text.
    """
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    n = F.row_number().over(order).cast("long")
    return conversations.select(F.col("conv_id").alias("tree"), n.alias("id"), (n - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score"))


def _digest(batches):
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
    for b in batches:
        rows = []
        for text, spans in zip(b.column("formatted").to_pylist(), b.column("loss_spans").to_pylist(), strict=True):
            turns = read_back(text)
            loss = "".join(unescape(text[a:z]) for a, z in spans)
            rows.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([b.column("tree"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_back_digests(formatted: DataFrame) -> DataFrame:
    """What reading the formatted conversations back gives, as digests."""
    return formatted.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
