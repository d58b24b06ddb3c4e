"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed over source x language x topic. The cells are raked in turn to
the target shares of each margin until every margin fits; a cell's calibrated weight
divided by its tokens gives the rate at which its documents are wanted. A rate above 1
is a number of epochs: each document of the cell is taken its whole part of times, and
once more by the rest as a probability, with a hash of its id, so a run can be repeated.
Without such copies a cell with too few tokens would leave its margins short.

Targets that contradict each other, or the cells there are, have no such weights: where a
margin doesn't fit after MAX_SWEEPS, the last weights are used and a warning says by
how much it is off.

Defined cases: null source, language or topic is a value of its own; null or wordless
text has no tokens and is never selected; a text of any length counts with all its
tokens; documents of one cell that share a doc_id get the same number of copies; a target for a value without tokens is left
out and the margin's other shares are scaled up; values without a target keep their
natural share among themselves, scaled to what the targets leave; repeated rows are
sampled alike; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import Scratch

SEED = 20240301
MAX_SWEEPS, TOLERANCE = 40, 1e-6
MARGINS = ("source", "lang", "topic")


def n_tokens() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def topic() -> Column:
    """A topic by form: what a document mostly consists of. For tables that name no topics; pass a column where there is one."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return (
        F.when(text.contains("Licensed under") | text.contains("License"), "licence")
        .when(text.contains(" | "), "table")
        .when(F.length(text) < 600, "note")
        .when(F.length(text) < 3000, "article")
        .otherwise("report")
    )


def _targets(cells: DataFrame, margin: str, wanted: dict[str | None, float]) -> Column:
    """Share of all tokens each cell's margin value should have."""
    listed = F.lit(None).cast("double")
    for value, share in wanted.items():
        listed = F.when(F.col(margin).eqNullSafe(F.lit(value)), float(share)).otherwise(listed)
    others = cells.where(listed.isNull()).agg(F.sum("base")).first()[0] or 1.0
    natural = F.sum("base").over(Window.partitionBy(margin)) / F.lit(float(others))
    return F.coalesce(listed, natural * F.lit(max(0.0, 1 - sum(wanted.values()))))


def rake(cells: DataFrame, wanted: dict[str, dict[str | None, float]], scratch: Scratch, margins: tuple[str, ...] = MARGINS, max_sweeps: int = MAX_SWEEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """cells (the margins, tokens) with `weight`: shares of all tokens that fit the wanted margins.

    wanted: for each raked margin the share of some or all of its values.
    """
    cells = cells.where("tokens > 0").withColumn("base", F.col("tokens").cast("double"))
    total = float(cells.agg(F.sum("base")).first()[0] or 1.0)
    raked = [m for m in margins if wanted.get(m)]
    for m in raked:
        cells = cells.withColumn(f"t_{m}", _targets(cells, m, wanted[m]))
    cells = scratch.save(cells.withColumn("weight", F.col("base") / F.lit(total)), "cells")
    for m in raked:  # targets of values that have tokens make up the whole
        had = cells.select(m, f"t_{m}").distinct().agg(F.sum(f"t_{m}")).first()[0]
        cells = cells.withColumn(f"t_{m}", F.col(f"t_{m}") / F.lit(had or 1.0))
    for _ in range(max_sweeps if raked else 0):
        for m in raked:
            cells = cells.withColumn("weight", F.col("weight") * F.coalesce(F.col(f"t_{m}") / F.nullif(F.sum("weight").over(Window.partitionBy(m)), F.lit(0.0)), F.lit(0.0)))
        cells = scratch.save(cells, "cells")
        off = [cells.groupBy(m).agg(F.abs(F.sum("weight") - F.first(f"t_{m}")).alias("off")).agg(F.max("off").alias("off")) for m in raked]
        worst = off[0]
        for x in off[1:]:
            worst = worst.union(x)
        left = worst.agg(F.max("off")).first()[0] or 0.0
        if left <= tolerance:
            break
    else:
        if raked:
            warnings.warn(f"the target shares don't fit the cells: a margin is off by {left:.2g} after {max_sweeps} sweeps", stacklevel=2)
    return cells.select(*margins, "tokens", "weight")


def uniform(seed: int = SEED) -> Column:
    """A number in [0, 1) that depends on doc_id and seed alone."""
    return F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 52)).cast("double") / float(1 << 52)


def _rates(fitted: DataFrame, budget: float) -> DataFrame:
    """The rate at which each cell's documents are wanted: above 1 where it has too few tokens."""
    total = float(fitted.agg(F.sum("tokens")).first()[0] or 0)
    rate = F.lit(budget * total) * F.col("weight") / F.col("tokens")
    return fitted.select(*(F.col(m).alias(f"r_{m}") for m in MARGINS), "weight", rate.alias("rate"))


def _copies(rate: Column, seed: int) -> Column:
    """How often a document is taken: `rate` times on average."""
    whole = F.floor(rate)
    return whole + (uniform(seed) < rate - whole).cast("long")


def mix(docs: DataFrame, wanted: dict[str, dict[str | None, float]], budget: float = 0.5, seed: int = SEED, scratch: Scratch | None = None, topics: Column | None = None) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight, probability, copies, selected of every row of `docs`.

    budget: tokens wanted as a share of all tokens, copies included. topics: the column
    with a document's topic, its form where there is none. probability: of being
    taken at all; where a cell has too few tokens it is 1 and copies make up the weight.
    """
    scratch = scratch or Scratch(docs.sparkSession, "mixing")
    seen = scratch.save(docs.select("doc_id", "source", "lang", (topic() if topics is None else topics).alias("topic"), n_tokens().alias("n_tokens")), "tokens")
    cells = seen.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens"))
    fitted = rake(cells, wanted, scratch)
    rates = scratch.save(_rates(fitted, budget), "rates")
    on = [F.col(m).eqNullSafe(F.col(f"r_{m}")) for m in MARGINS]
    j = seen.join(rates, on[0] & on[1] & on[2], "left")
    rate = F.when(F.col("n_tokens") > 0, F.coalesce("rate", F.lit(0.0))).otherwise(0.0)
    copies = _copies(rate, seed)
    return j.select("doc_id", *MARGINS, "n_tokens", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.least(F.lit(1.0), rate).alias("probability"), copies.alias("copies"), (copies > 0).alias("selected"))


def achieved_shares(mixed: DataFrame, margin: str) -> DataFrame:
    """(value, tokens, share): the drawn tokens of each value of a margin of mix's result, copies included."""
    tokens = F.sum(F.col("n_tokens") * F.col("copies"))
    total = mixed.agg(tokens).first()[0] or 1
    return mixed.groupBy(F.col(margin).alias("value")).agg(tokens.alias("tokens")).withColumn("share", F.col("tokens") / F.lit(total))


def sample_mixture(docs: DataFrame, wanted: dict[str, dict[str | None, float]], budget: float = 0.5, seed: int = SEED, topics: Column | None = None) -> DataFrame:
    """The rows of `docs` that the mixture selects, each as often as it has copies.

    Rows without tokens are left out. The rates of the cells are joined on the margins
    themselves, so rows that share a doc_id are judged each by its own cell.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    named = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", "lang", (topic() if topics is None else topics).alias("topic"), n_tokens().alias("n_tokens"))
    cells = named.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens"))
    rates = scratch.save(_rates(rake(cells, wanted, scratch), budget), "rates").drop("weight")
    on = [F.col(m).eqNullSafe(F.col(f"r_{m}")) for m in MARGINS]
    taken = named.join(rates, on[0] & on[1] & on[2]).where("n_tokens > 0").select("row", _copies(F.col("rate"), seed).alias("copies")).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")
