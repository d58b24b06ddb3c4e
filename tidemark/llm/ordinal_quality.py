"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight for each hashed text feature, shared by all grades, and ordered thresholds:
P(grade > k) = sigmoid(w.x - t_k). Features are the presence of words, of runs of
symbols and of a length class. The fit sees a bounded sample of rated rows, stratified
by grade; fits that leave parts of it out set the probability from which rows are kept. Expected grade and tail probability of every document select the rows.

Defined cases: null or empty text has no features and gets the grade of the thresholds
alone; a text of any length is read whole, within one task; rated rows without a
document, without a grade or with a null id are not learned from; a rating or a row
that repeats counts once, and a document rated twice counts with both grades; with fewer than two
grades every tail probability is 1 for the lowest grade; a probability equal to the
least one is kept; repeated rows each get a result; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text as T
from ._spark import Scratch

BITS = 18
#: Bound of the sample: rated rows of each grade.
PER_GRADE = 2500
#: Share of the sample that must have a feature.
LEAST_SHARE = 0.002
L2, STEPS, RATE = 2e-3, 250, 0.1
#: Parts of the sample, each judged by a fit on the others.
FOLDS = 2
#: Share of the well rated rows that selection keeps, as judged by fits that have not seen them.
KEEP_SHARE = 0.97

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def _features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of each text, all together, and the text of each."""
    data, off = T.utf8(column)
    data = T.LOWER[data]
    found = []
    for kind, salt in ((T.ALNUM, 1), (_SYMBOL, 2)):
        w = T.Words(data, off, kind)
        bucket = T.mix(w.names() + np.uint64(salt)) >> np.uint64(64 - BITS)
        found.append((T.owner(w.first).astype(np.uint64) << np.uint64(BITS)) | bucket)
        if salt == 1:  # how long the text is, so that few words alone don't count against it
            size = np.log2(w.counts() + 1.0).astype(np.uint64)
            bucket = T.mix(size + np.uint64(3 << 32)) >> np.uint64(64 - BITS)
            found.append((np.arange(len(size), dtype=np.uint64) << np.uint64(BITS)) | bucket)
    both = np.unique(np.concatenate(found))
    return (both & np.uint64((1 << BITS) - 1)).astype(np.int32), (both >> np.uint64(BITS)).astype(np.int64)


def _sample_features(batches):
    for b in T.chunks(batches):
        f, doc = _features(b.column("text"))
        at = np.searchsorted(doc, np.arange(b.num_rows + 1))
        yield pa.RecordBatch.from_arrays([b.column("grade"), b.column("fold"), pa.array([f[at[i] : at[i + 1]].tobytes() for i in range(b.num_rows)], pa.binary())], names=["grade", "fold", "features"])


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_ordinal(grade: np.ndarray, features: list[np.ndarray], grades: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds by Adam on the negative log-likelihood."""
    w, cuts = np.zeros(1 << BITS), np.linspace(-1, 1, grades - 1)
    if not len(grade) or grades < 2:
        return w, cuts
    doc = np.repeat(np.arange(len(features)), [len(f) for f in features])
    flat = np.concatenate(features).astype(np.int64)
    often = np.bincount(flat, minlength=1 << BITS) >= LEAST_SHARE * len(grade)
    keep = often[flat]
    doc, flat = doc[keep], flat[keep]
    used, flat = np.unique(flat, return_inverse=True)
    n = len(grade)
    weight = (n / grades) / np.maximum(np.bincount(grade, minlength=grades), 1)[grade]
    # cuts = first, then first plus positive gaps
    p = np.zeros(len(used) + grades - 1)
    p[len(used)] = -1.0
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, STEPS + 1):
        z = np.bincount(doc, p[flat], n) if len(flat) else np.zeros(n)
        gaps = np.exp(p[len(used) + 1 :])
        cut = p[len(used)] + np.concatenate([[0], np.cumsum(gaps)])
        up = np.concatenate([np.ones((n, 1)), _sigmoid(z[:, None] - cut[None]), np.zeros((n, 1))], 1)
        hi, lo = up[np.arange(n), grade], up[np.arange(n), grade + 1]
        like = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi) / like, lo * (1 - lo) / like
        g = np.zeros_like(p)
        dz = -(dhi - dlo) * weight / n
        g[: len(used)] = np.bincount(flat, dz[doc], len(used)) + L2 * p[: len(used)]
        dcut = np.zeros(grades - 1)
        np.add.at(dcut, np.maximum(grade - 1, 0), np.where(grade > 0, dhi, 0) * weight / n)
        np.add.at(dcut, np.minimum(grade, grades - 2), np.where(grade < grades - 1, -dlo, 0) * weight / n)
        g[len(used)] = dcut.sum()
        g[len(used) + 1 :] = [gaps[i] * dcut[i + 1 :].sum() for i in range(grades - 2)]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    w[used] = p[: len(used)]
    return w, p[len(used)] + np.concatenate([[0], np.cumsum(np.exp(p[len(used) + 1 :]))])


@dataclass
class OrdinalModel:
    """weights, thresholds, and for each tail k the probability that KEEP_SHARE of the rows of grade >= k reach unseen."""

    weights: np.ndarray
    cuts: np.ndarray
    least: dict[int, float]


def _first_of_each(rows: DataFrame, by: list[str], per_grade: int, scratch: Scratch) -> DataFrame:
    """The per_grade rows of each grade with the least hashes of `by`, which is unique within a grade.

    A grade's count gives the hash below which some twice per_grade of its rows lie, so only
    those are ranked, and no task sorts a whole grade.
    """
    rows = scratch.save(rows.withColumn("chance", F.xxhash64(F.lit(17), *by)), "rated")
    share = rows.groupBy("grade").agg(F.count("*").alias("n")).select(F.col("grade").alias("of"), ((2 * per_grade + 1000) / F.col("n")).alias("share"))
    near = F.col("chance").cast("double") / F.lit(2.0**64) + 0.5 <= F.col("share")
    few = rows.join(F.broadcast(share), F.col("grade") == F.col("of")).where(near)  # a row for each grade
    first = Window.partitionBy("grade").orderBy("chance", *by)
    return few.withColumn("r", F.row_number().over(first)).where(F.col("r") <= per_grade).select(rows.columns).drop("chance")


def sample_ratings(docs: DataFrame, ratings: DataFrame, grades: int, per_grade: int = PER_GRADE, scratch: Scratch | None = None) -> DataFrame:
    """(grade, fold, text): at most per_grade rated texts of each grade, chosen by a hash, in FOLDS parts by another."""
    scratch = scratch or Scratch(docs.sparkSession, "ratings")
    rated = ratings.where("doc_id is not null and grade is not null").select(F.col("doc_id").alias("rated_id"), F.col("grade").cast("int").alias("grade"))
    rated = rated.where(F.col("grade").between(0, grades - 1)).distinct()
    chosen = scratch.save(_first_of_each(rated, ["rated_id"], per_grade, scratch), "chosen")  # so few that it can be broadcast
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("rated_id"))
    picked = scratch.save(picked.select("grade", "rated_id", F.xxhash64("text").alias("named"), "text"), "picked")
    # documents that share an id are more rows than ratings
    names = scratch.save(_first_of_each(picked.select("grade", "rated_id", "named").distinct(), ["rated_id", "named"], per_grade, scratch), "names")
    picked = picked.join(F.broadcast(names), ["grade", "rated_id", "named"], "left_semi").dropDuplicates(["grade", "rated_id", "text"])
    return picked.select("grade", F.pmod(F.xxhash64(F.lit(23), "rated_id"), F.lit(FOLDS)).cast("int").alias("fold"), "text")


def train(docs: DataFrame, ratings: DataFrame, grades: int, per_grade: int = PER_GRADE) -> OrdinalModel:
    """Fit on at most per_grade rows of each grade of `ratings` (doc_id, grade 0 .. grades - 1).

    The least probabilities are set on rows that the fit has not seen: each of FOLDS parts
    of the sample is judged by a fit on the others. The model itself is fitted on all rows.
    """
    rows = sample_ratings(docs, ratings, grades, per_grade).mapInArrow(_sample_features, "grade int, fold int, features binary").collect()
    rows = sorted(rows, key=tuple)  # the order of arrival must not decide
    grade, fold, features = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), [np.frombuffer(r[2], np.int32) for r in rows]
    unseen = np.full((len(rows), max(grades - 1, 0)), 0.5)
    for k in range(FOLDS):
        rest, own = fold != k, np.flatnonzero(fold == k)
        w, cuts = fit_ordinal(grade[rest], [f for f, r in zip(features, rest, strict=True) if r], grades)
        z = np.array([w[features[i]].sum() for i in own])
        unseen[own] = _sigmoid(z[:, None] - cuts[None]) if len(own) else unseen[own]
    least = {}
    for k in range(1, grades):
        good = unseen[grade >= k, k - 1]
        least[k] = float(np.quantile(good, 1 - KEEP_SHARE)) if len(good) else 0.5
    return OrdinalModel(*fit_ordinal(grade, features, grades), least)


def _score(w: np.ndarray, cuts: np.ndarray, tail: int, least: float):
    def run(batches):
        for b in T.chunks(batches):
            f, doc = _features(b.column("text"))
            z = np.bincount(doc, w[f], b.num_rows)
            up = _sigmoid(z[:, None] - cuts[None]) if len(cuts) else np.zeros((b.num_rows, 0))
            top = up[:, tail - 1] if len(cuts) >= tail else np.ones(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(up.sum(1)), pa.array(top), pa.array(top >= least)], names=["doc_id", "expected_grade", "p_tail", "kept"])

    return run


def grade_documents(docs: DataFrame, model: OrdinalModel, tail: int, least: float | None = None) -> DataFrame:
    """doc_id, expected_grade, p_tail = P(grade >= tail), kept = p_tail >= least (the model's own where None), of every row."""
    run = _score(model.weights, model.cuts, tail, model.least.get(tail, 0.5) if least is None else least)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, expected_grade double, p_tail double, kept boolean")
