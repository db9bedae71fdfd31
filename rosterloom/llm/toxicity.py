"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

A text has a severity grade 0 (clean) to G-1. With w shared by all thresholds,
P(grade >= k) = sigmoid(w.x - t_k) for t_1 < t_2 < ...; x marks which of the model's terms occur
in the whole text. The output is the expected severity, sum over k of P(grade >= k).

Grades come from the labels (a column with 0..G-1), or from 0/1 labels: then the number of
different terms typical of label 1 cuts those rows into mild, moderate and severe. A term is
typical when its rates differ between the labels by more than chance allows for so many terms,
near copies counted once.

Null, empty and word-free texts have no terms: their severity is that of a text without evidence.
Rows with null labels or ids take no part in the fit. Without two kinds of labels no term is
typical and every text gets the same severity (0 if no row is toxic).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.groups import lookup
from ..session import cut_lineage
from .common import slices
from .ranking import held_out, labelled_sample

#: Labelled rows used to fit, at most.
MAX_LABELLED = 20_000
#: Different typical terms from which a toxic text counts as moderate, and as severe.
MODERATE, SEVERE = 3, 5
#: Chance that any term of the sample is taken for typical without being it, and how much more
#: often a typical term must occur in toxic texts.
CHANCE, MIN_ODDS = 0.01, 8
#: Terms of a model, at most.
MAX_TERMS = 50_000
#: P(grade >= 1) from which a text counts as toxic.
TOXIC_AT = 0.1

_TERM = re.compile(r"[^\W\d_]+")


def terms(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's lower-case runs of letters."""
    found = {*_TERM.findall(text.lower())} if text else ()
    return np.sort(np.fromiter((xxhash.xxh64_intdigest(t.encode()) for t in found), np.uint64,
                               len(found)))


@dataclass(frozen=True)
class OrdinalModel:
    """Sorted term hashes, a weight for each, and the increasing thresholds."""

    vocabulary: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def evidence(self, found: np.ndarray) -> float:
        if not len(self.vocabulary) or not len(found):
            return 0.0
        at = np.minimum(np.searchsorted(self.vocabulary, found), len(self.vocabulary) - 1)
        return float(self.weights[at[self.vocabulary[at] == found]].sum())

    def at_least(self, evidence: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..., a row for each text."""
        z = evidence[:, None] - self.thresholds[None, :]
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def cumulative_link(rows: np.ndarray, columns: np.ndarray, shape: tuple[int, int],
                    grade: np.ndarray, grades: int, penalty: float = 0.02,
                    steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by gradient descent with momentum on the penalised likelihood.

    (rows, columns) are the places of the ones in the sparse matrix of features. Thresholds are
    kept apart by writing each as the one before plus the exponential of a free number.
    """
    n, k = shape
    w = np.zeros(k)
    share = np.array([(np.sum(grade >= g) + 0.5) / (n + 1) for g in range(1, grades)])
    t = np.log((1 - share) / share)
    gaps = np.log(np.maximum(np.diff(t), 0.05))
    free = np.concatenate([t[:1], gaps])
    mean_w, var_w = np.zeros(k), np.zeros(k)
    mean_t, var_t = np.zeros(grades - 1), np.zeros(grades - 1)
    picked = np.arange(n)
    for step in range(1, steps + 1):
        t = free[0] + np.concatenate([[0], np.cumsum(np.exp(free[1:]))])
        edge = np.concatenate([[-np.inf], t, [np.inf]])
        s = np.bincount(rows, w[columns], n)
        low, high = edge[grade] - s, edge[grade + 1] - s
        cdf_low, cdf_high = _sigmoid(low), _sigmoid(high)
        mass = np.maximum(cdf_high - cdf_low, 1e-12)
        d_low, d_high = cdf_low * (1 - cdf_low), cdf_high * (1 - cdf_high)
        by_score = (d_high - d_low) / mass  # of the negative log likelihood, by s
        grad_w = np.bincount(columns, by_score[rows], k) / n + penalty * w / max(n, 1)
        by_t = np.zeros(grades + 1)
        np.add.at(by_t, grade[picked], d_low / mass)
        np.add.at(by_t, grade[picked] + 1, -d_high / mass)
        by_t = by_t[1:-1] / n
        tail = np.cumsum(by_t[::-1])[::-1]
        grad_t = np.concatenate([tail[:1], tail[1:] * np.exp(free[1:])])
        rate = 0.2 * (1 - step / (steps + 1)) + 0.01
        for value, grad, mean, var in ((w, grad_w, mean_w, var_w), (free, grad_t, mean_t, var_t)):
            mean += 0.1 * (grad - mean)
            var += 0.01 * (grad * grad - var)
            value -= rate * (mean / (1 - 0.9 ** step)) / (
                np.sqrt(var / (1 - 0.99 ** step)) + 1e-8)
    return w, free[0] + np.concatenate([[0], np.cumsum(np.exp(free[1:]))])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _found(batches: Iterator[pa.RecordBatch]):
    for batch in slices(batches):
        found = [terms(t).view(np.int64) for t in batch.column("text").to_pylist()]
        yield pa.record_batch({
            "label": batch.column("label"), "terms": pa.array(found, pa.list_(pa.int64())),
            # most near copies share their three smallest hashes, which different texts hardly do
            "copy_of": pa.array([f[:3] for f in found], pa.list_(pa.int64()))})


def _log_chance(k: Column, n: Column, rate: Column) -> Column:
    """Log likelihood of k texts out of n holding a term of this rate."""
    rate = F.least(F.greatest(rate, F.lit(1e-12)), F.lit(1 - 1e-12))
    return k * F.log(rate) + (n - k) * F.log1p(-rate)


def typical_terms(rows: DataFrame) -> DataFrame:
    """(term, gain) of the at most MAX_TERMS terms typical of labels above 0, copies counted once.

    `gain` is the likelihood ratio, in nats, of two rates of the term against one. Counted by Spark:
    the number of different terms has no bound.
    """
    size = rows.groupBy("copy_of").agg((F.lit(1.0) / F.count(F.lit(1))).alias("share"))
    shared = lookup(rows, size, ["copy_of"]).withColumns({
        "toxic": F.when(F.col("label") > 0, F.col("share")).otherwise(0.0),
        "clean": F.when(F.col("label") > 0, 0.0).otherwise(F.col("share"))})
    total = shared.agg(F.sum("toxic").alias("n1"), F.sum("clean").alias("n0")).first()
    n1, n0 = F.lit(float(total["n1"])), F.lit(float(total["n0"]))
    counts = cut_lineage(shared.select(F.explode("terms").alias("term"), "toxic", "clean").groupBy("term").agg(
        F.sum("toxic").alias("k1"), F.sum("clean").alias("k0")), "toxicity")
    k1, k0 = F.col("k1"), F.col("k0")
    one = (k1 + k0) / (n1 + n0)
    gain = (_log_chance(k1, n1, k1 / n1) - _log_chance(k1, n1, one)
            + _log_chance(k0, n0, k0 / n0) - _log_chance(k0, n0, one))
    # only terms that say a text is toxic: one that says the contrary would excuse insults
    enough = float(np.log(max(counts.count(), 1) / CHANCE))
    return counts.select("term", gain.alias("gain"), (k1 * n0 > MIN_ODDS * k0 * n1).alias("up")).filter(
        (F.col("gain") >= enough) & F.col("up")).orderBy(F.desc("gain"), "term").limit(MAX_TERMS).select(
        "term", "gain")


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id",
          text_col: str = "text", max_labelled: int = MAX_LABELLED,
          grades: int | None = None) -> OrdinalModel:
    """Fit on at most `max_labelled` labelled rows outside the held-out fold.

    Labels are 0/1, or grades 0..`grades`-1. The driver gets the typical terms of these rows and
    which row holds which of them, never the texts' other terms.
    """
    sample = labelled_sample(labels, label_col, id_col, max_labelled, tuple(range(grades or 2)))
    # the sample's size is bounded by the parameter
    texts = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("text"))
    rows = cut_lineage(texts.join(F.broadcast(sample), "_id").select(
        F.col("_label").alias("label"), "text").mapInArrow(
        _found, "label int, terms array<bigint>, copy_of array<bigint>").withColumn(
        "row", F.monotonically_increasing_id()), "toxicity")
    kinds = {r[0] > 0 for r in rows.select("label").distinct().collect()}
    if kinds != {False, True}:
        far = np.arange(30.0, 30.0 + (grades or 4) - 1)
        return OrdinalModel(np.empty(0, np.uint64), np.empty(0), -far[::-1] if True in kinds else far)
    words = typical_terms(rows).toArrow()
    order = np.argsort(words.column("term").to_numpy().view(np.uint64))
    vocabulary = words.column("term").to_numpy().view(np.uint64)[order]
    known = docs.sparkSession.createDataFrame(
        [(int(t),) for t in vocabulary.view(np.int64)], "term bigint")
    label_of = rows.select("row", "label").toArrow()
    ids = label_of.column("row").to_numpy()
    label = label_of.column("label").to_numpy().astype(np.int64)
    by_id = np.argsort(ids)
    ids, label = ids[by_id], label[by_id]
    # at most MAX_TERMS rows on the small side
    held = rows.select("row", F.explode("terms").alias("term")).join(
        F.broadcast(known), "term").select("row", "term").toArrow()
    at_row = np.searchsorted(ids, held.column("row").to_numpy())
    at_term = np.searchsorted(vocabulary, held.column("term").to_numpy().view(np.uint64))
    if grades is None:
        count = np.bincount(at_row, minlength=len(ids))
        grade = np.where(label > 0, 1 + (count >= MODERATE) + (count >= SEVERE), 0)
    else:
        grade = label
    weights, thresholds = cumulative_link(at_row, at_term, (len(ids), len(vocabulary)), grade, grades or 4)
    return OrdinalModel(vocabulary, weights, thresholds)


def severity(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, expected_severity, grade, toxic) for each row.

    `grade` is the highest k with P(grade >= k) >= 0.5; `toxic` is P(grade >= 1) >= TOXIC_AT.
    """
    def scored(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches):
            at_least = model.at_least(np.array(
                [model.evidence(terms(t)) for t in batch.column("text").to_pylist()], float))
            grade = (at_least >= 0.5).sum(1)
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"),
                "expected_severity": pa.array(at_least.sum(1)),
                "grade": pa.array(grade, pa.int32()),
                "toxic": pa.array(at_least[:, 0] >= TOXIC_AT, pa.bool_())})

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                       held_out(id_col).alias("held_out"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scored, f"doc_id {kind}, held_out boolean, expected_severity double, "
                                   "grade int, toxic boolean")
