"""Quality classifier by Bradley-Terry pairwise ranking.

A document's strength is a weighted sum of surface features of its whole text. Pairs (preferred,
rejected) are drawn from labelled rows; the weights minimise the logistic loss of the feature
differences, so only comparisons are learnt, never absolute labels. The decision threshold is a
quantile of the training scores: the one at which the two labels separate best. Scores are mapped
to (0, 1) so that the threshold is at 0.3.

Null and empty texts have all-zero features and get the score of those. Labels that are null, or
other than 0 and 1, take no part. With labels of one kind only, no pair exists: all weights are 0
and every score is on the side of that label. Null ids are not held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

FOLDS = 5
THRESHOLD = 0.3
#: Labelled rows used to fit, at most: the first in the order of a hash of their id.
MAX_LABELLED = 20_000
#: Preference pairs drawn from them.
MAX_PAIRS = 100_000
#: Bytes of a window; a feature's largest value in any window shows junk inside long texts.
WINDOW = 400

_FEATURES = ("log_words", "word_length", "upper", "symbols", "digits", "paired_symbols",
             "bare_symbols", "same_as_previous", "distinct", "top_word", "repeated_lines",
             "top_upper", "top_symbols", "top_digits", "top_paired")


def _classes() -> np.ndarray:
    """Bit flags of each byte: 1 letter, 2 upper case, 4 symbol, 8 digit."""
    flags = np.zeros(256, np.uint8)
    for b in range(256):
        c = chr(b)
        if b >= 128 or c.isalpha():
            flags[b] |= 1
        if b < 128 and c.isupper():
            flags[b] |= 2
        if 32 < b < 127 and not c.isalnum() and c not in ".,;:'\"-()?":
            flags[b] |= 4
        if c.isdigit() and b < 128:
            flags[b] |= 8
    return flags


def features(text: str | None, flags: np.ndarray) -> np.ndarray:
    """The surface features of one text."""
    raw = text.encode() if text else b""
    words = raw.split()
    if not words:
        return np.zeros(len(_FEATURES))
    kind = flags[np.frombuffer(raw, np.uint8)]
    starts = np.arange(0, len(raw), WINDOW)
    # the last window is as long as the others
    if len(starts) > 1:
        starts[-1] = len(raw) - WINDOW
    symbol = (kind & 4) > 0
    paired = symbol.copy()
    paired[1:] &= symbol[:-1]
    paired[0] = False
    rates, tops = [], []
    letters = (kind & 1) > 0
    totals = np.concatenate([[0], np.cumsum(letters)])
    ends = np.minimum(starts + WINDOW, len(raw))
    in_window = totals[ends] - totals[starts] + 16
    for flag in ((kind & 2) > 0, symbol, (kind & 8) > 0, paired):
        sums = np.concatenate([[0], np.cumsum(flag)])
        rates.append(sums[-1] / (totals[-1] + 16))
        tops.append(((sums[ends] - sums[starts]) / in_window).max())
    n = len(words)
    count: dict[bytes, int] = {}
    for w in words:
        count[w] = count.get(w, 0) + 1
    bare = sum(c for w, c in count.items() if len(w) < 4 and not flags[np.frombuffer(w, np.uint8)].any()
               or len(w) < 4 and (flags[np.frombuffer(w, np.uint8)] & 4).all())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return np.array([
        np.log1p(n), min(sum(map(len, words)) / n, 50) / 10, rates[0], rates[1], rates[2], rates[3],
        bare / n, sum(map(eq, words, words[1:])) / n, len(count) / n ** 0.9,
        max(count.values()) / (n + 20), 1 - len(set(lines)) / len(lines), *tops])


def spread(x: np.ndarray) -> np.ndarray:
    """Rates on a scale on which small shares count: x, its root, and whether it is there."""
    return np.hstack([x, np.sqrt(np.abs(x)), np.minimum(np.abs(x) * 20, 1)])


@dataclass(frozen=True)
class Ranker:
    """Centre and scale of the features, their weights, and the score at the threshold."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float

    def strengths(self, x: np.ndarray) -> np.ndarray:
        return np.clip((spread(x) - self.centre) / self.scale, -8, 8) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.strengths(x) - self.threshold) + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def bradley_terry(difference: np.ndarray, penalty: float = 1e-3, steps: int = 40) -> np.ndarray:
    """Weights w that minimise mean log(1 + exp(-w.d)) + penalty/2 |w|^2, by Newton's method."""
    n, k = difference.shape
    w = np.zeros(k)
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(difference @ w, -30, 30)))
        grad = penalty * w - difference.T @ p / n
        hess = (difference * (p * (1 - p))[:, None]).T @ difference / n + penalty * np.eye(k)
        step = np.linalg.solve(hess, grad)
        # damped: a step never moves the mean margin by more than a few units
        step *= min(1.0, 4 / (1e-9 + np.abs(step).max()))
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_ranker(x: np.ndarray, good: np.ndarray, pairs: int = MAX_PAIRS, seed: int = 7) -> Ranker:
    """Learn from features and labels of the same rows."""
    wide = spread(x)
    centre = wide.mean(0) if len(wide) else np.zeros(len(_FEATURES) * 3)
    scale = wide.std(0) + 1e-6 if len(wide) else np.ones(len(_FEATURES) * 3)
    up, down = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(up) or not len(down):
        # nothing to compare: everything gets the only label there is
        return Ranker(centre, scale, np.zeros(len(centre)), 1.0 if len(down) else -1.0, 1.0)
    rng = np.random.default_rng(seed)
    z = np.clip((wide - centre) / scale, -8, 8)
    difference = np.empty((pairs, z.shape[1]), np.float32)
    difference[:] = z[rng.choice(up, pairs)] - z[rng.choice(down, pairs)]
    w = bradley_terry(difference)
    s = z @ w
    # of all quantiles of the scores, the one that separates the labels best
    order = np.argsort(s, kind="stable")
    bad_below = np.concatenate([[0], np.cumsum(~good[order])]) / len(down)
    good_above = 1 - np.concatenate([[0], np.cumsum(good[order])]) / len(up)
    cut = int(np.argmax(bad_below + good_above))
    low = s[order[cut - 1]] if cut else s[order[0]] - 1
    high = s[order[cut]] if cut < len(s) else s[order[-1]] + 1
    return Ranker(centre, scale, w, float((low + high) / 2), float(4 / (s.std() + 1e-9)))


def held_out(id_col: str, folds: int = FOLDS) -> Column:
    fold = F.crc32(F.col(id_col).cast("string")) % folds == 0
    return F.coalesce(fold, F.lit(False))


def _measured(batches: Iterator[pa.RecordBatch], carry: str):
    flags = _classes()
    for batch in slices(batches):
        x = [features(t, flags).tolist() for t in batch.column("text").to_pylist()]
        yield pa.record_batch({carry: batch.column(carry),
                               "x": pa.array(x, pa.list_(pa.float64()))})


def _scored(batches: Iterator[pa.RecordBatch], ranker: Ranker):
    flags = _classes()
    for batch in slices(batches):
        x = np.array([features(t, flags) for t in batch.column("text").to_pylist()])
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"),
                               "score": pa.array(ranker.scores(x.reshape(-1, len(_FEATURES))))})


def labelled_sample(labels: DataFrame, label_col: str, id_col: str, most: int,
                    values: tuple[int, ...] = (0, 1)) -> DataFrame:
    """(id, label) of at most `most` rows outside the held-out fold, as a small table.

    The rows are the first in the order of a hash of the id, so reruns take the same ones.
    """
    rows = (labels.select(F.col(id_col).cast("bigint").alias("_id"),
                          F.col(label_col).cast("int").alias("_label"))
            .filter(F.col("_id").isNotNull() & F.col("_label").isin(*values)).filter(~held_out("_id"))
            .distinct().orderBy(F.xxhash64("_id"), "_id", "_label").limit(most).collect())
    return labels.sparkSession.createDataFrame([tuple(r) for r in rows], "_id bigint, _label int")


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id",
          text_col: str = "text", max_labelled: int = MAX_LABELLED) -> Ranker:
    """Fit on at most `max_labelled` labelled rows whose id is not in the held-out fold."""
    sample = labelled_sample(labels, label_col, id_col, max_labelled)
    # the sample's size is bounded by the parameter
    texts = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("text"))
    found = texts.join(F.broadcast(sample), "_id").select("_label", "text").mapInArrow(
        lambda b: _measured(b, "_label"), "_label int, x array<double>").toArrow()
    good = found.column("_label").to_numpy() == 1
    x = np.array(found.column("x").to_pylist(), float).reshape(-1, len(_FEATURES))
    return fit_ranker(x, good)


def quality_scores(docs: DataFrame, ranker: Ranker, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                       held_out(id_col).alias("held_out"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lambda b: _scored(b, ranker),
                           f"doc_id {kind}, held_out boolean, score double").withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int"))


def accepted(docs: DataFrame, ranker: Ranker, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, that the classifier does not reject."""
    def keep(batches: Iterator[pa.RecordBatch]):
        flags = _classes()
        for batch in slices(batches, text_col):
            x = np.array([features(t, flags) for t in batch.column(text_col).to_pylist()])
            yield batch.filter(pa.array(
                ranker.scores(x.reshape(-1, len(_FEATURES))) >= THRESHOLD))

    return docs.mapInArrow(keep, docs.schema)
