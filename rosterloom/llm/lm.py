"""Language-model scoring by cross-entropy difference.

Two n-gram models over characters share one vocabulary (the characters of the corpus), one order
and one smoothing: the target model counts the labelled good documents, the background model counts
all documents. The n-grams themselves are the keys, of every order, at every corpus size: counts are
exact, no two n-grams share one, and the models are a written table that grows with the corpus.
Probabilities of rising order are mixed with fixed weights, from the uniform distribution over the
vocabulary up.

Texts are dealt into blocks of a bounded size; a block's distinct n-grams are joined to the models,
and its texts are scored with the counts that come back. So no task holds more of a model than the
texts of one block can ask for, and the driver gets a single row of totals.

A document's losses are its mean negative log probabilities per character under either model; the
score is target loss minus background loss, lower for texts closer to the target. A document never
scores itself: its own n-grams are taken off the counts of the models that hold them, so a good
document is not good because it was counted as good.

Null and empty texts have no characters: losses and score are 0. Without target documents the
target model is uniform. Labels with null ids or values take no part; rows with equal ids are
labelled alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import slices

ORDER = 4
#: Weight of an order's own estimate against the lower orders'.
TRUST = 0.7
#: Bytes of text in a block on average, and of texts whose n-grams are numbered at a time.
BLOCK, SLICE = 8 << 20, 2 << 20


class Grams:
    """The distinct n-grams of some texts, numbered by order.

    Texts are laid end to end, each after `order` zeros that stand for its beginning. `numbers[k]`
    holds for every place the number of the (k+1)-gram that ends there, exact from the last zero
    before a text on; `keys[k]` maps numbers to n-grams (UTF-8), empty where no such place has one.
    """

    def __init__(self, texts: list[str | None], order: int):
        parts = [np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        self.lengths = np.array([len(p) for p in parts], np.int64)
        self.starts = np.cumsum([0, *(self.lengths + order)])
        codes = np.zeros(self.starts[-1], np.uint32)
        #: True at characters, False at the zeros before each text.
        self.real = np.ones(len(codes), bool)
        for p, at in zip(parts, self.starts):
            codes[at + order:at + order + len(p)] = p
            self.real[at:at + order] = False
        asked = self.real.copy()
        asked[self.starts[:-1] + order - 1] = True
        asked = np.flatnonzero(asked)
        laid = codes.tobytes().decode("utf-32-le", "surrogatepass")
        letters, size = _numbered(codes.astype(np.int64))
        self.numbers, self.keys = [], []
        number, n = letters, size
        for k in range(1, order + 1):
            if k > 1:
                longer = np.zeros(len(codes), np.int64)
                longer[1:] = number[:-1]
                number, n = _numbered(longer * size + letters)
            place = np.full(n, -1, np.int64)
            place[number[asked]] = asked
            self.numbers.append(number)
            self.keys.append([laid[i - k + 1:i + 1].encode("utf-8", "surrogatepass") if i >= 0 else b""
                              for i in place.tolist()])


def _numbered(values: np.ndarray) -> tuple[np.ndarray, int]:
    """Each value's rank among the distinct ones, and their number."""
    top = int(values.max(initial=-1)) + 1
    if top <= 8 * len(values) + (1 << 16):
        seen = np.zeros(top, bool)
        seen[values] = True
        rank = np.cumsum(seen, dtype=np.int32)
        return (rank - 1)[values], int(rank[-1]) if top else 0
    distinct, rank = np.unique(values, return_inverse=True)
    return rank.astype(np.int32), len(distinct)


def _counted(batches: Iterator[pa.RecordBatch], order: int):
    for batch in slices(batches, limit=SLICE):
        good = batch.column("good").to_numpy(zero_copy_only=False)
        grams = Grams(batch.column("text").to_pylist(), order)
        chosen = grams.real & np.repeat(good, np.diff(grams.starts))
        for k, (number, keys) in enumerate(zip(grams.numbers, grams.keys)):
            all_ = np.bincount(number[grams.real], minlength=len(keys))
            target = np.bincount(number[chosen], minlength=len(keys))
            used = np.flatnonzero(all_)
            for i in range(0, len(used), 50_000):
                part = used[i:i + 50_000]
                yield pa.record_batch({
                    "n": pa.array(np.full(len(part), k + 1, np.int32)),
                    "gram": pa.array([keys[j] for j in part.tolist()], pa.binary()),
                    "background": pa.array(all_[part], pa.int64()),
                    "target": pa.array(target[part], pa.int64())})


def _asked(block: pa.Table, order: int) -> pa.Table:
    """The distinct n-grams whose counts the texts of a block need."""
    found: set[bytes] = set()
    for batch in slices(block.to_batches(), limit=SLICE):
        found.update(*Grams(batch.column("text").to_pylist(), order).keys)
    found.discard(b"")
    return pa.table({"block": pa.repeat(block.column("block")[0], len(found)),
                     "gram": pa.array(sorted(found), pa.binary())})


def losses(texts: list[str | None], row: dict[bytes, int], models: list[np.ndarray],
           totals: list[int], vocabulary: int, order: int, trust: float = TRUST,
           held: np.ndarray | None = None) -> np.ndarray:
    """Mean loss per character of each text (rows) under each model (columns); 0 without any.

    `models` hold the counts of n-grams by `row`, and a 0 in the end for all others; `totals` the
    characters a model has counted. Where `held` (texts by models) is true, the model has counted
    the text itself, whose n-grams are taken off.
    """
    grams = Grams(texts, order)
    owner = np.repeat(np.arange(len(texts)), grams.lengths)
    text = np.repeat(np.arange(len(texts)), np.diff(grams.starts))
    if held is None:
        held = np.zeros((len(texts), len(models)), bool)
    # how often each place's n-gram occurs in its own text
    own_counts = [_within(grams.starts, number, grams.real) for number in grams.numbers]
    rows = [np.fromiter((row.get(key, -1) for key in keys), np.int64, len(keys)) for keys in grams.keys]
    out = np.zeros((len(texts), len(models)))
    for m, counts in enumerate(models):
        p = np.full(len(grams.real), 1 / max(vocabulary, 1))
        mine = held[text, m]
        some = mine.any()
        context = np.full(len(p), float(totals[m]))
        if some:
            context -= mine * grams.lengths[text]
        for k in range(order):
            own = counts[rows[k]][grams.numbers[k]]
            if some:
                own = own - (own_counts[k] if mine.all() else mine * own_counts[k])
            share = np.divide(own, context, out=np.zeros(len(p)), where=context > 0)
            # an unseen context leaves the lower orders' estimate as it is
            p = np.where(context > 0, trust * np.minimum(share, 1) + (1 - trust) * p, p)
            context = np.concatenate([np.zeros(1), own[:-1]])
        out[:, m] = np.bincount(owner, -np.log(p[grams.real]), len(texts)) / np.maximum(grams.lengths, 1)
    return out


def _within(starts: np.ndarray, number: np.ndarray, real: np.ndarray) -> np.ndarray:
    """For each place how many characters of its text end the same n-gram."""
    out = np.empty(len(number), np.int64)
    # one table for all texts, cleared where a text has used it
    seen = np.zeros(int(number.max(initial=0)) + 1, np.int64)
    for start, stop in zip(starts[:-1].tolist(), starts[1:].tolist()):
        own = number[start:stop]
        np.add.at(seen, own[real[start:stop]], 1)
        out[start:stop] = seen[own]
        seen[own] = 0
    return out


def _marked(docs: DataFrame, good_ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, good) of each row."""
    good = good_ids.select(F.col(good_ids.columns[0]).cast("bigint").alias("_good")).dropna().distinct()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # the same plan at every size: labels grow with the documents
    return texts.join(good.hint("merge"), F.col("doc_id").cast("bigint") == F.col("_good"), "left").select(
        "doc_id", "text", F.col("_good").isNotNull().alias("good"))


def train(docs: DataFrame, good_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          order: int = ORDER) -> DataFrame:
    """(n, gram, background, target): how often each n-gram is in all and in the target documents.

    `good_ids` holds the target documents' ids in its first column.
    """
    return _counts(_marked(docs, good_ids, id_col, text_col), order)


def _counts(marked: DataFrame, order: int) -> DataFrame:
    return (marked.select("text", "good").mapInArrow(lambda b: _counted(b, order),
                              "n int, gram binary, background bigint, target bigint")
            .groupBy("n", "gram").agg(F.sum("background").alias("background"),
                                      F.sum("target").alias("target")))


def cross_entropy_difference(docs: DataFrame, good_ids: DataFrame, id_col: str = "doc_id",
                             text_col: str = "text", order: int = ORDER) -> DataFrame:
    """(doc_id, n_chars, target_loss, background_loss, score) for each row."""
    held = docs.agg(F.sum(F.octet_length(text_col)).alias("bytes")).first()["bytes"] or 0
    blocks = -(-held // BLOCK) or 1
    # dealt by a written row number: equal rows go to different blocks
    dealt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).alias("block")
    rows = cut_lineage(_marked(docs, good_ids, id_col, text_col).select(dealt, "*"), "lm-texts")
    model = cut_lineage(_counts(rows, order), "lm")
    whole = model.filter("n = 1").agg(
        F.count(F.lit(1)).alias("vocabulary"), F.coalesce(F.sum("target"), F.lit(0)).alias("target"),
        F.coalesce(F.sum("background"), F.lit(0)).alias("background")).first()
    vocabulary, totals = whole["vocabulary"], [whole["target"], whole["background"]]
    # a task a block, or a few blocks: never more of them the more text there is
    rows = rows.repartition(int(max(blocks, 1)), "block")
    kind = rows.schema["doc_id"].dataType.simpleString()
    asked = rows.groupBy("block").applyInArrow(lambda t: _asked(t, order), "block bigint, gram binary")
    counts = asked.join(model.select("gram", "target", "background").hint("merge"), "gram")

    def scored(texts: pa.Table, known: pa.Table) -> pa.Table:
        row = {key: i for i, key in enumerate(known.column("gram").to_pylist())}
        models = [np.append(known.column(c).to_numpy(), 0).astype(np.float64)
                  for c in ("target", "background")]
        out = []
        for batch in slices(texts.to_batches(), limit=SLICE):
            said = batch.column("text").to_pylist()
            good = batch.column("good").to_numpy(zero_copy_only=False)
            counted = np.column_stack([good, np.ones(len(said), bool)])
            loss = losses(said, row, models, totals, vocabulary, order, held=counted)
            out.append(pa.record_batch({
                "doc_id": batch.column("doc_id"),
                "n_chars": pa.array([len(t or "") for t in said], pa.int64()),
                "target_loss": pa.array(loss[:, 0]), "background_loss": pa.array(loss[:, 1]),
                "score": pa.array(loss[:, 0] - loss[:, 1])}))
        return pa.Table.from_batches(out, None if out else pa.schema([
            ("doc_id", texts.schema.field("doc_id").type), ("n_chars", pa.int64()),
            *((c, pa.float64()) for c in ("target_loss", "background_loss", "score"))]))

    return rows.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(
        scored, f"doc_id {kind}, n_chars bigint, target_loss double, background_loss double, "
                "score double")
