"""Names of two sides compared tile by tile, for matches that no selective key can find.

At a threshold of 0.7 two names may be similar and share no rare character, so signatures find far
more pairs than there are names and have to be written. Here the names of a block are dealt into
tiles of bounded size and every pair of tiles is one row of a join: what is shuffled are names,
once for each tile of the other side, and a pair of names exists only in the memory of a task. Left
tiles grow with their block first, so that its names are not copied more often as it grows. The
pairs are as many as ever; two bounds of the ratio, both counted for whole tiles at once, leave few
for the ratio itself: the characters in common, then the longest common subsequence.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .groups import lookup

#: Names of a tile: a task holds one tile of each side.
LEFT_NAMES, RIGHT_NAMES = 1024, 16384
#: The right names of a block are copied for each left tile: left tiles grow up to so many times their
#: size before a block has more of them than this.
LEFT_GROWTH, LEFT_TILES = 8, 16
#: Characters in common are counted exactly for this many tokens, by the smaller side for the rest.
MEASURED_TOKENS = 256
#: Equal names are joined if that settles all names up to this length; else all go through tiles.
_JOINED_LENGTH = 8
#: Left names whose pairs are bounded at once, and pairs of one step of the subsequence.
_STEP_NAMES, _STEP_PAIRS = 64, 65536


def ratio(a: str, b: str) -> float:
    """Ratcliff/Obershelp ratio of two strings (argument order matters)."""
    return SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(T.DoubleType())
def similarity_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff/Obershelp ratio of two strings (argument order matters)."""
    return pd.Series([ratio(x, y) for x, y in zip(a, b)], dtype="float64")


class _Names:
    """The names of one side of a tile, longest first, as numbered characters."""

    def __init__(self, names: list[str]):
        sizes = np.fromiter(map(len, names), np.int64, len(names))
        self.order = np.argsort(-sizes, kind="stable")
        self.names = [names[i] for i in self.order]
        self.sizes = sizes[self.order]
        self.flat = np.frombuffer("".join(self.names).encode("utf-32-le"), "<u4").astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])

    def number(self, alphabet: np.ndarray) -> None:
        """Characters by their place in `alphabet`, and tokens: the n-th of a character is one."""
        self.codes = np.searchsorted(alphabet, self.flat)
        self.owner = np.repeat(np.arange(len(self.names)), self.sizes)
        order = np.lexsort((self.codes, self.owner))
        new = np.ones(len(order), bool)
        new[1:] = ((np.diff(self.codes[order]) != 0) | (np.diff(self.owner[order]) != 0))
        first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        self.tokens = np.empty(len(order), np.int64)
        self.tokens[order] = (np.arange(len(order)) - first) * len(alphabet) + self.codes[order]

    def counted(self, measured: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the measured tokens each name has, and how many of the rest."""
        has = np.zeros((len(self.names), len(measured)), np.float32)
        at = np.searchsorted(measured, self.tokens)
        hit = measured.take(at, mode="clip") == self.tokens if len(measured) else np.zeros(len(at), bool)
        has[self.owner[hit], at[hit]] = 1
        more = np.bincount(self.owner[np.isin(self.tokens, rest)], minlength=len(self.names))
        return has, more.astype(np.float32)

    def columns(self) -> list[np.ndarray]:
        """The n-th characters of all names that have one: names from the longest on."""
        longest = int(self.sizes[0]) if len(self.sizes) else 0
        counts = np.searchsorted(-self.sizes, -np.arange(longest), side="left")
        return [self.codes[self.starts[:n] + j] for j, n in enumerate(counts)]


def _masks(names: _Names, first: int, last: int, letters: int) -> np.ndarray:
    """(word, name * letters + character): the places of each character in names, as bits."""
    words = max(1, -(-int(names.sizes[first]) // 64))
    masks = np.zeros((words, (last - first) * letters), np.uint64)
    span = slice(names.starts[first], names.starts[last])
    place = np.arange(span.start, span.stop) - names.starts[names.owner[span]]
    np.bitwise_or.at(masks, (place // 64, (names.owner[span] - first) * letters + names.codes[span]),
                     np.uint64(1) << (place % 64).astype(np.uint64))
    return masks


def _subsequence(masks: np.ndarray, letters: int, columns: list[np.ndarray], left: np.ndarray,
                 right: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each pair, by bits; `right` ascends."""
    words, base = len(masks), left * letters
    state = np.full((words, len(left)), np.iinfo(np.uint64).max, np.uint64)
    for column in columns:
        # names are longest first, so those that have this character stand in front
        n = int(np.searchsorted(right, len(column)))
        if not n:
            break
        at, carry = base[:n] + column[right[:n]], None
        for w in range(words):
            old = state[w, :n]
            met = old & masks[w].take(at)
            new = old + met
            if words > 1:
                over = new < old
                if carry is not None:
                    new += carry
                    over |= new < carry
                carry = over.astype(np.uint64)
            state[w, :n] = new | (old ^ met)
    return np.bitwise_count(~state).sum(axis=0, dtype=np.int64)


class _Tile:
    """Pairs of left and right names with the bound of their ratio."""

    def __init__(self, left: list[str], right: list[str], threshold: float):
        self.left, self.right, self.threshold = _Names(left), _Names(right), threshold
        alphabet = np.union1d(self.left.flat, self.right.flat)
        self.letters = len(alphabet)
        for side in (self.left, self.right):
            side.number(alphabet)
        shared, counts = self._shared()
        order = np.argsort(-counts, kind="stable")
        measured, rest = np.sort(shared[order[:MEASURED_TOKENS]]), shared[order[MEASURED_TOKENS:]]
        self.has_left, self.more_left = self.left.counted(measured, rest)
        self.has_right, self.more_right = self.right.counted(measured, rest)
        self.columns = self.right.columns()

    def _shared(self) -> tuple[np.ndarray, np.ndarray]:
        a, na = np.unique(self.left.tokens, return_counts=True)
        b, nb = np.unique(self.right.tokens, return_counts=True)
        both, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
        return both, np.minimum(na[ia], nb[ib])

    def steps(self, best: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(first left name, floors, left, right, bound): pairs whose bound reaches the left's floor.

        A floor is the threshold or, for `best`, a ratio that some pair of the left name has.
        """
        sizes = self.right.sizes.astype(np.float32)[:, None]
        for first in range(0, len(self.left.names), _STEP_NAMES):
            last = min(first + _STEP_NAMES, len(self.left.names))
            common = self.has_right @ self.has_left[first:last].T
            if self.more_left[first:last].any():
                common += np.minimum(self.more_right[:, None], self.more_left[None, first:last])
            common *= 2
            common /= sizes + self.left.sizes[first:last].astype(np.float32)[None, :]
            floors = np.full(last - first, self.threshold)
            if best:
                top = common.argmax(axis=0)
                for i, j in enumerate(top):
                    if common[j, i] >= self.threshold - 1e-5:
                        floors[i] = max(floors[i], ratio(self.left.names[first + i], self.right.names[j]))
            # single precision: a little is left open here and decided by the subsequence
            right, left = np.nonzero(common >= (floors - 1e-5).astype(np.float32)[None, :])
            del common
            if not len(left):
                continue
            masks = _masks(self.left, first, last, self.letters)
            bound = np.concatenate([_subsequence(
                masks, self.letters, self.columns, left[k:k + _STEP_PAIRS], right[k:k + _STEP_PAIRS])
                for k in range(0, len(left), _STEP_PAIRS)])
            bound = 2.0 * bound / (self.left.sizes[first + left] + self.right.sizes[right])
            keep = bound >= floors[left]
            yield first, floors, left[keep], right[keep], bound[keep]

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(left, right, bound) of all pairs that can reach the threshold, by their given places."""
        for first, _, left, right, bound in self.steps(False):
            yield self.left.order[first + left], self.right.order[right], bound

    def best(self, seen: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(left, right, ratio) of the best partner of each left name, the smallest `seen` of equals."""
        seen = seen[self.right.order]
        for first, floors, left, right, bound in self.steps(True):
            # the pair of the highest bound raises the floor before all others are put in order
            top = np.zeros(len(floors))
            np.maximum.at(top, left, bound)
            at = np.flatnonzero(bound == top[left])
            _, one = np.unique(left[at], return_index=True)
            for k in at[one]:
                i = left[k]
                floors[i] = max(floors[i], ratio(self.left.names[first + i], self.right.names[right[k]]))
            keep = bound >= floors[left]
            left, right, bound = left[keep], right[keep], bound[keep]
            order = np.lexsort((seen[right], -bound, left))
            cuts = np.flatnonzero(np.diff(left[order], prepend=-1))
            for a, b in zip(cuts, [*cuts[1:], len(order)]):
                name, found = self.left.names[first + left[order[a]]], None
                for k in order[a:b]:
                    if found and (-bound[k], seen[right[k]]) >= (-found[0], found[1]):
                        # what follows with this bound is later, with a smaller one is worse
                        if bound[k] < found[0]:
                            break
                        continue
                    score = ratio(name, self.right.names[right[k]])
                    if score >= self.threshold and (not found or (-score, seen[right[k]]) < (-found[0], found[1])):
                        found = (score, seen[right[k]], k)
                if found:
                    k = found[2]
                    yield int(self.left.order[first + left[k]]), int(self.right.order[right[k]]), found[0]


def _dealt(df: DataFrame, tiles: DataFrame, own: str, other: str, out: str) -> DataFrame:
    """(_pair, out): the rows of each tile as a list, once for each tile of the other side."""
    rows = [c for c in df.columns if c != "_block"]
    placed = lookup(df, tiles, ["_block"], "inner").withColumn(
        "_tile", F.pmod(F.xxhash64("name"), F.col(own)))
    lists = placed.groupBy("_block", "_tile", other).agg(F.collect_list(F.struct(*rows)).alias(out))
    again = lists.withColumn("_again", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other) - 1)))
    mine, theirs = ("_tile", "_again") if own == "_left_tiles" else ("_again", "_tile")
    return again.select(F.struct(F.col("_block"), F.col(mine).alias("l"), F.col(theirs).alias("r")).alias("_pair"), out)


def tile_pairs(left: DataFrame, right: DataFrame, threshold: float, best: bool,
               left_names: int = LEFT_NAMES, right_names: int = RIGHT_NAMES) -> DataFrame:
    """(_block, a, b, seen, score) of names of one block whose ratio can reach the threshold.

    `left` has distinct (_block, name), `right` also `seen`, a number. With `best` one row for each
    left name of a pair of tiles, its best partner, and `score` is their ratio; else all pairs, and
    `score` is the bound of the ratio.

    A name and its partner have at most 2 / threshold times the characters of the name together, and
    at most 1 - threshold of those are not in common. Where that is less than one character, as for all
    but very long names at thresholds close to 1, only the equal name can match: a join finds it.
    """
    reach = threshold / (2 * (1 - threshold)) if threshold < 1 else math.inf
    if reach <= _JOINED_LENGTH:
        return _tiled_pairs(left, right, threshold, best, left_names, right_names)
    equal_only = F.length("name") < reach - 1e-6 if reach < math.inf else F.lit(True)
    # the struct keeps both sides plain shuffles, but would take two null blocks as equal
    key = F.struct("_block", "name")
    equal = left.filter(equal_only & F.col("_block").isNotNull()).select(key.alias("_key")).join(
        right.select(key.alias("_key"), "seen").hint("merge"), "_key").select(
        "_key._block", F.col("_key.name").alias("a"), F.col("_key.name").alias("b"), "seen",
        (similarity_ratio("_key.name", "_key.name") if best else F.lit(1.0)).alias("score"))
    return equal.filter(F.col("score") >= threshold).unionByName(_tiled_pairs(
        left.filter(~equal_only), right, threshold, best, left_names, right_names))


def _tiled_pairs(left: DataFrame, right: DataFrame, threshold: float, best: bool, left_names: int,
                 right_names: int) -> DataFrame:
    """`tile_pairs` by tiles alone."""
    def counted(df: DataFrame, size: Column, out: str) -> DataFrame:
        return df.groupBy("_block").agg(F.ceil(F.count(F.lit(1)) / size).cast("bigint").alias(out))

    grown = F.least(F.count(F.lit(1)) / LEFT_TILES, F.lit(float(left_names * LEFT_GROWTH)))
    tiles = counted(left, F.greatest(F.lit(float(left_names)), grown), "_left_tiles").join(
        counted(right, F.lit(right_names), "_right_tiles"), "_block")
    a = _dealt(left, tiles, "_left_tiles", "_right_tiles", "_as")
    b = _dealt(right, tiles, "_right_tiles", "_left_tiles", "_bs")
    block, seen = left.schema["_block"].dataType, right.schema["seen"].dataType
    schema = T.StructType([T.StructField("_block", block), T.StructField("a", T.StringType()),
                           T.StructField("b", T.StringType()), T.StructField("seen", seen),
                           T.StructField("score", T.DoubleType())])
    pairs = a.join(b.hint("merge"), "_pair").select("_pair._block", "_as", "_bs")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [batch.schema.field("_block").type, pa.string(), pa.string(),
                     batch.schema.field("_bs").type.value_type.field("seen").type, pa.float64()]
            for i in range(batch.num_rows):
                xs, ys = batch.column("_as")[i].values, batch.column("_bs")[i].values
                names, others = xs.field("name").to_pylist(), ys.field("name").to_pylist()
                numbers = ys.field("seen")
                tile, where = _Tile(names, others, threshold), batch.column("_block")[i].as_py()
                if best:
                    found = list(tile.best(numbers.to_numpy(zero_copy_only=False)))
                    chunks = [tuple(zip(*found))] if found else []
                else:
                    chunks = ((x.tolist(), y.tolist(), s.tolist()) for x, y, s in tile.pairs())
                for x, y, scores in chunks:
                    columns = ([where] * len(x), [names[k] for k in x], [others[k] for k in y],
                               numbers.take(pa.array(y, pa.int64())), scores)
                    yield pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, k)
                                           for c, k in zip(columns, kinds)], names=schema.names)

    return pairs.mapInArrow(compared, schema)
