"""Near-duplicate vectors by PCA-ordered tiled comparison.

Unit vectors are turned so that their leading components carry most of the variance (the turn is
fitted on a bounded sample and is exact for every vector: it keeps all products). Vectors of one
label are dealt into tiles of bounded size, and each pair of tiles is one task. There the products
of the leading components are summed first; the product of the norms of what is left bounds the
rest, and a pair is given up as soon as sum plus bound cannot reach the threshold. Pairs that reach
the end are links if the cosine of the original vectors, in double precision, is large enough.

A task returns for each vector its number of links and the smallest vector it is connected with
inside the task, never the pairs; equal vectors are one node with a multiplicity. So a group of
thousands of copies costs one row a copy.

Vectors that are null, zero, or hold null or non-finite components, and rows with a null label,
are linked with nothing. Vectors of different lengths are not linked. Rows with a null id have no
links and a null component; rows with equal ids are different vectors with one id: links are
counted and followed by vector, the id only names the component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.groups import lookup
from ..session import cut_lineage
from .graph import components
from .topk import finite

#: Vectors of a tile, on average; vectors the turn is fitted on, at most.
TILE, SAMPLE = 2048, 4096
#: Rounding that the bounds must leave room for.
SLACK = 1e-9
_ROWS, _PAIRS = 256, 1 << 16


def turns(sample: list[np.ndarray]) -> dict[int, np.ndarray]:
    """For each length of vector its principal axes, the one of largest variance first."""
    out = {}
    for width in {len(v) for v in sample}:
        rows = np.array([v for v in sample if len(v) == width], float)
        norms = np.linalg.norm(rows, axis=1)
        rows = rows[norms > 0] / norms[norms > 0][:, None]
        if len(rows) > 1:
            out[width] = np.linalg.eigh(rows.T @ rows)[1][:, ::-1]
    return out


def steps(width: int) -> list[int]:
    """Where the summing stops to look: 8, 16, 32, ... and the end."""
    out = []
    n = 8
    while n < width:
        out.append(n)
        n *= 2
    return [*out, width]


class Turned:
    """Vectors of one tile: as given, their norms, and turned unit vectors with suffix norms."""

    def __init__(self, vectors: np.ndarray, axes: np.ndarray | None):
        self.raw = vectors
        self.norm = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        units = vectors / self.norm[:, None]
        self.unit = units @ axes if axes is not None else units
        squares = np.cumsum(self.unit[:, ::-1] ** 2, axis=1)[:, ::-1]
        self.rest = np.sqrt(np.hstack([squares, np.zeros((len(vectors), 1))]))


def linked(a: Turned, b: Turned, least: float):
    """Yields arrays (i, j) of the pairs of rows of `a` and `b` whose cosine reaches `least`."""
    stops = steps(a.raw.shape[1])
    for top in range(0, len(a.raw), _ROWS):
        rows = slice(top, min(top + _ROWS, len(a.raw)))
        first = stops[0]
        total = a.unit[rows, :first] @ b.unit[:, :first].T
        alive = total + np.outer(a.rest[rows, first], b.rest[:, first]) >= least - SLACK
        i_all, j_all = np.nonzero(alive)
        sums = total[i_all, j_all]
        for at in range(0, len(i_all), _PAIRS):
            i, j, s = i_all[at:at + _PAIRS] + top, j_all[at:at + _PAIRS], sums[at:at + _PAIRS]
            for low, high in zip(stops[:-1], stops[1:]):
                s = s + np.einsum("ij,ij->i", a.unit[i, low:high], b.unit[j, low:high])
                keep = s + a.rest[i, high] * b.rest[j, high] >= least - SLACK
                i, j, s = i[keep], j[keep], s[keep]
            cosine = np.einsum("ij,ij->i", a.raw[i], b.raw[j]) / (a.norm[i] * b.norm[j])
            keep = cosine >= least
            yield i[keep], j[keep]


def _smallest(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest index that each of n nodes is connected with."""
    label = np.arange(n)
    if not pairs:
        return label
    i, j = (np.concatenate(x) for x in zip(*pairs))
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        # pass on what the labels' own nodes have learnt
        label = label[label]
        if (label == before).all():
            return label


def _compared(key, table: pa.Table, least: float, axes: dict[int, np.ndarray]) -> pa.Table:
    width, left, right = key[1].as_py(), key[2].as_py(), key[3].as_py()
    table = table.sort_by("node")
    node, times = table.column("node").to_numpy(), table.column("times").to_numpy()
    tile = table.column("tile").to_numpy()
    vectors = table.column("vector").combine_chunks().flatten().to_numpy().astype(float)
    vectors = vectors.reshape(len(node), width)
    mine, other = np.flatnonzero(tile == left), np.flatnonzero(tile == right)
    a = Turned(vectors[mine], axes.get(width))
    b = a if left == right else Turned(vectors[other], axes.get(width))
    links, pairs = np.zeros(len(node), np.int64), []
    for i, j in linked(a, b, least):
        i, j = mine[i], other[j]
        if left == right:
            i, j = i[i < j], j[i < j]
        links += np.bincount(i, times[j], len(node)).astype(np.int64)
        links += np.bincount(j, times[i], len(node)).astype(np.int64)
        # of a node's links in this part one to each side is enough to connect it
        pairs.append((i, j))
        if sum(len(p[0]) for p in pairs) > 1 << 20:
            label = _smallest(len(node), pairs)
            pairs = [(np.arange(len(node)), label)]
    label = _smallest(len(node), pairs)
    some = links > 0
    return pa.table({"node": pa.array(node[some]), "links": pa.array(links[some]),
                     "root": pa.array(node[label[some]])})


def near_vectors(vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id",
                 vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) for each row of `vectors`."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"),
                          F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    usable = (F.col("id").isNotNull() & F.col("label").isNotNull() & finite("vector")
              & F.exists("vector", lambda x: x != 0))
    good = rows.filter(usable)
    # equal vectors of a label are one node: the smallest id, and how many there are
    nodes = cut_lineage(good.groupBy("label", "vector").agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("times")).withColumns(
        {"width": F.size("vector"), "node": F.monotonically_increasing_id()}), "tiles")
    sample = nodes.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").collect()
    axes = turns([np.array(r[0], float) for r in sample])

    counts = nodes.groupBy("label", "width").agg(
        F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
    tiled = lookup(nodes, counts, ["label", "width"]).withColumn(
        "tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    paired = tiled.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "label", "width", F.least("tile", "_other").alias("left"),
        F.greatest("tile", "_other").alias("right"), "tile", "node", "times", "vector")
    found = cut_lineage(paired.groupBy("label", "width", "left", "right").applyInArrow(
        lambda key, t: _compared(key, t, least, axes), "node bigint, links bigint, root bigint"),
        "tiles")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    # a component is named by the smallest id in it
    labels = cut_lineage(lookup(labels, nodes.select("node", "id"), ["node"]), "tiles")
    names = labels.groupBy("component").agg(F.min("id").alias("least"))
    named = lookup(labels.drop("id"), names, ["component"]).select("node", F.col("least").alias("component"))

    per_node = lookup(lookup(nodes.drop("width").withColumnRenamed("id", "own"), links, ["node"]),
                      named, ["node"])
    all_rows = lookup(rows.withColumn("_usable", usable), per_node, ["label", "vector"])
    # unusable rows find no node: a zero vector is in none, and null ids are told apart here
    n_links = F.when(F.col("_usable"), F.col("times") - 1 + F.coalesce("links", F.lit(0))
                     ).otherwise(F.lit(0)).cast("bigint")
    component = F.when(F.col("_usable"), F.coalesce("component", "own")).otherwise(F.col("id"))
    return all_rows.select(F.col("id").alias(id_col), n_links.alias("n_links"),
                           component.alias("component_id"),
                           F.col("id").eqNullSafe(component).alias("kept"))
