"""Connected components of link tables too large for one machine."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.groups import lookup
from ..session import cut_lineage


def _forest(batches: Iterator[pa.RecordBatch]):
    """Union-find over the links of one batch: a star forest with the same components."""
    for batch in batches:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = parent[up]
                x = up
            return x

        for a, b in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        pairs = [(x, r) for x in parent if (r := root(x)) != x]
        yield pa.record_batch({"u": pa.array([p[0] for p in pairs], pa.int64()),
                               "v": pa.array([p[1] for p in pairs], pa.int64())})


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of `links` (columns a, b): the smallest node it reaches.

    Union-find inside each batch of links, then alternating large-star and small-star steps until
    nothing changes: a logarithmic number of rounds, each a few aggregated minima and joins whose
    hot hubs adaptive execution can split. Rounds are written to the shared folder.
    """
    edges = cut_lineage(
        links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .mapInArrow(_forest, "u bigint, v bigint").distinct(), "components")
    state = None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")),
                         F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if mark == state or not mark[0]:
            break
        state = mark
        # large star: each node's larger neighbours go to its smallest neighbour (or itself)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (lookup(both, least, ["u"]).filter("v > u")
                 .select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct())
        large = cut_lineage(large, "components")
        # small star: a node and its smaller neighbours go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = lookup(large, least, ["u"]).select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")),
                              F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = cut_lineage(small.select("e.u", "e.v").filter("u <> v").distinct(), "components")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
