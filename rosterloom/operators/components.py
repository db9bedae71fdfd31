"""Groups of records that are connected through shared keys, at any size.

Records and keys are the two sides of a graph. Every key is replaced by its smallest record, the
hub, to which the other records of the key are linked; so a key shared by a third of all records
makes one link a record and no list. Stars are then contracted: in turn the larger and the smaller
neighbours of a node move to the smallest one, until nothing moves, in a number of rounds that grows
with the logarithm of a group's length. Rounds are written, so a lost executor costs a re-read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .groups import lookup


def key_links(df: DataFrame, node: str, keys: Sequence[Column | str]) -> DataFrame:
    """(a, b): each record and the smallest one that shares a key. Null and empty keys link nothing.

    Keys of different kinds must differ as strings (put the kind in front).
    """
    strings = F.array(*[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    long = df.select(F.col(node).alias("a"), F.explode(strings).alias("key")).filter(
        F.coalesce(F.col("key") != "", F.lit(False)) & F.col("a").isNotNull())
    hubs = long.groupBy("key").agg(F.min("a").alias("b"))
    return lookup(long, hubs, ["key"]).filter("a <> b").select("a", "b").distinct()


def _toward_least(edges: DataFrame) -> DataFrame:
    """Edges (u, v), u > v, with the smallest neighbour of u, which may be u itself."""
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    return lookup(edges, least, ["u"])


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of `links` (a, b): the smallest node it reaches."""
    edges = cut_lineage(links.filter("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components")
    state = None
    while True:
        seen = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")),
                         F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if seen == state or not seen[0]:
            break
        state = seen
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = cut_lineage(_toward_least(both).filter("v > u").select(
            F.col("v").alias("u"), F.least("u", "least").alias("v")).distinct(), "components")
        small = _toward_least(large).select(F.explode(F.array(
            F.struct("u", F.col("least").alias("v")), F.struct(F.col("v").alias("u"),
                                                               F.col("least").alias("v")))).alias("e"))
        edges = cut_lineage(small.select("e.u", "e.v").filter("u <> v").distinct(), "components")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
