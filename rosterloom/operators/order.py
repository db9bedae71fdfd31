"""Global positions without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .groups import free_name, lookup


def with_offsets(df: DataFrame, part: str, sizes: Sequence[tuple[int, int]], place: str,
                 out: str) -> DataFrame:
    """Position of each row: the rows of all parts before its own, plus its place in it.

    `sizes` are (part, rows) in order of the parts: one pair for each partition or file split.
    """
    before = [0, *accumulate(n for _, n in sizes)]
    rows, offset = [(int(p), b) for (p, _), b in zip(sizes, before)], free_name("_before", df)
    offsets = df.sparkSession.createDataFrame(rows, f"{part} int, {offset} bigint")
    value = F.col(offset) + F.col(place)
    if out in (part, place):
        return lookup(df, offsets, [part]).withColumn(out, value).drop({part: place, place: part}[out], offset)
    return lookup(df, offsets, [part]).withColumn(out, value).drop(part, place, offset)


def numbered(df: DataFrame, order: Sequence[Column | str], out: str) -> DataFrame:
    """Add each row's position (from 0) in `order`, without bringing all rows into one task.

    Rows are ranged and sorted inside their range; the driver adds up the ranges' sizes, one
    number a range. Rows that are equal in `order` may be ranged apart only if it holds a column
    that tells them apart.
    """
    part, place = free_name("_range", df), free_name("_place", df)
    ranged = cut_lineage(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({
            part: F.spark_partition_id(),
            place: F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "order")
    sizes = sorted(map(tuple, ranged.groupBy(part).count().collect()))
    return with_offsets(ranged, part, sizes, place, out)
