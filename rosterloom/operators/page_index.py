"""Any page of a sorted table without sorting it again or reading what lies before.

Rows are written once, in ranges of the sort order, with a table of the rows and the first key of
each range. A page reads the ranges it lies in: for the usual page that is one.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_page_index(df: DataFrame, order: Sequence[Column], first: Sequence[str], path: str,
                     ranges: int | None = None) -> None:
    """Write `df` in ranges of `order`, which must tell all rows apart. `first` names its columns."""
    cut = df.repartitionByRange(ranges, *order) if ranges else df.repartitionByRange(*order)
    (cut.sortWithinPartitions(*order).withColumn("page_range", F.spark_partition_id())
     .write.partitionBy("page_range").parquet(f"{path}/rows"))
    # an empty table has no range, but columns
    df.limit(0).write.parquet(f"{path}/columns")
    rows = _rows(df.sparkSession, path)
    rows.groupBy("page_range").agg(F.count(F.lit(1)).alias("n"), *[
        F.min(c).alias(f"least_{c}") for c in first]).coalesce(1).write.parquet(f"{path}/ranges")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    columns = spark.read.parquet(f"{path}/columns").schema
    return spark.read.schema(columns.add("page_range", T.IntegerType())).parquet(f"{path}/rows")


def read_page(spark: SparkSession, path: str, order: Sequence[Column], page: int, size: int) -> DataFrame:
    """Page `page` (from 0) of `size` rows, in order; beyond the last page there are no rows."""
    # one row a range
    sizes = sorted((r["page_range"], r["n"]) for r in spark.read.parquet(f"{path}/ranges").collect())
    ends = list(accumulate(n for _, n in sizes))
    start, stop = page * size, (page + 1) * size
    wanted = [(k, end - n) for (k, n), end in zip(sizes, ends) if end > start and end - n < stop]
    rows = _rows(spark, path).filter(F.col("page_range").isin([k for k, _ in wanted]))
    before = start - wanted[0][1] if wanted else 0
    return rows.orderBy(*order).offset(max(0, before)).limit(size).drop("page_range")


def pages(spark: SparkSession, path: str, size: int) -> DataFrame:
    """One row: all rows and the number of pages (at least one), from the ranges alone."""
    n = F.coalesce(F.sum("n"), F.lit(0))
    return spark.read.parquet(f"{path}/ranges").agg(
        n.alias("total"), F.greatest(F.lit(1), F.ceil(n / size)).cast("bigint").alias("pages"))
