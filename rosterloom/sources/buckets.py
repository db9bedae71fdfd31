"""Tables kept in buckets by id, so that joins by id need no shuffle.

Records and their evidence are written into the same number of buckets, sorted by id. Joins and
aggregates by the id then read matching buckets side by side.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path


def write_buckets(df: DataFrame, name: str, key: str, buckets: int, path: str | None = None) -> DataFrame:
    """Write `df` as table `name` in buckets by `key`, and read it back from there."""
    spark = df.sparkSession
    # one file a bucket
    (df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).mode("overwrite")
     .option("path", path or scratch_path(spark, name)).saveAsTable(name))
    return spark.table(name)


def flags_from_buckets(records: DataFrame, key: str, sources: Mapping[str, DataFrame],
                       own: Mapping[str, Column]) -> DataFrame:
    """`has_{name}` a source (a table with the same buckets) or own condition, and `has_nothing`."""
    out = records
    for name, source in sources.items():
        there = source.groupBy(key).agg(F.lit(True).alias(f"has_{name}"))
        out = out.join(there.hint("merge"), key, "left")
    names = [f"has_{n}" for n in (*sources, *own)]
    out = out.withColumns({f"has_{n}": F.coalesce(f"has_{n}", F.lit(False)) for n in sources})
    out = out.withColumns({f"has_{n}": F.coalesce(c, F.lit(False)) for n, c in own.items()})
    nothing = F.lit(True)
    for n in names:
        nothing = nothing & ~F.col(n)
    return out.withColumn("has_nothing", nothing)
