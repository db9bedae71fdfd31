"""An incremental run: phases over the files that have arrived since the last run.

A file stream with a checkpoint knows which files are new; one trigger takes all of them and ends.
Every batch writes into a folder of its own, named by the batch id and overwritten if the batch is
run again, so a run that is cut short and repeated leaves the same rows as one that is not.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.groups import free_name, last_per_key, lookup

#: (new rows, the newest version of every record so far) -> rows to write
Phase = Callable[[DataFrame, DataFrame], DataFrame]


def versions(spark: SparkSession, target: str, schema: str) -> DataFrame:
    """All rows that runs have written, with the id of their batch. `schema` is that of the rows."""
    with_batch = f"{schema}, batch bigint"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], with_batch)
    return spark.read.schema(with_batch).parquet(target)


def newest(spark: SparkSession, target: str, schema: str, key: str) -> DataFrame:
    """The row of the last batch that wrote a key, for every key."""
    rows = versions(spark, target, schema)
    return last_per_key(rows, [key], ["batch"], [c for c in rows.columns if c != key])


def stale(new: DataFrame, current: DataFrame, key: str, modified: str) -> DataFrame:
    """`new` without rows that are no newer than the current version of their record.

    Records that were never seen are kept, and so are rows without a time.
    """
    seen = free_name("_seen", new)
    known = current.select(key, F.col(modified).alias(seen))
    fresh = F.coalesce(F.col(modified) > F.col(seen), F.lit(True))
    return lookup(new, known, [key]).filter(fresh).drop(seen)


def expired(entry_time: Column, ttl_seconds: int, now: Column) -> Column:
    """Whether a cache entry is older than its time to live (an entry without a time is)."""
    age = now.cast("timestamp").cast("double") - entry_time.cast("timestamp").cast("double")
    return F.coalesce(age > ttl_seconds, F.lit(True))


def run_arrived(spark: SparkSession, source: str, source_schema: str | T.StructType, target: str,
                checkpoint: str, phase: Phase, schema: str, key: str,
                columns: Sequence[str] | None = None) -> int:
    """Run `phase` over all files of `source` that no earlier run took; the number of batches run.

    `schema` is that of the rows `phase` returns. A run without new files runs no batch.
    """
    ran = []

    def one(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        done = versions(session, target, schema).filter(F.col("batch") < batch_id)
        rest = [c for c in done.columns if c != key]
        out = phase(batch, last_per_key(done, [key], ["batch"], rest))
        out.select(*(columns or [c for c in done.columns if c != "batch"])).write.mode("overwrite").parquet(
            f"{target}/batch={batch_id}")
        ran.append(batch_id)

    stream = spark.readStream.schema(source_schema).parquet(source)
    (stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint)
     .foreachBatch(one).start().awaitTermination())
    return len(ran)
