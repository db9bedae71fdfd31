"""Writers. Tables are Parquet; one-document JSON exists only for the envelope row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import iso_utc
from ..operators.groups import lookup


def envelope(df: DataFrame, as_of: Column, **extra: Column) -> DataFrame:
    """The one-row header of an index: when it was made and how many records it has."""
    counted = df.agg(F.count(F.lit(1)).alias("total_records"),
                     *[c.alias(n) for n, c in extra.items()])
    # the time stands outside the aggregate: an empty index has one too
    return counted.select(iso_utc(as_of).alias("generated_at"), "*")


def write_index(df: DataFrame, path: str, as_of: Column, **extra: Column) -> None:
    """Records as Parquet plus the envelope row next to them."""
    df.write.mode("overwrite").parquet(f"{path}/records")
    written = df.sparkSession.read.schema(df.schema).parquet(f"{path}/records")
    envelope(written, as_of, **extra).write.mode("overwrite").json(f"{path}/envelope")


def changed_partitions(df: DataFrame, partition: str, changed: str, updated_at: str,
                       as_of: Column) -> DataFrame:
    """All rows of the partitions in which something changed; changed rows are stamped."""
    touched = df.filter(F.col(changed)).select(partition).distinct()
    stamped = df.withColumn(updated_at, F.when(F.col(changed), as_of).otherwise(F.col(updated_at)))
    return lookup(stamped, touched, [partition], "left_semi").drop(changed)


def write_changed(df: DataFrame, path: str, partition: str, changed: str, updated_at: str,
                  as_of: Column) -> None:
    """Overwrite only the partitions in which something changed."""
    (changed_partitions(df, partition, changed, updated_at, as_of).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with minimal quoting: quotes double inside quoted fields, white space is kept."""
    df.write.mode("overwrite").options(
        header=True, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False).csv(path)


def append_run(summary: DataFrame, path: str) -> None:
    summary.write.mode("append").parquet(path)


def write_enriched_and_scores(enriched: DataFrame, path: str, key: str, score: str,
                              extra: Sequence[str] = ()) -> None:
    """The enriched index, and the scores-only index read back from it: one computation."""
    enriched.write.mode("overwrite").parquet(f"{path}/enriched")
    written = enriched.sparkSession.read.schema(enriched.schema).parquet(f"{path}/enriched")
    (written.filter(F.col(score).isNotNull()).select(key, score, *extra)
     .write.mode("overwrite").parquet(f"{path}/scores"))
