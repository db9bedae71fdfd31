"""Substring search by an index of 3-grams.

The index is a table of postings (gram, id) in folders by a hash of the gram, the number of postings
of each gram, and the searched texts in folders by a hash of the id. A needle's rarest grams are
looked up and their postings intersected; only the texts that are left are searched. A needle of
fewer than three letters has no gram: it scans the texts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import as_col

FOLDERS = 32
#: Grams of a needle that are looked up.
RAREST = 3


def grams(text: Column | str) -> Column:
    """The distinct 3-grams of a text's characters, in time that grows with its length."""
    def of(chars: Column) -> Column:
        places = F.when(F.size(chars) > 2, F.sequence(F.lit(0), F.size(chars) - 3)).otherwise(
            F.array().cast("array<int>"))
        return F.array_distinct(F.transform(places, lambda i: F.concat(
            F.get(chars, i), F.get(chars, i + 1), F.get(chars, i + 2))))

    # the characters are made once, not once a gram
    return F.get(F.transform(F.array(F.split(as_col(text), "")), of), 0)


def _folder(c: Column | str) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(FOLDERS)).cast("int")


def write_text_index(df: DataFrame, id_col: str, columns: Sequence[Column | str], path: str) -> None:
    """Index the lower-cased columns, joined by ` | ` (empty and null ones left out)."""
    parts = [F.nullif(c if isinstance(c, Column) else F.col(c), F.lit("")) for c in columns]
    rows = df.select(F.col(id_col).alias("id"), F.lower(F.concat_ws(" | ", *parts)).alias("text"))
    rows.withColumn("folder", _folder("id")).repartition("folder").write.partitionBy("folder").parquet(
        f"{path}/texts")
    # an empty table has no folder, but columns
    rows.limit(0).write.parquet(f"{path}/columns")
    postings = _texts(df.sparkSession, path).select(F.explode(grams("text")).alias("gram"), "id")
    # a hot gram is spread over tasks by the id
    postings = postings.withColumn("folder", _folder("gram"))
    (postings.repartition("folder", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("folder", "gram")
     .write.partitionBy("folder").parquet(f"{path}/postings"))
    _postings(df.sparkSession, path).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).withColumn("folder", _folder("gram")).repartition(
        "folder").sortWithinPartitions("folder", "gram").write.partitionBy("folder").parquet(f"{path}/counts")


def _texts(spark: SparkSession, path: str) -> DataFrame:
    columns = spark.read.parquet(f"{path}/columns").schema
    return spark.read.schema(columns.add("folder", T.IntegerType())).parquet(f"{path}/texts")


def _postings(spark: SparkSession, path: str) -> DataFrame:
    kind = _texts(spark, path).schema["id"].dataType.simpleString()
    return spark.read.schema(f"gram string, id {kind}, folder int").parquet(f"{path}/postings")


def search_index(spark: SparkSession, path: str, needle: str) -> DataFrame:
    """(id) of the texts that hold the needle, in any case; an empty needle is held by all."""
    texts = _texts(spark, path)
    low = needle.strip().lower()
    hit = F.col("text").contains(low)
    if len(low) < 3:
        return texts.filter(hit).select("id")
    # one row a gram of the needle
    asked = spark.createDataFrame([(low,)], "needle string").select(F.explode(grams("needle")).alias("gram"))
    asked = [(r["gram"], r["folder"]) for r in asked.withColumn("folder", _folder("gram")).collect()]
    counts = spark.read.schema("gram string, n bigint, folder int").parquet(f"{path}/counts").filter(
        F.col("folder").isin(sorted({f for _, f in asked})) & F.col("gram").isin([g for g, _ in asked])).collect()
    if len(counts) < len(asked):
        return texts.filter(F.lit(False)).select("id")
    rarest = sorted(counts, key=lambda r: (r["n"], r["gram"]))[:RAREST]
    found = _postings(spark, path).filter(
        F.col("folder").isin(sorted({r["folder"] for r in rarest}))
        & F.col("gram").isin([r["gram"] for r in rarest]))
    left = found.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(rarest)).select(
        "id", _folder("id").alias("folder"))
    return texts.join(left, ["folder", "id"], "left_semi").filter(hit).select("id")
