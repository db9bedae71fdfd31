"""The corpus pipeline: good documents, without near copies and secrets, mixed and packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of `docs`. Stages can be run one by one, each on what the one before has written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterloom.llm import mixing, packing, ranking, secrets, superminhash
from rosterloom.session import cut_lineage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the pairwise quality classifier does not reject."""
    ranker = ranking.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return ranking.accepted(docs, ranker)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word shingles, similarity 0.8)."""
    return superminhash.deduplicated(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts masked and their lengths counted anew."""
    clean = secrets.redacted(docs)
    kind = clean.schema["n_chars"].dataType
    return clean.withColumn("n_chars", F.length("text").cast(kind))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens."""
    return packing.packed(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secret_scan", secret_scan),
          ("mix", mix), ("pack", pack)]

#: The classifier is learnt and the texts are tokenized, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of `sf_dir`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
