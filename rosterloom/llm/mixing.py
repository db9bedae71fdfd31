"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source has a target number of words: its share by weight of the whole budget, at most
`max_epochs` times its own size, the excess reshared by weight among the others until none is
above. A source is taken in complete epochs as often as the target holds its size; the rest of the
target is filled by weighted sampling without replacement: each document gets the exponential key
-ln(u) / quality with u fixed by its id, the smallest keys come first, and a document is taken
while the running sum of words, to the middle of the document, stays within the rest.

The running sums are made of sums per (source, range of keys) and sums inside the ranges, so a
source with most of the rows is spread over all tasks; the driver sees one row a round.

Null sources are one source, the last in order. A null size counts as 0. Rows with equal ids have
equal keys and are neighbours in the order. A null quality counts as 1, one below 1e-6 as 1e-6.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.groups import free_name, lookup
from ..operators.order import numbered
from ..session import cut_lineage
from .common import WORD

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3


def words_in(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def letters_share(text: str) -> Column:
    """Share of a text's characters that are letters or white space, from 0 to 1."""
    plain = F.length(F.regexp_replace(F.col(text), r"[^\p{L}\s]+", ""))
    return F.coalesce(plain / F.greatest(F.length(F.col(text)), F.lit(1)), F.lit(0.0))


def uniform(id_col: str, seed: int) -> Column:
    """A number in (0, 1) fixed by seed and id: the first 52 bits of an MD5 sum."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(16 ** 13)


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.0,
            max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """`sizes` (source, source_size) with weight and target; weights repeat in source order."""
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    placed = numbered(sizes, [F.asc_nulls_last("source")], "_no").withColumn(
        "weight", F.get(cycle, (F.col("_no") % len(weights)).cast("int"))).drop("_no")
    placed = cut_lineage(placed.withColumn("_cap", F.col("source_size") * float(max_epochs)),
                         "mixing")
    # a source is at its cap once level * weight exceeds it; the level only rises
    level, seen = 0.0, -1
    while True:
        full = F.col("_cap") < level * F.col("weight")
        row = placed.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)).alias("all"),
            F.coalesce(F.sum(F.when(full, F.col("_cap"))), F.lit(0.0)).alias("capped"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("open"),
            F.count_if(full).alias("n")).first()
        if row["n"] == seen or not row["open"]:
            break
        seen = row["n"]
        level = (share * float(row["all"]) - row["capped"]) / row["open"]
    return placed.withColumn("target", F.least(F.col("_cap"), F.lit(float(level)) * F.col("weight"))
                             ).drop("_cap")


def mixture(docs: DataFrame, size: Column, quality: Column, id_col: str = "doc_id",
            source_col: str = "source", weights: Sequence[float] = WEIGHTS, share: float = 1.0,
            max_epochs: float = MAX_EPOCHS, seed: int = 11, row_col: str | None = None) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken) for each row of `docs`.

    `row_col` names a column of different numbers, which the result then holds as well.
    """
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    weight = F.greatest(F.coalesce(quality, F.lit(1.0)), F.lit(1e-6))
    sized = cut_lineage(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"),
        F.coalesce(size, F.lit(0)).cast("bigint").alias("size"),
        (-F.ln(uniform(id_col, seed)) / weight).alias("key"), row.alias("row")), "mixing")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(sizes, weights, share, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))
                    ).otherwise(F.lit(0)).cast("bigint")
    goal = goal.withColumn("epochs", epochs).withColumn(
        "rest", F.col("target") - F.col("epochs") * F.col("source_size"))

    order = [F.asc_nulls_last("source"), "key", F.asc_nulls_last("id"), "row"]
    # the row number parts equal ids, so that ranges can be cut between them
    ranged = cut_lineage(
        sized.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("range", F.spark_partition_id()), "mixing")
    # at most one row a range for each source
    ranges = ranged.groupBy("source", "range").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(
        Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    ranges = lookup(ranges, goal, ["source"])
    inside = Window.partitionBy("source", "range").orderBy("key", F.asc_nulls_last("id"), "row"
                                                           ).rowsBetween(Window.unboundedPreceding, -1)
    rows = lookup(ranged.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))),
                  ranges.drop("words", "weight"), ["source", "range"])
    middle = F.col("before") + F.col("inside") + F.col("size") / 2
    copies = F.col("epochs") + (middle < F.col("rest")).cast("bigint")
    return rows.withColumn("copies", copies).select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size",
        "target", "copies", (F.col("copies") * F.col("size")).alias("taken"),
        *([F.col("row").alias(row_col)] if row_col else []))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          source_col: str = "source", **options) -> DataFrame:
    """The rows of the mix, all columns of `docs`: each document as often as it is taken.

    Each row is taken by its own plan, whatever other rows share its id.
    """
    # row numbers are written: they must be the same in every later read
    row, of, times_col = (free_name(c, docs) for c in ("_mix_row", "_mix_of", "_mix_copies"))
    rows = cut_lineage(docs.withColumn(row, F.monotonically_increasing_id()), "mixing")
    plan = mixture(rows, words_in(text_col), letters_share(text_col), id_col, source_col,
                   row_col=row, **options)
    times = plan.filter("copies > 0").select(F.col(row).alias(of), F.col("copies").alias(times_col))
    found = rows.join(cut_lineage(times, "mixing"), F.col(row) == F.col(of))
    return found.withColumn(times_col, F.explode(F.sequence(
        F.lit(1).cast("bigint"), F.col(times_col)))).select(*[rows[c] for c in docs.columns])
