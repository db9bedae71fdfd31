"""Run counters, rates and summary rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import iso_utc


def outcome_counters(df: DataFrame, region: str, outcome: str, kinds: Sequence[str]) -> DataFrame:
    """Processed records and one counter per outcome, per region and in total."""
    counters = [F.count_if(F.col(outcome) == k).alias(k) for k in kinds]
    return df.rollup(region).agg(
        F.when(F.grouping(region) == 1, "total").otherwise(F.col(region)).alias("level"),
        F.count(F.lit(1)).alias("processed"), *counters)


def flagged(df: DataFrame, id_col: str, region: str, outcome: str, kind: str = "failed") -> DataFrame:
    """Ids that need review, as rows."""
    return df.filter(F.col(outcome) == kind).select(region, id_col)


def rate_text(hits: Column, total: Column) -> Column:
    """`12.3%`, and `0%` for an empty input."""
    pct = F.round(F.try_divide(hits * 100.0, total), 1)
    return F.when(pct.isNull(), "0%").otherwise(F.format_string("%.1f%%", pct))


def coverage_text(hits: Column, total: Column) -> Column:
    """`n/m (p%)`."""
    return F.concat(hits.cast("string"), F.lit("/"), total.cast("string"), F.lit(" ("),
                    rate_text(hits, total), F.lit(")"))


def run_summary(df: DataFrame, outcome: str, kinds: Sequence[str], region: str, phase: str,
                run_id: str, as_of: Column) -> DataFrame:
    """One row per run: counters and identity of the run."""
    counted = df.agg(
        F.count_distinct(region).alias("regions"), F.count(F.lit(1)).alias("total_processed"),
        *[F.count_if(F.col(outcome) == k).alias(k) for k in kinds])
    # literals stand outside the aggregate: a run over no records has them too
    return counted.select(F.lit(run_id).alias("run_id"), F.lit(phase).alias("phase"), "*",
                          iso_utc(as_of).alias("completed_at"))


def write_counted(df: DataFrame, path: str, outcome: str, kinds: Sequence[str], phase: str, run_id: str,
                  as_of: Column) -> DataFrame:
    """Write `df` and return its run summary, counted while it is written: no second scan."""
    seen = Observation(f"run {run_id}")
    counters = [F.count_if(F.col(outcome) == k).alias(k) for k in kinds]
    df.observe(seen, F.count(F.lit(1)).alias("total_processed"), *counters).write.mode("overwrite").parquet(path)
    counted = seen.get
    row = [counted["total_processed"], *(counted[k] for k in kinds)]
    names = ", ".join(f"{c} bigint" for c in ("total_processed", *kinds))
    return df.sparkSession.createDataFrame([row], names).select(
        F.lit(run_id).alias("run_id"), F.lit(phase).alias("phase"), "*", iso_utc(as_of).alias("completed_at"))
