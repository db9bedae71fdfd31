"""Reconciling caches and evidence with records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import derive
from ..functions.text import truthy
from .groups import last_per_key, lookup


def ttl_split(requests: DataFrame, cache: DataFrame, key: str, fetched_at: str, as_of: Column,
              ttl_seconds: int = 14 * 24 * 3600) -> DataFrame:
    """Adds `is_hit`: the newest cache entry of the key is no older than the time to live."""
    newest = cache.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(fetched_at).alias("_at"))
    age = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("_at").cast("timestamp"))
    hit = F.coalesce(age <= F.lit(ttl_seconds * 1_000_000), F.lit(False))
    return lookup(requests, newest, [key]).withColumn("is_hit", hit).drop("_at")


def cache_vs_record(cache: DataFrame, records: DataFrame, key: str, fields: Sequence[str],
                    success: str, scored_field: str) -> DataFrame:
    """Class per cache row: not_found, match, mismatch, cache_only, ignored; mismatching fields.

    Null equals null. `records` has one row per key (take the last one first, if needed).
    """
    right = records.select(key, F.lit(True).alias("_there"),
                           *[F.col(f).alias(f"_r_{f}") for f in fields])
    joined = lookup(cache, right, [key])
    differs = {f: ~F.col(f).eqNullSafe(F.col(f"_r_{f}")) for f in fields}
    bad = F.array_compact(F.array(*[F.when(c, F.lit(f)) for f, c in differs.items()]))
    ok = F.coalesce(F.col(success), F.lit(False))
    has = F.col(f"_r_{scored_field}").isNotNull()
    kind = (F.when(F.col("_there").isNull(), "not_found")
            .when(ok & has & (F.size(bad) == 0), "match").when(ok & has, "mismatch")
            .when(ok, "cache_only").otherwise("ignored"))
    return joined.select(*cache.columns, kind.alias("class"),
                         F.when(kind == "mismatch", bad).alias("mismatched"))


def cache_status(cache: DataFrame, key: str, success: str, scores: Sequence[str]) -> DataFrame:
    """Per key: number of entries and whether any was scored, all-null or failed."""
    ok = F.coalesce(F.col(success), F.lit(False))
    has = derive.any_set(*scores)
    return cache.groupBy(key).agg(
        F.count(F.lit(1)).alias("entries"), F.bool_or(ok & has).alias("scored"),
        F.bool_or(ok & ~has).alias("null_scores"), F.bool_or(~ok).alias("failed"))


def sync_status(status: DataFrame, records: DataFrame, key: str, scores: Sequence[str]) -> DataFrame:
    """synced / unsynced_null / unsynced_scores per cached key that has a record."""
    have = records.select(key, derive.any_set(*scores).alias("_has"))
    kind = (F.when(F.col("_has"), "synced").when(F.col("null_scores"), "unsynced_null")
            .when(F.col("scored"), "unsynced_scores").otherwise("failed_only"))
    return status.join(have, key).select(*status.columns, kind.alias("sync"))


def overlay_scores(records: DataFrame, scores: DataFrame, key: str, score_cols: Sequence[str],
                   summary_cols: Sequence[str], struct_name: str = "tour_planning_scores",
                   version: str = "v2_tour_planning") -> DataFrame:
    """Nest score columns in a struct, lift truthy summaries, mark scored records."""
    types = dict(scores.dtypes)
    right = scores.select(
        key, F.struct(*score_cols).alias(struct_name),
        *[F.when(truthy(c, types[c]), F.col(c)).alias(c) for c in summary_cols])
    hit = F.col(struct_name).isNotNull()
    out = lookup(records.drop(struct_name, *summary_cols), right, [key])
    return out.withColumns({
        "is_scored": F.when(hit, F.lit(True)).otherwise(
            F.col("is_scored") if "is_scored" in records.columns else F.lit(None).cast("boolean")),
        "scoring_version": F.when(hit, F.lit(version)).otherwise(
            F.col("scoring_version") if "scoring_version" in records.columns
            else F.lit(None).cast("string"))})


def evidence_flags(records: DataFrame, key: str, sources: Mapping[str, DataFrame],
                   inline: Mapping[str, Column]) -> DataFrame:
    """One flag per evidence source (a distinct-key join each) plus in-record evidence."""
    out = records
    for name, df in sources.items():
        keys = df.select(key).distinct().withColumn(f"has_{name}", F.lit(True))
        out = lookup(out, keys, [key]).withColumn(
            f"has_{name}", F.coalesce(F.col(f"has_{name}"), F.lit(False)))
    out = out.withColumns({f"has_{n}": F.coalesce(c, F.lit(False)) for n, c in inline.items()})
    names = [f"has_{n}" for n in (*sources, *inline)]
    anything = F.greatest(*[F.col(n).cast("int") for n in names]) == 1
    return out.withColumn("has_nothing", ~anything)


def coverage(df: DataFrame, has_cache: Column, has_score: Column) -> DataFrame:
    """2×2 coverage of cache and score, with the two ratios; empty sides give null."""
    return df.agg(
        F.count_if(has_cache).alias("with_cache"), F.count_if(~has_cache).alias("without_cache"),
        F.count_if(has_cache & has_score).alias("cache_and_score"),
        F.count_if(~has_cache & ~has_score).alias("no_cache_no_score"),
        F.try_divide(F.count_if(has_cache & has_score) * 100.0,
                     F.count_if(has_cache)).alias("scored_with_cache_pct"),
        F.try_divide(F.count_if(~has_cache & ~has_score) * 100.0,
                     F.count_if(~has_cache)).alias("unscored_without_cache_pct"))


def field_diff(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Null-safe field differences of two versions: one row per key and differing field."""
    left = old.select(key, *[F.col(f).cast("string").alias(f"_o_{f}") for f in fields])
    right = new.select(key, *[F.col(f).cast("string").alias(f"_n_{f}") for f in fields])
    changes = F.array_compact(F.array(*[
        F.when(~F.col(f"_o_{f}").eqNullSafe(F.col(f"_n_{f}")),
               F.struct(F.lit(f).alias("field"), F.col(f"_o_{f}").alias("old_value"),
                        F.col(f"_n_{f}").alias("new_value"))) for f in fields]))
    return left.join(right, key).select(key, F.explode(changes).alias("d")).select(key, "d.*")


def latest_entry(cache: DataFrame, key: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return last_per_key(cache, [key], order, columns)


def prefer_first(primary: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    """All primary rows, plus fallback rows whose key the primary lacks."""
    rest = lookup(fallback, primary.select(key).distinct(), [key], "left_anti")
    return primary.unionByName(rest.select(*fallback.columns), allowMissingColumns=True)
