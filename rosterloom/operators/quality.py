"""Completeness, rule checks and data-quality reports. Profiles and rules are data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import derive, text, vocab
from .components import connected_components, key_links
from .groups import attach_group_stats


# -- completeness -------------------------------------------------------------

def has_tags(c: str) -> Column:
    return F.coalesce(F.size(c) > 0, F.lit(False))


def has_confidence(c: str) -> Column:
    return F.coalesce(F.col(c).between(1, 5), F.lit(False))


def has_time_estimate(visit: str, minutes: str) -> Column:
    return ~text.is_missing(visit) | F.col(minutes).isNotNull()


@dataclass(frozen=True)
class Profile:
    """What makes a record complete.

    `columns` maps a profile field to the column that holds it; `either` maps a pseudo-field
    to columns of which one suffices; `conditional` fields count only where `when` holds.
    """

    fields: Sequence[str]
    tags: Sequence[str] = ("data_sources",)
    confidence: Sequence[str] = ("confidence",)
    either: Mapping[str, Sequence[str]] = field(default_factory=dict)
    conditional: Sequence[str] = ()
    must_be_true: Sequence[str] = ()
    when: Column | None = None
    columns: Mapping[str, str] = field(default_factory=dict)


def progress_profile(columns: Mapping[str, str] | None = None, domain: str = "primary_domain") -> Profile:
    return Profile(vocab.SCHEMA_FIELDS + tuple(f for f in vocab.PROGRESS_FIELDS
                                               if f not in vocab.SCHEMA_FIELDS),
                   conditional=tuple(f for f in vocab.ART_FIELDS if f != "is_scored"),
                   must_be_true=("is_scored",), when=derive.is_art("domain", domain_col=domain),
                   columns=columns or {})


def report_profile(columns: Mapping[str, str] | None = None) -> Profile:
    return Profile(vocab.SCHEMA_FIELDS + vocab.REPORT_FIELDS,
                   either={"time_estimate": ("time_needed", "estimated_visit_minutes")},
                   columns=columns or {})


def missing_flags(df: DataFrame, profile: Profile, placeholders: str = "report") -> dict[str, Column]:
    """{field: Column that is true when the field counts as missing}."""
    types = dict(df.dtypes)

    def one(name: str) -> Column:
        col = profile.columns.get(name, name)
        if name in profile.tags:
            return ~has_tags(col)
        if name in profile.confidence:
            return ~has_confidence(col)
        return text.missing_of_type(col, types[col], placeholders)

    flags = {f: one(f) for f in profile.fields}
    for name, cols in profile.either.items():
        flags[name] = reduce(lambda a, b: a & b, [one(c) for c in cols])
    if profile.when is not None:
        for f in profile.conditional:
            flags[f] = profile.when & one(f)
        for f in profile.must_be_true:
            col = profile.columns.get(f, f)
            flags[f] = profile.when & ~F.coalesce(F.col(col), F.lit(False))
    return flags


def is_full(df: DataFrame, profile: Profile) -> Column:
    return ~reduce(lambda a, b: a | b, missing_flags(df, profile).values())


def missing_fields(df: DataFrame, profile: Profile) -> Column:
    return F.array_compact(F.array(
        *[F.when(c, F.lit(f)) for f, c in missing_flags(df, profile).items()]))


def completeness(df: DataFrame, fields: Sequence[str], placeholders: str = "report") -> Column:
    """Share of the fields that are filled, in percent."""
    types = dict(df.dtypes)
    filled = [(~text.missing_of_type(f, types[f], placeholders)).cast("int") for f in fields]
    return reduce(lambda a, b: a + b, filled) * 100.0 / len(fields)


def progress(df: DataFrame, region: str, full: Column) -> DataFrame:
    """Totals of full and placeholder records, overall and per upper-cased region, in one pass."""
    keyed = df.select(F.upper(F.coalesce(F.nullif(F.col(region), F.lit("")),
                                         F.lit(vocab.FOREIGN_CODE))).alias("region"),
                      full.alias("_full"))
    n_full = F.count_if("_full")
    return keyed.rollup("region").agg(
        F.when(F.grouping("region") == 1, "total").otherwise(F.col("region")).alias("level"),
        F.count(F.lit(1)).alias("total"), n_full.alias("full"),
        (F.count(F.lit(1)) - n_full).alias("placeholder"),
        F.round(n_full * 100.0 / F.count(F.lit(1)), 2).alias("full_pct"))


def missing_report(df: DataFrame, region: str, missing: Column) -> DataFrame:
    """How often each field is missing, overall and per region, from one exploded scan."""
    gaps = df.select(F.upper(F.coalesce(F.nullif(F.col(region), F.lit("")),
                                        F.lit(vocab.FOREIGN_CODE))).alias("region"),
                     F.explode(missing).alias("field"))
    return (gaps.groupingSets([["field"], ["region", "field"]], "region", "field")
            .agg(F.when(F.grouping("region") == 1, "total").otherwise(F.col("region")).alias("level"),
                 F.count(F.lit(1)).alias("n")))


def missing_examples(df: DataFrame, row_no: str, missing: Column, columns: Sequence[str],
                     n: int = 10) -> DataFrame:
    """The first `n` records per missing field. The rank limit runs before the shuffle too."""
    from pyspark.sql import Window

    gaps = df.select(row_no, *columns, F.explode(missing).alias("field"))
    w = Window.partitionBy("field").orderBy(row_no)
    return gaps.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


# -- rules --------------------------------------------------------------------

@dataclass(frozen=True)
class Rule:
    """One field rule. `kind`: required, enum, range, http_url, type; arguments as needed.

    `type` holds the one Spark type, as `values`, that the text of the field must be readable as.
    """

    field: str
    kind: str
    values: Sequence[str] = ()
    low: float | None = None
    high: float | None = None

    def broken(self, dtype: str) -> Column:
        c = F.col(self.field)
        if self.kind == "required":
            return (text.strip(c) == "") | c.isNull() if dtype == "string" else c.isNull()
        if self.kind == "enum":
            return F.coalesce(~c.isin(*self.values), F.lit(False))
        if self.kind == "range":
            return F.coalesce(~c.between(self.low, self.high), F.lit(False))
        if self.kind == "http_url":
            return c.isNotNull() & ~text.is_http_url(c)
        if self.kind == "type":
            as_text = text.strip(c.cast("string"))
            return c.isNotNull() & as_text.try_cast(self.values[0]).isNull()
        raise ValueError(f"unknown rule kind {self.kind!r}")


def _issue(cond: Column, *values: Column) -> Column:
    return F.when(cond, F.struct(*values))


def rule_issues(df: DataFrame, rules: Sequence[Rule], keys: Sequence[str]) -> DataFrame:
    """One row per broken rule and record."""
    types = dict(df.dtypes)
    issues = F.array_compact(F.array(*[
        _issue(r.broken(types[r.field]), F.lit(r.field).alias("field"),
               F.lit(r.kind).alias("rule")) for r in rules]))
    return df.select(*keys, F.explode(issues).alias("i")).select(*keys, "i.field", "i.rule")


def container_issues(df: DataFrame, key: str, required: Sequence[str], array: str,
                     record_required: Sequence[str]) -> DataFrame:
    """Missing required fields of containers and of the records in them: key, ordinal, field.

    Ordinal 0 is the container itself, its records count from 1. Null and blank text are missing;
    a container without the array lacks the array's field.
    """
    types = dict(df.dtypes)
    inner = {f.name: f.dataType.simpleString() for f in df.schema[array].dataType.elementType.fields}

    def missing(c: Column, dtype: str) -> Column:
        return c.isNull() | (text.strip(c) == "") if dtype == "string" else c.isNull()

    def gaps(ordinal: Column, checks: Mapping[str, Column]) -> Column:
        return F.array_compact(F.array(*[
            _issue(cond, ordinal.cast("int").alias("ordinal"), F.lit(f).alias("field"))
            for f, cond in checks.items()]))

    own = gaps(F.lit(0), {f: missing(F.col(f), types[f]) for f in (*required, array)})
    records = F.flatten(F.transform(F.coalesce(F.col(array), F.array().cast(types[array])), lambda r, i: gaps(
        i + 1, {f: F.coalesce(missing(r[f], inner[f]), F.lit(True)) for f in record_required})))
    return df.select(key, F.explode(F.concat(own, records)).alias("i")).select(
        key, "i.ordinal", "i.field")


def conformance(df: DataFrame, rules: Sequence[Rule], unit: str) -> DataFrame:
    """Valid and invalid records per unit (file, region)."""
    types = dict(df.dtypes)
    bad = reduce(lambda a, b: a | b, [r.broken(types[r.field]) for r in rules])
    return (df.groupBy(unit).agg(F.count_if(~bad).alias("valid"), F.count_if(bad).alias("invalid"),
                                 (F.count_if(bad) == 0).alias("unit_valid")))


def roster_issues(df: DataFrame, state: str, name: str, city: str, url: str, row_no: str,
                  salts: int = 32) -> DataFrame:
    """Roster checks: empty fields and bad URLs are errors, scrape artefacts and repeats warnings."""
    s, n, c, u = (text.strip(F.coalesce(F.col(x), F.lit(""))) for x in (state, name, city, url))
    keyed = df.select(row_no, s.alias("_s"), n.alias("_n"), c.alias("_c"), u.alias("_u"),
                      F.lower(s).alias("_ks"), F.lower(n).alias("_kn"), F.lower(c).alias("_kc"))
    first = attach_group_stats(keyed, ["_ks", "_kn", "_kc"], {"_first": ("min", row_no)}, row_no,
                               salts)
    url_col = F.col("_u")
    checks = [
        (F.col("_s") == "", "ERROR", "empty_state"), (F.col("_n") == "", "ERROR", "empty_name"),
        (url_col == "", "ERROR", "empty_url"),
        ((url_col != "") & ~text.is_http_url("_u"), "ERROR", "invalid_url"),
        (url_col.rlike(r"[)\]]$"), "WARN", "trailing_bracket"),
        (url_col.contains("%20"), "WARN", "percent_20"),
        (F.col(row_no) > F.col("_first"), "WARN", "duplicate"),
    ]
    issues = F.array_compact(F.array(*[
        _issue(cond, F.lit(level).alias("level"), F.lit(issue).alias("issue"))
        for cond, level, issue in checks]))
    return first.select(row_no, F.explode(issues).alias("i")).select(row_no, "i.level", "i.issue")


def art_guard_issues(df: DataFrame, id_col: str, domain: str, visit: str, scoreable: str,
                     scores: Sequence[str]) -> DataFrame:
    """Records that break the write guard: bad domain, bad visit length, scores on non-art."""
    non_art = ~(derive.is_art("domain", domain_col=domain) | derive.is_art("flag", flag_col=scoreable))
    bad_visit = F.col(visit).isNotNull() & derive.normalize_visit_length(visit).isNull()
    checks = [
        (F.col(domain).isNotNull() & ~F.col(domain).isin(*vocab.DOMAINS), "domain"),
        (bad_visit, "visit_length"),
        (non_art & derive.any_set(*scores), "scores_on_non_art"),
    ]
    issues = F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in checks]))
    return df.select(id_col, F.explode(issues).alias("issue"))


def validated(df: DataFrame, id_col: str, domain: str, visit: str, scoreable: str,
              scores: Sequence[str]) -> DataFrame:
    """The records with their visit length normalised; raises on the first broken guard."""
    fail_on_issues(art_guard_issues(df, id_col, domain, visit, scoreable, scores))
    return df.withColumn(visit, derive.normalize_visit_length(visit))


def fail_on_issues(issues: DataFrame) -> None:
    """Raise when there is any issue (reads at most one row)."""
    first = issues.limit(1).collect()
    if first:
        raise ValueError(f"validation failed: {first[0].asDict()}")


def coordinate_issues(df: DataFrame, id_col: str, lat: str, lon: str, region: str | None = None,
                      bounds: DataFrame | None = None) -> DataFrame:
    """Coordinates outside the globe, or outside the bounds table (region, min_lat, max_lat,
    min_lon, max_lon) when one is given."""
    bad = ~F.col(lat).between(-90, 90) | ~F.col(lon).between(-180, 180)
    out = df
    outside = F.lit(False)
    if bounds is not None:
        out = df.join(bounds.withColumnRenamed("region", region), region, "left")
        outside = ~(F.col(lat).between(F.col("min_lat"), F.col("max_lat"))
                    & F.col(lon).between(F.col("min_lon"), F.col("max_lon")))
    issue = F.when(bad, "out_of_range").when(F.coalesce(outside, F.lit(False)), "out_of_region")
    return out.select(id_col, issue.alias("issue")).filter(F.col("issue").isNotNull())


def blocked_writes(df: DataFrame, id_col: str, new_value: str, reviewed: str | None = None) -> DataFrame:
    """New values that are placeholders and not human-reviewed: they must not be written."""
    bad = F.lower(text.strip(new_value)).isin(*vocab.PLACEHOLDERS["blocked"])
    if reviewed:
        bad = bad & ~F.coalesce(F.col(reviewed), F.lit(False))
    return df.filter(bad).select(id_col, new_value)


def shared_key_duplicates(df: DataFrame, id_col: str, keys: Mapping[str, Column],
                          salts: int = 32) -> DataFrame:
    """Records that share a key (website, phone, address …) with others, one row per member.

    Members are rows, not collected lists, so a key shared by a third of all records is fine.
    """
    kinds = F.explode(F.array(*[
        F.struct(F.lit(k).alias("kind"), c.cast("string").alias("value"))
        for k, c in keys.items()]))
    long = (df.select(id_col, kinds.alias("k")).select(id_col, "k.kind", "k.value")
            .filter(F.coalesce(F.col("value") != "", F.lit(False))))
    return (attach_group_stats(long, ["kind", "value"], {"n": ("count", None)}, id_col, salts)
            .filter("n > 1"))


def review_groups(df: DataFrame, id_col: str, keys: Mapping[str, Column],
                  salts: int = 32) -> DataFrame:
    """(id, group_id, n): the review group of each record that may be a duplicate.

    Records belong together if a chain of shared keys leads from one to the other, whichever kinds
    the keys are of; `group_id` is the group's smallest id, `n` its number of records. Members are
    rows, so a group with a third of all records is fine. Null and empty keys are shared by none.
    """
    named = df.select(F.col(id_col).alias("a"), *[
        F.when(c.cast("string") != "", F.concat(F.lit(f"{kind}:"), c.cast("string"))).alias(f"key_{kind}")
        for kind, c in keys.items()])
    groups_ = connected_components(key_links(named, "a", [f"key_{kind}" for kind in keys]))
    sized = attach_group_stats(groups_, ["component"], {"n": ("count", None)}, "node", salts)
    return sized.select(F.col("node").alias(id_col), F.col("component").alias("group_id"), "n")


def repeated_keys(df: DataFrame, keys: Sequence[str | Column], n: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n)).filter(F.col(n) > 1)


def integrity_sweep(df: DataFrame, id_col: str, confidence: str, stored: str,
                    recomputed: Column, floor: int = 3) -> DataFrame:
    """Duplicate ids, low confidence and stored scores that differ from the formula."""
    dup = repeated_keys(df, [id_col]).select(id_col, F.lit("duplicate_id").alias("issue"))
    checks = [(F.coalesce(F.col(confidence) < floor, F.lit(False)), "low_confidence"),
              (~F.col(stored).eqNullSafe(recomputed), "stale_score")]
    issues = F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in checks]))
    return df.select(id_col, F.explode(issues).alias("issue")).unionByName(dup)


def rollout_rank(region: Column | str) -> Column:
    """Wave of a region code: the fixed waves, then the other states, then everything else."""
    c = text.as_col(region)
    out = None
    for i, wave in enumerate(vocab.ROLLOUT_WAVES, 1):
        out = F.when(c.isin(*wave), i) if out is None else out.when(c.isin(*wave), i)
    n = len(vocab.ROLLOUT_WAVES)
    return out.when(c.isin(*vocab.US_STATES.values()), n + 1).otherwise(n + 2)


def release_gates(failed: Column, total: Column, drifted: Column, compared: Column,
                  top_changed: Column, max_failure: float = 0.10,
                  max_drift: float = 0.05) -> list[Column]:
    """Failure rate, drift and manual-review gates as columns over one aggregate row."""
    failure = F.coalesce(F.try_divide(failed, total), F.lit(0.0))
    drift = F.coalesce(F.try_divide(drifted, compared), F.lit(0.0))
    ok = (failure <= max_failure) & (drift <= max_drift) & (top_changed == 0)
    return [failure.alias("failure_rate"), drift.alias("drift_rate"),
            top_changed.alias("needs_review"), ok.alias("pass")]
