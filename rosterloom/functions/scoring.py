"""Priority and quality scores, their breakdown, focus, bands and score validation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import json_object_in


@dataclass(frozen=True)
class ScoreColumns:
    """Names of the score inputs."""

    imp: str = "impressionist_strength"
    mod: str = "modern_contemporary_strength"
    hist: str = "historical_context_score"
    rep: str = "reputation"
    tier: str = "collection_tier"
    nearby: str = "nearby_museum_count"
    eca: str = "eca_score"
    cbs: str = "collection_based_strength"


DEFAULT = ScoreColumns()


def _dual(s: ScoreColumns) -> Column:
    both = (F.col(s.imp) >= 4) & (F.col(s.mod) >= 4)
    return F.when(both, 2).otherwise(0)


def _strength(s: ScoreColumns, version: str) -> Column:
    if version == "v2":  # a missing strength counts as weak
        one = F.lit(1)
        best = F.greatest(F.coalesce(F.col(s.imp), one), F.coalesce(F.col(s.mod), one))
        return F.when(F.coalesce(s.imp, s.mod).isNotNull(), best)
    return F.greatest(F.col(s.imp), F.col(s.mod))


def missing_inputs(s: ScoreColumns = DEFAULT, version: str = "v3") -> Column:
    """Names of the inputs without which a record cannot be scored."""
    def gap(cond: Column, name: str) -> Column:
        return F.when(cond, F.lit(name))

    if version == "v1":
        gaps = [gap(F.col(c).isNull(), n) for c, n in (
            (s.imp, "impressionist"), (s.mod, "modern"), (s.hist, "history"),
            (s.rep, "reputation"), (s.tier, "collection_tier"))]
    else:
        gaps = [gap(F.coalesce(s.imp, s.mod).isNull(), "art_strength")]
        needed = ((s.rep, "reputation"), (s.tier, "collection_tier"))
        if version == "v3":
            needed = ((s.hist, "history"), (s.cbs, "collection_strength"),
                      (s.rep, "reputation"), (s.eca, "eca"))
        gaps += [gap(F.col(c).isNull(), n) for c, n in needed]
    return F.array_compact(F.array(*gaps))


def components(s: ScoreColumns = DEFAULT, version: str = "v3") -> dict[str, Column]:
    """Named additive parts of the priority score (each may be null when not scorable)."""
    top, hist = _strength(s, version), F.col(s.hist)
    if version == "v3":
        return {
            "art": (5 - top) * 3, "history": (5 - hist) * 2, "collection": (5 - F.col(s.cbs)) * 2,
            "reputation": F.col(s.rep), "dual_bonus": -_dual(s),
            "eca_bonus": F.when(F.col(s.eca) >= 4, -1).when(F.col(s.eca).isNotNull(), 0),
        }
    if version == "v2":
        hist = F.coalesce(hist, F.lit(3))
    parts = {
        "art": (6 - top) * 3, "history": (6 - hist) * 2, "reputation": F.col(s.rep),
        "collection": F.col(s.tier), "dual_bonus": -_dual(s),
    }
    if version == "v2":
        parts["cluster_bonus"] = F.when(F.col(s.nearby) >= 3, -1).otherwise(0)
    return parts


def can_score(s: ScoreColumns = DEFAULT, version: str = "v3") -> Column:
    return F.size(missing_inputs(s, version)) == 0


def priority(s: ScoreColumns = DEFAULT, version: str = "v3") -> Column:
    """Priority score, lower is better; null when an input is missing."""
    total = F.lit(0)
    for part in components(s, version).values():
        total = total + part
    return F.when(can_score(s, version), total).cast("int")


def quality(s: ScoreColumns = DEFAULT, version: str = "v3", eca_mode: str = "bonus") -> Column:
    """Overall quality, higher is better; v3 adds the ECA score or only a bonus for ECA ≥ 4."""
    base = _strength(s, version) * 3 + (3 - F.col(s.rep)) + _dual(s)
    if version == "v2":
        total = base + (3 - F.col(s.tier))
    else:
        eca = F.col(s.eca) if eca_mode == "score" else F.when(F.col(s.eca) >= 4, 1).otherwise(0)
        total = base + F.col(s.hist) * 2 + F.col(s.cbs) * 2 + eca
    return F.when(can_score(s, version), total).cast("int")


def breakdown(s: ScoreColumns = DEFAULT, version: str = "v3", eca_mode: str = "bonus") -> Column:
    """One struct with the flag, both scores, every component and the missing inputs."""
    ok = can_score(s, version)
    parts = components(s, version)
    quality_version = "v2" if version == "v1" else version
    return F.struct(
        ok.alias("can_score"),
        priority(s, version).alias("priority"),
        F.when(ok, quality(s, quality_version, eca_mode)).alias("quality"),
        *[F.when(ok, col).cast("int").alias(name) for name, col in parts.items()],
        missing_inputs(s, version).alias("missing"),
    )


def primary_focus(s: ScoreColumns = DEFAULT, variant: str = "index") -> Column:
    """Dominant strength. Ties: `index` → modern; `phase` → modern unless 0/0; `patch` → impressionist unless 0/0."""
    imp_name, mod_name = F.lit("Impressionist"), F.lit("Modern/Contemporary")
    imp, mod = F.col(s.imp), F.col(s.mod)
    if variant == "index":
        return (F.when(imp.isNull() & mod.isNull(), None).when(imp.isNull(), mod_name)
                .when(mod.isNull(), imp_name).when(imp > mod, imp_name).otherwise(mod_name))
    a, b = F.coalesce(imp, F.lit(0)), F.coalesce(mod, F.lit(0))
    tie = mod_name if variant == "phase" else imp_name
    return F.when(a > b, imp_name).when(b > a, mod_name).when(a > 0, tie)


def must_see(s: ScoreColumns = DEFAULT) -> Column:
    return F.coalesce(F.col(s.hist) == 5, F.lit(False))


def has_art_score(s: ScoreColumns = DEFAULT) -> Column:
    """Truthiness rule: a strength of 0 counts as absent."""
    zero = F.lit(0)
    return (F.coalesce(F.col(s.imp), zero) != 0) | (F.coalesce(F.col(s.mod), zero) != 0)


def priority_band(score: Column) -> Column:
    return (F.when(score <= 5, "must_visit").when(score <= 10, "high_priority")
            .when(score <= 15, "worthwhile").when(score.isNotNull(), "known_or_regional"))


def quality_band(score: Column) -> Column:
    return (F.when(score >= 35, "world_class").when(score >= 28, "excellent")
            .when(score >= 21, "very_good").when(score >= 14, "good")
            .when(score.isNotNull(), "modest"))


def clamp(value: Column, low: int, high: int) -> Column:
    """Number truncated to an integer inside [low, high]; null, NaN and infinities give null."""
    number = value.cast("double")
    number = F.when(~F.isnan(number) & (F.abs(number) != F.lit(float("inf"))), number)
    whole = F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number))
    return F.when(number.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), whole))).cast(
        "int")


# fixed values: scores of an answer and their ranges
SCORE_RANGES = {
    "impressionist_strength": (0, 5), "modern_contemporary_strength": (0, 5),
    "historical_context_score": (0, 5), "eca_score": (0, 5),
    "collection_based_strength": (0, 5), "confidence": (1, 5), "reputation": (0, 3),
}


def validated_scores(df: DataFrame, response: Column,
                     ranges: dict[str, tuple[int, int]] | None = None,
                     note: str = "score_notes", note_length: int = 500) -> DataFrame:
    """Adds the clamped scores of a response text that holds one JSON object somewhere.

    The text is parsed once per row; JSON strings (also "NaN" and "Infinity", which the parser
    would take for numbers) are not numbers and give null.
    """
    ranges = SCORE_RANGES if ranges is None else ranges
    schema = ", ".join([*[f"{f} DOUBLE" for f in ranges], f"{note} STRING"])
    parsed = df.withColumn("_doc", F.from_json(json_object_in(response), schema))
    text = F.col(f"_doc.{note}")
    return parsed.withColumns({
        **{f: clamp(F.col(f"_doc.{f}"), low, high) for f, (low, high) in ranges.items()},
        note: F.nullif(F.left(text, F.lit(note_length)), F.lit("")),
    }).drop("_doc")
