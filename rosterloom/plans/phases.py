"""The enrichment run: phases are plain DataFrame functions composed in a fixed order."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import derive, scoring, text, vocab
from ..functions.scoring import ScoreColumns
from ..operators import dedupe, groups, linkage, merge
from ..session import cut_lineage

Phase = tuple[str, Callable[[DataFrame], DataFrame]]


def backbone(df: DataFrame, id_col: str, city: str, state: str, kind: str, name: str,
             population: str | None = None, force: bool = False) -> DataFrame:
    """Derived fields city_tier, time_needed, nearby_count, type and is_scoreable.

    Tier and visit length are written only when missing (or forced); the neighbour count is
    always recomputed. `updated_fields` lists what changed. Expects the columns `city_tier`,
    `time_needed` and `nearby_count` to exist (null when unknown).
    """
    with_peers = groups.peers_in_city(df.withColumnRenamed("nearby_count", "_old_nearby"),
                                      id_col, city, state, mode="phase")
    with_peers = with_peers.withColumn("_kind", derive.normalize_type(kind))
    no_tier = F.lit(force) | F.col("city_tier").isNull()
    no_time = F.lit(force) | text.is_missing("time_needed", "write")
    new_kind = F.col("_kind") != F.col(kind)
    changes = merge.change_list({
        "city_tier": no_tier, "time_needed": no_time,
        "nearby_count": ~F.col("_old_nearby").eqNullSafe(F.col("nearby_count")),
        "type": F.coalesce(new_kind, F.lit(False))})
    return with_peers.withColumns({
        "updated_fields": changes,
        "city_tier": F.when(no_tier, derive.city_tier(F.coalesce(city, F.lit("")), population))
        .otherwise(F.col("city_tier")),
        "time_needed": F.when(no_time, derive.visit_length(kind, name)).otherwise(
            F.col("time_needed")),
        kind: F.coalesce("_kind", kind),
        "is_scoreable": F.coalesce(F.col("_kind").isin(*vocab.SCOREABLE_TYPES), F.lit(False)),
    }).drop("_old_nearby", "_kind")


def heuristic_fill(df: DataFrame, entity: DataFrame, key: str, rep: str, tier: str, links: str,
                   amount: str, tag: str = "wikidata_heuristic") -> DataFrame:
    """Fill reputation and collection tier from an entity table, each with its source tag."""
    joined = groups.lookup(df, entity.select(key, links, amount), [key])
    new_rep, new_tier = derive.reputation_of_links(links), derive.tier_of_size(amount)
    return joined.withColumns({
        f"{rep}_source": F.when(F.col(rep).isNull() & new_rep.isNotNull(), tag),
        f"{tier}_source": F.when(F.col(tier).isNull() & new_tier.isNotNull(), tag),
        rep: F.coalesce(rep, new_rep).cast("int"), tier: F.coalesce(tier, new_tier).cast("int"),
    }).drop(links, amount)


def scoring_outcome(s: ScoreColumns, scoreable: str, stored: Column, version: str = "v2",
                    force: bool = False) -> Column:
    """not_art, already_scored, cannot_score or scored."""
    done = F.lit(False) if force else stored.isNotNull()
    return (F.when(~derive.is_art("flag", flag_col=scoreable), "not_art")
            .when(done, "already_scored")
            .when(~scoring.can_score(s, version), "cannot_score").otherwise("scored"))


def score_records(df: DataFrame, s: ScoreColumns, scoreable: str, version: str = "v2",
                  force: bool = False) -> DataFrame:
    """Write priority, quality and focus of newly scored records; adds the run outcome.

    Expects `priority_score`, `overall_quality_score`, `primary_art` and `scoring_version`.
    """
    outcome = scoring_outcome(s, scoreable, F.col("priority_score"), version, force)
    marked = df.withColumn("outcome", outcome)
    now = F.col("outcome") == "scored"
    focus = scoring.primary_focus(s, "phase")
    return marked.withColumns({
        "priority_score": F.when(now, scoring.priority(s, version)).otherwise(
            F.col("priority_score")),
        "overall_quality_score": F.when(now, scoring.quality(s, version)).otherwise(
            F.col("overall_quality_score")),
        "primary_art": F.when(now, F.coalesce(focus, F.col("primary_art"))).otherwise(
            F.col("primary_art")),
        "scoring_version": F.when(now, f"mrd_{version}").otherwise(F.col("scoring_version"))})


def ingest_roster(records: DataFrame, roster: DataFrame, roles: Mapping[str, str], row_no: str,
                  as_of: Column | str, source_tag: str, note: str,
                  null_fields: Mapping[str, str] | None = None,
                  keep: Sequence[str] = ()) -> DataFrame:
    """Stubs for roster rows that match no record and no earlier stub of the batch.

    `roles` names block (file region), state, name, city and url of the roster; `records` has
    them as state_code, state_province, museum_name, city and website; `keep` are roster columns
    that the stubs carry along.
    """
    known = {"block": "state_code", "state": "state_province", "name": "museum_name",
             "city": "city", "url": "website"}
    fresh = linkage.unmatched_roster(roster, records, roles, known)
    kept = dedupe.greedy_dedupe(fresh, roles, row_no)
    return merge.make_stubs(kept, roles, as_of, source_tag, note, null_fields, keep)


def apply_identity(df: DataFrame, identity: DataFrame, key: str, as_of: Column | str,
                   force: bool = False, tag: str = "google_places_api") -> DataFrame:
    """Overwrite the address of records that need resolution with a successful lookup.

    `identity` has one row per key: success, city, street_address, postal_code, latitude,
    longitude, place_id, phone. Records with a plausible city are skipped; a lookup without
    success leaves the record alone. Adds `outcome`.
    """
    fields = ("city", "street_address", "postal_code", "latitude", "longitude", "place_id", "phone")
    found = identity.select(key, F.col("success").alias("_ok"),
                            *[F.col(f).alias(f"_n_{f}") for f in fields])
    joined = groups.lookup(df, found, [key])
    need = derive.needs_resolution("city", force)
    ok = F.coalesce(F.col("_ok"), F.lit(False)) & (F.coalesce("_n_city", F.lit("")) != "")
    outcome = F.when(~need, "skipped").when(ok, "updated").otherwise("failed")
    hit = joined.withColumn("outcome", outcome)
    now = F.col("outcome") == "updated"
    out = merge.overwrite_known(hit, {f: F.when(now, F.col(f"_n_{f}")) for f in fields})
    return out.withColumns({
        "address_source": F.when(now, "google_places").otherwise(F.col("address_source")),
        "address_last_verified": F.when(now, text.as_col(as_of)).otherwise(
            F.col("address_last_verified")),
        "data_sources": F.when(now, merge.add_tag("data_sources", tag)).otherwise(
            F.col("data_sources")),
    }).drop("_ok", *[f"_n_{f}" for f in fields])


EXTERNAL_ROLES = {
    # fixed values: column names of the external table
    "id": "Museum ID", "phone": "Phone Number", "type": "Museum Type", "lat": "Latitude",
    "lon": "Longitude", "street": "Street Address (Physical Location)",
    "street_admin": "Street Address (Administrative Location)",
    "city": "City (Physical Location)", "city_admin": "City (Administrative Location)",
    "zip": "Zip Code (Physical Location)", "zip_admin": "Zip Code (Administrative Location)",
    "income": "Income", "revenue": "Revenue",
}


def link_external(df: DataFrame, external: DataFrame, row_no: str, as_of: Column | str,
                  name: str = "museum_name", state: str = "state_province",
                  external_name: str = "Museum Name",
                  external_state: str = "State (Administrative Location)",
                  roles: Mapping[str, str] = EXTERNAL_ROLES, force: bool = False,
                  tag: str = "museums_csv", threshold: float = 0.70) -> DataFrame:
    """Fill records from the best row of an external table in the same state.

    Fills only missing fields (coordinates as a pair, the address only over a blank or weak
    source), appends provenance sentences and the source tag. Records that carry the tag are
    skipped unless forced. Adds `outcome` (exact, fuzzy, no_match, skipped), `match_score` and
    `filled_fields`.
    """
    typed = merge.external_fields(roles)
    right = external.select(row_no, F.col(external_state).alias("_st"),
                            F.col(external_name).alias("_title"),
                            *[c.alias(n) for n, c in typed.items()])
    done = F.lit(False) if force else derive.is_done_source("data_sources", tag)
    left = df.withColumns({"_done": done,
                           "_st": F.when(~done, derive.region_code(state, None))})
    hit = linkage.fuzzy_match(left, right, "_st", name, "_title", row_no, list(typed), threshold)
    new = {n: f"match_{n}" for n in typed}
    out = merge.fill_missing(
        hit, {"phone": new["ext_phone"], "museum_type": new["ext_type"], "city": new["ext_city"],
              "postal_code": new["ext_zip"]}, "write", changed="filled_fields")
    before = out.withColumns({"_lat": F.col("latitude"), "_street": F.col("street_address")})
    out = merge.pair_fill(before, "latitude", "longitude", new["ext_lat"], new["ext_lon"])
    out = merge.guarded_fill(out, "street_address", "address_source", "address_last_verified",
                             new["ext_street"], tag, as_of)
    sentences = merge.source_sentences(
        "CSV", "IRS 990", *[F.col(new[f"ext_{k}"]) for k in (
            "id", "phone", "type", "lat", "lon", "street", "income", "revenue")])
    matched = F.col("match_type").isNotNull()
    return out.withColumns({
        "filled_fields": F.concat("filled_fields", merge.change_list({
            "latitude": F.col("_lat").isNull() & F.col("latitude").isNotNull(),
            "longitude": F.col("_lat").isNull() & F.col("latitude").isNotNull(),
            "street_address": ~F.col("_street").eqNullSafe(F.col("street_address"))})),
        "notes": F.when(matched, merge.append_sentences("notes", sentences)).otherwise(
            F.col("notes")),
        "data_sources": F.when(matched, merge.add_tag("data_sources", tag)).otherwise(
            F.col("data_sources")),
        "outcome": F.when(F.col("_done"), "skipped").otherwise(
            F.coalesce("match_type", F.lit("no_match")))
    }).drop("_st", "_done", "_lat", "_street", "match_type", *new.values())


def link_sheet(df: DataFrame, sheet: DataFrame, row_no: str, payload: Sequence[str],
               modified_at: Column, as_of: Column, name: str = "museum_name",
               sheet_name: str = "museum_name", stamp: str = "planner_data_updated_at",
               prefix: str = "planner_", force: bool = False,
               tag: str = "museum_planner_spreadsheet") -> DataFrame:
    """Write changed values of a curated sheet into `{prefix}{field}` columns.

    A record synced after the sheet was last modified is skipped unless forced. Only records
    with a real change are stamped and tagged. Adds `outcome` and `changed_fields`.
    """
    hit = linkage.sheet_match(df, name, sheet, sheet_name, row_no, list(payload))
    current = F.lit(False) if force else F.coalesce(F.col(stamp) >= modified_at, F.lit(False))
    active = hit.withColumn("_go", F.col("match_type").isNotNull() & ~current)
    out = merge.change_only(
        active, {f"{prefix}{f}": F.when(F.col("_go"), F.col(f"sheet_{f}")) for f in payload})
    changed = F.size("changed_fields") > 0
    return out.withColumns({
        stamp: F.when(changed, as_of).otherwise(F.col(stamp)),
        "data_sources": F.when(changed, merge.add_tag("data_sources", tag)).otherwise(
            F.col("data_sources")),
        "outcome": F.when(F.col("match_type").isNull(), "not_found").when(~F.col("_go"), "current")
        .when(changed, "updated").otherwise("no_change"),
    }).drop("_go", "match_type", *[f"sheet_{f}" for f in payload])


def apply_scores(df: DataFrame, answers: DataFrame, key: str, response: str, model: str,
                 s: ScoreColumns = scoring.DEFAULT, scoreable: str = "is_scoreable",
                 force: bool = False) -> DataFrame:
    """Overwrite scores of eligible records with the validated answers of one model.

    `answers` has one response text per key. Derives the focus and the must-see flag of the
    records that received scores. Adds `outcome`.
    """
    fields = list(scoring.SCORE_RANGES)
    checked = scoring.validated_scores(answers.select(key, response, model), F.col(response))
    patch = checked.select(key, F.lit(True).alias("_answered"), F.col(model).alias("_model"),
                           F.get_json_object(text.json_object_in(response), "$").isNotNull()
                           .alias("_valid"),
                           *[F.col(f).alias(f"_n_{f}") for f in (*fields, "score_notes")])
    joined = groups.lookup(df, patch, [key])
    done = F.lit(False) if force else derive.any_set(s.imp, s.mod, s.hist, s.eca, s.cbs)
    valid = F.coalesce(F.col("_answered") & F.col("_valid"), F.lit(False))
    outcome = (F.when(~derive.is_art("flag", flag_col=scoreable), "skipped_not_art")
               .when(done, "skipped_already_scored").when(valid, "scored").otherwise("failed"))
    marked = joined.withColumn("outcome", outcome)
    now = F.col("outcome") == "scored"
    names = {f: f for f in (*fields, "score_notes")}
    out = merge.overwrite_known(marked, {
        **{f: F.when(now, F.col(f"_n_{n}")) for n, f in names.items()},
        "scored_by": F.when(now, F.col("_model"))})
    return out.withColumns({
        "primary_art_focus": F.when(now, F.coalesce(scoring.primary_focus(s, "patch"),
                                                    F.col("primary_art_focus")))
        .otherwise(F.col("primary_art_focus")),
        "must_see_candidate": F.when(now & scoring.must_see(s), F.lit(True)).otherwise(
            F.col("must_see_candidate")),
    }).drop("_answered", "_model", "_valid", *[f"_n_{n}" for n in names])


def build_index(df: DataFrame, id_col: str = "museum_id", city: str = "city",
                state: str = "state_province", domain: str = "primary_domain",
                s: ScoreColumns = scoring.DEFAULT, scores: bool = False) -> DataFrame:
    """Derived index columns: neighbour count, city tier, focus and, on request, v1 scores.

    Expects `city_tier`, `primary_art` and `scoring_version`; the count is always recomputed.
    """
    counted = groups.peers_in_city(df.drop(s.nearby), id_col, city, state, "index", s.nearby)
    art = derive.is_art("domain", domain_col=domain)
    out = counted.withColumns({
        "city_tier": F.coalesce("city_tier", derive.city_tier_listed(city)),
        "primary_art": F.when(art, F.coalesce("primary_art", scoring.primary_focus(s, "index")))})
    if not scores:
        return out
    return out.withColumn("priority_score", F.when(art, scoring.priority(s, "v1"))).withColumns({
        "is_scored": F.col("priority_score").isNotNull(),
        "scoring_version": F.when(F.col("priority_score").isNotNull(),
                                  F.coalesce("scoring_version", F.lit("v1.0")))
        .otherwise(F.col("scoring_version"))})


#: Fields of a record that phases fill and a new one starts without.
RUN_FIELDS = {
    "latitude": "double", "longitude": "double", "place_id": "string", "phone": "string", "notes": "string",
    "address_last_verified": "string", "city_tier": "int", "time_needed": "string", "nearby_count": "bigint",
    "planner_data_updated_at": "timestamp", "priority_score": "int", "overall_quality_score": "int",
    "primary_art": "string", "scoring_version": "string", "reputation": "int"}


def new_records(roster: DataFrame, known: DataFrame, roles: Mapping[str, str], row_no: str,
                as_of: Column) -> DataFrame:
    """The first step of the run, written: roster rows that are known or repeat each other go, the
    others become records with the fields that later phases fill."""
    return cut_lineage(ingest_roster(known, roster, roles, row_no, as_of.cast("string"), "seed",
                                     "Seeded from the roster.", RUN_FIELDS, [row_no]), "run-stubs")


def whole_run(start: DataFrame, row_no: str, identity: DataFrame, external: DataFrame, sheet: DataFrame,
              sheet_modified: Column, payload: Sequence[str], score_inputs: Mapping[str, Column],
              s: ScoreColumns, as_of: Column, skip: Sequence[str] = ()) -> DataFrame:
    """The run from the `new_records` of a roster to their index, phase after phase.

    Addresses by `identity` (keyed by the roster's row number), derived fields, the best row of the
    external table, changed values of the sheet (`payload`), scores from `score_inputs`, and the
    index. Each phase's result is written, so a phase that is lost is not computed from the start.
    The outcome of every phase stays as `{phase}_outcome`.
    """
    def outcome_of(phase: str, df: DataFrame) -> DataFrame:
        return cut_lineage(df.withColumnRenamed("outcome", f"{phase}_outcome"), f"run-{phase}")

    steps = [
        ("identity", lambda d: outcome_of("identity", apply_identity(d, identity, row_no, as_of.cast("string")))),
        ("backbone", lambda d: cut_lineage(backbone(
            d, row_no, "city", "state_province", "museum_type", "museum_name").drop("updated_fields"), "run-backbone")),
        ("external", lambda d: outcome_of("external", link_external(d, external, row_no, as_of.cast("string")).drop(
            "filled_fields", "match_score"))),
        ("sheet", lambda d: outcome_of("sheet", link_sheet(
            d, sheet, row_no, payload, sheet_modified, as_of.cast("timestamp")).drop("changed_fields"))),
        ("scores", lambda d: outcome_of("scores", score_records(
            d.withColumns({**score_inputs, "run_scoreable": F.lit(True)}), s, "run_scoreable"))),
        ("index", lambda d: build_index(d, row_no, "city", "state_province", "run_domain", s))]
    unfilled = {f"planner_{f}": F.lit(None).cast(dict(sheet.dtypes)[f]) for f in payload}
    return run_phases(start.withColumns({**unfilled, "run_domain": F.lit("Art")}), steps, skip).drop(
        "run_domain", "run_scoreable")


def run_phases(df: DataFrame, phases: Sequence[Phase], skip: Sequence[str] = ()) -> DataFrame:
    """Apply the phases in order as one lazy plan; names in `skip` are left out."""
    for name, phase in phases:
        if name not in skip:
            df = phase(df)
    return df
