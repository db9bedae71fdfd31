"""Merging a patch into a record: fill, overwrite, never-null, change-only, trust order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import derive, text, vocab

Patch = Mapping[str, Column | str]


def _types(df: DataFrame) -> dict[str, str]:
    return dict(df.dtypes)


def _col(c: Column | str) -> Column:
    return text.as_col(c)


def fill_missing(df: DataFrame, patch: Patch, placeholders: str = "fill",
                 changed: str | None = None) -> DataFrame:
    """Patch only fields that are null or placeholders; optionally list the filled fields."""
    types = _types(df)
    hits = {f: text.missing_of_type(f, types[f], placeholders) & _col(v).isNotNull()
            for f, v in patch.items()}
    out = {f: F.when(hits[f], _col(v)).otherwise(F.col(f)) for f, v in patch.items()}
    if changed:
        out[changed] = change_list(hits)
    return df.withColumns(out)


def overwrite_known(df: DataFrame, patch: Patch) -> DataFrame:
    """A non-null patch value replaces the field."""
    return df.withColumns({f: F.coalesce(_col(v), F.col(f)) for f, v in patch.items()})


def never_null_known(df: DataFrame, patch: Patch, placeholders: str = "fill",
                     rejected: str = "rejected") -> DataFrame:
    """Known values stay; missing ones take the patch, even null. Lists rejected fields."""
    types = _types(df)
    open_ = {f: text.missing_of_type(f, types[f], placeholders) for f in patch}
    out = {f: F.when(open_[f], _col(v)).otherwise(F.col(f)) for f, v in patch.items()}
    out[rejected] = change_list({f: ~open_[f] for f in patch})
    return df.withColumns(out)


def change_only(df: DataFrame, patch: Patch, changed: str = "changed_fields") -> DataFrame:
    """Write a non-null value only where it differs; lists the fields that changed."""
    diff = {f: _col(v).isNotNull() & ~_col(v).eqNullSafe(F.col(f)) for f, v in patch.items()}
    out = {f: F.when(diff[f], _col(v)).otherwise(F.col(f)) for f, v in patch.items()}
    out[changed] = change_list(diff)
    return df.withColumns(out)


def truthy_overlay(df: DataFrame, patch: Patch, patch_types: Mapping[str, str]) -> DataFrame:
    """A truthy patch value replaces the field."""
    return df.withColumns({
        f: F.when(text.truthy(v, patch_types[f]), _col(v)).otherwise(F.col(f))
        for f, v in patch.items()})


def pair_fill(df: DataFrame, lat: str, lon: str, new_lat: Column | str, new_lon: Column | str,
              independent: bool = False) -> DataFrame:
    """Coordinates: both or nothing, or (`independent`) each on its own."""
    new_lat, new_lon = _col(new_lat), _col(new_lon)
    if independent:
        return df.withColumns({lat: F.coalesce(F.col(lat), new_lat),
                               lon: F.coalesce(F.col(lon), new_lon)})
    take = (F.col(lat).isNull() & F.col(lon).isNull() & new_lat.isNotNull()
            & new_lon.isNotNull())
    return df.withColumns({lat: F.when(take, new_lat).otherwise(F.col(lat)),
                           lon: F.when(take, new_lon).otherwise(F.col(lon))})


def guarded_fill(df: DataFrame, field: str, source: str, verified: str, value: Column | str,
                 new_source: str, as_of: Column | str, weak: Sequence[str] = ("narm",),
                 placeholders: str = "write") -> DataFrame:
    """Fill a field only if its source is blank or weak; stamps source and date."""
    value = _col(value)
    weak_source = F.coalesce(F.col(source), F.lit("")).isin("", *weak)
    take = weak_source & text.is_missing(field, placeholders) & F.coalesce(value != "", F.lit(False))
    return df.withColumns({
        field: F.when(take, value).otherwise(F.col(field)),
        source: F.when(take, F.lit(new_source)).otherwise(F.col(source)),
        verified: F.when(take, _col(as_of)).otherwise(F.col(verified))})


def change_list(flags: Mapping[str, Column]) -> Column:
    """Array of the names whose flag holds, in declared order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(f)) for f, c in flags.items()]))


def add_tag(tags: Column | str, tag: str) -> Column:
    """Append a tag unless it is there; null counts as the empty list."""
    arr = F.coalesce(_col(tags), F.array().cast("array<string>"))
    return F.when(F.array_contains(arr, tag), arr).otherwise(F.array_append(arr, tag))


def append_sentences(notes: Column | str, sentences: Sequence[Column]) -> Column:
    """Append sentences that are not null and not yet contained (so a rerun changes nothing)."""
    notes = F.coalesce(_col(notes), F.lit(""))
    fresh = [F.when(~notes.contains(s), s) for s in sentences]
    return F.nullif(F.concat_ws(" ", F.nullif(notes, F.lit("")), *fresh), F.lit(""))


def source_sentences(prefix: str, database: str, id_: Column, phone: Column, kind: Column,
                     lat: Column, lon: Column, address: Column, income: Column,
                     revenue: Column) -> list[Column]:
    """Provenance sentences for a linked external row; absent facts give null.

    The sentences are fixed values: reruns and readers look for them.
    """
    def when(c: Column, *parts: Column | str) -> Column:
        return F.when(c.isNotNull() & (c.cast("string") != ""), F.concat(*[
            F.lit(p) if isinstance(p, str) else p for p in parts]))

    money = F.concat(
        F.lit(f"{prefix}: financial data available (income: "), F.coalesce(income, F.lit("N/A")),
        F.lit(", revenue: "), F.coalesce(revenue, F.lit("N/A")), F.lit(")"))
    has_point = (F.coalesce(lat, F.lit(0.0)) != 0) & (F.coalesce(lon, F.lit(0.0)) != 0)
    return [
        when(id_, f"{prefix}: IRS Museum ID ", id_),
        when(phone, f"{prefix}: phone from {database} database"),
        when(kind, f"{prefix}: museum type '", kind, "'"),
        F.when(has_point, F.lit(f"{prefix}: coordinates from {database} database")),
        when(address, f"{prefix}: physical address from {database}"),
        F.when(F.coalesce(income, revenue).isNotNull(), money),
    ]


def external_fields(p: Mapping[str, str]) -> dict[str, Column]:
    """Typed fields of an external row: physical before administrative, blank as null.

    `p` maps the roles id, phone, type, lat, lon, street, street_admin, city, city_admin,
    zip, zip_admin, income, revenue to column names. Coordinates count only as a pair.
    """
    def first(*roles: str) -> Column:
        return F.coalesce(*[text.blank_to_null(p[r]) for r in roles])

    lat, lon = (text.strip(p[k]).try_cast("double") for k in ("lat", "lon"))
    both = lat.isNotNull() & lon.isNotNull()
    return {
        "ext_id": first("id"), "ext_phone": first("phone"),
        "ext_type": derive.normalize_type(first("type"), title_case=True),
        "ext_lat": F.when(both, lat), "ext_lon": F.when(both, lon),
        "ext_street": first("street", "street_admin"), "ext_city": first("city", "city_admin"),
        "ext_zip": first("zip", "zip_admin"), "ext_income": first("income"),
        "ext_revenue": first("revenue"),
    }


# -- trust --------------------------------------------------------------------

def _trust_order(value: str, trust: str, ts: str, current: str, locked: str, tie: str,
                 placeholders: str) -> Column:
    known = (~text.is_missing(value, placeholders)).cast("int")
    veto = (F.col(current) & F.coalesce(F.col(locked), F.lit(False))).cast("int")
    return F.struct(veto, known, F.col(trust), F.col(ts), F.col(current).cast("int"), F.col(tie))


def trust_merge(candidates: DataFrame, keys: Sequence[str], value: str, trust: str, ts: str,
                current: str, locked: str, tie: str, placeholders: str = "fill",
                extra: Sequence[str] = ()) -> DataFrame:
    """One winning value per key out of long-form candidates, by partial aggregation.

    A locked current value always wins; a known value beats a missing one; then trust; at equal
    trust a newer, non-placeholder value; then the current one; `tie` breaks what is left.
    """
    order = _trust_order(value, trust, ts, current, locked, tie, placeholders)
    picked = F.max_by(F.struct(value, trust, ts, current, *extra), order)
    return (candidates.groupBy(*keys).agg(picked.alias("_w"))
            .select(*keys, *[F.col(f"_w.{c}").alias(c) for c in (value, trust, ts, current, *extra)]))


def trust_merge_wide(candidates: DataFrame, key: str, field: str, fields: Sequence[str],
                     value: str, trust: str, ts: str, current: str, locked: str, tie: str,
                     placeholders: str = "fill") -> DataFrame:
    """The winners of `trust_merge` as one row per key, in a single aggregation."""
    order = _trust_order(value, trust, ts, current, locked, tie, placeholders)
    return candidates.groupBy(key).agg(*[
        F.max_by(value, F.when(F.col(field) == f, order)).alias(f) for f in fields])


def route_recommendation(confidence: Column | str, trust: Column | str, threshold: int = 4,
                         min_trust: int = vocab.TRUST_LEVELS["wikipedia"],
                         blocked: Column | None = None) -> Column:
    """`apply` when confidence and evidence trust are high enough, else `review`."""
    ok = F.coalesce((_col(confidence) >= threshold) & (_col(trust) >= min_trust), F.lit(False))
    if blocked is not None:
        ok = ok & ~blocked
    return F.when(ok, "apply").otherwise("review")


# -- stubs --------------------------------------------------------------------

STUB_TEXT = {
    # fixed values: defaults of a new record; every field not named here starts as null
    "status": "unknown", "street_address": "TBD", "postal_code": "TBD",
    "address_source": "unknown", "museum_type": "Unknown",
}


def make_stubs(rows: DataFrame, roles: Mapping[str, str], as_of: Column | str, source_tag: str,
               note: str, null_fields: Mapping[str, str] | None = None,
               keep: Sequence[str] = ()) -> DataFrame:
    """New records for unmatched roster rows. `roles`: state, name, city, url; `keep` names
    roster columns to carry along."""
    state, name, url = (F.col(roles[k]) for k in ("state", "name", "url"))
    home = derive.region_code(state, None)
    city = F.coalesce(text.blank_to_null(roles["city"]), F.lit("Unknown"))
    country = F.when(home.isNotNull(), "USA").otherwise(state)
    code = F.coalesce(home, F.lit(vocab.FOREIGN_CODE))
    cols = {
        "museum_id": text.entity_id(country, code, city, name), "country": country,
        "state_province": state, "state_code": code, "city": city, "museum_name": name,
        "website": url, **{k: F.lit(v) for k, v in STUB_TEXT.items()},
        "data_sources": F.array(F.lit(source_tag)), "row_notes_internal": F.lit(note),
        "created_at": _col(as_of), "updated_at": _col(as_of), "last_updated": _col(as_of),
        **{k: F.lit(None).cast(t) for k, t in (null_fields or {}).items()},
    }
    return rows.select(*keep, *[c.alias(n) for n, c in cols.items()])
