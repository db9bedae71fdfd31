"""Derived categories: type, visit length, city tier, region, gates, heuristics, labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab
from .text import ColumnLike, as_col, contains_any, is_missing, strip


def lookup(c: Column, mapping: Mapping | Sequence[tuple]) -> Column:
    """Constant-map lookup; unknown keys give null."""
    pairs = mapping.items() if isinstance(mapping, Mapping) else mapping
    lits = [F.lit(x) for pair in pairs for x in pair]
    return F.try_element_at(F.create_map(*lits), c)


def first_case(cases: Sequence[tuple[Column, Column]], default: Column) -> Column:
    """Ordered CASE: the first condition that holds decides."""
    out = F.when(*cases[0])
    for cond, value in cases[1:]:
        out = out.when(cond, value)
    return out.otherwise(default)


def _reachable(pairs: Sequence[tuple[str, str]]) -> list[tuple[str, str]]:
    """Containment rules that can still fire: none that contains an earlier rule's key."""
    keys = [k for k, _ in pairs]
    return [(k, v) for i, (k, v) in enumerate(pairs) if not any(e in k for e in keys[:i])]


def normalize_type(c: ColumnLike, title_case: bool = False) -> Column:
    """Exact map entry, else the first map key contained in the text, else the text itself."""
    text, low = strip(c), F.lower(as_col(c))
    contained = [(low.contains(k), F.lit(v)) for k, v in _reachable(vocab.TYPE_MAP)]
    kept = F.initcap(text) if title_case else text
    out = F.coalesce(lookup(F.lower(text), vocab.TYPE_MAP), first_case(contained, kept))
    return F.when(as_col(c) != "", out)


def is_scoreable_type(c: ColumnLike) -> Column:
    return F.coalesce(normalize_type(c).isin(*vocab.SCOREABLE_TYPES), F.lit(False))


def is_art(kind: str, type_col: ColumnLike | None = None, domain_col: ColumnLike | None = None,
           flag_col: ColumnLike | None = None) -> Column:
    """Eligibility gates: `type`, `flag`, `keyword`, `domain`, `domain_or_type`."""
    no = F.lit(False)
    if kind == "type":
        return is_scoreable_type(type_col)
    if kind == "flag":
        return F.coalesce(as_col(flag_col), no)
    if kind == "keyword":
        low = F.lower(F.coalesce(as_col(type_col), F.lit("")))
        return contains_any(low, vocab.ART_KEYWORDS)
    if kind == "domain":
        return F.coalesce(as_col(domain_col) == "Art", no)
    if kind == "domain_or_type":
        return F.coalesce(as_col(domain_col) == "Art", no) | F.coalesce(
            F.lower(as_col(type_col)).contains("art"), no)
    raise ValueError(f"unknown gate {kind!r}")


def model_tier(type_col: ColumnLike) -> Column:
    return F.when(is_art("keyword", type_col), "premium").otherwise("standard")


def visit_length(type_col: ColumnLike, name_col: ColumnLike) -> Column:
    """Keyword rules over type and name, in declared order; everything else is a half day."""
    text = F.lower(F.concat_ws(" ", as_col(type_col), as_col(name_col)))
    cases = [(contains_any(text, words), F.lit(v)) for v, words in vocab.VISIT_KEYWORDS]
    return first_case(cases, F.lit(vocab.HALF))


def normalize_visit_length(c: ColumnLike) -> Column:
    return lookup(F.lower(strip(c)), vocab.VISIT_SYNONYMS)


def city_tier(city: ColumnLike, population: ColumnLike | None = None,
              tier_1: Sequence[str] = vocab.TIER_1_CITIES,
              tier_2: Sequence[str] = vocab.TIER_2_CITIES,
              thresholds: tuple[int, int] = vocab.TIER_POPULATION) -> Column:
    """Manual lists first, then population, then the smallest tier."""
    name = strip(city)
    out = F.when(name.isin(*tier_1), 1).when(name.isin(*tier_2), 2)
    if population is not None:
        pop = as_col(population)
        out = out.when(pop >= thresholds[0], 1).when(pop >= thresholds[1], 2)
    return out.otherwise(3)


def city_tier_listed(city: ColumnLike) -> Column:
    """Index variant: lists only; a placeholder city has no tier."""
    tier = city_tier(city, None, vocab.INDEX_TIER_1_CITIES, vocab.INDEX_TIER_2_CITIES)
    return F.when(~is_missing(city, ("", "unknown", "tbd")), tier)


def region_code(state: ColumnLike, foreign: str | None = vocab.FOREIGN_CODE) -> Column:
    codes = {k.lower(): v for k, v in vocab.US_STATES.items()}
    code = lookup(F.lower(strip(state)), codes)
    return F.coalesce(code, F.lit(foreign)) if foreign else code


def region_name(state: ColumnLike) -> Column:
    known = F.lower(strip(state)).isin(*[k.lower() for k in vocab.US_STATES])
    return F.when(F.coalesce(known, F.lit(False)), as_col(state)).otherwise(
        F.lit(vocab.FOREIGN_NAME))


def needs_resolution(city: ColumnLike, force: bool = False) -> Column:
    """Missing or placeholder city, or a city that is really a state name."""
    if force:
        return F.lit(True)
    return is_missing(city, "resolve") | F.coalesce(
        strip(city).isin(*vocab.STATE_NAMES), F.lit(False))


def in_scope(code: ColumnLike, id_: ColumnLike, states: str | Sequence[str] | None = None,
             entity: str | None = None) -> Column:
    """Scope of a run: one entity, a list of regions, or every two-letter region.

    A single entity also pins the region in its id, so a table partitioned by region is pruned.
    """
    code = as_col(code)
    if entity is not None:
        region = entity.split("-")
        if len(region) < 2:
            raise ValueError(f"not an entity id: {entity!r}")
        return (code == region[1].upper()) & (as_col(id_) == entity)
    if states is not None:
        names = states.split(",") if isinstance(states, str) else states
        return code.isin(*[s.strip().upper() for s in names])
    return code.rlike("^[A-Za-z]{2}$")


def is_done_source(sources: ColumnLike, tag: str) -> Column:
    return F.coalesce(F.array_contains(as_col(sources), tag), F.lit(False))


def any_set(*cols: ColumnLike) -> Column:
    return reduce(lambda a, b: a | b, [as_col(c).isNotNull() for c in cols])


def all_given(*cols: ColumnLike) -> Column:
    """Every content field holds a non-empty string."""
    return reduce(lambda a, b: a & b, [F.coalesce(as_col(c) != "", F.lit(False)) for c in cols])


def skip_or_todo(done: Column, force: bool = False) -> Column:
    """`skip` for records that are done, unless forced."""
    return F.when(F.lit(not force) & F.coalesce(done, F.lit(False)), "skip").otherwise("todo")


def current_or_process(last_sync: ColumnLike, modified_at: Column, force: bool = False) -> Column:
    """`current` when the last sync, a time as text, is not before the source's modification.

    A missing or unreadable time means `process`, and so does `force`.
    """
    last = F.try_to_timestamp(as_col(last_sync))
    fresh = F.coalesce(last >= modified_at, F.lit(False))
    return F.when(F.lit(not force) & fresh, "current").otherwise("process")


# -- address components, claims ----------------------------------------------

def component(components: ColumnLike, kind: str, part: str = "long_name") -> Column:
    """First address component of a kind; `components` is array<struct<long_name,…,types>>."""
    hits = F.filter(as_col(components), lambda x: F.array_contains(x["types"], kind))
    return F.get(hits, 0)[part]


def component_city(components: ColumnLike) -> Column:
    return F.coalesce(*[component(components, k) for k in vocab.CITY_COMPONENTS])


def state_mismatch(state_name: ColumnLike, component_code: ColumnLike) -> Column:
    """True when the address says another region (full name → code, never its first letters)."""
    text = strip(state_name)
    expected = F.coalesce(region_code(text, None), F.upper(text))
    return F.coalesce(F.upper(as_col(component_code)) != expected, F.lit(False))


def claim_value(claims: ColumnLike, prop: str) -> Column:
    """First non-null value of a property in a map<string, array<…>>."""
    values = F.try_element_at(as_col(claims), F.lit(prop))
    return F.get(F.filter(values, lambda v: v.isNotNull()), 0)


def reputation_of_links(n_links: ColumnLike) -> Column:
    n = as_col(n_links)
    return F.when(n >= 50, 0).when(n >= 10, 1).when(n >= 3, 2)


def tier_of_size(amount: ColumnLike) -> Column:
    """Collection tier from a size claim such as `+12000`; not a number gives null."""
    size = F.floor(F.regexp_replace(as_col(amount), r"^\++", "").try_cast("double"))
    return F.when(size >= 100_000, 0).when(size >= 10_000, 1).when(size >= 1_000, 2).when(
        size.isNotNull(), 3)


def documented_reputation(name: ColumnLike, tier: ColumnLike) -> Column:
    return F.when(as_col(name).contains("National"), 1).when(as_col(tier) == 1, 2).otherwise(3)


def documented_collection_tier(type_col: ColumnLike, tier: ColumnLike) -> Column:
    t = as_col(type_col)
    return F.when(t.contains("National") | t.contains("State"), 1).when(
        as_col(tier) <= 2, 2).otherwise(3)


# -- labels -------------------------------------------------------------------

def label(c: ColumnLike, labels: Mapping[int, str], default: str | None = None) -> Column:
    out = lookup(as_col(c).cast("int"), labels)
    return out if default is None else F.coalesce(out, F.lit(default))


def score_label(c: ColumnLike) -> Column:
    s = as_col(c)
    # fixed values: score bands
    bands = [(9, "World-Class"), (8, "Outstanding"), (7, "Excellent"), (6, "Very Good"),
             (5, "Good")]
    cases = [(F.coalesce(s, F.lit(0)) == 0, F.lit("Not Rated"))]
    cases += [(s >= lo, F.lit(name)) for lo, name in bands]
    return first_case(cases, F.lit("Modest"))


def article_class(found: ColumnLike, extract: ColumnLike,
                  wrong_words: Sequence[str] = ("airport", "station")) -> Column:
    """Quality of a cached article: none, city (place page), wrong, good."""
    low = F.lower(F.coalesce(as_col(extract), F.lit("")))
    head = F.substring(low, 1, 200)
    place = head.contains("city") & F.substring(low, 1, 400).contains("population")
    return (F.when(~F.coalesce(as_col(found), F.lit(False)), "none").when(place, "city")
            .when(contains_any(head, wrong_words), "wrong").otherwise("good"))


def gap_reason(notes: ColumnLike) -> Column:
    low = F.lower(F.coalesce(as_col(notes), F.lit("")))
    # fixed values: words of each reason
    return (F.when(contains_any(low, ("wrong", "airport", "instrument")), "wrong_entity")
            .when(low.contains("city") & low.contains("not the museum"), "city_only")
            .when(low.contains("no") & contains_any(low, ("collection", "permanent")),
                  "no_collection").otherwise("other"))
