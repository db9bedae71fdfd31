"""Evidence packets and text contexts built from a record and its joined caches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import derive, vocab
from ..functions.text import as_col


def _given(c: Column | str) -> Column:
    return F.nullif(as_col(c), F.lit(""))


def public_notes(notes: Column | str, internal: Column | str | None = None, n: int = 500) -> Column:
    """Notes only when free of import traces and internal remarks, cut to `n` characters."""
    c = _given(notes)
    clean = ~c.contains("CSV:") & ~F.lower(c).contains("internal")
    return F.when(clean, F.substring(c, 1, n))


def _packed(fields: Mapping[str, Column]) -> Column:
    """Struct of the fields, or null when every field is null."""
    some = F.coalesce(*[c.cast("string") for c in fields.values()])
    return F.when(some.isNotNull(), F.struct(*[c.alias(n) for n, c in fields.items()]))


def evidence_packet(p: Mapping[str, str], articles: str | None = None) -> Column:
    """JSON packet of the judgment-relevant fields; nulls and empty groups are left out.

    `p` maps the roles name, city, state, type, domain, topics, reputation, tier, city_tier,
    nearby, website, notes (and found, extract, page_url of the joined article) to columns.
    """
    ok = F.coalesce(F.col(p["found"]), F.lit(False)) & F.coalesce(F.col(p["extract"]) != "",
                                                                  F.lit(False))
    city_tier = F.nullif(F.col(p["city_tier"]), F.lit(0))
    topics = F.when(F.size(p["topics"]) > 0, F.col(p["topics"]))
    return F.to_json(F.struct(
        F.col(p["name"]).alias("museum_name"), F.col(p["city"]).alias("city"),
        F.col(p["state"]).alias("state"), F.col(p["type"]).alias("museum_type"),
        F.col(p["domain"]).alias("primary_domain"),
        F.when(ok, F.col(p["extract"])).alias("wikipedia_summary"),
        F.when(ok, _given(p["page_url"])).alias("wikipedia_url"),
        topics.alias("topics"),
        _packed({"prior_reputation": F.col(p["reputation"]),
                 "prior_collection_tier": F.col(p["tier"])}).alias("existing_assessments"),
        _packed({"city_tier": city_tier, "nearby_museums": F.col(p["nearby"])})
        .alias("institutional_signals"),
        _given(p["website"]).alias("website"), public_notes(p["notes"]).alias("notes")))


def text_context(parts: Sequence[Column], default: str = "Limited information available") -> Column:
    """Ordered parts joined by blank lines; `default` when nothing is known."""
    known = F.filter(F.array(*parts), lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.array_join(known, "\n\n")).otherwise(F.lit(default))


def labelled(prefix: str, c: Column | str, n: int | None = None) -> Column:
    value = _given(c)
    value = F.substring(value, 1, n) if n else value
    return F.concat(F.lit(prefix), value)


def characteristics(p: Mapping[str, str]) -> Column:
    """`Type: … | Reputation: … | …` from the roles type, reputation, collection, eca, must_see."""
    def named(prefix: str, c: str, labels: Mapping[int, str]) -> Column:
        return F.when(F.col(c).isNotNull(),
                      F.concat(F.lit(prefix), derive.label(c, labels, "Unknown")))

    parts = F.array(
        labelled("Type: ", p["type"]),
        named("Reputation: ", p["reputation"], vocab.REPUTATION_LABELS),
        named("Collection: ", p["collection"], vocab.CONTEXT_COLLECTION_LABELS),
        named("Curatorial Authority: ", p["eca"], vocab.ECA_LABELS),
        F.when(F.col(p["must_see"]), F.lit("★ Must-See Candidate")))
    return F.nullif(F.array_join(F.array_compact(parts), " | "), F.lit(""))


def visitor_info(hours: Column, adult_fee: Column, accessibility: Column) -> Column:
    """One line on what a visitor can look up; null when nothing is known."""
    facts = F.array(F.when(hours, F.lit("Hours available")),
                    F.concat(F.lit("Admission: "), _given(adult_fee)),
                    F.when(accessibility, F.lit("Accessibility features documented")))
    known = F.nullif(F.array_join(F.array_compact(facts), ", "), F.lit(""))
    return F.concat(F.lit("Visitor Info: "), known)


def record_context(p: Mapping[str, str], visitor: Column | None = None) -> Column:
    """Everything known about a record, in fixed order, as one text.

    Roles: description, about (cut at 500), extract (cut at 600), wikidata, and those of
    `characteristics`.
    """
    parts = [labelled("Website Description: ", p["description"]),
             labelled("About: ", p["about"], 500), labelled("Wikipedia: ", p["extract"], 600),
             labelled("Wikidata: ", p["wikidata"])]
    if visitor is not None:
        parts.append(visitor)
    return text_context([*parts, characteristics(p)])


def scoring_gate(df: DataFrame, key: str, articles: DataFrame, sites: DataFrame, domain: str,
                 scoreable: str) -> DataFrame:
    """Records that may be scored: art, scoreable, with an article and site content."""
    ok = derive.is_art("domain", domain_col=domain) & F.coalesce(F.col(scoreable), F.lit(False))
    return (df.filter(ok).join(articles.select(key).distinct(), key, "left_semi")
            .join(sites.select(key).distinct(), key, "left_semi"))


def content_gate(quality: Column, complete: Column, manual: Column, floor: int = 14) -> Column:
    no = F.lit(False)
    return (F.coalesce(quality >= floor, no) & complete) | F.coalesce(manual, no)
