"""Completeness, rules, guards and integrity."""

from pyspark.sql import functions as F

from ..functions import scoring, vocab
from ..operators import quality
from .bindings import ART, CUST, art, cust, score_columns, tables
from .queries_scoring import P3
from .registry import query

S = score_columns()

# Full records over parts: every profile field has a column of the scored record.
_COLS = {
    "museum_id": "id", "country": "country", "state_province": "state", "city": "city",
    "museum_name": "name", "website": "website", "museum_type": "kind",
    "street_address": "address", "postal_code": "postal", "city_tier": "tier", "status": "status",
    "reputation": "rep", "collection_tier": "tier", "time_needed": "visit",
    "nearby_museum_count": "nearby", "notes": "notes", "data_sources": "sources",
    "confidence": "confidence", "primary_domain": "domain", "estimated_visit_minutes": "minutes",
    "impressionist_strength": "imp", "modern_contemporary_strength": "mod", "primary_art": "focus",
    "historical_context_score": "hist", "priority_score": "priority", "is_scored": "is_scored",
}
REC = f"""{ART}, rec AS (
  SELECT *, 'USA' AS country, CASE WHEN id % 13 = 0 THEN ' TBD' ELSE 'http://x.org/' || id END AS website,
    CASE WHEN id % 17 = 0 THEN 'Unknown' ELSE id || ' Main St' END AS address, '0' || id AS postal,
    CASE WHEN id % 19 = 0 THEN '' ELSE 'active' END AS status,
    CASE WHEN id % 3 = 0 THEN 'Half day' END AS visit, CASE WHEN id % 3 = 1 THEN 60 END AS minutes,
    CASE WHEN id % 23 = 0 THEN 'n/a' ELSE name END AS notes, id % 29 <> 0 AS has_sources,
    CASE WHEN imp >= mod THEN 'Impressionist' WHEN mod > imp THEN 'Modern/Contemporary' END AS focus,
    {P3} AS priority, confidence + CASE WHEN id % 31 = 0 THEN 9 ELSE 0 END AS conf
  FROM art
)"""
_SCHEMA_OK = ("lower(trim(website)) <> 'tbd' AND kind IS NOT NULL AND lower(address) <> 'unknown'")
_CORE_OK = ("status <> '' AND rep IS NOT NULL AND tier IS NOT NULL AND notes <> 'n/a' AND has_sources "
            "AND conf BETWEEN 1 AND 5")
_ART_OK = ("(coalesce(domain, '') <> 'Art' OR (imp IS NOT NULL AND mod IS NOT NULL AND focus IS NOT "
           "NULL AND hist IS NOT NULL AND priority IS NOT NULL))")


def rec(spark, path):
    k = F.col("id")
    sid = k.cast("string")
    imp, mod = F.col("imp"), F.col("mod")
    sources = F.when(k % 29 != 0, F.array(F.lit("seed"))).otherwise(F.array().cast("array<string>"))
    return art(spark, path).withColumns({
        "country": F.lit("USA"),
        "website": F.when(k % 13 == 0, " TBD").otherwise(F.concat(F.lit("http://x.org/"), sid)),
        "address": F.when(k % 17 == 0, "Unknown").otherwise(F.concat(sid, F.lit(" Main St"))),
        "postal": F.concat(F.lit("0"), sid),
        "status": F.when(k % 19 == 0, "").otherwise("active"),
        "visit": F.when(k % 3 == 0, "Half day"), "minutes": F.when(k % 3 == 1, 60),
        "notes": F.when(k % 23 == 0, "n/a").otherwise(F.col("name")), "sources": sources,
        "focus": F.when(imp >= mod, "Impressionist").when(mod > imp, "Modern/Contemporary"),
        "priority": scoring.priority(S),
        "confidence": F.col("confidence") + F.when(k % 31 == 0, 9).otherwise(0),
        "is_scored": scoring.priority(S).isNotNull()})


@query("k1_full_records", (
    f"WITH {REC} SELECT id, {_SCHEMA_OK} AND {_CORE_OK} AND visit IS NOT NULL AND nearby IS NOT NULL "
    f"AND {_ART_OK} AS full_progress, {_SCHEMA_OK} AND {_CORE_OK} AND domain IS NOT NULL AND (visit IS "
    "NOT NULL OR minutes IS NOT NULL) AS full_report FROM rec"))
def full_records(spark, path):
    df = rec(spark, path)
    return df.select(
        "id", quality.is_full(df, quality.progress_profile(_COLS, "domain")).alias("full_progress"),
        quality.is_full(df, quality.report_profile(_COLS)).alias("full_report"))


@query("k2_field_checks", (
    f"WITH {REC} SELECT id, has_sources AS has_tags, conf BETWEEN 1 AND 5 AS has_confidence, visit IS "
    "NOT NULL OR minutes IS NOT NULL AS has_time FROM rec"))
def field_checks(spark, path):
    return rec(spark, path).select(
        "id", quality.has_tags("sources").alias("has_tags"),
        quality.has_confidence("confidence").alias("has_confidence"),
        quality.has_time_estimate("visit", "minutes").alias("has_time"))


@query("k3_art_guard", (
    f"WITH {REC} SELECT id, 'domain' AS issue FROM rec WHERE domain = 'Science' UNION ALL SELECT id, "
    "'visit_length' FROM rec WHERE id % 3 = 2 UNION ALL SELECT id, 'scores_on_non_art' FROM rec WHERE "
    "NOT (coalesce(domain, '') = 'Art' OR scoreable) AND coalesce(imp, mod, hist) IS NOT NULL"))
def art_guard(spark, path):
    df = rec(spark, path).withColumns({
        "domain": F.when(F.col("domain") == "Science", "Sciences").otherwise(F.col("domain")),
        "visit": F.when(F.col("id") % 3 == 2, "3 days").otherwise(F.col("visit"))})
    return quality.art_guard_issues(df, "id", "domain", "visit", "scoreable", ["imp", "mod", "hist"])


@query("k4_roster_issues", (
    f"WITH {CUST}, r AS (SELECT id, state, name, coalesce(trim(raw_city), '') AS city, "
    "coalesce(trim(url), '') AS u FROM cust UNION ALL SELECT id + 10000000, state, upper(name), "
    "coalesce(trim(raw_city), ''), coalesce(trim(url), '') FROM cust WHERE balance > 9000) SELECT id, "
    "'ERROR' AS level, 'empty_url' AS issue FROM r WHERE u = '' UNION ALL SELECT id, 'ERROR', "
    "'invalid_url' FROM r WHERE u <> '' AND NOT regexp_matches(u, '(?i)^https?://[^/?#]+') UNION ALL "
    "SELECT id, 'WARN', 'trailing_bracket' FROM r WHERE u LIKE '%)' UNION ALL SELECT id, 'WARN', "
    "'percent_20' FROM r WHERE contains(u, '%20') UNION ALL SELECT id, 'WARN', 'duplicate' FROM (SELECT "
    "*, row_number() OVER (PARTITION BY lower(state), lower(name), lower(city) ORDER BY id) AS rk FROM "
    "r) WHERE rk > 1"))
def roster_issues(spark, path):
    c = cust(spark, path).select("id", "state", "name", "raw_city", "url", "balance")
    again = c.filter("balance > 9000").withColumns(
        {"id": F.col("id") + 10000000, "name": F.upper("name")})
    return quality.roster_issues(c.unionByName(again), "state", "name", "raw_city", "url", "id")


@query("k5_required_fields", (
    f"WITH {CUST} SELECT id, 'raw_city' AS field, 'required' AS rule FROM cust WHERE "
    "coalesce(trim(raw_city), '') = '' UNION ALL SELECT id, 'url', 'required' FROM cust WHERE url IS "
    "NULL"))
def required_fields(spark, path):
    rules = [quality.Rule(f, "required") for f in ("name", "region", "state", "raw_city", "url")]
    return quality.rule_issues(cust(spark, path), rules, ["id"])


@query("k5_container_fields", (
    f"WITH {CUST}, part AS (SELECT code || '-' || CAST(floor(id / 200) AS BIGINT) AS file, CASE WHEN code = "
    "'ZZ' THEN ' ' ELSE code END AS state_code, id, raw_city, url, row_number() OVER (PARTITION BY code, "
    "floor(id / 200) ORDER BY id) AS n FROM cust), box AS (SELECT DISTINCT file, state_code FROM part) "
    "SELECT file, 0 AS ordinal, 'state_code' AS field FROM box WHERE trim(state_code) = '' UNION ALL SELECT "
    "file, 0, 'last_updated' FROM box UNION ALL SELECT file, CAST(n AS INT), 'city' FROM part WHERE "
    "coalesce(trim(raw_city), '') = '' UNION ALL SELECT file, CAST(n AS INT), 'url' FROM part WHERE url IS "
    "NULL"))
def container_fields(spark, path):
    # containers of at most 200 records
    record = F.struct("id", F.col("raw_city").alias("city"), "url", "name")
    box = cust(spark, path).groupBy("code", F.floor(F.col("id") / 200).cast("bigint").alias("part")).agg(
        F.array_sort(F.collect_list(record)).alias("museums"))
    named = box.select(F.concat_ws("-", "code", F.col("part").cast("string")).alias("file"), "museums",
                       F.when(F.col("code") == "ZZ", " ").otherwise(F.col("code")).alias("state_code"),
                       F.lit(None).cast("string").alias("last_updated"))
    return quality.container_issues(named, "file", ["state_code", "last_updated"], "museums",
                                    ["id", "name", "city", "url"])


@query("k6_type_rule", (
    f"WITH {CUST} SELECT id, 'raw_city' AS field, 'type' AS rule FROM cust WHERE raw_city IS NOT NULL UNION "
    "ALL SELECT id, 'digits', 'type' FROM cust WHERE id % 3 = 0"))
def type_rule(spark, path):
    digits = F.when(F.col("id") % 3 == 0, "4,2").when(F.col("id") % 3 == 1, " 42 ")
    rules = [quality.Rule("raw_city", "type", ["int"]), quality.Rule("digits", "type", ["int"]),
             quality.Rule("balance", "type", ["double"]), quality.Rule("id", "type", ["bigint"])]
    return quality.rule_issues(cust(spark, path).withColumn("digits", digits), rules, ["id"])


_RULES = [
    quality.Rule("domain", "enum", vocab.DOMAINS), quality.Rule("imp", "range", low=0, high=5),
    quality.Rule("rep", "range", low=0, high=2), quality.Rule("confidence", "range", low=1, high=4),
    quality.Rule("kind", "required"), quality.Rule("price", "range", low=901, high=100000),
]
_BAD = ("coalesce(rep > 2, false) OR confidence > 4 OR kind IS NULL OR trim(kind) = '' OR NOT (price "
        "BETWEEN 901 AND 100000)")


@query("k6_conformance", (
    f"WITH {ART} SELECT state, count(*) FILTER (NOT ({_BAD})) AS valid, count(*) FILTER ({_BAD}) AS "
    f"invalid, count(*) FILTER ({_BAD}) = 0 AS unit_valid FROM art GROUP BY state"))
def conformance(spark, path):
    return quality.conformance(art(spark, path), _RULES, "state")


@query("k6_rule_issues", (
    f"WITH {ART} SELECT id, 'rep' AS field, 'range' AS rule FROM art WHERE rep > 2 UNION ALL SELECT id,"
    " 'confidence', 'range' FROM art WHERE confidence > 4 UNION ALL SELECT id, 'price', 'range' FROM "
    "art WHERE NOT (price BETWEEN 901 AND 100000)"))
def rule_issues(spark, path):
    return quality.rule_issues(art(spark, path), _RULES, ["id"])


@query("k8_coordinate_sanity", (
    f"WITH {CUST}, p AS (SELECT id, region, balance / 100 AS lat, CAST(nk * 16 - 190 AS DOUBLE) AS lon "
    "FROM cust) SELECT id, CASE WHEN NOT (lat BETWEEN -90 AND 90) OR NOT (lon BETWEEN -180 AND 180) THEN "
    "'out_of_range' ELSE 'out_of_region' END AS issue FROM p WHERE NOT (lat "
    "BETWEEN -90 AND 90) OR NOT (lon BETWEEN -180 AND 180) OR lat < (SELECT r_regionkey * 5 FROM region "
    "WHERE r_name = p.region) OR lat > (SELECT 60 + r_regionkey * 5 FROM region WHERE r_name = p.region) OR "
    "lon > (SELECT 180 - r_regionkey * 20 FROM region WHERE r_name = p.region)"))
def coordinate_sanity(spark, path):
    p = cust(spark, path).select("id", "region", (F.col("balance") / 100).alias("lat"),
                                 (F.col("nk") * 16 - 190).cast("double").alias("lon"))
    (r,) = tables(spark, path, "region")
    key = F.col("r_regionkey").cast("double")
    bounds = r.select(F.col("r_name").alias("region"), (key * 5).alias("min_lat"),
                      (key * 5 + 60).alias("max_lat"), F.lit(-180.0).alias("min_lon"),
                      (F.lit(180.0) - key * 20).alias("max_lon"))
    return quality.coordinate_issues(p, "id", "lat", "lon", "region", bounds)


@query("k10_integrity_sweep", (
    f"WITH {ART}, a AS (SELECT id, confidence, {P3} AS good, CASE WHEN id % 40 = 0 THEN 1 ELSE {P3} END"
    " AS stored FROM art), twice AS (SELECT * FROM a UNION ALL SELECT * FROM a WHERE id % 7 = 0) SELECT id, "
    "'low_confidence' AS issue FROM twice WHERE confidence < 3 UNION ALL SELECT id, 'stale_score' FROM "
    "twice WHERE stored IS DISTINCT FROM good UNION ALL SELECT id, 'duplicate_id' FROM a WHERE id % 7 = 0"))
def integrity_sweep(spark, path):
    stored = F.when(F.col("id") % 40 == 0, 1).otherwise(scoring.priority(S))
    a = art(spark, path).withColumn("stored", stored)
    twice = a.unionByName(a.filter("id % 7 = 0"))
    return quality.integrity_sweep(twice, "id", "confidence", "stored", scoring.priority(S))
