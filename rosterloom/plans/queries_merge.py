"""Merge semantics: a record per customer, patches from its orders."""

from pyspark.sql import functions as F

from ..operators import merge
from .bindings import ART, CUST, EVT, art, cust, evt, tables
from .registry import query

# The patch of a customer comes from its first order; customers without orders have none.
PATCH = f"""{CUST}, first_order AS (
  SELECT o_custkey AS id, arg_min(o_orderpriority, o_orderkey) AS new_city,
    arg_min(o_totalprice, o_orderkey) AS new_balance, min(o_orderkey) AS ok FROM orders
  GROUP BY o_custkey
), m AS (
  SELECT c.*, CASE WHEN nk % 2 = 0 THEN balance END AS old_balance,
    CASE WHEN ok % 3 = 0 THEN NULL WHEN ok % 3 = 1 THEN city ELSE new_city END AS new_city,
    new_balance
  FROM cust c LEFT JOIN first_order f ON c.id = f.id
)"""
_MISSING = ("(raw_city IS NULL OR lower(trim(raw_city)) IN ('', 'tbd', 'unknown', 'n/a', 'na', 'not "
            "known', 'not available'))")


def patched(spark, path):
    (o,) = tables(spark, path, "orders")
    first = o.groupBy(F.col("o_custkey").alias("id")).agg(
        F.min_by("o_orderpriority", "o_orderkey").alias("p"),
        F.min_by("o_totalprice", "o_orderkey").alias("new_balance"),
        F.min("o_orderkey").alias("ok"))
    ok = F.col("ok") % 3
    new_city = F.when(ok == 0, None).when(ok == 1, F.col("city")).otherwise(F.col("p"))
    return cust(spark, path).join(first, "id", "left").withColumns({
        "old_balance": F.when(F.col("nk") % 2 == 0, F.col("balance")), "new_city": new_city})


@query("i1_fill_missing", (
    f"WITH {PATCH} SELECT id, CASE WHEN {_MISSING} AND new_city IS NOT NULL THEN new_city ELSE raw_city "
    "END AS raw_city, coalesce(old_balance, new_balance) AS old_balance, concat_ws(',', CASE WHEN "
    f"{_MISSING} AND new_city IS NOT NULL THEN 'raw_city' END, CASE WHEN old_balance IS NULL AND "
    "new_balance IS NOT NULL THEN 'old_balance' END) AS filled FROM m"))
def fill_missing(spark, path):
    out = merge.fill_missing(patched(spark, path),
                             {"raw_city": "new_city", "old_balance": "new_balance"},
                             changed="filled")
    return out.select("id", "raw_city", "old_balance", F.array_join("filled", ",").alias("filled"))


@query("i2_overwrite_known", (
    f"WITH {PATCH} SELECT id, coalesce(new_city, raw_city) AS raw_city, coalesce(new_balance, "
    "old_balance) AS old_balance FROM m"))
def overwrite_known(spark, path):
    return merge.overwrite_known(
        patched(spark, path), {"raw_city": "new_city", "old_balance": "new_balance"}).select(
        "id", "raw_city", "old_balance")


@query("i3_never_null_known", (
    f"WITH {PATCH} SELECT id, CASE WHEN {_MISSING} THEN new_city ELSE raw_city END AS raw_city, CASE "
    f"WHEN {_MISSING} THEN '' ELSE 'raw_city' END AS rejected FROM m"))
def never_null_known(spark, path):
    out = merge.never_null_known(patched(spark, path), {"raw_city": "new_city"})
    return out.select("id", "raw_city", F.array_join("rejected", ",").alias("rejected"))


_TRUST = f"""{EVT}, cand AS (
  SELECT uid, kind AS field, CASE WHEN k < 10 THEN 'TBD' WHEN k < 15 THEN NULL ELSE kind || k END AS
    value, CAST(k % 5 AS INT) AS trust, ts, id, id % 50 = 0 AS cur, k > 90 AS locked FROM evt
)"""


def candidates(spark, path):
    k = F.col("k")
    value = F.when(k < 10, "TBD").when(k < 15, None).otherwise(F.concat("kind", k.cast("string")))
    return evt(spark, path).select(
        "uid", F.col("kind").alias("field"), value.alias("value"),
        (k % 5).cast("int").alias("trust"), "ts", "id", (F.col("id") % 50 == 0).alias("cur"),
        (k > 90).alias("locked"))


@query("i4_trust_merge", (
    f"WITH {_TRUST}, r AS (SELECT *, row_number() OVER (PARTITION BY uid, field ORDER BY (cur AND "
    "locked) DESC, (value IS NOT NULL AND value <> 'TBD') DESC, trust DESC, ts DESC, cur DESC, id "
    "DESC) AS rk FROM cand) SELECT uid, field, value, trust, id FROM r WHERE rk = 1"))
def trust_merge(spark, path):
    out = merge.trust_merge(candidates(spark, path), ["uid", "field"], "value", "trust", "ts", "cur",
                            "locked", "id", extra=["id"])
    return out.select("uid", "field", "value", "trust", "id")


@query("i4_trust_merge_wide", (
    f"WITH {_TRUST}, r AS (SELECT *, row_number() OVER (PARTITION BY uid, field ORDER BY (cur AND "
    "locked) DESC, (value IS NOT NULL AND value <> 'TBD') DESC, trust DESC, ts DESC, cur DESC, id "
    "DESC) AS rk FROM cand), w AS (SELECT * FROM r WHERE rk = 1) SELECT uid, max(value) FILTER (field ="
    " 'click') AS click, max(value) FILTER (field = 'view') AS view, max(value) FILTER (field = "
    "'error') AS error, max(value) FILTER (field = 'purchase') AS purchase, max(value) FILTER (field = "
    "'signup') AS signup FROM w GROUP BY uid"))
def trust_merge_wide(spark, path):
    return merge.trust_merge_wide(
        candidates(spark, path), "uid", "field", ["click", "view", "error", "purchase", "signup"], "value", "trust", "ts",
        "cur", "locked", "id")


@query("i5_change_only", (
    f"WITH {PATCH} SELECT id, CASE WHEN new_city IS NOT NULL AND new_city IS DISTINCT FROM city THEN "
    "new_city ELSE city END AS city, CASE WHEN new_balance IS NOT NULL THEN new_balance ELSE "
    "old_balance END AS old_balance, CAST((new_city IS NOT NULL AND new_city <> city)::INT + "
    "(new_balance IS NOT NULL AND new_balance IS DISTINCT FROM old_balance)::INT AS INT) AS n FROM m"))
def change_only(spark, path):
    out = merge.change_only(patched(spark, path),
                            {"city": "new_city", "old_balance": "new_balance"}, "changed")
    return out.select("id", "city", "old_balance", F.size("changed").alias("n"))


@query("i6_truthy_overlay", (
    f"WITH {PATCH} SELECT id, CASE WHEN coalesce(raw_city, '') <> '' THEN raw_city ELSE city END AS "
    "city, CASE WHEN coalesce(nk, 0) <> 0 THEN CAST(nk AS DOUBLE) ELSE balance END AS balance FROM m"))
def truthy_overlay(spark, path):
    out = merge.truthy_overlay(
        patched(spark, path), {"city": "raw_city", "balance": F.col("nk").cast("double")},
        {"city": "string", "balance": "double"})
    return out.select("id", "city", "balance")


_POINT = f"""{ART}, p AS (
  SELECT id, CASE WHEN id % 3 = 0 THEN price END AS lat, CASE WHEN id % 2 = 0 THEN -price END AS lon,
    CASE WHEN tier IS NOT NULL THEN CAST(tier AS DOUBLE) END AS nlat, CAST(rep AS DOUBLE) AS nlon FROM
    art
)"""


def points(spark, path):
    k = F.col("id")
    return art(spark, path).select(
        "id", F.when(k % 3 == 0, F.col("price")).alias("lat"),
        F.when(k % 2 == 0, -F.col("price")).alias("lon"),
        F.col("tier").cast("double").alias("nlat"), F.col("rep").cast("double").alias("nlon"))


@query("i7_pair_fill", (
    f"WITH {_POINT}, q AS (SELECT *, lat IS NULL AND lon IS NULL AND nlat IS NOT NULL AND nlon IS NOT "
    "NULL AS t FROM p) SELECT id, CASE WHEN t THEN nlat ELSE lat END AS pair_lat, CASE WHEN t THEN nlon"
    " ELSE lon END AS pair_lon, coalesce(lat, nlat) AS lat, coalesce(lon, nlon) AS lon FROM q"))
def pair_fill(spark, path):
    p = points(spark, path).withColumns({"pair_lat": F.col("lat"), "pair_lon": F.col("lon")})
    both = merge.pair_fill(p, "pair_lat", "pair_lon", "nlat", "nlon")
    return merge.pair_fill(both, "lat", "lon", "nlat", "nlon", independent=True).drop("nlat", "nlon")


@query("i8_guarded_fill", (
    f"WITH {CUST}, a AS (SELECT id, raw_city AS address, CASE nk % 4 WHEN 0 THEN 'narm' WHEN 1 THEN '' "
    "WHEN 2 THEN 'google' END AS src, city AS fresh FROM cust), g AS (SELECT *, coalesce(src, '') IN "
    "('', 'narm') AND (address IS NULL OR lower(trim(address)) IN ('', 'tbd', 'unknown', 'n/a', 'null',"
    " 'pending', 'none')) AS t FROM a) SELECT id, CASE WHEN t THEN fresh ELSE address END AS address, "
    "CASE WHEN t THEN 'museums_csv' ELSE src END AS src, CASE WHEN t THEN '2026-01-01' END AS verified "
    "FROM g"))
def guarded_fill(spark, path):
    n = F.col("nk") % 4
    a = cust(spark, path).select(
        "id", F.col("raw_city").alias("address"),
        F.when(n == 0, "narm").when(n == 1, "").when(n == 2, "google").alias("src"),
        F.lit(None).cast("string").alias("verified"), F.col("city").alias("fresh"))
    return merge.guarded_fill(a, "address", "src", "verified", "fresh", "museums_csv",
                              F.lit("2026-01-01")).drop("fresh")


@query("i10_backbone", (
    f"WITH {ART}, c AS (SELECT *, CASE name[1] WHEN 'r' THEN 'Denver' WHEN 's' THEN ' Boise ' WHEN 'h' "
    "THEN NULL ELSE city END AS town, CASE WHEN id % 4 = 0 THEN 'Full day' WHEN id % 4 = 1 THEN 'n/a' "
    "END AS time0, CASE WHEN id % 4 = 2 THEN nearby END AS near0, tier AS tier0 FROM art), d AS (SELECT "
    "*, CASE WHEN town IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY state, lower(trim(town))) - 1 END"
    " AS near1, CASE WHEN kind IS NULL THEN NULL ELSE CASE trim(lower(kind)) WHEN 'art museum' THEN 'Art "
    "Museum' WHEN 'fine art' THEN 'Fine Art' WHEN 'history museum' THEN 'History Museum' WHEN "
    "'university museum' THEN 'University Art Museum' WHEN 'zoo' THEN 'Zoo/Aquarium' WHEN 'children''s "
    "museum' THEN 'Children''s Museum' ELSE CASE WHEN lower(kind) LIKE '%art%' THEN 'Art Museum' ELSE "
    "trim(kind) END END END AS kind1 FROM c) SELECT id, CAST(coalesce(tier0, CASE trim(coalesce(town, "
    "'')) WHEN 'Denver' THEN 1 WHEN 'Boise' THEN 2 ELSE 3 END) AS INT) AS city_tier, CASE WHEN time0 = "
    "'Full day' THEN time0 ELSE 'Half day' END AS time_needed, near1 AS nearby_count, kind1 AS kind, "
    "coalesce(kind1 IN ('Fine Art', 'Contemporary Art', 'Modern Art', 'University Art Museum', "
    "'Encyclopedic Art Museum', 'Art Museum', 'Art Center', 'Art Gallery'), false) AS is_scoreable, "
    "concat_ws(',', CASE WHEN tier0 IS NULL THEN 'city_tier' END, CASE WHEN coalesce(time0, 'n/a') = "
    "'n/a' THEN 'time_needed' END, CASE WHEN near0 IS DISTINCT FROM near1 THEN 'nearby_count' END, CASE"
    " WHEN kind1 <> kind THEN 'type' END) AS updated FROM d"))
def backbone_phase(spark, path):
    from .phases import backbone
    k = F.col("id") % 4
    first = F.substring("name", 1, 1)
    town = F.when(first == "r", "Denver").when(first == "s", " Boise ").when(first == "h", None).otherwise(
        F.col("city"))
    start = art(spark, path).withColumns({
        "town": town, "time_needed": F.when(k == 0, "Full day").when(k == 1, "n/a"),
        "nearby_count": F.when(k == 2, F.col("nearby")), "city_tier": F.col("tier")})
    out = backbone(start, "id", "town", "state", "kind", "name")
    return out.select("id", "city_tier", "time_needed", "nearby_count", "kind", "is_scoreable",
                      F.array_join("updated_fields", ",").alias("updated"))


@query("i11_recommend_or_write", (
    f"WITH {ART} SELECT id, CASE WHEN confidence >= 4 AND cbs >= 3 AND domain = 'Art' THEN 'apply' ELSE "
    "'review' END AS route FROM art"))
def recommend_or_write(spark, path):
    from ..functions import derive
    guard = ~derive.is_art("domain", domain_col="domain")
    return art(spark, path).select(
        "id", merge.route_recommendation("confidence", "cbs", blocked=guard).alias("route"))


@query("b6_staleness_skip", (
    f"WITH {EVT} SELECT id, CASE WHEN kind = 'error' OR kind = 'signup' THEN 'process' WHEN ts >= "
    "TIMESTAMP '2024-01-10 00:00:00' THEN 'current' ELSE 'process' END AS state, 'process' AS forced "
    "FROM evt"))
def staleness_skip(spark, path):
    from ..functions import derive
    stamp = F.when(F.col("kind") == "error", "not a time").when(F.col("kind") == "signup", None).otherwise(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    mtime = F.lit("2024-01-10T00:00:00Z").cast("timestamp")
    return evt(spark, path).select("id", derive.current_or_process(stamp, mtime).alias("state"),
                                   derive.current_or_process(stamp, mtime, True).alias("forced"))


@query("a10_changed_partitions", (
    f"WITH {CUST}, t AS (SELECT DISTINCT code FROM cust WHERE balance > 9980) SELECT id, code, CASE "
    "WHEN balance > 9980 THEN '2026-01-01' ELSE '2025-01-01' END AS updated_at FROM cust WHERE code IN "
    "(SELECT code FROM t)"))
def changed_partitions(spark, path):
    from ..sources import writers
    c = cust(spark, path).select("id", "code", (F.col("balance") > 9980).alias("changed"),
                                 F.lit("2025-01-01").alias("updated_at"))
    return writers.changed_partitions(c, "code", "changed", "updated_at", F.lit("2026-01-01"))
