"""Joins: roster anti-join, dedupe, exact / containment / fuzzy / edit / proximity matches."""

from pyspark.sql import functions as F

from ..functions import derive, text
from ..operators import dedupe, groups, linkage, merge, quality
from .bindings import CUST, cust, tables
from .registry import query

# A roster with one row per order; names, cities and URLs partly repeat those of its customer.
ROSTER = f"""{CUST}, roster AS (
  SELECT o_orderkey AS row_no, code AS block, state,
    CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN lower(name) WHEN 1 THEN name || ' Annex '
      || (o_orderkey % 50) WHEN 2 THEN name ELSE upper(name) || ' Hall' END AS name,
    CASE CAST(o_orderkey % 3 AS INT) WHEN 0 THEN '' WHEN 1 THEN city ELSE 'Elsewhere' END AS city,
    CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN upper(coalesce(url, '')) || '/'
      WHEN 1 THEN '' ELSE 'http://new.org/' || (o_orderkey % 4000) || '/' END AS url
  FROM orders JOIN cust ON o_custkey = id
), known AS (
  SELECT id, code AS block, upper(state) AS state, upper(name) AS name, lower(city) AS city, url
  FROM cust
)"""
ROLES = {"block": "block", "state": "state", "name": "name", "city": "city", "url": "url"}


def roster(spark, path):
    (o,) = tables(spark, path, "orders")
    k = F.col("o_orderkey")
    name = (F.when(k % 4 == 0, F.lower("name"))
            .when(k % 4 == 1, F.concat("name", F.lit(" Annex "), (k % 50).cast("string")))
            .when(k % 4 == 2, F.col("name")).otherwise(F.concat(F.upper("name"), F.lit(" Hall"))))
    url = (F.when(k % 5 == 0, F.concat(F.upper(F.coalesce("url", F.lit(""))), F.lit("/")))
           .when(k % 5 == 1, "")
           .otherwise(F.concat(F.lit("http://new.org/"), (k % 4000).cast("string"), F.lit("/"))))
    return o.join(cust(spark, path), F.col("o_custkey") == F.col("id")).select(
        k.alias("row_no"), F.col("code").alias("block"), "state", name.alias("name"),
        F.when(k % 3 == 0, "").when(k % 3 == 1, F.col("city")).otherwise("Elsewhere").alias("city"),
        url.alias("url"))


def known(spark, path):
    return cust(spark, path).select(
        "id", F.col("code").alias("block"), F.upper("state").alias("state"),
        F.upper("name").alias("name"), F.lower("city").alias("city"), "url")


def _url_key(c: str) -> str:
    return (f"lower(regexp_replace(replace(regexp_replace(coalesce({c}, ''), '\\s+', '', 'g'), "
            "'://%20', '://'), '/+$', ''))")


@query("c1_unmatched_roster", (
    f"WITH {ROSTER}, r AS (SELECT *, {_url_key('url')} AS u FROM roster), k AS (SELECT *, "
    f"{_url_key('url')} AS u FROM known) SELECT row_no, name FROM r WHERE NOT EXISTS (SELECT 1 FROM "
    "k WHERE k.block = r.block AND k.u <> '' AND k.u = r.u) AND NOT EXISTS (SELECT 1 FROM k WHERE "
    "k.block = r.block AND lower(k.state) = lower(r.state) AND lower(k.name) = lower(r.name) AND "
    "(r.city = '' OR lower(k.city) = lower(r.city)))"))
def unmatched_roster(spark, path):
    out = linkage.unmatched_roster(roster(spark, path), known(spark, path), ROLES, ROLES)
    return out.select("row_no", "name")


# The sequential rule as an ordered reduction of each block: a row is taken unless its URL or its
# place is among those of the rows taken before.
@query("c2_greedy_dedupe", (
    f"WITH {ROSTER}, r AS (SELECT row_no, name, block, {_url_key('url')} AS u, lower(trim(state)) || "
    "chr(1) || lower(trim(name)) AS place, lower(trim(city)) AS c FROM roster), e AS (SELECT block, "
    "row_no, struct_pack(kept := [row_no], urls := CASE WHEN u <> '' THEN [u] ELSE []::VARCHAR[] END, "
    "places := [place, place || chr(1) || CASE WHEN c = '' THEN 'unknown' ELSE c END], ask := CASE WHEN "
    "c = '' THEN place ELSE place || chr(1) || c END) AS x FROM r), b AS (SELECT list_reduce(list(x "
    "ORDER BY row_no), lambda a, y: CASE WHEN list_has_any(a.urls, y.urls) OR list_contains(a.places, "
    "y.ask) THEN a ELSE struct_pack(kept := a.kept || y.kept, urls := a.urls || y.urls, places := "
    "a.places || y.places, ask := a.ask) END) AS x FROM e GROUP BY block) SELECT r.row_no, r.name FROM r "
    "SEMI JOIN (SELECT unnest(x.kept) AS row_no FROM b) k ON r.row_no = k.row_no"))
def greedy_dedupe(spark, path):
    return dedupe.greedy_dedupe(roster(spark, path), ROLES, "row_no").select("row_no", "name")


@query("c3_exact_match", (
    f"WITH {CUST} SELECT c.id, min(o_orderkey) AS external_id FROM cust c LEFT JOIN orders ON "
    "o_custkey = c.id GROUP BY c.id"))
def exact_match(spark, path):
    c = cust(spark, path)
    (o,) = tables(spark, path, "orders")
    external = o.join(c.select(F.col("id").alias("o_custkey"), "state", "name"), "o_custkey").select(
        F.col("o_orderkey").alias("row_no"), F.concat(F.lit(" "), F.upper("name")).alias("title"),
        F.col("state").alias("ext_state"), F.col("o_orderkey").alias("external_id"))
    return linkage.exact_match(
        c, external, {"_s": F.col("state"), "_n": F.lower("name")},
        {"_s": F.col("ext_state"), "_n": F.lower(text.strip("title"))}, "row_no",
        ["external_id"]).select("id", "external_id")


def fuzzy_sides(spark, path):
    s, c, n = tables(spark, path, "supplier", "customer", "nation")
    left = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("id"), F.col("n_name").alias("state"),
        F.concat(F.lit("The "), F.when(F.col("s_suppkey") % 3 == 0, F.regexp_replace(
            "s_name", "Supplier", "Customer")).otherwise(F.col("s_name")),
            F.lit(" Museum")).alias("name"))
    right = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("row_no"), F.col("n_name").alias("state"),
        F.col("c_name").alias("title"))
    return left, right


# All pairs of a state; the ratio by recursion: the longest common block (the first of the longest),
# then what stands left and right of it.
_FUZZY = """lft AS (
  SELECT s_suppkey AS id, n_name AS state, CASE WHEN s_suppkey % 3 = 0 THEN 'customer' ELSE 'supplier'
    END || right(s_name, 9) AS k FROM supplier JOIN nation ON s_nationkey = n_nationkey
), rgt AS (
  SELECT c_custkey AS row_no, n_name AS state, 'customer' || right(c_name, 9) AS k
  FROM customer JOIN nation ON c_nationkey = n_nationkey
), pairs AS (
  SELECT row_number() OVER () AS pid, * FROM (SELECT DISTINCT l.state, l.k AS a, r.k AS b
  FROM lft l JOIN rgt r ON l.state = r.state)
), seg AS (
  SELECT pid, 1 AS alo, length(a) + 1 AS ahi, 1 AS blo, length(b) + 1 AS bhi, 0 AS size, 0 AS step
  FROM pairs
  UNION ALL
  SELECT pid, CASE half WHEN 0 THEN alo WHEN 1 THEN m.i + m.n ELSE 0 END,
    CASE half WHEN 0 THEN m.i WHEN 1 THEN ahi ELSE 0 END,
    CASE half WHEN 0 THEN blo WHEN 1 THEN m.j + m.n ELSE 0 END,
    CASE half WHEN 0 THEN m.j WHEN 1 THEN bhi ELSE 0 END,
    CASE half WHEN 2 THEN m.n ELSE 0 END, step
  FROM (SELECT pid, alo, ahi, blo, bhi, step + 1 AS step, min(struct_pack(neg := -n, i := i, j := j,
      n := n)) AS m
    FROM (SELECT s.*, i, j, coalesce(list_position(list_transform(range(0, least(ahi - i, bhi - j)),
        lambda t: a[i + t] = b[j + t]), false) - 1, least(ahi - i, bhi - j)) AS n
      FROM seg s JOIN pairs USING (pid), unnest(range(alo, ahi)) AS x(i), unnest(range(blo, bhi)) AS y(j)
      WHERE a[i] = b[j]) GROUP BY ALL)
  CROSS JOIN (VALUES (0), (1), (2)) h(half)
), ratio AS (
  SELECT state, a, b, 2.0 * sum(size) / (length(a) + length(b)) AS score
  FROM seg JOIN pairs USING (pid) GROUP BY state, a, b
), best AS (
  SELECT l.id, max(struct_pack(score := score, pos := -row_no)) AS m FROM lft l
  JOIN rgt r ON l.state = r.state JOIN ratio q ON q.state = l.state AND q.a = l.k AND q.b = r.k
  WHERE score >= 0.7 GROUP BY l.id
)"""


@query("c4_fuzzy_match", (
    f"WITH RECURSIVE {_FUZZY} SELECT l.id, CASE WHEN m IS NOT NULL THEN 'fuzzy' END AS match_type, "
    "round(m.score, 6) AS match_score, -m.pos AS match_id FROM lft l LEFT JOIN best USING (id)"))
def fuzzy_match(spark, path):
    left, right = fuzzy_sides(spark, path)
    out = linkage.fuzzy_match(left, right, "state", "name", "title", "row_no", ["row_no", "title"])
    return out.select("id", "match_type", F.round("match_score", 6).alias("match_score"),
                      F.col("match_row_no").alias("match_id"))


SHEET = """sheet AS (
  SELECT s_suppkey AS row_no, CAST(floor(s_acctbal) AS INT) AS score, CASE CAST(s_suppkey % 4 AS INT)
    WHEN 0 THEN 'Customer#' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0')
    WHEN 1 THEN 'Grand Customer#' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') || ' Hall'
    WHEN 2 THEN 'Customer''s 0000' || lpad(CAST(s_suppkey % 8 AS VARCHAR), 3, '0')
    ELSE 'Customer' END AS title
  FROM supplier
), key_names AS (
  SELECT trim(regexp_replace(replace(lower(title), '''', ''), '[^a-z0-9_\\s]', '', 'g')) AS k,
    row_no, score FROM sheet
), dim AS (
  SELECT k, min(row_no) AS seen, arg_max(score, row_no) AS score FROM key_names GROUP BY k
), rec AS (
  SELECT c_custkey AS id, replace(replace(lower(c_name), '#', ''), 'customer', CASE WHEN c_custkey
    % 2 = 0 THEN 'customer' ELSE 'customers ' END) AS k FROM customer
)"""


def sheet(spark, path):
    (s,) = tables(spark, path, "supplier")
    k = F.col("s_suppkey")
    digits = F.lpad(k.cast("string"), 9, "0")
    title = (F.when(k % 4 == 0, F.concat(F.lit("Customer#"), digits))
             .when(k % 4 == 1, F.concat(F.lit("Grand Customer#"), digits, F.lit(" Hall")))
             .when(k % 4 == 2, F.concat(F.lit("Customer's 0000"),
                                        F.lpad((k % 8).cast("string"), 3, "0")))
             .otherwise("Customer"))
    return s.select(k.alias("row_no"), F.floor("s_acctbal").cast("int").alias("score"),
                    title.alias("title"))


def sheet_records(spark, path):
    (c,) = tables(spark, path, "customer")
    odd = F.regexp_replace("c_name", "Customer#", "Customer's ")
    return c.select(F.col("c_custkey").alias("id"),
                    F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(odd).alias("name"))


@query("c5_sheet_exact_match", (
    f"WITH {SHEET} SELECT id, score FROM rec JOIN dim ON rec.k = dim.k"))
def sheet_exact_match(spark, path):
    out = linkage.sheet_match(sheet_records(spark, path), "name", sheet(spark, path), "title",
                              "row_no", ["score"])
    return out.filter("match_type = 'exact'").select("id", F.col("sheet_score").alias("score"))


@query("c6_sheet_containment_match", (
    f"WITH {SHEET}, hit AS (SELECT id, rec.k, seen, score FROM rec JOIN dim ON length(rec.k) > 10 "
    "AND length(dim.k) > 10 AND (contains(rec.k, dim.k) OR contains(dim.k, rec.k)) WHERE rec.k NOT "
    "IN (SELECT k FROM dim)) SELECT id, arg_min(score, seen) AS score FROM hit GROUP BY id"))
def sheet_containment_match(spark, path):
    out = linkage.sheet_match(sheet_records(spark, path), "name", sheet(spark, path), "title",
                              "row_no", ["score"])
    return out.filter("match_type = 'partial'").select("id", F.col("sheet_score").alias("score"))


@query("a5_sheet_entries", (
    f"WITH {SHEET} SELECT k AS name_key, seen AS position, score FROM dim"))
def sheet_entries(spark, path):
    from ..sources import readers
    raw = sheet(spark, path).select(
        "row_no", F.col("title").alias("The museum name (official)"),
        F.concat(F.col("score").cast("string"), F.lit(".0")).alias("PRIORITY SCORE v2"),
        F.lit("x").alias("Museum Name 2"))
    resolved = readers.resolve_sheet(raw, "row_no")
    return readers.sheet_entries(resolved, "row_no", "museum_name", ["priority_score"]).select(
        "name_key", "position", F.col("priority_score").alias("score"))


@query("c12_city_tier_by_population", (
    f"WITH {CUST}, p AS (SELECT city, state, count(*) * 30000 AS population FROM cust GROUP BY city, "
    "state) SELECT c.id, CAST(CASE WHEN c.id % 5 = 0 THEN 1 WHEN c.id % 5 = 1 THEN 2 WHEN "
    "p.population >= 500000 THEN 1 WHEN p.population >= 50000 THEN 2 ELSE 3 END AS INT) AS tier FROM"
    " cust c LEFT JOIN p ON c.city = p.city AND c.state = p.state"))
def city_tier_by_population(spark, path):
    c = cust(spark, path)
    population = c.groupBy("city", "state").agg((F.count(F.lit(1)) * 30000).alias("population"))
    city = F.when(F.col("id") % 5 == 0, " Chicago").when(F.col("id") % 5 == 1, "Boise").otherwise(
        F.col("city"))
    return groups.lookup(c, population, ["city", "state"]).select(
        "id", derive.city_tier(city, "population").alias("tier"))


@query("c14_peers_in_city", (
    f"WITH {CUST} SELECT id, CASE WHEN coalesce(trim(raw_city), '') = '' THEN 0 ELSE count(*) OVER "
    "(PARTITION BY state, lower(trim(raw_city))) - 1 END AS nearby FROM cust"))
def peers_in_city(spark, path):
    return groups.peers_in_city(cust(spark, path), "id", "raw_city", "state", "phase",
                                "nearby").select("id", "nearby")


@query("e1_peers_excluding_own_id", (
    "SELECT l_orderkey, l_linenumber, l_suppkey, count(*) OVER (PARTITION BY l_returnflag, "
    "l_linestatus) - count(*) OVER (PARTITION BY l_returnflag, l_linestatus, l_suppkey) AS others "
    "FROM lineitem"))
def peers_excluding_own_id(spark, path):
    (li,) = tables(spark, path, "lineitem")
    return groups.peers_in_city(
        li.select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_linestatus"),
        "l_suppkey", "l_returnflag", "l_linestatus", "phase", "others").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "others")


@query("d1_nearby_counts", (
    f"WITH {CUST} SELECT id, greatest(0, count(*) OVER (PARTITION BY coalesce(raw_city, ''), "
    "coalesce(state, '')) - 1) AS nearby FROM cust"))
def nearby_counts(spark, path):
    return groups.peers_in_city(cust(spark, path), "id", "raw_city", "state", "index",
                                "nearby").select("id", "nearby")


@query("c15_entity_by_key", (
    "SELECT p_partkey AS id, 'Q' || p_partkey AS qid, n AS links FROM part LEFT JOIN (SELECT "
    "l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey) ON p_partkey = l_partkey"))
def entity_by_key(spark, path):
    p, li = tables(spark, path, "part", "lineitem")
    entity = li.groupBy(F.concat(F.lit("Q"), F.col("l_partkey").cast("string")).alias("qid")).agg(
        F.count(F.lit(1)).alias("links"))
    return p.select(F.col("p_partkey").alias("id"),
                    F.concat(F.lit("Q"), F.col("p_partkey").cast("string")).alias("qid")).join(
        entity, "qid", "left").select("id", "qid", "links")


_SPOT = ("SELECT c_custkey AS id, c_acctbal / 200 AS lat, ((c_custkey * 7919) % 36000) / 100.0 - 180 "
         "AS lon FROM customer")


@query("c17_proximity_match", (
    f"WITH spot AS ({_SPOT}), probe AS (SELECT id, lat + CASE WHEN id % 2 = 0 THEN 0.0004 ELSE 0.002 "
    "END AS lat, lon FROM spot), near AS (SELECT p.id, s.id AS partner, 2 * 6371008.8 * "
    "asin(least(1.0, sqrt(pow(sin(radians(s.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * "
    "cos(radians(s.lat)) * pow(sin(radians(s.lon - p.lon) / 2), 2)))) AS metres FROM probe p JOIN "
    "spot s ON s.lat BETWEEN p.lat - 0.001 AND p.lat + 0.001) SELECT id, arg_min(partner, metres) AS"
    " partner, CAST(round(min(metres)) AS INT) AS metres FROM near WHERE metres <= 100 GROUP BY id"))
def proximity_match(spark, path):
    (c,) = tables(spark, path, "customer")
    spot = c.select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 200).alias("lat"),
                    ((F.col("c_custkey") * 7919) % 36000 / 100.0 - 180).alias("lon"))
    probe = spot.withColumn("lat", F.col("lat") + F.when(F.col("id") % 2 == 0, 0.0004).otherwise(0.002))
    near = linkage.proximity_match(probe, spot, "lat", "lon", "id")
    return near.filter("partner IS NOT NULL").select(
        "id", "partner", F.round("metres").cast("int").alias("metres"))


@query("c18_edit_distance_match", (
    "WITH a AS (SELECT c_mktsegment AS city, replace(replace(lower(c_name), '#', ' '), 'tom', 'tm') "
    "AS name FROM customer), b AS (SELECT c_mktsegment AS city, replace(lower(c_name), '#', ' ') AS "
    "name FROM customer), m AS (SELECT a.city, a.name, b.name AS partner, levenshtein(a.name, b.name)"
    " AS d FROM a JOIN b ON a.city = b.city AND levenshtein(a.name, b.name) < 3), r AS (SELECT *, "
    "row_number() OVER (PARTITION BY city, name ORDER BY d, partner) AS rk FROM m) SELECT city, name,"
    " partner, CAST(d AS INT) AS distance FROM r WHERE rk = 1"))
def edit_distance_match(spark, path):
    (c,) = tables(spark, path, "customer")
    right = c.select(F.col("c_mktsegment").alias("city"),
                     F.replace(F.lower("c_name"), F.lit("#"), F.lit(" ")).alias("name"))
    left = right.withColumn("name", F.replace("name", F.lit("tom"), F.lit("tm")))
    return linkage.edit_distance_match(left.distinct(), right.distinct(), "city", "name")


@query("i13_stubs", (
    f"WITH {ROSTER} SELECT row_no, CASE WHEN block = 'ZZ' THEN lower(replace(state, '_', '-')) || '-zz-' ELSE 'usa-' || lower(block) || '-' "
    "END || CASE WHEN city = '' THEN 'unknown' ELSE lower(city) END || '-' || "
    "regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g') AS museum_id, CASE WHEN block = 'ZZ' THEN "
    "state ELSE 'USA' END AS country, state AS state_province, block AS state_code, CASE WHEN city ="
    " '' THEN 'Unknown' ELSE city END AS city, 'TBD' AS street_address, 'Unknown' AS museum_type, "
    "CAST(NULL AS INT) AS reputation, 'seed' AS sources, '2026-01-01' AS created_at FROM roster"))
def stubs(spark, path):
    made = merge.make_stubs(
        roster(spark, path), ROLES, F.lit("2026-01-01"), "seed",
        "Seeded from the roster; needs enrichment.", {"reputation": "int"}, keep=["row_no"])
    return made.select("row_no", "museum_id", "country", "state_province", "state_code", "city",
                       "street_address", "museum_type", "reputation",
                       F.array_join("data_sources", ",").alias("sources"), "created_at")


@query("k11_rollout_order", (
    f"WITH {CUST} SELECT id, code, CAST(CASE code WHEN 'IL' THEN 1 WHEN 'MA' THEN 2 WHEN 'NY' THEN 2 "
    "WHEN 'PA' THEN 2 WHEN 'CT' THEN 2 WHEN 'CA' THEN 3 WHEN 'ZZ' THEN 5 ELSE 4 END AS INT) AS wave "
    "FROM cust"))
def rollout_order(spark, path):
    return cust(spark, path).select("id", "code", quality.rollout_rank("code").alias("wave")).orderBy(
        "wave", "code", "id")
