"""The composed phases over the given tables, one query a phase, and the whole run from a roster file."""

from pyspark.sql import functions as F

from ..functions import derive, vocab
from ..session import scratch_path
from ..sources import readers, writers
from . import phases
from .bindings import ART, CODES, CODES_SQL, CUST, STATE_NAMES, art, cust, score_columns, tables
from .queries_linkage import _FUZZY, ROLES, ROSTER, SHEET, _url_key, known, roster, sheet, sheet_records
from .queries_scoring import OK2, P1, P2, Q2
from .registry import query

S = score_columns()
AS_OF = "2026-01-01"

# Roster rows without a known record, then the sequential rule as an ordered reduction.
_FRESH = f"""{ROSTER}, n AS (
  SELECT *, {_url_key('url')} AS u, lower(trim(state)) || chr(1) || lower(trim(name)) AS place,
    lower(trim(city)) AS c FROM roster
), k AS (SELECT *, {_url_key('url')} AS u FROM known), fresh AS (
  SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.block = n.block AND k.u <> '' AND k.u = n.u)
    AND NOT EXISTS (SELECT 1 FROM k WHERE k.block = n.block AND lower(k.state) = lower(n.state)
      AND lower(k.name) = lower(n.name) AND (n.city = '' OR lower(k.city) = lower(n.city)))
), e AS (
  SELECT block, row_no, struct_pack(kept := [row_no], urls := CASE WHEN u <> '' THEN [u] ELSE
    []::VARCHAR[] END, places := [place, place || chr(1) || CASE WHEN c = '' THEN 'unknown' ELSE c END],
    ask := CASE WHEN c = '' THEN place ELSE place || chr(1) || c END) AS x FROM fresh
), b AS (
  SELECT list_reduce(list(x ORDER BY row_no), lambda a, y: CASE WHEN list_has_any(a.urls, y.urls) OR
    list_contains(a.places, y.ask) THEN a ELSE struct_pack(kept := a.kept || y.kept, urls := a.urls ||
    y.urls, places := a.places || y.places, ask := a.ask) END) AS x FROM e GROUP BY block
), kept AS (SELECT fresh.* FROM fresh SEMI JOIN (SELECT unnest(x.kept) AS row_no FROM b) t
  ON fresh.row_no = t.row_no)"""


_STUBS = (
    f"WITH {_FRESH} SELECT CASE WHEN block = 'ZZ' THEN lower(replace(state, '_', '-')) || '-zz-' ELSE 'usa-' "
    "|| lower(block) || '-' END || CASE WHEN city = '' THEN 'unknown' ELSE lower(city) END || '-' || "
    "regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g') AS museum_id, name AS museum_name, state AS "
    "state_province, CASE WHEN city = '' THEN 'Unknown' ELSE city END AS city, url AS website, 'TBD' AS "
    f"street_address, CAST(NULL AS INT) AS reputation, 'seed' AS sources, '{AS_OF}' AS created_at FROM kept")


def _stubs(spark, path, rows, roles):
    records = known(spark, path).select(
        F.col("block").alias("state_code"), F.col("state").alias("state_province"),
        F.col("name").alias("museum_name"), "city", F.col("url").alias("website"))
    out = phases.ingest_roster(records, rows, roles, "row_no", F.lit(AS_OF), "seed",
                               "Seeded from the roster.", {"reputation": "int"})
    return out.select("museum_id", "museum_name", "state_province", "city", "website", "street_address",
                      "reputation", F.array_join("data_sources", ",").alias("sources"), "created_at")


@query("i13_ingest_roster", _STUBS)
def ingest_roster(spark, path):
    return _stubs(spark, path, roster(spark, path), ROLES)


@query("e2_roster_file_to_stubs", _STUBS)
def roster_file_to_stubs(spark, path):
    # the same rows by way of a roster file: their order is the order of the file
    target = scratch_path(spark, "roster")
    writers.write_csv(roster(spark, path).orderBy("row_no").select(
        F.col("city").alias("CITY"), F.col("state").alias("STATE"), F.col("url").alias("URL"),
        F.col("name").alias("NAME")), target)
    rows = readers.read_roster(spark, target, strict=False).withColumn(
        "block", derive.region_code("STATE"))
    return _stubs(spark, path, rows, {"block": "block", "state": "STATE", "name": "NAME", "city": "CITY",
                                      "url": "URL"})


_NEED = ("(raw_city IS NULL OR lower(trim(raw_city)) IN ('', 'tbd', 'unknown', 'n/a', 'na', 'not known', "
         "'not available') OR (nk < 20 AND CAST(id % 8 AS INT) = 5))")


@query("b3_apply_identity", (
    f"WITH {CUST}, r AS (SELECT *, CASE WHEN NOT {_NEED} THEN 'skipped' WHEN id % 4 < 2 AND id % 5 <> 0 THEN "
    "'updated' ELSE 'failed' END AS outcome FROM cust) SELECT id, outcome, CASE WHEN outcome = 'updated' THEN "
    "'Found ' || city ELSE raw_city END AS city, CASE WHEN outcome = 'updated' THEN id || ' Main St' END AS "
    "street_address, CASE WHEN outcome = 'updated' THEN 'google_places' END AS address_source, CASE WHEN "
    f"outcome = 'updated' THEN '{AS_OF}' END AS verified, CASE WHEN outcome = 'updated' THEN "
    "'seed,google_places_api' ELSE 'seed' END AS sources FROM r"))
def apply_identity(spark, path):
    c = cust(spark, path)
    blank = {f: F.lit(None).cast("string") for f in (
        "street_address", "postal_code", "place_id", "phone", "address_source", "address_last_verified")}
    records = c.select("id", F.col("raw_city").alias("city"), F.array(F.lit("seed")).alias("data_sources")
                       ).withColumns({**blank, "latitude": F.lit(None).cast("double"),
                                      "longitude": F.lit(None).cast("double")})
    # every fourth record has no answer at all
    found = c.filter("id % 4 <> 3").select(
        "id", (F.col("id") % 4 < 2).alias("success"),
        F.when(F.col("id") % 5 == 0, "").otherwise(F.concat(F.lit("Found "), "city")).alias("city"),
        F.concat(F.col("id").cast("string"), F.lit(" Main St")).alias("street_address"),
        F.lit("1").alias("postal_code"), F.lit(1.5).alias("latitude"), F.lit(2.5).alias("longitude"),
        F.lit("p").alias("place_id"), F.lit("t").alias("phone"))
    out = phases.apply_identity(records, found, "id", F.lit(AS_OF))
    return out.select("id", "outcome", "city", "street_address", "address_source",
                      F.col("address_last_verified").alias("verified"),
                      F.array_join("data_sources", ",").alias("sources"))


@query("c4_link_external", (
    f"WITH {CUST}, r AS (SELECT *, CASE WHEN id % 7 = 0 THEN 'skipped' WHEN id % 2 = 0 AND code <> 'ZZ' THEN "
    "'exact' ELSE 'no_match' END AS outcome FROM cust) SELECT id, outcome, CASE WHEN outcome = 'exact' AND id "
    "% 3 <> 0 THEN '555-' || id WHEN id % 3 = 0 THEN 'old' END AS phone, CASE WHEN outcome = 'exact' THEN "
    "id % 90 + 0.5 END AS latitude, CASE WHEN outcome = 'exact' THEN 'seed,museums_csv' WHEN outcome = "
    "'skipped' THEN 'museums_csv' ELSE 'seed' END AS sources, CASE WHEN outcome = 'exact' THEN 'CSV: IRS "
    "Museum ID ' || id || ' CSV: phone from IRS 990 database CSV: coordinates from IRS 990 database' END AS "
    "notes, CASE WHEN outcome = 'exact' THEN CASE WHEN id % 3 <> 0 THEN 'phone,latitude,longitude' ELSE "
    "'latitude,longitude' END ELSE '' END AS filled FROM r"))
def link_external(spark, path):
    c, key = cust(spark, path), F.col("id")
    text_ = key.cast("string")
    names = {
        "Museum ID": text_, "Museum Name": F.concat(F.lit(" "), F.upper("name")), "Museum Type": F.lit(""),
        "Phone Number": F.concat(F.lit("555-"), text_),
        "Latitude": ((key % 90).cast("double") + 0.5).cast("string"), "Longitude": F.lit("-1.5"),
        **{n: F.lit(" ") for n in (
            "Street Address (Physical Location)", "Street Address (Administrative Location)",
            "City (Physical Location)", "City (Administrative Location)",
            "Zip Code (Physical Location)", "Zip Code (Administrative Location)", "Income", "Revenue")},
        "State (Administrative Location)": F.col("code")}
    external = c.filter("id % 2 = 0").select(key.alias("row_no"), *[v.alias(k) for k, v in names.items()])
    blank = {f: F.lit(None).cast("string") for f in (
        "museum_type", "street_address", "address_source", "address_last_verified", "postal_code", "notes")}
    records = c.select(
        "id", F.col("name").alias("museum_name"), F.col("state").alias("state_province"), "city",
        F.when(key % 3 == 0, "old").alias("phone"), F.lit(None).cast("double").alias("latitude"),
        F.lit(None).cast("double").alias("longitude"),
        F.array(F.when(key % 7 == 0, "museums_csv").otherwise("seed")).alias("data_sources")
    ).withColumns(blank)
    # names that differ in their number only are not meant to match here
    out = phases.link_external(records, external, "row_no", F.lit(AS_OF), threshold=0.999)
    return out.select("id", "outcome", "phone", "latitude",
                      F.array_join("data_sources", ",").alias("sources"), "notes",
                      F.array_join("filled_fields", ",").alias("filled"))


# Titles of pages against other titles of the same state: some as they are in small letters, some
# without their last word, some without their first; the ratio by the recursion of `c4_fuzzy_match`.
_RATIO = _FUZZY[_FUZZY.index("seg AS ("):_FUZZY.index(", best AS (")]


def _plain(title: str) -> str:
    return (f"trim(regexp_replace(regexp_replace(regexp_replace(chr(1) || regexp_replace(lower({title}), "
            "'([^\\p{L}\\p{N}_])', chr(1) || '\\1' || chr(1), 'g') || chr(1), '\\x01("
            + "|".join(vocab.NAME_STOP_WORDS) + ")\\x01', '', 'g'), '[^\\p{L}\\p{N}_\\s]', '', 'g'), '\\s+', ' ', 'g'))")


@query("c4_link_titles", (
    "WITH RECURSIVE src AS (SELECT page_id AS id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, "
    f"{CODES_SQL}[page_id % 8 + 1] AS state FROM pages), rec AS (SELECT id, state, lower(title) AS raw, "
    f"{_plain('title')} AS k FROM src), given AS (SELECT id AS row_no, state, trim(CASE id % 6 WHEN 0 THEN lower(title) "
    "WHEN 2 THEN regexp_replace(title, ' [^ ]*$', '') || ' Hall' ELSE regexp_replace(title, '^[^ ]* ', '') END) AS t "
    f"FROM src WHERE id % 2 = 0), ext AS (SELECT *, lower(t) AS raw, {_plain('t')} AS k FROM given WHERE t <> ''), "
    "seen AS (SELECT state, k, min(row_no) AS row_no FROM ext GROUP BY state, k), exact AS (SELECT rec.id, "
    "min(row_no) AS row_no FROM rec JOIN ext USING (state, raw) GROUP BY rec.id), same AS (SELECT rec.id, row_no FROM "
    "rec JOIN seen USING (state, k) WHERE rec.id NOT IN (SELECT id FROM exact)), pairs AS (SELECT row_number() OVER () "
    "AS pid, * FROM (SELECT DISTINCT rec.state, rec.k AS a, seen.k AS b FROM rec JOIN seen USING (state) WHERE rec.id "
    "NOT IN (SELECT id FROM exact) AND rec.id NOT IN (SELECT id FROM same))), "
    f"{_RATIO}, near AS (SELECT rec.id, max(struct_pack(score := q.score, pos := -row_no)) AS m FROM rec JOIN ratio q "
    "ON q.state = rec.state AND q.a = rec.k JOIN seen ON seen.state = rec.state AND seen.k = q.b WHERE q.score >= 0.7 "
    "AND rec.id NOT IN (SELECT id FROM exact) AND rec.id NOT IN (SELECT id FROM same) GROUP BY rec.id), hit AS (SELECT "
    "id, row_no, 'exact' AS outcome, 1.0::DOUBLE AS score FROM exact UNION ALL SELECT id, row_no, 'fuzzy', 1.0 FROM same "
    "UNION ALL SELECT id, -m.pos, 'fuzzy', m.score FROM near) SELECT rec.id, coalesce(outcome, 'no_match') AS outcome, "
    "round(score, 6) AS match_score, CASE WHEN rec.id % 3 = 0 THEN 'old' ELSE '555-' || row_no END AS phone, CASE WHEN "
    "row_no IS NULL THEN 'seed' ELSE 'seed,museums_csv' END AS sources, 'CSV: IRS Museum ID ' || row_no || ' CSV: phone "
    "from IRS 990 database' AS notes FROM rec LEFT JOIN hit ON hit.id = rec.id"))
def link_titles(spark, path):
    (p,) = tables(spark, path, "pages")
    key, text_ = F.col("page_id"), F.col("page_id").cast("string")
    title = F.regexp_extract("html", r"<title>([^<]*)</title>", 1)
    spot = (key % 8 + 1).cast("int")
    code = F.element_at(F.array(*[F.lit(c) for c in CODES[:8]]), spot)
    other = (F.when(key % 6 == 0, F.lower(title)).when(key % 6 == 2, F.concat(
        F.regexp_replace(title, " [^ ]*$", ""), F.lit(" Hall"))).otherwise(F.regexp_replace(title, "^[^ ]* ", "")))
    names = {"Museum ID": text_, "Museum Name": other, "Museum Type": F.lit(""),
             "Phone Number": F.concat(F.lit("555-"), text_), "State (Administrative Location)": code,
             **{n: F.lit(" ") for n in phases.EXTERNAL_ROLES.values() if n not in (
                 "Museum ID", "Museum Type", "Phone Number")}}
    external = p.filter("page_id % 2 = 0").select(key.alias("row_no"), *[v.alias(k) for k, v in names.items()])
    blank = {f: F.lit(None).cast("string") for f in (
        "museum_type", "street_address", "address_source", "address_last_verified", "postal_code", "notes", "city")}
    records = p.select(
        key.alias("id"), title.alias("museum_name"),
        F.element_at(F.array(*[F.lit(s) for s in STATE_NAMES[:8]]), spot).alias("state_province"),
        F.when(key % 3 == 0, "old").alias("phone"), F.lit(None).cast("double").alias("latitude"),
        F.lit(None).cast("double").alias("longitude"), F.array(F.lit("seed")).alias("data_sources")).withColumns(blank)
    # the threshold the phase has in production
    out = phases.link_external(records, external, "row_no", F.lit(AS_OF))
    return out.select("id", "outcome", F.round("match_score", 6).alias("match_score"), "phone",
                      F.array_join("data_sources", ",").alias("sources"), "notes")


@query("c6_link_sheet", (
    f"WITH {SHEET}, near AS (SELECT id, arg_min(score, seen) AS score FROM rec JOIN dim ON length(rec.k) > 10 "
    "AND length(dim.k) > 10 AND (contains(rec.k, dim.k) OR contains(dim.k, rec.k)) WHERE rec.k NOT IN (SELECT "
    "k FROM dim) GROUP BY id), hit AS (SELECT id, score FROM rec JOIN dim ON rec.k = dim.k UNION ALL SELECT * "
    "FROM near), r AS (SELECT rec.id, hit.id IS NOT NULL AS found, hit.id IS NOT NULL AND rec.id % 5 <> 0 AND "
    "score <> 7 AS changed, score FROM rec LEFT JOIN hit ON rec.id = hit.id) SELECT id, CASE WHEN NOT found "
    "THEN 'not_found' WHEN id % 5 = 0 THEN 'current' WHEN changed THEN 'updated' ELSE 'no_change' END AS "
    "outcome, CAST(CASE WHEN changed THEN score ELSE 7 END AS INT) AS planner_score, CASE WHEN changed THEN "
    "'museum_planner_spreadsheet' ELSE '' END AS sources FROM r"))
def link_sheet(spark, path):
    at = F.lit("2026-01-01").cast("timestamp")
    records = sheet_records(spark, path).withColumns({
        "planner_score": F.lit(7), "data_sources": F.array().cast("array<string>"),
        "planner_data_updated_at": F.when(F.col("id") % 5 == 0, F.lit("2026-02-01")).cast("timestamp")})
    out = phases.link_sheet(records, sheet(spark, path), "row_no", ["score"], at,
                            F.lit("2026-03-01").cast("timestamp"), name="name", sheet_name="title")
    return out.select("id", "outcome", "planner_score", F.array_join("data_sources", ",").alias("sources"))


@query("j11_apply_scores", (
    f"WITH {ART}, r AS (SELECT *, CASE WHEN NOT scoreable THEN 'skipped_not_art' WHEN coalesce(imp, mod, hist, "
    "eca, cbs) IS NOT NULL AND id % 2 = 0 THEN 'skipped_already_scored' WHEN id % 3 = 0 THEN 'failed' ELSE "
    "'scored' END AS outcome FROM art) SELECT id, outcome, CAST(CASE WHEN outcome = 'scored' THEN id % 6 WHEN "
    "id % 2 = 0 THEN imp END AS INT) AS impressionist_strength, CAST(CASE WHEN outcome = 'scored' THEN 5 WHEN "
    "id % 2 = 0 THEN hist END AS INT) AS historical_context_score, CASE WHEN outcome = 'scored' THEN 'm' END "
    "AS scored_by, CASE WHEN outcome = 'scored' THEN true END AS must_see_candidate FROM r"))
def apply_scores(spark, path):
    a = art(spark, path)
    even = F.col("id") % 2 == 0
    given = {"impressionist_strength": "imp", "modern_contemporary_strength": "mod",
             "historical_context_score": "hist", "eca_score": "eca", "collection_based_strength": "cbs"}
    nothing = F.lit(None)
    records = a.select(
        "id", F.col("scoreable").alias("is_scoreable"),
        *[F.when(even, F.col(c)).alias(f) for f, c in given.items()],
        *[nothing.cast("int").alias(f) for f in ("confidence", "reputation")],
        *[nothing.cast("string").alias(f) for f in ("score_notes", "scored_by", "primary_art_focus")],
        nothing.cast("boolean").alias("must_see_candidate"))
    body = F.concat(F.lit('Here: {"impressionist_strength": '), (F.col("id") % 6).cast("string"),
                    F.lit(', "historical_context_score": 9}'))
    answers = a.select("id", F.when(F.col("id") % 3 == 0, "no {json").otherwise(body).alias("response"),
                       F.lit("m").alias("model"))
    out = phases.apply_scores(records, answers, "id", "response", "model")
    return out.select("id", "outcome", "impressionist_strength", "historical_context_score", "scored_by",
                      "must_see_candidate")


_STORED = "CASE WHEN id % 9 = 0 THEN 1 END"
_OUTCOME = (f"CASE WHEN NOT scoreable THEN 'not_art' WHEN id % 9 = 0 THEN 'already_scored' WHEN {OK2} THEN "
            "'scored' ELSE 'cannot_score' END")


def _stored(df):
    return df.withColumns({
        "priority_score": F.when(F.col("id") % 9 == 0, 1),
        "overall_quality_score": F.when(F.col("id") % 9 == 0, 2),
        "primary_art": F.lit(None).cast("string"), "scoring_version": F.lit(None).cast("string")})


@query("j9_score_records", (
    f"WITH {ART}, r AS (SELECT *, {_OUTCOME} AS outcome FROM art) SELECT id, outcome, CAST(CASE WHEN outcome = "
    f"'scored' THEN {P2} ELSE {_STORED} END AS INT) AS priority_score, CAST(CASE WHEN outcome = 'scored' THEN "
    f"{Q2} WHEN id % 9 = 0 THEN 2 END AS INT) AS overall_quality_score, CASE WHEN outcome = 'scored' THEN "
    "'mrd_v2' END AS scoring_version FROM r"))
def score_records(spark, path):
    out = phases.score_records(_stored(art(spark, path)), S, "scoreable")
    return out.select("id", "outcome", "priority_score", "overall_quality_score", "scoring_version")


_PEERS = "greatest(0, count(*) OVER (PARTITION BY coalesce(city, ''), coalesce(state, '')) - 1)"


@query("a9_build_index", (
    f"WITH {ART}, r AS (SELECT * EXCLUDE (nearby), {_PEERS} AS nearby FROM art), p AS (SELECT *, CASE WHEN "
    f"domain = 'Art' THEN {P1} END AS p1 FROM r) SELECT id, nearby, p1 AS priority_score, p1 IS NOT NULL AS "
    "is_scored, CASE WHEN p1 IS NOT NULL THEN 'v1.0' END AS scoring_version, CASE WHEN domain = 'Art' THEN "
    "CASE WHEN imp IS NULL AND mod IS NULL THEN NULL WHEN mod IS NULL OR imp > mod THEN 'Impressionist' ELSE "
    "'Modern/Contemporary' END END AS primary_art FROM p"))
def build_index(spark, path):
    a = _stored(art(spark, path)).withColumn("city_tier", F.lit(None).cast("int"))
    out = phases.build_index(a, "id", "city", "state", "domain", S, scores=True)
    return out.select("id", "nearby", "priority_score", "is_scored", "scoring_version", "primary_art")


def run(df):
    """Scores, then the index: the phases that need nothing but the records."""
    return phases.run_phases(df, [
        ("scores", lambda d: phases.score_records(d, S, "scoreable").drop("outcome")),
        ("index", lambda d: phases.build_index(d, "id", "city", "state", "domain", S)),
        ("skipped", lambda d: d.limit(0))], skip=["skipped"])


@query("i10_run_phases", (
    f"WITH {ART}, o AS (SELECT *, {_OUTCOME} AS outcome FROM art), s AS (SELECT *, CAST(CASE WHEN outcome = "
    f"'scored' THEN {P2} ELSE {_STORED} END AS INT) AS priority_score FROM o) SELECT id, priority_score, "
    f"{_PEERS} AS nearby, CAST(3 AS INT) AS city_tier, CASE WHEN domain = 'Art' THEN CASE WHEN outcome = "
    "'scored' AND coalesce(imp, 0) > coalesce(mod, 0) THEN 'Impressionist' WHEN outcome = 'scored' AND "
    "coalesce(mod, 0) + coalesce(imp, 0) > 0 THEN 'Modern/Contemporary' WHEN imp IS NULL AND mod IS NULL THEN "
    "NULL WHEN mod IS NULL OR imp > mod THEN 'Impressionist' ELSE 'Modern/Contemporary' END END AS primary_art "
    "FROM s"))
def run_phases(spark, path):
    # a second run over the result changes nothing, so the result of both is returned
    start = _stored(art(spark, path)).withColumn("city_tier", F.lit(None).cast("int"))
    twice = run(run(start))
    return twice.select("id", "priority_score", "nearby", "city_tier", "primary_art")


# The run over a roster file. External rows lie in four states, where every new record has one of its own name;
# sheet rows are some of the names, which others contain.
_EXTERNAL_CODES = ("AL", "CO", "NY", "TX")
_SHEET_KEY = "trim(regexp_replace(lower({}), '[^a-z0-9_\\s]', '', 'g'))"
_RUN = f"""{_FRESH}, s1 AS (
  SELECT row_no, block, state, name, CASE WHEN city <> '' THEN 'skipped' WHEN row_no % 2 = 0 AND row_no % 5 <> 0 THEN
    'updated' ELSE 'failed' END AS identity, city FROM kept
), s2 AS (
  SELECT *, CASE WHEN identity = 'updated' THEN 'Found ' || state WHEN city = '' THEN 'Unknown' ELSE city END AS town
  FROM s1
), ext AS (SELECT block, lower(name) AS raw, min(row_no) AS ext_no FROM s1 WHERE block IN {_EXTERNAL_CODES}
  GROUP BY ALL
), s3 AS (
  SELECT s2.*, ext_no, CASE WHEN ext_no IS NULL THEN 'no_match' ELSE 'exact' END AS external FROM s2 LEFT JOIN ext ON
    ext.block = s2.block AND ext.raw = lower(s2.name)
), dim AS (
  SELECT {_SHEET_KEY.format('name')} AS k, min(row_no) AS seen, arg_max(row_no % 6, row_no) AS score FROM s1
  WHERE row_no % 97 = 3 GROUP BY 1
), rec AS (SELECT DISTINCT {_SHEET_KEY.format('name')} AS k FROM s1
), near AS (
  SELECT rec.k, arg_min(score, seen) AS score FROM rec JOIN dim ON length(rec.k) > 10 AND length(dim.k) > 10 AND
    (contains(rec.k, dim.k) OR contains(dim.k, rec.k)) WHERE rec.k NOT IN (SELECT k FROM dim) GROUP BY rec.k
), found AS (SELECT k, score FROM dim UNION ALL SELECT k, score FROM near
), s4 AS (
  SELECT s3.*, score AS planner FROM s3 LEFT JOIN found ON found.k = {_SHEET_KEY.format('s3.name')}
), s5 AS (
  SELECT *, CAST(planner AS INT) AS imp, CAST(NULL AS INT) AS mod, CAST(NULL AS INT) AS hist, CAST(row_no % 4 AS INT)
    AS rep, 3 AS tier, count(*) OVER (PARTITION BY state, lower(trim(town))) - 1 AS nearby FROM s4
)"""


@query("i10_whole_run", (
    f"WITH {_RUN} SELECT row_no, identity AS identity_outcome, town AS city, 3::INT AS city_tier, nearby AS "
    "nearby_count, external AS external_outcome, '555-' || ext_no AS phone, CASE WHEN planner IS NULL THEN 'not_found' "
    "ELSE 'updated' END AS sheet_outcome, CAST(planner AS INT) AS planner_score, CASE WHEN planner IS NULL THEN "
    f"'cannot_score' ELSE 'scored' END AS scores_outcome, {P2} AS priority_score, 'seed' || CASE WHEN identity = "
    "'updated' THEN ',google_places_api' ELSE '' END || CASE WHEN ext_no IS NOT NULL THEN ',museums_csv' ELSE '' END "
    "|| CASE WHEN planner IS NOT NULL THEN ',museum_planner_spreadsheet' ELSE '' END AS sources, count(*) OVER "
    "(PARTITION BY town, state) - 1 AS index_nearby FROM s5"))
def whole_run(spark, path):
    target = scratch_path(spark, "roster")
    writers.write_csv(roster(spark, path).orderBy("row_no").select(
        F.col("city").alias("CITY"), F.col("state").alias("STATE"), F.col("url").alias("URL"),
        F.col("name").alias("NAME"), F.col("row_no").alias("ORDER")), target)
    read, _ = readers._csv_rows(spark, target, readers.ROSTER_HEADERS, True, "line")
    rows = read.select(readers._cell("ORDER").cast("bigint").alias("row_no"), *[
        F.coalesce(readers._cell(c), F.lit("")).alias(c) for c in readers.ROSTER_HEADERS]).withColumn(
        "block", derive.region_code("STATE"))
    key = F.col("row_no")
    text_ = key.cast("string")
    records = known(spark, path).select(
        F.col("block").alias("state_code"), F.col("state").alias("state_province"),
        F.col("name").alias("museum_name"), "city", F.col("url").alias("website"))
    roles = {"block": "block", "state": "STATE", "name": "NAME", "city": "CITY", "url": "URL"}
    # answers and tables for all rows of the roster; only new records look them up
    identity = rows.filter("row_no % 2 = 0").select(
        "row_no", (key % 5 != 0).alias("success"), F.concat(F.lit("Found "), "STATE").alias("city"),
        *[F.lit(None).cast(t).alias(f) for f, t in (
            ("street_address", "string"), ("postal_code", "string"), ("latitude", "double"),
            ("longitude", "double"), ("place_id", "string"), ("phone", "string"))])
    names = {"Museum ID": text_, "Museum Name": F.col("museum_name"), "Phone Number": F.concat(F.lit("555-"), text_),
             "State (Administrative Location)": F.col("state_code"),
             **{n: F.lit(" ") for n in phases.EXTERNAL_ROLES.values() if n not in ("Museum ID", "Phone Number")}}
    # the other tables are made of the new records, which are found once
    new = phases.new_records(rows, records, roles, "row_no", F.lit(AS_OF))
    external = new.filter(F.col("state_code").isin(*_EXTERNAL_CODES)).select(
        "row_no", *[v.alias(k) for k, v in names.items()])
    planner = new.filter("row_no % 97 = 3").select(
        "row_no", "museum_name", (key % 6).cast("int").alias("score"))
    modified = F.lit("2026-01-01").cast("timestamp")
    inputs = {"imp": F.col("planner_score"), "rep": (key % 4).cast("int"), "tier": F.col("city_tier"),
              "nearby": F.col("nearby_count").cast("int"),
              **{c: F.lit(None).cast("int") for c in ("mod", "hist", "eca", "cbs")}}
    out = phases.whole_run(new, "row_no", identity, external, planner, modified, ["score"], inputs, S, F.lit(AS_OF))
    return out.select("row_no", "identity_outcome", "city", "city_tier", "nearby_count", "external_outcome", "phone",
                      "sheet_outcome", "planner_score", "scores_outcome", "priority_score",
                      F.array_join("data_sources", ",").alias("sources"), F.col("nearby").alias("index_nearby"))
