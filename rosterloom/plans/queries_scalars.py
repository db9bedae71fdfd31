"""Scalar expressions: placeholders, names, URLs, keys, types, claims, JSON."""

from pyspark.sql import functions as F

from ..functions import derive, scoring, text, vocab
from ..operators import merge
from .bindings import ART, CUST, DOC, EVT, art, cust, doc, evt
from .registry import query


def _cust(select: str, tail: str = "") -> str:
    return f"WITH {CUST} SELECT {select} FROM cust {tail}"


_TRIM_CITY = "lower(regexp_replace(raw_city, '^\\s+|\\s+$', '', 'g'))"


def _missing_sql(words):
    quoted = ", ".join("'" + w + "'" for w in words)
    return f"raw_city IS NULL OR {_TRIM_CITY} IN ({quoted})"


@query("b2_missing_sets", _cust("id, " + ", ".join(
    f"{_missing_sql(vocab.PLACEHOLDERS[k])} AS missing_{k}"
    for k in ("fill", "write", "resolve", "report", "documented"))))
def missing_sets(spark, path):
    return cust(spark, path).select("id", *[
        text.is_missing("raw_city", k).alias(f"missing_{k}")
        for k in ("fill", "write", "resolve", "report", "documented")])


@query("b3_needs_resolution", _cust(
    f"id, ({_missing_sql(vocab.PLACEHOLDERS['resolve'])}) OR (nk < 20 AND CAST(id % 8 AS INT) = 5) "
    "AS needed"))
def needs_resolution(spark, path):
    return cust(spark, path).select("id", derive.needs_resolution("raw_city").alias("needed"))


@query("h1_slugify", _cust(
    "id, regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') "
    "AS slug"))
def slugify(spark, path):
    return cust(spark, path).select("id", text.slugify("name").alias("slug"))


_ID_SQL = ("'usa-' || lower(code) || '-' || CASE WHEN id % 8 IN (2, 4) THEN 'unknown' ELSE "
           "regexp_replace(regexp_replace(lower(raw_city), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', "
           "'g') END || '-' || regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g')")


def _entity_id():
    return text.entity_id(F.lit("USA"), "code", "raw_city", "name")


@query("h2_entity_id", _cust(f"id, {_ID_SQL} AS entity_id"))
def entity_id(spark, path):
    return cust(spark, path).select("id", _entity_id().alias("entity_id"))


@query("h3_normalize_url", _cust(
    "id, lower(regexp_replace(replace(regexp_replace(url, '\\s+', '', 'g'), '://%20', '://'), '/+$',"
    " '')) AS url_key"))
def normalize_url(spark, path):
    return cust(spark, path).select("id", text.normalize_url("url").alias("url_key"))


@query("h4_normalize_website", "SELECT page_id AS id, regexp_replace(trim(url), '/+$', '') AS site, "
       "regexp_replace(trim('  ' || url || '//  '), '/+$', '') AS padded FROM pages")
def normalize_website(spark, path):
    p = spark.read.parquet(f"{path}/pages.parquet")
    return p.select(F.col("page_id").alias("id"), text.normalize_website("url").alias("site"),
                    text.normalize_website(F.concat(F.lit("  "), "url", F.lit("//  ")))
                    .alias("padded"))


@query("h5_is_http_url", _cust(
    "id, coalesce(regexp_matches(trim(url), '(?i)^https?://[^/?#]+'), false) AS ok"))
def is_http_url(spark, path):
    return cust(spark, path).select("id", text.is_http_url(text.strip("url")).alias("ok"))


_DOC_NAME = "'The ' || source || '''s Museum of ' || lang || ' & ' || text"


def _doc_name():
    return F.concat(F.lit("The "), "source", F.lit("'s Museum of "), "lang", F.lit(" & "), "text")


# The \b of the check only knows ASCII letters, so word borders are marked with chr(1) there.
_STOP = "|".join(vocab.NAME_STOP_WORDS)


@query("h6_match_name", (
    "SELECT doc_id AS id, trim(regexp_replace(regexp_replace(regexp_replace(chr(1) || "
    f"regexp_replace(lower({_DOC_NAME}), '([^\\p{{L}}\\p{{N}}_])', chr(1) || '\\1' || chr(1), 'g') || "
    f"chr(1), '\\x01({_STOP})\\x01', '', 'g'), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+', ' ', 'g'"
    ")) AS words FROM documents"))
def match_name(spark, path):
    d = spark.read.parquet(f"{path}/documents.parquet")
    return d.select(F.col("doc_id").alias("id"), text.match_name(_doc_name()).alias("words"))


@query("h7_plain_name", (
    f"SELECT doc_id AS id, trim(regexp_replace(regexp_replace(replace(lower({_DOC_NAME}), '''', '')"
    ", '[^\\p{L}\\p{N}_\\s]', '', 'g'), '\\s+', ' ', 'g')) AS name_key FROM documents"))
def plain_name(spark, path):
    d = spark.read.parquet(f"{path}/documents.parquet")
    return d.select(F.col("doc_id").alias("id"), text.plain_name(_doc_name()).alias("name_key"))


@query("h9_normalize_type", (
    f"WITH {ART} SELECT id, CASE trim(lower(kind)) WHEN 'art museum' THEN 'Art Museum' WHEN 'fine "
    "art' THEN 'Fine Art' WHEN 'history museum' THEN 'History Museum' WHEN 'university museum' THEN "
    "'University Art Museum' WHEN 'zoo' THEN 'Zoo/Aquarium' WHEN 'children''s museum' THEN "
    "'Children''s Museum' ELSE CASE WHEN lower(kind) LIKE '%art%' THEN 'Art Museum' ELSE trim(kind) "
    "END END AS type_name, CASE WHEN name LIKE '%plate%' THEN 'Memorial' WHEN name LIKE '%art%' THEN"
    " 'Art Museum' ELSE upper(name[1]) || lower(split_part(name, ' ', 1)[2:]) || ' ' || "
    "upper(split_part(name, ' ', 2)[1]) || split_part(name, ' ', 2)[2:] END AS titled FROM art"))
def normalize_type(spark, path):
    named = F.when(F.col("name").contains("plate"), F.concat(F.lit("plate memorial "), "name")
                   ).otherwise(F.col("name"))
    return art(spark, path).select(
        "id", derive.normalize_type("kind").alias("type_name"),
        derive.normalize_type(named, title_case=True).alias("titled"))


@query("h10_visit_length", (
    f"WITH {ART} SELECT id, CASE WHEN lower(kind) LIKE '%university%' THEN 'Full day' WHEN name LIKE"
    " '%bolt%' THEN 'Quick stop (<1 hr)' ELSE 'Half day' END AS visit FROM art"))
def visit_length(spark, path):
    kind = F.when(F.lower("kind").contains("university"), F.concat("kind", F.lit(" National Gallery"))
                  ).otherwise(F.col("kind"))
    name = F.when(F.col("name").contains("bolt"), F.concat("name", F.lit(" Memorial"))).otherwise(
        F.col("name"))
    return art(spark, path).select("id", derive.visit_length(kind, name).alias("visit"))


@query("h11_visit_synonyms", (
    "SELECT p_partkey AS id, CASE CAST(p_size % 6 AS INT) WHEN 0 THEN 'Quick stop (<1 hr)' WHEN 1 "
    "THEN 'Full day' WHEN 2 THEN NULL WHEN 3 THEN 'Half day' WHEN 4 THEN 'Half day' END AS visit "
    "FROM part"))
def visit_synonyms(spark, path):
    raw = F.try_element_at(F.array(*[F.lit(v) for v in (
        "1-2 hours", " FULL DAY ", "3 days", "half-day", "Half Day (2-4 hours)")]),
        (F.col("p_size") % 6 + 1).cast("int"))
    return spark.read.parquet(f"{path}/part.parquet").select(
        F.col("p_partkey").alias("id"), derive.normalize_visit_length(raw).alias("visit"))


_CITIES = ("New York", " Raleigh ", "Boise", "Annapolis", "Nowhere", "TBD", "unknown")
_CITY_SQL = "[" + ", ".join(f"'{c}'" for c in _CITIES) + "]"


@query("h12_city_tier_listed", (
    f"SELECT c_custkey AS id, CAST(CASE trim({_CITY_SQL}[CAST(c_custkey % 8 AS INT) + 1]) WHEN 'New "
    "York' THEN 1 WHEN 'Annapolis' THEN 2 WHEN 'Raleigh' THEN 3 WHEN 'Boise' THEN 3 WHEN 'Nowhere' "
    "THEN 3 END AS INT) AS tier FROM customer"))
def city_tier_listed(spark, path):
    city = F.try_element_at(F.array(*[F.lit(c) for c in _CITIES]),
                            (F.col("c_custkey") % 8 + 1).cast("int"))
    return spark.read.parquet(f"{path}/customer.parquet").select(
        F.col("c_custkey").alias("id"), derive.city_tier_listed(city).alias("tier"))


@query("h13_region_code", _cust(
    "id, code AS region_code, CASE WHEN nk < 20 THEN ' ' || upper(state) || ' ' ELSE 'International'"
    " END AS region_name"))
def region_code(spark, path):
    messy = F.concat(F.lit(" "), F.upper("state"), F.lit(" "))
    return cust(spark, path).select("id", derive.region_code(messy).alias("region_code"),
                                    derive.region_name(messy).alias("region_name"))


@query("h14_state_of_id", _cust(
    "id, CASE WHEN id % 8 = 2 THEN upper(city) ELSE code END AS token, CASE WHEN id % 8 = 2 THEN "
    "NULL ELSE code END AS home, CASE WHEN id % 8 <> 2 THEN code END AS strict"))
def state_of_id(spark, path):
    key = F.when(F.col("id") % 8 == 2, F.concat_ws("-", F.lit("fr"), "city", "name")).otherwise(
        F.concat_ws("-", F.lit("usa"), F.lower("code"), "city"))
    return cust(spark, path).select("id", *[
        text.state_of_id(key, v).alias(v) for v in ("token", "home", "strict")])


@query("h15_hash_keys", _cust(
    f"id, 'm_' || left(sha256({_ID_SQL}), 8) AS folder, left(sha256(lower(name || '|' || state)), "
    "16) AS lookup, left(sha256(coalesce(url, '')), 16) AS page, sha256('{\"params\": {\"city\": "
    "\"' || city || '\", \"q\": \"' || name || '\\\" \\u00e9\\t\\n\\u0001\\\\\\ud83d\\ude00\\u007f\"}, \"url\": "
    "\"http://x\"}') AS request"))
def hash_keys(spark, path):
    # quotes, accents, control characters, a backslash and a character beyond 16 bits
    odd = F.concat("name", F.lit('" \u00e9\t\n\u0001\\\U0001F600\u007f'))
    params = F.create_map(F.lit("q"), odd, F.lit("city"), "city")
    return cust(spark, path).select(
        "id", text.folder_hash(_entity_id()).alias("folder"),
        text.lookup_key("name", "state").alias("lookup"),
        text.url_key(F.coalesce("url", F.lit(""))).alias("page"),
        text.request_key(F.lit("http://x"), params).alias("request"))


@query("h16_slug_alias", _cust(
    "id, lower(city) || '-' || regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g') || '--' || "
    "right(lpad(CAST(id AS VARCHAR), 9, '0'), 6) AS slug_alias"))
def slug_alias(spark, path):
    return cust(spark, path).select(
        "id", text.slug_alias("city", "name", _entity_id()).alias("slug_alias"))


@query("h17_infobox_population", (
    "SELECT o_orderkey AS id, CASE WHEN o_orderstatus <> 'P' THEN CAST(round(o_totalprice) AS "
    "BIGINT) END AS population FROM orders"))
def infobox_population(spark, path):
    o = spark.read.parquet(f"{path}/orders.parquet")
    label = F.when(F.col("o_orderstatus") == "F", "| Population_total = ").when(
        F.col("o_orderstatus") == "O", "|population total=").otherwise("| density = ")
    wikitext = F.concat(F.lit("{{Infobox "), label, F.format_number(F.round("o_totalprice"), 0),
                        F.lit(" <ref>"))
    return o.select(F.col("o_orderkey").alias("id"),
                    text.infobox_population(wikitext).alias("population"))


# Document text: every white space run becomes one blank, then a cut at 2000.
_FLAT = "trim(regexp_replace(text, '[\\s\\p{Z}\\x{85}\\x{1c}-\\x{1f}\\x{0b}]+', ' ', 'g'))"


@query("h18_collapse_and_cut", (
    f"SELECT doc_id AS id, CASE WHEN length({_FLAT}) > 2000 THEN left({_FLAT}, 2000) || '...' ELSE "
    f"{_FLAT} END AS extract FROM documents"))
def collapse_and_cut(spark, path):
    d = spark.read.parquet(f"{path}/documents.parquet")
    return d.select(F.col("doc_id").alias("id"),
                    text.cut(text.collapse_spaces("text"), 2000).alias("extract"))


def _pick_answer():
    """Answers that are no numbers: all of them give null."""
    answers = F.array(*[F.lit(x) for x in ('"x"', '"Infinity"', '"NaN"', '"-Infinity"', "NaN", '"4"')])
    return F.get(answers, (F.col("k") % 6).cast("int"))


def _response():
    """A model answer around one JSON object whose fields come from the event."""
    note = F.concat(F.lit("note "), F.repeat(F.col("kind"), (F.col("k") * 3).cast("int")))
    return F.concat(
        F.lit('Sure: {"impressionist_strength": '), F.col("k").cast("string"),
        F.lit(', "modern_contemporary_strength": '), (F.col("k") - 50).cast("string"),
        F.lit(', "historical_context_score": '), F.col("value").cast("string"),
        F.lit(', "eca_score": '), _pick_answer(), F.lit(', "collection_based_strength": null, "confidence": '),
        (F.col("k") % 7).cast("string"), F.lit(', "reputation": '),
        (F.col("k") % 5).cast("string"), F.lit(', "score_notes": "'), note, F.lit('"} done'))


@query("h19_validated_scores", (
    f"WITH {EVT} SELECT id, CAST(least(5, k) AS INT) AS impressionist_strength, CAST(greatest(0, "
    "least(5, k - 50)) AS INT) AS modern_contemporary_strength, CAST(greatest(0, least(5, "
    "trunc(value))) AS INT) AS historical_context_score, CAST(NULL AS INT) AS eca_score, CAST(NULL "
    "AS INT) AS collection_based_strength, CAST(greatest(1, least(5, k % 7)) AS INT) AS confidence, "
    "CAST(least(3, k % 5) AS INT) AS reputation, left('note ' || repeat(kind, CAST(k * 3 AS INT)), "
    "500) AS score_notes FROM evt"))
def validated_scores(spark, path):
    scored = scoring.validated_scores(evt(spark, path), _response())
    return scored.select("id", *scoring.SCORE_RANGES, "score_notes")


@query("h20_json_in_text", f"WITH {EVT} SELECT id, '{{\"k\":' || k || '}}' AS body FROM evt")
def json_in_text(spark, path):
    noisy = F.concat(F.lit("Answer\n"), F.to_json(F.struct("k")), F.lit("\nthanks"))
    return evt(spark, path).select("id", text.json_object_in(noisy).alias("body"))


def _components():
    """Address components whose city type depends on the customer."""
    kinds = F.try_element_at(F.array(*[F.lit(k) for k in (*vocab.CITY_COMPONENTS, "route")]),
                             (F.col("id") % 5 + 1).cast("int"))

    def part(long, short, kind):
        return F.struct(long.alias("long_name"), short.alias("short_name"),
                        F.array(kind, F.lit("political")).alias("types"))

    return F.array(
        part(F.concat(F.lit("Old "), "city"), F.col("city"), F.lit("administrative_area_level_3")),
        part(F.col("city"), F.col("city"), kinds),
        part(F.col("state"), F.col("code"), F.lit("administrative_area_level_1")),
        part(F.lpad(F.col("id").cast("string"), 5, "0"), F.lit(""), F.lit("postal_code")))


@query("h21_address_components", _cust(
    "id, CASE WHEN id % 5 < 3 THEN city ELSE 'Old ' || city END AS city, code AS state, "
    "lpad(CAST(id AS VARCHAR), 5, '0') AS postal_code"))
def address_components(spark, path):
    c = cust(spark, path).withColumn("parts", _components())
    return c.select("id", derive.component_city("parts").alias("city"),
                    derive.component("parts", "administrative_area_level_1", "short_name")
                    .alias("state"),
                    derive.component("parts", "postal_code").alias("postal_code"))


@query("h22_state_mismatch", _cust(
    "id, id % 3 = 0 OR (code = 'ZZ' AND upper(state) <> 'ZZ') AS mismatch"))
def state_mismatch(spark, path):
    found = F.when(F.col("id") % 3 == 0, "XX").otherwise(F.lower("code"))
    return cust(spark, path).select("id", derive.state_mismatch("state", found).alias("mismatch"))


@query("h23_claim_value", _cust(
    "id, CASE WHEN id % 8 IN (2, 4) THEN city ELSE raw_city END AS first_value, CAST(NULL AS "
    "VARCHAR) AS absent"))
def claim_value(spark, path):
    claims = F.create_map(F.lit("P281"), F.array(F.nullif("raw_city", F.lit("")), F.col("city")))
    return cust(spark, path).select("id", derive.claim_value(claims, "P281").alias("first_value"),
                                    derive.claim_value(claims, "P999").alias("absent"))


@query("h30_source_sentences", _cust(
    "id, trim(coalesce(CASE WHEN id % 2 = 0 THEN 'IRS: IRS Museum ID ' || id || ' ' END, '') || "
    "CASE WHEN balance > 0 THEN '' ELSE 'seen before ' END || 'IRS: phone from 990 database ' || "
    "'IRS: museum type ''' || city || ''' ' || CASE WHEN balance > 0 THEN 'IRS: financial data "
    "available (income: ' || CAST(CAST(floor(balance) AS BIGINT) AS VARCHAR) || ', revenue: N/A)' ELSE '' "
    "END) AS notes"))
def source_sentences(spark, path):
    none = F.lit(None).cast("string")
    ext_id = F.when(F.col("id") % 2 == 0, F.col("id").cast("string"))
    income = F.when(F.col("balance") > 0, F.floor("balance").cast("string"))
    sentences = merge.source_sentences(
        "IRS", "990", ext_id, F.lit("555"), F.col("city"), F.lit(0.0), F.lit(0.0), none, income,
        none)
    notes = F.when(~(F.col("balance") > 0), F.concat_ws(" ", F.when(
        F.col("id") % 2 == 0, F.concat(F.lit("IRS: IRS Museum ID "), F.col("id").cast("string"))),
        F.lit("seen before")))
    return cust(spark, path).select("id", merge.append_sentences(notes, sentences).alias("notes"))


@query("h32_external_fields", _cust(
    "id, CASE WHEN id % 8 IN (2, 4) THEN city ELSE trim(raw_city) END AS city, CASE WHEN "
    "id % 4 = 0 THEN CAST(id AS VARCHAR) || ' Admin Rd' ELSE CAST(id AS VARCHAR) || ' Main St' END "
    "AS street, CASE WHEN id % 3 <> 0 THEN balance END AS lat, CASE WHEN id % 3 <> 0 THEN "
    "CAST('-' || nk AS DOUBLE) END AS lon"))
def external_fields(spark, path):
    sid = F.col("id").cast("string")
    blank = F.lit(" ")
    c = cust(spark, path).select(
        "id", F.col("raw_city").alias("city1"), F.col("city").alias("city2"),
        F.when(F.col("id") % 4 == 0, blank).otherwise(F.concat(sid, F.lit(" Main St"))).alias("s1"),
        F.concat(sid, F.lit(" Admin Rd ")).alias("s2"),
        F.when(F.col("id") % 3 == 0, "n.a.").otherwise(F.col("balance").cast("string")).alias("la"),
        F.concat(F.lit(" -"), F.col("nk").cast("string")).alias("lo"), blank.alias("blank"))
    roles = {k: "blank" for k in ("id", "phone", "type", "zip", "zip_admin", "income", "revenue")}
    roles |= {"lat": "la", "lon": "lo", "street": "s1", "street_admin": "s2", "city": "city1",
              "city_admin": "city2"}
    f = merge.external_fields(roles)
    return c.select("id", f["ext_city"].alias("city"), f["ext_street"].alias("street"),
                    f["ext_lat"].alias("lat"), f["ext_lon"].alias("lon"))


@query("h37_iso_timestamps", (
    f"WITH {EVT} SELECT id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at, strftime(ts, '%Y-%m-%d') AS "
    "day FROM evt"))
def iso_timestamps(spark, path):
    return evt(spark, path).select("id", text.iso_utc("ts").alias("at"),
                                   F.date_format("ts", "yyyy-MM-dd").alias("day"))


@query("h38_previews", (
    "SELECT doc_id AS id, CASE WHEN length(text) > 60 THEN left(text, 60) || '...' ELSE text END AS "
    "preview, left(text, 100) AS head FROM documents"))
def previews(spark, path):
    return spark.read.parquet(f"{path}/documents.parquet").select(
        F.col("doc_id").alias("id"), text.cut("text", 60).alias("preview"),
        F.left("text", F.lit(100)).alias("head"))


@query("c13_code_maps", _cust(
    "id, CASE WHEN nk < 20 THEN code END AS code, nk < 20 AS is_us"))
def code_maps(spark, path):
    code = derive.region_code("state", None)
    return cust(spark, path).select("id", code.alias("code"), code.isNotNull().alias("is_us"))


@query("k9_placeholder_defence", _cust(
    "id, raw_city AS new_value", "WHERE id % 8 IN (3, 6)"))
def placeholder_defence(spark, path):
    from ..operators import quality
    rows = cust(spark, path).withColumn("new_value", F.col("raw_city"))
    return quality.blocked_writes(rows, "id", "new_value")


@query("b1_scope_filter", _cust(
    "id, code IN ('CO', 'NY') AS in_list, id = 7 AS is_one, nk < 20 OR code = 'ZZ' AS in_all"))
def scope_filter(spark, path):
    one = "usa-co-household-customer-000000007"
    c = cust(spark, path).withColumn("key", F.when(F.col("id") == 7, one).otherwise(F.concat(
        F.lit("usa-"), F.lower("code"), F.lit("-x-"), F.col("id").cast("string"))))
    code = F.when(F.col("id") == 7, "CO").otherwise(F.col("code"))
    return c.select("id", derive.in_scope("code", "key", states="co, ny").alias("in_list"),
                    derive.in_scope(code, "key", entity=one).alias("is_one"),
                    derive.in_scope("code", "key").alias("in_all"))


@query("b14_evidence_packet", (
    f"WITH {DOC} SELECT id, '{{\"museum_name\":\"' || source || '\"' || ',\"museum_type\":\"' || lang || '\"' || "
    "CASE WHEN quality = 1 THEN ',\"wikipedia_summary\":\"len ' || n_chars || '\"' ELSE '' END || "
    "CASE WHEN quality IS NOT NULL OR toxic IS NOT NULL THEN ',\"existing_assessments\":{' || "
    "'\"prior_reputation\":' || quality || ',\"prior_collection_tier\":' || toxic || '}' ELSE '' "
    "END || ',\"institutional_signals\":{\"nearby_museums\":' || n_chars || '}' || CASE WHEN topic IS NOT "
    "NULL THEN ',\"notes\":\"' || topic || '\"' ELSE '' END || '}' AS packet FROM doc"))
def evidence_packet(spark, path):
    from ..operators import evidence
    d = doc(spark, path).select(
        "id", "source", "lang", "quality", "toxic", "n_chars", "topic",
        F.lit(None).cast("string").alias("none"), F.array().cast("array<string>").alias("no_topics"),
        F.lit(0).alias("zero"), (F.col("quality") == 1).alias("found"),
        F.concat(F.lit("len "), F.col("n_chars").cast("string")).alias("extract"))
    roles = {"name": "source", "city": "none", "state": "none", "type": "lang", "domain": "none",
             "topics": "no_topics", "reputation": "quality", "tier": "toxic", "city_tier": "zero",
             "nearby": "n_chars", "website": "none", "notes": "topic", "found": "found",
             "extract": "extract", "page_url": "none"}
    return d.select("id", evidence.evidence_packet(roles).alias("packet"))


@query("b15_text_context", (
    f"WITH {DOC} SELECT id, coalesce(nullif(concat_ws(chr(10) || chr(10), CASE WHEN lang = 'de' THEN "
    "'Website Description: ' || source END, CASE WHEN lang = 'en' THEN 'About: ' || left(text, 500) END,"
    " CASE WHEN quality = 1 THEN 'Wikipedia: ' || left(text, 600) END, CASE WHEN n_chars > 2000 THEN "
    "'Visitor Info: Hours available, Admission: ' || n_chars WHEN lang = 'es' THEN 'Visitor Info: "
    "Admission: ' || n_chars END, CASE WHEN quality IS NOT NULL THEN 'Type: ' || lang || ' | Reputation: "
    "' || CASE quality WHEN 0 THEN 'International' ELSE 'National' END || ' | Curatorial Authority: "
    "Unknown' END), ''), 'Limited information available') AS context FROM doc"))
def record_context(spark, path):
    from ..operators import evidence
    known = F.col("quality").isNotNull()
    d = doc(spark, path).withColumns({
        "description": F.when(F.col("lang") == "de", F.col("source")),
        "about": F.when(F.col("lang") == "en", F.col("text")),
        "extract": F.when(F.col("quality") == 1, F.col("text")),
        "wikidata": F.lit(""), "kind": F.when(known, F.col("lang")),
        "eca": F.when(known, F.lit(9)), "none": F.lit(None).cast("int"), "no": F.lit(False)})
    hours = F.col("n_chars") > 2000
    fee = F.when(hours | (F.col("lang") == "es"), F.col("n_chars").cast("string"))
    roles = {c: c for c in ("description", "about", "extract", "wikidata", "eca")}
    roles |= {"type": "kind", "reputation": "quality", "collection": "none", "must_see": "no"}
    return d.select("id", evidence.record_context(
        roles, evidence.visitor_info(hours, fee, F.lit(False))).alias("context"))
