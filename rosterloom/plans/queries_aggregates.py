"""Progress, counters, coverage, top and last per key, set operations."""

from pyspark.sql import functions as F

from ..functions import derive, text
from ..operators import groups, merge, quality, reconcile, runs
from .bindings import ART, CUST, DOC, EVT, art, cust, doc, evt, tables
from .registry import query
from ..operators import browse
from .bindings import score_columns

S = score_columns()
FIELDS = ("topic", "status", "quality", "text", "lang")
_MISS = {
    "topic": "topic IS NULL OR lower(trim(topic)) IN ('', 'tbd', 'unknown', 'n/a')",
    "status": "status IS NULL OR lower(trim(status)) IN ('', 'tbd', 'unknown', 'n/a')",
    "quality": "quality IS NULL",
    "text": "text IS NULL OR length(text) <= 7 AND lower(trim(text)) IN ('', 'tbd', 'unknown', 'n/a')",
    "lang": "lang IS NULL OR lower(trim(lang)) IN ('', 'tbd', 'unknown', 'n/a')",
}
_GAPS = " UNION ALL ".join(
    f"SELECT id, source, '{f}' AS field FROM doc WHERE {_MISS[f]}" for f in FIELDS)
_FULL = "NOT (" + " OR ".join(f"({c})" for c in _MISS.values()) + ")"


def profile():
    return quality.Profile(FIELDS, tags=(), confidence=())


@query("d2_progress_by_region", (
    f"WITH {DOC}, s AS (SELECT upper(source) AS region, {_FULL} AS is_full FROM doc) SELECT "
    "coalesce(region, 'total') AS level, count(*) AS total, count(*) FILTER (is_full) AS full, "
    "count(*) FILTER (NOT is_full) AS placeholder, round(count(*) FILTER (is_full) * 100.0 / "
    "count(*), 2) AS full_pct FROM s GROUP BY ROLLUP (region)"))
def progress_by_region(spark, path):
    d = doc(spark, path)
    return quality.progress(d, "source", quality.is_full(d, profile())).drop("region")


@query("d3_missing_report", (
    f"WITH {DOC}, g AS ({_GAPS}) SELECT CASE WHEN grouping(source) = 1 THEN 'total' ELSE "
    "upper(source) END AS level, field, count(*) AS n FROM g GROUP BY GROUPING SETS ((field), "
    "(source, field))"))
def missing_report(spark, path):
    d = doc(spark, path)
    return quality.missing_report(d, "source", quality.missing_fields(d, profile())).drop("region")


@query("d4_missing_examples", (
    f"WITH {DOC}, g AS ({_GAPS}), r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY id) "
    "AS rank FROM g) SELECT field, CAST(rank AS INT) AS rank, id, source FROM r WHERE rank <= 10"))
def missing_examples(spark, path):
    d = doc(spark, path)
    return quality.missing_examples(d, "id", quality.missing_fields(d, profile()), ["source"])


@query("f6_frequency_order", (
    f"WITH {DOC}, g AS ({_GAPS}) SELECT field, count(*) AS n FROM g GROUP BY field ORDER BY n DESC, "
    "field"))
def frequency_order(spark, path):
    d = doc(spark, path)
    report = quality.missing_report(d, "source", quality.missing_fields(d, profile()))
    return report.filter("level = 'total'").select("field", "n").orderBy(F.desc("n"), "field")


@query("d22_field_completeness", (
    f"WITH {DOC} SELECT source, round(avg(" + " + ".join(
        f"CASE WHEN {_MISS[f]} THEN 0 ELSE 1 END" for f in FIELDS)
    + ") * 100.0 / 5, 6) AS completeness FROM doc GROUP BY source"))
def field_completeness(spark, path):
    d = doc(spark, path)
    return d.groupBy("source").agg(
        F.round(F.avg(quality.completeness(d, FIELDS)), 6).alias("completeness"))


_KINDS = ("updated", "skipped", "failed")


@query("d5_phase_counters", (
    f"WITH {EVT} SELECT CASE WHEN grouping(kind) = 1 THEN 'total' ELSE kind END AS level, count(*) AS"
    " processed, " + ", ".join(f"count(*) FILTER (outcome = '{k}') AS {k}" for k in _KINDS)
    + " FROM evt GROUP BY ROLLUP (kind)"))
def phase_counters(spark, path):
    return runs.outcome_counters(evt(spark, path), "kind", "outcome", _KINDS).drop("kind")


@query("d5_flagged_records", f"WITH {EVT} SELECT kind, id FROM evt WHERE outcome = 'failed'")
def flagged_records(spark, path):
    return runs.flagged(evt(spark, path), "id", "kind", "outcome")


@query("d6_match_rates", (
    f"WITH {EVT} SELECT uid, CASE WHEN count(*) FILTER (kind <> 'signup') = 0 THEN '0%' ELSE "
    "format('{:.1f}%', round(count(*) FILTER (outcome = 'updated') * 100.0 / count(*) FILTER (kind <>"
    " 'signup'), 1)) END AS match_rate FROM evt GROUP BY uid"))
def match_rates(spark, path):
    return evt(spark, path).groupBy("uid").agg(runs.rate_text(
        F.count_if(F.col("outcome") == "updated"), F.count_if(F.col("kind") != "signup"))
        .alias("match_rate"))


@query("a12_run_summary", (
    f"WITH {EVT} SELECT 'run-1' AS run_id, 'backbone' AS phase, count(DISTINCT uid) AS regions, "
    "count(*) AS total_processed, " + ", ".join(
        f"count(*) FILTER (outcome = '{k}') AS {k}" for k in _KINDS)
    + ", '2026-01-01T00:00:00Z' AS completed_at FROM evt"))
def run_summary(spark, path):
    from ..session import scratch_path
    from ..sources import writers
    summary = runs.run_summary(evt(spark, path), "outcome", _KINDS, "uid", "backbone", "run-1",
                               F.lit("2026-01-01").cast("timestamp_ntz"))
    target = scratch_path(spark, "runs")
    writers.append_run(summary, target)
    return spark.read.schema(summary.schema).parquet(target)


@query("d8_evidence_totals", (
    f"WITH {DOC} SELECT count(*) AS records, count(*) FILTER (quality IS NOT NULL) AS has_labels, "
    "count(*) FILTER (lang = 'en') AS has_topic, count(*) FILTER (n_chars > 2000) AS has_notes, "
    "count(*) FILTER (quality IS NULL AND lang <> 'en' AND n_chars <= 2000) AS has_nothing FROM doc"))
def evidence_totals(spark, path):
    f = evidence(spark, path)
    return f.agg(F.count(F.lit(1)).alias("records"), *[
        F.count_if(c).alias(c) for c in ("has_labels", "has_topic", "has_notes", "has_nothing")])


def evidence(spark, path):
    d, lab = tables(spark, path, "documents", "labels")
    return reconcile.evidence_flags(
        d.select("doc_id", "lang", "n_chars"), "doc_id", {"labels": lab},
        {"topic": F.col("lang") == "en", "notes": F.col("n_chars") > 2000})


@query("c10_evidence_flags", (
    f"WITH {DOC} SELECT id, quality IS NOT NULL AS has_labels, lang = 'en' AS has_topic, n_chars > "
    "2000 AS has_notes, quality IS NULL AND lang <> 'en' AND n_chars <= 2000 AS has_nothing FROM doc"))
def evidence_flags(spark, path):
    return evidence(spark, path).select(F.col("doc_id").alias("id"), "has_labels", "has_topic",
                                        "has_notes", "has_nothing")


# a note made of the document's words; the class rules look for words anywhere in it
_NOTE = ("CASE lang WHEN 'en' THEN text WHEN 'de' THEN 'Wrong entity' WHEN 'fr' THEN 'only the city, "
         "not the museum' ELSE 'no permanent items ' || text END")
_REASON = ("CASE WHEN l LIKE '%wrong%' OR l LIKE '%airport%' OR l LIKE '%instrument%' THEN "
           "'wrong_entity' WHEN l LIKE '%city%' AND l LIKE '%not the museum%' THEN 'city_only' WHEN l "
           "LIKE '%no%' AND (l LIKE '%collection%' OR l LIKE '%permanent%') THEN 'no_collection' ELSE "
           "'other' END")


def _note():
    return (F.when(F.col("lang") == "en", F.col("text")).when(F.col("lang") == "de", "Wrong entity")
            .when(F.col("lang") == "fr", "only the city, not the museum")
            .otherwise(F.concat(F.lit("no permanent items "), "text")))


@query("d9_gap_reasons", (
    f"WITH n AS (SELECT lower({_NOTE}) AS l FROM documents) SELECT {_REASON} AS reason, count(*) AS n "
    "FROM n GROUP BY reason"))
def gap_reasons(spark, path):
    (d,) = tables(spark, path, "documents")
    return d.groupBy(derive.gap_reason(_note()).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


_ARTICLE = ("CASE WHEN NOT coalesce(quality = 1, false) THEN 'none' WHEN left(lower(t), 200) LIKE "
            "'%city%' AND left(lower(t), 400) LIKE '%population%' THEN 'city' WHEN left(lower(t), 200) "
            "LIKE '%airport%' OR left(lower(t), 200) LIKE '%station%' THEN 'wrong' ELSE 'good' END")
_ARTICLE_TEXT = ("CASE source WHEN 'src1' THEN 'A City with a population. ' || text WHEN 'src2' THEN "
                 "'Station: ' || text ELSE text END")


def _article():
    t = (F.when(F.col("source") == "src1", F.concat(F.lit("A City with a population. "), "text"))
         .when(F.col("source") == "src2", F.concat(F.lit("Station: "), "text"))
         .otherwise(F.col("text")))
    return derive.article_class(F.col("quality") == 1, t)


@query("d10_article_quality", (
    f"WITH {DOC}, a AS (SELECT *, {_ARTICLE_TEXT} AS t FROM doc) SELECT {_ARTICLE} AS article, "
    "count(*) AS n FROM a GROUP BY article"))
def article_quality(spark, path):
    return doc(spark, path).groupBy(_article().alias("article")).agg(F.count(F.lit(1)).alias("n"))


@query("d11_quality_by_score", (
    f"WITH {DOC}, a AS (SELECT *, {_ARTICLE_TEXT} AS t FROM doc) SELECT {_ARTICLE} AS article, "
    "count(*) FILTER (toxic IS NOT NULL AND toxic > 0) AS scored, count(*) FILTER (NOT coalesce(toxic"
    " > 0, false)) AS unscored FROM a GROUP BY article"))
def quality_by_score(spark, path):
    scored = F.when(F.col("toxic") > 0, "scored").otherwise("unscored")
    return (doc(spark, path).select(_article().alias("article"), scored.alias("s"))
            .groupBy("article").pivot("s", ["scored", "unscored"]).agg(F.count(F.lit(1)))
            .fillna(0, ["scored", "unscored"]))


@query("c11_coverage", (
    f"WITH {DOC}, c AS (SELECT count(*) FILTER (quality IS NOT NULL) AS a, count(*) FILTER (quality IS"
    " NULL) AS b, count(*) FILTER (quality IS NOT NULL AND lang = 'en') AS x, count(*) FILTER (quality"
    " IS NULL AND lang <> 'en') AS y FROM doc) SELECT a AS with_cache, b AS without_cache, x AS "
    "cache_and_score, y AS no_cache_no_score, round(x * 100.0 / a, 6) AS scored_with_cache_pct, "
    "round(y * 100.0 / b, 6) AS unscored_without_cache_pct FROM c"))
def coverage(spark, path):
    out = reconcile.coverage(doc(spark, path), F.col("quality").isNotNull(), F.col("lang") == "en")
    return out.withColumns({c: F.round(c, 6) for c in ("scored_with_cache_pct",
                                                       "unscored_without_cache_pct")})


@query("d12_coverage_ratios", (
    "SELECT d.source, round(count(l.doc_id) * 100.0 / count(*), 6) AS labelled_pct, CASE WHEN "
    "count(l.doc_id) > 0 THEN round(count(*) FILTER (l.quality = 1) * 100.0 / count(l.doc_id), 6) END"
    " AS good_pct FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source"))
def coverage_ratios(spark, path):
    return doc(spark, path).groupBy("source").agg(
        F.round(F.try_divide(F.count("quality") * 100.0, F.count(F.lit(1))), 6).alias("labelled_pct"),
        F.round(F.try_divide(F.count_if(F.col("quality") == 1) * 100.0, F.count("quality")), 6)
        .alias("good_pct"))


@query("d13_multiple_results", (
    f"WITH {EVT} SELECT uid, count(*) AS n FROM evt GROUP BY uid HAVING count(*) > 1"))
def multiple_results(spark, path):
    return quality.repeated_keys(evt(spark, path), ["uid"])


@query("d14_cache_status", (
    f"WITH {EVT} SELECT uid, count(*) AS entries, bool_or(success AND score IS NOT NULL) AS scored, "
    "bool_or(success AND score IS NULL) AS null_scores, bool_or(NOT success) AS failed FROM evt GROUP "
    "BY uid"))
def cache_status(spark, path):
    return reconcile.cache_status(evt(spark, path), "uid", "success", ["score"])


@query("d16_scored_count", (
    f"WITH {ART} SELECT count(*) FILTER (scoreable AND (coalesce(imp, 0) <> 0 OR coalesce(mod, 0) <> "
    "0)) AS scored, count(*) AS total FROM art"))
def scored_count(spark, path):
    return art(spark, path).agg(browse.scored_count(S, "scoreable").alias("scored"),
                                F.count(F.lit(1)).alias("total"))


@query("d17_scoring_coverage", (
    f"WITH {DOC} SELECT lang, count(quality) AS scored, count(DISTINCT CASE WHEN quality IS NOT NULL "
    "THEN source END) AS sources, count(quality) || '/' || count(*) || ' (' || format('{:.1f}%', "
    "round(count(quality) * 100.0 / count(*), 1)) || ')' AS coverage FROM doc GROUP BY lang"))
def scoring_coverage(spark, path):
    n = F.count("quality")
    return doc(spark, path).groupBy("lang").agg(
        n.alias("scored"),
        F.count_distinct(F.when(F.col("quality").isNotNull(), F.col("source"))).alias("sources"),
        runs.coverage_text(n, F.count(F.lit(1))).alias("coverage"))


@query("d18_distinct_sets", (
    f"WITH {EVT} SELECT kind, count(DISTINCT uid) AS ids, count(DISTINCT CASE WHEN outcome = 'updated'"
    " THEN uid END) AS changed FROM evt GROUP BY kind"))
def distinct_sets(spark, path):
    return evt(spark, path).groupBy("kind").agg(
        F.count_distinct("uid").alias("ids"),
        F.count_distinct(F.when(F.col("outcome") == "updated", F.col("uid"))).alias("changed"))


@query("d19_shared_websites", (
    "WITH k AS (SELECT page_id AS id, 'host' AS kind, regexp_extract(lower(url), "
    "'^https?://(?:www\\.)?([^/?#]+)', 1) AS value FROM pages UNION ALL SELECT page_id, 'title', "
    "lower(regexp_extract(html, '<title>([^<]*)</title>', 1)) FROM pages), n AS (SELECT *, count(*) "
    "OVER (PARTITION BY kind, value) AS n FROM k WHERE value <> '') SELECT id, kind, value, n FROM n "
    "WHERE n > 1"))
def shared_websites(spark, path):
    (p,) = tables(spark, path, "pages")
    keys = {"host": F.regexp_extract(F.lower("url"), r"^https?://(?:www\.)?([^/?#]+)", 1),
            "title": F.lower(F.regexp_extract("html", r"<title>([^<]*)</title>", 1))}
    return quality.shared_key_duplicates(
        p.withColumnRenamed("page_id", "id"), "id", keys).select("id", "kind", "value", "n")


# Pages that share a place on the web, a title, or an article number, directly or through others.
_REVIEW_KEYS = {
    "website": (r"^https?://(?:www\.)?([^/?#]+/?[^?#]*)", "url"),
    "title": (r"<title>([^<]*)</title>", "html"),
    "article": (r"^https?://[^/]+(/[^?#]*[0-9]{2,})", "url")}


@query("d19_review_groups", (
    "WITH RECURSIVE k AS (" + " UNION ALL ".join(
        f"SELECT page_id AS id, '{kind}:' || regexp_extract(lower({column}), '{pattern}', 1) AS key FROM "
        f"pages WHERE regexp_extract(lower({column}), '{pattern}', 1) <> ''"
        for kind, (pattern, column) in _REVIEW_KEYS.items())
    + "), reach AS (SELECT id AS a, id AS b FROM k UNION SELECT r.a, y.id FROM reach r JOIN k x ON x.id = r.b "
    "JOIN k y ON y.key = x.key), g AS (SELECT a AS id, min(b) AS group_id FROM reach GROUP BY a) "
    "SELECT id, group_id, count(*) OVER (PARTITION BY group_id) AS n FROM g QUALIFY n > 1"))
def review_groups(spark, path):
    (p,) = tables(spark, path, "pages")
    keys = {kind: F.regexp_extract(F.lower(column), pattern, 1)
            for kind, (pattern, column) in _REVIEW_KEYS.items()}
    return quality.review_groups(p.withColumnRenamed("page_id", "id"), "id", keys)


@query("d20_names_within_city", (
    "SELECT p_brand AS city, lower(p_name) AS name, count(*) AS n FROM part GROUP BY p_brand, "
    "lower(p_name) HAVING count(*) > 1"))
def names_within_city(spark, path):
    (p,) = tables(spark, path, "part")
    return quality.repeated_keys(p.select(F.col("p_brand").alias("city"),
                                          F.lower("p_name").alias("name")), ["city", "name"])


@query("d21_release_gates", (
    f"WITH {EVT}, f AS (SELECT count(*) FILTER (outcome = 'failed') AS failed, count(*) AS total FROM "
    "evt), g AS (SELECT count(*) FILTER (o.o_totalprice IS DISTINCT FROM l.gold) AS drifted, count(*) "
    "AS compared, count(*) FILTER (o.o_orderpriority = '1-URGENT' AND o.o_totalprice IS DISTINCT FROM "
    "l.gold) AS top FROM orders o JOIN (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS gold FROM"
    " lineitem GROUP BY l_orderkey) l ON o.o_orderkey = l.l_orderkey) SELECT round(failed / total, 6) "
    "AS failure_rate, round(drifted / compared, 6) AS drift_rate, top AS needs_review, failed / total "
    "<= 0.1 AND drifted / compared <= 0.05 AND top = 0 AS pass FROM f, g"))
def release_gates(spark, path):
    o, li = tables(spark, path, "orders", "lineitem")
    gold = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.round(F.sum("l_extendedprice"), 2).alias("gold"))
    pairs = o.join(gold, "o_orderkey")
    drift = ~F.col("o_totalprice").eqNullSafe(F.col("gold"))
    compared = pairs.agg(F.count_if(drift).alias("drifted"), F.count(F.lit(1)).alias("compared"),
                         F.count_if(drift & (F.col("o_orderpriority") == "1-URGENT")).alias("top"))
    ran = evt(spark, path).agg(F.count_if(F.col("outcome") == "failed").alias("failed"),
                               F.count(F.lit(1)).alias("total"))
    both = compared.withColumns({c: ran.select(c).scalar() for c in ("failed", "total")})
    failure, drift_rate, review, ok = quality.release_gates(
        F.col("failed"), F.col("total"), F.col("drifted"), F.col("compared"), F.col("top"))
    return both.select(failure, drift_rate, review, ok).withColumns(
        {c: F.round(c, 6) for c in ("failure_rate", "drift_rate")})


@query("e3_first_per_key", (
    "SELECT o_custkey AS id, min(o_orderkey) AS row_no, arg_min(o_orderpriority, o_orderkey) AS "
    "priority FROM orders GROUP BY o_custkey"))
def first_per_key(spark, path):
    (o,) = tables(spark, path, "orders")
    o = o.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("row_no"),
                 F.col("o_orderpriority").alias("priority"))
    return groups.first_per_key(o, ["id"], "row_no", ["priority"])


@query("e4_last_per_key", (
    "SELECT o_custkey AS id, max(o_orderkey) AS row_no, arg_max(o_orderstatus, o_orderkey) AS status "
    "FROM orders GROUP BY o_custkey"))
def last_per_key(spark, path):
    (o,) = tables(spark, path, "orders")
    o = o.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("row_no"),
                 F.col("o_orderstatus").alias("status"))
    return groups.last_per_key(o, ["id"], ["row_no"], ["row_no", "status"])


@query("e5_latest_cache_entry", (
    f"WITH {EVT}, r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY ts DESC, id DESC) AS rk "
    "FROM evt) SELECT uid, id, kind FROM r WHERE rk = 1"))
def latest_cache_entry(spark, path):
    return reconcile.latest_entry(evt(spark, path), "uid", ["ts", "id"], ["id", "kind"])


@query("e6_duplicate_flags", (
    f"WITH {CUST} SELECT id, row_number() OVER (PARTITION BY lower(state), lower(city), balance > 5000"
    " ORDER BY id) > 1 AS is_duplicate FROM cust"))
def duplicate_flags(spark, path):
    keys = {"_s": F.lower("state"), "_c": F.lower("city"), "_b": F.col("balance") > 5000}
    return groups.flag_duplicates(cust(spark, path), keys, "id").select("id", "is_duplicate")


@query("g1_union_regions", (
    "SELECT c_custkey AS id, c_name AS name, 'customer' AS origin, c_mktsegment AS segment FROM "
    "customer UNION ALL SELECT s_suppkey, s_name, 'supplier', NULL FROM supplier"))
def union_regions(spark, path):
    c, s = tables(spark, path, "customer", "supplier")
    left = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
                    F.lit("customer").alias("origin"), F.col("c_mktsegment").alias("segment"))
    right = s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"),
                     F.lit("supplier").alias("origin"))
    return left.unionByName(right, allowMissingColumns=True)


@query("g2_rebuild_table", (
    f"WITH {ART} SELECT id, CAST(coalesce(tier, rep, 3) AS INT) AS tier, tier IS NULL AS updated FROM "
    "art"))
def rebuild_table(spark, path):
    # skipped and updated rows in one conditional projection, so the table is read once
    gone = F.col("tier").isNull()
    return art(spark, path).select(
        "id", F.when(gone, F.coalesce("rep", F.lit(3))).otherwise(F.col("tier")).alias("tier"),
        gone.alias("updated"))


@query("g3_ids_without_record", (
    "SELECT DISTINCT o_custkey + 700 AS id FROM orders WHERE o_custkey + 700 NOT IN (SELECT c_custkey "
    "FROM customer)"))
def ids_without_record(spark, path):
    o, c = tables(spark, path, "orders", "customer")
    ids = o.select((F.col("o_custkey") + 700).alias("id")).distinct()
    return ids.join(c.select(F.col("c_custkey").alias("id")), "id", "left_anti")


@query("g4_ids_in_both", (
    "SELECT o_custkey + 700 AS id FROM orders INTERSECT SELECT c_custkey FROM customer"))
def ids_in_both(spark, path):
    o, c = tables(spark, path, "orders", "customer")
    return o.select((F.col("o_custkey") + 700).alias("id")).intersect(
        c.select(F.col("c_custkey").alias("id")))


@query("g5_append_tag", (
    "SELECT doc_id AS id, CASE WHEN lang = 'en' THEN 'wikidata,' || source WHEN lang = 'de' THEN "
    "source || ',wikidata' ELSE 'wikidata' END AS tags FROM documents"))
def append_tag(spark, path):
    (d,) = tables(spark, path, "documents")
    tags = (F.when(F.col("lang") == "en", F.array(F.lit("wikidata"), F.col("source")))
            .when(F.col("lang") == "de", F.array("source")))
    return d.select(F.col("doc_id").alias("id"),
                    F.array_join(merge.add_tag(tags, "wikidata"), ",").alias("tags"))


@query("g6_distinct_keys", (
    f"WITH {CUST} SELECT DISTINCT code, lower(trim(raw_city)) AS city FROM cust WHERE "
    "coalesce(trim(raw_city), '') <> ''"))
def distinct_keys(spark, path):
    c = cust(spark, path).select("code", F.lower(text.strip("raw_city")).alias("city"))
    return c.filter("city <> ''").distinct()
