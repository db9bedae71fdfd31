"""Filters, sorts, pages, facets and exports of the browse surface."""

from pyspark.sql import functions as F

from ..functions import scoring, vocab
from ..operators import browse
from ..sources import readers, writers
from ..session import scratch_path
from .bindings import ART, CUST, art, cust, score_columns, tables
from .queries_scoring import P3, Q3
from .registry import query

S = score_columns()
SCORED = f"{ART}, scored AS (SELECT *, {P3} AS priority, {Q3} AS quality_score FROM art)"


def scored(spark, path):
    return art(spark, path).withColumns({"priority": scoring.priority(S),
                                         "quality_score": scoring.quality(S)})


@query("b7_text_search", (
    f"WITH {CUST} SELECT id FROM cust WHERE contains(lower(concat_ws(' | ', name, nullif(raw_city, "
    "''), state, region)), 's | a')"))
def text_search(spark, path):
    c = cust(spark, path).withColumn("others", F.array("state", "region"))
    return c.filter(browse.search_text(" S | a ", "name", "others", "raw_city")).select("id")


@query("b8_facet_filters", (
    f"WITH {CUST} SELECT id, state, 'all' AS shown FROM cust WHERE lower(trim(raw_city)) = 'furniture' AND "
    "lower(region) = 'asia' UNION ALL SELECT id, state, 'full' FROM cust WHERE lower(trim(raw_city)) = "
    "'furniture' AND lower(region) = 'asia' AND coalesce(trim(url), '') <> ''"))
def facet_filters(spark, path):
    from ..operators import quality
    wanted = {"raw_city": " Furniture", "region": "asia ", "state": ""}
    c = cust(spark, path)
    full = quality.is_full(c, quality.Profile(("name", "url", "raw_city"), tags=(), confidence=()))
    rows = [c.filter(cond).select("id", "state", F.lit(shown).alias("shown")) for shown, cond in (
        ("all", browse.facet_equals(wanted)), ("full", browse.facet_equals(wanted, full)))]
    return rows[0].unionByName(rows[1])


@query("b9_api_page", (
    f"WITH {SCORED}, f AS (SELECT * FROM scored WHERE domain = 'Art' AND confidence >= 2 AND priority "
    "BETWEEN 5 AND 20) SELECT id, name, priority, (SELECT count(*) FROM f) AS total FROM f ORDER BY "
    "priority, name, id LIMIT 50 OFFSET 20"))
def api_page(spark, path):
    q = browse.BrowseQuery(
        order=browse.priority_order("priority", "name", "id"), facets={"domain": "art"},
        ranges={"confidence": (2, None), "priority": (5, 20)}, limit=50, offset=20, max_limit=200)
    return q.page_with_total(scored(spark, path)).select("id", "name", "priority", "total")


_FACETS = ("domain", "city", "state", "kind", "rep")


@query("d15_facet_values", (
    f"WITH {ART} SELECT DISTINCT facet, value FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS facet, {'CAST(nullif(rep, 0) AS VARCHAR)' if c == 'rep' else c} AS value FROM art"
        for c in _FACETS) + ") WHERE value <> '' ORDER BY facet, value"))
def facet_values(spark, path):
    return browse.facet_values(art(spark, path), list(_FACETS))


@query("f1_priority_sort", (
    f"WITH {SCORED} SELECT id, priority, name FROM scored ORDER BY priority ASC NULLS LAST, name, id "
    "LIMIT 50"))
def priority_sort(spark, path):
    return scored(spark, path).select("id", "priority", "name").orderBy(
        *browse.priority_order("priority", "name", "id")).limit(50)


# sort key, column of the records, what a null sorts as in SQL
_SORTS = (("state_province", "state", "''"), ("city", "city", "''"), ("museum_name", "name", "''"),
          ("museum_type", "kind", "''"), ("time_needed", "visit", "''"), ("reputation", "rep", "999"),
          ("collection_based_strength", "cbs", "-1"), ("eca_score", "eca", "-1"),
          ("overall_quality_score", "quality_score", "-1"), ("priority_score", "priority", "999"),
          ("nearby_museum_count", "nearby", "0"))
_VISIT = "CASE WHEN id % 3 = 0 THEN 'Full day' WHEN id % 3 = 1 THEN 'Half day' END"


@query("f2_multi_key_sorts", (
    f"WITH {SCORED}, v AS (SELECT *, {_VISIT} AS visit FROM scored)" + "".join(
        f", {k}_{d} AS (SELECT '{k}' AS sort_key, '{d}' AS direction, id FROM v ORDER BY "
        f"coalesce({c}, {n}) {d}, name, id LIMIT 100)" for k, c, n in _SORTS for d in ("asc", "desc"))
    + " " + " UNION ALL ".join(f"SELECT * FROM {k}_{d}" for k, *_ in _SORTS for d in ("asc", "desc"))))
def multi_key_sorts(spark, path):
    visit = F.when(F.col("id") % 3 == 0, vocab.FULL).when(F.col("id") % 3 == 1, vocab.HALF)
    df = scored(spark, path).withColumn("visit", visit)
    out = None
    for key, column, _ in _SORTS:
        for direction in ("asc", "desc"):
            order = browse.sort_order(column, "name", "id", direction == "desc",
                                      browse.SORT_NULLS[key])
            page = df.orderBy(*order).limit(100).select(
                F.lit(key).alias("sort_key"), F.lit(direction).alias("direction"), "id")
            out = page if out is None else out.unionByName(page)
    return out


@query("f3_tier_label_sort", (
    f"WITH {ART}, l AS (SELECT id, name, CASE tier WHEN 0 THEN 'Flagship' WHEN 1 THEN 'Strong' WHEN 2 THEN "
    "'Moderate' WHEN 3 THEN 'Small' END AS label FROM art) SELECT id, label FROM l ORDER BY CASE label WHEN "
    "'Small' THEN 1 WHEN 'Moderate' THEN 2 WHEN 'Strong' THEN 3 WHEN 'Flagship' THEN 4 ELSE 999 END, name, "
    "id LIMIT 50"))
def tier_label_sort(spark, path):
    from ..functions import derive
    labels = dict(enumerate(reversed(vocab.COLLECTION_TIER_ORDER)))
    df = art(spark, path).withColumn("label", derive.label("tier", labels))
    return df.orderBy(*browse.label_order("label", vocab.COLLECTION_TIER_ORDER, "name", "id")).limit(
        50).select("id", "label")


@query("f3_label_sort", (
    f"WITH {ART}, l AS (SELECT id, name, CASE rep WHEN 0 THEN 'International' WHEN 1 THEN 'National' "
    "WHEN 2 THEN 'Regional' WHEN 3 THEN 'Local' END AS label FROM art) SELECT id, label FROM l ORDER "
    "BY CASE label WHEN 'Local' THEN 1 WHEN 'Regional' THEN 2 WHEN 'National' THEN 3 WHEN "
    "'International' THEN 4 ELSE 999 END, name, id LIMIT 50"))
def label_sort(spark, path):
    from ..functions import derive
    df = art(spark, path).withColumn("label", derive.label("rep", vocab.REPUTATION_LABELS))
    return df.orderBy(*browse.label_order("label", vocab.REPUTATION_ORDER, "name", "id")).limit(
        50).select("id", "label")


@query("f4_page_of_100", (
    f"WITH {SCORED} SELECT id, quality_score, CAST((SELECT greatest(1, ceil(count(*) / 100.0)) FROM "
    "scored WHERE scoreable) AS BIGINT) AS pages FROM scored WHERE scoreable ORDER BY "
    "coalesce(quality_score, -1) DESC, name, id LIMIT 100 OFFSET 300"))
def page_of_100(spark, path):
    q = browse.BrowseQuery(order=browse.sort_order("quality_score", "name", "id", True, -1),
                           where=F.col("scoreable"), limit=100, offset=300)
    df = scored(spark, path)
    return q.page(df).select("id", "quality_score").withColumn(
        "pages", q.total(df).select("pages").scalar())


@query("f5_api_limit_cap", (
    f"WITH {SCORED} SELECT id, priority FROM scored ORDER BY priority ASC NULLS LAST, name, id LIMIT "
    "200"))
def api_limit_cap(spark, path):
    q = browse.BrowseQuery(order=browse.priority_order("priority", "name", "id"), limit=5000,
                           max_limit=200)
    return q.page(scored(spark, path)).select("id", "priority")


@query("f7_sample_heads", (
    f"WITH {ART} SELECT id, name FROM art WHERE domain = 'Art' AND tier IS NULL ORDER BY id LIMIT 10"))
def sample_heads(spark, path):
    return art(spark, path).filter((F.col("domain") == "Art") & F.col("tier").isNull()).orderBy(
        "id").limit(10).select("id", "name")


def _case(c: str, labels: dict) -> str:
    return "CASE " + c + "".join(f" WHEN {k} THEN '{v}'" for k, v in labels.items()) + " ELSE '' END"


def _text(c: str) -> str:
    return f"coalesce(CAST({c} AS VARCHAR), '')"


# export field: SQL of its text
_EXPORT = {
    "state_province": "state", "city": "city", "museum_name": "name || ', \"' || id || '\"'",
    "museum_type": _text("kind"), "primary_domain": _text("domain"),
    "time_needed": f"coalesce({_VISIT}, '')", "reputation": _case("rep", vocab.REPUTATION_LABELS),
    "collection_based_strength": _case("cbs", vocab.COLLECTION_LABELS),
    "eca_score": _case("eca", vocab.ECA_LABELS), "overall_quality_score": _text("quality_score"),
    "priority_score": _text("priority"), "nearby_museum_count": _text("nearby"),
    "impressionist_strength": _text("imp"), "modern_contemporary_strength": _text("mod"),
    "historical_context_score": _text("hist"), "must_see_candidate": _text("coalesce(hist = 5, false)"),
    "website": "'https://x.org/' || id", "street_address": "id || ' Main' || chr(10) || 'St'",
    "postal_code": "lpad(CAST(id AS VARCHAR), 5, '0')", "latitude": _text("CAST(id % 90 AS DOUBLE) + 0.5"),
    "longitude": _text("CAST(-id % 180 AS DOUBLE) - 0.25"), "phone": "''",
    "collection_tier": _text("tier"), "status": "'active'", "estimated_visit_minutes": _text("id % 240"),
}


def _export_sql(columns) -> str:
    return (f"WITH {SCORED} SELECT " + ", ".join(f'{_EXPORT[c]} AS "{h}"' for c, h in columns)
            + " FROM scored WHERE domain = 'Art'")


def _exported(spark, path, columns):
    """The current set written as CSV in its order, and read back."""
    key = F.col("id")
    df = scored(spark, path).filter("domain = 'Art'").withColumns({
        "state_province": F.col("state"), "museum_type": F.col("kind"),
        "museum_name": F.concat("name", F.lit(', "'), key.cast("string"), F.lit('"')),
        "primary_domain": F.col("domain"), "reputation": F.col("rep"),
        "time_needed": F.when(key % 3 == 0, vocab.FULL).when(key % 3 == 1, vocab.HALF),
        "collection_based_strength": F.col("cbs"), "eca_score": F.col("eca"),
        "overall_quality_score": F.col("quality_score"), "priority_score": F.col("priority"),
        "nearby_museum_count": F.col("nearby"), "impressionist_strength": F.col("imp"),
        "modern_contemporary_strength": F.col("mod"), "historical_context_score": F.col("hist"),
        "must_see_candidate": scoring.must_see(S),
        "website": F.concat(F.lit("https://x.org/"), key.cast("string")),
        "street_address": F.concat(key.cast("string"), F.lit(" Main\nSt")),
        "postal_code": F.lpad(key.cast("string"), 5, "0"),
        "latitude": (key % 90).cast("double") + 0.5, "longitude": (-key % 180).cast("double") - 0.25,
        "phone": F.lit(None).cast("string"), "collection_tier": F.col("tier"),
        "status": F.lit("active"), "estimated_visit_minutes": key % 240})
    out = browse.export_projection(df.orderBy("name", "id"), columns)
    target = scratch_path(spark, "export")
    writers.write_csv(out, target)
    back = (spark.read.schema(out.schema).options(header=True, escape='"', multiLine=True).csv(target))
    return back.fillna("")


@query("a11_csv_export", _export_sql(vocab.EXPORT_COLUMNS))
def csv_export(spark, path):
    return _exported(spark, path, vocab.EXPORT_COLUMNS)


@query("a11_csv_export_short", _export_sql(vocab.EXPORT_COLUMNS_SHORT))
def csv_export_short(spark, path):
    return _exported(spark, path, vocab.EXPORT_COLUMNS_SHORT)


@query("h29_csv_field", (
    "SELECT doc_id AS id, CASE WHEN regexp_matches(text, '[,\"\\n]') THEN '\"' || replace(text, '\"', "
    "'\"\"') || '\"' ELSE text END AS field FROM documents"))
def csv_field(spark, path):
    (d,) = tables(spark, path, "documents")
    return d.select(F.col("doc_id").alias("id"), browse.csv_field("text").alias("field"))


@query("a14_source_priority", (
    "SELECT c_custkey AS id, 'primary' AS origin FROM customer WHERE c_acctbal > 0 UNION ALL SELECT "
    "c_custkey, 'fallback' FROM customer WHERE NOT c_acctbal > 0"))
def source_priority(spark, path):
    from ..operators import reconcile
    (c,) = tables(spark, path, "customer")
    base = c.select(F.col("c_custkey").alias("id"), F.lit("fallback").alias("origin"))
    first = c.filter("c_acctbal > 0").select(F.col("c_custkey").alias("id"),
                                             F.lit("primary").alias("origin"))
    return reconcile.prefer_first(first, base, "id")


@query("a14_record_read", (
    f"WITH {CUST} SELECT id, name, CASE WHEN balance > 0 THEN city END AS city, CASE WHEN balance > 0 THEN url "
    "END AS url FROM cust"))
def record_read(spark, path):
    # a record comes from its region's file, or with the fewer fields of the index
    from ..operators import reconcile
    c = cust(spark, path)
    detail = c.filter("balance > 0").select("id", "name", "city", "url")
    return reconcile.prefer_first(detail, c.select("id", "name"), "id")


@query("a15_key_maps", (
    f"WITH {CUST}, k AS (SELECT id, 'usa-' || lower(code) || '-' || lower(city) || '-' || "
    "regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g') AS museum_id, lower(city) || '-' || "
    "regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g') || '--' || right(lpad(CAST(id AS VARCHAR), 9,"
    " '0'), 6) AS slug_alias FROM cust) SELECT 'm_' || left(sha256(museum_id), 8) AS folder_hash, "
    "museum_id, slug_alias, count(*) OVER (PARTITION BY left(sha256(museum_id), 8)) > 1 AS collides "
    "FROM k"))
def key_maps(spark, path):
    from ..functions import text
    from ..operators import groups
    c = cust(spark, path).withColumn(
        "museum_id", text.entity_id(F.lit("USA"), "code", "city", "name"))
    maps = readers.key_maps(c, "museum_id", "city", "name")
    counted = groups.attach_group_stats(maps, ["folder_hash"], {"n": ("count", None)}, "museum_id")
    return counted.withColumn("collides", F.col("n") > 1).drop("n")


@query("b17_run_gates", (
    f"WITH {SCORED}, li AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R'), lo AS ("
    "SELECT DISTINCT l_partkey FROM lineitem WHERE l_linestatus = 'O') SELECT id, coalesce(domain = 'Art', false) AND "
    "scoreable AND id IN (SELECT l_partkey FROM li) AND id IN (SELECT l_partkey FROM lo) AS "
    "may_score, coalesce(quality_score >= 14, false) AND quality_score IS NOT NULL OR confidence = 5 "
    "AS may_write FROM scored"))
def run_gates(spark, path):
    from ..operators import evidence
    (li,) = tables(spark, path, "lineitem")
    key = F.col("l_partkey").alias("id")
    df = scored(spark, path)
    ok = evidence.scoring_gate(df, "id", li.filter("l_returnflag = 'R'").select(key),
                               li.filter("l_linestatus = 'O'").select(key), "domain", "scoreable")
    q = F.col("quality_score")
    return df.join(ok.select("id", F.lit(True).alias("_ok")), "id", "left").select(
        "id", F.coalesce("_ok", F.lit(False)).alias("may_score"),
        evidence.content_gate(q, q.isNotNull(), F.col("confidence") == 5).alias("may_write"))
