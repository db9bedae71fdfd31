"""Cache against record, version diffs, overlays."""

from pyspark.sql import functions as F

from ..operators import reconcile
from .bindings import EVT, evt, tables
from .registry import query

# Records are orders, their cache is the aggregate of the line items.
_CACHE = """cache AS (
  SELECT l_orderkey + 500 AS id, count(*) > 1 AS success, CAST(count(*) AS INT) AS lines,
    max(l_linestatus) AS status, CAST(max(l_linenumber) AS INT) AS top FROM lineitem GROUP BY l_orderkey
), rec AS (
  SELECT o_orderkey AS id, CAST(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 1 + o_orderkey % 4 END AS INT)
    AS lines, o_orderstatus AS status, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 7 END AS INT) AS top FROM
    orders
)"""


def cache(spark, path):
    (li,) = tables(spark, path, "lineitem")
    return li.groupBy((F.col("l_orderkey") + 500).alias("id")).agg(
        (F.count(F.lit(1)) > 1).alias("success"), F.count(F.lit(1)).cast("int").alias("lines"),
        F.max("l_linestatus").alias("status"), F.max("l_linenumber").cast("int").alias("top"))


def records(spark, path):
    (o,) = tables(spark, path, "orders")
    k = F.col("o_orderkey")
    return o.select(k.alias("id"), F.when(k % 3 != 0, 1 + k % 4).cast("int").alias("lines"),
                    F.col("o_orderstatus").alias("status"), F.when(k % 2 == 0, 7).alias("top"))


@query("c7_cache_vs_record", (
    f"WITH {_CACHE} SELECT c.id, CASE WHEN r.id IS NULL THEN 'not_found' WHEN c.success AND r.lines IS "
    "NOT NULL AND c.lines IS NOT DISTINCT FROM r.lines AND c.status IS NOT DISTINCT FROM r.status AND "
    "c.top IS NOT DISTINCT FROM r.top THEN 'match' WHEN c.success AND r.lines IS NOT NULL THEN "
    "'mismatch' WHEN c.success THEN 'cache_only' ELSE 'ignored' END AS class, CASE WHEN r.id IS NOT NULL"
    " AND c.success AND r.lines IS NOT NULL THEN nullif(concat_ws(',', CASE WHEN c.lines IS DISTINCT "
    "FROM r.lines THEN 'lines' END, CASE WHEN c.status IS DISTINCT FROM r.status THEN 'status' END, CASE"
    " WHEN c.top IS DISTINCT FROM r.top THEN 'top' END), '') END AS mismatched FROM cache c LEFT JOIN "
    "rec r ON c.id = r.id"))
def cache_vs_record(spark, path):
    out = reconcile.cache_vs_record(cache(spark, path), records(spark, path), "id",
                                    ["lines", "status", "top"], "success", "lines")
    return out.select("id", "class", F.array_join("mismatched", ",").alias("mismatched"))


@query("c8_sync_status", (
    f"WITH {EVT}, s AS (SELECT id // 4 AS uid, bool_or(success AND score IS NOT NULL) AS scored, bool_or("
    "success AND score IS NULL) AS null_scores FROM evt GROUP BY id // 4), r AS (SELECT c_custkey AS "
    "uid, c_acctbal > 5000 AS has FROM customer) SELECT uid, CASE WHEN has THEN 'synced' WHEN "
    "null_scores THEN 'unsynced_null' WHEN scored THEN 'unsynced_scores' ELSE 'failed_only' END AS sync "
    "FROM s JOIN r USING (uid)"))
def sync_status(spark, path):
    (c,) = tables(spark, path, "customer")
    rec = c.select(F.col("c_custkey").alias("uid"),
                   F.when(F.col("c_acctbal") > 5000, 1).alias("score"))
    entries = evt(spark, path).withColumn("uid", F.floor(F.col("id") / 4))  # four per record
    status = reconcile.cache_status(entries, "uid", "success", ["score"])
    return reconcile.sync_status(status, rec, "uid", ["score"]).select("uid", "sync")


@query("c9_score_overlay", (
    "SELECT d.doc_id AS id, l.quality AS quality, l.toxic AS toxic, CASE WHEN l.quality = 1 THEN 'good' "
    "END AS summary_short, CASE WHEN l.doc_id IS NOT NULL THEN true WHEN d.lang = 'en' THEN false END AS"
    " is_scored, CASE WHEN l.doc_id IS NOT NULL THEN 'v2_tour_planning' ELSE 'v1.0' END AS "
    "scoring_version FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"))
def score_overlay(spark, path):
    d, lab = tables(spark, path, "documents", "labels")
    rec = d.select(F.col("doc_id").alias("id"),
                   F.when(F.col("lang") == "en", F.lit(False)).alias("is_scored"),
                   F.lit("v1.0").alias("scoring_version"))
    scores = lab.select(F.col("doc_id").alias("id"), "quality", "toxic",
                        F.when(F.col("quality") == 1, "good").otherwise("").alias("summary_short"))
    out = reconcile.overlay_scores(rec, scores, "id", ["quality", "toxic"], ["summary_short"])
    return out.select("id", "tour_planning_scores.quality", "tour_planning_scores.toxic",
                      "summary_short", "is_scored", "scoring_version")


@query("c16_scores_with_summaries", (
    "SELECT 'm_' || left(sha256(CAST(d.doc_id AS VARCHAR)), 8) AS folder_hash, d.n_chars, d.lang, "
    "l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"))
def scores_with_summaries(spark, path):
    # many documents have no labels, so the gaps are those of the tables; a folder is named by eight hex
    # digits of a hash, which two documents may share, so the record's id is what joins
    from ..functions import text
    d, lab = tables(spark, path, "documents", "labels")
    key = text.folder_hash(F.col("doc_id").cast("string")).alias("folder_hash")
    return d.join(lab.select("doc_id", "quality", "toxic"), "doc_id", "left").select(
        key, "n_chars", "lang", "quality", "toxic")


@query("k7_version_diff", (
    f"WITH {_CACHE}, o AS (SELECT id, unnest(['lines', 'status', 'top']) AS field, unnest([CAST(lines AS "
    "VARCHAR), status, CAST(top AS VARCHAR)]) AS old_value FROM rec), n AS (SELECT id, unnest(['lines', "
    "'status', 'top']) AS field, unnest([CAST(lines AS VARCHAR), status, CAST(top AS VARCHAR)]) AS "
    "new_value FROM cache) SELECT o.id, o.field, old_value, new_value FROM o JOIN n ON o.id = n.id AND "
    "o.field = n.field WHERE old_value IS DISTINCT FROM new_value"))
def version_diff(spark, path):
    return reconcile.field_diff(records(spark, path), cache(spark, path), "id",
                                ["lines", "status", "top"])


@query("a8_ttl_split", (
    f"WITH {EVT}, n AS (SELECT uid, max(ts) AS last_at FROM evt GROUP BY uid) SELECT "
    "c_custkey AS uid, coalesce(TIMESTAMP '2024-01-30 00:00:00' - last_at <= INTERVAL 14 DAY, false) AS "
    "is_hit FROM customer LEFT JOIN n ON c_custkey = uid"))
def ttl_split(spark, path):
    (c,) = tables(spark, path, "customer")
    entries = evt(spark, path).select("uid", "ts")
    return reconcile.ttl_split(c.select(F.col("c_custkey").alias("uid")), entries, "uid", "ts",
                               F.lit("2024-01-30 00:00:00").cast("timestamp_ntz"))
