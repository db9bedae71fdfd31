"""Search and page indexes, bucketed joins, variants, counted writes, and the incremental run."""

from pyspark.sql import functions as F

from ..functions import variants
from ..operators import browse, page_index, runs, text_index
from ..session import scratch_path
from ..sources import buckets
from ..streaming import incremental
from .bindings import CUST, DOC, EVT, cust, evt, tables
from .queries_aggregates import _KINDS
from .queries_browse import SCORED, scored
from .registry import query

_NEEDLES = ("en ", "Éair", "ou", "eAn de", "no such words", "$$$ ")
_PAGE_TITLE = r"<title>([^<]*)</title>"


@query("b7_indexed_search", (
    f"WITH t AS (SELECT page_id AS id, lower(regexp_extract(html, '{_PAGE_TITLE}', 1) || ' | ' || url) AS text "
    "FROM pages), n AS (SELECT unnest([" + ", ".join(f"'{n}'" for n in _NEEDLES) + "]) AS needle) SELECT needle, "
    "id FROM n JOIN t ON contains(text, lower(trim(needle)))"))
def indexed_search(spark, path):
    (p,) = tables(spark, path, "pages")
    where = scratch_path(spark, "text-index")
    text_index.write_text_index(p, "page_id", [F.regexp_extract("html", _PAGE_TITLE, 1), "url"], where)
    found = None
    for needle in _NEEDLES:
        hits = text_index.search_index(spark, where, needle).select(F.lit(needle).alias("needle"), "id")
        found = hits if found is None else found.unionByName(hits)
    return found


@query("f4_far_page", (
    f"WITH {SCORED}, n AS (SELECT count(*) AS n FROM scored) SELECT id, quality_score, CAST((n + 19) // 20 AS "
    "BIGINT) AS pages FROM scored, n ORDER BY coalesce(quality_score, -1) DESC, name, id LIMIT 20 OFFSET (SELECT "
    "CAST(n // 20 // 2 * 20 AS BIGINT) FROM n)"))
def far_page(spark, path):
    # the page in the middle of all of them
    where, order = scratch_path(spark, "page-index"), browse.sort_order("quality_score", "name", "id", True, -1)
    rows = scored(spark, path).select("id", "name", "quality_score")
    page_index.write_page_index(rows, order, ["name"], where, ranges=16)
    pages = page_index.pages(spark, where, 20)
    middle = pages.first()["total"] // 20 // 2
    return page_index.read_page(spark, where, order, middle, 20).select(
        "id", "quality_score").withColumn("pages", pages.select("pages").scalar())


@query("c10_bucketed_flags", (
    f"WITH {DOC} SELECT id, quality IS NOT NULL AS has_labels, lang = 'en' AS has_topic, n_chars > "
    "2000 AS has_notes, quality IS NULL AND lang <> 'en' AND n_chars <= 2000 AS has_nothing FROM doc"))
def bucketed_flags(spark, path):
    d, lab = tables(spark, path, "documents", "labels")
    name = scratch_path(spark, "t").rsplit("/", 1)[-1].replace("-", "_")
    records = buckets.write_buckets(d.select(F.col("doc_id").alias("id"), "lang", "n_chars"), f"{name}_records", "id", 16)
    labels = buckets.write_buckets(lab.filter("quality is not null").select(F.col("doc_id").alias("id"), "quality"),
                                   f"{name}_labels", "id", 16)
    return buckets.flags_from_buckets(records, "id", {"labels": labels}, {
        "topic": F.col("lang") == "en", "notes": F.col("n_chars") > 2000}).select(
        "id", "has_labels", "has_topic", "has_notes", "has_nothing")


# Claims of four types: text behind a null, a number, an object with a value, a list of lists; some are broken.
@query("h23_claims_of_mixed_types", (
    f"WITH {CUST} SELECT id, CASE WHEN id % 7 = 0 THEN NULL ELSE ['string', 'number', 'object', 'list'][id % 4 + 1] END "
    "AS kind, CASE WHEN id % 7 = 0 THEN NULL WHEN id % 4 = 0 THEN name WHEN id % 4 = 1 THEN CAST(id AS VARCHAR) WHEN "
    "id % 4 = 2 THEN code ELSE CAST(id + 1 AS VARCHAR) END AS value FROM cust"))
def claims_of_mixed_types(spark, path):
    c, key = cust(spark, path), F.col("id").cast("string")
    body = (F.when(F.col("id") % 4 == 0, F.concat(F.lit('[null, "'), "name", F.lit('"]')))
            .when(F.col("id") % 4 == 1, F.concat(F.lit("["), key, F.lit(", 5]")))
            .when(F.col("id") % 4 == 2, F.concat(F.lit('{"value": "'), "code", F.lit('", "rank": 1}')))
            .otherwise(F.concat(F.lit("[["), (F.col("id") + 1).cast("string"), F.lit(", 0]]"))))
    end = F.when(F.col("id") % 7 == 0, "").otherwise("}")
    value = variants.first_claim(F.try_parse_json(F.concat(F.lit('{"P281": '), body, end)), "P281")
    return c.select("id", value.alias("v")).select(
        "id", variants.claim_kind(F.col("v")).alias("kind"), variants.claim_text(F.col("v")).alias("value"))


@query("h20_answer_fields", (
    f"WITH {CUST} SELECT id, unnest(['code', 'score']) AS field, unnest(['string', CASE WHEN id % 2 = 0 THEN 'number' "
    "ELSE 'list' END]) AS kind, unnest(['\"' || code || '\"', CASE WHEN id % 2 = 0 THEN CAST(id AS VARCHAR) ELSE "
    "'[' || id || ',null]' END]) AS value FROM cust WHERE id % 5 <> 0 UNION ALL SELECT id, NULL, NULL, NULL FROM "
    "cust WHERE id % 5 = 0"))
def answer_fields(spark, path):
    c, key = cust(spark, path), F.col("id").cast("string")
    score = F.when(F.col("id") % 2 == 0, key).otherwise(F.concat(F.lit("["), key, F.lit(", null]")))
    said = F.concat(F.lit('Sure: {"score": '), score, F.lit(', "code": "'), "code", F.lit('"} done'))
    answers = c.select("id", F.when(F.col("id") % 5 == 0, "no answer {").otherwise(said).alias("response"))
    return variants.answer_fields(answers, "id", "response")


@query("d5_counted_write", (
    f"WITH {EVT} SELECT 'run-2' AS run_id, 'backbone' AS phase, count(*) AS total_processed, " + ", ".join(
        f"count(*) FILTER (outcome = '{k}') AS {k}" for k in _KINDS)
    + ", '2026-01-01T00:00:00Z' AS completed_at FROM evt"))
def counted_write(spark, path):
    return runs.write_counted(evt(spark, path), scratch_path(spark, "counted"), "outcome", _KINDS, "backbone",
                              "run-2", F.lit("2026-01-01").cast("timestamp_ntz"))


_ORDER = "id bigint, price double, modified string"


def order_phase(new, current):
    """Prices of new versions in cents; versions no newer than what is known are passed over."""
    return incremental.stale(new, current, "id", "modified").withColumn(
        "cents", F.round(F.col("price") * 100).cast("bigint"))


# The second batch brings the other orders, newer versions of some, and old versions of others.
@query("b6_incremental_run", (
    "SELECT o_orderkey AS id, CAST(round(CASE WHEN o_orderkey % 10 = 1 THEN o_totalprice * 2 ELSE o_totalprice END "
    "* 100) AS BIGINT) AS cents, CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 10 = 1 THEN '2026-02-01' ELSE "
    "'2026-01-01' END AS modified, CAST(CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 10 = 1 THEN 1 ELSE 0 END AS "
    "BIGINT) AS batch, CAST(2 AS BIGINT) AS batches FROM orders"))
def incremental_run(spark, path):
    (o,) = tables(spark, path, "orders")
    where = scratch_path(spark, "incremental")
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    schema = f"{_ORDER}, cents bigint"

    def arrive(rows, cost, modified):
        rows.select(key.alias("id"), cost.alias("price"), F.lit(modified).alias("modified")).write.mode(
            "append").parquet(f"{where}/source")

    def run():
        return incremental.run_arrived(spark, f"{where}/source", _ORDER, f"{where}/target", f"{where}/checkpoint",
                                       order_phase, schema, "id")

    first = key % 3 != 0
    arrive(o.filter(first), price, "2026-01-01")
    batches = run()
    arrive(o.filter(~first), F.when(key % 10 == 1, price * 2).otherwise(price), "2026-02-01")
    arrive(o.filter(first & (key % 10 == 1)), price * 2, "2026-02-01")
    arrive(o.filter(first & (key % 10 == 2)), price * 3, "2025-12-01")
    # the last run finds no new file
    batches += run() + run()
    return incremental.newest(spark, f"{where}/target", schema, "id").select(
        "id", "cents", "modified", "batch", F.lit(batches).cast("bigint").alias("batches"))
