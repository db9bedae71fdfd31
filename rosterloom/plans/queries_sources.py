"""Readers and writers, exercised on files written from the given tables."""

from pyspark.sql import functions as F

from ..functions import text
from ..session import cut_lineage, scratch_path
from ..sources import readers, writers
from .bindings import CUST, cust, tables
from .registry import query

RECORD = "museum_id STRING, museum_name STRING, city STRING, reputation INT"
BATCH = 200  # records per container document


def _containers(spark, path):
    """Container documents of at most BATCH records each, so no region is collected whole."""
    c = cust(spark, path)
    rec = F.struct(F.col("id").cast("string").alias("museum_id"), F.col("name").alias("museum_name"),
                   F.col("raw_city").alias("city"), F.col("nk").cast("int").alias("reputation"))
    return (c.groupBy("code", F.floor(F.col("id") / BATCH).alias("part"))
            .agg(F.collect_list(rec).alias("museums"), F.first("state").alias("state"))
            .select("state", F.col("code").alias("state_code"),
                    F.lit("2026-01-01").alias("last_updated"), "museums"))


@query("a1_read_containers", (
    f"WITH {CUST} SELECT code AS state_code, CAST(id AS VARCHAR) AS museum_id, name AS museum_name, "
    "raw_city AS city, CAST(nk AS INT) AS reputation FROM cust"))
def read_containers(spark, path):
    target = scratch_path(spark, "containers")
    _containers(spark, path).write.json(target)
    return readers.read_containers(spark, target, RECORD, multi_line=False)


@query("a2_read_containers_skipping_bad", (
    f"WITH {CUST} SELECT CAST(id AS VARCHAR) AS museum_id, name AS museum_name FROM cust WHERE code NOT IN"
    " ('AL', 'CO', 'CT', 'WA')"))
def read_containers_skipping_bad(spark, path):
    target = scratch_path(spark, "containers")
    docs = _containers(spark, path).select(F.to_json(F.struct("*")).alias("value"), "state_code")
    broken = F.col("state_code").isin("AL", "CO", "CT", "WA")
    cut = F.expr("substring(value, 1, length(value) - 20)")
    docs.select(F.when(broken, cut).otherwise(F.col("value")).alias("value")).write.text(target)
    return readers.read_containers(spark, target, RECORD, skip_bad=True, multi_line=False).select(
        "museum_id", "museum_name")


@query("a3_read_roster", (
    f"WITH {CUST} SELECT state AS \"STATE\", name AS \"NAME\", coalesce(trim(raw_city), '') AS \"CITY\","
    " 'https://x.org/\"' || id || '\",' AS \"URL\" FROM cust"))
def read_roster(spark, path):
    target = scratch_path(spark, "roster")
    writers.write_csv(cust(spark, path).select(
        F.col("state").alias("STATE"), F.concat(F.lit(" "), "name").alias("NAME"),
        F.coalesce("raw_city", F.lit("")).alias("CITY"),
        F.concat(F.lit('https://x.org/"'), F.col("id").cast("string"), F.lit('",')).alias("URL")),
        target)
    return readers.read_roster(spark, target).drop("row_no")


@query("a4_read_external", (
    f"WITH {CUST} SELECT CAST(id AS VARCHAR) AS \"Museum ID\", name AS \"Museum Name\", trim(raw_city) AS"
    " \"State (Administrative Location)\" FROM cust WHERE coalesce(trim(raw_city), '') <> ''"))
def read_external(spark, path):
    target = scratch_path(spark, "external")
    state = "State (Administrative Location)"
    writers.write_csv(cust(spark, path).select(
        F.col("id").cast("string").alias("Museum ID"), F.col("name").alias("Museum Name"),
        F.col("raw_city").alias(state)), target)
    return readers.read_external(spark, target, state).drop("row_no")


@query("e2_row_ordinals", (
    "SELECT row_number() OVER (ORDER BY o_orderkey) AS row_no, CAST(o_orderkey AS VARCHAR) AS order_id,"
    " CASE WHEN o_orderkey % 5 = 0 THEN 'two' || chr(10) || 'lines, \"quoted\"' ELSE o_orderstatus END AS "
    "note FROM orders"))
def row_ordinals(spark, path):
    # file order is key order; every second file has its columns in the other order
    target = scratch_path(spark, "ordinals")
    (o,) = tables(spark, path, "orders")
    note = F.when(F.col("o_orderkey") % 5 == 0, 'two\nlines, "quoted"').otherwise(F.col("o_orderstatus"))
    rows = cut_lineage(o.select(F.col("o_orderkey").cast("string").alias("order_id"), note.alias("note"),
                                "o_orderkey").orderBy("o_orderkey"), "ordinals")
    half = rows.approxQuantile("o_orderkey", [0.5], 0.1)[0]
    writers.write_csv(rows.filter(F.col("o_orderkey") <= half).orderBy("o_orderkey").select(
        "order_id", "note"), f"{target}/a")
    writers.write_csv(rows.filter(F.col("o_orderkey") > half).orderBy("o_orderkey").select(
        "note", "order_id"), f"{target}/b")
    return readers.read_external(spark, f"{target}/*", "order_id").select("row_no", "order_id", "note")


_CACHE_SCHEMA = "found BOOLEAN, extract STRING"


@query("a7_read_caches", (
    "SELECT source AS museum_id, count(*) AS entries, count(*) FILTER (lang = 'en') AS found, "
    "CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY source"))
def read_caches(spark, path):
    # one folder per source, as `<key>/cache/…`; every document is one line of its cache
    target = scratch_path(spark, "caches")
    (d,) = tables(spark, path, "documents")
    (d.select("source", F.lit("x").alias("kind"), (F.col("lang") == "en").alias("found"),
              F.col("text").alias("extract"))
     .write.partitionBy("source", "kind").json(target))
    docs = readers.read_caches(spark, target, _CACHE_SCHEMA, "*.json",
                               r"/source=([^/]+)/kind=x/[^/]+$", multi_line=False)
    return docs.groupBy("museum_id").agg(
        F.count(F.lit(1)).alias("entries"), F.count_if("found").alias("found"),
        F.sum(F.length("extract")).alias("chars"))


@query("a9_index_with_envelope", (
    f"WITH {CUST} SELECT code, count(*) AS n, (SELECT count(*) FROM cust) AS total_records, "
    "'2026-01-01T00:00:00Z' AS generated_at FROM cust GROUP BY code"))
def index_with_envelope(spark, path):
    target = scratch_path(spark, "index")
    as_of = F.lit("2026-01-01").cast("timestamp_ntz")
    c = cust(spark, path).select("id", "code", "name")
    writers.write_index(c, target, as_of)
    records = spark.read.schema(c.schema).parquet(f"{target}/records")
    head = spark.read.schema("generated_at STRING, total_records BIGINT").json(f"{target}/envelope")
    return records.groupBy("code").agg(F.count(F.lit(1)).alias("n")).withColumns(
        {n: head.select(n).scalar() for n in ("total_records", "generated_at")})


@query("a10_rewrite_changed", (
    f"WITH {CUST} SELECT id, code, CASE WHEN balance > 9900 THEN '2026-01-01' ELSE '2025-01-01' END AS "
    "updated_at FROM cust"))
def rewrite_changed(spark, path):
    target = scratch_path(spark, "partitions")
    base = cust(spark, path).select("id", F.lit("2025-01-01").alias("updated_at"), "code",
                                    (F.col("balance") > 9900).alias("changed"))
    base.drop("changed").write.partitionBy("code").parquet(target)
    writers.write_changed(base, target, "code", "changed", "updated_at", F.lit("2026-01-01"))
    return spark.read.schema("id BIGINT, updated_at STRING, code STRING").parquet(target)


@query("a13_enriched_and_scores", (
    "SELECT 'enriched' AS output, count(*) AS n, count(quality) AS scored FROM documents LEFT JOIN labels "
    "USING (doc_id) UNION ALL SELECT 'scores', count(*), count(*) FROM labels WHERE quality IS NOT NULL"))
def enriched_and_scores(spark, path):
    target = scratch_path(spark, "enriched")
    d, lab = tables(spark, path, "documents", "labels")
    enriched = d.select("doc_id", "source").join(lab, "doc_id", "left")
    writers.write_enriched_and_scores(enriched, target, "doc_id", "quality")
    count, scored = F.count(F.lit(1)).alias("n"), F.count("quality").alias("scored")
    return spark.read.schema(enriched.schema).parquet(f"{target}/enriched").select("quality").agg(
        F.lit("enriched").alias("output"), count, scored).unionByName(
        spark.read.parquet(f"{target}/scores").agg(F.lit("scores").alias("output"), count, scored))


@query("a15_read_key_map", (
    f"WITH {CUST} SELECT 'm_' || left(sha256(name), 8) AS folder_hash, name AS museum_id FROM cust"))
def read_key_map(spark, path):
    # maps of at most BATCH entries per document
    target = scratch_path(spark, "maps")
    c = cust(spark, path)
    entry = F.struct(text.folder_hash("name").alias("k"), F.col("name").alias("v"))
    (c.groupBy("code", F.floor(F.col("id") / BATCH)).agg(
        F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value")).select("value")
     .write.text(target))
    return readers.read_key_map(spark, target, "folder_hash", "museum_id", one_per_file=False)
