"""Entity frames over the driver's tables, and the same frames as SQL.

Each frame stands for one of the record shapes the operators work on. Attributes the tables
do not have (ratings, types, addresses, messy text) are derived from the columns of the same
row, so every frame has as many rows as its table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scoring import ScoreColumns

# The SQL text below is what the checks run as well; each constant is one common table.

STATES_SQL = (
    "['Alabama', 'Alaska', 'Arizona', 'Arkansas', 'California', 'Colorado', 'Illinois', "
    "'Massachusetts', 'New York', 'Pennsylvania', 'Connecticut', 'Texas', 'Utah', 'Vermont', "
    "'Virginia', 'Washington', 'Ohio', 'Iowa', 'Maine', 'Nevada']"
)
STATE_NAMES = tuple(s.strip("' ") for s in STATES_SQL.strip("[]").split(","))
CODES = ("AL", "AK", "AZ", "AR", "CA", "CO", "IL", "MA", "NY", "PA", "CT", "TX", "UT", "VT",
         "VA", "WA", "OH", "IA", "ME", "NV")
CODES_SQL = "[" + ", ".join(f"'{c}'" for c in CODES) + "]"
TYPES = ("Art Museum", " art (regional)", "history museum", "Cartoon Archive", "Maritime",
         "Fine Art", "University Museum", "zoo", "Kunsthalle", "Children's Museum  ")
TYPES_SQL = "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in TYPES) + "]"

# Roster: one row per customer. Regions are US states for the first 20 nations.
CUST = f"""cust AS (
  SELECT c_custkey AS id, c_name AS name, c_mktsegment AS city,
    CASE WHEN n_nationkey < 20 THEN {STATES_SQL}[n_nationkey + 1] ELSE n_name END AS state,
    CASE WHEN n_nationkey < 20 THEN {CODES_SQL}[n_nationkey + 1] ELSE 'ZZ' END AS code,
    r_name AS region, c_acctbal AS balance, n_nationkey AS nk,
    CASE CAST(c_custkey % 8 AS INT)
      WHEN 0 THEN '  ' || c_mktsegment || ' ' WHEN 1 THEN lower(c_mktsegment) WHEN 2 THEN NULL
      WHEN 3 THEN ' TBD ' WHEN 4 THEN '' WHEN 5 THEN
        CASE WHEN n_nationkey < 20 THEN {STATES_SQL}[n_nationkey + 1] ELSE n_name END
      WHEN 6 THEN 'N/A' ELSE c_mktsegment END AS raw_city,
    CASE CAST(c_custkey % 6 AS INT)
      WHEN 0 THEN 'HTTPS://Ex' || n_nationkey || '.org/C ' || c_custkey || '//'
      WHEN 1 THEN ' http://%20ex' || n_nationkey || '.org/' || c_custkey || '/'
      WHEN 2 THEN 'ftp://ex.org/' || c_custkey WHEN 3 THEN NULL
      WHEN 4 THEN 'https://shared' || n_nationkey || '.org/'
      ELSE 'https://ex' || n_nationkey || '.org/' || c_custkey || '%20x)' END AS url
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""

# Scored record: one row per part.
ART = f"""art AS (
  SELECT p_partkey AS id, p_name AS name, p_brand AS city, p_type AS state,
    {TYPES_SQL}[CAST(p_size % 10 AS INT) + 1] AS kind,
    CASE p_type WHEN 'STANDARD' THEN 'Art' WHEN 'PROMO' THEN 'Art' WHEN 'MEDIUM' THEN 'Art'
      WHEN 'LARGE' THEN 'History' WHEN 'SMALL' THEN 'Science' END AS domain,
    p_type IN ('STANDARD', 'PROMO', 'SMALL') AS scoreable,
    CAST(nullif(p_size % 7, 6) AS INT) AS imp,
    CAST(nullif(p_partkey % 7, 6) AS INT) AS mod,
    CAST(CASE WHEN p_partkey % 9 < 6 THEN p_partkey % 9 END AS INT) AS hist,
    CAST(nullif(p_size % 5, 4) AS INT) AS rep,
    CAST(nullif(p_partkey % 5, 4) AS INT) AS tier,
    CAST(nullif(p_size % 6, 5) AS INT) AS nearby,
    CAST(CASE WHEN p_size % 8 < 6 THEN p_size % 8 END AS INT) AS eca,
    CAST(CASE WHEN (p_partkey + p_size) % 8 < 6 THEN (p_partkey + p_size) % 8 END AS INT) AS cbs,
    CAST(1 + p_size % 5 AS INT) AS confidence, p_retailprice AS price
  FROM part
)"""

# Record with a partly missing label cache: one row per document.
DOC = """doc AS (
  SELECT d.doc_id AS id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic,
    CASE d.lang WHEN 'en' THEN d.source WHEN 'de' THEN 'TBD' WHEN 'fr' THEN ' unknown '
      ELSE NULL END AS topic,
    CASE WHEN l.quality IS NULL THEN 'n/a' WHEN l.quality = 1 THEN 'active' ELSE '' END AS status
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""

# Cache entries and run outcomes: one row per event.
EVT = """evt AS (
  SELECT event_id AS id, user_id AS uid, ts, event_type AS kind, value,
    CAST(regexp_replace(props, '[^0-9]', '', 'g') AS INT) AS k,
    CASE event_type WHEN 'purchase' THEN 'updated' WHEN 'click' THEN 'updated'
      WHEN 'view' THEN 'skipped' WHEN 'error' THEN 'failed' ELSE 'processed' END AS outcome,
    event_type <> 'error' AS success,
    CAST(CASE WHEN event_type IN ('click', 'purchase') THEN floor(value) END AS INT) AS score
  FROM events
)"""


def tables(spark: SparkSession, path: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{path}/{n}.parquet") for n in names]


def _pick(index, values):
    return F.try_element_at(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def cust(spark: SparkSession, path: str) -> DataFrame:
    """Roster rows; see CUST."""
    c, n, r = tables(spark, path, "customer", "nation", "region")
    key, nk, seg = F.col("c_custkey"), F.col("n_nationkey"), F.col("c_mktsegment")
    home = nk < len(STATE_NAMES)
    state = F.when(home, _pick(nk + 1, STATE_NAMES)).otherwise(F.col("n_name"))
    k8, k6 = key % 8, key % 6
    raw_city = (F.when(k8 == 0, F.concat(F.lit("  "), seg, F.lit(" "))).when(k8 == 1, F.lower(seg))
                .when(k8 == 2, None).when(k8 == 3, " TBD ").when(k8 == 4, "").when(k8 == 5, state)
                .when(k8 == 6, "N/A").otherwise(seg))

    def url(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    urls = (F.when(k6 == 0, url("HTTPS://Ex", nk, ".org/C ", key, "//"))
            .when(k6 == 1, url(" http://%20ex", nk, ".org/", key, "/"))
            .when(k6 == 2, url("ftp://ex.org/", key)).when(k6 == 3, None)
            .when(k6 == 4, url("https://shared", nk, ".org/"))
            .otherwise(url("https://ex", nk, ".org/", key, "%20x)")))
    joined = (c.join(n, F.col("c_nationkey") == nk)
              .join(r, F.col("n_regionkey") == F.col("r_regionkey")))
    return joined.select(
        key.alias("id"), F.col("c_name").alias("name"), seg.alias("city"), state.alias("state"),
        F.when(home, _pick(nk + 1, CODES)).otherwise("ZZ").alias("code"),
        F.col("r_name").alias("region"), F.col("c_acctbal").alias("balance"), nk.alias("nk"),
        raw_city.alias("raw_city"), urls.alias("url"))


def art(spark: SparkSession, path: str) -> DataFrame:
    """Scored records; see ART."""
    (p,) = tables(spark, path, "part")
    key, size, kind = F.col("p_partkey"), F.col("p_size"), F.col("p_type")

    def below(c, n):
        return F.when(c < n, c).cast("int")

    def but(c, v):
        return F.nullif(c, F.lit(v)).cast("int")

    return p.select(
        key.alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("city"),
        kind.alias("state"), _pick(size % 10 + 1, TYPES).alias("kind"),
        F.when(kind.isin("STANDARD", "PROMO", "MEDIUM"), "Art").when(kind == "LARGE", "History")
        .when(kind == "SMALL", "Science").alias("domain"),
        kind.isin("STANDARD", "PROMO", "SMALL").alias("scoreable"),
        but(size % 7, 6).alias("imp"), but(key % 7, 6).alias("mod"),
        below(key % 9, 6).alias("hist"), but(size % 5, 4).alias("rep"),
        but(key % 5, 4).alias("tier"), but(size % 6, 5).alias("nearby"),
        below(size % 8, 6).alias("eca"), below((key + size) % 8, 6).alias("cbs"),
        (size % 5 + 1).cast("int").alias("confidence"), F.col("p_retailprice").alias("price"))


def doc(spark: SparkSession, path: str) -> DataFrame:
    """Records with a partly missing label; see DOC."""
    d, lab = tables(spark, path, "documents", "labels")
    lang, q = F.col("lang"), F.col("quality")
    topic = (F.when(lang == "en", F.col("source")).when(lang == "de", "TBD")
             .when(lang == "fr", " unknown "))
    status = F.when(q.isNull(), "n/a").when(q == 1, "active").otherwise("")
    return d.join(lab, "doc_id", "left").select(
        F.col("doc_id").alias("id"), "text", "lang", "source", "n_chars", "quality", "toxic",
        topic.alias("topic"), status.alias("status"))


def evt(spark: SparkSession, path: str) -> DataFrame:
    """Cache entries and run outcomes; see EVT."""
    (e,) = tables(spark, path, "events")
    kind = F.col("event_type")
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("uid"), "ts", kind.alias("kind"),
        "value", F.from_json("props", "k int")["k"].alias("k"),
        F.when(kind.isin("purchase", "click"), "updated").when(kind == "view", "skipped")
        .when(kind == "error", "failed").otherwise("processed").alias("outcome"),
        (kind != "error").alias("success"),
        F.when(kind.isin("click", "purchase"), F.floor("value")).cast("int").alias("score"))


def score_columns():
    return ScoreColumns("imp", "mod", "hist", "rep", "tier", "nearby", "eca", "cbs")
