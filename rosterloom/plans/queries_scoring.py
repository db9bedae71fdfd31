"""Scores, focus, bands, gates and gap selections over scored records."""

from pyspark.sql import functions as F

from ..functions import derive, scoring, vocab
from ..operators import browse, merge
from .bindings import ART, art, score_columns
from .registry import query

S = score_columns()

P1 = ("CASE WHEN imp IS NOT NULL AND mod IS NOT NULL AND hist IS NOT NULL AND rep IS NOT NULL AND "
      "tier IS NOT NULL THEN CAST((6 - greatest(imp, mod)) * 3 + (6 - hist) * 2 + rep + tier - "
      "CASE WHEN imp >= 4 AND mod >= 4 THEN 2 ELSE 0 END AS INT) END")
OK2 = "(coalesce(imp, mod) IS NOT NULL AND rep IS NOT NULL AND tier IS NOT NULL)"
TOP2 = "greatest(coalesce(imp, 1), coalesce(mod, 1))"
DUAL = "(CASE WHEN imp >= 4 AND mod >= 4 THEN 2 ELSE 0 END)"
P2 = (f"CASE WHEN {OK2} THEN CAST((6 - {TOP2}) * 3 + (6 - coalesce(hist, 3)) * 2 + rep + tier - "
      f"{DUAL} - CASE WHEN nearby >= 3 THEN 1 ELSE 0 END AS INT) END")
Q2 = f"CASE WHEN {OK2} THEN CAST({TOP2} * 3 + (3 - rep) + (3 - tier) + {DUAL} AS INT) END"
OK3 = ("(coalesce(imp, mod) IS NOT NULL AND hist IS NOT NULL AND cbs IS NOT NULL AND "
       "rep IS NOT NULL AND eca IS NOT NULL)")
TOP3 = "greatest(coalesce(imp, mod), coalesce(mod, imp))"
P3 = (f"CASE WHEN {OK3} THEN CAST((5 - {TOP3}) * 3 + (5 - hist) * 2 + (5 - cbs) * 2 + rep - {DUAL}"
      " - CASE WHEN eca >= 4 THEN 1 ELSE 0 END AS INT) END")
Q3 = (f"CASE WHEN {OK3} THEN CAST({TOP3} * 3 + hist * 2 + cbs * 2 + (3 - rep) + {DUAL} + "
      "CASE WHEN eca >= 4 THEN 1 ELSE 0 END AS INT) END")
Q3S = f"CASE WHEN {OK3} THEN CAST({TOP3} * 3 + hist * 2 + cbs * 2 + (3 - rep) + {DUAL} + eca AS INT) END"
HAS_ART = "(coalesce(imp, 0) <> 0 OR coalesce(mod, 0) <> 0)"


def _sql(select: str, tail: str = "") -> str:
    return f"WITH {ART} SELECT {select} FROM art {tail}"


@query("j6_rank_with_breakdown", _sql(
    f"id, name, {P3} AS priority, {Q3} AS quality, CAST((5 - {TOP3}) * 3 AS INT) AS art_part, "
    "CAST((5 - hist) * 2 AS INT) AS history_part, CAST((5 - cbs) * 2 AS INT) AS collection_part, "
    f"rep AS reputation_part, CAST(-{DUAL} AS INT) AS dual_part, "
    "CAST(CASE WHEN eca >= 4 THEN -1 ELSE 0 END AS INT) AS eca_part",
    f"WHERE domain = 'Art' AND scoreable AND {OK3}"))
def rank_with_breakdown(spark, path):
    b = scoring.breakdown(S, "v3")
    scored = (art(spark, path).filter(derive.is_art("domain", domain_col="domain")
                                      & derive.is_art("flag", flag_col="scoreable"))
              .select("id", "name", b.alias("b")).filter("b.can_score")
              .select("id", "name", "b.priority", "b.quality", F.col("b.art").alias("art_part"),
                      F.col("b.history").alias("history_part"),
                      F.col("b.collection").alias("collection_part"),
                      F.col("b.reputation").alias("reputation_part"),
                      F.col("b.dual_bonus").alias("dual_part"),
                      F.col("b.eca_bonus").alias("eca_part")))
    return scored.orderBy(*browse.priority_order("priority", "name", "id"))


@query("j1_priority_v1", _sql(f"id, {P1} AS priority"))
def priority_v1(spark, path):
    return art(spark, path).select("id", scoring.priority(S, "v1").alias("priority"))


@query("j2_priority_v2", _sql(f"id, {P2} AS priority"))
def priority_v2(spark, path):
    return art(spark, path).select("id", scoring.priority(S, "v2").alias("priority"))


@query("j3_priority_v3", _sql(f"id, {P3} AS priority"))
def priority_v3(spark, path):
    return art(spark, path).select("id", scoring.priority(S, "v3").alias("priority"))


@query("j4_quality_v2", _sql(f"id, {Q2} AS quality"))
def quality_v2(spark, path):
    return art(spark, path).select("id", scoring.quality(S, "v2").alias("quality"))


@query("j5_quality_v3", _sql(f"id, {Q3} AS with_bonus, {Q3S} AS with_score"))
def quality_v3(spark, path):
    return art(spark, path).select("id", scoring.quality(S, "v3", "bonus").alias("with_bonus"),
                                   scoring.quality(S, "v3", "score").alias("with_score"))


@query("j6_missing_inputs", _sql(
    "id, concat_ws(',', CASE WHEN coalesce(imp, mod) IS NULL THEN 'art_strength' END, "
    "CASE WHEN rep IS NULL THEN 'reputation' END, CASE WHEN tier IS NULL THEN 'collection_tier' "
    f"END) AS missing_v2, {OK2} AS can_v2, concat_ws(',', CASE WHEN coalesce(imp, mod) IS NULL "
    "THEN 'art_strength' END, CASE WHEN hist IS NULL THEN 'history' END, CASE WHEN cbs IS NULL "
    "THEN 'collection_strength' END, CASE WHEN rep IS NULL THEN 'reputation' END, CASE WHEN eca "
    "IS NULL THEN 'eca' END) AS missing_v3"))
def missing_inputs(spark, path):
    return art(spark, path).select(
        "id", F.array_join(scoring.missing_inputs(S, "v2"), ",").alias("missing_v2"),
        scoring.can_score(S, "v2").alias("can_v2"),
        F.array_join(scoring.missing_inputs(S, "v3"), ",").alias("missing_v3"))


_IMP, _MOD = "'Impressionist'", "'Modern/Contemporary'"


@query("j7_primary_focus", _sql(
    f"id, CASE WHEN imp IS NULL AND mod IS NULL THEN NULL WHEN mod IS NULL THEN {_IMP} WHEN imp > "
    f"mod THEN {_IMP} ELSE {_MOD} END AS focus_index, CASE WHEN coalesce(imp, 0) > coalesce(mod, "
    f"0) THEN {_IMP} WHEN coalesce(mod, 0) > coalesce(imp, 0) THEN {_MOD} WHEN coalesce(imp, 0) > 0 "
    f"THEN {_MOD} END AS focus_phase, CASE WHEN coalesce(mod, 0) > coalesce(imp, 0) THEN {_MOD} "
    f"WHEN coalesce(imp, 0) > 0 THEN {_IMP} END AS focus_patch"))
def primary_focus(spark, path):
    return art(spark, path).select("id", *[
        scoring.primary_focus(S, v).alias(f"focus_{v}") for v in ("index", "phase", "patch")])


@query("j8_must_see_and_eca", _sql(
    "id, coalesce(hist = 5, false) AS must_see, coalesce(eca >= 4, false) AS eca_highlight"))
def must_see(spark, path):
    return art(spark, path).select("id", scoring.must_see(S).alias("must_see"),
                                   F.coalesce(F.col("eca") >= 4, F.lit(False)).alias("eca_highlight"))


@query("j9_scored_flag", _sql(
    f"id, coalesce(domain = 'Art', false) AND ({P1}) IS NOT NULL AS is_scored, CASE WHEN domain = 'Art' "
    f"AND ({P1}) IS NOT NULL THEN 'v1.0' END AS scoring_version"))
def scored_flag(spark, path):
    score = F.when(derive.is_art("domain", domain_col="domain"), scoring.priority(S, "v1"))
    return art(spark, path).select(
        "id", score.isNotNull().alias("is_scored"),
        F.when(score.isNotNull(), "v1.0").alias("scoring_version"))


@query("j10_score_bands", _sql(
    f"id, CASE WHEN ({P3}) <= 5 THEN 'must_visit' WHEN ({P3}) <= 10 THEN 'high_priority' WHEN "
    f"({P3}) <= 15 THEN 'worthwhile' WHEN ({P3}) IS NOT NULL THEN 'known_or_regional' END AS "
    f"priority_band, CASE WHEN ({Q3S}) >= 35 THEN 'world_class' WHEN ({Q3S}) >= 28 THEN 'excellent'"
    f" WHEN ({Q3S}) >= 21 THEN 'very_good' WHEN ({Q3S}) >= 14 THEN 'good' WHEN ({Q3S}) IS NOT NULL "
    "THEN 'modest' END AS quality_band"))
def score_bands(spark, path):
    return art(spark, path).select(
        "id", scoring.priority_band(scoring.priority(S)).alias("priority_band"),
        scoring.quality_band(scoring.quality(S, "v3", "score")).alias("quality_band"))


_TYPE_OK = ("('Fine Art', 'Contemporary Art', 'Modern Art', 'University Art Museum', "
            "'Encyclopedic Art Museum', 'Art Museum', 'Art Center', 'Art Gallery')")
# what the type rule gives for the ten type texts of this binding
_NORM = ("CASE trim(lower(kind)) WHEN 'art museum' THEN 'Art Museum' WHEN 'fine art' THEN 'Fine Art' "
         "WHEN 'history museum' THEN 'History Museum' WHEN 'university museum' THEN "
         "'University Art Museum' WHEN 'zoo' THEN 'Zoo/Aquarium' WHEN 'children''s museum' THEN "
         "'Children''s Museum' ELSE CASE WHEN lower(kind) LIKE '%art%' THEN 'Art Museum' ELSE "
         "trim(kind) END END")


@query("b4_eligibility_gates", _sql(
    f"id, {_NORM} IN {_TYPE_OK} AS by_type, scoreable AS by_flag, regexp_matches(lower(kind), "
    "'art|arte|kunst|gallery|contemporary') AS by_keyword, coalesce(domain = 'Art', false) AS "
    "by_domain, coalesce(domain = 'Art', false) OR lower(kind) LIKE '%art%' AS by_domain_or_type"))
def eligibility_gates(spark, path):
    return art(spark, path).select(
        "id", derive.is_art("type", type_col="kind").alias("by_type"),
        derive.is_art("flag", flag_col="scoreable").alias("by_flag"),
        derive.is_art("keyword", type_col="kind").alias("by_keyword"),
        derive.is_art("domain", domain_col="domain").alias("by_domain"),
        derive.is_art("domain_or_type", type_col="kind", domain_col="domain")
        .alias("by_domain_or_type"))


@query("b10_scored_only", _sql("id, imp, mod", f"WHERE scoreable AND {HAS_ART}"))
def scored_only(spark, path):
    return art(spark, path).filter(F.col("scoreable") & scoring.has_art_score(S)).select(
        "id", "imp", "mod")


@query("b11_must_see_and_high_eca", _sql(
    "id, hist, eca, coalesce(hist = 5, false) AS must_see",
    "WHERE scoreable AND (hist = 5 OR coalesce(eca, 0) >= 4)"))
def must_see_and_high_eca(spark, path):
    keep = scoring.must_see(S) | (F.coalesce("eca", F.lit(0)) >= 4)
    return art(spark, path).filter(F.col("scoreable") & keep).select(
        "id", "hist", "eca", scoring.must_see(S).alias("must_see"))


def _rescorable():
    return (derive.is_art("domain", domain_col="domain") & F.col("rep").isNotNull()
            & (F.col("tier").isNull() | ~scoring.has_art_score(S)))


_RESCORE = f"domain = 'Art' AND rep IS NOT NULL AND (tier IS NULL OR NOT {HAS_ART})"


@query("b12_rescorable", _sql("id, rep, tier, imp, mod", f"WHERE {_RESCORE}"))
def rescorable(spark, path):
    return art(spark, path).filter(_rescorable()).select("id", "rep", "tier", "imp", "mod")


@query("d7_gap_breakdown", _sql(
    f"CAST(count(*) AS BIGINT) AS total, count(*) FILTER (tier IS NULL AND {HAS_ART}) AS tier_only,"
    f" count(*) FILTER (tier IS NOT NULL AND NOT {HAS_ART}) AS art_only, count(*) FILTER (tier IS "
    f"NULL AND NOT {HAS_ART}) AS both_missing", f"WHERE {_RESCORE}"))
def gap_breakdown(spark, path):
    has, no_tier = scoring.has_art_score(S), F.col("tier").isNull()
    return art(spark, path).filter(_rescorable()).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(no_tier & has).alias("tier_only"),
        F.count_if(~no_tier & ~has).alias("art_only"),
        F.count_if(no_tier & ~has).alias("both_missing"))


@query("b13_high_value_gaps", _sql(
    "id, name, rep", f"WHERE domain = 'Art' AND rep <= 2 AND NOT {HAS_ART} AND name LIKE "
    "'%ring%' ORDER BY id LIMIT 15"))
def high_value_gaps(spark, path):
    gap = (derive.is_art("domain", domain_col="domain") & ~scoring.has_art_score(S)
           & (F.col("rep") <= 2) & F.col("name").contains("ring"))
    return art(spark, path).filter(gap).select("id", "name", "rep").orderBy("id").limit(15)


@query("b16_model_tier", _sql(
    "id, CASE WHEN regexp_matches(lower(kind), 'art|arte|kunst|gallery|contemporary') THEN "
    "'premium' ELSE 'standard' END AS model_tier"))
def model_tier(spark, path):
    return art(spark, path).select("id", derive.model_tier("kind").alias("model_tier"))


# one expression for each of the dimensions, in their order
_DIM = tuple((c, f"(p_size * {2 * i + 1} + p_partkey * {i + 2}) % 11", label)
             for i, (c, label) in enumerate(vocab.DIMENSIONS))


@query("e7_top_dimension_scores", (
    "WITH s AS (" + " UNION ALL ".join(
        f"SELECT p_partkey AS id, {i} AS i, '{label}' AS label, CAST({e} AS INT) AS score "
        "FROM part" for i, (c, e, label) in enumerate(_DIM))
    + "), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, i) AS rk FROM s "
    "WHERE score >= 5) SELECT id, CAST(rk AS INT) AS rank, label, score FROM r WHERE rk <= 5"))
def top_dimension_scores(spark, path):
    part = spark.read.parquet(f"{path}/part.parquet")
    scored = part.select(F.col("p_partkey").alias("id"),
                         *[F.expr(e).cast("int").alias(c) for c, e, _ in _DIM])
    top = browse.top_dimensions()
    return scored.select("id", F.posexplode(top).alias("pos", "t")).select(
        "id", (F.col("pos") + 1).alias("rank"), "t.label", "t.score")


@query("e8_rank_bands", (
    f"WITH {ART}, s AS (SELECT id, name, {P3} AS priority FROM art WHERE domain = 'Art'), r AS ("
    "SELECT *, row_number() OVER (ORDER BY priority ASC NULLS LAST, name, id) AS rk FROM s) SELECT "
    "id, priority, CASE WHEN rk <= 50 THEN 'GOLD' WHEN rk <= 100 THEN 'SILVER' ELSE 'BRONZE' END AS "
    "band FROM r"))
def rank_bands(spark, path):
    scored = art(spark, path).filter(derive.is_art("domain", domain_col="domain")).select(
        "id", "name", scoring.priority(S).alias("priority"))
    banded = browse.rank_bands(scored, "id", browse.priority_order("priority", "name", "id"))
    return banded.select("id", "priority", "band")


@query("j11_scoring_run", (
    f"WITH {ART}, s AS (SELECT state, CASE WHEN NOT scoreable THEN 'not_art' WHEN imp = 5 THEN "
    f"'already_scored' WHEN {OK2} THEN 'scored' ELSE 'cannot_score' END AS outcome FROM art) SELECT "
    "coalesce(state, 'total') AS level, count(*) AS processed, count(*) FILTER (outcome = "
    "'not_art') AS not_art, count(*) FILTER (outcome = 'already_scored') AS already_scored, "
    "count(*) FILTER (outcome = 'cannot_score') AS cannot_score, count(*) FILTER (outcome = "
    "'scored') AS scored FROM s GROUP BY ROLLUP (state)"))
def scoring_run(spark, path):
    from ..operators import runs
    from .phases import scoring_outcome

    stored = F.when(F.col("imp") == 5, 1)
    outcome = scoring_outcome(S, "scoreable", stored, "v2")
    return runs.outcome_counters(
        art(spark, path).withColumn("outcome", outcome), "state", "outcome",
        ("not_art", "already_scored", "cannot_score", "scored")).drop("state")


@query("h28_score_labels", _sql(
    "id, CASE WHEN coalesce(nearby, 0) + coalesce(imp, 0) = 0 THEN 'Not Rated' WHEN "
    "coalesce(nearby, 0) + coalesce(imp, 0) >= 9 THEN 'World-Class' WHEN coalesce(nearby, 0) + "
    "coalesce(imp, 0) >= 8 THEN 'Outstanding' WHEN coalesce(nearby, 0) + coalesce(imp, 0) >= 7 THEN "
    "'Excellent' WHEN coalesce(nearby, 0) + coalesce(imp, 0) >= 6 THEN 'Very Good' WHEN "
    "coalesce(nearby, 0) + coalesce(imp, 0) >= 5 THEN 'Good' ELSE 'Modest' END AS label"))
def score_labels(spark, path):
    score = F.coalesce("nearby", F.lit(0)) + F.coalesce("imp", F.lit(0))
    return art(spark, path).select("id", derive.score_label(score).alias("label"))


@query("h27_ordinal_labels", _sql(
    "id, CASE rep WHEN 0 THEN 'International' WHEN 1 THEN 'National' WHEN 2 THEN 'Regional' WHEN 3 "
    "THEN 'Local' END AS reputation, CASE cbs WHEN 5 THEN 'Canon-Defining' WHEN 4 THEN 'Major "
    "Scholarly' WHEN 3 THEN 'Strong Regional' WHEN 2 THEN 'Modest' WHEN 1 THEN 'Limited' WHEN 0 "
    "THEN 'None' END AS collection, CASE eca WHEN 5 THEN 'Field-Shaping' WHEN 4 THEN 'Nationally "
    "Recognized' WHEN 3 THEN 'Strong Regional' WHEN 2 THEN 'Competent' WHEN 1 THEN 'Minimal' WHEN 0 "
    "THEN 'None' END AS curatorial"))
def ordinal_labels(spark, path):
    from ..functions import vocab
    return art(spark, path).select(
        "id", derive.label("rep", vocab.REPUTATION_LABELS).alias("reputation"),
        derive.label("cbs", vocab.COLLECTION_LABELS).alias("collection"),
        derive.label("eca", vocab.ECA_LABELS).alias("curatorial"))


_TIER = "CASE WHEN p_brand < 'Brand#15' THEN 1 WHEN p_brand < 'Brand#20' THEN 2 ELSE 3 END"


@query("h26_documented_heuristics", (
    f"SELECT p_partkey AS id, CAST(CASE WHEN p_name LIKE 'r%' THEN 1 WHEN "
    f"{_TIER} = 1 THEN 2 ELSE 3 END AS INT) AS reputation, CAST(CASE WHEN p_type = 'STANDARD' THEN 1"
    f" WHEN {_TIER} <= 2 THEN 2 ELSE 3 END AS INT) AS collection_tier FROM part"))
def documented_heuristics(spark, path):
    part = spark.read.parquet(f"{path}/part.parquet")
    tier = F.expr(_TIER)
    name = F.when(F.col("p_name").startswith("r"), F.concat(F.lit("National "), "p_name")).otherwise(
        F.col("p_name"))
    kind = F.when(F.col("p_type") == "STANDARD", "State Museum").otherwise(F.col("p_type"))
    return part.select(F.col("p_partkey").alias("id"),
                       derive.documented_reputation(name, tier).alias("reputation"),
                       derive.documented_collection_tier(kind, tier).alias("collection_tier"))


@query("h24_reputation_of_links", (
    "SELECT c_custkey AS id, CAST(CASE WHEN n >= 50 THEN 0 WHEN n >= 10 THEN 1 WHEN n >= 3 THEN 2 "
    "END AS INT) AS reputation FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT "
    "JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey)"))
def reputation_of_links(spark, path):
    c = spark.read.parquet(f"{path}/customer.parquet")
    o = spark.read.parquet(f"{path}/orders.parquet").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n"))
    return c.join(o, "c_custkey", "left").select(
        F.col("c_custkey").alias("id"), derive.reputation_of_links("n").alias("reputation"))


@query("h25_tier_of_size", (
    "SELECT o_orderkey AS id, CAST(CASE WHEN o_orderpriority = '5-LOW' THEN NULL WHEN "
    "floor(o_totalprice) >= 100000 THEN 0 WHEN floor(o_totalprice) >= 10000 THEN 1 WHEN "
    "floor(o_totalprice) >= 1000 THEN 2 ELSE 3 END AS INT) AS tier FROM orders"))
def tier_of_size(spark, path):
    amount = F.when(F.col("o_orderpriority") == "5-LOW", "many").otherwise(
        F.concat(F.lit("+"), F.col("o_totalprice").cast("decimal(18,2)").cast("string")))
    return spark.read.parquet(f"{path}/orders.parquet").select(
        F.col("o_orderkey").alias("id"), derive.tier_of_size(amount).alias("tier"))


@query("i12_heuristic_fallback", (
    f"WITH {ART} SELECT id, CAST(coalesce(rep, CASE WHEN links >= 50 THEN 0 WHEN links >= 10 THEN 1 "
    "WHEN links >= 3 THEN 2 END) AS INT) AS rep, CASE WHEN rep IS NULL AND links >= 3 THEN "
    "'wikidata_heuristic' END AS rep_source, CAST(coalesce(tier, CASE WHEN qty >= 100000 THEN 0 WHEN"
    " qty >= 10000 THEN 1 WHEN qty >= 1000 THEN 2 WHEN qty IS NOT NULL THEN 3 END) AS INT) AS tier, "
    "CASE WHEN tier IS NULL AND qty IS NOT NULL THEN 'wikidata_heuristic' END AS tier_source FROM "
    "art LEFT JOIN (SELECT l_partkey, count(*) AS links, sum(l_quantity) AS qty FROM lineitem GROUP "
    "BY l_partkey) ON id = l_partkey"))
def heuristic_fallback(spark, path):
    from .phases import heuristic_fill
    entity = (spark.read.parquet(f"{path}/lineitem.parquet").groupBy(F.col("l_partkey").alias("id"))
              .agg(F.count(F.lit(1)).alias("links"),
                   F.concat(F.lit("+"), F.sum("l_quantity").cast("string")).alias("amount")))
    return heuristic_fill(art(spark, path), entity, "id", "rep", "tier", "links", "amount").select(
        "id", "rep", "rep_source", "tier", "tier_source")


@query("b5_already_done", _sql(
    "id, CASE WHEN coalesce(imp, mod, hist, eca, cbs) IS NOT NULL THEN 'skip' ELSE 'todo' END AS "
    "by_scores, CASE WHEN kind LIKE '%Museum%' AND city <> '' AND coalesce(domain, '') <> '' THEN "
    "'skip' ELSE 'todo' END AS by_content, CASE WHEN domain = 'Art' THEN 'skip' ELSE 'todo' END AS "
    f"by_source, CASE WHEN {P3} IS NOT NULL THEN 'skip' ELSE 'todo' END AS by_priority, 'todo' AS forced"))
def already_done(spark, path):
    tags = F.when(F.col("domain") == "Art", F.array(F.lit("seed"), F.lit("wikidata"))).otherwise(
        F.array(F.lit("seed")))
    a = art(spark, path).withColumns({
        "summary": F.when(F.col("kind").contains("Museum"), F.col("city")),
        "priority": scoring.priority(S)})
    scores = derive.any_set("imp", "mod", "hist", "eca", "cbs")
    return a.select(
        "id", derive.skip_or_todo(scores).alias("by_scores"),
        derive.skip_or_todo(derive.all_given("summary", "city", "domain")).alias("by_content"),
        derive.skip_or_todo(derive.is_done_source(tags, "wikidata")).alias("by_source"),
        derive.skip_or_todo(derive.any_set("priority")).alias("by_priority"),
        derive.skip_or_todo(scores, force=True).alias("forced"))


@query("i9_change_log", _sql(
    "id, concat_ws(',', CASE WHEN tier IS NULL THEN 'tier' END, CASE WHEN rep IS NULL THEN 'rep' "
    "END) AS updated, concat_ws(',', CASE WHEN tier IS NOT NULL THEN 'tier' END, CASE WHEN rep IS "
    "NOT NULL THEN 'rep' END) AS skipped"))
def change_log(spark, path):
    gone = {c: F.col(c).isNull() for c in ("tier", "rep")}
    return art(spark, path).select(
        "id", F.array_join(merge.change_list(gone), ",").alias("updated"),
        F.array_join(merge.change_list({c: ~v for c, v in gone.items()}), ",").alias("skipped"))
