"""Golden rows: fixed inputs with known results, and the traps of the semantics."""

import pytest
from pyspark.sql import functions as F

from rosterloom.functions import derive, scoring, text
from rosterloom.functions.scoring import ScoreColumns
from rosterloom.operators import browse, evidence, groups, linkage, merge, quality
from rosterloom.sources import readers

S = ScoreColumns("imp", "mod", "hist", "rep", "tier", "nearby", "eca", "cbs")
SCORE_DDL = "imp int, mod int, hist int, rep int, tier int, nearby int, eca int, cbs int"


def values(spark, rows, ddl, *cols):
    out = spark.createDataFrame(rows, ddl).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)])
    got = [tuple(r) for r in out.collect()]
    return [g[0] for g in got] if len(cols) == 1 else got


def test_folder_hash_and_ids(spark):
    assert values(spark, [("usa-ak-anchorage-anchorage-museum",)], "s string",
                  text.folder_hash("s")) == ["m_32f29c04"]
    assert values(spark, [("USA", "AK", "", "Sheldon Museum and Cultural Center")],
                  "a string, b string, c string, d string",
                  text.entity_id("a", "b", "c", "d")) == [
        "usa-ak-unknown-sheldon-museum-and-cultural-center"]
    rows = [("anchorage", "Anchorage Museum", "usa-ak-anchorage-anchorage-museum"),
            ("palmer", "Palmer Museum of History and Art",
             "usa-ak-unknown-palmer-museum-of-history-and-art"),
            ("valdez", "Valdez Museum & Historical Archive",
             "usa-ak-unknown-valdez-museum-historical-archive")]
    assert values(spark, rows, "c string, n string, i string", text.slug_alias("c", "n", "i")) == [
        "anchorage-anchorage-museum--museum", "palmer-palmer-museum-of-history-and-art--art",
        "valdez-valdez-museum-historical-archive--rchive"]


def test_urls(spark):
    assert values(spark, [(" HTTPS://Ex.org/A b// ",)], "s string", text.normalize_url("s")) == [
        "https://ex.org/ab"]
    cases = [("http://h/a/b?q#f", "c.html", "http://h/a/c.html"),
             ("http://h/a/b", "/x", "http://h/x"), ("https://h", "//o/x", "https://o/x"),
             ("http://h/a", "https://z/", "https://z/"), ("http://h/a", "#t", "http://h/a#t"),
             ("http://h", "p", "http://h/p"), ("http://h/a?x=1", "?y=2", "http://h/a?y=2")]
    got = values(spark, [c[:2] for c in cases], "b string, h string", text.resolve_url("b", "h"))
    assert got == [c[2] for c in cases]


def test_names(spark):
    rows = [("The Museum",), ("Musée d'Orsay — Paris",), (None,)]
    assert values(spark, rows, "s string", text.match_name("s"), text.plain_name("s")) == [
        ("", "the museum"), ("musée dorsay paris", "musée dorsay paris"), ("", "")]


def test_similarity_is_ordered(spark):
    got = values(spark, [("tide", "diet"), ("diet", "tide"),
                         ("carnegie visual arts", "carnegie visual art")], "a string, b string",
                 linkage.similarity_ratio("a", "b"))
    assert got == pytest.approx([0.25, 0.5, 0.974359], abs=1e-6)


def test_types_and_visit_length(spark):
    rows = [("Art (Regional)",), ("history museum",), ("Cartoon Archive",), ("Maritime",), ("",),
            (None,)]
    assert values(spark, rows, "t string", derive.normalize_type("t")) == [
        "Art Museum", "History Museum", "Art Museum", "Maritime", None, None]
    rows = [("Art Museum", "Metropolitan Museum of Art"), ("Art Museum", "Lincoln Memorial Gallery"),
            (None, None)]
    assert values(spark, rows, "t string, n string", derive.visit_length("t", "n")) == [
        "Full day", "Quick stop (<1 hr)", "Half day"]
    assert values(spark, [("1-2 hours",), ("FULL DAY",), ("3 days",)], "v string",
                  derive.normalize_visit_length("v")) == ["Quick stop (<1 hr)", "Full day", None]


def test_containment_rules_that_cannot_fire_are_dropped_without_loss(spark):
    from rosterloom.functions import vocab
    probe = [f"x {k} y" for k, _ in vocab.TYPE_MAP] + ["Smart Zoo", "Ethnic museum hall of fame"]
    want = [next(v for k, v in vocab.TYPE_MAP if k in p.lower()) for p in probe]
    assert values(spark, [(p,) for p in probe], "t string", derive.normalize_type("t")) == want


def test_priority_versions(spark):
    rows = [(2, 3, 4, 1, 1, 3, 2, 3), (5, 5, 5, 0, 0, 0, 5, 5), (None, 4, None, 0, 0, 0, None, None),
            (None, None, None, None, 1, None, None, None)]
    got = values(spark, rows, SCORE_DDL, scoring.priority(S, "v1"), scoring.priority(S, "v2"),
                 scoring.priority(S, "v3"), scoring.quality(S, "v2"))
    assert got[0] == (15, 14, 13, 13)
    assert got[1][2] == -3
    assert got[2][:2] == (None, 12)
    assert got[3] == (None, None, None, None)
    missing = values(spark, rows[3:], SCORE_DDL, scoring.missing_inputs(S, "v2"))
    assert missing == [["art_strength", "reputation"]]


def test_breakdown_adds_up(spark):
    df = spark.createDataFrame([(2, 3, 4, 1, 1, 3, 4, 3)], SCORE_DDL)
    b = df.select(scoring.breakdown(S, "v3").alias("b")).first()["b"]
    assert b.priority == b.art + b.history + b.collection + b.reputation + b.dual_bonus + b.eca_bonus


def test_focus_ties(spark):
    rows = [(3, 3), (0, 0)]
    got = values(spark, rows, "imp int, mod int", *[
        scoring.primary_focus(S, v) for v in ("index", "phase", "patch")])
    modern = "Modern/Contemporary"
    assert got == [(modern, modern, "Impressionist"), (modern, None, None)]


def test_score_validation(spark):
    answer = ('Here: {"impressionist_strength": 7, "modern_contemporary_strength": -1, '
              '"historical_context_score": 3.9, "eca_score": "x", "confidence": 0, "reputation": 9, '
              '"score_notes": "%s"} ok' % ("n" * 600))
    df = spark.createDataFrame([(answer,), ("no json",)], "r string")
    a, b = scoring.validated_scores(df, F.col("r")).collect()
    assert (a.impressionist_strength, a.modern_contemporary_strength, a.historical_context_score,
            a.eca_score, a.confidence, a.reputation) == (5, 0, 3, None, 1, 3)
    assert len(a.score_notes) == 500 and b.confidence is None


def test_heuristics(spark):
    assert values(spark, [(50,), (10,), (3,), (2,)], "n int", derive.reputation_of_links("n")) == [
        0, 1, 2, None]
    assert values(spark, [("+100000",), ("9999",), ("999",), (None,), ("many",)], "a string",
                  derive.tier_of_size("a")) == [0, 2, 3, None, None]


def test_placeholders(spark):
    rows = [(None,), ("",), (" TBD ",), ("N/A",), ("none",), ("Tulsa",), ("\tunknown\n",)]
    got = values(spark, rows, "s string", text.is_missing("s", "report"),
                 text.is_missing("s", "write"))
    assert got == [(True, True)] * 4 + [(False, True), (False, False), (True, True)]


def test_peers_modes(spark):
    rows = [(1, "A", "X"), (2, "A", "X"), (3, "A", "X"), (4, "", "X"), (5, "", "X"), (6, None, "X")]
    df = spark.createDataFrame(rows, "id int, city string, state string")

    def counts(mode):
        out = groups.peers_in_city(df, "id", "city", "state", mode, "n").collect()
        return [r.n for r in sorted(out, key=lambda r: r.id)]

    assert counts("index") == [2, 2, 2, 2, 2, 2]  # null and '' are one place there
    assert counts("phase") == [2, 2, 2, 0, 0, 0]


def test_never_null_known(spark):
    rows = [(None, "x"), ("TBD", None), ("k", None), ("k", "o")]
    df = spark.createDataFrame(rows, "cur string, new string")
    out = merge.never_null_known(df, {"cur": "new"}).collect()
    assert [r.cur for r in out] == ["x", None, "k", "k"]


def test_trust_merge(spark):
    def win(*cands):
        rows = [("e", "f", v, t, ts, cur, lock, i) for i, (v, t, ts, cur, lock) in enumerate(cands)]
        df = spark.createDataFrame(
            rows, "id string, field string, value string, trust int, ts int, cur boolean, "
                  "locked boolean, tie int")
        return merge.trust_merge(df, ["id", "field"], "value", "trust", "ts", "cur", "locked",
                                 "tie").first()["value"]

    assert win(("old", 3, 1, True, False), ("new", 4, 0, False, False)) == "new"
    assert win(("old", 4, 1, True, False), ("new", 3, 9, False, False)) == "old"
    assert win(("old", 3, 1, True, False), ("new", 3, 2, False, False)) == "new"
    assert win(("old", 3, 1, True, False), ("TBD", 3, 2, False, False)) == "old"
    assert win(("old", 3, 1, True, True), ("new", 9, 2, False, False)) == "old"
    assert win(("old", 3, 1, True, False), (None, 9, 2, False, False)) == "old"


def test_pair_fill(spark):
    df = spark.createDataFrame([(1.0, None)], "lat double, lon double")
    pair = merge.pair_fill(df, "lat", "lon", F.lit(5.0), F.lit(6.0)).first()
    single = merge.pair_fill(df, "lat", "lon", F.lit(5.0), F.lit(6.0), independent=True).first()
    assert (pair.lat, pair.lon, single.lat, single.lon) == (1.0, None, 1.0, 6.0)


def test_zero_counts_as_absent_in_the_scored_filter(spark):
    assert values(spark, [(0, 0), (0, 1), (None, None)], "imp int, mod int",
                  scoring.has_art_score(S)) == [False, True, False]


def test_state_mismatch_uses_the_name_table(spark):
    rows = [("Arizona", "AZ"), ("Arizona", "AR"), ("Arizona", None), ("AZ", "AZ")]
    assert values(spark, rows, "s string, c string", derive.state_mismatch("s", "c")) == [
        False, True, False, False]


def test_roster_issues(spark):
    rows = [(1, "S", "N", "", "x.org"), (2, "S", "M", "", "http://a.org)"),
            (3, "S", "O", "", "http://a.org/%20"), (4, "s", "n ", "", "http://a.org"),
            (5, "", "P", "", "")]
    df = spark.createDataFrame(rows, "r int, s string, n string, c string, u string")
    got = {tuple(r) for r in quality.roster_issues(df, "s", "n", "c", "u", "r").collect()}
    assert got == {(1, "ERROR", "invalid_url"), (2, "WARN", "trailing_bracket"),
                   (3, "WARN", "percent_20"), (4, "WARN", "duplicate"), (5, "ERROR", "empty_state"),
                   (5, "ERROR", "empty_url")}


def test_article_classes(spark):
    rows = [(True, "A city." + " x" * 120 + " population 9"), (True, "The airport"), (True, "A museum"),
            (False, "A museum"), (None, None)]
    assert values(spark, rows, "f boolean, e string", derive.article_class("f", "e")) == [
        "city", "wrong", "good", "none", "none"]


def test_sheet_headers_and_repeated_names(spark):
    rows = [(1, "X's", "1.0", "a"), (2, "Y", "2", "b"), (3, "xs", "oops", "c"), (4, None, "9", "d")]
    df = spark.createDataFrame(rows, "row_no int, `The MUSEUM NAME here` string, "
                                     "`Priority Score (new)` string, Notes string")
    sheet = readers.resolve_sheet(df, "row_no")
    got = {r.name_key: (r.position, r.priority_score, r.notes) for r in readers.sheet_entries(
        sheet, "row_no", "museum_name", ["priority_score", "notes"]).collect()}
    assert got == {"xs": (1, None, "c"), "y": (2, 2, "b")}
    with pytest.raises(ValueError):
        readers.resolve_sheet(df.drop("The MUSEUM NAME here"), "row_no")


def test_containment_needs_eleven_characters(spark):
    records = spark.createDataFrame([(1, "abcdefghij hall"), (2, "abcdefghijk hall")], "id int, n string")
    sheet = spark.createDataFrame([(1, "abcdefghij", 1), (2, "abcdefghijk", 2)],
                                  "row_no int, t string, v int")
    out = linkage.sheet_match(records, "n", sheet, "t", "row_no", ["v"]).collect()
    assert {r.id: r.sheet_v for r in out} == {1: None, 2: 2}


def test_fuzzy_goldens(spark):
    museums = spark.createDataFrame(
        [(1, "AL", "Carnegie Visual Arts Center"), (2, "CO", "Denver Art Museum"),
         (3, "NY", "The Museum"), (4, "NY", ""), (5, "TX", "EXACT Name")], "id int, st string, n string")
    ext = spark.createDataFrame(
        [(1, "AL", "Carnegie Visual Art Center"), (2, "CO", "Denver Botanic Gardens"),
         (3, "NY", "Center for the Gallery"), (4, "TX", "exact name "), (5, "TX", "Exact Name")],
        "row_no int, st string, t string")
    out = {r.id: (r.match_type, r.match_row_no) for r in linkage.fuzzy_match(
        museums, ext, "st", "n", "t", "row_no", ["row_no"]).collect()}
    assert out == {1: ("fuzzy", 1), 2: (None, None), 3: ("fuzzy", 3), 4: (None, None),
                   5: ("exact", 4)}


def test_evidence_packet_drops_noise(spark):
    import json
    row = ("N", None, "S", "Art", None, ["a"], None, 2, 0, None, "", "CSV: x", True, "text", None)
    ddl = ("name string, city string, state string, type string, domain string, topics array<string>, "
           "reputation int, tier int, city_tier int, nearby int, website string, notes string, "
           "found boolean, extract string, page_url string")
    roles = {k.split()[0]: k.split()[0] for k in ddl.split(", ")}
    packet = spark.createDataFrame([row], ddl).select(evidence.evidence_packet(roles)).first()[0]
    assert json.loads(packet) == {"museum_name": "N", "state": "S", "museum_type": "Art", "wikipedia_summary": "text",
                                  "topics": ["a"], "existing_assessments": {"prior_collection_tier": 2}}


def test_top_dimensions_keep_declared_order_on_ties(spark):
    df = spark.createDataFrame([(5, 9, 9, 4, None)], "a int, b int, c int, d int, e int")
    dims = [(c, c.upper()) for c in "abcde"]
    got = df.select(browse.top_dimensions(dims)).first()[0]
    assert [(r.label, r.score) for r in got] == [("B", 9), ("C", 9), ("A", 5)]


def test_claim_values_and_components(spark):
    got = spark.range(1).select(
        derive.claim_value(F.create_map(F.lit("P1"), F.array(F.lit(None), F.lit("v"))), "P1"),
        derive.claim_value(F.create_map(F.lit("P1"), F.array(F.lit("v"))), "P2")).first()
    assert tuple(got) == ("v", None)


def test_rates(spark):
    from rosterloom.operators import runs
    got = values(spark, [(1, 3), (0, 0)], "a int, b int", runs.rate_text(F.col("a"), F.col("b")),
                 runs.coverage_text(F.col("a"), F.col("b")))
    assert got == [("33.3%", "1/3 (33.3%)"), ("0%", "0/0 (0%)")]


def test_rerun_adds_no_sentence_twice(spark):
    df = spark.createDataFrame([("old",), (None,)], "n string")
    add = [F.lit("A: one"), F.lit(None).cast("string"), F.lit("B: two")]
    once = df.withColumn("n", merge.append_sentences("n", add))
    twice = once.withColumn("n", merge.append_sentences("n", add))
    assert [r.n for r in once.collect()] == ["old A: one B: two", "A: one B: two"]
    assert once.collect() == twice.collect()
