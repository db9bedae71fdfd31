"""The composed phases on small records."""

from pyspark.sql import functions as F

from rosterloom.operators import dedupe
from rosterloom.plans import phases, queries_run
from tests.test_linkage import DDL, ROLES, greedy, matches, roster_rows


def test_ingest_equals_the_sequential_rule(spark):
    rows, known = roster_rows(250, 21, 0.2), roster_rows(80, 22, 0.2)
    records = spark.createDataFrame(
        [(b, s, n, c or "Unknown", u) for _, b, s, n, c, u in known],
        "state_code string, state_province string, museum_name string, city string, website string")
    roster = spark.createDataFrame(rows, DDL)
    out = phases.ingest_roster(records, roster, ROLES, "row_no", F.lit("2026-01-01"), "seed", "note")
    fresh = [r for r in rows if not any(matches((0, *k[1:4], k[4] or "Unknown", k[5]), r) for k in known)]
    kept = set(greedy(fresh))
    want = sorted((r[3], r[4] or "Unknown", r[5]) for r in rows if r[0] in kept)
    assert sorted((r.museum_name, r.city, r.website) for r in out.collect()) == want
    # a second run over records and stubs adds nothing
    again = phases.ingest_roster(
        records.unionByName(out.withColumn("state_code", F.lit("ZZ")).select(records.columns)),
        roster, ROLES, "row_no", F.lit("2026-01-01"), "seed", "note")
    assert again.count() == 0


EXT = ("row_no int, `Museum ID` string, `Museum Name` string, `Museum Type` string, "
       "`Phone Number` string, Latitude string, Longitude string, "
       "`Street Address (Physical Location)` string, "
       "`Street Address (Administrative Location)` string, `City (Physical Location)` string, "
       "`City (Administrative Location)` string, `State (Administrative Location)` string, "
       "`Zip Code (Physical Location)` string, `Zip Code (Administrative Location)` string, "
       "Income string, Revenue string")
REC = ("museum_id string, state_province string, museum_name string, phone string, "
       "museum_type string, latitude double, longitude double, street_address string, "
       "address_source string, address_last_verified string, city string, postal_code string, "
       "notes string, data_sources array<string>")


def test_link_external(spark):
    ext = spark.createDataFrame(
        [(1, "84", "Ada House", "ART MUSEUM ", "555", "40.5", "-80", " ", "1 Admin Rd", "", "Akron",
          "OH", "", "44301", "10", ""),
         (2, "85", "Lincoln County Railway", "zoo", "", "x", "1", "2 Rail", "", "Lima", "", "OH", "1",
          "", "", "")], EXT)
    rec = spark.createDataFrame(
        [("a", "Ohio", "ADA house", "TBD", "Unknown", None, None, "TBD", "narm", None, "unknown",
          None, "seen", None),
         ("b", "Ohio", "Lincoln Co. Railway", "1", "Kept", 1.0, None, "TBD", "manual", None, "Lima",
          "9", None, ["seed"]),
         ("c", "Ohio", "Elsewhere", None, None, None, None, None, None, None, None, None, None, []),
         ("d", "Ohio", "Ada House", None, None, None, None, None, None, None, None, None, None,
          ["museums_csv"]),
         ("e", "Bermuda", "Ada House", None, None, None, None, None, None, None, None, None, None,
          None)], REC)
    out = phases.link_external(rec, ext, "row_no", F.lit("2026-01-01"))
    got = {r.museum_id: r for r in out.collect()}
    a, b = got["a"], got["b"]
    assert [got[k].outcome for k in "abcde"] == ["exact", "fuzzy", "no_match", "skipped", "no_match"]
    assert (a.phone, a.museum_type, a.latitude, a.longitude, a.city, a.postal_code) == (
        "555", "Art Museum", 40.5, -80.0, "Akron", "44301")
    assert (a.street_address, a.address_source, a.address_last_verified) == (
        "1 Admin Rd", "museums_csv", "2026-01-01")
    assert a.notes == (
        "seen CSV: IRS Museum ID 84 CSV: phone from IRS 990 database CSV: museum type 'Art Museum' "
        "CSV: coordinates from IRS 990 database CSV: physical address from IRS 990 CSV: "
        "financial data available (income: 10, revenue: N/A)")
    assert a.data_sources == ["museums_csv"] and len(a.filled_fields) == 7
    assert (b.phone, b.museum_type, b.latitude, b.longitude, b.street_address) == (
        "1", "Kept", 1.0, None, "TBD")
    assert b.data_sources == ["seed", "museums_csv"] and b.filled_fields == []
    once = out.filter("outcome <> 'skipped'").select(rec.columns)
    twice = phases.link_external(once, ext, "row_no", F.lit("2027-01-01"), force=True)
    assert sorted(map(str, twice.select(rec.columns).collect())) == sorted(map(str, once.collect()))


def test_link_sheet(spark):
    sheet = spark.createDataFrame([(1, "Ada's House", 5, "x"), (2, "Grand Railway Museum", None, "y")],
                                  "row_no int, museum_name string, priority_score int, notes string")
    ddl = ("id int, museum_name string, planner_priority_score int, planner_notes string, "
           "planner_data_updated_at timestamp, data_sources array<string>")
    rec = spark.createDataFrame(
        [(1, "Adas House", 5, None, None, None), (2, "The Grand Railway Museum", 1, "y", None, []),
         (3, "Nowhere", None, None, None, None)], ddl)
    rec = rec.unionByName(spark.createDataFrame([(4, "ADAS HOUSE", None, None, None, None)], ddl)
                          .withColumn("planner_data_updated_at", F.to_timestamp(F.lit("2026-02-01"))))
    at = F.to_timestamp(F.lit("2026-01-01"))
    out = phases.link_sheet(rec, sheet, "row_no", ["priority_score", "notes"], at,
                            F.to_timestamp(F.lit("2026-03-01")))
    got = {r.id: r for r in out.collect()}
    assert {k: r.outcome for k, r in got.items()} == {1: "updated", 2: "no_change", 3: "not_found",
                                                      4: "current"}
    assert got[1].changed_fields == ["planner_notes"] and got[1].planner_notes == "x"
    assert got[1].data_sources == ["museum_planner_spreadsheet"]
    assert got[2].planner_priority_score == 1 and got[2].planner_data_updated_at is None


def test_apply_identity(spark):
    rec = spark.createDataFrame(
        [(1, "Ohio", None, None), (2, "Lima", None, None), (3, "TBD", None, ["s"]), (4, "", None, None)],
        "id int, city string, address_source string, data_sources array<string>").withColumns(
        {c: F.lit(None).cast("string") for c in ("street_address", "postal_code", "place_id", "phone",
                                                 "address_last_verified")}
        | {c: F.lit(None).cast("double") for c in ("latitude", "longitude")})
    found = spark.createDataFrame(
        [(1, True, "Akron"), (2, True, "Wrong"), (3, False, "X")], "id int, success boolean, city string"
    ).withColumns({c: F.lit("v") for c in ("street_address", "postal_code", "place_id", "phone")}
                  | {c: F.lit(1.5) for c in ("latitude", "longitude")})
    got = {r.id: r for r in phases.apply_identity(rec, found, "id", F.lit("2026-01-01")).collect()}
    assert {k: (r.outcome, r.city) for k, r in got.items()} == {
        1: ("updated", "Akron"), 2: ("skipped", "Lima"), 3: ("failed", "TBD"), 4: ("failed", "")}
    assert got[1].data_sources == ["google_places_api"] and got[1].address_source == "google_places"
    assert got[1].latitude == 1.5 and got[3].latitude is None


def test_apply_scores(spark):
    cols = {c: F.lit(None).cast("int") for c in (
        "impressionist_strength", "modern_contemporary_strength", "historical_context_score",
        "eca_score", "collection_based_strength", "reputation", "confidence")}
    texts = {c: F.lit(None).cast("string") for c in ("score_notes", "scored_by", "primary_art_focus")}
    rec = spark.createDataFrame([(1, True), (2, False), (3, True), (4, True)],
                                "id int, is_scoreable boolean").withColumns(
        {**cols, **texts, "must_see_candidate": F.lit(None).cast("boolean")})
    rec = rec.withColumn("eca_score", F.when(F.col("id") == 3, 2))
    answers = spark.createDataFrame(
        [(i, 'ok {"impressionist_strength": 4, "modern_contemporary_strength": 4, '
             '"historical_context_score": 9, "confidence": 2, "score_notes": "n"}', "m") for i in (1, 2, 3)]
        + [(4, "sorry {not json}", "m")], "id int, response string, model string")
    got = {r.id: r for r in phases.apply_scores(rec, answers, "id", "response", "model").collect()}
    assert {k: r.outcome for k, r in got.items()} == {
        1: "scored", 2: "skipped_not_art", 3: "skipped_already_scored", 4: "failed"}
    one = got[1]
    assert (one.impressionist_strength, one.historical_context_score, one.eca_score, one.confidence,
            one.scored_by, one.primary_art_focus, one.must_see_candidate) == (
        4, 5, None, 2, "m", "Impressionist", True)
    assert got[2].impressionist_strength is None and got[3].eca_score == 2


def test_build_index(spark):
    rec = spark.createDataFrame(
        [(1, "Boston", "MA", "Art", 3, 3, 4, 1, 1, None, None), (2, "Boston", "MA", "History", None,
          None, None, 1, 1, 2, "Impressionist"), (3, "TBD", "MA", "Art", 1, None, None, 1, 1, None, None)],
        "museum_id int, city string, state_province string, primary_domain string, "
        "impressionist_strength int, modern_contemporary_strength int, historical_context_score int, "
        "reputation int, collection_tier int, city_tier int, primary_art string").withColumns(
        {"nearby_museum_count": F.lit(99), "scoring_version": F.lit(None).cast("string")})
    got = {r.museum_id: r for r in phases.build_index(rec, scores=True).collect()}
    assert [(got[i].nearby_museum_count, got[i].city_tier, got[i].primary_art, got[i].priority_score,
             got[i].is_scored, got[i].scoring_version) for i in (1, 2, 3)] == [
        (1, 1, "Modern/Contemporary", 15, True, "v1.0"), (1, 2, None, None, False, None),
        (0, None, "Impressionist", None, False, None)]


def test_whole_run_finds_new_records_once(spark, small, monkeypatch):
    calls, once = [], dedupe.greedy_dedupe
    monkeypatch.setattr(dedupe, "greedy_dedupe", lambda *a: calls.append(a) or once(*a))
    queries_run.whole_run(spark, small)
    assert len(calls) == 1
