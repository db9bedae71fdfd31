"""Properties of whole phases: rerunning changes nothing, knowledge never shrinks."""

from pyspark.sql import functions as F

from rosterloom.functions import text
from rosterloom.functions.scoring import ScoreColumns
from rosterloom.operators import browse, merge, quality
from rosterloom.plans import phases
from rosterloom.plans.bindings import art, cust
from rosterloom.plans.queries_merge import patched

S = ScoreColumns("imp", "mod", "hist", "rep", "tier", "nearby", "eca", "cbs")


def start(spark, small):
    return art(spark, small).withColumns({
        "time_needed": F.lit(None).cast("string"), "nearby_count": F.lit(None).cast("bigint"),
        "city_tier": F.lit(None).cast("int"), "priority_score": F.lit(None).cast("int"),
        "overall_quality_score": F.lit(None).cast("int"), "primary_art": F.lit(None).cast("string"),
        "scoring_version": F.lit(None).cast("string")})


def steps():
    return [
        ("backbone", lambda d: phases.backbone(d, "id", "city", "state", "kind", "name")),
        ("score", lambda d: phases.score_records(d, S, "is_scoreable", "v2")),
    ]


def test_run_is_idempotent(spark, small):
    once = phases.run_phases(start(spark, small), steps())
    twice = phases.run_phases(once, steps())
    cols = ["id", "city_tier", "time_needed", "nearby_count", "kind", "is_scoreable",
            "priority_score", "overall_quality_score", "primary_art", "scoring_version"]
    assert sorted(map(str, once.select(cols).collect())) == sorted(map(str, twice.select(cols).collect()))
    assert twice.filter(F.size("updated_fields") > 0).count() == 0
    assert twice.filter("outcome = 'scored'").count() == 0
    assert once.filter("outcome = 'scored'").count() > 0


def test_phases_can_be_skipped(spark, small):
    out = phases.run_phases(start(spark, small), steps(), skip=["score"])
    assert "outcome" not in out.columns


def test_non_art_is_never_scored(spark, small):
    out = phases.run_phases(start(spark, small), steps())
    assert out.filter("NOT is_scoreable AND priority_score IS NOT NULL").count() == 0


def test_known_fields_never_become_fewer(spark, small):
    df = patched(spark, small)
    known = lambda d: d.filter(~text.is_missing("raw_city", "fill")).count()
    for fn in (merge.fill_missing, merge.never_null_known):
        assert known(fn(df, {"raw_city": "new_city"})) >= known(df)
        once = fn(df, {"raw_city": "new_city"}).select("id", "raw_city", "new_city")
        again = fn(once, {"raw_city": "new_city"}).select("id", "raw_city", "new_city")
        assert sorted(map(str, once.collect())) == sorted(map(str, again.collect()))


def test_unchanged_patch_changes_nothing(spark, small):
    c = cust(spark, small)
    out = merge.change_only(c, {"city": "city", "balance": "balance"})
    assert out.filter(F.size("changed_fields") > 0).count() == 0


def test_guard_raises_on_the_first_issue(spark, small):
    df = art(spark, small).withColumn("visit", F.lit("3 days"))
    issues = quality.art_guard_issues(df, "id", "domain", "visit", "scoreable", ["imp"])
    try:
        quality.fail_on_issues(issues)
    except ValueError as e:
        assert "visit_length" in str(e)
    else:
        raise AssertionError("no error")
    quality.fail_on_issues(issues.filter("issue = 'none'"))


def test_pages_by_their_last_row_are_the_pages_by_offset(spark):
    df = spark.createDataFrame([(i, f"n{i % 5}", (i * 7) % 4 or None) for i in range(60)],
                               "id int, name string, v int")
    for down in (False, True):
        order = browse.sort_order("v", "name", "id", down, 9)
        whole = [r.id for r in df.orderBy(*order).collect()]
        got, last = [], None
        while True:
            where = None if last is None else browse.after_row("v", "name", "id", last, down, 9)
            rows = browse.BrowseQuery(order=order, where=where, limit=13).page(df).collect()
            if not rows:
                break
            got += [r.id for r in rows]
            last = (rows[-1].v, rows[-1].name, rows[-1].id)
        assert got == whole
