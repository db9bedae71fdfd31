"""Indexes, buckets, variants, counted writes and incremental runs against plain computation."""

import random
import re

import pytest
from pyspark.sql import functions as F

from rosterloom.functions import variants
from rosterloom.operators import browse, page_index, runs, text_index
from rosterloom.sources import buckets
from rosterloom.streaming import incremental

WORDS = ["Mus\u00e9e", "art", "ART", "\u4e2d\u56fd", "caf\u00e9", "x", "of", "zoo", "the", "a b", "\U0001F600 ok", "100%_"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_text_index_equals_a_scan(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.choices(WORDS, k=rnd.randint(0, 5))), rnd.choice([None, "", "Town", "zo"]))
            for i in range(300)]
    df = spark.createDataFrame(rows, "k bigint, name string, city string")
    text_index.write_text_index(df, "k", ["name", "city"], str(tmp_path / "ix"))
    texts = {i: " | ".join(x for x in (n, c) if x).lower() for i, n, c in rows}
    for needle in ("mus\u00e9e", " ART ", "\u4e2d\u56fd", "\u56fd c", "o", "zo", "", "zoo |", "no such", "\U0001F600 ok", "0%_",
                   "e caf\u00e9 x"):
        got = sorted(r.id for r in text_index.search_index(spark, str(tmp_path / "ix"), needle).collect())
        assert got == sorted(i for i, t in texts.items() if needle.strip().lower() in t), needle
    found = text_index.search_index(spark, str(tmp_path / "ix"), "mus\u00e9e")
    # postings of the rarest grams' folders only
    postings = next(line for line in plan_of(found).splitlines() if "FileScan" in line and "gram#" in line)
    assert re.search(r"PartitionFilters: \[[^]]*folder#\d+", postings)
    text_index.write_text_index(df.limit(0), "k", ["name"], str(tmp_path / "none"))
    for needle in ("x", "mus\u00e9e"):
        assert text_index.search_index(spark, str(tmp_path / "none"), needle).count() == 0


def test_any_page_equals_an_offset_and_reads_its_ranges(spark, tmp_path):
    rnd = random.Random(2)
    df = spark.createDataFrame([(i, rnd.choice([None, 1, 2, 3]), f"n{rnd.randint(0, 40)}") for i in range(997)],
                               "id bigint, score int, name string")
    order = browse.sort_order("score", "name", "id", True, -1)
    path = str(tmp_path / "pages")
    page_index.write_page_index(df, order, ["name"], path, ranges=10)
    want = [r.id for r in df.orderBy(*order).collect()]
    for page in (0, 1, 7, 30, 49, 50, 1000):
        rows = page_index.read_page(spark, path, order, page, 20)
        assert [r.id for r in rows.collect()] == want[page * 20:(page + 1) * 20]
    # the page's own ranges are read: one, or two if it lies across a border
    scan = next(line for line in plan_of(page_index.read_page(spark, path, order, 30, 20)).splitlines()
                if "FileScan" in line)
    named = re.search(r"PartitionFilters: \[([^\]]*)\]", scan).group(1)
    assert 1 <= len(re.findall(r"(?<!#)\b\d+\b", named)) <= 2, named
    assert page_index.pages(spark, path, 20).first() == (997, 50)
    page_index.write_page_index(df.limit(0), order, ["name"], str(tmp_path / "none"))
    assert page_index.pages(spark, str(tmp_path / "none"), 20).first() == (0, 1)
    assert page_index.read_page(spark, str(tmp_path / "none"), order, 0, 20).count() == 0


def test_bucketed_joins_do_not_shuffle(spark, tmp_path):
    rows = spark.range(500).withColumnRenamed("id", "k").withColumn("v", F.col("k") % 7)
    some = rows.filter("k % 3 = 0").unionByName(rows.filter("k % 6 = 0"))
    a = buckets.write_buckets(rows, "bucket_test_a", "k", 8, str(tmp_path / "a"))
    b = buckets.write_buckets(some, "bucket_test_b", "k", 8, str(tmp_path / "b"))
    flags = buckets.flags_from_buckets(a, "k", {"b": b}, {"v": F.col("v") == 1})
    got = {r.k: (r.has_b, r.has_v, r.has_nothing) for r in flags.collect()}
    assert got == {k: (k % 3 == 0, k % 7 == 1, k % 3 != 0 and k % 7 != 1) for k in range(500)}
    assert "Exchange" not in plan_of(flags) and "SortMergeJoin" in plan_of(flags)
    for name in ("bucket_test_a", "bucket_test_b"):
        spark.sql(f"DROP TABLE {name}")


@pytest.mark.parametrize("said, kind, text", [
    ('{"p": [null, "x"]}', "string", "x"), ('{"p": 3}', "number", "3"), ('{"p": [{"value": 4}]}', "object", "4"),
    ('{"p": [[1, 2]]}', "list", "1"), ('{"p": []}', None, None), ('{"q": 1}', None, None), ("{", None, None),
    ('{"p": [null]}', None, None), (None, None, None)])
def test_claims_of_any_type(spark, said, kind, text):
    df = spark.createDataFrame([(said,)], "c string")
    value = variants.first_claim(F.try_parse_json("c"), "p")
    row = df.select(value.alias("v")).select(
        variants.claim_kind(F.col("v")).alias("kind"), variants.claim_text(F.col("v")).alias("text")).first()
    assert (row.kind, row.text) == (kind, text)


def test_counters_of_a_write_are_those_of_a_scan(spark, tmp_path):
    df = spark.range(100).select("id", F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("outcome"))
    for name, rows in (("all", df), ("none", df.limit(0))):
        got = runs.write_counted(rows, str(tmp_path / name), "outcome", ["a", "b", "c"], "p", "r",
                                 F.lit("2026-01-01").cast("timestamp_ntz")).first()
        n = rows.count()
        assert (got.total_processed, got.a, got.b, got.c) == (n, 34 if n else 0, 66 if n else 0, 0)
        assert spark.read.parquet(str(tmp_path / name)).count() == n


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    schema, seen = "id bigint, modified string", []

    def phase(new, current):
        seen.append(current.count())
        if len(seen) == 2:
            # the run is lost after its files are listed
            raise RuntimeError("lost")
        return incremental.stale(new, current, "id", "modified")

    def run():
        return incremental.run_arrived(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"),
                                       str(tmp_path / "check"), phase, schema, "id")

    def arrive(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    arrive((1, "a"), (2, "a"), (4, None))
    assert run() == 1
    arrive((1, "b"), (2, "a"), (3, "a"), (4, "a"))
    with pytest.raises(Exception, match="lost"):
        run()
    # the same batch once more, then nothing new
    assert run() == 1 and run() == 0
    rows = incremental.versions(spark, str(tmp_path / "out"), schema).collect()
    assert sorted((r.id, r.modified or "", r.batch) for r in rows) == [
        (1, "a", 0), (1, "b", 1), (2, "a", 0), (3, "a", 1), (4, "", 0), (4, "a", 1)]
    newest = incremental.newest(spark, str(tmp_path / "out"), schema, "id").collect()
    assert sorted((r.id, r.modified, r.batch) for r in newest) == [(1, "b", 1), (2, "a", 0), (3, "a", 1), (4, "a", 1)]


def test_entries_expire(spark):
    df = spark.createDataFrame([("2026-01-01 00:00:00",), ("2025-12-31 23:00:00",), (None,)], "t string")
    now = F.lit("2026-01-01 00:30:00")
    assert [r[0] for r in df.select(incremental.expired(F.col("t"), 3600, now)).collect()] == [False, True, True]


@pytest.mark.parametrize("top", [10_000, 10])
def test_rank_bands_equal_a_sort(spark, monkeypatch, top):
    monkeypatch.setattr(browse, "TOP_ROWS", top)
    rnd = random.Random(4)
    rows = [(i, rnd.choice([None, 1, 2]), f"n{rnd.randint(0, 9)}", "mine") for i in range(200)]
    df = spark.createDataFrame(rows, "id bigint, p int, name string, _rank string").repartition(3)
    got = browse.rank_bands(df, "id", browse.priority_order("p", "name", "id")).collect()
    order = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[2], r[0]))
    want = {r[0]: "GOLD" if i < 50 else "SILVER" if i < 100 else "BRONZE" for i, r in enumerate(order)}
    assert {r.id: r.band for r in got} == want and all(r["_rank"] == "mine" for r in got)
