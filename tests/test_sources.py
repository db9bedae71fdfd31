"""Readers and writers on files, good and bad."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from rosterloom import session
from rosterloom.operators import runs
from rosterloom.sources import csv_records, readers, writers

RECORD = "museum_id STRING, museum_name STRING, topics ARRAY<STRING>, latitude DOUBLE"


@pytest.fixture()
def states(tmp_path):
    for code in ("AL", "AK"):
        doc = {"state": code, "state_code": code, "last_updated": "2026-01-01", "museums": [
            {"museum_id": f"{code}-{i}", "museum_name": "A\nB", "topics": ["x"], "extra": 1}
            for i in range(3)]}
        (tmp_path / f"{code}.json").write_text(json.dumps(doc, indent=2))
    return tmp_path


def test_containers(spark, states):
    df = readers.read_containers(spark, str(states / "*.json"), RECORD)
    rows = df.collect()
    assert len(rows) == 6 and {r.state_code for r in rows} == {"AL", "AK"}
    assert rows[0].topics == ["x"] and rows[0].latitude is None


def test_malformed_container_aborts_or_is_skipped(spark, states):
    (states / "ZZ.json").write_text('{"state": "ZZ", "museums": [')
    with pytest.raises(Exception):
        readers.read_containers(spark, str(states / "*.json"), RECORD).collect()
    df = readers.read_containers(spark, str(states / "*.json"), RECORD, skip_bad=True)
    assert sorted({r.state_code for r in df.collect()}) == ["AK", "AL"] and df.count() == 6
    bad = [r.file for r in readers.bad_containers(spark, str(states / "*.json")).collect()]
    assert len(bad) == 1 and bad[0].endswith("ZZ.json")


def test_roster(spark, tmp_path):
    good = tmp_path / "good.csv"
    good.write_text('STATE,NAME,CITY,URL\nOhio," The ""A"" ",,http://a.org\n')
    row = readers.read_roster(spark, str(good)).first()
    assert tuple(row) == (1, "Ohio", 'The "A"', "", "http://a.org")
    bad = tmp_path / "bad.csv"
    bad.write_text("STATE,NAME,CITY,URL\nOhio,A,,http://a.org\nOhio,B,,nowhere\n")
    with pytest.raises(Exception, match="invalid roster row"):
        readers.read_roster(spark, str(bad)).collect()
    assert readers.read_roster(spark, str(bad), strict=False).count() == 2
    # whichever columns are read
    for job in (lambda df: df.count(), lambda df: df.select("NAME").collect(),
                lambda df: df.select("row_no").collect()):
        with pytest.raises(Exception, match="invalid roster row"):
            job(readers.read_roster(spark, str(bad)))
    short = tmp_path / "short.csv"
    short.write_text("STATE,NAME\nOhio,A\n")
    with pytest.raises(ValueError, match="missing headers"):
        readers.read_roster(spark, str(short))


def test_caches_take_their_key_from_the_path(spark, tmp_path):
    for key in ("usa-ak-a", "usa-ak-b"):
        folder = tmp_path / "AK" / key / "cache"
        folder.mkdir(parents=True)
        (folder / "wikipedia.json").write_text(json.dumps({"found": True, "extract": key}, indent=1))
        (folder / "other.json").write_text("{}")
    df = readers.read_caches(spark, str(tmp_path), "found BOOLEAN, extract STRING", "wikipedia.json")
    assert sorted((r.museum_id, r.extract) for r in df.collect()) == [
        ("usa-ak-a", "usa-ak-a"), ("usa-ak-b", "usa-ak-b")]


def test_key_map(spark, tmp_path):
    (tmp_path / "map.json").write_text('{\n "m_1": "a",\n "m_2": "b"\n}')
    rows = readers.read_key_map(spark, str(tmp_path / "map.json"), "folder_hash", "museum_id").collect()
    assert sorted(map(tuple, rows)) == [("m_1", "a"), ("m_2", "b")]


def test_csv_quotes_only_what_needs_it(spark, tmp_path):
    df = spark.createDataFrame([('a"b', "x,y", "plain")], "p string, q string, r string")
    writers.write_csv(df.coalesce(1), str(tmp_path / "out"))
    part = next((tmp_path / "out").glob("*.csv")).read_text()
    assert part.splitlines() == ["p,q,r", '"a""b","x,y",plain']


def test_only_changed_partitions_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "old", "A", True), (2, "old", "A", False), (3, "old", "B", False)],
                               "id int, updated_at string, code string, changed boolean")
    df.drop("changed").write.partitionBy("code").parquet(path)
    before = {p.name for p in (tmp_path / "t" / "code=B").iterdir()}
    writers.write_changed(df, path, "code", "changed", "updated_at", F.lit("new"))
    assert {p.name for p in (tmp_path / "t" / "code=B").iterdir()} == before
    rows = spark.read.parquet(path).select("id", "updated_at").collect()
    assert sorted(map(tuple, rows)) == [(1, "new"), (2, "old"), (3, "old")]


class _Named:
    """A session whose configuration names (or does not name) the shared folder."""

    def __init__(self, folder, master):
        self.conf = self
        self.folder, self.sparkContext = folder, type("C", (), {"master": master,
                                                                "applicationId": "app-x"})

    def get(self, key, default):
        assert key == "spark.checkpoint.dir"
        return self.folder or default


def test_shared_folder_comes_from_the_session(spark):
    path = session.scratch_path(_Named("s3a://bucket/dir/", "yarn"), "x")
    assert path.startswith("s3a://bucket/dir/rosterloom-") and "/x-" in path
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(_Named(None, "yarn"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(_Named(None, "local-cluster[2,1,512]"))
    assert session.shared_dir(_Named(None, "local[2]")) == session.shared_dir(_Named(None, "local[2]"))
    assert session.cut_lineage(spark.range(5), "x").count() == 5


def test_csv_files_have_their_own_column_order_and_one_count_of_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text('STATE,NAME,CITY,URL\nOhio,"Two\nlines",,http://a.org\n\nIowa,B,x,http://b.org\n')
    (tmp_path / "b.csv").write_text("NAME,URL,STATE,CITY\nZoo,http://c.org,Texas,y\n")
    (tmp_path / "c.csv").write_text("NAME,URL,STATE,CITY\n")
    got = readers.read_roster(spark, str(tmp_path)).orderBy("row_no").collect()
    assert [tuple(r) for r in got] == [
        (1, "Ohio", "Two\nlines", "", "http://a.org"), (2, "Iowa", "B", "x", "http://b.org"),
        (3, "Texas", "Zoo", "y", "http://c.org")]
    ext = readers.read_external(spark, str(tmp_path), "STATE").orderBy("row_no").collect()
    assert ext[0].NAME == "Two\nlines" and [r.STATE for r in ext] == ["Ohio", "Iowa", "Texas"]
    (tmp_path / "d.csv").write_text("NAME,URL,STATE,TOWN\nZoo,http://c.org,Texas,y\n")
    with pytest.raises(ValueError, match="missing headers"):
        readers.read_roster(spark, str(tmp_path))
    with pytest.raises(ValueError, match="differ from"):
        readers.read_external(spark, str(tmp_path), "STATE")


def test_split_files_never_lose_a_broken_record(spark, tmp_path):
    lines = "".join(f"{i},Ohio\n" for i in range(40_000))
    (tmp_path / "a.csv").write_text("id,state\n" + lines)
    (tmp_path / "b.csv").write_text("state,id\nIowa,x\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        df = readers.read_external(spark, str(tmp_path), "state", multi_line=False)
        got = {r.row_no: r.id for r in df.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {**{i + 1: str(i) for i in range(40_000)}, 40_001: "x"}
    (tmp_path / "c.csv").write_text('id,state\n1,"a\nb"\n')
    with pytest.raises(Exception, match="broken record"):
        readers.read_external(spark, str(tmp_path), "state", multi_line=False).count()


def test_empty_tables_still_have_a_time(spark):
    none = spark.createDataFrame([], "id int, region string, outcome string")
    head = writers.envelope(none, F.lit("2026-01-01").cast("timestamp_ntz")).first()
    assert tuple(head) == ("2026-01-01T00:00:00Z", 0)
    row = runs.run_summary(none, "outcome", ["failed"], "region", "p", "r1",
                           F.lit("2026-01-01").cast("timestamp_ntz")).first()
    assert (row.run_id, row.total_processed, row.completed_at) == ("r1", 0, "2026-01-01T00:00:00Z")


def test_scratch_is_cleared_by_its_owner(spark):
    kept = session.cut_lineage(spark.range(5).toDF("id"), "mine")
    assert kept.count() == 5
    path = kept.inputFiles()[0].removeprefix("file://")
    session.clear_scratch(spark)
    assert not os.path.exists(path)


def csv_text(rnd, rows, end):
    """A CSV file with quoted line breaks, quotes, commas, empty lines and quotes in plain fields."""
    fields = ["plain", "", '5" pipe', '"a, b"', '"two{0}lines"', '"{0}"', '"say ""x""{0}and ""y"""', '"q"', '""',
              '"{0}{0}deep{0}"', "caf\u00e9", '"""{0}"""']
    out = ["id,STATE,NAME,CITY,URL"]
    for i in range(rows):
        out.append(",".join([str(i), *(rnd.choice(fields).format(end) for _ in range(4))]))
        if rnd.random() < .05:
            out.append("")
    return end.join(out) + rnd.choice(["", end])


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_quoted_breaks_are_read_from_many_splits(spark, tmp_path, end):
    rnd = random.Random(3)
    for name in ("a", "b"):
        (tmp_path / f"{name}.csv").write_bytes(csv_text(rnd, 400, end).encode())
    plain = spark.read.options(header=True, escape='"', multiLine=True)
    want = []
    for name in ("a", "b"):
        # the one-task reader; its rows are in the file's order
        got = plain.csv(str(tmp_path / f"{name}.csv")).collect()
        assert [int(r.id) for r in got] == list(range(400))
        want += [[x or "" for x in r] for r in got]
    default = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "701")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
        raw, names = readers._csv_rows(spark, str(tmp_path), ["STATE"], True, "row_no")
        rows = sorted(raw.select("row_no", "_cells").collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", default)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    assert names == ["id", "STATE", "NAME", "CITY", "URL"]
    assert [r.row_no for r in rows] == list(range(1, 801))
    assert [[x or "" for x in r._cells] for r in rows] == want


def test_open_quotes_and_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('STATE,x\nOhio,"never closed\n' + "more\n" * 50)
    with pytest.raises(ValueError, match="is a quote open"):
        csv_records.read_records(spark, str(tmp_path / "a.csv"), most_lines=20)
    got = readers.read_external(spark, str(tmp_path / "a.csv"), "STATE").collect()
    assert [(r.row_no, r.STATE) for r in got] == [(1, "Ohio")] and got[0].x.startswith("never closed\nmore")
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "b.csv").write_text('"STATE\n",x\n')
    assert readers.read_external(spark, str(tmp_path / "b"), "STATE").count() == 0
    for line, opened, want in (('a,"b', False, True), ('b"', True, False), ('x""y', True, True), ('a"b', False, False),
                               ('"",""', False, False), ('",a,"', True, True), ('"""', False, True), ('"', True, False)):
        assert csv_records.open_after(line, opened) == want, line


def test_records_find_their_header_without_a_shuffle(spark, tmp_path):
    (tmp_path / "a.csv").write_text('STATE,NAME,CITY,URL\nOhio,"A\nB",c,u\n')
    (tmp_path / "b.csv").write_text("URL,CITY,NAME,STATE\nv,d,E,Utah\n")
    rows = readers.read_roster(spark, str(tmp_path), strict=False)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert sorted(map(tuple, rows.collect())) == [(1, "Ohio", "A\nB", "c", "u"), (2, "Utah", "E", "d", "v")]
