"""Every query of the subpackage on the smallest tables: SQL where there is any, whole results else."""

import duckdb
import pytest

import corpus_pipeline
from rosterloom.llm import mixing, packing, ranking, secrets, superminhash
from rosterloom.llm.queries import ORACLES, QUERIES
from tools.check import TABLES, rows_of

from .test_documents import base_by_hand, groups, shingle_set


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, small, name):
    df = QUERIES[name](spark, small)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    got, columns = rows_of(df.columns, df.collect())
    assert got
    if name in ORACLES:
        cur = duck.execute(ORACLES[name])
        want, expected = rows_of([c[0] for c in cur.description], cur.fetchall())
        assert columns == expected and got == want
    else:
        docs = duck.execute("select count(*), count(distinct doc_id) from documents").fetchone()
        ids = {r[columns.index("doc_id")] for r in got}
        assert len(ids) == docs[1] and (len(got) == docs[0] or name.startswith("op8"))


def test_stages_keep_and_drop_what_they_should(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    ranker = ranking.train(docs, spark.read.parquet(f"{small}/labels.parquet"))
    good = {r.doc_id for r in ranking.quality_scores(docs, ranker).filter("predicted = 1").collect()}
    first = steps["quality"](spark, docs, small)
    assert {r.doc_id for r in first.collect()} == good and first.columns == docs.columns

    rows = sorted(first.collect(), key=lambda r: r.doc_id)
    label = groups([shingle_set(r.text, 5) for r in rows])
    second = steps["near_duplicates"](spark, first, small)
    assert {r.doc_id for r in second.collect()} == {rows[i].doc_id for i in set(label)}
    assert second.columns == docs.columns

    third = steps["secret_scan"](spark, second, small)
    before = {r.doc_id: r.text for r in second.collect()}
    after = {r.doc_id: r.text for r in third.collect()}
    assert before.keys() == after.keys() and third.columns == docs.columns
    limits = secrets._limits(secrets._found(second, "doc_id", "text"), secrets.RATE)
    assert after == {k: secrets.masked(t, limits, "[secret]") for k, t in before.items()}
    for k, text in before.items():
        assert bool(base_by_hand(text)) <= (after[k] != text)
        assert not [s for s in base_by_hand(after[k]) if s.startswith(("hex", "access"))]

    fourth = steps["mix"](spark, third, small)
    plan = mixing.mixture(third, mixing.words_in("text"), mixing.letters_share("text")).collect()
    assert fourth.count() == sum(r.copies for r in plan) and fourth.columns == docs.columns

    fifth = steps["pack"](spark, fourth, small)
    whole = packing.packed(fourth).collect()
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in fifth.collect()) == sorted(
        (r.doc_id, r.piece, r.ids_crc32) for r in whole)


def test_pipeline_is_its_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = corpus_pipeline.run(spark, small).collect()
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, got)) == sorted(map(key, docs.collect()))


def test_near_duplicates_of_the_table_equal_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = sorted(docs.select("doc_id", "text").collect())
    sets = [shingle_set(r.text, 5) for r in rows]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in superminhash.near_duplicates(docs).collect()}
    assert got == {r.doc_id: (len(s), rows[g].doc_id) for r, s, g in zip(rows, sets, groups(sets))}
