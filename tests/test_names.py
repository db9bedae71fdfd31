"""Columns a caller already has under the names operators use in between."""

from pyspark.sql import functions as F

from rosterloom.operators import groups, order

NAMES = ("_lookup", "_key", "_salt", "_city", "_state", "_own", "_n", "_first", "_before", "_range", "_place")
DDL = "id bigint, city string, state string, " + ", ".join(f"{n} string" for n in NAMES)


def frame(spark):
    own = tuple(f"own {n}" for n in NAMES)
    return spark.createDataFrame([(i, f"c{i % 3}", "s", *own) for i in range(12)], DDL)


def same(df, extra):
    """All columns of the caller are there with their values, and one more."""
    rows = df.collect()
    assert set(df.columns) == {"id", "city", "state", *NAMES, extra}
    assert all(r[n] == f"own {n}" for r in rows for n in NAMES) and len(rows) == 12
    return sorted((r.id, r[extra]) for r in rows)


def test_lookup(spark):
    dim = spark.createDataFrame([("c0", 5), ("c1", 6)], "city string, v int")
    assert same(groups.lookup(frame(spark), dim, ["city"]), "v")[:3] == [(0, 5), (1, 6), (2, None)]


def test_group_stats(spark):
    assert same(groups.attach_group_stats(frame(spark), ["city"], {"k": ("count", None)}, "id"), "k")[0] == (0, 4)


def test_peers(spark):
    for mode in ("index", "phase"):
        got = same(groups.peers_in_city(frame(spark), "id", "city", "state", mode), "nearby_count")
        assert got == [(i, 3) for i in range(12)]


def test_duplicate_flags(spark):
    got = same(groups.flag_duplicates(frame(spark), {"k": F.col("city")}, "id"), "is_duplicate")
    assert got == [(i, i > 2) for i in range(12)]


def test_numbers(spark):
    assert same(order.numbered(frame(spark), [F.desc("id")], "no"), "no")[0] == (0, 11)
