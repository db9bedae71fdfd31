"""Joins against brute force, on hot keys too."""

import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from rosterloom.functions import vocab
from rosterloom.operators import components, dedupe, groups, linkage, name_tiles, order, quality
from rosterloom.plans.queries_linkage import sheet_containment_match

ROLES = {"block": "block", "state": "state", "name": "name", "city": "city", "url": "url"}
DDL = "row_no bigint, block string, state string, name string, city string, url string"


def roster_rows(n, seed, hot=0.0):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        url = rnd.choice(["", f"http://h{rnd.randint(0, n // 3)}.org/", f"HTTP://h{rnd.randint(0, n // 3)}.org"])
        name = f"Name {rnd.randint(0, n // 4)}"
        city = rnd.choice(["", "Unknown", f"C{rnd.randint(0, 3)}", f"c{rnd.randint(0, 3)}"])
        if rnd.random() < hot:
            url, name = "http://hot.org", f"Name {i}"
        rows.append((i, "ZZ", "S", name, city, url))
    return rows


def norm(url):
    return re.sub(r"\s+", "", url).replace("://%20", "://").rstrip("/").lower()


def matches(kept, row):
    if norm(kept[5]) and norm(kept[5]) == norm(row[5]):
        return True
    if kept[2].lower() != row[2].lower() or kept[3].lower() != row[3].lower():
        return False
    return not row[4] or (kept[4] or "Unknown").lower() == row[4].lower()


def greedy(rows):
    kept = []
    for row in rows:
        if not any(k[1] == row[1] and matches(k, row) for k in kept):
            kept.append(row)
    return [k[0] for k in kept]


@pytest.mark.parametrize("hot", [0.0, 0.4])
def test_greedy_dedupe(spark, hot):
    rows = roster_rows(600, 7, hot)
    df = spark.createDataFrame(rows, DDL).repartition(5)
    got = dedupe.greedy_dedupe(df, ROLES, "row_no")
    assert sorted(r.row_no for r in got.collect()) == greedy(rows)


def test_greedy_dedupe_follows_long_chains(spark):
    # every row shares its URL with the one before and its name with the one after
    rows = [(i, "B", "S", f"n{(i + 1) // 2}", "", f"http://u{i // 2}") for i in range(40)]
    df = spark.createDataFrame(rows, DDL)
    got = dedupe.greedy_dedupe(df, ROLES, "row_no")
    assert sorted(r.row_no for r in got.collect()) == greedy(rows)


@pytest.mark.parametrize("block_rows", [100_000, 40])
def test_greedy_dedupe_in_blocks(spark, block_rows):
    # interleaved chains, a hot key, and rows at random, in blocks that cut through all of them
    rows = roster_rows(300, 5, 0.2)
    rows += [(1000 + 7 * i + k, "B", "S", f"n{k}-{(i + 1) // 2}", "", f"http://u{k}-{i // 2}")
             for k in range(7) for i in range(60)]
    df = spark.createDataFrame(rows, DDL).repartition(5)
    got = dedupe.greedy_dedupe(df, ROLES, "row_no", block_rows)
    assert sorted(r.row_no for r in got.collect()) == greedy(sorted(rows))


def test_rounds_do_not_follow_the_length_of_a_chain(spark, monkeypatch):
    rows = [(i, "B", "S", f"n{(i + 1) // 2}", "", f"http://u{i // 2}") for i in range(10_000)]
    written = []
    real = dedupe.cut_lineage
    monkeypatch.setattr(dedupe, "cut_lineage", lambda df, name: written.append(name) or real(df, name))
    got = dedupe.greedy_dedupe(spark.createDataFrame(rows, DDL), ROLES, "row_no")
    # each row conflicts with the next one only: every other row stays
    assert sorted(r.row_no for r in got.collect()) == list(range(0, 10_000, 2))
    assert len(written) <= 5


def test_connected_components_through_keys(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice([None, "", f"a{rnd.randint(0, 250)}"]), rnd.choice([None, f"b{rnd.randint(0, 250)}"]))
            for i in range(400)]
    rows += [(1000 + i, f"chain{i // 2}", f"chain-{(i + 1) // 2}") for i in range(130)]
    rows += [(5000 + i, "hot", None) for i in range(300)] + [(None, "hot", "b1")]
    df = spark.createDataFrame(rows, "id bigint, x string, y string").repartition(6)
    links = components.key_links(df, "id", [F.concat(F.lit("x:"), "x"), F.concat(F.lit("y:"), "y")])
    got = {r.node: r.component for r in components.connected_components(links).collect()}
    root = {i: i for i, _, _ in rows if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    first = {}
    for i, *keys in sorted(r for r in rows if r[0] is not None):
        for k in enumerate(keys):
            # the kind goes in front: an empty key is a key here, a null one is none
            if k[1] is not None:
                a, b = find(first.setdefault(k, i)), find(i)
                root[max(a, b)] = min(a, b)
    assert all(got.get(i, i) == find(i) for i in root)


def test_dedupe_of_the_deduped_changes_nothing(spark):
    df = spark.createDataFrame(roster_rows(300, 3, 0.3), DDL)
    once = dedupe.greedy_dedupe(df, ROLES, "row_no")
    again = dedupe.greedy_dedupe(once, ROLES, "row_no")
    assert sorted(once.collect()) == sorted(again.collect())


def test_unmatched_roster(spark):
    rows, known = roster_rows(400, 1, 0.3), roster_rows(150, 2, 0.3)
    known = [(i, b, s.upper(), n.upper(), c or "Unknown", u) for i, b, s, n, c, u in known]
    got = linkage.unmatched_roster(spark.createDataFrame(rows, DDL),
                                   spark.createDataFrame(known, DDL), ROLES, ROLES)
    want = [r[0] for r in rows if not any(matches(k, r) for k in known)]
    assert sorted(r.row_no for r in got.collect()) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "Cartesian" not in plan


def random_name(rnd, words):
    name = " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 4)))
    chars = list(name)
    for _ in range(rnd.randint(0, 3)):
        if chars:
            chars[rnd.randrange(len(chars))] = rnd.choice("abcxyzé ")
    return "".join(chars)


def test_fuzzy_match_equals_all_pairs(spark):
    rnd = random.Random(11)
    words = ["art", "house", "lincoln", "county", "historical", "railway", "sea", "modern", "a", "of"]
    left = [(i, rnd.choice("XY"), random_name(rnd, words)) for i in range(150)]
    right = [(i, rnd.choice("XY"), random_name(rnd, words)) for i in range(150)]

    def key(s):
        s = re.sub(r"\b(" + "|".join(vocab.NAME_STOP_WORDS) + r")\b", "", s.lower())
        return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", "", s)).strip()

    def best(row):
        if not row[2]:
            return None, None
        pool = [r for r in right if r[1] == row[1] and r[2].strip()]
        for r in pool:
            if r[2].strip().lower() == row[2].lower():
                return r[0], 1.0
        top = max(pool, key=lambda r: (SequenceMatcher(None, key(row[2]), key(r[2])).ratio(), -r[0]))
        ratio = SequenceMatcher(None, key(row[2]), key(top[2])).ratio()
        return (top[0], ratio) if ratio >= 0.7 else (None, None)

    out = linkage.fuzzy_match(spark.createDataFrame(left, "id int, st string, n string"),
                              spark.createDataFrame(right, "row_no int, st string, t string"),
                              "st", "n", "t", "row_no", ["row_no"])
    got = {r.id: (r.match_row_no, r.match_score) for r in out.collect()}
    want = {row[0]: best(row) for row in left}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert sum(v[0] is not None for v in want.values()) > 40
    assert all(got[k][1] == pytest.approx(want[k][1]) for k in want if want[k][1])


def test_fuzzy_candidates_lose_no_pair_at_other_thresholds(spark):
    rnd = random.Random(5)
    names = sorted({random_name(rnd, ["abc", "abd", "xyz", "mm"]) for _ in range(80)})
    df = spark.createDataFrame([("B", n, i) for i, n in enumerate(names)], "blk string, k string, o int")
    for t in (0.67, 0.7, 0.9):
        rows = linkage.fuzzy_candidates(df, df, "blk", "k", "o", t).collect()
        got = {(r.a, r.b) for r in rows}
        assert len(got) == len(rows)  # each pair once
        need = {(x, y) for x in names for y in names if x and y
                and SequenceMatcher(None, x, y).ratio() >= t and min(len(x), len(y)) > 1}
        assert need <= got


def test_containment_equals_all_pairs(spark):
    rnd = random.Random(3)
    base = ["".join(rnd.choice("abc ") for _ in range(30)).strip() for _ in range(40)]
    left = sorted({re.sub(r"\s+", " ", b[rnd.randint(0, 6):]).strip() for b in base})
    right = sorted({re.sub(r"\s+", " ", b[rnd.randint(0, 12):rnd.randint(18, 30)]).strip() for b in base})
    rnd.shuffle(right)
    out = linkage.containment_match(
        spark.createDataFrame([(n,) for n in left], "k string"),
        spark.createDataFrame([(n, i) for i, n in enumerate(right)], "k string, seen int"), "k", "seen")
    want = {}
    for n in left:
        hit = [r for r in right if len(n) > 10 and len(r) > 10 and (r in n or n in r)]
        if hit:
            want[n] = hit[0]
    assert {r.k: r.partner for r in out.collect()} == want and len(want) > 10


def test_edit_distance_equals_all_pairs(spark):
    rnd = random.Random(9)
    names = sorted({"".join(rnd.choice("ab") for _ in range(rnd.randint(0, 7))) for _ in range(60)})
    left, right = names[::2], names[1::2]

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, prev = [i] + row[1:], row
            for j, y in enumerate(b, 1):
                row[j] = min(prev[j] + 1, row[j - 1] + 1, prev[j - 1] + (x != y))
        return row[-1]

    out = linkage.edit_distance_match(
        spark.createDataFrame([("c", n) for n in left], "c string, n string"),
        spark.createDataFrame([("c", n) for n in right], "c string, n string"), "c", "n")
    want = {}
    for a in left:
        d, b = min((lev(a, b), b) for b in right)
        if d <= 2:
            want[a] = (b, d)
    assert {r.n: (r.partner, r.distance) for r in out.collect()} == want


def test_proximity_equals_all_pairs(spark):
    import math
    rnd = random.Random(4)
    left = [(min(90.0, rnd.choice([0.0, 45.0, -70.0, 89.9995]) + rnd.uniform(-0.002, 0.002)),
             rnd.choice([0.0, 179.9995, -179.9995, 12.0]) + rnd.uniform(-0.0004, 0.0004))
            for _ in range(120)]
    right = [(i, min(90.0, a + rnd.uniform(-0.0008, 0.0008)), b + rnd.uniform(-0.0008, 0.0008))
             for i, (a, b) in enumerate(left)]
    right = [(i, a, b - 360 if b > 180 else b + 360 if b < -180 else b) for i, a, b in right]

    def metres(a, b):
        p, q = math.radians(a[0]), math.radians(b[0])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(
            math.radians(b[1] - a[1]) / 2) ** 2
        return 2 * linkage.EARTH_METRES * math.asin(min(1, math.sqrt(h)))

    out = linkage.proximity_match(
        spark.createDataFrame(left, "lat double, lon double"),
        spark.createDataFrame(right, "id int, lat double, lon double"), "lat", "lon", "id")
    rows = out.collect()
    assert len(rows) == len(left)  # every row is kept, equal points too
    got = {(r.lat, r.lon): r.partner for r in rows if r.partner is not None}
    want = {}
    for p in left:
        d, i = min((metres(p, r[1:]), r[0]) for r in right)
        if d <= 100:
            want[p] = i
    assert got == want and len(want) > 60


def test_hot_key_statistics_stay_spread(spark):
    # one key holds 90 % of the rows
    df = spark.range(20_000).select("id", F.when(F.col("id") % 10 < 9, "hot").otherwise(
        F.concat(F.lit("k"), (F.col("id") % 700).cast("string"))).alias("k"))
    out = groups.attach_group_stats(df, ["k"], {"n": ("count", None), "first": ("min", "id")}, "id")
    plan = out._jdf.queryExecution().executedPlan().toString()
    want = {r.k: (r.n, r.f) for r in df.groupBy("k").agg(
        F.count("*").alias("n"), F.min("id").alias("f")).collect()}
    rows = out.collect()
    assert len(rows) == 20_000 and all((r.n, r["first"]) == want[r.k] for r in rows)
    # the only window runs over the salted partials
    assert plan.count("Window ") == 1 and "_salt" in plan


def test_examples_are_limited_before_the_shuffle(spark):
    df = spark.range(5000).select("id", F.lit("x").alias("name"))
    out = quality.missing_examples(df, "id", F.array(F.lit("a"), F.lit("b")), ["name"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert sorted((r.field, r.id) for r in out.collect()) == [
        (f, i) for f in ("a", "b") for i in range(10)]


def test_shared_keys_return_members_not_lists(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, "same").otherwise(
        F.col("id").cast("string")).alias("site"))
    out = quality.shared_key_duplicates(df, "id", {"site": F.col("site")}).collect()
    assert len(out) == 334 and {r.n for r in out} == {334}


def test_hot_keys_of_a_lookup_are_split_at_run_time(spark):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
                "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1000"}
    old = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        rows = spark.range(0, 60_000, 1, 8).select(
            "id", F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("n"))
        ext = rows.select(F.col("id").alias("row_no"), F.col("n").alias("t"))
        out = linkage.exact_match(rows, ext, {"_n": F.lower("n")}, {"_n": F.lower("t")}, "row_no",
                                  ["row_no"])
        got = out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan
        assert len(got) == 60_000 and all(r.row_no == (1 if r.n == "hot" else r.id) for r in got)
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_rows_of_a_salted_key_are_shuffled_by_key_and_salt(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        df = spark.range(1000).select("id", F.concat(F.lit("k"), (F.col("id") % 2).cast("string")).alias("k"))
        out = groups.attach_group_stats(df, ["k"], {"n": ("count", None)}, "id")
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    shuffles = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    # rows, partials and totals go by (key, salt); only the partials of a key meet by key alone
    assert len([x for x in shuffles if "_salt#" in x]) == 3 and len(shuffles) == 4


def test_containment_pairs_of_a_hot_partner_stay_spread(spark, monkeypatch):
    # a third of the records contain one short sheet name
    left = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, F.concat(
        F.lit("harbour light museum hall "), F.col("id").cast("string"))).otherwise(F.concat(
            F.lit("other place number "), F.col("id").cast("string"))).alias("name"))
    sheet = spark.createDataFrame([(1, "harbour light", 5), (2, "somewhere else", 6)],
                                  "row_no int, title string, score int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = linkage.sheet_match(left, "name", sheet, "title", "row_no", ["score"])
        plan = out._jdf.queryExecution().executedPlan().toString()
        rows = out.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(r.match_type == "partial" and r.sheet_score == 5 for r in rows) == 2000
    assert sum(r.match_type is None for r in rows) == 4000
    assert "SinglePartition" not in plan


def test_edit_distance_takes_the_closest_and_the_smaller_name(spark):
    rnd = random.Random(4)
    names = {"".join(rnd.choices("abcd", k=rnd.randint(0, 7))) for _ in range(120)}
    left = [(b, n) for n in sorted(names) for b in "xy" if rnd.random() < 0.5]
    right = [(b, n) for n in sorted(names) for b in "xy" if rnd.random() < 0.4]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    ddl = "b string, n string"
    got = linkage.edit_distance_match(spark.createDataFrame(left, ddl), spark.createDataFrame(right, ddl),
                                      "b", "n").collect()
    want = set()
    for b, n in left:
        d, m = min(((distance(n, o), o) for c, o in right if c == b), default=(9, ""))
        if d <= 2:
            want.add((b, n, m, d))
    assert {tuple(r) for r in got} == want


def test_fuzzy_signatures_make_fewer_rows_than_all_pairs(spark, small):
    # names with real variety: the first words of documents
    names = spark.read.parquet(f"{small}/documents.parquet").select(
        F.lit("x").alias("b"), F.substring("text", 1, 24).alias("n"), F.col("doc_id").alias("no")).filter(
        "length(trim(n)) > 10").dropDuplicates(["n"])
    n = names.count()
    found = linkage.fuzzy_candidates(names.filter("no % 2 = 0").select("b", "n"),
                                     names.filter("no % 2 = 1"), "b", "n", "no", 0.7)
    plan = found._jdf.queryExecution()
    found.collect()
    assert n > 100 and "SortMergeJoin" in plan.executedPlan().toString()
    halves = names.filter("no % 2 = 0").count() * names.filter("no % 2 = 1").count()
    assert found.count() < halves / 10


def test_numbered_is_the_global_order(spark):
    df = spark.range(0, 3000).selectExpr("(id * 7919) % 3000 AS v", "id % 2 AS place").repartition(7)
    got = order.numbered(df, ["v"], "no").collect()
    assert all(r.v == r.no for r in got) and len(got) == 3000
    assert order.numbered(df.limit(0), ["v"], "no").count() == 0


def test_sheet_match_broadcasts_no_names(spark):
    # small files of names are large once their grams are exploded; a broadcast holds them in the driver
    left = spark.range(2000).select("id", F.concat(F.lit("records "), F.lpad(
        F.col("id").cast("string"), 9, "0")).alias("name"))
    sheet = spark.range(0, 2000, 7).select(F.col("id").alias("row_no"), F.concat(F.lit("grand records "), F.lpad(
        F.col("id").cast("string"), 9, "0")).alias("title"), F.col("id").alias("score"))
    out = linkage.sheet_match(left, "name", sheet, "title", "row_no", ["score"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    assert {r.id: r.sheet_score for r in out.filter("match_type = 'partial'").collect()} == {
        i: i for i in range(0, 2000, 7)}


def test_sheet_containment_query_holds_no_table_in_the_driver(spark, small):
    # the plan as it ran: adaptive execution broadcasts whatever small side it is free to
    df = sheet_containment_match(spark, small.replace("sf0.001", "sf0.01"))
    assert len(df.collect()) == 100
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan and "Broadcast" not in plan


def test_name_tiles_keep_one_partner_a_name_and_tile(spark):
    # numbers after one word: nearly all pairs are similar enough, so pairs must not become rows
    rnd = random.Random(9)
    left = [(b, f"customer{rnd.randrange(10 ** 6):09d}" + "x" * rnd.choice([0, 0, 90])) for b in "PQ" for _ in range(60)]
    right = [(b, f"customer{rnd.randrange(10 ** 6):09d}" + "x" * rnd.choice([0, 0, 90]), i)
             for b in "PQ" for i in rnd.sample(range(500), 90)]
    a = spark.createDataFrame(left, "_block string, name string").dropDuplicates()
    b = spark.createDataFrame(right, "_block string, name string, seen bigint").dropDuplicates(["_block", "name"])
    right = [tuple(r) for r in b.collect()]
    every = name_tiles.tile_pairs(a, b, 0.7, False, 25, 40).count()
    rows = name_tiles.tile_pairs(a, b, 0.7, True, 25, 40).collect()
    # 90 names make three tiles
    assert every > 2000 and len(rows) <= 3 * a.count()
    got = {}
    for r in rows:
        got[r._block, r.a] = min(got.get((r._block, r.a), (0, 0, "")), (-r.score, r.seen, r.b))
    want = {}
    for block, name in map(tuple, a.collect()):
        least = min((-SequenceMatcher(None, name, o).ratio(), i, o) for c, o, i in right if c == block)
        if -least[0] >= 0.7:
            want[block, name] = least
    assert got == want and len(want) > 100


def test_right_names_are_copied_for_few_left_tiles(spark, monkeypatch):
    # copies of the right names were as many as the left names had tiles: both grow with the block
    dealt, deal = {}, name_tiles._dealt

    def kept(*a):
        dealt[a[4]] = deal(*a)
        return dealt[a[4]]

    monkeypatch.setattr(name_tiles, "_dealt", kept)
    rnd = random.Random(4)
    words = ["harbour", "light", "museum", "of", "north", "art", "old", "town"]

    def names(n):
        return sorted({" ".join(rnd.sample(words, 3)) + f" {rnd.randrange(90)}" for _ in range(n)})

    left = [("P", n) for n in names(300)] + [("Q", n) for n in names(9)]
    right = [(b, n, i) for b in "PQ" for i, n in enumerate(names(80))]
    a = spark.createDataFrame(left, "_block string, name string")
    b = spark.createDataFrame(right, "_block string, name string, seen bigint")
    rows = name_tiles.tile_pairs(a, b, 0.7, True, 4, 30).collect()
    copies = dealt["_bs"].groupBy("_pair._block").agg(F.sum(F.size("_bs")).alias("n")).collect()
    own = {block: sum(c == block for c, _, _ in right) for block in "PQ"}
    most = {"P": 16, "Q": 3}
    assert all(r.n <= most[r._block] * own[r._block] for r in copies) and len(copies) == 2
    assert len(left) > 250 and all(r.n > own[r._block] for r in copies)
    got = {}
    for r in rows:
        got[r._block, r.a] = min(got.get((r._block, r.a), (0, 0, "")), (-r.score, r.seen, r.b))
    want = {}
    for block, name in left:
        least = min((-SequenceMatcher(None, name, o).ratio(), i, o) for c, o, i in right if c == block)
        if -least[0] >= 0.7:
            want[block, name] = least
    assert got == want and len(want) > 100


def test_close_to_one_only_long_names_are_compared(spark, monkeypatch):
    compared, tiled = [], name_tiles._tiled_pairs
    monkeypatch.setattr(name_tiles, "_tiled_pairs", lambda left, *a: compared.append(left) or tiled(left, *a))
    names = [f"customer{i:09d}" for i in range(40)] + ["y" * 210 + str(i) for i in range(3)] + ["x" * 300 + "yz" * 200]
    # the last names are long enough for a partner that lacks a character
    left = [(b, n) for b in ("P", "Q", None) for n in names] + [("P", "z" * 600 + "a")]
    right = [(b, n, i) for b in ("P", None) for i, n in enumerate(names[::2] + ["z" * 600, "y" * 210 + "1"])]
    a = spark.createDataFrame(left, "_block string, name string")
    b = spark.createDataFrame(right, "_block string, name string, seen bigint").dropDuplicates(["_block", "name"])
    right = [tuple(r) for r in b.collect()]
    got = sorted((r._block, r.a, r.b, r.seen, r.score) for r in name_tiles.tile_pairs(a, b, 0.999, True).collect())
    best = [max(((SequenceMatcher(None, n, o).ratio(), -i, o) for c, o, i in right if c == block), default=(0, 0, ""))
            for block, n in left if block]
    want = sorted((block, n, o, -i, score) for (block, n), (score, i, o) in zip(
        [x for x in left if x[0]], best) if score >= 0.999)
    assert got == want and len(want) > 20
    # what is compared name by name
    assert len(compared) == 1 and {r.name for r in compared[0].collect()} == {
        n for _, n in left if len(n) >= 0.999 / 0.002 - 1e-6}


def test_greedy_dedupe_computes_its_roster_once(spark, tmp_path):
    rows = roster_rows(60, 3)
    spark.createDataFrame(rows, DDL).write.parquet(str(tmp_path / "roster"))
    roster = spark.read.parquet(str(tmp_path / "roster")).withColumn("_r", F.lit("kept"))
    out = dedupe.greedy_dedupe(roster, ROLES, "row_no")
    # the rows come back from what the rounds have written, not from the input once more
    assert not any(str(tmp_path) in f for f in out.inputFiles())
    assert out.columns == roster.columns and {r._r for r in out.collect()} == {"kept"}
    assert sorted(r.row_no for r in out.collect()) == greedy(rows)
