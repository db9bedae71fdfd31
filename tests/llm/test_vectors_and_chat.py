"""Operators on vectors and conversations against brute force and exact round trips."""

import hashlib
import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rosterloom.llm import chat, graph, tiles, topk

VEC = "vec_id bigint, embedding array<float>, label int, node string, c int, q int, width string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "n", 1, 2, "w") for r in rows], VEC)


def awkward_vectors(n=300, width=12, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=width).astype("f4").tolist(), int(rng.integers(0, 3))) for i in range(n)]
    rows += [(n + i, rows[i % 5][1], rows[i % 5][2]) for i in range(40)]  # copies
    near = [np.array(rows[7][1]) * s + 0.02 * rng.normal(size=width) for s in (1, 2, 0.5, 1, 3)]
    rows += [(n + 50 + i, v.astype("f4").tolist(), rows[7][2]) for i, v in enumerate(near)]
    rows += [(n + 100, None, 1), (n + 101, [None] * width, 1), (n + 102, [float("nan")] * width, 1),
             (n + 103, [float("inf")] + [0.0] * (width - 1), 1), (n + 104, [0.0] * width, 1),
             (n + 105, [], 1), (n + 106, [1.0, 2.0], 1), (n + 107, [2.0, 4.0], 1),
             (n + 108, rows[0][1], None), (None, rows[0][1], rows[0][2])]
    return rows


def good(v, zero=True):
    return v is not None and all(x is not None and np.isfinite(x) for x in v) and (
        zero or any(x != 0 for x in v))


@pytest.mark.parametrize("block", [8192, 50])
def test_top_k_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "CANDIDATES", block)
    monkeypatch.setattr(topk, "QUERIES", max(4, block // 10))
    # repeated rows and ids are rows of their own: queries, and candidates of each other
    rows = awkward_vectors()
    rows += rows[:3] + [(20, rows[5][1], 0), (20, rows[6][1], 1), (21, rows[20][1], 0)]
    df = vectors(spark, rows).repartition(3)
    got = topk.top_k(df, F.col("vec_id") % 10 == 0).collect()
    ints = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v, _ in rows if i is not None and good(v)]
    want = []
    for m, (q, a) in enumerate(ints):
        if q % 10 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for n, (i, b) in enumerate(ints)
                            if n != m and len(a) == len(b))[:5]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_top_k_keeps_candidates_of_repeated_ids(spark):
    df = vectors(spark, [(1, [0.5, 0.0], 0), (1, [0.9, 0.0], 0), (0, [1.0, 0.0], 0)])
    got = topk.top_k(df, F.col("vec_id") == 0).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 1, 58880), (0, 2, 1, 32768)]


def test_top_k_stops_early():
    rng = np.random.default_rng(0)
    v = rng.normal(size=(4000, 3)) * 100
    v = np.floor(v)
    lists = np.argsort(v, axis=0, kind="stable").T
    values = np.take_along_axis(v.T, lists, 1)
    met = []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            out = super().__getitem__(key)
            met.append(len(out))
            return np.asarray(out)

    for q in v[:20]:
        best = topk.threshold_top(lists, values, v.view(Counted), np.arange(4000), q, -1, 5)
        order = np.lexsort((np.arange(4000), -(v @ q)))[:5]
        assert best == order.tolist()
    assert sum(met) / 20 < 2000


def test_known_scores_end_a_walk_early():
    rng = np.random.default_rng(5)
    v = np.floor(rng.normal(size=(4000, 8)) * 100)
    lists = np.argsort(v, axis=0, kind="stable").T
    values = np.take_along_axis(v.T, lists, 1)
    ids = np.arange(4000)
    for q in v[:20]:
        best = np.sort(v @ q)[::-1]
        whole = topk.threshold_top(lists, values, v, ids, q, -1, 5)
        # nothing that reaches the known score is lost; beyond the best one nothing need be read
        assert topk.threshold_top(lists, values, v, ids, q, -1, 5, best[4]) == whole
        few = topk.threshold_top(lists, values, v, ids, q, -1, 5, best[0] + 1)
        assert len(few) <= 5


def brute_links(rows, least=0.98):
    usable = [(k, i, np.array(v, float), lab) for k, (i, v, lab) in enumerate(rows)
              if i is not None and lab is not None and good(v, zero=False)]
    links = {k: set() for k in range(len(rows))}
    for x, (k, _, a, la) in enumerate(usable):
        for m, _, b, lb in usable[x + 1:]:
            if la == lb and len(a) == len(b) and (a @ b) / np.sqrt((a @ a) * (b @ b)) >= least:
                links[k].add(m)
                links[m].add(k)
    out = []
    for k, (i, _, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for m in links[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        ids = [rows[m][0] for m in seen]
        out.append((i, len(links[k]), None if i is None else min(ids)))
    return out


def test_links_of_repeated_ids_are_counted_by_vector(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    near = [[1.0, 0.01, 0.0], [0.01, 1.0, 0.0], [0.0, 1.0, 0.01]]
    rows = [(5, a, 1), (5, b, 1), (7, near[0], 1), (8, near[1], 1), (9, near[2], 1)]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in tiles.near_vectors(vectors(spark, rows)).collect())
    assert got == [(5, 1, 5), (5, 2, 5), (7, 1, 5), (8, 2, 5), (9, 2, 5)]


@pytest.mark.parametrize("tile", [2048, 37])
def test_near_vectors_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(tiles, "TILE", tile)
    rows = awkward_vectors()
    rows += [(3, rows[9][1], rows[9][2]), (3, rows[10][1], rows[10][2]), (4, rows[4][1], rows[4][2])]
    got = tiles.near_vectors(vectors(spark, rows)).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=key) == sorted(
        brute_links(rows), key=key)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_near_vectors_bounds_never_lose_a_pair():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 64))
    v = np.vstack([base + s * rng.normal(size=base.shape) for s in (0, 0.1, 0.15, 0.2, 0.25)])
    axes = tiles.turns(list(v))[64]
    side = tiles.Turned(v, axes)
    got = {(int(i), int(j)) for a, b in tiles.linked(side, side, 0.98) for i, j in zip(a, b)}
    norm = np.sqrt((v * v).sum(1))
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(v @ v.T / np.outer(norm, norm) >= 0.98))}
    assert got ^ want <= {(i, j) for i, j in got ^ want if abs(v[i] @ v[j] / norm[i] / norm[j] - 0.98) < 1e-12}
    assert len(want) > len(v)


def test_empty_vectors(spark):
    empty = vectors(spark, [])
    assert topk.top_k(empty, F.col("vec_id") % 50 == 0).count() == 0
    assert tiles.near_vectors(empty).count() == 0


def test_components_of_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(100, 400)]
    star = [(1000, 1000 + i) for i in range(1, 500)]
    tail = [(1499, 50), (5, 5)]
    df = spark.createDataFrame(path + star + tail + star[:9], "a bigint, b bigint").repartition(9)
    got = {r.node: r.component for r in graph.components(df).collect()}
    want = {**{i: 100 for i in range(100, 401)}, **{i: 50 for i in range(1000, 1500)}, 50: 50}
    assert got == want
    assert graph.components(df.limit(0)).count() == 0


TEXT = st.lists(st.sampled_from([*"ab \\\n.n<>|[]/", "<s>", "</s>", "[INST]", "<|im_end|>", "<|im_start|>",
                                "<<SYS>>", "é", "\U0001F600"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "", "a\nb\\"]), TEXT), max_size=5))
def test_template_round_trip(turns):
    parts = [chat.formatted_turn(role, text) for role, text in turns]
    whole = "".join(p for p, _ in parts)
    assert chat.read_turns(whole) == turns
    assert whole.count(chat.START) == whole.count(chat.END) == len(turns)
    for control in chat.CONTROL[2:]:
        assert control not in whole
    at, loss = 0, []
    for part, span in parts:
        if span:
            loss.append(chat.unescape(whole[at + span[0]:at + span[1]]))
        at += len(part)
    assert loss == [t for r, t in turns if r == "assistant"]


def test_layouts_lead_to_the_same_turns(spark):
    records = [
        {"prompt": "p", "completion": "c"}, {"system": None, "prompt": "p", "response": "c"},
        {"question": "p", "answer": "c"}, {"instruction": "p", "input": None, "output": "c"},
        {"messages": [{"role": "user", "content": "p"}, {"role": "assistant", "content": "c"}]},
        {"conversations": [{"from": "human", "value": "p"}, {"from": "gpt", "value": "c"}]},
        {"turns": [{"role": "user", "text": "p"}, {"role": "assistant", "text": "c"}]},
    ]
    odd = [{"instruction": "p", "input": "i", "output": "c"}, {"system": "s", "prompt": "p", "completion": "c"},
           {"unknown": 1}, {}, None, []]
    rows = [(i, json.dumps(r), "x") for i, r in enumerate(records + odd)] + [(99, None, "x"), (98, "{", "x")]
    df = spark.createDataFrame(rows, "rid bigint, body string, layout string")
    got = {r.rid: r for r in chat.format_records(df, "rid", "body").collect()}
    pair = [("user", "p"), ("assistant", "c")]
    for i in range(len(records)):
        assert got[i].layout and chat.read_turns(got[i].formatted) == pair
        assert [got[i].formatted[s.start:s.end] for s in got[i].loss] == ["c"]
    n = len(records)
    assert chat.read_turns(got[n].formatted) == [("user", "p\n\ni"), ("assistant", "c")]
    assert chat.read_turns(got[n + 1].formatted) == [("system", "s"), *pair]
    for i in (n + 2, n + 3, n + 4, n + 5, 98, 99):
        assert got[i].layout is None and got[i].formatted == "" and got[i].loss == []
    keys = [k for layout in chat.LAYOUTS for k in layout.fingerprints()]
    assert len(keys) == len(set(keys))


def test_rows_read_back(spark):
    long = "long \\ text </s> " * 20_000
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (2, 5, "assistant", "b\n"), (2, 3, None, "a"),
            (None, 0, "user", "n"), (3, 0, None, None), (4, 1, "assistant", long), (4, 1, "assistant", long),
            (4, 2, "assistant", "")]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows],
                               "conv_id bigint, turn bigint, role string, text string, loss string, record int")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turn_rows(df)).collect()}
    assert len(got) == 5
    for conv, r in got.items():
        turns = [(role or "", text or "") for c, _, role, text in
                 sorted((x for x in rows if x[0] == conv), key=lambda x: x[1])]
        said = "".join(f"{role}\n{text}\n" for role, text in turns)
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(turns), len(loss))
        assert r.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.formatted_chars == sum(len(chat.formatted_turn(*t)[0]) for t in turns)
    assert chat.read_back(chat.format_turn_rows(df.limit(0))).count() == 0


@pytest.mark.parametrize("record, layout, turns", [
    ({"id": 7, "prompt": "a", "completion": "b"}, "prompt", [("user", "a"), ("assistant", "b")]),
    ({"prompt": "a", "completion": None}, "prompt", [("user", "a"), ("assistant", "")]),
    ({"prompt": "a", "response": "b", "completion": None}, "response", [("user", "a"), ("assistant", "b")]),
    ({"messages": [{"role": "human", "content": "x", "name": "n"}, {"role": "assistant", "content": None}],
      "source": {"url": "u"}}, "messages", [("user", "x"), ("assistant", "")]),
    ({"instruction": "do", "input": None, "output": "it", "score": 1.5}, "instruction",
     [("user", "do"), ("assistant", "it")]),
    ({"question": None, "answer": None}, "question", [("user", ""), ("assistant", "")]),
    ({"prompt": "a"}, None, []), ({"url": "u"}, None, []), ([1], None, []), (None, None, [])])
def test_layouts_go_by_the_fields_they_name(record, layout, turns):
    assert chat.canonical(record, chat.Registry(chat.LAYOUTS)) == (layout, turns)


def test_empty_tables_format_to_nothing(spark):
    rows = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    formatted = chat.format_turn_rows(rows)
    assert formatted.count() == 0 and chat.read_back(formatted).count() == 0
    records = spark.createDataFrame([], "rid bigint, body string")
    assert chat.format_records(records, "rid", "body").count() == 0
