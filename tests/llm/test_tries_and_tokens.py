"""Prefix tries, aligned tokens and languages against brute force and held-out labels."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterloom.llm import alignment, languages, trie

TURN = "conv_id bigint, turn bigint, role string, text string, id string, row int, place int, size int"


def turns(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], TURN)


def trie_by_hand(rows, group=5):
    conv = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            tie = hashlib.md5(f"{len(r)}:{r}{x}".encode()).hexdigest()
            conv[c].append((t is not None, t or 0, tie, r, x))
    said = {c: [v[3:] for v in sorted(vs, key=lambda v: v[:3])] for c, vs in conv.items()}
    rebuilt = {}
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = said.get(c - int(math.fmod(c, group)), [])[:h] + own[h:]
    members, kids, below = defaultdict(list), defaultdict(list), {}
    for c, s in rebuilt.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    for k in sorted(members, key=len, reverse=True):
        own = (len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0
        below[k] = (sum(below[x][0] for x in kids[k]) or 1, own + sum(below[x][1] for x in kids[k]))
    return sorted((min(ms), len(k), min(members[k[:-1]]) if k else -1000, len(ms), len(kids[k]), *below[k],
                   hashlib.sha256(",".join(str(c) for c in sorted(ms) if len(rebuilt[c]) == len(k))
                                  .encode()).hexdigest()) for k, ms in members.items())


def awkward_turns(seed):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(-30, 200), 70):
        for t in range(rnd.choice([1, 2, 5, 9, 20, 40])):
            said = rnd.choice(["x", "", "é", None, "long"]) if t < 12 or rnd.random() < .3 else "k"
            rows.append((c, rnd.choice([t, t, t, None]), rnd.choice(["u", "a", None]), said))
    rows += [(300 + c, t, "u", f"copy {t}") for c in range(40) for t in range(15)]
    return rows + [(None, 0, "u", "x")] * 2 + rows[:5]


def tree_of(spark, rows, **parameters):
    got = trie.prefix_nodes(*trie.rebuilt(turns(spark, rows).repartition(4)), **parameters)
    assert tuple(got.columns) == trie.OUT
    return sorted((r[0], r[1], -1000 if r[2] is None else r[2], *r[3:]) for r in got.collect())


@pytest.mark.parametrize("seed, width, cells", [(1, 64, 1 << 21), (2, 3, 300), (5, 2, 1 << 20)])
def test_trie_equals_brute_force(spark, seed, width, cells):
    # narrow blocks: several rounds and chains; few cells: nodes that go on over many shards
    rows = awkward_turns(seed)
    assert tree_of(spark, rows, width=width, widest=2 * width, cells=cells) == trie_by_hand(rows)


def test_trie_of_copies_in_many_shards(spark):
    rows = [(5 * c, t, "u", "same") for c in range(200) for t in range(3)]
    got = tree_of(spark, rows, cells=64)
    assert got == trie_by_hand(rows) and max(r[3] for r in got) == 200


def test_trie_of_nothing_and_of_conversations_without_turns(spark):
    assert tree_of(spark, []) == []
    assert tree_of(spark, [(None, 1, "u", "x")]) == []
    # no base, and as many own turns as are replaced: members of the root alone
    lone = [c for c in range(1, 60) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 1]
    rows = [(c, 0, "u", "x") for c in lone]
    assert tree_of(spark, rows) == trie_by_hand(rows) and len(tree_of(spark, rows)) == 1


def test_shard_cuts_do_not_matter(spark):
    rows = awkward_turns(9)
    whole = tree_of(spark, rows)
    assert whole == tree_of(spark, rows, cells=64) == tree_of(spark, rows, width=4, widest=4)


# token alignment ---------------------------------------------------------------------------------

PIECES = [" ", "  ", "\n", "\t", "a", "b", "é", "中", "▁", "<s>", "</s>", "<|endoftext|>", "<0x41>",
          "the", " of", "🙂", "\x00", "don't", "1234", "ﬁ", "!!!"]


@pytest.fixture(scope="module")
def slow():
    """Token ids and bytes straight from the two libraries."""
    import public_tokenizers as public
    import sentencepiece
    from tokenizers import Tokenizer, pre_tokenizers

    a = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    # the byte-level alphabet: printable bytes stand for themselves, the others follow in order
    own = [x for x in range(256) if 33 <= x <= 126 or 161 <= x <= 172 or x >= 174]
    of = {chr(x): x for x in own}
    of |= {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in own)}
    assert set(of) == set(pre_tokenizers.ByteLevel.alphabet())

    def encode(text):
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text, num_threads=1)
        return ([(i, bytes(of[c] for c in a.id_to_token(i))) for i in x],
                [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else
                  b.id_to_piece(i).replace("▁", " ").encode()) for i in y])
    return encode


def aligned_by_hand(texts, encode):
    docs = []
    for text in texts:
        x, y = encode(text) if text else ([], [])
        raw = (" " + (text or "")).encode()
        if b"".join(t for _, t in x) != raw or b"".join(t for _, t in y) != raw:
            docs.append(None)
            continue
        i = j = at_a = at_b = 0
        groups, links, left, right = [], [], [], []
        while i < len(x):
            links.append((x[i][0], y[j][0]))
            end_a, end_b = at_a + len(x[i][1]), at_b + len(y[j][1])
            if end_a <= end_b:
                left.append(x[i][0])
                at_a, i = end_a, i + 1
            if end_b <= end_a:
                right.append(y[j][0])
                at_b, j = end_b, j + 1
            if end_a == end_b:
                groups.append(",".join(map(str, left)) + "|" + ",".join(map(str, right)))
                left, right = [], []
        docs.append((len(x), len(y), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    n = Counter(link for d in docs if d for link in d[3])
    top = defaultdict(int)
    for (_, b), k in n.items():
        top[b] = max(top[b], k)
    return [(*d[:3], len(d[3]), sum(n[k] == top[k[1]] for k in d[3]), sum(n[k] for k in d[3]), d[4])
            if d else (0, 0, 0, 0, 0, 0, "") for d in docs]


@pytest.mark.parametrize("block", [8 << 20, 5000])
def test_alignment_equals_brute_force(spark, small, slow, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK", block)
    rnd = random.Random(3)
    texts = [None, "", " ", "   ", "a ", " a", "a  b ", "x" * 3000, " " * 500, "\n" * 300 + "a"]
    texts += ["".join(rnd.choices(PIECES, k=rnd.randint(1, 60))) for _ in range(200)]
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(60)
    texts += [r.text for r in docs.collect()] + ["same words again"] * 50
    rows = [(i if i % 7 else None, t, i, "c") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, block int, code string").repartition(5)
    got = sorted(tuple(r)[1:] for r in alignment.align(df).collect())
    assert got == sorted(aligned_by_hand(texts, slow))
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in alignment.align(df).collect())
    assert ids == sorted((r[0] is None, r[0] or 0) for r in rows)


def test_alignment_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert alignment.align(df).collect() == []
    df = spark.createDataFrame([(1, None), (1, "")], "doc_id bigint, text string")
    assert [tuple(r)[1:] for r in alignment.align(df).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_same_bytes_pairs_and_long_texts():
    v = alignment.public_vocabularies()
    for a in (0, 220, 257, 50255):
        b = v.same[a]
        assert b < 0 or v.a_bytes[a] == v.b_bytes[int(b)]
    assert (v.same >= 0).sum() > 10_000 and v.by_word
    text = "word, " * 200_000 + "q" * 100_000
    found = alignment.Aligned([text], v)
    assert v.a_size[found.a].sum() == v.b_size[found.b].sum() == len(text) + 1
    assert found.n_links[0] == len(found.link_a)


# languages ---------------------------------------------------------------------------------------

def path_by_hand(scores, switch):
    n, k = scores.shape
    value, back = scores[0].copy(), []
    for t in range(1, n):
        top = value.argmax()
        come = [(value[j], j) if value[j] >= value[top] - switch else (value[top] - switch, top)
                for j in range(k)]
        back.append([c[1] for c in come])
        value = np.array([c[0] for c in come]) + scores[t]
    label = [int(value.argmax())]
    for row in reversed(back):
        label.append(int(row[label[-1]]))
    return label[::-1]


def test_best_paths_equal_one_text_at_a_time():
    rng = np.random.default_rng(4)
    scores = rng.normal(size=(50, 4)) * 3
    lengths = np.array([0, 1, 7, 30, 0, 2, 30, 3, 0])
    word = rng.integers(0, 50, lengths.sum())
    got = languages.best_paths(scores, word, lengths, 2.5)
    at = 0
    for n in lengths:
        assert not n or got[at:at + n].tolist() == path_by_hand(scores[word[at:at + n]], 2.5)
        at += n
    assert languages.best_paths(scores, word[:0], np.zeros(3, int)).tolist() == []


def test_held_out_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = languages.predicted(docs, languages.train(docs)).join(
        docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.99 * len(held) > 200
    assert all(0 <= r.score <= 1 for r in rows)


SAID = {"en": "the house and the garden were where they had been with their friends",
        "de": "das haus und der garten waren nicht mehr dort wo sie einst gewesen sind",
        "ru": "дом и сад были там где они когда то жили"}
DOC = "doc_id bigint, text string, lang string, hash int, place string, held_out int, grams int"


def test_spans_scripts_and_odd_rows(spark):
    taught = [(i, SAID[lang], lang) for lang in SAID for i in range(40)]
    odd = [(1000, None, None), (1001, "", "en"), (1002, "1234 ½ !!", "de"), (1003, SAID["en"], None),
           (None, SAID["ru"], None), (1004, SAID["de"] + ". " + SAID["en"] + "! " + SAID["ru"], None),
           (1005, "中文", None), (1005, "中文", None), (1006, SAID["de"] + " the " + SAID["de"], None),
           (1007, (SAID["de"] + " ") * 3000 + "中" * 5000, None), (1008, "A1", None)]
    df = spark.createDataFrame([(*r, 0, "p", 1, 2) for r in taught + odd], DOC)
    model = languages.train(df)
    assert model.languages == ["de", "en", "ru"]
    got = {r.doc_id: r for r in languages.predicted(df, model).collect()}
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3
    assert [got[i].score for i in (1000, 1001, 1002)] == [0.0] * 3
    assert got[1003].lang_pred == "en" and got[None].lang_pred == "ru" and not got[None].held_out
    assert got[1006].lang_pred == "de" and got[1006].score == 1.0
    assert got[1007].lang_pred == "de"
    assert got[1005].lang_pred in model.languages and got[1008].lang_pred in model.languages
    parts = [(r.lang, r.start, r.end) for r in languages.spans(df, model).filter("doc_id = 1004")
             .orderBy("start").collect()]
    text = odd[5][1]
    assert [p[0] for p in parts] == ["de", "en", "ru"]
    assert [text[a:b] for _, a, b in parts] == [SAID["de"], SAID["en"], SAID["ru"]]
    assert languages.spans(df, model).filter("doc_id in (1000, 1001, 1002)").count() == 0


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "some words", None)], "doc_id bigint, text string, lang string")
    model = languages.train(df)
    assert [(r.lang_pred, r.score) for r in languages.predicted(df, model).collect()] == [("und", 0.0)]
    assert languages.spans(df, model).collect() == []
    empty = df.limit(0)
    assert languages.predicted(empty, languages.train(empty)).collect() == []


def test_languages_learn_a_bounded_sample(spark):
    rows = [(i, SAID["en"], "en") for i in range(300)] + [(i, SAID["de"], "de") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    one = languages.train(df, per_language=5)
    assert one.languages == ["de", "en"]
    assert np.allclose(one.scores, languages.train(df.repartition(7), per_language=5).scores)
    assert languages.train(df, languages=1).languages == ["en"]
    assert languages.predicted(df, one).filter(F.col("lang_pred") != F.when(
        F.col("doc_id") < 0, "x").otherwise("en")).count() == 20
