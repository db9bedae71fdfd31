"""Operators on documents against brute force, on awkward rows and on the given tables."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import public_tokenizers
from rosterloom.llm import lm, mixing, packing, ranking, secrets, superminhash, toxicity
from rosterloom.llm.common import table

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# names the operators use inside, to be carried along unharmed
CLASH = ", node string, bands int, component string, `key` int, `range` string, _group int, label int"
MORE = ("x", 1, "y", 2, "z", 3, 4)
LONG = " ".join(f"w{i}" for i in range(30_000))


def rows_of(texts, clash=True):
    more = MORE if clash else ()
    return [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or ""), *more)
            for i, t in enumerate(texts)]


def frame(spark, rows, clash=True):
    return spark.createDataFrame(rows, DOC + CLASH * clash)


AWKWARD = [None, "", "   \n\t", "one", "one", "ONE", "two words", "two  words", "Two words x",
           "a b c d e f g h i j", "a b c d e f g h i j k", "b c d e f g h i j k", LONG, LONG + " end",
           "x " * 500, "x " * 400, "Été été", "été été", "a b c", "a\x1cb c",
           "\U0001F600 \U0001F600 ok"]


def shingle_set(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    n = min(n, len(words))
    return frozenset(tuple(words[i:i + n]) for i in range(len(words) - n + 1))


def groups(sets):
    """Smallest index each index reaches over links of similarity 0.8."""
    label = list(range(len(sets)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, j in itertools.combinations(range(len(sets)), 2):
        if sets[i] and sets[j]:
            common = len(sets[i] & sets[j])
            if 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(i) for i in range(len(sets))]


def near_copies(seed=3, base=40, copies=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 5)))
    texts = []
    for _ in range(4):
        origin = [word() for _ in range(base)]
        for _ in range(copies):
            copy = list(origin)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(base)] = word()
            texts.append(" ".join(copy))
    # a chain: each a little further from the first
    link = [word() for _ in range(60)]
    for i in range(25):
        link[(i * 7) % 60] = word()
        texts.append(" ".join(link))
    return texts


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates_equal_brute_force(spark, n):
    texts = AWKWARD + near_copies()
    sets = [shingle_set(t, n) for t in texts]
    want = {i: (len(s), g) for i, (s, g) in enumerate(zip(sets, groups(sets)))}
    got = superminhash.near_duplicates(frame(spark, rows_of(texts)).repartition(5), n=n).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert len(got) == len(texts) and all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_repeated_and_null_ids(spark):
    rows = [(1, "a b c", "en", "s", 1), (1, "a b c", "en", "s", 1), (None, "a b c", "en", "s", 1),
            (None, None, "en", "s", 1), (0, "a b c", "en", "s", 1)]
    got = superminhash.near_duplicates(frame(spark, rows, False), n=2).collect()
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id is not None) == [
        (0, 0), (1, 0), (1, 0)]
    assert sum(r.doc_id is None for r in got) == 2
    left = superminhash.deduplicated(frame(spark, rows, False))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in left.collect()) == [
        (False, 0), (True, 0), (True, 0)]
    assert left.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_different_texts_of_one_id_are_decided_by_themselves(spark):
    near = " ".join(f"w{i}" for i in range(60))
    rows = [(3, "a b c d e f"), (5, "a b c d e f"), (5, "g h i j k l"), (5, "g h i j k l"),
            (7, near), (8, near + " x"), (8, "m n o p q r"), (9, None), (9, None), (9, " ")]
    docs = frame(spark, [(i, t, "en", "s", 1) for i, t in rows], False)
    for parts in (1, 4):
        left = superminhash.deduplicated(docs.repartition(parts)).collect()
        assert sorted((r.doc_id, r.text or "") for r in left) == [
            (3, "a b c d e f"), (5, "g h i j k l"), (7, near), (8, "m n o p q r"), (9, ""), (9, " ")]


def test_signature_is_the_sequential_one_and_estimates_similarity():
    slots = 24
    sets = [np.unique(np.random.default_rng(i).integers(0, 2 ** 63, size, dtype=np.uint64))
            for i, size in enumerate((1, 2, 5, 40, 900))]
    got = superminhash.signatures(sets, slots)
    gold = int(superminhash._GOLDEN)
    for row, s in zip(got, sets):
        want = [2 ** 64 - 1] * slots
        for e in superminhash.mix64(s + superminhash._GOLDEN):
            perm = list(range(slots))
            for j in range(slots):
                draw = int(superminhash.mix64(np.array(
                    [(int(e) + (j + 1) * gold) % 2 ** 64], np.uint64))[0])
                k = j + ((draw & 0xFFFFFF) * (slots - j) >> 24)
                perm[j], perm[k] = perm[k], perm[j]
                want[perm[j]] = min(want[perm[j]], j << 40 | draw >> 24)
        assert row.tolist() == want
    rng = np.random.default_rng(5)
    pool = np.unique(rng.integers(0, 2 ** 63, 300, dtype=np.uint64))
    errors = []
    for _ in range(60):
        pool = np.unique(rng.integers(0, 2 ** 63, 300, dtype=np.uint64))
        a, b = superminhash.signatures([pool[:200], pool[50:250]], 256)
        errors.append((a == b).mean() - 150 / 250)
    # below the error of independent minima
    assert np.sqrt(np.mean(np.square(errors))) < np.sqrt(0.6 * 0.4 / 256)


def test_empty_tables(spark):
    empty = frame(spark, [], False)
    assert superminhash.near_duplicates(empty).count() == 0
    assert mixing.mixture(empty, mixing.words_in("text"), mixing.letters_share("text")).count() == 0
    assert mixing.mixed(empty).count() == 0
    assert packing.packed(empty).count() == 0
    assert secrets.secret_spans(empty).count() == 0
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert ranking.quality_scores(empty, ranking.train(empty, labels)).count() == 0
    assert toxicity.severity(empty, toxicity.train(empty, labels)).count() == 0
    assert lm.cross_entropy_difference(empty, labels.select("doc_id")).count() == 0


def brute_mixture(rows, weights=(5, 2, 1), most=3):
    """rows: (row, id, source, size, key)."""
    sources = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    size = {s: sum(r[3] for r in rows if r[2] == s) for s in sources}
    target, full, total = {}, set(), sum(size.values())
    while True:
        rest = total - sum(most * size[s] for s in full)
        open_ = sum(weight[s] for s in sources if s not in full)
        target = {s: most * size[s] if s in full else rest * weight[s] / open_ for s in sources}
        above = {s for s in sources if s not in full and target[s] > most * size[s]}
        if not above:
            break
        full |= above
    out = {}
    for s in sources:
        epochs = int(target[s] // size[s]) if size[s] else 0
        rest, before = target[s] - epochs * size[s], 0
        for row, _, _, n, _ in sorted((r for r in rows if r[2] == s), key=lambda r: (r[4], r[1])):
            out[row] = (n, size[s], target[s], n * (epochs + (before + n / 2 < rest)))
            before += n
    return out


def test_mixture_equals_brute_force(spark):
    texts = AWKWARD + near_copies(copies=10)
    docs = frame(spark, rows_of(texts)).repartition(4)
    got = mixing.mixture(docs, mixing.words_in("text"), mixing.letters_share("text")).collect()

    def key(i, text):
        u = (int(hashlib.md5(f"11:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 16 ** 13
        letters = sum(c.isalpha() or c in " \t\n\x0b\f\r" for c in text or "") / max(1, len(text or ""))
        return -np.log(u) / max(letters, 1e-6)

    rows = [(r[0], r[0], r[3], len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")), key(r[0], r[1]))
            for r in rows_of(texts)]
    want = brute_mixture(rows)
    assert {r.doc_id: (r.size, r.source_size, pytest.approx(r.target), r.taken) for r in got} == want
    assert all(r.taken <= 3 * r.size for r in got)


def test_mix_takes_documents_as_often_as_planned(spark):
    docs = frame(spark, rows_of(AWKWARD))
    plan = {r.doc_id: r.copies for r in mixing.mixture(
        docs, mixing.words_in("text"), mixing.letters_share("text")).collect()}
    mix = mixing.mixed(docs)
    assert mix.columns == docs.columns
    count = {}
    for r in mix.collect():
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
    assert count == {k: v for k, v in plan.items() if v}
    # null and repeated ids, a null source, a null text
    odd = frame(spark, [(None, "a b", "en", "s", 3), (None, "c d", "en", None, 3), (5, None, "en", "s", 0),
                        (6, "e f g", "en", "s", 5), (6, "e f g", "en", "s", 5)], False)
    rows = mixing.mixture(odd, mixing.words_in("text"), mixing.letters_share("text")).collect()
    assert sorted(r.size for r in rows) == [0, 2, 2, 3, 3]
    assert all(r.taken <= 3 * r.size and r.target <= 3 * r.source_size for r in rows)
    assert mixing.mixed(odd).columns == odd.columns


def test_mixed_rows_without_ids_are_taken_by_their_own_plan(spark):
    rows = [(None, f"a{i} b c d", "en", s, 1) for s, n in (("a", 1), ("b", 30), ("c", 300)) for i in range(n)]
    docs = frame(spark, rows, False).repartition(5)
    plan = mixing.mixture(docs, mixing.words_in("text"), mixing.letters_share("text")).collect()
    want, got = Counter(), Counter(r.source for r in mixing.mixed(docs).collect())
    for r in plan:
        want[r.source] += r.copies
    assert got == want and len({r.copies for r in plan}) > 1


def test_losses_equal_counting_by_hand(spark):
    texts = [None, "", "a", "abcabd", "abc abc", "zzz", "é\U0001F600a", "abcabd"]
    docs = frame(spark, rows_of(texts))
    good = spark.createDataFrame([(3,), (4,), (3,), (None,)], "doc_id bigint")
    got = {r.doc_id: r for r in lm.cross_entropy_difference(docs, good).collect()}

    def count(chosen):
        grams = {}
        for t in chosen:
            padded = "\0" * lm.ORDER + (t or "")
            for i in range(lm.ORDER, len(padded)):
                for k in range(1, lm.ORDER + 1):
                    g = (k, padded[i - k + 1:i + 1])
                    grams[g] = grams.get(g, 0) + 1
        return grams

    vocabulary = len({c for t in texts for c in t or ""})
    for name, chosen in (("target_loss", [3, 4]), ("background_loss", range(len(texts)))):
        for i, t in enumerate(texts):
            # a text is never among those that score it
            grams = count([texts[j] for j in chosen if j != i])
            whole = sum(n for (k, _), n in grams.items() if k == 1)
            padded, loss = "\0" * lm.ORDER + (t or ""), 0.0
            for at in range(lm.ORDER, len(padded)):
                p, context = 1 / vocabulary, whole
                for k in range(1, lm.ORDER + 1):
                    own = grams.get((k, padded[at - k + 1:at + 1]), 0)
                    if context:
                        p = lm.TRUST * min(own / context, 1) + (1 - lm.TRUST) * p
                    context = grams.get((k, padded[at - k:at]), 0) if k < lm.ORDER else 0
                loss -= np.log(p)
            assert got[i][name] == pytest.approx(loss / max(len(t or ""), 1), rel=1e-5), (name, i)
    assert got[0].score == 0 and got[1].n_chars == 0


def test_losses_do_not_share_counts_over_many_scripts(spark):
    # far more different n-grams an order than any fixed table would keep apart
    rng = np.random.default_rng(5)
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x9FA0, 1500))) for _ in range(400)]
    texts += [texts[0][:400], "".join(map(chr, rng.integers(0xAC00, 0xD7A0, 300)))]
    docs = frame(spark, rows_of(texts, False), False)
    good = spark.createDataFrame([(i,) for i in range(0, 400, 4)], "doc_id bigint")
    assert lm.train(docs, good).filter("n = 4").count() > 1 << 19
    got = {r.doc_id: r for r in lm.cross_entropy_difference(docs, good).collect()}
    assert len(got) == len(texts)

    def count(chosen):
        grams = Counter()
        for t in chosen:
            padded = "\0" * (lm.ORDER - 1) + t
            for k in range(1, lm.ORDER + 1):
                grams.update(padded[i - k + 1:i + 1] for i in range(lm.ORDER - 1, len(padded)))
        return grams

    vocabulary = len(set("".join(texts)))
    for name, chosen in (("target_loss", texts[:400:4]), ("background_loss", texts)):
        every = count(chosen)
        for i in (0, 1, 2, 400, 401):
            held = name == "background_loss" or i in (0,)
            grams = every - count([texts[i]]) if held else every
            whole = sum(map(len, chosen)) - (len(texts[i]) if held else 0)
            padded, loss = "\0" * lm.ORDER + texts[i], 0.0
            for at in range(lm.ORDER, len(padded)):
                p, context = 1 / vocabulary, whole
                for k in range(1, lm.ORDER + 1):
                    own = grams[padded[at - k + 1:at + 1]]
                    if context:
                        p = lm.TRUST * min(own / context, 1) + (1 - lm.TRUST) * p
                    context = grams[padded[at - k:at]]
                loss -= np.log(p)
            assert got[i][name] == pytest.approx(loss / len(texts[i]), rel=1e-9), (name, i)


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


@pytest.fixture(scope="module")
def labelled(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r for r in table(spark, sf, "labels").collect()}
    return table(spark, sf, "documents"), table(spark, sf, "labels"), labels


def test_quality_ranking_on_held_out_rows(spark, labelled):
    docs, labels, truth = labelled
    ranker = ranking.train(docs, labels)
    got = ranking.quality_scores(docs, ranker).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == held_out(r.doc_id) for r in got)
    test = [(r.predicted, truth[r.doc_id].quality) for r in got if r.held_out and r.doc_id in truth]
    good = [p for p, q in test if q]
    bad = [p for p, q in test if not q]
    assert len(bad) > 3 and np.mean(good) >= 0.97 and np.mean(bad) <= 0.2
    # the filter keeps exactly the accepted rows, with all columns
    more = docs.withColumn("score", mixing.F.lit("mine"))
    kept = ranking.accepted(more, ranker)
    assert kept.columns == more.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.predicted}


def test_quality_labels_of_held_out_rows_are_never_used(spark, labelled):
    docs, labels, truth = labelled
    flipped = labels.withColumn("quality", mixing.F.when(
        ranking.held_out("doc_id"), 1 - mixing.F.col("quality")).otherwise(mixing.F.col("quality")))
    a, b = ranking.train(docs, labels), ranking.train(docs, flipped)
    assert np.array_equal(a.weights, b.weights) and a.threshold == b.threshold


def test_quality_of_awkward_texts(spark):
    docs = frame(spark, rows_of(AWKWARD))
    labels = spark.createDataFrame(
        [(i, i % 2, None) for i in range(len(AWKWARD))] + [(None, 1, 0), (3, None, 0), (4, 7, 0)],
        "doc_id bigint, quality int, toxic int")
    got = ranking.quality_scores(docs, ranking.train(docs, labels)).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r.score <= 1 for r in got)
    one_sided = ranking.train(docs, labels.filter("quality = 1"))
    assert all(r.predicted == 1 for r in ranking.quality_scores(docs, one_sided).collect())


def test_toxicity_on_held_out_rows(spark, labelled):
    docs, labels, truth = labelled
    model = toxicity.train(docs, labels)
    got = toxicity.severity(docs, model).collect()
    assert all(0 <= r.expected_severity <= 3 for r in got)
    test = [(r.toxic, truth[r.doc_id].toxic) for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([p for p, t in test if t]) >= 0.6 and np.mean([p for p, t in test if not t]) <= 0.02
    assert (np.diff(model.thresholds) > 0).all()


def test_ordinal_regression_recovers_order():
    rng = np.random.default_rng(1)
    n, k = 3000, 8
    ones = rng.random((n, k)) < 0.3
    w = np.linspace(-2, 2, k)
    latent = ones @ w + rng.logistic(size=n)
    grade = np.digitize(latent, [0.5, 1.5, 3.0])
    rows, columns = np.nonzero(ones)
    got, t = toxicity.cumulative_link(rows, columns, (n, k), grade, 4)
    assert np.corrcoef(got, w)[0, 1] > 0.98
    assert np.abs(t - [0.5, 1.5, 3.0]).max() < 0.35


def test_toxicity_without_evidence(spark):
    docs = frame(spark, rows_of(AWKWARD))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(9)], "doc_id bigint, quality int, toxic int")
    got = toxicity.severity(docs, toxicity.train(docs, labels)).collect()
    assert len(got) == len(AWKWARD) and not any(r.toxic for r in got)


def test_packing_round_trip(spark):
    texts = AWKWARD[:-1] + ["<|endoftext|> a<|endoftext|>", "a  b   c\n\n d " * 3000, "z" * 5000]
    docs = frame(spark, rows_of(texts)).unionByName(frame(spark, rows_of(["again"])))
    got = packing.packed(docs, with_ids=True).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
    for i, text in enumerate(texts):
        want = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        own = sorted((r for r in pieces[i] if not (i == 0 and r.length == 2)), key=lambda r: r.piece)
        ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in own])
        assert ids.tolist() == want, i
        assert [r.piece for r in own] == list(range(len(own)))
        assert all(r.length == 2048 for r in own[1:]) and own[0].length <= 2048
        assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own[:-1])]).tolist()
        assert all(r.ids_crc32 == zlib.crc32(r.ids) for r in own)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for content in bins.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= sum(r.length for r in got) / 2048 + 2


def test_best_two_fit():
    # greedy leaves 10 - 6 - 3 = 1; two pieces of 2 fill what the 3 left
    bins = packing.best_two_fit([6, 3, 2, 2], 10)
    assert sorted(sorted([6, 3, 2, 2][i] for i in b) for b in bins) == [[2, 2, 6], [3]]
    rng = random.Random(4)
    for _ in range(50):
        lengths = [rng.randint(1, 2047) for _ in range(400)]
        bins = packing.best_two_fit(lengths, 2048)
        assert sorted(i for b in bins for i in b) == list(range(400))
        assert all(sum(lengths[i] for i in b) <= 2048 for b in bins)
        assert len(bins) <= -(-sum(lengths) // 2048) * 1.06 + 1
    assert packing.best_two_fit([], 10) == [] and packing.best_two_fit([10, 10], 10) == [[1], [0]]


BASE = {
    "assign": (re.compile(r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|"
                          r"[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
                          r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"),
               lambda m: len(m[1]) >= 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
}


def base_by_hand(text):
    out = []
    for rank, (kind, (pattern, good)) in enumerate(BASE.items()):
        out += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}")
                for m in pattern.finditer(text or "") if good(m)]
    return [s for *_, s in sorted(out)]


def test_secret_spans_on_awkward_texts(spark):
    key = "".join(random.Random(8).choices(secrets.ENCODINGS[3][2], k=40))
    texts = AWKWARD + [
        'token="abcdef" TOKEN: x=1 password = hunter22', "Key apı_key=abcdefg api_key='abc.def'",
        "AKIA" + "A" * 16 + " AKIAB AKIA" + "AKIA" * 6, "deadbeef" * 3 + " " + "deadbeef" * 2,
        "secret: token=abcdefgh", "token: ab token: abcdef", f"\U0001F600 see {key} there",
        "theninerinationhestthandnderthing", "INGANDTHENINERINATIONHESTTHAND", "2024-01-01-2024-02-02-2024",
        "getUserNameFromDatabaseConnection", "a/path/to/some/very/long/file/name", "=" * 40, "-" * 40]
    docs = frame(spark, rows_of(texts))
    got = {r.doc_id: r for r in secrets.secret_spans(docs).collect()}
    for i, text in enumerate(texts):
        want = base_by_hand(text)
        r = got[i]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), text
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(
            sum(s.startswith(k) for s in want) for k in BASE)
        spans = r.spans.split(",") if r.spans else []
        assert [s for s in spans if not s.startswith("random")] == want
        at = text.find(key) if text else -1
        assert [s for s in spans if s.startswith("random")] == (
            [f"random:{at}:{at + len(key)}"] if at >= 0 else []), text
    clean = {r.doc_id: r.text for r in secrets.redacted(docs).collect()}
    for i, text in enumerate(texts):
        assert clean[i] == text if not got[i].spans else "[secret]" in clean[i]
    assert clean[texts.index(texts[-8])].startswith("\U0001F600 see [secret] there")


def test_random_tokens_glued_to_other_key_characters(spark):
    rng = random.Random(9)
    symbols = {name: letters for name, _, letters in secrets.ENCODINGS}

    def token(kind, n=40):
        return "".join(rng.choices(symbols[kind], k=n))

    cases = [("AWS_SECRET_ACCESS_KEY={}", token("base64")), ("https://x.org/f?sig={}&v=1", token("base64url")),
             ("private_key={}==", token("base64")), ("/api/v1-beta/{}/some_page", token("base62")),
             ("a-b_c/{}", token("base64url")), ("see AKIA" + "Q7" * 8 + "/{} there", token("base62")),
             ("see {} there", "".join(rng.choices(symbols["base62"][10:], k=64))),
             ("deadbeef" * 3 + "={}", token("base64"))]
    plain = ["NAME_OF_SOME_SETTING=another_ordinary_setting", "/a-page/with_words/and/other-words/in_it",
             "SomeVeryLongClassNameOfTheLibrary=getUserNameFromDatabase", "theninerinationhestthandnderthing"]
    texts = [form.format(key) for form, key in cases] + plain
    docs = frame(spark, rows_of(texts, False), False)
    got = {r.doc_id: r.spans for r in secrets.secret_spans(docs).collect()}
    clean = {r.doc_id: r.text for r in secrets.redacted(docs).collect()}
    for i, (form, key) in enumerate(cases):
        at = texts[i].index(key)
        found = [tuple(map(int, s.split(":")[1:])) for s in got[i].split(",") if s.startswith("random")]
        assert any(s <= at and at + len(key) <= e for s, e in found), (texts[i], got[i])
        # accepted pieces of one token are one span
        assert len(found) == 1 and key not in clean[i] and "[secret]" in clean[i]
    for i in range(len(cases), len(texts)):
        assert got[i] == "" and clean[i] == texts[i], (texts[i], got[i])


def test_randomness_battery():
    rng = random.Random(2)
    letters = secrets.ENCODINGS[3][2]
    kept = [secrets.run_evidence("".join(rng.choices(letters, k=40))) for _ in range(400)]
    # the battery rejects uniform text about as often as its level says
    assert sum(p is None for p in kept) < 25
    assert np.median([p for p in kept if p is not None]) < 1e-4
    for n in (20, 60):
        symbols = np.arange(n) % 2 * 50
        assert secrets.randomness(symbols, 62) < 1e-3
        assert secrets.randomness(np.sort(np.random.default_rng(n).integers(0, 62, n)), 62) < 1e-2
    assert secrets.discovery_limits({(0, 100): 3, (0, 1): 50}, [100, 0, 0, 0], 0.01)[:2] == [
        100 * secrets.BIN, float("inf")]


def test_long_texts_are_scanned_in_proportion():
    import time

    rnd = random.Random(6)
    letters = secrets.ENCODINGS[5][2]

    def seconds(n):
        text = " ".join(f"token={''.join(rnd.choices(letters, k=24))} {''.join(rnd.choices(letters, k=30))}"
                        for _ in range(n))
        start = time.perf_counter()
        spans = secrets.added_spans(text, secrets.base_spans(text))[0]
        secrets.around(spans)
        return time.perf_counter() - start

    seconds(200)
    # sixteen times the text: far from 256 times the work
    assert seconds(16_000) < 50 * seconds(1_000)


def test_pieces_and_nesting_equal_a_pairwise_search():
    rnd = random.Random(9)
    parts = ["=", "/", "+", "-", "_", " ", "AKIA" + "Q7" * 9, "token=", "abcdef0123456789" * 2, "x"]
    for _ in range(300):
        text = "".join(rnd.choice(parts) if rnd.random() < .4 else "".join(
            rnd.choices(secrets.ENCODINGS[3][2], k=rnd.randint(1, 30))) for _ in range(rnd.randint(1, 25)))
        base = secrets.base_spans(text)
        want = set()
        for m in secrets.RUN.finditer(text):
            places = [i for i in range(m.start(), m.end()) if not any(s <= i < e for s, _, e in base)]
            cuts = [k for k in range(1, len(places)) if places[k] != places[k - 1] + 1]
            for a, b in zip([0, *cuts], [*cuts, len(places)]):
                if b - a < secrets.SHORTEST:
                    continue
                start, end = places[a], places[b - 1] + 1
                last = start + len(text[start:end].rstrip("="))
                for pattern in secrets.PIECES:
                    for piece in pattern.finditer(text, start, last):
                        stop = end if piece.end() == last else piece.end()
                        if stop - piece.start() >= secrets.SHORTEST:
                            want.add((piece.start(), stop))
        assert secrets._pieces(text, base) == sorted(want)
        spans = [(s, e, rnd.choice([1.5, 2.5, 9.0]), secrets.length_class(e - s)) for s, e in sorted(want)]
        limits = [2.0, 1.0, 3.0, float("inf")]
        kept = [t for t in spans if t[2] >= limits[t[3]]]
        outer = [s for s in kept if not any(
            t[0] <= s[0] and s[1] <= t[1] and t[:2] != s[:2] for t in kept)]
        assert [s for s, a in zip(spans, secrets.around(spans)) if s in kept and not any(
            x >= y for x, y in zip(a, limits))] == outer


def test_discovery_limits_equal_an_exact_benjamini_hochberg():
    rnd = random.Random(4)
    for _ in range(50):
        # p-values on the grid of steps: the counted rule has to be the exact one
        steps = [rnd.choice([0, 1, 5, 20, 40, 60, 100, 200]) for _ in range(rnd.randint(0, 60))]
        total = len(steps) + rnd.randint(0, 500)
        counts = {(1, s): steps.count(s) for s in steps}
        p = sorted(10 ** (-s * secrets.BIN) for s in steps)
        passed = p[:max([i for i, x in enumerate(p, 1) if x <= 0.05 * i / max(total, 1)], default=0)]
        limit = secrets.discovery_limits(counts, [0, total, 0, 0], 0.05)[1]
        assert [x for x in p if x <= 10 ** -limit * (1 + 1e-12)] == passed


def test_clashing_columns_stay(spark):
    own = {c: f"own {c}" for c in ("_row", "_kept", "_of", "_node", "_mix_row", "_mix_of", "_mix_copies",
                                   "row", "key", "copies")}
    ddl = "doc_id bigint, text string, source string, " + ", ".join(f"{c} string" for c in own)
    rows = [(i, f"some words of text {i // 2} and more of them {i // 2}", "s", *own.values()) for i in range(8)]
    df = spark.createDataFrame(rows, ddl)
    for out in (superminhash.deduplicated(df), mixing.mixed(df), secrets.redacted(df)):
        found = out.collect()
        assert out.columns == df.columns and found
        assert all(r[c] == v for r in found for c, v in own.items())
    assert superminhash.deduplicated(df).count() == 4


def naive_two_fit(lengths, capacity):
    """Best-two-fit by trying all pieces and all pairs: the lengths of each bin."""
    left, bins = sorted(lengths, reverse=True), []
    while left:
        content, gap = [], capacity
        while fits := [n for n in left if n <= gap]:
            n = max(fits)
            left.remove(n)
            content.append(n)
            gap -= n
        if gap and len(content) > 1:
            smallest = content[-1]
            room = gap + smallest
            # two pieces that fill the room more tightly than the smallest one did
            sums = [a + b for a, b in itertools.combinations(left, 2) if smallest < a + b <= room]
            if sums:
                total = max(sums)
                # of equal sums the pair with the longest piece
                a = max(max(x, y) for x, y in itertools.combinations(left, 2) if x + y == total)
                content[-1:] = [a, total - a]
                left.remove(a)
                left.remove(total - a)
                left.append(smallest)
        bins.append(sorted(content))
    return sorted(bins)


def test_best_two_fit_equals_a_naive_search():
    rng = random.Random(12)
    for _ in range(150):
        capacity = rng.choice([10, 30, 100])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 40))]
        bins = packing.best_two_fit(lengths, capacity)
        assert sorted(sorted(lengths[i] for i in b) for b in bins) == naive_two_fit(lengths, capacity)


def test_pairwise_weights_are_the_minimum_of_the_loss():
    rng = np.random.default_rng(2)
    difference = rng.normal(size=(400, 4)) + [0.5, 0, -0.2, 0]
    w = ranking.bradley_terry(difference, penalty=1e-2)

    def loss(v):
        return np.mean(np.log1p(np.exp(-difference @ v))) + 0.5e-2 * v @ v

    for k in range(4):
        for step in (-1e-3, 1e-3, -0.1, 0.1):
            moved = w.copy()
            moved[k] += step
            assert loss(moved) > loss(w)


def test_quality_scores_equal_a_sum_by_hand(spark, labelled):
    docs, labels, _ = labelled
    ranker = ranking.train(docs, labels)
    got = {r.doc_id: r for r in ranking.quality_scores(docs, ranker).collect()}
    flags = ranking._classes()
    for r in docs.limit(60).collect():
        x = ranking.features(r.text, flags)
        z = sum(w * min(max((v - c) / s, -8), 8) for w, v, c, s in zip(
            ranker.weights, [*x, *np.sqrt(np.abs(x)), *np.minimum(np.abs(x) * 20, 1)], ranker.centre, ranker.scale))
        z = ranker.slope * (z - ranker.threshold) + np.log(0.3 / 0.7)
        score = 1 / (1 + np.exp(-min(max(z, -30), 30)))
        assert got[r.doc_id].score == pytest.approx(score, rel=1e-9)
        assert got[r.doc_id].predicted == (got[r.doc_id].score >= 0.3)


def test_severity_equals_a_sum_by_hand(spark, labelled):
    docs, labels, _ = labelled
    model = toxicity.train(docs, labels)
    weight = dict(zip(model.vocabulary.tolist(), model.weights.tolist()))
    got = {r.doc_id: r for r in toxicity.severity(docs, model).collect()}
    for r in docs.limit(200).collect():
        evidence = sum(weight.get(int(t), 0.0) for t in toxicity.terms(r.text))
        p = [1 / (1 + np.exp(-min(max(evidence - t, -35), 35))) for t in model.thresholds]
        assert got[r.doc_id].expected_severity == pytest.approx(sum(p), rel=1e-9)
        assert got[r.doc_id].grade == sum(x >= 0.5 for x in p)
    assert len({round(r.expected_severity, 3) for r in got.values()}) > 3


def test_ordinal_gradient_ends_near_a_minimum():
    rng = np.random.default_rng(3)
    n, k = 300, 5
    x = rng.random((n, k)) < 0.4
    grade = np.clip((x @ [1.5, 1, 0.5, 0, 0] + rng.normal(size=n) * 0.5).astype(int), 0, 2)
    rows, columns = np.nonzero(x)
    w, t = toxicity.cumulative_link(rows, columns, (n, k), grade, 3)

    def loss(w, t):
        s = x @ w
        edge = np.concatenate([[-np.inf], t, [np.inf]])
        cdf = lambda z: 1 / (1 + np.exp(-z))
        with np.errstate(over="ignore"):
            mass = cdf(edge[grade + 1] - s) - cdf(edge[grade] - s)
        return -np.log(mass).mean() + 0.01 * w @ w / n

    best = loss(w, t)
    for _ in range(200):
        assert loss(w + rng.normal(size=k) * 0.2, t + rng.normal(size=2) * 0.05) > best - 1e-3
