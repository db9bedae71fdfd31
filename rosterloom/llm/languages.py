"""Language spans of texts: script ranges, scores of words, and the best path through them.

A word is a run of letters, cut after `WORD_LENGTH`. Its letters' script leaves the languages
written in that script as candidates; a script that no language was learnt with leaves all of them.
Each candidate's score sums the log ratios of the word's 1- to 3-grams of characters (with marks for
the word's ends) in the language to their share in all languages alike. The Viterbi path through a
text's words, on which each change of language costs `SWITCH`, labels its spans; so a few odd words
don't change the language, a foreign sentence does. A document's language is the one with most
letters in its spans, its score the share of the letters that are in them.

Learnt are texts with a language outside the held-out fold: `PER_LANGUAGE` a language at most, the
first in the order of a hash of id and text, of the `LANGUAGES` most frequent ones; `GRAMS` n-grams
of a language at most. All texts are labelled as a whole, whatever their length.

Null texts and texts without a letter have no spans: `und`, score 0. So has every text if nothing
could be learnt. Ties go to the language that comes first by code point. Null ids are not held out.
Repeated rows and ids are kept as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices

NO_LANGUAGE = "und"
FOLDS, HELD_OUT = 4, 2
#: Texts learnt from a language, languages learnt, and n-grams kept of a language, at most.
PER_LANGUAGE, LANGUAGES, GRAMS = 2000, 200, 20_000
#: What a change of language costs, in the unit of the words' scores.
SWITCH = 8.0
#: What a language outside a word's candidates costs: more than two changes.
OUTSIDE = -100.0
#: Letters of a word; longer runs, as of scripts without spaces, are several words.
WORD_LENGTH = 32
#: Distinct words scored at once.
CHUNK = 1 << 15
#: Share of a language's letters above which it is a candidate in their script.
CANDIDATE = 0.01
_WORD = re.compile(r"[^\W\d_]{1,%d}" % WORD_LENGTH)

# Where the ranges of scripts start, by Unicode block; None is any other.
_SCRIPT_RANGES = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"),
    (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, None), (0x0750, "Arabic"), (0x0780, None),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"),
    (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"),
    (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"),
    (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"),
    (0x1200, "Ethiopic"), (0x13A0, None), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, None),
    (0x1C80, "Cyrillic"), (0x1C90, "Georgian"), (0x1CC0, None), (0x1E00, "Latin"), (0x1F00, "Greek"),
    (0x2000, None), (0x2C60, "Latin"), (0x2C80, None), (0x2DE0, "Cyrillic"), (0x2E80, "Han"),
    (0x3040, "Kana"), (0x3100, "Han"), (0x3130, "Hangul"), (0x3190, "Han"), (0x31F0, "Kana"),
    (0x3200, None), (0x3400, "Han"), (0xA000, None), (0xA640, "Cyrillic"), (0xA6A0, None),
    (0xA720, "Latin"), (0xA800, None), (0xAC00, "Hangul"), (0xD800, None), (0xF900, "Han"),
    (0xFB00, "Latin"), (0xFB13, "Armenian"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, None),
    (0xFE70, "Arabic"), (0xFF00, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0xFFE0, None),
    (0x20000, "Han"), (0x323B0, None))
_STARTS = np.array([start for start, _ in _SCRIPT_RANGES], np.int64)
_NAMES = sorted({name for _, name in _SCRIPT_RANGES if name})
SCRIPTS = len(_NAMES) + 1
_SCRIPT_OF = np.array([_NAMES.index(name) + 1 if name else 0 for _, name in _SCRIPT_RANGES])


class Words:
    """Distinct words: how many letters they have, their n-grams and their letters' scripts."""

    def __init__(self, words: list[str]):
        self.n = len(words)
        self.letters = np.array([len(w) if w.isalpha() else sum(map(str.isalpha, w)) for w in words],
                                np.int64)
        laid = "".join(f"\x01{w.lower()}\x02" for w in words)
        codes = np.frombuffer(laid.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        starts = np.flatnonzero(codes == 1)
        at = np.arange(len(codes)) - np.repeat(starts, np.diff(np.append(starts, len(codes))))
        owner = np.cumsum(codes == 1) - 1
        inside = codes > 2
        # n-grams of 21 bits a character; shorter ones are smaller numbers
        one = np.concatenate([np.zeros(2, np.int64), codes])
        pairs, threes = at >= 1, at >= 2
        self.grams = np.concatenate([
            codes[inside], (one[1:-1] << 21 | codes)[pairs],
            (one[:-2] << 42 | one[1:-1] << 21 | codes)[threes]])
        self.owner = np.concatenate([owner[inside], owner[pairs], owner[threes]])
        script = _SCRIPT_OF[np.searchsorted(_STARTS, codes[inside], "right") - 1]
        #: letters by script, a row a word
        self.scripts = np.bincount(owner[inside] * SCRIPTS + script,
                                   minlength=self.n * SCRIPTS).reshape(self.n, SCRIPTS)


@dataclass(frozen=True)
class LanguageModel:
    """Languages, the scores of n-grams in them (rows as `grams`), and each script's candidates."""

    languages: list[str]
    grams: np.ndarray
    scores: np.ndarray
    candidates: np.ndarray

    def word_scores(self, words: Words) -> np.ndarray:
        out = np.zeros((words.n, len(self.languages)))
        if len(self.grams):
            row = np.minimum(np.searchsorted(self.grams, words.grams), len(self.grams) - 1)
            known = self.grams[row] == words.grams
            row, owner = row[known], words.owner[known]
            for k in range(len(self.languages)):
                out[:, k] = np.bincount(owner, self.scores[row, k], words.n)
        return out + np.where(self.candidates[words.scripts.argmax(1)], 0, OUTSIDE)

    @property
    def slice_bytes(self) -> int:
        """Text bytes worked on at once: less for more languages."""
        return max(1 << 18, (16 << 20) // max(len(self.languages), 1))


def best_paths(scores: np.ndarray, word: np.ndarray, lengths: np.ndarray,
               switch: float = SWITCH) -> np.ndarray:
    """The label of each word on the best path of its text.

    `word` holds rows of `scores`, text after text; `lengths` the words of each text. All texts go
    one word forward at a time, the longest ones first, so a step works on a prefix of them.
    """
    order = np.argsort(-lengths, kind="stable")
    start = np.concatenate([[0], np.cumsum(lengths)[:-1]])[order].astype(np.int64)
    size = lengths[order]
    # how many texts have a t-th word
    active = len(size) - np.searchsorted(size[::-1], np.arange(size[0] if len(size) else 0), "right")
    stays = np.zeros((len(word), scores.shape[1]), bool)
    best_before = np.zeros(len(word), np.int32)
    value = np.zeros((len(size), scores.shape[1]))
    final = np.zeros(len(size), np.int32)
    for t, m in enumerate(active.tolist()):
        at = start[:m] + t
        now = value[:m]
        if t:
            top = now.argmax(1)
            jump = now[np.arange(m), top][:, None] - switch
            stay = now >= jump
            stays[at], best_before[at] = stay, top
            now = np.where(stay, now, jump)
        value[:m] = now + scores[word[at]]
        done = active[t + 1] if t + 1 < len(active) else 0
        final[done:m] = value[done:m].argmax(1)
    label = np.zeros(len(word), np.int32)
    state = final
    for t in range(len(active) - 1, -1, -1):
        m = active[t]
        at = start[:m] + t
        label[at] = state[:m]
        if t:
            state[:m] = np.where(stays[at, state[:m]], state[:m], best_before[at])
    return label


class Labelled:
    """The words of some texts and their labels."""

    def __init__(self, texts: list[str | None], model: LanguageModel, switch: float = SWITCH):
        number: dict[str, int] = {}
        found = [[number.setdefault(w, len(number)) for w in _WORD.findall(t or "")] for t in texts]
        distinct = list(number)
        del number
        letters, scores = [np.zeros(0, np.int64)], [np.zeros((0, len(model.languages)))]
        for i in range(0, len(distinct), CHUNK):
            words = Words(distinct[i:i + CHUNK])
            letters.append(words.letters)
            scores.append(model.word_scores(words))
        del distinct
        letters, scores = np.concatenate(letters), np.concatenate(scores)
        word = np.fromiter((w for x in found for w in x), np.int64, sum(map(len, found)))
        text = np.repeat(np.arange(len(texts)), [len(x) for x in found])
        del found
        #: which of all words have a letter; other runs take no part
        self.real = letters[word] > 0
        self.word, self.text = word[self.real], text[self.real]
        self.letters = letters[self.word]
        self.label = np.zeros(len(self.word), np.int32)
        if model.languages and len(self.word):
            lengths = np.bincount(self.text, minlength=len(texts))
            self.label = best_paths(scores, self.word, lengths, switch)


def _labelled(batches: Iterator[pa.RecordBatch], model: LanguageModel, switch: float):
    names = pa.array([*model.languages, NO_LANGUAGE], pa.string())
    for batch in slices(batches, limit=model.slice_bytes):
        n, k = batch.num_rows, max(len(model.languages), 1)
        found = Labelled(batch.column("text").to_pylist(), model, switch)
        letters = np.bincount(found.text * k + found.label, found.letters, n * k).reshape(n, k)
        total = letters.sum(1)
        top = np.where((total > 0) & bool(model.languages), letters.argmax(1), len(model.languages))
        share = np.divide(letters.max(1), total, out=np.zeros(n), where=total > 0)
        yield pa.record_batch({
            "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"),
            "lang_pred": names.take(pa.array(top)),
            "score": pa.array(share if model.languages else np.zeros(n))})


def _spans(batches: Iterator[pa.RecordBatch], model: LanguageModel, switch: float):
    for batch in slices(batches, limit=model.slice_bytes):
        texts = batch.column("text").to_pylist()
        found = Labelled(texts, model, switch)
        places = np.array([m.span() for t in texts for m in _WORD.finditer(t or "")],
                          np.int64).reshape(-1, 2)[found.real]
        if not model.languages:
            places = places[:0]
        text, label = found.text[:len(places)], found.label[:len(places)]
        first = np.ones(len(places), bool)
        first[1:] = (text[1:] != text[:-1]) | (label[1:] != label[:-1])
        first = np.flatnonzero(first)
        last = np.append(first[1:], len(places)) - 1 if len(first) else first
        yield pa.record_batch({
            "doc_id": batch.column("doc_id").take(pa.array(text[first])),
            "start": pa.array(places[first, 0]), "end": pa.array(places[last, 1]),
            "lang": pa.array(model.languages, pa.string()).take(pa.array(label[first]))})


def _chunks(count: dict[str, int]) -> Iterator[dict[str, int]]:
    entries = iter(count.items())
    while part := dict(islice(entries, CHUNK)):
        yield part


def _counted(batches: Iterator[pa.RecordBatch]):
    """(lang, gram, n): the n-grams of the words of each language; letters by script below 0."""
    for batch in slices(batches):
        by_language: dict[str, dict[str, int]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            count = by_language.setdefault(lang, {})
            for w in _WORD.findall(text):
                count[w] = count.get(w, 0) + 1
        for lang, said in ((k, v) for k, count in by_language.items() for v in _chunks(count)):
            words = Words(list(said))
            times = np.fromiter(said.values(), np.int64, len(said)) * (words.letters > 0)
            grams, at = np.unique(words.grams, return_inverse=True)
            n = np.bincount(at, times[words.owner], len(grams)).astype(np.int64)
            scripts = (words.scripts * times[:, None]).sum(0)
            yield pa.record_batch({
                "lang": pa.array([lang] * (len(grams) + SCRIPTS), pa.string()),
                "gram": pa.array(np.concatenate([grams, -1 - np.arange(SCRIPTS)])),
                "n": pa.array(np.concatenate([n, scripts]))})


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def fit(rows: list[tuple[str, int, int]], trust: float = 500.0) -> LanguageModel:
    """The model of (language, n-gram, times); script counts have n-grams below 0."""
    languages = sorted({lang for lang, gram, n in rows if gram >= 0 and n > 0})
    place = {lang: i for i, lang in enumerate(languages)}
    used = [r for r in rows if r[0] in place and r[2] > 0]
    grams = np.array(sorted({r[1] for r in used if r[1] >= 0}), np.int64)
    counts = np.zeros((len(grams), len(languages)))
    scripts = np.zeros((SCRIPTS, len(languages)))
    for lang, gram, n in used:
        if gram < 0:
            scripts[-1 - gram, place[lang]] = n
        else:
            counts[np.searchsorted(grams, gram), place[lang]] = n
    total = np.maximum(counts.sum(0), 1)
    # languages count alike, however many texts they have
    share = (counts / total).sum(1, keepdims=True) / max(len(languages), 1)
    ratio = (counts + trust * share) / (total + trust) / share
    candidates = scripts > CANDIDATE * np.maximum(scripts.sum(0), 1)
    candidates[~candidates.any(1)] = True
    return LanguageModel(languages, grams, np.log(ratio) / 2, candidates)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          per_language: int = PER_LANGUAGE, languages: int = LANGUAGES,
          grams: int = GRAMS) -> LanguageModel:
    """Learn from texts with a language whose id is not in the held-out fold."""
    rows = docs.filter(~held_out(id_col)).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"),
        F.xxhash64(id_col, text_col).alias("hash")).filter("lang is not null and text is not null")
    often = [r["lang"] for r in rows.groupBy("lang").count().orderBy(
        F.desc("count"), "lang").limit(languages).collect()]
    first = F.row_number().over(Window.partitionBy("lang").orderBy("hash"))
    limits = (rows.filter(F.col("lang").isin(often)).select("lang", "hash").distinct()
              .withColumn("place", first).filter(F.col("place") <= per_language)
              .groupBy("lang").agg(F.max("hash").alias("limit")))
    # one row a language
    small = docs.sparkSession.createDataFrame([tuple(r) for r in limits.collect()],
                                              "lang string, limit bigint")
    counts = (rows.join(F.broadcast(small), "lang").filter("hash <= limit")
              .dropDuplicates(["lang", "hash"]).select("lang", "text")
              .mapInArrow(_counted, "lang string, gram bigint, n bigint")
              .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    ranked = F.row_number().over(Window.partitionBy("lang", F.col("gram") < 0).orderBy(
        F.desc("n"), "gram"))
    kept = counts.withColumn("place", ranked).filter(F.col("place") <= grams)
    return fit([(r["lang"], r["gram"], r["n"]) for r in kept.collect()])


def predicted(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text",
              switch: float = SWITCH) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                       held_out(id_col).alias("held_out"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lambda b: _labelled(b, model, switch),
                           f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def spans(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text",
          switch: float = SWITCH) -> DataFrame:
    """(doc_id, start, end, lang): runs of words of one language, in code points, end exclusive."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lambda b: _spans(b, model, switch),
                           f"doc_id {kind}, start bigint, end bigint, lang string")
