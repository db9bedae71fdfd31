"""Secret scan: fixed patterns, and tokens that pass a battery of randomness tests.

Base kinds, leftmost and non-overlapping per kind: `assign` (a key name, = or :, a value of six
characters or more), `access` (access key ids), `hex` (24 lower-case hex digits or more). Matches
that fail the length rule are dropped and still use up their text.

Added kind `random`: pieces of 20 or more characters of the runs of key characters. Runs are cut at
the borders of base matches and at inner equals signs; what is left is tested as a whole, and its
parts between slashes and pluses, between underscores and hyphens, and between any of them, so that
tokens glued to names, paths and other tokens are tested too. Of accepted pieces inside each other
the outermost is the span. The narrowest alphabet that holds a piece (hex, base 32, 36, 62, 64) is
its encoding, without its digits if the piece has none. Uniform text over it must not be rejected by chi-squared uniformity, by a runs test about the median and by
serial correlation (Bonferroni over the three). Against it stands ordinary text, in which lower
case, upper case and digits follow each other in stretches: its p-value is the chance of so many
changes of character class, and of so many digits, in a run of that length. Benjamini-Hochberg
over the whole corpus, within classes of length, keeps the share of ordinary runs among the added
spans below `rate`; the counts behind it are a table of bounded size.

Null texts are empty and have no spans. Null and repeated ids are kept as they are, a row each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import erfc, exp, lgamma, log, log1p, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import slices

# fixed values: the base patterns and their rules, in the order in which kinds are listed
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?"
                    r"([A-Za-z0-9+/_.=-]+)", re.ASCII)
KEY_NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey")
MIN_VALUE = 6
# a match of AKIA[A-Z0-9]+ with 20 characters or more; a shorter one can hold no longer one
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

SHORTEST = 20
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: What a run is cut into: at equals signs only, and at the separators of one alphabet or of both.
PIECES = tuple(re.compile(p) for p in (
    r"[A-Za-z0-9+/_-]+", r"[A-Za-z0-9_-]+", r"[A-Za-z0-9+/]+", r"[A-Za-z0-9]+"))
#: Encodings from the narrowest alphabet to the widest.
ENCODINGS = (
    ("hex", re.compile(r"[0-9a-f]+|[0-9A-F]+"), "0123456789abcdef"),
    ("base32", re.compile(r"[A-Z2-7]+"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", re.compile(r"[a-z0-9]+|[A-Z0-9]+"), "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base62", re.compile(r"[A-Za-z0-9]+"),
     "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", re.compile(r"[A-Za-z0-9+/]+"),
     "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", re.compile(r"[A-Za-z0-9_-]+"),
     "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
#: A run is consistent with chance if no test rejects it at this level.
RANDOM_LEVEL = 0.01
#: Chances of a change of class between neighbours, and of a digit, in ordinary runs.
CHANGE, DIGIT = 0.25, 0.08
#: Wanted share of ordinary runs among the added spans.
RATE = 0.01
#: Classes of length, and steps of -log10(p) in which p-values are counted.
LENGTHS = (20, 28, 40, 64)
BIN, BINS = 0.05, 2000


def _normal_tail(z: float) -> float:
    return erfc(abs(z) / sqrt(2))


def _chi_squared_tail(x: float, freedom: int) -> float:
    """Wilson and Hilferty's approximation."""
    z = ((x / freedom) ** (1 / 3) - 1 + 2 / (9 * freedom)) / sqrt(2 / (9 * freedom))
    return erfc(z / sqrt(2)) / 2


def _binomial_tail(n: int, p: float, least: int) -> float:
    """P(X >= least) for X of n tries; 1 for anything up to the mean, which is never rejected."""
    if least <= n * p:
        return 1.0
    out = 0.0
    for k in range(least, n + 1):
        term = exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(p) + (n - k) * log1p(-p))
        out += term
        # beyond the mean the terms fall faster than a geometric series
        if term <= out * 1e-9:
            break
    return min(1.0, out)


def randomness(symbols: np.ndarray, size: int) -> float:
    """The battery's p-value for uniform text over `size` symbols (0: it is rejected by all)."""
    n = len(symbols)
    # chi-squared over equal stretches of the alphabet, as many as the length can fill
    stretches = max(2, min(size, n // 5))
    share = np.bincount(np.arange(size) * stretches // size, minlength=stretches) / size
    seen = np.bincount(symbols * stretches // size, minlength=stretches)
    uniform = _chi_squared_tail(float(((seen - n * share) ** 2 / (n * share)).sum()), stretches - 1)
    high = symbols >= size / 2
    up = int(high.sum())
    down = n - up
    if not up or not down:
        return 0.0
    mean = 2 * up * down / n + 1
    spread = (mean - 1) * (mean - 2) / (n - 1)
    runs = _normal_tail((1 + int((high[1:] != high[:-1]).sum()) - mean) / sqrt(max(spread, 1e-9)))
    centred = symbols - symbols.mean()
    power = float(centred @ centred)
    serial = _normal_tail(float(centred[1:] @ centred[:-1]) / power * sqrt(n)) if power else 0.0
    return min(1.0, 3 * min(uniform, runs, serial))


def ordinary(run: str) -> float:
    """The chance of an ordinary run with at least so many changes of class, or so many digits."""
    kinds = [1 if c.isdigit() else 2 if c.isupper() else 3 if c.islower() else 4 for c in run]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:]))
    by_change = _binomial_tail(len(run) - 1, CHANGE, changes)
    # digits count only where letters surround them: numbers and dates are ordinary
    mixed = sum(a == 1 for a in kinds) if 1 < len({*kinds} & {1, 2, 3}) else 0
    between = sum(1 for a, b in zip(kinds, kinds[1:]) if (a == 1) != (b == 1))
    by_digit = _binomial_tail(len(run), DIGIT, min(mixed, between))
    return min(1.0, 2 * min(by_change, by_digit))


def length_class(n: int) -> int:
    return sum(n >= x for x in LENGTHS) - 1


def encoding(body: str) -> str | None:
    """The symbols of the narrowest alphabet that holds `body`, None if none does."""
    return next((symbols for _, alphabet, symbols in ENCODINGS if alphabet.fullmatch(body)), None)


def run_evidence(run: str) -> float | None:
    """The ordinary-text p-value of a run that may be random, None for one that may not."""
    body = run.rstrip("=")
    symbols = encoding(body)
    if symbols is None or body.isdigit():
        return None
    text = body.lower() if len(symbols) == 16 or len(symbols) == 36 else body
    if not any(c.isdigit() for c in body):
        # uniform text that happens to have no digit is uniform over the rest
        symbols = "".join(c for c in symbols if not c.isdigit())
    at = np.fromiter((symbols.index(c) for c in text), np.int64, len(text))
    return ordinary(body) if randomness(at, len(symbols)) >= RANDOM_LEVEL else None


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of kind, end) of every base match, in order."""
    out = []
    low = text.lower()
    if any(k in low for k in KEY_NAMES):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text)
                if m.end(2) - m.start(2) >= MIN_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _pieces(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of everything to be tested, in order; pieces may lie inside each other."""
    out = set()
    # what base matches cover, in order; runs are in order too, so both are walked once
    covered: list[list[int]] = []
    for s, _, e in base:
        if covered and s <= covered[-1][1]:
            covered[-1][1] = max(e, covered[-1][1])
        else:
            covered.append([s, e])
    first = 0
    for m in RUN.finditer(text):
        # the parts of the run outside base matches
        parts, at = [], m.start()
        while first < len(covered) and covered[first][1] <= at:
            first += 1
        for k in range(first, len(covered)):
            s, e = covered[k]
            if s >= m.end():
                break
            parts.append((at, s))
            at = e
        parts.append((at, m.end()))
        for start, end in parts:
            if end - start < SHORTEST:
                continue
            last = start + len(text[start:end].rstrip("="))
            for pattern in PIECES:
                for piece in pattern.finditer(text, start, last):
                    # equals signs that end a part are padding
                    e = end if piece.end() == last else piece.end()
                    if e - piece.start() >= SHORTEST:
                        out.add((piece.start(), e))
    return sorted(out)


def around(spans: list[tuple]) -> list[list[float]]:
    """For spans (start, end, evidence, class) in order: the most evidence, by class, around each.

    The pieces of one pattern don't overlap, so only a few spans are open at any place.
    """
    out: list[list[float]] = [[]] * len(spans)
    open_: list[tuple] = []
    # of spans with one start the longest comes first
    for i in sorted(range(len(spans)), key=lambda i: (spans[i][0], -spans[i][1])):
        start, end = spans[i][:2]
        open_ = [t for t in open_ if t[1] > start]
        out[i] = [-1.0] * len(LENGTHS)
        for _, stop, evidence, size in open_:
            if stop >= end:
                out[i][size] = max(out[i][size], evidence)
        open_.append(spans[i])
    return out


def added_spans(text: str, base: list[tuple[int, int, int]]) -> tuple[list, list[int]]:
    """(start, end, -log10 p, class) of pieces that may be random, and all tested ones by class."""
    out, tested = [], [0] * len(LENGTHS)
    for start, end in _pieces(text, base):
        run = text[start:end]
        if encoding(run.rstrip("=")) is None:
            continue
        size = length_class(end - start)
        tested[size] += 1
        # ordinary words: nothing to compute
        if run.isalpha() and (run.islower() or run.isupper() or run[1:].islower()):
            continue
        p = run_evidence(run)
        if p is not None and p < 0.1:
            out.append((start, end, -log(max(p, 1e-99), 10), size))
    return out, tested


_SPAN = pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32()),
                   ("evidence", pa.float64()), ("size", pa.int32()),
                   ("around", pa.list_(pa.float64()))])


def _scanned(batches: Iterator[pa.RecordBatch]):
    for batch in slices(batches):
        base, added, tested = [], [], []
        for text in batch.column("text").to_pylist():
            found = base_spans(text or "")
            more, seen = added_spans(text or "", found)
            base.append([{"start": s, "rank": r, "end": e} for s, r, e in found])
            added.append([{"start": s, "rank": 3, "end": e, "evidence": p, "size": c, "around": a}
                          for (s, e, p, c), a in zip(more, around(more))])
            tested.append(seen)
        yield pa.record_batch({
            "doc_id": batch.column("doc_id"), "base": pa.array(base, pa.list_(_SPAN)),
            "added": pa.array(added, pa.list_(_SPAN)),
            "tested": pa.array(tested, pa.list_(pa.int64()))})


def discovery_limits(counts: dict[tuple[int, int], int], tested: list[int], rate: float) -> list[float]:
    """For each class of length the least -log10 p that Benjamini-Hochberg accepts.

    `counts` holds runs by (class, step of -log10 p); a step counts with its largest p-value.
    """
    limits = []
    for size, total in enumerate(tested):
        limit, seen = float("inf"), 0
        for step in range(BINS, -1, -1):
            here = counts.get((size, step), 0)
            seen += here
            if here and 10 ** (-step * BIN) <= rate * seen / max(total, 1):
                limit = step * BIN
        limits.append(limit)
    return limits


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))))


_SPANS = "array<struct<start:int,rank:int,end:int,evidence:double,size:int,around:array<double>>>"


def _found(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id with its base spans, its added spans before control, and its tested runs by class."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        _scanned, f"doc_id {kind}, base {_SPANS}, added {_SPANS}, tested array<bigint>")


def _limits(found: DataFrame, rate: float) -> list[float]:
    """The limits over all rows, from counts by class and step: a table of bounded size."""
    one = F.explode(F.concat(
        F.transform("added", lambda s: F.struct(s["size"].alias("size"), F.least(
            F.floor(s["evidence"] / BIN), F.lit(BINS)).cast("int").alias("step"),
            F.lit(1).cast("bigint").alias("n"))),
        F.transform("tested", lambda n, i: F.struct(i.alias("size"), F.lit(-1).alias("step"),
                                                    n.alias("n")))))
    counts = (found.select(one.alias("c")).groupBy("c.size", "c.step")
              .agg(F.sum("c.n").alias("n")).collect())
    by_step = {(r["size"], r["step"]): r["n"] for r in counts}
    tested = [by_step.get((size, -1), 0) for size in range(len(LENGTHS))]
    return discovery_limits(by_step, tested, rate)


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            rate: float = RATE) -> DataFrame:
    """(doc_id, base, spans) of each row: arrays of (start, rank, end, ...) in order."""
    found = cut_lineage(_found(docs, id_col, text_col), "secrets")
    least = F.array(*[F.lit(x) for x in _limits(found, rate)])
    kept = F.filter("added", lambda s: s["evidence"] >= F.get(least, s["size"]))
    # a piece inside another one that is kept goes
    outer = F.filter(kept, lambda s: ~F.exists(F.zip_with(s["around"], least, lambda a, b: a >= b), lambda x: x))
    return found.select("doc_id", "base", F.array_sort(F.concat("base", outer)).alias("spans"))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 rate: float = RATE) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans) of each row."""
    found = scanned(docs, id_col, text_col, rate)

    def number(rank: int) -> Column:
        return F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("bigint")

    return found.select(
        F.col("doc_id").alias(id_col), number(0).alias("n_assign"), number(1).alias("n_access"),
        number(2).alias("n_hex"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             rate: float = RATE, mask: str = "[secret]") -> DataFrame:
    """`docs`, all columns, with every span of its text replaced by `mask`; null texts stay null.

    The added spans are those that `rate` allows over all of `docs`; the texts are read a second
    time with the limits found, so they are never shuffled.
    """
    limits = _limits(_found(docs, id_col, text_col), rate)

    def cleaned(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches, text_col):
            at = batch.schema.get_field_index(text_col)
            texts = [None if t is None else masked(t, limits, mask)
                     for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(cleaned, docs.schema)


def masked(text: str, limits: list[float], mask: str) -> str:
    base = base_spans(text)
    added = [(s, 3, e) for s, e, p, size in added_spans(text, base)[0] if p >= limits[size]]
    out, at = [], 0
    for start, _, end in sorted(base + added):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], mask]
        # spans that overlap share one mask
        at = end
    return "".join([*out, text[at:]])
