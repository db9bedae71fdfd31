"""Which tokens of two tokenizers stand for the same bytes, document by document and corpus-wide.

Every text is encoded by a byte-level vocabulary A and a piece vocabulary B, both reading a space
and the text, special strings as plain text. Offsets where a token of A and one of B end cut a text
into groups; a link is a pair of overlapping tokens, so a group of m and n tokens has m + n - 1.

An array gives for each id of A the id of B with the same bytes. Groups of one such pair, most of
all, are counted in vectors as long as the vocabulary, one a task; only links of other groups
become (A id, B id) rows, added up inside a block of texts first. Texts wait, as the distinct links
of a document with their numbers, until all counts are known: the corpus counts of a block's
distinct links are sent to the block, those of same-bytes pairs as one vector to all.

Null and empty texts, and texts whose tokens' bytes are not a space and the text, have no tokens:
zeros and an empty digest. Null and repeated ids are kept; each row is a document of its own. Other
columns are not read. A block holds about `BLOCK` bytes of text, a row at least.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import slices

#: Bytes of text whose links are added up together and whose counts are fetched together, and
#: bytes encoded at once.
BLOCK, SLICE = 8 << 20, 1 << 20
_SEGMENT = re.compile(" +[^ ]*")
_SPACE = "\N{LOWER ONE EIGHTH BLOCK}"


class Vocabularies:
    """Both encoders, and their tokens' bytes.

    `vocabulary` and `ranks` are the same byte-level vocabulary as a `tokenizers` file and as ranks
    (faster, same ids); `pieces` is a SentencePiece model that puts a space before the text.
    """

    def __init__(self, vocabulary: str, ranks: str, pattern: str, pieces: str):
        import base64

        import sentencepiece
        import tiktoken

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.vocabulary, self.exact = vocabulary, None
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pieces)
        a_bytes = [b""] * (max(table.values()) + 1)
        for token, i in table.items():
            a_bytes[i] = token
        said = [self.pieces.id_to_piece(i) for i in range(self.pieces.vocab_size())]
        b_bytes = [bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else
                   p.replace(_SPACE, " ").encode() for i, p in enumerate(said)]
        self.a_bytes, self.b_bytes = (pa.array(x, pa.large_binary()) for x in (a_bytes, b_bytes))
        self.n_a, self.n_b = len(a_bytes), len(b_bytes)
        self.a_size, self.b_size = (np.array([len(x) for x in v]) for v in (a_bytes, b_bytes))
        # a piece goes before the single byte that is written the same
        of = {x: i for i, x in enumerate(b_bytes) if self.pieces.is_byte(i)}
        of |= {x: i for i, x in enumerate(b_bytes) if not self.pieces.is_byte(i)
               and not self.pieces.is_control(i) and not self.pieces.is_unknown(i)}
        #: id of B with the bytes of an id of A, or -1
        self.same = np.array([of.get(x, -1) if x else -1 for x in a_bytes], np.int64)
        # if no piece has a space behind another character, words are encoded one by one
        self.by_word = not any(re.search(f"[^{_SPACE}]{_SPACE}", p) for p in said)
        # tokens as written in a group list, with what follows them
        self.written = pa.array([f"{i}{end}" for n, ends in ((self.n_a, ",|"), (self.n_b, ",;"))
                                 for i in range(n) for end in ends], pa.large_string())

    def encode_a(self, text: str) -> np.ndarray:
        """Ids of A of a space and the text."""
        try:
            return np.array(self.fast.encode_ordinary(" " + text), np.int64)
        except BaseException as error:  # noqa: BLE001  a panic of its regex engine is no Exception
            if type(error).__name__ != "PanicException":
                raise
        if self.exact is None:
            from tokenizers import Tokenizer

            self.exact = Tokenizer.from_file(self.vocabulary)
            self.exact.encode_special_tokens = True
        return np.array(self.exact.encode(" " + text, add_special_tokens=False).ids, np.int64)

    def encode_b(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids of B, and the number of each text's."""
        if not self.by_word:
            ids = self.pieces.encode(texts, num_threads=1)
            return (np.array([i for x in ids for i in x], np.int64),
                    np.array([len(x) for x in ids], np.int64))
        number: dict[str, int] = {}
        words, counts = [], []
        for text in texts:
            if not text:
                said = []
            elif "  " in text or text[0] == " " or text[-1] == " ":
                said = [x[1:] for x in _SEGMENT.findall(" " + text)]
            else:
                said = text.split(" ")
            counts.append(len(said))
            words += [number.setdefault(w, len(number)) for w in said]
        ids = self.pieces.encode(list(number), num_threads=1)
        if "" in number:  # a space that ends a text, which the encoder would leave out
            ids[number[""]] = [self.pieces.piece_to_id(_SPACE)]
        told = pa.array(ids, pa.list_(pa.int32())).take(pa.array(words, pa.int64()))
        sizes = pc.list_value_length(told).to_numpy(zero_copy_only=False).astype(np.int64)
        owner = np.repeat(np.arange(len(texts)), counts)
        return (told.flatten().to_numpy().astype(np.int64),
                np.bincount(owner, sizes, len(texts)).astype(np.int64))


def public_vocabularies(a: str = "byte_bpe_50k", b: str = "piece_bpe_32k") -> Vocabularies:
    """Two installed public vocabularies."""
    import public_tokenizers as public

    return Vocabularies(public.path(f"{a}.json"), public.path(f"{a}.tiktoken"), public.PATTERN,
                        public.path(f"{b}.model"))


def _bounds(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)])


class Aligned:
    """The tokens, groups and links of some texts."""

    def __init__(self, texts: list[str | None], v: Vocabularies):
        texts = [t or "" for t in texts]
        a = [v.encode_a(t) if t else np.zeros(0, np.int64) for t in texts]
        n_a = np.array([len(x) for x in a], np.int64)
        a = np.concatenate([*a, np.zeros(0, np.int64)])
        b, n_b = v.encode_b(texts)
        raw = [f" {t}".encode() if t else b"" for t in texts]
        same = [self._is(raw, ids, n, table, size) for ids, n, table, size in (
            (a, n_a, v.a_bytes, v.a_size), (b, n_b, v.b_bytes, v.b_size))]
        good = same[0] & same[1]
        if not good.all():
            a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
            n_a, n_b = n_a * good, n_b * good
        self.a, self.b, self.n_a, self.n_b, self.v = a, b, n_a, n_b, v
        # ends run through all texts: a text's last tokens end together
        end_a, end_b = np.cumsum(v.a_size[a]), np.cumsum(v.b_size[b])
        total = int(end_a[-1]) if len(end_a) else 0
        by_a, by_b = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
        by_a[end_a] = by_b[end_b] = True
        self.closes_a, self.closes_b = by_b[end_a], by_a[end_b]
        ends = np.flatnonzero(by_a | by_b)
        at_a, at_b = by_a[ends], by_b[ends]
        both = at_a & at_b
        self.link_a = a[np.cumsum(at_a) - at_a]
        self.link_b = b[np.cumsum(at_b) - at_b]
        alone = both & np.concatenate([[True], both[:-1]])[:len(both)]
        #: links of a group of one pair with the same bytes
        self.plain = alone & (v.same[self.link_a] == self.link_b)
        until = _bounds(n_a)
        groups = np.concatenate([[0], np.cumsum(self.closes_a)])
        self.n_groups = np.diff(groups[until])
        self.n_links = n_a + n_b - self.n_groups

    @staticmethod
    def _is(raw: list[bytes], ids: np.ndarray, counts: np.ndarray, table: pa.Array,
            size: np.ndarray) -> np.ndarray:
        """Whether the tokens of each text are its bytes."""
        joined = table.take(pa.array(ids)).buffers()[2]
        # unsigned bytes, which compare equal to those of `raw`
        joined = memoryview(joined if joined is not None else b"").cast("B")
        stops = np.concatenate([[0], np.cumsum(size[ids])])[_bounds(counts)].tolist()
        return np.array([joined[i:j] == x for i, j, x in zip(stops[:-1], stops[1:], raw)], bool)

    def digests(self) -> list[str]:
        """The digest of each text's groups as `a1,a2|b1;a3|b2,b3`; '' without tokens."""
        a, b, v = self.a, self.b, self.v
        last_a, last_b = np.flatnonzero(self.closes_a), np.flatnonzero(self.closes_b)
        group_a = np.cumsum(self.closes_a) - self.closes_a
        group_b = np.cumsum(self.closes_b) - self.closes_b
        before_b = np.concatenate([[0], last_b[:-1] + 1])
        at = np.empty(len(a) + len(b), np.int64)
        if len(a):
            at[np.arange(len(a)) + before_b[group_a]] = 2 * a + self.closes_a
            at[np.arange(len(b)) + (last_a + 1)[group_b]] = 2 * (v.n_a + b) + self.closes_b
        said = v.written.take(pa.array(at))
        offsets = np.frombuffer(said.buffers()[1], np.int64)[:len(said) + 1]
        text = memoryview(said.buffers()[2]) if len(said) else memoryview(b"")
        stops = offsets[_bounds(self.n_a + self.n_b)].tolist() if len(said) else [0] * (len(self.n_a) + 1)
        return [hashlib.sha256(text[i:j - 1]).hexdigest() if j > i else ""
                for i, j in zip(stops[:-1], stops[1:])]

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct link codes text by text: the codes, their numbers, how many codes each text has.

        The code of a plain link is its id of A; any other's lies beyond, by both ids.
        """
        v = self.v
        code = np.where(self.plain, self.link_a, v.n_a + self.link_a * v.n_b + self.link_b)
        owner = np.repeat(np.arange(len(self.n_a)), self.n_links)
        keys, counts = np.unique(owner << 32 | code, return_counts=True)
        return keys & 0xFFFFFFFF, counts, np.bincount(keys >> 32, minlength=len(self.n_a))


_TEXTS = ("block bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
          "groups_sha256 string, codes array<bigint>, counts array<bigint>")


def _encoded(batches: Iterator[pa.RecordBatch], make: Callable[[], Vocabularies]):
    v = make()
    block, size = TaskContext.get().partitionId() << 40, 0
    for batch in slices(batches, limit=min(BLOCK, SLICE)):
        more = pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0
        if size and size + more > BLOCK:
            block, size = block + 1, 0
        size += more
        found = Aligned(batch.column("text").to_pylist(), v)
        codes, counts, sizes = found.distinct()
        offsets = pa.array(_bounds(sizes), pa.int32())
        yield pa.record_batch({
            "doc_id": batch.column("doc_id"),
            "block": pa.array(np.full(batch.num_rows, block), pa.int64()),
            **{c: pa.array(getattr(found, c), pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")},
            "groups_sha256": pa.array(found.digests(), pa.string()),
            "codes": pa.ListArray.from_arrays(offsets, pa.array(codes, pa.int64())),
            "counts": pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64()))})


def _added(batches: Iterator[pa.RecordBatch], n_a: int):
    """(block, code, n): a block's links; those of plain pairs once a task, without a block."""
    plain = np.zeros(n_a, np.int64)
    for batch in batches:
        blocks = batch.column("block").to_numpy()
        # the rows of a block follow each other
        cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
        for start, stop in zip(cuts[:-1], cuts[1:]):
            codes, counts = (batch.column(c).slice(start, stop - start).flatten().to_numpy()
                             for c in ("codes", "counts"))
            is_plain = codes < n_a
            plain += np.bincount(codes[is_plain], counts[is_plain], n_a).astype(np.int64)
            keys, at = np.unique(codes[~is_plain], return_inverse=True)
            total = np.bincount(at, counts[~is_plain], len(keys)).astype(np.int64)
            yield pa.record_batch({"block": pa.array(np.repeat(blocks[start:start + 1], len(keys))),
                                   "code": pa.array(keys), "n": pa.array(total)})
    used = np.flatnonzero(plain)
    yield pa.record_batch({"block": pa.nulls(len(used), pa.int64()), "code": pa.array(used, pa.int64()),
                           "n": pa.array(plain[used], pa.int64())})


def link_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                make: Callable[[], Vocabularies] = public_vocabularies
                ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts, links, pairs), written: encoded rows, blocks' links, and the corpus counts of id pairs.

    `pairs` are (a, b, n, best): n links corpus-wide, best if no other pair of b has more.
    """
    v = make()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    texts = cut_lineage(rows.mapInArrow(lambda b: _encoded(b, make), f"doc_id {kind}, {_TEXTS}"),
                        "aligned")
    n_a, n_b, same = v.n_a, v.n_b, v.same
    links = cut_lineage(texts.select("block", "codes", "counts").mapInArrow(
        lambda b: _added(b, n_a), "block bigint, code bigint, n bigint"), "links")
    by_code = links.groupBy("code").agg(F.sum("n").alias("n"))
    # a plain pair may be linked in other groups too: both codes are the same pair
    twin = docs.sparkSession.createDataFrame(
        [(int(i), int(b)) for i, b in enumerate(same) if b >= 0], "code bigint, twin bigint")
    named = by_code.join(twin, "code", "left").select(
        F.when(F.col("code") < n_a, F.col("code")).otherwise(
            F.expr(f"(code - {n_a}) div {n_b}")).alias("a"),
        F.when(F.col("code") < n_a, F.col("twin")).otherwise((F.col("code") - n_a) % n_b).alias("b"),
        "n")
    totals = cut_lineage(named.groupBy("a", "b").agg(F.sum("n").alias("n")), "pairs")
    best = totals.groupBy("b").agg(F.max("n").alias("most"))
    pairs = totals.join(best, "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))
    return texts, links, cut_lineage(pairs, "pairs")


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          make: Callable[[], Vocabularies] = public_vocabularies) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row."""
    texts, links, pairs = link_counts(docs, id_col, text_col, make)
    v = make()
    n_a, n_b = v.n_a, v.n_b
    twin = docs.sparkSession.createDataFrame(
        [(int(i), int(b)) for i, b in enumerate(v.same) if b >= 0], "a bigint, b bigint")
    # as long as the vocabulary, whatever the corpus
    number, top = np.zeros(n_a, np.int64), np.zeros(n_a, bool)
    for row in pairs.join(F.broadcast(twin), ["a", "b"]).collect():
        number[row["a"]], top[row["a"]] = row["n"], row["best"]
    asked = links.filter("block is not null").select("block", "code")
    known = asked.join(pairs.select((n_a + F.col("a") * n_b + F.col("b")).alias("code"), "n", "best")
                       .hint("merge"), "code")
    kind = texts.schema["doc_id"].dataType.simpleString()
    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]

    def resolved(rows: pa.Table, counts: pa.Table) -> pa.Table:
        code, n, best = (counts.column(c).to_numpy() for c in ("code", "n", "best"))
        order = np.argsort(code)
        code, n, best = code[order], n[order], best[order]
        out = []
        for batch in rows.to_batches(max_chunksize=1000):
            sizes = pc.list_value_length(batch.column("codes")).to_numpy(zero_copy_only=False)
            codes = batch.column("codes").flatten().to_numpy()
            times = batch.column("counts").flatten().to_numpy()
            plain = codes < n_a
            place = np.searchsorted(code, codes[~plain])
            each, is_best = np.empty(len(codes), np.int64), np.empty(len(codes), bool)
            each[plain], is_best[plain] = number[codes[plain]], top[codes[plain]]
            each[~plain], is_best[~plain] = n[place], best[place]
            stops = _bounds(sizes)
            sums, bests = (_bounds(x)[stops] for x in (each * times, is_best * times))
            out.append(pa.record_batch({
                **{c: batch.column(c) for c in kept}, "n_best": pa.array(np.diff(bests)),
                "count_sum": pa.array(np.diff(sums)),
                "groups_sha256": batch.column("groups_sha256")}))
        return pa.Table.from_batches(out, None if out else pa.schema(
            [rows.schema.field("doc_id"), *((c, pa.int64()) for c in (*kept[1:], "n_best", "count_sum")),
             ("groups_sha256", pa.string())]))

    # as many tasks as blocks: a task holds a block or a few, however many there are
    blocks = max(texts.select("block").distinct().count(), 1)
    texts, known = texts.repartition(blocks, "block"), known.repartition(blocks, "block")
    return texts.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(
        resolved, f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
                  "n_best bigint, count_sum bigint, groups_sha256 string")
