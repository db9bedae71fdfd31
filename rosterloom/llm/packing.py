"""Packing tokenized documents into fixed-length sequences by best-two-fit.

A document is the ids of its text and one end id. Only documents longer than a sequence are cut:
into full pieces, the first piece being the shorter one. Full pieces are sequences of their own.
The others are dealt at random into groups of some ten thousand pieces, each packed in one task:
a bin is filled greedily (the longest piece that still fits, again and again); then, if two
unpacked pieces fill the gap left without the bin's smallest piece more tightly than that piece
did, they replace it. A group leaves at most its last few bins half empty, whatever its size, so
the result differs from packing everything at once by less than a bin in thousands.

Null texts are empty: one piece with the end id. Null and repeated ids are kept as they are; each
row is packed as a document of its own.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import slices

LENGTH = 2048
#: Pieces packed together, on average.
GROUP = 32_768
#: Texts are tokenized in parts of about this many characters.
PART = 50_000
_BREAK = re.compile(r"(?<=\S) (?=\S)")


class Encoder:
    """Token ids of a text by a byte-level BPE vocabulary with one special token.

    `vocabulary` is the vocabulary as a `tokenizers` file; `ranks` is the same vocabulary as
    ranks, with which `tiktoken` gives the same ids in a quarter of the time. A text holding the
    special token's string has its id there, as `tokenizers` does it.
    """

    def __init__(self, vocabulary: str, ranks: str, pattern: str,
                 special: str = "<|endoftext|>", special_id: int = 50256):
        import base64

        import tiktoken

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table,
                                      special_tokens={})
        self.vocabulary, self.special, self.special_id = vocabulary, special, special_id
        self.exact = None

    def _part(self, text: str) -> np.ndarray:
        try:
            return np.array(self.fast.encode_ordinary(text), np.uint32)
        except BaseException as error:  # noqa: BLE001  its regex engine gives up by a panic
            if isinstance(error, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
        if self.exact is None:
            from tokenizers import Tokenizer

            self.exact = Tokenizer.from_file(self.vocabulary)
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)

    def parts(self, text: str) -> Iterator[np.ndarray]:
        """The ids in parts, cut where a single space parts two words: no token crosses it."""
        for i, plain in enumerate(text.split(self.special)):
            if i:
                yield np.array([self.special_id], np.uint32)
            start = 0
            while len(plain) - start > 2 * PART:
                cut = _BREAK.search(plain, start + PART)
                if not cut:
                    break
                yield self._part(plain[start:cut.start()])
                start = cut.start()
            if start < len(plain):
                yield self._part(plain[start:])


def public_encoder(name: str = "byte_bpe_50k") -> Encoder:
    """The encoder of an installed public vocabulary."""
    import public_tokenizers

    return Encoder(public_tokenizers.path(f"{name}.json"), public_tokenizers.path(f"{name}.tiktoken"),
                   public_tokenizers.PATTERN)


def _pieces(batches: Iterator[pa.RecordBatch], make_encoder, length: int, end_id: int, with_ids: bool):
    encoder = make_encoder()
    for batch in slices(batches, limit=1 << 20):
        doc, no, start, size, crc, ids = [], [], [], [], [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            every = np.concatenate([*encoder.parts(text or ""), np.array([end_id], np.uint32)])
            first = len(every) % length or length
            cuts = [0, *range(first, len(every) + 1, length)] if len(every) > length else [
                0, len(every)]
            for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                raw = every[a:b].astype("<u4").tobytes()
                doc.append(i)
                no.append(k)
                start.append(a)
                size.append(b - a)
                crc.append(zlib.crc32(raw))
                if with_ids:
                    ids.append(raw)
        columns = {"doc_id": batch.column("doc_id").take(pa.array(doc, pa.int64())),
                   "piece": pa.array(no, pa.int32()), "start": pa.array(start, pa.int64()),
                   "length": pa.array(size, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
        if with_ids:
            columns["ids"] = pa.array(ids, pa.binary())
        yield pa.record_batch(columns)


def best_two_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of indexes into `lengths`; every length is from 1 to `capacity`."""
    stacks: dict[int, list[int]] = {}
    for i, n in enumerate(lengths):
        stacks.setdefault(n, []).append(i)
    # bit n of `have`, and bit capacity - n of `mirror`: some piece of length n is unpacked
    have = sum(1 << n for n in stacks)
    mirror = sum(1 << (capacity - n) for n in stacks)
    bins = []

    def take(n: int) -> int:
        nonlocal have, mirror
        i = stacks[n].pop()
        if not stacks[n]:
            have ^= 1 << n
            mirror ^= 1 << (capacity - n)
        return i

    def put_back(i: int) -> None:
        nonlocal have, mirror
        n = lengths[i]
        if not stacks[n]:
            have ^= 1 << n
            mirror ^= 1 << (capacity - n)
        stacks[n].append(i)

    def two(total: int) -> tuple[int, int] | None:
        """Two unpacked lengths of this sum."""
        both = have & (mirror >> (capacity - total)) if total <= capacity else 0
        while both:
            a = both.bit_length() - 1
            if 2 * a != total or len(stacks[a]) > 1:
                return a, total - a
            both ^= 1 << a
        return None

    while have:
        gap, content = capacity, []
        while fits := have & ((1 << (gap + 1)) - 1):
            n = fits.bit_length() - 1
            content.append(take(n))
            gap -= n
        if gap and len(content) > 1:
            smallest = content[-1]
            room = gap + lengths[smallest]
            for total in range(room, lengths[smallest], -1):
                if pair := two(total):
                    content[-1:] = [take(pair[0]), take(pair[1])]
                    put_back(smallest)
                    break
        bins.append(content)
    return bins


def _packed(table: pa.Table, capacity: int) -> pa.Table:
    lengths = table.column("length").to_pylist()
    group = table.column("_group")[0].as_py()
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for number, content in enumerate(best_two_fit(lengths, capacity)):
        at = 0
        for i in content:
            sequence[i], offset[i] = (group << 32) + number, at
            at += lengths[i]
    return table.drop_columns(["_group"]).append_column("sequence_id", pa.array(sequence)).append_column(
        "offset", pa.array(offset))


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
           end_id: int = 0, with_ids: bool = False, make_encoder=public_encoder) -> DataFrame:
    """One row a piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    `with_ids` adds the token ids as little-endian 32-bit numbers. `make_encoder` builds the
    encoder inside each task.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
              + ", ids binary" * with_ids)
    pieces = cut_lineage(rows.mapInArrow(
        lambda b: _pieces(b, make_encoder, length, end_id, with_ids), schema), "packing")
    # the written table's rows are numbered the same way in every attempt of a task
    pieces = pieces.withColumn("_row", F.monotonically_increasing_id())
    whole = pieces.filter(F.col("length") == length).select(
        *pieces.drop("_row").columns, (-1 - F.col("_row")).alias("sequence_id"),
        F.lit(0).cast("bigint").alias("offset"))
    parts = pieces.filter(F.col("length") < length)
    groups = max(1, -(-parts.count() // GROUP))
    dealt = parts.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups))).drop("_row")
    joined = dealt.groupBy("_group").applyInArrow(
        lambda t: _packed(t, length), schema + ", sequence_id bigint, offset bigint")
    return whole.unionByName(joined).withColumnRenamed("doc_id", id_col)
