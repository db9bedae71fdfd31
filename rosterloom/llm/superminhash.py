"""Near-duplicate documents by SuperMinHash signatures, banding, verification and grouping.

1. A document's set holds its distinct word n-grams as 64-bit hashes. SuperMinHash gives each
   element a random permutation of the signature's slots; slot p_j may get the value j + r_j. The
   ranks of one element are correlated (no rank comes twice), which lowers the variance, and once
   every slot holds a value below j the ranks from j on cannot matter: long texts stop after one
   or two ranks. Here rank j is drawn for all elements of a slice of documents at once.
2. Documents with the same set are one node. Bands of `ROWS` slots give each node `BANDS` keys; a
   pair of similarity 0.8 shares none of them with probability (1 - 0.8^6)^44 < 2e-6.
3. In each bucket every node is compared with the smallest one, the bucket's hub; pairs that pass
   on their full sets are links. All nodes of a bucket are in the cluster of its hub. In clusters
   whose nodes are then still in several components, the nodes outside the largest component are
   compared with all nodes of other components, in tiles of bounded size that return links only.
   So every pair that shares a bucket is compared or already connected, and a group of thousands
   of copies costs one comparison a copy, not one a pair.
4. Components come from alternating star contraction (`graph.components`).

Nulls, empty texts and texts without words have the empty set and are linked with nothing. Texts
with fewer than n words have their whole word sequence as their one shingle. Rows with equal ids
are one node; rows with a null id are linked with nothing (component null).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.groups import free_name, lookup
from ..session import cut_lineage
from .common import mix64, slices
from .graph import components

BANDS, ROWS = 44, 6
#: Nodes and shingles of a tile, on average.
TILE, TILE_SHINGLES = 512, 1 << 20
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; A-Z are lower-cased, nothing else."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = min(n, len(words))
    out = np.full(len(h) - n + 1, np.uint64(n))
    for i in range(n):
        out = mix64(out * _GOLDEN + h[i:len(h) - n + 1 + i])
    return np.unique(out)


def signatures(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """SuperMinHash signatures of non-empty sets, one row each: rank * 2^40 + random part."""
    sig = np.full(len(sets) * slots, np.iinfo(np.uint64).max, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    element = mix64(np.concatenate(sets) + _GOLDEN)
    perm = None
    for j in range(slots):
        draw = mix64(element + np.uint64((j + 1) * int(_GOLDEN) % (1 << 64)))
        k = j + (((draw & np.uint64(0xFFFFFF)) * np.uint64(slots - j)) >> np.uint64(24)).astype(np.int64)
        if perm is None:
            place = k
        else:
            at = np.arange(len(perm))
            place = perm[at, k].astype(np.int64)
            perm[at, k] = perm[:, j]
        np.minimum.at(sig, owner * slots + place, (np.uint64(j) << np.uint64(40)) | (draw >> np.uint64(24)))
        # a slot whose rank is at most j can't be lowered by rank j + 1
        done = (sig.reshape(-1, slots) >> np.uint64(40)).max(1) <= j
        if done.all():
            break
        alive = ~done[owner]
        if perm is None:
            perm = np.tile(np.arange(slots, dtype=np.int16), (int(alive.sum()), 1))
            perm[np.arange(len(perm)), k[alive]] = 0
        elif not alive.all():
            perm = perm[alive]
        owner, element = owner[alive], element[alive]
    return sig.reshape(-1, slots)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band, different between bands."""
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _GOLDEN, (len(sig), bands))
    parts = sig[:, :bands * rows].reshape(len(sig), bands, rows)
    for r in range(rows):
        keys = mix64(keys * _GOLDEN + parts[:, :, r])
    return keys


def _signed(batches: Iterator[pa.RecordBatch], n: int, bands: int, rows: int):
    # few elements at a time: a rank's permutations take 2 * slots bytes an element
    for batch in slices(batches, limit=256 << 10):
        sets = [shingles(t, n) for t in batch.column("text").to_pylist()]
        full = [i for i, s in enumerate(sets) if len(s)]
        keys: list = [None] * len(sets)
        if full:
            found = band_keys(signatures([sets[i] for i in full], bands * rows), bands, rows)
            for i, row in zip(full, found.view(np.int64)):
                keys[i] = row
        yield pa.record_batch({
            "node": batch.column("node"),
            "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
            "set_key": pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                                 if len(s) else None for s in sets], pa.binary()),
            "bands": pa.array(keys, pa.list_(pa.int64()))})


def _shingled(batches: Iterator[pa.RecordBatch], n: int):
    for batch in slices(batches):
        yield pa.record_batch({
            "node": batch.column("node"),
            "shingles": pa.array([shingles(t, n).view(np.int64)
                                  for t in batch.column("text").to_pylist()],
                                 pa.list_(pa.int64()))})


def _sets_of(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All shingles of a table's rows, and the row of each."""
    column = t.column("shingles").combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    return column.flatten().to_numpy(), np.repeat(np.arange(t.num_rows), sizes)


def overlaps(a: pa.Table, b: pa.Table, width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of each row of `a` with each row of `b`."""
    (x, row_x), (y, row_y) = _sets_of(a), _sets_of(b)
    both = np.intersect1d(x, y)
    out = np.zeros((a.num_rows, b.num_rows), np.float32)

    def places(values: np.ndarray, rows: np.ndarray):
        at = np.searchsorted(both, values)
        found = np.flatnonzero(np.append(both, 0)[at] == values)
        found = found[at[found] < len(both)]
        order = found[np.argsort(at[found], kind="stable")]
        return at[order], rows[order]

    (at_x, row_x), (at_y, row_y) = places(x, row_x), places(y, row_y)
    for low in range(0, len(both), width):
        sides = []
        for at, row, n in ((at_x, row_x, a.num_rows), (at_y, row_y, b.num_rows)):
            i, j = np.searchsorted(at, [low, low + width])
            side = np.zeros((n, width), np.float32)
            side[row[i:j], at[i:j] - low] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    return out.astype(np.int64)


def _tile_links(a: pa.Table, b: pa.Table, percent: int) -> pa.Table:
    """Links between rows of two tiles that are in different components."""
    left, right = np.empty(0, np.int64), np.empty(0, np.int64)
    if a.num_rows and b.num_rows:
        common = overlaps(a, b)
        size_a, size_b = (t.column("n").to_numpy().astype(np.int64) for t in (a, b))
        close = 100 * common >= percent * (size_a[:, None] + size_b[None, :] - common)
        close &= a.column("component").to_numpy()[:, None] != b.column("component").to_numpy()[None, :]
        i, j = np.nonzero(close)
        left, right = a.column("node").to_numpy()[i], b.column("node").to_numpy()[j]
    return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})


def _links_across(pairs: DataFrame, found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between nodes of one hub's cluster that are in different components so far.

    `pairs` holds (hub a, node b). Only nodes outside the cluster's largest component are put
    against the others; both sides are dealt into tiles.
    """
    nodes = lookup(pairs.select(F.col("a").alias("hub"), F.col("b").alias("node")), found, ["node"])
    nodes = lookup(nodes.withColumn("component", F.coalesce("component", "node")),
                   sets.select("node", "n"), ["node"])
    sizes = nodes.groupBy("hub", "component").agg(F.count(F.lit(1)).alias("nodes"), F.sum("n").alias("n"))
    whole = sizes.groupBy("hub").agg(
        F.max(F.struct("nodes", "component", "n")).alias("top"), F.sum("nodes").alias("nodes"),
        F.sum("n").alias("n")).filter("nodes > top.nodes")

    def tiles(count, shingles_):
        return F.greatest(F.ceil(count / TILE), F.ceil(shingles_ / TILE_SHINGLES)).cast("int")

    plan = whole.select("hub", F.col("top.component").alias("largest"),
                        tiles(F.col("nodes"), F.col("n")).alias("all_tiles"),
                        tiles(F.col("nodes") - F.col("top.nodes"), F.col("n") - F.col("top.n"))
                        .alias("some_tiles"))
    open_ = cut_lineage(lookup(nodes.drop("n"), plan, ["hub"], "inner"), "minhash")
    full = lookup(open_, sets, ["node"], "inner")

    def dealt(rows: DataFrame, own: str, own_tiles: str, other: str, other_tiles: str) -> DataFrame:
        # new names for the columns: both sides come from the same rows
        return rows.select(
            F.pmod(F.xxhash64("node"), F.col(own_tiles)).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.col(other_tiles) - 1)).alias(other),
            *[F.col(c).alias(c) for c in ("hub", "node", "component", "n", "shingles")]
        ).groupBy("hub", "i", "j")

    some = dealt(full.filter("component <> largest"), "i", "some_tiles", "j", "all_tiles")
    every = dealt(full, "j", "all_tiles", "i", "some_tiles")
    return some.cogroup(every).applyInArrow(lambda a, b: _tile_links(a, b, percent),
                                            "a bigint, b bigint")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity: 100 * common >= percent * union."""
    one = lookup(pairs.withColumn("node", F.col("a")), sets, ["node"], "inner")
    one = one.select("a", "b", F.col("shingles").alias("left"))
    two = lookup(one.withColumn("node", F.col("b")), sets, ["node"], "inner")
    common = F.size(F.array_intersect("left", "shingles"))
    union = F.size("left") + F.size("shingles") - common
    return two.filter(100 * common >= percent * union).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5,
                    percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of `docs`.

    Links join documents whose distinct word n-grams reach Jaccard similarity percent/100.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("node"), F.col(text_col).alias("text"))
    signed = cut_lineage(texts.mapInArrow(
        lambda b: _signed(b, n, bands, rows),
        "node bigint, n_shingles bigint, set_key binary, bands array<bigint>"), "minhash")
    usable = signed.filter("node IS NOT NULL AND set_key IS NOT NULL")
    first = cut_lineage(usable.groupBy("set_key").agg(F.min("node").alias("rep")), "minhash")
    buckets = (lookup(usable, first, ["set_key"], "inner").filter("node = rep")
               .select("node", F.explode("bands").alias("bucket")))
    hubs = cut_lineage(buckets.groupBy("bucket").agg(
        F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "minhash")
    pairs = cut_lineage(lookup(buckets, hubs, ["bucket"], "inner").filter("node <> hub").select(
        F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "minhash")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    # the same plan at every size: both sides are shuffled, candidates are too many to broadcast
    sets = cut_lineage(texts.join(nodes.hint("merge"), "node", "left_semi").mapInArrow(
        lambda b: _shingled(b, n), "node bigint, shingles array<bigint>").withColumn(
        "n", F.size("shingles")), "minhash")
    links = cut_lineage(_verified(pairs, sets, percent), "minhash")
    found = components(links)
    more = cut_lineage(_links_across(pairs, found, sets, percent), "minhash")
    if not more.isEmpty():
        found = components(links.unionByName(more))

    rows_ = lookup(signed.drop("bands"), first, ["set_key"])
    rows_ = lookup(rows_, found.select(F.col("node").alias("rep"), "component"), ["rep"])
    label = F.coalesce("component", "rep", "node")
    # an id on several rows is one document: all its rows are in one component
    return rows_.select(
        F.col("node").alias(id_col), "n_shingles", label.alias("component_id"),
        F.col("node").eqNullSafe(label).alias("kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5,
                 percent: int = 80) -> DataFrame:
    """The rows of `docs`, all columns, that stay: one of each group, the smallest id.

    Each row is decided by its own text, so different texts of one id stay. Of rows with equal ids
    and texts one stays; rows with a null id all stay.
    """
    # row numbers are written: they must be the same in every later read
    row = free_name("_row", docs)
    rows = cut_lineage(docs.withColumn(row, F.monotonically_increasing_id()), "minhash")
    named = rows.filter(F.col(id_col).isNotNull())
    ids = named.select(F.col(row).alias("_of"), F.col(id_col).cast("bigint").alias("_id"),
                       F.sha2(text_col, 256).alias("_digest"))
    grouped = near_duplicates(named, row, text_col, n, percent).select(
        F.col(row).alias("_node"), "n_shingles", "component_id")
    grouped = grouped.join(ids.hint("merge"), F.col("_node") == F.col("_of"))
    # texts without words are no near copies of anything but themselves under the same id
    bare = F.col("n_shingles") == 0
    kept = grouped.groupBy(
        F.when(~bare, F.col("component_id")).alias("_component"), F.when(bare, F.col("_id")).alias("_own"),
        F.when(bare, F.col("_digest")).alias("_bare")).agg(
        F.min(F.struct("_id", "_of")).alias("_first"))
    stays = free_name("_kept", rows)
    kept = kept.select(F.col("_first._of").alias(stays))
    stay = rows.join(kept.hint("merge"), F.col(row) == F.col(stays), "left_semi")
    return stay.unionByName(rows.filter(F.col(id_col).isNull())).drop(row)
