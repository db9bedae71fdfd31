"""A trie of conversation prefixes: one node for each distinct sequence of first turns.

`rebuilt` makes the conversations, one row a turn: the first h turns of the group's base
conversation, then the conversation's own turns after its first h. Turns are ordered by `turn`,
nulls first, ties by the digest of role and text; null roles and texts are empty. Positions come
from sorted ranges of all turns, so a conversation with most of the rows is spread over tasks.

`prefix_nodes` takes depths in blocks. In a block every conversation is one row, at most `width`
turn digests long; rows are ranged by these digests into shards. A shard is a padded matrix of
turn ids (ranks of digests): numpy sorts it, the columns' changes against the row above, or-ed from
left to right, mark where nodes start, and `reduceat` adds up every depth. Nodes that hold a shard's
first or last row may go on in the next shard: their parts are put together by Spark. A conversation
that is the only one to go on beyond a block makes a chain of nodes, one for each of its turns; only
those that still share all turns enter the next, twice as wide block. So the number of rounds
follows the longest prefix that two conversations share, by its logarithm until `WIDEST`.

Rows without a conversation id belong to no conversation. An empty table gives no node. Columns
other than the four named ones are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.groups import lookup
from ..operators.order import numbered
from ..session import cut_lineage

#: Turns a conversation has in the first block of depths, and in the widest.
WIDTH, WIDEST = 64, 4096
#: Cells of a shard's matrix, on average: its conversations times the block's width.
CELLS = 1 << 21
NOTHING = hashlib.sha256(b"").hexdigest()
#: Places of a base conversation's turns that its group may take.
HEAD = 8


def rebuilt(turns: DataFrame, group: int = 5) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, id, size) a turn, and (conv_id, n) a conversation, after the exchange of heads.

    `id` is the hexadecimal digest of role and text, `size` the UTF-8 bytes of the text. The first h
    turns (h from 0 to 8, by the id's CRC) are those of conversation `conv_id - conv_id % group`.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = turns.filter("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").alias("turn"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("id"),
        F.octet_length(text).cast("bigint").alias("size"),
        F.monotonically_increasing_id().alias("row"))
    placed = numbered(said, [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("id"),
                             F.col("row")], "place").select("conv_id", "id", "size", "place")
    held = placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"), F.min("place").alias("first"))
    held = cut_lineage(held, "conversations")
    base = F.col("conv_id") - F.col("conv_id") % group
    convs = held.select("conv_id", "own", "first", base.alias("base"),
                        (F.crc32(F.col("conv_id").cast("string")) % (HEAD + 1)).alias("h"))
    bases = held.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    convs = cut_lineage(lookup(convs, bases, ["base"]).withColumn(
        "head", F.least("h", F.coalesce("base_own", F.lit(0)))).drop("base_own"), "conversations")

    at = lookup(placed, convs.drop("own"), ["conv_id"]).withColumn(
        "pos", F.col("place") - F.col("first") + 1)
    tails = at.filter("pos > h").select("conv_id", (F.col("head") + F.col("pos") - F.col("h")).alias("pos"),
                                        "id", "size")
    # at most HEAD turns of a base meet the at most 2 * group - 1 conversations of its group
    heads = at.filter(f"conv_id % {group} = 0 and pos <= {HEAD}").select(
        F.col("conv_id").alias("base"), "pos", "id", "size").join(
        convs.filter("head > 0").select("conv_id", "base", "head"), "base").filter("pos <= head")
    rows = tails.unionByName(heads.select("conv_id", "pos", "id", "size"))
    lengths = convs.select("conv_id", (F.col("head") + F.greatest(
        F.col("own") - F.col("h"), F.lit(0))).alias("n"))
    return rows, lengths


#: Columns of the result.
OUT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
       "ends_sha256")
_NODE_SQL = ("conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, "
             "n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, "
             "ends string, parent_key binary, key binary, path array<binary>, size bigint")
_KEPT = (*OUT, "parent_key", "key")
_KINDS = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(),
          "array<binary>": pa.list_(pa.binary())}
_NODE = pa.schema([(name, _KINDS[kind]) for name, kind in map(str.split, _NODE_SQL.split(", "))])


class _Shard:
    """The sorted matrix of a shard's rows, and what its depths add up to."""

    def __init__(self, table: pa.Table):
        n = table.num_rows
        ids, groups = table.column("ids").to_pylist(), table.column("group").to_pylist()
        lengths = np.fromiter((len(x) // 16 for x in ids), np.int64, n)
        words = np.frombuffer(b"".join(ids), ">u8").astype(np.uint64)
        # turn ids are ranks of digests, in the digests' order; 0 is the padding
        _, rank = np.unique(words.view([("high", "u8"), ("low", "u8")]), return_inverse=True)
        place = {g: i for i, g in enumerate(sorted(set(groups)))}
        first = np.fromiter((place[g] for g in groups), np.int64, n)
        width = int(lengths.max())
        inside = np.arange(width) < lengths[:, None]
        matrix = np.zeros((n, width), np.int32)
        matrix[inside] = rank + 1
        sizes = np.zeros((n, width + 1), np.int64)
        sizes[:, 1:][inside] = pc.list_flatten(table.column("sizes")).to_numpy()
        conv, left = (table.column(c).to_numpy() for c in ("conv_id", "left"))
        order = np.lexsort((conv, left > 0, *matrix.T[::-1], first))
        self.n, self.width = n, width
        self.lengths, self.conv, self.left = lengths[order], conv[order], left[order]
        self.more, self.sizes = self.left > 0, sizes[order]
        self.groups, self.ids = [groups[i] for i in order], [ids[i] for i in order]
        self.extra = {c: table.column(c).to_numpy()[order] for c in ("children", "leaves", "saved")}
        self.alone = table.column("alone").to_numpy()[order]
        first, matrix = first[order], matrix[order]
        # changed[i, d]: row i's first d turns (or its group) are not those of the row above
        self.changed = np.ones((n + 1, width + 1), bool)
        self.changed[1:n, 0] = first[1:] != first[:-1]
        self.changed[1:n, 1:] = matrix[1:] != matrix[:-1]
        self.changed = np.logical_or.accumulate(self.changed, axis=1)
        depths = np.arange(width + 1)
        self.present = self.lengths[:, None] >= depths
        self.starts = self.changed[:n] & self.present
        #: the row where the node of a row's first d turns starts
        self.top = np.maximum.accumulate(np.where(self.starts, np.arange(n)[:, None], -1), axis=0)
        # nodes that hold the first or last row are open: the next shard may hold more of them
        self.open = np.zeros((n, width + 1), bool)
        self.open[0] = self.present[0]
        self.open[self.top[-1][self.present[-1]], depths[self.present[-1]]] = True

    def key(self, row: int, depth: int) -> bytes:
        """A name for the node that all shards agree on."""
        if not depth:
            return self.groups[row]
        return hashlib.md5(self.groups[row] + self.ids[row][:16 * depth]).digest()

    def nodes(self, offset: int) -> Iterator[pa.RecordBatch]:
        """A batch of nodes for each depth; open nodes hold their key, path and last text's size."""
        n, rows, closed = self.n, np.arange(self.n), self.starts & ~self.open
        own = self.top[rows, self.lengths]
        # a row ends a leaf if the row below does not go on from it
        leaf = (self.changed[rows + 1, self.lengths] & ~self.more & ~self.open[own, self.lengths])
        members = np.cumsum(self.sizes[:, ::-1], axis=1)[:, ::-1]
        once = np.cumsum((self.sizes * closed)[:, ::-1], axis=1)[:, ::-1]
        above = np.zeros(n, np.int64)
        for d in range(self.width + 1):
            cuts = np.flatnonzero(self.changed[:n, d])
            kept = self.present[cuts, d]
            top = cuts[kept]
            if not len(top):
                break

            def added(values, cuts=cuts, kept=kept):
                return np.add.reduceat(values.astype(np.int64), cuts)[kept]

            ended = self.lengths == d
            beyond = ended & self.more
            children = added(self.extra["children"] * beyond)
            if d < self.width:
                children += added(closed[:, d + 1])
            smallest = np.zeros(n, np.int64)
            smallest[top] = np.minimum.reduceat(self.conv, cuts)[kept]
            opened = self.open[top, d]
            up = self.top[top, d - 1] if d else top
            # the smallest member of an open parent, or of one in the block above, is not known here
            known = ~self.open[up, d - 1] & (d > 1 or not offset) if d else np.zeros(len(top), bool)
            stops = np.append(cuts, n)[np.flatnonzero(kept) + 1]
            n_ended, n_beyond = added(ended & ~self.more), added(beyond)
            ends, digest = [None] * len(top), [NOTHING] * len(top)
            for k in np.flatnonzero((n_ended > 0) | opened).tolist():
                # those that end here come first in their node, by id
                said = ",".join(map(str, self.conv[top[k]:top[k] + n_ended[k]].tolist()))
                if opened[k]:
                    ends[k], digest[k] = said, None
                else:
                    digest[k] = hashlib.sha256(said.encode()).hexdigest()
            named = opened | (n_beyond > 0) | (d == 0)
            yield _batch(
                conv_id=smallest[top], depth=np.full(len(top), offset + d),
                parent_conv_id=[int(p) if k else None for p, k in zip(above[up], known)],
                n_convs=stops - top, n_children=children,
                n_leaves=added(leaf) + added(self.extra["leaves"] * self.more),
                saved_tokens=added(members[:, d] - once[:, d]) + added(self.extra["saved"] * self.more),
                ends_sha256=digest, ends=ends,
                parent_key=[None if k or not d else self.key(i, d - 1)
                            for i, k in zip(top.tolist(), known)],
                key=[self.key(i, d) if k else None for i, k in zip(top.tolist(), named)],
                path=[[self.key(i, e) for e in range(d + 1)] if k else None
                      for i, k in zip(top.tolist(), opened)],
                size=self.sizes[top, d])
            above = smallest
        # the first node of each conversation that goes on alone
        alone = np.flatnonzero(self.alone)
        if len(alone):
            yield _batch(
                conv_id=self.conv[alone], depth=offset + self.lengths[alone] + 1,
                parent_conv_id=[None] * len(alone), n_convs=np.ones(len(alone), np.int64),
                n_children=(self.left[alone] > 1).astype(np.int64),
                n_leaves=np.ones(len(alone), np.int64), saved_tokens=np.zeros(len(alone), np.int64),
                ends_sha256=[_ends(c) if last else NOTHING for c, last in zip(
                    self.conv[alone].tolist(), self.left[alone] == 1)],
                ends=[None] * len(alone),
                parent_key=[self.key(i, self.lengths[i]) for i in alone.tolist()],
                key=[None] * len(alone), path=[None] * len(alone), size=np.zeros(len(alone), np.int64))


def _ends(conv: int) -> str:
    return hashlib.sha256(str(conv).encode()).hexdigest()


def _batch(**columns) -> pa.RecordBatch:
    return pa.record_batch({f.name: pa.array(columns[f.name], f.type) for f in _NODE}, _NODE)


def _shards(batches: Iterator[pa.RecordBatch], offset: int) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if held:
        yield from _Shard(pa.Table.from_batches(held)).nodes(offset)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest a key of the texts in its rows, which follow each other in order."""
    key, running, done = None, None, []
    for batch in batches:
        for k, said in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
            if running is not None and k == key:
                running.update(b"," + said.encode())
                continue
            if running is not None:
                done.append((key, running.hexdigest()))
            key, running = k, hashlib.sha256(said.encode())
        yield pa.record_batch({"key": pa.array([k for k, _ in done], pa.binary()),
                               "digest": pa.array([x for _, x in done], pa.string())})
        done = []
    if running is not None:
        yield pa.record_batch({"key": pa.array([key], pa.binary()),
                               "digest": pa.array([running.hexdigest()], pa.string())})


def _joined_shards(parts: DataFrame) -> DataFrame:
    """All nodes of a block, the parts of open ones put together.

    An open node's children and descendants may be open too; each of them counts once, for every
    node on its path. There is one path of open nodes at each end of a shard.
    """
    whole = parts.filter("path is null")
    open_ = parts.filter("path is not null").groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"),
        F.max("parent_key").alias("parent_key"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"),
        F.sum("saved_tokens").alias("saved_tokens"), F.max("path").alias("path"),
        F.max("size").alias("size"))
    open_ = cut_lineage(open_, "trie-open")
    kids = open_.filter("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(
        F.count(F.lit(1)).alias("kids"))
    open_ = lookup(open_, kids, ["key"]).withColumn(
        "n_children", F.col("n_children") + F.coalesce("kids", F.lit(0))).drop("kids")
    below = open_.select(F.explode("path").alias("key"), "size",
                         (F.col("n_children") == 0).cast("bigint").alias("leaf")).groupBy("key").agg(
        F.sum("size").alias("sizes"), F.sum("leaf").alias("leaves"))
    digests = (parts.filter("path is not null and ends <> ''").select("key", "ends")
               .repartition("key").sortWithinPartitions("key", F.split_part(
                   "ends", F.lit(","), F.lit(1)).cast("bigint"))
               .mapInArrow(_digests, "key binary, digest string"))
    open_ = lookup(lookup(open_, below, ["key"]), digests, ["key"]).withColumns({
        "n_leaves": F.col("n_leaves") + F.col("leaves"),
        "saved_tokens": F.col("saved_tokens") - F.col("sizes"),
        "ends_sha256": F.coalesce("digest", F.lit(NOTHING)),
        "parent_conv_id": F.lit(None).cast("bigint")})
    return whole.select(*_KEPT).unionByName(open_.select(*_KEPT))


def prefix_nodes(rows: DataFrame, lengths: DataFrame, width: int = WIDTH,
                 widest: int = WIDEST, cells: int = CELLS) -> DataFrame:
    """The nodes of all conversations' prefixes.

    `rows` are turns (conv_id, pos from 1, id of 32 hexadecimal digits, size), `lengths` all
    conversations (conv_id, n turns, 0 too). Columns: conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    rows, lengths = cut_lineage(rows, "turns"), cut_lineage(lengths, "lengths")
    longest = lengths.agg(F.max("n")).first()[0]
    active = lengths.select("conv_id", "n", F.unhex(F.lit("")).alias("group"))
    blocks, chains, offset = [], [], 0
    while True:
        said = rows.filter((F.col("pos") > offset) & (F.col("pos") <= offset + width))
        if offset:
            said = lookup(said, active.select("conv_id"), ["conv_id"], "inner")
        # at most `width` turns a conversation
        turns = said.groupBy("conv_id").agg(
            F.array_sort(F.collect_list(F.struct("pos", "id", "size"))).alias("turns"))
        block = active.join(turns, "conv_id", "left").select(
            "conv_id", "group",
            F.unhex(F.coalesce(F.array_join("turns.id", ""), F.lit(""))).alias("ids"),
            F.coalesce("turns.size", F.array().cast("array<bigint>")).alias("sizes"),
            F.greatest(F.col("n") - offset - width, F.lit(0)).alias("left"))
        block = cut_lineage(block.withColumn("below", F.when(F.col("left") > 0, F.unhex(
            F.md5(F.concat("group", "ids"))))), "trie-block")
        shared = None
        if (longest or 0) > offset + width:
            more = block.filter("left > 0")
            together = more.groupBy("below").agg(F.count(F.lit(1)).alias("members"),
                                                 F.min("conv_id").alias("leader"))
            block = cut_lineage(lookup(more, together, ["below"]).unionByName(
                block.filter("left = 0"), allowMissingColumns=True), "trie-block")
            chains.append(block.filter("members = 1").select(
                "conv_id", F.lit(offset + width).alias("depth"),
                (F.col("left") + offset + width).alias("n")))
            shared = block.filter("members > 1")
        else:
            block = block.withColumns({"members": F.lit(None).cast("bigint"),
                                       "leader": F.lit(None).cast("bigint")})
        blocks.append((block, offset, width))
        if shared is None or shared.isEmpty():
            break
        active = shared.select("conv_id", (F.col("left") + offset + width).alias("n"),
                               F.col("below").alias("group"))
        offset, width = offset + width, min(2 * width, widest)

    # from the deepest block up: what lies below a block counts for the nodes in it
    nodes, totals = [], None
    for block, offset, width in reversed(blocks):
        if totals is None:
            totals = block.sparkSession.createDataFrame(
                [], "below binary, n_children bigint, n_leaves bigint, saved_tokens bigint")
        goes_on = F.coalesce(F.col("members") == 1, F.lit(False))
        leads = F.col("conv_id") == F.col("leader")

        def extra(name, alone, goes_on=goes_on, leads=leads):
            return F.coalesce(F.when(goes_on, F.lit(alone)).when(leads, F.col(name)), F.lit(0)).cast(
                "bigint")

        rows_in = lookup(block, totals, ["below"]).select(
            "conv_id", "group", "ids", "sizes", "left", goes_on.alias("alone"),
            extra("n_children", 1).alias("children"), extra("n_leaves", 1).alias("leaves"),
            extra("saved_tokens", 0).alias("saved"))
        shards = -(-block.count() * min(width, max(longest or 0, 1)) // cells) or 1
        parts = cut_lineage(
            rows_in.repartitionByRange(shards, "group", "ids", F.col("left") > 0, "conv_id")
            .mapInArrow(lambda b, o=offset: _shards(b, o), _NODE_SQL), "trie-parts")
        joined = cut_lineage(_joined_shards(parts), "trie-nodes")
        if offset:
            totals = joined.filter(F.col("depth") == offset).select(
                F.col("key").alias("below"), "n_children", "n_leaves", "saved_tokens")
            joined = joined.filter(F.col("depth") > offset)
        nodes.append(joined)

    every = nodes[0]
    for more in nodes[1:]:
        every = every.unionByName(more)
    names = every.filter("key is not null").select(F.col("key").alias("parent_key"),
                                                   F.col("conv_id").alias("named"))
    out = [*OUT]
    found = lookup(every.filter("parent_key is not null"), names, ["parent_key"]).withColumn(
        "parent_conv_id", F.col("named"))
    result = every.filter("parent_key is null").select(*out).unionByName(found.select(*out))
    for chain in chains:
        tail = lookup(rows, chain, ["conv_id"], "inner").filter(F.col("pos") > F.col("depth") + 1)
        result = result.unionByName(tail.select(
            "conv_id", F.col("pos").alias("depth"), F.col("conv_id").alias("parent_conv_id"),
            F.lit(1).cast("bigint").alias("n_convs"),
            (F.col("pos") < F.col("n")).cast("bigint").alias("n_children"),
            F.lit(1).cast("bigint").alias("n_leaves"), F.lit(0).cast("bigint").alias("saved_tokens"),
            F.when(F.col("pos") == F.col("n"), F.sha2(F.col("conv_id").cast("string"), 256))
            .otherwise(NOTHING).alias("ends_sha256")))
    return result


def prefix_trie(turns: DataFrame, group: int = 5) -> DataFrame:
    """The nodes over the rebuilt conversations of a table of turns."""
    return prefix_nodes(*rebuilt(turns, group))
