"""CSV records with quoted line breaks, read from all splits of a file at once.

Whether a line starts inside a quoted field depends on all lines before it. So the lines are read
twice, split by split and in order. The first pass finds for each split, for both states it may
start in, the state it ends in and the records that start in it: one row a split. From these the
driver knows the state and the number of records before every split. The second pass numbers the
records and lets single lines through; only the lines of records that span several, perhaps in
several splits, are brought together.

A quoted field starts at the start of a field only, so a quote inside a plain field opens nothing;
two quotes inside a quoted field are one. Empty lines between records are skipped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Lines a record may span; more come from a quote that is never closed.
MOST_LINES = 100_000
_QUOTED = re.compile(r'(^|,)"[^"]*(?:""[^"]*)*"(?!")')
_OPENS = re.compile(r'(?:^|,)"')
_CLOSES = re.compile(r'[^"]*(?:""[^"]*)*"(?!")')


def open_after(line: str, opened: bool) -> bool:
    """Whether a quoted field is open after a line, if one is or is not open before it."""
    if opened:
        found = _CLOSES.match(line)
        if not found:
            return True
        line = "_" + line[found.end():]
    return _OPENS.search(_QUOTED.sub(r"\1_", line)) is not None


class _Lines:
    """The lines of a batch that come from one split."""

    def __init__(self, batch: pa.RecordBatch):
        values = batch.column("value")
        self.n = batch.num_rows
        self.filled = np.asarray(pc.and_(pc.not_equal(values, ""), pc.not_equal(values, "\r")))
        quoted = np.flatnonzero(np.asarray(pc.match_substring(values, '"')))
        self.quoted = quoted.tolist()
        self.said = values.take(pa.array(quoted)).to_pylist()

    def walk(self, opened: bool) -> tuple[bool, np.ndarray, np.ndarray]:
        """The state at the end, the state before each line, and the lines that leave a field open."""
        inside, leaves = np.zeros(self.n, bool), np.zeros(self.n, bool)
        at = 0
        for i, line in zip(self.quoted, self.said):
            inside[at:i + 1] = opened
            leaves[at:i] = opened
            opened, at = open_after(line, opened), i + 1
            leaves[i] = opened
        inside[at:] = leaves[at:] = opened
        return opened, inside, leaves


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """Batches cut where another split begins."""
    for batch in batches:
        files, blocks = batch.column("file"), batch.column("block").to_numpy()
        names = pc.dictionary_encode(files)
        codes = names.indices.to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((codes[1:] != codes[:-1]) | (blocks[1:] != blocks[:-1])) + 1
        cuts = [0, *cuts.tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b > a:
                yield (files[a].as_py(), int(blocks[a])), batch.slice(a, b - a)


_SUMMARY = "file string, block bigint, start boolean, stop boolean, records bigint"


def _summarized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each split and state before it: the state after it and the records that start in it."""
    state: dict[tuple[str, int], dict[bool, tuple[bool, int]]] = {}
    for split, part in _by_split(batches):
        lines, now = _Lines(part), state.setdefault(split, {False: (False, 0), True: (True, 0)})
        for start, (opened, n) in now.items():
            opened, inside, _ = lines.walk(opened)
            now[start] = (opened, n + int((~inside & lines.filled).sum()))
    rows = [(*split, start, *found) for split, now in state.items() for start, found in now.items()]
    columns = list(zip(*rows)) or [()] * 5
    kinds = (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64())
    yield pa.record_batch({c: pa.array(x, k) for c, x, k in zip(
        ("file", "block", "start", "stop", "records"), columns, kinds)})


def _numbered(batches: Iterator[pa.RecordBatch], known: dict[tuple[str, int], tuple[bool, int]]):
    """Lines with their record's number in its file, and whether they are all of it."""
    state: dict[tuple[str, int], tuple[bool, int]] = {}
    for split, part in _by_split(batches):
        opened, n = state.get(split) or known[split]
        lines = _Lines(part)
        opened, inside, leaves = lines.walk(opened)
        begins = ~inside & lines.filled
        record = n + np.cumsum(begins) - 1
        state[split] = (opened, n + int(begins.sum()))
        alone = begins & ~leaves
        # empty lines between records go
        kept = begins | inside
        keep = pa.array(kept)
        yield pa.record_batch({
            "file": part.column("file").filter(keep), "block": part.column("block").filter(keep),
            "line": part.column("line").filter(keep), "value": part.column("value").filter(keep),
            "record": pa.array(record[kept], pa.int64()), "alone": pa.array(alone[kept])})


def read_records(spark: SparkSession, path: str, most_lines: int = MOST_LINES) -> DataFrame:
    """(file, record, value): the text of each record, and its number in its file from 0.

    Line breaks inside a record are `\\n`. A record of more than `most_lines` lines stops the job.
    """
    lines = spark.read.text(path, lineSep="\n").select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    found = lines.mapInArrow(_summarized, _SUMMARY).collect()
    ends = {(r["file"], r["block"], r["start"]): (r["stop"], r["records"]) for r in found}
    known: dict[tuple[str, int], tuple[bool, int]] = {}
    before, opened, n = None, False, 0
    for file, block in sorted({(r["file"], r["block"]) for r in found}):
        if file != before:
            before, opened, n = file, False, 0
        known[file, block] = (opened, n)
        opened, more = ends[file, block, opened]
        n += more
    numbered = cut_lineage(lines.mapInArrow(
        lambda b: _numbered(b, known),
        "file string, block bigint, line bigint, value string, record bigint, alone boolean"), "csv-lines")
    ended = F.regexp_replace("value", "\r$", "").alias("value")
    several = numbered.filter("NOT alone")
    long = several.groupBy("file", "record").count().filter(F.col("count") > most_lines).first()
    if long:
        raise ValueError(f"{long['file']}: record {long['record']} has {long['count']} lines; is a quote open?")
    # at most `most_lines` lines a record
    joined = several.groupBy("file", "record").agg(F.array_join(F.transform(F.array_sort(
        F.collect_list(F.struct("block", "line", "value"))), lambda x: x["value"]), "\n").alias("value"))
    joined = joined.select("file", "record", F.regexp_replace(F.regexp_replace(
        "value", "\r\n", "\n"), "\r$", "").alias("value"))
    return numbered.filter("alone").select("file", "record", ended).unionByName(joined)
