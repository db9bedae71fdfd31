"""Readers. Schemas are always explicit; checks of rows run as filters, never on the driver."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text, vocab
from ..operators.groups import lookup
from ..session import cut_lineage
from .csv_records import read_records

ROSTER_HEADERS = ("STATE", "NAME", "CITY", "URL")


def read_containers(spark: SparkSession, path: str, record: T.StructType | str,
                    array: str = "museums", skip_bad: bool = False,
                    multi_line: bool = True) -> DataFrame:
    """Records out of container documents `{…, museums: [record, …]}`.

    Strict mode aborts on malformed JSON. With `skip_bad` a malformed document is skipped and
    `state_code` is taken from the file name.
    """
    if isinstance(record, str):
        record = T.StructType.fromDDL(record)
    envelope = T.StructType([
        T.StructField("state", T.StringType()), T.StructField("state_code", T.StringType()),
        T.StructField("last_updated", T.StringType()),
        T.StructField(array, T.ArrayType(record))])
    reader = spark.read.option("multiLine", multi_line).option("recursiveFileLookup", "false")
    if not skip_bad:
        docs = reader.schema(envelope).option("mode", "FAILFAST").json(path)
        return docs.select("state_code", F.explode(array).alias("r")).select("state_code", "r.*")
    checked = T.StructType([*envelope.fields, T.StructField("_corrupt_record", T.StringType())])
    docs = (reader.schema(checked).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))
    stem = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(\.json)?$", 1)
    good = docs.filter(F.col("_corrupt_record").isNull())
    return good.select(stem.alias("state_code"), F.explode(array).alias("r")).select(
        "state_code", "r.*")


def bad_containers(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Files with malformed documents, for the report that goes with `skip_bad`."""
    schema = "museums ARRAY<STRUCT<museum_id: STRING>>, _corrupt_record STRING"
    docs = (spark.read.schema(schema).option("multiLine", multi_line)
            .option("mode", "PERMISSIVE").json(path))
    # Spark refuses to read the corrupt-record column alone, so a second column is touched
    touched = F.coalesce(F.size("museums"), F.lit(0)) >= 0
    return docs.filter(F.col("_corrupt_record").isNotNull() & touched).select(
        F.col("_metadata.file_path").alias("file"))


def check_headers(found: Sequence[str], required: Sequence[str]) -> None:
    missing = [h for h in required if h not in found]
    if missing:
        raise ValueError(f"missing headers {missing}; found {list(found)}")


def _file_offsets(files: Sequence[tuple[str, list[str], int]], required: Sequence[str]
                  ) -> tuple[list[tuple[str, list[str], int]], list[str]]:
    """(file, header, records before it) of files in order, and the names all of them share."""
    names, table, before = None, [], 0
    for file, header, n in files:
        header = [cell.strip().lstrip("\ufeff") if cell else "" for cell in header]
        check_headers(header, required)
        names = names or header
        if sorted(header) != sorted(names):
            raise ValueError(f"{file}: headers {header} differ from {names}")
        table.append((file, header, before))
        before += n
    return table, names or []


def _csv_rows(spark: SparkSession, path: str, required: Sequence[str], multi_line: bool,
              row_no: str) -> tuple[DataFrame, list[str]]:
    """All CSV records below `path` with `_cells`, their file's `_header`, and the row number.

    Every file has its own header, in its own order; all must have the same names. Row numbers
    count from 1 through the files in order of their paths. With `multi_line` a quoted field may
    hold line breaks, also across the splits of a file; without it each line is a record, and one
    that does not fit its header stops the job instead of being lost. The driver sees the headers
    and the number of records of each split, one row a split.
    """
    if not multi_line:
        return _csv_lines(spark, path, required, row_no)
    records = read_records(spark, path)
    # one row a file
    counts = {r["file"]: r["n"] for r in records.groupBy("file").agg(F.count(F.lit(1)).alias("n")).collect()}
    heads = sorted((r["file"], next(csv.reader([r["value"]])), counts[r["file"]] - 1)
                   for r in records.filter("record = 0").collect())
    table, names = _file_offsets(heads, required)
    width = max((len(header) for _, header, _ in table), default=1)
    schema = ", ".join([*(f"c{i} STRING" for i in range(width)), "_bad STRING"])
    cells = F.from_csv("value", schema, {
        "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    offsets = spark.createDataFrame(table, "_file string, _header array<string>, _before bigint")
    rows = records.filter("record > 0").select(F.col("file").alias("_file"), "record", cells.alias("_c"))
    # one row a file, which the driver has already: no record is shuffled to find its header
    found = lookup(rows, F.broadcast(offsets), ["_file"]).select(
        "_file", "_header", F.array(*[f"_c.c{i}" for i in range(width)]).alias("_cells"),
        (F.col("_before") + F.col("record")).alias(row_no))
    return found, names


def _csv_lines(spark: SparkSession, path: str, required: Sequence[str], row_no: str
               ) -> tuple[DataFrame, list[str]]:
    """`_csv_rows` of files in which every record is a line."""
    plain = spark.read.options(header=False, escape='"')
    width = len(plain.csv(path).columns)
    schema = ", ".join([*(f"c{i} STRING" for i in range(width)), "_bad STRING"])
    raw = plain.schema(schema).options(mode="PERMISSIVE", columnNameOfCorruptRecord="_bad").csv(path)
    rows = cut_lineage(raw.select(
        F.array(*[f"c{i}" for i in range(width)]).alias("_cells"), "_bad",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id")), "csv")
    splits = sorted(rows.groupBy("_file", "_block").agg(
        F.count(F.lit(1)).alias("n"), F.min("_id").alias("first"),
        F.min_by(F.struct("_cells", "_bad"), "_id").alias("head")).collect())
    heads: dict[str, tuple] = {}
    for file, _, n, _, head in splits:
        if file not in heads:
            if head["_bad"] is not None:
                raise ValueError(f"{file}: more than {width} columns")
            heads[file] = (head["_cells"], n - 1)
        else:
            heads[file] = (heads[file][0], heads[file][1] + n)
    table, names = _file_offsets([(f, h, n) for f, (h, n) in heads.items()], required)
    header, before = {f: h for f, h, _ in table}, {f: b for f, _, b in table}
    offsets, last = [], None
    for file, block, n, first, _ in splits:
        starts, last = file != last, file
        # rows of a split are numbered without gaps in the order of the file
        offsets.append((file, block, header[file], first if starts else first - 1, before[file]))
        before[file] += n - starts
    offsets = spark.createDataFrame(
        offsets, "_file string, _block bigint, _header array<string>, _zero bigint, _before bigint")
    found = lookup(rows, offsets, ["_file", "_block"]).withColumn(
        row_no, F.col("_before") + F.col("_id") - F.col("_zero")).filter(F.col("_id") > F.col("_zero"))
    message = F.concat(F.lit("broken record: "), "_bad")
    # a filter on every row: leaving out columns can't prune it
    return found.filter(F.when(F.col("_bad").isNull(), F.lit(True)).otherwise(
        F.raise_error(message).cast("boolean"))), names


def _cell(name: str) -> Column:
    """The field of a record under a header name, the position being that of its own file."""
    return F.get("_cells", (F.array_position("_header", name) - 1).cast("int"))


def read_roster(spark: SparkSession, path: str, strict: bool = True, multi_line: bool = True,
                row_no: str = "row_no") -> DataFrame:
    """Roster CSV with its row number and stripped STATE, NAME, CITY, URL.

    The header of each file must hold the four names, in any order; with `strict` any row without
    state, name or a valid http(s) URL aborts the job, whichever columns that job reads.
    """
    raw, _ = _csv_rows(spark, path, ROSTER_HEADERS, multi_line, row_no)
    rows = raw.select(row_no, *[text.strip(F.coalesce(_cell(h), F.lit(""))).alias(h)
                                for h in ROSTER_HEADERS])
    if not strict:
        return rows
    ok = ((F.col("STATE") != "") & (F.col("NAME") != "") & text.is_http_url("URL"))
    message = F.concat(F.lit("invalid roster row: "), F.to_json(F.struct(row_no, *ROSTER_HEADERS)))
    return rows.filter(F.when(ok, F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))


def read_external(spark: SparkSession, path: str, state: str, multi_line: bool = True,
                  row_no: str = "row_no") -> DataFrame:
    """External CSV (row number, then all columns as strings) without rows of a blank state."""
    raw, names = _csv_rows(spark, path, [state], multi_line, row_no)
    rows = raw.select(row_no, *[_cell(n).alias(n) for n in names])
    return rows.withColumn(state, text.strip(state)).filter(
        F.coalesce(F.col(f"`{state}`") != "", F.lit(False)))


def resolve_sheet(df: DataFrame, row_no: str,
                  headers: Sequence[tuple[str, str, bool]] = vocab.SHEET_HEADERS,
                  name_field: str = "museum_name") -> DataFrame:
    """Typed columns of a curated sheet whose headers only contain the expected names.

    The first column whose header contains the expected one (any case) is taken; integers are
    truncated numbers; rows without a name are dropped.
    """
    out = [F.col(row_no)]
    seen = []
    for expected, field, is_int in headers:
        match = next((c for c in df.columns if expected.lower() in c.lower()), None)
        if match is None:
            continue
        seen.append(field)
        c = F.col(f"`{match}`").cast("string")
        value = c.try_cast("double").cast("int") if is_int else text.strip(c)
        out.append(value.alias(field))
    check_headers(seen, [name_field])
    return df.select(*out).filter(F.coalesce(F.col(name_field) != "", F.lit(False)))


def sheet_entries(sheet: DataFrame, row_no: str, name: str, payload: Sequence[str]) -> DataFrame:
    """One entry per normalised name: position of its first row, values of its last one."""
    return (sheet.withColumn("name_key", text.plain_name(name)).groupBy("name_key")
            .agg(F.min(row_no).alias("position"),
                 F.max_by(F.struct(*payload), F.col(row_no)).alias("_row"))
            .select("name_key", "position", *[F.col(f"_row.{c}").alias(c) for c in payload]))


def read_caches(spark: SparkSession, path: str, schema: str, file_name: str,
                key_pattern: str = r"/([^/]+)/cache/[^/]+$", key: str = "museum_id",
                multi_line: bool = True) -> DataFrame:
    """All cache files of one kind below `path` in one scan; the key comes from the path
    unless the content has it."""
    docs = (spark.read.schema(schema).option("multiLine", multi_line)
            .option("recursiveFileLookup", "true").option("pathGlobFilter", file_name).json(path))
    from_path = F.regexp_extract(F.col("_metadata.file_path"), key_pattern, 1)
    if key in docs.columns:
        return docs.withColumn(key, F.coalesce(F.col(key), from_path))
    return docs.select(from_path.alias(key), "*")


def key_maps(df: DataFrame, id_col: str, city: str, name: str) -> DataFrame:
    """folder hash and readable alias per id, as a table."""
    return df.select(text.folder_hash(id_col).alias("folder_hash"), F.col(id_col),
                     text.slug_alias(city, name, id_col).alias("slug_alias"))


def read_key_map(spark: SparkSession, path: str, key: str, value: str,
                 one_per_file: bool = True) -> DataFrame:
    """`{key: value, …}` JSON documents (one per file or one per line) as rows."""
    doc = spark.read.text(path, wholetext=one_per_file)
    pairs = F.from_json("value", "map<string,string>")
    return doc.select(F.explode(pairs).alias(key, value))
