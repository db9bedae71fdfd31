"""Greedy in-batch dedupe of a roster: in row order, a row is dropped when an earlier kept
row already covers it.

Row s covers a later row r of the same block when the normalised URLs are equal (not empty),
or state and name are equal and either r has no city or the cities are equal (a kept row
without a city counts as city `unknown`).

The sequential rule is computed in rounds of two steps. First, a row whose every conflicting
earlier row is gone is kept, and rows covered by a newly kept row are dropped: a few
pre-aggregated minima, so a key shared by a third of the roster is no problem. Second, undecided
rows are dealt into blocks of bounded size, conflicting rows together and in order, and each
block decides by itself, in order, all that no earlier row of another block can change. So the
rounds follow the number of blocks a chain of conflicts goes through, not its length; and once a
block holds all undecided rows, it decides them all.
"""

from __future__ import annotations

from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..session import cut_lineage, scratch_path
from .components import connected_components, key_links
from .groups import lookup
from .order import numbered

#: Undecided rows one task decides in order.
BLOCK_ROWS = 100_000
_COLUMNS = ("_r", "_u", "_with_city", "_any_city", "_asks")


def _keyed(roster: DataFrame, roles: Mapping[str, str], row_no: str) -> DataFrame:
    """Each `row` with `keys`: its number, URL key, the two place keys it offers if kept, and the one it asks for."""
    low = {k: F.lower(text.strip(F.coalesce(F.col(roles[k]), F.lit(""))))
           for k in ("state", "name", "city")}
    url = text.normalize_url(F.coalesce(F.col(roles["url"]), F.lit("")))
    block = F.coalesce(F.col(roles["block"]).cast("string"), F.lit(""))
    sep = F.lit("\u0001")
    any_city = F.concat(block, sep, low["state"], sep, low["name"])
    city = F.when(low["city"] == "", F.lit("unknown")).otherwise(low["city"])
    with_city = F.concat(any_city, sep, city)
    keys = F.struct(
        F.col(row_no).cast("bigint").alias("_r"),
        F.when(url != "", F.concat(block, sep, url)).alias("_u"),
        with_city.alias("_with_city"), any_city.alias("_any_city"),
        F.when(low["city"] == "", any_city).otherwise(with_city).alias("_asks"))
    return roster.select(F.struct(*roster.columns).alias("row"), keys.alias("keys"))


def _with_minima(rows: DataFrame, source: DataFrame, out: str) -> DataFrame:
    """The smallest row number of `source` that covers each row, by URL or by place."""
    urls = (source.filter(F.col("_u").isNotNull()).groupBy("_u")
            .agg(F.min("_r").alias("_min_u")))
    offers = F.explode(F.array("_with_city", "_any_city"))
    places = source.select("_r", offers.alias("_asks")).groupBy("_asks").agg(
        F.min("_r").alias("_min_p"))
    return (lookup(lookup(rows, urls, ["_u"]), places, ["_asks"])
            .withColumn(out, F.least("_min_u", "_min_p")).drop("_min_u", "_min_p"))


def _blocks(undecided: DataFrame, rows: int) -> DataFrame:
    """Undecided rows with `_block`: rows that conflict lie next to each other, in order."""
    links = key_links(undecided, "_r", [F.concat(F.lit("u"), "_u"), F.concat(F.lit("p"), "_with_city"),
                                        F.concat(F.lit("p"), "_any_city")])
    part = connected_components(links).withColumnRenamed("node", "_r")
    placed = numbered(lookup(undecided, part, ["_r"]).withColumn(
        "component", F.coalesce("component", "_r")), ["component", "_r"], "place")
    return placed.select(*_COLUMNS, F.floor(F.col("place") / rows).alias("_block"))


def _with_outsiders(rows: DataFrame) -> DataFrame:
    """Whether an earlier undecided row of another block may cover a row, by URL or by place."""
    def span(source: DataFrame, key: str) -> DataFrame:
        return source.groupBy(key).agg(F.min("_r").alias("_least"), F.min("_block").alias("_low"),
                                       F.max("_block").alias("_high"))

    def outside(key: str):
        return F.coalesce((F.col("_low") != F.col("_high")) & (F.col("_least") < F.col("_r")),
                          F.lit(False)).alias(key)

    urls = span(rows.filter("_u is not null"), "_u")
    places = span(rows.select("_r", "_block", F.explode(F.array("_with_city", "_any_city")).alias("_asks")),
                  "_asks")
    by_url = lookup(rows, urls, ["_u"]).select(*rows.columns, outside("_out_u"))
    return lookup(by_url, places, ["_asks"]).select(*by_url.columns, outside("_out_p"))


def _decided(block: pa.Table) -> pa.Table:
    """(_r, _kept) of a block's rows: true, false, or null where another block has to decide first."""
    block = block.sort_by("_r")
    # keys of rows that are kept, and of rows still open
    kept: set[str] = set()
    open_: set[str] = set()
    out = []
    columns = (block.column(c).to_pylist() for c in (*_COLUMNS[1:], "_out_u", "_out_p"))
    for url, with_city, any_city, asks, out_u, out_p in zip(*columns):
        url = None if url is None else "u" + url
        if url in kept or asks in kept:
            out.append(False)
            continue
        unsure = out_u or out_p or url in open_ or asks in open_
        out.append(None if unsure else True)
        offers = {with_city, any_city} | ({url} if url else set())
        (open_ if unsure else kept).update(offers)
    return pa.table({"_r": block.column("_r"), "_kept": pa.array(out, pa.bool_())})


def _uncovered(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows that no earlier one of the newly kept rows covers."""
    rest = _with_minima(rows, kept, "_cover")
    return rest.filter(F.col("_cover").isNull() | (F.col("_cover") > F.col("_r"))).select(*_COLUMNS)


def greedy_dedupe(roster: DataFrame, roles: Mapping[str, str], row_no: str,
                  block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The rows the sequential rule keeps. `roles`: block, state, name, city, url columns.

    Rounds go on until nothing is undecided, at any size; a round decides at least the first
    undecided row of every group of conflicting rows. Row numbers must be unique integers.
    """
    spark, folder = roster.sparkSession, scratch_path(roster.sparkSession, "dedupe-kept")
    # rows and keys are written together: what comes before the roster is computed once
    held = cut_lineage(_keyed(roster, roles, row_no), "dedupe")
    undecided = held.select("keys.*")
    undecided.select("_r").limit(0).write.parquet(folder)
    rounds, left = 0, undecided.count()
    while left:
        rounds += 1
        # a row no earlier undecided row covers is kept; rows without conflict go in round one
        marked = cut_lineage(_with_minima(undecided, undecided, "_head").select(
            *_COLUMNS, (F.col("_head") == F.col("_r")).alias("_is_head")), "dedupe")
        heads = marked.filter("_is_head").select(*_COLUMNS)
        heads.select("_r").write.mode("append").parquet(folder)
        undecided = cut_lineage(_uncovered(marked.filter("NOT _is_head").select(*_COLUMNS), heads),
                                "dedupe")
        left = undecided.count()
        if not left or (left > block_rows and rounds == 1):
            continue
        if left <= block_rows:
            dealt = undecided.withColumns({"_block": F.lit(0).cast("bigint"), "_out_u": F.lit(False),
                                           "_out_p": F.lit(False)})
        else:
            dealt = _with_outsiders(_blocks(undecided, block_rows))
        known = dealt.groupBy("_block").applyInArrow(_decided, "_r bigint, _kept boolean")
        known = cut_lineage(lookup(undecided, known, ["_r"]), "dedupe")
        heads = known.filter("_kept").select(*_COLUMNS)
        heads.select("_r").write.mode("append").parquet(folder)
        undecided = cut_lineage(_uncovered(known.filter("_kept is null").select(*_COLUMNS), heads),
                                "dedupe")
        left = undecided.count()
    ids = spark.read.schema("_r bigint").parquet(folder)
    return held.join(ids, F.col("keys._r") == ids["_r"], "left_semi").select("row.*")
