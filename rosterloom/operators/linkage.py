"""Record linkage: anti-joins, exact, containment, fuzzy, edit-distance and proximity matches.

No operator here plans a cross join: every join is an equi-join on a key that provably loses
no match. Only the fuzzy match, which no selective key can serve, compares the names of a block
with each other, in tiles of bounded size (`name_tiles`).
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..session import cut_lineage
from .groups import first_per_key, lookup
from .name_tiles import similarity_ratio, tile_pairs  # noqa: F401

GRAM = 11


# -- roster against known records --------------------------------------------

def unmatched_roster(roster: DataFrame, existing: DataFrame, r: Mapping[str, str],
                     e: Mapping[str, str]) -> DataFrame:
    """Roster rows without a known record in the same file region.

    Match: equal normalised URL (not empty); else equal state and name, and equal city
    when the roster has one. The OR becomes two equi anti-joins: a known record offers its
    place with and without the city, a roster row asks for one of the two. `r` and `e` map
    the roles `block, state, name, city, url` to column names.
    """
    def low(side: Mapping[str, str], role: str) -> Column:
        return F.lower(F.coalesce(F.col(side[role]), F.lit("")))

    def url(side: Mapping[str, str]) -> Column:
        return text.normalize_url(F.coalesce(F.col(side["url"]), F.lit("")))

    place = ("_b", "_s", "_n", "_c")
    no_city = F.lit("")
    known_city = F.concat(F.lit("="), low(e, "city"))
    by_url = existing.select(F.col(e["block"]).alias("_b"), url(e).alias("_u")).filter(
        "_u <> ''").distinct()
    by_place = existing.select(
        F.col(e["block"]).alias("_b"), low(e, "state").alias("_s"), low(e, "name").alias("_n"),
        F.explode(F.array(no_city, known_city)).alias("_c")).distinct()
    asked = F.when(text.strip(low(r, "city")) == "", no_city).otherwise(
        F.concat(F.lit("="), low(r, "city")))
    block = F.col(r["block"]).alias("_b")
    # each shuffle carries the keys of its own join only
    unknown_url = lookup(roster.select("*", block, url(r).alias("_u")), by_url, ["_b", "_u"], "left_anti")
    rows = unknown_url.select(
        *roster.columns, block, low(r, "state").alias("_s"), low(r, "name").alias("_n"), asked.alias("_c"))
    return lookup(rows, by_place, place, "left_anti").select(*roster.columns)


# -- exact --------------------------------------------------------------------

def exact_match(left: DataFrame, right: DataFrame, left_keys: Mapping[str, Column],
                right_keys: Mapping[str, Column], order: str, columns: list[str],
                how: str = "left") -> DataFrame:
    """Equi-match on computed keys; the first right row (by `order`) of a key wins.

    Key expressions are given as {temporary name: Column}, the same names on both sides.
    """
    names = list(left_keys)
    dim = first_per_key(
        right.withColumns(dict(right_keys)).dropna(subset=names), names, order, columns)
    return lookup(left.withColumns(dict(left_keys)), dim, names, how).drop(*names)


# -- containment --------------------------------------------------------------

def _grams(c: Column, n: int = GRAM) -> Column:
    return F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(c, i, F.lit(n))))


def _contained(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """Rows of (outer, inner) with inner ⊂ outer, all columns; both longer than 10 characters.

    Every 11-gram of the inner name occurs in the outer one, so any single gram finds all
    matches. The one that is rarest among the outer names is used, to keep blocks small. Both sides
    of every join are shuffled: the size of exploded grams is estimated too low for a broadcast.
    """
    outer_grams = outer.select("*", F.explode(_grams(F.col("outer"))).alias("gram"))
    inner_grams = inner.select("inner", F.explode(_grams(F.col("inner"))).alias("gram"))
    frequency = outer_grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    rarest = (lookup(inner_grams, frequency.hint("merge"), ["gram"])
              .groupBy("inner").agg(
                  F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")).alias("g"))
              .filter("g.df > 0").select("inner", F.col("g.gram").alias("gram")))
    keyed = lookup(inner, rarest.hint("merge"), ["inner"], "inner")
    # the struct keeps both sides plain shuffles, so a gram of many names can be split
    left = outer_grams.withColumn("_g", F.struct("gram")).drop("gram")
    right = keyed.withColumn("_g", F.struct("gram")).drop("gram")
    return left.join(right.hint("merge"), "_g").filter(F.col("outer").contains(F.col("inner"))).drop("_g")


def containment_match(left_names: DataFrame, right_names: DataFrame, name: str,
                      first_seen: str) -> DataFrame:
    """Best containment partner per distinct left name: the right name seen first.

    Both inputs hold one row per normalised name; the result is (name, partner). The order
    travels with the right names, so pairs are never joined back by their partner.
    """
    long_left = left_names.filter(F.length(name) > GRAM - 1).select(F.col(name).alias("_l"))
    long_right = right_names.filter(F.length(name) > GRAM - 1).select(
        F.col(name).alias("_r"), F.col(first_seen).alias("_seen"))
    left_outer = _contained(long_left.withColumnRenamed("_l", "outer"),
                            long_right.withColumnRenamed("_r", "inner"))
    right_outer = _contained(long_right.withColumnRenamed("_r", "outer"),
                             long_left.withColumnRenamed("_l", "inner"))
    pairs = left_outer.select(
        F.col("outer").alias(name), F.col("inner").alias("partner"), "_seen").unionByName(
        right_outer.select(F.col("inner").alias(name), F.col("outer").alias("partner"), "_seen"))
    return pairs.groupBy(name).agg(F.min_by("partner", "_seen").alias("partner"))


def sheet_match(left: DataFrame, left_name: str, sheet: DataFrame, sheet_name: str, row_no: str,
                payload: list[str]) -> DataFrame:
    """Curated-sheet match: equal normalised name, else containment.

    Sheet rows with the same normalised name collapse to the position of the first and the
    values of the last. Adds `match_type` (exact, partial, null) and the payload columns.
    """
    keyed = sheet.withColumn("_k", text.plain_name(sheet_name))
    dim = cut_lineage(keyed.groupBy("_k").agg(
        F.min(row_no).alias("_seen"), F.max_by(F.struct(*payload), F.col(row_no)).alias("_row")),
        "sheet")
    records = left.withColumn("_k", F.when(F.col(left_name) != "", text.plain_name(left_name)))
    # the distinct names feed three branches: computed once
    names = cut_lineage(records.filter(F.col("_k").isNotNull()).select("_k").distinct(), "sheet")
    # written names are small files and large in memory, so no table of them is broadcast
    exact = names.join(dim.select("_k").hint("merge"), "_k", "left_semi").withColumns(
        {"_p": F.col("_k"), "match_type": F.lit("exact")})
    rest = names.join(dim.select("_k").hint("merge"), "_k", "left_anti")
    partial = containment_match(rest, dim.select("_k", "_seen"), "_k", "_seen").select(
        "_k", F.col("partner").alias("_p"), F.lit("partial").alias("match_type"))
    resolved = lookup(exact.select("_k", "_p", "match_type").unionByName(partial),
                      dim.select(F.col("_k").alias("_p"), "_row").hint("merge"), ["_p"], "inner")
    return (lookup(records, resolved.drop("_p").hint("merge"), ["_k"])
            .select(*left.columns, "match_type",
                    *[F.col(f"_row.{c}").alias(f"sheet_{c}") for c in payload]))


# -- fuzzy --------------------------------------------------------------------

def _tile_names(left: DataFrame, right: DataFrame, block: str, name: str, order: str
                ) -> tuple[DataFrame, DataFrame]:
    """Both sides as `tile_pairs` takes them; each is counted and dealt, so it is written first."""
    def prepared(df: DataFrame, *more: Column) -> DataFrame:
        return cut_lineage(df.filter(F.length(name) > 0).select(
            F.col(block).alias("_block"), F.col(name).alias("name"), *more), "fuzzy")

    return prepared(left), prepared(right, F.col(order).alias("seen"))


def fuzzy_candidates(left: DataFrame, right: DataFrame, block: str, name: str, order: str,
                     threshold: float) -> DataFrame:
    """Distinct (block, a, b, order of b, bound) pairs whose ratio can reach the threshold.

    Both sides hold distinct (block, name). `bound` is the ratio if the longest common subsequence
    matched.
    """
    pairs = tile_pairs(*_tile_names(left, right, block, name, order), threshold, best=False)
    return pairs.select(F.col("_block").alias(block), "a", "b", F.col("seen").alias(order),
                        F.col("score").alias("bound"))


def best_ratio(left: DataFrame, right: DataFrame, block: str, name: str, order: str,
               threshold: float) -> DataFrame:
    """(block, a, b, score): the best partner of each a with ratio ≥ threshold, first row wins ties.

    Both sides hold distinct (block, name). Each pair of tiles gives one partner of a name, so what
    is compared at last are as many rows as the names have tiles to look into.
    """
    pairs = tile_pairs(*_tile_names(left, right, block, name, order), threshold, best=True)
    best = pairs.groupBy("_block", "a").agg(F.max_by(
        F.struct("b", "score"), F.struct("score", -F.col("seen"))).alias("m"))
    return cut_lineage(best.select(F.col("_block").alias(block), "a", "m.b", "m.score"), "fuzzy")


def fuzzy_match(left: DataFrame, right: DataFrame, block: str, left_name: str, right_name: str,
                row_no: str, payload: list[str], threshold: float = 0.70) -> DataFrame:
    """Best partner inside a block: exact name, else best ratio ≥ threshold, first row wins ties.

    Adds `match_type`, `match_score` and the payload of the partner. Names are compared after
    removing stop words and punctuation; two empty names have ratio 1. Only distinct names
    without an equal partner reach the fuzzy stage.
    """
    title = text.strip(right_name)
    rows = right.filter(title != "").select(
        block, F.col(row_no).alias("_seen"), F.struct(*payload).alias("_hit"),
        F.lower(title).alias("_raw"), text.match_name(title).alias("_k"))
    by_raw = rows.groupBy(block, "_raw").agg(F.min_by("_hit", "_seen").alias("_exact"))
    by_norm = rows.groupBy(block, "_k").agg(F.min("_seen").alias("_seen"),
                                            F.min_by("_hit", "_seen").alias("_same"))
    named = left.withColumn("_raw", F.lower(F.nullif(F.col(left_name), F.lit(""))))
    names = (named.filter(F.col("_raw").isNotNull()).select(block, "_raw").distinct()
             .withColumn("_k", text.match_name("_raw"))
             .join(by_raw, [block, "_raw"], "left")
             .join(by_norm.select(block, "_k", "_same"), [block, "_k"], "left"))
    rest = names.filter(F.col("_exact").isNull() & F.col("_same").isNull()).select(
        block, "_k").distinct()
    best = best_ratio(rest, by_norm.select(block, "_k", "_seen"), block, "_k", "_seen", threshold).select(
        block, F.col("a").alias("_k"), F.col("b").alias("_b"), F.col("score").alias("_score"))
    hits = by_norm.select(block, F.col("_k").alias("_b"), F.col("_same").alias("_fuzzy"))
    best = lookup(best, hits, [block, "_b"]).drop("_b")
    resolved = names.join(best, [block, "_k"], "left").select(
        block, "_raw", F.coalesce("_exact", "_same", "_fuzzy").alias("_hit"),
        F.when(F.col("_exact").isNotNull(), "exact").otherwise("fuzzy").alias("match_type"),
        F.coalesce(F.when(F.coalesce("_exact", "_same").isNotNull(), 1.0), F.col("_score"))
        .alias("match_score")).filter(F.col("_hit").isNotNull())
    return lookup(named, resolved, [block, "_raw"]).select(
        *left.columns, "match_type", "match_score",
        *[F.col("_hit")[c].alias(f"match_{c}") for c in payload])


# -- edit distance ------------------------------------------------------------

def _drop_char(c: Column, i: Column) -> Column:
    return F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c)))


def _deletions(c: Column, depth: int) -> Column:
    """Every string left after deleting up to `depth` characters."""
    level, found = F.array(c), F.array(c)
    for _ in range(depth):
        level = F.array_distinct(F.flatten(F.transform(level, lambda s: F.when(
            F.length(s) > 0, F.transform(F.sequence(F.lit(1), F.length(s)),
                                         lambda i: _drop_char(s, i)))
            .otherwise(F.array(s)))))
        found = F.array_union(found, level)
    return found


def edit_distance_match(left: DataFrame, right: DataFrame, block: str, name: str,
                        max_distance: int = 2) -> DataFrame:
    """Closest right name per left name in a block, Levenshtein distance ≤ `max_distance`.

    Both sides hold distinct (block, name). Names within distance d share a string that arises
    from each by at most d deletions, so an equi-join on those strings is lossless. Distances are
    tried in order 0, 1, ..., each only for the left names still without a partner, as the closest
    wins; from 1 on only right names of a length that can match take part. Ties go to the
    smaller name. Result: block, name, partner, distance.
    """
    open_ = cut_lineage(left.select(block, name), "edit")
    right = cut_lineage(right.select(block, name), "edit")
    same = open_.join(right, [block, name]).withColumns(
        {"partner": F.col(name), "distance": F.lit(0)})
    found = [same.select(block, name, "partner", "distance")]
    open_ = cut_lineage(open_.join(right, [block, name], "left_anti"), "edit")
    for depth in range(1, max_distance + 1):
        lengths = open_.select(block, F.explode(F.sequence(
            F.length(name) - depth, F.length(name) + depth)).alias("_n")).distinct()
        near_length = right.withColumn("_n", F.length(name)).join(
            lengths, [block, "_n"], "left_semi").drop("_n")

        def variants(df: DataFrame, out: str, depth: int = depth) -> DataFrame:
            return df.select(block, F.col(name).alias(out),
                             F.explode(_deletions(F.col(name), depth)).alias("_v"))

        pairs = variants(open_, "_left").join(
            variants(near_length, "_right").hint("merge"), [block, "_v"]).drop("_v")
        distance = F.levenshtein("_left", "_right", depth)
        near = pairs.withColumn("distance", distance).filter("distance >= 0")
        best = cut_lineage(
            near.groupBy(block, F.col("_left").alias(name))
            .agg(F.min(F.struct("distance", F.col("_right").alias("partner"))).alias("m"))
            .select(block, name, "m.partner", "m.distance"), "edit")
        found.append(best)
        open_ = cut_lineage(open_.join(best, [block, name], "left_anti"), "edit")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


# -- proximity ----------------------------------------------------------------

EARTH_METRES = 6371008.8


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    dp, dl = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.sin(dp) * F.sin(dp) + F.cos(p1) * F.cos(p2) * F.sin(dl) * F.sin(dl)
    return F.lit(2 * EARTH_METRES) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def proximity_match(left: DataFrame, right: DataFrame, lat: str, lon: str, right_id: str,
                    radius: float = 100.0) -> DataFrame:
    """All left rows with `partner` and `metres` of the nearest right record within `radius`.

    Both are null without one. Rows of one point (records geocoded to a city centre) get their
    partner by a lookup whose hot points adaptive execution can split.
    """
    best = nearest_points(left, right, lat, lon, right_id, radius)
    return lookup(left, best, [lat, lon])


def nearest_points(left: DataFrame, right: DataFrame, lat: str, lon: str, right_id: str,
                   radius: float = 100.0) -> DataFrame:
    """Nearest right record within `radius` metres of each distinct left point.

    Points fall into latitude bands and longitude cells at least one radius wide (the cell
    width follows the band's latitude); a left point looks into its 3×3 neighbourhood.
    Equal coordinates collapse before the join, ties go to the smaller id.
    """
    step = radius / (EARTH_METRES * math.pi / 180) * 1.01

    def width(band: Column) -> Column:
        edge = (F.abs(band.cast("double")) + 2) * F.lit(step)
        # close to a pole every longitude is a neighbour
        return F.when(edge >= 89.99, F.lit(720.0)).otherwise(
            F.lit(step) / F.cos(F.radians(edge)))

    def band_of(c: Column) -> Column:
        return F.floor(c / F.lit(step))

    points = left.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(lat, lon).distinct()
    probes = (points.withColumn("band", F.explode(F.array(
        *[band_of(F.col(lat)) + d for d in (-1, 0, 1)])))
        .withColumn("_w", width(F.col("band")))
        .withColumn("cell", F.explode(F.array(
            *[F.floor(F.col(lon) / F.col("_w")) + d for d in (-1, 0, 1)]))))
    spots = (right.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull())
             .groupBy(F.col(lat).alias("_lat"), F.col(lon).alias("_lon"))
             .agg(F.min(right_id).alias("partner"))
             .withColumn("band", band_of(F.col("_lat")))
             .withColumn("_w", width(F.col("band")))
             # a spot near the date line also stands beyond it
             .withColumn("_x", F.explode(F.filter(
                 F.array(F.col("_lon"), F.col("_lon") + 360, F.col("_lon") - 360),
                 lambda x: F.abs(x) <= F.lit(180) + F.col("_w") * 2)))
             .withColumn("cell", F.floor(F.col("_x") / F.col("_w")))
             .select("_lat", "_lon", "partner", "band", "cell"))
    near = (probes.join(spots, ["band", "cell"])
            .withColumn("metres", haversine(F.col(lat), F.col(lon), F.col("_lat"), F.col("_lon")))
            .filter(F.col("metres") <= radius))
    best = near.groupBy(lat, lon).agg(F.min(F.struct("metres", "partner")).alias("m"))
    return best.select(lat, lon, F.col("m.partner").alias("partner"),
                       F.col("m.metres").alias("metres"))
