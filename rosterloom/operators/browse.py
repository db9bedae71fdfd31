"""Faceted browse: text search, filters, sort, page, facets, export projection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import derive, scoring, vocab
from ..functions.text import strip, truthy
from .groups import free_name, lookup
from .order import numbered

#: First rows whose ids may be read to the driver.
TOP_ROWS = 10_000


def search_text(q: str, name: str, alternates: str | None = None, city: str | None = None) -> Column:
    """Case-insensitive substring search over name, city and alternate names."""
    q = q.strip().lower()
    if not q:
        return F.lit(True)
    def given(c: str) -> Column:
        return F.nullif(F.col(c), F.lit(""))

    parts = [given(name)] + ([given(city)] if city else [])
    if alternates:
        parts.append(F.nullif(F.concat_ws(" | ", alternates), F.lit("")))
    return F.lower(F.concat_ws(" | ", *parts)).contains(q)


def facet_equals(values: Mapping[str, str], full: Column | None = None) -> Column:
    """Conjunction of trimmed, case-insensitive equalities; blank values filter nothing.

    `full` is the condition of a complete record, for the option that shows only those.
    """
    out = F.lit(True) if full is None else full
    for col, v in values.items():
        v = (v or "").strip().lower()
        if v:
            out = out & (F.lower(strip(F.coalesce(F.col(col).cast("string"), F.lit("")))) == v)
    return out


def range_filter(bounds: Mapping[str, tuple[float | None, float | None]]) -> Column:
    out = F.lit(True)
    for col, (low, high) in bounds.items():
        if low is not None:
            out = out & (F.col(col) >= low)
        if high is not None:
            out = out & (F.col(col) <= high)
    return out


# fixed values: sort keys and the value a null sorts as
SORT_NULLS: dict[str, object] = {
    "state_province": "", "city": "", "museum_name": "", "museum_type": "", "time_needed": "",
    "reputation": 999, "collection_based_strength": -1, "eca_score": -1,
    "overall_quality_score": -1, "priority_score": 999, "nearby_museum_count": 0,
}


def sort_order(key: str, name: str, id_col: str, descending: bool = False,
               nulls: object | None = None) -> list[Column]:
    """Order by one key with its null stand-in; ties always by name, then id, ascending."""
    c = F.coalesce(F.col(key), F.lit(SORT_NULLS.get(key) if nulls is None else nulls))
    return [c.desc() if descending else c.asc(), F.col(name).asc(), F.col(id_col).asc()]


def after_row(key: str, name: str, id_col: str, last: tuple, descending: bool = False,
              nulls: object | None = None) -> Column:
    """Rows that follow the row `last` = (key value, name, id) in `sort_order`.

    As the `where` of the next page this replaces a deep offset: no skipped row is sorted.
    """
    stand_in = SORT_NULLS.get(key) if nulls is None else nulls
    c, value = F.coalesce(F.col(key), F.lit(stand_in)), F.lit(stand_in if last[0] is None else last[0])
    further = c < value if descending else c > value
    tie = (F.col(name) > last[1]) | ((F.col(name) == last[1]) & (F.col(id_col) > last[2]))
    return further | ((c == value) & tie)


def label_order(col: str, ranks: Mapping[str, int], name: str, id_col: str) -> list[Column]:
    rank = F.coalesce(derive.lookup(F.col(col).cast("string"), ranks), F.lit(999))
    return [rank.asc(), F.col(name).asc(), F.col(id_col).asc()]


def priority_order(score: str, name: str, id_col: str) -> list[Column]:
    return [F.asc_nulls_last(score), F.asc(name), F.asc(id_col)]


@dataclass
class BrowseQuery:
    """Filters, sort and page of one browse request, compiled to one plan."""

    order: Sequence[Column]
    text: Column | None = None
    facets: Mapping[str, str] = field(default_factory=dict)
    ranges: Mapping[str, tuple[float | None, float | None]] = field(default_factory=dict)
    where: Column | None = None
    limit: int = 50
    offset: int = 0
    max_limit: int | None = None

    def filtered(self, df: DataFrame) -> DataFrame:
        cond = facet_equals(self.facets) & range_filter(self.ranges)
        for extra in (self.text, self.where):
            if extra is not None:
                cond = cond & extra
        return df.filter(cond)

    @property
    def size(self) -> int:
        """Rows of a page; `max_limit` is the cap of an interface that has one."""
        return self.limit if self.max_limit is None else min(self.limit, self.max_limit)

    def page(self, df: DataFrame) -> DataFrame:
        """The rows of the page (a top-k, never a full sort for early pages)."""
        return self.filtered(df).orderBy(*self.order).offset(self.offset).limit(self.size)

    def total(self, df: DataFrame) -> DataFrame:
        """One row: matching records and number of pages (at least one)."""
        n = F.count(F.lit(1))
        return self.filtered(df).agg(n.alias("total"), F.greatest(
            F.lit(1), F.ceil(n / self.size)).cast("bigint").alias("pages"))

    def page_with_total(self, df: DataFrame) -> DataFrame:
        """The page with the total as a scalar subquery column."""
        return self.page(df).withColumn("total", self.total(df).select("total").scalar())


def facet_values(df: DataFrame, facets: Sequence[str]) -> DataFrame:
    """Distinct truthy values per facet in long form (no per-facet collection)."""
    types = dict(df.dtypes)
    pairs = F.explode(F.array(*[
        F.struct(F.lit(f).alias("facet"),
                 F.when(truthy(f, types[f]), F.col(f).cast("string")).alias("value"))
        for f in facets]))
    return (df.select(pairs.alias("p")).select("p.facet", "p.value")
            .filter(F.col("value").isNotNull()).distinct().orderBy("facet", "value"))


def scored_count(s: scoring.ScoreColumns, scoreable: str) -> Column:
    return F.count_if(F.coalesce(F.col(scoreable), F.lit(False)) & scoring.has_art_score(s))


def top_dimensions(dimensions: Sequence[tuple[str, str]] = vocab.DIMENSIONS, floor: int = 5,
                   n: int = 5) -> Column:
    """The n highest dimension scores ≥ floor of a record as array<struct<label, score>>.

    Ties keep declared order.
    """
    entries = F.array(*[
        F.when(F.col(c) >= floor, F.struct((-F.col(c)).alias("k"), F.lit(i).alias("i"),
                                           F.lit(lab).alias("label"), F.col(c).alias("score")))
        for i, (c, lab) in enumerate(dimensions)])
    best = F.slice(F.array_sort(F.array_compact(entries)), 1, n)
    return F.transform(best, lambda e: F.struct(e["label"].alias("label"), e["score"].alias("score")))


def rank_bands(df: DataFrame, id_col: str, order: Sequence[Column],
               bands: Sequence[tuple[str, int]] = (("GOLD", 50), ("SILVER", 100)),
               rest: str = "BRONZE") -> DataFrame:
    """Band by global rank, the last row of each band given as a position from 1; ids are unique.

    Bands that end within `TOP_ROWS` rows come from those first rows alone: only their ids are
    read. For longer ones the rank comes from sorted ranges and their sizes.
    """
    by, last = [*order, F.col(id_col)], max((n for _, n in bands), default=0)
    if last <= TOP_ROWS:
        first = df.orderBy(*by).limit(last).select(id_col).collect()
        named = [(r[0], next(name for name, stop in bands if i < stop)) for i, r in enumerate(first)]
        kind = T.StructType([df.schema[id_col], T.StructField("band", T.StringType())])
        tops = df.sparkSession.createDataFrame(named, kind)
        return lookup(df, tops, [id_col]).withColumn("band", F.coalesce("band", F.lit(rest)))
    rank = free_name("_rank", df)
    ranked = numbered(df, by, rank)
    band = F.lit(rest)
    for name, stop in reversed(bands):
        band = F.when(F.col(rank) < stop, F.lit(name)).otherwise(band)
    return ranked.withColumn("band", band).drop(rank)


def export_projection(df: DataFrame, columns: Sequence[tuple[str, str]] = vocab.EXPORT_COLUMNS,
                      labels: Mapping[str, Mapping[int, str]] = vocab.EXPORT_LABELS,
                      sources: Mapping[str, str] | None = None) -> DataFrame:
    """Export columns under their headers; ordinals become labels, everything becomes text."""
    sources = sources or {}
    out = []
    for name, header in columns:
        c = sources.get(name, name)
        value = derive.label(c, labels[name]) if name in labels else F.col(c).cast("string")
        out.append(F.coalesce(value, F.lit("")).alias(header))
    return df.select(*out)


def csv_field(c: Column | str) -> Column:
    """A field as it appears in a CSV line: quoted only when it holds , \" or a line break."""
    v = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")).cast("string")
    quoted = F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(v.rlike('[,"\n]'), quoted).otherwise(v)
