"""Per-key statistics attached back to rows, safe for hot keys.

A window over the key would move a whole key into one task. Here every key is
split by a salt: there are at most `salts` partial rows per key, a window over these
partials gives the totals, and rows join on (key, salt), so the rows of one key stay
spread over up to `salts` tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

_MERGE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


def free_name(name: str, *frames: DataFrame) -> str:
    """`name`, or a longer one that no column of `frames` has: for columns that are dropped again."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def attach_group_stats(df: DataFrame, keys: Sequence[str],
                       stats: Mapping[str, tuple[str, str | None]], salt_on: str,
                       salts: int = 32) -> DataFrame:
    """Add `stats` = {new column: (count|sum|min|max, input column)} of each row's key.

    Null keys are equal to each other. `salt_on` is any column that varies inside a key.
    """
    # keys travel as one struct: it is never null itself and compares its nulls as equal
    key, salt = free_name("_key", df), free_name("_salt", df)
    salted = df.withColumns({
        key: F.struct(*keys),
        salt: F.pmod(F.xxhash64(salt_on), F.lit(salts)).cast("int")})

    def first(fn: str, col: str | None):
        return F.count(F.lit(1) if col is None else col) if fn == "count" else getattr(F, fn)(col)

    partial = salted.groupBy(key, salt).agg(
        *[first(fn, col).alias(name) for name, (fn, col) in stats.items()])
    per_key = Window.partitionBy(key)  # at most `salts` rows per key
    totals = partial.withColumns(
        {name: _MERGE[fn](name).over(per_key) for name, (fn, _) in stats.items()})
    return salted.join(totals, [key, salt], "left").drop(key, salt)


def lookup(rows: DataFrame, dim: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join rows with a table that holds one row per key.

    The join key is the struct of the keys. A table that was aggregated by the same keys is
    shuffled once more for it, so both sides of the join are plain shuffles: only in that shape
    does adaptive execution split the partition of a hot key. Without it all rows of the key
    would follow the aggregate into one task. Null keys are equal to each other.
    """
    key, name = F.struct(*keys), free_name("_lookup", rows, dim)
    right = dim.select(key.alias(name), *[c for c in dim.columns if c not in keys])
    return rows.withColumn(name, key).join(right, name, how).drop(name)


def first_per_key(df: DataFrame, keys: Sequence[str], order: str,
                  columns: Sequence[str]) -> DataFrame:
    """One row per key: `columns` of the row with the smallest `order` (partial aggregation)."""
    picked = F.min_by(F.struct(*columns), F.col(order))
    kept = [c for c in columns if c != order]
    return (df.groupBy(*keys).agg(picked.alias("_row"), F.min(order).alias(order))
            .select(*keys, order, *[F.col(f"_row.{c}").alias(c) for c in kept]))


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                 columns: Sequence[str]) -> DataFrame:
    """One row per key: `columns` of the row with the largest `order`."""
    picked = F.max_by(F.struct(*columns), F.struct(*order))
    return (df.groupBy(*keys).agg(picked.alias("_row"))
            .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in columns]))


def peers_in_city(df: DataFrame, id_col: str, city: str, state: str, mode: str = "index",
                  out: str = "nearby_count", salts: int = 32) -> DataFrame:
    """Number of other records in the same place, without a self-join.

    `index`: exact (city, state), null folded to '', minus one, never below 0.
    `phase`: per state, city compared stripped and case-insensitively, rows with the
    record's own id excluded, a record without city has 0.
    """
    own_city, own_state, own, n = (free_name(c, df) for c in ("_city", "_state", "_own", "_n"))
    if mode == "index":
        keyed = df.withColumns({own_city: F.coalesce(city, F.lit("")),
                                own_state: F.coalesce(state, F.lit(""))})
        counted = attach_group_stats(keyed, [own_city, own_state], {n: ("count", None)}, id_col, salts)
        value = F.greatest(F.lit(0), F.col(n) - 1)
        return counted.withColumn(out, value).drop(own_city, own_state, n)
    place = F.lower(strip(city))
    keyed = df.withColumn(own_city, F.coalesce(place, F.lit("")))
    # one row per (place, id), and from those one per place
    per_id = keyed.filter(F.col(own_city) != "").groupBy(state, own_city, id_col).agg(
        F.count(F.lit(1)).alias(own))
    per_place = per_id.groupBy(state, own_city).agg(F.sum(own).alias(n))
    # a record without city finds no counts and has no neighbours
    found = lookup(lookup(keyed, per_id, [state, own_city, id_col]), per_place, [state, own_city])
    return found.withColumn(out, F.coalesce(F.col(n) - F.col(own), F.lit(0)).cast("bigint")).drop(
        n, own, own_city)


def flag_duplicates(df: DataFrame, keys: Mapping[str, object], row_no: str,
                    out: str = "is_duplicate", salts: int = 32) -> DataFrame:
    """True for the 2nd and later occurrence of a key; `keys` = {temporary name: Column}."""
    keyed = df.withColumns(dict(keys))
    least = free_name("_first", keyed)
    first = attach_group_stats(keyed, list(keys), {least: ("min", row_no)}, row_no, salts)
    return first.withColumn(out, F.col(row_no) > F.col(least)).drop(least, *keys)
