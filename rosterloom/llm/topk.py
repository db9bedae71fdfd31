"""Exact top-k search by inner product with Fagin's threshold algorithm.

Candidates are dealt into blocks of bounded size and queries into blocks as well; each pair of
blocks is one task. In a block of candidates every dimension has a list of the candidates sorted
by that component. A query walks down all lists at once, from the top where its own component is
positive and from the bottom where it is negative, and scores each candidate it meets by looking
up its other components. The sum of the query's products with the last values read bounds every
candidate not met yet; once that bound is below the k-th score, the block is done. Each query first walks
one block; the k-th score found there goes along to all others, where the walk also ends once the
bound is below it. Each query's best of all blocks are merged by (score descending, id).

Vectors that are null or hold null or non-finite components take no part, nor do rows with a null
id. Every row is a query and a candidate of its own, whatever other rows have its id: a query's
candidates are all rows but itself. Vectors are compared with those of their own number of components. Components must be below 2^45 in size after scaling.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.groups import lookup
from ..session import cut_lineage

#: Candidates and queries of a block, on average.
CANDIDATES, QUERIES = 8192, 2048
FIRST_DEPTH = 16


def finite(vector: str) -> Column:
    """A vector without null, NaN or infinite components (false for null)."""
    good = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (
        F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(good, F.lit(False))


def threshold_top(lists: np.ndarray, values: np.ndarray, vectors: np.ndarray, ids: np.ndarray,
                  query: np.ndarray, own: int, k: int, least: float | None = None) -> list[int]:
    """Rows of the k best candidates, by (score descending, id ascending), without row `own`.

    `lists[d]` holds the rows in ascending order of component d, `values[d]` that component.
    Candidates whose score is below `least` may be left out.
    """
    used = np.flatnonzero(query)
    n = len(ids)
    if not len(used):
        order = np.argsort(ids, kind="stable")
        return [int(i) for i in order if i != own][:k]
    up = query[used] > 0
    met = np.zeros(n, bool)
    if own >= 0:
        met[own] = True
    best = np.empty(0, np.int64)
    scores = np.empty(0, vectors.dtype)
    depth, last = FIRST_DEPTH, 0
    while True:
        depth = min(depth, n)
        fresh = np.zeros(n, bool)
        fresh[lists[used[up], n - depth:n - last]] = True
        fresh[lists[used[~up], last:depth]] = True
        new = np.flatnonzero(fresh & ~met)
        met[new] = True
        best = np.concatenate([best, new])
        scores = np.concatenate([scores, vectors[new] @ query])
        order = np.lexsort((ids[best], -scores))[:k]
        best, scores = best[order], scores[order]
        if depth == n:
            break
        reach = np.where(up, values[used, n - depth], values[used, depth - 1]) @ query[used]
        # an unmet candidate may equal the bound and win by its smaller id
        if len(best) == k and reach < scores[-1] or least is not None and reach < least:
            break
        last, depth = depth, depth * 2
    return [int(i) for i in best]


_BEST = "row bigint, query_id bigint, vec_id bigint, score bigint"


def _searched(key, queries: pa.Table, candidates: pa.Table, k: int) -> pa.Table:
    out_row, out_query, out_id, out_score = [], [], [], []
    if queries.num_rows and candidates.num_rows:
        ids = candidates.column("id").to_numpy()
        place = {row: i for i, row in enumerate(candidates.column("row").to_pylist())}
        width = int(key[2].as_py())

        def matrix(t: pa.Table) -> np.ndarray:
            flat = t.column("vector").combine_chunks().flatten().to_numpy()
            return flat.reshape(t.num_rows, width)

        vectors, asked = matrix(candidates), matrix(queries)
        # products and sums that doubles hold exactly are computed in doubles
        top = max(1, np.abs(vectors).max(initial=0)) * max(1, np.abs(asked).max(initial=0))
        kind = np.float64 if float(top) * max(width, 1) < 2 ** 53 else np.int64
        numbers, asked = np.ascontiguousarray(vectors.astype(kind)), asked.astype(kind)
        lists = np.argsort(vectors, axis=0, kind="stable").T.copy()
        values = np.take_along_axis(numbers.T, lists, 1)
        columns = (queries.column(c).to_pylist() for c in ("row", "id", "least"))
        for q, (row, own, least) in enumerate(zip(*columns)):
            found = threshold_top(lists, values, numbers, ids, asked[q], place.get(row, -1), k, least)
            out_row += [row] * len(found)
            out_query += [own] * len(found)
            out_id += ids[found].tolist()
            out_score += (numbers[found] @ asked[q]).astype(np.int64).tolist()
    return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(
        ("row", "query_id", "vec_id", "score"), (out_row, out_query, out_id, out_score))})


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id",
          vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best among all other rows.

    Components become floor(scale * x). `is_query` is a condition on the id column.
    """
    whole = F.transform(F.col("vector"), lambda x: F.floor(x.cast("double") * scale))
    rows = (vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("vector"),
                           is_query.alias("asks"))
            .filter(F.col("id").isNotNull() & finite("vector"))
            .select("id", "asks", whole.alias("vector")))
    rows = cut_lineage(rows.withColumns({"width": F.size("vector"), "row": F.monotonically_increasing_id()}),
                       "topk")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("q")).first()
    blocks, asked = -(-size["n"] // CANDIDATES) or 1, -(-size["q"] // QUERIES) or 1
    # columns of their own: both sides of a search come from the same table
    candidates = rows.select(*[F.col(c).alias(c) for c in ("row", "id", "vector", "width")], F.pmod(
        F.xxhash64("row"), F.lit(blocks)).cast("int").alias("c"))
    queries = rows.filter("asks").select("row", "id", "vector", "width", F.pmod(
        F.xxhash64(F.lit(1), "row"), F.lit(asked)).cast("int").alias("q"))

    def searched(these: DataFrame, those: DataFrame) -> DataFrame:
        return these.groupBy("c", "q", "width").cogroup(those.groupBy("c", "q", "width")).applyInArrow(
            lambda key, a, b: _searched(key, a, b, k), _BEST)

    # each block of queries walks one block of candidates first
    home = F.pmod(F.col("q"), F.lit(blocks))
    met = F.filter(F.sequence(F.lit(0), F.lit(asked - 1)), lambda q: q % blocks == F.col("c"))
    first = searched(queries.withColumns({"c": home, "least": F.lit(None).cast("bigint")}),
                     candidates.withColumn("q", F.explode(met)))
    best = first
    if blocks > 1:
        first = cut_lineage(first, "topk")
        least = first.groupBy("row").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
        others = F.filter(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda c: c != home)
        rest = searched(lookup(queries, least, ["row"]).withColumn("c", F.explode(others)),
                        candidates.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(asked - 1)))))
        best = first.unionByName(rest)
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return (best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
