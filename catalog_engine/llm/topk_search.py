"""Exact top-k search (operator 12): Fagin's threshold algorithm over sorted lists.

Vectors are dealt into blocks by a hash of their row. A block keeps one sorted list for each
dimension. For a query, each dimension's list is read from the end that helps its inner
product; a vector met in any list is scored in full at once (random access); the threshold is
the query's product with the values reached in the lists, which no vector not yet met can
exceed. A search ends when the threshold is below the k-th best score.

A query first searches its own block. Its k-th score there is a floor under its final k-th
score, so in the other blocks lists are read only until the threshold is below the floor, and a
block hands on only vectors that reach it. Queries and blocks meet as parts of at most
QUERY_ROWS queries by blocks of at most BLOCK_ROWS vectors: each task holds one of each.

In many dimensions the bound is loose: on 64 dimensions of near-independent values lists are
read to about an eighth of their length, by which nearly every vector has been met. The result
is exact all the same, and the cost is that of scoring the blocks.

Defined cases: vectors that are null or hold null or non-finite components take no part;
shorter vectors count as padded with zeros, so an empty one scores 0 everywhere; rows that
repeat an id are rows of their own, as queries and as candidates, and only the very row of the
query is left out; null ids are candidates, last among ties, and no queries; ties go to the
smaller id; components are saturated at 64 bits, and so are scores; products beyond 2^53 are
computed with Python's integers; other columns aren't read; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalog_engine.llm.common import stored

K = 5
QUERY_DIVISOR = 50
SCALE = 256
BLOCK_ROWS, LEAST_BLOCK_ROWS, QUERY_ROWS = 65536, 2048, 16384
FIRST_DEPTH = 16
LONG_MAX, LONG_MIN = (1 << 63) - 1, -(1 << 63)
NO_ID = LONG_MAX  # stands for a null id in ties; such rows carry a flag

FOUND = "query long, query_id long, vec_id long, score long"
FOUND_ARROW = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def integer_vectors(embeddings: DataFrame, column: str = "embedding") -> DataFrame:
    """(row, vec_id, v): components as whole doubles; row numbers the vectors that take part."""
    x = F.col(column)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    good = embeddings.where(x.isNotNull() & ~F.coalesce(bad, F.lit(True)))
    return good.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"),
                       F.transform(x, lambda c: F.floor(c.cast("double") * SCALE).cast("double")).alias("v"))


class SortedLists:
    """The rows of a block and, for each dimension, its values in order with their rows."""

    def __init__(self, matrix: np.ndarray, ids: np.ndarray):
        self.matrix, self.ids = matrix, ids
        self.order = np.ascontiguousarray(np.argsort(matrix, axis=0, kind="stable").T.astype(np.int32))
        self.values = np.take_along_axis(matrix.T, self.order, axis=1)

    def search(self, query: np.ndarray, k: int, floor=None, own: int | None = None):
        """(rows, scores) of the k best rows for query, score descending, then id ascending; with
        a floor, those of them that reach it. own: a row that is left out."""
        n = len(self.ids)
        seen = np.zeros(n, dtype=bool)
        if own is not None:
            seen[own] = True
        active = np.flatnonzero(query != 0)
        weights = query[active]
        ascending = (weights < 0)[:, None]
        rows, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=self.matrix.dtype)
        start, end = 0, FIRST_DEPTH if len(active) else n
        while start < n:
            end = min(end, n)
            if len(active):
                met = np.where(ascending, self.order[active, start:end], self.order[active, n - end:n - start][:, ::-1]).ravel()
                met = met[~seen[met]]
                seen[met] = True
                met = np.unique(met)
            else:
                met = np.flatnonzero(~seen)  # every product is 0
                seen[met] = True
            got = self.matrix[met] @ query
            least = floor if len(rows) < k else scores[-1] if floor is None else max(floor, scores[-1])
            if least is not None:
                good = np.flatnonzero(got >= least)
                met, got = met[good], got[good]
            if len(met):
                rows, scores = np.concatenate([rows, met]), np.concatenate([scores, got])
                best = np.lexsort((self.ids[rows], -scores))[:k]
                rows, scores = rows[best], scores[best]
            # no row that isn't met yet can score more than this
            threshold = (np.where(ascending[:, 0], self.values[active, end - 1], self.values[active, n - end]) * weights).sum() if len(active) else 0
            if (len(rows) == k and scores[-1] > threshold) or (floor is not None and floor > threshold):
                break
            start, end = end, 2 * end
        return rows, scores


def _matrix(column: pa.ChunkedArray, dims: int, exact: bool) -> np.ndarray:
    """Rows of whole numbers, padded with zeros: doubles, or Python's integers if exact."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), dims))
    out[np.arange(dims) < lengths[:, None]] = flat
    if not exact:
        return out
    whole = np.empty(out.shape, dtype=object)
    for at in np.ndindex(out.shape):
        whole[at] = int(out[at])
    return whole


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return column.fill_null(NO_ID).to_numpy()


def _found(hits: list[tuple]) -> pa.Table:
    """hits: (query row, query id, ids, missing, scores)."""
    out = [[], [], [], []]
    for row, query, ids, missing, scores in hits:
        out[0].extend([row] * len(ids))
        out[1].extend([query] * len(ids))
        out[2].extend(None if gone else int(i) for i, gone in zip(ids, missing, strict=True))
        out[3].extend(min(max(int(s), LONG_MIN), LONG_MAX) for s in scores)
    return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in out], schema=FOUND_ARROW)


def _search_own(dims: int, exact: bool, k: int, divisor: int):
    """Function of a block's table: its queries against the block itself."""

    def run(block: pa.Table) -> pa.Table:
        lists = SortedLists(_matrix(block["v"], dims, exact), _ids(block["vec_id"]))
        missing, numbers = block["vec_id"].is_null().to_numpy(), block["row"].to_numpy()
        hits = []
        for at in np.flatnonzero(~missing & (lists.ids % divisor == 0)):
            rows, scores = lists.search(lists.matrix[at], k, own=int(at))
            hits.append((int(numbers[at]), int(lists.ids[at]), lists.ids[rows], missing[rows], scores))
        return _found(hits)

    return run


def _search_others(dims: int, exact: bool, k: int):
    """Function of a block's table and a table of queries of other blocks, with floors."""

    def run(block: pa.Table, queries: pa.Table) -> pa.Table:
        if not block.num_rows or not queries.num_rows:
            return _found([])
        lists = SortedLists(_matrix(block["v"], dims, exact), _ids(block["vec_id"]))
        missing = block["vec_id"].is_null().to_numpy()
        wanted = _matrix(queries["wanted"], dims, exact)
        hits = []
        for q, number, name, floor in zip(wanted, *(queries[c].to_pylist() for c in ("query", "query_id", "floor")), strict=True):
            rows, scores = lists.search(q, k, floor=floor)
            hits.append((number, name, lists.ids[rows], missing[rows], scores))
        return _found(hits)

    return run


def top_k(embeddings: DataFrame, k: int = K, divisor: int = QUERY_DIVISOR) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for every row whose id divisor divides."""
    spark = embeddings.sparkSession
    vectors = stored(integer_vectors(embeddings), "topk-vectors")
    is_query: Column = F.col("vec_id") % divisor == 0
    n, wanted, dims, peak = vectors.agg(
        F.count(F.lit(1)), F.count_if(is_query), F.max(F.size("v")),
        F.max(F.array_max(F.transform("v", F.abs)))).first()
    dims, exact = dims or 0, (peak or 0) ** 2 * (dims or 0) >= 2 ** 53
    n_blocks = max(1, math.ceil(n / BLOCK_ROWS), min(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / LEAST_BLOCK_ROWS)))
    parts = max(1, math.ceil(wanted / QUERY_ROWS))
    blocks = vectors.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n_blocks)).cast("int"))
    own = stored(blocks.groupBy("block").applyInArrow(_search_own(dims, exact, k, divisor), FOUND), "topk-own")
    found = own
    if n_blocks > 1:
        floors = own.groupBy("query").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
        queries = (blocks.where(is_query).join(floors, F.col("row") == F.col("query"), "left")
                   .withColumn("home", F.col("block")).withColumn("part", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(parts)).cast("int")))
        # the stated query set meets every block but its own: in parts, a block for each
        sent = (queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).where("block != home")
                .select(F.col("block").alias("to_block"), F.col("part").alias("of_part"), F.col("row").alias("query"),
                        F.col("vec_id").alias("query_id"), F.col("v").alias("wanted"), "floor"))
        held = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select("block", "part", "vec_id", "v")
        others = (held.groupBy("block", "part").cogroup(sent.groupBy("to_block", "of_part"))
                  .applyInArrow(_search_others(dims, exact, k), FOUND))
        found = own.unionByName(others)
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def oracle(k: int = K, divisor: int = QUERY_DIVISOR) -> str:
    """DuckDB SQL for top_k() over embeddings of one length."""
    return f"""
WITH vectors AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: floor({SCALE} * c::DOUBLE)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
scored AS (
  SELECT q.r AS query, q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM vectors q JOIN vectors c ON q.r <> c.r WHERE q.vec_id % {divisor} = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id ASC NULLS LAST)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {k}"""
