"""Exact top-k search by the threshold algorithm over sorted lists.

Vectors are cut into blocks. A block holds, for each dimension, its rows sorted by that component. A
query walks all lists downward from the end that suits the sign of its component, in steps of growing
depth; rows met for the first time are scored in full. The sum of |query component| x component at the
current depth bounds every row not met: once it is below the kth score so far, the rest of the block
can't enter the result. The kth score goes along from block to block, so later blocks end sooner.

Blocks of queries meet blocks of candidates in cells, a task each; every cell gives k rows a query, and
a window over these gives the result. Candidates are copied once a block of queries and queries once a
block of candidates: both numbers follow from counts taken first, and there are as many cells as the
shuffle has partitions at least.

Edge cases: vectors that are null or hold null, NaN or infinite components take no part; of vectors of
different lengths the shorter count as filled up with zeros; every row is a candidate and, if asked for, a
query of its own, repeated rows too: only the query's own row is left out; ties go to the smaller id, null
after all, and among rows of the same id to the row that is read first; rows without an id are candidates
and no queries; an empty table gives an empty result; other columns are ignored. Vectors are as long as
their block's longest: memory of a cell is its rows times that. Scores are exact while sums of products stay below 2 ** 53.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored, table

K = 20
#: Rows of a block with lists of its own; candidates and queries of a cell.
BLOCK, CANDIDATES, QUERIES = 8192, 1 << 15, 1 << 10
#: Queries that a cell has at least before cells are made smaller to use the cluster.
LEAST_QUERIES = 64
FIRST_DEPTH, GROWTH = 32, 4


class Lists:
    """A block of rows, and of each dimension the rows in falling order."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        self.order = np.argsort(-rows, axis=0, kind="stable").T  # dimension, depth
        self.values = np.take_along_axis(rows, self.order.T, axis=0).T

    def search(self, query: np.ndarray, own: int, best: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
        """The best (scores, ids) so far, and what this block adds to them."""
        n = len(self.ids)
        down, up = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        met = self.ids == own
        depth, size = 0, FIRST_DEPTH
        while depth < n:
            to = min(n, size)
            seen = np.zeros(n, bool)
            seen[self.order[down, depth:to].ravel()] = True
            seen[self.order[up, n - to : n - depth].ravel()] = True
            if to == n:
                seen[:] = True  # also what a query of zeros never meets
            new = np.flatnonzero(seen & ~met)
            met |= seen
            if len(new):
                scores = self.rows[new] @ query if 2 * len(new) < n else (self.rows @ query)[new]
                best = top(np.concatenate([best[0], scores]), np.concatenate([best[1], self.ids[new]]), k)
            bound = (self.values[down, to - 1] * query[down]).sum() + (self.values[up, n - to] * query[up]).sum()
            if len(best[0]) == k and best[0][-1] > bound or met.all():
                break
            depth, size = to, size * GROWTH
        return best


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest scores, ties to smaller ids, in order."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = scores >= least
        scores, ids = scores[keep], ids[keep]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def search(vectors: DataFrame, queries: Column, k: int = K, key: str = "vec_id", vector: str = "vector") -> DataFrame:
    """(query_id, rank, key, score): of each row for which `queries` holds its k rows with the highest inner products. Vectors are arrays of whole numbers."""
    # a row is told from others by its place in the stored table
    own = stored(vectors.select(F.col(key).alias("_key"), F.col(vector).alias("_vector"), F.monotonically_increasing_id().alias("_row"), F.coalesce(queries, F.lit(False)).alias("_asks")))
    n_vectors, n_queries = own.agg(F.count("*"), F.count_if("_asks")).first()
    least = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    across, down = max(1, -(-n_vectors // CANDIDATES)), max(1, -(-n_queries // QUERIES))
    down = max(down, min(-(-least // across), -(-n_queries // LEAST_QUERIES)))
    one = own.select("_key", "_vector", "_row", "_asks", F.pmod(F.xxhash64("_row"), F.lit(across)).cast("int").alias("_i"), F.pmod(F.xxhash64("_row", F.lit(1)), F.lit(down)).cast("int").alias("_j"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = one.drop("_j").withColumn("_j", every(down)).withColumn("_cell", F.col("_i") * down + F.col("_j")).select("_cell", "_key", "_row", "_vector")
    right = one.where("_asks").drop("_i").withColumn("_i", every(across)).withColumn("_cell", F.col("_i") * down + F.col("_j")).select("_cell", "_key", "_row", "_vector")
    schema = pa.schema([("_row", pa.int64()), ("query_id", pa.int64()), ("_key", pa.int64()), ("_of", pa.int64()), ("score", pa.int64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        width = max(int(pc.max(pc.list_value_length(t["_vector"])).as_py()) for t in (left, right))
        # in order of id and row, so that places in the block stand for both
        left = left.sort_by([("_key", "ascending"), ("_row", "ascending")])
        rows, asked = matrix(left["_vector"], width), matrix(right["_vector"], width)
        places = np.arange(left.num_rows)
        at = dict(zip(left["_row"].to_pylist(), places.tolist()))
        blocks = [Lists(places[i : i + BLOCK], rows[i : i + BLOCK]) for i in range(0, len(places), BLOCK)]
        found, scores, size = [], [], []
        for row, query in zip(right["_row"].to_pylist(), asked):
            best = (np.zeros(0), np.zeros(0, np.int64))
            for block in blocks:
                best = block.search(query, at.get(row, -1), best, k)
            found.append(best[1])
            scores.append(best[0])
            size.append(len(best[1]))
        of = pa.array(np.concatenate(found))
        who = pa.array(np.repeat(np.arange(right.num_rows), size))
        return pa.table([right["_row"].take(who), right["_key"].take(who), left["_key"].take(of), left["_row"].take(of), pa.array(np.concatenate(scores).astype(np.int64))], schema=schema)

    met = left.groupBy("_cell").cogroup(right.groupBy("_cell")).applyInArrow(run, "_row bigint, query_id bigint, _key bigint, _of bigint, score bigint")
    place = F.row_number().over(Window.partitionBy("_row").orderBy(F.desc("score"), F.asc_nulls_last("_key"), "_of"))
    return met.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", F.col("_key").alias(key), "score")


def scaled(df: DataFrame, key: str = "vec_id", vector: str = "embedding", by: int = 64) -> DataFrame:
    """(key, vector): components times `by`, rounded down; without vectors that have no place in a search."""
    whole = F.transform(F.col(vector), lambda x: x.cast("double"))
    fit = F.col(vector).isNotNull() & F.forall(whole, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return df.where(fit).select(F.col(key), F.transform(whole, lambda x: F.floor(x * by).cast("double")).alias("vector"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(scaled(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 20 == 0)


def sql() -> str:
    return """
    WITH a AS (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, q.n, c.n AS m, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
        FROM a q JOIN a c ON c.n <> q.n WHERE q.vec_id % 20 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id NULLS LAST, m)::INTEGER AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""
