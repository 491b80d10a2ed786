"""Exact top-k search: term-at-a-time accumulation into dense score arrays, partition selection and merge."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from memlake.llm.common import small_batches, stored

#: Queries a block, and candidates scored at a time: together they bound the score array of a task, 32 MB.
QUERY_BLOCK, SCORED = 4096, 1024
SCALE, TOP = 1024, 10
#: Below any score, and its negative is a number too.
LOW = np.iinfo(np.int64).min + 1


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(row, vec_id, v): a number of the row, and floor(scale * x) of every component; vectors null or with null or
    non-finite components go. Stored, so that the numbers are the same for queries and candidates. Null, repeated and
    clashing ids stay: a row is told by its number."""
    x = F.col("embedding")
    usable = x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    used = vectors.where(F.coalesce(usable, F.lit(False)))
    return stored(used.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v")), "search-rows")


class Postings:
    """Weighted postings of a block of rows: for each term the rows that have it and their weights."""

    def __init__(self, rows: list[np.ndarray]):
        self.n = len(rows)
        sizes = [len(r) for r in rows]
        own, term = np.repeat(np.arange(self.n), sizes), np.concatenate([np.arange(s) for s in sizes] or [np.zeros(0, np.int64)])
        weight = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        order = np.lexsort((own, term))
        order = order[weight[order] != 0]
        term, own, weight = term[order], own[order], weight[order]
        heads = np.flatnonzero(np.diff(term, prepend=-1))
        self.lists = {int(term[a]): (own[a:b], weight[a:b]) for a, b in zip(heads, [*heads[1:], len(term)])}


def scores(queries: np.ndarray, block: Postings) -> np.ndarray:
    """Dense integer scores (row, query): term by term, the weights of the queries that have it times those of its
    postings are scattered into the rows of the postings."""
    out = np.zeros((block.n, len(queries)), np.int64)
    for t, (rows, weights) in block.lists.items():
        if t < queries.shape[1]:
            asks = np.flatnonzero(queries[:, t])
            if len(asks) == len(queries):
                out[rows] += np.multiply.outer(weights, queries[:, t])
            elif len(asks):
                out[np.ix_(rows, asks)] += np.multiply.outer(weights, queries[asks, t])
    return out


def _ordered(score: np.ndarray, ids: np.ndarray, known: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids, null ids last."""
    return np.lexsort((ids, ~known, -score))[:k]


class Best:
    """The k best candidates of each query so far."""

    def __init__(self, n: int, k: int):
        none = np.zeros(0, np.int64)
        self.k, self.found = k, [(none, none, none.astype(bool))] * n

    def add(self, score: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        """Of each query's scores (row, query) the k highest by partition selection, merged with those before."""
        k = self.k
        floor = -np.partition(-score, k - 1, axis=0)[k - 1] if len(score) > k else np.full(score.shape[1], LOW + 1)
        for q, (s, i, n) in enumerate(self.found):
            least = max(floor[q], LOW + 1, s[-1] if len(s) == k else LOW + 1)
            at = np.flatnonzero(score[:, q] >= least)
            if len(at):
                s, i, n = np.concatenate([s, score[at, q]]), np.concatenate([i, ids[at]]), np.concatenate([n, known[at]])
                o = _ordered(s, i, n, k)
                self.found[q] = s[o], i[o], n[o]


RESULT = pa.schema([("qrow", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _ids(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    return column.fill_null(0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)


def _rows(column) -> list[np.ndarray]:
    off, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [flat[a:b] for a, b in zip(off[:-1], off[1:])]


def _searched(queries: pa.Table, k: int):
    """The scan of candidates for one block of queries (row, vec_id, v)."""
    vectors = queries.column("v").to_pylist()
    matrix = np.zeros((len(vectors), max(map(len, vectors), default=0)), np.int64)
    for r, v in enumerate(vectors):
        matrix[r, : len(v)] = v
    asks = matrix, queries.column("row").to_numpy(), queries.column("vec_id").to_pylist()

    def run(batches):
        matrix, qrow, qid = asks
        place = {int(r): n for n, r in enumerate(qrow)}
        best = Best(len(qrow), k)
        for batch in batches:
            row = batch.column(0).to_numpy()
            (ids, known), v = _ids(batch.column(1)), _rows(batch.column(2))
            for j in range(0, len(v), SCORED):
                score = scores(matrix, Postings(v[j : j + SCORED]))
                for n, r in enumerate(row[j : j + SCORED].tolist()):
                    if r in place:
                        score[n, place[r]] = LOW
                best.add(score, ids[j : j + SCORED], known[j : j + SCORED])
        size = [len(s) for s, _, _ in best.found]
        if sum(size):
            s, i, n = (np.concatenate(x) for x in zip(*best.found))
            at = np.repeat(np.arange(len(size)), size)
            yield pa.RecordBatch.from_arrays([pa.array(qrow[at]), pa.array([qid[a] for a in at], pa.int64()), pa.array(i, mask=~n), pa.array(s)], schema=RESULT)

    return run


def top_k(queries: DataFrame, candidates: DataFrame, k: int = TOP, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row of ``queries`` (row, vec_id, v) the ``k`` highest inner products
    among all rows of ``candidates`` (the same) with another row number.

    Candidates are scanned where they lie; each scan meets one block of about ``block`` queries, which is sent to all
    tasks, and only k results a query leave a task. So a task holds a block of queries, one batch of candidates and
    its results, and the scans grow with the number of blocks. Repeated query rows each get their results; repeated
    candidates each count; candidates without an id come after all others of their score; a query without an id has a
    null query_id. Empty inputs give an empty result."""
    spark = queries.sparkSession
    small_batches(spark, 2048)
    blocks = max(1, -(-queries.count() // block))
    own = F.pmod(F.xxhash64("row"), F.lit(blocks))
    order = W.partitionBy("qrow").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    out = None
    for b in range(blocks):
        asked = queries.where(own == b).select("row", "vec_id", "v").toArrow()
        found = candidates.select("row", "vec_id", "v").mapInArrow(_searched(asked, k), "qrow long, query_id long, vec_id long, score long")
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        found = stored(found, "search-block") if blocks > 1 else found
        out = found if out is None else out.unionByName(found)
    return out


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return top_k(vectors.where(F.col("vec_id") % 100 == 0), vectors)


OP1_SQL = """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.rid <> c.rid),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
