"""Dense retrieval: exact top-k by cosine over blocks of vectors, and the nearest-neighbour graph."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .lexical import top_k

#: Queries of a block that are scored at once, and how far below the k-th score one may be that equals it once rounded.
SLICE, NEAR = 256, 1e-11


def _blocks(n: int, most: int, tasks: int) -> int:
    return max(1, math.ceil(n / most), min(tasks, n // 256))


def nearest(queries: DataFrame, corpus: DataFrame, k: int, qid: str = "query_id", id: str = "id", vector: str = "embedding", skip_self: bool = False, block_rows: int = 16384, n_queries: int | None = None, n_corpus: int | None = None) -> DataFrame:
    """query_id, rank, id, score: the k vectors of greatest dot product. Vectors are taken as normalised.

    Queries and corpus are dealt into blocks by hash, and each pair of blocks is one matrix product; only the k best of
    each query leave it. Nothing is broadcast, and a task holds two blocks whatever the number of vectors, and the scores of
    some queries at a time. A search is exact, so work grows with queries times corpus, spread over all pairs of blocks. Sides whose numbers of rows are known,
    which only set the numbers of blocks, needn't be counted.
    """
    if k <= 0:
        return queries.where(F.lit(False)).select(F.col(qid).alias("query_id"), F.lit(1).alias("rank"), F.lit(None).cast("long").alias("id"), F.lit(0.0).alias("score"))
    tasks = max(1, int(queries.sparkSession.sparkContext.defaultParallelism ** 0.5))
    qn, cn = (_blocks(df.count() if n is None else n, block_rows, tasks) for df, n in ((queries, n_queries), (corpus, n_corpus)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    q = queries.select(F.col(qid).cast("long").alias("query_id"), F.col(vector).alias("v"), dealt(qid, qn).alias("qb")).withColumn("cb", every(cn))
    c = corpus.select(F.col(id).cast("long").alias("id"), F.col(vector).alias("v"), dealt(id, cn).alias("cb")).withColumn("qb", every(qn))

    def best(key, left, right):
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        matrix = lambda t: np.stack(t["v"].to_numpy(zero_copy_only=False)).astype(np.float64)
        qids, ids = left["query_id"].to_numpy(), right["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, held = ids[order], matrix(right)[order].T
        keep, asked, parts = min(k, len(ids)), matrix(left), []
        for begin in range(0, len(qids), SLICE):
            scores = asked[begin : begin + SLICE] @ held
            if skip_self:
                scores[qids[begin : begin + SLICE, None] == ids[None, :]] = -np.inf
            # only what may be among the k best once rounded is rounded and sorted
            least = np.partition(scores, len(ids) - keep, axis=1)[:, len(ids) - keep, None] - NEAR
            row, at = np.nonzero(scores >= least)
            value = np.round(scores[row, at], 12)
            order = np.lexsort((at, -value, row))
            row, at, value = row[order], at[order], value[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            real = (place < keep) & np.isfinite(value)
            parts.append((qids[begin + row[real]], ids[at[real]], value[real]))
        return pa.table(dict(zip(("query_id", "id", "score"), map(np.concatenate, zip(*parts, strict=True)), strict=True)))

    scored = q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb")).applyInArrow(best, "query_id long, id long, score double")
    return top_k(scored, k).select("query_id", "rank", "id", "score")


def knn_graph(vectors: DataFrame, k: int = 5, id: str = "id", vector: str = "embedding") -> DataFrame:
    """source_id, target_id, score of each vector's k nearest others."""
    found = nearest(vectors, vectors, k, qid=id, id=id, vector=vector, skip_self=True)
    return found.select(F.col("query_id").alias("source_id"), F.col("id").alias("target_id"), "score")


def neighbours(edges: DataFrame, nodes: DataFrame, sources: DataFrame, limit: int = 5) -> DataFrame:
    """query_id (a source), rank, id, score and the target's node columns; the best edges first."""
    rows = edges.join(sources.select("source_id"), "source_id", "left_semi").join(nodes.withColumnRenamed("id", "target_id"), "target_id")
    return top_k(rows.withColumnRenamed("source_id", "query_id").withColumnRenamed("target_id", "id"), limit)
