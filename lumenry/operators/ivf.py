"""Dense search below all pairs: vectors in cells around centroids, of which a query reads only those near it.

Centroids come from a bounded sample, every vector is put into the cell of its nearest centroid, and the table is
partitioned by cell, so that a search scans the cells it probes. A cell knows its longest vector and its widest angle to
the centroid; by the triangle inequality of angles this bounds what any of its vectors can score, which makes a search
exact: the cells whose bound isn't below the k-th score of those probed are read too. Scores are dot products.
"""

from __future__ import annotations

import posixpath
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..storage import new_path, stored
from .lexical import PLACES, top_k

#: Vectors that centroids are fitted to, at most, and steps of fitting.
SAMPLE, STEPS = 20_000, 12
#: Of those, the ones that are asked in order to choose the number of probes, for how many neighbours and what recall.
TRIED, NEIGHBOURS, RECALL = 400, 10, 0.95
#: Vectors of a cell that a task holds: larger cells are dealt into parts.
PART_ROWS = 4096
SLACK = 10.0 ** (1 - PLACES)


@dataclass(frozen=True)
class Cells:
    """table(cell, part, id, embedding) and about(cell, n, parts, least, longest): rows, parts, the least cosine to the centroid
    and the greatest length."""

    table: DataFrame
    about: DataFrame
    centroids: np.ndarray
    path: str
    probes: int


def centroids(sample: np.ndarray, cells: int, steps: int = STEPS, seed: int = 0) -> np.ndarray:
    """Unit vectors by k-means of angles; copies of a vector count once, and a cell that runs empty begins anew at the vector
    farthest from its own."""
    sample = np.unique(sample, axis=0)
    cells = min(cells, len(sample))
    rng = np.random.default_rng(seed)
    out = sample[rng.choice(len(sample), cells, replace=False)] if cells else sample[:0]
    for _ in range(steps if cells else 0):
        scores = sample @ out.T
        own = scores.argmax(axis=1)
        sums = np.zeros_like(out)
        np.add.at(sums, own, sample)
        counts = np.bincount(own, minlength=cells)
        empty = np.flatnonzero(counts == 0)
        if len(empty):
            sums[empty] = sample[np.argsort(scores.max(axis=1), kind="stable")[: len(empty)]]
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        out = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), out)
    return out


def probes_for(sample: np.ndarray, middle: np.ndarray, tried: int = TRIED, k: int = NEIGHBOURS, recall: float = RECALL) -> int:
    """How many cells near it a vector must read for this recall of its neighbours in the sample. Among more vectors they are
    nearer, so a larger table has the same recall or a better one."""
    if len(sample) < 2:
        return 1
    step = max(1, len(sample) // tried)
    asked = sample[::step]
    scores = asked @ sample.T
    scores[np.arange(len(asked)), np.arange(len(asked)) * step] = -np.inf
    k = min(k, len(sample) - 1)
    near = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    own = (sample @ middle.T).argmax(axis=1)
    rank = np.empty((len(asked), len(middle)), np.int64)
    np.put_along_axis(rank, np.argsort(-(asked @ middle.T), axis=1, kind="stable"), np.arange(len(middle))[None, :], axis=1)
    needed = np.sort(np.take_along_axis(rank, own[near], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1


def _matrix(column) -> np.ndarray:
    values = column.to_numpy(zero_copy_only=False) if not isinstance(column, pa.ChunkedArray) else column.combine_chunks().to_numpy(zero_copy_only=False)
    return np.stack(values).astype(np.float64) if len(values) else np.zeros((0, 0))


def _unit(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions, zeros for zeros, and lengths."""
    length = np.linalg.norm(m, axis=1)
    return m / np.maximum(length, 1e-300)[:, None], length


def build(vectors: DataFrame, cells: int | None = None, path: str | None = None, id: str = "id", vector: str = "embedding", part_rows: int = PART_ROWS, sample: int = SAMPLE, seed: int = 0) -> Cells:
    """Cells of vectors(id long, embedding); about the square root of their number unless told.

    Centroids are fitted on the driver to `sample` vectors at most, those of the least digests of id, which also tell how many
    cells a search probes; all vectors are indexed.
    """
    spark = vectors.sparkSession
    path = path or new_path(spark, "cells")
    rows = vectors.select(F.col(id).cast("long").alias("id"), F.col(vector).alias("embedding")).where("embedding is not null")
    n = rows.count()
    drawn = rows.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(1, n // sample))) == 0) if n > sample else rows
    few = drawn.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample).select("embedding").toArrow()
    units = _unit(_matrix(few.column(0)))[0] if few.num_rows else np.zeros((0, 1))
    middle = centroids(units, max(1, round(n**0.5)) if cells is None else cells, seed=seed)
    shared = spark.sparkContext.broadcast(middle)  # `cells` vectors

    def assign(batches):
        for r in batches:
            if not r.num_rows:
                continue
            units, lengths = _unit(_matrix(r.column("embedding")))
            scores = units @ shared.value.T
            yield pa.RecordBatch.from_arrays([*r.columns, pa.array(scores.argmax(axis=1), pa.int32()), pa.array(scores.max(axis=1), pa.float64()), pa.array(lengths)], names=["id", "embedding", "cell", "near", "length"])

    kind = rows.schema["embedding"].dataType.simpleString()
    placed = stored(rows.mapInArrow(assign, f"id long, embedding {kind}, cell int, near double, length double"), "placed")
    about = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("near").alias("least"), F.max("length").alias("longest")).withColumn("parts", F.ceil(F.col("n") / part_rows).cast("int"))
    about.coalesce(1).write.parquet(posixpath.join(path, "about"))  # a row a cell
    about = spark.read.schema("cell int, n long, least double, longest double, parts int").parquet(posixpath.join(path, "about"))
    dealt = placed.join(F.broadcast(about.select("cell", "parts")), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    dealt.select("cell", "part", "id", "embedding").repartition("cell", "part").sortWithinPartitions("cell", "part").write.partitionBy("cell").parquet(posixpath.join(path, "vectors"))
    table = spark.read.schema(f"part int, id long, embedding {kind}, cell int").parquet(posixpath.join(path, "vectors"))
    return Cells(table, about, middle, path, probes_for(units, middle))


def _bounds(cells: Cells, queries: DataFrame) -> DataFrame:
    """query_id, cell, near, bound, parts for all pairs of a query and a cell: what a cell's best vector can score at most.

    With a the angle of a query to the centroid and r that of the cell's farthest vector, none is at less than a - r."""
    about = {r["cell"]: r for r in cells.about.collect()}  # a row a cell
    held = np.array(sorted(about), np.int64)
    of = lambda c: np.array([about[x][c] for x in held.tolist()], np.float64)
    reach = np.arccos(np.clip(of("least"), -1, 1)) + 1e-7
    shared = cells.table.sparkSession.sparkContext.broadcast((cells.centroids[held] if len(held) else cells.centroids, held, reach, of("longest"), of("parts").astype(np.int32)))

    def run(batches):
        middle, held, reach, longest, parts = shared.value
        for r in batches:
            if not r.num_rows or not len(held):
                continue
            units, lengths = _unit(_matrix(r.column("embedding")))
            near = units @ middle.T
            bound = lengths[:, None] * longest * np.maximum(0, np.cos(np.maximum(0, np.arccos(np.clip(near, -1, 1)) - reach)))
            ids = r.column("query_id").to_numpy(zero_copy_only=False)
            n, m = near.shape
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, m)), pa.array(np.tile(held, n), pa.int32()), pa.array(near.ravel()), pa.array(bound.ravel()), pa.array(np.tile(parts, n))], names=["query_id", "cell", "near", "bound", "parts"])

    return queries.mapInArrow(run, "query_id long, cell int, near double, bound double, parts int")


def _scored(cells: Cells, queries: DataFrame, pairs: DataFrame, k: int, query_rows: int = 4096) -> DataFrame:
    """query_id, id, score: the k best of each part of each (query_id, cell, parts) pair, parts and blocks of queries in pairs of matrices."""
    used = [r["cell"] for r in pairs.select("cell").distinct().collect()]  # as many as cells at most
    crowd = stored(pairs.groupBy("cell").agg(F.ceil(F.count("*") / query_rows).cast("int").alias("blocks")), "crowds")
    asked = pairs.join(F.broadcast(crowd), "cell").join(queries.select("query_id", F.col("embedding").alias("v")), "query_id")
    asked = asked.select("query_id", "v", "cell", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    held = cells.table.where(F.col("cell").isin(used)).join(F.broadcast(crowd), "cell").select("id", F.col("embedding").alias("v"), "cell", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

    def best(key, left, right):
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        qids, ids = left["query_id"].to_numpy(), right["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, scores = ids[order], np.round(_matrix(left["v"]) @ _matrix(right["v"])[order].T, 12)
        keep = min(k, len(ids))
        at = np.argsort(-scores, axis=1, kind="stable")[:, :keep]
        rows = np.repeat(np.arange(len(qids)), keep)
        return pa.table({"query_id": qids[rows], "id": ids[at.ravel()], "score": scores[rows, at.ravel()]})

    return asked.groupBy("cell", "part", "block").cogroup(held.groupBy("cell", "part", "block")).applyInArrow(best, "query_id long, id long, score double")


def search(cells: Cells, queries: DataFrame, k: int, probes: int | None = None, exact: bool = True, qid: str = "query_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, id, score of the k nearest vectors: of the `probes` cells nearest each query (as many as the index was tuned to), and if exact, of all cells
    that could still hold one."""
    probes = probes or cells.probes
    asked = stored(queries.select(F.col(qid).cast("long").alias("query_id"), F.col(vector).alias("embedding")).where("embedding is not null"), "asked_vectors")
    bounds = stored(_bounds(cells, asked), "cell_bounds")
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("near"), "cell"))
    numbered = bounds.withColumn("n", order)
    first = stored(top_k(_scored(cells, asked, stored(numbered.where(F.col("n") <= probes).select("query_id", "cell", "parts"), "probed"), k), k).select("query_id", "rank", "id", "score"), "first_found")
    if not exact:
        return first
    least = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    more = numbered.where(F.col("n") > probes).join(least, "query_id", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - SLACK))
    rest = _scored(cells, asked, stored(more.select("query_id", "cell", "parts"), "more_cells"), k)
    return top_k(first.select("query_id", "id", "score").unionByName(rest), k).select("query_id", "rank", "id", "score")
