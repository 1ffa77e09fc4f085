"""Packing into optimal length buckets.

One aggregation gives the global histogram of lengths; dynamic programming over it chooses the bucket boundaries of
least total padding; inside each bucket, documents are dealt into batches of at most `budget` padded tokens. Buckets
are dealt in shards of about `shard_rows` rows, so that no task holds a whole bucket.

The histogram is exact and reaches the driver: k different lengths need k * k / 2 tokens, so 10**14 bytes of text have
a few million at most, 16 bytes each. `Packing(grid=True)` takes lengths of over FINE tokens up to the next of STEPS
points a doubling instead, which bounds it by some thousand points at the price of boundaries on the grid.

Defined results: a null text or one without words has length 0 and goes to the first bucket; a document longer than
the budget, however long, is a batch of its own; repeated rows are packed each on its own, any null ids among them;
extra columns are ignored; an empty table gives an empty result. Ties of boundaries go to the smaller one. Documents of
one id and length may change places in a batch from run to run, which no figure shows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .common import rows_of, stored

FINE, STEPS = 1024, 256
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Packing:
    buckets: int = 16
    budget: int = 32768
    shard_rows: int = 2048
    grid: bool = False


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def grid_point(length: Column) -> Column:
    """The least grid point that is no less than a length, and 1 at least."""
    n = F.greatest(length, F.lit(1)).cast("long")
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(n.cast("double")) + 1e-12) - 8, F.lit(0))).cast("long")
    return F.when(n <= FINE, n).otherwise(F.ceil(n / step).cast("long") * step).cast("long")


def boundaries(points: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most `buckets` buckets over ascending points, minimising sum(count * bound).

    best[b][j] = min over i < j of best[b-1][i] + points[j-1] * counts[i:j]; the best i doesn't fall as j rises, so
    each row is filled by halving ranges of j, all ranges of a level at a time.
    """
    k = len(points)
    if not k:
        return []
    total = np.concatenate(([0.0], np.cumsum(counts.astype(np.float64))))
    bound = points.astype(np.float64)
    row = np.concatenate(([0.0], np.full(k, np.inf)))
    back = []
    for b in range(min(buckets, k)):
        # with b buckets before it, a bucket begins at i = b or later
        new, arg = np.full(k + 1, np.inf), np.zeros(k + 1, np.int64)
        lo, hi, a, z = (np.array([x]) for x in (b + 1, k, b, k - 1))
        while len(lo):
            j = (lo + hi) // 2
            last = np.minimum(z, j - 1)
            width = last - a + 1
            i = rows_of(a, width)
            mid = np.repeat(j, width)
            cost = row[i] + bound[mid - 1] * (total[mid] - total[i])
            first = np.cumsum(width) - width
            new[j] = np.minimum.reduceat(cost, first)
            hit = np.flatnonzero(cost == np.repeat(new[j], width))
            arg[j] = i[hit[np.searchsorted(hit, first)]]
            lo, hi, a, z = np.concatenate((lo, j + 1)), np.concatenate((j - 1, hi)), np.concatenate((a, arg[j])), np.concatenate((arg[j], z))
            going = lo <= hi
            lo, hi, a, z = lo[going], hi[going], a[going], z[going]
        back.append(arg)
        row = new
    out, j = [], k
    for arg in reversed(back):
        if j:
            out.append(int(points[j - 1]))
            j = int(arg[j])
    return out[::-1]


def pack(lengths: DataFrame, packing: Packing = Packing()) -> DataFrame:
    """Batches for lengths(doc_id, n_tokens): adds bucket_len, batch_id and slot."""
    # texts are counted once; the number of a row is fixed as it is written, and tells repeated rows apart
    lengths = stored(lengths.select("doc_id", "n_tokens", F.monotonically_increasing_id().alias("row")), "lengths")
    points = lengths.withColumn("point", grid_point(F.col("n_tokens")) if packing.grid else F.greatest("n_tokens", F.lit(1).cast("long")))
    hist = sorted((r["point"], r["n"]) for r in points.groupBy("point").agg(F.count("*").alias("n")).toLocalIterator())
    at, counts = np.array([p for p, _ in hist], np.int64), np.array([n for _, n in hist], np.int64)
    bounds = boundaries(at, counts, packing.buckets)
    held = [int(counts[(at <= b) & (at > a)].sum()) for a, b in zip([0, *bounds], bounds, strict=False)]
    shards = [max(1, -(-n // packing.shard_rows)) for n in held]
    room = [max(1, packing.budget // b) for b in bounds]

    def by_bucket(values: list[int]) -> Column:
        out = F.lit(values[-1] if values else 1)
        for bound, value in reversed(list(zip(bounds[:-1], values[:-1], strict=True))):
            out = F.when(F.col("point") <= bound, F.lit(value)).otherwise(out)
        return out.cast("long")

    dealt = points.withColumn("bucket", by_bucket(list(range(len(bounds))))).withColumn("bucket_len", by_bucket(bounds)).withColumn("room", by_bucket(room))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("row"), by_bucket(shards)))
    place = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("doc_id", "n_tokens", "row")) - 1
    dealt = dealt.withColumn("place", place.cast("long"))
    return dealt.select(
        "doc_id", "n_tokens", "bucket_len", F.concat_ws("-", "bucket", "shard", F.floor(F.col("place") / F.col("room"))).alias("batch_id"), (F.col("place") % F.col("room")).alias("slot")
    )


def pack_documents(docs: DataFrame, packing: Packing = Packing()) -> DataFrame:
    """Batches of whole documents, by words."""
    return pack(docs.select("doc_id", word_count(F.col("text")).alias("n_tokens")), packing)
