"""Maps of sets, whose size decides what op4's and op1's suffix filters send."""

import numpy as np

from lumenry.llm import ngram_join, shingles


def test_maps_bound_overlaps_and_are_small(spark):
    rng = np.random.default_rng(7)
    sizes = [1, 2, 9, 40, 41, 300, 310, 330, 0, 2000, 2000]
    pool = rng.integers(0, 2**63, 400, np.int64).astype(np.uint64)
    sets = [np.unique(rng.choice(pool, s, False)) if s <= 400 else rng.integers(0, 2**63, s, np.int64).astype(np.uint64) for s in sizes]
    # all on one counter, more than it holds
    sets += [np.arange(200, dtype=np.uint64) << np.uint64(20), np.arange(20, 210, dtype=np.uint64) << np.uint64(20)]
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    flat, first, room = shingles.map_bytes(shingles.count_maps(np.concatenate(sets), at))
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    held = (room[i] > 0) & (room[j] > 0)
    i, j = i[held], j[held]
    bound = shingles.most_common(flat, first, room, np.diff(at), i, j)
    assert all(b >= len(np.intersect1d(sets[x], sets[y])) for b, x, y in zip(bound, i, j, strict=True))
    assert bound[(i == 9) & (j == 10)][0] < 1600 and bound[(i == 11) & (j == 12)][0] == 190

    df = spark.createDataFrame([(n, " ".join(f"w{n}x{k}" for k in range(500 + n))) for n in range(9)], "doc_id long, text string")
    join = ngram_join.Join(sketch_bits=8)
    size, held = ngram_join.described(df, ngram_join.rarity(df, join), join).selectExpr("sum(size)", "sum(length(sig))").first()
    assert held <= size / 4  # eight bits a shingle before
