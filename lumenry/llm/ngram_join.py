"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

1. A count sketch of fixed size over all shingles of the corpus orders shingles, rarest first (ties by hash). Prefix
   filtering holds for any one order, so the sketch only decides how few candidates there are, never which links.
2. Of each distinct set, the prefix goes to an index: two sets that link share a shingle of both prefixes.
3. Each shared shingle's members are tied to one pivot rather than to each other: a star of candidates. Pairs that
   pass the length, positional and suffix filters are verified exactly, and components follow.
4. Where members of a shingle are still in different components, the remaining pairs are filtered and verified in
   blocks; no link is lost, and no list of all pairs is made. A second pass over components ends it.

The suffix filter compares maps of counters of four bits, one for four shingles or fewer, in which each shingle counts at
its hash: the lesser counts of both maps bound the overlap. A token's group of two members whose sizes and places rule a
link out is left before maps are sent. Shingles are 64-bit hashes; equal sets
share a 64-bit key, so all copies of a text count as one set.

Defined results: null and empty texts have no shingles and are linked with nothing; repeated rows are copies of each
other; a null doc_id is linked like any other, and is never a component's name unless all its members are null; texts
of any length count whole; of ties, the least doc_id names a component; extra columns are ignored (`ngram_join`) or kept
(`keep_one`), whatever their names but `__id`, `__of` and `__digest`; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import bloom
from .common import batches, bounded, hot_keys, rows_of, salted_join, stored
from .graph import connected_components
from .shingles import count_maps, map_bytes, most_common, set_keys, shingle_hashes, shingle_sets

SKETCH_SLICES = 64


@dataclass(frozen=True)
class Join:
    """Link where 100 * intersection >= percent * union."""

    n: int = 4
    percent: int = 85
    sketch_bits: int = 24
    block: int = 256


def least_overlap(a, b, percent: int):
    """ceil(percent / (100 + percent) * (a + b)) in whole numbers."""
    return -((-percent * (a + b)) // (100 + percent))


def prefix_length(size: np.ndarray, percent: int) -> np.ndarray:
    """Shingles of which one is shared by all sets of enough overlap: size - ceil(percent * size / 100) + 1."""
    return size + (-percent * size) // 100 + 1


def _bytes_of(texts: list) -> list[bytes]:
    return [(t or "").encode() for t in texts]


def rarity(docs: DataFrame, join: Join) -> np.ndarray:
    """How often shingles stand in the corpus, by their hash's upper bits, in 255 steps of a logarithm.

    Counts are over all texts; the table has 1 << sketch_bits bytes whatever the corpus.
    """
    size, width = 1 << join.sketch_bits, (1 << join.sketch_bits) // SKETCH_SLICES
    shift = np.uint64(64 - join.sketch_bits)
    schema = "slice int, part int, counts binary"

    def count(rows):
        from pyspark import TaskContext

        total = np.zeros(size, np.uint32)
        for piece in batches(rows):
            at, n = np.unique((shingle_hashes(_bytes_of(piece["text"]), join.n)[0] >> shift).astype(np.int64), return_counts=True)
            total[at] += n.astype(np.uint32)
        if total.any():
            part = TaskContext.get().partitionId()
            packed = [zlib.compress(x.tobytes(), 1) for x in total.reshape(SKETCH_SLICES, width)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SKETCH_SLICES), pa.int32()), pa.array([part] * SKETCH_SLICES, pa.int32()), pa.array(packed)], names=["slice", "part", "counts"])

    def add(table, last):
        total = np.zeros(width, np.uint64)
        for x in table["counts"].to_pylist():
            total += np.frombuffer(zlib.decompress(x), np.uint32)
        out = np.minimum(np.log2(total + 1.0) * 8, 255).astype(np.uint8) if last else np.minimum(total, 2**32 - 1).astype(np.uint32)
        return pa.table({"slice": table["slice"].slice(0, 1), "part": pa.array([0], pa.int32()), "counts": pa.array([zlib.compress(out.tobytes(), 1)])})

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, schema)
    # partial sums of 64 partitions each, then of those: no group grows with the corpus
    near = found.groupBy("slice", F.floor(F.col("part") / 64).alias("some")).applyInArrow(lambda key, t: add(t, False), schema)
    out = np.zeros((SKETCH_SLICES, width), np.uint8)
    for row in near.groupBy("slice").applyInArrow(lambda t: add(t, True), schema).toLocalIterator():
        out[row["slice"]] = np.frombuffer(zlib.decompress(row["counts"]), np.uint8)
    return out.reshape(-1)


def text_digest() -> Column:
    """64 bits of a text; they need to differ only among rows of one doc_id."""
    return F.xxhash64(F.col("text").cast("string"))


def described(docs: DataFrame, counts: np.ndarray, join: Join, digests: bool = False) -> DataFrame:
    """doc_id, sid (the set's key), size, sig (its map of counters) and the prefix's tokens, rarest first.

    Of copies in one batch, only the first has a map and tokens. With digests, also the text's.
    """
    shift = np.uint64(64 - join.sketch_bits)
    held = docs.sparkSession.sparkContext.broadcast(counts)  # 1 << sketch_bits bytes, whatever the corpus

    def lists(flat: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(flat, kind))

    def run(rows):
        for piece in batches(rows):
            h, at = shingle_sets(_bytes_of(piece["text"]), join.n)
            sizes, keys = np.diff(at), set_keys(h, at)
            _, first = np.unique(keys, return_index=True)
            mine = np.zeros(len(keys), bool)
            mine[first] = True
            owner = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((h, held.value[(h >> shift).astype(np.int64)], owner))
            taken = np.where(mine & (sizes > 0), prefix_length(sizes, join.percent), 0)
            place = np.arange(len(h)) - np.repeat(at[:-1], sizes)
            tokens = h[order[place < taken[owner]]].view(np.int64)
            own = mine[owner]
            sig = count_maps(h[own], np.concatenate(([0], np.cumsum(np.where(mine, sizes, 0)))))
            more = [pa.array(piece["digest"], pa.int64())] if digests else []
            yield pa.RecordBatch.from_arrays(
                [pa.array(piece["doc_id"], pa.int64()), pa.array(keys.view(np.int64)), pa.array(sizes.astype(np.int32)), sig, lists(tokens, taken, pa.int64()), *more],
                names=["doc_id", "sid", "size", "sig", "tokens", *["digest"] * digests],
            )

    asked = [F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"), *[text_digest().alias("digest")] * digests]
    return docs.select(*asked).mapInArrow(run, "doc_id long, sid long, size int, sig binary, tokens array<long>" + ", digest long" * digests)


def _fits(percent: int):
    """Length and positional filters of a pair with sizes and places of one shared shingle."""
    need = F.ceil((F.lit(percent) * (F.col("size_a") + F.col("size_b"))) / (100 + percent))
    length = (100 * F.least("size_a", "size_b")) >= (percent * F.greatest("size_a", "size_b"))
    # shingles of either set after the shared one, plus those before it in both
    reach = F.least("size_a", "size_b")
    position = F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b")) + F.least("place_a", "place_b")
    return length & (reach >= need) & (position >= need)


def link(index: DataFrame, fetch: Callable[[DataFrame], DataFrame], signatures: Callable[[DataFrame], DataFrame], percent: int, block: int = 256) -> DataFrame:
    """Links (a, b) that span the components of all pairs that share a token and whose Jaccard similarity is enough.

    index: token, sid, size, place. fetch: ids (sid) to their sets (sid, items, sorted). signatures: ids (sid) to
    their maps (sid, sig).
    """
    ends = index.groupBy("token").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi")).where("lo <> hi").select("token")
    members = stored(index.join(ends, "token").select("token", "sid", "size", "place"), "members")
    sigs = stored(signatures(members.select("sid").distinct()), "signatures")
    # a token's pivot is the set with the fewest rarer shingles, most likely what the others were copied from; each
    # other set is tied to the one pivot that it shares most tokens with
    pivots = members.groupBy("token").agg(F.min(F.struct("place", "sid", "size")).alias("q"))
    pivots = stored(pivots.select("token", F.col("q.sid").alias("p"), F.col("q.size").alias("size_a"), F.col("q.place").alias("place_a")), "pivots")
    star = members.join(pivots, "token").where("sid <> p").select(F.col("p").alias("a"), "size_a", "place_a", F.col("sid").alias("b"), F.col("size").alias("size_b"), F.col("place").alias("place_b"))
    often = star.where(_fits(percent)).groupBy("a", "b", "size_a", "size_b").agg(F.count("*").alias("n"))
    best = often.groupBy("b").agg(F.max(F.struct("n", "a", "size_a", "size_b")).alias("m")).select("m.a", "b", "m.size_a", "m.size_b")
    links = stored(verify(_suffix(best, sigs, percent), fetch, percent), "links")
    return links.union(_remaining(members, pivots, links, sigs, fetch, percent, block))


def _suffix(pairs: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, size_a, size_b) whose sets could overlap enough, judged by their maps."""
    joined = pairs.join(sigs.select(F.col("sid").alias("a"), F.col("sig").alias("sig_a")), "a").join(sigs.select(F.col("sid").alias("b"), F.col("sig").alias("sig_b")), "b")

    def run(batches):
        for batch in batches:
            a, b, sizes = batch.column("a"), batch.column("b"), np.concatenate([batch.column(c).to_numpy() for c in ("size_a", "size_b")]).astype(np.int64)
            flat, begin, room = map_bytes(pa.chunked_array([batch.column("sig_a"), batch.column("sig_b")]))
            n, fine = batch.num_rows, np.zeros(batch.num_rows, bool)
            for x, y in _slices(np.maximum(room[:n], room[n:]), WORK_BYTES):
                i = np.arange(x, y)
                fine[x:y] = _enough(most_common(flat, begin, room, sizes, i, i + n), sizes[i], sizes[i + n], percent)
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(fine))

    return joined.mapInArrow(run, "a long, b long")


def verify(pairs: DataFrame, fetch: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """Pairs (a, b) whose sets are similar enough, exactly; each pair is compared once."""
    pairs = stored(pairs.select("a", "b").distinct(), "candidates")
    need = stored(pairs.select(F.col("a").alias("sid")).union(pairs.select(F.col("b").alias("sid"))).distinct(), "needed")
    sets = fetch(need)
    both = pairs.join(sets.select(F.col("sid").alias("b"), F.col("items").alias("items_b")), "b").join(sets.select(F.col("sid").alias("a"), F.col("items").alias("items_a")), "a")
    common = F.size(F.array_intersect("items_a", "items_b"))
    return both.select("a", "b", common.alias("n"), (F.size("items_a") + F.size("items_b")).alias("m")).where((100 + percent) * F.col("n") >= percent * F.col("m")).select("a", "b")


#: Bytes of maps that are compared at a time.
WORK_BYTES = 1 << 21
WORK = "token long, other boolean, x int, y int, sid long, size int, component long, inner boolean, block int"


def _enough(common: np.ndarray, a, b, percent: int) -> np.ndarray:
    return common * (100 + percent) >= percent * (a + b)


def _changes(t: pa.Table) -> np.ndarray:
    """True where a piece of work begins."""
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for c in ("token", "other", "x", "y"):
        value = t[c].to_numpy() if c != "other" else t[c].to_numpy(zero_copy_only=False)
        new[1:] |= value[1:] != value[:-1]
    return new


def _slices(counts: np.ndarray, most: int):
    """Ranges of places whose counts add up to `most` at most, or of one place."""
    upto = np.cumsum(counts)
    a = 0
    while a < len(counts):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def _sides(key, t) -> tuple:
    """Columns of one piece of work, and the rows that meet each other."""
    sid, size, comp, where = (t[c].to_numpy() for c in ("sid", "size", "component", "block"))
    inner = t["inner"].to_numpy(zero_copy_only=False)
    other, x, y = (key[i].as_py() for i in (1, 2, 3))
    left, right = (np.flatnonzero(where == x), np.flatnonzero(where == y)) if other else (np.flatnonzero(~inner), np.flatnonzero(inner))
    return sid, size.astype(np.int64), comp.copy(), left, right


def _remaining(members: DataFrame, pivots: DataFrame, links: DataFrame, sigs: DataFrame, fetch: Callable[[DataFrame], DataFrame], percent: int, block: int) -> DataFrame:
    """Links among tokens' members that are in different components so far.

    Of a token's members, those in its pivot's component need no pairs among each other. The others are dealt into
    blocks; each meets blocks of the pivot's component, and each other, so that no task holds a whole group. Members
    that could link by length and suffix filter in their piece of work are sent their sets and verified there; what
    leaves a piece of work are links that join components, no more than its members.
    """
    components = connected_components(links)
    own = components.select(F.col("id").alias("sid"), "component")
    root = components.select(F.col("id").alias("p"), F.col("component").alias("root"))
    lit = members.join(pivots.select("token", "p"), "token").join(own, "sid", "left").join(root, "p", "left")
    lit = lit.select("token", "sid", "size", "place", F.coalesce("component", "sid").alias("component"), (F.coalesce("component", "sid") == F.coalesce("root", "p")).alias("inner")).dropDuplicates(["token", "sid"])
    # tokens of the same members are one group: the least such token stands for all
    pick = lambda seed: F.sum(F.xxhash64("sid", F.lit(seed)).cast("decimal(38,0)"))
    groups = lit.groupBy("token").agg(F.count_if("inner").alias("m"), F.count_if(~F.col("inner")).alias("o"), pick(1).alias("h1"), pick(2).alias("h2"), *(f(F.struct("sid", "size", "place")).alias(c) for f, c in ((F.min, "a"), (F.max, "b")))).where("o > 0")
    # most groups are pairs, which sizes and places tell already
    groups = groups.select("token", "m", "o", "h1", "h2", *(F.col(f"{x}.{c}").alias(f"{c}_{x}") for x in "ab" for c in ("size", "place")))
    groups = groups.where((F.col("m") + F.col("o") > 2) | _fits(percent))
    groups = groups.groupBy("m", "o", "h1", "h2").agg(F.min("token").alias("token"))
    blocks = groups.select("token", (F.col("o") == 1).alias("single"), F.ceil(F.col("m") / (4 * block)).cast("int").alias("ms"), F.ceil(F.col("o") / block).cast("int").alias("os"))
    rows = lit.join(blocks, "token").join(sigs, "sid")
    mine = F.pmod(F.xxhash64("sid"), F.when(F.col("inner"), F.col("ms")).otherwise(F.col("os"))).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)
    work = lambda other, x, y: F.struct(F.lit(other).alias("other"), x.cast("int").alias("x"), y.cast("int").alias("y"))
    meets = F.transform(upto(F.col("ms")), lambda j: work(False, F.col("block"), j))
    alike = F.transform(upto(F.col("os")), lambda j: work(True, F.least("block", j), F.greatest("block", j)))
    tasks = F.when(F.col("inner"), F.transform(upto(F.col("os")), lambda i: work(False, i, F.col("block")))).otherwise(F.when(F.col("single"), meets).otherwise(F.concat(meets, alike)))
    dealt = rows.withColumn("block", mine).select("token", "sid", "size", "component", "inner", "block", "sig", F.explode(tasks).alias("w"))
    names = ["token", "other", "x", "y", "sid", "size", "component", "inner", "block"]
    dealt = dealt.select("token", "w.other", "w.x", "w.y", *names[4:], "sig")

    def possible(t: pa.Table) -> np.ndarray:
        """Which members have a partner in another component that passes the filters; t holds whole pieces of work."""
        size, comp = t["size"].to_numpy().astype(np.int64), t["component"].to_numpy()
        flat, begin, room = map_bytes(t["sig"])
        other, inner = (t[c].to_numpy(zero_copy_only=False) for c in ("other", "inner"))
        where, x, y = (t[c].to_numpy() for c in ("block", "x", "y"))
        unit = np.cumsum(_changes(t)) - 1
        left, right = np.flatnonzero(np.where(other, where == x, ~inner)), np.flatnonzero(np.where(other, where == y, inner))
        first = np.searchsorted(unit[right], np.arange(unit[-1] + 2))
        many = np.diff(first)[unit[left]]
        alive = np.zeros(len(size), bool)
        # partners of each left member one after another, a bounded number of pairs at a time
        for a, b in _slices(many * room[left], WORK_BYTES):
            i = np.repeat(left[a:b], many[a:b])
            j = right[rows_of(first[unit[left[a:b]]], many[a:b])]
            fine = (comp[i] != comp[j]) & (100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j])) & ~(alive[i] & alive[j])
            i, j = i[fine], j[fine]
            fine = _enough(most_common(flat, begin, room, size, i, j), size[i], size[j], percent)
            alive[i[fine]] = True
            alive[j[fine]] = True
        return alive

    def living(batches):
        """Rows come sorted by piece of work; a piece that a batch's end cuts waits for its rest."""
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            last = int(np.flatnonzero(_changes(t))[-1])
            held = t.slice(last)
            if last:
                done = t.slice(0, last)
                yield from done.filter(pa.array(possible(done))).select(names).combine_chunks().to_batches()
        if held is not None:
            yield from held.filter(pa.array(possible(held))).select(names).combine_chunks().to_batches()

    def verified(key, t):
        """Links that join components, by exact overlaps: products of membership in tokens that two or more sets share."""
        sid, size, comp, left, right = _sides(key, t)
        items = t["items"].combine_chunks()
        owner = np.repeat(np.arange(len(sid)), np.diff(items.offsets.to_numpy()))
        kinds, token, counts = np.unique(items.values.to_numpy(), return_inverse=True, return_counts=True)
        common = counts[token] > 1
        owner, token = owner[common], (np.cumsum(counts > 1) - 1)[token[common]]
        order = np.argsort(token, kind="stable")
        owner, token = owner[order], token[order]
        overlap = np.zeros((len(left), len(right)), np.float32)
        width = 2048
        for begin in range(0, int(token[-1]) + 1 if len(token) else 0, width):
            a, b = np.searchsorted(token, (begin, begin + width))
            held = np.zeros((len(sid), width), np.float32)
            held[owner[a:b], token[a:b] - begin] = 1
            overlap += held[left] @ held[right].T
        out = []
        for n, i in enumerate(left):
            js = np.flatnonzero((comp[right] != comp[i]) & _enough(overlap[n].astype(np.int64), size[right], size[i], percent))
            _, lead = np.unique(comp[right[js]], return_index=True)
            for j in right[js[lead]]:
                out.append((min(sid[i], sid[j]), max(sid[i], sid[j])))
                comp[comp == comp[j]] = comp[i]
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    keys = ["token", "other", "x", "y"]
    alive = stored(dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(living, WORK), "alive")
    if alive.isEmpty():
        return links.limit(0)
    # pieces of work with the same members on the same sides are one: the least stands for all
    left = F.when(F.col("other"), F.col("block") == F.col("x")).otherwise(~F.col("inner"))
    right = F.when(F.col("other"), F.col("block") == F.col("y")).otherwise(F.col("inner"))
    mark = lambda seed: F.sum(F.xxhash64("sid", left, right, F.lit(seed)).cast("decimal(38,0)"))
    alike = alive.groupBy(*keys).agg(F.count("*").alias("m"), mark(1).alias("h1"), mark(2).alias("h2")).groupBy("m", "h1", "h2").agg(F.min(F.struct(*keys)).alias("k"))
    alive = stored(alive.join(alike.select("k.*"), keys, "left_semi"), "work")
    sets = fetch(stored(alive.select("sid").distinct(), "needed"))
    full = alive.join(sets, "sid").select(*names, "items")
    return stored(full.groupBy(*keys).applyInArrow(verified, "a long, b long").distinct(), "more")


def fetched(docs: DataFrame, wanted: DataFrame, sets_in: Callable[[dict], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """sid and items of the sets of wanted(sid, doc_id), read anew from docs; a few others may come along.

    sets_in gives keys, items and bounds of all sets of a piece of docs. While the wanted ones fit a filter of fixed
    size, texts are filtered where they are read and no text moves; beyond that they are joined.
    """
    wanted = stored(wanted, "wanted")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    if wanted.count() <= bloom.ROOM // 2:
        keys = wanted.select(F.col("doc_id").alias("key"), F.lit(1).alias("salt")).union(wanted.select(F.col("sid").alias("key"), F.lit(2).alias("salt")))
        held = docs.sparkSession.sparkContext.broadcast(bloom.build(keys))  # BITS / 8 bytes, whatever the corpus
        chosen = None
    else:
        held = None
        ids = wanted.select(F.col("doc_id").alias("wanted_id")).distinct()
        chosen = texts.join(ids, F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi")

    def run(rows):
        for batch in rows:
            small = batch if held is None else batch.filter(pa.array(bloom.holds(held.value, batch.column("doc_id"), 1)))
            for piece in batches([small]):
                keys, items, at = sets_in(piece)
                listed = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(items.view(np.int64)))
                out = pa.RecordBatch.from_arrays([pa.array(keys), listed], names=["sid", "items"])
                yield out if held is None else out.filter(pa.array(bloom.holds(held.value, keys_column(keys), 2)))

    found = (texts if chosen is None else chosen).mapInArrow(run, "sid long, items array<long>")
    # copies of a text give their set once each; one stays
    return stored(found, "found").join(wanted.select("sid"), "sid", "left_semi").dropDuplicates(["sid"])


def keys_column(keys: np.ndarray) -> pa.Array:
    return pa.array(keys, pa.int64())


def named_rows(docs: DataFrame, join: Join, digests: bool = False) -> DataFrame:
    """doc_id, size, sid and component (and digest) for each row of docs(doc_id, text)."""
    docs = bounded(docs)
    sets = stored(described(docs, rarity(docs, join), join, digests), "doc_sets")
    reps = sets.where("size > 0").groupBy("sid").agg(F.min("doc_id").alias("doc_id"))
    index = sets.select("sid", "size", F.posexplode("tokens").alias("place", "token")).select("token", "sid", "size", "place")

    def sets_in(piece: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h, at = shingle_sets(_bytes_of(piece["text"]), join.n)
        return set_keys(h, at).view(np.int64), h, at

    def fetch(need: DataFrame) -> DataFrame:
        return fetched(docs, reps.join(need, "sid", "left_semi"), sets_in)

    def signatures(need: DataFrame) -> DataFrame:
        return sets.where(F.size("tokens") > 0).select("sid", "sig").join(need, "sid", "left_semi").dropDuplicates(["sid"])

    links = link(index, fetch, signatures, join.percent, join.block)
    components = connected_components(links)
    copies = hot_keys(sets.groupBy("sid").agg(F.count("*").alias("n")), ["sid"])
    named = salted_join(sets, components.withColumnRenamed("id", "sid"), ["sid"], copies, ["doc_id"], "left").select("doc_id", "size", "sid", F.coalesce("component", "sid").alias("component"), *["digest"] * digests)
    return stored(named, "named")


def ngram_join(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """doc_id, n_shingles and component_id for each row of docs(doc_id, text)."""
    named = named_rows(docs, join)
    least = stored(named.where("size > 0").groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n")), "least")
    full = salted_join(named, least.drop("n"), ["component"], hot_keys(least, ["component"]), ["doc_id"], "left")
    return full.select("doc_id", F.col("size").cast("long").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """docs with one row of each component, with all their columns; rows without shingles stay.

    The row of the least doc_id stays, null last, then of the least digest of its text. Rows are told apart by both; of
    rows that repeat both any one stays. Partial aggregation takes in copies where they are read, however many.
    """
    # rows of one doc_id and text in one component count as one
    keys = named_rows(docs, join, True).where("size > 0").groupBy("component", "doc_id", "digest").agg(F.count("*").alias("n"))
    keys = stored(keys.withColumn("rank", F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")), "keys")
    first = stored(keys.groupBy("component").agg(F.min("rank").alias("first"), F.count("*").alias("m")), "first")
    ruled = salted_join(keys, first.drop("m"), ["component"], hot_keys(first, ["component"], "m"), ["doc_id", "digest"]).select(F.col("doc_id").alias("__id"), F.col("digest").alias("__of"), "n", (F.col("rank") == F.col("first")).alias("lead"))
    ruled = stored(ruled.where("not lead or n > 1"), "gone")
    again = stored(ruled.where("lead").drop("n", "lead"), "again")
    marked = docs.withColumn("__digest", text_digest())
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__of"))
    kept = marked.join(ruled.select("__id", "__of"), same, "left_anti")
    if not again.isEmpty():
        kept = kept.union(marked.join(again, same, "left_semi").dropDuplicates(["doc_id", "__digest"]))
    return kept.drop("__digest")
