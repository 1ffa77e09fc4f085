"""A Merkle manifest of a dataset, by bitmap ranks.

Each group's ids are a bitmap of words of WORD bits, of which only words with a bit are held; tasks' words are merged by
bitwise or, and a directory of popcounts, in three levels of at most 2^20 entries, tells how many rows of the group come
before a word. An id's rank is the directory's number plus a popcount within its word: that is its leaf's place, and no
leaf is sorted. Places of equal ids come from the same index over the leaves' digests, and of equal leaves over row
numbers. Leaves then meet in keyed slot arrays of fan ** LEVELS places, each of which is reduced by LEVELS levels at once,
and so on with the results until one node is left; proofs go down the same arrays. Groups are ordered by ranges.

Defined results: a null id comes before all others; rows of one id are leaves each on its own, ordered by digest; null
fields are `-`; a null group is the first; tampering needs an id; extra columns are ignored; an empty table gives an empty
result; texts are hashed whole in the JVM.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..operators.places import numbered
from .common import bounded, hot_keys, salted_join, stored

FAN_BITS, LEVELS = 3, 3
FAN, BLOCK_BITS = 1 << FAN_BITS, FAN_BITS * LEVELS
BLOCK = 1 << BLOCK_BITS
WORD_BITS, DIRECTORY_BITS = 6, 20
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Stands for a null id: before all others.
NO_ID = -(1 << 63)


def value(c: Column) -> Column:
    text = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*inputs: Column) -> Column:
    return F.sha2(F.concat(*inputs), 256)


def leaf_rows(docs: DataFrame) -> DataFrame:
    """key, doc_id, leaf, other, row: key is the group, orderable, and other the leaf of a tampered row. Stored, so that rows keep their numbers."""
    kept = docs.select(*FIELDS)
    head = [value(F.col(c)) for c in FIELDS[:-1]]
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    rows = kept.select(
        F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.unhex(digest(*head, value(F.col("text")))).alias("leaf"),
        F.when(tampered, F.unhex(digest(*head, value(F.translate("text", upper, lower))))).alias("other"), F.monotonically_increasing_id().alias("row"),
    )
    return stored(rows, "leaves")


def bitmap(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """group, word, bits, n, more, before, total: a sparse bitmap of values and its directory of popcounts.

    n counts rows, more lists bits whose value repeats with how often beyond once, before is the number of the group's
    rows in lesser words and total that of all.
    """
    bit = (F.col(value).bitwiseAND(F.lit((1 << WORD_BITS) - 1))).cast("int")
    placed = rows.select(*group, F.shiftright(value, WORD_BITS).alias("word"), bit.alias("bit"))
    words = stored(placed.groupBy(*group, "word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"), F.count("*").alias("n")), "words")
    crowded = words.where(F.col("n") > F.bit_count("bits")).select(*group, "word")
    again = placed.join(crowded, [*group, "word"], "left_semi").groupBy(*group, "word", "bit").agg((F.count("*") - 1).alias("more")).where("more > 0")
    listed = again.groupBy(*group, "word").agg(F.collect_list(F.struct("bit", "more")).alias("more"))
    leveled = words.join(listed, [*group, "word"], "left").withColumn("l1", F.shiftright("word", DIRECTORY_BITS)).withColumn("l2", F.shiftright("word", 2 * DIRECTORY_BITS))
    running = lambda *by: Window.partitionBy(*group, *by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    first = words.groupBy(*group, F.shiftright("word", DIRECTORY_BITS).alias("l1")).agg(F.sum("n").alias("n1")).withColumn("l2", F.shiftright("l1", DIRECTORY_BITS))
    second = first.groupBy(*group, "l2").agg(F.sum("n1").alias("n2"))
    none = F.lit(0).cast("long")
    second = second.withColumn("b2", F.coalesce(F.sum("n2").over(running("l2")), none)).withColumn("total", F.sum("n2").over(Window.partitionBy(*group)))
    first = first.join(second.drop("n2"), [*group, "l2"]).withColumn("b1", F.col("b2") + F.coalesce(F.sum("n1").over(running("l2", "l1")), none))
    out = leveled.join(first.select(*group, "l1", "b1", "total"), [*group, "l1"]).withColumn("before", F.col("b1") + F.coalesce(F.sum("n").over(running("l1", "word")), none))
    return stored(out.select(*group, "word", "bits", "n", "more", "before", "total"), "bitmap")


def ranked(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """rows with rank (how many of the group have lesser values), same (how many have this one) and total.

    Rows meet their word by a join; words that hold very many rows, all of them of at most 2 ** WORD_BITS values, are
    copied to the tasks over which such rows are dealt.
    """
    index = bitmap(rows, group, value)
    keyed = rows.withColumn("word", F.shiftright(value, WORD_BITS))
    both = salted_join(keyed, index, [*group, "word"], hot_keys(index, [*group, "word"]), ["row"])
    bit = F.col(value).bitwiseAND(F.lit((1 << WORD_BITS) - 1)).cast("int")
    both = both.withColumn("__bit", bit)
    below = F.bit_count(F.expr("bits & ~shiftleft(-1L, __bit)"))
    repeats = lambda test: F.coalesce(F.aggregate("more", F.lit(0).cast("long"), lambda a, x: a + F.when(test(x.bit), x.more).otherwise(F.lit(0))), F.lit(0))
    rank = F.col("before") + below + repeats(lambda b: b < F.col("__bit"))
    return both.withColumn("rank", rank.cast("long")).withColumn("same", (1 + repeats(lambda b: b == F.col("__bit"))).cast("long")).drop("word", "__bit", "bits", "n", "more", "before")


def positions(leaves: DataFrame) -> DataFrame:
    """leaves with pos, a leaf's place in its group from 0, and n, the group's number of leaves."""
    rows = leaves.withColumn("ord", F.coalesce("doc_id", F.lit(NO_ID)))
    group, value = ["key"], "ord"
    out, done = None, []
    rows = rows.withColumn("pos", F.lit(0).cast("long")).withColumn("size", F.lit(None).cast("long"))
    rows = rows.withColumn("head", F.conv(F.substring(F.hex("leaf"), 1, 15), 16, 10).cast("long"))
    for more in ("head", "row", None):
        found = stored(ranked(rows, group, value).withColumn("pos", F.col("pos") + F.col("rank")).withColumn("size", F.coalesce("size", "total")).drop("rank", "total"), "ranks")
        done.append(found.where("same = 1"))
        ties = found.where("same > 1").drop("same")
        if more is None or ties.isEmpty():
            break
        rows, group, value = ties, [*group, value], more
    for d in done:
        one = d.select("key", "doc_id", "leaf", "other", "pos", F.col("size").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def sha(data: str) -> str:
    return hashlib.sha256(data.encode()).hexdigest()


def reduced(nodes: list[str], n: int) -> list[list[str]]:
    """Levels of nodes within a block: its slots, and then what each LEVELS levels at most make of them; n is the whole level's number."""
    out = [nodes]
    while n > 1 and len(out) <= LEVELS:
        below = out[-1]
        out.append([sha("".join(below[i : i + FAN])) for i in range(0, len(below), FAN)])
        n = -(-n // FAN)
    return out


def slot_array(slots: list[dict], name: str) -> list:
    out = [None] * len(slots)
    for s in slots:
        out[s["slot"]] = s[name]
    return out


@dataclass
class Tree:
    """Stored slot arrays(key, block, n, slots) of each step up, and what is left of each key: roots(key, digest)."""

    blocks: list[DataFrame] = field(default_factory=list)
    roots: DataFrame | None = None


def grown(nodes: DataFrame, payload: tuple[str, ...] = ()) -> Tree:
    """The trees of nodes(key, pos, n, digest): every FAN consecutive ones become one, until a key has one left."""
    tree = Tree()
    while True:
        slot = F.col("pos").bitwiseAND(F.lit(BLOCK - 1)).cast("int").alias("slot")
        arrays = nodes.groupBy("key", F.shiftright("pos", BLOCK_BITS).alias("block")).agg(F.first("n").alias("n"), F.collect_list(F.struct(slot, "digest", *payload)).alias("slots"))
        arrays = stored(arrays, "slot_arrays")
        tree.blocks.append(arrays)

        def run(rows):
            for r in rows:
                up = []
                for n, slots in zip(r.column("n").to_pylist(), r.column("slots").to_pylist(), strict=True):
                    levels = reduced([d.hex() for d in slot_array(slots, "digest")], n)
                    up.append(bytes.fromhex(levels[-1][0]))
                ns = [-(-n // BLOCK) for n in r.column("n").to_pylist()]
                yield pa.RecordBatch.from_arrays([r.column("key"), r.column("block"), pa.array(ns, pa.int64()), pa.array(up, pa.binary())], names=["key", "pos", "n", "digest"])

        nodes = stored(bounded(arrays.select("key", "block", "n", "slots")).mapInArrow(run, "key string, pos long, n long, digest binary"), "nodes")
        tree.roots = (tree.roots.unionByName(nodes.where("n = 1")) if tree.roots else nodes.where("n = 1"))
        nodes, payload = nodes.where("n > 1"), ()
        if nodes.isEmpty():
            tree.roots = tree.roots.select("key", "digest")
            return tree


def steps_up(pos: int, n: int):
    """Place and size of a node's run on each level up to the root."""
    while n > 1:
        yield pos % FAN, min(FAN, n - pos // FAN * FAN)
        pos, n = pos // FAN, -(-n // FAN)


def folded(node: str, siblings: list[tuple[str, str]]) -> str:
    for left, right in siblings:
        node = sha(left + node + right)
    return node


def sides(proof: str, pos: int, n: int) -> list[tuple[str, str]]:
    """A proof's digests left and right of the way up, level by level."""
    out, at = [], 0
    for place, size in steps_up(pos, n):
        cut = at + 64 * place
        end = at + 64 * (size - 1)
        out.append((proof[at:cut], proof[cut:end]))
        at = end
    if at != len(proof):
        raise ValueError("the proof doesn't fit the place")
    return out


def block_proofs(levels: list[list[str]], n: int) -> list[list[tuple[str, str]]]:
    """For each slot, the digests left and right of its way up within its block."""
    out = [[] for _ in levels[0]]
    for k, nodes in enumerate(levels[:-1]):
        shift = FAN_BITS * k
        parts = []
        for i in range(len(nodes)):
            begin = i // FAN * FAN
            parts.append(("".join(nodes[begin:i]), "".join(nodes[i + 1 : begin + FAN])))
        for slot, way in enumerate(out):
            way.append(parts[slot >> shift])
    return out


PROOF = "key string, pos long, proof binary, place long, places long, subroot binary, root binary"


def descended(tree: Tree, tops: DataFrame) -> DataFrame:
    """Proofs of the blocks of a tree's leaves, of tops(key, proof, place, places, subroot, root) of its roots."""
    below = tops.withColumn("pos", F.lit(0).cast("long")).select("key", "pos", "proof", "place", "places", "subroot", "root")
    above = below
    for arrays in reversed(tree.blocks[1:]):
        # keys whose tree ends here have their proof from the top
        got = arrays.withColumnRenamed("block", "pos").join(above, ["key", "pos"])

        def run(rows):
            for r in rows:
                out: list[tuple] = []
                for key, block, n, slots, proof, *rest in zip(*(r.column(c).to_pylist() for c in ("key", "pos", "n", "slots", "proof", "place", "places", "subroot", "root")), strict=True):
                    levels = reduced([d.hex() for d in slot_array(slots, "digest")], n)
                    for slot, way in enumerate(block_proofs(levels, n)):
                        out.append((key, block * BLOCK + slot, bytes.fromhex("".join(a + b for a, b in way)) + proof, *rest))
                columns = list(zip(*out, strict=True)) or [()] * 7
                kinds = (pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["key", "pos", "proof", "place", "places", "subroot", "root"])

        higher = arrays.select("key").distinct()
        above = bounded(got).mapInArrow(run, PROOF).unionByName(below.join(higher, "key", "left_anti"))
    return above


RESULT = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def manifest(docs: DataFrame) -> tuple[Tree, DataFrame]:
    """The tree of leaves and, per group, tops(key, proof, place, places, subroot, root): its subroot's place among all
    groups' and its proof to the root."""
    tree = grown(positions(leaf_rows(docs)).withColumnRenamed("leaf", "digest"), ("doc_id", "other"))
    placed, n = numbered(tree.roots, "key", place="place")
    tops = placed.select(F.lit("").alias("key"), F.col("place").cast("long").alias("pos"), F.lit(n).cast("long").alias("n"), "digest", F.col("key").alias("group"))
    over = grown(tops, ("group",))
    root = over.roots.select("digest").withColumnRenamed("digest", "root")
    start = root.select(F.lit("").alias("key"), F.lit(b"").alias("proof"), F.lit(0).cast("long").alias("place"), F.lit(1).cast("long").alias("places"), F.col("root").alias("subroot"), "root")
    blocks = over.blocks[0].withColumnRenamed("block", "pos").join(descended(over, start), ["key", "pos"])

    def run(rows):
        for r in rows:
            out: list[tuple] = []
            for block, n, slots, proof, root in zip(*(r.column(c).to_pylist() for c in ("pos", "n", "slots", "proof", "root")), strict=True):
                digests, groups = slot_array(slots, "digest"), slot_array(slots, "group")
                for slot, way in enumerate(block_proofs(reduced([d.hex() for d in digests], n), n)):
                    out.append((groups[slot], bytes.fromhex("".join(a + b for a, b in way)) + proof, block * BLOCK + slot, n, digests[slot], root))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["key", "proof", "place", "places", "subroot", "root"])

    return tree, stored(bounded(blocks).mapInArrow(run, "key string, proof binary, place long, places long, subroot binary, root binary"), "tops")


def audit(docs: DataFrame) -> DataFrame:
    """leaf, subroot, root, proof_sha256, folded_root and verified of each row of docs: the manifest of all rows, and each row,
    tampered with or not, checked against it by its proof."""
    tree, tops = manifest(docs)
    blocks = tree.blocks[0].withColumnRenamed("block", "pos").join(descended(tree, tops), ["key", "pos"])

    def run(rows):
        for r in rows:
            out: list[tuple] = []
            for block, n, slots, proof, place, places, subroot, root in zip(*(r.column(c).to_pylist() for c in ("pos", "n", "slots", "proof", "place", "places", "subroot", "root")), strict=True):
                ids, others, leaves = slot_array(slots, "doc_id"), slot_array(slots, "other"), [d.hex() for d in slot_array(slots, "digest")]
                above, subroot, root = proof.hex(), subroot.hex(), root.hex()
                levels = reduced(leaves, n)
                ways = block_proofs(levels, n)
                up, m = block, n
                for _ in levels[1:]:
                    m = -(-m // FAN)
                inner = sum(size - 1 for _, size in steps_up(up, m)) * 64
                higher = sides(above[:inner], up, m) + sides(above[inner:], place, places)
                for slot, way in enumerate(ways):
                    got = folded(leaves[slot] if others[slot] is None else others[slot].hex(), way + higher)
                    out.append((ids[slot], leaves[slot], subroot, root, sha("".join(a + b for a, b in way) + above), got, got == root))
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = (pa.int64(), *[pa.string()] * 5, pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in RESULT.split(", ")])

    return bounded(blocks).mapInArrow(run, RESULT)
