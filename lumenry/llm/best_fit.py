"""Best-fit packing: bin completion by branch and bound.

Pieces of one length are alike, so a packing is planned over the histogram of lengths, `capacity` numbers whatever the
table: around the largest piece left, fillings that no other filling dominates are enumerated, the chosen one is taken as
often as the histogram allows, and branches go whose waste, or whose bound on what is left, can't lead to fewer sequences
than the incumbent. The first incumbent is the best-fit one. Pieces are then dealt to the plan's places by their rank
within their length: ranks come from counters of the tasks that write the pieces and from sums of those counts, so that
pieces are neither sorted nor gathered.

The plan takes at most `nodes` steps and looks at `breadth` fillings a step (Search); within these it is optimal, beyond
them the incumbent stays, whose distance from the lower bound is reported by Plan.gap. No piece is left out either way.

Defined results: a null or empty text is one piece of the end mark alone; pieces of null ids and repeated rows are packed
each on its own; extra columns stay; an empty table gives an empty result; ties of length are dealt in the order of
writing, so which of them share a sequence may change from run to run, while the number of sequences and each one's
lengths don't.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from .common import bounded, stored

#: A filling: (length, how many) from the longest to the shortest.
Filling = tuple[tuple[int, int], ...]


@dataclass(frozen=True)
class Search:
    """Steps of the search, and fillings that a step looks at."""

    nodes: int = 2000
    breadth: int = 200


@dataclass
class Plan:
    """Fillings with how many sequences have them, and the least number of sequences that is possible for all one knows."""

    capacity: int
    fillings: list[tuple[Filling, int]] = field(default_factory=list)
    bound: int = 0

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.fillings)

    @property
    def gap(self) -> int:
        return self.sequences - self.bound


def lower_bound(counts: np.ndarray) -> int:
    """Sequences that any packing of counts[length] needs: the best over all k of those longer than capacity - k, those
    over half, and what pieces of k to half need beyond the room beside the latter."""
    capacity = len(counts) - 1
    n = np.concatenate(([0], np.cumsum(counts)))  # n[i]: pieces shorter than i
    total = np.concatenate(([0], np.cumsum(counts * np.arange(capacity + 1))))
    half = capacity // 2
    k = np.arange(half + 1)
    over = n[capacity + 1] - n[capacity - k + 1]
    middle, middle_sum = n[capacity - k + 1] - n[half + 1], total[capacity - k + 1] - total[half + 1]
    small = total[half + 1] - total[k]
    rest = np.maximum(0, small - (middle * capacity - middle_sum))
    return int(np.max(over + middle + -(-rest // capacity)))


def fitted(left: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """The best-fit packing: the largest piece left, then again and again the largest that still fits."""
    left = dict(left)
    lengths, out = sorted(left), []
    while lengths:
        room, use, at = capacity, [], len(lengths)
        while at and room >= lengths[0]:
            at = bisect_right(lengths, room, 0, at)
            if not at:
                break
            x = lengths[at - 1]
            take = min(left[x], room // x)
            use.append((x, take))
            room -= take * x
            at -= 1
        copies = min(left[x] // c for x, c in use)
        out.append((tuple(use), copies))
        for x, c in use:
            left[x] -= c * copies
            if not left[x]:
                del left[x]
                lengths.remove(x)
    return out


def completions(room: int, lengths: list[int], left: dict[int, int], most_waste: int, breadth: int) -> list[Filling]:
    """Fillings of a room by lengths (ascending) that waste no more than most_waste, the greediest first, `breadth` looked at."""
    upto = [0]
    for x in lengths:
        upto.append(upto[-1] + x * left[x])
    out: list[Filling] = []
    seen = 0

    def fill(at: int, room: int, use: Filling) -> Iterator[Filling]:
        at = bisect_right(lengths, room, 0, at)
        for i in range(at - 1, -1, -1):
            if room - upto[i + 1] > most_waste:
                break  # all that are left don't fill it
            x = lengths[i]
            for c in range(min(left[x], room // x), 0, -1):
                yield from fill(i, room - c * x, (*use, (x, c)))
        yield use if room <= most_waste else ()

    for use in fill(len(lengths), room, ()):
        seen += 1
        if use:
            out.append(use)
        if seen >= breadth:
            break
    return out


def _spread(bits: int, width: int) -> int:
    """Bits moved up by 0 to width places."""
    done = 0
    while done < width:
        step = min(done + 1, width - done)
        bits |= bits << step
        done += step
    return bits


def undominated(use: Filling, room: int, spare: int) -> bool:
    """Whether no piece outside (spare: a bit for each length that has one) could stand for some of a filling's pieces and be
    no shorter than these together: it would do at least as well, and what it replaced would be left to fill elsewhere."""
    slack = room - sum(x * c for x, c in use)
    one, more = 0, 0
    for x, c in use:
        for _ in range(c):
            more |= (more << x) | (one << x)
            one |= 1 << x
    longer = _spread(one, slack) & ~one if slack else 0
    for x, _ in use:  # longer than this one, if it is another's length
        if slack:
            longer |= _spread(1 << (x + 1), slack - 1)
    return not spare & (longer | _spread(more, slack) | (_spread(2, slack - 1) if slack else 0))


def plan(counts: np.ndarray, search: Search = Search()) -> Plan:
    """A packing of counts[length] pieces into as few sequences of len(counts) - 1 as the search finds."""
    capacity = len(counts) - 1
    left = {int(x): int(counts[x]) for x in np.flatnonzero(counts)}
    best = Plan(capacity, fitted(left, capacity), lower_bound(counts))
    total = sum(x * n for x, n in left.items())
    counts = counts.astype(np.int64).copy()
    path: list[tuple[Filling, int]] = []
    waste = used = 0

    def choices() -> Iterator[tuple[Filling, int]]:
        lengths = sorted(left)
        first = lengths[-1]
        room, allowed = capacity - first, (best.sequences - 1) * capacity - total - waste
        left[first] -= 1
        others = [x for x in lengths if left[x]]
        found = completions(room, others, left, max(0, min(allowed, room)), search.breadth) if others else []
        good: list[tuple[int, int, Filling]] = []
        there = int.from_bytes(np.packbits(counts > (np.arange(capacity + 1) == first), bitorder="little").tobytes(), "little")
        for use in [*found, ()]:
            spare = there & ~sum(1 << x for x, c in use if left[x] == c)
            short = room - sum(x * c for x, c in use)
            if short <= allowed and undominated(use, room, spare):
                good.append((short, sum(c for _, c in use), use))
        left[first] += 1
        for short, _, use in sorted(good):
            whole = Counter({first: 1})
            for x, c in use:
                whole[x] += c
            filling = tuple(sorted(whole.items(), reverse=True))
            copies = min(left[x] // c for x, c in filling)
            copies = min(copies, max(1, allowed // short)) if short else copies
            yield filling, copies
            if copies > 1:
                yield filling, 1

    def take(filling: Filling, copies: int) -> None:
        nonlocal waste, used
        for x, c in filling:
            left[x] = left.get(x, 0) - c * copies
            counts[x] -= c * copies
            if not left[x]:
                del left[x]
        waste += copies * (capacity - sum(x * c for x, c in filling))
        used += copies

    stack = [choices()] if left else []
    nodes = 0
    while stack and nodes < search.nodes and best.gap > 0:
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
            if path:
                filling, copies = path.pop()
                take(filling, -copies)
            continue
        nodes += 1
        take(*step)
        if not left and used < best.sequences:
            best = Plan(capacity, [*path, step], best.bound)
        if not left or used + lower_bound(counts) >= best.sequences or waste > (best.sequences - 1) * capacity - total:
            take(step[0], -step[1])
            continue
        path.append(step)
        stack.append(choices())
    return best


def numbered(pieces: DataFrame, capacity: int) -> DataFrame:
    """pieces(length, ...) with the writing task and each piece's number among those of its length in that task. Narrow."""
    schema = StructType([*pieces.schema.fields, StructField("__task", LongType()), StructField("__nth", LongType())])

    def run(rows):
        task, passed = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for r in rows:
            length = r.column("length").to_numpy(zero_copy_only=False)
            if len(length) and not 0 < length.min() <= length.max() <= capacity:
                raise ValueError(f"a length is not in 1 to {capacity}")
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            first = np.searchsorted(ordered, ordered)
            nth = np.empty(len(length), np.int64)
            nth[order] = passed[ordered] + np.arange(len(length)) - first
            passed += np.bincount(length, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays([*r.columns, pa.array(np.full(len(length), task), pa.int64()), pa.array(nth)], names=[*r.schema.names, "__task", "__nth"])

    return bounded(pieces).mapInArrow(run, schema)


#: A rank and a length in one number: ranks are below it.
RANKS = 1 << 48


def places(p: Plan) -> dict[str, np.ndarray]:
    """The plan as intervals of ranks: from key on (length * RANKS + rank), `each` pieces of a sequence have the length, the
    first sequence is `sequence` and the first offset `offset`."""
    given: Counter = Counter()
    rows, sequence = [], 0
    for filling, copies in p.fillings:
        offset = 0
        for x, c in filling:
            rows.append((x * RANKS + given[x], sequence, offset, c))
            given[x] += c * copies
            offset += c * x
        sequence += copies
    rows.sort()
    return dict(zip(("key", "sequence", "offset", "each"), np.array(rows, np.int64).reshape(-1, 4).T, strict=True))


def pack(pieces: DataFrame, capacity: int = 2048, search: Search = Search()) -> DataFrame:
    """pieces(length long, ...) with sequence_id and offset: sequences of at most `capacity`, as few as the search finds.

    One shuffle, of pieces by (length, task) to the sums of counts. What is broadcast is the plan: no more rows than it has
    fillings times the different lengths of one, which hang on `capacity` and not on the number of pieces.
    """
    written = stored(numbered(pieces.withColumn("length", F.col("length").cast("long")), capacity), "pieces")
    counted = stored(written.groupBy("length", "__task").agg(F.count("*").alias("n")), "piece_counts")
    counts = np.zeros(capacity + 1, np.int64)
    for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect():  # capacity rows at most
        counts[r["length"]] = r["n"]
    intervals = pieces.sparkSession.sparkContext.broadcast(places(plan(counts, search)))
    before = Window.partitionBy("length").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("length", "__task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    ranked = written.join(offsets, ["length", "__task"]).withColumn("__rank", F.col("__before") + F.col("__nth")).drop("__task", "__nth", "__before")
    schema = StructType([*(f for f in ranked.schema if f.name != "__rank"), StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def run(rows):
        plan = intervals.value
        for r in rows:
            length, rank = (r.column(c).to_numpy(zero_copy_only=False) for c in ("length", "__rank"))
            at = np.searchsorted(plan["key"], length * RANKS + rank, side="right") - 1
            n = length * RANKS + rank - plan["key"][at] if len(length) else rank
            each = plan["each"][at]
            out = [pa.array(plan["sequence"][at] + n // each), pa.array(plan["offset"][at] + n % each * length)]
            names = [c for c in r.schema.names if c != "__rank"]
            yield pa.RecordBatch.from_arrays([*(r.column(c) for c in names), *out], names=[*names, "sequence_id", "offset"])

    return bounded(ranked).mapInArrow(run, schema).select(*pieces.columns, "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, length and ids of whole sequences, of packed pieces(sequence_id, offset, length, ids)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts"))
    return joined.select("sequence_id", "length", F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p.ids)), "")).alias("ids"))
