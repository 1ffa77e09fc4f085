"""Suffix-array dedup: removes each byte covered by a string of `length` bytes that begins at two places or more.

1. Each window of `length` bytes is assigned to its least k-gram by hash (the leftmost of equals), its anchor. Equal
   windows have equal anchors at equal places, so windows whose anchor's hash is found once in the corpus are unique.
   Consecutive windows of one anchor make a slice; anchors are about 2 in length - k + 2 bytes.
2. Slices whose anchor is shared are classed by their bytes' digest. All windows of a class of two or more are
   repeated. Of anchors with several classes, one slice a class goes to a shard by the anchor's hash.
3. Each shard builds its suffix array by Larsson-Sadakane refinement and common prefixes by Kasai; windows with a
   common prefix of `length` or more with a neighbour are repeated.
4. An anchor with very many classes is dealt over several shards. Those send digests of their windows, one a distinct
   window, as sorted runs, one for each of as many buckets, in which they are merged across shards by binary search.
5. Spans come back to their texts, whose remaining bytes are hashed.

Equal texts share a key, the digest of their bytes, and one list of spans. Anchors, slices and texts that hold more
than their share of all rows are dealt over several tasks. Texts of any length are worked through in segments that
overlap by a window. Defined results: a null or empty text has no bytes and nothing to remove; repeated rows repeat
each other's windows, so all of a repeated text of `length` bytes goes from every row; there are no ties, as every
place of a repeated string goes; extra columns are ignored (`substring_dedup`) or kept (`remove_repeats`), whatever
their names but `__key`, `__salt`, `__parts` and `__spans`; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import batches, bounded, hot_keys, salted_join, stored
from .hashing import Rolling, Spans, chained, joined
from .suffixes import merged, minima, repeated_windows

#: Lower bits of a window's order that hold the position within a segment; the upper ones hold the hash.
PLACE_BITS = np.uint64(24)
#: Windows of a text that are worked on at once.
SEGMENT = 1 << 21


#: A window of a shard: 128 bits of its bytes, its text among the run's, its place there, and whether it is known to be repeated.
RUN = np.dtype([("left", "<u8"), ("right", "<u8"), ("slice", "<i4"), ("at", "<i4"), ("known", "?")])


@dataclass(frozen=True)
class Repeats:
    length: int = 200
    k: int = 40
    shard_bytes: int = 750_000
    shard_classes: int = 2048


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def anchors(raw: list[bytes], rules: Repeats) -> tuple[np.ndarray, ...]:
    """(text, start, end, anchor, digest) of each slice; start and end are bytes within the text."""
    held, size, made = [], 0, []
    # a slice that a segment's end cuts is two slices of its anchor, which finds the same repeated windows
    parts = ((i, at, r[at : at + SEGMENT + rules.length - 1]) for i, r in enumerate(raw) for at in range(0, max(len(r) - rules.length + 1, 1), SEGMENT))
    for part in parts:
        if held and size + len(part[2]) > SEGMENT + rules.length:
            made.append(_anchors(held, rules))
            held, size = [], 0
        held.append(part)
        size += len(part[2])
    if held:
        made.append(_anchors(held, rules))
    return tuple(np.concatenate([m[i] for m in made]) if made else np.zeros(0, np.int64) for i in range(5))


def _anchors(parts: list[tuple[int, int, bytes]], rules: Repeats) -> tuple[np.ndarray, ...]:
    sizes = np.fromiter((len(p[2]) for p in parts), np.int64, len(parts))
    data = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
    first = np.concatenate(([0], np.cumsum(sizes)))
    length, k = rules.length, rules.k
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none
    width = 1 << (k.bit_length() - 1)
    runs = Spans(data).runs(width)
    grams = runs if width == k else joined(runs[: len(runs) - k + width], runs[k - width :])
    low = (np.uint64(1) << PLACE_BITS) - np.uint64(1)
    best = (minima((grams & ~low) | np.arange(len(grams), dtype=np.uint64), length - k + 1) & low).astype(np.int64)
    part = np.repeat(np.arange(len(parts)), sizes)
    begin = np.flatnonzero(part[: len(best)] == part[length - 1 :])
    if not len(begin):
        return none, none, none, none, none
    best, part = best[begin], part[begin]
    head = np.flatnonzero(np.concatenate(([True], (best[1:] != best[:-1]) | (part[1:] != part[:-1]))))
    last = np.append(head[1:], len(begin)) - 1
    start, end, owner = begin[head], begin[last] + length, part[head]
    digest = chained(runs, width, start, end).view(np.int64)
    text, base = np.array([p[0] for p in parts]), np.array([p[1] for p in parts])
    moved = base[owner] - first[owner]
    return text[owner], start + moved, end + moved, grams[best[head]].view(np.int64), digest


def _bytes_of(texts: list) -> list[bytes]:
    return [(t or "").encode() for t in texts]


def _pieces(rows):
    return batches(rows, lambda t: 4 * len(t))


def anchor_table(docs: DataFrame, rules: Repeats, whole: bool) -> DataFrame:
    """One row a slice: its anchor, and if whole also key, digest, start and end."""

    def run(rows):
        for piece in _pieces(rows):
            raw = _bytes_of(piece["text"])
            owner, start, end, anchor, digest = anchors(raw, rules)
            if not whole:
                yield pa.RecordBatch.from_arrays([pa.array(anchor)], names=["anchor"])
                continue
            keys = pa.array([hashlib.md5(r).digest() for r in raw], pa.binary())
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(owner)), pa.array(anchor), pa.array(digest), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], names=["key", "anchor", "digest", "start", "end"])

    schema = "key binary, anchor long, digest long, start int, end int" if whole else "anchor long"
    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def repeated_spans(docs: DataFrame, rules: Repeats = Repeats(), hot_texts: DataFrame | None = None) -> DataFrame:
    """key (of a text), start and end of spans whose union is what is repeated, each once."""
    length, docs = rules.length, bounded(docs)
    hot_texts = hot_keys(_copies(docs), ["key"]) if hot_texts is None else hot_texts
    shared = stored(anchor_table(docs, rules, False).groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "anchors")
    found = anchor_table(docs, rules, True)
    members = stored(salted_join(found, shared.select("anchor"), ["anchor"], hot_keys(shared, ["anchor"]), ["key", "start"]), "members")
    one = F.min(F.struct("key", "start", "end")).alias("rep")
    classes = stored(members.groupBy("anchor", "digest").agg(F.count("*").alias("n"), one), "classes")
    many = classes.where("n > 1").select("anchor", "digest", "n")
    alike = salted_join(members, many.select("anchor", "digest"), ["anchor", "digest"], hot_keys(many, ["anchor", "digest"]), ["key", "start"]).select("key", "start", "end")

    mixed = classes.groupBy("anchor").agg(F.count("*").alias("classes"), F.sum(F.col("rep.end") - F.col("rep.start")).alias("size"), F.min("n").alias("least")).where("classes > 1 and least = 1").drop("least")
    mixed = stored(mixed, "mixed")
    total = mixed.agg(F.sum("size")).first()[0] or 0
    if not total:
        return alike.distinct()
    shards = max(1, -(-total // rules.shard_bytes))
    asked = salted_join(classes, mixed, ["anchor"], hot_keys(mixed, ["anchor"], "classes"), ["digest"]).select(
        F.col("rep.key").alias("key"),
        F.struct("anchor", F.col("rep.start").alias("start"), F.col("rep.end").alias("end"), (F.col("n") > 1).alias("many"), "classes", "digest").alias("s"),
    )
    slices = _with_bytes(docs, asked, hot_texts)
    hot = F.col("classes") > rules.shard_classes
    dealt = slices.withColumn("hot", hot).withColumn("shard", F.when(hot, F.xxhash64("anchor")).otherwise(F.pmod(F.xxhash64("anchor"), F.lit(shards))))
    dealt = dealt.withColumn("part", F.when(hot, F.pmod(F.xxhash64("digest"), F.ceil(F.col("classes") / rules.shard_classes))).otherwise(F.lit(0).cast("long")))

    def in_shard(key, t):
        base, many = t["start"].to_numpy().astype(np.int64), t["many"].to_numpy(zero_copy_only=False)
        raw = t["bytes"].to_pylist()
        data, bounds = np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw])))
        again = repeated_windows(data, bounds, length)
        owner = np.repeat(np.arange(len(base)), np.diff(bounds))
        at = np.flatnonzero(again & ~many[owner])
        # spans of each slice by itself: windows end within their slices
        step = owner[at] * (length + 1)
        first, last = merged(at + step, at + length + step)
        own = np.searchsorted(bounds + np.arange(len(bounds)) * (length + 1), first, "right") - 1
        moved = base[own] - bounds[own] - own * (length + 1)
        ints = lambda x: pa.array(x.astype(np.int32), pa.int32())
        keys, none = t["key"].combine_chunks(), pa.nulls(len(own))
        spans = pa.table({"key": keys.take(pa.array(own)), "start": ints(first + moved), "end": ints(last + moved), "anchor": none.cast(pa.int64()), "bucket": none.cast(pa.int64()), "run": none.cast(pa.binary())})
        if not t["hot"][0].as_py():
            return spans
        inside = np.flatnonzero(np.arange(len(data)) + length <= np.repeat(bounds[1:], np.diff(bounds)))
        left = Spans(data).windows(length)[inside]
        _, lead = np.unique(left, return_index=True)
        inside, left = inside[lead], left[lead]
        runs = np.zeros(len(inside), RUN)
        runs["left"], runs["right"] = left, Rolling(data).of(inside, inside + length)
        runs["slice"], runs["at"], runs["known"] = owner[inside], inside - bounds[owner[inside]] + base[owner[inside]], again[inside] | many[owner[inside]]
        # windows of one hash meet in one bucket of their anchor; each goes there in one sorted run a shard
        buckets = -(-t["classes"][0].as_py() // rules.shard_classes)
        bucket = (left % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((left, bucket))
        runs, bucket = runs[order], bucket[order]
        cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
        sent, listed = [], []
        for i, j in zip(cut, [*cut[1:], len(runs)], strict=False):
            part = runs[i:j].copy()
            held, part["slice"] = np.unique(part["slice"], return_inverse=True)
            sent.append(part.tobytes())
            listed.append(b"".join(keys.take(pa.array(held)).to_pylist()))
        n = len(sent)
        return pa.concat_tables([spans, pa.table({"key": pa.array(listed, pa.binary()), "start": pa.nulls(n, pa.int32()), "end": pa.nulls(n, pa.int32()), "anchor": pa.array([t["anchor"][0].as_py()] * n, pa.int64()), "bucket": pa.array(bucket[cut], pa.int64()), "run": pa.array(sent, pa.binary())})])

    done = stored(dealt.groupBy("shard", "part").applyInArrow(in_shard, "key binary, start int, end int, anchor long, bucket long, run binary"), "shards")
    spans = alike.union(done.where("run is null").select("key", "start", "end"))

    def across(key, t):
        """Windows of one shard that stand in another one too; a bucket holds as many windows as a shard."""
        runs = [np.frombuffer(x, RUN) for x in t["run"].to_pylist()]
        every = np.concatenate(runs)
        whole = np.sort(every[["left", "right"]])
        own = np.repeat(np.arange(len(runs)), [len(x) for x in runs])
        todo = np.flatnonzero(~every["known"])
        asked = every[todo][["left", "right"]]
        todo = todo[np.searchsorted(whole, asked, "right") - np.searchsorted(whole, asked, "left") > 1]
        keys = t["key"].to_pylist()
        found = [keys[o][16 * i : 16 * i + 16] for o, i in zip(own[todo].tolist(), every["slice"][todo].tolist(), strict=True)]
        start = every["at"][todo].astype(np.int32)
        return pa.table({"key": pa.array(found, pa.binary()), "start": pa.array(start), "end": pa.array(start + np.int32(length))})

    sent = done.where("run is not null").select("anchor", "bucket", "key", "run")
    return spans.union(sent.groupBy("anchor", "bucket").applyInArrow(across, "key binary, start int, end int")).distinct()


def _copies(docs: DataFrame) -> DataFrame:
    """key and n of each text."""
    return docs.groupBy(text_key(F.col("text").cast("string")).alias("key")).agg(F.count("*").alias("n"))


def _with_bytes(docs: DataFrame, asked: DataFrame, hot_texts: DataFrame) -> DataFrame:
    """asked(key, s) with the bytes of s.start to s.end of the text of that key."""
    wanted = asked.groupBy("key").agg(F.collect_list("s").alias("list"))
    texts = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).where(F.length("text") > 0).withColumn("key", text_key(F.col("text")))
    schema = "key binary, anchor long, start int, bytes binary, many boolean, classes long, digest long"

    def run(rows):
        for piece in _pieces(rows):
            out = {n: [] for n in ("key", "anchor", "start", "bytes", "many", "classes", "digest")}
            seen = set()
            for text, key, listed in zip(piece["text"], piece["key"], piece["list"], strict=True):
                if key in seen:
                    continue
                seen.add(key)
                raw = text.encode()
                for s in listed:
                    for n in ("anchor", "start", "many", "classes", "digest"):
                        out[n].append(s[n])
                    out["key"].append(key)
                    out["bytes"].append(raw[s["start"] : s["end"]])
            kinds = (pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.bool_(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))

    # copies of a text that were read in different tasks give a slice each: one of them stays
    return salted_join(texts, wanted, ["key"], hot_texts, ["doc_id"]).select("key", "text", "list").mapInArrow(run, schema).dropDuplicates(["anchor", "digest"])


def _cut(raw: bytes, start: np.ndarray, end: np.ndarray) -> tuple[bytes, int, int]:
    """Remaining bytes, bytes removed, maximal removed runs."""
    if not len(start):
        return raw, 0, 0
    start, end = merged(start, end)
    kept, at = [], 0
    for a, b in zip(start.tolist(), end.tolist(), strict=True):
        kept.append(raw[at:a])
        at = b
    return b"".join([*kept, raw[at:]]), int((end - start).sum()), len(start)


def _lists(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Starts and ends of each row's spans, without an object a span."""
    at, flat = column.offsets.to_numpy(), column.values
    start, end = flat.field("start").to_numpy().astype(np.int64), flat.field("end").to_numpy().astype(np.int64)
    return [(start[a:b], end[a:b]) for a, b in zip(at, at[1:], strict=False)]


def _with_spans(docs: DataFrame, rules: Repeats) -> DataFrame:
    """docs with __spans, the spans of each row's text."""
    docs = bounded(docs)
    hot_texts = hot_keys(_copies(docs), ["key"])
    spans = repeated_spans(docs, rules, hot_texts).groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("__spans"))
    keyed = docs.withColumn("__key", text_key(F.col("text").cast("string")))
    rows = salted_join(keyed, spans.withColumnRenamed("key", "__key"), ["__key"], hot_texts.withColumnRenamed("key", "__key"), ["doc_id"], "left")
    return rows.drop("__key")


def substring_dedup(docs: DataFrame, rules: Repeats = Repeats()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for each row of docs(doc_id, text)."""

    def run(rows):
        for batch in rows:
            out = []
            for text, (start, end) in zip(batch.column("text"), _lists(batch.column("__spans")), strict=True):
                raw = (text.as_py() or "").encode()
                kept, removed, runs = _cut(raw, start, end)
                out.append((len(raw), removed, runs, hashlib.sha256(kept).hexdigest()))
            columns = [pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    base = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    return _with_spans(base, rules).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, rules: Repeats = Repeats()) -> DataFrame:
    """docs with its columns and without repeated bytes; characters of which a part goes, go; n_chars follows."""
    from pyspark.sql.types import StructType

    schema, names = docs.schema, docs.columns

    def run(rows):
        for batch in rows:
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            texts, spans = columns["text"].to_pylist(), _lists(columns["__spans"])
            clean = [t if not len(a) else _cut(t.encode(), a, b)[0].decode("utf-8", "ignore") for t, (a, b) in zip(texts, spans, strict=True)]
            columns["text"] = pa.array(clean, columns["text"].type)
            if "n_chars" in names:
                counts = [n if a is b else len(b) for n, a, b in zip(columns["n_chars"].to_pylist(), texts, clean, strict=True)]
                columns["n_chars"] = pa.array(counts, columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    return _with_spans(docs, rules).mapInArrow(run, StructType(schema.fields))
