"""Substring dedup by paragraphs: MinHash banding, exact verification, removal by components.

Every line with words is a paragraph. Lines of under `min_words` words that follow each other, up to a blank line, are
also cut into pieces by content: before each word whose hash is the least among `reach` words to both sides, so that a
passage is cut alike wherever it stands and however it is wrapped. Longer lines are cut so too, and their pieces meet equal
ones alone: that finds what stands inside lines that differ otherwise. Paragraphs are sets of five-word shingles of
lower-cased words (of fewer words: all as one); bands are tuned so that a pair at the threshold is found with the
demanded recall; pairs that collide in a band are verified by exact Jaccard similarity, and components follow.

A line and the pieces that overlap it are one place. Of each component the first place by (doc_id, first word) stays;
what stands at its other places is removed. A component of one place has no copies.

Equal paragraphs share a 64-bit key and count as one set. Defined results: a null or empty text has no paragraphs; rows
of one doc_id (or of none) are one document, in which what stands at the same words of both is at one place; very long
texts and lines are split and compared whole; extra columns are ignored (`paragraph_dedup`) or kept
(`drop_paragraphs`), whatever their names but `__id` and `__gone`; an empty table gives an empty result; ties are broken
by (doc_id, first word), nulls first.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .common import batches, bounded, hot_keys, rows_of, salted_join, stored
from .graph import connected_components
from .hashing import Spans, mix64
from .ngram_join import fetched, link
from .shingles import count_maps, set_keys, word_hashes


@dataclass(frozen=True)
class Paragraphs:
    n: int = 5
    percent: int = 80
    min_words: int = 16
    reach: int = 8
    #: The same for pieces of longer lines, which only meet equal ones.
    long_reach: int = 6
    recall: float = 0.999
    hashes: int = 32
    seed: int = 11
    block: int = 256
    #: Repeated words side by side that are a repeated passage.
    passage: int = 30


def tune(threshold: float, recall: float, hashes: int) -> tuple[int, int]:
    """(bands, rows) of at most `hashes` hashes that find a pair at the threshold with that recall: the most rows a
    band, which has the fewest false candidates, then the fewest bands. One row a band always does."""
    for rows in range(hashes, 0, -1):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows))) if threshold < 1 else 1
        if bands * rows <= hashes or rows == 1:
            return bands, rows
    return 1, 1


def cuts(words: np.ndarray, run: np.ndarray, reach: int) -> np.ndarray:
    """Whether a piece begins at each word: at least `reach` words from both ends of its run (-1: in none), and least by hash there."""
    n = len(words)
    value = words.copy()
    value[:-1] += words[1:] * np.uint64(3)
    value = mix64(value)
    out = run >= 0
    for k in range(1, reach + 1):
        far = np.zeros(n, bool)
        far[k:] = (run[k:] == run[:-k]) & (value[k:] < value[:-k])
        out &= far
        far = np.zeros(n, bool)
        far[:-k] = (run[:-k] == run[k:]) & (value[:-k] <= value[k:])
        out &= far
    return out


def split(texts: list[str | None], rules: Paragraphs) -> dict[str, np.ndarray]:
    """Paragraphs of all texts: text (its number), no, first_word, last_word (of the text), bounds into words, and whether it is
    a piece of a longer line."""
    lines = [(t or "").split("\n") for t in texts]
    counts = np.fromiter(map(len, lines), np.int64, len(lines))
    words, at = word_hashes([x.encode() for ls in lines for x in ls]) if len(lines) else (np.zeros(0, np.uint64), np.zeros(1, np.int64))
    owner = np.repeat(np.arange(len(lines)), counts)
    size = np.diff(at)
    short = (size > 0) & (size < rules.min_words)
    begins = short.copy()
    begins[1:] &= ~short[:-1] | (owner[1:] != owner[:-1])
    run_of = np.where(short, np.cumsum(begins) - 1, -1)
    run = np.repeat(run_of, size)
    lead = np.flatnonzero(begins)
    tail = lead + np.bincount(run_of[short], minlength=len(lead))
    piece = cuts(words, run, rules.reach)
    piece[at[lead]] = True
    piece_start = np.flatnonzero(piece)
    piece_end = np.append(piece_start[1:], len(words))
    piece_end = np.minimum(piece_end, at[tail][run[piece_start]])
    has = size > 0
    long = size >= rules.min_words
    line = np.repeat(np.where(long, np.arange(len(size)), -1), size)
    inner = cuts(words, line, rules.long_reach)
    inner[at[:-1][long]] = True
    inner_start = np.flatnonzero(inner)
    inner_end = np.minimum(np.append(inner_start[1:], len(words)), at[1:][line[inner_start]])
    start, end = np.concatenate((at[:-1][has], piece_start, inner_start)), np.concatenate((at[1:][has], piece_end, inner_end))
    inside = np.arange(len(start)) >= len(start) - len(inner_start)
    # by place, the longest first; a piece that is a line counts once
    order = np.lexsort((inside, -end, start))
    start, end, inside = start[order], end[order], inside[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, inside = start[new], end[new], inside[new]
    base = at[np.concatenate(([0], np.cumsum(counts)))]
    text = np.searchsorted(base, start, side="right") - 1
    no = np.arange(len(text)) - np.searchsorted(text, text)
    return {"words": words, "text": text, "no": no, "first_word": start - base[text], "last_word": end - base[text], "start": start, "end": end, "inside": inside}


def shingled(p: dict[str, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each paragraph that is no piece of a longer line, and bounds."""
    start, end = p["start"][~p["inside"]], p["end"][~p["inside"]]
    counts = end - start
    made = np.maximum(counts - n + 1, 1)
    begin = rows_of(start, made)
    h = Spans(p["words"]).of(begin, begin + np.repeat(np.minimum(counts, n), made))
    owner = np.repeat(np.arange(len(start)), made)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.searchsorted(owner[new], np.arange(len(start) + 1))


def band_keys(h: np.ndarray, at: np.ndarray, bands: int, rows: int, seed: int) -> np.ndarray:
    """A key for each set and band: the digest of the least values of `rows` hash functions."""
    out = np.zeros((len(at) - 1, bands), np.uint64)
    if not len(h):
        return out
    factors = mix64(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64) + np.uint64(seed << 20)).reshape(-1, 2)
    for b in range(bands):
        key = np.full(len(at) - 1, np.uint64(b + 1))
        for r in range(rows):
            a, c = factors[b * rows + r]
            # multiplying mixed bits by an odd number: one of a family of hash functions
            value = h ^ c
            value *= a | np.uint64(1)
            key = mix64(key ^ np.minimum.reduceat(value, at[:-1]))
        out[:, b] = key
    return out


def paragraph_table(docs: DataFrame, rules: Paragraphs = Paragraphs()) -> DataFrame:
    """doc_id, no, first_word, last_word, inside (a piece of a longer line), pid, size, sig and band keys of each paragraph."""
    bands, rows_a_band = tune(rules.percent / 100, rules.recall, rules.hashes)

    def run(rows):
        for piece in batches(rows):
            p = split(piece["text"], rules)
            inside = p["inside"]
            h, at = shingled(p, rules.n)
            key = set_keys(h, at).view(np.int64)
            _, lead = np.unique(key, return_index=True)
            once = np.zeros(len(key), bool)
            once[lead] = True  # of copies in one batch, the first has bands
            keys = band_keys(h, at, bands, rows_a_band, rules.seed)[once].view(np.int64)
            counts = np.diff(at)
            sig = count_maps(h[np.repeat(once, counts)], np.concatenate(([0], np.cumsum(np.where(once, counts, 0)))))
            pid, size, own, first = np.zeros(len(inside), np.int64), np.zeros(len(inside), np.int32), np.full(len(inside), -1), np.zeros(len(inside), bool)
            pid[~inside], size[~inside], own[~inside], first[~inside] = key, counts, np.arange(len(key)), once
            # pieces of longer lines are told by their words in order
            pid[inside] = mix64(Spans(p["words"]).of(p["start"][inside], p["end"][inside]) ^ np.uint64(rules.seed)).view(np.int64)
            lists = lambda x, sizes: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(x.reshape(-1).view(np.int64)))
            ids = np.array(piece["doc_id"], dtype=object)[p["text"]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(p["no"].astype(np.int32)), pa.array(p["first_word"].astype(np.int32)), pa.array(p["last_word"].astype(np.int32)), pa.array(p["inside"]), pa.array(pid), pa.array(size), sig.take(pa.array(own, mask=inside)), lists(keys, first * bands)],
                names=["doc_id", "no", "first_word", "last_word", "inside", "pid", "size", "sig", "bands"],
            )

    schema = "doc_id long, no int, first_word int, last_word int, inside boolean, pid long, size int, sig binary, bands array<long>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def repeated_paragraphs(docs: DataFrame, rules: Paragraphs = Paragraphs(), table: DataFrame | None = None) -> DataFrame:
    """doc_id, no, first_word, last_word, inside, group_doc (the document that keeps the group's text), removed of all paragraphs with copies."""
    docs = bounded(docs)
    table = stored(paragraph_table(docs, rules), "paragraphs") if table is None else table
    held = table.where(F.size("bands") > 0)
    index = held.select(F.explode("bands").alias("token"), F.col("pid").alias("sid"), "size", F.lit(0).alias("place"))
    reps = held.groupBy(F.col("pid").alias("sid")).agg(F.min("doc_id").alias("doc_id"))

    def sets_in(piece: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h, at = shingled(split(piece["text"], rules), rules.n)
        return set_keys(h, at).view(np.int64), h, at

    def fetch(need: DataFrame) -> DataFrame:
        return fetched(docs, reps.join(need, "sid", "left_semi"), sets_in)

    def signatures(need: DataFrame) -> DataFrame:
        return held.select(F.col("pid").alias("sid"), "sig").join(need, "sid", "left_semi").dropDuplicates(["sid"])

    components = connected_components(link(index, fetch, signatures, rules.percent, rules.block))
    # a paragraph's set is named by its component; sets without links name themselves
    # a piece of a longer line has no links: where it stands once, it has no copies
    sets = table.groupBy("pid").agg(F.count("*").alias("n"), F.bool_and("inside").alias("inside")).where("n > 1 or not inside").drop("inside")
    named = stored(sets.join(components, sets["pid"] == components["id"], "left").select("pid", "n", F.coalesce("component", "pid").alias("component")), "named")
    several = named.groupBy("component").agg(F.sum("n").alias("all")).where(F.col("all") > 1)
    lit = stored(named.join(several.select("component"), "component", "left_semi"), "several")
    found = table.select("doc_id", "no", "first_word", "last_word", "inside", "pid")
    rows = salted_join(found, lit.select("pid", "component"), ["pid"], hot_keys(lit, ["pid"]), ["doc_id", "no"])
    # overlapping paragraphs of one document and component are one place
    order = Window.partitionBy("component", "doc_id").orderBy("first_word", "no")
    reach = F.max("last_word").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col("first_word") < reach, 0).otherwise(1)
    placed = rows.withColumn("opens", opens).withColumn("place", F.sum("opens").over(order)).select("component", "doc_id", "no", "first_word", "last_word", "inside", "place", "opens")
    placed = stored(placed, "placed")
    groups = placed.groupBy("component").agg(F.count("*").alias("n"), F.sum("opens").alias("places"), F.min(F.struct("doc_id", "place")).alias("kept")).where("places > 1")
    copies = salted_join(placed, groups.select("component", "kept"), ["component"], hot_keys(groups, ["component"]), ["doc_id", "no"])
    return copies.select("doc_id", "no", "first_word", "last_word", "inside", F.col("kept.doc_id").alias("group_doc"), (~F.struct("doc_id", "place").eqNullSafe(F.col("kept"))).alias("removed"))


def passages(ranges: Column, least: int) -> Column:
    """Maximal runs of `least` words or more that ranges, sorted by their begin, cover without a gap."""
    begin = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("from"), F.lit(-1).alias("to"))
    closed = lambda s: s["n"] + F.when(s["to"] - s["from"] >= least, 1).otherwise(0)

    def step(s: Column, x: Column) -> Column:
        apart = x["first_word"] > s["to"]
        return F.struct(F.when(apart, closed(s)).otherwise(s["n"]).alias("n"), F.when(apart, x["first_word"]).otherwise(s["from"]).alias("from"), F.greatest(s["to"], x["last_word"]).alias("to"))

    return F.aggregate(ranges, begin, step, closed)


def paragraph_dedup(docs: DataFrame, rules: Paragraphs = Paragraphs()) -> DataFrame:
    """One row a doc_id: repeated passages of `rules.passage` words or more, paragraphs with copies anywhere, those removed,
    their places, the groups' documents, paragraphs, and pieces of longer lines that are removed, which count as no paragraphs."""
    table = stored(paragraph_table(bounded(docs), rules), "paragraphs")
    rows = repeated_paragraphs(docs, rules, table)
    per_doc = rows.groupBy("doc_id").agg(
        passages(F.array_sort(F.collect_list(F.struct("first_word", "last_word"))), rules.passage).alias("n_passages"),
        F.count_if(~F.col("inside")).alias("n_repeated"),
        F.count_if(F.col("removed") & ~F.col("inside")).alias("n_removed"),
        F.count_if(F.col("removed") & F.col("inside")).alias("n_removed_pieces"),
        F.array_sort(F.collect_list(F.when(F.col("removed") & ~F.col("inside"), F.col("no")))).alias("removed"),
        F.array_sort(F.collect_set("group_doc")).alias("group_docs"),
    )
    totals = table.where("not inside").groupBy(F.col("doc_id").alias("of")).agg(F.count("*").alias("n_paragraphs"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    joined = ids.join(totals, F.col("doc_id").eqNullSafe(F.col("of")), "left").join(per_doc.withColumnRenamed("doc_id", "id"), F.col("doc_id").eqNullSafe(F.col("id")), "left")
    return joined.select(
        "doc_id", zero("n_passages"), zero("n_repeated"), zero("n_removed"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"),
        F.coalesce("group_docs", F.array().cast("array<long>")).alias("group_docs"), zero("n_paragraphs"), zero("n_removed_pieces"),
    )


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without those of its words, and without the lines that lose all their words."""
    out, at, gone = [], 0, {i for s, e in spans for i in range(s, e)}
    for line in text.split("\n"):
        found = [m.start() for m in WORD.finditer(line)]
        hit = [at + i in gone for i in range(len(found))]
        at += len(found)
        if any(hit):
            if all(hit):
                continue
            ends = [*found[1:], len(line)]
            line = line[: found[0]] + "".join(line[s:e] for s, e, h in zip(found, ends, hit, strict=True) if not h)
        out.append(line)
    return "\n".join(out)


def drop_paragraphs(docs: DataFrame, rules: Paragraphs = Paragraphs()) -> DataFrame:
    """docs with its columns, without the words of removed paragraphs; a document may be left empty."""
    gone = repeated_paragraphs(docs, rules).where("removed").groupBy(F.col("doc_id").alias("__id")).agg(F.collect_list(F.struct("first_word", "last_word")).alias("__gone"))
    names = docs.columns

    def run(rows):
        for batch in rows:
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            clean = []
            for text, spans in zip(columns["text"].to_pylist(), columns["__gone"].to_pylist(), strict=True):
                clean.append(without(text, [(s["first_word"], s["last_word"]) for s in spans]) if spans else text)
            columns["text"] = pa.array(clean, columns["text"].type)
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    return bounded(docs).join(gone, F.col("doc_id").eqNullSafe(F.col("__id")), "left").drop("__id").mapInArrow(run, docs.schema)
