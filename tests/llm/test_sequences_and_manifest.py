"""Best-fit packing, fill-in-the-middle and the Merkle manifest against brute force and the public library, with odd rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenry.llm import best_fit, fim, merkle, word_ids
from lumenry.llm.queries import vocabulary

LONG = " ".join(f"tok{i % 977}y{i}\n" for i in range(200_000))  # a few MB
TEXTS = [None, "", " \n", "a", "same text", "same text", "<|endoftext|> and <|startoftext|>x", "It's WE'LL o'clock--'s", "ß façade été ÀÉ µ² ½", "été Σας ΑΣ İ", "a\x1cb\xa0c\x85d e 　f", "日本語 🙂🙂 ñandú", "x" * 5000, "word " * 3000, LONG, "<P>", "one\ntwo\nthree\n", "one\r\ntwo"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, length string, row int, word string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("en", "de", None)[i % 3], "s", None if t is None else len(t), "clash", 1, "w") for i, t in enumerate(TEXTS)]
    rows += [(None, "Same Text", "en", None, 9, "clash", 1, "w")] * 3 + [(4, "same text", "de", "s", 9, "clash", 1, "w")] * 2 + [(4, "OTHER", "de", "s", 5, "clash", 1, "w"), (-7, "below zero", "de", "s", 10, None, 1, "w"), (1 << 40, "FAR", "de", "s", 3, None, 1, "w")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary("word_bpe_49k.json"))


def test_word_ids_are_the_librarys(monkeypatch):
    ours, theirs = word_ids.WordIds(vocabulary("word_bpe_49k.json")), library()
    rng = random.Random(4)
    marks = ["'s", "'S", "'", "a", "Word", "9", "--", " ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "é", "é", "́", "ß", "Σ", "İ", "²", "½", "<|endoftext|>", "<|", "|>", "</w>", "日", "🙂", "_", "\x00", " ", "ǆ"]
    texts = [*(t or "" for t in TEXTS if t != LONG), *("".join(rng.choice(marks) for _ in range(rng.randint(0, 40))) for _ in range(3000))]
    got = ours.encode([t.encode() for t in texts])
    for text, ids, want in zip(texts, got, theirs.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, repr(text)
    monkeypatch.setattr(word_ids, "SLICE", 1000)
    assert ours.encode_long(LONG[:100_000].encode()) == ours.encode([LONG[:100_000].encode()])[0]
    monkeypatch.setattr(word_ids, "REMEMBERED", 10)
    for _ in range(3):
        assert ours.encode([t.encode() for t in texts[:300]]) == got[:300]
    assert ours.encode([b"some new words", b"x" * 100, b"again x"]) == [np.array(e.ids, "<u4").tobytes() for e in theirs.encode_batch(["some new words", "x" * 100, "again x"], add_special_tokens=False)]


def fewest(items, capacity):
    """The least number of sequences, over all subsets."""
    best = [(0, capacity)] + [(99, 0)] * ((1 << len(items)) - 1)
    for held in range(1 << len(items)):
        n, last = best[held]
        for i, x in enumerate(items):
            if not held >> i & 1:
                best[held | 1 << i] = min(best[held | 1 << i], (n, last + x) if last + x <= capacity else (n + 1, x))
    return best[-1][0]


def counts_of(items, capacity):
    return np.bincount(items, minlength=capacity + 1)


def check_plan(plan, counts):
    given = np.zeros_like(counts)
    for filling, copies in plan.fillings:
        assert sum(x * c for x, c in filling) <= plan.capacity and copies > 0
        for x, c in filling:
            given[x] += c * copies
    assert (given == counts).all() and plan.bound <= plan.sequences


def test_plans_are_optimal():
    rng = random.Random(3)
    better = 0
    for _ in range(200):
        capacity = rng.choice([10, 20, 37, 100])
        items = [rng.randint(1, capacity) if rng.random() < 0.3 else rng.randint(max(1, capacity // 5), capacity // 2) for _ in range(rng.randint(1, 11))]
        counts = counts_of(items, capacity)
        plan, fit = best_fit.plan(counts), best_fit.fitted({x: n for x, n in enumerate(counts.tolist()) if n}, capacity)
        check_plan(plan, counts)
        assert plan.sequences == fewest(items, capacity)
        better += sum(n for _, n in fit) > plan.sequences
    assert better > 0


def test_search_improves_large_histograms():
    rng = np.random.default_rng(0)
    for low, high in ((600, 760), (300, 1200)):
        counts = counts_of(rng.integers(low, high, 30_000), 2048)
        plan = best_fit.plan(counts)
        check_plan(plan, counts)
        assert plan.sequences < sum(n for _, n in best_fit.fitted({x: n for x, n in enumerate(counts.tolist()) if n}, 2048))
    assert best_fit.plan(np.zeros(2049, np.int64)).sequences == 0
    assert best_fit.plan(counts_of([2048] * 5 + [1] * 3, 2048)).sequences == 6


def test_best_fit(spark, docs):
    theirs = library()
    pieces = word_ids.pieces(docs, vocabulary("word_bpe_49k.json"), 2048)
    packed = best_fit.pack(pieces.withColumn("extra", F.lit("kept")), 2048)
    rows = packed.collect()
    texts = collections.Counter((r["doc_id"], r["text"] or "") for r in docs.collect())
    want = collections.Counter()
    for (doc_id, text), n in texts.items():
        ids = [*theirs.encode(text, add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            want[doc_id, piece, at, len(ids[at : at + 2048]), np.array(ids[at : at + 2048], "<u4").tobytes()] += n
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], bytes(r["ids"])) for r in rows) == want
    held = collections.defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    counts = counts_of([r["length"] for r in rows], 2048)
    assert len(held) == best_fit.plan(counts).sequences and set(packed.columns) == {*pieces.columns, "extra", "sequence_id", "offset"}
    whole = {r["sequence_id"]: (r["length"], bytes(r["ids"])) for r in best_fit.sequences(packed).collect()}
    r = next(r for r in rows if r["offset"])
    assert len(whole) == len(held) and whole[r["sequence_id"]][1][4 * r["offset"] : 4 * (r["offset"] + r["length"])] == bytes(r["ids"]) and all(len(ids) == 4 * n for n, ids in whole.values())
    assert best_fit.pack(pieces.limit(0), 2048).count() == 0 and zlib.crc32(bytes(r["ids"])) == packed.where((F.col("sequence_id") == r["sequence_id"]) & (F.col("offset") == r["offset"])).select(F.crc32("ids")).first()[0]


def test_lengths_of_most_rows(spark):
    """A third of all pieces has one length; tasks and batches count on."""
    lengths = spark.range(30_000, numPartitions=7).select("id", F.when(F.col("id") % 3 == 0, 700).otherwise(F.col("id") % 900 + 1).alias("length"))
    rows = best_fit.pack(lengths, 2048).collect()
    assert len(rows) == len({(r["sequence_id"], r["offset"]) for r in rows}) == 30_000
    room = collections.Counter()
    for r in rows:
        room[r["sequence_id"]] += r["length"]
    plan = best_fit.plan(counts_of([r["length"] for r in rows], 2048))
    assert max(room.values()) <= 2048 and len(room) == plan.sequences <= 1.001 * plan.bound
    with pytest.raises(Exception, match="a length is not in 1 to 10"):
        best_fit.pack(lengths, 10).collect()


def fim_by_hand(doc_id, text, rate=100, spm=50):
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, z = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (lines[:a], lines[a:z], lines[z:]))
    form = "spm" if h4 % 100 < spm else "psm"
    return n, form, len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("rate", [100, 40])
def test_fill_in_middle(spark, docs, rate):
    odd = ["<S\n", "<\n<P", "<P\n>", "a\n\nb\n", "\n", "\n\n\n", "é\nß\n日本\n🙂"]
    rows = docs.select("doc_id", "text", "length").union(spark.createDataFrame([(i, t, "x") for i in range(20) for t in odd], "doc_id long, text string, length string"))
    f = fim.Fim(rate=rate)
    out = fim.transform(rows, f)
    want = collections.Counter((r["doc_id"], *fim_by_hand(r["doc_id"], r["text"] or "", rate)) for r in rows.collect())
    got = out.collect()
    assert collections.Counter((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got) == want
    assert {r["form"] for r in got} == {"plain", "spm", "psm"} and all(r["output_sha256"] == hashlib.sha256(r["output"].encode()).hexdigest() for r in got)
    back = fim.restore(out, f).collect()
    assert collections.Counter((r["doc_id"], r["restored"]) for r in back) == collections.Counter((r["doc_id"], r["text"] or "") for r in rows.collect())
    assert all(r["restored_sha256"] == hashlib.sha256(r["restored"].encode()).hexdigest() for r in back)
    assert fim.fill_in_middle(docs.limit(0), f).count() == 0
    with pytest.raises(ValueError):
        fim.transform(docs, fim.Fim(sentinels=("<P>", "<P>", "<S>")))


def test_piece_tables():
    table = fim.PieceTable([b"abcdef", b"--"]).cut([0, 2, 2, 6])
    assert [bytes(v) for v in table.views()] == [b"", b"ab", b"", b"cdef", b""]
    moved = table.arranged((3, 1), {3: 1, 1: 1})
    assert moved.joined() == b"--cdef--ab" and moved.sha256() == hashlib.sha256(b"--cdef--ab").hexdigest() and moved.cut([3, 9]).joined() == moved.joined()


def by_hand(rows):
    """Rows of the manifest, from its definition; equal ids by digest."""
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    size = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: h("".join(size(r[c]) for c in ("doc_id", "source", "lang", "n_chars")) + size(text))

    def climb(nodes):
        ways = [[] for _ in nodes]
        at = list(range(len(nodes)))
        while len(nodes) > 1:
            for i, way in enumerate(ways):
                run = nodes[at[i] // 8 * 8 : at[i] // 8 * 8 + 8]
                way.append((run[: at[i] % 8], run[at[i] % 8 + 1 :]))
                at[i] //= 8
            nodes = [h("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
        return nodes[0], ways

    groups = collections.defaultdict(list)
    for r in rows:
        groups[r["lang"]].append(r)
    subroots, ways, leaves = {}, {}, {}
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        leaves[g] = sorted((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), i) for i, r in enumerate(groups[g]))
        subroots[g], ways[g] = climb([x[2] for x in leaves[g]])
    root, tops = climb([subroots[g] for g in order])
    out = []
    for g, top in zip(order, tops, strict=True):
        for (_, _, digest, i), way in zip(leaves[g], ways[g], strict=True):
            r = groups[g][i]
            up = way + top
            tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
            text = re.sub("[A-Z]", lambda m: m[0].lower(), r["text"]) if tampered and r["text"] is not None else r["text"]
            node = leaf(r, text)
            for left, right in up:
                node = h("".join(left) + node + "".join(right))
            out.append((r["doc_id"], digest, subroots[g], root, h("".join("".join(a + b) for a, b in up)), node, node == root))
    return collections.Counter(out)


def test_manifest(spark, docs):
    got = merkle.audit(docs)
    assert collections.Counter(map(tuple, got.collect())) == by_hand(docs.collect())
    assert merkle.audit(docs.limit(0)).count() == 0


def test_manifest_of_several_blocks(spark):
    """Over 512 leaves of a group and over 512 groups, sparse and negative ids, and one id of a third of all rows."""
    rows = [(i * 37 - 5000, f"Text {i}", None if i < 700 else f"g{i}", "s", i) for i in range(1400)] + [(11, f"Copy {i % 5}", None, "s", 1) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    got = merkle.audit(df).collect()
    assert collections.Counter(map(tuple, got)) == by_hand(df.collect())
    assert 0 < sum(not r["verified"] for r in got) < len(got)
