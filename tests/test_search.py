"""Searches in stored steps, the stored lexical index, vector cells and the graph by descent, against plain searches."""

import collections
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenry.functions import text as T
from lumenry.operators import dense, descent, evaluation, ivf, lexical, places, postings
from lumenry.plans import providers
from lumenry.plans.search import Engine, embedder_trial

TEXTS = ["Section 9 bars the suit.", "the appeal fails on limitation", "costs follow the event", "notice was served in time", "Section 9 again with AIR 1974", "zebra crossing case"]
QUERIES = "query_id long, query string"


@pytest.fixture(scope="module", params=["plain", "stored"])
def engine(spark, request):
    rows = spark.createDataFrame([(i, f"d{i // 3}", i % 3, t, "Supreme Court", 5) for i, t in enumerate(TEXTS)], "id long, doc_id string, idx int, text string, court string, cited_by long")
    e = providers.HashedWords(32)
    return Engine(rows, providers.embed(rows, e), e) if request.param == "plain" else Engine.build(rows, e, cells=2)


@pytest.fixture(scope="module")
def q(spark):
    return spark.createDataFrame([(1, "Section 9"), (2, "zebra crossing")], QUERIES)


def test_routed(engine, q):
    routed = engine.routed(q, 3).orderBy("query_id", "rank").collect()
    assert [r["id"] for r in routed if r["query_id"] == 1][:2] == [0, 4] and routed[3]["id"] == 5


def test_answers(engine, q):
    told, sources = engine.answer_with_sources(q, providers.Extractive, 2)
    out = {r["query_id"]: r for r in told.collect()}
    assert out[1]["cited"] == [1] and not out[1]["refused"]
    assert {(r["query_id"], r["n"], r["id"]) for r in sources.collect()} >= {(1, 1, 0), (2, 1, 5)}


def plan_size(df):
    return len(df._jdf.queryExecution().optimizedPlan().toString().splitlines())


def test_corrected(engine, q):
    """Answers to refused questions from their parts; a plan begins at the stored step before it, however many came before."""
    refused = engine.answer(q, lambda: providers.Scripted([]), 2)
    assert refused.where("refused").count() == 2
    model = lambda: providers.Scripted([("Split", "1. zebra\n2. crossing"), ("Sources", "It is so [1].")])
    again = engine.corrected(refused, model, 2)
    rows = again.collect()
    assert sorted(r["query_id"] for r in rows) == [1, 2] and not any(r["refused"] for r in rows)
    assert plan_size(again) == plan_size(refused) == 1
    assert engine.corrected(again, model, 2).count() == 0


def test_nothing_found_stays_unanswered(engine, q):
    refused = engine.answer(q.where("query_id = 1"), lambda: providers.Scripted([]), 2)
    assert engine.corrected(refused, lambda: providers.Scripted([], "-\n* "), 2).count() == 0  # no part is left to ask


def test_hyde(engine, q):
    """A passage instead of the question is looked for; without a reply, the question."""
    found = engine.hyde(q, lambda: providers.Scripted([("crossing", "costs follow the event")], "zebra crossing case"), 1)
    assert {r["query_id"]: r["id"] for r in found.collect()} == {1: 5, 2: 2}


@pytest.mark.parametrize("search", ["dense", "bm25", "hybrid", "reranked", "routed", "live"])
def test_empty_queries_are_errors(spark, engine, search):
    for text in (" \n", None):
        with pytest.raises(ValueError, match="a query is empty"):
            getattr(engine, search)(spark.createDataFrame([(1, "good"), (2, text)], QUERIES), 1)


def test_a_pool_and_two_embedders(spark, engine):
    """Searches of a pool find nothing else, and embedders are held against each other on it."""
    pool = spark.createDataFrame([(1,), (2,), (5,), (5,)], "id long")
    asked = spark.createDataFrame([(1, "Section 9 bars the suit."), (2, "zebra crossing")], QUERIES)
    assert {r["id"] for r in engine.within(pool).dense(asked, 9).collect()} == {1, 2, 5}
    labels = spark.createDataFrame([(1, "exact", [1]), (2, "exact", [5])], "query_id long, kind string, relevant array<long>")
    kinds = {"one": providers.HashedWords(1), "many": providers.HashedWords(512)}
    got = {(r["config"], r["kind"]): (r["n"], r["recall"], r["reciprocal_rank"]) for r in embedder_trial(engine.chunks, pool, asked, labels, kinds, 1).collect()}
    texts = {i: TEXTS[i] for i in (1, 2, 5)}
    want = {}
    for name, e in kinds.items():
        hits = []
        for query, relevant in (("Section 9 bars the suit.", 1), ("zebra crossing", 5)):
            scores = {i: round(float(np.float32(e.queries([query])[0]) @ np.float32(e.documents([t])[0])), 9) for i, t in texts.items()}
            hits.append(min(scores, key=lambda i: (-scores[i], i)) == relevant)
        want[name] = sum(hits) / 2
    assert {c: got[c, "all"][1] for c in kinds} == want and got["many", "exact"][0] == 2


def test_changed_rankings(spark):
    rank = lambda *rows: spark.createDataFrame(rows, "query_id long, rank int, id long, score double")
    before = rank((1, 1, 7, 0.5), (1, 2, 8, 0.4), (2, 1, 7, 0.1))
    assert evaluation.changed(before, rank((1, 1, 7, 0.5000000001), (1, 2, 8, 0.4), (2, 1, 7, 0.1))).count() == 0
    got = evaluation.changed(before, rank((1, 1, 8, 0.5), (1, 2, 8, 0.3), (1, 3, 9, 0.2))).collect()
    assert {(r["query_id"], r["rank"]) for r in got} == {(1, 1), (1, 2), (1, 3), (2, 1)}


def test_ids_of_chunks(spark):
    df = spark.createDataFrame([("a#b#12",), ("doc",), ("doc#x",), ("#3",), ("a\n#4",), (None,)], "id string")
    assert [tuple(r["p"]) for r in df.select(T.chunk_place(F.col("id")).alias("p")).collect()] == [("a#b", 12), ("doc", None), ("doc#x", None), ("", 3), ("a\n", 4), (None, None)]


def words(rng, n):
    return " ".join(f"w{int(x)}" for x in np.minimum(rng.zipf(1.3, n), 400))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(1)
    rows = [(i, words(rng, int(rng.integers(1, 60)))) for i in range(700)]
    rows += [(700 + i, "same words w1 w2") for i in range(300)] + [(1000, None), (1001, ""), (1002, "AIR 1974 and No. 7 of 1980"), (-5, "rare w399")]
    return spark.createDataFrame(rows, "id long, text string").repartition(3)


@pytest.mark.parametrize(("block", "k"), [(16, 3), (256, 10), (10_000, 2000)])
def test_stored_postings_find_what_a_search_of_all_texts_finds(spark, corpus, block, k):
    index = postings.build(corpus, buckets=8, block_texts=block)
    rng = np.random.default_rng(2)
    asked = spark.createDataFrame([(i, words(rng, 5)) for i in range(12)] + [(20, "same w2 w2"), (21, "unheard"), (22, ""), (23, "AIR 1974")], QUERIES)
    rows = lambda df: sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 9)) for r in df.collect())
    assert rows(postings.search(index, asked, k)) == rows(lexical.bm25(corpus, asked, k))
    assert rows(postings.search(postings.load(spark, index.path), asked, k, probe=1)) == rows(lexical.bm25(corpus, asked, k))
    kept, every = postings.kept_blocks(index, postings._terms(index, asked), k).select("query_id", "block").distinct().count(), index.blocks * 14
    assert kept < every if block == 16 else kept <= every


def test_a_search_reads_the_buckets_of_its_terms(spark, corpus):
    index = postings.build(corpus, buckets=64)
    asked = spark.createDataFrame([(1, "w3 w399")], QUERIES)
    buckets = {r[0] for r in postings._terms(index, asked).select("bucket").collect()}
    plan = postings.search(index, asked, 5)._jdf.queryExecution().executedPlan().toString()
    assert 0 < len(buckets) <= 2 and re.search(r"PartitionFilters: \[[^]]*bucket", plan)
    flat = {(r["term"], r["id"]): r["tf"] for r in postings.flat(index).collect()}
    want = {(r["term"], r["id"]): r["tf"] for r in lexical.postings(lexical.tokens_table(corpus)).collect()}
    assert flat == want and postings.search(postings.build(corpus.limit(0)), asked, 5).count() == 0


@pytest.fixture(scope="module")
def clustered(spark):
    """Clusters, a third of all rows one vector, zeros, and rows without a vector."""
    rng = np.random.default_rng(0)
    middles = rng.normal(size=(20, 16))
    v = np.concatenate([middles[rng.integers(0, 20, 700)] + 0.3 * rng.normal(size=(700, 16)), np.tile(middles[:1], (350, 1)), np.zeros((3, 16))])
    v[:1050] /= np.linalg.norm(v[:1050], axis=1, keepdims=True)
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(5000, None)], "id long, embedding array<float>").repartition(4)


def results(df):
    return sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 8)) for r in df.collect())


@pytest.mark.parametrize("part", [50, 4096])
def test_cells_find_what_a_search_of_all_vectors_finds(spark, clustered, part):
    cells = ivf.build(clustered, 12, part_rows=part)
    whole = clustered.where("embedding is not null")
    asked = whole.where("id % 50 = 0 or id >= 1050").withColumnRenamed("id", "query_id")
    assert cells.table.count() == 1053 and cells.about.agg(F.sum("n")).first()[0] == 1053
    for k, probes in ((5, 1), (2000, None)):
        assert results(ivf.search(cells, asked, k, probes)) == results(dense.nearest(asked, whole, k))
    assert ivf.search(cells, asked.limit(0), 5).count() == 0 and ivf.search(ivf.build(clustered.limit(0)), asked, 5).count() == 0


def test_probed_cells_hold_nine_in_ten(spark, clustered):
    cells = ivf.build(clustered, 12)
    whole = clustered.where("embedding is not null")
    asked = whole.where("id % 10 = 0").withColumnRenamed("id", "query_id")
    found = ivf.search(cells, asked, 10, exact=False)
    best = collections.defaultdict(list)
    for r in dense.nearest(asked, whole, 10).collect():
        best[r["query_id"]].append(r["score"])
    hits = sum(r["score"] >= min(best[r["query_id"]]) - 1e-9 for r in found.collect())
    assert cells.probes < 12 and hits >= 0.9 * sum(map(len, best.values()))
    plan = ivf._scored(cells, asked, found.select(F.lit(0).cast("long").alias("query_id"), F.lit(3).alias("cell"), F.lit(1).alias("parts")), 1)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*cell", plan)


def edge_recall(graph, exact):
    best = collections.defaultdict(list)
    for r in exact.collect():
        best[r["source_id"]].append(r["score"])
    held = collections.Counter(r["source_id"] for r in graph.collect() if r["score"] >= min(best[r["source_id"]]) - 1e-9)
    return sum(min(held[i], len(b)) for i, b in best.items()) / sum(map(len, best.values()))


def test_graph_by_descent(spark, clustered):
    whole = clustered.where("embedding is not null")
    graph = descent.knn_graph(clustered, 5)
    rows = graph.collect()
    assert edge_recall(graph, dense.knn_graph(whole, 5)) >= 0.9
    assert all(r["source_id"] != r["target_id"] for r in rows) and len({(r["source_id"], r["target_id"]) for r in rows}) == len(rows) == 5 * 1053
    assert descent.knn_graph(clustered.limit(0)).count() == 0 and descent.knn_graph(whole.limit(1)).count() == 0


def test_graph_of_vectors_without_clusters(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(600, 48))
    df = spark.createDataFrame([(i, [float(x) for x in r / np.linalg.norm(r)]) for i, r in enumerate(v)], "id long, embedding array<double>")
    assert edge_recall(descent.knn_graph(df), dense.knn_graph(df)) >= 0.9


def test_systematic_sample_of_wide_rows(spark):
    """Over 100,000 rows with more columns than the order, whose exchanges used to differ; ties; repeated rows; no rows."""
    df = spark.range(150_000, numPartitions=7).select(F.xxhash64("id").alias("key"), "id", F.sha2(F.col("id").cast("string"), 256).alias("wide"), F.lit("x" * 20).alias("place"))
    keys = sorted(r[0] for r in df.select("key").collect())
    got = evaluation.systematic_sample(df, "key", 37)
    assert sorted(r["key"] for r in got.collect()) == keys[:: 150_000 // 37][:37] and got.columns == df.columns
    ties = spark.range(1000).select((F.col("id") % 7).alias("key"), F.lit("same").alias("v"))
    want = sorted(i % 7 for i in range(1000))[:: 1000 // 10][:10]
    assert sorted(r["key"] for r in evaluation.systematic_sample(ties, "key", 10).collect()) == want
    assert evaluation.systematic_sample(ties.limit(0), "key", 3).count() == 0
    none = spark.createDataFrame([(None, 1), (None, 2), (3, 3)], "key long, v int")
    assert {r["v"] for r in evaluation.systematic_sample(none, "key", 3).collect()} == {1, 2, 3}


def test_places(spark):
    rows, n = places.numbered(spark.range(5000, numPartitions=5).withColumn("k", F.xxhash64("id")), "k")
    got = sorted((r["place"], r["k"]) for r in rows.collect())
    assert n == 5000 and [p for p, _ in got] == list(range(5000)) and [k for _, k in got] == sorted(k for _, k in got)


def test_index_is_not_shuffled_for_few_terms(spark):
    """rows of the index met the queries' terms by a shuffle of the whole index."""
    rows = spark.createDataFrame([(i, f"w{i % 3} x{i} common") for i in range(12)], "id long, text string")
    index = postings.build(rows, block_texts=4)
    terms = spark.createDataFrame([("common",), ("w1",)], "term string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few, many = (postings._of_terms(index.table, terms, n) for n in (2, postings.SENT + 1))
        plans = [x._jdf.queryExecution().executedPlan().toString() for x in (few, many)]
        assert "BroadcastHashJoin" in plans[0] and "SortMergeJoin" in plans[1]
        assert 0 < few.count() == many.count() == index.table.where("term in ('common', 'w1')").count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_word_digests_are_taken_once(monkeypatch):
    """each word of each text was digested anew."""
    calls, md5 = [], providers.hashlib.md5
    monkeypatch.setattr(providers.hashlib, "md5", lambda x: calls.append(x) or md5(x))
    embedder = providers.HashedWords(8)
    found = embedder.documents(["a b a", "", "b b c"])
    assert len(calls) == 3
    want = np.zeros((3, 8))
    for i, words in enumerate(("aba", "", "bbc")):
        for w in words:
            d = md5(w.encode()).digest()
            want[i, int.from_bytes(d[:4], "big") % 8] += 1 if d[4] & 1 else -1
    assert np.allclose(found, want / np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9))
    monkeypatch.setattr(providers.Places, "MOST", 2)
    assert np.allclose(providers.HashedWords(8).documents(["a b a", "", "b b c"]), found)
