import math
import random
from collections import Counter

import numpy as np
import pytest

from lumenry.operators import lexical


def brute_force(texts, queries, k):
    """texts: (id, words) rows; those of one id and length are one text. All of a query's scored ids, best first."""
    mean = sum(len(w) for _, w in texts) / len(texts)
    posts = {}
    for id, words in texts:
        posts.setdefault((id, len(words)), Counter()).update(words)
    df = Counter(t for p in posts.values() for t in p)
    out = {}
    for query_id, words in queries:
        scores = Counter()
        for (id, dl), p in posts.items():
            for t, qtf in Counter(words).items():
                if t in p:
                    idf = math.log(1 + (len(texts) - df[t] + 0.5) / (df[t] + 0.5))
                    scores[id] += qtf * idf * p[t] * 2.5 / (p[t] + 1.5 * (0.25 + 0.75 * dl / mean))
        out[query_id] = [(id, round(s, 6)) for id, s in sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]]
    return {q: v for q, v in out.items() if v}


def test_bm25_of_whole_texts_leaves_blocks_as_k_best(spark, monkeypatch):
    """Pairs of queries and texts that share a word are no rows of a shuffle: 40 queries and 200 texts, all with one common word."""
    draw = random.Random(3)
    texts = [(i, ["all"] + [f"w{int(draw.paretovariate(0.6)) % 300}" for _ in range(draw.randrange(0, 60))]) for i in range(180)]
    texts += [(1000 + i, texts[i][1]) for i in range(20)] + [(5, texts[5][1]), (6, ["all", "more"])]  # copies, a row again, an id again
    corpus = spark.createDataFrame([(i, " ".join(w)) for i, w in texts], "id long, text string")
    queries = [(i, w) for i, w in texts[:180:5]]
    asked = spark.createDataFrame([(i, " ".join(w)) for i, w in queries], "query_id long, query string")
    monkeypatch.setattr(lexical, "BLOCK_TEXTS", 64)
    monkeypatch.setattr(lexical, "BLOCK_QUERIES", 16)
    monkeypatch.setattr(lexical, "SLICE", 5)
    monkeypatch.setattr(lexical, "FREQUENT", 7)
    found = lexical.bm25(corpus, asked, 4)
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["id"], round(r["score"], 6)))
    assert got == brute_force(texts, queries, 4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "HashAggregate(keys=[query_id" not in plan


@pytest.mark.parametrize("frequent", [0, 3, 512])
def test_block_scores_equal_sums_over_terms(monkeypatch, frequent):
    monkeypatch.setattr(lexical, "FREQUENT", frequent)
    draw = np.random.default_rng(1)
    left, right = (draw.random((n, 40)) * (draw.random((n, 40)) < np.linspace(0.01, 0.9, 40)) for n in (9, 30))
    flat = lambda m: (np.nonzero(m)[1], np.nonzero(m)[0], m[np.nonzero(m)])
    for i, scores in lexical.weighed(flat(left), 9, flat(right), 30):
        assert np.allclose(scores, right @ left[i])
        assert list(lexical.best_of_block(scores, np.arange(30), 5)) == sorted(np.flatnonzero(scores), key=lambda j: (-round(scores[j], 9), j))[:5]


def test_exact_graph_keeps_ties_by_id_over_slices_and_blocks(spark, monkeypatch):
    from lumenry.operators import dense

    draw = np.random.default_rng(4)
    v = np.round(draw.normal(size=(90, 4)), 1)
    v[30:60] = v[3]  # copies: many equal scores
    df = spark.createDataFrame([(int(i), x.tolist()) for i, x in enumerate(v)], "id long, embedding array<double>")
    monkeypatch.setattr(dense, "SLICE", 7)
    got = dense.nearest(df, df, 5, qid="id", skip_self=True, block_rows=40)
    s = np.round(v @ v.T, 12)
    want = {(i, n + 1, j) for i in range(90) for n, j in enumerate(sorted((j for j in range(90) if j != i), key=lambda j: (-round(s[i, j], 9), j))[:5])}
    assert {(r["query_id"], r["rank"], r["id"]) for r in got.collect()} == want


def test_descent_of_vectors_without_neighbourhoods(spark):
    """Evenly spread vectors of 64 numbers: lists of random beginnings found 0.86 of the edges of 10,256 such ones."""
    from lumenry.operators import dense, descent

    v = np.random.default_rng(5).normal(size=(3000, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<float>").repartition(4).cache()
    edges = lambda g: {(r["source_id"], r["target_id"]) for r in g.collect()}
    exact = edges(dense.knn_graph(df))
    assert len(edges(descent.knn_graph(df, group=512, rounds=2)) & exact) >= 0.9 * len(exact)


def test_source_lines_are_numbered_without_a_task_a_query(spark):
    from lumenry.operators import answers

    rows = spark.createDataFrame([(q, 7 * i, i, "c", f"text {i}") for q in ("a", None) for i in range(50)], "query_id string, rank long, id long, court string, text string")
    warned = spark.createDataFrame([(3, "beware")], "id long, warning string")
    lines = answers.source_lines(rows, warned)
    got = {(r["query_id"], r["id"]): (r["n"], r["line"]) for r in lines.collect()}
    assert len(got) == 100 and all(n == id + 1 and line.startswith(f"[{n}] (") and ("CAUTION: beware" in line) == (id == 3) for (_, id), (n, line) in got.items())
    assert "windowspecdefinition(query_id" not in lines._jdf.queryExecution().optimizedPlan().toString()


def test_chunks_are_made_of_some_texts_at_a_time():
    import pyarrow as pa

    from lumenry.operators import chunk

    texts = ["a" * 300, None, "b" * 2000, "", "c" * 100, "d" * 100]
    parts = list(chunk.some_texts(pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string()), "n": list(range(6))}), 1000))
    assert [p.column("n").to_pylist() for p in parts] == [[0, 1], [2], [3, 4, 5]]
    assert list(chunk.some_texts(pa.RecordBatch.from_pydict({"text": pa.array([], pa.string())}))) == []


def test_stored_search_of_many_long_queries_scores_blocks(spark, monkeypatch):
    """Queries by blocks by terms are no rows of a shuffle."""
    from lumenry.operators import postings

    draw = random.Random(6)
    texts = [(i, " ".join(f"w{int(draw.paretovariate(0.6)) % 200}" for _ in range(draw.randrange(0, 50)))) for i in range(150)] + [(500 + i, "w1 w2 w2") for i in range(9)]
    corpus = spark.createDataFrame(texts, "id long, text string").repartition(3)
    asked = spark.createDataFrame([*texts[::10], (-1, "unheard"), (-2, "")], "query_id long, query string")
    index = postings.build(corpus, buckets=4, block_texts=16)
    rows = lambda df: sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 6)) for r in df.collect())
    want = rows(postings.search(index, asked, 4))
    monkeypatch.setattr(postings, "BOUNDED", 10)
    monkeypatch.setattr(postings, "kept_blocks", None)
    monkeypatch.setattr(lexical, "BLOCK_TEXTS", 50)
    assert rows(postings.search(index, asked, 4)) == want


def kept_plans(monkeypatch):
    """What is stored as best rows from now on."""
    held, stored = [], lexical.stored

    def keep(df, name):
        out = stored(df, name)
        if name == "best":
            held.append((df._jdf.queryExecution().executedPlan().toString(), out.count()))
        return out

    monkeypatch.setattr(lexical, "stored", keep)
    return held


def test_bm25_shuffles_neither_texts_nor_terms_of_queries(spark, monkeypatch):
    """Lists of texts were shuffled once for each block of queries, those of queries once for each block of texts."""
    draw = random.Random(8)
    texts = [(f"{i:03}", ["all"] + [f"w{int(draw.paretovariate(0.6)) % 300}" for _ in range(draw.randrange(0, 40))]) for i in range(120)]
    texts += [(f"a{99 - i}", ["same", "words", "all"]) for i in range(60)]  # equal scores, the least ids last
    corpus = spark.createDataFrame([(i, " ".join(w)) for i, w in texts], "id string, text string").coalesce(1)
    queries = [(f"q{i}", w) for i, w in texts[::5]]
    asked = spark.createDataFrame([(i, " ".join(w)) for i, w in queries], "query_id string, query string")
    for name, value in (("ROW_TEXTS", 8), ("BLOCK_TEXTS", 20), ("BLOCK_QUERIES", 10), ("SLICE", 3)):
        monkeypatch.setattr(lexical, name, value)
    held = kept_plans(monkeypatch)
    found = lexical.bm25(corpus, asked, 3)
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["id"], round(r["score"], 6)))
    assert got == brute_force(texts, queries, 3)
    assert len(held) == 4 and all("Exchange" not in plan for plan, _ in held)
    tasks = max(lexical.TASKS, 2 * spark.sparkContext.defaultParallelism)
    assert sum(n for _, n in held) <= 3 * len(queries) * tasks
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "terms" not in plan and "places" not in plan


def test_bm25_of_repeated_and_missing_ids(spark, monkeypatch):
    """Texts of one id add up wherever they stand; one of none is a result like others."""
    texts = [(i % 7 if i % 11 else None, "red " * (1 + i % 3) + "w" * (1 + i % 5) + " blue" * (i % 4 == 1)) for i in range(60)]
    corpus = spark.createDataFrame(texts, "id long, text string").repartition(5)
    asked = spark.createDataFrame([(1, "red blue"), (2, "www w"), (None, "blue")], "query_id long, query string")
    monkeypatch.setattr(lexical, "ROW_TEXTS", 4)
    monkeypatch.setattr(lexical, "BLOCK_TEXTS", 6)
    key = lambda i: -1 if i is None else i
    want = brute_force([(key(i), t.split()) for i, t in texts], [(1, ["red", "blue"]), (2, ["www", "w"]), (-1, ["blue"])], 3)
    got = {}
    for r in sorted(lexical.bm25(corpus, asked, 3).collect(), key=lambda r: (key(r["query_id"]), r["rank"])):
        got.setdefault(key(r["query_id"]), []).append((key(r["id"]), round(r["score"], 6)))
    assert got == want


def test_stored_search_of_many_queries_reads_blocks_where_they_lie(spark, monkeypatch):
    """Postings of the index were shuffled to their terms, then once more for each block of queries."""
    from lumenry.operators import postings

    draw = random.Random(9)
    texts = [(i, [f"w{int(draw.paretovariate(0.6)) % 200}" for _ in range(draw.randrange(0, 50))]) for i in range(90)] + [(700 - i, ["w1", "w2", "w2"]) for i in range(40)]
    corpus = spark.createDataFrame([(i, " ".join(w)) for i, w in texts], "id long, text string").repartition(2)
    queries = [(i, w) for i, w in texts[::7]]
    asked = spark.createDataFrame([(i, " ".join(w)) for i, w in queries], "query_id long, query string")
    index = postings.load(spark, postings.build(corpus, buckets=4, block_texts=16).path)
    for module, name, value in ((postings, "BOUNDED", 10), (postings, "SENT", 5), (lexical, "BLOCK_TEXTS", 40), (lexical, "BLOCK_QUERIES", 10)):
        monkeypatch.setattr(module, name, value)
    held = kept_plans(monkeypatch)
    found = postings.search(index, asked, 4)
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["id"], round(r["score"], 6)))
    assert got == brute_force(texts, queries, 4)
    assert len(held) == 2 and all("Exchange" not in plan for plan, _ in held)
    assert "places" not in found._jdf.queryExecution().executedPlan().toString()


def test_index_is_laid_out_by_a_row_a_block_and_bucket(spark, monkeypatch):
    """Each term of each block was a row of the shuffle."""
    from lumenry.operators import postings

    draw = random.Random(10)
    texts = [(i, " ".join(f"w{int(draw.paretovariate(0.6)) % 200}" for _ in range(draw.randrange(0, 50)))) for i in range(100)] + [(200, None)]
    corpus = spark.createDataFrame(texts, "id long, text string").coalesce(1)
    monkeypatch.setattr(postings, "FILE_TEXTS", 40)
    index = postings.build(corpus, buckets=4, block_texts=16)
    packed = postings._blocks(index.whole, index.mean_length, 4, index.k1, index.b)
    assert packed.count() <= index.blocks * 5 < index.table.count()
    flat = lambda df: {(r["term"], r["id"]): r["tf"] for r in df.collect()}
    assert flat(postings.flat(index)) == flat(lexical.postings(lexical.tokens_table(corpus)))
    own = postings.texts(index).collect()
    assert {r["id"]: r["dl"] for r in own} == {i: len((t or "").split()) for i, t in texts} and len(own) == 101
