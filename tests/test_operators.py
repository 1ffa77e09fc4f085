"""Operators on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenry import schemas
from lumenry.operators import answers, chunk, dense, evaluation, exact, fusion, ingest, lexical, treatment
from lumenry.plans import audit, providers
from lumenry.plans.search import Agent, Engine
from lumenry.sources import corpus
from lumenry.streaming import state


def test_ingest(spark):
    rows = [("u1", "text one", "A v B", "Court", "SC", "civil", 1, 2), ("u1", "other", "A v B", "Court", "SC", "appeal", 1, 2), ("u2", "  ", "t", "c", "k", None, 0, 0), (None, "x", "t", "c", "k", "z", 0, 0), ("u3", "ok", "t", None, "k", None, None, None)]
    raw = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "Doc_url string, Text string, Titles string, Court_Name_Normalized string, Court_Type string, Case_Type string, Cites long, Cited_by long, n int")
    got = {r["id"]: r for r in ingest.documents(raw, "n").collect()}
    assert set(got) == {"u1", "u3"} and got["u1"]["text"] == "text one" and got["u1"]["metadata"]["case_types"] == ["appeal", "civil"] and got["u3"]["metadata"]["case_types"] == []
    p = ingest.profile(raw, "Doc_url", "Text", ("Court_Name_Normalized",)).first().asDict()
    ingest.check_accounts(p)
    assert (p["emitted"], p["duplicates"], p["excluded_missing_url"], p["excluded_empty_text"], p["missing_Court_Name_Normalized"]) == (2, 1, 1, 1, 1)
    with pytest.raises(ValueError):
        schemas.expect(raw, schemas.DOCUMENT)


def test_percentiles(spark):
    df = spark.createDataFrame([(i,) for i in range(1, 11)], "v long")
    assert tuple(ingest.percentiles(df, "v").first()) == (1, 6, 10, 10, 10)
    assert tuple(ingest.percentiles(df.limit(0), "v").first()) == (0, 0, 0, 0, 0)


def test_bm25(spark):
    docs = spark.createDataFrame([(0, "the court sat"), (1, "the court rose"), (2, "court court"), (3, "zebra court")], "id long, text string")
    q = spark.createDataFrame([(1, "zebra"), (2, "unknown"), (3, ""), (4, "court")], "query_id long, query string")
    got = lexical.bm25(docs, q, 2).collect()
    assert [(r["query_id"], r["id"]) for r in got if r["query_id"] == 1] == [(1, 3)] and {r["query_id"] for r in got} == {1, 4}
    assert lexical.bm25(docs.limit(0), q, 2).count() == 0


def test_dense(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [0.6, 0.8, 0.0])], "id long, embedding array<float>")
    q = spark.createDataFrame([(9, [1.0, 0.0, 0.0])], "query_id long, embedding array<float>")
    assert [(r["id"], round(r["score"], 6)) for r in dense.nearest(q, v, 2).orderBy("rank").collect()] == [(0, 1.0), (2, 0.6)]
    assert dense.nearest(q, v, 0).count() == 0 and [r["id"] for r in dense.nearest(q, v, 99).orderBy("rank").collect()] == [0, 2, 1]
    rng = np.random.default_rng(0)
    m = rng.normal(size=(60, 8))
    big = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], "id long, embedding array<double>")
    one, many = dense.knn_graph(big, 3).collect(), dense.nearest(big, big, 3, qid="id", skip_self=True, block_rows=7).collect()
    assert sorted((r[0], r[1]) for r in one) == sorted((r["query_id"], r["id"]) for r in many)
    assert all(r["source_id"] != r["target_id"] for r in one)


def test_fusion(spark):
    ranked = lambda ids: spark.createDataFrame([(1, i + 1, x) for i, x in enumerate(ids)], "query_id int, rank int, id string")
    got = [r["id"] for r in fusion.rrf([ranked("xyz"), ranked("yzx")], 3).orderBy("rank").collect()]
    assert got[0] == "y"
    assert fusion.rrf([ranked("a")], 5).first()["score"] == pytest.approx(1 / 61)
    with pytest.raises(ValueError):
        fusion.rrf([ranked("a")], 5, [1.0, 2.0])
    assert fusion.pool({"p": ranked("ab"), "q": ranked("bc")}).count() == 3
    hits, rest = spark.createDataFrame([(1, "b")], "query_id int, id string"), ranked("abc").withColumn("score", 1.0 / F.col("rank"))
    boost = spark.createDataFrame([("a", 0.1), ("c", 9.0)], "id string, weight double")
    out = fusion.routed(hits, rest, boost, 5).orderBy("rank").collect()
    assert [(r["rank"], r["id"], r["score_type"]) for r in out] == [(1, "b", "exact"), (2, "c", "boosted"), (3, "a", "boosted")]


def test_expand(spark):
    chunks = spark.createDataFrame([("d", 0, "a"), ("d", 1, "b"), ("d", 2, "c"), ("e", 0, "z")], "doc_id string, idx int, text string")
    hits = spark.createDataFrame([(1, 1, "d", 0), (1, 2, "d", 1), (1, 3, "e", 0)], "query_id int, rank int, doc_id string, idx int")
    assert [r["expanded"] for r in fusion.expand(hits, chunks).orderBy("rank").collect()] == ["a\n\nb", "a\n\nb\n\nc", "z"]


def test_exact(spark):
    docs = spark.createDataFrame([(0, "AIR 1974 and Section 9"), (1, "AIR 1974"), (2, "nothing")], "id long, text string")
    q = spark.createDataFrame([(1, "Section 9 in AIR 1974"), (2, "no ids"), (3, "AIR 1974")], "query_id int, query string")
    index = exact.identifier_postings(docs)
    assert sorted((r["query_id"], r["id"]) for r in exact.lookup(index, q).collect()) == [(1, 0), (3, 0), (3, 1)]
    assert [r["query"] for r in exact.exact_labels(index).collect()] == ["AIR 1974"]


def test_chunks(spark):
    numbered = "\n".join(f"{i}. Paragraph {i} says something of note here" for i in range(1, 8))
    assert len(chunk.numbered_units(numbered, 5)) == 7 and chunk.numbered_units(numbered.replace("2. P", "1985. P", 1), 5) == []
    length = lambda t: len(t) // 4 + 1
    pieces = chunk.plain_cuts("abcd" * 500, 20, length)
    assert "".join(pieces) == "abcd" * 500 and all(0 < length(p) <= 20 for p in pieces)
    meta = "struct<title:string,court:string>"
    docs = spark.createDataFrame([("d", "word " * 4000, ("A vs B", "Patna High Court")), ("e", "tiny", ("t", "c"))], f"id string, text string, metadata {meta}")
    rows = chunk.chunk_documents(docs).collect()
    assert rows and all(len(r["text"]) <= 450 and r["text"].startswith("Patna High Court | A vs B\n\n") and r["doc_id"] == "d" for r in rows)
    assert [r["idx"] for r in rows] == list(range(len(rows))) and rows[3]["id"] == "d#3"
    summaries = spark.createDataFrame([("d", "s" * 900)], "doc_id string, summary string")
    assert not any("Summary:" in r["text"] for r in chunk.chunk_documents(docs, summaries=summaries).collect())
    with pytest.raises(ValueError):
        chunk.chunk_text("text", "h" * 900, "h" * 900, chunk.Chunking())


def test_claims(spark):
    claims = lambda t: [(c.text, c.cited) for c in answers.split_claims(t)]
    assert claims("The lease had expired [1]. Rent is overdue [2].") == [("The lease had expired", [1]), (". Rent is overdue", [2])]
    assert claims("Silence may be consent [1, 3].")[0][1] == [1, 3] and claims("Yes [1].") == [("Yes .", [1])]
    assert claims("") == [] and claims("Nobody can tell from what is on file here.") == [("Nobody can tell from what is on file here.", [])]
    assert claims("See the long note of [1987] 4 SCC 12 there.")[0][1] == []
    df = spark.createDataFrame([("a", "The lease had expired [1]. Rent is overdue [9].")], "id string, text string")
    table = answers.claims_table(df)
    sources = spark.createDataFrame([("a", 1, "the lease had expired by june")], "id string, n int, text string")
    pairs = answers.to_judge(table, sources)
    checks = pairs.withColumn("verdict", F.coalesce("verdict", answers.lexical_verdict(F.col("claim"), F.col("passage"))))
    out = answers.attribution(table, checks).first().asDict()
    assert (out["claims"], out["citations"], out["missing_sources"], out["citation_precision"], out["claim_support"]) == (2, 2, 1, 1.0, 0.5)
    nothing = answers.attribution(table.limit(0), checks.limit(0)).first().asDict()
    assert nothing["claim_support"] == 0.0 and nothing["claims"] == 0


def test_prompts(spark):
    r = spark.createDataFrame([(1, "q", 1, "a" * 50), (1, "q", 2, "b" * 50), (1, "q", 3, "c")], "query_id int, query string, rank int, text string")
    assert [x["n"] for x in answers.pack_sources(r, 60, notes=False).collect()] == [1]
    assert answers.pack_sources(r, 1, notes=False).count() == 1 and answers.pack_sources(r, 600, notes=False).count() == 3
    q = spark.createDataFrame([(1, "q"), (2, "none")], "query_id int, query string")
    got = {x["query_id"]: x for x in answers.prompts(q, answers.pack_sources(r, 600)).collect()}
    assert answers.NO_SOURCES in got[2]["prompt"] and got[1]["n_sources"] == 3


def test_evaluation(spark):
    ranked = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "a")], "query_id int, rank int, id string")
    labels = spark.createDataFrame([(1, "exact", ["a"]), (2, "conceptual", ["z"]), (3, "exact", ["q"])], "query_id int, kind string, relevant array<string>")
    s = {r["kind"]: r for r in evaluation.summary(evaluation.query_results(ranked, labels, 5)).collect()}
    assert s["all"]["n"] == 3 and s["exact"]["recall"] == 0.5 and s["conceptual"]["reciprocal_rank"] == 0.0
    assert evaluation.sweep({"a": ranked, "b": ranked}, labels, 5).count() == 6
    assert evaluation.overlap(ranked, ranked, 1).agg(F.sum("shared")).first()[0] == 2
    df = spark.range(100).withColumn("g", F.col("id") % 3)
    assert [r["id"] for r in evaluation.systematic_sample(df, "id", 7).orderBy("id").collect()] == [0, 14, 28, 42, 56, 70, 84]
    assert evaluation.stratified_sample(df, "g", "id", 4).count() == 12


def test_limiter_and_cache(spark):
    e = spark.createDataFrame([(i, "k", float(t)) for i, t in enumerate([0, 1, 2, 11, 12])] + [(9, "other", 2.0)], "event_id int, user_id string, t double").withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long")))
    got = {r["id"]: r["allowed"] for r in state.replay_limiter(e, limit=2, window=10.0).collect()}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: True, 9: True}
    c = state.AnswerCache(most=2)
    v = np.array([1.0, 0.0])
    c.put("AIR 1974", "identifier", 1, v)
    assert c.get("AIR 1975", "identifier", v) is None and c.get(" air  1974", "identifier") == 1
    c.put("a question", "conceptual", 2, v)
    assert c.get("another", "conceptual", v) == 2 and c.get("x", "conceptual", np.array([0.0, 1.0])) is None and c.hit_rate == 0.5
    c.put("third", "conceptual", 3, v)
    assert c.get("AIR 1974", "identifier") is None


def test_streaming_limiter(spark, tmp_path):
    rows = spark.createDataFrame([(i, "k", float(i)) for i in range(5)], "id int, key string, t double")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = state.stream_limiter(stream, limit=2, window=100.0).writeStream.format("memory").queryName("limited").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r["id"]: r["allowed"] for r in spark.table("limited").collect()} == {0: True, 1: True, 2: False, 3: False, 4: False}


def test_index_files(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(10)], "id long, text string")
    e = providers.HashedWords(16)
    path = f"{tmp_path}/ix"
    assert not corpus.index_is_complete(spark, path)
    done = providers.embed(rows.limit(6), e).withColumnRenamed("id", "chunk_id")
    assert state.pending(rows, done).count() == 4
    corpus.write_index(providers.embed(rows, e), path, e.name, e.dim, 3)
    assert corpus.read_index(spark, path, e.name, 16).count() == 10
    with pytest.raises(ValueError):
        corpus.read_index(spark, path, "another", 16)
    (tmp_path / "q.txt").write_text("# note\n\n what is law \n")
    assert [r["query"] for r in corpus.read_queries(spark, f"{tmp_path}/q.txt").collect()] == ["what is law"]


def test_providers():
    calls = []

    def busy():
        calls.append(1)
        if len(calls) < 3:
            raise providers.Unavailable(429)
        return "ok"

    assert providers.patient(busy, sleep=lambda s: None) == "ok" and len(calls) == 3
    with pytest.raises(providers.Unavailable):
        providers.patient(lambda: (_ for _ in ()).throw(providers.Unavailable(400)), sleep=lambda s: None)
    agent = Agent({"search": lambda q: [f"found {q}"]})
    assert agent.run("x?", providers.Scripted([("found", "answer: it is x [1]")], "search: x")) == ("it is x [1]", ["found x"])


def models():
    """Models made here, so that workers get their code and need no import of this file."""

    class Cut:
        """Runs out of room unless it gets twice as much."""

        def __init__(self):
            self.max_tokens, self.last_finish_reason = 10, None

        def complete(self, system, prompt):
            whole = self.max_tokens > 10 or "short" in prompt
            self.last_finish_reason = None if whole else "length"
            return "<summary>It is so.</summary>" if whole else "<summary>It is"

    class Failing:
        def complete(self, system, prompt):
            raise providers.Unavailable(400)

    return Cut, Failing


def test_summaries(spark):
    Cut, Failing = models()
    docs = spark.createDataFrame([("a", "a short text"), ("b", "a long text"), ("c", "stored")], "id string, text string")
    stored = spark.createDataFrame([("c", "kept")], "doc_id string, summary string")
    got = {r["doc_id"]: r["summary"] for r in audit.summaries(docs, stored, Cut).collect()}
    assert got == {"a": "It is so.", "b": "It is so."}
    assert audit.summaries(docs, stored, Failing).count() == 0
    wide = {r["doc_id"]: (r["summary"], r["fresh"]) for r in audit.context_summaries(docs, stored, lambda: providers.Scripted([], " told ")).collect()}
    assert wide == {"a": ("told", True), "b": ("told", True), "c": ("kept", False)}
    assert {r["summary"] for r in audit.context_summaries(docs, stored, Failing).collect()} == {"", "kept"}


def test_judge_and_audit(spark):
    _, Failing = models()
    answered = spark.createDataFrame(
        [(1, "The lease had expired [1]. The roof was sound and new [2][7].", False, False, [1, 2]), (2, "INSUFFICIENT_CONTEXT", True, False, []), (3, "cut off in the mid", False, True, []), (4, "Nothing here is sourced at all.", False, False, [])],
        "query_id int, text string, refused boolean, truncated boolean, cited array<int>",
    )
    sources = spark.createDataFrame([(1, 1, "by june the lease had expired"), (1, 2, "the walls were damp")], "query_id int, n int, text string")
    r = audit.audit(answered, sources, audit.WordJudge).first().asDict()
    assert (r["answers"], r["refused"], r["truncated"], r["uncited_answers"]) == (4, 1, 1, 1)
    assert (r["claims"], r["uncited_claims"], r["citations"], r["missing_sources"], r["citation_precision"], r["claim_support"]) == (3, 1, 3, 1, 0.5, 0.5)
    claims = answers.claims_table(answered.select(F.col("query_id").alias("id"), "text").where("id = 1"))
    odd = audit.judge(claims, sources.select(F.col("query_id").alias("id"), "n", "text"), lambda: providers.Scripted([], "well, maybe")).collect()
    assert sorted(x["verdict"] for x in odd) == ["missing_source", "unclear", "unclear"]
    assert {x["verdict"] for x in audit.judge(claims, sources.select(F.col("query_id").alias("id"), "n", "text"), Failing).collect()} == {"missing_source", "unclear"}


def test_questions_and_grades(spark):
    chunks = spark.createDataFrame([("1", "We hold that the tender lapsed in may."), ("2", "We hold that rent is due on the first day of each month."), ("3", "The lorry left."), ("4", "We find no fault.")], "id string, text string")
    labels = spark.createDataFrame([("when is it?", ["4"], "conceptual", None)], "query string, relevant_chunk_ids array<string>, kind string, note string")
    model = lambda: providers.Scripted([("tender", '"When do offers end?"'), ("rent", "we hold that rent is due when?")], "")
    got = audit.questions(chunks, labels, model, 5).collect()
    assert [(r["query"], r["relevant_chunk_ids"], r["kind"]) for r in got] == [("When do offers end?", ["1"], "conceptual")]
    pool = spark.createDataFrame([("q", "a", "yes it is"), ("q", "b", "no"), ("p", "c", "no")], "query string, id string, text string")
    graded = audit.annotate(pool, lambda: providers.Scripted([("yes", " Y ")], "none"))
    assert {(r["id"], r["grade"]) for r in graded.collect()} == {("a", "y"), ("b", "n"), ("c", "n")}
    assert [(r["query"], r["relevant_chunk_ids"]) for r in audit.graded_labels(graded).collect()] == [("q", ["a"])]
    checked = audit.stance_validation(chunks, lambda: providers.Scripted([("lorry", "argument"), ("fault", "??")], "It is HOLDING."), 3)
    r = evaluation.agreement(checked).first().asDict()
    assert (r["judged"], r["agreed"], r["skipped"], r["declined"], r["missed"], r["missed_rate"]) == (3, 2, 1, 1, 1, 1.0)


def test_structured_answers(spark):
    rows = spark.createDataFrame([(i, f"d{i}", 0, t, "Supreme Court", 5) for i, t in enumerate(["zebra crossing case", "the appeal fails"])], "id long, doc_id string, idx int, text string, court string, cited_by long")
    e = providers.HashedWords(32)
    engine = Engine(rows, providers.embed(rows, e), e)
    q = spark.createDataFrame([(1, "zebra crossing"), (2, "the appeal")], "query_id long, query string")
    model = lambda: providers.Scripted([("Question: zebra", '{"refused": false, "claims": [{"text": "It is so", "source_ids": [1, 8, 1.5]}]}')], "no json")
    out = {r["query_id"]: r for r in engine.answer(q, model, 2, structured=True).collect()}
    assert (out[1]["text"], out[1]["cited"], out[1]["invalid"], out[1]["refused"]) == ("It is so [1, 8]", [1], [8], False) and out[2]["refused"] and out[2]["text"] == "INSUFFICIENT_CONTEXT"
    log = corpus.request_log(engine.answer(q, model, 2, structured=True), F.lit("peer"), "answer", 2)
    assert log.count() == 2 and log.columns == schemas.REQUEST_LOG.fieldNames()
    assert {r["text"] for r in engine.hydrate(engine.bm25(q, 1)).collect()} == {"zebra crossing case", "the appeal fails"}
    with pytest.raises(Exception, match="no chunk 77"):
        engine.hydrate(spark.createDataFrame([(1, 1, 77)], "query_id long, rank int, id long")).collect()
    agent = Agent.over(engine, dense.knn_graph(providers.embed(rows, e), 1), k=1)
    talk = agent.run("x?", providers.Scripted([(r"\[2\]", "answer: done [2]"), (r"\[1\]", "explore: 0")], "search: zebra crossing"))
    assert talk == ("done [2]", ["zebra crossing case", "the appeal fails"])
    scored = providers.relevance(q.join(rows.select("id", "text"), F.lit(True)), providers.WordOverlap)
    assert {(r["query_id"], r["id"]): r["relevance"] for r in scored.collect()} == {(1, 0): 1.0, (1, 1): 0.0, (2, 0): 0.0, (2, 1): 1.0}
    assert providers.chosen({"a": 1, "b": 2}) == 1 and providers.chosen({"a": 1, "b": 2}, "b") == 2
    with pytest.raises(ValueError):
        providers.chosen({"a": 1}, "z")


def test_profiles(spark):
    df = spark.createDataFrame([(0,), (0,), (10,), (30,)], "v int")
    assert tuple(evaluation.described(df, "v").first()) == (10.0, 5.0, 50.0, 30, 30)
    docs = spark.createDataFrame([("a", "Ram Lal Sah Vs. Union of India [AIR 1974 Patna 164] and (1998) 2 SCC 341"), ("b", "AIR  1974 Patna 164, 1998 (2) BLJR 341"), ("c", "none")], "id string, text string")
    assert tuple(treatment.citation_profile(docs).select("texts", "citing", "occurrences", "named", "distinct_citations").first()) == (3, 2, 3, 1, 2)
    assert treatment.most_cited(docs, 1).first()["n"] == 2 and treatment.cited_cases(docs).first()["citation"] == "AIR 1974 Patna 164"
    pooled = spark.createDataFrame([(1, "a", ["x", "y"]), (1, "b", ["x"]), (2, "a", ["y"])], "query_id int, id string, systems array<string>")
    assert tuple(evaluation.pool_overlap(pooled).first()) == (4, 3, 0.25) and {r["place"] for r in evaluation.shuffled(pooled).where("query_id = 1").collect()} == {1, 2}
    assert [r["v"] for r in evaluation.head(df, "v", 3).collect()] == [0, 0, 10]
    words = spark.createDataFrame([("one two three",), ("one",), (None,)], "text string")
    assert tuple(providers.truncated(words, "text", 2).first()) == (3, 1)


def test_sources(spark, tmp_path):
    (tmp_path / "l.json").write_text('[{"query": "q", "relevant_chunk_ids": ["a"], "kind": "exact"}, {"query": "none", "relevant_chunk_ids": [], "kind": "conceptual"}]')
    labels = corpus.read_labels(spark, f"{tmp_path}/l.json")
    assert labels.count() == 2 and evaluation.of_kind(labels).first()["query"] == "none"
    corpus.write_labels(labels, f"{tmp_path}/out")
    assert [r["query"] for r in spark.read.json(f"{tmp_path}/out").collect()] == ["q"]
    (tmp_path / "p.jsonl").write_text('{"id": "1", "text": "x"}\n{"id": "2", "text": "y"}\n')
    assert corpus.read_jsonl(spark, f"{tmp_path}/p.jsonl", "id string, text string", 2).count() == 2
    with pytest.raises(ValueError):
        corpus.read_jsonl(spark, f"{tmp_path}/p.jsonl", "id string, text string", 3)
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "key string, v int")
    corpus.append_new(rows.limit(1), f"{tmp_path}/s", "key")
    corpus.append_new(rows.union(rows), f"{tmp_path}/s", "key")
    assert sorted(r["key"] for r in spark.read.parquet(f"{tmp_path}/s").collect()) == ["a", "b"]
    corpus.write_graph(rows, spark.createDataFrame([(1, 2, 0.5)], "source_id int, target_id int, score double"), f"{tmp_path}/g")
    nodes, edges = corpus.read_graph(spark, f"{tmp_path}/g")
    assert nodes.count() == 2 and edges.first()["score"] == 0.5
    corpus.write_preferences(spark.createDataFrame([("q", "new", "old")], "query string, corrected string, original string"), f"{tmp_path}/d")
    assert spark.read.json(f"{tmp_path}/d").first().asDict() == {"prompt": "q", "chosen": "new", "rejected": "old"}
    corpus.write_scores(rows, f"{tmp_path}/c")
    assert spark.read.option("header", True).csv(f"{tmp_path}/c").count() == 2
    raw = spark.createDataFrame([("u", "t", "T", "c", "k", "x", 1, 2)], schemas.RAW)
    raw.write.parquet(f"{tmp_path}/raw")
    assert corpus.read_raw(spark, f"{tmp_path}/raw").first()["Cited_by"] == 2
    e = providers.HashedWords(8)
    texts = spark.createDataFrame([(1, "a b")], "id long, text string")
    corpus.write_index(providers.embed(texts, e), f"{tmp_path}/ix", e.name, e.dim, payloads=texts)
    assert corpus.read_payloads(spark, f"{tmp_path}/ix").first()["text"] == "a b"
    assert corpus.ensure_index(spark, f"{tmp_path}/iy", f"{tmp_path}/ix") and corpus.index_is_complete(spark, f"{tmp_path}/iy")


def test_a_stream_of_chunks_is_indexed_once(spark, tmp_path):
    e = providers.HashedWords(8)
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(6)], "id long, text string")
    rows.limit(3).write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
        q = state.stream_index(stream, lambda b: providers.embed(b, e), f"{tmp_path}/ix", f"{tmp_path}/cp")
        q.awaitTermination(120)
        rows.where("id >= 3").write.mode("append").parquet(f"{tmp_path}/in")
    assert spark.read.parquet(f"{tmp_path}/ix").count() == 6
