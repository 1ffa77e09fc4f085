"""Searchers as plans over whole batches of queries, and what is composed of them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from ..functions import text as T
from ..functions.patterns import LEGAL, PatternSet
from ..operators import answers, dense, evaluation, exact, fusion, ivf, lexical, postings
from ..storage import stored
from . import providers

RERANK_DEPTH = 50


@dataclass(frozen=True)
class Asked:
    """Questions(query_id, query, ...) as a stored table, none of them empty, and how many they are."""

    rows: DataFrame
    n: int


Questions = DataFrame | Asked
Search = Callable[[Asked, int], DataFrame]


@dataclass
class Engine:
    """An index over chunks(id long, doc_id, idx, text, court, cited_by) and their vectors(id, embedding).

    Steps are tables of the shared folder: questions, candidates, results and replies are written once and read by
    whatever comes next, so a step's plan begins at the step before it, whose rows needn't be counted or searched again,
    and no model is asked twice. With `lexicon` and `cells`, searches read a stored postings table and stored vector cells;
    without, they read texts and vectors whole.
    """

    chunks: DataFrame
    vectors: DataFrame
    embedder: providers.Embedder = field(default_factory=providers.HashedWords)
    patterns: PatternSet = field(default_factory=lambda: LEGAL)
    lexicon: postings.Lexicon | None = None
    cells: ivf.Cells | None = None

    @classmethod
    def build(cls, chunks: DataFrame, embedder: providers.Embedder, patterns: PatternSet = LEGAL, cells: int | None = None) -> Engine:
        """An engine over stored chunks, vectors and postings, with vectors in cells if their number is given."""
        kept = stored(chunks, "chunks")
        vectors = stored(providers.embed(kept, embedder), "vectors")
        return cls(kept, vectors, embedder, patterns, postings.build(kept, patterns=patterns), ivf.build(vectors, cells) if cells else None)

    def within(self, pool: DataFrame) -> Engine:
        """An engine over the chunks of a pool(id) alone."""
        kept = pool.select("id").distinct()
        return Engine(stored(self.chunks.join(kept, "id", "left_semi"), "pool"), stored(self.vectors.join(kept, "id", "left_semi"), "pool_vectors"), self.embedder, self.patterns)

    @cached_property
    def n_vectors(self) -> int:
        return self.vectors.count()

    def once(self, queries: Questions) -> Asked:
        """queries(query_id long, query), stored; an empty one is an error. What is stored already is taken as it is."""
        if isinstance(queries, Asked):
            return queries
        rows = stored(queries, "queries")
        n, empty = rows.agg(F.count("*"), F.count_if(F.coalesce(T.strip(F.col("query")), F.lit("")) == "")).first()
        if empty:
            raise ValueError("a query is empty")
        return Asked(rows, n)

    def near(self, vectors: DataFrame, n: int, k: int) -> DataFrame:
        vectors = vectors.withColumnRenamed("id", "query_id")
        return ivf.search(self.cells, vectors, k) if self.cells else dense.nearest(vectors, self.vectors, k, n_queries=n, n_corpus=self.n_vectors)

    def dense(self, queries: Questions, k: int) -> DataFrame:
        asked = self.once(queries)
        return self.near(providers.embed(asked.rows, self.embedder, "query_id", "query", as_query=True), asked.n, k)

    def hyde(self, queries: Questions, make: Callable[[], providers.Model], k: int) -> DataFrame:
        """Dense search by a passage that a model writes for the question, embedded as a document."""
        asked = self.once(queries)
        told = stored(providers.complete(asked.rows.withColumn("prompt", F.concat(F.lit("Write a passage that answers: "), "query")), make), "passages")
        return self.near(providers.embed(told.select("query_id", F.coalesce("reply", "query").alias("query")), self.embedder, "query_id", "query"), asked.n, k)

    def bm25(self, queries: Questions, k: int) -> DataFrame:
        asked = self.once(queries)
        return postings.search(self.lexicon, asked.rows, k) if self.lexicon else lexical.bm25(self.chunks, asked.rows, k, patterns=self.patterns)

    def hybrid(self, queries: Questions, k: int, depth: int = 20, weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
        asked = self.once(queries)
        return fusion.rrf([self.dense(asked, depth), self.bm25(asked, depth)], k, weights)

    def reranked(self, queries: Questions, k: int) -> DataFrame:
        """More candidates than asked for, ordered anew by a scorer that sees question and text."""
        asked = self.once(queries)
        found = stored(self.hybrid(asked, depth := max(RERANK_DEPTH, k), depth).drop("score"), "candidates")
        scored = providers.scored_candidates(found, asked.rows, self.chunks.select("id", "text"))
        return fusion.rerank(scored, F.col("relevance"), k).select("query_id", "rank", "id", "score")

    def routed(self, queries: Questions, k: int, semantic: Search | None = None) -> DataFrame:
        """Exact hits of identifiers first; the rest is filled by another search, weighted by authority."""
        asked = self.once(queries)
        hits = exact.lookup(exact.identifier_postings(self.chunks, patterns=self.patterns), asked.rows, self.patterns)
        # as many more as exact hits could hide, which are k at most
        rest = (semantic or self.reranked)(asked, 2 * k)
        boost = self.chunks.select("id", T.authority(F.col("court"), F.col("cited_by")).alias("weight"))
        return fusion.routed(stored(hits, "hits"), rest, boost, k)

    def expanded(self, results: DataFrame, width: int = 1) -> DataFrame:
        """Results with the text of their neighbours."""
        hits = results.join(self.chunks.select("id", "doc_id", "idx", "text"), "id")
        wide = fusion.expand(hits, self.chunks.select("doc_id", "idx", "text"), width)
        return wide.withColumn("text", F.coalesce("expanded", "text")).drop("expanded", "n_pieces")

    def live(self, queries: Questions, k: int = 6) -> DataFrame:
        """Routed over reranked over hybrid, with neighbours."""
        return self.expanded(stored(self.routed(queries, k), "routed"))

    def hydrate(self, results: DataFrame) -> DataFrame:
        """Results with what is stored of their chunks; an id without a chunk is an error."""
        known = results.join(self.chunks.drop("score"), "id", "left")
        there = F.col("doc_id").isNotNull() | F.col("text").isNotNull()
        return known.withColumn("text", F.when(there, F.col("text")).otherwise(F.raise_error(F.concat(F.lit("no chunk "), F.col("id").cast("string")))))

    def asked(self, queries: Questions, k: int, search: Search | None) -> tuple[Asked, DataFrame, DataFrame]:
        """Stored questions, results with texts and packed sources."""
        asked = self.once(queries)
        found = (search or self.live)(asked, k)
        if "text" not in found.columns:
            found = found.join(self.chunks.select("id", "text"), "id")
        found = stored(found, "found")
        packed = answers.pack_sources(found.join(asked.rows.select("query_id", "query"), "query_id"), patterns=self.patterns)
        return asked, found, stored(packed, "packed")

    def sources(self, queries: Questions, k: int = 6, search: Search | None = None) -> DataFrame:
        """query_id, n, id, text of the sources that answers to queries are written from."""
        return self.asked(queries, k, search)[2].select("query_id", "n", "id", "text")

    def answer(self, queries: Questions, make: Callable[[], providers.Model], k: int = 6, search: Search | None = None, structured: bool = False) -> DataFrame:
        """query_id, query, reply, text, refused, cited, invalid, n_sources, truncated, gap: retrieve, pack, ask, read. Stored.

        A structured reply is JSON of claims with their sources' numbers; its text is built from them.
        """
        return self.answer_with_sources(queries, make, k, search, structured)[0]

    def answer_with_sources(self, queries: Questions, make: Callable[[], providers.Model], k: int = 6, search: Search | None = None, structured: bool = False) -> tuple[DataFrame, DataFrame]:
        """Answers, and the sources(query_id, n, id, text) that they were written from, of one search."""
        asked, found, packed = self.asked(queries, k, search)
        told = providers.complete(answers.prompts(asked.rows, packed, not structured), make, system=answers.STRUCTURED if structured else answers.RULES)
        read = T.structured_answer if structured else T.parsed_answer
        told = told.withColumn("a", read(F.coalesce("reply", F.lit("" if structured else T.REFUSAL)), F.col("n_sources")))
        rows = told.join(asked.rows.select("query_id", "query"), "query_id").join(fusion.score_gap(found), "query_id", "left")
        text = F.col("a.text") if structured else F.col("reply")
        rows = rows.select("query_id", "query", "reply", text.alias("text"), "a.refused", "a.cited", "a.invalid", "n_sources", "truncated", F.coalesce("gap", F.lit(0.0)).alias("gap"))
        return stored(rows, "answers"), packed.select("query_id", "n", "id", "text")

    def corrected(self, answered: DataFrame, make: Callable[[], providers.Model], k: int = 6) -> DataFrame:
        """New answers to refused questions, from what their sub-questions find; a question whose parts find nothing has none."""
        refused = stored(answered.where("refused").select("query_id", "query"), "refused")
        told = providers.complete(refused.withColumn("prompt", F.concat(F.lit("Split into simpler questions, one a line: "), "query")), make)
        subs = stored(told.select("query_id", F.posexplode(T.sub_questions(F.col("reply"))).alias("sub", "sub_query")).withColumn("sub_id", F.xxhash64("query_id", "sub")), "sub_questions")
        found = self.reranked(subs.select(F.col("sub_id").alias("query_id"), F.col("sub_query").alias("query")), k)
        back = found.withColumnRenamed("query_id", "sub_id").join(subs.select("sub_id", "query_id", "sub"), "sub_id")
        merged = stored(fusion.merge_sub_queries(back.select("query_id", "sub", "rank", "id", "score")), "merged")
        return self.answer(refused.join(merged.select("query_id").distinct(), "query_id", "left_semi"), make, k, search=lambda q, n: merged)


def embedder_trial(chunks: DataFrame, pool: DataFrame, queries: DataFrame, labels: DataFrame, embedders: dict[str, providers.Embedder], k: int = 10) -> DataFrame:
    """config, kind, n, recall, precision, reciprocal_rank of dense searches of one pool(id) of chunks(id, text), by embedder."""
    held = stored(chunks.join(pool.select("id").distinct(), "id", "left_semi"), "pool")
    asked, found = None, {}
    for name, embedder in embedders.items():
        engine = Engine(held, stored(providers.embed(held, embedder), "pool_vectors"), embedder)
        asked = asked or engine.once(queries)
        found[name] = stored(engine.dense(asked, k), "trial")
    return evaluation.sweep(found, labels, k)


@dataclass
class Agent:
    """A driver-side loop of few turns over batch operators: a model asks for tools and must answer in the end."""

    tools: dict[str, Callable[[str], list[str]]]
    turns: int = 5
    longest_note: int = 500

    @classmethod
    def over(cls, engine: Engine, edges: DataFrame | None = None, k: int = 5) -> Agent:
        """An agent that searches an engine's chunks and, with edges(source_id, target_id, score), walks from a chunk to its neighbours."""
        spark = engine.chunks.sparkSession

        def search(query: str) -> list[str]:
            asked = spark.createDataFrame([(0, query)], "query_id long, query string")
            return [r["text"] for r in engine.hydrate(engine.reranked(asked, k)).orderBy("rank").select("text").take(k)]

        def explore(id: str) -> list[str]:
            near = dense.neighbours(edges, engine.chunks.select("id", "text"), spark.createDataFrame([(int(id),)], "source_id long"), k)
            return [r["text"] for r in near.orderBy("rank").select("text").take(k)]

        return cls({"search": search} | ({"explore": explore} if edges is not None else {}))

    def run(self, question: str, model: providers.Model) -> tuple[str, list[str]]:
        """The final answer and all sources, numbered over the whole talk. Replies are `tool: argument` or `answer: text`.

        In the turn before the last, answering is all that is left; long notes are cut before each turn.
        """
        notes, sources = [f"Question: {question}"], []
        for turn in range(self.turns):
            last = turn >= self.turns - 1
            reply = model.complete("Answer now." if last else "Use a tool or answer.", "\n".join(notes))
            name, _, rest = reply.partition(":")
            name = name.strip()
            if name == "answer" or last or name not in self.tools:
                return (rest if name == "answer" else reply).strip(), sources
            notes = [n[: self.longest_note] for n in notes]
            for text in self.tools[name](rest.strip()):
                sources.append(text)
                notes.append(f"[{len(sources)}] {text}")
        return T.REFUSAL, sources
