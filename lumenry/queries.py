"""The query catalogue over the driver's tables: each query as a plan, beside SQL that says the same to another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from .functions import markup, text as T, vectors as V
from .functions.patterns import PLAIN, STANCES
from .operators import answers, chunk, containment, dense, descent, evaluation, exact, fusion, ingest, ivf, lexical, treatment
from .operators import postings as lexicon
from .plans import audit, providers
from .plans.search import Engine, embedder_trial as embedder_trial_of
from .sources import corpus
from .storage import stored
from .streaming import state

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def docs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").withColumn("id", F.col("doc_id"))


def asked(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark passages as queries."""
    return read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def asked_docs(spark: SparkSession, d: str) -> DataFrame:
    """Every hundredth document, whole, as a query."""
    return docs(spark, d).where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))


def asked_identifiers(spark: SparkSession, d: str) -> DataFrame:
    """The identifiers of each document that has some, as a query; documents of the same ones are one query, named by the
    least of them, below zero."""
    held = docs(spark, d).select("doc_id", F.array_join(T.identifiers(F.col("text"), PLAIN), " ").alias("query")).where("query <> ''")
    return held.groupBy("query").agg((-1 - F.min("doc_id")).alias("query_id")).select("query_id", "query")


def asked_both(spark: SparkSession, d: str) -> DataFrame:
    return asked_identifiers(spark, d).union(asked_docs(spark, d))


def asked_vectors(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


# SQL that several queries share.
TOKENS = "list_concat(list_transform(regexp_extract_all({0}, '[0-9]{{3}}-[0-9]{{4}}'), lambda x: replace(x, ' ', '_')), regexp_extract_all(lower({0}), '[a-z0-9]+'))"
IDS = "list_sort(list_distinct(list_concat(regexp_extract_all({0}, '[0-9]{{3}}-[0-9]{{4}}'), regexp_extract_all({0}, '[0-9]{{1,3}}[.][0-9]{{1,3}}[.][0-9]{{1,3}}[.][0-9]{{1,3}}'), regexp_extract_all({0}, '[0-9]{{16}}'))))"
STANCE = "case when regexp_matches({0}, '(?i)(?:thand|thest|oner)') and regexp_matches({0}, '(?i)(?:tiona|edent|erly)') then 'both' when regexp_matches({0}, '(?i)(?:thand|thest|oner)') then 'argument' when regexp_matches({0}, '(?i)(?:tiona|edent|erly)') then 'holding' else 'neither' end"
NOTE = " ".join(f"when '{k}' then '{note}'" for k, (_, note) in STANCES.items())
NOTE = f"case {{0}} {NOTE} end"


def bm25_sql(queries: str, k: int) -> str:
    return f"""
qs as ({queries}),
tok as (select doc_id as id, {TOKENS.format("text")} as tokens from documents),
stats as (select count(*) as n, avg(len(tokens)) as avgdl from tok),
qt as (select query_id, term, count(*) as qtf from (select query_id, unnest({TOKENS.format("query")}) as term from qs) group by 1, 2),
post as (select term, id, dl, count(*) as tf from (select id, len(tokens) as dl, unnest(tokens) as term from tok) where term in (select term from qt) group by 1, 2, 3),
df as (select term, count(*) as df from post group by 1),
scored as (select query_id, id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as score
  from post join df using (term) join qt using (term), stats group by 1, 2),
bm25 as (select query_id, cast(row_number() over (partition by query_id order by round(score, 9) desc, id) as int) as rank, id, score from scored qualify rank <= {k})"""


BENCH_Q = "select item_id as query_id, text as query from benchmark"
DOCS_Q = "select doc_id as query_id, text as query from documents where doc_id % 100 = 0"
IDS_Q = f"select -1 - min(doc_id) as query_id, query from (select doc_id, array_to_string({IDS.format('text')}, ' ') as query from documents) where query <> '' group by query"
BOTH_Q = f"{IDS_Q} union all {DOCS_Q}"
COS = "list_dot_product(cast(a.embedding as double[]), cast(b.embedding as double[]))"


def dense_sql(k: int) -> str:
    return f"""
sims as (select a.vec_id as query_id, b.vec_id as id, {COS} as score from embeddings a, embeddings b where a.vec_id % 100 = 0),
dense as (select query_id, cast(row_number() over (partition by query_id order by round(score, 9) desc, id) as int) as rank, id, score from sims qualify rank <= {k})"""


# Ingest.


@query("""
with f as (select text as k, coalesce(text, '') = '' as u, trim(coalesce(text, ''), ' \n\t\r\f\v') = '' as e, coalesce(lang, '') = '' as ml, coalesce(source, '') = '' as ms from documents),
g as (select k, count(*) n, sum((not u and not e)::int) good, sum(u::int) u, sum((e and not u)::int) e, sum(ml::int) ml, sum(ms::int) ms from f group by k)
select cast(sum(n) as bigint) source_rows, cast(sum((good > 0)::int) as bigint) emitted, cast(sum(greatest(good - 1, 0)) as bigint) duplicates, cast(sum(u) as bigint) excluded_missing_url, cast(sum(e) as bigint) excluded_empty_text,
 cast(sum(ml) as bigint) missing_lang, cast(sum(ms) as bigint) missing_source from g""")
def doc_profile(spark, d):
    return ingest.profile(read(spark, d, "documents"), "text", "text", ("lang", "source"))


@query("""
with o as (select n_chars v, row_number() over (order by n_chars) - 1 as i, count(*) over () as n from documents)
select cast(min(v) as bigint) as min, max(v) filter (where i = least(floor(n * 0.5), n - 1)) as p50, max(v) filter (where i = least(floor(n * 0.9), n - 1)) as p90, max(v) filter (where i = least(floor(n * 0.99), n - 1)) as p99, max(v) as max from o""")
def length_percentiles(spark, d):
    return ingest.percentiles(read(spark, d, "documents"), "n_chars")


@query("select min(doc_id) as doc_id, arg_min(lang, doc_id) as lang from documents group by text")
def dedup_keep_first(spark, d):
    return ingest.keep_first(read(spark, d, "documents"), "text", "doc_id").select("doc_id", "lang")


@query("select md5(text) as digest, min(doc_id) as first_id, count(*) as n from documents group by text having count(*) > 1")
def dup_groups(spark, d):
    return read(spark, d, "documents").groupBy(F.md5("text").alias("digest")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")


@query("select lang, array_to_string(list_sort(list_distinct(list(source))), ',') as labels from documents group by lang")
def labels_by_key(spark, d):
    return ingest.labels_by_key(read(spark, d, "documents"), "lang", "source").select("lang", F.array_join("labels", ",").alias("labels"))


@query(r"""
select page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<span[^>]*>.*?</span>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[ \t]+', ' ', 'g'), ' *\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) as digest from pages""")
def normalize_text(spark, d):
    return read(spark, d, "pages").select("page_id", F.md5(T.normalize_markup(F.col("html"))).alias("digest"))


@query(r"""
select page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) as digest from pages""")
def page_text(spark, d):
    return read(spark, d, "pages").select("page_id", F.md5(corpus.page_text(F.col("html"))).alias("digest"))


LINK = '<a href="([^"]*)">([^<]*)</a>'


@query(rf"""
with l as (select page_id, unnest(range(len(ls))) as n, unnest(ls) as l from (select page_id, regexp_extract_all(html, '{LINK}') as ls from pages))
select page_id, cast(n as int) as n, regexp_extract(l, '{LINK}', 1) as value, trim(regexp_replace(replace(replace(replace(replace(regexp_extract(l, '{LINK}', 2), '&quot;', chr(34)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g')) as text from l""")
def page_links(spark, d):
    """Addresses and texts of all links, from the tags of pages."""
    return markup.elements(read(spark, d, "pages"), "a")


@query(r"""select page_id, 0 as n, trim(regexp_replace(replace(regexp_extract(html, '<div class="ad">([^<]*)</div>', 1), '&amp;', '&'), '\s+', ' ', 'g')) as text from pages where regexp_matches(html, '<div class="ad">[^<]*</div>')""")
def page_ads(spark, d):
    """Texts of the elements of one class."""
    return markup.elements(read(spark, d, "pages"), "div", "ad").select("page_id", "n", "text")


# Lexical.


@query(f"select lang, count(*) as n, cast(sum(len(tk)) as bigint) as tokens, max(len(tk)) as longest from (select lang, {TOKENS.format('text')} as tk from documents) group by lang")
def token_stats(spark, d):
    rows = docs(spark, d).select("lang", F.size(T.tokenize(F.col("text"), PLAIN)).cast("long").alias("dl"))
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum("dl").alias("tokens"), F.max("dl").alias("longest"))


@query(f"with t as (select doc_id, unnest({TOKENS.format('text')}) as term from documents), p as (select term, doc_id, count(*) as tf from t group by 1, 2), n as (select count(*) as n from documents) "
       "select term, count(*) as df, cast(sum(tf) as bigint) as cf, round(ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)), 6) as idf from p, n group by term")
def df_idf(spark, d):
    rows = docs(spark, d)
    posted = lexical.postings(lexical.tokens_table(rows, patterns=PLAIN))
    n = F.lit(rows.count())
    df = F.count("*")
    return posted.groupBy("term").agg(df.alias("df"), F.sum("tf").alias("cf"), F.round(F.log(1 + (n - df + 0.5) / (df + 0.5)), 6).alias("idf"))


@query(f"with t as (select doc_id as id, unnest({TOKENS.format('text')}) as term from documents) select term, id, count(*) as tf from t group by 1, 2")
def postings(spark, d):
    return lexical.postings(lexical.tokens_table(docs(spark, d), patterns=PLAIN)).select("term", "id", "tf")


@query(f"with {bm25_sql(BENCH_Q, 10)} select query_id, rank, id, round(score, 6) as score from bm25")
def bm25_multiquery(spark, d):
    return lexical.bm25(docs(spark, d), asked(spark, d), 10, patterns=PLAIN).withColumn("score", F.round("score", 6))


@query(f"with {bm25_sql(BENCH_Q, 10)} select query_id, rank, id, round(score, 6) as score from bm25")
def bm25_stored(spark, d):
    """From a stored index, of which only the buckets of the queries' terms and the blocks that can matter are read."""
    found = lexicon.search(lexicon.build(docs(spark, d), patterns=PLAIN), asked(spark, d), 10)
    return found.withColumn("score", F.round("score", 6))


@query(f"with {bm25_sql(DOCS_Q, 10)} select query_id, rank, id, round(score, 6) as score from bm25")
def bm25_stored_documents(spark, d):
    """Every hundredth document, whole, asked of a stored index."""
    found = lexicon.search(lexicon.build(docs(spark, d), patterns=PLAIN), asked_docs(spark, d), 10)
    return found.withColumn("score", F.round("score", 6))


# Exact.


@query(f"select unnest({IDS.format('text')}) as identifier, doc_id as id from documents")
def identifier_index(spark, d):
    return exact.identifier_postings(docs(spark, d), patterns=PLAIN)


@query(f"select doc_id, case when len({IDS.format('text')}) > 0 then 'identifier' else 'conceptual' end as kind from documents")
def query_classify(spark, d):
    return docs(spark, d).select("doc_id", T.query_kind(F.col("text"), PLAIN).alias("kind"))


EXACT_SQL = f"""
eq as ({BOTH_Q}), ex as (select doc_id as id, unnest({IDS.format('text')}) as identifier from documents),
et as (select query_id, len({IDS.format('query')}) as n, unnest({IDS.format('query')}) as identifier from eq),
exact as (select query_id, id from ex join et using (identifier) group by query_id, n, id having count(*) = n)"""


@query(f"with {EXACT_SQL} select query_id, id from exact")
def exact_lookup_intersect(spark, d):
    return exact.lookup(exact.identifier_postings(docs(spark, d), patterns=PLAIN), asked_both(spark, d), PLAIN)


@query(f"select identifier as query, array_to_string(list_sort(list(distinct id)), ',') as relevant from (select unnest({IDS.format('text')}) as identifier, doc_id as id from documents) group by identifier having count(distinct id) between 2 and 12")
def exact_labels(spark, d):
    found = exact.exact_labels(exact.identifier_postings(docs(spark, d), patterns=PLAIN))
    return found.select("query", F.array_join(F.transform("relevant", lambda x: x.cast("string")), ",").alias("relevant"))


# Dense.


@query(f"with {dense_sql(10)} select query_id, rank, id, round(score, 6) as score from dense")
def dense_topk(spark, d):
    return dense.nearest(asked_vectors(spark, d), vectors(spark, d), 10).withColumn("score", F.round("score", 6))


@query(f"with {dense_sql(10)} select query_id, rank, id, round(score, 6) as score from dense")
def ivf_topk(spark, d):
    """From stored cells, exact: those that can still hold one of the nearest are read beside the probed ones."""
    found = ivf.search(ivf.build(vectors(spark, d)), asked_vectors(spark, d), 10)
    return found.withColumn("score", F.round("score", 6))


def _recall(found: DataFrame, exact: DataFrame, query: str, k: int) -> DataFrame:
    """One row: queries, results that exact search has, and whether nine in ten of them, by score, were found as well."""
    least = exact.groupBy(query).agg(F.round(F.min("score"), 9).alias("least"), F.count("*").alias("n"))
    good = least.join(found, query, "left").groupBy(query).agg(F.max("n").alias("n"), F.count_if(F.round("score", 9) >= F.col("least")).alias("held"))
    share = F.sum(F.least("held", "n")).cast("double") / F.sum("n")
    return good.agg(F.count("*").alias("queries"), F.sum("n").alias("results"), (share >= 0.9).alias("recalled"))


@query("select count(*) filter (where vec_id % 100 = 0) as queries, cast(count(*) filter (where vec_id % 100 = 0) * least(10, count(*)) as bigint) as results, true as recalled from embeddings")
def ivf_recall(spark, d):
    """Ten nearest of the probed cells alone, held against exact search."""
    asked = asked_vectors(spark, d)
    return _recall(ivf.search(ivf.build(vectors(spark, d)), asked, 10, exact=False), dense.nearest(asked, vectors(spark, d), 10), "query_id", 10)


KNN_SQL = f"""
sims as (select a.vec_id as source_id, b.vec_id as target_id, {COS} as score from embeddings a, embeddings b where a.vec_id <> b.vec_id),
knn as (select source_id, target_id, score from sims qualify row_number() over (partition by source_id order by round(score, 9) desc, target_id) <= 5)"""


@query(f"with {KNN_SQL} select source_id, target_id, round(score, 6) as score from knn")
def knn_graph(spark, d):
    return dense.knn_graph(vectors(spark, d)).withColumn("score", F.round("score", 6))


@query("select count(*) filter (where vec_id % 100 = 0) as queries, cast(count(*) filter (where vec_id % 100 = 0) * least(5, count(*) - 1) as bigint) as results, true as recalled from embeddings")
def descent_recall(spark, d):
    """The graph of all vectors by neighbours of neighbours; every hundredth vector's edges held against exact search."""
    v = vectors(spark, d)
    graph = descent.knn_graph(v).withColumnRenamed("source_id", "query_id").where("query_id % 100 = 0")
    exact = dense.nearest(asked_vectors(spark, d), v, 6).where("query_id <> id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return _recall(graph, exact.withColumn("n", rank).where("n <= 5").drop("n"), "query_id", 5)


@query()
def descent_graph(spark, d):
    """Every vector's five neighbours, by neighbours of neighbours."""
    return descent.knn_graph(vectors(spark, d)).withColumn("score", F.round("score", 6))


@query(f"with {KNN_SQL} select source_id as query_id, cast(row_number() over (partition by source_id order by round(score, 9) desc, target_id) as int) as rank, target_id as id, e.label, round(score, 6) as score from knn join embeddings e on e.vec_id = target_id where source_id % 100 = 0 qualify rank <= 3")
def graph_neighbors(spark, d):
    v = vectors(spark, d)
    sources = asked_vectors(spark, d).select(F.col("query_id").alias("source_id"))
    return dense.neighbours(dense.knn_graph(v), v.select("id", "label"), sources, 3).select("query_id", "rank", "id", "label", F.round("score", 6).alias("score"))


@query(f"select a.vec_id as id, round({COS}, 6) as self from (select vec_id, embedding from embeddings) a join embeddings b using (vec_id)")
def cosine_pairs(spark, d):
    v = read(spark, d, "embeddings")
    return v.select(F.col("vec_id").alias("id"), F.round(V.dot(F.col("embedding"), F.col("embedding")), 6).alias("self"))


# Fusion and routing. Documents and vectors are paired by id.


def _hybrid(spark, d, weights, k=10):
    lists = [dense.nearest(asked_vectors(spark, d), vectors(spark, d), 20), lexical.bm25(docs(spark, d), asked_docs(spark, d), 20, patterns=PLAIN)]
    return fusion.rrf(lists, k, weights).withColumn("score", F.round("score", 6))


def rrf_sql(w1: float, w2: float) -> str:
    return f"""with {dense_sql(20)}, {bm25_sql(DOCS_Q, 20)},
u as (select query_id, id, rank, 0 as no, cast({w1} as double) as w from dense union all select query_id, id, rank, 1, cast({w2} as double) from bm25),
f as (select query_id, id, sum(w / (60 + rank)) as score, min(no * 1000 + rank) as first from u group by 1, 2)
select query_id, cast(row_number() over (partition by query_id order by round(score, 9) desc, first, id) as int) as rank, id, round(score, 6) as score from f qualify rank <= 10"""


@query(rrf_sql(1, 1))
def rrf_fusion(spark, d):
    return _hybrid(spark, d, (1.0, 1.0))


@query(rrf_sql(1, 3))
def rrf_weighted(spark, d):
    return _hybrid(spark, d, (1.0, 3.0))


SOURCE_WEIGHTS = (("src1", 0.9), ("src0", 1.0), ("src2", 0.8))
AUTHORITY_SQL = "case when contains(lower(source), 'src1') then 0.9 when contains(lower(source), 'src0') then 1.0 when contains(lower(source), 'src2') then 0.8 else 0.7 end + least(ln(1 + n_chars % 10) / ln(1001), 0.3)"


@query(f"select doc_id, round({AUTHORITY_SQL}, 6) as weight from documents")
def authority_boost(spark, d):
    return docs(spark, d).select("doc_id", F.round(T.authority(F.col("source"), F.col("n_chars") % 10, SOURCE_WEIGHTS), 6).alias("weight"))


@query(f"""with {EXACT_SQL}, {bm25_sql(BOTH_Q, 20)},
b as (select doc_id as id, {AUTHORITY_SQL} as weight from documents),
r as (select query_id, id, 0 as c, cast(1.0 as double) as score, 'exact' as score_type from exact union all
  select query_id, id, 1, score * weight, 'boosted' from bm25 join b using (id) where (query_id, id) not in (select (query_id, id) from exact))
select query_id, cast(row_number() over (partition by query_id order by c, round(score, 9) desc, id) as int) as rank, id, round(score, 6) as score, score_type from r qualify rank <= 10""")
def routed_search(spark, d):
    rows, q = docs(spark, d), asked_both(spark, d)
    hits = exact.lookup(exact.identifier_postings(rows, patterns=PLAIN), q, PLAIN)
    boost = rows.select("id", T.authority(F.col("source"), F.col("n_chars") % 10, SOURCE_WEIGHTS).alias("weight"))
    return fusion.routed(hits, lexical.bm25(rows, q, 20, patterns=PLAIN), boost, 10).withColumn("score", F.round("score", 6))


@query("""
with h as (select conv_id, turn from conversations)
select h.conv_id as doc_id, h.turn as idx, md5(string_agg(c.text, chr(10) || chr(10) order by c.turn, c.text)) as digest, count(*) as n_pieces from h join conversations c on c.conv_id = h.conv_id and c.turn between h.turn - 1 and h.turn + 1 group by 1, 2""")
def parent_expand(spark, d):
    c = read(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("idx"), "text")
    hits = c.select(F.lit(0).alias("query_id"), F.lit(1).alias("rank"), "doc_id", "idx")
    return fusion.expand(hits, c).select("doc_id", "idx", F.md5("expanded").alias("digest"), "n_pieces")


@query(f"with {bm25_sql(BENCH_Q, 10)} select query_id, round(max(score) - median(score), 6) as gap from bm25 group by query_id")
def score_gap(spark, d):
    return fusion.score_gap(lexical.bm25(docs(spark, d), asked(spark, d), 10, patterns=PLAIN)).withColumn("gap", F.round("gap", 6))


@query(f"""with {bm25_sql(BENCH_Q, 50)},
c as (select query_id, rank as former, id, list_distinct(regexp_extract_all(lower(query), '[a-z0-9]+')) as qw, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) as dw, regexp_extract_all(lower(query), '[a-z0-9]+') as qa, regexp_extract_all(lower(text), '[a-z0-9]+') as da
 from bm25 join documents on doc_id = id join qs using (query_id)),
g as (select query_id, former, id, qw, dw, list_distinct(list_transform(range(1, len(qa)), lambda i: qa[i] || ' ' || qa[i + 1])) as qg, list_distinct(list_transform(range(1, len(da)), lambda i: da[i] || ' ' || da[i + 1])) as dg from c),
s as (select query_id, former, id, coalesce(len(list_intersect(qw, dw)) / nullif(len(qw), 0)::double, 0) + 0.5 * coalesce(len(list_intersect(qg, dg)) / nullif(len(qg), 0)::double, 0) as score from g)
select query_id, cast(row_number() over (partition by query_id order by round(score, 9) desc, former, id) as int) as rank, id, round(score, 6) as score from s qualify rank <= 10""")
def reranked(spark, d):
    rows, q = docs(spark, d), asked(spark, d)
    found = providers.scored_candidates(stored(lexical.bm25(rows, q, 50, patterns=PLAIN).drop("score"), "candidates"), q, rows)
    return fusion.rerank(found, F.col("relevance"), 10).select("query_id", "rank", "id", F.round("score", 6).alias("score"))


# Stance and treatment.


@query(f"select doc_id, {STANCE.format('text')} as stance from documents")
def stance_labels(spark, d):
    return docs(spark, d).select("doc_id", T.stance(F.col("text"), PLAIN).alias("stance"))


@query(f"with s as (select lang, {STANCE.format('text')} as label from documents) select lang, label, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (partition by lang), 6) as percent from s group by 1, 2")
def stance_distribution(spark, d):
    return evaluation.distribution(docs(spark, d), T.stance(F.col("text"), PLAIN), "lang")


@query(f"with s as (select {STANCE.format('text')} as stance, quality from documents join labels using (doc_id)) select stance, quality, count(*) as n, round(count(*)::double / sum(count(*)) over (partition by stance), 6) as share from s group by 1, 2")
def stance_confusion(spark, d):
    rows = docs(spark, d).join(read(spark, d, "labels"), "doc_id").select(T.stance(F.col("text"), PLAIN).alias("stance"), "quality")
    return evaluation.confusion(rows, "stance", "quality")


MENTIONS_SQL = """
m0 as (select doc_id, text, regexp_extract_all(text, '[0-9]{3}-[0-9]{4}') as ms, string_split_regex(text, '[0-9]{3}-[0-9]{4}') as ps from documents),
m1 as (select doc_id, text, ms, ps, unnest(range(1, len(ms) + 1)) as i from m0),
m2 as (select doc_id, text, ms[i] as raw, cast(list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) as int) as start from m1),
m3 as (select *, substr(text, cast(greatest(start - 200, 0) + 1 as bigint), cast(start + length(raw) + 200 - greatest(start - 200, 0) as bigint)) as win, substr(text, cast(greatest(start - 80, 0) + 1 as bigint), cast(start + length(raw) + 80 - greatest(start - 80, 0) as bigint)) as snip from m2),
mentions as (select raw as citation_key, doc_id as source_doc_id, case when regexp_matches(win, '(?i)(?:scum|idiot)') then 'overruled' when regexp_matches(win, '(?i)(?:stan|tial)') then 'distinguished' when regexp_matches(win, '(?i)(?:ing|ly)') then 'followed' else 'referred' end as treatment, raw, trim(snip) as snippet, start from m3)"""


@query(f"with {MENTIONS_SQL} select citation_key, source_doc_id, treatment, snippet, start from mentions")
def citation_mentions(spark, d):
    return treatment.mentions(docs(spark, d), patterns=PLAIN).drop("raw")


@query(f"with {MENTIONS_SQL} select citation_key, arg_max(treatment, case treatment when 'overruled' then 3 when 'distinguished' then 2 when 'followed' then 1 else 0 end) as worst, count(*) as n from mentions group by 1")
def worst_treatment(spark, d):
    return treatment.worst_treatment(treatment.mentions(docs(spark, d), patterns=PLAIN))


@query(f"with {MENTIONS_SQL} select treatment, count(*) as mentions, count(distinct citation_key) as citations from mentions group by grouping sets ((treatment), ())")
def treatment_stats(spark, d):
    return treatment.treatment_stats(treatment.mentions(docs(spark, d), patterns=PLAIN))


@query(f"""with {MENTIONS_SQL}, w as (select citation_key, max(case treatment when 'overruled' then 3 when 'distinguished' then 2 when 'followed' then 1 else 0 end) as s from mentions group by 1)
select source_doc_id as id, string_agg(line, '; ' order by line) as warning from (select distinct source_doc_id, citation_key || ' was ' || case s when 3 then 'overruled' else 'distinguished' end as line from mentions join w using (citation_key) where s >= 2) group by 1""")
def treatment_warnings(spark, d):
    rows = docs(spark, d)
    return treatment.warnings(rows, treatment.worst_treatment(treatment.mentions(rows, patterns=PLAIN)), patterns=PLAIN)


@query(f"""with {MENTIONS_SQL}, w as (select citation_key, max(case treatment when 'overruled' then 3 when 'distinguished' then 2 when 'followed' then 1 else 0 end) as s from mentions group by 1),
c as (select source_doc_id as id, string_agg(line, '; ' order by line) as warning from (select distinct source_doc_id, citation_key || ' was ' || case s when 3 then 'overruled' else 'distinguished' end as line from mentions join w using (citation_key) where s >= 2) group by 1),
r as (select lang as query_id, doc_id as id, source, text, row_number() over (partition by lang order by doc_id) as n from documents)
select id, md5('[' || n || '] (' || {NOTE.format(STANCE.format('text'))} || ') ' || source || ': ' || text || coalesce(chr(10) || 'CAUTION: ' || warning, '')) as digest from r left join c using (id)""")
def source_lines(spark, d):
    rows = docs(spark, d)
    found = treatment.warnings(rows, treatment.worst_treatment(treatment.mentions(rows, patterns=PLAIN)), patterns=PLAIN)
    listed = rows.select(F.col("lang").alias("query_id"), F.col("doc_id").alias("rank"), "id", F.col("source").alias("court"), "text")
    return answers.source_lines(listed, found, PLAIN).select("id", F.md5("line").alias("digest"))


# Evaluation.


def _labels(spark, d):
    """Vectors of a query's own label are relevant to it."""
    v = vectors(spark, d)
    q = asked_vectors(spark, d).select("query_id", "label")
    same = q.join(v.select("id", "label"), "label").groupBy("query_id", "label").agg(F.array_sort(F.collect_list("id")).alias("relevant"))
    return same.select("query_id", F.when(F.col("label") % 2 == 0, "exact").otherwise("conceptual").alias("kind"), "relevant")


EVAL_SQL = f"""{dense_sql(10)}, rel as (select a.vec_id as query_id, case when a.label % 2 = 0 then 'exact' else 'conceptual' end as kind, b.vec_id as id, count(*) over (partition by a.vec_id) as n_rel from embeddings a join embeddings b on a.label = b.label where a.vec_id % 100 = 0),
hit as (select query_id, rank, (query_id, id) in (select (query_id, id) from rel) as ok from dense),
res as (select h.query_id, any_value(r.kind) as kind, sum(ok::int)::double / any_value(r.n_rel) as recall, avg(ok::int) as precision, coalesce(1.0 / min(rank) filter (where ok), 0) as reciprocal_rank from hit h join (select distinct query_id, kind, n_rel from rel) r on r.query_id = h.query_id group by 1)"""


@query(f"with {EVAL_SQL} select query_id, kind, round(recall, 6) as recall, round(precision, 6) as precision, round(reciprocal_rank, 6) as reciprocal_rank from res")
def eval_metrics(spark, d):
    ranked = dense.nearest(asked_vectors(spark, d), vectors(spark, d), 10)
    return evaluation.query_results(ranked, _labels(spark, d), 10).select("query_id", "kind", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "reciprocal_rank")])


@query(f"with {EVAL_SQL} select coalesce(kind, 'all') as kind, count(*) as n, round(avg(recall), 6) as recall, round(avg(precision), 6) as precision, round(avg(reciprocal_rank), 6) as reciprocal_rank from res group by grouping sets ((kind), ())")
def eval_summary_by_kind(spark, d):
    ranked = dense.nearest(asked_vectors(spark, d), vectors(spark, d), 10)
    return evaluation.summary(evaluation.query_results(ranked, _labels(spark, d), 10))


@query(f"with {dense_sql(20)}, {bm25_sql(DOCS_Q, 20)}, u as (select query_id, id, 'dense' as s from dense union all select query_id, id, 'bm25' from bm25) select query_id, id, string_agg(s, ',' order by s) as systems from u group by 1, 2")
def pool_union(spark, d):
    found = {"dense": dense.nearest(asked_vectors(spark, d), vectors(spark, d), 20), "bm25": lexical.bm25(docs(spark, d), asked_docs(spark, d), 20, patterns=PLAIN)}
    return fusion.pool(found).withColumn("systems", F.array_join("systems", ","))


@query(f"with {dense_sql(20)}, {bm25_sql(DOCS_Q, 20)} select query_id, count(*) as shared from dense join bm25 using (query_id, id) group by 1")
def topk_overlap(spark, d):
    return evaluation.overlap(dense.nearest(asked_vectors(spark, d), vectors(spark, d), 20), lexical.bm25(docs(spark, d), asked_docs(spark, d), 20, patterns=PLAIN), 20)


@query("with o as (select doc_id, row_number() over (order by doc_id) - 1 as place, greatest(1, count(*) over () // 37) as step from documents) select doc_id from o where place % step = 0 and place < step * 37")
def systematic_sample(spark, d):
    return evaluation.systematic_sample(docs(spark, d), "doc_id", 37).select("doc_id")


@query("with o as (select *, row_number() over (order by n_chars, doc_id) - 1 as place, greatest(1, count(*) over () // 101) as step from documents) select n_chars, count(*) as n from o where place % step = 0 and place < step * 101 group by 1")
def sampled_lengths(spark, d):
    """Lengths of a systematic sample in order of length, which repeats."""
    return evaluation.systematic_sample(docs(spark, d), "n_chars", 101).groupBy("n_chars").agg(F.count("*").alias("n"))


@query("select lang, doc_id, cast(row_number() over (partition by lang order by md5('7:' || doc_id), doc_id) as int) as draw from documents qualify draw <= 5")
def stratified_sample(spark, d):
    return evaluation.stratified_sample(docs(spark, d).select("lang", "doc_id"), "lang", "doc_id", 5, 7)


@query("""with w as (select distinct doc_id from labels where quality = 0), r as (select doc_id from documents where doc_id not in (select doc_id from w) order by md5('3:' || doc_id), doc_id limit 50)
select doc_id, true as positive from documents where doc_id in (select doc_id from w) union all select doc_id, false from r""")
def probe_pool(spark, d):
    bad = read(spark, d, "labels").where("quality = 0")
    return evaluation.probe_pool(docs(spark, d).select("doc_id"), bad, "doc_id", 50, 3)


@query("select lang, median(n_chars) as median_cited, round(avg(n_chars), 6) as mean_cited, round(avg((source = 'src0')::int), 6) as top_share from documents group by lang")
def authority_profile(spark, d):
    return evaluation.authority_profile(docs(spark, d), "lang", "n_chars", F.col("source") == "src0")


@query("select source, count(*) as n from documents group by source order by n desc, source limit 5")
def most_common_sources(spark, d):
    return evaluation.most_common(docs(spark, d), "source", 5)


CONFIGS = {"hybrid": (1, 1), "weighted": (1, 3)}


def sweep_sql() -> str:
    fused = "".join(
        f""",
f_{name} as (select query_id, id, sum(w / (60 + rank)) as score, min(no * 1000 + rank) as first from (select query_id, id, rank, 0 as no, cast({a} as double) as w from dense union all select query_id, id, rank, 1, cast({b} as double) from bm25) group by 1, 2),
r_{name} as (select query_id, row_number() over (partition by query_id order by round(score, 9) desc, first, id) as rank, id from f_{name} qualify rank <= 10)"""
        for name, (a, b) in CONFIGS.items()
    )
    lists = " union all ".join(f"select '{name}' as config, query_id, rank, id from {table} where rank <= 10" for name, table in (("dense", "dense"), ("bm25", "bm25"), *((n, f"r_{n}") for n in CONFIGS)))
    return f"""with {dense_sql(20)}, {bm25_sql(DOCS_Q, 20)}{fused},
lists as ({lists}),
rel as (select a.vec_id as query_id, case when a.label % 2 = 0 then 'exact' else 'conceptual' end as kind, b.vec_id as id, count(*) over (partition by a.vec_id) as n_rel from embeddings a join embeddings b on a.label = b.label where a.vec_id % 100 = 0),
hit as (select config, query_id, rank, (query_id, id) in (select (query_id, id) from rel) as ok from lists),
res as (select c.config, r.query_id, any_value(r.kind) as kind, coalesce(sum(ok::int), 0)::double / any_value(r.n_rel) as recall, coalesce(avg(ok::int), 0) as precision, coalesce(1.0 / min(rank) filter (where ok), 0) as reciprocal_rank
  from (select distinct query_id, kind, n_rel from rel) r cross join (select distinct config from lists) c left join hit h on h.query_id = r.query_id and h.config = c.config group by 1, 2)
select config, coalesce(kind, 'all') as kind, count(*) as n, round(avg(recall), 6) as recall, round(avg(precision), 6) as precision, round(avg(reciprocal_rank), 6) as reciprocal_rank from res group by grouping sets ((config, kind), (config))"""


@query(sweep_sql())
def config_sweep(spark, d):
    near, words = (stored(x, "ranking") for x in (dense.nearest(asked_vectors(spark, d), vectors(spark, d), 20), lexical.bm25(docs(spark, d), asked_docs(spark, d), 20, patterns=PLAIN)))
    fused = {name: fusion.rrf([near, words], 10, [float(w) for w in weights]) for name, weights in CONFIGS.items()}
    return evaluation.sweep({"dense": near, "bm25": words} | fused, _labels(spark, d), 10)


@query(f"with {dense_sql(20)}, {bm25_sql(DOCS_Q, 20)}, u as (select query_id, id from dense union all select query_id, id from bm25) select count(*) as returned, count(distinct (query_id, id)) as distinct, round(1 - count(distinct (query_id, id))::double / count(*), 6) as overlap from u")
def pool_agreement(spark, d):
    found = {"dense": dense.nearest(asked_vectors(spark, d), vectors(spark, d), 20), "bm25": lexical.bm25(docs(spark, d), asked_docs(spark, d), 20, patterns=PLAIN)}
    return evaluation.pool_overlap(fusion.pool(found))


@query(f"with {dense_sql(20)} select query_id, id, cast(row_number() over (partition by query_id order by md5('5:' || query_id || ':' || id), id) as int) as place from dense")
def pool_shuffled(spark, d):
    return evaluation.shuffled(dense.nearest(asked_vectors(spark, d), vectors(spark, d), 20).select("query_id", "id"), 5)


SNAPSHOT_Q = "select item_id as query_id, text as query from benchmark order by item_id limit 9"


@query(f"with {bm25_sql(SNAPSHOT_Q, 20)} select query_id, rank, id, round(score, 6) as score from bm25")
def score_snapshot(spark, d):
    """Scores of nine questions, the first by id, to depth 20: what a change of the ranking is held against."""
    nine = asked(spark, d).orderBy("query_id").limit(9)
    return lexical.bm25(docs(spark, d), nine, 20, patterns=PLAIN).withColumn("score", F.round("score", 6))


@query()
def embedder_trial(spark, d):
    """Two embedders on one pool: documents of bad quality and fifty others; passages find the pool's documents of a run of their words."""
    rows = docs(spark, d).select("id", "text")
    bad = read(spark, d, "labels").where("quality = 0").select(F.col("doc_id").alias("id"))
    pool = stored(evaluation.probe_pool(rows.select("id"), bad, "id", 50, 3), "trial_pool")
    shared = benchmark_overlap(spark, d).select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("id"))
    relevant = shared.join(pool.select("id"), "id", "left_semi").groupBy("query_id").agg(F.array_sort(F.collect_set("id")).alias("relevant"))
    labels = stored(relevant.select("query_id", F.lit("exact").alias("kind"), "relevant"), "trial_labels")
    return embedder_trial_of(rows, pool, asked(spark, d), labels, {"small": providers.HashedWords(32), "large": providers.HashedWords(256)}, 10)


MODEL_SQL = "case quality when 0 then 'both' when 1 then 'holding' else null end"


@query(f"""with s as (select {STANCE.format('text')} as a, {MODEL_SQL} as b from documents join labels using (doc_id)), c as (select count(*) filter (where b is not null) as judged, count(*) filter (where a = b) as agreed, count(*) filter (where b is null) as skipped,
  count(*) filter (where b is not null and a = 'neither') as declined, count(*) filter (where a = 'neither' and b <> 'neither') as missed from s)
select *, round(coalesce(agreed::double / nullif(judged, 0), 0), 6) as agreement, round(coalesce(missed::double / nullif(declined, 0), 0), 6) as missed_rate from c""")
def stance_agreement(spark, d):
    rows = docs(spark, d).join(read(spark, d, "labels"), "doc_id")
    model = F.when(F.col("quality") == 0, "both").when(F.col("quality") == 1, "holding")
    return evaluation.agreement(rows.select(T.stance(F.col("text"), PLAIN).alias("regex"), model.alias("model")))


@query("with o as (select n_chars v, row_number() over (order by n_chars) - 1 as i, count(*) over () as n from documents) select round(avg(v), 6) as mean, median(v) as median, round(100 * avg((v = 0)::int), 6) as zero_percent, max(v) filter (where i = least(floor(n * 0.9), n - 1)) as p90, max(v) as max from o")
def length_described(spark, d):
    return evaluation.described(docs(spark, d), "n_chars")


NAMED = "([A-Za-z]+)[ ,.|]+[+]1 [(][0-9]{3}[)] ([0-9]{3}-[0-9]{4})"


@query(f"""with c as (select regexp_extract_all(text, '[0-9]{{3}}-[0-9]{{4}}') as c, len(regexp_extract_all(text, '{NAMED}')) as n from documents), k as (select count(distinct c) as k from (select unnest(c) as c from c))
select count(*) as texts, count(*) filter (where len(c) > 0) as citing, cast(sum(len(c)) as bigint) as occurrences, cast(sum(n) as bigint) as named, any_value(k) as distinct_citations from c, k""")
def citation_profile(spark, d):
    return treatment.citation_profile(docs(spark, d), citation=PLAIN.citation, named=NAMED)


@query("select citation, count(*) as n from (select unnest(regexp_extract_all(text, '[0-9]{3}-[0-9]{4}')) as citation from documents) group by 1 order by n desc, citation limit 5")
def most_cited(spark, d):
    return treatment.most_cited(docs(spark, d), 5, citation=PLAIN.citation)


@query(rf"select doc_id as id, regexp_extract(m, '{NAMED}', 1) as name, regexp_extract(m, '{NAMED}', 2) as citation from (select doc_id, unnest(regexp_extract_all(text, '{NAMED}')) as m from documents)")
def cited_cases(spark, d):
    return treatment.cited_cases(docs(spark, d), pattern=NAMED)


@query(r"select count(*) as n, count(*) filter (where len(regexp_extract_all(text, '\S+')) > 300) as truncated from documents")
def embedder_cuts(spark, d):
    return providers.truncated(docs(spark, d), "text", 300)


# Prompts, answers, claims.


@query(f"""
with r as (select conv_id as query_id, 'q' as query, turn as rank, text, row_number() over (partition by conv_id order by turn, text) as n from conversations),
b as (select *, '[' || n || '] (' || {NOTE.format(STANCE.format('text'))} || ') ' || text as block from r),
s as (select *, length(query) + sum(length(block)) over (partition by query_id order by n) as spent from b),
o as (select *, max(case when n > 1 and spent > 1500 then 1 else 0 end) over (partition by query_id order by n) as over from s)
select query_id, cast(n as int) as n, md5(block) as digest, cast(spent as bigint) as spent from o where over = 0""")
def prompt_pack(spark, d):
    c = read(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), F.lit("q").alias("query"), F.struct("turn", "text").alias("rank"), "text")
    return answers.pack_sources(c, 1500, patterns=PLAIN).select("query_id", "n", F.md5("block").alias("digest"), "spent")


ANSWER_SQL = "select conv_id, turn, text || ' [' || (turn % 5) || ', ' || (turn + 1) || '] and [' || (turn % 3) || '][12].' as answer from conversations"


@query(f"""with a as ({ANSWER_SQL}), n as (select conv_id, turn, answer, list_transform(flatten(list_transform(regexp_extract_all(answer, '\\[\\s*[0-9]{{1,3}}(?:\\s*,\\s*[0-9]{{1,3}})*\\s*\\]'), lambda x: regexp_extract_all(x, '[0-9]+'))), lambda x: x::int) as ns from a),
x as (select conv_id, turn, answer, list_filter(ns, lambda v, i: list_position(ns, v) = i) as ns from n)
select conv_id, turn, answer like 'INSUFFICIENT_CONTEXT%' as refused, array_to_string(list_filter(ns, lambda v: v between 1 and 4), ',') as cited, array_to_string(list_filter(ns, lambda v: not v between 1 and 4), ',') as invalid from x""")
def parse_citations(spark, d):
    c = read(spark, d, "conversations")
    turn = F.col("turn")
    answer = F.concat("text", F.lit(" ["), (turn % 5).cast("string"), F.lit(", "), (turn + 1).cast("string"), F.lit("] and ["), (turn % 3).cast("string"), F.lit("][12]."))
    rows = c.select("conv_id", "turn", T.parsed_answer(answer, F.lit(4)).alias("a"))
    join = lambda x: F.array_join(F.transform(x, lambda n: n.cast("string")), ",")
    return rows.select("conv_id", "turn", "a.refused", join("a.cited").alias("cited"), join("a.invalid").alias("invalid"))


@query("""
with c as (select conv_id as id, turn as claim_no, case when turn % 3 = 0 then [] when turn % 3 = 1 then [1, 9] else [2] end as cited from conversations),
k as (select id, claim_no, unnest(cited) as source from c),
v as (select id, claim_no, case when source = 9 then 'missing_source' when (id + claim_no) % 3 = 0 then 'unclear' when (id + claim_no) % 3 = 1 then 'supported' else 'unsupported' end as verdict from k),
p as (select id, claim_no, count(*) n, sum((verdict = 'missing_source')::int) mis, sum((verdict = 'unclear')::int) unc, sum((verdict = 'supported')::int) good from v group by 1, 2),
j as (select c.id, len(cited) = 0 as bare, n, mis, unc, good from c left join p on p.id = c.id and p.claim_no = c.claim_no)
select count(*) as claims, cast(sum(bare::int) as bigint) as uncited_claims, round(sum(bare::int)::double / count(*), 6) as uncited_rate, cast(coalesce(sum(n), 0) as bigint) as citations, cast(coalesce(sum(mis), 0) as bigint) as missing_sources, cast(coalesce(sum(unc), 0) as bigint) as unclear,
 round(coalesce(sum(good)::double / nullif(sum(n) - sum(mis), 0), 0), 6) as citation_precision, round(coalesce(sum((not bare and good > 0)::int)::double / nullif(sum((not bare)::int), 0), 0), 6) as claim_support from j""")
def attribution_summary(spark, d):
    turn = F.col("turn")
    c = read(spark, d, "conversations").select(F.col("conv_id").alias("id"), turn.alias("claim_no"), F.when(turn % 3 == 0, F.array().cast("array<int>")).when(turn % 3 == 1, F.array(F.lit(1), F.lit(9))).otherwise(F.array(F.lit(2))).alias("cited"))
    s = (F.col("id") + F.col("claim_no")) % 3
    checks = c.select("id", "claim_no", F.explode("cited").alias("source")).withColumn("verdict", F.when(F.col("source") == 9, "missing_source").when(s == 0, "unclear").when(s == 1, "supported").otherwise("unsupported"))
    out = answers.attribution(c, checks)
    return out.select(*[F.round(x, 6).alias(x) if t == "double" else F.col(x) for x, t in out.dtypes])


@query("""
with c as (select conv_id, turn, 'claim ' || turn as t, [turn % 5, turn + 1, turn % 3] as ids from conversations)
select conv_id, turn, turn % 7 = 0 as refused, case when turn % 7 = 0 then 'INSUFFICIENT_CONTEXT' else t || ' [' || array_to_string(ids, ', ') || ']' || chr(10) || chr(10) || 'second [9]' end as text,
 array_to_string(list_filter(list_filter(list_concat(ids, [9]), lambda x, i: list_position(list_concat(ids, [9]), x) = i), lambda x: x between 1 and 4), ',') as cited,
 array_to_string(list_filter(list_filter(list_concat(ids, [9]), lambda x, i: list_position(list_concat(ids, [9]), x) = i), lambda x: not x between 1 and 4), ',') as invalid from c""")
def structured_answers(spark, d):
    """Replies of whole and of broken claims: one without text, one without sources, one whose number isn't whole."""
    turn = F.col("turn")
    number = lambda c: c.cast("string")
    ids = F.concat_ws(", ", number(turn % 5), number(turn + 1), F.lit("2.5"), number(turn % 3))
    reply = F.concat(
        F.lit('{"refused": '), F.when(turn % 7 == 0, "true").otherwise("false"), F.lit(', "claims": [{"text": " claim '), number(turn), F.lit(' ", "source_ids": ['), ids,
        F.lit(']}, {"text": " ", "source_ids": [1]}, {"text": "bare", "source_ids": []}, {"text": "second", "source_ids": [9]}]}'),
    )
    rows = read(spark, d, "conversations").select("conv_id", "turn", T.structured_answer(reply, F.lit(4)).alias("a"))
    join = lambda x: F.array_join(F.transform(x, number), ",")
    return rows.select("conv_id", "turn", "a.refused", "a.text", join("a.cited").alias("cited"), join("a.invalid").alias("invalid"))


class Closing:
    """A summariser's stand-in: the end of a text and a digest of all of it, without tags where it ends with a vowel."""

    last_finish_reason = None

    def complete(self, system: str, prompt: str) -> str:
        import hashlib

        text = prompt.removeprefix("Judgment Text:\n")
        told = f"{text[-90:]} {hashlib.md5(text.encode()).hexdigest()}"
        return told if text[-1:] in tuple("aeiou") else f"<summary>{told}</summary>"


LEAK_SQL = " or ".join(["contains(lower(s), '{}')".format(T.LEAKED), *("starts_with(lower(s), '{}')".format(p.replace("'", "''")) for p in T.LEAKS)])


@query(f"""with h as (select doc_id, trim(right(text, 90) || ' ' || md5(text), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as s from (select doc_id, coalesce(text, '') as text from documents) where doc_id % 3 <> 0 and right(text, 1) not in ('a', 'e', 'i', 'o', 'u'))
select doc_id, s as summary from h where not ({LEAK_SQL})""")
def document_summaries(spark, d):
    """Of documents that no summary is stored for (here: those whose id three doesn't divide), from their whole texts."""
    rows = docs(spark, d).select("id", "text")
    stored = rows.where("id % 3 = 0").select(F.col("id").alias("doc_id"))
    return audit.summaries(rows, stored, Closing, most=None)


@query()
def audited_answers(spark, d):
    """Answers of an engine, and their claims judged against their sources by a stand-in, as one row of figures."""
    told, sources = _engine(spark, d).answer_with_sources(asked(spark, d), providers.Extractive, 5)
    return audit.audit(told, sources, audit.WordJudge)


@query()
def conceptual_cache_replay(spark, d):
    """Questions of all events, by turns identifiers and conceptual ones, against each user's cache of a few answers; those
    beyond the table of vectors have none, so that nothing is near them."""
    v = vectors(spark, d).select(F.col("id").alias("event_id"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    e = read(spark, d, "events").join(v, "event_id", "left").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.col("event_type").alias("query"), F.when(F.col("event_id") % 4 == 0, "identifier").otherwise("conceptual").alias("kind"), "embedding")
    return state.replay_cache(e, 8, 0.4)


# Leaks and overlaps.


@query("""
with b as (select item_id, regexp_extract_all(lower(text), '[a-z0-9]+') as w from benchmark), g as (select distinct item_id, array_to_string(w[i:i + 5], ' ') as gram from (select item_id, w, unnest(range(1, len(w) - 4)) as i from b)),
d as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as w from documents), e as (select distinct doc_id, array_to_string(w[i:i + 5], ' ') as gram from (select doc_id, w, unnest(range(1, len(w) - 4)) as i from d))
select doc_id, item_id, count(*) as shared from e join g using (gram) group by 1, 2""")
def benchmark_overlap(spark, d):
    grams = lambda c: F.explode(T.ngrams(T.found(F.lower(c), "[a-z0-9]+"), 6))
    hashed = lambda df: df.withColumn("hash", F.xxhash64("gram"))
    right = hashed(read(spark, d, "benchmark").select("item_id", grams(F.col("text")).alias("gram")))
    # numbers of the benchmark's runs meet those of documents first; only runs that are there go on as text
    left = hashed(docs(spark, d).select("doc_id", grams(F.col("text")).alias("gram"))).join(right.select("hash").distinct(), "hash", "left_semi")
    return left.join(right, ["hash", "gram"]).groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))


@query("""
with c as (select conv_id, turn, text, lead(text) over (partition by conv_id order by turn) as after from conversations),
w as (select conv_id, turn, regexp_extract_all(lower(text), '[a-z0-9]+') as a, regexp_extract_all(lower(after), '[a-z0-9]+') as b from c where after is not null)
select conv_id, turn, list_has_any(list_transform(range(1, len(a) - 4), lambda i: array_to_string(a[i:i + 5], ' ')), list_transform(range(1, len(b) - 4), lambda i: array_to_string(b[i:i + 5], ' '))) as leaks from w""")
def leak_ngrams(spark, d):
    c = read(spark, d, "conversations").withColumn("after", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("after is not null")
    return c.select("conv_id", "turn", T.shares_run(F.col("text"), F.col("after")).alias("leaks"))


@query("""
with s as (select item_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: length(x) > 2 and not list_contains(['the', 'of', 'and', 'state', 'others', 'anr', 'ors', 'vs', 'v', 'union', 'india', 'in', 're', 'smt', 'shri', '&'], x))) as want from benchmark),
t as (select item_id, len(want) as n, unnest(want) as w from s where len(want) >= 2),
d as (select doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) as w from documents)
select item_id, doc_id from t join d using (w) group by item_id, doc_id, n having count(*) = n""")
def name_containment(spark, d):
    names = read(spark, d, "benchmark").select("item_id", T.significant(F.col("text")).alias("words")).where(F.size("words") >= 2)
    return containment.contained(names, docs(spark, d).select("doc_id", T.found(F.lower("text"), "[a-z]+").alias("words")), "item_id", "doc_id")


# State.


@query()
def rate_limit_replay(spark, d):
    return state.replay_limiter(read(spark, d, "events"), limit=3, window=7 * 86400.0)


@query()
def cache_replay(spark, d):
    c = read(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.col("event_type").alias("query"))
    return state.replay_cache(c, 2)


@query("select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n from events group by 1, 2")
def windowed_counts(spark, d):
    return state.windowed_counts(read(spark, d, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("select conv_id, max(turn) as turn, arg_max(role, turn) as role, md5(arg_max(text, turn)) as digest from conversations group by conv_id")
def latest_sessions(spark, d):
    return corpus.latest(read(spark, d, "conversations"), "conv_id", "turn").select("conv_id", "turn", "role", F.md5("text").alias("digest"))


# Functions of tables that only Python expresses.


@query()
def chunk_documents(spark, d):
    meta = F.struct(F.lit(None).cast("string").alias("title"), F.col("source").alias("court"))
    return chunk.chunk_documents(docs(spark, d).select(F.col("doc_id").cast("string").alias("id"), "text", meta.alias("metadata"))).drop("metadata")


@query()
def split_claims(spark, d):
    c = read(spark, d, "conversations").select(F.concat_ws("#", "conv_id", "turn").alias("id"), F.concat("text", F.lit(" [1]. "), "text", F.lit(" [2, 3].")).alias("text"))
    return answers.claims_table(c)


SIZES = ((450, 100), (700, 200), (1000, 300))


@query()
def chunk_sweep(spark, d):
    """Chunks, their mean and greatest length and documents with some, for each of three sizes."""
    rows = docs(spark, d).select(F.col("doc_id").cast("string").alias("id"), "text", F.struct(F.lit(None).cast("string").alias("title"), F.col("source").alias("court")).alias("metadata"))
    out = None
    for size, overlap in SIZES:
        chunks = chunk.chunk_documents(rows, chunk.Chunking(size=size, overlap=overlap))
        one = chunks.agg(F.count("*").alias("chunks"), F.round(F.avg(F.length("text")), 6).alias("mean"), F.max(F.length("text")).alias("longest"), F.count_distinct("doc_id").alias("documents")).withColumn("size", F.lit(size))
        out = one if out is None else out.unionByName(one)
    return out


def _engine(spark, d) -> Engine:
    rows = docs(spark, d).select("id", F.col("source").alias("doc_id"), F.col("doc_id").cast("int").alias("idx"), "text", F.col("source").alias("court"), F.col("n_chars").alias("cited_by"))
    embedder = providers.HashedWords()
    return Engine.build(rows, embedder, PLAIN)


@query()
def engine_answers(spark, d):
    """Routed, reranked, fused, expanded, packed and answered by a stand-in for a model."""
    return _engine(spark, d).answer(asked(spark, d), providers.Extractive, 5)
