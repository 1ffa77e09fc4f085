"""Every registered query of the catalogue against its SQL in DuckDB, on the smallest tables."""

import math

import pytest

from lumenry import queries as catalogue

DIR = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_parity(spark, con, name):
    df = catalogue.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted([tuple(plain(r[c]) for c in cols) for r in df.collect()], key=str)
    found = con.execute(catalogue.ORACLES[name])
    names = [c[0] for c in found.description]
    want = sorted([tuple(plain(dict(zip(names, r, strict=True))[c]) for c in cols) for r in found.fetchall()], key=str)
    assert sorted(names) == cols and got == want and (want or name in MAY_BE_EMPTY)


#: Tables of the smallest size hold no rows for these.
MAY_BE_EMPTY = {"exact_labels", "name_containment", "treatment_warnings"}


def test_queries_without_sql_are_known():
    assert set(catalogue.QUERIES) - set(catalogue.ORACLES) == {"rate_limit_replay", "cache_replay", "conceptual_cache_replay", "chunk_documents", "chunk_sweep", "split_claims", "engine_answers", "audited_answers", "descent_graph", "embedder_trial"}


def rows_of(name):
    import pyarrow.parquet as pq

    return pq.read_table(f"{DIR}/{name}.parquet").to_pylist()


def test_rate_limit_replay(spark):
    """Every user's events in order of time, let through while fewer than three of the last week were."""
    want, accepted = {}, {}
    for e in sorted(rows_of("events"), key=lambda e: (e["ts"], e["event_id"])):
        held = accepted.setdefault(e["user_id"], [])
        recent = [t for t in held if (e["ts"] - t).total_seconds() <= 7 * 86400]
        want[e["event_id"]] = len(recent) < 3
        if want[e["event_id"]]:
            held.append(e["ts"])
    got = {r["id"]: r["allowed"] for r in catalogue.QUERIES["rate_limit_replay"](spark, DIR).collect()}
    assert got == want and not all(want.values())


def test_cache_replay(spark):
    """Each user's questions against the last two different ones that missed."""
    want, caches = {}, {}
    for e in sorted(rows_of("events"), key=lambda e: e["event_id"]):
        cache = caches.setdefault(e["user_id"], [])
        want[e["event_id"]] = e["event_type"].lower() in cache
        if not want[e["event_id"]]:
            cache.append(e["event_type"].lower())
            del cache[:-2]
    got = {r["seq"]: r["hit"] for r in catalogue.QUERIES["cache_replay"](spark, DIR).collect()}
    assert got == want and any(want.values())


def test_conceptual_cache_replay(spark):
    vectors = {r["vec_id"]: r["embedding"] for r in rows_of("embeddings")}
    want, caches = {}, {}
    for e in sorted(rows_of("events"), key=lambda e: e["event_id"]):
        cache, kind, v = caches.setdefault(e["user_id"], []), "identifier" if e["event_id"] % 4 == 0 else "conceptual", vectors.get(e["event_id"])
        if kind == "identifier":
            hit = any(k == kind and t == e["event_type"] for k, t, _ in cache)
        else:
            hit = v is not None and any(k == kind and w is not None and sum(a * b for a, b in zip(v, w, strict=True)) >= 0.4 for k, _, w in cache)
        want[e["event_id"]] = hit
        if not hit:
            # one entry a question: a question asked again replaces the former answer where that stands
            again = [i for i, (k, t, _) in enumerate(cache) if (k, t) == (kind, e["event_type"])]
            if again:
                cache[again[0]] = (kind, e["event_type"], v)
            else:
                cache.append((kind, e["event_type"], v))
            del cache[:-8]
    got = {r["seq"]: r["hit"] for r in catalogue.QUERIES["conceptual_cache_replay"](spark, DIR).collect()}
    assert got == want and len(got) == len(rows_of("events")) and any(want.values()) and not all(want.values())


def test_chunks(spark):
    """Properties that hold of every chunk: size, order, overlap, and that no word of a text is lost."""
    rows = [r.asDict() for r in catalogue.QUERIES["chunk_documents"](spark, DIR).collect()]
    texts = {str(d["doc_id"]): (d["source"], d["text"] or "") for d in rows_of("documents")}
    by_doc = {}
    for r in sorted(rows, key=lambda r: r["idx"]):
        by_doc.setdefault(r["doc_id"], []).append(r)
    for doc, chunks in by_doc.items():
        source, text = texts[doc]
        assert [c["idx"] for c in chunks] == list(range(len(chunks))) and all(c["id"] == f"{doc}#{c['idx']}" for c in chunks)
        bodies = []
        for c in chunks:
            head, _, body = c["text"].partition("\n\n")
            assert head == source and len(c["text"]) <= 450 and len(body) >= 40
            bodies.append(body)
        joined = "".join("".join(bodies).split())
        assert all(b in joined for b in ("".join(b.split()) for b in bodies))
        # without white space, the chunks cover the text from its begin on in order
        plain, at = "".join(text.split()), 0
        for b in bodies:
            words = "".join(b.split())
            found = plain.find(words[-20:], max(0, at - 20))
            assert found >= 0
            at = found + len(words[-20:])
    sizes = {r["size"]: r for r in catalogue.QUERIES["chunk_sweep"](spark, DIR).collect()}
    assert sizes[450]["chunks"] > sizes[700]["chunks"] > sizes[1000]["chunks"] and all(r["longest"] <= n for n, r in sizes.items())


def test_claims(spark):
    """Each turn's text stands twice, before one source and before two: the claims hold all its words and those numbers."""
    got = {}
    for r in catalogue.QUERIES["split_claims"](spark, DIR).collect():
        got.setdefault(r["id"], []).append(r)
    for c in rows_of("conversations"):
        claims = sorted(got[f"{c['conv_id']}#{c['turn']}"], key=lambda r: r["claim_no"])
        assert [r["cited"] for r in claims] == [[1], [2, 3]] or len(" ".join(c["text"].split())) < 15
        if len(claims) == 2:
            assert claims[0]["claim"] == " ".join(c["text"].split()) and claims[1]["claim"] == " ".join(f". {c['text']}".split())


def test_answers_and_their_audit(spark):
    rows = catalogue.QUERIES["engine_answers"](spark, DIR).collect()
    asked = {b["item_id"] for b in rows_of("benchmark")}
    assert {r["query_id"] for r in rows} == asked
    assert all(r["refused"] == (r["reply"] == "INSUFFICIENT_CONTEXT") and set(r["cited"]) <= set(range(1, r["n_sources"] + 1)) for r in rows) and not all(r["refused"] for r in rows)
    a = catalogue.QUERIES["audited_answers"](spark, DIR).first()
    told = [r for r in rows if not r["refused"]]
    # the stand-in repeats a sentence of its first source, which therefore carries every claim
    assert (a["answers"], a["refused"], a["truncated"]) == (len(rows), len(rows) - len(told), 0)
    assert a["missing_sources"] == 0 and a["citation_precision"] == 1.0 and a["claims"] >= len(told)


def test_exact_hits_come_first(spark):
    """Queries that hold identifiers are there, and what holds all of them comes before other hits."""
    rows = catalogue.QUERIES["routed_search"](spark, DIR).collect()
    assert {r["score_type"] for r in rows} == {"exact", "boosted"}
    last = {}
    for r in rows:
        if r["score_type"] == "exact":
            last[r["query_id"]] = max(last.get(r["query_id"], 0), r["rank"])
    assert all(r["rank"] > last.get(r["query_id"], 0) for r in rows if r["score_type"] == "boosted")


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["query_id", "rank", "id", "score", "score_type"]
