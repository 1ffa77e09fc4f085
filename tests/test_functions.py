"""Column functions on literal texts."""

import math

import pytest
from pyspark.sql import functions as F

from lumenry.functions import metrics as M, text as T, vectors as V
from lumenry.operators import treatment


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first()["y"]


def test_normalize(spark):
    for raw, want in (("a     b", "a b"), ("a\nb", "a\nb"), ("a\n\n\n\nb", "a\n\nb"), ("x <span class=n>12</span>y<br>z ", "x y z")):
        assert one(spark, raw, T.normalize_markup) == want


def test_tokenize(spark):
    got = one(spark, "No.1091 of 2013", T.tokenize)
    assert got == ["No.1091_of_2013", "no", "1091", "of", "2013"]
    assert {"AIR", "air"} <= set(one(spark, "[AIR 1974 Patna 164].", T.tokenize))
    assert one(spark, None, T.tokenize) is None or one(spark, "", T.tokenize) == []


def test_identifiers(spark):
    assert one(spark, "AIR 1974, Section 9, No.1091 of 2013, dated 24.06.2014", T.identifiers) == ["24.06.2014", "AIR 1974", "No.1091 of 2013", "Section 9"]
    assert one(spark, "No.  1091   of 2013", lambda c: T.squeeze(c)) == "No. 1091 of 2013"
    assert one(spark, "AIR 1974", T.query_kind) == "identifier" and one(spark, "grounds for an injunction", T.query_kind) == "conceptual"


@pytest.mark.parametrize(("text", "want"), [
    ("Learned counsel for the appellants argued for remand.", "argument"),
    ("It has been urged that the tender lapsed.", "argument"),
    ("We find no merit in the revision.", "holding"),
    ("It is well settled, and the bench has held that fences make neighbours.", "holding"),
    ("The lorry left the depot at noon.", "neither"),
    ("It is argued that rent was paid. In our view it was not.", "both"),
])
def test_stance(spark, text, want):
    assert one(spark, text, T.stance) == want


def test_stance_order(spark):
    order = [one(spark, s, T.stance_order) for s in ("both", "holding", "neither", "argument")]
    assert order == sorted(order) and len({one(spark, s, T.stance_note) for s in ("both", "holding", "neither", "argument")}) == 4


def test_authority(spark):
    weigh = lambda court, n: spark.createDataFrame([(court, n)], "c string, n string").select(T.authority(F.col("c"), F.col("n")).alias("w")).first()["w"]
    assert weigh("Supreme Court", "0") == 1.0 and weigh(None, "1000000") == pytest.approx(1.0)
    assert weigh("Tribunal", "?") == pytest.approx(0.6 + math.log1p(1) / math.log1p(1000))


def test_answers(spark):
    parse = lambda a, n: spark.createDataFrame([(a, n)], "a string, n int").select(T.parsed_answer(F.col("a"), F.col("n")).alias("p")).first()["p"].asDict()
    assert parse("X [1], and Y [1, 3] but [7][2].", 3) == {"refused": False, "cited": [1, 3, 2], "invalid": [7]}
    assert parse("[1998] 2 SCC 341", 3)["cited"] == [] and parse(" INSUFFICIENT_CONTEXT", 3)["refused"]
    build = lambda j: one(spark, j, T.structured_answer)
    assert build('{"refused": false, "claims": [{"text": "A", "source_ids": [1, 2]}, {"text": "B", "source_ids": []}]}')["text"] == "A [1, 2]"
    assert build("{}")["refused"] and build('{"refused": false, "claims": []}')["refused"]


def test_small_parsers(spark):
    assert one(spark, "Supported.", T.verdict) == "supported" and one(spark, "well, no", T.verdict) == "unclear"
    assert one(spark, "1. first\n\n- second\n* third\nfourth", T.sub_questions) == ["first", "second", "third"]
    assert one(spark, "<think>x\ny</think> z", T.without_thoughts) == "z"
    assert one(spark, "a <summary>Good one</summary>", T.summary_of) == "Good one" and one(spark, "<summary>Okay, so</summary>", T.summary_of) is None
    for inner, kept in (("Let's see", False), ("need more", False), ("First, the bench", True), ("A sum. No reasoning inside tags", False), ("x" * 2500, True), ("x" * 2501, False), ("", False)):
        assert (one(spark, f"<summary> {inner} </summary>", T.summary_of) == inner) == kept
    assert [one(spark, r, T.relevance_letter) for r in ("Yes", "partly", "no", "", None)] == ["y", "y", "n", "n", "n"]
    assert one(spark, "State of Bihar & Others", T.significant) == ["bihar"]
    assert one(spark, "In No. 12 of 1999 decided", T.case_number) == "No. 12 of 1999"
    assert one(spark, "  Foo   BAR ", T.cache_key) == "foo bar"
    key = spark.createDataFrame([("1.1.1.1, 2", "p"), (None, "p"), (None, None)], "f string, p string").select(T.client_key(F.col("f"), F.col("p")).alias("k")).collect()
    assert [r["k"] for r in key] == ["1.1.1.1", "p", "unknown"]


def test_ngrams(spark):
    assert one(spark, ["a", "b", "c"], lambda c: T.ngrams(c, 2), "array<string>") == ["a b", "b c"]
    assert one(spark, ["a"], lambda c: T.ngrams(c, 2), "array<string>") == []


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, z array<float>")
    r = df.select(V.dot("a", "a").alias("d"), V.normalized(F.col("a")).alias("n"), V.normalized(F.col("z")).alias("z")).first()
    assert r["d"] == 25.0 and r["n"] == pytest.approx([0.6, 0.8]) and r["z"] == [0.0, 0.0]


def test_metrics(spark):
    df = spark.createDataFrame([(["a", "b"], ["a"]), (["a", "b"], ["z"]), ([], ["z"]), (["a"], [])], "got array<string>, rel array<string>")
    rows = df.select(M.recall(F.col("got"), F.col("rel"), 5).alias("r"), M.precision(F.col("got"), F.col("rel"), 5).alias("p"), M.reciprocal_rank(F.col("got"), F.col("rel")).alias("rr")).collect()
    assert [tuple(r) for r in rows] == [(1.0, 0.5, 1.0), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0)]


def test_citations(spark):
    text = "In AIR 1978 SC 597 the law was settled. (2019) 4 SCC 736 was overruled by 2020 SCC OnLine SC 123."
    got = one(spark, text, treatment.court_citations)
    assert [c["key"] for c in got] == ["AIR 1978 SC 597", "2019 SCC 736", "2020 SCC OnLine SC 123"]
    assert all(text[c["start"] : c["start"] + len(c["raw"])] == c["raw"] for c in got)
    df = spark.createDataFrame([("d1", text), ("d2", "AIR 1978 SC 597 was followed. " + "x " * 300 + "overruled")], "id string, text string")
    found = treatment.mentions(df)
    labels = {(r["source_doc_id"], r["citation_key"]): r["treatment"] for r in found.collect()}
    assert labels[("d2", "AIR 1978 SC 597")] == "followed" and labels[("d1", "2019 SCC 736")] == "overruled"
    worst = {r["citation_key"]: r["worst"] for r in treatment.worst_treatment(found).collect()}
    assert worst["AIR 1978 SC 597"] == "overruled"
    assert treatment.warnings(df, treatment.worst_treatment(found)).count() == 2
