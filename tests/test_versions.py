"""Versioned tables: broken writers, two writers, upserts, compaction, and an index build that is killed."""

import threading

import pytest
from pyspark.sql import functions as F

from lumenry.plans import providers
from lumenry.sources.versions import Conflict, Store
from lumenry.streaming import state


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_commits_are_whole(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s")
    assert store.version() == 0
    with pytest.raises(ValueError):
        store.read("a")
    df = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    assert store.commit({"a": df, "b": lambda done: done["a"].withColumn("v", F.upper("v"))}) == 1
    assert rows(store.read("a"), "k", "v") == [(1, "x"), (2, "y")] and rows(store.read("b"), "v") == [("X",), ("Y",)]

    def broken(done):
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError, match="killed"):
        store.commit({"a": df, "b": broken})
    assert store.version() == 1 and store.read("a").count() == 2
    assert len(store.clean()) == 1 and store.clean() == [] and store.read("a").count() == 2
    assert store.commit({"a": df}, tag="t") == 2 and store.commit({"a": df}, tag="t") == 2
    assert store.read("a").count() == 4 and store.read("a", 1).count() == 2
    with pytest.raises(Conflict):
        store.commit({"a": df}, base=1)


def test_two_writers_leave_one_row_a_key(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s")
    failed = []

    def write(writer):
        try:
            for step in range(3):
                keys = spark.range(step * 10, step * 10 + 20).select(F.col("id").alias("k"), F.lit(writer).alias("v"))
                store.insert_new("summaries", keys.union(keys), "k")
        except Exception as e:  # told by the main thread
            failed.append(e)

    threads = [threading.Thread(target=write, args=(w,)) for w in ("one", "two", "three")]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    assert [k for (k,) in rows(store.read("summaries"), "k")] == list(range(40))


def test_upserts_and_compaction(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s")
    make = lambda *r: spark.createDataFrame(r, "session string, at int, text string")
    store.upsert("sessions", make(("a", 1, "first"), ("b", 1, "only"), ("a", 2, "second"), (None, 1, "no key")), "session", "at")
    store.upsert("sessions", make(("a", 0, "later commit"), ("c", 1, "new")), "session", "at")
    want = [("a", "later commit"), ("b", "only"), ("c", "new")]
    latest = lambda v=None: rows(store.latest("sessions", "session", v).where("session is not null"), "session", "text")
    assert latest() == want and latest(1) == [("a", "second"), ("b", "only")]
    before = store.version()
    assert store.compact("sessions", "session") == before + 1 and len(store.parts("sessions")) == 1
    assert latest() == want and store.read("sessions").count() == 4 and latest(1) == [("a", "second"), ("b", "only")]
    store.upsert("sessions", make(("b", 9, "again")), "session", "at")
    assert latest()[1] == ("b", "again") and store.compact("sessions", "session") and latest()[1] == ("b", "again")
    assert store.compact("sessions", "session") == store.version()
    store.clean()
    assert latest()[1] == ("b", "again") and store.latest("sessions", "session").columns == ["session", "at", "text"]


def test_a_build_that_is_killed_between_payloads_and_vectors(spark, tmp_path):
    e = providers.HashedWords(8)
    chunks = spark.createDataFrame([(i, f"text {i}") for i in range(6)], "id long, text string")
    chunks.where("id < 3").write.parquet(f"{tmp_path}/in")
    store, killed = Store(spark, f"{tmp_path}/ix"), []

    def embed(payloads):
        if not killed and payloads.where("id >= 3").count():
            killed.append(1)
            raise RuntimeError("killed")
        return providers.embed(payloads, e)

    def build():
        stream = spark.readStream.schema(chunks.schema).parquet(f"{tmp_path}/in")
        state.stream_build(stream, embed, store, f"{tmp_path}/cp").awaitTermination(120)

    build()
    assert store.version() == 1 and store.read("vectors").count() == 3
    chunks.where("id >= 3").write.mode("append").parquet(f"{tmp_path}/in")
    with pytest.raises(Exception, match="killed"):
        build()
    assert (tmp_path / "ix/data/batch-1/payloads").exists() and not (tmp_path / "ix/data/batch-1/vectors").exists()
    assert store.version() == 1 and store.read("payloads").count() == store.read("vectors").count() == 3
    build()
    build()
    assert store.version() == 2 and rows(store.read("payloads"), "id") == rows(store.read("vectors"), "id") == [(i,) for i in range(6)]
