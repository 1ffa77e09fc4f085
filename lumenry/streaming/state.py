"""Operators with state: a sliding-window limiter, a cache of answers, and an index build that resumes.

Acceptance feeds back into a limiter's state, and hits into a cache's, so neither is a window aggregate: each key's events
are replayed in order. In batch that is a grouped function, in a stream the same step runs on kept state.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import text as T
from ..sources.versions import Store

LIMIT, WINDOW = 20, 300.0


def admit(accepted: list[float], at: float, limit: int, window: float) -> tuple[bool, list[float]]:
    """Whether an event is let through, and the accepted times that still count. Denied events leave no trace."""
    recent = [t for t in accepted if at - t <= window]
    return (True, [*recent, at]) if len(recent) < limit else (False, recent)


def replay_limiter(events: DataFrame, key: str = "user_id", at: str = "ts", id: str = "event_id", limit: int = LIMIT, window: float = WINDOW) -> DataFrame:
    """id, key, allowed of all events, each key's in order of time."""
    kinds = {c: t for c, t in events.dtypes}
    rows = events.select(F.col(id).alias("id"), F.col(key).alias("key"), (F.unix_micros(F.col(at).cast("timestamp")) / 1e6).alias("t"))

    def replay(held: list[float], row: tuple) -> tuple[bool, list[float]]:
        return admit(held, row[2], limit, window)

    return in_order(rows, "key", ["t", "id"], list, replay, "id", f"id {kinds[id]}, key {kinds[key]}, allowed boolean")


def in_order(rows: DataFrame, key: str, order: list[str], fresh: Callable, step: Callable, id: str, schema: str) -> DataFrame:
    """id, key and a flag of each row: step(state, row) gives the flag and the key's next state, beginning with fresh().

    Rows arrive sorted within their partition and are taken a batch at a time, with one key's state held: a key of any
    number of rows needs the memory of a batch. Its rows stay in one task, as each hangs on those before it.
    """
    names = schema.replace(",", "").split()[::2]
    sorted_rows = rows.repartition(key).sortWithinPartitions(key, *order)

    def run(batches):
        now, state = object(), None
        for batch in batches:
            flags = []
            keys = batch.column(key).to_pylist()
            for k, row in zip(keys, zip(*(c.to_pylist() for c in batch.columns), strict=True), strict=True):
                if k != now:
                    now, state = k, fresh()
                flag, state = step(state, row)
                flags.append(flag)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ([id, key] if names[0] == id else [key, id])), pa.array(flags, pa.bool_())], names=names)

    return sorted_rows.mapInArrow(run, schema)


def stream_limiter(events: DataFrame, limit: int = LIMIT, window: float = WINDOW) -> DataFrame:
    """The same over a stream of events(id, key, t): state is each key's accepted times within the window."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["t", "id"], kind="stable")
        allowed = []
        for t in rows["t"]:
            ok, held = admit(held, float(t), limit, window)
            allowed.append(ok)
        state.update((held,))
        yield pd.DataFrame({"id": rows["id"], "key": key[0], "allowed": allowed})

    kinds = dict(events.dtypes)
    return events.groupBy("key").applyInPandasWithState(step, f"id {kinds['id']}, key {kinds['key']}, allowed boolean", "held array<double>", "append", "NoTimeout")


@dataclass
class AnswerCache:
    """Answers by question: identifiers hit on equal questions alone, others on the nearest vector at or over `near`.

    Kinds of payload have entries of their own; the oldest entry goes when there are too many.
    """

    most: int = 200
    near: float = 0.97
    entries: OrderedDict = field(default_factory=OrderedDict)
    hits: int = 0
    misses: int = 0

    @staticmethod
    def key(query: str) -> str:
        return " ".join(query.split()).lower()

    def get(self, query: str, kind: str, vector: np.ndarray | None = None, payload_kind: str = "answer"):
        found = None
        if kind == "identifier":
            found = self.entries.get((payload_kind, kind, self.key(query)))
        elif vector is not None:
            near = [(float(v @ vector), p) for (pk, k, _), (p, v) in self.entries.items() if (pk, k) == (payload_kind, kind) and v is not None]
            if near and (best := max(near, key=lambda x: x[0]))[0] >= self.near:
                found = (best[1], None)
        self.hits += found is not None
        self.misses += found is None
        return found[0] if found else None

    def put(self, query: str, kind: str, payload, vector: np.ndarray | None = None, payload_kind: str = "answer") -> None:
        self.entries[(payload_kind, kind, self.key(query))] = (payload, vector)
        while len(self.entries) > self.most:
            self.entries.popitem(last=False)

    @property
    def hit_rate(self) -> float:
        return self.hits / n if (n := self.hits + self.misses) else 0.0


def replay_cache(events: DataFrame, most: int = 200, near: float = 0.97) -> DataFrame:
    """session, seq, hit of questions(session, seq, query) asked one after another, each session with its own cache.

    With columns kind and embedding, conceptual questions hit on vectors near enough; without, all are equal-text ones.
    """
    both = {"kind", "embedding"} <= set(events.columns)
    more = ["kind", F.col("embedding").cast("array<double>").alias("embedding")] if both else [F.lit("identifier").alias("kind"), F.lit(None).cast("array<double>").alias("embedding")]
    rows = events.select("session", "seq", T.cache_key(F.col("query")).alias("query"), *more)
    kind = dict(rows.dtypes)

    def ask(cache: AnswerCache, row: tuple) -> tuple[bool, AnswerCache]:
        _, _, query, how, vector = row
        vector = None if vector is None else np.array(vector)
        hit = cache.get(query or "", how, vector) is not None
        if not hit:
            cache.put(query or "", how, True, vector)
        return hit, cache

    return in_order(rows, "session", ["seq"], lambda: AnswerCache(most, near), ask, "seq", f"session {kind['session']}, seq {kind['seq']}, hit boolean")


def pending(chunks: DataFrame, done: DataFrame, id: str = "id") -> DataFrame:
    """Chunks that no stored vector is there for: what a build that was broken off has still to do."""
    return chunks.join(done.select(F.col("chunk_id").alias(id)), id, "left_anti")


def stream_index(chunks: DataFrame, embed: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Embeds a stream of chunks into a table; a batch that is run again writes its own folder anew, so nothing doubles."""

    def write(batch: DataFrame, number: int) -> None:
        embed(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_build(chunks: DataFrame, embed: Callable[[DataFrame], DataFrame], store: Store, checkpoint: str):
    """Embeds a stream of chunks into a store's tables payloads and vectors, each batch in one version.

    Vectors are made of the payloads as they were written. A build that breaks off between the two, or before the version
    is there, leaves nothing that a reader sees; started again, it writes the same batch in the same place, and a batch whose
    version is there already isn't written again.
    """

    def write(batch: DataFrame, number: int) -> None:
        store.commit({"payloads": batch, "vectors": lambda written: embed(written["payloads"])}, tag=f"batch-{number}")

    return chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, at: str = "ts", kind: str = "event_type", width: str = "1 hour", late: str | None = None) -> DataFrame:
    """Events by window and kind; with `late`, of a stream whose late rows are waited for so long."""
    rows = events.withColumn("at", F.col(at).cast("timestamp"))
    rows = rows.withWatermark("at", late) if late else rows
    return rows.groupBy(F.window("at", width).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def hit_rates(replayed: DataFrame) -> DataFrame:
    return replayed.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.round(F.avg(F.col("hit").cast("double")), 6).alias("hit_rate"))


