"""Models behind small interfaces, each with a deterministic stand-in that needs no network.

Models run inside mapInArrow, one instance a worker; SQL expressions never call one. Retries are here and nowhere else.
"""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T


class Embedder(Protocol):
    name: str
    dim: int

    def documents(self, texts: list[str]) -> np.ndarray: ...

    def queries(self, texts: list[str]) -> np.ndarray: ...


class Model(Protocol):
    def complete(self, system: str, prompt: str) -> str: ...


class Places(dict):
    """Of each word its place, or with sign -1 its place after `dim` more: digests are taken once, and forgotten beyond MOST words."""

    MOST = 500_000

    def __init__(self, dim: int):
        self.dim = dim

    def __missing__(self, word: str) -> int:
        d = hashlib.md5(word.encode()).digest()
        if len(self) >= self.MOST:
            self.clear()
        place = self[word] = int.from_bytes(d[:4], "big") % self.dim + (0 if d[4] & 1 else self.dim)
        return place


class HashedWords:
    """Signed counts of words in places given by a digest; unit length, zeros for a text without words."""

    def __init__(self, dim: int = 64, prefix: str = ""):
        self.dim, self.prefix, self.name = dim, prefix, f"hashed-words-{dim}"
        self.places = Places(dim)

    def _one(self, text: str) -> np.ndarray:
        places = list(map(self.places.__getitem__, re.findall(r"[a-z0-9]+", text.lower())))
        counts = np.bincount(np.array(places, np.int64), minlength=2 * self.dim)
        out = (counts[: self.dim] - counts[self.dim :]).astype(float)
        return out / max(float(np.linalg.norm(out)), 1e-9)

    def documents(self, texts: list[str]) -> np.ndarray:
        return np.array([self._one(t) for t in texts]).reshape(-1, self.dim)

    def queries(self, texts: list[str]) -> np.ndarray:
        return self.documents([self.prefix + t for t in texts])


def embed(df: DataFrame, embedder: Embedder, id: str = "id", text: str = "text", as_query: bool = False, batch: int = 64, tries: int = 5, pause: float = 0.0) -> DataFrame:
    """id and embedding of each text, a batch of texts at a time; a busy server is tried again, and calls are `pause` seconds apart."""
    kind = df.schema[id].dataType.simpleString()

    def run(rows):
        call = embedder.queries if as_query else embedder.documents
        began = False
        for r in rows:
            texts, parts = [t or "" for t in r.column(1).to_pylist()], []
            for i in range(0, len(texts), batch):
                if began and pause:
                    time.sleep(pause)
                parts.append(patient(lambda i=i: call(texts[i : i + batch]), tries))
                began = True
            flat = np.concatenate(parts).astype(np.float32) if parts else np.zeros((0, embedder.dim), np.float32)
            vectors = pa.FixedSizeListArray.from_arrays(pa.array(flat.reshape(-1)), embedder.dim).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([r.column(0), vectors], names=["id", "embedding"])

    return df.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, embedding array<float>")


def truncated(df: DataFrame, text: str, most: int, measure: Column | None = None) -> DataFrame:
    """How many texts an embedder would cut: those that measure more than it takes, by words unless told otherwise."""
    size = F.size(T.found(F.col(text), r"\S+")) if measure is None else measure
    return df.agg(F.count("*").alias("n"), F.count_if(size > most).alias("truncated"))


def _words(c: Column) -> Column:
    return T.found(F.lower(c), "[a-z0-9]+")


def lexical_features(c: Column) -> Column:
    """struct(words, pairs): distinct words of a text and distinct pairs of words side by side."""
    return T.once(_words(c), lambda w: F.struct(F.array_distinct(w).alias("words"), T.ngrams(w, 2).alias("pairs")))


def feature_relevance(query: Column, text: Column) -> Column:
    """A reranker's stand-in over lexical_features: the share of a query's words in a text, and of its word pairs there in order."""
    share = lambda a, b: F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(a).cast("double")), F.lit(0.0))
    return share(query["words"], text["words"]) + 0.5 * share(query["pairs"], text["pairs"])


def scored_candidates(found: DataFrame, queries: DataFrame, texts: DataFrame) -> DataFrame:
    """found(query_id, id, ...) with relevance. Features are made once a query and once a text that was found at all, not once a pair."""
    asked = queries.select("query_id", lexical_features(F.col("query")).alias("q"))
    held = texts.join(found.select("id").distinct(), "id", "left_semi").select("id", lexical_features(F.col("text")).alias("t"))
    return found.join(asked, "query_id").join(held, "id").withColumn("relevance", feature_relevance(F.col("q"), F.col("t"))).drop("q", "t")


class Scripted:
    """A model that replies by rule: the first pattern found in the prompt."""

    def __init__(self, replies: list[tuple[str, str]], otherwise: str = T.REFUSAL):
        self.replies, self.otherwise = replies, otherwise

    def complete(self, system: str, prompt: str) -> str:
        return next((reply for pattern, reply in self.replies if re.search(pattern, prompt)), self.otherwise)


class Extractive:
    """A model that answers with the first sentence of the first source, or refuses without sources."""

    def complete(self, system: str, prompt: str) -> str:
        first = re.search(r"(?m)^\[1\] (?:\([^)]*\) )?(.+?[.?!])(?:\s|$)", prompt)
        return f"{first[1].rstrip('.?!')} [1]." if first else T.REFUSAL


#: Replies of a server that are worth another try.
AGAIN = (429, 500, 502, 503, 504)


class Unavailable(RuntimeError):
    def __init__(self, status: int | None = None):
        super().__init__(f"status {status}")
        self.status = status


def patient(call: Callable, tries: int = 4, longest: float = 30.0, sleep: Callable[[float], None] = time.sleep):
    """The call's result; busy servers and broken transports are tried again with growing pauses."""
    for n in range(tries):
        try:
            return call()
        except Unavailable as e:
            if n + 1 == tries or e.status is not None and e.status not in AGAIN:
                raise
            sleep(min(longest, 2.0**n))
    raise RuntimeError("no tries")


def complete(df: DataFrame, make: Callable[[], Model], prompt: str = "prompt", system: str = "", tries: int = 4, again: Callable[[str], bool] | None = None) -> DataFrame:
    """df with reply and truncated: what a model says to each prompt, null after the last failed try, and whether it was cut off.

    A model tells by `last_finish_reason` that it ran out of room. With `again`, a cut-off reply that it accepts is asked
    for once more with twice the model's `max_tokens`.
    """
    from pyspark.sql.types import BooleanType, StringType, StructField, StructType

    def cut(model: Model) -> bool:
        return getattr(model, "last_finish_reason", None) == "length"

    def ask(model: Model, p: str) -> tuple[str | None, bool]:
        try:
            reply = patient(lambda: model.complete(system, p), tries)
            if again and cut(model) and hasattr(model, "max_tokens") and again(reply):
                room, model.max_tokens = model.max_tokens, 2 * model.max_tokens
                try:
                    reply = patient(lambda: model.complete(system, p), tries)
                finally:
                    model.max_tokens = room
            return reply, cut(model)
        except Unavailable:
            return None, False

    def run(rows):
        model = make()
        for r in rows:
            got = [ask(model, p) for p in r.column(prompt).to_pylist()]
            yield pa.RecordBatch.from_arrays([*r.columns, pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.bool_())], names=[*r.schema.names, "reply", "truncated"])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField("reply", StringType()), StructField("truncated", BooleanType())]))


class Reranker(Protocol):
    def score(self, query: str, texts: list[str]) -> list[float]: ...


class WordOverlap:
    """A reranker's stand-in: the share of a query's words that a text holds."""

    def score(self, query: str, texts: list[str]) -> list[float]:
        want = set(re.findall(r"[a-z0-9]+", query.lower()))
        return [len(want & set(re.findall(r"[a-z0-9]+", t.lower()))) / max(1, len(want)) for t in texts]


def relevance(pairs: DataFrame, make: Callable[[], Reranker], batch: int = 16) -> DataFrame:
    """pairs(query, text, ...) with relevance: what a reranker says of them, some texts of one query at a time."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    def run(rows):
        scorer = make()
        for r in rows:
            queries, texts = r.column("query").to_pylist(), [t or "" for t in r.column("text").to_pylist()]
            out, i = [], 0
            while i < len(texts):
                j = i + 1
                while j < len(texts) and j - i < batch and queries[j] == queries[i]:
                    j += 1
                out += map(float, scorer.score(queries[i] or "", texts[i:j]))
                i = j
            yield pa.RecordBatch.from_arrays([*r.columns, pa.array(out, pa.float64())], names=[*r.schema.names, "relevance"])

    return pairs.mapInArrow(run, StructType([*pairs.schema.fields, StructField("relevance", DoubleType())]))


def chosen(kinds: dict[str, Callable[[], Model]], name: str | None = None, variable: str = "LUMENRY_MODEL") -> Callable[[], Model]:
    """The maker of a model by its name, else by an environment variable's, else the first one."""
    import os

    name = name or os.environ.get(variable) or next(iter(kinds))
    if name not in kinds:
        raise ValueError(f"no model {name}: {', '.join(kinds)}")
    return kinds[name]
