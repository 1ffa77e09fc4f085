"""Shared helpers of the training-data operators."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows that a Python worker takes at once; long texts are further cut by bytes.
BATCH_ROWS = 2048
BATCH_CHARS = 1_500_000
BATCH_BYTES = 16 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bounded(df: DataFrame) -> DataFrame:
    """df, after seeing to it that Python workers get few long texts at a time. The session's setting stays lowered, as
    plans read it when they run."""
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        held = int(str(conf.get(name)).removesuffix("b"))
        if held <= 0 or held > most:
            conf.set(name, str(most))
    return df


def batches(rows: Iterable[pa.RecordBatch], size_of: Callable = len) -> Iterator[list[dict]]:
    """Rows as dicts of columns, cut so that no piece has more than BATCH_CHARS unless a single row has."""
    for batch in rows:
        texts = batch.column("text").to_pylist()
        others = {name: batch.column(name).to_pylist() for name in batch.schema.names if name != "text"}
        begin = held = 0
        for i, text in enumerate(texts):
            size = size_of(text) if text else 0
            if i > begin and (held + size > BATCH_CHARS or i - begin >= BATCH_ROWS):
                yield {"text": texts[begin:i]} | {k: v[begin:i] for k, v in others.items()}
                begin, held = i, 0
            held += size
        if begin < len(texts):
            yield {"text": texts[begin:]} | {k: v[begin:] for k, v in others.items()}


def map_texts(docs: DataFrame, fn: Callable[[dict], dict], schema: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """fn gets a dict of column lists (text and keep) and returns one list or array for each column of schema."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(rows):
        for piece in batches(rows):
            out = fn(piece)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    cols = [F.col(c) for c in keep] + [F.col("text").cast("string").alias("text")]
    return bounded(docs.select(*cols)).mapInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one is set only where none is set, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "/tmp/checkpoints/lumenry"
    return found


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to a table in the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = posixpath.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def rows_of(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated ranges start..start+count."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts, counts) + np.repeat(starts, counts)


#: A key with more than one in SHARE of all rows is dealt over several tasks; there are fewer than SHARE such keys.
SHARE = 1024


def hot_keys(counted: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """Of a table of keys and their numbers of rows, the hot ones and into how many parts each is dealt.

    Fewer than SHARE rows whatever the table, and their parts are 2 * SHARE at most: this bound lets them be broadcast.
    """
    total = counted.agg(F.sum(n)).first()[0] or 0
    return stored(counted.where(F.col(n) * SHARE > total).select(*keys, F.ceil(F.col(n) * SHARE / F.lit(max(total, 1))).cast("int").alias("__parts")), "hot")


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame, spread: list[str], how: str = "inner") -> DataFrame:
    """left join right on keys, where rows of left with a hot key are dealt by the columns spread and meet copies of right's rows."""
    few = F.broadcast(hot)
    dealt = left.join(few, keys, "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(*spread), F.col("__parts")), F.lit(0)).cast("int")).drop("__parts")
    copied = right.join(few, keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return dealt.join(copied, [*keys, "__salt"], how).drop("__salt")
