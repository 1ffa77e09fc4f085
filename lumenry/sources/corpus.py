"""Reading and writing: source rows, labels, query lists, index tables, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..schemas import LABEL, RAW, REQUEST_LOG, expect


def read_raw(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """Source rows of court texts by their schema, never inferred."""
    return spark.read.schema(RAW).format(format).load(path)


def read_jsonl(spark: SparkSession, path: str, schema, expected: int | None = None) -> DataFrame:
    """Payload lines; raises if there are not as many as expected."""
    df = spark.read.schema(schema).json(path)
    if expected is not None and (n := df.count()) != expected:
        raise ValueError(f"{n} payloads for {expected} ids")
    return df


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labelled queries of a file that is one JSON array, or of JSON lines."""
    return spark.read.schema(LABEL).option("multiLine", True).json(path)


def write_labels(labels: DataFrame, path: str) -> None:
    """Labels as JSON lines; queries without a relevant chunk are no labels."""
    labels.where(F.size("relevant_chunk_ids") > 0).select(*LABEL.fieldNames()).write.mode("overwrite").json(path)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """query_id and query of each line of a text file, without blank lines and comments."""
    lines = spark.read.text(path).select(T.strip(F.col("value")).alias("query"))
    good = lines.where((F.col("query") != "") & ~F.startswith("query", F.lit("#")))
    return good.select(F.md5("query").alias("query_id"), "query")


def write_index(vectors: DataFrame, path: str, model: str, dim: int, rows_a_file: int = 50_000, payloads: DataFrame | None = None) -> None:
    """Vectors in files of a bounded number of rows; model and size stand in a table beside them, and so do the chunks' payloads."""
    vectors.write.mode("overwrite").option("maxRecordsPerFile", rows_a_file).parquet(f"{path}/vectors")
    if payloads is not None:
        payloads.write.mode("overwrite").parquet(f"{path}/payloads")
    meta = vectors.agg(F.count("*").alias("count")).select(F.lit(model).alias("model"), F.lit(dim).alias("dim"), "count", F.lit(True).alias("normalized"))
    meta.write.mode("overwrite").parquet(f"{path}/meta")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/payloads")


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A graph of neighbours anew: its nodes, and its edges near each other by source, so that a lookup reads few files."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.repartitionByRange("source_id").sortWithinPartitions("source_id").write.mode("overwrite").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def index_is_complete(spark: SparkSession, path: str) -> bool:
    """Whether both tables of an index were written to their end."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return all(fs.exists(hadoop.Path(f"{path}/{t}/_SUCCESS")) for t in ("vectors", "meta"))


def read_index(spark: SparkSession, path: str, model: str, dim: int) -> DataFrame:
    """Vectors of an index; one of another model or size is an error, as is one that isn't whole."""
    if not index_is_complete(spark, path):
        raise RuntimeError(f"no whole index at {path}")
    meta = spark.read.parquet(f"{path}/meta").first()
    if (meta["model"], meta["dim"]) != (model, dim):
        raise ValueError(f"the index holds {meta['model']} vectors of {meta['dim']}, asked for {model} of {dim}")
    return spark.read.parquet(f"{path}/vectors")


def ensure_index(spark: SparkSession, path: str, source: str | None) -> str:
    """Copies an index from another store unless it is here; without a source nothing happens."""
    if source and not index_is_complete(spark, path):
        for t in ("vectors", "meta"):
            spark.read.parquet(f"{source}/{t}").write.mode("overwrite").parquet(f"{path}/{t}")
        if not index_is_complete(spark, path):
            raise RuntimeError(f"the copy of {source} isn't whole")
    return path


def append(df: DataFrame, path: str) -> None:
    """Appends rows to a log."""
    df.write.mode("append").parquet(path)


def append_new(df: DataFrame, path: str, key: str) -> None:
    """Appends the rows whose key isn't there yet, one a key: an insert that ignores what it finds."""
    spark, new = df.sparkSession, df.dropDuplicates([key])
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    there = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop.Path(path))
    append(new.join(spark.read.parquet(path).select(key), key, "left_anti") if there else new, path)


def request_log(answered: DataFrame, client: Column, route: str, k: int, at: Column | None = None) -> DataFrame:
    """Rows of REQUEST_LOG for answers(query_id, query, refused, cited, invalid, gap); times of stages are unknown in a batch."""
    none = F.lit(None)
    rows = answered.select(
        F.md5(F.concat_ws(":", F.col("query_id").cast("string"), "query")).alias("request_id"), (F.current_timestamp() if at is None else at).cast("string").alias("ts"), client.cast("string").alias("client"), "query", F.lit(route).alias("route"), F.lit(k).alias("k"),
        "refused", "cited", "invalid", F.col("gap").cast("double").alias("score_gap"), none.cast("long").alias("retriever_ms"), none.cast("long").alias("generation_ms"), none.cast("string").alias("error"),
    )
    return expect(rows, REQUEST_LOG)


def latest(df: DataFrame, key: str, at: str) -> DataFrame:
    """The last version of each key of an append-only table: what an upsert would have left."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), at).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def preferences(feedback: DataFrame) -> DataFrame:
    """prompt, chosen and rejected of feedback(query, corrected, original), for preference training."""
    return feedback.select(F.col("query").alias("prompt"), F.col("corrected").alias("chosen"), F.col("original").alias("rejected"))


def write_preferences(feedback: DataFrame, path: str) -> None:
    """Preferences as JSON lines."""
    preferences(feedback).write.mode("overwrite").json(path)


def missing_summaries(docs: DataFrame, summaries: DataFrame, id: str = "id") -> DataFrame:
    """Documents that no summary is stored for yet."""
    return docs.join(summaries.select(F.col("doc_id").alias(id)), id, "left_anti")


def write_scores(scores: DataFrame, path: str) -> None:
    scores.write.mode("overwrite").option("header", True).csv(path)


def page_text(html: Column) -> Column:
    """Text of a web page: scripts and styles go with what they hold, then all tags; white space is single."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return T.squeeze(F.regexp_replace(bare, r"(?s)<[^>]+>", " "))
