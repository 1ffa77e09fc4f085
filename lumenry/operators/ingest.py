"""From source rows to documents: normalise, exclude, keep the first row of each key, profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..storage import stored


def exclusion_reason(url: Column, text: Column) -> Column:
    """Why a row is no document: a missing key counts before an empty text; null if it is one."""
    return F.when(F.coalesce(url, F.lit("")) == "", "missing_url").when(F.coalesce(T.strip(text), F.lit("")) == "", "empty_text")


def digest(c: Column) -> Column:
    """256 bits that stand for a long key where rows are shuffled."""
    return F.unhex(F.sha2(c.cast("string"), 256))


def keep_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key, rows without a key going; order is one a row.

    A small aggregation over the key's digest finds it, so no key moves; rows themselves are joined by order and digest.
    """
    keyed = df.where(F.col(key).isNotNull()).withColumn("__key", digest(F.col(key)))
    first = keyed.groupBy("__key").agg(F.min(order).alias(order))
    return keyed.join(first, ["__key", order], "left_semi").drop("__key")


def labels_by_key(df: DataFrame, key: str, label: str) -> DataFrame:
    """Distinct labels of each key over all rows, sorted; keys without labels have an empty array."""
    real = F.when(F.coalesce(F.col(label), F.lit("")) != "", F.col(label))
    return df.groupBy(key).agg(F.array_sort(F.collect_set(real)).alias("labels"))


def documents(raw: DataFrame, seq: str | None = None) -> DataFrame:
    """Documents of raw source rows: excluded rows go, the first row of each address stays, in source order.

    seq names a column of source order; without one, the order in which files are read is taken.
    """
    rows = raw.withColumn("seq", F.col(seq).cast("long") if seq else F.monotonically_increasing_id())
    good = rows.where(exclusion_reason(F.col("Doc_url"), F.col("Text")).isNull())
    kinds = labels_by_key(rows, "Doc_url", "Case_Type")
    first = keep_first(good, "Doc_url", "seq").join(kinds, "Doc_url", "left")
    meta = F.struct(
        F.col("Titles").alias("title"), F.col("Court_Name_Normalized").alias("court"), F.col("Court_Type").alias("court_type"),
        F.coalesce("labels", F.array().cast("array<string>")).alias("case_types"), F.col("Cites").alias("cites"), F.col("Cited_by").alias("cited_by"), F.col("Doc_url").alias("url"),
    )
    return first.select(F.col("Doc_url").alias("id"), T.normalize_markup(F.col("Text")).alias("text"), meta.alias("metadata"), "seq")


def percentiles(df: DataFrame, value: str, shares: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """min, max and, for each share p, the value at place floor(n * p) of ascending order, the last one at most.

    Values are counted first, so what is ordered is one row a distinct value and not one a row.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("long").alias("v")).agg(F.count("*").alias("c"))
    # sums within ranges of values, then of the ranges, one row a range: no task sees all values
    dealt = stored(counts.repartitionByRange("v").withColumn("p", F.spark_partition_id()), "value_counts")
    ranges = dealt.groupBy("p").agg(F.sum("c").alias("held"))
    before = ranges.select("p", F.coalesce(F.sum("held").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("held").over(Window.partitionBy(F.lit(1))).alias("n"))
    within = F.sum("c").over(Window.partitionBy("p").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    rows = dealt.withColumn("within", within).join(before, "p").withColumn("upto", F.col("before") + F.col("within"))
    picks = [F.min(F.when(F.col("upto") > F.least(F.floor(F.col("n") * p), F.col("n") - 1), F.col("v"))) for p in shares]
    return rows.agg(F.coalesce(F.min("v"), F.lit(0)).alias("min"), *[F.coalesce(c, F.lit(0)).alias(f"p{round(p * 100)}") for c, p in zip(picks, shares, strict=True)], F.coalesce(F.max("v"), F.lit(0)).alias("max"))


def profile(raw: DataFrame, key: str, text: str, fields: tuple[str, ...] = ()) -> DataFrame:
    """Rows, documents, repeats, exclusions by reason and missing fields; emitted + duplicates + excluded = rows."""
    reason = exclusion_reason(F.col(key), F.col(text))
    flagged = raw.select(digest(F.col(key)).alias("k"), reason.alias("reason"), *[(F.coalesce(F.col(f).cast("string"), F.lit("")) == "").alias(f"m_{f}") for f in fields])
    per_key = flagged.groupBy("k").agg(
        F.count("*").alias("n"), F.count_if(F.col("reason").isNull()).alias("good"), F.count_if(F.col("reason") == "missing_url").alias("u"), F.count_if(F.col("reason") == "empty_text").alias("t"), *[F.count_if(f"m_{f}").alias(f"m_{f}") for f in fields]
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return per_key.agg(
        total("n").alias("source_rows"), F.count_if(F.col("good") > 0).alias("emitted"), total(F.greatest(F.col("good") - 1, F.lit(0))).alias("duplicates"),
        total("u").alias("excluded_missing_url"), total("t").alias("excluded_empty_text"), *[total(f"m_{f}").alias(f"missing_{f}") for f in fields],
    )


def check_accounts(row: dict) -> None:
    """Raises unless every source row is emitted, a duplicate or excluded."""
    if row["emitted"] + row["duplicates"] + row["excluded_missing_url"] + row["excluded_empty_text"] != row["source_rows"]:
        raise ValueError(f"rows don't add up: {row}")
