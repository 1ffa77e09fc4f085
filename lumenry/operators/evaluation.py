"""Evaluation of rankings against labels, samples, and profiles of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions import metrics as M
from ..storage import stored
from .places import numbered


def query_results(ranked: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """query_id, kind, recall, precision, reciprocal_rank of every labelled query, also of those that found nothing.

    ranked: query_id, rank, id. labels: query_id, kind, relevant.
    """
    lists = ranked.where(F.col("rank") <= k).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x.id).alias("retrieved"))
    rows = labels.join(lists, "query_id", "left")
    got = F.coalesce(F.col("retrieved"), F.slice("relevant", 1, 0))
    return rows.select("query_id", "kind", M.recall(got, F.col("relevant"), k).alias("recall"), M.precision(got, F.col("relevant"), k).alias("precision"), M.reciprocal_rank(got, F.col("relevant")).alias("reciprocal_rank"))


def summary(results: DataFrame, by: str = "kind") -> DataFrame:
    """Means by kind and over all (named all), in one pass."""
    grouped = results.rollup(by).agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in ("recall", "precision", "reciprocal_rank")], F.grouping(by).alias("g"))
    return grouped.withColumn(by, F.when(F.col("g") == 1, "all").otherwise(F.col(by))).drop("g")


def sweep(configs: dict[str, DataFrame], labels: DataFrame, k: int) -> DataFrame:
    """Summaries of several configurations in one plan."""
    rows = None
    for name, ranked in configs.items():
        one = query_results(ranked, labels, k).withColumn("config", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    grouped = rows.groupingSets([("config", "kind"), ("config",)], "config", "kind").agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in ("recall", "precision", "reciprocal_rank")])
    return grouped.withColumn("kind", F.coalesce("kind", F.lit("all")))


def changed(before: DataFrame, after: DataFrame, places: int = 6) -> DataFrame:
    """query_id, rank, id, score of both sides where two rankings(query_id, rank, id, score) differ: another id at a rank, a rank
    that one of them lacks, or a score that differs at so many places. No row: nothing has changed."""
    side = lambda df, name: df.select("query_id", "rank", F.col("id").alias(f"{name}_id"), F.round("score", places).alias(f"{name}_score"))
    both = side(before, "before").join(side(after, "after"), ["query_id", "rank"], "full")
    same = F.col("before_id").eqNullSafe(F.col("after_id")) & F.col("before_score").eqNullSafe(F.col("after_score"))
    return both.where(~same)


def overlap(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """query_id, shared: ids among both first k."""
    both = a.where(F.col("rank") <= k).select("query_id", "id").join(b.where(F.col("rank") <= k).select("query_id", "id"), ["query_id", "id"])
    return both.groupBy("query_id").agg(F.count("*").alias("shared"))


def systematic_sample(df: DataFrame, order: str, limit: int) -> DataFrame:
    """Every step-th row in order, limit rows at most; step is rows / limit, 1 at least. Equal values come by digest of their rows.

    The order and digests alone are numbered; whole rows only meet the `limit` chosen ones.
    """
    digest = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    places, n = numbered(df.select(F.col(order).alias("__order"), digest.alias("__digest")), "__order", "__digest", place="__place")
    step = max(1, n // limit)
    at = F.col("__place")
    wanted = stored(places.where((at % step == 0) & (at < step * limit)).groupBy("__order", "__digest").agg(F.count("*").alias("__wanted")), "sample")
    rows = df.withColumn("__row", digest).join(wanted, F.col(order).eqNullSafe(F.col("__order")) & (F.col("__row") == F.col("__digest")))
    again = F.row_number().over(Window.partitionBy("__order", "__digest").orderBy(F.lit(0)))
    return rows.withColumn("__again", again).where("__again <= __wanted").select(*df.columns)


def stratified_sample(df: DataFrame, by: str, id: str, n: int, seed: int = 0) -> DataFrame:
    """n rows of each stratum, by the digest of seed and id; ties by id."""
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col(id).cast("string")))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(key, id))
    return df.withColumn("draw", rank).where(F.col("draw") <= n)


def probe_pool(df: DataFrame, positives: DataFrame, id: str, n: int, seed: int = 0) -> DataFrame:
    """All positives and n other rows drawn by the digest of seed and id, with a flag."""
    wanted = positives.select(id).distinct()
    good = df.join(wanted, id, "left_semi").withColumn("positive", F.lit(True))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col(id).cast("string")))
    rest = df.join(wanted, id, "left_anti").withColumn("draw", key).orderBy("draw", id).limit(n).drop("draw").withColumn("positive", F.lit(False))
    return good.unionByName(rest)


def confusion(df: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, n and the share of a's rows; one row a pair that occurs."""
    counts = df.groupBy(a, b).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(a)), 6))


def distribution(df: DataFrame, label: Column, by: str | None = None) -> DataFrame:
    """label, n, percent, within each value of by."""
    groups = ([by] if by else []) + ["label"]
    counts = df.withColumn("label", label).groupBy(*groups).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(by) if by else Window.partitionBy(F.lit(1)))
    return counts.withColumn("percent", F.round(100.0 * F.col("n") / total, 6))


def authority_profile(df: DataFrame, by: str, cited: str, top: Column) -> DataFrame:
    """Median and mean citations and the share of top-court texts, by group."""
    return df.groupBy(by).agg(F.median(cited).cast("double").alias("median_cited"), F.round(F.avg(cited), 6).alias("mean_cited"), F.round(F.avg(top.cast("double")), 6).alias("top_share"))


def most_common(df: DataFrame, value: str, n: int) -> DataFrame:
    return df.groupBy(value).agg(F.count("*").alias("n")).orderBy(F.desc("n"), value).limit(n)


def described(df: DataFrame, value: str) -> DataFrame:
    """Mean, median, the value at place floor(0.9 n) of ascending order, the greatest, and the percentage of zeros."""
    from .ingest import percentiles

    means = df.where(F.col(value).isNotNull()).agg(F.round(F.avg(value), 6).alias("mean"), F.median(value).cast("double").alias("median"), F.round(100 * F.avg((F.col(value) == 0).cast("double")), 6).alias("zero_percent"))
    places = percentiles(df, value, (0.9,)).select("p90", "max")
    return means.withColumn("one", F.lit(1)).join(places.withColumn("one", F.lit(1)), "one").drop("one")


def agreement(labelled: DataFrame, a: str = "regex", b: str = "model", declined: str = "neither") -> DataFrame:
    """One row: pairs with both labels, those that agree and their share, and how many that a declined to label b did not.

    Rows where a label is missing are counted as skipped.
    """
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    out = labelled.agg(
        F.count_if(both).alias("judged"), F.count_if(both & (F.col(a) == F.col(b))).alias("agreed"), F.count_if(~both).alias("skipped"),
        F.count_if(both & (F.col(a) == declined)).alias("declined"), F.count_if(both & (F.col(a) == declined) & (F.col(b) != declined)).alias("missed"),
    )
    share = lambda x, y: F.round(F.coalesce(F.try_divide(F.col(x).cast("double"), F.col(y).cast("double")), F.lit(0.0)), 6)
    return out.withColumn("agreement", share("agreed", "judged")).withColumn("missed_rate", share("missed", "declined"))


def pool_overlap(pooled: DataFrame) -> DataFrame:
    """One row of a pool(query_id, id, systems): what systems returned, what is left of it once, and the share they agree on."""
    out = pooled.agg(F.coalesce(F.sum(F.size("systems")), F.lit(0)).cast("long").alias("returned"), F.count("*").alias("distinct"))
    return out.withColumn("overlap", F.round(F.coalesce(1 - F.try_divide(F.col("distinct").cast("double"), F.col("returned").cast("double")), F.lit(0.0)), 6))


def shuffled(pooled: DataFrame, seed: int = 0) -> DataFrame:
    """Each query's candidates in an order that tells nothing of their rank: by the digest of seed, query and id."""
    draw = F.md5(F.concat_ws(":", F.lit(seed), F.col("query_id").cast("string"), F.col("id").cast("string")))
    return pooled.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(draw, "id")))


def head(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first n rows in order."""
    return df.orderBy(order).limit(n)


def of_kind(labels: DataFrame, kind: str = "conceptual") -> DataFrame:
    return labels.where(F.col("kind") == kind)
