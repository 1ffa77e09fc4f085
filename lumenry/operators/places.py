"""Places of rows in an order over the whole table, without a task that sees all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..storage import stored


def numbered(df: DataFrame, *order: str, place: str = "place") -> tuple[DataFrame, int]:
    """df with each row's place, from 0, in ascending order (nulls first), and the number of rows.

    Rows are dealt by ranges of the order and stored once, so that the ranges' sums and the rows' ranks are taken of the
    same ranges; equal values may change places from run to run. A value that many rows share is one range: give more
    columns of order where one column repeats.
    """
    keys = [F.col(c).asc_nulls_first() for c in order]
    dealt = stored(df.repartitionByRange(*keys).withColumn("__range", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy("__range").agg(F.count("*").alias("__n"))
    upto = F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, 0))
    before = stored(sums.select("__range", (upto - F.col("__n")).alias("__before"), upto.alias("__upto")), "range_sums")
    rank = F.row_number().over(Window.partitionBy("__range").orderBy(*keys))
    rows = dealt.withColumn("__rank", rank).join(before.drop("__upto"), "__range")
    total = before.agg(F.max("__upto")).first()[0] or 0
    return rows.withColumn(place, F.col("__before") + F.col("__rank") - 1).drop("__range", "__rank", "__before"), int(total)
